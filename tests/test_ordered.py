import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlake.plans import bounds, ordered


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds a third of the rows, and half of the order values are the same."""
    rng = random.Random(3)
    data = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        when = 500 if rng.random() < 0.5 else rng.randrange(1000)
        data.append((key, when, i, float(rng.randrange(100))))
    return spark.createDataFrame(data, "key string, at int, id long, v double").repartition(5).persist()


def expected(rows):
    pdf = rows.toPandas().sort_values(["key", "at", "id"])
    pdf["pos"] = pdf.groupby("key").cumcount()
    pdf["total"] = pdf.groupby("key")["v"].cumsum()
    pdf["next"] = pdf.groupby("key")["id"].shift(-1)
    pdf["last3"] = pdf.groupby("key")["v"].transform(lambda s: s.rolling(3, min_periods=1).sum())
    return pdf.set_index("id").sort_index()


@pytest.mark.parametrize("limit", [1, 7, 50, 10_000])
def test_positions_and_sums(rows, limit):
    want = expected(rows)
    got = ordered.with_position(rows, ["key"], ["at", "id"], limit=limit).toPandas().set_index("id").sort_index()
    assert got["pos"].tolist() == want["pos"].tolist()
    sums = ordered.prefix_sums(rows, ["key"], ["at", "id"], {"total": F.col("v")}, limit=limit)
    assert sums.toPandas().set_index("id").sort_index()["total"].tolist() == want["total"].tolist()


@pytest.mark.parametrize("limit", [1, 7, 50, 10_000])
def test_bounded_frames(rows, limit):
    want = expected(rows)
    src, w, core = ordered.bounded_window(rows, ["key"], ["at", "id"], before=2, after=1, position="pos", limit=limit)
    framed = src.withColumn("next", F.lead("id").over(w)).withColumn("last3", F.sum("v").over(w.rowsBetween(-2, 0)))
    got = ordered.drop_layout(framed.where(core)).toPandas().set_index("id").sort_index()
    assert len(got) == len(want)
    assert got["pos"].tolist() == want["pos"].tolist()
    assert got["last3"].tolist() == want["last3"].tolist()
    pd.testing.assert_series_equal(got["next"].astype(float), want["next"].astype(float), check_names=False)


@pytest.mark.parametrize("limit", [10, 10_000])
def test_global_position_by_text_and_time(spark, limit):
    df = spark.range(300).select("id", ordered.hash_order(F.col("id"), 1).alias("h"))
    got = ordered.with_position(df, [], ["h"], limit=limit).orderBy("pos").toPandas()
    assert got["h"].tolist() == sorted(got["h"])
    assert got["pos"].tolist() == list(range(300))
    times = spark.range(300).select("id", (F.lit(1_700_000_000) - F.col("id")).cast("timestamp").alias("t"))
    got = ordered.with_position(times, [], ["t"], limit=limit).orderBy("pos").toPandas()
    assert got["id"].tolist() == list(range(299, -1, -1))


def test_blocks_stay_small(rows):
    blocked = ordered.with_block(rows, ["at", "id"], 600, 50)
    assert blocked.groupBy("_blk").count().agg(F.max("count")).first()[0] < 150


@pytest.mark.parametrize("top", [5, 10**6])
def test_first_and_last_rows(spark, monkeypatch, top):
    monkeypatch.setattr(ordered, "TOP_ROWS", top)
    df = spark.range(100).withColumnRenamed("id", "seq")
    assert sorted(r.seq for r in ordered.last_rows(df, "seq", 9).collect()) == list(range(91, 100))
    assert sorted(r.seq for r in ordered.first_rows(df, F.col("seq"), 9).collect()) == list(range(9))
    assert ordered.last_rows(df, "seq", 500).count() == 100
    assert ordered.last_rows(df, "seq", 0).count() == 0


def test_broadcast_only_when_small(spark):
    small, large = spark.range(5), spark.range(1000)
    assert bounds.is_small(small, 10) and not bounds.is_small(large, 10)
    hinted = bounds.broadcast_if_small(small, 10)._jdf.queryExecution().logical().toString()
    plain = bounds.broadcast_if_small(large, 10)._jdf.queryExecution().logical().toString()
    assert "UnresolvedHint" in hinted or "ResolvedHint" in hinted
    assert "Hint" not in plain


def test_broadcast_is_bounded_by_bytes(spark):
    """Few rows of long values aren't broadcast, nested ones included."""
    wide = spark.range(40).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    nested = spark.range(40).select(F.array(F.struct("id", F.array_repeat(F.lit(1.5), 1_000).alias("v"))).alias("m"))
    maps = spark.range(40).select(F.create_map(F.lit("a"), F.repeat(F.lit("x"), 10_000)).alias("m"))
    nulls = spark.range(40).select(F.lit(None).cast("string").alias("t"), F.lit(None).cast("array<string>").alias("a"), F.lit(None).cast("map<string,int>").alias("m"))
    spark.conf.set("gridlake.broadcast.maxBytes", "100000")
    try:
        assert not bounds.is_small(wide) and not bounds.is_small(nested) and not bounds.is_small(maps)
        assert bounds.is_small(wide.select("id")) and bounds.is_small(nulls) and bounds.is_small(wide.limit(0))
    finally:
        spark.conf.unset("gridlake.broadcast.maxBytes")
    assert bounds.is_small(wide) and bounds.is_small(nested)


def texts_in_order(spark):
    """Rows with a nullable order column and ties that the second one breaks."""
    return spark.range(300).select(
        F.when(F.col("id") % 50 != 0, F.col("id") % 7).alias("a"), F.col("id").alias("b"), F.repeat(F.lit("text "), 50).alias("text")
    )


def ordered_plainly(df):
    return sorted(df.collect(), key=lambda r: (r.a is not None, r.a or 0, r.b))


@pytest.mark.parametrize("limit", [None, 20])
def test_late_position_equals_plain_one(spark, limit):
    df = texts_in_order(spark)
    got = {r.b: r.pos for r in ordered.late_position(df, ["a", "b"], limit=limit).collect()}
    assert got == {r.b: i for i, r in enumerate(ordered_plainly(df))}
    assert ordered.late_position(df.limit(0), ["a", "b"]).count() == 0


@pytest.mark.parametrize("top", [5, 10**6])
@pytest.mark.parametrize("span", [(0, None), (0, 4), (3, 9), (6, 7), (250, 400), (300, None), (299, None), (9, 3), (-2, 2)])
def test_rows_from_equals_a_slice(spark, monkeypatch, top, span):
    monkeypatch.setattr(ordered, "TOP_ROWS", top)
    df = texts_in_order(spark)
    got = sorted(r.b for r in ordered.rows_from(df, ["a", "b"], *span, limit=20).collect())
    assert got == sorted(r.b for r in ordered_plainly(df)[max(span[0], 0) : span[1]])


def test_no_text_is_sorted_or_moved_for_its_number(spark):
    """The windows of numbered batches hold order columns only; resuming moves no row at all."""
    import re

    from gridlake.operators import sampling

    df = texts_in_order(spark).withColumn("text", F.concat("text", F.col("b").cast("string")))
    plan = sampling.numbered_batches(df, ["a", "b"], 16)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if re.search(r"\bWindow\b", line)]
    below = plan[plan.index(windows[0]) :]
    assert len(windows) == 1 and "text" not in below
    resumed = sampling.skip_rows(df, ["a", "b"], 100)
    outer = resumed._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert resumed.count() == 200 and "Sort" not in outer and "Join" not in outer


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(50).withColumn("x", F.rand(1))
    cut = bounds.cut_lineage(df)
    assert cut.collect() == cut.collect()
    assert cut.count() == 50


def test_long_common_prefixes_are_cut(spark):
    """Paths that differ only near their end, and half of them in two levels."""
    paths = [f"/warehouse/images/part-{i // 40:03d}/picture-of-something-{i:05d}.png" for i in range(400)]
    df = spark.createDataFrame([(p,) for p in reversed(paths)], "path string")
    blocked = ordered.with_block(df, ["path"], 400, 20)
    assert blocked.groupBy("_blk").count().agg(F.max("count")).first()[0] <= 80
    got = ordered.with_position(df, [], ["path"], limit=20).orderBy("pos").toPandas()
    assert got["path"].tolist() == paths and got["pos"].tolist() == list(range(400))


def test_order_by_struct_falls_back_to_one_block(spark):
    df = spark.range(30).select(F.struct("id").alias("s"))
    got = ordered.with_position(df, [], ["s"], limit=5).orderBy("pos").collect()
    assert [r.s.id for r in got] == list(range(30))
