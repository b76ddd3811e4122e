"""Source divergence audit: which sources of a language use other words than the rest.

A translate table lowers the letters A-Z and blanks every ASCII character that is no letter in one pass
over the bytes; what a split at blanks leaves are the terms, and one Counter per document gives the
frequencies and, by its keys, the documents. Partial sums of a task meet in grouped aggregates, so only
terms that occur are ever stored. Shares are compared in whole numbers: every result is exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.llm.common import bounded_batches, table, written
from gridlake.plans.bounds import broadcast_if_small

#: Documents of a language that a term must be in, shares of the whole, what is added to each count, ranks of terms.
LEAST_DOCS, UNIT, ADDED, TOP = 10, 1_000_000_000, 2, 10
#: Counts that a task holds before it hands them on.
HELD = 500_000
#: Sources of a block, and terms of a bucket: a task compares the sources of two blocks in one bucket.
SOURCES, TERMS = 64, 2048

LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
SEPARATORS = bytes(x for x in range(0x80) if x not in LETTERS)
TABLE = bytes.maketrans(SEPARATORS + LETTERS[:26], b" " * len(SEPARATORS) + LETTERS[26:])


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial (lang, source, term, n, docs): occurrences, and documents with the term; nulls count as ''."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences, documents, held = defaultdict(Counter), defaultdict(Counter), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in occurrences.items():
                of_group = documents[lang, source]
                names = [pa.repeat(pa.scalar(x, pa.string()), len(found)) for x in (lang, source)]
                numbers = [pa.array(x, pa.int64()) for x in (list(found.values()), [of_group[t] for t in found])]
                yield pa.RecordBatch.from_arrays([*names, pa.array(list(found), pa.binary()), *numbers], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "source", "text")]):
                found = Counter(terms(text))
                group = occurrences[lang, source]
                held -= len(group)
                # Elements, not the mapping: these are counted without a Python loop.
                group.update(found.elements())
                documents[lang, source].update(found.keys())
                held += len(group)
                if held > HELD:
                    yield from flush()
                    occurrences, documents, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from flush()

    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(count, "lang string, source string, term binary, n long, docs long")


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms in at least ``least_docs`` documents of their language.

    Partial counts are dealt by language and term once; the sums per source and per language both follow
    from that layout. ``first`` marks one source of each term. A term has one row for each source at most.
    """
    dealt = term_counts(docs).repartition("lang", "term")
    counts = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    sums = {"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "first": F.min("source").over(of_term) == F.col("source")}
    kept = counts.withColumns(sums).where(F.col("lang_docs") >= least_docs)
    return kept.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "first")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * kept)) in whole numbers; of no use where the language has no terms."""
    below = F.greatest(total + ADDED * kept, F.lit(1))
    top = (n + ADDED).cast("decimal(27,0)") * F.lit(UNIT).cast("decimal(10,0)")
    # Most counts leave room for the product in a long.
    small = F.call_function("div", (n + ADDED) * F.lit(UNIT), below)
    return F.lit(1) + F.when(n < F.lit(9 * UNIT), small).otherwise(F.call_function("div", top, below.cast("decimal(27,0)")))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def compare(batch: pd.DataFrame, size: int) -> pd.DataFrame:
    """What the terms of one bucket add to the gap of each pair of sources of two blocks of ``size``, beyond that of an absent term.

    Rows (term, at, p, base) hold the share of a term in the source numbered ``at`` and the share of a
    term that this source lacks; a row without a term stands for a source that may have none of them.
    """
    numbers, where = np.unique(batch["at"].to_numpy(), return_inverse=True)
    which, names = pd.factorize(batch["term"])
    base = np.zeros(len(numbers), np.int64)
    base[where] = batch["base"].to_numpy()
    p = np.repeat(base[:, None], len(names), axis=1)
    real = which >= 0
    p[where[real], which[real]] = batch["p"].to_numpy()[real]
    low, high = int(batch["block_a"].iloc[0]), int(batch["block_b"].iloc[0])
    first, second = (np.flatnonzero(numbers // size == x) for x in (low, high))
    out = []
    for i in first:
        others = second[second > i]
        if len(others):
            apart, both = p[others] - p[i], p[others] + p[i]
            plain = (base[others] - base[i]) ** 2 // (base[others] + base[i])
            out.append(pd.DataFrame({"a": numbers[i], "b": numbers[others], "more": (apart * apart // both).sum(axis=1) - len(names) * plain}))
    frame = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "more": []}, dtype=np.int64)
    return frame.assign(lang=batch["lang"].iloc[0])


def in_blocks(rows: DataFrame, mine: str, other: str, size: int) -> DataFrame:
    """A copy of each row(at, sources) for every block of sources it meets, under the block it is in as ``mine``."""
    blocks = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("sources") - 1, F.lit(size)))
    return rows.withColumn(mine, F.call_function("div", F.col("at"), F.lit(size))).withColumn(other, F.explode(blocks))


def pair_gaps(found: DataFrame, groups: DataFrame, size: int, width: int) -> DataFrame:
    """(lang, a, b, more) for sources a < b of a language: sums over the terms that occur in the blocks of either.

    Terms are dealt into buckets and sources into blocks, so that a task holds two blocks of ``size`` sources
    and some ``width`` terms of them, however many sources use a term.
    """
    buckets = F.call_function("div", F.col("kept") + width - 1, F.lit(width))
    columns = ["lang", "term", "at", "sources", "p", "base", "bucket"]
    present = found.withColumn("bucket", F.pmod(F.xxhash64("term"), buckets)).select(*columns)
    every = groups.where("kept > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)))
    rows = present.union(every.withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("base")).select(*columns))
    met = in_blocks(rows, "own", "other", size).withColumn("block_a", F.least("own", "other")).withColumn("block_b", F.greatest("own", "other"))
    parts = met.select("lang", "bucket", "block_a", "block_b", "term", "at", "p", "base").groupBy("lang", "bucket", "block_a", "block_b")
    return parts.applyInPandas(lambda batch: compare(batch, size), "a long, b long, more long, lang string").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def all_pairs(groups: DataFrame, gaps: DataFrame, size: int) -> DataFrame:
    """Every ordered pair of sources of a language with its gap over all kept terms; built block by block."""
    left = in_blocks(groups.select("lang", "source", "at", "sources", "kept", "base"), "x", "y", size)
    right = in_blocks(groups.select("lang", F.col("source").alias("item"), F.col("at"), "sources", F.col("base").alias("q")), "y", "x", size)
    right = right.select("lang", "x", "y", "item", F.col("at").alias("item_at"), "q")
    met = left.join(right, ["lang", "x", "y"]).where("at != item_at")
    met = met.withColumn("a", F.least("at", "item_at")).withColumn("b", F.greatest("at", "item_at"))
    value = F.when(F.col("kept") > 0, F.col("kept") * gap(F.col("base"), F.col("q")) + F.coalesce("more", F.lit(0))).otherwise(0)
    return met.join(gaps, ["lang", "a", "b"], "left").select("lang", "source", "item", value.cast("long").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, size: int = SOURCES, width: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of docs(text, lang, source).

    Part ``pair`` ranks the other sources of the language by the gap over all kept terms, part ``term`` the
    terms that the source uses more than its language does, up to ``top``. A term is kept in a language
    where at least ``least_docs`` documents have it. Nulls count as ''; a group without terms has its pairs;
    a language without kept terms has pairs of value 0; ties go to the smaller item in UTF-8. Repeated rows
    count each; other columns of docs are not looked at; an empty table gives no rows. A long text is one
    list of its terms while it is counted.
    """
    bounded_batches(docs.sparkSession)
    found = written(kept_counts(docs, least_docs))
    langs = found.groupBy("lang").agg(F.count_if("first").alias("kept"), F.sum("n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_lang = Window.partitionBy("lang")
    groups = named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = groups.withColumn("at", F.row_number().over(of_lang.orderBy("source")).cast("long") - 1).withColumn("sources", F.count(F.lit(1)).over(of_lang))
    groups = written(groups.withColumn("base", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))))
    shared = found.join(broadcast_if_small(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    pairs = all_pairs(groups, pair_gaps(shared, groups, size, width), size)
    own = shared.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    parts = [(pairs, "pair", F.lit(True)), (own, "term", F.col("rank") <= top)]
    out = [df.withColumn("rank", rank).where(keep).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for df, part, keep in parts]
    return out[0].union(out[1])


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the sources of each language, and the terms that stand out in each."""
    return divergence(table(spark, sf_dir, "documents"))


def _share(n: str, total: str) -> str:
    return f"1 + ({UNIT}::hugeint * ({n} + {ADDED})) // ({total} + {ADDED} * v)"


SQL = f"""with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
occ as (select lang, source, row, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term, count(*) as ln from occ group by 1, 2 having count(distinct row) >= {LEAST_DOCS}),
langs as (select lang, count(*) as v, sum(ln) as lt from kept group by 1),
cnt as (select o.lang, o.source, o.term, count(*) as n from occ o join kept using (lang, term) group by all),
grp as (select g.lang, g.source, coalesce(l.v, 0) as v, coalesce(l.lt, 0) as lt, coalesce(t.total, 0) as total
  from (select distinct lang, source from d) g left join langs l using (lang)
  left join (select lang, source, sum(n) as total from cnt group by 1, 2) t using (lang, source)),
cell as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, {_share("coalesce(c.n, 0)", "g.total")} as p, {_share("k.ln", "g.lt")} as q
  from grp g join kept k using (lang) left join cnt c using (lang, source, term)),
gaps as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from cell a join cell b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(g.value, 0)::bigint as value
  from grp a join grp b on a.lang = b.lang and a.source != b.source
  left join gaps g on g.lang = a.lang and g.source = a.source and g.item = b.source),
own as (select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from cell where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all (select lang, source, 'term' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank
from own qualify rank <= {TOP})"""
