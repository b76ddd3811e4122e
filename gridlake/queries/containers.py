"""Queries over the container, order and pair functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import arrays as A
from gridlake.functions import vec2 as V
from gridlake.queries.fixtures import CELLS, grids
from gridlake.queries.registry import query, table

ROWS_SQL = f"""{CELLS},
two as (
  select grid_id, list(v order by c) filter (r = 0) as a, list(v order by c) filter (r = 1) as b
  from cells where r < 2 group by grid_id)"""


def _two_rows(spark, sf_dir):
    """First and second grid row as two containers."""
    return grids(spark, sf_dir).select(
        "grid_id", F.get("grid", F.lit(0)).alias("a"), F.get("grid", F.lit(1)).alias("b")
    )


def _text(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def _sql_text(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda x: x::varchar), ',')"


@query(f"""with {ROWS_SQL}
select grid_id, list_contains(b, a[1]) as contained, len(a)::int as size,
  {_sql_text('list_sort(list_distinct(list_concat(a, b)))')} as united,
  {_sql_text('list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x))))')} as common,
  {_sql_text('list_filter(a, lambda x: not list_contains(b, x))')} as difference,
  {_sql_text('list_concat(a, b)')} as combined,
  {_sql_text('list_sort(list_distinct(a))')} as deduped,
  {_sql_text('list_filter(a, lambda x: x <> 4)')} as removed,
  {_sql_text('list_filter(a, lambda x: x % 2 = 0)')} as filtered,
  {_sql_text('list_transform(a, lambda x: x * 2)')} as applied,
  list_filter(a, lambda x: x <> a[1])[1] as other, list_filter(a, lambda x: x > 5)[1] as extracted,
  coalesce(list_max(a), 0) as maximum, coalesce(list_min(list_filter(a, lambda x: x > 5)), 0) as minimum,
  a[1] as first, a[-1] as last
from two""")
def container_functions(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _two_rows(spark, sf_dir).select(
        "grid_id",
        A.contained(A.first(a), b).alias("contained"),
        A.size(a).alias("size"),
        _text(A.totuple(A.union(a, b))).alias("united"),
        _text(A.totuple(A.intersection(a, b))).alias("common"),
        _text(A.difference(a, b)).alias("difference"),
        _text(A.merge(F.array(a, b))).alias("combined"),
        _text(A.totuple(A.dedupe(a))).alias("deduped"),
        _text(A.remove(F.lit(4), a)).alias("removed"),
        _text(A.sfilter(a, lambda x: x % 2 == 0)).alias("filtered"),
        _text(A.apply(lambda x: x * 2, a)).alias("applied"),
        A.other(a, A.first(a)).alias("other"),
        A.extract(a, lambda x: x > 5).alias("extracted"),
        A.maximum(a).alias("maximum"),
        A.minimum(A.sfilter(a, lambda x: x > 5)).alias("minimum"),
        A.first(a).alias("first"),
        A.last(a).alias("last"),
    )


@query(f"""with {ROWS_SQL},
e as (select grid_id, unnest(a) as v, generate_subscripts(a, 1) - 1 as i from two),
n as (select grid_id, v, count(*) as n from e group by all),
best as (select grid_id, arg_max(v, n * 100 - v) as mostcommon, arg_min(v, n * 100 + v) as leastcommon from n group by grid_id),
keyed as (
  select grid_id, string_agg(v::varchar, ',' order by (v * 7) % 10, i) as ordered,
    arg_max(v, ((v * 7) % 10) * 100 - i) as argmax, arg_min(v, ((v * 7) % 10) * 100 + i) as argmin,
    max((v * 7) % 10) as valmax, min((v * 7) % 10) as valmin from e group by grid_id)
select * from best join keyed using (grid_id)""")
def container_order(spark, sf_dir):
    a = F.col("a")

    def key(x):
        return (x * 7) % 10

    return _two_rows(spark, sf_dir).select(
        "grid_id",
        A.mostcommon(a).alias("mostcommon"),
        A.leastcommon(a).alias("leastcommon"),
        _text(A.order(a, key)).alias("ordered"),
        A.argmax(a, key).alias("argmax"),
        A.argmin(a, key).alias("argmin"),
        A.valmax(a, key).alias("valmax"),
        A.valmin(a, key).alias("valmin"),
    )


@query(f"""with {ROWS_SQL},
p as (select grid_id, unnest(a) as x, generate_subscripts(a, 1) as i from two),
q as (select grid_id, unnest(b[1:5]) as y, generate_subscripts(b[1:5], 1) as j from two),
prod as (select grid_id, count(*)::int as n_product, sum(x * y)::bigint as prapplied from p join q using (grid_id) group by grid_id),
zip as (select p.grid_id, string_agg((x + y)::varchar, ',' order by i) as papplied, count(*)::int as n_pairs
        from p join q on p.grid_id = q.grid_id and i = j group by p.grid_id),
spread as (select grid_id, string_agg(repeat(x::varchar || ',', 2), '' order by i) as mapplied from p group by grid_id)
select grid_id, n_product, prapplied, papplied, n_pairs, mapplied, a[1] + 1 as rapplied_1, a[1] * 2 as rapplied_2,
  case when a[1] < a[2] then {_sql_text('range(a[1], a[2], 1)')} else '' end as upward
from prod join zip using (grid_id) join spread using (grid_id) join two using (grid_id)""")
def container_products(spark, sf_dir):
    """Products, zips and nested application; the shorter side decides the length of a zip."""
    a, b = F.col("a"), F.slice(F.col("b"), 1, 5)
    prod = A.product(a, b)
    both = A.rapply([lambda x: x + 1, lambda x: x * 2], A.first(a))
    doubled = A.mapply(lambda x: A.repeat(x, 2), a)
    return _two_rows(spark, sf_dir).select(
        "grid_id",
        F.size(prod).alias("n_product"),
        F.aggregate(A.prapply(lambda x, y: x * y, a, b), F.lit(0).cast("long"), lambda s, x: s + x).alias("prapplied"),
        _text(A.papply(lambda x, y: x + y, a, b)).alias("papplied"),
        F.size(A.pair(a, b)).alias("n_pairs"),
        F.concat(_text(doubled), F.lit(",")).alias("mapplied"),
        F.get(both, F.lit(0)).alias("rapplied_1"),
        F.get(both, F.lit(1)).alias("rapplied_2"),
        _text(A.interval(F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.lit(1))).alias("upward"),
    )


@query("""with x as (
  select l_linenumber - 4 as i, (trunc(l_quantity) - 25)::int as j, (l_suppkey % 7 + 1)::int as d from lineitem)
select i, j, d, count(*) as n, i + j as added, i - j as subtracted, i * j as multiplied,
  floor(i::double / d)::int as divided_i, floor(j::double / d)::int as divided_j,
  floor(j / 2.0::double)::int as halved, -i as inverted, i * 2 as doubled, i + 1 as incremented, i - 1 as decremented,
  i + sign(i)::int as cremented, sign(j)::int as signed, i % 2 = 0 as even, i > 0 as positive,
  i + d as vec_i, j + d as vec_j, i > j as greater, (i > 0 and j > 0) as both_positive, (i > 0 or j > 0) as any_positive,
  not (i > 0) as flipped, case when i > j then i else j end as branched
from x group by i, j, d""")
def vec2_arithmetic(spark, sf_dir):
    """Integer and pair arithmetic on every distinct operand triple of the line items."""
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") - 4).alias("i"),
        (F.col("l_quantity").cast("int") - 25).alias("j"),
        (F.col("l_suppkey") % 7 + 1).cast("int").alias("d"),
    )
    i, j, d = F.col("i"), F.col("j"), F.col("d")
    pair = V.Vec(i, j)
    parts = V.divide(pair, d)
    moved = V.Vec.of(V.add(pair, d).col)
    return li.groupBy("i", "j", "d").agg(F.count("*").alias("n")).select(
        "i", "j", "d", "n",
        V.add(i, j).alias("added"),
        V.subtract(i, j).alias("subtracted"),
        V.multiply(i, j).alias("multiplied"),
        parts.i.alias("divided_i"),
        parts.j.alias("divided_j"),
        V.halve(j).alias("halved"),
        V.invert(i).alias("inverted"),
        V.double(i).alias("doubled"),
        V.increment(i).alias("incremented"),
        V.decrement(i).alias("decremented"),
        V.crement(i).alias("cremented"),
        V.sign(j).alias("signed"),
        V.even(i).alias("even"),
        V.positive(i).alias("positive"),
        moved.i.alias("vec_i"),
        moved.j.alias("vec_j"),
        V.greater(i, j).alias("greater"),
        V.both(V.positive(i), V.positive(j)).alias("both_positive"),
        V.either(V.positive(i), V.positive(j)).alias("any_positive"),
        V.flip(V.positive(i)).alias("flipped"),
        V.branch(V.greater(i, j), i, j).alias("branched"),
    )


@query("""select round(l_discount, 2) as d, least(greatest(3, round_even(3 + 27 * round(l_discount * 10, 2), 0)::int), 30) as bound,
  count(*) as n from lineitem group by 1, 2""")
def bound_interpolation(spark, sf_dir):
    """Integer bounds between 3 and 30 at the difficulty given by the discount."""
    li = table(spark, sf_dir, "lineitem")
    bound = V.interpolate(3, 30, F.round(F.col("l_discount") * 10, 2))
    return li.groupBy(F.round("l_discount", 2).alias("d"), bound.alias("bound")).agg(F.count("*").alias("n"))
