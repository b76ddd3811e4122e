"""Queries over grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import grid as G
from gridlake.functions import objects as O
from gridlake.operators import expand as X
from gridlake.operators import quality as Q
from gridlake.queries.fixtures import (
    BINARY,
    CELLS,
    PAIRS,
    RAGGED,
    binary,
    colour_objects,
    grids,
    pairs,
    ragged,
    text_sql,
)
from gridlake.queries.registry import query, table

def g():
    return F.col("grid")


def obj():
    return F.col("obj")

DIHEDRAL_SQL = """
forms as (
  select grid_id, t as tid, v,
    (case t when 0 then r when 1 then w - 1 - c when 2 then h - 1 - r when 3 then c
            when 4 then r when 5 then h - 1 - r when 6 then c else w - 1 - c end) as r,
    (case t when 0 then c when 1 then r when 2 then w - 1 - c when 3 then h - 1 - r
            when 4 then w - 1 - c when 5 then c when 6 then r else h - 1 - r end) as c,
    (case when t in (1, 3, 6, 7) then w else h end) as h,
    (case when t in (1, 3, 6, 7) then h else w end) as w
  from ragged, range(8) x(t))"""

HASHED_SQL = """
hashed as (
  select grid_id, tid, md5(max(h)::varchar || 'x' || max(w)::varchar || ':' ||
         string_agg(v::varchar, ',' order by r, c)) as grid_hash
  from forms group by grid_id, tid)"""


@query(f"with {CELLS} select grid_id, v, count(*) as n from cells group by grid_id, v")
def grid_histogram(spark, sf_dir):
    cells = G.explode_cells(grids(spark, sf_dir))
    return cells.groupBy("grid_id", "v").agg(F.count("*").alias("n"))


@query(f"""with {RAGGED},
n as (select grid_id, v, count(*) as n from ragged group by all)
select grid_id, arg_max(v, n * 100 - v) as mostcolor, arg_min(v, n * 100 + v) as leastcolor,
       count(*)::int as numcolors, string_agg(v::varchar, ',' order by v) as palette,
       coalesce(sum(n) filter (v = 5), 0)::int as fives
from n group by grid_id""")
def grid_colors(spark, sf_dir):
    names = F.array_join(F.transform(G.palette(g()), lambda v: v.cast("string")), ",")
    return ragged(spark, sf_dir).select(
        "grid_id",
        G.mostcolor(g()).alias("mostcolor"),
        G.leastcolor(g()).alias("leastcolor"),
        G.numcolors(g()).alias("numcolors"),
        names.alias("palette"),
        G.colorcount(g(), 5).alias("fives"),
    )


@query(f"with {RAGGED}, {DIHEDRAL_SQL} {text_sql('forms', 'grid_id, tid')}")
def grid_dihedral(spark, sf_dir):
    src = ragged(spark, sf_dir).withColumn("tid", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return src.select("grid_id", F.col("tid").cast("long").alias("tid"), G.to_text(G.dihedral(g(), F.col("tid"))).alias("grid"))


@query(f"""with {RAGGED}, base as ({text_sql('ragged')})
select grid_id, t as tid, true as restored, grid from base, range(8) x(t)""")
def grid_inverse_roundtrip(spark, sf_dir):
    src = ragged(spark, sf_dir).withColumn("tid", F.explode(F.sequence(F.lit(0), F.lit(7))))
    back = src.withColumn("back", G.inverse_dihedral(G.dihedral(g(), F.col("tid")), F.col("tid")))
    return back.select(
        "grid_id",
        F.col("tid").cast("long").alias("tid"),
        (F.col("back") == g()).alias("restored"),
        G.to_text(F.col("back")).alias("grid"),
    )


@query(f"""with {RAGGED}, {DIHEDRAL_SQL}, {HASHED_SQL}
select grid_hash, min(grid_id * 8 + tid) as first_seq, count(*) as copies from hashed group by grid_hash""")
def grid_augment_dedup(spark, sf_dir):
    src = ragged(spark, sf_dir).withColumn("sample_id", F.col("grid_id").cast("string"))
    forms = Q.augment_dihedral(src)
    hashed = forms.select(
        G.grid_hash(g()).alias("grid_hash"), (F.col("grid_id") * 8 + F.col("tid")).alias("seq")
    )
    return hashed.groupBy("grid_hash").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("copies")
    )


@query(f"""with {RAGGED}, {DIHEDRAL_SQL}, t as ({text_sql('forms', 'grid_id, tid')})
select grid_id::varchar || case when tid = 0 then '' else '_aug' || tid end as sample_id, grid from t""")
def grid_augment(spark, sf_dir):
    src = ragged(spark, sf_dir).withColumn("sample_id", F.col("grid_id").cast("string"))
    return Q.augment_dihedral(src).select("sample_id", G.to_text(g()).alias("grid"))


@query(f"""with {RAGGED}, {DIHEDRAL_SQL}, t as ({text_sql('forms', 'grid_id, tid')})
select grid_id::varchar || case when tid = 0 then '' else '_aug' || tid end as sample_id, tid::int as tid, grid from t""")
def augment_lateral(spark, sf_dir):
    """The eight forms by a table function that SQL calls once a row."""
    X.register(spark)
    ragged(spark, sf_dir).createOrReplaceTempView("_ragged_grids")
    forms = spark.sql("select f.* from _ragged_grids g, lateral augment_sample(cast(g.grid_id as string), g.grid) f")
    return forms.select("sample_id", "tid", G.to_text(g()).alias("grid"))


@query(f"""with {RAGGED}, {DIHEDRAL_SQL}, t as ({text_sql('forms', 'grid_id, tid')}),
f as (select grid_id, grid, min(tid) as tid from t group by grid_id, grid)
select grid_id::varchar || case when tid = 0 then '' else '_aug' || tid end as sample_id, tid::int as tid, grid from f""")
def distinct_forms(spark, sf_dir):
    """Forms of each grid that differ, by a table function over the forms of one grid at a time."""
    forms = X.augment_samples(ragged(spark, sf_dir).withColumnRenamed("grid_id", "sample_id"))
    named = forms.withColumn("source_id", F.split("sample_id", "_aug")[0])
    return X.distinct_forms(named).select("sample_id", "tid", G.to_text(g()).alias("grid"))


@query(f"""with {PAIRS},
d as (select distinct pair_id, md5(pair_id::varchar || '|42') as h from pin),
drawn as (
  select pair_id, ('0x' || substr(h, 9, 8))::bigint % 5 + 1 as t,
         ('0x' || substr(h, 17, 8))::bigint % 2 = 0 as on_input
  from d where ('0x' || substr(h, 1, 8))::bigint < 2147483648),
both_sides as (
  select 'i' as side, p.*, t, on_input, case when on_input then t else 0 end as k from pin p join drawn using (pair_id)
  union all
  select 'o' as side, p.*, t, on_input, case when on_input then 0 else t end as k from pout p join drawn using (pair_id)),
moved as (
  select side, pair_id, t, on_input, v,
    (case k when 0 then r when 1 then w - 1 - c when 2 then h - 1 - r when 3 then c when 4 then r else h - 1 - r end) as r,
    (case k when 0 then c when 1 then r when 2 then w - 1 - c when 3 then h - 1 - r when 4 then w - 1 - c else c end) as c
  from both_sides),
texts as ({text_sql('moved', 'pair_id, side, t, on_input')})
select pair_id::varchar || '_probaug_' || case t when 1 then 'rotate_90' when 2 then 'rotate_180'
         when 3 then 'rotate_270' when 4 then 'flip_h' else 'flip_v' end || '_' ||
         case when on_input then 'True' else 'False' end as sample_id,
       max(grid) filter (side = 'i') as input, max(grid) filter (side = 'o') as output
from texts group by pair_id, t, on_input""")
def grid_problem_aug(spark, sf_dir):
    src = pairs(spark, sf_dir).select(
        F.col("pair_id").cast("string").alias("sample_id"),
        F.lit("grid").alias("modality"),
        F.col("input").alias("grid"),
        F.col("output").alias("label"),
    )
    return Q.augment_problem(src).select(
        "sample_id", G.to_text(g()).alias("input"), G.to_text(F.col("label")).alias("output")
    )


EDGE_SQL = """
edges as (
  select a.grid_id, max(a.h) as h, max(a.w) as w,
         count(*) filter (a.r < a.h - 1 and a.c < a.w - 1 and (a.v <> b.v or a.v <> d.v)) as n
  from ragged a
  left join ragged b on b.grid_id = a.grid_id and b.r = a.r and b.c = a.c + 1
  left join ragged d on d.grid_id = a.grid_id and d.r = a.r + 1 and d.c = a.c
  group by a.grid_id),
density as (
  select grid_id, h, w, case when h <= 1 or w <= 1 then 0.0::double
         else n::double / ((h - 1) * (w - 1)) end as e from edges)"""


@query(f"with {RAGGED}, {EDGE_SQL} select grid_id, round(e, 6) as edge_density from density")
def grid_edge_density(spark, sf_dir):
    return ragged(spark, sf_dir).select("grid_id", F.round(G.edge_density(g()), 6).alias("edge_density"))


@query(f"""with {PAIRS}, {EDGE_SQL},
dims as (select grid_id, max(h) as h, max(w) as w, count(distinct v) as k from ragged group by grid_id),
base as (
  select a.grid_id // 2 as pair_id, a.h * a.w as sa, b.h * b.w as sb, a.k + b.k as k,
         least(a.h, b.h) * least(a.w, b.w) as overlap, (ea.e + eb.e) / 2 as pattern
  from dims a join dims b on b.grid_id = a.grid_id + 1 and a.grid_id % 2 = 0
  join density ea on ea.grid_id = a.grid_id join density eb on eb.grid_id = b.grid_id),
diffs as (
  select i.pair_id, count(*) filter (i.v <> o.v) as n
  from pin i join pout o on i.pair_id = o.pair_id and i.r = o.r and i.c = o.c group by i.pair_id),
parts as (
  select pair_id, sa / 900.0::double as size_factor, k / 20.0::double as color_diversity,
         0.7::double * (n::double / overlap) + 0.3::double * (abs(sa - sb)::double / greatest(sa, sb)) as transformation,
         pattern from base join diffs using (pair_id))
select pair_id, round(size_factor, 6) as size_factor, round(color_diversity, 6) as color_diversity,
       round(transformation, 6) as transformation, round(pattern, 6) as pattern,
       round(0.2::double * size_factor + 0.3::double * color_diversity + 0.3::double * transformation
             + 0.2::double * pattern, 6) as difficulty from parts""")
def grid_difficulty(spark, sf_dir):
    scored = pairs(spark, sf_dir).withColumn("s", G.difficulty(F.col("input"), F.col("output")))
    names = ["size_factor", "color_diversity", "transformation", "pattern", "difficulty"]
    return scored.select("pair_id", *[F.round(F.col(f"s.{n}"), 6).alias(n) for n in names])


def _objects_sql(source: str, univalued: bool, diagonal: bool, without_bg: bool) -> str:
    near = "abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1" if diagonal else "abs(a.r - b.r) + abs(a.c - b.c) = 1"
    same = "and a.v = b.v" if univalued else ""
    keep = f"where v <> mc" if without_bg else ""
    return f"""
bg as (select grid_id, arg_max(v, n * 100 - v) as mc
       from (select grid_id, v, count(*) as n from {source} group by all) group by grid_id),
fg as (select s.* from {source} s join bg using (grid_id) {keep}),
links as (select a.grid_id, a.r * 100 + a.c as x, b.r * 100 + b.c as y
          from fg a join fg b on a.grid_id = b.grid_id and {near} {same}),
reach(grid_id, x, y) as (
  select grid_id, r * 100 + c, r * 100 + c from fg
  union
  select p.grid_id, p.x, l.y from reach p join links l on l.grid_id = p.grid_id and l.x = p.y),
labels_ as (select grid_id, x, min(y) as obj from reach group by all),
objs as (select f.grid_id, l.obj, f.r, f.c, f.v from fg f join labels_ l on l.grid_id = f.grid_id and l.x = f.r * 100 + f.c)"""


OBJECT_COLUMNS = """grid_id, obj as first_cell, count(*)::int as n, arg_min(v, r * 100 + c) as v, min(r) as t,
  min(c) as l, max(r) as b, max(c) as "right", sum(r * 37 + c * 101 + v * 1009)::bigint as check_sum"""


def _object_rows(src, univalued, diagonal, without_bg):
    labelled = src.select("grid_id", O.objects(g(), univalued, diagonal, without_bg).alias("objs"))
    objs = labelled.select("grid_id", F.explode("objs").alias("obj"))
    first = F.array_min(F.transform(obj(), lambda s: s["r"] * 100 + s["c"]))
    check = F.aggregate(
        obj(), F.lit(0).cast("long"), lambda a, s: a + s["r"] * 37 + s["c"] * 101 + s["v"] * 1009
    )
    return objs.select(
        "grid_id",
        first.alias("first_cell"),
        F.size(obj()).alias("n"),
        O.color(obj()).alias("v"),
        O.uppermost(obj()).alias("t"),
        O.leftmost(obj()).alias("l"),
        O.lowermost(obj()).alias("b"),
        O.rightmost(obj()).alias("right"),
        check.alias("check_sum"),
    )


@query(f"with recursive {RAGGED}, {_objects_sql('ragged', True, False, False)} select {OBJECT_COLUMNS} from objs group by grid_id, obj")
def grid_objects(spark, sf_dir):
    return _object_rows(ragged(spark, sf_dir), True, False, False)


@query(f"with recursive {RAGGED}, {_objects_sql('ragged', True, True, True)} select {OBJECT_COLUMNS} from objs group by grid_id, obj")
def grid_objects_diagonal(spark, sf_dir):
    return _object_rows(ragged(spark, sf_dir), True, True, True)


@query(f"with recursive {BINARY}, {_objects_sql('two_tone', False, False, True)} select {OBJECT_COLUMNS} from objs group by grid_id, obj")
def grid_objects_multicolor(spark, sf_dir):
    return _object_rows(binary(spark, sf_dir), False, False, True)


@query(f"""with recursive {RAGGED}, {_objects_sql('ragged', True, False, False)},
n as (select grid_id, count(distinct obj) as n from objs group by grid_id),
dims as (select grid_id, max(h) * max(w) as area, list(distinct v) as p from ragged group by grid_id),
f as (select * from dims join n using (grid_id))
select a.grid_id // 2 as pair_id,
  round(((a.area + b.area) / 1800.0::double + len(list_distinct(list_concat(a.p, b.p))) / 10.0::double
         + (a.n::double / a.area + b.n::double / b.area) / 2) / 3, 6) as pso
from f a join f b on b.grid_id = a.grid_id + 1 and a.grid_id % 2 = 0""")
def grid_pso(spark, sf_dir):
    score = Q.pso_difficulty(F.col("input"), F.col("output"))
    return pairs(spark, sf_dir).select("pair_id", F.round(score, 6).alias("pso"))


@query(f"""with {RAGGED},
b as (select grid_id, v, min(r) as t, min(c) as l, max(r) as b, max(c) as rr, count(*) as n,
             floor(sum(r)::double / count(*))::int as mr, floor(sum(c)::double / count(*))::int as mc
      from ragged group by grid_id, v)
select grid_id, v, t as uppermost, l as leftmost, b as lowermost, rr as rightmost, b - t + 1 as height,
  rr - l + 1 as width, b - t > rr - l as portrait, (b - t = rr - l and (b - t + 1) * (rr - l + 1) = n) as square,
  (b - t + 1 = n and rr = l) as vline, (rr - l + 1 = n and b = t) as hline,
  t + (b - t + 1) // 2 as center_r, l + (rr - l + 1) // 2 as center_c, mr as mass_r, mc as mass_c,
  (case when t = b then 1 else 2 end * case when l = rr then 1 else 2 end)::int as n_corners
from b""")
def grid_bbox(spark, sf_dir):
    return colour_objects(spark, sf_dir).select(
        "grid_id",
        "v",
        O.uppermost(obj()).alias("uppermost"),
        O.leftmost(obj()).alias("leftmost"),
        O.lowermost(obj()).alias("lowermost"),
        O.rightmost(obj()).alias("rightmost"),
        O.height(obj()).alias("height"),
        O.width(obj()).alias("width"),
        O.portrait(obj()).alias("portrait"),
        O.square(obj()).alias("square"),
        O.vline(obj()).alias("vline"),
        O.hline(obj()).alias("hline"),
        O.center(obj())["r"].alias("center_r"),
        O.center(obj())["c"].alias("center_c"),
        O.centerofmass(obj())["r"].alias("mass_r"),
        O.centerofmass(obj())["c"].alias("mass_c"),
        F.size(O.corners(obj())).alias("n_corners"),
    )


def _patch_check(p):
    """Number of locations and a position-weighted sum."""
    total = F.aggregate(p, F.lit(0).cast("long"), lambda a, s: a + s["r"] * 37 + s["c"] * 101 + 7)
    return F.size(p), total


def _ring_sql(name: str, grow: int) -> str:
    return f"""
{name}_e as (select grid_id, v, least(t - {grow}, b + {grow}) as t, greatest(t - {grow}, b + {grow}) as b,
                  least(l - {grow}, rr + {grow}) as l, greatest(l - {grow}, rr + {grow}) as rr from bb),
{name} as (
  select grid_id, v, count(*)::int as {name}_n, sum(y * 37 + x * 101 + 7)::bigint as {name}_s
  from {name}_e, range(-2, 12) a(y), range(-2, 12) c(x)
  where y between t and b and x between l and rr and (y in (t, b) or x in (l, rr)) group by all)"""


@query(f"""with {RAGGED},
bb as (select grid_id, v, min(r) as t, min(c) as l, max(r) as b, max(c) as rr from ragged group by all),
backdrop as (
  select bb.grid_id, bb.v, count(*)::int as backdrop_n, sum(y * 37 + x * 101 + 7)::bigint as backdrop_s,
         (count(*) filter (q.v is null))::int as delta_n,
         coalesce(sum(y * 37 + x * 101 + 7) filter (q.v is null), 0)::bigint as delta_s
  from bb, range(0, 8) a(y), range(0, 8) c(x)
  left join ragged q on q.grid_id = bb.grid_id and q.v = bb.v and q.r = y and q.c = x
  where y between t and b and x between l and rr group by bb.grid_id, bb.v),
{_ring_sql('box', 0)}, {_ring_sql('inbox', -1)}, {_ring_sql('outbox', 1)}
select * from backdrop join box using (grid_id, v) join inbox using (grid_id, v) join outbox using (grid_id, v)""")
def grid_boxes(spark, sf_dir):
    out = []
    for name, form in [
        ("backdrop", O.backdrop), ("delta", O.delta), ("box", O.box), ("inbox", O.inbox), ("outbox", O.outbox),
    ]:
        n, s = _patch_check(form(obj()))
        out += [n.alias(f"{name}_n"), s.alias(f"{name}_s")]
    return colour_objects(spark, sf_dir).select("grid_id", "v", *out)


@query(f"""with {RAGGED},
n as (select grid_id, v, count(*) as n from ragged group by all),
m as (select grid_id, arg_max(v, n * 100 - v) as mc from n group by grid_id)
select grid_id, count(*)::int as n_parts, (count(*) filter (v <> mc))::int as n_foreground,
  (count(*) filter (v = 5))::int as n_five, (count(*) filter (n = 3))::int as n_of_three,
  coalesce(sum(n) filter (v <> mc), 0)::int as foreground_cells
from n join m using (grid_id) group by grid_id""")
def grid_partition(spark, sf_dir):
    parts, fore = O.partition(g()), O.fgpartition(g())
    return ragged(spark, sf_dir).select(
        "grid_id",
        F.size(parts).alias("n_parts"),
        F.size(fore).alias("n_foreground"),
        F.size(O.colorfilter(parts, 5)).alias("n_five"),
        F.size(O.sizefilter(parts, 3)).alias("n_of_three"),
        F.size(F.flatten(fore)).alias("foreground_cells"),
    )


@query(f"""with {PAIRS}
select i.pair_id, (select v from pout o where o.pair_id = i.pair_id and o.r = 6 and o.c = 2) as at_6_2,
  string_agg(o.v::varchar, ',' order by i.r, i.c) as under_fives, count(*) as n_fives
from pin i left join pout o on o.pair_id = i.pair_id and o.r = i.r and o.c = i.c
where i.v = 5 group by i.pair_id""")
def grid_select(spark, sf_dir):
    """Cells of the output under the input's colour-5 locations."""
    fives = G.ofcolor(F.col("input"), 5)
    under = F.transform(O.toobject(fives, F.col("output")), lambda s: s["v"].cast("string"))
    joined = F.array_join(under, ",")
    return (
        pairs(spark, sf_dir)
        .select(
            "pair_id",
            O.index(F.col("output"), O.loc(6, 2)).alias("at_6_2"),
            F.when(joined != "", joined).alias("under_fives"),
            F.size(O.toindices(fives)).cast("long").alias("n_fives"),
        )
        .where("n_fives > 0")
    )


@query(f"""with {RAGGED},
n as (select grid_id, v, count(*) as n from ragged group by all),
m as (select grid_id, arg_max(v, n * 100 - v) as mc, arg_min(v, n * 100 + v) as lc from n group by grid_id),
moved as (
  select a.grid_id, a.r, a.c,
    coalesce(s.v, case when a.v = lc and mc <> lc then mc when a.v = lc then mc else a.v end) as v
  from ragged a join m using (grid_id)
  left join ragged s on s.grid_id = a.grid_id and s.v = lc and s.r = a.r - 1 and s.c = a.c - 1),
norm as (
  select grid_id, string_agg((r - t) || ':' || (c - l), ',' order by r, c) as normal
  from (select a.*, min(r) over p as t, min(c) over p as l from ragged a join m using (grid_id) where v = lc
        window p as (partition by grid_id)) group by grid_id)
select grid_id, grid, normal from ({text_sql('moved')}) join norm using (grid_id)""")
def grid_move(spark, sf_dir):
    """The rarest colour's cells moved one step down and right, and their normalised locations."""
    rare = O.toobject(G.ofcolor(g(), G.leastcolor(g())), g())
    src = ragged(spark, sf_dir).withColumn("obj", rare)
    places = F.transform(O.normalize(obj()), lambda s: F.concat_ws(":", s["r"], s["c"]))
    return src.select(
        "grid_id", G.to_text(O.move(g(), obj(), 1, 1)).alias("grid"), F.array_join(places, ",").alias("normal")
    )


@query(f"""with {RAGGED}
select a.grid_id,
  (count(*) filter (abs(a.r - b.r) + abs(a.c - b.c) = 1 and a.v = b.v))::bigint as direct_equal,
  (count(*) filter (abs(a.r - b.r) = 1 and abs(a.c - b.c) = 1 and a.v = b.v))::bigint as diagonal_equal,
  (count(*) filter (greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1))::bigint as n_neighbors
from ragged a join ragged b on a.grid_id = b.grid_id group by a.grid_id""")
def grid_neighbors(spark, sf_dir):
    def total(around, equal):
        def hits(s):
            return F.size(
                F.filter(
                    around(s),
                    lambda n: G.cell(g(), n["r"], n["c"]) == s["v"] if equal else G.cell(g(), n["r"], n["c"]).isNotNull(),
                )
            )

        return F.aggregate(G.asobject(g()), F.lit(0).cast("long"), lambda a, s: a + hits(s))

    return ragged(spark, sf_dir).select(
        "grid_id",
        total(O.dneighbors, True).alias("direct_equal"),
        total(O.ineighbors, True).alias("diagonal_equal"),
        total(O.neighbors, False).alias("n_neighbors"),
    )


RELATION_SQL = f"""{RAGGED},
n as (select grid_id, min(v) as lo, max(v) as hi from ragged group by grid_id),
a as (select x.* from ragged x join n using (grid_id) where v = lo and lo < hi),
b as (select x.* from ragged x join n using (grid_id) where v = hi and lo < hi),
box as (
  select a.grid_id, max(a.h) as h, max(a.w) as w, min(a.r) as a_t, max(a.r) as a_b, min(a.c) as a_l, max(a.c) as a_r
  from a group by a.grid_id),
boxb as (select grid_id, min(r) as bt, max(r) as bb, min(c) as bl, max(c) as br from b group by grid_id),
cen as (
  select *, a_t + (a_b - a_t + 1) // 2 as ca_r, a_l + (a_r - a_l + 1) // 2 as ca_c,
         bt + (bb - bt + 1) // 2 as cb_r, bl + (br - bl + 1) // 2 as cb_c
  from box join boxb using (grid_id)),
rel as (
  select a.grid_id, bool_or(a.r = b.r) as hmatching, bool_or(a.c = b.c) as vmatching,
         min(abs(a.r - b.r) + abs(a.c - b.c)) as manhattan
  from a join b using (grid_id) group by a.grid_id)"""


@query(f"""with {RELATION_SQL}
select grid_id, hmatching, vmatching, manhattan, manhattan = 1 as adjacent,
  (a_t = 0 or a_l = 0 or a_b = h - 1 or a_r = w - 1) as bordering,
  (case when ca_r = cb_r and ca_c = cb_c then 0 else sign(cb_r - ca_r) end)::int as pos_r,
  (case when ca_r = cb_r and ca_c = cb_c then -1 else sign(cb_c - ca_c) end)::int as pos_c
from rel join cen using (grid_id)""")
def grid_relations(spark, sf_dir):
    src = _extreme_colours(spark, sf_dir)
    a, b = F.col("a"), F.col("b")
    return src.select(
        "grid_id",
        O.hmatching(a, b).alias("hmatching"),
        O.vmatching(a, b).alias("vmatching"),
        O.manhattan(a, b).alias("manhattan"),
        O.adjacent(a, b).alias("adjacent"),
        O.bordering(a, g()).alias("bordering"),
        O.position(a, b)["r"].alias("pos_r"),
        O.position(a, b)["c"].alias("pos_c"),
    )


def _extreme_colours(spark, sf_dir):
    """Cells of the lowest and of the highest colour of each ragged grid."""
    lo, hi = F.array_min(G.values(g())), F.array_max(G.values(g()))
    return (
        ragged(spark, sf_dir)
        .where(lo < hi)
        .select("grid_id", "grid", G.ofcolor(g(), lo).alias("a"), G.ofcolor(g(), hi).alias("b"))
    )


@query(f"""with {RELATION_SQL},
dir as (
  select grid_id, case when vmatching then case when ca_r < cb_r then 1 else -1 end else 0 end as i,
         case when vmatching then 0 else case when ca_c < cb_c then 1 else -1 end end as j
  from rel join cen using (grid_id)),
steps as (
  select a.grid_id, k, min(abs(a.r + i * k - b.r) + abs(a.c + j * k - b.c)) as d
  from a join b using (grid_id) join dir using (grid_id), range(43) s(k) group by a.grid_id, k),
stop as (select grid_id, coalesce(min(k) filter (d = 1), 42) as k from steps group by grid_id)
select grid_id, (i * k)::int as fall_r, (j * k)::int as fall_c from stop join dir using (grid_id)""")
def grid_gravitate(spark, sf_dir):
    src = _extreme_colours(spark, sf_dir).withColumn("move", O.gravitate(F.col("a"), F.col("b")))
    return src.select("grid_id", F.col("move.r").alias("fall_r"), F.col("move.c").alias("fall_c"))


WRITE_SQL = f"""{PAIRS},
n as (select pair_id, v, count(*) as n from pin group by all),
m as (select pair_id, arg_max(v, n * 100 - v) as mc from n group by pair_id),
cellsx as (
  select i.pair_id, i.r, i.c, i.v, o.v as ov, mc
  from pin i join m using (pair_id) left join pout o on o.pair_id = i.pair_id and o.r = i.r and o.c = i.c and o.v = 5)"""


@query(f"""with {WRITE_SQL},
forms as (
  select pair_id, r, c, 'fill' as form, case when ov is not null then 0 else v end as v from cellsx union all
  select pair_id, r, c, 'paint', coalesce(ov, v) from cellsx union all
  select pair_id, r, c, 'underfill', case when ov is not null and v = mc then 0 else v end from cellsx union all
  select pair_id, r, c, 'underpaint', case when ov is not null and v = mc then ov else v end from cellsx union all
  select pair_id, r, c, 'cover', case when ov is not null then mc else v end from cellsx)
{text_sql('forms', 'pair_id, form')}""")
def grid_writers(spark, sf_dir):
    """The input overwritten in five ways at the output's colour-5 cells."""
    a = F.col("input")
    patch = G.ofcolor(F.col("output"), 5)
    five = O.toobject(patch, F.col("output"))
    src = pairs(spark, sf_dir).withColumn("patch", patch).withColumn("five", five)
    p, f = F.col("patch"), F.col("five")
    forms = {
        "fill": O.fill(a, 0, p),
        "paint": O.paint(a, f),
        "underfill": O.underfill(a, 0, p),
        "underpaint": O.underpaint(a, f),
        "cover": O.cover(a, p),
    }
    return _named_forms(src, "pair_id", forms)


def _named_forms(src, key, forms):
    """One row per named grid expression."""
    entries = F.array(*[F.struct(F.lit(k).alias("form"), G.to_text(v).alias("grid")) for k, v in forms.items()])
    return src.select(key, F.explode(entries).alias("e")).select(key, "e.form", "e.grid")


@query(f"""with {RAGGED},
forms as (
  select grid_id, r, c, v, 'crop' as form from ragged where r between 1 and 2 and c between 1 and 2 union all
  select grid_id, r, c, v, 'trim' from ragged where r between 1 and h - 2 and c between 1 and w - 2 union all
  select grid_id, r, c, v, 'tophalf' from ragged where r < h // 2 union all
  select grid_id, r, c, v, 'bottomhalf' from ragged where r >= h // 2 + h % 2 union all
  select grid_id, r, c, v, 'lefthalf' from ragged where c < w // 2 union all
  select grid_id, r, c, v, 'righthalf' from ragged where c >= w // 2 + w % 2 union all
  select a.grid_id, r, c, v, 'subgrid' from ragged a join (
    select grid_id, min(r) as t, max(r) as b, min(c) as l, max(c) as rr from ragged join (
      select grid_id, max(v) as hi from ragged group by grid_id) using (grid_id) where v = hi group by grid_id) x
    on x.grid_id = a.grid_id and r between t and b and c between l and rr)
{text_sql('forms', 'grid_id, form')}""")
def grid_windows(spark, sf_dir):
    forms = {
        "crop": G.crop(g(), 1, 1, 2, 2),
        "trim": G.trim(g()),
        "tophalf": G.tophalf(g()),
        "bottomhalf": G.bottomhalf(g()),
        "lefthalf": G.lefthalf(g()),
        "righthalf": G.righthalf(g()),
        "subgrid": O.subgrid(G.ofcolor(g(), F.array_max(G.values(g()))), g()),
    }
    return _named_forms(ragged(spark, sf_dir), "grid_id", forms)


@query(f"""with {RAGGED},
forms as (
  select grid_id, r, c * 2 + j as c, v, 'hupscale' as form from ragged, range(2) b(j) union all
  select grid_id, r * 3 + i, c, v, 'vupscale' from ragged, range(3) a(i) union all
  select grid_id, r * 2 + i, c * 2 + j, v, 'upscale' from ragged, range(2) a(i), range(2) b(j) union all
  select grid_id, r // 2, c // 2, v, 'downscale' from ragged where r % 2 = 0 and c % 2 = 0)
{text_sql('forms', 'grid_id, form')}""")
def grid_scaling(spark, sf_dir):
    forms = {
        "hupscale": G.hupscale(g(), 2),
        "vupscale": G.vupscale(g(), 3),
        "upscale": G.upscale(g(), 2),
        "downscale": G.downscale(g(), 2),
    }
    return _named_forms(ragged(spark, sf_dir), "grid_id", forms)


@query(f"""with {RAGGED},
bb as (select grid_id, v, min(r) as t, min(c) as l, max(r) as b, max(c) as rr from ragged group by all),
forms as (
  select grid_id, v, 'hmirror' as form, t + b - r as y, c as x from ragged join bb using (grid_id, v) union all
  select grid_id, v, 'vmirror', r, l + rr - c from ragged join bb using (grid_id, v) union all
  select grid_id, v, 'dmirror', c - l + t, r - t + l from ragged join bb using (grid_id, v) union all
  select grid_id, v, 'cmirror', t + rr - c, l + b - r from ragged join bb using (grid_id, v) union all
  select grid_id, v, 'upscale', t + (r - t) * 2 + i, l + (c - l) * 2 + j
    from ragged join bb using (grid_id, v), range(2) p(i), range(2) q(j))
select grid_id, v, form, string_agg(y || ':' || x, ',' order by y, x) as cells from forms group by all""")
def grid_object_symmetry(spark, sf_dir):
    forms = {
        "hmirror": O.hmirror(obj()),
        "vmirror": O.vmirror(obj()),
        "dmirror": O.dmirror(obj()),
        "cmirror": O.cmirror(obj()),
        "upscale": O.upscale(obj(), 2),
    }

    def text(o):
        ordered = F.array_sort(O.toindices(o))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["r"], s["c"])), ",")

    entries = F.array(*[F.struct(F.lit(k).alias("form"), text(o).alias("cells")) for k, o in forms.items()])
    src = colour_objects(spark, sf_dir)
    return src.select("grid_id", "v", F.explode(entries).alias("e")).select("grid_id", "v", "e.form", "e.cells")


@query(f"""with {PAIRS},
forms as (
  select i.pair_id, i.r, i.c, i.v, 'hconcat' as form from pin i
    join (select pair_id, max(h) as oh from pout group by pair_id) o on o.pair_id = i.pair_id and i.r < oh union all
  select o.pair_id, o.r, o.c + iw, o.v, 'hconcat' from pout o
    join (select pair_id, max(h) as ih, max(w) as iw from pin group by pair_id) i on o.pair_id = i.pair_id and o.r < ih union all
  select pair_id, r, c, v, 'hsplit_1' from pin where c between w // 2 + w % 2 and w // 2 + w % 2 + w // 2 - 1 union all
  select pair_id, r, c, v, 'vsplit_2' from pin
    where r between 2 * (h // 3) + 2 * least(h % 3, 1) and 3 * (h // 3) + 2 * least(h % 3, 1) - 1)
select * from ({text_sql('forms', 'pair_id, form')}) union all
select pair_id, 'vconcat' as form, a.grid || ' | ' || b.grid from ({text_sql('pin', 'pair_id')}) a
  join ({text_sql('pout', 'pair_id')}) b using (pair_id)""")
def grid_concat(spark, sf_dir):
    a, b = F.col("input"), F.col("output")
    forms = {
        "hconcat": G.hconcat(a, b),
        "vconcat": G.vconcat(a, b),
        "hsplit_1": F.get(G.hsplit(a, 2), F.lit(1)),
        "vsplit_2": F.get(G.vsplit(a, 3), F.lit(2)),
    }
    out = _named_forms(pairs(spark, sf_dir), "pair_id", forms)
    return out.where("grid <> ''")


@query(f"""with {PAIRS},
forms as (select i.pair_id, i.r, i.c, case when i.v = o.v then i.v else 0 end as v
          from pin i left join pout o on o.pair_id = i.pair_id and o.r = i.r and o.c = i.c)
{text_sql('forms', 'pair_id')}""")
def grid_cellwise(spark, sf_dir):
    out = G.cellwise(F.col("input"), F.col("output"), 0)
    return pairs(spark, sf_dir).select("pair_id", G.to_text(out).alias("grid"))


@query(f"""with {RAGGED},
forms as (
  select grid_id, r, c, case when v = 5 then 1 else v end as v, 'replace' as form from ragged union all
  select grid_id, r, c, case when v = 5 then 4 when v = 4 then 5 else v end, 'switch' from ragged)
{text_sql('forms', 'grid_id, form')}""")
def grid_recolor(spark, sf_dir):
    forms = {"replace": G.replace(g(), 5, 1), "switch": G.switch(g(), 4, 5)}
    return _named_forms(ragged(spark, sf_dir), "grid_id", forms)


@query(f"""with {RAGGED},
d as (select distinct grid_id, h, w from ragged),
forms as (
  select grid_id, r, c, 'frontiers' as form,
         case when r = h - 1 or c = w - 1 then 1 else 0 end as v from ragged union all
  select grid_id, r, c, 'diagonal', case when r = c and r < least(h, w) then 1 else 0 end from ragged union all
  select grid_id, r, c, 'antidiagonal',
         case when r + c = least(h, w) - 1 and greatest(r, c) < least(h, w) then 1 else 0 end from ragged union all
  select grid_id, r, c, 'none', 0 from ragged union all
  select grid_id, r, c, 'ray', case when r - c = 1 then 1 else 0 end from ragged)
{text_sql('forms', 'grid_id, form')}""")
def grid_lines(spark, sf_dir):
    """Frontiers, connections and rays drawn on an empty canvas of the grid's shape."""
    blank = G.canvas(0, G.height(g()), G.width(g()))
    h, w = G.height(g()), G.width(g())
    n = F.least(h, w) - 1
    crossing = F.concat(O.hfrontier(O.loc(h - 1, 0)), O.vfrontier(O.loc(0, w - 1)))
    forms = {
        "frontiers": O.fill(blank, 1, crossing),
        "diagonal": O.fill(blank, 1, O.connect(O.loc(0, 0), O.loc(n, n))),
        "antidiagonal": O.fill(blank, 1, O.connect(O.loc(0, n), O.loc(n, 0))),
        "none": O.fill(blank, 1, O.connect(O.loc(0, 0), O.loc(1, 2))),
        "ray": O.fill(blank, 1, O.shoot(O.loc(1, 0), O.loc(1, 1))),
    }
    return _named_forms(ragged(spark, sf_dir), "grid_id", forms)


@query(f"""with {RAGGED},
pat as (select grid_id, max(v) filter (r = 0 and c = 0) as a, max(v) filter (r = 0 and c = 1) as b from ragged group by grid_id)
select x.grid_id, string_agg(x.r || ':' || x.c, ',' order by x.r, x.c) as places, count(*)::int as n
from ragged x join ragged y on y.grid_id = x.grid_id and y.r = x.r and y.c = x.c + 1
join pat on pat.grid_id = x.grid_id and x.v = a and y.v = b group by x.grid_id""")
def grid_occurrences(spark, sf_dir):
    """Places where the grid's first two cells occur again, found as a grid and as an object."""
    pattern = G.crop(g(), 0, 0, 1, 2)
    src = ragged(spark, sf_dir).withColumn("hits", G.occurrences(g(), pattern))
    by_object = O.object_occurrences(g(), G.asobject(pattern))
    text = F.array_join(F.transform("hits", lambda s: F.concat_ws(":", s["r"], s["c"])), ",")
    return src.select("grid_id", text.alias("places"), F.size(by_object).alias("n"))


UNIFORM_SQL = """
rows_ as (select grid_id, r, min(v) as v, count(distinct v) as k from two_tone group by all),
cols_ as (select grid_id, c, min(v) as v, count(distinct v) as k from two_tone group by all)"""


@query(f"""with {BINARY}, {UNIFORM_SQL}
select grid_id, 'h' as axis, r as line, v from rows_ where k = 1 union all
select grid_id, 'v', c, v from cols_ where k = 1""")
def grid_frontiers(spark, sf_dir):
    rows = binary(spark, sf_dir).select("grid_id", F.explode(G.frontiers(g())).alias("f"))
    return rows.select("grid_id", "f.axis", F.col("f.at").alias("line"), "f.v")


@query(f"""with {BINARY}, {UNIFORM_SQL},
kept as (select b.* from two_tone b join rows_ x on x.grid_id = b.grid_id and x.r = b.r and x.k > 1
         join cols_ y on y.grid_id = b.grid_id and y.c = b.c and y.k > 1)
{text_sql('kept')}""")
def grid_compress(spark, sf_dir):
    out = binary(spark, sf_dir).select("grid_id", G.compress(g()).alias("grid")).where(G.width(g()) > 0)
    return out.select("grid_id", G.to_text(g()).alias("grid"))


@query(f"""with {BINARY},
dims as (select distinct grid_id, h, w from two_tone),
hp as (
  select d.grid_id, p from dims d, range(1, 8) t(p)
  where p < w and not exists (select 1 from two_tone a join two_tone b on a.grid_id = b.grid_id and a.r = b.r
    and b.c = a.c + p where a.grid_id = d.grid_id and a.v <> b.v)),
vp as (
  select d.grid_id, p from dims d, range(1, 8) t(p)
  where p < h and not exists (select 1 from two_tone a join two_tone b on a.grid_id = b.grid_id and a.c = b.c
    and b.r = a.r + p where a.grid_id = d.grid_id and a.v <> b.v))
select d.grid_id, coalesce((select min(p) from hp where hp.grid_id = d.grid_id), w)::int as hperiod,
  coalesce((select min(p) from vp where vp.grid_id = d.grid_id), h)::int as vperiod from dims d""")
def grid_period(spark, sf_dir):
    return binary(spark, sf_dir).select(
        "grid_id", G.hperiod(g()).alias("hperiod"), G.vperiod(g()).alias("vperiod")
    )


@query(f"""with {BINARY},
bb as (select grid_id, v, min(r) as t, min(c) as l, max(r) - min(r) + 1 as h, max(c) - min(c) + 1 as w from two_tone group by all),
norm as (select a.grid_id, a.v, a.r - t as r, a.c - l as c from two_tone a join bb using (grid_id, v)),
hbad as (select a.grid_id, a.v, p from norm a, range(1, 8) t(p) where a.c >= p and not exists (
  select 1 from norm b where b.grid_id = a.grid_id and b.v = a.v and b.r = a.r and b.c = a.c - p)),
vbad as (select a.grid_id, a.v, p from norm a, range(1, 8) t(p) where a.r >= p and not exists (
  select 1 from norm b where b.grid_id = a.grid_id and b.v = a.v and b.c = a.c and b.r = a.r - p))
select grid_id, v,
  coalesce((select min(p) from range(1, 8) t(p) where p < w and not exists (
    select 1 from hbad x where x.grid_id = bb.grid_id and x.v = bb.v and x.p = t.p)), w)::int as hperiod,
  coalesce((select min(p) from range(1, 8) t(p) where p < h and not exists (
    select 1 from vbad x where x.grid_id = bb.grid_id and x.v = bb.v and x.p = t.p)), h)::int as vperiod
from bb""")
def grid_object_period(spark, sf_dir):
    rows = binary(spark, sf_dir).select("grid_id", F.explode(O.partition(g())).alias("obj"))
    return rows.select(
        "grid_id",
        O.color(obj()).alias("v"),
        O.object_hperiod(obj()).alias("hperiod"),
        O.object_vperiod(obj()).alias("vperiod"),
    )


@query(f"""with {RAGGED},
canvas as (
  select d.grid_id, y as r, x as c, coalesce(q.v + 2, 0) as v
  from (select distinct grid_id from ragged) d cross join range(30) a(y) cross join range(30) b(x)
  left join (select grid_id, r, c, case when (r * 8 + c + grid_id) % 23 = 7 then -1 else v end as v from ragged) q
    on q.grid_id = d.grid_id and q.r = y and q.c = x),
firsts as (select grid_id, r, min(case when v < 2 or v > 11 then c else 30 end) as n from canvas group by all),
runs as (select grid_id, r, min(n) over (partition by grid_id order by r) as run from firsts),
best as (select grid_id, arg_max(r + 1, (r + 1) * run * 100 - r) as h, arg_max(run, (r + 1) * run * 100 - r) as w,
                max((r + 1) * run) as area from runs group by grid_id),
kept as (select c.grid_id, c.r, c.c, c.v - 2 as v from canvas c join best using (grid_id)
         where area > 0 and c.r < h and c.c < w)
select grid_id, (case when area > 0 then h else 0 end)::int as h, (case when area > 0 then w else 0 end)::int as w,
       coalesce(grid, '') as grid
from best left join ({text_sql('kept')}) using (grid_id)""")
def grid_crop_valid_rect(spark, sf_dir):
    """Largest clean corner of the grids on a 30 x 30 canvas with some cells spoiled."""
    def value(r, c):
        inside = G.cell(g(), r, c)
        spoiled = (r * 8 + c + F.col("grid_id")) % 23 == 7
        return F.when(inside.isNull(), 0).when(spoiled, 1).otherwise(inside + 2).cast("int")

    canvas = ragged(spark, sf_dir).select("grid_id", G.build(30, 30, value).alias("x"))
    cut = canvas.select("grid_id", G.valid_rect(F.col("x")).alias("grid"))
    return cut.select(
        "grid_id", G.height(g()).alias("h"), G.width(g()).alias("w"), G.to_text(g()).alias("grid")
    )


@query(f"""with {CELLS},
forms as (
  select grid_id, t, v,
    (case t when 0 then r when 1 then 7 - c when 2 then 7 - r when 3 then c
            when 4 then r when 5 then 7 - r when 6 then c else 7 - c end) as r,
    (case t when 0 then c when 1 then r when 2 then 7 - c when 3 then 7 - r
            when 4 then 7 - c when 5 then c when 6 then r else 7 - r end) as c
  from cells, range(8) x(t)),
tiles as (
  select grid_id, (r + 8 * (t // 3))::int as r, (c + 8 * (t % 3))::int as c, v from forms union all
  select grid_id, (16 + y)::int, (16 + x)::int, 255 from (select distinct grid_id from cells), range(8) a(y), range(8) b(x))
select grid_id, md5(grid) as mosaic from ({text_sql('tiles')})""")
def grid_mosaic(spark, sf_dir):
    panels = F.array(*[G.dihedral(g(), t) for t in range(8)])
    src = grids(spark, sf_dir).select("grid_id", panels.alias("panels"))
    board = G.mosaic(F.col("panels"), 8)
    return src.select("grid_id", F.md5(G.to_text(board)).alias("mosaic"))


@query(f"""with {RAGGED},
s as (select *, min(v) over (partition by grid_id) as lo, max(v) over (partition by grid_id) as hi from ragged),
forms as (
  select grid_id, r, c, 'minmax' as form,
         floor((v - lo)::double / (hi - lo + 1e-8::double) * 255)::int as v from s union all
  select grid_id, r, c, 'max', case when hi > 0 then floor(((v::double / hi)::float * 255::float)::float)::int else v end from s)
{text_sql('forms', 'grid_id, form')}""")
def grid_normalise(spark, sf_dir):
    forms = {"minmax": G.rescale(g()), "max": G.rescale_by_max(g())}
    return _named_forms(ragged(spark, sf_dir), "grid_id", forms)


@query(f"""with {RAGGED}
select grid_id, (grid_id % 7 <> 3 and max(v) - (case when grid_id % 5 = 2 then 0 else 4 end) <= 9
                 and min(v) + (case when grid_id % 5 = 1 then -6 else 0 end) >= 0
                 and max(v) + (case when grid_id % 5 = 2 then 4 else 0 end) <= 9) as valid
from ragged group by grid_id""")
def grid_validity(spark, sf_dir):
    """Validity after some grids are made ragged or pushed out of the value range."""
    shift = (
        F.when(F.col("grid_id") % 5 == 1, -6).when(F.col("grid_id") % 5 == 2, 4).otherwise(0)
    )
    moved = F.transform(g(), lambda row: F.transform(row, lambda v: (v + shift).cast("int")))
    broken = F.when(
        F.col("grid_id") % 7 == 3, F.concat(moved, F.array(F.array(F.lit(1))))
    ).otherwise(moved)
    return ragged(spark, sf_dir).select("grid_id", G.is_valid(broken).alias("valid"))


RULE_SQL = f"""{BINARY},
ex as (
  select grid_id, grid_id % 20 as task, r, c, v, h, w,
         case when grid_id % 20 < 12 then r when grid_id % 40 < 20 then h - 1 - r else r end as orow,
         case when grid_id % 20 < 12 then w - 1 - c when grid_id % 40 < 20 then c else w - 1 - c end as ocol
  from two_tone),
texts as (
  select grid_id, task, max(h) as h, max(w) as w, string_agg(v::varchar, ',' order by r, c) as i,
         string_agg(v::varchar, ',' order by orow, ocol) as o, string_agg(v::varchar, ',' order by r, w - 1 - c) as rule
  from ex group by grid_id, task)"""


def _rule_examples(spark, sf_dir):
    """Examples of 20 tasks whose output mirrors columns, or rows in half of the last eight tasks."""
    mirrored = F.when(
        (F.col("grid_id") % 20 >= 12) & (F.col("grid_id") % 40 < 20), G.hmirror(g())
    ).otherwise(G.vmirror(g()))
    return binary(spark, sf_dir).select(
        (F.col("grid_id") % 20).alias("task"),
        F.col("grid_id").alias("seq"),
        g().alias("input"),
        mirrored.alias("output"),
    )


@query(f"""with {RULE_SQL}
select task, count(*) as n, count(*) filter (o = rule) as n_ok,
  round(avg(case when o = rule then 1.0::double else 0.0::double end), 6) as share, bool_and(o = rule) as solved
from texts group by task""")
def rule_verification(spark, sf_dir):
    report = Q.verify_rule(_rule_examples(spark, sf_dir), G.vmirror, ["task"])
    return report.withColumn("share", F.round("share", 6))


@query(f"""with {RULE_SQL},
good as (select *, row_number() over (partition by task, h, w, i order by grid_id) as rn
         from texts where o = rule and o <> i),
kept as (select *, row_number() over (partition by task order by grid_id) as k from good where rn = 1)
select task, grid_id as seq, i as input from kept where k <= 10""")
def verified_examples(spark, sf_dir):
    kept = Q.verified_examples(_rule_examples(spark, sf_dir), G.vmirror, ["task"], "seq", cap=10)
    flat = F.transform(G.values(F.col("input")), lambda v: v.cast("string"))
    return kept.select("task", "seq", F.array_join(flat, ",").alias("input"))


@query(f"""with {RULE_SQL}
select task, count(*) as generated, count(*) as valid, count(*) filter (o = rule) as verified,
  count(*) filter (o = rule and o <> i) as non_degenerate,
  count(distinct (h, w, i)) filter (o = rule and o <> i) as unique_inputs
from texts group by task""")
def verification_funnel(spark, sf_dir):
    return Q.verification_funnel(_rule_examples(spark, sf_dir), G.vmirror, ["task"], "seq")


@query(f"""with {RAGGED},
patches as (select p_partkey % 500 as grid_id, p_size % 8 as r, (p_size // 8) % 8 as c, min(p_size % 10) as v
            from part group by all),
fixed as (select a.grid_id, a.r, a.c, coalesce(p.v, a.v) as v from ragged a left join patches p using (grid_id, r, c))
{text_sql('fixed')}""")
def grid_patches(spark, sf_dir):
    """Listed cells overwritten, one value per grid and cell."""
    size = F.col("p_size")
    patches = (
        table(spark, sf_dir, "part")
        .groupBy(
            (F.col("p_partkey") % 500).alias("grid_id"),
            (size % 8).alias("r"),
            (F.floor(size / 8) % 8).cast("int").alias("c"),
        )
        .agg(F.min(size % 10).alias("v"))
    )
    return Q.patch_cells(ragged(spark, sf_dir), patches).select("grid_id", G.to_text(g()).alias("grid"))


@query(f"""with {RAGGED}, n as (select grid_id, count(distinct v) * 100 + count(*) as score from ragged group by grid_id),
ranked as (select grid_id % 5 as task, grid_id, score,
  row_number() over (partition by grid_id % 5 order by score, grid_id) - 1 as rank from n)
select task, grid_id, rank, case when rank < 20 then 'easy' else 'hard' end as slice
from ranked where rank between 10 and 19 or rank between 80 and 89""")
def difficulty_slices(spark, sf_dir):
    scored = ragged(spark, sf_dir).select(
        (F.col("grid_id") % 5).alias("task"),
        "grid_id",
        (G.numcolors(g()) * 100 + G.height(g()) * G.width(g())).alias("score"),
    )
    out = Q.difficulty_slices(scored, ["task"], "score", "grid_id", 10)
    return out.select("task", "grid_id", "rank", "slice")
