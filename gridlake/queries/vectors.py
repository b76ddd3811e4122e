"""Queries over embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridlake.functions import numeric as N
from gridlake.operators import hamming as H
from gridlake.operators import vectors as V
from gridlake.plans.bounds import cut_lineage, spread
from gridlake.queries.registry import query, table

DIM = 64


def embeddings(spark, sf_dir):
    return spread(table(spark, sf_dir, "embeddings"))


# --- codebooks: one centre per label and half of the vectors' signs, from the whole table --------

BOOK_SQL = """
flat as (select vec_id, label, i, embedding[i + 1]::double as x from embeddings, range(64) t(i)),
groups as (select vec_id, label * 2 + (embedding[1] > 0)::int as g from embeddings),
book as (select g::bigint as concept_id, i, round(avg(x), 6) as c from flat join groups using (vec_id) group by all),
book_norm as (select concept_id, sum(c * c) as n from book group by concept_id),
dist as (
  select f.vec_id, b.concept_id, sum(f.x * f.x) + max(n.n) - 2 * sum(f.x * b.c) as d
  from flat f join book b using (i) join book_norm n using (concept_id) group by all),
assigned as (select vec_id, arg_min(concept_id, d) as concept_id, min(d) as distance from dist group by vec_id)"""


def codebook(spark, sf_dir):
    """Mean vector per label and sign of the first dimension, rounded."""
    emb = table(spark, sf_dir, "embeddings")
    group = F.col("label") * 2 + (F.get("embedding", F.lit(0)) > 0).cast("int")
    sums = emb.groupBy(group.cast("long").alias("concept_id")).agg(
        F.count("*").alias("n"), *[F.sum(F.get("embedding", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(DIM)]
    )
    means = F.transform(F.array(*[F.col(f"_{i}") for i in range(DIM)]), lambda s: F.round(s / F.col("n"), 6))
    return sums.select("concept_id", means.alias("vec"))


def assigned(spark, sf_dir):
    return V.assign_codebook(embeddings(spark, sf_dir), codebook(spark, sf_dir), "vec_id", "embedding", DIM)


@query(f"with {BOOK_SQL} select vec_id, concept_id, round(distance, 6) as distance from assigned")
def vq_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select("vec_id", "concept_id", F.round("distance", 6).alias("distance"))


@query(f"with {BOOK_SQL} select vec_id, concept_id, round(distance, 6) as distance from assigned")
def vq_assign_blocked(spark, sf_dir):
    """The same assignment with the codebook cut into blocks, as for one too large for a task."""
    out = V.assign_codebook(
        embeddings(spark, sf_dir), codebook(spark, sf_dir), "vec_id", "embedding", DIM, max_values=5 * DIM, group_rows=200
    )
    return out.select("vec_id", "concept_id", F.round("distance", 6).alias("distance"))


USAGE_SQL = f"""{BOOK_SQL},
usage as (select k as concept_id, count(a.vec_id) as n from range(24) t(k) left join assigned a on a.concept_id = k group by k)"""


def usage(spark, sf_dir):
    """Usage of 24 concepts, four of which have no centre and stay unused."""
    known = spark.range(24).select(F.col("id").alias("concept_id"))
    return V.codebook_usage(assigned(spark, sf_dir), known)


@query(f"""with {USAGE_SQL}
select concept_id, n, round(n::double / sum(n) over (), 6) as share from usage""")
def codebook_usage(spark, sf_dir):
    out = V.normalised_usage(usage(spark, sf_dir))
    return out.select("concept_id", "n", F.round("share", 6).alias("share"))


@query(f"""with {USAGE_SQL}, m as (select avg(n) as m from usage)
select count(*) filter (n > m * 0.01::double) as active_codes, count(*) filter (n < m * 0.01::double) as dead_codes,
  round(avg((n > 0)::int), 6) as utilization, max(n) as max_usage, round(avg(n), 6) as mean_usage, min(n) as min_usage,
  round(stddev_samp(n), 6) as std_usage from usage, m""")
def codebook_health(spark, sf_dir):
    out = V.usage_report(usage(spark, sf_dir))
    for name in ("utilization", "mean_usage", "std_usage"):
        out = out.withColumn(name, F.round(name, 6))
    return out


@query(f"""with {USAGE_SQL}, p as (select n::double / sum(n) over () as p from usage)
select round(exp(-sum(p * ln(p + 1e-10::double))), 6) as perplexity from p""")
def codebook_perplexity(spark, sf_dir):
    return V.codebook_perplexity(usage(spark, sf_dir)).withColumn("perplexity", F.round("perplexity", 6))


UPDATE_SQL = f"""{BOOK_SQL},
state as (select concept_id, 5.0::double + concept_id as size from range(24) t(concept_id)),
cnt as (select concept_id, count(*) as n from assigned group by concept_id),
moved as (select s.concept_id, 0.9::double * size + 0.1::double * coalesce(n, 0) as size from state s left join cnt using (concept_id)),
whole as (select sum(size) as t, count(*) as k from moved),
smooth as (select concept_id, (size + 1e-5::double) / (t + k * 1e-5::double) * t as size from moved, whole),
sums as (select a.concept_id, i, sum(x) as s from assigned a join flat f using (vec_id) group by all),
tot as (
  select s.concept_id, i, 0.9::double * ((s.concept_id + i) / 100.0::double) + 0.1::double * coalesce(u.s, 0) as total
  from state s cross join range(64) t(i) left join sums u using (concept_id, i))"""


def updated_codebook(spark, sf_dir):
    state = spark.range(24).select(
        F.col("id").alias("concept_id"),
        (F.lit(5.0) + F.col("id")).alias("size"),
        F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: (F.col("id") + i) / F.lit(100.0)).alias("total"),
    )
    return V.update_codebook(state, assigned(spark, sf_dir), "embedding", DIM, decay=0.9)


@query(f"""with {UPDATE_SQL}
select concept_id, i::int as dim, round(size, 6) as size, round(total, 6) as total, round(total / size, 6) as centre
from tot join smooth using (concept_id)""")
def codebook_update(spark, sf_dir):
    out = updated_codebook(spark, sf_dir)
    rows = out.select("concept_id", "size", F.posexplode(F.arrays_zip("total", "vec")).alias("dim", "s"))
    return rows.select(
        "concept_id", "dim", F.round("size", 6).alias("size"), F.round("s.total", 6).alias("total"), F.round("s.vec", 6).alias("centre")
    )


@query(f"""with {UPDATE_SQL},
m as (select avg(size) as m from smooth),
flag as (select concept_id, size, size < m * 0.9::double as dead, m from smooth, m),
active as (select concept_id as src, row_number() over (order by concept_id) - 1 as spot, (select count(*) from flag where not dead) as n
           from flag where not dead),
pick as (select d.concept_id, a.src from flag d join active a
         on a.spot = ('0x' || substr(md5(d.concept_id::varchar || '|42'), 1, 8))::bigint % a.n where d.dead),
noise as (
  select concept_id, i, md5(concept_id::varchar || '|' || i || '|42') as h from pick, range(64) t(i)),
g as (select concept_id, i, sqrt(-2 * ln((('0x' || substr(h, 1, 8))::bigint + 1) / (pow(2, 32) + 1)))
        * cos(2 * pi() * (('0x' || substr(h, 9, 8))::bigint / pow(2, 32))) * 0.1::double as e from noise)
select f.concept_id, t.i::int as dim, dead, round(case when dead then m * 0.1::double else f.size end, 6) as size,
  round(case when dead then st.total / ss.size + e else t.total / f.size end, 6) as centre
from flag f join tot t using (concept_id) left join pick p on p.concept_id = f.concept_id
left join tot st on st.concept_id = p.src and st.i = t.i left join smooth ss on ss.concept_id = p.src
left join g on g.concept_id = f.concept_id and g.i = t.i""")
def dead_codes(spark, sf_dir):
    out = V.reset_dead_codes(updated_codebook(spark, sf_dir), DIM, min_usage=0.9)
    rows = out.select("concept_id", "dead", "size", F.posexplode("vec").alias("dim", "centre"))
    return rows.select("concept_id", "dim", "dead", F.round("size", 6).alias("size"), F.round("centre", 6).alias("centre"))


@query(f"""with {BOOK_SQL}, m as (
  select f.vec_id, avg((x - c) ** 2) as m from flat f join assigned a using (vec_id) join book b on b.concept_id = a.concept_id and b.i = f.i group by 1)
select round(avg(m), 6) as commitment from m""")
def vq_commitment(spark, sf_dir):
    looked = V.lookup(assigned(spark, sf_dir), codebook(spark, sf_dir))
    return V.commitment_loss(looked, "embedding", "looked_up").withColumn("commitment", F.round("commitment", 6))


def _kmeans_sql(k: int, rounds: int, steps: int, seed: int = 42) -> str:
    """Seeding and steps of the clustering one after the other, over whole numbers."""
    draw = lambda r: f"('0x' || substr(md5(vec_id::varchar || '|{seed}|{r}'), 1, 8))::bigint"
    near = lambda book: (
        f"select vec_id, min(d) as d, arg_min(cid, d * 4294967296::hugeint + cid) as cid from "
        f"(select g.vec_id, b.cid, sum((g.x - b.x) * (g.x - b.x)) as d from g join {book} b using (i) group by all) group by vec_id"
    )
    ctes = [
        "g as (select vec_id, i, floor(embedding[i + 1]::double * 65536)::bigint as x from embeddings, range(64) t(i))",
        "ids as (select distinct vec_id from g)",
        f"c0 as materialized (select vec_id as cid, i, x from g where vec_id = (select vec_id from ids order by {draw(0)}, vec_id limit 1))",
    ]
    for r in range(1, rounds + 1):
        ctes += [
            f"n{r} as materialized ({near(f'c{r - 1}')})",
            f"c{r} as materialized (select * from c{r - 1} union all select vec_id, i, x from g where vec_id in (select vec_id from n{r} "
            f"where {draw(r)}::double * (select sum(d) from n{r})::double < {2 * k * 2**32}::double * d::double))",
        ]
    ctes += [
        f"w as materialized (select cid, count(*) as weight from ({near(f'c{rounds}')}) group by cid)",
        f"pairs as materialized (select a.cid, b.cid as other, sum((a.x - b.x) * (a.x - b.x)) as d from c{rounds} a join c{rounds} b using (i) group by all)",
        "s0 as materialized (select cid, 0 as concept_id from w order by weight desc, cid limit 1)",
    ]
    for j in range(1, k):
        ctes.append(
            f"s{j} as materialized (select * from s{j - 1} union all (select cid, {j} from w join (select p.cid, min(d) as d from pairs p join s{j - 1} s on p.other = s.cid "
            f"group by p.cid) using (cid) where d > 0 order by weight * d desc, cid limit 1))"
        )
    ctes.append(f"b0 as materialized (select concept_id::bigint as cid, i, x from s{k - 1} join c{rounds} using (cid))")
    for t in range(1, steps + 1):
        ctes += [
            f"a{t} as materialized ({near(f'b{t - 1}')})",
            f"b{t} as materialized (select b.cid, i, coalesce(m.x, b.x) as x from b{t - 1} b left join (select cid, i, "
            f"floor((2 * sum(x) + count(*))::double / (2 * count(*)))::bigint as x from g join a{t} using (vec_id) group by cid, i) m using (cid, i))",
        ]
    ctes.append(f"fin as ({near(f'b{steps}')})")
    return "with " + ",\n".join(ctes)


@query(_kmeans_sql(16, 2, 5) + """
select cid as concept_id, n, size, norm from (select cid, sum((x * x)::bigint)::double as norm from b5 group by cid)
left join (select cid, count(*) as n, sum(d)::double as size from fin group by cid) using (cid)""")
def kmeans_concepts(spark, sf_dir):
    """Clusters of all vectors: members, squared distances in them and squared length of the centre, in grains."""
    emb = embeddings(spark, sf_dir)
    found, book = V.kmeans_concepts(emb, "vec_id", "embedding", DIM, k=16, max_iter=5, rounds=2)
    grains = F.transform("embedding", lambda x: F.floor(x.cast("double") * V.GRAIN))
    centre = book.select("concept_id", F.transform("vec", lambda x: F.round(x * V.GRAIN).cast("long")).alias("centre"))
    off = F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    members = emb.select("vec_id", grains.alias("v")).join(found, "vec_id").join(F.broadcast(centre), "concept_id")
    sums = members.groupBy("concept_id").agg(F.count("*").alias("n"), F.sum(total(off)).cast("double").alias("size"))
    norm = total(F.transform("centre", lambda x: x * x)).cast("double").alias("norm")
    return centre.select("concept_id", norm).join(sums, "concept_id", "left")


PHRASE_SQL = f"""{BOOK_SQL},
texts as (select doc_id as sample_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as ws from documents),
parts as (select sample_id, k::int as k, array_to_string(ws[(k * len(ws)) // 4 + 1:((k + 1) * len(ws)) // 4], ' ') as phrase
          from texts, range(4) t(k)),
caps as (select vec_id // 4 as sample_id, (vec_id % 4)::int as k, concept_id from assigned)"""


@query(f"""with {PHRASE_SQL}
select concept_id, arg_min(phrase, sample_id * 4 + k) as phrase from caps join parts using (sample_id, k) group by concept_id""")
def concept_phrases(spark, sf_dir):
    """Four consecutive vectors are the capsules of one document; their slices name the concepts."""
    caps = assigned(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 4).alias("sample_id"), (F.col("vec_id") % 4).cast("int").alias("k"), "concept_id"
    )
    texts = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("sample_id"), "text")
    return V.representative_phrases(caps, texts, 4)


# --- hashing and retrieval ----------------------------------------------------------------------

PROJECT_SQL = """
proj as (select d, h, case when (d * 7919 + h * 104729) % 7 < 3 then 1.0::double else -1.0 end as p from range(64) a(d), range(32) b(h)),
flat as (select vec_id, label, i, embedding[i + 1]::double as x from embeddings, range(64) t(i))"""


@query(f"""with {PROJECT_SQL},
b as (select vec_id, h, sum(x * p) > 0 as bit from flat join proj on d = i group by all)
select vec_id, string_agg(bit::int::varchar, '' order by h) as simhash from b group by vec_id""")
def simhash(spark, sf_dir):
    code = V.simhash(F.col("embedding"), V.sign_projection(DIM, 32))
    return embeddings(spark, sf_dir).select("vec_id", code.alias("simhash"))


HASHES, HASH_SIZE = 8, 4


def lsh_projection():
    """Eight hashes of four projections each, from the fixed sign table."""
    return np.stack([V.sign_projection(DIM, 32)[:, h * HASH_SIZE : (h + 1) * HASH_SIZE] for h in range(HASHES)])


LSH_SQL = f"""{PROJECT_SQL},
b as (select vec_id, h // {HASH_SIZE} as n, sum(x * p) > 1e-12::double as bit from flat join proj on d = i group by all),
codes as (select vec_id, sum(case when bit then 1 << n::int else 0 end)::bigint as code from b group by vec_id),
top as (
  select q.vec_id as query_id, k.vec_id as key_id, bit_count(xor(q.code, k.code))::int as distance,
    row_number() over (partition by q.vec_id order by bit_count(xor(q.code, k.code)), k.vec_id)::int as rank
  from codes q, codes k qualify rank <= 32)"""


def lsh_tables(spark, sf_dir):
    coded = embeddings(spark, sf_dir).select(
        "vec_id", "embedding", V.lsh_code(F.col("embedding"), lsh_projection()).alias("code")
    )
    queries = coded.select(F.col("vec_id").alias("query_id"), "code", F.col("embedding").alias("vec"))
    bank = coded.select(
        F.col("vec_id").alias("key_id"), "code", F.col("embedding").alias("key_vec"), F.reverse("embedding").alias("value_vec")
    )
    return queries, bank


@query(f"with {LSH_SQL} select query_id, key_id, distance, rank from top")
def lsh_topk(spark, sf_dir):
    queries, bank = lsh_tables(spark, sf_dir)
    return V.lsh_topk(queries, bank, HASHES, 32)


LONG_SIZE = 16


def long_projection():
    """128 signs from a fixed rule: eight sub-codes of sixteen bits."""
    d, h = np.meshgrid(np.arange(DIM), np.arange(HASHES * LONG_SIZE), indexing="ij")
    return np.where(((d + 1) * (h + 3) * 7919 + (d + 1) ** 2 * 104729 + h * h * 31) % 211 < 105, 1.0, -1.0)


@query(f"""with proj as (select d, h, case when ((d + 1) * (h + 3) * 7919 + (d + 1) * (d + 1) * 104729 + h * h * 31) % 211 < 105 then 1.0::double else -1.0 end as p
  from range({DIM}) a(d), range({HASHES * LONG_SIZE}) b(h)),
flat as (select vec_id, i, embedding[i + 1]::double as x from embeddings, range({DIM}) t(i)),
b as (select vec_id, h, sum(x * p) > 1e-12::double as bit from flat join proj on d = i group by all),
codes as (select vec_id, string_agg(bit::int::varchar, '' order by h)::bit as code from b group by vec_id)
select q.vec_id as query_id, k.vec_id as key_id, bit_count(xor(q.code, k.code))::int as distance,
  row_number() over (partition by q.vec_id order by bit_count(xor(q.code, k.code)), k.vec_id)::int as rank
from codes q, codes k qualify rank <= 32""")
def hamming_topk(spark, sf_dir):
    """Eight hashes of sixteen bits each, all of them kept: the 32 nearest of every vector."""
    coded = embeddings(spark, sf_dir).select("vec_id", H.sign_code(F.col("embedding"), long_projection(), LONG_SIZE).alias("code"))
    coded = cut_lineage(coded)
    return H.nearest_codes(coded.withColumnRenamed("vec_id", "query_id"), coded.withColumnRenamed("vec_id", "key_id"), LONG_SIZE, 32)


@query(f"""with {LSH_SQL},
s as (select t.query_id, t.key_id, sum(a.x * b.x) / 8.0::double as s from top t join flat a on a.vec_id = t.query_id
      join flat b on b.vec_id = t.key_id and b.i = a.i group by all),
e as (select *, exp(s - max(s) over (partition by query_id)) as e from s),
w as (select query_id, key_id, e / sum(e) over (partition by query_id) as w from e)
select query_id, (63 - i)::int as dim, round(sum(w * x), 5) as output from w join flat on vec_id = key_id group by query_id, i""")
def attention_read(spark, sf_dir):
    queries, bank = lsh_tables(spark, sf_dir)
    out = V.attention_read(queries, bank, HASHES, 32, DIM)
    rows = out.select("query_id", F.posexplode("output").alias("dim", "output"))
    return rows.withColumn("output", F.round("output", 5))


@query("""with k as (select event_id as seq, value / 50 as reward from events where value / 50 > 0.5 order by event_id desc limit 600),
reads as (select l_orderkey as seq, count(*) as n from lineitem group by 1)
select coalesce(sum(n), 0)::bigint as total_accesses, count(n) as active_slots, round(count(n) / 600.0::double, 6) as utilization
from k left join reads using (seq)""")
def memory_write(spark, sf_dir):
    """Events with a high reward kept in 600 slots; line items read the slot of their order."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("value") / 50).alias("reward"))
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"))
    report = V.memory_report(V.write_memory(ev, 600), reads, 600)
    return report.withColumn("utilization", F.round("utilization", 6))


# --- capsules: each vector as four sketches of sixteen numbers with four children each ------------

CAPSULE_SQL = """
flat as (select vec_id, i // 16 as k, i % 16 as j, embedding[i + 1]::double as x from embeddings, range(64) t(i)),
nextv as (select vec_id - 1 as vec_id, k, j, x as y from flat)"""


@query(f"""with {CAPSULE_SQL},
c as (select vec_id, k, sum(x * y) / greatest(sqrt(sum(x * x)) * sqrt(sum(y * y)), 1e-8::double) as c
      from flat join nextv using (vec_id, k, j) group by all)
select vec_id, round(avg(c), 6) as cos_mean, round(min(c), 6) as cos_min, round(stddev_samp(c), 6) as cos_std from c group by vec_id""")
def cosine_pairs(spark, sf_dir):
    """Each vector's sketches against those of the next vector."""
    emb = embeddings(spark, sf_dir)
    a = emb.select("vec_id", V.split_capsules(F.col("embedding"), 4, 16).alias("a"))
    b = emb.select((F.col("vec_id") - 1).alias("vec_id"), V.split_capsules(F.col("embedding"), 4, 16).alias("b"))
    rows = a.join(b, "vec_id").withColumn("s", V.capsule_similarity(F.col("a"), F.col("b")))
    return rows.select(
        "vec_id", F.round("s.mean", 6).alias("cos_mean"), F.round("s.min", 6).alias("cos_min"), F.round("s.std", 6).alias("cos_std")
    )


CHILD_SQL = f"""{CAPSULE_SQL},
child as (select vec_id, k, j // 4 as m, j % 4 as d, x from flat),
pooled as (select vec_id, k, d, avg(x) as p from child group by all),
sketch as (select vec_id, k, j as d, x as s from flat where j < 4),
err as (
  select vec_id, k, 1 - sum(p * s) / greatest(sqrt(sum(p * p)) * sqrt(sum(s * s)), 1e-8::double) as e, avg((p - s) ** 2) as c
  from pooled join sketch using (vec_id, k, d) group by all),
sums as (select vec_id, k, sqrt(sum(x * x)) as n from flat group by all)"""


def capsules(spark, sf_dir):
    """Sketches of four numbers (the head of each sixteen), their four children, and checksums."""
    v = F.col("embedding")
    children = F.transform(V.split_capsules(v, 4, 16), lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda m: F.slice(c, m * 4 + 1, F.lit(4))))
    return embeddings(spark, sf_dir).select(
        "vec_id",
        F.transform(V.split_capsules(v, 4, 16), lambda c: F.slice(c, 1, 4)).alias("sketches"),
        children.alias("children"),
        V.split_capsules(v, 4, 16).alias("checksums"),
    )


@query(f"""with {CHILD_SQL}
select e.vec_id, round(avg(e), 6) as recon_error, bool_or(e > 0.1) as expand, round(avg(c), 6) as cycle_loss,
  (count(*) filter (n > 0.5))::int as n_recon, round(count(*) filter (n > 0.5) * 0.1::double, 6) as bonus
from err e join sums using (vec_id, k) group by e.vec_id""")
def capsule_consistency(spark, sf_dir):
    rows = capsules(spark, sf_dir)
    errors = V.expansion_errors(F.col("sketches"), F.col("children"))
    marks = V.reconstructability(F.col("checksums"))
    return rows.select(
        "vec_id",
        F.round(N.mean(errors), 6).alias("recon_error"),
        V.should_expand(errors).alias("expand"),
        F.round(V.cycle_loss(F.col("sketches"), F.col("children")), 6).alias("cycle_loss"),
        marks["n"].alias("n_recon"),
        F.round(marks["bonus"], 6).alias("bonus"),
    )


@query(f"""with {CHILD_SQL},
cut as (select vec_id, vec_id % 4 as p from embeddings),
seq as (
  select vec_id, case when k < p then k else k + 3 end as o, d, s as x from sketch join cut using (vec_id) where k <> p union all
  select vec_id, p + m, d, x from child join cut using (vec_id) where k = p)
select vec_id, (o * 4 + d)::int as spot, round(x, 6) as x from seq where o < 4""")
def capsule_expand(spark, sf_dir):
    """One capsule of each vector replaced by its children, cut back to four."""
    at = F.pmod("vec_id", F.lit(4)).cast("int")
    out = capsules(spark, sf_dir).select(
        "vec_id", V.expand_capsule(F.col("sketches"), F.col("children"), at).alias("s")
    )
    rows = out.select("vec_id", F.posexplode(F.flatten("s")).alias("spot", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query("""with f as (select label, vec_id, embedding[64]::double * 3 as z, embedding from embeddings),
e as (select *, exp(z - max(z) over (partition by label)) as e from f),
p as (select *, e / sum(e) over (partition by label) as p from e),
ent as (select label, -sum(p * ln(p + 1e-8::double)) as entropy from p group by label)
select label, i::int as dim, round(sum(p * embedding[i + 1]::double), 6) as pooled, round(max(entropy), 6) as entropy
from p join ent using (label), range(64) t(i) group by label, i""")
def attention_pool(spark, sf_dir):
    """All vectors of a label pooled with weights from their last dimension."""
    feats = table(spark, sf_dir, "embeddings").select(
        "label", "embedding", (F.get("embedding", F.lit(63)).cast("double") * 3).alias("z")
    )
    out = V.attention_pool(feats, ["label"], "z", "embedding", DIM)
    rows = out.select("label", "entropy", F.posexplode("pooled").alias("dim", "pooled"))
    return rows.select("label", "dim", F.round("pooled", 6).alias("pooled"), F.round("entropy", 6).alias("entropy"))


@query("""with w as (select vec_id, i // 16 as k, (i % 16)::int as pos, embedding[i + 1]::double as w from embeddings, range(64) t(i))
select vec_id, k::int as k, pos, round(w, 6) as w, row_number() over (partition by vec_id, k order by w desc, pos)::int as rank
from w qualify rank <= 4""")
def top_children(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("i", "w"))
    weights = rows.select(
        "vec_id", F.floor(F.col("i") / 16).cast("int").alias("k"), (F.col("i") % 16).alias("pos"), F.col("w").cast("double").alias("w")
    )
    out = V.top_children(weights, ["vec_id", "k"], "w", "pos")
    return out.select("vec_id", "k", "pos", F.round("w", 6).alias("w"), "rank")


@query("""with s as (select vec_id, list_max(list_transform(embedding, lambda x: abs(x::double))) / 127 as s, embedding from embeddings),
q as (select vec_id, i, s, embedding[i + 1]::double as x, round_even(embedding[i + 1]::double / s, 0) as q from s, range(64) t(i))
select vec_id, round(max(s), 6) as scale, sum(q)::bigint as q_sum, min(q)::int as q_min, max(q)::int as q_max,
  max(abs(q * s - x)) <= max(s) * 0.5001 as close from q group by vec_id""")
def quantised_storage(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("vec_id", "embedding", V.quantise(F.col("embedding")).alias("p"))
    back = V.dequantise(F.col("p"))
    gap = F.array_max(F.zip_with(back, "embedding", lambda a, b: F.abs(a - b.cast("double"))))
    q = F.col("p.q")
    return rows.select(
        "vec_id",
        F.round("p.scale", 6).alias("scale"),
        F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x).alias("q_sum"),
        F.array_min(q).cast("int").alias("q_min"),
        F.array_max(q).cast("int").alias("q_max"),
        (gap <= F.col("p.scale") * 0.5001).alias("close"),
    )
