"""Queries over documents, pages, conversations and order texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import text as X
from gridlake.operators import evaluation as E
from gridlake.plans.bounds import spread
from gridlake.queries.fixtures import RAGGED, ragged, text_sql
from gridlake.queries.registry import query, table
from gridlake.sources import files as L

SPACE_RE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
FLAT = f"trim(regexp_replace(text, '{SPACE_RE}+', ' ', 'g'), ' ')"
CLEAN_SQL = f"""
flat as (select *, {FLAT} as f from documents),
clean as (select *, case when length(f) > 10000 then substr(f, 1, 10000) || '...' else f end as c from flat)"""
WORDS_SQL = f"""
word_lists as (select doc_id, case when {FLAT} = '' then []::varchar[] else string_split({FLAT}, ' ') end as ws from documents)"""


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE_RE}+', ''), '{SPACE_RE}+$', '')"


@query(f"""with {CLEAN_SQL}
select doc_id, concat_ws(' | ', nullif(c, ''), 'Category: ' || lang,
  case when n_chars > 1000 then 'Difficulty: ' || source end) as text from clean""")
def text_clean(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    difficulty = F.when(F.col("n_chars") > 1000, F.col("source"))
    return docs.select("doc_id", X.preprocess(F.col("text"), F.col("lang"), difficulty).alias("text"))


@query(f"""with {RAGGED}, g as ({text_sql('ragged')})
select doc_id, concat_ws(' | ', 'Text: ' || substr(nullif(text, ''), 1, 500),
  case when doc_id % 3 = 0 then 'Image: (' || n_chars || ', 3)' end, 'Grid: ' || substr(grid, 1, 200)) as text,
  case when doc_id % 3 = 0 then 'image' when grid is not null then 'grid' when text <> '' then 'text' end as built_as,
  case when text <> '' then 'text' when grid is not null then 'grid' when doc_id % 3 = 0 then 'image' end as encoded_as
from documents left join g on grid_id = doc_id""")
def text_unified(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    grids = ragged(spark, sf_dir)
    shape = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("("), F.col("n_chars"), F.lit(", 3)")))
    joined = docs.join(grids, docs.doc_id == grids.grid_id, "left").withColumn("image", shape)
    return joined.select(
        "doc_id",
        X.unified_text(F.col("text"), F.col("image"), F.col("grid")).alias("text"),
        X.primary_modality(X.BUILDER_PRECEDENCE).alias("built_as"),
        X.primary_modality(X.ENCODER_PRECEDENCE).alias("encoded_as"),
    )


@query(f"""with pieces as (
  select doc_id, i, substr(text, (i * 1000 + 1)::bigint, 1000) as chunk
  from documents, unnest(range((length(text) + 999) // 1000)) t(i)),
kept as (select * from pieces where regexp_replace(chunk, '{SPACE_RE}', '', 'g') <> '')
select 'text_' || doc_id || '_' || (row_number() over (partition by doc_id order by i) - 1) as sample_id,
  length(chunk)::int as n, md5(chunk) as chunk_md5 from kept""")
def text_chunks(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    rows = docs.select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"))).alias("idx", "chunk"))
    return rows.select(
        F.concat_ws("_", F.lit("text"), "doc_id", "idx").alias("sample_id"),
        F.length("chunk").alias("n"),
        F.md5("chunk").alias("chunk_md5"),
    )


@query(f"""with recursive walk(doc_id, idx, pos, n, total) as (
  select doc_id, -1, 1::bigint, 0::bigint, length(text)::bigint from documents
  union all
  select w.doc_id, w.idx + 1, w.pos + w.n, case
      when w.total - (w.pos + w.n) + 1 < 1000 then w.total - (w.pos + w.n) + 1
      else coalesce(list_max(list_filter(range(1, 1000), lambda k: d.cs[w.pos + w.n + k] = ' ')), 1000) end, w.total
  from walk w join (select doc_id, string_split(text, '') as cs from documents) d using (doc_id)
  where w.pos + w.n <= w.total)
select doc_id, idx, md5({strip_sql('substr(text, pos, n)')}) as chunk_md5
from walk join documents using (doc_id) where idx >= 0""")
def text_word_chunks(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    rows = docs.select("doc_id", F.posexplode(X.word_chunks(F.col("text"))).alias("idx", "chunk"))
    return rows.select("doc_id", "idx", F.md5("chunk").alias("chunk_md5"))


@query(f"""with recursive files as (select lang as file, string_agg(text || chr(10), '' order by doc_id) as t from documents group by lang),
walk(file, idx, pos, n, total) as (
  select file, -1::bigint, 1::bigint, 0::bigint, length(t)::bigint from files
  union all
  select w.file, w.idx + 1, w.pos + w.n, case
      when w.total - (w.pos + w.n) + 1 < 1000 then w.total - (w.pos + w.n) + 1
      when contains(substr(f.t, w.pos + w.n + 1, 999), ' ') then 1000 - position(' ' in reverse(substr(f.t, w.pos + w.n + 1, 999)))
      else 1000 end, w.total
  from walk w join files f using (file) where w.pos + w.n <= w.total)
select file, idx, md5({strip_sql('substr(t, pos, n)')}) as chunk_md5 from walk join files using (file) where idx >= 0""")
def file_word_chunks(spark, sf_dir):
    """The documents of each language as the lines of one file, which is cut block by block."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("lang").alias("file"), F.lit(0).cast("long").alias("start"), F.col("doc_id").alias("row"), F.col("text").alias("line"), F.lit(1 << 62).alias("file_size"))
    return L.chunk_words(lines).select("file", "idx", F.md5("chunk").alias("chunk_md5"))


@query(f"""with {WORDS_SQL}
select doc_id, k::int as k, array_to_string(ws[(k * len(ws)) // 4 + 1:((k + 1) * len(ws)) // 4], ' ') as part
from word_lists, range(4) t(k)""")
def text_words_k(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode(X.even_slices(F.col("text"), 4)).alias("k", "part"))


def _markers_sql() -> str:
    return " + ".join(f"contains(html, '{m}')::int" for m in X.CODE_MARKERS)


@query(f"select page_id, {_markers_sql()} as markers, {_markers_sql()} >= 2 as code from pages")
def text_code_detect(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        X.code_markers(F.col("html")).alias("markers"),
        X.looks_like_code(F.col("html")).alias("code"),
    )


@query(f"""with m as (
  select conv_id, turn, case role when 'assistant' then 'Sure:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || text
    when 'system' then 'import ' || text else text end as t from conversations)
select conv_id, turn, case when contains(t, '```python' || chr(10))
    then {strip_sql("regexp_extract(t, '(?s)```python' || chr(10) || '(.*?)```', 1)")}
  when contains(t, 'def ') or contains(t, 'import ') then {strip_sql('t')} else '' end as code from m""")
def text_code_extract(spark, sf_dir):
    """Replies fenced as code, system messages turned into imports, user messages as they are."""
    conv = table(spark, sf_dir, "conversations")
    fence = F.lit("```")
    wrapped = (
        F.when(
            F.col("role") == "assistant",
            F.concat(F.lit("Sure:\n```python\n"), F.col("text"), F.lit("\n"), fence, F.col("text")),
        )
        .when(F.col("role") == "system", F.concat(F.lit("import "), F.col("text")))
        .otherwise(F.col("text"))
    )
    return conv.select("conv_id", "turn", X.extract_code(wrapped).alias("code"))


# Six ways in which an order states its price, and what is read from each.
SAYINGS = [
    ("'The answer is ' || p || ' of 99'", "p"),
    ("'so 2 + 2 = ' || p || ', done 7'", "p"),
    ("'Therefore, x= ' || p", "p"),
    (r"'thus \boxed{' || p || '} and 5'", "p"),
    ("'12 first, #### -' || p || ' last 3'", "-p"),
    ("'no phrase ' || p || ' but 41.5'", "41.5"),
]


def _sayings_sql() -> str:
    cases = " ".join(f"when {i} then {form}" for i, (form, _) in enumerate(SAYINGS))
    return f"case (o_orderkey % 6)::int {cases} end"


ANSWER_SQL = f"""
said as (select o_orderkey, round(o_totalprice, 2) as price, printf('%.2f', o_totalprice) as p, o_orderkey % 6 as k from orders),
texts as (select o_orderkey, price, p, k, case k {' '.join(f'when {i} then {form}' for i, (form, _) in enumerate(SAYINGS))} end as t from said),
nums as (
  select *, case when k in (0, 1, 2, 3) then p::double when k = 4 then 3.0::double else 41.5::double end as answer,
    case when k in (0, 1, 2, 3) then p::double when k = 4 then -p::double else 41.5::double end as marked from texts)"""


def order_answers(spark, sf_dir):
    """Orders with a sentence that states their price, rightly or not."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    p = F.col("p")
    forms = [
        F.concat(F.lit("The answer is "), p, F.lit(" of 99")),
        F.concat(F.lit("so 2 + 2 = "), p, F.lit(", done 7")),
        F.concat(F.lit("Therefore, x= "), p),
        F.concat(F.lit("thus \\boxed{"), p, F.lit("} and 5")),
        F.concat(F.lit("12 first, #### -"), p, F.lit(" last 3")),
        F.concat(F.lit("no phrase "), p, F.lit(" but 41.5")),
    ]
    priced = orders.select(
        "o_orderkey",
        F.round("o_totalprice", 2).alias("price"),
        F.format_string("%.2f", "o_totalprice").alias("p"),
        (F.col("o_orderkey") % 6).alias("k"),
    )
    said = F.get(F.array(*forms), F.col("k").cast("int"))
    return priced.withColumn("t", said)


@query(f"with {ANSWER_SQL} select o_orderkey, round(answer, 2) as answer, round(marked, 2) as marked from nums")
def text_answer(spark, sf_dir):
    t = F.col("t")
    return order_answers(spark, sf_dir).select(
        "o_orderkey",
        F.round(X.extract_answer(t), 2).alias("answer"),
        F.round(X.extract_marked_answer(t), 2).alias("marked"),
    )


@query(f"""with {ANSWER_SQL},
ok as (select k, case when marked = floor(marked) and price = floor(price) then marked = price
  else abs(marked - price) <= 0.01::double end as hit from nums)
select k, round(avg(hit::int), 6) as accuracy, count(*) filter (hit) as correct, count(*) as total from ok group by k""")
def math_accuracy(spark, sf_dir):
    rows = order_answers(spark, sf_dir).withColumn("pred", X.extract_marked_answer(F.col("t")))
    report = E.answer_accuracy(rows, "pred", "price", ["k"])
    return report.withColumn("accuracy", F.round("accuracy", 6))


@query("""select doc_id, sha256(text || '_224_224') as content_key, left(sha256(text || '_224_224'), 2) as shard,
  case when doc_id % 5 = 0 then 'IMG:' || doc_id when doc_id % 5 = 1 then 'GRID:' || doc_id
       when doc_id % 5 = 2 then source else text end as cache_key from documents""")
def content_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = X.content_key(F.col("text"))
    kind = F.col("doc_id") % 5
    text = F.when(kind == 2, "").otherwise(F.col("text"))
    cache = X.cache_key(
        F.col("doc_id").cast("string"), kind == 0, kind == 1, text, F.col("source"), F.lit("?")
    )
    return docs.select("doc_id", key.alias("content_key"), X.key_shard(key).alias("shard"), cache.alias("cache_key"))


PATHS = [
    "data/puzzle_vqa/", "sets/MATH-V/", "raven/", "craven/", "data/ARC/", "maze/a.csv", "maze/a.json",
    "Sudoku/", "notes.md", "wikitext-2", "cifar10/", "plain-name", "local/file.bin", "tinystories/",
]


def _paths_sql() -> str:
    return "[" + ", ".join(f"'{p}'" for p in PATHS) + "]"


@query(f"""with p as (
  select page_id, url, {_paths_sql()}[(page_id % {len(PATHS)} + 1)::int] as base from pages),
q as (select page_id, case when page_id % 2 = 0 then base else regexp_extract(url, '[^/]*$') || base end as path,
             page_id % 7 = 3 as is_dir, page_id % 7 <= 3 as is_there from p)
select page_id, path, case
  when lower(path) like '%puzzlevqa%' or contains(lower(path), 'puzzle_vqa') then 'puzzlevqa'
  when lower(path) like '%math-v%' or lower(path) like '%mathv%' or contains(lower(path), 'math_vision') then 'mathv'
  when lower(path) like '%raven%' and lower(path) not like '%craven%' then 'raven'
  when lower(path) like '%arc%' then 'arc_json'
  when lower(path) like '%maze%' and lower(path) like '%.csv' then 'maze_csv'
  when lower(path) like '%sudoku%' then 'sudoku_grid'
  when lower(path) like '%.txt' or lower(path) like '%.md' or lower(path) like '%text%' or lower(path) like '%tinystories%' then 'text_file'
  when lower(path) like '%cifar%' or lower(path) like '%imagenet%' or is_dir then 'image_dir'
  when not contains(path, '/') and not is_there then 'hf' else 'local' end as kind from q""")
def source_detect(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    base = F.get(F.array(*[F.lit(p) for p in PATHS]), F.pmod("page_id", F.lit(len(PATHS))).cast("int"))
    tail = F.regexp_extract("url", "[^/]*$", 0)
    path = F.when(F.col("page_id") % 2 == 0, base).otherwise(F.concat(tail, base))
    rows = pages.select("page_id", path.alias("path"))
    day = F.col("page_id") % 7
    return rows.select("page_id", "path", X.source_type(F.col("path"), day == 3, day <= 3).alias("kind"))


NAMES = [
    "text-wikitext2", "text-tinystories", "my-tinystories-v2", "arc-aug-1000", "code-alpaca", "vision-set",
    "cifar100", "alpaca-52k", "sharegpt-en", "sudoku-extreme", "maze-30x30", "plain-name",
]


@query(f"""with p as (
  select doc_id, 'data/' || source || '/' || case when doc_id % 3 = 0 then source || '-' || lang
    else {"[" + ", ".join(f"'{n}'" for n in NAMES) + "]"}[(doc_id % {len(NAMES)} + 1)::int] end as path from documents),
b as (select doc_id, path, string_split(path, '/')[-1] as n from p)
select doc_id, path, case when n like '%text-wikitext%' then 'text' when n like '%tinystories%' then 'text-tiny'
  when n like '%arc%' then 'arc' when n like '%code%' then 'code'
  when n like '%vision%' or n like '%cifar%' or n like '%image%' then 'vision' when n like '%alpaca%' then 'alpaca'
  when n like '%sharegpt%' then 'sharegpt' when n like '%sudoku%' then 'sudoku' when n like '%maze%' then 'maze'
  else replace(n, '-', '_') end as name from b""")
def name_classify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pick = F.get(F.array(*[F.lit(n) for n in NAMES]), F.pmod("doc_id", F.lit(len(NAMES))).cast("int"))
    base = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("-", "source", "lang")).otherwise(pick)
    rows = docs.select("doc_id", F.concat_ws("/", F.lit("data"), "source", base).alias("path"))
    return rows.select("doc_id", "path", X.dataset_name(F.col("path")).alias("name"))


@query("""with n as (select vec_id, vec_id % 8 as tid, 'puzzle_' || vec_id as base from embeddings)
select vec_id, base || '_aug' || tid as augmented, base as original, tid::int as tid, base || '_distlearn' as dist from n""")
def augmented_names(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    base = F.concat(F.lit("puzzle_"), F.col("vec_id"))
    rows = emb.select("vec_id", X.augmented_name(base, F.col("vec_id") % 8).alias("augmented"), base.alias("base"))
    return rows.select(
        "vec_id",
        "augmented",
        X.original_name(F.col("augmented")).alias("original"),
        X.augmentation_id(F.col("augmented")).alias("tid"),
        X.distribution_name(F.col("base")).alias("dist"),
    )


@query("""with lines as (
  select *, upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || text || chr(10) as line from conversations),
framed as (
  select conv_id, turn, role, text, coalesce(array_to_string(list(line) over (
    partition by conv_id order by turn rows between 5 preceding and 1 preceding), ''), '') as past from lines)
select conv_id, turn, 'System: You are a helpful AI assistant.' || chr(10) || past || 'User: ' || text || chr(10) || 'Assistant:' as prompt
from framed where role = 'user'""")
def prompt_last5(spark, sf_dir):
    return X.prompts(table(spark, sf_dir, "conversations"))


CONCEPTS = 12
DECODE_SQL = f"""{WORDS_SQL},
steps as (
  select doc_id, (unnest(range(len(ws))))::int as pos, unnest(ws) as w from word_lists),
coded as (
  select doc_id, pos, length(w) as n,
    case when n % 9 = 7 then {CONCEPTS} + 2 when n % 9 = 8 then {CONCEPTS} + 3 when n > 24 then {CONCEPTS} + 1
         when n % 9 = 6 then {CONCEPTS} + 4 else n % {CONCEPTS} end as cid,
    (n % 9 >= 6 or n > 24) as control, pos % 4 = 1 as expanded from steps),
stops as (select doc_id, min(pos) as stop from coded where control and cid = {CONCEPTS} + 1 group by doc_id),
live as (select c.* from coded c left join stops s using (doc_id) where stop is null or pos < stop),
emitted as (
  select doc_id, pos, control and cid = {CONCEPTS} + 2 as merge, case
    when control and cid = {CONCEPTS} + 3 then '<THOUGHT>' when control and cid = {CONCEPTS} + 4 then '<END_THOUGHT>'
    when control then null
    when expanded and cid % 3 = 0 then ' ' when expanded and cid < 9 then 'e' || cid || 'x'
    when expanded then null when cid % 5 = 4 then '<C' || cid || '>' else 'w' || cid end as tok from live),
-- a merge takes back one space: in each run between other tokens, what is left of the spaces is the
-- height of the path of +1 (space) and -1 (merge) above its floor
runs as (
  select *, case when tok = ' ' then 1 when merge then -1 else 0 end as d,
    count(*) filter (tok <> ' ') over (partition by doc_id order by pos rows unbounded preceding) as run from emitted
  where tok is not null or merge),
path as (select *, sum(d) over (partition by doc_id, run order by pos rows unbounded preceding) as h from runs),
folded as (
  select doc_id, run, max(tok) filter (tok <> ' ') as tok, sum(d) - least(0, min(h)) as spaces from path group by doc_id, run)
select d.doc_id, coalesce(string_agg(coalesce(tok, '') || repeat(' ', spaces::int), '' order by run), '') as text
from (select distinct doc_id from steps) d left join folded f on f.doc_id = d.doc_id group by d.doc_id"""


@query(f"with {DECODE_SQL}")
def concept_decode(spark, sf_dir):
    """Document words coded by their length as concepts and control symbols, then decoded."""
    docs = spread(table(spark, sf_dir, "documents"))
    n = F.transform(X.words(F.col("text")), lambda w: F.length(w))
    rows = docs.select(F.col("doc_id").alias("seq_id"), n.alias("n"))

    def code(x):
        return (
            F.when(x % 9 == 7, CONCEPTS + 2)
            .when(x % 9 == 8, CONCEPTS + 3)
            .when(x > 24, CONCEPTS + 1)
            .when(x % 9 == 6, CONCEPTS + 4)
            .otherwise(x % CONCEPTS)
        )

    sequences = rows.select(
        "seq_id",
        F.transform("n", code).alias("concept_ids"),
        F.transform("n", lambda x: ((x % 9 >= 6) | (x > 24)).cast("int")).alias("control"),
        F.transform("n", lambda x, i: (i % 4 == 1).cast("int")).alias("expand"),
    )
    cid = F.col("concept_id")
    tokens = F.when(cid % 3 == 0, F.array(F.lit(" "))).when(
        cid < 9, F.array(F.concat(F.lit("e"), cid), F.lit("x"))
    )
    concepts = (
        spark.range(CONCEPTS)
        .select(F.col("id").cast("int").alias("concept_id"))
        .select(
            "concept_id",
            tokens.alias("tokens"),
            F.when(cid % 5 != 4, F.concat(F.lit("w"), cid)).alias("text"),
        )
    )
    out = X.decode_concepts(sequences, concepts, CONCEPTS)
    return out.select(F.col("seq_id").alias("doc_id"), "text")


@query(f"""with {WORDS_SQL},
steps as (select doc_id, (unnest(range(len(ws))))::int as pos, unnest(ws) as w from word_lists),
stops as (select doc_id, min(pos) as s from steps where length(w) > 12 group by doc_id)
select doc_id, count(*) as kept, max(pos) as last from steps left join stops using (doc_id) where s is null or pos < s group by doc_id""")
def stop_cut(spark, sf_dir):
    """Words of each document before its first word of more than twelve letters."""
    docs = spread(table(spark, sf_dir, "documents"))
    steps = docs.select("doc_id", F.posexplode(X.words(F.col("text"))).alias("pos", "w"))
    kept = X.cut_at_stop(steps, ["doc_id"], "pos", F.length("w") > 12)
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.max("pos").alias("last"))


@query(f"""with {WORDS_SQL}
select doc_id, (len(ws) % 7)::int as concept_id, list_transform(ws[1:3], lambda w: length(w)::int)[1] as first_token,
  len(ws[1:3])::int as n_tokens, coalesce(ws[1], '') as text, lang from word_lists join documents using (doc_id)""")
def expansion_json(spark, sf_dir):
    """Expansion tables written as JSON with text keys and read back with integer ones."""
    docs = table(spark, sf_dir, "documents")
    ws = X.words(F.col("text"))
    rows = docs.select("doc_id", "lang", ws.alias("ws"))
    cid = (F.size("ws") % 7).cast("int")
    lengths = F.transform(F.slice("ws", 1, 3), lambda w: F.length(w))
    written = rows.select(
        "doc_id",
        X.expansions_to_json(F.create_map(cid, lengths), F.create_map(cid, F.coalesce(F.get("ws", F.lit(0)), F.lit("")))).alias("j"),
        X.metadata_to_json(F.create_map(F.lit("lang"), F.col("lang"))).alias("m"),
    )
    back = written.select("doc_id", X.expansions_from_json(F.col("j")).alias("e"), X.metadata_from_json(F.col("m")).alias("m"))
    key = F.get(F.map_keys("e.expansions"), F.lit(0))
    tokens = F.try_element_at("e.expansions", key)
    return back.select(
        "doc_id",
        key.alias("concept_id"),
        F.get(tokens, F.lit(0)).alias("first_token"),
        F.size(tokens).alias("n_tokens"),
        F.try_element_at("e.texts", key).alias("text"),
        F.try_element_at("m", F.lit("lang")).alias("lang"),
    )
