"""Quality rules of documents and of their hosts.

Every document is measured and fails or passes each rule. The failures are summed by host, and a
host's failure rate is shrunk toward the rate of all hosts by a beta prior whose strength is what the
spread of the hosts' rates shows beyond the chance in small hosts. A host whose shrunken rate passes
the limit for some rule is rejected with all its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.common import WORD, bounded_batches, table, written
from gridlake.plans.bounds import broadcast_if_small

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6
RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("few_words", "repeats")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words that stand in some window of ``width`` words found twice or more."""
    shifted = [words[k:] for k in range(width)]
    counts = Counter(zip(*shifted))
    if len(counts) == max(0, len(words) - width + 1):
        return 0
    covered, total = 0, 0
    for i, window in enumerate(zip(*shifted)):
        if counts[window] > 1:
            total += i + width - max(covered, i)
            covered = i + width
    return total


def measured(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measure(text):
    """Column: struct of counts of a whole text; all zero for a null or empty one."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measured(t) for t in texts], columns=MEASURES)

    return counts(text)


def prior_strength(mean: float, spread: float, n: int, hosts: int, squares: float) -> float:
    """Documents that the beta prior counts for, from the spread of the hosts' rates by moments.

    A host of n documents has a rate of variance m (1 - m) (rho + (1 - rho) / n), where rho is
    1 / (strength + 1). So of the spread, the sum of n (rate - m)^2, chance alone brings hosts - 1 times
    m (1 - m), and only what goes beyond it speaks of hosts that differ. ``squares`` is the sum of n^2. Where
    nothing goes beyond it, or every host has one document, the prior is as strong as it gets.
    """
    chance = mean * (1 - mean)
    freedom = n - squares / n - (hosts - 1) if n else 0.0
    if chance <= 0 or freedom <= 0 or spread / chance <= hosts - 1:
        return STRONGEST
    rho = (spread / chance - (hosts - 1)) / freedom
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1))


def host_verdicts(rows: DataFrame, limit: float) -> DataFrame:
    """(host, n, rate_<rule>, rejected) from rows(host, fail_<rule>); the rates are shrunk."""
    fails = [F.sum(F.col(f"fail_{r}").cast("long")).alias(f"f_{r}") for r in RULES]
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("n"), *fails))
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"f_{r}").alias(r) for r in RULES]).first()
    mean = {r: (total[r] or 0) / max(1, total["n"] or 0) for r in RULES}
    spread = [F.sum(F.col("n") * (F.col(f"f_{r}") / F.col("n") - mean[r]) ** 2).alias(r) for r in RULES]
    spreads = hosts.agg(F.count("*").alias("hosts"), F.sum(F.col("n").cast("double") ** 2).alias("squares"), *spread).first()
    for r in RULES:
        strength = prior_strength(mean[r], spreads[r] or 0.0, total["n"] or 0, spreads["hosts"], spreads["squares"] or 0.0)
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"f_{r}") + mean[r] * strength) / (F.col("n") + strength))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (F.col(f"rate_{r}") > limit)
    return hosts.select("host", "n", *[f"rate_{r}" for r in RULES], rejected.alias("rejected"))


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, host, measures, base_failed, host_rejected and kept for every row of docs(doc_id, text, host).

    A document is kept if it passes the base rules and its host isn't rejected. Null and empty texts
    have no words and fail; null hosts are one host of their own; ids may be null or repeat, and each
    row is judged by itself. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"), measure(docs["text"]).alias("__m")).select("doc_id", "host", "__m.*")
    rows = written(rows.select("*", *[F.expr(x).alias(f"fail_{r}") for r, x in RULES.items()]))
    rejected = written(host_verdicts(rows, limit).where("rejected").select("host", F.lit(True).alias("host_rejected")))
    joined = rows.join(broadcast_if_small(rejected), "host", "left")
    base = F.lit(False)
    for r in BASE:
        base = base | F.col(f"fail_{r}")
    gone = F.coalesce("host_rejected", F.lit(False))
    return joined.select("doc_id", "host", *MEASURES, base.alias("base_failed"), gone.alias("host_rejected"), (~base & ~gone).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; its source is its host."""
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *MEASURES[:-1], "base_failed", "kept")


SQL = r"""
with d as (
  select doc_id, coalesce('=' || source, '') as host, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), windows as (
  select doc_id, i, list_slice(words, i, i + 4) as w
  from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from d where len(words) >= 5)
), repeats as (
  select doc_id, count(distinct p) as n_repeat_words
  from (
    select doc_id, unnest(range(i, i + 5)) as p
    from (select doc_id, i, count(*) over (partition by doc_id, w) as c from windows)
    where c > 1
  ) group by doc_id
), lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]')
  group by doc_id
), m as (
  select d.doc_id, host, cast(len(words) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    cast(coalesce(n_lines, 0) as bigint) as n_lines
  from d left join repeats using (doc_id) left join lines using (doc_id)
), failed as (
  select *, n_words < 10 as few_words, 100 * n_repeat_words > 20 * n_words as repeated,
    2 * n_symbols > n_words as symbols, 10 * n_dup_lines > 3 * n_lines as dup_lines
  from m
), rates as (
  select host, rule, count(*) as n, sum(cast(fail as int)) as f
  from (unpivot (select host, few_words, repeated, symbols, dup_lines from failed)
        on few_words, repeated, symbols, dup_lines into name rule value fail)
  group by host, rule
), prior as (
  select rule, mean, case when mean * (1 - mean) > 0 and freedom > 0 and spread / (mean * (1 - mean)) > hosts - 1
    then least(1e6, greatest(1.0, freedom / (spread / (mean * (1 - mean)) - (hosts - 1)) - 1)) else 1e6 end as strength
  from (
    select rule, any_value(mean) as mean, sum(n * (f / n - mean) ** 2) as spread, count(*) as hosts,
      sum(n) - sum(n * n) / sum(n) - (count(*) - 1) as freedom
    from (select *, sum(f) over (partition by rule) / sum(n) over (partition by rule) as mean from rates)
    group by rule
  )
), rejected as (
  select distinct host from rates join prior using (rule)
  where (f + mean * strength) / (n + strength) > 0.5
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  few_words or repeated as base_failed,
  not (few_words or repeated) and host not in (select host from rejected) as kept
from failed
"""
