"""Language identification by Bayesian fusion of text, declared language, address and host.

A byte-trigram model per declared language gives the likelihood of the text. The declared markup
language is evidence of a stated reliability. The prior of a host is its mix of languages as the texts
alone show it, smoothed toward the mix of its address suffix, and that toward the mix of all
documents; these mixes are grouped aggregates over the whole table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.common import bounded_batches, cut_lineage, slices, table
from gridlake.plans.bounds import broadcast_if_small, small_limit

BUCKETS = 1 << 14
#: Every declared language is learned; so many of them stand in one block of the model and of the host sums.
LANGUAGES = 32
#: Dense blocks a task keeps; of a model with more of them each is spread out again when it is used.
KEPT_BLOCKS = 16
#: Likelihoods (rows x languages) worked on at once.
CELLS = 4_000_000
#: Languages whose counts a task holds before it passes them on.
HELD = 256
#: Overlapping trigrams repeat evidence; this power of the likelihood undoes that.
TEMPER = 0.3
#: Chance that a declared language is the true one.
RELIABILITY = 0.9
#: Documents' worth of evidence that the wider level gives to the narrower one.
STRENGTH = 20.0
LEAST_POSTERIOR = 0.5

LETTER = re.compile(r"[^\W\d_]")


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the lower-cased texts, and where each text starts among them."""
    parts = [f" {t.lower()} ".encode("utf-8", "replace") if t else b"" for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    if not len(raw):
        return np.empty(0, np.int64), np.zeros(len(parts) + 1, np.int64)
    raw = np.concatenate((raw, [np.uint32(0), np.uint32(0)])).astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(18)
    # The two trigrams that run over the end of a text are left out.
    keep = np.ones(len(code), bool)
    full = sizes > 0
    keep[ends[full] - 1] = False
    keep[ends[full] - 2] = False
    return code[keep].astype(np.int64), np.concatenate(([0], np.cumsum(np.where(full, sizes - 2, 0))))


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over docs(text, lang)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}

        def passed_on() -> Iterator[pd.DataFrame]:
            for lang, counts in totals.items():
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})
            totals.clear()

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                values = texts.tolist()
                for a, b in slices(values):
                    codes, _ = trigrams(values[a:b])
                    totals[lang] = totals.get(lang, 0) + np.bincount(codes, minlength=BUCKETS)
                if len(totals) >= HELD:
                    yield from passed_on()
        yield from passed_on()

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    return rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class TextModel:
    """Log likelihood of trigrams under each language, with one pseudo-count per bucket.

    ``counts`` has the buckets seen in each language and how often; blocks of ``LANGUAGES`` languages are
    spread out to dense tables in the tasks.
    """

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.counts = counts
        self.kept: dict[int, np.ndarray] = {}

    def dense(self, first: int) -> np.ndarray:
        """Log probabilities (bucket, language) of the block that starts at language ``first``."""
        if first in self.kept:
            return self.kept[first]
        part = self.counts[first : first + LANGUAGES]
        smooth = np.ones((BUCKETS, len(part)))
        for k, (bucket, n) in enumerate(part):
            smooth[bucket, k] += n
        out = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        if len(self.languages) <= KEPT_BLOCKS * LANGUAGES:
            self.kept[first] = out
        return out

    def likelihoods(self, texts: list[str | None]) -> np.ndarray:
        """One row per text, one column per language; zeros for a text without trigrams."""
        out = np.zeros((len(texts), len(self.languages)))
        for first in range(0, len(self.languages), LANGUAGES):
            dense = self.dense(first)
            for a, b in slices(texts):
                codes, starts = trigrams(texts[a:b])
                full = np.flatnonzero(np.diff(starts))
                if len(full):
                    for k in range(dense.shape[1]):
                        out[a + full, first + k] = np.add.reduceat(dense[codes, k].astype(np.float64), starts[full])
        return out

    def row_slices(self, n: int) -> Iterator[tuple[int, int]]:
        """Cuts of n rows whose likelihoods are worked on together."""
        step = max(1, CELLS // max(1, len(self.languages)))
        return ((a, min(n, a + step)) for a in range(0, n, step))


def normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def language_tag(declared: Column) -> Column:
    """The declared tag in lower case without region or script (en-US and EN are en), null where it is blank."""
    tag = F.regexp_replace(F.lower(F.trim(declared)), r"(?s)^([a-z]{2,3})[-_].*$", "$1")
    return F.when(tag != "", tag)


def fit_text_model(docs: DataFrame) -> TextModel:
    """The model of docs(text, lang); at most 16384 counts per declared language reach the driver."""
    counts = cut_lineage(count_trigrams(docs))
    per_lang = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    found = {r["lang"]: (np.array(r["bucket"], np.uint16), np.array(r["n"], np.float64)) for r in per_lang.toLocalIterator()}
    languages = sorted(found)
    return TextModel(languages, [found[x] for x in languages])


def suffix_of(url: Column) -> Column:
    """Last label of the host of an address, empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z]+://[^/?#]*?\.([a-z]+)(?::\d+)?(?:[/?#]|$)", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z]+://([^/?#:]+)", 1), F.lit(""))


def host_priors(rows: DataFrame, model: TextModel, strength: float) -> DataFrame:
    """(host, suffix, prior array) from rows(host, suffix, text)."""
    n = len(model.languages)
    names = [f"__p{k}" for k in range(min(n, LANGUAGES))]
    width = len(names)

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of what the texts of a host say, a row for each block of languages; ``__n`` is over all blocks."""
        for batch in batches:
            for a, b in model.row_slices(len(batch)):
                part = batch.iloc[a:b]
                # A text without evidence says nothing about its host.
                logs = model.likelihoods(part["text"].tolist())
                p = np.where((logs == 0).all(axis=1, keepdims=True), 0.0, normal(TEMPER * logs))
                which = part.groupby(["host", "suffix"], sort=False)
                number = which.ngroup().to_numpy()
                order = np.argsort(number, kind="stable")
                starts = np.searchsorted(number[order], np.arange(which.ngroups))
                sums = np.add.reduceat(p[order], starts, axis=0)
                keys = part.iloc[order[starts]][["host", "suffix"]].reset_index(drop=True)
                for first in range(0, n, LANGUAGES):
                    mine = sums[:, first : first + LANGUAGES]
                    mine = np.pad(mine, ((0, 0), (0, width - mine.shape[1])))
                    yield pd.concat([keys.assign(block=first // LANGUAGES, __n=sums.sum(axis=1)), pd.DataFrame(mine, columns=names)], axis=1)

    added = [F.sum(c).alias(c) for c in ["__n", *names]]
    schema = "host string, suffix string, block int, __n double, " + ", ".join(f"{c} double" for c in names)
    hosts = cut_lineage(rows.select("host", "suffix", "text").mapInPandas(alone, schema).groupBy("host", "suffix", "block").agg(*added))

    def smoothed(wide: list[Column]) -> list[Column]:
        return [(F.col(c) + strength * w) / (F.col("__n") + strength) for c, w in zip(names, wide)]

    wider = [F.col(f"__w{k}") for k in range(width)]
    overall = hosts.groupBy("block").agg(*added)
    everywhere = cut_lineage(overall.select("block", *[x.alias(f"__w{k}") for k, x in enumerate(smoothed([F.lit(1.0 / n)] * width))]))
    suffixes = hosts.groupBy("suffix", "block").agg(*added).join(F.broadcast(everywhere), "block")
    suffixes = cut_lineage(suffixes.select("suffix", "block", *[x.alias(f"__w{k}") for k, x in enumerate(smoothed(wider))]))
    joined = hosts.join(suffixes, ["suffix", "block"])
    parts = joined.select("host", "suffix", "block", F.array(*smoothed(wider)).alias("part"))
    whole = parts.groupBy("host", "suffix").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
    prior = F.slice(F.flatten(F.col("parts.part")), 1, n)
    return cut_lineage(whole.select(F.col("host").alias("__host"), F.col("suffix").alias("__suffix"), prior.alias("__prior")))


def identify(
    docs: DataFrame,
    declared: Column,
    host: Column,
    suffix: Column,
    text: str = "text",
    accepted: list[str] | None = None,
    least: float = LEAST_POSTERIOR,
    reliability: float = RELIABILITY,
    strength: float = STRENGTH,
) -> DataFrame:
    """The rows of docs with a struct ``language_id``: language, posterior, text_language, kept.

    Declared languages count by their tag (``language_tag``), however many there are. A null or blank one
    is no evidence; null hosts and suffixes count as the empty one. A text
    without a letter (null and empty texts too) has no language and is rejected, as is one whose best
    language has a posterior under ``least`` or is none of ``accepted`` (by default every language
    learned). Ties go to the language first in the alphabet. Repeated rows get equal verdicts. Where
    nothing is declared at all, no language is learned and every row is rejected.
    """
    bounded_batches(docs.sparkSession)
    asked = docs.select(
        F.col(text).alias("text"), language_tag(declared).alias("lang"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(suffix, F.lit("")).alias("suffix")
    )
    model = fit_text_model(asked)
    verdict = "language string, posterior double, text_language string, kept boolean"
    if not model.languages:
        none = F.struct(F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("kept"))
        return docs.withColumn("language_id", none)
    priors = host_priors(asked, model, strength)
    allowed = set(accepted or model.languages)
    place = {lang: k for k, lang in enumerate(model.languages)}
    n = len(place)

    @F.pandas_udf(verdict)
    def fuse(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        names = np.array(model.languages, dtype=object)
        for texts, langs, prior in batches:
            values, priors_ = texts.tolist(), prior.to_numpy()
            said = np.array([place.get(x, -1) for x in langs], int)
            best, alone, posterior = np.zeros(len(values), int), np.zeros(len(values), int), np.zeros(len(values))
            for a, b in model.row_slices(len(values)):
                logs = TEMPER * model.likelihoods(values[a:b])
                alone[a:b] = logs.argmax(axis=1)
                logs = logs + np.log(np.stack(priors_[a:b]))
                rows = np.flatnonzero(said[a:b] >= 0)
                logs[rows] += np.log((1 - reliability) / max(1, n - 1))
                logs[rows, said[a:b][rows]] += np.log(reliability) - np.log((1 - reliability) / max(1, n - 1))
                p = normal(logs)
                best[a:b] = p.argmax(axis=1)
                posterior[a:b] = p[np.arange(b - a), best[a:b]]
            lettered = np.array([bool(t and LETTER.search(t)) for t in values], bool)
            frame = pd.DataFrame({"language": names[best], "posterior": posterior, "text_language": names[alone]})
            frame.loc[~lettered, ["language", "text_language"]] = None
            frame["kept"] = lettered & (frame["posterior"].to_numpy() >= least) & np.array([x in allowed for x in frame["language"]], bool)
            yield frame

    # Marked so that a filter on the verdict doesn't evaluate it a second time.
    fuse = fuse.asNondeterministic()
    keyed = docs.withColumn("__host", F.coalesce(host, F.lit(""))).withColumn("__suffix", F.coalesce(suffix, F.lit(""))).withColumn("__declared", language_tag(declared))
    # The limit is on rows of one block of languages.
    limit = max(1, small_limit(docs) * LANGUAGES // max(n, LANGUAGES))
    joined = keyed.join(broadcast_if_small(priors, limit), ["__host", "__suffix"])
    return joined.withColumn("language_id", fuse(text, "__declared", "__prior")).select(*[docs[c] for c in docs.columns if c != "language_id"], "language_id")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents: the lang column is what they declare, the source their host; they have no address."""
    return identify(docs, F.col("lang"), F.col("source"), F.lit(""))


def identify_pages(pages: DataFrame) -> DataFrame:
    """Raw pages: the html tag declares a language, the url has host and suffix, tags are cut from the text."""
    body = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    lang = F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1)
    read = pages.withColumn("__body", body)
    found = identify(read, F.when(lang != "", F.lower(lang)), host_of(F.col("url")), suffix_of(F.col("url")), text="__body")
    return found.drop("__body")


def language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and verdict of every raw page, from its text, markup, address suffix and host; one row per input row."""
    return identify_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", host_of(F.col("url")).alias("host"), suffix_of(F.col("url")).alias("suffix"), "language_id.*")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and verdict of every document; one row per input row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = identify_documents(docs)
    return found.select("doc_id", F.col("lang").alias("declared"), "source", "language_id.*")
