"""Mixing to target weights with soft membership.

A linear classifier, fitted on a bounded sample of the labelled documents, gives every document a
posterior over domains, so that a document adds its tokens to each domain in part. Nonnegative rates
per document are fitted by projected gradient steps on the weighted squares of what the domains'
expected totals lack; a step needs only totals over the domains, so the documents stay where they are.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.common import LONGEST, WORD, bounded_batches, labelled_sample, scalars, slices, table, written

BUCKETS = 1 << 18
#: Labelled documents of one domain that the classifier is fitted on, at most.
SAMPLE = 1500
#: Passes over the table at most, what is left of the gradient at the end as a share of all tokens, and lengths tried for a step.
STEPS, TOLERANCE, LENGTHS = 40, 1e-6, (1.0, 0.5, 0.25, 0.125)
#: How much totals may give way for rates to stay near 1. A target of zero can't be reached while every posterior
#: is above zero, so it gives way more: documents that hardly belong to such a domain keep their rates.
GIVE, GIVE_ZERO = 1e-4, 0.05
#: A total further from its target than this share of it makes a warning.
OFF = 0.01
#: What the anchor domain gets above its own size, so that its documents keep a rate of one or more.
HEADROOM = 0.05
EPOCHS = 8
#: Least chi-square between a word's presence and a domain for the word to get a weight.
CHI_SQUARE = 15.0
EDGES = "\"'.,;:()[]"

DOMAINS = ["clean", "low_quality", "toxic"]
TARGETS = {"clean": 0.97, "low_quality": 0.03, "toxic": 0.0}


def domain_of_labels() -> Column:
    """Toxic before low quality before clean; null where a label is missing."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(BUCKETS)


def word_features(words: list[str]) -> np.ndarray:
    """Two buckets per word: the lower-cased word without punctuation, and its raw last characters."""
    out = np.empty((len(words), 2), np.int64)
    out[:, 0] = hashed([w.lower().strip(EDGES) for w in words])
    # Few words end in characters of their own.
    ends = [w[-2:] for w in words]
    places = {x: i for i, x in enumerate(set(ends))}
    out[:, 1] = hashed(["\x00" + x for x in places])[np.fromiter(map(places.__getitem__, ends), np.int64, len(ends))]
    return out


def variety(words: int, distinct: int) -> str:
    """A feature, written as no word can be, for the share of words that are new; short texts share one."""
    return f" {8 * distinct // words if words >= 20 else 'short'}"


class Words:
    """Features of words, kept for a partition."""

    MOST = 250_000

    def __init__(self):
        self.at: dict[str, int] = {}
        self.features = np.empty((0, 2), np.int64)

    def rows(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct word numbers of each text, and its number of words."""
        cut = [WORD.findall(t) if t else [] for t in texts]
        sets = [{*c, variety(len(c), len(d))} if (d := set(c)) else d for c in cut]
        if len(self.at) > self.MOST:
            self.__init__()
        fresh = list(set().union(*sets).difference(self.at))
        first = len(self.at)
        self.at.update(zip(fresh, range(first, first + len(fresh))))
        self.features = np.concatenate((self.features, word_features(fresh)))
        get = self.at.__getitem__
        return [np.fromiter(map(get, s), np.int64, len(s)) for s in sets], np.array([len(c) for c in cut], np.int64)


#: Weight of the mean over last characters beside the sum over words, and words added to its divisor.
TAIL, FEW = 10.0, 10


class Classifier:
    """Softmax over the sum of word weights and the mean of tail weights."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.weights = np.zeros((BUCKETS, len(domains)), np.float32)
        self.bias = np.zeros(len(domains))

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = 0.1, least: int = 3) -> Classifier:
        words = Words()
        words.MOST = float("inf")  # The sample is bounded, and its word numbers must stay.
        rows = [r for a, b in slices(texts) for r in words.rows(texts[a:b])[0]]
        features = words.features
        told = self.telling([np.unique(features[r]) for r in rows], labels, least)
        docs = [(f := features[r][:, 0])[told[f]] for r in rows]
        tails = [features[r][:, 1] for r in rows]
        y = np.eye(len(self.domains))[labels]
        # Balanced start; the shares of the domains are learned by the bias.
        w = self.weights.astype(np.float64)
        speed, bias_speed = np.full(w.shape, 1e-2), np.full(len(self.bias), 1e-2)
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                if not len(rows[i]):
                    continue
                z = w[docs[i]].sum(axis=0) + TAIL * w[tails[i]].sum(axis=0) / (len(tails[i]) + FEW) + self.bias
                p = np.exp(z - z.max())
                g = p / p.sum() - y[i]
                spot, count = np.unique(tails[i], return_counts=True)
                for at, step in ((docs[i], g[None, :]), (spot, TAIL * (count / (len(tails[i]) + FEW))[:, None] * g[None, :])):
                    speed[at] += step * step
                    w[at] -= rate * step / np.sqrt(speed[at])
                bias_speed += g * g
                self.bias -= rate * g / np.sqrt(bias_speed)
        self.weights = w.astype(np.float32)
        return self

    def shift(self, labels: list[str], sizes: dict[str, int]) -> None:
        """From the shares of the domains in the sample to those among all labels."""
        for k, d in enumerate(self.domains):
            self.bias[k] += np.log((sizes.get(d, 0) + 1) / (labels.count(d) + 1))

    def telling(self, present: list[np.ndarray], labels: list[int], least: int) -> np.ndarray:
        """Buckets whose presence goes with some domain beyond chance; the others would only be learned by heart."""
        k = len(self.domains)
        sizes = np.bincount(labels, minlength=k).astype(np.float64)
        both = np.array([np.bincount(np.concatenate([np.empty(0, np.int64), *[p for p, y in zip(present, labels) if y == d]]).astype(np.int64), minlength=BUCKETS) for d in range(k)], np.float64)
        seen, n = both.sum(axis=0), sizes.sum()
        best = np.zeros(BUCKETS)
        for d in range(k):
            if 0 < sizes[d] < n:
                expected = seen * sizes[d] / n
                spread = expected * (1 - sizes[d] / n) * (1 - seen / n)
                best = np.maximum(best, (both[d] - expected) ** 2 / np.maximum(spread, 1e-9))
        return (seen >= least) & (best >= CHI_SQUARE)

    def posteriors(self, words: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """One row per text, and its number of words."""
        rows, sizes = words.rows(texts)
        out = np.tile(self.bias, (len(texts), 1))
        full = [i for i, r in enumerate(rows) if len(r)]
        if full:
            flat = np.concatenate([rows[i] for i in full])
            counts = np.array([len(rows[i]) for i in full])
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            f = words.features[flat]
            out[full] += np.add.reduceat(self.weights[f[:, 0]].astype(np.float64), starts)
            out[full] += TAIL * np.add.reduceat(self.weights[f[:, 1]].astype(np.float64), starts) / (counts + FEW)[:, None]
        p = np.exp(out - out.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), sizes


def memberships(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """The rows of docs with ``__tokens`` and ``__p`` (posteriors in the order of the domains)."""

    @F.pandas_udf("tokens long, p array<double>")
    def soft(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words()
        for texts in batches:
            values, tokens, p = texts.tolist(), [], []
            for a, b in slices(values):
                q, n = model.posteriors(words, values[a:b])
                tokens += n.tolist()
                p += list(q)
            yield pd.DataFrame({"tokens": np.array(tokens, np.int64), "p": pd.Series(p, dtype=object)})

    return docs.withColumn("__m", soft(text)).withColumn("__tokens", F.col("__m.tokens")).withColumn("__p", F.col("__m.p")).drop("__m")


def rate_column(pull: np.ndarray) -> Column:
    """The rate of a row: 1, moved along its posterior by all gradient steps so far, and projected to zero or more."""
    return F.greatest(F.lit(0.0), sum((F.col("__p")[k] * float(x) for k, x in enumerate(pull)), F.lit(1.0)))


class Fit:
    """The pull of each domain on the rates, and how near the expected totals came to their goals."""

    def __init__(self, domains: list[str], goal: np.ndarray, got: np.ndarray, pull: np.ndarray, passes: int, settled: bool):
        self.domains, self.goal, self.got, self.pull, self.passes, self.settled = domains, goal, got, pull, passes, settled

    def residual(self) -> dict[str, float]:
        """What each domain has beyond its goal, as a share of all goals."""
        return dict(zip(self.domains, ((self.got - self.goal) / max(self.goal.sum(), 1e-300)).tolist()))


def measures(rows: DataFrame, pulls: list[np.ndarray], scale: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each pull, in one pass: half the weighted squares of the rates, the totals, and the Gram matrix of the rows above zero."""
    n = len(pulls[0])
    low = [(k, m) for k in range(n) for m in range(k, n)]
    sums = []
    for pull in pulls:
        rate = rate_column(pull)
        above = F.when(rate > 0, F.col("__tokens")).otherwise(0)
        sums.append(F.sum(F.col("__tokens") * rate * rate))
        sums += [F.sum(F.col("__tokens") * rate * F.col("__p")[k]) for k in range(n)]
        sums += [F.sum(above * F.col("__p")[k] * F.col("__p")[m]) for k, m in low]
    found = np.array([x or 0.0 for x in rows.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()]) / scale
    out = []
    for part in found.reshape(len(pulls), -1):
        gram = np.zeros((n, n))
        for (k, m), x in zip(low, part[1 + n :]):
            gram[k, m] = gram[m, k] = x
        out.append((part[0] / 2, part[1 : 1 + n], gram))
    return out


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], anchor: str, headroom: float, steps: int) -> Fit:
    """Rates of zero or more whose expected totals over rows(__tokens, __p) are at the targets.

    The squares of what totals lack, each weighed against the squares of how far rates move, are brought
    down by projected gradient steps. All rows move along the same n directions, so the state is one
    number a domain, and the Gram matrix of the rows above zero turns a gradient into a step. Several
    lengths of it are tried in the same pass over the table, the best one is taken, and the fit ends where
    the gradient vanishes. Domains without documents are left out.
    """
    n = len(domains)
    total = scalars(rows.agg(F.sum("__tokens").alias("n")))["n"] or 0
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    weights = weights / weights.sum()
    pull = np.zeros(n)
    if total <= 0:
        return Fit(domains, np.zeros(n), np.zeros(n), pull, 0, True)
    half, got, gram = measures(rows, [pull], total)[0]
    have, k = got, domains.index(anchor)
    goal = weights * ((1 + headroom) * have[k] / weights[k] if have[k] > 0 and weights[k] > 0 else 1.0)
    there = have > 1e-9
    give = np.where(weights > 0, GIVE, GIVE_ZERO) * np.maximum(have, 1e-9)

    def value(half: float, pull: np.ndarray) -> float:
        return half - goal @ pull + (give * pull * pull).sum() / 2

    for passes in range(1, steps + 1):
        slope = np.where(there, got + give * pull - goal, 0.0)
        if np.abs(slope).max() <= TOLERANCE:
            return Fit(domains, goal * total, got * total, pull, passes, True)
        step = np.zeros(n)
        step[there] = np.linalg.solve((gram + np.diag(give))[np.ix_(there, there)], slope[there])
        tried = [pull - length * step for length in LENGTHS]
        found = measures(rows, tried, total)
        best = min(range(len(tried)), key=lambda i: value(found[i][0], tried[i]))
        if value(found[best][0], tried[best]) >= value(half, pull):
            break
        pull, (half, got, gram) = tried[best], found[best]
    return Fit(domains, goal * total, got * total, pull, passes, bool(np.abs(np.where(there, got + give * pull - goal, 0.0)).max() <= 100 * TOLERANCE))


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domains: list[str] = DOMAINS,
    targets: dict[str, float] = TARGETS,
    anchor: str = "clean",
    headroom: float = HEADROOM,
    steps: int = STEPS,
    sample: int = SAMPLE,
    longest: int = LONGEST,
    seed: int = 10,
) -> DataFrame:
    """doc_id, n_tokens, domain, posteriors, rate, copies, selected for every row of docs(doc_id, text).

    ``labels`` has doc_id and domain; rows with a null or unknown domain and repeated rows of a
    document are left out, and at most ``sample`` documents of a domain are fitted on, of those
    the ones of up to ``longest`` characters and the first by text of rows that repeat a doc_id. A document is
    selected if its fixed uniform number is under its rate, so rates of one or more are always
    selected; copies is the rate rounded up or down by the same number. Null, empty and word-free
    texts have no tokens, weigh nothing and get the rate of their posterior. Ties between domains go to
    the first one. A warning tells if a total misses a target above zero by more than a hundredth of it; a
    target of zero is only approached. Without usable labels all posteriors are equal. A null doc_id counts as one fixed
    id, repeated rows are treated alike, an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = labelled_sample(labels.where(F.col("domain").isin(domains)), "domain", domains, sample, seed)
    rows = docs.join(F.broadcast(chosen), "doc_id").where(F.length("text") <= longest).groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["text"]))
    model = Classifier(domains)
    if len({r["label"] for r in rows}) > 1:
        model.fit([r["text"] for r in rows], [domains.index(r["label"]) for r in rows])
        sizes = {r["domain"]: r["count"] for r in labels.where(F.col("domain").isin(domains)).groupBy("domain").count().collect()}
        model.shift([r["label"] for r in rows], sizes)
    soft = written(memberships(docs, model).select("doc_id", "__tokens", "__p"))
    fit = fit_rates(soft, domains, targets, anchor, headroom, steps)
    off = [d for d, goal, got in zip(domains, fit.goal, fit.got) if goal > 0 and abs(got - goal) > OFF * goal]
    if off or not fit.settled:
        warnings.warn(f"domain totals miss their targets after {fit.passes} passes: {fit.residual()}", stacklevel=2)
    uniform = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    rated = soft.withColumn("rate", rate_column(fit.pull)).withColumn("__u", uniform)
    best = F.array_position("__p", F.array_max("__p")).cast("int")
    return rated.select(
        "doc_id",
        F.col("__tokens").alias("n_tokens"),
        F.element_at(F.array(*[F.lit(d) for d in domains]), best).alias("domain"),
        *[F.col("__p")[k].alias(f"p_{d}") for k, d in enumerate(domains)],
        "rate",
        F.floor(F.col("rate") + F.col("__u")).cast("long").alias("copies"),
        (F.col("__u") < F.col("rate")).alias("selected"),
    )


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the quality and toxic labels."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of_labels().alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for a mix of clean, low-quality and toxic tokens at the target weights."""
    return mix(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")))
