"""Toxicity by bags of subwords.

A word is the mean of the vectors of its character n-grams and of itself, a passage the mean of its
words, and a linear softmax on that mean tells toxic from clean; vectors and softmax are trained
together. Misspelled words share most of their n-grams with the words seen in training. Labels are of
whole documents, but a few words make one toxic: training first takes whole documents, and then, in
rounds, each document's passages that look most toxic so far. A document scores as its worst passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.common import LONGEST, WORD, bounded_batches, labelled_sample, slices, table

BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4, 5)
WINDOW, STRIDE = 8, 4
#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE = 1500
ROUNDS = 5
EDGES = "\"'.,;:!?()[]{}|#*$%&"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words in a row, and how many each has."""
    raw = [f"<{w.lower().strip(EDGES)}>".encode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    if not len(raw):
        return np.empty(0, np.int64), sizes
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32) + np.uint32(1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(raw)), sizes)
    place = np.arange(len(flat)) - starts[owner]
    power = np.ones(int(sizes.max()), np.uint32)
    power[1:] = np.uint32(16777619)
    power = np.multiply.accumulate(power, dtype=np.uint32)
    codes = [np.add.reduceat(flat * power[place], starts, dtype=np.uint32)]
    owners = [np.arange(len(raw))]
    for n in GRAMS:
        if len(flat) < n:
            continue
        at = np.flatnonzero(place + n <= sizes[owner])
        code = np.full(len(at), n, np.uint32)
        for k in range(n):
            code = code * np.uint32(16777619) + flat[at + k]
        codes.append(code)
        owners.append(owner[at])
    code, owner = np.concatenate(codes), np.concatenate(owners)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(2246822519)
    order = np.argsort(owner, kind="stable")
    return (code >> np.uint32(15))[order].astype(np.int64), np.bincount(owner, minlength=len(raw))


def without_echo(words: list[str]) -> list[str]:
    """The words without those equal to the one before: a stutter says no more than the word."""
    return [w for w, before in zip(words, chain([None], words)) if w != before]


def window_starts(sizes) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window in the row of all words, and its text; a text without words has none."""
    starts, owner, at = [], [], 0
    for i, n in enumerate(sizes):
        if n:
            own = np.arange(0, max(1, n - STRIDE), STRIDE)
            starts.append(own + at)
            owner.append(np.full(len(own), i))
        at += n
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(owner)


class Model:
    """Subword vectors and softmax weights; scores need only one number per subword."""

    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        self.vectors = random.normal(0, 0.3, (BUCKETS, DIMENSIONS))
        self.softmax = random.normal(0, 0.3, (DIMENSIONS, 2))
        self.bias = np.zeros(2)
        self.slope, self.shift = 1.0, 0.0
        self.speed = [np.full(x.shape, 1e-6) for x in (self.vectors, self.softmax, self.bias)]

    def step(self, words: list[np.ndarray], labels: np.ndarray, features: np.ndarray, first: np.ndarray, counts: np.ndarray, rate: float) -> None:
        """One gradient step on passages given as arrays of word numbers."""
        sizes = np.array([len(w) for w in words])
        used, inverse = np.unique(np.concatenate(words), return_inverse=True)
        n = counts[used]
        ends = np.cumsum(n)
        at = features[np.repeat(first[used] - (ends - n), n) + np.arange(ends[-1])]
        vectors = np.add.reduceat(self.vectors[at], ends - n, axis=0) / n[:, None]
        cuts = np.cumsum(sizes) - sizes
        means = np.add.reduceat(vectors[inverse], cuts, axis=0) / sizes[:, None]
        z = means @ self.softmax + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = p / p.sum(axis=1, keepdims=True)
        g[np.arange(len(labels)), labels] -= 1
        g /= len(labels)
        back = np.repeat((g @ self.softmax.T) / sizes[:, None], sizes, axis=0)
        per_word = np.stack([np.bincount(inverse, back[:, k], len(used)) for k in range(DIMENSIONS)], axis=1) / n[:, None]
        per_gram = np.repeat(per_word, n, axis=0)
        touched, where = np.unique(at, return_inverse=True)
        down = np.stack([np.bincount(where, per_gram[:, k], len(touched)) for k in range(DIMENSIONS)], axis=1)
        for x, s, i, d in ((self.vectors, self.speed[0], touched, down), (self.softmax, self.speed[1], slice(None), means.T @ g), (self.bias, self.speed[2], slice(None), g.sum(axis=0))):
            s[i] += d * d
            x[i] -= rate * d / np.sqrt(s[i])

    def freeze(self) -> None:
        self.gram_score = (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)
        self.base = float(self.bias[1] - self.bias[0])

    def word_scores(self, words: list[str]) -> np.ndarray:
        features, counts = subwords(words)
        if not len(words):
            return np.empty(0)
        return np.add.reduceat(self.gram_score[features].astype(np.float64), np.cumsum(counts) - counts) / counts

    def worst(self, scores: np.ndarray, sizes) -> np.ndarray:
        """Logit of the worst window of each text; a text without words has the bias alone."""
        out = np.full(len(sizes), self.base)
        starts, owner = window_starts(sizes)
        if len(starts):
            out = np.full(len(sizes), -np.inf)
            np.maximum.at(out, owner, self.window_logits(scores, sizes, starts, owner))
            out[np.array(sizes) == 0] = self.base
        return out

    def window_logits(self, scores: np.ndarray, sizes, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
        stops = np.minimum(starts + WINDOW, np.cumsum(sizes)[owner])
        sums = np.concatenate(([0.0], np.cumsum(scores)))
        return (sums[stops] - sums[starts]) / (stops - starts) + self.base

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -60, 60)))


def fit(texts: list[str], labels: list[int], share: float, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """Train on the texts; every fifth is held back to turn logits into probabilities at the given toxic share."""
    model = Model(seed)
    random = np.random.default_rng(seed)
    cut = [without_echo(WORD.findall(t)) for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
    features, counts = subwords(list(vocabulary))
    first = np.cumsum(counts) - counts
    docs = [np.array([vocabulary[w] for w in c], np.int64) for c in cut]
    y = np.array(labels)
    full = np.array([i for i, d in enumerate(docs) if len(d)], int)
    training, held = full[full % 5 != 0], full[full % 5 == 0]

    def train(passages: list[np.ndarray], targets: np.ndarray, epochs: int, rate: float) -> None:
        for _ in range(epochs):
            order = random.permutation(len(passages))
            for a in range(0, len(order), 128):
                part = order[a : a + 128]
                model.step([passages[i] for i in part], targets[part], features, first, counts, rate)

    # Whole documents stand for themselves through a bounded, even choice of their words' windows.
    whole, targets = [], []
    for i in training:
        starts = window_starts([len(docs[i])])[0]
        for s in random.permutation(starts)[:6]:
            whole.append(docs[i][s : s + WINDOW])
            targets.append(y[i])
    if whole:
        train(whole, np.array(targets), 2, 0.1)
    for _ in range(rounds):
        model.freeze()
        table_ = np.add.reduceat(model.gram_score[features].astype(np.float64), first) / counts
        passages, targets = [], []
        for i in training:
            starts, owner = window_starts([len(docs[i])])
            logits = model.window_logits(table_[docs[i]], [len(docs[i])], starts, owner)
            ranked = np.argsort(-logits, kind="stable")
            chosen = ranked[:2] if y[i] else np.concatenate((ranked[:3], random.permutation(ranked[3:])[:2]))
            passages += [docs[i][s : s + WINDOW] for s in starts[chosen]]
            targets += [y[i]] * len(chosen)
        if passages:
            train(passages, np.array(targets), 3, 0.1)
    model.freeze()
    if len(held) and len(set(y[held])) == 2:
        scores = model.word_scores(list(vocabulary))
        logits = model.worst(np.concatenate([scores[docs[i]] for i in held]), [len(docs[i]) for i in held])
        model.slope, model.shift = logistic(logits, y[held])
        model.shift += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic regression with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum()])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


class Scorer:
    """Scores of words, kept for a partition."""

    MOST = 250_000

    def __init__(self, model: Model):
        self.model, self.at, self.scores = model, {}, np.empty(0)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        cut = [without_echo(WORD.findall(t)) if t else [] for t in texts]
        if len(self.at) > self.MOST:
            self.at, self.scores = {}, np.empty(0)
        fresh = [w for w in set(chain.from_iterable(cut)) if w not in self.at]
        n = len(self.at)
        self.at.update(zip(fresh, range(n, n + len(fresh))))
        self.scores = np.concatenate((self.scores, self.model.word_scores(fresh)))
        sizes = [len(c) for c in cut]
        which = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, sum(sizes))
        return self.model.probability(self.model.worst(self.scores[which], sizes))


def score(text: Column, model: Model):
    """Column: probability that a text is toxic; a null, empty or word-free text has that of no words."""

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            values = texts.tolist()
            parts = [scorer.probabilities(values[a:b]) for a, b in slices(values)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return probability(text)


def train_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5, longest: int = LONGEST) -> Model | None:
    """Model of docs(doc_id, text) and labels(doc_id, toxic); at most ``sample`` documents of each class are read.

    Of those, texts longer than ``longest`` characters are left out, and of rows that repeat a doc_id only
    the first by text counts, so that the sample stays small. Labels that are null or neither 0 nor 1 are left out, and a document with both counts as toxic.
    None where there are not both classes.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = labelled_sample(known, "toxic", [0, 1], sample, seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= longest).groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["text"]))
    if len({r["label"] for r in rows}) < 2:
        return None
    total = known.agg(F.avg("toxic")).first()[0]
    model = fit([r["text"] for r in rows], [r["label"] for r in rows], min(0.99, max(0.01, total)), seed=seed)
    # Only what scores need travels with the tasks.
    del model.vectors, model.speed
    return model


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    Rows whose crc32(doc_id) has the remainder 0 are held out: their labels are never seen. Without
    labels of both classes every score is 0. A null doc_id is held out; repeated rows score alike; an
    empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    model = train_model(docs, labels.where(remainder(modulus) != 0), sample)
    p = F.lit(0.0) if model is None else score(docs["text"], model)
    scored = docs.select("doc_id", F.coalesce(remainder(modulus) == 0, F.lit(True)).alias("held_out"), p.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
