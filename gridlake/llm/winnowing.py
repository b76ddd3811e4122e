"""Document fingerprints by winnowing.

Every run of k code points has a rolling hash. Of each window of consecutive hashes the smallest one is
chosen, of equal ones the rightmost, and the chosen ones with their positions are the fingerprint. Two
texts that share a passage of ``k + window - 1`` code points share a chosen hash of that passage, and
nothing shorter than k is ever seen.

The query compares each text with its neighbour in the order of the ids. Rows are cut into ranges of the
order, one shuffle brings a range together, and the border row of each range also goes to the range that
ends before it, so no task needs more than its own rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.common import bounded_batches, table
from gridlake.plans.ordered import with_block

#: Code points of a gram, and hashes of a window: a shared passage of K + WINDOW - 1 is always found.
K, WINDOW = 20, 60
#: Windows of a long text that are worked on at once.
PIECE = 1 << 17
#: Code points of all texts in one range of the order, about.
RANGE_CHARS = 16_000_000

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xFF51AFD7ED558CCD)


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, x)))) for x in (BASE, inverse))


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread over all bits, so that the smallest hash is any gram's alike."""
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(29))


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every gram of k codes: sums of a polynomial, each the difference of two running sums."""
    n = len(codes)
    POWERS.reach(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * POWERS.down[:n], out=run[1:])
    return mixed((run[k:] - run[:-k]) * POWERS.up[k - 1 : n])


def rightmost_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Position of the smallest hash of every window, the rightmost of equal ones; ascending, each once."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    at, least, span = np.arange(n), hashes, 1
    while 2 * span <= window:
        right = least[span:] <= least[:-span]
        at, least, span = np.where(right, at[span:], at[:-span]), np.where(right, least[span:], least[:-span]), 2 * span
    rest = window - span
    if rest:
        at = np.where(least[rest:] <= least[:-rest], at[rest:], at[:-rest])
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen of a whole text, in pieces whose windows follow on each other.

    A text shorter than k is one gram; the empty text has none. Fewer hashes than a window are one window.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, n)
    chosen, places, last = [], [], -1
    for start in range(0, max(1, n - k - window + 2), PIECE):
        hashes = rolling(codes[start : start + PIECE + window + k - 2], k)
        at = rightmost_minima(hashes, window)
        if at[0] + start == last:
            at = at[1:]
        if len(at):
            chosen.append(hashes[at])
            places.append(at + start)
            last = int(at[-1]) + start
    return np.concatenate(chosen), np.concatenate(places)


def likeness(a: frozenset, b: frozenset) -> float:
    """Shared part of two sets of hashes; two empty ones are alike."""
    return len(a & b) / len(a | b) if a or b else 1.0


def joined(hashes: np.ndarray, places: np.ndarray) -> str:
    return ",".join(f"{h:016x}:{p}" for h, p in zip(hashes.tolist(), places.tolist()))


def fingerprint(text, k: int = K, window: int = WINDOW):
    """Column: array of (hash, position) of the whole text; null and empty texts have none."""

    @F.pandas_udf("array<struct<hash: long, position: long>>")
    def chosen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = (winnow(t or "", k, window) for t in texts)
            yield pd.Series([[{"hash": h, "position": p} for h, p in zip(x.view(np.int64).tolist(), y.tolist())] for x, y in found], dtype=object)

    return chosen(text)


def edited(text: str, other: str) -> str:
    """The last half of a text replaced by as much of the start of another one."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def ranges(docs: DataFrame, chars: int) -> tuple[DataFrame, int]:
    """The rows of docs(__key, __tie, text) with the range ``__to`` they are read in, and the number of ranges.

    Ranges follow the order of (__key, __tie) downwards. The first row of a range has a second copy,
    marked ``__copy``, in the range before, that of the very first range in the last one.
    """
    total = docs.agg(F.count(F.lit(1)), F.sum(F.length("text").cast("long") + 1)).first()
    if not total[0]:
        return docs.withColumn("__to", F.lit(0)).withColumn("__copy", F.lit(0)), 1
    rows = max(1, math.ceil(total[0] * min(1.0, chars / total[1])))
    cut = with_block(docs, ["__key", "__tie"], total[0], rows, "__blk")
    # One row for each range; their number is bounded by the helper that cuts them.
    first = cut.groupBy("__blk").agg(F.max(F.struct("__key", "__tie")).alias("__first"))
    found = sorted(first.collect(), key=lambda r: tuple(r["__blk"]), reverse=True)
    n = len(found)
    places = docs.sparkSession.createDataFrame([(r["__blk"], r["__first"], i, (i - 1) % n) for i, r in enumerate(found)], first.select("*", F.lit(0).alias("__own"), F.lit(0).alias("__before")).schema)
    placed = cut.join(F.broadcast(places), "__blk")
    own = F.struct(F.col("__own").alias("to"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("__before").alias("to"), F.lit(1).alias("copy"))
    twice = F.when(F.struct("__key", "__tie") == F.col("__first"), F.array(own, copy)).otherwise(F.array(own))
    spread = placed.withColumn("__at", F.explode(twice))
    return spread.select(*docs.columns, F.col("__at.to").alias("__to"), F.col("__at.copy").alias("__copy")), n


def compare_neighbours(docs: DataFrame, k: int = K, window: int = WINDOW, chars: int = RANGE_CHARS) -> DataFrame:
    """Fingerprint of every text, of the same with its last half replaced by the start of the next document, and likenesses.

    The next document is the one of the next smaller doc_id, after the last one the first; a null doc_id
    comes after all others, and rows of one doc_id follow a hash of their texts. One row per input row;
    null texts count as empty. Rows alike in id and text share a range and give the same results but for
    the last of them, whose next row is another one. A single row is its own next document. Other columns
    of docs are not looked at; an empty table gives no rows. Equal texts have equal fingerprints.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = plain.withColumn("__key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("__tie", F.xxhash64("text"))
    dealt, n = ranges(keyed, chars)
    ordered = dealt.repartition(n, "__to").sortWithinPartitions("__to", "__copy", F.desc("__key"), F.desc("__tie"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # The row before, which waits for its next one.
        for batch in batches:
            out = []
            for doc_id, text, to, copy in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["__to"].tolist(), batch["__copy"].tolist()):
                waiting = held is not None and held[2] == to and not held[3]
                if copy and not waiting:
                    held = None
                    continue
                hashes, places = winnow(text, k, window)
                grams = frozenset(hashes.tolist())
                if waiting:
                    changed = edited(held[1], text)
                    other = winnow(changed, k, window)
                    out.append((held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), held[5], joined(*other), likeness(held[4], frozenset(other[0].tolist())), likeness(held[4], grams)))
                held = (doc_id, text, to, copy, grams, joined(hashes, places))
            # Ids as objects: a null among them would turn all into floats.
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield frame.assign(doc_id=pd.array([None if x[0] is None or x[0] != x[0] else int(x[0]) for x in out], dtype="Int64"))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    # Ids travel as text beside the rows; pandas has no long column with nulls.
    sent = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "__to", "__copy")
    return sent.mapInPandas(compare, schema)


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and what they share."""
    return compare_neighbours(table(spark, sf_dir, "documents"))
