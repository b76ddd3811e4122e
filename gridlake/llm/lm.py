"""Language-model scoring by online logistic context mixing.

Every occurrence of a token is coded bit by bit in the context of the tokens before it. The frequent
training tokens have a Huffman code; any other token is coded as its first byte there and then spelled,
as its bytes and an end mark. For each bit of the code, the counts of the tree and hashed contexts (the
token before, the two before) predict it from the token stream of the training texts; a gate picks the
weights that mix the predictions in the logistic domain, weights that are learned online over that
stream, and a last table refines the mixed probability by what really followed it. Spelling works alike
with the last bytes of the token as contexts, counted over the distinct training tokens; the token's
share of the rare ones is mixed in with one fitted weight.

The corpus is cut into chunks of texts. A chunk sends each distinct token once to the corpus counts and
gets its code, count and spelling back, so spelling is worked out once per distinct token; then the
tables are counted, the weights learned and the texts scored over the chunks, token after token.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.common import bounded_batches, scalars, table, written

CHUNK_CHARS = 32_000_000
ORDERS = (1, 2, 3, 5)
SLOT_BITS = 18
BLOCK = 4096
ONLINE_WORDS = 1_000
PACK_ROWS = 500_000
#: Bit position, and how often the longest context was seen: never, below 4, below 32, more.
GATES = 8 * 4
REFINE_STEPS = 33
RATE = 0.03

#: Most tokens that have a code as wholes; with two training occurrences at least.
VOCABULARY = 1 << 14
#: Slots per order of the token contexts: about one per training token within these bounds of memory.
LEAST_BITS, MOST_BITS = 16, 22
TOKEN_ORDERS = 2
TOKEN_BLOCK = 1 << 16
#: Depth in the code, and how often either context was seen: never, below 4, below 32, more.
TOKEN_GATES = 4 * 4 * 4
#: Nodes of the code, the most frequent first, that have a row of their own in the refinement table.
TOKEN_KEYS = 256
SLICE_TOKENS, ONLINE_TOKENS = 4_000, 4_000
#: Most that is kept of the counts of a slot.
FULL = 255
#: Chunks whose counts a task adds up before they travel.
COUNT_CHUNKS = 8
#: Stands for the tokens before a text.
START = -(1 << 31)

NODE = np.array([[(1 << b) | (byte >> (8 - b)) for b in range(8)] for byte in range(256)], np.uint32)
BIT = np.array([[(byte >> (7 - b)) & 1 for b in range(8)] for byte in range(256)], np.float32)


def is_held_out(doc_id: int | None) -> bool:
    """Ids whose CRC-32 leaves the remainder 2; rows without an id aren't learned from either."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def packed_places(which: np.ndarray) -> bytes:
    """Places plane by plane of their bytes, compressed; most are small."""
    return pa.Codec("zstd").compress(which.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unpacked_places(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


class Chunk:
    """Documents of a chunk, its distinct tokens with training counts, and who has which."""

    def __init__(self):
        self.ids, self.words, self.sizes, self.bytes, self.chars = [], [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        lowered = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(lowered)
        words, doc = parts.flatten(), np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy())
        # White space at either end leaves an empty part there.
        kept = pc.binary_length(words).to_numpy() > 0
        self.words.append(words.filter(pa.array(kept)))
        self.sizes.append(np.bincount(doc[kept], minlength=len(parts)) + 1)
        self.ids.append(ids)
        self.bytes.append(pc.binary_length(lowered).to_numpy())

    def row(self, number: int) -> pa.RecordBatch:
        """The chunk as one row; the end token comes last among the distinct ones."""
        sizes, ids = np.concatenate(self.sizes).astype(np.int64), pa.concat_arrays(self.ids)
        words, self.words = pa.concat_arrays(self.words), []
        coded = words.dictionary_encode()
        del words
        end = len(coded.dictionary)
        which = np.full(sizes.sum(), end, np.int32)
        inner = np.ones(len(which), bool)
        inner[np.cumsum(sizes) - 1] = False
        which[inner] = coded.indices.to_numpy()
        held = np.array([is_held_out(i) for i in ids.to_pylist()], bool)
        counts = np.bincount(which[np.repeat(~held, sizes)], minlength=end + 1)
        lists = {"ids": ids, "sizes": sizes, "held": held, "bytes": np.concatenate(self.bytes).astype(np.int64)}
        rows = {"chunk": pa.array([number])} | {k: whole_list(pa.array(v)) for k, v in lists.items()} | {"which": pa.array([packed_places(which)])}
        rows["words"] = whole_list(pa.concat_arrays([coded.dictionary, pa.array([""], coded.dictionary.type)]))
        return pa.RecordBatch.from_pydict(rows | {"counts": whole_list(pa.array(counts))})


def whole_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def chunks_of(docs: DataFrame, chars: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        chunk = Chunk()
        for batch in batches:
            ids, texts = batch.column("doc_id"), pc.fill_null(batch.column("text"), "")
            ends, start = np.cumsum(pc.utf8_length(texts).to_numpy(), dtype=np.int64), 0
            while start < len(texts):
                before = ends[start - 1] if start else 0
                stop = min(len(texts), int(np.searchsorted(ends, before + chars - chunk.chars)) + 1)
                chunk.add(ids.slice(start, stop - start), texts.slice(start, stop - start))
                chunk.chars += int(ends[stop - 1] - before)
                start = stop
                if chunk.chars >= chars:
                    yield chunk.row(number)
                    chunk, number = Chunk(), number + 1
        if chunk.ids:
            yield chunk.row(number)

    schema = (
        "chunk long, ids array<long>, sizes array<long>, held array<boolean>, bytes array<long>, which binary, "
        "words array<string>, counts array<long>"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, schema)


class Bits:
    """The bits of a batch of tokens, and the slot of each bit for each order."""

    def __init__(self, words: list[str]):
        raw = [w.encode("utf-8", "replace") + b" " for w in words]
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(self.sizes)
        place = np.arange(len(flat)) - np.repeat(ends - self.sizes, self.sizes)
        node = NODE[flat]
        self.bit = BIT[flat]
        self.before = np.where(place > 0, np.concatenate(([0], flat[:-1])), 0).astype(np.int64)
        self.slots = []
        context, done = np.full(len(flat), 2166136261, np.uint32), 0
        for order in ORDERS:
            for k in range(done + 1, order + 1):
                earlier = np.zeros(len(flat), np.uint32)
                earlier[k:] = flat[:-k] if len(flat) > k else 0
                context = (context ^ np.where(place >= k, earlier, 256)) * np.uint32(16777619)
            done = order
            mixed = (context * np.uint32(2654435761) + np.uint32(order))[:, None] ^ (node * np.uint32(0x9E3779B1))
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)
            self.slots.append((mixed >> np.uint32(32 - SLOT_BITS)).astype(np.int64))

    def per_word(self, values: np.ndarray) -> np.ndarray:
        """Sums over the bits of each token."""
        return np.add.reduceat(values.sum(axis=1, dtype=np.float64), np.cumsum(self.sizes) - self.sizes)


def batched(words: list[str], size: int) -> Iterator[list[str]]:
    for a in range(0, len(words), size):
        yield words[a : a + size]


def count_contexts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per order and slot, how many bits were seen and how many were set; of a fixed size at any input."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((len(ORDERS), 2 << SLOT_BITS), np.uint32)
        for batch in batches:
            for part in batched(batch["word"].tolist(), ONLINE_WORDS):
                bits = Bits(part)
                bit = bits.bit.astype(np.int64)
                for k, slot in enumerate(bits.slots):
                    slot *= 2
                    slot += bit
                    np.add.at(both[k], slot.ravel(), np.uint32(1))
        ones = both[:, 1::2].astype(np.float32)
        seen = (both[:, 1::2] + both[:, ::2]).astype(np.float32)
        rows = []
        for k in range(len(ORDERS)):
            for b in range(0, 1 << SLOT_BITS, BLOCK):
                if seen[k, b : b + BLOCK].any():
                    rows.append((k * (1 << SLOT_BITS) + b, seen[k, b : b + BLOCK].tobytes(), ones[k, b : b + BLOCK].tobytes()))
        yield pd.DataFrame(rows, columns=["block", "seen", "ones"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = [sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group[c]).astype(np.float32) for c in ("seen", "ones")]
        return pd.DataFrame({"block": [group["block"].iloc[0]], "seen": [total[0].tobytes()], "ones": [total[1].tobytes()]})

    schema = "block int, seen binary, ones binary"
    parts = words.select("word").mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema)
    seen, ones = np.zeros((2, len(ORDERS) << SLOT_BITS), np.float32)
    for r in parts.collect():
        seen[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["seen"], np.float32)
        ones[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["ones"], np.float32)
    return seen.reshape(len(ORDERS), -1), ones.reshape(len(ORDERS), -1)


def picked(values: np.ndarray, at: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """``values[at]`` for places that are known to exist, which needn't be checked one by one."""
    return values.take(at, out=out, mode="clip")


class Mixing:
    """Mixes stretched predictions; weights by gate, then a refinement by key and probability."""

    def __init__(self, start: list[float], gates: int, keys: int):
        self.weights = np.tile(np.array(start, np.float32), (gates, 1))
        self.refined = np.zeros((2, keys * REFINE_STEPS))

    def fork(self) -> Mixing:
        """A copy that learns on its own; counts are shared."""
        own = copy.copy(self)
        own.weights, own.refined = self.weights.copy(), self.refined.copy()
        own.speed = np.full(own.weights.shape, 1e-4)
        return own

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z, weights = np.zeros(gate.shape, np.float32), np.ascontiguousarray(self.weights.T)
        for k in range(len(x)):
            z += picked(weights[k], gate) * x[k]
        return np.clip(z, -12, 12, out=z)

    def refine_at(self, z: np.ndarray, row: np.ndarray) -> np.ndarray:
        step = np.rint((np.clip(z, -8, 8) + 8) * ((REFINE_STEPS - 1) / 16)).astype(np.int64)
        return row * REFINE_STEPS + step

    def update(self, x: np.ndarray, gate: np.ndarray, z: np.ndarray, key: np.ndarray, bit: np.ndarray) -> None:
        """One online step over the bits of a small batch."""
        flat, gates = gate.ravel(), len(self.weights)
        followed = np.bincount((key * 2 + bit.astype(np.int64)).ravel(), minlength=2 * self.refined.shape[1]).reshape(-1, 2)
        self.refined[0] += followed[:, 0] + followed[:, 1]
        self.refined[1] += followed[:, 1]
        miss = (bit - 1 / (1 + np.exp(-z))).ravel()
        each = np.maximum(np.bincount(flat, minlength=gates), 1)
        for k in range(len(x)):
            step = np.bincount(flat, miss * x[k].ravel(), gates) / each
            self.speed[:, k] += step * step
            self.weights[:, k] += (RATE * step / np.sqrt(self.speed[:, k])).astype(np.float32)

    def finish(self) -> None:
        """The refined probability of each key: what followed it, with a prior at the key's own value."""
        middle = np.tile(np.linspace(-8, 8, REFINE_STEPS), self.refined.shape[1] // REFINE_STEPS)
        prior = 1 / (1 + np.exp(-middle))
        self.table = ((self.refined[1] + 20 * prior) / (self.refined[0] + 20)).astype(np.float32)

    def chance(self, z: np.ndarray, key: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The probability of each bit that stands there."""
        p = (1 / (1 + np.exp(-z)) + picked(self.table, key)) / 2
        return np.subtract(1, p, out=p, where=bit == 0)


class Mixer(Mixing):
    """Mixes the orders' predictions of the bits of a spelling, refined by previous byte."""

    def __init__(self, seen: np.ndarray, ones: np.ndarray):
        super().__init__([1.0 / len(ORDERS)] * len(ORDERS) + [0.0], GATES, 256)
        self.seen, self.ones = seen, ones
        self.known = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def inputs(self, bits: Bits, own: float) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (order, byte, bit) and gates; ``own`` takes a token's own counts out."""
        x = np.empty((len(ORDERS) + 1, *bits.bit.shape), np.float32)
        if not own and self.known is None:  # once per process
            self.known = np.log((self.ones + np.float32(0.3)) / (np.maximum(self.seen - self.ones, 0) + np.float32(0.3)))
        for k, slot in enumerate(bits.slots):
            if not own:
                picked(self.known[k], slot, x[k])
                continue
            n, one = picked(self.seen[k], slot), picked(self.ones[k], slot)
            n -= np.float32(own)
            one -= bits.bit if own == 1 else np.float32(own) * bits.bit
            np.maximum(one, 0, out=one)
            np.maximum(n, 0, out=n)
            rest = np.maximum(n - one, 0)
            rest += np.float32(0.3)
            one += np.float32(0.3)
            one /= rest
            np.log(one, out=x[k])
        if not own:
            n = picked(self.seen[-1], bits.slots[-1])
        x[-1] = 0.3
        gate = ((n >= 0.5).astype(np.int64) + (n >= 4) + (n >= 32)) * 8 + np.arange(8)[None, :]
        return x, gate

    def refine_key(self, z: np.ndarray, bits: Bits) -> np.ndarray:
        return self.refine_at(z, bits.before[:, None])

    def learn(self, words: list[str]) -> None:
        """One online pass over training tokens, a small batch at a time."""
        self.speed = np.full(self.weights.shape, 1e-4)
        for part in batched(words, ONLINE_WORDS):
            bits = Bits(part)
            x, gate = self.inputs(bits, 1.0)
            z = self.mix(x, gate)
            self.update(x, gate, z, self.refine_key(z, bits), bits.bit)

    def log10(self, words: list[str], first: bool = True) -> np.ndarray:
        """log10 probability of each token's bytes and end mark; without its first byte if not ``first``."""
        out = []
        for part in batched(words, ONLINE_WORDS):
            bits = Bits(part)
            z = self.mix(*self.inputs(bits, 0.0))
            each = np.log10(self.chance(z, self.refine_key(z, bits), bits.bit))
            if not first:
                each[np.cumsum(bits.sizes) - bits.sizes] = 0
            out.append(bits.per_word(each))
        return np.concatenate(out) if out else np.empty(0)


def learned(rows: DataFrame, mixer: Mixing, learn: Callable[[Mixing, pd.DataFrame], int]) -> None:
    """Weights learned online in every task, averaged by the tokens that ``learn`` returns, and refinements added up."""
    model = rows.sparkSession.sparkContext.broadcast(mixer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local, n = model.value.fork(), 0
        for batch in batches:
            n += learn(local, batch)
        if n:
            values = np.concatenate((local.weights.ravel() * n, [n], local.refined.ravel()))
            at = np.flatnonzero(values)
            yield pd.DataFrame({"slot": at, "value": values[at]})

    sums = rows.mapInPandas(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    flat = np.zeros(mixer.weights.size + 1 + mixer.refined.size)
    for r in sums.collect():
        flat[r["slot"]] = r["value"]
    model.destroy()
    n = flat[mixer.weights.size]
    if n:
        mixer.weights = (flat[: mixer.weights.size] / n).reshape(mixer.weights.shape).astype(np.float32)
        mixer.refined = flat[mixer.weights.size + 1 :].reshape(mixer.refined.shape)
    mixer.finish()


def train_mixer(words: DataFrame) -> Mixer:
    """Counts over all distinct training tokens, then weights learned from them."""
    mixer = Mixer(*count_contexts(words))

    def learn(local: Mixer, batch: pd.DataFrame) -> int:
        local.learn(batch["word"].tolist())
        return len(batch)

    learned(words.select("word"), mixer, learn)
    return mixer


def code_words(words: DataFrame, mixer: Mixer, whole: list[str]) -> DataFrame:
    """(word, c, spelled, code) of every token.

    ``code`` is the place in ``whole``, or else below zero: ~(23 bits of a hash, first byte). ``spelled`` is the
    model's log10 probability of the spelling after the first byte, of tokens that are spelled.
    """
    model = words.sparkSession.sparkContext.broadcast((mixer, {w: i for i, w in enumerate(whole)}))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer, places = model.value
        for batch in batches:
            code = np.fromiter((places.get(w, -1) for w in batch["word"]), np.int32, len(batch))
            spelled, rest = np.zeros(len(batch)), np.flatnonzero(code < 0)
            names = batch["word"].iloc[rest].tolist()
            spelled[rest] = mixer.log10(names, first=False)
            raw = [w.encode("utf-8", "replace") + b" " for w in names]
            code[rest] = [~((zlib.crc32(x) & 0x7FFFFF) << 8 | x[0]) for x in raw]
            yield batch.assign(spelled=spelled, code=code)

    return words.select("word", "c").mapInPandas(spell, "word string, c long, spelled double, code int")


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3))).astype(np.float32)


def readings() -> tuple[np.ndarray, np.ndarray]:
    """Stretched prediction, and how often seen (0 to 3), by 2^16 i + zeros + 256 ones.

    With i of 0 and 1 a bit of that value takes its own count out, unless counts were scaled down; with 2 none does.
    """
    zeros, ones = np.tile(np.arange(256), 256), np.repeat(np.arange(256), 256)
    own = (zeros + ones < FULL - 1).astype(np.int64)
    zeros, ones = np.concatenate((np.maximum(zeros - own, 0), zeros, zeros)), np.concatenate((ones, np.maximum(ones - own, 0), ones))
    return stretched(zeros, ones), np.digitize(zeros + ones, (0.5, 4, 32)).astype(np.uint8)


class Codes:
    """A Huffman code of symbols, every path laid out as the nodes it goes through and the bits it takes.

    Nodes are numbered from the root by falling weight. The counts below a node predict its bit. Hashed
    contexts keep the up to fifteen nodes of four levels side by side, so a path touches few places.
    """

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        leaves, made = counts[order].tolist(), []
        up, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        i = j = 0
        for node in range(n - 1):
            weight = 0
            for bit in (1, 0):
                if j >= len(made) or i < n and leaves[i] <= made[j]:
                    child, w, i = int(order[i]), leaves[i], i + 1
                else:
                    child, w, j = n + j, made[j], j + 1
                up[child], side[child], weight = n + node, bit, weight + w
            made.append(weight)
        inner = n - 2 - np.arange(n - 1)  # the root was made last
        depth = np.zeros(2 * n - 1, np.int64)
        for node in range(2 * n - 3, n - 1, -1):
            depth[node] = depth[up[node]] + 1
        depth[:n] = depth[up[:n]] + 1
        self.length = depth[:n].astype(np.int32)
        self.offset = np.cumsum(depth[:n]) - depth[:n]
        self.seen, self.ones = np.zeros(n - 1, np.float32), np.zeros(n - 1, np.float32)
        self.seen[inner] = made
        weight = np.concatenate((counts, made))
        ones = np.flatnonzero(side)
        self.ones[inner[up[ones] - n]] = weight[ones]
        size = int(depth[:n].sum())
        self.node, self.bit = np.zeros(size, np.int32), np.zeros(size, np.float32)
        at, now, left = self.offset + depth[:n] - 1, np.arange(n), np.arange(n)
        while len(left):
            self.node[at[left]], self.bit[at[left]] = inner[up[now[left]] - n], side[now[left]]
            at[left] -= 1
            now[left] = up[now[left]]
            left = left[at[left] >= self.offset[left]]
        level = np.arange(size) - np.repeat(self.offset, self.length)
        self.anchor = (self.node[np.arange(size) - level % 4].astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        within = np.ones(size, np.int64)
        for back in (3, 2, 1):
            earlier = np.flatnonzero(level % 4 >= back)
            within[earlier] = within[earlier] * 2 + self.bit[earlier - back].astype(np.int64)
        key = np.minimum(self.node, TOKEN_KEYS - 1)
        self.facts = (self.bit.astype(np.int64) | within << 1 | np.digitize(level, (1, 4, 8)) << 5 | key << 7).astype(np.uint16)
        seen, one = self.seen[self.node], self.ones[self.node]
        self.stretched = stretched(seen - one, one)
        one = np.maximum(one - self.bit, 0)
        self.stretched_own = stretched(np.maximum(seen - 1 - one, 0), one)
        self.counts = counts

    def __reduce__(self):
        return Codes, (self.counts,)


class Path:
    """The bits of a slice of tokens, and the slot of each bit for each context."""

    def __init__(self, codes: Codes, symbols: np.ndarray, contexts: list[np.ndarray], slot_bits: int):
        sizes = codes.length[symbols]
        ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = ends - sizes
        self.at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(codes.offset[symbols] - self.starts, sizes)
        self.facts = picked(codes.facts, self.at)
        self.bit = self.facts & 1
        anchor, within = picked(codes.anchor, self.at), self.facts >> 1 & 15
        self.slots = []
        for context in contexts:
            mixed = np.repeat(context, sizes)
            mixed ^= anchor
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(2246822519)
            mixed >>= np.uint32(36 - slot_bits)
            mixed <<= np.uint32(4)
            mixed |= within
            self.slots.append(mixed.astype(np.int64))


class Stream:
    """The tokens of a chunk one after another: symbols of the code, and hashes of the one and the two before."""

    def __init__(self, row: pd.Series, whole: int):
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.which = unpacked_places(row["which"], int(self.sizes.sum()))
        self.held = np.asarray(row["held"], bool)
        code = np.frombuffer(row["code"], np.int32)
        token = code[self.which]
        self.symbol = np.where(code >= 0, code, whole + (~code & 255)).astype(np.uint16)[self.which]
        before = self.shifted(token)
        self.one = before.view(np.uint32) * np.uint32(0x85EBCA6B) + np.uint32(1)
        self.one ^= self.one >> np.uint32(13)
        self.two = (self.one + np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35)
        self.two ^= self.shifted(before).view(np.uint32) * np.uint32(0x165667B1)
        self.two ^= self.two >> np.uint32(16)

    def shifted(self, tokens: np.ndarray) -> np.ndarray:
        """What stands before each token in its text."""
        out = np.empty_like(tokens)
        out[1:] = tokens[:-1]
        out[self.starts] = START
        return out

    def slices(self, size: int, training: bool) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """(symbols, contexts) of slices of the tokens, of all or of those to learn from."""
        keep = np.repeat(~self.held, self.sizes) if training and self.held.any() else None
        for a in range(0, len(self.symbol), size):
            parts = [x[a : a + size] for x in (self.symbol, self.one, self.two)]
            if keep is not None:
                parts = [x[keep[a : a + size]] for x in parts]
            if len(parts[0]):
                yield parts[0], parts[1:]


class TokenMixer(Mixing):
    """Mixes the predictions of the bits of tokens by the code's tree, the token before and the two before."""

    def __init__(self, codes: Codes, whole: int, counts: np.ndarray):
        """``counts``: per order and slot, how many bits were not set, and 256 times how many were."""
        super().__init__([0.4, 0.3, 0.3, 0.0], TOKEN_GATES, TOKEN_KEYS)
        self.codes, self.whole, self.counts = codes, whole, counts
        self.slot_bits = counts.shape[1].bit_length() - 1
        self.reading, self.often = readings()

    def path(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> Path:
        return Path(self.codes, symbols, contexts, self.slot_bits)

    def inputs(self, path: Path, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (order, bit) and gates; ``own`` takes a token's own counts out."""
        x = np.empty((TOKEN_ORDERS + 2, len(path.bit)), np.float32)
        picked(self.codes.stretched_own if own else self.codes.stretched, path.at, x[0])
        x[-1] = 0.3
        part = path.bit.astype(np.int64) << 16 if own else np.int64(2 << 16)
        gate = (path.facts >> 5 & 3).astype(np.int64)
        for k, slot in enumerate(path.slots):
            read = picked(self.counts[k], slot) + part
            picked(self.reading, read, x[k + 1])
            gate <<= 2
            gate |= picked(self.often, read)
        return x, gate

    def refine_key(self, z: np.ndarray, path: Path) -> np.ndarray:
        return self.refine_at(z, path.facts >> 7)

    def learn(self, stream: Stream) -> int:
        """One online pass over the training tokens of a chunk in their order, a small batch at a time."""
        n = 0
        for symbols, contexts in stream.slices(ONLINE_TOKENS, training=True):
            path = self.path(symbols, contexts)
            x, gate = self.inputs(path, own=True)
            z = self.mix(x, gate)
            self.update(x, gate, z, self.refine_key(z, path), path.bit)
            n += len(symbols)
        return n

    def log10(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each symbol after the tokens before it."""
        path = self.path(symbols, contexts)
        z = self.mix(*self.inputs(path, own=False))
        return np.add.reduceat(np.log10(self.chance(z, self.refine_key(z, path), path.bit)), path.starts, dtype=np.float64)


def count_tokens(chunks: DataFrame, codes: Codes, whole: int, slot_bits: int) -> np.ndarray:
    """Per order and slot, how many bits were not set, and 256 times how many were, over the training tokens of all chunks.

    The two are scaled down together where they exceed ``FULL``. A task adds up a few chunks before its tables travel.
    """
    code = chunks.sparkSession.sparkContext.broadcast(codes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((TOKEN_ORDERS, 2 << slot_bits), np.uint32)
        for batch in batches:
            for _, row in batch.iterrows():
                for symbols, contexts in Stream(row, whole).slices(SLICE_TOKENS, training=True):
                    path = Path(code.value, symbols, contexts, slot_bits)
                    for k, slot in enumerate(path.slots):
                        slot *= 2
                        slot += path.bit
                        np.add.at(both[k], slot, np.uint32(1))
        flat = both.reshape(-1, 2 * TOKEN_BLOCK)
        for i, block in enumerate(flat):
            if block.any():
                # Plane by plane, since most counts are small.
                yield pd.DataFrame({"block": [i], "counts": [pa.Codec("zstd").compress(block.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((TOKEN_BLOCK, 2), np.float64)
        for blob in group["counts"]:
            planes = np.frombuffer(pa.Codec("zstd").decompress(blob, 8 * TOKEN_BLOCK, asbytes=True), np.uint8).reshape(4, -1)
            total += np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1, 2)
        total *= np.minimum(1, FULL / np.maximum(total.sum(axis=1), 1))[:, None]
        return pd.DataFrame({"block": [group["block"].iloc[0]], "counts": [np.rint(total).astype(np.uint8).tobytes()]})

    cores = chunks.sparkSession.sparkContext.defaultParallelism
    few = chunks.coalesce(max(cores, -(-chunks.rdd.getNumPartitions() // COUNT_CHUNKS)))
    schema = "block int, counts binary"
    parts = few.select("sizes", "held", "which", "code").mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema)
    both = np.zeros(TOKEN_ORDERS << slot_bits, np.uint16)
    for r in parts.collect():
        both[r["block"] * TOKEN_BLOCK : (r["block"] + 1) * TOKEN_BLOCK] = np.frombuffer(r["counts"], "<u2")
    code.destroy()
    return both.reshape(TOKEN_ORDERS, -1)


def train_tokens(chunks: DataFrame, codes: Codes, whole: int, slot_bits: int) -> TokenMixer:
    """Counts over the training tokens of all chunks, then weights learned online over them in every task."""
    mixer = TokenMixer(codes, whole, count_tokens(chunks, codes, whole, slot_bits))

    def learn(local: TokenMixer, batch: pd.DataFrame) -> int:
        return sum(local.learn(Stream(row, whole)) for _, row in batch.iterrows())

    learned(chunks.select("sizes", "held", "which", "code"), mixer, learn)
    return mixer


def packed_by_chunk(values: DataFrame) -> DataFrame:
    """(chunk, at, c, spelled, code) with the values of a task's rows of one chunk as arrays in binary columns."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and len(batch):
                kept.append(batch)
                n += len(batch)
            if kept and (batch is None or n >= PACK_ROWS):
                rows = pd.concat(kept).sort_values("chunk", kind="stable")
                chunk = rows["chunk"].to_numpy()
                cuts = np.flatnonzero(np.diff(chunk)) + 1
                parts = [np.split(rows[k].to_numpy(t), cuts) for k, t in (("at", np.int32), ("c", np.int64), ("spelled", np.float32), ("code", np.int32))]
                blobs = [[x.tobytes() for x in p] for p in parts]
                yield pd.DataFrame({"chunk": chunk[np.concatenate(([0], cuts))], "at": blobs[0], "c": blobs[1], "spelled": blobs[2], "code": blobs[3]})
                kept, n = [], 0

    return values.mapInPandas(pack, "chunk long, at binary, c binary, spelled binary, code binary")


def whole_word_weight(words: DataFrame, totals: np.ndarray) -> float:
    """Weight of the share of the rare tokens beside the spelling, by expectation maximization with each token left out.

    ``totals``: how often tokens of each first byte were spelled. The ratio of the two is binned to a
    twentieth of a power of ten, so at most 801 rows reach the driver.
    """
    total = F.element_at(F.lit([float(max(1, x)) for x in totals]).cast("array<double>"), F.col("code").bitwiseAND(255).bitwiseXOR(255) + 1)
    ratio = F.log10((F.col("c") - 1) / total) - F.col("spelled")
    binned = F.when(F.col("c") > 1, F.least(F.lit(400), F.greatest(F.lit(-400), F.round(ratio * 20))).cast("int"))
    rows = words.where("c > 0").groupBy(binned.alias("bin")).agg(F.sum("c").alias("n")).collect()
    share = np.array([0.0 if r["bin"] is None else 10.0 ** (r["bin"] / 20) for r in rows])
    n = np.array([float(r["n"]) for r in rows])
    if not len(rows):
        return 0.0
    weight = 0.5
    for _ in range(100):
        weight = float((n * weight * share / (weight * share + 1 - weight)).sum() / n.sum())
        weight = min(0.999, max(0.001, weight))
    return weight


def with_codes(values: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each chunk beside count, spelling and code of its distinct tokens, in their order."""
    rows = chunks.select(F.col("chunk").alias("part"), "ids", "sizes", "held", "bytes", "which")
    kinds = {"c": np.int64, "spelled": np.float32, "code": np.int32}

    def gather(known: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        at = np.frombuffer(b"".join(known["at"]), np.int32)
        out = {}
        for name, kind in kinds.items():
            ordered = np.zeros(len(at), kind)
            ordered[at] = np.frombuffer(b"".join(known[name]), kind)
            out[name] = [ordered.tobytes()]
        r = chunk.iloc[0]
        ids = [None if i is None or i != i else int(i) for i in r["ids"]]
        return pd.DataFrame({"ids": [ids]} | {k: [r[k]] for k in ("sizes", "held", "bytes", "which")} | out)

    schema = "ids array<long>, sizes array<long>, held array<boolean>, bytes array<long>, which binary, c binary, spelled binary, code binary"
    return values.groupBy("chunk").cogroup(rows.groupBy("part")).applyInPandas(gather, schema)


def score_texts(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Scores of every row of docs(doc_id, text): counts, base score, the model's score and bits per byte.

    Every token is scored where it stands, after the tokens before it in its text. Null and empty texts
    have the end token alone. Rows without a doc_id aren't learned from; repeated rows are rows of their
    own and are learned from as often as they stand. Without any training row all counts are 0 and the
    model is untrained. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    chunks = written(chunks_of(docs, chunk_chars))
    tokens = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts"))).select("chunk", F.col("pos").alias("at"), F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    words = written(tokens.groupBy("word").agg(F.sum("n").alias("c")))
    facts = scalars(words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.when(F.col("c") > 0, 1)).alias("distinct")))
    total, distinct = int(facts["total"]), int(facts["distinct"])
    frequent = words.where("c > 1").orderBy(F.desc("c"), "word").limit(VOCABULARY).collect()
    whole = [r["word"] for r in frequent]
    scored = written(code_words(words, train_mixer(words.where("c > 0")), whole))
    spelled, totals = scored.where("code < 0"), np.zeros(256, np.int64)
    for r in spelled.groupBy(F.col("code").bitwiseAND(255).alias("byte")).agg(F.sum("c").alias("c")).collect():
        totals[255 - r["byte"]] = r["c"]
    weight = whole_word_weight(spelled, totals)
    values = packed_by_chunk(tokens.drop("n").join(scored.hint("shuffle_hash"), "word").select("chunk", "at", "c", "spelled", "code"))
    coded = written(with_codes(values, chunks))
    # A first byte that was never spelled counts as seen once.
    codes = Codes(np.concatenate((np.array([r["c"] for r in frequent], np.int64), totals + 1)))
    slot_bits = min(MOST_BITS, max(LEAST_BITS, total.bit_length()))
    model = docs.sparkSession.sparkContext.broadcast(train_tokens(coded, codes, len(whole), slot_bits))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer = model.value
        for batch in batches:
            for _, r in batch.iterrows():
                c, code = np.frombuffer(r["c"], np.int64), np.frombuffer(r["code"], np.int32)
                spelled = np.frombuffer(r["spelled"], np.float32).astype(np.float64)
                base = np.log10((c + 1) / (total + distinct + 1))
                share = np.where(code < 0, c / np.maximum(1, totals[~code & 255]), 0)
                rest = np.log10(weight * share + (1 - weight) * 10.0 ** np.maximum(spelled, -290))
                rest = np.where((share == 0) & (spelled < -290), spelled + np.log10(1 - weight), rest)
                rest = np.where(code < 0, rest, 0)
                stream = Stream(r, len(whole))
                each, at = rest[stream.which], 0
                for symbols, contexts in stream.slices(SLICE_TOKENS, training=False):
                    each[at : at + len(symbols)] += mixer.log10(symbols, contexts)
                    at += len(symbols)
                score = np.add.reduceat(each, stream.starts)
                del each
                size = np.asarray(r["bytes"], float)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if i is None or i != i else int(i) for i in r["ids"]], dtype="Int64"),
                        "held_out": stream.held,
                        "n_tokens": stream.sizes,
                        "n_known": np.add.reduceat((c > 0)[stream.which].astype(np.int64), stream.starts),
                        "train_tokens": total,
                        "base_score": np.add.reduceat(base[stream.which], stream.starts),
                        "score": score,
                        "bits_per_byte": -score * np.log2(10) / np.maximum(size, 1),
                    }
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return coded.mapInPandas(score, schema)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_texts(table(spark, sf_dir, "documents"))
