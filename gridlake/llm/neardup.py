"""Near-duplicates by a chosen-path set similarity join on word shingles.

Every document becomes a set of shingles, and every distinct set a class with a signature of minwise
tokens. A tree node names a few signature positions at random; each of them deals the node's classes
to child nodes by their token there, so that similar classes meet in some child with at least even
odds. Small nodes are compared exhaustively by signature, large ones branch again, and independent
trees repeat this until the target recall is reached. What a last level leaves large shares all its
chosen tokens and counts as linked. The links so found only tell which classes are worth reading
again: each such cluster is compared exhaustively on the full sets, and those links make the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.common import WORD, bounded_batches, cut_lineage, lower_ascii, slices, table, written
from gridlake.llm.components import components

POSITIONS = 96
TREES = 8
LEVELS = 4
SMALL_NODE = 256
BLOCK = 128
MOST_BLOCKS = 24
LARGEST_BLOCK = 8192
#: A signature estimate has a deviation of at most 0.04 near the threshold; four of them below it still count.
MARGIN = 0.15
COLUMNS_AT_ONCE = 8192
#: Sets on a side of a link matrix; larger groups are compared tile by tile.
TILE = 1024

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[2]
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words has its whole sequence as one."""
    sets = []
    for a, b in slices(texts):
        words = [WORD.findall(lower_ascii(t)) if t else [] for t in texts[a:b]]
        for w in words:
            if not w:
                sets.append(np.empty(0, np.uint64))
                continue
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
            n = min(width, len(h))
            mixed = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                mixed = scramble((mixed * MIX[0]) ^ (h[k : len(h) - n + 1 + k] * MIX[1]))
            sets.append(np.unique(mixed))
    return sets


def signatures(sets: list[np.ndarray], positions: int, seed: int) -> np.ndarray:
    """Minwise tokens of each non-empty set, one row of 32-bit tokens per set."""
    random = np.random.default_rng(seed)
    factors = random.integers(1, 2**63, positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(1, 2**63, positions, dtype=np.uint64)
    out = np.zeros((len(sets), positions), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
    for k in range(positions):
        out[full, k] = np.minimum.reduceat((flat ^ shifts[k]) * factors[k], starts) >> np.uint64(32)
    return out


def sketch(docs: DataFrame, width: int, seed: int, positions: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature (null where there is no word)."""

    @F.pandas_udf("n_shingles long, digest binary, tokens binary")
    def columns(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values, rows = texts.tolist(), []
            for a, b in slices(values):
                sets = shingle_sets(values[a:b], width)
                tokens = signatures(sets, positions, seed)
                rows += [(len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, t.tobytes() if len(s) else None) for s, t in zip(sets, tokens)]
            yield pd.DataFrame(rows, columns=["n_shingles", "digest", "tokens"])

    return docs.select("doc_id", columns(docs["text"]).alias("__s")).select("doc_id", "__s.*")


def hashed(*parts: int) -> int:
    return xxhash.xxh3_64_intdigest(b"".join(int(p).to_bytes(8, "little", signed=False) for p in parts))


def chosen(path: int, positions: int, threshold: float) -> list[int]:
    """Signature positions a node branches on: 1 / threshold of them on average, at least one."""
    count = int(1 / threshold + hashed(path, 1) / 2**64)
    return sorted(range(positions), key=lambda i: hashed(path, 2, i))[:count]


def children(paths: np.ndarray, tokens: np.ndarray, positions: int, threshold: float):
    """(row, child path) of every row at every chosen position of its node."""
    for path in np.unique(paths):
        at = np.flatnonzero(paths == path)
        for i in chosen(int(path), positions, threshold):
            key = scramble(scramble(tokens[at, i].astype(np.uint64) + np.uint64(hashed(int(path), 3, i))) + path)
            yield at, key


def branch(rows: DataFrame, positions: int, threshold: float, carry: bool) -> DataFrame:
    """Child nodes (node, rep) of (node, rep, n_shingles, tokens); ``carry`` takes the other columns along."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = batch["node"].to_numpy(np.int64).view(np.uint64)
            tokens = np.frombuffer(b"".join(batch["tokens"]), np.uint32).reshape(len(batch), positions)
            for at, key in children(paths, tokens, positions, threshold):
                out = batch.iloc[at][columns].copy()
                out.insert(0, "node", key.view(np.int64))
                yield out

    columns = ["rep", "n_shingles", "tokens"] if carry else ["rep"]
    schema = "node long, rep long" + (", n_shingles long, tokens binary" if carry else "")
    return rows.select("node", "rep", "n_shingles", "tokens").mapInPandas(deal, schema)


def roots(classes: DataFrame, trees: int, seed: int) -> DataFrame:
    """Every class at the root of every tree."""
    # Fixed by the seed alone, so a task that runs again deals its classes to the same nodes.
    keys = [int(np.uint64(hashed(seed, t)).view(np.int64)) for t in range(trees)]
    return classes.select(F.explode(F.array(*[F.lit(k).cast("long") for k in keys])).alias("node"), "rep", "n_shingles", "tokens")


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches sorted by the key, cut so that no group is split between two of them."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        values = batch[key].to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield batch.iloc[:cut]
        rest = batch.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def group_bounds(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    return zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(values)])).tolist())


def stars(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect each component of a small link matrix: its smallest id with every other."""
    order = np.argsort(ids, kind="stable")
    ids, linked = ids[order], linked[np.ix_(order, order)]
    labels = np.arange(len(ids))
    while True:
        near = np.where(linked, labels[None, :], len(ids)).min(axis=1)
        near = np.minimum(near, labels)
        near = near[near]
        if (near == labels).all():
            break
        labels = near
    other = np.flatnonzero(ids[labels] != ids)
    return ids[labels[other]], ids[other]


def compare_nodes(members: DataFrame, positions: int, least: float, ratio: float) -> DataFrame:
    """Candidate links (a, b) of small nodes given as (node, rep, n_shingles, tokens)."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in whole_groups(batches, "node"):
            nodes, ids = batch["node"].to_numpy(np.int64), batch["rep"].to_numpy(np.int64)
            sizes = batch["n_shingles"].to_numpy(np.float64)
            tokens = np.frombuffer(b"".join(batch["tokens"]), np.uint32).reshape(len(batch), positions)
            left, right = [], []
            for a, b in group_bounds(nodes):
                t, n = tokens[a:b], sizes[a:b]
                alike = (t[:, None, :] == t[None, :, :]).mean(axis=2) >= least
                alike &= np.minimum(n[:, None], n[None, :]) >= ratio * np.maximum(n[:, None], n[None, :])
                x, y = stars(ids[a:b], alike)
                left.append(x)
                right.append(y)
            yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    rows = members.select("node", "rep", "n_shingles", "tokens")
    return rows.repartition("node").sortWithinPartitions("node").mapInPandas(compare, "a long, b long")


def candidate_links(classes: DataFrame, percent: int, trees: int, levels: int, small: int, positions: int, seed: int) -> list[DataFrame]:
    """Links (a, b) of classes that some node of some tree brought together and found alike."""
    threshold = percent / 100
    found, rows = [], roots(classes, trees, seed)
    for level in range(levels):
        # The roots deal every class, so their tokens are fetched later, for classes that met another one.
        nodes = written(branch(rows, positions, threshold, carry=level > 0))
        sizes = cut_lineage(nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where("n > 1"))
        members = nodes.join(sizes, "node")
        near, large = members.where(F.col("n") <= small), members.where(F.col("n") > small)
        if not level:
            near = near.select("node", "rep").join(classes, "rep")
        found.append(cut_lineage(compare_nodes(near, positions, threshold - MARGIN, threshold).distinct()))
        if sizes.where(F.col("n") > small).isEmpty():
            break
        if level == levels - 1:
            found.append(large.where("first != rep").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct())
        rows = large if level else written(large.select("node", "rep")).join(classes, "rep")
    return found


def linked_sets(sets: list[np.ndarray], percent: int, split: int | None = None) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for all pairs of a small group; exact.

    With ``split``, for pairs of one of the first ``split`` sets and one of the others.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    # A shingle of one set alone adds to no intersection.
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows, columns = (slice(None), slice(None)) if split is None else (slice(split), slice(split, None))
    common = np.zeros((len(sizes[rows]), len(sizes[columns])), np.int64)
    total = int(shared.sum())
    for start in range(0, total, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, (start, start + COLUMNS_AT_ONCE))
        part = np.zeros((m, min(COLUMNS_AT_ONCE, total - start)), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        common += (part[rows] @ part[columns].T).astype(np.int64)
    union = sizes[rows, None] + sizes[None, columns] - common
    return 100 * common >= percent * union


def merged(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Roots after the links (x, y); every root is the smallest member."""
    while True:
        a, b = parent[x], parent[y]
        new = a != b
        if not new.any():
            return parent
        np.minimum.at(parent, np.maximum(a[new], b[new]), np.minimum(a[new], b[new]))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def group_links(ids: np.ndarray, known: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect each component of a group: its smallest id with every other.

    Memory is bounded by tiles of the link matrix. Pairs connected already, by equal ``known`` labels or
    by links found so far, are passed over, which leaves the components as they are.
    """
    if len(ids) <= 2 * TILE and len(np.unique(known)) == len(ids):
        return stars(ids, linked_sets(sets, percent))
    order = np.argsort(ids, kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    _, first, label = np.unique(known[order], return_index=True, return_inverse=True)
    parent = first[label]
    starts = range(0, len(ids), TILE)
    for gap in range(len(starts)):
        for i in range(len(starts) - gap):
            left, right = (np.arange(starts[k], min(len(ids), starts[k] + TILE)) for k in (i, i + gap))
            largest = np.bincount(parent).argmax()
            apart = parent[left] != largest
            for rows, columns in ((left[apart], right), (left[~apart], right[parent[right] != largest])):
                if len(rows) and len(columns) and len(np.unique(parent[np.concatenate((rows, columns))])) > 1:
                    x, y = np.nonzero(linked_sets([sets[k] for k in (*rows, *columns)], percent, len(rows)))
                    parent = merged(parent, rows[x], columns[y])
    other = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[parent[other]], ids[other]


def compare_groups(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the groups of sets(group, doc_id, known, shingles)."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in whole_groups(batches, "group"):
            groups, ids, known = (batch[c].to_numpy(np.int64) for c in ("group", "doc_id", "known"))
            values = batch["shingles"].tolist()
            left, right = [], []
            for a, b in group_bounds(groups):
                if b - a < 2:
                    continue
                x, y = group_links(ids[a:b], known[a:b], [np.frombuffer(v, np.uint64) for v in values[a:b]], percent)
                left.append(x)
                right.append(y)
            if left:
                yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    return sets.repartition("group").sortWithinPartitions("group").mapInPandas(confirm, "a long, b long")


def huge_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets(doc_id, component, n, shingles) in clusters of more than MOST_BLOCKS full blocks.

    A first round compares each block with itself, and a block's worth of members of all blocks. It connects
    most of a cluster of near copies. The second compares every set outside a cluster's largest part
    with all others, so no pair of different parts is left out.
    """
    sets = written(sets)

    def dealt(n: Column, salt: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.ceil(n / LARGEST_BLOCK))

    def in_group(rows: DataFrame, known: Column, *group: Column) -> DataFrame:
        return rows.select(F.xxhash64("component", *group).alias("group"), "doc_id", known.alias("known"), "shingles")

    n, alone = F.col("n"), F.col("doc_id")
    own = in_group(sets, alone, F.lit("own"), dealt(n, 1))
    across = in_group(sets.where(dealt(n, 2) == 0), alone, F.lit("across"))
    links = cut_lineage(compare_groups(own.union(across), percent).distinct())
    named = sets.select("doc_id", "component", "n").join(components(links).select(F.col("id").alias("doc_id"), F.col("component").alias("found")), "doc_id", "left")
    named = cut_lineage(named.select("doc_id", "component", F.coalesce("found", "doc_id").alias("part")))
    parts = named.groupBy("component", "part").agg(F.count("*").alias("size"))
    largest = parts.groupBy("component").agg(F.max_by("part", F.struct("size", "part")).alias("largest"), (F.sum("size") - F.max("size")).alias("outside"))
    largest = cut_lineage(largest.where("outside > 0"))
    rest = sets.join(named, ["doc_id", "component"]).join(largest, "component").withColumn("is_out", F.col("part") != F.col("largest"))
    outside = F.col("outside")
    out_blocks, in_blocks = F.ceil(outside / LARGEST_BLOCK), F.ceil((n - outside) / LARGEST_BLOCK)
    out, inside = rest.where("is_out").withColumn("own", dealt(outside, 3)), rest.where("not is_out").withColumn("own", dealt(n - outside, 4))
    each_out, each_in = F.explode(F.sequence(F.lit(0), out_blocks - 1)), F.explode(F.sequence(F.lit(0), in_blocks - 1))
    grouped = (
        in_group(out.withColumn("other", each_out), F.col("part"), F.lit("out"), F.least("own", "other"), F.greatest("own", "other")),
        in_group(out.withColumn("other", each_in), F.col("part"), F.lit("in"), F.col("own"), F.col("other")),
        in_group(inside.withColumn("other", each_out), F.col("part"), F.lit("in"), F.col("other"), F.col("own")),
    )
    return links.union(compare_groups(grouped[0].union(grouped[1]).union(grouped[2]), percent))


def confirmed_links(docs: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) confirmed on full sets, in every cluster (id, component) of class representatives.

    A cluster too large for one task is cut into blocks, and every pair of blocks is a task of its own; one
    too large for that goes through ``huge_links``.
    """
    sizes = cut_lineage(clusters.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"))
    most = MOST_BLOCKS * LARGEST_BLOCK
    members = cut_lineage(clusters.join(sizes, "component").select("component", F.col("id").alias("doc_id"), "n"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["text"].tolist()
            out = batch[["doc_id", "component", "n"]].copy()
            out["shingles"] = [s.tobytes() for s in shingle_sets(values, width)]
            yield out

    def sets_of(some: DataFrame) -> DataFrame:
        texts = docs.select("doc_id", "text").where("doc_id is not null").join(some, "doc_id")
        return texts.mapInPandas(read, "doc_id long, component long, n long, shingles binary")

    blocks = F.least(F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)), F.lit(MOST_BLOCKS)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    sets = sets_of(members.where(F.col("n") <= most)).withColumn("own", own).withColumn("other", other)
    sets = sets.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "doc_id", F.col("doc_id").alias("known"), "shingles")
    links = compare_groups(sets, percent)
    if not sizes.where(F.col("n") > most).isEmpty():
        links = links.union(huge_links(sets_of(members.where(F.col("n") > most)), percent))
    return links.distinct()


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    trees: int = TREES,
    levels: int = LEVELS,
    small_node: int = SMALL_NODE,
    positions: int = POSITIONS,
    seed: int = 20,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; the
    component is the smallest doc_id reachable over links, and that document is kept. Null and
    word-free texts have no shingles, link with nothing and are kept. Rows without a doc_id link with
    nothing, have a null component and are kept. Rows are not merged by doc_id: repeated rows stay
    repeated, and have the component of their own text. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(sketch(docs, width, seed, positions))
    worded = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = written(
        worded.groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")
        )
    )
    tokens = classes.select("rep", "n_shingles", "tokens")
    candidates = candidate_links(tokens, percent, trees, levels, small_node, positions, seed)
    links = candidates[0]
    for more in candidates[1:]:
        links = links.union(more)
    clusters = components(links)
    joined = components(confirmed_links(docs, clusters, width, percent))
    named = classes.select("digest", "rep").join(joined, F.col("rep") == F.col("id"), "left")
    named = cut_lineage(named.select("digest", F.coalesce("component", "rep").alias("component")))
    return (
        sketches.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def target_recall(percent: int, trees: int, level: int) -> float:
    """Chance that a pair exactly at the threshold meets in a node at the given level of some tree."""
    s, miss = percent / 100, 0.0
    more = 1 / s - 1
    for _ in range(level):
        meet = s * (1 - miss)
        miss = (1 - more) * (1 - meet) + more * (1 - meet) ** 2
    return 1 - math.pow(miss, trees)


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at three-word shingles and a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
