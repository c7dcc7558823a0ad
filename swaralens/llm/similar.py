"""SimHash near-duplicates at a similarity of 0.8 over five-word shingles, by pigeonring.

A fingerprint has 252 bits, made from the distinct shingles of a text. Two fingerprints link if at most
40 bits differ, at most 23 of the first 126, and the smaller text has at least four fifths of the
distinct shingles of the larger. Sets of equal size and Jaccard similarity s differ in a share
arccos(2s / (1 + s)) / pi of all bits on average: 38 of 252 at 0.8, 26 at 0.9.

The first 126 bits are a ring of eight segments. If at most 23 of them differ, some start on the ring has
every chain of l consecutive segments differ in at most l * 23/8 bits: 2, 5, 8, 11, 14, 17, 20 and 23.
Candidates are made from the first link (two values within two bits of each other are both within
one bit of a third), the budgets of the longer chains prune them, and all bits decide. Within a key rows
are sorted by size, so only texts of like size meet. A key has 1/2^16 of a segment's values: this work
grows with the square of the number of distinct texts, see the README.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, texts_of
from .components import components, local_forest
from .simhash import BITS, shingle_hashes, with_classes

SHINGLE = 5
SEGMENTS = 8
#: Differing bits among those of the ring, and among all.
RADIUS = 23
WITHIN = 40
#: Bits in each of the four words of a fingerprint; two words are the ring.
HALF = 63
LOW = (1 << HALF) - 1
WORDS = ["w0", "w1", "w2", "w3"]
#: Columns of a row of a key, and where its size and node stand.
ROW = [*WORDS, "size", "node"]
SIZE, NODE = 4, 5
PRINT = ROW[:NODE]
#: Where segments begin and end: 15 or 16 bits, none across two words.
EDGES = [2 * HALF * k // SEGMENTS for k in range(SEGMENTS + 1)]
#: The most bits of a segment.
WIDTH = 16
#: The smaller of two linked texts has at least this share of the shingles of the larger.
RATIO = (4, 5)
#: Keys of up to so many rows are compared by shifts of whole batches, larger ones by a search from a row.
SMALL = 64
#: Rows of one key that are compared at once.
BLOCK = 4096
#: Shingles whose bits are counted at once.
PIECE = 1 << 16
LANE = np.arange(8 * len(WORDS), dtype=np.int64) * 256
WEIGHTS = BITS.astype(np.float64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Another hash of 64 bits from one (a step of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str) -> tuple[int, ...]:
    """Four words of 63 bits and the number of distinct shingles. A bit is one if it is set in over half
    of them; no words: all zero."""
    hashes = np.unique(shingle_hashes(text, SHINGLE).astype(np.uint64))
    n = len(hashes)
    counts = np.zeros(len(LANE) * 256, np.int64)
    for at in range(0, n, PIECE):
        words = [hashes[at : at + PIECE]]
        while len(words) < len(WORDS):
            words.append(_mixed(words[-1]))
        raw = np.stack(words, 1).astype("<u8").view(np.uint8).reshape(-1, len(LANE))
        counts += np.bincount((raw + LANE).ravel(), minlength=len(counts))
    ones = (counts.reshape(-1, 256) @ WEIGHTS).ravel() * 2 > n
    return *(w & LOW for w in np.packbits(ones, bitorder="little").view("<u8").tolist()), n


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(t) for t in texts_of(batch)], np.int64).reshape(-1, len(WORDS) + 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, prints.T.copy())], names=["doc_id", *WORDS, "size"])


def _chains(start: int) -> list[tuple[int, int, int]]:
    """For chains of two segments and more from `start` their bits in both words of the ring and their budget."""
    out, bits = [], 0
    for link in range(SEGMENTS):
        k = (start + link) % SEGMENTS
        bits |= (1 << EDGES[k + 1]) - (1 << EDGES[k])
        if link:
            out.append((bits & LOW, bits >> HALF, (link + 1) * RADIUS // SEGMENTS))
    return out


CHAINS = [_chains(start) for start in range(SEGMENTS)]


def _differ(a_low, a_high, b_low, b_high, low: int, high: int) -> np.ndarray:
    if not high:
        return np.bitwise_count((a_low ^ b_low) & low)
    if not low:
        return np.bitwise_count((a_high ^ b_high) & high)
    return np.bitwise_count((a_low ^ b_low) & low) + np.bitwise_count((a_high ^ b_high) & high)


def _like(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    return large * RATIO[0] <= small * RATIO[1]


def _pruned(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, chains) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a[i], b[j]) that keep every chain within its budget and all bits within WITHIN."""
    for low, high, budget in chains:
        near = _differ(a[i, 0], a[i, 1], b[j, 0], b[j, 1], low, high) <= budget
        i, j = i[near], j[near]
    near = sum(np.bitwise_count(a[i, w] ^ b[j, w]).astype(np.int64) for w in range(len(WORDS))) <= WITHIN
    return i[near], j[near]


def near(x: np.ndarray, y: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows of x and y whose chains from `start` are within budget."""
    low, high, budget = CHAINS[start][0]
    first = _differ(x[:, None, 0], x[:, None, 1], y[None, :, 0], y[None, :, 1], low, high) <= budget
    i, j = _pruned(x, y, *np.nonzero(first), CHAINS[start][1:])
    like = _like(np.minimum(x[i, SIZE], y[j, SIZE]), np.maximum(x[i, SIZE], y[j, SIZE]))
    return i[like], j[like]


def forest(rows: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of nodes with the components of all links among the rows of a key, which are sorted by size."""
    a, b = [], []
    rest = rows
    while len(rest) > 1:
        x = rest[:SMALL]
        upto = np.searchsorted(rest[:, SIZE], x[-1, SIZE] * RATIO[1] // RATIO[0], "right")
        i, j = near(x, rest[:upto], start)
        i = i[i < j]
        if not len(i):
            rest = rest[len(x) :]
            continue
        # The first linked row of the batch and all that is reachable from it leave together.
        at = int(i.min())
        node, front, rest = rest[at, NODE], rest[at : at + 1], np.delete(rest, at, 0)
        while len(front) and len(rest):
            x, front = front[:SMALL], front[SMALL:]
            least = np.searchsorted(rest[:, SIZE], -(-x[:, SIZE].min() * RATIO[0] // RATIO[1]))
            upto = np.searchsorted(rest[:, SIZE], x[:, SIZE].max() * RATIO[1] // RATIO[0], "right")
            found = least + np.unique(near(x, rest[least:upto], start)[1])
            if len(found):
                a.append(np.full(len(found), node))
                b.append(rest[found, NODE])
                front, rest = np.concatenate([front, rest[found]]), np.delete(rest, found, 0)
    empty = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _keys(batches):
    """Each class under the values within one bit of each of its segments."""
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ROW]
        for k in range(SEGMENTS):
            word, at = divmod(EDGES[k], HALF)
            width = EDGES[k + 1] - EDGES[k]
            home = (columns[word] >> at & (1 << width) - 1 | k << WIDTH)[:, None]
            keys = np.concatenate([home, home ^ (1 << np.arange(width))], 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), *(pa.array(np.repeat(c, width + 1)) for c in columns)], names=["key", *ROW])


LINK_ROWS = "a long, b long, key int, block int, least long, most long, members binary"
LINK_NAMES = ["a", "b", "key", "block", "least", "most", "members"]


def _found(a: np.ndarray, b: np.ndarray):
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=LINK_NAMES)


def _part(key: int, block: int, rows: np.ndarray):
    """A block of a key beyond BLOCK rows: its links, and itself for the pairs of blocks."""
    yield _found(*forest(rows, key >> WIDTH))
    held = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int32()), pa.array([block], pa.int32())]
    held += [pa.array([rows[0, SIZE]], pa.int64()), pa.array([rows[-1, SIZE]], pa.int64()), pa.array([rows.tobytes()], pa.binary())]
    yield pa.RecordBatch.from_arrays(held, names=LINK_NAMES)


def _links(batches):
    """Rows sorted by key and size -> links; of a key beyond BLOCK rows also its blocks."""
    key, rows, block = np.empty(0, np.int32), np.empty((0, len(ROW)), np.int64), 0
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        rows = np.concatenate([rows, np.stack([batch.column(c).to_numpy() for c in ROW], 1)])
        last = np.searchsorted(key, key[-1]) if len(key) else 0
        if last:
            yield from _whole(key[:last], rows[:last], block)
            key, rows, block = key[last:], rows[last:], 0
        while len(key) >= 2 * BLOCK:  # one key goes on and on
            yield from _part(int(key[0]), block, rows[:BLOCK])
            key, rows, block = key[BLOCK:], rows[BLOCK:], block + 1
    if len(key):
        yield from _whole(key, rows, block)


def _whole(key: np.ndarray, rows: np.ndarray, block: int):
    """All rows of some keys. block: over zero if the first key's earlier blocks are out already."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[first, len(key)])
    small = sizes <= SMALL
    if block:
        small[0] = False
    left = np.flatnonzero(np.repeat(small, sizes))
    a, b = [], []
    for step in range(1, SMALL):
        left = left[left + step < len(key)]
        left = left[(key[left] == key[left + step]) & _like(rows[left, SIZE], rows[left + step, SIZE])]
        if not len(left):
            break
        start = key[left] >> WIDTH
        for k in np.unique(start):
            i = left[start == k]
            i, j = _pruned(rows, rows, i, i + step, CHAINS[k])
            a.append(rows[i, NODE])
            b.append(rows[j, NODE])
    for g in np.flatnonzero(~small):
        at, n, k = first[g], sizes[g], int(key[first[g]])
        if n <= BLOCK and not (block and g == 0):
            x, y = forest(rows[at : at + n], k >> WIDTH)
            a.append(x)
            b.append(y)
        else:
            before = block if g == 0 else 0
            for low in range(0, n, BLOCK):
                yield from _part(k, before + low // BLOCK, rows[at + low : at + min(low + BLOCK, n)])
    if a:
        yield _found(*local_forest(np.concatenate(a), np.concatenate(b)))


def _across(batches):
    """Links among two blocks of one key."""
    for batch in batches:
        for key, x, y in zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y"))):
            rows = np.concatenate([np.frombuffer(m, np.int64).reshape(-1, len(ROW)) for m in (x, y)])
            a, b = forest(rows[np.argsort(rows[:, SIZE], kind="stable")], key >> WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(classes: DataFrame) -> DataFrame:
    """Distinct fingerprints (w0 to w3, size, node) -> links (a, b) between nodes whose components are those of all links."""
    width = shuffle_width(classes.sparkSession)
    keyed = classes.select(*ROW).mapInArrow(_keys, "key int, " + ", ".join(f"{c} long" for c in ROW))
    found = materialize(keyed.repartition(width, "key").sortWithinPartitions("key", "size").mapInArrow(_links, LINK_ROWS), "similar")
    direct = found.where("members is null").select("a", "b")
    held = found.where("members is not null").select("key", "block", "least", "most", "members")
    if held.isEmpty():
        return direct
    # Blocks follow each other in size; pairs that hold no texts of like size are left out.
    names = held.drop("members")
    pairs = names.select("key", F.col("block").alias("i"), "most").join(names.select("key", F.col("block").alias("j"), "least"), "key")
    pairs = pairs.where(f"i < j and least * {RATIO[0]} <= most * {RATIO[1]}").select("key", "i", "j").repartition(width, "key", "i", "j")
    blocks = held.select("key", "block", "members")
    pairs = pairs.join(blocks.withColumnsRenamed({"block": "i", "members": "x"}), ["key", "i"]).join(blocks.withColumnsRenamed({"block": "j", "members": "y"}), ["key", "j"])
    return direct.union(pairs.select("key", "x", "y").mapInArrow(_across, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, component_id), a row for each row of documents with a doc_id.

    Rows with a null doc_id are left out and link nothing. Null and wordless texts are alike, and like no
    other; a text of fewer than five words is its one shingle. Classes of equal fingerprints with the same
    smallest doc_id count as one. An empty table gives an empty result; further columns of documents
    are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    prints = materialize(texts.mapInArrow(_fingerprints, ", ".join(f"{c} long" for c in ("doc_id", *PRINT))), "prints")
    classes = materialize(prints.groupBy(*PRINT).agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    ids = classes.join(components(links(classes)), "node", "left")
    ids = materialize(ids.select(*PRINT, F.coalesce("root", "node").alias("component_id"), "n"), "ids")
    return with_classes(prints, ids, PRINT).select("doc_id", "component_id")
