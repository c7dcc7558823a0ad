"""SimHash near-duplicates with a pigeonring filter.

A 64-bit fingerprint is cut into a ring of four segments of 16 bits. If two fingerprints differ in
at most three bits, some start on the ring has every chain of l consecutive segments differ in at
most l * 3/4 bits: 0, 1, 2 and 3. Candidates are made from the first two links of the chain
(segment i equal, segment i + 1 within one bit) through equal 34-bit keys, the chain budgets of
three and four segments prune them, and the Hamming distance decides.

Only classes of equal fingerprints are compared, so copies cost one row. Links leave a key as a
spanning forest, never as all pairs; whatever a key's size, its pairs pass the chain budgets before
the full check. A key with more classes than BLOCK is cut into blocks; each pair of blocks is then a
row of its own, dealt by both blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, texts_of
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Classes of one key that are compared at once.
BLOCK = 4096
#: Fingerprint classes with more than one in HOT of all rows are too large for one shuffle partition.
HOT = 1000
#: Ids (8 bytes each) that may be broadcast.
BROADCAST = 1_000_000
#: The bits of each of the 256 byte values, lowest first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LANE = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle of a lower-cased (A-Z) text, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, ">u8")
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), ">u8")


def fingerprint(text: str) -> int:
    """A bit is one if it is set in over half the shingle hashes; no words: zero."""
    hashes = shingle_hashes(text)
    n = len(hashes)
    if not n:
        return 0
    raw = hashes.view(np.uint8).reshape(n, 8)[:, ::-1]
    counts = np.bincount((raw + LANE).ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, fp): a row for each row; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _keys(batches):
    """Each fingerprint's four home keys, and a probe key for every set bit of the second segment."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        seg = [(fp >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)]
        keys, rows = [], []
        every = np.arange(len(fp))
        for i in range(4):
            first, second = seg[i], seg[(i + 1) % 4]
            home = (np.uint64(i) << np.uint64(32)) | (first << np.uint64(16)) | second
            keys.append(home << np.uint64(1))
            rows.append(every)
            for bit in range(16):
                has = np.flatnonzero((second >> np.uint64(bit)) & np.uint64(1))
                keys.append(((home[has] ^ np.uint64(1 << bit)) << np.uint64(1)) | np.uint64(1))
                rows.append(has)
        key, row = np.concatenate(keys), np.concatenate(rows)
        yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(1)).view(np.int64)), pa.array((key & np.uint64(1)) == 1), pa.array(fp[row].view(np.int64))], names=["key", "probe", "fp"])


def pigeonring(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs keep every chain from their start within its budget; then the full check."""
    diff = a ^ b
    near = np.ones(len(diff), bool)
    total = np.zeros(len(diff), np.int64)
    for link in range(4):
        shift = (((start + np.uint64(link)) % np.uint64(4)) * np.uint64(16)).astype(np.uint64)
        total += np.bitwise_count((diff >> shift) & np.uint64(0xFFFF))
        near &= total <= (link + 1) * RADIUS // 4
    out = np.flatnonzero(near)
    return out[np.bitwise_count(diff[out]) <= RADIUS]


def chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """For chains of two, three and four segments from `start` their bits and their budget; within a
    key the first segments are equal."""
    out, mask = [], 0
    for link in range(4):
        mask |= 0xFFFF << 16 * ((start + link) % 4)
        if link:
            out.append((np.uint64(mask), (link + 1) * RADIUS // 4))
    return out


def forest(members: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints of a key of segment `start`. Chains
    of segments beyond their budget prune pairs step by step; the last chain is the full Hamming check."""
    chains = chain_masks(start)
    rest, front = members[1:], [members[0]] if len(members) else []
    a, b = [], []
    while len(rest):
        if not front:
            front, rest = [rest[0]], rest[1:]
            continue
        x = front.pop()
        diff = rest ^ x
        near = np.arange(len(rest))
        for mask, budget in chains:
            near = near[np.bitwise_count(diff[near] & mask) <= budget]
        if len(near):
            found = rest[near]
            a.append(np.full(len(found), x))
            b.append(found)
            front.extend(found)
            rest = np.delete(rest, near)
    empty = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _rows(a, b, key=None, block=None, members=None):
    n = len(a)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)) if n else none, pa.array(b.view(np.int64)) if n else none, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["a", "b", "key", "block", "members"])


def _held(key: int, block: int, members: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()), pa.array([block], pa.int32()), pa.array([members.tobytes()], pa.binary())], names=["a", "b", "key", "block", "members"])


LINK_ROWS = "a long, b long, key long, block int, members binary"


def _links(batches):
    """Rows sorted by key -> links; of a key beyond BLOCK members also its blocks, for later."""
    key = np.empty(0, np.int64)
    fp = np.empty(0, np.uint64)
    probe = np.empty(0, bool)
    block = 0
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
        probe = np.concatenate([probe, batch.column("probe").to_numpy(zero_copy_only=False)])
        last = np.searchsorted(key, key[-1])
        if last:
            yield from _whole(key[:last], fp[:last], probe[:last], block)
            key, fp, probe, block = key[last:], fp[last:], probe[last:], 0
        while len(key) >= 2 * BLOCK:  # one key goes on and on
            yield from _part(int(key[0]), block, np.unique(fp[:BLOCK]))
            key, fp, probe, block = key[BLOCK:], fp[BLOCK:], probe[BLOCK:], block + 1
    if len(key):
        yield from _whole(key, fp, probe, block)


def _part(key: int, block: int, members: np.ndarray):
    yield _rows(*forest(members, key >> 32))
    yield _held(key, block, members)


def _whole(key, fp, probe, block):
    """block: over zero if the first key's earlier blocks are out already."""
    if block:
        n = np.searchsorted(key, key[0], "right")
        yield from _part(int(key[0]), block, np.unique(fp[:n]))
        key, fp, probe = key[n:], fp[n:], probe[n:]
    if not len(key):
        return
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[first, len(key)])
    homes = np.add.reduceat(~probe, first, dtype=np.int64)
    live = (sizes > 1) & (homes > 0)
    small = np.repeat(live & (sizes <= 8), sizes)
    for step in range(1, 8):
        x = np.flatnonzero(small[:-step] & (key[:-step] == key[step:])) if len(key) > step else np.empty(0, int)
        if not len(x):
            break
        near = x[pigeonring(fp[x], fp[x + step], (key[x] >> 32).astype(np.uint64))]
        near = near[fp[near] != fp[near + step]]
        if len(near):
            yield _rows(fp[near], fp[near + step])
    for g in np.flatnonzero(live & (sizes > 8)):
        at, n = first[g], sizes[g]
        members = np.unique(fp[at : at + n])
        if len(members) <= BLOCK:
            yield _rows(*forest(members, int(key[at]) >> 32))
        else:
            for k in range(0, len(members), BLOCK):
                yield from _part(int(key[at]), k // BLOCK, members[k : k + BLOCK])


def _across(batches):
    """Links between two blocks of one key."""
    for batch in batches:
        for key, x, y in zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y"))):
            a, b = forest(np.unique(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])), key >> 32)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(classes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of all links."""
    spark = classes.sparkSession
    keyed = classes.select("fp").mapInArrow(_keys, "key long, probe boolean, fp long")
    found = keyed.repartition(shuffle_width(spark), "key").sortWithinPartitions("key").mapInArrow(_links, LINK_ROWS)
    found = materialize(found, "simhash")
    direct = found.where("members is null").select("a", "b")
    held = found.where("members is not null").select("key", "block", "members")
    if held.isEmpty():
        return direct
    # Pairs of blocks are dealt by both numbers, so a key of many blocks has as many tasks as it can use.
    names = held.select("key", "block")
    pairs = names.withColumnRenamed("block", "i").join(names.withColumnRenamed("block", "j"), "key").where("i < j").repartition(shuffle_width(spark), "key", "i", "j")
    pairs = pairs.join(held.withColumnsRenamed({"block": "i", "members": "x"}), ["key", "i"]).join(held.withColumnsRenamed({"block": "j", "members": "y"}), ["key", "j"])
    return direct.union(pairs.select("key", "x", "y").mapInArrow(_across, "a long, b long"))


def with_classes(prints: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of documents with what `ids` says of their class; ids has a row for each class, with its
    number of rows in n."""
    # At most HOT classes have more than one in HOT of the rows: those are joined without a shuffle.
    total = ids.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(ids.where(F.col("n") * HOT > total).drop("n"))
    rest = prints.join(hot.select(*keys), keys, "left_anti").join(ids.drop("n"), keys, "left")
    return rest.unionByName(prints.join(hot, keys))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, fp, component_id), a row for each row of documents.

    Null and wordless texts have fingerprint zero and link like any other. Rows that repeat a doc_id
    are judged by their own texts. Null ids take part but never name a component; a component of
    null ids only has a null component_id. An empty table gives an empty result; further columns of
    documents are ignored.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    rooted = components(links(classes)).select(F.col("node").alias("fp"), "root")
    named = classes.join(rooted, "fp")
    lows = named.groupBy("root").agg(F.min("first_id").alias("low"))
    named = named.join(lows, "root").select("fp", "low")
    ids = materialize(classes.join(named, "fp", "left").select("fp", F.coalesce("low", "first_id").alias("component_id"), "n"), "ids")
    return with_classes(prints, ids, ["fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, most: int = BROADCAST, judge: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """documents without all but the first document (smallest doc_id) of each component that `judge` finds.

    Rows with a null doc_id stay. Rows that share a kept doc_id stay together. Up to `most` ids that
    go are sent to the texts; beyond that, texts and ids are joined by key.
    """
    judged = materialize(judge(docs), "judged")
    lost = judged.where("doc_id <> component_id").select("doc_id").distinct()
    kept = judged.where("doc_id = component_id").select("doc_id").distinct()
    gone = materialize(lost.join(kept, "doc_id", "left_anti"), "gone").withColumnRenamed("doc_id", "gone_id")
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
