"""Exact removal of repeated substrings across documents, by suffix arrays over shards.

A byte goes if a `width`-byte string that covers it also starts in a document with a smaller id.
Every document is cut into windows (all its strings of that length). Equal windows must meet in one
shard, so each window is sent by its *anchor*: the GRAM-byte string within it whose hash is least.
Windows that follow each other and have one anchor form a block, which travels as one row. Three
passes over a table of text chunks, joined by small rows:

1. Chunks tell shards which anchors they hold; shards answer which occur in more than one document.
2. Chunks send the blocks of those shared anchors, equal ones once with their smallest id. Each shard
   joins its distinct blocks into one text, builds its suffix array by induced sorting, takes common
   prefixes in text order, and so finds which windows are equal and the smallest id that has them.
   It answers with a bit for each window of each block.
3. Chunks mark the bytes that lost windows cover, and digest what is left.

A passage that a third of all documents share is one block row a chunk and one distinct block in its
shard. There is a shard for every SHARD bytes of text, each in a partition of its own, so what a task
reads does not grow with the input. Where a window holds its least gram more than once, as in periodic
text, the anchor is taken so that neighbouring windows share it: blocks stay few whatever a text holds.
"""

from __future__ import annotations

import atexit
import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, shuffle_width, texts_of
from .suffix import equal_prefixes, suffix_array

WIDTH = 50
GRAM = 16
#: Bytes of text a chunk row holds; a longer document has a chunk of its own.
CHUNK = 4 << 20
#: Bytes of blocks that are sorted as one text, and positions hashed at once: what caches hold.
SORTED = 1 << 20
PIECE = 1 << 15
#: Bytes of text a shard stands for, and rows of blocks that are gathered at once.
SHARD = 4 << 20
GATHER = 1 << 14
NO_ID = np.iinfo(np.int64).max
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
CHUNK_ROWS = "chunk long, ids array<long>, sizes array<long>, known array<boolean>, body binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    parts: list[bytes] = []
    size = number = 0
    base = TaskContext.get().partitionId() << 32

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([base | number], pa.int64()), pa.array([[NO_ID if i is None else i for i in ids]], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([[i is not None for i in ids]], pa.list_(pa.bool_())), pa.array([b"".join(parts)], pa.binary())],
            names=["chunk", "ids", "sizes", "known", "body"],
        )

    for batch in batches:
        for i, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            raw = text.encode()
            if parts and size + len(raw) > CHUNK:
                yield row()
                ids, parts, size, number = [], [], 0, number + 1
            ids.append(i)
            parts.append(raw)
            size += len(raw)
    if parts:
        yield row()


def _rows(batch: pa.RecordBatch, *names: str):
    """The values of some columns, a row at a time: chunk rows are large."""
    for k in range(batch.num_rows):
        yield tuple(batch.column(name)[k].as_py() for name in names)


def chunk_table(docs: DataFrame) -> DataFrame:
    """documents as rows of chunks, in a table bucketed by chunk: joining small rows to it by chunk
    never moves the texts again."""
    spark = docs.sparkSession
    name = f"swaralens_chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/swaralens-{name}"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_chunks, CHUNK_ROWS)
    rows.write.bucketBy(shuffle_width(spark), "chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)

    def forget() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session may be over
            pass

    atexit.register(forget)
    return spark.table(name)


class Blocks:
    """The blocks of a chunk: runs of windows with one anchor, within one document."""

    def __init__(self, ids, sizes, body: bytes, width: int = WIDTH) -> None:
        self.ids = np.asarray(ids, np.int64)
        self.sizes = np.asarray(sizes, np.int64)
        self.body = np.frombuffer(body, np.uint8)
        self.width = width
        self.begins = np.cumsum(self.sizes) - self.sizes
        #: Whether a whole window of one document starts at a position.
        self.starts = np.ones(len(body), bool)
        for end, size in zip(np.cumsum(self.sizes).tolist(), self.sizes.tolist()):
            self.starts[end - min(size, width - 1) : end] = False
        parts = [self._part(a, min(a + PIECE, len(body) - width + 1)) for a in range(0, max(0, len(body) - width + 1), PIECE)]
        if parts:
            self.low, self.count, self.anchor, self.key = map(np.concatenate, zip(*parts))
        else:
            self.low, self.count, self.anchor = (np.empty(0, np.int64) for _ in range(3))
            self.key = np.empty(0, np.uint64)
        self.doc = np.searchsorted(self.begins, self.low, "right") - 1

    def _part(self, start: int, stop: int):
        """Blocks of the windows that start in [start, stop)."""
        width = self.width
        grams = width - GRAM + 1
        n = stop - start + grams - 1  # gram positions
        raw = np.zeros(n + 16, np.uint8)
        raw[: stop + width - 1 - start] = self.body[start : stop + width - 1]
        words = np.ndarray((n + 8,), "<u8", raw, strides=(1,)).astype(np.uint64)
        hashes = words[:n] * MIX[0]
        hashes ^= words[8 : n + 8] * MIX[1]
        hashes ^= hashes >> np.uint64(29)
        hashes *= MIX[2]
        hashes ^= hashes >> np.uint64(32)
        # The least hash of a window, with its place in the low bits: the leftmost one wins a tie.
        least = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
        reach = 1
        while 2 * reach <= grams:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < grams:
            least = np.minimum(least[: -(grams - reach)], least[grams - reach :])
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        window = np.flatnonzero(self.starts[start:stop])
        anchor = anchor[window]
        if not len(window):
            return *(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64)
        first = _breaks(anchor, window)
        if len(first) * 12 > len(window):
            anchor = _steady(hashes, anchor, window, start, grams)
            first = _breaks(anchor, window)
        count = np.diff(np.r_[first, len(window)])
        return window[first] + start, count, anchor[first] + start, hashes[anchor[first]]

    def places(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Each block's place among the sorted (shard, rest of the hash), and those places."""
        shard = ((self.key >> np.uint64(32)) % np.uint64(shards)).astype(np.uint64)
        places, inverse = np.unique((shard << np.uint64(32)) | (self.key & np.uint64(0xFFFFFFFF)), return_inverse=True)
        return inverse, places

    def contents(self, rows: np.ndarray) -> np.ndarray:
        """The bytes of blocks around their anchors, as equal-sized rows; bytes of no window are zero."""
        left = self.width - GRAM
        size = left + self.width
        column = np.arange(size)
        out = np.empty((len(rows), size), np.uint8)
        for a in range(0, len(rows), GATHER):
            part = rows[a : a + GATHER]
            begin = self.anchor[part] - left
            content = self.body[np.clip(begin[:, None] + column, 0, len(self.body) - 1)]
            low = (self.low[part] - begin)[:, None]
            content[(column < low) | (column >= low + (self.count[part] + self.width - 1)[:, None])] = 0
            out[a : a + GATHER] = content
        return out

    def shared(self, shards: int, answer: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of shared anchors, and their shards."""
        inverse, places = self.places(shards)
        flags = np.zeros(len(places), bool)
        shard = (places >> np.uint64(32)).astype(np.int64)
        first = np.searchsorted(shard, np.arange(shards + 1))
        for at, bits in answer:
            a, b = first[at], first[at + 1]
            flags[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        rows = np.flatnonzero(flags[inverse])
        return rows, shard[inverse[rows]]


def _breaks(anchor: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Where blocks begin among windows."""
    return np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])


def _steady(hashes: np.ndarray, anchor: np.ndarray, window: np.ndarray, start: int, grams: int) -> np.ndarray:
    """Moves anchors to another gram of the same hash within their window: the first one at or behind
    the position divisible by `grams`, which windows that follow each other have in common."""
    _, kind = np.unique(hashes, return_inverse=True)
    held = np.sort(kind << 17 | np.arange(len(kind)))
    beat = -(-(window + start) // grams) * grams - start
    at = np.searchsorted(held, kind[anchor] << 17 | beat)
    found = held[np.minimum(at, len(held) - 1)]
    place = found & 0x1FFFF
    fits = (at < len(held)) & (found >> 17 == kind[anchor]) & (place < window + grams)
    return np.where(fits, place, anchor)


def row_groups(content: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """A number for each row that is equal exactly for equal rows (of content and what else is given)."""
    n, size = content.shape
    padded = np.zeros((n, -(-size // 8) * 8), np.uint8)
    padded[:, :size] = content
    words = padded.view("<u8")
    code = np.zeros(n, np.uint64)
    for k in range(words.shape[1]):
        code = (code ^ words[:, k]) * MIX[k % 3]
        code ^= code >> np.uint64(31)
    for column in more:
        code = (code ^ column.astype(np.uint64)) * MIX[1]
        code ^= code >> np.uint64(30)
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    same = (content == content[first[inverse]]).all(1)
    for column in more:
        same &= column == column[first[inverse]]
    if not same.all():  # two rows with one hash: tell them apart by their bytes
        keys: dict[bytes, int] = {}
        tail = [np.asarray(c) for c in more]
        return np.array([keys.setdefault(content[i].tobytes() + b"|".join(str(c[i]).encode() for c in tail), len(keys)) for i in range(n)])
    return inverse


def shard_homes(spark, shards: int) -> np.ndarray:
    """A key for each shard that hash partitioning into as many partitions sends to one of its own."""
    tries = spark.range(int(shards * (math.log(shards) + 12))).select("id", F.pmod(F.hash("id"), F.lit(shards)).alias("at"))
    homes = np.arange(shards, dtype=np.int64)
    for r in tries.groupBy("at").agg(F.min("id").alias("id")).collect():  # a row a shard
        homes[r["at"]] = r["id"]
    return homes


def _tell_anchors(homes: np.ndarray, width: int):
    """Pass 1, chunk side: (home and number of a shard, chunk, the sorted hashes of its anchors, bits of
    those in several documents)."""
    shards = len(homes)

    def run(batches):
        for batch in batches:
            for chunk, ids, sizes, body in _rows(batch, "chunk", "ids", "sizes", "body"):
                blocks = Blocks(ids, sizes, body, width)
                if not len(blocks.low):
                    continue
                inverse, places = blocks.places(shards)
                doc = blocks.ids[blocks.doc]
                low = np.full(len(places), NO_ID)
                high = np.full(len(places), np.iinfo(np.int64).min)
                np.minimum.at(low, inverse, doc)
                np.maximum.at(high, inverse, doc)
                several = low < high
                shard = (places >> np.uint64(32)).astype(np.int64)
                rest = (places & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                at = np.searchsorted(shard, np.arange(shards + 1))
                some = np.flatnonzero(at[1:] > at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(homes[some]), pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk)), pa.array([rest[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()), pa.array([np.packbits(several[at[k] : at[k + 1]]).tobytes() for k in some], pa.binary())],
                    names=["home", "shard", "chunk", "hashes", "several"],
                )

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Pass 1, shard side: bits of the anchors that more than one document has."""
    parts = [np.frombuffer(b, np.uint32) for b in table["hashes"].to_pylist()]
    flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)).astype(bool) for b, p in zip(table["several"].to_pylist(), parts)]
    every = np.concatenate(parts)
    values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[inverse[np.concatenate(flags)]] = True
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(shared[inverse[e - len(p) : e]]).tobytes() for e, p in zip(ends, parts)]
    return pa.table({"chunk": table["chunk"], "shard": table["shard"], "bits": pa.array(bits, pa.binary())})


def _answers(values) -> list[tuple[int, bytes]]:
    return sorted((v["shard"], v["bits"]) for v in values or ())


def _representatives(blocks: Blocks, rows: np.ndarray, shard: np.ndarray):
    """Equal blocks (bytes, windows and shard) of a chunk: their number a block, and of each number its
    first row, shard and smallest id, in order of shard."""
    content = blocks.contents(rows)
    begin = blocks.low[rows] - blocks.anchor[rows]
    group = row_groups(content, begin, blocks.count[rows], shard)
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    order = np.lexsort((first, shard[first]))
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order))
    group, first = turn[group], first[order]
    low = np.full(len(first), NO_ID)
    np.minimum.at(low, group, blocks.ids[blocks.doc[rows]])
    return content, group, first, low


def _send_blocks(homes: np.ndarray, width: int):
    """Pass 2, chunk side: (home, shard, chunk, packed distinct blocks)."""
    shards = len(homes)

    def run(batches):
        for batch in batches:
            for chunk, ids, sizes, body, answer in _rows(batch, "chunk", "ids", "sizes", "body", "answer"):
                blocks = Blocks(ids, sizes, body, width)
                rows, shard = blocks.shared(shards, _answers(answer))
                if not len(rows):
                    continue
                content, _, first, low = _representatives(blocks, rows, shard)
                begin = (blocks.low - blocks.anchor)[rows][first] + (width - GRAM)
                count = blocks.count[rows][first]
                owner = shard[first]
                at = np.searchsorted(owner, np.arange(shards + 1))
                some = np.flatnonzero(at[1:] > at[:-1])
                packed = []
                for k in some:
                    part = slice(at[k], at[k + 1])
                    packed.append(struct.pack("<q", at[k + 1] - at[k]) + low[part].tobytes() + begin[part].astype(np.uint8).tobytes() + count[part].astype(np.uint8).tobytes() + content[first[part]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(homes[some]), pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk)), pa.array(packed, pa.binary())], names=["home", "shard", "chunk", "blocks"])

    return run


def first_holders(content: np.ndarray, begin: np.ndarray, count: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """For each distinct block and each of its windows, the smallest id of a block with that window.

    The blocks form texts of about SORTED bytes, those of one anchor in one text. There, windows are the
    suffixes that have `width` bytes of their block left; sorted suffixes with equal prefixes are equal
    windows."""
    out = np.full((len(content), width - GRAM + 1), NO_ID)
    gram = row_groups(np.ascontiguousarray(content[:, width - GRAM : width]))
    several = np.bincount(gram) > 1
    alone = ~several[gram]
    # No other block has this one's anchor, so none has its windows.
    out[alone] = np.where(np.arange(width - GRAM + 1) < count[alone][:, None], low[alone][:, None], NO_ID)
    rest = np.flatnonzero(~alone)
    part = gram[rest] % max(1, -(-int((count[rest] + width - 1).sum()) // SORTED))
    for rows in np.split(rest[np.argsort(part, kind="stable")], np.cumsum(np.bincount(part))[:-1]) if len(rest) else ():
        out[rows] = _sorted_holders(content[rows], begin[rows], count[rows], low[rows], width)
    return out


def _sorted_holders(content: np.ndarray, begin: np.ndarray, count: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    n, size = content.shape
    if not n:
        return np.full((0, width - GRAM + 1), NO_ID)
    column = np.arange(size)
    inside = (column >= begin[:, None]) & (column < (begin + count + width - 1)[:, None])
    text = content[inside]
    is_window = (column < (begin + count)[:, None])[inside]
    order = suffix_array(text, width)
    order = order[is_window[order]]
    owner = np.repeat(np.arange(n), inside.sum(1))
    fresh = np.r_[True, ~equal_prefixes(text, order, width)]
    start = np.flatnonzero(fresh)
    holder = np.minimum.reduceat(low[owner[order]], start)
    out = np.full((n, width - GRAM + 1), NO_ID)
    starts = np.cumsum(count + width - 1) - (count + width - 1)
    out[owner[order], order - starts[owner[order]]] = holder[np.cumsum(fresh) - 1]
    return out


def _sort_shard(width: int):
    """Pass 2, shard side: a bit for each window of each block that is lost to a smaller id."""
    size = 2 * width - GRAM

    def run(table: pa.Table) -> pa.Table:
        lows, begins, counts, contents, many = [], [], [], [], []
        for packed in table["blocks"].to_pylist():
            (n,) = struct.unpack_from("<q", packed)
            lows.append(np.frombuffer(packed, np.int64, n, 8))
            begins.append(np.frombuffer(packed, np.uint8, n, 8 + 8 * n))
            counts.append(np.frombuffer(packed, np.uint8, n, 8 + 9 * n))
            contents.append(np.frombuffer(packed, np.uint8, n * size, 8 + 10 * n).reshape(n, size))
            many.append(n)
        low, begin, count, content = np.concatenate(lows), np.concatenate(begins).astype(np.int64), np.concatenate(counts).astype(np.int64), np.concatenate(contents)
        group = row_groups(content, begin, count)
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
        least = np.full(len(first), NO_ID)
        np.minimum.at(least, group, low)
        holder = first_holders(content[first], begin[first], count[first], least, width)
        lost = holder[group] < low[:, None]
        weights = np.uint64(1) << np.arange(lost.shape[1], dtype=np.uint64)
        masks = (lost * weights).sum(1, dtype=np.uint64)
        ends = np.cumsum(many)
        return pa.table({"chunk": table["chunk"], "shard": table["shard"], "masks": pa.array([masks[e - n : e].tobytes() for e, n in zip(ends, many)], pa.binary())})

    return run


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(blocks: Blocks, rows, shard, masks: np.ndarray) -> np.ndarray:
    """Which bytes of a chunk go."""
    _, group, first, low = _representatives(blocks, rows, shard)
    if len(masks) != len(first):
        raise ValueError("answers do not fit their chunk")
    width = blocks.width
    every = np.arange(width - GRAM + 1)
    # One more window covers a byte from where it starts, one less from behind its end: at most `width` at once.
    change = np.zeros(len(blocks.body) + width + 1, np.int8)
    for a in range(0, len(rows), GATHER):
        part, of = rows[a : a + GATHER], group[a : a + GATHER]
        lost = (masks[of][:, None] >> every.astype(np.uint64)) & np.uint64(1) > 0
        lost |= (blocks.ids[blocks.doc[part]] > low[of])[:, None]  # an equal block stands in a smaller id's text here
        lost &= every < blocks.count[part][:, None]
        at = (blocks.low[part][:, None] + every)[lost]  # distinct positions
        change[at] += 1
        change[at + width] -= 1
    return np.cumsum(change[: len(blocks.body)], dtype=np.int8) > 0


def _digest(shards: int, width: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            for ids, sizes, known, body, answer, lost in _rows(batch, "ids", "sizes", "known", "body", "answer", "lost"):
                raw = np.frombuffer(body, np.uint8)
                gone = None
                if lost:
                    blocks = Blocks(ids, sizes, body, width)
                    rows, shard = blocks.shared(shards, _answers(answer))
                    masks = np.concatenate([np.frombuffer(v["masks"], np.uint64) for v in sorted(lost, key=lambda v: v["shard"])])
                    gone = _removed(blocks, rows, shard, masks)
                out: list[list] = [[], [], [], [], []]
                texts = []
                at = 0
                for size in sizes:
                    part = raw[at : at + size]
                    flags = gone[at : at + size] if gone is not None else None
                    n = int(flags.sum()) if flags is not None else 0
                    kept = part[~flags] if n else part
                    out[0].append(size)
                    out[1].append(n)
                    out[2].append(int(np.count_nonzero(flags[1:] & ~flags[:-1]) + flags[0]) if n else 0)
                    out[3].append(hashlib.sha256(kept.tobytes()).hexdigest())
                    if keep_text:
                        texts.append(kept.tobytes())
                    at += size
                arrays = [pa.array([i if k else None for i, k in zip(ids, known)], pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
                if keep_text:
                    arrays.append(pa.array(texts, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays)])

    return run


def deduplicate(docs: DataFrame, width: int = WIDTH, keep_text: bool = False) -> DataFrame:
    """documents -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept]), a row for each row.

    Matches never cross documents; texts shorter than width are left as they are; a null text is the
    empty one. Rows that share an id never remove each other. A null id counts as greater than all
    others: such rows lose what others have and take nothing away. An empty table gives an empty
    result; further columns are ignored. kept holds the bytes that are left, which need not be valid
    UTF-8. width is from GRAM + 1 to 79.
    """
    if not GRAM < width <= GRAM + 63:
        raise ValueError(f"width must be from {GRAM + 1} to {GRAM + 63}")
    spark = docs.sparkSession
    chunks = chunk_table(docs)
    size = chunks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
    shards = max(shuffle_width(spark), math.ceil(size / SHARD))
    homes = shard_homes(spark, shards)
    told = chunks.select("chunk", "ids", "sizes", "body").mapInArrow(_tell_anchors(homes, width), "home long, shard int, chunk long, hashes binary, several binary")
    shared = told.repartition(shards, "home").groupBy("home").applyInArrow(_shared_anchors, "chunk long, shard int, bits binary")
    answers = materialize(shared.groupBy("chunk").agg(F.collect_list(F.struct("shard", "bits")).alias("answer")), "anchors")
    sent = chunks.join(answers, "chunk").select("chunk", "ids", "sizes", "body", "answer").mapInArrow(_send_blocks(homes, width), "home long, shard int, chunk long, blocks binary")
    sorted_ = sent.repartition(shards, "home").groupBy("home").applyInArrow(_sort_shard(width), "chunk long, shard int, masks binary")
    losses = materialize(sorted_.groupBy("chunk").agg(F.collect_list(F.struct("shard", "masks")).alias("lost")), "losses")
    final = chunks.join(answers.join(losses, "chunk", "left"), "chunk", "left").select("ids", "sizes", "known", "body", "answer", "lost")
    return final.mapInArrow(_digest(shards, width, keep_text), DIGEST + ", kept binary" * keep_text)
