"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Components are terms and vectors are rows. Queries and candidates are packed into blocks of bounded
size, which are dealt to the cells of a grid: a cell meets one group of queries with one group of
candidate blocks. A task streams the blocks of its cells in order, the queries of a cell first, so it
holds one group of queries and one block of candidates at a time. Of a block it makes postings: for
each term the positions and weights of the candidates that hold it. Query rows scatter weight times
posting into dense score arrays, and partition selection takes the best. A cell answers with k rows a
query; a window merges the cells' rows.

Nothing passes through the driver but the numbers of rows, and nothing is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_width

#: Vectors and bytes of a packed block; queries a cell holds; candidates a cell reads; candidates scored at once.
PACKED, BYTES, GROUP, CELL, BLOCK = 512, 1 << 20, 4096, 1 << 20, 4096
#: Query rows that are accumulated at once.
LANES = 32
PACKS = "pack long, n int, ids binary, sizes binary, terms binary, width int"
FOUND = "query_pack long, query_no int, query_id long, vec_id long, score long"
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, scale: int = 256, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, terms): floor(scale * x) of each component; one beyond 64 bits becomes the nearest long.
    Rows whose vector is null or holds a null, NaN or infinite component take no part; neither do rows
    without an id."""
    sound = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_column).isNotNull()).where(F.coalesce(sound, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("terms"))


def _lists(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row sizes and values of a list column."""
    return np.diff(array.offsets.to_numpy()).astype(np.int32), array.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray) -> list:
    """A block's columns; terms in the least width that holds them all."""
    width = next(w for w in (2, 4, 8) if not len(terms) or (-(2 ** (8 * w - 1)) <= terms.min() and terms.max() < 2 ** (8 * w - 1)))
    return [len(ids), ids.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), terms.astype(f"<i{width}").tobytes(), width]


def _unpacked(n: int, ids: bytes, sizes: bytes, terms: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i4"), np.frombuffer(terms, f"<i{width}").astype(np.int64)


def _pack(batches):
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        sizes, terms = _lists(batch.column("terms"))
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ids):
            begin = int(ends[at] - sizes[at])
            to = max(at + 1, min(at + PACKED, int(np.searchsorted(ends, begin + BYTES // 8, "right"))))
            row = [number, *_packed(ids[at:to], sizes[at:to], terms[begin : int(ends[to - 1])])]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int32()), *(pa.array([v], pa.binary()) for v in row[2:5]), pa.array([row[5]], pa.int32())], names=["pack", "n", "ids", "sizes", "terms", "width"])
            at, number = to, number + 1


def postings(sizes: np.ndarray, values: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (positions, weights) of the rows that hold it with a weight other than zero."""
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(values)) - starts[rows]
    live = values != 0
    rows, terms, values = rows[live], terms[live], values[live]
    order = np.argsort(terms, kind="stable")
    rows, terms, values = rows[order], terms[order], values[order]
    cut = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.empty(0, int)
    return {int(terms[a]): (rows[a:b], values[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(terms)])}


def spread_out(rows: np.ndarray, weights: np.ndarray, n: int, kind) -> tuple[np.ndarray | None, np.ndarray]:
    """A posting, with a weight for each of n rows (and no positions) if a quarter of them have one."""
    if len(rows) * 4 < n:
        return rows, weights.astype(kind)
    out = np.zeros(n, kind)
    out[rows] = weights
    return None, out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, in that order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over, even = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        need = k - len(over)
        if len(even) > need:
            even = even[np.argpartition(ids[even], need - 1)[:need]] if need else even[:0]
        at = np.r_[over, even]
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], ~scores[at]))]  # ~: falls as scores rise, for every long


class Queries:
    """The queries of a cell and the best candidates of each so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.packs: list[tuple[int, int]] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ready = False

    def add(self, pack: int, block) -> None:
        self.packs.append((pack, len(block[0])))
        self.parts.append(block)

    def _open(self) -> None:
        self.ids = np.concatenate([p[0] for p in self.parts])
        sizes = np.concatenate([p[1] for p in self.parts])
        values = np.concatenate([p[2] for p in self.parts])
        self.parts = []
        self.heavy = int(np.abs(values.astype(float)).max(initial=0))
        self.longest = int(sizes.max(initial=0))
        ends = np.cumsum(sizes, dtype=np.int64)
        self.lanes = []  # the postings of a few queries at a time
        for a in range(0, len(self.ids), LANES):
            b = min(a + LANES, len(self.ids))
            self.lanes.append((a, b, postings(sizes[a:b], values[int(ends[a] - sizes[a]) : int(ends[b - 1])])))
        self.kept_ids = [np.empty(0, np.int64)] * len(self.ids)
        self.kept = [np.empty(0, np.int64)] * len(self.ids)
        self.ready = True

    def scan(self, block) -> None:
        """Scores a block of candidates for every query."""
        if not self.ready:
            self._open()
        ids, sizes, values = block
        table = postings(sizes, values)
        # The least width that no score can pass; scores that might pass 64 bits are summed as Python's
        # integers and then taken to the nearest long.
        most = float(self.heavy) * float(np.abs(values.astype(float)).max(initial=0)) * min(self.longest, int(sizes.max(initial=0)))
        kind = np.int32 if most < 2.0**30 else np.int64 if most < 2.0**62 else object
        table = {t: spread_out(*entry, len(ids), kind) for t, entry in table.items()}
        product = np.empty((LANES, len(ids)), kind)
        for a, b, lane in self.lanes:
            scores = np.zeros((b - a, len(ids)), kind)
            for term, entry in lane.items():
                if term not in table:
                    continue
                at, held = table[term]
                rows, weights = spread_out(*entry, b - a, kind)
                weights = weights[:, None]
                if at is None and rows is None:
                    np.multiply(weights, held, out=product[: b - a])
                    scores += product[: b - a]
                elif at is None:
                    scores[rows] += weights * held
                elif rows is None:
                    scores[:, at] += weights * held
                else:
                    scores[np.ix_(rows, at)] += weights * held
            if kind is object:
                scores = np.clip(scores, LEAST, MOST).astype(np.int64)
            for q in range(a, b):
                self._keep(q, ids, scores[q - a])

    def _keep(self, q: int, ids: np.ndarray, points: np.ndarray) -> None:
        if len(self.kept[q]) == self.k:  # only what reaches the least kept score can enter
            near = np.flatnonzero(points >= self.kept[q][-1])
            if not len(near):
                return
            ids, points = ids[near], points[near]
        own = ids == self.ids[q]
        if own.any():
            ids, points = ids[~own], points[~own]
        ids, points = np.concatenate([self.kept_ids[q], ids]), np.concatenate([self.kept[q], points.astype(np.int64)])
        top = best(ids, points, self.k)
        self.kept_ids[q], self.kept[q] = ids[top], points[top]

    def found(self):
        if not self.ready:
            return None
        pack = np.repeat([p for p, _ in self.packs], [n for _, n in self.packs])
        no = np.concatenate([np.arange(n) for _, n in self.packs])
        many = np.array([len(x) for x in self.kept])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(pack, many), pa.int64()), pa.array(np.repeat(no, many).astype(np.int32)), pa.array(np.repeat(self.ids, many)), pa.array(np.concatenate(self.kept_ids)), pa.array(np.concatenate(self.kept))],
            names=["query_pack", "query_no", "query_id", "vec_id", "score"],
        )


def _search(k: int, block: int):
    """Rows of cells in order, each cell's queries before its candidates -> the best of each cell."""

    def merged(held):
        return tuple(np.concatenate(part) for part in zip(*held))

    def run(batches):
        cell = None
        queries = Queries(k)
        held, size = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                if cell != (row["i"], row["j"]):
                    if held:
                        queries.scan(merged(held))
                    found = queries.found()
                    if found is not None:
                        yield found
                    cell, queries, held, size = (row["i"], row["j"]), Queries(k), [], 0
                part = _unpacked(row["n"], row["ids"], row["sizes"], row["terms"], row["width"])
                if row["side"] == 0:
                    queries.add(row["pack"], part)
                elif queries.packs:
                    if held and size + len(part[0]) > block:
                        queries.scan(merged(held))
                        held, size = [], 0
                    held.append(part)
                    size += len(part[0])
        if held:
            queries.scan(merged(held))
        found = queries.found()
        if found is not None:
            yield found

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, group: int = GROUP, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """quantised() queries and candidates -> (query_id, rank, vec_id, score), k rows a query or all if
    there are fewer.

    Scores are integer inner products; a component that one side lacks counts as zero. A candidate
    with the query's own id is left out. Equal scores go to the smaller id. A query row that repeats
    gets rows of its own each time. A score beyond 64 bits counts as the nearest long. No queries or no candidates: an empty result.
    """
    spark = candidates.sparkSession
    asked = materialize(queries.select("vec_id", "terms").mapInArrow(_pack, PACKS), "queries")
    given = materialize(candidates.select("vec_id", "terms").mapInArrow(_pack, PACKS), "candidates")
    n, m = (df.agg(F.sum("n")).first()[0] or 0 for df in (asked, given))
    width = shuffle_width(spark)
    across = max(1, math.ceil(n / group))
    # Cells enough to keep every task busy, or so many that none reads more than its share.
    down = max(1, math.ceil(m / cell), min(math.ceil(2 * width / across), math.ceil(m / PACKED)))
    place = lambda seed, many: F.pmod(F.xxhash64(F.lit(seed), "pack"), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    columns = ("i", "j", "side", "pack", "n", "ids", "sizes", "terms", "width")
    left = asked.withColumns({"i": place(1, across), "side": F.lit(0)}).withColumn("j", each(down)).select(*columns)
    right = given.withColumns({"j": place(2, down), "side": F.lit(1)}).withColumn("i", each(across)).select(*columns)
    dealt = left.union(right).repartition(width, "i", "j").sortWithinPartitions("i", "j", "side", "pack")
    rows = dealt.mapInArrow(_search(k, block), FOUND)
    order = Window.partitionBy("query_pack", "query_no").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
