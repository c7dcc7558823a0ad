"""Temperature mixing of sources, realised as budgeted block permutations.

Source i with T_i tokens has the share p_i = T_i / T and gets the weight w_i = p_i^a / sum p_j^a. The
exponent a in [0, 1] is found by bisection: the smallest one that keeps every source within a
repetition limit, or the one that meets a target entropy. The budget is then dealt out as b_i =
w_i * B tokens. Without a budget B is the least at which every source is used up at least once, so
that mixing repeats small sources and drops nothing.

A source's documents are laid out in blocks by a hash, the blocks in a pseudo-random order and the
documents within a block in another: an epoch's permutation. There are as many blocks as keep a block
to about ROWS rows even if one source has them all. Only blocks' totals are summed in order over a
source, so no task ever sorts a whole source. b_i is spent on whole epochs and then on the leading
documents of one more: those up to one place in the permutation, which a row a source tells. A placement's `position` is the share of its source's budget
spent before it, so that ordering all placements by it mixes every prefix to the target weights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Blocks a source has at least, rows they hold at most (about), and blocks of the mix.
BLOCKS, ROWS, MIX_BLOCKS = 256, 20_000, 1024
#: Tables of so many rows are broadcast; longer ones are joined by key.
BROADCAST = 100_000


def weights(totals: dict, exponent: float, counts: dict | None = None) -> dict:
    """The weight of each source from its total. With counts, a key stands for so many equal sources."""
    top = max(totals.values())
    raw = {s: (n / top) ** exponent for s, n in totals.items()}
    whole = math.fsum(w * (counts[s] if counts else 1) for s, w in raw.items())
    return {s: w / whole for s, w in raw.items()}


def entropy(w: dict, counts: dict | None = None) -> float:
    """In nats."""
    return -math.fsum(x * math.log(x) * (counts[s] if counts else 1) for s, x in w.items() if x > 0)


def repetition(totals: dict[str, int], w: dict[str, float], budget: float | None) -> float:
    """Epochs of the source that is repeated most."""
    whole = budget or full_budget(totals, w)
    return max(w[s] * whole / n for s, n in totals.items())


def full_budget(totals: dict[str, int], w: dict[str, float]) -> float:
    """The least budget that uses up every source once."""
    return max(n / w[s] for s, n in totals.items())


def find_exponent(totals: dict[str, int], target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, steps: int = 60, counts: dict | None = None) -> float:
    """Bisects [0, 1]. Entropy falls and repetition falls as the exponent rises. A target beyond what
    the interval reaches gives its nearer end."""
    if not totals:
        return 1.0
    low, high = 0.0, 1.0

    def flat_enough(a: float) -> bool:
        w = weights(totals, a, counts)
        if target_entropy is not None:
            return entropy(w, counts) >= target_entropy
        return repetition(totals, w, budget) > max_repeats

    if target_entropy is None and max_repeats is None:
        raise ValueError("a target entropy or a repetition limit is needed")
    if not flat_enough(low):
        return low
    if flat_enough(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if flat_enough(mid) else (low, mid)
    return high


def with_tokens(docs: DataFrame) -> DataFrame:
    """Adds n_tokens, the number of runs of non-blank characters, at least 1, and mix_source: source,
    or '' for null."""
    return docs.withColumns({"n_tokens": F.greatest(F.lit(1), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))).cast("long"), "mix_source": F.coalesce("source", F.lit(""))})


def plan_mix(sized: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """(mix_source, weight, budget, total) of each source.

    Sources of one total weigh the same, so the driver weighs the distinct totals: at most the square
    root of twice the tokens, however many sources there are.
    """
    totals = materialize(sized.groupBy("mix_source").agg(F.sum("n_tokens").alias("total")), "totals")
    counts = {r["total"]: r["n"] for r in totals.groupBy("total").agg(F.count("*").alias("n")).collect()}
    by_total = []
    if counts:
        distinct = {n: n for n in counts}
        w = weights(distinct, find_exponent(distinct, target_entropy, max_repeats, budget, counts=counts), counts)
        whole = budget or full_budget(distinct, w)
        by_total = [(n, w[n], float(w[n] * whole)) for n in distinct]
    weighed = sized.sparkSession.createDataFrame(by_total, "total long, weight double, budget double")
    return materialize(totals.join(weighed, "total").select("mix_source", "weight", "budget", "total"), "sources")


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def block_count(sized: DataFrame, least: int = BLOCKS) -> int:
    return max(least, math.ceil(sized.count() / ROWS))


def laid_out(sized: DataFrame, seed: int, blocks: int) -> DataFrame:
    """Adds a row's place in its source's permutation: block, the block's turn, and order within it.
    Equal rows have one place."""
    order = F.xxhash64(F.lit(seed), "mix_source", "doc_id", "row_hash")
    laid = sized.withColumn("order", order).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.lit(blocks)).cast("int"))
    return laid.withColumn("turn", F.xxhash64(F.lit(seed), "mix_source", "block"))


def block_plan(laid: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (mix_source, block, before_block), the tokens of the blocks before, and sources
    (mix_source, weight, budget, total, full, last): the number of whole epochs, and the last place
    (turn, block, order) that one more, partial epoch takes, null for none."""
    per_block = laid.groupBy("mix_source", "turn", "block").agg(F.sum("n_tokens").alias("in_block"), F.max("order").alias("top"))
    over = Window.partitionBy("mix_source").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per_block.withColumn("before_block", F.coalesce(F.sum("in_block").over(over), F.lit(0)))
    full = F.floor(F.col("budget") / F.col("total") + 1e-9)
    room = F.col("budget") - full * F.col("total") - F.col("before_block") + 1e-6
    blocks = materialize(blocks.join(small(sources), "mix_source").withColumns({"full": full.cast("int"), "room": room}), "blocks")
    # A source's room ends within one of its blocks at most; only that one's rows are summed in order.
    split = materialize(blocks.where("room > 0 and room < in_block").select("mix_source", "block", "room"), "split")
    within = Window.partitionBy("mix_source", "block").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
    cuts = laid.join(small(split), ["mix_source", "block"]).withColumn("reached", F.sum("n_tokens").over(within)).where("reached <= room").select("mix_source", F.struct("turn", "block", "order").alias("last"))
    ends = blocks.where("room >= in_block").select("mix_source", F.struct("turn", "block", F.col("top").alias("order")).alias("last"))
    last = cuts.union(ends).groupBy("mix_source").agg(F.max("last").alias("last"))
    known = sources.withColumn("full", full.cast("int")).join(last, "mix_source", "left")
    return blocks.select("mix_source", "block", "before_block"), materialize(known, "plan")


def epochs() -> F.Column:
    return F.col("full") + F.coalesce((F.struct("turn", "block", "order") <= F.col("last")).cast("int"), F.lit(0))


def _sized(docs: DataFrame) -> DataFrame:
    return with_tokens(docs).withColumn("row_hash", F.xxhash64("text"))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: float | None = None, seed: int = 7, blocks: int = BLOCKS, mix_blocks: int = MIX_BLOCKS) -> DataFrame:
    """documents -> (doc_id, source, n_tokens, weight, epoch, position, mix_block), one row a placement.

    The last epoch ends before the first document that would pass its source's budget. A null source
    is a source of its own (''); a null or blank text weighs one token; rows and ids may repeat or be
    null: rows equal in doc_id, source and text are placed side by side and are in or out together. An
    empty table gives an empty result; further columns are ignored.
    """
    sized = materialize(_sized(docs.select(F.col("doc_id").cast("long"), "source", "text")).select("mix_source", "doc_id", "row_hash", "n_tokens"), "sized")
    sources = plan_mix(sized, target_entropy, max_repeats, budget)
    laid = laid_out(sized, seed, block_count(sized, blocks))
    before, plan = block_plan(laid, sources)
    inside = Window.partitionBy("mix_source", "block").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(small(before), ["mix_source", "block"]).join(small(plan), "mix_source")
    placed = placed.withColumn("epochs", epochs()).where("epochs > 0")
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    position = F.least((F.col("epoch") * F.col("total") + F.col("before_block") + F.col("inside")) / F.col("budget"), F.lit(1.0))
    placed = placed.withColumn("position", position)
    return placed.select("doc_id", F.col("mix_source").alias("source"), "n_tokens", "weight", "epoch", "position", F.least(F.floor(F.col("position") * mix_blocks), F.lit(mix_blocks - 1)).cast("int").alias("mix_block"))


def mixed_documents(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: float | None = None, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """documents, each row as many times as the mix places it, with their own columns. A row's copies
    follow from its hash and its source's row of block_plan(), so texts are not shuffled unless there
    are more than BROADCAST sources."""
    names = docs.columns
    slim = docs.select(*(c for c in ("doc_id", "source", "text") if c in names))
    sized = materialize(_sized(slim).select("mix_source", "doc_id", "row_hash", "n_tokens"), "sized")
    sources = plan_mix(sized, target_entropy, max_repeats, budget)
    if sources.isEmpty():
        return docs
    many = block_count(sized, blocks)
    _, plan = block_plan(laid_out(sized, seed, many), sources)
    own = docs.select(F.struct(*names).alias("row"))
    keyed = own.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("row_hash"), F.coalesce("row.source", F.lit("")).alias("mix_source"))
    placed = laid_out(keyed, seed, many).join(small(plan), "mix_source").withColumn("epochs", epochs()).where("epochs > 0")
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select("row.*")
