"""Word lattices over many models' hypotheses, in long form.

Hypotheses are rows (utt_id, reference, model_ord, model, hyp). A lattice column is a position of the
alignments. Hypotheses are dealt by utterance once and read in its order: the alignments of one
utterance, its bins and the scores of its models are worked out where they lie, and a task holds one
utterance's texts. bins() and votes() build the same from a table of alignment columns.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.lattice import align_lowered, align_words, form, score_bins, spellings, variants, verdict
from ..functions.text import is_blank, round_even


def from_wide(sheet: DataFrame, reference: str = "Human", prefix: str = "Model ", utt_id: str = "utt_id") -> DataFrame:
    """One row a hypothesis from columns named 'Model *', in the order of the columns. Blank
    references and hypotheses are dropped."""
    models = [c for c in sheet.columns if c.startswith(prefix)]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("model_ord"), F.lit(c).alias("model"), F.col(f"`{c}`").cast("string").alias("hyp")) for k, c in enumerate(models))))
    long = sheet.select(F.col(utt_id).alias("utt_id"), F.col(reference).cast("string").alias("reference"), rows.alias("m")).select("utt_id", "reference", "m.*")
    return long.where(F.col("reference").isNotNull() & ~is_blank("reference") & F.col("hyp").isNotNull() & ~is_blank("hyp"))


def with_enough_models(hyps: DataFrame, least: int = 2) -> DataFrame:
    many = hyps.groupBy("utt_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return hyps.join(many.select("utt_id"), "utt_id", "left_semi")


#: Pairs whose alignment columns leave Python at once.
PAIRS = 512


def alignments(hyps: DataFrame) -> DataFrame:
    """(utt_id, model_ord, pos, ref, hyp): one row an alignment column of a model. A null reference or
    hypothesis has none."""
    schema = StructType([hyps.schema["utt_id"], hyps.schema["model_ord"], StructField("pos", IntegerType()), StructField("ref", StringType()), StructField("hyp", StringType())])

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(a, PAIRS)
                row, pos, ref, hyp = [], [], [], []
                for k, pair in enumerate(zip(batch.column("reference").to_pylist(), batch.column("hyp").to_pylist())):
                    if None in pair:
                        continue
                    x, y = (unicodedata.normalize("NFC", t).split() for t in pair)
                    found = align_words(x, y)
                    row += [k] * len(found)
                    pos += range(len(found))
                    ref += [x[i] if i >= 0 else None for i, _ in found]
                    hyp += [y[j] if j >= 0 else None for _, j in found]
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("utt_id").take(at), batch.column("model_ord").take(at), pa.array(pos, pa.int32()), pa.array(ref, pa.string()), pa.array(hyp, pa.string())], names=schema.names)

    return hyps.select("utt_id", "model_ord", F.col("reference").cast("string"), F.col("hyp").cast("string")).mapInArrow(run, schema)


def bins(aligned: DataFrame, mode: str = "column", threshold: float = 0.6) -> DataFrame:
    """(utt_id, position, ref, variants): the lattice. A column's reference word is the first model's
    that has one; its bin holds the variants of that word and of every model's word. With mode 'vote',
    only words that at least `threshold` of the models agree on join the reference word."""
    if mode not in ("column", "vote"):
        raise ValueError(f"unknown mode {mode}")
    columns = aligned.groupBy("utt_id", "pos").agg(F.min_by("ref", F.when(F.col("ref").isNotNull(), F.col("model_ord"))).alias("ref"), F.collect_set("hyp").alias("hyps"))
    if mode == "vote":
        agreed = votes(aligned, threshold).where(F.col("share") >= threshold).groupBy("utt_id", "pos").agg(F.collect_set("form").alias("hyps"))
        columns = columns.drop("hyps").join(agreed, ["utt_id", "pos"], "left").withColumn("hyps", F.coalesce("hyps", F.array().cast("array<string>")))
    words = F.array_compact(F.array_union(F.array("ref"), F.col("hyps")))
    merged = columns.select("utt_id", "pos", "ref", F.array_sort(F.array_distinct(F.flatten(F.transform(words, variants)))).alias("variants")).where(F.size("variants") > 0)
    return merged.withColumn("position", F.row_number().over(Window.partitionBy("utt_id").orderBy("pos")) - 1).select("utt_id", "position", "ref", "variants")


def votes(aligned: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(utt_id, pos, form, n, share, trusted): how many models have a form in a column, and whether
    that many overrule the reference word."""
    forms = aligned.where("hyp is not null").groupBy("utt_id", "pos", form("hyp").alias("form")).agg(F.count("*").alias("n"))
    refs = aligned.groupBy("utt_id", "pos").agg(F.min_by(form("ref"), F.when(F.col("ref").isNotNull(), F.col("model_ord"))).alias("ref"))
    total = F.sum("n").over(Window.partitionBy("utt_id", "pos"))
    out = forms.withColumn("share", F.col("n") / total).join(refs, ["utt_id", "pos"])
    return out.select("utt_id", "pos", "form", "n", "share", ((F.col("share") >= threshold) & ~F.col("form").eqNullSafe(F.col("ref"))).alias("trusted"))


# --- An utterance at a time -----------------------------------------------------------------------

#: Rows that leave Python at once.
ROWS = 4096
MODES = ("column", "vote")
#: What a hypothesis scores: word edits against the reference, its words, and the lattice's rate and parts.
PARTS = [("edits", IntegerType()), ("words", IntegerType()), ("lattice_wer", DoubleType()), *((c, IntegerType()) for c in ("substitutions", "deletions", "insertions", "bins", "hyp_length"))]


def shares(spark: SparkSession) -> int:
    """Into how many partitions rows are dealt for Python: not fewer than twice the cores, whatever files they are read from."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _words(text: str | None) -> list[str] | None:
    return None if text is None else unicodedata.normalize("NFC", text).split()


class Utterance:
    """The rows (model_ord, reference, hyp, ...) of an utterance in order of models, aligned: the reference
    word of each column, which is the first model's that has one, all models' words, and word edits by row."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.refs, self.hyps, self.edits = rows, [], [], []
        self.tokens: list[tuple[list[str] | None, list[str] | None]] = []
        text, x, a = None, None, []
        for order, reference, hyp, *_ in rows:
            if reference is None or reference != text:
                text, x = reference, _words(reference)
                a = [t.lower() for t in x or ()]
            y = _words(hyp)
            self.tokens.append((x, y))
            if x is None or y is None:
                self.edits.append(None)
                continue
            b = [t.lower() for t in y]
            found = align_lowered(a, b)
            self._place(found, x, y, order is not None)
            self.edits.append(sum(i < 0 or j < 0 or a[i] != b[j] for i, j in found))

    def _place(self, found: list[tuple[int, int]], x: list[str], y: list[str], ordered: bool) -> None:
        refs, hyps = self.refs, self.hyps
        for _ in range(len(found) - len(refs)):
            refs.append(None)
            hyps.append([])
        for pos, (i, j) in enumerate(found):
            if j >= 0:
                hyps[pos].append(y[j])
            if i >= 0 and refs[pos] is None and ordered:
                refs[pos] = x[i]

    def votes(self) -> Iterator[tuple[int, str, int, float]]:
        for pos, hyps in enumerate(self.hyps):
            for f, n in Counter(h.strip().lower() for h in hyps).items():
                yield pos, f, n, n / len(hyps)

    def bins(self, mode: str, threshold: float) -> list[tuple[str | None, frozenset[str]]]:
        """Reference word and forms of the columns that have any."""
        words = self.hyps
        if mode == "vote":
            words = [[] for _ in words]
            for pos, f, _, share in self.votes():
                if share >= threshold:
                    words[pos].append(f)
        out = []
        for ref, hyps in zip(self.refs, words):
            found = set(hyps)
            if ref is not None:
                found.add(ref)
            if forms := spellings(found.pop()) if len(found) == 1 else frozenset().union(*map(spellings, found)):
                out.append((ref, forms))
        return out

    def scores(self, sets: list[frozenset[str]]) -> Iterator[tuple]:
        """PARTS of each row."""
        for (x, y), edits in zip(self.tokens, self.edits):
            words = [t.lower() for t in y or ()]
            s, d, n = score_bins(sets, words)
            yield edits, None if x is None else len(x), round((s + d + n) / len(sets) * 100, 2) if sets else 0.0, s, d, n, len(sets), len(words)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(utt_id, other values of its rows) of batches whose equal ids are neighbours; nulls are one id."""
    last, rows = None, []
    for batch in batches:
        for utt_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and utt_id != last and not (utt_id != utt_id and last != last):
                yield last, rows
                rows = []
            last = utt_id
            rows.append(tuple(row))
    if rows:
        yield last, rows


def by_utterance(hyps: DataFrame, of: Callable[[object, list[tuple]], Iterable[tuple]], fields: list[tuple], columns: tuple[str, ...] = ()) -> DataFrame:
    """The rows that of(utt_id, rows) gives for each utterance: its id and the fields. Rows are (model_ord,
    reference, hyp) and further columns, in order of model_ord, nulls last."""
    given = hyps.select("utt_id", "model_ord", F.col("reference").cast("string").alias("reference"), F.col("hyp").cast("string").alias("hyp"), *columns)
    dealt = given.repartition(shares(hyps.sparkSession), "utt_id").sortWithinPartitions("utt_id", F.asc_nulls_last("model_ord"), "hyp")
    schema = StructType([hyps.schema["utt_id"], *(f if isinstance(f, StructField) else StructField(*f) for f in fields)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

        out = []
        for utt_id, rows in _grouped(batches):
            for row in of(utt_id, rows):
                out.append((utt_id, *row))
                if len(out) >= ROWS:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return dealt.mapInArrow(run, schema)


def _known(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")


def _least_share(utt_id: object, threshold: float) -> float:
    """Rows without an id have no votes."""
    return math.inf if utt_id is None else threshold


def utterance_bins(hyps: DataFrame, mode: str = "column", threshold: float = 0.6) -> DataFrame:
    """bins() of hypotheses."""
    _known(mode)

    def of(utt_id, rows):
        for k, (ref, forms) in enumerate(Utterance(rows).bins(mode, _least_share(utt_id, threshold))):
            yield k, ref, sorted(forms)

    return by_utterance(hyps, of, [("position", IntegerType()), ("ref", StringType()), ("variants", ArrayType(StringType()))])


def utterance_votes(hyps: DataFrame, threshold: float = 0.6) -> DataFrame:
    """votes() of hypotheses, with the column's reference word in place of trusted."""

    def of(utt_id, rows):
        if utt_id is None:
            return
        u = Utterance(rows)
        refs = [None if r is None else r.strip().lower() for r in u.refs]
        for pos, f, n, share in u.votes():
            yield pos, f, n, share, refs[pos]

    found = by_utterance(hyps, of, [("pos", IntegerType()), ("form", StringType()), ("n", LongType()), ("share", DoubleType()), ("ref", StringType())])
    return found.select("utt_id", "pos", "form", "n", "share", ((F.col("share") >= threshold) & ~F.col("form").eqNullSafe(F.col("ref"))).alias("trusted"))


def lattices(hyps: DataFrame, mode: str = "column", threshold: float = 0.6) -> DataFrame:
    """(utt_id, lattice): bins in order of position."""
    _known(mode)

    def of(utt_id, rows):
        if found := Utterance(rows).bins(mode, _least_share(utt_id, threshold)):
            yield ([sorted(forms) for _, forms in found],)

    return by_utterance(hyps, of, [("lattice", ArrayType(ArrayType(StringType())))])


def _standard(edits: Column, words: Column, hyp_length: Column) -> Column:
    """The standard error rate; no words give 1.0, or 0.0 for an empty hypothesis."""
    return F.when(words == 0, F.when(hyp_length > 0, 1.0).otherwise(0.0)).otherwise(round_even(edits / words * 100, 2))


def _scores(hyps: DataFrame, mode: str, threshold: float, least: int = 1) -> DataFrame:
    """evaluate(), and with it `first`: 1 for one row of each utterance, 0 elsewhere. Utterances with
    fewer than `least` hypotheses are left out, and with a least of several those without an id too."""
    _known(mode)

    def of(utt_id, rows):
        if least > 1 and (utt_id is None or len(rows) < least):
            return
        if utt_id is None:  # rows without an id share no lattice
            for row in rows:
                for score in Utterance([row]).scores([]):
                    yield row[0], row[3], *score, 0
            return
        u = Utterance(rows)
        sets = [forms for _, forms in u.bins(mode, threshold)]
        for k, (row, score) in enumerate(zip(rows, u.scores(sets))):
            yield row[0], row[3], *score, int(k == 0)

    found = by_utterance(hyps, of, [hyps.schema["model_ord"], hyps.schema["model"], *PARTS, ("first", IntegerType())], ("model",))
    rated = found.withColumn("standard_wer", _standard(F.col("edits"), F.col("words"), F.col("hyp_length")))
    return rated.select("utt_id", "model_ord", "model", "standard_wer", "lattice_wer", "substitutions", "deletions", "insertions", "bins", "hyp_length", (F.col("lattice_wer") < F.col("standard_wer")).alias("improved"), verdict(F.col("standard_wer"), F.col("lattice_wer")).alias("verdict"), "first")


def evaluate(hyps: DataFrame, mode: str = "column", threshold: float = 0.6) -> DataFrame:
    """Scores of every hypothesis: standard and lattice error rate, their parts, and whether the
    lattice is fairer. Utterances without a lattice score 0.0 on it."""
    return _scores(hyps, mode, threshold).drop("first")


def lattice_report(hyps: DataFrame, mode: str = "column", threshold: float = 0.6) -> DataFrame:
    """One row an utterance: reference, threshold, the lattice (position, its variants and how many),
    and each model's scores with its verdict, in order of models."""
    _known(mode)
    raw = StructType([hyps.schema["model_ord"], hyps.schema["model"], *(StructField(*p) for p in PARTS)])
    names = raw.names

    def of(utt_id, rows):
        reference = rows[0][1] if rows[0][0] is not None else None
        if utt_id is None:  # rows without an id share no lattice
            yield reference, None, None
            return
        u = Utterance(rows)
        sets = [forms for _, forms in u.bins(mode, threshold)]
        yield reference, [sorted(forms) for forms in sets] or None, [dict(zip(names, (row[0], row[3], *score))) for row, score in zip(rows, u.scores(sets))]

    found = by_utterance(hyps, of, [("reference", StringType()), ("forms", ArrayType(ArrayType(StringType()))), ("raw", ArrayType(raw))], ("model",))
    bin_ = lambda v, k: F.struct(k.alias("position"), v.alias("variants"), F.size(v).alias("size"))

    def rated(m: Column) -> Column:
        standard, lattice = _standard(m["edits"], m["words"], m["hyp_length"]), m["lattice_wer"]
        kept = lambda *fields: (m[f].alias(f) for f in fields)
        return F.struct(*kept("model_ord", "model", "hyp_length"), standard.alias("standard_wer"), *kept("lattice_wer", "substitutions", "deletions", "insertions"), (lattice < standard).alias("improved"), verdict(standard, lattice).alias("verdict"))

    return found.select("utt_id", "reference", F.lit(threshold).alias("threshold"), F.coalesce(F.size("forms"), F.lit(0)).alias("bins"), F.transform("forms", bin_).alias("lattice"), F.transform("raw", rated).alias("models"))


def averages(hyps: DataFrame, mode: str = "column", threshold: float = 0.6, least: int = 1) -> DataFrame:
    """model_averages() of hypotheses, over the utterances with at least `least` of them. Scores are
    worked out once and added up as hundredths, which is exact."""
    hundredths = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")) / 100
    sums = _scores(hyps, mode, threshold, least).groupBy("model").agg(hundredths("standard_wer").alias("a"), hundredths("lattice_wer").alias("b"), F.count("*").alias("n"), F.sum("first").alias("u"))
    return _averaged(sums.withColumn("utterances", F.sum("u").over(Window.partitionBy())), 2)  # a row a model


def model_averages(scores: DataFrame, digits: int = 2) -> DataFrame:
    """Mean rates of each model over *all* utterances, also those it has no hypothesis for."""
    n = scores.agg(F.countDistinct("utt_id").alias("utterances"))
    sums = scores.groupBy("model").agg(F.sum("standard_wer").alias("a"), F.sum("lattice_wer").alias("b"), F.count("*").alias("n"))
    return _averaged(sums.crossJoin(n), digits)  # one row


def _averaged(rates: DataFrame, digits: int) -> DataFrame:
    average = lambda c: round_even(F.col(c) / F.col("utterances"), digits)
    return rates.select("model", "n", "utterances", average("a").alias("standard_wer"), average("b").alias("lattice_wer")).withColumn("improved", F.col("lattice_wer") < F.col("standard_wer"))
