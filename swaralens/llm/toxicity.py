"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression.

Features of a text (all densities are per word or per character): words of a toxic lexicon, as they
stand and behind obfuscation; lexicon words with a second-person word near them; capitals,
punctuation, exclamation marks and obfuscated words. The lexicon is a short fixed list plus words
that the training rows show to be toxic. Trees are fitted on histograms with logistic loss; scores
are calibrated on out-of-fold predictions: a fold's words and trees come from the other folds only.

Training reads at most `sample` labelled rows, those with the smallest hash of their doc_id, so what
the driver gathers is bounded by that parameter. Everything else is one pass over the documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod3, materialize, texts_of

SAMPLE = 8000
CUT = 0.7
FEATURES = ("log_words", "hits", "hit_rate", "learned", "learned_rate", "near", "masked", "capitals", "punctuation", "exclaims", "obfuscated", "digits", "longest_caps")

# Insults that make up the base lexicon, and second-person words.
LEXICON = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "dumb", "fool", "loser", "losers", "clown", "scum", "trash", "garbage", "pathetic", "worthless", "useless", "disgusting", "imbecile",
    "cretin", "jerk", "bastard", "bitch", "crap", "damn", "shit", "fuck", "fucking", "asshole", "whore", "slut", "retard", "pig", "vermin", "filth", "hate", "kill",
    "dumm", "dummkopf", "trottel", "abschaum", "arschloch", "schwein", "imbécile", "crétin", "ordure", "connard", "salaud", "stupide", "idiota", "estúpido", "basura", "imbécil", "cabrón", "mierda",
)
SECOND = frozenset(w.encode() for w in ("you", "your", "yours", "yourself", "ur", "u", "du", "dich", "dir", "dein", "ihr", "euch", "tu", "toi", "te", "vous", "votre", "ton", "usted", "ustedes", "vos", "tú"))
LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
#: Letters, digits and bytes of longer UTF-8 characters stay; other ASCII parts words.
PARTED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Blanks and punctuation beyond ASCII.
STOPS = re.compile("[\u00a0-\u00bf\u1680\u2000-\u206f\u2e00-\u2e7f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\ufeff]")
IS_PUNCT = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
MASKED = re.compile(rb"(?<![^\s])[A-Za-z]+[0-9@$!|*][A-Za-z0-9@$!|*]*[A-Za-z](?![A-Za-z])")
CAPS = re.compile(rb"[A-Z]{3,}(?:[^A-Za-z]+[A-Z]{2,})*")
NEAR = 6


def words_of(text: str) -> list[bytes]:
    """The words of a text, for learning and scoring alike."""
    return (text if text.isascii() else STOPS.sub(" ", text)).lower().encode().translate(PARTED).split()


def text_features(text: str, lexicon: frozenset[bytes], learned: frozenset[bytes]) -> list[float]:
    """FEATURES of a whole text; an empty one has zeros."""
    raw = text.encode()
    words = words_of(text)
    n = max(1, len(words))
    size = max(1, len(raw))
    hits = near = 0
    found = sum(map(learned.__contains__, words))
    if not lexicon.isdisjoint(words):
        at = [k for k, w in enumerate(words) if w in lexicon]
        hits = len(at)
        near = sum(not SECOND.isdisjoint(words[max(0, k - NEAR) : k + NEAR + 1]) for k in at)
    masks = MASKED.findall(raw)
    masked = 0
    for m in masks:
        plain = m.lower().translate(LEET)
        masked += plain in lexicon or plain in learned or (b"*" in m and _wild(m.lower(), lexicon))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
    runs = CAPS.findall(raw) if counts[65:91].sum() > 2 else ()
    return [
        np.log1p(len(words)), float(hits), hits / n, float(found), found / n, near / n, float(masked), counts[65:91].sum() / size, counts[IS_PUNCT].sum() / size,
        counts[33] / size, len(masks) / n, counts[48:58].sum() / size, np.log1p(max(map(len, runs), default=0)),
    ]


def _wild(word: bytes, lexicon: frozenset[bytes]) -> bool:
    pattern = re.compile(re.escape(word).replace(rb"\*", b".") + rb"\Z")
    return any(len(w) == len(word) and pattern.match(w) for w in lexicon)


@dataclass
class Trees:
    """Boosted complete trees of one depth: split features, thresholds and leaf values."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 10.0, ridge: float = 1.0) -> Trees:
    """Gradient-boosted trees with logistic loss on histograms; gains and leaves use second order."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    feature, cut, leaf = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        fs, cs = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, int)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            gain = np.full(many, 1e-6)
            for f in range(width):
                slots = local * (bins + 1) + codes[:, f]
                gs = np.bincount(slots, g, many * (bins + 1)).reshape(many, -1).cumsum(1)
                hs = np.bincount(slots, h, many * (bins + 1)).reshape(many, -1).cumsum(1)
                ns = np.bincount(slots, minlength=many * (bins + 1)).reshape(many, -1).cumsum(1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                score = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                score[(ns < least) | (nt - ns < least)] = 0
                score[:, len(cuts[f]) :] = 0
                top = score.argmax(1)
                for k in np.flatnonzero(score[np.arange(many), top] > gain):
                    gain[k] = score[k, top[k]]
                    fs[first + k], cs[first + k] = f, cuts[f][top[k]]
            node = 2 * node + 1 + (x[np.arange(n), fs[node]] > cs[node])
        local = node - inner
        value = -rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + ridge)
        margin += value[local]
        feature.append(fs)
        cut.append(cs)
        leaf.append(value)
    return Trees(base, np.array(feature), np.array(cut), np.array(leaf))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, share) of the best rising fit, by pooling adjacent violators."""
    order = np.argsort(margin, kind="stable")
    x, inverse = np.unique(margin[order], return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y[order]) / weight
    blocks: list[list[float]] = []  # share, weight, first x, last x
    for at, m, w in zip(x, mean, weight):
        blocks.append([m, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, end = blocks.pop()
            m1, w1, start, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, start, end])
    # Half a row of each kind keeps small blocks from shares of 0 and 1.
    knots = [(x, (share * n + 0.5) / (n + 1)) for share, n, first, last in blocks for x in ((first, last) if first < last else (first,))]
    xs, ys = np.array([k[0] for k in knots]), np.maximum.accumulate([k[1] for k in knots])
    return xs, ys


@dataclass
class Model:
    learned: frozenset[bytes]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]
    lexicon: frozenset[bytes] = frozenset(w.encode() for w in LEXICON)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x = np.array([text_features(t, self.lexicon, self.learned) for t in texts])
        return np.interp(self.trees.margin(x), *self.knots)


def labelled(docs: DataFrame, labels: DataFrame, sample: int, folds: int) -> DataFrame:
    """(doc_id, text, toxic, fold) of the training rows: labels whose crc32(doc_id as text) mod 3 is
    not 1. A doc_id that is labelled more than once is toxic if one of its labels is; null labels are
    left out. Equal texts share a fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    once = marks.where(crc_mod3(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int"))  # at most `sample` rows are broadcast


def _contexts(batches):
    """The distinct (word, word before) of each row, with its label and fold."""
    for batch in batches:
        for text, toxic, fold in zip(texts_of(batch), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist()):
            words = words_of(text)
            pairs = {(w, v) for v, w in zip(words, words[1:]) if len(w) > 2}
            if pairs:
                word, before = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(before, pa.binary()), pa.array([toxic] * len(pairs), pa.int32()), pa.array([fold] * len(pairs), pa.int32())], names=["word", "before", "toxic", "fold"])


def learned_words(rows: DataFrame, folds: int, most: int = 200) -> list[frozenset[bytes]]:
    """Words that training rows show to be toxic, by the words they follow: at least ten different
    ones, of which most occur in toxic rows only. Copies of a toxic text repeat its contexts, so they
    do not make its ordinary words toxic. The first set is that of all rows, then comes one for each
    fold, of the rows of the others. At most (folds + 1) x most words reach the driver."""
    pairs = rows.select("text", "toxic", "fold").mapInArrow(_contexts, "word binary, before binary, toxic int, fold int")
    parts = range(-1, folds)  # -1: no fold is left out
    contexts = pairs.groupBy("word", "before").agg(*(F.min(F.when(F.col("fold") != k, F.col("toxic"))).alias(f"bad{k + 1}") for k in parts))
    by_word = contexts.groupBy("word").agg(*(F.struct(F.sum(f"bad{k + 1}").alias("bad"), F.count(f"bad{k + 1}").alias("n")).alias(f"of{k + 1}") for k in parts))
    each = by_word.select("word", F.posexplode(F.array(*(f"of{k + 1}" for k in parts))).alias("part", "of")).select("part", "word", "of.bad", "of.n").where("bad >= 10 and bad >= 0.6 * n")
    turn = Window.partitionBy("part").orderBy(F.desc(F.col("bad") / F.col("n")), F.desc("n"), "word")
    top = each.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most).select("part", "word").collect()
    return [frozenset(bytes(r["word"]) for r in top if r["part"] == k) for k in range(folds + 1)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 4) -> Model:
    """Fits on at most `sample` labelled rows. Without labels of both kinds, every score is the share
    of toxic ones (0 if there are none)."""
    rows = materialize(labelled(docs, labels, sample, folds), "labelled")
    learned = learned_words(rows, folds)
    base = Model(learned[0], None, None)

    def run(batches):
        for batch in batches:
            x = [[f for words in learned for f in text_features(t, base.lexicon, words)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "fold")), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    got = rows.mapInArrow(run, "doc_id long, toxic int, fold int, x array<double>").orderBy("doc_id", "fold", "x").toArrow()
    y = (got["toxic"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        flat = Trees(0.0, np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8)))
        return Model(learned[0], flat, (np.array([0.0]), np.array([share])))
    x = np.array(got["x"].to_pylist()).reshape(len(y), folds + 1, len(FEATURES))
    fold = got["fold"].to_numpy()
    apart = np.empty(len(y))
    for k in range(folds):
        if (fold == k).any():
            own = x[:, k + 1]
            apart[fold == k] = boost(own[fold != k], y[fold != k]).margin(own[fold == k]) if (fold != k).any() else 0.0
    return Model(learned[0], boost(x[:, 0], y), isotonic(apart, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """documents -> (doc_id, held_out, score), a row for each row, in one pass; null texts are scored as empty."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(texts_of(batch)), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc_mod3(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score")


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted), a row for each row.

    predicted is 1 where the score reaches cut. Labels, lang, source and doc_id are never inputs of a
    score. doc_id and toxic may be of any integer type. Null ids count as not held out; repeated rows
    get equal scores; an empty table gives an empty result; further columns, whatever their names, are
    ignored.
    """
    return scored(docs, fit(docs, labels, sample)).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """documents whose score stays below cut, with their own columns."""
    model = fit(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = model.score([t or "" for t in batch.column(at).to_pylist()]) < cut
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
