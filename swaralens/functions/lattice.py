"""Word alignment and word-lattice scoring.

Alignment paths need a traceback, so they run in Python on Arrow batches. A row of a pair's cost table is
two integers with a bit a column. Long texts keep the moves of one block of rows at a time: other blocks
are worked out again on the way back, so texts of many thousand words fit.
Ties are broken in one order everywhere: substitution or match, then deletion, then insertion.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .lexicons import ANUSVARA, CHANDRABINDU, DEVANAGARI_DIGITS, LATTICE_DIGITS, NUKTA, SYNONYMS, literal_map
from .text import ascii_digits, col, nfc, strip, tokens

PARTS = ["substitutions", "deletions", "insertions", "ref_length", "hyp_length", "total_errors"]
ALIGNED = ArrayType(StructType([StructField("ref", StringType()), StructField("hyp", StringType())]))
SCORED = StructType([StructField("wer", DoubleType()), *(StructField(n, IntegerType()) for n in PARTS)])


def lattice_tokens(c: Column | str) -> Column:
    return tokens(nfc(strip(c)))


def form(c: Column | str) -> Column:
    """What tokens are compared by."""
    return F.lower(strip(c))


def variants(word: Column | str) -> Column:
    """Spellings that count as the same word, one step away: signs, digits, number words, synonyms."""
    w = col(word)
    to_digit, words_of = {}, {}
    for name, digit in LATTICE_DIGITS.items():
        to_digit[name] = digit
        words_of.setdefault(digit, []).append(name)
    digit = F.try_element_at(literal_map(to_digit), F.lower(w))
    names = F.try_element_at(literal_map({d: " ".join(n) for d, n in words_of.items()}), w)
    others = F.try_element_at(literal_map(SYNONYMS), w)
    listed = lambda c: F.coalesce(F.split(c, " "), F.array().cast("array<string>"))
    plain = F.array(w, F.replace(w, F.lit(ANUSVARA), F.lit(CHANDRABINDU)), F.replace(w, F.lit(CHANDRABINDU), F.lit(ANUSVARA)), F.replace(w, F.lit(NUKTA), F.lit("")), ascii_digits(w), F.coalesce(digit, w))
    found = F.concat(plain, listed(names), listed(others))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, form), lambda v: v != "")))


_NAMES: dict[str, list[str]] = {}
for _name, _digit in LATTICE_DIGITS.items():
    _NAMES.setdefault(_digit, []).append(_name)
_DIGITS = str.maketrans(DEVANAGARI_DIGITS, "0123456789")


_SIGNED = re.compile(f"[{ANUSVARA}{CHANDRABINDU}{NUKTA}{DEVANAGARI_DIGITS}]").search


@lru_cache(1 << 16)
def spellings(word: str) -> frozenset[str]:
    """variants() of a word in Python."""
    lower = word.lower()
    if word.isascii() and word not in _NAMES:
        return frozenset(filter(None, (lower.strip(),)))
    found = [word, LATTICE_DIGITS.get(lower, word), *_NAMES.get(word, ()), *SYNONYMS.get(word, "").split()]
    if _SIGNED(word):
        found += word.replace(ANUSVARA, CHANDRABINDU), word.replace(CHANDRABINDU, ANUSVARA), word.replace(NUKTA, ""), word.translate(_DIGITS)
    return frozenset(f for v in found if (f := v.strip().lower()))


#: Cells whose moves are kept at once, two bits a cell.
CELLS = 1 << 24


def _advance(rows: range, like: Callable[[int], int], rise: int, fall: int, width: int, moves: list | None = None) -> tuple[int, int]:
    """Takes a row of the cost table over some rows. A row is two integers: the bits of the columns whose
    cost is one more, and one less, than that of the column before. Moves get, a row, the cells that no
    match or substitution leads to, and of these the ones a deletion leads to."""
    full, beyond = (1 << width) - 1, (2 << width) - 1
    for i in rows:
        same = like(i)
        level = ((((same & rise) + rise) ^ rise) | same | fall) & full
        if moves is not None:
            moves.append((level ^ same, fall))
        up = (fall | (full ^ (level | rise))) << 1 | 1
        rise, fall = ((level & rise) << 1 | (beyond ^ (level | up))) & full, up & level
    return rise, fall


def bit_path(n: int, m: int, like: Callable[[int], int], block: int | None = None) -> list[tuple[int, int]]:
    """The alignment of n and m words as (i, j) pairs; -1 is a gap. like(i) has the bits of all j that
    count as equal to i. All columns of a row are worked out at once (Myers, Hyyrö)."""
    block = block or max(256, math.isqrt(n), CELLS // (m + 1))
    blocks = [range(a, min(a + block, n)) for a in range(0, n, block)]
    first = [((1 << m) - 1, 0)]
    for rows in blocks[:-1]:
        first.append(_advance(rows, like, *first[-1], m))
    out = []
    i, j = n, m
    for rows, start in zip(reversed(blocks), reversed(first)):
        moves: list[tuple[int, int]] = []
        _advance(rows, like, *start, m, moves)
        a = rows.start
        while i > a:
            if not j:
                out += [(k, -1) for k in range(i - 1, a - 1, -1)]
                i = a
                break
            gap, fall = moves[i - 1 - a]
            if not gap or not gap >> (j - 1) & 1:
                i -= 1
                j -= 1
                out.append((i, j))
            elif fall >> (j - 1) & 1:
                i -= 1
                out.append((i, -1))
            else:
                j -= 1
                out.append((-1, j))
    out += [(-1, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def path(n: int, m: int, unlike: Callable[[int], np.ndarray], block: int | None = None) -> list[tuple[int, int]]:
    """bit_path() with unlike(i) as an array that tells which j differ from i."""
    return bit_path(n, m, lambda i: int.from_bytes(np.packbits(np.equal(unlike(i), 0), bitorder="little").tobytes(), "little"), block)


def places(words: list[str]) -> dict[str, int]:
    """The bits of the places of each word."""
    found: dict[str, int] = {}
    for j, w in enumerate(words):
        found[w] = found.get(w, 0) | 1 << j
    return found


def _within(longer: list[str], shorter: list[str]) -> list[tuple[int, int]] | None:
    """The path of two lists if the shorter one's words are in the longer one in order, else None. It costs
    the difference of their lengths, the least there is, so from the end each word is met where it first can be."""
    out, j = [], len(shorter) - 1
    for i in range(len(longer) - 1, -1, -1):
        if j >= 0 and longer[i] == shorter[j]:
            out.append((i, j))
            j -= 1
        else:
            out.append((i, -1))
    return out[::-1] if j < 0 else None


def align_lowered(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The path of two lists of words in lower case; without a table where it can be told at sight."""
    n, m = len(a), len(b)
    if n == m:
        wrong = [k for k in range(n) if a[k] != b[k]]
        # If none of these words is on the other side too, each costs an edit whatever the path.
        if {a[k] for k in wrong}.isdisjoint([b[k] for k in wrong]):
            return [(k, k) for k in range(n)]
    elif n > m:
        if found := _within(a, b):
            return found
    elif found := _within(b, a):
        return [(i, j) for j, i in found]
    at = places(b)
    return bit_path(n, m, lambda i: at.get(a[i], 0))


def distance(a: list[str], b: list[str]) -> int:
    """Fewest substitutions, deletions and insertions between two lists of words as they are."""
    if len(a) == len(b):
        wrong = [k for k in range(len(a)) if a[k] != b[k]]
        if {a[k] for k in wrong}.isdisjoint([b[k] for k in wrong]):
            return len(wrong)
    at = places(b)
    rise, fall = _advance(range(len(a)), lambda i: at.get(a[i], 0), (1 << len(b)) - 1, 0, len(b))
    return len(a) + rise.bit_count() - fall.bit_count()


def align_words(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The path of two lists of words, whatever their case."""
    return align_lowered([t.lower() for t in x], [t.lower() for t in y])


def score_bins(sets: list[frozenset[str]], words: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of words against bins of forms."""
    met, most = 0, len(words)
    for forms in sets:
        if met < most and words[met] in forms:
            met += 1
    if met == most:  # all are in the bins in order: the other bins are deleted, and nothing costs less
        return 0, len(sets) - most, 0
    at = places(words)

    def like(i: int) -> int:
        out = 0
        for v in sets[i] if len(sets[i]) < 8 else sets[i] & at.keys():
            out |= at.get(v, 0)
        return out

    found = bit_path(len(sets), len(words), like)
    substituted = deleted = inserted = 0
    for i, j in found:
        if j < 0:
            deleted += 1
        elif i < 0:
            inserted += 1
        elif words[j] not in sets[i]:
            substituted += 1
    return substituted, deleted, inserted


def _aligned(pairs: Iterable[tuple[list[str] | None, list[str] | None]]) -> pa.Array:
    refs, hyps, ends, absent = [], [], [0], []
    for x, y in pairs:
        absent.append(x is None or y is None)
        if not absent[-1]:
            for i, j in align_words(x, y):
                refs.append(x[i] if i >= 0 else None)
                hyps.append(y[j] if j >= 0 else None)
        ends.append(len(refs))
    found = pa.StructArray.from_arrays([pa.array(refs, pa.string()), pa.array(hyps, pa.string())], ["ref", "hyp"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=pa.array(absent, pa.bool_()))


@F.arrow_udf(ALIGNED)
def align(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Pairs of two arrays of lattice_tokens(); a gap is null."""
    return _aligned(zip(reference.to_pylist(), hypothesis.to_pylist()))


@F.arrow_udf(ALIGNED)
def align_texts(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """align() of the lattice_tokens() of two texts, which are read in the same step."""
    words = lambda t: None if t is None else unicodedata.normalize("NFC", t).split()
    return _aligned((words(r), words(h)) for r, h in zip(reference.to_pylist(), hypothesis.to_pylist()))


@F.pandas_udf(SCORED)
def lattice_wer(bins: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Scores an array of lattice_tokens() against an array of bins (arrays of forms). The error rate
    is per bin; an empty lattice gives 0.0 and counts every token as inserted."""
    rows = []
    for b, h in zip(bins, hypothesis):
        sets = [frozenset(x) for x in (b if b is not None else ())]
        words = [t.strip().lower() for t in (h if h is not None else ())]
        s, d, n = score_bins(sets, words)
        rate = round((s + d + n) / len(sets) * 100, 2) if sets else 0.0
        rows.append((rate, s, d, n, len(sets), len(words), s + d + n))
    out = pd.DataFrame(rows, columns=["wer", *PARTS])
    return out.astype({"wer": "float64", **dict.fromkeys(PARTS, "int32")})


def verdict(standard: Column, lattice: Column) -> Column:
    return F.when(lattice < standard, "✓ fairer").when(lattice == standard, "=").otherwise("✗")
