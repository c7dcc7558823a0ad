"""SentencePiece BPE encoding by backtracking, and decoding.

The encoder never simulates the merges of a text. It walks the text with the longest vocabulary
match an Aho-Corasick automaton finds at each position, and accepts a token only if it is compatible
with its left neighbour: merging the text of the two must give the same two tokens back, which is
checked by undoing merges along their seam. When no match at a position fits, the position is
marked in a bitfield as failed and the walk steps back. A sequence whose neighbours are all
compatible is the one that merging gives, so the result is exact.

Blanks become U+2581 and one more is put in front (the model's dummy prefix). No vocabulary piece
holds that mark behind another character, so each blank starts a unit of its own; characters outside
the vocabulary never merge and also end a unit (they fall back to byte tokens). Units repeat a lot and
the results of short ones are kept in a bounded table. Pieces made of marks alone have the lowest score, all the
same one: they are merged last, from the left.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Units (of at most SHORT characters) and token pairs a worker keeps; a full table starts anew.
UNITS, PAIRS, SHORT = 200_000, 250_000, 32


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    i, n = 0, len(data)

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    while i < n:
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, i = varint(i)
            value = data[i : i + size]
            i += size
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each entry of a SentencePiece model file."""
    with open(path, "rb") as file:
        entries = [dict(_fields(v)) for k, v in _fields(file.read()) if k == 1]
    return [(e[1].decode(), struct.unpack("<f", e[2])[0], e.get(3, NORMAL)) for e in entries]


class BacktrackEncoder:
    def __init__(self, path: str, units: int = UNITS) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.eos = self.library.eos_id()
        pieces = read_pieces(path)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in normal) or any("\n" in p for p in normal):
            raise ValueError("units need pieces without a blank behind other characters and without line ends")
        self.runs = {len(p): i for p, i in normal.items() if p.strip(MARK) == ""}
        words = {p: i for p, i in normal.items() if len(p) == 1 or p.strip(MARK)}
        order = {p: k for k, p in enumerate(sorted(words, key=lambda p: (-pieces[words[p]][1], words[p])))}
        self.chars = {p for p in words if len(p) == 1}
        # A token's rank is the turn of the merge that makes it; single characters come before all merges.
        self.rank = [-1] * len(pieces)
        self.parts: list[tuple[int, int] | None] = [None] * len(pieces)
        self.length = [len(p) for p, _, _ in pieces]
        self.text = [p for p, _, _ in pieces]
        self.word_ids = words
        alive = {}
        for p in sorted(words, key=len):
            if len(p) == 1:
                alive[p] = words[p]
                continue
            self.rank[words[p]] = order[p]
            last = self._last_merge(p, order)
            if last:  # otherwise merging never makes this piece
                self.parts[words[p]] = last
                alive[p] = words[p]
        self.joined = {pair: i for i in alive.values() if (pair := self.parts[i])}
        self.shorter: list[int] = [-1] * len(pieces)
        self.automaton = ahocorasick.Automaton()
        for p, i in alive.items():
            self.automaton.add_word(p, (len(p), i))
            for cut in range(len(p) - 1, 0, -1):
                if p[:cut] in alive:
                    self.shorter[i] = alive[p[:cut]]
                    break
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.limit = units
        self.units: dict[str, tuple[int, ...]] = {}

    def _last_merge(self, piece: str, order: dict[str, int]) -> tuple[int, int] | None:
        """The two tokens the last merge of piece joins; None if merging stops before."""
        parts = list(piece)
        if any(c not in self.word_ids for c in parts):
            return None
        while len(parts) > 2:
            turns = [order.get(a + b, 1 << 60) if len(a + b) < len(piece) else 1 << 60 for a, b in zip(parts, parts[1:])]
            best = min(turns)
            whole = order[piece]
            if best == 1 << 60 or best > whole and len(parts) == 2:
                return None
            k = turns.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (self.word_ids[parts[0]], self.word_ids[parts[1]]) if len(parts) == 2 else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of left and right gives left and right again.

        Undoes the later of the two tokens' last merges again and again. If the two tokens that then
        touch at the seam have a merge that would have come before the one undone, it would have
        crossed the seam.
        """
        key = left << 20 | right
        rank, parts, joined = self.rank, self.parts, self.joined
        a, b = left, right
        # What merge a seam token is consumed by, and when; from the left side an equal turn is no threat.
        by_a = by_b = 1 << 60
        fits = True
        while True:
            made = joined.get((a, b))
            if made is not None:
                turn = rank[made]
                # At the same turn the leftmost pair merges first: the seam pair stands right of
                # the merge that consumes a, and left of the one that consumes b.
                if turn < by_a and turn <= by_b:
                    fits = False
                    break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb or (ra == rb):
                by_a, a = ra, parts[a][1]
            else:
                by_b, b = rb, parts[b][0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def unit(self, text: str) -> tuple[int, ...]:
        """Tokens of a unit whose characters are all in the vocabulary."""
        n = len(text)
        best = [-1] * n
        for end, (size, token) in self.automaton.iter(text):
            best[end - size + 1] = token
        out: list[int] = []
        failed = b""  # a bit a position, made at the first failure
        at = 0
        token = best[0]
        length, shorter, known = self.length, self.shorter, self.pairs.get
        last = -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not (failed and failed[end >> 3] >> (end & 7) & 1):
                    if last < 0:
                        break
                    fits = known(last << 20 | token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last = token
                at = end
                token = best[at] if at < n else -1
            else:
                failed = failed or bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                last = out[-1] if out else -1
        return tuple(out)

    def _fresh(self, unit: str) -> tuple[int, ...]:
        if not unit:
            return ()
        if self.chars.issuperset(unit):
            stem = self.units.get(unit[:-1])
            if stem and unit[-1] in ".,;:!?":  # a known unit with a mark behind it
                end = self.word_ids[unit[-1]]
                fits = self.pairs.get(stem[-1] << 20 | end)
                if fits or fits is None and self.compatible(stem[-1], end):
                    return *stem, end
            return self.unit(unit)
        out: list[int] = []
        held = ""
        for c in unit:
            if c in self.chars:
                held += c
                continue
            if held:
                out += self.unit(held)
                held = ""
            out += [self.bytes[b] for b in c.encode()]
        if held:
            out += self.unit(held)
        return tuple(out)

    def _miss(self, unit: str) -> tuple[int, ...]:
        out = self._fresh(unit)
        if len(unit) <= SHORT:
            if len(self.units) >= self.limit:
                self.units.clear()
            self.units[unit] = out
        return out

    def encode(self, text: str) -> list[int]:
        """The ids the library gives without begin or end."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        units = (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
        found = list(map(self.units.get, units))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self.units.get(units[k]) or self._miss(units[k])
        out = list(itertools.chain.from_iterable(found))
        return self._merge_marks(out) if MARK in units else out

    def _merge_marks(self, ids: list[int]) -> list[int]:
        mark, longest = self.runs[1], max(self.runs)
        out: list[int] = []
        run = 0
        for i in [*ids, -1]:
            if i == mark:
                run += 1
                continue
            while run:
                size = min(run, longest)
                out.append(self.runs[size])
                run -= size
            out.append(i)
        out.pop()
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> BacktrackEncoder:
    return BacktrackEncoder(path)


def piece_codes(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """documents -> (doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded]), a row for each row.

    Ids end with the model's end id; a null or empty text has that id alone and decodes to "". Very
    long texts are encoded whole. Ids and rows may repeat or be null; an empty table gives an empty
    result; further columns are ignored. path names the model file on every executor.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches):
        encoder = load(path)
        names = [str(i) for i in range(encoder.library.get_piece_size())]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for text in texts_of(batch):
                ids = encoder.encode(text)
                ids.append(encoder.eos)
                decoded = encoder.library.decode(ids)
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                rows[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    rows[3].append(ids)
                    rows[4].append(decoded)
            arrays = [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            if keep_ids:
                arrays += [pa.array(rows[3], pa.list_(pa.int32())), pa.array(rows[4], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
