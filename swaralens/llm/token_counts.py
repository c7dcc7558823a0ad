"""Token counts of whole texts; huge texts by overlapping chunks that are spliced where it is proven safe.

A text of up to CHUNK characters is encoded at once. A longer one is cut into chunks that overlap;
each chunk is encoded on its own, with the offsets of its tokens. Two neighbours are joined at a
*stable common boundary* of their overlap:

- merge-type models (SentencePiece BPE): a token that both chunks place on the same characters. A
  BPE result is right exactly if each pair of neighbouring tokens is one that merging the pair's own
  text gives back. The pairs up to the shared token come from the left chunk and those after it from
  the right one, so the spliced sequence is the result for the whole text. A right chunk starts at a
  token of the left one and is encoded without the blank that the model puts before a text, so even
  in a run of one character the two agree from the start.
- models that split words first (tokenizers JSON files): a space after a non-space and before a
  letter or digit, at which both chunks begin a token. No word the splitter makes crosses it, and
  what follows does not depend on what stands before.

If an overlap has no such boundary, the overlap and the chunk are doubled and the right chunk is
encoded again, back to the start of the text at most. As both grow, a text without any boundary costs
a few times its length, not its square. No token is ever estimated.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

CHUNK, OVERLAP = 8192, 256
#: Tokens whose spans are kept for further overlaps, 16 bytes each.
HELD = 1 << 20
LIMIT = 4096


#: A model's normaliser without the blank before a text: a later field overrules an earlier one.
NO_BLANK = b"\x1a\x02\x18\x00"


class PieceModel:
    """A SentencePiece BPE model; spans are in characters of the text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            proto = file.read()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=proto + NO_BLANK)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.width = np.array([1 if b else len(self.model.id_to_piece(i)) for i, b in enumerate(self.is_byte)])

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def spans(self, text: str, first: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Token starts and ends; the tokens of one character's bytes share its span. first: the text
        starts here, so a blank stands before it, at -1."""
        ids = np.array((self.model if first else self.inner).encode(text), np.int64)
        width = self.width[ids].copy()
        bytes_at = np.flatnonzero(self.is_byte[ids])
        if len(bytes_at):
            lead = self._leads(ids[bytes_at])
            width[bytes_at] = lead
        ends = np.cumsum(width)
        starts = ends - width
        if len(bytes_at):  # a character's later bytes get its span as well
            cont = np.zeros(len(ids), bool)
            cont[bytes_at] = lead == 0
            starts[cont] -= 1
        return starts - first, ends - first

    def _leads(self, ids: np.ndarray) -> np.ndarray:
        value = np.array([int(self.model.id_to_piece(int(i))[3:5], 16) for i in ids])
        return (value & 0xC0 != 0x80).astype(np.int64)

    def restart(self, text: str, starts: np.ndarray, before: int) -> int:
        """Where a chunk may start: the last token that starts at or before a position; 0: the text's start."""
        k = int(np.searchsorted(starts, before, "right")) - 1
        return max(0, int(starts[k])) if k > 0 else 0

    def common(self, text: str, left, right) -> tuple[int, int] | None:
        """How many tokens of the left chunk to keep and of the right one to leave out."""
        wide = len(text) + 2
        a, b = left[0] * wide + left[1], right[0] * wide + right[1]
        shared = np.intersect1d(a, b)
        if not len(shared):
            return None
        pick = shared[len(shared) // 2]
        return int(np.searchsorted(a, pick, "right")), int(np.searchsorted(b, pick, "right"))


class WordModel:
    """A tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def spans(self, text: str, first: bool = True) -> tuple[np.ndarray, np.ndarray]:
        offsets = self.model.encode(text, add_special_tokens=False).offsets
        array = np.array(offsets, np.int64).reshape(-1, 2)
        starts = array[:, 0].copy()
        for k in np.flatnonzero(np.diff(starts, prepend=-1) > 0):  # offsets may leave out the blank before a word
            if starts[k] and text[starts[k] - 1] == " " and (k == 0 or array[k - 1, 1] < starts[k]):
                starts[k] -= 1
        return starts, array[:, 1]

    def restart(self, text: str, starts: np.ndarray, before: int) -> int:
        return max(0, before)

    def common(self, text: str, left, right) -> tuple[int, int] | None:
        shared = np.intersect1d(left[0], right[0][1:])
        shared = shared[[0 < p < len(text) - 1 and text[p] == " " and not text[p - 1].isspace() and text[p + 1].isalnum() for p in shared.tolist()]] if len(shared) else shared
        if not len(shared):
            return None
        cut = shared[len(shared) // 2]
        return int(np.searchsorted(left[0], cut)), int(np.searchsorted(right[0], cut))


@functools.lru_cache(maxsize=4)
def load(path: str):
    return PieceModel(path) if path.endswith(".model") else WordModel(path)


def huge_count(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, held: int = HELD) -> int:
    """Tokens of a text of any length, a chunk at a time; the spans of the last `held` tokens are kept."""
    at = min(chunk, len(text))
    done, left = 0, model.spans(text[:at])
    while at < len(text):
        wide, step = overlap, chunk
        while True:
            to = min(len(text), at + step)
            begin = model.restart(text, left[0], at - wide) if at > wide else 0
            if begin <= 0 or done and begin <= left[0][0]:  # nothing is stable in all that is kept
                done, left = 0, model.spans(text[:to])
                break
            starts, ends = model.spans(text[begin:to], False)
            starts, ends = starts + begin, ends + begin
            cut = model.common(text, left, (starts, ends))
            if cut:
                left = np.r_[left[0][: cut[0]], starts[cut[1] :]], np.r_[left[1][: cut[0]], ends[cut[1] :]]
                break
            wide, step = 2 * wide, max(2 * step, 2 * wide)
        if len(left[0]) > 2 * held:
            done, left = done + len(left[0]) - held, (left[0][-held:], left[1][-held:])
        at = to
    return done + len(left[0])


def count_tokens(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    model = load(path)
    out = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= chunk]
    for i, n in zip(short, model.count([texts[i] for i in short])):
        out[i] = n
    for i, t in enumerate(texts):
        if len(t) > chunk:
            out[i] = huge_count(model, t, chunk, overlap)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """documents -> (doc_id, n_bytes, n_tokens, over_limit), a row for each row.

    path names a tokenizers .json or SentencePiece .model file on every executor. A null text counts
    as empty (0 bytes, 0 tokens); ids may be null or repeated; an empty table gives an empty result;
    further columns are ignored. No text is cut short.
    """

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            counts = count_tokens(texts, path, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
