"""Oversize texts cut into pieces at natural boundaries by balanced targets (problem 10).

The least number of pieces is computed first, then equal-length targets; each target moves to the strongest
boundary near it: end of a paragraph, of a sentence, of a line, of a word. If a piece cannot keep the limit, more
pieces are used. Consecutive pieces share the given number of tokens, or up to three more where a character
spans tokens.

Natural boundaries lie before a blank or after a full-width sentence mark, where the tokenizer's pattern splits
in any case: so the tokens of a piece are those of the text, but for the first word where the overlap begins
inside it; that word alone is measured again, and ``n_tokens`` is what encoding the piece gives.

Defined results: an overlap that leaves less than ``ROOM`` tokens is an error; null, empty and fitting texts have no pieces; the pieces without their overlaps, joined, are
the text; a stretch without any boundary that is longer than the limit is cut between characters, and it alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.encoding import FOLDER, Vocabulary, vocabulary

_END = re.compile(r"(?<=\S)\s+|(?<=[。！？])(?=[^\s。！？」』）])")
_CLOSING = "\"'”’»)]」』）"
PARAGRAPH, SENTENCE, LINE, WORD = 4, 3, 2, 1
NEAR = 0.25
"""A target moves by up to this share of a piece to reach a stronger boundary."""
ROOM = 8
"""A piece must have room for so many tokens beside the overlap, as a character may span several."""


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Character positions that end a paragraph, sentence, line or word, ascending, and their strengths."""
    at, strength = [], []
    last = len(text.rstrip())
    for m in _END.finditer(text):
        p = m.start()
        if p >= last:
            break
        run = m[0]
        q = p - 1
        if q > 0 and text[q] in _CLOSING:
            q -= 1
        if run.count("\n") > 1:
            s = PARAGRAPH
        elif text[q] in ".?!…。！？":
            s = SENTENCE
        elif "\n" in run:
            s = LINE
        else:
            s = WORD
        at.append(p)
        strength.append(s)
    return at, strength


class Cutter:
    """One text, its tokens and its boundaries, for any number of limits."""

    def __init__(self, text: str, ids: np.ndarray, vocabulary_: Vocabulary):
        self.text, self.v, self.n = text, vocabulary_, len(ids)
        ends = np.concatenate(([0], np.cumsum(vocabulary_.lengths[ids], dtype=np.int64)))
        if len(text) == ends[-1]:  # one byte a character
            self.char = ends
            self.whole = np.ones(self.n + 1, bool)
        else:
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            starts = (data & 0xC0) != 0x80
            before = np.concatenate(([0], np.cumsum(starts)))
            self.char = before[ends]
            self.whole = np.concatenate((starts, [True]))[ends]
        at, strength = boundaries(text)
        if at:
            at_, strength_ = np.array(at), np.array(strength)
            token = np.searchsorted(self.char, at_, side="right") - 1  # of ends within one character, the last is whole
            fits = (self.char[token] == at_) & self.whole[token]
            self.cuts, self.strong = token[fits].tolist(), strength_[fits].tolist()
        else:
            self.cuts, self.strong = [], []

    def _head(self, s: int, capacity: int) -> int:
        """By how many tokens a piece from token ``s`` differs from the text's own tokens; of a stretch that no piece can
        hold, by its beginning."""
        k = bisect_left(self.cuts, s)
        if s == 0 or (k < len(self.cuts) and self.cuts[k] == s):
            return 0
        e = self.cuts[k] if k < len(self.cuts) else self.n
        e = min(e, s + max(4096, 2 * capacity))
        return len(self.v.ids(self.text[self.char[s] : self.char[e]])) - (e - s)

    def _start(self, e: int, overlap: int) -> int:
        s = max(0, e - overlap)
        while not self.whole[s]:
            s -= 1
        return s

    def _between(self, low: float, high: float, target: float) -> int | None:
        """The strongest boundary from ``low`` to ``high``, of equals the nearest to the target."""
        a, b = bisect_left(self.cuts, low), bisect_right(self.cuts, high)
        return self.cuts[max(range(a, b), key=lambda k: (self.strong[k], -abs(self.cuts[k] - target)))] if a < b else None

    def pieces(self, capacity: int, overlap: int) -> list[tuple[int, int, int]]:
        """``(start, end, tokens)`` of each piece in tokens of the text; ``tokens`` as the piece itself encodes."""
        if not 0 <= overlap <= capacity - ROOM:
            raise ValueError(f"an overlap of {overlap} leaves no room for a character in pieces of {capacity}")
        count = max(2, -(-(self.n - overlap) // (capacity - overlap)))
        # With as many pieces as tokens the targets are so near that boundaries within the limit are always taken, so this ends.
        while (made := self._balanced(count, capacity, overlap)) is None:
            count += max(1, count // 16)
        return made

    def _balanced(self, count: int, capacity: int, overlap: int) -> list[tuple[int, int, int]] | None:
        """Pieces around equal targets; None if ``count`` of them cannot keep the limit."""
        out: list[tuple[int, int, int]] = []
        s, e = 0, 0
        while True:
            head = self._head(s, capacity)
            if self.n - s + head <= capacity:
                return [*out, (s, self.n, self.n - s + head)]
            left = count - len(out)
            if left < 2:
                return None
            length = (self.n - s + (left - 1) * overlap) / left
            low, high = max(e, s + overlap) + 1, s + capacity - head
            near = NEAR * length
            cut = self._between(max(low, s + length - near), min(high, s + length + near), s + length)
            if cut is None:
                cut = self._between(low, high, s + length)
            if cut is None:
                cut, size = self._within(s, e, max(low, min(high, int(s + length))), capacity)
            else:
                size = cut - s + head
            out.append((s, cut, size))
            e, s = cut, self._start(cut, overlap)

    def _within(self, s: int, e: int, cut: int, capacity: int) -> tuple[int, int]:
        """The last end between characters up to ``cut`` and after ``e`` that keeps the limit, and the piece's tokens."""
        while True:
            while not self.whole[cut] and cut > e + 1:
                cut -= 1
            size = len(self.v.ids(self.text[self.char[s] : self.char[cut]]))
            if size <= capacity or cut <= e + 1:
                return cut, size
            cut = max(e + 1, cut - (size - capacity))


def split(documents: DataFrame, limits: DataFrame, prefix: str = "cut_", folder: str = FOLDER, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every text longer than a ``prefix`` capacity of ``limits``.

    ``(setting_name, doc_id, piece_no, start_char, end_char, overlap_chars, n_tokens, piece)``; whole texts are
    encoded once for each tokenizer, in the scan, and nothing is shuffled.
    """
    schema = "setting_name string, doc_id long, piece_no int, start_char int, end_char int, overlap_chars int, n_tokens int, piece string"
    rows = limits.filter(F.col("setting_name").startswith(prefix) & (F.col("capacity") > 0)).select("setting_name", "tokenizer", "capacity", "overlap").distinct().collect()
    out = None
    for tokenizer in sorted({r.tokenizer for r in rows}):
        settings = sorted((r.setting_name, r.capacity, r.overlap or 0) for r in rows if r.tokenizer == tokenizer)
        get = vocabulary(documents.sparkSession, tokenizer, folder)

        def run(batches, settings=settings, get=get):
            v = get()
            least = min(c for _, c, _ in settings)
            for b in batches:
                made: list[tuple] = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if not t or len(t.encode("utf-8", "surrogatepass")) <= least:
                        continue
                    ids = v.ids(t)
                    if len(ids) <= least:
                        continue
                    cutter = Cutter(t, ids, v)
                    for name, capacity, overlap in settings:
                        if len(ids) <= capacity:
                            continue
                        before = 0
                        for k, (s, e, size) in enumerate(cutter.pieces(capacity, overlap)):
                            p, q = int(cutter.char[s]), int(cutter.char[e])
                            made.append((name, i, k, p, q, before - p if k else 0, size, t[p:q]))
                            before = q
                cols = list(zip(*made)) if made else [[] for _ in range(8)]
                kinds = [pa.string(), pa.int64(), *[pa.int32()] * 5, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["setting_name", "doc_id", "piece_no", "start_char", "end_char", "overlap_chars", "n_tokens", "piece"])

        made = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out if out is not None else documents.sparkSession.createDataFrame([], schema)
