"""Oversized texts cut into pieces under a token limit, at natural boundaries.

A text is tokenized once.  The tokens' byte offsets are a prefix sum, and each
kind of boundary (paragraph, line, sentence, clause, blank) becomes a sorted
array of token positions.  A piece ends at the last boundary of the strongest
kind that lies under the limit and leaves the piece at least ``least_fill`` full,
found by binary search; where there is none, it is cut hard at the last token
that ends with a whole character.  The next piece starts ``overlap`` tokens
before, or at a boundary near that place.

Pieces are spans of the text: dropping what each shares with the one before it
gives the text back.  A piece cut inside a word may take more tokens on its own
than in the text, so pieces near the limit are counted again and shortened until
they are within it.

Scale: one narrow pass, no shuffle; each text is split in the task that reads it.

Nulls and odd input: null texts, and texts within the limit, give no pieces;
repeated rows are split again under their id; a limit must be at least 8 tokens
and twice the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import tokens

KINDS = ("paragraph", "line", "sentence", "clause", "blank")
_BLANK, _BREAK, _STOP, _DOT, _CLAUSE, _CLOSE = 1, 2, 4, 8, 16, 32
_marks: np.ndarray | None = None


def _char_marks() -> np.ndarray:
    global _marks
    if _marks is None:
        marks = np.zeros(0x110000, np.uint8)
        for chars, mark in (
            (" \t\u00a0\u3000\u2002\u2003\u2007\u2009\u202f", _BLANK),
            ("\n\r\u0085\u2028\u2029", _BREAK),
            ("。！？!?…｡", _STOP),
            (".!?", _DOT),
            (",，、;；:：､", _CLAUSE),
            ("」』”’)）】》〉\"'", _CLOSE),
        ):
            for c in chars:
                marks[ord(c)] |= mark
        for c in "!?":
            marks[ord(c)] = _DOT
        _marks = marks
    return _marks


def boundaries(text: str) -> list[np.ndarray]:
    """For each kind, the character positions at which a piece may end, ascending."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = _char_marks()[codes]
    after = np.append(marks[1:], _BREAK)
    # \r\n is one line end
    is_break = (marks & _BREAK != 0) & ~((codes == 13) & (np.append(codes[1:], 0) == 10))
    line = is_break & (after & _BREAK == 0)
    # a line end closes a paragraph if nothing visible stands between it and the one before
    seen = np.cumsum(marks & (_BLANK | _BREAK) == 0)
    ends = np.flatnonzero(is_break)
    paragraph = np.zeros(len(codes), bool)
    paragraph[ends[1:][seen[ends[1:]] == seen[ends[:-1]]]] = True
    paragraph &= line
    stop = (marks & _STOP != 0) | ((marks & _DOT != 0) & (after & (_BLANK | _BREAK | _CLOSE) != 0))
    for _ in range(2):
        # closing quotes and brackets belong to the sentence
        closed = np.append(False, stop[:-1]) & (marks & _CLOSE != 0)
        stop = (stop & ~np.append(closed[1:], False)) | closed
    stop &= ~(after & (_STOP | _DOT) != 0)
    found = (paragraph, line, stop, marks & _CLAUSE != 0, marks & _BLANK != 0)
    return [np.flatnonzero(f) + 1 for f in found]


class Prepared:
    """A text's tokens and the token positions at which it may be cut, for any limit."""

    def __init__(self, tok: tokens.Tokenizer, text: str, ends: np.ndarray | None = None):
        self.text = text
        ends = tok.ends(text) if ends is None else ends
        self.n = n = len(ends)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        # byte offset of each character, and of the text's end
        offsets = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        at_char = offsets.searchsorted(ends)
        whole = offsets[at_char] == ends
        # position k: after k tokens
        self.char_of = np.append(0, at_char)
        self.safe = np.append(0, np.flatnonzero(whole) + 1)
        # the token that ends with each character, 0 if none does
        token_at = np.zeros(len(offsets), np.int64)
        token_at[at_char[whole]] = np.flatnonzero(whole) + 1
        kinds = [token_at[chars] for chars in boundaries(text)] if n else []
        self.kinds = [k[k > 0] for k in kinds]
        every = np.zeros(n + 1, bool)
        for k in self.kinds:
            every[k] = True
        self.every = np.flatnonzero(every)


class Splitter:
    def __init__(self, tok: tokens.Tokenizer, limit: int, overlap: int, least_fill: float = 0.5):
        if limit < 8 or overlap * 2 > limit or overlap < 0:
            raise ValueError("a limit must be at least 8 tokens and twice the overlap")
        self.tok, self.limit, self.overlap, self.least_fill = tok, limit, overlap, least_fill

    def split(self, text: str | Prepared) -> list[tuple[int, int, int, str]]:
        """``(start, end, tokens, kind of end)`` in characters; empty if the text is within the limit."""
        ready = text if isinstance(text, Prepared) else Prepared(self.tok, text)
        n, char_of = ready.n, ready.char_of
        if n <= self.limit:
            return []
        out, s, done = [], 0, 0
        while True:
            room = self.limit
            while True:
                e, kind = self._end(s, n, room, ready.kinds, ready.safe)
                size = e - s
                if size > self.limit - 8:
                    size = self.tok.count(ready.text[char_of[s] : char_of[e]])
                if e <= done and s < done:
                    # the overlap leaves no room for anything new
                    s, room = done, self.limit
                    continue
                if size <= self.limit or room <= 1:
                    break
                room = max(1, min(room, e - s) - max(1, size - self.limit))
            done = e
            out.append((int(char_of[s]), int(char_of[e]), size, kind))
            if e >= n:
                return out
            s = self._start(s, e, ready.every, ready.safe)

    def _end(self, s: int, n: int, room: int, kinds: list[np.ndarray], safe: np.ndarray) -> tuple[int, str]:
        if n - s <= room:
            return n, "end"
        least = s + max(self.overlap, int(room * self.least_fill))
        for name, places in zip(KINDS, kinds):
            i = places.searchsorted(s + room, "right") - 1
            if i >= 0 and places[i] > least:
                return int(places[i]), name
        i = safe.searchsorted(s + room, "right") - 1
        if safe[i] <= s:
            i += 1  # one character of more tokens than the limit leaves room for
        return int(safe[i]), "hard"

    def _start(self, s: int, e: int, every: np.ndarray, safe: np.ndarray) -> int:
        if not self.overlap:
            return e
        want, slack = e - self.overlap, max(1, self.overlap // 4)
        a, b = every.searchsorted(want - slack), every.searchsorted(want + slack, "right")
        near = every[a:b]
        if len(near):
            want = int(near[np.argmin(np.abs(near - want))])
        start = int(safe[safe.searchsorted(want)])
        return start if s < start < e else e


def split_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    limits: dict[int, tuple[int, int]],
    vocabulary: str = tokens.VOCABULARY,
    with_text: bool = True,
) -> DataFrame:
    """``limit_id, id_col, piece_no, start_char, end_char, n_tokens, ends_at[, piece]`` for each of the ``limits`` (limit id to tokens and overlap)."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t IS NOT NULL")
    kind = rows.schema["_id"].dataType.simpleString()
    for limit, overlap in limits.values():
        Splitter(None, limit, overlap)
    least = min((limit for limit, _ in limits.values()), default=0)
    # a token holds a byte at least
    rows = rows.where(F.octet_length("_t") > least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.load(vocabulary)
        splitters = [(k, Splitter(tok, *v)) for k, v in sorted(limits.items())]
        names = ["limit_id", "_id", "piece_no", "start_char", "end_char", "n_tokens", "ends_at"] + ["piece"] * with_text
        for batch in batches:
            kinds = [pa.int32(), batch.schema.field("_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns: list[list] = [[] for _ in names]
            size = 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_t").to_pylist()):
                ends = tok.ends(text)
                if len(ends) <= least:
                    continue
                ready = Prepared(tok, text, ends)
                for limit_id, splitter in splitters:
                    pieces = splitter.split(ready)
                    if not pieces:
                        continue
                    starts, stops, counts, ends_at = zip(*pieces)
                    parts = [[limit_id] * len(pieces), [doc] * len(pieces), range(len(pieces)), starts, stops, counts, ends_at]
                    if with_text:
                        parts.append([text[a:b] for a, b in zip(starts, stops)])
                    for column, part in zip(columns, parts):
                        column.extend(part)
                    size += len(text)
                if size > 1 << 21:
                    yield made()
                    columns, size = [[] for _ in names], 0
            yield made()

    schema = f"limit_id int, _id {kind}, piece_no int, start_char long, end_char long, n_tokens long, ends_at string" + ", piece string" * with_text
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
