"""Evaluation passages inside a large corpus: size-partitioned MinHash containment search.

Every test item and every document is brought to plain letters (no case, width,
accents, punctuation, blanks, marks at line starts) and cut into shingles of
``SHINGLE`` letters.

Search.  A long document's sketch drowns a short item, so documents are read in
overlapping windows and the items are partitioned by size: an item of ``S``
shingles is sought in windows of about two thirds of ``S``, a quarter of a
window apart.  A window that holds the stretch asked for has at least a Jaccard
similarity ``J`` with the item that follows from the stretch, the size ratio and
the misreadings allowed for; windows whose ``hashes`` minima agree with the
item's in at least ``t`` places are candidates, where ``t`` is the largest
number that misses a true window with a probability of at most ``miss``.  Minima
are taken once per block of 16 shingles and joined, so all size partitions and
all blocks of items share them.

Verification.  For each candidate the exact shingles shared by item and document
are placed on the item; those near one diagonal, without a hole of more than
``HOLE`` letters, make the stretch.  It must reach over the letters asked for,
but for one shingle at its ends, and its share of the item's shingles what the
misreadings allowed for leave.
Every candidate is verified and none is capped.

Short items.  Below ``SHORT`` letters too few shingles are left for sketches, so
these items are joined exactly: a stretch of ``h`` letters with at most ``m``
misread ones (one in ``MISREAD``) has at least one of its ``m + 1`` parts whole;
every run of that many letters is looked up, and the letters on its diagonal are
compared.

Scale: documents are read once for each ``PASS_BLOCKS`` blocks of items and
never shuffled; only matches leave the tasks.  The items are a stated query set:
they are broadcast in blocks of about ``BLOCK_LETTERS`` letters, and a pass
loops over its blocks with the shingles and minima of a document made once.

Nulls and odd input: null, empty and letterless texts match nothing; very long
documents are read in overlapping pieces, at least twice as long as their
overlap, which is twice the longest item; a document that holds an item several
times gives one row with its best stretch; repeated rows give repeated ids once.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 6
BASE = 16
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24)
HOLE = 40
BLOCK_LETTERS = 2_000_000
PASS_BLOCKS = 8
PIECE = 1 << 20
SHORT = 64
MISREAD = 8
_MARKS = re.compile(r"(?m)^[ \t　]*(?:[>#*+|•・·◆■□●○※→–—-]+[ \t　]*|[(（]?\d{1,3}[.)、）][ \t　]+|\[[\d:.]+\][ \t　]*)+")
_MULT = np.uint32(0x9E3779B1)
_table: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Code point to plain letter, 0 for what does not count."""
    global _table
    if _table is None:
        table = np.zeros(0x110000, np.uint32)
        for cp in [*range(0x323B0), *range(0xE0000, 0xE0200)]:
            if 0xD800 <= cp < 0xE000:
                continue
            ch = chr(cp)
            if 0xAC00 <= cp < 0xD7A4 or 0x4E00 <= cp < 0xA000 or 0x3400 <= cp < 0x4DC0 or 0x20000 <= cp < 0x2F800:
                table[cp] = cp if ch.isalnum() else 0
                continue
            plain = next((c for c in unicodedata.normalize("NFKD", ch).casefold() if c.isalnum()), None)
            table[cp] = ord(plain) if plain else 0
        _table = table
    return _table


def letters(text: str) -> np.ndarray:
    codes = np.frombuffer(_MARKS.sub("", text).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = letter_table()[codes]
    return out[out != 0]


def shingles(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash for each run of SHINGLE letters."""
    n = len(codes) - SHINGLE + 1
    if n < 1:
        if not len(codes):
            return np.zeros(0, np.uint32)
        codes, n = np.concatenate([codes, np.zeros(SHINGLE - len(codes), np.uint32)]), 1
    h = np.zeros(n, np.uint32)
    for j in range(SHINGLE):
        h *= np.uint32(0x01000193)
        h ^= codes[j : j + n] * _MULT
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def least_matches(j: float, hashes: int, miss: float) -> int:
    """The largest t with P(Binomial(hashes, j) < t) <= miss; at least 1."""
    t, below = 0, 0.0
    while t < hashes:
        below += math.comb(hashes, t) * j**t * (1 - j) ** (hashes - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def window_blocks(size: int) -> int:
    """Width, in blocks, of the windows in which an item of so many shingles is sought."""
    want, unit = size * 2 / 3 / BASE, 1
    while want > WIDTHS[-1]:
        want, unit = want / 8, unit * 8
    return min(WIDTHS, key=lambda w: abs(math.log(w / max(want, 1e-9)))) * unit


def least_jaccard(size: int, stretch: float, width: int, stride: int, noise: float) -> float:
    """Similarity of the item and the best window over a stretch, wherever it lies."""
    fits = stretch * size
    seen = min(fits, width) - max(0.0, (stride - abs(width - fits)) / 2)
    return seen * noise / (size + width - seen * noise)


def least_share(size: int, stretch: float, noise: float) -> float:
    """Share of an item's ``size`` shingles in the stretch asked for, with the misreadings allowed for."""
    wanted = math.ceil(stretch * (size + SHINGLE - 1)) - SHINGLE + 1
    return noise * max(1, wanted) / size


class ItemIndex:
    """The items of one block: shingles for verification, signatures by size partition."""

    def __init__(self, items: list[tuple[int, str]], stretch: float, min_share: float | None, hashes: int, noise: float, miss: float, least_noise: float = 0.6, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mult = (rng.integers(0, 1 << 31, hashes, dtype=np.int64) * 2 + 1).astype(np.uint32)
        self.xor = rng.integers(0, 1 << 32, hashes, dtype=np.int64).astype(np.uint32)
        self.hashes = hashes
        self.ids, self.sorted, self.place, self.least, self.span = [], [], [], [], []
        parts: dict[int, list[int]] = {}
        signatures = []
        for item_id, text in items:
            sh = shingles(letters(text))
            if not len(sh):
                continue
            order = np.argsort(sh, kind="stable")
            parts.setdefault(window_blocks(len(sh)), []).append(len(self.ids))
            self.ids.append(item_id)
            self.sorted.append(sh[order])
            self.place.append(order)
            self.least.append(least_share(len(sh), stretch, least_noise) if min_share is None else min_share)
            # a misreading near an end of the stretch hides the letters before it
            self.span.append(math.ceil(stretch * (len(sh) + SHINGLE - 1)) - SHINGLE if min_share is None else 0)
            signatures.append(((np.unique(sh)[None, :] ^ self.xor[:, None]) * self.mult[:, None]).min(1))
        self.longest = max(map(len, self.sorted), default=0)
        self.parts = {}
        for width, members in sorted(parts.items()):
            stride = max(1, width // 4)
            worst = min(least_jaccard(len(self.sorted[m]), stretch, width * BASE, stride * BASE, noise) for m in members)
            sig = np.stack([signatures[m] for m in members], 1)
            order = np.argsort(sig, axis=1, kind="stable")
            values = np.take_along_axis(sig, order, 1)
            filters = np.zeros((hashes, 1 << 16), bool)
            filters[np.arange(hashes)[:, None], values & 0xFFFF] = True
            self.parts[width] = (stride, np.array(members), values, order, filters, least_matches(worst, hashes, miss))

    def block_minima(self, sh: np.ndarray) -> np.ndarray:
        """(hashes, blocks) minima over blocks of BASE shingles; the last block is padded with its own shingles."""
        blocks = -(-len(sh) // BASE)
        if blocks * BASE > len(sh):
            sh = np.concatenate([sh, np.full(blocks * BASE - len(sh), sh[-1], np.uint32)])
        out = np.empty((self.hashes, blocks), np.uint32)
        step = 512
        for at in range(0, blocks, step):
            part = np.ascontiguousarray(sh[at * BASE : (at + step) * BASE].reshape(-1, BASE).T)
            buf = np.empty_like(part)
            for k in range(self.hashes):
                np.bitwise_xor(part, self.xor[k], out=buf)
                np.multiply(buf, self.mult[k], out=buf)
                np.minimum.reduce(buf, axis=0, out=out[k, at : at + step])
        return out

    def candidates(self, sh: np.ndarray, minima: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """``item, from, to`` in shingle positions, runs of candidate windows joined."""
        sliding, reach = self.block_minima(sh) if minima is None else minima, 1
        for width, (stride, members, values, order, filters, t) in self.parts.items():
            while reach * 2 <= width:
                # minima over ``reach`` blocks from every block on, doubled
                grown = sliding.copy()
                np.minimum(grown[:, :-reach], sliding[:, reach:], out=grown[:, :-reach])
                sliding, reach = grown, reach * 2
            windows = sliding[:, ::stride]
            if width > reach:
                # the rest of the width, by an overlapping power of two
                rest = sliding[:, width - reach :: stride]
                windows = windows.copy()
                np.minimum(windows[:, : rest.shape[1]], rest, out=windows[:, : rest.shape[1]])
            found = []
            for k in range(self.hashes):
                hit = np.flatnonzero(filters[k][windows[k] & 0xFFFF])
                if not len(hit):
                    continue
                v = windows[k][hit]
                left, right = np.searchsorted(values[k], v, "left"), np.searchsorted(values[k], v, "right")
                n = right - left
                keep = n > 0
                if not keep.any():
                    continue
                hit, left, n = hit[keep], left[keep], n[keep]
                where = np.repeat(left - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                found.append(np.repeat(hit, n) * len(members) + order[k][where])
            if not found:
                continue
            pair, count = np.unique(np.concatenate(found), return_counts=True)
            pair = pair[count >= t]
            win, item = pair // len(members), pair % len(members)
            by = np.lexsort((win, item))
            win, item = win[by], item[by]
            new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (win[1:] > win[:-1] + 2)]) if len(win) else []
            for a, b in zip(new, [*new[1:], len(win)]):
                yield int(members[item[a]]), int(win[a]) * stride * BASE, (int(win[b - 1]) * stride + width) * BASE

    def stretch(self, sh: np.ndarray, item: int) -> float:
        """Share of the item's shingles in its longest stretch in these shingles."""
        hashes, place = self.sorted[item], self.place[item]
        total = len(hashes)
        left = np.searchsorted(hashes, sh, "left")
        known = np.flatnonzero(hashes[np.minimum(left, total - 1)] == sh)
        if len(known) < self.least[item] * total:
            return 0.0
        left = left[known]
        n = np.searchsorted(hashes, sh[known], "right") - left
        j = place[np.repeat(left - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        d = np.repeat(known, n) - j
        by = np.argsort(d, kind="stable")
        d, j = d[by], j[by]
        counts = np.searchsorted(d, d + max(16, total // 12), "right") - np.arange(len(d))
        best, last = 0.0, None
        # bands of diagonals, fullest first, until none can hold more than the best stretch
        for a in np.argsort(-counts, kind="stable"):
            if counts[a] <= max(best, self.least[item] * 0.999) * total:
                break
            if last is not None and d[a] == last:
                continue
            last = d[a]
            js = np.unique(j[a : a + counts[a]])
            cut = np.r_[0, np.flatnonzero(np.diff(js) > HOLE) + 1, len(js)]
            long = js[cut[1:] - 1] - js[cut[:-1]] + SHINGLE >= self.span[item]
            if long.any():
                best = max(best, float(np.diff(cut)[long].max()) / total)
        return best

    def leaks(self, batch: Batch) -> Iterator[tuple[int, int, float]]:
        """``document, item id, share`` for a batch of documents."""
        if not len(batch.shingles) or not self.ids:
            return
        if batch.minima is None:
            batch.minima = self.block_minima(batch.shingles)
        sh, starts = batch.shingles, batch.starts
        regions: dict[tuple[int, int], tuple[int, int]] = {}
        for item, lo, hi in self.candidates(sh, batch.minima):
            margin = len(self.sorted[item])
            lo, hi = max(0, lo - margin), min(len(sh), hi + margin)
            for doc in range(np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")):
                a, b = max(lo, int(starts[doc])), min(hi, int(starts[doc + 1]))
                if b > a:
                    old = regions.get((doc, item), (a, b))
                    regions[doc, item] = (min(a, old[0]), max(b, old[1]))
        for (doc, item), (a, b) in regions.items():
            share = self.stretch(sh[a:b], item)
            if share >= self.least[item]:
                yield doc, self.ids[item], share


class Batch:
    """The letters of some documents, with their shingles; the minima are filled in by the first index that needs them."""

    def __init__(self, docs: list[np.ndarray]):
        self.docs = docs
        parts = [shingles(d) for d in docs]
        self.starts = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
        self.shingles = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        self.minima: np.ndarray | None = None


def _runs(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` letters."""
    size = len(codes) - n + 1
    if size < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[j : j + size]
        h ^= h >> np.uint64(29)
    return h


class ShortIndex:
    """Items below ``SHORT`` letters, by length: exact runs as seeds, letters compared on the diagonal."""

    def __init__(self, items: list[tuple[int, np.ndarray]], stretch: float):
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, codes in items:
            by_length.setdefault(len(codes), []).append((item_id, codes))
        self.lengths = []
        for length, members in sorted(by_length.items()):
            wanted = max(1, math.ceil(stretch * length))
            wrong = wanted // MISREAD
            seed = wanted // (wrong + 1)
            runs = np.stack([_runs(c, seed) for _, c in members])
            order = np.argsort(runs, axis=None, kind="stable")
            filt = np.zeros(1 << 18, bool)
            filt[runs.ravel() & np.uint64(0x3FFFF)] = True
            self.lengths.append((length, wanted, wrong, seed, [i for i, _ in members], np.stack([c for _, c in members]), runs.ravel()[order], order, filt))

    def leaks(self, batch: Batch) -> Iterator[tuple[int, int, float]]:
        """``document, item id, share`` of the item's letters, as ``ItemIndex.leaks``."""
        if not self.lengths or not batch.docs:
            return
        gap = np.zeros(SHORT, np.uint32)
        text = np.concatenate([gap, *[x for d in batch.docs for x in (d, gap)]])
        owners = np.cumsum([SHORT, *[len(d) + SHORT for d in batch.docs]])
        hashed: dict[int, np.ndarray] = {}
        best: dict[tuple[int, int], float] = {}
        for length, wanted, wrong, seed, ids, codes, runs, order, filt in self.lengths:
            if seed not in hashed:
                hashed = {seed: _runs(text, seed)}
            h = hashed[seed]
            per = length - seed + 1
            at = np.flatnonzero(filt[h & np.uint64(0x3FFFF)])
            for a in range(0, len(at), 1 << 16):
                places = at[a : a + (1 << 16)]
                left, right = np.searchsorted(runs, h[places], "left"), np.searchsorted(runs, h[places], "right")
                n = right - left
                hit = order[np.repeat(left - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                # one row for each item and diagonal
                pair = np.unique(np.stack([hit // per, np.repeat(places, n) - hit % per]), axis=1)
                for b in range(0, pair.shape[1], 1 << 15):
                    item, start = pair[:, b : b + (1 << 15)]
                    keep = (start >= 0) & (start + length <= len(text))
                    item, start = item[keep], start[keep]
                    same = text[start[:, None] + np.arange(length)] == codes[item]
                    sums = np.cumsum(np.concatenate([np.zeros((len(same), 1), np.int32), same], axis=1, dtype=np.int32), axis=1)
                    good = ((sums[:, wanted:] - sums[:, :-wanted]) >= wanted - wrong).any(1)
                    middle = start[good] + np.argmax((sums[good, wanted:] - sums[good, :-wanted]) >= wanted - wrong, axis=1)
                    for doc, i, equal in zip((np.searchsorted(owners, middle + wrong, "right") - 1).tolist(), item[good].tolist(), sums[good, -1].tolist()):
                        key = (min(doc, len(batch.docs) - 1), ids[i])
                        best[key] = max(best.get(key, 0.0), equal / length)
        for (doc, i), share in best.items():
            yield doc, i, share


def indexes(rows: list[tuple], stretch: float, min_share: float | None, hashes: int, noise: float, miss: float, least_noise: float = 0.6) -> list[ItemIndex | ShortIndex]:
    """One index of the short items and one for each block of the others."""
    short, blocks, size = [], [[]], 0
    for item_id, text in rows:
        codes = letters(text)
        if len(codes) >= SHORT:
            if size and size + len(codes) > BLOCK_LETTERS:
                blocks.append([])
                size = 0
            blocks[-1].append((item_id, text))
            size += len(codes)
        elif len(codes):
            short.append((item_id, codes))
    return [ShortIndex(short, stretch), *[ItemIndex(b, stretch, min_share, hashes, noise, miss, least_noise) for b in blocks]]


_built: dict[str, list] = {}


def _indexes(key: str, shared, *settings) -> list[ItemIndex | ShortIndex]:
    """The indexes of a pass, built once in a worker; those of one pass are held at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = indexes(shared.value, *settings)
    return _built[key]


def _pieces(codes: np.ndarray, overlap: int) -> list[np.ndarray]:
    size = max(PIECE, 2 * overlap)
    if len(codes) <= size:
        return [codes]
    return [codes[a : a + size] for a in range(0, len(codes) - overlap, size - overlap)]


def find_leaks(
    docs: DataFrame,
    doc_id: str,
    text_col: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    stretch: float = 0.5,
    min_share: float | None = None,
    hashes: int = 64,
    noise: float = 0.7,
    miss: float = 1e-3,
    least_noise: float = 0.6,
) -> DataFrame:
    """``doc_id, item_id, share``: each document with each item of which it holds a stretch.

    ``stretch``: share of the item that a document must hold in one stretch;
    ``noise``: share of the shingles of a true stretch that misreadings leave,
    for which the search misses no more than ``miss``; ``least_noise``: the share
    of them that the exact check asks for; ``min_share``: least share of the
    item's shingles in the stretch, by default what ``stretch`` and
    ``least_noise`` leave of an item of its length.
    """
    stated = items.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_text")).where("_item IS NOT NULL AND _text IS NOT NULL").distinct()
    total = stated.agg(F.sum(F.length("_text"))).collect()[0][0] or 0
    passes = max(1, -(-total // (BLOCK_LETTERS * PASS_BLOCKS)))
    corpus = docs.select(F.col(doc_id).alias("_doc"), F.col(text_col).alias("_t")).where("_t IS NOT NULL")
    found = None
    for p in range(passes):
        rows = [(r._item, r._text) for r in stated.where(F.pmod(F.xxhash64("_item"), F.lit(passes)) == p).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(sorted(rows))

        def search(batches: Iterator[pd.DataFrame], shared=shared, key=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            every = _indexes(key, shared, stretch, min_share, hashes, noise, miss, least_noise)
            overlap = 2 * max([SHORT, *[index.longest for index in every if isinstance(index, ItemIndex)]])
            for batch in batches:
                out: list[tuple[int, int, float]] = []
                queue: list[np.ndarray] = []
                owners: list[int] = []
                size = 0

                def flush() -> None:
                    held = Batch(queue)
                    for index in every:
                        out.extend((owners[d], i, s) for d, i, s in index.leaks(held))
                    queue.clear()
                    owners.clear()

                for doc, text in zip(batch["_doc"].tolist(), batch["_t"]):
                    for piece in _pieces(letters(text), overlap):
                        queue.append(piece)
                        owners.append(doc)
                        size += len(piece)
                        if size >= PIECE:
                            flush()
                            size = 0
                flush()
                yield pd.DataFrame(out, columns=["d", "i", "s"])

        part = corpus.mapInPandas(search, f"d {corpus.schema['_doc'].dataType.simpleString()}, i {stated.schema['_item'].dataType.simpleString()}, s double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("d", "i").agg(F.max("s").alias("share")).select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "share")
