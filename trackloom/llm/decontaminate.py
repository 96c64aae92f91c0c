"""Benchmark items in documents, by q-gram lemma filtering.

Texts are compared as lower-case letters and digits with one blank for all else. An item of m characters occurs in a
text with e edits at most only if they share m + 1 - q * (e + 1) q-grams whose diagonals (place in the text minus place
in the item) differ by e at most. scan() counts the shared q-grams of each item in overlapping diagonal bands, of which
one holds any such range of diagonals, retains the bands that meet the bound, and verifies each by a banded alignment.

The edit budget e is rate * m, but never so much that the bound falls under 1. Items of fewer than Q characters share no
q-gram, and their budget is 0: they are found where they stand as whole words, by hashes of the words' characters.
Benchmarks are compared in blocks of about BLOCK characters and at most ITEMS items, which bounds what is sent to
executors; each block passes over all documents.

Nulls: a null or empty text holds no item, a null or empty item is in no text; rows with null ids are compared too.
Repeated rows are reported one by one. Of an item's regions in a text, the one with the fewest edits is reported, the
first of equal ones. Empty tables give empty results. Extra columns are kept by clean() and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import text as tx
from trackloom.llm.langid import fold
from trackloom.llm.tokens import NUMBER, classes

Q = 9
RATE = 0.09
BLOCK = 4_000_000
ITEMS = 1 << 18
#: Alignments made at once.
BATCH = 256
START_BITS = 24
FOUND = "doc_id bigint, item_id bigint, start bigint, end bigint, edits int, shared int"

_PLAIN: np.ndarray | None = None


def plain() -> np.ndarray:
    """Code points to lower-case letters or digits; 0 for all else."""
    global _PLAIN
    if _PLAIN is None:
        _PLAIN = fold().copy()
        digits = np.flatnonzero(classes() == NUMBER)
        _PLAIN[digits] = digits
    return _PLAIN


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the rows of a slab, each one's place in its row (code points), and where rows begin among them."""
    codes = plain()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0  # of blanks, the first after a word
    heads = points[:-1][points[:-1] < points[1:]]
    keep[heads] = codes[heads] > 0
    at = np.flatnonzero(keep)
    begin = np.searchsorted(at, points)
    return codes[at], at - np.repeat(points[:-1], np.diff(begin)), begin


def grams(codes: np.ndarray, size: int = Q) -> np.ndarray:
    """64-bit hashes of all runs of size characters."""
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - size + 1, np.uint64)
    for weight, k in zip(tx.seeds(Q, 3) | np.uint64(1), range(size), strict=False):
        out += codes[k : len(codes) - size + 1 + k] * weight
    return tx.mix(out)


def tallied(row: np.ndarray, item: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (row, item, band) in order, and how often each is there."""
    if not len(row):
        return (np.zeros(0, np.int64),) * 4
    items, bands = int(item.max()) + 1, int(band.max()) + 1
    if (int(row.max()) + 1) * items * bands < 1 << 63:
        key, count = np.unique((row * items + item) * bands + band, return_counts=True)
        return key // bands // items, key // bands % items, key % bands, count
    order = np.lexsort((band, item, row))
    row, item, band = row[order], item[order], band[order]
    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])))
    return row[head], item[head], band[head], np.diff(np.append(head, len(row)))


@dataclass
class Index:
    """q-grams of a block of items: sorted hashes, and for each the (item, place) where it stands."""

    ids: np.ndarray
    codes: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str]], rate: float = RATE) -> Index:
        if len(items) > ITEMS:
            raise ValueError(f"{len(items)} items in a block, which has {ITEMS} at most")
        ids, codes = [], []
        for item_id, body in items:
            raw = np.frombuffer((body or "").encode(), np.uint8)
            if len(raw):
                own = normal(raw, np.array([0, len(raw)]))[0]
                own = own[:-1] if len(own) and own[-1] == 0 else own
                if len(own):
                    ids.append(item_id)
                    codes.append(own.astype(np.uint64))
        size = np.array([len(c) for c in codes], np.int64)
        edits = np.maximum(np.minimum((size * rate).astype(np.int64), (size - Q) // Q), 0)
        item = np.repeat(np.arange(len(codes)), np.maximum(size - Q + 1, 0))
        place = np.concatenate([np.arange(max(0, n - Q + 1)) for n in size]) if len(size) else np.zeros(0, np.int64)
        every = np.concatenate([grams(c) for c in codes]) if codes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        hashes, first = np.unique(every[order], return_index=True)
        return cls(np.array(ids, np.int64), codes, edits, size + 1 - Q * (edits + 1), hashes, np.append(first, len(every)), item[order], place[order])

    def __post_init__(self) -> None:
        self.quick = np.zeros(1 << 22, bool)
        self.quick[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        self.short = {}  # by length: hashes in order, and the items that have them
        size = np.array([len(c) for c in self.codes], np.int64)
        for n in np.unique(size[size < Q]).tolist():
            items = np.flatnonzero(size == n)
            hashes = np.concatenate([grams(self.codes[i], n) for i in items])
            order = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[order], items[order]

    def words(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, start, end) of all short items that stand in the rows as whole words."""
        out = [(np.zeros(0, np.int64),) * 4]
        edge = np.append(codes == 0, True)  # where a word ends: at a blank, or where a row begins
        edge[begin] = True
        fresh = np.flatnonzero(~edge[:-1] & np.append(True, codes[:-1] == 0)[: len(codes)] | np.isin(np.arange(len(codes)), begin) & (codes > 0)) if self.short else []
        for n, (hashes, items) in self.short.items():
            at = fresh[fresh + n <= len(codes)]
            row = np.searchsorted(begin, at, side="right") - 1
            inside = (at + n <= begin[row + 1]) & edge[at + n]
            at, row = at[inside], row[inside]
            own = grams(codes, n)[at] if len(at) else np.zeros(0, np.uint64)
            low, high = np.searchsorted(hashes, own, side="left"), np.searchsorted(hashes, own, side="right")
            which = np.repeat(np.arange(len(at)), high - low)
            item = items[np.repeat(low - np.append(0, np.cumsum(high - low)[:-1]), high - low) + np.arange(len(which))] if len(which) else np.zeros(0, np.int64)
            out.append((row[which], item, at[which], at[which] + n))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def bands(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, lowest diagonal, shared q-grams) of the bands that meet the bound."""
        none = (np.zeros(0, np.int64),) * 4
        found = grams(codes)
        at = np.flatnonzero(self.quick[(found >> np.uint64(42)).astype(np.int64)])
        if not len(self.hashes) or not len(at):
            return none
        where = np.minimum(np.searchsorted(self.hashes, found[at]), len(self.hashes) - 1)
        same = self.hashes[where] == found[at]
        at, where = at[same], where[same]
        row = np.searchsorted(begin, at, side="right") - 1
        same = at + Q <= begin[row + 1]
        at, where, row = at[same], where[same], row[same]
        size = self.first[where + 1] - self.first[where]
        into = np.repeat(self.first[where] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        item, row = self.item[into], np.repeat(row, size)
        diagonal = np.repeat(at, size) - self.place[into] + self._margin
        half = self.edits[item] + 1
        out = []
        for shift in (0, 1):  # bands of two halves, by one half apart
            band = (diagonal + shift * half) // (2 * half)
            r, i, band, count = tallied(row, item, band)
            good = count >= self.least[i]
            r, i, band, count = (x[good] for x in (r, i, band, count))
            half_i = self.edits[i] + 1
            out.append((r, i, (2 * band - shift) * half_i - self._margin, count))
        row, item, low, count = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((low, item, row))
        row, item, low, count = (x[order] for x in (row, item, low, count))
        # verify() looks half a band to either side, so a band needs no look of its own if the one half a band before it gets one
        half = self.edits[item] + 1
        chained = np.append(False, (row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (low[1:] - low[:-1] <= half[1:])) if len(row) else np.zeros(0, bool)
        run = np.arange(len(row)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(row)))) if len(row) else np.zeros(0, int)
        look = run % 2 == 0
        return row[look], item[look], low[look], count[look]

    @property
    def _margin(self) -> int:
        """More than any place in an item, and a multiple of every band, so that diagonals stay positive."""
        return 0 if not len(self.codes) else max(map(len, self.codes))

    def verify(self, codes: np.ndarray, begin: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of the item in the band's region of the row, and start and end of the match among codes."""
        n = len(row)
        half = self.edits[item] + 1
        size = np.array([len(self.codes[i]) for i in item])
        wide, longest = int(4 * half.max()), int(size.max())
        text_at = (low - half)[:, None] + np.arange(wide + longest)[None, :]
        inside = (text_at >= begin[row][:, None]) & (text_at < begin[row + 1][:, None])
        window = np.where(inside, codes[np.clip(text_at, 0, len(codes) - 1)], np.uint64(0xFFFFFFFF)).astype(np.uint32)
        pattern = np.full((n, longest), 0xFFFFFFFE, np.uint32)
        for k, i in enumerate(item):
            pattern[k, : size[k]] = self.codes[i]
        one = np.int64(1) << START_BITS  # a cell is its cost times this, plus the column where its match starts
        columns = np.arange(wide, dtype=np.int64)
        cell = np.repeat((columns - columns * one)[None, :], n, axis=0)  # less its column's number, so that an insertion costs nothing
        best, best_start, best_end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(longest):
            skip = cell[:, 1:] + 2 * one
            cell += (window[:, k : k + wide] != pattern[:, k : k + 1]) * one
            np.minimum(cell[:, :-1], skip, out=cell[:, :-1])
            np.minimum.accumulate(cell, axis=1, out=cell)
            for j in np.flatnonzero(size == k + 1):
                own = cell[j] + columns * one
                b = int(own.argmin())
                best[j], best_start[j], best_end[j] = own[b] >> START_BITS, text_at[j, own[b] & (one - 1)], text_at[j, b] + k + 1
        return best, best_start, best_end


def scan(data: np.ndarray, offsets: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
    """(row, item number, start, end, edits, shared) of the items in the rows of a slab, by row and item."""
    codes, place, begin = normal(data, offsets)
    codes = codes.astype(np.uint64)
    row, item, low, shared = index.bands(codes, begin)
    edits, start, end = (np.zeros(len(row), np.int64) for _ in range(3))
    order = np.argsort(np.array([len(index.codes[i]) for i in item], np.int64), kind="stable")
    for k in range(0, len(row), BATCH):
        part = order[k : k + BATCH]
        edits[part], start[part], end[part] = index.verify(codes, begin, row[part], item[part], low[part])
    good = edits <= index.edits[item] if len(item) else np.zeros(0, bool)
    row, item, edits, start, end, shared = (x[good] for x in (row, item, edits, start, end, shared))
    short = index.words(codes, begin)
    zero = np.zeros(len(short[0]), np.int64)
    row, item, edits, start, end, shared = (np.concatenate(x) for x in zip((row, item, edits, start, end, shared), (short[0], short[1], zero, short[2], short[3], zero), strict=True))
    order = np.lexsort((start, edits, item, row))
    row, item, edits, start, end, shared = (x[order] for x in (row, item, edits, start, end, shared))
    new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])) if len(row) else np.zeros(0, bool)
    row, item, edits, start, end, shared = (x[new] for x in (row, item, edits, start, end, shared))
    start = np.maximum(start, begin[row])
    return row, item, place[start], place[np.maximum(end, start + 1) - 1] + 1, edits, shared


def _find(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in tx.slabs(batch.column(1)):
            row, item, start, end, edits, shared = scan(data, offsets, index)
            ids = batch.column(0).slice(low, high - low).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(index.ids[item]), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32()), pa.array(shared, pa.int32())], names=["doc_id", "item_id", "start", "end", "edits", "shared"])


def _keep(batches: Iterator[pa.RecordBatch], index: Index, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(len(batch), bool)
        for low, _, data, offsets in tx.slabs(batch.column(column)):
            keep[low + scan(data, offsets, index)[0]] = False
        yield batch.filter(pa.array(keep))


def blocks(benchmark: DataFrame, most: int = BLOCK) -> Iterator[Index]:
    """Indexes of the items, block by block, each of about most characters and at most ITEMS items."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    count = max(-(-(total.size or 0) // most), -(-total.n * 2 // ITEMS))  # blocks aren't equal, so half of ITEMS on average
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()  # bounded by the block
        for at in range(0, len(rows), ITEMS):  # more than one only if repeated rows fill a block
            yield Index.of([(r.item_id, r.text) for r in rows[at : at + ITEMS]])


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text), edits and shared q-grams of each item in each document."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    for index in blocks(benchmark):
        out = out.unionByName(rows.mapInArrow(partial(_find, index=index), FOUND))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    for index in blocks(benchmark):
        docs = docs.mapInArrow(partial(_keep, index=index, column="text"), docs.schema)
    return docs
