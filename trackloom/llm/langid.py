"""Language of a text by rank-order profiles: the out-of-place distance of its most frequent n-grams to each language.

N-grams have 1 to ORDER letters, in lower case; the edges of words count as a letter. The profile of a language is the
order of its TOP most frequent n-grams in labelled texts; learn() fits it on a bounded sample of these (sample rows a
language in the mean, taken by a hash of doc_id). A text's own TOP are compared rank by rank: an n-gram that a profile
lacks is TOP places out. score is 1 - distance / largest possible distance. N-grams are told apart by 32-bit hashes: that
one of a text's 400 takes the hash of another one's in a profile of 400 has odds of 4e-5, and costs 1 of 400 places.

Nulls: a text that is null, empty or without a letter is `und` with score 0; rows with a null lang or doc_id aren't learnt
from; with nothing to learn from, all is `und`. Ties go to the language that is first in order. Repeated rows are
predicted alike. Texts are read whole. An empty table gives an empty result. Extra columns are kept by classify() and
not read; its own are lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm import text as tx
from trackloom.llm.tokens import LETTER, classes

ORDER, TOP = 4, 400
UNKNOWN = "und"
#: Rows compared at once, so that row, count and n-gram fit a 64-bit number; counts over MOST are sorted in another way.
ROWS = 1 << 12
MOST = (1 << 20) - 1
#: Bytes of text read at once (one text at least): n-grams take some hundred bytes for each, in every worker of an executor.
SLAB = 1 << 18

_FOLD: np.ndarray | None = None


def fold() -> np.ndarray:
    """Code points to lower-case letters; 0 for all else."""
    global _FOLD
    if _FOLD is None:
        kinds = classes()
        out = np.zeros(len(kinds), np.uint32)
        for code in np.flatnonzero(kinds == LETTER).tolist():
            low = chr(code).lower()
            out[code] = ord(low) if len(low) == 1 else code
        _FOLD = out
    return _FOLD


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 32-bit n-gram) of all n-grams of the rows of a slab."""
    codes = fold()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(points))
    head = np.ones(len(codes), bool)
    head[1:] = row[1:] != row[:-1]
    keep = codes > 0
    keep[1:] |= (codes[:-1] > 0) & ~head[1:]  # of white space, the first after a word
    codes, row = codes[keep], row[keep]
    start = np.ones(len(codes), bool)
    start[1:] = row[1:] != row[:-1]
    at = np.flatnonzero(start)
    codes, row = np.insert(codes, at, 0), np.insert(row, at, row[at])  # and one before the first word
    ends = np.flatnonzero(np.append(row[1:] != row[:-1], True) & (codes > 0)) + 1 if len(row) else np.zeros(0, int)
    codes, row = np.insert(codes, ends, 0), np.insert(row, ends, row[ends - 1])  # and after the last
    rows, found = [], []
    value = np.zeros(len(codes), np.uint64)
    fits = np.ones(len(codes), bool)
    for n in range(1, ORDER + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        value = tx.mix(value[:m] * np.uint64(31) + codes[n - 1 :] + np.uint64(1))
        same = row[:m] == row[n - 1 :]
        fits = fits[:m] & same if n < 3 else fits[:m] & same & (codes[n - 2 : n - 2 + m] > 0)  # inner letters are letters
        good = fits if n > 2 else fits & ((codes[:m] > 0) | (codes[n - 1 :] > 0))  # not an edge alone
        rows.append(row[:m][good])
        found.append(value[good] >> np.uint64(32))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.uint64),) * 2


def counted(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.sort((row << np.uint64(32)) | gram)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    count = np.diff(np.append(first, len(key))).astype(np.uint64)
    return key[first] >> np.uint64(32), key[first] & np.uint64(0xFFFFFFFF), count


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to counts of n-grams by language."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, codes = langs.dictionary, np.asarray(langs.indices)
        for low, high, data, offsets in tx.slabs(batch.column(1), SLAB):
            row, gram = grams(data, offsets)
            lang, gram, count = counted(codes[low:high].astype(np.uint64)[row.astype(np.int64)], gram)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang.astype(np.int64))), pa.array(gram.astype(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, sample: int = 2000) -> dict[str, list[int]]:
    """Profiles: TOP n-grams of each language, most frequent first, from about sample rows (doc_id, lang, text) each."""
    rows = labelled.where("lang is not null and doc_id is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    unit = 1 << 20
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(unit, -(-sample * unit // n))))))
    taken = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(unit)) < F.element_at(share, F.col("lang")))
    counts = taken.select("lang", F.col("text").cast("string")).mapInArrow(_learn, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= TOP)
    out: dict[str, list[int]] = {k: [] for k in sorted(sizes)}
    for r in best.orderBy("lang", "rank").collect():  # TOP a language
        out[r.lang].append(r.gram)
    return {k: v for k, v in out.items() if v}


class Ranker:
    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.names = sorted(profiles)
        self.grams = np.unique(np.array([g for v in profiles.values() for g in v], np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)  # the last row: in no profile
        for k, name in enumerate(self.names):
            own = np.array(profiles[name], np.uint64)
            self.ranks[np.searchsorted(self.grams, own), k] = np.arange(len(own))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language (-1: none) and score of each row; at most ROWS rows."""
        rows = len(offsets) - 1
        row, gram, count = counted(*grams(data, offsets))
        if not len(row) or not self.names:
            return np.full(rows, -1), np.zeros(rows)
        if int(count.max()) <= MOST:
            key = np.sort((row << np.uint64(52)) | ((np.uint64(MOST) - count) << np.uint64(32)) | gram)
            row, gram = (key >> np.uint64(52)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
        else:  # of a very long text
            order = np.lexsort((gram, -count.astype(np.int64), row))
            row, gram = row[order].astype(np.int64), gram[order]
        size = np.bincount(row, minlength=rows)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        top = rank < TOP
        row, gram, rank = row[top], gram[top], rank[top]
        where = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[where] == gram, where, len(self.grams))]
        out = np.where(ranks < 0, TOP, np.abs(ranks - rank[:, None]))
        far = np.stack([np.bincount(row, out[:, k], minlength=rows) for k in range(len(self.names))], axis=1)
        worst = np.minimum(size, TOP) * float(TOP)
        lang = np.where(size > 0, far.argmin(axis=1), -1)
        return lang, np.where(size > 0, 1 - far.min(axis=1) / np.maximum(worst, 1), 0.0)


def _classify(batches: Iterator[pa.RecordBatch], profiles: dict[str, list[int]], column: str) -> Iterator[pa.RecordBatch]:
    ranker = Ranker(profiles)
    names = pa.array([*ranker.names, UNKNOWN])
    for batch in batches:
        for low, high, data, offsets in tx.slabs(batch.column(column), SLAB):
            langs, scores = [], []
            for k in range(0, high - low, ROWS):
                part = offsets[k : min(k + ROWS, high - low) + 1]
                lang, score = ranker.predict(data[part[0] : part[-1]], part - part[0])
                langs.append(np.where(lang < 0, len(ranker.names), lang))
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, names.take(pa.array(np.concatenate(langs))), pa.array(np.concatenate(scores))], names=[*batch.schema.names, "lang_pred", "score"])


def classify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """docs with lang_pred and score, of its column text."""
    docs = docs.drop("lang_pred", "score")
    schema = docs.schema.add("lang_pred", "string").add("score", "double")
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(partial(_classify, profiles=profiles, column="text"), schema)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
