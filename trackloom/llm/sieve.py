"""A sieve of numbers: a Bloom filter of bounded size, made on the executors, that tells most rows which no join wants
apart where they are read. What it lets through may be wrong, what it holds back never is.
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

#: Most 64-bit words of a sieve (8 MB), and bits for each number as long as there are fewer.
MOST, BITS = 1 << 20, 16
SEEDS = tx.seeds(3, 41)


def _places(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each of the places of ids."""
    at = np.concatenate([tx.mix(ids.astype(np.int64).view(np.uint64) ^ s) for s in SEEDS]) % np.uint64(64 * words)
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def _set(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, bit = _places(np.asarray(batch.column(0)), words)
        order = np.argsort(word, kind="stable")
        word, bit = word[order], bit[order]
        head = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        joined = np.bitwise_or.reduceat(bit, head) if len(head) else bit
        yield pa.RecordBatch.from_arrays([pa.array(word[head]), pa.array(joined.view(np.int64))], names=["word", "bits"])


@dataclass
class Sieve:
    bits: np.ndarray

    @classmethod
    def of(cls, ids: DataFrame, column: str, most: int = MOST) -> Sieve:
        """The sieve of a column of numbers without nulls."""
        words = 64
        wanted = ids.count() * BITS // 64
        while words < min(wanted, most):
            words *= 2
        made = ids.select(F.col(column).cast("bigint")).mapInArrow(partial(_set, words=words), "word bigint, bits bigint")
        bits = np.zeros(words, np.uint64)
        for r in made.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():  # words rows at most
            bits[np.asarray(r.column(0))] = np.asarray(r.column(1)).view(np.uint64)
        return cls(bits)

    def holds(self, ids: np.ndarray) -> np.ndarray:
        word, bit = _places(ids, len(self.bits))
        return ((self.bits[word] & bit) > 0).reshape(len(SEEDS), -1).all(axis=0)
