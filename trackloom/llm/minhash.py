"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct shingles of 5 words (A-Z lowered). Two small collections of minhash groups (SIDES
groups of WIDTH minhashes each) give SIDES x SIDES table keys, one for each pair of a group of the first and a group of
the second collection: 2 * SIDES * WIDTH minhashes do the work of SIDES * SIDES * 2 * WIDTH independent ones. A pair at
similarity s shares a table unless it misses all groups of a collection: 2 * (1 - s ** WIDTH) ** SIDES at most, 1e-3
at 0.85 with the defaults.

Documents with equal sets are one representative from the start. Two documents share a table key only if they share both
of its halves, so halves are counted first, and keys are made of the halves that occur twice or more. Candidates are confirmed on the full sets, in two steps, and no bucket is ever
expanded into rows of pairs. First, each bucket's members are compared to its smallest one (the pivot) and components are
formed, which is all that a group of true copies needs. A bucket whose other members (pairs with
the pivot are decided) still have more than one component is then dealt into chunks of about CHUNK shingles or MEMBERS members; every two chunks meet in one task, where the sizes of all intersections come
from products of incidence matrices, and only links that join two components come out. So every candidate is decided
exactly and a task's memory is bounded by two chunks; a bucket of many chunks sends each member to each chunk. Open
buckets whose keys have the same first half are dealt as one, since their members are largely the same.

Full sets are made anew from the texts of candidates. A sieve (one bit array, of SIEVE words at most at any size) tells
most other texts apart where they are read, so they aren't shuffled; what it lets through besides joins nothing.

A candidate of the first step first has to fit in size, and its signatures have to agree in a share that a linked pair falls short of
with odds under 1e-6 (6 standard deviations).

Nulls: a text that is null, or without words, has an empty set and links with nothing; a null doc_id isn't allowed and
such rows are left out. Rows with one doc_id are one document; if their sets differ, it is linked where any of them is. Rows come back one
by one. Other columns are not read by link(); dedup() keeps them.
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
from trackloom.llm.components import components
from trackloom.llm.sieve import Sieve
from trackloom.llm.state import cut

WORDS = 5
SHINGLE_SEEDS = tx.seeds(WORDS, 5)
#: Shingles and members of a chunk of a bucket (about), and columns of an incidence matrix at once.
CHUNK, MEMBERS, COLUMNS = 150_000, 1000, 2048


@dataclass(frozen=True)
class Banding:
    sides: int = 8
    width: int = 3

    @property
    def hashes(self) -> int:
        return 2 * self.sides * self.width

    @classmethod
    def of(cls, similarity: float, miss: float = 1e-3, width: int = 3) -> Banding:
        """The fewest groups that miss a pair at this similarity with at most these odds."""
        sides = 1
        while 2 * (1 - similarity**width) ** sides > miss:
            sides += 1
        return cls(sides, width)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit shingle), distinct, by row and hash, of the rows of a slab."""
    start, end, row = tx.words(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = tx.range_hash(tx.prefix_hash(tx.LOWER[data]), start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    place = np.arange(len(word)) - first[row]
    left = count[row] - place  # words from here to the end of the row
    whole = (left >= WORDS) | (place == 0)
    at = np.flatnonzero(whole)
    value = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        there = left[at] > k
        value[there] += tx.mix(word[at[there] + k] ^ SHINGLE_SEEDS[k])
    value = tx.mix(value + np.minimum(left[at], WORDS).astype(np.uint64))
    row = row[at]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))
    return row[new], value[new]


def _sign(batches: Iterator[pa.RecordBatch], hashes: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, set_a, set_b, signature)."""
    flip, turn = tx.seeds(hashes, 71), tx.seeds(hashes, 97) | np.uint64(1)
    for batch in batches:
        for low, high, data, offsets in tx.slabs(batch.column(1)):
            row, value = shingles(data, offsets)
            size = np.bincount(row, minlength=high - low)
            some = np.flatnonzero(size)
            at = (np.cumsum(size) - size)[some]
            sums = np.zeros((2, high - low), np.uint64)
            signature = np.zeros((high - low, hashes), np.uint32)
            if len(some):
                sums[0, some] = np.add.reduceat(tx.mix(value), at)
                sums[1, some] = np.add.reduceat(tx.mix(value ^ flip[0]), at)
                for k in range(hashes):
                    signature[some, k] = np.minimum.reduceat((value ^ flip[k]) * turn[k], at) >> np.uint64(32)
            kept = pa.array([x.tobytes() for x in signature], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(size, pa.int64()), *(pa.array(x.view(np.int64)) for x in sums), kept], names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])


def sign(docs: DataFrame, banding: Banding) -> DataFrame:
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_sign, hashes=banding.hashes), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary")


def _halves(batches: Iterator[pa.RecordBatch], banding: Banding) -> Iterator[pa.RecordBatch]:
    """(rep, signature) to (rep, halves): a hash of each group, first those of the first and then of the second collection."""
    m, w = banding.sides, banding.width
    salt = tx.seeds(2 * m, 29)
    for batch in batches:
        if not len(batch):
            continue
        signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(batch), 2 * m, w).astype(np.uint64)
        group = np.broadcast_to(salt, signature.shape[:2])
        for k in range(w):
            group = tx.mix(group * np.uint64(3) + signature[..., k] + np.uint64(1))
        ends = pa.array(np.arange(0, (len(batch) + 1) * 2 * m, 2 * m, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(group.view(np.int64).ravel()))], names=["rep", "halves"])


def _sets(batches: Iterator[pa.RecordBatch], wanted: Sieve) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (rep, shingles) of the rows that the sieve lets through; of equal rows in a task, one."""
    seen: set[tuple[int, int, int]] = set()
    for batch in batches:
        batch = batch.filter(pa.array(wanted.holds(np.asarray(batch.column(0)))))
        for low, high, data, offsets in tx.slabs(batch.column(1)):
            row, value = shingles(data, offsets)
            reps, size = batch.column(0).slice(low, high - low), np.bincount(row, minlength=high - low)
            sums = np.zeros(high - low, np.uint64)
            some = np.flatnonzero(size)
            sums[some] = np.add.reduceat(tx.mix(value), (np.cumsum(size) - size)[some]) if len(some) else 0
            fresh = np.zeros(high - low, bool)
            for k, name in enumerate(zip(reps.to_pylist(), size.tolist(), sums.tolist(), strict=True)):
                fresh[k] = name not in seen
                seen.add(name)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            made = pa.RecordBatch.from_arrays([reps, pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))], names=["rep", "shingles"])
            yield made.filter(pa.array(fresh))


def _agree(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in at least so many places."""
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(len(batch), -1) for k in (2, 3))
            kept = batch.filter(pa.array((a == b).sum(axis=1) >= least))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


class Linker:
    """Confirms candidate pairs of representatives on their full sets."""

    def __init__(self, docs: DataFrame, reps: DataFrame, banding: Banding, per_mille: int) -> None:
        self.docs, self.reps, self.per_mille = docs, reps, per_mille
        share = per_mille / 1000
        self.least = int(np.floor(banding.hashes * share - 6 * np.sqrt(banding.hashes * share * (1 - share))))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Distinct (a, b), a < b, out of pairs (a, b) whose sets have per_mille * union <= 1000 * intersection."""
        reps = self.reps
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        one = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
        two = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
        sized = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 1000 >= F.greatest("na", "nb") * self.per_mille)
        pairs = cut(sized.select("a", "b", "sa", "sb").mapInArrow(partial(_agree, least=self.least), "a bigint, b bigint"), "near-pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")))
        one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
        two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        linked = pairs.join(one, "a").join(two, "b").where(both * 1000 >= (F.size("sa") + F.size("sb") - both) * self.per_mille)
        return linked.select("a", "b").distinct()

    def sets(self, reps: DataFrame) -> DataFrame:
        """(rep, shingles) of the representatives in reps, and of a few documents more."""
        texts = self.docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("string").alias("text"))
        return cut(texts.mapInArrow(partial(_sets, wanted=Sieve.of(reps.distinct(), "rep")), "rep bigint, shingles array<bigint>"), "near-sets")

    def block_links(self, members: DataFrame) -> DataFrame:
        """Links (a, b) that join components of buckets; members: key, rep, comp."""
        sized = members.join(self.reps.select("rep", "n_shingles"), "rep")
        chunks = sized.groupBy("key").agg(F.ceil(F.greatest(F.sum("n_shingles") / F.lit(CHUNK), F.count(F.lit(1)) / F.lit(MEMBERS))).cast("int").alias("chunks"))
        dealt = sized.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        rows = dealt.withColumn("other", other).select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "rep", "comp")
        full = rows.join(self.sets(members.select("rep")), "rep")
        sorted_ = full.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").select("key", "low", "high", "chunk", "rep", "comp", "shingles")
        return sorted_.mapInArrow(partial(_blocks, per_mille=self.per_mille), "a bigint, b bigint").distinct()


def joined(chunk: np.ndarray, rep: np.ndarray, comp: np.ndarray, shingles: list[np.ndarray], per_mille: int) -> list[tuple[int, int]]:
    """Links that join components among the members of a block: of one chunk, or of one with the other."""
    n, size = len(rep), np.array([len(x) for x in shingles])
    if (comp == comp[0]).all():
        return []
    value, column, count = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = count[column] > 1  # others are in no intersection
    column, row = (np.cumsum(count > 1) - 1)[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int((count > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    linked = both * 1000 >= (size[:, None] + size[None, :] - both) * per_mille
    linked &= np.triu(np.ones((n, n), bool), 1)
    if chunk.min() < chunk.max():
        linked &= chunk[:, None] != chunk[None, :]
    root = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = top(int(comp[i])), top(int(comp[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], per_mille: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block (key, low, high) to links; a block may go on in the next batch."""
    held: list[tuple] = []
    block = None

    def done() -> pa.RecordBatch:
        chunk, rep, comp = (np.array(x) for x in zip(*(h[:3] for h in held), strict=True))
        links = joined(chunk, rep, comp, [h[3] for h in held], per_mille)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        chunk, rep, comp = (batch.column(k).to_pylist() for k in (3, 4, 5))
        lists = batch.column(6)
        ends, values = np.asarray(lists.offsets), np.asarray(lists.values)
        for k, key in enumerate(keys):
            if key != block:
                if len(held) > 1:
                    yield done()
                held, block = [], key
            held.append((chunk[k], rep[k], comp[k], values[ends[k] : ends[k + 1]].copy()))
    if len(held) > 1:
        yield done()


def candidates(reps: DataFrame, banding: Banding) -> tuple[DataFrame, DataFrame]:
    """Representatives with a half that others have too, and members (key, half, rep, pivot) of the tables' buckets of two or
    more; half is the first one of the key, and pivot the smallest member."""
    made = reps.select("rep", "signature").mapInArrow(partial(_halves, banding=banding), "rep bigint, halves array<bigint>")
    halves = made.select("rep", F.posexplode("halves").alias("slot", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    own = halves.join(shared, "half", "left_semi").groupBy("rep").agg(F.collect_set(F.struct("slot", "half")).alias("halves"))  # 2 * sides at most
    side = lambda test: F.transform(F.filter("halves", lambda x: test(x["slot"] < banding.sides)), lambda x: x["half"])
    own = own.select("rep", side(lambda c: c).alias("first"), side(lambda c: ~c).alias("second")).where((F.size("first") > 0) & (F.size("second") > 0))
    live = cut(reps.select("rep", "n_shingles", "signature").join(own, "rep"), "near-live")
    pairs = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.struct(F.xxhash64(a, b).alias("key"), a.alias("half")))))
    keys = live.select("rep", F.explode(pairs).alias("of")).select("rep", "of.key", "of.half").distinct()
    buckets = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").drop("last")
    return live.drop("first", "second"), cut(keys.join(buckets, "key"), "near-members")


def link(docs: DataFrame, similarity: float = 0.85, banding: Banding | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    per_mille = round(similarity * 1000)
    banding = banding or Banding.of(similarity)
    signed = cut(sign(docs, banding), "near-signatures")
    by_set = ["set_a", "set_b", "n_shingles"]
    least = F.min(F.struct(F.col("doc_id").alias("rep"), "signature")).alias("least")
    reps = cut(signed.where("n_shingles > 0").groupBy(*by_set).agg(least).select(*by_set, "least.rep", "least.signature"), "near-reps")
    live, members = candidates(reps, banding)
    linker = Linker(docs, live, banding, per_mille)
    others = members.where("rep > pivot")
    links = cut(linker.links(others.select(F.col("pivot").alias("a"), F.col("rep").alias("b"))), "near-links")
    comps = components(links)
    more = cut(linker.block_links(open_buckets(others.select("key", "half", "rep"), comps)), "near-links")
    if not more.isEmpty():
        comps = components(links.unionByName(more))
    of_set = reps.select(*by_set, "rep").join(comps, F.col("rep") == F.col("node"), "left").select(*by_set, F.coalesce("comp", "rep").alias("component_id"))
    return signed.select("doc_id", *by_set).join(of_set, by_set, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def open_buckets(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (key, rep, comp) of the buckets that have more than one component, with the first half as the key."""
    named = members.join(comps, members["rep"] == comps["node"], "left").select("key", "half", "rep", F.coalesce("comp", "rep").alias("comp"))
    several = named.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("key")
    return cut(named.join(several, "key", "left_semi").select(F.col("half").alias("key"), "rep", "comp").distinct(), "near-open")


def dedup(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that represent their component (the smallest doc_id); of rows with one doc_id, one stays. Rows
    without a doc_id stay."""
    found = link(docs, similarity).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
