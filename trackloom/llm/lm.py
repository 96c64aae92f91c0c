"""Cross-entropy difference of documents between matched n-gram models.

The background model counts the words and word pairs of all documents, the target model those of target documents.
Both share one vocabulary: every word that occurs twice or more in all documents, one unknown word for all others, and
the end that closes each document. A model gives

    p(w) = (c(w) + 1) / (N + V)
    p(w | v) = PAIR_WEIGHT * c(v, w) / c(v) + (1 - PAIR_WEIGHT) * p(w), and p(w) where v is first or never occurs

Every word is followed by another or by the end, so the counts of pairs of v add up to c(v), and both are distributions
over the vocabulary. A document is scored by models of all other documents: its own counts are taken off first (off the
target model too, if it is a target), else a rare pair of its own would vouch for itself. A loss is the mean of -log p
over its words and its end. Its score is target loss minus background loss: the lower, the more it is like the target.

No model is held in one place, so its size follows the corpus. Documents are packed into slabs. A slab asks for its
distinct words, dealt to buckets by hash; a bucket adds up what all slabs counted and answers each in the order of its
question, 0 for words that occur once. With its words' counts a slab knows its unknown words, and asks for its pairs in the
same way; with both answers it scores its documents. Questions and answers are shuffled, and so are packed documents,
to meet their answers; no text is shuffled unpacked. Which documents are targets is found by joining their ids alone, and
told to a slab by the places of its target rows. Words and pairs are told apart by 64-bit hashes. The number of buckets follows
spark.sql.shuffle.partitions and, from some size on, the corpus, so that a bucket fits in memory.

Words are runs of what isn't white space, A-Z lowered. Nulls: a text that is null or without words has no tokens, and
losses and score 0; a null target flag is false. Repeated rows are documents of their own, so each is scored by models
that know the other. Without target documents the target model is uniform. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import text as tx
from trackloom.llm.state import cut

PAIR_WEIGHT = 0.7
#: Words that occur more rarely are unknown.
LEAST = 2
#: What stands for the unknown word and for the end where pairs are hashed.
UNKNOWN, END = np.uint64(0), np.uint64(1)
#: Bytes of text in a slab (and more in one that holds a single longer document), and slabs for which a bucket is added.
SLAB, SLABS_A_BUCKET = 2 << 20, 8
#: A slab: its number, its rows, and for each row its id, whether it has words and whether it came as a target.
PARTS = "slab bigint, docs binary, ids array<bigint>, has array<boolean>, target array<boolean>"
ASKED = "bucket bigint, slab bigint, keys binary, n binary, n_target binary"
#: known, kept and kept_target (all that is known in the bucket), total and total_target stand in a bucket's first row.
STATED = ("known", "kept", "kept_target", "total", "total_target")
ANSWERED = "slab bigint, bucket bigint, n binary, n_target binary, " + ", ".join(f"{k} bigint" for k in STATED)
#: Rows of answers that tell a slab's target rows have these places, all others counts.
TOLD = "slab bigint, bucket bigint, n binary, n_target binary, of_pairs boolean, places array<int>"
SCORED = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of a slab."""
    start, end, row = tx.words(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return row, tx.range_hash(tx.prefix_hash(tx.LOWER[data]), start, end).view(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, target) to slabs: a number of its own and the rows, as a compressed Arrow stream."""
    number, held, has, size = TaskContext.get().partitionId() << 33, [], [], 0

    def packed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].select([0, 1]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for x in held:
                out.write_batch(x.select([0, 1]))
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        cells = [pa.concat_arrays([x.column(k) for x in held]) for k in (0, 2)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), listed(cells[0]), listed(pa.array(np.concatenate(has))), listed(cells[1])], names=["slab", "docs", "ids", "has", "target"])

    for batch in batches:
        for low, high, data, offsets in tx.slabs(batch.column(1), SLAB):
            held.append(batch.slice(low, high - low))
            has.append(np.zeros(high - low, bool))
            has[-1][tx.words(data, offsets)[2]] = True
            size += len(data) + 64 * (high - low)
            if size >= SLAB:
                yield packed()
                number, held, has, size = number + 1, [], [], 0
    if held:
        yield packed()


def _unpacked(docs: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of a slab, and row and hash of their words."""
    rows = pa.ipc.open_stream(docs).read_all()
    found = [(low, *tokens(data, offsets)) for low, _, data, offsets in tx.slabs(rows.column("text"))]
    return rows, np.concatenate([low + row for low, row, _ in found]), np.concatenate([key for _, _, key in found]).view(np.uint64)


def _pairs(row: np.ndarray, key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of each word together with the word after it or the end; all unknown words count as one."""
    word = np.where(count > 0, key, UNKNOWN)
    after = np.append(word[1:], END) if len(word) else word
    after = np.where(np.append(row[1:] != row[:-1], True), END, after) if len(word) else after
    return tx.mix(tx.mix(word) * np.uint64(0x9E3779B97F4A7C15) + after)


def _own(row: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """For each word, how many words of its row are of the same kind (a number)."""
    if not len(row):
        return np.zeros(0, np.int64)
    _, inverse, count = np.unique(row * (int(kind.max()) + 1) + kind, return_inverse=True, return_counts=True)
    return count[inverse]


def _dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys by bucket and value, their buckets, and the place of each of key among them."""
    distinct, inverse = np.unique(key, return_inverse=True)
    bucket = (distinct % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], bucket[order], place[inverse]


def _planes(x: np.ndarray) -> bytes:
    """How many bytes the largest of x (none negative) needs; then all lowest bytes of x, all next ones, and so on up to
    that many: most numbers are small, and the shuffle's compression finds runs."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.view(np.uint8).reshape(-1, x.itemsize)[:, :width].T.tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    found = np.frombuffer(planes, np.uint8)[1:].reshape(planes[0], -1)
    out = np.zeros((found.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, : len(found)] = found.T
    return out.view(kind)[:, 0]


def _question(slab: int, key: np.ndarray, target: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket in which the slab has keys: these, and their counts in the slab. The keys of a bucket are
    sent as steps from one to the next, of what its number leaves of them."""
    distinct, bucket, place = _dealt(key, buckets)
    n = np.bincount(place, minlength=len(distinct)).astype(np.uint32)
    n_target = np.bincount(place, target, minlength=len(distinct)).astype(np.uint32)
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    rest = distinct // np.uint64(buckets)
    steps = np.append(rest[:1], rest[1:] - rest[:-1])
    steps[head] = rest[head]
    ends = zip(head, np.append(head[1:], len(bucket)), strict=True)
    split = [[_planes(steps[a:b]), _planes(n[a:b]), _planes(n_target[a:b])] for a, b in ends]
    return pa.RecordBatch.from_arrays([pa.array(bucket[head], pa.int64()), pa.array([slab] * len(head), pa.int64()), *(pa.array([x[k] for x in split], pa.binary()) for k in range(3))], names=["bucket", "slab", "keys", "n", "n_target"])


def _answer(asked: pa.Table, least: int) -> pa.Table:
    """All questions to a bucket to an answer to each; keys that occur less than so often are answered by 0."""
    cells = lambda name: (x.as_py() for x in asked[name])
    keys = [np.cumsum(_numbers(x, np.uint64)) for x in cells("keys")]
    ends = np.cumsum([0, *map(len, keys)])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(head, len(keys)))
    del keys
    stated, answers, known = [], [], None
    for name in ("n", "n_target"):
        counts = np.concatenate([_numbers(x, np.uint32) for x in cells(name)])
        sums = np.add.reduceat(counts[order], head, dtype=np.int64)
        known = sums >= least if known is None else known
        stated += [int(sums[known].sum()), int(sums.sum())]
        answer = np.empty(len(order), np.int64)
        answer[order] = np.repeat(np.where(known, sums, 0), size)
        answers.append(pa.array([_planes(answer[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))
    said = [int(known.sum()), stated[0], stated[2], stated[1], stated[3]]
    first = [pa.array([x, *[0] * (len(asked) - 1)], pa.int64()) for x in said]
    return pa.table([asked["slab"], asked["bucket"], *answers, *first], names=["slab", "bucket", "n", "n_target", *STATED])


def _heard(answers: pa.Table) -> np.ndarray:
    """Counts, in all and in target documents, of a slab's distinct keys as _dealt() orders them."""
    answers = answers.sort_by("bucket")
    return np.stack([np.concatenate([np.zeros(0, np.int64), *(_numbers(x.as_py(), np.int64) for x in answers[name])]) for name in ("n", "n_target")])


def _told(answers: pa.Table, of_pairs: bool) -> pa.Table:
    """Answers on words, or on pairs."""
    return answers.filter(pa.array([x is of_pairs for x in answers["of_pairs"].to_pylist()], pa.bool_()))


def _target(rows: pa.Table, answers: pa.Table) -> np.ndarray:
    """Whether each row of a slab is a target."""
    out = np.zeros(len(rows), bool)
    for places in answers["places"]:
        if places.is_valid:
            out[np.asarray(places.values)] = True
    return out


def _ask_words(part: pa.Table, targets: pa.Table, buckets: int) -> pa.Table:
    rows, row, key = _unpacked(part["docs"][0].as_py())
    return pa.Table.from_batches([_question(part["slab"][0].as_py(), key, _target(rows, targets)[row], buckets)])


def _ask_pairs(part: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """A slab and the answers on its words to its question for pairs."""
    rows, row, key = _unpacked(part["docs"][0].as_py())
    pairs = _pairs(row, key, _heard(_told(answers, False))[0][_dealt(key, buckets)[2]])
    return pa.Table.from_batches([_question(part["slab"][0].as_py(), pairs, _target(rows, answers)[row], buckets)])


@dataclass
class Totals:
    """Number of known words; and in all and in target documents, counts of all words, of unknown ones and of ends."""

    known: int
    total: np.ndarray
    unknown: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, answers: DataFrame, ends: tuple[int, int]) -> Totals:
        x = answers.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in STATED)).first()
        total, kept = np.array([[x.total], [x.total_target]], np.float64), np.array([[x.kept], [x.kept_target]], np.float64)
        return cls(x.known, total, total - kept, np.array([[ends[0]], [ends[1]]], np.float64))


def losses(row: np.ndarray, target: np.ndarray, known: np.ndarray, word: np.ndarray, pair: np.ndarray, pair_count: np.ndarray, totals: Totals) -> np.ndarray:
    """Losses (background and target) of documents. By word: its row; counts if it is known, else 0; a number of its own
    among the words of the slab (unknown ones have one number), and one for its pair with what follows; the pair's counts."""
    docs = len(target)
    taken = np.stack([np.ones(docs), target])  # documents taken off each model
    n = np.bincount(row, minlength=docs)
    some = (n > 0).astype(np.float64)
    size = totals.total - taken * n + totals.ends - taken * some + totals.known + 2  # N + V of each document's models
    count = np.where(known[0] > 0, known, totals.unknown) - taken[:, row] * _own(row, word)
    single = (count + 1) / size[:, row]
    followed = pair_count - taken[:, row] * _own(row, pair)
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end = (totals.ends - taken + 1) / size
    after = np.where(last, end[:, row], np.append(single[:, 1:], np.ones((2, 1)), axis=1) if len(row) else single)  # p of what follows each word
    weight = np.where(count > 0, PAIR_WEIGHT, 0)
    p = weight * followed / np.maximum(count, 1) + (1 - weight) * after
    first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    lost = -np.log(p) - np.where(first, np.log(single), 0)
    return np.stack([np.bincount(row, x, minlength=docs) for x in lost]) / (n + 1)


def _score(part: pa.Table, answers: pa.Table, buckets: int, totals: Totals) -> pa.Table:
    """A slab and the answers on its words and pairs to losses and scores of its documents."""
    rows, row, key = _unpacked(part["docs"][0].as_py())
    words, pairs = _told(answers, False), _told(answers, True)
    place = _dealt(key, buckets)[2]
    known = _heard(words)[:, place]
    pair = _dealt(_pairs(row, key, known[0]), buckets)[2]
    pair_count = _heard(pairs)[:, pair]
    background, target = losses(row, _target(rows, answers).astype(np.float64), known, np.where(known[0] > 0, place + 1, 0), pair, pair_count, totals)
    n = np.bincount(row, minlength=len(rows))
    return pa.table([rows["doc_id"], pa.array(n, pa.int64()), pa.array(target), pa.array(background), pa.array(target - background)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def _scored(parts: DataFrame, targets: DataFrame) -> DataFrame:
    """parts: slabs. targets: slab, row and has of the rows that are targets."""
    of_slab = targets.groupBy("slab").agg(F.array_sort(F.collect_list("row")).alias("places"), F.sum(F.col("has").cast("bigint")).alias("ends"))  # a slab's rows are bounded
    of_slab = cut(of_slab, "lm-targets")
    ends, target_ends = parts.agg(F.coalesce(F.sum(F.aggregate("has", F.lit(0).cast("bigint"), lambda n, x: n + x.cast("bigint"))), F.lit(0))).first()[0], of_slab.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    buckets = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts.count() // SLABS_A_BUCKET)
    answered = lambda asked, name, least: cut(asked.groupBy("bucket").applyInArrow(lambda x: _answer(x, least), ANSWERED), name)
    with_slab = lambda answers: parts.select("slab", "docs").groupBy("slab").cogroup(answers.groupBy("slab"))
    told = lambda answers, of_pairs: answers.select("slab", "bucket", "n", "n_target", F.lit(of_pairs).alias("of_pairs"), F.lit(None).cast("array<int>").alias("places"))
    empty = {k: F.lit(None).cast(kind) for k, kind in (x.split() for x in TOLD.split(", "))}
    heard = of_slab.select(*(F.col(k) if k in ("slab", "places") else v.alias(k) for k, v in empty.items()))
    words = answered(with_slab(heard).applyInArrow(lambda part, own: _ask_words(part, own, buckets), ASKED), "lm-words", LEAST)
    totals = Totals.of(words, (ends, target_ends))
    heard = heard.unionByName(told(words, False))
    pairs = answered(with_slab(heard).applyInArrow(lambda part, own: _ask_pairs(part, own, buckets), ASKED), "lm-pairs", 1)
    heard = heard.unionByName(told(pairs, True))
    return with_slab(heard).applyInArrow(lambda part, own: _score(part, own, buckets, totals), SCORED)


def _slabs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slabs of rows (doc_id, text and target), and slab, row, doc_id, has and target of every row."""
    parts = cut(rows.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("target").cast("boolean")).mapInArrow(_packed, PARTS), "lm-slabs")
    listed = parts.select("slab", F.posexplode(F.arrays_zip("ids", "has", "target")).alias("row", "of"))
    return parts, listed.select("slab", "row", F.col("of.ids").alias("doc_id"), F.col("of.has").alias("has"), F.col("of.target").alias("target"))


def score(rows: DataFrame) -> DataFrame:
    """rows: doc_id, text and target (boolean). doc_id, n_tokens, target_loss, background_loss and score of every row."""
    parts, listed = _slabs(rows)
    return _scored(parts, listed.where("target"))


def cross_entropy_difference(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Scores of docs, with those whose doc_id is in targets as the target corpus. Both grow together, so their ids are
    joined by sorting at every size; texts stay where they are."""
    ids = targets.select(F.col("doc_id").cast("bigint").alias("_target_id")).where("_target_id is not null").distinct()
    parts, listed = _slabs(docs.select("doc_id", "text", F.lit(False).alias("target")))
    return _scored(parts, listed.join(ids.hint("merge"), F.col("doc_id") == F.col("_target_id"), "left_semi"))
