"""Best-fit packing of documents into sequences of a fixed length, planned on the histogram of lengths.

plan() runs best-fit decreasing on counts: bins that hold the same lengths are one group, so its work and its result
depend on the sequence length, not on the number of documents. pack() then gives every piece its rank among the pieces
of its length and joins the planned segment that holds this rank. Ranks are counted in buckets whose number follows
spark.sql.shuffle.partitions, so no task gets all pieces of a frequent length.

Nulls: a null text is an empty one and is packed as the end id alone; a null doc_id is kept. Repeated rows are pieces
of their own (ties in rank fall anyhow). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.state import cut
from trackloom.llm.tokens import pieces

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
SEGMENTS = "length bigint, low bigint, high bigint, sequence bigint, each bigint, place bigint"


def tokenize(docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit)."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(partial(pieces, path=tokenizer, most=most, end_id=end_id), PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, low, high, sequence, each, place): ranks low to high of a length go to sequences from
    sequence on, each of them to a sequence, the first at place.

    Best-fit decreasing: a piece goes where it leaves the least room. A bin that has taken a piece is then the best one
    for further pieces of this length while they fit, so bins of a group fill one after another.
    """
    rooms: list[int] = []  # ascending
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, bins)

    def put(room: int, first: int, bins: int) -> None:
        if bins and room:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((first, bins))

    out, opened = [], 0
    for length in sorted(histogram, reverse=True):
        low, left = 0, histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, bins = groups[room].pop()
                if not groups[room]:
                    rooms.pop(k)
            else:
                room = capacity
                first, bins = opened, -(-left // (capacity // length))
                opened += bins
            each = room // length
            full, rest = min(bins, left // each), 0
            if full < bins:
                rest = min(left - full * each, each - 1)
            place = capacity - room
            if full:
                out.append((length, low, low + full * each, first, each, place))
                put(room - each * length, first, full)
            low, left = low + full * each, left - full * each
            if rest:
                out.append((length, low, low + rest, first + full, rest, place))
                put(room - rest * length, first + full, 1)
            low, left = low + rest, left - rest
            used = full + bool(rest)
            put(room, first + used, bins - used)
    return out


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """items: rows with length (1 to capacity) and other columns; adds sequence_id and offset (gapless from 0)."""
    spark = items.sparkSession
    items = cut(items, "pieces")
    histogram = {r.length: r.n for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    segments = F.broadcast(spark.createDataFrame(plan(histogram, capacity), SEGMENTS))  # bounded by capacity alone
    share = max(1, sum(histogram.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counts = spark.createDataFrame([(k, -(-n // share)) for k, n in histogram.items()] or [(0, 1)], "length bigint, buckets bigint")
    keys = [c for c in items.columns if c != "length"]
    spread = items.join(F.broadcast(counts), "length").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.col("buckets"))).drop("buckets")
    sizes = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy(*keys)
    ranked = spread.withColumn("rank", F.row_number().over(within)).join(starts, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("rank") - 1)
    found = ranked.join(segments, (ranked["length"] == segments["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(segments["length"])
    nth = F.col("rank") - F.col("low")
    return found.select(*items.columns, (F.col("sequence") + F.floor(nth / F.col("each"))).cast("bigint").alias("sequence_id"), (F.col("place") + F.pmod(nth, F.col("each")) * F.col("length")).cast("bigint").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    found = tokenize(docs, tokenizer, capacity, end_id)
    return pack(found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
