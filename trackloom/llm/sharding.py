"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts are a group and stay together, unless the group alone is more than a fraction of a shard: then it
is dealt in parts, each placed as a group of its own. Heavy groups (over 1 / HEAVY of a shard, so a bounded number) are
placed one by one; all others by size class (bytes, tokens and rows within a small ratio), planned together: plan() takes the classes from the heaviest down and gives chunks of each to the shard
where the dot product of the chunk's vector with the residual capacity is highest. Its work depends on the number of
classes, which the ratio bounds, and on the number of shards; groups take the planned places by their rank in the class.

The law is `bytes`: the sizes of shards are near equal. Nulls: a null text has no bytes and counts 1; all null texts
are one group, apart from empty ones. Repeated rows are rows of their own. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.state import cut

#: Classes of size: values within a 2 ** (1 / STEPS) ratio are one class of a dimension.
STEPS = 4
#: A group over this share of a shard is dealt in parts of about this size.
PART = 1 / 64
#: Places planned for a class at most, in multiples of the number of shards; more groups share a place in turn.
ROUNDS = 4
#: Groups over this share of a shard are placed one by one: 3 * shards * HEAVY of them at most.
HEAVY = 256
#: Of bytes, tokens and rows in the dot product.
WEIGHTS = np.array([4.0, 1.0, 1.0])


def _class(c: Column) -> Column:
    return F.floor(F.log2(c.cast("double")) * STEPS).cast("int")


def plan(classes: list[tuple], totals: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """classes: (class_id, groups, bytes, tokens, rows in all). Returns (class_id, low, high, shard): groups of ranks
    from low to high, in a class, go to this shard."""
    residual = np.tile(totals / shards, (shards, 1)).astype(float)
    scale = np.where(totals > 0, totals / shards, 1).astype(float)
    out = []
    for class_id, groups, *size in sorted(classes, key=lambda c: (-max(np.array(c[2:]) / c[1] / scale), c[0])):
        each = np.array(size, float) / groups
        places = min(groups, ROUNDS * shards)
        edges = [groups * k // places for k in range(places + 1)]
        for low, high in zip(edges, edges[1:], strict=False):
            vector = each * (high - low)
            fit = ((residual / scale) * (vector / scale)) @ WEIGHTS
            shard = int(np.argmax(fit))
            residual[shard] -= vector
            out.append((class_id, low, high, shard))
    return out


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("tokens"),
            F.coalesce(F.xxhash64(F.sha2(text, 256)), F.lit(0)).alias("group"),
        ),
        "shard-rows",
    )
    whole = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    totals = np.array([x or 0 for x in whole], float)
    limits = [max(1.0, t * PART / shards) for t in totals]
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    part = F.pmod(F.xxhash64("doc_id", "size"), F.col("parts"))
    groups = rows.groupBy("group").agg(*sums)
    parts = F.ceil(F.greatest(*(F.col(c) / F.lit(m) for c, m in zip(("size", "tokens", "rows"), limits, strict=True)))).cast("bigint")
    split = groups.withColumn("parts", parts).where("parts > 1 and rows > 1").select("group", "parts")  # at most 3 * shards / PART of them
    rows = cut(rows.join(F.broadcast(split), "group", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(part)).drop("parts"), "shard-parts")
    groups = rows.groupBy("group", "part").agg(*sums).withColumn("class", F.struct(_class(F.col("size")), _class(F.col("tokens") + 1), _class(F.col("rows"))).cast("string"))
    heavy = F.greatest(*(F.col(c) * (shards * HEAVY) > F.lit(float(t)) for c, t in zip(("size", "tokens", "rows"), totals, strict=True)))
    groups = cut(groups.withColumn("class", F.when(heavy, F.concat_ws(":", F.lit("one"), "group", "part")).otherwise(F.col("class"))), "shard-groups")
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("size"), F.sum("tokens"), F.sum("rows")).collect()  # bounded by STEPS
    share = max(1, sum(c[1] for c in classes) // (4 * spread))
    counts = spark.createDataFrame([(c[0], -(-c[1] // share)) for c in classes] or [("", 1)], "class string, buckets bigint")
    placed = numbered(groups.join(F.broadcast(counts), "class").withColumn("bucket", F.pmod(F.xxhash64("group", "part"), F.col("buckets"))), "class", ["size", "group", "part"], "rank")
    planned = spark.createDataFrame(plan([tuple(c) for c in classes], totals, shards), "in_class string, low bigint, high bigint, shard int")
    placed = placed.join(F.broadcast(planned), (F.col("class") == F.col("in_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    out = rows.join(placed.select("group", "part", "shard"), ["group", "part"])
    buckets = max(1, 4 * spread // shards)
    out = numbered(out.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "group"), F.lit(buckets))), "shard", ["doc_id", "group"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds numbers from 0 without gaps among the rows of a key, counted bucket by bucket (column bucket), so that no
    task holds all rows of a key."""
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n")).select(key, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy(key, "bucket").orderBy(*order)
    return df.withColumn(name, F.row_number().over(own)).join(starts, [key, "bucket"]).withColumn(name, (F.col("base") + F.col(name) - 1).cast("bigint")).drop("base", "bucket")
