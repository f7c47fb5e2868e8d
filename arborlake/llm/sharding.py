"""Minimax contiguous sharding: the smallest feasible shard capacity over ordered atomic groups, then cut there."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Probed capacities in one pass of the search, buckets of the order, and slot ranges of a shard.
PROBES, DIGITS, RANGES = 24, 3, 256


def _greedy(cum: DataFrame, ends: list[tuple[int, int, int]], total: int, capacities: list[int], shards: int) -> dict[int, list[int]]:
    """For each capacity the ends (running sizes) of its shards when each takes all that still fits; as many steps as shards.

    A step asks the table of running sizes for the last group end within reach. Only the bucket that holds the end of the
    reach is read (the table is sorted by bucket), so the cost doesn't grow with the number of groups before it.
    """
    starts = [s for _, s, _ in ends]
    at = {c: [0] for c in capacities}
    for _ in range(shards - 1):
        asked = []
        for c, cuts in at.items():
            if cuts[-1] < total:
                reach = cuts[-1] + c
                bucket, start, end = ends[bisect_right(starts, reach) - 1]
                if reach >= end:
                    cuts.append(end)
                else:
                    asked.append((c, bucket, start, reach))
        if asked:
            session = cum.sparkSession
            reaches = session.sql(f"SELECT * FROM VALUES {', '.join(f'({c}L, {b}, {reach}L)' for c, b, _, reach in asked)} AS t(capacity, bucket, reach)")
            near = cum.where(F.col("bucket").isin(sorted({b for _, b, _, _ in asked})))
            last = dict(near.join(F.broadcast(reaches), "bucket").where("cum <= reach").groupBy("capacity").agg(F.max("cum")).collect())
            for c, _, start, _ in asked:
                at[c].append(last.get(c, start))
    for c, cuts in at.items():
        if 0 < total - cuts[-1] <= c:
            cuts.append(total)
    return at


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", probes: int = PROBES) -> DataFrame:
    """Documents with shard and slot, so that the largest shard is as small as contiguous shards of whole groups can be.

    Groups are the rows with equal texts (null texts form one group); they are atomic and ordered by the SHA-256 of the
    text, null first. A row's size is the UTF-8 bytes of its text (null: none) plus 1. The smallest capacity for which greedy
    filling needs at most ``shards`` shards is found by bisection with ``probes`` probes in a pass (so a range shrinks by
    probes + 1); the cuts are then keys of that order, and a row finds its shard by comparing its own key to them: no join.
    One text may hold any share of the rows: its rows are summed before the shuffle. Slots number the rows of a shard from 0,
    ordered by a hash range of the id, then id and text; each range is numbered by itself and starts where the one before ends.

    Result: id_col, size long, text_crc32 long, law string ("bytes"), shard int, slot long, grown_shard int (null). An empty
    table gives no rows. Rows with null ids are kept; repeated rows have slots of their own; other columns are not returned.
    Where one group is larger than the mean shard, later shards may stay empty.
    """
    text, key = F.col(text_col), F.col("_key")
    rows = written(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
            F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("_crc"),
            F.coalesce(F.sha2(text, 256), F.lit("-")).alias("_key"),
        ),
        "shard-rows",
    )
    bucket = F.when(key == "-", F.lit(0)).otherwise(F.conv(F.substring(key, 1, DIGITS), 16, 10).cast("int"))
    groups = rows.groupBy("_key").agg(F.sum("_size").alias("size")).withColumn("bucket", bucket)
    cut_keys: list[str] = []
    # At most 16 ** DIGITS rows, whatever the input.
    sums = sorted(groups.groupBy("bucket").agg(F.sum("size").alias("size"), F.max("size").alias("most")).collect())
    if sums:
        ends, total = [], 0
        for b, size, _ in sums:
            ends.append((b, total, total + size))
            total += size
        starts = groups.sparkSession.createDataFrame([(b, s) for b, s, _ in ends], "bucket int, start long")
        in_bucket = Window.partitionBy("bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = written(
            groups.join(F.broadcast(starts), "bucket").select("bucket", "_key", (F.col("start") + F.sum("size").over(in_bucket)).alias("cum")).repartitionByRange("bucket").sortWithinPartitions("bucket", "cum"),
            "shard-groups",
        )
        most = max(m for _, _, m in sums)
        low, high = max(-(-total // shards), most), min(total, -(-total // shards) + most)  # high is always feasible
        found = None
        while low < high:
            step = max(1, (high - low) // (probes + 1))
            tried = sorted({c for k in range(probes) if (c := low + k * step) < high})
            cuts = _greedy(cum, ends, total, tried, shards)
            good = [c for c in tried if cuts[c][-1] >= total]
            if good:
                high, found = good[0], cuts[good[0]]
            below = [c for c in tried if cuts[c][-1] < total and c < high]
            low = below[-1] + 1 if below else high
        if found is None or high == total:
            found = _greedy(cum, ends, total, [high], shards)[high]
        inner = [c for c in found[1:] if c < total]
        if inner:
            where = sorted({ends[bisect_right([s for _, s, _ in ends], c - 1) - 1][0] for c in inner})
            cut_keys = sorted(r[0] for r in cum.where(F.col("bucket").isin(where) & F.col("cum").isin(inner)).select("_key").collect())
    shard = sum((F.when(key > k, 1).otherwise(0) for k in cut_keys), F.lit(0)).cast("int")
    placed = rows.withColumn("shard", shard).withColumn("_range", F.pmod(F.xxhash64("_id"), F.lit(RANGES)).cast("int"))
    counts = placed.groupBy("shard", "_range").agg(F.count("*").alias("_n"))  # at most shards * RANGES rows
    offsets = counts.select("shard", "_range", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_n")).alias("_from"))
    slot = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_id", "_key"))
    return (
        placed.withColumn("_row", slot)
        .join(F.broadcast(offsets), ["shard", "_range"])
        .select(
            F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
            (F.col("_from") + F.col("_row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
