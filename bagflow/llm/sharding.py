"""Operator 5: contiguous shards of near equal bytes from global prefix sums, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagflow.llm.common import own, prepared, table


def shards_by_bytes(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The documents are laid in one line ordered by key; a document goes to the shard whose equal share of all bytes holds
    its middle byte. So a shard is a contiguous run of the line and misses the equal share by at most one document.
    Only (key, size, crc) is shuffled, never a text. Range parts are written with their number to the checkpoint folder,
    since the bounds of a range exchange come from a sample and may differ if it is run again. A row per part (parts is a
    number, not data) and a row per shard are all that is broadcast.

    Null text: size 1, crc 0. Null keys stand first. Rows of equal key are ordered by crc and size; rows equal in all
    three are interchangeable. An empty table gives no rows. Further columns are ignored."""
    spark = prepared(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    light = own(docs, doc_id=key, size=(F.octet_length(body) + 1).cast("long"), text_crc32=F.crc32(body.cast("binary")))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_crc32", "size"]
    placed = light.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).checkpoint()

    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        placed.withColumns({"upto": F.sum("size").over(running), "nth": F.row_number().over(running)})
        .join(F.broadcast(offsets), "part")
        .withColumn("place", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.expr(f"cast(((2 * (bytes_before + upto) - size) * {shards}L) div (2 * total) as int)"))
    )
    first = cut.groupBy("shard").agg(F.min("place").alias("first_place"))
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first_place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark, sf_dir):
    return shards_by_bytes(table(spark, sf_dir, "documents"))
