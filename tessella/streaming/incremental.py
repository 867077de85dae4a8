"""An extension: gene statistics kept up to date over arriving files of log-ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def partial_stats(ranks: DataFrame) -> DataFrame:
    """Mergeable sums of one batch of whole cells: by gene, and with gene null of the cells."""
    genes = ranks.groupBy("gene").agg(F.sum("lr").alias("s"), F.coalesce(F.sum("zero_lr"), F.lit(0.0)).alias("z"), F.count(F.lit(1)).alias("k"))
    cells = ranks.groupBy("cell").agg(F.max("zero_lr").alias("z")).agg(F.lit(None).cast("string").alias("gene"), F.lit(0.0).alias("s"), F.coalesce(F.sum("z"), F.lit(0.0)).alias("z"), F.count(F.lit(1)).alias("k"))
    return genes.unionByName(cells)


def merged_stats(parts: DataFrame) -> DataFrame:
    """(gene, g_mean, frac) from the parts of all batches."""
    total = parts.groupBy("gene").agg(F.sum("s").alias("s"), F.sum("z").alias("z"), F.sum("k").alias("k"))
    cells = total.where("gene IS NULL").select(F.col("z").alias("zc"), F.col("k").alias("n"))
    return total.where("gene IS NOT NULL").withColumn("_k", F.lit(1)).join(F.broadcast(cells.withColumn("_k", F.lit(1))), "_k").select("gene", ((F.col("s") + F.col("zc") - F.col("z")) / F.col("n")).alias("g_mean"), (F.col("k") / F.col("n")).alias("frac"))


def keep_stats(ranks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's sums into its own folder, so that a repeated batch replaces its first write."""

    def write(batch: DataFrame, number: int) -> None:
        partial_stats(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return ranks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
