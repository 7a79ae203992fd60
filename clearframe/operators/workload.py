"""Analytics over logs of edit events: batches, folds, gaps and cost tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def batches(events: DataFrame) -> DataFrame:
    """Edits with the number of their batch in the stream: a command closes a batch."""
    order = W.partitionBy("stream").orderBy("ts", "ord")
    marked = events.withColumn("batch", F.count_if(F.col("kind") == "command").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.where("kind = 'edit'")


def batch_table(events: DataFrame) -> DataFrame:
    return batches(events).groupBy("stream", "batch").agg(
        F.min("ts").alias("start_at"), F.max("ts").alias("end_at"), F.count("*").alias("edits"), F.countDistinct("file").alias("files"), F.round(F.sum("cost"), 4).alias("cost")
    )


def file_folds(events: DataFrame) -> DataFrame:
    """Per batch and file: the first and last event, and how many."""
    at = F.struct("ts", "ord")
    return batches(events).groupBy("stream", "batch", "file").agg(F.min_by("ord", at).alias("first_ord"), F.max_by("ord", at).alias("last_ord"), F.count("*").alias("n"))


def known_state(events: DataFrame) -> DataFrame:
    """Per edit: the previous edit of the file since the last command that touched sources."""
    order = W.partitionBy("stream").orderBy("ts", "ord")
    epoch = F.count_if(F.col("touches_src") & (F.col("kind") == "command")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    file_order = W.partitionBy("stream", "file", "epoch").orderBy("ts", "ord")
    return events.withColumn("epoch", epoch).where("kind = 'edit'").withColumn("known", F.lag("ord").over(file_order)).select("stream", "ord", "file", "epoch", "known")


def shapes(events: DataFrame) -> DataFrame:
    """Batches by the set of their files: how many have it and what they cost."""
    key = F.array_join(F.array_sort(F.collect_set("file")), "+")
    each = batches(events).groupBy("stream", "batch").agg(key.alias("shape"), F.sum("cost").alias("cost"))
    return each.groupBy("shape").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


def gaps(table: DataFrame) -> DataFrame:
    """(stream, batch, gap): seconds since the batch before in order of all starts, where it is of
    the same stream and had ended.

    Order over all streams needs one ordering; a range partitioning with the last start of every
    earlier partition would spread it, but batches are few beside events.
    """
    before = F.lag(F.struct("stream", "end_at")).over(W.orderBy("start_at", "stream", "batch"))
    seconds = F.unix_timestamp("start_at") - F.unix_timestamp("p.end_at")
    return table.withColumn("p", before).where((F.col("p.stream") == F.col("stream")) & (F.col("p.end_at") <= F.col("start_at"))).select("stream", "batch", seconds.alias("gap"))


def class_table(events: DataFrame) -> DataFrame:
    """Batches by size class: number, share, nearest-rank quantiles of edits."""
    size = F.when(F.col("edits") == 1, "one").when(F.col("edits") <= 5, "few").otherwise("many")
    t = batch_table(events).withColumn("cls", size)
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY edits)").cast("long")
    out = t.groupBy("cls").agg(F.count("*").alias("n"), rank(0.5).alias("p50"), rank(0.75).alias("p75"), rank(0.9).alias("p90"), F.max("edits").alias("most"), F.sum("edits").alias("edits"))
    total = t.agg(F.count("*").alias("total"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).drop("total")
