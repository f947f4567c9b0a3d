"""Running sums over a whole table without a task that sorts all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN_BITS = 12


def before(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of a smaller ``key`` (a unique integer that is not negative) as ``name``.

    Keys are cut into spans of 4096, spans into groups of 4096 spans: sums run within a span, over the spans of a group and over the
    groups, each a window that is partitioned by the level above. The top level has a row for each 16 million keys.
    """
    spans = df.withColumn("_s", F.shiftright(F.col(key), SPAN_BITS))
    per_span = spans.groupBy("_s").agg(F.sum(value).alias("_n")).withColumn("_g", F.shiftright("_s", SPAN_BITS))
    per_group = per_span.groupBy("_g").agg(F.sum("_n").alias("_m"))
    group_first = per_group.select("_g", (F.sum("_m").over(Window.orderBy("_g")) - F.col("_m")).alias("_gf"))
    in_group = F.sum("_n").over(Window.partitionBy("_g").orderBy("_s")) - F.col("_n")
    first = per_span.withColumn("_if", in_group).join(group_first, "_g").select("_s", (F.col("_if") + F.col("_gf")).alias("_f"))
    inside = F.sum(value).over(Window.partitionBy("_s").orderBy(key)) - F.col(value)
    return spans.withColumn("_i", inside).join(first, "_s").withColumn(name, F.col("_i") + F.col("_f")).drop("_s", "_i", "_f")
