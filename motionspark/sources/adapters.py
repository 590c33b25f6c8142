"""The driver's tables as the tables of the analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionspark.runtime import dealt_out

PX_UM = 0.26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as shift frames: one recording a user, 1 frame a second; the only shuffle is by recording."""
    lost = (F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)
    number = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    shift = lambda x: F.when(~F.coalesce(lost, F.lit(False)), (x - 50) / 10)
    order = Window.partitionBy("recording").orderBy("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .select(F.concat(F.lit("S"), "user_id").alias("recording"), F.when(F.col("user_id") % 2 == 0, "control").otherwise("experimental").alias("group"), "ts", "event_id", shift(F.col("value")).alias("dx_px"), shift(number).alias("dy_px"))
        .withColumn("frame", F.row_number().over(order))
        .select("recording", "group", "frame", "dx_px", "dy_px", F.lit(1.0).alias("fps"), F.lit(PX_UM).alias("px_um"))
    )


def traces(spark: SparkSession, sf_dir: str, offset: float = 0.0) -> DataFrame:
    """``embeddings`` as fluorescence traces: a recording a label, a region a vector, 2 frames a second. The rows are dealt out: a file is
    few tasks, or one, however many traces it holds, and measuring a trace takes about 2 ms."""
    trace = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(offset))
    return dealt_out(table(spark, sf_dir, "embeddings"), "vec_id").select(
        F.concat(F.lit("L"), "label").alias("recording"), (F.col("label") % 2).cast("string").alias("condition"), F.col("vec_id").alias("roi_id"), trace.alias("trace"), F.lit(2.0).alias("fps")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as movies of 8 by 8 pixels in long form."""
    order = Window.partitionBy("label").orderBy("vec_id")
    numbered = table(spark, sf_dir, "embeddings").withColumn("frame", F.row_number().over(order))
    long = numbered.select(F.concat(F.lit("L"), "label").alias("recording"), "frame", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "value"))
    return long.select("recording", "frame", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "value")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as nested values: condition, sample, and one row for each metric of a region."""
    wide = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("condition"), F.col("l_suppkey").alias("sample"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_discount").cast("double").alias("discount")
    )
    return wide.unpivot(["condition", "sample"], ["quantity", "price", "discount"], "metric", "value")
