"""Sources, sinks and selection of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHIFT_COLUMNS = "frame int, dx_px double, dy_px double, dx_um double, dy_um double, fps_measured double, fps_used double, px_um double"


def read_shifts(spark: SparkSession, path: str, px_um: float = 0.26, fps: float = 1.0, fps_override: float | None = None, include_cropped: bool = False, glob: str = "*_shifts.csv") -> DataFrame:
    """All ``*_shifts.csv`` of a folder in one schema: the recording comes from the file name, or from folders
    ``recording=...``; absent or non-finite values are NULL, micrometres fall back to pixels, and the frame rate to the default."""
    raw = spark.read.option("header", True).option("pathGlobFilter", glob).option("enforceSchema", False).csv(path)
    named = {c.lower(): c for c in raw.columns}
    number = lambda c: F.expr(f"try_cast(`{named[c]}` as double)") if c in named else F.lit(None).cast("double")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    px = F.coalesce(finite(number("px_um")), F.lit(px_um))
    rate = F.lit(fps_override) if fps_override else F.coalesce(finite(number("fps_measured")), finite(number("fps_used")), F.lit(fps))
    name = F.col(named["recording"]).cast("string") if "recording" in named else F.regexp_replace(F.col("_metadata.file_name"), r"_shifts\.csv$", "")
    rows = raw.select(
        name.alias("recording"), number("frame").cast("int").alias("frame"),
        F.coalesce(finite(number("dx_um")), finite(number("dx_px")) * px).alias("dx_um"), F.coalesce(finite(number("dy_um")), finite(number("dy_px")) * px).alias("dy_um"), rate.alias("fps"), px.alias("px_um"),
    )
    return rows if include_cropped else rows.filter(~F.lower("recording").contains("cropped"))


def write_shifts(frames: DataFrame, path: str, folders: bool = True) -> None:
    """Shifts as CSV files in a folder for each recording (``recording=...``), which ``read_shifts`` reads with
    ``glob="*.csv"``; without ``folders`` a file holds many whole recordings, named in a column, so the number of files does not grow
    with theirs. One shuffle by recording."""
    writer = frames.repartition("recording").write.option("header", True)
    (writer.partitionBy("recording") if folders else writer).csv(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Writes CSV, TSV, JSON, text (one column) or Parquet."""
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if kind in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind in ("json", "text", "parquet"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def normalize_file(df: DataFrame) -> DataFrame:
    """``File`` from a column named like it, else "unknown"; .csv becomes .avi."""
    named = next((c for c in df.columns if c.lower() in ("file", "filename", "avi", "stem")), None)
    value = F.regexp_replace(F.col(named).cast("string"), r"\.csv$", ".avi") if named else F.lit("unknown")
    return df.withColumn("File", value)


def select_inputs(files: DataFrame) -> DataFrame:
    """Names without case-insensitive repeats and without ``_rigid``, ordered by the number after S."""
    first = Window.partitionBy(F.lower("name")).orderBy("name")
    kept = files.filter(~F.lower("name").contains("_rigid")).withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    number = F.expr("try_cast(regexp_extract(name, 'S(\\\\d+)', 1) as int)")
    return kept.withColumn("number", number).orderBy(F.col("number").asc_nulls_last(), "name")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The names of a list file: column Stem, one row a word."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("Stem")).filter("Stem <> ''")


def eligible(recordings: DataFrame, candidates: DataFrame | None, gate: str = "ROI_ELIGIBLE", listed: DataFrame | None = None) -> DataFrame:
    """Recordings of the list file (column Stem), which counts when the gate is ROI_ELIGIBLE; without one, those that pass
    the gate of the candidates' table, or its ROI_ELIGIBLE; all that it names if it has neither, and all without a table."""
    if listed is not None and gate.upper() == "ROI_ELIGIBLE":
        return recordings.join(listed.select(F.col("Stem").alias("recording")), "recording", "left_semi")
    if candidates is None:
        return recordings
    gate = gate if gate in candidates.columns else "ROI_ELIGIBLE"
    if gate not in candidates.columns:
        return recordings
    return recordings.join(candidates.filter(F.col(gate)).select(F.col("Stem").alias("recording")), "recording", "left_semi")


def pending(inputs: DataFrame, done: DataFrame, key: str = "recording") -> DataFrame:
    return inputs.join(done.select(key), key, "left_anti")


def group_label(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("hydrogel +") | low.contains("ether") | low.contains("experimental"), "experimental").when(low.contains("hydrogel") | low.contains("control"), "control").otherwise("unknown")


def join_motion(samples: DataFrame, motion: DataFrame) -> DataFrame:
    """Each sample's motion row: the same stem without case first, else the first motion stem that contains the sample's.
    Samples without an equal stem meet the pieces of the motion stems that are as long as one of their stems, by equality:
    no stem is held against one that does not contain it."""
    s, m = samples.withColumn("_s", F.lower("stem")), motion.select(F.lower("stem").alias("_m"), F.col("stem").alias("motion_stem"), "ordinal")
    least = F.min(F.struct("ordinal", "motion_stem")).alias("_b")
    equal = s.join(m.groupBy("_m").agg(least), s["_s"] == F.col("_m")).select(*samples.columns, F.col("_b.motion_stem").alias("motion_stem"), F.lit("exact").alias("match"))
    rest = s.join(m.select(F.col("_m").alias("_s")), "_s", "left_anti")
    lengths = F.array(*[F.lit(r[0]) for r in rest.filter("_s is not null").select(F.length("_s")).distinct().collect()]).cast("array<int>")  # as many as a stem is long
    cut = F.flatten(F.transform(lengths, lambda k: F.when(F.length("_m") >= k, F.transform(F.sequence(F.lit(1), F.length("_m") - k + 1), lambda i: F.substring(F.col("_m"), i, k))).otherwise(F.array().cast("array<string>"))))
    pieces = m.select("motion_stem", "ordinal", F.explode(F.array_distinct(cut)).alias("_s"))
    chosen = rest.select("_s").distinct().join(pieces, "_s").groupBy("_s").agg(least)
    near = rest.join(chosen, "_s").select(*samples.columns, F.col("_b.motion_stem").alias("motion_stem"), F.lit("contains").alias("match"))
    return equal.unionByName(near)


def read_motion_tables(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The qc and enriched tables of one group's folder, joined on File; columns that both have come from qc. ``kind`` is
    parquet, or csv for files with a header."""
    read = lambda name: spark.read.parquet(f"{path}/{name}") if kind == "parquet" else spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{name}")
    qc, enriched = normalize_file(read("qc")), normalize_file(read("enriched"))
    own = [c for c in enriched.columns if c == "File" or c not in qc.columns]
    return qc.join(enriched.select(*own), "File", "left")
