"""Sources, sinks and the choice of inputs."""

from pyspark.sql import functions as F

from motionspark.operators import files, gates, traces


def test_read_shifts(spark, tmp_path):
    (tmp_path / "S1_shifts.csv").write_text("Frame,dx_px,dy_px,dx_um,dy_um\n1,1,2,NaN,0.5\n2,Inf,3,,\n")
    (tmp_path / "S2_cropped_shifts.csv").write_text("Frame,dx_px,dy_px,dx_um,dy_um\n1,1,2,1,1\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    got = [tuple(r) for r in files.read_shifts(spark, str(tmp_path), px_um=0.5, fps=2.0).orderBy("frame").collect()]
    assert got == [("S1", 1, 0.5, 0.5, 2.0, 0.5), ("S1", 2, None, 1.5, 2.0, 0.5)]
    assert files.read_shifts(spark, str(tmp_path), include_cropped=True).count() == 3


def test_select_inputs(spark):
    names = spark.createDataFrame([("S10.avi",), ("s2.AVI",), ("S2.avi",), ("S3_Rigid.avi",), ("x.avi",)], "name string")
    assert [r["name"] for r in files.select_inputs(names).collect()] == ["S2.avi", "S10.avi", "x.avi"]


def test_group_labels_depend_on_order(spark):
    rows = spark.createDataFrame([("a/Hydrogel + x",), ("a/hydrogel",), ("b/Ether",), ("c",)], "p string")
    assert [r[0] for r in rows.select(files.group_label(F.col("p"))).collect()] == ["experimental", "control", "experimental", "unknown"]


def test_eligible_falls_back(spark):
    rec = spark.createDataFrame([("A",), ("B",)], "recording string")
    cand = spark.createDataFrame([("A", True), ("B", False)], "Stem string, ROI_ELIGIBLE boolean")
    assert files.eligible(rec, cand, "MISSING").count() == 1
    assert files.eligible(rec, cand.drop("ROI_ELIGIBLE"), "MISSING").count() == 2


def test_motion_stems(spark):
    s = spark.createDataFrame([(1, "abcd1"), (2, "ABCD1"), (3, "bcd"), (4, "zzzz")], "k int, stem string")
    m = spark.createDataFrame([("Abcd1", 1), ("xbcdef", 2), ("abcd1x", 3)], "stem string, ordinal int")
    got = {r["k"]: (r["motion_stem"], r["match"]) for r in files.join_motion(s, m).collect()}
    assert got[1] == got[2] == ("Abcd1", "exact") and 4 not in got
    assert got[3] == ("Abcd1", "contains")


def test_reasons(spark):
    row = spark.range(1).select(gates.reasons([("a", F.lit(True)), ("b", F.lit(None).cast("boolean")), ("c", F.lit(True))], "OK"), gates.reasons([("a", F.lit(False))], "OK")).first()
    assert list(row) == ["a,c", "OK"]


def test_severity(spark):
    got = spark.createDataFrame([(0.6,), (0.4,), (0.2,), (0.1,), (None,)], "s double").select(traces.neuropil_severity(F.col("s"))).collect()
    assert [r[0] for r in got] == ["SEVERE", "HIGH", "MILD", "LOW", None]


def test_shifts_of_many_recordings_take_few_files(spark, tmp_path):
    data = [(f"r{k}", i, k + i / 2 if i % 3 else None, float(-i)) for k in range(60) for i in range(1, 8)]
    f = spark.createDataFrame(data, "recording string, frame int, dx_px double, dy_px double")
    files.write_shifts(f, str(tmp_path / "x"), folders=False)
    assert len(list((tmp_path / "x").rglob("*.csv"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = files.read_shifts(spark, str(tmp_path / "x"), px_um=1.0, glob="*.csv").select("recording", "frame", "dx_um", "dy_um")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(data, key=lambda r: r[:2])


def test_judged_recordings_are_written_once_for_their_tables(spark, monkeypatch):
    from motionspark.jobs import group_queries

    seen = []
    real = group_queries.checkpointed
    monkeypatch.setattr(group_queries, "checkpointed", lambda df: seen.append(df.columns) or real(df))
    assert group_queries.QUERIES["io03_read_motion_tables"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 1 and "roi_eligible" in seen[0]
