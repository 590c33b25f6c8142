"""Registered queries of traces, sample quality and refinement (driver table ``embeddings``), with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionspark.jobs.motion_queries import hz, six
from motionspark.operators import movies, refine, tables, traces
from motionspark.sources import adapters

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rows(spark, sf):
    """Traces of five times the vectors' values, so that thresholds on dF/F decide something."""
    t = adapters.traces(spark, sf)
    return t.withColumn("trace", F.transform("trace", lambda v: v * 5))


TR = """tr as (select 'L' || label as recording, (label % 2)::varchar as condition, vec_id as roi_id, list_transform(embedding::double[], lambda v: v * 5) as x from embeddings),
pt as (select recording, roi_id, unnest(x) as v, unnest(range(1, len(x) + 1)) as frame from tr)"""


@query("im17_dff", f"""with {TR}, c as (select recording, roi_id, frame, (v + 50) - 0.7 * 20.0 as f from pt),
a as (select *, min(f) over w as lo from c window w as (partition by roi_id order by frame rows between 10 preceding and 9 following)),
b as (select *, avg(lo) over w as base from a window w as (partition by roi_id order by frame rows between 10 preceding and 9 following))
select recording, roi_id, frame::int as frame, round((f - base) / base, 6) as dff from b""")
def im17(spark, sf):
    t = rows(spark, sf).withColumns({"f": F.transform("trace", lambda v: v + 50), "fneu": F.transform("trace", lambda v: F.lit(20.0))})
    got = traces.dff(t, seconds=10).select("recording", "roi_id", F.posexplode("dff_raw").alias("frame", "dff"))
    return six(got.withColumn("frame", F.col("frame") + 1), "dff")


MEAN = "mt as (select recording, frame, avg(v) as m from pt group by all)"


@query("im19_regress_out", f"""with {TR}, {MEAN}, j as (select p.*, m from pt p join mt using (recording, frame)), s as (select roi_id, regr_slope(v, m) as b, regr_intercept(v, m) as a from j group by roi_id)
select recording, roi_id, frame::int as frame, round(v - a - b * m, 6) as residual from j join s using (roi_id)""")
def im19(spark, sf):
    t = rows(spark, sf)
    both = t.join(traces.mean_trace(t, "trace"), "recording")
    got = traces.regress_out(both, "trace", "mean_trace").select("recording", "roi_id", F.posexplode("dff").alias("frame", "residual"))
    return six(got.withColumn("frame", F.col("frame") + 1), "residual")


@query("im19_robust_regression")
def im19r(spark, sf):
    t = rows(spark, sf)
    both = t.join(traces.mean_trace(t, "trace"), "recording")
    got = traces.regress_out(both, "trace", "mean_trace", "robust").select("recording", "roi_id", F.posexplode("dff").alias("frame", "residual"))
    return six(got.withColumn("frame", F.col("frame") + 1), "residual")


PAIRS = f"""{TR}, n as (select recording, roi_id, list_transform(x, lambda v: v - list_avg(x)) as c from tr), u as (select recording, roi_id, c, sqrt(list_sum(list_transform(c, lambda v: v * v))) as s from n),
pairs as (select a.recording, a.roi_id as roi_i, b.roi_id as roi_j, list_dot_product(a.c, b.c) / (a.s * b.s) as r from u a join u b on a.recording = b.recording and a.roi_id < b.roi_id)"""


@query("im20_pairwise_corr", f"with {PAIRS} select recording, roi_i, roi_j, round(r, 6) as r from pairs where abs(r) >= 0.3")
def im20(spark, sf):
    return six(traces.pairwise_corr(rows(spark, sf), "trace", 0.3), "r")


@query("im20_synchrony", f"with {PAIRS} select recording, round(avg(abs(r)), 6) as synchrony from pairs group by recording")
def im20s(spark, sf):
    return six(traces.synchrony(rows(spark, sf), "trace"), "synchrony")


@query("im21_corr_with_mean", f"with {TR}, {MEAN} select p.recording, roi_id, round(corr(v, m), 6) as r_mean from pt p join mt using (recording, frame) group by all")
def im21(spark, sf):
    return six(traces.corr_with_mean(rows(spark, sf), "trace"), "r_mean")


ARTIFACT = "art as (select recording, max(v) as hi, min(v) as lo, max(v) > 2.2 or min(v) < -2.3 as artifact from pt group by recording)"


@query("im22_artifact_flag", f"with {TR}, {ARTIFACT} select recording, round(hi, 6) as max_dff, round(lo, 6) as min_dff, artifact from art")
def im22(spark, sf):
    return six(traces.artifact_flag(rows(spark, sf), "trace", 2.2, -2.3), "max_dff", "min_dff").drop("reason")


@query("im23_neuropil_severity", f"with {PAIRS}, s as (select recording, avg(abs(r)) * 3 as s from pairs group by recording) select recording, case when s > 0.5 then 'SEVERE' when s > 0.3 then 'HIGH' when s > 0.15 then 'MILD' else 'LOW' end as severity from s")
def im23(spark, sf):
    return traces.synchrony(rows(spark, sf), "trace").select("recording", traces.neuropil_severity(F.col("synchrony") * 3).alias("severity"))


@query("im24_savgol")
def im24(spark, sf):
    """All frames: the five-point cubic, and its fit at the ends, which has no closed form in SQL (tested against least
    squares)."""
    got = traces.savgol(rows(spark, sf), "trace").select("recording", "roi_id", F.posexplode("dff_smooth").alias("frame", "s"))
    return six(got.withColumn("frame", F.col("frame") + 1), "s")


@query("im24_inner_frames", f"with {TR}, w as (select recording, roi_id, frame, (-3 * lag(v, 2) over o + 12 * lag(v) over o + 17 * v + 12 * lead(v) over o - 3 * lead(v, 2) over o) / 35 as s from pt window o as (partition by roi_id order by frame)) select recording, roi_id, frame::int as frame, round(s, 6) as s from w where s is not null")
def im24i(spark, sf):
    """The frames that have two others on each side: the five-point cubic."""
    return im24(spark, sf).filter(F.col("frame").between(3, 62))


SNR = f"""{TR}, sm as (select recording, roi_id, frame, v, v - avg(v) over (partition by roi_id order by frame rows between 2 preceding and 1 following) as d from pt),
md as (select *, median(d) over (partition by roi_id) as m from sm),
snr as (select recording, roi_id, ({hz("list_sort(list(v))", 95)} - {hz("list_sort(list(v))", 25)}) / (1.4826 * median(abs(d - m))) as snr from md group by recording, roi_id)"""


@query("im25_snr", f"with {SNR} select recording, roi_id, round(snr, 6) as snr from snr")
def im25(spark, sf):
    return six(traces.snr(rows(spark, sf), "trace"), "snr").select("recording", "roi_id", "snr")


def measured(spark, sf):
    return traces.detect_events(traces.snr(traces.savgol(rows(spark, sf), "trace"), "trace"), "dff_smooth", prominence=0.8)


@query("im26_detect_events")
def im26(spark, sf):
    return six(measured(spark, sf), "event_rate", "event_amplitude").select("recording", "roi_id", "event_count", "event_rate", "event_amplitude")


@query("im27_keep_rois", f"""with {SNR}, c as (select recording, case when median(snr) < 4.5 and median(snr) > 2.25 then greatest(3.15, 0.8 * median(snr)) else 4.5 end as cut from snr group by recording)
select recording, roi_id, snr >= cut or (snr >= 0.8 * cut and roi_id % 4 >= 2) as keep from snr join c using (recording)""")
def im27(spark, sf):
    t = traces.snr(rows(spark, sf), "trace").withColumn("event_count", (F.col("roi_id") % 4).cast("int"))
    return traces.keep_rois(t, 4.5).select("recording", "roi_id", "keep")


STATS = ("mean", "max", "sd", "p25", "p50", "p75", "p90", "p95")


@query("im29_trace_stats", f"with {TR}, s as (select recording, roi_id, list_sort(x) as v, x from tr) select recording, roi_id, round(list_avg(x), 6) as mean, round(list_max(x), 6) as max, round(list_stddev_samp(x), 6) as sd, {', '.join(f'round({hz(chr(118), p)}, 6) as p{p}' for p in (25, 50, 75, 90, 95))} from s")
def im29(spark, sf):
    return six(traces.trace_stats(rows(spark, sf), "trace"), *STATS)


def eventful(spark, sf):
    """Regions with their quality, and events, places and sizes that follow from the id."""
    k = F.col("roi_id")
    return traces.snr(rows(spark, sf), "trace").withColumns({
        "event_rate": (k % 7) / 10.0, "event_amplitude": (k % 5) / 4.0, "event_count": (k % 4).cast("int"), "center_x": (k * 7 % 61).cast("double"), "center_y": (k * 11 % 53).cast("double"), "level": (k % 7).cast("int"),
    })


EVENTFUL = f"{SNR}, ev as (select *, (roi_id % 7) / 10.0 as event_rate, (roi_id % 5) / 4.0 as event_amplitude, (roi_id % 4)::int as event_count, (roi_id * 7 % 61)::double as center_x, (roi_id * 11 % 53)::double as center_y, roi_id % 7 as lv from snr)"
LEVEL_SQL = "case lv " + " ".join(f"when {k} then '{n}'" for k, n in tables.LEVELS.items()) + " else 'unknown' end"


@query("im30_roi_metrics", f"""with {EVENTFUL}, s as (select recording, roi_id, list_sort(x) as v, x from tr)
select recording, roi_id, center_x, center_y, round(snr, 6) as snr, event_count, round(event_rate, 6) as event_rate, round(event_amplitude, 6) as event_amplitude, {LEVEL_SQL} as level, round(list_avg(x), 6) as mean, round(list_max(x), 6) as max, round(list_stddev_samp(x), 6) as sd,
  {', '.join(f'round({hz(chr(118), p)}, 6) as p{p}' for p in (25, 50, 75, 90, 95))}, round(roi_id % 3 * 2.5, 6)::double as area_um2 from ev join s using (recording, roi_id)""")
def im30(spark, sf):
    m = eventful(spark, sf)
    got = tables.roi_metrics(m, traces.trace_stats(rows(spark, sf), "trace"), m.select("recording", "roi_id", (F.col("roi_id") % 3 * 2.5).cast("double").alias("area_um2")))
    return six(got, "snr", "event_rate", "event_amplitude", *STATS)


def listed(spark, sf):
    """All recordings, also some in which no region was found."""
    label = adapters.table(spark, sf, "embeddings").select("label").distinct()
    label = label.unionByName(label.filter("label % 5 = 0").select((F.col("label") + 100).alias("label")))
    return label.select(F.concat(F.lit("L"), "label").alias("recording"), (F.col("label") % 2).cast("string").alias("condition"))


LISTED = "listed as (select distinct 'L' || label as recording, (label % 2)::varchar as condition from (select label from embeddings union all select label + 100 from embeddings where label % 5 = 0))"
SUMMARY = f"""{EVENTFUL}, {PAIRS.removeprefix(TR + ', ')}, {LISTED}, t as (select *, row_number() over (partition by recording order by snr desc, roi_id) as k from ev),
s as (select recording, count(*) as n, avg(snr) as q, avg(event_rate) as r, avg(event_amplitude) as a, avg(snr) filter (k <= 6) as top6_snr from t group by recording), sy as (select recording, avg(abs(r)) as synchrony from pairs group by recording),
su as (select l.recording, condition, coalesce(n, 0) as n_rois, coalesce(q, 0) as mean_snr, coalesce(r, 0) as mean_event_rate, coalesce(a, 0) as mean_event_amplitude, top6_snr, synchrony from listed l left join s using (recording) left join sy using (recording))"""
SUMMED = ("mean_snr", "mean_event_rate", "mean_event_amplitude", "top6_snr", "synchrony")


def summary(spark, sf):
    return tables.pipeline_summary(eventful(spark, sf), traces.synchrony(rows(spark, sf), "trace"), recordings=listed(spark, sf))


@query("im33_pipeline_summary", f"with {SUMMARY} select recording, condition, n_rois, {', '.join(f'round({c}, 6) as {c}' for c in SUMMED)} from su")
def im33(spark, sf):
    """Recordings without regions have a row too."""
    return six(summary(spark, sf), *SUMMED)


@query("im33_condition_summary", f"with {SUMMARY} select condition, count(*) as n_files, sum(n_rois)::bigint as total_rois, round(avg(n_rois), 6) as mean_rois, round(coalesce(stddev_samp(n_rois), 0), 6) as sd_rois, round(avg(mean_snr), 6) as mean_snr, round(avg(mean_event_rate), 6) as mean_event_rate from su group by condition")
def im33c(spark, sf):
    return six(tables.condition_summary(summary(spark, sf)), "mean_rois", "sd_rois", "mean_snr", "mean_event_rate")


@query("im33_level_counts", "with r as (select 'L' || label as recording, vec_id, vec_id % 7 as level from embeddings) select recording, " + ", ".join(f"count(*) filter (level = {k}) as n_{n}" for k, n in tables.LEVELS.items()) + " from r group by recording")
def im33l(spark, sf):
    return tables.level_counts(rows(spark, sf).withColumn("level", F.col("roi_id") % 7))


# ---- quality of samples ------------------------------------------------------------------------------------------

SAMPLES = f"""{EVENTFUL}, {PAIRS.removeprefix(TR + ', ')}, {LISTED}, sy as (select recording, avg(abs(r)) as c_synchrony from pairs group by recording), ex as (select recording, max(v) as hi, min(v) as lo from pt group by recording),
nu as (select recording, count(*) as n, avg(snr) as mean_snr, avg(event_rate) as mean_event_rate from ev group by recording),
sa as (select l.recording, l.condition, coalesce(n, 0) as n_rois, n is not null and l.condition = '1' as known, hi as max_dff, lo as min_dff, case when n is null then null when l.condition = '1' then 3 * c_synchrony else c_synchrony end as synchrony,
  case when n is not null and l.condition = '1' then c_synchrony / 2 end as synchrony_after, case when n is null then 'NONE' when l.condition = '1' then 'UNKNOWN' when c_synchrony > 0.5 then 'SEVERE' when c_synchrony > 0.3 then 'HIGH' when c_synchrony > 0.15 then 'MILD' else 'LOW' end as neuropil_severity,
  n is not null and l.condition = '1' as regression_applied, mean_snr, mean_event_rate, case when n is null then 'unknown' when l.condition = '1' then 'v4.5' else 'v4.4' end as pipeline_version,
  coalesce((l.condition = '1' and l.recording = 'L3') or hi > 2.4 or lo < -2.5, false) as artifact from listed l left join nu using (recording) left join ex using (recording) left join sy using (recording)),
st as (select *, case when n_rois = 0 then 'NO_ROIS' when artifact then 'ARTIFACT' when n_rois < 5 then 'TOO_FEW_ROIS' when synchrony > 0.5 then 'SEVERE_NEUROPIL' when synchrony > 0.3 then 'HIGH_NEUROPIL' when synchrony > 0.15 then 'MILD_NEUROPIL' else 'OK' end as status from sa),
el as (select *, status in ('OK', 'MILD_NEUROPIL', 'HIGH_NEUROPIL') as eligible from st)"""
SAMPLED = ("max_dff", "min_dff", "synchrony", "synchrony_after", "mean_snr", "mean_event_rate")


def samples(spark, sf):
    """Odd recordings carry stored metrics (three times the synchrony, and no severity), the others are measured, some have no region."""
    t = eventful(spark, sf)
    s = traces.synchrony(t, "trace")
    extremes = t.groupBy("recording").agg(F.max(F.array_max("trace")).alias("max_dff"), F.min(F.array_min("trace")).alias("min_dff"))
    stored = s.join(extremes, "recording").filter(F.substring("recording", 2, 9).cast("int") % 2 == 1).select(
        "recording", "max_dff", "min_dff", (3 * F.col("synchrony")).alias("synchrony_before"), (F.col("synchrony") / 2).alias("synchrony_after"), F.lit(True).alias("global_regression_applied"), (F.col("recording") == "L3").alias("artifact_flag")
    )
    return tables.sample_metrics(listed(spark, sf), t, stored, "trace", 2.4, -2.5)


@query("qa01_sample_metrics", f"with {SAMPLES} select recording, condition, n_rois, {', '.join(f'round({c}, 6) as {c}' for c in SAMPLED)}, neuropil_severity, regression_applied, pipeline_version, artifact from sa")
def qa01(spark, sf):
    return six(samples(spark, sf), *SAMPLED)


@query("qa02_sample_status", f"""with {SAMPLES} select recording, status, eligible, status in ('MILD_NEUROPIL', 'HIGH_NEUROPIL', 'SEVERE_NEUROPIL') as needs_regression,
case status when 'NO_ROIS' then 'No ROIs detected' when 'ARTIFACT' then printf('Extreme dF/F (max=%.1f, min=%.1f)', max_dff, min_dff) when 'TOO_FEW_ROIS' then printf('Only %d ROIs (need >= 5)', n_rois) when 'OK' then 'Clean signal'
  else upper(status[1]) || lower(split_part(status, '_', 1)[2:]) || printf(' neuropil (synchrony=%.3f)', synchrony) end as reason from el""")
def qa02(spark, sf):
    return refine.sample_status(samples(spark, sf)).select("recording", "status", "eligible", "needs_regression", "reason")


@query("qa03_eligible_list", f"with {SAMPLES} select condition, string_agg(recording, ',' order by recording) as names from el where eligible group by condition")
def qa03(spark, sf):
    ok = refine.sample_status(samples(spark, sf)).filter("eligible")
    return ok.groupBy("condition").agg(F.array_join(F.array_sort(F.collect_list("recording")), ",").alias("names"))


@query("qa04_quality_summary", f"with {SAMPLES} select condition, count(*) as total_samples, count(*) filter (eligible) as eligible_samples, round(100 * count(*) filter (eligible) / count(*), 6) as pct_eligible, {', '.join(f'count(*) filter (status = {chr(39)}{s}{chr(39)}) as n_{s.lower()}' for s in refine.STATUSES)}, round(100 * count(*) filter (status = 'ARTIFACT') / count(*), 6) as pct_artifact, round(100 * count(*) filter (status = 'OK') / count(*), 6) as pct_clean, round(avg(synchrony) filter (eligible), 6) as mean_synchrony, round(avg(mean_snr) filter (eligible), 6) as mean_snr, round(avg(n_rois) filter (eligible), 6) as mean_rois from el group by condition")
def qa04(spark, sf):
    return six(refine.quality_summary(refine.sample_status(samples(spark, sf))), "pct_eligible", "pct_artifact", "pct_clean", "mean_synchrony", "mean_snr", "mean_rois")


@query("qa05_corr_histogram", f"with {PAIRS} select recording, least(30, floor((r + 1) / 2 * 30)::int + 1) as bin, count(*) as n from pairs group by all")
def qa05(spark, sf):
    return refine.corr_histogram(rows(spark, sf), "trace")


# ---- refinement --------------------------------------------------------------------------------------------------


def criteria(spark, sf):
    """Regions with the measures of their traces and the criteria on them, and centres on a coarse grid."""
    m = measured(spark, sf).withColumns({"center_x": (F.col("roi_id") * 7 % 61).cast("double"), "center_y": (F.col("roi_id") * 11 % 53).cast("double")})
    return refine.trace_criteria(m, "trace", "dff_smooth", max_snr=6.5, max_plateau_s=1.4, jump=1.6)


def regions(spark, sf):
    """The same with pixels: a block whose sides follow from the id, in a field whose border some of them touch."""
    m = criteria(spark, sf)
    box = F.explode(F.sequence(F.lit(0), 2 + F.col("roi_id") % 7)).alias("a")
    cells = m.select("recording", "roi_id", "center_x", "center_y", box).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("b"))
    cells = cells.filter((F.col("roi_id") % 3 == 0) | (F.col("a") + F.col("b") > 0))  # most blocks lack a corner, a whole one fills its box
    masks = cells.select("recording", "roi_id", (F.col("center_y") + F.col("b")).cast("int").alias("y"), (F.col("center_x") + F.col("a")).cast("int").alias("x"))
    field = rows(spark, sf).select("recording").distinct().select("recording", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("y")).select("recording", "y", F.explode(F.sequence(F.lit(1), F.lit(70))).alias("x"))
    edges = movies.reject_edge(masks, field).select("recording", "roi_id", "contact", "c_edge", "why_edge")
    shapes = movies.reject_shape(movies.roi_shape(masks, 0.26)).select("recording", "roi_id", "area_um2", "aspect", "c_shape", "why_shape")
    return m.join(edges, ["recording", "roi_id"], "left").join(shapes, ["recording", "roi_id"], "left")


@query("rf01_reject_snr", f"""with {SNR}, z as (select recording, roi_id, x, list_sort(x) as v from tr), y as (select recording, roi_id, x, list_filter(x, lambda k: k < {hz("v", 75)}) as low from z),
h as (select recording, roi_id, len(list_filter(x, lambda k: k > 8 * greatest(0.001, 1.4826 * list_median(list_transform(low, lambda q: abs(q - list_median(low))))))) / len(x) as high from y)
select recording, roi_id, snr > 6.5 or high > 0.3 as rejected from snr join h using (recording, roi_id)""")
def rf01(spark, sf):
    return criteria(spark, sf).select("recording", "roi_id", F.col("c_snr").isNotNull().alias("rejected"))


@query("rf04_reject_negative", f"""with {TR}, z as (select recording, roi_id, x, list_sort(x) as v from tr), y as (select recording, roi_id, x, list_filter(x, lambda k: k < {hz("v", 50)}) as low from z)
select recording, roi_id, (list_min(x) - list_median(low)) / greatest(0.001, 1.4826 * list_median(list_transform(low, lambda q: abs(q - list_median(low))))) < -3 as rejected from y""")
def rf04(spark, sf):
    return criteria(spark, sf).select("recording", "roi_id", F.col("c_negative").isNotNull().alias("rejected"))


@query("rf05_reject_step", f"""with {TR}, w as (select recording, roi_id, frame, abs(lead(v) over o - v) as jump, lead(v) over o as after, avg(v) over (partition by roi_id order by frame rows between 5 preceding and current row) as before from pt window o as (partition by roi_id order by frame))
select recording, roi_id, count(*) filter (frame < 63 and jump > 1.6 and after > before + 0.8 * jump) >= 2 as rejected from w group by all""")
def rf05(spark, sf):
    return criteria(spark, sf).select("recording", "roi_id", F.col("c_step").isNotNull().alias("rejected"))


@query("rf06_reject_kinetics")
def rf06(spark, sf):
    return criteria(spark, sf).select("recording", "roi_id", "c_kinetics")


@query("rf07_reject_plateau", f"""with {TR}, l as (select recording, roi_id, {hz("list_sort(x)", 10)} as lo, {hz("list_sort(x)", 99)} as hi from tr), e as (select p.recording, p.roi_id, frame, hi - lo >= 0.05 and v > lo + 0.7 * (hi - lo) as up from pt p join l using (roi_id)),
i as (select *, row_number() over (partition by roi_id order by frame) - row_number() over (partition by roi_id, up order by frame) as g from e), r as (select recording, roi_id, up, count(*) as n from i group by recording, roi_id, up, g)
select recording, roi_id, coalesce(max(n) filter (up), 0) > 3 as rejected from r group by all""")
def rf07(spark, sf):
    return criteria(spark, sf).select("recording", "roi_id", F.col("c_plateau").isNotNull().alias("rejected"))


@query("rf08_prune_correlated")
def rf08(spark, sf):
    return six(refine.prune_correlated(traces.snr(rows(spark, sf), "trace"), "trace", 0.35), "value")


@query("rf09_close_pairs", "with r as (select 'L' || label as recording, vec_id as roi_id, vec_id * 7 % 61 as x, vec_id * 11 % 53 as y from embeddings) select a.recording, a.roi_id as roi_i, b.roi_id as roi_j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) as distance from r a join r b on a.recording = b.recording and a.roi_id < b.roi_id where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 5")
def rf09(spark, sf):
    c = rows(spark, sf).withColumns({"center_x": (F.col("roi_id") * 7 % 61).cast("double"), "center_y": (F.col("roi_id") * 11 % 53).cast("double")})
    return six(refine.close_pairs(c), "distance")


@query("rf09_prune_close")
def rf09p(spark, sf):
    c = criteria(spark, sf)
    return six(refine.greedy_prune(c, refine.close_pairs(c), "distance"), "value")


@query("rf10_reject_drift", f"""with {TR}, w as (select recording, roi_id, list_sort(x[1:10]) as s, x[len(x) - 9:] as en, list_sort(x[len(x) - 9:]) as e from tr),
b as (select *, list_median(list_filter(s, lambda k: k <= {hz("s", 90)})) as sb, list_median(list_filter(e, lambda k: k <= {hz("e", 90)})) as eb from w)
select recording, roi_id, abs(eb - sb) > 0.5 and len(list_filter(en, lambda k: k > sb + 0.25)) / 10 > 0.5 as rejected from b""")
def rf10(spark, sf):
    return criteria(spark, sf).select("recording", "roi_id", F.col("c_drift").isNotNull().alias("rejected"))


def refined(spark, sf):
    return refine.refine(regions(spark, sf), "trace", 0.35, 3.0)


@query("rf11_refine")
def rf11(spark, sf):
    return refined(spark, sf).select("recording", "roi_id", "category", "reason")


#: Every category, and as many regions again that are kept.
CATEGORIES = [c for names in refine.COUNTS.values() for c in names]


def sorted_out(spark, sf):
    """Regions with a category that follows from the id, as ``refine`` (rf11) gives them."""
    place = (F.col("roi_id") * 7 % (2 * len(CATEGORIES))).cast("int")
    category = F.get(F.array(*map(F.lit, CATEGORIES)), place)
    return eventful(spark, sf).withColumn("category", category).withColumn("reason", F.concat(F.lit("why "), "category"))


SORTED = f"""{EVENTFUL}, {PAIRS.removeprefix(TR + ', ')}, so as (select e.recording, (e.recording[2:]::int % 2)::varchar as condition, roi_id, snr, event_rate, {CATEGORIES}[(roi_id * 7 % {2 * len(CATEGORIES)})::int + 1] as category from ev e),
kp as (select * from so where category is null), ks as (select p.recording, avg(abs(r)) as synchrony_score from pairs p join kp a on a.roi_id = p.roi_i join kp b on b.roi_id = p.roi_j group by p.recording)"""
IN = lambda names: "category in (" + ", ".join(f"'{c}'" for k in names for c in refine.COUNTS[k]) + ")"
REMOVALS = ", ".join(f"count(*) filter ({IN([k])}) as removed_{k}" for k in refine.COUNTS)


@query("rf12_refined_rois", f"with {SORTED} select recording, row_number() over (partition by recording order by roi_id)::int as roi_id, roi_id as roi_original, round(snr, 6) as snr from kp")
def rf12(spark, sf):
    return six(refine.refined_rois(sorted_out(spark, sf)).select("recording", "roi_id", "roi_original", "snr"), "snr")


@query("rf12_refined_synchrony", f"with {SORTED} select recording, round(synchrony_score, 6) as synchrony_score from (select distinct recording from kp) left join ks using (recording)")
def rf12s(spark, sf):
    return six(refine.refined_synchrony(sorted_out(spark, sf), "trace"), "synchrony_score")


@query("rf13_removal_counts", f"with {SORTED} select recording, {', '.join(f'count(*) filter ({IN([k])}) as {k}' for k in refine.COUNTS)} from so group by recording")
def rf13(spark, sf):
    return refine.removal_counts(sorted_out(spark, sf))


@query("rf13_category_counts", f"with {SORTED} select recording, {', '.join(f'count(*) filter ({IN(names)}) as {k}' for k, names in refine.MERGED.items())} from so group by recording")
def rf13c(spark, sf):
    return refine.category_counts(sorted_out(spark, sf))


@query("rf13_rejection_examples", f"with {SORTED}, p as (select *, row_number() over (partition by recording, category order by roi_id) as p, dense_rank() over (partition by recording order by category) as r from so where category is not null) select recording, category, roi_id, 'why ' || category as reason from p where p <= 2 and r <= 6")
def rf13e(spark, sf):
    return refine.rejection_examples(sorted_out(spark, sf))


@query("rf13_refinement_log", f"with {SORTED} select recording, roi_id as \"ROI_Original\", category is null as \"Kept\", coalesce(category, '') as \"Category\", coalesce('why ' || category, '') as \"Removal_Reason\", round(snr, 6) as \"SNR\" from so")
def rf13l(spark, sf):
    return six(refine.refinement_log(sorted_out(spark, sf)), "SNR")


REFINED_SQL = f"""{SORTED}, rs as (select recording as filename, condition, 'unknown' as motion_quality, count(*) as n_original, count(*) filter (category is null) as n_refined, count(category) as n_removed, 100 * count(category) / count(*) as pct_removed, {REMOVALS},
  avg(snr) filter (category is null) as mean_snr, avg(event_rate) filter (category is null) as mean_event_rate, any_value(synchrony_score) as synchrony_score from so left join ks using (recording) group by recording, condition)"""
REFINED_NUMBERS = ("pct_removed", "mean_snr", "mean_event_rate", "synchrony_score")


@query("rf14_refinement_summary", f"with {REFINED_SQL} select filename, condition, motion_quality, n_original, n_refined, n_removed, {', '.join(f'removed_{k}' for k in refine.COUNTS)}, {', '.join(f'round({c}, 6) as {c}' for c in REFINED_NUMBERS)} from rs")
def rf14(spark, sf):
    return six(refine.refinement_summary(sorted_out(spark, sf), "trace"), *REFINED_NUMBERS)


BY_CONDITION = ("mean_rois_per_file", "std_rois_per_file", "mean_pct_removed", "mean_snr", "std_snr", "mean_event_rate", "std_event_rate", "mean_synchrony")


@query("rf15_refinement_by_condition", f"""with {REFINED_SQL}, c as (select condition, count(*) as n_files, sum(n_original)::bigint as total_rois_original, sum(n_refined)::bigint as total_rois_refined, avg(n_refined) as mean_rois_per_file, stddev_samp(n_refined) as std_rois_per_file, avg(pct_removed) as mean_pct_removed,
  sum(removed_edge)::bigint as total_edge_removed, sum(removed_shape)::bigint as total_shape_removed, sum(removed_kinetics + removed_negative + removed_step + removed_plateau)::bigint as total_kinetics_removed, avg(mean_snr) as mean_snr, stddev_samp(mean_snr) as std_snr,
  avg(mean_event_rate) as mean_event_rate, stddev_samp(mean_event_rate) as std_event_rate, avg(synchrony_score) as mean_synchrony from rs group by condition)
select condition, n_files, total_rois_original, total_rois_refined, total_edge_removed, total_shape_removed, total_kinetics_removed, {', '.join(f'round({c}, 6) as {c}' for c in BY_CONDITION)} from c""")
def rf15(spark, sf):
    return six(refine.refinement_by_condition(refine.refinement_summary(sorted_out(spark, sf), "trace")), *BY_CONDITION)


@query("rf16_zscore_traces", f"with {TR} select recording, roi_id, frame::int as frame, round((v - avg(v) over w) / coalesce(nullif(stddev_samp(v) over w, 0), 1), 6) as z from pt window w as (partition by roi_id)")
def rf16(spark, sf):
    got = traces.zscore(rows(spark, sf), "trace").select("recording", "roi_id", F.posexplode("z").alias("frame", "z"))
    return six(got.withColumn("frame", F.col("frame") + 1), "z")


@query("rf17_segment_traces", f"with {TR}, l as (select roi_id, {hz('list_sort(x)', 0.5)} as low, {hz('list_sort(x)', 99.5)} as high from tr) select recording, roi_id, ((frame - 1) // 20)::int as segment, count(*) as n, round(sum(v), 6) as total, round(any_value(low), 6) as low, round(any_value(high), 6) as high from pt join l using (roi_id) group by all")
def rf17(spark, sf):
    s = traces.segments(rows(spark, sf), "trace", 10)
    return six(s.select("recording", "roi_id", "segment", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("total"), "low", "high"), "total", "low", "high")
