"""Registered queries of the motion series and their gates (driver table ``events``), each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionspark.operators import gates, series, tables
from motionspark.runtime import checkpointed
from motionspark.sources.adapters import frames as raw_frames
from motionspark.sources.adapters import table

LIMIT, SPIKE, WIN = 1.2, 0.8, 61
CFG = gates.QcConfig(
    max_nan=0.06, max_pegged=0.34, good_step_um=1.6, max_spikes=0.5, field_um=16.0, limit_x_um=LIMIT, limit_y_um=LIMIT, spike_um=SPIKE, spike_frames=3, settle_base_min=0.5, settle_least_min=0.1, median_frames=WIN, peg_run_frames=3,
)
#: Reposition rules small enough for recordings of about a minute.
MOVES = dict(threshold=SPIKE, sustain_s=3.0, shift=0.3, around_s=5.0, more_than=3, widen_s=1.0)


def six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def frames(spark, sf):
    return series.step_size(series.to_um(raw_frames(spark, sf)))


def settled(spark, sf):
    return series.reposition_mask(series.settle(frames(spark, sf), base=0.5, least=0.1), **MOVES)


def metrics(spark, sf):
    return gates.recording_metrics(settled(spark, sf), CFG)


def judged(spark, sf):
    return gates.dual_qc(metrics(spark, sf), CFG)


def hz(values: str, p: float) -> str:
    """Percentile at midpoint positions of an ascending DuckDB list."""
    n = f"len({values})"
    h = f"greatest(1.0, least({n}::double, {n} * {p / 100} + 0.5))"
    lo = f"floor({h})::bigint"
    return f"({values}[{lo}] + ({h} - {lo}) * ({values}[least({n}, {lo} + 1)] - {values}[{lo}]))"


LOST = "coalesce(event_type = 'error' and event_id % 7 = 0, false)"
FRAMES = rf"""
frames as (
  select 'S' || user_id as recording, case when user_id % 2 = 0 then 'control' else 'experimental' end as "group",
    row_number() over (partition by user_id order by ts, event_id) as frame,
    case when not {LOST} then (value - 50) / 10 * 0.26 end as dx_um,
    case when not {LOST} then (try_cast(regexp_extract(props, '(\d+)', 1) as double) - 50) / 10 * 0.26 end as dy_um
  from events),
steps as (
  select *, case when frame = 1 then 0.0 else sqrt((dx_um - lag(dx_um) over w) ** 2 + (dy_um - lag(dy_um) over w) ** 2) end as step_um,
    count(*) over (partition by recording) as n
  from frames window w as (partition by recording order by frame)),
pegs as (select *, coalesce(abs(dx_um) > 0.98 * {LIMIT} or abs(dy_um) > 0.98 * {LIMIT}, false) as is_pegged from steps)"""


def island(source: str, flag: str, name: str, order: str = "frame") -> str:
    return f"""{name} as (select *, row_number() over (partition by recording order by {order}) - row_number() over (partition by recording, {flag} order by {order}) as island from {source})"""


SETTLED = f"""{FRAMES},
timed as (select *, least(0.5, greatest(0.1, 0.2 * ((n - 1) / 60.0))) as settle_min from pegs),
posted as (select *, frame > least(n::double, round(settle_min * 60)) as post, coalesce(step_um > {SPIKE}, false) as hi from timed),
{island("posted", "hi", "hi_islands")},
hi_runs as (select recording, min(frame) as s, max(frame) as e, count(*) as len, max(n) as n from hi_islands where hi group by recording, island),
events_a as (select *, greatest(1, s - 5) as pre_a, greatest(1, s - 1) as pre_b, least(e + 1, n) as post_a, least(e + 5, n) as post_b from hi_runs where len >= 3),
events_b as (select * from events_a where pre_b - pre_a + 1 > 3 and post_b - post_a + 1 > 3),
moved as (
  select v.recording, v.s, v.e, max(v.n) as n
  from events_b v join posted f on f.recording = v.recording and (f.frame between v.pre_a and v.pre_b or f.frame between v.post_a and v.post_b)
  group by v.recording, v.s, v.e
  having sqrt((median(f.dx_um) filter (f.frame between post_a and post_b) - median(f.dx_um) filter (f.frame between pre_a and pre_b)) ** 2
    + (median(f.dy_um) filter (f.frame between post_a and post_b) - median(f.dy_um) filter (f.frame between pre_a and pre_b)) ** 2) > 0.3),
settled as (
  select p.*, exists (select 1 from moved m where m.recording = p.recording and p.frame between greatest(1, m.s - 1) and least(m.n, m.e + 1)) as reposition from posted p),
clean as (select * exclude (frame, hi), frame as frame_was, row_number() over (partition by recording order by frame) as frame, coalesce(step_um > {SPIKE}, false) as hi from settled where post and not reposition),
{island("clean", "hi", "clean_islands")},
spikes as (select *, hi and count(*) over (partition by recording, hi, island) >= 3 as above from clean_islands),
post_a as (
  select recording, count(*) as n_post, list_sort(list(step_um) filter (step_um is not null)) as v, avg(step_um) as mean_step_ps, sum(step_um) as cum_path_ps, avg(is_pegged::int) as pegged_ps,
    coalesce(count(*) filter (dx_um is null or dy_um is null) = 0 and stddev_samp(dx_um) < 0.065 and stddev_samp(dy_um) < 0.065, false) as flatline_ps, avg(above::int) as spike_frac_ps, min(frame_was) as lo, max(frame_was) as hi
  from spikes group by recording having count(*) >= 2),
post_b as (
  select a.recording, sqrt((median(f.dx_um) filter (f.frame between a.hi - 30 and a.hi + 30) - median(f.dx_um) filter (f.frame between a.lo - 30 and a.lo + 30)) ** 2
    + (median(f.dy_um) filter (f.frame between a.hi - 30 and a.hi + 30) - median(f.dy_um) filter (f.frame between a.lo - 30 and a.lo + 30)) ** 2) as net_drift_ps
  from post_a a join steps f using (recording) group by a.recording),
post as (
  select a.recording, n_post, {hz("v", 50)} as med_step_ps, mean_step_ps, {hz("v", 95)} as p95_step_ps, {hz("v", 99)} as p99_step_ps, cum_path_ps, net_drift_ps,
    net_drift_ps / greatest(1e-9, (n_post - 1)::double) as drift_rate_ps, pegged_ps, flatline_ps, spike_frac_ps, least(1000, cum_path_ps / greatest(1e-9, net_drift_ps)) as jitter_ratio
  from post_a a join post_b b using (recording))"""

JUDGED = f"""{SETTLED},
whole as (
  select recording, "group", count(*) as n_frames, avg((dx_um is null or dy_um is null)::int) as nan_frac, avg(is_pegged::int) as pegged,
    coalesce(count(*) filter (dx_um is null or dy_um is null) = 0 and coalesce(stddev_samp(dx_um), 0) < 0.065 and coalesce(stddev_samp(dy_um), 0) < 0.065, false) as flatline,
    greatest(max(dx_um) - min(dx_um), max(dy_um) - min(dy_um)) as excursion_um, median(step_um) as median_step, sum(step_um) as cum_path, count(*) filter (not post) + 1 as post_start_frame
  from settled group by recording, "group"),
tests as (
  select *, nan_frac >= 0.06 as t_nan, pegged >= 0.34 as t_peg, coalesce(excursion_um / 16.0 > 0.4, false) as t_exit, excursion_um / 16.0 as excursion_frac from whole left join post using (recording)),
judged as (
  select *, not (t_nan or t_peg or flatline) as movement_valid, not (t_nan or t_peg or flatline or t_exit) as roi_eligible,
    case when t_nan or t_peg or flatline then concat_ws(',', case when t_nan then 'nan_frac_high' end, case when t_peg then 'tracking_ceiling' end, case when flatline then 'flatline_suspicious' end) else 'TRACKING_OK' end as movement_reason,
    case when t_nan or t_peg or flatline or t_exit then concat_ws(',', case when t_nan then 'nan_frac_high' end, case when t_peg then 'tracking_ceiling' end, case when flatline then 'flatline_suspicious' end, case when t_exit then 'boundary_exit' end) else 'ELIGIBLE' end as roi_reason,
    case when flatline then 'FLATLINE' when t_nan then 'NAN_EXCESS' when t_peg then 'TRACKING_CEILING' else 'OK' end as movement_health,
    case when not (t_nan or t_peg or flatline) and t_exit then 'BOUNDARY_EXIT' when flatline then 'FLATLINE' when t_nan then 'NAN_EXCESS' when t_peg then 'TRACKING_CEILING' else 'OK' end as roi_health,
    case when med_step_ps >= 1.6 then 'HIGH_MOTION' when spike_frac_ps >= 0.5 then 'SPIKY' else 'GOOD' end as motion_quality
  from tests)"""

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("mo01_to_um", f"with {FRAMES} select recording, frame::int as frame, round(dx_um, 6) as dx_um, round(dy_um, 6) as dy_um, round((frame - 1)::double, 6) as time_s, round((frame - 1) / 60, 6) as time_min from frames")
def mo01(spark, sf):
    return six(series.to_um(raw_frames(spark, sf)), "dx_um", "dy_um", "time_s", "time_min").select("recording", "frame", "dx_um", "dy_um", "time_s", "time_min")


@query("mo02_step_size", f"with {FRAMES} select recording, frame::int as frame, round(step_um, 6) as step_um from steps")
def mo02(spark, sf):
    return six(frames(spark, sf), "step_um").select("recording", "frame", "step_um")


MODES = ("auto", "auto_conservative", "auto_loose", "auto_extreme", "fixed_um", "fixed_px")


@query("mo03_max_shift", """
with sizes as (select p_partkey as item, p_size + 3 as height, 2 * p_size + 1 as width from part),
modes as (select unnest(['auto', 'auto_conservative', 'auto_loose', 'auto_extreme', 'fixed_um', 'fixed_px']) as mode, unnest([0.4, 0.1, 0.45, 0.5, null, null]) as frac),
got as (select item, mode, least(height, width) as small, greatest(1, least(floor(least(height, width) / 2) - 1, round(case mode when 'fixed_um' then 5 / 0.26 when 'fixed_px' then 7 else frac * least(height, width) end))) as px from sizes, modes)
select item, mode, px::double as max_shift_px, round(px * 0.26, 6) as max_shift_um, greatest(px, greatest(1, least(floor(small / 2) - 1, round(small * 0.5))))::double as rescue_cap_px from got""")
def mo03(spark, sf):
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") + 3).alias("height"), (2 * F.col("p_size") + 1).alias("width"), F.lit(0.26).alias("px_um"))
    out = None
    for mode in MODES:
        one = series.rescue_cap(series.max_shift(sizes, mode, {"fixed_um": 5, "fixed_px": 7}.get(mode))).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return six(out, "max_shift_um").select("item", "mode", "max_shift_px", "max_shift_um", "rescue_cap_px")


@query("mo04_pegged", f"with {FRAMES} select recording, round(avg(is_pegged::int), 6) as pegged from pegs group by recording")
def mo04(spark, sf):
    return series.pegged(frames(spark, sf), LIMIT, LIMIT).groupBy("recording").agg(F.round(F.avg(F.col("is_pegged").cast("double")), 6).alias("pegged"))


RUNS = f"with {FRAMES}, {island('pegs', 'is_pegged', 'isl')}, runs as (select recording, min(frame) as start, max(frame) as \"end\", count(*) as length from isl where is_pegged group by recording, island)"


@query("mo05_runs", f'{RUNS} select recording, start::int as start, "end"::int as "end", length, length::double as duration_s from runs')
def mo05(spark, sf):
    return series.runs(series.pegged(frames(spark, sf), LIMIT, LIMIT), "is_pegged")


@query("mo06_longest_run", f"{RUNS} select f.recording, coalesce(max(length), 0) as longest from (select distinct recording from frames) f left join runs using (recording) group by f.recording")
def mo06(spark, sf):
    return series.longest_run(series.pegged(frames(spark, sf), LIMIT, LIMIT), "is_pegged")


@query("mo07_frac_above", f"with {FRAMES}, hot as (select *, coalesce(step_um > {SPIKE}, false) as hi from steps), {island('hot', 'hi', 'isl')}, marked as (select recording, hi and count(*) over (partition by recording, hi, island) >= 3 as above from isl) select recording, round(avg(above::int), 6) as frac_above from marked group by recording")
def mo07(spark, sf):
    return six(series.frac_above(frames(spark, sf), "step_um", SPIKE, 3), "frac_above")


@query("mo08_nan_frac", f"with {FRAMES} select recording, round(avg((dx_um is null or dy_um is null)::int), 6) as nan_frac from frames group by recording")
def mo08(spark, sf):
    return frames(spark, sf).groupBy("recording").agg(F.round(series.nan_frac(), 6).alias("nan_frac"))


@query("mo09_flatline", f"with {FRAMES} select recording, frame // 4 as part, coalesce(count(*) filter (dx_um is null or dy_um is null) = 0 and coalesce(stddev_samp(dx_um), 0) < 0.065 and coalesce(stddev_samp(dy_um), 0) < 0.065, false) as flatline from frames group by all")
def mo09(spark, sf):
    return frames(spark, sf).groupBy("recording", F.floor(F.col("frame") / 4).alias("part")).agg(series.flatline().alias("flatline"))


@query("mo10_excursion", f"with {FRAMES}, e as (select recording, greatest(max(dx_um) - min(dx_um), max(dy_um) - min(dy_um)) as u from frames group by recording) select recording, round(u, 6) as excursion_um, round(u / 16.0, 6) as excursion_frac, u / 16.0 > 0.25 as boundary_warning, u / 16.0 > 0.4 as boundary_exit from e")
def mo10(spark, sf):
    return six(series.excursion(frames(spark, sf), 16.0), "excursion_um", "excursion_frac")


@query("mo11_step_stats", f"""with {FRAMES}, v as (select recording, list_sort(list(step_um) filter (step_um is not null)) as v, avg(step_um) as m, coalesce(stddev_samp(step_um), 0) as sd, sum(step_um) as c, avg(coalesce(step_um <= 0.1, false)::int) as b1, avg(coalesce(step_um <= 0.2, false)::int) as b2 from steps group by recording)
select recording, round({hz("v", 50)}, 6) as median_step, round(m, 6) as mean_step, round(sd, 6) as sd_step, round({hz("v", 95)}, 6) as p95_step, round({hz("v", 99)}, 6) as p99_step, round(c, 6) as cum_path, round(b1, 6) as below_010, round(b2, 6) as below_020 from v""")
def mo11(spark, sf):
    return six(series.step_stats(frames(spark, sf)), "median_step", "mean_step", "sd_step", "p95_step", "p99_step", "cum_path", "below_010", "below_020")


@query("mo12_rolling_median", f"with {FRAMES} select recording, frame::int as frame, round(median(dx_um) over w, 6) as dx_um_s, round(median(dy_um) over w, 6) as dy_um_s from frames window w as (partition by recording order by frame rows between 30 preceding and 30 following)")
def mo12(spark, sf):
    return six(series.rolling_median(frames(spark, sf).select("recording", "frame", "dx_um", "dy_um"), ["dx_um", "dy_um"], WIN), "dx_um_s", "dy_um_s").select("recording", "frame", "dx_um_s", "dy_um_s")


@query("mo13_net_drift", f"""with {FRAMES}, e as (select recording, max(n) as n, median(dx_um) filter (frame >= n - 30) - median(dx_um) filter (frame <= 31) as x, median(dy_um) filter (frame >= n - 30) - median(dy_um) filter (frame <= 31) as y from steps group by recording)
select recording, (n - 1)::double as duration_s, round(sqrt(x * x + y * y), 6) as net_drift, round(sqrt(x * x + y * y) / greatest(1e-9, n - 1), 6) as drift_rate, round(degrees(atan2(y, x)), 6) as drift_angle from e""")
def mo13(spark, sf):
    return six(series.net_drift(frames(spark, sf), WIN), "net_drift", "drift_rate", "drift_angle")


@query("mo14_settle", f"with {SETTLED} select recording, round(max(settle_min), 6) as settle_min, count(*) filter (post) as n_post from settled group by recording")
def mo14(spark, sf):
    return series.settle(frames(spark, sf), base=0.5, least=0.1).groupBy("recording").agg(F.round(F.max("settle_min"), 6).alias("settle_min"), F.count_if("post").alias("n_post"))


PS = ("med_step_ps", "mean_step_ps", "p95_step_ps", "p99_step_ps", "cum_path_ps", "net_drift_ps", "drift_rate_ps", "pegged_ps", "spike_frac_ps", "jitter_ratio")


@query("mo15_post_settle_stats", f"with {SETTLED} select recording, n_post, {', '.join(f'round({c}, 6) as {c}' for c in PS)}, flatline_ps from post")
def mo15(spark, sf):
    return six(series.post_settle_stats(settled(spark, sf), LIMIT, LIMIT, SPIKE, 3, WIN), *PS)


@query("mo16_reposition_mask", f"with {SETTLED} select recording, frame::int as frame, reposition from settled")
def mo16(spark, sf):
    return settled(spark, sf).select("recording", "frame", "reposition")


@query("mo17_settle_ratio", f"""with {SETTLED}, r as (select recording, median(step_um) filter (not post) as pre, median(step_um) filter (post and not reposition) as after, count(*) filter (post and not reposition) as k, (count(*) - 1) / 60.0 as minutes, max(settle_min) as settle_min from settled group by recording)
select recording, round(case when minutes >= 2 * settle_min and k >= 2 and pre >= 0.02 then after / pre end, 6) as settle_ratio from r""")
def mo17(spark, sf):
    return six(series.settle_ratio(settled(spark, sf)), "settle_ratio")


@query("mo18_auto_settle", f"""with {FRAMES}, m as (select recording, frame, coalesce(median(step_um) over (partition by recording order by frame rows between 5 preceding and 4 following) < 1.0, false) as calm from steps), {island('m', 'calm', 'isl')},
r as (select recording, min(frame) as s from isl where calm group by recording, island having count(*) >= 8) select f.recording, round((min(s) - 1) / 60, 6) as auto_settle_min from (select distinct recording from frames) f left join r using (recording) group by f.recording""")
def mo18(spark, sf):
    return six(series.auto_settle(frames(spark, sf), 1.0, 10, 8), "auto_settle_min")


@query("mo19_jitter_ratio", f"with {SETTLED} select recording, round(least(1.5, cum_path_ps / greatest(1e-9, net_drift_ps)), 6) as jitter_capped, round(jitter_ratio, 6) as jitter_ratio from post")
def mo19(spark, sf):
    post = series.post_settle_stats(settled(spark, sf), LIMIT, LIMIT, SPIKE, 3, WIN)
    return six(post.select("recording", series.jitter_ratio("cum_path_ps", "net_drift_ps", 1.5).alias("jitter_capped"), "jitter_ratio"), "jitter_capped", "jitter_ratio")


@query("mo20_bursts", f"""with {FRAMES}, t as (select unnest([0.2, 0.5, 1.0]) as threshold), b as (select recording, frame, threshold, coalesce(step_um > threshold, false) as o from steps, t), e as (select *, o and not lag(o) over (partition by recording, threshold order by frame) as rise from b)
select recording, threshold::double as threshold, count(*) filter (rise) as n_bursts, round(count(*) filter (rise) / greatest(1e-9, count(*) / 60), 6) as rate_per_min from e group by recording, threshold""")
def mo20(spark, sf):
    return six(series.bursts(frames(spark, sf), [0.2, 0.5, 1.0]), "rate_per_min")


def spectra(spark, sf):
    return series.psd(frames(spark, sf), 128, 16)


TAPER = "(0.54 - 0.46 * cos(2 * pi() * i / (win - 1)))"
SPECTRA = f"""{FRAMES}, series as (select recording, n, greatest(16, n // 4) as win, list(coalesce(step_um - m, 0) order by frame) as x from (select *, avg(step_um) over (partition by recording) as m from steps) group by all),
weight as (select recording, sum({TAPER} ** 2) as weight from (select recording, win, unnest(range(win)) as i from series) group by recording),
pieces as (select recording, win, x, unnest(range((n - win) // (win - win // 2) + 1)) as piece from series),
samples as (select recording, piece, i, x[piece * (win - win // 2) + i + 1] * {TAPER} as v from (select *, unnest(range(win)) as i from pieces)),
lines as (select recording, piece, k, sum(v * cos(2 * pi() * ((k * i) % 256) / 256)) as re, sum(v * sin(2 * pi() * ((k * i) % 256) / 256)) as im from samples, (select unnest(range(129)) as k) group by all),
spectra as (select recording, k::int as k, k::double / 256 as f, avg(re * re + im * im) / any_value(weight) * case when k between 1 and 127 then 2 else 1 end as p from lines join weight using (recording) group by recording, k)"""


@query("mo21_psd", f"with {SPECTRA} select recording, k, round(f, 6) as f, round(p, 6) as p from spectra")
def mo21(spark, sf):
    """Recordings of about a minute: pieces of 16 frames or a quarter of the recording, padded to 256."""
    return six(spectra(spark, sf), "f", "p")


@query("mo22_dominant_peak", f"with {SPECTRA}, r as (select *, row_number() over (partition by recording order by p desc, f) as place from spectra where f between 0.01 and 0.5) select recording, round(f, 6) as dom_f, round(p, 6) as dom_p, round(1 / f / 60, 6) as dom_period_min from r where place = 1")
def mo22(spark, sf):
    return six(series.dominant_peak(spectra(spark, sf)), "dom_f", "dom_p", "dom_period_min")


MO23 = {"low": (0.01, 0.05), "mid": (0.05, 0.2), "high": (0.2, 0.5)}


@query("mo23_band_power", f"""with {SPECTRA}, strips as (select recording, f, lead(f) over w as f2, (lead(f) over w - f) * (p + lead(p) over w) / 2 as area from spectra window w as (partition by recording order by f))
select recording, {', '.join(f'round(coalesce(sum(area) filter (f >= {lo} and f2 <= {hi}), 0) / sum(area), 6) as frac_{k}' for k, (lo, hi) in MO23.items())} from strips group by recording""")
def mo23(spark, sf):
    return six(series.band_power(spectra(spark, sf), MO23), *(f"frac_{k}" for k in MO23))


@query("mo24_mean_psd", f"with {SPECTRA} select round(f, 6) as f, round(avg(p), 6) as mean_p, count(*) as n_recordings from spectra group by f")
def mo24(spark, sf):
    """All recordings have one grid here; other grids are tested on a fixture."""
    every = frames(spark, sf)
    first = series.psd(every.filter(F.col("recording") == raw_frames(spark, sf).agg(F.min("recording")).first()[0]), 128, 16)
    return six(series.mean_psd(series.resampled_lines(series.spectra(every, 128, 16), first)), "f", "mean_p")


MINUTES = f'{FRAMES}, minutes as (select recording, "group", ((frame - 1) // 60 + 1)::int as minute, median(step_um) as median_step from steps group by all)'


@query("mo25_per_minute_median", f"with {MINUTES} select recording, \"group\", minute, round(median_step, 6) as median_step from minutes")
def mo25(spark, sf):
    return six(series.per_minute_median(frames(spark, sf)), "median_step")


SETTLED_MINUTES = f"""{SETTLED}, lengths as (select recording, "group", (max(n) - 1) / 60.0 as minutes, max(settle_min) as settle_min from posted group by all),
long_enough as (select "group" from lengths group by "group" having median(minutes) >= 2 * median(settle_min)), enough as (select recording from clean group by recording having count(*) >= 2),
minutes as (select recording, "group", ((frame - 1) // 60 + 1)::int as minute, median(step_um) as median_step from clean where "group" in (select "group" from long_enough) and recording in (select recording from enough) group by all)"""
TIMECOURSE = """select "group", minute, count(median_step) as n_active, round(avg(median_step), 6) as mean_um, round(coalesce(stddev_samp(median_step), case when count(median_step) = 1 then 0 end) / sqrt(count(median_step)), 6) as sem_um from minutes group by all"""


@query("mo26_settled_timecourse", f"with {SETTLED_MINUTES} {TIMECOURSE}")
def mo26s(spark, sf):
    return six(series.group_timecourse(series.settled_minutes(settled(spark, sf))), "mean_um", "sem_um")


@query("mo26_group_timecourse", f"with {MINUTES} select \"group\", minute, count(median_step) as n_active, round(avg(median_step), 6) as mean_um, round(coalesce(stddev_samp(median_step), case when count(median_step) = 1 then 0 end) / sqrt(count(median_step)), 6) as sem_um from minutes group by all")
def mo26(spark, sf):
    return six(series.group_timecourse(series.per_minute_median(frames(spark, sf))), "mean_um", "sem_um")


@query("mo27_dual_qc", f'with {JUDGED} select recording, "group", movement_valid, movement_reason, roi_eligible, roi_reason, movement_health, roi_health, motion_quality, round(excursion_frac, 6) as excursion_frac from judged')
def mo27(spark, sf):
    return six(judged(spark, sf), "excursion_frac").select("recording", "group", "movement_valid", "movement_reason", "roi_eligible", "roi_reason", "movement_health", "roi_health", "motion_quality", "excursion_frac")


@query("mo28_movement_qc", f"""with {JUDGED}, {island('pegs', 'is_pegged', 'isl')}, longest as (select recording, coalesce(max(k) filter (is_pegged), 0) as longest from (select recording, is_pegged, count(*) as k from isl group by recording, is_pegged, island) group by recording),
m as (select *, longest >= 3 as t_run from tests join longest using (recording))
select recording, longest as max_pegged_run, not (t_peg or t_run or t_nan or flatline) as qc_pass, coalesce(nullif(concat_ws(',', case when t_peg then 'pegged_frac' end, case when t_run then 'ceiling_run' end, case when t_nan then 'nan_frac' end, case when flatline then 'flatline' end), ''), 'OK') as qc_reason,
  coalesce(med_step_ps < 1.6 and spike_frac_ps < 0.5, false) as qc_soft_still, case when flatline then 'FLATLINE' when t_nan then 'NAN_EXCESS' when t_run then 'CEILING_RUN' when t_peg then 'PEGGED' else 'OK' end as health from m""")
def mo28(spark, sf):
    longest = series.longest_run(series.pegged(frames(spark, sf), LIMIT, LIMIT), "is_pegged")
    return gates.movement_qc(metrics(spark, sf), CFG, longest).select("recording", "max_pegged_run", "qc_pass", "qc_reason", "qc_soft_still", "health")


MO29 = {
    "MedianDisp_um": "median_step", "CumPath_um": "cum_path", "Pegged_frac": "pegged", "MedianDisp_postSettle_um": "med_step_ps", "Pct95Disp_postSettle_um": "p95_step_ps", "CumPath_postSettle_um": "cum_path_ps",
    "NetDrift_postSettle_um": "net_drift_ps", "SpikeFrac_postSettle_over_0p8um_per_s": "spike_frac_ps", "JitterRatio_post_cumPath_over_netDrift": "jitter_ratio", "nan_frac": "nan_frac", "Excursion_max_um": "excursion_um",
    "Excursion_frac_FOV": "excursion_frac", "MeanStep_postSettle_um": "mean_step_ps", "P99Step_postSettle_um": "p99_step_ps",
}
MO29_PLAIN = {"n_frames": "n_frames", "MOVEMENT_VALID": "movement_valid", "Movement_QC_reason": "movement_reason", "Movement_HealthFlag": "movement_health", "ROI_ELIGIBLE": "roi_eligible", "ROI_QC_reason": "roi_reason", "ROI_HealthFlag": "roi_health", "MotionQuality": "motion_quality"}


@query("mo29_motion_tables", f"""with {JUDGED} select recording || '.avi' as "File", {', '.join(f'round({c}, 6) as "{n}"' for n, c in MO29.items())}, {', '.join(f'{c} as "{n}"' for n, c in MO29_PLAIN.items())} from judged""")
def mo29(spark, sf):
    """What the qc and enriched tables hold of the gates' own metrics."""
    t = gates.motion_tables(judged(spark, sf), SPIKE)
    joined = t["qc"].join(t["enriched"].select("File", *[c for c in t["enriched"].columns if c not in t["qc"].columns]), "File")
    return six(joined.select("File", *MO29, *MO29_PLAIN), *MO29)


@query("mo29_full_tables")
def mo29f(spark, sf):
    """All columns of the three tables side by side; each has an oracle in the query of its own operator."""
    whole = checkpointed(settled(spark, sf))
    t = gates.motion_tables(checkpointed(gates.full_record(whole, gates.dual_qc(gates.recording_metrics(whole, CFG), CFG), CFG)), SPIKE)
    wide = t["basic"]
    for name in ("qc", "enriched"):
        wide = wide.join(t[name].select("File", *[c for c in t[name].columns if c not in wide.columns]), "File")
    return six(wide, *[f.name for f in wide.schema if f.dataType.simpleString() == "double"])


def movement(spark, sf):
    return gates.movement_record(checkpointed(frames(spark, sf)), MOVEMENT, 1.0, 10, 8)


#: A stage whose limits are met by about half of the recordings.
MOVEMENT = gates.QcConfig(max_nan=0.06, max_pegged=0.34, good_step_um=1.6, max_spikes=0.5, limit_x_um=LIMIT, limit_y_um=LIMIT, spike_um=SPIKE, spike_frames=3, median_frames=WIN, peg_run_frames=3)
BURST_SQL = ", ".join(f"count(*) filter (coalesce(step_um > {t}, false) and not coalesce(coalesce(before > {t}, false), false) and frame > 1) as n{k}" for k, t in enumerate(gates.BURSTS))
MOVED = f"""{SPECTRA}, {island('pegs', 'is_pegged', 'peg_isl')}, longest as (select recording, coalesce(max(k) filter (is_pegged), 0) as longest from (select recording, is_pegged, count(*) as k from peg_isl group by recording, is_pegged, island) group by recording),
hot as (select *, coalesce(step_um > {SPIKE}, false) as hi, lag(step_um) over (partition by recording order by frame) as before from pegs), {island('hot', 'hi', 'hot_isl')}, marked as (select *, hi and count(*) over (partition by recording, hi, island) >= 3 as above from hot_isl),
calm_a as (select recording, frame, coalesce(median(step_um) over (partition by recording order by frame rows between 5 preceding and 4 following) < 1.6, false) as calm from steps), {island('calm_a', 'calm', 'calm_isl')},
calm as (select recording, (min(s) - 1) / 60.0 as auto_settle_min from (select recording, min(frame) as s from calm_isl where calm group by recording, island having count(*) >= 8) group by recording),
peak as (select recording, f, p from (select *, row_number() over (partition by recording order by p desc, f) as place from spectra where f between 0.01 and 0.5) where place = 1),
strips as (select recording, f, lead(f) over w as f2, (lead(f) over w - f) * (p + lead(p) over w) / 2 as area from spectra window w as (partition by recording order by f)),
power as (select recording, {', '.join(f'coalesce(sum(area) filter (f >= {lo} and f2 <= {hi}), 0) / sum(area) as frac_{k}' for k, (lo, hi) in gates.movement_bands(1.0).items())} from strips group by recording),
whole as (select recording, "group", count(*) as n_frames, list_sort(list(step_um) filter (step_um is not null)) as v, avg(step_um) as mean_step, coalesce(stddev_samp(step_um), 0) as sd_step, sum(step_um) as cum_path, avg(is_pegged::int) as pegged, avg(above::int) as spikes,
  coalesce(count(*) filter (dx_um is null or dy_um is null) = 0 and coalesce(stddev_samp(dx_um), 0) < 0.065 and coalesce(stddev_samp(dy_um), 0) < 0.065, false) as flatline, avg((dx_um is null or dy_um is null)::int) as nan_frac,
  avg(coalesce(step_um <= 0.1, false)::int) as b1, avg(coalesce(step_um <= 0.2, false)::int) as b2, median(dx_um) filter (frame >= n - 30) - median(dx_um) filter (frame <= 31) as ex, median(dy_um) filter (frame >= n - 30) - median(dy_um) filter (frame <= 31) as ey, {BURST_SQL}
  from marked group by recording, "group"),
moved as (select *, sqrt(ex * ex + ey * ey) as drift, (n_frames - 1)::double as seconds, nan_frac >= 0.06 as t_nan, pegged >= 0.34 as t_peg, longest >= 3 as t_run, {hz("v", 50)} as med from whole join longest using (recording) left join calm using (recording) left join peak using (recording) left join power using (recording)),
mv as (select *, not (t_peg or t_run or t_nan or flatline) as qc_pass, coalesce(med < 1.6 and spikes < 0.5, false) as still, coalesce(nullif(concat_ws(',', case when t_peg then 'pegged_frac' end, case when t_run then 'ceiling_run' end, case when t_nan then 'nan_frac' end, case when flatline then 'flatline' end), ''), 'OK') as reason,
  case when flatline then 'FLATLINE' when t_nan then 'NAN_EXCESS' when t_run then 'CEILING_RUN' when t_peg then 'PEGGED' else 'OK' end as health from moved)"""
MOVED_NUMBERS = {
    "MedianDisp_um": "med", "Pct95Disp_um": hz("v", 95), "CumPath_um": "cum_path", "NetDrift_um": "drift", "DriftRate_um_per_s": "drift / greatest(1e-9, seconds)", "Pegged_frac": "pegged", "MedianDisp_postSettle_um": "med",
    "Pct95Disp_postSettle_um": hz("v", 95), "CumPath_postSettle_um": "cum_path", "NetDrift_postSettle_um": "drift", "DriftRate_postSettle_um_per_s": "drift / greatest(1e-9, seconds)", "Pegged_postSettle_frac": "pegged",
    "SpikeFrac_postSettle_over_0p5um_per_s": "spikes", "JitterRatio_post_cumPath_over_netDrift": "least(1000, cum_path / greatest(1e-9, drift))", "TailLength_min": "seconds / 60", "AutoSettle_min": "auto_settle_min", "nan_frac": "nan_frac",
    "MeanStep_um": "mean_step", "SDStep_um": "sd_step", "P99Step_um": hz("v", 99), "MeanStep_postSettle_um": "mean_step", "P99Step_postSettle_um": hz("v", 99), "PctTime_step_le_0p10um": "b1", "PctTime_step_le_0p20um": "b2",
    "DriftAngle_deg": "degrees(atan2(ey, ex))", **{f"Rate_post_{str(t).replace('.', 'p')}um_per_min": f"n{k} / greatest(1e-9, n_frames / 60)" for k, t in enumerate(gates.BURSTS)}, "PSD_DominantFreq_Hz": "f", "PSD_DominantPeriod_min": "1 / f / 60",
    "PSD_DominantPower": "p", "PSD_FracLow": "frac_low", "PSD_FracMid": "frac_mid", "PSD_FracHigh": "frac_high", "MedianStep_um": "med", "MedianStep_postSettle_um": "med", "DriftSpeed_um_s": "drift / greatest(1e-9, seconds)",
    "MedianDisp_preSettle_um": "null::double", "SettleRatio_post_over_pre": "null::double", "settle_min": "0::double", "TailStart_min": "0::double", "fps_used": "1::double", "px_um": "0.26::double", "max_shift_um": f"{LIMIT}::double",
}
MOVED_PLAIN = {
    "File": "recording || '.avi'", "n_frames": "n_frames", "Flatline_flag": "flatline", "Flatline_postSettle_flag": "flatline", "QC_PASS": "qc_pass", "QC_PASS_tracking": "qc_pass", "QC_soft_still": "still", "QC_reason": "reason",
    "HealthFlag": "health", "rescue_count": "0", "unstable_tracking": "false", **{f"Bursts_post_{str(t).replace('.', 'p')}um": f"n{k}" for k, t in enumerate(gates.BURSTS)},
}


@query("mo29_movement_tables", f"with {MOVED} select {', '.join(f'round({c}, 6) as {chr(34)}{n}{chr(34)}' for n, c in MOVED_NUMBERS.items())}, {', '.join(f'{c} as {chr(34)}{n}{chr(34)}' for n, c in MOVED_PLAIN.items())} from mv")
def mo29m(spark, sf):
    """All columns of the three tables of the movement stage side by side."""
    t = gates.movement_tables(checkpointed(movement(spark, sf)))
    wide = t["basic"]
    for name in ("qc", "enriched"):
        wide = wide.join(t[name].select("File", *[c for c in t[name].columns if c not in wide.columns]), "File")
    return six(wide, *MOVED_NUMBERS)


@query("mo31_movement_summary", f"""with {MOVED} select "group", count(*) as n_files, count(*) filter (qc_pass) as n_pass, round(count(*) filter (qc_pass) / count(*), 6) as pass_rate, count(*) filter (qc_pass) as n_pass_tracking, count(*) filter (still) as n_soft_still,
  round(avg(med), 6) as "mean_MedianDisp_post_um", round(stddev_samp(med), 6) as "sd_MedianDisp_post_um", null::double as "mean_SettleRatio", null::double as "sd_SettleRatio", round(avg(auto_settle_min), 6) as "mean_AutoSettle_min", round(avg(seconds / 60), 6) as "mean_TailLength_min" from mv group by "group" """)
def mo31m(spark, sf):
    got = gates.movement_summary(movement(spark, sf))
    return six(got, *[f.name for f in got.schema if f.dataType.simpleString() == "double"])


@query("mo30_motion_summary", f"""with {FRAMES}, e as (select recording, median(dx_um) filter (frame >= n - 30) - median(dx_um) filter (frame <= 31) as x, median(dy_um) filter (frame >= n - 30) - median(dy_um) filter (frame <= 31) as y, median(step_um) as median_step, sum(step_um) as cum_path, median(step_um) filter (frame > 20) as median_step_late from steps group by recording)
select recording, round(median_step, 6) as median_step, round(cum_path, 6) as cum_path, round(median_step_late, 6) as median_step_late, round(sqrt(x * x + y * y), 6) as net_drift from e""")
def mo30(spark, sf):
    """A fixed settling time (20 frames here) and no reposition cleaning."""
    got = tables.motion_summary(frames(spark, sf), WIN, 20)
    return six(got, "median_step", "cum_path", "median_step_late", "net_drift").select("recording", "median_step", "cum_path", "median_step_late", "net_drift")


MO31 = ("movement_valid_rate", "roi_eligible_rate", "mean_median_step_ps", "sd_median_step_ps", "mean_excursion_frac", "max_excursion_frac", "mean_pegged")


@query("mo31_group_summary", f"""with {JUDGED} select "group", count(*) as n_files, count(*) filter (movement_valid) as n_movement_valid, round(count(*) filter (movement_valid) / count(*), 6) as movement_valid_rate, count(*) filter (roi_eligible) as n_roi_eligible,
round(count(*) filter (roi_eligible) / count(*), 6) as roi_eligible_rate, count(*) filter (t_exit) as n_boundary_exit, round(avg(med_step_ps), 6) as mean_median_step_ps, round(stddev_samp(med_step_ps), 6) as sd_median_step_ps,
round(avg(excursion_frac), 6) as mean_excursion_frac, round(max(excursion_frac), 6) as max_excursion_frac, round(avg(pegged), 6) as mean_pegged from judged group by "group" """)
def mo31(spark, sf):
    return six(gates.group_summary(judged(spark, sf), CFG), *MO31)


CANDIDATES = """"group" as "Group", recording as "Stem", recording || '.avi' as "AVI", movement_valid as "MOVEMENT_VALID", movement_reason as "Movement_QC_reason", roi_eligible as "ROI_ELIGIBLE", roi_reason as "ROI_QC_reason", round(excursion_frac, 6) as "Excursion_frac_FOV", post_start_frame as "PostSettleStartFrame", n_frames, 1.0::double as fps_used"""


@query("mo32_roi_candidates", f"with {JUDGED} select {CANDIDATES} from judged")
def mo32(spark, sf):
    return six(gates.roi_candidates(judged(spark, sf)), "Excursion_frac_FOV")


@query("mo33_histograms", f"""with {FRAMES}, e as (select recording, median(dx_um) filter (frame >= n - 30) - median(dx_um) filter (frame <= 31) as x, median(dy_um) filter (frame >= n - 30) - median(dy_um) filter (frame <= 31) as y from steps group by recording)
select 'step' as kind, floor(step_um / 0.25)::int as bin, count(*) as n, null::double as probability from steps where step_um is not null group by all
union all select 'angle', floor(((degrees(atan2(y, x)) % 360) + 360) % 360 / 30)::int % 12, count(*), round(count(*) / (sum(count(*)) over ()), 6) from e where x is not null and y is not null group by 2""")
def mo33(spark, sf):
    f = frames(spark, sf)
    steps = series.fixed_histogram(f, "step_um", 0.25).select(F.lit("step").alias("kind"), "bin", "n", F.lit(None).cast("double").alias("probability"))
    angles = series.angle_histogram(series.net_drift(f, WIN), "drift_angle").select(F.lit("angle").alias("kind"), F.col("sector").alias("bin"), "n", F.round("probability", 6).alias("probability"))
    return steps.unionByName(angles)


@query("mo34_sort_by_status", f'with {JUDGED} select {CANDIDATES} from judged order by roi_eligible desc, movement_valid desc, recording')
def mo34(spark, sf):
    return six(gates.sort_by_status(gates.roi_candidates(judged(spark, sf))), "Excursion_frac_FOV")
