"""Registered queries of movies, maps and regions (driver table ``embeddings``: each vector is a frame of 8 by 8 pixels),
with their DuckDB twins."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from motionspark.jobs.motion_queries import hz, six
from motionspark.operators import movies, refine, tables
from motionspark.operators.traces import mean_of
from motionspark.runtime import checkpointed, shared_folder
from motionspark.sources import adapters

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def movie(spark, sf):
    order = Window.partitionBy("label").orderBy("vec_id")
    e = adapters.table(spark, sf, "embeddings").withColumn("frame", F.row_number().over(order))
    return e.select(F.concat(F.lit("L"), "label").alias("recording"), "frame", F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 100 + 100).alias("pixels"))


MV = """mv as (select 'L' || label as recording, row_number() over (partition by label order by vec_id) as frame, list_transform(embedding::double[], lambda v: v * 100 + 100) as px from embeddings),
pix as (select recording, frame, (i // 8)::int as y, (i % 8)::int as x, value from (select recording, frame, unnest(range(64)) as i, unnest(px) as value from mv))"""


@query("io05_read_frames", f"with {MV} select recording, count(*) as n_frames, round(avg(list_avg(px)), 3) as mean from mv group by recording")
def io05(spark, sf):
    """The frames written as Parquet, in single precision, and read back."""
    path = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    movie(spark, sf).withColumn("pixels", F.col("pixels").cast("array<float>")).write.partitionBy("recording").parquet(path)
    m = tables.read_frames(spark, path)
    return m.groupBy("recording").agg(F.count("*").alias("n_frames"), F.round(F.avg(mean_of(F.col("pixels").cast("array<double>"))), 3).cast("double").alias("mean"))


@query("io05_read_rois", "select 'L' || label as recording, vec_id as roi_id, null::double as fps, null::int as event_count, round(list_sum(embedding::double[]), 6) as total from embeddings")
def io05r(spark, sf):
    """Regions written without some columns, and read back with them."""
    path = f"{shared_folder(spark)}/rois-{uuid.uuid4().hex}"
    adapters.table(spark, sf, "embeddings").select(F.concat(F.lit("L"), "label").alias("recording"), F.col("vec_id").cast("string").alias("roi_id"), F.col("embedding").cast("array<double>").alias("dff")).write.parquet(path)
    got = tables.read_rois(spark, path)
    return six(got.select("recording", "roi_id", "fps", "event_count", F.aggregate("dff", F.lit(0.0), lambda a, v: a + v).alias("total")), "total")


@query("im01_quiet_window", f"""with {MV}, d as (select recording, frame, px, lag(px) over (partition by recording order by frame) as q from mv),
m as (select recording, frame, list_median(list_transform(list_zip(px, q), lambda z: abs(z[1] - z[2]))) as d from d where q is not null),
s as (select recording, frame, median(d) over (partition by recording order by frame rows between 2 preceding and 2 following) as m from m),
a as (select recording, frame, avg(m) over w as activity, count(*) over w as k, count(*) over (partition by recording) as n from s window w as (partition by recording order by frame rows between current row and 9 following)),
r as (select *, row_number() over (partition by recording order by activity, frame) as p from a where k = least(10, n))
select recording, frame::int as start, round(activity, 6) as activity from r where p = 1""")
def im01(spark, sf):
    return six(movies.quiet_window(movie(spark, sf), fps=10, least=10, seconds=1), "activity")


def shifts(spark, sf):
    m = movie(spark, sf)
    return movies.estimate_shifts(m, movies.template(m, movies.quiet_window(m, fps=10, least=10, seconds=1), 10), 2, 3)


@query("im02_estimate_shifts")
def im02(spark, sf):
    return six(shifts(spark, sf), "dx_px", "dy_px")


@query("im03_motion_quality", r"""with f as (select 'S' || user_id as recording, (value - 50) / 10 as dx, (try_cast(regexp_extract(props, '(\d+)', 1) as double) - 50) / 10 as dy, event_type = 'error' and event_id % 7 = 0 as lost from events),
k as (select recording, case when not coalesce(lost, false) then dx end as dx, case when not coalesce(lost, false) then dy end as dy from f),
q as (select recording, max(greatest(abs(dx), abs(dy))) as m, greatest(max(dx) - min(dx), max(dy) - min(dy)) as r from k group by recording)
select recording, round(m, 6) as max_shift, round(r, 6) as shift_range, case when m > 9 then 'excessive_motion' when r > 9 then 'high_motion' else 'good' end as motion_quality from q""")
def im03(spark, sf):
    return six(movies.motion_quality(adapters.frames(spark, sf), 9), "max_shift", "shift_range")


@query("im04_align_shifts", f"""with {MV}, s as (select recording, frame, frame * 0.5 as dx, -frame * 0.25 as dy from mv where frame <= 20 and frame % 3 <> 0)
select m.recording, m.frame::int as frame, s.dx::double as dx_px, s.dy::double as dy_px from mv m left join s on s.recording = m.recording and s.frame = (select max(t.frame) from s t where t.recording = m.recording and t.frame <= m.frame)""")
def im04(spark, sf):
    m = movie(spark, sf).select("recording", "frame")
    known = m.filter((F.col("frame") <= 20) & (F.col("frame") % 3 != 0)).select("recording", "frame", (F.col("frame") * 0.5).cast("double").alias("dx_px"), (-F.col("frame") * 0.25).cast("double").alias("dy_px"))
    return movies.align_shifts(m, known)


@query("im05_apply_shifts")
def im05(spark, sf):
    m = movie(spark, sf)
    s = m.select("recording", "frame", (F.col("frame") % 3 - 1).cast("double").alias("dx_px"), (F.col("frame") % 5 / 2.0 - 1).alias("dy_px"))
    return movies.apply_shifts(m, s).select("recording", "frame", F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("im06_sample_frames", f"with {MV}, l as (select recording, max(frame) as last from mv group by recording), w as (select recording, last, unnest(range(12)) as k from l) select distinct recording, round(1 + k * ((last - 1) / 11))::int as frame from w")
def im06(spark, sf):
    return movies.sample_frames(movie(spark, sf), 12).select("recording", "frame")


STD = "ms as (select recording, y, x, avg(value) as mean, stddev_samp(value) as std from pix group by all)"


@query("im07_pixel_mean_std", f"with {MV}, {STD} select recording, y, x, round(mean, 6) as mean, round(std, 6) as std from ms")
def im07(spark, sf):
    return six(movies.pixel_mean_std(movie(spark, sf)), "mean", "std")


@query("im08_brain_mask")
def im08(spark, sf):
    return movies.brain_mask(movies.pixel_mean_std(movie(spark, sf)), 1.0, 4, 1).select("recording", "y", "x", "in_mask")


CN = f"""{MV}, ck as (select *, (frame - 1) // 20 as chunk from pix), st as (select recording, chunk, y, x, avg(value) as m, coalesce(stddev_samp(value), 0) as s, max(value) as top from ck group by all),
z as (select c.recording, c.chunk, c.frame, c.y, c.x, (value - m) / (s + 1.1920928955078125e-07) as z from ck c join st using (recording, chunk, y, x)),
nb as (select a.recording, a.chunk, a.y, a.x, sum(a.z * b.z) / count(distinct a.frame) / 8 as cn from z a join z b on a.recording = b.recording and a.frame = b.frame and not (a.y = b.y and a.x = b.x)
  and (b.y - a.y + 8) % 8 in (0, 1, 7) and (b.x - a.x + 8) % 8 in (0, 1, 7) group by all),
cnp as (select recording, y, x, avg(cn) as cn, avg((top - m) / (s + 1.1920928955078125e-07)) as pnr from nb join st using (recording, chunk, y, x) group by all)"""


@query("im09_cn_pnr_maps", f"with {CN} select recording, y, x, round(cn, 6) as cn, round(pnr, 6) as pnr from cnp")
def im09(spark, sf):
    return six(movies.cn_pnr_maps(movie(spark, sf), 20), "cn", "pnr")


def raw_maps(spark, sf):
    """Maps before masking and smoothing, with a mask of all but the first and last row of pixels."""
    m = movie(spark, sf)
    bands = movies.mean_std_bands(m).join(movies.cn_pnr_bands(m, 20).select("recording", "band", "cn", "pnr"), ["recording", "band"])
    return bands.withColumn("in_mask", F.transform("cn", lambda v, i: F.when(F.floor(i / 8).between(1, 6), 1.0).otherwise(0.0)))


def maps(spark, sf):
    return movies.finished_maps(raw_maps(spark, sf))


def smooth_sql(source: str, column: str, sigma: float, out: str) -> str:
    """CTEs from ``source`` (recording, y, x, column) to ``out`` (recording, y, x, v): the Gaussian filter with the border repeated."""
    half = math.ceil(2 * sigma)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    taps = ", ".join(f"({k - half}, {v / sum(w)!r}::double)" for k, v in enumerate(w))
    step = lambda src, col, name, along, across: f"{name} as (select a.recording, a.y, a.x, sum(t.w * b.{col}) as v from {src} a, (values {taps}) t(k, w), {src} b where b.recording = a.recording and b.{across} = a.{across} and b.{along} = greatest(0, least(7, a.{along} + t.k)) group by all)"
    return f"{step(source, column, f'{out}_v', 'y', 'x')}, {step(f'{out}_v', 'v', out, 'x', 'y')}"


FINISHED = f"""{CN}, masked as (select recording, y, x, case when y between 1 and 6 then cn else 0 end as cn, case when y between 1 and 6 then pnr else 0 end as pnr from cnp),
{smooth_sql("masked", "cn", 1.5, "s_cn")}, {smooth_sql("masked", "pnr", 1.0, "s_pnr")},
fin as (select recording, y, x, a.v as cn, b.v as pnr from s_cn a join s_pnr b using (recording, y, x)), inside as (select * from fin where y between 1 and 6)"""


@query("im09_finished_maps", f"with {FINISHED} select recording, y, x, round(cn, 6) as cn, round(pnr, 6) as pnr from fin")
def im09f(spark, sf):
    return six(movies.pixels_of(maps(spark, sf), "cn", "pnr"), "cn", "pnr")


MEASURES = ("mean", "median", "std", "min", "max", *(f"p{k}" for k in movies.PERCENTILES))


def map_sql(c: str) -> str:
    """The measures of one map as SQL."""
    plain = {"mean": f"avg({c})", "median": f"median({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})"}
    return ", ".join(f"{plain.get(k) or hz(f'list_sort(list({c}))', int(k[1:]))} as {c}_{k}" for k in MEASURES)


def map_stats_sql(least_c: float, least_p: float, rows: str) -> str:
    return f"""v as (select recording, {map_sql("cn")}, {map_sql("pnr")} from {rows} group by recording),
ms as (select *, cn_max - cn_min as cn_range, cn_max - cn_min < 0.15 and cn_median > 0.7 as cn_uniform, case when pnr_max < {least_p} then 'low_pnr' when cn_max < {least_c} then 'poor_correlation' else 'normal' end as data_quality,
  pnr_p75 < {least_p} as weak_signal_mode, case when pnr_p75 < {least_p} then {0.75 * least_p} else {least_p} end::double as effective_min_pnr, case when pnr_p75 < {least_p} then {0.8 * least_c} else {least_c} end::double as effective_min_corr from v)"""


LEVELS = """t as (select *, greatest(effective_min_corr, least(cn_p75, 0.6)) as c, greatest(effective_min_pnr, least(pnr_p75, 6)) as p from ms),
lv as (select recording, cn_uniform, 1 as level, 'strict' as name, c as cn, p as pnr from t union all select recording, cn_uniform, 2, 'medium', greatest(effective_min_corr, 0.7 * c), greatest(0.8 * effective_min_pnr, 0.7 * p) from t union all select recording, cn_uniform, 3, 'relaxed', effective_min_corr, effective_min_pnr from t)"""
MAP_COLUMNS = (*(f"{c}_{k}" for c in ("cn", "pnr") for k in MEASURES), "cn_range")


@query("im10_map_stats", f"with {FINISHED}, {map_stats_sql(0.3, 3.0, 'inside')} select recording, {', '.join(f'round({c}, 6) as {c}' for c in MAP_COLUMNS)}, cn_uniform, data_quality, weak_signal_mode, effective_min_pnr, effective_min_corr from ms")
def im10(spark, sf):
    """Statistics of the finished maps within the mask."""
    return six(movies.map_stats(maps(spark, sf)), *MAP_COLUMNS)


@query("im11_threshold_levels", f"with {FINISHED}, {map_stats_sql(0.02, 1.5, 'inside')}, {LEVELS} select recording, level, name, round(cn, 6) as cn, round(pnr, 6) as pnr from lv")
def im11(spark, sf):
    return six(movies.threshold_levels(movies.map_stats(maps(spark, sf), 0.02, 1.5)), "cn", "pnr").drop("cn_uniform")


@query("im11_weak_signal_levels", f"with {FINISHED}, {map_stats_sql(0.5, 9.0, 'inside')}, {LEVELS} select recording, level, name, round(cn, 6) as cn, round(pnr, 6) as pnr from lv")
def im11w(spark, sf):
    """Limits above what the recordings reach, so they are lowered."""
    return six(movies.threshold_levels(movies.map_stats(maps(spark, sf), 0.5, 9.0)), "cn", "pnr").drop("cn_uniform")


def top_sql(source: str, out: str) -> str:
    """Pixels of ``source`` (v) that no neighbour exceeds; no two neighbours are equal here."""
    return f"{out} as (select recording, y, x from {source} a where not exists (select 1 from {source} b where b.recording = a.recording and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1 and b.v > a.v))"


SCALES = (0.5, 1.0, 1.5)
SEEDS = f"""{FINISHED}, {map_stats_sql(0.0, 1.5, 'inside')}, {LEVELS}, inner_maps as (select recording, y, x, case when y between 1 and 6 then cn else 0 end as cn, case when y between 1 and 6 then pnr else 0 end as pnr from fin),
{', '.join(f"{smooth_sql('inner_maps', c, s, f'{c}{k}')}, {top_sql(f'{c}{k}', f'top_{c}{k}')}" for c in ("cn", "pnr") for k, s in enumerate(SCALES))},
tops as ({' union '.join(f"select * from top_cn{k}" for k in range(3))}), tops4 as ({' union '.join(f"select * from top_pnr{k}" for k in range(3))}),
by_level as (select i.recording, i.y, i.x, i.cn * i.pnr as score, min(l.level)::int as level from inside i join tops using (recording, y, x) join lv l on l.recording = i.recording and i.cn > l.cn and i.pnr > l.pnr and not l.cn_uniform group by all),
cut as (select v.recording, greatest(0.9 * l.pnr, {hz("v", 70)}) as least from (select recording, list_sort(list(pnr)) as v from inside group by recording) v join lv l on l.recording = v.recording and l.level = 3),
by_peak as (select i.recording, i.y, i.x, i.pnr as score, 4 as level from inside i join tops4 using (recording, y, x) join cut c on c.recording = i.recording and i.pnr > c.least where i.recording not in (select recording from by_level)),
sd as (select *, row_number() over (partition by recording order by score desc, y, x)::int as place from (select * from by_level union all select * from by_peak))"""


def levels(spark, sf, bands=None):
    return movies.threshold_levels(movies.map_stats(maps(spark, sf) if bands is None else bands, 0.0, 1.5))


@query("im12_seed_candidates", f"with {SEEDS} select recording, y, x, round(score, 6) as score, level, place from sd")
def im12(spark, sf):
    """Regional maxima of the finished maps at three scales over the limits of each level."""
    bands = checkpointed(maps(spark, sf))
    return six(movies.seed_candidates(bands, levels(spark, sf, bands), 1.0), "score")


def whole_chain(spark, sf):
    """Finished maps of each recording with its own mask (parameters for 8 by 8 pixels), and their levels."""
    bands = checkpointed(movies.recording_maps(movie(spark, sf), 20, (1.0, 4, 1)))
    return bands, levels(spark, sf, bands)


@query("im13_seeds")
def im13(spark, sf):
    """Candidates of all scales and levels (IM-12) after removal of those near a better one (IM-13)."""
    bands, limits = whole_chain(spark, sf)
    return six(movies.find_regions(bands, limits, 1.0, 3, 20, grow=False, blur=None), "score")


def regions(spark, sf):
    bands, limits = whole_chain(spark, sf)
    return movies.find_regions(bands, limits, 1.0, 3, 20, blur=None)


@query("im14_grow_rois")
def im14(spark, sf):
    return regions(spark, sf).select("recording", "roi_id", "y", "x", F.col("level"))


MASKS = "mk as (select distinct recording, r as roi_id, ty + oy as y, tx + ox as x from (select distinct recording from mv), (select unnest([1, 2, 3]) as r, unnest([1, 1, 5]) as ty, unnest([1, 5, 3]) as tx), (select unnest([0, 0, 1, 1]) as oy, unnest([0, 1, 0, 1]) as ox))"


def masks(spark, sf):
    cells = [(r, y + a, x + b) for r, y, x in ((1, 1, 1), (2, 1, 5), (3, 5, 3)) for a in (0, 1) for b in (0, 1)]
    c = F.array(*[F.struct(F.lit(r).alias("roi_id"), F.lit(y).alias("y"), F.lit(x).alias("x")) for r, y, x in cells])
    return movie(spark, sf).select("recording").distinct().select("recording", F.inline(c))


RING = """wide as (select distinct k.recording, k.roi_id, k.y + a as y, k.x + b as x from mk k, (select unnest(range(-2, 3)) as a), (select unnest(range(-2, 3)) as b) where a * a + b * b <= 6.25 and k.y + a between 0 and 7 and k.x + b between 0 and 7),
near as (select distinct k.recording, k.roi_id, k.y + a as y, k.x + b as x from mk k, (select unnest(range(-1, 2)) as a), (select unnest(range(-1, 2)) as b) where a * a + b * b <= 1),
ring as (select * from wide w where not exists (select 1 from near n where n.recording = w.recording and n.roi_id = w.roi_id and n.y = w.y and n.x = w.x) and not exists (select 1 from mk n where n.recording = w.recording and n.y = w.y and n.x = w.x))"""


@query("im15_neuropil_masks", f"with {MV}, {MASKS}, {RING} select recording, roi_id, y::int as y, x::int as x from ring")
def im15(spark, sf):
    return movies.neuropil_masks(masks(spark, sf), 8, 8, 1.0, 2.5)


@query("im16_extract_traces", f"with {MV}, {MASKS}, {RING}, f as (select p.recording, roi_id, frame, avg(value) as f from pix p join mk using (recording, y, x) group by all), g as (select p.recording, roi_id, frame, median(value) as fneu from pix p join ring using (recording, y, x) group by all) select recording, roi_id, frame::int as frame, round(f, 6) as f, round(fneu, 6) as fneu from f join g using (recording, roi_id, frame)")
def im16(spark, sf):
    p, m = movie(spark, sf), masks(spark, sf)
    ring = movies.extract_traces(p, movies.neuropil_masks(m, 8, 8, 1.0, 2.5), "median").withColumnRenamed("f", "fneu")
    got = movies.extract_traces(p, m).join(ring, ["recording", "roi_id", "frame"])
    return six(got.withColumn("roi_id", F.col("roi_id").cast("int")), "f", "fneu")


@query("im18_global_signal", f"with {MV}, {MASKS} select recording, frame::int as frame, round(avg(value), 6) as g from pix p where not exists (select 1 from mk where mk.recording = p.recording and mk.y = p.y and mk.x = p.x) group by all")
def im18(spark, sf):
    """With every frame sampled the curve passes through the means themselves."""
    got = movies.global_signal(movie(spark, sf), masks(spark, sf), 20_000, 10).select("recording", F.posexplode("signal").alias("frame", "g"))
    return six(got.withColumn("frame", F.col("frame") + 1), "g")


SHAPES = ("area", "extent", "diameter_um", "area_um2", "major", "minor", "eccentricity", "aspect")
SHAPE = """mo as (select recording, roi_id, count(*)::int as area, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) as box, var_pop(x) + 1 / 12 as xx, var_pop(y) + 1 / 12 as yy, covar_pop(x, y) as xy from mk group by all),
ax as (select *, 2 * sqrt(2) * sqrt(xx + yy + sqrt((xx - yy) ** 2 + 4 * xy ** 2)) as major, 2 * sqrt(2) * sqrt(xx + yy - sqrt((xx - yy) ** 2 + 4 * xy ** 2)) as minor from mo)"""


@query("im28_roi_shape", f"with {MV}, {MASKS}, {SHAPE} select recording, roi_id, area, round(area / box, 6) as extent, round(2 * sqrt(area * 0.0676 / pi()), 6) as diameter_um, round(area * 0.0676, 6) as area_um2, round(major, 6) as major, round(minor, 6) as minor, round(sqrt(1 - (minor / major) ** 2), 6) as eccentricity, round(major / minor, 6) as aspect from ax")
def im28(spark, sf):
    """Solidity, perimeter and compactness have no closed form; they are tested on shapes with known ones."""
    return six(movies.roi_shape(masks(spark, sf), 0.26), *SHAPES[1:]).select("recording", "roi_id", *SHAPES)


@query("im31_zero_roi_diagnostics")
def im31(spark, sf):
    """Regions of 5 pixels at least are asked for, which only some recordings have."""
    bands, limits = whole_chain(spark, sf)
    counts = movies.find_regions(bands, limits, 1.0, 5, 20, blur=None).groupBy("recording").agg(F.count_distinct("roi_id").alias("n_rois"))
    seeds = movies.thinned(movies.seed_candidates(bands, limits, 1.0), 1.5)
    return movies.zero_roi_diagnostics(movies.map_stats(bands, 0.0, 1.5), counts, seeds, 0.0, 1.5, 5, 20, 1.0)


@query("im32_detection_thresholds")
def im32(spark, sf):
    bands, limits = whole_chain(spark, sf)
    found = movies.find_regions(bands, limits, 1.0, 3, 20, blur=None)
    return six(movies.detection_thresholds(movies.map_stats(bands, 0.0, 1.5), limits, found, 0.0, 1.5), "cn_median", "cn_range", "cn_max", "pnr_median", "pnr_max", "cn", "pnr")


FIELD = "fd as (select recording, y, x from (select distinct recording from mv), (select unnest(range(1, 7)) as y), (select unnest(range(1, 8)) as x))"
PERIM = lambda t, k: f"select distinct a.* from {t} a, (select unnest([0, 1, 0, -1]) as a, unnest([1, 0, -1, 0]) as b) o where not exists (select 1 from {t} c where c.recording = a.recording{k} and c.y = a.y + o.a and c.x = a.x + o.b)"


@query("rf02_reject_edge", f"with {MV}, {MASKS}, {FIELD}, own as ({PERIM('mk', ' and c.roi_id = a.roi_id')}), edge as ({PERIM('fd', '')}) select o.recording, o.roi_id, round(count(e.y) / count(*), 6) as contact, count(e.y) / count(*) > 0.2 as rejected from own o left join edge e on e.recording = o.recording and e.y = o.y and e.x = o.x group by all")
def rf02(spark, sf):
    cells = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in range(1, 7) for x in range(1, 8)])
    field = movie(spark, sf).select("recording").distinct().select("recording", F.inline(cells))
    got = movies.reject_edge(masks(spark, sf), field)
    return six(got.select("recording", "roi_id", "contact", F.col("c_edge").isNotNull().alias("rejected")), "contact")


@query("rf03_reject_shape")
def rf03(spark, sf):
    return movies.reject_shape(movies.roi_shape(regions(spark, sf), 0.26)).select("recording", "roi_id", "area", F.round("eccentricity", 6).alias("eccentricity"), "c_shape")


@query("rf08_correlated_regions")
def rf08(spark, sf):
    """Regions of a movie whose traces are alike, pruned in order."""
    from motionspark.operators import traces

    long = movies.extract_traces(movie(spark, sf), masks(spark, sf))
    rows = long.groupBy("recording", "roi_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "f"))), lambda s: s["f"]).alias("dff")).withColumn("fps", F.lit(2.0))
    return six(refine.prune_correlated(traces.snr(rows, "dff"), "dff", 0.05), "value")
