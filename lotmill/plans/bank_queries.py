"""Memory-bank scoring, distance-map, threshold-curve and version queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotmill.functions.names import folded, plain_lot, sql_folded, sql_plain_lot
from lotmill.operators import grid, knn, quality, sweep, versions
from lotmill.operators.records import to_records
from lotmill.plans.lookup_queries import REC
from lotmill.session import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "bank_patches").where(knn.usable(F.col("embedding"), 32))
    return b.select(folded(F.col("bank_version")).alias("key"), "bank_row", "embedding", "source_image", "patch_row", "patch_col").where("key is not null")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "query_patches").where(knn.usable(F.col("embedding"), 32))
    return q.select(folded(F.col("bank_version")).alias("key"), F.col("vec_id").alias("query_id"), "image", "q_index", "embedding").where("key is not null")


_GOOD = "len(embedding) = 32 and not list_bool_or(list_transform(embedding, lambda v: v is null or isnan(v) or isinf(v)))"
KNN = f"""with b as (select {sql_folded("bank_version")} as k, bank_row, source_image, patch_row, patch_col, embedding::double[] as e from bank_patches where {_GOOD}),
q as (select {sql_folded("bank_version")} as k, vec_id, image, q_index, embedding::double[] as e from query_patches where {_GOOD}),
r as (select q.k, q.vec_id, q.image, q.q_index, b.bank_row, list_distance(q.e, b.e) as d from q join b on q.k = b.k),
n as (select * from (select *, row_number() over (partition by vec_id order by d, bank_row) as place from r) where place = 1)
"""


@query(KNN + "select vec_id as query_id, bank_row, round(d, 6) as distance from n")
def knn_nearest(spark, sf_dir):
    return knn.nearest_exact(_bank(spark, sf_dir), _queries(spark, sf_dir)).select("query_id", "bank_row", F.round("distance", 6).alias("distance"))


def _first(spark, sf_dir):
    q = _queries(spark, sf_dir)
    return cut(knn.nearest_exact(_bank(spark, sf_dir), q)), q.select("query_id", "image", F.col("q_index").alias("patch"))


@query(KNN + "select image, round(d, 6) as raw, q_index as worst_patch from (select *, row_number() over (partition by image order by d desc, q_index) as rn from n where image is not null) where rn = 1")
def image_scores(spark, sf_dir):
    near, patches = _first(spark, sf_dir)
    return knn.image_scores(near, patches.where("image is not null")).select("image", F.round("raw", 6).alias("raw"), "worst_patch")


@query(KNN + """, t as (select *, row_number() over (partition by image order by d desc, q_index, vec_id) as pl from n where image is not null)
select t.image, t.pl::int as place, t.q_index as patch, t.bank_row, round(t.d, 6) as distance, b.source_image, b.patch_row, b.patch_col from t join b on b.k = t.k and b.bank_row = t.bank_row where t.pl <= 5""")
def topk_trace(spark, sf_dir):
    near, patches = _first(spark, sf_dir)
    top = knn.top_patches(near, patches.where("image is not null"), 8)
    out = top.join(_bank(spark, sf_dir).drop("embedding"), ["key", "bank_row"])
    return out.select("image", "place", "patch", "bank_row", F.round("distance", 6).alias("distance"), "source_image", "patch_row", "patch_col")


_REW = KNN + """, nb as (select k, anchor, near from (select a.k, a.bank_row as anchor, b.bank_row as near, row_number() over (partition by a.k, a.bank_row order by list_distance(a.e, b.e), b.bank_row) as rn
  from b a join b on a.k = b.k where (a.k, a.bank_row) in (select (k, bank_row) from n)) where rn <= 9),
x as (select n.vec_id, n.bank_row as anchor, n.d as raw, list_distance(q.e, b.e) as d from n join nb on nb.k = n.k and nb.anchor = n.bank_row join b on b.k = nb.k and b.bank_row = nb.near join q on q.vec_id = n.vec_id),
w as (select vec_id, anchor, raw, count(*) as c, max(d) as top, min(d) as low, list(d) as ds from x group by all)
select vec_id as query_id, anchor, round(raw, 6) as raw, round(case when c <= 1 then raw else (1 - exp(low - top) / list_sum(list_transform(ds, lambda v: exp(v - top)))) * raw end, 6) as score from w"""


def _reweighted(spark, sf_dir):
    return knn.reweighted(cut(_bank(spark, sf_dir)), _queries(spark, sf_dir))


@query(_REW)
def knn_reweighted(spark, sf_dir):
    return _reweighted(spark, sf_dir).select("query_id", "anchor", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


@query("with s as (" + _REW + ") select q.image, count(*) as patches, count(*) filter (s.score >= 2) as defect_patches, max(s.score) as image_score, max(s.score) >= 2 as defect from s join query_patches q on q.vec_id = s.query_id group by 1")
def entry_scores(spark, sf_dir):
    """The flagship: nearest bank row, reweighting and verdict, gathered per image."""
    s = _reweighted(spark, sf_dir).withColumn("score", F.round("score", 6))
    both = s.join(table(spark, sf_dir, "query_patches").select(F.col("vec_id").alias("query_id"), "image"), "query_id")
    top = F.max("score")
    return both.groupBy("image").agg(F.count(F.lit(1)).alias("patches"), F.count_if(F.col("score") >= 2).alias("defect_patches"), top.alias("image_score"), (top >= 2).alias("defect"))


@query(f"with n as (select {sql_folded('bank_version')} as key, source_image, count(*) as n_rows from bank_patches where source_image is not null and bank_version is not null group by all) select key, source_image, n_rows, n_rows * count(*) over (partition by key) / sum(n_rows) over (partition by key) as amplification from n")
def contributing_images(spark, sf_dir):
    b = table(spark, sf_dir, "bank_patches").where("bank_version is not null").select(folded(F.col("bank_version")).alias("key"), "source_image")
    return knn.contributions(b)


_ISO = KNN.split("q as (")[0] + """g as (select k from b group by k having count(*) > 9),
m as (select k, bank_row, avg(d) as iso from (select a.k, a.bank_row, list_distance(a.e, b.e) as d, row_number() over (partition by a.k, a.bank_row order by list_distance(a.e, b.e), b.bank_row) as rn from b a join b on a.k = b.k and a.bank_row <> b.bank_row where a.k in (select k from g)) where rn <= 8 group by all),
z as (select k, bank_row, iso, case when stddev_pop(iso) over (partition by k) < 1e-12 then 0 else (iso - avg(iso) over (partition by k)) / stddev_pop(iso) over (partition by k) end as z from m)
"""


def _isolated(spark, sf_dir):
    bank = cut(_bank(spark, sf_dir))
    return cut(knn.isolation(bank)), bank


@query(_ISO + "select k as key, bank_row, round(iso, 6) as isolation, round(z, 6) as z from z")
def isolation_z(spark, sf_dir):
    s, _ = _isolated(spark, sf_dir)
    return s.select("key", "bank_row", F.round("isolation", 6).alias("isolation"), F.round("z", 6).alias("z"))


_IMG = _ISO + """, i as (select z.k as key, source_image, count(*) as n_rows, avg(z) as z_mean, max(z) as z_max, count(*) filter (z >= 2) as hot_rows, count(*) filter (z >= 2) / count(*) as hot_share, count(*) >= 3 as ranked
 from z join b using (k, bank_row) where source_image is not null group by all)
"""


@query(_IMG + "select key, source_image, n_rows, round(z_mean, 6) as z_mean, round(z_max, 6) as z_max, hot_rows, hot_share, ranked from i")
def image_isolation(spark, sf_dir):
    out = knn.image_isolation(*_isolated(spark, sf_dir))
    return out.withColumn("z_mean", F.round("z_mean", 6)).withColumn("z_max", F.round("z_max", 6))


@query(_IMG + "select key, source_image, round(z_mean, 6) as z_mean, hot_rows from i where (ranked and z_mean >= 1) or hot_rows > 0")
def suspects(spark, sf_dir):
    return knn.suspects(knn.image_isolation(*_isolated(spark, sf_dir))).select("key", "source_image", F.round("z_mean", 6).alias("z_mean"), "hot_rows")


@query(f"select {sql_folded('bank_version')} as bank_version, matches[1].bank_image as bank_image, count(*) as n from inference_results where len(matches) > 0 and matches[1].bank_image is not null group by all")
def bank_contribution(spark, sf_dir):
    r = table(spark, sf_dir, "inference_results").select(folded(F.col("bank_version")).alias("bank_version"), "matches")
    return knn.top_match_counts(r)


@query("with recursive " + KNN.split("q as (")[0].replace("with ", "", 1) + """l as (select k, list(e order by bank_row) as es, list(bank_row order by bank_row) as ids, greatest(1, round_even(count(*) * 0.1::double, 0)::bigint) as want from b where k is not null group by k),
g(k, step, near, picks) as (select k, 1::bigint, list_transform(es, lambda e: list_distance(e, es[1])), [1::bigint] from l
  union all select x.k, x.step + 1, list_transform(x.near, lambda v, i: least(v, list_distance(l.es[i], l.es[x.p]))), list_append(x.picks, x.p) from (select *, list_position(near, list_max(near))::bigint as p from g) x join l on l.k = x.k where x.step < least(l.want, 20000)),
f as (select k, picks from g qualify row_number() over (partition by k order by step desc) = 1)
select f.k as key, l.ids[i] as bank_row, l.want > 20000 as capped from (select k, unnest(list_distinct(picks)) as i from f) f join l using (k)""")
def coreset_greedy(spark, sf_dir):
    return knn.coreset(_bank(spark, sf_dir), 0.1)


# distance maps: a map a day, a row for each event type, a column for each hour ----------------------------------
_CELLS = """with c as (select ts::date as map, array_position(['click', 'view', 'purchase', 'signup', 'scroll'], event_type) as t, hour(ts)::int as col, value from events),
cells as (select map, coalesce(t, 0)::int as row, col, avg(value) as value from c group by all)
"""
_TYPES = ["click", "view", "purchase", "signup", "scroll"]


def _cells(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.coalesce(*(F.when(F.col("event_type") == t, i + 1) for i, t in enumerate(_TYPES)), F.lit(0))
    return e.groupBy(F.to_date("ts").alias("map"), kind.alias("row"), F.hour("ts").alias("col")).agg(F.avg("value").alias("value"))


_BASE = _CELLS + ", m as (select row, col, median(value) as median, count(*) as n from cells group by all), d as (select c.row, c.col, m.median, m.n, median(abs(c.value - m.median)) as mad from cells c join m using (row, col) group by all)\n"


@query(_BASE + "select row, col, round(median, 4) as median, round(mad, 4) as mad, n from d where n >= 8")
def cell_baseline(spark, sf_dir):
    return grid.cell_baseline(_cells(spark, sf_dir), [], 8).select("row", "col", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), "n")


@query(_BASE + "select c.map, c.row, c.col, round(c.value - d.median, 6) as residual, round((c.value - d.median) / (d.mad + 1e-6), 4) as robust from cells c join d using (row, col)")
def cell_residual(spark, sf_dir):
    c = cut(_cells(spark, sf_dir))
    return grid.residuals(c, grid.cell_baseline(c, []), []).select("map", "row", "col", F.round("residual", 6).alias("residual"), F.round("robust", 4).alias("robust"))


@query(_CELLS + "select map, row, col, round(value, 6) as value from (select *, row_number() over (partition by map order by value desc, row, col) as rn from cells) where rn = 1")
def hottest_cell(spark, sf_dir):
    return grid.hottest_cell(_cells(spark, sf_dir), ["map"]).withColumn("value", F.round("value", 6))


_FAR = "(abs(c.row - {p}.row) >= 3 or abs(c.col - {p}.col) >= 3)"


def _next(place: int, *before: str) -> str:
    joins = " ".join(f"join {p} using (map)" for p in before)
    apart = " and ".join(_FAR.format(p=p) for p in before) or "true"
    return f"h{place} as (select map, row, col from (select c.map, c.row, c.col, row_number() over (partition by c.map order by c.value desc, c.row, c.col) as rn from cells c {joins} where c.value is not null and {apart}) where rn = 1)"


@query(_CELLS.rstrip() + ", " + ", ".join([_next(1), _next(2, "h1"), _next(3, "h1", "h2")]) + " " + " union all ".join(f"select map, {i} as place, row, col from h{i}" for i in (1, 2, 3)))
def hottest_cells(spark, sf_dir):
    return grid.hottest_cells(_cells(spark, sf_dir), ["map"], 3)


_MASK = _CELLS.replace("with c as", "with recursive c as").rstrip() + """, m as (select map, row * 1000 + col as i, row, col from cells where value >= 120),
n(map, i, seen) as (select map, i, i from m union select n.map, n.i, o.i from n join m a on a.map = n.map and a.i = n.seen join m o on o.map = a.map and abs(o.row - a.row) + abs(o.col - a.col) = 1),
r as (select map, i, min(seen) as root from n group by all), s as (select map, root, count(*) as size from r group by all), b as (select map, count(*) as blob_count, max(size) as largest_area, sum(size)::bigint as total_area from s group by map)
select a.map, coalesce(blob_count, 0) as blob_count, coalesce(largest_area, 0) as largest_area, coalesce(total_area, 0) as total_area from (select distinct map from cells) a left join b on b.map is not distinct from a.map"""


@query(_MASK)
def blob_areas(spark, sf_dir):
    return grid.blobs(_cells(spark, sf_dir), ["map"], 120.0)


_UPSAMPLED = _CELLS.replace("with c as", "with recursive c as").rstrip() + """, d as (select map, max(row) as h, max(col) as w from cells group by map),
p as (select d.*, i, j, i * (h / 47.0::double) as y, j * (w / 95.0::double) as x from d, range(48) a(i), range(96) b(j)),
q as (select *, floor(y)::int as r0, least(floor(y)::int + 1, h) as r1, y - floor(y) as fr, floor(x)::int as c0, least(floor(x)::int + 1, w) as c1, x - floor(x) as fc from p),
v as (select q.map, i, j, (coalesce(a.value, 0) * (1 - fc) + coalesce(b.value, 0) * fc) * (1 - fr) + (coalesce(c.value, 0) * (1 - fc) + coalesce(e.value, 0) * fc) * fr as value from q
  left join cells a on a.map = q.map and a.row = r0 and a.col = c0 left join cells b on b.map = q.map and b.row = r0 and b.col = c1 left join cells c on c.map = q.map and c.row = r1 and c.col = c0 left join cells e on e.map = q.map and e.row = r1 and e.col = c1)"""


@query(_UPSAMPLED + """, m as (select map, i * 1000 + j as px, i, j from v where value >= 120),
n(map, px, seen) as (select map, px, px from m union select n.map, n.px, o.px from n join m a on a.map = n.map and a.px = n.seen join m o on o.map = a.map and abs(o.i - a.i) + abs(o.j - a.j) = 1),
r as (select map, px, min(seen) as root from n group by all), s as (select map, root, count(*) as size from r group by all), b as (select map, count(*) as blob_count, max(size) as largest_area, sum(size)::bigint as total_area from s group by map)
select a.map, coalesce(blob_count, 0) as blob_count, coalesce(largest_area, 0) as largest_area, coalesce(total_area, 0) as total_area from (select distinct map from cells) a left join b on b.map is not distinct from a.map""")
def upsampled_areas(spark, sf_dir):
    return grid.blobs(_cells(spark, sf_dir), ["map"], 120.0, scale=(48, 96))


@query(_UPSAMPLED + " select map, count(*) filter (value >= 120) as total_area from v group by map")
def upsampled_totals(spark, sf_dir):
    """Pixels at or above the cutoff of each upsampled map."""
    return grid.blobs(_cells(spark, sf_dir), ["map"], 120.0, scale=(48, 96)).select("map", "total_area")


@query(_CELLS + "select map, greatest(min(row) - 1, 0) as row0, greatest(min(col) - 1, 0) as col0, max(row) + 1 as row1, max(col) + 1 as col1 from cells where value >= 200 group by 1")
def mask_boxes(spark, sf_dir):
    return grid.mask_box(_cells(spark, sf_dir), ["map"], 200.0, 1)


@query(_CELLS + "select map, row, col, round((value - min(value) over w) / (case when max(value) over w > min(value) over w then max(value) over w - min(value) over w else 1 end), 6) as heat from cells window w as (partition by map)")
def heatmap(spark, sf_dir):
    return grid.normalised(_cells(spark, sf_dir), ["map"]).select("map", "row", "col", F.round("heat", 6).alias("heat"))


_SPAN = "least(greatest(0, round_even({i} * {s}::double / {n}, 0)::int - 4), {s} - 1)"
_SPAN2 = "greatest(least({s}, round_even(({i} + 1) * {s}::double / {n}, 0)::int + 4), " + _SPAN + " + 1)"


@query("with m as (select result_id, grid_h, grid_w, unnest(matches) as x from inference_results) select result_id, x.q_index as q_index, " + ", ".join(f"{t.format(i=i, s=512, n=n)} as {a}" for a, t, i, n in (("x0", _SPAN, "x.q_col", "grid_w"), ("y0", _SPAN, "x.q_row", "grid_h"), ("x1", _SPAN2, "x.q_col", "grid_w"), ("y1", _SPAN2, "x.q_row", "grid_h"))) + " from m where x.q_row >= 0 and x.q_row < grid_h and x.q_col >= 0 and x.q_col < grid_w")
def patch_boxes(spark, sf_dir):
    m = table(spark, sf_dir, "inference_results").select("result_id", "grid_h", "grid_w", F.explode("matches").alias("x"))
    b = grid.patch_box(F.col("x.q_row"), F.col("x.q_col"), F.col("grid_h"), F.col("grid_w"), 512, 512, 4)
    return m.select("result_id", "x.q_index", b.alias("b")).where("b is not null").select("result_id", "q_index", "b.*")


# quality ---------------------------------------------------------------------------------------------------------
_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "with long as (select l_linestatus as line, l_suppkey as lot, metric, value from (select l_linestatus, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax from lineitem) unpivot (value for metric in (l_quantity, l_extendedprice, l_discount, l_tax)))\n"
_STATS = _LONG + ", s as (select line, metric, count(*) as n, avg(value) as mean, coalesce(stddev_samp(value), 0) as std, quantile_cont(value, 0.01) as p01, quantile_cont(value, 0.99) as p99 from long group by all)\n"


def _long(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("line"), F.col("l_suppkey").alias("lot"), *_METRICS)
    return quality.long_metrics(li, ["line", "lot"], _METRICS)


@query(_STATS + "select line, metric, n, round(mean, 4) as mean, round(std, 4) as std, round(p01, 4) as p01, round(p99, 4) as p99 from s")
def quality_baseline(spark, sf_dir):
    out = quality.baseline(_long(spark, sf_dir), ["line"])
    return out.select("line", "metric", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "p01", "p99")))


_ASSESS = _STATS + ", a as (select l.line, l.lot, l.metric, count(*) as images, count(*) filter (abs((value - mean) / std) > 1.7) as outliers from long l join s using (line, metric) where std > 0 and value is not null group by all)\n"


def _assessed(spark, sf_dir):
    long = _long(spark, sf_dir)
    return quality.assess(long, quality.baseline(long, ["line"]), ["line", "lot"], 1.7, 0.05, 20)


@query(_ASSESS + "select line, lot, metric, images, outliers, outliers / images as outlier_ratio, outliers / images > 0.05 and images >= 20 as breached from a")
def quality_assess(spark, sf_dir):
    return _assessed(spark, sf_dir)


@query(_ASSESS + "select line, lot, count(*) filter (outliers / images > 0.05 and images >= 20) as breached_metrics, count(*) filter (outliers / images > 0.05 and images >= 20) < 1 as within from a group by all")
def quality_within(spark, sf_dir):
    return quality.within(_assessed(spark, sf_dir), ["line", "lot"])


# threshold curves ------------------------------------------------------------------------------------------------
def _scores(spark, sf_dir):
    truth = to_records(table(spark, sf_dir, "manifest")).where("truth is not null").groupBy("path").agg(F.max((F.col("truth") == "defect").cast("int")).alias("d"))
    r = table(spark, sf_dir, "inference_results").select(folded(F.col("bank_version")).alias("bank_version"), F.col("image").alias("path"), "score").where("bank_version is not null")
    return r.join(truth, "path").select("bank_version", "score", (F.col("d") == 1).alias("defect"))


_SC = REC + f""", t as (select path, max((truth = 'defect')::int) = 1 as defect from rec where truth is not null and path is not null group by 1),
sc as (select {sql_folded("i.bank_version")} as bank_version, i.score, t.defect from inference_results i join t on t.path = i.image where i.bank_version is not null and i.score is not null and i.score::varchar <> 'nan')
"""
_CURVE = _SC + """, th as (select distinct bank_version, score as threshold from sc union select bank_version, max(score) + greatest(1e-9, abs(max(score)) * 1e-6) from sc group by 1),
pts as (select th.bank_version, th.threshold, count(*) filter (defect and score >= threshold) as detected, count(*) filter (defect and score < threshold) as missed, count(*) filter (not defect and score >= threshold) as false_positives, count(*) filter (not defect and score < threshold) as true_negatives from th join sc using (bank_version) group by all),
p as (select *, detected / nullif(detected + missed, 0) as detection_rate, false_positives / nullif(false_positives + true_negatives, 0) as false_positive_rate from pts)
"""


@query(_SC + """, r as (select *, rank() over (partition by bank_version order by score) + (count(*) over (partition by bank_version, score) - 1) / 2 as rk from sc), a as (select bank_version, count(*) filter (defect) as n_pos, count(*) filter (not defect) as n_neg, sum(rk) filter (defect) as rs from r group by 1)
select bank_version, n_pos, n_neg, case when n_pos > 0 and n_neg > 0 then (rs - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) end as auroc from a""")
def auroc(spark, sf_dir):
    return sweep.auroc(_scores(spark, sf_dir), ["bank_version"])


@query(_CURVE + "select * from p")
def threshold_points(spark, sf_dir):
    return sweep.curve(_scores(spark, sf_dir), ["bank_version"])


@query(_CURVE + "select bank_version, max(threshold) as threshold, max_by(detection_rate, threshold) as detection_rate, max_by(false_positive_rate, threshold) as false_positive_rate from p where detection_rate >= 0.9 - 1e-9 group by 1")
def threshold_for_detection(spark, sf_dir):
    return sweep.threshold_for(sweep.curve(_scores(spark, sf_dir), ["bank_version"]), ["bank_version"], 0.9)


_FEAS = _CURVE + """, n as (select bank_version, count(*) filter (defect) as n_pos, count(*) filter (not defect) as n_neg from sc group by 1), k as (select bank_version, max(threshold) as threshold, max_by(false_positive_rate, threshold) as fpr from p where detection_rate >= 1 - 1e-9 group by 1),
f as (select n.bank_version, n_pos, n_neg, case when n_pos >= 3 and n_neg >= 3 then threshold end as threshold, case when n_pos >= 3 and n_neg >= 3 then fpr end as resulting_fpr from n left join k using (bank_version))
"""


@query(_FEAS + "select *, resulting_fpr <= 0.05 as achievable from f")
def feasibility(spark, sf_dir):
    return sweep.feasibility(_scores(spark, sf_dir), ["bank_version"])


@query(_CURVE + """, r as (select *, row_number() over (partition by bank_version order by threshold desc) - 1 as i, count(*) over (partition by bank_version) as n from p)
select bank_version, threshold, detected, missed, false_positives, true_negatives, detection_rate, false_positive_rate from r where n <= 20 or list_contains(list_transform(range(20), lambda j: round_even(j * ((n - 1) / 19.0::double), 0)::bigint), i)""")
def thinned_curve(spark, sf_dir):
    return sweep.thinned(sweep.curve(_scores(spark, sf_dir), ["bank_version"]), ["bank_version"], 20)


_LIMITS = [("detection_rate", ">=", 0.9), ("false_positive_rate", "<=", 0.05)]
_GATE = "with c as (select bank_version, threshold, x.check_name, x.value, x.bound, x.passed from (select bank_version, threshold, unnest([{'check_name': 'detection_rate', 'value': detection_rate, 'bound': 0.9::double, 'passed': coalesce(detection_rate >= 0.9, false)}, {'check_name': 'false_positive_rate', 'value': false_positive_rate, 'bound': 0.05::double, 'passed': coalesce(false_positive_rate <= 0.05, false)}]) as x from (select distinct * from sweep_points)))\n"


def _gate(spark, sf_dir):
    return versions.gate(table(spark, sf_dir, "sweep_points").distinct(), _LIMITS, ["bank_version", "threshold"])


@query(_GATE + "select * from c")
def gate_checks(spark, sf_dir):
    return _gate(spark, sf_dir)


@query(_GATE + "select bank_version, threshold, bool_and(passed) as passed, coalesce(string_agg(check_name, ',' order by check_name) filter (not passed), '') as failures from c group by all")
def gate_results(spark, sf_dir):
    return versions.gate_result(_gate(spark, sf_dir), ["bank_version", "threshold"])


# versions --------------------------------------------------------------------------------------------------------
def _cases(spark, sf_dir):
    r = table(spark, sf_dir, "inference_results").where("score is not null and not isnan(score) and bank_version is not null").select(folded(F.col("bank_version")).alias("bank_version"), "result_id", "score")
    v = lambda t: r.select("bank_version", "result_id", F.when(F.col("score") >= t, "defect").otherwise("pass").alias("verdict"))
    return versions.agreements(v(2.0), v(1.6), ["bank_version", "result_id"])


_CASES = f"with v as (select {sql_folded('bank_version')} as bank_version, result_id, case when score >= 2 then 'defect' else 'pass' end as old_verdict, case when score >= 1.6 then 'defect' else 'pass' end as new_verdict from inference_results where score is not null and score::varchar <> 'nan' and bank_version is not null), c as (select *, case when old_verdict = new_verdict then null when new_verdict = 'defect' then 'newly_detected' else 'newly_missed' end as kind from v)\n"


@query(_CASES + "select * from c where kind is not null")
def shadow_disagreements(spark, sf_dir):
    return _cases(spark, sf_dir).where("kind is not null")


@query(_CASES + "select bank_version, count(*) as total, count(*) filter (kind is null) as agreed, count(*) filter (kind = 'newly_detected') as newly_detected, count(*) filter (kind = 'newly_missed') as newly_missed, count(*) filter (kind is null) / count(*) as agreement_rate from c group by 1")
def shadow_summary(spark, sf_dir):
    return versions.agreement_report(_cases(spark, sf_dir), ["bank_version"])


def _members(spark, sf_dir):
    b = table(spark, sf_dir, "bank_patches").where("source_image is not null and bank_version is not null")
    k = folded(F.col("bank_version"))
    return b.select(F.regexp_replace(k, r"-v\d+$", "").alias("item"), versions.version_number(k).alias("n"), k.alias("version"), F.col("source_image").alias("member"))


_MEM = f"with m as (select distinct regexp_replace(k, '-v\\d+$', '') as item, nullif(regexp_extract(k, 'v(\\d{{1,9}})(?:_.*)?$', 1), '')::int as n, k as version, source_image as member from (select {sql_folded('bank_version')} as k, source_image from bank_patches) where source_image is not null and k is not null)\n"


@query(_MEM + """, a as (select m.item, m.n, count(*) filter (o.member is null) as added, count(*) filter (o.member is not null) as kept from m left join m o on o.item = m.item and o.n = m.n - 1 and o.member = m.member group by all),
r as (select v.item, v.n, count(*) as removed from (select distinct item, n from m) v join m o on o.item = v.item and o.n = v.n - 1 where not exists (select 1 from m x where x.item = v.item and x.n = v.n and x.member = o.member) group by all)
select a.item, a.n, a.added, coalesce(r.removed, 0) as removed, a.kept from a left join r using (item, n)""")
def version_changes(spark, sf_dir):
    return versions.consecutive_changes(_members(spark, sf_dir), ["item"])


@query(_MEM + ", x as (select member, max((version = 'busbar-03-v1')::int) as a, max((version = 'busbar-03-v2')::int) as b from m where version in ('busbar-03-v1', 'busbar-03-v2') group by 1) select case when a = 1 and b = 1 then 'kept' when b = 1 then 'added' else 'removed' end as change, member from x")
def version_diff(spark, sf_dir):
    return versions.version_diff(_members(spark, sf_dir), "busbar-03-v1", "busbar-03-v2")


@query(_MEM + REC.replace("with rec", ", rec", 1) + """, k as (select distinct split_part(item, '-', 1) as object_name, member from m where n = 1), a as (select distinct object_name, path as member from rec where split = 'operation' and truth = 'pass'), d as (select distinct object_name, path as member from rec where truth = 'defect'),
s as (select k.* from k left join d on d.object_name = k.object_name and d.member = k.member where d.member is null)
select object_name, member, 'kept' as origin from s union all select a.object_name, a.member, 'added' from a left join s on s.object_name = a.object_name and s.member = a.member where s.member is null and a.member is not null and a.object_name is not null""")
def rebuild_composition(spark, sf_dir):
    r = to_records(table(spark, sf_dir, "manifest")).where("path is not null and object_name is not null").withColumn("member", F.col("path"))
    kept = _members(spark, sf_dir).where("n = 1").select(F.split("item", "-")[0].alias("object_name"), "member")
    return versions.rebuilt(kept, r.where("split = 'operation' and truth = 'pass'"), r.where("truth = 'defect'"), ["object_name"], "member")


@query(f"with r as (select {sql_plain_lot('lot_id')} as lot, registered_at, withdrawn_at, planned_count from lot_register) select *, case when row_number() over (partition by lot order by withdrawn_at is null desc, registered_at desc, planned_count desc nulls last, withdrawn_at desc) = 1 then 'kept' else 'skipped' end as status from r where lot is not null")
def keep_best(spark, sf_dir):
    r = table(spark, sf_dir, "lot_register").select(plain_lot(F.col("lot_id")).alias("lot"), "registered_at", "withdrawn_at", "planned_count").where("lot is not null")
    return versions.keep_best(r, ["lot"], [F.desc(F.col("withdrawn_at").isNull()), F.desc("registered_at"), F.desc_nulls_last("planned_count"), F.desc("withdrawn_at")])


@query(_MEM + ", v as (select distinct item, n, version from m) select item, version, n, row_number() over (partition by item order by n desc)::int as place, row_number() over (partition by item order by n desc) > 1 and not coalesce(n = 1, false) as pruned from v")
def retention(spark, sf_dir):
    v = _members(spark, sf_dir).select("item", "n", "version").distinct()
    return versions.retention(v, ["item"], [F.desc("n")], 1, F.col("n") == 1).select("item", "version", "n", "place", "pruned")


@query("with d as (select o_custkey, o_orderkey, o_orderdate, (o_orderkey % 7)::int as number from orders), l as (select *, lag(number) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous from d) select o_custkey, o_orderkey, number, previous, coalesce(number < previous, false) as rollback from l")
def rollback_log(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return versions.rollbacks(d, ["o_custkey"], ["o_orderdate", "o_orderkey"], (F.col("o_orderkey") % 7).cast("int")).select("o_custkey", "o_orderkey", "number", "previous", "rollback")


@query("select image, count(*) as runs, count(distinct coalesce(score::varchar, '')) as outcomes, count(distinct coalesce(score::varchar, '')) = 1 and count(*) >= 2 as reproducible from inference_results group by 1")
def reproducibility(spark, sf_dir):
    return versions.reproducible(table(spark, sf_dir, "inference_results"), ["image"], F.col("score"))
