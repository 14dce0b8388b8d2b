"""Registered queries of moving objects, image measurements and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions import filenames
from skylattice.operators import imaging as im
from skylattice.operators import movers as mv
from skylattice.operators import significance as sg
from skylattice.operators.resampling import draw_sql
from skylattice.plans.common import LC_SQL, light_curve, rounded
from skylattice.plans.spatial_queries import CS, DIST, PART, _cs, _plane
from skylattice.registry import Registry, table

R = Registry()
LC = f"WITH {LC_SQL} "
TIMES = [0.0, 5.0, 10.0, 15.0, 20.0]
TSQL = "(VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in TIMES) + ") w(t)"
MOVE = "SELECT s.id, t, mod(ra + 0.3*t/cos(radians(dec)) + 3600, 360) AS ra, dec + 0.1*t AS dec FROM s, " + TSQL


def _objects(spark, d):
    return _cs(spark, d)[1].withColumn("pm_ra", F.lit(0.3)).withColumn("pm_dec", F.lit(0.1)), spark.createDataFrame([(t,) for t in TIMES], "t double")


@R.query("match_moving", f"WITH {CS}, o AS ({MOVE}) SELECT o.id AS obj_id, o.t, c.id AS cat_id, round({DIST.format(a='o.', b='c.')}, 6) AS dist FROM o, c WHERE {DIST.format(a='o.', b='c.')} <= 3.0")
def match_moving(spark, d):
    o, t = _objects(spark, d)
    return rounded(mv.match_moving(o, t, _cs(spark, d)[0], 3.0), "dist")


def _track_sql(name, pm_ra, pm_dec):
    return f"{name} AS (SELECT s.id, t, mod(ra + ({pm_ra})*t/cos(radians(dec)) + 3600, 360) AS ra, dec + ({pm_dec})*t AS dec FROM s, {TSQL})"


@R.query("conjunctions", f"WITH {CS}, {_track_sql('a', 0.3, 0.1)}, {_track_sql('b', -0.6, 0.4)}, p AS (SELECT a.id AS id1, b.id AS id2, a.t, {DIST.format(a='a.', b='b.')} AS dist FROM a JOIN b ON a.t = b.t), w AS (SELECT *, lag(dist) OVER o AS before, lead(dist) OVER o AS after FROM p WINDOW o AS (PARTITION BY id1, id2 ORDER BY t)) SELECT id1, id2, t, round(dist, 6) AS dist FROM w WHERE dist <= 30.0 AND dist < before AND dist < after")
def conjunctions(spark, d):
    o, t = _objects(spark, d)
    p = mv.predicted(o, t)
    q = mv.predicted(o.withColumn("pm_ra", F.lit(-0.6)).withColumn("pm_dec", F.lit(0.4)), t)
    return rounded(mv.conjunctions(p, q, 30.0), "dist")


IMG = "WITH px AS (SELECT l_suppkey % 20 AS r, l_partkey % 20 AS c, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) "


def _image(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("r"), (F.col("l_partkey") % 20).alias("c")).agg(F.sum("l_extendedprice").alias("v"))


@R.query("index_conversion", "SELECT p_partkey, (p_partkey % 7 + 1) AS r, floor(p_partkey/7)::BIGINT + 1 AS c, p_partkey + 1 AS back FROM part")
def index_conversion(spark, d):
    r, c = im.subscripts(F.col("p_partkey") + 1, 7)
    return table(spark, d, "part").select("p_partkey", r.alias("r"), c.alias("c")).withColumn("back", im.linear_index(F.col("r"), F.col("c"), 7))


@R.query("tile_overlap", IMG + ", t AS (SELECT r, c, v, tr, tc FROM px, (SELECT unnest(range(0, 3)) AS tr), (SELECT unnest(range(0, 3)) AS tc) WHERE r >= tr*8 AND r < tr*8+10 AND c >= tc*8 AND c < tc*8+10) SELECT tr, tc, round(median(v), 2) AS back, count(*) AS n FROM t GROUP BY tr, tc")
def tile_overlap(spark, d):
    return im.tile_background(_image(spark, d), 10, 2).select("tr", "tc", F.round("back", 2).alias("back"), "n")


@R.query("find_sources", IMG + ", b AS (SELECT floor(r/10) AS tr, floor(c/10) AS tc, median(v) AS m, (quantile_cont(v, 0.75)-quantile_cont(v, 0.25))/2*1.4826 AS s FROM px GROUP BY 1, 2), f AS (SELECT r, c, v-m AS v, (v-m)/s AS sn FROM px JOIN b ON floor(r/10) = tr AND floor(c/10) = tc) SELECT a.r, a.c, round(a.sn, 6) AS sn FROM f a JOIN f b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) WHERE a.sn >= 0.5 GROUP BY a.r, a.c, a.v, a.sn HAVING a.v > max(b.v)")
def find_sources(spark, d):
    return im.find_sources(_image(spark, d), 10, 0.5).select("r", "c", F.round("sn", 6).alias("sn"))


@R.query("aperture_moments", IMG + ", s AS (SELECT n_nationkey AS src, n_nationkey % 20 AS sr, n_nationkey*3 % 20 AS sc FROM nation), p AS (SELECT src, v, r-sr AS y, c-sc AS x FROM s JOIN px ON abs(r-sr) <= 2 AND abs(c-sc) <= 2) SELECT src, round(sum(v), 3) AS flux, round(sum(v*x)/sum(v), 6) AS dx, round(sum(v*y)/sum(v), 6) AS dy, round(sum(v*x*x)/sum(v) - pow(sum(v*x)/sum(v), 2), 6) AS var_x FROM p GROUP BY src")
def aperture_moments(spark, d):
    k = F.col("n_nationkey")
    src = table(spark, d, "nation").select(k.alias("src"), (k % 20).alias("sr"), (k * 3 % 20).alias("sc"))
    m = im.moments(_image(spark, d), src, 2)
    return m.select("src", F.round("flux", 3).alias("flux"), F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), F.round("var_x", 6).alias("var_x"))


@R.query("variance_propagation", "SELECT p_partkey, round(p_size*p_retailprice, 4) AS product, round(0.04*p_retailprice*p_retailprice + 9.0*p_size*p_size, 3) AS product_var, round(p_size/p_retailprice, 9) AS ratio FROM part")
def variance_propagation(spark, d):
    a, b = F.col("p_size").cast("double"), F.col("p_retailprice")
    p, v = im.propagate("*", a, b, F.lit(0.04), F.lit(9.0))
    q, _ = im.propagate("/", a, b, F.lit(0.04), F.lit(9.0))
    return table(spark, d, "part").select("p_partkey", F.round(p, 4).alias("product"), F.round(v, 3).alias("product_var"), F.round(q, 9).alias("ratio"))


@R.query("bounding_circle", f"WITH t AS (SELECT {PART} FROM part), b AS (SELECT (max(x)+min(x))/2 AS cx, (max(y)+min(y))/2 AS cy FROM t) SELECT cx, cy, round(sqrt(max(pow(x-cx,2)+pow(y-cy,2))), 6) AS radius FROM t, b GROUP BY cx, cy")
def bounding_circle(spark, d):
    return rounded(im.bounding_circle(_plane(spark, d), "x", "y"), "radius")


@R.query("collapse_stat", IMG + "SELECT r, round(sum(v), 2) AS total, round(avg(v), 4) AS mean, round(median(v), 4) AS median FROM px GROUP BY r")
def collapse_stat(spark, d):
    return im.collapse(_image(spark, d), "r").select("r", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


@R.query("overdense_rows", "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), s AS (SELECT median(n) AS m, greatest(0.5, (quantile_cont(n::DOUBLE, 0.75)-quantile_cont(n::DOUBLE, 0.25))/2*1.4826) AS s FROM c) SELECT p_size, n, n > m + 1.1*s AS overdense FROM c, s")
def overdense_rows(spark, d):
    return im.dense_rows(table(spark, d, "part"), "p_size", 1.1)


@R.query("brightest_per_cell", f"SELECT id FROM (SELECT p_partkey AS id, p_retailprice AS mag, {PART} FROM part) QUALIFY row_number() OVER (PARTITION BY floor(x/20), floor(y/20) ORDER BY mag, id) <= 5")
def brightest_per_cell(spark, d):
    p = _plane(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("mag")), "id")
    return im.brightest_per_cell(p, "x", "y", "mag", "id", 20.0, 5).select("id")


@R.query("weighted_sigma_clip", LC + ", a AS (SELECT source, flux, v FROM (SELECT source, flux, err*err AS v FROM lc) JOIN (SELECT source, sum(flux/(err*err))/sum(1/(err*err)) AS m, stddev_samp(flux) AS s FROM lc GROUP BY source) USING (source) WHERE abs(flux-m) <= 1.5*s) SELECT source, round(sum(flux/v)/sum(1/v), 3) AS mean, count(*) AS n_good FROM a GROUP BY source")
def weighted_sigma_clip(spark, d):
    lc = light_curve(spark, d).withColumn("v", F.col("err") * F.col("err"))
    return sg.weighted_sigma_clip(lc, "flux", "v", ["source"], 1.5, 1).select("source", F.round("mean", 3).alias("mean"), "n_good")


@R.query("adaptive_bins", LC + "SELECT source, bin, min(flux) AS lo, max(flux) AS hi, count(*) AS n FROM (SELECT source, flux, floor((row_number() OVER (PARTITION BY source ORDER BY flux)-1)/50)::BIGINT AS bin FROM lc) GROUP BY source, bin")
def adaptive_bins(spark, d):
    return sg.adaptive_bins(light_curve(spark, d), "flux", ["source"], 50)


@R.query("log_mode", "WITH c AS (SELECT floor(ln(l_extendedprice)/0.2) AS b, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1) SELECT round(exp((arg_min(b, (-n, b))+0.5)*0.2), 6) AS mode FROM c")
def log_mode(spark, d):
    return rounded(sg.log_mode(table(spark, d, "lineitem"), "l_extendedprice", 0.2), "mode")


@R.query("correlation_significance")
def correlation_significance(spark, d):
    return sg.correlation_significance(table(spark, d, "customer"), "c_custkey", "c_nationkey", "c_acctbal", 40)


@R.query("error_ensemble", f"SELECT s_suppkey, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM (SELECT s_suppkey, ln(abs(s_acctbal) + 10 + sqrt(-2*ln({draw_sql('s_suppkey', 'sim', 1)}))*cos(6.283185307179586*({draw_sql('s_suppkey', 'sim', 2)}))) AS v FROM supplier, (SELECT unnest(range(1, 101)) AS sim)) GROUP BY s_suppkey")
def error_ensemble(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.abs("s_acctbal") + 10).alias("v"), F.lit(1.0).alias("e"))
    return rounded(sg.error_ensemble(s, "s_suppkey", "v", "e", F.log, 100), "mean", "std")


@R.query("file_name_fields", "SELECT s_suppkey, 'SKY' AS project, s_suppkey::VARCHAR AS counter, 'SKY_t_r_f_' || s_suppkey || '_1_c_sci_raw_Image_1.fits' AS name FROM supplier")
def file_name_fields(spark, d):
    n = filenames.compose(F.lit("SKY"), F.lit("t"), F.lit("r"), F.lit("f"), F.col("s_suppkey").cast("string"), F.lit("1"), F.lit("c"), F.lit("sci"), F.lit("raw"), F.lit("Image"), F.lit("1"))
    d2 = table(spark, d, "supplier").select("s_suppkey", n.alias("name"))
    return d2.select("s_suppkey", filenames.field(F.col("name"), "project").alias("project"), filenames.field(F.col("name"), "counter").alias("counter"), "name")


@R.query("rotation_scale")
def rotation_scale(spark, d):
    import math

    from skylattice.operators.registration import rotation_and_scale

    a = _plane(spark, d)
    c, s, k = math.cos(math.radians(30)), math.sin(math.radians(30)), 1.2
    b = a.select("id", (k * (c * F.col("x") - s * F.col("y"))).alias("x"), (k * (s * F.col("x") + c * F.col("y"))).alias("y"))
    return rounded(rotation_and_scale(a, b, 10.0), "angle", "scale")


@R.query("indicator_design", LC + "SELECT id, 'zp_' || floor(t/365)::BIGINT AS column, 1.0::DOUBLE AS h FROM lc UNION ALL SELECT id, 'mean_' || source, 1.0 FROM lc")
def indicator_design(spark, d):
    from skylattice.operators.catalogs import indicator_design as design

    return design(light_curve(spark, d).withColumn("e", F.floor(F.col("t") / 365)), "id", "source", "e")


@R.query("lag_correlation", LC + ", m AS (SELECT source, floor(t/30) AS e, avg(flux) AS a, avg(err) AS b FROM lc GROUP BY 1, 2), c AS (SELECT source, e, a - avg(a) OVER s AS a, b - avg(b) OVER s AS b, row_number() OVER (PARTITION BY source ORDER BY e) AS i FROM m WINDOW s AS (PARTITION BY source)), n AS (SELECT source, sqrt(sum(a*a)*sum(b*b)) AS norm, count(*) AS k FROM c GROUP BY source), g AS (SELECT source, norm, unnest(range(-least(5, k-1), least(5, k-1)+1)) AS lag FROM n) SELECT g.source, g.lag, round(coalesce(sum(x.a*y.b), 0)/any_value(norm), 6) AS corr FROM g LEFT JOIN c x ON x.source = g.source LEFT JOIN c y ON y.source = g.source AND y.i = x.i + g.lag GROUP BY g.source, g.lag")
def lag_correlation(spark, d):
    from skylattice.operators.models import lag_correlation as lags

    m = light_curve(spark, d).groupBy("source", F.floor(F.col("t") / 30).alias("e")).agg(F.avg("flux").alias("a"), F.avg("err").alias("b"))
    return rounded(lags(m, "source", "e", "a", "b", 5), "corr")


@R.query("cadence_weight", "SELECT c_custkey, round(CASE WHEN w < 0.7 THEN 1.1/(1+exp(-(w-0.7)/0.5)) ELSE 1.0+(1.1-1.0)*exp(-(w-0.7)/2.0) END, 9) AS weight FROM (SELECT c_custkey, abs(c_acctbal)/1000 AS w FROM customer)")
def cadence_weight(spark, d):
    from skylattice.functions.schedule import cadence_weight as weight

    return table(spark, d, "customer").select("c_custkey", F.round(weight(F.abs("c_acctbal") / 1000), 9).alias("weight"))
