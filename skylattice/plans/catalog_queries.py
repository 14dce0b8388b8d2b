"""Registered queries of matched catalogs, selections, bins and fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.functions import sphere
from skylattice.operators import catalogs as ca
from skylattice.operators import imaging as im
from skylattice.operators import models as mo
from skylattice.operators import transforms as tf
from skylattice.operators import spatial as sp
from skylattice.plans.common import LC_SQL, day, light_curve, rounded
from skylattice.plans.series_queries import MAG, _mags
from skylattice.plans.spatial_queries import CS, DIST, PAIRS, PART, _cs, _plane
from skylattice.registry import Registry, table

R = Registry()
LC = f"WITH {LC_SQL} "


@R.query("light_curve_of_source", LC + "SELECT id, t, flux FROM lc WHERE source IN (3, 7) ORDER BY source, t, id")
def light_curve_of_source(spark, d):
    return light_curve(spark, d).where(F.col("source").isin(3, 7)).orderBy("source", "t", "id").select("id", "t", "flux")


@R.query("not_nan_epochs", MAG + "SELECT e, bool_and(mag < 11.9) AS complete, count(*) AS n FROM m GROUP BY e")
def not_nan_epochs(spark, d):
    return _mags(spark, d).groupBy("e").agg(F.bool_and(F.col("mag") < 11.9).alias("complete"), F.count("*").alias("n"))


@R.query("design_matrix", LC + "SELECT id, 1.0::DOUBLE AS h0, t AS h1, t*t AS h2, flux AS y FROM lc")
def design_matrix(spark, d):
    return ca.design_matrix(light_curve(spark, d), "id", [F.lit(1.0), F.col("t"), F.col("t") * F.col("t")], "flux")


@R.query("column_summary", "SELECT 'p_size' AS name, count(p_size) AS n, avg(p_size) AS mean, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part UNION ALL SELECT 'p_retailprice', count(p_retailprice), round(avg(p_retailprice), 8), min(p_retailprice), max(p_retailprice) FROM part")
def column_summary(spark, d):
    return ca.summary(table(spark, d, "part"), ["p_size", "p_retailprice"]).withColumn("mean", F.round("mean", 8))


@R.query("keyed_insert", "SELECT s_name, 'K' || s_suppkey AS rec FROM supplier")
def keyed_insert(spark, d):
    return ca.with_key(table(spark, d, "supplier"), "rec", F.concat(F.lit("K"), F.col("s_suppkey").cast("string"))).select("s_name", "rec")


@R.query("array_round_trip", "SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part")
def array_round_trip(spark, d):
    return ca.from_array(ca.to_array(table(spark, d, "part"), ["p_size", "p_retailprice"], ["p_partkey"]), ["a", "b"], ["p_partkey"])


@R.query("cone_in_many_tables", f"WITH {CS}, z AS (SELECT 60.0 AS ra, -10.0 AS dec) SELECT 'customer' AS src, c.id FROM c, z WHERE {DIST.format(a='c.', b='z.')} <= 14.0 UNION ALL SELECT 'supplier', s.id FROM s, z WHERE {DIST.format(a='s.', b='z.')} <= 14.0")
def cone_in_many_tables(spark, d):
    c, s = _cs(spark, d)
    every = c.withColumn("src", F.lit("customer")).unionByName(s.withColumn("src", F.lit("supplier")))
    return sp.cone(every, 60.0, -10.0, 14.0).select("src", "id")


@R.query("merge_catalogs", LC + "SELECT source, round(avg(f), 5) AS mean, round(median(f), 5) AS median, count(*) AS n_obs, round(max(f)-min(f), 5) AS range FROM (SELECT source, floor(t/90) AS e, avg(flux) AS f FROM lc GROUP BY 1, 2) GROUP BY source")
def merge_catalogs(spark, d):
    e = light_curve(spark, d).groupBy("source", F.floor(F.col("t") / 90).alias("e")).agg(F.avg("flux").alias("f"))
    return rounded(e.groupBy("source").agg(F.avg("f").alias("mean"), F.median("f").alias("median"), F.count("*").alias("n_obs"), (F.max("f") - F.min("f")).alias("range")), "mean", "median", "range", digits=5)


@R.query("match_residuals", f"WITH t AS (SELECT p_partkey AS id, {PART}, p_size FROM part), p AS (SELECT a.id AS probe_id, b.id AS cat_id, sqrt(pow(a.x-b.x-0.2,2)+pow(a.y-b.y+0.3,2)) AS dist, b.x-(a.x-0.2) AS dx, b.y-(a.y+0.3) AS dy FROM t a, t b), n AS (SELECT probe_id, arg_min(dx, (dist, cat_id)) AS dx, arg_min(dy, (dist, cat_id)) AS dy FROM p WHERE dist <= 1.03 GROUP BY probe_id) SELECT count(*) AS n, round(avg(dx), 5) AS mean_dx, round(avg(dy), 5) AS mean_dy, round(stddev_samp(dx), 5) AS std_dx FROM n")
def match_residuals(spark, d):
    b = _plane(spark, d)
    a = b.withColumn("x", F.col("x") - 0.2).withColumn("y", F.col("y") + 0.3)
    return rounded(ca.residuals(a, b, 1.03), "mean_dx", "mean_dy", "std_dx", digits=5)


@R.query("external_orphans", PAIRS + "SELECT id FROM c WHERE id NOT IN (SELECT probe_id FROM p WHERE dist <= 3.0)")
def external_orphans(spark, d):
    c, s = _cs(spark, d)
    return sp.unmatched(c, sp.matched(c, s, 3.0), "probe_id").select("id")


@R.query("half_space", f"WITH {CS} SELECT id FROM c WHERE 0.6*cos(radians(dec))*cos(radians(ra)) - 0.64*cos(radians(dec))*sin(radians(ra)) + 0.48*sin(radians(dec)) > 0.3001")
def half_space(spark, d):
    x, y, z = sphere.unit_vector(F.radians("ra"), F.radians("dec"))
    return _cs(spark, d)[0].where(0.6 * x - 0.64 * y + 0.48 * z > 0.3001).select("id")


@R.query("sky_tile", f"WITH {CS} SELECT id, floor((dec+90)/10.0)::BIGINT AS row_no, floor(ra/(360.0/greatest(1, floor(36*cos(radians(abs(floor((dec+90)/10.0)*10-85)))))))::BIGINT AS tile FROM c")
def sky_tile(spark, d):
    row, tile = ca.sky_tile(F.col("ra"), F.col("dec"), 10.0)
    return _cs(spark, d)[0].select("id", row.alias("row_no"), tile.alias("tile"))


@R.query("rect_overlap", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT n_nationkey, n_nationkey*3.0 AS lo, n_nationkey*3.0+5.5 AS hi FROM nation) a, (SELECT n_nationkey, n_nationkey*7.0 AS lo, n_nationkey*7.0+2.2 AS hi FROM nation) b WHERE a.lo <= b.hi AND b.lo <= a.hi")
def rect_overlap(spark, d):
    n = table(spark, d, "nation")
    box = lambda k, w, name: n.select(F.col("n_nationkey").alias(name), (F.col("n_nationkey") * k).alias(f"{name}_lo"), (F.col("n_nationkey") * k + w).alias(f"{name}_hi"))
    return ca.overlaps(box(3.0, 5.5, "a"), box(7.0, 2.2, "b"), "a", "b", 10.0)


@R.query("nearest_in_time", "SELECT o_custkey, arg_min(o_orderkey, (abs(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1996-01-01')), o_orderkey)) AS near FROM orders GROUP BY o_custkey")
def nearest_in_time(spark, d):
    gap = F.abs(F.unix_micros(F.col("o_orderdate").cast("timestamp")) - F.unix_micros(F.lit("1996-01-01").cast("timestamp")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(gap, F.col("o_orderkey"))).alias("near"))


@R.query("dilute_by_mag", "SELECT p_partkey FROM part WHERE p_retailprice < (SELECT quantile_cont(p_retailprice, 0.25) FROM part)")
def dilute_by_mag(spark, d):
    return ca.dilute(table(spark, d, "part"), "p_retailprice", 4.0, 1.0).select("p_partkey")


@R.query("array_select", "SELECT p_partkey FROM part WHERE (p_size > 10 AND p_size < 20) OR (p_retailprice > 1200 AND p_retailprice < 1300)")
def array_select(spark, d):
    return ca.strict_ranges(table(spark, d, "part"), {"p_size": (10, 20), "p_retailprice": (1200, 1300)}, every=False).select("p_partkey")


@R.query("find_many", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def find_many(spark, d):
    o, s = table(spark, d, "orders"), table(spark, d, "supplier")
    return o.join(s, o["o_custkey"] == s["s_suppkey"], "left_semi").select("o_orderkey")


@R.query("confidence_limits", LC + "SELECT source, round(quantile_cont(flux, 0.16), 4) AS lo, round(quantile_cont(flux, 0.84), 4) AS hi FROM lc GROUP BY source")
def confidence_limits(spark, d):
    p = F.percentile("flux", F.array(F.lit(0.16), F.lit(0.84)))
    return light_curve(spark, d).groupBy("source").agg(p.alias("p")).select("source", F.round(F.col("p")[0], 4).alias("lo"), F.round(F.col("p")[1], 4).alias("hi"))


@R.query("mode_density", LC + ", w AS (SELECT source, flux, lead(flux, 5) OVER (PARTITION BY source ORDER BY flux) AS up FROM lc) SELECT source, round(arg_min((flux+up)/2, (up-flux, flux)), 5) AS mode FROM w WHERE up IS NOT NULL GROUP BY source")
def mode_density(spark, d):
    return rounded(ca.mode_density(light_curve(spark, d), "flux", ["source"], 5), "mode", digits=5)


@R.query("all_cuts", "SELECT p_size::BIGINT AS a, p_partkey % 5 AS b, NULL::BIGINT AS c, min(p_retailprice) AS best FROM part GROUP BY 1, 2 UNION ALL SELECT p_size, NULL, p_partkey % 7, min(p_retailprice) FROM part GROUP BY 1, 3 UNION ALL SELECT NULL, p_partkey % 5, p_partkey % 7, min(p_retailprice) FROM part GROUP BY 2, 3")
def all_cuts(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").cast("bigint").alias("a"), (F.col("p_partkey") % 5).alias("b"), (F.col("p_partkey") % 7).alias("c"), F.col("p_retailprice").alias("v"))
    return ca.all_cuts(p, ["a", "b", "c"], F.min("v").alias("best"))


@R.query("histogram", "SELECT bin, count(*) AS n, count(*)/(SELECT count(*) FROM part WHERE p_retailprice > 900 AND p_retailprice <= 1900) AS share FROM (SELECT ceil((p_retailprice-900)/50.0)::BIGINT AS bin FROM part WHERE p_retailprice > 900 AND p_retailprice <= 1900) GROUP BY bin")
def histogram(spark, d):
    return ca.histogram(table(spark, d, "part"), "p_retailprice", 900.0, 1900.0, 50.0)


@R.query("assoc_range", "SELECT p_partkey, CASE WHEN p_size > 1 AND p_size <= 5 THEN 1 WHEN p_size > 5 AND p_size <= 20 THEN 2 WHEN p_size > 20 AND p_size <= 45 THEN 3 END AS bin FROM part")
def assoc_range(spark, d):
    return table(spark, d, "part").select("p_partkey", ca.edge_bin(F.col("p_size"), [1, 5, 20, 45]).alias("bin"))


@R.query("bad_images", "WITH s AS (SELECT l_linenumber AS img, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd, count(*) AS n FROM lineitem GROUP BY 1) SELECT img, (n < 0.5*(SELECT median(n) FROM s)) AS bad FROM s")
def bad_images(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("img")).agg(F.count("*").alias("n"))
    return s.join(F.broadcast(s.agg(F.median("n").alias("med")))).select("img", (F.col("n") < 0.5 * F.col("med")).alias("bad"))


@R.query("select_maxima", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 1000 ORDER BY s_acctbal DESC, s_suppkey LIMIT 5")
def select_maxima(spark, d):
    return table(spark, d, "supplier").where("s_acctbal > 1000").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5).select("s_suppkey", "s_acctbal")


@R.query("split_sections", LC + ", g AS (SELECT source, t, id, coalesce((t - lag(t) OVER w > 10)::INT, 0) AS new FROM lc WINDOW w AS (PARTITION BY source ORDER BY t, id)), k AS (SELECT source, t, sum(new) OVER (PARTITION BY source ORDER BY t, id) AS grp FROM g) SELECT source, min(t) AS t_start, max(t) AS t_end, count(*) AS n FROM k GROUP BY source, grp HAVING count(*) >= 10 AND max(t)-min(t) >= 100")
def split_sections(spark, d):
    from skylattice.operators.sequence import time_gap_groups

    g = time_gap_groups(light_curve(spark, d), "t", ["source"], 10.0, 10, "id")
    return g.where(F.col("t_end") - F.col("t_start") >= 100).select("source", "t_start", "t_end", "n")


@R.query("kernel_mean", LC + "SELECT a.id, round(sum(b.flux*(1-abs(b.t-a.t)/20.0))/sum(1-abs(b.t-a.t)/20.0), 7) AS smooth FROM lc a JOIN lc b ON a.source = b.source AND abs(b.t-a.t) < 20.0 GROUP BY a.id")
def kernel_mean(spark, d):
    return rounded(ca.kernel_mean(light_curve(spark, d), "id", "t", "flux", ["source"], 20.0), "smooth", digits=7)


@R.query("integral_percentile", LC + ", w AS (SELECT source, t, flux, sum(flux) OVER (PARTITION BY source ORDER BY t, id)/sum(flux) OVER (PARTITION BY source) AS c FROM lc) SELECT source, min(t) FILTER (c >= 0.05) AS left_limit, min(t) FILTER (c >= 0.95) AS right_limit FROM w GROUP BY source")
def integral_percentile(spark, d):
    return ca.integral_limits(light_curve(spark, d), "t", "flux", ["source"], 0.9, ["id"])


@R.query("trapz_error", LC + "SELECT source, round(sqrt(coalesce(sum(pow(dt/2, 2)*(err*err + err2*err2)), 0)), 3) AS int_err FROM (SELECT source, lead(t) OVER w - t AS dt, err, lead(err) OVER w AS err2 FROM lc WINDOW w AS (PARTITION BY source ORDER BY t, id)) GROUP BY source")
def trapz_error(spark, d):
    return rounded(ca.trapezoid_error(light_curve(spark, d), "t", "err", ["source"], ["id"]), "int_err", digits=3)


@R.query("external_sigma_clip", LC + "SELECT id FROM lc JOIN (SELECT source, avg(err) AS m, stddev_samp(err) AS s FROM lc GROUP BY source) USING (source) WHERE abs(err-m) <= 1.7*s")
def external_sigma_clip(spark, d):
    return ca.clip_by(light_curve(spark, d), ["err"], ["source"], 1.7).select("id")


@R.query("zp_external", MAG + "SELECT m.e, round(median(m.mag - x.ref), 6) AS zp FROM m JOIN (SELECT source, median(mag) AS ref FROM m GROUP BY source) x USING (source) GROUP BY m.e")
def zp_external(spark, d):
    m = _mags(spark, d)
    ref = m.groupBy("source").agg(F.median("mag").alias("ref"))
    return rounded(m.join(ref, "source").groupBy("e").agg(F.median(F.col("mag") - F.col("ref")).alias("zp")), "zp")


@R.query("zp_sum_flux", MAG + "SELECT e, round(-2.5*log10(sum(pow(10, -0.4*mag))/count(*)), 6) AS zp FROM m GROUP BY e")
def zp_sum_flux(spark, d):
    return _mags(spark, d).groupBy("e").agg(F.round(-2.5 * F.log10(F.sum(F.pow(F.lit(10.0), -0.4 * F.col("mag"))) / F.count("*")), 6).alias("zp"))


@R.query("poisson_period", LC + ", f AS (SELECT source, count(*) AS n, sum(cos(2*pi()*t/30)) AS c, sum(sin(2*pi()*t/30)) AS s FROM lc GROUP BY source) SELECT source, round((c*c+s*s)/n, 6) AS power FROM f")
def poisson_period(spark, d):
    a = 2 * 3.141592653589793 * F.col("t") / 30
    f = light_curve(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.cos(a)).alias("c"), F.sum(F.sin(a)).alias("s"))
    return f.select("source", F.round((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n"), 6).alias("power"))


@R.query("residual_flags", MAG + ", r AS (SELECT source, e, mag - avg(mag) OVER (PARTITION BY source) AS r, ceil(mag*10)::BIGINT AS b FROM m), s AS (SELECT b, median(r) AS med, (quantile_cont(r, 0.75)-quantile_cont(r, 0.25))/2*1.4826 AS sd FROM r GROUP BY b) SELECT source, e, abs(r-med) > 3*greatest(sd, 0.001) AS outlier FROM r JOIN s USING (b)")
def residual_flags(spark, d):
    return ca.residual_outliers(_mags(spark, d), "source", "mag", 0.1, 3.0).select("source", "e", "outlier")


@R.query("order_history", "SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY o_custkey HAVING count(*) > 5")
def order_history(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date")).where("n > 5")


@R.query("continuous_longitude", f"WITH {CS}, g AS (SELECT id, id % 200 AS k, radians(mod(ra, 40) + CASE WHEN id % 3 = 0 THEN 320 ELSE 0 END) AS lon FROM c), w AS (SELECT *, min(lon) OVER p < pi()/2 AND max(lon) OVER p > 3*pi()/2 AS x, avg(lon) OVER p > pi() AS up FROM g WINDOW p AS (PARTITION BY k)) SELECT id, round(CASE WHEN x AND up AND lon < pi() THEN lon + 2*pi() WHEN x AND NOT up AND lon > pi() THEN lon - 2*pi() ELSE lon END, 6) AS lon FROM w")
def continuous_longitude(spark, d):
    from skylattice.operators.sequence import continuous_longitude as fix

    c = _cs(spark, d)[0]
    g = c.select("id", (F.col("id") % 200).alias("k"), F.radians(F.pmod(F.col("ra"), F.lit(40.0)) + F.when(F.col("id") % 3 == 0, 320.0).otherwise(0.0)).alias("lon"))
    return g.select("id", F.round(fix("lon", Window.partitionBy("k")), 6).alias("lon"))


@R.query("running_z", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w)/nullif(stddev_samp(o_totalprice) OVER w, 0), 5) AS z FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def running_z(spark, d):
    from skylattice.operators.sequence import running_z as z

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(z("o_totalprice", 3, w), 5).alias("z"))


# fits

#: Orthogonal parabola about the mean time: p2 = u^2 - a u - b.
FIT = LC + ", k AS (SELECT source, avg(t) AS tm, avg(flux) AS vm, count(*) AS n FROM lc GROUP BY source), u AS (SELECT source, n, vm, t-tm AS u, flux-vm AS y FROM lc JOIN k USING (source)), s AS (SELECT source, any_value(n) AS n, any_value(vm) AS vm, sum(u*u) AS s2, sum(u*u*u)/sum(u*u) AS a, sum(u*u)/any_value(n) AS b, sum(u*y)/sum(u*u) AS l, sum(y*y) AS yy FROM u GROUP BY source), q AS (SELECT source, sum((u*u-a*u-b)*y) AS qy, sum(pow(u*u-a*u-b, 2)) AS qq FROM u JOIN s USING (source) GROUP BY source) "


@R.query("poly_fit", FIT + "SELECT source, round(qy/qq, 6) AS c2, round(l - a*qy/qq, 4) AS c1, round(vm - b*qy/qq, 2) AS c0, round((yy - l*l*s2 - qy*qy/qq)/1e9, 4) AS chi2, n FROM s JOIN q USING (source)")
def poly_fit(spark, d):
    p, c = mo.polynomial(light_curve(spark, d), "source", "t", "flux", 2), F.col("coef")
    return p.select("source", F.round(c[0], 6).alias("c2"), F.round(c[1], 4).alias("c1"), F.round(c[2], 2).alias("c0"), F.round(F.col("chi2") / 1e9, 4).alias("chi2"), "n")


@R.query("poly_hypothesis", FIT + "SELECT source, degree, round(CASE degree WHEN 0 THEN 0 WHEN 1 THEN l*l*s2 ELSE l*l*s2 + qy*qy/qq END/1e6, 4) AS d_chi2 FROM s JOIN q USING (source), (SELECT unnest(range(0, 3)) AS degree)")
def poly_hypothesis(spark, d):
    return rounded(mo.polynomial_hypothesis(light_curve(spark, d), "source", "t", "flux", 1000.0), "d_chi2", digits=4)


# fits that SQL cannot say: tests compare them with numpy

@R.query("harmonic_fit")
def harmonic_fit(spark, d):
    return mo.harmonics(light_curve(spark, d), "source", "t", "flux", 0.05)


@R.query("fft_power", LC + ", n AS (SELECT source, flux - avg(flux) OVER s AS y, row_number() OVER (PARTITION BY source ORDER BY t, flux) - 1 AS i, count(*) OVER s AS n, coalesce(nullif((max(t) OVER s - min(t) OVER s)/nullif(count(*) OVER s - 1, 0), 0), 1.0) AS step FROM lc WINDOW s AS (PARTITION BY source)), k AS (SELECT source, n, step, unnest(range(0, n//2 + 1)) AS k FROM (SELECT DISTINCT source, n, step FROM n)) SELECT source, round(k/(any_value(k.n)*any_value(k.step)), 9) AS freq, round((pow(sum(y*cos(2*pi()*((k*i) % k.n)/k.n)), 2) + pow(sum(y*sin(2*pi()*((k*i) % k.n)/k.n)), 2))/any_value(k.n)/1e6, 4) AS power FROM k JOIN n USING (source) GROUP BY source, k")
def fft_power(spark, d):
    p = tf.power(light_curve(spark, d), "source", "t", "flux")
    return p.select("source", F.round("freq", 9).alias("freq"), F.round(F.col("power") / 1e6, 4).alias("power"))


@R.query("gp_interpolation")
def gp_interpolation(spark, d):
    m = _mags(spark, d).withColumn("e", F.col("e").cast("double"))
    lo, hi = m.agg(F.min("e"), F.max("e")).first()
    grid = [] if lo is None else [lo + k + 0.5 for k in range(int(hi - lo))] or [lo]
    return mo.gaussian_process(m, "source", "e", "mag", grid, 1.5, 0.05)


@R.query("savitzky_golay", LC + ", j AS (SELECT a.source, a.t AS ta, (b.t-a.t)/30.0 AS u, b.flux AS y, b.t FROM (SELECT DISTINCT source, t FROM lc) a JOIN lc b ON a.source = b.source AND abs(b.t-a.t) <= 30.0), m AS (SELECT source, ta, count(*)::DOUBLE AS s0, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(y) AS y0, sum(u*y) AS y1, sum(u*u*y) AS y2, count(DISTINCT t) AS k FROM j GROUP BY source, ta), f AS (SELECT source, ta, CASE WHEN k > 2 THEN (y0*(s2*s4-s3*s3)-y1*(s1*s4-s2*s3)+y2*(s1*s3-s2*s2))/(s0*(s2*s4-s3*s3)-s1*(s1*s4-s2*s3)+s2*(s1*s3-s2*s2)) WHEN k = 2 THEN (s2*y0-s1*y1)/(s0*s2-s1*s1) ELSE y0/s0 END AS smooth FROM m) SELECT lc.source, lc.t, round(smooth, 2) AS smooth FROM lc JOIN f ON f.source = lc.source AND f.ta = lc.t")
def savitzky_golay(spark, d):
    return rounded(mo.savitzky_golay(light_curve(spark, d), "source", "t", "flux", 60.0), "smooth", digits=2)


RANSAC_SQL = LC + """, d AS (SELECT source, id, t, flux, (id % 2147483647 * 48271 + 1) % 2147483647 AS x FROM lc),
h AS (SELECT *, x*x % 2147483647 AS h, count(*) OVER (PARTITION BY source) AS n FROM d),
s AS (SELECT source, t, flux, row_number() OVER (PARTITION BY source ORDER BY h, id, t, flux) AS r FROM h WHERE h / 2147483647 <= 102.0::DOUBLE / n QUALIFY r <= 51),
l AS (SELECT a.source, a.r + b.r AS line, a.t AS t0, a.flux AS y0, (b.flux - a.flux)/(b.t - a.t) AS b FROM s a JOIN s b ON a.source = b.source AND b.r - a.r BETWEEN 1 AND 2 WHERE a.t <> b.t),
c AS (SELECT source, line, any_value(t0) AS t0, any_value(y0) AS y0, any_value(b) AS b, count(*) AS votes FROM l JOIN d USING (source) WHERE abs(flux - y0 - b*(t - t0)) <= 5000 GROUP BY source, line),
w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY votes DESC, line) = 1),
f AS (SELECT d.source, coalesce(regr_slope(flux, t), 0) AS slope, avg(t) AS tm, avg(flux) AS ym, count(*) AS n_in FROM d LEFT JOIN w USING (source) WHERE b IS NULL OR abs(flux - y0 - b*(t - t0)) <= 5000 GROUP BY d.source)
SELECT source, round(slope, 5) AS slope, round(ym - slope*tm, 2) AS intercept, n_in FROM f"""


@R.query("ransac_line", RANSAC_SQL)
def ransac_line(spark, d):
    line = mo.ransac_line(light_curve(spark, d), "source", "id", "t", "flux", 5000.0)
    return rounded(rounded(line, "slope", digits=5), "intercept", digits=2)


TAPS = "(-0.8*y + 0.2*lead(y, 1) OVER w + 1.2*lead(y, 2) OVER w + 0.2*lead(y, 3) OVER w - 0.8*lead(y, 4) OVER w)/sqrt(2.8)"


@R.query("matched_filter", LC + f", y AS (SELECT source, t, flux, (flux - avg(flux) OVER s)/stddev_pop(flux) OVER s AS y FROM lc WINDOW s AS (PARTITION BY source)), c AS (SELECT source, {TAPS} AS c, row_number() OVER w - 1 AS i FROM y WINDOW w AS (PARTITION BY source ORDER BY t, flux)) SELECT source, round(max(c), 6) AS best, arg_min(i, (-c, i)) AS at FROM c WHERE c IS NOT NULL GROUP BY source")
def matched_filter(spark, d):
    return rounded(mo.matched_filter(light_curve(spark, d), "source", "t", "flux", [0, 1, 2, 1, 0]), "best")


@R.query("kepler_residual", "WITH RECURSIVE k AS (SELECT p_partkey, p_size/10.0 AS m, (p_partkey % 90)/100.0 AS e, p_size/10.0 + (p_partkey % 90)/100.0*sin(p_size/10.0) AS x, 0 AS i FROM part UNION ALL SELECT p_partkey, m, e, x - (x - e*sin(x) - m)/(1 - e*cos(x)), i + 1 FROM k WHERE i < 20) SELECT p_partkey, round(x, 8) AS anomaly FROM k WHERE i = 20")
def kepler_residual(spark, d):
    """Eccentric anomalies."""
    m, e = F.col("p_size") / 10.0, F.pmod(F.col("p_partkey"), F.lit(90)) / 100.0
    return table(spark, d, "part").select("p_partkey", F.round(mo.kepler(m, e), 8).alias("anomaly"))


@R.query("image_convolution", "WITH p AS (SELECT l_linenumber AS img, l_suppkey % 10 AS r, l_partkey % 10 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), g AS (SELECT img, r, unnest(range(0, mc+1)) AS c FROM (SELECT img, mc, unnest(range(0, mr+1)) AS r FROM (SELECT img, max(r) AS mr, max(c) AS mc FROM p GROUP BY img))) SELECT g.img::BIGINT AS img, g.r, g.c, round(coalesce(sum(v), 0)/9, 6) AS v FROM g LEFT JOIN p ON p.img = g.img AND abs(p.r-g.r) <= 1 AND abs(p.c-g.c) <= 1 GROUP BY g.img, g.r, g.c")
def image_convolution(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("img"), (F.col("l_suppkey") % 10).alias("r"), (F.col("l_partkey") % 10).alias("c")).agg(F.sum("l_quantity").alias("v"))
    return rounded(im.convolved(p, [[1 / 9] * 3] * 3), "v")
