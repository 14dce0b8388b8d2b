"""Registered queries of aggregations and bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.operators import stats as st
from skylattice.operators.resampling import weight_sql
from skylattice.plans.common import rounded
from skylattice.registry import Registry, table

R = Registry()

ERR = "(1 + l_tax*l_extendedprice)"


def _li(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("v"), (1 + F.col("l_tax") * F.col("l_extendedprice")).alias("e"))


LI = f"WITH t AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice AS v, {ERR} AS e FROM lineitem) "


@R.query("column_min_max", "SELECT min(p_size) AS min_size, max(p_size) AS max_size, min(p_retailprice) AS min_price, max(p_retailprice) AS max_price FROM part")
def column_min_max(spark, d):
    return table(spark, d, "part").agg(F.min("p_size").alias("min_size"), F.max("p_size").alias("max_size"), F.min("p_retailprice").alias("min_price"), F.max("p_retailprice").alias("max_price"))


@R.query("nan_statistics", LI + "SELECT l_suppkey, round(avg(x), 6) AS mean, median(x) AS median, round(stddev_samp(x), 6) AS std, max(x) AS top, count(x) AS n FROM (SELECT l_suppkey, CASE WHEN l_linenumber <> 3 THEN v END AS x FROM t) GROUP BY l_suppkey")
def nan_statistics(spark, d):
    from skylattice.operators.tables import nan_to_null

    t = nan_to_null(_li(spark, d).withColumn("x", F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("v"))))
    return rounded(t.groupBy("l_suppkey").agg(F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("std"), F.max("x").alias("top"), F.count("x").alias("n")), "mean", "std")


@R.query("rstd", LI + "SELECT l_suppkey, round((quantile_cont(v, 0.75) - quantile_cont(v, 0.25))/2*1.4826, 6) AS rstd FROM t GROUP BY l_suppkey")
def rstd(spark, d):
    return _li(spark, d).groupBy("l_suppkey").agg(F.round(st.rstd("v"), 6).alias("rstd"))


@R.query("iqr_fast", LI + "SELECT l_suppkey, round(quantile_disc(v, 0.75) - quantile_disc(v, 0.25), 6) AS iqr FROM t GROUP BY l_suppkey")
def iqr_fast(spark, d):
    return _li(spark, d).groupBy("l_suppkey").agg(F.round(st.iqr_fast("v"), 6).alias("iqr"))


@R.query("quantile_fast", LI + "SELECT l_suppkey, quantile_disc(v, 0.1) AS q FROM t GROUP BY l_suppkey")
def quantile_fast(spark, d):
    return _li(spark, d).groupBy("l_suppkey").agg(st.quantile_disc("v", 0.1).alias("q"))


@R.query("wmean", LI + "SELECT l_suppkey, round(sum(v/(e*e))/sum(1/(e*e)), 4) AS wmean, round(sqrt(1/sum(1/(e*e))), 6) AS wmean_err FROM t GROUP BY l_suppkey")
def wmean(spark, d):
    m = st.wmean("v", "e")
    return _li(spark, d).groupBy("l_suppkey").agg(m[0], m[1]).select("l_suppkey", F.round("wmean", 4).alias("wmean"), F.round("wmean_err", 6).alias("wmean_err"))


@R.query("wmedian", LI + """, c AS (SELECT l_suppkey, v, e, row_number() OVER w AS n, sum(1/(e*e)) OVER (PARTITION BY l_suppkey ORDER BY v, e ROWS UNBOUNDED PRECEDING)/sum(1/(e*e)) OVER (PARTITION BY l_suppkey) AS c FROM t WINDOW w AS (PARTITION BY l_suppkey ORDER BY v, e)),
g AS (SELECT l_suppkey, v, n, CASE WHEN n = 1 THEN least(c, 0.5) ELSE c END AS c FROM c), h AS (SELECT l_suppkey, v, c, lag(c) OVER (PARTITION BY l_suppkey ORDER BY n) AS c0, lag(v) OVER (PARTITION BY l_suppkey ORDER BY n) AS v0 FROM g)
SELECT l_suppkey, round(CASE WHEN c0 IS NULL THEN v ELSE v0 + (v-v0)*(0.5-c0)/(c-c0) END, 3) AS wmedian FROM h WHERE c >= 0.5 AND (c0 IS NULL OR c0 < 0.5)""")
def wmedian(spark, d):
    return rounded(st.wmedian(_li(spark, d), "v", "e", ["l_suppkey"]), "wmedian", digits=3)


@R.query("std_w", LI + "SELECT l_suppkey, round(sqrt(sum(pow(v-m,2)/(e*e))/(sum(1/(e*e))*(count(*)-1)/count(*))), 4) AS std_w FROM t JOIN (SELECT l_suppkey, avg(v) AS m FROM t GROUP BY 1) USING (l_suppkey) GROUP BY l_suppkey")
def std_w(spark, d):
    return rounded(st.std_w(_li(spark, d), "v", "e", ["l_suppkey"]), "std_w", digits=4)


@R.query("mean_error", LI + "SELECT l_suppkey, round(stddev_samp(v)/sqrt(count(v)), 5) AS err, round(stddev_samp(v), 5) AS std FROM t GROUP BY l_suppkey")
def mean_error(spark, d):
    return _li(spark, d).groupBy("l_suppkey").agg(F.round(F.stddev_samp("v") / F.sqrt(F.count("v")), 5).alias("err"), F.round(F.stddev_samp("v"), 5).alias("std"))


@R.query("rmean", LI + "SELECT l_suppkey, round(avg(v), 5) AS rmean FROM (SELECT l_suppkey, v, row_number() OVER (PARTITION BY l_suppkey ORDER BY v) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM t) WHERE i > ceil(n*0.1) AND i <= floor(n*0.9) GROUP BY l_suppkey")
def rmean(spark, d):
    return rounded(st.rmean(_li(spark, d), "v", ["l_suppkey"]), "rmean", digits=5)


@R.query("rstd_l1", LI + "SELECT l_suppkey, round(avg(abs(v-m))*1.1547, 5) AS rstd_l1 FROM t JOIN (SELECT l_suppkey, avg(v) AS m FROM t GROUP BY 1) USING (l_suppkey) GROUP BY l_suppkey")
def rstd_l1(spark, d):
    return rounded(st.rstd_l1(_li(spark, d), "v", ["l_suppkey"]), "rstd_l1", digits=5)


@R.query("central_moment", LI + "SELECT l_suppkey, round(avg(pow(l_quantity-m,3)), 4) AS moment FROM t JOIN (SELECT l_suppkey, avg(l_quantity) AS m FROM t GROUP BY 1) USING (l_suppkey) GROUP BY l_suppkey")
def central_moment(spark, d):
    return rounded(st.central_moment(_li(spark, d), "l_quantity", 3, ["l_suppkey"]), "moment", digits=4)


@R.query("sigma_clip_mean", LI + """, a AS (SELECT l_suppkey, v FROM t JOIN (SELECT l_suppkey, avg(v) m, stddev_samp(v) s FROM t GROUP BY 1) USING (l_suppkey) WHERE s IS NULL OR abs(v-m) <= 1.5*s),
b AS (SELECT l_suppkey, v FROM a JOIN (SELECT l_suppkey, avg(v) m, stddev_samp(v) s FROM a GROUP BY 1) USING (l_suppkey) WHERE s IS NULL OR abs(v-m) <= 1.5*s)
SELECT l_suppkey, round(avg(v), 2) AS mean, round(var_samp(v), 0) AS var, count(*) AS n_good FROM b GROUP BY l_suppkey""")
def sigma_clip_mean(spark, d):
    c = st.sigma_clip(_li(spark, d), "v", ["l_suppkey"], 1.5)
    return c.select("l_suppkey", F.round("mean", 2).alias("mean"), F.round("var", 0).alias("var"), "n_good")


BINS = "SELECT b.bin, round({start} + (b.bin-0.5)*{size}, 6) AS mid, coalesce(n, 0) AS n, round(mean, 5) AS mean, round(std, 5) AS std FROM (SELECT unnest(range(1, {n}+1)) AS bin) b LEFT JOIN (SELECT ceil((l_quantity-({start}))/{size})::BIGINT AS bin, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std FROM t GROUP BY 1) USING (bin)"


@R.query("binning", LI + BINS.format(start="0.0", size="(60.0/8)", n=8))
def binning(spark, d):
    return rounded(st.binning(_li(spark, d), "l_quantity", "v", 0.0, 60.0, 7.0), "mid", "mean", "std", digits=5)


@R.query("binning_fast", LI + "SELECT b.bin, round((b.bin-0.5)*7.0, 6)::DOUBLE AS mid, coalesce(n, 0) AS n, round(coalesce(mean, 0.0), 5) AS mean, round(std, 5) AS std FROM (SELECT unnest(range(1, 9)) AS bin) b LEFT JOIN (SELECT ceil(l_quantity/7.0)::BIGINT AS bin, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std FROM t GROUP BY 1) USING (bin)")
def binning_fast(spark, d):
    return rounded(st.binning(_li(spark, d), "l_quantity", "v", 0.0, 60.0, 7.0, rescale=False, fill=0.0), "mid", "mean", "std", digits=5)


@R.query("binning_npt", "WITH o AS (SELECT o_custkey % 50 AS g, epoch_us(o_orderdate)/86400000000.0 AS t, o_totalprice AS v, floor((row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_totalprice)-1)/10)::BIGINT AS bin FROM orders) SELECT g, bin, count(*) AS n, round(avg(t), 5) AS mean_x, round(avg(v), 4) AS mean_y, round(stddev_samp(v), 4) AS std_y FROM o GROUP BY g, bin HAVING count(*) = 10")
def binning_npt(spark, d):
    from skylattice.plans.common import day

    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("g"), day("o_orderdate").alias("t"), F.col("o_totalprice").alias("v"))
    b = st.binning_npt(o, "t", "v", 10, ["g"])
    return b.select("g", "bin", "n", F.round("mean_x", 5).alias("mean_x"), F.round("mean_y", 4).alias("mean_y"), F.round("std_y", 4).alias("std_y"))


@R.query("bin2d_stat", LI + "SELECT ceil(l_quantity/10.0)::BIGINT AS bin_x, ceil((v-1000.0)/20000.0)::BIGINT AS bin_y, count(*) AS n, round(avg(e), 5) AS mean, round(median(e), 5) AS median FROM t WHERE v > 1000.0 AND l_quantity > 0 GROUP BY 1, 2")
def bin2d_stat(spark, d):
    return rounded(st.bin2d(_li(spark, d), "l_quantity", "v", "e", 0.0, 1000.0, 10.0, 20000.0), "mean", "median", digits=5)


@R.query("hist2d", "SELECT floor(p_size/5.0)::BIGINT AS ix, floor(p_retailprice/100.0)::BIGINT AS iy, count(*) AS n FROM part GROUP BY 1, 2")
def hist2d(spark, d):
    from skylattice.operators.events import image

    p = table(spark, d, "part").select((F.col("p_size") / 5.0).alias("x"), (F.col("p_retailprice") / 100.0).alias("y"))
    return image(p, "x", "y", 1.0)


@R.query("overdense_flag", "WITH t AS (SELECT p_partkey, floor(p_size/2.0)::BIGINT AS bx, floor((p_partkey*p_partkey % 700)/100.0)::BIGINT AS b FROM part), c AS (SELECT bx, b, count(*) AS c FROM t GROUP BY 1, 2), l AS (SELECT avg(c) + 2.0*greatest(0.5, (quantile_cont(c::DOUBLE, 0.75)-quantile_cont(c::DOUBLE, 0.25))/2*1.4826) AS lim FROM c) SELECT p_partkey, c > lim AS overdense FROM t JOIN c USING (bx, b), l")
def overdense_flag(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") * F.col("p_partkey") % 700).cast("double").alias("y"))
    return st.overdense(p, "x", "y", 2.0, 100.0, 2.0).select("p_partkey", "overdense")


@R.query("mode_bin", """WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS lo, quantile_cont(p_retailprice, 0.75) AS hi, greatest(1, count(*)//2//10) AS k FROM part GROUP BY 1),
b AS (SELECT p_brand, lo, hi, k, least(k-1, floor((p_retailprice-lo)/((hi-lo)/k)))::BIGINT AS b FROM part JOIN q USING (p_brand) WHERE p_retailprice BETWEEN lo AND hi), c AS (SELECT p_brand, b, count(*) AS c, min(lo + (b+0.5)*(hi-lo)/k) AS mid FROM b GROUP BY ALL)
SELECT p_brand, round(arg_min(mid, (-c, b)), 6) AS mode FROM c GROUP BY p_brand""")
def mode_bin(spark, d):
    return rounded(st.mode_bin(table(spark, d, "part"), "p_retailprice", ["p_brand"], 10), "mode")


@R.query("marginalize", "SELECT p_size::BIGINT AS p_size, NULL::BIGINT AS b, round(ln(sum(exp(v))), 6) AS margin FROM (SELECT p_size, p_retailprice/1000 AS v FROM part) GROUP BY 1 UNION ALL SELECT NULL, p_partkey % 25, round(ln(sum(exp(p_retailprice/1000))), 6) FROM part GROUP BY 2")
def marginalize(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").cast("bigint").alias("p_size"), (F.col("p_partkey") % 25).alias("b"), (F.col("p_retailprice") / 1000).alias("v"))
    return rounded(st.marginals(p, ["p_size", "b"], "v"), "margin")


@R.query("rollup_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def rollup_cube(spark, d):
    return table(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@R.query("lognlogs", "SELECT edge::DOUBLE AS edge, (SELECT count(*) FROM orders WHERE o_totalprice >= edge) AS n FROM (VALUES (1000.0), (50000.0), (100000.0), (200000.0), (400000.0)) e(edge)")
def lognlogs(spark, d):
    edges = [1000.0, 50000.0, 100000.0, 200000.0, 400000.0]
    one = table(spark, d, "orders").agg(*[F.count_if(F.col("o_totalprice") >= e).alias(f"n{i}") for i, e in enumerate(edges)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(e).alias("edge"), F.col(f"n{i}").alias("n")) for i, e in enumerate(edges)])).alias("r")).select("r.*")


@R.query("jackknife", LI + "SELECT l_suppkey, round(avg(v), 5) AS mean, round(stddev_samp(v)/sqrt(count(v)), 5) AS jack_std FROM t GROUP BY l_suppkey")
def jackknife(spark, d):
    return rounded(st.jackknife_mean(_li(spark, d), "v", ["l_suppkey"]), "mean", "jack_std", digits=5)


@R.query("bootstrap", f"WITH w AS (SELECT s_nationkey, s_acctbal AS v, sim, {weight_sql('s_suppkey', 'sim')} AS w FROM supplier, (SELECT unnest(range(1, 51)) AS sim)), m AS (SELECT s_nationkey, sim, sum(v*w)/nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2) SELECT s_nationkey, round(avg(m), 5) AS boot_mean, round(stddev_samp(m), 5) AS boot_std FROM m GROUP BY s_nationkey")
def bootstrap(spark, d):
    s = table(spark, d, "supplier")
    return rounded(st.bootstrap_mean(s, "s_suppkey", "s_acctbal", ["s_nationkey"], 50), "boot_mean", "boot_std", digits=5)


@R.query("mutual_info", "WITH xy AS (SELECT c_nationkey AS x, c_mktsegment AS y, count(*) AS n FROM customer GROUP BY 1, 2) SELECT round(sum(n/t*ln(n*t/(nx*ny))), 9) AS mi FROM (SELECT n, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny, sum(n) OVER ()::DOUBLE AS t FROM xy)")
def mutual_info(spark, d):
    return rounded(st.mutual_information(table(spark, d, "customer"), "c_nationkey", "c_mktsegment"), "mi", digits=9)


@R.query("correlation", LI + "SELECT round(corr(l_quantity, v), 9) AS r, round(covar_samp(l_quantity, v), 2) AS cov FROM t")
def correlation(spark, d):
    return _li(spark, d).agg(F.round(F.corr("l_quantity", "v"), 9).alias("r"), F.round(F.covar_samp("l_quantity", "v"), 2).alias("cov"))


@R.query("center_of_mass", "SELECT round(sum(p_size*p_retailprice)/sum(p_retailprice), 6) AS cx, round(sum((p_partkey % 100)*p_retailprice)/sum(p_retailprice), 6) AS cy, round(sum(p_size*p_size*p_retailprice)/sum(p_retailprice) - pow(sum(p_size*p_retailprice)/sum(p_retailprice), 2), 5) AS mxx FROM part")
def center_of_mass(spark, d):
    w, x, y = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey") % 100
    mean = F.sum(x * w) / F.sum(w)
    return table(spark, d, "part").agg(F.round(mean, 6).alias("cx"), F.round(F.sum(y * w) / F.sum(w), 6).alias("cy"), F.round(F.sum(x * x * w) / F.sum(w) - F.pow(mean, F.lit(2)), 5).alias("mxx"))


@R.query("max_index", "SELECT max(l_extendedprice) AS top, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS at FROM lineitem")
def max_index(spark, d):
    return table(spark, d, "lineitem").agg(F.max("l_extendedprice").alias("top"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("at"))


# images as long tables: image = line number, row and column from the keys

CUBE = "WITH px AS (SELECT l_linenumber AS img, l_suppkey % 10 AS r, l_partkey % 10 AS c, l_extendedprice AS v, l_linenumber AS m FROM lineitem) "


def _cube(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("img"), (F.col("l_suppkey") % 10).alias("r"), (F.col("l_partkey") % 10).alias("c"), F.col("l_extendedprice").alias("v"), F.col("l_linenumber").alias("m"))


@R.query("stack_cube", CUBE + "SELECT r, c, count(v) AS n, round(sum(v), 2) AS total, round(avg(v), 4) AS mean, median(v) AS median, max(v)-min(v) AS spread, bit_or(m) AS mask FROM px GROUP BY r, c")
def stack_cube(spark, d):
    return _cube(spark, d).groupBy("r", "c").agg(F.count("v").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.round(F.avg("v"), 4).alias("mean"), F.median("v").alias("median"), (F.max("v") - F.min("v")).alias("spread"), F.bit_or("m").alias("mask"))


@R.query("coadd_normalised", CUBE + "SELECT r, c, round(avg(v/f), 6) AS coadd FROM px JOIN (SELECT img, median(v) AS f FROM px GROUP BY img) USING (img) GROUP BY r, c")
def coadd_normalised(spark, d):
    p = _cube(spark, d)
    f = p.groupBy("img").agg(F.median("v").alias("f"))
    return p.join(f, "img").groupBy("r", "c").agg(F.round(F.avg(F.col("v") / F.col("f")), 6).alias("coadd"))


@R.query("image_statistics", CUBE + "SELECT img, count(*) AS n, count(*) FILTER (v > 50000) AS n_bright, quantile_disc(v, 0.9) AS q90, round(stddev_samp(v), 4) AS std FROM px GROUP BY img")
def image_statistics(spark, d):
    return _cube(spark, d).groupBy("img").agg(F.count("*").alias("n"), F.count_if(F.col("v") > 50000).alias("n_bright"), st.quantile_disc("v", 0.9).alias("q90"), F.round(F.stddev_samp("v"), 4).alias("std"))


@R.query("local_maxima", CUBE + ", im AS (SELECT r, c, sum(v) AS v FROM px GROUP BY r, c) SELECT a.r, a.c FROM im a LEFT JOIN im b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY a.r, a.c, a.v HAVING a.v > max(b.v)")
def local_maxima(spark, d):
    from skylattice.operators.cubes import local_maxima as peaks

    im = _cube(spark, d).groupBy("r", "c").agg(F.sum("v").alias("v"))
    return peaks(im).select("r", "c")


@R.query("image_cutouts", CUBE + ", im AS (SELECT r, c, sum(v) AS v, bit_or(m) AS m FROM px GROUP BY r, c), s AS (SELECT n_nationkey AS src, n_nationkey % 10 AS sr, n_nationkey*3 % 10 AS sc FROM nation) SELECT src, count(*) AS n, round(sum(v), 2) AS total, bit_or(m) AS mask FROM s JOIN im ON abs(r-sr) <= 2 AND abs(c-sc) <= 2 GROUP BY src")
def image_cutouts(spark, d):
    from skylattice.operators.cubes import cutouts

    im = _cube(spark, d).groupBy("r", "c").agg(F.sum("v").alias("v"), F.bit_or("m").alias("m"))
    k = F.col("n_nationkey")
    src = table(spark, d, "nation").select(k.alias("src"), (k % 10).alias("sr"), (k * 3 % 10).alias("sc"))
    return cutouts(im, src, 2).groupBy("src").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.bit_or("m").alias("mask"))


@R.query("block_background", CUBE + "SELECT r//5 AS tr, c//5 AS tc, median(v) AS back, round(pow((quantile_cont(v, 0.75)-quantile_cont(v, 0.25))/2*1.4826, 2), 2) AS var FROM px GROUP BY 1, 2")
def block_background(spark, d):
    p = _cube(spark, d).groupBy(F.floor(F.col("r") / 5).alias("tr"), F.floor(F.col("c") / 5).alias("tc"))
    return p.agg(F.median("v").alias("back"), F.round(F.pow(st.rstd("v"), F.lit(2)), 2).alias("var"))
