"""Registered queries of fits, transforms, sketches, resampling and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.operators import leastsq, resampling, shapes, sketches, transforms
from skylattice.plans.common import LC_SQL, day, light_curve, rounded
from skylattice.plans.storage import checkpointed
from skylattice.registry import Registry, table

R = Registry()
LC = f"WITH {LC_SQL}"

_DET = "(m00*(m11*m22-m12*m12) - m01*(m01*m22-m12*m02) + m02*(m01*m12-m11*m02))"


@R.query("regress", "WITH d AS (SELECT l_suppkey AS source, l_extendedprice/1000 AS y, l_quantity - avg(l_quantity) OVER s AS a, l_discount*100 - avg(l_discount*100) OVER s AS b, avg(l_quantity) OVER s AS am, avg(l_discount*100) OVER s AS bm, 1/(pow(1 + l_tax*10, 2) + 0.0001) AS w FROM lineitem WINDOW s AS (PARTITION BY l_suppkey)), m AS (SELECT source, any_value(am) AS am, any_value(bm) AS bm, count(*) AS n, sum(w*a*a) AS m00, sum(w*a*b) AS m01, sum(w*a) AS m02, sum(w*b*b) AS m11, sum(w*b) AS m12, sum(w) AS m22, sum(w*a*y) AS h0, sum(w*b*y) AS h1, sum(w*y) AS h2, sum(w*y*y) AS yy FROM d GROUP BY source), "
    f"p AS (SELECT *, {_DET} AS det FROM m), s AS (SELECT *, (h0*(m11*m22-m12*m12) - m01*(h1*m22-m12*h2) + m02*(h1*m12-m11*h2))/det AS p0, (m00*(h1*m22-m12*h2) - h0*(m01*m22-m12*m02) + m02*(m01*h2-h1*m02))/det AS p1, (m00*(m11*h2-h1*m12) - m01*(m01*h2-h1*m02) + h0*(m01*m12-m11*m02))/det AS p2 FROM p) "
    "SELECT source, n, n - 3 AS dof, round(p0, 6) AS slope_a, round(p1, 6) AS slope_b, round(p2 - p0*am - p1*bm, 5) AS const, round(sqrt((m11*m22-m12*m12)/det), 6) AS err_a, round(sqrt((m00*m22-m02*m02)/det), 6) AS err_b, round(yy - p0*h0 - p1*h1 - p2*h2, 3) AS chi2 FROM s WHERE n > 3")  # fmt: skip
def regress(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (1 + F.col("l_tax") * 10).alias("e"))
    r = leastsq.regress(li, "source", ["a", "b"], "y", "e", 0.01).where("n > 3")
    return r.select("source", "n", "dof", F.round(F.col("par")[0], 6).alias("slope_a"), F.round(F.col("par")[1], 6).alias("slope_b"), F.round(F.col("par")[2], 5).alias("const"), F.round(F.col("par_err")[0], 6).alias("err_a"), F.round(F.col("par_err")[1], 6).alias("err_b"), F.round("chi2", 3).alias("chi2"))


@R.query("sparse_fit")
def sparse_fit(spark, d):
    """Brightness of every supplier and offset of every month (but the first) from the logarithms of all prices."""
    li = table(spark, d, "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.log("l_extendedprice").alias("y"), (0.1 + F.col("l_tax")).alias("e"))
    # numbers of order and line are not unique: prices of a supplier in a month are one equation, their mean by weight
    w = 1 / (F.col("e") * F.col("e"))
    li = li.where("y is not null and e > 0").groupBy("l_suppkey", "month").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("y"), (1 / F.sqrt(F.sum(w))).alias("err"))
    li = checkpointed(li.withColumn("row", F.concat_ws(":", "l_suppkey", "month")))
    cols = F.array(F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("m"), F.col("month")))
    entries = li.select("row", F.explode(cols).alias("col"), F.lit(1.0).alias("value"))
    first = "m" + (li.agg(F.min("month")).first()[0] or "")
    par, _ = leastsq.sparse_solve(entries.where(F.col("col") != first), li.select("row", "y", "err"))
    return par.select("col", F.round("par", 6).alias("par"), F.round("par_err", 6).alias("par_err"))


PX = "px AS (SELECT l_linenumber AS img, l_suppkey % 20 AS r, l_partkey % 13 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


@R.query("fast_radon", f"WITH RECURSIVE {PX}, o AS (SELECT c, dy AS d0, dy, 0 AS off, 4 AS m FROM (SELECT unnest(range(0, 16)) AS c), (SELECT unnest(range(-15, 16)) AS dy) UNION ALL SELECT c, d0, CAST(trunc(dy/2) AS BIGINT), off + CASE WHEN (c >> (m-1)) & 1 = 1 THEN dy - CAST(trunc(dy/2) AS BIGINT) ELSE 0 END, m-1 FROM o WHERE m > 0), i AS (SELECT img, max(r) AS last FROM px GROUP BY img HAVING max(c) BETWEEN 8 AND 15), g AS (SELECT img, last, d0, unnest(range(0, last+1)) AS r FROM i, (SELECT DISTINCT d0 FROM o)) SELECT g.img, g.d0::INT AS dy, g.r::INT AS r, round(coalesce(sum(px.v), 0), 2) AS v FROM g JOIN o ON o.d0 = g.d0 AND o.m = 0 LEFT JOIN px ON px.img = g.img AND px.c = o.c AND px.r = g.r + o.off GROUP BY g.img, g.d0, g.r")
def fast_radon(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("img"), (F.col("l_suppkey") % 20).alias("r"), (F.col("l_partkey") % 13).alias("c")).agg(F.sum("l_quantity").alias("v"))
    return transforms.fast_radon(p).select("img", "dy", "r", F.round("v", 2).alias("v"))


def _months(spark, d):
    return light_curve(spark, d).groupBy("source", F.floor(F.col("t") / 30).alias("e")).agg(F.avg("flux").alias("a"), F.avg("err").alias("b"))


MONTHS = LC + ", m AS (SELECT source, floor(t/30) AS e, avg(flux) AS a, avg(err) AS b FROM lc GROUP BY 1, 2)"


@R.query("ccf_fft", MONTHS + ", c AS (SELECT source, a - avg(a) OVER s AS a, b - avg(b) OVER s AS b, row_number() OVER (PARTITION BY source ORDER BY e) - 1 AS i, count(*) OVER s AS n, stddev_samp(a) OVER s * stddev_samp(b) OVER s AS norm FROM m WINDOW s AS (PARTITION BY source)) SELECT x.source, (x.i - y.i + x.n) % x.n AS lag, round(sum(x.a*y.b)/any_value(x.n*x.norm), 6) AS corr FROM c x JOIN c y ON x.source = y.source GROUP BY ALL")
def ccf_fft(spark, d):
    return rounded(transforms.circular_correlation(_months(spark, d), "source", "e", "a", "b"), "corr")


@R.query("lag_sums", MONTHS + "SELECT x.source, y.e::BIGINT - x.e::BIGINT AS lag, round(sum(x.a*y.b)/1e6, 3) AS s, count(*) AS n FROM m x JOIN m y ON x.source = y.source AND abs(y.e - x.e) <= 12 GROUP BY ALL")
def lag_sums(spark, d):
    return transforms.lag_sums(_months(spark, d), "source", "e", "a", "b", 12).select("source", "lag", F.round(F.col("s") / 1e6, 3).alias("s"), "n")


@R.query("sketch_quantiles", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(value) AS n, true AS median_ok, true AS p95_ok FROM events GROUP BY 1 HAVING count(value) > 0")
def sketch_quantiles(spark, d):
    """Weekly median and 95 % quantile from daily sketches, against those of the rows: within 1 %."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "value")
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")
    s = sketches.quantile_sketch(e, "value", ["day"]).select(week, "sign", "bucket", "n")
    exact = e.where("value is not null").groupBy(week).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(k) for k, q in (("p50", 0.5), ("p95", 0.95))])
    at = lambda q, k: sketches.sketch_quantile(s, ["week"], q).select("week", F.col("n").alias(f"n{k}"), F.col("value").alias(k))
    j = exact.join(at(0.5, "a"), "week").join(at(0.95, "b"), "week")
    return j.select("week", F.col("na").alias("n"), sketches.within(F.col("a"), F.col("p50"), 0.0101).alias("median_ok"), sketches.within(F.col("b"), F.col("p95"), 0.0101).alias("p95_ok"))


@R.query("sketch_distinct", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(DISTINCT user_id) AS n, true AS ok FROM events GROUP BY 1")
def sketch_distinct(spark, d):
    """Weekly distinct users from daily sketches: within five standard errors of the exact number."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id")
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")
    s = sketches.distinct_estimate(sketches.distinct_sketch(e, "user_id", ["day"]).select(week, "sketch"), ["week"]).withColumnRenamed("n", "about")
    j = e.groupBy(week).agg(F.count_distinct("user_id").alias("n")).join(s, "week")
    return j.select("week", "n", sketches.within(F.col("about"), F.col("n"), 5 * 1.04 / 2 ** (sketches.HLL_BITS / 2)).alias("ok"))


_SUMS = "SELECT l_suppkey AS source, l_quantity AS x, l_extendedprice/1000 AS y, count(*) OVER s AS n, sum(l_quantity) OVER s AS sx, sum(l_extendedprice/1000) OVER s AS sy, sum(l_quantity*l_quantity) OVER s AS sxx, sum(pow(l_extendedprice/1000, 2)) OVER s AS syy, sum(l_quantity*l_extendedprice/1000) OVER s AS sxy FROM lineitem WINDOW s AS (PARTITION BY l_suppkey)"
_CORR = "({n}*({xy}) - ({x})*({y}))/sqrt(({n}*({xx}) - pow({x}, 2))*({n}*({yy}) - pow({y}, 2)))"
_ALL, _OUT = _CORR.format(n="n", x="sx", y="sy", xx="sxx", yy="syy", xy="sxy"), _CORR.format(n="(n-1)", x="sx-x", y="sy-y", xx="sxx-x*x", yy="syy-y*y", xy="sxy-x*y")


def _prices(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


_TAIL = ", m AS (SELECT source, avg(e) AS m FROM j GROUP BY source), z AS (SELECT j.source, any_value(v) AS value, any_value(m) AS m, count(*) AS n, sum(pow(m-e, 2)) AS s2, sum(pow(m-e, 3)) AS s3, avg((e < v)::INT) AS below FROM j JOIN m USING (source) GROUP BY j.source) SELECT source, round(value, 6) AS value, round(sqrt((n-1.0)/n*s2), {k}) AS std, round((n-1)*(m-value), {b}) + 0.0 AS bias, n"


@R.query("jackknife_correlation", f"WITH d AS ({_SUMS}), j AS (SELECT source, {_OUT} AS e, {_ALL} AS v FROM d WHERE n > 3)" + _TAIL.format(k=6, b=6) + ", round(coalesce(s3/(6*pow(nullif(s2, 0), 1.5)), 0), 4) + 0.0 AS acceleration, round(below, 6) AS below FROM z")
def jackknife_correlation(spark, d):
    p = _prices(spark, d)
    j = resampling.jackknife(p, ["source"], resampling.correlation_terms(F.col("x"), F.col("y")), resampling.correlation).where("n > 3")
    return rounded(j, "value", "std", "below").withColumn("bias", F.round("bias", 6) + 0.0).withColumn("acceleration", F.round("acceleration", 4) + 0.0)


@R.query("jackknife_median", "WITH r AS (SELECT l_suppkey AS source, l_extendedprice AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem), l AS (SELECT source, list(y ORDER BY i) AS ys FROM r GROUP BY source), k AS (SELECT r.source, i, n, median(y) OVER (PARTITION BY r.source) AS v, ys, (n-1) AS c FROM r JOIN l USING (source) WHERE n > 1), j AS (SELECT source, v, CASE WHEN c % 2 = 1 THEN ys[(c+1)//2 + ((c+1)//2 >= i)::INT] ELSE (ys[c//2 + (c//2 >= i)::INT] + ys[c//2 + 1 + (c//2 + 1 >= i)::INT])/2 END AS e FROM k)" + _TAIL.format(k=4, b=3) + " FROM z")
def jackknife_median(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_extendedprice").alias("y"))
    j = resampling.jackknife_median(li, ["source"], "y")
    return j.select("source", F.round("value", 6).alias("value"), F.round("std", 4).alias("std"), (F.round("bias", 3) + 0.0).alias("bias"), "n")


@R.query("bootstrap_correlation", f"WITH p AS (SELECT l_suppkey AS source, l_orderkey*8 + l_linenumber AS id, l_quantity AS x, l_extendedprice/1000 AS y FROM lineitem), w AS (SELECT *, CASE WHEN sim = 0 THEN 1 ELSE {resampling.weight_sql('id', 'sim')} END AS w FROM (SELECT *, unnest(range(0, 21)) AS sim FROM p)), s AS (SELECT source, sim, sum(w)::DOUBLE AS n, sum(w*x) AS x, sum(w*y) AS y, sum(w*x*x) AS xx, sum(w*y*y) AS yy, sum(w*x*y) AS xy FROM w GROUP BY source, sim), e AS (SELECT source, sim, {_CORR.format(n='n', x='x', y='y', xx='xx', yy='yy', xy='xy')} AS e FROM s) SELECT source, round(max(e) FILTER (sim = 0), 6) AS value, round(avg(e) FILTER (sim > 0), 6) AS mean, round(stddev_samp(e) FILTER (sim > 0), 6) AS std, round(avg(e) FILTER (sim > 0) - max(e) FILTER (sim = 0), 6) AS bias FROM e GROUP BY source")
def bootstrap_correlation(spark, d):
    b = resampling.bootstrap(_prices(spark, d), ["source"], "id", resampling.correlation_terms(F.col("x"), F.col("y")), resampling.correlation, 20)
    return rounded(b, "value", "mean", "std", "bias")


_PART = "(mod(p_partkey*37, 1000)/10.0)::DOUBLE AS x, (mod(p_partkey*91, 1000)/10.0)::DOUBLE AS y"


@R.query("enclosing_circle", f"WITH p AS (SELECT DISTINCT p_size AS g, {_PART} FROM part), k AS (SELECT g, x AS cx, y AS cy, 0.0 AS r FROM p UNION ALL SELECT a.g, (a.x+b.x)/2, (a.y+b.y)/2, sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2))/2 FROM p a JOIN p b ON a.g = b.g AND (a.x, a.y) < (b.x, b.y) UNION ALL SELECT g, ax + ux/d, ay + uy/d, sqrt(ux*ux + uy*uy)/abs(d) FROM (SELECT a.g, a.x AS ax, a.y AS ay, 2*((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x)) AS d, (c.y-a.y)*(pow(b.x-a.x, 2)+pow(b.y-a.y, 2)) - (b.y-a.y)*(pow(c.x-a.x, 2)+pow(c.y-a.y, 2)) AS ux, (b.x-a.x)*(pow(c.x-a.x, 2)+pow(c.y-a.y, 2)) - (c.x-a.x)*(pow(b.x-a.x, 2)+pow(b.y-a.y, 2)) AS uy FROM p a JOIN p b ON a.g = b.g AND (a.x, a.y) < (b.x, b.y) JOIN p c ON b.g = c.g AND (b.x, b.y) < (c.x, c.y)) WHERE abs(d) > 1e-9), f AS (SELECT g, list(struct_pack(x := x, y := y)) AS pts FROM p GROUP BY g), h AS (SELECT k.g, cx, cy, r FROM k JOIN f USING (g) WHERE len(list_filter(pts, lambda q: sqrt(pow(q.x-cx, 2) + pow(q.y-cy, 2)) > r + 1e-7)) = 0) SELECT g, round(min(r), 5) AS radius, round(arg_min(cx, r), 4) AS cx, round(arg_min(cy, r), 4) AS cy FROM h GROUP BY g")
def enclosing_circle(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.col("p_size").alias("g"), (F.pmod(k * 37, F.lit(1000)) / 10.0).alias("x"), (F.pmod(k * 91, F.lit(1000)) / 10.0).alias("y"))
    c = shapes.enclosing_circle(p, "x", "y", ["g"])
    return c.select("g", F.round("radius", 5).alias("radius"), F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


@R.query("mode_fit")
def mode_fit(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return rounded(shapes.mode_fit(p, "l_extendedprice", ["flag"]), "mode", "std", digits=4)
