"""Registered queries over ordered rows: runs, gaps, light curves, periods, events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.operators import events as ev
from skylattice.operators import sequence as sq
from skylattice.operators import timeseries as ts
from skylattice.plans.common import DAY_SQL, EV_SQL, LC_SQL, day, event_times, light_curve, rounded
from skylattice.registry import Registry, table

R = Registry()
LC, EV = f"WITH {LC_SQL} ", f"WITH {EV_SQL} "


@R.query("group_counter", "WITH o AS (SELECT DISTINCT o_custkey AS k, o_orderkey//4 AS c FROM orders), g AS (SELECT k, c, c - row_number() OVER (PARTITION BY k ORDER BY c) AS g FROM o), p AS (SELECT k, g, c, floor((row_number() OVER (PARTITION BY k, g ORDER BY c)-1)/3) AS part FROM g) SELECT k, min(c) AS first_c, max(c) AS last_c, count(*) AS n FROM p GROUP BY k, g, part HAVING count(*) >= 1")
def group_counter(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.floor(F.col("o_orderkey") / 4).alias("c"))
    return sq.counter_runs(o, "c", ["k"], 1, 3)


@R.query("group_time_gaps", EV + "SELECT user_id, min(s) AS t_start, max(s) AS t_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS grp FROM (SELECT *, coalesce((s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 3600)::INT, 0) AS new FROM ev)) GROUP BY user_id, grp HAVING count(*) >= 2")
def group_time_gaps(spark, d):
    return sq.time_gap_groups(event_times(spark, d), "s", ["user_id"], 3600.0, 2, "event_id").drop("grp")


@R.query("flag_regions", "WITH r AS (SELECT l_orderkey AS k, l_linenumber AS p, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20)) SELECT k, min(p) AS first_pos, max(p) AS last_pos FROM r GROUP BY k, g")
def flag_regions(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("p")).distinct()
    return sq.flag_regions(li, "p", F.lit(True), ["k"])


@R.query("runmean", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)/5, 4) AS rm FROM orders")
def runmean(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(sq.running_mean("o_totalprice", 2, w), 4).alias("rm"))


@R.query("running_extent", "SELECT o_orderkey, max(o_totalprice) OVER w - min(o_totalprice) OVER w AS extent, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def running_extent(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-3, 0)
    return table(spark, d, "orders").select("o_orderkey", (F.max("o_totalprice").over(w) - F.min("o_totalprice").over(w)).alias("extent"), F.count("*").over(w).alias("n"))


@R.query("von_neumann", LC + "SELECT source, round(n*ss/((n-1)*v*(n-1)), 6) AS von_neumann FROM (SELECT source, count(flux) AS n, sum(step*step) AS ss, var_samp(flux) AS v FROM (SELECT source, flux, flux - lag(flux) OVER (PARTITION BY source ORDER BY t, id) AS step FROM lc) GROUP BY source)")
def von_neumann(spark, d):
    return rounded(sq.von_neumann(light_curve(spark, d), "t,id", "flux", ["source"]), "von_neumann")


@R.query("trapz", LC + "SELECT source, round(coalesce(sum(a), 0), 2) AS integral FROM (SELECT source, abs(lead(t) OVER w - t)*(flux + lead(flux) OVER w)/2 AS a FROM lc WINDOW w AS (PARTITION BY source ORDER BY t, id)) GROUP BY source")
def trapz(spark, d):
    return rounded(sq.trapezoid(light_curve(spark, d), "t", "flux", ["source"], ["id"]), "integral", digits=2)


@R.query("curve_length", LC + "SELECT source, round(coalesce(sum(sqrt(dx*dx+dy*dy)), 0), 2) AS length FROM (SELECT source, t - lag(t) OVER w AS dx, flux - lag(flux) OVER w AS dy FROM lc WINDOW w AS (PARTITION BY source ORDER BY t, id)) GROUP BY source")
def curve_length(spark, d):
    return rounded(sq.curve_length(light_curve(spark, d), "t", "flux", ["source"], ["id"]), "length", digits=2)


DAILY = LC + ", dd AS (SELECT source, floor(t/30)::BIGINT AS e, avg(flux) AS f FROM lc GROUP BY 1, 2) "


def _epochs(spark, d):
    return light_curve(spark, d).groupBy("source", F.floor(F.col("t") / 30).alias("e")).agg(F.avg("flux").alias("f"))


@R.query("local_extrema", DAILY + "SELECT source, e, kind FROM (SELECT source, e, CASE WHEN f > lag(f) OVER w AND f > lead(f) OVER w THEN 'max' WHEN f < lag(f) OVER w AND f < lead(f) OVER w THEN 'min' END AS kind FROM dd WINDOW w AS (PARTITION BY source ORDER BY e)) WHERE kind IS NOT NULL")
def local_extrema(spark, d):
    return sq.local_extrema(_epochs(spark, d), "e", "f", ["source"]).select("source", "e", "kind")


@R.query("zero_crossings", DAILY + ", z AS (SELECT source, e, f - avg(f) OVER (PARTITION BY source) AS y FROM dd) SELECT source, round(e0 - y0*(e-e0)/(y-y0), 6) AS root FROM (SELECT *, lag(e) OVER w AS e0, lag(y) OVER w AS y0 FROM z WINDOW w AS (PARTITION BY source ORDER BY e)) WHERE y0*y < 0")
def zero_crossings(spark, d):
    z = _epochs(spark, d).withColumn("y", F.col("f") - F.avg("f").over(Window.partitionBy("source")))
    return rounded(sq.zero_crossings(z, "e", "y", ["source"]), "root")


@R.query("interp_nan", DAILY + ", m AS (SELECT source, e, CASE WHEN e % 3 > 0 THEN f END AS f FROM dd), k AS (SELECT source, e, f, last_value(CASE WHEN f IS NOT NULL THEN {'x': e, 'y': f} END IGNORE NULLS) OVER (PARTITION BY source ORDER BY e ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN f IS NOT NULL THEN {'x': e, 'y': f} END IGNORE NULLS) OVER (PARTITION BY source ORDER BY e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM m) SELECT source, e, round(coalesce(f, a.y + (b.y-a.y)*(e-a.x)/(b.x-a.x)), 7) AS f FROM k")
def interp_nan(spark, d):
    m = _epochs(spark, d).withColumn("f", F.when(F.col("e") % 3 != 0, F.col("f")))
    return sq.fill_linear(m, "e", "f", ["source"]).select("source", "e", F.round("filled", 7).alias("f"))


@R.query("uniform_resample", DAILY + ", g AS (SELECT source, unnest(range(ceil(min(e)/2.0)::BIGINT, floor(max(e)/2.0)::BIGINT + 1))*2 + 0.5 AS x FROM dd GROUP BY source), p AS (SELECT g.source, g.x, a.e AS ea, a.f AS fa FROM g ASOF LEFT JOIN dd a ON g.source = a.source AND g.x >= a.e), q AS (SELECT p.*, b.e AS eb, b.f AS fb FROM p ASOF LEFT JOIN dd b ON p.source = b.source AND p.x <= b.e) SELECT source, x::DOUBLE AS e, round(fa + (fb-fa)*(x-ea)/(eb-ea), 7) AS f FROM q")
def uniform_resample(spark, d):
    e = _epochs(spark, d).select("source", F.col("e").cast("double").alias("e"), "f")
    grid = e.groupBy("source").agg(F.min("e").alias("a"), F.max("e").alias("b")).select("source", F.explode(F.sequence(F.ceil(F.col("a") / 2), F.floor(F.col("b") / 2))).alias("k")).select("source", (F.col("k") * 2 + 0.5).alias("e"))
    return rounded(sq.interpolate_at(e, grid, "e", "f", ["source"]), "f", digits=7)


@R.query("asof_nearest", "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def asof_nearest(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), F.col("ts").alias("t"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return sq.asof(e, o, "t", ["k"], "o_orderkey").select("event_id", "o_orderkey")


@R.query("fold_phase", LC + "SELECT id, round(x - floor(x), 6) AS phase FROM (SELECT id, (t - m)/37.3 AS x FROM lc JOIN (SELECT source, median(t) AS m FROM lc GROUP BY source) USING (source))")
def fold_phase(spark, d):
    return ts.fold(light_curve(spark, d), "t", 37.3, ["source"]).select("id", F.round("phase", 6).alias("phase"))


@R.query("extract_phase", LC + "SELECT id FROM (SELECT id, (t - 0.5)/37.3 - floor((t - 0.5)/37.3) AS p FROM lc) WHERE p >= 0.9003 OR p <= 0.1003")
def extract_phase(spark, d):
    return ts.extract_phase(light_curve(spark, d), "t", 0.5, 37.3, 0.9003, 0.1003).select("id")


FREQS = [0.01 * k for k in range(1, 21)]
FSQL = "(VALUES " + ", ".join(f"({f!r}::DOUBLE)" for f in FREQS) + ") q(freq)"
CENTRED = LC + f", c AS (SELECT source, t, flux, flux - avg(flux) OVER (PARTITION BY source) AS m FROM lc), st AS (SELECT source, var_samp(flux) AS var, count(*) AS n FROM c GROUP BY source), f AS (SELECT * FROM c, {FSQL}) "


@R.query("periodogram", CENTRED + "SELECT source, round(freq, 4) AS freq, round((pow(sum(m*cos(2*pi()*freq*t)),2)+pow(sum(m*sin(2*pi()*freq*t)),2))/any_value(n)/any_value(var), 5) AS power FROM f JOIN st USING (source) GROUP BY source, freq")
def periodogram(spark, d):
    return ts.periodogram(light_curve(spark, d), "t", "flux", ["source"], FREQS).select("source", F.round("freq", 4).alias("freq"), F.round("power", 5).alias("power"))


@R.query("scargle", CENTRED + ", tau AS (SELECT source, freq, atan2(sum(sin(4*pi()*freq*t)), sum(cos(4*pi()*freq*t)))/(4*pi()*freq) AS tau FROM f GROUP BY source, freq) SELECT source, round(freq, 4) AS freq, round(0.5*(pow(sum(m*cos(2*pi()*freq*(t-tau))),2)/sum(pow(cos(2*pi()*freq*(t-tau)),2)) + pow(sum(m*sin(2*pi()*freq*(t-tau))),2)/sum(pow(sin(2*pi()*freq*(t-tau)),2)))/any_value(var), 5) AS power FROM f JOIN tau USING (source, freq) JOIN st USING (source) GROUP BY source, freq")
def scargle(spark, d):
    return ts.scargle(light_curve(spark, d), "t", "flux", ["source"], FREQS).select("source", F.round("freq", 4).alias("freq"), F.round("power", 5).alias("power"))


@R.query("pdm", CENTRED + ", b AS (SELECT source, freq, floor((t*freq - floor(t*freq))*8) AS b, flux FROM f), w AS (SELECT source, freq, b, count(*) AS n, coalesce(var_samp(flux), 0) AS v FROM b GROUP BY ALL) SELECT source, round(freq, 4) AS freq, round(sum((n-1)*v)/(any_value(var)*(sum(n)-1)), 5) AS theta FROM w JOIN (SELECT source, var FROM st) USING (source) GROUP BY source, freq")
def pdm(spark, d):
    return ts.pdm(light_curve(spark, d), "t", "flux", ["source"], FREQS, 8).select("source", F.round("freq", 4).alias("freq"), F.round("theta", 5).alias("theta"))


@R.query("phase_entropy", LC + f", r AS (SELECT source, min(flux) AS lo, max(flux) AS hi, count(*) AS n FROM lc GROUP BY 1), c AS (SELECT source, freq, count(*)/any_value(n) AS p FROM (SELECT source, freq, n, floor((t*freq-floor(t*freq))*5) AS i, least(4, floor((flux-lo)/(hi-lo)*5)) AS j FROM lc JOIN r USING (source), {FSQL}) GROUP BY source, freq, i, j) SELECT source, round(freq, 4) AS freq, round(-sum(p*ln(p)), 6) AS entropy FROM c GROUP BY source, freq")
def phase_entropy(spark, d):
    return ts.phase_entropy(light_curve(spark, d), "t", "flux", ["source"], FREQS, 5).select("source", F.round("freq", 4).alias("freq"), F.round("entropy", 6).alias("entropy"))


@R.query("string_length", LC + f", p AS (SELECT source, freq, t*freq - floor(t*freq) AS ph, flux FROM lc, {FSQL}) SELECT source, round(freq, 3) AS freq, round(sum(l), 1) AS length FROM (SELECT source, freq, sqrt(pow(ph - lag(ph) OVER w, 2) + pow(flux - lag(flux) OVER w, 2)) AS l FROM p WINDOW w AS (PARTITION BY source, freq ORDER BY ph, flux)) GROUP BY source, freq")
def string_length(spark, d):
    s = ts.string_length(light_curve(spark, d), "t", "flux", ["source"], FREQS)
    return s.select("source", F.round("freq", 3).alias("freq"), F.round("length", 1).alias("length"))


DAYS = f"WITH a AS (SELECT {DAY_SQL.format(c='o_orderdate')} AS t, avg(o_totalprice) AS flux FROM orders GROUP BY 1), b AS (SELECT {DAY_SQL.format(c='l_shipdate')} AS t, avg(l_extendedprice) AS flux FROM lineitem GROUP BY 1)"


@R.query("ccf_pairs", DAYS + ", s AS (SELECT (SELECT avg(flux) FROM a) AS am, (SELECT stddev_pop(flux) FROM a) AS sa, (SELECT avg(flux) FROM b) AS bm, (SELECT stddev_pop(flux) FROM b) AS sb) SELECT round((b.t-a.t)/10.0)::BIGINT AS lag_bin, round(avg((a.flux-am)*(b.flux-bm)/(sa*sb)), 6) AS dcf, round(avg(pow((b.flux-a.flux)/1000, 2)), 3) AS sf, count(*) AS n_pairs FROM a, b, s WHERE abs(b.t-a.t) <= 95.3 GROUP BY 1")
def ccf_pairs(spark, d):
    """Daily means of the orders and of the shipments."""
    a = table(spark, d, "orders").groupBy(day("o_orderdate").alias("t")).agg(F.avg("o_totalprice").alias("flux"))
    b = table(spark, d, "lineitem").groupBy(day("l_shipdate").alias("t")).agg(F.avg("l_extendedprice").alias("flux"))
    c = ts.dcf(a, b, "t", "flux", 10.0, 95.3)
    return c.select("lag_bin", F.round("dcf", 6).alias("dcf"), F.round(F.col("sf") / 1e6, 3).alias("sf"), "n_pairs")


@R.query("orphans", LC + "SELECT source, count(DISTINCT floor(t/365)) AS n_det FROM lc WHERE flux > 80000 GROUP BY source HAVING count(DISTINCT floor(t/365)) BETWEEN 1 AND 5")
def orphans(spark, d):
    return ts.orphans(light_curve(spark, d).where("flux > 80000").withColumn("e", F.floor(F.col("t") / 365)), "source", "e", 5)


@R.query("orphans_clean", LC + ", g AS (SELECT source, floor(t/365)::BIGINT AS e, avg(flux/err) AS s FROM lc WHERE flux > 97000 GROUP BY 1, 2) SELECT source, count(*) AS n_det, round(avg(s), 6) AS mean_snr FROM g GROUP BY source HAVING count(*) <= 3 AND max(e)-min(e)+1 = count(*) AND avg(s) >= greatest(9-count(*), 5)")
def orphans_clean(spark, d):
    lc = light_curve(spark, d).where("flux > 97000").withColumn("e", F.floor(F.col("t") / 365)).withColumn("snr", F.col("flux") / F.col("err"))
    return rounded(ts.clean_orphans(lc, "source", "e", "snr"), "mean_snr")


MAG = LC + ", m AS (SELECT source, floor(t/365)::BIGINT AS e, avg(25-2.5*log10(flux)) AS mag FROM lc GROUP BY 1, 2) "


def _mags(spark, d):
    return light_curve(spark, d).groupBy("source", F.floor(F.col("t") / 365).alias("e")).agg(F.avg(25 - 2.5 * F.log10("flux")).alias("mag"))


@R.query("zp_meddiff", MAG + "SELECT m.e, round(median(m.mag - r.mag), 6) AS zp, count(*) AS n FROM m JOIN m r ON r.source = m.source AND r.e = (SELECT min(e) FROM m) GROUP BY m.e")
def zp_meddiff(spark, d):
    m = _mags(spark, d)
    return rounded(ts.zero_points(m, "source", "e", "mag", m.agg(F.min("e")).first()[0]), "zp")


@R.query("apply_zp", MAG + ", z AS (SELECT e, avg(mag) AS zp FROM m GROUP BY e) SELECT source, e, round(mag - zp, 6) AS mag FROM m JOIN z USING (e)")
def apply_zp(spark, d):
    m = _mags(spark, d)
    z = m.groupBy("e").agg(F.avg("mag").alias("zp"))
    return m.join(z, "e").select("source", "e", F.round(F.col("mag") - F.col("zp"), 6).alias("mag"))


@R.query("rms_mag", MAG + "SELECT source, round(avg(mag), 6) AS mean, round(stddev_samp(mag), 6) AS rms FROM m GROUP BY source")
def rms_mag(spark, d):
    return _mags(spark, d).groupBy("source").agg(F.round(F.avg("mag"), 6).alias("mean"), F.round(F.stddev_samp("mag"), 6).alias("rms"))


@R.query("stat_summary", LC + "SELECT source, round(avg(flux), 4) AS mean, median(flux) AS median, round(stddev_samp(flux), 4) AS std, round((quantile_cont(flux, 0.75)-quantile_cont(flux, 0.25))/2*1.4826, 4) AS rstd, max(flux)-min(flux) AS range, min(flux) AS min, max(flux) AS max, count(flux) AS n_obs FROM lc GROUP BY source")
def stat_summary(spark, d):
    return rounded(ts.stat_summary(light_curve(spark, d), "source", "flux"), "mean", "std", "rstd", digits=4)


@R.query("not_nan_sources", LC + "SELECT source, bool_and(flags <> 4 OR flux > 2000) AS complete FROM lc GROUP BY source")
def not_nan_sources(spark, d):
    v = F.when((F.col("flags") != 4) | (F.col("flux") > 2000), F.col("flux"))
    return light_curve(spark, d).groupBy("source").agg(F.bool_and(v.isNotNull()).alias("complete"))


@R.query("matched2matrix", MAG + "SELECT source, count(*) AS n_epochs, string_agg(e::BIGINT || ':' || round(mag*1e4)::BIGINT, ',' ORDER BY e) AS cells FROM (SELECT source, e, max(mag) AS mag FROM m WHERE mag IS NOT NULL AND e IS NOT NULL GROUP BY ALL) GROUP BY source")
def matched2matrix(spark, d):
    """A row of the matrix for each source: its epochs in order with the magnitude (1e-4) of each; no epoch list goes to the driver."""
    m = _mags(spark, d).where("mag is not null and e is not null").groupBy("source", F.col("e").cast("bigint").alias("e")).agg(F.max("mag").alias("mag"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("e", F.round(F.col("mag") * 1e4).cast("bigint").alias("v")))), lambda x: F.concat(x["e"].cast("string"), F.lit(":"), x["v"].cast("string")))
    return m.groupBy("source").agg(F.count("*").alias("n_epochs"), F.array_join(cells, ",").alias("cells"))


@R.query("fit_motion", LC + "SELECT source, round(regr_slope(flux, t), 6) AS rate, round(avg(flux), 4) AS mean, count(*) AS n, round(pow(regr_sxy(flux, t), 2)/regr_sxx(flux, t)/1e6, 3) AS d_chi2 FROM lc GROUP BY source HAVING count(*) >= 3")
def fit_motion(spark, d):
    m = ts.fit_motion(light_curve(spark, d), "source", "t", "flux", 1000.0)
    return m.select("source", F.round("rate", 6).alias("rate"), F.round("mean", 4).alias("mean"), "n", F.round("d_chi2", 3).alias("d_chi2"))


@R.query("detrend", LC + "SELECT id, round(flux - y - b*(t - x), 3) AS resid FROM lc JOIN (SELECT source, regr_slope(flux, t) AS b, avg(flux) AS y, avg(t) AS x FROM lc GROUP BY source) USING (source)")
def detrend(spark, d):
    return ts.detrend(light_curve(spark, d), "t", "flux", ["source"]).select("id", F.round("resid", 3).alias("resid"))


ROUNDS = ["a0 AS (SELECT source, avg(mag) AS mean FROM m GROUP BY source)"]
for _k in range(4):
    ROUNDS.append(f"z{_k} AS (SELECT e, avg(mag - mean) AS zp FROM m JOIN a{_k} USING (source) GROUP BY e)")
    ROUNDS.append(f"a{_k + 1} AS (SELECT source, avg(mag - zp) AS mean FROM m JOIN z{_k} USING (e) GROUP BY source)")


@R.query("relative_photometry", MAG + ", " + ", ".join(ROUNDS) + " SELECT e, round(zp, 6) AS zp FROM z3")
def relative_photometry(spark, d):
    zps, _ = ts.relative_photometry(_mags(spark, d), "source", "e", "mag")
    return rounded(zps, "zp")


RANK_ONE = ["r AS (SELECT source, e, mag - (SELECT avg(mag) FROM m) AS r FROM m)", "k0 AS (SELECT DISTINCT e, 1.0::DOUBLE AS a FROM r)"]
for _k in range(3):
    RANK_ONE.append(f"c{_k} AS (SELECT source, sum(r*a)/nullif(sum(a*a), 0) AS c FROM r JOIN k{_k} USING (e) GROUP BY source)")
    RANK_ONE.append(f"k{_k + 1} AS (SELECT e, sum(r*c)/nullif(sum(c*c), 0) AS a FROM r JOIN c{_k} USING (source) GROUP BY e)")


@R.query("sysrem", MAG + ", " + ", ".join(RANK_ONE) + " SELECT source, e, round(r - c*a, 6) AS clean FROM r JOIN c2 USING (source) JOIN k3 USING (e)")
def sysrem(spark, d):
    m = _mags(spark, d)
    # residuals of a mean that is the same for all: those of every source's own mean have no first part to find
    r = m.join(F.broadcast(m.agg(F.avg("mag").alias("a")))).select("source", "e", (F.col("mag") - F.col("a")).alias("resid"), F.lit(0.1).alias("sigma"))
    return rounded(ts.sysrem(r, "source", "e", "resid", "sigma").select("source", "e", "clean"), "clean")


@R.query("structure_function", LC + "SELECT floor((b.t-a.t)/20.0)::BIGINT AS lag_bin, round(avg(pow(b.flux-a.flux, 2)), 0) AS sf, count(*) AS n_pairs FROM lc a JOIN lc b ON a.source = b.source AND b.t > a.t AND b.t - a.t <= 100.0 GROUP BY 1")
def structure_function(spark, d):
    s = ts.structure_function(light_curve(spark, d), "t", "flux", ["source"], 20.0, 100.0)
    return rounded(s, "sf", digits=0)


# events

@R.query("bad_times", EV + ", r AS (SELECT min(s) AS t0, max(s) AS t1, greatest(30.0, 100*(max(s)-min(s))/count(*)) AS step FROM ev), c AS (SELECT floor((s-t0)/step)::BIGINT AS bin, count(*) AS c FROM ev, r GROUP BY 1), f AS (SELECT b.bin, coalesce(c, 0) AS c FROM (SELECT unnest(range(0, (SELECT floor((t1-t0)/step)::BIGINT FROM r))) AS bin) b LEFT JOIN c USING (bin)) SELECT round(t0+bin*step, 3) AS lo, round(t0+(bin+1)*step, 3) AS hi, c AS n FROM f, r WHERE c > (SELECT median(c) + 1.0*sqrt(median(c)) FROM f)")
def bad_times(spark, d):
    return rounded(ev.bad_times(event_times(spark, d), "s", n_sigma=1.0), "lo", "hi", digits=3)


@R.query("remove_bad_times", EV + "SELECT event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM (SELECT s AS lo, s + 600.0 AS hi FROM ev WHERE event_type = 'error') b WHERE ev.s BETWEEN lo AND hi)")
def remove_bad_times(spark, d):
    e = event_times(spark, d)
    bad = ev.united(e.where("event_type = 'error'"), "s", 600.0)
    hit = sq.interval_join(e, bad, "s", "lo", "hi", 600.0).select("event_id").distinct()
    return e.join(hit, "event_id", "left_anti").select("event_id")


@R.query("select_energy", EV + "SELECT event_id FROM ev WHERE (value > 1.0 AND value < 5.0) OR (value > 20.0 AND value < 22.5)")
def select_energy(spark, d):
    return event_times(spark, d).where(ev.select_energy(F.col("value"), [(1.0, 5.0), (20.0, 22.5)])).select("event_id")


@R.query("events2image", EV + "SELECT floor(value/5.0)::BIGINT AS ix, floor(user_id/5.0)::BIGINT AS iy, count(*) AS n FROM ev GROUP BY 1, 2")
def events2image(spark, d):
    return ev.image(event_times(spark, d), "value", "user_id", 5.0)


@R.query("nphotons", EV + "SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_good FROM ev")
def nphotons(spark, d):
    return ev.counts(event_times(spark, d), F.col("event_type") != "error")


@R.query("period_events", EV + ", c AS (SELECT floor((s/86400.0 - floor(s/86400.0))*12) AS b, count(*) AS c FROM ev GROUP BY 1) SELECT round(sum(c*c)*12.0/sum(c) - sum(c), 6) AS chi2, 11 AS dof FROM c")
def period_events(spark, d):
    return rounded(ev.folded_chi2(event_times(spark, d), "s", 86400.0, 12), "chi2")


ORACLE_TUMBLING = "SELECT event_type, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS w, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL"


@R.query("tumbling_windows", ORACLE_TUMBLING)
def tumbling_windows(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return e.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("w"), "n", "v")


@R.query("session_windows", EV + "SELECT user_id, round(min(s), 3) AS t_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS g FROM (SELECT *, coalesce((s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) >= 1800)::INT, 0) AS new FROM ev)) GROUP BY user_id, g")
def session_windows(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.count("*").alias("n"))
    return e.select("user_id", F.round("t", 3).alias("t_start"), "n")
