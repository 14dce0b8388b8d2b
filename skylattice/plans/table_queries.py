"""Registered queries of column, row, set and scalar-function operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions import sphere, text, times, units
from skylattice.functions.bits import BitDictionary
from skylattice.operators import tables as tb
from skylattice.plans.common import rounded
from skylattice.registry import Registry, table

R = Registry()


@R.query("query_expr", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size > 8 AND p_size < 30 AND NOT (p_retailprice = 950)")
def query_expr(spark, d):
    return tb.query(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size>8 & p_size<30 & ~(p_retailprice==950)")


@R.query("query_range", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 950 AND 1200")
def query_range(spark, d):
    return tb.query_range(table(spark, d, "part"), p_size=(10, 20), p_retailprice=(950, 1200)).select("p_partkey")


@R.query("query_fun", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000 OR s_nationkey < 3")
def query_fun(spark, d):
    return tb.query_fun(table(spark, d, "supplier"), {"s_acctbal": lambda c: c > 5000, "s_nationkey": lambda c: c < 3}, every=False).select("s_suppkey")


@R.query("find_ranges_flag", "SELECT p_partkey, CASE WHEN p_size BETWEEN 40 AND 50 THEN 3 WHEN p_size BETWEEN 5 AND 30 THEN 2 WHEN p_size BETWEEN 1 AND 10 THEN 1 ELSE 0 END AS range_no FROM part")
def find_ranges_flag(spark, d):
    return table(spark, d, "part").select("p_partkey", tb.last_range(F.col("p_size"), [(1, 10), (5, 30), (40, 50)]).alias("range_no"))


@R.query("in_range_all", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 30 AND p_size BETWEEN 20 AND 45")
def in_range_all(spark, d):
    return table(spark, d, "part").where(tb.in_ranges(F.col("p_size"), [(5, 30), (20, 45)])).select("p_partkey")


@R.query("and_or_nan", "SELECT o_orderkey, coalesce(a, true) AND coalesce(b, true) AS both_ok, coalesce(a, false) OR coalesce(b, false) AS any_ok FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice > 100000 END AS a, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey > 500 END AS b FROM orders)")
def and_or_nan(spark, d):
    o = table(spark, d, "orders")
    a, b = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") > 100000), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") > 500)
    return o.select("o_orderkey", tb.and_missing(a, b).alias("both_ok"), tb.or_missing(a, b).alias("any_ok"))


@R.query("replace_range", "SELECT s_suppkey, CASE WHEN s_acctbal BETWEEN -1000 AND 0 THEN 0.0 ELSE s_acctbal END AS bal FROM supplier")
def replace_range(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal").between(-1000, 0), 0.0).otherwise(F.col("s_acctbal")).alias("bal"))


@R.query("count_val", "SELECT count(*) FILTER (p_size = 7) AS n_eq, count(*) FILTER (p_size <> 7) AS n_ne FROM part")
def count_val(spark, d):
    return table(spark, d, "part").agg(F.count_if(F.col("p_size") == 7).alias("n_eq"), F.count_if(F.col("p_size") != 7).alias("n_ne"))


@R.query("select_rows", "SELECT i.pos, i.k AS p_partkey, p_name FROM (SELECT s_suppkey AS pos, s_suppkey*37 % 2200 AS k FROM supplier) i LEFT JOIN part ON p_partkey = i.k")
def select_rows(spark, d):
    index = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") * 37 % 2200).alias("p_partkey"))
    return tb.select_rows(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", index)


@R.query("insert_rows", "SELECT p_partkey, coalesce(s_acctbal, p_retailprice) AS v FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def insert_rows(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_acctbal").alias("v"))
    return tb.insert_rows(a, b, "p_partkey")


@R.query("insert_lines_fill", "SELECT p_partkey, s_acctbal AS v FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def insert_lines_fill(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_acctbal").alias("v"))
    return tb.insert_rows(a, b, "p_partkey", blank_others=True)


@R.query("crop_xy", "SELECT p_partkey, p_size - 9 AS x, p_retailprice - 949.0 AS y FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 950 AND 1300")
def crop_xy(spark, d):
    return tb.crop(table(spark, d, "part").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y")), "x", "y", (10, 30, 950.0, 1300.0))


@R.query("merge_union", "SELECT n_name AS name, n_nationkey AS k FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def merge_union(spark, d):
    return tb.merge([table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")), table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))], ["name", "k"])


@R.query("same_content", "SELECT true AS is_equal")
def same_content(spark, d):
    n = table(spark, d, "nation").select("n_name", "n_regionkey")
    return tb.same_content(n, n.orderBy(F.desc("n_name")))


@R.query("flipud", "SELECT n_name, (SELECT max(n_nationkey) FROM nation) - n_nationkey + 1 AS n_nationkey FROM nation")
def flipud(spark, d):
    return tb.flip(table(spark, d, "nation").select("n_name", "n_nationkey"), "n_nationkey")


@R.query("sortrows_topk", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def sortrows_topk(spark, d):
    return tb.top_k(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), 3, [F.desc("c_acctbal"), F.asc("c_custkey")], ["c_nationkey"])


@R.query("select_last", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def select_last(spark, d):
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", at).alias("last_order"), F.min_by("o_orderkey", at).alias("first_order"))


@R.query("delete_ind", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def delete_ind(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_nationkey"] == r["r_regionkey"], "left_anti").select("n_nationkey")


@R.query("header_pivot", "SELECT o_custkey AS file, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS O FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey")
def header_pivot(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("value"))
    return tb.header_table(o, ["F", "O"])


@R.query("group_by_key_val", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS first_member, max(o_orderkey) AS last_member FROM orders GROUP BY ALL")
def group_by_key_val(spark, d):
    return tb.group_numbers(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@R.query("unique_count", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand")
def unique_count(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n"))


@R.query("dictionary_codes", "SELECT DISTINCT p_type, dense_rank() OVER (ORDER BY p_type) AS code FROM part")
def dictionary_codes(spark, d):
    return tb.dense_codes(table(spark, d, "part"), "p_type", "code")


@R.query("get_val_alias", "SELECT e.event_id, coalesce(CASE WHEN event_type = 'click' THEN value END, CASE WHEN event_type = 'view' THEN value*2 END, -1.0) AS v FROM events e")
def get_val_alias(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("a"), F.when(F.col("event_type") == "view", F.col("value") * 2).alias("b"), F.lit(-1.0).alias("c"))
    return e.select("event_id", tb.alias_value(["a", "b", "c"]).alias("v"))


@R.query("insert_dedup", "SELECT s_suppkey AS k FROM supplier UNION ALL SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_dedup(spark, d):
    s, c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return s.unionByName(c.join(s, "k", "left_anti"))


@R.query("update_where", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE NOT coalesce(s_nationkey = 3, false)")
def update_where(spark, d):
    s = table(spark, d, "supplier").where(~F.coalesce(F.col("s_nationkey") == 3, F.lit(False)))
    return s.select("s_suppkey", F.when(F.col("s_acctbal") < 0, 0.0).otherwise(F.col("s_acctbal")).alias("s_acctbal"))


BITS = BitDictionary(("Saturated", "Dark", "Bright", "Hole", "Edge"))


@R.query("bitmask_any", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber & 5) <> 0")
def bitmask_any(spark, d):
    return table(spark, d, "lineitem").where(BITS.any_set(F.col("l_linenumber"), "Saturated", "Bright")).select("l_orderkey", "l_linenumber")


@R.query("bitmask_all", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber & 6) = 6")
def bitmask_all(spark, d):
    return table(spark, d, "lineitem").where(BITS.all_set(F.col("l_linenumber"), "Dark", "Bright")).select("l_orderkey", "l_linenumber")


@R.query("bitmask_set", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.05 THEN l_linenumber | 8 ELSE l_linenumber END AS m FROM lineitem")
def bitmask_set(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", BITS.set_where(F.col("l_linenumber"), F.col("l_tax") > 0.05, "Hole").alias("m"))


@R.query("bitdec2name", "SELECT p_partkey, concat_ws(',', CASE WHEN (p_size & 1) <> 0 THEN 'Saturated' END, CASE WHEN (p_size & 2) <> 0 THEN 'Dark' END, CASE WHEN (p_size & 4) <> 0 THEN 'Bright' END, CASE WHEN (p_size & 8) <> 0 THEN 'Hole' END, CASE WHEN (p_size & 16) <> 0 THEN 'Edge' END) AS names FROM part")
def bitdec2name(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(BITS.names_of(F.col("p_size")), ",").alias("names"))


@R.query("bit_stat", " UNION ALL ".join(f"SELECT '{n}' AS bit, count(*) FILTER ((p_size & {1 << i}) <> 0) AS n_set, count(*) FILTER ((p_size & {1 << i}) <> 0)/count(*) AS share FROM part" for i, n in enumerate(BITS.names)))
def bit_stat(spark, d):
    return BITS.stat(table(spark, d, "part"), "p_size")


@R.query("bit_reduce", "SELECT l_suppkey, bit_or(l_linenumber) AS b_or, bit_and(l_linenumber) AS b_and, bool_and(l_quantity > 1) AS all_q FROM lineitem GROUP BY l_suppkey")
def bit_reduce(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.bit_or("l_linenumber").alias("b_or"), F.bit_and("l_linenumber").alias("b_and"), F.bool_and(F.col("l_quantity") > 1).alias("all_q"))


# scalar functions over derived positions (radians) of customers

XY = "WITH q AS (SELECT c_custkey AS id, radians(mod(c_custkey*7919, 36000)/100.0) AS lon, radians(mod(c_custkey*104729, 17000)/100.0 - 85.0) AS lat, 1.5::DOUBLE AS l0, 0.25::DOUBLE AS b0 FROM customer) "


def _q(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.radians(F.pmod(k * 7919, F.lit(36000)) / 100.0).alias("lon"), F.radians(F.pmod(k * 104729, F.lit(17000)) / 100.0 - 85.0).alias("lat"), F.lit(1.5).alias("l0"), F.lit(0.25).alias("b0"))


ACOS = "acos(least(1.0, greatest(-1.0, sin(b0)*sin(lat)+cos(b0)*cos(lat)*cos(l0-lon))))"
PA = "atan2(sin(lon-l0)*cos(lat), cos(b0)*sin(lat)-sin(b0)*cos(lat)*cos(lon-l0))"
WRAP = "({x} - 6.283185307179586*floor(({x})/6.283185307179586))"


def _four():
    return F.col("l0"), F.col("b0"), F.col("lon"), F.col("lat")


@R.query("sphere_distance", XY + f"SELECT id, round({ACOS}, 6) AS dist, round({WRAP.format(x=PA)}, 6) AS pa FROM q")
def sphere_distance(spark, d):
    return _q(spark, d).select("id", F.round(sphere.sphere_dist(*_four()), 6).alias("dist"), F.round(sphere.position_angle(*_four()), 6).alias("pa"))


@R.query("sphere_offset_move", XY + f"SELECT id, round(x*sin(pa), 6) AS dx, round(x*cos(pa), 6) AS dy FROM (SELECT id, 2*asin(sqrt(least(1.0, pow(sin((lat-b0)/2),2)+cos(b0)*cos(lat)*pow(sin((lon-l0)/2),2)))) AS x, {PA} AS pa FROM q)")
def sphere_offset_move(spark, d):
    dx, dy = sphere.offset(*_four())
    return _q(spark, d).select("id", F.round(dx, 6).alias("dx"), F.round(dy, 6).alias("dy"))


def _rot_sql(m):
    v = ("cos(lat)*cos(lon)", "cos(lat)*sin(lon)", "sin(lat)")
    x, y, z = ("(" + "+".join(f"({c!r})*{e}" for c, e in zip(row, v, strict=True)) + ")" for row in m)
    return f"round({WRAP.format(x=f'atan2({y},{x})')}, 6) AS out_lon, round(atan2({z}, sqrt({x}*{x}+{y}*{y})), 6) AS out_lat"


def _rotated(spark, d, fn):
    lo, la = fn(F.col("lon"), F.col("lat"))
    return _q(spark, d).select("id", F.round(lo, 6).alias("out_lon"), F.round(la, 6).alias("out_lat"))


@R.query("to_galactic", XY + f"SELECT id, {_rot_sql(sphere.TO_GALACTIC)} FROM q")
def to_galactic(spark, d):
    return _rotated(spark, d, sphere.to_galactic)


@R.query("to_ecliptic", XY + f"SELECT id, {_rot_sql(sphere.ecliptic_matrix())} FROM q")
def to_ecliptic(spark, d):
    return _rotated(spark, d, sphere.to_ecliptic)


@R.query("precess", XY + f"SELECT id, {_rot_sql(sphere.precession_matrix(2460676.5))} FROM q")
def precess(spark, d):
    return _rotated(spark, d, lambda a, b: sphere.rotate(a, b, sphere.precession_matrix(2460676.5)))


@R.query("unit_vectors", XY + "SELECT id, round(cos(lat)*cos(lon), 6) AS x, round(cos(lat)*sin(lon), 6) AS y, round(sin(lat), 6) AS z FROM q")
def unit_vectors(spark, d):
    x, y, z = sphere.unit_vector(F.col("lon"), F.col("lat"))
    return _q(spark, d).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


@R.query("wrap_angles", XY + "SELECT id, round(CASE WHEN p > 3.141592653589793 THEN p - 6.283185307179586 ELSE p END, 6) AS w FROM (SELECT id, " + WRAP.format(x="(lon*3-7)") + " AS p FROM q)")
def wrap_angles(spark, d):
    return _q(spark, d).select("id", F.round(sphere.wrap_pi(F.col("lon") * 3 - 7), 6).alias("w"))


@R.query("horizontal", XY + f"SELECT id, round({WRAP.format(x='atan2(-cos(lat)*sin(lon), sin(lat)*cos(0.53)-cos(lat)*cos(lon)*sin(0.53))')}, 6) AS az, round(asin(sin(lat)*sin(0.53)+cos(lat)*cos(lon)*cos(0.53)), 6) AS alt FROM q")
def horizontal(spark, d):
    az, alt = sphere.altaz(F.col("lon"), F.col("lat"), 0.53)
    return _q(spark, d).select("id", F.round(az, 6).alias("az"), F.round(alt, 6).alias("alt"))


@R.query("projections", XY + "SELECT id, round(2*sqrt(2.0)*cos(lat)*sin(w/2)/sqrt(1+cos(lat)*cos(w/2)), 6) AS hx, round(sqrt(2.0)*sin(lat)/sqrt(1+cos(lat)*cos(w/2)), 6) AS hy FROM (SELECT *, CASE WHEN lon > 3.141592653589793 THEN lon - 6.283185307179586 ELSE lon END AS w FROM q)")
def projections(spark, d):
    x, y = sphere.hammer_aitoff(sphere.wrap_pi(F.col("lon")), F.col("lat"))
    return _q(spark, d).select("id", F.round(x, 6).alias("hx"), F.round(y, 6).alias("hy"))


@R.query("airmass_hardie", "SELECT p_partkey, round(1 + s - 0.0018167*s - 0.002875*s*s - 0.0008083*s*s*s, 6) AS am FROM (SELECT p_partkey, 1/cos(p_size/40.0) - 1 AS s FROM part)")
def airmass_hardie(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(sphere.hardie_airmass(F.col("p_size") / 40.0), 6).alias("am"))


@R.query("plane_geometry", "SELECT p_partkey, round(sqrt(pow(p_size-3.0,2)+pow(p_retailprice-900.0,2)), 6) AS dist, round(abs(0.5*p_size - p_retailprice + 2.0)/sqrt(1.25), 6) AS to_line FROM part")
def plane_geometry(spark, d):
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(sphere.plane_dist(F.lit(3.0), F.lit(900.0), x, y), 6).alias("dist"), F.round(sphere.line_dist(x, y, 0.5, 2.0), 6).alias("to_line"))


@R.query("affine2d", "SELECT p_partkey, round(2.0*p_size - 0.5*p_retailprice + 1.0, 6) AS x, round(0.5*p_size + 2.0*p_retailprice - 3.0, 6) AS y FROM part")
def affine2d(spark, d):
    x, y = sphere.affine(F.col("p_size"), F.col("p_retailprice"), [[2.0, -0.5, 1.0], [0.5, 2.0, -3.0]])
    return table(spark, d, "part").select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@R.query("date2jd", "SELECT o_orderkey, round(epoch_us(o_orderdate)/86400000000.0 + 2440587.5, 6) AS jd, round(epoch_us(o_orderdate)/86400000000.0 + 2440587.5 - 2400000.5, 6) AS mjd, round(2000 + (epoch_us(o_orderdate)/86400000000.0 + 2440587.5 - 2451545.0)/365.25, 6) AS jyear FROM orders")
def date2jd(spark, d):
    j = times.jd(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.round(j, 6).alias("jd"), F.round(times.mjd(j), 6).alias("mjd"), F.round(times.julian_year(j), 6).alias("jyear"))


@R.query("jd2date", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def jd2date(spark, d):
    j = times.jd(F.date_trunc("second", "ts"))
    return table(spark, d, "events").select("event_id", F.date_format(F.date_trunc("second", times.from_jd(j) + F.expr("INTERVAL '0.1' SECOND")), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@R.query("frac2hms", "SELECT p_partkey, floor(s/3600)::BIGINT AS h, (floor(s/60)::BIGINT % 60) AS m, round(s - floor(s/60)*60, 6) AS sec FROM (SELECT p_partkey, ((p_partkey*7919 % 10000)/10000.0)*86400 AS s FROM part)")
def frac2hms(spark, d):
    h, m, s = times.hms((F.col("p_partkey") * 7919 % 10000) / 10000.0)
    return table(spark, d, "part").select("p_partkey", h.alias("h"), m.alias("m"), F.round(s, 6).alias("sec"))


@R.query("sidereal_time", "SELECT o_orderkey, round(x - floor(x), 5) AS lst FROM (SELECT o_orderkey, (280.46061837 + 360.98564736629*(j-2451545.0))/360 AS x FROM (SELECT o_orderkey, epoch_us(o_orderdate)/86400000000.0 + 2440587.5 AS j FROM orders))")
def sidereal_time(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(times.sidereal(times.jd(F.col("o_orderdate"))), 5).alias("lst"))


LEAP_SQL = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in times.LEAP_SECONDS) + ") l(j0, sec)"


@R.query("tai_utc", f"SELECT o_orderkey, (SELECT arg_max(sec, j0) FROM {LEAP_SQL} WHERE j0 <= epoch_us(o_orderdate)/86400000000.0 + 2440587.5)::INT AS leap FROM orders")
def tai_utc(spark, d):
    return table(spark, d, "orders").select("o_orderkey", times.tai_utc(times.jd(F.col("o_orderdate"))).alias("leap"))


@R.query("days_in_month", "SELECT o_orderkey, day(last_day(o_orderdate))::INT AS n_days FROM orders")
def days_in_month(spark, d):
    return table(spark, d, "orders").select("o_orderkey", times.days_in_month(F.col("o_orderdate")).alias("n_days"))


@R.query("unit_conversion", "SELECT p_partkey, round(p_size*180/3.141592653589793*3600, 4) AS arcsec, round(p_size*1000/86400.0*1.0, 9) AS rate FROM part")
def unit_conversion(spark, d):
    f = units.factor(units.ANGLE, "rad", "arcsec")
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_size") * f, 4).alias("arcsec"), F.round(F.col("p_size") * units.unit_factor("km*day^-1", "m/s"), 9).alias("rate"))


@R.query("flux2mag", "SELECT l_orderkey, l_linenumber, round(25.0 - 2.5*log10(l_extendedprice), 6) AS mag FROM lineitem")
def flux2mag(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(units.flux_to_mag(F.col("l_extendedprice"), 25.0), 6).alias("mag"))


@R.query("luptitude", "SELECT s_suppkey, round(-2.5/ln(10.0)*(asinh(s_acctbal/1000.0/(2*0.01)) + ln(0.01)), 6) AS lup FROM supplier")
def luptitude(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.round(units.luptitude(F.col("s_acctbal"), 1000.0, 0.01), 6).alias("lup"))


@R.query("sum_mag", "SELECT l_suppkey, round(-2.5*log10(sum(pow(10.0, -0.4*l_quantity/10))), 6) AS mag FROM lineitem GROUP BY l_suppkey")
def sum_mag(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(units.sum_mag(F.col("l_quantity") / 10), 6).alias("mag"))


@R.query("string_functions", "SELECT p_partkey, regexp_replace(p_name, '\\s+', '', 'g') AS no_space, trim(regexp_replace(p_name, ' +', ' ', 'g')) AS one_space, p_name = lower(p_name) AS lower_case, concat('x_', p_brand) AS prefixed FROM part")
def string_functions(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", text.without_spaces(n).alias("no_space"), text.single_spaces(n).alias("one_space"), text.is_lower(n).alias("lower_case"), F.concat(F.lit("x_"), "p_brand").alias("prefixed"))


@R.query("str2num", "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(v, '^\\s*([+-]?[0-9]+)', 1), '') AS DOUBLE) AS num FROM (SELECT p_partkey, substr(p_brand, 7) AS v FROM part)")
def str2num(spark, d):
    v = text.leading_number(F.substring("p_brand", 7, 20))
    return table(spark, d, "part").select("p_partkey", F.when(~F.isnan(v), v).alias("num"))


@R.query("string_search", "SELECT count(*) FILTER (lower(o_orderpriority) = '1-urgent') AS n_exact, count(*) FILTER (regexp_matches(o_orderpriority, '(?i)^[23]-')) AS n_regexp FROM orders")
def string_search(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").agg(F.count_if(text.search_flag(p, "1-urgent", case=False)).alias("n_exact"), F.count_if(text.search_flag(p, "^[23]-", True, False)).alias("n_regexp"))


@R.query("sexagesimal_round_trip", XY + "SELECT id, round(degrees(lat), 4) AS deg FROM q")
def sexagesimal_round_trip(spark, d):
    return _q(spark, d).select("id", F.round(text.from_sexagesimal(text.sexagesimal(F.degrees("lat"))), 4).alias("deg"))
