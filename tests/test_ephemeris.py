"""Term tables against published values, lookups in tables of times against numpy."""

import math

import numpy as np
import pytest
from oracle import compare

from skylattice.operators import ephemeris as ep
from skylattice.queries import ORACLE, QUERIES


def test_nutation_of_a_published_day(spark):
    # fixed values: 1987 April 10.0, in arcseconds
    r = ep.nutation(spark.createDataFrame([(2446895.5,)], "jd double"), "jd").first()
    assert abs(math.degrees(r.psi) * 3600 + 3.788) < 6e-4 and abs(math.degrees(r.eps) * 3600 - 9.443) < 6e-4
    assert abs(math.degrees(r.tilt) * 3600 - (23 * 3600 + 26 * 60 + 27.407)) < 6e-4


def test_turn_keeps_angles_and_matches_first_order(spark):
    rows = [(1, 2446895.5, 0.3, 0.4), (2, 2446895.5, 1.3, -0.9), (3, 2446895.5, 0.0, math.pi / 2), (4, None, 0.1, 0.1)]
    d = ep.true_of_date(spark.createDataFrame(rows, "id int, jd double, lon double, lat double"), "jd", "lon", "lat", "a", "b")
    assert d.columns == ["id", "jd", "lon", "lat", "a", "b"]
    got = {r.id: r for r in d.collect()}
    unit = lambda a, b: np.array([math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)])
    before, after = ([unit(*(r.lon, r.lat) if k == 0 else (r.a, r.b)) for r in (got[1], got[2], got[3])] for k in (0, 1))
    for i in range(3):
        for j in range(3):
            assert np.isclose(before[i] @ before[j], after[i] @ after[j], atol=1e-12)
    psi, eps, tilt = (math.radians(x / 3600) for x in (-3.788, 9.443, 84387.407))
    r = got[1]
    shift = psi * (math.cos(tilt) + math.sin(tilt) * math.sin(r.lon) * math.tan(r.lat)) - eps * math.cos(r.lon) * math.tan(r.lat)
    assert abs(r.a - r.lon - shift) < 1e-8 and abs(r.b - r.lat - psi * math.sin(tilt) * math.cos(r.lon) - eps * math.sin(r.lon)) < 1e-8
    assert got[4].a is None and got[4].b is None


def test_earth_of_a_published_time(spark):
    # fixed values: barycentric place and motion at 2453412.52501161 (astronomical units, days)
    d = spark.createDataFrame([(2453412.02501161,), (None,)], "jd double")
    r, none = ep.earth(d, "jd").collect()
    assert np.allclose(r.earth[:3], (-0.77141044404911, 0.55984120618242, 0.24259962777225), atol=1e-4)
    assert np.allclose(r.earth[3:], (-0.01091874268117, -0.01246525461733, -0.00540477318097), atol=2e-6)
    assert none.earth is None


def test_light_time_stays_within_the_orbit(spark):
    rows = [(float(2440000 + 37 * k), 0.1 * k, 0.02 * k - 1) for k in range(100)]
    for r in ep.barycentric(spark.createDataFrame(rows, "jd double, lon double, lat double"), "jd", "lon", "lat").collect():
        assert abs(r.delay) < 515 and abs(r.velocity) < 31
    pole = spark.createDataFrame([(2451545.0 + 30.4 * k, 0.0, math.pi / 2 - math.radians(23.43928)) for k in range(12)], "jd double, lon double, lat double")
    near = ep.barycentric(pole.selectExpr("jd", "radians(270.0) lon", "lat"), "jd", "lon", "lat").collect()
    # towards the pole of the ecliptic nothing but the Sun's own offset is left
    assert max(abs(r.delay) for r in near) < 0.5 and max(abs(r.velocity) for r in near) < 0.05


@pytest.mark.parametrize("few", [ep.FEW, 0])
def test_lookup_in_a_table_of_times(spark, monkeypatch, few):
    monkeypatch.setattr(ep, "FEW", few)
    known = [(float(i), float(i * i)) for i in (1, 2, 3, 5, 9, 40)] + [(3.0, 11.0), (None, 1.0), (4.0, None)]
    times = [0.5, 1.0, 1.5, 3.0, 4.0, 8.9, 9.0, 9.1, 39.9, 40.0, 40.1, -3.0, None] + [2.5] * 50
    k = spark.createDataFrame(known, "a double, u double")
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(times)], "id long, t double, u string")
    out = ep.from_table(rows, "t", k, "a", "u", 1.0, "v")
    assert out.columns == ["id", "t", "u", "v"]
    got = {r.id: r.v for r in out.collect()}
    assert len(got) == len(times)
    x, y = [1, 2, 3, 5, 9, 40], [1, 4, 10, 25, 81, 1600]
    for i, t in enumerate(times):
        if t is None or not 1 <= t <= 40:
            assert got[i] is None
        else:
            assert np.isclose(got[i], np.interp(t, x, y))
    assert ep.from_table(rows, "t", k.limit(0), "a", "u", 1.0, "v").where("v is not null").count() == 0
    assert ep.from_table(rows.limit(0), "t", k, "a", "u", 1.0, "v").count() == 0


@pytest.mark.parametrize("name", ["nutation_terms", "true_of_date", "barycentric_time", "ut1_from_table"])
def test_queries_on_more_rows(spark, name):
    compare(spark, QUERIES[name], ORACLE[name], "/root/testdata/sf0.01")
