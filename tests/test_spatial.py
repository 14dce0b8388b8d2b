import math

import numpy as np
from oracle import SF, compare, connect
from pyspark.sql import functions as F

from skylattice.operators import spatial as sp


def points(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "id long, ra double, dec double")


def angle(a, b):
    la, lb = (math.radians(x[1]) for x in (a, b))
    d = math.radians(b[0] - a[0])
    s = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(d / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(min(1.0, s))))


def test_pairs_equal_brute_force_at_poles_and_wrap(spark):
    a = [(359.95, 0.0), (0.02, 0.01), (10, 89.9), (190, 89.95), (100, -89.99), (280, -89.97), (45, 45), (45.4, 45.1), (45, 84.9), (49, 85.1)]
    b = [(x + 0.03, y - 0.02 if y > 0 else y + 0.02) for x, y in a] + [(0.05, 0.0), (11, 89.8)]
    for r in (0.1, 0.5, 2.0):
        got = {(x.probe_id, x.cat_id) for x in sp.zone_pairs(points(spark, a), points(spark, b), r).collect()}
        assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if angle(p, q) <= r}


def test_pairs_are_not_repeated(spark):
    a = points(spark, [(i * 0.7 % 360, (i * 13) % 170 - 85) for i in range(300)])
    p = sp.zone_pairs(a, a, 3.0)
    assert p.count() == p.distinct().count()


def test_fixture_nearest_and_ties(spark):
    deg = math.degrees
    a = points(spark, [(deg(1), 0), (deg(1), deg(1.2)), (deg(1), deg(1)), (deg(2), deg(-1)), (deg(2), 0), (deg(2.01), 0)])
    b = points(spark, [(deg(1), deg(1.2)), (deg(1), deg(1)), (deg(2.001), 0), (deg(3), deg(-1)), (deg(3), 0)])
    m = {r.probe_id: (r.cat_id, r.n_match) for r in sp.nearest(sp.zone_pairs(b, a, deg(0.01))).collect()}
    assert m == {0: (1, 1), 1: (2, 1), 2: (4, 2)}
    same = points(spark, [(10, 10), (10, 10), (10, 10)])
    assert {r.cat_id for r in sp.nearest(sp.zone_pairs(same, same, 0.1)).collect()} == {0}


def test_missing_positions_and_empty_tables(spark):
    a = spark.createDataFrame([(1, None, 2.0), (2, 1.0, None), (3, 1.0, 1.0)], "id long, ra double, dec double")
    assert sp.zone_pairs(a, a, 1.0).count() == 1
    assert sp.zone_pairs(a.limit(0), a, 1.0).count() == 0
    assert sp.with_neighbours(a, 1.0).where("has_neighbour").count() == 0


def test_unify_keeps_mutual_neighbours_of_one_epoch(spark):
    e1, e2 = points(spark, [(0, 0)]), points(spark, [(0.01, 0), (50, 0), (50.01, 0)])
    assert sp.unify([e1, e2], 0.1).count() == 3


def test_cone_strict_and_inclusive(spark):
    a = points(spark, [(0, 0), (1, 0)])
    edge = sp.cone(a, 0.0, 0.0, 5.0).where("id = 1").first().dist
    assert sp.cone(a, 0.0, 0.0, edge).count() == 2
    assert sp.cone(a, 0.0, 0.0, edge, inclusive=False).count() == 1


def test_plane_polygon(spark):
    p = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (0.1, 0.95)], "x double, y double")
    assert p.where(sp.in_plane_polygon(F.col("x"), F.col("y"), [(0, 0), (1, 0), (1, 1), (0, 1)])).count() == 2


def test_join_is_an_equi_join(spark):
    a = points(spark, [(i, 0) for i in range(10)])
    plan = sp.zone_pairs(a, a, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_conjunctions_meet_within_reach_only(spark):
    from skylattice.operators import movers

    rng = np.random.default_rng(4)
    lists = []
    for _ in range(2):
        ra, dec, va, vd = rng.uniform(0, 360, 60), rng.uniform(-80, 80, 60), rng.uniform(-1, 1, 60), rng.uniform(-0.3, 0.3, 60)
        lists.append({(i, t): (float((ra[i] + va[i] * t) % 360), float(dec[i] + vd[i] * t)) for i in range(60) for t in range(12) if (i + t) % 7})
    frames = [spark.createDataFrame([(i, float(t), r, d) for (i, t), (r, d) in x.items()], "id long, t double, ra double, dec double") for x in lists]

    def far(p, q):
        (a, b), (c, d) = np.radians(p), np.radians(q)
        return np.degrees(2 * np.arcsin(np.sqrt(np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2)))

    want = set()
    for i in range(60):
        for j in range(60):
            times = [t for t in range(12) if (i, t) in lists[0] and (j, t) in lists[1]]
            s = [far(lists[0][i, t], lists[1][j, t]) for t in times]
            want |= {(i, j, times[k]) for k in range(1, len(s) - 1) if s[k] <= 6 and s[k] < s[k - 1] and s[k] < s[k + 1]}
    out = movers.conjunctions(*frames, 6.0)
    assert want and {(r.id1, r.id2, r.t) for r in out.collect()} == want
    assert "cell" in out._jdf.queryExecution().optimizedPlan().toString()  # the lists meet through cells, not on the time alone


def test_conjunctions_of_common_times_shuffle_no_pairs(spark):
    """Lists of the same times, then lists in which a few objects lack times, have one twice or lack a place."""
    from skylattice.operators import movers

    rng = np.random.default_rng(11)
    lists = []
    for _ in range(2):
        ra, dec, va, vd = rng.uniform(0, 360, 50), rng.uniform(-88, 88, 50), rng.uniform(-3, 3, 50), rng.uniform(-1, 1, 50)
        lists.append([(i, float(t), float((ra[i] + va[i] * t) % 360), float(dec[i] + vd[i] * t)) for i in range(50) for t in range(9)])

    def want(a, b):
        c = connect(tables=[])
        for name, rows in (("a", a), ("b", b)):
            c.execute(f"CREATE TABLE {name} (id BIGINT, t DOUBLE, ra DOUBLE, dec DOUBLE)")
            c.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?)", rows)
        h = "degrees(2*asin(sqrt(least(1.0, pow(sin(radians(b.dec-a.dec)/2),2)+cos(radians(a.dec))*cos(radians(b.dec))*pow(sin(radians(b.ra-a.ra)/2),2)))))"
        sql = f"WITH p AS (SELECT a.id AS i, b.id AS j, a.t, {h} AS dist FROM a JOIN b ON a.t = b.t), w AS (SELECT *, lag(dist) OVER o AS before, lead(dist) OVER o AS after FROM p WINDOW o AS (PARTITION BY i, j ORDER BY t)) SELECT i, j, t, round(dist, 6) FROM w WHERE dist <= 40 AND dist < before AND dist < after"
        return sorted(c.sql(sql).fetchall())

    def got(a, b):
        out = movers.conjunctions(*(spark.createDataFrame(x, "id long, t double, ra double, dec double") for x in (a, b)), 40.0)
        return out, sorted((r.id1, r.id2, r.t, round(r.dist, 6)) for r in out.collect())

    out, rows = got(*lists)
    assert len(rows) > 40 and rows == want(*lists)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in x and "id1" in x for x in plan.splitlines()) and "Aggregate" not in plan
    a = [(i, t, None if (i, t) == (3, 4.0) else ra, dec) for i, t, ra, dec in lists[0] if not (i < 8 and (i + t) % 4 == 0)]
    b = [x for x in lists[1] if not (20 < x[0] < 25 and x[1] == 5.0)] + [x for x in lists[1] if x[0] == 30 and x[1] == 4.0]
    assert got(a, b)[1] == want(a, b)
    assert got(a, a[:0])[1] == []


def test_a_latitude_beyond_the_pole_is_a_place_on_the_other_side(spark):
    a, b = [(40.0, 93.0), (10.0, -95.0)], [(220.0, 58.5), (40.0, 58.5), (190.0, -60.0), (10.0, -62.0), (100.0, 0.0)]
    got = {(x.probe_id, x.cat_id) for x in sp.zone_pairs(points(spark, a), points(spark, b), 30.0).collect()}
    assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if angle(p, q) <= 30.0} and (0, 0) in got


def test_polar_rows_are_dealt_over_cells(spark):
    a = points(spark, [(i * 3.6, 84.0 + i % 50 / 10) for i in range(100)])
    left = sp.zone_pairs(a, a, 5.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in left  # explode() makes a side larger than its estimate: it is never sent out
    got = sp.zone_pairs(a, a, 5.0).count()
    rows = [(r.ra, r.dec) for r in a.collect()]
    assert got == sum(angle(p, q) <= 5.0 for p in rows for q in rows)


def test_copies_of_a_place_count_and_are_partners(spark):
    rng = np.random.default_rng(8)
    spots = [(float(x), float(y)) for x, y in zip(rng.uniform(0, 360, 30), rng.uniform(-90, 90, 30), strict=True)]
    rows = [spots[i] for i in rng.integers(0, 30, 120)]
    a = points(spark, rows)
    want, other = {}, {}
    for i, p in enumerate(rows):
        d = sorted((angle(p, q), j) for j, q in enumerate(rows) if angle(p, q) <= 20.0)
        want[i] = (len(d), min(j for _, j in d), max(j for _, j in d))
        if len(d) > 1:
            other[i] = min((x, j) for x, j in d if j != i)[1]
    assert {r.probe_id: (r.n_match, r.first_id, r.last_id) for r in sp.matched(a, a, 20.0).collect()} == want
    assert {r.probe_id: r.cat_id for r in sp.nearest_other(a, 20.0).collect()} == other
    assert {r.id: r.n_near for r in sp.with_neighbours(a, 20.0).collect()} == {i: n - 1 for i, (n, _, _) in want.items()}
    assert all(rows[r.cat_id] == rows[r.probe_id] for r in sp.nearest_partner(a, a, 20.0).collect())


def test_plane_lists_with_copies(spark, monkeypatch):
    rows = [(i, float(i % 5), float(i % 3)) for i in range(200)]
    a = spark.createDataFrame(rows, "id long, x double, y double")
    monkeypatch.setattr(sp, "COPIES", 4)
    want = sorted((i, j) for i, *p in rows for j, *q in rows if math.dist(p, q) <= 1.1)
    assert sorted((r.probe_id, r.cat_id) for r in sp.plane_matches(a, a, 1.1).collect()) == want
    m = sp.plane_place_pairs(a, a, 1.1)
    assert m.count() < 200 and m.agg(F.sum(F.col("p.n") * F.col("q.n"))).first()[0] == len(want)
    assert sp.best_shift(a, a, 1.1, 0.5).first().n == sum(p == q for _, *p in rows for _, *q in rows)


def test_plane_pairs_are_rounded_once_and_made_a_list_at_a_time(spark, monkeypatch):
    from skylattice.queries import ORACLE, QUERIES

    steps = [x.strip(" :+-") for x in QUERIES["match_plane"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    first = lambda text: next(i for i, x in enumerate(steps) if text in x)
    # from the result down: second list, its own generated code, first list, distance rounded for all copies
    assert first("Generate explode(cat_id") < first("Repartition") < first("Generate explode(probe_id") < first("round(")
    monkeypatch.setattr(sp, "COPIES", 1)
    compare(spark, QUERIES["match_plane"], ORACLE["match_plane"], "/root/testdata/sf0.01")
    a = spark.createDataFrame([(i, i % 3 / 3, 0.0) for i in range(30)], "id long, x double, y double")
    got = sorted(tuple(r) for r in sp.plane_matches(a, a, 0.5, digits=2).collect())
    assert got == sorted((i, j, round(abs(i % 3 - j % 3) / 3, 2)) for i in range(30) for j in range(30) if abs(i % 3 - j % 3) < 2)


def test_score_of_rotation_passes_a_long(spark):
    from unittest import mock

    from skylattice.operators import registration as rg

    h = spark.createDataFrame([(0, 0, 1 << 33), (3, 5, 1 << 32)], "ld int, an int, n long")
    with mock.patch.object(rg, "pair_histogram", return_value=h):
        assert rg.rotation_and_scale(h, h, 1.0).first().score == (1 << 66) + (1 << 64)


def test_an_angle_just_below_zero_is_just_below_a_turn(spark):
    from skylattice.functions import sphere

    r = spark.createDataFrame([(-1e-17,), (-0.5,), (7.0,), (0.0,)], "a double").select(sphere.wrap_2pi(F.col("a")).alias("w")).collect()
    assert round(r[0].w, 6) == 6.283185 and r[0].w < 2 * math.pi
    assert [round(x.w, 9) for x in r[1:]] == [round(2 * math.pi - 0.5, 9), round(7 - 2 * math.pi, 9), 0.0]


def test_shuffled_pairs_are_not_sent_out(spark):
    from skylattice.operators import significance as sg

    d = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(200)], "k long, x double, y double")
    assert "strategy=merge" in sg.correlation_significance(d, "k", "x", "y", 5)._jdf.queryExecution().analyzed().toString()
