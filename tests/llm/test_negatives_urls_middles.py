"""Hard negatives, url filters and fill-in-middle against brute-force versions."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skylattice.llm import fill_middle, hard_negatives, url_filter
from skylattice.llm.queries import QUERIES
from test_llm import docs_of, odd, sha

# 11: hard negatives


def brute_negatives(rows, anchors, k=5, m=3, low=50, high=95):
    rows = sorted({(i, y, tuple(q)) for i, y, q in rows})
    out = []
    for a in (r for r in rows if anchors(r[0])):
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))  # noqa: B023, E731, B905
        scored = sorted(((-score(r), r[0], r[1]) for r in rows), key=lambda x: x[:2])
        for p in [x for x in scored if x[2] == a[1] and x[1] != a[0]][:k]:
            near = [x for x in scored if x[2] != a[1] and -p[0] * low <= -100 * x[0] <= -p[0] * high]
            out += [(a[0], p[1], j + 1, x[1], -p[0], -x[0]) for j, x in enumerate(near[:m])]
    return sorted(out)


def mined(spark, rows, every=3, **more):
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    d = d.withColumns({c: F.lit("clash") for c in ("q", "chunk", "w", "place", "rank", "digit", "n")})
    return sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.quantised(d, "embedding", F.col("label")), F.col("vec_id") % every == 0, **more).collect())


def floors(rows):
    return [(i, y, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, y, v in rows]


@pytest.mark.parametrize(("chunk", "few", "digit"), [(4096, 32, 8), (30, 0, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, chunk, few, digit):
    for name, v in (("CHUNK", chunk), ("FEW", few), ("DIGIT", digit), ("TILE_ROWS", 16), ("TILE_ANCHORS", 4)):
        monkeypatch.setattr(hard_negatives, name, v)
    rnd = np.random.default_rng(4)
    rows = [(i, int(rnd.integers(0, 4)), rnd.normal(size=6).round(1 if i % 2 else 3).tolist()) for i in range(90)]
    rows += [(200 + i, 1, rows[5][2]) for i in range(40)]  # copies: ties of every score
    rows += [(300 + i, 2, rows[6][2]) for i in range(40)] + [rows[3], rows[3]]
    want = brute_negatives(floors(rows), lambda i: i % 3 == 0)
    assert mined(spark, rows) == want and len({r[0] for r in want}) > 30


@pytest.mark.parametrize("scale", [1e-3, 3e4, 1e8])
def test_negatives_of_any_size(spark, scale):
    rnd = np.random.default_rng(5)
    rows = [(i, i % 2, (np.abs(rnd.normal(size=3)) * scale).tolist()) for i in range(40)]
    want = brute_negatives(floors(rows), lambda i: i % 3 == 0)
    got = mined(spark, rows)
    if max(abs(r[4]) for r in want) < hard_negatives.MOST:
        assert got == want
    else:  # beyond 2^56 all scores are one, and none is 95 hundredths of it
        assert got == []


def test_negatives_of_odd_tables(spark):
    v = [0.5, 0.25]
    rows = [(0, 1, v), (None, 1, v), (1, None, v), (2, 1, None), (3, 1, [float("nan"), 1.0]), (4, 1, [float("inf"), 1.0]), (5, 1, [None, 1.0]), (6, 1, []), (7, 1, v), (8, 2, [0.3]), (8, 2, [0.3]), (9, 2, [0.3, 0.2, 0.9]), (12, 2, [])]
    ok = [(0, 1, v), (6, 1, []), (7, 1, v), (8, 2, [0.3]), (9, 2, [0.3, 0.2, 0.9]), (12, 2, [])]
    assert mined(spark, rows) == brute_negatives(floors([(i, y, (x + [0.0] * 3)[:3]) for i, y, x in ok]), lambda i: i % 3 == 0)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, v), (2, 2, v)]) == []


# 12: url filters


def brute_verdict(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = max(((len(h) + len(p), len(h), h + p, v) for h, p, v in rules if v and (not h or host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best[3] if best else otherwise


@pytest.mark.parametrize("parts", [1, 7])
def test_url_rules_equal_brute_force(spark, parts):
    rnd = random.Random(parts)
    labels, steps = ["com", "a", "b", "www", "a.b", "", "é", "co"], ["/", "/en", "/en/", "/e", "", "/en/a/", "/é"]
    host = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))
    rules = sorted({(host(), rnd.choice(steps)) for _ in range(60)} - {("", "")})
    rules = [(h, p, rnd.choice(["allow", "block"])) for h, p in rules]
    urls = [f"{rnd.choice(['http', 'HTTPS', ''])}://{host()}{rnd.choice(steps)}{rnd.choice(['', 'x', '?q=/en/', '#/en', '/en/a/b'])}" for _ in range(400)]
    urls += ["http://WWW.A.com/en/"] * 300 + [None, "", "://", "no scheme", "http://a.com:80/en/", "http://a.com", "http://" + "a." * 500 + "com/" + "en/" * 5000, "x://y://a.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0]), (0, urls[0])], "page_id long, url string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("rid", "key", "kind", "rule", "host", "path", "part", "level")}).repartition(3)
    table = spark.createDataFrame([*rules, ("com", "/", None), ("com", "/", "maybe")], "host string, path string, verdict string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = url_filter.judge(pages, table, "block").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(urls) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id or 0], rules, "block"), r


def test_url_rules_of_all_hosts_and_conflicts(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/y"), (3, None)], "page_id long, url string")
    rules = spark.createDataFrame([(None, "/x", "block"), ("B.ORG", None, "allow"), ("b.org", "", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: ("/x", "block"), 2: ("b.org", "block"), 3: (None, "allow")}
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_url_query_runs_no_python(spark):
    plan = QUERIES["op12_url_filters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 13: fill in the middle


def units_of(t):
    return re.findall(r"[^\n]*\n|[^\n]+", t)


@given(st.text(st.sampled_from("ab\né<>PSM"), max_size=60), st.integers(0, 70), st.integers(0, 70))
@settings(max_examples=300, deadline=None)
def test_rope_splits_like_lists(text, a, b):
    leaf, fill_middle.LEAF = fill_middle.LEAF, 3
    try:
        u, rope = units_of(text), fill_middle.Rope.of(text)
        assert rope.units() == len(u) and rope.chars == len(text) and str(rope) == text
        left, right = rope.split_units(min(a, len(u)))
        assert (str(left), str(right)) == ("".join(u[:a]), "".join(u[a:]))
        assert left.chars + right.chars == len(text) and left.newlines == str(left).count("\n")
        x, y = (right + left).split_chars(min(b, len(text)))
        assert (str(x), str(y)) == ((str(right) + str(left))[:b], (str(right) + str(left))[b:])
    finally:
        fill_middle.LEAF = leaf


def brute_middle(doc_id, text, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    u, d = units_of(text), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return len(u), "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


@pytest.mark.parametrize("more", [{}, {"seed": 3, "rate": 60, "spm": 10, "marks": ("[p]", "[s]", "[m]")}])
def test_fill_middle_equals_brute_force(spark, more):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["line\n", "\n", "é 日本", "<", "<P", ">", "x" * 50]) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    texts += [None, "", "\n", "a<P>b", "<M>", "one line", "y" * 1_000_000, "l\n" * 100_000, "é\n" * 9999 + "end"]
    docs = docs_of(spark, texts).union(docs_of(spark, texts[:1]))
    named = {"seed": more.get("seed", 7), "rate": more.get("rate", 100), "spm_rate": more.get("spm", 50), "sentinels": more.get("marks", fill_middle.SENTINELS)}
    got = fill_middle.restore(fill_middle.transform(docs, **named), named["sentinels"]).collect()
    assert len(got) == len(texts) + 1
    forms = defaultdict(int)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_middle(r.doc_id, texts[r.doc_id] or "", **more)
        assert r.restored == (texts[r.doc_id] or "")
        forms[r.form] += 1
    assert len(forms) == 3


def test_fill_middle_of_odd_tables(spark):
    d = odd(spark).withColumns({c: F.lit("clash") for c in ("n", "form", "output", "restored", "prefix_chars")})
    got = fill_middle.restore(fill_middle.transform(d)).collect()
    assert len(got) == 7 and {r.restored for r in got if r.doc_id == 2} == {""}
    null = next(r for r in got if r.doc_id is None)
    assert sha(null.output) == sha(brute_middle(None, null.restored)[4])
    assert fill_middle.restore(fill_middle.transform(d.limit(0))).count() == 0
