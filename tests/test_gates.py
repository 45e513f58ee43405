"""Gates and findings: what must raise does, and controls fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import oplog as O
from lodestar.operators import publish as P
from lodestar.operators import series as S
from lodestar.sources import text as T


def days(spark, shift=0):
    d = spark.range(2200).select(F.lit("a").alias("key"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")).alias("d"), (20 + 8 * F.sin((F.col("id") + shift) / 58.1)).alias("value"))
    return d.withColumn("provisional", F.lit(False))


def test_normal_gate_and_its_control(spark):
    clim = S.climatology(days(spark), 1995, 1999)
    normals = lambda shift: days(spark, shift).filter("year(d) < 2000").groupBy("key", C.day_of_cycle(F.col("d")).cast("long").alias("doy")).agg(F.avg("value").alias("normal"))
    near, far = (S.normal_gate(clim, normals(x), 0.05, 0.5).first() for x in (0, 182))
    assert near.passed and near.median < 0.01 and not far.passed and far.median > 0.2


def test_complete_years_raise(spark):
    summary = S.annual_summary(days(spark))
    assert S.complete_years(summary, 365, some_go=True).count() == 6
    with pytest.raises(ValueError, match="no year has"):
        S.complete_years(summary, 400)
    with pytest.raises(ValueError, match="all years have"):
        S.complete_years(summary, 1, some_go=True)


def test_heat_expectations(spark):
    some = days(spark).withColumn("key", F.lit("x")).unionByName(days(spark).withColumn("key", F.lit("y")))
    found = spark.createDataFrame([("x", "1998-06-01", "1998-07-31"), ("y", "2000-06-01", "2000-06-10")], "key string, a string, b string").select("key", F.to_date("a").alias("start"), F.to_date("b").alias("end"))
    got = {r.name: (r.observed, r.held) for r in S.heat_expectations(some, found, {"E6": ("x", "y"), "E7": ("x", "z")}, ("1998-06-01", "1998-08-31"), 46, 1, F.col("d") >= "2000-01-01", "E8").collect()}
    assert got == {"E6": (1, True), "E7": (1, True), "E8": (1, False)}


def test_diffs(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/src/x.py\n@@ -1,0 +5,2 @@\n+a = 1\n+token = 'abcdefgh'\n@@ -9 +12 @@ def f\n-old\n+eval (x)\n--- a/k\n+++ b/out/k\n@@ -0,0 +1 @@\n+-----BEGIN PRIVATE KEY-----"
    lines = O.added_lines(spark.createDataFrame([(1, diff), (2, None), (3, "")], "id int, diff string"), "id", "diff")
    assert sorted((r.file, r.line, r.added) for r in lines.collect()) == [("out/k", 1, "-----BEGIN PRIVATE KEY-----"), ("src/x.py", 5, "a = 1"), ("src/x.py", 6, "token = 'abcdefgh'"), ("src/x.py", 12, "eval (x)")]
    assert sorted((r.file, r.line, r.label, r.blocks) for r in O.findings(lines, "added").collect()) == [("out/k", 1, "private key", True), ("src/x.py", 6, "credential", True), ("src/x.py", 12, "eval", False)]
    assert {r.file for r in O.findings(lines, "added", "^out/").collect()} == {"src/x.py"}
    changes = spark.createDataFrame([("b", 3, 4), ("a", 4, 3), ("z.lock", 99, 1), ("c", 1, 1)], "path string, added int, deleted int")
    assert [tuple(r) for r in O.largest(changes, "path", "added", "deleted", r"\.lock$", 2).collect()] == [("a", 7), ("b", 7)]


def test_outcomes_and_pairs(spark):
    rows = [("\x1b[32m20 passed\x1b[0m", 0, "vitest", ""), ("done", 0, "make", "no evidence"), ("", 5, "pytest -q", "nothing collected"), ("", 5, "make", ""), ("x", 127, "y", "not found"), ("sh: x: command not found", 0, "x", "not started"), ("No tests ran", 1, "x", "nothing ran"), (None, 1, "x", "")]
    df = spark.createDataFrame(rows, "o string, c int, m string, e string").select("e", O.run_outcome(F.col("o"), F.col("c"), F.col("m")).alias("r"))
    assert all(r.e == r.r.reason and r.r.ran == (r.e == "") for r in df.collect())
    pair = lambda t, **k: spark.createDataFrame([(t,)], "t string").select(O.key_value(F.col("t"), **k).alias("p")).first().p
    assert tuple(pair("sha=1e5", strings=("sha",))) == ("sha", "1e5", False) and tuple(pair("n=1e5", strings=("sha",))) == ("n", "1e5", True)
    assert pair("nothing") is None
    with pytest.raises(Exception, match="not key=value"):
        pair("nothing", strict=True)


def test_hygiene_by_line(spark):
    df = spark.createDataFrame([(1, "ok\nԀ\nㆎ allow\nㆎ\x02\na\tb\r"), (2, None), (3, "")], "id int, t string")
    assert [(r.id, r.line, r.kinds) for r in O.hygiene_lines(df, "id", "t", "allow").collect()] == [(1, 2, "cyrillic"), (1, 4, "hangul,control")]


def test_sources_that_insist(spark, tmp_path):
    cell = lambda n, name: f'<td>{n}</td><td>{name}</td><td><a href="area{n}.html">'
    pages = lambda *c: spark.createDataFrame([(1, "".join(c))], "id int, html string")
    assert T.paired_codes(pages(cell(1, "a"), cell(2, "b")), "id", "html", 2).count() == 2
    with pytest.raises(ValueError, match="at least 3"):
        T.paired_codes(pages(cell(1, "a"), cell(2, "b")), "id", "html", 3)
    with pytest.raises(ValueError, match="two names"):
        T.paired_codes(pages(cell(1, "a"), cell(1, "b"), cell(2, "b")), "id", "html", 2)
    sums = T.fixed_numbers(spark.createDataFrame([("a 1 2",), ("  3  4",), ("t",)], "l string"), "l", 2, {"x": 0, "y": 1})
    assert sorted(map(tuple, sums.collect()), key=str) == [("a", 1, 2), (None, 3, 4)]
    files = spark.createDataFrame([("f", 100, 102), ("g", 100, 110)], "f string, said int, got int")
    assert P.sizes_checked(files.filter("f = 'f'"), "said", "got").count() == 1
    with pytest.raises(Exception, match="size 110 instead of 100"):
        P.sizes_checked(files, "said", "got").collect()
    at = f"file://{tmp_path}/t"
    parts = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    with pytest.raises(ValueError, match="trial"):
        P.replaced(parts, at, "k", only=True)
    P.replaced(parts, at, "k")
    assert sorted((r.k, r.v) for r in P.replaced(parts.filter("k = 2").withColumn("v", F.lit("b")), at, "k", only=True).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="trial"):
        P.replaced(parts, at, "k", only=True)


def test_second_implementations_notice_differences(spark):
    """Trends and neighbours measured twice: equal as they are, unequal once one number is changed."""
    from lodestar.operators import series as S
    from lodestar.operators import similar as N

    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(k, float(i), float(k * i + rng.normal())) for k in range(4) for i in range(12)] + [(9, 1.0, 2.0), (1, None, 3.0)], "key int, x double, y double")
    a, b = S.trends(points, "key", "x", "y", with_p=False), S.trends_by_moments(points, "key", "x", "y")
    columns = ["slope", "intercept", "se"]
    assert tuple(S.agreeing(a, b, "key", columns).first()) == (4, 4, True)
    bent = F.when(F.col("key") == 2, F.col("slope") + 1e-6).otherwise(F.col("slope"))
    assert tuple(S.agreeing(a.withColumn("slope", bent), b, "key", columns).first()) == (4, 3, False)
    assert tuple(S.agreeing(a, b.filter("key > 0"), "key", columns).first()) == (4, 3, False)
    v = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(rng.standard_normal((40, 3)))], "id long, vec array<double>")
    pairs = N.nearest(v, 3, block=8)
    assert tuple(N.audited(pairs, v).first()) == (120, 0, 0)
    assert tuple(N.audited(pairs.withColumn("distance", F.when(F.col("src") == 7, F.col("distance") + 1e-6).otherwise(F.col("distance"))), v).first()) == (120, 3, 0)
    assert tuple(N.audited(pairs.withColumn("rank", F.when(F.col("src") == 7, -F.col("rank")).otherwise(F.col("rank"))), v).first()) == (120, 0, 2)
