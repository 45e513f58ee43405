"""Operators against fixed values, closed forms, loops and mutants that must fail."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import checks, layout, matching, metrics, oplog, publish, series, similar, spatial
from lodestar.sources import shapes, text


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


# Columns --------------------------------------------------------------------------------------------------------------


def test_text(spark):
    assert values(spark, ["小 樽 市", "ｼｬﾅｲ", None], C.normalized_text) == ["小樽市", "シャナイ", None]
    assert values(spark, ["ＡＢＣ", "やいづ", "a B"], C.search_form) == ["abc", "ヤイヅ", "ab"]
    assert values(spark, ["", "〇", "○", "◎"], C.folded_mark) == ["", "○", "○", "◎"]
    assert values(spark, ["○", "◎", None], lambda c: C.mark_flag(c, "○")) == [1, 0, 0]
    assert values(spark, ["-", "―", "", "1,234", "7"], C.dashed_number) == [0, 0, 0, 1234, 7]
    assert values(spark, ["S29.10.30", "H1.1.1", "R5.12.3"], C.era_year) == [1954, 1989, 2023]
    assert values(spark, ["1.5KB", "2 MB", "1GB"], C.size_bytes) == [1536, 2097152, 1073741824]
    assert values(spark, ["京都府", "青森県"], lambda c: C.stem(c, "県都府")) == ["京", "青森"]
    assert values(spark, ["青森県", "北海道"], lambda c: C.short_name(c, "北海道")) == ["青森", "北海道"]
    assert values(spark, ["<b>a</b>  &amp;&lt;"], C.stripped_tags) == ["a &<"]
    for bad, f in (("x", C.folded_mark), ("x", C.era_year), ("3TB", C.size_bytes), ("a", C.digits_or_zero)):
        with pytest.raises(PySparkException):
            values(spark, [bad], f)


GOLD = {
    "～0.3m": "〜0.3m", "0.3～0.5m": "0.3〜0.5m", "5m～": "5m〜", "0.01～0.3m": "0.01〜0.3m", "5.0m～": "5m〜", "1m以上 ～ 3m未満": "1〜3m", "1.0m以上 ～ 3.0m未満": "1〜3m", "20m以上": "20m〜",
    "0.3m未満": "〜0.3m", "～ 0.3m未満": "〜0.3m", "～0.3m未満": "〜0.3m", "0.01m以上 0.3m未満": "0.01〜0.3m", "0.01m以上～0.3m未満\n": "0.01〜0.3m", "20m以上 ～ 50m未満": "20〜50m",
}


def test_labels(spark):
    f = lambda c: C.canonical_label(C.label_bounds(c)["low"], C.label_bounds(c)["high"])
    assert values(spark, list(GOLD), f) == list(GOLD.values())
    assert values(spark, ["深い", "3～1m", "m以上", "", "1m以上 ～ 1m未満"], lambda c: C.label_bounds(c, strict=False)) == [None] * 5
    for bad in ("深い", "3～1m", "1m以上 ～ 1m未満"):
        with pytest.raises(PySparkException):
            values(spark, [bad], C.label_bounds)
    bins = lambda c: C.depth_bin(C.label_bounds(c)["low"])
    assert values(spark, ["〜0.3m", "0.01〜0.3m", "0.3〜0.5m", "1〜2m", "2〜5m", "5m〜", "10m〜", "20〜50m"], bins) == [0, 0, 1, 2, 2, 3, 4, 4]


def test_formats(spark):
    assert values(spark, [0.275, -0.075], C.signed_slope, "double") == ["+0.275", "−0.075"]
    assert values(spark, [0.0, 0.0312, 0.00012], C.p_text, "double") == ["< 0.000001", "0.031", "1.2e-4"]
    days = [datetime.date(2024, 2, 28), datetime.date(2024, 2, 29), datetime.date(2024, 3, 1), datetime.date(2023, 12, 31), datetime.date(2020, 1, 1)]
    assert values(spark, days, C.day_of_cycle, "date") == [58, 58, 59, 364, 0]


def test_margin(spark):
    rows = [(37.0, 136.8), (35.611, 134.467), (36.35 - 0.4, 136.8), (36.35 - 0.6, 136.8)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    box = [F.lit(x) for x in (36.35, 37.85, 136.32, 137.36)]
    assert [r[0] for r in df.select(C.in_margin(F.col("lat"), F.col("lon"), *box, 0.5)).collect()] == [True, False, True, False]
    assert df.select(C.in_margin(F.col("lat"), F.col("lon"), *[F.lit(None).cast("double")] * 4, 0.5)).first()[0] is False


# Series ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("..HHHH..", []), ("..HHHHH..", [("2023-06-03", 5)]), ("HHHHH..HHHHH", [("2023-06-01", 12)]), ("HHHHH...HHHHH", [("2023-06-01", 5), ("2023-06-09", 5)]), ("HHPHH", [("2023-06-01", 5)]), ("HHH HH", [])],
)
def test_events(spark, pattern, want):
    start = datetime.date(2023, 6, 1)
    rows = [("a", start + datetime.timedelta(i), 21.0 if c in "HP" else 19.0, 19.5, 20.0, c == "P") for i, c in enumerate(pattern) if c != " "]
    got = series.events(spark.createDataFrame(rows, "key string, d date, value double, mean double, threshold double, provisional boolean")).orderBy("start").collect()
    assert [(str(r.start), r.duration) for r in got] == want
    assert [r.provisional for r in got] == ["P" in pattern] * len(got)
    if pattern == "..HHHHH..":
        assert got[0].max_over == 1.5


def test_trends(spark):
    flat = [("flat", float(y), 15.0) for y in range(1982, 2026)]
    rise = [("rise", float(y), 15 + 0.03 * (y - 1982) + 0.01 * (-1) ** y) for y in range(1982, 2026)]
    few = [("few", float(y), 1.0 * y) for y in range(9)]
    got = {r.key: r for r in series.trends(spark.createDataFrame(flat + rise + few, "key string, x double, y double"), "key", "x", "y").collect()}
    assert set(got) == {"flat", "rise"}
    assert got["flat"].slope == 0 and got["flat"].r2 is None
    assert got["rise"].slope * 10 == pytest.approx(0.3, abs=1e-3) and got["rise"].p < 1e-6
    x, y = np.array([r[1] for r in rise]), np.array([r[2] for r in rise])
    s, i = np.polyfit(x, y, 1)
    assert got["rise"].sse == pytest.approx(((y - s * x - i) ** 2).sum(), rel=1e-6)


def test_t_tail():
    for t in (0.0, 0.3, 1.0, 5.0, 40.0):
        assert series.t_tail(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-12)
        assert series.t_tail(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
    assert series.t_tail(math.inf, 5) == 0


def test_climatology_wraps(spark):
    first = datetime.date(1991, 1, 1)
    rows = [("a", first + datetime.timedelta(i), float(i % 7)) for i in range(3 * 365 + 1)]
    df = spark.createDataFrame(rows, "key string, d date, value double")
    got = {r.doy: r for r in series.climatology(df, 1991, 1993, window=2, q=0.9).collect()}
    doy = [min((r[1].replace(year=2001) if (r[1].month, r[1].day) != (2, 29) else datetime.date(2001, 2, 28)).timetuple().tm_yday - 1, 364) for r in rows]
    for k in (0, 1, 58, 364):
        near = [r[2] for r, d in zip(rows, doy, strict=True) if min((d - k) % 365, (k - d) % 365) <= 2 and r[1].year <= 1993]
        assert got[k].mean == pytest.approx(np.mean(near)) and got[k].threshold == pytest.approx(np.percentile(near, 90))
    rate = lambda q: series.exceedance(series.with_climatology(df, series.climatology(df, 1991, 1993, 2, q))).first().rate
    assert rate(0.5) > 0.3 > rate(0.9)


def test_sparkline(spark):
    got = {r.key: r.path for r in series.sparkline(spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("b", 0.0, 1.0)], "key string, x double, y double"), "key", "x", "y", 10.0, 6.0, 1.0).collect()}
    assert got == {"a": "M1.0,5.0 L9.0,1.0", "b": ""}


# Matching -------------------------------------------------------------------------------------------------------------


def test_cascade_guards_by_cardinality(spark):
    left = spark.createDataFrame([(1, "c1", "p", "n1"), (2, "c2", "p", "n2"), (3, "c3", "p", "n3"), (4, "c4", "p", "n4"), (5, "c5", "q", "n5")], "id int, code string, area string, name string")
    right = spark.createDataFrame([("c1", "p", "n1", 10), ("c1", "p", "zz", 11), ("c2", "p", "other", 20), ("c3", "p", "a", 30), ("c3", "p", "b", 31), ("x", "p", "n3", 32), ("y", "p", "n4", 40), ("z", "p", "n4", 41), ("c5", "p", "n5", 50)], "code string, area string, name string, gid int")
    got = {r.id: (r.method, r.gid) for r in matching.cascade(left, right, "id", "code", "area", "name", ["gid"]).collect()}
    assert got == {1: ("code_name_area", 10), 2: ("code_area", 20), 3: ("name_area", 32), 4: (None, None), 5: (None, None)}


def test_place_tokens(spark):
    strip = matching.place_tokens(["港", "漁"])
    assert values(spark, ["小樽漁港・余市、港", None], strip) == [["小樽", "余市"], []]
    whole = matching.place_tokens(["沿岸", "の東", "南部", "列島"])
    assert values(spark, ["沿岸・南部", "五島列島沿岸南部", "種子島・ 屋久島 沿岸", "日向灘南部・列島の東沿岸", ""], whole) == [[], ["五島"], ["種子島", "屋久島"], ["日向灘"], []]


def test_containing_by_automaton_and_by_keys(spark):
    texts = spark.createDataFrame([("abcde",), ("bcd",), ("xyz",), ("",), (None,), ("abcde",)], "t string")
    tokens = spark.createDataFrame([("bc",), ("abc",), ("cd",), ("de",), ("q",), ("",), (None,), ("bc",), ("abcdef",)], "w string")
    expected = {(t, w) for t in ("abcde", "bcd", "xyz") for w in ("bc", "abc", "cd", "de", "q", "abcdef") if w in t}
    for most in (100, 2):
        assert {tuple(r) for r in matching.containing(texts, "t", tokens, "w", most).collect()} == expected
    assert matching.containing(texts, "t", tokens.limit(0), "w").count() == 0


def test_named_areas(spark):
    areas = spark.createDataFrame([(1, "五島列島沿岸", ["五島"]), (2, "長崎県北西部", []), (3, "長崎県南部", None), (4, "鹿児島県沿岸", ["鹿児島"])], "no int, name string, tokens array<string>")
    places = spark.createDataFrame([(1, "五島市", "長崎"), (2, "佐世保市", "長崎"), (3, None, "鹿児島"), (4, "鹿児島五島町", "長崎"), (5, "", "秋田"), (6, None, None)], "id int, muni string, stem string")
    got = {r.id: (r.no, r.method, r.n) for r in matching.named_areas(places, "id", "muni", "stem", areas, "no", "name", "tokens").collect()}
    assert got == {1: (1, "municipality_named", 1), 2: (None, "ambiguous_prefecture_named", 2), 3: (4, "prefecture_named", 1), 4: (None, "ambiguous_municipality_named", 2), 5: (None, "none", 0), 6: (None, "none", 0)}


def test_page_cells(spark):
    """A cell of two lines belongs to the row whose number stands between them; what overflows belongs to the last row."""
    g = spark.createDataFrame([("p", 10.0, 5.0, "1"), ("p", 30.0, 5.0, "2"), ("p", 9.0, 15.0, "a"), ("p", 26.0, 15.0, "b"), ("p", 34.0, 16.0, "c"), ("p", 20.0, 15.0, "d"), ("p", 99.0, 12.0, "z"), ("p", 1.0, 25.0, "t"), ("q", 1.0, 15.0, "n")], "page string, y double, x double, t string")
    edges = spark.createDataFrame([(p, e) for p in "pq" for e in (0.0, 10.0, 20.0, 30.0)], "page string, edge double")
    got = {(r.page, r.row, r.col): r.cell for r in layout.page_cells(g, "page", "y", "x", "t", edges, 3.0).collect()}
    assert got == {("p", 0, 0): "1", ("p", 1, 0): "2", ("p", 0, 1): "a", ("p", 1, 1): "dbcz", ("p", 0, 2): "t", ("q", None, 1): "n"}
    for x in (30.0, -1.0):
        with pytest.raises(Exception, match="no column holds"):
            layout.page_cells(spark.createDataFrame([("p", 1.0, x, "a")], g.schema), "page", "y", "x", "t", edges, 3.0).collect()


def test_corrections(spark):
    rows = [("f", 1, None, False), ("f", 2, None, False), ("f", 3, 1, True), ("f", 4, 9, True), ("f", 5, 3, True), ("g", 1, None, False)]
    df = spark.createDataFrame(rows, "file string, line int, supersedes int, fix boolean")
    got = sorted((r.file, r.line) for r in matching.without_voided(df, "file", "line", "supersedes", F.col("fix")).collect())
    assert got == [("f", 2), ("g", 1)]


# Space ----------------------------------------------------------------------------------------------------------------


def test_radii(spark):
    lat, lon = 45.0, 142.0
    m = 1 / (math.cos(math.radians(lat)) * 111320)
    north = 5 / 110574
    boxes = [(i, lon + a * m, lat - north, lon + b * m, lat + north, r, 2023) for i, (a, b, r) in enumerate([(150, 160, 3), (1000, 1010, 5)])]
    df = spark.createDataFrame(boxes, "box_id int, x0 double, y0 double, x1 double, y1 double, rank int, version int")
    p = spark.createDataFrame([(1, lat, lon)], "id int, lat double, lon double")
    pairs = spatial.near_pairs(p, df, 1100.0, 0.003)
    got = {r.radius: (r.rank, r.version) for r in spatial.max_within(pairs, p, "id", [100.0, 200.0, 500.0, 1100.0], "rank", "version").collect()}
    assert got == {100.0: (None, None), 200.0: (3, 2023), 500.0: (3, 2023), 1100.0: (5, 2023)}


def test_polygons():
    d = spatial.disc(500.0)
    assert spatial.area(d) == pytest.approx(64 * 500**2 * math.sin(2 * math.pi / 128))
    half = spatial.clip(np.array([[0, -600], [600, -600], [600, 600], [0, 600.0]]), d)
    assert spatial.area(half) == pytest.approx(spatial.area(d) / 2)
    a, b = np.array([[0, 0], [2, 0], [2, 2], [0, 2.0]]), np.array([[1, 1], [3, 1], [3, 3], [1, 3.0]])
    assert spatial.strips_union_area([a, b]) == pytest.approx(7)
    assert spatial.strips_union_area([a, a, b + 10]) == pytest.approx(8)
    assert spatial.inside(a, 1, 1) and not spatial.inside(a, 3, 1)
    wavy = np.array([[x, 0.3 * (x % 2)] for x in range(41)] + [[40, 30.0], [0, 30.0]], dtype=float)
    s, t = spatial.simplified(wavy)
    assert t > 0 and len(s) < len(wavy) and abs(spatial.area(s) - spatial.area(wavy)) <= 0.01 * spatial.area(wavy)
    assert len(spatial.simplify(wavy, 0)) == len(wavy)


# Similarity and measures ----------------------------------------------------------------------------------------------


def test_nearest_ties(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    got = {}
    for r in similar.nearest(spark.createDataFrame(rows, "id long, vec array<double>"), 5, block=7).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    for s in range(30):
        want = sorted((abs(s % 3 - i % 3), i) for i in range(30) if i != s)[:5]
        assert got[s] == [i for _, i in want]


def test_macro_f1_of_a_constant(spark):
    rows = [(0, i % 10 // 2 if i % 10 < 8 else 0, 0) for i in range(100)]
    p = sum(t == 0 for _, t, _ in rows) / 100
    f = metrics.macro_f1(spark.createDataFrame(rows, "repeat int, truth int, pred int"), "repeat", "truth", "pred", [0, 1, 2, 3, 4]).first().f1
    assert f == pytest.approx(2 * p / (1 + p) / 5)


def test_models_learn():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300)
    x = np.eye(3)[y] + rng.normal(0, 0.3, (300, 3))
    w = np.ones(300)
    for m in ("logistic", "boosted", "perceptron"):
        assert (metrics.fit_predict(m, x[:200], y[:200], w[:200], x[200:], 3) == y[200:]).mean() > 0.85
    assert (metrics.fit_predict("logistic", x[:200], rng.permutation(y[:200]), w[:200], x[200:], 3) == y[200:]).mean() < 0.7


def test_constant_column_raises(spark):
    with pytest.raises(PySparkException):
        similar.standardized(spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, a double"), ["a"]).collect()


# Layout, logs, gates, publication -------------------------------------------------------------------------------------


def test_layout(spark):
    df = spark.createDataFrame([(1, y) for y in (100.0, 100.4, 112.7, 113.1)], "page int, y double")
    assert [round(r.y, 3) for r in layout.line_means(df, ["page"], "y", 3.0).orderBy("line").collect()] == [100.2, 112.9]
    rng = random.Random(1)
    for _ in range(5):
        e = [rng.uniform(0, 30) for _ in range(20)]
        kept = []
        for x in sorted(e):
            if not kept or x - kept[-1] > 2.0:
                kept.append(x)
        assert values(spark, [e], lambda c: layout.kept_edges(c, 2.0), "array<double>") == [kept]
    with pytest.raises(PySparkException):
        values(spark, [9.0], lambda c: layout.column_of(c, F.array(F.lit(0.0), F.lit(5.0))), "double")


def test_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"event":"x","data":{"a":"1"}}\n\nnot json\n{"event":"y"}\n')
    got = [(r.line, r.record.event if r.record else None) for r in oplog.read_jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()]
    assert got == [(1, "x"), (3, None), (4, "y")]
    assert values(spark, ["3 passed in 1s", "\x1b[31m1 failed\x1b[0m, 2 passed", "collected 0 items", "hi", "0 failed, 4 passed"], oplog.run_evidence) == ["passed", "failed", "none", "unknown", "passed"]
    assert [tuple(v) if v else None for v in values(spark, ["a=1", "b=x y", "=1", "c"], oplog.key_value)] == [("a", "1", True), ("b", "x y", False), None, None]
    assert tuple(values(spark, ["aЖ한\x01\rb\r\n"], oplog.hygiene)[0]) == (1, 1, 1, 1)


def test_gates(spark):
    good, bad = spark.range(0), spark.range(2)
    assert {r.gate: r.passed for r in checks.report([checks.Check("a", good), checks.Check("b", bad)]).collect()} == {"a": True, "b": False}
    checks.enforce([checks.Check("a", good)])
    with pytest.raises(checks.GateError):
        checks.enforce([checks.Check("b", bad)])
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int"), spark.createDataFrame([("x", 1), ("z", 2)], "k string, n int")
    assert sorted(r.k for r in checks.reconciled(a, b, ["k"], "n").collect()) == ["y", "z"]


def test_publication(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, "b", 0)], "id int, name string, v int")
    files = publish.one_file_per_key(df, "id", f"file://{tmp_path}/out").collect()
    assert sorted(r.key for r in files) == ["1", "2"] and (tmp_path / "out/1.json").read_text() == '{"id":1,"name":"é","v":null}'
    assert all(r.bytes == len((tmp_path / f"out/{r.key}.json").read_bytes()) for r in files)
    records = df.select("id", F.map_from_arrays(F.array("name"), F.array(F.lit('x, "y"'))).alias("data"))
    assert publish.csv_with_union(records, ["id"], "data", ["id"], f"file://{tmp_path}/csv") == ["id", "é", "b"]
    parts = [f.read_bytes().decode() for f in sorted((tmp_path / "csv").glob("part-*.csv"))]
    assert "".join(x.removeprefix("\ufeffid,é,b\n") for x in parts) == '1,"x, ""y""",\n2,,"x, ""y"""\n'
    assert publish.manifest({"a": df, "b": None}) == '{"a": {"rows": 2}}'
    assert publish.forbidden(df, ["v", "w"]) == ["v"]
    assert [r.id for r in publish.missing_parts(df, df.filter("id = 1"), "id").collect()] == [2]


# Sources --------------------------------------------------------------------------------------------------------------


def test_daily_files(spark, tmp_path):
    (tmp_path / "area7.txt").write_text("yyyy,mm,dd,areaNo.,flag,Temp.\n\n2024,1,1,7,R,10.5\n2024,1,2,7,P,-9999\n2024,1,3,7,X,3\n2024,2,30,7,R,3\n2024,1,4,8,R,3\n2024,1,5,7,R,99\n2024,1,6,7,R\n2024,1,7,7,R,1\n2024,1,7,7,R,2\n")
    good, bad = text.daily_files(spark, str(tmp_path))
    assert [(str(r.d), r.temp, r.flag) for r in good.collect()] == [("2024-01-01", 10.5, "R")]
    assert sorted(r.reason for r in bad.collect()) == ["area", "columns", "date", "duplicate", "duplicate", "flag", "range"]


def test_normals_and_numbers(spark, tmp_path):
    (tmp_path / "area3-stat.txt").write_text("Period of Norm. : 1991-2020\nx\nmm,dd,norm,a,b,c,d,e\n1,1,10.1,0,0,0,0,0\n1,2,10.3,0,0,0,0,0\n")
    assert [(r.month, r.day, r.normal, r.period) for r in text.normal_files(spark, str(tmp_path)).orderBy("day").collect()] == [(1, 1, 10.1, "1991-2020"), (1, 2, 10.3, "1991-2020")]
    lines = spark.createDataFrame([("青森 1 2 1,000",), ("bad 1 2",), ("秋田県 - 0 ―",)], "l string")
    assert sorted(tuple(r) for r in text.fixed_numbers(lines, "l", 3, {"a": 0, "c": 2}).collect()) == [("秋田県", 0, 0), ("青森", 1, 1000)]


def test_page_tables(spark):
    page = '<table><tr><th>x</th></tr><tr><td>A&amp;B</td><td> 1 </td><td>z</td><td>1.5MB</td><td>A40-16_02_GML.zip</td></tr></table>'
    df = spark.createDataFrame([(1, page)], "id int, html string")
    assert [tuple(r) for r in text.archive_listing(df, "id", "html").collect()] == [(1, "A&B", 2016, "A40-16_02_GML.zip", 1572864)]
    codes = "".join(f'<tr><td>{n}</td><td>name{n}</td><td><a href="area{k}.html">' for n, k in ((1, 1), (2, 3), (4, 4)))
    assert sorted(r.number for r in text.paired_codes(spark.createDataFrame([(1, codes)], "id int, html string"), "id", "html").collect()) == [1, 4]


def test_encodings(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes('<?xml version="1.0" encoding="shift_jis"?><a>なお、港</a>'.encode("cp932"))
    (tmp_path / "b.xml").write_bytes("港".encode("cp932"))
    got = {r.path.rpartition("/")[2]: r.text for r in text.declared_files(spark, str(tmp_path)).collect()}
    assert "なお、港" in got["a.xml"] and got["b.xml"] == "港"


def test_shapefiles(spark, tmp_path):
    shapes.write_archive(str(tmp_path / "z.zip"), "x", [("青森県", "0.3m未満", [[(0.0, 0.0), (0.0, 2.0), (1.0, 2.0), (0.0, 0.0)]]), ("青森県", "5m以上", [[(5.0, 5.0), (5.0, 6.0), (6.0, 6.0), (5.0, 5.0)]])], ["PREF", "LABEL"])
    got = shapes.read_archives(spark, str(tmp_path / "*.zip")).orderBy("record").collect()
    assert [(r.attributes["PREF"], r.attributes["LABEL"], r.x0, r.y0, r.x1, r.y1) for r in got] == [("青森県", "0.3m未満", 0.0, 0.0, 1.0, 2.0), ("青森県", "5m以上", 5.0, 5.0, 6.0, 6.0)]
    assert got[0].rings == [[[0.0, 0.0], [0.0, 2.0], [1.0, 2.0], [0.0, 0.0]]]


def test_polygon_strips_and_precedence(spark):
    a, b = np.array([[0, 0], [4, 0], [4, 2], [0, 2.0]]), np.array([[1, -1], [2, -1], [2, 3], [1, 3.0]])
    size = lambda q: sum(abs(spatial.area(x)) for x in q)
    assert size(spatial.strips([a], [b], "difference")) == pytest.approx(6)
    assert size(spatial.strips([a], [b], "intersection")) == pytest.approx(2)
    assert size(spatial.strips([a, a], [], "difference")) == pytest.approx(8)
    tri = np.array([[0, 0], [4, 0], [2, 4.0]])
    assert size(spatial.strips([tri], [b], "intersection")) + size(spatial.strips([tri], [b], "difference")) == pytest.approx(8)
    rows = [(1, 1, 2020, "x", a.tolist()), (1, 2, 2023, "y", b.tolist()), (1, 3, 2023, "y", a.tolist()), (1, 4, 2023, "z", b.tolist()), (2, 5, 2020, "x", a.tolist())]
    got = {r.object_id: round(r.area, 6) for r in spatial.newer_first(spark.createDataFrame(rows, "id int, object_id long, version int, file string, ring array<array<double>>"), "id").collect()}
    assert got == {2: 4.0, 3: 8.0, 5: 8.0}


def test_numbered(spark):
    from lodestar.operators.numbering import numbered

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    assert [(r.k, r.i) for r in numbered(df, "k", start=0).orderBy("k").collect()] == [(i, i) for i in range(1000)]
