"""Sources, sinks and polygons beyond what their queries' SQL shows: faults, splits, closed forms."""

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import oplog, publish, spatial
from lodestar.plans.registry import QUERIES, load
from lodestar.sources import shapes, text

load()
SF = "/root/testdata/sf0.01"
SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]


def test_shapes_of_each_kind_and_header_boxes():
    import io
    import zipfile

    rows = [(i, [SQUARE, [[1.0, 1.0], [1.0, 2.0], [2.0, 2.0], [1.0, 1.0]]]) for i in range(3)] + [(9, [[[5.0, -1.0], [7.0, 2.0]]])]
    for kind in (3, 5):
        with zipfile.ZipFile(io.BytesIO(shapes.archive("a", rows, ["ID"], kind=kind))) as z:
            shp, shx = z.read("a.shp"), z.read("a.shx")
            assert list(shapes.shapes(shp)) == [r[1] for r in rows]
            assert shapes.header_boxes(shp, shx, kind).tolist() == [[0.0, 0.0, 4.0, 4.0]] * 3 + [[5.0, -1.0, 7.0, 2.0]]
            with pytest.raises(ValueError, match="shape types"):
                shapes.header_boxes(shp, shx, 8 - kind)
            assert [r["ID"] for r in shapes.attributes(z.read("a.dbf"))] == ["0", "1", "2", "9"]


def test_lines_keep_their_numbers_in_splits(spark, tmp_path):
    lines = {f"f{i}.txt": ["" if j % 13 == 0 else f"{i} {j} " + "x" * (j % 50) for j in range(4000)] for i in range(2)}
    for name, ls in lines.items():
        (tmp_path / name).write_text("\n".join(ls) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = text.numbered_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        got = {(r.file.rsplit("/", 1)[1], r.line): r.text for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(name, i + 1): t for name, ls in lines.items() for i, t in enumerate(ls)}


def test_manifests_and_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    wanted = spark.createDataFrame([("a.txt", "x"), ("b.txt", "x")], "file string, kind string")
    m = text.file_manifest(spark, wanted, str(tmp_path))
    assert {r.file: (r.status, r.bytes) for r in m.collect()} == {"a.txt": ("present", 8), "b.txt": ("missing", None)}
    assert [r.line for r in text.listed_lines(spark, m, "kind", ("y",)).collect()] == ["one", "two"]
    assert text.listed_lines(spark, m, "kind", ("x",)).collect() == []
    listing, policies = spark.createDataFrame([("p", 1), ("q", 2)], "area string, v int"), spark.createDataFrame([("p", "ok")], "area string, policy string")
    with pytest.raises(Exception, match="no policy for q"):
        publish.fetch_plan(listing, policies, "area", "policy", "ok").collect()


def test_a_resumed_build_leaves_parts_alone(spark, tmp_path):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    calls = []

    def build(todo):
        calls.append(sorted(r.k for r in todo.collect()))
        return todo.withColumn("v", F.lit(len(calls)))

    at = str(tmp_path / "t")
    publish.resumed(wanted.filter("k < 2"), at, "k", build)
    publish.resumed(wanted, at, "k", build)
    done, now = publish.resumed(wanted, at, "k", build)
    assert calls == [[1], [2, 3]] and now.collect() == []
    assert sorted(map(tuple, done.select("k", "v").collect())) == [(1, 1), (2, 2), (3, 2)]


def test_admission_of_log_rows(spark):
    schema = "file long, line long, event string, supersedes long"
    log = spark.createDataFrame([(1, 1, "a", None), (1, 2, "correction", 1), (1, 3, "a", None), (2, 3, "a", None)], schema)
    new = spark.createDataFrame([(1, 5, "a", None), (1, 6, "b", None), (1, 7, "correction", 1), (1, 8, "correction", 2), (1, 9, "correction", 3), (1, 10, "correction", 10), (1, 11, "correction", None), (2, 12, "correction", 1)], schema)
    new = new.unionByName(spark.createDataFrame([(1, 13, "correction", 3)], schema))
    got = {r.line: r.verdict for r in oplog.admission(log, new, ("a",)).collect()}
    assert got == {5: "ok", 6: "unknown event", 7: "corrected before", 8: "target is a correction", 9: "ok", 10: "later target", 11: "no target", 12: "no target", 13: "corrected before"}


# Spellings of intervals with and without the unit, and what they mean.
SPELLINGS = {
    "1以上3m未満": (1, 3), "0.3未満": (0, 0.3), "20以上": (20, math.inf), "1以上～3未満": (1, 3), "1m以上 ～ 3m未満": (1, 3), "～0.3m": (0, 0.3), "０．３～０．５ｍ": (0.3, 0.5), "5m～": (5, math.inf), "0.01m以上～0.3m未満\n": (0.01, 0.3), "2m〜5m": (2, 5),
    "20m以上": (20, math.inf), "～ 0.3m未満": (0, 0.3),
    "深い": None, "3～1m": None, "m以上": None, "": None, "1m以上 ～ 1m未満": None, "5～": None, "～0.3": None, "1～2～3m": None, "1m以上3m": None,
}


def test_interval_labels(spark):
    df = spark.createDataFrame([(k,) for k in SPELLINGS], "label string").select("label", C.label_bounds(F.col("label"), strict=False).alias("b"))
    assert {r.label: None if r.b is None else (r.b.low, r.b.high) for r in df.collect()} == SPELLINGS
    with pytest.raises(Exception, match="not a label"):
        df.select(C.label_bounds(F.lit("深い"))).collect()


def test_strict_values(spark):
    df = spark.createDataFrame([(0.0, "離島"), (3.0, None), (10.0, "半島")], "v double, k string")
    assert [r[0] for r in df.select(C.measured(F.col("v"), 3)).collect()] == [None, 3.0, 10.0]
    assert [r[0] for r in df.select(C.member(F.col("k"), ("離島",), ("離島", "半島"))).collect()] == [1, 0, 0]
    for bad in (df.select(C.measured(F.lit(-1.0), 3)), df.select(C.measured(F.lit(2.0), 3)), df.select(C.member(F.lit("x"), ("離島",), ("離島",)))):
        with pytest.raises(Exception, match="not a length|unknown value"):
            bad.collect()


def test_distance_to_polygons_with_holes_and_bays(spark):
    def plain(x, y, rings):
        near, inside = math.inf, False
        for r in rings:
            for (a, b), (c, d) in zip(r, r[1:] + r[:1], strict=True):
                n = (c - a) ** 2 + (d - b) ** 2
                t = max(0.0, min(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / n)) if n else 0.0
                near = min(near, math.hypot(x - a - t * (c - a), y - b - t * (d - b)))
                if (b > y) != (d > y) and x < a + (y - b) / (d - b) * (c - a):
                    inside = not inside
        return 0.0 if inside else near

    bay = [[0.0, 0.0], [6.0, 0.0], [6.0, 6.0], [3.0, 2.0], [0.0, 6.0]]
    hole = [[1.0, 0.5], [1.0, 1.5], [2.0, 1.5], [2.0, 0.5], [1.0, 0.5]]
    rng = random.Random(3)
    points = [(rng.uniform(-3, 9), rng.uniform(-3, 9)) for _ in range(300)] + [(1.5, 1.0), (3.0, 5.0), (0.5, 0.5), (6.0, 3.0)]
    df = spark.createDataFrame([(x, y, [bay, hole]) for x, y in points], "x double, y double, rings array<array<array<double>>>")
    moved = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p[0] - F.col("x"), p[1] - F.col("y"))))
    got = [r[0] for r in df.select(spatial.origin_distance(F.flatten(F.transform(moved, spatial.ring_edges)))).collect()]
    assert got == pytest.approx([plain(x, y, [bay, hole]) for x, y in points], abs=1e-9)
    assert got[300] == pytest.approx(0.5) and got[301] > 0 and got[302] == 0


def test_symmetric_difference_and_sizes(spark):
    a, b = np.array(SQUARE[:4]), np.array(SQUARE[:4]) + [1.0, 2.0]
    assert spatial.symmetric_difference(a, b) == pytest.approx(2 * (16 - 3 * 2))
    assert spatial.symmetric_difference(a, a) == pytest.approx(0)
    rings = [SQUARE, [[x + 0.5, y] for x, y in SQUARE]]
    df = spark.createDataFrame([(1, rings[0]), (1, rings[1]), (2, rings[0])], "id long, ring array<array<double>>")
    got = {r.id: r for r in spatial.outline_sizes(df, "id", 30).collect()}
    data = ("[" + ",".join(sorted(spatial.outline_text(np.array(r)) for r in rings)) + "]").encode()
    assert (got[1].polygons, got[1].bytes, got[1].gzip_bytes) == (2, len(data), len(gzip.compress(data, mtime=0)))
    assert got[2].all_bytes == pytest.approx(30 * (got[1].bytes + got[2].bytes) / 3)


def test_sizes_of_all_outlines(spark):
    s = QUERIES["outline_sizes"](spark, SF).collect()
    assert all(0 < r.gzip_bytes and r.polygons > 0 for r in s) and len({r.all_bytes for r in s}) == 1


def test_cluster_gate_tells_clusters_from_none(spark):
    from lodestar.operators import similar

    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9.0]])
    for planted in (True, False):
        x = rng.standard_normal((400, 3)) + (centres[np.arange(400) % 4] if planted else 0)
        rows = [(i, *v, bool(i % 4 == 1), bool(rng.random() < 0.5)) for i, v in enumerate(x.tolist())]
        df = spark.createDataFrame(rows, "id long, a double, b double, c double, f boolean, g boolean")
        null = similar.permuted(df, "id", ["a", "b", "c"], 5)
        got = {r.k: r for r in similar.cluster_gate(df, null, ["a", "b", "c"], ["f", "g"], ks=(3, 4, 5), starts=4, seeds=(1, 2), subsamples=2).collect()}
        assert [r.k for r in got.values() if r.selected] == ([4] if planted else [])
        if planted:
            assert got[4].qualifies and got[4].seed_ari == got[4].subsample_ari == 1 and got[4].flag == "f" and 0.2 < got[4].flag_ari < 0.8


def test_silhouettes_of_several_clusterings(spark):
    from lodestar.operators import similar

    rng = np.random.default_rng(5)
    x, a, b = rng.standard_normal((60, 2)), rng.integers(0, 3, 60), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(i, *v, int(p), int(q)) for i, (v, p, q) in enumerate(zip(x.tolist(), a, b, strict=True))], "id long, x double, y double, a long, b long")
    got = {(r.id, r.clustering): r.silhouette for r in similar.silhouettes(df, ["x", "y"], ["a", "b"], block=17).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for name, c in (("a", a), ("b", b)):
        for i in range(60):
            own = d[i][(c == c[i]) & (np.arange(60) != i)].mean()
            other = min(d[i][c == k].mean() for k in set(c.tolist()) - {c[i]})
            assert got[i, name] == pytest.approx((other - own) / max(own, other), abs=1e-12)


def _made_up_logs(rng):
    """Rows of logs in any state: (file, line, project, event, supersedes, complete, there)."""
    rows = []
    for file in range(12):
        old = rng.randrange(12)
        for line in range(1, 40):
            event = "loop_start" if line == 1 else rng.choice(["loop_start", "loop_end", "a", "a", "b", "odd", "correction", "correction", "correction"])
            target = rng.choice([None, line, line + 1, *range(max(1, line - 6), line), 1]) if event == "correction" else None
            rows.append((file, line, rng.choice("pppppq"), event, target, rng.random() < 0.9, line <= old))
    return rows


def _verdicts(rows):
    """The rules, said once more over whole lists."""
    out, stands = {}, {}
    for file, line, project, event, target, complete, there in rows:
        seen = stands.setdefault(file, [])
        void = set()
        for r in seen:
            if r[3] == "correction" and any(t[1] == r[4] and t[1] < r[1] and t[3] != "correction" and t[1] not in void for t in seen):
                void.add(r[4])
        force = [r for r in seen if r[3] != "correction" and r[1] not in void]
        ends = [r[1] for r in seen if r[3] == "loop_end"]
        hit = next((r for r in seen if r[1] == target), None)
        if event not in ("loop_start", "loop_end", "a", "b", "correction"):
            v = "unknown event"
        elif not complete:
            v = "missing field"
        elif event == "correction":
            v = "later target" if target is not None and target >= line else "no target" if hit is None else "target is a correction" if hit[3] == "correction" else "corrected before" if target in void else "start is followed" if hit[3] == "loop_start" and len(force) > 1 else "ok"
        elif force and force[0][2] != project:
            v = "other project"
        elif any(r[3] == "loop_end" for r in force) and sum(r[1] > max(ends) and r[3] == event for r in seen) >= sum(r[3] == event and r[1] in void for r in seen):
            v = "after the end"
        else:
            v = "ok"
        if there or v == "ok":
            seen.append((file, line, project, event, target))
        if not there:
            out[file, line] = v
    return out


LOG_SCHEMA = "file long, line long, project string, event string, supersedes long, complete boolean, there boolean"


def test_a_log_is_a_fold_and_a_stream_equals_it(spark, tmp_path):
    from lodestar.streaming.log import follow

    rows = [r for seed in (1, 2) for r in _made_up_logs(random.Random(seed))]
    rows = [(k // 39, *r[1:]) for k, r in enumerate(rows)]
    expected = _verdicts(rows)
    assert set(expected.values()) == {"ok", "unknown event", "missing field", "later target", "no target", "target is a correction", "corrected before", "start is followed", "other project", "after the end"}
    df = spark.createDataFrame(rows, LOG_SCHEMA).withColumn("needed", F.when(F.col("complete"), 1))
    kinds = ("loop_start", "loop_end", "a", "b")
    needs = {k: ("needed",) for k in (*kinds, "correction")}
    got = {(r.file, r.line): r.verdict for r in oplog.admission(df.filter("there"), df.filter("NOT there").repartition(5), kinds, needs).collect()}
    assert got == expected
    for cuts in ([40], [5, 17, 18, 40]):
        at, low = tmp_path / str(len(cuts)), 0
        for cut in cuts:
            df.drop("needed").filter((F.col("line") > low) & (F.col("line") <= cut)).write.mode("append").json(f"{at}/in")
            follow(spark, f"{at}/in", f"{at}/log", f"{at}/progress", kinds)
            low = cut
        assert {(r.file, r.line): r.verdict for r in spark.read.parquet(f"{at}/log").filter("verdict <> ''").collect()} == expected


def test_a_correction_counts_only_if_it_is_valid(spark):
    """The correction of line 7 at line 5 is not one; that at line 9 is the first. One of a row of the same append is one too."""
    schema = "file long, line long, event string, supersedes long"
    log, new = spark.createDataFrame([(1, 4, "a", None)], schema), spark.createDataFrame([(1, 5, "correction", 7), (1, 7, "a", None), (1, 9, "correction", 7), (1, 10, "correction", 7)], schema)
    assert {r.line: r.verdict for r in oplog.admission(log, new, ("a",)).collect()} == {5: "later target", 7: "ok", 9: "ok", 10: "corrected before"}
    assert oplog.admission(log, new.limit(0), ("a",)).count() == 0

