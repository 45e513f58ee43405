import pytest

import __spark_entry__ as entry
from lodestar.plans.registry import ORACLE_SQL, QUERIES

from .oracle import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), ORACLE_SQL[name], duck) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_orders_and_labels_are_read(spark):
    """Against loops over whole tables; no query stops at an order or a part."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey", "l_extendedprice / 100 AS y").collect()
    pages = {}
    for r in rows:
        pages.setdefault(r.l_orderkey // 50, set()).add(r.y)
    expected = {}
    for page, ys in pages.items():
        kept = []
        for y in sorted(ys):
            if not kept or y - kept[-1] > 20:
                kept.append(y)
        expected[page] = (len(ys), len(kept), round(kept[-1], 4))
    assert max(pages) > 2000 // 50
    assert {r.page: (r.n, r.kept, r["last"]) for r in QUERIES["kept_edges"](spark, SF).collect()} == expected
    assert QUERIES["text_lines"](spark, SF).agg({"n": "sum"}).first()[0] == len(rows)
    u = {(r.canonical, r.low, float("inf") if r.high < 0 else r.high) for r in QUERIES["parsed_labels"](spark, SF).collect()}
    nested = sorted((a, b) for a, x, y in u for b, v, w in u if x < v and w < y)
    assert sorted(map(tuple, QUERIES["nested_labels"](spark, SF).select("outer_label", "inner_label").collect())) == nested


def test_protocols_are_whole(spark):
    """5 x 5 folds, logistic regression on three sets of columns, five starts of the perceptron."""
    from inspect import signature

    from lodestar.operators import metrics

    assert {r.seed for r in QUERIES["seed_robustness"](spark, SF).select("seed").collect()} == {1, 2, 3, 4, 20260914}
    assert [signature(f).parameters[a].default for f in (metrics.cross_validated, metrics.seed_spread) for a in ("folds", "repeats")] == [5, 5, 5, 5]
    assert [signature(metrics.boosted).parameters[a].default for a in ("rounds", "rate", "bins")] == [300, 0.05, 255]
    assert sum(r.model.startswith("logistic") for r in QUERIES["cross_validation"](spark, SF).select("model").collect()) == 3
