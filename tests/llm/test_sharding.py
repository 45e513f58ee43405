"""Sharding over virtual slots: equal bytes, gapless places, versions of the map."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm import sharding as S

SCHEMA = "doc_id long, text string"


def balance(rows, shards):
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    return max(load.values()) - min(load.get(s, 0) for s in range(shards))


def check(rows, texts, shards):
    """``texts``: (doc_id, text) pairs that went in."""
    said = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert said == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    places = {}
    for r in rows:
        places.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_bytes_are_near_equal(spark):
    texts = [(i, f"text {i} " * (1 + i % 37)) for i in range(6000)]
    out, edits = S.sharded(spark.createDataFrame(texts, SCHEMA), 6)
    rows = out.collect()
    check(rows, texts, 6)
    assert balance(rows, 6) < 0.002 * sum(r.size for r in rows) / 6
    at = {r.virtual_slot: r.shard for r in S.map_at(edits).collect()}
    assert all(at[r.virtual_slot] == r.shard for r in rows)
    again, _ = S.sharded(spark.createDataFrame(texts, SCHEMA), 6, edits=edits)
    moved = {(r.doc_id, r.shard) for r in rows} - {(r.doc_id, r.shard) for r in again.collect()}
    assert len(moved) <= 0.08 * len(rows)


def test_equal_texts_share_a_shard_unless_they_are_hot(spark):
    texts = [(i, f"pair {i // 2}") for i in range(3000)] + [(None, "the same text again")] * 1500 + [(7, "the same row")] * 300
    out, _ = S.sharded(spark.createDataFrame(texts, SCHEMA), 8)
    rows = out.collect()
    check(rows, texts, 8)
    shards = {}
    for r in rows:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(shards[zlib.crc32(b"the same text again")]) == 8
    assert all(len(shards[zlib.crc32(f"pair {i}".encode())]) == 1 for i in range(1500))
    assert balance(rows, 8) < 0.02 * sum(r.size for r in rows) / 8


def test_growth_only_fills_the_new_shard(spark):
    out, edits = S.sharded(spark.createDataFrame([(i, f"text {i}") for i in range(5000)], SCHEMA), 5)
    sizes = S.slot_sizes(out)
    more = S.grown(edits, sizes, 5)
    assert {(r.version, r.shard) for r in more.collect()} == {(2, 5)}
    bytes_there = more.join(sizes, "virtual_slot").agg(F.sum("bytes")).first()[0]
    total = out.agg(F.sum("size")).first()[0]
    assert 0.97 * total / 6 <= bytes_there <= total / 6
    # Back to five: what the sixth held is dealt to the others, and an older version can still be read.
    back = S.rebalanced(edits.unionByName(more), sizes, 5)
    now = {r.virtual_slot: r.shard for r in S.map_at(edits.unionByName(more).unionByName(back)).collect()}
    assert set(now.values()) == set(range(5)) and set(now) == set(range(S.SLOTS))
    assert {r.shard for r in S.map_at(edits.unionByName(more), 1).collect()} == set(range(5))


@pytest.mark.parametrize("texts", [[], [(None, None)], [(None, None), (None, ""), (3, None), (3, None)], [(1, "x" * 3_000_000), (2, "y")]])
def test_cases(spark, texts):
    df = spark.createDataFrame(texts, SCHEMA)
    for c in ("shard", "slot", "size", "virtual_slot", "law"):
        df = df.withColumn(c, F.lit("clash"))
    check(S.sharded(df, 3)[0].collect(), texts, 3)
