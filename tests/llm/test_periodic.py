"""Periodic runs against all periods at all places."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import periodic as P


def brute(c):
    best = {}
    for q in range(1, len(c) // 4 + 1):
        i = 0
        while i + q < len(c):
            s = i
            while i + q < len(c) and c[i] == c[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                best.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_runs_equal_all_periods(parts):
    c = [x for unit, n in parts for x in unit * n]
    assert P.find_runs(np.array(c, np.int32)) == brute(c)


def test_long_texts_of_few_runs_or_many():
    for c in ([i % 7 for i in range(60_000)], [0] * 60_000, [0 if i % 9 else 1 for i in range(9_000)], [i % 13_000 for i in range(60_000)]):
        found = P.find_runs(np.array(c, np.int32))
        assert (0, len(c), min(q for _, n, q in found if n == len(c))) in found
    assert len(P.find_runs(np.array([0 if i % 9 else 1 for i in range(9_000)], np.int32))) == 1001
    assert P.find_runs(np.arange(50_000, dtype=np.int32)) == []


def expected(doc_id, text):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text or "") if x]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


def test_documents(spark):
    texts = ["", None, " \n", "a a a a a", "a a a a a a", "x y " * 4, "x y " * 3, "a b c " * 5 + "d " + "b c " * 9, "é\x1cé é é é é\tz", "one two three four five six"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "k " * 8), (None, "k " * 8), (3, "a a a a a")]
    docs += [(i, " ".join(str(j * j % (3 + i % 40)) for j in range(i % 90))) for i in range(100, 400)]
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, start int, period string")
    found = P.periodic_runs(df)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(expected(*d)) for d in docs)
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = [(r.doc_id, r.text) for r in rows.collect() if len(r.text or "") < 4000]
    found = {r.doc_id: tuple(r) for r in P.periodic_runs(rows).collect()}
    assert len(short) > 150
    for d in short:
        assert found[d[0]] == expected(*d)
