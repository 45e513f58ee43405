"""N-gram Jaccard join by chosen paths: sets follow sampled shared tokens into buckets, small buckets are brute-forced."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, dropped, grouped, inner_by_key, join_by_key, made, row_ids, spread, text_udf, tidied, written

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SLICE = 1 << 15
_GAP = re.compile(r"\s")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are white space (the last entry stands for all beyond), powers of an odd number, and their inverses."""
    gap = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
    odd = 0xA0761D6478BD642F
    up, down = (np.full(_SLICE + 1, x, np.uint64) for x in (odd, pow(odd, -1, 1 << 64)))
    up[0] = down[0] = 1
    return gap, np.cumprod(up), np.cumprod(down)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (white space apart) of a text, in order; the text is read in slices that end where a word does."""
    out = [np.zeros(0, np.uint64)]
    a = 0
    while a < len(text):
        b = a + _SLICE
        if b < len(text):
            while b > a and not text[b].isspace():
                b -= 1
            if b == a:  # a word longer than a slice
                m = _GAP.search(text, a + _SLICE)
                b = m.start() if m else len(text)
        out += [_hashed(text[a:b])] if b - a <= _SLICE else [_hashed(w) if len(w) <= _SLICE else np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))], np.uint64) for w in text[a:b].split()]
        a = b
    return out[1] if len(out) == 2 else np.concatenate(out)


def _hashed(text: str) -> np.ndarray:
    gaps, up, down = _tables()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    gap = gaps[np.minimum(cp, 0x3001)]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    x = (cp + np.uint32(1)) * up[: len(cp)]  # plus one, so that U+0000 counts
    x[gap] = 0
    h = np.add.reduceat(x, starts) * down[starts]  # as if each word began at 0
    h ^= h >> np.uint64(32)
    h *= _Q
    return h ^ (h >> np.uint64(29))


def shingles(text: str, n: int = 5) -> np.ndarray:
    """The distinct runs of ``n`` words (white space apart, case kept) as 64-bit hashes, sorted.

    A text of one to ``n - 1`` words is one run; one without words has none.
    """
    w = word_hashes(text)
    if not len(w):
        return w
    m = max(1, len(w) - n + 1)
    h = np.zeros(m, np.uint64)
    for i in range(min(n, len(w))):
        h += w[i : i + m]
        h *= _P
        h ^= h >> np.uint64(29)
    h *= _P
    h.sort()
    new = np.empty(m, bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


@lru_cache(4)
def _mix(hashes: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 31, (2, hashes, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def min_hashes(s: np.ndarray, hashes: int) -> np.ndarray:
    """Independent min-hashes (32 bits) of a set of 64-bit hashes."""
    times, plus = _mix(hashes)
    out = np.full(hashes, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(s), 2048):
        x = times * (s[a : a + 2048] >> np.uint64(32)).astype(np.uint32)
        x += plus
        np.minimum(out, x.min(axis=1), out=out)
    return out.astype("<u4")


def sketches(docs: DataFrame, hashes: int, n: int = 5) -> DataFrame:
    """``docs`` without text and with key (MD5 of the text), sketch (``hashes`` 32-bit min-hashes), short (their low bytes) and weight.

    Null without words. weight is 1 for texts of up to 4096 shingles and grows with them, so that blocks of texts are bounded in bytes.
    """
    names, kinds = ["key", "sketch", "short", "weight"], (pa.binary(), pa.binary(), pa.binary(), pa.int64())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows: list[tuple] = []
            for t in batch:
                text = t.as_py() or ""
                s = shingles(text, n)
                if len(s):
                    m = min_hashes(s, hashes)
                    rows.append((hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest(), m.tobytes(), m.astype(np.uint8).tobytes(), 1 + len(s) // 4096))
                else:
                    rows.append((None, None, None, None))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    made = text_udf(run, "key binary, sketch binary, short binary, weight long")
    return docs.withColumn("__s", made(F.col("text").cast("string"))).drop("text").select("*", "__s.*").drop("__s")


def runs_for(recall: float, similarity: float, levels: int) -> int:
    """Runs after which a pair of that similarity has met with probability ``recall`` even in buckets of the deepest level."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**levels))


def leaves(texts: DataFrame, runs: int, levels: int, bucket: int) -> DataFrame:
    """Where each run takes each text: key, run, leaf, size (the weight of the leaf's texts).

    A run samples one token of each set (the least under its hash function, so that two sets share it with the
    probability of their similarity); texts that share it share a bucket. Buckets of one go, those of up to ``bucket`` are
    leaves, larger ones split by the next sampled token, down to ``levels``; what is still larger then is a leaf too.
    Each row carries the tokens of its run's deeper levels, so a split needs no join; texts of a hot bucket stay where they are while
    they learn its size.
    """
    at = texts.select("key", "weight", "sketch", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    # The tokens of a run: the sketch's hashes from run * levels on, 4 bytes each.
    at = at.select("key", "run", "weight", F.expr(f"substring(sketch, {4 * levels} * run + 1, {4 * levels})").alias("tokens"))
    token = lambda level: F.substring("tokens", 4 * level + 1, 4)
    at = at.withColumn("leaf", F.xxhash64("run", token(0)))
    total = texts.count() * runs
    done: DataFrame | None = None
    for level in range(levels):
        sizes = at.groupBy("leaf").agg(F.sum("weight").alias("size"), F.count("*").alias("n")).filter("n > 1")
        met = written(inner_by_key(at, sizes, "leaf", "n", total).select("key", "run", "weight", "tokens", "leaf", "size"), "paths")
        last = level == levels - 1
        small = met if last else met.filter(F.col("size") <= bucket)
        done = small if done is None else done.unionByName(small)
        large = met.filter(F.col("size") > bucket)
        total = 0 if last else large.count()
        if not total:
            break
        at = large.select("key", "run", "weight", "tokens", F.xxhash64("leaf", token(level + 1)).alias("leaf"))
    return done.select("key", "run", "leaf", "size")


def _pairs(leaf: np.ndarray, run: int, block: np.ndarray, two: bool) -> np.ndarray:
    """Which pairs of a group are its own: not met in an earlier run, and from different blocks if the group has two."""
    m = len(leaf)
    own = np.triu(np.ones((m, m), bool), 1)
    for r in range(run):
        x = leaf[:, r]
        own &= (x[:, None] != x[None, :]) | (x == 0)[:, None]
    if two:
        own &= block[:, None] != block[None, :]
    return own


def _array(col: pa.ChunkedArray, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=kind).reshape(-1, width)


def _leaf_matrix(col: pa.ChunkedArray, runs: int) -> np.ndarray:
    return np.array(col.to_pylist(), dtype=np.int64).reshape(-1, runs)


_GROUP = ["leaf", "first", "second"]


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of a group next to each other: one shuffle and a sort."""
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "key")


def candidates(texts: DataFrame, runs: int, hashes: int, bucket: int, likely: float) -> DataFrame:
    """Who has a partner that sketches call likely, in which group: key, __file, __row, leaf, first, second, block, run, met.

    ``texts`` has key, __file, __row, short and paths: run, leaf and the leaf's size of each run that keeps the text. Leaves of over ``bucket`` texts are dealt into
    blocks, and each pair of blocks is a group, so that no task holds more than two blocks at a time. A pair counts only in the first run in
    which it meets (``met``, the leaf of each run, tells), so no pair is listed twice and no pairs have to be written to find that out.
    One row per text and group.
    """
    leaf = F.map_from_entries(F.transform("paths", lambda p: F.struct(p["run"], p["leaf"])))
    met = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0)))
    at = texts.withColumn("m", leaf).withColumn("met", met).select("key", *ROW, "short", "met", F.explode("paths").alias("p")).select("key", *ROW, "short", "met", "p.*")
    blocks = F.ceil(F.col("size") / bucket).cast("int")
    block = F.pmod(F.xxhash64("key"), blocks).cast("int")
    rows = at.withColumn("blocks", blocks).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", *ROW, "short", "met", "run", "leaf", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))

    def run_(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[pa.Table] = []
        n = 0
        for g in grouped(batches, _GROUP):
            if len(g) < 2:
                continue
            short, met = _array(g["short"], hashes, "u1"), _leaf_matrix(g["met"], runs)
            own = _pairs(met, g["run"][0].as_py(), g["block"].to_numpy(), g["first"][0].as_py() != g["second"][0].as_py())
            for i in range(0, len(g), 128):
                own[i : i + 128] &= (short[i : i + 128, None, :] == short[None, :, :]).sum(axis=2) >= likely * hashes
            who = own.any(axis=0) | own.any(axis=1)
            if who.any():
                keep.append(g.drop_columns(["short"]).filter(pa.array(who)))
                n += len(keep[-1])
            if n > 5000:
                yield from pa.concat_tables(keep).combine_chunks().to_batches()
                keep, n = [], 0
        if keep:
            yield from pa.concat_tables(keep).combine_chunks().to_batches()

    return _placed(rows).mapInArrow(tidied(run_), "key binary, __file long, __row long, met array<long>, run int, leaf long, block int, first int, second int")


def linked(sets: list[np.ndarray], similarity: float, at_once: int = 1_000_000) -> np.ndarray:
    """Which pairs of sets have the Jaccard similarity or more, exactly, as a symmetric matrix.

    Sets are taken by size, in chunks of about ``at_once`` tokens; sets whose sizes alone rule the similarity out never meet.
    Shared tokens are counted by matrix products over the tokens that two sets of a chunk pair have in common.
    """
    size = np.array([len(s) for s in sets], dtype=np.float64)
    out = np.zeros((len(sets), len(sets)), bool)
    by = np.argsort(size, kind="stable")
    chunk = (np.cumsum(size[by]) // at_once).astype(np.int64)
    parts = [by[chunk == c] for c in np.unique(chunk)]
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            b = parts[j]
            if size[a[-1]] < similarity * size[b[0]] - 1e-9:
                break
            both = a if i == j else np.concatenate([a, b])
            row = np.repeat(np.arange(len(both)), size[both].astype(np.int64))
            _, col, times = np.unique(np.concatenate([sets[x] for x in both]), return_inverse=True, return_counts=True)
            shared = times[col] > 1
            row, col = row[shared], (np.cumsum(times > 1) - 1)[col[shared]]
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            common = np.zeros((len(both), len(both)))
            width = max(64, 2_000_000 // len(both))
            for at in range(0, int((times > 1).sum()), width):
                lo, hi = np.searchsorted(col, (at, at + width))
                x = np.zeros((len(both), width), np.float32)
                x[row[lo:hi], col[lo:hi] - at] = 1
                common += x @ x.T
            s = size[both]
            out[np.ix_(both, both)] |= common >= similarity * (s[:, None] + s[None, :] - common) - 1e-9
    return out


def verified(found: DataFrame, runs: int, similarity: float, n: int = 5) -> DataFrame:
    """Exact Jaccard similarity within the groups of ``candidates`` with their texts: key, links, root.

    links counts a text's links in the group, root is the least key that its links lead to there. One row per linked
    text and group; pairs stay in the task.
    """

    def run_(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in grouped(batches, _GROUP):
            keys = g["key"].to_pylist()
            if len(keys) < 2:
                continue
            own = _pairs(_leaf_matrix(g["met"], runs), g["run"][0].as_py(), g["block"].to_numpy(), g["first"][0].as_py() != g["second"][0].as_py())
            sets = [shingles(t.as_py(), n) for t in g["text"]]
            link = own & linked(sets, similarity)
            link |= link.T
            if not link.any():
                continue
            order = np.argsort(np.array(keys, dtype=object), kind="stable")
            label = np.empty(len(keys), np.int64)
            label[order] = np.arange(len(keys))
            while True:
                least = np.minimum(label, np.where(link, label[None, :], len(keys)).min(axis=1))
                if (least == label).all():
                    break
                label = least
            count = link.sum(axis=1)
            out += [(keys[i], int(count[i]), keys[order[label[i]]]) for i in np.flatnonzero(count)]
            if len(out) > 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["key", "links", "root"])

    return _placed(found).mapInArrow(tidied(run_), "key binary, links long, root binary")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): node, root (the least node), without nodes that have no edge.

    Large-star and small-star steps alternate until nothing changes, each a minimum per node and a join; tables are
    written between rounds, and only counts and sums of hashes come to the driver.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now = state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = inner_by_key(both, least, "a", "n", 2 * now[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.filter("a > m").select("a", F.col("m").alias("b"))).distinct()
        large = written(large, "stars")
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = inner_by_key(large, down, "a", "n", now[0]).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        e = written(small, "links")
        then, now = now, state(e)
        if then == now:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, n: int, similarity: float, recall: float, levels: int, bucket: int, likely: float) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (doc_id, __file, __row and what else it has, without text) with their key, and per key: root, class_id, n_links, n_copies.

    root is the least key of the class, class_id its least doc_id. Of all copies of a text one row, told by its place in its file, is read again for
    verification, whatever doc_ids the copies have.
    """
    runs = runs_for(recall, similarity, levels)
    hashes = runs * levels
    since = len(made())
    seen = written(sketches(spread(docs), hashes, n), "sketches")
    texts = seen.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min(F.struct(*ROW)).alias("at"), F.count("*").alias("n_copies"), *[F.first(c).alias(c) for c in ("sketch", "short", "weight")])
    texts = written(texts, "texts")
    paths = leaves(texts, runs, levels, bucket).groupBy("key").agg(F.collect_list(F.struct("run", "leaf", "size")).alias("paths"))
    known = texts.select("key", "at.*", "short").join(paths, "key")
    likely_ones = written(candidates(known, runs, hashes, bucket, likely), "candidates")
    found = likely_ones.join(docs.select(*ROW, "text"), ROW)
    links = written(verified(found, runs, similarity, n), "verified")
    nodes = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    member = texts.select("key", "rep", "n_copies").join(nodes.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    member = written(member.join(counts, "key", "left"), "members")
    # A class of one text is named by it; the others' names are one row per class.
    inside = member.filter("n_links is not null")
    names = inside.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n_texts"))
    named = inner_by_key(inside.select("root", "key", "n_copies", "n_links"), names, "root", "n_texts", inside.count())
    alone = member.filter("n_links is null").select("root", "key", "n_copies", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("class_id"))
    report = written(named.unionByName(alone), "classes")
    dropped(docs.sparkSession, since, (made()[since], made()[-1]))
    return seen.drop("sketch", "short", "weight"), report


def jaccard_join(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.999, levels: int = 4, bucket: int = 512, likely: float = 0.6) -> DataFrame:
    """Near-duplicate classes of documents: doc_id, class_id, n_links, n_copies.

    Two texts are linked if the Jaccard similarity of their sets of ``n``-word runs is ``similarity`` or more; a
    class is what links connect, named by its least doc_id. n_links: different texts that the document's text is linked to; n_copies:
    documents with exactly its text, itself too. Copies are collapsed first and never expanded into pairs. Candidates come
    from chosen-path runs (see leaves), as many as ``recall`` asks for at the deepest level; sketches drop
    those far below the limit (``likely``); the rest are verified exactly, each pair once.

    Null or empty texts and texts without words have no links: each is a class of its own (n_copies 1). Null doc_ids are kept
    (class_id is then the least known doc_id of the class, or null). Repeated rows count as copies. An empty table gives no rows. Very long texts are read whole. Other
    columns are ignored, whatever their names.
    """
    rows, report = classes(row_ids(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *ROW), n, similarity, recall, levels, bucket, likely)
    report = report.select("key", "class_id", "n_links", "n_copies", F.col("n_copies").alias("copies"))
    out = join_by_key(rows, report, "key", "copies", F.xxhash64("doc_id"), rows.count())
    return out.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def deduplicated(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.999, levels: int = 4, bucket: int = 512, likely: float = 0.6) -> DataFrame:
    """``docs`` with one row of each near-duplicate class of ``jaccard_join``.

    The row that stays has the least doc_id (rows without one come last); among rows of one doc_id, the one with the least hash of its columns, so
    reruns agree. Rows without words are classes of their own and stay. Rows are told apart by where they stand in their files,
    so null and repeated doc_ids lose nothing. An empty table stays empty. Columns may have any names but __file and __row, which raise as ambiguous.
    """
    ids = row_ids(docs)
    plain = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *ROW, F.xxhash64(*docs.columns).alias("mark"))
    rows, report = classes(plain, n, similarity, recall, levels, bucket, likely)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "mark", *ROW))
    # Copies of a text give way to one of them first, then the texts of a class.
    best = written(rows.filter("key is not null").groupBy("key").agg(first.alias("best")), "copies")
    one = best.join(report.select("key", "root"), "key").groupBy("root").agg(F.min("best").alias("best")).select(*[f"best.{c}" for c in ROW])
    kept = written(one.unionByName(rows.filter("key is null").select(*ROW)), "kept")
    return ids.join(kept, ROW, "left_semi").select(docs.columns)


def brute_force(texts: dict[int, str], n: int = 5, similarity: float = 0.8) -> dict[int, tuple[int, int]]:
    """class_id and n_links by comparing all pairs (for tests)."""
    sets = {d: set(shingles(t or "", n).tolist()) for d, t in texts.items()}
    root = {d: d for d in texts}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    near: dict[int, set[str]] = {d: set() for d in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                if texts[a] != texts[b]:
                    near[a].add(texts[b])
                    near[b].add(texts[a])
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (top(d), len(near[d])) for d in ids}
