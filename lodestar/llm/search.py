"""Exact top-k search by block-at-a-time pruning, and approximate nearest neighbours by adaptive dimension scans."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import matched, tidied, written


def whole_vectors(vectors: DataFrame, is_query: Column, allow_zero: bool = True) -> DataFrame:
    """vec_id, vec (array of doubles) and asks of rows that take part: not null, no null or non-finite component, vec_id known."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    return v if allow_zero else v.filter(F.exists("vec", lambda x: x != 0))


def merged_top(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` of each query row's candidates (``query`` tells the row), as rank; groups hold at most k rows from each piece of the data."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)).cast("int")).filter(F.col("rank") <= k)


def _matrix(t: pa.Table) -> np.ndarray:
    """The vectors of rows, which all have one length."""
    return t["vec"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)


# Exact search ------------------------------------------------------------------------------------------------------


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer matrix product a @ b.T: in floating point where that is exact, else in Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    out = a.astype(object) @ b.astype(object).T
    if max((abs(x) for x in out.ravel()), default=0) >= 2**63:
        raise OverflowError("an inner product doesn't fit 64 bits")
    return out.astype(np.int64)


def block_order(x: np.ndarray, size: int) -> np.ndarray:
    """Numbers documents so that ranges of ``size`` are alike: halves by the median of the dimension of most variance."""
    parts, out = [np.arange(len(x))], []
    while parts:
        p = parts.pop()
        if len(p) <= size:
            out.append(p)
            continue
        d = int(x[p].var(axis=0).argmax())
        half = math.ceil(len(p) / 2 / size) * size
        p = p[np.argsort(x[p, d], kind="stable")]
        parts += [p[half:], p[:half]] if half < len(p) else [p]
        if half >= len(p):
            out.append(parts.pop())
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def top_of_chunk(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int, size: int = 64, at_once: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``top_of_blocks`` for any number of queries, ``at_once`` of them at a time against the same blocks."""
    order = block_order(d, size)
    d_ids, d = d_ids[order], d[order]
    parts = []
    for a in range(0, len(q), at_once):
        who, ids, scores = top_of_blocks(q_ids[a : a + at_once], q[a : a + at_once], floor[a : a + at_once], d_ids, d, k, size)
        parts.append((who + a, ids, scores))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def top_of_blocks(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best ``k`` in a chunk of documents: query numbers, vec_ids, scores; only those that can be in the result.

    Documents are cut into ranges of ``size``: blocks, whose forward index is their rows. A term's
    maximum in a block bounds what it adds to a score (its minimum, for negative query weights), the sum bounds the block.
    Each query takes its blocks in descending order of bounds, some at a time, and stops where the bound is below its kth
    score so far, or below ``floor``, a score that its kth is known to reach. Equal bounds are still scored, for ties.
    """
    n_blocks = math.ceil(len(d) / size)
    cuts = np.arange(0, len(d), size)
    hi, lo = np.maximum.reduceat(d, cuts, axis=0), np.minimum.reduceat(d, cuts, axis=0)
    bound = exact_dot(np.maximum(q, 0), hi) + exact_dot(np.minimum(q, 0), lo)
    turn = np.argsort(-bound, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    best = np.full((len(q), k), none)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    limit = floor.copy()
    live = np.arange(len(q))
    at, step = 0, 4
    while at < n_blocks and len(live):
        mine = turn[live, at : at + step]
        ok = np.take_along_axis(bound[live], mine, axis=1) >= limit[live, None]
        live, mine, ok = live[ok[:, 0]], mine[ok[:, 0]], ok[ok[:, 0]]
        scores = np.full((len(live), mine.shape[1], size), none)
        ids = np.full((len(live), mine.shape[1], size), np.iinfo(np.int64).max)
        pair_q, pair_s = np.nonzero(ok)
        block = mine[pair_q, pair_s]
        by = np.argsort(block, kind="stable")
        pair_q, pair_s, block = pair_q[by], pair_s[by], block[by]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
        for s, e in zip(starts, [*starts[1:], len(block)], strict=True):
            rows = slice(block[s] * size, min((block[s] + 1) * size, len(d)))
            got = exact_dot(q[live[pair_q[s:e]]], d[rows])
            got[q_ids[live[pair_q[s:e]]][:, None] == d_ids[rows][None, :]] = none  # a query's own row
            scores[pair_q[s:e], pair_s[s:e], : got.shape[1]] = got
            ids[pair_q[s:e], pair_s[s:e], : got.shape[1]] = d_ids[rows][None, :]
        if len(live):
            all_s = np.concatenate([best[live], scores.reshape(len(live), -1)], axis=1)
            all_i = np.concatenate([best_id[live], ids.reshape(len(live), -1)], axis=1)
            first = np.lexsort((all_i, -np.maximum(all_s, none + 1)), axis=1)[:, :k]
            best[live], best_id[live] = np.take_along_axis(all_s, first, axis=1), np.take_along_axis(all_i, first, axis=1)
            limit[live] = np.maximum(limit[live], best[live, k - 1])
        at += step
        step = min(64, step * 2)
    who, place = np.nonzero((best > none) & (best >= floor[:, None]))
    return who, best_id[who, place], best[who, place]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, queries_per_chunk: int = 16384, docs_per_chunk: int = 32768, warm: int = 64) -> DataFrame:
    """Exact maximum inner products of integer vectors: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries are the rows where ``is_query``; candidates are all rows but the query's own
    (rows with its vec_id); ties go to smaller vec_ids; fewer than ``k`` candidates: all. Rows that whole_vectors drops
    take no part. Vectors whose lengths differ from the query's have no score with it. Scores beyond 64 bits raise. Rows that repeat a vec_id
    each count: as candidates, and each query row has a ranking of its own. Empty table: no rows.

    Queries and candidates are dealt to chunks by hash, and each pair of chunks is one group (top_of_chunk) of bounded size; there are at least
    as many groups as cores while chunks hold 4096 candidates. First each query is scored against about one in ``warm`` candidates: its kth score
    there bounds the kth of all from below, so blocks below it are skipped in every chunk.
    """
    v = whole_vectors(vectors, is_query).withColumn("dim", F.size("vec"))
    v = written(v.select("vec_id", "dim", F.transform("vec", lambda x: F.floor(x * scale).cast("long")).alias("vec"), "asks", F.monotonically_increasing_id().alias("rid")), "topk")
    n, n_q = v.count(), v.filter("asks").count()
    cores = v.sparkSession.sparkContext.defaultParallelism
    n_qc = max(1, math.ceil(n_q / queries_per_chunk))
    n_dc = max(1, math.ceil(n / docs_per_chunk), min(math.ceil(2 * cores / n_qc), n // 4096))
    in_chunk = lambda salt, parts: F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(parts)).cast("int")
    queries, docs = v.filter("asks").withColumn("qc", in_chunk(1, n_qc)), v.withColumn("dc", in_chunk(2, n_dc))

    def groups(queries: DataFrame, docs: DataFrame, n_dc: int) -> DataFrame:
        """Rows of both sides of each pair of chunks: a copy of the queries' rows for each chunk of documents, and the other way round."""
        a = queries.select("dim", "qc", F.explode(F.sequence(F.lit(0), F.lit(n_dc - 1))).alias("dc"), F.lit(True).alias("asks"), "vec_id", "rid", "vec", "floor")
        b = docs.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_qc - 1))).alias("qc"), "dc", F.lit(False).alias("asks"), "vec_id", "rid", "vec", F.lit(None).cast("long").alias("floor"))
        keys = ["dim", "qc", "dc"]
        return a.unionByName(b).repartition(*keys).sortWithinPartitions(*keys, "asks")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, asked, _ in matched(batches, ["dim", "qc", "dc"], 4096):
            if not asked["dim"][0].as_py():
                continue
            ids, rids, floor = asked["vec_id"].to_numpy(), asked["rid"].to_numpy(), asked["floor"].fill_null(np.iinfo(np.int64).min + 1).to_numpy()
            who, found, score = top_of_chunk(ids, _matrix(asked), floor, docs["vec_id"].to_numpy(), _matrix(docs), k)
            yield pa.RecordBatch.from_arrays([pa.array(rids[who]), pa.array(ids[who]), pa.array(found), pa.array(score)], ["query", "query_id", "vec_id", "score"])

    schema = "query long, query_id long, vec_id long, score long"
    best_first = [F.desc("score"), F.asc("vec_id")]
    no_floor = queries.withColumn("floor", F.lit(None).cast("long"))
    if n > 4 * docs_per_chunk // warm:
        few = docs.filter(F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(warm)) == 0)
        n_few = max(1, math.ceil(n / warm / docs_per_chunk))
        some = groups(no_floor, few.withColumn("dc", in_chunk(2, n_few)), n_few).mapInArrow(tidied(search), schema)
        floors = written(merged_top(some, k, best_first).filter(F.col("rank") == k).select(F.col("query").alias("rid"), F.col("score").alias("floor")), "floors")
        queries = queries.join(floors, "rid", "left")
    else:
        queries = no_floor
    found = groups(queries, docs, n_dc).mapInArrow(tidied(search), schema)
    return merged_top(found, k, best_first).select("query_id", "rank", "vec_id", "score")


# Approximate search ------------------------------------------------------------------------------------------------


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for every run."""
    m, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return m * np.sign(np.diag(r))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct random rows; empty ones stay where they are.

    Over 1024 centroids are found in two levels: about sqrt(k) coarse ones, then those of each one's rows in proportion to them.
    """
    if k > 1024:
        coarse = k_means(x, math.isqrt(k), rounds, seed)
        near = nearest_lists(x, coarse, 1)[:, 0]
        return np.vstack([k_means(part, max(1, round(k * len(part) / len(x))), rounds, seed) for c in range(len(coarse)) if len(part := x[near == c])])
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest_lists(x, c, 1)[:, 0]
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_lists(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Each row's ``n`` nearest centroids, nearest first."""
    out = np.empty((len(x), min(n, len(c))), np.int64)
    half = (c * c).sum(axis=1) / 2
    step = max(16, 1_000_000 // len(c))
    for a in range(0, len(x), step):
        far = half - x[a : a + step] @ c.T
        out[a : a + step] = far.argmin(axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def adaptive_scan(q: np.ndarray, x: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, k: int, columns: int, epsilon: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's ``k`` nearest rows of x (both rotated): number, positions, squared distances.

    x is held in blocks of ``columns`` dimensions. After each block a candidate is abandoned if its partial distance, scaled to all
    dimensions, is over the kth best by more than the error that a random rotation allows at this depth
    (1 + epsilon / sqrt(dimensions seen)); those that pass to the end have their full distance. The first candidates, 4 * k of
    them, are scored fully and set the first kth best; batches of rows then tighten it.
    """
    dim = x.shape[1]
    blocks = [np.ascontiguousarray(x[:, a : a + columns]) for a in range(0, dim, columns)]
    for i in range(len(q)):
        others = np.flatnonzero(ids != q_ids[i])
        kept, dist = np.zeros(0, np.int64), np.zeros(0)
        limit = np.inf
        at, step = 0, 4 * k
        while at < len(others):
            live = others[at : at + step]
            part, seen = np.zeros(len(live)), 0
            for b in blocks:
                diff = b[live] - q[i, seen : seen + b.shape[1]]
                part = part + np.einsum("ij,ij->i", diff, diff)
                seen += b.shape[1]
                slack = (1 + epsilon / math.sqrt(seen)) ** 2 * seen / dim if seen < dim else 1 + 1e-9
                if limit < np.inf:
                    ok = part <= limit * slack
                    live, part = live[ok], part[ok]
                if not len(live):
                    break
            kept, dist = np.concatenate([kept, live]), np.concatenate([dist, part])
            if len(kept) > k:
                first = np.lexsort((ids[kept], dist))
                near = dist[first[k - 1]] * (1 + 1e-9)
                first = first[dist[first] <= near]
                kept, dist, limit = kept[first], dist[first], near
                if len(kept) > 4 * k:  # many ties: those with the smallest vec_ids are enough
                    tie = np.lexsort((ids[kept], np.round(dist / max(near, 1e-300), 9)))[: 2 * k]
                    kept, dist = kept[tie], dist[tie]
            elif len(kept) == k:
                limit = dist.max() * (1 + 1e-9)
            at += step
            step = 2048
        yield i, kept, dist


def _probes(rows: DataFrame, model: tuple, sizes: dict[int, int], k: int, recall: float, tuning_queries: int) -> int:
    """How many of its nearest lists a query must scan so that they hold the share ``recall`` of the true ``k`` nearest rows."""
    turn, centroids, scale = model
    few = rows.filter("asks").orderBy(F.xxhash64("vec_id"), "vec_id", "rid").limit(tuning_queries).select("rid", "vec_id", "vec").toArrow()
    if not len(few):
        return 1
    rids, q_ids = few["rid"].to_numpy(), few["vec_id"].to_numpy()
    q = few["vec"].combine_chunks().flatten().to_numpy().reshape(len(few), -1) / scale

    def brute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(ids), -1) / scale
            d = (q * q).sum(axis=1)[:, None] - 2 * q @ x.T + (x * x).sum(axis=1)
            d[q_ids[:, None] == ids[None, :]] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            who = np.repeat(np.arange(len(q)), near.shape[1])
            cols = [rids[who], ids[near.ravel()], lists[near.ravel()], d[who, near.ravel()]]
            ok = np.isfinite(cols[3])
            yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in cols], ["query", "vec_id", "list", "d"])

    found = rows.select("vec_id", "vec", "list").mapInArrow(tidied(brute), "query long, vec_id long, list int, d double")
    true = merged_top(found, k, [F.asc("d"), F.asc("vec_id")]).select("query", "list").collect()
    full = np.array([c for c in range(len(centroids)) if sizes.get(c)])
    ranked = full[nearest_lists(q @ turn, centroids[full], len(full))]
    at = {int(i): {int(c): r for r, c in enumerate(row)} for i, row in zip(rids, ranked, strict=True)}
    places = sorted(at[r["query"]][r["list"]] for r in true)
    return places[math.ceil(recall * len(places)) - 1] + 1 if places else 1


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.97, rows_per_list: int = 800, max_lists: int = 65_536, sample_rows: int = 40_000, tuning_queries: int = 128, piece: int = 8192, columns: int = 16, epsilon: float = 2.1) -> DataFrame:
    """Approximate nearest neighbours by Euclidean distance: query_id, rank, vec_id, score (exact, in double precision).

    An inverted file for each length of vectors: one centroid for each ``rows_per_list`` rows, at most ``max_lists``, from a sample of about
    ``sample_rows`` rows or eight for each list, so the model that is broadcast is bounded; every row is indexed in the list of its nearest centroid. Vectors are
    rotated at random, so that partial distances tell of whole ones, and a query scans its nearest lists with adaptive_scan. How
    many is measured: ``tuning_queries`` of the queries are compared with all rows (one pass, in blocks), and as many lists are probed as hold
    the share ``recall`` of their true neighbours; a query's probes go on until they hold over ``k`` rows. Lists are cut into pieces of about ``piece`` rows, so a hot list is many tasks.
    What survives is ranked by the exact distance between the original vectors, ties to smaller vec_ids.

    Queries are the rows where ``is_query``; candidates are all other rows (rows with the query's vec_id are its own) of its length. Null or zero vectors
    and those with null or non-finite components take no part. Rows that repeat a vec_id each count: as candidates, and each query row has a ranking
    of its own. Empty table: no rows.
    """
    v = whole_vectors(vectors, is_query, allow_zero=False).withColumn("dim", F.size("vec"))
    # One row per length of vectors.
    dims = v.groupBy("dim").agg(F.count("*").alias("n"), F.bool_or("asks").alias("asks")).filter("asks").orderBy("dim").collect()
    parts = [_of_length(v.filter(F.col("dim") == r["dim"]).drop("dim"), r["dim"], r["n"], k, recall, min(max_lists, max(1, r["n"] // rows_per_list)), sample_rows, tuning_queries, piece, columns, epsilon) for r in dims]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_length(v: DataFrame, dim: int, n: int, k: int, recall: float, n_lists: int, sample_rows: int, tuning_queries: int, piece: int, columns: int, epsilon: float) -> DataFrame:
    """``nearest_neighbours`` among the ``n`` rows of one length."""
    spark = v.sparkSession
    sample_rows = max(sample_rows, 8 * n_lists)
    share = min(1.0, sample_rows / n)
    sample = v.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0)).select("vec").limit(2 * sample_rows).toArrow()
    if not len(sample):  # few vec_ids that repeat
        sample = v.select("vec").limit(sample_rows).toArrow()
    turn = rotation(dim)
    x = sample["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    scale = float(np.abs(x).max(initial=0)) or 1.0
    model = spark.sparkContext.broadcast((turn, k_means(x / scale @ turn, n_lists), scale))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centroids, scale = model.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim) / scale @ turn
            near = nearest_lists(x, centroids, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "list"])

    rows = v.select("vec_id", "vec", "asks").mapInArrow(tidied(assign), "vec_id long, vec array<double>, asks boolean, list int")
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "ivf")
    # At most n_lists rows.
    sizes = {r[0]: r[1] for r in rows.groupBy("list").count().collect()}
    held = spark.sparkContext.broadcast(sizes)
    probes = _probes(rows, model.value, sizes, k, recall, tuning_queries)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centroids, scale = model.value
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, dim) / scale @ turn
            out = []
            for a in range(0, len(x), 64):
                for ranked in nearest_lists(x[a : a + 64], centroids, len(centroids)).tolist():
                    mine, total = [], 0
                    for c in ranked:
                        if len(mine) >= probes and total > k:
                            break
                        if held.value.get(c):
                            mine.append(c)
                            total += held.value[c]
                    out.append(mine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "lists"])

    # Lists that are cut into pieces: at most n_lists rows.
    cut = F.broadcast(spark.createDataFrame([(c, math.ceil(m / piece)) for c, m in sizes.items() if m > piece], "list int, pieces int"))
    pieces = F.coalesce("pieces", F.lit(1))
    asked = rows.filter("asks").select("vec_id", "rid", "vec").mapInArrow(tidied(route), "vec_id long, rid long, vec array<double>, lists array<int>")
    asked = asked.select("vec_id", "rid", "vec", F.explode("lists").alias("list")).join(cut, "list", "left").withColumn("part", F.explode(F.sequence(F.lit(0), pieces - 1)))
    there = rows.join(cut, "list", "left").withColumn("part", F.pmod(F.xxhash64("rid"), pieces).cast("int"))
    both = asked.select("list", "part", F.lit(True).alias("asks"), "vec_id", "rid", "vec").unionByName(there.select("list", "part", F.lit(False).alias("asks"), "vec_id", "rid", "vec"))
    both = both.repartition("list", "part").sortWithinPartitions("list", "part", "asks", "vec_id", "rid")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _, scale = model.value
        for docs, asked, fresh in matched(batches, ["list", "part"], 4096):
            if fresh:
                d_raw, d_ids = _matrix(docs), docs["vec_id"].to_numpy()
                x = d_raw / scale @ turn
            q_raw, q_ids, rids = _matrix(asked), asked["vec_id"].to_numpy(), asked["rid"].to_numpy()
            out = []
            for i, kept, _ in adaptive_scan(q_raw / scale @ turn, x, d_ids, q_ids, k, columns, epsilon):
                exact = np.sqrt(((d_raw[kept] - q_raw[i]) ** 2).sum(axis=1))
                first = np.lexsort((d_ids[kept], exact))[:k]
                out.append((np.full(len(first), rids[i]), np.full(len(first), q_ids[i]), d_ids[kept[first]], exact[first]))
            cols = [np.concatenate(z) for z in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "query_id", "vec_id", "score"])

    found = both.mapInArrow(tidied(scan), "query long, query_id long, vec_id long, score double")
    return merged_top(found, k, [F.asc("score"), F.asc("vec_id")]).select("query_id", "rank", "vec_id", "score")
