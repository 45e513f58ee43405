"""Mixing sources to target weights by entropy balancing. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, join_by_key, made, written

#: A word, for sizes: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_copies: int) -> DataFrame:
    """Each source's rank, size and target, from (source, source_size).

    Sources in order of code points, null last, weigh ``weights`` in turn and share the sum of all sizes. No target
    is above ``max_copies`` times its source's size; the excess is shared again by weight until none is above. That level
    is found directly: with caps per weight in order, it is the largest of (what is left) / (weight left).
    One row per source, so the windows without partitions run over sources, not documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w)
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    out = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return out.withColumn("target", F.least("cap", F.col("weight") * F.col("level"))).drop("level")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def size_bin(size: Column) -> Column:
    """Sizes below 4096 each on their own, larger ones by steps of about 0.2 %: at most some ten thousand bins."""
    return F.when(size < 4096, size).otherwise(F.floor(F.log(size.cast("double")) * 512) + 10_000).cast("long")


def solve_dual(hist: DataFrame, targets: DataFrame, max_copies: int, steps: int = 60, tolerance: float = 1e-12) -> DataFrame:
    """Each source's multiplier (rank, lam) with sum(tokens * min(max_copies, exp(lam * z))) = target, z = size / mean size.

    ``hist`` has rank, z and tokens of the source's size bins, sums over all documents that are taken where these are. Newton's
    method on the logarithm of the token constraint, which is the gradient of the convex dual, is kept inside a bracket (else the step halves the
    bracket, or doubles while it is open) and starts from the logarithm of target over size; a source's steps fold over its bins, sources
    side by side. Sources that are empty, or whose target is their cap, need no multiplier and have no row.
    """
    cap = F.lit(float(max_copies))

    def step(acc: Column, _: Column) -> Column:
        def sums(a: Column, x: Column) -> Column:
            return _let(F.exp(F.least(acc["lam"] * x["z"], F.lit(700.0))), lambda e: F.struct((a["f"] + x["tokens"] * F.least(e, cap)).alias("f"), (a["df"] + F.when(e < cap, x["tokens"] * x["z"] * e).otherwise(0.0)).alias("df")))

        def moved(s: Column) -> Column:
            gap = F.log(s["f"]) - F.log("target")
            lo, hi = F.when(gap < 0, acc["lam"]).otherwise(acc["lo"]), F.when(gap < 0, acc["hi"]).otherwise(acc["lam"])
            newton = F.when(s["df"] > 0, acc["lam"] - gap * s["f"] / s["df"])
            return _let(F.struct(gap.alias("gap"), lo.alias("lo"), hi.alias("hi"), newton.alias("newton")), chosen)

        def chosen(t: Column) -> Column:
            half = F.when(t["lo"].isNotNull() & t["hi"].isNotNull(), (t["lo"] + t["hi"]) / 2).when(t["lo"].isNotNull(), F.greatest(t["lo"] * 2, F.lit(1.0))).otherwise(F.least(t["hi"] * 2, F.lit(-1.0)))
            inside = (t["newton"] > F.coalesce(t["lo"], t["newton"] - 1)) & (t["newton"] < F.coalesce(t["hi"], t["newton"] + 1)) & (F.abs(t["newton"] - acc["lam"]) < 16 * (1 + F.abs(acc["lam"])))
            done = F.abs(t["gap"]) < tolerance
            return F.struct(F.when(done, acc["lam"]).when(inside, t["newton"]).otherwise(half).alias("lam"), t["lo"].alias("lo"), t["hi"].alias("hi"), done.alias("done"))

        return F.when(acc["done"], acc).otherwise(_let(F.aggregate("bins", F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("df")), sums), moved))

    start = F.struct(F.log(F.col("target") * max_copies / F.col("cap")).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))
    open_ones = targets.filter((F.col("target") > 0) & (F.col("target") < F.col("cap") * (1 - 1e-12))).select("rank", "target", "cap")
    bins = hist.groupBy("rank").agg(F.collect_list(F.struct("z", "tokens")).alias("bins"))
    return bins.join(open_ones, "rank").select("rank", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lam"].alias("lam"))


def planned_repairs(rounded: DataFrame, max_copies: int, repairs: int) -> DataFrame:
    """Copies to add or take (rid, change), so that each source's words come nearer to its target.

    Of each source one document of each size bin and number of copies stands for all of it; up to ``repairs`` times the one whose size is nearest to
    what is still off gives or takes a copy.
    """
    off = rounded.groupBy("rank").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("off"))
    one = rounded.filter("size > 0").groupBy("rank", "copies", size_bin(F.col("size"))).agg(F.min(F.struct("h", "rid", "size")).alias("d"))
    some = one.groupBy("rank").agg(F.collect_list(F.struct("d.rid", "d.size", "copies")).alias("some")).join(off, "rank")
    sign = lambda acc: F.signum(acc["off"]).cast("long")

    def step(acc: Column, _: Column) -> Column:
        can = F.filter("some", lambda d: F.when(acc["off"] > 0, d["copies"] < max_copies).otherwise(d["copies"] > 0) & ~F.exists(acc["plan"], lambda p: p["rid"] == d["rid"]))
        nearest = F.array_min(F.transform(can, lambda d: F.struct(F.abs(F.abs(acc["off"]) - d["size"]).alias("left"), d["rid"].alias("rid"), d["size"].alias("size"))))
        better = lambda b: F.when(b["left"] < F.abs(acc["off"]), F.struct((acc["off"] - sign(acc) * b["size"]).alias("off"), F.concat(acc["plan"], F.array(F.struct(b["rid"].alias("rid"), sign(acc).alias("change")))).alias("plan"))).otherwise(acc)
        return _let(nearest, better)

    none = F.array().cast("array<struct<rid:long,change:long>>")
    plan = F.aggregate(F.sequence(F.lit(1), F.lit(repairs)), F.struct(F.col("off").alias("off"), none.alias("plan")), step)["plan"]
    return some.select(F.explode(plan).alias("p")).select("p.rid", "p.change")


def entropy_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_copies: int = 3, rows_per_cell: int = 5000, repairs: int = 4, keep: list[str] | None = None) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, rate, copies, taken and the columns ``keep``.

    Among all rates from 0 to ``max_copies`` that meet the token target of each source, the rates are those nearest
    to 1 in relative entropy: min(max_copies, exp(multiplier * size / mean size)) (see solve_dual). Copies come from
    systematic rounding: within cells of about ``rows_per_cell`` documents of a source, ordered by size, copies follow the
    running sum of rates, so a cell is off by at most its longest document; a hot source has many cells. Then up to
    ``repairs`` documents of each source get or lose a copy (see planned_repairs).
    Everything hangs on hashes of doc_id and text, so reruns agree.

    Null text or one without words: size 0, taken 0. Null source: a source of its own, last. Null doc_ids and
    repeated rows: each row counts as a document. No rows or no words at all: targets of 0. Further columns are ignored, but for ``keep``.
    """
    kept = list(keep or [])
    since = len(made())
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("h"), *kept)
    sized = written(sized.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    counts = written(sized.groupBy("source", size_bin(F.col("size")).alias("bin")).agg(F.count("*").alias("n"), F.sum("size").alias("tokens")), "mix-counts")
    sums = counts.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.sum(F.when(F.col("tokens") > 0, F.col("n"))).alias("n_docs"), F.sum("n").alias("n_rows"))
    targets = written(source_targets(sums, weights, max_copies), "mix-targets")
    mean = F.col("n_docs") / F.col("source_size")
    hist = counts.filter("tokens > 0").join(targets, counts["source"].eqNullSafe(targets["source"])).select("rank", (F.col("tokens") / F.col("n") * mean).alias("z"), F.col("tokens").cast("double").alias("tokens"))
    plan = written(targets.join(solve_dual(hist, targets, max_copies), "rank", "left"), "mix-plan")

    z = F.col("size") * mean
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).when(F.col("lam").isNull(), float(max_copies)).otherwise(F.least(F.lit(float(max_copies)), F.exp(F.least(F.col("lam") * z, F.lit(700.0)))))
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    rated = join_by_key(sized.withColumn("s", named), plan.select(named.alias("s"), "n_rows", "rank", "source_size", "n_docs", "target", "lam"), "s", "n_rows", F.col("rid"), sized.count()).drop("s")
    cell = F.pmod("h", F.ceil(F.coalesce("n_docs", F.lit(1)) / rows_per_cell).cast("long"))
    rated = rated.withColumn("rate", rate).withColumn("cell", cell)
    in_cell = Window.partitionBy("rank", "cell").orderBy("size", "h", "rid").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("rate").over(in_cell) + F.pmod(F.xxhash64("rank", "cell"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.least(F.lit(max_copies).cast("long"), F.floor("run") - F.floor(F.col("run") - F.col("rate")))
    rounded = rated.withColumn("run", run).withColumn("copies", F.greatest(copies, F.lit(0).cast("long"))).drop("run", "cell", "n_docs", "lam")
    rounded = written(rounded, "mix-copies")
    dropped(docs.sparkSession, since, (made()[-1],))
    # At most ``repairs`` rows for each source, one for each rid.
    changes = written(planned_repairs(rounded, max_copies, repairs), "mix-repairs")
    out = rounded.join(changes, "rid", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"), *kept)
