"""Exact order statistics per key with bounded state, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import kept

BUCKETS = 1024


def selected(df: DataFrame, keys: list[str], value: str, ranks: DataFrame, few: int = 1000) -> DataFrame:
    """keys, rank, value: the value at each rank (0 the least) of ``ranks`` (keys, rank), by rounds of histograms.

    A round splits the span in which a rank's value lies into 1024 buckets, counts them for all keys and ranks side by side and goes on with the bucket that holds the
    rank, as narrow as the values in it. Counts are added up where the rows are, so a hot key is shared among all tasks, and what is held per key and rank is its
    buckets. Spans of up to ``few`` values or of one value end the rounds. Nulls and NaNs don't count; ranks beyond a key's values have no row.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    span = rows.groupBy(*keys).agg(F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.count("*").alias("n"))
    open_ones = kept(ranks.join(span, keys).filter(F.col("rank") < F.col("n")).select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), "n"))
    done = None
    while True:
        over = (F.col("n") <= few) | (F.col("lo") == F.col("hi"))
        done = open_ones.filter(over) if done is None else done.unionByName(open_ones.filter(over))
        open_ones = open_ones.filter(~over)
        if open_ones.isEmpty():
            break
        at = rows.join(open_ones, keys).filter(F.col("__x").between(F.col("lo"), F.col("hi")))
        # Halves first, so that a span from one end of the doubles to the other doesn't overflow.
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("__x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS))
        counts = at.groupBy(*keys, "rank", "below", bucket.alias("b")).agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
        before = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("b")) - F.col("n")
        hit = counts.withColumn("below", F.col("below") + before).filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        open_ones = kept(hit.select(*keys, "rank", "lo", "hi", "below", "n"))
    one = done.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
    some = rows.join(done.filter("lo < hi"), keys).filter(F.col("__x").between(F.col("lo"), F.col("hi")))
    listed = some.groupBy(*keys, "rank", "below").agg(F.array_sort(F.collect_list("__x")).alias("xs"))
    return one.unionByName(listed.select(*keys, "rank", F.element_at("xs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value")))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], most: int = 100_000) -> DataFrame:
    """keys and q0, q1, ...: exact quantiles, interpolated between neighbours as ``percentile`` does.

    Keys of up to ``most`` values go through ``percentile``, which holds a key's distinct values; larger ones through ``selected``. Both give the same.
    """
    names = [f"q{i}" for i in range(len(shares))]
    counted = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    large = kept(counted.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most))
    plain = lambda d: d.groupBy(*keys).agg(*[F.percentile(value, F.lit(q)).alias(n) for q, n in zip(shares, names, strict=True)])
    if large.isEmpty():
        return plain(counted)
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * q).alias("p")) for i, q in enumerate(shares)]))
    places = large.select(*keys, at.alias("a")).select(*keys, "a.i", "a.p", F.floor("a.p").alias("low"), F.ceil("a.p").alias("high"))
    ranks = places.select(*keys, F.col("low").alias("rank")).unionByName(places.select(*keys, F.col("high").alias("rank"))).distinct()
    hot = counted.join(large.select(*keys), keys, "left_semi")
    found = kept(selected(hot, keys, value, ranks))
    both = places.join(found.withColumnsRenamed({"rank": "low", "value": "x"}), [*keys, "low"]).join(found.withColumnsRenamed({"rank": "high", "value": "y"}), [*keys, "high"])
    q = F.when(F.col("low") == F.col("high"), F.col("x")).otherwise((F.col("high") - F.col("p")) * F.col("x") + (F.col("p") - F.col("low")) * F.col("y"))
    wide = both.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, q)).alias(n) for i, n in enumerate(names)])
    return plain(counted.join(large.select(*keys), keys, "left_anti")).unionByName(wide)
