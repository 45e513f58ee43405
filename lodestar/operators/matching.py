"""Entity matching: cascades guarded by cardinality, fallbacks inside a box, verification by votes, set comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.columns import in_margin


def unique_by(df: DataFrame, keys: Sequence[str], row: Column) -> DataFrame:
    """Keys that exactly one row has, with that row: two hits are no hit."""
    return df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(row).alias("__row")).filter("__n = 1").drop("__n")


def cascade(left: DataFrame, right: DataFrame, key: str, code: str, area: str, name: str, payload: Sequence[str]) -> DataFrame:
    """Staged match; left rows keep, in this order: unique same code, area and name; unique same code and area; unique same area and name.

    A code's candidates in the area that are several can still be told apart by the name, but only if exactly one has
    it. Each stage is an aggregation of ``right`` to unique keys and a left join, so no stage multiplies rows. Adds ``method`` and the payload columns
    (null where there is no match).
    """
    row = F.struct(*payload)
    out = left
    for stage, keys in (("code_name_area", [code, area, name]), ("code_area", [code, area]), ("name_area", [area, name])):
        found = unique_by(right, keys, row).withColumnRenamed("__row", f"__{stage}")
        out = out.join(found, list(keys), "left")
    stages = ["code_name_area", "code_area", "name_area"]
    method = F.coalesce(*[F.when(F.col(f"__{s}").isNotNull(), s) for s in stages])
    best = F.coalesce(*[F.col(f"__{s}") for s in stages])
    out = out.withColumn("method", method).select(*left.columns, "method", *[best[p].alias(p) for p in payload])
    return out


def bounding_boxes(points: DataFrame, area: str, lat: str, lon: str) -> DataFrame:
    return points.groupBy(area).agg(F.min(lat).alias("lat0"), F.max(lat).alias("lat1"), F.min(lon).alias("lon0"), F.max(lon).alias("lon1"))


def vertex_means(lines: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, mean of all vertices over all its lines (not a centroid of area)."""
    return lines.groupBy(key).agg(F.avg(x).alias("lon"), F.avg(y).alias("lat"))


def fallback(matched: DataFrame, centroids: DataFrame, key: str, area: str, margin: float) -> DataFrame:
    """Rows without coordinates take their key's centroid if it lies in the area's box of rows matched before, plus a margin.

    Boxes come from the first pass alone, so fallback points never widen them. ``rejected`` tells of a centroid outside.
    """
    boxes = bounding_boxes(matched.filter(F.col("lat").isNotNull()), area, "lat", "lon")
    both = matched.join(centroids.select(F.col(key), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")), key, "left").join(boxes, area, "left")
    ok = in_margin(F.col("c_lat"), F.col("c_lon"), F.col("lat0"), F.col("lat1"), F.col("lon0"), F.col("lon1"), margin)
    take = F.col("lat").isNull() & ok
    return both.select(
        *[c for c in matched.columns if c not in ("lat", "lon", "method")],
        F.when(take, F.col("c_lat")).otherwise(F.col("lat")).alias("lat"), F.when(take, F.col("c_lon")).otherwise(F.col("lon")).alias("lon"),
        F.when(take, F.lit("centroid")).otherwise(F.col("method")).alias("method"), (F.col("lat").isNull() & F.col("c_lat").isNotNull() & ~ok).alias("rejected"),
    )


def majority(votes: DataFrame, key: str, value: str) -> DataFrame:
    """key, the value with most votes (ties to the least), its votes and all votes."""
    n = votes.groupBy(key, value).agg(F.count("*").alias("votes"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("m"), F.col(value).alias("v"))).alias("b"), F.sum("votes").alias("total"))
    return best.select(key, F.col("b.v").alias(value), (-F.col("b.m")).alias("votes"), "total")


def differences(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("missing", "unexpected")) -> DataFrame:
    """Both set differences: rows of a that b lacks, rows of b that a lacks, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit(names[0])).unionByName(b.exceptAll(a).withColumn("side", F.lit(names[1])))


def without_voided(log: DataFrame, file: str, line: str, supersedes: str, is_correction: Column) -> DataFrame:
    """Rows of a log that no valid correction voids, without the corrections.

    A correction names an earlier line of its file that is no correction; the first one for a line counts.
    """
    fix = log.filter(is_correction & F.col(supersedes).isNotNull()).select(F.col(file).alias("__f"), F.col(supersedes).alias("__t"), F.col(line).alias("__l"))
    targets = log.filter(~is_correction).select(F.col(file).alias("__f"), F.col(line).alias("__t"))
    valid = fix.filter("__t < __l").join(targets, ["__f", "__t"], "left_semi").dropDuplicates(["__f", "__t"])
    return log.filter(~is_correction).join(valid, (F.col(file) == F.col("__f")) & (F.col(line) == F.col("__t")), "left_anti")


def place_tokens(endings: Sequence[str], separators: str = "[・、]", least: int = 2) -> Callable[[Column], Column]:
    """Column function: parts of a text, each without the endings that it has, as far as they come off in rounds over all of them; parts of fewer than ``least`` characters go.

    A part that is nothing but endings goes too. A null text has no parts.
    """
    known = F.array(*[F.lit(e) for e in endings])

    def shorter(t: Column) -> Column:
        return F.aggregate(known, t, lambda x, e: F.when(F.endswith(x, e), F.left(x, F.length(x) - F.length(e))).otherwise(x))

    def bare(part: Column) -> Column:
        # A round that changes a part takes a character at least, so there are no more rounds than characters; the flag ends them early.
        start = F.struct(part.alias("t"), F.lit(True).alias("more"))
        step = lambda acc, _: F.when(acc["more"], F.transform(F.array(shorter(acc["t"])), lambda t: F.struct(t.alias("t"), (t != acc["t"]).alias("more")))[0]).otherwise(acc)
        return F.aggregate(F.sequence(F.lit(0), F.length(part)), start, step)["t"]

    return lambda text: F.filter(F.transform(F.coalesce(F.split(text, separators), F.array().cast("array<string>")), lambda p: F.trim(bare(p))), lambda t: F.length(t) >= least)


def containing(texts: DataFrame, text: str, tokens: DataFrame, token: str, most: int = 100_000) -> DataFrame:
    """Distinct (text, token) where the text holds the token: each text of a column, each token of another.

    Up to ``most`` tokens (counted first) make one Aho-Corasick automaton per worker, which reads each distinct text once. More of them meet the texts by equality of
    what they begin with: every stretch of a text that is as long as the shortest token is a key, and what meets is then compared. Null and empty texts and tokens
    hold nothing.
    """
    left = texts.select(F.col(text).alias("text")).filter("text <> ''").distinct()
    right = tokens.select(F.col(token).alias("token")).filter("token <> ''").distinct()
    some = right.limit(most + 1).collect()
    if len(some) > most:
        least = right.agg(F.min(F.length("token"))).first()[0]
        keyed = left.withColumn("key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (least - 1), F.lit(1))), lambda i: F.substring("text", i, F.lit(least))))))
        met = keyed.join(right.withColumn("key", F.left("token", F.lit(least))), "key")
        return met.filter(F.contains("text", "token")).select("text", "token").distinct()
    words = texts.sparkSession.sparkContext.broadcast(tuple(r.token for r in some))

    def read(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for p in pdfs:
            hits = [(t, w) for t in p["text"] for w in ({w for _, w in automaton.iter(t)} if words.value else ())]
            yield pd.DataFrame(hits, columns=["text", "token"])

    return left.mapInPandas(read, "text string, token string")


def named_areas(places: DataFrame, key: str, fine: str, coarse: str, areas: DataFrame, area: str, name: str, tokens: str) -> DataFrame:
    """Which area a place belongs to by names: key, area, method, n (areas that were candidates).

    Areas with a token that the place's ``fine`` text holds come first; without any, those whose name holds its ``coarse`` stem. One candidate assigns the area; several
    leave it null as "ambiguous_...", none as "none". Places repeat as they are given; null texts name nothing.
    """
    def one(hits: DataFrame, key: str, prefix: str) -> DataFrame:
        return hits.distinct().groupBy(key).agg(F.count("*").alias(f"{prefix}_n"), F.min(area).alias(f"{prefix}_area"))

    each = areas.select(area, name, F.explode_outer(tokens).alias("token"))
    by_fine = one(containing(places, fine, each, "token").join(each.select("token", area), "token").select(F.col("text").alias(fine), area), fine, "fine")
    by_coarse = one(containing(areas, name, places, coarse).join(areas.select(F.col(name).alias("text"), area), "text").select(F.col("token").alias(coarse), area), coarse, "coarse")
    out = places.join(by_fine, fine, "left").join(by_coarse, coarse, "left")
    took_fine, n = F.coalesce("fine_n", F.lit(0)) > 0, F.coalesce("fine_n", "coarse_n", F.lit(0)).cast("long")
    named = F.when(took_fine, "municipality_named").otherwise("prefecture_named")
    method = F.when(n == 0, "none").when(n == 1, named).otherwise(F.concat(F.lit("ambiguous_"), named))
    return out.select(key, F.when(n == 1, F.coalesce("fine_area", "coarse_area")).alias(area), method.alias("method"), n.alias("n"))


def single_candidate(left: DataFrame, right: DataFrame, key: str, text: str, token: str, value: str) -> DataFrame:
    """key and value where exactly one value has a token that the text contains (see ``containing``)."""
    hits = containing(left, text, right, token).join(right.select(F.col(token).alias("token"), value), "token").select(F.col("text").alias("__text"), value).distinct()
    found = left.join(hits, F.col(text) == F.col("__text")).select(key, value).distinct()
    return found.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias(value)).filter("n = 1").drop("n")
