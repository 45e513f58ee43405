"""Sharding over fixed virtual slots with a versioned slot-to-shard map. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, dropped, made, row_ids, written

SLOTS = 4096
#: What a record takes besides its text.
OVERHEAD = 8


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sized_records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, hash of the text, and the row's place in its files: all that sharding needs of a record."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return row_ids(docs).select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__h"), *ROW
    )


def slotted(records: DataFrame, shards: int, slots: int = SLOTS, part: float = 0.25) -> DataFrame:
    """Adds virtual_slot, from 0 to ``slots`` - 1: a hash of the text, so that equal texts share a slot.

    A text whose copies hold over ``part`` of a shard's share of all bytes (there are fewer than ``shards / part`` such texts, so they are
    broadcast) would make a slot that no map can place: its rows are dealt over all slots by their place in the files.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    hot = records.groupBy("__h").agg(F.sum("size").alias("__bytes")).filter(F.col("__bytes") * shards > total * part).select("__h", F.lit(True).alias("__hot"))
    out = records.join(F.broadcast(hot), "__h", "left")
    return out.withColumn("virtual_slot", F.pmod(F.when(F.col("__hot"), F.xxhash64("__h", *ROW)).otherwise(F.xxhash64("__h", F.lit(11))), F.lit(slots))).drop("__hot")


def slot_sizes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that holds any: at most as many rows as there are slots."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(sizes: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0 of the map: slots to shards in turn, whatever they hold. version, virtual_slot, shard."""
    return sizes.sparkSession.range(slots).select(F.lit(0).alias("version"), F.col("id").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def map_at(edits: DataFrame, version: int | None = None) -> DataFrame:
    """The map (virtual_slot, shard, since) as of ``version`` (None: the last): of each slot the edit with the greatest version up to it."""
    seen = edits if version is None else edits.filter(F.col("version") <= version)
    return seen.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"), F.max("version").alias("since"))


def rebalanced(edits: DataFrame, sizes: DataFrame, shards: int, slack: float = 0.03) -> DataFrame:
    """The edits of the next version (version, virtual_slot, shard), which make the bytes of ``shards`` shards near equal.

    Each shard keeps its slots, the largest first, as long as they stay within (1 - ``slack``) of an equal share; slots of shards that are no more
    are all let go. What is let go goes, the largest first, to the shard with the fewest bytes. So shards end apart by about their
    smallest slots, and only ``slack`` and what was out of balance moves. Everything here has at most one row per slot, and the fold
    over them takes slots times shards steps, whatever the number of records.
    """
    current = map_at(edits).join(F.broadcast(sizes), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    share = F.sum("bytes").over(Window.partitionBy(F.lit(1))) * ((1 - slack) / shards)
    in_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    current = current.withColumn("share", share).withColumn("stays", (F.sum("bytes").over(in_shard) <= F.col("share")) & (F.col("shard") < shards))
    let_go = F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "shard")
    each = current.groupBy("shard").agg(F.sum(F.when(F.col("stays"), F.col("bytes"))).alias("kept"), F.collect_list(F.when(~F.col("stays"), let_go)).alias("free"))
    whole = each.agg(F.map_from_entries(F.collect_list(F.struct("shard", F.coalesce("kept", F.lit(0).cast("long"))))).alias("kept"), F.array_sort(F.flatten(F.collect_list("free"))).alias("free"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.coalesce(F.try_element_at("kept", k), F.lit(0).cast("long")))

    def place(acc: Column, x: Column) -> Column:
        def at(k: Column) -> Column:
            loads = F.transform(acc["loads"], lambda b, i: F.when(i == k - 1, b - x["minus"]).otherwise(b))
            return F.struct(loads.alias("loads"), F.concat(acc["to"], F.array((k - 1).cast("int"))).alias("to"))

        return _let(F.array_position(acc["loads"], F.array_min(acc["loads"])), at)

    zero = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))
    moved = whole.select(F.explode(F.arrays_zip("free", F.aggregate("free", zero, place)["to"].alias("to"))).alias("m"))
    moved = moved.select(F.col("m.free.virtual_slot").alias("virtual_slot"), F.col("m.free.shard").alias("before"), F.col("m.to").alias("shard"))
    return moved.filter("shard <> before").select(F.lit(_next(edits)).alias("version"), "virtual_slot", "shard")


def _next(edits: DataFrame) -> int:
    return edits.agg(F.max("version")).first()[0] + 1


def grown(edits: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The edits of the next version with one shard more: number ``shards`` takes slots until it has an equal share, no other shard takes any.

    Each shard gives its smallest slots as long as these stay within its part of the new shard's share.
    """
    current = map_at(edits).join(F.broadcast(sizes), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    in_shard = Window.partitionBy("shard").orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    gives = F.sum("bytes").over(in_shard) * (shards + 1) <= F.sum("bytes").over(Window.partitionBy("shard"))
    return current.withColumn("gives", gives).filter("gives").select(F.lit(_next(edits)).alias("version"), "virtual_slot", F.lit(shards).alias("shard"))


def placed(records: DataFrame, shard_map: DataFrame, sizes: DataFrame, rows_per_cell: int = 5000) -> DataFrame:
    """Adds shard and slot, the record's place in its shard, gapless from 0.

    Places run on over cells: each virtual slot has one for about every ``rows_per_cell`` of its rows, dealt by their place in the files, so a cell is
    never large. The map and the number of cells per slot are at most one row per virtual slot and are broadcast.
    """
    plan = shard_map.join(F.broadcast(sizes), "virtual_slot").select("virtual_slot", "shard", F.ceil(F.col("n") / rows_per_cell).cast("long").alias("__cells"))
    dealt = records.join(F.broadcast(plan), "virtual_slot").withColumn("__cell", F.pmod(F.xxhash64(*ROW, F.lit(12)), F.col("__cells")))
    key = ["shard", "virtual_slot", "__cell"]
    counts = dealt.groupBy(*key).agg(F.count("*").alias("__n"))
    # Two steps, so that no window goes over all cells of a shard: slots within shards, cells within slots.
    by_slot = counts.groupBy("shard", "virtual_slot").agg(F.sum("__n").alias("__n"))
    by_slot = by_slot.select("virtual_slot", (F.sum("__n").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("__n")).alias("__base"))
    within = F.sum("__n").over(Window.partitionBy("shard", "virtual_slot").orderBy("__cell")) - F.col("__n")
    first = counts.withColumn("__within", within).join(F.broadcast(by_slot), "virtual_slot").select(*key, (F.col("__base") + F.col("__within")).alias("__first"))
    at = F.row_number().over(Window.partitionBy(*key).orderBy("__h", "doc_id", *ROW)) - 1
    return dealt.withColumn("__at", at).join(first, key).withColumn("slot", F.col("__first") + F.col("__at")).drop("__cells", "__cell", "__at", "__first")


def sharded(docs: DataFrame, shards: int = 24, slots: int = SLOTS, edits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every document's shard, by bytes, and the map it hangs on: (rows, edits).

    ``edits`` is the versioned map so far (None: begins with ``first_map``, slots to shards in turn); one more version, which makes the shards' bytes near
    equal, is edited in and the whole returned, so that the caller can keep it as a table and pass it again when documents were added.
    Rows: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law (`bytes`), shard, slot (place in the shard, gapless from 0),
    grown_shard (null: under this law a further shard is a matter of the next edit, see ``grown``), virtual_slot.

    Equal texts share a slot and so a shard, but for texts whose copies hold over a quarter of a shard's bytes, which are spread row by row.
    Null and empty texts: size 8, crc 0, equal to each other. Null and repeated doc_ids and repeated rows: each row is a record. An empty table gives
    no rows and a map as it was. A text larger than a shard's share makes its shard larger than the others, as texts aren't cut. Further columns are
    ignored, whatever their names.
    """
    spark, since = docs.sparkSession, len(made())
    records = written(sized_records(docs), "shard-records")
    in_slots = slotted(records, shards, slots)
    sizes = written(slot_sizes(in_slots), "shard-slots")
    known = first_map(sizes, shards, slots) if edits is None else edits
    edits = written(known.unionByName(rebalanced(known, sizes, shards)).coalesce(1), "shard-map")
    out = placed(in_slots, map_at(edits).select("virtual_slot", "shard"), sizes)
    out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), F.col("virtual_slot").cast("int"))
    out = written(out, "shard-rows")
    dropped(spark, since, (made()[-1], made()[-2]))
    return out, edits
