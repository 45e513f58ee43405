"""Repair of conversation structure: cheapest edits from an acyclic graph of tight arcs, found from both ends.

A state of the graph says which roles came so far: 0 none, 1 the system's, 2 a user's, 3 an assistant's after a user's. Layers are rows; an
arc keeps, reroles or deletes a row, or inserts one within a layer. Forward and backward least costs tell which arcs lie on a cheapest path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, dropped, grouped, join_by_key, made, row_ids, tidied, written

#: A character that isn't ASCII white space.
_INK = r"[^\x20\x09-\x0D]"

# What edits cost.
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
STATES = 4
#: The state after a role's initial in each state; whatever is missing isn't allowed.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that an insertion or a new role gives in each state: the only one that may follow (a system's turn is never made up).
GIVES = {0: "u", 1: "u", 2: "a", 3: "u"}
NAMES = {"u": "user", "a": "assistant"}
ENDS = (0, 3)
FAR = 1 << 60
END_COSTS = [0, FAR, FAR, 0]


def row_arcs(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row in a state, in order of letters."""
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = UNFINISHED if fault == TRUNCATED else 0
        if (state, initial) in NEXT:
            out.append(("K", more, NEXT[state, initial]))
        out.append(("R", REROLE + more, NEXT[state, GIVES[state]]))
    return out


_ARCS: dict[tuple[str, int], list[list[tuple[str, int, int]]]] = {}


def arcs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """``row_arcs`` of all states; there are few kinds of rows."""
    initial = initial if initial in ("s", "u", "a") else "?"
    if (initial, fault) not in _ARCS:
        _ARCS[initial, fault] = [row_arcs(initial, fault, s) for s in range(STATES)]
    return _ARCS[initial, fault]


def with_insertions(cost: list[int], forward: bool) -> list[int]:
    """Least costs of a layer's states when rows may be inserted too. Two insertions lead from any state to any that insertions reach."""
    out = list(cost)
    for _ in range(2):
        for s in range(STATES):
            t = NEXT[s, GIVES[s]]
            if forward:
                out[t] = min(out[t], out[s] + INSERT)
            else:
                out[s] = min(out[s], out[t] + INSERT)
    return out


def forward_costs(rows: list[tuple[str, int]], start: list[int]) -> list[list[int]]:
    """For each layer the least cost of reaching each state, from the first layer's costs."""
    layers = [with_insertions(start, True)]
    for initial, fault in rows:
        now, out = layers[-1], [FAR] * STATES
        for s, choices in enumerate(arcs(initial, fault)):
            for _, cost, t in choices:
                out[t] = min(out[t], now[s] + cost)
        layers.append(with_insertions(out, True))
    return layers


def backward_costs(rows: list[tuple[str, int]], end: list[int]) -> list[list[int]]:
    """For each layer the least cost from each state to the end, from the last layer's costs."""
    layers = [with_insertions(end, False)]
    for initial, fault in reversed(rows):
        after = layers[-1]
        layers.append(with_insertions([min(cost + after[t] for _, cost, t in choices) for choices in arcs(initial, fault)], False))
    return layers[::-1]


def least_edits(rows: list[tuple[str, int]], ahead: list[list[int]], behind: list[list[int]], begin: list[int], last: bool) -> tuple[str, list[int]]:
    """The least string of letters over all paths of tight arcs from the states ``begin`` of layer 0, and the frontier where it ends.

    An arc from u to v is tight if ahead[u] + cost + behind[v] is the least cost of all. The frontier holds all nodes (layer, state) that the letters
    so far lead to; each step takes the least letter that any of its tight arcs has. Unless ``last``, the walk stops in the last layer, whose insertions belong to the
    rows that follow.
    """
    n = len(rows)
    best = min(ahead[0][s] + behind[0][s] for s in begin)
    frontier = {(0, s) for s in begin if ahead[0][s] + behind[0][s] == best}
    letters = []
    while True:
        if all(i == n for i, _ in frontier) and (not last or any(s in ENDS and behind[n][s] == 0 for _, s in frontier)):
            return "".join(letters), sorted(s for _, s in frontier)
        steps: dict[str, set[tuple[int, int]]] = {}
        for i, s in frontier:
            t = NEXT[s, GIVES[s]]
            if (i < n or last) and ahead[i][s] + INSERT + behind[i][t] == best:
                steps.setdefault("I", set()).add((i, t))
            if i < n:
                for letter, cost, t in arcs(*rows[i])[s]:
                    if ahead[i][s] + cost + behind[i + 1][t] == best:
                        steps.setdefault(letter, set()).add((i + 1, t))
        letter = min(steps)
        letters.append(letter)
        frontier = steps[letter]


def repaired_rows(letters: str, state: int, rows: list[tuple[str, str]]) -> Iterator[str]:
    """The lines `role:text` that the edits leave of (role, text) rows, from the state before them."""
    left = iter(rows)
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter != "K":
            role = NAMES[GIVES[state]]
        state = NEXT[state, role[:1]]
        yield f"{role}:{text}"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with the faults that crc32(`conv_id:turn`) % 20 names (nulls: one space): 0 drops a row, 1 empties its text, 2 takes
    full stops, exclamation and question marks out of it, 3 repeats it, 4 makes its role user. Null roles and texts become one space. __copy tells repeats apart
    (0 and 1); a dropped row stays, without its text, as -1, so that no conversation is lost."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), blank), F.coalesce(F.col("text").cast("string"), blank)
    out = rows.withColumn("__kind", kind).withColumn("role", F.when(F.col("__kind") == 4, F.lit("user")).otherwise(role))
    out = out.withColumn("text", F.when(F.col("__kind") == 0, F.lit(None)).when(F.col("__kind") == 1, F.lit("")).when(F.col("__kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
    copies = F.when(F.col("__kind") == 0, F.array(F.lit(-1))).when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("__copy", F.explode(copies)).drop("__kind")


def _fault(text: Column) -> Column:
    """BLANK, TRUNCATED or 0, from the text alone."""
    last = F.regexp_extract(text, rf"({_INK})[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)


#: Rows of a conversation in order: by turn, nulls first, then as they stand in their files.
ORDER = ["__c", "turn", *ROW, "__copy"]
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def gaps(turns: Iterable[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def repair(turns: list[int | None], roles: list[str], texts: list[str], faults: list[int]) -> tuple:
    """One conversation's counts, cost, audit and digest, from its rows in order; ``faults`` are BLANK, TRUNCATED or 0, duplicates are found here."""
    seen: set[tuple[str, str]] = set()
    found = []
    for role, text, fault in zip(roles, texts, faults, strict=True):
        found.append(DUPLICATE if fault != BLANK and (role, text) in seen else fault)
        seen.add((role, text))
    rows = [(r[:1], f) for r, f in zip(roles, found, strict=True)]
    ahead, behind = forward_costs(rows, [0] + [FAR] * 3), backward_costs(rows, END_COSTS)
    audit, _ = least_edits(rows, ahead, behind, [0], True)
    digest = hashlib.sha256("\n".join(repaired_rows(audit, 0, list(zip(roles, texts, strict=True)))).encode())
    return gaps(turns), found.count(BLANK), found.count(DUPLICATE), found.count(TRUNCATED), illegal_pairs([i for i, _ in rows]), behind[0][0], audit, digest.hexdigest()


def _whole(rows: DataFrame) -> DataFrame:
    """Repairs conversations that fit a task: rows are dealt by conversation and stream through in order, one conversation at a time."""
    names = "conv_id long, " + COUNTS + ", audit string, repaired_sha256 string"
    schema = pa.schema([(n.split()[0], pa.string() if n.endswith("string") else pa.int64()) for n in names.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in grouped(batches, ["__c"]):
            ids, turns, roles, texts, faults, copies = (g[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "__copy"))
            here = [k for k, c in enumerate(copies) if c >= 0]
            out.append((ids[0], *repair(*([x[k] for k in here] for x in (turns, roles, texts, faults)))))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.select("conv_id", *ORDER, "role", "text", "fault").repartition("__c").sortWithinPartitions(*ORDER).mapInArrow(tidied(run), names)


def _segments(rows: DataFrame) -> DataFrame:
    """Per segment of a long conversation: least costs from each state to each state, and what its counts need from its ends."""
    schema = "__c string, seg long, costs array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, turn_a long, turn_b long, turns long"
    kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}.get(k, pa.list_(pa.int64()))) for n, k in (c.split() for c in schema.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["__c", "seg"]):
            initials, faults, turns = (g[c].to_pylist() for c in ("initial", "fault", "turn"))
            rows = list(zip(initials, faults, strict=True))
            costs = [forward_costs(rows, [0 if t == s else FAR for t in range(STATES)])[-1] for s in range(STATES)]
            known = [t for t in turns if t is not None]
            row = (
                g["__c"][0].as_py(), g["seg"][0].as_py(), [min(c, FAR) for m in costs for c in m], faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal_pairs(initials),
                initials[0], initials[-1], known[0] if known else None, known[-1] if known else None, len(set(known)),
            )
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(tidied(run), schema)


def _joined(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts and cost of each long conversation, least costs from each state behind each segment to the end): a fold over segments, of which a conversation of n rows has
    about n / 2048."""

    def fold(key: tuple, g: pd.DataFrame) -> pd.DataFrame:

        g = g.sort_values("seg")
        behind, after = with_insertions(END_COSTS, False), []
        for costs in reversed(list(g["costs"])):
            after.append(list(behind))
            behind = [min(int(costs[s * STATES + t]) + behind[t] for t in range(STATES)) for s in range(STATES)]
        spans = [(int(a), int(b), int(n)) for a, b, n in zip(g["turn_a"], g["turn_b"], g["turns"], strict=True) if pd.notna(a)]
        distinct = sum(n for _, _, n in spans) - sum(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        seams = sum(a + b not in ("su", "ua", "au") for a, b in zip(g["last"], list(g["first"])[1:], strict=False))
        counts = [spans[-1][1] - spans[0][0] + 1 - distinct if spans else 0, g["blank"].sum(), g["duplicate"].sum(), g["truncated"].sum(), g["illegal"].sum() + seams, behind[0]]
        return pd.DataFrame({"__c": key[0], "seg": g["seg"].to_numpy(), "behind": after[::-1], "counts": [[int(c) for c in counts]] * len(g)})

    folded = written(segments.groupBy("__c").applyInPandas(fold, "__c string, seg long, behind array<long>, counts array<long>"), "repair-ends")
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return folded.groupBy("__c").agg(F.first("counts").alias("c")).select("__c", *[F.col("c")[k].alias(n) for k, n in enumerate(names)]), folded.select("__c", "seg", "behind")


def _letters(rows: DataFrame) -> DataFrame:
    """Per row of a long conversation and per state at its segment's start: the letters up to and with the row's own, the lines put before it (with the
    role it is given, null for its own), the lines put after it; and the state at the segment's end."""
    part = "array<struct<letters:string,lines:string,role:string,tail:string,exit:int>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["__c", "seg"]):
            rows = list(zip(g["initial"].to_pylist(), g["fault"].to_pylist(), strict=True))
            end, last = g["behind"][0].as_py(), g["is_last"][0].as_py()
            behind = backward_costs(rows, END_COSTS if last else end)
            found: list[list[dict | None]] = []
            for s in range(STATES):
                if behind[0][s] >= FAR:
                    found.append([None] * len(rows))
                    continue
                letters, ends = least_edits(rows, forward_costs(rows, [0 if t == s else FAR for t in range(STATES)]), behind, [s], last)
                found.append(_by_row(letters, s, rows, ends[0]))
            edits = pa.array([list(e) for e in zip(*found, strict=True)], pa.list_(pa.struct([("letters", pa.string()), ("lines", pa.string()), ("role", pa.string()), ("tail", pa.string()), ("exit", pa.int32())])))
            t = g.select(["__c", "seg", "i", *ROW, "__copy"]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*t.columns, edits], [*t.schema.names, "edits"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["__c", "seg", "i", *ROW, "__copy"])
    return rows.mapInArrow(tidied(run), f"{schema}, edits {part}")


def _by_row(letters: str, state: int, rows: list[tuple[str, int]], end: int) -> list[dict | None]:
    """The letters of a path dealt to the rows; insertions go before the row that follows, those after the last one are its tail."""
    out: list[dict] = []
    own, lines = "", []
    for letter in letters:
        own += letter
        if letter == "I":
            role = NAMES[GIVES[state]]
            lines.append(f"{role}:")
            state = NEXT[state, role[0]]
            continue
        role = None
        if letter == "R":
            role = NAMES[GIVES[state]]
        if letter != "D":
            state = NEXT[state, rows[len(out)][0] if role is None else role[0]]
        out.append({"letters": own, "lines": "\n".join(lines) if lines else None, "role": role, "tail": None, "exit": end})
        own, lines = "", []
    if own:
        out[-1]["letters"] += own
        out[-1]["tail"] = "\n".join(lines)
    return out


def _long(rows: DataFrame, segment: int, chunk: int = 1 << 20) -> DataFrame:
    """Repairs long conversations in segments of at most ``segment`` rows.

    Rows are numbered over all of them by ranges, so a segment is a stretch of numbers. Costs between states add up over segments as shortest paths do:
    a fold from the end gives each segment the costs behind it, then each segment finds its letters for each state it may begin in, and a fold
    from the start tells which. Only narrow rows take part; texts join at the end, in chunks of lines that stream through the digest.
    """
    ranged = rows.select("conv_id", *ORDER, F.substring("role", 1, 1).alias("initial"), "fault", F.sha2(F.concat_ws("\0", "__c", F.length("role").cast("string"), "role", "text"), 256).alias("__d"))
    ranged = written(ranged.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("__at", F.monotonically_increasing_id()), "repair-ranges")
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    first = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))
    at = ranged.withColumn("__p", part).join(F.broadcast(first), "__p").withColumn("i", F.col("__b") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__b", "__at")
    again = at.filter("__copy >= 0").groupBy("__d").agg(F.min("i").alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    at = join_by_key(at, again, "__d", "__n", F.col("i"), ranged.count())
    dup = (F.col("fault") != BLANK) & (F.col("__first") < F.col("i"))
    at = written(at.withColumn("fault", F.when(dup, DUPLICATE).otherwise(F.col("fault"))).withColumn("seg", F.floor(F.col("i") / segment)).drop("__d", "__first"), "repair-rows")
    alive = at.filter("__copy >= 0")
    dealt = alive.repartition("__c", "seg").sortWithinPartitions("__c", "seg", "i")
    counts, ends = _joined(_segments(dealt))
    last = ends.groupBy("__c").agg(F.max("seg").alias("__last"))
    told = alive.join(ends, ["__c", "seg"]).join(last, "__c").withColumn("is_last", F.col("seg") == F.col("__last"))
    edits = written(_letters(told.repartition("__c", "seg").sortWithinPartitions("__c", "seg", "i")), "repair-edits")

    def entries(key: tuple, g: pd.DataFrame) -> pd.DataFrame:

        g, state, begins = g.sort_values("seg"), 0, []
        for exits in g["exits"]:
            begins.append(state)
            state = exits[state]
        return pd.DataFrame({"__c": key[0], "seg": g["seg"].to_numpy(), "begin": begins})

    exits = edits.groupBy("__c", "seg").agg(F.first(F.transform("edits", lambda e: F.coalesce(e["exit"], F.lit(-1)))).alias("exits"))
    begins = exits.groupBy("__c").applyInPandas(entries, "__c string, seg long, begin int")
    chosen = edits.join(begins, ["__c", "seg"]).select("__c", "seg", "i", *ROW, "__copy", F.col("edits")[F.col("begin")].alias("e"))
    text = rows.filter("__copy >= 0").select(*ROW, "__copy", "role", "text")
    line = F.when(F.col("e.letters").rlike("DI*$"), F.lit(None)).otherwise(F.concat(F.coalesce("e.role", "role"), F.lit(":"), "text"))
    lines = F.when(F.coalesce("e.lines", line, F.col("e.tail")).isNotNull(), F.concat_ws("\n", "e.lines", line, "e.tail"))
    said = chosen.join(text, [*ROW, "__copy"]).select("__c", "seg", "i", F.col("e.letters").alias("letters"), lines.alias("lines"))
    in_seg = Window.partitionBy("__c", "seg").orderBy("i")
    said = said.withColumn("chunk", F.floor(F.coalesce(F.sum(F.octet_length("lines")).over(in_seg), F.lit(0)) / chunk))
    items = F.array_sort(F.collect_list(F.struct("i", "letters", "lines")))
    chunks = said.groupBy("__c", "seg", "chunk").agg(items.alias("x"))
    kept = F.filter(F.col("x")["lines"], lambda x: x.isNotNull())
    chunks = chunks.select("__c", "seg", "chunk", F.concat_ws("", F.col("x")["letters"]).alias("letters"), F.when(F.size(kept) > 0, F.concat_ws("\n", kept)).alias("lines"))
    names = "__c string, audit string, repaired_sha256 string"

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sha, audit, begun = None, hashlib.sha256(), [], False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"__c": here, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}])

        for b in batches:
            for c, letters, text in zip(*(b.column(n).to_pylist() for n in ("__c", "letters", "lines")), strict=True):
                if c != here:
                    if here is not None:
                        yield out()
                    here, sha, audit, begun = c, hashlib.sha256(), [], False
                audit.append(letters)
                if text is not None:
                    sha.update((("\n" if begun else "") + text).encode())
                    begun = True
        if here is not None:
            yield out()

    streamed = chunks.repartition("__c").sortWithinPartitions("__c", "seg", "chunk").mapInArrow(tidied(digest), names)
    ids = at.groupBy("__c").agg(F.first("conv_id").alias("conv_id"))
    out = ids.join(counts, "__c", "left").join(streamed, "__c", "left")
    zeros = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in (c.split()[0] for c in COUNTS.split(", "))]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repaired(conversations: DataFrame, max_rows: int = 2048, max_bytes: int = 4 << 20, segment: int = 2048) -> DataFrame:
    """Damages conversations (see ``damaged``) and repairs their structure with the cheapest edits: one row per conv_id.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit (the edits' letters D, I, K, R in order, of all cheapest ones the least string),
    repaired_sha256 (of the repaired `role:text`, newline-joined). Roles must come out as nothing, or as pairs of user and assistant
    with a system turn before them at most.

    Conversations of up to ``max_rows`` rows and ``max_bytes`` of text are dealt whole, with one shuffle of the texts; longer ones are cut into segments
    of ``segment`` rows (see ``_long``), so that one conversation may hold any share of all rows. Its audit is one value of one byte per edit, and its digest reads its
    text in order, as chunks. Both ways give the same rows.

    Null conv_ids are one conversation, null turns come first and don't count as turns; null roles and texts are one space. Equal turns stay in the order of their files.
    Repeated rows are duplicates. A conversation all of whose rows were dropped has zeros, an empty audit and the empty text's digest. An empty table gives no
    rows. Roles without a known initial can only be changed or deleted. Further columns are ignored, whatever their names.
    """
    spark, since = conversations.sparkSession, len(made())
    rows = row_ids(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    rows = damaged(rows).withColumn("__c", F.coalesce(F.concat(F.lit("c"), "conv_id"), F.lit(""))).withColumn("fault", _fault(F.col("text")))
    size = rows.groupBy("__c").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    # As a written table its size is known, so it is broadcast only if it is small.
    long = written(size.filter((F.col("n") > max_rows) | (F.col("b") > max_bytes)).select("__c"), "repair-long")
    out = _whole(rows.join(long, "__c", "left_anti"))
    if not long.isEmpty():
        out = out.unionByName(_long(rows.join(long, "__c"), segment))
    out = written(out, "repair-out")
    dropped(spark, since, (made()[-1],))
    return out
