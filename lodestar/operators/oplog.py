"""Append-only logs: validation, corrections, facts per loop, strikes, diff totals, run evidence."""

from __future__ import annotations

from collections.abc import Collection, Iterator, MutableMapping
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.sources.text import numbered_lines

FIX = "correction"
RECORD = "v string, ts string, project string, loop_id string, event string, data map<string,string>"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), record (null where the line is no JSON): lines keep their number within the file, blank ones go."""
    raw = numbered_lines(spark, path).filter(F.trim("text") != "")
    return raw.select("file", "line", F.when(F.try_parse_json("text").isNotNull(), F.from_json("text", RECORD)).alias("record"))


@dataclass
class LogState:
    """What a log's rows so far say about the next one. ``known`` maps lines to (event, project, status: "on", "void" or "fix"); it may be a state store."""

    known: MutableMapping[int, tuple[str, str | None, str]]
    on: int = 0
    first: tuple[int, str | None] | None = None
    first_safe: tuple[int, str | None] | None = None
    ends: int = 0
    last_end: int = 0
    voids: dict[str, int] = field(default_factory=dict)
    after: dict[str, int] = field(default_factory=dict)

    def verdict(self, line: int, project: str | None, event: str, supersedes: int | None, complete: bool, kinds: Collection[str], begin: str, end: str) -> str:
        """Why a row may not be appended, or ok."""
        if event != FIX and event not in kinds:
            return "unknown event"
        if not complete:
            return "missing field"
        if event == FIX:
            if supersedes is not None and supersedes >= line:
                return "later target"
            target = None if supersedes is None else self.known.get(supersedes)
            if target is None:
                return "no target"
            if target[2] != "on":
                return "target is a correction" if target[2] == "fix" else "corrected before"
            return "start is followed" if target[0] == begin and self.on > 1 else "ok"
        if self.first is not None and project != self.first[1]:
            return "other project"
        # After the end, each voided row of a kind may be replaced once.
        if self.ends and self.after.get(event, 0) >= self.voids.get(event, 0):
            return "after the end"
        return "ok"

    def add(self, line: int, project: str | None, event: str, supersedes: int | None, end: str, remember: bool = True) -> None:
        """Takes a row in. Corrections that name no row in force change nothing. ``remember`` is false for lines that no correction names."""
        self.after[event] = self.after.get(event, 0) + 1
        if event == end:
            self.last_end, self.after = line, {}
        if event != FIX:
            self.on += 1
            self.ends += event == end
            self.first = self.first or (line, project)
            if remember:
                self.known[line] = (event, project, "on")
            else:
                self.first_safe = self.first_safe or (line, project)
            return
        if remember:
            self.known[line] = (event, project, "fix")
        target = self.known.get(supersedes) if supersedes is not None and supersedes < line else None
        if target is None or target[2] != "on":
            return
        self.known[supersedes] = (target[0], target[1], "void")
        self.on -= 1
        self.ends -= target[0] == end
        self.voids[target[0]] = self.voids.get(target[0], 0) + 1
        if self.first is not None and self.first[0] == supersedes:
            rest = [(k, v[1]) for k, v in self.known.items() if v[2] == "on"]
            self.first = min(rest + ([self.first_safe] if self.first_safe else []), key=lambda x: x[0], default=None)


def admission(log: DataFrame, new: DataFrame, kinds: tuple[str, ...], needs: dict[str, tuple[str, ...]] | None = None, begin: str = "loop_start", end: str = "loop_end") -> DataFrame:
    """``new`` rows (file, line, event, supersedes and, if there is one, project) with verdict: ok, or why a row may not be appended to its log.

    A fold over each log in order of lines: rows of ``log`` stand as they are, each new row is judged by those before it that stand or were admitted. Events are of
    known ``kinds`` and have the columns that ``needs`` names for them; rows of a log share the project of its first row in force; a correction names an
    earlier row in force, and not a ``begin`` that others follow; after an ``end`` in force only rows that were voided are replaced, each once.
    A log is read in order by one task, which remembers only those of its lines that corrections name. Null lines or files go by their own order, first; lines should be
    unique in a file. Empty tables give no rows.
    """
    names = new.columns
    kinds_of = dict(new.dtypes)
    project = lambda df: F.col("project").cast("string") if "project" in df.columns else F.lit(None).cast("string")
    complete = F.lit(True)
    for event, columns in (needs or {}).items():
        complete = F.when(F.col("event") == event, reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in columns], F.lit(True))).otherwise(complete)
    mine = lambda df, there, whole: df.select("file", "line", "event", "supersedes", project(df).alias("__project"), F.lit(there).alias("__there"), (complete if whole else F.lit(True)).alias("__complete"))
    rows = mine(log, True, False).unionByName(mine(new, False, True))
    named = rows.filter("event = 'correction'").select("file", F.col("supersedes").alias("line")).distinct().withColumn("__named", F.lit(True))
    rows = rows.join(named, ["file", "line"], "left")

    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = object(), LogState({})
        for p in pdfs:
            verdicts = []
            for file, line, event, supersedes, project, there, complete, named in zip(*(p[c] for c in ("file", "line", "event", "supersedes", "__project", "__there", "__complete", "__named")), strict=True):
                if file != here:
                    here, state = file, LogState({})
                target = None if pd.isna(supersedes) else int(supersedes)
                v = "" if there else state.verdict(line, project, event, target, complete, kinds, begin, end)
                verdicts.append(v)
                if there or v == "ok":
                    state.add(line, project, event, target, end, named is True)
            out = p[["file", "line"]].assign(verdict=verdicts)
            yield out[~p["__there"].to_numpy(bool)]

    dealt = rows.repartition("file").sortWithinPartitions("file", "line")
    judged = dealt.mapInPandas(fold, f"file {kinds_of['file']}, line {kinds_of['line']}, verdict string")
    return new.join(judged, ["file", "line"]).select(*names, "verdict")


def appended(new: DataFrame, order: list[str], path: str) -> DataFrame:
    """Appends rows to a log of JSON lines: a file of its own for each append, in order; what was there stays as it is. Returns the rows."""
    new.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*new.columns)).alias("value")).write.mode("append").text(path)
    return new


def facts(log: DataFrame, keys: list[str], kind: str, seq: str, counts: dict[str, str], last: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per loop: first and last ``seq``, n, a count for each name of ``counts`` (of rows of that kind), and for each name of ``last`` the value that a column has in the last
    row of a kind, null where there is none: what a loop's start, end or last test run says."""
    counted = [F.count_if(F.col(kind) == k).alias(name) for name, k in counts.items()]
    lasting = [F.max_by(F.when(F.col(kind) == k, F.struct(F.col(c).alias("v"))), F.when(F.col(kind) == k, F.col(seq)))["v"].alias(name) for name, (k, c) in last.items()]
    return log.groupBy(*keys).agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count("*").alias("n"), *counted, *lasting)


def strikes(log: DataFrame, code: str, ref: Column, least: int = 2) -> DataFrame:
    """code, n, struck (n reaches ``least``), has_ref."""
    return log.groupBy(code).agg(F.count("*").alias("n"), (F.count("*") >= least).alias("struck"), F.bool_or(ref).alias("has_ref"))


def diff_totals(changes: DataFrame, path: str, added: str, deleted: str, exempt: str, most_lines: int, most_files: int) -> DataFrame:
    """One row: files, lines, over (either limit), of paths that no exemption matches."""
    kept = changes.filter(~F.col(path).rlike(exempt))
    return kept.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.col(added) + F.col(deleted)), F.lit(0)).alias("lines")).withColumn("over", (F.col("lines") > most_lines) | (F.col("files") > most_files))


def without_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1b\[[0-9;?]*[A-Za-z]", "")


def run_evidence(c: Column) -> Column:
    """What a test run's output shows: failed, passed, nothing collected, or unknown."""
    t = F.lower(without_ansi(c))
    return F.when(t.rlike(r"no tests ran|collected 0 items|no test files"), "none").when(t.rlike(r"\b[1-9]\d* (failed|errors?)\b"), "failed").when(t.rlike(r"\b[1-9]\d* passed\b|tests? passed"), "passed").otherwise("unknown")


def key_value(c: Column, strings: Collection[str] = (), strict: bool = False) -> Column:
    """struct(key, value, is_json) of a ``k=v`` text; text without a name and a sign is null, or raises if ``strict``. Values of the keys ``strings`` are never JSON."""
    at = F.instr(c, "=")
    key, value = F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.char_length(c))
    parsed = F.try_parse_json(value).isNotNull() & ~key.isin(*strings) if strings else F.try_parse_json(value).isNotNull()
    pair = F.when(at > 1, F.struct(key.alias("key"), value.alias("value"), parsed.alias("is_json")))
    return pair.when(c.isNotNull(), F.raise_error(F.concat(F.lit("not key=value: "), c))) if strict else pair


# Ranges of characters that don't belong into a text.
CYRILLIC = r"[\x{0400}-\x{052F}]"
HANGUL = r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def hygiene_lines(texts: DataFrame, key: str, text: str, allowed: str) -> DataFrame:
    """key, line (from 1), kinds of each line with characters that don't belong there; a line that holds the mark ``allowed`` says nothing."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).filter(~F.contains("line", F.lit(allowed)))
    kinds = F.filter(F.array(*[F.when(F.col("line").rlike(p), name) for name, p in (("cyrillic", CYRILLIC), ("hangul", HANGUL), ("control", CONTROL))]), lambda k: k.isNotNull())
    return lines.select(key, (F.col("pos") + 1).cast("long").alias("line"), F.array_join(kinds, ",").alias("kinds")).filter("kinds <> ''")


# What added lines must not hold, and what they should not.
BLOCKED = {
    "private key": r"-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----",
    "access key": r"AKIA[0-9A-Z]{16}",
    "credential": r"""(?i)\b(api[_-]?key|secret|token|password|passwd)\b\s*[=:]\s*['"][^'"]{8,}['"]""",
}
WARNED = {"eval": r"\beval\s*\(", "statement": r"""(?i)(execute|cursor\.execute)\s*\(\s*["'].*%s.*["']\s*%"""}


def added_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, file, line, added of the lines that diffs without context add: files begin with +++ b/, hunks name their first line after a plus."""
    rows = diffs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "row"))
    w = Window.partitionBy(key).orderBy("pos")
    plus = (F.col("row").startswith("+") & ~F.col("row").startswith("+++")).cast("long")
    hunk = F.when(F.col("row").startswith("@@"), F.regexp_extract("row", r"\+(\d+)", 1).cast("long"))
    rows = rows.withColumn("n", F.sum(plus).over(w)).withColumn("file", F.last(F.when(F.col("row").startswith("+++ "), F.regexp_replace("row", r"^\+\+\+ (b/)?", "")), ignorenulls=True).over(w))
    rows = rows.withColumn("first", F.last(F.when(hunk.isNotNull(), hunk - F.col("n")), ignorenulls=True).over(w))
    return rows.filter(plus == 1).select(key, "file", (F.col("first") + F.col("n") - 1).alias("line"), F.substring("row", 2, 1_000_000_000).alias("added"))


def findings(lines: DataFrame, added: str, exempt: str | None = None) -> DataFrame:
    """lines with label and blocks for each pattern that an added line holds, but for files that match ``exempt``."""
    kept = lines if exempt is None else lines.filter(~F.col("file").rlike(exempt))
    hits = F.array(*[F.when(F.col(added).rlike(p), F.struct(F.lit(name).alias("label"), F.lit(blocks).alias("blocks"))) for blocks, some in ((True, BLOCKED), (False, WARNED)) for name, p in some.items()])
    return kept.withColumn("__h", F.explode(F.filter(hits, lambda h: h.isNotNull()))).select("*", "__h.label", "__h.blocks").drop("__h", added)


def largest(changes: DataFrame, path: str, added: str, deleted: str, exempt: str, k: int = 5) -> DataFrame:
    """path, lines of the ``k`` largest changes that aren't exempt, ties by path."""
    return changes.filter(~F.col(path).rlike(exempt)).select(path, (F.col(added) + F.col(deleted)).alias("lines")).orderBy(F.desc("lines"), path).limit(k)


# What an output says when nothing could be started, when nothing ran, and what shows that something did.
NOT_STARTED = ("command not found", "not recognized as an internal", "no such file or directory", "cannot find module", "this is not the tsc command")
NOTHING_RAN = ("no tests ran", "no tests were found", "no test files found", "no tests found", "missing script", "no test specified")
RAN = (r"\b\d+ (passed|failed|errors?|skipped)\b", r"\btests?\s+\d+", r"test result:\s*(ok|failed)", r"\b\d+\s+(tests?|examples?),\s*\d+\s+(failures?|assertions?)")


def run_outcome(output: Column, code: Column, command: Column) -> Column:
    """struct(ran, reason): whether tests ran at all. An exit code isn't believed alone: 5 of pytest and 127 say that nothing ran, 0 needs evidence in the output."""
    t = F.lower(without_ansi(F.coalesce(output, F.lit(""))))
    holds = lambda some: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in some])
    evidence = reduce(lambda a, b: a | b, [t.rlike(p) for p in RAN])
    reason = (
        F.when(holds(NOT_STARTED), "not started").when(holds(NOTHING_RAN), "nothing ran").when((code == 5) & F.contains(command, F.lit("pytest")), "nothing collected")
        .when(code == 127, "not found").when((code == 0) & ~evidence, "no evidence").otherwise("")
    )
    return F.struct((reason == "").alias("ran"), reason.alias("reason"))


def hygiene(c: Column) -> Column:
    """struct(cyrillic, hangul, control, lone_cr): counts of code points that text shouldn't have."""
    n = lambda p: F.regexp_count(c, F.lit(p)).cast("long")
    return F.struct(n(CYRILLIC).alias("cyrillic"), n(HANGUL).alias("hangul"), n(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]").alias("control"), n(r"\r(?!\n)").alias("lone_cr"))
