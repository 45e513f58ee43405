"""A log that grows by what arrives and is admitted."""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.operators.oplog import LogState

SCHEMA = "file long, line long, project string, event string, supersedes long, complete boolean, there boolean"
RESULT = "file long, line long, project string, event string, supersedes long, verdict string"


class _Lines(MutableMapping):
    """The lines of a log in a state store: only those asked for are read."""

    def __init__(self, state) -> None:  # noqa: ANN001
        self.state = state

    def __getitem__(self, line: int) -> tuple:
        if not self.state.containsKey((line,)):
            raise KeyError(line)
        return tuple(self.state.getValue((line,)))

    def __setitem__(self, line: int, value: tuple) -> None:
        self.state.updateValue((line,), value)

    def __delitem__(self, line: int) -> None:
        self.state.removeKey((line,))

    def __iter__(self) -> Iterator[int]:
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)


class Admission(StatefulProcessor):
    """Judges each log's rows by those that stand (see oplog.admission); what a log says so far is its key's state."""

    def __init__(self, kinds: tuple[str, ...], begin: str, end: str) -> None:
        self.kinds, self.begin, self.end = kinds, begin, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "line long", "event string, project string, status string")
        self.rest = handle.getValueState("rest", "n long, first long, project string, ends long, last_end long, voids string, after string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        import json

        log = LogState(_Lines(self.lines))
        if self.rest.exists():
            n, first, project, ends, last_end, voids, after = self.rest.get()
            log = LogState(log.known, n, None if first is None else (first, project), None, ends, last_end, json.loads(voids), json.loads(after))
        batch = pd.concat(list(rows)).sort_values("line")
        verdicts = []
        for line, project, event, target, complete, there in zip(*(batch[c] for c in ("line", "project", "event", "supersedes", "complete", "there")), strict=True):
            line, target = int(line), None if pd.isna(target) else int(target)
            v = "" if there else log.verdict(line, project, event, target, complete, self.kinds, self.begin, self.end)
            verdicts.append(v)
            if there or v == "ok":
                log.add(line, project, event, target, self.end)
        line, project = log.first or (None, None)
        self.rest.update((log.on, line, project, log.ends, log.last_end, json.dumps(log.voids), json.dumps(log.after)))
        out = batch.assign(verdict=verdicts, supersedes=batch["supersedes"].astype("Int64"))
        yield out[["file", "line", "project", "event", "supersedes", "verdict"]]

    def close(self) -> None:
        pass


def judged(rows: DataFrame, kinds: tuple[str, ...], begin: str = "loop_start", end: str = "loop_end") -> DataFrame:
    """A stream of rows (SCHEMA) with verdicts, empty for rows that were there before. Rows of a log must arrive in order of lines, in any batches."""
    return rows.groupBy("file").transformWithStateInPandas(statefulProcessor=Admission(kinds, begin, end), outputStructType=RESULT, outputMode="Append", timeMode="None")


def follow(spark: SparkSession, incoming: str, log: str, progress: str, kinds: tuple[str, ...], files_at_once: int = 1000) -> None:
    """Judges all rows of JSON lines that have arrived in ``incoming`` since the last call, in micro-batches of files by name; verdicts are appended to ``log`` as Parquet.

    Each log's state is kept by its key in a state store below ``progress``, so no batch reads the log again.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).json(incoming)
    try:
        judged(rows, kinds).writeStream.format("parquet").option("path", log).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
