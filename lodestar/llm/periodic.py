"""Periodic runs of words: aligned power-of-two blocks, searched for across the document, seed exact extensions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_chars, text_udf

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run is as long as so many of its periods, and so many words, at least.
PERIODS, LEAST = 4, 6


def _gap_ahead(codes: np.ndarray) -> np.ndarray:
    """For each word the distance to the next equal one (the length of the text where there is none)."""
    order = np.argsort(codes, kind="stable")
    gap = np.full(len(codes), len(codes), np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    gap[order[:-1][same]] = np.diff(order)[same]
    return gap


def _matches(codes: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(block, place) of the aligned blocks at ``starts`` and the places of equal stretches from ``size`` to below twice ``size`` words behind.

    The blocks are the keys of an automaton over sequences of integers, which reads the document where an occurrence can be. All keys are
    of one length, so at most one ends at a place, and at most one aligned block lies at a compatible distance before it.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    kind: dict[int, int] = {}
    for at in starts.tolist():
        key = tuple(codes[at : at + size].tolist())
        kind[at] = automaton.get(key, at)
        automaton.add_word(key, kind[at])
    automaton.make_automaton()
    ends = np.minimum(starts + 3 * size - 1, len(codes))
    # Stretches to read, those that meet or overlap as one.
    opens = np.concatenate(([True], starts[1:] + size > ends[:-1]))
    lows, highs = (starts + size)[opens].tolist(), ends[np.concatenate((opens[1:], [True]))].tolist()
    for low, high in zip(lows, highs, strict=True):
        for end, found in automaton.iter(tuple(codes[low:high].tolist())):
            place = low + end - size + 1
            block = (place - size) // size * size
            if kind.get(block) == found:
                yield block, place


def _reach(codes: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on agree, going forward (step 1) or backward (-1): in stretches that double."""
    most = len(codes) - b if step > 0 else a + 1
    done, size = 0, 32
    while done < most:
        n = min(size, most - done)
        if step > 0:
            differ = codes[a + done : a + done + n] != codes[b + done : b + done + n]
        else:
            differ = (codes[a - done - n + 1 : a - done + 1] != codes[b - done - n + 1 : b - done + 1])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, size = done + n, size * 2
    return done


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of a sequence of integers, by start, then period.

    A run of period q is a stretch, as long as can be, whose members q apart agree, of at least max(6, 4 q) members. With ``size`` the largest power
    of two up to q, it holds an aligned block of that size within its first 2 size - 1 members, which occurs again q later. A
    block is looked for only if each of its members recurs within less than 2 size: in a run each does within q. What two equal
    blocks agree in is extended in both directions, once for each stretch. Within a run of period p that is known, blocks at a distance q >= p agree only if p divides
    q, and their stretch is that run: such blocks are left out, so a text that is one run takes no longer than others.
    """
    n = len(codes)
    gap = _gap_ahead(codes) if n >= LEAST else np.array([], np.int64)
    best: dict[tuple[int, int], int] = {}
    # Of the run with the largest period so far at each place: its end and its period.
    until, period = np.zeros(n, np.int64), np.ones(n, np.int64)
    size = 1
    while PERIODS * size <= n and n >= LEAST:
        near = gap[: n - n % size] < 2 * size
        starts = np.flatnonzero(near if size == 1 else near.reshape(-1, size).all(axis=1)) * size
        starts = starts[until[starts] < np.minimum(starts + 3 * size - 1, n)]
        if len(starts):
            reached: dict[int, int] = {}
            for block, place in _matches(codes, starts, size):
                q = place - block
                if place < reached.get(q, 0) or (place + size <= until[block] and q % period[block] == 0):
                    continue
                end = place + _reach(codes, block, place, 1)
                start = block - _reach(codes, block - 1, place - 1, -1)
                reached[q] = end
                if end - start >= max(LEAST, PERIODS * q):
                    best[start, end] = min(q, best.get((start, end), q))
                    if best[start, end] == q:
                        until[start:end], period[start:end] = end, q
        size *= 2
    return sorted((start, end - start, q) for (start, end), q in best.items())


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words, in one of ten documents with a repeat: from a on, word a + (i - a) % p for word i (see ``periodic_runs``)."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def coded(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run repeats: of each run the first period stays, unless another run repeats it."""
    if not runs:
        return words
    drop = np.zeros(len(words), bool)
    for start, length, q in runs:
        drop[start + q : start + length] = True
    return [words[i] for i in np.flatnonzero(~drop).tolist()]


def _report(text: str, doc_id: int | None) -> tuple:
    words = planted(WORD.findall(text), doc_id)
    runs = find_runs(coded(words))
    # Exact comparison of length / period by products: of equal ones the first in order stays.
    top = None
    for run in runs:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    start, length, q = top or (None, None, None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return len(runs), start, length, q, top and 1000 * length // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()


_FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def _reports(args: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct(_FIELDS)
    for texts, ids in args:
        numbers, at, out = ids.to_pylist(), 0, []
        for part in by_chars(texts, 1 << 22):
            out += [_report(t, i) for t, i in zip(part, numbers[at : at + len(part)], strict=True)]
            at += len(part)
        yield pa.array([dict(zip((n for n, _ in _FIELDS), r, strict=True)) for r in out], kind)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of repeated words in each whole text, and what is left of it when each run is cut to its first period.

    doc_id, n_runs; start (word number), length, period and exponent_milli of the run with the greatest length / period (ties: smallest start, then
    period), null without runs; runs_sha256 of all runs as lines `start,length,period`; collapsed_sha256 of the words that are left,
    joined by one space. Words are what ASCII white space leaves apart. In documents whose crc32(doc_id) % 10 is 0 a repeat is planted first (see ``planted``).

    Null or empty texts have no words and no runs. A null doc_id plants nothing. Each row counts by itself, so repeated rows and ids give repeated
    results. Very long texts are read whole: time grows with n log n and memory with n. An empty table gives no rows. Further columns are ignored, whatever their names.
    """
    udf = text_udf(_reports, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in _FIELDS))
    found: Column = udf("text", "doc_id")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", found.alias("r")).select("doc_id", *[F.col("r")[n].alias(n) for n, _ in _FIELDS])
