"""Best-fit packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, rechunked, row_ids, spread, tidied

#: GPT-2's pre-tokenisation pattern; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary (a ``tokenizers`` JSON file), as little-endian unsigned 32-bit bytes.

    Equal to ``tokenizers`` with ``add_special_tokens=False``; texts that hold a special token's string go through ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        char = _byte_of_char()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.path, self.special, self._slow = path, special, None
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self.path)
            return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.asarray(self._bpe.encode_ordinary(text), dtype="<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids and then ``end_id``, whole if it fits ``capacity``, else cut into pieces of ``capacity``.

    Of a longer document the first piece takes the remainder, so it may be shorter and all others are full.
    Returns doc_id, piece (from 0), start (ids before it), length and ids (binary, little-endian unsigned 32-bit).
    Null or empty text: one piece that holds ``end_id`` alone. Null doc_ids and repeated rows are kept as they are.
    A column __salt (long), if there is one, is passed on; other columns of ``docs`` are ignored. Very long texts are read whole. An empty table gives no rows.
    """
    salted = "__salt" in docs.columns

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.asarray([end_id], dtype="<u4").tobytes()
        step = 4 * capacity

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids", "__salt"][: len(cols)])

        for batch in batches:
            rows, size = [], 0
            salts = [(x,) for x in batch.column(2).to_pylist()] if salted else [()] * batch.num_rows
            for doc_id, text, salt in zip(batch.column(0).to_pylist(), batch.column(1), salts, strict=True):
                ids = enc.encode(text.as_py() or "") + end
                size += len(ids)
                a, piece = 0, 0
                b = len(ids) % step or step
                while a < len(ids):
                    rows.append((doc_id, piece, a // 4, (b - a) // 4, ids[a:b], *salt))
                    a, b, piece = b, b + step, piece + 1
                if size > 8_000_000:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    more = ["__salt"] if salted else []
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(tidied(cut), "doc_id long, piece int, start long, length long, ids binary" + ", __salt long" * salted)


class OpenBins:
    """Bounded-space online best-fit: at most ``limit`` open bins, found through a bitset keyed by free space."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.n_open, self.next_bin = 0, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it: the open bin with the least free space that fits, else a new one.

        When more than ``limit`` bins are open, the fullest closes.
        """
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.capacity, self.next_bin
            self.next_bin += 1
        left = free - length
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return b, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        b = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return b


def pack_best_fit(pieces: DataFrame, capacity: int = 2048, open_bins: int = 1024, packers: int = 1, order: tuple[str, ...] = ("doc_id", "piece"), lookahead: int = 1000) -> DataFrame:
    """Adds sequence_id and offset: each piece's sequence of at most ``capacity`` ids and its place there.

    Pieces are dealt by a hash of ``order`` to ``packers`` independent packers, each of which streams its pieces, in
    the order of another hash, through a bounded set of ``open_bins`` open bins (see OpenBins), ``lookahead`` pieces at a time
    from the longest to the shortest. Memory is bounded by the open bins and what is looked ahead. A packer leaves at most ``open_bins`` sequences partly filled at its end, so use as few packers as
    time allows. So the order is best-fit decreasing within each ``lookahead`` pieces and online beyond them, whatever the
    batches that Spark deals. Lengths must be from 1 to ``capacity``. Reruns agree. An empty table gives an empty table.
    """
    names = pieces.columns
    dealt = pieces.repartition(packers, F.xxhash64(*order, F.lit(1))).sortWithinPartitions(F.xxhash64(*order), *order)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 36
        for batch in rechunked(batches, lookahead):
            lengths = batch.column(names.index("length")).to_pylist()
            placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
            for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
                placed[i] = bins.place(lengths[i])
            more = [pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "sequence_id", "offset"])

    return dealt.mapInArrow(tidied(pack), schema)


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, open_bins: int = 1024, end_id: int = 0, docs_per_packer: int = 150_000, keep_ids: bool = True) -> DataFrame:
    """Tokenises and packs: ``tokenized_pieces`` and ``pack_best_fit`` with the number of packers that the row count asks for.

    Pieces are dealt and ordered by what they are (doc_id, piece, start, length, ids_crc32), so reruns agree whatever the partitions, and rows without a doc_id
    spread like others. Rows that agree in doc_id and text fall to one packer, unless there are more of them than an eighth of its share: then (fewer than
    eight times as many cases as packers, so they are broadcast) they are dealt by their place in the files. ``ids_crc32`` (unsigned, of the binary ids) is taken before the shuffle; with ``keep_ids=False`` the ids
    themselves aren't shuffled, only what places them. Cases: see the two functions.
    """
    n: Any = docs.count()
    packers = max(1, math.ceil(n / docs_per_packer))
    if packers > 1:
        content = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        rows = row_ids(docs.select("doc_id", "text")).withColumn("__c", content)
        hot = rows.groupBy("__c").agg(F.count("*").alias("__n")).filter(F.col("__n") * packers * 8 > n).select("__c", F.lit(True).alias("__hot"))
        docs = spread(rows).join(F.broadcast(hot), "__c", "left").withColumn("__salt", F.when(F.col("__hot"), F.xxhash64(*ROW)).otherwise(F.lit(0).cast("long")))
    else:
        docs = spread(docs)
    pieces = tokenized_pieces(docs, tokenizer_path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        pieces = pieces.drop("ids")
    order = ("doc_id", "piece", "start", "length", "ids_crc32")
    return pack_best_fit(pieces, capacity, open_bins, packers, (*order, "__salt") if packers > 1 else order).drop("__salt")


def assembled(packed: DataFrame) -> DataFrame:
    """One row per sequence: its id, its ids in order of offset (binary) and its number of ids. ``packed`` needs ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"]))).alias("h"), F.sum("length").alias("length")).select("sequence_id", F.unhex("h").alias("ids"), "length")
