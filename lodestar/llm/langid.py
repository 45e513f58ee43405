"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays, with calibrated rejection."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_chars, dropped, made, text_udf, written

ORDER = 4
PAD, SPACE, BITS = 1, 32, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)  # odd, so the product is one-to-one on 64 bits
#: Characters that are scored at once; longer texts are scored in slices.
_CHUNK = 200_000
#: Languages that share one set of tables. A row of a table has a value for each of them, so memory grows with the languages, not their square.
_BANK = 8
UND = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all texts in a row, and where each begins: letters in lower case, each other run one space.

    ORDER - 1 pads stand before each text. Characters beyond 16 bits share one code.
    """
    joined = "\0" + "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts)
    cp = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where(_letters()[cp], np.minimum(cp, 0xFFFF), SPACE).astype(np.uint16)
    c[cp == 0] = PAD
    gap = c <= SPACE
    keep = ~gap | (c == PAD)
    keep[1:] |= ~gap[:-1]
    c = c[keep]
    c = np.repeat(c, np.where(c == PAD, ORDER - 1, 1))
    pads = np.flatnonzero(c == PAD)
    return c, pads[:: ORDER - 1]


def grams(c: np.ndarray) -> np.ndarray:
    """The packed ORDER characters that end at each code from index ORDER - 1 on."""
    n = len(c) - ORDER + 1
    key = np.zeros(max(n, 0), np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(BITS)) | c[i : i + n].astype(np.uint64)
    return key


class Table(NamedTuple):
    """Hashes in order, the first index for each value of their top bits, and a row of values for each."""

    keys: np.ndarray
    starts: np.ndarray
    probes: int
    values: np.ndarray

    @classmethod
    def of(cls, packed: np.ndarray, values: np.ndarray) -> Table:
        h = packed * _ODD
        order = np.argsort(h)
        h = h[order]
        bits = 18
        starts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        probes = int(np.diff(starts).max(initial=0))
        pad = np.full(probes + 1, np.uint64(0))
        return cls(np.concatenate([h, pad]), starts[:-1], probes, np.vstack([values[order], np.zeros((probes + 1, values.shape[1]))]).astype(np.float32))

    def find(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each packed gram, and whether it is there: a few probes from its bucket's start."""
        h = packed * _ODD
        at = self.starts[h >> np.uint64(46)]
        hit = self.keys[at] == h
        todo = np.flatnonzero(~hit & (self.keys[at] < h))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] += 1
            k = self.keys[at[todo]]
            hit[todo] = k == h[todo]
            todo = todo[(k < h[todo]) & (k != 0)]
        return at, hit & (at < len(self.keys) - self.probes - 1)


class Bank(NamedTuple):
    """Natural-log probabilities of grams and back-off weights of contexts by order, a column for each of a few languages."""

    probs: list[Table]
    backoff: list[Table]
    floor: np.ndarray

    def log_probs(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Rows of log probabilities of the last of ``order`` packed characters after the others."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(key), len(self.floor)))
        t = self.probs[order - 1]
        at, hit = t.find(key)
        out = t.values[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            k = key[miss]
            lower = self.log_probs(k & np.uint64((1 << (BITS * (order - 1))) - 1), order - 1)
            b = self.backoff[order - 1]
            ctx, known = b.find(k >> np.uint64(BITS))
            out[miss] = lower + np.where(known[:, None], b.values[ctx], 0)
        return out


class Model(NamedTuple):
    """Languages, their tables in banks of a few, and what calibration found."""

    langs: list[str]
    banks: list[Bank]
    mean: np.ndarray
    spread: np.ndarray
    slack: float
    heat: float

    def log_probs(self, key: np.ndarray) -> np.ndarray:
        """Rows of log probabilities of the last character of each gram, a column for each language."""
        return np.hstack([b.log_probs(key) for b in self.banks])

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: summed log probabilities by language, scored characters, letters. Texts beyond _CHUNK are read in slices."""
        total, n, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        short = [i for i, t in enumerate(texts) if len(t) <= _CHUNK]
        if short:
            c, at = codes([texts[i] for i in short])
            c = np.append(c, np.uint16(PAD))  # so that an empty last text has a window too
            p = self.log_probs(grams(c))
            target = c[ORDER - 1 :]
            p[target == PAD] = 0
            total[short] = np.add.reduceat(p, at, axis=0)  # a text's windows are those that begin at its pads
            n[short] = np.add.reduceat((target != PAD).astype(np.int64), at)
            letters[short] = np.add.reduceat((target > SPACE).astype(np.int64), at)
        for i, t in enumerate(texts):
            if len(t) > _CHUNK:
                before = np.full(ORDER - 1, PAD, np.uint16)
                for a in range(0, len(t), _CHUNK):
                    c = codes([t[a : a + _CHUNK]])[0][ORDER - 1 :]
                    c = c[1:] if len(c) and c[0] == SPACE and before[-1] <= SPACE else c
                    target, c = c, np.concatenate([before, c])
                    if len(target):
                        total[i] += self.log_probs(grams(c)).sum(axis=0, dtype=np.float64)
                    n[i] += len(target)
                    letters[i] += int((target > SPACE).sum())
                    before = c[-(ORDER - 1) :]
        return total, n, letters

    def predict(self, texts: list[str]) -> list[tuple[str, float, float, bool]]:
        """Per text: language (UND without letters), its posterior, cross-entropy per character, whether it is accepted."""
        if not self.langs:
            return [(UND, 0.0, 0.0, False)] * len(texts)
        out: list[tuple[str, float, float, bool]] = []
        total, n, letters = self.scores(texts)
        m = np.maximum(n, 1)
        best = total.argmax(axis=1)
        z = (total - total.max(axis=1, keepdims=True)) / self.heat
        post = 1 / np.exp(z).sum(axis=1)
        ce = -total.max(axis=1) / m
        for i, b in enumerate(best.tolist()):
            if not letters[i]:
                out.append((UND, 0.0, 0.0, False))
            else:
                over = ce[i] - self.mean[b] - 6 * self.spread[b] / np.sqrt(m[i])
                out.append((self.langs[b], float(post[i]), float(ce[i]), bool(over <= self.slack)))
        return out


def kneser_ney(n_langs: int, alphabet: int, lang: np.ndarray, key: np.ndarray, n: np.ndarray) -> Bank:
    """Interpolated Kneser-Ney from the counts of full-order grams by language index; lower orders count distinct left contexts.

    ``alphabet`` is how many characters the lowest order shares its mass among, the same for all languages.
    """
    full, at = np.unique(key, return_inverse=True)
    count = np.zeros((len(full), n_langs))
    np.add.at(count, (at, lang), n)
    by_order = [(full, count)]
    for order in range(ORDER - 1, 0, -1):
        longer, c = by_order[0]
        short, at = np.unique(longer & np.uint64((1 << (BITS * order)) - 1), return_inverse=True)
        cont = np.zeros((len(short), n_langs))
        np.add.at(cont, at, c > 0)
        by_order.insert(0, (short, cont))
    lower_keys, lower = np.zeros(1, np.uint64), np.full((1, n_langs), 1 / alphabet)
    probs, backoff = [], []
    for order, (keys, c) in enumerate(by_order, 1):
        ctx_keys, ctx = np.unique(keys >> np.uint64(BITS), return_inverse=True)
        tot, kinds = np.zeros((len(ctx_keys), n_langs)), np.zeros((len(ctx_keys), n_langs))
        np.add.at(tot, ctx, c)
        np.add.at(kinds, ctx, c > 0)
        one, two = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        d = np.clip(one / np.maximum(one + 2 * two, 1), 0.1, 0.95)
        gamma = np.where(tot > 0, d * kinds / np.maximum(tot, 1), 1.0)
        suffix = np.searchsorted(lower_keys, keys & np.uint64((1 << (BITS * (order - 1))) - 1))
        p = np.maximum(c - d, 0) / np.maximum(tot, 1)[ctx] * (tot[ctx] > 0) + gamma[ctx] * lower[suffix]
        probs.append(Table.of(keys, np.log(p)))
        backoff.append(Table.of(ctx_keys, np.log(gamma)))
        lower_keys, lower = keys, p
    return Bank(probs, backoff, np.full(n_langs, -np.log(alphabet)))


def held_out() -> F.Column:
    """Whether a document's label may not be learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, docs_per_lang: int, sample_docs: int) -> tuple[DataFrame, list[str]]:
    """text, lang, rank of a bounded sample of labelled rows, and the languages.

    A row is labelled if its lang, doc_id and text are known and it isn't held out. Of each language the distinct texts with the smallest hashes
    are taken, ``docs_per_lang`` of them, or fewer where all languages together would pass ``sample_docs``; texts that repeat count
    once. Texts whose hash is far beyond what is taken go before they are ranked, so that a hot language isn't one task's.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    # One row per language.
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).collect()}
    langs = sorted(sizes)
    take = max(1, min(docs_per_lang, sample_docs // max(1, len(langs))))
    limits = spark.createDataFrame([(x, int(min(1.0, 4 * take / sizes[x]) * (1 << 30))) for x in langs], "lang string, most long")
    place = F.pmod("h", F.lit(1 << 30))
    near = rows.join(F.broadcast(limits), "lang").filter(place < F.col("most")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))
    return written(written(near, "lang-near").withColumn("rank", ranked).filter(F.col("rank") <= take).select("text", "lang", "rank"), "lang-sample"), langs


def train(docs: DataFrame, docs_per_lang: int = 800, sample_docs: int = 20_000) -> Model:
    """Fits the models on a bounded sample of labelled rows (see labelled_sample): every language that labels name is learned.

    A fifth of the sample calibrates: the spread of cross-entropy, the slack beyond which a text is rejected (never
    one like those of the sample), and the posterior's temperature. Every counted gram of the rest is used. Counts come to the driver a
    bank of languages at a time; the model's size is bounded by the sample's (a few MB for four languages). No labelled rows: no languages.
    Rows with a null doc_id, lang or text teach nothing.
    """
    since = len(made())
    sample, langs = labelled_sample(docs, docs_per_lang, sample_docs)
    if not langs:
        return Model([], [], np.zeros(0), np.zeros(0), 0.0, 1.0)
    test = F.col("rank") % 5 == 0

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                c, _ = codes([text.as_py()])
                key, n = np.unique(grams(c)[c[ORDER - 1 :] != PAD], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    counts = written(sample.filter(~test).select("text", "lang").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), "lang-counts")
    alphabet = counts.select(F.col("key").bitwiseAND(F.lit((1 << BITS) - 1))).distinct().count() + 1000
    banks = []
    for a in range(0, len(langs), _BANK):
        some = langs[a : a + _BANK]
        got = counts.filter(F.col("lang").isin(some)).toArrow()
        index = {x: i for i, x in enumerate(some)}
        banks.append(kneser_ney(len(some), alphabet, np.array([index[x] for x in got["lang"].to_pylist()], dtype=np.int64), np.asarray(got["key"]).view(np.uint64), np.asarray(got["n"])))
    model = Model(langs, banks, np.full(len(langs), 99.0), np.zeros(len(langs)), 0.0, 1.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                total, n, letters = sent.value.scores([text.as_py()])
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(n), pa.array(letters)], ["lang", "total", "n", "letters"])

    # At most a fifth of the sample.
    seen = sample.filter(test).select("text", "lang").mapInArrow(measure, "lang string, total array<double>, n long, letters long").filter("letters > 0").collect()
    dropped(docs.sparkSession, since)
    if not seen:
        return model
    index = {x: i for i, x in enumerate(langs)}
    total, n, y = np.array([r["total"] for r in seen]), np.array([r["n"] for r in seen]), np.array([index[r["lang"]] for r in seen])
    ce = -total.max(axis=1) / n
    mean, spread = np.full(len(langs), ce.mean()), np.full(len(langs), 1.0)
    for i in range(len(langs)):
        if (y == i).any():
            mean[i] = np.median(ce[y == i])
            spread[i] = np.median(np.abs(ce[y == i] - mean[i]) * np.sqrt(n[y == i])) * 1.5 + 0.1
    best = total.argmax(axis=1)
    slack = max(0.0, float((ce - mean[best] - 6 * spread[best] / np.sqrt(n)).max())) + 0.75
    z = total - total.max(axis=1, keepdims=True)
    loss = {t: float(-(z[np.arange(len(y)), y] / t - np.log(np.exp(z / t).sum(axis=1))).mean()) for t in (1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0, 50.0)}
    return model._replace(mean=mean, spread=spread, slack=slack, heat=min(loss, key=loss.get))  # type: ignore[arg-type]


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and lang_pred, lang_score (0 to 1), lang_entropy (nats per character), lang_accepted.

    Whole texts are scored. lang_pred is the language with the lowest cross-entropy per character; the score is its
    posterior at the calibrated temperature. Null text or one without letters: ``und``, 0, 0, not accepted. Texts whose cross-entropy
    is further above their language's than calibration allows for their length aren't accepted. Columns of
    those names in docs are replaced; rows with a null doc_id and repeated rows are scored like others. Only texts go to Python.
    """
    new = ["lang_pred", "lang_score", "lang_entropy", "lang_accepted"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at_once = max(20_000, _CHUNK * 2 * _BANK // max(2 * _BANK, len(sent.value.langs)))
        for batch in batches:
            out: list[tuple] = []
            for part in by_chars(batch, at_once):
                out += sent.value.predict(part)
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], new)

    found = text_udf(run, "lang_pred string, lang_score double, lang_entropy double, lang_accepted boolean")
    docs = docs.drop(*new)
    return docs.withColumn("__lang", found(F.col("text").cast("string"))).select(*docs.columns, "__lang.*")
