"""The named queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, html_text, jaccard, langid, licenses, mixing, packing, periodic, search, secrets, sharding, warc
from .common import spread_table, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spread_table(spark, sf_dir, "pages"))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.entropy_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.license_scan(spread_table(spark, sf_dir, "documents")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(spread_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "documents"))
    found = langid.identified(spread_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op11_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))[0]


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(spread_table(spark, sf_dir, "documents"))


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_license_scan reports of the base phrases alone, which SQL can say too."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9_secret_scan reports of the base kinds alone, which SQL can count too."""
    return op9_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_scan": op6_license_scan,
    "op7_main_text": op7_main_text,
    "op8_entropy_mix": op8_entropy_mix,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
    "op11_slot_sharding": op11_slot_sharding,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
    "base_licenses": base_licenses,
    "base_secrets": base_secrets,
}

#: White space as Python's str.split has it.
_SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: What SQL can express as a whole. The others hang on models or on an order of work; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    # All pairs that share a shingle, then the closure of the links.
    "op1_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
texts AS (SELECT text AS t, min(doc_id) AS rep, count(*) AS n_copies, any_value(w) AS w FROM w WHERE len(w) > 0 GROUP BY text),
s AS (SELECT rep, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:least(i + 4, len(w))], chr(1))))) AS s FROM texts),
size AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
pair AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.rep <> b.rep GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.rep = a JOIN size y ON y.rep = b WHERE pair.n >= 0.8 * (x.n + y.n - pair.n) - 1e-9),
reach AS (SELECT rep AS a, rep AS b FROM texts UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, CAST(coalesce(t.n_copies, 1) AS BIGINT) AS n_copies
FROM documents d LEFT JOIN texts t ON t.t = d.text LEFT JOIN class c ON c.a = t.rep LEFT JOIN links l ON l.a = t.rep""",
    # SHA-1's 160 bits in groups of five.
    "op2_warc_round_trip": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), d AS (SELECT *, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS top FROM p),
b AS (SELECT DISTINCT sha, array_to_string(list_transform(string_split(sha, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM d),
e AS (SELECT sha, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * (16 >> j))) AS INTEGER), 1)), '') AS digest FROM b)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, url FROM d JOIN e USING (sha)""",
    "op3_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "base_licenses": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w),
m AS (SELECT doc_id, i - 1 AS i, CASE WHEN w[i:i + 1] = ['mit', 'license'] THEN 'mit' WHEN w[i:i + 1] = ['apache', 'license'] THEN 'apache' WHEN w[i:i + 2] = ['general', 'public', 'license'] THEN 'gpl' END AS label FROM p),
g AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m WHERE label IS NOT NULL GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g ON w.doc_id = g.doc_id""",
    "base_secrets": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM t""",
}
