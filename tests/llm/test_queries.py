"""Each registered query over whole small tables: the columns and types that its contract names, one row per row where that is so."""

import pytest

from lodestar.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id bigint class_id bigint n_links bigint",
    "op2": "page_id bigint payload_bytes bigint payload_digest string record_type string refers_to bigint",
    "op3": "query_id bigint rank int vec_id bigint score bigint",
    "op4": "query_id bigint rank int vec_id bigint score double",
    "op5": "doc_id bigint piece int start bigint length bigint ids_crc32 bigint sequence_id bigint offset bigint",
    "op6": "doc_id bigint n_words bigint n_base bigint first_word bigint last_word bigint base_labels string labels string score double",
    "op7": "page_id bigint url string text string n_chars bigint",
    "op8": "doc_id bigint size bigint source_size bigint target double taken bigint",
    "op9": "doc_id bigint n_assign bigint n_access bigint n_hex bigint base_sha256 string spans string",
    "op10": "doc_id bigint held_out boolean lang_pred string score double",
    "op11": "doc_id bigint size bigint text_crc32 bigint law string shard int slot bigint grown_shard int",
    "op12": "conv_id bigint gaps bigint blank bigint duplicate bigint truncated bigint illegal bigint cost bigint audit string repaired_sha256 string",
    "op13": "doc_id bigint n_runs bigint start bigint length bigint period bigint exponent_milli bigint runs_sha256 string collapsed_sha256 string",
    "base_licenses": "doc_id bigint n_words bigint n_base bigint first_word bigint last_word bigint base_labels string",
    "base_secrets": "doc_id bigint n_assign bigint n_access bigint n_hex bigint",
}
ROWS = {"op1": "documents", "op2": "pages", "op6": "documents", "op7": "pages", "op8": "documents", "op9": "documents", "op10": "documents", "op11": "documents", "op13": "documents", "base_licenses": "documents", "base_secrets": "documents"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    op = name if name in COLUMNS else name.split("_")[0]
    df = QUERIES[name](spark, SF)
    parts = COLUMNS[op].split()
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in parts[::2]} == dict(zip(parts[::2], parts[1::2], strict=True))
    n = df.count()
    assert n > 0
    if op in ROWS:
        assert n == spark.read.parquet(f"{SF}/{ROWS[op]}.parquet").count()
