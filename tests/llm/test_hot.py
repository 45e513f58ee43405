"""Hot groups and look-alikes of the Jaccard join and of packing."""

from pyspark.sql import functions as F

from lodestar.llm import jaccard, packing
from lodestar.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string"


def test_null_characters_make_other_words(spark):
    plain = " ".join(f"w{i}" for i in range(40))
    with_nulls = " ".join(f"w{i}\0" for i in range(40))
    assert jaccard.word_hashes("a").tolist() != jaccard.word_hashes("a\0").tolist() != jaccard.word_hashes("\0a").tolist()
    rows = jaccard.jaccard_join(spark.createDataFrame([(1, plain), (2, with_nulls)], SCHEMA)).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in rows} == {(1, 1, 0), (2, 2, 0)}


def test_one_row_of_a_text_is_verified(spark, monkeypatch):
    text = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(None, text)] * 10_000 + [(4, text + " end")], SCHEMA)
    sent = []

    def counted(found, *more):
        sent.append((found.count(), found.select("key").distinct().count(), found.groupBy("key", "leaf", "first", "second").count().agg(F.max("count")).first()[0]))
        return real(found, *more)

    real = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", counted)
    rows = jaccard.jaccard_join(df).collect()
    assert len(rows) == 10_001 and {(r.class_id, r.n_links) for r in rows} == {(4, 1)}
    assert sent[0][1:] == (2, 1)


def test_rows_without_ids_spread_over_packers(spark):
    df = spark.createDataFrame([(None, f"text {i % 4000} of some words") for i in range(8000)] + [(None, "one text")] * 4000, SCHEMA).repartition(7)
    packed = packing.packed_documents(df, tokenizer_path(), docs_per_packer=1500, keep_ids=False)
    dealt = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 36)).count().collect()]
    assert len(dealt) == 8 and sum(dealt) == 12_000 and max(dealt) < 2 * min(dealt)


def test_packing_agrees_for_any_partitions(spark, tmp_path):
    rows = [(None if i % 3 else i, f"text {i % 50} " * (1 + i % 9)) for i in range(900)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    both = [sorted(map(repr, packing.packed_documents(d, tokenizer_path(), docs_per_packer=200, keep_ids=False).collect())) for d in (df, df.repartition(5, "text"))]
    assert both[0] == both[1]
