"""Every operator over empty tables, nulls, repeated rows, ties and extra columns whose names clash."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trawl.llm import language, lookalike, mixing, mojibake, neardup, neighbours, queries, sentences, splitting, tokens

def clash():
    """Columns that bear the names of what operators make."""
    return {c: F.lit("x") for c in ("rep", "print", "shingles", "keys", "a", "b", "rank", "ids", "n_tokens", "copy_no", "boundary", "piece_no", "run", "kind", "field", "vkey", "seg_no")}



def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values, 1)), "id long, text string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "id long, text string, heading string, page int, line_start int")


def test_empty_tables(spark, empty):
    names = spark.createDataFrame([("general", 2)], "namespace string, dimensions int")
    vectors = spark.createDataFrame([], "id long, namespace string, vector array<float>")
    assert neighbours.similar_pairs(vectors, names).count() == 0
    assert neighbours.neighbours(vectors, names, every=100).count() == 0
    assert splitting.split_oversized(empty).count() == 0
    labels = spark.createDataFrame([], "chunk_id long, lang string")
    assert language.relabel(empty, labels).count() == 0
    members, links = neardup.near_duplicates(empty)
    assert neardup.linked_rows(members, links).count() == 0 and neardup.grouped(members, links).count() == 0
    values = spark.createDataFrame([], "field string, id long, value string")
    assert lookalike.look_alikes(values).count() == 0 and lookalike.normalised(values).count() == 0
    assert mojibake.garbled(values).count() == 0 and mojibake.restored(values).count() == 0
    documents = spark.createDataFrame([], "doc_id long, text string, source string")
    assert tokens.encode_corpus(documents).count() == 0
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    made, report = mixing.mix(documents, targets)
    assert made.count() == 0 and report.first()["actual_share"] is None
    assert mixing.mix(documents, targets.where("false"))[1].count() == 0
    assert sentences.sentence_spans(documents).count() == 0


def test_nulls_blanks_repeats_and_clashes(spark):
    t = texts(spark, [None, "", " \n", "one two three", "one two three"]).unionByName(spark.createDataFrame([(None, "null id text"), (4, "one two three")], "id long, text string"))
    t = t.withColumns(clash()).withColumns({"heading": F.lit(None).cast("string"), "page": F.lit(1), "line_start": F.lit(None).cast("int")})
    assert splitting.split_oversized(t).count() == 0
    members, links = neardup.near_duplicates(t, words=2, threshold=0.5)
    assert rows(members) == [(4, 4), (5, 4)] and links.count() == 0
    assert rows(neardup.grouped(members, links)) == [(4, 4, 2), (5, 4, 2)]
    assert rows(neardup.near_duplicate_groups(t, words=2, threshold=0.5)) == [(4, 4, 2), (5, 4, 2)]
    values = t.select(F.lit("chunk_text").alias("field"), "id", F.col("text").alias("value"), "rep", "run")
    assert lookalike.look_alikes(values).count() == 0 and mojibake.garbled(values).count() == 0
    got = tokens.encode_corpus(t.withColumnRenamed("id", "doc_id"))
    assert got.count() == 7 and sorted(len(r["ids"]) for r in got.collect()) == [0, 0, 2, 3, 3, 3, 3]
    assert rows(sentences.sentence_spans(t, "id")) == sorted([(4, 0, 13)] * 2 + [(5, 0, 13), (None, 0, 12)], key=repr)


def test_unknown_and_unusable_vectors(spark):
    names = spark.createDataFrame([("g", 2, "x"), ("g", 2, "x")], "namespace string, dimensions int, metric string")
    nan, inf = float("nan"), float("inf")
    data = [(1, "g", [1.0, 0.0]), (2, "g", [2.0, 0.01]), (3, "g", [0.0, 0.0]), (4, "g", [nan, 1.0]), (5, "g", [inf, 1.0]), (6, "g", [1.0]), (7, "g", None), (8, "h", [1.0, 0.0]),
            (9, None, [1.0, 0.0]), (10, "g", [1.0, None]), (None, "g", [1.0, 0.0]), (1, "g", [1.0, 0.0]), (11, "g", [1.0, 0.0])]
    df = spark.createDataFrame(data, "id long, namespace string, vector array<float>").withColumns(clash()).withColumn("dimensions", F.lit(5))
    assert rows(neighbours.similar_pairs(df, names)) == [(1, 2), (1, 11), (2, 11)] or rows(neighbours.similar_pairs(df, names)) == [(1, 11), (1, 2), (2, 11)]


def test_queries_with_sql(spark, data):
    from tests.test_sql import compare

    for name, sql in queries.oracle_sql().items():
        compare(spark, data, queries.queries()[name], sql)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_run(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.count() >= 0
    columns = {
        "p1_found": [("id_a", "bigint"), ("id_b", "bigint")],
        "p3_found": [("chunk_id", "bigint"), ("seg_no", "int"), ("lang", "string")],
        "p4_found": [("id_a", "bigint"), ("id_b", "bigint")],
        "p5_found": [("field", "string"), ("id_a", "bigint"), ("id_b", "bigint")],
        "p7_found": [("field", "string"), ("id", "bigint")],
        "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p9_found": [("source", "string")],
        "p10_found": [("doc_id", "bigint"), ("start_char", "int"), ("end_char", "int")],
    }
    if name in columns:
        assert df.dtypes == columns[name]
