"""The pipeline as a whole, and its stages on rows that share ids."""

import random
from collections import Counter

import pytest
from conftest_llm import ODD, SCHEMA

import corpus_pipeline
from rtflow.llm import near_join

COPY = "a text of more than five words that several rows have in common"


def left(spark, table, schema="doc_id bigint, text string"):
    return Counter(map(tuple, near_join.without_near_copies(spark.createDataFrame(table, schema), 5, 80).collect()))


def test_a_text_stays_whose_id_a_copy_shares(spark):
    other = COPY.replace("text", "note").replace("rows", "lines").replace("five", "six").replace("common", "store")
    assert left(spark, [(1, COPY), (1, other), (0, COPY)]) == Counter([(0, COPY), (1, other)])
    assert left(spark, [(None, COPY), (None, COPY), (3, COPY), (None, other)]) == Counter([(3, COPY), (None, other)])
    assert left(spark, [(None, COPY), (None, COPY)]) == Counter([(None, COPY)])
    assert left(spark, [(2, COPY)] * 3 + [(4, other)] * 2) == Counter([(2, COPY), (4, other)])
    # Of equal rows but for other columns one stays; rows without shingles are no copies of each other.
    some = left(spark, [(2, COPY, "x"), (2, COPY, "y"), (2, None, "x"), (2, None, "x"), (5, "", "z")], "doc_id bigint, text string, rid string")
    assert some in (Counter([(2, COPY, c), (2, None, "x"), (2, None, "x"), (5, "", "z")]) for c in "xy")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(30, 90))) for _ in range(60)]
    passage = " ".join(f"item{i}" for i in range(40))
    docs = [(i, x, "en", f"s{i % 3}", len(x), "clash", 7, None) for i, x in enumerate(texts)]
    docs += [(100 + i, texts[i], "en", "s0", 0, "clash", 7, None) for i in range(10)]  # copies
    docs += [(200, passage, "en", "s1", 0, "clash", 7, None), (3, "another text with an id that is taken by one above", "en", "s1", 0, "c", 7, None)]
    docs += [(*row[:5], "clash", 7, None) for row in ODD]
    root = tmp_path_factory.mktemp("pipeline")
    schema = SCHEMA + ", score string, shard int, component_id string"
    spark.createDataFrame(docs, schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([("b", passage), ("n", None)], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), docs, schema


def test_pipeline(spark, folder):
    root, docs, _ = folder
    out = corpus_pipeline.run(spark, root)
    rows = out.collect()
    assert out.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "score", "shard"]
    texts = {r.text for r in rows}
    assert {r.doc_id for r in rows} <= {d[0] for d in docs}
    # No label is toxic, so only copies, contaminated texts and what the mix leaves out go.
    assert docs[70][1] not in texts and not any(100 <= (r.doc_id or 0) < 110 for r in rows)
    # Reruns agree, and every stage hands on the columns of its input.
    assert Counter(map(str, rows)) == Counter(map(str, corpus_pipeline.run(spark, root).collect()))
    table = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, root).columns == table.columns, name


def test_pipeline_of_nothing(spark, folder, tmp_path):
    root, _, schema = folder
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
