"""Operators on wide ids, repeated rows, very long texts and clashing names, against brute force."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from rtflow.llm import fingerprints, licenses, line_dedup, pii, secrets
from rtflow.llm.candidates import matches

BIG = 1 << 60


def _hash_of(spark, texts):
    table = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").alias("h"))
    return {r["text"]: r["h"] for r in table.collect()}


@pytest.mark.parametrize("kind", ["bigint", "string", "int", "double", "decimal(30,2)", "date"])
def test_fingerprints_of_any_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    rng = random.Random(5)
    numbers = [i // 3 if i % 5 else i for i in range(300)] + [None] * 20  # repeated and null ids
    docs = [(n, "".join(rng.choices("ab é\n", k=rng.randrange(30)))) for n in numbers] + [(7, "equal")] * 30
    df = spark.createDataFrame(docs, "n bigint, text string")
    number = {"bigint": F.col("n") + F.lit(BIG), "date": F.date_add(F.lit("2020-01-01"), F.col("n").cast("int"))}.get(kind, F.col("n"))
    df = df.select(number.cast(kind).alias("doc_id"), "text", F.lit(1).alias("n_chars"), F.lit(2).alias("bucket"))
    ties = _hash_of(spark, {t for _, t in docs})
    rows = sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0 if kind not in ("string", "date") else str(r["doc_id"]), ties[r["text"]]))
    wanted = []
    for row, after in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(row["text"]) // 2
        new = row["text"][: len(row["text"]) - half] + after["text"][:half]
        wanted.append((str(row["doc_id"]), len(row["text"]), hashlib.sha256(new.encode()).hexdigest()))
    got = fingerprints.fingerprints(df.repartition(6))
    assert got.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got.collect()) == sorted(wanted)


def test_many_ids_and_a_null(spark):
    docs = [(BIG + i, f"text {i} {zlib.crc32(str(i).encode())}") for i in range(3000)] + [(None, "no id")]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    rows = docs[-1:] + docs[:-1]
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        assert got[key] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_likeness_of_long_texts():
    def counts(text):  # all 16-byte strings, unbounded
        out = {}
        for at in range(len(text) - 15):
            out[text[at : at + 16]] = out.get(text[at : at + 16], 0) + 1
        return out

    def cosine(a, b):
        dot = sum(n * b.get(g, 0) for g, n in a.items())
        return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5

    words = random.Random(1).choices(["alpha ", "beta ", "gamma ", "delta "], k=6000)
    for one, two in [("a" * 40_000, "a" * 20_000 + "b" * 20_000), ("".join(words), "".join(words[:3000]) + "x" * 15_000), ("a" * 70_000, "c" * 70_000)]:
        near = fingerprints.likeness(fingerprints.fingerprint(one), fingerprints.fingerprint(two))
        assert abs(near - cosine(counts(one), counts(two))) < 0.15


def _few_lines(rng, words):
    return "\n".join(" ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n)) for n in words)


def test_equal_rows_are_one_document(spark):
    shared = _few_lines(random.Random(0), (22, 18))
    docs = [(1, shared), (2, shared)]
    schema = "doc_id bigint, text string"
    for times in (1, 2):
        out = line_dedup.without_repeated_lines(spark.createDataFrame(docs * times, schema))
        assert [list(r.gone_lines) for r in out.collect()] == [[], []] * times
    long = _few_lines(random.Random(1), (30, 21, 2))
    docs = [(1, long), (2, long + "\nmore"), (3, "own\n" + long), (None, "null id\n" + shared), (5, None), (6, "")]
    seen = set()
    for times in (1, 3):
        df = spark.createDataFrame(docs * times, schema).repartition(5).withColumn("n_lines", F.lit("x"))
        got = sorted(((r.doc_id or 0, r.text or "", tuple(r.gone_lines)) for r in line_dedup.without_repeated_lines(df).collect()))
        assert len(got) == len(docs) * times
        seen.add(tuple(sorted(set(got))))
        assert set(got) >= {(1, long, ()), (2, "more", (0, 1, 2)), (3, "own", (1, 2, 3)), (5, "", ())}
    assert len(seen) == 1


def test_texts_of_many_lines(spark):
    text = "\n".join(f"line {i} of many" for i in range(40_000))
    out = line_dedup.without_repeated_lines(spark.createDataFrame([(1, text), (2, text + "\nend")], "doc_id bigint, text string"))
    start = time.time()
    got = {r.doc_id: (r.n_lines, len(r.gone_lines), r.text) for r in out.collect()}
    assert got == {1: (40_000, 0, text), 2: (40_001, 40_000, "end")} and time.time() - start < 20


def test_marks_hold_all_keys(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k1"))
    rows = spark.range(200_000).select(F.xxhash64("id").alias("k"), "id")
    marked = line_dedup._marked(rows, keys, "k", "mark")
    assert marked.where("id < 5000 and mark").count() == 5000
    assert marked.where("id >= 5000 and mark").count() < 1000
    assert not line_dedup._marked(rows, keys.limit(0), "k", "mark").where("mark").count()


def _plain(text, pattern, across):
    """Matches of a pattern without possessive parts, by Python's own search."""
    out, last = [], 0
    found = list(re.finditer(pattern, text))
    for i, m in enumerate(found):
        after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
        out.append((m.start(), m.end(), m.group(), text[0 if across else last : m.start()][-24:], after[:24]))
        last = m.end()
    return out


@pytest.mark.parametrize("across", [False, True])
def test_matches_are_placed(spark, across):
    pattern = "[0-9a-f]{16,}" if across else "[0-9]+"
    rng = random.Random(2)
    texts = ["", "no", "7" * 30, None] + ["".join(rng.choice(["é😀", "x y ", "123", "9" * 17, " ", "long words between them all "]) for _ in range(n)) for n in (1, 5, 60, 3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = df.select("id", matches(F.coalesce("text", F.lit("")), pattern, across=across).alias("m")).collect()
    for r in got:
        assert [tuple(m) for m in r.m] == _plain(texts[r.id] or "", pattern, across)


def test_time_of_one_text_of_many_numbers(spark):
    text = " ".join(str(i % 9973) for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "a 1")], "id int, text string")
    df.select(F.size(pii.base_spans(F.col("text")))).collect()
    start = time.time()
    got = dict(df.select("id", F.size(matches(F.col("text"), "[0-9]+"))).collect())
    df.select(F.size(pii.base_spans(F.col("text")))).collect()
    assert got == {1: 100_000, 2: 1} and time.time() - start < 10


def test_results_replace_columns_of_their_names(spark):
    text = "MIT License. mail a.b@example.org token: ghp_" + "a1B2" * 9
    df = spark.createDataFrame([(1, text, "x")], "doc_id bigint, text string, score string")
    for name in ("Spans", "base", "n_candidates", "secrets", "labels", "N_WORDS", "row_", "a.b"):
        df = df.withColumn(name, F.lit("old"))
    found = secrets.find_secrets(df)
    assert found.columns == ["doc_id", "Spans", "base", "labels", "N_WORDS", "row_", "a.b", "n_candidates", "secrets", "score"]
    assert found.first()["n_candidates"] == 1
    found = pii.find_pii(df)
    assert found.columns == ["doc_id", "score", "n_candidates", "secrets", "labels", "N_WORDS", "row_", "a.b", "base", "spans"]
    assert len(found.first()["base"]) == 1
    found = licenses.license_report(df, "doc_id", "score", "Spans", "N_WORDS", "row_")
    row = found.first()
    assert len(found.columns) == len({c.lower() for c in found.columns}) and (row["labels"], row["row_"], row["score"]) == ("mit", "old", 1.0)
    only = df.select("text")
    assert [secrets.find_secrets(only).count(), pii.find_pii(only).count(), licenses.license_report(only).count()] == [1, 1, 1]
