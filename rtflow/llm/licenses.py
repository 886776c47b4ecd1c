"""License scans by diagonal voting.

The rolling codes of all pairs of neighbouring words are joined with the places of the same pairs in
license templates. A hit votes for the diagonal "place in the document minus place in the template".
Votes are counted by diagonal, diagonals that lie close together are merged (a word more or less
inside a notice shifts the rest by one), and a span stands if enough of its template has voted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rtflow.llm.common import NO_WORD, NO_WORD_ANY_CASE, free_name, kept, names_besides, text_of, words_between

#: Phrases whose every place counts, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices that the method knows besides, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("under the terms of the eclipse public license", "epl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
)
#: Share of a notice's pairs of words that must vote.
COVER = 0.8
#: Diagonals at most so far apart are merged.
SLACK = 2


def lowered(text: Column) -> Column:
    """Lower case, in which words of ASCII are as if only A-Z had been changed.

    The Kelvin sign is the one character beyond ASCII whose lower case is ASCII, so it is replaced.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))


def templates(spark: SparkSession) -> DataFrame:
    """``(code, template, at, said)``: each pair of words in each template; a table of fixed, small size."""
    rows = []
    for number, (phrase, _) in enumerate(BASE + NOTICES):
        said = phrase.split()
        rows += [(number, at, said[at], said[at + 1]) for at in range(len(said) - 1)]
    table = spark.createDataFrame(rows, "template int, at int, one string, two string")
    return table.select(F.xxhash64("one", "two").alias("code"), "template", "at", F.struct("one", "two").alias("said"))


def _facts(spark: SparkSession) -> DataFrame:
    rows = [(i, label, len(phrase.split()) - 1, i < len(BASE)) for i, (phrase, label) in enumerate(BASE + NOTICES)]
    return spark.createDataFrame(rows, "template int, label string, pairs int, base boolean")


def license_spans(docs: DataFrame, key: list[str]) -> DataFrame:
    """``key`` columns, ``label, base, first, last, cover``: spans in words from 0, both ends included.

    Base phrases are found exactly (all their pairs on one diagonal), notices from a cover of
    ``COVER`` on. Rows that share a key and a text have their spans once. A null or empty text, or
    one of a single word, has none.
    """
    spark = docs.sparkSession
    words = docs.select(*key, words_between(lowered(text_of()), NO_WORD).alias("words"))
    two = F.transform("words", lambda x, i: F.struct(x.alias("one"), F.get("words", i + 1).alias("two")))
    pairs = words.select(*key, F.posexplode(two).alias("place", "pair"))
    pairs = pairs.withColumn("code", F.xxhash64("pair.one", "pair.two"))
    # Codes find the places, and the words themselves verify them.
    same = (F.col("pair.one") == F.col("said.one")) & (F.col("pair.two") == F.col("said.two"))
    hits = pairs.join(F.broadcast(templates(spark)), "code").where(same)
    by = [*key, "template"]
    votes = hits.groupBy(*by, (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.count_distinct("at").alias("votes"), F.min("place").alias("first"), (F.max("place") + 1).alias("last"), F.collect_set("at").alias("ats")
    )
    order = f"over (partition by {', '.join(by)} order by diagonal)"
    far = F.expr(f"coalesce(diagonal - lag(diagonal) {order} > {SLACK}, true)")
    votes = votes.join(F.broadcast(_facts(spark)), "template").withColumn("far", (far | F.col("base")).cast("int"))
    bands = votes.withColumn("band", F.expr(f"sum(far) {order}"))
    spans = bands.groupBy(*by, "band", "label", "base", "pairs").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("voted"),
        F.bool_or(F.array_contains("ats", F.col("pairs") - 1)).alias("ended"),
    )
    # A notice that lacks its last pair lacks what tells it from others, such as the version.
    cover = F.when(F.col("ended"), F.col("voted") / F.col("pairs")).otherwise(F.col("voted") / (2 * F.col("pairs"))).alias("cover")
    return spans.select(*key, "label", "base", "first", "last", cover)


def license_report(docs: DataFrame, *keep: str) -> DataFrame:
    """Each row's columns ``keep`` with what ``license_spans`` finds in its text, in place of columns so called.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` (places of base phrases, null if none);
    ``base_labels`` and ``labels`` (distinct, sorted, joined by commas, empty if none); ``score``, the
    best cover of any template; ``spans``, those that stand. Rows are kept apart by two hashes of
    ``keep`` and the text; equal rows get equal reports.
    """
    k1, k2 = free_name(docs, "k1", "k2")
    same = [F.col(c) for c in dict.fromkeys([*keep, "text"])]
    keyed = docs.withColumn(k1, F.xxhash64(*same)).withColumn(k2, F.xxhash64(F.lit(3), *same))
    spans = license_spans(keyed, [k1, k2])
    stands = F.col("cover") >= F.when(F.col("base"), 1.0).otherwise(COVER)
    base = stands & F.col("base")
    found = spans.groupBy(k1, k2).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(stands, F.col("label")))), ",").alias("labels"),
        F.max("cover").alias("score"),
        F.sort_array(F.collect_list(F.when(stands, F.struct("first", "last", "label")))).alias("spans"),
    )
    results = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    counted = keyed.select(*names_besides(list(keep), results), k1, k2, F.size(words_between(text_of(), NO_WORD_ANY_CASE)).cast("bigint").alias("n_words"))
    out = counted.join(kept(found), [k1, k2], "left").drop(k1, k2)
    return out.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})


def op2_license_scans(spark, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_report(docs, "doc_id").drop("spans")
