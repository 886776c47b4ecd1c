"""Line dedup: delete later copies of runs of lines, found by distributed prefix doubling.

A document is the sequence of its lines that are not blank, each line a letter. Prefix doubling names
the suffixes by their first 1, 2, 4 and so on lines: the name for 2n lines joins the name here with
the name n lines further on. Suffixes whose name occurs once are sorted already and leave the
doubling, so its tables shrink to what is repeated. Suffixes that share a name form an interval of
common prefixes; runs of a length between two powers are named by two overlapping names. In each
interval the earliest copy stays, and the lines of the others go.

A run goes if it is long in lines or in words. Whatever is repeated within a later copy is a later
copy itself, so the shortest runs that are long enough cover the lines of all longer ones, and
doubling ends at ``min_lines``: maximal runs would delete the same lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtflow.llm.common import SPACE, free_name, kept, released, text_of, words_between

#: A run is deleted from this many lines on, or from so many words in all its lines together.
MIN_LINES, MIN_WORDS = 3, 50
#: Keys of rows that lose lines are marked in so many words of 64 bits, which are broadcast.
MARKS = 1 << 18


def _lines() -> Column:
    """The lines with something in them."""
    return F.filter(F.split(text_of(), "\n"), lambda x: F.trim(x) != "")


def _repeated(names: DataFrame) -> DataFrame:
    """The suffixes whose name occurs more than once. Counts are partly added up before the shuffle."""
    often = names.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("n1", "n2")
    return names.join(often, ["n1", "n2"], "left_semi")


def _joined(names: DataFrame, ahead: int) -> DataFrame:
    """Each suffix's name joined with the one ``ahead`` lines further on, if that is repeated as well."""
    frame = f"over (partition by k1, k2 order by i range between {ahead} following and {ahead} following)"
    both = names.withColumn("m1", F.expr(f"max(n1) {frame}")).withColumn("m2", F.expr(f"max(n2) {frame}"))
    # All places in between are there if the whole run is repeated, and else the run leaves the doubling.
    front = f"sum(words) over (partition by k1, k2 order by i range between current row and {ahead - 1} following)"
    both = both.withColumn("total", F.expr(f"{front} + max(total) {frame}")).where("m1 is not null")
    new = [F.xxhash64("n1", "m1", F.lit(ahead)).alias("n1"), F.xxhash64(F.lit(ahead), "n2", "m2").alias("n2")]
    return both.select("k1", "k2", "order", "i", *new, "words", "total")


def _later(names: DataFrame) -> DataFrame:
    """Of repeated suffixes ``(k1, k2, order, i, n1, n2)`` those that are not the earliest of their name."""
    place = F.struct("order", "k1", "k2", "i")
    first = names.groupBy("n1", "n2").agg(F.min(place).alias("first"))
    return names.join(first, ["n1", "n2"]).where(place > F.col("first")).select("k1", "k2", "i")


def repeated_lines(keyed: DataFrame, order: str, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(k1, k2, gone)``: the places, from 0 among lines not blank, of lines to delete.

    ``keyed`` has ``k1, k2`` for each different row. Copies come in the order of ``order`` (null
    first), then of the keys; rows with equal keys are one document and count once. The result is
    written (see ``kept``).
    """
    lines = keyed.select("k1", "k2", F.col(order).alias("order"), F.posexplode(_lines()).alias("i", "line"))
    words = F.size(words_between(F.col("line"), SPACE)).cast("bigint")
    letters = lines.select(
        "k1", "k2", "order", "i", F.xxhash64("line").alias("n1"), F.xxhash64(F.lit(1), "line").alias("n2"),
        words.alias("words"), words.alias("total"),
    )
    # Lines of equal rows are the same places, which the map side makes one before they are dealt out.
    names, length, found = kept(_repeated(letters).distinct()), 1, []
    tables = [names]
    for run in range(1, min_lines + 1):
        now = names if run == 1 else kept(_repeated(_joined(names, run - length)))
        tables.append(now)
        long = now if run == min_lines else now.where(F.col("total") >= min_words)
        found.append(_later(long).select("k1", "k2", "i", F.lit(run).alias("run")))
        if run == 2 * length:
            names, length = now, run
    gone = reduce(DataFrame.union, found)
    each = gone.select("k1", "k2", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("run") - 1)).alias("i"))
    out = kept(each.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("i")).alias("gone")))
    released(*tables)
    return out


def _marked(rows: DataFrame, keys: DataFrame, key: str, mark: str) -> DataFrame:
    """``rows`` with ``mark``: false where ``key`` is surely none of ``keys``' ``k1``.

    The marks are a table of at most ``MARKS`` rows, so it may be broadcast whatever the input.
    """
    word = F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(MARKS - 1))
    bit = lambda name: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(name).bitwiseAND(F.lit(63)).cast("int"))
    at, bits = free_name(rows, "at", "bits")
    marks = keys.select(F.shiftrightunsigned("k1", 6).bitwiseAND(F.lit(MARKS - 1)).alias(at), bit("k1").alias(bits))
    marks = marks.groupBy(at).agg(F.bit_or(bits).alias(bits))
    both = rows.withColumn(at, word).join(F.broadcast(marks), at, "left")
    return both.withColumn(mark, F.coalesce(F.col(bits).bitwiseAND(bit(key)) != 0, F.lit(False))).drop(at, bits)


def without_repeated_lines(docs: DataFrame, order: str = "doc_id", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines that repeat earlier runs taken out of ``text``.

    Adds ``n_lines`` (not blank) and ``gone_lines`` (their places), in place of columns so called. A text that loses nothing stays as
    it is; one that loses lines loses blank ones too. A null text stays null and has no lines. Rows
    equal in all columns are one document and lose the same lines.
    """
    k1, k2, gone, mark = free_name(docs, "k1", "k2", "gone", "mark")
    columns = [F.col(c) for c in docs.columns]
    keyed = docs.withColumn(k1, F.xxhash64(*columns)).withColumn(k2, F.xxhash64(F.lit(23), *columns))
    slim = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(order).alias(order), "text")
    found = repeated_lines(slim, order, min_lines, min_words)
    marked = _marked(keyed, found, k1, mark)
    # Only texts that lose lines are shuffled, at every size.
    found = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(gone))
    losing = marked.where(F.col(mark)).join(found.hint("merge"), [k1, k2], "left")
    whole = marked.where(~F.col(mark)).withColumn(gone, F.lit(None).cast("array<int>")).unionByName(losing).drop(mark)

    def without(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    # As an element of an array a text's lines are split once.
    stay = F.element_at(F.transform(F.array(_lines()), without), 1)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(stay)
    none = F.array().cast("array<int>")
    out = whole.withColumn("n_lines", F.size(_lines())).withColumn("gone_lines", F.coalesce(F.col(gone), none))
    return out.withColumn("text", text).drop(k1, k2, gone)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without later copies of runs of lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = without_repeated_lines(docs)
    return out.select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.size("gone_lines").cast("bigint").alias("n_gone"),
        F.array_join(F.transform("gone_lines", lambda i: i.cast("string")), ",").alias("gone_lines"),
        F.sha2(text_of(), 256).alias("text_sha256"),
    )
