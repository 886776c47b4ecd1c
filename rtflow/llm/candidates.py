"""Finding candidates with regular expressions, and scoring them with tree ensembles of ``pyspark.ml``."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtflow.llm.common import kept

#: Characters kept before and after a candidate.
CONTEXT = 24

_KIND = "array<struct<start:int,end:int,said:string,before:string,after:string>>"

#: Numbers that are added up in a row before their sums are.
BLOCK = 256


def _once(value: Column, then) -> Column:
    """``then(value)``: as an element of an array a value is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(numbers: Column) -> Column:
    """The running sums of an array. Appending copies an array, so it is done within blocks."""

    def sums(values: Column) -> Column:
        step = lambda out, x: F.concat(out, F.array(F.coalesce(F.get(out, F.size(out) - 1), F.lit(0)) + x))
        return F.aggregate(values, F.array().cast("array<int>"), step)

    def shifted(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda block: F.get(block, F.size(block) - 1)))
        moved = lambda block, i, at: F.transform(block, lambda x: x + F.coalesce(F.get(at, i - 1), F.lit(0)))
        return _once(ends, lambda at: F.flatten(F.transform(blocks, lambda block, i: moved(block, i, at))))

    def blocked(values: Column) -> Column:
        n = F.floor((F.size(values) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda b: sums(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))

    return _once(numbers, lambda values: _once(blocked(values), shifted))


def matches(text: Column, pattern: str, needs: str | None = None, across: bool = False) -> Column:
    """All leftmost matches without overlap: ``start``, ``end`` (code points, end exclusive), ``said``,
    and up to ``CONTEXT`` characters ``before`` and ``after``, which end at the next match; ``before``
    goes on into the match before if ``across``, for which matches have ``CONTEXT / 2`` characters or more.

    What stands between matches gives the places: a text is its pieces and matches in turn, and where
    one ends is a running sum. Texts without ``needs`` (a plain string) have none and are not searched.
    ``pattern`` has no capturing groups and matches no empty string.
    """
    none = F.array().cast(_KIND)

    def placed(all_: Column) -> Column:
        found, pieces, ends = all_["found"], all_["pieces"], all_["ends"]

        def one(said: Column, i: Column) -> Column:
            before = F.get(pieces, i)
            if across:
                near = [F.get(found, i - 2), F.get(pieces, i - 1), F.get(found, i - 1)]
                before = F.concat(*[F.coalesce(x, F.lit("")) for x in near], before)
            return F.struct(
                (F.get(ends, i) - F.length(said)).alias("start"),
                F.get(ends, i).alias("end"),
                said.alias("said"),
                F.right(before, F.lit(CONTEXT)).alias("before"),
                F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("after"),
            )

        return F.transform(found, one)

    def ended(two: Column) -> Column:
        lengths = F.zip_with(two["found"], F.slice(two["pieces"], F.lit(1), F.size(two["found"])), lambda x, y: F.length(x) + F.length(y))
        return F.struct(two["found"].alias("found"), two["pieces"].alias("pieces"), _running(lengths).alias("ends"))

    def searched(found: Column) -> Column:
        two = F.struct(found.alias("found"), F.split(text, pattern).alias("pieces"))
        return F.when(F.size(found) > 0, _once(two, lambda x: _once(ended(x), placed))).otherwise(none)

    some = _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), searched)
    return some if needs is None else F.when(F.contains(text, F.lit(needs)), some).otherwise(none)


def share(text: Column, pattern: str) -> Column:
    """The share of a text's characters that match a pattern of single characters."""
    return 1 - F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


#: A row of several equal candidates is given to an estimator so many times at most, with weights for the rest.
COPIES = 8


def _shares(sizes: dict, sample: int) -> dict:
    """How many rows of each group to take: all of small groups, and the rest evenly of the others."""
    out, left = {}, sample
    for k, (group, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], str(x[0])))):
        out[group] = min(n, left // (len(sizes) - k))
        left -= out[group]
    return out


def trained(estimator, rows: DataFrame, features: list[str], sample: int, by: tuple[str, ...] = ()):
    """A model of at most ``sample`` different rows with a ``label`` of 0 or 1; None if the table lacks a label.

    Rows are drawn by label and the columns ``by`` (of few values), those with the least hashes. A row
    weighs as many candidates as are equal to it, and a group's rows together as many as the group has.
    """
    rows = rows.where("label is not null").select(*[F.col(b).cast("double").alias(f"by_{b}") for b in by], F.col("label").cast("double").alias("label"), *[F.col(f).cast("double") for f in features])
    groups = ["label", *[f"by_{b}" for b in by]]
    different = kept(rows.groupBy(*groups, *features).agg(F.count(F.lit(1)).alias("copies")))
    all_ = {tuple(r[g] for g in groups): (r["n"], r["total"]) for r in different.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("total")).collect()}
    if len({g[0] for g in all_}) < 2:
        return None
    parts = []
    for group, n in _shares({g: n for g, (n, _) in all_.items()}, sample).items():
        mine = different
        for name, value in zip(groups, group, strict=True):
            mine = mine.where(F.col(name).eqNullSafe(F.lit(value)))
        mine = mine.orderBy(F.xxhash64(*features), *features).limit(n)
        parts.append(mine.withColumns({"group": F.lit(len(parts)), "of": F.lit(float(all_[group][1]))}))
    chosen = kept(reduce(DataFrame.union, parts))
    taken = chosen.groupBy("group").agg(F.sum("copies").alias("taken"))  # a row for each group
    chosen = chosen.join(F.broadcast(taken), "group")
    times = F.least("copies", F.lit(COPIES)).cast("int")
    chosen = chosen.withColumn("weight", F.col("copies") * F.col("of") / F.col("taken") / times)
    chosen = chosen.withColumn("time", F.explode(F.sequence(F.lit(1), times))).orderBy(F.xxhash64(*features, "label", "time"))
    vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(kept(chosen))
    return estimator.setWeightCol("weight").fit(vectors)


def scored(model, rows: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    """``rows`` with the model's probability of label 1."""
    numbers = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    others = [c for c in rows.columns if c not in features]
    vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows.select(*others, *numbers))
    out = model.transform(vectors).withColumn(name, vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")
