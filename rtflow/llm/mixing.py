"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / size of the source`` times, a number that is
seldom whole. Its whole part is taken at once. What is left, a probability times the document's
words, is mass: two documents at a time, mass is moved from one to the other, at random but fair,
until one of them has all of its words or none. So sums of words stay as they were, and a source
misses its target by the words of one document at most.

Documents are paired within blocks of bounded size. Each block leaves one document with a fraction at
most; those meet in the next round's blocks, a reduction tree of a few levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtflow.llm.common import SPACE, free_name, kept, text_of, uniform, words_between

#: Weights of the sources in their order, repeating, and the most copies of a document.
WEIGHTS, MOST_COPIES = (5, 2, 1), 3
#: Documents of more than so many times their source's mean size are rounded before the others.
LONG = 4
#: Documents that are paired in one block at most.
BLOCK = 128
SEED = 20_240_601


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(source, source_size)`` with ``target`` added, one row per source.

    Sources by code point, null last, weigh as in ``weights``, repeating, and share all words. A
    target stops at ``most`` times its source's size, and the excess is shared again by weight.
    Sorted by size per weight, the sources that stop are the first ones: source j stops if the words
    are not used up when everyone has the share at which j stops. The table has a row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("rank", F.expr("row_number() over (order by source asc nulls last)")).withColumn("w", w)
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    ranked = ranked.selectExpr(
        "*",
        "sum(cap) over (order by r, rank rows between unbounded preceding and current row) as caps",
        "coalesce(sum(w) over (order by r, rank rows between 1 following and unbounded following), 0D) as others",
        "cast(sum(source_size) over () as double) as words",
    )
    stopped = ranked.withColumn("stops", F.col("caps") + F.col("r") * F.col("others") <= F.col("words"))
    shared = stopped.selectExpr(
        "*",
        "sum(if(stops, cap, 0D)) over () as used",
        "sum(if(stops, 0D, w)) over () as sharing",
    )
    share = F.col("w") * (F.col("words") - F.col("used")) / F.nullif(F.col("sharing"), F.lit(0.0))
    return shared.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(share).alias("target"))


# One step of pivotal rounding. ``s.open`` is the document with a fraction left, ``e`` the next one;
# each has its words ``a`` and its mass ``m``. Mass goes up to the open one by what it lacks or the
# other has, or down by what it has or the other lacks, with odds that leave the means as they are.
_UP, _DOWN = "least(s.open.a - s.open.m, e.m)", "least(s.open.m, e.a - e.m)"
_ITEM = "named_struct('a', {d}.a, 'k1', {d}.k1, 'k2', {d}.k2, 'm', {m}, 'u', {d}.u)"
_DONE = "named_struct('k1', {d}.k1, 'k2', {d}.k2, 'up', {up})"


def _next(open_: str, *done: str) -> str:
    return f"named_struct('open', {open_}, 'done', concat(s.done, array({', '.join(done)})))"


def _item(d: str, m: str) -> str:
    return _ITEM.format(d=d, m=m)


def _done(d: str, up: int) -> str:
    return _DONE.format(d=d, up=up)


_STEP = f"""
case when s.open is null then named_struct('open', e, 'done', s.done)
when e.u * ({_UP} + {_DOWN}) < {_DOWN} then
  case when s.open.a - s.open.m < e.m then {_next(_item("e", "e.m - (s.open.a - s.open.m)"), _done("s.open", 1))}
       when s.open.a - s.open.m > e.m then {_next(_item("s.open", "s.open.m + e.m"), _done("e", 0))}
       else {_next("cast(null as struct<a:double,k1:bigint,k2:bigint,m:double,u:double>)", _done("s.open", 1), _done("e", 0))} end
else
  case when s.open.m < e.a - e.m then {_next(_item("e", "e.m + s.open.m"), _done("s.open", 0))}
       when s.open.m > e.a - e.m then {_next(_item("s.open", "s.open.m - (e.a - e.m)"), _done("e", 1))}
       else {_next("cast(null as struct<a:double,k1:bigint,k2:bigint,m:double,u:double>)", _done("s.open", 0), _done("e", 1))} end
end"""
_FOLD = f"""aggregate(docs,
  named_struct('open', cast(null as struct<a:double,k1:bigint,k2:bigint,m:double,u:double>),
               'done', cast(array() as array<struct<k1:bigint,k2:bigint,up:int>>)),
  (s, e) -> {_STEP})"""


#: Sources whose table is broadcast at most; with more of them the joins shuffle by source.
MOST_BROADCAST = 100_000


def _by_source(table: DataFrame, sources: int) -> DataFrame:
    """A table of one row per source, broadcast while it is small, so that a large source isn't one task."""
    return F.broadcast(table) if sources <= MOST_BROADCAST else table


def _level(open_: DataFrame, level: int, seed: int, block: int, sources: int) -> DataFrame:
    """Pair within blocks: ``(src, result)`` with the decided documents and the one left open."""
    counts = open_.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    dealt = open_.join(_by_source(counts, sources), "src").withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed + level), "k1", "k2"), F.ceil(F.col("n") / block))
    )
    # A bucket has ``block`` documents on average; cut in chunks, no block has more.
    dealt = dealt.withColumn("chunk", F.expr(f"floor((row_number() over (partition by src, bucket order by k1, k2) - 1) / {block})"))
    # Long documents first: what is left open at the end is then a short one more often.
    doc = F.struct("a", "k1", "k2", "m", uniform(F.col("k1"), F.col("k2"), seed=seed + 1000 + level).alias("u"))
    blocks = dealt.groupBy("src", "bucket", "chunk").agg(F.sort_array(F.collect_list(doc), asc=False).alias("docs"))
    return blocks.select("src", F.expr(_FOLD).alias("result"))


def pivotal_copies(units: DataFrame, sources: int, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``(k1, k2, up)``: whether each unit's fraction is rounded up.

    ``units`` are ``(src, k1, k2, a, x)``: source number, key, words (more than 0) and a probability
    strictly between 0 and 1. Each level is written, so lost executors cost one level at most.
    """
    open_ = units.select("src", "k1", "k2", F.col("a").cast("double").alias("a"), (F.col("x") * F.col("a")).alias("m"))
    decided, level = [], 0
    while True:
        done = kept(_level(open_, level, seed, block, sources))
        decided.append(done.select(F.inline("result.done")))
        left = done.where("result.open is not null").select("src", "result.open.*")
        most = left.groupBy("src").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            u = uniform(F.col("k1"), F.col("k2"), seed=seed + 999_983)
            last = left.select("k1", "k2", (u * F.col("a") < F.col("m")).cast("int").alias("up"))
            out = last
            for part in decided:
                out = out.unionByName(part)
            return out
        open_, level = left.select("src", "k1", "k2", "a", "m"), level + 1


def _rounded(units: DataFrame, due: Column, sources: int, seed: int) -> DataFrame:
    """``units`` with ``copies``, ``due`` rounded so that the words of each source's units stay as due."""
    units = units.withColumn("due", due).withColumn("whole", F.floor(F.col("due") + 1e-9))
    units = units.withColumn("x", F.col("due") - F.col("whole"))
    open_ = units.where((F.col("size") > 0) & (F.col("x") > 1e-9))
    ups = pivotal_copies(open_.select("src", "k1", "k2", F.col("size").alias("a"), "x"), sources, seed)
    out = units.join(ups, ["k1", "k2"], "left").withColumn("copies", F.col("whole") + F.coalesce("up", F.lit(0)))
    return out.drop("due", "whole", "x", "up")


def mixed_copies(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Copies for rows ``(k1, k2, source, size, *others)``; ``k1, k2`` tell different rows apart.

    Adds ``n`` (rows that share all values), ``source_size``, ``target`` and ``copies``, how often
    they are taken in all. Equal rows are one unit, however many there are: they get the whole part
    of what they are due together, and their fraction enters the rounding as one document's.

    Documents of more than ``LONG`` times their source's mean are rounded first, and what they take
    too much or too little is made up for by the others, so a source misses its target by no more
    than one of those.
    """
    units = kept(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))
    words = F.col("size") * F.col("n")
    sizes = units.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum("n").alias("rows"))
    targets = source_targets(sizes.select("source", "source_size")).withColumnRenamed("source", "of")
    numbered = F.expr("row_number() over (order by source asc nulls last)")
    targets = targets.join(sizes.select("source", "rows"), F.col("of").eqNullSafe(F.col("source")))
    targets = kept(targets.withColumn("src", numbered).drop("source"))
    sources = targets.count()
    units = units.join(_by_source(targets, sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    long = F.col("size") * F.col("rows") > LONG * F.col("source_size")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    first = kept(_rounded(units.where(long), share * F.col("n"), sources, seed))
    used = first.groupBy("src").agg(F.sum(words).alias("their_size"), F.sum(F.col("size") * F.col("copies")).alias("their_words"))
    rest = units.where(~long).join(_by_source(used, sources), "src", "left").fillna(0, ["their_size", "their_words"])
    left = (F.col("target") - F.col("their_words")) / F.nullif(F.col("source_size") - F.col("their_size"), F.lit(0))
    left = F.greatest(F.lit(0.0), F.least(F.coalesce(left, F.lit(0.0)), F.lit(float(MOST_COPIES))))
    each = F.when(F.col("their_size") > 0, left).otherwise(share)
    then = _rounded(rest, each * F.col("n"), sources, seed + 7).drop("their_size", "their_words")
    return first.unionByName(then).drop("src", "rows")


def copies_of_row(place: Column, copies: Column, n: Column) -> Column:
    """The share of row ``place`` (from 0) in the copies of ``n`` equal rows: shares differ by one at most."""
    return (F.floor((place + 1) * copies / n) - F.floor(place * copies / n)).cast("bigint")


def _keys(docs: DataFrame) -> list[Column]:
    columns = [F.col(c) for c in docs.columns]
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(17), *columns).alias("k2")]


def _size(name: str = "text") -> Column:
    return F.size(words_between(text_of(name), SPACE)).cast("bigint")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: documents of ``docs`` with their columns, as often as they are taken.

    A null text has no words, and documents without words are left out unless whole copies are due
    to them; a null source is a source; equal rows share their copies evenly. An empty table stays
    empty.
    """
    k1, k2, n_, all_, place = free_name(docs, "k1", "k2", "n_rows", "n_copies", "place")
    rows = docs.select(*_keys(docs), "source", _size().alias("size"))
    # A key of a row is found again by its hashes, so only they and two numbers meet the texts.
    copies = kept(mixed_copies(rows, seed).where("copies > 0").select(
        F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("n").alias(n_), F.col("copies").alias(all_)
    ))
    columns = [F.col(c) for c in docs.columns]
    keyed = docs.withColumn(k1, F.xxhash64(*columns)).withColumn(k2, F.xxhash64(F.lit(17), *columns))
    joined = keyed.join(copies, [k1, k2])
    numbered = joined.withColumn(place, F.expr(f"row_number() over (partition by {k1}, {k2} order by {n_}) - 1"))
    share = copies_of_row(F.col(place), F.col(all_), F.col(n_))
    taken = numbered.where(share > 0).withColumn(place, F.explode(F.sequence(F.lit(1).cast("bigint"), share)))
    return taken.select(*docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(*_keys(docs), "doc_id", "source", _size().alias("size"))
    units = mixed_copies(rows)
    each = units.withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    taken = F.col("size") * copies_of_row(F.col("place"), F.col("copies"), F.col("n"))
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
