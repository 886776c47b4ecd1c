"""Sharding by jump consistent hashing.

A key and the number of shards decide the shard; there is no ring table. When shards are appended,
a key either stays or moves into one of the new shards, and only the necessary fraction moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtflow.llm.common import free_name, text_of

#: Fixed value: the multiplier of the published generator (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757
#: Draws that nearly all keys need at most; the rest take as many more as there are shards.
USUAL_DRAWS = 40
#: Slots are counted within so many parts of a shard, so that no task has to hold a whole shard.
PARTS = 4096

_LOW, _TOP = (1 << 22) - 1, (1 << 20) - 1


def _draw(state: Column, shards: int) -> Column:
    """One step of the jump: the generator's next number, and the bucket it jumps to.

    The 64 bits of the generator are kept in limbs of 22, 22 and 20 bits: products of limbs fit a
    BIGINT, so nothing overflows whatever ``spark.sql.ansi.enabled`` is.
    """
    m0, m1, m2 = MULTIPLIER & _LOW, (MULTIPLIER >> 22) & _LOW, MULTIPLIER >> 44
    a, b, c = state["a"], state["b"], state["c"]
    p0 = a * m0 + 1
    p1 = a * m1 + b * m0 + F.shiftright(p0, 22)
    p2 = a * m2 + b * m1 + c * m0 + F.shiftright(p1, 22)
    na, nb, nc = p0.bitwiseAND(_LOW), p1.bitwiseAND(_LOW), p2.bitwiseAND(_TOP)
    high = F.shiftleft(nc, 11) + F.shiftright(nb, 11) + 1  # the upper 31 bits, and one
    jump = F.floor((state["next"] + 1).cast("double") * (float(1 << 31) / high.cast("double")))
    moved = F.struct(
        state["next"].alias("at"), jump.cast("bigint").alias("next"), na.alias("a"), nb.alias("b"), nc.alias("c")
    )
    return F.when(state["next"] < shards, moved).otherwise(state)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of a 64-bit key."""
    if shards < 1:
        raise ValueError("there must be a shard")
    start = F.struct(
        F.lit(-1).cast("bigint").alias("at"),
        F.lit(0).cast("bigint").alias("next"),
        key.bitwiseAND(_LOW).alias("a"),
        F.shiftrightunsigned(key, 22).bitwiseAND(_LOW).alias("b"),
        F.shiftrightunsigned(key, 44).bitwiseAND(_TOP).alias("c"),
    )

    def draws(state: Column, most: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, lambda s, _: _draw(s, shards))

    if shards <= USUAL_DRAWS:  # each draw goes at least one bucket on
        return draws(start, shards)["at"].cast("int")
    first = draws(start, USUAL_DRAWS)
    more = F.when(first["next"] >= shards, first).otherwise(draws(first, shards))
    return more["at"].cast("int")


def with_shard(df: DataFrame, keys: list[str], shards: int, name: str = "shard") -> DataFrame:
    """``df`` and the shard of each row, from the values of ``keys`` alone.

    No shuffle. A null key is a value like any other and has a shard of its own choosing; rows with
    equal keys share a shard. A clashing column ``name`` is replaced.
    """
    return df.withColumn(name, jump_hash(F.xxhash64(*[F.col(k) for k in keys]), shards))


def with_slots(df: DataFrame, order: list[str], shard: str = "shard", name: str = "slot") -> DataFrame:
    """``df`` and each row's place in its shard: 0, 1, 2 and so on without gaps.

    Rows are numbered within ``PARTS`` parts of each shard, dealt by a hash of the columns in
    ``order``, and each part starts where those before it end. The table of starts has at most
    ``shards * PARTS`` rows whatever the input, so it is broadcast. Reruns agree, as rows that
    tie in all of ``order`` can be told apart by nothing that is numbered. Columns in ``order``
    should be few and narrow: ``df`` is read twice.
    """
    part, offset = free_name(df, "part", "offset")
    dealt = df.withColumn(part, F.pmod(F.xxhash64(F.lit(1), *[F.col(c) for c in order]), F.lit(PARTS)).cast("int"))
    sizes = dealt.groupBy(shard, part).agg(F.count(F.lit(1)).alias("n"))
    frame = "sum(n) over (partition by {s} order by {p} rows between unbounded preceding and current row) - n"
    starts = sizes.select(
        F.col(shard).alias("s_"), F.col(part).alias("p_"), F.expr(frame.format(s=shard, p=part)).alias(offset)
    )
    same = (F.col(shard) == F.col("s_")) & (F.col(part) == F.col("p_"))
    over = f"row_number() over (partition by {shard}, {part} order by {', '.join(order)}) - 1"
    return (
        dealt.withColumn(name, F.expr(over).cast("bigint"))
        .join(F.broadcast(starts), same)
        .withColumn(name, F.col(name) + F.col(offset))
        .drop(part, offset, "s_", "p_")
    )


def op7_sharding(spark, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents in shards 0 to 23 by the law ``key``, and where one more shard would take them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_of()) + 8).cast("bigint").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    sharded = with_shard(with_shard(rows, ["doc_id"], shards), ["doc_id"], shards + 1, "grown_shard")
    return with_slots(sharded, ["doc_id", "text_crc32", "size"])
