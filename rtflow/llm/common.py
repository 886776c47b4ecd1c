"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands between words of the contract's alphanumeric kind (digits, letters, everything
#: beyond ASCII), after A-Z is lowered and before; and between words that white space separates.
#: Splitting is several times cheaper than extracting all words.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def words_between(text: Column, breaks: str) -> Column:
    """The words of a text, given what stands between them."""
    return F.array_remove(F.split(text, breaks), "")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that all executors reach, deleted when the session's JVM ends.

    It lies in ``spark.checkpoint.dir``. Only a local-mode session, whose executors are this very
    machine, may go without that setting.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/rtflow-llm-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read from there.

    It cuts the lineage: what follows neither repeats the work when it reads the table twice nor
    needs any executor that wrote it.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rtflow_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete tables of ``kept`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_rtflow_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def names_besides(columns: list[str], results: tuple[str, ...]) -> list[str]:
    """The columns that are not called like results, which replace them, whatever the case."""
    return [c for c in columns if c.lower() not in results]


def uniform(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns' values and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


#: Salts that rows of a hot key are dealt to when they look something up.
SALTS = 60


def salt_of(*names: str) -> Column:
    """The salt of a row, from the values of its columns."""
    return F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int")


def salt_bits(salt: str) -> Column:
    """Aggregate: which salts occur, a bit for each."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(salt)))


def salted_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A left join of ``rows`` (with ``salt``) to ``table`` (one row per key, with ``salts``) by key and salt.

    A row of ``table`` is repeated for those salts that rows with its key have, so a hot key is in
    ``SALTS`` places and a rare one in as many as it has rows, at most.
    """
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    found = F.filter(every, lambda s: F.expr("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), s)) != 0)
    return rows.join(table.withColumn("salt", F.explode(found)).drop("salts"), [key, "salt"], "left")
