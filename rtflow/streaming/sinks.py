"""Output: rows as JSON records, to topics or to directories of files."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from rtflow.functions.time import time2str
from rtflow.schema import EVENT_TIME, WINDOW


def encode_json(df: DataFrame, offset_hours: int = 0) -> DataFrame:
    """One column ``value`` with each row as a JSON object.

    ``event_time`` is written as text, any other timestamp as epoch milliseconds, and null fields
    are left out.
    """
    fields = []
    for field in df.schema.fields:
        if field.name == WINDOW:
            continue
        column = F.col(f"`{field.name}`")
        if field.name == EVENT_TIME:
            column = time2str(column, offset_hours)
        elif isinstance(field.dataType, T.TimestampType):
            column = F.unix_millis(column)
        fields.append(column.alias(field.name))
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def _kafka_options(options: Mapping, topic: str) -> dict:
    if "kafka.bootstrap.servers" not in options:
        raise ValueError(f"topic {topic!r}: option kafka.bootstrap.servers is missing")
    return {**options, "topic": topic}


def topic_writer(df: DataFrame, topic: str, options: Mapping, offset_hours: int = 0) -> DataStreamWriter:
    """Append a streaming table to a Kafka topic (at least once)."""
    writer = encode_json(df, offset_hours).writeStream.outputMode("append")
    return writer.format("kafka").options(**_kafka_options(options, topic))


def write_topic(df: DataFrame, topic: str, options: Mapping, offset_hours: int = 0) -> None:
    """Append a batch table to a Kafka topic."""
    encode_json(df, offset_hours).write.format("kafka").options(**_kafka_options(options, topic)).save()


def file_writer(df: DataFrame, path: str, fmt: str = "json", offset_hours: int = 0) -> DataStreamWriter:
    """Append a streaming table to a directory (exactly once): JSON records, or typed columns."""
    if fmt == "json":
        return encode_json(df, offset_hours).writeStream.outputMode("append").format("text").option("path", path)
    visible = df.drop(WINDOW) if WINDOW in df.columns else df
    return visible.writeStream.outputMode("append").format(fmt).option("path", path)


def storage_writer(
    df: DataFrame, storages: Mapping, options: Mapping | None = None, offset_hours: int = 0
) -> DataStreamWriter | None:
    """A writer to the first storage there is, ``kafka`` or ``files``; ``None`` if there is neither."""
    if storages.get("kafka"):
        return topic_writer(df, storages["kafka"]["topic"], options or {}, offset_hours)
    if storages.get("files"):
        files = storages["files"]
        return file_writer(df, files["path"], files.get("format", "json"), offset_hours)
    return None


# Fan-out --------------------------------------------------------------------------------------
#
# A job's output goes to its table, for the jobs that read it, and to its sink, in one query. Spark
# promises that a batch that is run again has its number and its rows. The rest is made idempotent by
# the number: files are staged, and once the stage is whole its files, and no others, become the batch.


class Folder:
    """A folder to which each numbered batch is added once, whatever is run again and wherever it broke off.

    ``writer`` tells apart those that number batches on their own, such as queries with different
    checkpoints that write to one folder.
    """

    def __init__(self, spark: SparkSession, path: str, writer: str):
        self.spark, self.root = spark, path.rstrip("/")
        self.tag = hashlib.sha256(writer.encode()).hexdigest()[:12]

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, batch: str) -> bool:
        """Whether the whole batch is in the folder."""
        return self._fs().exists(self._path("_batches", f"{self.tag}-{batch}"))

    def mark(self, batch: str) -> None:
        """Note that a batch is done that has no files here, such as one sent to a topic."""
        self._fs().mkdirs(self._path("_batches"))
        self._fs().create(self._path("_batches", f"{self.tag}-{batch}"), True).close()

    def add(self, df: DataFrame, batch: str, fmt: str) -> None:
        """Add a batch. Readers see no file of it before all of them are written."""
        if self.has(batch):
            return
        fs, name = self._fs(), f"{self.tag}-{batch}"
        staged, whole = self._path("_staged", name), self._path("_staged", name, "_SUCCESS")
        if not fs.exists(whole):
            df.write.mode("overwrite").format(fmt).save(f"{self.root}/_staged/{name}")
        # From here on the stage is not written again: who goes on after a break moves what is left.
        for status in fs.listStatus(staged):
            file = status.getPath().getName()
            if not file.startswith(("_", ".")) and not fs.rename(status.getPath(), self._path(f"{name}-{file}")):
                raise OSError(f"cannot move {status.getPath()} to {self.root}")
        self.mark(batch)
        fs.delete(staged, True)

    def read(self, batch: str, schema: T.StructType, fmt: str) -> DataFrame:
        """The rows of a batch that has been added."""
        found = self._fs().globStatus(self._path(f"{self.tag}-{batch}-*"))
        paths = [status.getPath().toString() for status in found or []]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(fmt).load(paths)


def check_storages(name: str, storages: Mapping, options: Mapping) -> None:
    """Refuse a topic without servers before anything runs."""
    if storages.get("kafka"):
        _kafka_options(options, storages["kafka"]["topic"])


def store(
    df: DataFrame, storages: Mapping, options: Mapping, writer: str, batch: str, marks: str, offset_hours: int = 0
) -> None:
    """Write one batch of an output to the first storage there is, once.

    A topic gets a batch again if the run breaks between sending it and noting that in ``marks``.
    """
    spark = df.sparkSession
    if storages.get("kafka"):
        sent = Folder(spark, marks, writer)
        if not sent.has(batch):
            write_topic(df, storages["kafka"]["topic"], options, offset_hours)
            sent.mark(batch)
    elif storages.get("files"):
        files = storages["files"]
        fmt = files.get("format", "json")
        records = encode_json(df, offset_hours) if fmt == "json" else df
        Folder(spark, files["path"], writer).add(records, batch, "text" if fmt == "json" else fmt)


def fan_out(
    df: DataFrame, table: str, storages: Mapping, options: Mapping, checkpoint: str, offset_hours: int = 0
) -> DataStreamWriter:
    """Write a stream to the parquet folder ``table`` and to its storage, in one query.

    What goes to the storage is read from the table, so the stream's plan runs once for each batch and
    both hold the same rows. ``checkpoint`` is the query's, which numbers the batches.
    """
    schema = df.schema

    def write(batch: DataFrame, number: int) -> None:
        own = Folder(batch.sparkSession, table, checkpoint)
        name = f"{number:010d}"
        own.add(batch, name, "parquet")
        if storages:
            store(own.read(name, schema, "parquet"), storages, options, checkpoint, name, f"{checkpoint}-sent", offset_hours)

    return df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
