"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

A paragraph (what stands between line feeds) is hashed to a wide vector of 32-bit lanes; a text's
fingerprint is the sum of its paragraphs' vectors modulo 2**32. The order of paragraphs does not
matter, and adding or subtracting a vector inserts or deletes a paragraph without reading the rest.

The first ``EXACT`` lanes come from BLAKE2b of the paragraph and tell texts apart. The other ``SENSE``
lanes are a signed count sketch of the 16-byte strings in the paragraph (of the whole paragraph if it
is shorter); sketches add up as well, and their cosine is the likeness of two texts.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rtflow.llm.common import text_of
from rtflow.llm.pywords import mixed

EXACT, SENSE = 16, 256
GRAM = 16
#: Bytes that are hashed at a time, so that a very long text takes bounded memory.
CHUNK = 1 << 20
_P = 0x100000001B3
_NEWLINE = 10


def fingerprint(text: str) -> np.ndarray:
    """The ``EXACT + SENSE`` lanes of a text, as unsigned 32-bit numbers.

    A sketch lane holds a count, which no text is long enough to bring beyond 31 bits.
    """
    data = text.encode("utf-8", "surrogatepass")
    exact = np.zeros(EXACT, np.uint64)
    short = []
    digests = []
    for paragraph in data.split(b"\n"):
        digest = hashlib.blake2b(paragraph, digest_size=4 * EXACT).digest()
        digests.append(digest)
        if 0 < len(paragraph) < GRAM:
            short.append(digest[:8])
        if len(digests) >= 4096:
            exact += np.frombuffer(b"".join(digests), np.uint32).reshape(-1, EXACT).sum(0, np.uint64)
            digests = []
    if digests:
        exact += np.frombuffer(b"".join(digests), np.uint32).reshape(-1, EXACT).sum(0, np.uint64)
    counts = np.bincount(np.frombuffer(b"".join(short), np.uint64).astype(np.int64) & 511, minlength=512)
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(raw) - GRAM + 1), CHUNK):
        counts += _grams(raw[at : at + CHUNK + GRAM - 1])
    sense = counts[0::2] - counts[1::2]
    return np.concatenate([exact.astype(np.uint32), sense.astype(np.int64).astype(np.uint32)])


def _grams(raw: np.ndarray) -> np.ndarray:
    """Counts by lane and sign of the 16-byte strings that lie within one paragraph."""
    h, step = raw.astype(np.uint64) + np.uint64(1), 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(_P, step, 1 << 64)) + h[step:]
        step *= 2
    breaks = raw == _NEWLINE
    if breaks.any():
        before = np.concatenate([[0], np.cumsum(breaks, dtype=np.int32)])
        h = h[before[GRAM:] == before[:-GRAM]]
    return np.bincount((mixed(h) >> np.uint64(55)).astype(np.int64), minlength=512)


def combined(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """``a`` with the paragraphs of ``b`` inserted, or deleted with sign -1."""
    return a + b if sign > 0 else a - b


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the cosine of the sketches, 0 at least."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a[EXACT:].view(np.int32).astype(np.float64), b[EXACT:].view(np.int32).astype(np.float64)
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


def as_text(lanes: np.ndarray) -> str:
    return base64.b64encode(lanes.astype("<u4").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Fixed value: rows a bucket has on average, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 1000, 20_000

_OUT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rank(key, tie: int) -> tuple:
    """What Python compares as Spark orders a key and a tie: nulls first, not-a-number last."""
    if key is None:
        return (0, 0, tie)
    return (2, 0, tie) if key != key else (1, key, tie)


def in_order(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows ``(bucket, extra, key, tie, text)``: buckets hold successive ranges of key and tie.

    A bucket's ``extra`` rows are those that follow its last row: the first of the next bucket, or
    after the last bucket the first of all. So each row's successor is in its own bucket and one
    shuffle of the texts does. The ranges are those Spark deals keys and ties to, without the texts;
    only their first rows' keys and ties come to the driver, ``MOST_BUCKETS`` at most. The key may
    be of any type that Spark sorts and Python compares. Nulls sort first; the tie is a hash of the
    text, so rows that share an id are dealt to several buckets unless their texts are equal too.
    """
    rows = docs.select(F.col(key).alias("key"), text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    buckets = max(1, min(MOST_BUCKETS, rows.count() // BUCKET_ROWS))
    slim = rows.select("key", "tie").repartitionByRange(buckets, "key", "tie")
    firsts = slim.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "tie")).alias("first"))
    starts = sorted({_rank(*r["first"]) for r in firsts.collect()})
    shared = docs.sparkSession.sparkContext.broadcast(starts)

    @F.arrow_udf("array<int>")
    def places(keys: pa.Array, ties: pa.Array) -> pa.Array:
        starts, out = shared.value, []
        for row in zip(keys.to_pylist(), ties.to_pylist(), strict=True):
            rank = _rank(*row)
            b = bisect_right(starts, rank) - 1
            # A row that starts bucket b also follows bucket b - 1, or the last one: -b, or -n, says so.
            out.append([b, -(b or len(starts))] if bisect_left(starts, rank) == b else [b])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = rows.withColumn("at", F.explode(places("key", "tie")))
    dealt = dealt.withColumn("bucket", F.when(F.col("at") < 0, -F.col("at") - 1).otherwise(F.col("at")))
    return dealt.withColumn("extra", (F.col("at") < 0).cast("int")).drop("at")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Go through the rows of successive buckets, each row meeting the one after it."""
    names = ["doc_id", *(x.split(" ")[0] for x in _OUT.split(", "))]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list[tuple] = []
    bucket = held = None

    def done() -> pa.RecordBatch:
        columns = list(map(pa.array, zip(*out, strict=True), kinds))
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    def meet(one: tuple, two: tuple) -> None:
        key, text, lanes = one
        new = edited(text, two[1])
        new_lanes = fingerprint(new)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        near = likeness(lanes, new_lanes), likeness(lanes, two[2])
        out.append((key, len(text), sha, as_text(lanes), as_text(new_lanes), *near))

    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = [batch.schema.field("key").type, *kinds[-6:]]
        at = {name: batch.column(name) for name in ("bucket", "key", "text")}
        for i in range(batch.num_rows):
            b = at["bucket"][i].as_py()
            if b != bucket:
                bucket, held = b, None
            elif held is None:
                continue  # further rows that follow the bucket
            extra = batch.column("extra")[i].as_py()
            text = at["text"][i].as_py()
            row = (at["key"][i].as_py(), text, fingerprint(text))
            if held is not None:
                meet(held, row)
            held = None if extra else row
            if len(out) >= 512:
                yield done()
    if out:
        yield done()


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, and how like it is its edited text's and the next document's.

    A null text is empty. Rows with equal ids follow each other in the order of a hash of their
    texts, null ids come first, and the only row of a table follows itself. ``doc_id`` keeps its type.
    Other columns of ``docs`` are neither needed nor returned.
    """
    rows = in_order(docs).repartition("bucket").sortWithinPartitions("bucket", "extra", "key", "tie")
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(_OUT).fields])
    return rows.select("bucket", "extra", "key", "text").mapInArrow(_compared, out)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
