"""Benchmark decontamination: find the passages of benchmark items in training documents.

Items are cut into windows of 13 words (an item of fewer words is one window). Documents are scanned
with rolling codes of as many words; a window whose code is a benchmark window's is a hit once its
words have been compared. While the benchmark has at most ``MOST_WINDOWS`` windows, they are
broadcast as a hash set. Beyond that, only a bitmap of fixed size is broadcast, and what passes it is
joined with the table of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rtflow.llm.common import free_name
from rtflow.llm.pywords import ALNUM, coded, lowered, said, windows

WINDOW = 13
#: Windows that are broadcast at most, about 760 bytes each in each Python worker (190 MB in all).
MOST_WINDOWS = 250_000
#: log2 of the bits of the bitmap that stands for a larger benchmark: 16 MB.
BITMAP_BITS = 27

_ITEM_WINDOWS = "array<struct<length:int,code:bigint,words:string>>"
_HITS = "struct<n_words:bigint,starts:array<int>,lengths:array<int>,items:array<string>>"
_FOUND = "struct<n_words:bigint,hits:array<struct<start:int,length:int,code:bigint,words:string>>>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each item's each window: ``item`` (text), ``length``, ``code``, ``words``.

    Items without words, or with a null text, have none. A null id is the empty text.
    """

    @arrow_udf(_ITEM_WINDOWS)
    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            codes, *at = coded(data := lowered(text), ALNUM)
            n = min(window, len(codes))
            hashes = windows(codes, n).view(np.int64).tolist() if n else []
            rows.append([{"length": n, "code": h, "words": said(data, *at, i, n)} for i, h in enumerate(hashes)])
        return pa.array(rows, pa.list_(pa.struct([("length", pa.int32()), ("code", pa.int64()), ("words", pa.string())])))

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return benchmark.select(item, F.inline(cut("text"))).distinct()


def _scanner(by_length: dict[int, np.ndarray]):
    """A function from a document's words to the starts, lengths and codes of windows in the sets."""
    sets = []
    for length, codes in sorted(by_length.items()):
        table = np.zeros(1 << 20, bool)
        table[codes >> np.uint64(44)] = True
        sets.append((length, np.sort(codes), table))

    def scan(codes: np.ndarray) -> list[tuple[int, int, int]]:
        out = []
        for length, known, table in sets:
            h = windows(codes, length)
            at = np.flatnonzero(table[h >> np.uint64(44)])
            if len(at):
                got = h[at]
                place = np.minimum(np.searchsorted(known, got), len(known) - 1)
                at = at[known[place] == got]
                out += [(int(i), length, int(h[i])) for i in at]
        return out

    return scan


def _spans(docs: DataFrame, benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """``docs`` and ``_hits``: per document its words, and starts, lengths and items of the hits."""
    spark = docs.sparkSession
    table = benchmark_windows(benchmark, window)
    some = table.limit(most + 1).collect()
    if len(some) > most:
        return _spans_by_join(docs, table, window)
    known: dict[tuple[int, int], dict[str, set[str]]] = {}
    for row in some:
        known.setdefault((row["length"], row["code"] & (2**64 - 1)), {}).setdefault(row["words"], set()).add(row["item"])
    shared = spark.sparkContext.broadcast(known)

    @arrow_udf(_HITS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        lengths = {length for length, _ in known}
        scan = _scanner({x: np.array([c for n, c in known if n == x], np.uint64) for x in lengths})
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("starts", pa.list_(pa.int32())),
                ("lengths", pa.list_(pa.int32())),
                ("items", pa.list_(pa.string())),
            ]
        )
        for texts in batches:
            rows = []
            for text in texts:
                codes, *at = coded(data := lowered(text.as_py()), ALNUM)
                hits, items = [], set()
                for start, length, code in scan(codes):
                    of = known[length, code].get(said(data, *at, start, length))
                    if of:
                        hits.append((start, length))
                        items |= of
                hits.sort()
                rows.append(
                    {
                        "n_words": len(codes),
                        "starts": [h[0] for h in hits],
                        "lengths": [h[1] for h in hits],
                        "items": sorted(items),
                    }
                )
            yield pa.array(rows, kind)

    return docs.withColumn("_hits", find("text"))


def _spans_by_join(docs: DataFrame, table: DataFrame, window: int) -> DataFrame:
    """The same for a benchmark of any size: a bitmap sorts out, a join decides."""
    spark = docs.sparkSession
    bits = table.select(F.pmod("code", F.lit(1 << BITMAP_BITS)).alias("bit"))
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    )
    lengths = [r[0] for r in table.select("length").distinct().collect()]  # at most one for each size up to the window
    bitmap = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for row in parts.toLocalIterator():  # a bitmap of fixed size in all
        size, at = len(row["bits"]), (row["bucket"] - 1) * 4096
        end = min(at + size, len(bitmap))
        bitmap[at:end] = np.frombuffer(row["bits"], np.uint8)[: end - at]
    # bucket 0 of Spark holds bit 0 alone, counted from 1 in the next buckets
    shared = spark.sparkContext.broadcast((lengths, bitmap))

    @arrow_udf(_FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lengths, bitmap = shared.value
        hit = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("code", pa.int64()), ("words", pa.string())])
        kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(hit))])
        for texts in batches:
            rows = []
            for text in texts:
                codes, *at = coded(data := lowered(text.as_py()), ALNUM)
                hits = []
                for length in lengths:
                    h = windows(codes, length)
                    bit = (h & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
                    for i in np.flatnonzero(_tested(bitmap, bit)).tolist():
                        code = int(h[i : i + 1].view(np.int64)[0])
                        hits.append({"start": i, "length": length, "code": code, "words": said(data, *at, i, length)})
                rows.append({"n_words": len(codes), "hits": hits})
            yield pa.array(rows, kind)

    # A row is known by two hashes of all its columns: rows that share both are the same and hit alike.
    k1, k2, found = free_name(docs, "k1", "k2", "found")
    columns = [F.col(c) for c in docs.columns]
    scanned = docs.withColumn(k1, F.xxhash64(*columns)).withColumn(k2, F.xxhash64(F.lit(7), *columns))
    scanned = scanned.withColumn(found, find("text"))
    hits = scanned.select(k1, k2, F.inline(f"{found}.hits"))
    of = hits.join(table, ["length", "code", "words"]).groupBy(k1, k2)
    place = F.collect_set(F.struct("start", F.col("length"))).alias("places_")
    gathered = of.agg(F.sort_array(place).alias("places_"), F.sort_array(F.collect_set("item")).alias("items_"))
    whole = scanned.join(gathered, [k1, k2], "left")
    none = F.array().cast("array<int>")
    return whole.select(
        *docs.columns,
        F.struct(
            F.col(found)["n_words"].alias("n_words"),
            F.coalesce(F.col("places_.start"), none).alias("starts"),
            F.coalesce(F.col("places_.length"), none).alias("lengths"),
            F.coalesce("items_", F.array().cast("array<string>")).alias("items"),
        ).alias("_hits"),
    )


def _tested(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Whether Spark's bitmap aggregate has set each bit (bit b is position (b - 1) % 32768 of its bucket; 0 is its own)."""
    at = np.where(bit > 0, bit - 1, 0)
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) | (bit == 0)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items``, ``spans`` and ``contaminated``.

    ``spans`` are ``{start, end}`` in words, end exclusive, merged where they touch; ``n_hit`` is the
    number of words in them and ``items`` the sorted ids of the items they come from. A document is
    contaminated when at least a twentieth of its words are hit. A null or empty text has no words
    and is not contaminated; repeated rows are judged alike; columns of these names are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "items", "spans", "contaminated", "_hits")
    found = _spans(docs, benchmark, window, most_windows)
    # Hits come sorted by start, so a span goes on while the next hit starts before its end.
    merged = F.expr(
        """aggregate(arrays_zip(_hits.starts, _hits.lengths),
             cast(array() as array<struct<start:int,end:int>>),
             (s, h) -> if(size(s) > 0 and h.starts <= element_at(s, -1).end,
               concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).start as start,
                 greatest(element_at(s, -1).end, h.starts + h.lengths) as end))),
               concat(s, array(struct(h.starts as start, h.starts + h.lengths as end)))))"""
    )
    out = found.withColumn("spans", merged)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    out = out.withColumn("n_words", F.col("_hits.n_words")).withColumn("n_hit", hit).withColumn("items", F.col("_hits.items"))
    rule = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.withColumn("contaminated", rule).drop("_hits")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    helper = free_name(docs, "text_of_document")[0]
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias(helper)
    found = find_contamination(docs.select(whole, "text"), benchmark)
    return found.where(~F.col("contaminated")).select(f"{helper}.*")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document's words in benchmark windows, by the contract's rule of contamination."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
