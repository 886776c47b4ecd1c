"""Alignment of two tokenizers' tokens over a corpus, each distinct text once.

Texts are shuffled by their whole content, so each distinct one is encoded by both tokenizers and aligned
in one place, however many documents have it. Its pairs of linked token ids then count with the number of
its documents, and its measures are joined to the documents' ids.

Tokens are told by the bytes they stand for. Between two successive ends of tokens, of either tokenizer,
lies one token of each: one link. Ends that both have cut the text into groups.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtflow.llm.common import kept, released, salt_bits, salt_of, salted_lookup

#: The most id pairs whose counts are broadcast at a time, as two arrays of 8 bytes and one of 1. More
#: pairs are taken in several passes over the aligned texts; the ids bound their number.
MOST_PAIRS = 2_000_000
#: Code points of texts that are encoded together.
BATCH = 1 << 18


@dataclass(frozen=True)
class Tokenizers:
    """Where the vocabulary files lie: in the same place on all executors."""

    byte_level: str
    pieces: str
    #: how the byte-level tokenizer splits text before it merges; without it, its own library does all texts
    pattern: str | None = None

    @classmethod
    def public(cls) -> Tokenizers:
        import public_tokenizers as public

        return cls(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN)


#: Texts with these go the slow way: characters that libraries may class differently, as they are younger
#: than the libraries' tables, and runs so long that merging by ranks, which is quadratic in them, is slower.
_SLOW = re.compile(r"[^\x00-\u07ff]|\s{500}|\S{500}")


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others as 256 and up in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, files: Tokenizers):
        import os

        # One thread each: Spark has a task on every core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(files.byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
        self.fast = self._by_ranks(files)
        table = _byte_of_character()
        size = self.a.get_vocab_size()
        pieces = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(map(table.get, p)) if all(c in table for c in p) else p.encode() for p in pieces]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        # An id with what follows it in the text form of groups: by tokenizer, within and at the end of a group.
        sides = [(size, ","), (size, "|"), (len(pieces), ","), (len(pieces), ";")]
        self.text = np.array([f"{i}{end}" for n, end in sides for i in range(n)], object)
        self.a_bytes, self.b_bytes = np.array(self.a_bytes, object), np.array(self.b_bytes, object)

    @staticmethod
    def _by_ranks(files: Tokenizers):
        """The same vocabulary for a library that is several times as fast, if ids rise with the order of merges.

        Where they do, merging the pair with the least id first is merging in the vocabulary's order.
        """
        import json
        from pathlib import Path

        import tiktoken

        model = json.loads(Path(files.byte_level).read_text(encoding="utf-8"))["model"]
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if files.pattern is None or merged != sorted(merged) or (merged and merged[0] < 256):
            return None
        table = _byte_of_character()
        ranks = {bytes(map(table.get, p)): i for p, i in model["vocab"].items() if i < 256 or i <= merged[-1]}
        return tiktoken.Encoding("own", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})

    def _byte_level(self, spaced: list[str]) -> list[np.ndarray]:
        slow = [i for i, x in enumerate(spaced) if self.fast is None or _SLOW.search(x)]
        out = dict(zip(slow, (x.ids for x in self.a.encode_batch_fast([spaced[i] for i in slow], add_special_tokens=False)), strict=True))
        return [np.array(out[i] if i in out else self.fast.encode_ordinary(x), np.int64) for i, x in enumerate(spaced)]

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        spaced = [" " + x for x in texts]
        for x, a, b in zip(spaced, self._byte_level(spaced), self.b.encode(texts, num_threads=1), strict=True):
            b = np.array(b, np.int64)
            yield (a, b) if self._whole(x, a, b) else (a[:0], b[:0])

    def _whole(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether both tokenizers' tokens are the bytes of the text."""
        data = text.encode("utf-8", "surrogatepass")
        if not len(data) == self.a_length[a].sum() == self.b_length[b].sum():
            return False
        return b"".join(self.a_bytes[a].tolist()) == data == b"".join(self.b_bytes[b].tolist())


@dataclass
class Aligned:
    n_groups: int
    #: the ids of each link, in no order
    a: np.ndarray
    b: np.ndarray
    #: ``a1,a2|b1;a3|b2,b3``
    groups: str


def align(encoder: Encoder, a: np.ndarray, b: np.ndarray) -> Aligned:
    """Line up the tokens of a text, given both tokenizers' ids."""
    if not len(a):
        return Aligned(0, a, b, "")
    ends_a, ends_b = np.cumsum(encoder.a_length[a]), np.cumsum(encoder.b_length[b])
    # The first token of the other side that ends no earlier; all tokens of both end at the text's end.
    beside_a, beside_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    last_a, last_b = ends_b[beside_a] == ends_a, ends_a[beside_b] == ends_b
    # A link ends where a token of either side does: those of a, and those of b that end inside one of a.
    inside = ~last_b
    ids_a = np.concatenate([a, a[beside_b[inside]]])
    ids_b = np.concatenate([b[beside_a], b[inside]])
    # Tokens in the order of groups, those of the first tokenizer first: each after all before it.
    shared_a, shared_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    size_a, size_b = len(encoder.a_length), len(encoder.b_length)
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.concatenate([[0], shared_b + 1])[group_a]] = a + size_a * last_a
    out[np.arange(len(b)) + (shared_a + 1)[group_b]] = 2 * size_a + b + size_b * last_b
    groups = "".join(encoder.text[out].tolist())[:-1]
    return Aligned(len(shared_a), ids_a, ids_b, groups)


_TEXTS = "key binary, salts bigint, n bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def _aligner(files: Tokenizers) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(key, salts, n, text)`` to those of ``_TEXTS``: ids linked in a text, and how often there."""
    kinds = [pa.binary(), *[pa.int64()] * 6, pa.string(), *[pa.list_(pa.int32())] * 3]
    schema = pa.schema(list(zip([x.split(" ")[0] for x in _TEXTS.split(", ")], kinds, strict=True)))

    def run(batches):
        encoder = Encoder(files)

        def done(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for (key, salts, n, _), (a, b) in zip(rows, encoder.encoded([r[3] for r in rows]), strict=True):
                found = align(encoder, a, b)
                codes, times = np.unique(found.a << 32 | found.b, return_counts=True)
                sha = hashlib.sha256(found.groups.encode()).hexdigest() if len(a) else ""
                ids = [(codes >> 32).astype(np.int32), (codes & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32)]
                out.append((key, salts, n, len(a), len(b), found.n_groups, len(found.a), sha, *ids))
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema)

        rows, size = [], 0
        for batch in batches:
            columns = [batch.column(name) for name in ("key", "salts", "n", "text")]
            for i in range(batch.num_rows):
                rows.append(tuple(c[i].as_py() for c in columns))
                size += len(rows[-1][3])
                if size >= BATCH:
                    yield done(rows)
                    rows, size = [], 0
        if rows:
            yield done(rows)

    return run


def aligned_texts(docs: DataFrame, files: Tokenizers, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row of ``_TEXTS`` per distinct text that is neither null nor empty, written.

    ``n`` is the number of its documents, and ``salts`` says which of their salts occur.
    """
    texts = docs.where(F.octet_length(text) > 0).select(F.col(text).alias("text"), salt_of(id_column).alias("salt"))
    distinct = texts.groupBy("text").agg(F.count("*").alias("n"), salt_bits("salt").alias("salts"))
    keyed = distinct.select(_key("text").alias("key"), "salts", "n", "text")
    return kept(keyed.mapInArrow(_aligner(files), _TEXTS))


def _key(text: str):
    return F.unhex(F.sha2(text, 256))


def pair_counts(texts: DataFrame) -> DataFrame:
    """``a, b, count, best``: in how many documents two ids are linked, and whether that is the most for ``a``.

    There are as many rows as pairs of ids occur, so at most the product of the vocabularies.
    """
    pairs = texts.select("n", F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("count"))
    pairs = kept(pairs)
    most = pairs.groupBy("a").agg(F.max("count").alias("most"))
    return kept(pairs.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")))


def _measures(texts: DataFrame, pairs: DataFrame, most_pairs: int) -> DataFrame:
    """``key, n_best, count_sum`` by text: its links looked up among the counts, a bounded part of them at a time."""
    spark = texts.sparkSession
    passes = max(1, -(-pairs.count() // most_pairs))
    out = None
    for i in range(passes):
        part = pairs if passes == 1 else pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == i)
        table = part.select((F.shiftleft(F.col("a").cast("bigint"), 32) + F.col("b")).alias("code"), "count", "best").toArrow()
        codes = table.column("code").to_numpy()
        order = np.argsort(codes)
        shared = spark.sparkContext.broadcast(
            (codes[order], table.column("count").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False)[order])
        )
        found = texts.select("key", "a", "b", "times").mapInArrow(_looker(shared), "key binary, n_best bigint, count_sum bigint")
        out = found if out is None else out.unionByName(found)
    if passes > 1:
        out = out.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def _looker(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        codes, counts, best = shared.value
        for batch in batches:
            lists = {name: batch.column(name) for name in ("a", "b", "times")}
            a, b, times = (lists[name].flatten().to_numpy().astype(np.int64) for name in lists)
            wanted = a << 32 | b
            at = np.minimum(np.searchsorted(codes, wanted), max(0, len(codes) - 1))
            there = codes[at] == wanted if len(codes) else np.zeros(len(wanted), bool)
            lengths = np.diff(lists["a"].offsets.to_numpy())
            text = np.repeat(np.arange(batch.num_rows), lengths)[there]
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, text, (times[there] * best[at[there]]))
            np.add.at(count_sum, text, times[there] * counts[at[there]])
            yield pa.record_batch([batch.column("key"), pa.array(n_best), pa.array(count_sum)], ["key", "n_best", "count_sum"])

    return run


def alignments(docs: DataFrame, files: Tokenizers | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per document the measures of its text's alignment, with the corpus-wide counts of its links.

    Texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens:
    zeros, and an empty digest. Each row is a document, so repeated rows count and come repeatedly; null
    ids are like any others. Other columns are not read. An empty table has no rows.
    """
    texts = aligned_texts(docs, files or Tokenizers.public())
    pairs = pair_counts(texts)
    rows = texts.select("key", "salts", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    found = kept(rows.join(_measures(texts, pairs, most_pairs), "key"))
    released(texts, pairs)
    wanted = docs.select("doc_id", F.when(F.octet_length("text") > 0, _key("text")).alias("key"), salt_of("doc_id").alias("salt"))
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return salted_lookup(wanted, found, "key").select(
        "doc_id",
        *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in numbers],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents' tokens by a byte-level and a piece vocabulary, aligned."""
    return alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
