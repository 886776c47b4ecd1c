"""Approximate nearest neighbours by inner product: balanced posting lists and a graph over their centroids.

A bounded sample is clustered, top down into eighths, until a cluster has as many vectors of the sample as
a list should have of all. A vector goes to the list of its nearest centroid and, on a boundary, to those of
others that are nearly as near. Centroids are found by a best-first walk over a graph that links
neighbouring ones. A query reads the lists whose centroids are no farther than ``RATIO`` times the nearest
one, and the ``LEAD`` nearest in any case.

Lists that follow each other in the clustering are neighbours. They are kept together on shelves, so a
vector is sent to a shelf once for all of its lists there, and so is a query, which is compared with all
vectors of the shelf. A shelf whose only list is too long is cut into blocks.

The largest inner product is the least distance once each vector gets one more component that lifts it to
the greatest length of all, and queries are stretched to that length.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtflow.llm.common import kept, salt_bits, salt_of, salted_lookup, uniform

#: About how many vectors the index learns from, drawn by a hash; and the fewest a list has of them.
SAMPLE, LEAST = 65_536, 64
#: Vectors a list and a shelf have at most, as far as the sample tells, and a block of a list that is longer.
LIST, SHELF, BLOCK = 256, 4096, 8192
#: A vector is also in lists whose centroid is at most so much farther than the nearest, in so many at most.
BOUNDARY, REPLICAS = 1.03, 4
#: A query reads all lists up to this many times as far as the nearest.
RATIO = 1.12
#: Centroids a walk keeps at first; how many of the best it goes on from in any case, and in one step.
WIDTH, LEAD, STEP = 64, 16, 4
#: Links of a centroid to its nearest, and to others drawn at random; where walks start.
NEAR, FAR, STARTS = 20, 6, 32


def _clusters(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of each cluster, neighbouring clusters one after the other: parts are split until they fit."""
    rng = np.random.default_rng(7)
    out, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        part = x[rows]
        k = min(8, -(-len(rows) // most))
        centres = part[rng.choice(len(rows), k, replace=False)]
        for turn in range(8):
            far = (centres * centres).sum(1) - 2 * part @ centres.T
            if turn:  # large clusters look farther away, which balances them
                spread = np.abs(far - far.mean()).mean()
                far = far + 0.2 * spread * np.bincount(own, minlength=k) / (len(rows) / k)
            own = far.argmin(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, part)
            counts = np.bincount(own, minlength=k)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centres)
        if counts.max() == len(rows):  # equal vectors cannot be told apart
            own = np.arange(len(rows)) % k
        # Successive clusters are neighbours: follow the direction in which centres differ most.
        axis = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
        stack += [rows[own == j] for j in np.argsort(centres @ axis) if (own == j).any()]
    return out


@dataclass
class Index:
    """Centroids with their graph, and the shelves of their lists."""

    centroids: np.ndarray
    links: np.ndarray
    starts: np.ndarray
    shelf: np.ndarray
    blocks: np.ndarray
    length: float

    @classmethod
    def fit(cls, vectors: np.ndarray, total: int, length: float) -> Index:
        """From a sample of ``total`` vectors that are no longer than ``length``."""
        x = np.unique(lifted(vectors, length), axis=0)
        share = len(vectors) / max(1, total)
        clusters = _clusters(x, max(LEAST, round(LIST * share)))
        centroids = np.stack([x[rows].mean(0) for rows in clusters])
        sizes = np.array([len(rows) for rows in clusters]) / share
        shelf, on = np.zeros(len(clusters), np.int32), 0.0
        for i, n in enumerate(sizes):
            new = i and on + n > SHELF
            shelf[i] = shelf[i - 1] + new if i else 0
            on = n if new else on + n
        blocks = np.maximum(1, np.ceil(np.bincount(shelf, sizes) / BLOCK)).astype(np.int32)
        links = _linked(centroids)
        starts = np.unique(np.linspace(0, len(centroids) - 1, STARTS).astype(np.int64))
        return cls(centroids, links, starts, shelf, blocks, length)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        found = np.load(io.BytesIO(data))
        return cls(**{**{name: found[name] for name in found.files}, "length": float(found["length"])})

    def nearest(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """The centroids that a walk finds for each row, all within ``ratio`` of its nearest one's distance.

        Returns them nearest first, some beyond that, and their distances, infinite where a row has no more.
        """
        n, width = len(x), WIDTH
        ids, far = self._walked(x, ratio, width)
        # Rows whose range is fuller than the walk is wide walk again, wider.
        while width < len(self.centroids) and (full := np.flatnonzero(far[:, -1] <= ratio * far[:, 0] + 1e-6)).size:
            width *= 2
            more, more_far = self._walked(x[full], ratio, width)
            wide, wide_far = np.zeros((n, more.shape[1]), np.int64), np.full((n, more.shape[1]), np.inf, np.float32)
            wide[:, : ids.shape[1]], wide_far[:, : far.shape[1]] = ids, far
            wide[full], wide_far[full] = more, more_far
            ids, far = wide, wide_far
        return ids, far

    def _walked(self, x: np.ndarray, ratio: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Walks that keep the ``width`` best, and go on from those in range and from the ``LEAD`` best.

        Each step goes on from up to ``STEP`` centroids of a row that have not been left yet.
        """
        n, c = len(x), self.centroids
        squares, lengths = (c * c).sum(1), (x * x).sum(1)
        width = min(width, len(c))
        seen = np.zeros((n, len(c)), bool)
        ids, far, left = np.zeros((n, width), np.int64), np.full((n, width), np.inf, np.float32), np.ones((n, width), bool)

        def met(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
            square = squares[found] + lengths[rows, None] - 2 * np.matmul(c[found], x[rows][:, :, None])[:, :, 0]
            d = np.sqrt(np.maximum(0, square))
            d[seen[rows[:, None], found]] = np.inf
            seen[rows[:, None], found] = True
            return d

        def kept_best(rows: np.ndarray, found: np.ndarray, d: np.ndarray) -> None:
            every, every_far = np.hstack([ids[rows], found]), np.hstack([far[rows], d])
            every_left = np.hstack([left[rows], ~np.isfinite(d)])
            best = np.argsort(every_far, axis=1)[:, :width]
            ids[rows], far[rows] = np.take_along_axis(every, best, 1), np.take_along_axis(every_far, best, 1)
            left[rows] = np.take_along_axis(every_left, best, 1)

        rows, found = np.arange(n), np.tile(self.starts, (n, 1))
        kept_best(rows, found, met(rows, found))
        while True:
            open_ = ~left & (far <= ratio * far[:, :1])
            open_[:, :LEAD] = ~left[:, :LEAD]
            rows = np.flatnonzero(open_.any(1))
            if not len(rows):
                return ids, far
            order = np.argsort(~open_[rows], axis=1, kind="stable")[:, :STEP]
            new, new_far = [], []
            for j in range(order.shape[1]):
                at = order[:, j]
                here = open_[rows, at]
                left[rows[here], at[here]] = True
                # A row with nothing left to go on from looks at its nearest's links, which it has seen.
                found = self.links[np.where(here, ids[rows, at], ids[rows, 0])]
                new.append(found)
                new_far.append(met(rows, found))
            kept_best(rows, np.hstack(new), np.hstack(new_far))

    def lists_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists a vector is in: centroids, and which of them hold."""
        ids, far = self.nearest(lifted(vectors, self.length), BOUNDARY)
        ids, far = ids[:, :REPLICAS], far[:, :REPLICAS]
        return ids, far <= BOUNDARY * far[:, :1] + 1e-6

    def lists_for(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists a query reads."""
        norms = np.linalg.norm(queries.astype(np.float64), axis=1)[:, None]
        x = np.hstack([queries * (self.length / norms), np.zeros((len(queries), 1))]).astype(np.float32)
        ids, far = self.nearest(x, RATIO)
        reads = far <= RATIO * far[:, :1] + 1e-6
        reads[:, :LEAD] = np.isfinite(far[:, :LEAD])
        return ids, reads


def lifted(vectors: np.ndarray, length: float) -> np.ndarray:
    x = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(0, length * length - (x * x).sum(1)))
    return np.hstack([x, rest[:, None]]).astype(np.float32)


def _linked(c: np.ndarray) -> np.ndarray:
    """Each centroid's nearest others and a few at random, block by block."""
    rng = np.random.default_rng(11)
    near = min(NEAR, len(c) - 1)
    out = np.empty((len(c), near + FAR), np.int32)
    squares = (c * c).sum(1)
    for at in range(0, len(c), 1024):
        far = squares - 2 * c[at : at + 1024] @ c.T
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        out[at : at + 1024, :near] = np.argsort(far, axis=1, kind="stable")[:, :near]
    out[:, near:] = rng.integers(0, len(c), (len(c), FAR))
    # A link that a row has already leads to the row itself, where a walk has been.
    order = np.argsort(out, axis=1, kind="stable")
    again = np.take_along_axis(out, order, 1)
    again = np.hstack([np.zeros((len(c), 1), bool), again[:, 1:] == again[:, :-1]])
    rows, places = np.nonzero(again)
    out[rows, order[rows, places]] = rows
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _shelves(index: Index, ids: np.ndarray, holds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (row, shelf)."""
    rows = np.repeat(np.arange(len(ids)), holds.sum(1))
    codes = np.unique(rows.astype(np.int64) << 32 | index.shelf[ids[holds]])
    return codes >> 32, codes & 0xFFFFFFFF


_SENT = "shelf int, block int, tag int, k1 bigint, k2 bigint, ids array<bigint>"
_NAMES = ["shelf", "block", "tag", "k1", "k2", "ids", "v"]


def _batch(shelf, block, tag, k1, k2, ids, v) -> pa.RecordBatch:
    n = len(shelf)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    columns = [pa.array(x, k) for x, k in zip([shelf, block, np.full(n, tag), k1, k2], kinds)]
    return pa.record_batch([*columns, ids, v], _NAMES)


def _sender(shared, k: int, queries: bool):
    """Rows ``(vec_id, k1, k2, v)`` to their shelves, equal vectors of a batch as one row.

    No result needs more than ``k + 1`` ids of equal vectors: the smallest, should one be the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.load(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                k1, k2, vec_id = (part.column(c).to_numpy() for c in ("k1", "k2", "vec_id"))
                order = np.lexsort((vec_id, k2, k1))
                new = np.r_[True, (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)]
                first = order[new]
                groups = np.split(vec_id[order], np.flatnonzero(new)[1:])
                v = part.column("v").take(pa.array(first))
                x = _matrix(v)
                rows, shelf = _shelves(index, *(index.lists_for(x) if queries else index.lists_of(x)))
                blocks = index.blocks[shelf]
                if queries:  # to every block of the shelf
                    rows, shelf = np.repeat(rows, blocks), np.repeat(shelf, blocks)
                    block = np.concatenate([np.arange(b) for b in blocks])
                    ids = pa.array([[]] * len(rows), pa.list_(pa.int64()))
                else:
                    block = k2[first][rows] % blocks
                    ids = pa.array([np.unique(groups[r])[: k + 1] for r in rows], pa.list_(pa.int64()))
                yield _batch(shelf, block, int(queries), k1[first][rows], k2[first][rows], ids, v.take(pa.array(rows)))

    return run


_FOUND = "k1 bigint, k2 bigint, found array<struct<far: double, vec_id: bigint>>"
_FOUND_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())]))]


def _comparer(k: int):
    """Rows of a shelf's block, vectors before queries, to the best ``k + 1`` vectors of each query."""

    def best(x: np.ndarray, ids: list[np.ndarray], q: np.ndarray) -> list[list[dict]]:
        scores = q @ x.T
        width = min(len(x), k + 12)
        out = []
        for row, s in zip(q, scores, strict=True):
            top = np.argpartition(-s, width - 1)[:width]
            top = top[s[top] >= np.partition(s[top], -min(width, k + 1))[-min(width, k + 1)] - 1e-9 * max(1.0, np.abs(s[top]).max())]
            exact = (x[top] * row).sum(1)  # the same whatever else is in the block
            pairs = sorted((-e, int(i)) for e, t in zip(exact.tolist(), top) for i in ids[t])[: k + 1]
            out.append([{"far": e, "vec_id": i} for e, i in pairs])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, x, ids, done = None, {}, None, [], set()
        for batch in batches:
            shelf, block, tag, k1, k2 = (batch.column(c).to_numpy() for c in _NAMES[:5])
            starts = np.flatnonzero(np.r_[True, (np.diff(shelf) != 0) | (np.diff(block) != 0) | (np.diff(tag) != 0)])
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                if (shelf[a], block[a]) != place:
                    place, held, x, done = (shelf[a], block[a]), {}, None, set()
                part = batch.slice(a, b - a)
                v = _matrix(part.column("v")).astype(np.float64)
                keys = list(zip(k1[a:b].tolist(), k2[a:b].tolist()))
                if not tag[a]:
                    for key, row, some in zip(keys, v, part.column("ids").to_pylist(), strict=True):
                        vector, known = held.get(key, (row, []))
                        held[key] = vector, sorted({*known, *some})[: k + 1]
                    continue
                if not held:
                    continue
                if x is None:
                    x, ids = np.stack([row for row, _ in held.values()]), [some for _, some in held.values()]
                new = [i for i, key in enumerate(keys) if key not in done and not done.add(key)]
                for at in range(0, len(new), 512):
                    some = new[at : at + 512]
                    found = best(x, ids, v[some])
                    columns = [[keys[i][0] for i in some], [keys[i][1] for i in some], found]
                    yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, _FOUND_KINDS)], ["k1", "k2", "found"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, k1, k2`` of the vectors that take part: those of the commonest length."""
    v = F.col("embedding")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & sound).select("vec_id", v.alias("v"), F.size(v).alias("size"))
    common = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.col("size") == F.lit(common["size"] if common else 0)).drop("size")
    return rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})


def fitted(rows: DataFrame, sample: int = SAMPLE) -> bytes | None:
    """An index of the rows of ``usable``, learnt in one task from about ``sample`` of them."""
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    total, length = rows.agg(F.count("*"), F.sqrt(F.max(squares))).first()
    if not total:
        return None

    def learn(batches):
        found = np.concatenate([_matrix(b.column("v")) for b in batches if b.num_rows] or [np.zeros((0, 1))])
        if len(found):
            yield pa.record_batch([pa.array([Index.fit(found, total, length).dump()], pa.binary())], ["index"])

    some = rows.where(uniform("k1", "vec_id", seed=3) < F.lit(sample / total)) if total > sample else rows
    return some.select("v").coalesce(1).mapInArrow(learn, "index binary").first()[0]


def nearest_vectors(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """The ``k`` nearest found of each row that ``is_query`` selects, among all rows with another id.

    Returns ``query_id, rank, vec_id, score``, ties by the smaller id. Vectors that are null or zero, hold
    nulls or non-finite components, have a null id or not the table's commonest length take no part. Equal
    rows count once; of rows with one id and different vectors each is a query and a candidate, and none
    is found by the others. Other columns are not read. An empty table has no rows.
    """
    rows = usable(vectors)
    index = fitted(rows)
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = spark.sparkContext.broadcast(index)
    schema = f"{_SENT}, v {rows.schema['v'].dataType.simpleString()}"
    queries = rows.where(is_query)
    sent = rows.mapInArrow(_sender(shared, k, False), schema).unionByName(queries.mapInArrow(_sender(shared, k, True), schema))
    dealt = sent.repartition("shelf", "block").sortWithinPartitions("shelf", "block", "tag")
    # One row for each query and block that it reads, so lists are as short as the walk is wide.
    found = dealt.mapInArrow(_comparer(k), _FOUND).groupBy("k1", "k2").agg(F.flatten(F.collect_list("found")).alias("found"))
    found = found.withColumn("found", F.slice(F.array_sort(F.array_distinct("found")), 1, k + 1))
    wanted = queries.select("k1", "k2", F.col("vec_id").alias("query_id")).distinct().withColumn("salt", salt_of("query_id"))
    salts = wanted.groupBy("k1", "k2").agg(salt_bits("salt").alias("salts"))
    keyed = F.struct("k1", "k2").alias("key")
    tops = kept(found.join(salts, ["k1", "k2"]).select(keyed, "salts", "found"))
    ranked = salted_lookup(wanted.select(keyed, "query_id", "salt"), tops, "key")
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k)
    ranked = ranked.select("query_id", F.posexplode(others))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "col.vec_id", (-F.col("col.far")).alias("score"))


def op11_vector_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
