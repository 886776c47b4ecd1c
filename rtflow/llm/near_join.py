"""Exact Jaccard join of documents on their shingles, as a join in the Jaccard metric space.

Two documents link when their distance is at most a bound: for op9 0.15 on shingles of 4 words. Nearly all documents are at distance 1 from
nearly all others, so whole documents as first pivots would tell nothing apart. The first pivots are
single shingles: a document lies in the regions of its first shingles in an order that puts frequent
ones last, as many as make it certain that two linked documents meet in one (a document of n
shingles is replicated to n - ceil(0.85 n) + 1 regions at 0.15). Regions go on inside with documents as
pivots and with parity bitmaps, an embedding that never lengthens the size of a set difference:
what the bitmaps' distance rules out can't link, and what they leave is compared by whole sets.

Only components are asked for, so a region hands on a spanning forest of its near pairs, never all of
them. When those are verified, regions are searched once more for documents that are near one of
another component. The whole sets of those go into their regions, where pairs are verified at once, and
a spanning forest of the links is handed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from rtflow.llm.common import free_name, kept, released
from rtflow.llm.pywords import NONSPACE, coded, lowered, windows

#: What op9 asks for: words of a shingle; linked when ``100 * intersection >= PERCENT * union``.
SHINGLE, PERCENT = 4, 85
#: log2 of the counters that tell frequent shingles; fixed, whatever the input.
COUNTERS = 17
#: Documents of a region that are compared in one task; larger regions are cut in blocks of them.
BLOCK = 2048
#: Bytes of whole sets that a block holds on average, where sets go into regions.
BLOCK_BYTES = 1 << 25
#: Bits for a shingle, at least, in bitmaps that go into regions, and in those of whole sets inside one.
BITS, FINE = 2, 32
#: log2 of the bits of the filter for documents whose sets are asked for; fixed as well.
FILTER = 24
#: Links, or a batch more, that a task contracts at a time.
CHUNK = 1 << 18
#: Shingles are 58-bit codes; six bits above them are for their order.
_LOW = np.uint64((1 << 58) - 1)
_INT = np.int64


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, sorted; of a text of fewer words, the whole sequence as one."""
    codes, _, _ = coded(lowered(text), NONSPACE)
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint64)
    h = windows(codes, size) if n >= size else windows(codes, n) + np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return np.unique(h >> np.uint64(6))


def set_key(found: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for the set."""
    digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), _INT)
    return int(digest[0]), int(digest[1])


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def parity_bits(found: np.ndarray, each: int = BITS) -> bytes:
    """A bit for each class of codes: whether an odd number of the set is in it.

    There are ``each`` bits for a shingle at least. Of two sets near the bound few classes hold two
    codes that differ: at 0.85 and two bits, what is below 0.83 is mostly ruled out.
    """
    m = max(64, 1 << (each * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(m - 1)).astype(_INT), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _slots(found: list[np.ndarray]) -> np.ndarray:
    slots = np.concatenate(found) & np.uint64((1 << COUNTERS) - 1)
    return np.bincount(slots.astype(_INT), minlength=1 << COUNTERS)


def _count(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNTERS, _INT)
    for batch in batches:
        held, size = [], 0
        for text in batch.column(0):
            held.append(shingles(text.as_py(), shingle))
            size += len(held[-1])
            if size > 1 << 18:
                counts += _slots(held)
                held, size = [], 0
        if held:
            counts += _slots(held)
    at = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["slot", "n"])


def frequency_levels(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """For each counter how far beyond the usual its shingles are, 0 to 40, over all documents."""
    parts = docs.select("text").mapInArrow(lambda batches: _count(batches, shingle), "slot int, n bigint")
    totals = np.zeros(1 << COUNTERS, np.float64)
    for slot, n in parts.groupBy("slot").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        totals[slot] = n
    usual = max(1.0, float(np.median(totals)))
    excess = (totals - usual) / (6 * np.sqrt(usual) + 2)
    return np.where(excess >= 1, 1 + np.floor(2 * np.log2(np.maximum(excess, 1))), 0).clip(0, 40).astype(np.uint64)


_PROFILE = "doc_id {id}, k1 bigint, k2 bigint, n bigint, prefix array<bigint>, bits binary"


def _profiles(docs: DataFrame, levels: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """A row per document; within a task only the first of equal sets has its prefix and bits."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary())])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = shared.value, set()
        mask = np.uint64((1 << COUNTERS) - 1)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = shingles(text.as_py(), shingle)
                n, key = len(found), set_key(found)
                if n == 0 or key in seen:
                    rows.append((*key, n, None, None))
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                order = found | (levels[(found & mask).astype(_INT)] << np.uint64(58))
                keep = n - least_overlap(n, percent) + 1
                prefix = np.sort(np.partition(order, keep - 1)[:keep]).view(_INT)
                rows.append((*key, n, prefix, parity_bits(found)))
            columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *schema.names])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(profile, _PROFILE.format(id=kind))


class _Set:
    """The documents of a region: sizes, bitmaps by their number of bits, and distances between them."""

    def __init__(self, n: np.ndarray, bits: list[bytes], percent: int = PERCENT):
        self.most, self.of = 100 - percent, 100 + percent
        self.n, self.m = n, np.array([8 * len(b) for b in bits])
        self.rows: dict[int, np.ndarray] = {}  # by number of bits: of all documents with so many or more
        for m in np.unique(self.m).tolist():
            table = np.zeros((len(bits), m // 64), np.uint64)
            for i in np.flatnonzero(self.m >= m).tolist():
                folded = np.frombuffer(bits[i], np.uint64)
                while len(folded) > m // 64:
                    folded = folded[: len(folded) // 2] ^ folded[len(folded) // 2 :]
                table[i] = folded
            self.rows[m] = table

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` whose distance from document i isn't ruled out."""
        s = self.n[others] + self.n[i]
        # |A xor B| <= most / of * (|A| + |B|), 15 / 185 for 0.85, is the same as Jaccard >= percent / 100; sizes alone bound it first
        others = others[self.of * np.abs(self.n[others] - self.n[i]) <= self.most * s]
        out = []
        for m in np.unique(np.minimum(self.m[others], self.m[i])).tolist():
            part = others[np.minimum(self.m[others], self.m[i]) == m]
            apart = np.bitwise_count(self.rows[m][part] ^ self.rows[m][i]).sum(1, dtype=_INT)
            out.append(part[self.of * apart <= self.most * (self.n[part] + self.n[i])])
        return np.concatenate(out) if out else others


def _forest(region: _Set, component: np.ndarray) -> list[tuple[int, int]]:
    """Near pairs that connect whatever components near pairs connect: each document is compared with
    those of components not yet reached, and a component it reaches hangs on it by one pair."""
    left, out = np.arange(len(region.n)), []
    while len(left):
        same = component[left] == component[left[0]]
        queue, left = left[same].tolist(), left[~same]
        while queue and len(left):
            i = queue.pop()
            got = region.near(i, left)
            if len(got):
                reached, first = np.unique(component[got], return_index=True)
                out += [(i, int(j)) for j in got[first]]
                moved = np.isin(component[left], reached)
                queue += left[moved].tolist()
                left = left[~moved]
    return out


def _apart(region: _Set, component: np.ndarray) -> np.ndarray:
    """The documents that are near one of another component."""
    names, sizes = np.unique(component, return_counts=True)
    marked = np.zeros(len(component), bool)
    if len(names) > 1:
        everyone, largest = np.arange(len(component)), names[np.argmax(sizes)]
        for i in np.flatnonzero(component != largest).tolist():
            others = everyone[(component != component[i]) & ((component == largest) | (everyone > i))]
            got = region.near(i, others)
            if len(got):
                marked[i] = marked[got] = True
    return np.flatnonzero(marked)


def _linked(found: list[np.ndarray], component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever components links of these sets connect, each verified."""
    region = _Set(np.array([len(x) for x in found], _INT), [parity_bits(x, FINE) for x in found], percent)
    everyone, out = np.arange(len(found)), []
    for i in everyone[:-1].tolist():
        others = everyone[i + 1 :]
        for j in region.near(i, others[component[others] != component[i]]).tolist():
            if component[j] != component[i] and _links_to(found[i], found[j], percent):
                component[component == component[j]] = component[i]
                out.append((i, j))
    return out


_PAIR = "a1 bigint, a2 bigint, b1 bigint, b2 bigint"


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Regions ``(pivot, i, j)`` of two documents or more that come one after the other, each whole."""
    at, rows = None, []
    for batch in batches:
        names = batch.schema.names
        for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if row[:3] != at:
                if len(rows) > 1:
                    yield at, rows
                at, rows = row[:3], []
            rows.append(row[3:])
    if len(rows) > 1:
        yield at, rows


def _near_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Each region's forest of near pairs."""
    for _, rows in _regions(batches):
        k1, k2, n, bits, component = zip(*rows, strict=True)
        found = _forest(_Set(np.array(n, _INT), list(bits), percent), np.array(component))
        if found:
            ends = [sorted([(k1[i], k2[i]), (k1[j], k2[j])]) for i, j in found]
            columns = [[e[x][y] for e in ends] for x in (0, 1) for y in (0, 1)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a1", "a2", "b1", "b2"])


_MEMBER = "pivot bigint, k1 bigint, k2 bigint, n bigint, component bigint"


def _near_others(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Each region's documents that are near one of another component."""
    for (pivot, _, _), rows in _regions(batches):
        k1, k2, n, bits, component = [np.array(x, _INT) if k != 3 else x for k, x in enumerate(zip(*rows, strict=True))]
        found = _apart(_Set(n, list(bits), percent), component)
        if len(found):
            columns = [np.full(len(found), pivot), k1[found], k2[found], n[found], component[found]]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["pivot", "k1", "k2", "n", "component"])


def _links_inside(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Each region's forest of links, from whole sets."""
    for _, rows in _regions(batches):
        k1, codes, component = zip(*rows, strict=True)
        found = _linked([np.frombuffer(c, np.uint64) for c in codes], np.array(component), percent)
        if found:
            columns = [[k1[pair[x]] for pair in found] for x in (0, 1)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["u", "v"])


def _blocked(cells: DataFrame, blocks: Column, held: DataFrame) -> DataFrame:
    """Regions in pairs ``i, j`` of their blocks, with what ``held`` has by document; not sorted yet."""
    own = F.pmod(F.xxhash64(F.lit(5), "k1"), blocks).cast("int")
    rows = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return rows.join(held, ["k1", "k2"])


def _in_regions(cells: DataFrame, bits: DataFrame) -> DataFrame:
    """Regions ``(pivot, k1, k2, n, c, component)`` with bitmaps, each in one task, in blocks of some ``BLOCK`` documents."""
    rows = _blocked(cells, F.ceil(F.col("c") / BLOCK).cast("int"), bits)
    rows = rows.select("pivot", "i", "j", "k1", "k2", "n", "bits", "component")
    return rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "n", "k1", "k2")


def _candidates(cells: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Distinct near pairs, a forest of each region."""
    return _in_regions(cells, bits).mapInArrow(lambda batches: _near_pairs(batches, percent), _PAIR).distinct()


def _links_between(cells: DataFrame, bits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(u, v)`` that connect different components, a forest of each region.

    Only documents near one of another component take their sets along, in blocks of bounded bytes.
    """
    near = kept(_in_regions(cells, bits).mapInArrow(lambda batches: _near_others(batches, percent), _MEMBER).distinct())
    sizes = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("codes"))
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("codes") * 8 / BLOCK_BYTES)).cast("int")
    rows = _blocked(near.join(sizes.select("pivot", blocks.alias("blocks")), "pivot"), F.col("blocks"), sets)
    rows = rows.select("pivot", "i", "j", "k1", "codes", "component")
    rows = rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "component", "k1")
    links = kept(rows.mapInArrow(lambda batches: _links_inside(batches, percent), "u bigint, v bigint"))
    released(near)
    return links


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(k1, k2, codes)`` of the documents whose keys are wanted; a filter of fixed size sorts out the rest."""
    size = 1 << FILTER
    slots = wanted.select(F.pmod("k1", F.lit(size)).alias("slot")).groupBy((F.col("slot").bitwiseAND((1 << 14) - 1)).alias("x"))
    ones = np.zeros(size, bool)
    for row in slots.agg(F.collect_set("slot").alias("slots")).toLocalIterator():  # a slot once at most
        ones[row["slots"]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(ones))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, seen = np.unpackbits(shared.value), set()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                found = shingles(text.as_py(), shingle)
                key = set_key(found)
                if ones[key[0] % size] and key not in seen:
                    if len(seen) < 200_000:
                        seen.add(key)
                    rows.append((*key, found.tobytes()))
            if rows:
                k1, k2, codes = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(k1), pa.array(k2), pa.array(codes, pa.binary())], ["k1", "k2", "codes"])

    found = docs.select("text").mapInArrow(emit, "k1 bigint, k2 bigint, codes binary")
    return found.join(wanted, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])


def _links_to(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(percent: int):
    @arrow_udf(BooleanType())
    def links(a: pa.Array, b: pa.Array) -> pa.Array:
        sets = zip(a, b, strict=True)
        return pa.array([_links_to(*[np.frombuffer(x.as_py(), np.uint64) for x in two], percent) for two in sets], pa.bool_())

    return links


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, as ``(u, v)`` of keys' first halves."""
    a = sets.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("codes").alias("a"))
    b = sets.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("codes").alias("b"))
    both = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    return both.where(_links(percent)("a", "b")).select(F.col("a1").alias("u"), F.col("b1").alias("v"))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links ``(u, v)`` of each chunk as stars around the smallest nodes: connected alike, in fewer steps."""

    def stars(links: list[pa.RecordBatch]) -> pa.RecordBatch:
        up: dict[int, int] = {}  # of every node that isn't the smallest of its component so far

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for batch in links:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = root(u), root(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
        return pa.record_batch([pa.array(list(up), pa.int64()), pa.array([root(x) for x in list(up)], pa.int64())], ["u", "v"])

    links, n = [], 0
    for batch in batches:
        links.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield stars(links)
            links, n = [], 0
    if n:
        yield stars(links)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for all nodes of ``(u, v)`` but the roots, the smallest nodes of components.

    Large-star and small-star steps in turn until nothing changes; each step is an aggregation and a
    join on nodes, so no component meets in one task. Before each, tasks contract what they read,
    which shortens long chains of links; on stars that changes nothing. Links are written before that,
    as they may come from Python: a task that ran both would hold two Python workers, which stay.
    """
    pair = "u bigint, v bigint"
    now = kept(edges.select("u", "v"))
    state = None
    while True:
        links = now.mapInArrow(_contracted, pair)
        both = links.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        then = small.union(low.select("u", "m")).distinct()
        # Few links make few files: each that is written has Hadoop's local file system start programs.
        then = kept(then.coalesce(-(-state[0] // CHUNK)) if state else then)
        new = then.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        released(now)
        if new == state or not new[0]:
            return then.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, state = then, new


def _several(cells: DataFrame, stars: DataFrame) -> DataFrame:
    """The rows of regions that hold more than one component, with their components."""
    named = cells.join(stars, F.col("k1") == F.col("node"), "left").withColumn("component", F.coalesce("root", "k1"))
    mixed = named.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    named = named.join(mixed.where("low != high").select("pivot"), "pivot", "left_semi")
    return named.select("pivot", "k1", "k2", "n", "c", "component")


def near_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Texts link whose sets of shingles of ``shingle`` words have a Jaccard of ``percent`` hundredths or more.

    ``component_id`` is the smallest ``doc_id`` that links reach, the row's own included. Texts with
    the same shingles are one node of the join. A null or empty text has no shingles, links with
    nothing and keeps its own id; a null id is passed over by the minimum, and the component of
    null ids alone is null. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    whole = kept(_profiles(docs, frequency_levels(docs, shingle), shingle, percent))
    profiles = kept(whole.select("doc_id", "k1", "k2", "n"))
    first = whole.where("bits is not null")
    cells = first.select(F.explode("prefix").alias("h"), "k1", "k2", "n").repartition("h").distinct()
    cells = cells.withColumn("c", F.expr("count(*) over (partition by h)"))
    cells = cells.withColumn("pivot", F.expr("min(k1) over (partition by h)")).where("c > 1")
    # Shingles whose documents have the same least one make one region, around that document.
    members = kept(cells.select("pivot", "k1", "k2", "n").distinct())
    cells = kept(members.join(members.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")), "pivot"))
    inside = cells.select("k1", "k2").distinct()
    bits = kept(first.select("k1", "k2", "bits").join(inside, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    released(whole, members)
    # First the region of each document's least pivot, then all regions for what that has left apart.
    # Their pairs are not verified yet, which only decides what else is handed on to be verified.
    apart = F.col("k1").alias("component")
    home = cells.withColumn("home", F.expr("min(pivot) over (partition by k1, k2)")).where("pivot = home")
    least = kept(_candidates(home.select("pivot", "k1", "k2", "n", "c", apart), bits, percent))
    guessed = components(least.select(F.col("a1").alias("u"), F.col("b1").alias("v")))
    pairs = kept(least.union(_candidates(_several(cells, guessed), bits, percent)).distinct())
    released(least)
    wanted = pairs.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).union(pairs.select("b1", "b2")).distinct()
    sets = kept(_sets(docs, wanted, shingle))
    stars = components(_verified(pairs, sets, percent))
    # Regions of several components may hold further links; their documents are in ``sets`` already.
    more = _links_between(_several(cells, stars), bits, sets, percent)
    released(cells, bits, sets, pairs)
    stars = components(more.union(stars.select("node", "root")))
    classes = profiles.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"))
    classes = classes.join(stars, (F.col("k1") == F.col("node")) & (F.col("n") > 0), "left")
    classes = classes.select("k1", "k2", "least", F.coalesce("root", "k1").alias("root"), "n")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.where("n > 0").join(least, "root").select("k1", "k2", "component_id")
    rows = profiles.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"))
    linked = rows.where("n_shingles > 0").join(named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    return linked.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))


#: Ids that are broadcast at most.
MOST_BROADCAST = 500_000


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each component the document with the smallest id, with the columns they came with.

    Documents without shingles stay. Null ids come after all others. Rows that share an id, or have none,
    are told apart by a hash of their texts: the smallest stays, and the others of its component go, while
    other texts of that id stay. Of rows with equal ids and texts one stays. What goes is broadcast while it
    is little; beyond that the join shuffles.
    """
    columns = docs.columns
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if unclear.isEmpty():
        return _without(docs, "doc_id", near_components(docs, shingle, percent)).select(*columns)
    rid, rank = free_name(docs, "rid", "rank")
    text = F.coalesce("text", F.lit(""))
    named = docs.withColumn(rid, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")))
    found = kept(near_components(named.select(F.col(rid).alias("doc_id"), "text"), shingle, percent))
    rest = _without(named, rid, found)
    again = found.where("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(rid))
    again = kept(again)
    # Rows that are equal may differ in other columns, of which the least stay.
    least = Window.partitionBy(rid).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    one = rest.join(again, rid, "left_semi").withColumn(rank, F.row_number().over(least)).where(F.col(rank) == 1).drop(rank)
    return rest.join(again, rid, "left_anti").select(*columns).unionByName(one.select(*columns))


def _without(docs: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id, in the column ``name``, is not that of a copy by ``found``."""
    gone = kept(found.where("n_shingles > 0 and doc_id != component_id").select(F.col("doc_id").alias(name)).distinct())
    few = gone.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, name, "left_anti")


def op9_near_join(spark, sf_dir: str) -> DataFrame:
    """Each document's number of shingles and its component of near copies."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
