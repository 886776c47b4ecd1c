"""A Merkle manifest of a dataset, and a recursive query that climbs it from every leaf.

Each row is a leaf, each source a tree over its leaves in the order of the key, and the sources' roots
are the leaves of the tree on top. A node is the hash of up to ``RUN`` consecutive nodes below it.

The built levels are stored as rows that name their parent. ``climb`` starts at all leaves, with the hash
of the row as it is now, and goes up one level with each step of a recursive query: it joins the parent,
appends the leaf's siblings there and folds the hash with them. A row that has changed since the
manifest was built does not arrive at the root.

Near the top all leaves of a source have the same parent. So leaves are dealt to blocks of ``BLOCK``
successive ones, a node has one row for each block below it, and blocks are part of the join's key: no
key has more than a block's leaves, and the copies add one row per level and block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtflow.llm.common import kept, released

#: Fixed value: how many nodes have one parent.
RUN = 16
#: The columns whose content makes a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves whose way up is joined by one key.
BLOCK = RUN**3
#: The number of the tree over the sources.
TOP = -1
#: Rows of a file of a table that is known to be small.
FILE_ROWS = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """The hash of a row's values: each ``-`` if null, else its UTF-8 length, ``:`` and itself; as bytes."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(column) -> Column:
    return F.lower(F.hex(column))


def _hash(digests: Column) -> Column:
    """The hash of digests, which are hashed as text."""
    return F.unhex(F.sha2(_hex(digests), 256))


def _kept(df: DataFrame, rows: int) -> DataFrame:
    """A table of about so many rows, in few files if it is small."""
    return kept(df.coalesce(1 + rows // FILE_ROWS))


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """The rows, written, with ``part`` and the place ``at`` in it, sorted over all parts; and the parts.

    Parts are ranges of the order. The second table has each part's number of rows before it; it is as
    long as there are tasks. Rows equal in the whole order are spread by where they were read.
    """
    tied = df.withColumn("tie", F.monotonically_increasing_id()).orderBy(*order, "tie").drop("tie")
    mid = F.monotonically_increasing_id()
    rows = kept(tied.withColumn("mid", mid)).withColumns(
        {"part": F.shiftright("mid", 33), "at": F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    return rows.drop("mid"), rows.groupBy("part").agg(F.count("*").alias("n"))


@dataclass
class Manifest:
    """A built manifest. All tables are written."""

    #: one row per leaf: ``tree`` and ``i`` (its place there), ``digest``, the tree's size ``n``, and what was carried
    leaves: DataFrame
    #: one row per node above the leaves and block below it: its key, its children's digests, its parent
    nodes: DataFrame
    #: one row per source: ``tree``, ``n``, ``source``, ``subroot``
    sources: DataFrame
    #: the digest of everything; null without rows
    root: bytes | None

    def release(self) -> None:
        released(self.leaves, self.nodes, self.sources)


def _levels(level: DataFrame, most: int, total: int, trees: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes above ``level`` (tree, i, n, digest), level by level, and each tree's root.

    There are ``total`` of them in ``trees`` trees, of which the largest has ``most``.
    """
    roots = level.where("n = 1").select("tree", "digest")
    built, n, height = [], most, 0
    while n > 1:
        height += 1
        total = total // RUN + trees
        runs = level.where("n > 1").groupBy("tree", F.expr(f"i div {RUN}").alias("i"), F.ceil(F.col("n") / RUN).alias("n"))
        run = F.array_sort(F.collect_list(F.struct(F.pmod("i", F.lit(RUN)).alias("place"), "digest")))
        kids = F.unhex(F.array_join(F.transform(run, lambda x: F.hex(x.digest)), ""))
        level = _kept(runs.agg(kids.alias("kids")).withColumn("digest", _hash(F.col("kids"))), total)
        built.append(level.withColumn("level", F.lit(height)))
        roots = roots.unionByName(level.where("n = 1").select("tree", "digest"))
        n = -(-n // RUN)
    return built, roots


def _name(tree, level, i) -> Column:
    return F.concat_ws("/", *[x if isinstance(x, Column) else F.lit(x) for x in (tree, level, i)])


def _sequence(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low.cast("bigint"), high.cast("bigint")))


def build(docs: DataFrame, key: str, source: str, leaf: Column, carried: dict[str, Column]) -> Manifest:
    """The manifest of ``docs``; ``leaf`` is the digest of a row, and leaves keep the ``carried`` columns."""
    table = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), leaf.alias("digest"),
        *[c.alias(name) for name, c in carried.items()],
    )
    rows, _ = numbered(table, "source", "key", "digest")
    # A source's rows of one part are a run; runs are added up by source, so no key has more than its tasks.
    runs = rows.groupBy("source", "part").agg(F.count("*").alias("m"), F.min("at").alias("low"))
    sizes = kept(runs.groupBy("source").agg(F.sum("m").alias("n")))
    most, trees, total = sizes.agg(F.max("n"), F.count("*"), F.sum("n")).first()
    ordered, parts = numbered(sizes, "source")
    before = F.coalesce(F.sum("n").over(_upto("part")), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    named = _kept(ordered.join(parts, "part").select("source", "n", (F.col("before") + F.col("at")).alias("tree")), trees)
    r, t = runs.alias("r"), named.alias("t")
    runs = r.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        F.col("r.source").alias("run_source"), F.col("part").alias("run_part"), "tree", "n", "low",
        F.coalesce(F.sum("m").over(_upto("part", "tree")), F.lit(0)).alias("before"),
    )
    runs = kept(runs)
    same = F.col("source").eqNullSafe(F.col("run_source")) & (F.col("part") == F.col("run_part"))
    leaves = kept(
        rows.join(runs, same).select(
            "tree", (F.col("at") - F.col("low") + F.col("before")).alias("i"), "n", "digest", "key", *carried
        )
    )
    released(rows, sizes, ordered, runs)
    below, subroots = _levels(leaves.select("tree", "i", "n", "digest"), most or 0, total or 0, trees)
    sources = _kept(named.join(subroots.withColumnRenamed("digest", "subroot"), "tree"), trees)
    tops = sources.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("i"), F.lit(trees).alias("n"), F.col("subroot").alias("digest"))
    above, roots = _levels(tops, trees, trees, 1)
    root = roots.first()
    nodes = _nodes(below, above, sources, trees, (total or 0) // BLOCK + (total or 0) // RUN + trees)
    released(named, *below, *above)
    return Manifest(leaves, nodes, sources, bytes(root.digest) if root else None)


def _upto(order: str, *keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _nodes(below: list[DataFrame], above: list[DataFrame], sources: DataFrame, trees: int, about: int) -> DataFrame:
    """All nodes with their parents' names, once for each block of leaves below them."""
    sizes = sources.select(F.col("tree").alias("of"), F.col("n").alias("leaves"))
    out = None
    for level, df in enumerate(below, 1):
        width = RUN**level
        last = F.least((F.col("i") + 1) * width, F.col("leaves")) - 1
        whole = F.col("n") == 1
        # The roots of sources go on in the tree on top, if there is more than one.
        up = F.when(~whole, _name(F.col("tree"), level + 1, F.expr(f"i div {RUN}"))).when(
            F.lit(trees > 1), _name(TOP, 1, F.expr(f"tree div {RUN}"))
        )
        rows = df.join(sizes, F.col("tree") == F.col("of")).select(
            _name(F.col("tree"), level, F.col("i")).alias("node"), "kids", up.alias("up"),
            F.pmod(F.when(whole, F.col("tree")).otherwise(F.col("i")), F.lit(RUN)).cast("int").alias("place"),
            F.when(whole, F.col("digest")).alias("subroot"), F.col("tree").alias("of"),
            _sequence(F.expr(f"i * {width} div {BLOCK}"), F.floor(last / BLOCK)).alias("block"),
        )
        out = rows if out is None else out.unionByName(rows)
    for level, df in enumerate(above, 1):
        up = F.when(F.col("n") > 1, _name(TOP, level + 1, F.expr(f"i div {RUN}")))
        blocks = sizes.select("of", F.expr(f"of div {RUN**level}").alias("over"), _sequence(F.lit(0), F.expr(f"(leaves - 1) div {BLOCK}")).alias("block"))
        rows = df.join(blocks, F.col("i") == F.col("over")).select(
            _name(TOP, level, F.col("i")).alias("node"), "kids", up.alias("up"),
            F.pmod("i", F.lit(RUN)).cast("int").alias("place"), F.lit(None).cast("binary").alias("subroot"), "of", "block",
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        schema = "node string, kids binary, up string, place int, subroot binary, of bigint, block bigint"
        out = sources.sparkSession.createDataFrame([], schema)
    return _kept(out, about)


#: A step: the parent's children are cut at the leaf's place into the siblings before and after it.
_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT leaf, of, block, up, place, folded, 0 AS depth, CAST(NULL AS BINARY) AS siblings, subroot, key, digest
  FROM {leaves}
  UNION ALL
  SELECT c.leaf, c.of, c.block, n.up, n.place,
    unhex(sha2(lower(hex(concat(substr(n.kids, 1, 32 * c.place), c.folded, substr(n.kids, 32 * c.place + 33)))), 256)),
    c.depth + 1,
    concat(substr(n.kids, 1, 32 * c.place), substr(n.kids, 32 * c.place + 33)),
    n.subroot, CAST(NULL AS {key_type}), CAST(NULL AS BINARY)
  FROM climb c JOIN {nodes} n ON n.of = c.of AND n.block = c.block AND n.node = c.up
)
SELECT * FROM climb
"""


def climb(manifest: Manifest, now: Column) -> DataFrame:
    """For each leaf the way from ``now``, its digest today, to the root.

    Returns ``key``, ``digest``, ``subroot``, ``proof`` (the hash of the siblings' digests from the leaf up)
    and ``folded`` (what is reached at the top), written.
    """
    spark = manifest.leaves.sparkSession
    trees = manifest.sources.count()
    alone = F.col("n") == 1
    up = F.when(~alone, _name(F.col("tree"), 1, F.expr(f"i div {RUN}"))).when(F.lit(trees > 1), _name(TOP, 1, F.expr(f"tree div {RUN}")))
    leaves = manifest.leaves.select(
        F.struct("tree", "i").alias("leaf"), F.col("tree").alias("of"), F.expr(f"i div {BLOCK}").alias("block"), up.alias("up"),
        F.pmod(F.when(alone, F.col("tree")).otherwise(F.col("i")), F.lit(RUN)).cast("int").alias("place"),
        now.alias("folded"), F.when(alone, F.col("digest")).alias("subroot"), "key", "digest",
    )
    # The query is bounded by the manifest's height; Spark's guard against endless recursion counts rows. All
    # steps' rows are read in as many tasks as the last step has, which AQE would make few, as it is empty.
    own = {"spark.sql.cteRecursionRowLimit": -1, "spark.sql.adaptive.coalescePartitions.enabled": False}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        query = _CLIMB.replace("{key_type}", leaves.schema["key"].dataType.simpleString())
        steps = spark.sql(query, leaves=leaves, nodes=manifest.nodes)
        way = F.array_sort(F.collect_list(F.when(F.col("depth") > 0, F.struct("depth", "siblings"))))
        proof = F.lower(F.array_join(F.transform(way, lambda x: F.hex(x.siblings)), ""))
        return kept(
            steps.groupBy("leaf").agg(
                F.max("key").alias("key"), F.max("digest").alias("digest"), F.max("subroot").alias("subroot"),
                F.max_by("folded", "depth").alias("folded"), F.unhex(F.sha2(proof, 256)).alias("proof"),
            ).drop("leaf")
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def verified(docs: DataFrame, tampered: Column) -> DataFrame:
    """Build the manifest of ``docs`` and climb it with the digests of the texts in ``tampered``.

    Where ``tampered`` is null or the text as it was, the row must verify, and elsewhere it must not. Every
    row is a leaf of its own, equal ones too; those with a null id come first in their source. A null
    value and an empty text have different digests. Columns besides ``FIELDS`` are neither read nor
    returned, and an empty table has no rows.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = digest(*fields[:-1], tampered)
    manifest = build(docs, "doc_id", "source", digest(*fields), {"now": F.when(tampered.isNotNull(), changed)})
    ways = climb(manifest, F.coalesce("now", "digest"))
    manifest.release()
    root = F.lit(manifest.root).cast("binary")
    return ways.select(
        F.col("key").alias("doc_id"), _hex("digest").alias("leaf"), _hex("subroot").alias("subroot"), _hex(root).alias("root"),
        _hex("proof").alias("proof_sha256"), _hex("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"),
    )


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents; where 5 divides the CRC-32 of the id, A-Z of the text has been lowered meanwhile."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return verified(docs, F.when(hit, F.translate("text", _UPPER, _LOWER)))


#: The same in DuckDB, whose recursion may aggregate: levels are built by recursion, too.
ORACLE_SQL = """
WITH RECURSIVE base AS (
  SELECT *, concat(
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
  FROM documents
), digests AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM base
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM digests
), below AS (
  SELECT tree, i, n, 0 AS level, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, i // 16, min((n + 15) // 16), min(level) + 1, sha256(string_agg(digest, '' ORDER BY i))
  FROM below WHERE n > 1 GROUP BY tree, i // 16
), subroots AS (
  SELECT tree, digest AS subroot, level AS height, count(*) OVER () AS trees FROM below WHERE n = 1
), above AS (
  SELECT tree AS i, trees AS n, 0 AS level, subroot AS digest FROM subroots
  UNION ALL
  SELECT i // 16, min((n + 15) // 16), min(level) + 1, sha256(string_agg(digest, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY i // 16
), nodes AS (
  SELECT tree, i, level, digest FROM below UNION ALL SELECT -1, i, level, digest FROM above
), climb AS (
  SELECT tree AS of, i AS leaf, tree, i, 0 AS level, coalesce(changed, leaf) AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT c.of, c.leaf, min(c.tree), c.i // 16, min(c.level) + 1,
    sha256(string_agg(CASE WHEN m.i = c.i THEN c.folded ELSE m.digest END, '' ORDER BY m.i)),
    min(c.proof) || coalesce(string_agg(m.digest, '' ORDER BY m.i) FILTER (m.i <> c.i), '')
  FROM (
    SELECT c.of, c.leaf, CASE WHEN c.tree >= 0 AND c.level = s.height THEN -1 ELSE c.tree END AS tree,
      CASE WHEN c.tree >= 0 AND c.level = s.height THEN c.tree ELSE c.i END AS i,
      CASE WHEN c.tree >= 0 AND c.level = s.height THEN 0 ELSE c.level END AS level, c.folded, c.proof
    FROM climb c JOIN subroots s ON s.tree = c.of
  ) c JOIN nodes m ON m.tree = c.tree AND m.level = c.level AND m.i // 16 = c.i // 16
  WHERE c.tree >= 0 OR c.level < (SELECT max(level) FROM above)
  GROUP BY c.of, c.leaf, c.i
), ends AS (
  SELECT of, leaf, folded, proof FROM climb
  QUALIFY row_number() OVER (PARTITION BY of, leaf ORDER BY tree < 0 DESC, level DESC) = 1
)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = r.digest AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN ends e ON e.of = l.tree AND e.leaf = l.i
CROSS JOIN (SELECT digest FROM above WHERE n = 1) r
"""
