"""Vector search, Merkle manifest and tokenizer alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import ODD, SCHEMA
from pyspark.sql import functions as F

from rtflow.llm import alignment, merkle, vector_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return Counter(map(tuple, df.collect()))


# --- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    i, _, lang, source, n = row
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def manifest(table):
    """By levels, as the contract says it; no parents are stored."""

    def climbed(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][j : j + 16]) for j in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, at, folded):
        proof = []
        for level in levels[:-1]:
            low = at // 16 * 16
            run = level[low : low + 16]
            proof += run[: at - low] + run[at - low + 1 :]
            folded = sha(*run[: at - low], folded, *run[at - low + 1 :])
            at //= 16
        return proof, folded

    by = defaultdict(list)
    for row in table:
        by[row[3]].append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climbed([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order]
    top = climbed([t[-1][0] for t in trees])
    out = Counter()
    for k, (s, levels) in enumerate(zip(order, trees)):
        for at, (_, _, leaf, row) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            text, now = row[1], leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                now = leaf_of(row, text and text.translate(LOWER))
            proof, folded = way(levels, at, now)
            more, folded = way(top, k, folded)
            out[row[0], leaf, levels[-1][0], top[-1][0], sha(*proof, *more), folded, folded == top[-1][0]] += 1
    return out


def many_documents(n, sources, seed=0):
    rng = random.Random(seed)
    names = [None, "", "é", "Z", "a", *[f"s{i}" for i in range(sources)]]
    return [(i, rng.choice(["Some Text", "lower", "", None]) , rng.choice(["en", None]), "hot" if i % 3 else rng.choice(names), i) for i in range(n)]


@pytest.mark.parametrize("table", [ODD, ODD[:1], many_documents(700, 300), many_documents(5200, 2)], ids=["odd", "one", "sources", "blocks"])
def test_merkle(spark, monkeypatch, table):
    monkeypatch.setattr(merkle, "BLOCK", 64)  # several blocks below a node
    docs = spark.createDataFrame(table, SCHEMA)
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = merkle.verified(docs, F.when(hit, F.translate("text", merkle._UPPER, merkle._LOWER)))
    assert rows(out) == manifest(table)


def test_merkle_clashes_empty_and_guard(spark, odd, none, clashing):
    tampered = F.when(F.col("doc_id") == 4, F.lit("changed"))
    plain = rows(merkle.verified(odd, tampered))
    assert plain == rows(merkle.verified(clashing.withColumn("leaf", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("tree", F.lit(0)), tampered))
    assert {row[0]: row[-1] for row in plain} == {**{i: True for i in (1, 2, 3, 5, 6, 7, 8, None)}, 4: False}
    assert merkle.verified(none, tampered).count() == 0
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


# --- tokenizer alignment


@pytest.fixture(scope="module")
def encoder():
    return alignment.Encoder(alignment.Tokenizers.public())


def aligned(encoder, texts):
    """Byte by byte."""
    found = []
    for text in texts:
        a, b = ([], []) if not text else (encoder.a.encode(" " + text, add_special_tokens=False).ids, encoder.b.encode(text))
        pieces = [[encoder.a_bytes[i] for i in a], [encoder.b_bytes[i] for i in b]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in pieces):
            found.append(((), (), "", Counter()))
            continue
        owners = [[k for k, x in enumerate(p) for _ in x] for p in pieces]
        links = {*zip(*owners)}
        groups, cut, end = [], ([], []), [0, 0]
        for x, y in sorted(links):
            for side, k in enumerate((x, y)):
                if k not in cut[side]:
                    cut[side].append(k)
            end = [sum(map(len, p[: k + 1])) for p, k in zip(pieces, (x, y))]
            if end[0] == end[1]:
                groups.append(",".join(str(a[k]) for k in cut[0]) + "|" + ",".join(str(b[k]) for k in cut[1]))
                cut = ([], [])
        found.append((a, b, groups, Counter((a[x], b[y]) for x, y in links)))
    count = Counter(p for *_, links in found for p in links)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for a, b, groups, links in found:
        best = sum(n for p, n in links.items() if count[p] == most[p[0]])
        digest = sha(";".join(groups)) if a else ""
        out.append((len(a), len(b), len(groups), sum(links.values()), best, sum(n * count[p] for p, n in links.items()), digest))
    return out


TEXTS = ["", None, "a", "Hello world", "  two  spaces\n\nlines\t", "<|endoftext|> and </s> are text", "naïve café 😀 漢字かな", "▁ a low bar", "\x00\x01", "x" * 3000, "Hello world", "ﬁ ligature ½ ㎏", " lead", "trail ", "é"]


def test_alignment(spark, encoder):
    rng = random.Random(1)
    words = ["the", "quick", "Übung", "tokenization", "🙂🙂", "12345", "don't", "--", "\n"]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(60)] + ["copied text"] * 50
    docs = spark.createDataFrame([(None if i % 9 == 0 else i, x) for i, x in enumerate(texts)], "doc_id bigint, text string")
    want = Counter(((None if i % 9 == 0 else i), *r) for i, r in enumerate(aligned(encoder, texts)))
    assert want[(4, 0, 0, 0, 0, 0, 0, "")] == 0 and any(r[1] == 0 for r in want)
    for most in (alignment.MOST_PAIRS, 7):  # all pairs in one pass, and in many
        assert rows(alignment.alignments(docs, most_pairs=most)) == want


def test_both_ways_to_merge_agree(encoder):
    rng = random.Random(9)
    every = [chr(i) for i in range(0x800)]
    texts = [" " + "".join(rng.choices(every, k=80)) for _ in range(1500)]
    texts += [" " + "".join(rng.choices("ab .'s\u0301é1\u00a0\u0085\t\n\x1c've", k=60)) for _ in range(1500)]
    texts += [" " + x for x in TEXTS if x]
    fast = sum(alignment._SLOW.search(x) is None for x in texts)
    assert encoder.fast is not None and 3000 <= fast < len(texts)
    want = [x.ids for x in encoder.a.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder._byte_level(texts)] == want
    assert alignment.Encoder(alignment.Tokenizers(*[getattr(alignment.Tokenizers.public(), f) for f in ("byte_level", "pieces")])).fast is None


def test_alignment_odd(spark, odd, none, clashing):
    plain = rows(alignment.alignments(odd))
    assert sum(plain.values()) == len(ODD) and plain[(2, 0, 0, 0, 0, 0, 0, "")] == 1
    named = clashing.withColumn("salt", F.lit(1)).withColumn("key", F.lit(1)).withColumn("n", F.lit(1)).withColumn("n_a", F.lit(1)).withColumn("salts", F.lit(1))
    assert rows(alignment.alignments(named)) == plain
    assert alignment.alignments(none).count() == 0


# --- vector search


def searched(table, k=20):
    """All pairs."""
    table = [(i, np.array(v, np.float32).astype(float)) for i, v in table]
    out = {}
    for i, q in table:
        if i % 20 == 0:
            near = sorted((-(x * q).sum(), j) for j, x in table if j != i)[:k]
            out[i] = [(r + 1, j, s) for r, (s, j) in enumerate(near)]
    return out


def result(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.rank, r.vec_id, -r.score))
    return out


VECTORS = "vec_id bigint, embedding array<float>, label int"


def frame(spark, table):
    return spark.createDataFrame([(i, v, 0) for i, v in table], VECTORS)


def test_vector_search_is_exact_while_all_lists_are_read(spark):
    rng = np.random.default_rng(0)
    # Different lengths, ties, a group of equal vectors.
    table = [(i, (rng.integers(-3, 4, 6) * float(rng.integers(1, 4))).tolist()) for i in range(400)]
    table = [(i, v if any(v) else [1.0] * 6) for i, v in table] + [(1000 + i, [2.0] * 6) for i in range(130)]
    assert result(vector_search.nearest_vectors(frame(spark, table), F.col("vec_id") % 20 == 0)) == searched(table)


def test_vector_search_recall_through_several_shelves(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))) * rng.uniform(0.8, 1.2, (3000, 1))
    index = vector_search.Index.fit(x.astype(np.float32), len(x), float(np.linalg.norm(x, axis=1).max()))
    monkeypatch.setattr(vector_search, "LIST", 32)
    monkeypatch.setattr(vector_search, "LEAST", 8)
    monkeypatch.setattr(vector_search, "SHELF", 200)
    monkeypatch.setattr(vector_search, "RATIO", 2.0)
    small = vector_search.Index.fit(x.astype(np.float32), len(x), float(np.linalg.norm(x, axis=1).max()))
    assert small.shelf.max() >= 12 and len(small.centroids) > 3 * len(index.centroids)
    table = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    want, got = searched(table), result(vector_search.nearest_vectors(frame(spark, table), F.col("vec_id") % 20 == 0))
    hit = [len({j for _, j, _ in want[i]} & {j for _, j, _ in got[i]}) / 20 for i in want]
    assert np.mean(hit) >= 0.95
    for i in want:
        known = {j: s for _, j, s in want[i]}
        assert all(abs(known[j] - s) < 1e-9 for _, j, s in got[i] if j in known)


def test_walks_find_all_centroids_in_range():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 8)).astype(np.float32)
    length = float(np.linalg.norm(x, axis=1).max())
    index = vector_search.Index.load(vector_search.Index.fit(x, 6000 * 20, length).dump())
    q = vector_search.lifted(x[:300], length)
    far = np.linalg.norm(q[:, None] - index.centroids, axis=2)
    ids, _ = index.nearest(q, 2.0)
    want = [set(np.flatnonzero(d <= 2.0 * d.min())) for d in far]
    assert max(map(len, want)) > vector_search.WIDTH
    assert sum(len(w & set(i)) for w, i in zip(want, ids.tolist())) >= 0.99 * sum(map(len, want))


def test_vector_search_odd(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(i, [float(i + 1), 1.0]) for i in range(25)]
    odd = [(100, None), (120, [0.0, 0.0]), (140, [nan, 1.0]), (160, [inf, 1.0]), (180, [1.0, None]), (200, []), (220, [1.0]), (None, [1.0, 1.0])]
    clash = frame(spark, sound + odd + sound[:3]).selectExpr("*", "1 AS k1", "2 AS shelf", "3 AS v", "4 AS rank", "5 AS key", "6 AS salt")
    assert result(vector_search.nearest_vectors(clash, F.col("vec_id") % 20 == 0)) == searched(sound)
    assert len(searched(sound[:4])[0]) == 3 and result(vector_search.nearest_vectors(frame(spark, sound[:4]), F.col("vec_id") % 20 == 0)) == searched(sound[:4])
    assert vector_search.nearest_vectors(frame(spark, odd[:2]), F.col("vec_id") % 20 == 0).count() == 0
    alone = vector_search.nearest_vectors(frame(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0)
    assert alone.count() == 0
