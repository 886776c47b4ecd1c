"""Operators against brute force and against what their docstrings say of odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import ODD, SCHEMA, shingles
from pyspark.sql import functions as F

import corpus_pipeline
from rtflow.llm import decontamination, fingerprints, licenses, line_dedup, mixing, near_join, pii, secrets, sharding, toxicity
from rtflow.llm.pywords import ALNUM, NONSPACE, coded, lowered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows(df):
    return Counter(tuple(map(repr, r)) for r in df.collect())


@pytest.mark.parametrize("kind,pattern", [(ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NONSPACE, rb"[^\x20\x09-\x0D]+")])
def test_codes_depend_on_the_word_alone(kind, pattern):
    seen = {}
    for text in ["", "a", " a", "a b a", "É x\tÉ", "x" * 3000, " ".join(str(i % 977) for i in range(400_000))]:
        data = lowered(text)
        codes, starts, ends = coded(data, kind)
        found = [data[a:b] for a, b in zip(starts, ends)]
        assert found == re.findall(pattern, data)
        for word, code in zip(found, codes.tolist()):
            assert seen.setdefault(word, code) == code
    assert len(set(seen.values())) == len(seen)


# --- line dedup


def deduped(docs, n=3, long=50):
    first, gone = {}, defaultdict(set)
    lines = {i: [y for y in (x or "").split("\n") if y.strip(" ")] for i, x in docs}
    for i, found in lines.items():
        for size in (1, n):
            for j in range(len(found) - size + 1):
                if size > 1 or len(found[j].split()) >= long:
                    if first.setdefault(tuple(found[j : j + size]), (i, j)) != (i, j):
                        gone[i] |= set(range(j, j + size))
    return {i: (len(x), tuple(sorted(gone[i]))) for i, x in lines.items()}


@pytest.mark.parametrize("min_lines", [2, 3, 4, 5])
def test_line_dedup(spark, min_lines):
    rng = random.Random(min_lines)
    docs = [(i, "\n".join(rng.choice("abc") if rng.random() < 0.7 else str(rng.random()) for _ in range(rng.randrange(25)))) for i in range(40)]
    docs += [(100, " ".join("word" for _ in range(60))), (101, "x\n" + " ".join("word" for _ in range(60)))]
    out = line_dedup.without_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_lines=min_lines)
    got = {r.doc_id: (r.n_lines, tuple(r.gone_lines), r.text) for r in out.collect()}
    for i, (n, gone) in deduped(docs, min_lines).items():
        assert got[i][:2] == (n, gone)
        if gone:
            kept = [x for x in dict(docs)[i].split("\n") if x.strip(" ")]
            assert got[i][2] == "\n".join(x for j, x in enumerate(kept) if j not in gone)
        else:
            assert got[i][2] == dict(docs)[i]


@pytest.mark.parametrize("min_lines", [1, 3, 5])
def test_runs_count_the_words_of_all_their_lines(spark, min_lines):
    rng = random.Random(min_lines)
    lines = [" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 30), ("b", 21), ("c", 20), ("d", 15), ("e", 8), ("f", 52))]
    docs = [(0, f"{lines[0]}\n{lines[1]}"), (1, f"{lines[0]}\n \n{lines[1]}"), (2, f"{lines[0]}\n{lines[2]}\nnew"), (3, f"x\n{lines[0]}\n{lines[2]}")]
    docs += [(i, "\n".join(rng.choice(lines) if rng.random() < 0.8 else str(rng.random()) for _ in range(rng.randrange(12)))) for i in range(4, 40)]
    first, want = {}, defaultdict(set)
    for i, text in docs:
        found = [y for y in text.split("\n") if y.strip(" ")]
        for j in range(len(found)):
            for k in range(j + 1, len(found) + 1):  # all runs, of any length
                if k - j >= min_lines or sum(len(y.split()) for y in found[j:k]) >= 50:
                    if first.setdefault(tuple(found[j:k]), (i, j)) != (i, j):
                        want[i] |= set(range(j, k))
    assert want[1] == {0, 1} and (min_lines == 1 or not want[2]) and want[3] >= {1, 2}
    out = line_dedup.without_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_lines=min_lines)
    assert {r.doc_id: r.gone_lines for r in out.collect()} == {i: sorted(want[i]) for i, _ in docs}


# --- licenses


def test_licenses(spark):
    docs = [
        (0, "Released under the MIT License. The mit  LICENSE! mit-license"),
        (1, "This work is licensed under the GNU General Public License, version 3."),
        (2, "This work is licensed under the GNU General Public big License, version 3."),
        (3, "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0; mit"),
        (4, "license mit by cc apache"),
        (5, None),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.license_report(df, "doc_id").collect()}
    for i, text in docs:
        found, places = words(text), []
        for phrase, _ in licenses.BASE:
            p = phrase.split()
            places += [j for j in range(len(found)) if found[j : j + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(found), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
    assert [got[i].base_labels for i in range(6)] == ["mit", "gpl", "", "apache,cc-by", "", ""]
    assert "gpl-3.0" in got[1].labels and "gpl-3.0" in got[2].labels and "apache-2.0" in got[3].labels
    assert got[0].score == 1.0 and got[5].score == 0.0 and 0 < got[2].score < 1


# --- decontamination


@pytest.mark.parametrize("most", [10**6, 3])
def test_decontamination(spark, most):
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n))
    items = [(i, some(30)) for i in range(5)] + [(5, "Short item!"), (6, ""), (7, None), (8, items_text := some(30)), (9, items_text)]
    docs = [(i, some(60)) for i in range(20)]
    docs += [(100 + i, some(20) + " " + (t or "")[: rng.randrange(200)] + " " + some(rng.choice([5, 400]))) for i, t in items]
    docs += [(200, "a SHORT, item."), (201, None), (202, "short"), (202, "short")]
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    want = Counter()
    for i, t in docs:
        w, hit, of = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    of |= windows[k]
        want[i, len(w), len(hit), tuple(sorted(of)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    out = decontamination.find_contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), most_windows=most
    )
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in out.collect()) == want


# --- fingerprints


def test_fingerprints(spark, odd, none):
    got = fingerprints.fingerprints(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    assert fingerprints.fingerprints(none).count() == 0
    docs = [(i, "".join(random.Random(i).choices("ab é\n😀", k=i * 7))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    by = {r.doc_id: r for r in fingerprints.fingerprints(df.repartition(5)).collect()}
    for i, text in docs:
        following = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        r = by[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == fingerprints.as_text(fingerprints.fingerprint(text))
        assert r.edited_fingerprint == fingerprints.as_text(fingerprints.fingerprint(new))


def test_fingerprints_add_up():
    one = fingerprints.fingerprint
    a, b, c = "first paragraph, long enough", "short", "the third paragraph of this text"
    assert np.array_equal(one(f"{a}\n{b}\n{c}"), one(f"{c}\n{a}\n{b}"))
    assert np.array_equal(fingerprints.combined(one(f"{a}\n{b}"), one(c)), one(f"{a}\n{b}\n{c}"))
    assert np.array_equal(fingerprints.combined(one(f"{a}\n{b}\n{c}"), one(b), -1), one(f"{a}\n{c}"))
    assert not np.array_equal(one("a\n"), one("a"))
    long = "\n".join(f"line number {i} with some words" for i in range(60_000))
    assert np.array_equal(one(long), fingerprints.combined(one(long[: long.index("\n", 10**6)]), one(long[long.index("\n", 10**6) + 1 :])))


# --- sharding


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 25, 700])
def test_jump_hash(spark, n):
    got = spark.range(300).select(F.xxhash64("id").alias("k"), sharding.jump_hash(F.xxhash64("id"), n).alias("s")).collect()
    assert all(jump(r.k, n) == r.s for r in got)


def test_slots(spark, odd, none, clashing):
    for df in (odd, none, clashing):
        sharded = sharding.with_shard(df, ["doc_id"], 4)
        got = sharding.with_slots(sharded, ["doc_id", "text"]).collect()
        assert len(got) == df.count()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in by.values())


# --- mixing


def test_mixing_targets(spark):
    sizes = [("c", 50), ("a", 1000), ("b", 5), (None, 0), ("d", 400), ("é", 7)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    order = sorted((s for s, _ in sizes if s is not None)) + [None]
    weight, size = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, dict(sizes)
    want, free, left = {}, set(order), float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]}
        if not over:
            want |= {s: left * weight[s] / total for s in free}
            break
        want |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    assert got == pytest.approx(want)


def test_mix_meets_targets_and_agrees(spark, odd, none, clashing):
    docs = [(i, "w " * random.Random(i).randrange(60), "en", "abc"[i % 3], 0) for i in range(600)]
    docs += [(10_000, "w " * 20, "en", "a", 0)] * 300  # a hot row, repeated
    df = spark.createDataFrame(docs, SCHEMA)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    sizes = Counter()
    for _, text, _, source, _ in docs:
        sizes[source] += len(text.split())
    targets = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    assert all(abs(taken[s] - targets[s]) <= 60 for s in sizes)
    assert rows(mixing.mix(df.repartition(7))) == rows(mixed)
    each = Counter(r.doc_id for r in mixed.collect())
    assert all(n <= 3 for i, n in each.items() if i != 10_000) and each[10_000] <= 900
    assert mixing.mix(none).count() == 0
    assert mixing.mix(clashing).columns == clashing.columns
    assert {r.doc_id for r in mixing.mix(odd).collect()} <= {r[0] for r in ODD}


# --- near copies


def components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if sets[a][1] and sets[b][1] and 100 * both >= 85 * (len(sets[a][1]) + len(sets[b][1]) - both):
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return Counter((i, len(s), least.get(root(x)) if s else i) for x, (i, s) in enumerate(sets))


def test_near_components(spark, odd, none, monkeypatch):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(4000)}" for _ in range(n)] for n in (150, 150, 40, 12, 700)]
    docs = [(i, " ".join(b)) for i, b in enumerate(base)]
    chain = base[0]
    for i in range(10, 110):  # a chain of copies of copies
        chain = list(chain if rng.random() < 0.7 else base[rng.randrange(5)])
        for _ in range(rng.randrange(4)):
            chain[rng.randrange(len(chain))] = f"w{rng.randrange(4000)}"
        docs.append((i, " ".join(chain)))
    docs += [(200 + i, "the same few words in front " + " ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    docs += [(r[0], r[1]) for r in ODD]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    want = components(docs)
    get = lambda: Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_join.near_components(df).collect())
    assert get() == want
    monkeypatch.setattr(near_join, "BLOCK", 7)  # regions in blocks
    monkeypatch.setattr(near_join, "BLOCK_BYTES", 5000)
    assert get() == want
    assert near_join.near_components(none).count() == 0
    assert near_join.without_near_copies(none).columns == none.columns


def test_copies_around_the_bound(spark):
    """Copies of one text whose Jaccard is little below or above the bound: bitmaps can't tell all of them apart."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(150):
        text = list(base)
        for _ in range(4 if i % 3 else 3):  # each changed word changes four of 397 shingles
            at = rng.randrange(4, 390)
            text[at : at + 3] = [f"v{rng.randrange(10**6)}" for _ in range(3)]
        docs.append((i, " ".join(text)))
    want = components(docs)
    assert 20 < len({root for _, _, root in want}) < 150
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_join.near_components(df).collect())
    assert got == want
    # Near pairs grow with the square of the copies; what is handed on doesn't.
    found = [near_join.shingles(t) for _, t in docs]
    region = near_join._Set(np.array([len(x) for x in found]), [near_join.parity_bits(x) for x in found])
    near = sum(len(region.near(i, np.arange(i))) for i in range(150))
    assert near > 1000 and len(near_join._linked(found, np.arange(150), 85)) == 150 - len({root for _, _, root in want})
    assert len(near_join._apart(region, np.arange(150))) <= 150


def test_pipeline_drops_near_copies_by_its_own_rule(spark):
    rng = random.Random(12)
    docs = []
    for i in range(30):
        text = [f"w{rng.randrange(9000)}" for _ in range(rng.randrange(40, 120))]
        docs.append((i, " ".join(text)))
        for k in range(rng.randrange(3)):
            at = rng.randrange(len(text) - 6)  # a few words in a row change, which leaves a Jaccard around 0.8
            changed = text[:at] + [f"v{rng.randrange(9000)}" for _ in range(rng.randrange(1, 7))] + text[at + 3 :]
            docs.append((100 * (k + 1) + i, " ".join(changed)))
    sets = [(i, frozenset(tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4))) for i, t in docs]
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    name, changes = dict((i, i) for i, _ in sets), True
    while changes:
        changes = False
        for i, a in sets:
            for j, b in sets:
                if name[j] < name[i] and near(a, b):
                    name[i], changes = name[j], True
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    assert got == {i for i, x in name.items() if i == x}
    assert got != {r.doc_id for r in near_join.without_near_copies(df).collect()}


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(5)
    for n in (5, 60, 65, 300):
        a = np.unique(rng.integers(0, 1 << 58, n).astype(np.uint64))
        for changed in range(0, n // 5):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 58, changed).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            region = near_join._Set(np.array([len(a), len(b)]), [near_join.parity_bits(a), near_join.parity_bits(b)])
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert len(region.near(0, np.array([1])))


# --- toxicity


def test_toxicity_learns_and_is_stable(spark, odd, none):
    rng = random.Random(2)
    plain = lambda: [rng.choice(["sun", "tree", "river", "stone", "cloud", "field"]) for _ in range(rng.randrange(5, 120))]
    docs, labels = [], []
    for i in range(400):
        text, bad = plain(), i % 5 == 0
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["nasty", "vile"]))
        docs.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (7, None, None)]
    df, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, known)
    scored = toxicity.with_score(df, model).collect()
    out = {r.doc_id: r.score for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    right = sum((s >= 0.3) == (i % 5 == 0) for i, s in out.items())
    assert right >= 0.97 * len(out)
    again = {r.doc_id: r.score for r in toxicity.with_score(df.repartition(3), model).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-4 for r in scored)
    assert all(0 <= r.score <= 1 for r in toxicity.with_score(odd, model).collect())
    flat = toxicity.fit(none, known.limit(0))
    assert toxicity.with_score(odd, flat).count() == len(ODD)
    assert toxicity.without_toxic(none, df, known).columns == none.columns


def test_toxicity_learns_from_whole_texts():
    rng = random.Random(8)
    plain = lambda n: [rng.choice(["sun", "tree", "river", "stone", "cloud", "field"]) for _ in range(n)]
    texts, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        texts.append(" ".join(plain(450) + (["nasty", "vile"] if bad else []) * 4 + plain(rng.randrange(20))))
        labels.append(int(bad))
    model = toxicity.train(texts[:200], labels[:200])
    right = sum((s >= 0.3) == y for s, y in zip(toxicity.Scorer(model).scores(texts[200:]), labels[200:]))
    assert right >= 95


def test_long_runs_are_read_whole():
    rng = random.Random(9)
    run = "".join(rng.choice("日本語文字列中国泰") for _ in range(400)) + "x" * 100
    data, (codes, starts, ends) = toxicity.words_of("Short é " + run)
    found = [data[a:b].decode() for a, b in zip(starts, ends)]
    assert found[:2] == ["short", "é"] and len(codes) > 60 and max(map(len, found)) <= toxicity.LONGEST
    raw, grams = run.encode(), {g for w in found for k in toxicity.GRAMS for g in (w.encode()[j : j + k] for j in range(len(w.encode()) - k + 1))}
    assert all(raw[j : j + k] in grams for k in toxicity.GRAMS for j in range(len(raw) - k + 1))
    assert toxicity.words_of("ab " * 40)[0] == b"ab " * 40 and len(toxicity.words_of("y" * toxicity.LONGEST)[1][0]) == 1
    model = toxicity.Model(toxicity.Network(1), np.empty(0, np.uint64), np.array([0.5, 0.5, 0.0, 0.0]))
    scores = toxicity.Scorer(model).scores([run, run[:300] + "毒悪罵" * 9 + run[300:], "z" * 100, "z" * 90 + "毒悪罵"])
    assert len(set(scores)) == 4  # what comes after the first 64 bytes counts


def test_gradients_are_those_of_the_loss():
    network = toxicity.Network(3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    rng = np.random.default_rng(1)
    inputs, ids = rng.standard_normal((4, 2 * toxicity.WIDTH)), rng.integers(0, 4, (6, 2))
    there = np.ones((6, 2))
    there[4:, 1] = 0
    keep = {}
    network.logits(inputs, ids, there, keep)
    weight = np.array([0.7, -1.3])
    grads, _ = network.gradients(keep, there, weight)
    for name, grad in grads.items():
        at = tuple(rng.integers(0, n) for n in grad.shape)
        old, ends = network.p[name][at], []
        for step in (1e-4, -1e-4):
            network.p[name][at] = old + step
            ends.append(network.logits(inputs, ids, there, {}) @ weight)
        network.p[name][at] = old
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(grad[at], rel=2e-2, abs=1e-5)


# --- secrets and personal data


def test_secrets(spark, odd, none, clashing):
    rng = random.Random(4)
    docs = [(i, f'say token = "{rng.randbytes(20).hex()}" and supercalifragilisticwords https://x.org/{"a" * 30}') for i in range(40)]
    docs.append((99, "nothing here"))
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for i, text in docs[:-1]:
        start = text.index('"') + 1
        assert [(s.start, s.end) for s in got[i].secrets] == [(start, start + 40)] and got[i].n_candidates == 3
    assert got[99].n_candidates == 0 and got[99].score == 0
    for df in (odd, none, clashing):
        assert secrets.find_secrets(df).count() == df.count()


def test_secrets_assigned_without_quotes(spark):
    rng = random.Random(5)
    some = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    docs, want = [], {}
    for i in range(40):
        name, value = [
            ("API_KEY=", "AKIA" + some(16, letters)),
            ("x --token=", "ghp_" + some(36, letters + letters.lower())),
            ("export MY_COMPANY_ACCESS_KEY=", "AKIA" + some(16, letters)),
            ('MY_COMPANY_SECRET_TOKEN="', some(40, "0123456789abcdef")),
        ][i % 4]
        docs.append((i, f"{name}{value} and supercalifragilisticwords https://x.org/{'a' * 30}"))
        want[i] = [(len(name), len(name) + len(value))]
    docs.append((90, "data: YWJjZGVmZ2hpamtsbW5vcA== end"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.secrets] for r in secrets.find_secrets(df).collect()}
    assert {i: got[i] for i in want} == want
    found = df.where("doc_id in (1, 2, 90)").select("doc_id", F.inline(secrets.matches(F.col("text"), secrets.CANDIDATE, across=True))).collect()
    said = {(r.doc_id, r.said): r.before for r in found}
    assert said[90, "YWJjZGVmZ2hpamtsbW5vcA=="] == "data: "
    assert said[1, docs[1][1].split("=")[1].split()[0]] == "x --token="
    assert said[2, docs[2][1].split("=")[1].split()[0]] == "export MY_COMPANY_ACCESS_KEY="[-24:]


def test_rare_labels_are_learnt(spark):
    rng = random.Random(7)
    words = [f"{w}-{v}-pages/{u}" for w in ("image", "upload", "content", "static") for v in ("release", "download", "a" * 9, "bcdefghij") for u in range(4)]
    docs = [(i, "\n".join(f"{rng.choice(words)}{'z' * rng.randrange(12)} and {'q' * rng.randrange(3, 9)}longwordofletters" for _ in range(40))) for i in range(200)]
    docs += [(900 + i, f'token = "{rng.randbytes(20).hex()}"') for i in range(4)]
    docs.append((990, f'token = "{rng.randbytes(20).hex().upper()}"'))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: len(r.secrets) for r in secrets.find_secrets(df).collect()}
    assert got[990] == 1 and all(got[900 + i] == 1 for i in range(4)) and not any(got[i] for i in range(200))


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    holds = (
        lambda m: True,
        lambda m: all(int(x) <= 255 for x in m.split(".")),
        lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)),
        lambda m: 10 <= len(digits(m)) <= 15,
    )
    return sorted((m.start(), k, m.end()) for k, p in enumerate((EMAIL, IP, CARD, PHONE)) for m in p.finditer(text or "") if holds[k](m.group()))


def test_pii(spark, odd, none, clashing):
    rng = random.Random(6)
    fixed = ["a@b.c_d@e.f-g", "😀x.y@z.org!", "1.2.3.4.5.6.7.8", "0001.02.255.256 001.2.3.255", "4111 1111 1111 1111", "4111111111111111 12", "+1 (523) 555-1055", "+49 30 1234567890123456", "a@b a@.c @", "1" * 3000, "1 " * 4000, "a." * 4000 + "@"]
    texts = fixed + ["".join(rng.choices("ab@.1234567890 -+()é_%", k=120)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for i, text in enumerate(texts):
        assert [tuple(b) for b in got[i].base] == base(text), text[:200]
        spans = [tuple(s) for s in got[i].spans]
        assert set(base(text)) <= set(spans) and spans == sorted(set(spans))
    for some in (odd, none, clashing):
        assert pii.find_pii(some).count() == some.count()
    marked = df.where("doc_id in (1, 6)").select(pii.redacted(F.col("text"), pii.base_spans(F.col("text")), "#").alias("t")).collect()
    assert {r.t for r in marked} == {"😀#!", "#"}


# --- odd input for all that return documents


def test_odd_documents(odd, none, clashing, spark):
    benchmark = spark.createDataFrame([(1, "one two three"), (None, "no id here none"), (2, None)], "item_id bigint, text string")
    for df in (odd, none, clashing):
        assert decontamination.find_contamination(df, benchmark).count() == df.count()
        assert decontamination.without_contaminated(df, benchmark).columns == df.columns
        assert decontamination.find_contamination(df, benchmark.limit(0)).where("contaminated").count() == 0
        assert near_join.without_near_copies(df).columns == df.columns
        assert licenses.license_report(df, "doc_id").count() == df.count()
        assert line_dedup.without_repeated_lines(df).count() == df.count()


def test_components_of_long_chains(spark, monkeypatch):
    monkeypatch.setattr(near_join, "CHUNK", 5)
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (200, 200)] + [(50 + i, 50) for i in range(1, 9)]
    random.Random(3).shuffle(links)
    df = spark.createDataFrame(links, "u bigint, v bigint").repartition(4)
    got = {tuple(r) for r in near_join.components(df).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(101, 100), (103, 100)} | {(50 + i, 50) for i in range(1, 9)}


def python_operators(plan):
    """The most Python operators that a task runs at once: in this node's stage, and in any stage below."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return python_operators(plan.executedPlan())
    children = plan.children()
    below = [python_operators(children.apply(i)) for i in range(children.size())]
    here, most = sum(x for x, _ in below) + name.startswith(("MapInArrow", "ArrowEvalPython")), max([x for _, x in below], default=0)
    return (0 if name.endswith("Exchange") else here), max(here, most)


def test_near_copies_take_one_python_worker_a_task(spark, monkeypatch):
    found, keep = [], near_join.kept

    def spied(df):
        found.append(python_operators(df._jdf.queryExecution().executedPlan())[1])
        return keep(df)

    monkeypatch.setattr(near_join, "kept", spied)
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "another text that is like none of them")], "doc_id bigint, text string")
    assert {r.doc_id for r in near_join.without_near_copies(df).collect()} == {1, 3}
    assert max(found) == 1, found


def test_scorer_remembers_words_in_one_copy(monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}é" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(300)]
    model = toxicity.train(texts[:40], [i % 2 for i in range(40)])
    want = toxicity.Scorer(model).scores(texts)
    monkeypatch.setattr(toxicity.Scorer, "BATCH", 512)
    monkeypatch.setattr(toxicity.Scorer, "MOST_WORDS", 700)  # forgets, and grows beyond what is set aside
    scorer = toxicity.Scorer(model)
    assert np.allclose([s for i in range(0, 300, 10) for s in scorer.scores(texts[i : i + 10])], want, atol=1e-6)
    assert np.allclose(scorer.scores(texts), want, atol=1e-6)
    scorer.forget()
    held = scorer.projected["f"]
    scorer.scores(texts[:1])
    scorer.scores(texts[1:2])
    assert scorer.projected["f"] is held and len(set(scorer.at.tolist())) == len(scorer.known)


def test_components_write_few_files_for_few_links(spark, monkeypatch):
    written, keep = [], near_join.kept

    def spied(df):
        out = keep(df)
        written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_join, "kept", spied)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(40)], "u bigint, v bigint").repartition(4)
        assert {tuple(r) for r in near_join.components(links).collect()} == {(i, 0) for i in range(1, 41)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(written) > 2 and set(written[2:]) == {1}, written
