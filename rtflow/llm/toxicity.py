"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a vector of its own (of words that training has met) joined with the mean of the
vectors of its character n-grams. Texts are read in overlapping windows; a window's states are
pooled by attention into a logit. A text's score is the calibrated greatest logit of its windows.

The network learns from at most ``SAMPLE`` labelled documents, in one task that sends back the weights;
scoring runs where the documents are.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rtflow.llm.common import free_name
from rtflow.llm.pywords import ALNUM, coded, lowered, mixed

#: Words of a window and from one window's start to the next's, so that windows overlap.
WINDOW, STRIDE = 24, 16
#: Size of word and n-gram vectors, of the state of each direction, and log2 of the n-gram buckets.
WIDTH, STATE, BUCKETS = 8, 8, 14
#: Characters (bytes) of n-grams; a word stands between marks.
GRAMS = (3, 4, 5, 6)
#: Runs of more bytes than this are words of pieces of so many bytes, neighbours sharing so many.
LONGEST, PIECE, SHARED = 64, 24, GRAMS[-1] - 1
#: Words whose n-grams are made together, so that this takes bounded memory.
WORDS_AT_ONCE = 50_000
#: Labelled documents to learn from at most, each with its whole text, and passes.
SAMPLE, EPOCHS = 2500, 3
THRESHOLD = 0.3
SEED = 11


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document must not be learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, word by word, and where each word's begin."""
    if len(words) > WORDS_AT_ONCE:
        parts = [grams_of(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        before = np.cumsum([0, *[len(ids) for ids, _ in parts[:-1]]])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([at + n for (_, at), n in zip(parts, before)])
    marked = [b"\x02" + w + b"\x03" for w in words]
    sizes = np.array([len(w) for w in marked])
    ends = np.repeat(np.cumsum(sizes), sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    at = np.arange(len(raw))
    ids, of = [], []
    for size in GRAMS:
        n = max(0, len(raw) - size + 1)
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = h * np.uint64(257) + raw[k : k + n]
        within = at[:n] + size <= ends[:n]
        ids.append((mixed(h[within]) >> np.uint64(64 - BUCKETS)).astype(np.int32))
        of.append(word[:n][within])
    ids, of = np.concatenate(ids), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return ids[order], np.searchsorted(of[order], np.arange(len(words)))


_LONG = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]{%d,}" % (LONGEST + 1))


def _pieces(run: re.Match) -> bytes:
    """A long run in pieces of whole characters, separated by blanks; each n-gram is in one of them."""
    data, out, start = run[0], [], 0

    def character(i: int) -> int:
        while i < len(data) and data[i] & 0xC0 == 0x80:
            i -= 1
        return min(i, len(data))

    while True:
        end = character(start + PIECE)
        out.append(data[start:end])
        if end == len(data):
            return b" ".join(out)
        start = character(end - SHARED)


def words_of(text: str | None) -> tuple[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The text as bytes, and the codes, starts and ends of its words in them.

    Writing without blanks makes runs of any length; long ones are taken in pieces, so that they
    spread over windows as other texts do.
    """
    data = lowered(text)
    found = coded(data, ALNUM)
    if len(found[0]) and (found[2] - found[1]).max() > LONGEST:
        data = _LONG.sub(_pieces, data)
        found = coded(data, ALNUM)
    return data, found


def starts_of(n: int) -> range:
    """Where windows start in a text of n words: the last one reaches the end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)


class Network:
    """Parameters by name, float32, and the forward and backward passes."""

    def __init__(self, n_words: int):
        r, d, h = np.random.default_rng(SEED), 2 * WIDTH, STATE
        make = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"words": make(n_words, WIDTH, scale=0.3), "grams": make(1 << BUCKETS, WIDTH, scale=0.3)}
        for side in "fb":
            self.p |= {f"W{side}": make(d, 3 * h, scale=0.3), f"U{side}": make(h, 3 * h, scale=0.3), f"c{side}": make(3 * h, scale=0.01)}
        self.p |= {"A": make(2 * h, scale=0.3), "v": make(2 * h, scale=0.3), "o": np.zeros(1, np.float32)}

    def table(self, gram_ids: np.ndarray, gram_at: np.ndarray, word_ids: np.ndarray) -> np.ndarray:
        """Inputs of distinct words: word vector (row 0: unknown words) and mean n-gram vector."""
        counts = np.diff(np.append(gram_at, len(gram_ids)))[:, None]
        grams = np.add.reduceat(self.p["grams"][gram_ids], gram_at, axis=0) / counts
        return np.concatenate([self.p["words"][word_ids], grams], 1).astype(np.float32)

    def side(self, s: str, projected: np.ndarray, there: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, window, STATE) of one direction; ``projected`` (time, window, 3 STATE)."""
        u, c, n = self.p[f"U{s}"], self.p[f"c{s}"], STATE
        h = np.zeros((projected.shape[1], n), projected.dtype)
        out = np.empty((*projected.shape[:2], n), projected.dtype)
        for t in range(len(projected)) if s == "f" else reversed(range(len(projected))):
            x, hu = projected[t] + c, h @ u
            gates = 0.5 * np.tanh(0.5 * (x[:, : 2 * n] + hu[:, : 2 * n])) + 0.5
            z, r = gates[:, :n], gates[:, n:]
            g = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
            new = h + there[t, :, None] * (1 - z) * (g - h)
            if keep is not None:
                keep.append((t, h, z, r, g, hu))
            out[t] = h = new
        return out

    def logits(self, inputs: np.ndarray, words: np.ndarray, there: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit per window; ``words`` (time, window) are rows of ``inputs``, ``there`` is 0 beyond a text's end."""
        steps = {s: [] if keep is not None else None for s in "fb"}
        if keep is None:  # projecting each distinct word once is enough
            states = [self.side(s, (inputs @ self.p[f"W{s}"])[words], there, None) for s in "fb"]
        else:
            x = inputs[words]
            states = [self.side(s, x @ self.p[f"W{s}"], there, steps[s]) for s in "fb"]
        h = np.concatenate(states, 2)
        e = h @ self.p["A"] + 40 * (there - 1)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tw,twd->wd", a, h)
        if keep is not None:
            keep |= {"steps": steps, "h": h, "a": a, "pooled": pooled, "x": x}
        return pooled @ self.p["v"] + self.p["o"][0]

    def gradients(self, keep: dict, there: np.ndarray, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients by parameter, and of the inputs (time, window, width)."""
        p, n, h, a = self.p, STATE, keep["h"], keep["a"]
        g = {"v": keep["pooled"].T @ d_logit, "o": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["v"]
        dot = np.einsum("wd,twd->tw", d_pooled, h)
        de = a * (dot - (a * dot).sum(0))
        g["A"] = np.einsum("tw,twd->d", de, h)
        dh_all = a[:, :, None] * d_pooled + de[:, :, None] * p["A"]
        dx = np.zeros_like(keep["x"])
        for s, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            u, w = p[f"U{s}"], p[f"W{s}"]
            du, dw, dc = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * n, np.float32)
            dh = np.zeros((h.shape[1], n), np.float32)
            for t, old, z, r, c, hu in reversed(keep["steps"][s]):
                dh = dh + dh_all[t, :, part]
                m = there[t, :, None]
                dc_ = dh * m * (1 - z) * (1 - c * c)
                dz = dh * m * (old - c) * z * (1 - z)
                dr = dc_ * hu[:, 2 * n :] * r * (1 - r)
                pre = np.concatenate([dz, dr, dc_], 1)
                back = np.concatenate([dz, dr, dc_ * r], 1)
                du += old.T @ back
                dw += keep["x"][t].T @ pre
                dc += pre.sum(0)
                dx[t] += pre @ w.T
                dh = dh * (1 - m * (1 - z)) + back @ u.T
            g |= {f"U{s}": du, f"W{s}": dw, f"c{s}": dc}
        return g, dx


def _summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows."""
    order = np.argsort(ids, kind="stable")
    distinct, at = np.unique(ids[order], return_index=True)
    return distinct, np.add.reduceat(rows[order], at, axis=0)


def _windows(ids: np.ndarray, start: int) -> np.ndarray:
    part = ids[start : start + WINDOW]
    return part if len(part) == WINDOW else np.concatenate([part, np.full(WINDOW - len(part), -1, part.dtype)])


class Model:
    """A trained network with its words and calibration; small, and broadcast for scoring."""

    def __init__(self, network: Network, codes: np.ndarray, scale: np.ndarray):
        self.network, self.codes, self.scale = network, codes, scale

    def __getstate__(self):
        return {"p": self.network.p, "codes": self.codes, "scale": self.scale}

    def __setstate__(self, state):
        self.network = Network.__new__(Network)
        self.network.p = state["p"]
        self.codes, self.scale = state["codes"], state["scale"]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.scale, -30, 30)))


class Scorer:
    """Scores texts with a model; remembers the inputs of words it has met, up to a bound."""

    MOST_WORDS = 300_000
    BATCH = 4096

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)
        # Rows are appended; pages of them that have not been written yet take no memory.
        self.projected = {s: np.empty((2 * self.MOST_WORDS, 3 * STATE), np.float32) for s in "fb"}

    def places(self, datas: list[bytes], coded_: list[tuple]) -> list[np.ndarray]:
        """Rows of the projected inputs for the words of each text."""
        codes = np.concatenate([c[0] for c in coded_])
        distinct, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.known) > self.MOST_WORDS:
            self.forget()
        new = ~np.isin(distinct, self.known, assume_unique=True)
        if new.any():
            ends = np.cumsum([len(c[0]) for c in coded_])
            grams = []
            for at in first[new].tolist():
                doc = int(np.searchsorted(ends, at, "right"))
                i = at - (int(ends[doc - 1]) if doc else 0)
                grams.append(datas[doc][coded_[doc][1][i] : coded_[doc][2][i]])
            words = np.searchsorted(self.model.codes, distinct[new])
            words = np.minimum(words, len(self.model.codes) - 1)
            ids = np.where(self.model.codes[words] == distinct[new], words + 1, 0) if len(self.model.codes) else np.zeros(int(new.sum()), int)
            parts = [slice(i, i + self.BATCH) for i in range(0, len(grams), self.BATCH)]
            rows = np.concatenate([self.model.network.table(*grams_of(grams[x]), ids[x]) for x in parts])
            n, end = len(self.known), len(self.known) + len(rows)
            for s in "fb":
                if end > len(self.projected[s]):
                    self.projected[s] = np.concatenate([self.projected[s][:n], np.empty((end - n, 3 * STATE), np.float32)])
                self.projected[s][n:end] = rows @ self.model.network.p[f"W{s}"]
            order = np.argsort(all_ := np.concatenate([self.known, distinct[new]]))
            self.known, self.at = all_[order], np.concatenate([self.at, np.arange(n, end)])[order]
        rows = self.at[np.searchsorted(self.known, distinct)][inverse]
        return np.split(rows, np.cumsum([len(c[0]) for c in coded_])[:-1])

    def scores(self, texts: list[str | None]) -> list[float]:
        """The calibrated score of each text."""
        return self.model.probability(self.evidence(texts)).tolist()

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Per text: its windows' two greatest logits, the logarithm of their number, and 1.

        The greatest of many is great by chance, so their number counts. A text without words has
        the logit of nothing, and one of a single window has it twice.
        """
        datas, found = zip(*map(words_of, texts), strict=True) if texts else ((), ())
        rows = self.places(datas, found) if any(len(c[0]) for c in found) else [np.empty(0, int)] * len(texts)
        held, owner, found = [], [], []
        for i, ids in enumerate(rows):
            for start in starts_of(len(ids)):
                held.append(_windows(ids, start))
                owner.append(i)
                if len(held) == self.BATCH:
                    found.append(self.logits(np.stack(held, 1)))
                    held.clear()
        if held:
            found.append(self.logits(np.stack(held, 1)))
        out = np.zeros((len(texts), 4))
        out[:, :2], out[:, 3] = self.model.network.p["o"][0], 1
        if owner:
            owner, found = np.array(owner), np.concatenate(found)
            order = np.lexsort((-found, owner))
            has, first, n = np.unique(owner[order], return_index=True, return_counts=True)
            found = found[order]
            out[has, 0], out[has, 1], out[has, 2] = found[first], found[first + np.minimum(n - 1, 1)], np.log(n)
        return out

    def logits(self, words: np.ndarray) -> np.ndarray:
        there = (words >= 0).astype(np.float32)
        network, words = self.model.network, np.maximum(words, 0)
        h = np.concatenate([network.side(s, self.projected[s][words], there) for s in "fb"], 2)
        e = h @ network.p["A"] + 40 * (there - 1)
        a = np.exp(e - e.max(0))
        return np.einsum("tw,twd->wd", a / a.sum(0), h) @ network.p["v"] + network.p["o"][0]


def train(texts: list[str | None], toxic: list[int]) -> Model:
    """Learn from documents' labels: a document's windows share its label, and the scale is set afterwards."""
    rng = np.random.default_rng(SEED)
    datas, found = zip(*map(words_of, texts), strict=True) if texts else ((), ())
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max() or not sum(len(c[0]) for c in found):
        mean = float(y.mean()) if len(y) else 0.0
        flat = Network(1)
        flat.p["v"][:] = 0
        scale = np.array([0, 0, 0, np.log((mean + 1e-3) / (1 - mean + 1e-3))])
        return Model(flat, np.empty(0, np.uint64), scale)
    codes = np.concatenate([c[0] for c in found])
    distinct, first, inverse, counts = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
    common = distinct[counts >= 4]
    place = np.searchsorted(common, distinct)
    word_ids = np.where((counts >= 4), np.minimum(place, max(0, len(common) - 1)) + 1, 0)
    ends = np.cumsum([len(c[0]) for c in found])
    grams = []
    for at in first.tolist():
        doc = int(np.searchsorted(ends, at, "right"))
        i = at - (int(ends[doc - 1]) if doc else 0)
        grams.append(datas[doc][found[doc][1][i] : found[doc][2][i]])
    gram_ids, gram_at = grams_of(grams)
    gram_ends = np.append(gram_at[1:], len(gram_ids))
    docs = np.split(inverse.astype(np.int32), ends[:-1])
    windows_, owner = [], []
    for i, ids in enumerate(docs):
        for start in starts_of(len(ids)):
            windows_.append(_windows(ids, start))
            owner.append(i)
    windows_, owner = np.stack(windows_, 1), np.array(owner)
    # A fifth of the documents only sets the scale, as logits of what has been learnt are too sure.
    for_scale = rng.random(len(texts)) < 0.2
    learnt = np.flatnonzero(~for_scale[owner])
    network = Network(len(common) + 1)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(learnt), max(1, len(learnt) // 256)):
            step += 1
            words = windows_[:, batch]
            there = (words >= 0).astype(np.float32)
            used, local = np.unique(np.maximum(words, 0), return_inverse=True)
            pick = np.concatenate([np.arange(gram_at[w], gram_ends[w]) for w in used])
            sizes = (gram_ends - gram_at)[used]
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            inputs = network.table(gram_ids[pick], at, word_ids[used])
            keep: dict = {}
            logit = network.logits(inputs, local.reshape(words.shape), there, keep)
            d = ((1 / (1 + np.exp(-logit)) - y[owner[batch]]) / len(batch)).astype(np.float32)
            g, dx = network.gradients(keep, there, d)
            _, d_in = _summed(local.reshape(-1), (dx * there[:, :, None]).reshape(-1, 2 * WIDTH))
            rows = {"words": (word_ids[used], d_in[:, :WIDTH]), "grams": (gram_ids[pick], np.repeat(d_in[:, WIDTH:] / sizes[:, None], sizes, 0))}
            for k, grad in g.items():
                m, v = state[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                network.p[k] -= 0.01 * m / (np.sqrt(v) + 1e-6)
            for k, (ids, grad) in rows.items():
                u, total = _summed(ids, grad)
                v = state[k][1]
                v[u] += total * total
                network.p[k][u] -= 0.1 * total / (np.sqrt(v[u]) + 1e-6)
    model = Model(network, common, np.array([0.5, 0.5, 0.0, 0.0]))
    if len(set(y[for_scale].tolist())) < 2:
        for_scale[:] = True
    chosen = np.flatnonzero(for_scale)
    x, y = Scorer(model).evidence([texts[i] for i in chosen]), y[chosen]
    prior, weight = model.scale.copy(), np.array([1.0, 1.0, 1.0, 1e-3])

    def loss(scale: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ scale).sum() - y @ (x @ scale) + weight @ (scale - prior) ** 2 / 2)

    for _ in range(100):  # logistic regression with a weak prior, by damped Newton steps
        q = model.probability(x)
        gradient = x.T @ (q - y) + weight * (model.scale - prior)
        move = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(weight), gradient)
        size, now = 1.0, loss(model.scale)
        while size > 1e-6 and loss(model.scale - size * move) > now:
            size /= 2
        model.scale = model.scale - size * move
        if np.abs(move).max() < 1e-6 or size <= 1e-6:
            break
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled documents, those with the least hashes, none held out.

    Rows with a null label or a null id are passed over; of rows that share ids, at most twice as many are
    read. Without labels of both kinds, the model gives every text the share of toxic labels. The texts go
    to one task, whose size the sample bounds, and only the model comes to the driver.
    """
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    # At most ``sample`` rows, so the broadcast is bounded.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", F.xxhash64("text")).limit(2 * sample)
    rows = rows.select("text", "toxic").coalesce(1)
    learnt = rows.mapInArrow(_learn, "model binary").first()
    if learnt is None:
        return train([], [])
    model = Model.__new__(Model)
    model.__setstate__(pickle.loads(learnt.model))
    return model


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, toxic = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        toxic += batch.column("toxic").to_pylist()
    if texts:
        yield pa.record_batch([pa.array([pickle.dumps(train(texts, toxic).__getstate__())], pa.binary())], ["model"])


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` and the score of each row's whole text, 0 to 1; null and empty texts have one too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            out, held, size = [], [], 0
            for text in texts:
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size > 1 << 20:
                    out += scorer.scores(held)
                    held, size = [], 0
            if held:
                out += scorer.scores(held)
            yield pa.array(out, pa.float64())

    return docs.withColumn(name, score(F.col("text")))


def without_toxic(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under the threshold, with the columns they came with."""
    score, = free_name(docs, "score")
    return with_score(docs, fit(train_docs, labels), score).where(F.col(score) < THRESHOLD).drop(score)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """A toxicity score for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
