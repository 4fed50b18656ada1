"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network with calibrated probabilities.

Tokens are words and marks, each also as a shape, so that unseen words still say something. Every
token has a sparse ternary index vector that follows from its hash. A known token's vector is its
index vector plus the damped sum of its neighbours' index vectors in the sample (random indexing);
other tokens have their index vector alone. A document is the mean of its tokens' vectors with a few
ratios (length, distinct tokens, repeated lines). A two-layer network, trained with numpy in the
driver, gives a logit; a temperature fitted on a validation part of the sample makes it a probability.

The sample: at most sample_rows labels of documents that are not held out, those of smallest id hash;
whole texts, which stay on the executors. Nothing else is learnt from, and the scoring is narrow.

Defined cases: null and empty texts are scored as a document without tokens; without any usable
label every score is 0.5; null labels are ignored, repeated labels count each, ties of a hash go by
the label; rows may repeat and ids may be null; very long texts are read whole, one at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, held_out, in_slices, settle

DIM, NONZERO, EXTRA, KNOWN, REMEMBER = 96, 8, 6, 20_000, 300_000
_token = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def tokens(text: str) -> list[str]:
    return _token.findall(text)


def shape(token: str) -> str:
    """Letters: their case and length; marks: themselves, cut; digits: their number."""
    if token[0].isalpha():
        case = "U" if len(token) > 1 and token.isupper() else "C" if token[0].isupper() else "l"
        return f"{case}{min(len(token), 12)}"
    return f"d{min(len(token), 8)}" if token[0].isdigit() else f"m{token[:3]}"


def index_vectors(names: list[str]) -> np.ndarray:
    """Sparse ternary vectors that follow from the names' hashes."""
    out = np.zeros((len(names), DIM), np.float32)
    h, at = np.fromiter((zlib.crc32(n.encode()) for n in names), np.uint64, len(names)), np.arange(len(names))
    for k in range(NONZERO):
        z = (h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out[at, ((z >> np.uint64(33)) % np.uint64(DIM)).astype(np.int64)] += np.where((z >> np.uint64(20)) & np.uint64(1), 1, -1)
    return out / np.sqrt(NONZERO).astype(np.float32)


def ratios(text: str, n: int, counts: Counter) -> list[float]:
    lines = [x for x in text.split("\n") if x.strip()]
    return [np.log1p(n) / 8, len(counts) / n if n else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0, sum(c for w, c in counts.items() if not w[0].isalpha()) / n if n else 0.0, n / (1 + len(text)), sum(c for w, c in counts.items() if w.isupper()) / n if n else 0.0]


class TokenMemory:
    """Vectors of the tokens seen so far; emptied when full."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, DIM), np.float16)

    def take(self, model: QualityModel, words: set[str]) -> None:
        if len(self.place) > REMEMBER:
            self.place.clear()
        new = sorted(words.difference(self.place))
        n, m = len(self.place), len(self.place) + len(new)
        if m > len(self.rows):
            self.rows = np.concatenate([self.rows[:n], np.zeros((2 * m - n, DIM), np.float16)])
        if new:
            self.rows[n:m] = model.token_vectors(new)
            self.place.update(zip(new, range(n, m), strict=True))


class QualityModel:
    def __init__(self, vectors: dict[str, np.ndarray]) -> None:
        self.vectors, self.layers, self.temperature = vectors, None, 1.0

    def token_vectors(self, words: list[str]) -> np.ndarray:
        out = index_vectors(words)
        for i, w in enumerate(words):
            if (v := self.vectors.get(w)) is not None:
                out[i] = v
        return 0.5 * out + index_vectors(["shape " + shape(w) for w in words])

    def pooled(self, texts: list[str], memory: TokenMemory) -> np.ndarray:
        """One vector a text."""
        out, found = np.zeros((len(texts), DIM + EXTRA), np.float32), [tokens(t) for t in texts]
        memory.take(self, {w for words in found for w in words})
        for i, (text, words) in enumerate(zip(texts, found, strict=True)):
            n = Counter(words)
            if words:
                k = np.fromiter(map(memory.place.__getitem__, n), np.int64, len(n))
                out[i, :DIM] = np.fromiter(n.values(), np.float32, len(n)) @ memory.rows[k].astype(np.float32) / len(words)
            out[i, DIM:] = ratios(text, len(words), n)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, hidden: int = 48, epochs: int = 60, seed: int = 5) -> None:
        """Adam on the log loss of a tanh layer and a logit; the epoch with the least validation loss stays."""
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        cut = max(1, len(x) * 4 // 5)
        train, check = order[:cut], order[cut:] if cut < len(x) else order
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, best, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], (np.inf, p), 0
        loss = lambda z, t: float(np.mean(np.logaddexp(0, z) - t * z))
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
                a, t = x[part], y[part]
                h = np.tanh(a @ p[0] + p[1])
                g = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - t) / len(part)
                back = np.outer(g, p[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                step += 1
                for k, d in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    p[k] = p[k] - 2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if (now := loss(np.tanh(x[check] @ p[0] + p[1]) @ p[2] + p[3], y[check])) < best[0]:
                best = (now, [a.copy() for a in p])
        self.layers = best[1]
        z = self._logit(x[check])
        self.temperature = min(np.geomspace(0.2, 5, 60), key=lambda t: loss(z / t, y[check]))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.layers
        return np.tanh(x @ w + b) @ u + c

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(pooled), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._logit((pooled - self.mean) / self.scale) / self.temperature, -60, 60)))


def frequent_tokens(sample: DataFrame) -> list[str]:
    """The KNOWN most frequent tokens of the sample, ties in order of the token."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text"):
            n = Counter(w for t in b.column("text").to_pylist() for w in tokens(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["w", "n"])

    counts = arrow_rows(sample.select("text"), work, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(KNOWN).collect()]


def neighbour_counts(texts: list[str], known: dict[str, int], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, times): pair a * len(known) + b where known tokens a and b stand within reach of each other."""
    n, pairs = len(known), [np.zeros(0, np.int64)]
    for t in texts:
        ids = np.array([known.get(w, -1) for w in tokens(t)], np.int64)
        for d in range(1, reach + 1):
            a, b = ids[:-d], ids[d:]
            a, b = a[k := (a >= 0) & (b >= 0)], b[k]
            pairs += [a * n + b, b * n + a]
    return np.unique(np.concatenate(pairs), return_counts=True)


def word_vectors(sample: DataFrame, reach: int = 2) -> dict[str, np.ndarray]:
    """Random indexing over the sample, on the executors; the driver gets at most KNOWN vectors.

    Pairs of neighbours are counted batch by batch and added up before a token's vector is made, so that a frequent
    token's group holds at most KNOWN rows.
    """
    names = frequent_tokens(sample)
    known, n = {w: i for i, w in enumerate(names)}, len(names)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text", 2 << 20):
            pair, times = neighbour_counts(b.column("text").to_pylist(), known, reach)
            yield pa.RecordBatch.from_arrays([pa.array(pair // max(n, 1)), pa.array(pair % max(n, 1)), pa.array(times)], names=["a", "b", "n"])

    def context(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        total = pdf["n"].to_numpy(float) @ index_vectors([names[b] for b in pdf["b"]]).astype(float)
        return pd.DataFrame({"a": [key[0]], "v": [total / max(np.linalg.norm(total), 1e-6)]})

    counted = arrow_rows(sample.select("text"), pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    vectors = index_vectors(names)
    for r in counted.groupBy("a").applyInPandas(context, "a long, v array<double>").collect():
        vectors[r["a"]] += 0.5 * np.array(r["v"], np.float32)
    return dict(zip(names, vectors, strict=True))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """The driver gets the sample's ids, tokens, vectors and pooled features, all bounded by sample_rows and KNOWN; texts stay on the executors."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(~held_out() & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    chosen = marked.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("h", "y").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # At most sample_rows ids, whatever the size of the tables: small enough to broadcast. Of rows that repeat an id, the text of smallest hash counts.
    ids = F.broadcast(chosen.groupBy("doc_id").agg(F.min("h").alias("h"), F.sort_array(F.collect_list("y")).alias("ys")))
    sample = texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "h", "ys", "text")).alias("s"))
    sample = settle(sample.select("s.h", "s.ys", "s.text"), "sample")
    model = QualityModel(word_vectors(sample))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = TokenMemory()
        for b in in_slices(batches, "text"):
            x = model.pooled(b.column("text").to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("ys"), pa.array(list(x), pa.list_(pa.float32()))], names=["h", "ys", "x"])

    rows = arrow_rows(sample, pool, "h long, ys array<int>, x array<float>").select("h", "x", F.explode("ys").alias("y")).collect()
    rows.sort(key=lambda r: (r["h"], r["y"], r["x"]))
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) == 2:
        model.fit(np.array([r["x"] for r in rows]), y)
    return model


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one for each row of docs. Narrow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = TokenMemory()
        for b in in_slices(batches, "text"):
            s = model.score(model.pooled([x or "" for x in b.column("text").to_pylist()], memory))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s.astype(float)), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return arrow_rows(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, learn(docs, labels))
