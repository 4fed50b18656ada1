"""Language ID by multilingual mixture inference.

Letters of a text, in lower case and with runs of anything else as one blank, give overlapping
character n-grams (hashed to a fixed number of cells). A language is a smoothed distribution over
cells, learnt from labelled texts. Each document is a mixture: expectation-maximisation over its
n-gram counts estimates the proportion of each language; then languages leave one by one, the
smallest proportion first, as long as the penalised likelihood (BIC: half a log of the number of
n-grams for each language kept) does not fall. The language of the largest proportion is predicted,
with that proportion as the score; ties go to the first in the alphabet.

Defined cases: a null text, or one without a letter, is 'und' with score 0; if no labelled text has
a letter, all are; rows may repeat, ids may be null; empty tables give empty results; other columns
are ignored. Very long texts are read whole (a slice of a batch holds one of them). Learning takes at most sample_rows labelled texts, those of smallest id hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, held_out, in_slices, smallest_hashes

CELLS, WIDTH = 1 << 15, 3
UNKNOWN = "und"
_other = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Cells of the text's n-grams, with repeats; none if it has no letter."""
    core = _other.sub(" ", text.lower()).strip(" ")
    if not core:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {core} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = np.zeros(len(c) - WIDTH + 1, np.uint64)
    for k in range(WIDTH):
        h = h * np.uint64(0x100000001B3) + c[k : len(c) - WIDTH + 1 + k]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


class Languages:
    """names in order; chance[cell, k]: probability of the cell in language k."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.names = sorted(counts)
        n = np.stack([counts[k] for k in self.names], axis=1) if counts else np.zeros((CELLS, 0))
        self.chance = (n + 0.5) / (n.sum(axis=0) + 0.5 * CELLS)

    def mixtures(self, cells: list[np.ndarray], rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (documents x languages) after the choice of the language set, for documents with n-grams."""
        d, k = len(cells), len(self.names)
        owner = np.repeat(np.arange(d), [len(c) for c in cells])
        key, n = np.unique(owner * CELLS + np.concatenate(cells), return_counts=True)
        owner, p = key // CELLS, self.chance[key % CELLS].astype(np.float32)
        starts, total = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), np.bincount(owner, weights=n)
        weight = n.astype(np.float32)

        def fit(kept: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            share = kept * at
            share = np.where(share.sum(1, keepdims=True) > 0, share, kept)
            share = (share / share.sum(1, keepdims=True)).astype(np.float32)
            for _ in range(rounds):
                r = p * share[owner]
                s = r.sum(1)
                share = np.add.reduceat(r * (weight / s)[:, None], starts) / total[:, None].astype(np.float32)
            return share, np.add.reduceat(weight * np.log((p * share[owner]).sum(1)), starts)

        kept = np.ones((d, k))
        share, fitted = fit(kept, kept)
        value = fitted - 0.5 * np.log(total) * k
        for left in range(k - 1, 0, -1):
            fewer = kept.copy()
            least = np.where(kept > 0, share, np.inf).argmin(1)
            able = kept.sum(1) == left + 1
            fewer[np.arange(d)[able], least[able]] = 0
            if not able.any():
                break
            new_share, new_fit = fit(fewer, share)
            new_value = new_fit - 0.5 * np.log(total) * left
            better = able & (new_value >= value)
            kept[better], share[better], value[better] = fewer[better], new_share[better], new_value[better]
        return share, value

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[list[float]]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        shares = [[0.0] * len(self.names) for _ in texts]
        cells = [grams(t) for t in texts]
        full = [i for i, c in enumerate(cells) if len(c)]
        if full and self.names:
            share, _ = self.mixtures([cells[i] for i in full])
            best = np.round(share, 6).argmax(1)
            for i, b, row in zip(full, best.tolist(), share.astype(float).tolist(), strict=True):
                names[i], scores[i], shares[i] = self.names[b], min(1.0, max(0.0, row[b])), row
        return names, scores, shares


def learn(docs: DataFrame, sample_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """n-gram counts of at most sample_rows labelled texts that are not held out; counted on the executors."""
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS STRING) AS text", f"CAST(`{lang_col}` AS STRING) AS lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = smallest_hashes(rows, F.xxhash64(F.col("doc_id").cast("string")), sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in in_slices(batches, "text"):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if len(g := grams(text)):
                    np.add.at(found.setdefault(lang, np.zeros(CELLS, np.int64)), g, 1)
        for lang, n in found.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[k])], names=["lang", "cell", "n"])

    counts = arrow_rows(sample.select("text", "lang"), count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for b in counts.toArrow().to_batches():
        for lang, cell, n in zip(*(b.column(c).to_pylist() for c in ("lang", "cell", "n")), strict=True):
            out.setdefault(lang, np.zeros(CELLS, np.int64))[cell] = n
    return Languages(out)


def identify(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, shares map<lang, proportion>), one for each row of docs. Narrow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text", 2 << 20):
            names, scores, shares = model.predict([x or "" for x in b.column("text").to_pylist()])
            maps = pa.array([[(k, v) for k, v in zip(model.names, row, strict=True) if v > 0] for row in shares], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names), pa.array(scores), maps], names=["doc_id", "held_out", "lang_pred", "score", "shares"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return arrow_rows(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, shares map<string,double>")


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))
