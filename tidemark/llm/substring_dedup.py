"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the least hash of the `mer`-word sequences
in it; neighbouring windows share it, and such a run of windows travels as one packed string of words
(a super-k-mer) to the bucket of the minimiser, where the windows are cut out again, sorted, and the
least doc_id of each distinct window is known exactly. Equal windows have equal minimisers, so a
minimiser that only one document has cannot bear a duplicate: a first pass sends only (minimiser,
doc_id), and super-k-mers travel for minimisers of several documents alone. A bucket of more than HOT
windows is not gathered in one task: its windows travel singly under a 128-bit digest, and are
reduced to the least doc_id before and after the shuffle.

Removal: a word goes if a window over it also starts in a document with a smaller doc_id. Spans come
back per document and are cut out of the whole text.

Defined cases: a null text has no words; documents with a null doc_id are kept whole and are nobody's
source; rows that repeat a doc_id are judged alike (a document is no duplicate of itself); an empty
table gives an empty result; other columns are ignored; very long texts are cut whole, one at a time.
Ids must be integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, in_slices, settle

WINDOW, MER, HOT, REMEMBER = 50, 8, 30_000, 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """XXH64 of words, remembered; emptied when full."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def minimisers(h: np.ndarray, window: int, mer: int) -> np.ndarray:
    """The least mixed hash of a mer in each window of words with hashes h."""
    m = np.zeros(len(h) - mer + 1, np.uint64)
    for k in range(mer):
        m = (m ^ (m >> np.uint64(31))) * _MIX + h[k : len(h) - mer + 1 + k]
    m = (m ^ (m >> np.uint64(29))) * _MIX
    m ^= m >> np.uint64(32)
    span, least, step = window - mer + 1, m, 1
    while step * 2 <= span:  # least of 1, 2, 4, .. neighbours
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = span - step
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def super_kmers(h: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each run of windows with one minimiser."""
    least = minimisers(h, window, mer)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[starts].view(np.int64), starts, np.diff(np.r_[starts, len(least)])


def windows_of(words: list[bytes], n: int, window: int) -> list[bytes]:
    return [b" ".join(words[i : i + window]) for i in range(n)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def duplicate_spans(texts: DataFrame, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """(doc_id, text key, first, end): words covered by windows that start in a smaller document as well. texts: (doc_id, key, text), ids not null."""
    mer = min(mer, window)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in in_slices(batches, "text"):
            ids, out, sizes = [], [], []
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if len(words := (x or "").encode().split()) >= window:
                    bucket, _, n = super_kmers(hashes.of(words), window, mer)
                    bucket, at = np.unique(bucket, return_inverse=True)
                    out.append(bucket)
                    sizes.append(np.bincount(at, weights=n).astype(np.int64))
                    ids.append(np.full(len(bucket), d))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes))], names=["bucket", "doc_id", "windows"])

    seen = settle(arrow_rows(texts.select("doc_id", "text"), anchors, "bucket long, doc_id long, windows long"), "anchors")
    shared = settle(seen.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("windows").alias("n")).filter("least < most").select("bucket", (F.col("n") > HOT).alias("hot")), "shared")
    wanted = seen.join(shared, "bucket").groupBy("doc_id").agg(F.collect_set(F.struct("bucket", "hot")).alias("wanted"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Super-k-mers of the wanted buckets; for hot ones their windows' digests."""
        hashes = WordHashes()
        names = ["doc_id", "key", "bucket", "first", "n", "pack", "digest"]
        for b in in_slices(batches, "text", 2 << 20):
            rows: list[tuple] = []
            for d, key, x, wanted in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text", "wanted")), strict=True):
                hot = {w["bucket"]: w["hot"] for w in wanted}
                words = (x or "").encode().split()
                if len(words) < window:
                    continue
                for m, i, n in zip(*(c.tolist() for c in super_kmers(hashes.of(words), window, mer)), strict=True):
                    if (h := hot.get(m)) is None:
                        continue
                    if h:
                        for k, w in enumerate(windows_of(words[i : i + n + window - 1], n, window)):
                            rows.append((d, key, m, i + k, 1, None, hashlib.md5(w, usedforsecurity=False).digest()))
                    else:
                        rows.append((d, key, m, i, n, b" ".join(words[i : i + n + window - 1]), None))
            for k in range(0, len(rows), 20_000):
                cols = list(zip(*rows[k : k + 20_000], strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    runs = settle(arrow_rows(texts.join(wanted, "doc_id"), packed, "doc_id long, key long, bucket long, first int, n int, pack binary, digest binary"), "super-kmers")

    def counted(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        """One bucket's (doc_id, key, first, n, pack): sort its windows; those whose least document is smaller than their own give spans."""
        if min(r[0] for r in rows) == max(r[0] for r in rows):
            return []
        cut = sorted((w, d, k, i + j) for d, k, i, m, p in rows for j, w in enumerate(windows_of(p.split(b" "), m, window)))
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        least = last = None
        for w, d, k, i in cut:
            if w != last:
                last, least = w, d
            elif d > least:
                spans.setdefault((d, k), []).append((i, i + window))
        return [(d, k, a, b) for (d, k), s in spans.items() for a, b in merged(s)]

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket. Spans of many buckets go out in one batch: a batch for each would cost more than the work."""
        kinds = [("doc_id", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]
        give = lambda out: pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])
        now, rows, out = None, [], []
        for b in batches:
            for bucket, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "key", "first", "n", "pack")), strict=True):
                if bucket != now and rows:
                    out += counted(rows)
                    rows = []
                    if len(out) > 20_000:
                        yield give(out)
                        out = []
                now = bucket
                rows.append(row)
        yield give(out + (counted(rows) if rows else []))

    # At most HOT windows a bucket, so sorting by it gathers no unbounded group.
    cold = arrow_rows(runs.filter("pack IS NOT NULL").select("bucket", "doc_id", "key", "first", "n", "pack").repartition("bucket").sortWithinPartitions("bucket"), buckets, "doc_id long, key long, first int, end int")
    hot = runs.filter("digest IS NOT NULL").select("digest", "doc_id", "key", "first")
    least = settle(hot.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least"), "hot")
    warm = hot.join(least, "digest").filter("doc_id > least").select("doc_id", "key", "first", (F.col("first") + window).alias("end"))
    return cold.unionByName(warm)


def substring_dedup(docs: DataFrame, window: int = WINDOW, mer: int = MER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one for each row of docs; kept: the kept words joined by blanks."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    spans = duplicate_spans(texts.filter("doc_id IS NOT NULL"), window, mer)
    # Of one document's spans: as many as it has words at most.
    spans = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text"):
            total, gone, kept = [], [], []
            for x, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = x.encode().split()
                total.append(len(words))
                for a, e in reversed(merged([(s["first"], s["end"]) for s in spans or []])):
                    del words[a:e]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    rows = texts.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    return arrow_rows(rows, cut, "doc_id long, n_words long, n_removed long, kept string")


def dedup_digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
