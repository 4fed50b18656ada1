"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints that differ in at most T bits differ, for some part i of the bits, in at most t_i
bits there, if the thresholds satisfy sum(t_i + 1) = T + 1 (a part with t_i = -1 is not looked at).
Bits that go together in the corpus are grouped into one part; a dynamic program chooses the
thresholds with the least probes and estimated candidates, for each number of parts: from the counts
of ones in all fingerprints, and from how often bits of a part differ together in a bounded sample. A fingerprint is kept once with its smallest document. It
stands in one bucket for each part, and probes the buckets within the part's threshold; links are
verified on all 64 bits. A bucket gives only a spanning forest of its links, so its output grows
with its members; a bucket of more than BLOCK members is dealt out as pairs of blocks.

Defined cases: a null text is an empty one; texts without words have fingerprint 0 and are linked
like any other; repeated rows give a row each; a component_id is the smallest non-null doc_id
reachable, null if there is none; an empty table gives an empty result; other columns are ignored;
very long texts are read whole, 65,536 shingles at a time. Ids must be integers.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, in_slices, settle, smallest_hashes
from tidemark.llm.components import components

BITS, SEED, BLOCK, SAMPLE = 64, 42, 1024, 2048


def fingerprint(text: str, width: int = 3) -> int:
    """Majority of the XXH64 bits of all word shingles, as an unsigned number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, at = b" ".join(words), [0, *itertools.accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        h = [digest(joined, SEED)]
    else:
        h = [digest(joined[i : j - 1], SEED) for i, j in zip(at, at[width:], strict=False)]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.array(h[k : k + (1 << 16)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "text"):
            fp = np.array([fingerprint(x or "", width) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")
    return arrow_rows(rows, work, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often each pair of bits is set together (the diagonal: each bit), over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            bits = np.unpackbits(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BITS * BITS)), pa.array(np.r_[n, both.ravel()].astype(np.int64))], names=["k", "c"])

    sums = {r["k"]: r["c"] for r in arrow_rows(fps.select("fp"), work, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()}
    return sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of equal width: each starts at the lowest bit left and takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    strength = np.abs(cov) / np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    left, out = list(range(BITS)), []
    for k in range(parts):
        group = [left.pop(0)]
        while len(group) < BITS // parts + (k < BITS % parts):
            group.append(left.pop(int(np.argmax(strength[group][:, left].mean(axis=0)))))
        out.append(sorted(group))
    return out


def near_share(sample: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Share of the pairs of a sample of fingerprints that differ in 0, 1, .. of these bits: correlated bits differ together."""
    part = sample & np.uint64(sum(1 << j for j in bits))
    counts = sum((np.bincount(np.bitwise_count(part[i + 1 :] ^ x), minlength=BITS + 1) for i, x in enumerate(part)), np.zeros(BITS + 1))
    return counts[: most + 1] / max(counts.sum(), 1)


def allocation(n: int, both: np.ndarray, most: int, sample: np.ndarray | None = None, probe_cost: float = 1.0, pair_cost: float = 0.2, parts: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of least estimated cost; parts that need no look are left out."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (math.inf, [])
    for m in parts:
        groups = grouped_bits(n, both, m)
        costs = []
        for g in groups:
            near = np.r_[1.0, np.zeros(most)]  # chance of 0, 1, .. differing bits
            for j in g:
                near = near * (1 - differ[j]) + np.r_[0, near[:-1]] * differ[j]
            if sample is not None:  # independent bits are the least that is assumed
                near = np.maximum(near, near_share(sample, g, most))
            costs.append([0.0] + [n * probe_cost * sum(math.comb(len(g), j) for j in range(t + 1)) + pair_cost * n * n * near[: t + 1].sum() / 2 for t in range(most + 1)])
        plan = {0: (0.0, [])}  # thresholds used up: cost, thresholds
        for c in costs:
            plan = {k: min((plan[k - t][0] + c[t], [*plan[k - t][1], t - 1]) for t in range(most + 2) if k - t in plan) for k in range(most + 2) if any(k - t in plan for t in range(most + 2))}
        if (found := plan[most + 1])[0] < best[0]:
            best = (found[0], [(g, t) for g, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member reachable from each of n members over links a-b."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        a, b, low, high = (x[low != high] for x in (a, b, low, high))
        # All labels are roots here, and only roots get a new parent: none is overwritten.
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def links(fps: DataFrame, plan: list[tuple[list[int], int]], most: int) -> DataFrame:
    """Edges (a, b) that span all links of different fingerprints (column fp, distinct)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (bits, t) in enumerate(plan):
                mask = np.uint64(sum(1 << j for j in bits))
                for r in range(t + 1):
                    for flip in itertools.combinations(bits, r):
                        key = ((fp & mask) ^ np.uint64(sum(1 << j for j in flip))).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(key), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), r == 0))], names=["part", "key", "fp", "own"])

    rows = arrow_rows(fps.select("fp"), keyed, "part int, key long, fp long, own boolean")
    large = rows.groupBy("part", "key").count().filter(F.col("count") > BLOCK)
    block = F.pmod(F.xxhash64("fp"), F.ceil(F.col("count") / BLOCK)).cast("int")
    dealt = rows.join(large, ["part", "key"], "left").withColumn("i", F.coalesce(block, F.lit(0)))
    dealt = dealt.select("part", "key", "fp", "own", "i", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil(F.col("count") / BLOCK).cast("int") - 1))).alias("j"))
    dealt = dealt.select("part", "key", "fp", "own", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))

    def spanned(part: pa.Table) -> pa.RecordBatch:
        fp, own = part["fp"].to_numpy().view(np.uint64), part["own"].to_numpy(zero_copy_only=False)
        cols = [part[c].to_numpy() for c in ("part", "key", "i", "j")]
        n = len(fp)
        new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]
        group = np.cumsum(new)
        found, at, d = [], np.arange(n), 1
        while len(at := at[at + d < n]) and len(at := at[group[at] == group[at + d]]):
            near = at[(own[at] | own[at + d]) & (np.bitwise_count(fp[at] ^ fp[at + d]) <= most)]
            found.append((near, near + d))
            d += 1
            if sum(len(x) for x, _ in found) > 1 << 22:
                label = _forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), n)
                found = [(np.flatnonzero(label != np.arange(n)), label[label != np.arange(n)])]
        label = _forest(*(np.concatenate([f[k] for f in found] or [np.zeros(0, int)]) for k in (0, 1)), n)
        k = np.flatnonzero(fp[label] != fp)
        return pa.RecordBatch.from_arrays([pa.array(fp[k].view(np.int64)), pa.array(fp[label[k]].view(np.int64))], names=["a", "b"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; whole buckets are handled together, the last may go on in the next batch."""
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks()
            same = np.logical_and.reduce([t[c].to_numpy() == t[c][-1].as_py() for c in ("part", "key", "i", "j")])
            cut = int(np.argmax(same))
            if cut:
                yield spanned(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield spanned(rest)

    keys = ["part", "key", "i", "j"]
    near = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return arrow_rows(near, verified, "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one for each row of docs."""
    fps = settle(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    n, both = bit_counts(classes)
    some = smallest_hashes(classes.select("fp"), F.xxhash64("fp"), SAMPLE).collect()
    sample = np.array(sorted(r["fp"] for r in some), np.int64).view(np.uint64)
    roots = components(links(classes, allocation(n, both, most, sample), most))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = named.select("fp", "root", "first")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = settle(named.join(lowest, "root").select("fp", "component_id"), "components")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
