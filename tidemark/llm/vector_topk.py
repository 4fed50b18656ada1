"""Exact top-k search by inner product over a pivot-distance index.

Components are floored to integers, so scores are exact. Every vector gets one more coordinate that
lifts it to the common norm M; a query is stretched to M with none. Distances between them are then a
metric that falls as the inner product grows. Pivots come from a bounded sample (farthest first), more
of them the more vectors there are. A vector is keyed by its nearest pivot and its distance to it; the
members of a pivot are cut into annuli by quantiles of that distance, so that annuli follow the data.
A query first searches the annuli nearest to it that hold enough vectors, which bounds its k-th best;
a second round expands to the other annuli and stops where the triangle inequality puts a whole
annulus beyond the bound. Inside an annulus members stand in order of their distance, and a query
scans outwards from its own distance, with its bound tightened as it goes, until the next is beyond.

Equal vectors are searched once: of each distinct vector the k + 1 first rows (by id) can matter, as
ties go to the smaller id. Queries that are equal share one search for k + 1. Vectors travel only to
the annuli and query chunks that ask for them; annuli beyond BLOCK members are dealt out by a hash, so
that no task gathers a group that grows.

Vectors of many independent dimensions lie at nearly the same distance from everything: there hardly
an annulus is beyond the bound, and the search comes near to brute force, as for any such index.

Defined cases: vectors that are null, hold null or non-finite components, or have a null id take no
part; shorter vectors count as filled up with zeros; rows that repeat are rows of their own, as
queries and as candidates (ties of an id in any order, the rows being equal in the answer); fewer than
k candidates give as many rows; an empty table gives an empty result; other columns are ignored; very
long vectors are read whole. Ids must be integers. Scores beyond a long are cut to its range; they are
ranked by their exact values (components too large for exact doubles are multiplied as Python integers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, settle

#: Pivots at least and at most, vectors of the sample they come from, annuli in all, members of an annulus before one more is made, members and queries of a task's group, members scored at once.
PIVOTS, SAMPLE, ANNULI, SMALL, BLOCK, CHUNK, SCAN = (16, 128), 4096, 4096, 2048, 65_536, 4096, 64
LONGEST = (1 << 63) - 1


def whole_vectors(rows: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec binary of whole doubles without zeros at the end)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v) or not np.isfinite(a := np.array(v, float)).all():
                    continue
                ids.append(i)
                with np.errstate(over="ignore"):
                    whole = np.floor(scale * a)
                big = np.finfo(float).max
                out.append((np.trim_zeros(np.clip(whole, -big, big), "b") + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return arrow_rows(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")), work, "vec_id long, vec binary")


def unpacked(vectors: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        a = np.frombuffer(v)
        out[i, : len(a)] = a
    return out


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows with one vector: doubles where they are exact, else Python integers."""
    if exact:
        return x @ q
    whole = [int(v) for v in q]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x], object)


class PivotIndex:
    """Pivots, and the annuli with what each holds."""

    def __init__(self, sample: list[bytes], dim: int, norm: float, k: int, n: int) -> None:
        self.dim, self.norm, self.k = dim, norm, k
        x = self.lifted(unpacked(sample, dim))
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < min(max(PIVOTS[0], min(PIVOTS[1], int(n**0.5) // 16)), len(x)):
            far = np.minimum(far, self.distances(x, x[chosen[-1:]])[:, 0])
            chosen.append(int(far.argmax()))
        self.pivots = x[chosen]
        self.annuli: dict[str, np.ndarray] = {}

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.c_[x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))]

    def stretched(self, q: np.ndarray) -> np.ndarray:
        q = q / self.norm
        n = np.sqrt((q * q).sum(1, keepdims=True))
        return np.c_[q / np.maximum(n, 1e-300), np.zeros(len(q))]

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))

    def nearest(self, vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pivot and distance (in units of the common norm) of each vector."""
        d = self.distances(self.lifted(unpacked(vectors, self.dim)), self.pivots)
        p = d.argmin(1)
        return p, d[np.arange(len(d)), p]

    def gaps(self, vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Queries x annuli: no member is nearer than this; and the query's distance to the annulus's pivot."""
        d = self.distances(self.stretched(unpacked(vectors, self.dim)), self.pivots)[:, self.annuli["pivot"]]
        return np.maximum(np.maximum(self.annuli["low"] - d, d - self.annuli["high"]), 0), d


def reach(norm: float, length: float, kth: float) -> float:
    """Distance within which all members of a query's k best stand, given its length and a score they reach; a little more for rounding."""
    if not length > 0 or not np.isfinite(kth):
        return np.inf
    return float(np.sqrt(max(2 - 2 * (kth / length) / norm, 0.0)) + 1e-6)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    if scores.dtype == object:
        return np.array(sorted(order.tolist(), key=lambda i: -scores[i])[:k], int)
    return order[np.argsort(-scores[order], kind="stable")][:k]


def scan(ids: np.ndarray, x: np.ndarray, r: np.ndarray, q: np.ndarray, at: float, kth: float, norm: float, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of the k best members for one query, outwards from its distance `at`; r in order. Also: members scored."""
    length = float(np.sqrt(((q / norm) ** 2).sum()) * norm)
    low = high = int(np.searchsorted(r, at))
    found_ids, found, scored = np.zeros(0, np.int64), np.zeros(0, float if exact else object), 0
    limit, step = reach(norm, length, kth), SCAN
    while True:
        down, up = (at - r[low - 1] if low > 0 else np.inf), (r[high] - at if high < len(r) else np.inf)
        if min(down, up) > limit or (low == 0 and high == len(r)):
            return found_ids, found, scored
        # Steps grow, but never past the bound as it stands.
        part = slice(min(low - 1, max(0, low - step, int(np.searchsorted(r, at - limit)))), low) if down <= up else slice(high, max(high + 1, min(len(r), high + step, int(np.searchsorted(r, at + limit, side="right")))))
        low, high, step = min(low, part.start), max(high, part.stop), step * 2
        scores = products(x[part], q, exact)
        scored += len(scores)
        found_ids, found = np.r_[found_ids, ids[part]], np.concatenate([found, scores])
        keep = best(found_ids, found, k)
        found_ids, found = found_ids[keep], found[keep]
        if len(found) == k:
            last = found[-1]
            limit = min(limit, reach(norm, length, float(last) if abs(last) < 1e300 else np.inf))


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by `every`."""
    spark = rows.sparkSession
    vectors = settle(whole_vectors(rows, scale, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    shape = arrow_rows(vectors.select("vec"), _shapes, "dim long, most double, n long").agg(F.max("dim").alias("dim"), F.max("most").alias("most"), F.sum("n").alias("n")).first()
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, most = max(1, shape["dim"]), max(shape["most"], 1.0)
    exact = dim * most * most < 2.0**53
    norm = most * dim**0.5  # no vector is longer
    first = Window.partitionBy("vec").orderBy("vec_id", "row")
    kept = vectors.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).drop("r")
    asked = vectors.filter(F.col("vec_id") % every == 0)
    longest = arrow_rows(vectors.select("vec"), _lengths(norm), "length double").agg(F.max("length")).first()[0]
    norm = max(longest, 1.0) * (1 + 1e-12)
    hashed = vectors.select(F.xxhash64("vec").alias("h"))
    bound = hashed.distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    # Hashes first, so that only the vectors of the sample travel.
    sample = sorted({bytes(r["vec"]) for r in vectors.filter(F.xxhash64("vec") <= bound).select("vec").distinct().collect()})
    index = PivotIndex(sample, dim, norm, k + 1, shape["n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p, r = index.nearest(b.column("vec").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("row"), b.column("vec"), pa.array(p, pa.int32()), pa.array(r)], names=["vec_id", "row", "vec", "pivot", "r"])

    near_pivot = settle(arrow_rows(kept.select("vec_id", "row", "vec"), place, "vec_id long, row long, vec binary, pivot int, r double"), "placed")
    # Annuli by quantiles: at most ANNULI edges over all pivots; a pivot has as many as its share of the members asks for.
    n = near_pivot.count()
    step = F.greatest(F.lit(float(SMALL)), F.lit(n / ANNULI * 2))
    marks = near_pivot.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("r", [i / 65 for i in range(1, 65)], 2000).alias("q"))
    marks = marks.select("pivot", F.least(F.lit(64), F.ceil(F.col("n") / step) - 1).cast("int").alias("m"), "q")
    edges = {r["pivot"]: np.unique(np.array(r["q"])[np.arange(1, r["m"] + 1) * 64 // (r["m"] + 1)]) for r in marks.collect()}  # PIVOTS * 64 numbers at most

    def ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p, r = b.column("pivot").to_numpy(), b.column("r").to_numpy()
                ring = np.zeros(len(p), np.int32)
                for one in np.unique(p).tolist():
                    ring[p == one] = np.searchsorted(edges[one], r[p == one], side="right")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ring)], names=[*b.schema.names, "ring"])

    placed = arrow_rows(near_pivot, ringed, "vec_id long, row long, vec binary, pivot int, r double, ring int")
    annuli = placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).orderBy("pivot", "ring").toPandas()
    index.annuli = {c: annuli[c].to_numpy() for c in annuli}
    blocks = np.ceil(index.annuli["n"] / BLOCK).astype(int)
    sizes = spark.createDataFrame([(int(p), int(r), int(b)) for p, r, b in zip(index.annuli["pivot"], index.annuli["ring"], blocks, strict=True)], "pivot int, ring int, blocks int")

    # Queries that are equal share a number.
    searched = settle(asked.select(F.col("vec").alias("q")).distinct().withColumn("qid", F.monotonically_increasing_id()), "queries")
    chunks = max(1, -(-searched.count() // CHUNK))
    members = placed.join(F.broadcast(sizes), ["pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    keys = ["pivot", "ring", "block", "chunk"]

    def probe(first_round: bool):  # noqa: ANN202
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start in range(0, b.num_rows, 512):
                    part = b.slice(start, 512)
                    q = part.column("q").to_pylist()
                    gaps, away = index.gaps(q)
                    order = np.argsort(gaps, axis=1, kind="stable")
                    held = np.take_along_axis(np.broadcast_to(index.annuli["n"], gaps.shape), order, 1).cumsum(1)
                    near = np.zeros(gaps.shape, bool)  # the nearest annuli that hold 16 k vectors
                    np.put_along_axis(near, order, np.c_[np.zeros(len(q)), held[:, :-1]] < 16 * index.k, 1)
                    kth = np.array([np.nan if x is None else x for x in part.column("kth").to_pylist()], float)
                    if not first_round:
                        length = [float(np.sqrt(((np.frombuffer(v) / norm) ** 2).sum()) * norm) for v in q]
                        near = ~near & (gaps <= np.array([reach(norm, n, s) for n, s in zip(length, kth, strict=True)])[:, None])
                    at, ring = np.nonzero(near)
                    rep = blocks[ring]
                    at, ring = np.repeat(at, rep), np.repeat(ring, rep)
                    block = np.arange(len(at)) - np.repeat(np.cumsum(rep) - rep, rep)
                    chunk = pa.array((part.column("qid").to_numpy() % chunks).astype(np.int32)).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([part.column("qid").take(pa.array(at)), part.column("q").take(pa.array(at)), pa.array(kth[at]), pa.array(away[at, ring]), pa.array(index.annuli["pivot"][ring].astype(np.int32)), pa.array(index.annuli["ring"][ring].astype(np.int32)), pa.array(block.astype(np.int32)), chunk], names=["qid", "q", "kth", "at", *keys])

        return work

    def search(probes: DataFrame) -> DataFrame:
        """(qid, vec_id, row, value, score): the k best of each annulus for each query that probes it."""
        wanted = probes.select(*(F.col(c).alias(f"{c}_") for c in keys)).distinct().toDF(*keys)
        sent = members.join(wanted, ["pivot", "ring", "block"])

        def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            left = left.sort_values(["r", "row"])
            places, x, r = left["row"].to_numpy(), unpacked(left["vec"].tolist(), dim), left["r"].to_numpy()
            ids = left["vec_id"].to_numpy()
            order = np.argsort(np.lexsort((places, ids)))  # ties go by id, then row
            back = np.argsort(order)
            for qid, q, kth, at in zip(right["qid"].tolist(), right["q"].tolist(), right["kth"].tolist(), right["at"].tolist(), strict=True):
                found, scores, _ = scan(order, x, r, unpacked([q], dim)[0], at, kth, norm, k + 1, exact)
                if exact and np.isfinite(kth):  # others can't be among the best
                    found, scores = found[scores >= kth], scores[scores >= kth]
                out += [(qid, int(ids[back[i]]), int(places[back[i]]), str(int(s)), max(-LONGEST - 1, min(LONGEST, int(s)))) for i, s in zip(found.tolist(), scores.tolist(), strict=True)]
            return pd.DataFrame(out, columns=["qid", "vec_id", "row", "value", "score"])

        return sent.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(work, "qid long, vec_id long, row long, value string, score long")

    def ordered(found: DataFrame) -> list:
        # Scores beyond a long are told apart by their exact values: sign, length, digits.
        digits = F.regexp_replace("value", "-", "")
        size = F.format_string("%06d", F.length(digits))
        big = F.concat(size, digits)
        return [F.desc("score"), F.desc(F.when((F.col("score") == LONGEST), big)), F.asc(F.when(F.col("score") == -LONGEST - 1, big)), "vec_id", "row"]

    schema = "qid long, q binary, kth double, at double, pivot int, ring int, block int, chunk int"
    order = Window.partitionBy("qid").orderBy(*ordered(searched))
    one = settle(search(settle(arrow_rows(searched.withColumn("kth", F.lit(None).cast("double")), probe(True), schema), "first")), "near")
    kth = one.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k + 1).select("qid", F.col("value").cast("double").alias("kth"))
    two = search(settle(arrow_rows(searched.join(kth, "qid", "left").select("qid", "q", "kth"), probe(False), schema), "second"))
    found = one.unionByName(two).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).drop("r")
    own = Window.partitionBy("asked").orderBy(*ordered(found))
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("row").alias("asked"), F.col("vec").alias("q")).join(searched, "q").drop("q").join(found, "qid").filter("row <> asked")
    return answers.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a = [np.frombuffer(v) for v in b.column("vec").to_pylist()]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array([max(map(len, a))], pa.int64()), pa.array([float(max((np.abs(x).max() for x in a if len(x)), default=0.0))]), pa.array([len(a)], pa.int64())], names=["dim", "most", "n"])


def _lengths(norm: float):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt(((np.frombuffer(v) / norm) ** 2).sum()) * norm) for v in b.column("vec").to_pylist()])], names=["length"])

    return work
