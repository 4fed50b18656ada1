"""Frame changes: stability windows, kinds, reasons, clusters, representatives, change points."""

from __future__ import annotations


from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

def stream() -> Window:
    """Frames of a stream in order (made when asked for: workers import this module without a session)."""
    return Window.partitionBy("stream_id").orderBy("ts", "event_id")


# Least significant share of changed pixels, least share of a strong change, the pair (share, largest part) that is as broad, similarity from which texts count as the same page, frames looked back.
SIGNIFICANT, STRONG, BROAD, SAME_PAGE, BACK = 0.02, 0.12, (0.08, 0.02), 0.82, 5


def broad(ratio: Column, component: Column) -> Column:
    """A change of the whole page: strong, or fairly strong with a large connected part."""
    return (ratio >= STRONG) | ((ratio >= BROAD[0]) & (component >= BROAD[1]))


def _stable(changed: Column) -> Column:
    """No significant change in the BACK frames before."""
    return ~F.coalesce(F.max(changed).over(stream().rowsBetween(-BACK, -1)), F.lit(False))


def change_kinds(frames: DataFrame) -> DataFrame:
    """Every frame against the one before: its kind; whether it stands for a page (candidate), and why. The first frame has nothing to compare with."""
    found = frames.withColumn("tokens", T.tokens(F.col("ocr_text"))).withColumn("n", F.row_number().over(stream()))
    zero = lambda c: F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    found = found.withColumn("similarity", zero(T.jaccard(F.lag("tokens").over(stream()), F.col("tokens"))))
    found = found.withColumns({c: zero(F.col(c)) for c in ("change_ratio", "component_ratio", "scene_score")})
    changed = F.col("change_ratio") >= SIGNIFICANT
    found = found.withColumn("stable", _stable(changed))
    page = broad(F.col("change_ratio"), F.col("component_ratio")) & F.col("stable") & (F.col("similarity") < SAME_PAGE) & (F.col("n") > 1)
    found = found.withColumn("change_kind", F.when(page, "page_change").when(changed, "annotation_like_change").otherwise("no_change"))
    # The reasons.
    before = F.when(F.lead("change_kind").over(stream()) == "page_change", F.lit("stable_before_change"))
    reason = F.coalesce(before, F.when(F.col("n") == 1, F.lit("opening_frame")), F.when(F.lead("n").over(stream()).isNull(), F.lit("closing_frame")), F.lit(""))
    return found.withColumn("reason", reason).withColumn("candidate", reason != "")


def signature(phash: Column, content: Column) -> Column:
    """A frame's hash: the one given, else the start of its content's MD5; empty without either."""
    given = F.trim(F.coalesce(phash, F.lit("")))
    return F.when(given != "", given).otherwise(F.coalesce(F.substring(F.md5(content), 1, 16), F.lit("")))


def page_frames(annotated: DataFrame) -> DataFrame:
    """The frames that units are built from: the first, the candidates and the last of a stream (all, if it has no candidate), one for each time."""
    whole = Window.partitionBy("stream_id")
    rows = annotated.withColumn("any", F.max("candidate").over(whole)).withColumn("first", F.row_number().over(stream())).withColumn("last", F.lead("event_id").over(stream()).isNull())
    kept = rows.filter(~F.col("any") | F.col("candidate") | (F.col("first") == 1) | F.col("last"))
    at = F.row_number().over(Window.partitionBy("stream_id", "ts").orderBy("event_id"))
    return kept.withColumn("at", at).filter(~F.col("any") | (F.col("at") == 1)).drop("any", "first", "last", "at")


def clusters(frames: DataFrame, alike: float = 0.7, most: int = 6) -> DataFrame:
    """Runs of neighbouring frames that look alike (chain linkage); cluster counts from 1 in each stream."""
    found = frames.withColumn("tokens", T.tokens(F.col("ocr_text")))
    far = T.hash_distance(F.lag("phash").over(stream()), F.col("phash")) > most
    new = F.when(F.lag("event_id").over(stream()).isNull() | (far & (T.jaccard(F.lag("tokens").over(stream()), F.col("tokens")) < alike)), 1).otherwise(0)
    return found.withColumn("new", new).withColumn("cluster", F.sum("new").over(stream()).cast("long"))


def cluster_rollup(found: DataFrame) -> DataFrame:
    return found.groupBy("stream_id", "cluster").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("frame_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("frames"))


def _best_frames(found: DataFrame) -> DataFrame:
    """Of each cluster the frame with the most information, then nearest to the members' mean time, then first."""
    of = Window.partitionBy("stream_id", "cluster")
    score = T.text_quality(F.col("ocr_text")) + 10 * F.size("tokens") + F.coalesce("scene_score", F.lit(0.0))
    # Times are summed in order, so that equal data give equal means.
    mean = F.sum("ts").over(of.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / F.count("*").over(of)
    scored = found.withColumn("score", score).withColumn("off", F.round(F.abs(F.col("ts") - mean), 9))
    return scored.withColumn("r", F.row_number().over(of.orderBy(F.desc("score"), "off", "ts", "event_id"))).filter("r = 1")


def representatives(found: DataFrame) -> DataFrame:
    return _best_frames(found).select("stream_id", "cluster", "event_id", "score")


def visual_units(annotated: DataFrame) -> DataFrame:
    """One row a cluster of page frames: number, id, span, members, and its representative's time, text, change and worth."""
    found = clusters(page_frames(annotated))
    best = _best_frames(found).select("stream_id", "cluster", "event_id", "ts", F.trim("ocr_text").alias("ocr_text"), "tokens", "scene_score", "change_ratio", "change_kind", "candidate")
    best = best.withColumn("quality", T.text_quality(F.col("ocr_text")))
    size, known = F.char_length("ocr_text"), F.size("tokens")
    # The bounds of a unit of low value.
    low = (F.col("quality") < 25) | (size < 20) | (F.size(T.informative(F.col("tokens"))) < 2) | ((known <= 2) & (size < 30))
    rows = cluster_rollup(found).join(best, ["stream_id", "cluster"])
    return rows.select("stream_id", F.col("cluster").cast("int").alias("unit_number"), F.format_string("visual_unit_%03d", "cluster").alias("unit_id"), "start", "end", "frame_count", "frames", "event_id", "ts", "ocr_text", size.alias("ocr_len"), "quality", "scene_score", "change_ratio", "change_kind", "candidate", "tokens", low.alias("low"))


def thinned(points: list[tuple[float, float]], gap: float) -> list[tuple[float, float]]:
    """Of (time, strength) in order: within the gap of the last point kept, the stronger stays (the later, if equal)."""
    kept: list[tuple[float, float]] = []
    for at, strength in points:
        if kept and at - kept[-1][0] < gap:
            if strength >= kept[-1][1]:
                kept[-1] = (at, strength)
        else:
            kept.append((at, strength))
    return kept


def change_points(samples: DataFrame, interval: float = 1.0, gap: float = 8.0, most: int = 18) -> DataFrame:
    """Whole seconds to look at: the sample before each broad change after a stable time, the opening and the closing.

    samples: (stream_id, event_id, ts, scene_score, change_ratio, component_ratio, duration). Times are rounded half to even and
    clamped to the duration; of equal ones the strongest counts; within the gap the stronger stays; of more than `most` the strongest.
    """
    n = F.row_number().over(stream())
    rows = samples.withColumn("n", n).withColumn("before", F.lag("ts").over(stream()))
    rows = rows.withColumn("stable", _stable((F.col("n") > 1) & (F.col("change_ratio") >= SIGNIFICANT)))
    strong = rows.filter((F.col("n") > 1) & F.col("stable") & broad(F.col("change_ratio"), F.col("component_ratio")))
    found = strong.select("stream_id", "duration", F.col("before").alias("t"), (F.col("scene_score") + F.col("change_ratio") * 100 + F.col("component_ratio") * 50).alias("strength"))
    ends = samples.select("stream_id", "duration").distinct().filter("duration > 0")
    closing = F.greatest(F.lit(0.0), F.col("duration") - max(interval, 1.0))
    ends = ends.select("stream_id", "duration", F.explode(F.array(F.lit(0.0), closing)).alias("t"), F.lit(0.0).alias("strength"))
    at = F.greatest(F.lit(0).cast("long"), F.least(F.bround("t").cast("long"), F.col("duration").cast("long")))
    points = found.filter("duration > 0").unionByName(ends).select("stream_id", at.alias("at"), "strength").groupBy("stream_id", "at").agg(F.max("strength").alias("strength"))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kept = thinned(list(pdf.sort_values("at")[["at", "strength"]].itertuples(index=False, name=None)), gap)
        return pd.DataFrame([(key[0], int(a), s) for a, s in kept], columns=["stream_id", "at", "strength"])

    kept = points.groupBy("stream_id").applyInPandas(work, "stream_id long, at long, strength double")
    order = Window.partitionBy("stream_id").orderBy(F.desc("strength"), "at")
    return kept.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")


def supplements(points: DataFrame, around: int = 12) -> DataFrame:
    """Whole seconds before and after weak points (stream_id, at, duration), clamped, and not there yet."""
    low = F.greatest(F.lit(0).cast("long"), F.col("at") - around)
    high = F.least((F.floor("duration") - 1).cast("long"), F.col("at") + around)
    found = points.filter("weak").select("stream_id", F.explode(F.array(low, high)).alias("at")).distinct()
    return found.join(points.select("stream_id", "at"), ["stream_id", "at"], "left_anti")


def refreshed_units(frames: DataFrame, durations: DataFrame, recognise: Callable[[DataFrame], DataFrame], around: int = 12) -> DataFrame:
    """Visual units after a second look: frames beside units of low value are asked for (recognise takes (stream_id, at) and gives frames), take part, and units are built anew. durations: (stream_id, duration)."""
    weak = visual_units(frames).join(durations, "stream_id").select("stream_id", F.floor("ts").cast("long").alias("at"), "duration", F.col("low").alias("weak"))
    more = recognise(supplements(weak, around))
    return visual_units(upsert(frames, more, ["stream_id", "ts"]))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, one for each key; the new ones win."""
    both = old.withColumn("p", F.lit(0)).unionByName(new.withColumn("p", F.lit(1)))
    return both.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p")))).filter("r = 1").drop("p", "r")


def bucket_best(utterances: DataFrame, n: int = 4) -> DataFrame:
    """Of each of n equal parts of a stream, the middle of the longest utterance (the first, if equal), or the part's start."""
    size = F.col("duration") / n
    spans = utterances.groupBy("stream_id").agg(F.max("end").alias("duration"))
    mid = (F.col("start") + F.col("end")) / 2
    rows = utterances.join(spans, "stream_id").withColumn("mid", mid).withColumn("bucket", F.least(F.floor(F.col("mid") / size), F.lit(n - 1)).cast("int"))
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("stream_id", "bucket").orderBy(F.desc(F.char_length("text")), "index"))).filter("r = 1").select("stream_id", "bucket", "mid")
    grid = spans.select("stream_id", "duration", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket")).join(best, ["stream_id", "bucket"], "left")
    return grid.select("stream_id", "bucket", F.bround(F.coalesce("mid", F.col("bucket") * size)).cast("long").alias("at"))




def band(ts: Column, start: Column, end: Column, reach: float) -> Column:
    return (ts >= start - reach) & (ts <= end + reach)
