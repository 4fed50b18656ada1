"""Candidates for a segment: frames, visual units and slides, scored and ranked.

No join pairs all rows of a stream: texts meet by token, times by buckets of the band's width, and
exact titles by their first characters. Weights are quarters, so that the order of a sum does not
matter. Of a segment's tokens only those of weight above 0 can score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.changes import band

KEYS = ["stream_id", "segment_number", "segment_id"]
#: Characters of a title that are looked up.
GRAM = 4


def of_segment() -> Window:
    return Window.partitionBy("stream_id", "segment_number")


def with_tokens(segments: DataFrame) -> DataFrame:
    """Segments (summary, issues, cleaned_text, text, hints) with their tokens, and the text that titles are looked for in."""
    cleaned = F.coalesce(F.nullif(F.trim("cleaned_text"), F.lit("")), F.trim("text"))
    parts = [F.trim("summary"), F.array_join(F.filter(F.transform("issues", lambda x: F.trim(x)), lambda x: x != ""), " "), cleaned, F.trim("text"), F.array_join("hints", " ")]
    return segments.withColumn("tokens", T.tokens(*(F.coalesce(p, F.lit("")) for p in parts))).withColumn("bundle", F.concat_ws(" ", F.trim("summary"), cleaned, F.trim("text")))


def centre() -> Column:
    return (F.col("start") + F.col("end")) / 2


def _overlap(left: str, right: str) -> tuple[Column, Column]:
    both = F.array_intersect(left, right)
    return F.size(both), T.weighted(both)


def _ranked(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(of_segment().orderBy(*order))).filter(F.col("rank") <= most)


def in_band(segments: DataFrame, points: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs of segments and points (ts) of a stream with low <= ts <= high, met by buckets of time."""
    cut = lambda t: F.floor(t / width).cast("long")
    left = segments.withColumn("low_at", low).withColumn("high_at", high)
    left = left.withColumn("bucket", F.explode(F.sequence(cut(F.col("low_at")), cut(F.col("high_at")))))
    return left.join(points.withColumn("bucket", cut(F.col("ts"))), ["stream_id", "bucket"]).filter("ts BETWEEN low_at AND high_at").drop("bucket", "low_at", "high_at")


def token_rows(rows: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """(keep, token, w): the tokens of weight above 0."""
    return rows.select(*keep, F.explode(tokens).alias("token")).withColumn("w", T.weight(F.col("token"))).filter("w > 0")


def frame_matches(segments: DataFrame, frames: DataFrame, near: float = 5.0, wide: float = 30.0, most: int = 5) -> DataFrame:
    """Frames that share weighted tokens or stand in the wide band; if any of a segment shares weight, only such stay."""
    s = segments.select(*KEYS, "start", "end", "tokens")
    f = frames.select("stream_id", "event_id", "ts", T.tokens(F.col("ocr_text")).alias("frame_tokens"))
    said = token_rows(s, "tokens", *KEYS, "start", "end").join(token_rows(f, "frame_tokens", "stream_id", "event_id", "ts").drop("w"), ["stream_id", "token"]).select(*KEYS, "start", "end", "event_id", "ts", "w", F.lit(0.0).alias("bonus"))
    bonus = F.when(band(F.col("ts"), F.col("start"), F.col("end"), near), 2.0).otherwise(1.0)
    beside = in_band(s.drop("tokens"), f.drop("frame_tokens"), F.col("start") - wide, F.col("end") + wide, 4 * wide).select(*KEYS, "start", "end", "event_id", "ts", F.lit(0.0).alias("w"), bonus.alias("bonus"))
    rows = said.unionByName(beside).groupBy(*KEYS, "event_id").agg(F.first("ts").alias("ts"), F.first("start").alias("start"), F.first("end").alias("end"), F.sum("w").alias("w"), F.max("bonus").alias("time_score"))
    rows = rows.withColumn("text_score", 10 * F.col("w")).withColumn("score", F.col("text_score") + F.col("time_score")).withColumn("away", F.abs(F.col("ts") - centre()))
    rows = rows.withColumn("any", F.max(F.col("w") > 0).over(of_segment())).filter("NOT any OR w > 0")
    return _ranked(rows, most, F.desc("score"), F.col("away"), F.col("event_id")).select(*KEYS, "event_id", "ts", "text_score", "time_score", "score", "rank")


UNIT = [*KEYS, "unit_id", "low", "w", "away", "score", "rank"]


def _unit_score() -> Column:
    return 10 * F.col("w") - F.col("away") / 10 - F.when(F.col("low"), 8.0).otherwise(0.0)


def near_units(segments: DataFrame, visual: DataFrame, reach: float = 45.0, most: int = 5) -> DataFrame:
    """Units around a segment's centre. Whether any shares weight, or is of value, is decided before any is dropped."""
    s = segments.select(*KEYS, centre().alias("centre"), "tokens")
    v = visual.select("stream_id", "unit_number", "unit_id", "ts", F.col("tokens").alias("unit_tokens"), "low")
    rows = in_band(s, v, F.col("centre") - reach, F.col("centre") + reach, 2 * reach).withColumn("away", F.abs(F.col("ts") - F.col("centre")))
    rows = rows.withColumn("w", _overlap("tokens", "unit_tokens")[1]).withColumn("score", _unit_score())
    rows = rows.withColumn("any_text", F.max(F.col("w") > 0).over(of_segment())).withColumn("any_good", F.max(~F.col("low")).over(of_segment()))
    rows = rows.filter("(score > 0 OR w > 0) AND (NOT any_text OR w > 0) AND (NOT any_good OR NOT low)")
    return _ranked(rows, most, F.desc("score"), F.col("away"), F.col("unit_number")).select(*UNIT)


def global_units(segments: DataFrame, visual: DataFrame, near: DataFrame, least: float = 1.5, most: int = 5) -> DataFrame:
    """For segments without a near unit: any unit of the stream that shares enough weight."""
    left = segments.join(near.select("stream_id", "segment_number").distinct(), ["stream_id", "segment_number"], "left_anti").select(*KEYS, centre().alias("centre"), "tokens")
    units = token_rows(visual, "tokens", "stream_id", "unit_number", "unit_id", "ts", "low").drop("w")
    rows = token_rows(left, "tokens", *KEYS, "centre").join(units, ["stream_id", "token"]).groupBy(*KEYS, "centre", "unit_number", "unit_id", "ts", "low").agg(F.sum("w").alias("w")).filter(F.col("w") >= least)
    rows = rows.withColumn("away", F.abs(F.col("ts") - F.col("centre"))).withColumn("score", _unit_score())
    rows = rows.withColumn("any_good", F.max(~F.col("low")).over(of_segment())).filter("NOT any_good OR NOT low")
    return _ranked(rows, most, F.desc("score"), F.col("away"), F.col("unit_number")).select(*UNIT)


def borrowed_units(segments: DataFrame, visual: DataFrame, best: DataFrame, reach: float = 120.0, least: float = 0.75, most: int = 2) -> DataFrame:
    """For segments whose best unit is of low value: good units nearby that share weight."""
    left = segments.join(best.filter("rank = 1 AND low").select("stream_id", "segment_number"), ["stream_id", "segment_number"], "left_semi").select(*KEYS, centre().alias("centre"), "tokens")
    v = visual.filter("NOT low").select("stream_id", "unit_number", "unit_id", "ts", F.col("tokens").alias("unit_tokens"))
    rows = in_band(left, v, F.col("centre") - reach, F.col("centre") + reach, 2 * reach)
    rows = rows.withColumn("away", F.abs(F.col("ts") - F.col("centre"))).withColumn("w", _overlap("tokens", "unit_tokens")[1]).filter(F.col("w") >= least)
    rows = rows.withColumn("score", 12 * F.col("w") + reach - F.col("away") + 5)
    return _ranked(rows, most, F.desc("score"), F.col("away"), F.col("unit_number")).select(*KEYS, "unit_id", "w", "away", "score", "rank")


def exact_titles(segments: DataFrame, slides: DataFrame, small: bool = False) -> DataFrame:
    """(segment, slide_index): slides whose title stands in the segment's text, as it is written. Met by the title's first characters.

    Only starts that a title of the deck has are made into rows. The text goes with them where the titles are sent to it
    (small); elsewhere it is joined to what was found, so that it does not pass a shuffle once for every start.
    """
    at, sent = KEYS[:2], F.broadcast if small else lambda x: x
    start = lambda title: F.substring(title, 1, GRAM)
    titles = slides.select("deck", "slide_index", F.trim("title").alias("title")).filter("title <> ''").withColumn("gram", start(F.col("title")))
    # Starts and their lengths by deck: nearly always GRAM alone, so that other grams are not made.
    starts = titles.groupBy("deck").agg(F.collect_set(F.char_length("gram")).alias("sizes"), F.collect_set("gram").alias("starts"))
    # All runs of n characters, by an empty match before each.
    runs = lambda n: F.when(F.array_contains("sizes", n), F.regexp_extract_all("bundle", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    grams = F.array_intersect(F.concat(*(runs(n) for n in range(1, GRAM + 1))), F.col("starts"))
    wanted = segments.select(*KEYS, "deck", "bundle").join(sent(starts), "deck").select(*KEYS, "deck", *(["bundle"] if small else []), F.explode(grams).alias("gram"))
    met = wanted.join(sent(titles), ["deck", "gram"])
    if not small:
        met = met.join(segments.select(*at, "bundle"), at)
    return met.filter(F.contains("bundle", F.col("title"))).select(*KEYS, "slide_index")


def slide_scores(segments: DataFrame, slides: DataFrame, most: int = 8, most_sent: int = 400_000) -> DataFrame:
    """Slides of value of the segment's deck: 20 for title weight, 6 for body weight, 4 for both, 18 if the title stands in the text.

    Of the slides, those of the segments' decks are looked at. With up to most_sent tokens they are sent to the segments,
    so that a segment's hits are added up where it stands; beyond that both are dealt by deck and token.
    """
    good = slides.filter(~F.coalesce("low", F.lit(False))).join(segments.select("deck").distinct(), "deck", "left_semi")
    n_tokens = good.agg(F.sum(1 + F.size(T.tokens(F.col("title"))) + F.size(T.tokens(F.col("text"))))).first()[0] or 0
    small = n_tokens <= most_sent
    s = token_rows(segments, "tokens", *KEYS, "deck")
    part = lambda text, name: token_rows(good.withColumn("t", T.tokens(F.col(text))), "t", "deck", "slide_index").select("deck", "token", "slide_index", F.lit(name).alias("part"))
    parts = part("title", "title").unionByName(part("text", "body"))
    hits = s.join(F.broadcast(parts) if small else parts, ["deck", "token"])
    of = lambda name: F.when(F.col("part") == name, F.col("w")).otherwise(0.0)
    scored = hits.select(*KEYS, "slide_index", of("title").alias("title_w"), of("body").alias("body_w"), F.lit(False).alias("exact"))
    titles = exact_titles(segments, good, small).select(*KEYS, "slide_index", F.lit(0.0).alias("title_w"), F.lit(0.0).alias("body_w"), F.lit(True).alias("exact"))
    rows = scored.unionByName(titles).groupBy(*KEYS, "slide_index").agg(F.sum("title_w").alias("title_w"), F.sum("body_w").alias("body_w"), F.max("exact").alias("exact"))
    score = 20 * F.col("title_w") + 6 * F.col("body_w") + F.when((F.col("title_w") > 0) & (F.col("body_w") > 0), 4.0).otherwise(0.0) + F.when(F.col("exact"), 18.0).otherwise(0.0)
    return _ranked(rows.withColumn("score", score), most, F.desc("score"), F.col("slide_index")).select(*KEYS, "slide_index", "title_w", "body_w", "exact", "score", "rank")
