"""Sentence-aware segmentation of utterances, and the frames beside a segment."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scores import in_band

_final = re.compile(r"""[。！？!?；;.](["'”’)\]]+)?$""")


def grouped(rows: list[tuple[float, float, str]], max_chars: int = 280, max_span: float = 150.0, more_chars: int = 120, more_span: float = 30.0, ahead: int = 2) -> list[int]:
    """The group of each (start, end, text), from 0. A group is full when the next utterance would pass a limit; if it
    then ends within a sentence, up to `ahead` more utterances join while they stay within the wider limits, until one
    ends a sentence; after that it is closed in any case."""
    out: list[int] = []
    group, chars, begin, extra = -1, 0, 0.0, None
    for k, (start, end, text) in enumerate(rows):
        size = chars + len(text) + 1
        open_ = group >= 0
        if open_ and extra is None and (size > max_chars or end - begin > max_span):
            extra = 0
        if open_ and extra is not None:
            fits = extra < ahead and not _final.search(rows[k - 1][2].strip()) and size <= max_chars + more_chars and end - begin <= max_span + more_span
            extra += 1
            open_ = fits
        if not open_:
            group, chars, begin, extra = group + 1, len(text), start, None
        else:
            chars = size
        out.append(group)
    return out


def review_segments(utterances: DataFrame, **limits: float) -> DataFrame:
    """(stream_id, segment_number, segment_id, start, end, segment_indexes, char_count, text); a stream is folded in order by one task, streams in parallel."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "index"], kind="stable")
        pdf["g"] = grouped(list(pdf[["start", "end", "text"]].itertuples(index=False, name=None)), **limits)
        return pdf

    rows = utterances.select("stream_id", "index", "start", "end", "text")
    g = rows.groupBy("stream_id").applyInPandas(work, "stream_id long, index long, start double, end double, text string, g long")
    parts = F.array_sort(F.collect_list(F.struct("start", "index", "end", "text")))
    out = g.groupBy("stream_id", "g").agg(parts.alias("p")).select("stream_id", (F.col("g") + 1).cast("int").alias("segment_number"), F.format_string("segment_%03d", F.col("g") + 1).alias("segment_id"), F.col("p")[0]["start"].alias("start"), F.element_at("p", -1)["end"].alias("end"), F.transform("p", lambda x: x["index"]).alias("segment_indexes"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))
    return out.withColumn("char_count", F.char_length("text"))


def hints(segments: DataFrame, frames: DataFrame, reach: float = 5.0, most: int = 3) -> DataFrame:
    """(stream_id, segment_number, segment_id, hints array<string>): the first distinct texts of frames beside each segment, in frame order."""
    keys = ["stream_id", "segment_number", "segment_id"]
    said = frames.withColumn("ocr_text", F.trim("ocr_text")).filter("ocr_text <> ''").select("stream_id", "ts", "event_id", "ocr_text")
    near = in_band(segments.select(*keys, "start", "end"), said, F.col("start") - reach, F.col("end") + reach, 120.0)
    first = near.groupBy(*keys, "ocr_text").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).filter(F.col("r") <= most)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "ocr_text"))), lambda x: x["ocr_text"]).alias("hints"))


def related_frames(segments: DataFrame, frames: DataFrame, reach: float = 5.0) -> DataFrame:
    """All frames beside each segment, bounds included."""
    return in_band(segments.select("stream_id", "segment_number", "start", "end"), frames, F.col("start") - reach, F.col("end") + reach, 120.0).drop("start", "end")
