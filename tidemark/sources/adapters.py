"""The test tables as streams of utterances, frames, slides and reviews; transcript and tolerant JSON sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_page_title, page_is_low, page_title, slide_text, squeeze


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalised(raw: DataFrame) -> DataFrame:
    """Utterances (stream_id, index, start, end, text): blanks go, white space is squeezed, an end of zero or before the start becomes the start. Indexes are those of the raw rows."""
    text = squeeze(F.coalesce("text", F.lit("")))
    start = F.coalesce("start", F.lit(0.0))
    end = F.greatest(F.coalesce(F.nullif("end", F.lit(0.0)), start), start)
    return raw.select("stream_id", "index", start.alias("start"), end.alias("end"), text.alias("text")).filter("text <> ''")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON transcripts, one file a stream (multi-line): segments without text or of a wrong type go; a broken file gives nothing."""
    schema = "segments array<struct<start:double,end:double,text:string>>"
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("stream_id"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"))
    rows = files.select("stream_id", F.posexplode("j.segments").alias("p", "s")).select("stream_id", (F.col("p") + 1).alias("index"), "s.start", "s.end", "s.text")
    return normalised(rows)


def plain_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Plain text fallback: all lines that are not blank, as one utterance at 0."""
    lines = F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: x != "")
    return normalised(spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("stream_id"), F.lit(1).alias("index"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.array_join(lines, " ").alias("text")))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a stream, a turn lasts 20 s."""
    turn = F.col("turn").cast("double")
    return normalised(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), (F.col("turn") + 1).alias("index"), (turn * 20).alias("start"), (turn * 20 + 20).alias("end"), "text"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a stream; an event is a frame at the hours since the user's first event."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", (F.col("value") / 500).alias("change_ratio"), F.concat_ws(" ", "event_type", "props").alias("ocr_text"))
    first = F.min("at").over(Window.partitionBy("stream_id"))
    component, scene = F.col("change_ratio") * (F.col("event_id") % 10) / 20, F.col("change_ratio") * 50
    return rows.select("stream_id", "event_id", ((F.col("at") - first) / F.lit(3.6e9)).alias("ts"), "event_type", "change_ratio", component.alias("component_ratio"), scene.alias("scene_score"), F.substring(F.md5(F.col("event_type").cast("binary")), 1, 16).alias("phash"), "ocr_text")


def page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents in a row are the frames of a stream, 16 s apart; their opening is the recognised text, two in a row have one hash."""
    doc = F.col("doc_id")
    ratio = (doc * 7919) % 1000 / 4000
    rows = table(spark, sf_dir, "documents").select(F.floor(doc / 10).alias("stream_id"), doc.alias("event_id"), ((doc % 10) * 16).cast("double").alias("ts"), ratio.alias("change_ratio"), ((doc * 104729) % 100 / 2000).alias("component_ratio"), (ratio * 60).alias("scene_score"), F.substring(F.md5(F.floor(doc / 2).cast("string").cast("binary")), 1, 16).alias("phash"), squeeze(F.substring(F.coalesce("text", F.lit("")), 1, 160)).alias("ocr_text"))
    return rows.withColumn("relative_path", F.format_string("frames/frame_%d.jpg", "event_id"))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents in a row are a deck's pages; the first three lines are the page's text."""
    lines = F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 3)
    index = (F.col("doc_id") % 50 + 1).cast("int")
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("deck"), index.alias("slide_index"), squeeze(F.array_join(F.transform(lines, lambda x: F.trim(F.substring(x, 1, 80))), " | ")).alias("text"))
    return pages(rows)


def pages(rows: DataFrame) -> DataFrame:
    """(deck, slide_index, text) as slide pages: title, path, and whether they say little."""
    rows = rows.withColumn("title", page_title(F.col("text"), F.col("slide_index")))
    return rows.withColumn("relative_path", F.format_string("slides/slide_%03d.png", "slide_index")).withColumn("low", page_is_low(F.col("title"), F.col("text")))


def sanitised(rows: DataFrame) -> DataFrame:
    """Slide pages with clean text and title."""
    text = slide_text(F.trim("text"))
    out = rows.withColumn("text", text).withColumn("title", clean_page_title(F.trim("title"), F.col("text"), F.col("slide_index")))
    return out.withColumn("low", page_is_low(F.col("title"), F.col("text")))


def first_full(*sources: DataFrame) -> DataFrame:
    """Of several sources of the same rows (stream_id first), the first that has any row of a stream gives all of that stream's."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other.join(out.select("stream_id").distinct(), "stream_id", "left_anti"))
    return out


def head_lines(spark: SparkSession, path: str, most: int = 6) -> DataFrame:
    """(stream_id, lines): the first lines of text files that are not blank."""
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("stream_id"), F.slice(lines, 1, most).alias("lines"))


def preferred(cleaned: Column, raw: Column) -> Column:
    """The cleaned text, if it says anything, else the raw one."""
    return F.coalesce(F.nullif(F.trim(cleaned), F.lit("")), raw)


def explicit_path(spark: SparkSession, path: str | None) -> str | None:
    """A path that was given and is there; nothing is looked for otherwise."""
    if not path:
        return None
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else None


def frame_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, n, ts): a folder's frames in order of their names; their times are not known (0)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.jpg").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumn("name", name).withColumn("n", F.row_number().over(Window.orderBy("name"))).withColumn("ts", F.lit(0.0))


def numbered_frames(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """planned (stream_id, at) with the numbers after the largest that a stream has."""
    last = existing.groupBy("stream_id").agg(F.max("n").alias("last"))
    rows = planned.distinct().join(last, "stream_id", "left")
    order = Window.partitionBy("stream_id").orderBy("at")
    return rows.select("stream_id", "at", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).alias("n"))
