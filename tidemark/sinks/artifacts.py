"""Where a stream's artifacts are, and how tables become them: JSON, one folder for each artifact, partitioned by stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# The folder of each artifact below a stream's `pipeline` folder, and its file.
FILES = {
    "pipeline_readme_md": "README.md",
    "metadata_json": "00_run/metadata.json",
    "work_dir_agents_md": "00_run/AGENTS.md",
    "audio_path": "01_media/audio/audio.wav",
    "transcript_txt": "01_media/audio/transcript.txt",
    "transcript_srt": "01_media/audio/transcript.srt",
    "transcript_json": "01_media/audio/transcript.json",
    "transcript_vtt": "01_media/audio/transcript.vtt",
    "transcript_tsv": "01_media/audio/transcript.tsv",
    "visual_candidates_dir": "01_media/visual/visual_candidates",
    "visual_candidates_ocr_json": "01_media/visual/visual_candidates.ocr.json",
    "visual_units_json": "01_media/visual/visual_units.json",
    "transcript_cleaned_txt": "02_review/transcript.cleaned.txt",
    "transcript_corrections_json": "02_review/transcript.corrections.json",
    "codex_review_prompt_md": "02_review/codex_review_prompt.md",
    "review_report_json": "02_review/review_report.json",
    "review_segments_json": "02_review/review_segments.json",
    "slides_preview_dir": "03_alignment/slides_preview",
    "slides_index_raw_json": "03_alignment/slides_index.raw.json",
    "slides_index_json": "03_alignment/slides_index.json",
    "slides_cleanup_prompt_md": "03_alignment/slides_cleanup_prompt.md",
    "slides_cleanup_report_json": "03_alignment/slides_cleanup_report.json",
    "visual_alignment_json": "03_alignment/visual_alignment.json",
    "ppt_alignment_debug_md": "03_alignment/ppt_alignment_debug.md",
    "note_outline_json": "04_structure/note_outline.json",
    "note_blocks_json": "04_structure/note_blocks.json",
    "note_generation_prompt_md": "05_note/note_generation_prompt.md",
    "note_generation_report_json": "05_note/note_generation_report.json",
    "note_path": "05_note/note.md",
}


def artifact_path(root: str, video: Column, name: str) -> Column:
    """The path of a stream's artifact, from its video's name."""
    return F.concat(F.lit(root.rstrip("/") + "/"), T.slug(video), F.lit(f"/pipeline/{FILES[name]}"))


def relative_path(path: Column, folder: Column) -> Column:
    """A path below the folder as it is seen from there; others stay."""
    inside = F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, inside), F.substring(path, F.length(inside) + 1, F.length(path))).otherwise(path)


def now_label() -> Column:
    """The time of the run, to the second, with its zone."""
    return F.date_format(F.date_trunc("second", F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ssXXX")


def write_json(rows: DataFrame, root: str, name: str) -> str:
    """One artifact of all streams as JSON lines, partitioned by stream_id; an earlier one of the same streams is replaced, others stay."""
    folder = f"{root.rstrip('/')}/{name}"
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("stream_id").json(folder)
    return folder


def write_text(rows: DataFrame, root: str, name: str, column: str = "markdown") -> str:
    """One text of each stream (notes, debug files), a file for each, partitioned by stream_id."""
    folder = f"{root.rstrip('/')}/{name}"
    rows.select("stream_id", F.col(column).alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("stream_id").text(folder)
    return folder
