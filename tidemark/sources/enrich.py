"""Enrichers: speech, recognition and language-model steps as pluggable functions over partitions, and a download manifest.

An enricher is called for each row with a bounded number of attempts; what fails keeps its reasons. The
rule-based default marks every segment with its first sentence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (row as a dict, reasons of the last attempt) -> (summary, reasons); no reasons: passed.
Enricher = Callable[[dict, list[str]], tuple[str, list[str]]]


def first_sentence(row: dict, reasons: list[str]) -> tuple[str, list[str]]:
    text = (row.get("text") or "").strip()
    return text.split("\n")[0][:80], [] if text else ["empty text"]


def enriched(rows: DataFrame, enrich: Enricher = first_sentence, attempts: int = 2) -> DataFrame:
    """rows with (summary, attempt_count, passed, failure_reasons); attempts are made within the task, so that a retry of the task alone repeats them."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                reasons: list[str] = []
                for n in range(1, attempts + 1):
                    summary, reasons = enrich(row, reasons)
                    if not reasons:
                        break
                out.append((summary, n, not reasons, reasons))
            yield b.assign(**{c: [x[k] for x in out] for k, c in enumerate(("summary", "attempt_count", "passed", "failure_reasons"))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(work, f"{fields}, summary string, attempt_count int, passed boolean, failure_reasons array<string>")


def manifest(files: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Videos still to fetch (name, url, type): only type video, not there yet unless forced, with names that do not collide."""
    safe = F.regexp_replace(F.trim("name"), r'[\\/:*?"<>|\x00-\x1f]+', "_")
    rows = files.filter("type = 'video'").withColumn("safe", safe).withColumn("r", F.row_number().over(Window.partitionBy("safe").orderBy("url")))
    rows = rows.select("url", F.when(F.col("r") == 1, F.col("safe")).otherwise(F.concat("safe", F.lit("_"), F.col("r"))).alias("name"))
    return rows if force else rows.join(existing.select("name"), "name", "left_anti")
