"""Benchmark decontamination with DataFrame functions only: a prefix-filtered join of word windows.

Every item is cut into windows of `width` consecutive words (an item with fewer words is one window),
and a window into shingles of three words (a shorter window is one shingle). A window occurs in a
document only if all its shingles do, so that a prefix of one shingle is enough: shingles are ordered
by their count over all documents (ties: the hash), each window keeps its rarest one with its place,
and only these keys are joined with the documents' shingles. Shingles travel as 64-bit hashes;
equal hashes of different shingles only make candidates. Positional and length bounds drop places
where the window would stick out of the document. What is left is verified word by word on the whole
document, window by window.

Tables are broadcast only if a count says that they hold at most SMALL rows and BYTES bytes of text;
above that they are joined by shuffles, with the same result.

Defined cases: null and empty texts have no words; items without words, and with a null id, are
ignored; equal items count as one, equal ids with other texts as one id; rows of documents may repeat
and have null ids; empty tables give empty results, or clean documents; other columns are ignored;
very long texts are split and verified whole, in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, settle

# The characters between words, and the words, after lower-casing A-Z.
GAP, WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE, SMALL, BYTES = 3, 1_000_000, 16 << 20


def words(text: Column) -> Column:
    """array<string>; only A-Z are lower-cased (texts of ASCII alone can take the fast function)."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, GAP), "")


def small(df: DataFrame, *texts: str) -> DataFrame:
    """df, to be broadcast if it holds at most SMALL rows, and BYTES bytes in these text columns."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(16))
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= SMALL and total <= BYTES + 16 * rows else df


def shingles(w: Column, n: int) -> Column:
    """array<long>: a hash of each n neighbouring words, in order."""
    hashes = F.transform(w, lambda x, i: F.xxhash64(F.lit(n), x, *(F.get(w, i + k) for k in range(1, n))))
    return F.slice(hashes, F.lit(1), F.greatest(F.lit(0), F.size(w) - n + 1))


def shingle_places(rows: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """(keep, n, at, key): the shingles of column w, of each size."""
    parts = [rows.select(*keep, F.size("w").alias("n"), F.posexplode(shingles(F.col("w"), n)).alias("at", "key")) for n in sizes]
    return reduce(DataFrame.unionAll, parts)


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>), one for each row of docs. Extra columns of docs are not kept."""
    # Rows meet their candidates by id; a null id, by its text. Candidates are verified, so ids may repeat.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("k", F.coalesce(F.xxhash64(F.when(F.col("doc_id").isNotNull(), F.col("doc_id").cast("string"))), F.lit(0)) + F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0))
    bench = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).filter("size(w) > 0").distinct()
    bench = settle(bench.withColumn("item", F.xxhash64("item_id", "w")).withColumn("s", F.least(F.size("w"), F.lit(SHINGLE))), "items")
    sizes = sorted(r["s"] for r in bench.select("s").distinct().collect()) or [SHINGLE]  # SHINGLE values at most

    # The documents' shingles that some item has: one pass over the texts.
    placed = reduce(DataFrame.unionAll, [shingle_places(bench.filter(F.col("s") == n), [n], "item", "s") for n in sizes])
    vocabulary = settle(placed.select("key").distinct(), "vocabulary")
    seen = shingle_places(texts.select("k", words(F.col("text")).alias("w")), sizes, "k").join(small(vocabulary), "key")
    seen = settle(seen.select("k", "n", "at", "key"), "seen")
    counts = settle(vocabulary.join(seen.groupBy("key").count(), "key"), "counts")

    # The rarest shingle of each window; windows with the same one stand beside each other: starts lo to hi.
    length = F.least(F.col("n"), F.lit(width))
    windows = placed.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") + F.col("s") - length), F.least(F.col("at"), F.col("n") - length))))
    # A window with a shingle that no document has can't occur: its rarest has count 0 and goes.
    rarest = windows.join(small(counts), "key", "left").fillna(0, ["count"]).groupBy("item", "start").agg(F.min(F.struct("count", "key", "at")).alias("r")).filter("r.count > 0")
    keys = rarest.groupBy("item", F.col("r.key").alias("key"), F.col("r.at").alias("at")).agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    length = F.least(F.size("w"), F.lit(width))
    keys = keys.join(bench.select("item", "item_id", "w"), "item").select("key", "item_id", (F.col("at") - F.col("lo")).alias("back"), length.alias("len"), F.slice("w", F.col("lo") + 1, F.col("hi") - F.col("lo") + length).alias("run")).withColumn("size", F.array_join("run", " "))
    keys = settle(keys, "keys")

    found = seen.join(small(keys, "item_id", "size"), "key").withColumn("first", F.col("at") - F.col("back"))
    # Some window of the run must lie within the document.
    found = found.filter((F.greatest(F.col("first"), F.lit(0)) + F.col("len") <= F.col("n")) & (F.col("first") + F.size("run") >= F.col("len")))
    # One group a document: as many candidates as windows that share its rare shingles.
    found = settle(found.groupBy("k").agg(F.collect_set(F.struct("first", "len", "run", "item_id")).alias("found")), "found")

    def hits(w: Column, c: Column) -> Column:
        """(start, len, item_id) of the windows of a candidate that stand in the document."""
        at = F.filter(F.sequence(F.lit(0), F.size(c["run"]) - c["len"]), lambda j: (c["first"] + j >= 0) & (F.slice(w, F.greatest(c["first"] + j, F.lit(0)) + 1, c["len"]) == F.slice(c["run"], j + 1, c["len"])))
        return F.transform(at, lambda j: F.struct((c["first"] + j).alias("start"), c["len"].alias("len"), c["item_id"].alias("item_id")))

    # Only texts with candidates travel, where their keys are few enough to broadcast.
    keyed = small(found.select("k"))
    clean = texts.join(keyed, "k", "left_anti").select("doc_id", F.regexp_count(F.col("text"), F.lit(WORD)).alias("n"), F.lit(None).cast("array<struct<start:int,len:int,item_id:string>>").alias("h"))
    joined = texts.join(keyed, "k", "left_semi").join(found, "k")
    true = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.flatten(F.transform("found", lambda c: hits(w, c))).alias("h")))
    rows = clean.unionByName(joined.select("doc_id", true.alias("t")).select("doc_id", "t.n", "t.h"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("h", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))))
    names = F.array_sort(F.array_distinct(F.transform("h", lambda h: h["item_id"])))
    return rows.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_words"), F.when(F.col("h").isNull(), 0).otherwise(covered).cast("long").alias("n_hit"), F.coalesce(names, F.array().cast("array<string>")).alias("items"))


def decontamination_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
