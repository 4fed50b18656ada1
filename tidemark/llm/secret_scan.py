"""Secret scans with DataFrame functions only.

Base spans come from three fixed patterns, leftmost and non-overlapping for each kind, in code points.
More spans ("markov") come from long runs of key characters: two character Markov models, one of
random strings and one of ordinary identifiers, are compared by log-likelihood ratio, on the parts of
a run outside base spans (20 characters or more each). A part whose total ratio reaches the margin is
a secret too; else each of its best-scoring stretches is that reaches it, so identifiers before a token
can't hide it. A stretch of under 20 characters, grown to the ends of its letters and digits, is none. The models are learnt
from labelled samples: random strings made by hashing a fixed range, and identifiers joined from all
words of at most sample_rows documents (those of smallest hash of id and text; repeats of a row count
with it) that hold no base span.

Defined cases: a null text is an empty one without spans; rows may repeat, ids may be null; an empty
table gives an empty result (and a model of random strings alone); other columns are ignored, and
kept by redact(). Very long texts are scanned whole, in time that grows with their length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, smallest_hashes

# The kinds in order, their patterns and least lengths (group 2 for assign, else the match).
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's matches; value is the group. Texts without a match skip the work."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["whole"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    zipped = F.arrays_zip(whole.alias("whole"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(zipped, zero, add, lambda s: s["out"])).otherwise(empty)


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end, kind>>, sorted by start, then kind as listed."""

    def of(k: int, kind: str) -> Column:
        pattern, group, least = KINDS[kind]
        kept = F.filter(matches(text, pattern, group), lambda m: F.char_length(m["value"]) >= least)
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def samples(docs: DataFrame, sample_rows: int = 2000, random_rows: int = 4000) -> DataFrame:
    """(value, random boolean): labelled strings to learn from. docs: (doc_id, text)."""
    seed = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    made = docs.sparkSession.range(random_rows).select(F.explode(F.array(F.base64(F.unhex(seed)), seed, F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(seed.cast("binary"), 512))), "[+/=]", ""), 1, 40), F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(seed.cast("binary"), 384))), "[+/=]", ""), 1, 24)))).alias("value"), F.lit(True).alias("random"))
    clean = smallest_hashes(docs.filter("text IS NOT NULL"), F.xxhash64(F.col("doc_id").cast("string"), "text"), sample_rows)
    clean = clean.filter(F.size(base_spans(F.col("text"))) == 0).select(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w")).filter("size(w) > 0")
    # Each three words make an identifier, joined in turn by one of four signs; all words stand by themselves too.
    sign = F.array(*map(F.lit, ("_", "", "-", "/")))
    joined = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 3).cast("int")), lambda k: F.call_function("array_join", F.slice("w", k * 3 + 1, F.lit(3)), F.get(sign, k % 4)))
    own = clean.select(F.explode(F.concat(joined, "w")).alias("value"), F.lit(False).alias("random"))
    return made.unionByName(own)


def learn(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of the character pairs, row by row over ALPHABET; one added to each count."""
    chars = F.split(F.regexp_replace("value", f"[^{ALPHABET[:-1]}-]", ""), "")
    pairs = labelled.select("random", F.explode(F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))).alias("pair")).filter("char_length(pair) = 2")
    n = len(ALPHABET)
    counts = {True: [1.0] * (n * n), False: [1.0] * (n * n)}
    for r in pairs.groupBy("random", "pair").count().collect():  # 2 * len(ALPHABET)**2 rows at most
        counts[r["random"]][ALPHABET.index(r["pair"][0]) * n + ALPHABET.index(r["pair"][1])] += r["count"]
    rows = {k: [sum(c[i * n : i * n + n]) for i in range(n)] for k, c in counts.items()}
    return [math.log(counts[True][i] / rows[True][i // n]) - math.log(counts[False][i] / rows[False][i // n]) for i in range(n * n)]


def ratios(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of each pair of adjacent characters."""
    cells = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    places = F.transform(F.split(value, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    return let(places, lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda b, i: F.coalesce(F.get(cells, F.get(p, i) * len(ALPHABET) + b), F.lit(0.0))))


def outside(run: Column, base: Column) -> Column:
    """array<struct<start, end, value>>: the parts of a run that no base span (sorted by start) covers, LEAST characters or more each."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    part = lambda a, b: F.when(b - a >= LEAST, F.array(F.struct(a.alias("start"), b.alias("end")))).otherwise(empty)
    over = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    zero = F.struct(run["start"].alias("at"), empty.alias("out"))
    cut = F.aggregate(over, zero, lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), F.concat(s["out"], part(s["at"], b["start"])).alias("out")), lambda s: F.concat(s["out"], part(s["at"], run["end"])))
    return F.transform(cut, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring(run["value"], x["start"] - run["start"] + 1, x["end"] - x["start"]).alias("value")))


def stretches(r: Column, margin: float) -> Column:
    """array<struct<start, end>> of the best-scoring stretches of a string with these ratios: those that reach the margin.

    A stretch ends where the running sum is at its most; the next may begin once the sum has fallen to nothing or by the margin.
    """
    empty = F.array().cast("array<struct<start:int,end:int>>")
    won = lambda s: F.concat(s["out"], F.when(s["best"] >= margin, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(empty))
    state = lambda total, start, best, end, i, out: F.struct(total.alias("sum"), start.alias("start"), best.alias("best"), end.alias("end"), i.alias("i"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        total, i = s["sum"] + x, s["i"] + 1
        over = (total <= 0) | (total <= s["best"] - margin)
        better = total > s["best"]
        return F.when(over, state(F.lit(0.0), i, F.lit(0.0), i, i, won(s))).otherwise(state(total, s["start"], F.greatest(s["best"], total), F.when(better, i + 1).otherwise(s["end"]), i, s["out"]))

    return F.aggregate(r, state(F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), F.lit(0), empty), step, won)


def secret_parts(part: Column, table: list[float], margin: float) -> Column:
    """array<struct<start, end>>: a part that reaches the margin as a whole, else its best-scoring stretches, each to the ends of its letters and digits."""
    value = part["value"]
    before = lambda x: F.char_length(F.regexp_extract(F.substring(value, F.lit(1), x["start"]), "[A-Za-z0-9]*$", 0))
    after = lambda x: F.char_length(F.regexp_extract(F.substring(value, x["end"] + 1, F.char_length(value)), "^[A-Za-z0-9]*=*", 0))
    grown = lambda r: F.transform(stretches(r, margin), lambda x: F.struct((part["start"] + x["start"] - before(x)).alias("start"), (part["start"] + x["end"] + after(x)).alias("end")))
    whole = F.array(F.struct(part["start"].alias("start"), part["end"].alias("end")))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x)
    return let(ratios(value, table), lambda r: F.when(total(r) >= margin, whole).otherwise(F.array_distinct(F.filter(grown(r), lambda x: x["end"] - x["start"] >= LEAST))))


def spans(text: Column, table: list[float], margin: float = 10.0) -> Column:
    """Base spans and the method's own, sorted by start, then kind."""

    def more(base: Column) -> Column:
        parts = F.flatten(F.transform(matches(text, RUN), lambda m: outside(m, base)))
        found = F.flatten(F.transform(parts, lambda p: secret_parts(p, table, margin)))
        own = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("k"), m["end"].alias("end"), F.lit("markov").alias("kind")))
        return F.array_sort(F.concat(base, own))

    return let(base_spans(text), more)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, found): the spans of every row of docs. Narrow."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = learn(samples(rows))
    return rows.withColumn("found", spans(F.col("text"), table))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(scanned: DataFrame) -> DataFrame:
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["k"] < len(KINDS))
    return scanned.select("doc_id", *map(of, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), of("markov"))


def redact(docs: DataFrame, mark: str = "<secret>", text_col: str = "text", id_col: str = "doc_id", chars_col: str = "n_chars") -> DataFrame:
    """docs with every span replaced by a mark (overlapping spans by one); the count of characters follows, if there is one."""
    table = learn(samples(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))))
    text = F.col(text_col)

    def put(s: Column, x: Column) -> Column:
        joined = F.concat(s["out"], F.when(x["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), joined.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = let(spans(text, table), lambda found: F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, zero, put, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))))
    out = docs.withColumn(text_col, F.when(text.isNotNull(), clean))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(text.isNull(), F.col(chars_col)).otherwise(F.char_length(text)).cast(docs.schema[chars_col].dataType))
    return out
