"""Scalar text functions as Column expressions: tokens, quality, titles, times. No Python runs on executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, the default token weights, the words that say nothing about a page.
TOKEN = r"[0-9A-Za-z]+|[\x{4e00}-\x{9fff}]{2,}"
WEIGHTS = {"transformer": 0.0, "bert": 0.5, "rnn": 0.25, "dnn": 0.25, "lstm": 0.5, "gru": 0.5, "cls": 0.75, "sep": 0.75, "embedding": 0.75, "text": 0.25, "representations": 0.5}
UNINFORMATIVE = ["transformer", "bert"]
# What slide text may hold (of marks, ASCII ones alone), and signs of a broken encoding; the last of them is
# a Hebrew accent, written as an escape because it would merge with the character before it on the screen.
SLIDE_CHARS = r"\s\p{Z}A-Za-z0-9+\-_=:/%()\[\]{}.,<>*|\x{4e00}-\x{9fff}αβγδθλμστφψωℎ"
BROKEN, BROKEN_LINE = "[ǍǓǗǝǜƲƭƹ]", "[ǍǓǗǝǜƲƭƹ\u05a9]"
# Words of lecture talk before the matter of a heading.
TALK = (r"^(?:本段|本节|这一段|该段|这里|接下来|随后|最后)(?:主要|重点|先|继续)?", r"^(?:(?:主要|重点|先|继续)?(?:讲解|介绍|说明|讨论|围绕|展开|分析|讲))(?:了|的是)?", r"^[了把将关于对从与和：:，,。 ]+")
# Signs of a sentence about the editing process.
PROCESS = ["修正", "误听", "误识别", "ocr", "证据不足", "不补写公式", "未编造公式", "raw -> cleaned", "统一为", "理顺句子", "同音误识别", "口误"]


def squeeze(text: Column) -> Column:
    """Runs of (Unicode) white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokens(*texts: Column) -> Column:
    """Distinct tokens of two or more characters over all texts."""
    return F.array_distinct(F.filter(raw_tokens(F.concat_ws(" ", *texts)), lambda t: F.char_length(t) >= 2))


def informative(found: Column) -> Column:
    return F.array_except(found, F.array(*map(F.lit, UNINFORMATIVE)))


def weight(token: Column, table: dict[str, float] | None = None) -> Column:
    table = WEIGHTS if table is None else table
    chain = F.when(F.trim(token) == "", 0.0)
    for value in sorted(set(table.values())):
        chain = chain.when(F.lower(F.trim(token)).isin([t for t, w in table.items() if w == value]), value)
    return chain.otherwise(1.0)


def weighted(found: Column) -> Column:
    """Total weight; all weights are quarters, so that the order of the sum does not matter."""
    return F.aggregate(F.transform(found, lambda t: weight(t)), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | a.isNull() | b.isNull(), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def text_quality(text: Column) -> Column:
    """Length, eight for each token (repeats too), minus two for each odd character; 0 for empty."""
    norm = squeeze(F.coalesce(text, F.lit("")))
    odd = F.char_length(F.regexp_replace(norm, r"[\p{L}\p{N}\x{4e00}-\x{9fff} \-_/.:,;()\[\]{}+*=%]", ""))
    return F.when(norm == "", 0.0).otherwise((F.char_length(norm) + 8 * F.size(F.regexp_extract_all(norm, F.lit(TOKEN), F.lit(0))) - 2 * odd).cast("double"))


def hms(seconds: Column) -> Column:
    whole = F.greatest(seconds, F.lit(0.0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def stamp(seconds: Column) -> Column:
    whole = F.greatest(seconds, F.lit(0.0)).cast("long")
    short = F.format_string("[%02d:%02d]", F.floor(whole / 60), whole % 60)
    return F.when(whole >= 3600, F.concat(F.lit("["), hms(seconds), F.lit("]"))).otherwise(short)


def slug(path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    made = F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^0-9a-z\x{4e00}-\x{9fff}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("video"))


#: What is stripped from the ends of a sentence or point.
POINT_EDGES = r"^[ ,，、]+|[ ,，、]+$"


def point(text: Column) -> Column:
    return F.regexp_replace(squeeze(text), POINT_EDGES, "")


def sentences(text: Column, limit: int) -> Column:
    """The first sentences of six or more characters."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), r"[。！？；\n]+"), lambda s: point(s))
    return F.slice(F.filter(cut, lambda s: F.char_length(s) >= 6), 1, limit)


def without_label(text: Column) -> Column:
    """A label of at most eight characters before a colon goes; the wide colon is tried first."""
    norm = point(text)
    # The label patterns.
    wide, plain = r"^\s*[^：]{1,8}：\s*(\S.*)$", r"^\s*[^:]{1,8}:\s*(\S.*)$"
    return F.when(norm.rlike(wide), F.trim(F.regexp_extract(norm, wide, 1))).when(norm.rlike(plain), F.trim(F.regexp_extract(norm, plain, 1))).otherwise(norm)


def heading(text: Column) -> Column:
    return F.trim(reduce(lambda c, p: F.regexp_replace(c, p, ""), TALK, squeeze(text)))


def about_process(text: Column) -> Column:
    low = F.lower(squeeze(text))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in PROCESS])


def slide_text(text: Column) -> Column:
    """Tokens without combining and format characters; those with too much unsupported or broken text go."""
    words = F.transform(F.split(squeeze(F.translate(text, " ", " ")), " "), lambda t: F.regexp_replace(t, r"[\p{M}\p{Cf}]", ""))
    good = F.filter(words, lambda t: (t != "") & (F.char_length(F.regexp_replace(t, f"[^{SLIDE_CHARS}]", "")) >= 0.85 * F.char_length(t)) & ~t.rlike(BROKEN))
    return F.regexp_replace(squeeze(F.array_join(good, " ")), r"\s+([,.;:，。；：、])", "$1")


def slide_noise(text: Column) -> Column:
    """Signs of a broken encoding, or two characters and more that a slide does not hold."""
    return (F.trim(text) != "") & (text.rlike(BROKEN_LINE) | (F.char_length(F.regexp_replace(text, f"[{SLIDE_CHARS}]", "")) >= 2))


def _line_title(line: Column) -> Column:
    """The title that a line of a page gives, or null: a long first word before scattered short ones, else the words before a run of three single characters."""
    words = F.split(line, r"\s+")
    single = lambda w: w.rlike(r"^[\x{4e00}-\x{9fff}A-Za-z]$")
    ends = F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(words) - 1)), lambda i: F.coalesce(single(F.get(words, i)) & single(F.get(words, i - 1)) & single(F.get(words, i - 2)), F.lit(False)))
    before = F.array_join(F.when(F.size(ends) > 0, F.slice(words, F.lit(1), F.get(ends, F.lit(0)))).otherwise(words), " ")
    head = F.get(words, F.lit(0))
    tail = F.filter(F.slice(words, F.lit(2), F.size(words)), lambda w: F.char_length(w) <= 2)
    fits = lambda t: F.char_length(t).between(2, 40)
    scattered = (F.size(words) >= 4) & (F.char_length(head) >= 4) & (F.size(tail) >= 3) & fits(head)
    found = F.when(scattered, head).when(fits(before), before)
    return F.when(F.char_length(line).between(2, 80) & ~slide_noise(line), found)


def page_title(text: Column, index: Column) -> Column:
    """The title of a page of text: the first line (between breaks, bars and dots) that gives one, else its number."""
    lines = F.filter(F.transform(F.split(text, r"[\n|·•]+"), lambda x: F.trim(x)), lambda x: x != "")
    titles = F.filter(F.transform(lines, _line_title), lambda t: t.isNotNull())
    return F.coalesce(F.get(titles, F.lit(0)), F.concat(F.lit("Slide "), index.cast("string")))


def page_is_low(title: Column, text: Column) -> Column:
    """Pages that say little: hardly any text, or a table of contents. The titles."""
    return (F.char_length(text) < 8) | F.lower(title).isin("contents", "目录", "slide") | F.contains(title, F.lit("目录"))


def clean_page_title(title: Column, clean_text: Column, index: Column) -> Column:
    """A page's title after sanitising; noise and placeholders give way to a title from the clean text."""
    own = slide_text(title)
    kept = F.when(own == "", F.concat(F.lit("Slide "), index.cast("string"))).otherwise(page_title(own, index))
    return F.when((kept == "") | slide_noise(kept) | F.lower(kept).startswith("slide "), page_title(clean_text, index)).otherwise(kept)


def slide_title(text: Column) -> Column:
    """A page title, or an empty string for a placeholder."""
    # The marks at the ends, and the placeholders.
    norm = F.regexp_replace(squeeze(text), r"^[-_.:：]+|[-_.:：]+$", "")
    low = F.lower(norm)
    return F.when((F.char_length(norm) < 4) | low.isin("title", "agenda", "contents") | low.rlike(r"^slide\s+\d+$") | norm.rlike(r"^第?\d+页$"), "").otherwise(norm)


def formulas(sources: Column, limit: int = 3) -> Column:
    """Distinct formula-like chunks of an array of texts, in order."""
    # The pattern of a formula, its marks, and where a text is cut.
    fragment = r"([A-Za-z][A-Za-z0-9_(){}\[\]]*\s*=\s*[^，。；;\n]+)"
    marks, cuts = r"[^=+\-*/^_()\[\]{}<>∑Σ√≤≥≈]", r"[；;\n]+"
    chunks = F.transform(F.flatten(F.transform(sources, lambda s: F.split(F.coalesce(s, F.lit("")), cuts))), lambda c: squeeze(c))
    chunks = F.transform(chunks, lambda c: F.when(c.rlike(fragment), F.trim(F.regexp_extract(c, fragment, 1))).otherwise(c))
    math = lambda c: F.char_length(F.regexp_replace(c, marks, "")) >= 2
    named = lambda c: F.char_length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) >= 3
    return F.slice(F.array_distinct(F.filter(chunks, lambda c: (c != "") & (c.rlike(r"\\frac|\\sum|\\log") | (math(c) & named(c))))), 1, limit)


def unique_points(points: Column, limit: int) -> Column:
    """In order, points that neither hold nor are held by one kept before, white space aside."""
    bare = lambda p: F.regexp_replace(p, r"(?U)\s+", "")
    held = lambda kept, p: F.exists(kept, lambda k: F.contains(bare(k), bare(p)) | F.contains(bare(p), bare(k)))
    add = lambda kept, p: F.when((p == "") | held(kept, p) | (F.size(kept) >= limit), kept).otherwise(F.concat(kept, F.array(p)))
    return F.aggregate(F.transform(points, lambda p: point(p)), F.array().cast("array<string>"), add)


def reader_points(points: Column, limit: int = 3) -> Column:
    cut = F.transform(points, lambda p: point(p))
    return unique_points(F.filter(cut, lambda p: (F.char_length(p) >= 8) & ~about_process(p)), limit)


def ends_sentence(text: Column) -> Column:
    return F.trim(text).rlike(r"""[。！？!?；;.](["'”’)\]]+)?$""")


def hash_distance(a: Column, b: Column) -> Column:
    """Differing characters of two equally long hashes, else 999."""
    letters = lambda h: F.filter(F.split(h, ""), lambda c: c != "")
    differ = F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull() | (a == "") | (F.length(a) != F.length(b)), 999).otherwise(differ)
