"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is cut by the split pattern; each word becomes an array of byte tokens and a fold merges the
adjacent pair of lowest rank, leftmost first, until none is left. The rank map is a constant of the
plan (the value of a one-row scalar subquery): one array at displaced offsets, so that a lookup costs
two array reads. All words of all texts are counted; the most frequent (at most `keep`) are folded
once and kept in two more constants, maps in buckets for the very frequent and packed strings in
buckets for the others; rarer words are folded where they stand. These constants only save time: ids
are the same without them. Decoding looks up each id's piece, a
binary, and concatenates the pieces.

The only Python here runs in the driver, on the rank file. Characters that Unicode added as letters
after Java's own tables may split otherwise than in the library.

Defined cases: null and empty texts have no ids and decode to no bytes; repeated rows are encoded
each; ids of documents may be null or repeat; an empty table gives an empty result; other columns
are ignored; ids that the vocabulary lacks decode to no bytes. Very long texts are encoded whole, in
one row; a very long word (an unbroken run of letters, signs or blanks) is first cut between bytes
that stand beside each other in no token, which bounds the folds; a run without such a place costs a
pass for each distinct merge in it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, settle

# The white space of the split pattern, as the library's engine has it.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def java_pattern(pattern: str) -> str:
    """The split pattern with its white space spelt out (in Java, \\s is ASCII only). Neighbouring alternatives that are an apostrophe and letters are tried as one, which is faster."""
    pattern = re.sub(r"(?:'[a-z]+\|){2,}", lambda m: "'(?:" + m[0][1:-1].replace("|'", "|") + ")|", pattern)
    out, depth, i = "", 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\s":
            out += SPACE if depth else f"[{SPACE}]"
        elif two == "\\S":
            out += f"[^{SPACE}]"
        elif two[0] == "\\":
            out += two
        else:
            depth += (pattern[i] == "[") - (pattern[i] == "]")
            out += pattern[i]
            i -= 1
        i += 2
    return out


#: A pair's rank of at least this is none.
NONE = 1 << 17
#: Bits for the place in a long word, as many as an array has, and the none that goes with them.
PLACES = 31
NONE_LONG = 1 << (17 + PLACES)
#: Stands between the parts of a long word; no byte.
CUT = "\u0100"
#: Stand before and after a word in packed words; bytes that UTF-8 does not have.
BEFORE, AFTER = "FE", "FF"


#: A slot without a pair: its left is no token.
EMPTY = 1 << 40


def displaced(rows: dict[int, dict[int, int]], top: int, size: int = 1 << 19) -> tuple[list[int], list[int]]:
    """The pair table as one array: slot base[left] + right holds left * 2**17 + rank. Rows, the largest first, get the first of a fixed series of offsets where none of their slots is taken."""
    rng = np.random.default_rng(7)
    offsets = rng.integers(0, size - top, 1 << 16)
    base, slots = np.zeros(top, np.int64), np.full(size, EMPTY, np.int64)
    for left, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        rights = np.fromiter(row, np.int64, len(row))
        k = left % len(offsets)
        while (slots[offsets[k] + rights] != EMPTY).any():
            k = (k + 1) % len(offsets)
        base[left] = offsets[k]
        slots[offsets[k] + rights] = (left << 17) + np.fromiter(row.values(), np.int64, len(row))
    return base.tolist(), slots.tolist()


class ByteBpe:
    """Encode and decode expressions for a rank file."""

    #: Buckets of the most frequent words, and of the other frequent ones.
    WORD_BUCKETS, PACKED_BUCKETS = 1 << 15, 1 << 18
    #: Words with more bytes are cut into parts first; parts with more are folded with all places of a pair at once. The ids are the same.
    LONG = 48

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.spark, self.pattern = spark, java_pattern(pattern)
        self.top = max(ranks.values()) + 1
        by_left: dict[int, dict[int, int]] = {}
        odd = set()
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    by_left.setdefault(a, {})[b] = rank
                    odd |= {x for x in (a, b) if x > rank}
        # A merge whose result can take part in a merge of lower rank must go one place at a time.
        self.odd = sorted(odd)
        base, slots = displaced(by_left, self.top)
        bytes_ = [ranks[bytes([i])] for i in range(256)]
        pieces: list[str] = [""] * self.top
        for token, rank in ranks.items():
            pieces[rank] = token.hex()
        beside = np.zeros(1 << 16, bool)
        for token in ranks:
            for x, y in zip(token, token[1:], strict=False):
                beside[x << 8 | y] = True
        # Long Python lists are slow to hand over; strings are not.
        frame = spark.createDataFrame([tuple(",".join(map(str, x)) for x in (base, slots, bytes_, pieces, self.odd, beside.astype(int)))], "base string, slots string, bytes string, pieces string, odd string, beside string")
        numbers = lambda c, kind: F.split(c, ",").cast(f"array<{kind}>").alias(c)
        # A piece's bytes as they are, under the type string: array_join concatenates them without looking at them.
        raw = F.transform(F.split("pieces", ","), lambda x: F.unhex(x).cast("string")).alias("pieces")
        frame = frame.select(numbers("base", "int"), numbers("slots", "bigint"), numbers("bytes", "int"), raw, numbers("odd", "int"), numbers("beside", "int"))
        # Subqueries may not be written in a higher-order function: beside() puts them into a column of
        # their own, which the optimizer moves back into the one expression that reads it.
        self.tables = frame.select(F.struct("base", "slots", "bytes", "odd", "beside")).scalar()
        self.pieces = frame.select("pieces").scalar()
        self.words: Column | None = None
        self.packed: Column | None = None

    @staticmethod
    def _merged(slots: Column, base: Column, left: Column, right: Column) -> Column:
        """The rank of a pair's merge, or a number of NONE or more where it can't merge: the slot holds left * 2**17 + rank."""
        return F.get(slots, F.get(base, left) + right).bitwiseXOR(F.shiftleft(left.cast("long"), 17))

    def _best(self, t: Column, ids: Column) -> Column:
        """The lowest rank and its first place, as rank * 2**PLACES + place; NONE_LONG or more where nothing merges; null for one token."""
        rank = lambda i, x: F.least(self._merged(t["slots"], t["base"], F.get(ids, i), x), F.lit(NONE))
        return F.array_min(F.transform(F.slice(ids, F.lit(2), F.size(ids)), lambda x, i: F.shiftleft(rank(i, x), PLACES) + i))

    def _paired(self, slots: Column, base: Column, left: Column, right: Column) -> Column:
        """A token with the rank of its pair, as rank * 2**17 + token; a rank of NONE or more where the pair can't merge or there is no right one (null)."""
        return F.shiftleft(F.coalesce(self._merged(slots, base, left, right), F.lit(NONE).cast("long")), 17) + left

    def _fold(self, t: Column, ids: Column) -> Column:
        """Merge the leftmost pair of lowest rank, again and again. A token stands with the rank of its pair, so that a step looks up two pairs only: those of the new token."""

        def fold(slots: Column, base: Column) -> Column:
            token = lambda x: x.bitwiseAND(F.lit(NONE - 1)).cast("int")

            def merge(x: Column, m: Column, p: Column) -> Column:
                new = F.shiftright(m, 17).cast("int")
                # Most tokens stand behind the pair or before it, as they are; the first test decides for those behind.
                at = lambda v, i: F.when(i > p, v).when(i == p, self._paired(slots, base, new, token(F.get(x, p + 2)))).when(i == p - 1, self._paired(slots, base, token(v), new)).otherwise(v)
                return F.filter(F.transform(x, at), lambda _, i: i != p + 1)

            def step(x: Column, _: Column) -> Column:
                return let(F.array_min(x), lambda m: F.when(m < NONE << 17, let((F.array_position(x, m) - 1).cast("int"), lambda p: merge(x, m, p))).otherwise(x))

            start = F.transform(ids, lambda left, i: self._paired(slots, base, left, F.get(ids, i + 1)))
            return F.aggregate(F.slice(ids, F.lit(2), F.size(ids)), start, step, lambda x: F.transform(x, token))

        return let(t["slots"], lambda slots: let(t["base"], lambda base: fold(slots, base)))

    def _fold_long(self, t: Column, ids: Column) -> Column:
        """The same for long parts: ids as characters, all places of the lowest pair replaced at once, from the left.

        That equals one place at a time, as a new pair never ranks below the pair that made it; for
        the few results where it can (self.odd), only the first place is replaced.
        """
        first = 0x10000  # characters beyond the surrogates
        char = lambda x: F.decode(F.unhex(F.lpad(F.hex(x + first), 8, "0")), "UTF-32")
        codes = lambda s: F.transform(F.split(s, ""), lambda c: F.ascii(c) - first)

        def merge(text: Column, ids: Column, place: Column, m: Column) -> Column:
            pair = F.concat(char(F.get(ids, place)), char(F.get(ids, place + 1)))
            one = F.concat(F.substring(text, F.lit(1), place), char(m), F.substring(text, place + 3, F.length(text)))
            return F.when(F.array_contains(t["odd"], m), one).otherwise(F.replace(text, pair, char(m)))

        def step(s: Column, _: Column) -> Column:
            text, done = s["text"], F.struct(s["text"].alias("text"), F.lit(False).alias("live"))
            found = lambda ids: let(F.coalesce(self._best(t, ids), F.lit(NONE_LONG)), lambda b: F.when(b >= NONE_LONG, done).otherwise(F.struct(merge(text, ids, b.bitwiseAND(F.lit((1 << PLACES) - 1)).cast("int"), F.shiftright(b, PLACES).cast("int")).alias("text"), F.lit(True).alias("live"))))
            return F.when(s["live"], let(codes(text), found)).otherwise(s)

        start = F.array_join(F.transform(ids, char), "")
        return F.aggregate(ids, F.struct(start.alias("text"), F.lit(True).alias("live")), step, lambda s: codes(s["text"]))

    def _parts(self, t: Column, latin: Column) -> Column:
        """A long word cut between bytes that no token has beside each other: no merge ever crosses such a place."""
        follows = lambda cs, c, i: F.get(t["beside"], F.ascii(c) * 256 + F.ascii(F.get(cs, i + 1)))
        marked = lambda cs: F.array_join(F.transform(cs, lambda c, i: F.when(follows(cs, c, i) == 1, c).otherwise(F.concat(c, F.lit(CUT)))), "")
        return F.array_remove(F.split(let(F.split(latin, ""), marked), CUT), "")

    def _word(self, t: Column, word: Column) -> Column:
        tokens = lambda part: F.transform(F.split(part, ""), lambda c: F.get(t["bytes"], F.ascii(c)))
        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        part = lambda x: let(tokens(x), lambda ids: F.when(F.size(ids) > self.LONG, self._fold_long(t, ids)).otherwise(self._fold(t, ids)))
        return F.when(F.octet_length(word) > self.LONG, F.flatten(F.transform(self._parts(t, latin), part))).otherwise(let(tokens(latin), lambda ids: self._fold(t, ids)))

    def split(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    @staticmethod
    def _bucket(word: Column, buckets: int) -> Column:
        return F.hash(word).bitwiseAND(F.lit(buckets - 1))

    @staticmethod
    def _mark(byte: str) -> Column:
        return F.unhex(F.lit(byte)).cast("string")

    def _table(self, rows: DataFrame, buckets: int, entries: Column, none: Column, use: Callable[[Column], Column]) -> Column:
        """The buckets' entries of rows (w, ids) as one array, in order."""
        held = rows.groupBy(self._bucket(F.col("w"), buckets).alias("b")).agg(entries.alias("e"))
        every = self.spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(held, "b", "left")
        one = every.agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("e", none).alias("e")))).alias("all"))
        return settle(one.select(F.transform("all", lambda x: use(x["e"])).alias("words")), "frequent-words").scalar()

    def learn_words(self, docs: DataFrame, text_col: str = "text", keep: int = 524_288, longest: int = 32, quick: int = 65_536) -> ByteBpe:
        """Fold the most frequent words of all texts once: those of at least the least count that at most `keep` words reach. keep * longest bytes bound what the driver and each executor hold.

        Of them at most `quick` stand in maps, which are fast and take some 80 bytes a word; the others, packed into strings, take some 25.
        """
        words = docs.select(F.explode(self.split(F.col(text_col).cast("string"))).alias("w")).groupBy("w").count()
        step = F.floor(F.log2("count") * 16).cast("int").alias("step")
        counts = settle(words.filter(f"count > 1 AND length(w) <= {longest}").select("w", step), "words")
        least, often, total = None, None, 0
        for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # 16 * 64 rows at most
            total += r["count"]
            if total > keep:
                break
            least = r["step"]
            often = least if total <= quick else often
        if least is None:
            return self
        often = often if often is not None else 1 << 30

        def folded(top: DataFrame) -> DataFrame:
            return self.beside(top.select("w").repartition(64, "w")).select("w", let(F.col("__t"), lambda t: self._word(t, F.col("w"))).alias("ids"))

        ids = F.array_join(F.col("ids").cast("array<string>"), " ")
        line = F.array_join(F.collect_list(F.concat(ids, self._mark(BEFORE), F.col("w"), self._mark(AFTER))), "")
        # Both are set when both are made: words are folded without them.
        words = self._table(folded(counts.filter(F.col("step") >= often)), self.WORD_BUCKETS, F.collect_list(F.struct("w", "ids")), F.array().cast("array<struct<w:string,ids:array<int>>>"), F.map_from_entries)
        packed = self._table(folded(counts.filter((F.col("step") >= least) & (F.col("step") < often))), self.PACKED_BUCKETS, line, F.lit(""), lambda x: x)
        self.words, self.packed = words, packed
        return self

    def beside(self, df: DataFrame) -> DataFrame:
        """df with the constant tables as columns __t (pairs), __w and __k (frequent words: in maps, packed) and __p (pieces)."""
        words = self.words if self.words is not None else F.lit(None).cast("array<map<string,array<int>>>")
        packed = self.packed if self.packed is not None else F.lit(None).cast("array<string>")
        return df.select("*", self.tables.alias("__t"), words.alias("__w"), packed.alias("__k"), self.pieces.alias("__p"))

    def _encode(self, t: Column, words: Column, packed: Column, text: Column) -> Column:
        cut = lambda s, mark, n: F.call_function("substring_index", s, mark, F.lit(n))
        known = lambda w: F.try_element_at(F.get(words, self._bucket(w, self.WORD_BUCKETS)), w)
        # Of the bucket what stands before the word, and of that what follows the word before: the ids, or nothing.
        line = lambda w: cut(cut(F.get(packed, self._bucket(w, self.PACKED_BUCKETS)), F.concat(self._mark(BEFORE), w, self._mark(AFTER)), 1), self._mark(AFTER), -1)
        other = lambda w: let(line(w), lambda ids: F.when(ids != "", F.split(ids, " ").cast("array<int>")).otherwise(self._word(t, w)))
        return F.flatten(F.transform(self.split(F.coalesce(text.cast("string"), F.lit(""))), lambda w: F.coalesce(known(w), other(w))))

    def _decode(self, pieces: Column, ids: Column) -> Column:
        # Null pieces (of unknown ids) are left out by array_join.
        return F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "").cast("binary")

    def encode(self, df: DataFrame, text: str, into: str) -> DataFrame:
        """df with the ids of a text column; null has none."""
        tables = F.struct(F.col("__t").alias("t"), F.col("__w").alias("w"), F.col("__k").alias("k"))
        return self.beside(df).withColumn(into, let(tables, lambda b: self._encode(b["t"], b["w"], b["k"], F.col(text)))).drop("__t", "__w", "__k", "__p")

    def decode(self, df: DataFrame, ids: str, into: str) -> DataFrame:
        """df with the bytes of an ids column. Read ids from a table: the constant tables must not become columns of rows."""
        return self.beside(df).withColumn(into, let(F.col("__p"), lambda p: self._decode(p, F.col(ids)))).drop("__t", "__w", "__k", "__p")

    def round_trip(self, df: DataFrame, text: str, into: str) -> DataFrame:
        """df with struct<ids array<int>, decoded binary>: encoded, then decoded from the ids, in one expression."""
        tables = F.struct(F.col("__t").alias("t"), F.col("__w").alias("w"), F.col("__k").alias("k"), F.col("__p").alias("p"))
        both = let(tables, lambda b: let(self._encode(b["t"], b["w"], b["k"], F.col(text)), lambda ids: F.struct(ids.alias("ids"), self._decode(b["p"], ids).alias("decoded"))))
        return self.beside(df).withColumn(into, both).drop("__t", "__w", "__k", "__p")


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, ids array<int>, decoded binary), one for each row of docs. Narrow: no shuffle of texts."""
    bpe = ByteBpe(docs.sparkSession, path, pattern).learn_words(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return bpe.round_trip(rows, "text", "b").select("doc_id", "b.ids", "b.decoded")


def digest(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_documents' rows."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
