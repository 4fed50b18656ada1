"""Token counts for a piece-wise BPE model, by rank-synchronous merging of ragged arrays.

The model file gives pieces with scores; the best score merges first, ties to the left, as the
sentencepiece library does. A text is escaped (blanks become the mark U+2581, one mark in front),
then cut where no piece can reach across, so that each part can be counted alone and once per
distinct part. New parts of a batch are laid out as one flat array of symbol ids; each round every
part merges its single lowest-ranked pair at the same time, until no part has a mergeable pair.
Symbols that are no piece fall back to one token a UTF-8 byte.

Defined cases: null and empty texts count 0 bytes and 0 tokens; rows that repeat are counted each;
ids may be null or repeat; an empty table gives an empty result; other columns are ignored; very long
texts are counted whole, in slices of a batch.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_rows, in_slices

MARK = "▁"
#: Parts with more symbols go through a heap instead of rounds (rounds cost the square of the length).
LONG = 192
#: Distinct parts that a worker remembers; beyond it the memory is emptied.
REMEMBER = 1_000_000
NONE = np.int64(1) << 40


class PieceTable:
    """Pieces, ranks and mergeable pairs of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        order = sorted(pieces, key=lambda p: -pieces[p])
        self.ids = {p: i for i, p in enumerate(order)}
        bare = sorted({c for p in order for c in p} - self.ids.keys())
        self.ids |= {c: len(order) + i for i, c in enumerate(bare)}
        self.known = len(self.ids)
        self.cost = np.ones(self.known, np.int64)
        for c in bare:
            self.cost[self.ids[c]] = len(c.encode())
        pairs = {}
        for p in order:
            for k in range(1, len(p)):
                left, right = self.ids.get(p[:k]), self.ids.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * self.known + right] = self.ids[p]
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        beside = {p[i : i + 2] for p in order for i in range(len(p) - 1)}
        self.beside = beside
        cuts = "" if any("\n" in b for b in beside) else "\n"
        inner = any(b[1] == MARK and b[0] != MARK for b in beside)
        self.part = re.compile("(?s:.+)" if inner else f"{MARK}*[^{MARK}{cuts}]+|{MARK}+" + (f"|{cuts}+" if cuts else ""))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, NONE where there is none. Unknown symbols (-1) never merge."""
        keys = left * self.known + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def split(self, part: str) -> list[str]:
        """Cut a long part where two neighbours stand beside each other in no piece."""
        beside, out, start = self.beside, [], 0
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in beside:
                out.append(part[start:i])
                start = i
        return [*out, part[start:]]

    def by_heap(self, part: str) -> int:
        """Tokens of one long part."""
        n, ids, pairs, known = len(part), self.ids, self.pairs, self.known
        sym = [ids.get(c, -1) for c in part]
        cost = [int(self.cost[s]) if s >= 0 else len(c.encode()) for s, c in zip(sym, part, strict=True)]
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def push(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (m := pairs.get(sym[i] * known + sym[j])) is not None:
                heapq.heappush(heap, (m, i, sym[i], sym[j]))

        for i in range(n):
            push(i)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or cost[i] == 0 or j < 0 or sym[j] != right:
                continue
            sym[i], cost[i], cost[j], sym[j] = m, 1, 0, -2
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return sum(cost)

    def counts(self, parts: list[str]) -> list[int]:
        """Tokens of each part."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.zeros(len(parts), np.int64)
        owner = np.flatnonzero(lengths <= 24).tolist()
        whole = [parts[k] for k in owner]
        for k in np.flatnonzero(lengths > 24).tolist():
            for piece in self.split(parts[k]):
                if len(piece) > LONG:
                    out[k] += self.by_heap(piece)
                else:
                    whole.append(piece)
                    owner.append(k)
        if whole:
            out += np.bincount(owner, weights=self.by_rounds(whole), minlength=len(parts)).astype(np.int64)
        return out.tolist()

    def by_rounds(self, parts: list[str]) -> np.ndarray:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        text, ids = "".join(parts), self.ids
        codes, back = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
        chars = [chr(c) for c in codes.tolist()]
        sym = np.array([ids.get(c, -1) for c in chars], np.int64)[back]
        lost = np.array([0 if c in ids else len(c.encode()) for c in chars], np.int64)[back]
        seg = np.repeat(np.arange(len(parts)), lengths)
        out = np.bincount(seg, weights=lost, minlength=len(parts)).astype(np.int64)
        rank = np.full(len(sym), NONE)
        inside = seg[1:] == seg[:-1]
        rank[:-1][inside] = self.lookup(sym[:-1][inside], sym[1:][inside])
        while True:
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            if not live.all():  # parts that are done leave with what survives
                done = ~np.repeat(live, np.diff(np.r_[starts, len(seg)]))
                s = sym[done]
                np.add.at(out, seg[done], np.where(s >= 0, self.cost[s], 0))
                sym, seg, rank = sym[~done], seg[~done], rank[~done]
                if not len(sym):
                    return out
                starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
                best = best[live]
            sizes = np.diff(np.r_[starts, len(seg)])
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            at = hit[np.r_[True, seg[hit[1:]] != seg[hit[:-1]]]]  # the leftmost of each part
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            at -= np.arange(len(at))  # places after the removal
            last = len(sym) - 1
            for i in (at[at > 0] - 1, at[at < last]):
                same = seg[i] == seg[i + 1]
                rank[i] = np.where(same, self.lookup(sym[i], sym[i + 1]), NONE)
            rank[last] = NONE


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def count_texts(table: PieceTable, values: list[str], memory: dict[str, int]) -> list[int]:
    found = [table.part.findall(MARK + v.replace(" ", MARK)) if v else [] for v in values]
    if len(memory) > REMEMBER:
        memory.clear()
    new = list({p for parts in found for p in parts}.difference(memory))
    memory.update(zip(new, table.counts(new), strict=True))
    return [sum(map(memory.__getitem__, parts)) for parts in found]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, n_bytes, n_tokens, over_limit), one for each row of docs. Narrow: no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memory = piece_table(model_path), {}
        for b in in_slices(batches, "text"):
            values = [x or "" for x in b.column("text").to_pylist()]
            n = count_texts(table, values, memory)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(v.encode()) for v in values], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")
    return arrow_rows(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
