"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words. A pattern is a window of consecutive item words. For all patterns of one length m, the shift table tells for
each block of two words how far the search may jump without missing an occurrence; where the jump is 0, the block's hash selects
the bucket of patterns that end in it, and the words themselves are compared. The search runs over many stretches of text at a
time, so that each jump is one numpy step for all of them.

Defined results: null and empty texts and texts without words have no words and no hits; items without words have no windows;
an item id that is null is not listed, though its windows count as hits; repeated rows and ties each get their own equal result;
extra columns are left alone; an empty table of items hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import LOWER, NOT_ALNUM, U, Words, mix, words

#: Item words whose windows are searched for in one pass over the documents; more items make more passes.
BLOCK_WORDS = 500_000
_STRETCH = 256
_TWO = mix(np.arange(11, 13, dtype=U)) | U(1)


class _OneLength:
    """The search for all patterns of m words."""

    def __init__(self, m: int, patterns: dict[bytes, set[int]]):
        self.m, self.b = m, min(2, m)
        joined = b"\n".join(patterns)
        w = Words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), NOT_ALNUM)
        h = w.hashes().reshape(-1, m)
        size = 1 << max(12, (16 * h.size).bit_length())
        self.mask = U(size - 1)
        self.shift = np.full(size, m - self.b + 1, np.int64)
        for end in range(self.b, m + 1):  # later blocks allow smaller jumps, so they come last
            at = self.block(h, end - 1)
            self.shift[at & self.mask] = np.minimum(self.shift[at & self.mask], m - end)
        self.buckets: dict[int, list[tuple[bytes, set[int]]]] = {}
        for key, (text, items) in zip(self.block(h, m - 1).tolist(), patterns.items(), strict=True):
            self.buckets.setdefault(key, []).append((text, items))

    def block(self, h: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """Hashes of the blocks that end at these places of the last axis."""
        out = h[..., at] * _TWO[0]
        return mix(out + h[..., at - 1] * _TWO[1]) if self.b == 2 else mix(out)

    def search(self, w: Words, h: np.ndarray) -> Iterator[tuple[int, int, set[int]]]:
        """(from, to, items) of each occurrence, in words of the piece."""
        first, last = w.first[:-1] + self.m - 1, w.first[1:]  # places where an occurrence may end, by text
        n = np.maximum(0, -((first - last) // _STRETCH))
        text = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        at = first[text] + nth * _STRETCH
        stop = np.minimum(at + _STRETCH, last[text])
        while len(at):
            key = self.block(h, at)
            jump = self.shift[key & self.mask]
            for end, k in zip(at[jump == 0].tolist(), key[jump == 0].tolist(), strict=True):
                found = self.buckets.get(k)
                if found:
                    own = w.bytes_of(end - self.m + 1, end + 1)
                    for pattern, items in found:
                        if pattern == own:
                            yield end - self.m + 1, end + 1, items
            at = at + np.maximum(jump, 1)
            at, stop = at[on := at < stop], stop[on]


class Patterns:
    """Windows of items: (id, text) pairs."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids = [x for x, _ in items]
        by_length: dict[int, dict[bytes, set[int]]] = {}
        for i, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = Words(raw, np.array([0, len(raw)]), NOT_ALNUM)
            m = min(window, len(w))
            for k in range(len(w) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(w.bytes_of(k, k + m), set()).add(i)
        self.lengths = [_OneLength(m, x) for m, x in sorted(by_length.items())]

    def spans(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text its number of words, the stretches of words inside occurrences (apart, in order) and the items found."""
        for lo, hi, w in words(texts, NOT_ALNUM):
            h = w.hashes()
            found: dict[int, list[tuple[int, int, set[int]]]] = {}
            for x in self.lengths:
                for a, b, items in x.search(w, h):
                    found.setdefault(int(np.searchsorted(w.first, a, "right")) - 1, []).append((a, b, items))
            n = np.diff(w.first).tolist()
            for i in range(hi - lo):
                spans: list[tuple[int, int]] = []
                items: set[int] = set()
                base = int(w.first[i])
                for a, b, more in sorted(found.get(i, []), key=lambda x: x[:2]):
                    items |= more
                    if spans and a - base <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], b - base))
                    else:
                        spans.append((a - base, b - base))
                yield n[i], spans, items


def blocks(items: DataFrame, item_id: str, item_text: str, window: int) -> Iterator[Patterns]:
    """The items as searches of a bounded size each."""
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for x, text in items.select(F.col(item_id).cast("string"), F.col(item_text)).toLocalIterator():
        block.append((x, text))
        size += len(text or "") // 4 + 1
        if size >= BLOCK_WORDS:
            yield Patterns(block, window)
            block, size = [], 0
    if block:
        yield Patterns(block, window)


_SPANS = "n_words long, spans array<struct<start: int, end: int>>, items array<string>"


def _search(docs: DataFrame, text: str, patterns: Patterns) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = list(p.spans(batch.column(k)))
            columns = [c for i, c in enumerate(batch.columns) if i != k]
            columns += [pa.array([x[0] for x in out], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in out], kind)]
            columns.append(pa.array([sorted({p.ids[i] for i in x[2]} - {None}) for x in out], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema) if i != k)
    return docs.mapInArrow(run, f"{kept}, {_SPANS}")


def occurrences(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """doc_id, n_words, spans (stretches of words inside occurrences of windows, from word 0, end excluded) and items (their ids, sorted) of each document."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = [_search(own, "text", p) for p in blocks(items, item_id, item_text, window)] or [_search(own, "text", Patterns([], window))]
    if len(parts) == 1:
        return parts[0]
    # Several blocks of items: each row of a document has one result in each; equal rows have equal results.
    keyed = own.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    parts = [_search(keyed, "text", p) for p in blocks(items, item_id, item_text, window)]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.expr("cast(array() as array<struct<start: int, end: int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    rows = every.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / len(parts)).cast("int").alias("copies"))
    return rows.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = occurrences(docs, items)
    hit = n_hit(F.col("spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The rows of docs that hold no window of an item, with all their columns."""
    k = docs.columns.index(text)
    for p in blocks(items, item_id, item_text, window):
        shared = docs.sparkSession.sparkContext.broadcast(p)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not spans for _, spans, _ in shared.value.spans(batch.column(k))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = 10) -> list[tuple[int, int, list[str]]]:
    """(n_words, n_hit, items) of each text, by comparing all places with all windows; for tests."""
    import re

    def split(x: str | None) -> list[bytes]:
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").encode().lower())

    out = []
    for text in texts:
        w = split(text)
        hit, found = set(), set()
        for x, item in items:
            v = split(item)
            m = min(window, len(v))
            for k in range(len(v) - m + 1 if m else 0):
                for a in range(len(w) - m + 1):
                    if w[a : a + m] == v[k : k + m]:
                        hit |= set(range(a, a + m))
                        found.add(x)
        out.append((len(w), len(hit), sorted(found)))
    return out


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


__all__ = ["LOWER", "BLOCK_WORDS", "Patterns", "blocks", "brute_force", "decontaminate", "n_hit", "occurrences", "report", "sha256_of"]
