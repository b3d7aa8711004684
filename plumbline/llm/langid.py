"""Language ID by multilingual mixture inference.

Each language is a distribution over byte trigrams of lower-cased text (anything but letters counts as a space), learned from
labelled documents. A document is a mixture: expectation-maximisation finds the proportions of languages that make its trigrams
most likely. Then sets of one, two, three ... languages (those with the largest proportions) are fitted again, as long as some text of a
piece gets a better likelihood, less a penalty for each language more; the best set is taken, and the answer is its largest language.

All labelled documents of the training folds are counted, and every language is kept. A task holds at most FLUSH languages' counters;
what is broadcast is 256 KB a language. Texts are fitted in groups that bound a task's memory, however many languages there are.

Defined results: texts that are null or have no letter are "und" with score 0; without any labelled document all are "und"; null
ids count as empty in the choice of folds; repeated rows get equal rows each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import LOWER, U, mix, pieces

BITS = 16
FLUSH = 16
STEPS = 12
#: Trigrams times languages that are fitted at once (at least those of one text).
FITTED = 1 << 22
#: Cost of a further language, in half logs of the number of trigrams; overlapping trigrams are worth less than their number.
PENALTY = 6.0

_CLASS = np.array([LOWER[c] if 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)], np.uint8)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count) of the distinct trigrams of consecutive texts, by text. Runs of spaces give none but at their ends."""
    n = np.diff(offsets)
    at = np.arange(len(offsets) - 1)
    padded = np.full(len(buf) + len(n), 0x20, np.uint8)  # a space after each text
    padded[np.arange(len(buf)) + np.repeat(at, n)] = _CLASS[buf]
    text = np.repeat(at, n + 1)
    x = padded.astype(np.int64)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    # A trigram starts and ends in one text (its end may be the space after it), and its middle is no space.
    keep = (x[1:-1] != 0x20) & (text[:-2] == text[2:])
    # The first trigram of a text starts at its first byte; words at the start also count with the space before them.
    first = offsets[:-1] + at
    head = first[(n > 0)]
    head = head[x[head] != 0x20]
    extra = 0x20 << 16 | x[head] << 8 | x[head + 1]
    code, owner = np.concatenate([code[keep], extra]), np.concatenate([text[:-2][keep], text[head]])
    gram = (mix(code.astype(U)) >> U(64 - BITS)).astype(np.int64)
    keys, counts = np.unique(owner << BITS | gram, return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), counts


def no_letter(text: str | None) -> bool:
    return not any(c.isalpha() for c in text or "")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log probability of each gram (row) in each language

    def predict(self, texts: pa.Array) -> Iterator[tuple[str, float, list[tuple[str, float]]]]:
        """(language, its proportion, the whole mixture) of each text."""
        for lo, hi, buf, offsets in pieces(texts):
            text, gram, count = grams(buf, offsets)
            share = np.zeros((hi - lo, len(self.languages)))
            first = np.searchsorted(text, np.arange(hi - lo + 1))
            a = 0
            while self.languages and a < hi - lo:
                b = max(a + 1, int(np.searchsorted(first, first[a] + FITTED // len(self.languages), "right")) - 1)
                own = slice(first[a], first[b])
                share[a:b] = self.mixture(text[own] - a, gram[own], count[own], b - a)
                a = b
            ascii_letter = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((_CLASS[buf] != 0x20) & (buf < 0x80), out=ascii_letter[1:])
            has = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
            for i in range(hi - lo):
                if not self.languages or (not has[i] and no_letter(texts[lo + i].as_py())) or not share[i].sum():
                    yield "und", 0.0, []
                else:
                    k = int(np.argmax(share[i]))
                    own = [(self.languages[j], float(share[i, j])) for j in np.argsort(-share[i], kind="stable") if share[i, j] > 0]
                    yield self.languages[k], min(1.0, float(share[i, k])), own

    def mixture(self, text: np.ndarray, gram: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Proportions (texts x languages), 0 outside the chosen set; all 0 for a text without grams."""
        if not len(text):
            return np.zeros((n, len(self.languages)))
        present, first = np.unique(text, return_index=True)
        row = np.searchsorted(present, text)
        log = self.table[gram]
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        total = np.add.reduceat(count, first).astype(float)
        weight = count[:, None].astype(np.float32)

        def fit(share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(steps):
                r = share[row] * p
                z = r.sum(1, keepdims=True)
                share = (np.add.reduceat(r * (weight / z), first, axis=0) / total[:, None]).astype(np.float32)
            return share, np.add.reduceat(count * np.log((share[row] * p).sum(1)), first)

        full, _ = fit(np.full((len(present), len(self.languages)), 1 / len(self.languages), np.float32), STEPS)
        order = np.argsort(-full, axis=1, kind="stable")
        best, best_value = full, np.full(len(present), -np.inf)
        going = np.ones(len(present), bool)
        for k in range(1, len(self.languages) + 1):
            some = np.full_like(full, 0)
            np.put_along_axis(some, order[:, :k], np.maximum(np.take_along_axis(full, order[:, :k], 1), 1e-3), 1)
            share, likelihood = fit(some / some.sum(1, keepdims=True), STEPS // 2 if k > 1 else 0)
            value = likelihood - PENALTY * (k - 1) * np.log(total + 1) / 2
            # A text whose set of three or more is no better than the one before takes no further language.
            better = going & (value > best_value)
            best, best_value = np.where(better[:, None], share, best), np.where(better, value, best_value)
            going = better if k >= 3 else going
            if not going.any():
                break
        out = np.zeros((n, len(self.languages)))
        out[present] = best
        return out


def learn(labelled: DataFrame, *, alpha: float = 0.5) -> Model:
    """labelled: text, lang (not null). Counts of all its rows, summed by language; one row of 2**BITS counters a language comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "counts"])

        for batch in batches:
            codes = batch.column(1).dictionary_encode()
            names, number = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            for lo, _, buf, offsets in pieces(batch.column(0)):
                text, gram, n = grams(buf, offsets)
                own = number[lo + text] if len(text) else text
                for k in np.unique(own).tolist():
                    x = np.bincount(gram[own == k], n[own == k], 1 << BITS)
                    sums[names[k]] = sums.get(names[k], 0) + x
                if len(sums) > FLUSH:
                    yield rows()
                    sums.clear()
        if sums:
            yield rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, total = None, None
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), np.float64)
                if name != lang and total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.sum()]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["lang", "n", "counts"])
                total = x.copy() if name != lang else total + x
                lang = name
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.sum()]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["lang", "n", "counts"])

    parts = labelled.select("text", "lang").mapInArrow(count, "lang string, counts binary").repartition("lang").sortWithinPartitions("lang")
    rows = parts.mapInArrow(add, "lang string, n double, counts binary").toLocalIterator()
    found = sorted(((r[0], np.frombuffer(r[2], np.float32)) for r in rows), key=lambda x: x[0])
    if not found:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    table = np.empty((1 << BITS, len(found)), np.float32)
    for k, (_, counts) in enumerate(found):
        counts = counts.astype(float) + alpha
        table[:, k] = np.log(counts / counts.sum())
    return Model([x for x, _ in found], table)


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs without text, with lang_pred, score and mixture (language, proportion). Only text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index(text)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(shared.value.predict(batch.column(k)))
            columns = [c for i, c in enumerate(batch.columns) if i != k]
            columns += [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([[{"lang": a, "share": b} for a, b in x[2]] for x in out], kind)]
            yield pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for i, f in enumerate(docs.schema) if i != k)
    return docs.mapInArrow(run, kept + "lang_pred string, score double, mixture array<struct<lang: string, share: double>>")


def report(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text", "lang")
    model = learn(own.filter("not held_out and lang is not null").select("text", "lang"))
    out = predict(own.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.to_json("mixture").alias("mixture"))
