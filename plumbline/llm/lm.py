"""LM scoring by deleted interpolation of word n-grams.

P(word | one before) mixes bigram, unigram and uniform estimates; the weights depend on how frequent the word before is (a bucket
for each doubling of its count). A part of the training documents is deleted from the counts, and expectation-maximisation finds
the weights that make that part most likely. The counts used for scoring then are those of all training documents.

Texts are handled in blocks. Each block asks for the counts of its distinct words and pairs: keys, sorted, with its own training
counts, are dealt to shards by key. A shard adds up what all blocks have and answers each with the totals, in the order of its keys.
The answers meet the block's text again, and there all documents of the block are scored. So what is shuffled is a few bytes for
each distinct pair of a block, and the texts once; no table of the whole vocabulary is held anywhere. A key that many blocks
hold (a frequent word) is one entry a block, so no shard is hot.

Words have 64-bit keys; pairs have 56 bits, so that of 10**9 different pairs some ten share their counts with another.

Defined results: a null text is empty: one token, the end; null ids count as empty in the choice of folds; without training
documents all counts are 0; repeated rows get equal rows each; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.langid import fold
from plumbline.llm.scratch import stash
from plumbline.llm.words import SPACES, U, _ODD, mix, words

#: Bytes of text of a block; a longer text is a block of its own.
BLOCK = 6 << 20
#: Documents for which there is one shard.
SHARD_DOCS = 5000
START, END = U(0x5354415254), U(0x454E44)
BUCKETS, STEP = 48, 8
FOLDS, HELD_OUT, DELETED = 7, 2, 3


class Block:
    """Texts with train (whether they count) and their tokens: word numbers of sorted distinct keys, and pair numbers."""

    def __init__(self, texts: pa.Array, train: np.ndarray):
        hashes, n = [], []
        for _, _, w in words(texts, SPACES):
            hashes.append(w.hashes())
            n.append(np.diff(w.first))
        h, n = np.concatenate([*hashes, np.zeros(0, U)]), np.concatenate([*n, np.zeros(0, np.int64)])
        self.n = n + 1
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        token = np.empty(self.first[-1], U)
        ends = self.first[1:] - 1
        inner = np.ones(len(token), bool)
        inner[ends] = False
        token[inner], token[ends] = h, END
        before = np.empty(len(token), U)
        before[1:] = token[:-1]
        before[self.first[:-1]] = START
        pair = mix(before * _ODD[0] + token * _ODD[1]) >> U(8)
        counted = np.repeat(train, self.n)
        self.keys, self.word = np.unique(np.concatenate([token, [END]]), return_inverse=True)
        self.word = self.word[:-1]
        self.word_counts = np.bincount(self.word[counted], minlength=len(self.keys))
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.pair_counts = np.bincount(self.pair[counted], minlength=len(self.pairs))
        self.end = int(np.searchsorted(self.keys, END))


def blocks(batches: Iterator[pa.RecordBatch], deleted: bool | None) -> Iterator[tuple[int, bool, list[pa.RecordBatch]]]:
    """(id, whether it is of the deleted part, rows) of blocks; rows: doc_id, role (0 train, 1 deleted, 2 held out), rid, text.

    Blocks are cut by the rows' own sizes in the order of the scan, and named by what they hold.
    """
    waiting: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}
    size = {True: 0, False: 0}

    def close(kind: bool) -> tuple[int, bool, list[pa.RecordBatch]]:
        rows, waiting[kind], size[kind] = waiting[kind], [], 0
        rid = np.concatenate([x.column(2).to_numpy() for x in rows]).view(U)
        return int((mix(rid).sum(dtype=U) + U(len(rid))).view(np.int64)), kind, rows

    for batch in batches:
        is_deleted = pc.equal(batch.column(1), 1)
        for kind, mask in ((True, is_deleted), (False, pc.invert(is_deleted))):
            if deleted not in (None, kind):
                continue
            part = batch.filter(mask)
            lengths = np.cumsum(pc.fill_null(pc.binary_length(part.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < part.num_rows:
                done = int(lengths[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(lengths, done + BLOCK - size[kind], "right")))
                waiting[kind].append(part.slice(lo, hi - lo))
                size[kind] += int(lengths[min(hi, part.num_rows) - 1]) - done
                lo = hi
                if size[kind] >= BLOCK * 9 // 10 or hi < part.num_rows:
                    yield close(kind)
    for kind in (True, False):
        if waiting[kind]:
            yield close(kind)


def _texts(rows: list[pa.RecordBatch]) -> pa.Array:
    return pa.concat_arrays([pc.fill_null(x.column(3).cast(pa.large_string()), "") for x in rows])


def _roles(rows: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([x.column(1).to_numpy() for x in rows])


def pack(x: np.ndarray) -> bytes:
    """Non-negative numbers, most of them small, as bytes."""
    low = np.minimum(x, 255).astype(np.uint8)
    return zstandard.ZstdCompressor(3).compress(low.tobytes() + x[x >= 255].astype(np.uint64).tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = zstandard.ZstdDecompressor().decompress(data)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.uint64, offset=n).astype(np.int64)
    return out


def pack_keys(x: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences: their lower 32 bits, and the rest in 1 or 4 bytes."""
    d = np.diff(x, prepend=U(0))
    high = d >> U(32)
    return d.astype(np.uint32).tobytes(), high.astype(np.uint8 if not len(high) or high.max() < 256 else np.uint32).tobytes()


def unpack_keys(low: bytes, high: bytes) -> np.ndarray:
    low_ = np.frombuffer(low, np.uint32)
    high_ = np.frombuffer(high, np.uint8 if len(high) == len(low_) else np.uint32)
    return np.cumsum(high_.astype(U) << U(32) | low_.astype(U), dtype=U)


_ASK = "shard int, id long, deleted boolean, words binary, word_counts binary, low binary, high binary, pair_counts binary"


def ask(docs: DataFrame, shards: int) -> DataFrame:
    """The blocks' requests. docs: doc_id, role, rid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(shards + 1).astype(object)
        word_edges = [int(-(-(int(e) << 64) // shards)) for e in edges[1:-1]]
        pair_edges = [int(-(-(int(e) << 56) // shards)) for e in edges[1:-1]]
        for name, deleted, rows in blocks(batches, None):
            b = Block(_texts(rows), _roles(rows) != 2)
            i = [0, *np.searchsorted(b.keys, np.array(word_edges, U)).tolist(), len(b.keys)]
            j = [0, *np.searchsorted(b.pairs, np.array(pair_edges, U)).tolist(), len(b.pairs)]
            out = []
            for s in range(shards):
                if i[s] < i[s + 1] or j[s] < j[s + 1]:
                    low, high = pack_keys(b.pairs[j[s] : j[s + 1]])
                    out.append((s, name, deleted, b.keys[i[s] : i[s + 1]].tobytes(), pack(b.word_counts[i[s] : i[s + 1]]), low, high, pack(b.pair_counts[j[s] : j[s + 1]])))
            kinds = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _ASK.split(", ")])

    return docs.mapInArrow(run, _ASK)


_ANSWER = "id long, deleted boolean, shard int, words binary, pairs binary, kept_words binary, kept_pairs binary, n_words int, n_pairs int, tokens long, kept_tokens long, types long"


def answer(requests: DataFrame) -> DataFrame:
    """Totals over all blocks, in the order of each request: over all training documents, and over those not deleted (for blocks of
    the deleted part). One row more of each shard has its sums: tokens, kept_tokens and types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = None, []
        names = [x.split()[0] for x in _ANSWER.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int32(), *[pa.binary()] * 4, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

        def totals(keys: list[np.ndarray], counts: list[np.ndarray], deleted: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            flat, n = np.concatenate(keys), np.concatenate(counts)
            _, at = np.unique(flat, return_inverse=True)
            every = np.bincount(at, n).astype(np.int64)
            kept = np.bincount(at, n * ~np.repeat(deleted, [len(k) for k in keys])).astype(np.int64)
            return at, every, kept

        def close() -> pa.RecordBatch:
            deleted = [r[1] for r in waiting]
            words_ = [np.frombuffer(r[2], U) for r in waiting]
            pairs_ = [unpack_keys(r[4], r[5]) for r in waiting]
            wat, wall, wkept = totals(words_, [unpack(r[3], len(k)) for r, k in zip(waiting, words_, strict=True)], deleted)
            pat, pall, pkept = totals(pairs_, [unpack(r[6], len(k)) for r, k in zip(waiting, pairs_, strict=True)], deleted)
            out, i, j = [], 0, 0
            for r, w, p in zip(waiting, words_, pairs_, strict=True):
                a, b = wat[i : i + len(w)], pat[j : j + len(p)]
                i, j = i + len(w), j + len(p)
                out.append((r[0], r[1], shard, pack(wall[a]), pack(pall[b]), pack(wkept[a]) if r[1] else None, pack(pkept[b]) if r[1] else None, len(w), len(p), None, None, None))
            out.append((None, None, shard, None, None, None, None, None, None, int(wall.sum()), int(wkept.sum()), int((wall > 0).sum())))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != shard:
                    if waiting:
                        yield close()
                    shard, waiting = row[0], []
                waiting.append(row[1:])
        if waiting:
            yield close()

    shards = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, _ANSWER)


@dataclass
class Totals:
    tokens: int
    kept_tokens: int
    types: int


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 for each doubling of its count."""
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(context, 1)).astype(np.int64)), 0)


def met(docs: DataFrame, answers: DataFrame, deleted: bool | None, work, schema: str) -> DataFrame:
    """work(block, roles, ids, words, pairs, kept_words, kept_pairs) for each block and its totals; yields a RecordBatch."""

    def pay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, rows in blocks(batches, deleted):
            texts = _texts(rows)
            lengths = pc.binary_length(texts).cast(pa.int64()).to_numpy()
            data = b"".join(x.as_buffer().to_pybytes() for x in texts)
            ids = pa.concat_arrays([x.column(0) for x in rows])
            one = lambda x, k: pa.array([x], k)
            yield pa.RecordBatch.from_arrays([
                one(name, pa.int64()), one(-1, pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(_roles(rows).tolist(), pa.list_(pa.int32())),
                one(lengths.tolist(), pa.list_(pa.int64())), one(zstandard.ZstdCompressor(3).compress(data), pa.binary()), *[pa.nulls(1, pa.binary())] * 4, pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()),
            ], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    wide = f"id long, shard int, ids array<{id_type}>, roles array<int>, lengths array<bigint>, text binary, words binary, pairs binary, kept_words binary, kept_pairs binary, n_words int, n_pairs int"
    names = [x.split()[0] for x in wide.split(", ")]
    totals = answers.filter("id is not null") if deleted is None else answers.filter(F.col("deleted") == deleted)
    rows = docs.mapInArrow(pay, wide).unionByName(totals.select("id", "shard", "words", "pairs", "kept_words", "kept_pairs", "n_words", "n_pairs"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, texts, got = None, [], {}

        def close() -> Iterator[pa.RecordBatch]:
            if not texts and got:
                raise RuntimeError("the documents changed between two scans")
            for ids, roles, lengths, data in texts:
                raw = pa.py_buffer(zstandard.ZstdDecompressor().decompress(data) if sum(lengths) else b"")
                offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
                b = Block(pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), raw), np.array(roles) != 2)
                parts = [got[k] for k in sorted(got)]
                if sum(p[4] for p in parts) != len(b.keys) or sum(p[5] for p in parts) != len(b.pairs):
                    raise RuntimeError("the documents changed between two scans")
                joined = [np.concatenate([unpack(p[k], p[4 + k % 2]) for p in parts]) if parts[0][k] is not None else None for k in range(4)]
                yield from work(b, np.array(roles), ids, *joined)

        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                if key != name:
                    yield from close()
                    name, texts, got = key, [], {}
                shard = batch.column(1)[i].as_py()
                if shard < 0:
                    texts.append((batch.column(2)[i].values, *(batch.column(k)[i].as_py() for k in (3, 4, 5))))
                else:
                    got[shard] = tuple(batch.column(k)[i].as_py() for k in range(6, 12))
        yield from close()

    together = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", "shard")
    return together.mapInArrow(run, schema)


def _estimates(b: Block, words_: np.ndarray, pairs_: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, bigram, unigram estimate, count) of each token."""
    count = words_[b.word]
    context = np.empty_like(count)
    context[1:] = count[:-1]
    context[b.first[:-1]] = words_[b.end]  # as many texts start as end
    pair = pairs_[b.pair]
    return bucket(context), np.where(context > 0, pair / np.maximum(context, 1), 0.0), count / max(1, tokens), count


def _bin(x: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + steps of an eighth of a doubling below 1."""
    return np.where(x > 0, 1 + np.minimum(1022, np.round(-STEP * np.log2(np.maximum(x, 1e-300)))), 0).astype(np.int64)


def deleted_counts(docs: DataFrame, answers: DataFrame, t: Totals) -> list[tuple[int, int, int, int]]:
    """(bucket, bin of the bigram estimate, bin of the unigram estimate, tokens) over the deleted part; a table of bounded size."""

    def work(b, roles, ids, _w, _p, kept_words, kept_pairs):
        where, two, one, _ = _estimates(b, kept_words, kept_pairs, t.kept_tokens)
        code, n = np.unique(where << 20 | _bin(two) << 10 | _bin(one), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    rows = met(docs, answers, True, work, "code long, n long").groupBy("code").agg(F.sum("n")).collect()
    return [(c >> 20, c >> 10 & 1023, c & 1023, n) for c, n in rows]


def learn_weights(events: list[tuple[int, int, int, int]], types: int, steps: int = 40) -> np.ndarray:
    """BUCKETS x 3 weights of the uniform, unigram and bigram estimates, by expectation-maximisation from thirds.

    A bucket also counts ten tokens with the weights of all buckets together, so that rare ones lean on those.
    """
    pooled = np.array([0.1, 0.6, 0.3])
    out = np.tile(pooled, (BUCKETS, 1))
    if not events:
        return _no_context(out)
    where, two, one, n = (np.array(x) for x in zip(*events, strict=True))
    value = lambda x: np.where(x > 0, 2.0 ** (-(x - 1) / STEP), 0.0)
    p = np.stack([np.full(len(n), 1 / (types + 1)), value(one), value(two)], 1)
    for _ in range(steps):
        r = pooled * p
        pooled = (n[:, None] * r / r.sum(1, keepdims=True)).sum(0) / n.sum()
    out = np.tile(pooled, (BUCKETS, 1))
    for _ in range(steps):
        r = out[where] * p
        r = n[:, None] * r / r.sum(1, keepdims=True)
        sums = np.stack([np.bincount(where, r[:, k], BUCKETS) for k in range(3)], 1) + 10 * pooled
        out = sums / sums.sum(1, keepdims=True)
    return _no_context(out)


def _no_context(weights: np.ndarray) -> np.ndarray:
    """After a word never seen there is no bigram estimate; the others share its weight. No weight is 0, so every text has a probability."""
    weights = np.maximum(weights, 1e-6)
    weights[0, 2] = 0
    return weights / weights.sum(1, keepdims=True)


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    f = fold(F.col(doc_id), FOLDS)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.when(f == HELD_OUT, 2).when(f == DELETED, 1).otherwise(0).alias("role"), F.coalesce(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(0)).alias("rid"), F.col(text).alias("text"))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // SHARD_DOCS)
    answers = stash(answer(ask(own, shards)), "lm-answers")
    sums = answers.filter("id is null").agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("tokens", "kept_tokens", "types"))).first()
    t = Totals(*sums)
    weights = learn_weights(deleted_counts(own, answers, t), t.types)

    def work(b, roles, ids, words_, pairs_, _w, _p):
        where, two, one, count = _estimates(b, words_, pairs_, t.tokens)
        w = weights[where]
        p = w[:, 0] / (t.types + 1) + w[:, 1] * one + w[:, 2] * two
        start = b.first[:-1]
        base = np.log10((count + 1) / (t.tokens + t.types + 1))
        add = lambda x: pa.array(np.add.reduceat(x, start) if len(start) else x[:0])
        yield pa.RecordBatch.from_arrays([ids, pa.array(roles == 2), pa.array(b.n), add((count > 0).astype(np.int64)), pa.array(np.full(len(start), t.tokens)), add(base), add(np.log10(p))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    id_type = own.schema["doc_id"].dataType.simpleString()
    return met(own, answers, None, work, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def report(docs: DataFrame) -> DataFrame:
    return score(docs)


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score); for tests."""
    import re
    import zlib
    from collections import Counter

    split = lambda x: [*re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower()), None]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % FOLDS == HELD_OUT
    c = Counter(w for i, x in rows if not held(i) for w in split(x))
    n = sum(c.values())
    return [(i, held(i), len(w := split(x)), sum(c[t] > 0 for t in w), n, sum(math.log10((c[t] + 1) / (n + len(c) + 1)) for t in w)) for i, x in rows]
