r"""Exact set-similarity join for the removal of later matches: which sets have a similar one before them.

Tokens are put in order and prefixes taken as in setjoin. Rows of prefix tokens travel packed, many in one binary value, to shards
that hold whole tokens. In a shard, the rows of a token stand in the order of their first places:

1. The first of them leads: others that pass the length, positional and bitmap filters with it follow it, and each such pair is a
   candidate. The next that follows none leads next, until none is left. So the rows of a group of copies meet its first one, not
   each other. A leader that comes after followers of others is compared with those, too.
2. Candidates are verified (suffix filter, then the whole sets). A set is settled when one before it proves similar.
3. Followers that are not settled, few as the filters are sharp, then meet every row before them of all their tokens, exactly.

So for every pair of similar sets the later one either was verified with the earlier one, or is settled by another.

The bitmap filter: each token flips one bit of its set's bitmap, 64 bits for up to 96 tokens and twice as many for each doubling.
Bits in which two sets differ (the wider bitmap is folded) are tokens of one of them only.

Rows of a frequent token are dealt out to several parts by node. A part settles most of them against its own leaders; leaders of
parts count as unsettled followers, and meet the rows of all parts in a join that adaptive execution can split.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import broadcast_upto, forget, stash
from plumbline.llm.setjoin import BITS, BROADCAST_IDS, SEEN, SLICES, Extract, Order, Sets, could_match, linked, prefix_length, scan, total_counts
from plumbline.llm.words import SPACES, U, mix, words

#: Sizes up to which a bitmap has 1, 2, 4, 8 words; those above have 16.
WIDTHS = (96, 192, 384, 768)
#: Rows that a task gathers before it packs them, and tokens of the corpus for which there is a shard.
GATHERED, SHARD_TOKENS = 200_000, 1_000_000
#: Passes of the first meeting at most, and shards of a pass at least. Only the packed rows of one pass are dealt out at a time, so that
#: not all of them lie twice on disk.
PASSES, PASS_SHARDS = 3, 12
#: Pairs that are filtered at once.
AT_ONCE = 1 << 20
#: Bits of the table of unsettled nodes that goes to the tasks; what it lets through in error is dropped by a join.
FILTER_BITS = 23
#: Stands for a null id, and comes first, too.
NULL = -(2**63)


def width(n: np.ndarray) -> np.ndarray:
    return 1 << np.searchsorted(WIDTHS, n)


def bitmaps(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    """(first, words): bitmaps of the items, words[first[k]:first[k + 1]] that of item k."""
    n = s.sizes()
    first = np.concatenate([[0], np.cumsum(width(n))])
    item = np.repeat(np.arange(len(n)), n)
    bit = s.token & (64 * width(n)[item] - 1).astype(U)
    out = np.zeros(first[-1], U)
    np.bitwise_xor.at(out, first[item] + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return first, out


@dataclass
class Rows:
    """Prefix tokens of sets; bits is ragged, width(size) words each."""

    token: np.ndarray  # uint64
    part: np.ndarray  # int32; 0 if the token has one part only
    node: np.ndarray  # int64
    size: np.ndarray  # int32
    place: np.ndarray  # int32, in the order
    doc: np.ndarray  # int64
    line: np.ndarray  # int32
    bits: np.ndarray  # uint64

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        return cls(*(np.concatenate([getattr(x, f.name) for x in parts]) for f in fields(cls)))

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(width(self.size))])

    def take(self, at: np.ndarray) -> Rows:
        first, w = self.starts()[at], width(self.size[at])
        own = np.concatenate([[0], np.cumsum(w)])
        bits = self.bits[np.repeat(first - own[:-1], w) + np.arange(own[-1])]
        return Rows(*(getattr(self, f.name)[at] for f in fields(self)[:-1]), bits)

    def cut(self, at: np.ndarray) -> Iterator[Rows]:
        """The rows from each of these places to the next, or to the end."""
        first, ends = self.starts(), [*at[1:], len(self.token)]
        for a, b in zip(at, ends, strict=True):
            yield Rows(*(getattr(self, f.name)[a:b] for f in fields(self)[:-1]), self.bits[first[a] : first[b]])

    def pack(self) -> bytes:
        kinds = [np.diff(self.token, prepend=U(0)), *(getattr(self, f.name) for f in fields(self)[1:])]
        # Bytes of one significance together, so that small numbers compress.
        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in kinds]
        return zstandard.ZstdCompressor(1).compress(len(self.token).to_bytes(8, "little") + b"".join(planes))

    @classmethod
    def unpack(cls, data: bytes) -> Rows:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        n, at, out = int(raw[:8].view(np.int64)[0]), 8, []
        for kind in (U, np.int32, np.int64, np.int32, np.int32, np.int64, np.int32, U):
            size = np.dtype(kind).itemsize
            many = n if len(out) < 7 else (len(raw) - at) // size
            out.append(np.ascontiguousarray(raw[at : at + many * size].reshape(size, many).T).view(kind).reshape(-1))
            at += many * size
        out[0] = np.cumsum(out[0], dtype=U)
        return cls(*out)


_PACKED = "shard int, rows binary"


def postings(docs: DataFrame, extract: Extract, order: Order, percent: int, shards: int) -> DataFrame:
    """docs: doc, rid, text. Packed rows, sorted by token, of each distinct set's first place in a task."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, seen, waiting, count = shared.value, {}, [], 0

        def packed() -> pa.RecordBatch:
            rows = Rows.joined(waiting)
            shard = shard_of(rows.token, rows.part, shards)
            at = np.lexsort((rows.token, shard))
            rows = rows.take(at)
            known, first = np.unique(shard[at], return_index=True)
            out = [x.pack() for x in rows.cut(first)]
            return pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), pa.array(out, pa.binary())], ["shard", "rows"])

        for batch in batches:
            for lo, _, w in words(batch.column(2), SPACES):
                s = extract(w)
                if not len(s.row):
                    continue
                ids = batch.column(0).slice(lo, len(w.offsets) - 1).fill_null(NULL).to_numpy(zero_copy_only=False)
                node, n, doc = s.nodes(), s.sizes(), ids[s.row]
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.zeros(len(node), bool)
                # Of a piece's equal sets the first by place, and that only if none before it was met.
                at = np.lexsort((s.line, doc, node))
                at = at[np.append(True, node[at[1:]] != node[at[:-1]]) & (n[at] > 0)]
                for i, x, place in zip(at.tolist(), node[at].tolist(), zip(doc[at].tolist(), s.line[at].tolist(), strict=True), strict=True):
                    if x not in seen or place < seen[x]:
                        seen[x] = place
                        fresh[i] = True
                if not fresh.any():
                    continue
                item, at, place = in_order(s, o.level, fresh)
                keep = place < prefix_length(n, percent)[item]
                at, place, item = at[keep], place[keep], item[keep]
                token = s.token[at]
                salts = o.salts[(token >> U(64 - BITS)).astype(np.int64)]
                part = np.where(salts > 1, 1 + (mix(node[item].view(U)) % salts.astype(U)).astype(np.int64), 0).astype(np.int32)
                first, bits = bitmaps(s)
                w_ = width(n)[item]
                own = np.concatenate([[0], np.cumsum(w_)])
                bits = bits[np.repeat(first[item] - own[:-1], w_) + np.arange(own[-1])]
                waiting.append(Rows(token, part, node[item], n[item].astype(np.int32), place.astype(np.int32), doc[item], s.line[item].astype(np.int32), bits))
                count += len(token)
                if count >= GATHERED:
                    yield packed()
                    waiting, count = [], 0
        if waiting:
            yield packed()

    return docs.mapInArrow(run, _PACKED)


def in_order(s: Sets, level: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, at, place): the tokens of the wanted items in the order, which is by level and then by hash, as tokens of an item stand."""
    n = s.sizes()
    own = np.flatnonzero(np.repeat(wanted, n))
    item = np.repeat(np.flatnonzero(wanted), n[wanted])
    # The place goes along in the lowest bits, as sorting is much faster than finding an order.
    bits = max(1, len(s.token).bit_length())
    key = np.sort((item << 8 | level[(s.token[own] >> U(64 - BITS)).astype(np.int64)]) << bits | own)
    at = key & ((1 << bits) - 1)
    return item, at, np.arange(len(at)) - np.repeat(np.cumsum(n[wanted]) - n[wanted], n[wanted])


def shard_of(token: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    """Tokens with one part have the shards below this number, all others those above."""
    return (mix(token + part.astype(U)) % U(shards)).astype(np.int64) + shards * (part > 0)


def places(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Numbers in the order of (doc, line), equal for equal ones."""
    if not len(doc):
        return doc
    low, lines = int(doc.min()), int(line.max()) + 1
    if (int(doc.max()) - low + 1) * lines < 1 << 62:
        return (doc - low) * lines + line
    at = np.lexsort((line, doc))
    out = np.zeros(len(at), np.int64)
    out[at[1:]] = np.cumsum((np.diff(doc[at]) != 0) | (np.diff(line[at]) != 0))
    return out


class Meeting:
    """The rows of a shard, by token, part and first place; sets of a token once each."""

    def __init__(self, rows: Rows, percent: int):
        # Packed rows come sorted by token, so a stable sort only merges them.
        at = np.lexsort((rows.part, rows.token)) if rows.part.any() else np.argsort(rows.token, kind="stable")
        edges = lambda: np.append(True, (rows.token[at[1:]] != rows.token[at[:-1]]) | (rows.part[at[1:]] != rows.part[at[:-1]]))[: len(at)]
        # Only tokens that two sets share, perhaps in another part.
        many = np.diff(np.append(np.flatnonzero(edges()), len(at)))
        at = at[np.repeat(many > 1, many) | (rows.part[at] > 0)]
        group, place = np.cumsum(edges()), places(rows.doc[at], rows.line[at])
        low, most = (int(place.min()), int(place.max()) - int(place.min()) + 1) if len(at) else (0, 1)
        order = np.argsort(group * most + (place - low)) if len(at) * most < 1 << 62 else np.lexsort((place, group))
        at, group, place = at[order], group[order], place[order]
        same = mix(rows.node[at].view(U) + mix(group.astype(U)))
        order = np.argsort(same)
        once = np.sort(np.minimum.reduceat(order, np.flatnonzero(np.append(True, same[order[1:]] != same[order[:-1]])))) if len(at) else order
        at, self.place = at[once], place[once]
        new = edges()
        self.percent, self.first, self.group = percent, np.append(np.flatnonzero(new), len(at)), np.cumsum(new) - 1
        self.node, self.part, self.size, self.rank = rows.node[at], rows.part[at], rows.size[at].astype(np.int64), rows.place[at]
        self.wide, starts = width(self.size), rows.starts()
        self.start, self.bits = starts[at], rows.bits
        self.folded = np.bitwise_xor.reduceat(rows.bits, starts[:-1])[at] if len(at) else rows.bits[:0]

    def may_match(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length, positional and bitmap filter of rows of one token, which counts as the first common one."""
        ok, p, na, nb = np.zeros(len(x), bool), self.percent, self.size[x], self.size[y]
        at = np.flatnonzero(100 * np.minimum(na, nb) >= p * np.maximum(na, nb))
        x, y, na, nb = x[at], y[at], na[at], nb[at]
        both = na + nb
        rest = np.minimum(na - self.rank[x], nb - self.rank[y])
        most = both - 2 * -(-p * both // (100 + p))
        near = np.flatnonzero((rest * (100 + p) >= p * both) & (np.bitwise_count(self.folded[x] ^ self.folded[y]) <= most))
        at, x, y, most = at[near], x[near], y[near], most[near]
        fine = np.ones(len(at), bool)
        wide = np.minimum(self.wide[x], self.wide[y])
        for w in (2, 4, 8, 16):
            k = np.flatnonzero(wide == w)
            if len(k):
                fine[k] = np.bitwise_count(self.of_width(x[k], w) ^ self.of_width(y[k], w)).sum(1, dtype=np.int64) <= most[k]
        ok[at[fine]] = True
        return ok

    def of_width(self, at: np.ndarray, w: int) -> np.ndarray:
        """Bitmaps of rows, folded to w words."""
        out = np.zeros((len(at), w), U)
        for k in range(int(self.wide[at].max()) // w):
            on = np.flatnonzero(self.wide[at] > k * w)
            out[on] ^= self.bits[self.start[at[on]][:, None] + k * w + np.arange(w)]
        return out

    def led(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leader, follower) of pairs that may match, and whether a row leads. All groups choose their next leaders at once."""
        rows = np.arange(len(self.group))
        lead = np.full(len(self.first), -1)
        leaders, followers = [rows[:0]], [rows[:0]]
        leads = np.zeros(len(rows), bool)
        while len(rows):
            own = self.group[rows]
            heads = rows[np.append(True, own[1:] != own[:-1])]
            leads[heads] = True
            lead[self.group[heads]] = heads
            by = lead[own]
            on = by != rows
            rows, by = rows[on], by[on]
            ok = self.may_match(by, rows)
            leaders.append(by[ok])
            followers.append(rows[ok])
            rows = rows[~ok]
        return np.concatenate(leaders), np.concatenate(followers), leads

    def pairs(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(earlier, later) of the pairs that may match of rows x and y (ascending): each of y with those of x in its group whose
        first place is before its own, or the same (documents with one id). No pair of a row with itself."""
        rank = np.zeros(len(self.group), np.int64)  # rises where the place does
        rank[1:] = np.cumsum((self.group[1:] != self.group[:-1]) | (self.place[1:] != self.place[:-1]))
        lo = np.searchsorted(x, self.first[self.group[y]])
        hi = np.searchsorted(rank[x], rank[y], "right")  # rows, and so their ranks, ascend
        n = np.maximum(0, hi - lo)
        ends = np.cumsum(n)
        a = 0
        while a < len(y):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
            later = np.repeat(y[a:b], n[a:b])
            earlier = x[np.repeat(lo[a:b] - (ends[a:b] - n[a:b]), n[a:b]) + np.arange(ends[a] - n[a], ends[b - 1])] if len(later) else later
            ok = (earlier != later) & self.may_match(earlier, later)
            yield earlier[ok], later[ok]
            a = b


def shards_met(packed: DataFrame, percent: int, work, schema: str, passes: int = 1) -> DataFrame:
    """work(meeting) of each shard, which yields RecordBatches. packed: the rows of one of so many passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = None, []
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != shard and waiting:
                    yield from work(Meeting(Rows.joined(waiting), percent))
                    waiting = []
                shard = k
                waiting.append(Rows.unpack(data.as_buffer().to_pybytes()))
        if waiting:
            yield from work(Meeting(Rows.joined(waiting), percent))

    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Shards of a pass are few, so twice as many tasks as its share; an empty one costs a start of Python.
    n = n if passes == 1 else -(-2 * n // passes)
    return packed.select("shard", "rows").repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


#: What the first meeting finds: pairs of nodes, whether b follows a, and leaders of parts (a is null).
_FOUND = "a long, b long, follows boolean"


def first_meeting(m: Meeting) -> Iterator[pa.RecordBatch]:
    node, names = m.node, ["a", "b", "follows"]
    leader, follower, leads = m.led()
    followed = np.bincount(m.group[follower], minlength=len(m.first)) > 0
    heads, behind = np.flatnonzero(leads & followed[m.group]), np.sort(follower)
    found = [(leader, follower, True), *((x, y, False) for x, y in m.pairs(behind, heads))]
    for x, y, follows in found:
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y]), pa.array(np.full(len(x), follows))], names)
    parts = np.unique(node[leads & (m.part > 0)])
    if len(parts):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.array(parts), pa.array(np.ones(len(parts), bool))], names)


def filter_of(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """A table of bits by hash: set for all of the keys (long) of the batches of df, and by chance for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for x in keys(batch):
                bits[filter_bit(x)] = True
        packed = np.packbits(bits).reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([x.tobytes() for x in packed], pa.binary())], ["slice", "bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint8)
                out[k] = out[k] | x if k in out else x.copy()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], ["slice", "bits"])

    rows = df.mapInArrow(run, "slice int, bits binary").repartition(SLICES, "slice").mapInArrow(either, "slice int, bits binary").collect()
    out = np.zeros((SLICES, (1 << FILTER_BITS) // 8 // SLICES), np.uint8)
    for k, x in rows:
        out[k] |= np.frombuffer(x, np.uint8)
    return out.reshape(-1)


def filter_bit(node: np.ndarray) -> np.ndarray:
    return (mix(node.view(U)) >> U(64 - FILTER_BITS)).astype(np.int64)


def passes(table: np.ndarray, node: np.ndarray) -> np.ndarray:
    at = filter_bit(node)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def graded(size: np.ndarray, percent: int) -> np.ndarray:
    """Sizes by steps, as wide as sizes of similar sets may differ."""
    return np.floor(np.log(size) / np.log(max(1.01, 100 / percent) * (1 + 1e-9))).astype(np.int64)


def second_meeting(packed: DataFrame, percent: int, table: np.ndarray) -> DataFrame:
    """packed: rows of tokens with one part. a, b: all pairs that may match of a node that passes the table (b) and one before it (a).
    Only rows of tokens that such a node has, and of about its size, are dealt out again."""
    context = packed.sparkSession.sparkContext
    shared = context.broadcast(table)

    def asked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for data in batch.column(1):
            r = Rows.unpack(data.as_buffer().to_pybytes())
            own = passes(shared.value, r.node)
            token, grade = r.token[own], graded(r.size[own], percent)
            for k in (-1, 0, 1):  # what is similar differs by one grade at most
                yield mix(token + (grade + k).astype(U)).view(np.int64)

    tokens = context.broadcast(filter_of(packed, asked))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                r = Rows.unpack(data.as_buffer().to_pybytes())
                r = r.take(np.flatnonzero(passes(tokens.value, mix(r.token + graded(r.size, percent).astype(U)).view(np.int64))))
                if len(r.token):
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()), pa.array([r.pack()], pa.binary())], ["shard", "rows"])

    def work(m: Meeting) -> Iterator[pa.RecordBatch]:
        for x, y in m.pairs(np.arange(len(m.group)), np.flatnonzero(passes(shared.value, m.node))):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(m.node[x]), pa.array(m.node[y])], ["a", "b"])

    return shards_met(packed.mapInArrow(narrowed, _PACKED), percent, work, "a long, b long")


def rows_in_parts(packed: DataFrame) -> DataFrame:
    """packed: rows of tokens with several parts. token, node, np (size << 32 | place), bits (64 of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                r = Rows.unpack(data.as_buffer().to_pybytes())
                if len(r.token):
                    bits = np.bitwise_xor.reduceat(r.bits, r.starts()[:-1]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(r.token.view(np.int64)), pa.array(r.node), pa.array(r.size.astype(np.int64) << 32 | r.place), pa.array(bits)], ["token", "node", "np", "bits"])

    return packed.mapInArrow(run, "token long, node long, np long, bits long").distinct()


@dataclass
class Matches:
    """items: doc, rid, line, n, node. firsts: node, its first place (doc, rid, line), and how many copies there are. later: the nodes that have a similar one before them."""

    items: DataFrame
    firsts: DataFrame
    later: DataFrame


def matches(docs: DataFrame, extract: Extract, *, percent: int = 80, hub_rows: int | None = None) -> Matches:
    """docs: doc (long), rid (long, equal only for rows with equal id and text), text. hub_rows: rows of a token from which it is dealt out to parts."""
    spark = docs.sparkSession
    every = stash(scan(docs, extract), "items")
    items = every.filter("slice is null").select("doc", "rid", "line", "n", "node")
    counts = total_counts(every.filter("slice is not null").select("slice", "counts"))
    order = Order.of(counts) if hub_rows is None else Order.of(counts, hub_rows)
    firsts = stash(items.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc", "rid", "line")).alias("place"), F.count("*").alias("copies")), "first-places")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // SHARD_TOKENS)
    passes = max(1, min(PASSES, shards // PASS_SHARDS))
    packed = postings(docs, extract, order, percent, shards).withColumn("turn", F.col("shard") % passes)
    packed = stash(packed, "postings", packed=True, by="turn" if passes > 1 else None)

    def in_order(pairs: DataFrame) -> DataFrame:
        """a, b: each pair once, the earlier one first."""
        pairs = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        nodes = stash(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "pairs-nodes")
        placed = stash(firsts.join(broadcast_upto(nodes, BROADCAST_IDS), "node", "left_semi"), "places")
        of = lambda x: placed.select(F.col("node").alias(x), F.col("place").alias(f"{x}_place"))
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        swap = F.col("a_place") > F.col("b_place")
        return both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))

    met = [stash(shards_met(packed.filter(F.col("turn") == k), percent, first_meeting, _FOUND, passes), "first-meeting") for k in range(passes)]
    found = functools.reduce(DataFrame.unionByName, met)
    tested = stash(in_order(found.filter("a is not null").select("a", "b")), "candidates")
    settled = linked(docs, extract, items, tested, percent).select(F.col("b").alias("node")).distinct()
    open_ = stash(found.filter("follows").select(F.col("b").alias("node")).distinct().join(settled, "node", "left_anti"), "open")
    if open_.isEmpty():
        forget(packed, *met)
        return Matches(items, firsts, settled)
    more = second_meeting(packed.filter(F.col("shard") < shards), percent, filter_of(open_, lambda batch: iter([batch.column(0).to_numpy()])))
    if not found.filter("a is null").isEmpty():
        rows = stash(rows_in_parts(packed.filter(F.col("shard") >= shards)), "rows-in-parts")
        x, y = rows.alias("x"), rows.join(open_, "node", "left_semi").alias("y")
        more = more.unionByName(x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") != F.col("y.node")) & could_match("x", "y", percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    more = in_order(more)
    forget(packed, *met)
    more = more.join(open_.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b").join(tested, ["a", "b"], "left_anti")
    again = linked(docs, extract, items, stash(more, "candidates"), percent).select(F.col("b").alias("node"))
    return Matches(items, firsts, settled.unionByName(again).distinct())
