"""Exact set-similarity join of the token sets of texts: all links with Jaccard similarity of percent / 100 or more, as classes.

1. One pass takes each item's set of distinct tokens (as 64-bit hashes), its signature (items of equal sets share a node), and
   counts tokens over the whole corpus in a table of 2**20 counters by hash.
2. Those counts (a table of fixed size, hence broadcast) put all tokens into one order, rare first. Any fixed order keeps the join
   exact; a counter shared by two tokens only makes one of them look more frequent. The second pass emits the prefix of each
   set in that order: as many tokens as must hold one of any set that is similar enough.
3. Rows meet by token. The first set of a token (the one with the least of rare tokens, which in a group of copies is the one that
   the others were made from) is a leader: every other set that passes the length, positional and bitmap filters with it is a
   candidate, and follows it. The next set that follows none leads next, until none is left. So not all pairs of a token are formed.
   A follower is first compared with the first of its leaders only. Verified pairs are links; connected sets need no further comparing
   with each other.
4. What is left are pairs of followers, and of them and later leaders, with a common prefix token in different components. They all
   are compared, too: with hubs as long as there are many and hubs make them fewer, then every one of them. So every link either is
   verified or lies within a class.

The bitmap filter: each token flips one of 64 bits of its set. Every bit in which two sets differ is a token in one of them only, so
sets with more such bits than a similar pair may have of such tokens can't be similar.

A pair is verified once: suffix filter, then the whole sets, fetched from the texts of one item of each node.

Sets of frequent tokens are dealt out to several tasks, by node, and all of them count as followers; a task passes on only the first of
equal sets that it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.graph import components
from plumbline.llm.scratch import broadcast_upto, forget, stash
from plumbline.llm.words import SPACES, U, Words, mix, words, _ODD

BITS = 20
SLICES = 16
#: Rows of a token that stay together at least, and as a multiple of the mean count; see salts.
HUB_ROWS, HUB_MEANS = 50_000, 8
#: Signatures that a task remembers, to pass on equal sets once.
SEEN = 50_000
#: Ids of texts to fetch up to which they are broadcast; more are joined by shuffling.
BROADCAST_IDS = 500_000
#: Cross-component pairs that are filtered at once without trying hubs first, as a multiple of the rows they come from.
PAIRS_PER_ROW = 64


@dataclass
class Sets:
    """Distinct tokens of items: item k has token[first[k]:first[k + 1]], in the order of rank; row and line say where it stands."""

    row: np.ndarray
    line: np.ndarray
    first: np.ndarray
    token: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def nodes(self) -> np.ndarray:
        """Signatures: equal for equal sets."""
        sums = np.zeros(len(self.token) + 1, U)
        np.cumsum(mix(self.token ^ U(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
        return mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.sizes().astype(U)).view(np.int64)


def distinct(item: np.ndarray, token: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, token): the distinct tokens of each item, sorted (but for the few last bits that the number of an item takes in the key)."""
    bits = U(max(1, int(n_items).bit_length()))
    at = np.argsort(item.astype(U) << (U(64) - bits) | token >> bits)
    item, token = item[at], token[at]
    new = np.ones(len(at), bool)
    new[1:] = (token[1:] != token[:-1]) | (item[1:] != item[:-1])
    return np.searchsorted(item[new], np.arange(n_items + 1)), token[new]


Extract = Callable[[Words], Sets]


def shingle_sets(n: int) -> Extract:
    """Items are whole texts; tokens their shingles of n words, or all words of a text with fewer, but some."""

    def extract(w: Words) -> Sets:
        h, text = w.hashes(), w.of_text()
        m = max(0, len(h) - n + 1)
        token = np.zeros(m, U)
        for i in range(n):
            token += h[i : m + i] * _ODD[i]
        token = mix(token + U(n))
        whole = text[:m] == text[n - 1 : m + n - 1]
        item, token = text[:m][whole], token[whole]
        counts = np.diff(w.first)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            more = [mix(np.sum(h[w.first[i] : w.first[i + 1]] * _ODD[: counts[i]], keepdims=True, dtype=U) + U(counts[i])) for i in short]
            item, token = np.concatenate([item, short]), np.concatenate([token, *more])
        first, token = distinct(item, token, len(counts))
        return Sets(np.arange(len(counts)), np.zeros(len(counts), np.int64), first, token)

    return extract


def line_sets(least: int = 1) -> Extract:
    r"""Items are \n-split lines with at least this many distinct words; tokens are words."""

    def extract(w: Words) -> Sets:
        breaks = np.flatnonzero(w.buf == 10)
        # Number the lines of the piece; each text starts a line of its own.
        before = np.searchsorted(breaks, w.offsets)
        text = w.of_text()
        line = np.searchsorted(breaks, w.start) + text
        n = len(breaks) + len(w.offsets) - 1
        first, token = distinct(line, w.hashes(), n)
        keep = np.flatnonzero(np.diff(first) >= least)
        row = np.searchsorted(before[1:] + np.arange(1, len(before)), keep, "right")
        counts = np.diff(first)[keep]
        own = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(first[keep] - own[:-1], counts) + np.arange(own[-1])
        return Sets(row, keep - before[row] - row, own, token[at])

    return extract


def _batch(columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


_ITEMS = "doc long, rid long, line int, n int, node long, slice int, counts binary"


def scan(docs: DataFrame, extract: Extract) -> DataFrame:
    """docs: doc, rid, text. Rows of items (doc, rid, line, n, node), and of counters (slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << BITS, np.int64)
        none = lambda n, kind: pa.nulls(n, kind)
        for batch in batches:
            for lo, _, w in words(batch.column(2), SPACES):
                s = extract(w)
                at = (s.token >> U(64 - BITS)).astype(np.int64)
                if len(at) > 1 << BITS:
                    counters += np.bincount(at, minlength=1 << BITS)
                else:  # a table of its own for each piece costs more than the piece
                    np.add.at(counters, at, 1)
                if not len(s.row):
                    continue
                at = pa.array(s.row + lo)
                yield _batch({"doc": batch.column(0).take(at), "rid": batch.column(1).take(at), "line": s.line.astype(np.int32), "n": s.sizes().astype(np.int32), "node": s.nodes(), "slice": none(len(at), pa.int32()), "counts": none(len(at), pa.binary())})
        width = (1 << BITS) // SLICES
        long, small = none(SLICES, pa.int64()), none(SLICES, pa.int32())
        yield _batch({"doc": long, "rid": long, "line": small, "n": small, "node": long, "slice": np.arange(SLICES, dtype=np.int32), "counts": pa.array([packed(counters[i * width : (i + 1) * width]) for i in range(SLICES)], pa.binary())})

    return docs.mapInArrow(run, _ITEMS)


def packed(counts: np.ndarray) -> bytes:
    """Counts as bytes, those of one significance together, so that small ones compress."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


def total_counts(slices: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters, 2**BITS numbers. Slices are summed where they meet; the driver gets SLICES rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = unpacked(x.as_buffer().to_pybytes())
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([packed(x) for x in sums.values()], pa.binary())], ["slice", "counts"])

    rows = slices.repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect()
    width = (1 << BITS) // SLICES
    out = np.zeros(1 << BITS, np.int64)
    for k, x in rows:
        out[k * width : (k + 1) * width] += unpacked(bytes(x))
    return out


@dataclass
class Order:
    """The order of tokens: by level (8 steps for each doubling of the count), then by hash. salts: parts that a token's rows are dealt to."""

    level: np.ndarray
    salts: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, hub_rows: int = HUB_ROWS) -> Order:
        level = np.minimum(255, np.log2(1.0 + counts) * 8).astype(np.uint8)
        most = max(hub_rows, int(HUB_MEANS * counts.mean()))
        return cls(level, np.minimum(1 << 14, -(-counts // most)).clip(1).astype(np.int32))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


_POSTINGS = "token long, sc int, node long, np long, bits long"


def postings(docs: DataFrame, extract: Extract, order: Order, percent: int) -> DataFrame:
    """Prefix tokens of the sets: token, sc (part << 16 | score, the first leader has the least; part 0 if the token has one part only), node,
    np (size << 32 | place in the order), bits (see the bitmap filter)."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, seen = shared.value, set()
        for batch in batches:
            for _, _, w in words(batch.column(2), SPACES):
                s = extract(w)
                node, n = s.nodes(), s.sizes()
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                fresh &= n > 0
                if not fresh.any():
                    continue
                item = np.repeat(np.arange(len(n)), n)
                level = o.level[(s.token >> U(64 - BITS)).astype(np.int64)]
                # Tokens of an item are sorted by hash, so a stable sort by (item, level) is the order.
                at = np.argsort(item * 256 + level, kind="stable")
                place = np.arange(len(at)) - s.first[item[at]]
                score = 65535 - np.minimum(65535, np.add.reduceat(np.append(level.astype(np.int64), 0), s.first[:-1]) * 256 // np.maximum(n, 1))
                keep = (place < prefix_length(n, percent)[item[at]]) & fresh[item[at]]
                at, place, item = at[keep], place[keep], item[at][keep]
                token = s.token[at]
                salts = o.salts[(token >> U(64 - BITS)).astype(np.int64)]
                salt = np.where(salts > 1, 1 + (mix(node[item].view(U)) % salts.astype(U)).astype(np.int64), 0)
                bits = np.bitwise_xor.reduceat(np.append(U(1) << (s.token & U(63)), U(0)), s.first[:-1]).view(np.int64)
                yield _batch({"token": token.view(np.int64), "sc": (salt << 16 | score[item]).astype(np.int32), "node": node[item], "np": n[item].astype(np.int64) << 32 | place, "bits": bits[item]})

    return docs.mapInArrow(run, _POSTINGS)


def led(new: np.ndarray, size: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(leader, follower): rows that may match, of groups that start where new is true. All groups choose their next leaders at once."""
    group = np.cumsum(new) - 1
    rows = np.flatnonzero(np.bincount(group)[group] > 1)
    lead, free = np.full(len(new), -1), np.ones(len(new), bool)
    leaders, followers = [rows[:0]], [rows[:0]]
    while len(rows):
        own = group[rows]
        left = rows[free[rows]]
        heads = left[np.append(True, group[left[1:]] != group[left[:-1]])] if len(left) else left
        lead[own] = -1
        lead[group[heads]] = heads
        free[heads] = False
        by = lead[own]
        on = (by >= 0) & (by != rows)
        rows, by = rows[on], by[on]
        ok = may_match(size[by], bits[by], size[rows], bits[rows], percent)
        leaders.append(by[ok])
        followers.append(rows[ok])
        free[rows[ok]] = False
    return np.concatenate(leaders), np.concatenate(followers)


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """token, node, np, bits, leader, member. Candidates: rows with a leader. Sets that are still to be compared with each other: rows
    with member true, once for each token; those are all sets of a token with several parts, of others the followers, if many, and
    their leaders. A set that leads and has no follower was compared with all others."""

    def found(token: np.ndarray, sc: np.ndarray, node: np.ndarray, size: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        part = sc >> 16
        new = np.append(True, (token[1:] != token[:-1]) | (part[1:] != part[:-1]))
        own = new | np.append(True, node[1:] != node[:-1])  # equal sets are next to each other
        token, part, node, size, bits, new = (x[own] for x in (token, part, node, size, bits, new))
        leader, row = led(new, size, bits, percent)
        at, first = np.unique(row, return_index=True)
        group = np.cumsum(new) - 1
        # A lone follower is compared with all its leaders, of others each with the first one only.
        several = np.bincount(group[at], minlength=group[-1] + 1) > 1
        once = np.zeros(len(row), bool)
        once[first] = True
        keep = once | ~several[group[row]]
        leads = np.unique(leader[several[group[leader]]])
        leader, row = leader[keep], row[keep]
        member = once[keep] & (several[group[row]] | (part[row] > 0))
        rest = np.setdiff1d(np.union1d(np.flatnonzero(part > 0), leads), row[member])
        row, member = np.append(row, rest), np.append(member, np.ones(len(rest), bool))
        leader = pa.array(np.append(node[leader], np.zeros(len(rest), np.int64)), mask=np.arange(len(row)) >= len(leader))
        return _batch({"token": token[row], "node": node[row], "np": size[row], "bits": bits[row], "leader": leader, "member": member})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Parts of the last group so far, which may go on in the next batch.
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            here = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            last = (here[0] == here[0][-1]) & (here[1] >> 16 == here[1][-1] >> 16)
            cut = int(np.argmax(last))
            if cut or (held and (held[-1][0][-1], held[-1][1][-1] >> 16) != (here[0][0], here[1][0] >> 16)):
                yield found(*(np.concatenate(x) for x in zip(*held, [x[:cut] for x in here], strict=True)))
                held = []
            held.append([x[cut:] for x in here])
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    together = rows.repartition("token", F.shiftright("sc", 16)).sortWithinPartitions("token", "sc", "node")
    return together.mapInArrow(run, "token long, node long, np long, bits long, leader long, member boolean")


def may_match(a: np.ndarray, a_bits: np.ndarray, b: np.ndarray, b_bits: np.ndarray, percent: int) -> np.ndarray:
    """Length, positional and bitmap filter on (size << 32 | place) of a common token, the first one in the order, and bits."""
    na, nb = a >> 32, b >> 32
    both = na + nb
    rest = np.minimum(na - (a & 0xFFFFFFFF), nb - (b & 0xFFFFFFFF))
    most = both - 2 * -(-percent * both // (100 + percent))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (rest * (100 + percent) >= percent * both) & (np.bitwise_count((a_bits ^ b_bits).view(U)) <= most)


def differing(a: str, b: str) -> Column:
    """Bits in which the rows with these aliases differ."""
    return F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))


def could_match(a: str, b: str, percent: int) -> Column:
    """The same as may_match, of the rows with these aliases."""
    x, y = F.col(f"{a}.np"), F.col(f"{b}.np")
    na, nb = F.shiftright(x, 32), F.shiftright(y, 32)
    px, py = x.bitwiseAND(F.lit(0xFFFFFFFF)), y.bitwiseAND(F.lit(0xFFFFFFFF))
    both = na + nb
    length = (100 * F.least(na, nb)) >= percent * F.greatest(na, nb)
    place = F.least(na - px, nb - py) * (100 + percent) >= percent * both
    # Bits count tokens in one set only: both - 2 * overlap, where overlap * (100 + percent) >= percent * both.
    return length & place & ((both - differing(a, b)) * (100 + percent) >= 2 * percent * both)


def differ_at_least(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """Suffix filter: a lower bound of how many tokens are in one of two sorted arrays only, by splitting at the middle token of y."""
    if not depth or len(x) < 8 or len(y) < 8:
        return abs(len(x) - len(y))
    mid = len(y) // 2
    cut = int(np.searchsorted(x, y[mid]))
    return differ_at_least(x[:cut], y[:mid], depth - 1) + differ_at_least(x[cut:], y[mid:], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays of distinct tokens reach the similarity."""
    both = len(x) + len(y)
    # 100 * i >= percent * (both - i), and both - 2 * i tokens are in one of them only.
    most = both - 2 * -(-percent * both // (100 + percent))
    if abs(len(x) - len(y)) > most or differ_at_least(x, y) > most:
        return False
    merged = np.sort(np.concatenate([x, y]))
    common = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * common >= percent * (both - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. sets: node, tokens (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [similar(np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U), percent) for p, q in zip(x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, extract: Extract) -> DataFrame:
    """node, tokens of the nodes in wanted (rid, nodes), from the texts of those rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, w in words(batch.column(0), SPACES):
                s = extract(w)
                out_node, out = [], []
                need = [set(x.as_py()) for x in batch.column(1).slice(lo, len(w.offsets) - 1)]
                for k, (row, node) in enumerate(zip(s.row.tolist(), s.nodes().tolist(), strict=True)):
                    if node in need[row]:
                        need[row].discard(node)
                        out_node.append(node)
                        out.append(s.token[s.first[k] : s.first[k + 1]].tobytes())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.int64()), pa.array(out, pa.binary())], ["node", "tokens"])

    return docs.join(broadcast_upto(wanted, BROADCAST_IDS), "rid").select("text", "nodes").mapInArrow(run, "node long, tokens binary")


@dataclass
class Classes:
    """items: doc, rid, line, n, node of each item. links: verified pairs of nodes (a, b), which connect the
    components; pairs within one need not be among them. comps: node, comp of linked nodes."""

    items: DataFrame
    links: DataFrame
    comps: DataFrame


def picked(pairs: DataFrame) -> DataFrame:
    """a, b: of each node, its pair with the least d."""
    both = pairs.select("a", "b", "d").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    least = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m"))
    return least.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()


@dataclass
class Found:
    """What is known of the links so far: links (a, b), comps (node, comp) of linked nodes, and tested, the pairs that were verified."""

    docs: DataFrame
    extract: Extract
    items: DataFrame
    percent: int
    links: DataFrame
    comps: DataFrame
    tested: DataFrame | None = None

    def settle(self, pairs: DataFrame, picks: int) -> None:
        """Verifies candidates (two nodes, of different components, and in how many bits they differ) until each is verified or lies
        within a component.

        First each node picks the partner that differs least from it (then the least one, so all sets of a group of copies tend to the
        same one), so many times; then all that are left are verified. So a group takes about a verification a member, not one a pair.
        """
        pairs = pairs.toDF("x", "y", "d").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("d").alias("d"))
        pairs = stash(pairs, "pairs")
        for step in range(picks + 1):
            left = pairs
            if step:
                of = lambda x: self.comps.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_comp"))
                apart = F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")
                left = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(apart).select("a", "b", "d")
            pairs = stash(left if self.tested is None else left.join(self.tested, ["a", "b"], "left_anti"), "pairs-left")
            if pairs.isEmpty():
                return
            self.verify(stash(picked(pairs), "picked") if step < picks else pairs.select("a", "b"))

    def verify(self, pairs: DataFrame) -> None:
        new = linked(self.docs, self.extract, self.items, pairs, self.percent)
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        if not new.isEmpty():
            self.links = self.links.unionByName(new)
            self.comps = stash(components(self.links), "comps")


def linked(docs: DataFrame, extract: Extract, items: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough, each once."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = stash(nodes, "wanted-nodes")
    rows = items.join(broadcast_upto(nodes, BROADCAST_IDS), "node", "left_semi").groupBy("node").agg(F.min("rid").alias("rid"))
    wanted = stash(rows.groupBy("rid").agg(F.collect_list("node").alias("nodes")), "wanted")
    sets = stash(sets_of(docs.select("rid", "text"), wanted, extract), "sets", packed=True)
    out = stash(verified(pairs, sets, percent).distinct(), "links")
    forget(nodes, wanted, sets)
    return out


def scanned(docs: DataFrame, extract: Extract) -> tuple[DataFrame, Order]:
    """The items (doc, rid, line, n, node) of docs, and the order of their tokens."""
    every = stash(scan(docs, extract), "items")
    order = Order.of(total_counts(every.filter("slice is not null").select("slice", "counts")))
    return every.filter("slice is null").select("doc", "rid", "line", "n", "node"), order


def classes(docs: DataFrame, extract: Extract, *, percent: int = 80) -> Classes:
    """docs: doc (long), rid (long, equal only for rows with equal text), text."""
    spark = docs.sparkSession
    items, order = scanned(docs, extract)
    met = stash(meetings(postings(docs, extract, order, percent), percent), "met")
    found = Found(docs, extract, items, percent, spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, comp long"))
    members = met.filter("member").select("token", "node", "np", "bits")
    pairs = met.filter("leader is not null").select("leader", "node", F.lit(0))
    final, rounds, before = False, 0, None
    while True:
        # At the end few of the candidates are links, so a second pick would hardly save any.
        found.settle(pairs, 1 if final else 2)
        links, comps = found.links, found.comps
        if final:
            return Classes(items, links, comps)
        # What shares a prefix token across components.
        labelled = members.join(comps, "node", "left").select("token", "node", "np", "bits", F.coalesce("comp", "node").alias("comp"))
        per = labelled.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.count("*").alias("comps")).filter("comps > 1")
        mixed = stash(labelled.join(per.select("token"), "token", "left_semi"), "mixed")
        n, cross = per.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("sq")) / 2)).first()
        if not n:
            return Classes(items, links, comps)
        rounds += 1
        # Hubs go on as long as each round of them at least halves what is left.
        paid, before = before is None or 2 * cross <= before, cross
        if cross > PAIRS_PER_ROW * n and paid:
            hub = mixed.groupBy("token").agg(F.min_by(F.struct("node", "np", "bits", "comp"), F.xxhash64("node", F.lit(rounds))).alias("h")).select("token", "h.*")
            x, y = mixed.alias("x"), stash(hub, "hubs").alias("y")
            pairs = x.join(y, "token").filter((F.col("x.comp") != F.col("y.comp")) & could_match("x", "y", percent)).select("x.node", "y.node", differing("x", "y"))
        else:
            x, y = mixed.alias("x"), mixed.alias("y")
            on = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") < F.col("y.comp")) & could_match("x", "y", percent)
            pairs, final = x.join(y, on).select("x.node", "y.node", differing("x", "y")), True


def with_identity(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, rid, text: rid tells apart rows with different ids or texts. Ids that are no integers count by their hash (64 bits)."""
    whole = docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    doc = F.col(doc_id).cast("long") if whole else F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.col(doc_id)))
    return docs.select(doc.alias("doc"), F.xxhash64(F.col(doc_id), F.col(text)).alias("rid"), F.col(text).alias("text"))
