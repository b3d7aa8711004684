r"""Line dedup: a line goes if an earlier line of the corpus has the same words, or words with a Jaccard similarity of 0.8 or more to its
own (see earlier). Earlier is by (doc_id, line); the earlier line need not stay itself.

Lines are split at \n; words are ``[^\x20\x09-\x0D]+``, A-Z as a-z. Lines without a word always stay;
all others take part, however short.

Defined results: a null text has no lines; null ids come first; rows with equal ids and different texts come in the order of a hash;
repeated rows (equal id and text) are told nothing apart and keep the same lines; a document without a word left, of which lines were
removed, goes; an empty table gives an empty one; extra columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.earlier import matches
from plumbline.llm.scratch import broadcast_upto, stash

#: Sets that stand twice or have a match up to which they are broadcast; more are joined by shuffling.
BROADCAST_NODES = 500_000
#: Removed lines (4 bytes each, and 8 a document) up to which they are broadcast, so that texts need no shuffle; more are joined by shuffling.
BROADCAST_LINES = 2_000_000
from plumbline.llm.setjoin import line_sets, with_identity


def removed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80, hub_rows: int | None = None) -> DataFrame:
    """rid and the numbers (from 0) of the lines to remove, for documents that have some."""
    m = matches(with_identity(docs, doc_id, text), line_sets(), percent=percent, hub_rows=hub_rows)
    nodes = m.firsts.join(m.later.withColumn("similar", F.lit(True)), "node", "left").filter("copies > 1 or similar")
    later = m.items.join(broadcast_upto(stash(nodes, "nodes-with-matches"), BROADCAST_NODES), "node").filter("similar or rid <> place.rid or line <> place.line").select("rid", "line")
    return later.distinct().groupBy("rid").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def _joined(rows: DataFrame, gone: DataFrame) -> DataFrame:
    n = gone.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0]
    return rows.join(F.broadcast(gone) if n <= BROADCAST_LINES else gone, "rid", "left")


def report(docs: DataFrame, *, hub_rows: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (numbers from 0, comma-joined) of each document."""
    gone = stash(removed(docs, hub_rows=hub_rows), "removed-lines")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    own = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), lines.alias("n_lines"))
    out = _joined(own, gone)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later lines removed from their texts, in their own columns."""
    names = docs.columns
    own = docs.toDF(*[f"c{k}" for k in range(len(names))])
    i, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    gone = stash(removed(own, doc_id=i, text=t), "removed-lines")
    rows = _joined(own.withColumn("rid", F.xxhash64(i, t)), gone)
    # Variables of lambdas are values, whereas a column would be split anew for each line, and once more by a filter on the result.
    without = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "removed"), lambda k: F.get(x, k)), "\n")
    left = F.filter(F.transform(F.array(F.split(t, "\n")), without), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumn("left", F.explode(F.when(F.col("removed").isNull(), F.array(t)).otherwise(left)))
    return rows.select(*[F.col("left" if f"c{k}" == t else f"c{k}").alias(x) for k, x in enumerate(names)])


def brute_force(rows: list[tuple[int | None, str | None]], percent: int = 80) -> list[list[int]]:
    """The removed lines of each row, by comparing all lines; ids are different. For tests."""
    import re

    flat = [(-1 if i is None else i, k, row, frozenset(re.findall(rb"[^\x20\x09-\x0D]+", line.encode().lower()))) for row, (i, x) in enumerate(rows) if x is not None for k, line in enumerate(x.split("\n"))]
    flat = sorted((x for x in flat if x[3]), key=lambda x: x[:2])
    out: list[list[int]] = [[] for _ in rows]
    for at, (_, k, row, s) in enumerate(flat):
        if any(100 * len(s & t) >= percent * len(s | t) for *_, t in flat[:at]):
            out[row].append(k)
    return out
