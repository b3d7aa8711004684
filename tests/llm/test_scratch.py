"""What operators leave on disk: shuffled rows and intermediate tables go as soon as nothing reads them any more."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.llm import earlier, line_dedup, scratch, substring


def shuffled(spark):
    """Names of the files of shuffled rows (local mode)."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for k in range(files.size()) if (x := files.apply(k).getName()).startswith("shuffle_")}


def left(n):
    """Names of the tables made since the first n that are still there."""
    return sorted(x.rpartition("/")[2].partition("-")[2] for x in scratch.made[n:] if os.path.exists(x.removeprefix("file://")))


def test_shuffled_rows_go(spark):
    before = shuffled(spark)
    rows = spark.range(10_000).repartition(3, "id")
    out = scratch.stash(rows, "test")
    for _ in range(100):  # they are deleted in the background
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert spark.conf.get(scratch.SHUFFLES_END) == "false"
    assert out.count() == rows.count() == 10_000
    n = len(scratch.made)
    scratch.forget(out)
    assert not left(n - 1)


def test_substrings_forget_tables(spark):
    rng = random.Random(3)
    prose = lambda n: [f"{rng.choice('abcdefghij')}{rng.randrange(10**6)}" for _ in range(n)]
    passage, other = prose(70), prose(60)
    docs = [prose(100) + passage, other + passage, prose(20) + other, prose(10)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    n = len(scratch.made)
    out = substring.report(df)
    assert set(left(n)) == {"copies", "passages"}
    assert sorted((r.doc_id, r.start, r.end, r.source_doc_id) for r in out.collect()) == [(1, 60, 130, 0), (2, 20, 80, 1)]


@pytest.mark.parametrize("hub_rows", [None, 1])
def test_lines_in_passes(spark, monkeypatch, hub_rows):
    """Packed rows are dealt out in several passes, with the same results as all pairs give, and the tables of them go."""
    monkeypatch.setattr(earlier, "PASS_SHARDS", 1)
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") + rng.choice("tuvwxyz") + rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))] for _ in range(30)]
    lines = [" ".join(x if rng.random() < 0.9 else "other" for x in b) for b in base * 6]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 6 : i * 6 + 6])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n = len(scratch.made)
    got = {r.rid: r.removed for r in line_dedup.removed(docs, hub_rows=hub_rows).collect()}
    assert sum(x.endswith("-first-meeting") for x in scratch.made[n:]) == earlier.PASSES
    assert not {"postings", "first-meeting", "sets"} & set(left(n))
    rid = {r.doc_id: r.rid for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid")).collect()}
    assert [got.get(rid[i], []) for i, _ in rows] == line_dedup.brute_force(rows)
