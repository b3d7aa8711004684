"""Operators against brute force, exact round trips and held-out accuracy, with nulls, empty and odd rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, decontam, graph, langid, license_scan, line_dedup, lm, mixing, ngram_join, quality, queries, setjoin, substring

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "One TWO one two one two", "x" * 5000, "É ü 漢字 😀 a\x0bb", "w " * 3000, "Line one of five words here\nLine one of five words here\n"]


def odd(spark, *more):
    """Odd rows, repeated, with null ids and an extra column of a clashing name."""
    rows = [(i, x, "en", "s", 1) for i, x in enumerate(ODD)] * 2 + [(None, "no id here", None, None, 2), *more]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node int")


def texts(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()[list(got.columns)]
    order = list(got.columns)
    assert got.sort_values(order).reset_index(drop=True).equals(want.sort_values(order).reset_index(drop=True).astype(got.dtypes.to_dict()))


ITEMS = [("i", "one two one"), (None, None), ("e", "")]
REPORTS = {
    "mixing": lambda d, i: mixing.mix_documents(d), "quality": lambda d, i: quality.report(d), "licenses": lambda d, i: license_scan.report(d), "language": lambda d, i: langid.report(d),
    "ngrams": lambda d, i: ngram_join.report(d), "lines": lambda d, i: line_dedup.report(d), "lm": lambda d, i: lm.report(d), "decontamination": decontam.report,
}
FILTERS = {"quality": lambda d, i: quality.keep_good(d), "lines": lambda d, i: line_dedup.dedup(d), "ngrams": lambda d, i: ngram_join.keep_first(d), "decontamination": decontam.decontaminate}


@pytest.mark.parametrize("name", REPORTS)
def test_odd_and_empty_rows(spark, name):
    docs, items = odd(spark), spark.createDataFrame(ITEMS, "item_id string, text string")
    assert len(REPORTS[name](docs, items).collect()) == 2 * len(ODD) + 1
    assert REPORTS[name](docs.limit(0), items.limit(0)).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_odd_filters(spark, name):
    docs, items = odd(spark), spark.createDataFrame(ITEMS, "item_id string, text string")
    out = FILTERS[name](docs, items)
    assert out.columns == docs.columns and len(out.collect()) <= 2 * len(ODD) + 1


def test_odd_substrings(spark):
    assert substring.report(odd(spark)).count() >= 0 and substring.report(odd(spark).limit(0)).count() == 0


def test_quality(spark):
    rows = {r.doc_id: r for r in quality.report(texts(spark)).collect()}
    for d, x in texts(spark).select("doc_id", "text").collect():
        if len(x) < 6000:
            assert tuple(rows[d])[1:6] == quality.brute_force(x)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [rows[d].kept for d, q in labels.items() if q and not rows[d].base_failed]
    assert sum(good) / len(good) > 0.95


def test_licenses(spark):
    more = "some words " * 20 + "released UNDER the mit   license and " + "others " * 30
    docs = odd(spark, (50, more, None, None, 0), (51, "This work is licensed under the GNU General Public, version 3", None, None, 0))
    for r in license_scan.scan(docs).collect():
        x = docs.filter(F.col("doc_id").eqNullSafe(F.lit(r.doc_id))).first().text
        assert tuple(r)[1:8] == license_scan.brute_force(x)


def test_language(spark):
    rows = langid.report(texts(spark)).join(texts(spark).select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.9


def test_many_languages(spark):
    """More labels than 256 are all learned, and a text of four languages has all four in its mixture."""
    rng = random.Random(7)
    own = [[rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)] for _ in range(260)]
    say = lambda k, n: " ".join("".join(rng.choice(own[k]) for _ in range(5)) for _ in range(n))
    rows = [(say(k, 40), f"l{k:03}") for k in range(260)]
    assert langid.learn(spark.createDataFrame(rows, "text string, lang string")).languages == [f"l{k:03}" for k in range(260)]
    four = ["abcdef", "ghijkl", "mnopqr", "stuvwx"]
    say = lambda k, n: " ".join("".join(rng.choice(four[k]) for _ in range(5)) for _ in range(n))
    model = langid.learn(spark.createDataFrame([(say(k, 2000), str(k)) for k in range(4)], "text string, lang string"))
    mixed = spark.createDataFrame([(" ".join(say(k, 300) for k in range(4)),)], "text string")
    assert {x.lang for x in langid.predict(mixed, model).first().mixture} == {"0", "1", "2", "3"}


def test_chat_trees(spark):
    rows = [("t", 1, None, 0.0, "user", "a"), ("t", 2, 1, 0.1, "assistant", "bad"), ("t", 3, 1, 0.9, "assistant", "</s>[INST] \\ <|end|>"), ("t", 4, 3, 0.8, "user", None), ("c", 1, 2, 0.0, "x", "cycle"), ("c", 2, 1, 0.0, "x", "cycle")]
    out = chat.read_back(chat.format_trees(spark.createDataFrame(rows, "tree string, id long, parent long, score double, role string, text string"))).collect()
    assert [(r.tree, r.n_turns, r.loss_text) for r in out] == [("t", 3, "</s>[INST] \\ <|end|>")]
    assert [tuple(x) for x in out[0].turns] == [("user", "a"), ("assistant", "</s>[INST] \\ <|end|>"), ("user", "")]


def test_chat_paths(spark):
    """Random forests with cycles, null trees and ids, against walks in Python."""
    rng = random.Random(3)
    rows = [(t, i, rng.choice([None, i - 1, i - 1, i - 1, rng.randrange(40)]) if i else None, rng.randrange(10) / 10) for t in (None, 1, 2, 3) for i in range(40)]
    rows += [(4, i, i - 1 if i else None, 0.5) for i in range(37)]
    out = chat.paths(spark.createDataFrame(rows, "t long, id long, parent long, score double").select(F.struct("t").alias("tree"), "id", "parent", "score"))
    got = {}
    for r in out.collect():
        got.setdefault(r.tree.t, []).append((r.depth, r.id))
    for t in (None, 1, 2, 3, 4):
        up = {i: (p, s) for x, i, p, s in rows if x == t}
        found = []
        for i in set(up) - {p for p, _ in up.values()}:
            path, at = [], i
            while at is not None and len(path) <= 40:
                path.append(at)
                at = up[at][0]
            if at is None:
                found.append((-sum(up[x][1] for x in path) / len(path), -len(path), i, path[::-1]))
        best = min((round(s, 9), n, i, p) for s, n, i, p in found)
        assert sorted(got[t]) == list(enumerate(best[3]))


def test_chat_plans(spark):
    """Plans don't grow with the depth of trees: all tables of ancestors are one scan."""
    scans = []
    for n in (3, 300):
        rows = [("t", i, i - 1 if i else None, 0.5) for i in range(n)]
        out = chat.paths(spark.createDataFrame(rows, "tree string, id long, parent long, score double"))
        scans.append(out._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        assert sorted((r.depth, r.id) for r in out.collect()) == [(i, i) for i in range(n)]
    assert scans == [2, 2]


def test_chat_odd(spark):
    kind = "conv_id long, turn long, role string, text string, id int"
    rows = [(None, 0, "user", "a", 1), (None, None, None, None, 1), (1, 0, "assistant", "", 1), (1, 0, "assistant", "", 1)]
    out = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.report(spark.createDataFrame(rows, kind)).collect()}
    assert out == {None: (2, 0), 1: (2, 0), -7: (2, 21)}
    assert [r.conv_id for r in chat.report(spark.createDataFrame([], kind)).collect()] == [-7]


def varied(rng, n_base, n, copies, changed):
    """Lines of n words, copied, a part of the words of some changed."""
    word = lambda: rng.choice("abcdefgh") + rng.choice("tuvwxyz") + rng.choice("abcdefgh")
    base = [[word() for _ in range(rng.randint(1, n))] for _ in range(n_base)]
    lines = [" ".join(word() if rng.random() < rng.choice((0, 0, changed)) else w for w in x) for x in base * copies]
    rng.shuffle(lines)
    return lines


@pytest.mark.parametrize(("hub_rows", "percent"), [(None, 80), (1, 80), (8, 60)])
def test_lines(spark, hub_rows, percent):
    """Against all pairs, with tokens in one part and in several: near copies, sets just below the threshold, ids out of order."""
    rng = random.Random(5)
    lines = varied(rng, 40, 14, 8, 0.15) + varied(rng, 6, 400, 4, 0.08)
    rows = [(i if i else None, "\n".join(lines[i * 6 : i * 6 + 6])) for i in range(58)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    gone = line_dedup.removed(docs, hub_rows=hub_rows, percent=percent).collect()
    rid = {r.doc_id: r.rid for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid")).collect()}
    got = {r.rid: r.removed for r in gone}
    assert [got.get(rid[i], []) for i, _ in rows] == line_dedup.brute_force(rows, percent)


def test_lines_without_an_earlier_match(spark):
    """A later line that links two others does not make the second of them a later match."""
    a = [f"w{i}" for i in range(12)]
    rows = [(0, " ".join(a)), (1, " ".join(a[2:] + ["x", "y"])), (2, " ".join(a[1:] + ["x"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.report(docs).collect()} == {0: 0, 1: 0, 2: 1}


def test_lines_of_string_ids(spark):
    docs = spark.createDataFrame([("a", "one two\nthree"), ("b", "One  TWO\nfour"), (None, "one\ntwo")], "doc_id string, text string")
    assert sorted(r.n_removed for r in line_dedup.report(docs).collect()) == [0, 0, 1]
    assert sorted(r.text for r in line_dedup.dedup(docs).collect())[-1:] == ["one\ntwo"] or line_dedup.dedup(docs).count() == 3


def test_short_lines(spark):
    """Lines of one word or few, and of no word."""
    rows = [(1, "Read more\n\n漢字かな交じりの文"), (2, "\nread  MORE\nRead less"), (3, "漢字かな交じりの文\nbuy now buy now buy now\n \t\nnow buy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.removed_lines for r in line_dedup.report(docs).collect()} == {1: "", 2: "1", 3: "0,3"}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, graph.components(df).collect())) == sorted(map(tuple, graph.components(df, 0).collect()))


def test_lm(spark):
    docs = texts(spark)
    rows = {r.doc_id: r for r in lm.report(docs).collect()}
    for i, held, n, known, total, base in lm.brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()]):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(base)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_substrings(spark):
    rng = random.Random(9)
    prose = lambda n: [f"{rng.choice('abcdefghij')}{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(70)
    fuzzy = passage[:30] + ["changed"] + passage[31:50] + passage[51:]
    docs = [prose(100) + passage + prose(50), prose(30) + fuzzy + prose(90), prose(300), prose(10) + passage]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    found = {(r.doc_id, r.source_doc_id): r for r in substring.report(df).collect()}
    assert {d for d, _ in found} == {1, 3}
    assert (found[3, 0].start, found[3, 0].end, found[3, 0].amiss_words) == (10, 80, 0)
    assert (found[1, 0].start, found[1, 0].end, found[1, 0].amiss_words) == (30, 99, 2)


def test_substrings_two_passages(spark):
    """After a long common passage and a stretch of other words, the passages that follow are still found."""
    rng = random.Random(4)
    prose = lambda n: [f"{rng.choice('abcdefghij')}{rng.randrange(10**6)}" for _ in range(n)]
    long, short = prose(500), prose(80)
    docs = [long + prose(100) + short, long + prose(90) + short]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    assert sorted((r.start, r.end, r.source_start) for r in substring.report(df).collect()) == [(0, 500, 0), (590, 670, 600)]


def test_substrings_recall(spark):
    """Passages with every eighth word, or a tenth of the words at random, changed are all found."""
    rng = random.Random(12)
    word = lambda: f"{rng.choice('abcdefghij')}{rng.randrange(10**6)}"
    docs = []
    for k in range(60):
        passage = [word() for _ in range((60, 100, 200)[k % 3])]
        every = set(range(4, len(passage), 8)) if k % 2 else set(rng.sample(range(len(passage)), len(passage) // 10))
        docs += [[word() for _ in range(30)] + x + [word() for _ in range(30)] for x in (passage, [word() if i in every else x for i, x in enumerate(passage)])]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    found = {(r.doc_id, r.source_doc_id) for r in substring.report(df).collect()}
    assert found == {(2 * k + 1, 2 * k) for k in range(60)}


def test_substrings_pieces(spark):
    """A passage whose pieces stand in earlier texts, too short each, and copies of a text reworded too much are found."""
    rng = random.Random(6)
    prose = lambda n: [f"{rng.choice('abcdefghij')}{rng.randrange(10**6)}" for _ in range(n)]
    whole, base = prose(120), prose(100)
    reworded = [prose(1)[0] if i % 6 in (0, 1) else x for i, x in enumerate(base)]
    docs = [prose(40) + x + prose(40) for x in (whole[:47], whole[37:84], whole[74:], whole, whole, base, reworded, reworded)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    assert {(r.doc_id, r.start, r.end, r.source_doc_id) for r in substring.report(df).collect()} == {(4, 40, 160, 3), (7, 40, 140, 6)}


def test_suffix_filter():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(2))
        differ = len(np.setxor1d(x, y))
        assert setjoin.differ_at_least(x, y) <= differ
        assert setjoin.similar(x, y, 80) == (100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)))
