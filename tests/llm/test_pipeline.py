"""The pipeline against a brute-force chain of its stages."""

import random
import re

import corpus_pipeline
import pytest
from plumbline.llm import decontam, line_dedup, quality

WORDS = "the of and to in is on by with river stone winter letter garden paper music silver bridge market window forest doctor island summer village captain morning history teacher kitchen engine harbor".split()


def prose(rng, n):
    out = [rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.3 else "") for _ in range(n)]
    return " ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(out))


def documents(rng):
    """Prose, copies, near copies, repeated lines, passages of the benchmark, junk, nulls, ties and long texts."""
    items = [prose(rng, 30) for _ in range(4)]
    texts = ["\n".join(prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6))) for _ in range(40)]
    texts += [texts[3], texts[4], texts[5].replace("river", "lake"), texts[6].replace("stone", "rock", 1), texts[7] + "\n" + texts[8].split("\n")[0]]
    texts += [prose(rng, 80) + " " + items[0] + " " + prose(rng, 80), prose(rng, 60) + " " + " ".join(items[1].split()[5:20]) + " " + prose(rng, 40)]
    texts += [None, "", "short text", "# $ % & | < > " * 40, "again and again " * 60, "\n".join(prose(rng, 40) for _ in range(300))]
    rows = [(i, x, rng.choice(["a", "b", "c", None]), "en", 7 if x is None else len(x), i % 2, "own") for i, x in enumerate(texts)]
    rows += [rows[11], (None, prose(rng, 90), "a", None, 0, 0, None)]
    return rows, items


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, kept int, rid string"


def chain(rows, items):
    """What is left before mixing, as (doc_id, text, source), by comparing everything with everything."""
    # Quality: features by brute force, votes by the rules in Python, and the same expectation-maximisation over their counts.
    judged = []
    for r in rows:
        t = r[1] or ""
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = quality.brute_force(t)
        f = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
        f |= {"n_lines": sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n")), "n_ends": sum(c in ".!?" for c in t), "n_marks": sum(c in quality._MARKS for c in t), "n_digits": sum(c in "0123456789" for c in t), "false": False}
        votes = [-1 if eval(x.bad.replace(" = ", " == "), {}, f) else 1 if x.good != "false" and eval(x.good.replace(" = ", " == "), {}, f) else 0 for x in quality.RULES]  # noqa: S307
        judged.append((votes, n_words < 50 or 100 * n_repeat_words > 50 * n_words))
    counts = {}
    for votes, _ in judged:
        p = sum((v + 1) * 3**k for k, v in enumerate(votes))
        counts[p] = counts.get(p, 0) + 1
    model = quality.fit(counts, len(quality.RULES))
    docs = [[r[0], r[1], r[2]] for r, (votes, failed) in zip(rows, judged, strict=True) if not failed and model.posterior(votes) >= 0.5]
    assert 30 < len(docs) < len(rows)
    # Lines: repeated rows are one.
    distinct = sorted({(-1 if d[0] is None else d[0], d[1]) for d in docs})
    gone = dict(zip(distinct, line_dedup.brute_force(distinct), strict=True))
    left = []
    for i, t, s in docs:
        out = gone[-1 if i is None else i, t]
        t2 = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out)
        if not out or re.search(r"[^\x20\x09-\x0D]", t2):
            left.append((i, t2, s))
    assert any(gone.values())
    # Near duplicates.
    docs = [(-1 if i is None else i, t, s) for i, t, s in dict.fromkeys(left)]
    sets = []
    for _, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    name = list(range(len(docs)))

    def root(k):
        return k if name[k] == k else root(name[k])

    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    groups = {}
    for k, d in enumerate(docs):
        groups.setdefault(root(k), []).append(d)
    docs = sorted(min(g, key=lambda d: d[0]) for g in groups.values())
    # The benchmark.
    found = decontam.brute_force([t for _, t, _ in docs], [(str(k), x) for k, x in enumerate(items)])
    assert any(n for _, n, _ in found)
    return [d for d, (_, n, _) in zip(docs, found, strict=True) if not n]


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    rows, items = documents(rng)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(str(k), x) for k, x in enumerate(items)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == spark.createDataFrame([], SCHEMA).columns
    want = chain(rows, items)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.source) for r in docs.collect())
    assert got == want
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    sizes = {None if i == -1 else i: len(t.split()) for i, t, _ in want}
    assert {i: r.size for i, r in out.items()} == sizes
    by = {}
    for i, _, s in want:
        by.setdefault(s, []).append(out[None if i == -1 else i])
    total = sum(sizes.values())
    assert sum({r.target for x in by.values() for r in x}) == pytest.approx(min(1.5, 2.0) * total)
    for own in by.values():
        assert {r.source_size for r in own} == {sum(r.size for r in own)} and all(0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_of_odd_rows(spark, tmp_path, stage):
    """An empty table, and one of nulls, through each stage alone."""
    spark.createDataFrame([(None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(None, None, None, None, None, None, None)] * 2 + [(1, "", "", "", 0, 0, "")]):
        out = stage[1](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
        assert len(out) == {"quality_rules": 0, "ngram_join": min(len(rows), 2)}.get(stage[0], len(rows))
