"""Quality rules as weak supervision: rules vote good or bad or abstain, expectation-maximisation finds how often each is right,
and the posterior probability of good decides.

DataFrame functions only. Features are array expressions over one row, so that no row of words is ever shuffled; what is counted
over the corpus are vote patterns, at most 3 to the number of rules.

Defined results: null and empty texts have no words and lines and zero features (and so fail the base rule); repeated rows get
equal results each; columns of the documents named as one of the results are replaced by features and judged, and kept by keep_good;
other extra columns are left alone; an empty table gives an empty one (the accuracies are then the first guesses).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import stash

_SPACE = " \t\n\x0b\f\r"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\"
_NS = "__q_"


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of FEATURES.

    n_repeat_words: with (hash, place) of each 3-word window sorted, windows found twice or more stand beside their equals; the
    words they cover are counted from the gaps between their places.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w, s, q, lines = (f"{_NS}{x}" for x in ("words", "windows", "places", "lines"))
    trimmed = F.btrim(t, F.lit(_SPACE))
    df = docs.withColumns({w: F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.expr("cast(array() as array<string>)")), lines: F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")})
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(t, _SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_ends": (F.length(t) - F.length(F.translate(t, ".!?", ""))).cast("long"),
        "n_marks": (F.length(t) - F.length(F.translate(t, _MARKS, ""))).cast("long"),
        "n_digits": (F.length(t) - F.length(F.translate(t, "0123456789", ""))).cast("long"),
        s: F.sort_array(F.slice(F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))),
    }).drop(lines, w)
    same = lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"])
    df = df.withColumn(q, F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))).drop(s)
    gaps = F.transform(q, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - p, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)).drop(q)


FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ends", "n_marks", "n_digits", "n_repeat_words"]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes bad (-1) where bad holds, else good (1) where good holds, else abstains (0)."""

    name: str
    bad: str
    good: str = "false"


#: Few rules vote good: what junk passes as easily as prose says nothing for a text.
RULES = [
    Rule("length", "n_words < 50"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("marks", "2 * n_marks > n_words", "4 * n_marks <= n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 20 * n_words"),
    Rule("sentences", "n_ends = 0 or 2 * n_ends > n_words", "n_ends * 100 >= n_words and n_ends * 4 <= n_words"),
    Rule("digits", "10 * n_digits > word_chars"),
]


def pattern(rules: list[Rule]) -> Column:
    """The votes of a row as one number in base 3; bad, abstaining, good are 0, 1, 2."""
    votes = [F.when(F.expr(r.bad), 0).when(F.expr(r.good), 2).otherwise(1) * 3**k for k, r in enumerate(rules)]
    out = votes[0]
    for x in votes[1:]:
        out = out + x
    return out.cast("int")


def votes_of(p: int, n: int) -> list[int]:
    return [p // 3**k % 3 - 1 for k in range(n)]


@dataclass
class LabelModel:
    """accuracy[k]: how often rule k is right when it votes, on rows that are good, and on those that are bad."""

    prior: float = 0.8
    on_good: list[float] = field(default_factory=list)
    on_bad: list[float] = field(default_factory=list)

    def posterior(self, votes: list[int]) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        for v, g, b in zip(votes, self.on_good, self.on_bad, strict=True):
            if v:
                odds += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def fit(counts: dict[int, int], n: int, *, steps: int = 50, least: float = 0.55, most: float = 0.98) -> LabelModel:
    """Expectation-maximisation over counts of vote patterns. Accuracies stay in [least, most]: a rule is taken to know something."""
    model = LabelModel(on_good=[0.9] * n, on_bad=[0.7] * n)
    rows = [(votes_of(p, n), c) for p, c in sorted(counts.items())]
    total = sum(c for _, c in rows)
    for _ in range(steps if total else 0):
        right, seen, good = [[1.8, 1.4] for _ in range(n)], [[2.0, 2.0] for _ in range(n)], 0.0
        for votes, c in rows:
            p = model.posterior(votes)
            good += c * p
            for k, v in enumerate(votes):
                if v:
                    seen[k][0] += c * p
                    seen[k][1] += c * (1 - p)
                    right[k][0 if v > 0 else 1] += c * (p if v > 0 else 1 - p)
        model = LabelModel(min(0.9, max(0.5, good / total)), *([min(most, max(least, right[k][y] / seen[k][y])) for k in range(n)] for y in (0, 1)))
    return model


def learn(rows: DataFrame, rules: list[Rule] = RULES) -> LabelModel:
    """rows: with a column pattern. At most 3 ** len(rules) counts come to the driver."""
    return fit({r[0]: r[1] for r in rows.groupBy("pattern").count().collect()}, len(rules))


def posterior(model: LabelModel, rules: list[Rule] = RULES) -> Column:
    """The probability that a row is good, from its pattern: log odds summed over the votes."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, (g, b) in enumerate(zip(model.on_good, model.on_bad, strict=True)):
        v = F.floor(F.col("pattern") / F.lit(3**k)) % 3
        odds = odds + F.when(v == 2, math.log(g / (1 - b))).when(v == 0, math.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, *, text: str = "text", rules: list[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """docs with FEATURES, base_failed, quality (posterior) and kept. Texts are read once; the table with features is written and reread."""
    rows = stash(features(docs, text).withColumn("pattern", pattern(rules)), "quality")
    quality = posterior(learn(rows, rules), rules)
    return rows.withColumns({"base_failed": base_failed(), "quality": quality}).drop("pattern").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def report(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", F.col("text"))
    rows = stash(features(own).withColumn("pattern", pattern(RULES)).drop("text"), "quality")
    model = learn(rows)
    rows = rows.withColumns({"base_failed": base_failed(), "quality": posterior(model)})
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), "quality")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name of ours clashes
    kept = judged(numbered, text=f"c{names.index(text)}").filter("kept")
    return kept.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(names)])


def brute_force(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); for tests."""
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)
