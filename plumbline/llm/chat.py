"""Chat formatting of reply trees, with DataFrame functions only.

Messages know their parent. Self-joins that double the distance each time (parent, grandparent, fourth ancestor ...) give every
message its root, its depth and the score of the path down to it, in as many joins as the logarithm of the depth. The leaves of
a tree are ranked by the score of their path; from the chosen leaf the same tables of ancestors mark its path, and the messages
on it become one conversation. Texts take no part in the self-joins.

Defined results: a null text or role is empty; a message whose parent does not exist is a root; messages on a cycle have no root
and no path, so they are left out; of repeated (tree, message) rows the least by (parent, role, text) counts; a null tree
is a tree like any other, and messages without an id are left out; ties of scores go to the deeper, then the least leaf; empty
tables give empty ones; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.scratch import stash, together

#: The template: <|turn|>role<|text|>text<|end|>, turn after turn.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a text must not hold when formatted: ours and those of common templates.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


def escape(text: Column) -> Column:
    r"""Reversible: \ becomes \\, and control strings get a \ after their first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROL:
        out = F.replace(out, F.lit(x), F.lit(f"{x[0]}\\{x[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for x in CONTROL:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


def paths(messages: DataFrame) -> DataFrame:
    """The best root-to-leaf path of each tree: tree, path_score, depth (0 at the root) and id of the messages on it.

    messages: tree, id, parent (null at the root), score double. Joins go on until no message finds its root any more.
    """
    m = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = m.select(F.col("tree").alias("t2"), F.col("id").alias("i2"))
    m = m.join(ids, (F.col("tree") == F.col("t2")) & (F.col("parent") == F.col("i2")), "left")
    # up: the ancestor 2**k above, if any; depth and sum: over the messages from here to below it. Table k holds the messages that
    # found no root before, so tables shrink as paths end. All of them are read as one, so that plans stay small, however many there are.
    first = m.select("tree", "id", F.col("i2").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("sum"), F.lit(0).alias("k"))
    table, found, going = _stash_and_count(first, "chat-0", "up is null", "up is not null")
    jumps = [table]
    # Every round finds the roots of messages up to twice as deep; one that finds none has only cycles left.
    while found and going:
        k = len(jumps)
        a, b = jumps[-1].filter("up is not null").alias("a"), together(*jumps).filter(f"up is null or k = {k - 1}").alias("b")
        j = a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.up") == F.col("b.id")))
        j = j.select("a.tree", "a.id", F.col("b.up").alias("up"), (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.sum") + F.col("b.sum")).alias("sum"), F.lit(k).alias("k"))
        table, found, going = _stash_and_count(j, f"chat-{k}", "up is null", "up is not null")
        jumps.append(table)
    rooted = together(*jumps).filter("up is null")  # all but messages on or below a cycle
    parents = jumps[0].filter("up is not null").select("tree", F.col("up").alias("id")).distinct()
    best, branched = _stash_and_count(_best(rooted.join(parents, ["tree", "id"], "left_anti")), "chat-best", "leaves > 1")
    # All messages of a tree with one leaf are on its path.
    whole = rooted.select("tree", "id", "depth").join(best.filter("leaves = 1").select("tree", "path_score"), "tree")
    marked = []
    if branched:
        marked = [best.filter("leaves > 1").select("tree", F.col("leaf").alias("id"), "depth", "path_score")]
        # Of several leaves, the best one marks its ancestors: each table, the longest jumps first, doubles what is marked.
        for k, j in reversed(list(enumerate(jumps))):
            steps = j.filter("up is not null").select("tree", "id", "up")
            up = reduce(DataFrame.unionByName, marked).join(steps, ["tree", "id"])
            marked.append(stash(up.select("tree", F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth"), "path_score"), f"chat-path-{k}"))
    return reduce(DataFrame.unionByName, [whole, *marked]).withColumn("depth", F.col("depth") - 1)


def _stash_and_count(df: DataFrame, name: str, *conditions: str) -> tuple:
    """df by stash, and for each condition a number over 0 if any row meets it, counted as rows are written (in tasks run again, twice)."""
    seen = Observation()
    out = stash(df.observe(seen, *(F.count(F.when(F.expr(x), 1)).alias(f"n{i}") for i, x in enumerate(conditions))), name)
    return out, *(seen.get[f"n{i}"] for i in range(len(conditions)))


def _best(leaves: DataFrame) -> DataFrame:
    """The leaf with the highest mean score; then the deepest, then the least id: tree, leaf, depth, path_score, leaves (how many there are)."""
    rank = F.struct((-F.col("sum") / F.col("depth")).alias("s"), (-F.col("depth")).alias("d"), F.col("id").alias("id"))
    best = leaves.groupBy("tree").agg(F.min(rank).alias("r"), F.count("*").alias("leaves"))
    return best.select("tree", F.col("r.id").alias("leaf"), (-F.col("r.d")).alias("depth"), (-F.col("r.s")).alias("path_score"), "leaves")


def format_trees(messages: DataFrame) -> DataFrame:
    """One conversation for each tree: tree, path_score, n_turns, formatted, and loss, the [from, to) places (code points) of assistant texts in it.

    messages: tree, id, parent, score, role, text.
    """
    own = messages.withColumn("tree", F.struct("tree"))  # so that null trees meet in joins
    one = own.filter("id is not null").groupBy("tree", "id").agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")).alias("m")).select("tree", "id", "m.*")
    one = stash(one, "chat-messages")
    chosen = paths(one).select("tree", "id", "depth", "path_score")
    turns = chosen.join(one.select("tree", "id", "role", "text"), ["tree", "id"])
    turns = turns.groupBy("tree").agg(F.first("path_score").alias("path_score"), F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return formatted(turns.withColumn("tree", F.col("tree.tree")))


def formatted(turns: DataFrame) -> DataFrame:
    """Adds n_turns, formatted and loss to rows with turns, an array of (depth, role, text), and drops turns."""
    head = F.transform("turns", lambda x: F.struct(F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT)).alias("head"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("loss")))
    df = turns.withColumn("parts", head).withColumn("n_turns", F.size("turns").cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))
    length = lambda x: F.length(x).cast("long")
    step = lambda acc, x: F.struct((acc["at"] + length(x["head"]) + length(x["body"]) + len(END)).alias("at"), F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + length(x["head"])).alias("start"), (acc["at"] + length(x["head"]) + length(x["body"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"))
    df = df.withColumn("loss", F.aggregate("parts", start, step)["spans"])
    df = df.withColumn("formatted", F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""))
    return df.drop("turns", "parts")


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds turns, an array of (role, text) parsed from formatted, and loss_text, the unescaped text under loss."""
    parts = F.slice(F.split("formatted", r"<\|end\|>"), F.lit(1), F.col("n_turns").cast("int"))
    turn = lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"), unescape(F.substring_index(x, TEXT, -1)).alias("text"))
    under = F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return conversations.withColumns({"turns": F.transform(parts, turn), "loss_text": F.array_join(under, "")})


def linear(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as reply trees with one branch: each row answers the one before it, by (turn, role, text)."""
    rows = conversations.select(F.col(conv_id).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("id", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


_EXTRA = "</s>[INST] ok [/INST]"


def report(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_EXTRA).alias("text"))
    back = read_back(format_trees(linear(rows.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


REPORT_SQL = f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '{_EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{_EXTRA}')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
           sum(length('{TURN}') + length('{TEXT}') + length('{END}') + length({escape_sql("role")}) + length({escape_sql("text")}))::BIGINT AS formatted_chars
    FROM r GROUP BY conv_id"""


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
