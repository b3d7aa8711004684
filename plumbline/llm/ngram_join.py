"""N-gram Jaccard join of documents: word shingles, five words, similarity 0.8; see setjoin.

Defined results: null and empty texts and texts without words have an empty set, linked with nothing, and are their own component;
a text of fewer than five words is one shingle; equal sets are linked whatever the texts; repeated rows get equal rows each; a
null id is never the name of a component unless all its documents have none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import setjoin
from plumbline.llm.scratch import broadcast_upto, stash


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, rid, n_shingles, component_id (the least doc_id reachable by links) and comp (its own name) of each row."""
    found = setjoin.classes(setjoin.with_identity(docs, doc_id, text), setjoin.shingle_sets(n), percent=percent)
    items = found.items
    reps = items.filter("n > 0").groupBy("node").agg(F.min("doc").alias("least"))
    labelled = stash(reps.join(found.comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled")
    least = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_node = stash(labelled.join(least, "comp").select("node", "component_id", "comp"), "by-node")
    linked = items.filter("n > 0").join(by_node, "node").select("doc", "rid", "n", "component_id", "comp")
    alone = items.filter("n = 0").select("doc", "rid", "n", F.col("doc").alias("component_id"), F.col("rid").alias("comp"))
    return linked.unionByName(alone).select(F.col("doc").alias("doc_id"), "rid", F.col("n").cast("long").alias("n_shingles"), "component_id", "comp")


def report(docs: DataFrame) -> DataFrame:
    return join(docs).drop("rid", "comp")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the least doc_id (of repeated rows, any one: they are equal in id and text)."""
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    found = join(own, doc_id=i, text=t)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    first = found.groupBy("comp", F.col("n_shingles") > 0).agg(least.alias("m")).select(F.col("m.rid").alias("rid"))
    # Of rows that are repeated (and only those) one stays.
    repeated = found.groupBy("rid").agg(F.count("*").alias("copies")).filter("copies > 1")
    first = stash(first.join(repeated, "rid", "left"), "first")
    rows = own.withColumn("rid", F.xxhash64(i, t)).join(broadcast_upto(first, setjoin.BROADCAST_IDS), "rid")
    if not first.filter("copies is not null").isEmpty():
        rows = rows.filter("copies is null").unionByName(rows.filter("copies is not null").dropDuplicates(["rid"]))
    return rows.select(*[F.col(f"c{k}").alias(x) for k, x in enumerate(names)])


#: For small tables: all pairs with a common shingle.
SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)"""
