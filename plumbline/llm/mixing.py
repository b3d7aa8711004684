"""Mixing sources to target weights.

Each source gets a share of a budget of words. What its target holds of complete epochs, every document of it is taken that
often; the rest is filled by weighted sampling without replacement (Efraimidis and Spirakis): the document with the least
-ln(u) / quality comes first, u being a hash of its id, and documents are taken in that order until their sizes sum up to the
rest. The last one is taken if the sum comes nearer to the rest with it than without it.

A source may hold a third of all rows, so no source is sorted as a whole. Keys are cut into ranges; sums by source and range
show in which range the budget ends, and only that range is sorted. Its cut is a fixed function of the key.

Defined results: a null text has size 0; null is a source of its own, the last; an empty table gives an empty one; rows with the
same id are documents of their own (their order among equals does not matter, as only their sizes count); quality that is null
or not above 0 counts as the least; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.scratch import broadcast_upto, stash

#: Ranges of keys of a source; the one in which the budget ends is sorted in one task.
RANGES = 4096
#: Sources up to which the plan of the mix (one row a source) is broadcast; more are joined by shuffling.
BROADCAST_SOURCES = 10_000
LEAST_QUALITY = 1e-3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """The weight of a document: 1 for text without symbols, less the more of them it has for each word."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.try_divide(size.cast("double"), (size + symbols).cast("double")), F.lit(1.0))


def key_of(doc_id: Column, quality: Column, seed: str) -> Column:
    """-ln(u) / quality, u from 48 bits of a hash of the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return -F.log(u) / F.greatest(F.coalesce(quality, F.lit(LEAST_QUALITY)), F.lit(LEAST_QUALITY))


def targets(sizes: DataFrame, weights: list[float], share: float, most_epochs: float) -> DataFrame:
    """target of each source: share of the sum of all sizes, divided by weight, none above most_epochs times its source's size.

    sizes: source, source_size; one row a source. Sources by code point, null last, take the weights in turn. With r = (what it may
    have at most) / weight, sources are full in the order of r: the first k are, where k is the least number for which what is left,
    by weight, is not above the next r.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("most", F.lit(float(most_epochs)) * F.col("source_size"))
    upward = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = upward.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({
        "total": F.lit(float(share)) * F.sum("source_size").over(every),
        "full": F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # The level at which the first source that is not full, and all after it, get their weight's part.
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    s = s.withColumn("open", F.col("level") <= F.col("most") / F.col("weight"))
    at = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("full"))).over(every)
    return s.select("source", "source_size", F.least(F.col("most"), F.coalesce(at, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", size: Column, quality: Column, weights: list[float], share: float = 1.5, most_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words that the mix takes of the document, repeats counted)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), quality.alias("quality"))
    key = key_of(F.col("doc_id"), F.col("quality"), seed)
    own = own.select("doc_id", "source", "size", key.alias("key"))
    # Keys of weight 1 fall evenly on these ranges; any weight keeps their order.
    own = stash(own.withColumn("range", F.floor(F.lit(float(RANGES)) * (1 - F.exp(-F.col("key")))).cast("int")), "mix-sizes")
    by_range = stash(own.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    plan = targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(0).cast("long"))
    plan = stash(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    # Ranges below the one where the sum passes the rest are taken, those above are not.
    sums = by_range.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("p.source", "range", "range_size", "rest")
    sums = sums.withColumn("below", F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size"))
    edge = sums.filter((F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("below") + F.col("range_size"))).groupBy("source").agg(F.min("range").alias("edge"), F.min("below").alias("below"))
    plan = stash(plan.alias("p").join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left").select("p.*", F.coalesce("edge", F.lit(RANGES + 1)).alias("edge"), "below"), "mix-plan")
    every = own.alias("d").join(broadcast_upto(plan, BROADCAST_SOURCES).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.doc_id", "d.size", "d.source", "d.key", "d.range", "p.source_size", "p.target", "p.epochs", "p.rest", "p.edge", "p.below")
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = every.filter("range = edge").withColumn("sum", F.col("below") + F.sum("size").over(in_order))
    before = F.col("sum") - F.col("size")
    nearer = (F.col("sum") <= F.col("rest")) | ((before <= F.col("rest")) & (F.col("sum") - F.col("rest") < F.col("rest") - before))
    columns = ["doc_id", "size", "source", "source_size", "target"]
    once = every.filter("range <> edge").select(*columns, ((F.col("epochs") + (F.col("range") < F.col("edge")).cast("long")) * F.col("size")).alias("taken"))
    return once.unionByName(at_edge.select(*columns, ((F.col("epochs") + nearer.cast("long")) * F.col("size")).alias("taken")))


def mix_documents(docs: DataFrame) -> DataFrame:
    """All documents, weights 3, 1, 2 in turn, 150 % of all words, no source above 2 epochs; quality from the text."""
    text = F.col("text")
    mixed = mix(docs, size=size_of(text), quality=quality_of(text, size_of(text)), weights=[3.0, 1.0, 2.0])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The same mix over a table with doc_id, source, text; the names of CTEs are free to be prefixed.
def mix_sql(table: str) -> str:
    return rf"""
    WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                      length(text) - length(translate(text, '#*$%&|<>', '')) AS symbols FROM {table}),
    k AS (SELECT doc_id, source, size,
                 -ln((('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:12])::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)
                 / greatest(coalesce(CASE WHEN size + symbols > 0 THEN size::DOUBLE / (size + symbols)::DOUBLE END, 1.0::DOUBLE), 0.001::DOUBLE) AS key FROM s),
    n AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
    w AS (SELECT source, source_size, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS most FROM n),
    l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
                     - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
                 coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fulls FROM w),
    t AS (SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, fulls) FROM l WHERE level <= most / weight), 'inf'::DOUBLE) * weight) AS target FROM l),
    c AS (SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
                 sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
          FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
    r AS (SELECT *, target - epochs * source_size AS rest FROM c)
    SELECT doc_id, size, source_size, target,
           ((epochs + (upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size)))::INT) * size)::BIGINT AS taken FROM r"""
