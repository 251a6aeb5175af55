"""Mix sources to target weights by weighted fair queueing.

Every source is shuffled and read in passes (epochs). A copy of a document gets a virtual
finish time: the tokens of its source up to and with it, divided by the target of the
source. All copies are range-sorted by that time and cut where the budget is used up, so
at any cut every source has given its share to within one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.llm.ordering import with_position
from armlift.llm.tables import WORD, documents
from armlift.session import stored

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_rank, source_size, target): shares of the total size by weight.

    Sources in code point order, null last, take the weights in turn. No target exceeds
    ``passes`` times the size of its source; what lies above is shared among the others by
    weight until none is above. That water level is found in one pass over the sources
    sorted by capacity per unit of weight: the first source that stays under its capacity
    sets the level for all after it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = ", ".join(f"{w}L" for w in weights)
    ranked = totals.selectExpr(
        "*", "row_number() over (order by source nulls last) - 1 as source_rank"
    ).selectExpr("*", f"element_at(array({listed}), cast(source_rank % {len(weights)} as int) + 1) as weight")
    order = f"order by {passes} * source_size / weight, source_rank"
    before = f"over ({order} rows between unbounded preceding and 1 preceding)"
    levels = ranked.selectExpr(
        "*",
        f"(sum(source_size) over () - {passes} * coalesce(sum(source_size) {before}, 0L))"
        f" / cast(sum(weight) over () - coalesce(sum(weight) {before}, 0L) as double) as level",
        f"row_number() over ({order}) as place",
    )
    under = f"min(case when level * weight <= {passes} * source_size then place end) over ()"
    found = levels.selectExpr("*", f"{under} as first_under").selectExpr(
        "*", "max(case when place = first_under then level end) over () as water"
    )
    return found.selectExpr(
        "source",
        "source_rank",
        "source_size",
        f"if(place < first_under, cast({passes} * source_size as double), water * weight) as target",
    )


def mix(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES, seed: int = 1
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` (times the mix takes the row) to every row.

    Input has doc_id, source and size (bigint, not null). Rows are shuffled inside their
    source by a hash of doc_id; rows that repeat are separate documents. Rows of size 0 are
    never taken. An empty table stays empty. Further columns are dropped, as the caller
    joins on the key it needs.
    """
    rows = stored(
        sizes.selectExpr("doc_id", "source", "size", f"md5(concat_ws(':', doc_id, '{seed}')) as shuffle")
    )
    targets = source_targets(rows, weights, passes)
    # one row per source, narrow; the join follows the sizes that Spark measures
    known = rows.join(targets.withColumnRenamed("source", "_source"), F.expr("source <=> _source")).drop("_source")
    queued = with_position(known, ["shuffle", "doc_id", "size"], "size", "source_rank").selectExpr(
        "doc_id", "size", "source_rank", "source_size", "target", "_p_position as turn", "_p_total as total_before"
    )
    copies = queued.selectExpr("*", f"explode(sequence(0, {passes - 1})) as pass").selectExpr(
        "*", "try_divide(pass * source_size + total_before + size, target) as finish"
    )
    budget = copies.selectExpr(
        *[c for c in copies.columns if c != "total_before"], "if(size > 0 and finish is not null, size, 0L) as asks"
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    line = with_position(budget, ["finish is null", "finish", "source_rank", "turn", "pass"], "asks")
    took = f"count_if(asks > 0 and _p_total + asks <= {total})"
    return line.groupBy("source_rank", "turn").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.expr(took).alias("copies"),
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of the text, 0 for null."""
    return docs.selectExpr("doc_id", "source", f"cast(coalesce(regexp_count(text, '{WORD}'), 0) as bigint) as size")


def op7_mix_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to 100 % of their words, sources weighted 1, 2, 3 in turn, at most three passes."""
    return mix(word_counts(documents(spark, folder))).selectExpr(
        "doc_id", "size", "source_size", "target", "size * copies as taken"
    )
