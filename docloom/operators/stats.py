"""Usage statistics over the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.operators import entities, parent, relations
from docloom.operators.chunking import semantic_array


def performance(log: DataFrame) -> DataFrame:
    """Totals of a log with ``seconds`` and ``cached``; the mean covers executed queries."""
    hits = F.coalesce(F.sum(F.col("cached").cast("long")), F.lit(0))
    return log.agg(
        F.count("*").alias("total_queries"),
        F.round(F.coalesce(F.avg(F.when(~F.col("cached"), F.col("seconds"))), F.lit(0.0)), 3).alias("average_response_time"),
        hits.alias("cache_hits"),
        F.round(hits / F.greatest(F.count("*"), F.lit(1)), 6).alias("cache_hit_rate"),
    )


def running_mean(log: DataFrame, unit: str = "hour") -> DataFrame:
    """Mean response time of everything up to each time unit.

    The log is aggregated per unit first; the running window then sees one row per unit
    of time, whatever the number of queries.
    """
    done = log.where(~F.col("cached"))
    units = done.groupBy(F.date_trunc(unit, "ts").alias("period")).agg(
        F.count("*").alias("queries"), F.sum("seconds").alias("seconds")
    )
    so_far = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return units.select(
        "period",
        "queries",
        F.sum("queries").over(so_far).alias("total_queries"),
        F.round(F.sum("seconds").over(so_far) / F.sum("queries").over(so_far), 4).alias("average_response_time"),
    )


def _top_labels(rows: DataFrame, id_col: str, label: str, n: int, names: tuple[str, str]) -> DataFrame:
    """Total and the ``n`` most frequent labels of each document as ``label=count`` text."""
    counted = rows.groupBy(id_col, label).agg(F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(label).alias("label"))))
    text = F.array_join(
        F.transform(F.slice(ordered, 1, n), lambda x: F.concat_ws("=", x["label"], (-x["o"]).cast("string"))), ","
    )
    return counted.groupBy(id_col).agg(F.sum("n").alias(names[0]), text.alias(names[1]))


def ingest_statistics(docs: DataFrame, id_col: str, dictionary=rules.ENTITY_TERMS, n: int = 10) -> DataFrame:
    """Chunks, entities and relations of each document with the most frequent types.

    Labels are few per document, so counts are small before they meet.
    """
    text = F.col("text")
    base = docs.select(
        id_col, F.size(semantic_array(text)).cast("long").alias("chunks")
    )
    found = entities.entities(docs.select(id_col, "text"), dictionary=dictionary, context=False).select(id_col, "label")
    links = relations.pattern_relations(docs.select(id_col, "text"), context=False).select(id_col, "relation")
    e = _top_labels(found, id_col, "label", n, ("entities", "top_entities"))
    r = _top_labels(links, id_col, "relation", n, ("relations", "top_relations"))
    return (
        base.join(e, id_col, "left")
        .join(r, id_col, "left")
        .fillna(0, ["entities", "relations"])
        .fillna("", ["top_entities", "top_relations"])
    )


def collection_analysis(docs: DataFrame, id_col: str, dictionary=rules.ENTITY_TERMS) -> DataFrame:
    """``part, section, key, value``: documents, entities, relations and hierarchy."""
    found = entities.entities(docs.select(id_col, "text"), dictionary=dictionary, context=False)
    links = relations.pattern_relations(docs.select(id_col, "text"), context=False)
    tops = parent.parents(docs, id_col)
    shape = parent.hierarchy_stats(tops, parent.children(tops))
    total = docs.agg(F.count("*").cast("double").alias("value")).select(
        F.lit("documents").alias("part"), F.lit("total").alias("section"), F.lit("documents").alias("key"), "value"
    )
    hierarchy = shape.select(
        F.lit("hierarchy").alias("part"),
        F.coalesce("document_type", F.lit("total")).alias("section"),
        F.expr(
            "stack(4, 'parent_documents', double(parent_documents), 'child_chunks', double(child_chunks), "
            "'average_chunks', double(average_chunks), 'largest_document', double(largest_document))"
        ).alias("key", "value"),
    )
    hierarchy = hierarchy.where((F.col("section") == "total") | (F.col("key") != "largest_document"))

    def part(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("part"), "section", "key", F.col("value").cast("double").alias("value"))

    return (
        total.unionByName(part("entities", entities.entity_summary(found)))
        .unionByName(part("relations", relations.relation_statistics(links)))
        .unionByName(hierarchy)
    )
