"""Extraction responses derived from the events table: one JSON document per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import spread
from riskloom.sources.star_schema import read_table


def _text(value: Column | str) -> Column:
    return F.col(value).cast("string") if isinstance(value, str) else value.cast("string")


def event_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four entities and three relationships per event; some events carry a deliberate defect."""
    user, kind, value = F.col("user_id"), F.col("event_type"), F.col("value")
    levels = F.array(*[F.lit(v) for v in ("LOW", "MEDIUM", "HIGH", "CRITICAL")])
    types = F.array(*[F.lit(v) for v in ("PREVENTIVE", "DETECTIVE", "CORRECTIVE")])
    code = F.concat(F.lit("FM-"), _text(user))
    day = F.date_format("ts", "yyyy-MM-dd")
    section = F.when((kind == "error") & (value > 50), "").otherwise(F.concat(F.lit("Sec "), F.col("event_id") % 5))
    control = F.when(value <= 150, F.concat(F.lit("control "), _text(user)))
    risk_label = F.when((kind == "purchase") & (value > 100), "Hazard").otherwise("Risk")
    source = F.struct(section.alias("section"), (F.col("event_id") % 9 + 1).alias("pageNumber"),
                      F.array(F.col("event_id") % 9 + 1, F.col("event_id") % 9 + 4).alias("lineRange"))

    def entity(label: Column, confidence: Column, **properties: Column) -> Column:
        entries = F.map_filter(F.create_map(*[c for k, v in properties.items() for c in (F.lit(k), _text(v))]),
                               lambda k, v: v.isNotNull())
        return F.struct(label.alias("entityType"), entries.alias("properties"), confidence.alias("confidence"),
                        source.alias("sourceReference"))

    def relationship(start: Column, end: Column, rel_type: Column) -> Column:
        return F.struct(start.alias("from"), end.alias("to"), rel_type.alias("type"), F.lit(0.9).alias("confidence"),
                        F.create_map(F.lit("seen"), kind).alias("properties"), source.alias("sourceReference"))

    entities = F.array(
        entity(F.lit("FailureMode"), F.when(value < 2, 0.65).otherwise(0.9), code=code,
               description=F.concat(kind, F.lit(" failure")), severity=user % 10 + 1),
        entity(risk_label, F.lit(0.8), level=F.element_at(levels, (user % 4 + 1).cast("int")),
               description=F.concat(kind, F.lit(" risk"))),
        entity(F.lit("Control"), F.lit(0.85), controlType=F.element_at(types, (user % 3 + 1).cast("int")), description=control),
        entity(F.lit("Audit"), F.lit(0.95), auditDate=day),
    )
    relationships = F.array(
        relationship(F.concat(F.lit("FailureMode:"), code), F.concat(F.lit("Risk:"), kind, F.lit(" risk")),
                     F.when((kind == "view") & (value > 120), "BREAKS").otherwise("IMPLIES")),
        relationship(F.concat(F.lit("Control:control "), _text(user)),
                     F.when((kind == "signup") & (value > 80), F.lit("FailureMode:none")).otherwise(F.concat(F.lit("FailureMode:"), code)),
                     F.when((kind == "click") & (value > 90), "IMPLIES").otherwise("MITIGATES")),
        relationship(F.concat(F.lit("Audit:"), day), F.concat(F.lit("Document:doc-"), _text("event_id")), F.lit("USES")),
    )
    return spread(read_table(spark, sf_dir, "events")).select(
        F.concat(F.lit("doc-"), _text("event_id")).alias("document_id"),
        F.concat(F.lit("model-"), user % 3).alias("model_used"), F.col("ts").alias("extracted_at"),
        F.to_json(F.struct(entities.alias("entities"), relationships.alias("relationships"))).alias("response"))


def stored_failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure modes already in the graph, as (id, entity_type, business_key, properties)."""
    texts = F.array(*[F.lit(v) for v in ("error failure", "click failure", "view failure")])
    key = F.col("p_partkey")
    return read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("fm-"), key).alias("id"), F.lit("FailureMode").alias("entity_type"),
        F.concat(F.lit("FM-"), key).alias("business_key"),
        F.create_map(F.lit("code"), F.concat(F.lit("FM-"), key),
                     F.lit("description"), F.element_at(texts, (F.col("p_size") % 3 + 1).cast("int")),
                     F.lit("severity"), (key % 10 + 1).cast("string")).alias("properties"))
