"""Ingestion as a batch job: extraction JSON to validated, resolved, versioned graph rows.

Input: one row per document with ``document_id, model_used, extracted_at, response`` (JSON text).
Stages are plain DataFrames; a document that fails a check is rejected whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.ordering import in_blocks
from riskloom.graph import AuditGraph
from riskloom.operators.records import delete_entities, detach

# Labels whose relationship references carry a business key; others match by label alone.
KEYED_REFERENCES = ("Process", "FailureMode", "Requirement", "Audit", "ProcedureStep")
# Labels looked up for earlier versions; the others are always created.
VERSIONED_LABELS = ("Process", "Audit", "FailureMode", "Requirement", "Incident", "ProcedureStep")
# What ``judged`` adds to a document; none of it goes along with its entities.
JUDGED = ("refs", "valid", "error_count", "first_error", "response_length", "entity_count", "relationship_count", "confidence_avg")


# --- parsing --------------------------------------------------------------------------

def parse_responses(raw: DataFrame) -> DataFrame:
    """Adds the parsed response as ``r``; the row parsers below do so themselves where it is missing."""
    if "r" in raw.columns:
        return raw
    return raw.withColumn("r", F.from_json("response", schemas.EXTRACTION_RESPONSE))


def parse_entities(raw: DataFrame) -> DataFrame:
    """One row per extracted entity; a missing list yields none."""
    rows = parse_responses(raw)
    keep = [c for c in rows.columns if c not in ("r", "response", *JUDGED)]
    return rows.select(*keep, F.posexplode("r.entities").alias("ordinal", "e")).select(
        *keep, "ordinal", F.col("e.entityType").alias("entity_type"), F.col("e.properties").alias("properties"),
        F.col("e.confidence").alias("confidence"), F.col("e.sourceReference.section").alias("section"),
        F.col("e.sourceReference.pageNumber").alias("page_number"), F.col("e.sourceReference.lineRange").alias("line_range"))


def parse_relationships(raw: DataFrame) -> DataFrame:
    """One row per extracted relationship; a missing list yields none. The ``refs`` of a judged document go along."""
    rows = parse_responses(raw)
    keep = [c for c in rows.columns if c not in ("r", "response", *JUDGED) or c == "refs"]
    return rows.select(*keep, F.posexplode("r.relationships").alias("ordinal", "e")).select(
        *keep, "ordinal", F.col("e.from").alias("from_ref"), F.col("e.to").alias("to_ref"),
        F.col("e.type").alias("rel_type"), F.col("e.confidence").alias("confidence"),
        F.col("e.properties").alias("properties"), F.col("e.sourceReference.section").alias("section"),
        F.col("e.sourceReference.pageNumber").alias("page_number"), F.col("e.sourceReference.lineRange").alias("line_range"))


# --- keys --------------------------------------------------------------------------------

Field = Callable[[str], Column]


def _entity(document: str = "document_id") -> Callable[[Column, Column], Field]:
    """Fields of an element of the list of entities, under the names that they have in a row of their own."""
    names = {"entity_type": "entityType", "properties": "properties", "confidence": "confidence"}

    def at(e: Column, ordinal: Column) -> Field:
        own = {"ordinal": ordinal, "document_id": F.col(document), "section": e["sourceReference"]["section"]}
        return lambda name: own[name] if name in own else e[names[name]]

    return at


def _prop(name: str, of: Field = F.col) -> Column:
    value = of("properties")[name]
    return F.when(value != "", value)


def _fallback(of: Field) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", of("document_id"), of("ordinal").cast("string")), 256), 1, 24)


def business_key(of: Field = F.col) -> Column:
    """Key under which relationships of the same document refer to an entity."""
    label, prop, fallback = of("entity_type"), lambda name: _prop(name, of), _fallback(of)
    process = F.concat_ws(":", F.coalesce(of("properties")["name"], F.lit("undefined")), F.coalesce(prop("version"), F.lit("1.0")))
    step = F.concat_ws(":", prop("stepNumber"), prop("processId"))
    risk = F.concat_ws(":", of("properties")["level"], F.coalesce(prop("category"), F.lit("unknown")))
    return (
        F.when(label == "Process", process)
        .when(label.isin("FailureMode", "Requirement", "RootCause", "Incident"), F.coalesce(prop("code"), prop("description"), fallback))
        .when(label == "Audit", F.coalesce(prop("auditDate"), fallback))
        .when(label == "Risk", F.coalesce(prop("code"), prop("description"), risk))
        .when(label == "Control", F.coalesce(prop("code"), prop("name"), prop("description"), fallback))
        .when(label == "Finding", F.coalesce(prop("code"), prop("title"), prop("description"), fallback))
        .when(label == "ProcedureStep", step)
        .otherwise(fallback)
    )


def content_fingerprint() -> Column:
    """Hash of the properties in key order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("properties")))), 256)


# --- validation --------------------------------------------------------------------------

def _errors(*checks: tuple[Column, str]) -> Column:
    found = F.array(*[F.when(failed, F.lit(message)) for failed, message in checks])
    return F.filter(found, lambda e: e.isNotNull())


def entity_errors(of: Field = F.col, min_confidence: float = schemas.MIN_CONFIDENCE) -> Column:
    label = of("entity_type")
    missing = reduce(lambda a, b: a | b, [
        (label == name) & reduce(lambda a, b: a | b, [_prop(p, of).isNull() for p in required])
        for name, required in schemas.REQUIRED_PROPERTIES.items()])
    return _errors(
        (~F.coalesce(label.isin(*schemas.LABELS), F.lit(False)), "invalid entity type"),
        (of("confidence") < min_confidence, "confidence below threshold"),
        (F.coalesce(of("section"), F.lit("")) == "", "missing source section"),
        (missing, "missing required property"),
    )


def validate_entities(entities: DataFrame, min_confidence: float = schemas.MIN_CONFIDENCE) -> DataFrame:
    """Adds ``errors``, empty when the entity is acceptable."""
    return entities.withColumn("errors", entity_errors(F.col, min_confidence))


def _is_document(ref: str | Column) -> Column:
    return F.coalesce((F.col(ref) if isinstance(ref, str) else ref).startswith("Document:"), F.lit(False))


def _label(ref: Column) -> Column:
    return F.when(ref.contains(":"), F.substring_index(ref, ":", 1))


def _reference(of: Field) -> Column:
    """What a reference to an entity has to say: all of it for a label with keys, else the label alone."""
    label = of("entity_type")
    return F.when(label.isin(*KEYED_REFERENCES), F.concat(label, F.lit(":"), business_key(of))).when(~label.contains(":"), label)


def _found(ref: Column, refs: Column) -> Column:
    label = _label(ref)
    return F.coalesce(F.array_contains(refs, F.when(label.isin(*KEYED_REFERENCES), ref).otherwise(label)), F.lit(False))


def _ends(of: Field, refs: Column) -> dict[str, Column]:
    """The labels of both ends and whether both are among ``refs``, the references of the entities of the document."""
    return {"from_label": _label(of("from_ref")), "to_label": _label(of("to_ref")),
            "resolved": _found(of("from_ref"), refs) & _found(of("to_ref"), refs)}


def relationship_errors(of: Field, min_confidence: float = schemas.MIN_CONFIDENCE, strict_reference: bool = False) -> Column:
    """Of a relationship with its ``_ends``."""
    allowed = schemas.RELATIONSHIP_RULES if strict_reference else schemas.RELATIONSHIP_RULES + schemas.EXTENDED_RULES
    triple = F.concat_ws("|", of("from_label"), of("to_label"), of("rel_type"))
    known = F.coalesce(of("rel_type").isin(*schemas.RELATIONSHIP_TYPES), F.lit(False))
    errors = _errors(
        (of("confidence") < min_confidence, "confidence below threshold"),
        (F.coalesce(of("section"), F.lit("")) == "", "missing source section"),
        (~of("resolved"), "unresolved reference"),
        (~known, "invalid relationship type"),
        (of("resolved") & known & ~triple.isin(*["|".join(rule) for rule in allowed]), "relationship not allowed"),
    )
    skip = _is_document(of("from_ref")) | _is_document(of("to_ref"))
    return F.when(skip, F.array().cast("array<string>")).otherwise(errors)


def validate_relationships(relationships: DataFrame, entities: DataFrame,
                           min_confidence: float = schemas.MIN_CONFIDENCE, strict_reference: bool = False) -> DataFrame:
    """Adds ``errors``; references to documents are passed over, they are created implicitly.

    Relationships of judged documents carry the references of their entities; others are joined with them.
    ``strict_reference`` leaves out the documented relationship types that have no rule.
    """
    rows = relationships
    if "refs" not in rows.columns:
        refs = entities.groupBy("document_id").agg(F.collect_set(_reference(F.col)).alias("refs"))
        rows = rows.join(refs, "document_id", "left")
    return rows.withColumns(_ends(F.col, F.col("refs"))).withColumn("errors", relationship_errors(F.col, min_confidence, strict_reference)).drop("refs", "resolved")


def judged(raw: DataFrame) -> DataFrame:
    """Documents with their parsed response ``r`` in place of its text, their verdict and what the log says of them.

    All checks of a document concern itself, so they are made on the lists in its row and nothing is shuffled.
    """
    at, none = _entity(), F.array().cast("array<struct<ordinal:int,errors:array<string>>>")

    names = {"from_ref": "from", "to_ref": "to", "rel_type": "type", "confidence": "confidence"}
    part = lambda e: lambda name: e["sourceReference"]["section"] if name == "section" else e[names[name]]

    rows = parse_responses(raw).withColumn("refs", F.array_distinct(F.transform("r.entities", lambda e, i: _reference(at(e, i)))))
    entities = F.transform("r.entities", lambda e, i: F.struct(i.alias("ordinal"), entity_errors(at(e, i)).alias("errors")))
    with_ends = F.transform("r.relationships", lambda e: F.struct(
        *[part(e)(n).alias(n) for n in (*names, "section")], *[c.alias(n) for n, c in _ends(part(e), F.col("refs")).items()]))
    relationships = F.transform(with_ends, lambda e, i: F.struct(i.alias("ordinal"), relationship_errors(lambda name: e[name]).alias("errors")))
    found = F.filter(F.concat(F.coalesce(entities, none), F.coalesce(relationships, none)), lambda e: F.size(e["errors"]) > 0)
    sure = F.filter(F.transform("r.entities", lambda e: e["confidence"]), lambda c: c.isNotNull())
    total = F.aggregate(sure, F.lit(0.0), lambda a, c: a + c)
    length = lambda column: F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)).cast("bigint")
    return rows.withColumn("_found", found).select(
        *[c for c in rows.columns if c != "response"], (F.size("_found") == 0).alias("valid"),
        F.aggregate("_found", F.lit(0).cast("bigint"), lambda a, e: a + F.size(e["errors"])).alias("error_count"),
        F.get(F.get("_found", F.lit(0))["errors"], F.lit(0)).alias("first_error"), F.length("response").alias("response_length"),
        length("r.entities").alias("entity_count"), length("r.relationships").alias("relationship_count"),
        F.when(F.size(sure) > 0, total / F.size(sure)).alias("confidence_avg"))


def document_verdicts(documents: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(document_id, valid, error_count, first_error): entity errors come before relationship errors."""
    failed = [
        df.filter(F.size("errors") > 0).select(
            "document_id", F.size("errors").alias("n"),
            F.struct(F.lit(stage).alias("stage"), F.col("ordinal"), F.element_at("errors", 1).alias("error")).alias("e"))
        for stage, df in ((0, entities), (1, relationships))]
    found = failed[0].unionByName(failed[1]).groupBy("document_id").agg(
        F.sum("n").cast("bigint").alias("error_count"), F.min("e").alias("first"))
    return documents.select("document_id").join(found, "document_id", "left").select(
        "document_id", F.col("first").isNull().alias("valid"),
        F.coalesce("error_count", F.lit(0)).cast("bigint").alias("error_count"), F.col("first.error").alias("first_error"))


def accepted(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of documents that passed every check."""
    return rows.join(verdicts.filter("valid").select("document_id"), "document_id", "left_semi")


# --- resolution ------------------------------------------------------------------------------

def _own_id(document: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("ent-"), F.substring(F.sha2(F.concat_ws(
        "|", "entity_type", "business_key", document, ordinal.cast("string")), 256), 1, 24))


def _versions(narrow: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds to candidates of versioned labels whether they open a version (``opens``), the id of their version and of the one before.

    Rows go into blocks by key and order. Inside a block windows tell where the content changes and which version a row
    belongs to; one row a block and key carries the last content and version into the blocks after it. Rows are thus dealt
    twice, and only what is needed for the decision.
    """
    keys, order = ["entity_type", "business_key"], ["extracted_at", "document_id", "ordinal"]
    latest = existing.filter("is_latest").groupBy(*keys).agg(F.min(F.struct("id", "fingerprint")).alias("latest"))
    blocks = in_blocks(narrow.select(*keys, *order, F.unhex("fingerprint").alias("content")), keys, order)
    inside, own = Window.partitionBy("_block", *keys).orderBy(*order), F.struct("document_id", "ordinal")
    rows = blocks.withColumns({"head": F.row_number().over(inside) == 1, "tail": F.lead(F.lit(1)).over(inside).isNull(),
                               "before": F.lag("content").over(inside)})
    rows = rows.withColumn("changed", ~F.col("head") & ~F.coalesce(F.col("content") == F.col("before"), F.lit(False))).drop("before")
    opened = F.when(F.col("changed"), own)
    rows = rows.withColumns({"current": F.last(opened, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                             "earlier": F.last(opened, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))})
    ends = rows.filter("head OR tail").groupBy("_block", *keys).agg(
        F.max(F.when(F.col("head"), F.struct("content", own.alias("own")))).alias("first"),
        F.max(F.when(F.col("tail"), F.struct("content", "current"))).alias("last"))
    along = Window.partitionBy(*keys).orderBy("_block")
    chain = ends.withColumn("before", F.lag("last.content").over(along)).join(latest, keys, "left")
    same = F.coalesce(F.col("first.content") == F.col("before"), F.lower(F.hex("first.content")) == F.col("latest.fingerprint"), F.lit(False))
    chain = chain.withColumn("started", F.when(~same, F.col("first.own")))
    chain = chain.select("_block", *keys, "started", F.col("latest.id").alias("latest_id"), F.last(
        F.coalesce("last.current", "started"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    id_of = lambda version: F.when(version.isNotNull(), _own_id(version["document_id"], version["ordinal"]))
    started, head = F.col("started"), F.col("head")
    # Version 0 is the latest stored one.
    return rows.join(chain, ["_block", *keys]).select(
        *keys, "document_id", "ordinal", F.when(head, started.isNotNull()).otherwise(F.col("changed")).alias("opens"),
        F.coalesce(id_of(F.coalesce("current", started, "carried")), "latest_id").alias("version_id"),
        F.coalesce(id_of(F.coalesce("earlier", F.when(~head, started), "carried")), "latest_id").alias("earlier_id"))


def resolve_entities(entities: DataFrame, existing: DataFrame, ingested: DataFrame | None = None) -> DataFrame:
    """Gives every candidate an entity id and an action: created, found_identical, created_version.

    ``existing``: stored versions as (id, entity_type, business_key, fingerprint[, is_latest]); without
    the flag every row is the latest of its key. Candidates of a key go in order of ``extracted_at``,
    then document and ordinal. Each is compared with the version before it: with the latest stored one,
    or with what the batch has made of it, so content A, then B, then A makes three versions.

    A version's id follows from document and ordinal, so a candidate whose own version is stored already
    makes none. ``ingested`` (document_id, ordinal, entity_id), the extraction records so far, says the
    same of candidates that found their content: they keep the entity they have and make no version. It
    names every candidate with a version of its own, so those need not be looked for among the stored ones.

    Columns beyond those of :func:`decisions` come from ``entities`` by document and ordinal.
    """
    candidates = entities.withColumns({"business_key": business_key(), "fingerprint": content_fingerprint()})
    columns, decided = candidates.columns, ["action", "entity_id", "supersedes_id", *(["repeated"] if ingested is not None else [])]
    place = ["document_id", "ordinal", "entity_type", "business_key"]
    if ingested is None:
        versioned = F.col("entity_type").isin(*VERSIONED_LABELS)
        one = _decided(candidates, existing, None, versioned).select(*place, *decided)
        always = _always(candidates.filter(~versioned)).select(*columns, *decided)
        return candidates.filter(versioned).join(one, place).select(*columns, *decided).unionByName(always)
    return candidates.join(decisions(entities, existing, ingested).select(*place, *decided), place).select(*columns, *decided)


def decisions(entities: DataFrame, existing: DataFrame, ingested: DataFrame | None = None) -> DataFrame:
    """What :func:`resolve_entities` decides, without the other columns of the entities: (document_id, ordinal, entity_type,
    business_key, action, entity_id, supersedes_id); with ``ingested`` also ``repeated``, true for candidates it names."""
    candidates = entities.withColumns({"business_key": business_key(), "fingerprint": content_fingerprint()})
    versioned = F.col("entity_type").isin(*VERSIONED_LABELS)
    columns = ["document_id", "ordinal", "entity_type", "business_key", "action", "entity_id", "supersedes_id"]
    if ingested is None:
        return _decided(candidates, existing, None, versioned).select(*columns).unionByName(_always(candidates.filter(~versioned)).select(*columns))
    narrow = candidates.select("entity_type", "business_key", "extracted_at", "document_id", "ordinal", F.when(versioned, F.col("fingerprint")).alias("fingerprint"))
    marked = narrow.join(ingested.select("document_id", "ordinal", F.col("entity_id").alias("known_id")), ["document_id", "ordinal"], "left")
    fresh, known = marked.filter("known_id IS NULL"), marked.filter("known_id IS NOT NULL")
    none = F.lit(None).cast("string")
    repeated = known.withColumns({"action": F.lit("found_identical"), "entity_id": F.col("known_id"), "supersedes_id": none, "repeated": F.lit(True)})
    rest = [rows.withColumn("repeated", F.lit(False)).select(*columns, "repeated") for rows in (
        _decided(fresh, existing, ingested, versioned), _always(fresh.filter(~versioned)))]
    return rest[0].unionByName(rest[1]).unionByName(repeated.select(*columns, "repeated"))


def _always(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns({"action": F.lit("created"), "entity_id": _own_id(F.col("document_id"), F.col("ordinal")),
                                   "supersedes_id": F.lit(None).cast("string")})


def _decided(candidates: DataFrame, existing: DataFrame, ingested: DataFrame | None, versioned: Column) -> DataFrame:
    if "is_latest" not in existing.columns:
        existing = existing.withColumn("is_latest", F.lit(True))
    found = _versions(candidates.filter(versioned), existing)
    stored = F.lit(False)
    if ingested is None:
        ids = existing.filter(F.col("id").startswith("ent-")).select(F.col("id").alias("own_id"), F.lit(True).alias("is_stored")).distinct()
        found = found.withColumn("own_id", _own_id(F.col("document_id"), F.col("ordinal"))).join(ids, "own_id", "left")
        stored = F.col("is_stored").isNotNull()
    is_new = F.col("opens") & ~stored
    supersedes = F.when(is_new, F.col("earlier_id"))
    entity_id = F.when(stored, F.col("own_id")).otherwise(F.col("version_id")) if ingested is None else F.col("version_id")
    return found.withColumns({"entity_id": entity_id, "supersedes_id": supersedes,
                              "action": F.when(~is_new, "found_identical").when(supersedes.isNotNull(), "created_version").otherwise("created")})


def supersedes_edges(resolved: DataFrame) -> DataFrame:
    return resolved.filter("supersedes_id is not null").select(
        F.col("entity_id").alias("src"), F.col("supersedes_id").alias("dst"), F.lit("SUPERSEDES").alias("rel_type"),
        F.lit(1.0).alias("confidence"), F.lit("Property changes detected").alias("reason"))


def to_entities(resolved: DataFrame) -> DataFrame:
    """New entity rows with timestamps; the extraction record travels as columns."""
    return resolved.filter("action <> 'found_identical'").select(
        F.col("entity_id").alias("id"), "entity_type", "properties", F.col("extracted_at").alias("created_at"),
        F.col("extracted_at").alias("updated_at"), "document_id", "ordinal", "model_used", "extracted_at",
        "confidence", "section", "page_number", "line_range")


def entity_references(resolved: DataFrame) -> DataFrame:
    """(document_id, ref, entity_id): the last entity of a document with a reference wins. Dealt by document, for the steps after it."""
    rows = resolved.select("document_id", F.concat_ws(":", "entity_type", "business_key").alias("ref"), "entity_id", "entity_type", "ordinal")
    return (rows.repartition("document_id").groupBy("document_id", "ref")
            .agg(F.max_by("entity_id", "ordinal").alias("entity_id"), F.max("entity_type").alias("entity_type")))


def between_entities(relationships: DataFrame) -> DataFrame:
    """Relationships of a known type that refer to no document."""
    return relationships.filter(~_is_document("from_ref") & ~_is_document("to_ref") & F.col("rel_type").isin(*schemas.RELATIONSHIP_TYPES))


def resolve_relationships(relationships: DataFrame, references: DataFrame) -> DataFrame:
    """Relationships between entity ids; unresolved or unknown ones and document references drop out.

    Properties and the whole source reference stay with the edge. The references of a document, which are no more than its
    response has entities, meet its relationships as one map.
    """
    refs = references.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "ref", F.struct("entity_id", "entity_type")))).alias("refs"))
    rows = between_entities(relationships.drop("refs"))
    ends = rows.join(refs, "document_id").withColumns({"from": F.col("refs")[F.col("from_ref")], "to": F.col("refs")[F.col("to_ref")]})
    return ends.filter("from IS NOT NULL AND to IS NOT NULL").select(
        "document_id", F.col("from.entity_id").alias("src"), F.col("to.entity_id").alias("dst"), "rel_type", "confidence", "section", "ordinal",
        F.col("from.entity_type").alias("src_label"), F.col("to.entity_type").alias("dst_label"),
        "properties", "page_number", "line_range", *[c for c in ("model_used", "extracted_at") if c in relationships.columns])


def implicit_edges(references: DataFrame) -> DataFrame:
    """Audit USES Document and Document IDENTIFIES FailureMode, confidence 1."""
    uses, entity, document = F.col("entity_type") == "Audit", F.col("entity_id"), F.col("document_id")
    return references.filter("entity_type IN ('Audit', 'FailureMode')").select(
        "document_id", F.when(uses, entity).otherwise(document).alias("src"), F.when(uses, document).otherwise(entity).alias("dst"),
        F.when(uses, "USES").otherwise("IDENTIFIES").alias("rel_type"), F.lit(1.0).alias("confidence"))


# --- reports ------------------------------------------------------------------------------------

def ingestion_counts(resolved: DataFrame, relationships: DataFrame, implicit: DataFrame) -> DataFrame:
    """Entities by type and relationships per document: (document_id, metric, value)."""
    rows = (resolved.select("document_id", F.col("entity_type").alias("metric"))
            .unionByName(relationships.select("document_id", F.lit("relationships").alias("metric")))
            .unionByName(implicit.select("document_id", F.lit("relationships").alias("metric"))))
    return rows.groupBy("document_id", "metric").agg(F.count(F.lit(1)).alias("value"))


def document_status(documents: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Lifecycle status: PENDING before extraction, PROCESSING while unjudged, then PROCESSED or FAILED."""
    rows = documents.select("document_id", F.col("response").isNotNull().alias("_extracted"))
    if verdicts is None:
        return rows.select("document_id", F.when(F.col("_extracted"), "PROCESSING").otherwise("PENDING").alias("status"),
                           F.lit(None).cast("string").alias("error"))
    found = rows.join(verdicts.select("document_id", "valid", "first_error"), "document_id", "left")
    return found.select("document_id", _status(F.col("_extracted")).alias("status"), F.col("first_error").alias("error"))


def _status(extracted: Column) -> Column:
    return (F.when(~extracted, "PENDING").when(F.col("valid").isNull(), "PROCESSING")
            .when(F.col("valid"), "PROCESSED").otherwise("FAILED"))


def judged_status(documents: DataFrame) -> DataFrame:
    """:func:`document_status` of judged documents."""
    return documents.select("document_id", _status(F.col("response_length").isNotNull()).alias("status"), F.col("first_error").alias("error"), "extracted_at")


def extraction_log(documents: DataFrame) -> DataFrame:
    """One log row per judged document: estimated tokens, mean confidence, counts, status."""
    return documents.select(
        "document_id", F.col("model_used").alias("model"), F.col("extracted_at").alias("timestamp"),
        F.ceil(F.col("response_length") / 4).cast("bigint").alias("tokens_used"), F.round("confidence_avg", 6).alias("confidence_avg"),
        "entity_count", "relationship_count", F.when(F.col("valid"), "success").otherwise("failed").alias("status"), F.col("first_error").alias("error_message"))


def purge(graph: AuditGraph, as_of: str, older_than_hours: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph without documents that failed long ago: documents, edges, and the number of documents deleted."""
    gone = purge_failed(graph.node("Document"), as_of, older_than_hours)
    return (delete_entities(graph.node("Document"), gone), detach(graph.edges(), gone), gone.agg(F.count(F.lit(1)).alias("purged")))


def purge_failed(documents: DataFrame, as_of: str, older_than_hours: int = 24) -> DataFrame:
    """Failed documents created more than ``older_than_hours`` before ``as_of``, to be deleted."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(older_than_hours))
    return documents.filter((F.upper("status") == "FAILED") & (F.col("created_at") < cutoff)).select("id")


# --- batch folder ingestion ------------------------------------------------------------------------

def mark_existing(files: DataFrame, stored_documents: DataFrame) -> DataFrame:
    """Adds ``skip`` and ``skip_reason`` to files whose content hash is already stored."""
    known = stored_documents.select("content_hash").distinct().withColumn("_known", F.lit(True))
    marked = files.join(known, "content_hash", "left")
    return marked.withColumns({
        "skip": F.coalesce("_known", F.lit(False)),
        "skip_reason": F.when(F.col("_known"), F.lit("exists"))}).drop("_known")


def mark_batch_duplicates(files: DataFrame, order: Sequence[str] = ("name",)) -> DataFrame:
    """Adds ``duplicate_of``: the first file of the batch with the same content hash, null for that first one."""
    first = files.groupBy("content_hash").agg(F.min(F.struct(*order)).alias("_first"))
    rows = files.join(first, "content_hash")
    return rows.withColumn("duplicate_of", F.when(F.struct(*order) != F.col("_first"), F.col("_first")[order[0]])).drop("_first")


def batch_summary(files: DataFrame) -> DataFrame:
    """(metric, value): total, skipped, processed, failed and files per document type.

    ``files``: document_type, skip, status.
    """
    skip = F.col("skip")
    rows = files.select(F.explode(F.filter(F.array(
        F.lit("total"),
        F.when(skip, F.lit("skipped")).when(F.col("status") == "PROCESSED", "processed").when(F.col("status") == "FAILED", "failed"),
        F.concat(F.lit("type:"), "document_type")), lambda m: m.isNotNull())).alias("metric"))
    blanks = files.sparkSession.createDataFrame([(m,) for m in ("total", "skipped", "processed", "failed")], "metric string")
    return (rows.withColumn("n", F.lit(1)).unionByName(blanks.withColumn("n", F.lit(0)))
            .groupBy("metric").agg(F.sum("n").alias("value")))


# --- chunk loading ----------------------------------------------------------------------------------

def loadable_chunks(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """Chunks with something other than white space in them."""
    return chunks.filter(F.regexp_replace(text, r"\s+", "") != "")


def attach_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Joins embeddings by chunk id; a chunk without one fails the job."""
    joined = chunks.join(embeddings.select("id", "embedding"), "id", "left")
    missing = F.raise_error(F.concat(F.lit("No embedding for chunk "), "id")).cast("array<float>")
    return joined.withColumn("embedding", F.when(F.col("embedding").isNull(), missing).otherwise(F.col("embedding")))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Rows of the chunk table from split segments; the document owns its chunks."""
    return chunks.select(
        F.concat(F.lit("chk-"), F.substring(F.sha2(F.concat_ws("|", "document_id", F.col("chunk_index").cast("string")), 256), 1, 24)).alias("id"),
        F.col("document_id").alias("graph_node_id"), "document_id", F.col("text").alias("chunk_text"),
        "chunk_index", "semantic_type", "context", "tokens", "is_oversized", "split_depth",
        "start_char", "end_char", "document_type")


# --- risk arithmetic -----------------------------------------------------------------------------------

def with_rpn(failure_modes: DataFrame) -> DataFrame:
    """Fills a missing RPN from severity x occurrence x detection and grades it."""
    rpn = F.coalesce("rpn", F.col("severity") * F.col("occurrence") * F.col("detection"))
    return failure_modes.withColumn("rpn", rpn).withColumn(
        "risk_level", F.when(F.col("rpn") > 200, "CRITICAL").when(F.col("rpn") >= 100, "HIGH")
        .when(F.col("rpn") >= 50, "MEDIUM").when(F.col("rpn").isNotNull(), "LOW"))
