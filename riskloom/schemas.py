"""Fixed vocabulary of the audit knowledge graph: labels, enums, rules, read schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
LABELS = (
    "Process", "Audit", "Document", "FailureMode", "Risk",
    "Control", "Finding", "Requirement", "ProcedureStep", "Incident",
)
DOCUMENT_TYPES = ("fmea", "ipar", "hira", "alert", "fps", "generic")
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
CONTROL_TYPES = ("PREVENTIVE", "DETECTIVE", "CORRECTIVE")
FINDING_STATUSES = ("OPEN", "IN_PROGRESS", "RESOLVED", "CLOSED")
FINDING_PRIORITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
REQUIREMENT_TYPES = ("REGULATORY", "COMPLIANCE", "INTERNAL", "INDUSTRY_STANDARD")
RPN_BUCKETS = ("critical", "high", "medium", "low", "unknown")
SATISFACTION_STATES = ("satisfied", "failed", "unknown")
RELATIONSHIP_TYPES = (
    "EVALUATES", "USES", "IDENTIFIES", "IMPLIES", "MITIGATES", "ADDRESSES", "REFERENCES",
    "SATISFIES", "FAILS_TO_SATISFY", "SUPERSEDES", "IMPLEMENTS", "APPLIED_IN",
    "RELATES_TO", "CAUSED_BY", "INVOLVED_STEP",
)

# Allowed (source label, target label, relationship type) triples.
RELATIONSHIP_RULES = (
    ("Audit", "Process", "EVALUATES"),
    ("Audit", "Document", "USES"),
    ("Document", "FailureMode", "IDENTIFIES"),
    ("Document", "Requirement", "SATISFIES"),
    ("Document", "Requirement", "FAILS_TO_SATISFY"),
    ("Document", "Document", "SUPERSEDES"),
    ("FailureMode", "Risk", "IMPLIES"),
    ("FailureMode", "FailureMode", "SUPERSEDES"),
    ("Control", "FailureMode", "MITIGATES"),
    ("Control", "Risk", "MITIGATES"),
    ("Control", "Control", "SUPERSEDES"),
    ("Finding", "FailureMode", "ADDRESSES"),
    ("Finding", "Control", "REFERENCES"),
    ("Finding", "Finding", "SUPERSEDES"),
    ("Process", "Process", "SUPERSEDES"),
    ("Risk", "Risk", "SUPERSEDES"),
    ("Requirement", "Requirement", "SUPERSEDES"),
    ("ProcedureStep", "Control", "IMPLEMENTS"),
    ("Control", "ProcedureStep", "APPLIED_IN"),
    ("ProcedureStep", "ProcedureStep", "SUPERSEDES"),
)
# Documented as legal, but without a rule in strict mode.
EXTENDED_RULES = (
    ("Document", "Process", "RELATES_TO"),
    ("Incident", "Control", "CAUSED_BY"),
    ("Incident", "ProcedureStep", "INVOLVED_STEP"),
)

# Properties an extracted entity must carry, per label.
REQUIRED_PROPERTIES = {
    "Audit": ("auditDate",),
    "Process": ("name", "version"),
    "FailureMode": ("code", "description"),
    "Risk": ("level", "description"),
    "Control": ("controlType", "description"),
    "Finding": ("status", "priority", "description"),
    "Requirement": ("code", "description"),
    "ProcedureStep": ("stepNumber", "processId", "description"),
}
MIN_CONFIDENCE = 0.7
# ---------------------------------------------------------------------------

SOURCE_REFERENCE = T.StructType([
    T.StructField("section", T.StringType()),
    T.StructField("pageNumber", T.IntegerType()),
    T.StructField("lineRange", T.ArrayType(T.IntegerType())),
])

EXTRACTION_RESPONSE = T.StructType([
    T.StructField("entities", T.ArrayType(T.StructType([
        T.StructField("entityType", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("sourceReference", SOURCE_REFERENCE),
    ]))),
    T.StructField("relationships", T.ArrayType(T.StructType([
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("sourceReference", SOURCE_REFERENCE),
    ]))),
])

EDGE = T.StructType([
    T.StructField("src", T.StringType(), False),
    T.StructField("dst", T.StringType(), False),
    T.StructField("rel_type", T.StringType(), False),
    T.StructField("src_label", T.StringType()),
    T.StructField("dst_label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("extraction_id", T.StringType()),
    T.StructField("status", T.StringType()),
])

EXTRACTION = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("entity_id", T.StringType(), False),
    T.StructField("entity_type", T.StringType()),
    T.StructField("source_document_id", T.StringType()),
    T.StructField("extracted_by", T.StringType()),
    T.StructField("extracted_at", T.TimestampNTZType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("section", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("line_range_start", T.IntegerType()),
    T.StructField("line_range_end", T.IntegerType()),
])

_BASE = "id string, created_at timestamp_ntz, updated_at timestamp_ntz"
NODE_SCHEMAS = {
    "Process": f"{_BASE}, name string, version string, description string",
    "Audit": f"{_BASE}, auditor string, audit_date string, scope string",
    "Document": f"{_BASE}, document_type string, status string, storage_path string, "
                "content_hash string, file_name string, uploaded_at timestamp_ntz, error string",
    "FailureMode": f"{_BASE}, code string, description string, severity int, occurrence int, "
                   "detection int, rpn int",
    "Risk": f"{_BASE}, level string, description string, likelihood double, impact double",
    "Control": f"{_BASE}, control_type string, description string, effectiveness double",
    "Finding": f"{_BASE}, status string, priority string, description string",
    "Requirement": f"{_BASE}, requirement_type string, code string, description string, source string",
    "ProcedureStep": f"{_BASE}, step_number int, process_id string, description string, "
                     "responsible_role string, frequency string, evidence string",
    "Incident": f"{_BASE}, code string, description string, severity string, status string, "
                "occurred_at timestamp_ntz, location string, root_cause string, process_id string",
}
CHUNK_SCHEMA = (
    "id string, embedding array<float>, graph_node_id string, document_id string, "
    "chunk_text string, chunk_index int, semantic_type string, context string, tokens int, "
    "is_oversized boolean, split_depth int, start_char int, end_char int, document_type string"
)
