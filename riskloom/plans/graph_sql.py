"""SQL form of the star-schema-to-graph mapping, one common table expression per graph table."""

from __future__ import annotations

import re

TABLES: dict[str, str] = {
    "document": """
        SELECT 'doc-' || o_orderkey AS id, o_orderdate AS created_at,
          ['fmea','ipar','hira','alert','fps','generic'][CAST(o_orderkey % 6 + 1 AS INT)] AS document_type,
          CASE o_orderstatus WHEN 'F' THEN 'PROCESSED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
          sha256('doc-' || o_orderkey) AS content_hash,
          CASE WHEN o_orderpriority = '5-LOW' THEN 'note-' || o_orderkey || '.txt'
               ELSE 'Safety ST ' || (o_custkey % 12 + 1) || ' rev.pdf' END AS file_name
        FROM orders""",
    "failure_mode": """
        SELECT 'fm-' || p_partkey AS id, 'FM-' || p_partkey AS code, p_name AS description,
          p_size % 10 + 1 AS severity, p_partkey % 10 + 1 AS occurrence, (p_partkey // 10) % 10 + 1 AS detection,
          CASE WHEN p_partkey % 17 <> 0
               THEN (p_size % 10 + 1) * (p_partkey % 10 + 1) * ((p_partkey // 10) % 10 + 1) END AS rpn,
          TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 60 AS INT)) AS created_at
        FROM part""",
    "risk": """
        SELECT 'risk-' || p_partkey AS id, ['LOW','MEDIUM','HIGH','CRITICAL'][p_size % 4 + 1] AS level,
          p_name AS description, TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 90 AS INT)) AS created_at
        FROM part""",
    "control": """
        SELECT 'ctl-' || s_suppkey AS id,
          ['PREVENTIVE','DETECTIVE','CORRECTIVE'][CAST(s_suppkey % 3 + 1 AS INT)] AS control_type,
          s_name AS description,
          CASE WHEN s_suppkey % 13 <> 0 THEN round((s_acctbal + 1000) / 110, 2) END AS effectiveness,
          TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 60 AS INT)) AS created_at
        FROM supplier""",
    "process": """
        SELECT 'proc-' || n_nationkey AS id, n_name AS name, '1.' || n_regionkey AS version,
          TIMESTAMP '2024-01-01' + to_days(n_nationkey) AS created_at FROM nation""",
    "audit": """
        SELECT 'aud-' || c_custkey AS id, c_name AS auditor, c_mktsegment AS scope,
          strftime(DATE '2024-01-01' + CAST(c_custkey % 365 AS INT), '%Y-%m-%d') AS audit_date,
          TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 365 AS INT)) AS created_at FROM customer""",
    "procedure_step": """
        SELECT 'step-' || s_suppkey AS id, 'proc-' || s_nationkey AS process_id, s_suppkey % 9 + 1 AS step_number,
          TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 60 AS INT)) AS created_at
        FROM supplier""",
    "finding": """
        SELECT 'fnd-' || event_id AS id, ts AS created_at,
          ts + to_hours(CAST(floor(value) AS BIGINT)) AS updated_at,
          CASE event_type WHEN 'signup' THEN 'RESOLVED' WHEN 'purchase' THEN 'CLOSED'
               WHEN 'click' THEN 'IN_PROGRESS' ELSE 'OPEN' END AS status,
          ['LOW','MEDIUM','HIGH','CRITICAL'][CAST(event_id % 4 + 1 AS INT)] AS priority
        FROM events""",
    "requirement": """
        SELECT 'req-' || p_partkey AS id, 'REQ-' || p_partkey AS code,
          ['REGULATORY','COMPLIANCE','INTERNAL','INDUSTRY_STANDARD'][CAST(p_partkey % 4 + 1 AS INT)] AS requirement_type,
          TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 60 AS INT)) AS created_at
        FROM part""",
    "incident": """
        SELECT 'inc-' || event_id AS id, 'INC-' || event_id AS code, ts AS created_at,
          ['MINOR','MODERATE','SERIOUS','PSIF'][CAST(user_id % 4 + 1 AS INT)] AS severity
        FROM events WHERE event_type = 'error'""",
    "identifies": """
        SELECT DISTINCT 'doc-' || l_orderkey AS src, 'fm-' || l_partkey AS dst FROM lineitem""",
    "implies": """
        SELECT 'fm-' || p_partkey AS src, 'risk-' || (p_partkey - p_partkey % 4) AS dst FROM part WHERE p_size > 5""",
    "mitigates_mode": """
        SELECT DISTINCT 'ctl-' || l_suppkey AS src, 'fm-' || l_partkey AS dst FROM lineitem
        WHERE l_returnflag = 'R' AND l_linenumber = 1""",
    "mitigates_risk": """
        SELECT DISTINCT 'ctl-' || l_suppkey AS src, 'risk-' || l_partkey AS dst FROM lineitem
        WHERE l_returnflag = 'A' AND l_linenumber = 2 AND l_quantity >= 40""",
    "implements": """
        SELECT 'step-' || s_suppkey AS src, 'ctl-' || s_suppkey AS dst FROM supplier WHERE s_acctbal > 2000""",
    "uses": "SELECT 'aud-' || o_custkey AS src, 'doc-' || o_orderkey AS dst FROM orders",
    "evaluates": "SELECT 'aud-' || c_custkey AS src, 'proc-' || c_nationkey AS dst FROM customer",
    "relates_to": "SELECT 'doc-' || o_orderkey AS src, 'proc-' || (o_custkey % 25) AS dst FROM orders",
    "satisfies": """
        SELECT DISTINCT 'doc-' || l_orderkey AS src, 'req-' || l_partkey AS dst FROM lineitem
        WHERE l_linenumber = 3 AND l_quantity >= 40 AND l_linestatus = 'F'""",
    "fails_to_satisfy": """
        SELECT DISTINCT 'doc-' || l_orderkey AS src, 'req-' || l_partkey AS dst FROM lineitem
        WHERE l_linenumber = 3 AND l_quantity >= 40 AND l_linestatus = 'O'""",
    "addresses": "SELECT 'fnd-' || event_id AS src, 'fm-' || (event_id % 200) AS dst FROM events",
    "references_": """
        SELECT 'fnd-' || event_id AS src, 'ctl-' || (user_id % 10) AS dst FROM events WHERE value > 10""",
    "supersedes": """
        SELECT 'fm-' || p_partkey AS src, 'fm-' || (p_partkey - 1) AS dst FROM part
        WHERE p_size > 40 AND p_partkey > 0""",
    "edge": """
        SELECT src, dst, 'IDENTIFIES' AS rel_type, 'Document' AS src_label, 'FailureMode' AS dst_label FROM identifies
        UNION ALL SELECT src, dst, 'IMPLIES', 'FailureMode', 'Risk' FROM implies
        UNION ALL SELECT src, dst, 'MITIGATES', 'Control', 'FailureMode' FROM mitigates_mode
        UNION ALL SELECT src, dst, 'MITIGATES', 'Control', 'Risk' FROM mitigates_risk
        UNION ALL SELECT src, dst, 'IMPLEMENTS', 'ProcedureStep', 'Control' FROM implements
        UNION ALL SELECT src, dst, 'USES', 'Audit', 'Document' FROM uses
        UNION ALL SELECT src, dst, 'EVALUATES', 'Audit', 'Process' FROM evaluates
        UNION ALL SELECT src, dst, 'RELATES_TO', 'Document', 'Process' FROM relates_to
        UNION ALL SELECT src, dst, 'SATISFIES', 'Document', 'Requirement' FROM satisfies
        UNION ALL SELECT src, dst, 'FAILS_TO_SATISFY', 'Document', 'Requirement' FROM fails_to_satisfy
        UNION ALL SELECT src, dst, 'ADDRESSES', 'Finding', 'FailureMode' FROM addresses
        UNION ALL SELECT src, dst, 'REFERENCES', 'Finding', 'Control' FROM references_
        UNION ALL SELECT src, dst, 'SUPERSEDES', 'FailureMode', 'FailureMode' FROM supersedes""",
    "entity": """
        SELECT id, 'Document' AS type FROM document UNION ALL SELECT id, 'FailureMode' FROM failure_mode
        UNION ALL SELECT id, 'Risk' FROM risk UNION ALL SELECT id, 'Control' FROM control
        UNION ALL SELECT id, 'Process' FROM process UNION ALL SELECT id, 'Audit' FROM audit
        UNION ALL SELECT id, 'ProcedureStep' FROM procedure_step UNION ALL SELECT id, 'Finding' FROM finding
        UNION ALL SELECT id, 'Requirement' FROM requirement UNION ALL SELECT id, 'Incident' FROM incident""",
    "extraction": """
        SELECT 'ext-' || l_orderkey || '-ctl-' || l_suppkey AS id, 'ctl-' || l_suppkey AS entity_id,
          'Control' AS entity_type, 'doc-' || l_orderkey AS source_document_id,
          round(1 - 4 * min(l_discount), 2) AS confidence, min(l_linenumber) AS page_number,
          'Item ' || min(l_linenumber) AS section, min(l_shipdate) AS extracted_at
        FROM lineitem GROUP BY l_orderkey, l_suppkey
        UNION ALL
        SELECT 'ext-' || l_orderkey || '-fm-' || l_partkey, 'fm-' || l_partkey, 'FailureMode', 'doc-' || l_orderkey,
          round(1 - 4 * min(l_discount), 2), min(l_linenumber), 'Item ' || min(l_linenumber), min(l_shipdate)
        FROM lineitem GROUP BY l_orderkey, l_partkey
        UNION ALL
        SELECT 'ext-' || l_orderkey || '-risk-' || l_partkey, 'risk-' || l_partkey, 'Risk', 'doc-' || l_orderkey,
          round(1 - 4 * min(l_discount), 2), min(l_linenumber), 'Item ' || min(l_linenumber), min(l_shipdate)
        FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey, l_partkey""",
    "chunk": """
        SELECT 'chk-' || vec_id AS id, embedding, 'doc-' || (vec_id // 5) AS document_id,
          coalesce(text, '') AS chunk_text, vec_id % 5 AS chunk_index, 'type_' || label AS semantic_type,
          lang AS context, vec_id * 37 % 900 + 20 AS tokens, vec_id * 37 % 900 + 20 > 800 AS is_oversized
        FROM (SELECT coalesce(e.vec_id, d.doc_id) AS vec_id, embedding, label, text, lang
          FROM embeddings e FULL JOIN documents d ON d.doc_id = e.vec_id)""",
}


def _needs(sql: str) -> set[str]:
    return {name for name in TABLES if re.search(rf"\b{name}\b", sql)}


def with_graph(sql: str, **ctes: str) -> str:
    """Prefixes ``sql`` with the graph tables it (or an extra CTE) mentions."""
    wanted: set[str] = set()
    frontier = _needs(sql).union(*[_needs(body) for body in ctes.values()]) if ctes else _needs(sql)
    while frontier - wanted:
        wanted |= frontier
        frontier = set().union(*[_needs(TABLES[name]) for name in wanted])
    parts = [f"{name} AS ({TABLES[name]})" for name in TABLES if name in wanted]
    parts += [f"{name} AS ({body})" for name, body in ctes.items()]
    recursive = "RECURSIVE " if any("UNION" in body and re.search(rf"\b{name}\b", body)
                                    for name, body in ctes.items()) else ""
    return f"WITH {recursive}{', '.join(parts)}\n{sql}" if parts else sql
