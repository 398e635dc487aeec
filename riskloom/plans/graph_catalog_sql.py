"""Reference answers in SQL for the pattern, vector, record and ingestion queries."""

from __future__ import annotations

import re

from riskloom.plans.graph_sql import with_graph

_VEC = "list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_HITS = f"""SELECT c.id, c.document_id, c.semantic_type, c.context, c.tokens, round({_VEC}, 5) AS score, {_VEC} AS s
    FROM chunk c, (SELECT embedding FROM chunk WHERE id = 'chk-7') q"""
_BOTH = """SELECT src AS id, dst AS neighbour_id, dst_label AS neighbour_type, rel_type, src, dst, 'out' AS direction FROM edge
    UNION ALL SELECT dst, src, src_label, rel_type, src, dst, 'in' FROM edge"""
def _inverted_file(rounds: int = 4) -> dict[str, str]:
    """Cells of all embeddings: k-means on the sample in ``rounds`` steps, each a pair of tables, then ``placed``."""
    def nearest(rows: str, cells: str) -> str:
        return f"""SELECT id, u, cell FROM (SELECT r.id, r.u, c.cell,
            row_number() OVER (PARTITION BY r.id ORDER BY list_dot_product(r.u, c.c) DESC, c.cell) AS place FROM {rows} r, {cells} c) WHERE place = 1"""

    length = "list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))"
    ctes = {
        "unit": f"SELECT id, {length} AS u FROM (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM chunk WHERE embedding IS NOT NULL)",
        "drawn": "SELECT id, u, row_number() OVER (ORDER BY md5(id), id) AS n FROM unit QUALIFY n <= 16384",
        "fitted0": "SELECT n - 1 AS cell, u AS c FROM drawn WHERE n <= least(4096, ceil(4 * sqrt((SELECT count(*) FROM unit))))",
    }
    for r in range(rounds):
        last = r == rounds - 1
        ctes[f"near{r}"] = nearest("drawn", f"fitted{r}")
        ctes["fitted" if last else f"fitted{r + 1}"] = f"""
            SELECT f.cell, coalesce(m.c, f.c) AS c FROM fitted{r} f LEFT JOIN (
              SELECT cell, {length} AS c FROM (SELECT cell, list(v ORDER BY i) AS e FROM (
                SELECT cell, i, sum(u[i]) AS v FROM near{r}, generate_series(1, len(u)) AS g(i) GROUP BY cell, i) GROUP BY cell)) m USING (cell)"""
    return ctes | {"placed": nearest("unit", "fitted")}


_CANDIDATES = """
    SELECT c.entity_id AS src, r.entity_id AS dst, r.id AS extraction_id, r.confidence FROM extraction c
    JOIN extraction r ON r.source_document_id = c.source_document_id AND r.page_number = c.page_number
    WHERE c.entity_type = 'Control' AND r.entity_type = 'Risk' AND c.confidence >= 0.7"""


def _chunk_stats(column: str) -> str:
    return f"""SELECT coalesce(CAST({column} AS VARCHAR), 'unknown') AS "group", count(*) AS chunks, round(avg(tokens), 6) AS avg_tokens,
        count(*) FILTER (is_oversized) AS oversized FROM chunk GROUP BY 1
      UNION ALL SELECT 'TOTAL', count(*), floor(avg(tokens) + 0.5), count(*) FILTER (is_oversized) FROM chunk"""


# --- ingestion, straight from the events the responses were built from -----------------------
_E = """SELECT 'doc-' || event_id AS document_id, 'model-' || (user_id % 3) AS model, ts, event_type AS kind, value, user_id, event_id,
      'FM-' || user_id AS code, strftime(ts, '%Y-%m-%d') AS day,
      CASE WHEN event_type = 'error' AND value > 50 THEN '' ELSE 'Sec ' || (event_id % 5) END AS section FROM events"""
_ENT = """
    SELECT document_id, CAST(0 AS BIGINT) AS ordinal, 'FailureMode' AS entity_type, CAST(CASE WHEN value < 2 THEN 0.65 ELSE 0.9 END AS DOUBLE) AS confidence, section,
      event_id % 9 + 1 AS page_number, code AS head_property, kind || ' failure' AS description FROM ev
    UNION ALL SELECT document_id, 1, CASE WHEN kind = 'purchase' AND value > 100 THEN 'Hazard' ELSE 'Risk' END, 0.8, section, event_id % 9 + 1,
      ['LOW','MEDIUM','HIGH','CRITICAL'][CAST(user_id % 4 + 1 AS INT)], kind || ' risk' FROM ev
    UNION ALL SELECT document_id, 2, 'Control', 0.85, section, event_id % 9 + 1,
      ['PREVENTIVE','DETECTIVE','CORRECTIVE'][CAST(user_id % 3 + 1 AS INT)], CASE WHEN value <= 150 THEN 'control ' || user_id END FROM ev
    UNION ALL SELECT document_id, 3, 'Audit', 0.95, section, event_id % 9 + 1, day, NULL FROM ev"""
_REL = """
    SELECT document_id, CAST(0 AS BIGINT) AS ordinal, 'FailureMode:' || code AS from_ref, 'Risk:' || kind || ' risk' AS to_ref,
      CASE WHEN kind = 'view' AND value > 120 THEN 'BREAKS' ELSE 'IMPLIES' END AS rel_type, section FROM ev
    UNION ALL SELECT document_id, 1, 'Control:control ' || user_id,
      CASE WHEN kind = 'signup' AND value > 80 THEN 'FailureMode:none' ELSE 'FailureMode:' || code END,
      CASE WHEN kind = 'click' AND value > 90 THEN 'IMPLIES' ELSE 'MITIGATES' END, section FROM ev
    UNION ALL SELECT document_id, 2, 'Audit:' || day, 'Document:' || document_id, 'USES', section FROM ev"""
_ENT_ERRORS = """SELECT document_id, ordinal, array_to_string(list_filter([
      CASE WHEN entity_type = 'Hazard' THEN 'invalid entity type' END,
      CASE WHEN confidence < 0.7 THEN 'confidence below threshold' END,
      CASE WHEN section = '' THEN 'missing source section' END,
      CASE WHEN entity_type = 'Control' AND description IS NULL THEN 'missing required property' END], lambda x: x IS NOT NULL), '; ') AS errors
    FROM ent"""
_REL_ERRORS = """SELECT r.document_id, ordinal, array_to_string(list_filter([
      CASE WHEN section = '' THEN 'missing source section' END,
      CASE WHEN ordinal = 0 AND kind = 'purchase' AND value > 100 OR to_ref = 'FailureMode:none' THEN 'unresolved reference' END,
      CASE WHEN rel_type = 'BREAKS' THEN 'invalid relationship type' END,
      CASE WHEN ordinal = 1 AND rel_type = 'IMPLIES' THEN 'relationship not allowed' END], lambda x: x IS NOT NULL), '; ') AS errors
    FROM rel r JOIN (SELECT document_id, kind, value FROM ev) e USING (document_id) WHERE ordinal < 2"""
_VERDICTS = """SELECT document_id, n IS NULL AS valid, coalesce(n, 0) AS error_count, first_error FROM ev LEFT JOIN (
      SELECT document_id, CAST(sum(len(string_split(errors, '; '))) AS BIGINT) AS n,
        arg_min(string_split(errors, '; ')[1], stage * 100 + ordinal) AS first_error
      FROM (SELECT 0 AS stage, * FROM ent_errors UNION ALL SELECT 1, * FROM rel_errors) WHERE errors <> '' GROUP BY 1) USING (document_id)"""
_HASH = "'ent-' || substr(sha256(entity_type || '|' || business_key || '|' || document_id || '|' || ordinal), 1, 24)"
# Contents of a failure mode differ by description only (severity follows the user).
_KEYED = f"""SELECT document_id, ordinal, entity_type, business_key, coalesce(description, '') AS content, {_HASH} AS own_id, ts FROM (
      SELECT ent.*, ev.ts, CASE entity_type WHEN 'FailureMode' THEN head_property WHEN 'Audit' THEN head_property ELSE description END AS business_key
      FROM ent JOIN ev USING (document_id) WHERE document_id IN (SELECT document_id FROM verdicts WHERE valid))"""
# Each candidate against the one before it by time, the first against the stored version.
_CONTENTS = """SELECT k.*, s.id AS stored_id,
      coalesce(lag(content) OVER w, s.description, chr(1)) <> content AS opens FROM keyed k
    LEFT JOIN (SELECT 'fm-' || p_partkey AS id, 'FM-' || p_partkey AS code,
        ['error failure', 'click failure', 'view failure'][p_size % 3 + 1] AS description FROM part) s
      ON k.entity_type = 'FailureMode' AND s.code = k.business_key
    WHERE k.entity_type IN ('FailureMode', 'Audit') WINDOW w AS (PARTITION BY k.entity_type, k.business_key ORDER BY k.ts, k.document_id, k.ordinal)"""
_VERSIONS = """SELECT *, coalesce(last_value(CASE WHEN opens THEN own_id END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), stored_id) AS entity_id,
      CASE WHEN opens THEN coalesce(last_value(CASE WHEN opens THEN own_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), stored_id) END AS supersedes_id
    FROM contents WINDOW w AS (PARTITION BY entity_type, business_key ORDER BY ts, document_id, ordinal)"""
_RESOLVED = """SELECT k.document_id, k.ordinal, k.entity_type, k.business_key,
      CASE WHEN v.own_id IS NULL THEN 'created' WHEN NOT v.opens THEN 'found_identical'
           WHEN v.supersedes_id IS NOT NULL THEN 'created_version' ELSE 'created' END AS action,
      CASE WHEN v.own_id IS NULL THEN k.own_id ELSE v.entity_id END AS entity_id, v.supersedes_id
    FROM keyed k LEFT JOIN versions v ON v.own_id = k.own_id"""
_REFS = """SELECT document_id, entity_type || ':' || business_key AS ref, arg_max(entity_id, ordinal) AS entity_id, max(entity_type) AS entity_type
    FROM resolved GROUP BY 1, 2"""
_LINKED = """SELECT r.document_id, a.entity_id AS src, b.entity_id AS dst, rel_type, CAST(0.9 AS DOUBLE) AS confidence FROM rel r
    JOIN refs a ON a.document_id = r.document_id AND a.ref = r.from_ref JOIN refs b ON b.document_id = r.document_id AND b.ref = r.to_ref
    WHERE rel_type IN ('IMPLIES', 'MITIGATES')"""
_IMPLICIT = """SELECT document_id, entity_id AS src, document_id AS dst, 'USES' AS rel_type, CAST(1.0 AS DOUBLE) AS confidence FROM refs WHERE entity_type = 'Audit'
    UNION ALL SELECT document_id, document_id, entity_id, 'IDENTIFIES', CAST(1.0 AS DOUBLE) FROM refs WHERE entity_type = 'FailureMode'"""
_STAGES = {"ev": _E, "ent": _ENT, "rel": _REL, "ent_errors": _ENT_ERRORS, "rel_errors": _REL_ERRORS, "verdicts": _VERDICTS,
           "keyed": _KEYED, "contents": _CONTENTS, "versions": _VERSIONS, "resolved": _RESOLVED, "refs": _REFS,
           "linked": _LINKED, "implicit": _IMPLICIT}


# Into an empty store: no version is there before the first.
_STORED = {
    "contents": re.sub(r"s\.id AS stored_id", "CAST(NULL AS VARCHAR) AS stored_id", re.sub(r"LEFT JOIN \(SELECT 'fm-'.*?business_key\n", "", _CONTENTS, flags=re.S)
                       .replace("s.description, ", "")),
    "entity_record": """SELECT 'ext-' || substr(sha256(r.entity_id || '|' || r.document_id || '|' || r.ordinal), 1, 24) AS id, r.entity_id, r.entity_type,
        r.document_id, model, e.section, page_number FROM resolved r JOIN ent e USING (document_id, ordinal) JOIN ev USING (document_id)""",
    "link": """SELECT r.document_id, r.ordinal, a.entity_id AS src, b.entity_id AS dst, a.entity_type AS src_label, b.entity_type AS dst_label, rel_type, kind, model,
        r.section, event_id % 9 + 1 AS page_number, 'ext-' || substr(sha256('relationship|' || r.document_id || '|' || r.ordinal), 1, 24) AS extraction_id
      FROM rel r JOIN ev USING (document_id) JOIN refs a ON a.document_id = r.document_id AND a.ref = r.from_ref
      JOIN refs b ON b.document_id = r.document_id AND b.ref = r.to_ref WHERE rel_type IN ('IMPLIES', 'MITIGATES')""",
    "stored_edge": """
        SELECT src, rel_type, dst, src_label, dst_label, 'SUGGESTED' AS status, extraction_id, 'seen=' || kind AS props, section, page_number FROM link
        UNION ALL SELECT DISTINCT src, rel_type, dst, CASE rel_type WHEN 'USES' THEN 'Audit' ELSE 'Document' END,
          CASE rel_type WHEN 'USES' THEN 'Document' ELSE 'FailureMode' END, 'CONFIRMED', NULL, NULL, NULL, NULL FROM implicit
        UNION ALL SELECT entity_id, 'SUPERSEDES', supersedes_id, entity_type, entity_type, 'CONFIRMED', NULL, 'reason=Property changes detected', NULL, NULL
          FROM resolved WHERE supersedes_id IS NOT NULL""",
}


def _ingest(sql: str, stored: bool = False) -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in (_STAGES | (_STORED if stored else {})).items()) + sql


_FILES = """SELECT doc_id, lang, source, sha256(text) AS content_hash,
      ['fmea sheet','HIRA plan','Safety ST 4','incident alert','notes'][CAST(doc_id % 5 + 1 AS INT)] || ' ' || doc_id || '.txt' AS name,
      text || ['',' A Failure mode.',' Lição aprendida.',' Risk assessment',' Normas de operações',' IPAR',' hazard identification risk assessment'][CAST((doc_id // 2) % 7 + 1 AS INT)] AS text
    FROM documents"""
# Position of the strongest rule; earlier rules win ties. Each rule: (name hits * 0.5 + content hits * 0.3) * weight.
_HIT = "CASE WHEN regexp_matches(lower({0}), '{1}') THEN {2} ELSE 0 END"
_RULES = (
    ("fmea", 1.0, ("fmea",), (r"failure\s*mode", "fmea", r"modo\s*de\s*falha")),
    ("ipar", 1.0, ("ipar",), ("ipar", r"identificação\s*de\s*perigos", r"investigação\s*de\s*perigo", r"avaliação\s*dos\s*riscos\s*de\s*segurança")),
    ("hira", 1.2, (r"\bhira\b", r"hazard\s*identification"), (r"\bhira\b", r"hazard\s*identification", r"risk\s*assessment", r"identificação\s*de\s*riscos")),
    ("alert", 1.1, ("alert", "gppm", "incident", "alerta"), ("gppm", r"safety\s*alert", r"alerta\s*de\s*segurança", r"incident\s*report", r"lesson\s*learned", r"lição\s*aprendida")),
    ("fps", 0.8, (r"\bfps\b", r"safety\s*st\s*\d"), (r"\bfps\b", r"procedimento\s*fundamental", r"normas\s*de\s*operações", r"fundamental\s*safety")),
)


def _pattern_hits() -> str:
    rows = []
    order = 0
    for rank, (kind, weight, names, contents) in enumerate(_RULES):
        for column, prefix, points, patterns in (("name", "filename", 0.5, names), ("text", "content", 0.3, contents)):
            for pattern in patterns:
                order += 1
                rows.append(f"SELECT name, {rank} AS rule_no, '{kind}' AS kind, {weight} AS weight, {points} AS points, {order} AS ord, "
                            f"'{prefix}:{pattern}' AS label FROM files WHERE regexp_matches(lower({column}), '{pattern}')")
    return " UNION ALL ".join(rows)


_CLASSIFIED = f"""SELECT f.name, f.doc_id, f.content_hash, coalesce(b.kind, 'generic') AS document_type,
      round(CASE WHEN b.score IS NULL THEN 0.3 ELSE least(b.score, 1.0) END, 6) AS confidence, coalesce(b.patterns, '') AS patterns
    FROM files f LEFT JOIN (
      SELECT * FROM (SELECT name, kind, CAST(sum(points) AS DOUBLE) * max(weight) AS score, string_agg(label, ' ; ' ORDER BY ord) AS patterns,
          row_number() OVER (PARTITION BY name ORDER BY round(sum(points) * max(weight), 9) DESC, rule_no) AS n
        FROM ({_pattern_hits()}) GROUP BY name, kind, rule_no) WHERE n = 1) b ON b.name = f.name"""


def _files(sql: str) -> str:
    return f"WITH files AS ({_FILES}), classified AS ({_CLASSIFIED}) {sql}"


_DETECT = """CASE
    WHEN contains(n, 'fmea') OR contains(t, 'failure mode') THEN 'fmea'
    WHEN contains(n, 'ipar') OR regexp_matches(t, 'ipar|identificação de perigos|investigação de perigo|avaliação dos riscos de segurança') THEN 'ipar'
    WHEN contains(n, 'hira') OR regexp_matches(t, 'hira|hazard identification|risk assessment|identificação de riscos') THEN 'hira'
    WHEN regexp_matches(n, 'alert|gppm|incident|alerta') OR regexp_matches(t, 'gppm|safety alert|alerta de segurança|incident report|lesson learned|lição aprendida') THEN 'alert'
    WHEN regexp_matches(n || chr(1) || t, 'fps|safety st|am safety|procedimento fundamental|normas de operações') THEN 'fps'
    ELSE 'generic' END"""

_QUESTIONS = """SELECT 'doc-' || (item_id % 10) AS document_id, 'Which item says ' || string_split(text, ' ')[1] AS question,
      ['factoid','contextual','multi-span'][CAST(item_id % 3 + 1 AS INT)] AS type,
      list_filter(list_transform(string_split_regex(text, '[.\\n]'), lambda s: trim(s)), lambda s: s <> '') AS facts FROM benchmark"""
_SHEET_LINES = r"""
    SELECT doc_id, source AS sheet, 0 AS row, 'Process,Quoted,Cause,Effect' AS line FROM documents
    UNION ALL SELECT doc_id, source, pos, line FROM (
      SELECT doc_id, source, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos
      FROM (SELECT doc_id, source, regexp_replace(regexp_replace(regexp_replace(text, '\. ', ',', 'g'), '(^|\n)(.)', '\1\2,"\2, x",\2', 'g'), '\s+$', '') AS body FROM documents))
    UNION ALL SELECT doc_id, 'notes', 0, 'Process,Note' FROM documents
    UNION ALL SELECT doc_id, 'notes', 1, lang || ',ok' FROM documents
    UNION ALL SELECT doc_id, 'notes', 2, ',' FROM documents
    UNION ALL SELECT doc_id, 'notes', 3, source || ',end' FROM documents"""
# Commas inside quotes become a marker before the split.
_CELLS = r"""SELECT doc_id, sheet, row, list_transform(string_split(replace(regexp_replace(line, '"([^",]*),([^"]*)"', '\1' || chr(1) || '\2'), '"', ''), ','),
      lambda c: trim(replace(c, chr(1), ','), ' ')) AS cells FROM lines"""

ORACLES: dict[str, str] = {
    "s03_content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "s04_storage_name": with_graph("""
        SELECT id, '1704067200000_' || substr(sha256(id), 1, 8) || '_' || regexp_replace(file_name, '[^A-Za-z0-9._-]', '_', 'g') AS storage_name FROM document"""),
    "s05_workbook_rows": f"""WITH lines AS ({_SHEET_LINES}), parsed AS ({_CELLS})
        SELECT doc_id, sheet, CAST(row AS BIGINT) AS row, len(cells) AS cells, array_to_string(cells, '|') AS content FROM parsed""",
    "s06_entities": _ingest("SELECT * FROM ent"),
    "s06_relationships": _ingest("SELECT * FROM rel"),
    "s07_created_records": _ingest("""
        SELECT r.entity_type, count(DISTINCT entity_id) AS nodes, count(DISTINCT entity_id || document_id || r.ordinal) AS extractions,
          min(page_number) AS min_line FROM resolved r JOIN ent USING (document_id, ordinal) WHERE action <> 'found_identical' GROUP BY 1"""),
    "s08_entity_with_provenance": with_graph("""
        SELECT r.id, x.source_document_id, CASE WHEN x.id IS NOT NULL THEN 'extractor' END AS extracted_by, x.extracted_at, x.confidence, x.section,
          x.page_number, (x.page_number * 10) || '-' || (x.page_number * 10 + 5) AS line_range
        FROM risk r LEFT JOIN extraction x ON x.entity_id = r.id"""),
    "s09_update_entities": with_graph("""
        SELECT id, CASE WHEN rpn IS NULL AND severity > 5 THEN 'graded' ELSE description END AS description,
          CAST(coalesce(rpn, severity * occurrence * detection) AS BIGINT) AS rpn,
          CASE WHEN rpn IS NULL THEN TIMESTAMP '2025-01-01' ELSE created_at END AS updated_at FROM failure_mode"""),
    "s09_keyed_changes": with_graph("""
        SELECT id, description, CAST(coalesce(rpn, severity * occurrence * detection) AS BIGINT) AS rpn FROM failure_mode WHERE severity IS DISTINCT FROM 1"""),
    "s10_delete_entities": with_graph("""
        SELECT 'Risk' AS what, count(*) AS remaining FROM risk WHERE level <> 'LOW'
        UNION ALL SELECT rel_type, count(*) FROM edge LEFT JOIN risk ON risk.id = edge.dst
        WHERE rel_type IN ('IMPLIES', 'MITIGATES', 'IDENTIFIES') AND coalesce(level, '') <> 'LOW' GROUP BY 1"""),
    "s11_create_relationships": with_graph(f"""
        SELECT src, dst, 'MITIGATES' AS rel_type, 'Control' AS src_label, 'Risk' AS dst_label, confidence, extraction_id FROM ({_CANDIDATES})"""),
    "s12_create_simple_relationships": with_graph(f"""
        SELECT 'MITIGATES' AS rel_type, 'Control' AS src_label, 'Risk' AS dst_label, count(*) AS edges FROM ({_CANDIDATES})"""),
    "s13_get_relationships": with_graph(f"""
        SELECT id, src, dst, rel_type, direction FROM ({_BOTH}) WHERE id IN (SELECT id FROM risk WHERE level = 'CRITICAL')"""),
    "s14_upsert_chunks": with_graph("""
        SELECT id, document_id, CAST(least(tokens, 800) AS BIGINT) AS tokens, false AS is_oversized FROM chunk
        UNION ALL SELECT 'new-' || document_id, document_id, tokens, is_oversized FROM chunk WHERE chunk_index = 0"""),
    "s14_keyed_upsert": with_graph("""
        SELECT id, document_id, CAST(least(tokens, 800) AS BIGINT) AS tokens, false AS is_oversized FROM chunk
        UNION ALL SELECT 'new-' || document_id, document_id, tokens, is_oversized FROM chunk WHERE chunk_index = 0"""),
    "s15_delete_chunks": with_graph("""
        SELECT id, document_id FROM chunk WHERE document_id NOT IN (SELECT id FROM document WHERE document_type = 'fmea')"""),
    "s16_scan_chunks": with_graph("SELECT id, document_id, len(embedding) AS dimensions, length(chunk_text) AS chars FROM chunk"),
    "s18_extraction_log": _ingest("""
        SELECT document_id, model, confidence_avg, CAST(4 AS BIGINT) AS entity_count, CAST(3 AS BIGINT) AS relationship_count,
          CASE WHEN valid THEN 'success' ELSE 'failed' END AS status, first_error AS error_message
        FROM ev JOIN verdicts USING (document_id)
        JOIN (SELECT document_id, round(avg(confidence), 6) AS confidence_avg FROM ent GROUP BY 1) USING (document_id)"""),
    "s19_golden_questions": f"""WITH q AS ({_QUESTIONS})
        SELECT document_id, question, type, len(facts) AS facts, facts[1] AS first_fact FROM q
        WHERE document_id NOT IN ('doc-0', 'doc-1')""",
    "s20_latest_runs": """
        SELECT document_id, chunker_type, id, timestamp, overall_score FROM (
          SELECT *, row_number() OVER (PARTITION BY document_id, chunker_type ORDER BY timestamp DESC, id DESC) AS n FROM (
            SELECT 'run-' || event_id AS id, 'doc-' || user_id AS document_id,
              CASE WHEN event_id % 2 = 0 THEN 'semantic' ELSE 'fixed' END AS chunker_type,
              strftime(ts, '%Y-%m-%dT%H:%M') AS timestamp, value / 1000 AS overall_score FROM events)) WHERE n = 1""",
    "s21_rebuild_documents": with_graph(r"""
        SELECT document_id, CAST(0 AS BIGINT) AS part, count(*) AS chunks, max(['fmea','ipar','hira','alert','fps','generic'][CAST(n % 6 + 1 AS INT)]) AS document_type,
          string_agg(chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index) AS content
        FROM (SELECT *, CAST(substr(document_id, 5) AS INT) AS n FROM chunk) GROUP BY document_id"""),
    "g01_pattern": with_graph("""
        SELECT f.id, f.code, x.id AS extraction_id, x.source_document_id, x.confidence
        FROM (SELECT * FROM failure_mode WHERE severity = 8) f LEFT JOIN extraction x ON x.entity_id = f.id"""),
    "g02_entities_by_ids": with_graph("SELECT id, type FROM entity WHERE id IN (SELECT dst FROM implies)"),
    "g03_expand": with_graph(f"""
        SELECT id, neighbour_id, neighbour_type, rel_type, direction FROM ({_BOTH}) WHERE id IN (SELECT id FROM risk WHERE level = 'CRITICAL')"""),
    "g03_expanded_entities": with_graph("""
        SELECT DISTINCT m.src AS id, 'Control' AS type FROM mitigates_risk m JOIN risk r ON r.id = m.dst WHERE r.level = 'CRITICAL'"""),
    "g04_graph_pattern": with_graph("""
        SELECT 'entity' AS part, id, 'Document' AS type, NULL AS other_id, NULL AS detail FROM ipar
        UNION ALL SELECT DISTINCT 'entity', dst, 'FailureMode', NULL, NULL FROM identifies WHERE src IN (SELECT id FROM ipar)
        UNION ALL SELECT DISTINCT 'entity', src, 'Audit', NULL, NULL FROM uses WHERE dst IN (SELECT id FROM ipar)
        UNION ALL SELECT 'relationship', src, 'IDENTIFIES', dst, 'out' FROM identifies WHERE src IN (SELECT id FROM ipar)
        UNION ALL SELECT 'relationship', src, 'USES', dst, 'in' FROM uses WHERE dst IN (SELECT id FROM ipar)
        UNION ALL SELECT 'chunk', document_id, NULL, id, coalesce(context, '') FROM chunk WHERE document_id IN (SELECT id FROM ipar)""",
        ipar="SELECT id FROM document WHERE document_type = 'ipar'"),
    "g03_expand_stored": with_graph("""
        SELECT seed AS seed_id, r.id, e.type, min(depth) AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two) r JOIN entity e ON e.id = r.id
        WHERE r.id <> seed GROUP BY 1, 2, 3""",
        hop="SELECT src AS a, dst AS b FROM edge UNION ALL SELECT dst, src FROM edge",
        one="SELECT DISTINCT r.id AS seed, b AS id, CAST(1 AS BIGINT) AS depth FROM risk r JOIN hop ON a = r.id WHERE level = 'CRITICAL'",
        two="SELECT DISTINCT one.seed, b AS id, CAST(2 AS BIGINT) AS depth FROM one JOIN hop ON a = one.id"),
    "g05_filters": with_graph("""
        SELECT id, description, CAST(severity AS BIGINT) AS severity, CAST(rpn AS BIGINT) AS rpn FROM failure_mode
        WHERE rpn > 100 AND rpn <= 300 AND description ILIKE '%widget%' AND severity IN (5, 6, 7, 8)"""),
    "g06_related_ids": with_graph("SELECT id FROM failure_mode WHERE severity >= 7 AND id IN (SELECT dst FROM mitigates_mode)"),
    "g06_related_findings": with_graph("SELECT id FROM finding WHERE id IN (SELECT src FROM references_)"),
    "g07_run_query": with_graph("""
        SELECT priority, count(*) AS findings FROM finding WHERE status = 'OPEN' AND id IN (SELECT src FROM references_) GROUP BY 1"""),
    "g08_latest_versions": with_graph("SELECT id, code FROM failure_mode WHERE id NOT IN (SELECT dst FROM supersedes)"),
    "g09_version_chains": with_graph("""
        SELECT id, latest_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS n FROM walk) WHERE n = 1""",
        walk="""SELECT id, id AS latest_id, CAST(0 AS BIGINT) AS depth FROM failure_mode
          UNION ALL SELECT w.id, s.src, w.depth + 1 FROM walk w JOIN supersedes s ON s.dst = w.latest_id"""),
    "g11_page_by_key": with_graph("SELECT id, status FROM finding ORDER BY id LIMIT 25 OFFSET 75"),
    "g11_page": with_graph("SELECT id, status FROM finding ORDER BY id LIMIT 25 OFFSET 40"),
    "g12_expected_paths": with_graph("""
        SELECT 'finding-control-risk' AS path, count(DISTINCT f.src) AS starts, count(DISTINCT (f.src, m.dst)) AS pairs
          FROM references_ f JOIN mitigates_risk m ON m.src = f.dst
        UNION ALL SELECT 'risk-extraction-document', count(DISTINCT entity_id), count(DISTINCT (entity_id, source_document_id))
          FROM extraction WHERE entity_type = 'Risk'
        UNION ALL SELECT 'audit-document-failure-mode', count(DISTINCT u.src), count(DISTINCT (u.src, n.dst))
          FROM uses u JOIN identifies n ON n.src = u.dst
        UNION ALL SELECT 'failure-mode-control', count(DISTINCT dst), count(*) FROM mitigates_mode"""),
    "v01_vector_search": with_graph(f"SELECT id, score FROM ({_HITS}) ORDER BY s DESC, id LIMIT 10"),
    "v01_filtered_search": with_graph(f"""
        SELECT id, score FROM ({_HITS}) WHERE context = 'en' AND tokens < 500 ORDER BY s DESC, id LIMIT 10"""),
    "v03_nearest_chunks": with_graph(f"""
        SELECT question_id, chunk_id, round(s, 5) AS score, rank FROM (
          SELECT q.id AS question_id, c.id AS chunk_id, {_VEC} AS s, row_number() OVER (PARTITION BY q.id ORDER BY {_VEC} DESC, c.id) AS rank
          FROM chunk q JOIN chunk c USING (document_id) WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL) WHERE rank <= 3"""),
    "v04_approximate_search": with_graph("""
        SELECT c.id, round(list_dot_product(c.u, q.u), 5) AS score FROM placed c, (SELECT u FROM unit WHERE id = 'chk-7') q
        WHERE cell IN (SELECT cell FROM probed WHERE before < greatest(0.5 * (SELECT count(*) FROM unit), 200))
        ORDER BY list_dot_product(c.u, q.u) DESC, c.id LIMIT 10""", **_inverted_file(),
        probed="""SELECT cell, sum(size) OVER (ORDER BY near DESC, cell) - size AS before
          FROM (SELECT f.cell, list_dot_product(f.c, q.u) AS near, (SELECT count(*) FROM placed p WHERE p.cell = f.cell) AS size
                FROM fitted f, (SELECT u FROM unit WHERE id = 'chk-7') q)"""),
    "v04_index_cells": with_graph("""
        SELECT c.id, CAST(coalesce(p.cell, -1) AS BIGINT) AS cell FROM chunk c LEFT JOIN placed p USING (id)""", **_inverted_file()),
    "v06_chunks_of_nodes": with_graph("""
        SELECT id, document_id AS graph_node_id FROM chunk WHERE document_id IN (SELECT id FROM document WHERE document_type = 'fmea')"""),
    "v07_count_by_filter": with_graph("SELECT count(*) AS chunks FROM chunk WHERE is_oversized AND context IN ('en', 'de')"),
    "v08_semantic_search": with_graph("""
        SELECT h.id AS chunk_id, h.score, h.semantic_type, coalesce(h.context, '') AS context, h.document_id AS entity_id, 'Document' AS entity_type,
          r.id AS related_id, e.type AS related_type, r.depth
        FROM hits h LEFT JOIN (SELECT seed, id, min(depth) AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE id <> seed GROUP BY 1, 2) r
          ON r.seed = h.document_id LEFT JOIN entity e ON e.id = r.id""",
        hits=f"SELECT * FROM ({_HITS}) ORDER BY s DESC, id LIMIT 5",
        hop="SELECT src AS a, dst AS b FROM edge UNION ALL SELECT dst, src FROM edge",
        one="SELECT DISTINCT h.document_id AS seed, b AS id, CAST(1 AS BIGINT) AS depth FROM hits h JOIN hop ON a = h.document_id",
        two="SELECT DISTINCT one.seed, b AS id, CAST(2 AS BIGINT) AS depth FROM one JOIN hop ON a = one.id"),
    "v08_search_aggregations": with_graph("""
        SELECT 'total' AS metric, count(*) AS chunks, count(DISTINCT document_id) AS entities FROM hits
        UNION ALL SELECT 'type:' || semantic_type, count(*), count(DISTINCT document_id) FROM hits GROUP BY 1""",
        hits=f"SELECT * FROM ({_HITS}) ORDER BY s DESC, id LIMIT 10"),
    "v09_entity_context": with_graph(f"""
        SELECT DISTINCT document_id AS entity_id, 'provenance' AS part, NULL AS item_id, NULL AS detail, CAST(1.0 AS DOUBLE) AS confidence FROM chunk
        UNION ALL SELECT document_id, 'chunk', id, coalesce(context, ''), NULL FROM chunk
        UNION ALL SELECT id, direction, neighbour_id, rel_type, NULL FROM ({_BOTH}) WHERE id IN (SELECT document_id FROM chunk)"""),
    "v10_chunks_by_type": with_graph(_chunk_stats("semantic_type")),
    "v10_chunks_by_context": with_graph(_chunk_stats("context")),
    "v10_chunks_by_document": with_graph(_chunk_stats("document_id")),
    "i01_detect_type": _files(f"SELECT name, {_DETECT} AS document_type FROM (SELECT name, lower(name) AS n, lower(text) AS t FROM files)"),
    "i02_classify": _files("SELECT name, document_type, confidence, patterns FROM classified"),
    "i03_skip_existing": _files("""
        SELECT name, content_hash IN (SELECT content_hash FROM files WHERE lang = 'en') AS skip,
          CASE WHEN content_hash IN (SELECT content_hash FROM files WHERE lang = 'en') THEN 'exists' END AS skip_reason FROM files"""),
    "i04_batch_duplicates": _files("""
        SELECT name, CASE WHEN name <> first THEN first END AS duplicate_of
        FROM (SELECT name, min(name) OVER (PARTITION BY content_hash) AS first FROM files)"""),
    "i05_batch_summary": _files("""
        , marked AS (SELECT *, content_hash IN (SELECT content_hash FROM files WHERE lang = 'en') AS skip, doc_id % 10 = 3 AS bad FROM classified)
        SELECT 'total' AS metric, count(*) AS value FROM marked UNION ALL SELECT 'skipped', count(*) FROM marked WHERE skip
        UNION ALL SELECT 'processed', count(*) FROM marked WHERE NOT skip AND NOT bad UNION ALL SELECT 'failed', count(*) FROM marked WHERE NOT skip AND bad
        UNION ALL SELECT 'type:' || document_type, count(*) FROM marked GROUP BY 1"""),
    "i06_entity_errors": _ingest("SELECT * FROM ent_errors WHERE errors <> ''"),
    "i07_relationship_errors": _ingest("SELECT * FROM rel_errors WHERE errors <> ''"),
    "i08_document_verdicts": _ingest("SELECT * FROM verdicts"),
    "i10_resolve_entities": _ingest("SELECT * FROM resolved"),
    "i10_supersedes_edges": _ingest("SELECT entity_id AS src, supersedes_id AS dst, 'SUPERSEDES' AS rel_type FROM resolved WHERE supersedes_id IS NOT NULL"),
    "i12_resolve_relationships": _ingest("SELECT * FROM linked"),
    "i13_implicit_edges": _ingest("SELECT * FROM implicit"),
    "i14_ingestion_counts": _ingest("""
        SELECT document_id, entity_type AS metric, count(*) AS value FROM resolved GROUP BY 1, 2
        UNION ALL SELECT document_id, 'relationships', count(*) FROM (SELECT document_id FROM linked UNION ALL SELECT document_id FROM implicit) GROUP BY 1"""),
    "i15_document_status": _ingest("""
        SELECT document_id, CASE WHEN valid THEN 'PROCESSED' ELSE 'FAILED' END AS status, first_error AS error FROM verdicts"""),
    "i16_loadable_chunks": with_graph("SELECT id, length(chunk_text) AS chars FROM chunk WHERE regexp_replace(chunk_text, '\\s+', '', 'g') <> ''"),
    "i11_committed_graph": _ingest("""
        SELECT 'node' AS part, document_id AS id, 'Document' AS type, NULL AS other_id, CASE WHEN valid THEN 'PROCESSED' ELSE 'FAILED' END AS detail FROM verdicts
        UNION ALL SELECT 'node', entity_id, entity_type, NULL, head_property FROM resolved JOIN ent USING (document_id, ordinal, entity_type) WHERE action <> 'found_identical'
        UNION ALL SELECT 'edge', src, rel_type, dst, concat_ws('|', src_label, dst_label, status, extraction_id, props) FROM stored_edge
        UNION ALL SELECT 'extraction', id, entity_type, document_id, concat_ws('|', entity_id, model, section, page_number, page_number, page_number + 3) FROM entity_record
        UNION ALL SELECT 'extraction', extraction_id, NULL, document_id, concat_ws('|', model, section, page_number, page_number, page_number + 3) FROM link""", True),
    "s13_relationship_sources": _ingest("""
        , wanted AS (SELECT entity_id AS id FROM resolved JOIN ent USING (document_id, ordinal) WHERE resolved.entity_type = 'Risk' AND head_property = 'CRITICAL')
        SELECT src AS id, src, dst, rel_type, 'out' AS direction, section, page_number FROM stored_edge WHERE src IN (SELECT id FROM wanted)
        UNION ALL SELECT dst, src, dst, rel_type, 'in', section, page_number FROM stored_edge WHERE dst IN (SELECT id FROM wanted)""", True),
    "i18_purge": with_graph("""
        SELECT 'purged' AS what, count(*) AS rows FROM gone UNION ALL SELECT 'documents', count(*) FROM document WHERE id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT rel_type, count(*) FROM edge WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY 1""",
        gone="SELECT id FROM document WHERE status = 'FAILED' AND created_at < TIMESTAMP '2040-01-01' - INTERVAL 24 HOUR"),
    "i18_purge_failed": with_graph("SELECT id FROM document WHERE status = 'FAILED' AND created_at < TIMESTAMP '2000-01-01' - INTERVAL 24 HOUR"),
    "i20_rpn": with_graph("""
        SELECT id, CAST(r AS BIGINT) AS rpn, CASE WHEN r > 200 THEN 'CRITICAL' WHEN r >= 100 THEN 'HIGH' WHEN r >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
        FROM (SELECT id, coalesce(rpn, severity * occurrence * detection) AS r FROM failure_mode)"""),
}
