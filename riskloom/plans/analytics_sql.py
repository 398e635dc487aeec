"""Reference answers in SQL for the analytics, coverage and diagnostic queries."""

from __future__ import annotations

from riskloom.plans.graph_sql import with_graph

AS_OF = "2024-02-15"

_RISK_ROWS = """
    SELECT r.id, r.level, i.src AS fm, m.src AS ctl FROM risk r
    LEFT JOIN implies i ON i.dst = r.id LEFT JOIN mitigates_mode m ON m.dst = i.src"""
_FM_ROWS = """
    SELECT f.id, f.code, f.rpn, m.src AS ctl, i.dst AS rsk,
      CASE WHEN f.rpn IS NULL THEN 'unknown' WHEN f.rpn > 200 THEN 'critical' WHEN f.rpn > 100 THEN 'high'
           WHEN f.rpn > 50 THEN 'medium' ELSE 'low' END AS rpn_bucket
    FROM failure_mode f LEFT JOIN implies i ON i.src = f.id LEFT JOIN mitigates_mode m ON m.dst = f.id"""
_REACH = """
    SELECT c.id, c.control_type, c.effectiveness, count(DISTINCT i.dst) AS risk_count,
      count(DISTINCT s.src) > 0 AS has_steps
    FROM control c LEFT JOIN (mitigates_mode m JOIN implies i ON i.src = m.dst) ON m.src = c.id
    LEFT JOIN implements s ON s.dst = c.id GROUP BY ALL"""
_REQ_ROWS = """
    SELECT q.id, q.requirement_type, d.document_type,
      CASE l.t WHEN 'S' THEN 'satisfied' WHEN 'F' THEN 'failed' ELSE 'unknown' END AS state
    FROM requirement q
    LEFT JOIN (SELECT *, 'S' AS t FROM satisfies UNION ALL SELECT *, 'F' FROM fails_to_satisfy) l ON l.dst = q.id
    LEFT JOIN document d ON d.id = l.src"""
_PROC = """
    SELECT p.id AS process_id, p.name, p.version, p.name || ':' || p.version AS version_key,
      CAST(count(DISTINCT s.id) AS BIGINT) AS procedure_steps, count(DISTINCT s.id) > 0 AS has_procedures,
      CAST(count(DISTINCT x.risk_id) AS BIGINT) AS critical_risks
    FROM process p LEFT JOIN procedure_step s ON s.process_id = p.id
    LEFT JOIN (SELECT DISTINCT e.dst AS process_id, r.id AS risk_id FROM evaluates e JOIN uses u ON u.src = e.src
               JOIN identifies n ON n.src = u.dst JOIN implies i ON i.src = n.dst
               JOIN risk r ON r.id = i.dst AND r.level = 'CRITICAL') x ON x.process_id = p.id
    GROUP BY ALL"""
_LEVELS = "SELECT unnest(['LOW','MEDIUM','HIGH','CRITICAL','TOTAL']) AS k"
_PCT = "floor(coalesce(({0}) * 100.0 / nullif({1}, 0), 0) * 100 + 0.5) / 100"

_RISK_EXPOSURE = f"""
    SELECT k AS level, count(DISTINCT id) AS risks,
      count(DISTINCT id) - count(DISTINCT CASE WHEN ctl IS NOT NULL THEN id END) AS unmitigated,
      count(DISTINCT CASE WHEN fm IS NOT NULL THEN id END) AS implied,
      count(DISTINCT CASE WHEN fm IS NULL THEN id END) AS explicit,
      count(id) AS row_risks, count(CASE WHEN ctl IS NULL THEN id END) AS row_unmitigated,
      count(CASE WHEN fm IS NOT NULL THEN id END) AS row_implied, count(CASE WHEN fm IS NULL THEN id END) AS row_explicit
    FROM ({_LEVELS}) LEFT JOIN ({_RISK_ROWS}) x ON k = level OR k = 'TOTAL' GROUP BY k"""
_CONTROL_EFF = f"""
    SELECT k AS control_type, count(id) AS controls, coalesce(round(avg(effectiveness), 6), 0) AS avg_effectiveness,
      count(CASE WHEN effectiveness > 80 THEN 1 END) AS high_effectiveness,
      count(CASE WHEN effectiveness < 50 THEN 1 END) AS low_effectiveness,
      count(CASE WHEN has_steps THEN 1 END) AS with_steps, count(CASE WHEN NOT has_steps THEN 1 END) AS without_steps,
      CAST(coalesce(sum(risk_count), 0) AS BIGINT) AS row_risks_covered
    FROM (SELECT unnest(['PREVENTIVE','DETECTIVE','CORRECTIVE','TOTAL']) AS k)
    LEFT JOIN ({_REACH}) x ON k = control_type OR k = 'TOTAL' GROUP BY k"""
_COVERAGE = f"""
    SELECT total_risks, risks_covered, total_risks - risks_covered AS risks_uncovered,
      {_PCT.format('risks_covered', 'total_risks')} AS coverage_percentage, row_risks_covered,
      total_risks - row_risks_covered AS row_risks_uncovered,
      {_PCT.format('row_risks_covered', 'total_risks')} AS row_coverage_percentage
    FROM (SELECT (SELECT count(*) FROM risk) AS total_risks,
      (SELECT count(DISTINCT i.dst) FROM implies i JOIN mitigates_mode m ON m.dst = i.src) AS risks_covered,
      (SELECT CAST(sum(risk_count) AS BIGINT) FROM ({_REACH})) AS row_risks_covered)"""
_FM_ANALYSIS = f"""
    SELECT *, {_PCT.format('failure_modes - unmitigated', 'failure_modes')} AS mitigation_coverage,
      {_PCT.format('row_failure_modes - row_unmitigated', 'row_failure_modes')} AS row_mitigation_coverage
    FROM (SELECT k AS rpn_bucket, count(DISTINCT id) AS failure_modes,
        count(DISTINCT CASE WHEN ctl IS NULL THEN id END) AS unmitigated,
        count(id) AS row_failure_modes, count(CASE WHEN ctl IS NULL THEN id END) AS row_unmitigated
      FROM (SELECT unnest(['critical','high','medium','low','unknown','TOTAL']) AS k)
      LEFT JOIN ({_FM_ROWS}) x ON k = rpn_bucket OR k = 'TOTAL' GROUP BY k)"""
_FINDINGS = """
    SELECT 'status' AS dimension, k AS key, count(id) AS findings
    FROM (SELECT unnest(['OPEN','IN_PROGRESS','RESOLVED','CLOSED']) AS k) LEFT JOIN finding ON status = k GROUP BY k
    UNION ALL
    SELECT 'priority', k, count(id)
    FROM (SELECT unnest(['LOW','MEDIUM','HIGH','CRITICAL']) AS k) LEFT JOIN finding ON priority = k GROUP BY k"""
_DAYS = "(epoch_us(updated_at) - epoch_us(created_at)) / 86400000000.0"
_RESOLUTION = f"""
    SELECT total, resolved, round(coalesce(r30 * 100.0 / nullif(resolved, 0), 0), 6) AS last_30_days,
      round(coalesce(r90 * 100.0 / nullif(resolved, 0), 0), 6) AS last_90_days,
      round(coalesce(resolved * 100.0 / nullif(total, 0), 0), 6) AS all_time,
      coalesce(round(days, 6), 0) AS average_resolution_days
    FROM (SELECT count(*) AS total, count(*) FILTER (done) AS resolved,
        count(*) FILTER (done AND updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS r30,
        count(*) FILTER (done AND updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) AS r90,
        avg({_DAYS}) FILTER (done AND {_DAYS} > 0) AS days
      FROM (SELECT *, status IN ('RESOLVED', 'CLOSED') AS done FROM finding))"""
_COMPLIANCE = f"""
    SELECT dimension, key, count(DISTINCT id) AS requirements, count(id) AS row_requirements FROM (
      SELECT 'requirement_type' AS dimension, requirement_type AS key, id FROM ({_REQ_ROWS})
      UNION ALL SELECT 'state', state, id FROM ({_REQ_ROWS})
      UNION ALL SELECT 'document_type', document_type, id FROM ({_REQ_ROWS}) WHERE document_type IS NOT NULL
      UNION ALL SELECT 'all', 'TOTAL', id FROM ({_REQ_ROWS})
      UNION ALL SELECT 'requirement_type', unnest(['REGULATORY','COMPLIANCE','INTERNAL','INDUSTRY_STANDARD']), NULL
      UNION ALL SELECT 'state', unnest(['satisfied','failed','unknown']), NULL
      UNION ALL SELECT 'document_type', unnest(['fmea','ipar','hira','alert','fps','generic']), NULL
    ) GROUP BY ALL"""
_PROC_SUMMARY = f"""
    SELECT count(*) AS processes, count(*) FILTER (has_procedures) AS with_procedures,
      count(*) FILTER (NOT has_procedures) AS without_procedures,
      count(*) FILTER (critical_risks > 0) AS high_risk_processes FROM ({_PROC})"""


def _section(name: str, sql: str, key: str, metrics: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS section, '{m}' AS metric, {key} AS key, "
        f"floor(CAST({m} AS DOUBLE) * 10000 + 0.5) / 10000 AS value FROM ({sql})" for m in metrics.split())


_PORTFOLIO = " UNION ALL ".join([
    _section("risk_exposure", _RISK_EXPOSURE, "level",
             "risks unmitigated implied explicit row_risks row_unmitigated row_implied row_explicit"),
    _section("control_effectiveness", _CONTROL_EFF, "control_type",
             "controls avg_effectiveness high_effectiveness low_effectiveness with_steps without_steps row_risks_covered"),
    _section("control_coverage", _COVERAGE, "''",
             "total_risks risks_covered risks_uncovered coverage_percentage row_risks_covered row_risks_uncovered row_coverage_percentage"),
    _section("failure_mode_analysis", _FM_ANALYSIS, "rpn_bucket",
             "failure_modes unmitigated row_failure_modes row_unmitigated mitigation_coverage row_mitigation_coverage"),
    _section("finding_trends", _FINDINGS, "dimension || '/' || key", "findings"),
    _section("finding_resolution", _RESOLUTION, "''",
             "total resolved last_30_days last_90_days all_time average_resolution_days"),
    _section("compliance_status", _COMPLIANCE, "dimension || '/' || key", "requirements row_requirements"),
    _section("process_health", _PROC_SUMMARY, "''",
             "processes with_procedures without_procedures high_risk_processes"),
])

# Whole months m between two timestamps, then the days left over.
_MONTHS = """((year(updated_at) - year(created_at)) * 12 + month(updated_at) - month(created_at)
    - CASE WHEN (day(updated_at), CAST(updated_at AS TIME)) < (day(created_at), CAST(created_at AS TIME)) THEN 1 ELSE 0 END)"""
_DAY_COMPONENT = f"""(date_diff('day', CAST(CAST(created_at AS DATE) + to_months(CAST({_MONTHS} AS INT)) AS DATE), CAST(updated_at AS DATE))
    - CASE WHEN CAST(updated_at AS TIME) < CAST(created_at AS TIME) THEN 1 ELSE 0 END)"""

_LINKS = """
    SELECT entity_id, entity_type, source_document_id AS document_id, 'x' AS route FROM extraction
    UNION SELECT dst, 'FailureMode', src, 'i' FROM identifies"""
_DOC_ITEMS = """
    SELECT n.src AS document_id, 'risk' AS kind, i.dst AS entity_id, 1 AS branch FROM identifies n JOIN implies i ON i.src = n.dst
    UNION SELECT x.source_document_id, 'risk', m.dst, 2 FROM extraction x JOIN mitigates_risk m ON m.src = x.entity_id
    UNION SELECT source_document_id, 'risk', entity_id, 3 FROM extraction WHERE entity_type = 'Risk'
    UNION SELECT n.src, 'control', m.src, 1 FROM identifies n JOIN mitigates_mode m ON m.dst = n.dst
    UNION SELECT source_document_id, 'control', entity_id, 2 FROM extraction WHERE entity_type = 'Control'
    UNION SELECT src, 'failure_mode', dst, 1 FROM identifies
    UNION SELECT source_document_id, 'extracted', entity_id, 1 FROM extraction"""
_DOC_COVERAGE = f"""
    SELECT d.id AS document_id, d.file_name, d.document_type,
      count(DISTINCT entity_id) FILTER (kind = 'risk') AS risk_count,
      count(DISTINCT entity_id) FILTER (kind = 'control') AS control_count,
      count(DISTINCT entity_id) FILTER (kind = 'failure_mode') AS failure_mode_count,
      count(DISTINCT entity_id) FILTER (kind = 'extracted') AS extracted_entity_count,
      count(entity_id) FILTER (kind = 'risk') AS row_risk_count,
      count(entity_id) FILTER (kind = 'control') AS row_control_count
    FROM document d LEFT JOIN ({_DOC_ITEMS}) i ON i.document_id = d.id GROUP BY d.id, d.file_name, d.document_type"""
_MEMBERS = """
    SELECT 'identified' AS route, dst AS entity_id, 'FailureMode' AS entity_type, src AS document_id, NULL AS via FROM identifies
    UNION SELECT 'implied_risk', i.dst, 'Risk', n.src, NULL FROM identifies n JOIN implies i ON i.src = n.dst
    UNION SELECT 'controls', m.dst, 'Risk', x.source_document_id, m.src FROM extraction x JOIN mitigates_risk m ON m.src = x.entity_id
    UNION SELECT 'extracted', entity_id, entity_type, source_document_id, NULL FROM extraction"""
_MEMBER_CTES = {
    "members": _MEMBERS,
    "sizes": "SELECT route, entity_id, entity_type, count(DISTINCT document_id) AS documents FROM members GROUP BY ALL",
    "alike": """SELECT entity_id, via, count(*) AS n, 'controls' AS route FROM (
        SELECT entity_id, document_id, min(via) AS via FROM members WHERE route = 'controls' GROUP BY ALL HAVING count(*) = 1) GROUP BY ALL""",
}
_MATURITY = """
    SELECT d.id AS document_id, d.file_name, d.document_type,
      CASE WHEN count(DISTINCT s.src) > 0 THEN count(DISTINCT s.src) ELSE count(DISTINCT x.entity_id) END AS total_procedures,
      count(DISTINCT CASE WHEN f.id IS NOT NULL THEN x.entity_id END)
        + count(DISTINCT CASE WHEN f.id IS NOT NULL THEN s.src END) AS audited_procedures,
      count(DISTINCT CASE WHEN f.open THEN x.entity_id END) + count(DISTINCT CASE WHEN f.open THEN s.src END) AS non_compliant_count
    FROM document d LEFT JOIN extraction x ON x.source_document_id = d.id AND x.entity_type = 'Control'
    LEFT JOIN implements s ON s.dst = x.entity_id
    LEFT JOIN (SELECT DISTINCT r.dst, 'any' AS id, status IN ('OPEN', 'IN_PROGRESS') AS open FROM references_ r JOIN finding ON finding.id = r.src) f
      ON f.dst = x.entity_id
    GROUP BY d.id, d.file_name, d.document_type"""
_PROV = """
    SELECT x.entity_id, x.entity_type, x.id AS extraction_id, x.source_document_id, d.file_name, d.document_type,
      'extractor' AS extracted_by, x.extracted_at, x.confidence, x.section, x.page_number,
      x.page_number * 10 AS line_range_start, x.page_number * 10 + 5 AS line_range_end
    FROM extraction x JOIN document d ON d.id = x.source_document_id"""
_AUDIT_CHAIN = """FROM audit a LEFT JOIN evaluates e ON e.src = a.id LEFT JOIN process p ON p.id = e.dst
    LEFT JOIN uses u ON u.src = a.id LEFT JOIN identifies n ON n.src = u.dst"""


def _summary(levels: str, findings: str) -> str:
    return f"""
    SELECT a.id AS audit_id, p.id AS process_id, p.name AS process_name, p.version AS process_version,
      (SELECT count(DISTINCT dst) FROM uses WHERE src = a.id) AS documents,
      coalesce(c.failure_modes, 0) AS failure_modes, coalesce(c.high_risks, 0) AS high_risks,
      coalesce(c.controls, 0) AS controls, {findings} AS findings
    FROM audit a LEFT JOIN evaluates e ON e.src = a.id LEFT JOIN process p ON p.id = e.dst
    LEFT JOIN (SELECT u.src, count(DISTINCT n.dst) AS failure_modes, count(DISTINCT r.id) AS high_risks,
        count(DISTINCT m.src) AS controls
      FROM uses u JOIN identifies n ON n.src = u.dst LEFT JOIN implies i ON i.src = n.dst
      LEFT JOIN risk r ON r.id = i.dst AND r.level IN ({levels}) LEFT JOIN mitigates_mode m ON m.dst = n.dst
      GROUP BY u.src) c ON c.src = a.id
    LEFT JOIN (SELECT u.src, count(DISTINCT g.src) AS n FROM uses u JOIN identifies n ON n.src = u.dst
      JOIN addresses g ON g.dst = n.dst GROUP BY u.src) f ON f.src = a.id"""


_IMPLEMENTED = "(SELECT dst FROM implements)"
_C04 = f"""
    SELECT id, level, created_at FROM risk r
    WHERE NOT EXISTS (SELECT 1 FROM mitigates_risk m WHERE m.dst = r.id AND m.src IN {_IMPLEMENTED})
      AND NOT EXISTS (SELECT 1 FROM implies i JOIN mitigates_mode m ON m.dst = i.src
                      WHERE i.dst = r.id AND m.src IN {_IMPLEMENTED})"""
_C05 = f"""
    SELECT DISTINCT n.src AS document_id, m.src AS control_id FROM identifies n
    JOIN document d ON d.id = n.src AND d.document_type = 'ipar' JOIN mitigates_mode m ON m.dst = n.dst
    WHERE m.src NOT IN {_IMPLEMENTED}"""
_C06_CTES = {
    "operated": "SELECT DISTINCT s.process_id, i.dst AS control_id FROM procedure_step s JOIN implements i ON i.src = s.id",
    "covered": """SELECT DISTINCT o.process_id, m.dst FROM operated o
        JOIN (SELECT * FROM mitigates_mode UNION ALL SELECT * FROM mitigates_risk) m ON m.src = o.control_id""",
}
_C06 = """
    SELECT DISTINCT t.src AS document_id, t.dst AS process_id FROM relates_to t JOIN identifies n ON n.src = t.src
    JOIN implies i ON i.src = n.dst
    WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.process_id = t.dst AND (c.dst = n.dst OR c.dst = i.dst))"""
_C06_SAFE = """
    SELECT DISTINCT t.src AS document_id, t.dst AS process_id FROM relates_to t JOIN identifies n ON n.src = t.src
    JOIN implies i ON i.src = n.dst
    LEFT JOIN covered a ON a.process_id = t.dst AND a.dst = n.dst
    LEFT JOIN covered b ON b.process_id = t.dst AND b.dst = i.dst
    WHERE a.dst IS NULL AND b.dst IS NULL"""

ORACLES: dict[str, str] = {
    "a01_risk_exposure": with_graph(_RISK_EXPOSURE),
    "a01_unmitigated_critical_risks": with_graph(f"""
        SELECT id AS risk_id, level, count(*) AS row_count FROM ({_RISK_ROWS}) WHERE level = 'CRITICAL'
        GROUP BY id, level HAVING count(ctl) = 0"""),
    "a02_risk_trends": with_graph("""
        SELECT strftime(created_at, '%Y-%m-%d') AS date, level AS label, count(*) AS value FROM risk
        GROUP BY ALL"""),
    "a03_control_effectiveness": with_graph(_CONTROL_EFF),
    "a03_control_facts": with_graph(f"""
        SELECT id AS control_id, control_type, effectiveness, risk_count, has_steps FROM ({_REACH})"""),
    "a04_control_coverage": with_graph(_COVERAGE),
    "a05_failure_mode_analysis": with_graph(_FM_ANALYSIS),
    "a05_unmitigated_critical_failure_modes": with_graph(f"""
        SELECT id, code, CAST(rpn AS BIGINT) AS rpn FROM ({_FM_ROWS}) WHERE rpn_bucket = 'critical'
        GROUP BY ALL HAVING count(ctl) = 0"""),
    "a06_finding_trends": with_graph(_FINDINGS),
    "a07_finding_resolution": with_graph(_RESOLUTION),
    "a08_finding_resolution_trends": with_graph(f"""
        SELECT strftime(created_at, '%Y-%m-%d') AS created_date, strftime(updated_at, '%Y-%m-%d') AS date,
          CAST({_DAY_COMPONENT} AS BIGINT) AS resolution_days, count(*) AS value, 'Resolved' AS label
        FROM finding WHERE status IN ('RESOLVED', 'CLOSED')
        GROUP BY ALL"""),
    "a09_compliance_status": with_graph(_COMPLIANCE),
    "a09_compliance_gaps": with_graph(f"""
        SELECT id AS requirement_id, requirement_type, state, count(*) AS row_count FROM ({_REQ_ROWS})
        WHERE state <> 'satisfied' GROUP BY ALL"""),
    "a10_process_health": with_graph(_PROC),
    "a10_process_summary": with_graph(_PROC_SUMMARY),
    "a10_process_versions": with_graph("""
        SELECT name || ':' || version AS version_key, count(*) AS processes FROM process GROUP BY ALL"""),
    "a11_portfolio": with_graph(_PORTFOLIO),
    "a12_cross_document_entities": with_graph(f"""
        SELECT entity_id, max(entity_type) AS entity_type, count(DISTINCT document_id) AS document_count,
          count(*) AS row_document_count FROM ({_LINKS}) GROUP BY entity_id HAVING count(DISTINCT document_id) > 1"""),
    "a12_cross_document_links": with_graph(f"""
        SELECT DISTINCT l.entity_id, l.entity_type, l.document_id, d.file_name, d.document_type
        FROM ({_LINKS}) l JOIN document d ON d.id = l.document_id
        WHERE l.entity_id IN (SELECT entity_id FROM ({_LINKS}) GROUP BY 1 HAVING count(DISTINCT document_id) > 1)"""),
    "a12_cross_document_types": with_graph(f"""
        SELECT entity_type, count(*) AS entities FROM (SELECT entity_id, max(entity_type) AS entity_type
          FROM ({_LINKS}) GROUP BY 1 HAVING count(DISTINCT document_id) > 1) GROUP BY 1"""),
    "a13_document_coverage": with_graph(_DOC_COVERAGE),
    "a13_document_coverage_totals": with_graph(f"""
        SELECT count(*) AS documents, CAST(sum(risk_count) AS BIGINT) AS risks, CAST(sum(control_count) AS BIGINT) AS controls,
          CAST(sum(row_risk_count) AS BIGINT) AS row_risks, CAST(sum(row_control_count) AS BIGINT) AS row_controls
        FROM ({_DOC_COVERAGE})"""),
    "a13_document_coverage_items": with_graph(f"""
        SELECT DISTINCT document_id, kind, entity_id, coalesce(r.level, c.control_type) AS category
        FROM ({_DOC_ITEMS}) i LEFT JOIN risk r ON r.id = entity_id LEFT JOIN control c ON c.id = entity_id
        WHERE kind IN ('risk', 'control')"""),
    "a14_shared_entity_network": with_graph("""
        SELECT route, entity_id, entity_type, document_id, CASE WHEN route = 'controls' THEN count(*) ELSE 2 END AS n_via, min(via) AS via
        FROM members GROUP BY route, entity_id, entity_type, document_id""", **_MEMBER_CTES),
    "a14_entity_links": with_graph("""
        SELECT route, entity_id, entity_type, documents,
          CAST(documents * (documents - 1) // 2 - coalesce(x.n, 0) AS BIGINT) AS links
        FROM sizes s LEFT JOIN (SELECT route, entity_id, sum(n * (n - 1) // 2) AS n FROM alike GROUP BY ALL) x USING (route, entity_id)""", **_MEMBER_CTES),
    "a14_document_neighbours": with_graph("""
        SELECT a.document_id AS doc1_id, b.document_id AS doc2_id, count(DISTINCT a.entity_id) AS shared_count, count(DISTINCT (a.route, a.entity_id)) AS row_shared_count
        FROM members a JOIN members b ON a.route = b.route AND a.entity_id = b.entity_id AND a.document_id <> b.document_id AND (a.via IS NULL OR a.via <> b.via)
        WHERE a.document_id = (SELECT min(id) FROM document) GROUP BY ALL""", **_MEMBER_CTES),
    "a15_document_connections": with_graph("""
        SELECT m.document_id, count(*) AS membership_count, CAST(sum(s.documents - 1 - CASE WHEN m.k = 1 THEN coalesce(x.n, 1) - 1 ELSE 0 END) AS BIGINT) AS connection_count
        FROM (SELECT route, entity_id, document_id, CASE WHEN route = 'controls' THEN count(*) ELSE 2 END AS k, min(via) AS via FROM members GROUP BY 1, 2, 3) m
        JOIN (SELECT route, entity_id, sum(documents) AS documents FROM sizes GROUP BY ALL) s ON s.route = m.route AND s.entity_id = m.entity_id
        LEFT JOIN alike x ON x.route = m.route AND x.entity_id = m.entity_id AND x.via = m.via
        GROUP BY m.document_id""", **_MEMBER_CTES),
    "a16_entity_provenance": with_graph(_PROV),
    "a17_fps_maturity": with_graph(_MATURITY),
    "a18_standard_maturity": with_graph(f"""
        SELECT *, {_PCT.format('total_audited', 'total_procedures')} AS audit_coverage_percentage,
          {_PCT.format('total_non_compliant', 'total_procedures')} AS non_compliance_percentage
        FROM (SELECT 'ST' || right('000' || CAST(CAST(regexp_extract(file_name, 'ST\\s*0*(\\d+)', 1) AS INT) AS VARCHAR), 3) AS standard_code,
            count(*) AS documents, CAST(sum(total_procedures) AS BIGINT) AS total_procedures,
            CAST(sum(audited_procedures) AS BIGINT) AS total_audited, CAST(sum(non_compliant_count) AS BIGINT) AS total_non_compliant
          FROM ({_MATURITY}) WHERE file_name LIKE 'Safety ST%' GROUP BY 1)"""),
    "c01_risks_without_controls": with_graph("""
        SELECT id, level, created_at FROM risk WHERE id NOT IN (SELECT dst FROM mitigates_risk)"""),
    "c02_controls_without_steps": with_graph(f"""
        SELECT id, control_type, created_at FROM control WHERE id NOT IN {_IMPLEMENTED}"""),
    "c03_unmitigated_high_rpn": with_graph("""
        SELECT id, code, CAST(rpn AS BIGINT) AS rpn FROM failure_mode
        WHERE rpn > 100 AND id NOT IN (SELECT dst FROM mitigates_mode)"""),
    "c04_risks_without_procedure_controls": with_graph(_C04),
    "c05_ipar_control_gaps": with_graph(_C05),
    "c06_process_update_gaps": with_graph(_C06_SAFE, **_C06_CTES),
    "c_gap_counts": with_graph(f"""
        SELECT 'risks-without-controls' AS query, count(*) AS gaps FROM risk WHERE id NOT IN (SELECT dst FROM mitigates_risk)
        UNION ALL SELECT 'controls-without-steps', count(*) FROM control WHERE id NOT IN {_IMPLEMENTED}
        UNION ALL SELECT 'unmitigated-high-rpn', count(*) FROM failure_mode
          WHERE rpn > 100 AND id NOT IN (SELECT dst FROM mitigates_mode)
        UNION ALL SELECT 'risks-without-procedure-controls', count(*) FROM ({_C04})
        UNION ALL SELECT 'ipar-controls-coverage', count(*) FROM ({_C05})
        UNION ALL SELECT 'procedures-affected-by-ipar-update', count(*) FROM ({_C06_SAFE})""", **_C06_CTES),
    "d01_control_connectivity": with_graph("""
        SELECT count(*) AS total_controls, count(*) FILTER (r > 0) AS controls_linked_to_risks,
          count(*) FILTER (f > 0) AS controls_linked_to_failure_modes, count(*) FILTER (r = 0 AND f = 0) AS orphaned_controls
        FROM (SELECT c.id, (SELECT count(*) FROM mitigates_risk m WHERE m.src = c.id) AS r,
                (SELECT count(*) FROM mitigates_mode m WHERE m.src = c.id) AS f FROM control c)"""),
    "d02_risk_connectivity": with_graph("""
        SELECT count(*) AS total_risks, count(*) FILTER (d > 0) AS risks_with_direct_controls,
          count(*) FILTER (i > 0) AS risks_with_indirect_controls, count(*) FILTER (d = 0 AND i = 0) AS unmitigated_risks,
          count(*) FILTER (f = 0) AS standalone_risks
        FROM (SELECT r.id, count(DISTINCT m.src) AS d, count(DISTINCT i.src) AS f, count(DISTINCT m2.src) AS i
          FROM risk r LEFT JOIN mitigates_risk m ON m.dst = r.id LEFT JOIN implies i ON i.dst = r.id
          LEFT JOIN mitigates_mode m2 ON m2.dst = i.src GROUP BY r.id)"""),
    "d03_failure_mode_connectivity": with_graph("""
        SELECT count(*) AS total_failure_modes, count(*) FILTER (c > 0) AS mitigated_failure_modes,
          count(*) FILTER (c = 0) AS unmitigated_failure_modes, count(*) FILTER (r > 0) AS failure_modes_with_risks,
          count(*) FILTER (r = 0) AS orphaned_failure_modes
        FROM (SELECT f.id, count(DISTINCT m.src) AS c, count(DISTINCT i.dst) AS r FROM failure_mode f
          LEFT JOIN mitigates_mode m ON m.dst = f.id LEFT JOIN implies i ON i.src = f.id GROUP BY f.id)"""),
    "d04_requirement_connectivity": with_graph("""
        SELECT count(*) AS total_requirements, count(*) FILTER (s > 0) AS satisfied_requirements,
          count(*) FILTER (f > 0) AS failed_requirements, count(*) FILTER (s = 0 AND f = 0) AS unknown_requirements
        FROM (SELECT q.id, count(DISTINCT a.src) AS s, count(DISTINCT b.src) AS f FROM requirement q
          LEFT JOIN satisfies a ON a.dst = q.id LEFT JOIN fails_to_satisfy b ON b.dst = q.id GROUP BY q.id)"""),
    "d05_process_connectivity": with_graph("""
        SELECT count(*) AS total_processes, count(*) FILTER (s > 0) AS processes_with_steps,
          count(*) FILTER (s = 0) AS processes_without_steps, count(*) FILTER (d > 0) AS processes_with_documents,
          count(*) FILTER (d = 0) AS processes_without_documents
        FROM (SELECT p.id, (SELECT count(*) FROM procedure_step s WHERE s.process_id = p.id) AS s,
          (SELECT count(*) FROM evaluates e JOIN uses u ON u.src = e.src WHERE e.dst = p.id) AS d FROM process p)"""),
    "d06_relationship_counts": with_graph("SELECT rel_type, count(*) AS edges FROM edge GROUP BY 1"),
    "d07_audit_summary_served": with_graph(_summary("'HIGH'", "(SELECT count(*) FROM finding)")),
    "d08_audit_summary": with_graph(_summary("'HIGH', 'CRITICAL'", "coalesce(f.n, 0)")),
    "d08_audit_documents": with_graph("""
        SELECT u.src AS audit_id, d.id AS document_id, d.document_type, d.created_at AS uploaded_at
        FROM uses u JOIN document d ON d.id = u.dst"""),
    "d09_audit_relationship_stats": with_graph("""
        SELECT u.src AS audit_id, count(DISTINCT x.fm) || '->' || count(DISTINCT x.risk_id) AS fm_to_risk,
          count(DISTINCT m.src) || '->' || count(DISTINCT x.fm) AS control_to_fm
        FROM uses u LEFT JOIN (SELECT n.src AS doc, n.dst AS fm, i.dst AS risk_id FROM identifies n JOIN implies i ON i.src = n.dst) x
          ON x.doc = u.dst LEFT JOIN mitigates_mode m ON m.dst = x.fm GROUP BY u.src"""),
    "d10_ontology_stats": with_graph("""
        SELECT type AS metric, count(*) AS value FROM entity WHERE type NOT IN ('ProcedureStep', 'Incident') GROUP BY 1
        UNION ALL SELECT 'total_entities', count(*) FROM entity WHERE type NOT IN ('ProcedureStep', 'Incident')
        UNION ALL SELECT 'high_risk_failure_modes', count(*) FROM failure_mode WHERE rpn > 100
        UNION ALL SELECT 'open_findings', count(*) FROM finding WHERE status = 'OPEN'"""),
}
