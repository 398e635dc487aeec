"""Reference answers in SQL for the segmentation, chunking and evaluation queries."""

from __future__ import annotations

from riskloom.plans.graph_catalog_sql import _SHEET_LINES, _CELLS, _VEC
from riskloom.plans.graph_sql import with_graph
from riskloom.sources.ground_truth import GROUND_TRUTH

_WS = "' ' || chr(9) || chr(10) || chr(13)"
_STRIP = "trim({0}, " + _WS + ")"


def _strip(column: str) -> str:
    return _STRIP.format(column)


def _lines_cte(text_sql: str) -> str:
    """(doc_id, i, line) with 0-based line numbers."""
    return f"""SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM ({text_sql})"""


def _marked(head: str, mark: str) -> str:
    return f"SELECT doc_id, {head} || regexp_replace(text, '\\n([AEIOU])', {mark}, 'g') AS text FROM documents"


_NL = "chr(10)"
_IPAR_TEXT = _marked(f"'Processo: ' || source || {_NL} || 'Unidade: ' || lang || {_NL} || 'Resumo geral' || repeat({_NL}, 4)",
                     f"{_NL} || 'Ruído e queda: \\1'")
_HIRA_TEXT = _marked(f"'Area: ' || source || {_NL} || 'Activity: work ' || lang || {_NL} || 'Summary of the assessment' || repeat({_NL}, 4)",
                     f"{_NL} || '3. High exposure \\1'")
_ALERT_TEXT = _marked(f"'Alert: A-' || doc_id || {_NL} || 'Location: ' || source || {_NL} || 'Summary' || repeat({_NL}, 3)",
                      f"{_NL} || 'Root cause:' || {_NL} || '\\1'")
_FPS_TEXT = _marked("''", f"{_NL} || '1. Escopo' || {_NL} || '\\1'")
_IPAR_HAZARDS = ("ruído|vibração|queda|atropelamento|aprisionamento|projeção|queimadura|choque|esmagamento|exposição|inalação|contato|corte|"
                 "perfuração|explosão|incêndio|intoxicação|radiação|ergonômico|ergonomico|temperatura|pressão|elétrico|eletrico|químico|"
                 "quimico|biológico|biologico|mecânico|mecanico|físico|fisico")
_IPAR_CLASSES = "intolerável|intoleravel|moderado|trivial|tolerável|toleravel"
_HIRA_HAZARDS = ("hazard|risk|danger|harm|injury|fatality|perigo|risco|lesão|acidente|fatalidade|chemical|electrical|mechanical|biological|"
                 "physical|químico|elétrico|mecânico|biológico|físico|fall|slip|trip|crush|burn|cut|queda|escorregão|tropeço|esmagamento|"
                 "queimadura|corte")
_HIRA_SEVERITIES = "catastrophic|critical|major|minor|negligible|high|medium|low"
_HIRA_LIKELIHOODS = "frequent|probable|occasional|remote|improbable|likely|unlikely"


def _first_word(column: str, words: str) -> str:
    """The first word of the list inside the text, capitalised; null when there is none."""
    listed = ", ".join(f"'{w}'" for w in words.split("|"))
    found = f"list_filter([{listed}], lambda k: contains(lower({column}), k))[1]"
    return f"(upper(substr({found}, 1, 1)) || substr({found}, 2))"


def _hazard_sql(text_sql: str, hazards: str, fields: tuple[str, str], process: str, head: str, head_type: str, head_section: str,
                prefix: str, line: str, kind: str, context: str, paragraph: tuple[str, str]) -> str:
    """Header and blocks by explicit line numbering; block starts come from a reduction over candidates.
    f1 and f2 are the two header fields, from the last line that carries them."""
    field = lambda words: (f"arg_max({_strip(f"regexp_extract(line, '(?i)({words})[:\\s]*([^\\n]+)', 2)")}, i) "
                           f"FILTER (regexp_matches(line, '(?i)({words})[:\\s]*([^\\n]+)') AND i < h + (hit IS NOT NULL)::INT)")
    return f"""
    WITH texts AS ({text_sql}), lines AS ({_lines_cte('SELECT doc_id, text FROM texts')}),
    flagged AS (SELECT *, length({_strip('line')}) >= 3 AND regexp_matches(lower({_strip('line')}),
        '^((item\\s*:?\\s*)?\\d+[\\s.:]+\\w+|.{{0,39}}({hazards}))') AS b FROM lines),
    limits AS (SELECT doc_id, min(i) FILTER (b AND i > 5 AND i < 30) AS hit, coalesce(hit, least(count(*), 30)) AS h, count(*) AS n
      FROM flagged GROUP BY doc_id),
    heads AS (SELECT doc_id, {field(fields[0])} AS f1, {field(fields[1])} AS f2, h, n FROM flagged JOIN limits USING (doc_id) GROUP BY doc_id, h, n),
    body AS (SELECT f.doc_id, i - h AS j, line, b FROM flagged f JOIN heads USING (doc_id) WHERE i >= h),
    starts AS (SELECT doc_id, list_reduce(list_prepend([CAST(0 AS BIGINT)], list([CAST(j AS BIGINT)] ORDER BY j) FILTER (b)),
        lambda a, x: CASE WHEN x[1] - a[-1] > 3 THEN list_concat(a, x) ELSE a END) AS s FROM body GROUP BY doc_id),
    spans AS (SELECT doc_id, a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), n - h) AS z, h, f1, f2
      FROM (SELECT doc_id, unnest(s) AS a FROM starts) JOIN heads USING (doc_id)),
    blocks AS (SELECT s.doc_id, a, z, h, f1, f2, {_strip("string_agg(line, chr(10) ORDER BY j)")} AS t
      FROM spans s JOIN body b ON b.doc_id = s.doc_id AND b.j >= a AND b.j < z GROUP BY ALL),
    named AS (SELECT *, {line} FROM blocks WHERE length(t) > 0),
    full_blocks AS (SELECT *, {prefix} || chr(10) || {kind[1]} AS text FROM named),
    header AS (SELECT doc_id, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS text, h, f1, f2
      FROM flagged JOIN heads USING (doc_id) WHERE i < h GROUP BY ALL),
    paragraphs AS (SELECT doc_id, f1, f2, p, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS k FROM (
      SELECT doc_id, f1, f2, unnest(string_split_regex(t, '\\n\\n+')) AS p, generate_subscripts(string_split_regex(t, '\\n\\n+'), 1) AS k
      FROM (SELECT doc_id, f1, f2, string_agg(line, chr(10) ORDER BY j) AS t FROM body JOIN heads USING (doc_id)
            WHERE doc_id NOT IN (SELECT doc_id FROM named) GROUP BY ALL)) WHERE length({_strip('p')}) > 0),
    segments AS (
      SELECT doc_id, -1 AS o, text, '{head_type}' AS semantic_type, {head} AS context, '{head_section}' AS section, 1 AS line_start, h AS line_end
        FROM header WHERE length(text) > 0
      UNION ALL SELECT doc_id, a, text, '{kind[0]}', {context}, {process}, h + 1 + a, h + z FROM full_blocks
      UNION ALL SELECT doc_id, k, {prefix} || chr(10) || chr(10) || {_strip('p')}, '{paragraph[0]}', '{paragraph[1]} ' || (k + 1), {process},
        k * 5, k * 5 + length(p) - length(replace(p, chr(10), '')) + 1 FROM paragraphs)
    SELECT doc_id, text, semantic_type, context, section, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS segment_index,
      CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end FROM segments"""


_IPAR = _hazard_sql(
    _IPAR_TEXT, _IPAR_HAZARDS, ("processo|process", "unidade|unit"), "f1", "'IPAR: ' || f1", "ipar_audit_header", "Cabeçalho",
    "'Processo: ' || f1 || ' | Unidade: ' || f2",
    f"coalesce({_first_word('t', _IPAR_HAZARDS)}, 'Não identificado') AS hz, {_first_word('t', _IPAR_CLASSES)} AS cl",
    ("ipar_hazard_block", "'Perigo: ' || hz || coalesce(' | Classificação: ' || cl, '') || chr(10) || chr(10) || t"),
    "'Perigo: ' || hz || coalesce(' (' || cl || ')', '')", ("ipar_paragraph", "Parágrafo"))
_HIRA = _hazard_sql(
    _HIRA_TEXT, _HIRA_HAZARDS, ("area|department|setor|área", "activity|task|atividade|tarefa"), "f2", "'HIRA: ' || f1 || ' - ' || f2", "hira_header", "Header",
    "'Area: ' || f1 || ' | Activity: ' || f2",
    f"coalesce({_first_word('t', _HIRA_HAZARDS)}, 'Unidentified') AS hz, "
    f"nullif(concat_ws(' / ', {_first_word('t', _HIRA_SEVERITIES)}, {_first_word('t', _HIRA_LIKELIHOODS)}), '') AS cl",
    ("hira_hazard_block", "'Hazard: ' || hz || coalesce(' | Risk: ' || cl, '') || chr(10) || chr(10) || t"),
    "'Hazard: ' || hz || coalesce(' (' || cl || ')', '')", ("hira_paragraph", "Paragraph"))

# Titles in the alert texts are the inserted 'Root cause:' lines and whatever else the rules accept.
_ALERT_TITLES = ("description|descrição|descrição do evento|root cause|causa raiz|causa principal|contributing factors|fatores contribuintes|"
                 "corrective action|ação corretiva|medidas corretivas|lesson learned|lição aprendida|aprendizado|recommendation|recomendação|"
                 "recomendações|timeline|cronologia|sequência de eventos|impact|impacto|consequências|investigation|investigação|análise")
_ALERT_LABEL = "regexp_extract(line, '^(?:\\d+[\\.\\)]\\s*)?([A-Za-zÀ-ú\\s]+)[:.\\s]*$', 1)"
_ALERT = f"""
    WITH lines AS ({_lines_cte(_ALERT_TEXT)}),
    titled AS (SELECT *, CASE WHEN length({_strip('line')}) BETWEEN 3 AND 100 THEN
        CASE WHEN regexp_matches(lower({_ALERT_LABEL}), '{_ALERT_TITLES}') THEN {_strip(_ALERT_LABEL)}
             WHEN regexp_matches(lower({_strip('line')}), '^({_ALERT_TITLES})') AND length({_strip('line')}) < 60 THEN {_strip('line')} END END AS title FROM lines),
    heads AS (SELECT doc_id, coalesce(min(i) FILTER (title IS NOT NULL AND i > 3 AND i < 25), least(count(*), 25)) AS h FROM titled GROUP BY 1),
    searched AS (SELECT t.doc_id, source, h FROM heads t JOIN documents USING (doc_id)),
    body AS (SELECT doc_id, i, line, title, h, source, count(title) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM titled JOIN searched USING (doc_id) WHERE i >= h),
    sections AS (SELECT doc_id, g, h, source, coalesce(max(title), 'Introduction') AS title, min(i) + 1 AS line_start, max(i) + 1 AS line_end,
        {_strip("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (title IS NULL), '')")} AS t FROM body GROUP BY doc_id, g, h, source),
    full_sections AS (SELECT *, 'Alert: A-' || doc_id || ' | Location: ' || source || chr(10) || 'Section: ' || title || chr(10) || chr(10) || t AS text
      FROM sections WHERE length(t) > 0),
    segments AS (
      SELECT doc_id, -1 AS o, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS text, 'alert_header' AS semantic_type, 'Alert: A-' || doc_id AS context,
        'Header' AS section, 1 AS line_start, h AS line_end FROM titled JOIN heads USING (doc_id) WHERE i < h GROUP BY doc_id, h
      UNION ALL SELECT doc_id, g, text, CASE WHEN contains(lower(title), 'root cause') THEN 'alert_root_cause' ELSE 'alert_section' END,
        title, title, line_start, line_end FROM full_sections
      UNION ALL SELECT doc_id, 0, 'Alert: A-' || doc_id || chr(10) || chr(10) || {_strip('t')}, 'alert_paragraph', 'Paragraph 1', 'Content', 0,
        length(t) - length(replace(t, chr(10), '')) + 1 FROM (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM body
          WHERE doc_id NOT IN (SELECT doc_id FROM full_sections) GROUP BY 1) WHERE length({_strip('t')}) > 0)
    SELECT doc_id, text, semantic_type, context, section, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS segment_index,
      CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end FROM segments WHERE length(text) > 0"""

_FPS_TITLE = """length(line) BETWEEN 3 AND 100 AND (regexp_matches(line, '^\\d+\\.?\\s*[–\\-:.]?\\s*[A-ZÁÊÔÇ]')
    OR regexp_matches(lower(line), '^(escopo|definições|procedimentos|responsabilidades|objetivo|anexo)'))"""
_FPS = f"""
    WITH lines AS (SELECT doc_id, i, {_strip('line')} AS line FROM ({_lines_cte(_FPS_TEXT)})),
    grouped AS (SELECT *, count(*) FILTER ({_FPS_TITLE}) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines),
    sections AS (SELECT doc_id, g, arg_min(line, i) AS title, min(i) AS a, max(i) AS z, string_agg(line, chr(10) ORDER BY i) AS text
      FROM grouped WHERE g > 0 GROUP BY 1, 2),
    kept AS (SELECT *, CASE WHEN contains(lower(title), 'escopo') THEN 'fps_scope' WHEN contains(lower(title), 'procedimento') THEN 'fps_procedures'
        WHEN contains(lower(title), 'responsabilidade') THEN 'fps_responsibilities' WHEN contains(lower(title), 'objetivo') THEN 'fps_objective'
        WHEN contains(lower(title), 'anexo') THEN 'fps_appendix' ELSE 'fps_section' END AS kind
      FROM sections WHERE length({_strip('text')}) > 0
      UNION ALL SELECT doc_id, 0, 'Introduction', 0, max(i), string_agg(line, chr(10) ORDER BY i), 'fps_section' FROM grouped
        WHERE g = 0 AND doc_id IN (SELECT doc_id FROM sections) GROUP BY 1 HAVING length({_strip("string_agg(line, chr(10) ORDER BY i)")}) > 0)
    SELECT doc_id, text, kind AS semantic_type, title AS context, title AS section,
      row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS segment_index, a AS line_start, z AS line_end FROM kept
    UNION ALL SELECT doc_id, text, 'fps_document', 'FPS Document', 'Full Document', 0, NULL, NULL
      FROM ({_FPS_TEXT}) WHERE doc_id NOT IN (SELECT doc_id FROM kept)"""

_GENERIC = f"""
    WITH parts AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS k,
        len(string_split(text, chr(10))) AS n FROM documents),
    kept AS (SELECT *, {_strip('p')} AS t, CASE WHEN k = 1 THEN source ELSE 'part' END AS heading FROM parts)
    SELECT doc_id, t AS text, 'paragraph' AS semantic_type, 'Section: ' || heading AS context, heading AS section,
      row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS segment_index, CAST(3 AS BIGINT) AS line_start, CAST(4 AS BIGINT) AS line_end
    FROM kept WHERE length(t) > 0 AND n > 1
    UNION ALL SELECT doc_id, t, 'paragraph', 'Section: Document', 'Document',
      row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1, CASE WHEN part = 0 THEN 1 ELSE 3 END, CASE WHEN part = 0 THEN 2 ELSE 4 END
    FROM (SELECT doc_id, 1 AS part, t FROM kept WHERE n = 1) WHERE length(t) > 0"""
_PARAGRAPHS = f"""
    SELECT doc_id, t AS text, 'paragraph' AS semantic_type, 'Section: Document' AS context, 'Document' AS section,
      CAST(0 AS BIGINT) AS segment_index, CAST(1 + lead_lines AS BIGINT) AS line_start,
      1 + lead_lines + length(t) - length(replace(t, chr(10), '')) + 1 AS line_end
    FROM (SELECT doc_id, {_strip('text')} AS t, length(regexp_extract(text, '^\\s*')) - length(replace(regexp_extract(text, '^\\s*'), chr(10), '')) AS lead_lines
          FROM documents) WHERE length(t) > 0"""

_FMEA = f"""
    WITH lines AS ({_SHEET_LINES}), parsed AS ({_CELLS}),
    heads AS (SELECT doc_id, sheet, cells AS head FROM parsed WHERE row = 0),
    filled AS (SELECT p.doc_id, p.sheet, row, len(list_filter(cells, lambda c: c <> '')) = 0 AS is_empty, nullif(cells[1], '') AS process,
        array_to_string(list_filter(list_transform(range(1, least(len(head), len(cells)) + 1),
          lambda x: CASE WHEN cells[x] <> '' THEN head[x] || ': ' || cells[x] END), lambda s: s IS NOT NULL), ' | ') AS line
      FROM parsed p JOIN heads h ON h.doc_id = p.doc_id AND h.sheet = p.sheet WHERE row > 0),
    carried AS (SELECT *, last_value(process IGNORE NULLS) OVER (PARTITION BY doc_id, sheet ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM filled),
    changed AS (SELECT *, process IS NOT NULL AND process IS DISTINCT FROM prev AS change FROM carried),
    grouped AS (SELECT *, count(*) FILTER (change) OVER w AS g, count(*) FILTER (is_empty) OVER w AS e,
        coalesce(max(CASE WHEN change THEN row + 1 END) OVER w, 1) AS start FROM changed WINDOW w AS (PARTITION BY doc_id, sheet ORDER BY row)),
    groups AS (SELECT doc_id, sheet, g, e, min(start) AS a, count(*) AS n, string_agg(line, chr(10) ORDER BY row) AS text FROM grouped
      WHERE NOT is_empty GROUP BY ALL)
    SELECT doc_id, text, 'fmea_row_group' AS semantic_type, 'Sheet: ' || sheet || ', Row ' || a || CASE WHEN n > 1 THEN '-' || (a + n - 1) ELSE '' END AS context,
      'Sheet: ' || sheet AS section, row_number() OVER (PARTITION BY doc_id ORDER BY sheet = 'notes', g, e) - 1 AS segment_index,
      CAST(a AS BIGINT) AS line_start, CAST(a + n - 1 AS BIGINT) AS line_end FROM groups"""

_ELEMENTS = """
    WITH lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents),
    typed AS (SELECT *, CASE WHEN length(text) < 60 THEN 'Title' WHEN regexp_matches(text, '[0-9]') THEN 'Table' ELSE 'NarrativeText' END AS type,
        position // 10 + 1 AS page FROM lines),
    counted AS (SELECT *, count(*) FILTER (type = 'Title') OVER w AS s, count(*) FILTER (type IN ('Title', 'Table')) OVER w AS c
      FROM typed WINDOW w AS (PARTITION BY document_id ORDER BY position)),
    parts AS (SELECT document_id, s, type = 'Table' AS tab, min(position) AS first_position, min(page) AS page,
        string_agg(text, chr(10) || chr(10) ORDER BY position) AS text FROM counted GROUP BY document_id, s, c, type = 'Table')
    SELECT p.document_id, first_position, p.text, CASE WHEN tab THEN 'fps_table' ELSE 'fps_section' END AS semantic_type,
      coalesce({0}, CASE WHEN tab THEN 'Table' ELSE 'FPS Document' END) AS context, coalesce({0}, CASE WHEN tab THEN 'Table' ELSE 'Body' END) AS section,
      CASE WHEN tab THEN p.page ELSE coalesce(t.page, 1) END AS page
    FROM parts p LEFT JOIN (SELECT document_id, s, text, page FROM counted WHERE type = 'Title') t ON t.document_id = p.document_id AND t.s = p.s
    WHERE tab OR length({1}) > 0""".format(_strip("t.text"), _strip("p.text"))

# Walks all documents line by line at once; state is the open chunk.
_FIXED = """
    WITH RECURSIVE docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    walk AS (
      SELECT doc_id, ls, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS k,
        CAST(NULL AS BIGINT) AS ended, CAST(NULL AS BIGINT) AS ended_start FROM docs
      UNION ALL
      SELECT doc_id, ls, i + 1, CASE WHEN cut THEN i - o ELSE a END,
        CASE WHEN cut THEN CAST(ceil(length(array_to_string(ls[i - o + 1:i], chr(10))) / 4.0) AS BIGINT) ELSE tokens END + cost,
        k + cut::BIGINT, CASE WHEN cut THEN i END, CASE WHEN cut THEN a END
      FROM (SELECT *, CASE WHEN cut THEN len(list_filter(range(1, least(i - a, 60) + 1), lambda m: list_sum(list_transform(ls[i - m + 1:i],
              lambda s: ceil(length(s) / 4.0))) <= 50)) ELSE 0 END AS o
            FROM (SELECT *, CAST(ceil((length(ls[i + 1]) + 1) / 4.0) AS BIGINT) AS cost,
                    tokens + CAST(ceil((length(ls[i + 1]) + 1) / 4.0) AS BIGINT) > 512 AND i > a AS cut
                  FROM walk WHERE i < len(ls)))),
    spans AS (SELECT doc_id, ls, k - 1 AS chunk_index, ended_start AS a, ended AS z FROM walk WHERE ended IS NOT NULL
      UNION ALL SELECT doc_id, ls, k, a, i FROM walk WHERE i = len(ls))
    SELECT doc_id, array_to_string(ls[a + 1:z], chr(10)) AS text, chunk_index,
      CAST(ceil(length(array_to_string(ls[a + 1:z], chr(10))) / 4.0) AS BIGINT) AS tokens, a + 1 AS line_start, z AS line_end FROM spans"""

_OUTLINE = f"""
    WITH lines AS (SELECT doc_id, i + 1 AS line_no, {_strip('line')} AS line FROM ({_lines_cte(_FPS_TEXT)})),
    hits AS (SELECT doc_id, line_no, line AS heading, CASE WHEN regexp_matches(line, '^\\d+\\.\\d+\\.') THEN 3 WHEN regexp_matches(line, '^\\d+\\.\\d+') THEN 2
        WHEN regexp_matches(line, '^\\d+\\.') OR regexp_matches(line, '^[A-ZÁÊÔ\\s]{{5,}}$') THEN 1 ELSE 2 END AS level
      FROM lines WHERE length(line) >= 3 AND regexp_matches(line, '^\\d+\\.\\d*\\s+[A-ZÁÊÔ]|^[A-ZÁÊÔ][a-záêô]+\\s*:|^[A-ZÁÊÔ\\s]{{3,}}$|^[IVX]+\\.\\s+[A-Z]')
      UNION ALL SELECT doc_id, line_no, regexp_extract(line, '^(\\d+)\\.(\\d*)\\s+(.+)$', 3),
        CASE WHEN regexp_extract(line, '^(\\d+)\\.(\\d*)\\s+(.+)$', 2) <> '' THEN 2 ELSE 1 END
      FROM lines WHERE length(line) >= 3 AND regexp_matches(line, '^(\\d+)\\.(\\d*)\\s+(.+)$'))
    SELECT doc_id, line_no AS line, heading, CAST(level AS BIGINT) AS level FROM hits"""

# --- evaluation ----------------------------------------------------------------------------------------
_GOLDEN = """SELECT doc_id AS question_id, CASE WHEN doc_id % 11 = 5 THEN ' short? ' ELSE 'What does it say in document ' || doc_id END AS question,
      ['factoid','contextual','multi-span','riddle'][CAST(doc_id % 4 + 1 AS INT)] AS type, doc_id % 5 + 1 AS a, doc_id % 5 + 2 AS z,
      len(string_split(text, chr(10))) AS line_count,
      CASE WHEN doc_id % 7 = 6 THEN [] ELSE list_filter(string_split_regex(text, '[.\\n]'), lambda x: trim(x) <> '') END AS facts FROM documents"""
_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: length(w) > 2))"
_RETRIEVED = f"""SELECT question_id, line_no, text, rank FROM (
      SELECT question_id, i + 1 AS line_no, line AS text, row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, i) AS rank FROM (
        SELECT g.question_id, l.i, l.line, len(list_intersect(g.words, {_WORDS.format('l.line')})) AS shared FROM lines l
        JOIN (SELECT question_id, {_WORDS.format("array_to_string(facts, ' ')")} AS words FROM golden) g ON g.question_id = l.doc_id) WHERE shared > 0) WHERE rank <= 5"""
_FIRST = """SELECT q.question_id, min(rank) AS first_rank, min(rank) IS NOT NULL AS hit FROM golden q
    LEFT JOIN got r ON r.question_id = q.question_id AND r.line_no BETWEEN q.a AND q.z GROUP BY 1"""
_IOU = """SELECT question_id, CASE WHEN len(f) = 0 THEN 0.0 ELSE round(len(list_intersect(f, g)) / len(list_distinct(list_concat(f, g))), 6) END AS token_iou
    FROM (SELECT question_id, list_distinct(list_filter(string_split_regex(lower(array_to_string(facts, ' ')), '\\s+'), lambda w: length(w) > 2)) AS f FROM golden)
    LEFT JOIN (SELECT question_id, list_distinct(list_filter(string_split_regex(lower(string_agg(text, ' ')), '\\s+'), lambda w: length(w) > 2)) AS g FROM got GROUP BY 1) USING (question_id)"""
_SCORES = "SELECT * FROM first_hits JOIN ious USING (question_id)"
_METRICS = """round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_1, round(avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_3,
    round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_5, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr,
    round(avg(token_iou), 6) AS avg_token_iou, count(*) AS questions"""


def _retrieval(sql: str) -> str:
    return (f"WITH lines AS ({_lines_cte('SELECT doc_id, text FROM documents')}), golden AS ({_GOLDEN}), got AS ({_RETRIEVED}), "
            f"first_hits AS ({_FIRST}), ious AS ({_IOU}), scores AS ({_SCORES}) {sql}")


_FINDINGS = f"""
    WITH lines AS ({_lines_cte('SELECT doc_id, text FROM documents')}),
    facts AS (SELECT doc_id AS document_id, i AS fact_id, line AS fact,
        list_distinct(list_filter(string_split_regex(lower(line), '\\s+'), lambda w: length(w) > 2)) AS ws FROM lines),
    kept AS (SELECT doc_id AS document_id, list_distinct(string_split_regex(lower(string_agg(line, ' ')), '\\s+')) AS present
      FROM lines WHERE line NOT LIKE 'E%' GROUP BY 1),
    findings AS (SELECT document_id, fact_id, fact, len(ws) > 0 AND len(list_filter(ws, lambda w: NOT list_contains(coalesce(present, []), w))) = 0 AS found
      FROM facts LEFT JOIN kept USING (document_id))"""
_RUNS = """WITH runs AS (SELECT *, floor((0.5 * (h1 * 0.3 + h3 * 0.3 + mrr * 0.4)
        + 0.3 * (unity / 5 * 0.4 + clean * 0.3 + alone / 5 * 0.3) + 0.2 * kept) * 1000 + 0.5) / 1000 AS overall_score
      FROM (SELECT event_id // 2 AS document_id, CASE WHEN event_id % 2 = 0 THEN 'semantic' ELSE 'fixed' END AS chunker_type,
        CAST(event_id % 11 AS DOUBLE) / 10 AS h1, least(CAST(event_id % 11 AS DOUBLE) / 10 + CAST(0.1 AS DOUBLE), 1.0) AS h3, CAST(user_id % 9 AS DOUBLE) / 8 AS mrr,
        CAST(1 + user_id % 5 AS DOUBLE) AS unity, CAST(event_id % 7 AS DOUBLE) / 8 AS clean, CAST(1 + event_id % 5 AS DOUBLE) AS alone,
        CAST(user_id % 4 AS DOUBLE) / 4 AS kept FROM events))"""
_R3 = "floor(({0}) * 1000 + 0.5) / 1000"
_COMPARE = f"""SELECT s.document_id, s.overall_score AS semantic_score, f.overall_score AS fixed_score,
      {_R3.format('s.mrr - f.mrr')} AS retrieval_delta, {_R3.format('s.unity / 5 - f.unity / 5')} AS intrinsic_delta,
      {_R3.format('s.kept - f.kept')} AS preservation_delta, {_R3.format('s.overall_score - f.overall_score')} AS overall_delta,
      CASE WHEN abs(s.overall_score - f.overall_score) < 0.02 THEN 'tie' WHEN s.overall_score > f.overall_score THEN 'semantic' ELSE 'fixed' END AS winner
    FROM runs s JOIN runs f USING (document_id) WHERE s.chunker_type = 'semantic' AND f.chunker_type = 'fixed'"""

# Expected entities per evaluation question.
_ALL_OF = {5: "failure_mode", 6: "risk", 9: "control", 10: "failure_mode", 15: "failure_mode", 16: "risk", 19: "control"}
_EXPECTED = " UNION ALL ".join(
    [f"SELECT {q} AS question_id, id FROM {table}" for q, table in _ALL_OF.items()] + [
        "SELECT 1, id FROM control WHERE contains(lower(description), 'queda')",
        "SELECT 3, id FROM requirement_text WHERE contains(lower(description), 'emergência')",
        "SELECT 8, id FROM requirement WHERE id IN (SELECT dst FROM satisfies)",
        "SELECT 11, id FROM failure_mode WHERE severity >= 7 AND id IN (SELECT dst FROM mitigates_mode)",
        "SELECT 12, id FROM risk WHERE contains(lower(description), 'queda')",
        "SELECT 13, id FROM finding WHERE id IN (SELECT src FROM references_)",
        "SELECT 14, id FROM audit WHERE id IN (SELECT src FROM uses)",
        "SELECT 17, id FROM failure_mode WHERE rpn > 100",
        "SELECT 18, id FROM document WHERE id IN (SELECT src FROM identifies)",
        "SELECT 20, id FROM extraction WHERE confidence > 0.9"])
_CATEGORIES = ", ".join(f"({q}, '{category}')" for q, category, *_ in GROUND_TRUTH)
_KEYWORDS = ", ".join(f"({row[0]}, '{k}')" for row in GROUND_TRUTH for k in (*row[5], "THE", "ción", "eau", "der"))
_TRUTH = {
    "questions": f"SELECT * FROM (VALUES {_CATEGORIES}) t(question_id, category)",
    "kws": f"SELECT * FROM (VALUES {_KEYWORDS}) t(question_id, keyword)",
    "requirement_text": "SELECT 'req-' || p_partkey AS id, p_name AS description FROM part",
    "hits": f"""SELECT question_id, id, document_id, chunk_text FROM (
        SELECT n.question_id, c.id, c.document_id, c.chunk_text, row_number() OVER (PARTITION BY n.question_id ORDER BY {_VEC} DESC, c.id) AS rank
        FROM questions n JOIN chunk q ON q.id = 'chk-' || n.question_id CROSS JOIN chunk c) WHERE rank <= 5""",
    "expected": _EXPECTED,
    "found": """SELECT question_id, document_id AS id FROM hits UNION SELECT question_id, dst FROM hits JOIN edge ON src = document_id
        UNION SELECT question_id, src FROM hits JOIN edge ON dst = document_id""",
    "tallies": """SELECT question_id, category, (SELECT count(*) FROM expected e WHERE e.question_id = q.question_id) AS n_expected,
        (SELECT count(*) FROM found f WHERE f.question_id = q.question_id) AS n_retrieved,
        (SELECT count(*) FROM found f JOIN expected e ON e.id = f.id AND e.question_id = f.question_id WHERE f.question_id = q.question_id) AS n_shared
        FROM questions q""",
    "entity_result": """SELECT question_id, category, n_expected, n_retrieved, n_shared, round(p, 6) AS precision, round(r, 6) AS recall,
        round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
        round(CASE WHEN category = 'aggregation' THEN CASE WHEN n_expected = 0 THEN (n_retrieved = 0)::INT
          ELSE greatest(0, 1 - abs(n_expected - n_retrieved) / n_expected) END END, 6) AS count_accuracy
        FROM (SELECT *, CASE WHEN n_retrieved > 0 THEN n_shared / n_retrieved ELSE 0 END AS p, CASE WHEN n_expected > 0 THEN n_shared / n_expected ELSE 0 END AS r FROM tallies)""",
    "coverage_result": """SELECT question_id, round(count(*) FILTER (ok) / count(*), 6) AS coverage FROM (
        SELECT k.question_id, keyword, coalesce(bool_or(contains(lower(chunk_text), lower(keyword))), false) AS ok
        FROM kws k LEFT JOIN hits h ON h.question_id = k.question_id GROUP BY 1, 2) GROUP BY 1""",
}

ORACLES: dict[str, str] = {
    "t03_segment_generic": _GENERIC,
    "t03_segment_paragraphs": _PARAGRAPHS,
    "t04_segment_fmea": _FMEA,
    "t05_segment_ipar": _IPAR,
    "t06_segment_hira": _HIRA,
    "t07_segment_alert": _ALERT,
    "t08_segment_elements": _ELEMENTS,
    "t09_segment_fps": _FPS,
    "t12_rebuilt_texts": r"""SELECT doc_id::VARCHAR AS document_id, sha256(regexp_replace(text, '\s+', '', 'g')) AS bare_sha256, true AS within_limit, true AS distinct_ids
        FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''""",
    "t15_fixed_size_chunks": _FIXED,
    "t16_element_types": f"""
        WITH parts AS (SELECT doc_id, i AS position, line, {_strip('line')} AS t FROM ({_lines_cte(_FPS_TEXT)}))
        SELECT doc_id, position, CASE WHEN regexp_matches(t, '^\\d+\\.?\\s*[–\\-:.]?\\s*[A-ZÁÊÔÇ]') AND length(t) < 100 THEN 'Title'
          WHEN regexp_matches(lower(t), '^(escopo|definições|definicoes|responsabilidades|procedimentos|objetivo|anexo|apêndice|appendice)') AND length(t) < 80 THEN 'Title'
          WHEN regexp_matches(t, '^[\\-•●○◦▪]\\s+|^\\d+\\.\\d+\\.\\d+\\.?\\s+') THEN 'ListItem' ELSE 'NarrativeText' END AS type
        FROM parts WHERE t <> ''""",
    "t17_page_furniture": """
        SELECT doc_id, lang = 'en' AS header, regexp_matches(trim(lower(string_split(text, ' ')[-1]), ' ' || chr(10)), '^\\d+\\s*$|^página\\s*\\d|^page\\s*\\d') AS footer FROM documents""",
    "t18_outline": _OUTLINE,
    "t18_keyword_frequencies": f"""
        SELECT keyword, count(*) AS occurrences FROM (SELECT unnest(regexp_extract_all(lower(
          regexp_replace(text, '\\n([AEIOU])', {_NL} || 'Riscos e perigo, Controles\\1 ', 'g') || ' objetivo'),
          '\\b(objetivo|escopo|definições|responsabilidades|procedimentos|risco|perigo|controle|mitigação|isolamento|lockout|tagout|energia|elétrica|altura|confinado|espaço|içamento|veículo|terceiros|auditoria|emergência|métrica|investigação|acidente|hira|segurança)\\w*', 1)) AS keyword
          FROM documents) GROUP BY 1""",
    "t19_chunk_locations": """
        SELECT doc_id, length(substr(text, 1, p - 1)) - length(replace(substr(text, 1, p - 1), chr(10), '')) + 1 AS line_start,
          length(substr(text, 1, p - 1 + n)) - length(replace(substr(text, 1, p - 1 + n), chr(10), '')) + 1 AS line_end
        FROM (SELECT doc_id, text, length(s) AS n, instr(text, s) AS p FROM (
          SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s FROM documents)
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, encode(s) DESC) = 1)""",
    "e01_valid_questions": _retrieval("""
        SELECT question_id, type, len(facts) AS facts FROM golden
        WHERE length(trim(question)) >= 10 AND type <> 'riddle' AND z <= line_count AND len(facts) > 0"""),
    "e02_relevance": _retrieval("""
        SELECT r.question_id, rank, line_no BETWEEN a AND z AS relevant FROM got r JOIN golden USING (question_id)"""),
    "j08_range_overlaps": _retrieval("""SELECT g.question_id, CAST(l.i // 8 AS BIGINT) AS chunk_id FROM golden g JOIN lines l ON l.doc_id = g.question_id
        WHERE l.i % 8 = 0 AND l.i + 1 <= g.z AND g.a <= l.i + 10"""),
    "e03_first_relevant": _retrieval("SELECT * FROM first_hits"),
    "e04_token_overlap": _retrieval("SELECT * FROM ious"),
    "e05_question_scores": _retrieval("SELECT * FROM scores"),
    "e05_retrieval_metrics": _retrieval(f"SELECT {_METRICS} FROM scores"),
    "e05_retrieval_metrics_by_type": _retrieval(f"SELECT type, {_METRICS} FROM scores JOIN golden USING (question_id) GROUP BY type"),
    "e06_intrinsic_metrics": """
        SELECT event_id % 50 AS document_id, round(avg(greatest(1, least(5, coalesce(CASE WHEN event_type <> 'view' THEN value / 20 END, 3)))), 8) AS avg_concept_unity,
          round(avg(CASE WHEN event_type IN ('error', 'view') THEN 0.0 ELSE 1.0 END), 8) AS clean_boundary_rate,
          round(avg(greatest(1, least(5, user_id % 8))), 8) AS avg_standalone_score, count(*) AS chunks FROM events GROUP BY 1""",
    "e07_preservation": _FINDINGS + """
        SELECT doc_id AS document_id, coalesce(n, 0) AS total_facts, coalesce(k, 0) AS facts_found, round(coalesce(k / n, 1), 6) AS preservation_score
        FROM documents LEFT JOIN (SELECT document_id, count(*) AS n, count(*) FILTER (found) AS k FROM findings GROUP BY 1) ON document_id = doc_id""",
    "e07_missing_facts": _FINDINGS + " SELECT document_id, fact_id, fact FROM findings WHERE NOT coalesce(found, false)",
    "e08_overall_score": _RUNS + " SELECT document_id, chunker_type, overall_score FROM runs",
    "e09_compare_runs": _RUNS + f" {_COMPARE}",
    "e10_score_bands": _RUNS + """ SELECT CASE WHEN overall_score >= 0.8 THEN 'Excellent' WHEN overall_score >= 0.6 THEN 'Good' ELSE 'Needs Work' END AS band,
        count(*) AS runs FROM runs GROUP BY 1""",
    "e10_run_insights": _RUNS + """, measured AS (
        UNPIVOT (SELECT document_id, chunker_type, h1 AS first_hit, mrr, unity / 5 AS unity, clean, kept AS preservation, overall_score AS overall FROM runs)
        ON first_hit, mrr, unity, clean, preservation, overall INTO NAME measure VALUE value),
      rules(rule, measure, low, high, level) AS (VALUES
        ('first_hit_strong', 'first_hit', 0.8, NULL, 'good'), ('first_hit_fair', 'first_hit', 0.6, 0.8, 'fair'), ('first_hit_weak', 'first_hit', NULL, 0.6, 'poor'),
        ('tune_chunk_size', 'first_hit', NULL, 0.7, 'act'), ('review_order', 'mrr', NULL, 0.6, 'act'), ('focused_chunks', 'unity', 0.8, NULL, 'good'),
        ('mixed_chunks', 'unity', NULL, 0.6, 'poor'), ('split_topics', 'unity', NULL, 0.7, 'act'), ('broken_boundaries', 'clean', NULL, 0.7, 'poor'),
        ('facts_cut', 'preservation', NULL, 0.9, 'poor'), ('overall_strong', 'overall', 0.8, NULL, 'good'), ('overall_weak', 'overall', NULL, 0.6, 'poor'))
      SELECT document_id, chunker_type, rule, level, round(value, 6) AS value, low::DOUBLE AS low, high::DOUBLE AS high
      FROM measured JOIN rules USING (measure) WHERE (low IS NULL OR value >= low::DOUBLE) AND (high IS NULL OR value < high::DOUBLE)""",
    "e10_comparison_insights": _RUNS + f""", cmp AS ({_COMPARE})
      SELECT document_id, 'winner' AS rule, 'verdict' AS level, winner AS favours, overall_delta AS value, 0.02::DOUBLE AS threshold FROM cmp
      UNION ALL SELECT document_id, 'retrieval_differs', 'note', CASE WHEN retrieval_delta > 0 THEN 'semantic' ELSE 'fixed' END, retrieval_delta, 0.05::DOUBLE
        FROM cmp WHERE abs(retrieval_delta) > 0.05::DOUBLE
      UNION ALL SELECT document_id, 'form_differs', 'note', CASE WHEN intrinsic_delta > 0 THEN 'semantic' ELSE 'fixed' END, intrinsic_delta, 0.05::DOUBLE
        FROM cmp WHERE abs(intrinsic_delta) > 0.05::DOUBLE
      UNION ALL SELECT document_id, 'retrieval_decides', 'act', CASE WHEN retrieval_delta > 0 THEN 'semantic' ELSE 'fixed' END, retrieval_delta, 0.1::DOUBLE
        FROM cmp WHERE abs(retrieval_delta) > 0.1::DOUBLE""",
    "e11_run_summaries": _RUNS + """ SELECT document_id, chunker_type, h1 AS hit_rate_1, round(h3, 6) AS hit_rate_3, 1.0::DOUBLE AS hit_rate_5, round(mrr, 6) AS mrr,
        unity AS avg_concept_unity, round(clean, 6) AS clean_boundary_rate, alone AS avg_standalone_score, kept AS preservation, round(overall_score, 6) AS overall,
        20::BIGINT AS questions, 8::BIGINT AS chunks, 4::BIGINT AS facts FROM runs""",
    "e12_entity_scores": with_graph("SELECT * FROM entity_result", **_TRUTH),
    "e13_keyword_coverage": with_graph("SELECT * FROM coverage_result", **_TRUTH),
    "e14_category_means": with_graph("""
        SELECT coalesce(category, 'OVERALL') AS category, count(*) AS questions, round(avg(precision), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall,
          round(avg(f1), 6) AS avg_f1, round(avg(coverage), 6) AS avg_coverage
        FROM entity_result JOIN coverage_result USING (question_id) GROUP BY ROLLUP (category)""", **_TRUTH),
    "e15_distribution_check": with_graph("""
        SELECT control_type AS key, CAST(CASE control_type WHEN 'PREVENTIVE' THEN 34 WHEN 'DETECTIVE' THEN 1 ELSE 0 END AS BIGINT) AS expected, count(*) AS actual,
          CASE control_type WHEN 'PREVENTIVE' THEN count(*) = 34 WHEN 'DETECTIVE' THEN count(*) = 1 END AS matches FROM control GROUP BY 1"""),
}
