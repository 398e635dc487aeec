"""Semantic segmentation of whole document texts.

A document is one row, so every segmenter is a narrow expression over its line array: no shuffle,
documents in parallel, and the text is read whole. All segmenters return the same columns::

    document columns..., segment_index, text, semantic_type, context, section, line_start, line_end
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import with_running_sums
from riskloom.functions.text import (
    any_of, capitalise, estimate_tokens, first_keyword, join_lines, last_match, let, line_of,
    lines_of, split_points, strip, with_evaluated,
)
from riskloom.sources.files import workbook_rows

MIN_BLOCK_LINES = 3

# --- fixed values: keyword lists and patterns of the document types -----------------------
IPAR_HAZARDS = (
    "ruído", "vibração", "queda", "atropelamento", "aprisionamento", "projeção", "queimadura", "choque",
    "esmagamento", "exposição", "inalação", "contato", "corte", "perfuração", "explosão", "incêndio",
    "intoxicação", "radiação", "ergonômico", "ergonomico", "temperatura", "pressão", "elétrico", "eletrico",
    "químico", "quimico", "biológico", "biologico", "mecânico", "mecanico", "físico", "fisico",
)
IPAR_CLASSES = ("intolerável", "intoleravel", "moderado", "trivial", "tolerável", "toleravel")
HIRA_HAZARDS = (
    "hazard", "risk", "danger", "harm", "injury", "fatality", "perigo", "risco", "lesão", "acidente", "fatalidade",
    "chemical", "electrical", "mechanical", "biological", "physical", "químico", "elétrico", "mecânico", "biológico",
    "físico", "fall", "slip", "trip", "crush", "burn", "cut", "queda", "escorregão", "tropeço", "esmagamento",
    "queimadura", "corte",
)
HIRA_SEVERITIES = ("catastrophic", "critical", "major", "minor", "negligible", "high", "medium", "low")
HIRA_LIKELIHOODS = ("frequent", "probable", "occasional", "remote", "improbable", "likely", "unlikely")
ALERT_TITLES = (
    "description", "descrição", "descrição do evento", "root cause", "causa raiz", "causa principal",
    "contributing factors", "fatores contribuintes", "corrective action", "ação corretiva", "medidas corretivas",
    "lesson learned", "lição aprendida", "aprendizado", "recommendation", "recomendação", "recomendações",
    "timeline", "cronologia", "sequência de eventos", "impact", "impacto", "consequências",
    "investigation", "investigação", "análise",
)
ALERT_TYPES = (
    ("description", "alert_description"), ("root cause", "alert_root_cause"), ("causa raiz", "alert_root_cause"),
    ("corrective action", "alert_corrective_action"), ("ação corretiva", "alert_corrective_action"),
    ("lesson learned", "alert_lesson_learned"), ("lição aprendida", "alert_lesson_learned"),
    ("recommendation", "alert_recommendation"), ("recomendação", "alert_recommendation"),
)
FPS_TITLES = ("escopo", "definições", "procedimentos", "responsabilidades", "objetivo", "anexo")
FPS_TYPES = (
    ("escopo", "fps_scope"), ("definição", "fps_definitions"), ("definicao", "fps_definitions"),
    ("procedimento", "fps_procedures"), ("responsabilidade", "fps_responsibilities"), ("objetivo", "fps_objective"),
    ("anexo", "fps_appendix"), ("apêndice", "fps_appendix"),
)
PROCESS_COLUMNS = ("process", "processo", "component")
NUMBERED_ITEM = r"^(?:item\s*:?\s*)?\d+[\s.:]+\w+"
NUMBERED_TITLE = r"^\d+\.?\s*[–\-:.]?\s*[A-ZÁÊÔÇ]"
ALERT_TITLE_LINE = r"^(?:\d+[\.\)]\s*)?([A-Za-zÀ-ú\s]+)[:.\s]*$"
SECTION_START = r"(?:#{1,6}\s+.+|.+\n[=\-]{3,})$"
# -------------------------------------------------------------------------------------------


def _segment(text: Column, semantic_type: Column | str, context: Column, section: Column,
             line_start: Column, line_end: Column) -> Column:
    kind = F.lit(semantic_type) if isinstance(semantic_type, str) else semantic_type
    return F.struct(text.alias("text"), kind.alias("semantic_type"), context.alias("context"), section.alias("section"),
                    line_start.cast("int").alias("line_start"), line_end.cast("int").alias("line_end"))


def _exploded(documents: DataFrame, text: str, segments: str, scratch: list[str]) -> DataFrame:
    keep = [c for c in documents.columns if c not in {text, segments, *scratch}]
    return documents.select(*keep, F.posexplode(segments).alias("segment_index", "s")).select(*keep, "segment_index", "s.*")


@dataclass(frozen=True)
class Limits:
    """Least sizes of what becomes a segment; shorter text is left out. By default none is: all text that is not blank stays."""

    paragraph_chars: int = 1
    block_chars: int = 1
    header_chars: int = 1
    section_chars: int = 1
    tokens: int = 0
    front_matter: bool = True


KEEP_ALL = Limits()
#: The limits of the reference, which also leave out what stands before a procedure's or a generic text's first title.
STRICT = Limits(paragraph_chars=20, block_chars=51, header_chars=51, section_chars=51, tokens=20, front_matter=False)
STRICT_ALERT = replace(STRICT, header_chars=31, section_chars=31)


def _paragraphs(content: Column) -> Column:
    return F.split(content, r"\n\n+")


# --- generic ------------------------------------------------------------------------------------

def _paragraph_segments(content: Column, heading: Column, limits: Limits) -> Column:
    """Paragraphs that are not headings, with their line range in ``content``."""
    kept = F.filter(F.transform(_paragraphs(content), strip), lambda p: (
        (F.length(p) >= limits.paragraph_chars) & ~F.rlike(p, F.lit(r"^#{1,6}\s+")) & ~F.rlike(p, F.lit(r"\n[=\-]{3,}$"))))
    def segment(paragraph: Column) -> Column:
        return let(line_of(content, F.position(paragraph, content) - 1), lambda line: _segment(
            paragraph, "paragraph", F.concat(F.lit("Section: "), heading), heading,
            line, line + F.size(lines_of(paragraph))))
    return F.transform(kept, segment)


def segment_generic(documents: DataFrame, text: str = "text", limits: Limits = KEEP_ALL) -> DataFrame:
    """Sections by Markdown or underlined headings, then paragraphs; without two sections, paragraphs."""
    titled = lambda part: F.rlike(part, F.lit(rf"(?m)\A{SECTION_START}"))
    every = F.split(F.col(text), rf"(?m)(?=^{SECTION_START})")
    sections = F.filter(every, titled)
    first_line = lambda part: F.element_at(lines_of(part), 1)
    heading = lambda part: strip(F.when(F.rlike(part, F.lit(r"(?m)\A#{1,6}\s+.+$")), F.regexp_replace(first_line(part), r"^#+\s*", ""))
                                 .otherwise(first_line(part)))
    parts = with_evaluated(documents, _sections=sections, _before=F.filter(F.slice(every, 1, 1), lambda part: ~titled(part)))
    by_section = F.flatten(F.transform("_sections", lambda part: let(strip(part), lambda content: let(
        heading(part), lambda title: _paragraph_segments(content, title, limits)))))
    if limits.front_matter:
        by_section = F.concat(F.flatten(F.transform("_before", lambda part: _paragraph_segments(part, F.lit("Document"), limits))), by_section)
    whole = _paragraph_segments(F.col(text), F.lit("Document"), limits)
    parts = parts.withColumn("_segments", F.when(F.size("_sections") > 1, by_section).otherwise(whole))
    return _exploded(parts, text, "_segments", ["_sections", "_before"])


# --- FMEA workbooks ---------------------------------------------------------------------------------

def segment_fmea(documents: DataFrame, text: str = "text", key: str = "document_id") -> DataFrame:
    """Sheet rows grouped while the process stays the same or blank; an empty row closes a group."""
    keep = [c for c in documents.columns if c != text]
    rows = workbook_rows(documents, text)
    sheet = Window.partitionBy(key, "sheet_no").orderBy("row")
    header = F.first("cells").over(sheet.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    process_at = F.coalesce(*[F.nullif(F.array_position(
        F.transform("header", lambda h: F.contains(F.lower(h), F.lit(name))), True), F.lit(0)) for name in PROCESS_COLUMNS])
    pairs = F.arrays_zip(F.slice("header", F.lit(1), F.least(F.size("header"), F.size("cells"))).alias("h"),
                         F.slice("cells", F.lit(1), F.least(F.size("header"), F.size("cells"))).alias("v"))
    line = F.array_join(F.transform(F.filter(pairs, lambda p: p["v"] != ""), lambda p: F.concat(p["h"], F.lit(": "), p["v"])), " | ")
    rows = rows.withColumn("header", header).filter("row > 0").withColumns({
        "line": line, "empty": ~F.exists("cells", lambda c: c != ""),
        "process": F.nullif(F.get("cells", (process_at - 1).cast("int")), F.lit(""))})
    before = sheet.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("previous", F.last("process", ignorenulls=True).over(before))
    rows = rows.withColumn("change", F.col("process").isNotNull() & ~F.equal_null("process", "previous"))
    upto = sheet.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "group": F.sum(F.col("change").cast("int")).over(upto), "gaps": F.sum(F.col("empty").cast("int")).over(upto),
        # Sheet rows count from 1 and the header is one of them.
        "start": F.coalesce(F.last(F.when(F.col("change"), F.col("row") + 1), ignorenulls=True).over(upto), F.lit(1))})
    groups = rows.filter(~F.col("empty")).groupBy(*keep, "sheet_no", "sheet", "group", "gaps").agg(
        F.min("start").alias("start"), F.count(F.lit(1)).cast("int").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("text"))
    end = F.col("start") + F.col("n") - 1
    context = F.concat(F.lit("Sheet: "), "sheet", F.lit(", Row "), "start",
                       F.when(end == F.col("start"), F.lit("")).otherwise(F.concat(F.lit("-"), end)))
    order = Window.partitionBy(key).orderBy("sheet_no", "group", "gaps")
    return groups.select(*keep, (F.row_number().over(order) - 1).alias("segment_index"), "text",
                         F.lit("fmea_row_group").alias("semantic_type"), context.alias("context"),
                         F.concat(F.lit("Sheet: "), "sheet").alias("section"), F.col("start").cast("int").alias("line_start"),
                         end.cast("int").alias("line_end"))


# --- header + blocks (IPAR, HIRA, alert) ---------------------------------------------------------------

@dataclass(frozen=True)
class BlockProfile:
    """What distinguishes one header-and-blocks document type from another."""

    header_lines: int
    header_min_index: int
    fields: Mapping[str, tuple[str, str]]          # name -> (pattern, default)
    header_type: str
    header_section: str
    header_context: Callable[[Mapping[str, Column]], Column]
    paragraph_type: str
    paragraph_prefix: Callable[[Mapping[str, Column]], Column]
    paragraph_context: str
    paragraph_section: Callable[[Mapping[str, Column]], Column]


def _with_header(documents: DataFrame, text: str, boundary: Callable[[Column], Column], profile: BlockProfile) -> DataFrame:
    """Adds _lines, _points (boundary positions), _header_end and the header fields."""
    n = F.size("_lines")
    rows = with_evaluated(documents, _lines=lines_of(F.col(text)))
    rows = with_evaluated(rows, _points=split_points(F.transform("_lines", boundary)))
    hit = F.get(F.filter("_points", lambda p: (p > profile.header_min_index) & (p < profile.header_lines)), F.lit(0))
    rows = with_evaluated(rows, _hit=hit, _header_end=F.coalesce(hit, F.least(n, F.lit(profile.header_lines))))
    # The line that ends the header is still searched for header fields.
    searched = F.slice("_lines", F.lit(1), F.coalesce(F.col("_hit") + 1, F.col("_header_end")))
    rows = with_evaluated(rows, _searched=searched)
    return with_evaluated(rows, **{f"_f_{name}": last_match(F.col("_searched"), pattern, default)
                                   for name, (pattern, default) in profile.fields.items()})


def _fields(profile: BlockProfile) -> dict[str, Column]:
    return {name: F.col(f"_f_{name}") for name in profile.fields}


def _assemble(rows: DataFrame, text: str, blocks: Column, profile: BlockProfile, limits: Limits) -> DataFrame:
    """Header segment, then the blocks, or paragraphs of the body when there are no blocks at all.

    ``blocks``: array of struct(keep, segment); blocks count even when they are not kept.
    """
    fields = _fields(profile)
    rows = with_evaluated(
        rows, _blocks=blocks, _head=strip(join_lines(F.col("_lines"), F.lit(0), F.col("_header_end"))),
        _prefix=profile.paragraph_prefix(fields))
    header = F.when(F.length("_head") >= limits.header_chars, F.array(_segment(
        F.col("_head"), profile.header_type, profile.header_context(fields), F.lit(profile.header_section), F.lit(1), F.col("_header_end"))))
    body = join_lines(F.col("_lines"), F.col("_header_end"), F.size("_lines") - F.col("_header_end"))
    long = F.filter(_paragraphs(body), lambda p: F.length(strip(p)) >= limits.block_chars)
    paragraphs = F.transform(long, lambda p, i: _segment(
        F.concat(F.col("_prefix"), F.lit("\n\n"), strip(p)), profile.paragraph_type,
        F.concat(F.lit(profile.paragraph_context + " "), (i + 1).cast("string")), profile.paragraph_section(fields),
        i * 5, i * 5 + F.size(lines_of(p))))
    kept = F.transform(F.filter("_blocks", lambda b: b["keep"]), lambda b: b["segment"])
    body_segments = F.when(F.size("_blocks") > 0, kept).otherwise(paragraphs)
    rows = with_evaluated(rows, _body=body_segments)
    rows = rows.withColumn("_segments", F.concat(F.coalesce(header, F.slice("_body", 1, 0)), "_body"))
    scratch = [c for c in rows.columns if c.startswith("_")]
    return _exploded(rows, text, "_segments", scratch)


def _block(text: Column, start: Column, end: Column, title: Column | None = None) -> Column:
    fields = [text.alias("text"), start.alias("start"), end.alias("end")]
    return F.struct(*fields, *([title.alias("title")] if title is not None else []))


def _with_hazard_texts(rows: DataFrame, limits: Limits) -> DataFrame:
    """Adds _texts: body blocks. A boundary line opens a new block once the
    current one has more than three lines."""
    first = F.col("_header_end")
    body_lines = F.greatest(F.size("_lines") - first, F.lit(1))
    candidates = F.transform(F.filter("_points", lambda p: p >= first), lambda p: p - first)
    starts = F.aggregate(candidates, F.array(F.lit(0)), lambda acc, p: F.when(
        p - F.element_at(acc, -1) > MIN_BLOCK_LINES, F.concat(acc, F.array(p))).otherwise(acc))
    rows = with_evaluated(rows, _starts=starts)
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(body_lines))
    rows = with_evaluated(rows, _spans=F.arrays_zip(F.col("_starts").alias("a"), ends.alias("b")))
    texts = F.transform("_spans", lambda s: _block(
        strip(join_lines(F.col("_lines"), first + s["a"], s["b"] - s["a"])), first + 1 + s["a"], first + s["b"]))
    return with_evaluated(rows, _texts=F.filter(texts, lambda b: F.length(b["text"]) >= limits.block_chars))


def _hazard_line(keywords: tuple[str, ...]) -> Callable[[Column], Column]:
    """A numbered item, or a hazard keyword that starts within the first 40 characters."""
    near = rf"^.{{0,39}}{any_of(keywords)}"
    return lambda line: let(strip(F.lower(line)), lambda lowered: (F.length(lowered) >= 3) & (
        F.rlike(lowered, F.lit("(?i)" + NUMBERED_ITEM)) | F.rlike(lowered, F.lit(near))))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def _pipe(*parts: Column) -> Column:
    return F.concat_ws(" | ", *parts)


IPAR = BlockProfile(
    header_lines=30, header_min_index=5,
    fields={
        "process": (r"(?iu)(?:processo|process)[:\s]*([^\n]+)", "Desconhecido"),
        "unit": (r"(?iu)(?:unidade|unit)[:\s]*([^\n]+)", "Desconhecida"),
        "code": (r"(?iu)(?:código|codigo|code)[:\s]*([^\n]+)", ""),
        "elaborator": (r"(?iu)(?:elaborador|elaborado por|autor|author)[:\s]*([^\n]+)", ""),
    },
    header_type="ipar_audit_header", header_section="Cabeçalho",
    header_context=lambda f: _labelled("IPAR: ", f["process"]),
    paragraph_type="ipar_paragraph", paragraph_context="Parágrafo",
    paragraph_prefix=lambda f: _pipe(_labelled("Processo: ", f["process"]), _labelled("Unidade: ", f["unit"])),
    paragraph_section=lambda f: f["process"],
)
HIRA = BlockProfile(
    header_lines=30, header_min_index=5,
    fields={
        "area": (r"(?iu)(?:area|department|setor|área)[:\s]*([^\n]+)", "Unknown"),
        "activity": (r"(?iu)(?:activity|task|atividade|tarefa)[:\s]*([^\n]+)", "Unknown"),
        "assessor": (r"(?iu)(?:assessor|evaluator|avaliador|responsável)[:\s]*([^\n]+)", ""),
        "date": (r"(?iu)(?:date|data)[:\s]*([^\n]+)", ""),
    },
    header_type="hira_header", header_section="Header",
    header_context=lambda f: F.concat(F.lit("HIRA: "), f["area"], F.lit(" - "), f["activity"]),
    paragraph_type="hira_paragraph", paragraph_context="Paragraph",
    paragraph_prefix=lambda f: _pipe(_labelled("Area: ", f["area"]), _labelled("Activity: ", f["activity"])),
    paragraph_section=lambda f: f["activity"],
)
ALERT = BlockProfile(
    header_lines=25, header_min_index=3,
    fields={
        "number": (r"(?iu)(?:alert|alerta|gppm|incident)[#:\s]*([A-Z0-9\-]+)", ""),
        "title": (r"(?iu)(?:title|título|subject|assunto)[:\s]*([^\n]+)", "Safety Alert"),
        "date": (r"(?iu)(?:date|data|occurred|ocorrido)[:\s]*([^\n]+)", ""),
        "location": (r"(?iu)(?:location|local|site|unidade)[:\s]*([^\n]+)", ""),
        "severity": (r"(?iu)(?:severity|gravidade|priority|prioridade)[:\s]*([^\n]+)", ""),
    },
    header_type="alert_header", header_section="Header",
    header_context=lambda f: _labelled("Alert: ", F.when(f["number"] != "", f["number"]).otherwise(f["title"])),
    paragraph_type="alert_paragraph", paragraph_context="Paragraph",
    paragraph_prefix=lambda f: _labelled("Alert: ", F.when(f["number"] != "", f["number"]).otherwise(f["title"])),
    paragraph_section=lambda f: F.lit("Content"),
)


def segment_ipar(documents: DataFrame, text: str = "text", limits: Limits = KEEP_ALL) -> DataFrame:
    """Audit header, then hazard blocks enriched with hazard type and classification."""
    fields = _fields(IPAR)

    def enrich(block: Column, hazard: Column, grade: Column) -> Column:
        body = F.concat(IPAR.paragraph_prefix(fields), F.lit("\nPerigo: "), hazard,
                        F.when(grade != "", F.concat(F.lit(" | Classificação: "), grade)).otherwise(""), F.lit("\n\n"), block["text"])
        context = F.concat(F.lit("Perigo: "), hazard, F.when(grade != "", F.concat(F.lit(" ("), grade, F.lit(")"))).otherwise(""))
        return _kept_if_long(body, "ipar_hazard_block", context, fields["process"], block, limits)

    rows = _with_header(documents, text, _hazard_line(IPAR_HAZARDS), IPAR)
    blocks = F.transform("_texts", lambda block: _graded(
        enrich, block, _found(block, IPAR_HAZARDS, "Não identificado"), _found(block, IPAR_CLASSES, "")))
    return _assemble(_with_hazard_texts(rows, limits), text, blocks, IPAR, limits)


def segment_hira(documents: DataFrame, text: str = "text", limits: Limits = KEEP_ALL) -> DataFrame:
    """Assessment header, then hazard blocks enriched with hazard type, severity and likelihood."""
    fields = _fields(HIRA)

    def enrich(block: Column, hazard: Column, grade: Column) -> Column:
        body = F.concat(HIRA.paragraph_prefix(fields), F.lit("\nHazard: "), hazard,
                        F.when(grade != "", F.concat(F.lit(" | Risk: "), grade)).otherwise(""), F.lit("\n\n"), block["text"])
        context = F.concat(F.lit("Hazard: "), hazard, F.when(grade != "", F.concat(F.lit(" ("), grade, F.lit(")"))).otherwise(""))
        return _kept_if_long(body, "hira_hazard_block", context, fields["activity"], block, limits)

    rows = _with_header(documents, text, _hazard_line(HIRA_HAZARDS), HIRA)
    blocks = F.transform("_texts", lambda block: _graded(
        enrich, block, _found(block, HIRA_HAZARDS, "Unidentified"), F.concat_ws(
            " / ", capitalise(first_keyword(block["text"], HIRA_SEVERITIES)), capitalise(first_keyword(block["text"], HIRA_LIKELIHOODS)))))
    return _assemble(_with_hazard_texts(rows, limits), text, blocks, HIRA, limits)


def _found(block: Column, keywords: tuple[str, ...], default: str) -> Column:
    return F.coalesce(capitalise(first_keyword(block["text"], keywords)), F.lit(default))


def _graded(enrich: Callable[[Column, Column, Column], Column], block: Column, hazard: Column, grade: Column) -> Column:
    return let(hazard, lambda h: let(grade, lambda g: enrich(block, h, g)))


def _kept_if_long(body: Column, kind: Column | str, context: Column, section: Column, block: Column, limits: Limits) -> Column:
    return let(body, lambda text: F.struct(
        (estimate_tokens(text) >= limits.tokens).alias("keep"),
        _segment(text, kind, context, section, block["start"], block["end"]).alias("segment")))


def alert_title(line: Column) -> Column:
    """Section title on a line, null when the line is none."""
    return let(strip(F.lower(line)), lambda lowered: _alert_title(line, lowered))


def _alert_title(line: Column, lowered: Column) -> Column:
    label = F.regexp_extract(line, ALERT_TITLE_LINE, 1)
    named = F.rlike(line, F.lit(ALERT_TITLE_LINE)) & F.rlike(F.lower(label), F.lit(any_of(ALERT_TITLES)))
    leading = F.rlike(lowered, F.lit("^" + any_of(ALERT_TITLES))) & (F.length(lowered) < 60)
    return F.when((F.length(lowered) >= 3) & (F.length(lowered) <= 100),
                  F.when(named, strip(label)).when(leading, strip(line)))


def segment_alert(documents: DataFrame, text: str = "text", limits: Limits = KEEP_ALL) -> DataFrame:
    """Alert header, then titled sections; text before the first title is the introduction."""
    fields = _fields(ALERT)
    rows = _with_header(documents, text, lambda line: alert_title(line).isNotNull(), ALERT)
    first = F.col("_header_end")
    body_lines = F.greatest(F.size("_lines") - first, F.lit(1))
    titles = F.transform(F.filter("_points", lambda p: p >= first), lambda p: p - first)
    rows = with_evaluated(rows, _titles=titles)
    # A span is (title line, end); title line -1 marks the untitled introduction.
    opening = F.when(F.coalesce(F.get("_titles", F.lit(0)), body_lines) > 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    rows = with_evaluated(rows, _starts=F.concat(opening, "_titles"))
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(body_lines))
    rows = with_evaluated(rows, _spans=F.arrays_zip(F.col("_starts").alias("a"), ends.alias("b")))
    texts = F.transform("_spans", lambda s: _block(
        strip(join_lines(F.col("_lines"), first + s["a"] + 1, s["b"] - s["a"] - 1)),
        first + 1 + F.greatest(s["a"], F.lit(0)), first + s["b"],
        F.when(s["a"] < 0, F.lit("Introduction")).otherwise(alert_title(F.get("_lines", first + s["a"])))))
    origin = _pipe(F.when(fields["number"] != "", _labelled("Alert: ", fields["number"])),
                   F.when(fields["location"] != "", _labelled("Location: ", fields["location"])))
    rows = with_evaluated(
        rows, _texts=F.filter(texts, lambda b: F.length(b["text"]) >= limits.section_chars),
        _origin=F.when(origin != "", origin).otherwise(_labelled("Alert: ", fields["title"])))

    def enrich(block: Column) -> Column:
        kind = F.lit("alert_section")
        for key, name in reversed(ALERT_TYPES):
            kind = F.when(F.contains(F.lower(block["title"]), F.lit(key)), name).otherwise(kind)
        body = F.concat(F.col("_origin"), F.lit("\nSection: "), block["title"], F.lit("\n\n"), block["text"])
        return _kept_if_long(body, kind, block["title"], block["title"], block, limits)

    return _assemble(rows, text, F.transform("_texts", enrich), ALERT, limits)


# --- procedures ----------------------------------------------------------------------------------------

def fps_type(title: Column) -> Column:
    kind = F.lit("fps_section")
    for key, name in reversed(FPS_TYPES):
        kind = F.when(F.contains(F.lower(title), F.lit(key)), name).otherwise(kind)
    return kind


def is_section_title(line: Column) -> Column:
    return F.length(line).between(3, 100) & (
        F.rlike(line, F.lit(NUMBERED_TITLE)) | F.rlike(F.lower(line), F.lit("^" + any_of(FPS_TITLES))))


def segment_fps(documents: DataFrame, text: str = "text", limits: Limits = KEEP_ALL) -> DataFrame:
    """Sections by title line, after an introduction that ends at the first title; a text without any section is one segment."""
    rows = with_evaluated(documents, _lines=F.transform(lines_of(F.col(text)), strip))
    rows = with_evaluated(rows, _points=split_points(F.transform("_lines", is_section_title)))
    ends = F.concat(F.slice("_points", F.lit(2), F.size("_points")), F.array(F.size("_lines")))
    spans = F.filter(F.arrays_zip(F.col("_points").alias("a"), ends.alias("b")), lambda s: s["a"].isNotNull())
    rows = with_evaluated(rows, _spans=spans)
    def segment(span: Column) -> Column:
        return let(F.get("_lines", span["a"]), lambda title: _segment(
            join_lines(F.col("_lines"), span["a"], span["b"] - span["a"]), fps_type(title), title, title, span["a"], span["b"] - 1))
    rows = with_evaluated(rows, _sections=F.filter(F.transform("_spans", segment), lambda s: F.length(strip(s["text"])) >= limits.section_chars))
    none, sections = F.lit(None).cast("int"), F.col("_sections")
    if limits.front_matter:
        first = F.coalesce(F.get("_points", F.lit(0)), F.lit(0))
        opening = let(join_lines(F.col("_lines"), F.lit(0), first), lambda before: F.filter(F.array(_segment(
            before, "fps_section", F.lit("Introduction"), F.lit("Introduction"), F.lit(0), first - 1)), lambda s: F.length(strip(s["text"])) > 0))
        sections = F.concat(opening, sections)
    whole = F.array(_segment(F.col(text), "fps_document", F.lit("FPS Document"), F.lit("Full Document"), none, none))
    rows = rows.withColumn("_segments", F.when(F.size("_sections") > 0, sections).otherwise(whole))
    return _exploded(rows, text, "_segments", ["_lines", "_points", "_spans", "_sections"])


def segment_fps_elements(elements: DataFrame, limits: Limits = KEEP_ALL) -> DataFrame:
    """Sections from typed elements (document_id, position, type, text, page): a Title opens a section,
    a Table is a segment of its own. Running counts are taken block by block, so a document with very
    many elements does not end up in one task."""
    is_title, is_table = F.col("type") == "Title", F.col("type") == "Table"
    flagged = elements.withColumns({
        "title": is_title.cast("int"), "cut": (is_title | is_table).cast("int")})
    rows = with_running_sums(flagged, ["document_id"], ["position"], ["title", "cut"])
    # A table closes the part before it, and what follows belongs to a new part of the same section.
    rows = rows.withColumn("part", F.col("sum_cut") * 2 + F.when(is_table, 0).otherwise(1))
    titles = rows.filter(is_title).select("document_id", "sum_title", F.col("text").alias("section_title"), F.col("page").alias("section_page"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    parts = rows.groupBy("document_id", "sum_title", "part").agg(
        F.max(is_table).alias("is_table"), F.min("position").alias("first_position"), F.min("page").alias("first_page"),
        F.array_join(F.transform(ordered, lambda e: e["text"]), "\n\n").alias("text"))
    parts = parts.join(titles, ["document_id", "sum_title"], "left").withColumn("section", strip(F.col("section_title")))
    parts = parts.filter(F.col("is_table") | (F.length(strip(F.col("text"))) >= limits.section_chars))
    default = lambda table, other: F.coalesce("section", F.when(F.col("is_table"), table).otherwise(other))
    return parts.select(
        "document_id", "first_position", "text",
        F.when(F.col("is_table"), "fps_table").otherwise(fps_type(F.coalesce("section", F.lit("content")))).alias("semantic_type"),
        default("Table", "FPS Document").alias("context"), default("Table", "Body").alias("section"),
        F.when(F.col("is_table"), F.col("first_page")).otherwise(F.coalesce("section_page", F.lit(1))).alias("page"))


# --- dispatch -------------------------------------------------------------------------------------------

SEGMENTERS: dict[str, Callable[..., DataFrame]] = {
    "fmea": segment_fmea, "ipar": segment_ipar, "hira": segment_hira,
    "alert": segment_alert, "fps": segment_fps, "generic": segment_generic,
}


def register_segmenter(document_type: str, segmenter: Callable[..., DataFrame]) -> None:
    SEGMENTERS[document_type] = segmenter


def segment_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """Segments every document by its ``document_type``; unknown types are treated as generic."""
    known = F.col("document_type").isin(*[t for t in SEGMENTERS if t != "generic"])
    kind = F.when(known, F.col("document_type")).otherwise("generic")
    return reduce(DataFrame.unionByName, [
        segmenter(documents.filter(kind == document_type), text) for document_type, segmenter in SEGMENTERS.items()])
