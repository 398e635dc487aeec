"""Registered segmentation, chunking and inspection queries over the documents table.

The texts are the documents' own, led by header lines and with type-specific marks at the start of
lines that begin with a vowel, so that every segmenter has something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.text import locate_lines
from riskloom.operators import chunk as ch
from riskloom.operators import segment as sg
from riskloom.plans.analytics_catalog import Query
from riskloom.plans.graph_catalog import workbook_text, workbook_texts
from riskloom.sources.star_schema import read_texts

VOWEL_LINE = r"\n([AEIOU])"
# document type -> (lines before the text, replacement for VOWEL_LINE)
MARKS = {
    "ipar": ("Processo: {source}\nUnidade: {lang}\nResumo geral\n\n\n\n", "\nRuído e queda: $1"),
    "hira": ("Area: {source}\nActivity: work {lang}\nSummary of the assessment\n\n\n\n", "\n3. High exposure $1"),
    "alert": ("Alert: A-{doc_id}\nLocation: {source}\nSummary\n\n\n", "\nRoot cause:\n$1"),
    "fps": ("", "\n1. Escopo\n$1"),
}
SPLIT_TOKENS, SPLIT_OVERLAP = 200, 20


def filled(template: str):
    """The template with {column} placeholders as a concatenation."""
    parts = []
    for piece in template.split("{"):
        name, _, rest = piece.partition("}") if "}" in piece else ("", "", piece)
        parts += ([F.col(name).cast("string")] if name else []) + ([F.lit(rest)] if rest else [])
    return F.concat(*parts) if parts else F.lit("")


def marked_texts(spark: SparkSession, sf_dir: str, document_type: str) -> DataFrame:
    head, mark = MARKS[document_type]
    return read_texts(spark, sf_dir).select(
        "doc_id", F.concat(filled(head), F.regexp_replace("text", VOWEL_LINE, mark)).alias("text"))


def markdown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text line becomes a section of its own under a heading."""
    body = F.regexp_replace("text", r"\n", "\n\n## part\n\n")
    return read_texts(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), body).alias("text"))


def typed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, one of the six types each, with the marks of their type, made in their rows."""
    kind = F.element_at(F.array(*[F.lit(t) for t in schemas.DOCUMENT_TYPES]), (F.col("doc_id") % 6 + 1).cast("int"))
    text = F.when(kind == "fmea", workbook_text())
    for name, (head, mark) in MARKS.items():
        text = text.when(kind == name, F.concat(filled(head), F.regexp_replace("text", VOWEL_LINE, mark)))
    return read_texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("document_id"), kind.alias("document_type"),
        text.otherwise(F.col("text")).alias("text"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as typed elements: short lines are titles, lines with a digit tables."""
    lines = read_texts(spark, sf_dir).select(
        F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    return lines.withColumns({
        "type": F.when(F.length("text") < 60, "Title").when(F.rlike("text", F.lit("[0-9]")), "Table").otherwise("NarrativeText"),
        "page": (F.floor(F.col("position") / 10) + 1).cast("int")})


def rows(segments: DataFrame) -> DataFrame:
    keep = [F.col(c).cast("bigint").alias(c) for c in ("segment_index", "line_start", "line_end")]
    return segments.select("doc_id", "text", "semantic_type", "context", "section", *keep)


def chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("document_id", "document_type", F.col("chunk_index").cast("bigint").alias("chunk_index"), "text",
                         "semantic_type", "context", F.col("tokens").cast("bigint").alias("tokens"), "is_oversized",
                         F.col("split_depth").cast("bigint").alias("split_depth"))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.chunk_documents(typed_texts(spark, sf_dir), max_tokens=SPLIT_TOKENS, overlap_tokens=SPLIT_OVERLAP)


def whole_text_pieces(spark: SparkSession, sf_dir: str, overlap: int = SPLIT_OVERLAP) -> DataFrame:
    """Whole documents as one segment each, split to size."""
    docs = read_texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("segment_index"), "text",
        F.lit("generic").alias("document_type"), F.lit("text").alias("semantic_type"), F.col("source").alias("context"))
    return ch.split_segments(docs, max_tokens=SPLIT_TOKENS, overlap_tokens=overlap)


def rebuilt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pieces without overlap keep of a document: its text but for white space, its limit, one id per piece."""
    pieces = whole_text_pieces(spark, sf_dir, overlap=0)
    bare = F.regexp_replace(F.regexp_replace("text", r"^(\[src[0-9]+\](\n|$))+", ""), r"\s+", "")
    in_order = F.array_sort(F.collect_list(F.struct("chunk_index", bare.alias("bare"))))
    return pieces.groupBy("document_id").agg(
        F.sha2(F.array_join(F.transform(in_order, lambda p: p["bare"]), ""), 256).alias("bare_sha256"),
        (F.max("tokens") <= SPLIT_TOKENS).alias("within_limit"), (F.count_distinct("chunk_index") == F.count(F.lit(1))).alias("distinct_ids"))


def chunk_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line range of every document's longest line, found again in the whole text."""
    longest = F.element_at(F.array_sort(F.transform(F.split("text", "\n"), lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))), -1)["s"]
    return read_texts(spark, sf_dir).withColumn("at", locate_lines(F.col("text"), longest)).select(
        "doc_id", F.col("at.line_start").cast("bigint").alias("line_start"), F.col("at.line_end").cast("bigint").alias("line_end"))


def outline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.outline(marked_texts(spark, sf_dir, "fps")).select(
        "doc_id", F.col("line").cast("bigint").alias("line"), "heading", F.col("level").cast("bigint").alias("level"))


QUERIES: dict[str, Query] = {
    "t01_chunk_documents": lambda s, d: chunk_rows(chunked(s, d)),
    "t02_chunk_statistics": lambda s, d: ch.chunk_job_statistics(chunked(s, d)),
    "t03_segment_generic": lambda s, d: rows(sg.segment_generic(markdown_texts(s, d))),
    "t03_segment_paragraphs": lambda s, d: rows(sg.segment_generic(read_texts(s, d).select("doc_id", "text"))),
    "t04_segment_fmea": lambda s, d: rows(sg.segment_fmea(workbook_texts(s, d), key="doc_id")),
    "t05_segment_ipar": lambda s, d: rows(sg.segment_ipar(marked_texts(s, d, "ipar"))),
    "t06_segment_hira": lambda s, d: rows(sg.segment_hira(marked_texts(s, d, "hira"))),
    "t07_segment_alert": lambda s, d: rows(sg.segment_alert(marked_texts(s, d, "alert"))),
    "t08_segment_elements": lambda s, d: sg.segment_fps_elements(elements(s, d)).withColumns(
        {c: F.col(c).cast("bigint") for c in ("first_position", "page")}),
    "t09_segment_fps": lambda s, d: rows(sg.segment_fps(marked_texts(s, d, "fps"))),
    "t12_split_segments": lambda s, d: chunk_rows(whole_text_pieces(s, d)),
    "t12_rebuilt_texts": rebuilt_texts,
    "t15_fixed_size_chunks": lambda s, d: ch.fixed_size_chunks(read_texts(s, d).select("doc_id", "text")).select(
        "doc_id", "text", *[F.col(c).cast("bigint").alias(c) for c in
                            ("chunk_index", "tokens", "line_start", "line_end")]),
    "t16_element_types": lambda s, d: ch.text_elements(marked_texts(s, d, "fps").withColumn("text", F.regexp_replace("text", r"\n", "\n\n"))).select(
        "doc_id", F.col("position").cast("bigint").alias("position"), "type"),
    "t17_page_furniture": lambda s, d: read_texts(s, d).select(
        "doc_id", ch.is_page_header(F.concat(F.lit("Página 3\nCorporativo\n"), F.when(F.col("lang") == "en", "Instruções\n").otherwise(""), "text")).alias("header"),
        ch.is_page_footer(F.element_at(F.split("text", " "), -1)).alias("footer")),
    "t18_outline": outline_rows,
    "t18_keyword_frequencies": lambda s, d: ch.keyword_frequencies(
        read_texts(s, d).select(F.concat(F.regexp_replace("text", VOWEL_LINE, "\nRiscos e perigo, Controles$1 "), F.lit(" objetivo")).alias("text"))),
    "t19_chunk_locations": chunk_locations,
}
