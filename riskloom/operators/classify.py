"""Document type detection by rules and by weighted patterns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: phrases that mark a document type, in order of precedence ---------
# (type, substrings of the file name, substrings of the content)
TYPE_RULES = (
    ("fmea", ("fmea",), ("failure mode",)),
    ("ipar", ("ipar",), ("ipar", "identificação de perigos", "investigação de perigo", "avaliação dos riscos de segurança")),
    ("hira", ("hira",), ("hira", "hazard identification", "risk assessment", "identificação de riscos")),
    ("alert", ("alert", "gppm", "incident", "alerta"),
     ("gppm", "safety alert", "alerta de segurança", "incident report", "lesson learned", "lição aprendida")),
    ("fps", ("fps", "safety st", "am safety", "procedimento fundamental", "normas de operações"),
     ("fps", "safety st", "am safety", "procedimento fundamental", "normas de operações")),
)
# (type, weight, file name patterns, content patterns)
PATTERN_RULES = (
    ("fmea", 1.0, (r"fmea",), (r"failure\s*mode", r"fmea", r"modo\s*de\s*falha")),
    ("ipar", 1.0, (r"ipar",), (r"ipar", r"identificação\s*de\s*perigos", r"investigação\s*de\s*perigo",
                               r"avaliação\s*dos\s*riscos\s*de\s*segurança")),
    ("hira", 1.2, (r"\bhira\b", r"hazard\s*identification"),
     (r"\bhira\b", r"hazard\s*identification", r"risk\s*assessment", r"identificação\s*de\s*riscos")),
    ("alert", 1.1, (r"alert", r"gppm", r"incident", r"alerta"),
     (r"gppm", r"safety\s*alert", r"alerta\s*de\s*segurança", r"incident\s*report", r"lesson\s*learned", r"lição\s*aprendida")),
    ("fps", 0.8, (r"\bfps\b", r"safety\s*st\s*\d"),
     (r"\bfps\b", r"procedimento\s*fundamental", r"normas\s*de\s*operações", r"fundamental\s*safety")),
)
NAME_HIT, CONTENT_HIT, FLOOR = 0.5, 0.3, 0.3
# --------------------------------------------------------------------------------------


def detect_type(name: Column, content: Column) -> Column:
    """First rule whose phrase occurs in the file name or the content; 'generic' if none does."""
    name, content = F.lower(name), F.lower(content)
    kind = F.lit("generic")
    for document_type, in_name, in_content in reversed(TYPE_RULES):
        hit = reduce(or_, [name.contains(p) for p in in_name] + [content.contains(p) for p in in_content])
        kind = F.when(hit, document_type).otherwise(kind)
    return kind


def classify(documents: DataFrame, name: str = "name", content: str = "text",
             preview_chars: int | None = None) -> DataFrame:
    """Adds document_type, confidence and matched_patterns by weighted pattern hits.

    The rule with the highest score wins, the earlier one on a tie. The whole text is graded
    unless ``preview_chars`` (500 for the quick preview grading) limits it to the opening.
    """
    body = F.col(content) if preview_chars is None else F.substring(F.col(content), 1, preview_chars)
    lower_name, preview = F.lower(F.col(name)), F.lower(body)
    scored = []
    for document_type, weight, in_name, in_content in PATTERN_RULES:
        hits = ([(lower_name.rlike(p), NAME_HIT, f"filename:{p}") for p in in_name]
                + [(preview.rlike(p), CONTENT_HIT, f"content:{p}") for p in in_content])
        score = reduce(lambda a, b: a + b, [F.when(hit, points).otherwise(0.0) for hit, points, _ in hits])
        patterns = F.filter(F.array(*[F.when(hit, F.lit(label)) for hit, _, label in hits]), lambda p: p.isNotNull())
        scored.append(F.struct((score * weight).alias("score"), F.lit(document_type).alias("type"), patterns.alias("patterns")))
    rules = F.array(*scored)
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit("generic").alias("type"), F.array().cast("array<string>").alias("patterns"))
    best = F.aggregate(rules, nothing, lambda best, rule: F.when(rule["score"] > best["score"], rule).otherwise(best))
    return documents.withColumn("_best", best).withColumns({
        "document_type": F.col("_best.type"),
        "confidence": F.when(F.col("_best.score") > 0, F.least(F.col("_best.score"), F.lit(1.0))).otherwise(F.lit(FLOOR)),
        "matched_patterns": F.col("_best.patterns"),
    }).drop("_best")
