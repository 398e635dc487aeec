import math
import re

import pytest

from riskloom.operators import chunk as ch
from riskloom.operators import segment as sg


def docs(spark, *texts, **extra):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, text string")


def count(text):
    return math.ceil(len(text) / 4)


def brute_pack(text, limit, overlap):
    """Greedy packing with overlap, straight from the definition."""
    pieces, glue = re.split(r"(?<=[.!?])\s+", text), " "
    if len(pieces) < 2:
        pieces, glue = re.split(r"\n+", text), "\n"
    runs = [[]]
    for piece in pieces:
        if runs[-1] and sum(map(count, runs[-1])) + count(piece) > limit:
            runs.append([])
        runs[-1].append(piece)
    out = []
    for run in runs:
        lead, used = [], 0
        if out:
            for sentence in reversed(re.split(r"(?<=[.!?])\s+", out[-1])):
                if used + count(sentence) > overlap:
                    break
                lead.insert(0, sentence)
                used += count(sentence)
        prefix = " ".join(lead).strip()
        out.append(f"{prefix} {glue.join(run)}" if prefix else glue.join(run))
    return out


def brute_windows(text, context, limit, overlap, depth):
    width = 4 * limit - len(f"[{context}]\n")
    starts = [0]
    while starts[-1] + width < len(text):
        starts.append(starts[-1] + width - 4 * overlap)
    return [(f"[{context}]\n{text[s:s + width]}", depth + 1) for s in starts]


def brute_split(text, context, limit, overlap, depth=0):
    parts = brute_pack(text, limit, overlap)
    if len(parts) == 1:
        return brute_windows(text, context, limit, overlap, depth)
    out = []
    for part in parts:
        body = f"[{context}]\n{part}"
        if count(body) <= limit:
            out.append((body, depth + 1))
        elif depth + 1 == ch.TEXT_LEVELS:
            out += brute_windows(body, context, limit, overlap, depth + 1)
        else:
            out += brute_split(body, context, limit, overlap, depth + 1)
    return out


@pytest.mark.parametrize("limit,overlap", [(40, 5), (60, 20), (25, 0)])
def test_split_matches_brute_force(spark, limit, overlap):
    texts = [
        "Short one.", "One sentence here. " * 30, "no sentence end at all " * 40, "line without stop\n" * 25,
        " ".join(f"Sentence number {i} is {'long ' * (i % 9)}indeed." for i in range(40)), "x" * 900, "A b. " + "y" * 700 + ". Tail! Is it? Yes.",
    ]
    from pyspark.sql import functions as F
    segments = docs(spark, *texts).select("document_id", F.lit(0).alias("segment_index"), "text", F.lit("k").alias("semantic_type"), F.lit("ctx").alias("context"))
    got = {}
    for r in ch.split_segments(segments, max_tokens=limit, overlap_tokens=overlap).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append((r.text, r.split_depth))
        assert r.tokens == count(r.text) <= limit and r.is_oversized == (r.split_depth > 0)
    for i, text in enumerate(texts):
        want = [(text, 0)] if count(text) <= limit else brute_split(text, "ctx", limit, overlap)
        assert got[str(i)] == want, i


def test_fixed_chunks_cover_lines_and_repeat_the_overlap(spark):
    text = "\n".join(f"line {i} " + "w" * (i * 7 % 50) for i in range(120))
    lines = text.split("\n")
    rows = ch.fixed_size_chunks(docs(spark, text, ""), max_tokens=60, overlap_tokens=20).orderBy("document_id", "chunk_index").collect()
    first = [r for r in rows if r.document_id == "0"]
    assert [r.chunk_index for r in first] == list(range(len(first)))
    covered = set()
    for previous, r in zip([None] + first, first):
        assert r.text == "\n".join(lines[r.line_start - 1:r.line_end])
        covered |= set(range(r.line_start, r.line_end + 1))
        if previous:
            repeated = lines[r.line_start - 1:previous.line_end]
            assert sum(map(count, repeated)) <= 20
            extra = lines[r.line_start - 2] if r.line_start - 1 > previous.line_start - 1 else None
            assert extra is None or sum(map(count, [extra, *repeated])) > 20
            # The end of a chunk is exact; its start is shifted by the inner breaks of the repeated lines.
            assert text[:previous.end_char] == "\n".join(lines[:previous.line_end])
            exact = len("\n".join(lines[:r.line_start - 1])) + 1
            assert r.start_char == exact - max(len(repeated) - 1, 0)
    assert covered == set(range(1, 121)) and first[-1].end_char == len(text)
    assert [(r.text, r.line_start, r.line_end) for r in rows if r.document_id == "1"] == [("", 1, 1)]


def test_generic_sections(spark):
    text = "# Top\n\nA paragraph that is long enough.\n\nshort\n\nUnder lined\n-----\n\nAnother paragraph, long enough too.\nSecond line."
    plain = "First paragraph of the text.\n\nSecond paragraph of the text."
    got = sg.segment_generic(docs(spark, text, plain), limits=sg.STRICT).collect()
    assert [(r.document_id, r.section, r.line_start, r.line_end) for r in got] == [
        ("0", "Top", 3, 4), ("0", "Under lined", 4, 6), ("1", "Document", 1, 2), ("1", "Document", 3, 4)]


def test_no_line_is_left_out(spark):
    """By default every line that is not blank comes back in some segment, as text or as the title of a section."""
    texts = ["a\n\n# Top\n\nb\n\nUnder\n-----\n\nc", "x", "ab\n1. Escopo\nc\n2. Objetivo\nd", "Alert: A-1\nL\nM\nN\nRoot cause:\nq\nLesson learned\nz",
             "Processo: S\n1\n2\n3\n4\n5\n1. Ruído x\nb\nc\nd\n2. Queda\ne", "p\n\nq\n\nr" + "\nl" * 40 + "\n\ntail"]
    rules = ("# Top", "-----")
    for segmenter in (sg.segment_generic, sg.segment_ipar, sg.segment_hira, sg.segment_alert, sg.segment_fps):
        got = {}
        for r in segmenter(docs(spark, *texts)).collect():
            got.setdefault(r.document_id, []).extend([*map(str.strip, r.text.split("\n")), r.section, *r.section.split(":")])
        for i, text in enumerate(texts):
            for line in filter(None, map(str.strip, text.split("\n"))):
                if line not in rules or segmenter is not sg.segment_generic:
                    assert line in got[str(i)] or line.rstrip(":") in got[str(i)] or any(line in x for x in got[str(i)]), (segmenter, line)
    assert sg.segment_fps(docs(spark, texts[2])).select("section").collect()[0].section == "Introduction"


def test_fmea_groups(spark):
    text = ('--- Sheet: Main ---\nProcess,Cause\nWeld,"a, b"\n,second\n,\nWeld,third\nCut,x\n'
            '--- Sheet: Other ---\nNo,Col\n1,2\n')
    got = sg.segment_fmea(docs(spark, text)).orderBy("segment_index").collect()
    assert [(r.text, r.context) for r in got] == [
        ("Process: Weld | Cause: a, b\nCause: second", "Sheet: Main, Row 2-3"), ("Process: Weld | Cause: third", "Sheet: Main, Row 2"),
        ("Process: Cut | Cause: x", "Sheet: Main, Row 6"), ("No: 1 | Col: 2", "Sheet: Other, Row 1")]


def test_ipar_blocks_and_fallback(spark):
    head = "Processo: Solda\nUnidade: Norte\nlinha\nlinha\nlinha\nlinha\n"
    block = "1. Ruído alto no setor\nlinha do bloco de texto\nmais uma linha aqui\nclassificação trivial\n"
    got = sg.segment_ipar(docs(spark, head + block + block, "Processo: Z\n\n" + "palavras simples sem nada " * 4)).orderBy("document_id", "segment_index").collect()
    first = [r for r in got if r.document_id == "0"]
    assert [r.semantic_type for r in first] == ["ipar_audit_header", "ipar_hazard_block", "ipar_hazard_block"]
    assert first[1].context == "Perigo: Ruído (Trivial)" and (first[1].line_start, first[1].line_end) == (7, 10)
    assert first[1].text.startswith("Processo: Solda | Unidade: Norte\nPerigo: Ruído | Classificação: Trivial\n\n1. Ruído")
    # All of the second text is header, so nothing is left for blocks or paragraphs.
    assert [r.semantic_type for r in got if r.document_id == "1"] == ["ipar_audit_header"]


def test_alert_sections(spark):
    text = ("Alert: A-1\nLocation: Plant\nintro line\nmore intro\nRoot cause:\nThe cause was a worn bolt that failed.\n"
            "Lesson learned\nCheck all bolts before every single shift.\n")
    got = sg.segment_alert(docs(spark, text), limits=sg.STRICT_ALERT).orderBy("segment_index").collect()
    assert [r.semantic_type for r in got] == ["alert_header", "alert_root_cause", "alert_lesson_learned"]
    assert got[1].text.startswith("Alert: A-1 | Location: Plant\nSection: Root cause\n\nThe cause") and (got[1].line_start, got[1].line_end) == (5, 6)


def test_fps_text_and_elements(spark):
    got = sg.segment_fps(docs(spark, "lead\n1. Escopo do documento\n" + "texto do escopo " * 5, "nothing here"), limits=sg.STRICT).collect()
    assert [(r.document_id, r.semantic_type) for r in got] == [("0", "fps_scope"), ("1", "fps_document")]
    rows = [("d", 0, "Title", "Escopo", 1), ("d", 1, "NarrativeText", "n" * 60, 1), ("d", 2, "Table", "a | b", 2), ("d", 3, "NarrativeText", "m" * 60, 3)]
    elements = spark.createDataFrame(rows, "document_id string, position int, type string, text string, page int")
    got = sg.segment_fps_elements(elements).orderBy("first_position").collect()
    assert [(r.semantic_type, r.section, r.page) for r in got] == [("fps_scope", "Escopo", 1), ("fps_table", "Escopo", 2), ("fps_scope", "Escopo", 1)]
    assert got[0].text == "Escopo\n\n" + "n" * 60


def test_dispatch_covers_every_type(spark):
    from pyspark.sql import functions as F
    rows = docs(spark, *["Some text that is certainly long enough to be kept. " * 3] * 7).withColumn(
        "document_type", F.element_at(F.array(*[F.lit(t) for t in ("fmea", "ipar", "hira", "alert", "fps", "generic", "odd")]), F.col("document_id").cast("int") + 1))
    assert {r.document_id for r in ch.chunk_documents(rows, max_tokens=50, overlap_tokens=5).collect()} >= {"1", "2", "3", "4", "5", "6"}
