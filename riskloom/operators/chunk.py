"""Token-bounded chunks from segments, fixed-size line chunks, and text inspection.

Packing is a fold over token counts inside the row, which carries break positions only; texts are
sliced once the breaks are known. ``counter`` maps a text column to its token count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import SENTENCE_END, TokenCounter, any_of, estimate_tokens, let, lines_of, strip, with_evaluated
from riskloom.functions.rounding import round_half_up
from riskloom.operators.segment import segment_documents

MAX_TOKENS, OVERLAP_TOKENS = 8192, 100
FIXED_TOKENS, FIXED_OVERLAP = 512, 50
CHARS_PER_TOKEN = 4
TEXT_LEVELS = 4

# --- fixed values: inspection vocabularies and patterns --------------------------------------------
SAFETY_KEYWORDS = (
    "objetivo", "escopo", "definições", "responsabilidades", "procedimentos", "risco", "perigo", "controle",
    "mitigação", "isolamento", "lockout", "tagout", "energia", "elétrica", "altura", "confinado", "espaço",
    "içamento", "veículo", "terceiros", "auditoria", "emergência", "métrica", "investigação", "acidente", "hira",
    "segurança",
)
OUTLINE_PATTERNS = (
    r"^\d+\.\d*\s+[A-ZÁÊÔ]", r"^[A-ZÁÊÔ][a-záêô]+\s*:", r"^[A-ZÁÊÔ\s]{3,}$", r"^[IVX]+\.\s+[A-Z]",
)
OUTLINE_LEVELS = ((r"^\d+\.\d+\.", 3), (r"^\d+\.\d+", 2), (r"^\d+\.", 1), (r"^[A-ZÁÊÔ\s]{5,}$", 1))
ELEMENT_TITLES = (
    "escopo", "definições", "definicoes", "responsabilidades", "procedimentos", "objetivo", "anexo", "apêndice", "appendice",
)
PAGE_HEADERS = (
    r"^página\s*[<\d]", r"^page\s*\d", r"página\s*<\s*\d+\s*de", r"saúde\s*(e|&)\s*segurança", r"am\s*safety\s*st",
    r"am\s*segurança\s*st", r"instruções\s*$", r"technology.*health", r"^espaços\s*$", r"^confinados\s*$",
    r"corporativo", r"circulação\s*controlada",
)
PAGE_FOOTERS = (r"^\d+\s*$", r"^página\s*\d", r"^page\s*\d")
# ----------------------------------------------------------------------------------------------------


# --- token-bounded splitting ---------------------------------------------------------------------------

def _break_positions(pieces: Column, limit: int, counter: TokenCounter) -> Column:
    """First piece of each text when pieces are packed in order into texts of at most ``limit`` tokens."""
    counts = F.transform(pieces, lambda p: counter(p).cast("int"))
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("tokens"), F.lit(0).alias("i"))

    def step(acc: Column, tokens: Column) -> Column:
        cut = (acc["tokens"] + tokens > limit) & (acc["i"] > F.element_at(acc["starts"], -1))
        return let(cut, lambda cut: F.struct(
            F.when(cut, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(cut, tokens).otherwise(acc["tokens"] + tokens).alias("tokens"), (acc["i"] + 1).alias("i")))

    return F.aggregate(counts, start, step, lambda acc: acc["starts"])


def _packed_texts(pieces: Column, starts: Column) -> Column:
    """The packed runs of pieces, each piece already ending in its glue."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(pieces)))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")),
                       lambda s: F.slice(pieces, s["a"] + 1, s["b"] - s["a"]))


def _led_by_overlap(texts: Column, overlap: int, counter: TokenCounter) -> Column:
    """Leads each text with the closing sentences of the one before it, up to ``overlap`` tokens."""
    def tail(text: Column) -> Column:
        state = F.struct(F.lit("").alias("text"), F.lit(0).alias("tokens"), F.lit(False).alias("full"))
        def take(acc: Column, sentence: Column) -> Column:
            return let(counter(sentence).cast("int"), lambda tokens: let(
                acc["full"] | (acc["tokens"] + tokens > overlap), lambda full: F.struct(
                    F.when(full, acc["text"]).otherwise(F.concat(sentence, F.lit(" "), acc["text"])).alias("text"),
                    F.when(full, acc["tokens"]).otherwise(acc["tokens"] + tokens).alias("tokens"), full.alias("full"))))
        return F.aggregate(F.reverse(F.split(text, SENTENCE_END)), state, take, lambda acc: strip(acc["text"]))

    def lead(acc: Column, text: Column) -> Column:
        closing = F.when(F.size(acc) > 0, tail(F.element_at(acc, -1))).otherwise(F.lit(""))
        return let(closing, lambda closing: F.concat(acc, F.array(
            F.when(closing != "", F.concat(closing, F.lit(" "), text)).otherwise(text))))

    return F.aggregate(texts, F.array().cast("array<string>"), lead) if overlap > 0 else texts


def _piece(text: Column, depth: Column, start: Column, end: Column, oversized: bool, settled: Column) -> Column:
    return F.struct(text.alias("text"), depth.cast("int").alias("split_depth"), start.cast("int").alias("start_char"),
                    end.cast("int").alias("end_char"), F.lit(oversized).alias("is_oversized"), settled.alias("settled"))


def _character_windows(text: Column, context: Column, depth: Column, limit: int, overlap: int) -> Column:
    """Windows of 4 x ``limit`` characters with their context, which step back by the overlap and stop at the end of the text."""
    width = F.greatest(F.lit(CHARS_PER_TOKEN * limit) - F.length(context), F.lit(CHARS_PER_TOKEN))
    step = F.greatest(width - CHARS_PER_TOKEN * overlap, F.lit(1))
    windows = F.greatest(F.ceil((F.length(text) - width) / step), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), windows), lambda k: k * step)
    return F.transform(starts, lambda s: _piece(
        F.concat(context, text.substr(s + 1, width)), depth + 1, s, F.least(s + width, F.length(text)), True, F.lit(True)))


def split_segments(segments: DataFrame, key: str = "document_id", max_tokens: int = MAX_TOKENS,
                   overlap_tokens: int = OVERLAP_TOKENS, counter: TokenCounter = estimate_tokens) -> DataFrame:
    """Chunks of at most ``max_tokens``: segments that fit stay whole, others are packed from sentences,
    else lines, else cut by characters; pieces still too long are split again, and after TEXT_LEVELS levels
    cut by characters. No chunk exceeds the limit with its context and overlap, as long as the context leaves
    room for a token and a token has at most CHARS_PER_TOKEN characters.

    Each level of splitting is one explode over the pieces of the level before, so nothing is shuffled
    until pieces are numbered within their segment. ``chunk_index`` holds the segment in its upper and the
    piece in its lower 32 bits, so it is unique in the document.
    """
    keep = [c for c in segments.columns if c != "text"]
    context = F.concat(F.lit("["), F.coalesce("context", F.lit("")), F.lit("]\n"))
    text, depth = F.col("piece.text"), F.col("piece.split_depth")
    fits = counter(F.col("text")) <= max_tokens
    rows = segments.filter(strip(F.coalesce("text", F.lit(""))) != "").select(
        *keep, F.array().cast("array<int>").alias("path"),
        _piece(F.col("text"), F.lit(0), F.lit(0), F.length("text"), False, fits).alias("piece"))
    for _ in range(TEXT_LEVELS):
        sentences = F.split(text, SENTENCE_END)
        rows = with_evaluated(rows, by_sentence=F.size(sentences) > 1)
        # Settled pieces have nothing to pack.
        rows = with_evaluated(rows, parts=F.when(F.col("piece.settled"), F.array().cast("array<string>"))
                              .when(F.col("by_sentence"), sentences).otherwise(F.split(text, r"\n+")))
        rows = with_evaluated(rows, starts=_break_positions(F.col("parts"), max_tokens, counter))
        runs = F.transform(_packed_texts(F.col("parts"), F.col("starts")), lambda run: F.when(
            F.col("by_sentence"), F.array_join(run, " ")).otherwise(F.array_join(run, "\n")))
        rows = with_evaluated(rows, packed=_led_by_overlap(runs, overlap_tokens, counter))
        def split_piece(part: Column) -> Column:
            return let(F.concat(context, part), lambda body: _piece(
                body, depth + 1, F.lit(0), F.length(body), True, counter(body) <= max_tokens))
        by_text = F.transform("packed", split_piece)
        by_chars = _character_windows(text, context, depth, max_tokens, overlap_tokens)
        pieces = F.when(F.col("piece.settled"), F.array("piece")).when(F.size("packed") > 1, by_text).otherwise(by_chars)
        rows = rows.select(*keep, "path", F.posexplode(pieces).alias("at", "piece")).select(
            *keep, F.concat("path", F.array("at")).alias("path"), "piece")
    pieces = F.when(F.col("piece.settled"), F.array("piece")).otherwise(_character_windows(text, context, depth, max_tokens, overlap_tokens))
    rows = rows.select(*keep, "path", F.posexplode(pieces).alias("at", "piece")).select(*keep, F.concat("path", F.array("at")).alias("path"), "piece")
    nth = F.row_number().over(Window.partitionBy(key, "segment_index").orderBy("path")) - 1
    return rows.select(*keep, "piece.*", "path").withColumns({
        "chunk_index": F.shiftleft(F.col("segment_index").cast("bigint"), 32) + nth,
        "tokens": counter(F.col("text")).cast("int")}).drop("path", "settled")


def chunk_documents(documents: DataFrame, text: str = "text", key: str = "document_id", max_tokens: int = MAX_TOKENS,
                    overlap_tokens: int = OVERLAP_TOKENS, counter: TokenCounter = estimate_tokens) -> DataFrame:
    """Segments documents by type and splits the segments into chunks."""
    return split_segments(segment_documents(documents, text), key, max_tokens, overlap_tokens, counter)


def chunk_job_statistics(chunks: DataFrame, by: str = "document_type") -> DataFrame:
    """Chunks, rounded mean and maximum tokens, oversized chunks per ``by``."""
    return chunks.groupBy(by).agg(
        F.count(F.lit(1)).alias("chunks"), round_half_up(F.avg("tokens"), 0).alias("avg_tokens"),
        F.max("tokens").cast("bigint").alias("max_tokens"),
        F.sum(F.col("is_oversized").cast("int")).alias("oversized"))


# --- fixed-size chunks -----------------------------------------------------------------------------------

def fixed_size_chunks(documents: DataFrame, text: str = "text", max_tokens: int = FIXED_TOKENS,
                      overlap_tokens: int = FIXED_OVERLAP, counter: TokenCounter = estimate_tokens) -> DataFrame:
    """Line chunks of about ``max_tokens`` that repeat the closing lines of the chunk before.

    Output: document columns + chunk_index, text, tokens, line_start, line_end, start_char, end_char.
    """
    keep = [c for c in documents.columns if c != text]
    rows = with_evaluated(documents, _lines=lines_of(F.col(text)))
    rows = with_evaluated(rows, _costs=F.transform("_lines", lambda line: F.struct(
        counter(F.concat(line, F.lit("\n"))).cast("int").alias("line"), counter(line).cast("int").alias("bare"),
        F.length(line).alias("chars"))))

    def overlap_lines(start: Column, at: Column) -> Column:
        """How many lines before ``at``, not before ``start``, fit the overlap."""
        state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"), F.lit(False).alias("full"))
        def take(acc: Column, cost: Column) -> Column:
            full = acc["full"] | (acc["tokens"] >= overlap_tokens) | (acc["tokens"] + cost["bare"] > overlap_tokens)
            return F.struct(F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"),
                            F.when(full, acc["tokens"]).otherwise(acc["tokens"] + cost["bare"]).alias("tokens"), full.alias("full"))
        return F.aggregate(F.reverse(F.slice("_costs", start + 1, at - start)), state, take, lambda acc: acc["n"])

    # The fold carries finished spans and, for the open chunk: its first line, how many of its lines
    # repeat, where its first fresh character stands, its tokens, and the line and character reached.
    empty = F.array().cast("array<struct<start:int,end:int,overlap:int,fresh:int,until:int>>")
    begin = F.struct(empty.alias("done"), *[F.lit(0).alias(c) for c in ("start", "overlap", "fresh", "tokens", "i", "at")])
    span = lambda acc, until: F.struct(acc["start"].alias("start"), acc["i"].alias("end"), acc["overlap"].alias("overlap"),
                                       acc["fresh"].alias("fresh"), until.alias("until"))

    def advance(acc: Column, cost: Column, cut: Column, repeat: Column) -> Column:
        # Tokens of the repeated lines are counted on their joined text.
        repeated = F.when(repeat > 0, counter(F.array_join(F.slice("_lines", acc["i"] - repeat + 1, repeat), "\n")).cast("int")).otherwise(F.lit(0))
        return F.struct(
            F.when(cut, F.concat(acc["done"], F.array(span(acc, acc["at"] - 1)))).otherwise(acc["done"]).alias("done"),
            F.when(cut, acc["i"] - repeat).otherwise(acc["start"]).alias("start"),
            F.when(cut, repeat).otherwise(acc["overlap"]).alias("overlap"),
            F.when(cut, acc["at"]).otherwise(acc["fresh"]).alias("fresh"),
            (F.when(cut, repeated).otherwise(acc["tokens"]) + cost["line"]).cast("int").alias("tokens"),
            (acc["i"] + 1).alias("i"), (acc["at"] + cost["chars"] + 1).alias("at"))

    def step(acc: Column, cost: Column) -> Column:
        full = (acc["tokens"] + cost["line"] > max_tokens) & (acc["i"] > acc["start"])
        return let(full, lambda cut: let(F.when(cut, overlap_lines(acc["start"], acc["i"])),
                                         lambda repeat: advance(acc, cost, cut, repeat)))

    spans = F.aggregate("_costs", begin, step, lambda acc: F.concat(acc["done"], F.array(span(acc, acc["at"] - 1))))
    chunks = rows.select(*keep, "_lines", F.posexplode(spans).alias("chunk_index", "_s"))
    start, end, repeat = F.col("_s.start"), F.col("_s.end"), F.col("_s.overlap")
    joined = lambda n: F.array_join(F.slice("_lines", start + 1, n), "\n")
    chunks = chunks.withColumn("text", joined(end - start))
    return chunks.select(
        *keep, "chunk_index", "text", counter(F.col("text")).cast("int").alias("tokens"),
        (start + 1).alias("line_start"), end.alias("line_end"),
        (F.col("_s.fresh") - F.length(joined(repeat)) - repeat).alias("start_char"), F.col("_s.until").alias("end_char"))


# --- inspection --------------------------------------------------------------------------------------------

def element_type(text: Column) -> Column:
    """Title, ListItem or NarrativeText for one paragraph."""
    body = strip(text)
    return (
        F.when(F.rlike(body, F.lit(r"^\d+\.?\s*[–\-:.]?\s*[A-ZÁÊÔÇ]")) & (F.length(body) < 100), "Title")
        .when(F.rlike(F.lower(body), F.lit("^" + any_of(ELEMENT_TITLES))) & (F.length(body) < 80), "Title")
        .when(F.rlike(body, F.lit(r"^[\-•●○◦▪]\s+")), "ListItem")
        .when(F.rlike(body, F.lit(r"^\d+\.\d+\.\d+\.?\s+")), "ListItem")
        .otherwise("NarrativeText"))


def text_elements(documents: DataFrame, text: str = "text") -> DataFrame:
    """Typed paragraphs (blank-line separated) in order; page furniture is left out."""
    keep = [c for c in documents.columns if c != text]
    rows = documents.select(*keep, F.posexplode(F.split(F.col(text), r"\n\n+")).alias("position", "text"))
    rows = rows.filter((strip(F.col("text")) != "") & ~is_page_header(F.col("text")))
    return rows.withColumn("type", element_type(F.col("text")))


def is_page_header(text: Column, extra_patterns: tuple[str, ...] = ()) -> Column:
    """At least three of the first five lines look like a repeated page header."""
    pattern = "|".join(PAGE_HEADERS + extra_patterns)
    opening = F.slice(F.split(strip(F.lower(text)), "\n"), 1, 5)
    return F.size(F.filter(opening, lambda line: F.rlike(strip(line), F.lit(pattern)))) >= 3


def is_page_footer(text: Column) -> Column:
    """A page-number line, for text known to stand at the foot of a page."""
    return F.rlike(strip(F.lower(text)), F.lit("|".join(PAGE_FOOTERS)))


def outline(documents: DataFrame, text: str = "text") -> DataFrame:
    """Section headings with line number and level; a numbered heading also yields its bare title."""
    keep = [c for c in documents.columns if c != text]
    rows = documents.select(*keep, F.posexplode(lines_of(F.col(text))).alias("_at", "_line")).withColumn("_line", strip(F.col("_line")))
    line = F.col("_line")
    level = F.lit(2)
    for pattern, value in reversed(OUTLINE_LEVELS):
        level = F.when(F.rlike(line, F.lit(pattern)), value).otherwise(level)
    numbered = r"^(\d+)\.(\d*)\s+(.+)$"
    hits = F.filter(F.array(
        F.when(F.rlike(line, F.lit("|".join(OUTLINE_PATTERNS))), F.struct(line.alias("heading"), level.alias("level"))),
        F.when(F.rlike(line, F.lit(numbered)), F.struct(
            F.regexp_extract(line, numbered, 3).alias("heading"),
            F.when(F.regexp_extract(line, numbered, 2) != "", 2).otherwise(1).alias("level"))),
    ), lambda h: h.isNotNull())
    return (rows.filter(F.length(line) >= 3).select(*keep, (F.col("_at") + 1).alias("line"), F.explode(hits).alias("h"))
            .select(*keep, "line", "h.heading", "h.level"))


def keyword_frequencies(documents: DataFrame, text: str = "text", keywords: tuple[str, ...] = SAFETY_KEYWORDS) -> DataFrame:
    """Occurrences over the corpus of words that begin with each keyword, most frequent first.

    No keyword may begin with another one.
    """
    pattern = rf"(?<![A-Za-z0-9_])({'|'.join(keywords)})\w*"
    hits = documents.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(1))).alias("keyword"))
    return hits.groupBy("keyword").agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), "keyword")
