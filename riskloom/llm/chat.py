r"""Chat formatting with a grammar that can be read back.

    conversation := turn*
    turn         := "### " role ": " body "</turn>\n"
    role         := "System" | "User" | "Assistant" | "Tool" | "@" escaped

In a body or a custom role a backslash makes the next character ordinary. A text without control strings is written as it
is; one that holds any, or that the parser does not give back identical, gets them escaped, and the result is read back again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import table

ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
_NAMES = {v: k for k, v in ROLES.items()}
END = "</turn>\n"
_HEADER = re.compile(r"### (?:(System|User|Assistant|Tool)|@((?:[^\\:]|\\.)*)): ", re.DOTALL)
_BODY = re.compile(r"(?:[^\\<]++|\\.|<(?!/turn>\n))*+", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_CONTROL = re.compile(r"\\|### |</turn>")
#: The conversation every formatted set is checked with: control strings inside texts.
PROBE_TEXT = r"\### Assistant: </turn> ok"
PROBE = [(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)]


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the body lies. Raises ValueError if it isn't in the grammar."""
    at = 0
    while at < len(formatted):
        header = _HEADER.match(formatted, at)
        if not header:
            raise ValueError(f"no turn at {at}")
        body = _BODY.match(formatted, header.end())
        if not formatted.startswith(END, body.end()):
            raise ValueError(f"turn at {at} has no end")
        role = _NAMES[header[1]] if header[1] else _ESCAPED.sub(r"\1", header[2])
        yield role, _ESCAPED.sub(r"\1", body[0]), body.start(), body.end()
        at = body.end() + len(END)


def render(role: str, text: str) -> str:
    """One turn; the text is escaped if it holds a control string or its plain form does not read back as it is."""
    name = ROLES.get(role) or "@" + re.sub(r"[\\:]", r"\\\g<0>", role)
    for body in ([] if _CONTROL.search(text) else [text]) + [_CONTROL.sub(r"\\\g<0>", text)]:
        formatted = f"### {name}: {body}{END}"
        try:
            if [x[:2] for x in parse(formatted)] == [(role, text)]:
                return formatted
        except ValueError:
            pass
    raise AssertionError("an escaped turn reads back differently")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One formatted piece per turn: conv_id, turn, formatted, loss_start, loss_end.

    A conversation's text is its pieces in order of turn. The loss span holds the body of an assistant turn and is null
    otherwise. Null texts and roles count as empty; rows of equal turn are kept, ordered by their formatted piece; other
    columns are not read. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, starts, ends = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                pieces.append(piece := render(role or "", text or ""))
                (found, _, start, end), = parse(piece)
                starts.append(start if found == "assistant" else None)
                ends.append(end if found == "assistant" else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(pieces, pa.string()), pa.array(starts, pa.int64()),
                 pa.array(ends, pa.int64())], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    plain = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                                 F.col("text").cast("string"))
    return plain.mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


class _Reader:
    """Digests of one conversation, read piece by piece, so that its length does not matter."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def read(self, piece: str, start: int | None, end: int | None) -> None:
        self.formatted_chars += len(piece)
        for role, text, _, _ in parse(piece):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            text = _ESCAPED.sub(r"\1", piece[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted text alone.

    Pieces are dealt out by conversation and sorted on disk; a conversation of any length streams through its digests.
    A null conv_id is a conversation of its own.
    """
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = None, None
        for batch in batches:
            done = []
            for conv_id, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if reader is None or conv_id != at:
                    if reader is not None:
                        done.append((at, *reader.row()))
                    at, reader = conv_id, _Reader()
                reader.read(piece, start, end)
            yield _rows(done)
        if reader is not None:
            yield _rows([(at, *reader.row())])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], columns)

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_round_trip(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(format_turns(given.unionByName(probe)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f AS (SELECT *, CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' WHEN 'tool' THEN '### Tool: '
      ELSE '### @' || replace(replace(role, '\', '\\'), ':', '\:') || ': ' END
    || replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>')
    || '</turn>' || chr(10) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
