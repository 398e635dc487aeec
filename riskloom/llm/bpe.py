"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string there is exactly one token that can end its encoding. The encoder stores that token
per prefix, so appending bytes never revisits earlier prefixes, and a changed byte only affects the prefixes from it on.

A sequence of tokens is the encoding of its bytes if and only if each token encodes to itself and each two neighbours
encode to themselves. The table of prefixes follows: the last token of a prefix is the longest vocabulary entry that ends
there and is compatible with the stored last token of the prefix before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import prepare, table, texts

#: Bytes of a rank file that may be broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Matches that a worker keeps the ids of (and as many pairs of tokens), and the longest match that is kept.
CACHE_ENTRIES, KEPT_BYTES = 500_000, 64


class _Bounded(dict):
    """A table that begins with some entries; ``room`` leaves the newer half of the others once they are ``most``."""

    def __init__(self, most: int, begun: dict | None = None) -> None:
        super().__init__(begun or {})
        self.most, self.begun = most, len(self)

    def room(self) -> None:
        if len(self) - self.begun >= self.most:
            for key in list(islice(self, self.begun, len(self) - self.most // 2)):
                del self[key]


class _Fit(_Bounded):
    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(CACHE_ENTRIES)
        self.vocabulary = vocabulary

    def __missing__(self, pair: int) -> bool:
        self.room()
        known = self[pair] = self.vocabulary.fits(pair >> 32, pair & 0xFFFFFFFF)
        return known


class Vocabulary:
    """Ranks of a byte-level BPE and the test whether two tokens may stand next to each other."""

    def __init__(self, rank_file: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.tokens = {i: b for b, i in self.ranks.items()}
        #: Trie of the tokens from their last byte to their first: the next node by node << 8 | byte, and each node's token or -1.
        self.step, self.token_at = {}, [-1]
        for b, i in self.ranks.items():
            node = 0
            for byte in reversed(b):
                node = self.step.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.longest = max(map(len, self.ranks), default=1)
        self.lengths = {i: len(b) for i, b in self.tokens.items()}
        #: What ``fits`` says, by left << 32 | right.
        self.fit = _Fit(self)
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """Encoding of a short byte string by its definition: merge the lowest rank, leftmost first, down to ``until`` parts."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > until:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, None for a single byte."""
        if token not in self._halves:
            data = self.tokens[token]
            self._halves[token] = tuple(self.merged(data, 2)) if len(data) > 1 else None  # type: ignore[assignment]
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        halves = self.halves(token)
        return halves is None or len(halves) == 2 and self.ranks.get(self.tokens[halves[0]] + self.tokens[halves[1]]) == token

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; left -1 is the start of the text.

        Merges are undone from the latest to the earliest, next to the border only. The two may stand side by side unless, at
        some moment, the parts at the border would have merged before the next merge of either side.
        """
        return self.reachable(right) and (left < 0 or self._stay_apart(left, right))

    def _stay_apart(self, left: int, right: int) -> bool:
        tokens, ranks, never = self.tokens, self.ranks, 1 << 60
        limit = never  # rank of the merge undone last; the left one of two equal ranks merges first
        while True:
            joined = ranks.get(tokens[left] + tokens[right], never)
            if joined < limit:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]


class PrefixEncoder:
    """Encoding of a growing byte string: ``last[j]`` is the last token of the encoding of the first j bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        first = len(self.data)
        self.data += data
        whole, last, fit = self.data, self.last, self.vocabulary.fit
        step, token_at, lengths = self.vocabulary.step, self.vocabulary.token_at, self.vocabulary.lengths
        for end in range(first + 1, len(whole) + 1):
            node, at, ending = 0, end, []  # tokens that end here, shortest first
            while at:
                at -= 1
                node = step.get(node << 8 | whole[at])
                if node is None:
                    break
                if token_at[node] >= 0:
                    ending.append(token_at[node])
            while ending:
                token = ending.pop()
                if fit[last[end - lengths[token]] << 32 | token]:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def cut(self, end: int) -> None:
        """Back to the first ``end`` bytes."""
        del self.data[end:], self.last[end + 1:]

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Re-encodes after an edit. Prefixes before ``start`` keep their tokens, and behind the edit the old ones come back.

        A prefix's last token follows from those of as many prefixes before it as the longest token has bytes. Once so many in
        a row are what they were, so are all that follow.
        """
        reach, old, tail = self.vocabulary.longest, self.last[stop:], bytes(self.data[stop:])
        self.cut(start)
        self.append(data)
        for at in range(0, len(tail), reach):
            self.append(tail[at:at + reach])
            done = at + reach
            if done < len(tail) and self.last[-reach:] == old[done - reach + 1:done + 1]:
                self.data += tail[done:]
                self.last += old[done + 1:]
                break

    def tokens(self, end: int | None = None) -> list[int]:
        """Ids of the first ``end`` bytes (all, if none is given): from the end, each last token tells the prefix before it."""
        out, at, last, lengths = [], len(self.data) if end is None else end, self.last, self.vocabulary.lengths
        while at:
            token = last[at]
            out.append(token)
            at -= lengths[token]
        return out[::-1]


class Codec:
    """Splits texts by the pattern, encodes each match on its own, and decodes ids.

    ``pieces`` holds the ids of matches by their text; those that are a token as a whole are there from the start. The others of
    a batch are encoded in order, so that each takes over the table of the prefix it shares with the one before.
    """

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.vocabulary, self.split = Vocabulary(rank_file), regex.compile(pattern).findall
        self.bytes_of = self.vocabulary.tokens.__getitem__
        whole = {}
        for token, data in self.vocabulary.tokens.items():
            try:
                whole[data.decode()] = (token,)
            except UnicodeDecodeError:  # part of a character, so no match by itself
                continue
        self.pieces = _Bounded(CACHE_ENTRIES, whole)

    def encode_all(self, batch: list[str]) -> list[list[int]]:
        split, pieces, long = [self.split(text) for text in batch], self.pieces, []
        pieces.room()
        encoder = PrefixEncoder(self.vocabulary)
        for data in sorted(p.encode() for p in set(chain.from_iterable(split)).difference(pieces)):
            before, same = encoder.data, 0
            for a, b in zip(before, data):
                if a != b:
                    break
                same += 1
            encoder.cut(same)
            encoder.append(data[same:])
            piece = data.decode()
            pieces[piece] = tuple(encoder.tokens())
            if len(data) > KEPT_BYTES:
                long.append(piece)
        ids = [list(chain.from_iterable(map(pieces.__getitem__, found))) for found in split]
        for piece in long:
            del pieces[piece]
        return ids

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of, ids))


_codecs: dict[str, Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds to each row its token ids and the bytes that these ids decode to: doc_id, ids array<int>, decoded binary.

    Null and empty texts have no ids and decode to no bytes. Every row is encoded on its own, so repeated rows stay
    repeated and null ids pass through; other columns are not read. Whole texts, one Arrow batch at a time, no shuffle.
    """
    rank_file = Path(vocabulary_path or public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    if len(rank_file) > MAX_VOCABULARY_BYTES:
        raise ValueError("the rank file is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            ids = codec.encode_all(texts(batch.column("text")))
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array([codec.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: digests of the encoded texts."""
    prepare(spark)
    return digests(encode(docs))
