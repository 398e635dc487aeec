import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from riskloom.llm import bpe

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [None, "", " ", "\n\n \t x", "a" * 5000, "ab" * 3000, "!" * 777, " " * 3001, "\U0001f600\u200d\u00e9\u4e2d\u6587", "it's <|endoftext|> they'll", "\x00\x01", "Zürich 12345678901234567890"]


def test_matches_the_library_on_odd_and_random_texts(library):
    codec, pick = bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(5)
    alphabet = "abcdeé ñ\n .,0123!!中𝄞ThE'sll"
    texts = [t or "" for t in ODD] + ["".join(pick.choices(alphabet, k=pick.randrange(1, 120))) for _ in range(1500)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_appends_and_edits_equal_a_fresh_encoding():
    v, pick = bpe.Vocabulary(RANKS), random.Random(6)
    for _ in range(60):
        data = bytes(pick.choices(b"abcdehtion tsr", k=40))
        grown = bpe.PrefixEncoder(v, data[:13])
        grown.append(data[13:])
        assert grown.tokens() == v.merged(data) and grown.tokens(20) == v.merged(data[:20])
        grown.replace(10, 15, b"zing")
        assert grown.tokens() == v.merged(data[:10] + b"zing" + data[15:])


def test_an_edit_in_a_long_text_leaves_what_follows():
    v, pick = bpe.Vocabulary(RANKS), random.Random(7)
    data = bytes(pick.choices(b"abcdehtion tsr", k=6 * v.longest + 50))
    for start, stop, new in ((3, 9, b"xyz"), (100, 100, b" more of it"), (40, 90, b""), (len(data) - 5, len(data), b"end"), (0, len(data), b"")):
        edited = bpe.PrefixEncoder(v, data)
        edited.replace(start, stop, new)
        fresh = bpe.PrefixEncoder(v, data[:start] + new + data[stop:])
        assert (edited.data, edited.last) == (fresh.data, fresh.last)


def test_tables_of_matches_stay_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    codec, pick = bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(8)
    for _ in range(60):
        texts = [" ".join("".join(pick.choices("abcdexyz", k=9)) for _ in range(7)) for _ in range(3)]
        assert codec.encode_all(texts) == [library.encode_ordinary(t) for t in texts]
        assert len(codec.pieces) - codec.pieces.begun <= 20 + 21 and len(codec.vocabulary.fit) <= 20


def test_operator(spark, docs_of, library):
    rows = list(enumerate(ODD)) + [(3, "x"), (3, "x"), (None, "no id")]
    got = bpe.digests(bpe.encode(docs_of(rows))).collect()
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.digests(bpe.encode(docs_of([]))).count() == 0


def test_query_matches_the_library(spark, library):
    from tests.llm.conftest import SF
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op8_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
