"""The pipeline against brute-force versions of its stages, each on its own input."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_bpe import RANKS
from tests.llm.test_decontaminate import brute as brute_matches
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_neardocs import brute_groups

from riskloom.llm import bpe, quality
import public_tokenizers


#: Ids of the edited copies, each of a long document that is in the table.
EDITED = (10_000_000, 10_000_020)


def folder_with(spark, path, rows):
    """The tables of the pipeline, the documents with some rows more."""
    for name in ("documents", "benchmark", "labels"):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        (table.unionByName(spark.createDataFrame(rows, table.schema)) if name == "documents" else table).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def edited_copies(spark):
    """Copies of good, long one-line documents of many words, with one word in sixty replaced; their lines stay apart, as no line is alike to 0.8."""
    pick, rows = random.Random(4), []
    long = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.lang == "en" and len(set((r.text or "").split())) > 120]
    for doc_id, r in zip(range(*EDITED), long):
        words = r.text.replace("\n", " ").split(" ")
        for at in range(pick.randrange(60), len(words), 60):
            words[at] = "edited"
        rows.append((doc_id, " ".join(words), r.lang, r.source, len(" ".join(words))))
    return rows


def test_near_copies_that_each_stage_takes(spark, tmp_path):
    """Edited copies of whole documents are gone, or without their text, after the stages for lines and documents together."""
    rows = edited_copies(spark)
    assert len(rows) >= 5
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    originals = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["simhash_near_dedup"](spark, originals.unionByName(docs), SF)
    assert {r.doc_id for r in kept.collect()} & set(range(*EDITED)) == set()


def test_odd_rows_through_the_whole_pipeline(spark, tmp_path):
    odd = [(None, None, None, None, None), (10_000_100, None, "en", "s", 0), (10_000_101, "", None, "s", 0), (10_000_101, "", None, "s", 0), (None, "a text without an id", "en", None, 20),
           (10_000_102, "\n \n\t", "en", "s", 4), (10_000_103, "word " * 60_000, "en", "s", 300_000)]
    got = corpus_pipeline.run(spark, folder_with(spark, tmp_path, odd)).collect()
    plain = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and all(r.n_tokens >= 0 for r in got)
    # More unlabelled rows move the classifier's threshold a little; nothing else changes for the documents there were.
    assert len(plain - set(ids)) <= 0.05 * len(plain)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, before = docs.columns, None
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [tuple(r) for r in docs.collect()]
        if n < 4:
            assert docs.columns == columns
        pairs = [(r[0], r[1]) for r in before]
        if name == "quality_classifier":
            source = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
            scorer = quality.learn(source, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = scorer(quality.np.array([quality.features(r[1] or "") for r in before]))
            assert Counter(after) == Counter(r for r, s in zip(before, scores, strict=True) if s >= 0.5)
            bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
            assert len(after) > 0.7 * len(before) and len(bad & {r[0] for r in after}) < 0.3 * len(bad & {r[0] for r in before})
        elif name == "line_dedup":
            assert Counter((r[0], r[1]) for r in after) == brute_lines(pairs) and all(r[4] == len(r[1]) for r in after)
        elif name == "simhash_near_dedup":
            # Five words in sequence at Jaccard 0.8, not the two bits of op6: edited copies go too.
            assert {(r[0] is None, r[0] or 0) for r in after} == brute_groups(pairs) and len(after) == len({r[0] for r in after})
            assert set(after) <= set(before)
        elif name == "benchmark_decontamination":
            clean = {k[0] for k in brute_matches(pairs, bench, 10) if not k[3]}
            assert Counter(after) == Counter(r for r in before if r[0] in clean)
        else:
            codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
            want = [(r[0], len(i := codec.encode(r[1])), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()) for r in before]
            assert Counter(after) == Counter(want) and len(after) > 0
    got = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, got.collect())) == Counter(after)
