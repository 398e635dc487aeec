import itertools
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from riskloom.llm import hilbert


def test_curve_visits_every_cell_once_and_steps_to_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (3, 1)):
        cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), ", ".join(f"a{i} int" for i in range(n)))
        rows = cells.withColumn("h", hilbert.hilbert_index([F.col(f"a{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << (n * bits)))
        for a, b in itertools.pairwise(rows):
            assert sum(abs(x - y) for x, y in zip(a[:n], b[:n])) == 1


def laws(rows, n):
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert len(rows) == n and all(sorted(v) == list(range(len(v))) for v in shards.values())
    sizes = [len(shards.get(s, [])) for s in range(hilbert.SHARDS)]
    assert max(sizes) - min(sizes) <= 1 and set(shards) <= set(range(hilbert.SHARDS))


def test_odd_rows(spark, docs_of):
    rows = [(None, None), (None, "a"), (1, ""), (2, "é" * 30_000)] + [(5, "same")] * 300 + [(i, "copy") for i in range(100, 200)]
    got = hilbert.shard(docs_of(rows)).collect()
    laws(got, len(rows))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert hilbert.shard(docs_of([])).count() == 0
    laws(hilbert.shard(docs_of([(1, "a"), (2, "b")])).collect(), 2)


def test_query_is_in_curve_order(spark, tmp_path):
    from tests.llm.conftest import SF
    placed = hilbert.op10_hilbert_shards(spark, SF)
    rows = sorted(placed.collect(), key=lambda r: (r.shard, r.slot))
    laws(rows, spark.read.parquet(f"{SF}/documents.parquet").count())
    assert [r.curve for r in rows] == sorted(r.curve for r in rows)
    hilbert.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
