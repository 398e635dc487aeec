from riskloom.streaming.file_drop import ingest_folder


def test_file_drop_reads_each_file_once(spark, tmp_path):
    drop, target, state = (tmp_path / name for name in ("drop", "target", "state"))
    drop.mkdir()

    def run():
        query = ingest_folder(spark, str(drop), str(target), str(state))
        assert query.awaitTermination(120)

    (drop / "hira plan.txt").write_text("Area: North\nActivity: welding\n" + "A sentence about the area. " * 5)
    run()
    (drop / "notes.txt").write_text("Plain words about nothing in particular, long enough to keep.")
    run()
    documents = spark.read.parquet(str(target / "documents"))
    assert {(r.document_type, r.batch) for r in documents.collect()} == {("hira", 0), ("generic", 1)}
    chunks = spark.read.parquet(str(target / "chunks"))
    assert {r.semantic_type for r in chunks.collect()} == {"hira_header", "paragraph"}


def test_one_content_is_one_document_over_batches_and_restarts(spark, tmp_path):
    drop, state = tmp_path / "drop", tmp_path / "state"
    drop.mkdir()
    for batch, names in enumerate((("a.txt", "copy of a.txt", "b.txt"), ("a again.txt", "c.txt"), ("b again.txt",))):
        for name in names:
            (drop / name).write_text(f"The text of {name.replace('copy of ', '').replace(' again', '')} and nothing else.")
        assert ingest_folder(spark, str(drop), str(tmp_path / "target"), str(state)).awaitTermination(120)  # each time a restart
    documents = spark.read.parquet(str(tmp_path / "target" / "documents")).collect()
    assert len(documents) == len({r.content_hash for r in documents}) == 3
    assert sorted(r.batch for r in documents) == [0, 0, 1]
