from riskloom.plans import text_catalog


def test_sheets_are_made_in_the_row_of_their_document(spark, tmp_path):
    rows = [(6, "One. two\nThree", "en", "src1"), (6, "Again", "fr", "src2"), (7, "Plain", "en", "src3"), (None, "No id", "en", "src4")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = text_catalog.typed_texts(spark, str(tmp_path))
    # One row a document, repeated ids and none included; texts are not dealt by id and sorted to meet their own sheets.
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 4
    every = spark.createDataFrame([(i, "One. two", "en", "src") for i in range(6)], "doc_id long, text string, lang string, source string")
    every.write.parquet(str(tmp_path / "all" / "documents.parquet"))
    texts = {r.document_type: r.text for r in text_catalog.typed_texts(spark, str(tmp_path / "all")).collect()}
    assert len(texts) == 6 and texts["fmea"] == '--- Sheet: src ---\nProcess,Quoted,Cause,Effect\nO,"O, x",One,two\n--- Sheet: notes ---\nProcess,Note\nen,ok\n,\nsrc,end'
