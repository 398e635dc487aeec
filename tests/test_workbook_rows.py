import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import rows_of

TEXTS = ["One. two\nThree, four", 'a token = "x. y", z', 'odd " quote, here\nnext', '"Said" he, so\n""twice, "x, y"', ", comma, first\n. dot first", "", "\n\n", "  \n ", None,
         "\n\nlate", "x", ",", '"', "a\r\n\rb\r", "one two\n three", '"a","b, c" d\n,"e, f"', " lead, space \n\ttab, too\n\n", "a. b. \n"]


@pytest.mark.parametrize("name", ["s05_workbook_rows", "t04_segment_fmea"])
def test_workbooks_of_odd_texts_equal_the_sql(spark, tmp_path, name):
    path = str(tmp_path / "documents.parquet")
    rows = [(i, text, "en", "src1") for i, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(path)
    df = entry.queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cursor = db.execute(entry.oracle_sql()[name])
    columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, want)
