import re
from collections import Counter

import duckdb

from riskloom.llm import decontaminate
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        ws, hit, names = split(text), set(), set()
        for name, item in items:
            iw = split(item)
            n = min(window, len(iw))
            for j in range(len(iw) - n + 1) if n else ():
                for i in range(len(ws) - n + 1):
                    if ws[i:i + n] == iw[j:j + n]:
                        hit.update(range(i, i + n))
                        names.add(str(name))
        out.append((doc_id, len(ws), tuple(sorted(hit)), tuple(sorted(names))))
    return Counter(out)


def found(df):
    return Counter((r.row.doc_id, r.found.n_words, tuple(p for s in r.found.spans for p in range(s.start, s.start + s.length)), tuple(r.found.items)) for r in df.collect())


def test_odd_rows(spark, docs_of):
    base = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(base)), (2, None), (3, ""), (None, "W5, w6!w7; É w8"), (4, "x " * 5000 + " ".join(base[3:9]) + " y"), (4, " ".join(base[30:36]) * 2),
            (5, "one"), (6, "a a a a a a a a"), (7, " ".join(base[10:13] + base[14:20]))]
    items = [(1, " ".join(base[2:20])), (10, " ".join(base[28:40])), (2, "ONE"), (3, None), (4, " .. "), (5, "a a a a a a"), (6, " ".join(base[3:7])), (10, "w6 w7 É w8")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, row int")
    for pass_bytes in (1 << 20, 60):
        assert found(decontaminate.find(docs_of(docs), bench, 4, pass_bytes)) == brute(docs, items, 4)
    clean = decontaminate.decontaminated(docs_of(docs), bench, 4)
    assert clean.columns == docs_of(docs).columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k in brute(docs, items, 4).elements() if not k[3])
    assert decontaminate.decontaminated(docs_of(docs), bench.limit(0)).count() == len(docs)
    assert decontaminate.find(docs_of([]), bench).count() == 0


def test_query_matches_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = sorted(map(tuple, decontaminate.op9_decontamination(spark, SF).collect()))
    assert got == sorted(db.execute(decontaminate.ORACLE).fetchall())
    assert any(r[5] for r in got) and not all(r[5] for r in got)
