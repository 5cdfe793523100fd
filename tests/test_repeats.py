"""Repeated documents by their whole texts, on planted copies."""

import duckdb

from pagewright.plans import catalog


def test_only_whole_copies_end_a_book(spark, tmp_path):
    texts = {
        "alike": ["Same start, one.", "Same start, two.", "Same start, six.", "Same line\nand a", "Same line\nand b", "Same line\nand c"],
        "copies": ["First.", "Second.", "Kept\nwhole.", "Kept\nwhole.", "Kept\nwhole.", "Kept\nwhole.", "End."],
        "pairs": ["Twice.", "Twice.", "Other.", "Twice.", "", None],
        "blank": ["Begin.", None, "", None],
    }
    rows = [(i, text, 1000 * k + i) for k, source in enumerate(texts) for i, text in enumerate(texts[source])]
    names = list(texts)
    frame = spark.createDataFrame([(at, text, names[at // 1000]) for _, text, at in rows], "doc_id long, text string, source string")
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["book"], r["last_page"]) for r in catalog.queries()["repeat_runs_documents"](spark, str(tmp_path)).where("last_page IS NOT NULL").collect()}
    assert got == {("copies/2", 3), ("blank/6", 2)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {(r[0], r[2]) for r in con.sql(catalog.oracle_sql()["repeat_runs_documents"]).fetchall() if r[2]} == got
