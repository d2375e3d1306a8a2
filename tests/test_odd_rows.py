"""Queries against their SQL twins on rows that the standard tables lack."""

import duckdb
import pytest

from corpusloom import plans

TEXTS = ["a\n\nb", " led\ntrailed \n\tx\t\n c", "\n \n\t\n\r\n 　\nz\r", " \n\x1c\n\x85\n​", "", "   ", None, "one\n", "\ntwo", "x y"]
LANGS = ["en", "", None, " "]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, LANGS[i % 4], "web", len(t or "")) for i, t in enumerate(TEXTS * 4)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_page_paragraphs_are_lines_as_they_stand(spark, odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    want = con.sql(plans.ORACLES["s07_page_paragraphs"]).fetchall()
    found = plans.QUERIES["s07_page_paragraphs"](spark, odd).select("doc_id", "side", "idx", "text").collect()
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 60
