"""Queries against their SQL on pages that the test tables hardly have."""

import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Titles that end within a reference, and pages of more words than a chunk holds."""
    base = str(tmp_path_factory.mktemp("odd"))
    for f in os.listdir(SMALL):
        shutil.copy(f"{SMALL}/{f}", base)
    os.chmod(f"{base}/pages.parquet", 0o644)
    broken = "CASE page_id % 4 WHEN 0 THEN '&amp;&amp' WHEN 1 THEN '&quot' WHEN 2 THEN '&am' ELSE '' END"
    long_ = "CASE WHEN page_id % 3 = 0 THEN repeat('<p>'||repeat('one two three ', 500)||'</p>', 5) ELSE '' END"
    duckdb.sql(f"COPY (SELECT page_id, url, replace(replace(html, '</h1>', {broken}||'</h1>'), '</article>', {long_}||'</article>') AS html FROM '{SMALL}/pages.parquet') TO '{base}/pages.parquet'")
    return base


NAMES = ("annotated_chunks", "context_headers", "heading_breadcrumbs", "jsonl_records", "markdown_chunks", "page_headings", "page_text", "split_pieces", "spa_shells", "text_chunks")


@pytest.mark.parametrize("name", NAMES)
def test_odd_pages(spark, odd, name):
    with duckdb.connect() as c:
        for f in os.listdir(odd):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{odd}/{f}'")
        want = c.execute(entry.oracle_sql()[name])
        names, rows = [x[0] for x in want.description], want.fetchall()
    got = entry.queries()[name](spark, odd)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, rows))


def test_headers_of_halves(spark, tmp_path):
    """Scores and noise that are halves of the last digit shown, but for what binary fractions add."""
    pages = [(i, f"https://a.example.com/x/{i}", f"<html><body><nav> {'menu ' * (4000 - n)}</nav> <article><h1>Title</h1> <p>{'word ' * (n - 1)}</p></article></body></html>") for i, n in enumerate((3750, 3718, 3314, 3700))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = c.execute(entry.oracle_sql()["context_headers"])
        names, rows = [x[0] for x in want.description], want.fetchall()
    assert len(rows) == 4
    got = entry.queries()["context_headers"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(rows)
