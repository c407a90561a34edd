"""Queries over pages give the rows of their SQL where references are cut off, nested or of other names."""

import duckdb
import pytest

from tidemark.plans import ORACLES, QUERIES

TITLES = ["the&&amp", "the&am", "the&", "&quot", "a&amp;amp;&amp;quot;&amp;&quot;", "&lt;b&gt; &hellip; &#39;x&#x27; &eacute", "&copy2;&copy;2 &middot;&middot", "no reference", "&&amp;&ampx &amp ;", ""]
NAMES = ["clean_text", "extract_body", "html_unescape", "label_extract", "strip_html"]


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    html = [f"<!doctype html>\n<html lang=\"en\"><title>{t}</title><style>p &amp</style><body><h1>{t}</h1><script>x&amp</script><article><p>{t}</p>\n \n<p>b &copy {t}</p></article><footer>&copy; {t}</footer></body></html>" for t in TITLES]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(k, f"https://h.example/{k}", h) for k, h in enumerate(html)])
    con.execute(f"COPY pages TO '{folder}/pages.parquet' (FORMAT parquet)")
    return con, str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_cut_references_stay_as_in_the_sql(spark, pages, name):
    con, folder = pages
    got = QUERIES[name](spark, folder)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in got.orderBy("page_id").collect()] == want
