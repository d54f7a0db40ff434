"""Links as they are written, against the query's SQL on odd pages."""

import duckdb

from corpusmill import plans


def test_odd_links_equal_sql(spark, tmp_path):
    hrefs = ["/a?", "/b;", "/.", "/..", "/c/../d", "//other/x", "?q=1", "e f", "/g#h", "#top", "mailto:x", "HTTP://h.org/a", "http://h.org/z?#", "http://h.org.evil/z", " /s", "/t\nu", "https://h.org/v", "i"]
    html = "".join(f'<a class="x" href="{h}">l</a>' for h in hrefs)
    urls = ["http://h.org/en/1?u=2", "http://h.org", "http://h.org?x", "ftp://h.org/a", "https://h.org/en/#top", "http://u@h.org:80/p/q"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES " + ", ".join(["(?, ?, ?)"] * 8) + ") t(page_id, url, html)", [x for i, u in enumerate([*urls, None, "http://h.org/n"]) for x in (i, u, html if i < 7 else None)])
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    got = {(r.page_id, r.link) for r in plans.queries()["web_links"](spark, str(tmp_path)).select("page_id", "link").collect()}
    assert got == set(con.execute(plans.oracle_sql()["web_links"]).fetchall())
    assert (0, "http://h.org/a?") in got and (0, "http://h.org/.") in got
