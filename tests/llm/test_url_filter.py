from boxwright.llm import url_filter as u
from boxwright.llm.queries import PAGE_RULES


def link(url):
    return f'<head><link rel="canonical" href="{url}"></head>'


def test_verdicts(spark):
    rows = [
        (1, "http://a.example.com/en/1", ""), (2, "https://a.EXAMPLE.com/en/7?x#y", ""), (3, "http://example.net/de/1", ""), (4, "http://sub.example.net/de/8", ""),
        (5, "http://x.org/es/", ""), (6, "http://x.org/en/", ""), (7, None, None), (8, "no scheme", ""), (9, "http://notcom/en/", ""), (10, "http://com/en/", ""),
        # aliases: 11 -> 12 -> blocked; 13 <- blocked; 14 has both, so the allow counts; 15 by a relative link; 16 is allowed itself
        (11, "http://alias.io/a", link("http://alias.io/b")), (12, "https://alias.io/b", link("https://a.example.com/en/99")), (13, "http://other.io/x", ""),
        (20, "http://q.org/es/1", '<meta http-equiv=refresh content="0; url=http://other.io/x">'), (14, "http://both.io/", link("http://example.com/en/70")),
        (21, "http://z.org/es/2", link("http://both.io")), (15, "http://rel.io/d/e", link("/f")), (22, "http://rel.io/f", link("http://w.org/es/")), (16, "http://example.net/de/1", link("http://q.org/es/1")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in u.judge(df, spark.createDataFrame(PAGE_RULES, u.RULES_SCHEMA)).collect()}
    assert got[1] == ("a.example.com", "/en/1", "com/en/", "block")
    assert got[2] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block")
    assert got[5][3] == "block" and got[6] == ("x.org", "/en/", None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2:] == (None, "allow") and got[10][3] == "block"
    assert [got[k][2:] for k in (11, 12, 15, 22)] == [(None, "block")] * 4
    assert got[14][2:] == (None, "allow") and got[21][3] == "block"
    assert got[16][2:] == ("net/de/", "allow") and got[13][2:] == (None, "allow")  # 16, an alias of 20, is allowed


def test_long_chains_and_hubs(spark):
    chain = [(i, f"http://c.io/{i}", link(f"http://c.io/{i + 1}")) for i in range(40)] + [(40, "http://c.io/40", link("http://q.org/es/1"))]
    hub = [(1000 + i, f"http://h.io/{i}", link("http://hub.io/")) for i in range(60)]
    df = spark.createDataFrame(chain + hub + hub[:2], "page_id long, url string, html string")
    got = u.judge(df, spark.createDataFrame(PAGE_RULES, u.RULES_SCHEMA)).collect()
    assert len(got) == 103
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(41))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, verdict string")
    assert u.judge(df, spark.createDataFrame(PAGE_RULES, u.RULES_SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "http://x.org/es/", "", "odd")], df.schema)
    assert u.judge(df, spark.createDataFrame([], u.RULES_SCHEMA)).first().verdict == "allow"


def test_what_links_are_and_where_they_lead(spark):
    rows = [
        (1, "http://a.io/x/y", f"<!-- {link('http://q.org/es/1')} -->"), (2, "http://b.io/x", '<link rel="canonical" data-href="http://q.org/es/1">'),
        (3, "http://c.io/d/e", link("?z=2")), (4, "http://c.io/d/e?z=2", link("http://q.org/es/1")), (5, "http://c.io/d/", ""),
        (6, "http://d.io/d/e/f", link("../g")), (7, "http://d.io/d/g", link("http://q.org/es/1")), (8, "http://e.io/a/b", link("/x/./y/../z/.")), (9, "http://e.io/x/z/", link("http://q.org/es/1")),
        (10, "http://f.io/a", link("#top")), (11, "http://g.io/../../a", link("http://q.org/es/1")), (12, "http://g.io/a", ""), (13, "http://h.io/a", "<!-- open " + link("http://q.org/es/1")),
        (14, None, link("http://q.org/es/1")), (15, "http://i.io/a", "<p>" * 100_000 + link("http://q.org/es/1")), (16, "http://j.io/", '<link data-rel="canonical" href="http://q.org/es/1">'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id for r in u.judge(df, spark.createDataFrame(PAGE_RULES, u.RULES_SCHEMA)).collect() if r.verdict == "block"}
    assert got == {3, 4, 6, 7, 8, 9, 11, 12, 15}
    import duckdb

    from boxwright.llm import oracles

    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert {r[0] for r in con.sql(oracles.op8_url_filter).fetchall() if r[4] == "block"} == got
