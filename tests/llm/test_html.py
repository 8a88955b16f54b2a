import pytest

from recollect.llm import html

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy &lt;now&gt;</div>
<article><h1>T &amp; t</h1><p><b>First   para
graph<br><p>Second &eacute;&#233;<i>x</i> &amp no semicolon</p><div class="newsletter-signup">Sign up</div><ul><li>one<li>two</ul>
<form><p>Name</p></form><section id="comments"><p>Nice post</p></section></article>
<aside>Side</aside><footer>&copy; host</footer></body></html>"""


def test_article_without_the_rest():
    assert html.extract(PAGE, []) == "T & t\n\nFirst para graph\n\nSecond ééx & no semicolon\n\none\n\ntwo"


@pytest.mark.parametrize("name", ["content-with-sidebar", "page no-sidebar", "site-main has-nav", "post-comments-open", "blog-search-results", "form-group", "social-impact"])
def test_wrappers_keep_their_text(name):
    for inside in ("<p>Body text</p>", "<article><p>Body text</p></article>"):
        assert html.extract(f'<body><nav>Menu</nav><div class="{name}">{inside}</div></body>', []) == "Body text"


@pytest.mark.parametrize("name", ["sidebar", "site-nav", "ad-slot", "cookie-banner", "comment-list", "newsletter-signup", "related box"])
def test_named_parts_go(name):
    assert html.extract(f'<body><p>Body text</p><div class="{name}"><p>Rest</p></div></body>', []) == "Body text"


def test_text_in_forms_and_code():
    assert html.extract("<body><form><nav>Menu</nav><p>All in a form</p></form></body>", []) == "All in a form"
    assert html.extract("<body><form><article><p>Text</p></article></form><p>Rest</p></body>", []) == "Text"
    assert html.extract("<main><nav>Menu</nav></main><p>Outside</p>", []) == "Outside"
    assert html.extract('<article><pre><code>x = 1 <span class="hljs-comment"># one</span> <span class="token comment"># two</span></code></pre></article>', []) == "x = 1 # one # two"
    assert html.extract('<article><p>Text <span class="ad">Buy</span></p></article>', []) == "Text"


def test_broken_markup_doesnt_crash():
    for cut in range(0, len(PAGE), 7):
        html.extract(PAGE[:cut], [])
    assert html.extract(None, []) == html.extract("", []) == ""
    assert html.extract("plain < text", []) == "plain < text"
    assert html.extract("<p>a &#0; &#xD800; &bogus; <3 b", []) != ""


def test_template_classes():
    a, b, c, d, e = 1, 2, 3, 4, 5
    assert html.template([a, b, 9, c], [[a, b, c]]) == {0, 1, 3}
    assert html.template([a, 9, c, b], [[a, b, c]]) == set()
    nested = html.template([a, d, e, d, e, c, b], [[a, c, b], [d, e]])
    assert nested == {0, 1, 2, 3, 4, 5, 6}
    crossing = html.template([a, d, b, 7, c, e], [[a, b, c], [d, e]])
    assert crossing == {0, 2, 4}


def body(host, i, words):
    return (i, f"http://{host}/{i}", f"<html><body><div class=top>Welcome to {host}</div><p>{words} {i}</p><p>{words}</p><div>All rights reserved</div></body></html>")


def test_repeated_blocks_of_a_host_are_its_template(spark):
    rows = [body("h.example", i, f"unique words {i * 7}") for i in range(12)] + [body("single.example", 99, "lonely")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert out[3] == "unique words 21 3\n\nunique words 21"
    assert out[99] == "Welcome to single.example\n\nlonely 99\n\nlonely\n\nAll rights reserved"


def test_joined_equals_broadcast(spark, monkeypatch):
    rows = [body("h.example", i, f"unique words {i * 7}") for i in range(12)] + [(50, None, None), (51, "not a url", ""), (51, "not a url", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as token")
    want = sorted(html.main_text(df).collect(), key=str)
    monkeypatch.setattr(html, "BROADCAST_TOKENS", 0)
    assert sorted(html.main_text(df).collect(), key=str) == want and len(want) == 15
    assert html.main_text(df.limit(0)).collect() == []


def test_occurrence_classes_against_brute_force(spark, small):
    from collections import Counter, defaultdict

    pages = spark.read.parquet(f"{small}/pages.parquet")
    vectors, hosts = defaultdict(dict), Counter()
    for r in pages.collect():
        of = html.host(r.url)
        hosts[of] += 1
        for t, n in Counter(html.Page(r.html).tokens).items():
            vectors[of, t][r.page_id] = n
    want = defaultdict(set)
    for (of, t), v in vectors.items():
        if len(v) >= max(html.PAGES, html.SUPPORT * hosts[of]):
            want[of, tuple(sorted(v.items()))].add(t)
    want = sorted((of, sorted(ts)) for (of, _), ts in want.items() if len(ts) >= html.TOKENS)
    assert sorted((r.host, sorted(c)) for r in html.templates(pages).collect() for c in r.classes) == want


def article(url, i):
    return (i, url, f"<html><body><article><h1>Title {i}</h1><p>unique words {i * 7}</p><div class=zz9><p>Read this on our host</p></div></article></body></html>")


def test_template_decides_inside_articles_too(spark):
    alike = [(100 + i, f"http://alike.example/{i}", "<article><h1>One</h1><p>Same text</p></article>") for i in range(5)]
    df = spark.createDataFrame([article(f"http://a.example/{i}", i) for i in range(12)] + alike, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert out[3] == "Title 3\n\nunique words 21"
    assert out[100] == "One\n\nSame text"


def test_joined_equals_broadcast_for_unusual_urls(spark, monkeypatch):
    urls = ["//a.example/{}", "http://[::1]:8080/{}", " http://b.example/{}"]
    df = spark.createDataFrame([article(u.format(i), 100 * n + i) for n, u in enumerate(urls) for i in range(6)], "page_id long, url string, html string")
    want = sorted(html.main_text(df).collect())
    monkeypatch.setattr(html, "BROADCAST_TOKENS", 0)
    assert sorted(html.main_text(df).collect()) == want
    assert all("our host" not in r.text for r in want)
