"""Main text that names or a host's template must not take, and template lines inside articles that must go."""

from quarrybook.llm import html_extraction

TEXT = "Rivers carry sand {k} and silt {k} to the sea {k}"


def extract(spark, pages):
    rows = [(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(pages)]
    return [r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_names_do_not_take_the_article(spark):
    cases = (
        "<article class='post comments-open'><p>{t}</article>", "<main class='no-sidebar'><p>{t}</main>", "<main class=sidebar><p>{t}</main>",
        "<div id=page class='has-sidebar'><article><p>{t}</article></div>", "<div class=sidebar><div class=banner><article><p>{t}</article></div></div>",
        "<article><h1 class='article-header'>{t}</h1></article>", "<article><p class='legal-text'>{t}</article>", "<article><section id='related-work'><p>{t}</section></article>",
        "<div class=notice><p>{t}</div>", "<article><p data-id=ad>{t}</article>",
    )
    pages, want = [], []
    for c, around in enumerate(cases):
        for k in range(5):
            want.append(TEXT.format(k=f"{c}x{k}"))
            pages.append((f"{'many' if k else 'one'}{c}.example", f"<body><nav>Home</nav>{around}<footer>Legal</footer>".format(t=want[-1])))
    assert extract(spark, pages) == want


def test_template_confirms_names(spark):
    rare = "<article><p>{t}<section id=related><p>Earlier work {k}</section></article>"
    common = "<article><p>{t}<div class='box ad'>Buy {k}</div></article>"
    rows = [("h.example", (rare if k == 0 else common).format(t=TEXT.format(k=k), k=k)) for k in range(5)] + [("alone.example", rare.format(t=TEXT.format(k=9), k=9))]
    assert extract(spark, rows) == [TEXT.format(k=0) + " Earlier work 0", *[TEXT.format(k=k) for k in (1, 2, 3, 4, 9)]]
    assert html_extraction.main_text("<article><p>f<span class=ad>oo</span>l <i class=ad>bar</i> !</article>", [1], [1]) == "fool bar !"
    nested = "<article><p>Main text<article class=comment><p>me too</article></article>"
    assert html_extraction.main_text(nested, [], []) == "Main text"


def test_template_lines_inside_articles(spark):
    notice = "Read our other stories and tell all your friends about them today because we depend on you"
    repeated = "The moon is out"
    article = "<article><h2>Our view</h2><div><span>Share this with friends</span></div><p>{t}<p>{m}</p><p>" + notice + "</p></article>"
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(8)]
    pages = [("h.example", article.format(t=t, m=repeated if k < 3 else f"Sun {k}")) for k, t in enumerate(texts)]
    pages += [("same.example", f"<article><h1>Poem</h1><p>{repeated}<p>{notice}<p>Verse {k}</article>") for k in range(5)]
    pages += [("few.example", article.format(t=texts[k], m="x")) for k in range(2)]
    got = extract(spark, pages)
    assert got[:8] == [f"Our view {t} {repeated if k < 3 else f'Sun {k}'}" for k, t in enumerate(texts)]
    assert got[8:13] == [f"Poem {repeated} {notice} Verse {k}" for k in range(5)]
    assert all("Share this with friends" in g and notice in g for g in got[13:])


def host_pages(host, n, body):
    return [(host, body.format(k=k, t=" ".join(f"w{k}x{j}" for j in range(30 + k)))) for k in range(n)]


#: No article, no main, no nav, no class: only what the pages share tells the text from the rest.
BARE = "<html><body><div><div>Home About Contact</div><p>Today {k}</p></div><div><h1>Title {k}</h1><p>{t}</p><p>More {t}</p></div><div><p>All rights are reserved by the house</p></div></body></html>"


def test_the_template_decides_where_no_name_does(spark):
    pages = host_pages("bare.example", 6, BARE)
    rows = [(i, f"http://{h}/{i}", page) for i, (h, page) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [r["text"] for r in html_extraction.extract(df).orderBy("page_id").collect()]
    texts = [" ".join(f"w{k}x{j}" for j in range(30 + k)) for k in range(6)]
    assert got == [f"Title {k} {t} More {t}" for k, t in enumerate(texts)]
    without = [html_extraction.main_text(page, [], []) for _, page in pages]
    assert all("Home About Contact" in w and w != g for w, g in zip(without, got, strict=True))


def test_an_article_breaks_the_tie(spark):
    body = "<body><div><article><h1>Head {k}</h1><p>{t}</p></article><div><p>Answer a{k} {t} b{k} {t} {t}</p></div></div></body>"
    texts = [" ".join(f"w{k}x{j}" for j in range(30 + k)) for k in range(5)]
    assert extract(spark, host_pages("tie.example", 5, body)) == [f"Head {k} {t}" for k, t in enumerate(texts)]


def test_templates_equal_brute_force(spark):
    """Classes by whole occurrence vectors instead of digests, pages and tokens held together."""
    from collections import Counter, defaultdict

    from quarrybook.llm.html_extraction import CLASS_SIZE, LEAST_PAGES, SHARE, _rows, page_tokens, templates
    from quarrybook.plans.staging import Staging

    pages = host_pages("one.example", 6, BARE) + host_pages("two.example", 4, "<body><nav><a href=x>Go</a></nav><article><h2>T {k}</h2><p>{t}</p></article><footer>Legal</footer></body>") + host_pages("few.example", 2, BARE)
    pages[2] = ("one.example", pages[2][1].replace("All rights", "No rights"))
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["host"]: r for r in templates(_rows(df, "page_id", "url", "html"), Staging(spark, "t")).collect()}
    for host in ("one.example", "two.example", "few.example"):
        own = [Counter(t for t, *_ in page_tokens(p)) for h, p in pages if h == host]
        classes = defaultdict(set)
        for token in set().union(*own):
            vector = tuple(c[token] for c in own)
            present = sum(n > 0 for n in vector)
            if present >= LEAST_PAGES and present >= SHARE * len(own):
                classes[vector].add(token)
        want = {frozenset(c) for c in classes.values() if len(c) >= CLASS_SIZE}
        found = defaultdict(set)
        for token, name in zip(got[host]["tokens"] or [], got[host]["classes"] or [], strict=True):
            found[name].add(token)
        assert {frozenset(c) for c in found.values()} == want and bool(want) == (host != "few.example")


def test_deep_and_broken_markup():
    deep = "<div>" * 30_000 + "<p>bottom" + "</div>" * 30_000
    assert html_extraction.main_text(deep, [], []) == "bottom"
    assert html_extraction.main_text("<p title=\"a>one</p><p class=\"x\">two</p><p title='b>c'>three <i title='>four</i>", [], []) == "one two three four"
    assert html_extraction.main_text("<p><b>open<br><p>next</b> x", [], []) == "open next x"


def test_formulas_are_text():
    page = "<article><p>Let <math><mi>x</mi><mspace/><msup><mi>y</mi><mn>2</mn></msup></math> be large.<p>So <math/>it <math><semantics><mi>z</mi><annotation>\\zeta</annotation></semantics></math> is</article>"
    assert html_extraction.main_text(page, [], []) == "Let xy2 be large. So it z is"


def test_names_of_several_parts():
    side = "<div class='{}'><p>We use cookies</p></div><div class=text><p>Main words</p></div>"
    for name in ("cookie-banner", "post-comments", "site_footer", "newsletter-signup", "right-sidebar"):
        assert html_extraction.main_text(side.format(name), [], []) == "Main words", name
    for name in ("no-sidebar", "comments-open", "has-comments", "legal-text", "related-work", "article-header", "-"):
        assert html_extraction.main_text(side.format(name), [], []) == "We use cookies Main words", name
