import itertools
import random

from folioscope.llm.wrapper import Node, Wrapper, main_text, parse

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/x">menu {i}</a></li></ul></nav><!-- ad --><div class="ad">buy {i}</div>
<div class="cookie-notice">We use cookies {i}</div><article><header><h1>Title {i}&amp;&#33;</h1></header>
<p><b>First  {i}.<br><p>Second
 <i>it</i>alic &lt;{i}&gt;.</p><p>Share this article</p><ul><li>one {i}<li>two</ul><form>search {i}</form>
<div id="comments"><p>reader {i}</p></div></article><aside>side {i}</aside><footer>&copy; {i}</footer></body></html>"""


def _text(i, shared):
    return "\n".join([f"Title {i}&!", f"First {i}.", f"Second italic <{i}>.", *(["Share this article"] if shared else []), f"one {i}", *(["two"] if shared else [])])


def test_pages_of_one_host_and_odd_pages(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.replace("{i}", str(i)), "clash") for i in range(8)]
    rows += [(100, "http://b.example/", PAGE.replace("{i}", "100"), ""), (101, None, None, ""), (102, "x", "", ""), (103, "http://c.example/", "plain & text", ""), (104, "http://c.example/2", "<p>cut &am", ""), (105, "http://c.example/3", "<div>" * 3000 + "deep" + "</div>" * 3000, ""), (106, "http://c.example/4", "a < b <p>c</p><foo", ""), (107, "http://c.example/5", "<p>" + "long " * 30000 + "</p>", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = {r.page_id: r for r in main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i].text == _text(i, False) and got[i].n_chars == len(got[i].text)
    assert got[100].text == _text(100, True)
    assert got[101].text == got[102].text == "" and got[101].n_chars == 0
    assert got[103].text == "plain & text" and got[104].text == "cut &am" and got[105].text == "deep"
    assert got[106].text == "a < b\nc" and got[107].n_chars == 30000 * 5 - 1
    assert main_text(df.limit(0)).count() == 0
    twice = df.filter("page_id = 100").union(df.filter("page_id = 100"))
    assert [r.text for r in main_text(twice).collect()] == [_text(100, True)] * 2


def test_many_hosts_are_joined(spark, monkeypatch):
    from folioscope.llm import wrapper as module

    rows = [(i, f"http://{'a' if i % 3 else i}.example/{i}", PAGE.replace("{i}", str(i))) for i in range(24)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    sent = {r.page_id: r.text for r in main_text(df).collect()}
    monkeypatch.setattr(module, "BROADCAST_BYTES", 2)
    assert {r.page_id: r.text for r in main_text(df).collect()} == sent == {i: _text(i, i % 3 == 0) for i in range(24)}


def _brute(a: Node, b: Node) -> int:
    if a.label != b.label:
        return 0
    best = 0
    for k in range(min(len(a.kids), len(b.kids)) + 1):
        for xs in itertools.combinations(a.kids, k):
            for ys in itertools.combinations(b.kids, k):
                vs = [_brute(x, y) for x, y in zip(xs, ys)]
                if all(vs):
                    best = max(best, sum(vs))
    return 1 + best


def test_matching_is_the_largest_ordered_one():
    rng = random.Random(2)

    def tree(depth):
        tag = rng.choice(["div", "span", "b"])
        kids = "".join(tree(depth - 1) for _ in range(rng.randrange(4))) if depth else ""
        return f"<{tag}>{kids}</{tag}>"

    for _ in range(60):
        a, b = tree(2), tree(2)
        w = Wrapper(a)
        root = parse(b)[0]
        to = w.match(root)
        assert len(to) == _brute(root, w.root)
        assert len(set(to.values())) == len(to)


def test_long_lists_and_deep_markup():
    item = lambda k: f"<p><b>{k}</b></p>" if k % 3 else f"<div>{k}</div>"
    base = "<ul>" + "".join(map(item, range(900))) + "</ul>"
    more = "<ul>" + "<h2>new</h2>" + "".join(map(item, range(450))) + "<h3>in between</h3>" + "".join(map(item, range(450, 900))) + "<h4>end</h4></ul>"
    w = Wrapper(base)
    root, order, _ = parse(more)
    to = w.match(root)
    assert len(set(to.values())) == len(to) > 0.9 * w.size
    # an inserted item in a long list ends no match
    assert sum(id(owner) in to for _, owner, _ in order) > 800
    deep = "<div>" * 5000 + "<nav>menu</nav><p>text</p>" + "</div>" * 5000
    w = Wrapper(deep)
    assert len(w.match(parse(deep)[0])) == w.size
    assert [b for b, owner, _ in parse("<div id=page><article>" + deep + "<p>after</p></article></div>")[1] if not owner.off and owner.inside] == ["text", "after"]


def _texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", x) for i, x in enumerate(pages)], "page_id long, url string, html string").repartition(2)
    return [r.text for r in main_text(df).orderBy("page_id").collect()]


def test_names_are_nouns_and_copies_keep_their_text(spark):
    page = '<body class="has-sidebar"><div class="site-header">x</div><article class="comments-open"><div class="article-header"><h1>Head</h1></div><div class="social-science">a</div><p class="related-work">b</p><p class="menu-recipes">c</p><p id="comments-policy">d</p><div class="banner-history">e</div><div class="share-buttons">s</div><div class="comments-area">r</div><div class="cookie-notice">n</div><div class="ad-slot-2">v</div></article></body>'
    assert _texts(spark, [page] * 6) == ["Head\na\nb\nc\nd\ne"] * 6


def test_alignment_finds_what_the_base_page_lacks(spark):
    # no names: a notice that some pages have, a constant line after lists of any length, menus whose links vary
    def page(i):
        menu = "".join(f'<div><a href="/{i}{k}">go {i} {k}</a></div>' for k in range(3))
        notice = "<section><p>The site is down on Monday.</p></section>" if i % 3 == 0 else ""
        return f"<div><div>{menu}</div>{notice}<section><h1>Title {i}</h1>" + "".join(f"<p>Text {i} {k}.</p>" for k in range(i % 4 + 1)) + "<p>Follow us everywhere.</p></section></div>"

    for i, text in enumerate(_texts(spark, [page(i) for i in range(30)])):
        assert text == "\n".join([f"Title {i}", *(f"Text {i} {k}." for k in range(i % 4 + 1))])


def test_pages_set_whole_into_a_form(spark):
    def page(i):
        hidden = '<input type="hidden" name="state" value="x">' * 5
        return f'<body><form action="x">{hidden}<nav>menu</nav><input name="q"><div><h1>Title {i}</h1>' + "".join(f"<p>Paragraph {k} of page {i} goes on for a while, as texts do, to its end.</p>" for k in range(8)) + "</div></form></body>"

    want = ["\n".join([f"Title {i}", *(f"Paragraph {k} of page {i} goes on for a while, as texts do, to its end." for k in range(8))]) for i in range(6)]
    assert _texts(spark, [page(i) for i in range(6)]) == want
    # fields outweigh a letter's subscription
    small = '<article><p>Text of {i}.</p><form><p>Have our news sent to you every week.</p><input name="mail"><button>Go</button></form></article>'
    assert _texts(spark, [small.replace("{i}", str(i)) for i in range(4)]) == [f"Text of {i}." for i in range(4)]


def test_teasers_in_articles_beside_the_text(spark):
    def page(i):
        teasers = "".join(f'<article><h3><a href="/{i}{k}">Other story {i} {k}</a></h3><p>Its first words {i} {k}</p></article>' for k in range(3))
        return f"<body><div><div><h1>Title {i}</h1>" + "".join(f"<p>Paragraph {k} of page {i} goes on for a while, as texts do, to its end.</p>" for k in range(8)) + f"</div><div>{teasers}</div></div></body>"

    want = ["\n".join([f"Title {i}", *(f"Paragraph {k} of page {i} goes on for a while, as texts do, to its end." for k in range(8))]) for i in range(6)]
    assert _texts(spark, [page(i) for i in range(6)]) == want
    assert _texts(spark, [page(i).replace("<body>", "<body><main>").replace("</body>", "</main></body>") for i in range(6)]) == want


def test_anchors_and_repeated_headings_within_an_article(spark):
    def page(i):
        return f'<article><h1>Study {i}</h1><h2 id="banner">Introduction</h2><p>Why {i}.</p><section id="social"><h2>Methods</h2><h3>Setting</h3><p>How {i}.</p></section><h2>Results</h2><p>What {i}.</p><h2>Share</h2><p>Tell a friend.</p><section id="comments"><p>reader {i}</p></section></article>'

    assert _texts(spark, [page(i) for i in range(6)]) == [f"Study {i}\nIntroduction\nWhy {i}.\nMethods\nSetting\nHow {i}.\nResults\nWhat {i}." for i in range(6)]
