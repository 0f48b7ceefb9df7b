import re

from waymill.llm import html_extract as h

SCHEMA = "page_id long, url string, html string, text string"


def page(body, i=0, main="article"):
    return f"""<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header>Site {i}</header><nav><ul><li><a href="/a">Menu {i}</a></li><li><a>More</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy {i}</div><div id="cookie-notice">We use cookies</div><aside>Aside {i}</aside>
<{main}>{body}</{main}><div class="sidebar"><p>Side {i}</p></div><form><p>Mail {i}</p><button>Go</button></form>
<section id="comments"><p>First! {i}</p></section><footer>&copy; me {i}</footer></body></html>"""


def alone(p):
    return h.main_text(p, None)


def of_host(pages):
    """The main texts of pages of one host, by the wrapper of them all."""
    node = h.wrapper(pages[0])
    for p in pages[1:]:
        node = h.merge(node, h.wrapper(p))
    rules = h.plan(h.judged(node))
    return [h.main_text(p, rules) for p in pages]


def test_one_page():
    body = "<h1>A &amp; B</h1><p><b>One\n  two</b>.<br>three<p>Four <i>fi</i>ve&nbsp;&#233;<div>six<ul><li>s1<li>s2</ul>tail</div><div class='comment'>no</div>"
    assert alone(page(body)) == "A & B\nOne two. three\nFour five é\nsix\ns1\ns2\ntail"


def test_words_of_class_and_id_drop_nothing_in_the_article():
    parts = ['<h2 id="discussion">Discussion</h2>', '<section id="related-work"><p>Related work</p></section>', '<h2 id="search-algorithms">Search</h2>', '<p class="share-price">Share price</p>', '<div class="register-map">Register map</div>', "<p>Hello<script>1</script>world</p>"]
    want = "Discussion\nRelated work\nSearch\nShare price\nRegister map\nHelloworld"
    assert alone(page("".join(parts))) == want
    assert of_host([page("".join(parts).replace("map<", f"map {i}<"), i) for i in range(5)]) == [want.replace("map\n", f"map {i}\n") for i in range(5)]
    for name in ("content no-sidebar", "long-form", "layout-with-footer", "page-header-fixed", "social-policy", "sidebar"):
        wrapped = f'<html><body><div class="{name}"><article><p>All of the text {name}</p></article></div><footer>f</footer></body></html>'
        assert alone(wrapped) == f"All of the text {name}"
        assert alone(wrapped.replace("article", "div")) == f"All of the text {name}"


def test_constant_groups_are_template_and_varying_slots_text():
    make = lambda i: f"<body><div>Site name</div><div><div>By the staff</div><h1>Title {i}</h1><p>Same opening words</p><p>Text number {i} of many more</p><table><tr><td>cell {i}</td></tr></table></div><ul><li><a>Home</a></li><li><a>News {i}</a></li></ul></body>"
    assert of_host([make(i) for i in range(3)]) == [f"By the staff\nTitle {i}\nSame opening words\nText number {i} of many more\ncell {i}" for i in range(3)]
    same = of_host([make(1)] * 3)
    assert same[0] == same[1] and "Text number 1" in same[0] and "Home" not in same[0]


def common(a, b):
    """A longest common subsequence by the full table."""
    best = [[[] for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + [a[i]] if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j], key=len)
    return best[-1][-1]


def test_a_plain_aligner_agrees_on_small_hosts():
    """Tokens of all pages aligned by full tables: what they have in common outside prose and under a doubtful name is template."""
    import random

    for seed in range(40):
        rng = random.Random(seed)
        fixed = [("div", "By the staff"), ("div class=share-links", "Share this page")]
        streams = []
        for i in range(rng.randrange(2, 6)):
            tokens = [("h1", f"Title {i}"), fixed[0]] + [("p", f"Text {i} {k}") for k in range(rng.randrange(1, 5))]
            tokens += [("pre", f"code {i}")] * rng.randrange(2) + [("blockquote", f"cite {i}")] * rng.randrange(2) + [fixed[1]]
            streams.append(tokens)
        shared = streams[0]
        for stream in streams[1:]:
            shared = common(shared, stream)
        want = ["\n".join(t for tag, t in stream if (tag, t) not in shared or "share" not in tag) for stream in streams]
        pages = [page("".join(f"<{tag}>{t}</{tag.split()[0]}>" for tag, t in stream), i) for i, stream in enumerate(streams)]
        assert of_host(pages) == want, seed


def test_what_looks_like_a_tag_in_comments_attributes_and_scripts_is_none():
    art = "<article><p>All of it</p></article>"
    assert alone(f"<!-- old: <script> -->{art}<script>1</script>") == "All of it"
    assert alone("<div><p title='<script>'>Before</p><p>All of it</p></div><script>if (a < b) '</p>'</script>") == "Before\nAll of it"
    assert alone(f"<!-- <style> -->{art}<style>p {{}}</style><!-- </article> <textarea> -->") == "All of it"
    assert alone("<article><p>a<textarea><p>typed</p></textarea>b</p><script><!-- </p> --></script><p>c</p><svg/><p>d</p></article>") == "ab\nc\nd"
    assert alone("<p>a</p><script>never closed <p>b</p>") == "a"


def test_a_form_around_the_page_is_no_form():
    make = lambda i: f"<body><form action=x><input name=state><div class='search'><label>Find</label><button>Go</button></div><article><h1>T{i}</h1><p>Text {i} of the page</p></article><form><p>Mail</p></form></form></body>"
    want = [f"T{i}\nText {i} of the page" for i in range(4)]
    assert [alone(make(i)) for i in range(4)] == want == of_host([make(i) for i in range(4)])
    bare = lambda i: make(i).replace("article", "div")
    assert [t.split("\n")[:2] for t in of_host([bare(i) for i in range(4)])] == [w.split("\n") for w in want]


def test_another_page_of_the_host_takes_no_text_away():
    make = lambda i: f"<body><nav><a>Home</a></nav><article><h1>T{i}</h1><div>By Jane Doe, our correspondent.</div><p>Text {i}</p><div>Same closing line</div></article></body>"
    want = "T0\nBy Jane Doe, our correspondent.\nText 0\nSame closing line"
    for n in range(1, 5):
        assert of_host([make(i) for i in range(n)])[0] == want


def test_part_of_a_name_drops_no_group_of_prose():
    make = lambda i: f"<body><div><h1>T{i}</h1><p>{'Text of the page ' * 9}{i}</p><section id=related-work><h2>Related work</h2><p>Related work text {i}</p></section><div class=related-links><a>One</a> <a>Two {i}</a></div></div></body>"
    for texts in (of_host([make(i) for i in range(3)]), [alone(make(0))]):
        assert "Related work\nRelated work text 0" in texts[0] and "One" not in texts[0]


def test_deep_and_odd_pages_are_bounded(monkeypatch):
    deep = "<div>" * 5000 + "<p>bottom</p>" + "</div>" * 4999 + "<p>after</p>"
    assert alone(deep) == "bottom\nafter"
    assert alone("<article>" + "<section>" * 300 + "<nav>menu</nav><p>text</p>" + "</section>" * 300 + "</article>") == "text"
    monkeypatch.setattr(h, "NODES", 60)
    pages = [page("".join(f"<div class='{chr(97 + (i * 7 + k) % 26)}x{'q' * k}'><p>Text {i} {k}</p></div>" for k in range(12)), i) for i in range(30)]
    node = h.wrapper(pages[0])
    for p in pages[1:]:
        node = h.bounded(h.merge(node, h.wrapper(p)))
    assert h.size(node) < 120 and node.pages == 30
    rules = h.plan(h.judged(node))
    for i, p in enumerate(pages):
        assert h.main_text(p, rules) == "\n".join(f"Text {i} {k}" for k in range(12))


def test_wrapper_is_union_free_with_groups():
    pages = ["<article><h1>a</h1><p>x</p><p>y</p></article>", "<article><h1>b</h1><p>z</p><table><tr><td>q</td></tr></table></article>"]
    node = h.merge(h.wrapper(pages[0]), h.wrapper(pages[1]))
    text = node.expression()
    assert "(<p>#</p>)+" in text and "(<table>" in text and text.count(")?") >= 1 and "|" not in text
    assert h.Node.unpacked(node.packed()).expression() == text


def test_container_without_marks():
    body = "".join(f"<p>Long paragraph number {k} of the text that matters here.</p>" for k in range(5))
    text = alone(page(body, main="div"))
    assert text.count("\n") == 4 and "Menu" not in text


def test_jobs_follow_hosts(spark):
    rows = [(i, f"http://{'big' if i % 3 else 'small'}.org/{i}", page(f"<h1>Head {i}</h1><p>Sign up now</p><p class='x'>Body {i}</p>" + f"<p class='x'>more {i}</p>" * (i % 4), i), "clash") for i in range(60)]
    rows += [(100, None, None, ""), (101, "http://big.org/x", "", ""), (None, "not a url", "plain <b>text", ""), (5, rows[5][1], rows[5][2], ""), (103, "http://big.org/y", "<p>" + "long " * 100_000, ""), (104, "http://big.org/z", "<<>< a < b &am <p", "")]
    got = h.extract(spark.createDataFrame(rows, SCHEMA).repartition(4))
    out = {r.page_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert out[100].text == out[101].text == "" and out[None].text == "plain text"
    for i in range(60):
        assert out[i].text.startswith(f"Head {i}\n") and out[i].text.endswith(f"{i}") and "Side" not in out[i].text and out[i].n_chars == len(out[i].text)
    assert out[103].n_chars == len("long " * 100_000) - 1
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matches_plain_reading_of_generated_pages(spark):
    """On pages of the given tables the article's blocks come back as a plain scan of them would give."""
    import html
    from pathlib import Path

    if not Path("/root/testdata/sf0.001/pages.parquet").exists():
        return
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)
        parts = re.split(r"</?(?:h1|p)>", inner[1])
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts]
        want[r.page_id] = "\n".join(t for t in texts if t)
    assert {r.page_id: r.text for r in h.extract(pages).collect()} == want
