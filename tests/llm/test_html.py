import random

import numpy as np
import pytest

from rillflow.llm import html


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def is_subsequence(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    """The same one whether the table is kept whole or made again piece by piece."""
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(30))]
        b = [rng.randrange(6) for _ in range(rng.randrange(30))]
        flags = []
        for most in (1 << 25, 40, 0):
            monkeypatch.setattr(html, "_PAIRS", most)
            flags.append(html.common_lines(np.array(a, np.int64), np.array(b, np.int64)).tolist())
        assert flags[0] == flags[1] == flags[2]
        kept = [x for x, k in zip(a, flags[0]) if k]
        assert len(kept) == lcs_length(a, b) and is_subsequence(kept, b)


PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy {n}</div><header>Top</header><article><h1>Head &eacute; {n}</h1><p><b>One  {n}\n two.<br><p>Three &lt;b&gt; &#233;</p><p>Unclosed <i>it<form>Name<input></form>'
    '<aside>Side</aside></article><div id="comments"><p>Reader {n}</p></div><footer>&copy; host</footer></body></html>'
)


def test_article():
    assert [t for t, r, _ in html.lines(PAGE.format(n=5)) if r == html.CONTENT] == ["Head é 5", "One 5 two.", "Three <b> é", "Unclosed it"]
    assert {t for t, r, _ in html.lines(PAGE.format(n=5)) if r in (html.FURNITURE, html.NAMED)} == {"Menu", "Buy 5", "Top", "Name", "Side", "Reader 5", "© host"}


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></p>", "<p>a<<b>c", "text only", "<a href='>'>x</a>", "<div hidden>x</div>", "<![CDATA[x]]>y", "&am &a &#xZZ;"])
def test_odd_markup(page):
    assert isinstance(html.lines(page), list)


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "page_id long, url string, html string, text string, row int")
    return sorted(((r.page_id, r.url, r.text) for r in html.extract(df).collect()), key=repr)


def test_extract(spark):
    rows = [(i, f"http://h/a/{i}", PAGE.format(n=i)) for i in range(40)] + [(100, None, None), (101, "http://h/b", ""), (None, "http://h/a/1", PAGE.format(n=1)), (3, "http://h/a/3", PAGE.format(n=3)), (102, "http://[bad", "<p>alone</p>")]
    want = [(p, u, "" if not h else "alone" if p == 102 else f"Head é {h.split('Buy ')[1].split('<')[0]}\nOne {h.split('Buy ')[1].split('<')[0]} two.\nThree <b> é\nUnclosed it") for p, u, h in rows]
    assert result(spark, rows) == sorted(want, key=repr)


def bare(n):
    return f"<body><div>Site name</div><div>Story {n} begins</div><div>and goes on {n * 7}</div><div>All rights reserved</div></body>"


def test_differencing_decides_where_markup_does_not(spark):
    rows = [(i, f"http://h/{i:03d}", bare(i)) for i in range(150)] + [(900, "http://alone/x", bare(1))]
    got = {p: t for p, _, t in result(spark, rows)}
    assert all(got[i] == f"Story {i} begins\nand goes on {i * 7}" for i in range(150))
    assert got[900] == "Site name\nStory 1 begins\nand goes on 7\nAll rights reserved"


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h{rng.randrange(3)}/{rng.choice('abc')}/{i}", bare(rng.randrange(40))) for i in range(120)]
    one = result(spark, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13", "60", "119"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert result(spark, rows) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_of_an_article_stay(spark):
    rows = [(i, f"http://h/{i}", PAGE.format(n=1)) for i in range(6)]
    assert {t for *_, t in result(spark, rows)} == {"Head é 1\nOne 1 two.\nThree <b> é\nUnclosed it"}
    assert result(spark, []) == []


def test_inline_markup_does_not_split_a_block():
    page = '<article><p>a <b>b</b>, <a href="/x">c</a>d<script>e</script> <span class="share">no</span> <button>no</button>f</p><p>g<br>h</p></article>'
    assert html.kept(html.lines(page), []) == ["a b, cd f", "g", "h"]


@pytest.mark.parametrize("unit", ['<a "', "<a ", "<div><b>", "<p><div><b><b>", "</i></b>", "<p>", "<a title='", "<!--", "<script>", "&#", '<p class="x" id=y>t'])
def test_broken_pages_take_linear_time(unit):
    import time

    start = time.time()
    for page in (unit * (2_000_000 // len(unit)), unit * (1_000_000 // len(unit)) + "</b></p>" * 120_000, unit * (1_000_000 // len(unit)) + '"'):
        html.lines(page)
    assert time.time() - start < 20


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def made(rng, n, template, article):
    """A page of random parts, and its main text."""
    sentence = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 9))) + f" {rng.randrange(10**6)}"
    body, out, text = [sentence() for _ in range(rng.randrange(2, 7))], [], []
    for block in body:
        words = block.split()
        styled = " ".join(f"<{t}>{w}</{t}>" if (t := rng.choice(["", "", "b", "em", "a"])) else w for w in words)
        out.append(rng.choice([f"<p>{styled}</p>", f"<p>{styled}", f"<blockquote>{styled}</blockquote>", f"<ul><li>{styled}</li></ul>"]))
        text.append(" ".join(words))
        if template["inner"] and rng.random() < 0.3:
            out.append(f'<aside>{sentence()}</aside>')
    inner = "".join(out)
    wrap = f"<article>{inner}</article>" if article else f'<div class="story">{inner}</div>'
    nav = "".join(f"<li>{rng.choice(WORDS)}{rng.randrange(99)}</li>" for _ in range(template["items"]))
    page = f'<html><head><title>{sentence()}</title></head><body><ul class="{template["menu"]}">{nav}</ul><div class="{template["promo"]}">{sentence()}</div>{wrap}<div id="{template["foot"]}">{sentence()}</div></body></html>'
    return page, "\n".join(text)


@pytest.mark.parametrize("article", [True, False])
def test_whole_query_against_pages_of_known_text(spark, tmp_path, article):
    """Menus, promotions and footers bear names that no word list knows, and other words on each page; only differencing can find them."""
    rng, rows, want = random.Random(11), [], {}
    for host in range(6):
        template = {"items": rng.randrange(2, 6), "menu": f"zq-{host}", "promo": f"vx-{host}", "foot": f"kk-{host}", "inner": host % 2}
        for n in range(30):
            page, want[len(rows)] = made(rng, n, template, article)
            rows.append((len(rows), f"http://h{host}.example/{n % 3}/{n}", page))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in html.op2_html(spark, str(tmp_path)).collect()}
    assert {p: r.text for p, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    bare_ = [html.kept(html.lines(h), []) for _, _, h in rows]
    assert all(len(b) > len(want[p].split("\n")) for p, b in enumerate(bare_)), "markup alone leaves furniture on every page"


def test_a_copy_beside_a_page_says_nothing_of_its_text(spark):
    """Copies under neighbouring addresses, without an article element: the text stays."""
    rows = [(i, f"http://h/{i:03d}", f"<div>Story {i // 2} is told</div><div>and it ends well {i // 2}</div>") for i in range(10)]
    assert {t for _, _, t in result(spark, rows)} == {f"Story {k} is told\nand it ends well {k}" for k in range(5)}


def test_long_page(spark):
    text = "\n".join(f"line {k} of a long page" for k in range(60_000))
    rows = [(1, "http://h/1", "<nav>x</nav><article>" + "".join(f"<p>{t}</p>" for t in text.split("\n")) + "</article>"), (2, "http://h/2", "<nav>y</nav>" + "<p>a</p>" * 50_000)]
    got = {p: t for p, _, t in result(spark, rows)}
    assert got[1] == text and set(got[2].split("\n")) == {"a"}


@pytest.mark.parametrize(
    "page,alone,asked",
    [
        ('<body class="has-sidebar"><article>Text one</article></body>', "Text one", "Text one"),
        ('<div class="content no-sidebar"><p>T</p></div><p class="lead share-price">x</p>', "T\nx", "T\nx"),
        ('<body class="sidebar"><p>a long text here</p><div class="ad">b</div></body>', "a long text here", "a long text here"),
        ('<div class="sidebar"><p>nearly all of the text of this page</p></div><div>end</div>', "nearly all of the text of this page\nend", "nearly all of the text of this page\nend"),
        ('<div class="sidebar"><article>story</article></div><p>and more of it</p>', "story\nand more of it", "story\nand more of it"),
        ("<aside><article>card</article></aside><p>body of the page</p>", "body of the page", "card\nbody of the page"),
        ("<article>a <math><mi>x</mi></math> b</article>", "a x b", "a x b"),
        ('<nav><ul><li>one</li></ul></nav><footer>two</footer><p>three is the text</p><div class="site ad">four</div>', "three is the text", "one\nthree is the text"),
    ],
)
def test_names_speak_only_where_no_neighbour_can(page, alone, asked):
    """On a page without neighbours names of all elements around a line count, beside others only its own element's, and only for lines without a counterpart."""
    assert "\n".join(html.kept(html.lines(page), None)) == alone
    assert "\n".join(html.kept(html.lines(page), [])) == asked


def test_differencing_decides_on_the_given_pages(spark, sf_dir):
    """Without it most furniture stays; without names nothing changes; each page keeps every line of its article."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text.split("\n") for r in html.op2_html(spark, sf_dir).collect()}
    furniture = left = 0
    for r in pages:
        found = html.lines(r.html)
        assert got[r.page_id] == [t for t, region, _ in found if region == html.CONTENT]
        furniture += sum(region != html.CONTENT for _, region, _ in found)
        left += len(html.kept(found, [])) - len(got[r.page_id])
    assert left >= furniture / 2


def test_a_slot_is_shared_as_a_whole():
    menu = lambda n: [("m", html.UNDECIDED, 7)] * n + [(f"t{n}", html.CONTENT, 0)]
    page = lambda n: ("r", "h", "/", n, html.keys(menu(n)))
    assert html._shared(page(5), page(2), None) == [True] * 5 + [False]
    assert html._shared(page(5), None, None) is None
