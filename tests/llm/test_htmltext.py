import random
from functools import cache

import numpy as np
import pytest

from hearthspark.llm import htmltext as h

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<!-- ad 1 --><div class="ad">buy</div><header>site</header><article><header><h1>T &amp;
 U</h1><p>by line</p></header><p><b>one<br><p>two&nbsp;&lt;b&gt; &#233;</p><aside>side</aside><div role=alert>cookies</div><article><p>reader</p></article><ul><li>a<li>b</ul></article><footer>&copy; f</footer>"""


def text(page, *wrapper):
    return h.extract(page, *wrapper)[0]


def tree(page):
    return h.Tree(h.outline(page).nodes)


def test_single_pages():
    assert text(PAGE) == "T & U\n\none\n\ntwo <b> é\n\na\n\nb"
    assert text(None) == text("") == text("<nav>x</nav>") == text(" <p> </p>") == ""
    assert text("plain <b>text</b> 1 < 2 <div") == "plain text 1 < 2" and text("a <b and c") == "a and c" and text("a <a href='x' t") == "a t"
    assert text("<article><p>cut off &am") == "cut off &am"


def test_nothing_else_is_dropped():
    assert text("<article><p>x <math><mi>y</mi></math> <svg><text>z</text></svg></p></article>") == "x y z"
    assert text("<article><p>a</p><button>go<p>b</p><video>c<p>d</p><select><option>o<p>e</article>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert text('<article class="breaking-alert"><div class="social-policy">kept</div><div class="ads">kept too</div></article>') == "kept\n\nkept too"
    table = "<article><table>" + "".join(f"<tr><td>{i}<td>b" for i in range(3)) + "</table></article>"
    assert text(table) == "0\n\nb\n\n1\n\nb\n\n2\n\nb"


def test_deep_and_long_pages():
    assert text("<article>" + "<span>" * 5000 + "deep" + "</span>" * 5000) == "deep" and text("<p>" + "<b>" * 5000 + "open") == "open"
    nested = "<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000
    assert text(nested) == "deep"
    a, b = (tree(nested + f"<p>{i}") for i in (1, 2))
    assert len(h.Matcher().align(a, b)) == len(a.keys) == 5003
    rows = lambda ns: tree("<table>" + "".join(f"<tr><td>{i}<td>x{i % 7}" for i in ns))
    a, b = rows(range(3000)), rows(range(500, 3500))
    pairs = h.Matcher().align(a, b)
    assert len(pairs) == len(a.keys) and sorted({i - j for i, j in pairs}) == [0]  # as many pairs as there are nodes leave no choice
    a, b = rows(range(3000)), rows(range(500, 2500))
    same = [(i, j) for i, j in h.Matcher().align(a, b) if a.own[i] == b.own[j] != 0]
    assert len(same) == 4000  # the equal rows meet


def brute(a, b):
    """Simple tree matching of (key, children) trees, as it is defined."""

    @cache
    def match(x, y):
        if x[0] != y[0]:
            return 0
        m = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, p in enumerate(x[1], 1):
            for j, q in enumerate(y[1], 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + match(p, q))
        return 1 + m[-1][-1]

    return match(a, b)


def as_tree(t, i=0):
    return t.keys[i], tuple(as_tree(t, c) for c in t.children[i])


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(0, 4) if depth < 4 else 0):
        tag = rng.choice(["div", "ul", "section", "h2"] if depth < 3 else ["p", "h3"])
        out += f"<{tag}>{rng.choice(['', 'x', 'y'])}{random_page(rng, depth + 1)}</{tag}>"
    return out


def test_matching_is_that_of_the_definition():
    rng, matcher = random.Random(3), h.Matcher()
    for _ in range(150):
        a, b = (tree(random_page(rng)) for _ in range(2))
        want = brute(as_tree(a), as_tree(b))
        assert matcher.score(a.classes(matcher)[0], b.classes(matcher)[0]) == want
        pairs = matcher.align(a, b)
        assert len(pairs) == want and all(a.keys[i] == b.keys[j] for i, j in pairs)
        of = dict(pairs)
        assert all(of[a.parents[i]] == b.parents[j] for i, j in pairs if i) and len(set(of.values())) == len(of)
        assert [j for _, j in sorted(pairs)] == sorted(of.values())  # page order is kept


def test_halved_tables_are_exact():
    rng = np.random.default_rng(4)
    for _ in range(60):
        w = rng.integers(0, 4, rng.integers(1, 12, 2))
        total = lambda pairs, w=w: sum(int(w[p]) for p in pairs)
        whole, halved = (h._best(lambda i, w=w: w[i], *w.shape, cells) for cells in (10**6, 4))
        assert whole == h._small(w.tolist()) and h._last(w.tolist()) == total(whole)
        assert total(whole) == total(halved) == h._rows(lambda i, w=w: w[i], 0, len(w), 0, w.shape[1])[-1]
        assert halved == sorted(halved) and len({j for _, j in halved}) == len(halved)


def plain(i):
    """A site without article elements."""
    return f'<body><div id="top">Always here</div><div id="main"><h2>Story {i}</h2><p>Text number {i} with words of its own {i * 7}.</p><p>Signed by the desk</p></div><div class="end">x</div></body>'


def article(i):
    """A site with them, a fixed notice inside and varying adverts outside."""
    more = "".join(f"<p>More of {i}, {k}.</p>" for k in range(i % 4))
    return f'<body><div class="b">Buy {i}</div><article><h1>Story {i}</h1><div>Read our terms first</div><p>Text number {i} with many words of its own {i * 7}.</p>{more}</article></body>'


def teasers(i):
    """The main text is in a div, articles are teasers."""
    body = "".join(f"<p>Paragraph {k} of the long text {i}, with words and more words.</p>" for k in range(8))
    return f'<body><div class="text">{body}</div><div class="latest"><article>Teaser {i}</article><article>Other {i + 1}</article></div></body>'


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_rows(spark, small):
    rows = [(i, f"http://h.example/{i}", plain(i), "x") for i in range(6)] + [(7, None, None, "x"), (None, "http://h.example/z", PAGE, "x"), (7, None, None, "x"), (8, "http://solo.example/", "<p>" + "word " * 100_000, "x")]
    rows += [(10 + i, "http://one.example/", plain(1), "x") for i in range(3)]  # copies of one page tell nothing
    # Two layouts on one host, and a third.
    rows += [(100 + i, f"http://two.example/{i}", article(i), "x") for i in range(20)] + [(200 + i, f"http://two.example/t/{i}", teasers(i), "x") for i in range(5)]
    rows += [(300, "http://deep.example/1", "<article>" + "<div>" * 3000 + "a", "x"), (301, "http://deep.example/2", "<article>" + "<div>" * 3000 + "b", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(5)
    got = h.main_text(df, small=small).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == "Story 3\n\nText number 3 with words of its own 21." and by[3]["by_wrapper"]
    assert by[7]["text"] == "" and by[None]["text"] == text(PAGE) and by[8]["n_chars"] == 499_999 and not by[8]["by_wrapper"]
    assert "Signed by the desk" in by[10]["text"] and not by[10]["by_wrapper"]
    for i in range(20):
        want = [f"Story {i}", f"Text number {i} with many words of its own {i * 7}.", *[f"More of {i}, {k}." for k in range(i % 4)]]
        assert by[100 + i]["text"] == "\n\n".join(want) and by[100 + i]["by_wrapper"]
    for i in range(5):
        assert by[200 + i]["text"].count("\n\n") == 7 and "Teaser" not in by[200 + i]["text"]
    assert (by[300]["text"], by[301]["text"]) == ("a", "b")
    assert h.main_text(df.limit(0), small=small).count() == 0


def test_forms_around_pages():
    body = "<nav>menu</nav><article><h1>T</h1><p>the text</p><form><p>mail</p><button>go</button></form></article><footer>f</footer>"
    assert text(f"<body><form id=aspnet>{body}</form>") == "T\n\nthe text"
    assert text(f"<body><form><div><p>{'long text ' * 9}</p></div></form><div>short</div>") == ("long text " * 9).strip()
    assert text("<body><form>search here</form><div><p>a text that is longer than that</p></div>") == "a text that is longer than that"
    # A role or hidden form stays apart, whatever it holds.
    assert text("<body><form role=search><h1>x</h1></form><p>kept</p>") == "kept"


def test_near_copies_keep_their_article(spark):
    """Four pages of one article that differ in a counter, and a group of different articles with one notice."""
    story = "".join(f"<p>paragraph {i} of the story, which is the same on each page</p>" for i in range(5))
    page = lambda n: f"<html><body><nav>menu</nav><article><h1>Story</h1>{story}<p>Views {n}</p></article></body></html>"
    other = lambda n: f"<html><body><article><p>notice for all</p><p>{' '.join(f'word{n * 50 + j}' for j in range(40))}</p></article></body></html>"
    rows = [(n, f"http://copies.example/{n}", page(n)) for n in range(4)] + [(10 + n, f"http://notes.example/{n}", other(n)) for n in range(6)]
    got = {r["page_id"]: r["text"] for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(4):
        assert got[n].startswith("Story\n\nparagraph 0") and got[n].endswith(f"same on each page\n\nViews {n}")
    for n in range(6):
        assert got[10 + n] == " ".join(f"word{n * 50 + j}" for j in range(40))
