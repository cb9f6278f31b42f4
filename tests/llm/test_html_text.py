from html.parser import HTMLParser

import pytest

from frisk.llm import html_text as H
from tests.conftest import SF

CASES = {
    "": "", "plain &amp; simple": "plain & simple", "<p>a<p>b": "a\n\nb", "a<br>b<br><br>c": "a\nb\n\nc",
    "<div>a</div><div>b</div>": "a\nb", "<b>bo</b>ld <i> x </i>y": "bold x y", "<p>a<div>b</div>c": "a\n\nb\nc",
    "<ul><li>one<li>two<ul><li>in</ul><li>three</ul>": "- one\n- two\n  - in\n- three",
    "<ol start=3><li>c<li value=9>i<li>j</ol>": "3. c\n9. i\n10. j",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e", "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<table><caption>cap</caption><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td></table>": "cap\nname      | n\nlong name | 1\nx         |",
    "<table><tr><td>a<br>b<td>c</table>after": "a | c\nb |\n\nafter", "<table><td>no row</table>": "no row",
    "<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>": "in | ner | out",
    "<table><tr><td colspan=2>wide<td>x<tr><td>1<td>2<td>3</table>": "wide |   | x\n1    | 2 | 3",
    "<pre>a\n  b\n\nc</pre>d": "a\n  b\n\nc\n\nd", "x<!-- no -->y<![CDATA[z]]>": "xyz",
    "<script>var t='</p>';<b></script>seen<style>p{}</style>": "seen", "<head><title>t</title>x</head><body>y": "y",
    "<p hidden>no</p><p style='color:red; DISPLAY : none'>no</p><p aria-hidden=true>no</p>yes": "yes",
    "<img alt='a &lt; b'> <img src=x>t": "a < b t", "</b></p>x</div>": "x", "a < b and <3 <": "a < b and <3 <",
    "<p title='a>b'>q</p>": "q", "<select><option>no</select>ok": "ok", "a b\n\t c": "a b c",
    "<body><p>1<hr>2": "1\n\n2", "<script>never closed": "", "<div><span>a</div>b</span>": "a\nb", "<td>alone</td><td>cell": "alone\ncell",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert H.render(html) == CASES[html]


SHOWN = {
    '<p title="a hidden gem">yes</p>': "yes", '<div class="nav hidden md:flex">yes</div>': "yes", "<p data-note='was hidden in'>yes": "yes",
    '<p title="type=hidden aria-hidden=true">yes': "yes", "<p title=\"style='display:none'\">yes": "yes", "<p data-hidden=1 id=hidden>yes": "yes",
    '<p style="display:none; display:block">yes': "yes", '<p style="--x:display:none">yes': "yes", "<p title='x'HIDDEN>no</p>yes": "yes",
    '<p class="a" hidden="">no</p><p style="visibility:hidden !important">no</p><p hidden=until-found>no</p>yes': "yes",
    '<img title="alt=no" alt="yes">': "yes", '<ol data-x="start=7"><li>a</ol>': "1. a",
    "a<svg><title>no</title><desc>no</desc><text>b</text><text>c</text><path d=x /></svg>d": "a b c d", "<desc>unknown</desc>": "unknown",
    "<math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></semantics></math>": "x=1",
}


@pytest.mark.parametrize("html", SHOWN)
def test_only_attributes_of_their_own_hide(html):
    assert H.render(html) == SHOWN[html]


class _Words(HTMLParser):
    """All words outside elements that are never shown; for pages without hidden attributes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.unseen = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "title"):
            self.unseen.append(tag)
        elif tag == "body":
            self.unseen.clear()
        elif tag == "img":
            self.words += (dict(attrs).get("alt") or "").split()

    def handle_endtag(self, tag):
        if self.unseen and tag == self.unseen[-1]:
            self.unseen.pop()

    def handle_data(self, data):
        if not self.unseen:
            self.words += data.split()


def test_all_words_of_the_pages_stay_in_order(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        plain = _Words()
        plain.feed(r.html)
        plain.close()
        want = "".join(plain.words).replace("|", "")  # bars may be text or stand between cells
        lines = [line[2:] if line.startswith("- ") else line for line in got[r.page_id].split("\n")]
        assert "".join("".join(line.replace("|", " ").split()) for line in lines) == want


def test_rows_that_reach_down():
    html = "<table><tr><td rowspan=2>A<td>B1<td>C1<tr><td>B2<td>C2<tr><td rowspan=0>D<td>E<td>F<tr><td>G<tr><td>H</table>"
    assert H.render(html) == "A | B1 | C1\n  | B2 | C2\nD | E  | F\n  | G\n  | H"


def test_deep_pages():
    for name in ("table", "div", "ul><li", "table><tr><td", "blockquote", "b", "thead", "dl><dd"):
        assert [w for w in H.render(f"<{name}>" * 5000 + "x").split() if w not in "-|"] == ["x"]
    deep = "<div>" * 420
    assert H.render(deep + "<div hidden>no<div>no</div>no</div>yes") == "yes"
    assert H.render(deep + "<p>a</p><div>b</div></div>c" + "</div>" * 419 + "d") == "a\n\nb\nc\nd"


@pytest.mark.parametrize("page", ["<a ", "<a", "<!", "</a ", "<a '", "<a \"'", "<div>", "<p><button>", "<script></script ", "<svg><desc>", "<a \"<b> "])
def test_time_is_linear(page):
    import time
    for end in ("", "\"", "\">"):
        start = time.monotonic()
        H.render(page * (1_000_000 // len(page)) + end)
        assert time.monotonic() - start < 20


def test_tags_end_where_a_plain_pattern_says(monkeypatch):
    import random
    import re
    plain = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*)(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
    rng, found = random.Random(3), 0
    for _ in range(4000):
        page = "".join(rng.choice(["<a", "<b", "</p", " ", ">", '"', "'", "=", "x", "/", "<", "<td "]) for _ in range(rng.randrange(3, 40)))
        for ordinary in (H._ORDINARY, re.compile("(?!)")):
            monkeypatch.setattr(H, "_ORDINARY", ordinary)
            tags = H._Tags(page)
            for m in re.finditer("<", page):
                want = plain.match(page, m.start())
                if want:
                    assert tags.tag(m.start() + 1 + len(want[1])) == (want[2].lower(), want.start(3), want.end(3))
                    found += 1
        monkeypatch.undo()
    assert found > 5000


def test_odd_rows(spark):
    deep = "<div><b><table><tr><td>" * 5000 + "x"
    rows = [(1, None, "a"), (None, "<p>x", None), (2, "", None), (2, "", None), (3, deep, "t"), (4, "<p>word " * 100_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text) for r in H.extract(pages).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2, None)] == [(1, ""), (2, ""), (2, ""), (None, "x")]
    assert dict(got)[3].strip(" |") == "x" and dict(got)[4].count("word") == 100_000
    assert H.extract(pages.limit(0)).count() == 0
