"""Extracted text against the markup of the test pages, planted layouts, and odd pages."""

from __future__ import annotations

import html
import random
import re

from agoraflow.llm import templates
from agoraflow.llm.common import table
from agoraflow.llm.queries import QUERIES


def slow_text(page):
    """The article of a test page by its known markup: blocks are h1 and p."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query_equals_known_markup(spark, sf_dir):
    pages = {r.page_id: (r.url, slow_text(r.html)) for r in table(spark, sf_dir, "pages").collect()}
    rows = QUERIES["op8_template_deduction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text) == pages[r.page_id] and r.n_chars == len(r.text)


LAYOUT = """<html><head><title>T {i}</title><script>if (a<b) document.write("<p>no</p>")</script></head>
<body class="has-sidebar"><header><h1>Site name</h1></header><div id="main-menu"><ul><li>Home<li>About</ul></div>
<div class="cookie-notice">We use cookies</div>{open}<header><h2>Title {i}</h2></header>
<p>First &amp; <b>bold</b>&nbsp;text<br>of {w}<p>Second &lt;tag&gt; &#233;
<aside>Related things</aside><div class="ad">Buy</div><form><label>Mail</label><input></form>
<ul><li>one<li>two {w}</ul><table><tr><td>a<td>b</table>{close}
<section class="comments"><p>Nice post {w}</p></section><div class="sidebar">More</div><footer>&copy; 2020 {i}"""

WANT = "First & bold text of {w}\nSecond <tag> é\none\ntwo {w}\na\nb"


def test_layouts():
    article = LAYOUT.replace("{open}", "<article class=post>").replace("{close}", "</article>")
    got = templates.main_text(article.replace("{i}", "5").replace("{w}", "x"))
    assert got == "Title 5\n" + WANT.replace("{w}", "x")
    plain = LAYOUT.replace("{open}", "<div>").replace("{close}", "</div>").replace("{i}", "5").replace("{w}", "x")
    assert templates.main_text(plain) == WANT.replace("{w}", "x")
    wrapped = '<body><div class="with sidebar"><main><p>kept</p></main><div class="sidebar">gone</div></div>'
    assert templates.main_text(wrapped) == "kept"
    assert templates.main_text("no markup  at\nall") == "no markup at all"
    assert templates.main_text("<p>a<script>x</script>b<!-- <p> --> c</p></p><p>d") == "ab c\nd"
    assert templates.main_text("<p title='a>b'>x</p><textarea><p>y</p>") == "x"
    assert templates.main_text("a < b <c") == "a < b <c"


def test_words_of_the_template_go(spark):
    rng = random.Random(1)
    pages = []
    for i in range(30):
        body = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(20))
        items = "".join(f"<span>Rank {k}</span>" for k in range(i % 4))
        pages.append((i, f"http://One.example/{i}", f"<body><div>Welcome to our pages</div>{items}<div>{body}</div><div>Read more here</div>"))
    pages.append((30, "http://two.example/1", "<body><div>Welcome to our pages</div>"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in templates.extract(frame).collect()}
    for i in range(30):
        body = re.search(r"<div>([a-z ]*)</div><div>Read", pages[i][2])[1]
        assert got[i].endswith(body) and "Welcome" not in got[i] and "Read" not in got[i]
    assert got[30] == "Welcome to our pages"


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (2, "", ""), (3, "http://h/", None), (4, "nonsense", "<p>a<p>b"), (4, "nonsense", "<p>a<p>b"),
            (None, "http://h/x", "<div>" * 3000 + "deep"), (5, "https://u@h:8/p", "<p>" + "word " * 50_000)]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = templates.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = sorted(((r.page_id, r.text[:20], r.n_chars) for r in got.collect()), key=str)
    want = [(1, "a", 1), (2, "", 0), (3, "", 0), (4, "a\nb", 3), (4, "a\nb", 3), (None, "deep", 4), (5, ("word " * 4), 249_999)]
    assert texts == sorted(want, key=str)
    assert templates.extract(frame.limit(0)).count() == 0


def test_classes_come_from_one_parsing(spark):
    """Counts and order of tokens are read from what is written of the pages, not from the pages again."""
    pages = [(i, "http://h/", f"<body><div>Same words</div><div>w{i}</div>{'<b>x</b>' * (i % 3)}</body>") for i in range(9)]
    frame = spark.createDataFrame([*pages, (9, None, "<p>"), (10, "http://h/", None)], "page_id long, url string, html string")
    parsed = templates.page_tokens(frame)
    rows = parsed.collect()
    assert sorted(list(zip(r.tokens, r.is_word)) for r in rows) == sorted(templates.tokens_of(p) for _, _, p in pages)
    found = {r.token: r.is_word for r in templates.occurrence_classes(parsed).collect()}
    everywhere = set.intersection(*(set(templates.tokens_of(p)) for _, _, p in pages))
    assert found == dict(everywhere)
    assert "html" not in templates.occurrence_classes(parsed)._jdf.queryExecution().toString()


def test_text_comes_from_slots_of_the_classes(spark):
    """A slot has the role that the template gives it on most pages of the host, also where a page's own tags tell another."""
    pages = []
    for i in range(12):
        wrapper = f'<div class="with sidebar">Site {i} notes<main><p>Body w{i}</p></main></div>'
        if i == 5:  # the article element is missing on one page only: alone, its wrapper would be a sidebar as a whole
            wrapper = f'<div class="with sidebar">Site {i} notes</div>'
        pages.append((i, "http://h.example/", f"<body><div>Top x{i}</div>{wrapper}<p>End</p></body>"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in templates.extract(frame).collect()}
    assert [got[i] for i in range(12) if i != 5] == [f"Body w{i}" for i in range(12) if i != 5]
    # the words of the template (Top, Site, notes, End) fill no slot, x5 and 5 do
    assert templates.main_text(pages[5][2]) == "Top x5\nEnd" and got[5] == "x5\n5"

    learned = templates.templates(templates.parsed_pages(frame)).collect()
    assert [r.host for r in learned] == ["h.example"]
    in_classes = {t for c in learned[0].classes for t in c}
    assert set(learned[0].slots) <= in_classes | {0}
    roles = dict(zip(learned[0].slots, learned[0].slot_roles))
    assert set(roles.values()) == {0, templates.INSIDE}


def test_slots_nest():
    classes = [[1, 2, 3], [4, 5], [6, 7]]
    spots = templates._spots(classes)
    slots, crossed = templates.fill([9, 1, 4, 9, 5, 4, 5, 2, 3, 9], spots)
    assert slots.tolist() == [0, 0, 1, 4, 4, 1, 4, 1, 2, 0, 0] and not crossed
    # a round of the third class is open when the second, around it, goes on
    slots, crossed = templates.fill([1, 4, 6, 5, 7, 2, 3], spots)
    assert crossed == {2} and slots.tolist() == [0, 1, 4, 6, 1, 1, 2, 0]


def test_classes_that_cross_are_taken_out(spark):
    parsed = spark.createDataFrame([("h", [1, 4, 6, 5, 7, 2]), ("h", [1, 4, 6, 7, 5, 2])], "host string, tokens array<long>")
    valid = spark.createDataFrame([("h", [1, 2]), ("h", [4, 5]), ("h", [6, 7])], "host string, class array<long>")
    (row,) = templates.nested_classes(parsed, valid).collect()
    assert sorted(row["classes"]) == [[1, 2], [4, 5]]
