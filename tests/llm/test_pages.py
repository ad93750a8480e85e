import base64
import hashlib
import time
from html.parser import HTMLParser

import pytest

from palimpsest.llm import queries, warc
from palimpsest.llm.html_text import BLOCK, extract, extract_text
from palimpsest.llm.store import Store

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>"</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav>menu</nav></header><div class="cookie-notice">We use cookies</div>
<div class="content-with-sidebar"><div class="sidebar"><p>Side text, with, commas, and many words of text in it, more than enough</p></div>
<div class="content"><h1>Title</h1><p>First &amp; para, with commas, and a good<br>number of   words in it.</p><form><p>sub</p></form><p>Short.
<p>Third <a href=x>with a link</a> &#8212; &eacute;t&eacute;</p><ul class="main-nav"><li>x</ul><ul><li>a<li>b</ul><table><tr><td>c1<td>c2</table>
<div class="ad">buy</div><aside>aside</aside>tail text</div>
<section id="comments"><article class="comment"><p>Nice article, really, I liked it a lot, thanks a lot for it, truly</p></article></section></div>
<footer>foot</footer></body></html>"""


def test_extract():
    assert extract(PAGE).split("\n") == ["Title", "First & para, with commas, and a good number of words in it.", "Short.", "Third with a link — été", "a", "b", "c1", "c2", "tail text"]


def test_extract_odd():
    assert extract(None) == extract("") == extract("<script>x") == ""
    assert extract("just text") == "just text"
    assert extract("<article><p>cut o") == "cut o"
    assert extract("<div>" * 20000 + "deep") == "deep"
    assert extract("<article><p>a &lt; b</p><p>" + "long, " * 30000 + "</p></article>").startswith("a < b\nlong, long")


def test_whole_article():
    page = "<body><main><article><section><p>" + "Long text, with commas, and more of it, again. " * 20 + "</p></section><section><p>The end.</p></section>"
    page += '<div class="related-work"><h2>Related work</h2><p>Others did this, too.</p></div><div class="related-links"><a href=x>other page</a></div><div class="share-story"><a href=y>tell</a></div>'
    page += '</article><div class="more"><a href=z>x</a></div></main><footer>f</footer>'
    assert extract(page).split("\n")[1:] == ["The end.", "Related work", "Others did this, too."]


@pytest.mark.parametrize("page", ["<div>" * 1 + "<div>{}" , "<i>{}", "<p><i>{}<p>x</b>", "<header>{}", "</section>{}", "<b><div>{}</b>"])
def test_time_is_linear_in_depth(page):
    before, after = page.split("{}")
    took = []
    for n in (20_000, 80_000):
        made = (before * n) + "deep, text" + (after * n)
        began = time.process_time()
        extract(made)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.2  # a quadratic step takes 16 times as long


class Plain(HTMLParser):
    """The blocks of the article element of the generated pages, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.depth, self.skip = [], [], 0, 0

    def flush(self):
        line = " ".join("".join(self.text).split())
        if line and self.depth:
            self.out.append(line)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.flush()
            self.depth += 1
        elif tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_generated_pages(spark, sf):
    """Every page of the tables has its text in one article element without other parts."""
    rows = queries.op10_tree_scoring(spark, f"/root/testdata/{sf}").collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        plain = Plain()
        plain.feed(html[r.page_id] or "")
        plain.flush()
        assert (r.text, r.n_chars) == ("\n".join(plain.out), len("\n".join(plain.out))), r.page_id


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, None, "u"), (1, "<p>x</p>", None), (None, "", "u")], "page_id long, html string, tag string")
    assert sorted(r.text for r in extract_text(df).collect()) == ["", "", "x"]
    assert extract_text(df.limit(0)).count() == 0


def test_surt():
    assert warc.surt("http://a.Example.com:80/p?q=1#f") == "com,example,a:80)/p?q=1#f"
    assert warc.surt(None) == "" and warc.surt("http://[bad") and warc.surt("a\tb") == "a%09b"


def want(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = i is not None and first[h or ""] != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def test_archives(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(k, f"http://h{k % 3}.example.org/{k % 10}", "same" if k % 3 == 0 else f"<p>{k} é") for k in range(100)]
    rows += [(200, None, None), (201, "http://x.org", ""), (201, "http://x.org", ""), (None, "http://x.org", "same"), (None, None, None), (202, "http://h0.example.org/0", "same")]
    pages, store = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), Store(spark, "test-warc")
    top = warc.build_index(warc.write_archives(pages, store), store, parts=3)
    assert len(top) == 3
    found = warc.read_records(warc.locate(pages, store, top), store, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == want(rows)
    assert {bytes(r.payload).decode() for r in found if r.record_type == "response" and r.page_id == 1} == {"<p>1 é"}
    missing = spark.createDataFrame([(1, "http://h2.example.org/1"), (5, "http://none.org/")], "page_id long, url string")
    assert warc.locate(missing, store, top).count() == 0


def test_archives_empty(spark):
    pages, store = spark.createDataFrame([], "page_id long, url string, html string"), Store(spark, "test-warc")
    top = warc.build_index(warc.write_archives(pages, store), store)
    assert top == [] and warc.read_records(warc.locate(pages, store, top), store).count() == 0


def test_pages_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op1_capture_index(spark, "/root/testdata/sf0.001").collect()), key=str) == want(rows)
