"""Page extraction against an independent reference, and scans of long and odd texts in bounded time."""

import random
import time
from html.parser import HTMLParser

import pyarrow as pa
import pytest

from sparkloom.llm import _blocks as B
from sparkloom.llm import html, licenses, secrets

SF = "/root/testdata/sf0.001"
BLOCK = set("p div article section main h1 h2 h3 h4 ul ol li table tr td th blockquote pre header footer nav aside form body html".split())
CUT = set("nav footer aside form script style".split())


class Reference(HTMLParser):
    """What stands in article or main elements, block by block, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.stack, self.out, self.text = [], [], ""

    def flush(self):
        self.out.append(" ".join(self.text.split()))
        self.text = ""

    def cut(self):
        return any(c for _, c in self.stack)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
            return
        if tag in ("img", "hr", "meta", "link", "input"):
            return
        if tag in BLOCK:
            self.flush()
            while self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] == tag == "li"):
                self.stack.pop()
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).replace("-", " ").replace("_", " ").split()
        self.stack.append((tag, tag in CUT or bool(set(names) & html._CUT_WORDS)))

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.cut() and any(t in ("article", "main") for t, _ in self.stack):
            self.text += data


def reference(page):
    parser = Reference()
    parser.feed(page)
    parser.flush()
    return " ".join(x for x in parser.out if x)


def sentence(rng, n):
    return " ".join(rng.choice("time, people year, work of the great city and river, stone".split()) for _ in range(n)) + "."


def made_page(rng):
    """(page, its main text) with boilerplate of many kinds around and inside."""
    junk = [
        lambda: "<nav><ul><li><a href='/x'>Home</a><li><a href=/y>News</a></ul></nav>",
        lambda: f"<div class='{rng.choice(['sidebar', 'ad', 'cookie-notice', 'social share', 'comments', 'newsletter'])}'><p>{sentence(rng, 30)}</p></div>",
        lambda: f"<script>if (a < b) {{ x('<p>{sentence(rng, 5)}</p>') }}</script><style>p > a {{ }}</style>",
        lambda: f"<form action=/s><p>{sentence(rng, 8)}<input name=q></form>",
        lambda: f"<!-- {sentence(rng, 9)} <p> -->",
        lambda: f"<aside><p>{sentence(rng, 20)}</p></aside>",
    ]
    body, want = [], []
    for _ in range(rng.randint(2, 9)):
        t = sentence(rng, rng.randint(12, 60))
        kind = rng.randrange(6)
        if kind == 0:
            head = sentence(rng, 4)
            body.append(f"<h2>{head}</h2><p>{t}")
            want += [head, t]
        elif kind == 1:
            items = [sentence(rng, 12) for _ in range(3)]
            body.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
            want += items
        elif kind == 2:
            body.append(f"<p>{t}&nbsp;&amp; <b>bold</b><br>next <span class=ad>BUY <b>NOW</b></span>end</p>")
            want.append(f"{t} & bold next end")
        elif kind == 3:
            body.append(f"<blockquote><p>{t}</p></blockquote>")
            want.append(t)
        else:
            body.append(f"<p class=lead>\n  {t}\n</p>")
            want.append(t)
        if rng.random() < 0.3:
            body.append(rng.choice(junk)())
    around = [rng.choice(junk)() for _ in range(rng.randint(0, 4))]
    holder = rng.choice([("<article>", "</article>"), ("<main id=m>", "</main>"), ("<div id=content>", "</div>")])
    page = f"<html><head><title>T</title></head><body><header><h1>Site</h1></header>{''.join(around)}{holder[0]}{''.join(body)}{holder[1]}<footer>x</footer></body></html>"
    return page, " ".join(want)


def test_made_pages():
    rng = random.Random(4)
    for _ in range(400):
        page, want = made_page(rng)
        assert html.main_text(page) == want, page
        if "<article>" in page or "<main" in page:
            assert reference(page) == want, page


def test_table_pages_equal_the_reference(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages = [p for p in pages if p and ("<article" in p or "<main" in p)]
    same = sum(html.main_text(p) == reference(p) for p in pages)
    assert len(pages) > 20 and same == len(pages)


@pytest.mark.parametrize("part", ["<div>", "<span class=ad>", "<a b", '<a "', "<!x", "<svg>", "<!--", "<ul><li>", "</p><article><div>"])
def test_odd_markup_takes_linear_time(part):
    took = []
    for n in (20_000, 160_000):
        page = "<p>" + part * (n // len(part)) + "some, words that end the page and are long enough"
        began = time.perf_counter()
        html.main_text(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 0.5


def test_long_pages_are_whole():
    rng = random.Random(5)
    text = [sentence(rng, 40) for _ in range(4000)]
    page = "<nav>x</nav><article>" + "".join(f"<p>{t}</p>" for t in text) + "</article>"
    assert html.main_text(page) == " ".join(text)


@pytest.mark.parametrize("value", [b"a" * 10_000 + b"1", b"ab-" * 5000 + b"A1b", b"Ab" * 5000 + b"9", b"A" * 9999 + b"a" * 9999 + b"1", b"-" * 10_000 + b"x"])
def test_allow_list_takes_linear_time(value):
    began = time.perf_counter()
    secrets._suspicious(value)
    assert time.perf_counter() - began < 1


@pytest.mark.parametrize(
    "value,known",
    [("ab-cd/Ef_GH=9", True), ("ABc-de", False), ("ThisWasCamelCase", True), ("ThisIsA", False), ("/usr/local/lib9", False), ("2024-01-02", True),
     ("a" * 30, True), ("a-1-b", True), ("1-a-b", False), ("myExampleKey9", True), ("xxxxxxxx9q", True)],
)
def test_allow_list(value, known):
    raw = value.encode()
    assert (any(rule.fullmatch(raw) for rule in secrets.ALLOWED) or any(x in raw.lower() for x in secrets.SAMPLES)) is known


def test_long_secret_rows(spark):
    """A table without rows, null ids, and runs of a hundred thousand characters."""
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.find_secrets(empty).collect() == [] and licenses.scan_licenses(empty).collect() == []
    rows = [(None, "a-" * 50_000), (None, "q7Zp2LxV9sTn4KdR8mWc1YbJ" * 5000), (3, None), (3, "")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_entropy) for r in got) == [(0, 0), (0, 1), (3, 0), (3, 0)]


def test_long_and_strange_licences(spark):
    names = [f"Lic-{i}.0" for i in range(600)]
    long = "SPDX-License-Identifier: " + " OR ".join(names)
    assert len(long) > 5000
    texts = [long, "SPDX-License-Identifier: MITRE-Proprietary", "SPDX-License-Identifier: (MIT AND (BSD-3-Clause OR GPL-2.0+)) WITH x",
             "SPDX License Identifier: MIT", "spdx-license-identifier MIT", "SPDX-License-Identifier:\nMIT", "xSPDX-License-Identifier: MIT", "SPDX-License-Identifier : Apache-2.0+"]
    got = licenses.scanned(next(B.blocks(pa.array(texts))))
    assert got["labels"][0] == ",".join(sorted(f"spdx:{x.lower()}" for x in names))
    assert got["permissive"] == [False, False, True, None, None, None, None, True]
    assert got["labels"][3:7] == ["", "", "", ""]
    rows = spark.createDataFrame([(None, "under the MIT license"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.labels) for r in licenses.scan_licenses(rows).collect()) == [(0, ""), (4, "mit")]
