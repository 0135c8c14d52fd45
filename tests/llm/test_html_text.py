import html
import math
import random
import re
import time
from collections import Counter

import pytest

from raschmill.llm import html_text
from raschmill.llm.html_text import extract, main_text, parse, subtree_hashes

CASES = [
    ("<p>a  b<br>c</p><p>d", "a b c\nd"),
    ("<html><head><title>T</title></head><body><nav><a>m</a></nav><article><h1>H &amp; I</h1><p><b>x<p>y</b></article><footer>f</footer>", "H & I\nx\ny"),
    ("<main>in<script>var t='</p>';</script><style>p{}</style> text<!-- c --></main>out", "in text"),
    ("<body>loose <i>text</i><div>block</div>tail</body>", "loose text\nblock\ntail"),
    ("<article><p>one</p><div class='ad'>buy</div><section class=comments><p>me</p></section><form><p>f</p></form><p>two</article>", "one\ntwo"),
    ("<article><header><h1>t</h1></header><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "t\na\nb\n1\n2"),
    ("<article><p title='a > b' class=\"x\">q</p><p>&eacute;&#233;&#xe9;&nbsp;&lt;p&gt; &am</p></article>", "q\néé\xe9 <p> &am".replace("éé\xe9", "ééé")),
    ("<div id='cookie-notice'>ok?</div><div class='sidebar'>s</div><p>t</p><aside>a</aside>", "t"),
    ("a < b <p>c</p> <", "a < b\nc\n<"),
    ("<article><p>t</p><article class='comment'><p>me too</p></article></article><article class='comment'><p>no</p></article>", "t"),
    ("<article class='post comments-open'><h2 id='related-work'>Related work</h2><section id=discussion><p>d</p></section><div id=comments>c</div><p class='notice-me'>p</p><p class=ad>a</p></article>", "Related work\nd\np"),
    ("<p>x</p><a href=\"y", "x"),
    ("<p>never closed <b>bold", "never closed bold"),
    ("<script>x", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_deep_and_odd_pages():
    assert main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert main_text("<p " + "a='" * 3000) is not None
    r = random.Random(0)
    for _ in range(300):
        page = "".join(r.choice(["<p>", "</p>", "<b", ">", "'", '"', "x ", "</", "<!--", "-->", "<ul>", "<li>", "&am", "<td>", "</table>", "<article>"]) for _ in range(40))
        main_text(page)
        subtree_hashes(page)


def test_time_is_linear():
    for page in ("<a " * 400_000, "<a " * 400_000 + ">", "<a '" * 300_001 + ">", "<a '>" * 200_001, "<a '" * 300_001, "<b>" * 300_000 + "</i>" * 300_000, "<p><li>" * 100_000, "<!--" * 200_000, "</p>" * 200_000, "<div><p>" * 100_000):
        begin = time.process_time()
        main_text(page)
        assert time.process_time() - begin < 12, page[:8]


def test_menu_below_any_depth():
    page = "<article>" + "<div>" * 900 + "<nav><a>menu</a></nav><p>text</p>" + "</div>" * 900 + "</article>"
    assert main_text(page) == "text"


def test_subtree_hash_covers_what_is_below():
    a, b = (parse(p).kids[0] for p in ("<div class=x><p>one  two</p></div>", "<div class=x><p>one two</p></div>"))
    c = parse("<div class=y><p>one two</p></div>").kids[0]
    assert a.digest == b.digest != c.digest and a.kids[0].digest == c.kids[0].digest


def site(host, n, first=0, copies=1):
    """Pages without an article element: a menu with changing links, a line on top, a text, a line below."""
    r, out = random.Random(host), []
    for i in range(n):
        menu = "".join(f"<li><a href=/{r.random()}>link {r.random()}</a></li>" for _ in range(r.randint(3, 6)))
        page = f"<body><div><ul>{menu}</ul></div><div><span>Top of {host}</span></div><div><p>Paragraph {i} of {host}</p><div>Read also: all</div><p>More, {i}</p></div></body>"
        out += [(first + i, f"http://{host}/{i}", page)] * copies
    return out


def test_site_templates(spark):
    rows = site("a.example", 30) + site("b.example", 4, 100) + site("c.example", 1, 150)
    rows += [(200 + i, "http://d.example/x", "<article><p>Copied article</p><div>Follow us</div></article>") for i in range(20)]
    rows += [(230 + i, "http://e.example/x", f"<article><p>Article {i}</p><div>Follow us</div><p>All rights</p></article>") for i in range(20)]
    rows += [(260 + i, "http://f.example/x", "<div><p>One copied page</p></div>") for i in range(20)]
    rows += [(300, None, None), (301, "nonsense", "<p>t</p>"), (301, "nonsense", "<p>t</p>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert got[7] == "Paragraph 7 of a.example\nMore, 7"
    assert got[101] == "Paragraph 1 of b.example\nMore, 1"
    assert got[150].startswith("link") and got[150].endswith("Top of c.example\nParagraph 0 of c.example\nRead also: all\nMore, 0")
    assert got[205] == "Copied article\nFollow us"
    assert got[235] == "Article 5\nAll rights"
    assert got[265] == "One copied page"
    assert got[300] == "" and got[301] == "t"
    assert extract(pages).count() == len(rows)
    assert extract(pages.limit(0)).count() == 0


def test_templates_against_brute_force(spark):
    """Counting by host, one page at a time; and what is left by templates alone."""
    rows = site("a.example", 12, 10_000, 3) + site("b.example", 5, 10_100) + site("A.example", 4, 10_200)
    rows += [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    by = {}
    for _, url, page in rows:
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        by.setdefault(host[1].lower() if host else "", set()).add(page)
    want = {}
    for host, own in by.items():
        counts = Counter(h for page in own for h in subtree_hashes(page))
        n, z = len(own), html_text.Z
        for h, c in counts.items():
            p = c / n
            low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if c >= 2 and low >= html_text.SHARE:
                want.setdefault(host, set()).add(h)
    got = {r["host"]: set(r["hashes"]) for r in html_text.site_templates(pages).collect()}
    assert got == want and len(want["a.example"]) > 2
    texts = {(r["page_id"], r["text"]) for r in extract(pages).collect()}
    hosts = {i: (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "") or [0, ""])[1].lower() for i, url, _ in rows}
    assert texts == {(i, main_text(page, want.get(hosts[i], set()))) for i, _, page in rows}


def test_query(spark):
    from raschmill.llm.queries import op2_html_text

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op2_html_text(spark, sf).collect()
    assert {r["page_id"] for r in got} == set(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    inner = lambda t: re.sub(r"\s+", "", html.unescape(re.sub(r"<[^>]*>", "", re.search(r"<article>(.*)</article>", t, re.S)[1])))
    plain = [r for r in got if pages[r["page_id"]] and pages[r["page_id"]].count("<article>") == 1 and "<script" not in pages[r["page_id"]].split("<article>")[1]]
    assert len(plain) > 10
    assert sum(re.sub(r"\s+", "", r["text"]) == inner(pages[r["page_id"]]) for r in plain) > 0.8 * len(plain)
