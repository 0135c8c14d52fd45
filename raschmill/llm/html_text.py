"""Main text of web pages by removal of site templates.

Pages are parsed into elements. Two hashes are made of an element's subtree: the exact one covers its tag, its class and
id, and everything below it, with white space folded; the shape leaves out text and takes equal neighbours as one, so a menu
keeps it whatever its links are. Spark counts, for every host, on how many different pages each subtree
occurs (copies of a page are one page). It is the host's template, and is deleted, if it occurs on two at least and its share of
the host's pages is SHARE or more with confidence (lower Wilson bound), which is one rule for hosts of any size. So a
host has at most (elements of a page) / SHARE templates, and its list is bounded. Shapes only count for subtrees whose text is mostly in
links, as paragraphs have the same shape everywhere.

Text that a site repeats by right must stay: inside the main part (article, main, role=main) a recurring subtree is
only deleted if it holds no paragraph, heading, list, table or quotation. Elements that are never the article's text go by
their meaning, recurring or not: menus, headers and footers of the page, asides, forms, scripts,
styles, reader comments, and elements whose class or id says advert, notice, sidebar and the like. Inside the main part only a
class, or an id that is one such word by itself, says so, as headings have ids like "related-work".

Blocks are the texts of block elements. Character references are decoded, white space inside a block
becomes one space, blocks are joined in page order by a line feed.

Defined results: a null or empty page has an empty text; pages without a main part are read as a
whole; text outside any element counts; unclosed elements end with their parents; a tag that the page ends in is dropped;
nesting has no limit, and the time is linear in a page's length; pages without a host share an empty host;
repeated rows are repeated pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHARE = 0.3
#: Standard deviations of the confidence bound.
Z = 1.64

# Element names of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math canvas object audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption".split())
_NEVER = frozenset("head nav aside footer form menu button select option dialog input label fieldset".split()) | _RAW
_ENDS_P = _BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
_SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}
# Words in a class or id that say an element is no article text.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist reply replies "
    "respond disqus discussion share sharing social related recommended widget skip login search disclaimer".split()
)
_PAGE_NOISE = frozenset({"header"})
# Ids that say so inside the main part.
_NOISE_ID = frozenset("ad ads advert banner breadcrumbs comments commentlist cookie-notice disqus disqus_thread footer menu nav navbar newsletter respond sidebar social".split())
# Classes of an article element that is a reader's comment.
_COMMENT = frozenset("comment reply comment-body comment-item comment-wrapper comment-content user-comment comment_body comment_item".split())

_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
_PLAIN = re.compile(r"""[^>"']*+>""")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in _RAW}
_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "names", "classes", "own_id", "role", "kids", "digest", "shape", "linked", "letters", "textual")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.kids, self.digest, self.shape, self.classes, self.own_id, self.role = tag, [], 0, 0, "", "", ""
        #: Length of the text below, and of its part in links; whether a text block is below.
        self.letters, self.linked, self.textual = 0, 0, tag in _TEXTUAL
        if attributes:
            for k, v in _ATTRIBUTE.findall(attributes):
                k, v = k.lower(), v.strip("\"'")
                if k == "role":
                    self.role = v.lower()
                elif k == "hidden":
                    self.role = self.role or "hidden"
                elif k == "class":
                    self.classes = v
                else:
                    self.own_id = v
        self.names = f"{self.classes} {self.own_id}"

    def noise(self, in_main: bool) -> bool:
        if self.tag in _NEVER or self.role in ("navigation", "banner", "contentinfo", "complementary", "search", "hidden") or (self.tag == "header" and not in_main):
            return True
        if self.names == " " or self.tag in ("body", "html", "main"):
            return False
        if self.tag == "article":
            return not _COMMENT.isdisjoint(self.classes.lower().split())
        if in_main:
            if self.own_id.lower() in _NOISE_ID:
                return True
            if self.tag in _TEXTUAL:
                return not _NOISE.isdisjoint(self.classes.lower().split())
            return not _NOISE.isdisjoint(w.lower() for w in _WORD.findall(self.classes))
        words = {w.lower() for w in _WORD.findall(self.names)}
        return bool(words & _NOISE) or bool(words & _PAGE_NOISE)


def _tag_end(page: str, at: int) -> int:
    """End of a tag whose name ends at ``at``: after the next ">" outside quotes, or after the next one if a quote stays open; -1 without any."""
    m = _PLAIN.match(page, at) or _QUOTED.match(page, at)
    return m.end() if m else page.find(">", at) + 1 or -1


def parse(page: str) -> Element:
    """The page's elements below one root; raw text of scripts and the like is left out."""
    root = Element("", "")
    stack, at, n = [root], 0, len(page)
    last = page.rfind(">")
    held: Counter[str] = Counter()
    while at < n:
        m = _START.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        if m[2] is None:
            closing = "-->" if m[0] == "<!--" else ">"
            end = page.find(closing, m.end())
            at = n if end < 0 else end + len(closing)
            continue
        end = _tag_end(page, m.end()) if last >= m.end() else -1
        if end < 0:
            break
        attributes, at = page[m.end() : end - 1], end
        tag = m[2].lower()
        if m[1]:
            if held[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        _close(stack, i, held)
                        break
            continue
        if tag in _ENDS_P and held["p"]:
            _end(stack, {"p"}, _P_SCOPES - {tag}, held)
        if tag in _SIBLINGS and any(held[x] for x in _SIBLINGS[tag]):
            _end(stack, _SIBLINGS[tag], _SCOPES[tag], held)
        e = Element(tag, attributes)
        stack[-1].kids.append(e)
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
        elif tag not in _VOID and not attributes.endswith("/"):
            stack.append(e)
            held[tag] += 1
    _close(stack, 0, held)
    return root


_P_SCOPES = {"table", "td", "th", "div", "article", "section", "li", "body"}


def _end(stack: list[Element], tags: set[str], scope: set[str], held: Counter[str]) -> None:
    """Close the nearest open element of these tags, unless a scope element lies between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            _close(stack, i, held)
            return
        if stack[i].tag in scope:
            return


def _close(stack: list[Element], i: int, held: Counter[str]) -> None:
    while len(stack) > max(i, 1) or (i == 0 and len(stack) == 1):
        e = stack.pop()
        held[e.tag] -= 1
        exact, shape = [e.tag, e.names], [e.tag, e.classes]
        for k in e.kids:
            if isinstance(k, Element):
                exact.append(f"\x02{k.digest:x}")
                if shape[-1] != (s := f"\x02{k.shape:x}"):
                    shape.append(s)
                e.letters += k.letters
                e.linked += k.letters if e.tag != "a" and k.tag == "a" else k.linked
                e.textual = e.textual or k.textual
            else:
                exact.append(t := _SPACE.sub(" ", k))
                e.letters += len(t) - t.count(" ")
        e.digest = xxhash.xxh3_64_intdigest("\x01".join(exact)) - (1 << 63)
        e.shape = xxhash.xxh3_64_intdigest("\x01".join(shape), 7) - (1 << 63)
        if not stack:
            return


def _elements(root: Element) -> Iterator[Element]:
    todo = [k for k in root.kids if isinstance(k, Element)]
    while todo:
        e = todo.pop()
        yield e
        todo += [k for k in e.kids if isinstance(k, Element)]


def _keys(e: Element) -> tuple[int, ...]:
    """Hashes by which a subtree is known: the exact one, and the shape if its text is mostly in links."""
    return (e.digest, e.shape) if e.letters and 2 * e.linked > e.letters else (e.digest,)


def subtree_hashes(page: str) -> set[int]:
    """Hashes of all subtrees that hold any text or element and could be deleted."""
    return {h for e in _elements(parse(page)) if e.kids and e.tag not in ("html", "body", "head", "a") for h in _keys(e)}


def _is_main(e: Element) -> bool:
    return e.tag in ("article", "main") or e.role == "main"


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset(), by_meaning: bool = True) -> str:
    """The page's main text without noise and without the subtrees of the host's template.

    Without ``by_meaning`` only the template is deleted: what the method does by itself.
    """
    if not page:
        return ""
    root = parse(page)
    mains, todo = [], [root] if by_meaning else []
    while todo:
        e = todo.pop()
        if _is_main(e):
            mains.append(e)
        else:
            todo += [k for k in reversed(e.kids) if isinstance(k, Element) and not k.noise(False)]
    blocks: list[str] = []
    for top in mains or [root]:
        _read(top, bool(mains), template, blocks, by_meaning)
    return "\n".join(blocks)


def _read(top: Element, in_main: bool, template: frozenset[int] | set[int], blocks: list[str], by_meaning: bool) -> None:
    piece: list[str] = []

    def flush() -> None:
        if piece:
            text = _SPACE.sub(" ", html.unescape("".join(piece))).strip()
            if text:
                blocks.append(text)
            piece.clear()

    todo: list = [top]
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            piece.append(k)
        else:
            if k is not top:
                if by_meaning and k.noise(in_main):
                    continue
                if template and not (in_main and k.textual) and k.tag != "a" and not template.isdisjoint(_keys(k)):
                    continue
                if k.tag == "br":
                    piece.append(" ")
                    continue
            if k.tag in _BLOCK:
                flush()
                todo.append(None)
            todo += reversed(k.kids)
    flush()


def _host(url) -> object:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def is_template(on: Column, pages: Column, share: float = SHARE) -> Column:
    """On two pages at least, and the lower confidence bound of the share of a host's pages reaches ``share``."""
    p, z2 = on / pages, Z * Z
    low = (p + z2 / (2 * pages) - Z * F.sqrt(p * (1 - p) / pages + z2 / (4 * pages * pages))) / (1 + z2 / pages)
    return (on >= 2) & (low >= share)


def site_templates(pages: DataFrame, url: str = "url", page: str = "html", share: float = SHARE) -> DataFrame:
    """host, hashes: the subtrees on many pages of each host that has any."""
    p = pages.select(_host(F.col(url)).alias("host"), F.col(page).cast("string").alias("html")).where("html is not null").withColumn("page", F.xxhash64("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, own_page, found = [], [], []
            for host, text, name in zip(b.column("host").to_pylist(), b.column("html"), b.column("page").to_pylist()):
                own = subtree_hashes(text.as_py())
                hosts += [host] * len(own)
                own_page += [name] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(own_page, pa.int64()), pa.array(found, pa.int64())], ["host", "page", "hash"])

    n = p.groupBy("host").agg(F.count_distinct("page").alias("n"))
    counts = p.mapInArrow(run, "host string, page long, hash long").groupBy("host", "hash").agg(F.count_distinct("page").alias("c")).where("c > 1")
    return counts.join(n, "host").where(is_template(F.col("c"), F.col("n"), share)).groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", share: float = SHARE, by_meaning: bool = True) -> DataFrame:
    """page_id, url, text for every page."""
    templates = written(site_templates(pages, url, page, share))
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"), _host(F.col(url)).alias("host"))
    joined = p.join(templates, "host", "left").select("page_id", "url", "html", "host", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, frozenset[int]] = {}
            texts = []
            for t, host, h in zip(b.column("html"), b.column("host").to_pylist(), b.column("hashes")):
                if host not in known:
                    known[host] = frozenset(h.as_py() or ())
                texts.append(main_text(t.as_py(), known[host], by_meaning))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
