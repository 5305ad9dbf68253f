"""Main text of web pages with the templates of their sites removed.

Element subtrees are hashed bottom-up, a parent from the hashes of its children, and counted per host in Spark, each distinct page once. A subtree
that recurs on many pages of its host belongs to the site's template and is taken out, with the elements whose kind or name marks them as
page furniture. Paragraphs and headings of an article are its text even where they recur, and nothing that holds the article is ever taken out.

Only hashes are counted and joined; a page's html moves once, to meet the list of its own recurring subtrees.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import Scratch, column, pieces

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[!?/][^>]*>)", re.S)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("head nav footer aside form script style noscript template iframe svg canvas object button select textarea dialog menu title".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote a b i em strong span code li td th tr dd dt".split())
#: Words of class, id or role that mark page furniture, and words that may stand beside them in a compound such as site-footer. A compound with
#: any other word, such as no-sidebar or search-results, marks nothing.
MARKS = frozenset("ad ads adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies cookiebar consent gdpr notice notices popup modal overlay sidebar menu navbar nav navigation "
                  "breadcrumb breadcrumbs comment comments disqus reply replies share sharing social related recommended newsletter subscribe footer contentinfo complementary masthead pagination pager toolbar skip widget search login signup".split())
BESIDE = frozenset("site page main top bottom left right center upper lower primary secondary global inner outer list box block bar wrap wrapper container section area slot item items unit form field button buttons link links icon icons content posts articles stories header thread text title".split())
CLOSES_P = BLOCK - {"body", "html"}


class Element:
    __slots__ = ("tag", "up", "kind", "mark", "bad", "article", "parts", "hash")

    def __init__(self, tag: str, up: Element | None, kind: bool, mark: bool, first: str):
        self.tag, self.up, self.kind, self.mark, self.bad, self.article, self.parts, self.hash = tag, up, kind, mark, False, False, [first], 0

    def close(self) -> None:
        """The hash of the subtree: its start tag, its own texts and its children's hashes in order."""
        self.hash = xxhash.xxh64_intdigest("\x1f".join(self.parts).encode("utf-8", "replace")) - (1 << 63)
        if self.up is not None:
            self.up.parts.append(str(self.hash))
        self.parts = None


def marked(attributes: str) -> bool:
    """Whether a class, id or role has a name made of furniture words alone, or of one and words that go beside it."""
    for groups in NAMED.findall(attributes):
        for name in "".join(groups).lower().split():
            words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
            if any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words):
                return True
    return False


def scan(page: str) -> tuple[list[Element], list[tuple[int, int, tuple, str | None]], bool]:
    """Elements, runs of text with the elements around them (or a block edge), and whether there is an article.

    Unclosed elements end with their parent; a stray end tag is ignored; a cut tag at the end of the page is dropped.
    """
    elements: list[Element] = []
    runs: list[tuple[int, int, tuple, str | None]] = []
    stack: list[Element] = []
    at = 0

    def leave(depth: int, where: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            gone.close()
            if gone.tag in BLOCK:
                runs.append((where, where, (), gone.tag))

    while True:
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        if not m and (cut := page.find("<", at)) >= 0 and re.match(r"</?[a-zA-Z!][^>]*\Z", page[cut:]):
            end = cut
        if end > at:
            runs.append((at, end, tuple(stack), None))
            if stack and (words := page[at:end].split()):
                stack[-1].parts.append(" ".join(words))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].tag == tag:
                    leave(depth, at)
                    break
                if tag not in BLOCK and stack[depth].tag in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                open_ = stack[depth].tag
                if open_ == "p" or open_ == tag and tag in ("li", "dt", "dd", "tr", "td", "th"):
                    leave(depth, m.start())
                    break
                if open_ in BLOCK:
                    break
        if tag in BLOCK:
            runs.append((m.start(), m.start(), (), tag))
        if tag in VOID:
            if stack:
                stack[-1].parts.append(" ".join(m[0].split()))
            if tag == "br":
                runs.append((m.start(), m.start(), tuple(stack), "br"))
            continue
        kind = bool(stack) and stack[-1].kind or tag in FURNITURE or tag == "header" and not any(e.tag == "article" for e in stack) or "hidden" in m[3].lower().split()
        new = Element(tag, stack[-1] if stack else None, kind, "=" in m[3] and marked(m[3]), " ".join(m[0].split()))
        elements.append(new)
        if m[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            new.close()
            continue
        stack.append(new)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            leave(len(stack) - 1, at)
    leave(0, len(page))
    return elements, runs, judge(elements)


def judge(elements: list[Element]) -> bool:
    """Sets which elements are furniture and which belong to an article; whether there is an article.

    An article is one outside every furniture element. Where all of them lie in elements with a furniture name, the one with the
    most elements is the article, and those around it are not furniture.
    """
    outer = [e for e in elements if e.tag == "article" and not e.kind and not any(u.tag == "article" for u in above(e))]
    clean = [e for e in outer if not any(u.mark and u.tag not in ("html", "body", "main") for u in above(e))]
    if outer and not clean:
        sizes = {id(e): 0 for e in outer}
        for e in elements:
            for u in (e, *above(e)):
                if id(u) in sizes:
                    sizes[id(u)] += 1
        clean = [max(outer, key=lambda e: sizes[id(e)])]
    free = {id(u) for e in clean for u in (e, *above(e))}
    roots = {id(e) for e in clean}
    for e in elements:  # parents come first
        up = e.up
        e.article = bool(up and up.article) or id(e) in roots
        named = e.mark and id(e) not in free and e.tag not in ("html", "body", "main") and not (e.article and e.tag in PROSE)
        e.bad = bool(up and up.bad) or e.kind or named
    return bool(clean)


def above(e: Element) -> Iterator[Element]:
    while (e := e.up) is not None:
        yield e


def candidates(elements: list[Element], articles: bool) -> list[Element]:
    """Elements that may be template: outside an article every one that is not furniture anyway, inside only containers, and none that
    holds the article. In a page without an article paragraphs count too."""
    holds = {id(u) for e in elements if e.tag == "article" and e.article for u in (e, *above(e))} if articles else set()
    return [e for e in elements if not e.bad and id(e) not in holds and e.tag not in ("html", "body", "article", "main") and not (e.article and e.tag in PROSE) and not (e.tag in PROSE and e.tag != "p" and e.tag[0] != "h")]


def main_text(page: str, template: frozenset) -> str:
    """Blocks of the article, or of the whole page if it has none, joined by line feeds."""
    elements, runs, articles = scan(page)
    if template:
        taken = {id(e) for e in candidates(elements, articles) if e.hash in template}
        for e in elements:
            e.bad = e.bad or id(e) in taken
    blocks, now = [], []
    for start, stop, around, edge in runs:
        if edge == "br":
            now.append(" ")
        elif edge is not None:
            blocks.append("".join(now))
            now = []
        elif not any(e.bad for e in around) and (not articles or any(e.article for e in around)):
            text = page[start:stop]
            now.append(entities.unescape(text) if "&" in text else text)
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def hash_batches(piece_bytes: int):
    """Pages to the hashes of the subtrees that may be template, each page of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "html", piece_bytes):
            found: dict[tuple[int, int], list[int]] = {}
            for site, page, html in zip(*(column(table, c).to_pylist() for c in ("site", "page", "html"))):
                if (site, page) not in found:
                    elements, _, articles = scan(html)
                    found[site, page] = sorted({e.hash for e in candidates(elements, articles)})
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([p for _, p in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["site", "page", "subtrees"])

    return run


def text_batches(piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "html", piece_bytes):
            out = [main_text(page, frozenset(listed or ())) for page, listed in zip(column(table, "html").to_pylist(), column(table, "template").to_pylist())]
            yield pa.RecordBatch.from_arrays([column(table, "id"), column(table, "url"), pa.array(out, pa.string())], names=["id", "url", "text"])

    return run


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_pages: int = 5, min_share: float = 0.1, many: int = 50, piece_bytes: int = 2 << 20) -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    A subtree is template if it is on at least ``min_pages`` distinct pages of its host that are a share ``min_share`` of them, or on ``many``; rows of one
    html are one page. Null html counts as empty and gives empty text. A page whose url is null or has no host belongs to no site and only
    loses page furniture. Pages of any length are read whole; rows are kept as they come, repeated ids too; other columns are not read, and an empty table gives none.

    Counts combine map-side and are keyed by host and subtree, so a host with a third of all pages is spread; a page is joined with
    the list of its own recurring subtrees, which is no longer than the page.
    """
    scratch = Scratch(pages.sparkSession)
    url = F.col(url_column).cast("string")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    base = pages.select(F.col(id_column).cast("long").alias("id"), url.alias("url"), F.when(host != "", F.xxhash64(host)).alias("site"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html")).withColumn("page", F.xxhash64("html"))
    hashed = base.filter("site is not null").select("site", "page", "html").mapInArrow(hash_batches(piece_bytes), "site long, page long, subtrees array<long>")
    once = scratch.write(hashed.groupBy("site", "page").agg(F.first("subtrees").alias("subtrees")))
    sizes = once.groupBy("site").agg(F.count("*").alias("pages"))
    rows = once.select("site", "page", F.explode("subtrees").alias("subtree"))
    counts = rows.groupBy("site", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    common = counts.join(sizes, "site").filter((F.col("n") >= many) | (F.col("n") >= F.col("pages") * min_share)).select("site", "subtree")
    listed = rows.join(common, ["site", "subtree"]).groupBy("site", "page").agg(F.collect_list("subtree").alias("template"))
    met = base.filter("site is not null").join(listed, ["site", "page"], "left").select("id", "url", "html", "template")
    free = base.filter("site is null").select("id", "url", "html", F.lit(None).cast("array<long>").alias("template"))
    text = met.unionByName(free).mapInArrow(text_batches(piece_bytes), "id long, url string, text string")
    return text.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", F.length("text").cast("long").alias("n_chars"))
