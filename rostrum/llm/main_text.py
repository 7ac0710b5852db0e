"""Main text of web pages, with site templates removed.

Every element subtree gets a hash from its tag, class, id, text and the hashes of its
children. Spark counts in how many different pages of a host each subtree occurs; those
that recur across many are site furniture and are deleted, together with elements whose
tag, role or class names say that they are not the article. Paragraphs and headings
inside an article element are its text and stay, however often an article is repeated.
"""

from __future__ import annotations

import html as html_std
import re
from collections.abc import Callable

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import add_columns, as_text, map_batches, register, stored, table

# Fixed values of HTML: elements without content, with raw text, that part blocks of text, and that a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = frozenset("table ul ol dl select td th body html article section div main nav aside header footer form".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption b i em strong a span br code".split())
# Elements, roles and class names that are not part of an article.
DROP_TAGS = RAW | frozenset("head nav footer aside form button select option label input dialog svg canvas object embed audio video map menu".split())
DROP_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog form menu menubar toolbar".split())
DROP_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
                       "notice notices notification alert sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead footer comment comments "
                       "commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe subscription popup modal "
                       "overlay widget toolbar pagination pager skip".split())

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    __slots__ = ("article", "digest", "drop", "marks", "parts", "tag", "text_size")

    def __init__(self, tag: str, drop: bool, article: bool, marks: str):
        self.tag, self.drop, self.article, self.marks = tag, drop, article, marks
        self.parts: list = []  # texts and elements in order
        self.digest = xxhash.xxh64(f"{tag}\0{marks}")
        self.text_size = 0


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_std.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def unwanted(tag: str, own: dict[str, str], inside_article: bool) -> bool:
    if tag in DROP_TAGS or tag == "header" and not inside_article:
        return True
    if not own:
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in DROP_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    if tag in ("body", "html", "main"):
        return False
    return any(w.lower() in DROP_NAMES for key in ("class", "id") for w in NAME.findall(own.get(key, "")))


def parsed(text: str) -> Element:
    """The element tree; end tags that are missing are supplied, stray ones ignored."""
    root = Element("html", False, False, "")
    stack = [root]

    def say(s: str) -> None:
        top = stack[-1]
        if s:
            top.parts.append(s)
            words = s.split()
            if words:
                top.digest.update(" ".join(words))
                top.text_size += sum(map(len, words))

    def close() -> None:
        done = stack.pop()
        stack[-1].digest.update(b"\1" + done.digest.digest())
        stack[-1].text_size += done.text_size

    at, n = 0, len(text)
    while at < n:
        m = MARKUP.search(text, at)
        if not m:
            say(html_std.unescape(text[at:]))
            break
        if m.start() > at:
            say(html_std.unescape(text[at:m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        close()
                    break
            continue
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        ended = ENDS.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if ended:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    while len(stack) > i:
                        close()
                    break
                if stack[i].tag in HOLDS:
                    break
        own = attributes(m[3] or m[6] or "")
        inside = stack[-1].article
        e = Element(tag, unwanted(tag, own, inside), inside or tag in ("article", "main"), f"{own.get('class', '')}\0{own.get('id', '')}")
        stack[-1].parts.append(e)
        if tag in VOID or tag not in ("script", "style") and (m[3] or m[6] or "").endswith("/") and tag not in BLOCK:
            stack[-1].digest.update(b"\2" + e.digest.digest())
            continue
        stack.append(e)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            say(text[at:end.start()] if end else text[at:])
            at = end.end() if end else n
            close()
    while len(stack) > 1:
        close()
    return root


def walk(root: Element, visit: Callable[[Element], bool]) -> None:
    """Pre-order over elements; children are skipped where ``visit`` says no."""
    stack = [root]
    while stack:
        e = stack.pop()
        if visit(e):
            stack.extend(p for p in reversed(e.parts) if isinstance(p, Element))


def countable(e: Element) -> bool:
    """Whether a recurring subtree may go: all outside an article, and inside it all but its paragraphs and itself."""
    return bool(e.text_size) and e.tag not in ("html", "body", "main", "article") and not (e.article and e.tag in PROSE)


def subtree_hashes(root: Element) -> list[int]:
    found: set[int] = set()

    def visit(e: Element) -> bool:
        if e.drop:
            return False
        if countable(e):
            found.add(e.digest.intdigest() - (1 << 63))
        return True

    walk(root, visit)
    return list(found)


def main_text(root: Element, templates: frozenset[int]) -> str:
    """Blocks of the articles, else of the main element, else of the page, without what is deleted."""

    def gone(e: Element) -> bool:
        return e.drop or bool(templates) and countable(e) and e.digest.intdigest() - (1 << 63) in templates

    chosen: dict[str, list[Element]] = {"article": [], "main": []}

    def visit(e: Element) -> bool:
        if gone(e):
            return False
        if e.tag in chosen:
            chosen[e.tag].append(e)
        return e.tag != "article"

    walk(root, visit)
    starts = chosen["article"] or chosen["main"] or [root]
    if not chosen["article"] and chosen["main"]:
        starts = starts[:1] if len(starts) == 1 else [e for e in starts if not any(e in o.parts for o in starts)]
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = "".join(line).split()
        if words:
            blocks.append(" ".join(words))
        line.clear()

    for start in starts:
        stack: list = [start]
        while stack:
            p = stack.pop()
            if p is None:
                flush()
            elif isinstance(p, str):
                line.append(p)
            elif gone(p):
                line.append(" ")
            else:
                if p.tag in BLOCK:
                    flush()
                    stack.append(None)
                elif p.tag == "br":
                    line.append(" ")
                stack.extend(reversed(p.parts))
        flush()
    return "\n".join(blocks)


def host_column(url: str):
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def site_templates(pages: DataFrame, min_pages: int = 5, min_share: float = 0.1, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per host the hashes of subtrees on at least ``min_pages`` different pages and ``min_share`` of its different pages.

    Pages with the same html count once, so copies make no template. A host's list has at most
    (subtrees per page / ``min_share``) entries.
    """

    def subtrees(batches):
        for b in batches:
            hosts, page, tree = [], [], []
            for host, h in zip(b.column(0).to_pylist(), as_text(b.column(1))):
                for x in subtree_hashes(parsed(h)):
                    hosts.append(host)
                    tree.append(x)
                    page.append(xxhash.xxh64_intdigest(h) - (1 << 63))
            yield hosts, page, tree

    seen = map_batches(pages.select(host_column(url_col).alias("host"), html_col), subtrees, "host string, page long, tree long")
    counts = seen.distinct().groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sizes = (pages.select(host_column(url_col).alias("host"), F.xxhash64(html_col).alias("page")).distinct()
             .groupBy("host").agg(F.count("*").alias("pages")))
    return (counts.join(sizes, "host").where(F.col("n") >= min_share * F.col("pages"))
            .groupBy("host").agg(F.collect_list("tree").alias("templates")))


def extract(pages: DataFrame, templates: DataFrame | None = None, url_col: str = "url", html_col: str = "html",
            keep: list[str] | None = None) -> DataFrame:
    """Append ``text`` and ``n_chars`` (code points).

    Null and empty html give the empty text; a null url is of the host without name. Rows are
    judged alone, copies alike; columns with the names of results are replaced.
    """
    names = pages.columns if keep is None else keep
    df = pages.select(*dict.fromkeys([*names, html_col]), host_column(url_col).alias("_mt_host"))
    if templates is None:
        df = df.withColumn("_mt_trees", F.lit(None).cast("array<long>"))
    else:  # the planner sees the stored size and broadcasts the table if that is small
        df = df.join(templates.select(F.col("host").alias("_mt_host"), F.col("templates").alias("_mt_trees")), "_mt_host", "left")

    def run(html, trees):
        texts = [main_text(parsed(h), frozenset(t or ())) for h, t in zip(as_text(html), trees.to_pylist())]
        return [texts, [len(t) for t in texts]]

    return add_columns(df, [html_col, "_mt_trees"], run, "text string, n_chars long", keep=names)


@register("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, stored(site_templates(pages)), keep=["page_id", "url"])
