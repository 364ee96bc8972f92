"""Main text of web pages by tree scoring.

A page becomes a tree of its elements.  Blocks of text earn points for length and commas and pass
them to their ancestors, less with each step; an element's points are discounted by the share of
its text that stands in links.  The best element, or the ``article`` or ``main`` around it, is the container;
it, and its siblings that are not mostly links, are kept, without the parts that are never the article (menus, page
headers and footers, sidebars, notices, adverts, forms, scripts, styles, comments), which are known by tag,
role, class or id.  Directly below the body, where page furniture without a name may stand, siblings must be of
the container's kind or text of their own.  Nothing else inside the container is dropped or cut.

Defined results: a null, empty or markup-free page gives its bare text or none; broken markup
(unclosed or stray tags, quotes left open) never fails; very long pages are read whole; of
containers with equal points the first in the page is taken; repeated rows are rows of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import read_table

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = frozenset("script style noscript template textarea title iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br hr".split()
)
DROP_TAGS = frozenset("nav header footer aside form button dialog menu search fieldset head".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert banner newsletter subscribe signup popup modal overlay share sharing social related recommended masthead topbar toolbar skip".split()
)
#: Words that name reader comments, and words that name other furniture, whatever stands beside them.
COMMENT_WORDS = frozenset("comment comments commentlist commenter disqus".split())
SURE_WORDS = frozenset("sidebar navbar breadcrumb breadcrumbs pagination masthead newsletter popup modal cookie cookies gdpr advert adverts advertisement advertising sponsored".split())
#: Words beside those that make the name one of a state, or of what holds the article too.
STATE_WORDS = frozenset("open closed off no not without with has have hide hidden count enabled disabled active recipe recipes".split())
#: Words that say nothing about what a class named by them holds.
FILLER_WORDS = frozenset("message messages user users reader readers thread threads policy law info warning text area bar block bottom box button buttons center col column container content group holder home icon icons inline inner item items left line link links list main outer page panel right row section site slot small top unit widget wrap wrapper x".split())
WEAK_WORDS = frozenset("header widget meta tools tags byline".split())
KEEP_WORDS = frozenset("article content main body post entry text story".split())
#: An open element on the left ends where one on the right begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table td th ul ol dl body html article section div main".split())
ENDS_P = BLOCK - {"br", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"} | {"li", "dd", "dt"}
PARAGRAPH = frozenset("p pre td blockquote li dd div section article main figcaption body".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure ul ol dl".split())
SCORED = frozenset("article main section div body td blockquote table ul ol dl center".split())


class Node:
    __slots__ = ("chars", "drop", "kids", "link_chars", "name", "order", "parent", "score", "tag", "commas", "own")

    def __init__(self, tag: str, parent: Node | None, drop: bool, order: int, name: str = ""):
        self.tag, self.parent, self.drop, self.order, self.name = tag, parent, drop, order, name
        self.kids: list = []  # Nodes and texts
        self.score = 0.0
        self.chars = self.link_chars = self.own = self.commas = 0


def _dropped(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is never the article; ``inside``: it stands in one, whose header is its own.

    A class or id that names comments tells so, as do some other words; with most words of furniture it does only
    if all its words do: ``user-comments`` and ``related-links`` go, ``related-work`` and ``comments-open`` stay.
    A comment in program text is none of a reader.
    """
    if tag in DROP_TAGS and not (tag == "header" and inside):
        return True
    if not attrs or attrs.isspace():
        return False
    words, drop, told = set(), False, False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value) or name == "role" and value in DROP_ROLES:
            return True
        if name in ("class", "id"):
            for token in (m[2] or "").strip("\"'").split():
                own = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()))
                drop = drop or bool(own & DROP_WORDS) and own <= DROP_WORDS | FILLER_WORDS
                if not own & STATE_WORDS:
                    told = told or bool(own & COMMENT_WORDS)
                    drop = drop or bool(own & SURE_WORDS) and not own & KEEP_WORDS
                words |= own
    if tag in ("span", "code", "i", "em", "b", "a") and told:
        return False
    if tag in ("html", "body", "main") or tag == "article" and not told:
        return False
    if told:
        return True
    return drop or not inside and bool(words & WEAK_WORDS) and not words & KEEP_WORDS


def parse(page: str) -> Node:
    """The page's tree; texts are decoded."""
    root = Node("body", None, False, 0)
    stack, at, order = [root], 0, 0
    end = len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text = page[at:lt]
            stack[-1].kids.append(unescape(text) if "&" in text else text)
        if lt == end:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        close, tag, attrs = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in SCOPE:
                    break
            stack[-1].kids.append(None if tag in BLOCK else "")
            continue
        if tag in RAW and not attrs.endswith("/"):
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else (end if tag in ("script", "style") else at)
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            stack[-1].kids.append(None if tag in BLOCK else "")
            continue
        if tag in ENDS_P or tag in CLOSES:
            gone = (CLOSES.get(tag) or set()) | ({"p"} if tag in ENDS_P else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in gone:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        order += 1
        node = Node(tag, stack[-1], stack[-1].drop or _dropped(tag, attrs, any(n.tag in ("article", "main") for n in stack)), order, attrs)
        stack[-1].kids.append(node)
        if not attrs.endswith("/"):
            stack.append(node)
    return root


def _measure(root: Node) -> list[Node]:
    """Text, link text, own text and commas of each kept node; the nodes in page order."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.drop:
            continue
        nodes.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    nodes.sort(key=lambda n: n.order)
    for node in reversed(nodes):
        for k in node.kids:
            if isinstance(k, str):
                n = len(k.strip())
                node.chars += n
                node.own += n
                node.commas += k.count(",")
        if node.tag == "a":
            node.link_chars = node.chars
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            if node.tag not in BLOCK and node.tag != "a":
                up.own += node.own
                up.commas += node.commas
    return nodes


def best_container(root: Node) -> tuple[list[Node], float]:
    """The nodes to keep, in page order, and the best score."""
    nodes = _measure(root)
    for node in nodes:
        if node.tag in PARAGRAPH and node.own:
            points = (1.0 if node.own >= 25 else 0.0) + node.commas + min(node.own / 100, 3.0)
            if node.chars:
                points *= 1 - min(1.0, node.link_chars / node.chars)
            up, step = node if node.own and node.tag in SCORED else node.parent, 1
            while up is not None and step <= 4:
                if up.tag in SCORED:
                    up.score += points / step
                up, step = up.parent, step + 1
    ranked = [n for n in nodes if n.tag in SCORED and n.score > 0]
    for n in ranked:
        n.score *= 1 - n.link_chars / max(1, n.chars)
    if not ranked:
        whole = [n for n in nodes if n.tag in ("article", "main") and n.chars]
        return ([whole[0]] if whole else [root]), 0.0
    best = max(ranked, key=lambda n: (n.score, -n.order))
    up = best  # the article or main part a section stands in is the container
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    score = max(best.score, 1e-9)
    if best.parent is None:
        return [best], score
    return _with_siblings(best, score), score


def _with_siblings(best: Node, score: float) -> list:
    """The container, what stands beside it and belongs to it, and the titles before them; in page order."""
    up, keep = best.parent, []
    top = up.parent is None
    for k in up.kids:
        if not isinstance(k, Node):
            if not top:
                keep.append(k)
            continue
        dense = k.link_chars / max(1, k.chars)
        if k is best:
            keep.append(k)
        elif k.drop or not k.chars or dense >= 0.5:
            continue
        elif not top or k.tag == best.tag and (k.name.strip() == best.name.strip() or k.tag == "article" or k.score >= 0.2 * score):
            keep.append(k)
        elif dense < 0.25 and (k.tag in TEXT_TAGS and (k.chars >= 25 or k.tag[0] == "h" or k.tag == "figure") or k.tag == "section" and k.own >= 80):
            keep.append(k)
    while up.parent is not None:
        before = []
        for k in up.parent.kids:
            if k is up:
                break
            if isinstance(k, Node) and k.tag == "h1" and not k.drop:
                before.append(k)
        keep, up = before + keep, up.parent
    return keep


def text_of(nodes: list[Node]) -> str:
    """Text of ``nodes``: blocks apart, white space as one space."""
    out: list[str] = []
    todo: list = list(reversed(nodes))
    while todo:
        k = todo.pop()
        if k is None:
            out.append(" ")
        elif isinstance(k, str):
            out.append(k)
        elif not k.drop:
            if k.tag in BLOCK:
                out.append(" ")
                todo.append(None)
            todo.extend(reversed(k.kids))
    return " ".join("".join(out).split())


def main_text(page: str | None) -> tuple[str, float]:
    """Main text of a page and the score of its container."""
    if not page:
        return "", 0.0
    nodes, score = best_container(parse(page))
    return text_of(nodes), score


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and score for each row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t for t, _ in made], pa.string()), pa.array([len(t) for t, _ in made], pa.int64()), pa.array([s for _, s in made], pa.float64())],
                names=["page_id", "url", "text", "n_chars", "score"],
            )

    cols = [F.col(c).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("html", "string"))]
    return pages.select(*cols).mapInArrow(run, "page_id long, url string, text string, n_chars long, score double")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_main_text(read_table(spark, sf_dir, "pages"))
