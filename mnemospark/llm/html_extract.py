"""Main text of web pages by tag-path ratios.

Each text node of a page hangs on a path of tags from the root.  Per path the length of its
text and its punctuation are aggregated over its nodes: navigation has many nodes of little,
even text, articles have nodes of much and uneven text.  The mean length, the mean punctuation
and the spread of the lengths are fused to one value per path, smoothed along the page, and
averaged per path again; paths over a threshold, six tenths of what a character of the page
has on average (four tenths is what a node without a value of its own has between two content
nodes), are content paths.  Boilerplate that markup itself declares (a footer, a form, a
sidebar, a class of advertisement) counts in the values but is never a content path; within an
article a block that is only named like boilerplate is one if its ratios are that of content.

Content paths select the nodes: those on them, and those of the sections that hold them, so a
heading or a last short paragraph, whose own path has little text, stays with its article, and
a block beside it that has no content path goes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, small_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
UNFINISHED = re.compile(r"<[/!a-zA-Z]")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")

# fixed values of HTML: elements without an end tag, elements whose content is no markup,
# elements that end an open paragraph, elements that do not break a block of text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# those of formulas
INLINE |= frozenset("math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = frozenset("table td th ul ol dl select article section div body html main aside nav footer header form".split())
# elements whose text is not part of the page that a reader sees, or belongs to a control
UNSEEN = frozenset("head title script style noscript button select option textarea input iframe object svg canvas template noembed noframes xmp audio video datalist annotation annotation-xml".split())
# elements that declare what is not the article
BESIDE = frozenset("nav footer aside form dialog menu search".split())
# words that declare it where they are the noun of a class, id or role
NOT_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "pagination pager footer sidebar aside widget related recommended share sharing social cookie cookies consent gdpr notice notices alert disclaimer popup modal "
    "overlay newsletter subscribe subscription signup login comment comments commentlist respond replies disqus contentinfo complementary search form masthead topbar toolbar skip "
    "subnav topnav sidenav leftnav rightnav mainmenu submenu adsbygoogle notification notifications announcement".split()
)
#: Those that mean nothing else, even within an article and whatever the ratios say.
NEVER_CONTENT = frozenset("ad ads adsbygoogle advert adverts advertisement adsense comments commentlist disqus replies sidebar cookie cookies newsletter navbar breadcrumb breadcrumbs pagination".split())
#: Words that follow the noun of a name and say only that it is a box of some kind.
BOXES = frozenset("area bar block body box button buttons col column container content full group header holder inner item items left link links list module outer panel placeholder post posts region right row section slot stories text title top bottom unit view wrap wrapper".split())
#: Words in a class name that say what a block has or lacks, not what it is.
ABOUT = frozenset("has with no without open closed".split())
#: Within these, names mark up code or figures.
QUOTED = frozenset("pre code figure math blockquote".split())
SECTIONS = frozenset("article main section div body html center".split())
ARTICLES = frozenset(("article", "main"))
#: Elements nested deeper than this become siblings, as in browsers.
DEEPEST = 512


class Element:
    __slots__ = ("tag", "parent", "unseen", "beside", "claimed", "path", "depth", "within", "quoted", "section", "holds")

    def __init__(self, tag: str, parent: Element | None, unseen: bool, beside: bool, claimed: bool, path: str) -> None:
        #: beside: boilerplate by declaration; claimed: by a name that ratios may overrule.
        self.tag, self.parent, self.unseen, self.beside, self.claimed, self.path = tag, parent, unseen, beside, claimed, path
        self.depth = parent.depth + 1 if parent else 0
        #: Whether an article is around it, and whether something is that quotes.
        self.within = parent is not None and (parent.within or parent.tag in ARTICLES)
        self.quoted = parent is not None and (parent.quoted or parent.tag in QUOTED)
        #: The innermost section around, itself included; whether it holds a node of a content path.
        self.section, self.holds = self if parent is None or tag in SECTIONS and not self.quoted else parent.section, False


def _noun(name: str) -> str:
    """What a class, id or role says its block is: the last word but for words of boxes, as in
    ``cookie-notice``, ``ad-container`` and ``related-posts``; a ``share-price`` is no sharing."""
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    if not ABOUT.isdisjoint(parts):
        return ""
    while len(parts) > 1 and parts[-1] in BOXES and parts[-1] not in NOT_CONTENT:
        parts.pop()
    return parts[-1] if parts else ""


def _marks(attributes: str) -> tuple[str, bool, set[str]]:
    """Class, id and role of a start tag for its path; whether it is hidden; the nouns of its names."""
    names, hidden, nouns = [], False, set()
    for match in ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), (match[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            names += value.split()
            nouns.update(map(_noun, value.split()))
    return ".".join(names), hidden, nouns


def nodes_of(page: str, trust_names: bool = True) -> list[tuple[Element, str, int]]:
    """Text nodes in page order: the element each is in, its text, and the number of its block.

    ``trust_names``: class, id and role may declare a block boilerplate, unless it is an article or
    quotes something.  Within an article most names only claim so, and ratios decide; names of
    inline elements never count, since a sentence goes on around them."""
    root = Element("", None, False, False, False, "")
    paths: dict[str, str] = {}  # each path of a page is held once
    at, nodes, block, pos = root, [], 0, 0

    def text(upto: int) -> None:
        if upto > pos and (piece := page[pos:upto]) and not at.unseen:
            nodes.append((at, html.unescape(piece) if "&" in piece else piece, block))

    def close(tags: tuple[str, ...], scoped: bool) -> Element:
        """The parent of the innermost open element of these tags, else where we are."""
        x = at
        while x.parent is not None:
            if x.tag in tags:
                return x.parent
            if scoped and x.tag in SCOPES:
                break
            x = x.parent
        return at

    match = TOKEN.search(page)
    while match:
        text(match.start())
        pos = match.end()
        tag = (match[2] or "").lower()
        if tag:
            if tag not in INLINE:
                block += 1
            if match[1]:
                if tag not in VOID:
                    at = close((tag,), False)
            else:
                if tag in CLOSES_P:
                    at = close(("p",), True)
                if tag in SAME_CLOSES:
                    at = close(SAME_CLOSES[tag], tag not in ("tbody", "tfoot", "tr", "td", "th"))
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
                    pos = end.end() if end else len(page)
                elif tag not in VOID and not (match[3] or "").endswith("/"):
                    names, hidden, nouns = _marks(match[3]) if match[3] and tag not in ("html", "body") else ("", False, set())
                    within, claimed = at.within or at.tag in ARTICLES, at.claimed
                    beside = at.beside or tag in BESIDE or tag == "header" and not within
                    quoted = at.quoted or at.tag in QUOTED
                    if trust_names and not quoted and tag not in INLINE and tag not in ARTICLES and tag not in QUOTED:
                        said = not nouns.isdisjoint(NOT_CONTENT) or "header" in nouns and not within
                        beside |= said and not within or not nouns.isdisjoint(NEVER_CONTENT)
                        claimed |= said and within
                    parent = at if at.depth < DEEPEST else at.parent
                    path = parent.path
                    if tag not in INLINE or tag == "a":  # inline marks are not part of a path
                        path = f"{path}/{tag}{'.' + names if names else ''}"
                    at = Element(tag, parent, at.unseen or hidden or tag in UNSEEN, beside, claimed, paths.setdefault(path, path))
        match = TOKEN.search(page, pos)
    cut = page.rfind("<", pos)
    text(cut if cut >= 0 and UNFINISHED.match(page, cut) else len(page))
    return nodes


def _ancestors(x: Element | None) -> Iterator[Element]:
    while x is not None:
        yield x
        x = x.parent


def path_values(paths: list[str], texts: list[str], beside: list[bool], claimed: list[bool], smooth: tuple[float, ...] = (0.2, 0.6, 0.2)) -> tuple[dict[str, float], float]:
    """The value of each path, and the threshold of the page.

    ``paths``, ``texts``, ``beside`` (declared boilerplate), ``claimed`` (said to be by a name that
    may mislead): the nodes in page order.  Lengths are counted without white space.  Declared
    boilerplate has its part in smoothing and in the threshold, but the value of its paths is
    fused to zero; so is that of claimed paths that are under the threshold before smoothing.
    """
    names, of = np.unique(paths, return_inverse=True)
    chars = np.array([len("".join(t.split())) for t in texts], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for t in texts], float)
    nodes = np.bincount(of)
    mean = np.bincount(of, weights=chars) / nodes
    spread = np.sqrt(np.bincount(of, weights=(chars - mean[of]) ** 2) / nodes)
    fused = np.sqrt(mean * (1 + np.bincount(of, weights=marks) / nodes) * (1 + spread))
    smoothed = np.convolve(np.pad(fused[of], len(smooth) // 2, mode="edge"), smooth, mode="valid")
    values = np.bincount(of, weights=smoothed) / nodes
    threshold = 0.6 * float((values[of] * chars).sum() / chars.sum())
    values[np.bincount(of, weights=np.array(beside, float)) > 0] = 0
    values[(np.bincount(of, weights=np.array(claimed, float)) > 0) & (fused < threshold)] = 0
    return dict(zip(names.tolist(), values.tolist(), strict=True)), threshold


def main_text(page: str) -> str:
    """The article of a page as one line of text; empty if there is none.

    Where names leave no text at all, they are not trusted: the page may call its whole body a
    sidebar.
    """
    return _content(nodes_of(page)) or _content(nodes_of(page, False))


def _content(found: list[tuple[Element, str, int]]) -> str:
    solid = [(x, t) for x, t, _ in found if not t.isspace()]
    if all(x.beside for x, _ in solid):
        return ""
    values, threshold = path_values([x.path for x, _ in solid], [t for _, t in solid], [x.beside for x, _ in solid], [x.claimed for x, _ in solid])
    content = {p for p, v in values.items() if v >= threshold} or {max(sorted(values), key=values.get)}
    chosen = [x for x, _ in solid if x.path in content]
    common = chosen[0].section  # the innermost section that holds all of them
    for x in chosen:
        for y in _ancestors(x):
            if y.holds:
                break
            y.holds = True
        common = _common(common, x.section)
    inside = set()
    parts, last = [], None
    for x, t, b in found:
        if x.path not in content and (x.beside or x.claimed):
            continue
        section = x.section
        if id(section) not in inside:
            if not (section.holds and any(y is common for y in _ancestors(section))):
                continue
            inside.add(id(section))
        if last is not None and b != last:
            parts.append(" ")
        parts.append(t)
        last = b
    return " ".join("".join(parts).split())


def _common(x: Element, y: Element) -> Element:
    """The innermost section that holds both sections."""
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent.section
        else:
            y = y.parent.section
    return x


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    Character references are decoded, white space within a block becomes one space, blocks are
    joined by one space in page order.  A null or empty page, a page without text and a page of
    markup only give an empty text; a page without any tags is its own text.  Rows are handled
    one by one, so repeated rows repeat in the result.  A page is read whole whatever its length;
    elements nested deeper than 512 (``DEEPEST``) count as siblings at that depth.  Of paths with
    equal values all are content or none; extra columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(raw.decode("utf-8", "replace")) for raw in raw_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
