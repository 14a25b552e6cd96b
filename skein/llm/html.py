"""Operator 9: main text of web pages, by site style trees."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from skein.plans.iterate import discard, materialize

#: Branches of a lower importance go.
LEAST_IMPORTANCE = 0.8
#: So many pages' weight has what a node's presentation tells before any page is seen.
PRIOR_PAGES = 20
#: Parts that the pages of one host are dealt to.
SALTS = 256

#: What HTML itself says of elements. These hold no text that is shown.
UNSEEN = frozenset("script style head title noscript template iframe svg canvas object audio video math textarea button select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Of these, the ones that are lines of a text and no part of a page of their own.
LINE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dt dd blockquote pre address figcaption caption tr tbody thead tfoot".split())
#: Elements and roles that are beside the main text by their meaning.
ASIDE = frozenset("nav footer aside form dialog menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id that readers' own texts stand under: each text is new, so no tree can tell them.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond|disqus)(?:$|[\s_-])", re.I)
#: Words of class and id that often mark what is repeated; they count where few pages are known.
REPEATED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|sidebar|menu|navbar|nav|breadcrumbs?|share|sharing|social|related|recommended|footer|header|masthead|widget|toolbar|pagination)(?:$|[\s_-])",
    re.I,
)
#: What presentation tells of a node: what its importance is likely to be, and what it is multiplied by.
PLAIN, MAIN, LIKELY_REPEATED, BESIDE = (0.9, 1.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.5)

#: One attribute whole, so that nothing inside a value is taken for a name.
_ATTR = re.compile(r"([^\s/=>][^\s/=>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Class words that tell how an element looks beside a part of the page, and not that it is this part.
_MODIFIER = re.compile(r"(?:has|with|without|no)[_-].*|.*[_-](?:open|opened|closed|enabled|disabled)", re.I | re.S)
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")


def attributes(text: str) -> dict[str, str]:
    """Attributes of a start tag by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(text):
        out.setdefault(name.lower(), "".join(values))
    return out


class _Tags:
    """The tags of a page in one pass: (kind, name, attributes, text before it) with kind '' for the page's end."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = True  # until one is left open to the page's end: from then on tags end at their first >
        self.ends: dict[str, re.Pattern] = {}

    def _end(self, at: int) -> int:
        """Where the tag that is open at `at` ends; -1 if it does not."""
        begin = at
        while self.quotes:
            m = _STOP.search(self.page, at)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                break
        self.quotes = False
        return self.page.find(">", begin)

    def __iter__(self) -> Iterator[tuple[str, str, str, str]]:
        page, done, at = self.page, 0, 0
        while True:
            at = page.find("<", at)
            if at < 0:
                yield "", "", "", page[done:]
                return
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                kind, name, attrs, after = "!", "", "", end + 3 if end >= 0 else len(page)
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                kind, name, attrs, after = "!", "", "", end + 3 if end >= 0 else len(page)
            elif page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                kind, name, attrs, after = "!", "", "", end + 1 if end >= 0 else len(page)
            elif m := _NAME.match(page, at + 1):
                end = self._end(m.end())
                if end < 0:  # a tag cut off at the end is no text
                    yield "", "", "", page[done:at]
                    return
                name, attrs, after = m[0].lower(), page[m.end() : end], end + 1
                kind = "/" if name[0] == "/" else "<"
                name = name.lstrip("/")
            else:
                at += 1
                continue
            yield kind, name, attrs, page[done:at]
            if kind == "<" and name in ("script", "style", "noscript", "template", "textarea", "iframe", "title"):
                if name not in self.ends:
                    self.ends[name] = re.compile(f"</{name}\\b[^>]*>", re.I)
                m = self.ends[name].search(page, after)
                after = m.end() if m else len(page)
            done = at = after


class _Open:
    """An open element."""

    __slots__ = ("tag", "path", "told", "unseen", "block", "above", "inline")

    def __init__(self, tag: str, path: int, told: tuple[float, float], unseen: bool, block: bool, above: int):
        self.tag, self.path, self.told, self.unseen, self.block = tag, path, told, unseen, block
        self.above = above  # the place of the nearest block element, itself included
        self.inline: dict[str, int] = {}  # of a block element: open inline elements in it by tag


def _style(tag: str, attrs: dict[str, str], inside: tuple[float, float]) -> tuple[str, tuple[float, float]]:
    """An element's presentation, by name and by what it tells where what holds it told `inside`."""
    role = attrs.get("role", "").lower()
    look = (attrs.get("class", "").split() or [attrs.get("id", "")])[0]
    style = f"{tag}.{look}" if look else tag
    if role:
        style += f"[{role}]"
    if inside == BESIDE:
        return style, inside
    if tag in ("article", "main") or role == "main":
        return style, MAIN
    if tag in ASIDE or role in ASIDE_ROLES or tag == "header" and inside != MAIN:
        return style, BESIDE
    words = " ".join(w for w in f"{attrs.get('class', '')} {attrs.get('id', '')}".split() if not _MODIFIER.fullmatch(w))
    if words and tag not in ("body", "html"):
        if READERS.search(words):
            return style, BESIDE
        if REPEATED.search(words):
            return style, LIKELY_REPEATED
    return style, inside


def blocks(page: str | None) -> list[tuple[int, tuple[float, float], str]]:
    """(path, what presentation tells, text) of each block of text that is shown.

    A path is a hash of the open block elements with their first class or id, and role. Lines of an
    article or main element, as paragraphs and headings, are contents of what holds them and no
    branches: a byline or heading that all articles of a host share is weighed with their texts, and stays
    with them. Elements left open end with what they stand in; a block element ends an open paragraph.
    One pass, whose time is in proportion to the page."""
    out: list[tuple[int, tuple[float, float], str]] = []
    stack = [_Open("", 0, PLAIN, False, True, 0)]
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                top = stack[stack[-1].above]
                out.append((top.path, top.told, joined))

    def close(at: int) -> None:
        while len(stack) > at:
            e = stack.pop()
            if not e.block:
                stack[e.above].inline[e.tag] -= 1
            else:
                count[e.tag] -= 1

    count: dict[str, int] = {}
    for kind, tag, attrs, before in _Tags(page or ""):
        if before and not stack[-1].unseen:
            text.append(before)
        block = tag in BLOCK
        if kind == "/":
            if block:
                flush()
                if count.get(tag):
                    at = len(stack) - 1
                    while stack[at := stack[at].above].tag != tag:
                        at -= 1
                    close(at)
            elif stack[stack[-1].above].inline.get(tag):  # an inline element does not end the block it is left open around
                at = len(stack) - 1
                while stack[at].tag != tag:
                    at -= 1
                close(at)
        elif kind == "<":
            if tag in ("br", "td", "th"):
                text.append(" ")
            if block:
                flush()
                top = stack[stack[-1].above]
                if top.tag == "p" or tag == "li" == top.tag or tag in ("dt", "dd") and top.tag in ("dt", "dd"):
                    close(stack[-1].above)
            if tag in VOID or not block and attrs.rstrip().endswith("/"):
                continue
            holder, told = stack[-1], attributes(attrs)
            unseen = holder.unseen or tag in UNSEEN or "hidden" in told or told.get("aria-hidden") == "true"
            if tag in ("script", "style", "noscript", "template", "textarea", "iframe", "title"):
                continue  # read to its end already
            style, means = _style(tag, told, holder.told)
            if block:
                path = stack[holder.above].path
                if not (tag in LINE and holder.told == means == MAIN):
                    path = xxhash.xxh3_64_intdigest(style.encode("utf-8", "surrogatepass"), seed=path)
                stack.append(_Open(tag, path, means, unseen, True, len(stack)))
                count[tag] = count.get(tag, 0) + 1
            else:
                # an inline element is no node of its own; what it tells is that of the block it is in
                stack.append(_Open(tag, holder.path, holder.told, unseen, False, holder.above))
                inline = stack[holder.above].inline
                inline[tag] = inline.get(tag, 0) + 1
    flush()
    return out


def _signed(x: int) -> int:
    return x - (1 << 63)


def _host(url: str | None) -> str:
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower() if url and "://" in url else ""


_FEATURES = "host string, path long, feature long, page long, prior double, factor double"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different text block of a page; page is a hash of its html."""
    for x in batches:
        rows = set()
        for url, page in zip(x["url"].to_pylist(), x["html"].to_pylist(), strict=True):
            copy, host = _signed(xxhash.xxh3_64_intdigest((page or "").encode("utf-8", "surrogatepass"))), _host(url)
            rows |= {(host, _signed(path), _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))), copy, *told) for path, told, text in blocks(page)}
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split(" ")[0] for c in _FEATURES.split(", ")])


def style_tree(rows: DataFrame, *site: str) -> DataFrame:
    """Importance of the nodes of style trees: (*site, path, pages, importance), from rows as _features() gives.

    The pages of a site, or of all sites if none is named, are merged into one tree whose nodes
    are paths of elements with their presentation (Yi, Liu and Li, "Eliminating noisy information
    in web pages", 2003). A node that m different pages have is weighed by its contents: a text
    that n of them have there has, spread evenly over those, an entropy of log n / log m; so a text
    that all share counts 0, a text of one page 1, and content is the mean over the different texts.
    What presentation tells counts as much as PRIOR_PAGES pages, and what stands beside the main text
    by its meaning counts by half. Copies of a page count once."""
    node = [*site, "path"]
    once = rows.select(*node, "feature", "page", "prior", "factor").distinct()
    spread = once.groupBy(*node, "feature").agg(F.count("*").alias("n"), F.max("prior").alias("prior"), F.max("factor").alias("factor"))
    m = once.select(*node, "page").distinct().groupBy(*node).agg(F.count("*").alias("pages"))
    weighed = spread.groupBy(*node, "n").agg(F.count("*").alias("texts"), F.max("prior").alias("prior"), F.max("factor").alias("factor")).join(m, node)
    entropy = F.when(F.col("pages") > 1, F.ln("n") / F.ln("pages")).otherwise(0.0)
    content = F.sum(F.col("texts") * (1 - entropy)) / F.sum("texts")
    shrunk = (F.col("pages") * content + PRIOR_PAGES * F.max("prior")) / (F.col("pages") + PRIOR_PAGES)
    return weighed.groupBy(*node, "pages").agg((F.max("factor") * shrunk).alias("importance"))


def low_branches(pages: DataFrame, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, low): the paths of each host that are of low importance in its own tree or in that of all hosts."""
    rows = materialize(pages.select("url", "html").mapInArrow(_features, _FEATURES))
    everywhere = style_tree(rows).where(F.col("importance") < least_importance).select("path")
    nodes = rows.select("host", "path").distinct().join(everywhere, "path")
    here = style_tree(rows, "host").where(F.col("importance") < least_importance).select("host", "path")
    low = materialize(nodes.select("host", "path").union(here).groupBy("host").agg(F.collect_set("path").alias("low")))  # a host's low nodes: a part of its templates
    discard(rows)
    return low


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        texts = []
        for page, low in zip(x["html"].to_pylist(), x["low"].to_pylist(), strict=True):
            gone, found = set(low or ()), blocks(page)
            kept = [text for path, _, text in found if _signed(path) not in gone]
            for least in (MAIN, PLAIN):  # a page that many others repeat whole still has a main text
                kept = kept or [text for _, told, text in found if told == least]
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([x["page_id"], x["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html).

    All blocks of all pages are weighed by style trees, one of each host and one of all hosts (see
    style_tree()); branches of low importance in either go: menus, headers, footers, adverts and notices,
    whose texts many pages share. Readers' comments, forms, menus and the like that repeat nothing
    are known by element, role or class, which halves their importance. Scripts, styles, comments
    and hidden elements are not shown and no text. Character references are decoded, white space in a
    block is one space, blocks are joined by a newline in page order.

    A page whose branches are all low, as pages of one text on a host are, keeps its main elements, or
    if it has none, what is plain by presentation.

    A host's low branches, a part of its templates, meet its pages in a join over host and a salt, so
    the pages of a common host are many tasks' work; small tables of them are broadcast by size.

    Cases: null and empty html give an empty text; a null url has the host ''; unclosed and
    crossed elements are closed by what holds them; a quote left open ends with its tag; text without
    any element is one block; few pages are judged by presentation; repeated rows each give a row;
    other columns are left aside.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    dealt = pages.select("page_id", "url", "html", host.alias("host"), salt.alias("salt"))
    low = low_branches(pages, least_importance)
    parts = dealt.select("host", "salt").distinct().join(low, "host")
    met = dealt.join(parts, ["host", "salt"], "left").select("page_id", "url", "html", "low")
    return met.mapInArrow(_extract, pages.select("page_id", "url", F.lit("").alias("text")).schema)
