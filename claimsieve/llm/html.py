"""Main text of web pages: site templates, found by counting element subtrees per host, are taken out."""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import pieces, ragged
from claimsieve.staging import Workspace

# Element names of HTML, and words that sites use for what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SKIPPED = frozenset(
    "head script style noscript template iframe object applet svg canvas audio video map nav footer aside form button select textarea "
    "input option datalist dialog menu title noembed noframes".split()
)
CONTAINERS = frozenset("div section ul ol dl table nav header footer aside form menu details figure".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
SKIPPED_WORDS = re.compile(
    r"ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|newsletter|subscri\w+|popup|modal|overlay|sidebar|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|footer|header|masthead|comments?|commentlist|disqus|repl(?:y|ies)|respond|shar(?:e|ing)|social|"
    r"related|recommended|widgets?|toolbar|pagination|pager|login|signin|signup|search|skip-link",
    re.I,
)
#: The same inside an article or main: only what nothing but such a block is called, whole, and only for GROUPS.
SKIPPED_BLOCKS = re.compile(
    r"(?:\w+[_-]+)*?(?:ads?|advert(?:s|isements?)?)|(?:cookie|gdpr|consent)[_-]+\w+|newsletter(?:[_-]+\w+)?|sidebar|share[_-]+(?:buttons|bar|links)|social[_-]+\w+|"
    r"comments|comment(?:[_-]*)(?:list|area|section)|disqus(?:[_-]+\w+)?|respond"
)
GROUPS = frozenset("div section".split())
#: Parts of a class that say what a wrapper has or lacks, not what it is.
NEGATIONS = frozenset("no not non none has have with without hide hides".split())
#: What an open element closes on opening, and where the search for it stops.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"),
    "thead": ("thead", "tbody", "tr", "td", "th"),
    "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
BARRIERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "p": ("table", "td", "th", "button", "object", "caption")}

_TOKEN = re.compile(r"<!--(.*?)(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)", re.S)
# html.unescape fails on a decimal reference of more than 4300 digits; of eight digits without zeros in front, none is a character.
_ZEROS, _DIGITS = re.compile(r"&#0+(?=[0-9])"), re.compile(r"(&#[0-9]{8})[0-9]+")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


@dataclass
class _Element:
    tag: str
    skipped: bool
    named: int
    in_article: bool
    in_main: bool
    sum: object
    first: int = 0


@dataclass
class Page:
    """``blocks`` of (text, in article, in main); ``trees`` of (hash, first block, block after the last) of the container subtrees."""

    blocks: list[tuple[str, bool, bool]]
    trees: list[tuple[int, int, int]]


def _decoded(text: str) -> str:
    """Character references decoded, as a browser does."""
    return html.unescape(_DIGITS.sub(r"\1", _ZEROS.sub("&#", text)) if "&#" in text else text)


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), _decoded(value.strip("\"'")))
    return found


def _is_skipped(tag: str, attributes: dict[str, str], in_content: bool) -> bool:
    if tag in SKIPPED or tag == "header" and not in_content:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    if attributes.get("role", "").lower() in SKIPPED_ROLES:
        return True
    return False


def _is_named(tag: str, attributes: dict[str, str], in_content: bool) -> bool:
    """Whether a class or the id says that an element is not the article.

    Outside of an article or main, its first or last part is enough, if it is one of SKIPPED_WORDS. Inside, where headings, paragraphs and
    sections are called after what they are about, the whole name must be one of SKIPPED_BLOCKS, of a group; all else is left to the counted templates.
    """
    if tag in ("html", "body", "article", "main") or tag in INLINE or in_content and tag not in GROUPS:
        return False
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = [x for x in re.split("[_-]+", token) if x]
        if not parts or NEGATIONS.intersection(parts):
            continue
        if in_content:
            if SKIPPED_BLOCKS.fullmatch(token):
                return True
        elif any(SKIPPED_WORDS.fullmatch(x) for x in (token, parts[0], parts[-1])):
            return True
    return False


def _dropped(blocks: list[tuple[str, bool, bool]], inside: list[int], around: list[int], mains: set[int], within: set[int]) -> list[bool]:
    """Which named elements go with all they hold. ``inside``: the innermost named element of each block; ``around``: of each element;
    ``mains``: those around a main element; ``within``: those inside an article or main.

    One that holds the main element is a wrapper and stays, as does one with more than half of the page's text, unless it stands
    outside of an article or main that has text, such as comments marked as articles. If no text of an
    article or main is then left, that which holds most of it stays, and so on inwards.
    """
    n = len(around)
    chars, content = [0] * n, [0] * n
    for (text, article, main), name in zip(blocks, inside):
        if name >= 0:
            chars[name] += len(text)
            content[name] += len(text) * (article or main)
    wraps = [k in mains for k in range(n)]
    for k in range(n - 1, -1, -1):  # the elements inside first
        if around[k] >= 0:
            chars[around[k]] += chars[k]
            content[around[k]] += content[k]
            wraps[around[k]] |= wraps[k]
    total, written = sum(len(x[0]) for x in blocks), sum(len(x[0]) for x in blocks if x[1] or x[2])
    stays = [wraps[k] or 2 * chars[k] > total and (k in within or content[k] == written) for k in range(n)]
    while True:
        gone = [False] * n
        outer = []
        for k in range(n):
            above = around[k] >= 0 and gone[around[k]]
            gone[k] = above or not stays[k]
            if gone[k] and not above and content[k]:
                outer.append(k)
        free = any((block[1] or block[2]) and (name < 0 or not gone[name]) for block, name in zip(blocks, inside))
        if free or not outer:
            return gone
        stays[max(outer, key=lambda k: content[k])] = True


def parse(page: str) -> Page:
    """Text blocks and container subtrees of a page.

    Elements are closed as in HTML where their end tags are left out; an end tag without its element is ignored,
    and at the end of a page cut short all open elements end. A subtree's hash covers tags, classes
    and text of all it holds. Text in elements that never hold the article is left out of the blocks, not of the hashes.
    What elements named by their class or id hold is judged at the page's end, see :func:`_dropped`.
    """
    blocks: list[tuple[str, bool, bool]] = []
    trees: list[tuple[int, int, int]] = []
    inside: list[int] = []
    around: list[int] = []
    mains: set[int] = set()
    within: set[int] = set()
    root = _Element("", False, -1, False, False, xxhash.xxh3_64())
    stack = [root]
    text: list[str] = []

    def flush() -> None:
        top = stack[-1]
        joined = " ".join("".join(text).split())
        text.clear()
        if joined and not top.skipped:
            blocks.append((joined, top.in_article, top.in_main))
            inside.append(top.named)

    def close() -> None:
        element = stack.pop()
        digest = element.sum.intdigest()
        stack[-1].sum.update(digest.to_bytes(8, "little"))
        if element.tag in CONTAINERS:
            trees.append((digest - (1 << 63), element.first, len(blocks)))

    def close_to(names: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                flush()
                while len(stack) > k:
                    close()
                return
            if stack[k].tag in barriers:
                return

    def add(raw: str) -> None:
        if raw:
            data = _decoded(raw) if "&" in raw else raw
            text.append(data)
            if not data.isspace():
                stack[-1].sum.update(" ".join(data.split()).encode("utf-8", "surrogatepass"))

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        tag = (found[3] or "").lower()
        if not tag or not found[5]:  # comment, declaration, or a tag cut off by the page's end
            continue
        if found[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag not in INLINE:
                        flush()
                    while len(stack) > k:
                        if stack[-1].tag not in INLINE:
                            flush()
                        close()
                    break
            else:
                if tag in ("p", "br"):
                    flush()
            continue
        if tag in CLOSES_P:
            close_to(("p",), BARRIERS["p"])
        if tag in CLOSES:
            close_to(CLOSES[tag], BARRIERS.get(tag, ("table",)))
        if tag not in INLINE:
            flush()
        attributes = _attributes(found[4]) if found[4].strip(" /") else {}
        top = stack[-1]
        role = attributes.get("role", "").lower()
        skipped = top.skipped or _is_skipped(tag, attributes, top.in_article or top.in_main)
        article = top.in_article or tag == "article" or role == "article"
        main = top.in_main or tag == "main" or role == "main"
        if skipped and not top.skipped and tag in INLINE:
            flush()
        if tag in VOID:
            top.sum.update(tag.encode())
            continue
        named = top.named
        if main and not top.in_main and not skipped:
            mains.add(named)
        if not skipped and _is_named(tag, attributes, top.in_article or top.in_main):
            named = len(around)
            around.append(top.named)
            if top.in_article or top.in_main:
                within.add(named)
        element = _Element(tag, skipped, named, article, main, xxhash.xxh3_64(f"{tag} {attributes.get('class', '')}".encode("utf-8", "surrogatepass")), len(blocks))
        stack.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            raw = page[at : end.start()] if end else page[at:]
            if tag in ("title", "textarea"):
                add(raw)
            element.sum.update(raw.encode("utf-8", "surrogatepass"))
            at = end.end() if end else len(page)
            flush()
            close()
    flush()
    while len(stack) > 1:
        close()
    if around:
        gone = _dropped(blocks, inside, around, mains, within)
        keep = [name < 0 or not gone[name] for name in inside]
        before = [0, *itertools.accumulate(map(int, keep))]  # of booleans, the first sum would be one
        blocks = [block for block, kept in zip(blocks, keep) if kept]
        trees = [(tree, before[a], before[b]) for tree, a, b in trees]
    return Page(blocks, trees)


def host(url: Column) -> Column:
    """The host of a url in lower case, without user, port and ``www.``; empty if there is none."""
    name = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(name, r"^www\.", "")


_PARSED = (
    "__id {id}, __url string, __host string, __print long, __seen array<long>, __blocks array<struct<text: string, article: boolean, main: boolean>>, "
    "__trees array<struct<tree: long, first: int, after: int>>"
)


def main_text(
    pages: DataFrame,
    workspace: Workspace,
    page_id: str = "page_id",
    url: str = "url",
    page: str = "html",
    min_pages: int = 8,
) -> DataFrame:
    """One row for each page: ``page_id, url, text, n_chars``.

    Each page is parsed once into text blocks and the hashes of its container subtrees, each with the range of blocks it holds. The hashes
    are counted per host over different pages, folded within tasks first, and a subtree on at least ``min_pages`` pages of a host, however large, is a
    template of that host: its blocks go, unless they are more than half of the
    page's text. Of what is left, only the blocks in an article stay if there are any, else those in a main element, else all.
    What a page's elements say is something other than the article (menus, headers, footers,
    asides, forms, scripts) goes by itself, as does outside of an article or main what a class or id calls so, but no element that holds the main element, the only
    articles or more than half of the page's text, nor by a class that says what a wrapper has or lacks (``no-sidebar``); inside, a name counts
    only if it is that of adverts, notices, sharing or comments as a whole and of a ``div`` or ``section``. Blocks are
    joined by a space, with references decoded and white space folded.
    Only pages whose blocks lie in containers are joined with the templates of their host.
    Cases: null html is empty; a page without url or host belongs to the host ""; copies of a page count
    as one; repeated rows give repeated rows; an empty table gives an empty table; other columns are not looked at. A page takes
    memory in proportion to its length, however deep its elements lie.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    schema = _PARSED.format(id=kind)
    rows = pages.select(
        F.col(page_id).alias("__id"), F.col(url).cast("string").alias("__url"), host(F.col(url).cast("string")).alias("__host"), F.coalesce(F.col(page), F.lit("")).alias("__page")
    )
    parsed = workspace.stage(rows.mapInArrow(_parsed, schema).withColumn("__row", F.monotonically_increasing_id()), "pages")

    # one row for each different page of a host, then one count for each subtree of a host
    different = parsed.groupBy("__host", "__print").agg(F.first("__seen").alias("__seen"))
    seen = different.select("__host", F.explode("__seen").alias("__tree")).groupBy("__host", "__tree").agg(F.count("*").alias("__n"))
    templates = workspace.stage(seen.where(F.col("__n") >= min_pages).select("__host", "__tree"), "templates")

    some = F.size("__trees") > 0
    trees = parsed.where(some).select("__row", "__host", F.explode(F.array_distinct(F.col("__trees.tree"))).alias("__tree"))
    hit = trees.join(templates, ["__host", "__tree"]).groupBy("__row").agg(F.collect_set("__tree").alias("__hit"))
    marked = parsed.where(some).join(hit, "__row", "left").unionByName(parsed.where(~some), allowMissingColumns=True)
    chars = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))
    held = lambda t: F.slice("__blocks", t["first"] + 1, t["after"] - t["first"])
    small = lambda t: F.array_contains("__hit", t["tree"]) & (chars(held(t)) * 2 <= chars(F.col("__blocks")))
    marked = marked.withColumn("__gone", F.filter("__trees", small))
    inside = lambda k: F.exists("__gone", lambda t: (t["first"] <= k) & (k < t["after"]))
    marked = marked.withColumn("__left", F.when(F.size("__gone") > 0, F.filter("__blocks", lambda b, k: ~inside(k))).otherwise(F.col("__blocks")))
    of = lambda place: F.filter("__left", lambda b: b[place])
    kept = F.when(F.exists("__left", lambda b: b["article"]), of("article")).when(F.exists("__left", lambda b: b["main"]), of("main")).otherwise(F.col("__left"))
    out = marked.withColumn("__text", F.array_join(F.transform(kept, lambda b: b["text"]), " "))
    return out.select(F.col("__id").alias("page_id"), F.col("__url").alias("url"), F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "__page"):
        pages = [parse(x) for x in batch.column("__page").to_pylist()]
        different = [sorted({tree for tree, _, _ in page.trees}) for page in pages]
        prints = [xxhash.xxh3_64_intdigest("\0".join(b[0] for b in page.blocks).encode("utf-8", "surrogatepass")) - (1 << 63) for page in pages]
        # a subtree without text has nothing to give up
        trees = [[{"tree": tree, "first": a, "after": b} for tree, a, b in page.trees if a < b] for page in pages]
        blocks = [[{"text": text, "article": article, "main": main} for text, article, main in page.blocks] for page in pages]
        columns = [
            *(batch.column(x) for x in ("__id", "__url", "__host")),
            pa.array(prints, pa.int64()),
            ragged(np.array([x for some in different for x in some], dtype=np.int64), np.array([len(x) for x in different]), pa.int64()),
            pa.array(blocks, pa.list_(pa.struct([("text", pa.string()), ("article", pa.bool_()), ("main", pa.bool_())]))),
            pa.array(trees, pa.list_(pa.struct([("tree", pa.int64()), ("first", pa.int32()), ("after", pa.int32())]))),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["__id", "__url", "__host", "__print", "__seen", "__blocks", "__trees"])
