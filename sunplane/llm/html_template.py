"""HTML extraction: the template that the pages of a host share is deduced from equivalence classes of tokens.

A token is an element's path of containers (tag names with class and id), or a path and the whole text of a block in it.
The tokens of one host that occur equally often on every page have equal occurrence vectors and form an equivalence
class. A class with an element (so with two tags at least) on enough pages is part of the template: its elements that
occur once a page are its frame, its texts are template text. A class is valid for pages on which its frame stands in one
order; pages of another order are an instance of their own. Classes nest by the tree of paths. All other text is in slots, and
the article is in the deepest frame element, of the classes that a page instantiates, whose slots hold the instance's data.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from sunplane.llm.common import in_batches
from sunplane.staging import staged

#: The support that a class and an instance of it need: so many pages (all of a host with fewer), and this share of the
#: host's. It bounds a template to 100 times the tokens of a page; pages of rarer layouts have those classes that they share.
LEAST_PAGES, LEAST_SHARE = 2, 0.01
#: The core is the deepest frame element whose slots hold this share of the data, the whole the one that holds all.
CORE_SHARE, WHOLE_SHARE = 0.8, 0.995
#: A host on which less than this share of the prose is data has copies of one page: there texts aren't template.
LEAST_DATA = 0.2
#: A block of which more than this share is link text is a menu's.
MOST_LINKS = 0.6

# HTML's elements by kind, and words that name what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object textarea select title svg math canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
OUTSIDE = frozenset("head nav footer aside form button menu dialog script style noscript template iframe select textarea".split())
ROLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related "
    "remark replies reply respond response responses share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
MAIN_TAGS = frozenset(["article", "main"])

PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
PAGE_TAGS = frozenset(["", "html", "body"])

#: Comments; declarations; tags with balanced quotes; other tags; a tag that the page's end cuts off.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"""
    r"""|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|</?[A-Za-z][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")




class Node:
    """An open element: its tag, its token, and whether it is outside the article, in a link, in an article or main element."""

    __slots__ = ("tag", "at", "outside", "link", "main")

    def __init__(self, tag: str, at: int, outside: bool, link: bool, main: bool):
        self.tag, self.at, self.outside, self.link, self.main = tag, at, outside, link, main


@lru_cache(1 << 14)
def _label(tag: str, attributes: str, in_main: bool) -> tuple[str, bool]:
    """The token's name (tag, classes and id without their digits) and whether its role is outside an article."""
    names: list[str] = []
    role = ""
    for m in _ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names += value.lower().split()
        elif key == "role":
            role = value.lower()
    words = {w for n in names for w in re.split(r"[^a-z]+", n) if w}
    outside = tag in OUTSIDE or role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
    if tag not in ("html", "body", "article", "main") and not words & {"with", "without", "has", "no"}:
        outside = outside or bool(words & (ROLE_WORDS - {"header", "masthead", "banner"} if in_main else ROLE_WORDS))
    return tag + "".join("." + re.sub(r"\d+", "", n) for n in sorted(set(names))), outside


class Shape:
    """What the template needs of a page. Of each element token (0 is the page itself): id, the token around it, occurrences,
    whether it is in the page's header, and outside the article; of each block that isn't outside, in page order, the facts
    (token, text hash, words, whether it is a menu's)."""

    ids: list[int]
    up: list[int]
    n: list[int]
    header: list[bool]
    outside: list[bool]
    facts: list[tuple[int, int, int, bool]]

    def texts(self) -> Counter:
        """Occurrences of each text token (id of its element, text hash)."""
        return Counter((self.ids[at], text) for at, text, _, _ in self.facts)

    def instances(self, frame: dict[int, int]) -> dict[tuple[int, int], list[int]]:
        """The page's instances of the template's classes, (class, hash of the order of its frame), with their elements in
        page order. frame: the class of each frame element's id."""
        found: dict[int, list[int]] = {}
        for at, k in enumerate(self.ids):
            if k in frame and self.n[at] == 1:
                found.setdefault(frame[k], []).append(at)
        return {(c, _hash(" ".join(str(self.ids[at]) for at in places))): places for c, places in found.items()}

    def data(self, template: set[tuple[int, int]], alike: bool) -> list[bool]:
        """Of each block whether it is data: no menu and no template text; on hosts of copies all but the header's."""
        return [not menu and (not self.header[at] if alike else (self.ids[at], text) not in template) for at, text, _, menu in self.facts]

    def under(self, core: int) -> list[bool]:
        """Of each token whether it is in the token `core`, or is it."""
        out = [False] * len(self.ids)
        for at in range(len(out)):
            out[at] = at == core or (at > 0 and out[self.up[at]])
        return out

    def row(self) -> dict:
        at, text, words, menu = zip(*self.facts) if self.facts else ((), (), (), ())
        return {"ids": self.ids, "up": self.up, "n": self.n, "header": self.header, "at": at, "text": text, "words": words, "menu": menu}

    @classmethod
    def of(cls, row: dict) -> Shape:
        out = cls()
        out.ids, out.up, out.n, out.header, out.outside = row["ids"], row["up"], row["n"], row["header"], []
        out.facts = list(zip(row["at"], row["text"], row["words"], row["menu"]))
        return out

    def depths(self) -> list[int]:
        out = [0] * len(self.ids)
        for at in range(1, len(out)):
            out[at] = out[self.up[at]] + 1
        return out


class Page(Shape):
    """A parsed page: also the tag and depth of each element token, and whether it is in an article or main element. `pieces`
    are (token, text or None where a block ends, outside, in a link) in page order; `blocks` are the slices of pieces
    of the blocks that facts tells of."""

    def __init__(self, source: str):
        self.ids, self.tags, self.up, self.depth, self.n = [0], [""], [0], [0], [1]
        self.main, self.header, self.outside = [False], [False], [False]
        self.pieces: list[tuple[int, str | None, bool, bool]] = []
        self._known: dict[tuple[int, str], int] = {}
        self._parse(source)
        self.facts, self.blocks = [], []
        begin = 0
        for k in range(len(self.pieces) + 1):
            if k == len(self.pieces) or self.pieces[k][1] is None:
                self._block(begin, k)
                begin = k + 1

    def _block(self, a: int, b: int) -> None:
        words, linked = [], 0
        for at, text, outside, link in self.pieces[a:b]:
            if not outside:
                found = text.split()
                words += found
                linked += len(found) * link
        if words:
            self.facts.append((self.pieces[a][0], _hash(" ".join(words)), len(words), linked > MOST_LINKS * len(words)))
            self.blocks.append((a, b))

    def _open(self, tag: str, label: str, around: Node, outside: bool) -> int:
        at = self._known.get((around.at, label))
        if at is None:
            at = self._known[around.at, label] = len(self.ids)
            self.ids.append(_child(self.ids[around.at], label))
            self.tags.append(tag)
            self.up.append(around.at)
            self.depth.append(self.depth[around.at] + 1)
            self.n.append(0)
            self.main.append(self.main[around.at] or tag in MAIN_TAGS)
            self.header.append((self.header[around.at] or tag == "header") and not self.main[-1] and tag != "h1")
            self.outside.append(outside)
        self.n[at] += 1
        return at

    def _parse(self, page: str) -> None:
        """Unclosed elements end with the element around them; end tags without a start are skipped; the text of scripts,
        styles and the like isn't reported."""
        stack = [Node("", 0, False, False, False)]
        at = 0
        while at < len(page):
            m = _TOKEN.search(page, at)
            if text := page[at : m.start() if m else len(page)]:
                top = stack[-1]
                self.pieces.append((top.at, html.unescape(text), top.outside, top.link))
            if not m:
                return
            at = m.end()
            slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            tag = name.lower()
            if tag not in INLINE:
                self.pieces.append((stack[-1].at, None, stack[-1].outside, False))
            if slash:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
                if k and not (tag in INLINE and any(n.tag not in INLINE for n in stack[k + 1 :])):
                    del stack[k:]
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            shut = "p" if tag in CLOSES_P else tag if tag in ("li", "option", "tr") else "dd" if tag in ("dt", "dd") else None
            for k in range(len(stack) - 1, 0, -1) if shut else ():
                if stack[k].tag == shut or (shut == "dd" and stack[k].tag == "dt"):
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE and stack[k].tag not in ("p",):
                    break
            top = stack[-1]
            label, outside = _label(tag, attributes, top.main)
            outside = top.outside or outside
            token = top.at if tag in INLINE else self._open(tag, label, top, outside)
            stack.append(Node(tag, token, outside, top.link or tag == "a", top.main or tag in MAIN_TAGS))

@lru_cache(1 << 14)
def _child(around: int, label: str) -> int:
    """The id of an element with this label in the element of the id `around`."""
    return _hash(f"{around} {label}")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


_TOKENS = pa.list_(pa.struct([("id", pa.int64()), ("text", pa.int64()), ("n", pa.int32())]))
_LONGS, _INTS, _BOOLS = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())
_SHAPE = {"ids": _LONGS, "up": _INTS, "n": _INTS, "header": _BOOLS, "at": _INTS, "text": _LONGS, "words": _INTS, "menu": _BOOLS}
_SHAPES = {"host": pa.string(), "page": pa.int64(), "tokens": _TOKENS} | _SHAPE


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))


def _ddl(types: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in from_arrow_schema(pa.schema(types.items())))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page a row: host, page, tokens that aren't outside with their occurrences (text 0: an element), its shape."""
    for batch in batches:
        rows = []
        for number, url, source in zip(*[batch.column(k).to_pylist() for k in ("page", "url", "html")]):
            page = Page(source or "")
            tokens = [(k, 0, n) for k, n, outside in zip(page.ids, page.n, page.outside) if not outside]
            rows.append((host_of(url), number, [{"id": k, "text": t, "n": n} for k, t, n in tokens + [(*key, n) for key, n in page.texts().items()]], *page.row().values()))
        yield _batch(rows, _SHAPES)


_TEMPLATE = {"host": pa.string(), "host_pages": pa.int64(), "frame": pa.list_(pa.int64()), "classes": pa.list_(pa.int32()), "owners": pa.list_(pa.int64()), "texts": pa.list_(pa.int64())}


def template_of(tokens: list[dict]) -> tuple[list[int], list[int], list[int], list[int]]:
    """The frame elements with the numbers of their classes, and the template texts with their elements. `tokens`: id, text,
    most (occurrences on a page) and the occurrence vector (pages, v1 to v4). A class without an element is no part of
    the template, so a text is part of it only if it occurs as often as some element does on every page."""
    classes: dict[tuple, list[dict]] = {}
    for t in sorted(tokens, key=lambda t: (t["pages"], t["v1"], t["v2"], t["id"], t["text"])):
        classes.setdefault((t["pages"], t["v1"], t["v2"], t["v3"], t["v4"]), []).append(t)
    valid = [members for members in classes.values() if any(t["text"] == 0 for t in members)]
    frame = [(t["id"], k) for k, members in enumerate(valid) for t in members if t["text"] == 0 and t["most"] == 1]
    texts = [(t["id"], t["text"]) for members in valid for t in members if t["text"] != 0]
    return [i for i, _ in frame], [k for _, k in frame], [i for i, _ in texts], [t for _, t in texts]


def _deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([(h, n, *template_of(t)) for h, n, t in zip(*[batch.column(k).to_pylist() for k in range(3)])], _TEMPLATE)


def frequent(pages: str | Column, host_pages: Column) -> Column:
    pages = F.col(pages) if isinstance(pages, str) else pages
    return (pages >= F.least(F.lit(LEAST_PAGES), host_pages)) & (pages >= LEAST_SHARE * host_pages)


def occurrence_hashes() -> tuple[Column, Column]:
    """Two hashes of a page and a token's occurrences on it, whose sums over pages stand for the occurrence vector."""
    return F.xxhash64("page", "n"), F.xxhash64("n", "page", F.lit(1))


def deduce_templates(shapes: DataFrame) -> DataFrame:
    """For each host of the pages' shapes its number of pages and its template (see template_of). Occurrence vectors are
    compared by sums over pages of four 32-bit hashes of page and occurrences, so a host with any share of all
    pages is counted on the map side; only tokens with support are gathered for a host."""
    sizes = shapes.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    each = shapes.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.id", "t.text", "t.n")
    low, high = (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda h: F.shiftrightunsigned(h, 32))
    one, two = occurrence_hashes()
    tokens = each.groupBy("host", "id", "text").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(low(one)).alias("v1"), F.sum(high(one)).alias("v2"), F.sum(low(two)).alias("v3"), F.sum(high(two)).alias("v4"), F.max("n").alias("most")
    )
    kept = tokens.join(sizes, "host").filter(frequent("pages", F.col("host_pages")))
    gathered = kept.groupBy("host").agg(F.max("host_pages").alias("host_pages"), F.collect_list(F.struct("id", "text", "pages", "v1", "v2", "v3", "v4", "most")).alias("tokens"))
    return gathered.mapInArrow(_deduce, _ddl(_TEMPLATE))


_SHARES = {"host": pa.string(), "alike": pa.int64(), "data": pa.int64(), "prose": pa.int64(), "class": pa.int32(), "instance": pa.int64(), "id": pa.int64(), "depth": pa.int32(), "under": pa.int64()}


def _template(row: dict) -> tuple[dict[int, int], set[tuple[int, int]]]:
    return dict(zip(row["frame"] or (), row["classes"] or ())), set(zip(row["owners"] or (), row["texts"] or ()))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page, with (alike 0) and without (1) template text, and of each frame element of its instances: the data under the element, of
    all data."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            page, (frame, template) = Shape.of(row), _template(row)
            instances, depth = page.instances(frame), page.depths()
            prose = sum(words for _, _, words, menu in page.facts if not menu)
            for alike in (0, 1):
                under = [0] * len(page.ids)
                for (at, _, words, _), data in zip(page.facts, page.data(template, bool(alike))):
                    under[at] += words * data
                for at in range(len(under) - 1, 0, -1):
                    under[page.up[at]] += under[at]
                for (c, instance), places in instances.items() if under[0] else ():
                    out += [(row["host"], alike, under[0], prose, c, instance, page.ids[at], depth[at], under[at]) for at in places if under[at]]
                if not under[0]:
                    out.append((row["host"], alike, 0, prose, None, None, 0, 0, 0))
        if out:
            yield _batch(out, _SHARES)


def choose_elements(joined: DataFrame, templates: DataFrame) -> DataFrame:
    """For each host: alike (1: its pages are copies), and for each frequent instance of a class its core and its whole, the ids of the deepest elements that
    hold CORE_SHARE and all of the instance's data, with their depths. `joined`: pages' shapes with their host's template."""
    told = staged(
        joined.mapInArrow(_shares, _ddl(_SHARES)).groupBy("host", "alike", "class", "instance", "id", "depth").agg(F.count(F.lit(1)).alias("pages"), F.sum("under").alias("under"), F.sum("data").alias("data"), F.sum("prose").alias("prose")), "shares"
    )
    page = (F.col("id") == 0) & (F.col("depth") == 0)  # each page has one such row
    hosts = told.filter(page).groupBy("host").agg(F.sum(F.when(F.col("alike") == 0, F.col("data")).otherwise(0)).alias("data"), F.sum(F.when(F.col("alike") == 0, F.col("prose")).otherwise(0)).alias("prose"))
    hosts = hosts.join(templates.select("host", "host_pages"), "host").select("host", "host_pages", ((F.col("host_pages") < 2) | (F.col("data") < LEAST_DATA * F.col("prose"))).cast("long").alias("alike"))
    deep = lambda share: F.max(F.when(F.col("under") >= share * F.col("data"), F.struct("depth", "id")))
    chosen = (
        told.join(hosts, ["host", "alike"])
        .filter(F.col("class").isNotNull() & frequent("pages", F.col("host_pages")))
        .groupBy("host", "alike", "class", "instance")
        .agg(deep(CORE_SHARE).alias("core"), deep(WHOLE_SHARE).alias("whole"))
        .filter("core is not null")
    )
    return hosts.join(chosen.groupBy("host").agg(F.collect_list(F.struct("class", "instance", "core", "whole")).alias("roles")), "host", "left").select("host", "alike", "roles")


def page_text(page: Page, frame: dict[int, int], template: set[tuple[int, int]], alike: bool, roles: list[dict]) -> str:
    """The text of the slots under the page's core, the deepest of its instances' cores; if that is no article or main
    element, without template text and menus. Of the slots around the core, in the deepest whole, those are the article's that are
    data and headings or paragraphs, or between a heading and the core. A page without a core gives the text of its article
    or main element, or else all that isn't outside."""
    mine = {(r["class"], r["instance"]): r for r in roles}
    found = [(mine[i], places) for i, places in page.instances(frame).items() if i in mine]
    place = {page.ids[at]: at for _, places in found for at in places}
    data = page.data(template, alike)
    if found:
        core = max((r["core"]["depth"], place[r["core"]["id"]]) for r, _ in found)[1]
        inside = page.under(core)
        wholes = [(r["whole"]["depth"], place[r["whole"]["id"]]) for r, _ in found if r["whole"]]
        around = [page.under(at) for _, at in sorted(wholes, reverse=True)]
        around = next((u for u in around if u[core]), inside)
        named = page.main[core]
        first = next((k for k, b in enumerate(page.facts) if inside[b[0]]), len(page.facts))
        top = next((k for k, b in enumerate(page.facts[:first]) if around[b[0]] and data[k] and page.tags[b[0]] == "h1"), first)

        def wanted(k: int, at: int, menu: bool) -> bool:
            prose = page.tags[at] in PROSE_TAGS
            if inside[at]:
                return named or data[k] or (prose and menu and page.tags[core] not in PAGE_TAGS)
            return around[at] and data[k] and (prose or page.main[at] or top <= k < first)

        if text := _joined(page, [wanted(k, b[0], b[3]) for k, b in enumerate(page.facts)]):
            return text
    return _joined(page, [page.main[b[0]] for b in page.facts]) or _joined(page, [alike or d for d in data]) or _joined(page, [True] * len(data))


def _joined(page: Page, wanted: list[bool]) -> str:
    out = []
    for want, (a, b) in zip(wanted, page.blocks):
        if want:
            out += "".join(text for _, text, outside, _ in page.pieces[a:b] if not outside).split()
    return " ".join(out)


def _fill(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [page_text(Page(r["html"] or ""), *_template(r), bool(r["alike"]), r["roles"] or []) for r in batch.drop_columns(["id"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(id_type), batch.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: the id, url and `text`, the article in the host's template.

    Character references are decoded once, white space becomes one space, blocks are joined by one space. The
    template is deduced from all pages of a host. Null and empty pages give an empty text; a null url is the
    host ''; a host of one page, or of copies of one, has no template text; a page without a core uses its own
    article or main element, or else all text outside menus and the like; repeated rows give a row each and
    count as a page each; a null id stays null; other columns are ignored; an empty table gives no rows. The
    whole page is read, whatever its length and depth.
    """
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = in_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("_host"))
    numbered = rows.select(F.xxhash64("url", "html").alias("page"), "url", "html")
    shapes = staged(numbered.mapInArrow(_shapes, _ddl(_SHAPES)), "page-shapes")
    templates = staged(deduce_templates(shapes), "templates")
    roles = staged(choose_elements(shapes.drop("page", "tokens").join(templates.drop("host_pages"), "host"), templates), "roles").withColumnRenamed("host", "_role_host")
    joined = rows.join(templates.drop("host_pages"), F.col("_host") == F.col("host"), "left")
    filled = joined.join(roles, F.col("_host") == F.col("_role_host"), "left").select("id", "url", "html", "frame", "classes", "owners", "texts", "alike", "roles")
    id_type = to_arrow_schema(rows.select("id").schema).field(0).type
    kind = pages.schema[id_col].dataType.simpleString()
    return filled.mapInArrow(_fill(id_type), f"id {kind}, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
