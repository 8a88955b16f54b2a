"""Main text of web pages by equivalence-class template deduction.

Tags (with their path) and text blocks are a page's tokens. A token's occurrence vector is how
often it occurs on each page of its host. Tokens of one vector, on enough pages, make an
equivalence class; a class is valid on a page if its tokens come there in one order, over and
over, and classes whose spans nest make the host's template. Text that the template doesn't
hold fills its slots, and the slots outside menus, notices and the like are the main text; an
article or main element tells which of them on the pages that have one.

Vectors aren't gathered: a vector's random projection onto two numbers a page is a sum, so
equal vectors are found by aggregation, whatever the number of a host's pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import for_python, saved, small

#: A token must be on this share of a host's pages, and on this many, to be a class's.
SUPPORT, PAGES, TOKENS = 0.5, 3, 3
#: Tokens of all templates up to which they are broadcast (8 bytes each); beyond, pages are joined.
BROADCAST_TOKENS = 2_000_000
#: Parts that each host's pages are dealt to where they are joined to templates.
SALTS = 32

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
# Elements of HTML and words of class and id names, by what becomes of them.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
INLINE = frozenset(["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "meter", "output", "progress", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br", "input", "picture", "source"])
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROPPED = frozenset(["script", "style", "noscript", "template", "head", "title", "nav", "menu", "header", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "dialog", "noembed", "noframes", "datalist", "fieldset"])
DROPPED_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"])
DROPPED_NAMES = frozenset(["ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsors", "sponsored", "promo", "promos", "promotion", "banner", "nav", "navbar", "navigation", "menu", "menus", "submenu", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "topbar", "footer", "sidebar", "aside", "widget", "widgets", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "paywall", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "recommendations", "skip", "toolbar"])
WHOLE = frozenset(["html", "body", "main", "article"])
SOFT = frozenset(["form", "fieldset"])
WITHOUT = frozenset(["has", "no", "with", "without", "not", "is", "hide", "show", "toggle", "open", "closed", "enabled", "disabled"])
PARTS_OF = frozenset(["area", "bar", "block", "body", "bottom", "box", "button", "container", "content", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "meta", "outer", "panel", "primary", "right", "row", "secondary", "section", "slot", "text", "thread", "title", "top", "unit", "widget", "wrap", "wrapper"])
MAIN = frozenset(["article", "main"])


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def apart_name(name: str) -> bool:
    """Whether a class or id names a menu, notice and so on.

    Its last word does, or its first with words for parts after it: "site-nav", "ad-slot", but
    not "content-with-sidebar", "has-nav", "form-group" or "search-results".
    """
    parts = [w for w in re.split(r"[_\-]+", name) if w and not w.isdigit()]
    if not parts or any(w in WITHOUT for w in parts[:-1]):
        return False
    return parts[-1] in DROPPED_NAMES or (parts[0] in DROPPED_NAMES and all(w in PARTS_OF for w in parts[1:]))


def names(attributes: str) -> tuple[list[str], bool, bool]:
    """The words of an element's class and id; whether one sets it apart; whether other attributes do."""
    words, named, apart = [], False, False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            words += re.split(r"[\s_\-]+", value)
            named |= any(map(apart_name, value.split()))
        elif key == "role":
            apart |= value in DROPPED_ROLES
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            apart = True
        elif key == "style":
            apart |= "display:none" in value.replace(" ", "")
    return [w for w in words if w], named, apart


class Page:
    """A page's tokens in order, and its text blocks.

    tokens: 64-bit hashes. blocks: (text, dropped, main, token's place) of each block of text;
    ``dropped`` is 2 if it stands in a menu, notice and so on by its element or role, 1 if only
    by a class, an id or a form around it, ``main`` if it stands in an article. An article or
    main element inside a form or a named element isn't dropped with it.
    """

    def __init__(self, source: str | None):
        self.tokens: list[int] = []
        self.blocks: list[tuple[str, int, bool, int]] = []
        self._held: list[str] = []
        #: (tag, path, dropped, main) of each open element.
        self._open: list[tuple[str, str, int, bool]] = [("", "", 0, False)]
        source, at = source or "", 0
        while at < len(source):
            m = MARKUP.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self._held.append(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW and not m[3].endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else len(source)
                self._end(tag)
        if at < len(source):
            self._held.append(source[at:])
        self._flush()

    def _flush(self) -> None:
        if not self._held:
            return
        text = SPACE.sub(" ", entities.unescape("".join(self._held))).strip()
        self._held.clear()
        if text:
            _, path, dropped, main = self._open[-1]
            self.blocks.append((text, dropped, main, len(self.tokens)))
            self.tokens.append(self._hash(f"{path} {text}"))

    @staticmethod
    def _hash(token: str) -> int:
        return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) >> 1

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._held.append(" ")
        words, named, apart = names(attributes) if attributes.strip() else ([], False, False)
        if tag in INLINE:
            named = any(w in DROPPED_NAMES for w in re.split(r"[\s\"'=]+", attributes.lower())) if named else False
            if tag in VOID or not (apart or (named and not any(t in ("pre", "code") for t, *_ in self._open))):
                if tag not in VOID:
                    self._open.append((tag, *self._open[-1][1:]))
                return
            self._flush()
            self._push(tag, words, 2 if apart else 1)
            return
        self._flush()
        self._close_implied(tag)
        self._push(tag, words, 0 if tag in WHOLE else 2 if apart else int(named))
        if tag in VOID:
            self._open.pop()

    def _push(self, tag: str, words: list[str], apart: int) -> None:
        _, path, dropped, main = self._open[-1]
        path = f"{path}/{tag}" + "".join(f".{w}" for w in words if not w.isdigit())
        if tag in MAIN and dropped == 1:
            dropped = 0
        dropped = max(dropped, apart, 1 if tag in SOFT else 2 if tag in DROPPED else 0)
        self.tokens.append(self._hash(f"{path}<"))
        self._open.append((tag, path, dropped, main or tag in MAIN))

    def _close_implied(self, tag: str) -> None:
        if any(t == "p" for t, *_ in self._open[1:]) and tag not in RAW:
            for i in range(len(self._open) - 1, 0, -1):
                if self._open[i][0] == "p":
                    del self._open[i:]
                    break
                if self._open[i][0] not in INLINE:
                    break
        for i in range(len(self._open) - 1, 0, -1):
            t = self._open[i][0]
            if tag in CLOSED_BY_SAME and (t == tag or (tag in ("dt", "dd") and t in ("dt", "dd")) or (tag in ("td", "th") and t in ("td", "th"))):
                del self._open[i:]
                return
            if t in CLOSED_BY_SAME.get(tag, ()) or tag not in CLOSED_BY_SAME:
                return

    def _end(self, tag: str) -> None:
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] == tag:
                if tag not in INLINE or any(t not in INLINE for t, *_ in self._open[i:]) or self._open[i][2] != self._open[i - 1][2]:
                    self._flush()
                    self.tokens.append(self._hash(f"{self._open[i][1]}>"))
                del self._open[i:]
                return
            if tag in INLINE and self._open[i][0] not in INLINE:
                return


def template(tokens: list[int], classes: list[list[int]]) -> set[int]:
    """Places of a page's tokens that its template holds, from its host's classes.

    A class, its tokens in order, is valid if the page has them in that order, over and over.
    Valid classes, the widest first, join the template unless their span crosses, rather than
    nests in, a gap of a class that is in.
    """
    where: dict[int, int] = {t: c for c, ts in enumerate(classes) for t in ts}
    found: dict[int, list[int]] = {}
    for at, t in enumerate(tokens):
        if (c := where.get(t)) is not None:
            found.setdefault(c, []).append(at)
    valid = []
    for c, places in found.items():
        n = len(classes[c])
        if len(places) % n == 0 and all(tokens[at] == classes[c][i % n] for i, at in enumerate(places)):
            valid.append((places[-1] - places[0], [places[i : i + n] for i in range(0, len(places), n)]))
    held: set[int] = set()
    spans: list[tuple[int, int]] = []
    for _, tuples in sorted(valid, key=lambda x: (-x[0], x[1])):
        own = [(t[0], t[-1]) for t in tuples]
        if all(b < x or y < a or (x <= a and b <= y) for a, b in own for x, y in spans):
            spans += own
            held.update(p for t in tuples for p in t)
    return held


def extract(source: str | None, classes: list[list[int]]) -> str:
    """The main text: blocks in page order, two line ends between.

    Slots, the text that the template doesn't hold, outside menus, notices, comments and so on.
    An article or main element is evidence of where the main text is: if the page has one, only
    its slots count, and if the template holds all of its text (all of a host's pages are
    alike), that text is the main text. If a form or a named element holds all of a page's text
    that no menu or the like does, it isn't set apart.
    """
    page = Page(source)
    held = template(page.tokens, classes) if classes else set()
    least = min((b[1] for b in page.blocks if b[1] < 2), default=0)  # a page all in a form or a named element has its text there
    blocks = [b for b in page.blocks if b[1] <= least]
    if any(b[2] for b in blocks):
        blocks = [b for b in blocks if b[2]]
        if all(b[3] in held for b in blocks):
            held = set()
    return "\n\n".join(text for text, _, _, at in blocks if at not in held)


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, n_pages, total, v1, v2, pos: sums over pages; token -1 counts a host's pages.

    v1 and v2 are the vector's projections: occurrences on a page x two random numbers of it.
    """
    for_python(pages.sparkSession)
    schema = pa.schema([("host", pa.string()), ("token", pa.int64()), ("n_pages", pa.int64()), ("total", pa.int64()), ("v1", pa.int64()), ("v2", pa.int64()), ("pos", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sums: dict[tuple[str, int], list] = {}
            for page_id, url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                tokens, of = Page(source.as_py()).tokens, host(url)
                r = xxhash.xxh64_intdigest(f"{page_id} {url}".encode("utf-8", "surrogatepass"))
                first = {t: i for i, t in reversed(list(enumerate(tokens)))}
                for t, n in (*Counter(tokens).items(), (-1, 1)):
                    s = sums.setdefault((of, t), [0, 0, 0, 0, 0.0])
                    s[0] += 1
                    s[1] += n
                    s[2] += n * (r >> 34)
                    s[3] += n * (r & 0x3FFFFFFF)
                    s[4] += first.get(t, 0)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), *(pa.array([s[i] for s in sums.values()], schema.field(i + 2).type) for i in range(5))], schema=schema)

    seen = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "host string, token long, n_pages long, total long, v1 long, v2 long, pos double")
    return seen.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("n_pages", "total", "v1", "v2", "pos")))


def templates(pages: DataFrame, support: float = SUPPORT, least_pages: int = PAGES, least_tokens: int = TOKENS) -> DataFrame:
    """host, classes: a host's equivalence classes, each its tokens in order of mean first place.

    A class is large (tokens) and frequent (pages). What is gathered of a host are tokens on at
    least ``support`` of its pages, so not more than a page's tokens / support.
    """
    sums = saved(occurrences(pages), "html-occurrences")
    hosts = sums.filter("token = -1").select("host", F.col("n_pages").alias("pages"))
    frequent = sums.filter((F.col("token") >= 0) & (F.col("n_pages") >= least_pages)).join(hosts, "host").filter(F.col("n_pages") >= support * F.col("pages"))
    token = F.struct((F.col("pos") / F.col("n_pages")).alias("at"), "token")
    classes = frequent.groupBy("host", "n_pages", "total", "v1", "v2").agg(F.sort_array(F.collect_list(token)).alias("ts")).filter(F.size("ts") >= least_tokens)
    return classes.groupBy("host").agg(F.collect_list(F.col("ts.token")).alias("classes"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html.

    Character references are decoded; white space in a block becomes one space. Null or empty
    html gives empty text; a very long page is read whole, by one task. A page whose host isn't known, or has few pages, has no template.
    Repeated rows give repeated results; an empty table gives an empty result; other columns
    are ignored. Templates are broadcast only up to BROADCAST_TOKENS; beyond that, pages and
    templates are joined, each host dealt to SALTS parts.
    """
    spark = pages.sparkSession
    for_python(spark)
    found = saved(templates(pages), "html-templates")
    size = found.agg(F.sum(F.aggregate("classes", F.lit(0), lambda a, c: a + F.size(c)))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = "page_id long, url string, text string, n_chars long"

    def batch(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if size <= BROADCAST_TOKENS:
        shipped = spark.sparkContext.broadcast({r.host: r.classes for r in found.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small(batches):
                yield batch(b, [extract(h.as_py(), shipped.value.get(host(u), [])) for u, h in zip(b.column(1).to_pylist(), b.column(2), strict=True)])

        return rows.mapInArrow(run, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield batch(b, [extract(h.as_py(), c.as_py() or []) for h, c in zip(b.column(2), b.column(3), strict=True)])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host(u) for u in b.column(1).to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])

    hosted = rows.mapInArrow(placed, "page_id long, url string, html string, host string")
    salted = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    dealt = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(dealt, ["host", "salt"], "left").select("page_id", "url", "html", "classes").mapInArrow(joined, schema)
