"""HTML extraction by equivalence-class template deduction.

Pages of a host are filled in from a template. Its tokens (tags and words, told apart by the tags
around them) stand on every page equally often, so they share one *occurrence vector*: the counts
over the pages of the host. Tokens with the same vector form an equivalence class.

1. Per page the tokens are counted. Per host and token a fingerprint of the occurrence vector, the sum over
   pages of count times a hash of the page, is one mergeable number: no host is gathered.
2. Tokens with the same fingerprint that stand on at least ``SUPPORT`` of the host's pages are a class. A class
   is valid when its tokens come in the same order, with nothing of it interleaved, on every page.
3. Valid classes have to nest: one of which a round is open when a class around it goes on is no class. What lies between two
   tokens of a nested class is a slot, named by the token before it. On every page the pieces of text fall into slots.
4. A slot has the role of the template tags around it, the one it has on most pages of the host: article, outside (menus,
   headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) or neither.
5. The text of a page is what fills its slots of the article, or without any those that are not outside. Elements that a page
   has inside a slot and that are not of the template, such as an advert amid the article, have their role by themselves.
   Words of the template fill no slot and go, outside an article.

Each page is parsed once; its tokens, pieces and elements with a role are written, and all steps read those.

A host with too few pages has no template to learn; its pages are one slot each, with roles from the page's own tags.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraflow.functions.scale import materialize
from agoraflow.llm.common import pick

#: Pages a host needs before a template is learned from it.
LEAST_PAGES = 8
#: Share of a host's pages a class has to stand on.
SUPPORT = 0.9

# Element names of HTML, by what they mean here.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "object", "math", "xmp"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
OUTSIDE = {
    "nav", "menu", "footer", "aside", "form", "button", "select", "dialog", "head", "script", "style", "noscript",
    "template", "textarea", "title", "iframe", "svg", "canvas", "object", "input", "label", "search", "audio", "video",
    "map", "math",
}
#: Words of class, id and role that name what is not the article.
OUTSIDE_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb",
    "breadcrumbs", "combx", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "disqus", "footer", "form", "gdpr", "hidden", "login", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "related",
    "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget", "widgets",
}
ARTICLE = {"article", "main"}
#: A header outside the article is the page's; inside it holds the title.
HEADER_NAMES = {"header", "masthead", "topbar"}
CONTENT_NAMES = {"article", "content", "entry", "post", "story"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)


#: Roles of an element for what stands in it, as bits: outside by tag, outside by name or as a header, article.
BY_TAG, BY_NAME, INSIDE = 1, 2, 4


@lru_cache(4096)
def _shape(tag: str, token: str) -> tuple[str, int, bool]:
    """Signature, role and whether it is a header, of an element by its start tag. Numbers in names tell pages apart and are no part of a signature."""
    attributes = _attributes(token)
    names = set(re.split(r"[\s_-]+", " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower()))
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    article = tag in ARTICLE or bool(names & ARTICLE)
    # names on the page or the article as a whole say what it has, not what it is
    by_name = tag not in ("html", "body", "article", "main") and bool(names & OUTSIDE_NAMES)
    header = tag == "header" or tag not in ("html", "body") and bool(names & HEADER_NAMES) and not names & CONTENT_NAMES
    sign = tag + "." + " ".join(sorted(n for n in names if n and not n.isdigit())) + ("!" if hidden else "")
    return sign, BY_TAG * (tag in OUTSIDE or hidden) | BY_NAME * by_name | INSIDE * article, header


class Element:
    """An open element: its number on the page, tag, a hash of the signatures from the root down to it, role, and whether an article is around or it is one."""

    __slots__ = ("number", "tag", "path", "role", "inside")

    def __init__(self, number: int, tag: str, token: str, parent: Element | None):
        sign, role, header = _shape(tag, token)
        self.number = number
        self.tag = tag
        self.path = xxhash.xxh64_intdigest(sign, parent.path if parent else 0)
        around = parent is not None and parent.inside
        self.role = role | BY_NAME if header and not around else role
        self.inside = around or role & INSIDE > 0


def _attributes(tag: str) -> dict[str, str]:
    inner = tag[1:-1].strip("/")
    _, _, rest = inner.partition(inner.split(None, 1)[0]) if inner.split() else ("", "", "")
    found = {}
    for name, value in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


def parse(page: str):
    """Events of a page in order: ("open" | "close", element, path) and ("text", text, path).

    The path is the tuple of the elements around. Elements whose end tag may be left out are closed
    as browsers do; raw elements hide all up to their end tag.
    """
    stack: list[Element] = []
    position, size, number = 0, len(page), 0
    while position < size:
        match = _TOKEN.match(page, position)
        token, position = match[0], match.end()
        if token[0] != "<" or token == "<":
            yield "text", html.unescape(token), stack
            continue
        name = _NAME.match(token)
        if name is None:
            continue  # comments, doctype, processing instructions
        tag = name[1].lower()
        if token.startswith("</"):
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if at is not None:
                while len(stack) > at:
                    yield "close", stack[-1], stack
                    stack.pop()
            elif tag in BLOCKS or tag == "br":
                yield "break", tag, stack
            continue
        if tag in VOID:
            yield "break", tag, stack
            continue
        for closes in _closed_by(tag, stack):
            while stack and stack[-1] is not closes:
                yield "close", stack[-1], stack
                stack.pop()
            yield "close", stack[-1], stack
            stack.pop()
        element = Element(number, tag, token, stack[-1] if stack else None)
        number += 1
        stack.append(element)
        yield "open", element, stack
        if tag in RAW and not token.endswith("/>"):
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, position)
            position = end.end() if end else size
            yield "close", element, stack
            stack.pop()
        elif token.endswith("/>") and tag in RAW:
            stack.pop()
    while stack:
        yield "close", stack[-1], stack
        stack.pop()


def _closed_by(tag: str, stack: list[Element]) -> list[Element]:
    """The open element that a start tag ends: p by a block, li by li, and so on."""
    if tag in BLOCKS and tag not in ("html", "body", "head"):
        limit = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
                 "option": ("select",)}.get(tag, ())
        same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,) if limit else ())
        for element in reversed(stack):
            if element.tag in limit:
                break
            if element.tag in same:
                return [element]
            if element.tag == "p" and not same:
                return [element]
            if element.tag in BLOCKS and not limit:
                break
    if tag == "body":
        return [e for e in stack if e.tag == "head"][:1]
    return []


def read(page: str | None):
    """(tokens, is word) and (at, texts) and (opens, closes, roles) of a page, in order.

    A token is a hash, told apart by the elements around it; words of an article are no tokens, they are its own on however
    many pages they stand. ``at`` is how many tokens come before a piece of text, -1 for a space that any element may leave
    and for the end of a block, whose text is None. An element with a role spans from its token in ``opens`` to that in ``closes``.
    An element that its name puts outside counts as inside after all when an article stands in it.
    """
    tokens: list[int] = []
    words: list[bool] = []
    at: list[int] = []
    texts: list[str | None] = []
    spans: dict[int, list[int]] = {}
    around_article: set[int] = set()
    digest = xxhash.xxh64_intdigest
    for kind, value, stack in parse(page or ""):
        if kind == "text":
            at.append(len(tokens))
            texts.append(value)
            if not (stack and stack[-1].inside):
                path = stack[-1].path if stack else 0
                found = [digest(w, path) >> 1 for w in value.split()]
                tokens += found
                words += [True] * len(found)
            continue
        if kind == "break":
            tag = value
        else:
            tag = value.tag
            if kind == "open":
                if value.role:
                    spans[value.number] = [len(tokens), len(tokens), value.role]
                if value.role & INSIDE:
                    around_article.update(e.number for e in stack[:-1])
                tokens.append(value.path >> 1)
            else:
                if value.role:
                    spans[value.number][1] = len(tokens)
                tokens.append(digest("/", value.path) >> 1)
            words.append(False)
        if tag in BLOCKS:
            if texts and texts[-1] is not None:
                at.append(-1)
                texts.append(None)
        elif kind == "break":
            at.append(-1)
            texts.append(" ")
    for number in around_article & spans.keys():
        spans[number][2] &= ~BY_NAME
    return (tokens, words), (at, texts), tuple(zip(*spans.values())) or ((), (), ())


def tokens_of(page: str) -> list[tuple[int, bool]]:
    """(hash, is word) of the tokens of a page; a token is told apart by the elements around it."""
    return list(zip(*read(page)[0]))


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pick(pages, page_id=id_col, url=url_col, html=html_col)


def parsed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, weight, and what ``read`` finds on each page. Written, so that no page is parsed twice.

    ``host`` is null without a page or a usable URL; the hash of the page, ``weight``, weighs its counts.
    """

    def run(batches):
        kinds = [pa.list_(k) for k in (pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())]
        for batch in batches:
            html_texts = batch.column(3).to_pylist()
            found = [sum(read(page), ()) for page in html_texts]
            weights = [None if page is None else xxhash.xxh64_intdigest(page) >> 24 for page in html_texts]
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64()), *columns], names=names)

    rows = _rows(pages, id_col, url_col, html_col)
    host = F.when(F.col("html").isNotNull(), _host_column("url"))
    names = ["page_id", "url", "host", "weight", "tokens", "is_word", "at", "texts", "opens", "closes", "roles"]
    kind = pages.schema[id_col].dataType.simpleString()
    return materialize(
        rows.select("page_id", "url", host.alias("host"), "html").mapInArrow(
            run,
            f"page_id {kind}, url string, host string, weight long, tokens array<long>, is_word array<boolean>, "
            "at array<int>, texts array<string>, opens array<int>, closes array<int>, roles array<int>",
        )
    )


def page_tokens(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, weight, tokens, is_word: the tokens of each page of a host in order."""
    return parsed_pages(pages, id_col, url_col, html_col).filter("host is not null").select("host", "weight", "tokens", "is_word")


def occurrence_classes(parsed: DataFrame) -> DataFrame:
    """host, token, vector, is_word: the tokens of each host that stand on ``SUPPORT`` of its pages or more.

    ``parsed`` comes from ``parsed_pages``, without the pages of no host. ``vector`` is the fingerprint of the occurrence vector; tokens of a host that share it are a
    class. Only counts and fingerprints are shuffled, combined before: a host with a third of all pages is as cheap as its tokens.
    """

    def run(batches):
        for batch in batches:
            hosts, tokens, parts, words = [], [], [], []
            given = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3))
            for host, weight, found, kinds in given:
                weight = np.uint64(weight)
                found = found.values.to_numpy()
                value, last, times = np.unique(found[::-1], return_index=True, return_counts=True)
                is_word = kinds.values.to_numpy(zero_copy_only=False)[::-1][last]
                # token 0 stands for the page itself
                hosts += [host] * (len(value) + 1)
                tokens += [0, *value.tolist()]
                parts += [int(weight), *(times.astype(np.uint64) * weight).astype(np.int64).tolist()]
                words += [False, *is_word.tolist()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip((hosts, tokens, parts, words), kinds)],
                names=["host", "token", "part", "is_word"],
            )

    counted = (
        parsed.select("host", "weight", "tokens", "is_word")
        .mapInArrow(run, "host string, token long, part long, is_word boolean")
        .groupBy("host", "token")
        .agg(
            F.sum(F.col("part").cast("decimal(20, 0)")).alias("vector"),
            F.count("*").alias("on_pages"),
            F.max("is_word").alias("is_word"),
        )
    )
    counted = materialize(counted.filter(f"token = 0 or on_pages >= {LEAST_PAGES}"))
    sizes = counted.filter(f"token = 0 and on_pages >= {LEAST_PAGES}").select("host", F.col("on_pages").alias("pages"))
    return (
        counted.filter("token != 0")
        .join(sizes, "host")
        .filter(F.col("on_pages") >= SUPPORT * F.col("pages"))
        .select("host", "token", F.xxhash64("vector").alias("vector"), "is_word")
    )


def valid_classes(parsed: DataFrame) -> DataFrame:
    """host, class: the tokens of each valid class in their order.

    A class has two tokens or more. It is valid when every page has its tokens as rounds of one and the same
    order, and on all pages this order agrees.
    """
    found = materialize(occurrence_classes(parsed))
    # at most as many tokens as a page of the host has
    by_host = found.groupBy("host").agg(F.collect_list("token").alias("found"), F.collect_list("vector").alias("vectors"))

    def orders(batches):
        for batch in batches:
            hosts, vectors, orders = [], [], []
            for host, placed, tokens, classes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                class_of = dict(zip(tokens, classes))
                sequences: dict[int, list[int]] = {}
                for token in placed:
                    if token in class_of:
                        sequences.setdefault(class_of[token], []).append(token)
                for vector, seen in sequences.items():
                    size = len(set(seen))
                    regular = size > 1 and len(seen) % size == 0 and seen == seen[:size] * (len(seen) // size)
                    hosts.append(host)
                    vectors.append(vector)
                    orders.append(seen[:size] if regular else [])
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip((hosts, vectors, orders), kinds)], names=["host", "vector", "order"]
            )

    return (
        parsed.select("host", "tokens")
        .join(by_host, "host")
        .select("host", "tokens", "found", "vectors")
        .mapInArrow(orders, "host string, vector long, order array<long>")
        .groupBy("host", "vector")
        .agg(F.min("order").alias("low"), F.max("order").alias("high"))
        .filter("low = high and size(low) > 0")
        .select("host", F.col("low").alias("class"))
    )


def _spots(classes: list[list[int]]) -> dict[int, tuple[int, int, bool]]:
    """token -> (number of its class, place in it, whether it is the last)."""
    return {t: (c, i, i == len(tokens) - 1) for c, tokens in enumerate(classes) for i, t in enumerate(tokens)}


def fill(tokens: list[int], spots: dict[int, tuple[int, int, bool]]) -> tuple[np.ndarray, set[int]]:
    """The slot at each place between the tokens of a page, 0 outside all classes, and the classes that do not nest there.

    A slot is named by the token before it in the innermost class of which a round is open.
    """
    slots = np.zeros(len(tokens) + 1, dtype=np.int64)
    open_rounds: list[list[int]] = []  # class, its last token so far
    crossed: set[int] = set()
    begin = 0
    for i, token in enumerate(tokens):
        spot = spots.get(token)
        if spot is None:
            continue
        slots[begin : i + 1] = open_rounds[-1][1] if open_rounds else 0
        begin = i + 1
        number, place, last = spot
        if place == 0:
            open_rounds.append([number, token])
            continue
        if all(c != number for c, _ in open_rounds):
            continue  # closed by a class that it crosses
        while open_rounds[-1][0] != number:
            crossed.add(open_rounds.pop()[0])
        if last:
            open_rounds.pop()
        else:
            open_rounds[-1][1] = token
    slots[begin:] = open_rounds[-1][1] if open_rounds else 0
    return slots, crossed


def nested_classes(parsed: DataFrame, valid: DataFrame) -> DataFrame:
    """host, classes: the classes of ``valid``, of which no page has a round open when a class around it goes on.

    Of two that cross the later one is taken out; of the rest no two cross on any page.
    """
    by_host = valid.groupBy("host").agg(F.collect_list("class").alias("classes"))

    def crossings(batches):
        for batch in batches:
            hosts, firsts = [], []
            for host, tokens, classes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for number in fill(tokens, _spots(classes))[1]:
                    hosts.append(host)
                    firsts.append(classes[number][0])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(firsts, pa.int64())], names=["host", "first"])

    crossed = (
        parsed.select("host", "tokens").join(by_host, "host").select("host", "tokens", "classes")
        .mapInArrow(crossings, "host string, first long").distinct()
    )
    nested = valid.withColumn("first", F.col("class")[0]).join(crossed, ["host", "first"], "left_anti")
    return nested.groupBy("host").agg(F.collect_list("class").alias("classes"))


def roles_at(opens, closes, roles, size: int) -> np.ndarray:
    """The roles of the elements around each place between ``size`` tokens, as bits."""
    opens, closes, roles = (np.asarray(x, dtype=np.int64) for x in (opens, closes, roles))
    bits = np.zeros(size + 1, dtype=np.int64)
    for bit in (BY_TAG, BY_NAME, INSIDE):
        has = roles & bit > 0
        if has.any():
            depth = np.bincount(opens[has] + 1, minlength=size + 1) - np.bincount(closes[has] + 1, minlength=size + 1)
            bits |= (np.cumsum(depth) > 0) * bit
    return bits


def _apart(tokens, opens, closes, roles, spots):
    """Roles at each place by the elements of the template, and by the others."""
    own = np.array([tokens[i] not in spots for i in opens], dtype=bool)
    parts = [np.asarray(x, dtype=np.int64) for x in (opens, closes, roles)]
    return (roles_at(*(x[take] for x in parts), len(tokens)) for take in (~own, own))


def templates(parsed: DataFrame) -> DataFrame:
    """host, classes, slots, slot_roles: the nested classes of each host of ``LEAST_PAGES`` pages or more, and the role of each slot that
    has text on a page: what the template elements around it say on most of the pages, the smaller bits of a tie.

    ``parsed`` comes from ``parsed_pages``.
    """
    parsed = parsed.filter("host is not null")
    valid = materialize(valid_classes(parsed))
    nested = materialize(nested_classes(parsed, valid))

    def run(batches):
        for batch in batches:
            hosts, slots, bits = [], [], []
            for host, tokens, at, opens, closes, roles, classes in zip(*(batch.column(i).to_pylist() for i in range(7))):
                spots = _spots(classes)
                slot, _ = fill(tokens, spots)
                around, _ = _apart(tokens, opens, closes, roles, spots)
                places = np.unique([i for i in at if i >= 0]).astype(np.int64)
                for name, role in set(zip(slot[places].tolist(), around[places].tolist())):
                    hosts.append(host)
                    slots.append(name)
                    bits.append(role)
            kinds = (pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((hosts, slots, bits), kinds)], names=["host", "slot", "bits"])

    seen = (
        parsed.select("host", "tokens", "at", "opens", "closes", "roles")
        .join(nested, "host")
        .select("host", "tokens", "at", "opens", "closes", "roles", "classes")
        .mapInArrow(run, "host string, slot long, bits int")
        .groupBy("host", "slot", "bits")
        .agg(F.count("*").alias("n"))
        .groupBy("host", "slot")
        .agg(F.max(F.struct("n", (-F.col("bits")).alias("less"))).alias("most"))
        .groupBy("host")
        .agg(F.collect_list(F.struct("slot", (-F.col("most.less")).alias("bits"))).alias("found"))
    )
    return nested.join(seen, "host", "left").select("host", "classes", F.col("found.slot").alias("slots"), F.col("found.bits").alias("slot_roles"))


def _host_column(url: str):
    found = F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found == "", None).otherwise(F.lower(found))


def assemble(tokens, at, texts, opens, closes, roles, spots=None, slot_roles=None) -> str:
    """The text that fills the slots of the article, a block per line; see ``read``. Without classes the page is one slot."""
    if spots:
        slot, _ = fill(tokens, spots)
        around, own = _apart(tokens, opens, closes, roles, spots)
        names, place = np.unique(slot, return_inverse=True)
        learned = np.array([slot_roles.get(name, -1) for name in names.tolist()])[place]
        bits = np.where(learned < 0, around, learned) | own
    else:
        bits = roles_at(opens, closes, roles, len(tokens))
    pieces = [0 if i < 0 else bit for i, bit in zip(at, bits[np.asarray(at, dtype=np.int64)].tolist())]
    blocks: list[tuple[bool, list[str]]] = []
    words: list[str] = []
    inside = False
    for place, text, role in zip(at, texts, pieces):
        if place < 0:
            if text is not None:
                words.append(text)
            elif words:
                blocks.append((inside, words))
                words = []
            continue
        if role & BY_TAG:
            continue
        if (role & INSIDE > 0) != inside:
            if words:
                blocks.append((inside, words))
                words = []
            inside = not inside
        if role & BY_NAME:
            continue
        if spots and not inside:
            word = iter(tokens[place:])
            text = re.sub(r"\S+", lambda m: "" if next(word) in spots else m[0], text)
        words.append(text)
    if words:
        blocks.append((inside, words))
    lines = [(own, " ".join("".join(parts).split())) for own, parts in blocks]
    lines = [x for x in lines if x[1]]
    if any(own for own, _ in lines):
        lines = [x for x in lines if x[0]]
    return "\n".join(text for _, text in lines)


def main_text(page: str | None) -> str:
    """The text of a page of a host without a template."""
    (tokens, _), pieces, spans = read(page)
    return assemble(tokens, *pieces, *spans)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page.

    A null or empty page has an empty text; a page without a usable URL has no template. Repeated rows are kept.
    Character references are decoded, white space inside a block is one space, blocks are joined by a line feed.
    """
    parsed = parsed_pages(pages, id_col, url_col, html_col)
    learned = materialize(templates(parsed))
    found = ("tokens", "at", "texts", "opens", "closes", "roles")
    joined = parsed.join(learned, "host", "left").select("page_id", "url", *found, "classes", "slots", "slot_roles")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = []
            for *page, classes, slots, roles in zip(*(batch.column(i).to_pylist() for i in range(2, 11))):
                texts.append(assemble(*page, _spots(classes or []), dict(zip(slots or [], roles or []))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
