"""Main text of web pages by differencing each page against its neighbour in URL order.

A page becomes a list of text lines, one per block, with the places that hold menus, headers,
footers, sidebars, notices, adverts, forms, comments and the like left out by element, role or class
(inside an article element only by whole class names, since "share price" or "related-work" is text).
Pages of a host are ordered by URL path; a page's partner is the page before it (for the first page
of a host, the one after). Lines are aligned by longest common subsequence, and lines the two pages
share are boilerplate and go. Lines of an explicit article element are known to be text: one that is
deleted, because it recurs in the partner, is put back. Lines outside it are kept or deleted as on any page.

Pages are dealt into ranges of (host, path, id) with one shuffle and walked in order; the last page
of a range is also sent to the next one as a guest. A host of any size is spread over many ranges.
Null html gives an empty text, null URLs form a host of their own, equal URLs are ordered by id.
Repeated rows, also those with a null id, give a row each; an empty table gives none; a page may be of
any length and is one row of one task; columns other than the three named ones are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundwork.llm.common import range_fences, range_of, small_batches

ROWS_PER_RANGE = 2_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)>"
    r"|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")  # a whole pair at a time

# Fixed names of the markup language and of common page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("head nav footer aside form button select menu dialog fieldset label object audio video canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog toolbar".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|menu\w*|nav|navbar|navigation|breadcrumbs?|cookies?|consent|"
    r"notices?|newsletter|subscribe|signup|popup|modal|overlay|social|share|sharing|related|recommend\w*|comments?|disqus|repl(?:y|ies)|"
    r"footer|masthead|login|search|pagination|pager|widget|toolbar|disclaimer|site-header|page-header)(?:$|[\s_-])", re.I)
# Whole class names that are furniture inside an article as well; other names there may be the subject of its text.
NAMED_INSIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo menu navbar navigation breadcrumb breadcrumbs sidebar notice notices "
    "cookie-notice cookie-banner newsletter newsletter-signup comment comments comment-list reader-comments related replies disqus disqus_thread footer".split())


def _left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_article):
        return True
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if not NAMED_INSIDE.isdisjoint(value.lower().split()) if in_article else NAMED.search(value):
                return True
        if name in ("class", "id") and tag == "article" and re.search(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies))(?:$|[\s_-])", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """The text lines of a page outside its furniture, and whether each lies in an article element."""
    lines: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, left out, in an article
    at = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            lines.append((text, bool(stack and stack[-1][2])))
        held.clear()

    def close_to(depth: int) -> None:
        flush()
        del stack[depth:]

    page = page or ""
    for token in TOKEN.finditer(page):
        if token.start() > at and not (stack and stack[-1][1]):
            held.append(page[at:token.start()])
        at = token.end()
        closing, tag = token[2], (token[3] or "").lower()
        if not tag:
            continue
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag in BLOCKS:
                        close_to(depth)
                    else:
                        del stack[depth:]
                    break
                if stack[depth][0] in ("article", "main", "body", "td", "th", "li") and tag not in BLOCKS:
                    break
            continue
        if tag in BLOCKS:
            flush()
            # A block ends an open paragraph, a list item or cell ends the one before.
            ends = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}.get(tag, ()) + (("p",) if tag != "br" else ())
            if tag == "body":
                ends += ("head",)
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCKS and stack[depth][0] != "p":
                    break
        if tag in VOID or token[4].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        out, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        hidden = out or _left_out(tag, token[4], inside)
        stack.append((tag, hidden, inside or (tag == "article" and not hidden)))
    if at < len(page) and not (stack and stack[-1][1]):
        held.append(page[at:])
    flush()
    return lines


def _row(a: list, b: list) -> int:
    """Bit j is 0 where the longest common subsequence of ``a`` and b[:j+1] is one longer than with b[:j]."""
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return row


def _lengths(row: int, n: int) -> list[int]:
    out, total = [0], 0
    for j in range(n):
        total += not (row >> j) & 1
        out.append(total)
    return out


def common_places(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``, in memory that grows with their sum."""
    known = set(b)
    keep = [i for i, x in enumerate(a) if x in known]
    mine = set(a)
    places = _common([a[i] for i in keep], [y for y in b if y in mine])
    return [keep[i] for i in places]


def _common(a: list, b: list) -> list[int]:
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    first, last = list(range(head)), list(range(len(a) - tail, len(a)))
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    if not a or not b:
        return first + last
    if len(a) == 1:
        middle = [0] if a[0] in b else []
    else:
        half = len(a) // 2
        ahead = _lengths(_row(a[:half], b), len(b))
        behind = _lengths(_row(a[half:][::-1], b[::-1]), len(b))[::-1]
        cut = max(range(len(b) + 1), key=lambda j: ahead[j] + behind[j])
        middle = _common(a[:half], b[:cut]) + [half + i for i in _common(a[half:], b[cut:])]
    return first + [head + i for i in middle] + last


def main_text(lines: list[tuple[str, bool]], partner: list[str] | None) -> str:
    """The lines not shared with the partner, and every line of an article element."""
    texts = [text for text, _ in lines]
    shared = set(common_places(texts, partner)) if partner else set()
    return "\n".join(text for i, (text, inside) in enumerate(lines) if inside or i not in shared)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page."""
    small_batches(pages.sparkSession)
    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(address, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    order = F.concat_ws("\u0001", host, path, F.lpad(F.coalesce(F.col(key).cast("string"), F.lit("")), 20, "0"))
    keys = pages.select(host.alias("host"), order.alias("order"))
    fences = range_fences(keys, "order", ROWS_PER_RANGE)
    # A page that is the first of its host looks ahead: as the end of a range it goes to the next one.
    ahead = []
    if len(fences) > 1:
        marks = pages.sparkSession.createDataFrame([(f,) for f in fences], "fence string")
        firsts = keys.groupBy("host").agg(F.min("order").alias("fence"))
        ahead = [r.fence for r in marks.join(firsts, "fence").select("fence").collect()]  # at most one per range
    own = range_of(order, fences)
    moved = order.isin(ahead) if ahead else F.lit(False)
    guest = (F.get(F.array(*[F.lit(f) for f in fences]), own) == order) & ~moved if fences else F.lit(False)
    seats = F.array_compact(F.array(
        F.struct((own + moved.cast("int")).alias("range"), F.lit(False).alias("guest")),
        F.when(guest, F.struct((own + 1).alias("range"), F.lit(True).alias("guest")))))
    kind = pages.schema[key].dataType.simpleString()

    def to_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page) for page in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in range(6)), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())),
                pa.array([[i for _, i in f] for f in found], pa.list_(pa.bool_()))],
                ["range", "guest", "order", "host", "key", "url", "lines", "inside"])

    seated = pages.select(F.inline(seats), order.alias("order"), host.alias("host"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    lined = seated.mapInArrow(
        to_lines, f"range int, guest boolean, order string, host string, key {kind}, url string, lines array<string>, inside array<boolean>")
    walked = lined.repartition(max(1, len(fences)) + 1, "range").sortWithinPartitions("range", F.col("guest").desc(), "order", "url")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = waiting = None  # (range, host, lines, key, url) of the page before; a first page that waits
        out: list[tuple] = []

        def settle(page: tuple, partner: tuple | None) -> None:
            text = main_text(page[2], [t for t, _ in partner[2]] if partner else None)
            out.append((page[3], page[4], text, len(text)))

        for batch in batches:
            kind_of = batch.column(4).type
            for place, guest_, _, site, k, link, texts, inside in zip(*(c.to_pylist() for c in batch.columns)):
                page = (place, site, list(zip(texts, inside)), k, link)
                near = before is not None and before[:2] == page[:2]
                if waiting is not None:
                    settle(waiting, page if near else None)
                    waiting = None
                if not guest_:
                    if near:
                        settle(page, before)
                    else:
                        waiting = page
                before = page
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[0], kind_of), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
                    [key, "url", "text", "n_chars"])
                out.clear()
        if waiting is not None:
            settle(waiting, None)
            yield pa.RecordBatch.from_arrays([
                pa.array([out[0][0]], kind_of), pa.array([out[0][1]], pa.string()), pa.array([out[0][2]], pa.string()), pa.array([out[0][3]], pa.int64())],
                [key, "url", "text", "n_chars"])

    return walked.mapInArrow(pair, f"`{key}` {kind}, url string, text string, n_chars long")
