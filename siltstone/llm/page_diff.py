"""HTML extraction by differencing each page with its nearest-URL page.

A page becomes text lines, one for each block, each with the part of the page it stands in.  Parts that HTML itself marks
as no article (menus, headers, footers, forms, notices, comments and so on) never count.  Every page is then differenced.

Pages of one host with equal lines are one entry, at the least of their paths, and share its result.  Entries are sorted
by host and URL path.  A page's partner is the nearest, by common path, of a few entries on both sides of it on the same
host that is no copy of it; the lines of both are aligned by longest common subsequence, and shared lines are template
text and go.  A page of template lines only is left without text.

Articles repeat lines of each other that are their own text, so within an article element one partner is not enough: a line
shared with it goes where all of the other entries have it too, WITNESSES or more of them that are no copies of the page
or of each other.

Pages are parsed twice: first to line hashes, which travel to the sort, then to text lines, which meet the few places that
go.  No text is written in between, and none is shuffled where the list of places is short.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import chunks, durable, parts_for, pick

# Fixed values of HTML: elements without content, with raw text, that flow within a line, and that are no article.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_OUT = set("head nav footer aside form script style noscript template iframe svg canvas object select button textarea dialog menu title audio video map applet fieldset".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id names that mark a part as no article.
_MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "sidebar aside widget widgets related recommended recommendations share sharing social comment comments commentlist reply replies "
    "respond disqus discussion footer header masthead topbar toolbar pagination pager skip".split()
)
_SETS_APART = set("article main body html".split())
_CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SAME = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_PLAIN, _ARTICLE, _APART, _MAIN = range(4)
#: Pages, the partner among them, that must have a line of an article for it to be template text.
WITNESSES = 4


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is marked as no part of the article."""
    if name == "header":
        return not inside
    if name in _OUT:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, a, b, c, alone in _ATTRIBUTE.findall(attributes):
        key, value = (key or alone).lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in _ROLES):
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for one in value.split():
                words = re.split(r"[^a-z0-9]+", re.sub(r"^(?:has|with|no|without)[-_].*", "", one))
                if not _MARKS.isdisjoint(words) and not (name == "article" and _MARKS.isdisjoint(words[:1])):
                    if not (inside and words == ["header"]):
                        return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """The text lines of a page, in order, each with its part: plain, in main, in an article, or apart."""
    found: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = [("", _PLAIN)]
    held: list[str] = []

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                found.append((text, stack[-1][1]))
            held.clear()

    def close(depth: int):
        if any(n not in _INLINE or p != stack[depth - 1][1] for n, p in stack[depth:]):
            flush()
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            held.append(page[at:])
            break
        if token.start() > at:
            held.append(page[at : token.start()])
        at = token.end()
        slash, name = token[1], (token[2] or "").lower()
        if not name:
            continue
        if slash:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
            else:
                if name not in _INLINE:
                    flush()
            continue
        part = stack[-1][1]
        if name not in _INLINE:
            flush()
            if name in _CLOSES_P or name in _SAME:
                names, bounds = ("p", {"button", "table", "td", "th"}) if name in _CLOSES_P else _SAME[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in names.split():
                        close(depth)
                        break
                    if stack[depth][0] in bounds or (name not in _CLOSES_P and stack[depth][0] in _CLOSES_P):
                        break
                part = stack[-1][1]
        if name in _VOID:
            continue
        if part != _APART:
            if _marked(name, token[3], part in (_ARTICLE, _MAIN)):
                part = _APART
            elif name == "article":
                part = _ARTICLE
            elif name == "main" and part == _PLAIN:
                part = _MAIN
        if name in _INLINE and part != stack[-1][1]:
            flush()
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if not token[3].rstrip().endswith("/") or name not in ("svg", "path"):
            stack.append((name, part))
    flush()
    return found


def _rows(a: list, b: list) -> list[int]:
    """For each prefix of a, the bits of b where the longest common subsequence does not grow (bit-parallel)."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, out = full, []
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        out.append(row)
    return out


def shared(a: list, b: list) -> list[int]:
    """Places in a of one longest common subsequence of a and b."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    outer = [*range(head), *range(len(a) - tail, len(a))]
    there, here = set(b[head : len(b) - tail]), set(a[head : len(a) - tail])
    own = [i for i in range(head, len(a) - tail) if a[i] in there]
    left, right = [a[i] for i in own], [x for x in b[head : len(b) - tail] if x in here]
    return sorted(outer + [own[i] for i in _align(left, right)])


def _align(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > 1 << 26 and len(a) > 1:  # halve a where both halves' best splits of b meet
        mid = len(a) // 2
        fore, back = _rows(a[:mid], b)[-1], _rows(a[mid:][::-1], b[::-1])[-1]
        one = np.cumsum([0, *(1 - (fore >> j & 1) for j in range(len(b)))])
        two = np.cumsum([0, *(1 - (back >> j & 1) for j in range(len(b)))])[::-1]
        cut = int(np.argmax(one + two))
        return _align(a[:mid], b[:cut]) + [mid + i for i in _align(a[mid:], b[cut:])]
    rows, i, j, out = _rows(a, b), len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif i > 1 and (~rows[i - 2] & ((1 << j) - 1)).bit_count() == (~rows[i - 1] & ((1 << j) - 1)).bit_count():
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; what is not a URL is a path without a host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), re.sub(r"(?:\.x?html?|/)+$", "", parts.path)
    except ValueError:
        return "", url or ""


def _pages(batches):
    """Tables of id, url and html with host, path and text lines of each page, and the hashes and parts of its lines."""
    for table in chunks(batches, 8 << 20, "html"):
        places = [_place(u.as_py()) for u in table.column("url")]
        found = [lines_of(p.as_py() or "") for p in table.column("html")]
        yield table, places, found, [b"".join(xxhash.xxh64_digest(t) + bytes([p]) for t, p in x) for x in found]


def _key(host: str, lines: bytes) -> int:
    """The entry that a page belongs to."""
    return int.from_bytes(xxhash.xxh64_digest(xxhash.xxh64_digest(host) + lines), "big", signed=True)


def _parse(batches):
    for _, places, _, lines in _pages(batches):
        hosts, paths = zip(*places, strict=True)
        columns = [pa.array([_key(h, x) for h, x in zip(hosts, lines, strict=True)], pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(lines, pa.binary())]
        yield pa.record_batch(columns, names=["key", "host", "path", "lines"])


def _blocks(batches):
    for table, places, found, lines in _pages(batches):
        keys = pa.array([_key(h, x) for (h, _), x in zip(places, lines, strict=True)], pa.int64())
        blocks = pa.array([body_lines(x) for x in found], pa.list_(pa.string()))
        yield pa.record_batch([table.column("id").combine_chunks(), table.column("url").combine_chunks(), keys, blocks], names=["id", "url", "key", "blocks"])


def _common(a: str, b: str) -> tuple[int, int]:
    """Common path segments, and common characters."""
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n].count("/"), n


def _body(parts: set[int]) -> int:
    """The part that holds a page's text."""
    return next((p for p in (_ARTICLE, _MAIN) if p in parts), _PLAIN)


def template_lines(host: str, path: str, lines: bytes, around: list) -> bytes:
    """The places of a page's template lines, four bytes each, by its nearest neighbour that is no copy.

    Copies have the same lines or, of the pages with a main or article element, more than half of its lines in common both
    ways.  Pages with nine tenths of all their lines in common are partners only where there is no other.
    """
    own = [lines[i : i + 9] for i in range(0, len(lines), 9)]
    near = sorted((x for x in around if x and x["host"] == host), key=lambda x: _common(path, x["path"]), reverse=True)
    body, mine = _body({x[8] for x in own}), set(own)
    text, partner, alike, seen = {x for x in own if x[8] == body}, None, None, []
    for other in near:
        theirs = [other["lines"][i : i + 9] for i in range(0, len(other["lines"]), 9)]
        others = set(theirs)
        if mine == others or (body in (_MAIN, _ARTICLE) and _copies(text, {x for x in others if x[8] == body})):
            continue  # a copy says nothing about the template
        seen.append(others)
        if len(mine & others) * 10 >= len(mine | others) * 9:
            alike = alike or theirs
        elif partner is None:
            partner = theirs
    partner = partner or alike
    if not partner:
        return b""
    places = shared(own, partner)
    if body == _ARTICLE:
        sure = _witnessed(text, seen)
        places = [i for i in places if own[i][8] != body or own[i] in sure]
    return np.array(places, "<u4").tobytes()


def _copies(a: set, b: set) -> bool:
    return len(a & b) * 2 > max(len(a), len(b))


def _witnessed(text: set, pages: list[set]) -> set:
    """The lines of an article that all pages have, if WITNESSES of them or more are no copies of each other."""
    apart: list[set] = []
    for page in pages:
        article = {x for x in page if x[8] == _ARTICLE}
        if not any(article == x or _copies(article - text, x - text) for x in apart):
            apart.append(article)
    return text.intersection(*apart) if len(apart) >= WITNESSES else set()


def _compare(batches):
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("host", "path", "lines", "before", "after")), strict=True)
        out = [body_places(x, template_lines(h, p, x, [*a[::-1], *b])) for h, p, x, a, b in rows]
        yield pa.record_batch([batch.column("key"), pa.array(out, pa.binary())], names=["key", "template"])


def body_lines(lines: list[tuple[str, int]]) -> list[str]:
    """The lines of the part that holds a page's text."""
    body = _body({p for _, p in lines})
    return [t for t, p in lines if p == body]


def body_places(lines: bytes, template: bytes) -> bytes:
    """Places of template lines among all lines as places among the lines of the text; others are left out."""
    parts = np.frombuffer(lines, np.uint8)[8::9]
    inside = parts == _body(set(parts.tolist()))
    places = np.frombuffer(template, "<u4")
    return (np.cumsum(inside) - 1)[places[inside[places]]].astype("<u4").tobytes()


def main_text(lines: list[tuple[str, int]], template: set[int]) -> str:
    """What is left of a page's lines, joined by a space."""
    body = _body({p for _, p in lines})
    return " ".join(t for i, (t, p) in enumerate(lines) if p == body and i not in template)


def _finish(batches):
    for batch in batches:
        out = []
        for blocks, template in zip(batch.column("blocks"), batch.column("template"), strict=True):
            places = set(np.frombuffer(template.as_buffer(), "<u4").tolist()) if template.is_valid else set()
            out.append(" ".join(t for i, t in enumerate(blocks.as_py()) if i not in places))
        yield pa.record_batch([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], names=["id", "url", "text"])


def _templates(parsed: DataFrame, near: int) -> DataFrame:
    """key, template: the places of template lines among the text lines of the entries that have any."""
    entries = durable(parsed.filter("length(lines) > 0").groupBy("key").agg(F.min(F.struct("path", "host", "lines")).alias("one")).select("key", "one.*"))
    parts = parts_for(entries, F.length("lines") + F.length("path") + 64, 4 << 20)
    placed = entries.repartitionByRange(parts, "host", "path", "key").sortWithinPartitions("host", "path", "key")
    placed = durable(placed.withColumn("part", F.spark_partition_id()).withColumn("spot", F.monotonically_increasing_id()))
    page = F.struct("host", "path", "lines")
    within, back = Window.partitionBy("part").orderBy("spot"), Window.partitionBy("part").orderBy(F.col("spot").desc())

    def end(order, name):
        some = placed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= near)
        return some.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("spot", page.alias("page")))), lambda x: x["page"]).alias(name))

    parts = Window.orderBy("part")  # a row for each partition of the sort
    ends = end(within, "first").join(end(back, "last"), "part")
    ends = durable(ends.select("part", F.lag("last").over(parts).alias("last_before"), F.lead("first").over(parts).alias("first_after")))
    before, after = F.collect_list(page).over(within.rowsBetween(-near, -1)), F.collect_list(page).over(within.rowsBetween(1, near))
    around = placed.withColumns({"before": before, "after": after}).join(ends, "part", "left")
    none = F.array().cast("array<struct<host:string,path:string,lines:binary>>")
    around = around.withColumn("before", F.when(F.size("before") < near, F.concat(F.coalesce("last_before", none), "before")).otherwise(F.col("before")))
    around = around.withColumn("after", F.when(F.size("after") < near, F.concat("after", F.coalesce("first_after", none))).otherwise(F.col("after")))
    return around.select("key", "host", "path", "lines", "before", "after").mapInArrow(_compare, "key long, template binary").filter("length(template) > 0")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", near: int = 4) -> DataFrame:
    """Per row: id_col, url_col, text (the main text; empty if none, also of a null or empty html).

    A page looks at `near` entries on each side; with 0 nothing is differenced.  Null urls count as one host with
    an empty path; a page alone on its host has no partner and nothing to delete by it; repeated rows are copies of each
    other.  Whole pages, any length.
    """
    rows = pick(pages, id=id_col, url=url_col, html=html_col).select(F.col("id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    found = rows.mapInArrow(_blocks, "id long, url string, key long, blocks array<string>")
    if near > 0:
        parsed = rows.select("id", "url", "html").mapInArrow(_parse, "key long, host string, path string, lines binary")
        found = found.join(durable(_templates(parsed, near)), "key", "left")
    else:
        found = found.withColumn("template", F.lit(None).cast("binary"))
    found = found.select("id", "url", "blocks", "template").mapInArrow(_finish, "id long, url string, text string")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})
