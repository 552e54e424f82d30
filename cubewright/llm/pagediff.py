"""Main text by nearest-URL page differencing.

Pages are range-partitioned and sorted by host, URL path and page_id, so that of
all pages of the same host the one with the nearest path (the longest common
prefix) stands next to a page, before or after it; a host with very many pages
spreads over many partitions. The ranges are
cut over keys alone; each partition is also handed the last page of the one
before it and the first of the one after it, so that neighbours don't depend on
where the ranges end. The text blocks
of a page and of its neighbour are aligned by a longest common subsequence, and
shared blocks are deleted first. A paragraph, heading or list item inside the
article element stays even if the neighbour has the same words, as repeated
sentences of authors are no boilerplate. What chrome (menus, headers, footers,
sidebars, notices, adverts, forms, comments) the neighbour doesn't share is then
told by markup. The result counts the blocks that each of the two deletes.

Each page is compared with the nearer of its two neighbours, with the one before
it where both are as near. Blocks are aligned in full at every size: time grows by
the product of the two lengths over the bits of a machine word. Edge cases: null html counts as
empty and gives an empty text; a null url sorts before others and has no host
in common with any; the only page of a host has no neighbour; pages that are
entire copies of their neighbour keep their blocks (else nothing would be left);
repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from math import isqrt
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas select button textarea form nav aside dialog menu footer".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = frozenset("svg math".split())
IN_HEAD = frozenset("html head title meta link style script base noscript template".split())
CLOSED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Class names and ids of chrome (fixed values). A name of several parts is chrome
#: if one part is and the others only say what kind of box: "cookie-notice",
#: "nav-item" and "related-posts", but not "related-work", "side-effects" or "share-price".
_CHROME = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising adsense banner banners promo promos promotion promotions sponsor sponsored sponsors cookie cookies consent gdpr notice notices newsletter "
    "subscribe subscription signup popup popover modal overlay menu menus nav navs navbar navigation topnav breadcrumb breadcrumbs sidebar aside side widget widgets header masthead footer comment comments reply replies "
    "respond disqus share sharing social related recommended recommendations pagination pager paging copyright login search skip toolbar".split()
)
_BOX = frozenset(
    "a and area articles bar block blocks body bottom box btn button buttons card cards col column container content footer form group head heading icon icons inner item items js left link links list main "
    "media module nav news outer page panel policy posts primary right row rows section secondary sidebar site slot small stories text thread title to toggle top unit video view wrap wrapper wide fixed sticky global local mobile desktop".split()
)


def _is_chrome(name: str) -> bool:
    parts = [part.rstrip("0123456789") for part in name.replace("_", "-").split("-")]
    parts = [part for part in parts if part]
    return any(part in _CHROME for part in parts) and all(part in _CHROME or part in _BOX for part in parts)


_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
_SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Text blocks in page order, each with where it stands."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # tag, inside chrome, inside the article
        self.blocks: list[tuple[str, bool, bool, bool]] = []  # text, chrome, article, prose
        self.parts: list[str] = []
        self.at = (False, False, False)

    def _state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            self.blocks.append((text, *self.at))

    def _mark(self) -> None:
        chrome, article = self._state()
        self.at = (chrome, article, any(tag in PROSE for tag, _, _ in self.stack))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        closed = {open_ for open_, by in CLOSED_BY.items() if tag in by}
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in closed:
                del self.stack[i:]
                break
            if self.stack[i][0] in BLOCKS and self.stack[i][0] != "p":
                break
        if tag not in IN_HEAD and self.stack and self.stack[-1][0] == "head":
            self.stack.pop()  # its end tag may be left out
        if tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            chrome, article = self._state()
            named = dict(attrs)
            marked = any(map(_is_chrome, f"{named.get('class') or ''} {named.get('id') or ''}".lower().split()))
            own = tag in ("article", "main", "body", "html", "p", "h1", "h2", "h3")
            chrome = chrome or tag in SKIPPED or tag == "header" and not article or not own and marked or named.get("role") in _ROLES or "hidden" in named or tag == "article" and marked and article
            self.stack.append((tag, chrome, article or tag in ("article", "main") or named.get("role") == "main"))
        self._mark()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # Of HTML's own elements only void ones end at once; drawings and formulas do, and all in them.
        if tag in FOREIGN or any(open_ in FOREIGN for open_, _, _ in self.stack):
            self.flush_if(tag)
        else:
            self.handle_starttag(tag, attrs)

    def flush_if(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        self._mark()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Unknown ``<![`` sections are bogus comments up to the next ``>``, as browsers have it."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)


def blocks(html: str | None) -> list[tuple[str, bool, bool, bool]]:
    """(text, chrome, article, prose) of each block of the whole page."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def shared(mine: list[str], other: list[str]) -> set[int]:
    """The positions in ``mine`` that a longest common subsequence with ``other`` holds.

    Ends that agree are matched first and only the middle is aligned; blocks that
    one side lacks can't be matched and are left out before.
    """
    n, m, lo = len(mine), len(other), 0
    while lo < n and lo < m and mine[lo] == other[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and hi < m - lo and mine[n - 1 - hi] == other[m - 1 - hi]:
        hi += 1
    out = {*range(lo), *range(n - hi, n)}
    both = set(mine[lo : n - hi]) & set(other[lo : m - hi])
    a = [i for i in range(lo, n - hi) if mine[i] in both]
    b = [other[j] for j in range(lo, m - hi) if other[j] in both]
    if not a or not b:
        return out
    return out | {a[i] for i in _aligned([mine[i] for i in a], b)}


def _aligned(a: list[str], b: list[str]) -> Iterator[int]:
    """The positions in ``a`` of a longest common subsequence with ``b``.

    Row i of the table, the lengths for a[i:] and every b[j:], is one integer:
    bit m - 1 - j is 0 where b[j:] has one more than b[j + 1:]. Every step-th row
    is held and those between are made again, so memory grows by the length
    times the root of the length.
    """
    n, m = len(a), len(b)
    ones, at = (1 << m) - 1, {}
    for j, word in enumerate(b):
        at.setdefault(word, []).append(m - 1 - j)

    def bits(word: str) -> int:
        out = bytearray(m // 8 + 1)
        for k in at[word]:
            out[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(out, "little")

    frequent = {word: bits(word) for word, ks in at.items() if len(ks) > isqrt(m)}  # at most the root of m

    def above(row: int, word: str) -> int:
        hit = row & (frequent.get(word) or bits(word))
        return ((row + hit) | (row - hit)) & ones

    step = isqrt(n) + 1
    held, row = {n: ones}, ones
    for i in range(n - 1, -1, -1):
        row = above(row, a[i])
        if i % step == 0:
            held[i] = row
    rows: dict[int, int] = {}

    def length(i: int, j: int) -> int:
        return m - j - (rows[i] & ((1 << (m - j)) - 1)).bit_count()

    i = j = 0
    while i < n and j < m:
        if i + 1 not in rows:
            end = min(n, i - i % step + step)
            rows = {end: held[end]}
            for k in range(end - 1, i - 1, -1):
                rows[k] = above(rows[k + 1], a[k])
            here, below = length(i, j), length(i + 1, j)
        if a[i] == b[j]:
            yield i
            i, j = i + 1, j + 1
        elif below >= here - (not rows[i] >> (m - 1 - j) & 1):
            i += 1
        else:
            here, below = here - (not rows[i] >> (m - 1 - j) & 1), below - (not rows[i + 1] >> (m - 1 - j) & 1)
            j += 1
            continue
        if i + 1 in rows:
            here, below = length(i, j), length(i + 1, j)


def decided(page: list, neighbour: list | None) -> tuple[list[str], int, int]:
    """The blocks that stay, how many differencing deletes, and how many more markup does."""
    held = any(article and not chrome for _, chrome, article, _ in page)
    mine = [b[0] for b in page]
    same = shared(mine, [b[0] for b in neighbour]) if neighbour else set()
    if len(same) == len(mine):
        same = set()
    kept, by_neighbour, by_markup = [], 0, 0
    for i, (text, chrome, article, prose) in enumerate(page):
        if i in same and not (article and prose and not chrome):
            by_neighbour += 1
        elif chrome or held and not article:
            by_markup += 1
        else:
            kept.append(text)
    return kept, by_neighbour, by_markup


def main_text(page: list, neighbour: list | None) -> str:
    """The page's text without what it shares with its neighbour and without chrome."""
    return "\n".join(decided(page, neighbour)[0])


def _pack(page: list) -> bytes:
    return zlib.compress(json.dumps(page, ensure_ascii=False).encode("utf-8", "surrogatepass"), 1)


def _unpack(data: bytes) -> list:
    return json.loads(zlib.decompress(data).decode("utf-8", "surrogatepass"))


def _key(host: str | None, path: str | None, page_id: int | None, url: str | None) -> tuple:
    """Compares as Spark sorts: nulls first, strings by code point."""
    return tuple((x is not None, x if x is not None else 0) for x in (host, path, page_id, url))


def _parser(firsts: list[tuple], lasts: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Html in, packed blocks out, each row with its range; those at a range's
    end a second time as a guest of the next range."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, hosts, paths, htmls, ties = (c.to_pylist() for c in batch.columns)
            rows = []
            for row in zip(ids, urls, hosts, paths, ties, (_pack(blocks(h)) for h in htmls)):
                key = _key(row[2], row[3], row[0], row[1])
                at = max(0, bisect_right(firsts, key) - 1)
                rows.append((*row, at, False))
                if at + 1 < len(firsts) and key == lasts[at]:
                    rows.append((*row, at + 1, True))
                if at and key == firsts[at]:
                    rows.append((*row, at - 1, True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_PARSED), _PARSED)], schema=_PARSED)

    return parsed


_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("tie", pa.int64()), ("page", pa.binary()), ("range", pa.int32()), ("guest", pa.bool_())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages in, texts of all but guests out; only three pages are held at a time."""

    def pages() -> Iterator[tuple]:
        for batch in batches:
            for page_id, url, host, path, _, data, _, guest in zip(*(c.to_pylist() for c in batch.columns)):
                yield page_id, url, host, path, _unpack(data), guest

    def texts() -> Iterator[tuple]:
        before, now = None, None
        for after in pages():
            if now is not None and not now[5]:
                yield _row(now, before, after)
            before, now = now, after
        if now is not None and not now[5]:
            yield _row(now, before, None)

    rows: list[tuple] = []
    for row in texts():
        rows.append(row)
        if len(rows) >= 200:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _row(now: tuple, before: tuple | None, after: tuple | None) -> tuple:
    kept, by_neighbour, by_markup = decided(now[4], _near(now, before, after))
    return now[0], now[1], "\n".join(kept), by_neighbour, by_markup


def _near(now: tuple, before: tuple | None, after: tuple | None) -> list | None:
    """The blocks of the nearer neighbour on the same host, of that before if both are as near."""
    near = [(len(commonprefix([other[3] or "", now[3] or ""])), other[4]) for other in (before, after) if other is not None and now[2] and other[2] == now[2]]
    return max(near, key=lambda x: x[0])[1] if near else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, urls, texts, by_neighbour, by_markup = zip(*rows)
    columns = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(by_neighbour, pa.int64()), pa.array(by_markup, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, _TEXTS)


_TEXTS = ["page_id", "url", "text", "n_chars", "n_shared", "n_chrome"]


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_shared (blocks
    that differencing deleted), n_chrome (blocks that only markup did)."""
    python_ready(pages.sparkSession)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    order = ["host", "path", "page_id", "url"]
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Two keys a range come to the driver, no page does.
    key = F.struct(*order)
    cut = rows.select(*order).repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("at")).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    cut = sorted((_key(*r["first"]), _key(*r["last"])) for r in cut.collect())
    parsed = rows.withColumn("tie", F.xxhash64("html")).mapInArrow(_parser([a for a, _ in cut], [b for _, b in cut]), "page_id long, url string, host string, path string, tie long, page binary, range int, guest boolean")
    dealt = parsed.repartitionById(max(1, len(cut)), F.col("range")).sortWithinPartitions("range", *order, "tie")
    return dealt.mapInArrow(_texts, "page_id long, url string, text string, n_chars long, n_shared long, n_chrome long")
