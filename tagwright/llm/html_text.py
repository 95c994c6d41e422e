"""Main text of web pages: nearest-URL page differencing.

A page is read once into text lines (one per block element), each with what
the markup says about it: boilerplate (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments), prose of the article, or open.
Pages are ordered by host and URL path; each is paired with the nearest page
of its host (of the pages next to it in that order, the one that shares the
longest path prefix) and the two are aligned by the longest common
subsequence of their lines.  Lines shared in the alignment are template: they
are deleted, unless they are the article's own prose.  A neighbour that is a
copy (less than a fifth of the page is not shared) says nothing about the
template, and the next one is taken.  On pages without an article element, or whose
article elements hold less than half of the text outside boilerplate, every line
outside boilerplate is open, so there the alignment alone decides.

Scale: only outlines (a digest per line) are sorted and aligned; the pages are
read a second time to write out the text.  Outlines are numbered in the order
of (host, path) and cut into blocks of ``BLOCK`` pages plus the few next to its
borders, so a host that holds a third of all pages is many blocks, and the
pairing does not depend on how the pages were dealt out.

Edge cases: null or empty html gives an empty text; a null URL counts as the
empty one; pages alone on their host are judged by their markup; repeated rows
are one page and share its result; unclosed or
misnested tags close with their parent; tables may be empty and further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

OPEN, PROSE, BOILERPLATE = 0, 1, 2
NEIGHBOURS = 3
BLOCK = 512
_TABLE_BITS = 1 << 26

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>|"
    r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(?P<text><|[^<]++)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
_DROP_TAGS = frozenset(
    "nav footer aside form head button select menu dialog svg object canvas audio video fieldset search datalist map".split()
)
_DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist "
    "directory status log marquee".split()
)
_DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar "
    "navigation menu topnav breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent "
    "gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments disqus respond reply replies pagination pager toolbar "
    "skip copyright".split()
)
#: containers whose class or id may name a part of the page rather than boilerplate
_NEVER_BY_NAME = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BLOCK - {"html", "body", "head", "li", "dd", "dt", "td", "th", "tr", "option", "caption", "tbody", "thead", "tfoot"}
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th li figcaption".split())


def _boilerplate(tag: str, attrs: str, in_root: bool) -> bool:
    if tag in _DROP_TAGS or (tag == "header" and not in_root):
        return True
    if not attrs or tag in _NEVER_BY_NAME or "=" not in attrs:
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), entities.unescape("".join(values))
        if name == "role" and value.strip().lower() in _DROP_ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                if any(p.lower() in _DROP_NAMES for p in _NAME.findall(word)):
                    return True
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (
            name == "style" and "display:none" in value.replace(" ", "").lower()
        ):
            return True
    return False


def _root(tag: str, attrs: str) -> bool:
    return tag in ("article", "main") or bool(
        attrs and re.search(r"role\s*=\s*[\"']?(?:main|article)\b|itemprop\s*=\s*[\"']?articleBody", attrs, re.I)
    )


def read_lines(page: str) -> list[tuple[str, int]]:
    """Text lines in page order with their kind."""
    lines: list[tuple[str, int, bool]] = []
    # open elements: (tag, inside boilerplate, inside article, prose element above)
    stack: list[tuple[str, bool, bool, bool]] = []
    held: list[str] = []
    any_root = False

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                _, drop, root, prose = stack[-1] if stack else ("", False, False, False)
                lines.append((text, BOILERPLATE if drop else PROSE if prose else OPEN, root))

    def close(upto: int) -> None:
        flush()
        del stack[upto:]

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        if m["text"] is not None:
            held.append(m["text"])
            continue
        if m["cdata"] is not None:
            held.append(m["cdata"].replace("&", "&amp;"))
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "p" or tag in _BLOCK:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                else:
                    flush()
            continue
        if tag in _VOID:
            if tag == "br" or tag == "wbr":
                held.append(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.start() if end else len(page)
            continue
        attrs = m["attrs"]
        if tag not in _BLOCK:
            if tag not in _DROP_TAGS:
                continue
        flush()
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in ("td", "th", "li", "button", "div", "article", "main", "section"):
                    break
        if tag in _SIBLINGS:
            ends, stops = _SIBLINGS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in stops:
                    break
        _, drop, root, prose = stack[-1] if stack else ("", False, False, False)
        is_root = not drop and _root(tag, attrs)
        any_root = any_root or is_root
        drop = drop or _boilerplate(tag, attrs, root)
        root = (root or is_root) and not drop
        stack.append((tag, drop, root, prose or tag in _PROSE_TAGS))
    close(0)
    kept = sum(len(t) for t, kind, _ in lines if kind != BOILERPLATE)
    if any_root and 2 * sum(len(t) for t, kind, root in lines if root and kind != BOILERPLATE) >= kept:
        # what lies outside the article is boilerplate; its loose lines (in no prose element) stay open
        return [(t, BOILERPLATE if not root else kind) for t, kind, root in lines]
    # no article, or teasers that hold the smaller part of the text
    return [(t, BOILERPLATE if kind == BOILERPLATE else OPEN) for t, kind, _ in lines]


def _rows(p: list[str], q: list[str]) -> list[int]:
    """Bit rows of the length table: in row i, bit j is clear where the longest
    common subsequence of ``p[:i]`` and ``q[:j + 1]`` is longer than that with
    ``q[:j]``."""
    where: dict[str, int] = {}
    for j, line in enumerate(q):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(q)) - 1
    rows = [full]
    for line in p:
        v = rows[-1]
        u = v & where.get(line, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def _lengths(row: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(p: list[str], q: list[str]) -> list[int]:
    """Positions in ``p`` on a longest common subsequence; long lists are
    halved first, so that the table stays small."""
    if not p or not q:
        return []
    if len(p) > 1 and len(p) * len(q) > _TABLE_BITS:
        mid, n = len(p) // 2, len(q)
        head = _lengths(_last(p[:mid], q), n)
        tail = _lengths(_last(p[mid:][::-1], q[::-1]), n)[::-1]
        cut = int((head + tail).argmax())
        return _aligned(p[:mid], q[:cut]) + [mid + i for i in _aligned(p[mid:], q[cut:])]
    rows, out = _rows(p, q), []
    i, j = len(p), len(q)
    while i and j:
        low = (1 << j) - 1
        if (rows[i] & low).bit_count() == (rows[i - 1] & low).bit_count():
            i -= 1
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def _last(p: list[str], q: list[str]) -> int:
    where: dict[str, int] = {}
    for j, line in enumerate(q):
        where[line] = where.get(line, 0) | 1 << j
    full = v = (1 << len(q)) - 1
    for line in p:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
    return v


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` on a longest common subsequence with ``b``."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    # only lines that occur on both sides can be aligned
    both = set(a[lo:x]) & set(b[lo:y])
    p = [i for i in range(lo, x) if a[i] in both]
    q = [line for line in b[lo:y] if line in both]
    return {*range(lo), *range(x, len(a)), *(p[i] for i in _aligned([a[i] for i in p], q))}


def template_lines(
    lines: list[str], kinds: list[int], sizes: list[int], others: list[list[str]]
) -> list[int]:
    """Open lines shared with the nearest page that is not a copy; ``others``:
    the neighbours' lines, nearest first."""
    if OPEN not in kinds:
        return []
    body = [i for i, kind in enumerate(kinds) if kind != BOILERPLATE]
    for other in others:
        shared = shared_lines(lines, other)
        if 5 * sum(sizes[i] for i in body if i not in shared) >= sum(sizes[i] for i in body):
            return sorted(i for i in shared if kinds[i] == OPEN)
    return []


def page_text(lines: list[tuple[str, int]], template: set[int]) -> str:
    return "\n".join(t for i, (t, kind) in enumerate(lines) if kind != BOILERPLATE and i not in template)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_outlines(rows: DataFrame) -> DataFrame:
    """``key, host, path, page_id, hashes, kinds, sizes``: the lines of each
    page as digests, their kinds and lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [read_lines(h) for h in b["html"]]
            out = b[["key", "host", "path", "page_id"]].astype({"page_id": "Int64"})
            out["hashes"] = [[_line_hash(t) for t, _ in lines] for lines in read]
            out["kinds"] = [[k for _, k in lines] for lines in read]
            out["sizes"] = [[len(t) for t, _ in lines] for lines in read]
            yield out

    schema = "key string, host string, path string, page_id long, hashes array<long>, kinds array<int>, sizes array<int>"
    return rows.mapInPandas(run, schema).dropDuplicates(["key"])


def template_of(outlines: DataFrame, neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """``key, template``: the lines to delete, for pages that have any."""
    order = ["host", "path", "page_id", "key"]
    width = int(outlines.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = (
        outlines.repartitionByRange(width, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    placed = cut_lineage(placed)
    # one row per range: where its pages begin in the whole order
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    begins = begins.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    at = F.col("begin") + F.col("place")
    numbered = placed.join(F.broadcast(begins), "part").withColumn("at", at).withColumn("own", F.floor(at / block))
    # a block also gets the pages next to its borders
    blocks = F.array_distinct(F.array(F.floor((at - neighbours) / block), F.col("own"), F.floor((at + neighbours) / block)))
    dealt = numbered.withColumn("block", F.explode(blocks)).drop("part", "place", "begin", "page_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pages = group.sort_values("at").to_dict("records")
        out = []
        for i, me in enumerate(pages):
            if me["own"] != me["block"] or OPEN not in me["kinds"]:
                continue
            near = sorted(
                (-_prefix(me["path"], pages[j]["path"]), abs(j - i), j)
                for j in range(max(0, i - neighbours), min(len(pages), i + neighbours + 1))
                if j != i and pages[j]["host"] == me["host"]
            )
            found = template_lines(
                list(me["hashes"]), list(me["kinds"]), list(me["sizes"]), [list(pages[j]["hashes"]) for _, _, j in near]
            )
            if found:
                out.append((me["key"], found))
        return pd.DataFrame(out, columns=["key", "template"])

    return dealt.groupBy("block").applyInPandas(run, "key string, template array<int>")


def extract_pages(
    pages: DataFrame, neighbours: int = NEIGHBOURS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["page_id", "url"]].astype({"page_id": "Int64"})
            out["text"] = [
                page_text(read_lines(h), set() if t is None else set(t)) for h, t in zip(b["html"], b["template"])
            ]
            yield out

    url = F.coalesce(F.col(url_col), F.lit(""))
    page_id = F.col(id_col).cast("long")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        page_id.alias("page_id"), F.col(url_col).alias("url"),
        F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"),
        html.alias("html"),
        F.md5(F.concat_ws("\x01", F.coalesce(page_id.cast("string"), F.lit("")), url, html).cast("binary")).alias("key"),
    )
    template = cut_lineage(template_of(page_outlines(rows), neighbours))
    return (
        rows.select("page_id", "url", "html", "key").join(template, "key", "left")
        .select("page_id", "url", "html", "template")
        .mapInPandas(run, "page_id long, url string, text string")
    )


def html_text_query(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))
