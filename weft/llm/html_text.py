"""Main text of web pages: nearest-URL page differencing, and what the markup itself declares.

Each page becomes a list of text lines (one per block element) with a zone: ``main`` inside
article or main elements, ``chrome`` inside elements that declare themselves menus, headers,
footers, sidebars, notices, adverts, forms or comments, and ``open`` for the rest.

Differencing: the distinct line sequences of a host are put in order of their URL path (of
copies, the first one's) and each is paired with the neighbour whose path shares the longer
prefix with its own.  The two line sequences are aligned by longest common subsequence, and
lines in the alignment are the host's template: they are deleted, in copies alike.

Which lines count: where a page declares a main zone, that is the text, whole, since a
passage that two articles of a host share is still theirs.  Otherwise it is the open lines
that the differencing did not delete.  (Differencing alone cannot give right results here:
adverts and menus differ between neighbours and articles may repeat.)
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import staged

MAIN, OPEN, CHROME = 0, 1, 2

#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template svg math iframe object canvas head select textarea button audio video".split())
#: Elements that are page furniture by their name.
FURNITURE = frozenset("nav aside footer form menu dialog".split())
#: Words in class, id or role that declare furniture.
DECLARED = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|banner|footer|sidebar|aside|ads?|"
                      r"advert|adverts|advertisement|sponsor|sponsored|promo|promoted|cookies?|consent|notice|popup|modal|"
                      r"newsletter|subscribe|comments?|disqus|replies|respond|related|share|sharing|social|search|"
                      r"complementary|contentinfo|skip)(?:$|[\s_-])", re.I)
#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
                   "section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new block of the same kind closes.
CLOSES = {"p", "li", "dd", "dt", "option", "tr", "td", "th"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
#: Name and value of an attribute; a value is consumed whole.
ATTRIBUTE = re.compile(r"([^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A word of class or id by which an article element is a reader's comment.
COMMENT = re.compile(r"(?:^|\s)(?:(?:div|user|reader)[_-])?(?:comments?|repl(?:y|ies)|disqus)(?:[_-]+(?:area|block|body|box|card|container|content|"
                     r"depth|entry|item|list|node|post|reply|section|text|thread|wrap|wrapper|\d+))*(?:$|\s)", re.I)
#: Blanks in HTML text; a no-break space counts as white space too.
BLANKS = re.compile(r"\s+")


def _zone(tag: str, attrs: str, inside: int) -> int:
    if tag in FURNITURE or (tag == "header" and inside != MAIN):
        return CHROME
    main = tag in ("article", "main")
    if "=" in attrs or "hidden" in attrs.lower():
        said: dict = {}
        for m in ATTRIBUTE.finditer(attrs):
            said.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # the first of a name counts
        if "hidden" in said or said.get("aria-hidden", "").strip().lower() == "true":
            return CHROME
        main = main or said.get("role", "").strip().lower() in ("main", "article")
        declared = COMMENT if main else DECLARED
        names = ("class", "id") if main else ("class", "id", "role")
        if tag not in ("body", "main") and any(declared.search(said.get(k, "")) for k in names):
            return CHROME
    return MAIN if main and inside != CHROME else inside


def lines(page: str) -> tuple[list[str], list[int]]:
    """Text lines of a page in order and their zones; white space inside a line is one space."""
    out, zones, buffer = [], [], []
    stack: list[tuple[str, int]] = []
    zone, at, end = OPEN, 0, len(page)

    def flush():
        if buffer:
            text = BLANKS.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append(text)
                zones.append(zone)

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in DROPPED and not m[1]:
            if tag in BLOCKS or tag in ("head", "textarea", "select", "button"):
                flush()
            if not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else _body(page, at) if tag == "head" else end
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if m[1]:
            names = [s[0] for s in stack]
            if tag in names:
                cut = len(names) - 1 - names[::-1].index(tag)
                # a stray end tag inside a zone doesn't close what lies around the zone
                if tag in BLOCKS or all(n not in BLOCKS for n in names[cut:]):
                    zone = stack[cut][1]
                    del stack[cut:]
        elif not m[3].endswith("/"):
            if tag in CLOSES and stack and stack[-1][0] == tag:
                zone = stack.pop()[1]
            stack.append((tag, zone))
            zone = _zone(tag, m[3], zone)
    flush()
    return out, zones


def _body(page: str, at: int) -> int:
    m = re.compile(r"<body[\s>]", re.I).search(page, at)
    return m.start() if m else len(page)


#: Cells of an alignment table that are held at once.
CELLS = 1 << 22


def _grow(row: np.ndarray, line, y: np.ndarray) -> np.ndarray:
    """The next row of the table: longest common lengths with one line more on the left side."""
    return np.maximum(row, np.append(0, np.maximum.accumulate(np.where(y == line, row[:-1] + 1, 0)))) if len(y) else row


def _align(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in ``x`` of a longest common subsequence.  A large table is halved: the best split
    of ``y`` for the two halves of ``x`` follows from a last row from either side."""
    if not len(x) or not len(y):
        return []
    if len(x) > 1 and len(x) * len(y) > CELLS:
        half = len(x) // 2
        up, down = np.zeros(len(y) + 1, np.int64), np.zeros(len(y) + 1, np.int64)
        for line in x[:half]:
            up = _grow(up, line, y)
        for line in x[:half - 1:-1]:
            down = _grow(down, line, y[::-1])
        cut = int(np.argmax(up + down[::-1]))
        return _align(x[:half], y[:cut]) + [half + i for i in _align(x[half:], y[cut:])]
    rows = [np.zeros(len(y) + 1, np.int64)]
    for line in x:
        rows.append(_grow(rows[-1], line, y))
    found, j = [], len(y)
    for i in range(len(x), 0, -1):
        if rows[i][j] == rows[i - 1][j]:
            continue
        found.append(i - 1)
        j = int(np.searchsorted(rows[i], rows[i][j])) - 1  # the first place that reaches this length is its match
    return found[::-1]


def common(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``a`` of a longest common subsequence of two sequences of line hashes."""
    n, m, head, tail = len(a), len(b), 0, 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[head:n - tail], b[head:m - tail]
    live = np.flatnonzero(np.isin(x, y))  # no other line can be in it
    inner = [head + int(live[i]) for i in _align(x[live], y[np.isin(y, x)])]
    return [*range(head), *inner, *range(n - tail, n)]


def _url_parts() -> list:
    """Host and path of a URL, lower-cased; scheme, query, fragment and trailing slashes aside."""
    url = F.lower(F.regexp_replace(F.regexp_replace(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[?#].*$", ""))
    return [F.regexp_extract(url, r"^([^/]*)", 1).alias("host"),
            F.regexp_replace(F.regexp_extract(url, r"^[^/]*(.*)$", 1), r"/+$", "").alias("path")]


def neighbours(keys: DataFrame) -> DataFrame:
    """``keys(uid, host, path)``, uid unique -> ``(uid, partner)`` for each page whose host has
    another one: of the pages next to it in the order of host and path, the one whose path
    shares more with its own (a tie: the one before).

    The order is made by ranges over all tasks, so a host of any size is spread; a page's
    place in it follows from the sizes of the ranges, and its neighbours by equi-join."""
    ordered = staged(keys.where("host is not null and host <> ''").repartitionByRange("host", "path", "uid")
                     .sortWithinPartitions("host", "path", "uid").withColumn("at", F.monotonically_increasing_id())
                     .withColumn("part", F.expr("shiftright(at, 33)")), "url-order")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    placed = ordered.join(F.broadcast(base), "part").select(
        "uid", "host", "path", (F.col("base") + F.col("at") - F.shiftleft("part", 33)).alias("g"))
    side = lambda d, name: placed.select((F.col("g") - d).alias("g"), *[F.col(c).alias(f"{name}_{c}") for c in ("uid", "host", "path")])
    both = placed.join(side(-1, "p"), "g", "left").join(side(1, "n"), "g", "left")

    def shared(name):
        longest = F.least(F.length("path"), F.length(f"{name}_path"))
        heads = F.filter(F.sequence(F.lit(0), longest),
                         lambda i: F.substring("path", F.lit(1), i) == F.substring(f"{name}_path", F.lit(1), i))
        return F.when(F.col(f"{name}_host") == F.col("host"), F.size(heads))

    both = both.withColumn("p_same", F.coalesce(shared("p"), F.lit(0))).withColumn("n_same", F.coalesce(shared("n"), F.lit(0)))
    return both.where("p_same > 0 or n_same > 0").select(
        "uid", F.when(F.col("n_same") > F.col("p_same"), F.col("n_uid")).otherwise(F.col("p_uid")).alias("partner"))


def template_lines(pages: DataFrame) -> DataFrame:
    """``pages(uid, url, html)`` -> ``(uid, has_main, shared array<int>)``: places of the lines that a
    page shares, in order, with the nearest page of its host that has other lines."""
    def sequences(batches):
        for b in batches:
            got = [lines(h) for h in b.column(3).to_pylist()]
            hashes = [np.array([xxhash.xxh64_intdigest(t) for t in text], np.uint64).view(np.int64) for text, _ in got]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(hashes, pa.list_(pa.int64())), pa.array([MAIN in z for _, z in got], pa.bool_()),
                 pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in hashes], pa.binary())],
                names=["uid", "host", "path", "seq", "has_main", "sig"])

    seqs = staged(pages.select("uid", *_url_parts(), "html").mapInArrow(
        sequences, "uid string, host string, path string, seq array<long>, has_main boolean, sig binary").dropDuplicates(["uid"]), "line-hashes")
    first = seqs.groupBy("host", "sig").agg(F.min(F.struct("path", "uid")).alias("first"))  # one page of each line sequence of a host
    pairs = neighbours(first.select("first.uid", "host", "first.path"))
    other = seqs.select(F.col("uid").alias("partner"), F.col("seq").alias("other"))

    def diff(batches):
        for b in batches:
            same = [common(np.array(x, np.int64), np.array(y, np.int64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.list_(pa.int32()))],
                                             names=["host", "sig", "shared"])

    told = (pairs.join(seqs.select("uid", "host", "sig", "seq"), "uid").join(other, "partner")
            .select("host", "sig", "seq", "other").mapInArrow(diff, "host string, sig binary, shared array<int>"))
    return seqs.join(told, ["host", "sig"]).select("uid", "has_main", "shared")


def main_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``page_id, url, text, n_chars, n_template`` for every row of ``pages`` (``page_id, url, html``).

    ``text``: lines joined by a line feed, empty if there are none; ``n_template``: lines deleted as
    the host's template (0 where the page declares its main text).  A null html counts as
    empty; a page without URL, or whose host has no page with other lines, has no neighbour, so
    nothing of it is deleted; rows that repeat get equal answers; an empty table gives no rows.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("uid", F.concat_ws(".", F.col("page_id").cast("string"), F.hex(F.xxhash64("url", "html"))))
    deleted = staged(template_lines(src).where("not has_main and size(shared) > 0").select("uid", "shared"), "template-lines")

    def extract(batches):
        for b in batches:
            out, gone = [], []
            for html, shared in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                text, zones = lines(html)
                if MAIN in zones:
                    out.append("\n".join(t for t, z in zip(text, zones) if z == MAIN))
                    gone.append(0)
                else:
                    drop = set(shared or ())
                    out.append("\n".join(t for i, (t, z) in enumerate(zip(text, zones)) if z == OPEN and i not in drop))
                    gone.append(len(drop))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(gone, pa.int32())],
                names=["page_id", "url", "text", "n_chars", "n_template"])

    return src.join(deleted, "uid", "left").select("page_id", "url", "html", "shared").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long, n_template int")
