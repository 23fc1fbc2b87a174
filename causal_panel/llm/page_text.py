"""HTML extraction by markup roles and nearest-URL page differencing.

A page becomes lines, one per block. Lines inside elements whose tag, role, class
or id names a menu, header, footer, sidebar, notice, advert, form or comment are
not text. But for comments and adverts, a name drops no element that holds ``article``
or ``main``; inside one only a role or a whole class does that says advert, comment, menu, notice or the like
(INSIDE), never an id. A name that is only a part of a class or id ("site-footer",
"has-sidebar") drops, on a page without ``article`` and ``main``, no element with most
of its letters. Lines inside
``article`` or ``main`` are text. For the rest markup does not tell, and the site does: pages of a host are paired with their neighbours in
the order of URL paths, the lines of both are aligned by a longest common
subsequence, and lines that both have are deleted. A neighbour that has all of a
page's lines is a copy of it, not a template, and deletes nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causal_panel.llm.text import as_text, spread
from causal_panel.session import staged

BREAKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside button dialog footer form head iframe menu nav noscript object select svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer "
    "disqus footer form masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related respond share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget widgets".split()
)
TEXT = frozenset(("article", "main"))
WITH = frozenset("has have hide no not with without".split())  # "has-sidebar" is no sidebar

#: Whole classes that drop an element inside ``article`` or ``main`` too.
INSIDE = frozenset(
    "ad ads adbox advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus menu modal nav "
    "navbar navigation newsletter notice notices popup promo promoted respond sidebar sponsor sponsored subscribe".split()
)
#: Whole classes and ids of comments and adverts: they drop an element even if it holds an ``article``, as some sites have each comment in one.
ALWAYS = frozenset("ad ads adbox advert adverts advertisement advertising comment comments commentlist disqus respond sponsor sponsored".split())
PART, WHOLE = 1, 2  # how a name speaks against an element that may still hold the text

# Attributes by state: a value follows a "=", quoted or up to white space; quotes elsewhere are characters like others.
_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"'][^\s<>]*)|[^<>=]|=)*+)>|<[!?][^>]*>", re.S | re.I
)
_attribute = re.compile(r"([^\s=/<>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s<>]+)))?|=\s*(?:\"[^\"]*\"|'[^']*')")
_parts = re.compile(r"[a-z]+")


def _named(tag: str, attributes: str, inside_text: bool) -> tuple[bool, int]:
    """Whether an element is dropped, and whether a PART of a class or id, or the WHOLE of one or a role, drops it if it holds no text."""
    if tag in DROPPED and tag != "form" or tag == "header" and not inside_text:
        return True, 0
    named = PART if tag == "form" else 0  # some sites have the whole page in one form
    if tag == "form" and inside_text:
        return True, 0
    if attributes and tag not in TEXT and tag not in ("html", "body"):
        for name, *values in _attribute.findall(attributes):
            name = name.lower()
            if name not in ("class", "id", "role"):
                continue
            tokens = "".join(values).lower().split()
            if inside_text:
                if name != "id" and any(t in (ROLES if name == "role" else INSIDE) for t in tokens):
                    return True, 0
            elif name != "role" and any(t in ALWAYS for t in tokens):
                return True, 0
            elif any(t in (ROLES if name == "role" else NAMES) for t in tokens):
                named = WHOLE
            elif name != "role" and not named:
                runs = [_parts.findall(t) for t in tokens]
                named = PART if any(b in NAMES and a not in WITH for found in runs for a, b in zip(["", *found], found)) else 0
    return False, named


def page_lines(source: str) -> list[tuple[str, bool]]:
    """(line, whether markup says that it is text) of every block outside dropped elements, in page order."""
    lines: list[tuple[list[tuple[str, tuple[int, ...]]], bool]] = []
    parts: list[tuple[str, tuple[int, ...]]] = []
    opened: list[tuple[str, bool, int]] = []  # block elements, and inline ones below or at a dropped or partly named one
    holds: list[bool] = []  # for each named element whether it holds article or main
    whole_name: list[bool] = []
    around: tuple[int, ...] = ()
    dropped = text = at = 0

    def flush() -> None:
        if parts:
            lines.append((parts[:], text > 0))
            parts.clear()

    def close(depth: int) -> None:
        nonlocal dropped, text, around
        for tag, drop, part in opened[depth:]:
            dropped -= drop
            text -= tag in TEXT
            if part >= 0:
                around = around[:-1]
        del opened[depth:]

    for m in _token.finditer(source):
        if not dropped and m.start() > at:
            parts.append((source[at:m.start()], around))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        breaks = tag in BREAKS
        if breaks:
            flush()
        elif tag in ("br", "td", "th"):
            parts.append((" ", ()))
        if m[2]:
            depth = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == tag), -1)
            if depth >= 0:
                close(depth)
            continue
        if tag in VOID:
            continue
        if breaks and opened and opened[-1][0] == "p":  # a block ends an open paragraph
            close(len(opened) - 1)
        if tag == "body" and any(t == "head" for t, _, _ in opened):
            close(next(i for i, (t, _, _) in enumerate(opened) if t == "head"))
        drop, part = _named(tag, m[4], text > 0)
        if tag in TEXT and not dropped:
            for k in around:
                holds[k] = True
        if breaks or drop or part or dropped or around:
            opened.append((tag, drop, len(holds) if part else -1))
            if part:
                around += (len(holds),)
                holds.append(False)
                whole_name.append(part == WHOLE)
            dropped += drop
            text += tag in TEXT
    if not dropped:
        parts.append((source[at:], around))
    flush()
    if holds and not any(text for _, text in lines):
        letters, whole = [0] * len(holds), 0
        for x, names in (part for found, _ in lines for part in found):
            size = len("".join(x.split()))
            whole += size
            for k in names:
                letters[k] += size
        holds = [2 * n > whole and not strict for n, strict in zip(letters, whole_name)]

    def kept(found: list[tuple[str, tuple[int, ...]]]) -> str:
        return "".join(x for x, names in found if all(holds[k] for k in names))

    done = ((" ".join(html.unescape(kept(found)).split()), text) for found, text in lines)
    return [(line, text) for line, text in done if line]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``, by bit vectors as wide as ``a``."""
    if len(a) * len(b) > 1 << 31:  # halve b where both halves have most in common with parts of a: memory stays linear
        middle = len(b) // 2
        head, tail = _lengths(a, b[:middle]), _lengths(a[::-1], b[middle:][::-1])
        cut = max(range(len(a) + 1), key=lambda i: head[i] + tail[len(a) - i])
        return common_lines(a[:cut], b[:middle]) + [cut + i for i in common_lines(a[cut:], b[middle:])]
    rows = list(_rows(a, b))
    found, i, j = [], len(a), len(b)
    while i and j:
        bit = 1 << i - 1
        if rows[j] & bit:
            i -= 1
        elif not rows[j - 1] & bit:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append(i)
    return found[::-1]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of ``b``: bit i is 0 where the subsequence grows with line i of ``a``."""
    places: dict[int, int] = {}
    for i, line in enumerate(a):
        places[line] = places.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    yield row
    for line in b:
        hit = row & places.get(line, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> list[int]:
    row = 0
    for row in _rows(a, b):
        pass
    out = [0]
    for i in range(len(a)):
        out.append(out[-1] + (not row >> i & 1))
    return out


PARSED = "page_key long, page_id string, url string, host string, path string, lines array<string>, open array<int>"


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for url, source in zip(frame["url"], frame["html"]):
            lines = page_lines(source or "")
            try:
                parts = urlsplit(url or "")
                host, path = parts.netloc.lower(), parts.path.rstrip("/")
            except ValueError:  # not an address: a host of its own
                host, path = url, ""
            rows.append((host, path, [x for x, _ in lines], [i for i, (_, text) in enumerate(lines) if not text]))
        out = pd.DataFrame(rows, columns=["host", "path", "lines", "open"], index=frame.index)
        yield pd.concat([frame[["page_key"]], frame[["page_id"]], frame[["url"]], out], axis=1)


def _neighbours(order: DataFrame) -> DataFrame:
    """(page_key, other) for the pages before and after each page in the order of host, path and key.

    Pages are cut into ranges, so a host may have any number of pages; the
    first and last page of each range meet in a table of two rows per range.
    """
    n = int(order.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = order.repartitionByRange(n, "host", "path", "page_key").sortWithinPartitions("host", "path", "page_key")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for frame in frames:
            rows = []
            for now in zip(frame["host"], frame["path"], frame["page_key"]):
                if before is None:
                    rows.append((*now, None, True))
                elif before[0] == now[0]:
                    rows += [(None, None, now[2], before[2], False), (None, None, before[2], now[2], False)]
                before = now
            yield _walked(rows)
        if before is not None:
            yield _walked([(*before, None, True)])

    columns = ["host", "path", "page_key", "other", "edge"]
    _walked = lambda rows: pd.DataFrame(rows, columns=columns, dtype=object)
    walked = staged(ranges.mapInPandas(walk, "host string, path string, page_key long, other long, edge boolean"), "page-pairs")
    ends = walked.filter("edge").select("host", "path", "page_key").distinct()
    by_host = W.partitionBy("host").orderBy("path", "page_key")
    ends = ends.select("page_key", F.array(F.lag("page_key").over(by_host), F.lead("page_key").over(by_host)).alias("both"))
    ends = ends.select("page_key", F.explode("both").alias("other"))
    return walked.filter("NOT edge").select("page_key", "other").unionByName(ends.filter("other IS NOT NULL")).distinct()


def _shared(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in pairs:
        rows = []
        for key, mine, place, theirs in zip(frame["page_key"], frame["hashes"], frame["open"], frame["others"]):
            mine, theirs = list(mine), list(theirs)
            found = common_lines(mine, theirs)
            if len(found) < len(mine):
                wanted = set(place)
                rows.append((key, [i for i in found if i in wanted]))
        yield pd.DataFrame(rows, columns=["page_key", "gone"]).astype({"page_key": "int64"})


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html).

    Lines are trimmed, white space inside is one space, character references are
    decoded, lines are joined by one line break. A null or empty page has an
    empty text. A null url is a host of its own. Repeated rows get equal texts;
    other columns are ignored.
    """
    keyed = pages.select("page_id", "url", "html").withColumn("page_key", F.xxhash64("page_id", "url", "html"))
    parsed = staged(keyed.withColumn("page_id", as_text("page_id")).mapInPandas(_parse, PARSED), "pages")
    named = lambda pages, lines: pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.array_join(lines, "\n").alias("text"))
    sure = named(parsed.filter(F.size("open") == 0), F.col("lines"))  # markup decides on every line
    unsure = parsed.filter(F.size("open") > 0)
    order = parsed.select("host", "path", "page_key").distinct()
    hashed = parsed.select("page_key", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), "open").dropDuplicates(["page_key"])
    others = hashed.select(F.col("page_key").alias("other"), F.col("hashes").alias("others"))
    pairs = hashed.filter(F.size("open") > 0).join(_neighbours(order), "page_key").join(others, "other")
    gone = spread(pairs.select("page_key", "hashes", "open", "others")).mapInPandas(_shared, "page_key long, gone array<int>")
    gone = gone.groupBy("page_key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))  # at most two rows a key
    kept = F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    return sure.unionByName(named(unsure.join(gone, "page_key", "left"), kept))
