"""Operator 5, HTML extraction by nearest-URL page differencing.

A page becomes lines, one per block of text, each with what its markup says:
left out (scripts, styles, menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, known by element or role, or doubted by a word of class
or id where the page has a part that fewer such words surround: a wrapper named
``has-sidebar`` or an article named ``comments-open`` loses nothing),
kept (a paragraph, heading, list item, quotation or cell of the page's
article) or undecided (any other block; everything, where a page marks no
article).  The undecided lines are settled by differencing: the page is paired
with the page of nearest URL on its host, their lines are aligned by longest
common subsequence, and undecided lines of the alignment are deleted.  An
article's own paragraphs are not up for deletion, as quotations and licence
lines repeat between neighbours; and a page that leaves another no line of
its own, or shares more than half of what is not template, is its copy, from
which nothing can be learned, so the next nearest is taken.  Template are as
many lines as are shared even with the least like of the neighbours; where
those are more than half of the page, also of ``DRAWN`` pages drawn from the
whole host by hash, as all neighbours may be copies.  A page whose neighbours
are all copies is paired with the likest of those drawn pages; if they are
copies too, with pages ever further away, until the host has none left.

Nearest is the longest common path (in segments), then the least distance in
the order by host, path and row hash.  A distributed sort gives that order;
pages of equal lines on a host take one place;
cells of ``CELL`` consecutive pages, with ``NEAR`` neighbours on either side,
hold line hashes only, so a host of any size is dealt evenly.  A second scan
joins the deletions (a short list per page) to the pages and writes the texts.

Defined results: a null or empty page has no text; a null URL, or one without
a host, makes pages of host ''; a page alone on its host keeps its undecided
lines; a tag that no > ends is text, and broken pages take linear time; equal rows get the same result; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growret.llm.stored import stored

CELL = 512
NEAR = 8
DRAWN = 8
KEPT, UNDECIDED = 1, 0
EXTRACTED = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
BODY = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote figcaption td th caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie cookies consent gdpr notice "
    "alert comment comments reply replies respond discussion share sharing social related recommended newsletter "
    "subscribe subscription signup login popup modal overlay pagination pager widget skip".split()
)
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
_TO_THE_END = re.compile(r"<!--|<!\[CDATA\[")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s/=]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[^a-z]+")


def left_out(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Do the element's name or role say that it is not main text, and does its class or id make one doubt it?"""
    if tag in DROPPED or (tag == "header" and not inside):
        return True, False
    if not attributes or tag in ("html", "body"):
        return False, False
    if _HIDDEN.search(attributes):
        return True, False
    doubted = False
    for name, *value in _ATTRIBUTE.findall(attributes):
        words = _PART.split("".join(value).lower())
        name = name.lower()
        if name == "role" and not ROLES.isdisjoint(words):
            return True, False
        if name in ("class", "id") and tag not in BODY | {"main"} and not NAMES.isdisjoint(words):
            doubted = True
    return False, doubted


class Element(NamedTuple):
    """An open element: what holds for the text in it."""

    tag: str
    out: bool
    article: bool
    doubts: int  # elements around it, itself included, whose class or id is listed
    block: str  # the nearest element that isn't inline


OUTSIDE = Element("", False, False, 0, "")


def _end_open_tags(page: str) -> str:
    """``page`` with each < behind its last > as text, as no tag can end there; comments and CDATA run to the end."""
    last = page.rfind(">") + 1
    m = _TO_THE_END.search(page, last)
    cut = m.start() if m else len(page)
    return page[:last] + page[last:cut].replace("<", "&lt;") + page[cut:]


def page_lines(page: str) -> list[tuple[str, int]]:
    """Lines of a page that are not left out, each kept or undecided."""
    lines: list[tuple[str, int, bool, int]] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()  # how often each element is on the stack
    pieces: list[str] = []
    here = OUTSIDE
    articles: list[int] = []  # their doubts

    def flush() -> None:
        text = "".join(pieces)
        pieces.clear()
        if text := " ".join((html.unescape(text) if "&" in text else text).split()):
            lines.append((text, KEPT if here.article and here.block in BODY else UNDECIDED, here.article, here.doubts))

    def close(k: int) -> Element:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]
        return stack[-1] if stack else OUTSIDE

    page = _end_open_tags(page)
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not here.out:
            pieces.append(page[at : m.start() if m else n])
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA[") and not here.out:
                pieces.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, attributes = tag.lower(), m[3] if m[2] else m[6]
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[1] or m[4]:
            if opened[tag] > 0:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == tag:
                        here = close(k)
                        break
                    if tag in INLINE and stack[k].tag not in INLINE:
                        break  # an inline end never closes a block
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:  # a new block ends an open paragraph; an item ends the item before it
            closes = ("p", tag) if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else ("p",)
            if any(opened[t] > 0 for t in closes):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in closes:
                        here = close(k)
                        break
                    if stack[k].tag not in INLINE:
                        break
        left, doubted = left_out(tag, attributes, here.article)
        out, doubts, article = here.out or left, here.doubts + doubted, here.article
        if tag in ("article", "main") and not out:
            article = True
            articles.append(doubts)
        here = Element(tag, out, article, doubts, here.block if tag in INLINE else tag)
        stack.append(here)
        opened[tag] += 1
    flush()
    if articles:
        lines = [x for x in lines if x[2]]
    least = min(articles or [doubts for *_, doubts in lines], default=0)
    return [(text, state) for text, state, _, doubts in lines if doubts <= least]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (matches in order, ends found by bisection)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < min(len(a), len(b)) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    places: dict[int, list[int]] = {}
    for j in range(len(b) - end - 1, lo - 1, -1):
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i in range(lo, len(a) - end):
        for j in places.get(a[i], ()):
            k = bisect.bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(lo), *reversed(middle), *range(len(a) - end, len(a))]


def is_copy(lines: int, common: int, template: int) -> bool:
    """Is the page that shares ``common`` of a page's lines its copy, if ``template`` of them are its host's?"""
    return common == lines or 2 * (common - template) > lines - template


def _shared_path(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _located(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    rest = F.regexp_replace(url, "[?#].*$", "")
    host = F.lower(F.regexp_extract(rest, "^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1))
    path = F.regexp_replace(rest, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"), path.alias("path"),
        F.xxhash64("page_id", "url", "html").alias("row"),
    )


def deletions(pages: DataFrame) -> DataFrame:
    """``row, gone``: per page row hash, the numbers of its undecided lines that differencing deletes."""

    def outline(batches):
        for batch in batches:
            hashes, undecided = [], []
            for page in batch.column("html"):
                lines = page_lines(page.as_py() or "")
                hashes.append([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for t, _ in lines])
                undecided.append([k for k, (_, state) in enumerate(lines) if state == UNDECIDED])
            columns = [batch.column(c) for c in ("host", "path", "row")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(hashes, pa.list_(pa.int64())), pa.array(undecided, pa.list_(pa.int32()))],
                ["host", "path", "row", "lines", "undecided"],
            )

    def number(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * n, pa.int64()), pa.array(range(seen, seen + n), pa.int64())],
                [*batch.schema.names, "part", "place"],
            )
            seen += n

    outlines = pages.select("host", "path", "row", "html").mapInArrow(
        outline, "host string, path string, row long, lines array<long>, undecided array<int>"
    )
    outlines = stored(outlines.withColumn("list", F.xxhash64("host", "lines")))
    # pages of equal lines on a host have equal partners, so one stands for all
    lead, unsure = F.min(F.struct("path", "row")).alias("lead"), F.max(F.size("undecided") > 0).alias("unsure")
    distinct = outlines.groupBy("host", "list").agg(lead, F.first("lines").alias("lines"), unsure)
    distinct = distinct.select("host", "lead.path", "lead.row", "list", "lines", "unsure")
    kind = "host string, path string, row long, list long, lines array<long>, unsure boolean"
    ordered = distinct.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    ordered = stored(ordered.mapInArrow(number, kind + ", part long, place long"))
    offsets, total = {}, 0
    for r in sorted(ordered.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row per partition
        offsets[r["part"]], total = total, total + r["n"]
    starts = ordered.sparkSession.createDataFrame(list(offsets.items()) or [(0, 0)], "part long, first long")
    ranked = ordered.join(starts, "part").withColumn("rank", F.col("first") + F.col("place")).drop("part", "place", "first")
    cell = F.floor(F.col("rank") / CELL)
    cells = F.array_distinct(F.array(cell, F.floor((F.col("rank") - NEAR) / CELL), F.floor((F.col("rank") + NEAR) / CELL)))
    dealt = ranked.withColumn("home", cell).withColumn("cell", F.explode(cells))

    def difference(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["rank"] is None, r["rank"]))
        lists, shared, leasts = [], [], []
        drawn: dict[str, list[dict]] = {}
        while rows and rows[-1]["rank"] is None:
            r = rows.pop()
            drawn.setdefault(r["host"], []).append(r)
        paths = [r["path"].split("/") for r in rows]
        for k, r in enumerate(rows):
            if r["home"] != r["cell"] or not r["unsure"]:
                continue
            near = [j for j in range(max(0, k - NEAR), min(len(rows), k + NEAR + 1)) if j != k and rows[j]["host"] == r["host"]]
            near.sort(key=lambda j: (-_shared_path(paths[k], paths[j]), abs(j - k), j))
            common = [common_lines(r["lines"], rows[j]["lines"]) for j in near]
            n, least = len(r["lines"]), min([len(c) for c in common], default=len(r["lines"]))
            if 2 * least > n:  # a large template, or copies all around
                others = sorted(drawn.get(r["host"], ()), key=lambda d: (-_shared_path(paths[k], d["path"].split("/")), d["path"], d["list"]))
                common += [common_lines(r["lines"], d["lines"]) for d in others]
                least = min([len(c) for c in common], default=n)
            lists.append(r["list"])
            shared.append(next((c for c in common if not is_copy(n, len(c), least)), None))
            leasts.append(least)
        return pa.table({"list": pa.array(lists, pa.int64()), "common": pa.array(shared, pa.list_(pa.int32())), "least": pa.array(leasts, pa.int32())})

    hosts = dealt.select("host", "cell").distinct()
    picked = F.pmod(F.col("row"), F.lit(DRAWN))
    drawn = ranked.groupBy("host", picked.alias("pick")).agg(F.min(F.struct(F.xxhash64("row").alias("h"), "path", "list", "lines")).alias("page"))
    dealt = dealt.unionByName(drawn.select("host", "page.path", "page.list", "page.lines").join(hosts, "host"), allowMissingColumns=True)
    found = stored(dealt.groupBy("cell").applyInArrow(difference, "list long, common array<int>, least int"))
    settled = found.filter("common IS NOT NULL").select("list", "common")
    settled = settled.unionByName(_further(found.filter("common IS NULL").select("list", "least"), ranked))
    own = F.array_sort(F.array_intersect("common", "undecided"))
    found = outlines.join(settled, "list").select("row", own.alias("gone")).filter(F.size("gone") > 0)
    return found.groupBy("row").agg(F.min("gone").alias("gone"))


def _further(left: DataFrame, ranked: DataFrame) -> DataFrame:
    """``list, common`` for pages whose near and drawn pages are all copies, from ever further pages of the host."""
    ends = ranked.groupBy("host").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    left = left.join(ranked.select("host", "path", "list", "lines", "rank"), "list").join(ends, "host")
    other = ranked.select(F.col("rank").alias("other"), F.col("path").alias("other_path"), F.col("lines").alias("other_lines"))
    kind = "list long, n int, least int, common array<int>, nearness array<long>"
    out, reach = left.sparkSession.createDataFrame([], "list long, common array<int>"), NEAR

    def compare(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                common = common_lines(r["lines"], r["other_lines"])
                if len(common) < len(r["lines"]):
                    alike = _shared_path(r["path"].split("/"), r["other_path"].split("/"))
                    rows.append((r["list"], len(r["lines"]), min(r["least"], len(common)), common, [-alike, abs(r["other"] - r["rank"]), r["other"]]))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                names = [c.split()[0] for c in kind.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    while True:
        left = stored(left.filter((F.col("rank") - reach > F.col("low")) | (F.col("rank") + reach < F.col("high"))))
        if left.isEmpty():
            return out
        far, rank = 4 * reach, F.col("rank")
        span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        ranks = F.concat(span(F.greatest("low", rank - far), rank - reach - 1), span(rank + reach + 1, F.least("high", rank + far)))
        pairs = left.withColumn("other", F.explode(ranks)).join(other, "other")
        met = stored(pairs.mapInArrow(compare, kind))
        least = met.groupBy("list").agg(F.min("least").alias("template"))
        size, template = F.size("common"), F.col("template")
        partners = met.join(least, "list").filter(2 * (size - template) <= F.col("n") - template)
        best = stored(partners.groupBy("list").agg(F.min(F.struct("nearness", "common"))["common"].alias("common")))
        out = out.unionByName(best)
        left = left.join(best, "list", "left_anti").join(least, "list", "left")
        left = left.withColumn("least", F.least("least", "template")).drop("template")
        reach = far


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``."""
    pages = _located(pages)
    gone = stored(deletions(pages))

    def texts(batches):
        for batch in batches:
            found = []
            for page, deleted in zip(batch.column("html"), batch.column("gone").to_pylist()):
                lines, drop = page_lines(page.as_py() or ""), set(deleted or ())
                found.append("\n".join(t for k, (t, _) in enumerate(lines) if k not in drop))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    both = pages.select("page_id", "url", "html", "row").join(gone, "row", "left")
    return both.select("page_id", "url", "html", "gone").mapInArrow(texts, EXTRACTED)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
