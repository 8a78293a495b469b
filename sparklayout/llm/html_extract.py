"""Main text of web pages by differencing with the page of the nearest URL.

Each page is aligned, line by line (a line is one block's text), with a page of the path next to its own on the
same host by their longest common subsequence; lines that both have are the site's, not the page's, and go. Two
things are settled by markup instead, because differences alone get them wrong: blocks in menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles go even where they vary from page to page; and lines
inside an article or main element stay even where another article says the same.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklayout.functions.ranking import global_rank
from sparklayout.llm.common import slices
from sparklayout.llm.url_filter import host_of, path_of
from sparklayout.sources.work import materialize

#: A comment or declaration, or a tag with its name and attributes.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {x: re.compile(rf"</{x}\s*[^>]*>|\Z", re.I) for x in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg")}
#: Elements that run on with the text around them; all others begin a new line.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav footer aside form button select option dialog menu object video audio canvas fieldset".split())
_CONTENT = frozenset("article main".split())
#: Words in class, id or role that mark what isn't the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices alert comment comments reply replies "
    "respond disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay "
    "widget contentinfo complementary search pagination pager toolbar copyright".split()
)
_HEADER_MARKS = frozenset("header masthead topbar".split())

_KEYS = ("page_id", "url", "host", "path")


def _flags(name: str, attributes: str, in_content: bool) -> bool:
    """Whether an element holds something else than the article."""
    if name in _DROPPED or (name == "header" and not in_content):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    words = {w for m in _ATTRIBUTE.finditer(attributes) for w in re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())}
    return bool(words & _MARKS) or (not in_content and bool(words & _HEADER_MARKS))


def lines_of(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, dropped by markup, inside an article or main element) for each block that has text."""
    out: list[tuple[str, bool, bool]] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, content

    def flush() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            dropped, content = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            out.append((text, dropped, content))

    at, page = 0, page or ""
    while match := _MARKUP.search(page, at):
        pieces.append(page[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            if any(x[0] == name for x in stack):
                if name not in _INLINE or stack[-1][1]:
                    flush()
                while stack.pop()[0] != name:
                    pass
            elif name not in _INLINE:
                flush()
            continue
        if name in _RAW:
            if not match[0].endswith("/>"):
                at = _RAW[name].search(page, at).end()
            pieces.append("" if name in _INLINE else " ")
            continue
        if name not in _INLINE:
            flush()
            while stack and name not in _VOID and stack[-1][0] in _INLINE and any(x[0] == "p" for x in stack):
                stack.pop()
            if stack and stack[-1][0] == "p" and name not in _VOID:
                stack.pop()
        if name in _VOID or match[0].endswith("/>"):
            continue
        dropped, content = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        flagged = _flags(name, match[3], content)
        if flagged and name in _INLINE:
            flush()
        stack.append((name, dropped or flagged, content or name in _CONTENT))
    pieces.append(page[at:])
    flush()
    return out


def common_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal ends belong to it; of what is between, lines that only one side has are left out, and of the longest common subsequences of
    the rest the one with the lexicographically least places in ``a`` is taken, whatever the number of lines.
    """
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a and lo < hi_b and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    found = {*range(lo), *range(hi_a, len(a))}
    times_a, times_b = Counter(a[lo:hi_a]), Counter(b[lo:hi_b])
    at = [i for i in range(lo, hi_a) if a[i] in times_b]
    left, right = [a[i] for i in at], [x for x in b[lo:hi_b] if x in times_a]
    found.update(at[i] for i in _least_places(left, right))
    return found


def _least_places(a: list, b: list) -> list[int]:
    """The lexicographically least places in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Row i has a bit for each line of ``b``, from the last on: 0 where one more line of ``b`` lengthens what it has in common with
    a[i:]. A line of ``a`` updates all bits at once. Rows are made from the end, and some of them kept; the others are
    made again, a stretch at a time, when ``a`` is then gone through from the start.
    """
    n, m = len(a), len(b)
    where: dict = {}
    places: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << (m - 1 - j)
        places.setdefault(x, []).append(j)
    whole = (1 << m) - 1

    def longer(row: int, x: str) -> int:
        hit = row & where[x]
        return (row + hit | row - hit) & whole

    step = isqrt(n) + 1
    row, kept = whole, {n: whole}
    for i in range(n - 1, -1, -1):
        row = longer(row, a[i])
        if i % step == 0:
            kept[i] = row
    left = m - row.bit_count()
    out: list[int] = []
    last = -1
    for start in range(0, n, step):
        end = min(n, start + step)
        rows = [kept[end]]
        for i in range(end - 1, start, -1):
            rows.append(longer(rows[-1], a[i]))
        for i in range(start, end):
            if not left:
                return out
            after = rows.pop()
            at = bisect_right(places[a[i]], last)
            if at == len(places[a[i]]):
                continue
            j = places[a[i]][at]
            rest = m - 1 - j
            if rest - (after & ((1 << rest) - 1)).bit_count() + 1 == left:
                out.append(i)
                last, left = j, left - 1
    return out


def main_text(lines: list[tuple[str, bool, bool]], other: list[tuple[str, bool, bool]] | None) -> str:
    """Blocks that stay, joined by one space: not dropped by markup, and not the other page's unless in an article."""
    shared = common_lines([x[0] for x in lines], [x[0] for x in other]) if other is not None else set()
    return " ".join(text for i, (text, dropped, content) in enumerate(lines) if not dropped and (content or i not in shared))


def _parsed(rows: DataFrame, whole: bool) -> DataFrame:
    """page_id, url, host, path, keys (a 64-bit hash of each line) and, if ``whole``, inside (whether a content element
    holds the line) and texts (of the lines that markup lets stay; null for the others)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                keys, marks, texts = [], [], []
                for page in part.column("html").to_pylist():
                    lines = lines_of(page)
                    hashes = [xxhash.xxh3_64_intdigest(x[0].encode("utf-8", "surrogatepass")) for x in lines]
                    keys.append(np.array(hashes, np.uint64).view(np.int64))
                    if whole:
                        marks.append([content for _, _, content in lines])
                        texts.append([None if dropped else t for t, dropped, _ in lines])
                columns = [*(part.column(c) for c in _KEYS), pa.array(keys, pa.list_(pa.int64()))]
                if whole:
                    columns += [pa.array(marks, pa.list_(pa.bool_())), pa.array(texts, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*_KEYS, "keys", *(("inside", "texts") if whole else ())])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in _KEYS) + ", keys array<bigint>"
    return rows.mapInArrow(run, schema + (", inside array<boolean>, texts array<string>" if whole else ""))


def _partners(rows: DataFrame) -> DataFrame:
    """(host, path, partner): the hashed lines of the last page (by url, id) of the host's path before this one,
    or of the first page of the path after it where there is none before; paths without either are left out."""
    page = F.struct("url", "page_id", "keys")
    ends = _parsed(rows, False).groupBy("host", "path").agg(F.min(page)["keys"].alias("first"), F.max(page)["keys"].alias("last"))
    paths = materialize(ends, "paths")
    ranked = materialize(global_rank(paths.select("host", "path"), ["host", "path"]), "path_ranks")
    before = ranked.select("host", F.col("path").alias("before"), (F.col("rank") + 1).alias("rank"))
    after = ranked.select("host", F.col("path").alias("after"), (F.col("rank") - 1).alias("rank"))
    near = (
        ranked.join(before, ["host", "rank"], "left")
        .join(after, ["host", "rank"], "left")
        .select("host", "path", F.coalesce("before", "after").alias("other"), F.col("before").isNotNull().alias("earlier"))
    )
    found = near.join(paths.withColumnRenamed("path", "other"), ["host", "other"])
    return found.select("host", "path", F.when(F.col("earlier"), F.col("last")).otherwise(F.col("first")).alias("partner"))


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text (empty if there is none), n_chars, had_partner, n_shared (lines that the partner has too),
    n_differencing (lines that only the comparison removes) and n_markup (lines that only markup removes) for every row.

    All pages of a path have one partner: the last page (by url, id) of the path before it on the same host,
    or the first page of the path after it where there is none before. It does not depend on partitions. A
    page without a partner (a host with one path, a null url on its own) loses no lines by comparison. Null
    html counts as empty. Lines are compared by 64-bit hashes. Repeated rows each get their row, an empty table
    gives an empty result, very long pages are worked on whole. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    paired = _parsed(rows, True).join(_partners(rows), ["host", "path"], "left")
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            columns = (batch.column(c).to_pylist() for c in ("keys", "inside", "texts", "partner"))
            for keys, inside, texts, partner in zip(*columns, strict=True):
                shared = common_lines(keys, partner) if partner is not None else set()
                gone = {i for i in shared if not inside[i]}
                out.append(" ".join(t for i, t in enumerate(texts) if t is not None and i not in gone))
                dropped = {i for i, t in enumerate(texts) if t is None}
                counts.append((len(shared), len(gone - dropped), len(dropped - gone)))
            n_shared, by_difference, by_markup = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(out, pa.string()),
                    pa.array([len(t) for t in out], pa.int64()),
                    batch.column("partner").is_valid(),
                    *(pa.array(x, pa.int32()) for x in (n_shared, by_difference, by_markup)),
                ],
                ["page_id", "url", "text", "n_chars", "had_partner", "n_shared", "n_differencing", "n_markup"],
            )

    return paired.select("page_id", "url", "keys", "inside", "texts", "partner").mapInArrow(
        run,
        f"page_id {id_type}, url string, text string, n_chars long, had_partner boolean, n_shared int, n_differencing int, n_markup int",
    )
