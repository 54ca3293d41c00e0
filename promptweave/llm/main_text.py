"""Main text of web pages by differencing each page against the nearest one of its host.

A page is cut into text lines, one per block. Lines of menus, footers, adverts
and the like are marked by their elements and dropped. What is left is aligned
with that of the page whose URL path is nearest on the same host: lines of the
longest common subsequence belong to the site, not to the page, and are deleted.
Lines inside an article are never deleted, as two pages may carry one text.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator, Sequence
from os.path import commonprefix
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweave.llm.common import stored

# Elements and class names.
RAW = "script|style|noscript|template|title|textarea|iframe"
CODE = {"script", "style", "title"}
CHROME = set("nav footer aside form menu dialog button select fieldset".split())
BLOCKS = set(
    "html body main article section header nav footer aside form menu dialog fieldset div p h1 h2 h3 h4 h5 h6 ul ol li "
    "dl dt dd table thead tbody tfoot tr td th caption blockquote pre hr figure figcaption address details summary".split()
)
LEAVES = {"p", "li", "dt", "dd", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
CHROME_CLASSES = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget notice notices cookie cookies consent alert popup modal "
    "overlay comment comments disqus replies respond share sharing social related recommended newsletter subscribe "
    "signup login search toolbar pagination pager copyright".split()
)
GENERIC_CLASSES = {"site", "page", "global", "top", "bottom", "main", "left", "right"}
# Inside an article a name counts if each of its parts is of these or generic; the first are needed.
ARTICLE_CHROME = CHROME_CLASSES - set("header aside notice notices alert banner search toolbar menu comment copyright".split())
ARTICLE_PARTS = set("bar block box button buttons container form icons item items label link links list section widget wrapper".split())
CONTENT, UNKNOWN = 1, 0
DENSE_BITS = 1 << 30

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_CLOSERS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW.split("|")}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


def _is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in CHROME or tag == "header" and not in_article:
        return True
    for found in _NAMES.findall(attributes) if attributes else ():
        for name in " ".join(found).lower().split():
            parts = [p for p in re.split("[-_]", name) if p not in GENERIC_CLASSES]
            if not parts:
                continue
            if not in_article and parts[0] in CHROME_CLASSES:
                return True
            if in_article and parts[0] in ARTICLE_CHROME and all(p in ARTICLE_CHROME | ARTICLE_PARTS for p in parts):
                return True
    return False


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """Text lines of a page in order, with ``CONTENT`` for those in an article, else ``UNKNOWN``.

    Each block is a line, its white space single blanks. Elements that are left
    open end with the block around them; scripts, frames and the like that are never
    closed go up to the next tag if they hold code, else with their tag alone.
    """
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []
    pieces: list[str] = []
    html = html or ""

    def flush() -> None:
        if pieces:
            line = " ".join(html_lib.unescape("".join(pieces)).split())
            pieces.clear()
            if line and not (stack and stack[-1][1]):
                lines.append((line, CONTENT if stack and stack[-1][2] else UNKNOWN))

    at, never = 0, set()
    while token := _TOKEN.search(html, at):
        if token.start() > at:
            pieces.append(html[at : token.start()])
        at = token.end()
        raw = (token["raw"] or "").lower()
        if raw:
            closer = None if raw in never else _CLOSERS[raw].search(html, at)
            if closer:
                at = closer.end()
                continue
            never.add(raw)
            if raw in CODE:
                follows = html.find("<", at)
                at = follows if follows >= 0 else len(html)
            continue
        tag = (token["tag"] or "").lower()
        if tag == "br":
            pieces.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if token["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
                if tag in LEAVES and stack[depth][0] not in LEAVES:
                    break
        elif tag not in VOID:
            # A paragraph or heading ends where a block starts, a cell or item where its like does.
            while stack and (stack[-1][0][0] in "ph" and stack[-1][0] in LEAVES or tag in LEAVES and stack[-1][0] == tag):
                stack.pop()
            chrome, article = stack[-1][1:] if stack else (False, False)
            chrome = chrome or _is_chrome(tag, token["attributes"], article)
            stack.append((tag, chrome, article or tag in ("article", "main")))
    if at < len(html):
        pieces.append(html[at:])
    flush()
    return lines


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, without query, fragment or a slash at the end."""
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


def common_lines(a: Sequence[int], b: Sequence[int]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Bit-parallel: one long integer per line of ``a``, a zero bit where the
    length grows. Too many bits are halved, and each half aligned by itself.
    """
    both = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in both]
    left, right = [a[i] for i in places], [x for x in b if x in both]
    return {places[i] for i in _aligned(left, right)}


def _rows(a: Sequence[int], b: Sequence[int]) -> Iterator[int]:
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        grown = row & where.get(x, 0)
        row = (row + grown | row - grown) & every
        yield row


def _lengths(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    total, out = 0, [0]
    for bit in reversed(f"{row:0{max(1, len(b))}b}"[-len(b) :] if b else ""):
        total += bit == "0"
        out.append(total)
    return out


def _aligned(a: Sequence[int], b: Sequence[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > DENSE_BITS:
        half = len(a) // 2
        before, after = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: before[j] + after[j])
        return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    found, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - 1] >> (j - 1) & 1:
            continue
        found.append(i)
        j -= 1
    return found[::-1]


_KEYS = "host string, path string, digest long"
_PACKED = f"page_id long, url string, {_KEYS}, packed binary, roles string"
_MARKS = "digest long, marks array<long>"
_ROWS = 256


def _marks(lines: Sequence[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(t) - (1 << 63) for t in lines]


def _parsed(pages: DataFrame, schema: str) -> DataFrame:
    """What is asked for of every page that has lines, or of every page if its text is."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = {
        "page_id": pa.int64(), "digest": pa.int64(), "marks": pa.list_(pa.int64()), "packed": pa.binary(),
    }

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS):
                part = batch.slice(begin, _ROWS)
                rows = []
                for page_id, url, html in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    found = page_lines(html)
                    if not found and "packed" not in names:
                        continue
                    lines = [t for t, _ in found]
                    marks = _marks(lines)
                    host, path = host_and_path(url)
                    row = {"page_id": page_id, "url": url, "host": host, "path": path, "marks": marks}
                    row["digest"] = xxhash.xxh64_intdigest(np.array(marks, np.int64).tobytes()) - (1 << 63)
                    if "packed" in names:
                        row["packed"] = zlib.compress("\n".join(lines).encode("utf-8", "replace"))
                        row["roles"] = "".join(str(r) for _, r in found)
                    rows.append([row[n] for n in names])
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                arrays = [pa.array(c, types.get(n, pa.string())) for n, c in zip(names, columns, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    return given.mapInArrow(parse, schema)


def assemble(lines: Sequence[str], roles: Sequence[int], nearest: Sequence[int] | None) -> str:
    """The lines that the nearest page, given by its marks, does not share, and those of an article.

    With no page to compare with, an article's lines, or without one all.
    """
    if nearest is None:
        kept = [t for t, role in zip(lines, roles, strict=True) if role == CONTENT] or lines
    elif UNKNOWN in roles:
        shared = common_lines(_marks(lines), list(nearest))
        kept = [t for i, (t, role) in enumerate(zip(lines, roles, strict=True)) if role == CONTENT or i not in shared]
    else:
        kept = lines
    return "\n\n".join(kept)


@F.pandas_udf(T.StringType())
def _assembled(packed: pd.Series, roles: pd.Series, nearest: pd.Series) -> pd.Series:
    texts = []
    for data, signs, near in zip(packed, roles, nearest, strict=True):
        lines = zlib.decompress(data).decode().split("\n") if signs else []
        texts.append(assemble(lines, [int(r) for r in signs], near))
    return pd.Series(texts, dtype=object)


#: A page's place among the others: host and path, and the digest of its lines.
_Place = tuple[str, str, int]


def _alike(a: _Place, b: _Place) -> bool:
    return a[0] == b[0] and a[2] == b[2]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range its ends, and next to each the first place that is not like it."""
    first = after = last = before = None
    for batch in batches:
        for place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            first = first or place
            if after is None and not _alike(place, first):
                after = place
            if last and not _alike(place, last):
                before = last
            last = place
    if first:
        found = [(kind, *p) for kind, p in enumerate((first, after, last, before)) if p]
        part = TaskContext.get().partitionId()
        columns = [[part] * len(found), *zip(*found, strict=True)]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        names = ["part", "kind", "host", "path", "digest"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _guests(ends: list[tuple[int, dict[int, _Place]]], near: int, far: int, beyond: int) -> dict[int, _Place | None]:
    """For every range the closest place outside of it that is not like its own end.

    ``ends`` are in walking order. ``near`` is the end of a range that is reached first,
    ``far`` the other one and ``beyond`` the last place of the range that is not like that.
    """
    found: dict[int, _Place | None] = {}
    last = other = None
    for part, places in ends:
        found[part] = other if last and _alike(last, places[near]) else last
        if beyond in places:
            other = places[beyond]
        elif last is None or not _alike(last, places[far]):
            other = last
        last = places[far]
    return found


def _beside(before: dict[int, _Place | None], after: dict[int, _Place | None]):
    """Sorted places with the digest of the nearest one on the host that has other lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        earlier, alike, out = before.get(part), [], []

        def settle(later: _Place | None) -> None:
            """Rows of a run of one digest look at the places on its two sides."""
            for place in alike:
                beside = [p for p in (earlier, later) if p and p[0] == place[0]]
                nearest = max(beside, key=lambda p, own=place[1]: len(commonprefix([own, p[1]])), default=None)
                out.append((*place, nearest[2] if nearest else None))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "digest", "near"])

        for batch in batches:
            for place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if alike and not _alike(place, alike[-1]):
                    settle(place)
                    earlier, alike = alike[-1], []
                alike.append(place)
            yield batch_of()
        if alike:
            settle(after.get(part))
        yield batch_of()

    return run


def _neighbours(paths: DataFrame) -> DataFrame:
    """Add ``near``: the digest of the nearest page of the host with other lines.

    Narrow rows are sorted by host, path and digest over all executors and stored.
    Those next to each other with one digest are a run; its rows look at the places in
    front of it and behind it. Four rows per range reach the driver, which hands every
    range the two places beyond its ends.
    """
    ordered = stored(paths.orderBy("host", "path", "digest"))
    ends: dict[int, dict[int, _Place]] = {}
    for r in ordered.mapInArrow(_edges, f"part int, kind int, {_KEYS}").collect():
        ends.setdefault(r["part"], {})[r["kind"]] = (r["host"], r["path"], r["digest"])
    in_order = sorted(ends.items())
    before, after = _guests(in_order, 0, 2, 3), _guests(in_order[::-1], 2, 0, 1)
    return ordered.mapInArrow(_beside(before, after), f"{_KEYS}, near long")


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    A page is compared with the nearest before or after it in the order of paths
    on the host that has other lines, on its own path or another: the one with
    the longer common beginning of the path, the one before if equal. Pages
    without lines are passed over. Where all pages of a host have the same
    lines, there is nothing to compare with. A null or empty html has an empty
    text; a null url has an empty host.
    """
    keys = F.unhex(F.md5(F.concat_ws("\0", "host", "path", "digest").cast("binary"))).alias("key")
    near = _neighbours(_parsed(pages, _KEYS).distinct()).where("near IS NOT NULL").select(keys, "near")
    marks = _parsed(pages, _MARKS).groupBy(F.col("digest").alias("near")).agg(F.first("marks").alias("marks"))
    compared = near.join(marks, "near").select("key", "marks")
    whole = _parsed(pages, _PACKED).select("page_id", "url", keys, "packed", "roles").join(compared, "key", "left")
    text = _assembled("packed", "roles", "marks")
    return whole.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
