"""One pass over a page: its title, date, text, links and job board.

A page is read once, tag by tag, in Arrow batches; what follows are columns, so no
filter or second column of the same page reads it again.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import COOKIE_LINE

# Elements whose text is not the page's, tags that end a line, and what white space is.
DROPPED = frozenset("script style noscript template nav header footer aside form title".split())
LINES = frozenset("br /p /div /li /h1 /h2 /h3 /h4 /h5 /h6 /tr /ul /ol /section /article p div li h1 h2 h3 h4 h5 h6 tr".split())
SPACE = "\t-\r \x85\xa0  -     　"
# Job boards by the addresses that pages link to, tried in order, with the board's name for the company, and its host and site where these differ by company.
BOARDS = [
    ("greenhouse", r"boards\.greenhouse\.io/embed/job_board(?:/js)?\?for=(?P<token>[\w-]+)"),
    ("greenhouse", r"(?:job-boards|boards)(?:\.eu)?\.greenhouse\.io/(?!embed\b)(?P<token>[\w-]+)"),
    ("lever", r"(?P<host>jobs\.(?:eu\.)?lever\.co)/(?P<token>[\w.-]+)"),
    ("workday", r"(?P<host>[\w-]+\.wd\d+\.myworkdayjobs\.com)/wday/cxs/(?P<token>[\w-]+)/(?P<site>[\w-]+)"),
    ("workday", r"(?P<host>(?P<token>[\w-]+)\.wd\d+\.myworkdayjobs\.com)/(?!wday/)(?:[a-z]{2}(?:-[a-z]{2})?/)?(?P<site>[\w-]+)"),
    ("workday", r"(?P<host>wd\d+\.myworkdaysite\.com)/(?:[a-z]{2}(?:-[a-z]{2})?/)?recruiting/(?P<token>[\w-]+)/(?P<site>[\w-]+)"),
    ("personio", r"(?P<host>(?P<token>[\w-]+)\.jobs\.personio\.(?:de|com))"),
    ("ashby", r"jobs\.ashbyhq\.com/(?P<token>[\w.-]+)"),
    ("smartrecruiters", r"(?:jobs|careers)\.smartrecruiters\.com/(?P<token>[\w-]+)"),
    ("workable", r"apply\.workable\.com/(?!api\b)(?P<token>[\w-]+)"),
    ("recruitee", r"(?P<host>(?P<token>[\w-]+)\.recruitee\.com)"),
]

_BOARDS = [(kind, re.compile(p)) for kind, p in BOARDS]
#: What every pattern of a board needs: a page without any of these is not searched.
_BOARD_MARK = re.compile(r"greenhouse\.io|lever\.co|myworkdayjobs|myworkdaysite|jobs\.personio|ashbyhq|smartrecruiters\.com|apply\.workable|recruitee\.com")
_TAG = re.compile(r"<!--.*?-->|<(/?[a-zA-Z][a-zA-Z0-9]*)?[^>]*>", re.S)
_HREF = re.compile(r"""\shref\s*=\s*["']([^"'#]+)""", re.I)
_META_DATE = re.compile(r'article:published_time"\s+content="([^"]+)"', re.I)
_SCRIPT_DATE = re.compile(r'datePublished"\s*:\s*"([^"]+)"', re.I)
_SPACES = re.compile(f"[{SPACE}]+")
_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_BANNER = re.compile(COOKIE_LINE)


class Read(NamedTuple):
    title: str | None
    date: str | None
    body: str
    links: list[tuple[str, str]]


def collapse(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def clean_lines(text: str) -> str:
    """C02 in Python: lines with one kind of space; no blank, banner or repeated line."""
    lines: dict[str, str] = {}
    for line in map(collapse, _LINE_END.split(text)):
        if line and not _BANNER.search(line):
            lines.setdefault(line.casefold(), line)
    return "\n".join(lines.values())


def read_page(source: str) -> Read:
    """Text of the body, line by line, without dropped elements; links with their labels, wherever they stand; the first title and date."""
    out: list[str] = []
    links: list[tuple[str, str]] = []
    label: list[str] | None = None
    href = title = date = ""
    at, dropped = 0, 0

    def say(piece: str, shown: bool) -> None:
        if shown:
            out.append(piece)
        if label is not None:
            label.append(piece)

    for tag in _TAG.finditer(source):
        start, shown = tag.start(), at >= dropped
        if start < at:
            continue  # inside a script
        if start > at:
            say(entities.unescape(source[at:start]), shown)
        at = tag.end()
        name = (tag.group(1) or "").lower()
        if not name:
            if source.startswith("<!--", start):
                say(" ", shown)
            continue
        if name in LINES:
            say("\n", shown)
        elif name == "a" and label is None:
            found = _HREF.search(tag.group())
            if found:
                href, label = found.group(1), []
        elif name == "/a" and label is not None:
            links.append((href, " ".join(filter(None, map(collapse, "".join(label).split("\n"))))))
            label = None
        elif name == "body" and shown:
            out.clear()
        elif name == "meta" and not date:
            found = _META_DATE.search(tag.group())
            date = found.group(1) if found else ""
        elif name in DROPPED:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            if end and shown:
                dropped = end.end()
                out.append(" ")
            if end and name == "title" and not title:
                title = entities.unescape(source[at : end.start()])
            if end and name == "script" and not date:
                found = _SCRIPT_DATE.search(source, at, end.start())
                date = found.group(1) if found else ""
            if end and name in ("script", "style"):
                at = end.start()  # no tags in there
    if at < len(source) and at >= dropped:
        out.append(entities.unescape(source[at:]))
    return Read(title or None, date or None, clean_lines("".join(out)), links)


def find_board(source: str) -> dict | None:
    """The first board in order that the page links to: ats, token, host, site."""
    if not _BOARD_MARK.search(source):
        return None
    for kind, pattern in _BOARDS:
        found = pattern.search(source)
        if found:
            groups = found.groupdict()
            return {"ats": kind, "token": groups["token"], "host": groups.get("host"), "site": groups.get("site")}
    return None


_BOARD = pa.struct([(c, pa.string()) for c in ("ats", "token", "host", "site")])
_LINKS = pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())]))


def parsed(pages: DataFrame) -> DataFrame:
    """Pages (company_id, url, html) as company_id, url, title, date, body (cleaned), links array<struct<href,label>>, board struct<ats,token,host,site>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sources = [x or "" for x in part.column("html").to_pylist()]
                rows = [read_page(x) for x in sources]
                columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
                links = pa.array([[{"href": h, "label": t} for h, t in r.links] for r in rows], _LINKS)
                yield pa.RecordBatch.from_arrays([part.column("company_id"), part.column("url"), *columns, links, pa.array(map(find_board, sources), _BOARD)], ["company_id", "url", "title", "date", "body", "links", "board"])

    kept = pages.select("company_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = kept.schema["company_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"company_id {kind}, url string, title string, date string, body string, links array<struct<href:string,label:string>>, board struct<ats:string,token:string,host:string,site:string>")
