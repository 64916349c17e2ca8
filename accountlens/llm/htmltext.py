"""Main text of web pages, by removal of what a site repeats.

A page is read into a tree; every element's subtree has a hash of its tags and texts.
Spark counts, for each host, on how many different pages a subtree occurs, and those on
many are the site's template: they go from every page of the host. Of what is left,
elements that say themselves that they are no part of the article go too (menus, notices,
adverts, forms, comments), and a page with an article keeps that. Prose inside an article
is never template, however often it is quoted.

Defined cases: null and empty pages have an empty text; pages without a host, or of a host
of few pages, lose only what is marked; repeated rows get equal texts and count once as a
page; pages of any length and depth are read whole; broken markup is read as browsers do
in the main (implied ends, unclosed elements, stray ends); an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import bounded, parts
from .simhash import with_hot
from .storage import checkpointed

#: A subtree is template if it is on so many different pages of its host, and on this share of them. So a host has at most 1 / SHARE times as many as a page has subtrees.
LEAST_PAGES, SHARE = 3, 0.01
#: Bytes of all hosts' templates up to which they go to every task; beyond, pages meet them by host.
BROADCAST_BYTES = 16 << 20

# Elements without content, with raw text, that break lines, and that are never part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption thead tbody tfoot tr ul".split()
)
FURNITURE = frozenset("head title nav footer aside form script style noscript template iframe object embed svg canvas audio video select button dialog menu search textarea datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
# Words of classes and ids of such elements.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay"
    " sidebar breadcrumb breadcrumbs menu nav navbar navigation footer masthead topbar toolbar pagination pager share sharing social related recommended comment comments commentlist disqus respond login widget".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies".split())
# Elements that an element of the same group ends, up to the one that holds them.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",))}
SCOPES = frozenset("html table td th caption template object".split())
CELLS = frozenset("td th br".split())

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # a comment
    r"|<[!?][^>]*+>?|</[^a-zA-Z][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """A page's elements in the order of their starts, and its text in pieces, each of an element and a block."""

    def __init__(self, source: str):
        self.tags, self.parents, self.marks, self.inside, self.hashes, self.sizes, self.linked = ["html"], [0], [False], [False], [0], [0], [0]
        self.named: list[bool] = [False]
        self.articles: list[int] = []
        self.pieces: list[tuple[int, int, str]] = []
        self._held: list[list[str]] = [["html"]]
        self._stack, self._open, self._block = [0], Counter({"html": 1}), 0
        self._read(source)
        while len(self._stack) > 1:
            self._close()
        self.hashes[0] = xxhash.xxh64_intdigest("\0".join(self._held[0]))

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            found = _MARKUP.search(source, at)
            start = found.start() if found else n
            if start > at:
                self._text(source[at:start])
            if not found:
                return
            at = found.end()
            name = found.group(2)
            if name is None:
                continue
            name = name.lower()
            if found.group(1):
                self._end(name)
                continue
            self._start(name, found.group(3))
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = stop.start() if stop else n

    def _text(self, text: str) -> None:
        node = self._stack[-1]
        text = entities.unescape(text)
        self.pieces.append((node, self._block, text))
        bare = " ".join(text.split())
        if bare:
            self._held[-1].append(bare)
            self.sizes[node] += len(bare)

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._block += 1
            if self._open["p"]:
                self._end_to(("p",), SCOPES)
        if name in ENDS and any(self._open[x] for x in ENDS[name][0]):
            self._end_to(*ENDS[name])
        if name in CELLS:
            self.pieces.append((self._stack[-1], self._block, " "))
        if name in VOID:
            return
        if name in ("html", "body") and self._open[name]:
            return
        parent, node = self._stack[-1], len(self.tags)
        self.tags.append(name)
        self.parents.append(parent)
        self.hashes.append(0)
        self.sizes.append(0)
        self.linked.append(0)
        words: set[str] = set()
        role = ""
        if attributes and "=" in attributes:
            for key, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values)
                if key.lower() == "role":
                    role = value.strip().lower()
                else:
                    words.update(w.lower() for w in _WORD.findall(value))
        within = self.inside[parent]
        is_article = name in ("article", "main") or role in ("article", "main")
        self.marks.append(name in FURNITURE or role in ROLES or (name == "header" and not within))
        self.named.append(bool(words & (COMMENTS if is_article else NAMES)) and name not in ("html", "body"))
        self.inside.append(within or (is_article and not self.named[-1]))
        if is_article and not self.named[-1]:
            self.articles.append(node)
        self._stack.append(node)
        self._open[name] += 1
        self._held.append([name])

    def _end(self, name: str) -> None:
        block = name in BLOCK
        if block:
            self._block += 1
        if name in ("html", "body") or not self._open[name]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[k]]
            if tag == name:
                while len(self._stack) > k:
                    self._close()
                return
            if tag in SCOPES and name not in ("table", "tr", "tbody", "thead", "tfoot") or not block and name not in CELLS and tag in BLOCK:
                return

    def _end_to(self, names: tuple, holders: Iterable[str]) -> None:
        """Closes the outermost of the named elements inside the nearest holder."""
        last = 0
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[k]]
            if tag in holders:
                break
            if tag in names:
                last = k
        while last and len(self._stack) > last:
            self._close()

    def _close(self) -> None:
        node = self._stack.pop()
        name, parent = self.tags[node], self.parents[node]
        self._open[name] -= 1
        self.hashes[node] = xxhash.xxh64_intdigest("\0".join(self._held.pop()))
        if self.sizes[node]:
            self._held[-1].append(f"{self.hashes[node]:x}")
        self.sizes[parent] += self.sizes[node]
        self.linked[parent] += self.sizes[node] if name == "a" else self.linked[node]

    def removable(self, node: int) -> bool:
        """Whether the subtree goes if the site repeats it: not single words or inline elements, no prose of an article, nor what holds one."""
        if not node or not self.sizes[node] or self.tags[node] not in BLOCK or self.tags[node] in ("html", "body"):
            return False
        return not self.inside[node] or (node not in self._kept() and 2 * self.linked[node] > self.sizes[node])

    def _kept(self) -> set[int]:
        """Articles and all that holds one."""
        if not hasattr(self, "_holders"):
            self._holders = set()
            for node in self.articles:
                while node and node not in self._holders:
                    self._holders.add(node)
                    node = self.parents[node]
        return self._holders

    def subtrees(self) -> set[int]:
        """Hashes of the subtrees that could be template."""
        holders = self._kept()
        return {self.hashes[k] for k in range(1, len(self.tags)) if k not in holders and self.removable(k)}

    def text(self, template: frozenset[int] | set[int] = frozenset()) -> tuple[str, int, int]:
        """(text, subtrees removed as template, as marked) of the page."""
        holders, gone = self._kept(), [0] * len(self.tags)
        n_template = n_marked = 0
        for k in range(1, len(self.tags)):
            if gone[self.parents[k]]:
                gone[k] = 1
            elif k not in holders and self.hashes[k] in template and self.removable(k):
                gone[k], n_template = 1, n_template + 1
            elif (self.marks[k] and self.tags[k] != "head" and (k not in holders or self.tags[k] != "header")) or (self.named[k] and k not in holders):
                gone[k], n_marked = 1, n_marked + 1
            elif self.tags[k] == "head":
                gone[k] = 1
        main = self._main(gone)
        blocks: dict[int, list[str]] = {}
        for node, block, piece in self.pieces:
            if not gone[node] and (main is None or main[node]):
                blocks.setdefault(block, []).append(piece)
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n\n".join(x for x in lines if x), n_template, n_marked

    def _main(self, gone: list[int]) -> list[bool] | None:
        """Which elements lie in the articles that are left, else in the main element; None if the page has neither."""
        for names in (("article",), ("main",)):
            roots = {k for k in self.articles if not gone[k] and (self.tags[k] in names or (names == ("main",) and self.tags[k] != "article")) and self.sizes[k]}
            if roots:
                main = [False] * len(self.tags)
                for k in range(1, len(self.tags)):
                    main[k] = main[self.parents[k]] or k in roots
                return main
        return None


def host_of(url: Column) -> Column:
    """Host of an address, lower case, without user and port; empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, pages): hashes of the subtrees that a host repeats, and how many different pages it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                out: tuple[list, list, list] = ([], [], [])
                for host, source in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    page = Page(source.as_py() or "")
                    found = [0, *(_signed(x) for x in page.subtrees())] if host else [0]
                    for column, x in zip(out, ([host] * len(found), found, [_signed(page.hashes[0])] * len(found)), strict=True):
                        column += x
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["host", "subtree", "page"])

    seen = bounded(pages).select("host", F.col("html")).mapInArrow(run, "host string, subtree long, page long").distinct()
    counts = checkpointed(seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).where((F.col("subtree") == 0) | (F.col("n") >= LEAST_PAGES)))
    hosts = counts.where("subtree = 0").select("host", F.col("n").alias("pages"))
    often = counts.where("subtree <> 0").join(hosts, "host").where(F.col("n") >= SHARE * F.col("pages"))
    return hosts.join(often.groupBy("host").agg(F.collect_list("subtree").alias("template")), "host", "left").select("host", F.coalesce("template", F.array().cast("array<long>")).alias("template"), "pages")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_template, n_marked) of every page."""
    kept = pages.select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{url_col}`").cast("string").alias("_url"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    found = checkpointed(templates(kept))
    size, n_pages = found.agg(F.sum(F.size("template")), F.sum("pages")).first()
    if 8 * (size or 0) <= BROADCAST_BYTES:
        both = kept.join(F.broadcast(found), "host")
    else:
        # As many rows as different pages are counted here; which hosts are hot changes no result.
        both = with_hot(kept, found.withColumnRenamed("pages", "_rows"), "host", n_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                known: dict[str, set[int]] = {}
                out: tuple[list, list, list, list] = ([], [], [], [])
                for host, source, template in zip(part.column(3).to_pylist(), part.column(2), part.column(4), strict=True):
                    if host not in known:
                        known[host] = {x & (1 << 64) - 1 for x in template.as_py()}
                    text, n, m = Page(source.as_py() or "").text(known[host])
                    for column, x in zip(out, (text, len(text), n, m), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], ["_key", "_url", "text", "n_chars", "n_template", "n_marked"])

    kind = kept.schema["_key"].dataType.simpleString()
    done = both.select("_key", "_url", "html", "host", "template").mapInArrow(run, f"_key {kind}, _url string, text string, n_chars long, n_template long, n_marked long")
    return done.withColumnRenamed("_key", id_col).withColumnRenamed("_url", url_col)
