"""Main text of web pages by consensus host paths.

1. Every page scores its containers and names its best one by a generalised path: tags with
   their classes from the body down, digits replaced.
2. Spark counts the votes per host and path; the path that most pages of a host name wins.
   Votes are summed before they are shuffled, so a host with a third of all pages is one row
   per task.
3. Pages are read again and the text below the host's winning path is extracted.  A page
   without that path uses its own best container.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Elements of raw text end at their end tag, or where the head does; a title without end tag at the next tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea)\b[^>]*(?<!/)>[^<]*+(?:<(?!/\1\s*>|/head\s*>\s*<body\b)[^<]*+)*+(?:</\1\s*>)?"
    r"|<title\b[^>]*(?<!/)>[^<]*+(?:(?:<(?!/title\s*>|/head\b|body\b|title\b)[^<]*+)*+</title\s*>)?"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*>)",
    re.S | re.I,
)
#: Elements that are left out from their tag to its end tag; one that is never closed is only its tag.
_LEFT_OUT = {"noscript", "template", "iframe", "object", "svg", "select", "canvas", "audio", "video"}
_ANY_LEFT_OUT = re.compile(rf"<(?:{'|'.join(sorted(_LEFT_OUT))})\b", re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Elements that hold other blocks, and those that are one block of text.
_CONTAINER = {"article", "main", "section", "div", "td", "th", "body", "center", "figure", "details", "ul", "ol", "dl", "table"}
_BLOCK = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "blockquote", "pre", "figcaption", "summary", "tr",
    "caption", "hr", "address", "tbody", "thead", "tfoot", "html", "legend",
}
#: Elements whose whole content is no article text.
_APART = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "label", "option"}
#: Those of them that may stand around a whole page.
_AROUND = {"form", "fieldset"}
_CONTROLS = {"button", "label", "option"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
#: Words of classes, ids and roles that mark such content (fixed values).
_MARKS = frozenset(
    "nav navbar navigation menu header masthead footer contentinfo sidebar aside complementary cookie cookies consent gdpr"
    " notice notices banner alert ad ads advert adverts advertisement adsense sponsor sponsored promo promotion share"
    " sharing social comment comments disqus reply replies respond related recommended newsletter subscribe subscription"
    " signup breadcrumb breadcrumbs pagination pager popup modal overlay login search toolbar skip hidden dialog".split()
)
#: Words that only in company say that something is article text (``related-work``, ``alert-levels``).
_ALONE = frozenset("related recommended alert banner notice notices search".split())
#: Words that do not change what a mark beside them says.
_FILLER = frozenset(
    "box list bar block wrap wrapper container content inner outer area section widget item items link links main site page top bottom left"
    " right global primary secondary posts post articles article stories story reading message text form field button buttons input icon icons"
    " the to of for and js no nojs col row grid panel module region zone holder group title heading head body msg info warning danger success error primary default".split()
)
#: Beside these a mark says something about the page or belongs to the article.
_ABOUT = frozenset({"has", "with", "no", "without"})
_HEADLINE = frozenset({"article", "post", "entry", "story"})
_CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_DIGITS = re.compile(r"\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _ends(tokens: list[re.Match]) -> dict[int, int]:
    """Where the elements that are left out begin and end, for those with an end tag."""
    ends: dict[int, int] = {}
    started: dict[str, list[int]] = {}
    for token in tokens:
        name = (token[3] or "").lower()
        if name in _LEFT_OUT:
            if not token[2]:
                if not token[4].endswith("/>"):
                    started.setdefault(name, []).append(token.start())
            elif started.get(name):
                ends[started[name].pop()] = token.end()
    return ends


class Page:
    """Blocks of text of one page, each with the container that it is in.

    ``paths[i]`` is the generalised path of container i, ``parents[i]`` the container around it
    (-1 for none); ``blocks`` has ``[container, parts, characters in links, links]``.
    """

    def __init__(self, source: str):
        self._tokens = list(_TOKEN.finditer(source))
        self._ends = _ends(self._tokens) if _ANY_LEFT_OUT.search(source) else {}
        self._read(source, _MARKS, _APART)
        if not any(self._worth()):  # everything stands below a mark or an element apart
            first = self.paths, self.parents, self.blocks
            for ways in (((frozenset(), _APART), (_MARKS, _APART - _AROUND)), ((frozenset(), _APART - _AROUND),), ((frozenset(), _CONTROLS),)):
                found = []
                for marks, apart in ways:
                    self._read(source, marks, apart)
                    found.append((sum(self._worth()), (self.paths, self.parents, self.blocks)))
                most, (self.paths, self.parents, self.blocks) = max(found, key=lambda x: x[0])
                if most:
                    return
            self.paths, self.parents, self.blocks = first

    def _worth(self) -> Iterator[int]:
        """Characters of every block beyond those in links, which count against it as in ``scores``."""
        for _, parts, linked, _ in self.blocks:
            yield max(0, len(" ".join(_html.unescape("".join(parts)).split())) - 2 * linked)

    def _read(self, source: str, marks: frozenset[str], apart: set[str]) -> None:
        self._marks, self._apart = marks, apart
        self.paths: list[str] = []
        self.parents: list[int] = []
        self.blocks: list[list] = []
        self._stack: list[tuple[str, int, bool]] = []  # tag, container, whether text in it counts
        self._parse(source)

    def _parse(self, source: str) -> None:
        at, links, open_block = 0, 0, False
        for token in self._tokens:
            if token.start() < at:
                continue  # inside an element that is left out
            if token.start() > at:
                open_block = self._text(source[at : token.start()], links, open_block)
            at = token.end()
            name = token[3]
            if name is None:
                continue
            name = name.lower()
            if token[2]:
                if name == "a":
                    links = 0
                elif name in _CONTAINER or name in _BLOCK or name in _APART or name == "span":
                    open_block = open_block and name == "span"
                    self._close(name)
            elif name == "a":
                links = 1
                if open_block:
                    self.blocks[-1][3] += 1
            elif name == "br":
                if open_block:
                    self.blocks[-1][1].append(" ")
            elif name in _LEFT_OUT:
                at = self._ends.get(token.start(), at)
            elif name in _CONTAINER or name in _BLOCK or name in _APART:
                open_block, links = False, 0
                self._open(name, token[4])
            elif name == "span" and len(token[4]) > 1:
                self._open(name, token[4])
        if at < len(source):
            self._text(source[at:], links, open_block)

    def _text(self, text: str, links: int, open_block: bool) -> bool:
        counts = self._stack[-1][2] if self._stack else True
        if not counts or not (open_block or text.strip()):
            return open_block
        if not open_block:
            self.blocks.append([self._stack[-1][1] if self._stack else self._root(), [], 0, links])
        block = self.blocks[-1]
        block[1].append(text)
        if links:
            block[2] += len(text)
        return True

    def _root(self) -> int:
        if not self.paths:
            self.paths.append("body")
            self.parents.append(-1)
        return 0

    def _open(self, name: str, attributes: str) -> None:
        closes = _CLOSED_BY.get(name)
        if name != "span":
            while self._stack and self._stack[-1][0] in ("p", "span", "option", "h1", "h2", "h3", "h4", "h5", "h6"):
                self._stack.pop()  # a block ends an open paragraph or option
            if closes and self._stack and self._stack[-1][0] in closes:
                self._stack.pop()
        above, counts = (self._stack[-1][1], self._stack[-1][2]) if self._stack else (self._root(), True)
        words: list[str] = []
        label = name
        if len(attributes) > 1:
            for found in _ATTRIBUTE.finditer(attributes):
                key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
                if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                    words.append("hidden")
                elif key in ("class", "id", "role"):
                    words += _SPLIT.split(_CAMEL.sub("-", value).lower())
                    if key == "class":
                        label = ".".join([name, *sorted(_DIGITS.sub("0", value.lower()).split())])
        if counts and name not in ("body", "html", "article", "main"):
            found = self._marks.intersection(words)
            inside = any(t in ("article", "main") for t, _, _ in self._stack)
            if found and not _ABOUT.isdisjoint(words):
                found = frozenset()
            if found == {"header"} and (inside or not _HEADLINE.isdisjoint(words)):
                found = frozenset()  # the headline of the article
            elif found and found <= _ALONE and not _FILLER.issuperset(w for w in words if w not in self._marks and not w.isdigit() and w):
                found = frozenset()  # a word of the article's own, with another that says what of
            counts = not found and (name not in self._apart or (name == "header" and inside))
        if name in _CONTAINER and name not in ("body",) and counts:
            self.paths.append(f"{self.paths[above]}/{label}")
            self.parents.append(above)
            above = len(self.paths) - 1
        if name not in _VOID:
            self._stack.append((name, above, counts))

    def _close(self, name: str) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == name:
                del self._stack[i:]
                return

    def texts(self) -> list[str]:
        """The clean text of every block: references decoded, white space single, trimmed."""
        return [" ".join(_html.unescape("".join(parts)).split()) for _, parts, _, _ in self.blocks]

    def menus(self) -> set[int]:
        """Containers that are lists of links in all but name: of short ones, since references are long."""
        total: dict[int, list[int]] = {}
        for container, parts, linked, links in self.blocks:
            n = sum(map(len, parts))
            while container >= 0:
                sums = total.setdefault(container, [0, 0, 0])
                sums[0] += n
                sums[1] += linked
                sums[2] += links
                container = self.parents[container]
        return {c for c, (n, linked, links) in total.items() if links >= 3 and 10 * linked >= 8 * n and linked < 30 * links}

    def scores(self, texts: list[str]) -> list[float]:
        """Text that each container holds: its own blocks in full, those of containers inside by half a level."""
        score = [0.0] * len(self.paths)
        for (container, _, linked, _), text in zip(self.blocks, texts, strict=True):
            weight = max(0.0, len(text) - 2.0 * linked)
            if len(text) < 25:
                weight *= 0.25
            while container >= 0 and weight > 0.5:
                tag = self.paths[container].rpartition("/")[2].partition(".")[0]
                if tag in ("ul", "ol", "dl", "figure", "table", "td", "th", "details"):
                    score[container] += 0.5 * weight  # parts of a text rather than the text
                else:
                    score[container] += weight * (1.25 if tag in ("article", "main") else 1.0)
                    weight *= 0.6
                container = self.parents[container]
        return score

    def best(self, texts: list[str]) -> int:
        """The container with the highest score, the outermost of equals; -1 without any text."""
        score = self.scores(texts)
        top = max(score, default=0.0)
        return score.index(top) if top > 0 else -1

    def below(self, chosen: set[int]) -> list[bool]:
        inside: list[bool] = []
        for i, parent in enumerate(self.parents):
            inside.append(i in chosen or (parent >= 0 and inside[parent]))
        return inside


def vote(source: str) -> str | None:
    """The generalised path of the page's best container."""
    page = Page(source)
    best = page.best(page.texts())
    return page.paths[best] if best >= 0 else None


def extract(source: str, path: str | None) -> str:
    """The text below the containers with ``path``, or below the page's own best one."""
    page = Page(source)
    texts = page.texts()
    chosen = {i for i, p in enumerate(page.paths) if p == path}
    inside = page.below(chosen)
    if not any(t and inside[b[0]] for t, b in zip(texts, page.blocks, strict=True)):
        best = page.best(texts)
        if best < 0:
            return ""
        chosen = {best}
        inside = page.below(chosen)
    for i in page.menus() - chosen:
        inside[i] = False
        for j in range(i + 1, len(inside)):
            if page.parents[j] >= 0 and not inside[page.parents[j]] and j not in chosen:
                inside[j] = False
    return "\n\n".join(t for t, b in zip(texts, page.blocks, strict=True) if t and inside[b[0]])


def host(url: str) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.regexp_replace(found, r"^www\.", "")


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, votes``: the winning path of every host (ties: the smaller path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [vote(x) if x else None for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], names=["host", "path"])

    votes = (
        pages.select(host("url").alias("host"), "html")
        .mapInArrow(run, "host string, path string")
        .where("path IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    return votes.groupBy("host").agg(
        F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"), F.max("votes").alias("votes")
    )


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    Null or empty html gives the empty text.  Pages without a host share the empty host's
    vote.  Other columns are ignored; repeated rows give repeated results.
    """
    scratch = Scratch(pages.sparkSession, "htmltext")
    winners = scratch.keep(host_paths(pages), "winners")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, paths = batch.column("html").to_pylist(), batch.column("path").to_pylist()
            texts = [extract(x, p) if x else "" for x, p in zip(sources, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = pages.select("page_id", "url", "html", host("url").alias("host"))
    return (
        source.join(winners.select("host", "path"), "host", "left")
        .select("page_id", "url", "html", "path")
        .mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
    )
