"""HTML to text and highlighting, which need a parser: Arrow-batched functions over the standard one."""

from __future__ import annotations

import re
import unicodedata
from html import escape
from html.parser import HTMLParser

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions.text import CJK, folding

# Elements before which a space is set, elements without content, white space of the web platform.
BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
WHITE = "\t\n\v\f\r    -     　﻿"
_WHITE = re.compile(f"[{WHITE}]+")
#: Elements that end an open paragraph when they start.
CLOSES_P = BLOCKS - {"br", "dd", "dt", "li", "td", "th", "tr"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.paragraph = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.parts.append(" ")
        if tag in CLOSES_P:
            self.paragraph = tag == "p"

    def handle_endtag(self, tag: str) -> None:
        if tag == "br" or (tag == "p" and not self.paragraph):  # a stray one makes an element
            self.parts.append(" ")
        if tag == "p":
            self.paragraph = False

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def text_of(html: str | None) -> str:
    """Text content with a space before each block element, white space collapsed."""
    if not html:
        return ""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return _WHITE.sub(" ", "".join(parser.parts)).strip(" ")


@F.pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(text_of)


def searchable(content: Column, warning: Column, media: Column) -> Column:
    """What a status is found by: its text, content warning and media descriptions."""
    told = F.coalesce(F.transform(media, lambda m: m["description"]), F.array().cast("array<string>"))
    described = F.filter(told, lambda d: F.coalesce(d, F.lit("")) != "")
    parts = F.concat(F.array(html_to_text(content)), F.array_compact(F.array(F.nullif(warning, F.lit("")))), described)
    return F.array_join(parts, " ")


#: Runs of one kind: CJK characters, or others that are no white space, punctuation or separator.
_RUNS = regex.compile(rf"(?P<cjk>[{CJK}]+)|[^{WHITE}\p{{P}}\p{{Z}}{CJK}]+")


def marked(text: str, singles: set[str], pairs: set[str], words: set[str], folds: dict[int, str]) -> list[tuple[int, int]]:
    """Spans of a text node that are part of a match, in order and merged where they touch."""
    found: list[tuple[int, int]] = []

    def add(lo: int, hi: int) -> None:
        if found and found[-1][1] >= lo:
            found[-1] = (found[-1][0], max(hi, found[-1][1]))
        else:
            found.append((lo, hi))

    for run in _RUNS.finditer(text):
        lo, hi = run.span()
        if run["cjk"] is None:
            if words and unicodedata.normalize("NFKC", run[0]).lower() in words:
                add(lo, hi)
        elif singles or pairs:
            folded = run[0].translate(folds)
            for k, c in enumerate(folded):
                if c in singles:
                    add(lo + k, lo + k + 1)
                if folded[k : k + 2] in pairs:
                    add(lo + k, lo + k + 2)
    return found


_IS_CJK = re.compile(f"[{CJK}]")
_ALL_CJK = re.compile(f"[{CJK}]+")


class _Marker(HTMLParser):
    """Writes the document again, with marks in its text nodes."""

    def __init__(self, find) -> None:
        super().__init__(convert_charrefs=True)
        self.find, self.out, self.open = find, [], []

    def _close(self, tag: str) -> None:
        while self.open:
            top = self.open.pop()
            self.out.append(f"</{top}>")
            if top == tag:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CLOSES_P and "p" in self.open:
            self._close("p")
        shown = "".join(f' {k}="{(v or "").replace("&", "&amp;").replace(chr(160), "&nbsp;").replace(chr(34), "&quot;")}"' for k, v in attrs)
        self.out.append(f"<{tag}{shown}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self._close(tag)
        elif tag == "p":
            self.out.append("<p></p>")
        elif tag == "br":
            self.out.append("<br>")

    def handle_comment(self, data: str) -> None:
        self.out.append(f"<!--{data}-->")

    def handle_data(self, data: str) -> None:
        plain = bool(self.open) and self.open[-1] in ("script", "style")
        show = (lambda s: s) if plain else (lambda s: escape(s, quote=False).replace(" ", "&nbsp;"))
        at = 0
        for lo, hi in self.find(data):
            self.out += [show(data[at:lo]), "<mark>", show(data[lo:hi]), "</mark>"]
            at = hi
        self.out.append(show(data[at:]))


def highlighted(html: str | None, found, folds: dict[int, str]) -> str | None:
    """``html`` with the ``found`` index terms marked in its text nodes; unchanged if there are none."""
    found = [t for t in (found if found is not None else ()) if t]
    cjk = {t for t in found if _ALL_CJK.fullmatch(t)}
    singles, pairs, words = {t for t in cjk if len(t) == 1}, {t for t in cjk if len(t) == 2}, set(found) - cjk
    if html is None or not (singles or pairs or words):
        return html
    marker = _Marker(lambda text: marked(text, singles, pairs, words, folds))
    marker.feed(html)
    marker.close()
    marker._close("")
    return "".join(marker.out)


def highlight(html: Column, found: Column) -> Column:
    folds = str.maketrans(*folding())

    @F.pandas_udf(StringType())
    def run(pages: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([highlighted(p, t, folds) for p, t in zip(pages, lists, strict=True)], dtype=object)

    return run(html, found)
