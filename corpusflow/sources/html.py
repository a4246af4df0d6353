"""HTML as text and markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that text without a parser undoes, in this order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip(c: Column) -> Column:
    """Without scripts, styles, comments and tags; white space as one blank."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape(c), r"[\x20\x09-\x0D]+", " "))


class _Markdown(HTMLParser):
    """Lines of markdown: headings, nested lists, check lists, links, bold and italic. An item's
    mark stands before its first line; an empty block outside lists is a blank line."""

    SIGNS = {"b": "**", "strong": "**", "i": "*", "em": "*"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.text: list[str] = []
        self.lists: list[int | None] = []  # the count of a numbered list, else None
        self.marks: list[str] = []  # of open items, empty once written
        self.links: list[str] = []
        self.hidden = 0

    def line(self) -> str:
        text, self.text = "".join(self.text), []
        return re.sub(r"[ \t]+", " ", text).strip()

    def end_block(self, blank: bool = False) -> None:
        text = self.line()
        if self.marks and self.marks[-1]:
            self.lines.append(self.marks[-1] + text)
            self.marks[-1] = ""
        elif text or blank and not self.marks:
            self.lines.append(text)

    def mark(self, look: str) -> str:
        if self.lists and self.lists[-1] is not None:
            self.lists[-1] += 1
            sign = f"{self.lists[-1]}. "
        else:
            sign = "- [ ] " if "unchecked" in look else "- [x] " if "checked" in look else "- "
        return "    " * max(0, len(self.lists) - 1) + sign

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = dict(attrs)
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag == "br":
            self.end_block(blank=True)
        elif tag in ("ul", "ol") or len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.end_block()
            if tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            self.marks.append(self.mark(have.get("class") or ""))
        elif tag == "a":
            self.links.append(have.get("href") or "")
            self.text.append("[")
        else:
            self.text.append(self.SIGNS.get(tag, ""))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("div", "p"):
            self.end_block(blank=True)
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            text = self.line()
            if text:
                self.lines.append("#" * int(tag[1]) + " " + text)
        elif tag == "li":
            self.end_block()
            del self.marks[-1:]
        elif tag in ("ul", "ol"):
            del self.lists[-1:]
            if not self.lists:
                self.lines.append("")
        elif tag == "a":
            self.text.append(f"]({self.links.pop() if self.links else ''})")
        else:
            self.text.append(self.SIGNS.get(tag, ""))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def to_markdown(html: str | None) -> str | None:
    """Blank lines in a row count as one; null stays null."""
    if html is None:
        return None
    p = _Markdown()
    p.feed(html)
    p.close()
    p.end_block()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(p.lines)).strip()


def _markdown(c: pd.Series) -> pd.Series:
    return c.map(to_markdown)


def markdown(c: Column) -> Column:
    """HTML as markdown, Arrow batches at a time: a stateful parse has no SQL form."""
    return F.pandas_udf(_markdown, "string")(c)
