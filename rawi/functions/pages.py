"""Texts of answer pages: the response and the thinking, each from its own part of the page.

A page is read once, tag by tag, with a stack of open elements: a closing tag closes
the innermost open element of its name and all inside it, one that nothing opened is
passed over, void elements close at once, and what is still open ends with the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Elements without content, and those whose text is not shown.
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
HIDDEN = frozenset("script style template".split())
#: Words of lines that begin a section of thinking.
SECTION_WORDS = (
    "establishing", "pinpointing", "commencing", "diving", "focusing", "analyzing", "crafting", "building", "refining", "expanding", "integrating", "composing", "generating",
    "investigating", "uncovering", "grasping", "initiating",
)

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[.*?\]>|<![^>]*>|<\?[^>]*>|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")


def _attributes(rest: str) -> tuple[frozenset[str], bool]:
    """Classes of a tag (the last told ones), and whether it closes itself."""
    classes, end = "", 0
    for m in _ATTRIBUTE.finditer(rest):
        end = m.end()
        if m[1].lower() == "class":
            classes = next((g for g in m.groups()[1:] if g is not None), "")
    return frozenset(unescape(classes).split()), rest[end:].strip().endswith("/")


@dataclass
class Element:
    """An element, the number of the one around it, and where its elements and texts begin and end."""

    name: str
    classes: frozenset[str]
    parent: int
    first_text: int
    last: int = -1
    end_text: int = -1


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    #: (text, or None for a line break; number of the element that holds it)
    texts: list[tuple[str | None, int]] = field(default_factory=list)

    def around(self, k: int, upto: int = -1) -> Iterator[Element]:
        """The elements around the one numbered k, and itself, from the inside out."""
        while k != upto:
            yield self.elements[k]
            k = self.elements[k].parent


def read(html: str) -> Page:
    page, stack, hidden, at = Page(), [], None, 0
    opened = Counter()
    while at < len(html):
        if hidden in ("script", "style"):  # their content ends at their closing tag alone
            end = re.compile(rf"</{hidden}\s*>", re.IGNORECASE).search(html, at)
            at = end.start() if end else len(html)
            hidden = None
            continue
        m = _TOKEN.match(html, at)
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                page.texts.append((unescape(m[0]), stack[-1] if stack else -1))
        elif m["close"]:
            _close(page, stack, opened, name)
        else:
            classes, closed = _attributes(m["rest"])
            page.elements.append(Element(name, classes, stack[-1] if stack else -1, len(page.texts)))
            if name in ("p", "br"):  # told even where they hold no text
                page.texts.append((None, stack[-1] if stack else -1) if name == "br" else ("", len(page.elements) - 1))
            stack.append(len(page.elements) - 1)
            opened[name] += 1
            if name in VOID or closed:
                _close(page, stack, opened, name)
            elif name in HIDDEN:
                hidden = name
    while stack:
        _close(page, stack, opened, page.elements[stack[-1]].name)
    return page


def _close(page: Page, stack: list[int], opened: Counter, name: str) -> None:
    while opened[name]:
        top = page.elements[stack.pop()]
        top.last, top.end_text = len(page.elements), len(page.texts)
        opened[top.name] -= 1
        if top.name == name:
            return


def find(page: Page, cls: str, within: int | None = None, name: str = "div") -> list[int]:
    """Elements of a class inside another one, in the order of the page."""
    first, last = (0, len(page.elements)) if within is None else (within + 1, page.elements[within].last)
    return [k for k in range(first, last) if page.elements[k].name == name and cls in page.elements[k].classes]


def text_of(page: Page, k: int) -> str:
    """Lines of an element that are not blank; paragraphs, and breaks outside of them, end lines."""
    own, out, before = page.elements[k], [], None
    for text, holder in page.texts[own.first_text : own.end_text]:
        inner = list(page.around(holder, k))
        paragraph = next((id(e) for e in reversed(inner) if e.name == "p"), None)  # the outermost
        if paragraph != before:
            out.append("\n")
            before = paragraph
        if text is None:
            out.append("" if paragraph is not None else "\n")
        elif not any(e.name in HIDDEN for e in inner):
            out.append(text)
    return "\n".join(line for line in map(str.strip, "".join(out).split("\n")) if line)


def sections(text: str) -> str:
    """Lines of thinking with a blank line before each that begins a section."""
    out = []
    for line in text.split("\n"):
        begins = line.startswith("**") or any(w in line.lower() for w in SECTION_WORDS)
        if begins or not out:
            out.append(line)
        else:
            out[-1] += "\n" + line
    return "\n\n".join(s.strip() for s in out if s.strip())


def answer(html: str) -> tuple[str, str]:
    """(response, thinking) of a page; empty where a page has no such part."""
    page = read(html)
    response = thinking = ""
    for top in find(page, "response")[:1]:
        shown = find(page, "model-response-text", top)
        if shown:
            chosen = find(page, "markdown", shown[0])
        else:
            chosen = [k for k in find(page, "markdown", top) if not any(e.name == "div" and "thinking" in e.classes or e.name == "model-thoughts" for e in page.around(page.elements[k].parent))]
        response = text_of(page, chosen[0]) if chosen else ""
    for top in find(page, "thinking")[:1]:
        chosen = find(page, "markdown", top)
        thinking = sections(text_of(page, chosen[0])) if chosen else ""
    return response, thinking


@F.pandas_udf(StructType([StructField("response", StringType()), StructField("thinking", StringType())]))
def _answers(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if h is None else answer(h) for h in html], columns=["response", "thinking"])


def answer_texts(html: Column) -> Column:
    """``response`` and ``thinking`` of an answer page; both null for a null page."""
    return _answers(html)
