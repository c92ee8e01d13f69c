"""Djot documents, read into the same trees as Markdown.

Blocks share Markdown's shapes (headings that may go on over lines, fenced code, quotes, lists, tables,
rules); attributes and divs are dropped. Inline marks get Markdown's normal form: ``*strong*`` becomes
``**strong**`` and ``_emphasis_`` becomes ``*emphasis*``.
"""

from __future__ import annotations

import re

from . import markdown
from .markdown import Node

_SPAN = re.compile(r"(`+)(?:.(?!\1(?!`)))*.?\1(?!`)|\\.", re.DOTALL)
_STRONG = re.compile(r"\{?(?<![*\w])\*(?=\S)([^*\n]+?)(?<=\S)\*(?!\*)\}?")
_EMPHASIS = re.compile(r"\{?(?<!\w)_(?=\S)([^_\n]+?)(?<=\S)_(?!\w)\}?")


def _marks(text: str) -> str:
    text = _STRONG.sub("\x01\\1\x01", text)
    text = _EMPHASIS.sub(r"*\1*", text)
    return text.replace("\x01", "**")


def inline(text: str) -> str:
    """Inline marks in Markdown's form; code and escapes stay."""
    out, at = [], 0
    for m in _SPAN.finditer(text):
        out += [_marks(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, _marks(text[at:])])


def parse(body: str, folder: str = "") -> list[Node]:
    lines: list[str] = []
    fence = None
    for line in body.split("\n"):
        if fence:
            lines.append(line)
            fence = None if re.match(rf"^ *{re.escape(fence)}[`~]* *$", line) else fence
            continue
        if m := re.match(r"^ *(`{3,}|~{3,})", line):
            fence = m[1]
            lines.append(line)
        elif re.match(r"^ *(?::{3,}.*|\{[.#%][^}]*\}) *$", line):
            lines.append("")  # divs and block attributes
        else:
            if lines and re.match(r"^#{1,6} ", lines[-1]) and line.strip() and not re.match(r"^ *(?:#|[-*+>|]|\d+[.)])", line):
                lines[-1] += " " + inline(line.strip())  # a heading goes on until a blank line
            else:
                lines.append(inline(line))
    return markdown.parse("\n".join(lines), folder)


markdown.FORMATS["djot"] = parse
