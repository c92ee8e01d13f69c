"""Markdown documents as trees of blocks, and trees as normalised Markdown.

A tree holds sections nested by relative header level, lists with items, quotes, code, tables, rules,
references (a paragraph that is one internal link) and paragraphs. Raw HTML is dropped.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import yaml

from ..functions import yamlcore

CONTAINERS = ("header", "item", "list", "quote")


@dataclass
class Node:
    kind: str  # header paragraph list item quote code table ref hr
    text: str | None = None  # own text in normal form
    children: list[Node] = field(default_factory=list)
    level: int = 0  # of a header as written
    ordered: bool = False
    start: int = 1
    lang: str = ""
    checked: bool | None = None
    rows: list[list[str]] = field(default_factory=list)
    align: list[str] = field(default_factory=list)
    target: str | None = None
    link: str = ""  # of a ref: how it is written
    line: tuple[int, int] = (0, 0)


# front matter


def split_frontmatter(content: str) -> tuple[str | None, str]:
    """The YAML of a leading ``---`` block, and the rest."""
    if content.startswith("---\n"):
        found = re.search(r"^(?:---|\.\.\.)[ \t]*$", content[4:], re.MULTILINE)
        if found:
            return content[4 : 4 + found.start()], content[4 + found.end() :].removeprefix("\n")
    return None, content


def frontmatter(content: str) -> dict:
    """The metadata mapping; empty where there is none or it isn't valid."""
    text, _ = split_frontmatter(content)
    if text is None:
        return {}
    try:
        value = yamlcore.loads(text)
    except (yaml.YAMLError, ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def join_frontmatter(fm: dict, body: str) -> str:
    if not fm:
        return body
    return f"---\n{yamlcore.dumps(fm)}---\n" + (f"\n{body}" if body else "")


def sanitised(content: str) -> str:
    return content.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


# links

_CODE = r"(?P<code>(?P<tick>`+)(?:(?!`).|(?<!`)(?!(?P=tick)(?!`))`+)*?(?P=tick)(?!`))"
_LINK = re.compile(_CODE + r"|(?P<image>!)?(?:\[\[(?P<wiki>[^\]|\n]+)(?:\|(?P<piped>[^\]\n]+))?\]\]|\[(?P<text>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\((?P<url><[^>\n]*>|[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?P<title>\s+(?:\"[^\"]*\"|'[^']*'))?\s*\))", re.DOTALL)


def is_internal(url: str) -> bool:
    return bool(url) and not re.match(r"(?:https?://|mailto:)", url) and not url.startswith("#")


def resolve(url: str, folder: str) -> str:
    """The key a link in a document of ``folder`` points to."""
    path = unquote(url.strip("<>").split("#")[0])
    path = re.sub(r"\.(?:md|dj)$", "", path)
    full = path.lstrip("/") if path.startswith("/") else posixpath.join(folder, path)
    parts: list[str] = []
    for part in full.split("/"):
        if part == "..":
            parts = parts[:-1]
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def relative(key: str, folder: str) -> str:
    return posixpath.relpath(key, folder) if folder else key


def links(text: str, folder: str) -> Iterator[tuple[str, str, bool]]:
    """(key, text, wiki) of each internal link of inline text."""
    for m in _LINK.finditer(text):
        if m["code"] or m["image"]:
            continue
        if m["wiki"]:
            yield re.sub(r"\.(?:md|dj)$", "", m["wiki"].split("#")[0].strip()), m["piped"] or m["wiki"], True
        elif is_internal(m["url"]):
            yield resolve(m["url"], folder), m["text"], False


def _normal_inline(text: str, folder: str) -> str:
    """Inline text on one line with one form of emphasis and of links."""
    text = re.sub(r"[ \t]*\\?\n[ \t]*", " ", text.strip())

    def one(m: re.Match) -> str:
        if m["code"] or m["wiki"] or m["image"] or not is_internal(m["url"]):
            return m[0]
        fragment = "#" + m["url"].split("#", 1)[1] if "#" in m["url"] else ""
        return f"[{m['text']}]({relative(resolve(m['url'], folder), folder)}{fragment}{m['title'] or ''})"

    out, at = [], 0
    for m in _LINK.finditer(text):
        out += [_emphasis(text[at : m.start()]), one(m)]
        at = m.end()
    return "".join([*out, _emphasis(text[at:])])


def _emphasis(text: str) -> str:
    text = re.sub(r"(?<![\w\\])__(?=\S)(.+?)(?<=\S)__(?!\w)", r"**\1**", text)
    return re.sub(r"(?<![\w\\_])_(?=[^\s_])([^_]+?)(?<=[^\s_\\])_(?![\w_])", r"*\1*", text)


def plain_inline(text: str | None) -> str:
    """Inline text without markup: link texts and code stay, marks go."""
    if not text:
        return ""

    def one(m: re.Match) -> str:
        if m["code"]:
            return m["code"].strip("`").strip()
        return m["piped"] or m["wiki"] if m["wiki"] else m["text"] or ""

    out = _LINK.sub(one, text)
    out = re.sub(r"(\*\*|\*|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", out)
    out = re.sub(r"(\*\*|\*|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", out)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", out)


# blocks

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_HR = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*)|)$")
_HTML = re.compile(r"^ {0,3}<(?:[a-zA-Z][\w-]*(?:[\s/>]|$)|/[a-zA-Z]|!--|\?|![A-Z])")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip() for c in re.split(r"(?<!\\)\|", line)]


class _Reader:
    def __init__(self, folder: str):
        self.folder = folder

    def blocks(self, lines: list[str], offset: int = 0) -> list[Node]:
        """Blocks in order; headers are not nested yet."""
        out: list[Node] = []
        i, n = 0, len(lines)
        while i < n:
            line = lines[i]
            start = i
            if not line.strip():
                i += 1
                continue
            if m := _FENCE.match(line):
                mark, info = m[1], m[2].strip()
                indent = len(line) - len(line.lstrip(" "))
                i += 1
                body = []
                while i < n and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i]):
                    body.append(lines[i][min(indent, len(lines[i]) - len(lines[i].lstrip(" "))) :])
                    i += 1
                i += 1
                node = Node("code", "\n".join(body).strip("\n"), lang=info)
            elif line.startswith("    "):
                body = []
                while i < n and (lines[i].startswith("    ") or not lines[i].strip()):
                    body.append(lines[i][4:])
                    i += 1
                node = Node("code", "\n".join(body).strip("\n"))
            elif m := _ATX.match(line):
                node = Node("header", _normal_inline(m[2] or "", self.folder), level=len(m[1]))
                i += 1
            elif _HR.match(line):
                node = Node("hr")
                i += 1
            elif re.match(r"^ {0,3}>", line):
                body = []
                while i < n and lines[i].strip() and (re.match(r"^ {0,3}>", lines[i]) or (body and body[-1].strip() and not self._starts(lines[i]))):
                    body.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                    i += 1
                node = Node("quote", children=nested(self.blocks(body, offset + start)))
            elif (m := _ITEM.match(line)) is not None:
                node, i = self._list(lines, i, m, offset)
            elif _HTML.match(line):
                while i < n and lines[i].strip():
                    i += 1
                continue
            elif i + 1 < n and "|" in line and _DELIMITER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
                width = len(_cells(line))
                align = [("center" if c[0] == c[-1] == ":" else "right" if c[-1] == ":" else "left" if c[0] == ":" else "") for c in _cells(lines[i + 1])]
                rows = [_cells(line)]
                i += 2
                while i < n and lines[i].strip() and not self._starts(lines[i]):
                    rows.append((_cells(lines[i]) + [""] * width)[:width])
                    i += 1
                node = Node("table", rows=[[_normal_inline(c, self.folder) for c in r] for r in rows], align=align)
                node.text = "\n".join(x for k, x in enumerate(_table(node)) if k != 1)
            else:
                node, i = self._paragraph(lines, i)
                if node is None:
                    continue
            node.line = (offset + start, offset + i)
            out.append(node)
        return out

    def _starts(self, line: str) -> bool:
        """Whether a line interrupts a paragraph."""
        m = _ITEM.match(line)
        item = m and (m[4] or "").strip() and (m[2] in "-*+" or m[2][:-1] == "1")
        return bool(item or _FENCE.match(line) or _ATX.match(line) or _HR.match(line) or re.match(r"^ {0,3}>", line))

    def _paragraph(self, lines: list[str], i: int) -> tuple[Node | None, int]:
        body = []
        while i < len(lines) and lines[i].strip():
            if body and (m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[i])):
                return Node("header", _normal_inline("\n".join(body), self.folder), level=1 if m[1][0] == "=" else 2), i + 1
            if body and self._starts(lines[i]):
                break
            body.append(lines[i].strip(" ") if not body else lines[i].lstrip(" "))
            i += 1
        text = "\n".join(body)
        return self._inline_block(text), i

    def _inline_block(self, text: str) -> Node:
        m = _LINK.fullmatch(text.strip())
        if m and not m["code"] and not m["image"]:
            if m["wiki"]:
                return Node("ref", m["piped"], target=re.sub(r"\.(?:md|dj)$", "", m["wiki"].split("#")[0].strip()), link="piped" if m["piped"] else "wiki")
            if is_internal(m["url"]):
                node = Node("ref", None, target=resolve(m["url"], self.folder), link="regular")
                node.lang = m["text"]  # the link text as written
                return node
        return Node("paragraph", _normal_inline(text, self.folder))

    def _list(self, lines: list[str], i: int, m: re.Match, offset: int) -> tuple[Node, int]:
        ordered = m[2][0].isdigit()
        mark = m[2][-1]
        out = Node("list", ordered=ordered, start=int(m[2][:-1]) if ordered else 1)
        n = len(lines)
        while i < n:
            m = _ITEM.match(lines[i])
            if not m or _HR.match(lines[i]) or m[2][-1] != mark or m[2][0].isdigit() != ordered:
                break
            start = i
            gap = len((m[3] or " ").expandtabs(4))
            width = len(m[1]) + len(m[2]) + (gap if gap <= 4 and (m[4] or "").strip() else 1)
            body = [(m[4] or "") if gap <= 4 else " " * (gap - 1) + (m[4] or "")]
            i += 1
            while i < n:
                if not lines[i].strip():
                    k = i
                    while k < n and not lines[k].strip():
                        k += 1
                    if k == n or len(lines[k]) - len(lines[k].lstrip(" ")) < width:
                        break
                    body += [""] * (k - i)
                    i = k
                elif len(lines[i]) - len(lines[i].lstrip(" ")) >= width:
                    body.append(lines[i][width:])
                    i += 1
                elif body[-1].strip() and not self._starts(lines[i]) and not _ITEM.match(lines[i]):
                    body.append(lines[i].lstrip(" "))
                    i += 1
                else:
                    break
            out.children += self._item(body, offset + start)
            k = i
            while k < n and not lines[k].strip():
                k += 1
            if k < n and k > i and (m2 := _ITEM.match(lines[k])) and m2[2][-1] == mark and m2[2][0].isdigit() == ordered and not _HR.match(lines[k]):
                i = k
        return out, i

    def _item(self, body: list[str], offset: int) -> list[Node]:
        checked = None
        if m := re.match(r"^\[([ xX])\](?:[ \t]+(.*))?$", body[0]):
            checked, body = m[1] != " ", [m[2] or "", *body[1:]]
        inner = self.blocks(body, offset)
        item = Node("item", "", checked=checked, line=(offset, offset + len(body)))
        if inner and inner[0].kind in ("paragraph", "header"):
            item.text = inner[0].text
            inner = inner[1:]
        elif inner and inner[0].kind == "ref" and len(inner) >= 1:
            item.text = _normal_inline(written(inner[0], self.folder), self.folder)
            inner = inner[1:]
        elif inner and inner[0].kind == "list" and checked is None:
            # an item that only opens another list is that list's items
            first, inner = inner[0].children, inner[1:]
            first[-1].children += inner
            return first
        item.children = [Node("paragraph", b.text) if b.kind == "header" else b for b in inner]
        return [item]


def nested(flat: list[Node]) -> list[Node]:
    """Blocks under their headers, by relative level."""
    out: list[Node] = []
    stack: list[Node] = []
    for node in flat:
        if node.kind == "header":
            while stack and stack[-1].level >= node.level:
                stack.pop()
        (stack[-1].children if stack else out).append(node)
        if node.kind == "header":
            stack.append(node)
    return out


def parse(body: str, folder: str = "") -> list[Node]:
    return nested(_Reader(folder).blocks(body.split("\n")))


def parse_inline(text: str, folder: str = "") -> str:
    return _normal_inline(text, folder)


# rendering


def written(ref: Node, folder: str = "") -> str:
    if ref.link == "wiki":
        return f"[[{ref.target}]]"
    if ref.link == "piped":
        return f"[[{ref.target}|{ref.text}]]"
    return f"[{ref.lang}]({relative(ref.target or '', folder)})"


def _table(node: Node) -> list[str]:
    width = [max(3, *(len(r[k]) for r in node.rows)) for k in range(len(node.rows[0]))]

    def cell(text: str, k: int) -> str:
        return text.rjust(width[k]) if node.align[k] == "right" else text.center(width[k]) if node.align[k] == "center" else text.ljust(width[k])

    rule = [(":" if a in ("left", "center") else "-") + "-" * (w - 2) + (":" if a in ("right", "center") else "-") for a, w in zip(node.align, width, strict=True)]
    body = ["| " + " | ".join(cell(c, k) for k, c in enumerate(r)) + " |" for r in node.rows]
    return [body[0], "| " + " | ".join(rule) + " |", *body[1:]]


def lines_of(nodes: list[Node], level: int = 1, folder: str = "") -> list[str]:
    out: list[str] = []
    for i, node in enumerate(nodes):
        if i:
            out.append("")
        out += _lines(node, level, folder)
    return out


def _lines(node: Node, level: int, folder: str) -> list[str]:
    if node.kind == "header":
        own = [f"{'#' * min(6, node.level if node.level < 0 else level)} {node.text}".rstrip()]
        return own + ([""] + lines_of(node.children, level + 1, folder) if node.children else [])
    if node.kind == "list":
        out: list[str] = []
        for k, item in enumerate(node.children):
            out += _item_lines(item, f"{node.start + k}. " if node.ordered else "- ", level, folder)
        return out
    if node.kind == "item":
        return _item_lines(node, "- ", level, folder)
    if node.kind == "quote":
        return [f"> {x}".rstrip() for x in lines_of(node.children, 1, folder)] or [">"]
    if node.kind == "code":
        mark = "`" * max([3, *(len(m) + 1 for m in re.findall(r"^`{3,}", node.text or "", re.MULTILINE))])
        return [f"{mark}{' ' if node.lang else ''}{node.lang}".replace(f"{mark} ", mark), *(node.text or "").split("\n"), mark]
    if node.kind == "table":
        return _table(node)
    if node.kind == "hr":
        return ["-" * 72]
    if node.kind == "ref":
        return [written(node, folder)]
    return [node.text or ""]


def _item_lines(item: Node, mark: str, level: int, folder: str) -> list[str]:
    box = "" if item.checked is None else "[x] " if item.checked else "[ ] "
    pad = " " * len(mark)
    inner: list[str] = []
    for k, child in enumerate(item.children):
        if not (child.kind == "list" and (k == 0 or item.children[k - 1].kind == "list")) and (k or item.text or box):
            inner.append("")
        inner += _lines(child, level, folder)
    if not item.text and not box and inner:
        return [mark + inner[0], *((pad + x) if x else "" for x in inner[1:])]
    return [(mark + box + (item.text or "")).rstrip(), *((pad + x) if x else "" for x in inner)]


def render(nodes: list[Node], folder: str = "") -> str:
    text = "\n".join(lines_of(nodes, 1, folder))
    return text + "\n" if text else ""


def normalise(content: str, folder: str = "") -> str:
    """A document in normal form, metadata as written."""
    raw, body = split_frontmatter(content)
    out = render(parse(body, folder), folder)
    return out if raw is None else f"---\n{raw}---\n" + (f"\n{out}" if out else "")


# flat views


def walk(nodes: list[Node], parent: int = -1, depth: int = 0, path: tuple[str, ...] = (), top: bool = True) -> Iterator[tuple[Node, int, int, tuple[str, ...]]]:
    """(node, parent place, depth, section path) in pre-order; places count from 0."""
    counter = [0]

    def go(children, parent, depth, path, top):
        for node in children:
            place = counter[0]
            counter[0] += 1
            yield node, parent, depth, path
            inner = (*path, plain_inline(node.text).strip()) if node.kind == "header" and not top else path
            yield from go(node.children, place, depth + 1, inner, False)

    yield from go(nodes, parent, depth, path, top)


def size(node: Node) -> int:
    return 1 + sum(size(c) for c in node.children)


def targets(node: Node, folder: str) -> list[tuple[str, bool]]:
    """(key, wiki) of each link in a block's own content."""
    if node.kind == "ref":
        return [(node.target or "", node.link != "regular")]
    if node.kind == "table":
        return [(k, w) for r in node.rows for c in r for k, _, w in links(c, folder)]
    if node.kind in ("header", "paragraph", "item"):
        return [(k, w) for k, _, w in links(node.text or "", folder)]
    return []


def plain_text(nodes: list[Node]) -> str:
    """One line for each block's text without markup."""
    out = []
    for node, *_ in walk(nodes):
        if node.kind == "code":
            text = node.text
        elif node.kind == "table":
            text = "\n".join(" ".join(plain_inline(c) for c in r) for r in node.rows)
        elif node.kind == "ref":
            text = node.text or node.lang
        else:
            text = plain_inline(node.text)
        if text:
            out.append(text)
    return "\n".join(out)


def title(nodes: list[Node]) -> str | None:
    return plain_inline(nodes[0].text) if nodes and nodes[0].kind == "header" else None


#: Formats by name: content, folder -> tree. Others may be added.
FORMATS: dict[str, Callable[[str, str], list[Node]]] = {"markdown": parse}
