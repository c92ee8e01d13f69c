"""Editor edits of one document's tree: lists to sections and back, list kinds, order, links."""

from __future__ import annotations

from dataclasses import replace

from ..functions.blocktree import Index
from ..sources import markdown
from ..sources.markdown import Node
from .edits import _rebuilt, _Slot, folder_of


def _changed(key: str, content: str, edit) -> str:
    folder = folder_of(key)
    raw, body = markdown.split_frontmatter(markdown.sanitised(content))
    tree = markdown.parse(body, folder)
    index = Index(tree, folder)
    text = markdown.normalise(markdown.render(_rebuilt(tree, edit(index), 0), folder), folder)
    return text if raw is None else f"---\n{raw}---\n\n{text}"


def _sections(items: list[Node]) -> list[Node]:
    out = []
    for item in items:
        inner = []
        for child in item.children:
            inner += _sections(child.children) if child.kind == "list" else [child]
        out.append(Node("header", item.text, inner))
    return out


def _items(sections: list[Node]) -> Node:
    out = Node("list")
    for s in sections:
        inner = [c for c in s.children if c.kind != "header"]
        below = [c for c in s.children if c.kind == "header"]
        out.children.append(Node("item", s.text, inner + ([_items(below)] if below else [])))
    return out


def list_to_sections(key: str, content: str, place: int) -> str:
    """The list at a place becomes sections, its nested lists sections below them."""
    return _changed(key, content, lambda ix: {place: _Slot(instead=_sections(ix.entries[place].node.children))})


def sections_to_list(key: str, content: str, place: int) -> str:
    """The section at a place becomes a list with one item, sections below it nested lists."""
    return _changed(key, content, lambda ix: {place: _Slot(instead=[_items([ix.entries[place].node])])})


def change_list(key: str, content: str, place: int) -> str:
    """Bullets become numbers and the other way round."""

    def edit(ix: Index):
        node = ix.entries[place].node
        return {place: _Slot(instead=[replace(node, ordered=not node.ordered, start=1)])}

    return _changed(key, content, edit)


def sort_list(key: str, content: str, place: int, descending: bool = False) -> str:
    """The items of a list by their text; equal texts keep their order."""

    def edit(ix: Index):
        node = ix.entries[place].node
        return {place: _Slot(instead=[replace(node, children=sorted(node.children, key=lambda n: markdown.plain_inline(n.text).lower(), reverse=descending))])}

    return _changed(key, content, edit)


def toggle_item(key: str, content: str, place: int) -> str:
    """Ticks an item's box, or takes the tick away; an item without a box gets one."""

    def edit(ix: Index):
        node = ix.entries[place].node
        return {place: _Slot(instead=[replace(node, checked=not node.checked)])}

    return _changed(key, content, edit)


def unlink(key: str, content: str, place: int) -> str:
    """The links of a block become their texts."""
    from .edits import map_links

    def edit(ix: Index):
        node = ix.entries[place].node
        if node.kind == "ref":
            return {place: _Slot(instead=[Node("paragraph", node.text or node.lang or node.target)])}
        text = map_links(key, node.text or "", lambda *_: None).strip("\n")
        return {place: _Slot(text=text)}

    return _changed(key, content, edit)


def link(key: str, content: str, place: int, target: str) -> str:
    """A paragraph's whole text becomes an inclusion of ``target``."""

    def edit(ix: Index):
        node = ix.entries[place].node
        return {place: _Slot(instead=[Node("ref", None, target=target, link="regular", lang=markdown.plain_inline(node.text))])}

    return _changed(key, content, edit)
