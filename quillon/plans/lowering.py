"""Selectors given as flags or tool parameters, lowered to filters and projections."""

from __future__ import annotations

from . import ir
from .parse import QueryError, check_regex, parse_blocks, parse_filter_expression, parse_projection_expression, yamlcore


def anchor(text: str | dict, kind: str, default: int | None) -> ir.Relation:
    """``KEY`` or ``KEY:DEPTH`` or {key, depth}; depth 0 has no bound. ``default`` None is unbounded too."""
    if isinstance(text, dict):
        key, depth = text["key"], text.get("depth")
    else:
        key, colon, given = text.rpartition(":")
        if not colon:
            key, depth = text, None
        elif given.isdigit() and int(given) <= 255:
            depth = int(given)
        else:
            raise QueryError("InvalidDepthValue", op=f"${kind}", modifier=text)
    depth = default if depth is None else depth
    return ir.Relation(kind, ir.KeyTest("eq", (key,)), 1, depth or ir.UNBOUNDED)


def _has_key(node) -> bool:
    return isinstance(node, ir.KeyTest) or isinstance(node, ir.All) and any(map(_has_key, node.parts))


def selector(
    filter: str | None = None,
    key: list[str] = (),
    roots: bool = False,
    includes: list = (),
    included_by: list = (),
    references: list = (),
    referenced_by: list = (),
    in_: list = (),
    in_any: list = (),
    not_in: list = (),
    refs_to: str | None = None,
    refs_from: str | None = None,
    max_depth: int | None = 1,
    max_distance: int | None = 1,
):
    """The conjunction of all flags, or None where none is given.

    Command lines take anchors to depth 1 unless told otherwise; tools pass ``max_depth=None``, which is unbounded.
    """
    parts: list = []
    if filter is not None:
        parsed = parse_filter_expression(filter)
        if key and _has_key(parsed):
            raise QueryError("KeyConflict", message="keys are given both as a flag and in the filter")
        parts.append(parsed)
    if key:
        parts.append(ir.KeyTest("eq" if len(key) == 1 else "in", tuple(key)))
    for kind, given, depth in (("includes", includes, max_depth), ("includedBy", [*included_by, *in_], max_depth), ("references", references, max_distance), ("referencedBy", referenced_by, max_distance)):
        parts += [anchor(a, kind, depth) for a in given]
    if roots:
        parts.append(ir.Relation("includedBy", ir.All(()), 1, 1, ir.CountTest((("eq", 0),))))
    if in_any:
        parts.append(ir.AnyOf(tuple(anchor(a, "includedBy", max_depth) for a in in_any)))
    parts += [ir.NoneOf((anchor(a, "includedBy", max_depth),)) for a in not_in]
    for key_, kinds in ((refs_to, ("includes", "references")), (refs_from, ("includedBy", "referencedBy"))):
        if key_ is not None:
            parts.append(ir.AnyOf(tuple(anchor({"key": key_}, k, 1) for k in kinds)))
    return None if not parts else parts[0] if len(parts) == 1 else ir.All(tuple(parts))


def find_operation(where=None, project: str | None = None, add_fields: str | None = None, blocks: str | None = None, matches: str | None = None, sort: ir.Sort | None = None, limit: int = 0, lexical: str | None = None, fuzzy: str | None = None) -> ir.Operation:
    """A find operation out of flags. ``blocks`` adds located blocks; ``matches`` is both a filter and a field."""
    if project is not None and (add_fields is not None or blocks is not None or matches is not None):
        raise QueryError("ProjectAddFieldsConflict")
    projection = parse_projection_expression(project) if project is not None else parse_projection_expression(add_fields, "document") if add_fields is not None else ir.Projection((), "document")
    extra = []
    if blocks is not None:
        extra.append(("blocks", ir.Source("blocks", parse_blocks(yamlcore.loads(blocks) or {}, "$blocks"))))
    if matches is not None:
        pattern = check_regex(matches)
        extra.append(("matches", ir.Source("matches", (), pattern)))
        content = ir.Content((ir.BlockTest("matches", pattern),))
        where = content if where is None else ir.All((where, content))
    search = ir.Search(lexical, fuzzy) if lexical is not None or fuzzy is not None else None
    return ir.Operation("find", where, search, ir.Projection(projection.fields + tuple(extra), projection.base), sort, limit)
