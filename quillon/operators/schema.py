"""Schemas of metadata: what is there (inference) and what should be (validation)."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields, tokens, yamlcore
from ..functions.text import matches_globs
from ..plans.staging import staged
from ..sources import markdown
from ..sources.markdown import Node

#: Values are listed for fields with at most so many different ones.
MOST_VALUES = 100
DIALECT = "https://document-schema.org/draft/2026-06/schema"

# inference


def field_values(rows: DataFrame) -> DataFrame:
    """(key, path, type, value): every field of the metadata, mappings inside mappings too.

    ``value`` is the text of a scalar that looks like one of a set; null for others.
    """

    def opened(level: DataFrame) -> DataFrame:
        return level.select("key", "path", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("k", "v")).where(~F.col("k").rlike(r"^[_$.#@]")).select("key", F.when(F.col("path") == "", F.col("k")).otherwise(F.concat_ws(".", "path", "k")).alias("path"), "v")

    level = opened(rows.select("key", F.lit("").alias("path"), F.col("fm").alias("v")))
    parts = [level]
    while True:  # ends, since mappings are finite
        inner = level.where(F.schema_of_variant("v").startswith("OBJECT"))
        if inner.isEmpty():
            break
        level = opened(inner)
        parts.append(level)
    every = reduce(DataFrame.unionByName, parts)
    kind = fields.class_of(F.col("v"))
    text = F.try_variant_get("v", "$", "string")
    kind = F.when((kind == "string") & text.rlike(fields.DATE), "date").when((kind == "string") & text.rlike(fields.DATETIME), "datetime").otherwise(kind)
    value = F.when(F.col("type") == "null", "null").when(F.col("type").isin("boolean", "number"), F.to_json("v")).when(F.col("type").isin("string", "date", "datetime") & text.rlike(r"^[\p{L}\p{N}\-_./]+\z"), text)
    return every.withColumn("type", kind).select("key", "path", "type", value.alias("value"))


def types(values: DataFrame) -> DataFrame:
    """(path, type, n, percentage)."""
    counts = values.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percentage", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("path")))


def coverage(values: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, n, percentage): documents that have the field."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return values.groupBy("path").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("path", "n", (100.0 * F.col("n") / F.col("total")).alias("percentage"))


def value_counts(values: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """(path, value, n) of fields with at most ``most`` different values."""
    counts = values.where("value IS NOT NULL").groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"))
    few = counts.groupBy("path").agg(F.count(F.lit(1)).alias("distinct")).where(F.col("distinct") <= most).select("path")
    return counts.join(few, "path")


def infer(rows: DataFrame) -> DataFrame:
    """(path, n, percentage, distinct, types, values): one row a field."""
    found = staged(field_values(rows), "fields")
    distinct = found.where("value IS NOT NULL").groupBy("path").agg(F.countDistinct("value").alias("distinct"))
    listed = lambda df, col: df.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(col).alias(col), "n"))), lambda x: F.struct(x[col].alias(col), x["n"].alias("n"))).alias(f"{col}s"))
    return coverage(found, rows).join(distinct, "path", "left").join(listed(types(found), "type"), "path", "left").join(listed(value_counts(found), "value"), "path", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def report(rows: DataFrame) -> str:
    """The inferred schema as a Markdown table."""
    out = ["| Field | Types | Coverage | Values |", "| --- | --- | --- | --- |"]
    for r in infer(rows).orderBy("path").collect():
        out.append(f"| {r['path']} | {', '.join(x['type'] for x in r['types'])} | {r['n']} ({r['percentage']:.0f}%) | {', '.join(x['value'] for x in (r['values'] or [])[:10])} |")
    return "\n".join(out) + "\n"


# validation

FOUND = "key string, schema string, path string, keyword string, message string"


class SchemaError(ValueError):
    """A schema document that can't be used."""


_JSON_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is(value: Any, name: str) -> bool:
    if name == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if name == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    return isinstance(value, _JSON_TYPES[name]) and not (name != "boolean" and isinstance(value, bool))


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return type(a) is type(b) and a == b or _is(a, "number") and _is(b, "number") and a == b


_FORMATS = {
    "date": r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])",
    "date-time": r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})",
    "time": r"\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})?",
    "email": r"[^@\s]+@[^@\s]+",
    "uri": r"[A-Za-z][A-Za-z0-9+.-]*:\S+",
    "uuid": r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "ipv4": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}",
}


def json_errors(schema: Any, value: Any, path: str = "", root: Any = None) -> list[tuple[str, str, str]]:
    """(path, keyword, message) of each violation of a JSON Schema (2020-12, references inside the document)."""
    root = schema if root is None else root
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [(path, "false", "nothing is allowed here")]
    out: list[tuple[str, str, str]] = []
    bad = lambda keyword, message: out.append((path, keyword, message))
    inner = lambda s, v, p=path: json_errors(s, v, p, root)
    for k, arg in schema.items():
        if k == "$ref":
            if not arg.startswith("#"):
                raise SchemaError(f"only references inside the document are allowed: {arg}")
            at = root
            for part in arg[1:].split("/")[1:]:
                part = part.replace("~1", "/").replace("~0", "~")
                at = at[int(part)] if isinstance(at, list) else at[part]
            out += inner(at, value)
        elif k == "type":
            names = arg if isinstance(arg, list) else [arg]
            if not any(_is(value, n) for n in names):
                bad(k, f"must be {' or '.join(names)}")
        elif k == "enum" and not any(_same(value, a) for a in arg):
            bad(k, "must be one of " + ", ".join(json.dumps(a, ensure_ascii=False) for a in arg))
        elif k == "const" and not _same(value, arg):
            bad(k, f"must be {json.dumps(arg, ensure_ascii=False)}")
        elif k == "allOf":
            for s in arg:
                out += inner(s, value)
        elif k == "anyOf" and not any(not inner(s, value) for s in arg):
            bad(k, "matches none of the alternatives")
        elif k == "oneOf" and (n := sum(not inner(s, value) for s in arg)) != 1:
            bad(k, f"matches {n} of the alternatives, not one")
        elif k == "not" and not inner(arg, value):
            bad(k, "must not match")
        elif k == "if":
            branch = "else" if inner(arg, value) else "then"
            out += inner(schema.get(branch, True), value)
        if isinstance(value, str):
            if k == "minLength" and len(value) < arg:
                bad(k, f"must have at least {arg} characters")
            elif k == "maxLength" and len(value) > arg:
                bad(k, f"must have at most {arg} characters")
            elif k == "pattern" and not re.search(arg, value):
                bad(k, f"must match {arg}")
            elif k == "format" and arg in _FORMATS and not re.fullmatch(_FORMATS[arg], value):
                bad(k, f"must be a {arg}")
        elif _is(value, "number"):
            tests = {"minimum": value < arg, "maximum": value > arg, "exclusiveMinimum": value <= arg, "exclusiveMaximum": value >= arg} if _is(arg, "number") else {}
            if tests.get(k):
                bad(k, f"violates {k} {arg}")
            elif k == "multipleOf" and (value / arg) % 1:
                bad(k, f"must be a multiple of {arg}")
        elif isinstance(value, list):
            if k == "minItems" and len(value) < arg or k == "maxItems" and len(value) > arg:
                bad(k, f"violates {k} {arg}")
            elif k == "uniqueItems" and arg and any(_same(a, b) for i, a in enumerate(value) for b in value[:i]):
                bad(k, "must have different items")
            elif k == "prefixItems":
                for i, (s, v) in enumerate(zip(arg, value, strict=False)):
                    out += inner(s, v, f"{path}/{i}")
            elif k == "items":
                start = len(schema.get("prefixItems", []))
                for i, v in enumerate(value[start:], start):
                    out += inner(arg, v, f"{path}/{i}")
            elif k == "contains":
                n = sum(not inner(arg, v) for v in value)
                if n < schema.get("minContains", 1):
                    bad(k, "has too few matching items")
                if n > schema.get("maxContains", n):
                    bad("maxContains", "has too many matching items")
        elif isinstance(value, dict):
            if k == "required":
                out += [(path, k, f"lacks {name!r}") for name in arg if name not in value]
            elif k == "properties":
                for name, s in arg.items():
                    if name in value:
                        out += inner(s, value[name], f"{path}/{name}")
            elif k == "patternProperties":
                for p, s in arg.items():
                    for name in value:
                        if re.search(p, name):
                            out += inner(s, value[name], f"{path}/{name}")
            elif k == "additionalProperties":
                for name in value:
                    if name not in schema.get("properties", {}) and not any(re.search(p, name) for p in schema.get("patternProperties", {})):
                        if arg is False:
                            bad(k, f"{name!r} is not allowed")
                        else:
                            out += inner(arg, value[name], f"{path}/{name}")
            elif k == "propertyNames":
                for name in value:
                    out += [(path, k, f"{name!r}: {m}") for _, _, m in inner(arg, name)]
            elif k in ("minProperties", "maxProperties") and (len(value) < arg if k == "minProperties" else len(value) > arg):
                bad(k, f"violates {k} {arg}")
            elif k == "dependentRequired":
                for name, needs in arg.items():
                    if name in value:
                        out += [(path, k, f"{name!r} needs {x!r}") for x in needs if x not in value]
    return out


_SECTION = {"header", "maxTokens", "maxDepth", "minContains", "maxContains", "description", "allSections", "sections", "additionalSections", "blocks", "additionalBlocks", "allBlocks"}
_DOCUMENT = {"$schema", "description", "frontmatter", "maxTokens", "maxDepth", "allSections", "sections", "additionalSections", "blocks", "additionalBlocks", "allBlocks"}
_HEADER = {"pattern", "const", "enum", "minLength", "maxLength", "maxTokens", "description"}
_REDUCED = {"header", "maxTokens", "maxDepth", "description"}
KINDS = ("paragraph", "bullet-list", "ordered-list", "code", "quote", "table", "rule")
_LISTS = {"bullet-list", "ordered-list"}
_BLOCK = {"type", "text", "maxTokens", "minContains", "maxContains", "description"}
#: Keywords that only some types take.
_ONLY = {"lang": {"code"}, "items": _LISTS, "minItems": _LISTS, "maxItems": _LISTS, "blocks": {"quote"}, "additionalBlocks": {"quote"}, "allBlocks": {"quote"}}
_ITEM = {"text", "maxTokens", "description", "blocks", "additionalBlocks", "allBlocks"}
_REDUCED_BLOCK = {"text", "maxTokens", "description"}
#: The part of a text schema that decides what binds.
_IDENTITY = ("const", "enum", "pattern")


def _types(entry: dict) -> list[str]:
    given = entry.get("type", list(KINDS))
    return given if isinstance(given, list) else [given]


def _check_blocks(schema: dict, where: str) -> None:
    """Block entries below a document, section, quote or item."""
    seen = []
    for i, s in enumerate(schema.get("blocks", [])):
        here = f"{where}/blocks/{i}"
        check_schema(s, here, _BLOCK | set(_ONLY))
        if unknown := [t for t in _types(s) if t not in KINDS]:
            raise SchemaError(f"{here}: unknown type {unknown[0]!r}")
        for k, kinds in _ONLY.items():
            if k in s and not set(_types(s)) <= kinds:
                raise SchemaError(f"{here}: {k} does not go with {', '.join(_types(s))}")
        same = (_types(s), {k: v for k, v in s.get("text", {}).items() if k in _IDENTITY}, s.get("lang"))
        if same in seen:
            raise SchemaError(f"{here}: an entry before it takes every such block")
        seen.append(same)
        if "items" in s:
            check_schema(s["items"], f"{here}/items", _ITEM)
    for k in ("allBlocks", "additionalBlocks"):
        if isinstance(schema.get(k), dict):
            check_schema(schema[k], f"{where}/{k}", _REDUCED_BLOCK)


def check_schema(schema: dict, where: str = "", known: set[str] = _DOCUMENT) -> None:
    """Raises ``SchemaError`` for a schema document that isn't valid."""
    if not isinstance(schema, dict):
        raise SchemaError(f"{where or 'schema'} must be a mapping")
    if extra := set(schema) - known:
        raise SchemaError(f"{where}: unknown keyword {sorted(extra)[0]!r}")
    if schema.get("$schema", DIALECT) != DIALECT:
        raise SchemaError(f"unknown dialect {schema['$schema']!r}")
    for name in ("header", "text", "lang"):
        if name in schema:
            check_schema(schema[name], f"{where}/{name}", _HEADER)
            if "const" in schema[name] and "enum" in schema[name]:
                raise SchemaError(f"{where}/{name}: enum and const can't be combined")
    _check_blocks(schema, where)
    entries = schema.get("sections", [])
    for i, s in enumerate(entries):
        check_schema(s, f"{where}/sections/{i}", _SECTION)
        if not s.get("header") and i < len(entries) - 1:
            raise SchemaError(f"{where}/sections/{i}: a section without a header schema must be the last")
    for k in ("allSections", "additionalSections"):
        if isinstance(schema.get(k), dict):
            check_schema(schema[k], f"{where}/{k}", _REDUCED)
    for k in ("minContains", "maxContains", "maxTokens", "maxDepth", "minItems", "maxItems", "minLength", "maxLength"):
        if k in schema and not _is(schema[k], "integer"):
            raise SchemaError(f"{where}/{k} must be an integer")


def header_errors(schema: dict, text: str) -> list[tuple[str, str]]:
    """(keyword, message) of a heading's violations."""
    out = [(k, m) for _, k, m in json_errors({k: v for k, v in schema.items() if k not in ("maxTokens", "description")}, text)]
    if "maxTokens" in schema and (n := tokens.count(text)) > schema["maxTokens"]:
        out.append(("maxTokens", f"has {n} tokens, at most {schema['maxTokens']} allowed"))
    return out


def _binds(schema: dict, text: str) -> bool:
    return not header_errors({k: v for k, v in schema.items() if k in _IDENTITY}, text)


def kind_of(node: Node) -> str:
    return {"list": "ordered-list" if node.ordered else "bullet-list", "ref": "paragraph", "hr": "rule"}.get(node.kind, node.kind)


def _own(node: Node) -> str:
    """A block's plain text; containers have none."""
    if node.kind in ("list", "quote", "hr"):
        return ""
    if node.kind == "table":
        return "\n".join(" ".join(markdown.plain_inline(c) for c in r) for r in node.rows)
    if node.kind == "ref":
        return node.text or node.lang or node.target or ""
    return node.text or "" if node.kind == "code" else markdown.plain_inline(node.text)


def _name(entry: dict, i: int) -> str:
    h = entry.get("header", {})
    return str(h.get("const") or h.get("enum") or h.get("pattern") or f"#{i + 1}")


class _Checker:
    def __init__(self, folder: str):
        self.folder, self.out, self.trace = folder, [], []

    def bad(self, path: str, keyword: str, message: str, hint: str | None = None) -> None:
        self.out.append((path, keyword, f"{message} ({hint})" if hint else message))

    def tokens(self, nodes: list[Node], schema: dict, path: str) -> None:
        if "maxTokens" in schema and (n := tokens.count(markdown.render(nodes, self.folder))) > schema["maxTokens"]:
            self.bad(path, "maxTokens", f"has {n} tokens, at most {schema['maxTokens']} allowed", schema.get("description"))

    def depth(self, nodes: list[Node], schema: dict, path: str) -> None:
        if "maxDepth" in schema and (n := _deepest(nodes)) > schema["maxDepth"]:
            self.bad(path, "maxDepth", f"nests {n} levels, at most {schema['maxDepth']} allowed", schema.get("description"))

    def reduced(self, node: Node, schema: dict, path: str) -> None:
        for keyword, message in header_errors(schema.get("header", {}), markdown.plain_inline(node.text)):
            self.bad(path, f"header/{keyword}", message, schema.get("description"))
        self.tokens([node], schema, path)
        self.depth(node.children, schema, path)

    def matched(self, things: list, entries: list[dict], fits) -> list[int | None]:
        """The entry of each thing: in order, greedy, no way back."""
        at, out = 0, []
        for thing in things:
            hit = next((i for i in range(at, len(entries)) if fits(entries[i], thing)), None)
            at = at if hit is None else hit
            out.append(hit)
        return out

    def occurrences(self, hits: list[int | None], entries: list[dict], path: str, what, hint: str | None) -> None:
        for i, entry in enumerate(entries):
            n, high = hits.count(i), entry.get("maxContains")
            if n < entry.get("minContains", 1):
                self.bad(path or "/", "minContains", f"required {what(entry, i)} missing", entry.get("description", hint))
            if high is not None and n > high:
                self.bad(path or "/", "maxContains", f"{what(entry, i)} occurs {n} times (limit {high})", entry.get("description", hint))

    def level(self, nodes: list[Node], schema: dict, path: str, sections: list[dict], blocks: list[dict]) -> None:
        """Content blocks, then sections, of a document or section against its schema."""
        hint = schema.get("description")
        sections = sections + ([schema["allSections"]] if "allSections" in schema else [])
        blocks = self.content([n for n in nodes if n.kind != "header"], schema, path, blocks)
        heads, entries = [n for n in nodes if n.kind == "header"], schema.get("sections", [])
        hits = self.matched(heads, entries, lambda e, n: _binds(e.get("header", {}), markdown.plain_inline(n.text)))
        for node, hit in zip(heads, hits, strict=True):
            title = markdown.plain_inline(node.text)
            here = f"{path}/{title}"
            for s in sections:
                self.reduced(node, s, here)
            self.trace.append((here, "additional" if hit is None else _name(entries[hit], hit)))
            entry = {} if hit is None else entries[hit]
            if hit is None:
                rest = schema.get("additionalSections", True)
                if rest is False:
                    self.bad(here, "additionalSections", "section is not allowed here", hint)
                elif isinstance(rest, dict):
                    self.reduced(node, rest, here)
            else:
                self.reduced(node, entry, here)
            self.level(node.children, entry, here, sections, blocks)
        self.occurrences(hits, entries, path, lambda e, i: f"section {_name(e, i)!r}", hint)

    def content(self, nodes: list[Node], schema: dict, path: str, everywhere: list[dict]) -> list[dict]:
        """Content blocks against the block entries of their container; gives the schemas for all blocks below."""
        everywhere = everywhere + ([schema["allBlocks"]] if "allBlocks" in schema else [])
        entries = schema.get("blocks", [])

        def fits(entry: dict, node: Node) -> bool:
            return kind_of(node) in _types(entry) and _binds(entry.get("text", {}), _own(node)) and ("lang" not in entry or _binds(entry["lang"], node.lang))

        hits = self.matched(nodes, entries, fits)
        for k, (node, hit) in enumerate(zip(nodes, hits, strict=True)):
            here = f"{path}/blocks[{k}]"
            for s in everywhere:
                self.block(node, s, here)
            entry = {} if hit is None else entries[hit]
            if hit is not None:
                self.block(node, entry, here)
            elif schema.get("additionalBlocks", True) is False:
                self.bad(here, "additionalBlocks", f"{kind_of(node)} is not allowed here", schema.get("description"))
            elif isinstance(schema.get("additionalBlocks"), dict):
                self.block(node, schema["additionalBlocks"], here)
            if node.kind == "quote":
                self.content(node.children, entry, here, everywhere)
            elif node.kind == "list":
                self.items(node, entry, here, everywhere)
        self.occurrences(hits, entries, path, lambda e, i: f"block {(e.get('text') or {}).get('const') or (e.get('text') or {}).get('enum') or e.get('type') or '#%d' % (i + 1)!r}", schema.get("description"))
        return everywhere

    def items(self, node: Node, entry: dict, path: str, everywhere: list[dict]) -> None:
        n = len(node.children)
        for k, bad in (("minItems", n < entry.get("minItems", 0)), ("maxItems", n > entry.get("maxItems", n))):
            if bad:
                self.bad(path, k, f"has {n} items (limit {entry[k]})", entry.get("description"))
        inner = entry.get("items", {})
        for k, item in enumerate(node.children):
            here = f"{path}/items[{k}]"
            for s in [*everywhere, inner]:
                self.block(item, s, here)
            self.content(item.children, inner, here, everywhere)

    def block(self, node: Node, schema: dict, path: str) -> None:
        """Text, language and size of a block or item."""
        for name, text in (("text", _own(node)), ("lang", node.lang)):
            for keyword, message in header_errors(schema.get(name, {}), text):
                self.bad(path, f"{name}/{keyword}", message, schema.get(name, {}).get("description", schema.get("description")))
        self.tokens([node], schema, path)


def _deepest(nodes: list[Node]) -> int:
    return max((1 + _deepest(n.children) for n in nodes if n.kind == "header"), default=0)


def validate_document(key: str, content: str, schema: dict) -> list[tuple[str, str, str]]:
    """(path, keyword, message) of one document's violations."""
    return _check(key, content, schema).out


def explain_document(key: str, content: str, schema: dict) -> list[tuple[str, str]]:
    """(section, entry that it is bound to)."""
    return _check(key, content, schema).trace


def _check(key: str, content: str, schema: dict) -> _Checker:
    content = markdown.sanitised(content)
    folder = key.rsplit("/", 1)[0] if "/" in key else ""
    _, body = markdown.split_frontmatter(content)
    tree = markdown.parse(body, folder)
    checker = _Checker(folder)
    if "frontmatter" in schema:
        fm = {k: v for k, v in markdown.frontmatter(content).items() if not (isinstance(k, str) and k[:1] and k[0] in "_$.#@")}
        checker.out += [(f"frontmatter{p}", k, m) for p, k, m in json_errors(schema["frontmatter"], json.loads(yamlcore.to_json(fm)))]
    checker.tokens(tree, schema, "/")
    checker.depth(tree, schema, "/")
    checker.level(tree, schema, "", [], [])
    return checker


def validate(corpus, schemas: dict[str, dict], bindings: dict[str, list[str]]) -> DataFrame:
    """(key, schema, path, keyword, message) of all violations. A document is checked by every schema whose globs match its key."""
    for s in schemas.values():
        check_schema(s)
    names = list(bindings)
    bound = F.array_compact(F.array(*[F.when(matches_globs(F.col("key"), [g.lstrip("/") if not g.startswith("!") else "!" + g[1:].lstrip("/") for g in bindings[n]]), n) for n in names]))
    rows = corpus.documents.select("key", "content", bound.alias("names")).where(F.size("names") > 0)

    def run(frames):
        for frame in frames:
            found = [(k, n, *e) for k, c, ns in zip(frame["key"], frame["content"], frame["names"], strict=True) for n in ns for e in validate_document(k, c or "", schemas[n])]
            yield pd.DataFrame(found, columns=["key", "schema", "path", "keyword", "message"])

    return rows.mapInPandas(run, FOUND)


def explain(corpus, schemas: dict[str, dict], bindings: dict[str, list[str]]) -> DataFrame:
    """(key, schema, section, entry): what each section is bound to."""
    names = list(bindings)
    bound = F.array_compact(F.array(*[F.when(matches_globs(F.col("key"), bindings[n]), n) for n in names]))
    rows = corpus.documents.select("key", "content", bound.alias("names")).where(F.size("names") > 0)

    def run(frames):
        for frame in frames:
            found = [(k, n, *e) for k, c, ns in zip(frame["key"], frame["content"], frame["names"], strict=True) for n in ns for e in explain_document(k, c or "", schemas[n])]
            yield pd.DataFrame(found, columns=["key", "schema", "section", "entry"])

    return rows.mapInPandas(run, "key string, schema string, section string, entry string")
