"""Guarded edits of documents: metadata, blocks, and operations on the link graph, as change sets.

Nothing here writes documents. Every operator returns changes (op, key, content) with op one of create,
update, remove; ``apply`` merges them into a table of documents. An update is planned per document on the
executors, then checked as a whole (errors by precedence, then guards), and only then handed out.
"""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocktree import Index
from ..plans import ir
from ..plans.parse import QueryError, parse, unguarded
from ..plans.staging import staged
from ..sources import markdown
from ..sources.files import read_once
from ..sources.markdown import Node

CHANGES = "op string, key string, content string"
#: Errors in the order in which they are reported.
PRECEDENCE = ("AppendNonContainer", "ReplaceTextNoText", "FragmentNotList", "ReplaceTextAnchor", "Overlap", "Expect", "ExpectDocuments")
#: Blocks that an error message lists.
LISTED = 20


class EvaluationError(ValueError):
    def __init__(self, code: str, op: str, message: str, blocks: list[str]):
        self.code, self.op, self.blocks = code, op, blocks
        super().__init__("\n".join([message, *(f"  {b}" for b in blocks)]))


def folder_of(key: str) -> str:
    return posixpath.dirname(key)


# metadata


def edit_fields(fm: dict, edits: tuple[ir.FieldEdit, ...]) -> dict:
    fm = json.loads(json.dumps(fm)) if fm else {}
    for e in edits:
        at = fm
        for part in e.path[:-1]:
            inner = at.get(part)
            if not isinstance(inner, dict):
                if e.op == "unset":
                    at = None
                    break
                inner = at[part] = {}
            at = inner
        if at is None:
            continue
        if e.op == "set":
            at[e.path[-1]] = e.value
        else:
            at.pop(e.path[-1], None)
    return {k: v for k, v in fm.items() if not (isinstance(k, str) and k[:1] and k[0] in "_$.#@")}


# blocks


@dataclass
class _Slot:
    """What happens around and to one block."""

    before: list[Node] = field(default_factory=list)
    after: list[Node] = field(default_factory=list)
    first: list[Node] = field(default_factory=list)
    last: list[Node] = field(default_factory=list)
    text: str | None = None
    instead: list[Node] | None = None  # replaces the block itself
    keep_contents: bool = False  # the contents of a replaced block stay


def _fragment(content: str, folder: str, as_items: bool) -> list[Node] | None:
    tree = markdown.parse(markdown.sanitised(content).strip("\n"), folder)
    if not as_items:
        return tree
    return tree[0].children if len(tree) == 1 and tree[0].kind == "list" else None


def _rebuilt(children: list[Node], slots: dict[int, _Slot], place: int) -> list[Node]:
    out: list[Node] = []
    for node in children:
        slot = slots.get(place, _Slot())
        inner = slot.first + _rebuilt(node.children, slots, place + 1) + slot.last
        out += slot.before
        if slot.instead is not None:
            out += slot.instead + (inner if slot.keep_contents else [])
        elif inner or not (node.kind in ("list", "quote") and node.children):
            changed = {"children": inner} | ({"text": slot.text} if slot.text is not None else {})
            out.append(replace(node, **changed))
        out += slot.after
        place += markdown.size(node)
    return out


@dataclass
class DocumentPlan:
    content: str
    counts: list[int]
    targets: list[list[str]]
    problems: list[tuple[str, str, str]]  # code, op, block


def plan_document(key: str, content: str, fields: tuple[ir.FieldEdit, ...], blocks: tuple[ir.BlockEdit, ...]) -> DocumentPlan:
    """The edited document, or what is wrong with the edits; all selections are made on the original."""
    content = markdown.sanitised(content)
    folder = folder_of(key)
    _, body = markdown.split_frontmatter(content)
    tree = markdown.parse(body, folder)
    index = Index(tree, folder)
    slots: dict[int, _Slot] = {}
    problems: list[tuple[str, str, str]] = []
    acted: list[list[tuple[int, bool]]] = []
    for edit in blocks:
        one_by_one = edit.op == "replaceText"
        targets = [(i, False) for i in sorted(index.select(edit.select))] if one_by_one else index.targets(edit.select)
        acted.append(targets)
        for i, whole in targets:
            if problem := _plan_block(index, i, whole, edit, slots, folder):
                problems.append((problem, edit.op, f"{key} › {index.said(i)}"))
    for a in range(len(blocks)):
        for b in range(a + 1, len(blocks)):
            for i, i_whole in acted[a]:
                for j, j_whole in acted[b]:
                    if i == j or i_whole and i < j <= index.entries[i].end or j_whole and j < i <= index.entries[j].end:
                        problems.append(("Overlap", f"{blocks[a].op}/{blocks[b].op}", f"{key} › {index.said(i)}"))
    fm = edit_fields(markdown.frontmatter(content), fields)
    said = [[f"{key} › {index.said(i)}" for i, _ in targets[:LISTED]] for targets in acted]
    if problems:
        return DocumentPlan("", [len(t) for t in acted], said, problems)
    text = markdown.render(_rebuilt(tree, slots, 0), folder)
    # what the edits leave is read again: nesting and levels follow from the text
    return DocumentPlan(markdown.join_frontmatter(fm, markdown.normalise(text, folder)), [len(t) for t in acted], said, [])


def _plan_block(index: Index, i: int, whole: bool, edit: ir.BlockEdit, slots: dict[int, _Slot], folder: str) -> str | None:
    """Enters the edit of one block; the code of what prevents it."""
    node = index.entries[i].node
    slot = slots.setdefault(i, _Slot())
    heading_only = node.kind == "header" and not whole
    if edit.op == "delete":
        slot.instead, slot.keep_contents = [], heading_only
        return None
    if edit.op == "replaceText":
        if node.text is None or node.kind == "table":
            return "ReplaceTextNoText"
        if edit.old is not None and node.text.count(edit.old) != 1:
            return "ReplaceTextAnchor"
        new = edit.new or ""
        if edit.old is not None:
            new = node.text.replace(edit.old, new, 1)
        slot.text = new if node.kind in ("code", "ref") else markdown.parse_inline(new, folder)
        return None
    if edit.op == "append" and node.kind not in markdown.CONTAINERS:
        return "AppendNonContainer"
    as_items = node.kind == "list" if edit.op == "append" else node.kind == "item"
    fragment = _fragment(edit.content or "", folder, as_items)
    if fragment is None:
        return "FragmentNotList"
    if edit.op == "append":
        slot.last += fragment
    elif edit.op == "insertBefore":
        slot.before += fragment
    elif edit.op == "insertAfter":
        if heading_only:
            slot.first += fragment
        else:
            slot.after += fragment
    elif heading_only and len(fragment) == 1 and fragment[0].kind == "header":
        slot.text, slot.first = fragment[0].text, fragment[0].children + slot.first
    else:
        slot.instead, slot.keep_contents = fragment, heading_only
    return None


_MESSAGES = {
    "AppendNonContainer": "$append target can't hold blocks",
    "ReplaceTextNoText": "$replaceText target has no editable own text",
    "FragmentNotList": "the content must be a single list here",
    "ReplaceTextAnchor": "`from` must occur exactly once in the own text",
    "Overlap": "two operators touch the same block",
}


def _rows(corpus, operation: ir.Operation) -> DataFrame:
    from ..plans import compile as plans

    rows = plans.select(corpus, operation.filter, False)
    return plans._limited(rows, operation, corpus.typed)


def _check_documents(rows: DataFrame, operation: ir.Operation) -> None:
    if operation.expect is None:
        return
    n = rows.count()
    if not operation.expect.holds(n):
        some = [f"{r['key']} › {r['title'] or r['key']}" for r in rows.select("key", "title").orderBy("key").limit(LISTED).collect()]
        raise EvaluationError("ExpectDocuments", operation.kind, f"{operation.kind} expected {operation.expect} documents, matched {n}", some)


def update(corpus, document: str | dict | ir.Operation, strict: bool = False) -> DataFrame:
    """The changes of an update operation; raises ``EvaluationError`` before any is made."""
    operation = document if isinstance(document, ir.Operation) else parse(document, "update")
    _guard(operation, strict)
    fields, blocks = operation.field_edits, operation.block_edits

    def run(frames):
        for frame in frames:
            plans = [plan_document(k, c or "", fields, blocks) for k, c in zip(frame["key"], frame["content"], strict=True)]
            yield pd.DataFrame({"key": frame["key"], "title": frame["title"], "content": [p.content for p in plans], "counts": [p.counts for p in plans], "targets": [json.dumps(p.targets) for p in plans], "problems": [[f"{PRECEDENCE.index(c)}\t{op}\t{b}" for c, op, b in p.problems] for p in plans]})

    rows = _rows(corpus, operation).select("key", "title", "content")
    planned = staged(rows.mapInPandas(run, "key string, title string, content string, counts array<int>, targets string, problems array<string>"), "update")
    bad = planned.select("key", F.explode("problems").alias("p")).select("key", F.split("p", "\t", 3).alias("p"))
    worst = bad.agg(F.min(F.col("p")[0].cast("int")).alias("code")).first()["code"]
    if worst is not None:
        some = bad.where(F.col("p")[0].cast("int") == worst).orderBy("key").limit(LISTED).collect()
        raise EvaluationError(PRECEDENCE[worst], some[0]["p"][1], _MESSAGES[PRECEDENCE[worst]], [r["p"][2] for r in some])
    guarded = [(i, e) for i, e in enumerate(blocks) if e.expect]
    if guarded:
        sums = planned.agg(*[F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)).alias(f"n{i}") for i, _ in guarded]).first()
        for i, e in guarded:
            if not e.expect.holds(sums[f"n{i}"]):
                some = [x for r in planned.where(F.col("counts")[i] > 0).orderBy("key").limit(LISTED).collect() for x in json.loads(r["targets"])[i]][:LISTED]
                raise EvaluationError("Expect", e.op, f"${e.op} expected {e.expect}, found {sums[f'n{i}']}", some)
    _check_documents(planned, operation)
    return planned.select(F.lit("update").alias("op"), "key", "content")


def delete(corpus, document: str | dict | ir.Operation, strict: bool = False) -> DataFrame:
    """Removes the matching documents and every link to them in the others."""
    operation = document if isinstance(document, ir.Operation) else parse(document, "delete")
    _guard(operation, strict)
    corpus = read_once(corpus)
    rows = _rows(corpus, operation)
    _check_documents(rows, operation)
    return remove(corpus, rows.select("key"))


def _guard(operation: ir.Operation, strict: bool) -> None:
    if strict and (missing := unguarded(operation)):
        raise QueryError("Unguarded", missing=missing)


# the link graph


def _referrers(corpus, keys: DataFrame) -> DataFrame:
    """(key, content, to array): documents with links to the keys."""
    both = corpus.inclusion_edges.select("src", "dst").unionByName(corpus.reference_edges.select("src", "dst"))
    hit = both.join(keys.select(F.col("key").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("key")).agg(F.collect_set("dst").alias("to"))
    return corpus.documents.select("key", "content").join(hit, "key")


def _rewritten(rows: DataFrame, change) -> DataFrame:
    """Updates by a function (key, content, to) -> content."""

    def run(frames):
        for frame in frames:
            new = [change(k, c or "", list(to)) for k, c, to in zip(frame["key"], frame["content"], frame["to"], strict=True)]
            yield pd.DataFrame({"op": "update", "key": frame["key"], "content": new})

    return rows.select("key", "content", "to").mapInPandas(run, CHANGES)


def map_links(key: str, content: str, change) -> str:
    """A document with each internal link passed through ``change``: (key, text, wiki) -> key, or None for the bare text."""
    folder = folder_of(key)
    raw, body = markdown.split_frontmatter(markdown.sanitised(content))
    tree = markdown.parse(body, folder)

    def inline(text: str) -> str:
        def one(m: re.Match) -> str:
            if m["code"] or m["image"]:
                return m[0]
            if m["wiki"]:
                to = change(m["wiki"], m["piped"] or m["wiki"], True)
                return (m["piped"] or m["wiki"]) if to is None else f"[[{to}|{m['piped']}]]" if m["piped"] else f"[[{to}]]"
            if not markdown.is_internal(m["url"]):
                return m[0]
            to = change(markdown.resolve(m["url"], folder), m["text"], False)
            if to is None:
                return m["text"]
            mark = "#" + m["url"].split("#", 1)[1] if "#" in m["url"] else ""
            return f"[{m['text']}]({markdown.relative(to, folder)}{mark}{m['title'] or ''})"

        return markdown._LINK.sub(one, text)

    def go(nodes: list[Node]) -> list[Node]:
        out = []
        for n in nodes:
            inner = go(n.children)
            if n.kind == "ref":
                to = change(n.target, n.text or n.lang, n.link != "regular")
                if to is None:
                    continue
                out.append(replace(n, target=to))
            elif n.kind == "table":
                made = replace(n, rows=[[inline(c) for c in r] for r in n.rows])
                out.append(made)
            elif n.kind in ("header", "paragraph", "item"):
                out.append(replace(n, text=inline(n.text or ""), children=inner))
            elif inner or not n.children:
                out.append(replace(n, children=inner))
        return out

    text = markdown.render(go(tree), folder)
    return text if raw is None else f"---\n{raw}---\n" + (f"\n{text}" if text else "")


def remove(corpus, keys: DataFrame) -> DataFrame:
    """Removes documents; links to them elsewhere become text, inclusions of them go."""
    corpus = read_once(corpus)
    gone = keys.select("key").distinct()
    removed = gone.select(F.lit("remove").alias("op"), "key", F.lit(None).cast("string").alias("content"))
    rest = _referrers(corpus, gone).join(gone, "key", "left_anti")
    return removed.unionByName(_rewritten(rest, lambda k, c, to: map_links(k, c, lambda t, text, wiki: None if t in to else t)))


def rename(corpus, old: str, new: str) -> DataFrame:
    """Moves a document to another key and every link to it along."""
    keys = {r["key"] for r in corpus.documents.where(F.col("key").isin(old, new)).select("key").collect()}
    if old not in keys:
        raise KeyError(f"no document {old!r}")
    if new in keys:
        raise ValueError(f"{new!r} exists")
    spark = corpus.spark
    # relative links inside the moved document are written anew from its new folder

    def moved(frames):
        for frame in frames:
            out = []
            for content in frame["content"]:
                text = map_links(old, content or "", lambda t, _, __: new if t == old else t)
                raw, body = markdown.split_frontmatter(text)
                out.append(_relocated(raw, body, old, new))
            yield pd.DataFrame({"op": "create", "key": new, "content": out})

    created = corpus.documents.where(F.col("key") == old).select("content").mapInPandas(moved, CHANGES)
    removed = spark.createDataFrame([("remove", old, None)], CHANGES)
    one = spark.createDataFrame([(old,)], "key string")
    rest = _referrers(corpus, one).where(F.col("key") != old)
    return removed.unionByName(created).unionByName(_rewritten(rest, lambda k, c, to: map_links(k, c, lambda t, text, wiki: new if t == old else t)))


def _relocated(raw: str | None, body: str, old: str, new: str) -> str:
    def one(m: re.Match) -> str:
        if m["code"] or m["image"] or m["wiki"] or not markdown.is_internal(m["url"]):
            return m[0]
        mark = "#" + m["url"].split("#", 1)[1] if "#" in m["url"] else ""
        return f"[{m['text']}]({markdown.relative(markdown.resolve(m['url'], folder_of(old)), folder_of(new))}{mark}{m['title'] or ''})"

    text = markdown._LINK.sub(one, body)
    return text if raw is None else f"---\n{raw}---\n{text}"


def _document(corpus, key: str) -> str:
    found = corpus.documents.where(F.col("key") == key).select("content").first()
    if found is None:
        raise KeyError(f"no document {key!r}")
    return markdown.sanitised(found["content"] or "")


def _free_key(corpus, wanted: str) -> str:
    like = {r["key"] for r in corpus.documents.where(F.col("key").startswith(wanted)).select("key").collect()}
    key, n = wanted, 1
    while key in like:
        key, n = f"{wanted}-{n}", n + 1
    return key


def pick(index: Index, kind: str, selector: str | int) -> int:
    """The place of a section or reference by its number from 1, or by a part of its text; it must be the only one."""
    found = [i for i, e in enumerate(index.entries) if e.node.kind == kind and not (kind == "header" and e.depth == 0)]
    if isinstance(selector, int):
        if not 1 <= selector <= len(found):
            raise ValueError(f"there are {len(found)}, not {selector}")
        return found[selector - 1]
    named = [i for i in found if selector.lower() in (index.entries[i].node.text or index.entries[i].node.target or "").lower()]
    if len(named) != 1:
        raise ValueError(f"{selector!r} names {len(named)} of {len(found)}: " + ", ".join(index.said(i) for i in named))
    return named[0]


def _slug(text: str) -> str:
    return re.sub(r"[\W_]+", "-", text.lower()).strip("-") or "untitled"


def extract(corpus, key: str, section: str | int | None = None) -> DataFrame:
    """Moves a section (all of the second level without a selector) into documents of their own, leaving inclusions."""
    content, folder = _document(corpus, key), folder_of(key)
    raw, body = markdown.split_frontmatter(content)
    tree = markdown.parse(body, folder)
    index = Index(tree, folder)
    places = [pick(index, "header", section)] if section is not None else [i for i, e in enumerate(index.entries) if e.node.kind == "header" and e.depth == 1]
    slots, created, taken = {}, [], set()
    for i in places:
        node = index.entries[i].node
        title = markdown.plain_inline(node.text)
        new = _free_key(corpus, posixpath.join(folder, _slug(title)))
        while new in taken:
            new += "-1"
        taken.add(new)
        ref = Node("ref", None, target=new, link="regular", lang=title)
        slots[i] = _Slot(instead=[ref])
        created.append(("create", new, markdown.render([node], folder)))
    text = markdown.normalise(markdown.render(_rebuilt(tree, slots, 0), folder), folder)
    changed = ("update", key, text if raw is None else f"---\n{raw}---\n\n{text}")
    return corpus.spark.createDataFrame([*created, changed], CHANGES)


def inline(corpus, key: str, reference: str | int, as_quote: bool = False, keep: bool = False) -> DataFrame:
    """Replaces an inclusion by its target's blocks; the target goes unless it is kept."""
    content, folder = _document(corpus, key), folder_of(key)
    raw, body = markdown.split_frontmatter(content)
    tree = markdown.parse(body, folder)
    index = Index(tree, folder)
    i = pick(index, "ref", reference)
    target = index.entries[i].node.target or ""
    _, inner_body = markdown.split_frontmatter(_document(corpus, target))
    inner = markdown.parse(_relocated(None, inner_body, target, key), folder)
    slots = {i: _Slot(instead=[Node("quote", children=inner)] if as_quote else inner)}
    text = markdown.normalise(markdown.render(_rebuilt(tree, slots, 0), folder), folder)
    rows = corpus.spark.createDataFrame([("update", key, text if raw is None else f"---\n{raw}---\n\n{text}")], CHANGES)
    if keep:
        return rows
    rest = remove(corpus, corpus.spark.createDataFrame([(target,)], "key string")).where(F.col("key") != key)
    return rows.unionByName(rest)


def attach(corpus, key: str, to: str, title: str | None = None) -> DataFrame:
    """Adds an inclusion of ``key`` at the end of ``to``; no change where there is one."""
    content, folder = _document(corpus, to), folder_of(to)
    raw, body = markdown.split_frontmatter(content)
    tree = markdown.parse(body, folder)
    if any(n.kind == "ref" and n.target == key for n, *_ in markdown.walk(tree)):
        return corpus.spark.createDataFrame([], CHANGES)
    if title is None:
        found = corpus.documents.where(F.col("key") == key).select("title").first()
        title = (found["title"] if found else None) or key
    ref = Node("ref", None, target=key, link="regular", lang=title)
    (tree[0].children if len(tree) == 1 and tree[0].kind == "header" else tree).append(ref)
    text = markdown.normalise(markdown.render(tree, folder), folder)
    return corpus.spark.createDataFrame([("update", to, text if raw is None else f"---\n{raw}---\n\n{text}")], CHANGES)


def create(corpus, rows: DataFrame, existing: str = "fail") -> DataFrame:
    """Creates for (key, content) rows; documents that exist fail the whole, or are skipped."""
    known = corpus.documents.select("key")
    if existing == "fail" and (clash := rows.join(known, "key", "left_semi").select("key").limit(LISTED).collect()):
        raise ValueError("these exist: " + ", ".join(r["key"] for r in clash))
    return rows.join(known, "key", "left_anti").select(F.lit("create").alias("op"), "key", "content")


def overwrite(corpus, key: str, body: str) -> DataFrame:
    """A new body for a document, its metadata kept."""
    raw, _ = markdown.split_frontmatter(_document(corpus, key))
    text = markdown.normalise(body, folder_of(key))
    return corpus.spark.createDataFrame([("update", key, text if raw is None else f"---\n{raw}---\n\n{text}")], CHANGES)


def normalize(corpus) -> DataFrame:
    """Updates for the documents that aren't in normal form."""

    def run(frames):
        for frame in frames:
            new = [markdown.normalise(markdown.sanitised(c or ""), folder_of(k)) for k, c in zip(frame["key"], frame["content"], strict=True)]
            yield pd.DataFrame({"op": "update", "key": frame["key"], "content": new, "old": frame["content"]})

    made = corpus.documents.select("key", "content").mapInPandas(run, CHANGES + ", old string")
    return made.where(~F.col("content").eqNullSafe(F.col("old"))).select("op", "key", "content")


def merged(*changes: DataFrame) -> DataFrame:
    """One change set of several in order: the first create of a key, its last update, one remove."""
    parts = [c.withColumn("turn", F.lit(i)) for i, c in enumerate(changes)]
    every = reduce(DataFrame.unionByName, parts)
    best = F.when(F.col("op") == "create", -F.col("turn")).otherwise(F.col("turn"))
    return every.groupBy("op", "key").agg(F.max_by("content", best).alias("content"))


def apply(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, content) after the changes."""
    new = changes.where("op <> 'remove'").select("key", "content")
    kept = documents.select("key", "content").join(changes.select("key"), "key", "left_anti")
    return kept.unionByName(new)


def squash(corpus, key: str, depth: int = 2) -> str:
    """A document with its inclusions replaced by their targets' blocks, ``depth`` levels down; the rest stay links."""
    needed, front, texts = {key}, [key], {}
    for _ in range(depth + 1):
        rows = corpus.documents.where(F.col("key").isin(*front)).select("key", "content").collect() if front else []
        for r in rows:
            texts[r["key"]] = markdown.split_frontmatter(markdown.sanitised(r["content"] or ""))[1]
        found = {t for r in rows for n, *_ in markdown.walk(markdown.parse(texts[r["key"]], folder_of(r["key"]))) if n.kind == "ref" for t in [n.target or ""]}
        front = sorted(found - needed)
        needed |= found
    if key not in texts:
        raise KeyError(f"no document {key!r}")

    def expanded(k: str, left: int, above: tuple[str, ...]) -> list[Node]:
        def go(nodes: list[Node]) -> list[Node]:
            out: list[Node] = []
            for n in nodes:
                if n.kind == "ref" and left and n.target in texts and n.target not in above:
                    out += expanded(n.target, left - 1, (*above, n.target))
                else:
                    out.append(replace(n, children=go(n.children)))
            return out

        return go(markdown.parse(texts[k], folder_of(k)))

    folder = folder_of(key)
    return markdown.render(expanded(key, depth, (key,)), folder)


# rendering of selections


def narrowed(tests: tuple[ir.BlockTest, ...], corpus) -> Column:
    """The selected blocks rendered alone; blocks of table corpora one after the other."""
    from ..functions import blocks as columns

    if corpus.options.get("format") == "markdown":

        @F.pandas_udf(T.StringType())
        def render(key: pd.Series, body: pd.Series) -> pd.Series:
            return pd.Series([Index(markdown.parse(b or "", folder_of(k)), folder_of(k)).narrowed(tests) for k, b in zip(key, body, strict=True)])

        return render(F.col("key"), F.col("body"))
    own = lambda b: F.coalesce(b["own_text"], F.lit(""))
    line = lambda b: F.when(b["kind"] == "header", F.concat(F.repeat(F.lit("#"), b["depth"] + 1), F.lit(" "), own(b))).when(b["kind"] == "item", F.concat(F.lit("- "), own(b))).when(b["kind"] == "quote", F.concat(F.lit("> "), own(b))).otherwise(own(b))
    return F.coalesce(F.array_join(F.transform(columns.selected(tests, F.col("blocks")), line), "\n\n"), F.lit(""))
