"""Operations to DataFrames.

A filter becomes one boolean column over the documents. Relations are the only clauses that need other
rows: each is a set of keys, joined as a semi-join where the filter is a plain conjunction and as a flag
column elsewhere. Sorting and limiting run on keys and sort columns; edge lists and block projections
are fetched for the rows that are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, fields
from ..functions.text import slug
from ..operators import graph
from ..sources.corpus import Corpus
from . import ir
from .parse import QueryError, parse, parse_filter_expression
from .staging import staged

_NEEDS_ROWS = (ir.Relation, ir.All, ir.AnyOf, ir.NoneOf)


def _relations(node) -> list[ir.Relation]:
    if isinstance(node, ir.Relation):
        return [node]
    return [r for p in getattr(node, "parts", ()) for r in _relations(p)]


class _Selection:
    """Documents under a filter. Rows: every column of documents plus ``is_document``."""

    def __init__(self, corpus: Corpus, dangling: bool):
        self.corpus, self.dangling = corpus, dangling
        self.typed = getattr(corpus, "typed", {})
        self.rows = corpus.documents.withColumn("is_document", F.lit(True))
        self.flags = 0

    def run(self, node) -> DataFrame:
        parts = node.parts if isinstance(node, ir.All) else (node,)
        plain = [p for p in parts if isinstance(p, ir.Relation)]
        rest = [p for p in parts if p not in plain]
        missing = self.dangling and any(r.size is None for r in _relations(node))
        if plain and missing and plain[0].size is None:
            # documents are reduced by a semi-join, which broadcasts a small key set; the keys without a document
            # are those that it didn't find, so the key column of the corpus need not move
            keys = self._keys(plain[0])
            found = self.rows.join(keys, "key", "left_semi")
            lost = keys.join(found.select("key"), "key", "left_anti").withColumn("is_document", F.lit(False))
            self.rows = found.unionByName(lost, allowMissingColumns=True)
            plain = plain[1:]
        elif missing:
            self._add_missing()
        sized = [r for r in plain if r.size is not None]
        for relation in plain:
            if relation.size is None:
                self.rows = self.rows.join(self._keys(relation), "key", "left_semi")
        if rest or not parts:
            alone = not any(isinstance(p, _NEEDS_ROWS) for p in parts)
            test = reduce(lambda a, b: a & b, [self._column(p, alone) for p in rest], F.lit(True))
            self.rows = self.rows.where(test)  # with the flag columns that the test has joined
        for relation in sized:  # counted for what is left, where counting takes walks
            self.rows = self._counted(relation, self.rows.where("is_document"))
        return self.rows

    def _counted(self, relation: ir.Relation, documents: DataFrame) -> DataFrame:
        every = isinstance(relation.match, ir.All) and not relation.match.parts
        matching = None if every else matching_keys(self.corpus, relation.match, self.dangling)
        return graph.with_count(self.corpus, relation, documents, matching, lambda n: fields.count_test(n, relation.size))

    def _add_missing(self) -> None:
        ends = [e.select(F.col(c).alias("key")) for e in (self.corpus.inclusion_edges, self.corpus.reference_edges) for c in ("src", "dst")]
        keys = reduce(DataFrame.unionByName, ends).distinct().join(self.corpus.documents.select("key"), "key", "left_anti")
        self.rows = self.rows.unionByName(keys.withColumn("is_document", F.lit(False)), allowMissingColumns=True)

    def _keys(self, relation: ir.Relation) -> DataFrame:
        match = relation.match
        if relation.size is not None:
            return self._counted(relation, self.corpus.documents.select("key"))
        if isinstance(match, ir.KeyTest) and match.op in ("eq", "in") and relation.kind in ("includedBy", "referencedBy"):
            # walks start at these keys; one without a document has no edge to start with
            keys = list(dict.fromkeys(match.keys))
            if relation.high == 1:
                return graph.neighbours(self.corpus, relation, keys)
            anchors = self.corpus.spark.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias("key"))
        else:
            # a walk needs its anchors several times, and they may take a scan of the corpus to find
            anchors = staged(matching_keys(self.corpus, match, self.dangling), "anchors")
        return graph.related(self.corpus, relation, anchors)

    def _column(self, node, alone: bool) -> Column:
        document = F.col("is_document")
        if isinstance(node, ir.FieldTest):
            test = None
            if node.path in self.typed:
                name, kind = self.typed[node.path]
                test = fields.typed_test(F.col(name), kind, node)
            test = fields.field_test(F.col("fm"), node) if test is None else test
            return test & document if alone else test
        if isinstance(node, ir.KeyTest):
            hit = F.col("key").isin(*node.keys) if node.op in ("eq", "in") else ~F.col("key").isin(*node.keys)
            return hit & document if alone else hit
        if isinstance(node, ir.Content):
            return document & blocks.any_block(node.predicate, F.col("blocks"))
        if isinstance(node, ir.All):
            inner = not any(isinstance(p, _NEEDS_ROWS) for p in node.parts)
            return reduce(lambda a, b: a & b, [self._column(p, inner) for p in node.parts]) if node.parts else document
        if isinstance(node, ir.AnyOf):
            return reduce(lambda a, b: a | b, [self._column(p, True) for p in node.parts], F.lit(False))
        if isinstance(node, ir.NoneOf):
            return document & ~reduce(lambda a, b: a | b, [self._column(p, True) for p in node.parts], F.lit(False))
        if isinstance(node, ir.Relation):
            name = f"_related_{self.flags}"
            self.flags += 1
            self.rows = self.rows.join(self._keys(node).withColumn(name, F.lit(True)), "key", "left")
            return F.coalesce(F.col(name), F.lit(False))
        raise TypeError(node)


def select(corpus: Corpus, node=None, dangling: bool = True) -> DataFrame:
    """The documents under a filter; with ``dangling``, relations also give keys without a document."""
    rows = _Selection(corpus, dangling).run(node if node is not None else ir.All(()))
    return rows.drop(*[c for c in rows.columns if c.startswith("_related_")])


def matching_keys(corpus: Corpus, node, dangling: bool = True) -> DataFrame:
    """(key): anchors are looked up in the whole corpus."""
    if isinstance(node, ir.KeyTest) and node.op == "eq":
        # a key that has no document is no anchor
        return corpus.documents.select("key").where(F.col("key") == node.keys[0])
    return select(corpus, node, dangling).select("key")


def _ordered(rows: DataFrame, operation: ir.Operation, typed: dict) -> tuple[DataFrame, list[Column]]:
    if operation.sort and operation.sort.path in typed:
        column = F.col(typed[operation.sort.path][0])
        return rows, [column.desc_nulls_last() if operation.sort.descending else column.asc_nulls_first(), F.asc("key")]
    if operation.sort:
        return rows, [*fields.sort_columns(F.col("fm"), operation.sort), F.asc("key")]
    if "_score" in rows.columns:
        return rows, [F.desc("_score"), F.asc("key")]
    return rows, [F.asc("key")]


def _limited(rows: DataFrame, operation: ir.Operation, typed: dict) -> DataFrame:
    if not operation.limit:
        return rows
    rows, order = _ordered(rows, operation, typed)
    return rows.orderBy(*order).limit(operation.limit)


def _candidates(corpus: Corpus, operation: ir.Operation, dangling: bool, scores: DataFrame | None) -> DataFrame:
    rows = select(corpus, operation.filter, dangling)
    if operation.search:
        from ..operators import search

        found = scores if scores is not None else search.scores(corpus, operation.search, rows.select("key"))
        rows = rows.join(found.select("key", F.col("score").alias("_score")), "key")
    elif scores is not None:
        rows = rows.join(scores.select("key", F.col("score").alias("_score")), "key")
    return rows


def count(corpus: Corpus, document: str | dict | ir.Operation, dangling: bool = True) -> DataFrame:
    """(count): one row."""
    operation = document if isinstance(document, ir.Operation) else parse(document, "count")
    rows = select(corpus, operation.filter, dangling)
    if operation.limit:  # which rows are counted makes no difference
        rows = rows.select("key").limit(operation.limit)
    return rows.agg(F.count(F.lit(1)).alias("count"))


DEFAULTS = (("key", "$key"), ("title", "$title"), ("includes", "$includes"), ("includedBy", "$includedBy"), ("references", "$references"), ("referencedBy", "$referencedBy"))
_EDGES = ("$includes", "$includedBy", "$references", "$referencedBy")


def find(corpus: Corpus, document: str | dict | ir.Operation | ir.Find, dangling: bool = True, scores: DataFrame | None = None) -> DataFrame:
    """The rows of a find operation, in order.

    Metadata fields are VARIANT columns; pseudo fields have their own types. An operation without a
    projection gives key and fm. ``scores`` (key, score) may replace the search clause's own ranking.
    """
    operation = document.operation if isinstance(document, ir.Find) else document if isinstance(document, ir.Operation) else parse(document, "find")
    rows = _limited(_candidates(corpus, operation, dangling, scores), operation, corpus.typed)
    projection = operation.project or ir.Projection((), "frontmatter")
    if projection.base == "frontmatter":
        outputs = (("key", ir.Source("pseudo", "$key")), ("fm", ir.Source("pseudo", "$frontmatter")))
    elif projection.base == "document":
        given = dict(projection.fields)
        outputs = tuple((n, given.pop(n, ir.Source("pseudo", s))) for n, s in DEFAULTS) + tuple(given.items())
    else:
        outputs = projection.fields
    rows, order = _ordered(rows, operation, corpus.typed)
    wanted = {s.arg for _, s in outputs if s.kind == "pseudo" and s.arg in _EDGES}
    for kind in sorted(wanted):
        lists = graph.edge_lists(corpus, rows.select("key"), kind).withColumnRenamed("edges", f"_{kind[1:]}")
        rows = rows.join(lists, "key", "left")
    columns = [_output(source, corpus).alias(name) for name, source in outputs]
    if projection.base == "document":
        columns = _with_frontmatter(columns, outputs)
    return rows.orderBy(*order).select(*columns)


_NO_EDGES = "array<struct<key:string,title:string,sectionPath:array<string>>>"


def _output(source: ir.Source, corpus: Corpus) -> Column:
    if source.kind == "field":
        return fields.at(F.col("fm"), source.arg)
    if source.kind == "blocks":
        return blocks.entries(source.arg, F.col("blocks"))
    if source.kind == "matches":
        return blocks.grep(source.arg, source.pattern, F.col("blocks"))
    if source.kind == "content":
        from ..operators.edits import narrowed

        return narrowed(source.arg, corpus)
    title = F.coalesce("title", "key")
    if source.arg in _EDGES:
        return F.coalesce(F.col(f"_{source.arg[1:]}"), F.array().cast(_NO_EDGES))
    return {"$key": F.col("key"), "$title": title, "$titleSlug": slug(title), "$content": F.coalesce("body", F.lit("")), "$frontmatter": fields.without_reserved(F.col("fm"))}[source.arg]


def _with_frontmatter(columns: list[Column], outputs) -> list[Column]:
    """Own metadata joins the defaults: key and title of the metadata win, other clashes lose."""
    names = [n for n, _ in outputs]
    fm = F.try_variant_get(fields.without_reserved(F.col("fm")), "$", "map<string,variant>")
    more = F.to_variant_object(F.coalesce(F.map_filter(fm, lambda k, _: ~k.isin(*names)), F.create_map().cast("map<string,variant>"))).alias("frontmatter")
    out = []
    for name, column in zip(names, columns, strict=True):
        if name in ("key", "title"):
            own = fields.at(F.col("fm"), (name,))
            column = F.coalesce(F.try_variant_get(own, "$", "string"), column.cast("string")).alias(name)
        out.append(column)
    return [*out, more]


__all__ = ["QueryError", "count", "find", "matching_keys", "parse", "parse_filter_expression", "select"]
