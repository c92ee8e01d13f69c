"""The whole surface in one place: a corpus with tools that read it and propose changes to it.

Readers return DataFrames or text. Writers return change sets; ``commit`` applies one and gives the new
workspace, with findings that it brings.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tokens
from .operators import edits, export, graph, retrieve, schema, search, stats
from .operators.evidence import evidence
from .plans import compile as plans
from .plans import ir, lowering, parse
from .plans.ranking import ranked
from .sources import files


class Workspace:
    def __init__(self, corpus, schemas: dict[str, dict] | None = None, bindings: dict[str, list[str]] | None = None):
        self.corpus, self.schemas, self.bindings = corpus, schemas or {}, bindings or {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Workspace:
        return cls(files.from_directory(spark, path), **options)

    # reading

    def find(self, project: str | None = None, add_fields: str | None = None, lexical: str | None = None, fuzzy: str | None = None, sort: str | None = None, limit: int = 0, blocks: str | None = None, matches: str | None = None, **flags) -> DataFrame:
        """Documents by flags, most linked first unless a search or a sort orders them."""
        operation = lowering.find_operation(lowering.selector(**flags), project, add_fields, blocks, matches, parse.parse_sort_argument(sort) if sort else None, limit, lexical, fuzzy)
        if sort or operation.search:
            return plans.find(self.corpus, operation)
        ranked = graph.popularity(self.corpus)
        everyone = self.corpus.documents.select("key").join(ranked, "key", "left").select("key", F.coalesce("popularity", F.lit(0)).alias("score"))
        return plans.find(self.corpus, operation, dangling=False, scores=everyone)

    def count(self, limit: int = 0, **flags) -> int:
        return plans.count(self.corpus, ir.Operation("count", lowering.selector(**flags), limit=limit)).first()["count"]

    def query(self, kind: str, document: str):
        """An operation document, verbatim and strict: rows, a count, or a change set."""
        return {"find": lambda: plans.find(self.corpus, document), "count": lambda: plans.count(self.corpus, document), "update": lambda: edits.update(self.corpus, document, strict=True), "delete": lambda: edits.delete(self.corpus, document, strict=True)}[kind]()

    def retrieve(self, keys: list[str] = (), expand: dict[str, int] | None = None, lexical: str | None = None, fuzzy: str | None = None, limit: int = 0, **options) -> DataFrame:
        """Seeds by key or by search, then their surroundings; expansion depths of 0 have no bound."""
        names = {"includes": "includes", "includedBy": "included_by", "references": "references", "referencedBy": "referenced_by"}
        depths = {names[k]: v or ir.UNBOUNDED for k, v in (expand or {}).items()}
        docs = self.corpus.documents.select("key")
        seeds = docs.where(F.col("key").isin(*keys)) if keys else docs
        if lexical is not None or fuzzy is not None:
            found = search.scores(self.corpus, ir.Search(lexical, fuzzy), seeds)
            seeds = ranked(found, [F.desc("score"), F.asc("key")], "ord").select("key", "ord")
        elif keys:
            place = F.create_map(*[F.lit(x) for i, k in enumerate(dict.fromkeys(keys)) for x in (k, i)])
            seeds = seeds.select("key", F.element_at(place, F.col("key")).alias("ord"))
        return retrieve.retrieve(self.corpus, seeds, limit=limit, **depths, **options)

    def tree(self, keys: list[str] = (), depth: int = 4) -> DataFrame:
        starts = self.corpus.documents.select("key").where(F.col("key").isin(*keys)) if keys else None
        return graph.tree(self.corpus, starts, depth)

    def stats(self, key: str | None = None) -> DataFrame:
        rows = stats.document_stats(self.corpus)
        return stats.corpus_stats(self.corpus, rows) if key is None else rows.where(F.col("key") == key)

    def findings(self, touched: DataFrame | None = None) -> DataFrame:
        return stats.findings(self.corpus, touched)

    def squash(self, key: str, depth: int = 2) -> str:
        return edits.squash(self.corpus, key, depth)

    def export(self, keys: list[str] = (), depth: int = 0, sections: bool = False) -> str:
        starts = self.corpus.documents.select("key").where(F.col("key").isin(*keys)) if keys else None
        return export.dot_text(export.dot(self.corpus, starts, depth, sections))

    def schema(self) -> DataFrame:
        return schema.infer(self.corpus.documents)

    def validate(self) -> DataFrame:
        return schema.validate(self.corpus, self.schemas, self.bindings)

    def explain(self) -> DataFrame:
        return schema.explain(self.corpus, self.schemas, self.bindings)

    def evidence(self) -> DataFrame:
        return evidence(self.corpus)

    def tokens(self) -> DataFrame:
        return self.corpus.documents.select("key", tokens.count_tokens(F.coalesce("body", F.lit(""))).alias("tokens"))

    # changing

    def create(self, key: str, content: str, if_exists: str = "fail") -> DataFrame:
        return edits.create(self.corpus, self.corpus.spark.createDataFrame([(key, content)], "key string, content string"), if_exists)

    def new(self, template: str, key_template: str = "{{slug}}", now: datetime.datetime | None = None, **variables: str) -> DataFrame:
        """A document from templates with ``{{name}}`` and ``{{today:%Y-%m-%d}}`` places."""
        now = now or datetime.datetime.now()
        known = variables | ({"slug": edits._slug(variables["title"])} if "title" in variables else {})

        def fill(text: str) -> str:
            def one(m: re.Match) -> str:
                name, _, form = m[1].strip().partition(":")
                if name in ("today", "now"):
                    return now.strftime(form or ("%Y-%m-%d" if name == "today" else "%Y-%m-%d %H:%M"))
                if name not in known:
                    raise KeyError(f"the template needs {name!r}")
                return str(known[name])

            return re.sub(r"\{\{([^{}]+)\}\}", one, text)

        return self.create(fill(key_template), fill(template))

    def update(self, key: str, content: str) -> DataFrame:
        edits._document(self.corpus, key)
        return self.corpus.spark.createDataFrame([("update", key, content)], edits.CHANGES)

    def overwrite(self, key: str, body: str) -> DataFrame:
        return edits.overwrite(self.corpus, key, body)

    def delete(self, *keys: str) -> DataFrame:
        return edits.remove(self.corpus, self.corpus.documents.select("key").where(F.col("key").isin(*keys)))

    def rename(self, old: str, new: str) -> DataFrame:
        return edits.rename(self.corpus, old, new)

    def extract(self, key: str, section: str | int | None = None) -> DataFrame:
        return edits.extract(self.corpus, key, section)

    def inline(self, key: str, reference: str | int, **options) -> DataFrame:
        return edits.inline(self.corpus, key, reference, **options)

    def attach(self, key: str, to: str) -> DataFrame:
        return edits.attach(self.corpus, key, to)

    def normalize(self) -> DataFrame:
        return edits.normalize(self.corpus)

    def commit(self, changes: DataFrame) -> Workspace:
        """The workspace after the changes; documents that break a bound schema stop them all."""
        from .plans.staging import staged

        rows = staged(edits.apply(self.corpus.documents, changes), "documents")
        after = Workspace(files.from_markdown(rows, format=self.corpus.options.get("format", "markdown")), self.schemas, self.bindings)
        after.corpus.options |= self.corpus.options
        if self.schemas:
            touched = changes.where("op <> 'remove'").select("key")
            broken = after.validate().join(touched, "key", "left_semi").limit(edits.LISTED).collect()
            if broken:
                raise edits.EvaluationError("Schema", "commit", "documents break their schema", [f"{r['key']} › {r['path']}: {r['message']}" for r in broken])
        return after
