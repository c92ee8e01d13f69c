"""A corpus: documents with dynamically typed metadata and blocks, and two sets of directed edges."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import BLOCK

NO_BLOCKS = f"array<{BLOCK}>"
EDGES = "src string, dst string, block_pos int, section_path array<string>, occurrences int"


def variant(json: Column) -> Column:
    return F.coalesce(F.try_parse_json(json), F.parse_json(F.lit("{}")))


@dataclass
class Corpus:
    """documents: key, title, fm variant, content, body, plain, blocks; edges: src, dst, block_pos, section_path, occurrences.

    ``typed`` names metadata fields that documents also hold in columns of their own, as path -> (column, class).
    Tests and sorts on them never touch the variant, so they prune scans and branches of unions.
    """

    documents: DataFrame
    inclusion_edges: DataFrame
    reference_edges: DataFrame
    options: dict = field(default_factory=dict)
    typed: dict[tuple[str, ...], tuple[str, str]] = field(default_factory=dict)

    @cached_property
    def blocks(self) -> DataFrame:
        """(key, pos, parent, end_pos, depth, kind, own_text, path, ...): one row a block."""
        return self.documents.select("key", F.explode("blocks").alias("b")).select("key", "b.*")

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def cache(self) -> Corpus:
        return Corpus(self.documents.cache(), self.inclusion_edges.cache(), self.reference_edges.cache(), self.options, self.typed)


def no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(EDGES))


def edges(df: DataFrame, src: Column, dst: Column, block_pos: Column | None = None) -> DataFrame:
    """Edge rows out of a table."""
    return df.select(src.cast("string").alias("src"), dst.cast("string").alias("dst"), (F.lit(0) if block_pos is None else block_pos).cast("int").alias("block_pos"), F.array().cast("array<string>").alias("section_path"), F.lit(1).alias("occurrences"))


def documents(df: DataFrame, key: Column, fm: Column | None = None, title: Column | None = None, text: Column | None = None, blocks: Column | None = None, typed: dict[str, Column] | None = None) -> DataFrame:
    """Document rows out of a table. ``fm`` is JSON text; a null field of a struct is left out by to_json, so absent.

    ``typed`` fields are kept in columns as well (see ``typed_columns``).
    """
    body = F.lit("") if text is None else F.coalesce(text, F.lit(""))
    return df.select(
        key.cast("string").alias("key"),
        (F.lit(None) if title is None else title).cast("string").alias("title"),
        variant(F.lit("{}") if fm is None else fm).alias("fm"),
        body.alias("content"),
        body.alias("body"),
        body.alias("plain"),
        (F.lit(None) if blocks is None else blocks).cast(NO_BLOCKS).alias("blocks"),
        *[c.alias(f"_f_{name}") for name, c in (typed or {}).items()],
    )


def typed_columns(docs: DataFrame) -> dict[tuple[str, ...], tuple[str, str]]:
    """The fields that document rows hold in columns of their own."""
    kinds = {"string": "string", "boolean": "boolean"} | dict.fromkeys(("tinyint", "smallint", "int", "bigint", "float", "double"), "number")
    return {(c.removeprefix("_f_"),): (c, kinds[t]) for c, t in docs.dtypes if c.startswith("_f_") and t in kinds}


def text_blocks(text: Column) -> Column:
    """Each non-empty line of a text as a paragraph block."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(s) != "")
    return F.transform(lines, lambda s, i: block(i, F.lit(-1), i, F.lit(0), F.lit("paragraph"), s))


def block(pos: Column, parent: Column, end: Column, depth: Column, kind: Column, own: Column, path: Column | None = None, targets: Column | None = None, target: Column | None = None) -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(
        pos.cast("int").alias("pos"),
        parent.cast("int").alias("parent"),
        end.cast("int").alias("end_pos"),
        depth.cast("int").alias("depth"),
        kind.alias("kind"),
        own.alias("own_text"),
        (empty if path is None else path).alias("path"),
        (empty if targets is None else targets).alias("ref_targets"),
        (F.lit(None).cast("string") if target is None else target).alias("ref_target"),
        own.alias("plain_text"),
        F.lit(None).cast("boolean").alias("ordered"),
        F.lit(None).cast("string").alias("lang"),
    )


def from_table(df: DataFrame, key: str, title: str | None = None, text: str | None = None, fields: list[str] | None = None, inclusion: DataFrame | None = None, reference: DataFrame | None = None) -> Corpus:
    """Any table as a corpus: named columns become metadata, a text column becomes paragraphs."""
    names = fields if fields is not None else [c for c in df.columns if c not in (key, text)]
    col = lambda c: None if c is None else F.col(c)
    own = {c: F.col(c) for c, t in df.dtypes if c in names and t in ("string", "boolean", "int", "bigint", "double")}
    docs = documents(df, F.col(key), F.to_json(F.struct(*names)) if names else None, col(title), col(text), None if text is None else text_blocks(F.col(text)), own)
    spark = df.sparkSession
    return Corpus(docs, no_edges(spark) if inclusion is None else inclusion, no_edges(spark) if reference is None else reference, {}, typed_columns(docs))


def union(first: Corpus, *others: Corpus) -> Corpus:
    docs, inc, ref = first.documents, first.inclusion_edges, first.reference_edges
    for c in others:
        docs, inc, ref = docs.unionByName(c.documents, allowMissingColumns=True), inc.unionByName(c.inclusion_edges), ref.unionByName(c.reference_edges)
    return Corpus(docs, inc, ref, {}, typed_columns(docs))
