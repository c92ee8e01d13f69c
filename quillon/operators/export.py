"""Text forms of results: DOT graphs, indexes, grep lines, JSON rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def json_rows(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def keys(rows: DataFrame) -> str:
    return "".join(f"{r['key']}\n" for r in rows.select("key").collect())


def index(rows: DataFrame) -> str:
    """A Markdown list of links, in the order of the rows."""
    return "".join(f"- [{r['title']}]({r['key']})\n" for r in rows.select("key", "title").collect())


def fenced(rows: DataFrame, column: str = "content") -> str:
    """Each content in a fence that is longer than any inside it, under its key."""
    out = []
    for r in rows.select("key", column).collect():
        text = r[column] or ""
        longest = max((len(x) for x in re.findall("`{3,}", text)), default=2)
        fence = "`" * max(3, longest + 1)
        out.append(f"{fence}markdown {r['key']}\n{text.rstrip()}\n{fence}\n")
    return "\n".join(out)


def grep_lines(rows: DataFrame, column: str) -> DataFrame:
    """(line): key › section path › text of each entry of a blocks or matches column."""
    e = rows.select("key", F.posexplode(column).alias("n", "e"))
    return e.select(F.concat_ws(" › ", F.concat(F.array("key"), F.col("e.path"), F.array(F.col("e.text")))).alias("line"))


def _quoted(column):
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(column, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def dot(corpus, starts: DataFrame | None = None, depth: int = 0, sections: bool = False) -> DataFrame:
    """(part, line): the lines of a DOT graph between its braces, nodes first. The lines stay distributed."""
    docs = corpus.documents
    if starts is not None:
        docs = docs.join(graph.subgraph(corpus, starts, depth), "key", "left_semi")
    known = docs.select("key")

    def inside(edges: DataFrame) -> DataFrame:
        return edges.select("src", "dst").distinct().join(known.select(F.col("key").alias("src")), "src", "left_semi").join(known.select(F.col("key").alias("dst")), "dst", "left_semi")

    q = lambda c: _quoted(F.col(c))
    nodes = docs.select(F.lit(0).alias("part"), F.concat(q("key"), F.lit(" [label="), _quoted(F.coalesce("title", "key")), F.lit("];")).alias("line"))
    solid = inside(corpus.inclusion_edges).select(F.lit(2).alias("part"), F.concat(q("src"), F.lit(" -> "), q("dst"), F.lit(";")).alias("line"))
    dashed = inside(corpus.reference_edges).select(F.lit(3).alias("part"), F.concat(q("src"), F.lit(" -> "), q("dst"), F.lit(" [style=dashed];")).alias("line"))
    out = nodes.unionByName(solid).unionByName(dashed)
    if sections:
        heads = corpus.blocks.where("kind = 'header'").join(known, "key", "left_semi")
        name = F.concat(F.lit('"'), F.col("key"), F.lit("#"), F.col("pos").cast("string"), F.lit('"'))
        up = F.when(F.col("parent") < 0, q("key")).otherwise(F.concat(F.lit('"'), F.col("key"), F.lit("#"), F.col("parent").cast("string"), F.lit('"')))
        out = out.unionByName(heads.select(F.lit(1).alias("part"), F.concat(name, F.lit(" [shape=note, label="), _quoted(F.col("plain_text")), F.lit("]; "), up, F.lit(" -> "), name, F.lit(" [arrowhead=none];")).alias("line")))
    return out.orderBy("part", "line")


def dot_text(lines: DataFrame) -> str:
    return "digraph G {\n" + "".join(f"  {r['line']}\n" for r in lines.collect()) + "}\n"
