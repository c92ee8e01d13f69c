"""Conventions of a corpus: how links, lists and dates are written, and which way is the usual one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: convention -> way -> regular expression whose matches are counted
PATTERNS = {
    "link": {"wiki": r"\[\[[^\]]+\]\]", "markdown": r"(?<!!)\[[^\]\[]*\]\((?!https?:|mailto:)[^)]+\)"},
    "link extension": {"with": r"\]\([^)\s:]+\.md(?:#[^)]*)?\)", "without": r"\]\((?!https?:|mailto:)[^)\s.]+\)"},
    "bullet": {"-": r"(?m)^\s*- ", "*": r"(?m)^\s*\* ", "+": r"(?m)^\s*\+ "},
    "emphasis": {"*": r"(?<![*\w])\*[^*\s][^*\n]*\*(?!\*)", "_": r"(?<![_\w])_[^_\s][^_\n]*_(?![_\w])"},
    "date": {"iso": r"\b\d{4}-\d{2}-\d{2}\b", "slashes": r"\b\d{1,2}/\d{1,2}/\d{4}\b", "dots": r"\b\d{1,2}\.\d{1,2}\.\d{4}\b"},
    "metadata": {"front matter": r"\A---\n"},
}


def evidence(corpus) -> DataFrame:
    """(convention, way, n, documents, place): every way of every convention that occurs, the usual one first."""
    text = F.coalesce("content", F.lit(""))
    counts = F.array(*[F.struct(F.lit(c).alias("convention"), F.lit(w).alias("way"), F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("n")) for c, ways in PATTERNS.items() for w, p in ways.items()])
    rows = corpus.documents.select(F.explode(counts).alias("c")).select("c.*").where("n > 0")
    tally = rows.groupBy("convention", "way").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))
    return tally.withColumn("place", F.row_number().over(Window.partitionBy("convention").orderBy(F.desc("n"), "way")))
