"""Directories of documents, and corpora out of Markdown text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import yamlcore
from ..functions.blocks import BLOCK
from ..plans.staging import kept, staged
from . import djot, markdown  # noqa: F401  djot adds its reader
from .corpus import Corpus, variant

PARSED = f"key string, title string, fm_json string, content string, body string, plain string, blocks array<{BLOCK}>, links array<struct<kind:string,dst:string,wiki:boolean,block_pos:int,section_path:array<string>,occurrences:int>>"


def parse_document(key: str, content: str, title_field: str | None = None, reader=markdown.parse) -> dict:
    """One document as a row of the parsed table."""
    content = markdown.sanitised(content)
    fm = markdown.frontmatter(content)
    _, body = markdown.split_frontmatter(content)
    folder = key.rsplit("/", 1)[0] if "/" in key else ""
    tree = reader(body, folder)
    blocks, links = [], []
    for place, (node, parent, depth, path) in enumerate(markdown.walk(tree)):
        found = markdown.targets(node, folder)
        blocks.append({"pos": place, "parent": parent, "end_pos": place + markdown.size(node) - 1, "depth": depth, "kind": node.kind, "own_text": node.text, "path": list(path), "ref_targets": [k for k, _ in found], "ref_target": node.target, "plain_text": node.text if node.kind in ("code", "table") else markdown.plain_inline(node.text) or (node.lang if node.kind == "ref" else ""), "ordered": node.ordered if node.kind == "list" else None, "lang": node.lang if node.kind == "code" else None})
        for target in dict.fromkeys(found):
            links.append({"kind": "inclusion" if node.kind == "ref" else "reference", "dst": target[0], "wiki": target[1], "block_pos": place, "section_path": list(path), "occurrences": 0 if node.kind == "table" else found.count(target)})
    own = fm.get(title_field) if title_field else None
    return {"key": key, "title": own if isinstance(own, str) else markdown.title(tree), "fm_json": yamlcore.to_json(fm), "content": content, "body": markdown.render(tree, folder), "plain": markdown.plain_text(tree), "blocks": blocks, "links": links}


def from_markdown(rows: DataFrame, title_field: str | None = None, format: str = "markdown") -> Corpus:
    """A corpus out of (key, content) rows. Rows are dealt out first: a small file can hold very many documents to parse."""
    reader = markdown.FORMATS[format]

    def run(frames):
        for frame in frames:
            parsed = [parse_document(k, c or "", title_field, reader) for k, c in zip(frame["key"], frame["content"], strict=True)]
            yield pd.DataFrame(parsed, columns=[c.split(" ")[0] for c in re.split(r", (?![^<]*>)", PARSED)])

    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _corpus(rows.select("key", "content").repartition(tasks, "key").mapInPandas(run, PARSED), format)


def _corpus(parsed: DataFrame, format: str) -> Corpus:
    docs = parsed.select("key", "title", variant(F.col("fm_json")).alias("fm"), "content", "body", "plain", "blocks")
    links = parsed.select(F.col("key").alias("src"), F.explode("links").alias("l")).select("src", "l.*")
    links = _with_wiki(links, parsed.select("key"))
    edge = ["src", "dst", "block_pos", "section_path", "occurrences"]
    corpus = Corpus(docs, links.where("kind = 'inclusion'").select(*edge), links.where("kind = 'reference'").select(*edge), {"format": format})
    corpus.parsed = parsed
    return corpus


def read_once(corpus: Corpus) -> Corpus:
    """The corpus over its parsed documents, written once; otherwise each use of documents, edges or keys parses all again."""
    if getattr(corpus, "parsed", None) is None:
        return corpus
    found = _corpus(kept(corpus, "parsed", lambda: corpus.parsed), corpus.options["format"])
    found.options, found.typed, found.parsed = corpus.options, corpus.typed, None
    return found


def _with_wiki(links: DataFrame, keys: DataFrame) -> DataFrame:
    """Wiki links point to the document whose key ends in their name: fewest segments, then smallest key."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    wiki = links.where("wiki").withColumn("base", base(F.col("dst"))).withColumn("at", F.monotonically_increasing_id())
    known = keys.select(F.col("key").alias("to")).withColumn("base", base(F.col("to")))
    hits = wiki.join(known, "base").where((F.col("to") == F.col("dst")) | F.col("to").endswith(F.concat(F.lit("/"), "dst")))
    best = hits.groupBy("src", "dst").agg(F.min(F.struct(F.size(F.split("to", "/")).alias("n"), "to")).alias("best")).select("src", "dst", F.col("best.to").alias("to"))
    resolved = links.where("wiki").join(best, ["src", "dst"], "left").withColumn("dst", F.coalesce("to", "dst")).drop("to")
    return links.where("NOT wiki").unionByName(resolved)


def ignore_regex(pattern: str) -> str:
    """A line of an ignore file as a regular expression over relative paths."""
    from ..functions.text import glob_regex

    only_dirs = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    anchored = "/" in pattern
    inner = glob_regex(pattern.lstrip("/")).removeprefix("^").removesuffix("$")
    return f"^{'' if anchored else '(?:.*/)?'}{inner}{'/.*' if only_dirs else '(?:/.*)?'}$"


def relative(file: Column, path: str) -> Column:
    """Paths in a folder, out of the URLs that Spark's readers give."""
    root = re.sub(r"^file:/*", "/", path).rstrip("/")
    return F.regexp_replace(F.url_decode(F.regexp_replace(file, "\\+", "%2B")), f"^(?:file:/*)?{re.escape(root)}/", "")


def ignore_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(folder, line) of the ignore files in a folder and below, in the order of precedence; hidden folders are skipped."""
    jvm, rules, folders = spark.sparkContext._jvm, [], [""]
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while folders:  # by levels, since a deeper file overrides
        below = []
        for folder in sorted(folders):
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}") if folder else root
            there, entries = set(), fs.listStatusIterator(at)
            while entries.hasNext():
                entry = entries.next()
                name = entry.getPath().getName()
                if entry.isDirectory() and not name.startswith("."):
                    below.append(f"{folder}{name}/")
                elif name in (".gitignore", ".ignore"):
                    there.add(name)
            for name in sorted(there):  # .gitignore, then .ignore
                stream = fs.open(jvm.org.apache.hadoop.fs.Path(at, name))
                rules += [(folder, line) for line in jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")]
                stream.close()
        folders = below
    return rules


def ignored(rel: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether a path is hidden or left out; the last rule that matches a path decides."""
    out = F.lit(False)
    for folder, line in rules:
        line = line.strip()
        if line and not line.startswith("#"):
            pattern = ignore_regex(line.removeprefix("!")).removeprefix("^")
            out = F.when(rel.rlike(f"^{re.escape(folder)}{pattern}"), not line.startswith("!")).otherwise(out)
    return rel.rlike(r"(^|/)\.") | out


def sanitised(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "^﻿", ""), "\r\n?", "\n")


def read_directory(spark: SparkSession, path: str, extension: str = "md", ignore: list[str] | None = None) -> DataFrame:
    """(key, content) of a folder's documents; hidden paths are skipped.

    ``ignore`` lines default to the ignore files of the folder and of those below; the last line that matches a path
    decides, and deeper files come later.
    """
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(path)
    rows = files.select(relative(F.col("_metadata.file_path"), path).alias("rel"), "value")
    rules = ignore_rules(spark, path) if ignore is None else [("", line) for line in ignore]
    key = F.regexp_replace("rel", rf"\.{extension}$", "")
    return rows.where(~ignored(F.col("rel"), rules)).select(key.alias("key"), sanitised(F.col("value")).alias("content"))


def from_directory(spark: SparkSession, path: str, **options) -> Corpus:
    return from_markdown(read_directory(spark, path), **options)


def from_literal(spark: SparkSession, text: str) -> Corpus:
    """Documents separated by lines that hold only ``_``; keys are 1, 2, 3, ..."""
    parts = [p.strip("\n") for p in re.split(r"^_$", text, flags=re.MULTILINE)]
    return from_markdown(spark.createDataFrame([(str(i + 1), p) for i, p in enumerate(parts)], "key string, content string"))


def keys_of(spark: SparkSession, text: str) -> DataFrame:
    """(key) out of lines, as given on standard input."""
    return spark.createDataFrame([(k.strip(),) for k in text.split("\n") if k.strip()], "key string")


def _mounted(path: str) -> str:
    """The path without its scheme; other stores than mounted file systems are refused."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme and scheme[1] != "file":
        raise ValueError(f"documents are written to mounted file systems only, not to {scheme[1]}; write them as a table there")
    return re.sub(r"^file:/*", "/", path)


def write_directory(documents: DataFrame, path: str, extension: str = "md") -> None:
    """One file for each (key, content), written by the executors to a file system that all of them have mounted."""
    from pathlib import Path

    root = _mounted(path)

    def write(rows):
        for r in rows:
            file = Path(root, f"{r['key']}.{extension}")
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(r["content"] or "")

    documents.select("key", "content").foreachPartition(write)


def apply_to_directory(changes: DataFrame, path: str, extension: str = "md") -> None:
    """Removes first (with folders that become empty), then creates and updates."""
    from pathlib import Path

    root = Path(_mounted(path))
    changes = staged(changes, "changes")  # they may come from the files that are about to change

    def remove(rows):
        for r in rows:
            file = root / f"{r['key']}.{extension}"
            file.unlink(missing_ok=True)
            folder = file.parent
            while folder != root and folder.is_dir() and not any(folder.iterdir()):
                folder.rmdir()
                folder = folder.parent

    changes.where("op = 'remove'").select("key").foreachPartition(remove)
    write_directory(changes.where("op <> 'remove'"), path, extension)


def first_per_key(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("_n = 1").drop("_n")
