"""The command line: ``python -m quillon COMMAND FOLDER ...``.

Readers print JSON rows or text. Writers apply their change set to the folder, or print it with ``--dry-run``.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import edits, export
from .sources import files
from .workspace import Workspace

#: Name of the file with a folder's options.
CONFIG = ".quillon.toml"
#: Commands by what they give.
READERS = ("find", "count", "retrieve", "tree", "squash", "export", "schema", "stats", "query")
WRITERS = ("create", "new", "update", "attach", "delete", "rename", "extract", "inline", "normalize")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon", description="Queries and edits of a folder of linked documents.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *arguments: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text, description=text)
        p.add_argument("folder")
        for a in arguments:
            p.add_argument(a)
        if name in WRITERS:
            p.add_argument("--dry-run", action="store_true", help="print the changes only")
        return p

    def selectors(p: argparse.ArgumentParser) -> None:
        p.add_argument("--filter")
        for flag in ("key", "includes", "included-by", "references", "referenced-by", "in", "in-any", "not-in"):
            p.add_argument(f"--{flag}", action="append", default=[], dest="in_" if flag == "in" else flag.replace("-", "_"))
        p.add_argument("--refs-to")
        p.add_argument("--refs-from")
        p.add_argument("--roots", action="store_true")
        p.add_argument("--max-depth", type=int, default=1)
        p.add_argument("--max-distance", type=int, default=1)
        p.add_argument("--limit", type=int, default=0)

    command("init", "Writes a file of options into a folder.")
    p = command("find", "Documents, as JSON rows.")
    selectors(p)
    for flag in ("project", "add-fields", "lexical", "fuzzy", "sort", "blocks", "matches"):
        p.add_argument(f"--{flag}")
    selectors(command("count", "The number of documents."))
    p = command("retrieve", "Documents with their surroundings, as JSON rows.")
    p.add_argument("--key", action="append", default=[])
    p.add_argument("--lexical")
    p.add_argument("--fuzzy")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--expand", action="append", default=[], metavar="KIND:DEPTH", help="includes, includedBy, references or referencedBy; depth 0 has no bound")
    p = command("tree", "Inclusions below the roots or given documents.")
    p.add_argument("--key", action="append", default=[])
    p.add_argument("--depth", type=int, default=4)
    command("squash", "A document with its inclusions in place.", "key").add_argument("--depth", type=int, default=2)
    p = command("export", "The graph in the DOT language.")
    p.add_argument("--key", action="append", default=[])
    p.add_argument("--depth", type=int, default=0)
    p.add_argument("--sections", action="store_true")
    command("schema", "The metadata fields in use.")
    command("stats", "Statistics of the corpus or of one document.").add_argument("--key")
    p = command("query", "An operation document; updates and deletes give their change set.", "kind")
    p.add_argument("document", help="the text, or - for standard input")
    p = command("create", "A document with given text (- for standard input).", "key", "content")
    p.add_argument("--if-exists", default="fail")
    p = command("new", "A document out of a template.", "title")
    p.add_argument("--template", default="# {{title}}\n")
    p.add_argument("--key", default="{{slug}}")
    command("update", "Replaces a document's text (- for standard input).", "key", "content")
    command("attach", "Adds a reference to a document at the end of another.", "key", "to")
    p = command("delete", "Deletes documents and the references to them.")
    p.add_argument("key", nargs="+")
    command("rename", "Renames a document and the references to it.", "old", "new")
    command("extract", "Makes a section a document of its own.", "key").add_argument("--section")
    p = command("inline", "Puts an included document in the place of its reference.", "key", "reference")
    p.add_argument("--as-quote", action="store_true")
    p.add_argument("--keep", action="store_true")
    command("normalize", "All documents in normal form.")
    commands.add_parser("completions", help="The words that a shell may complete.")
    commands.add_parser("docs", help="All commands and their arguments.")
    command("serve", "Answers tool calls on standard input, one JSON object a line.")
    return top


def _text(given: str) -> str:
    return sys.stdin.read() if given == "-" else given


def _number(given: str | None) -> str | int | None:
    return int(given) if given is not None and given.isdigit() else given


def config(folder: str) -> dict:
    """The options of a folder: extension, title_field, language and stop_words of searches, schemas by name, bindings (name -> patterns of keys)."""
    import tomllib

    at = Path(folder, CONFIG)
    return tomllib.loads(at.read_text()) if at.exists() else {}


def open_folder(spark: SparkSession, folder: str) -> Workspace:
    options = config(folder)
    rows = files.read_directory(spark, folder, options.get("extension", "md"))
    corpus = files.from_markdown(rows, options.get("title_field"), options.get("format", "markdown"))
    corpus.options |= {k: tuple(v) if isinstance(v, list) else v for k, v in options.items() if k in ("language", "stop_words")}
    return Workspace(corpus, options.get("schemas"), options.get("bindings"))


def perform(w: Workspace, a: argparse.Namespace):
    """What a command gives: rows, text or a number; for writers a change set."""
    given = {k: v for k, v in vars(a).items() if k not in ("command", "folder", "dry_run")}
    if a.command in ("find", "count"):
        return getattr(w, a.command)(**given)
    if a.command == "retrieve":
        expand = {kind: int(depth or 1) for kind, _, depth in (e.partition(":") for e in a.expand)}
        return w.retrieve(a.key, expand, a.lexical, a.fuzzy, a.limit)
    if a.command == "query":
        return w.query(a.kind, _text(a.document))
    if a.command in ("create", "update"):
        content = _text(a.content)
        return w.create(a.key, content, a.if_exists) if a.command == "create" else w.update(a.key, content)
    if a.command == "new":
        return w.new(a.template, a.key, title=a.title)
    if a.command == "delete":
        return w.delete(*a.key)
    if a.command == "extract":
        return w.extract(a.key, _number(a.section))
    if a.command == "inline":
        return w.inline(a.key, _number(a.reference), as_quote=a.as_quote, keep=a.keep)
    if a.command in ("tree", "export"):
        return getattr(w, a.command)(a.key, **{k: v for k, v in given.items() if k != "key"})
    return getattr(w, a.command)(**given)


def shown(result) -> str:
    return "\n".join(r["value"] for r in export.json_rows(result).toLocalIterator()) if isinstance(result, DataFrame) else str(result)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = parser()
    a = top.parse_args(arguments)
    commands = next(x for x in top._actions if x.dest == "command").choices
    if a.command == "completions":
        print("\n".join(f"{name} {flag}" for name, p in commands.items() for flag in sorted(p._option_string_actions)))
        return 0
    if a.command == "docs":
        print("\n".join(p.format_help() for p in commands.values()))
        return 0
    if a.command == "init":
        at = Path(a.folder, CONFIG)
        if at.exists():
            print(f"{at} exists", file=sys.stderr)
            return 1
        at.write_text('extension = "md"\n# title_field = "title"\n# language = "english"\n# [schemas.note]\n# [bindings]\n# note = ["notes/**"]\n')
        return 0
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    w = open_folder(spark, a.folder)
    if a.command == "serve":
        from . import server

        server.serve(w, a.folder, sys.stdin, sys.stdout)
        return 0
    try:
        result = perform(w, a)
        if a.command not in WRITERS or a.dry_run:
            print(shown(result))
        else:
            w.commit(result)  # refuses what breaks a schema
            files.apply_to_directory(result, a.folder, config(a.folder).get("extension", "md"))
    except (ValueError, KeyError, edits.EvaluationError) as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)}), file=sys.stderr)
        return 1
    return 0
