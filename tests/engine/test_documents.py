"""Markdown corpora: relations, blocks, projections, edits, search, statistics, schemas, streams."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import edits, export, graph, retrieve, schema, search, stats
from quillon.plans import compile as plans
from quillon.plans import ir, parse
from quillon.sources import corpus as sources
from quillon.sources import files, markdown
from quillon.streaming import changes as stream

NOTES = """---
status: draft
---
# Roadmap

Intro with [Two](2).

## Goals

Ship the **editor** integration

- first TODO
- [x] second
  - nested

### Q3 Milestones

Deliver block spec

[Two](2)

> quoted words

```py
code TODO
```
_
---
status: done
rank: 3
---
# Two

[Three](3)

See [[3]] and [gone](missing).
_
# Three

| a | b |
|---|---|
| TODO | [One](1) |
"""


@pytest.fixture(scope="module")
def notes(spark):
    return files.from_literal(spark, NOTES).cache()


def keys(df):
    return sorted(r["key"] for r in df.collect())


def matching(corpus, text, **options):
    return keys(plans.select(corpus, parse.parse_filter_expression(text), **options))


@pytest.mark.parametrize(
    "text,want",
    [
        ("status: draft", ["1"]),
        ("status: {$exists: false}", ["3"]),
        ("$includedBy: '1'", ["2"]),
        ("$includedBy: {match: {$key: '1'}, maxDepth: 0}", ["2", "3"]),
        ("$includedBy: {match: {$key: '1'}, minDepth: 2, maxDepth: 2}", ["3"]),
        ("$includes: '3'", ["2"]),
        ("$includes: {match: {$key: '3'}, maxDepth: 5}", ["1", "2"]),
        ("$references: '3'", ["2"]),
        ("$referencedBy: '1'", ["2"]),
        ("$referencedBy: '2'", ["3", "missing"]),
        ("$includedBy: {$size: 0}", ["1"]),
        ("$includes: {$size: 0}", ["3"]),
        ("$referencedBy: {$size: {$gte: 1}, match: {status: done}}", ["3"]),
        ("$includedBy: nothing", []),
        ("{$referencedBy: '2', status: {$ne: done}}", ["3", "missing"]),
        ("$or: [{$referencedBy: '2'}, {status: draft}]", ["1", "3", "missing"]),
        ("$nor: [{$referencedBy: '2'}]", ["1", "2"]),
        ("$content: {$text: todo}", ["1", "3"]),
        ("$content: {$code: {$text: todo}}", ["1"]),
        ("$content: {$item: {$matches: '^first'}}", ["1"]),
        ("$content: {$header: Goals, $contains: {$code: {}}}", ["1"]),
        ("$content: {$within: Goals, $quote: {}}", ["1"]),
        ("$content: {$references: '1'}", ["3"]),
        ("$content: {$table: {}}", ["3"]),
        ("$nor: [{$content: {$header: {$text: Two}}}]", ["1", "3"]),
        ("$content: {$ref: {$references: '2'}}", ["1"]),
    ],
)
def test_filters(notes, text, want):
    assert matching(notes, text) == want


def test_dangling_keys_can_be_left_out(notes):
    assert matching(notes, "$referencedBy: '2'", dangling=False) == ["3"]


CYCLE = "# A\n\n[B](2)\n_\n# B\n\n[C](3)\n\n[B](2)\n_\n# C\n\n[A](1)\n_\n# D\n\n[B](2)\n"


def test_cycles_and_bounds(spark):
    c = files.from_literal(spark, CYCLE)
    assert matching(c, "$includedBy: {match: {$key: '1'}, maxDepth: 0}") == ["2", "3"]
    assert matching(c, "$includedBy: {match: {$key: {$in: ['1', '4']}}, maxDepth: 0}") == ["2", "3"]
    # the shortest distance counts, for each anchor by itself
    assert matching(c, "$includedBy: {match: {$key: {$in: ['1', '2']}}, minDepth: 2, maxDepth: 2}") == ["3"]
    assert matching(c, "$includes: {$size: {$gte: 2}, maxDepth: 0}") == ["1", "2", "3", "4"]
    assert matching(c, "$includes: {$size: 1}") == ["1", "2", "3", "4"]
    hops = {r["key"]: r["depth"] for r in graph.walk(c.inclusion_edges, c.documents.where("key = '4'").select("key"), ir.UNBOUNDED).collect()}
    assert hops == {"2": 1, "3": 2, "1": 3}
    listed = [(r["trail"], r["level"]) for r in graph.tree(c, c.documents.where("key = '4'").select("key"), 6).orderBy("trail").collect()]
    assert listed == [(["4"], 0), (["4", "2"], 1), (["4", "2", "2"], 2), (["4", "2", "3"], 2), (["4", "2", "3", "1"], 3), (["4", "2", "3", "1", "2"], 4)]
    chains = sorted(r["keys"] for r in graph.paths(c).collect())
    assert chains == [["4"], ["4", "2"], ["4", "2", "3"], ["4", "2", "3", "1"]]


def test_projection(notes):
    rows = plans.find(notes, "{filter: {status: draft}, project: {key: $key, slug: $titleSlug, heads: {$content: {$header: {}}}, items: {$content: {$item: {}}}, all: $blocks, found: {$matches: 'TODO'}, out: $includes, absent: nothing}}").collect()
    (r,) = rows
    assert r["slug"] == "roadmap" and r["absent"] is None
    assert r["heads"] == "# Roadmap\n\n## Goals\n\n### Q3 Milestones\n"
    assert r["items"] == "- first TODO\n- [x] second\n  - nested\n"
    assert [b["type"] for b in r["all"]] == ["header", "paragraph", "header", "paragraph", "list", "item", "item", "list", "item", "header", "paragraph", "ref", "quote", "paragraph", "code"]
    assert [(f["path"], f["text"]) for f in r["found"]] == [(["Goals"], "first TODO"), (["Goals", "Q3 Milestones"], "code TODO")]
    assert [tuple(e) for e in r["out"]] == [("2", "Two", ["Goals", "Q3 Milestones"])]
    added = plans.find(notes, "{filter: {rank: 3}, addFields: {s: status}}").first()
    assert added["key"] == "2" and [e["key"] for e in added["includedBy"]] == ["1"] and [e["key"] for e in added["references"]] == ["3", "missing"]
    assert [r["key"] for r in plans.find(notes, "sort: {rank: -1}").collect()] == ["2", "1", "3"]
    assert plans.find(notes, ir.Find().where(ir.field_("rank") >= 2).limit(1)).count() == 1
    assert plans.count(notes, "limit: 2").first()["count"] == 2


def test_top_level_predicate_form(notes):
    rows = {r["key"]: r["content"] for r in plans.find(notes, "project: {$section: Goals}").collect()}
    assert rows["2"] == "" and rows["1"].startswith("## Goals\n\nShip")


NORMAL = [
    ("* a\n* b\n", "- a\n- b\n"),
    ("# a #\n\nb\nc\n", "# a\n\nb c\n"),
    ("Title\n=====\n\nx __y__ _z_\n", "# Title\n\nx **y** *z*\n"),
    ("### a\n\n## b\n\n# c\n", "# a\n\n# b\n\n# c\n"),
    ("# a\n\n### b\n", "# a\n\n## b\n"),
    ("- - a\n- b\n", "- a\n- b\n"),
    ("- > a\n- > b\n", "- > a\n- > b\n"),
    ("- ---\n- --- t\n", "-" * 72 + "\n\n- --- t\n"),
    ("1) a\n2) b\n", "1. a\n2. b\n"),
    ("~~~ py\nx\n~~~\n", "```py\nx\n```\n"),
    ("<div>\nraw\n</div>\n\nkept\n", "kept\n"),
    ("[x](a.md#s) and [y](http://e.com)\n", "[x](a#s) and [y](http://e.com)\n"),
    ("> a\nb\n\n***\n", "> a b\n\n" + "-" * 72 + "\n"),
    ("|a|b|\n|:-|-:|\n|1|22222|\n", "| a   |     b |\n| :-- | ----: |\n| 1   | 22222 |\n"),
    ("", ""),
]


@pytest.mark.parametrize("text,want", NORMAL)
def test_normal_form(text, want):
    got = markdown.normalise(text)
    assert got == want
    assert markdown.normalise(got) == got


def test_wiki_links(spark):
    rows = spark.createDataFrame([("a/b/note", "# N"), ("a/note", "# M"), ("x", "[[note]]\n\n[[note|Piped]] there")], "key string, content string")
    c = files.from_markdown(rows)
    assert [r["dst"] for r in c.inclusion_edges.collect()] == ["a/note"]
    assert [r["dst"] for r in c.reference_edges.collect()] == ["a/note"]


def run_update(corpus, text, **options):
    return {r["key"]: r["content"] for r in edits.update(corpus, text, **options).collect()}


@pytest.mark.parametrize(
    "body,update,want",
    [
        ("# D\n\nkeep\n\ndrop", "$delete: {$paragraph: {$text: drop}}", "# D\n\nkeep\n"),
        ("# D\n\npara", "$delete: {}", ""),
        ("# D\n\n## G\n\np\n\n### H\n\nq", "$delete: {$header: G}", "# D\n\np\n\n## H\n\nq\n"),
        ("# D\n\n## K\n\nk\n\n## G\n\ng", "$delete: {$section: G}", "# D\n\n## K\n\nk\n"),
        ("# D\n\n## G\n\ng", "$delete: {$within: G}", "# D\n\n## G\n"),
        ("# D\n\n## G\n\ng", "$replace: {$header: G, content: '## A'}", "# D\n\n## A\n\ng\n"),
        ("# D\n\n## G\n\ng", "$replace: {$header: G, content: text}", "# D\n\ntext\n\ng\n"),
        ("# D\n\n## G\n\ng", "$replace: {$section: G, content: text}", "# D\n\ntext\n"),
        ("# D\n\n- a\n- b", "$append: {$list: {}, content: '- c'}", "# D\n\n- a\n- b\n- c\n"),
        ("# D\n\n- a\n- b", "$insertAfter: {$item: a, content: '- x'}", "# D\n\n- a\n- x\n- b\n"),
        ("# D\n\n## G\n\ng", "$insertAfter: {$header: G, content: first}", "# D\n\n## G\n\nfirst\n\ng\n"),
        ("# D\n\n## G\n\ng\n\n## H", "$insertAfter: {$section: G, content: '## N'}", "# D\n\n## G\n\ng\n\n## N\n\n## H\n"),
        ("# D\n\np", "$insertBefore: {$paragraph: p, content: o}", "# D\n\no\n\np\n"),
        ("# D\n\nQ3 goal", "$replaceText: {$paragraph: {}, from: Q3, to: Q4}", "# D\n\nQ4 goal\n"),
        ("# D\n\nold", "$replaceText: {$header: D, to: E}", "# E\n\nold\n"),
        ("# D\n\n> a", "$append: {$quote: {}, content: b}", "# D\n\n> a\n>\n> b\n"),
        ("# D\n\n```\na b\n```", "$replaceText: {$code: {}, from: b, to: c}", "# D\n\n```\na c\n```\n"),
    ],
)
def test_block_edits(spark, body, update, want):
    plan = edits.plan_document("k", body, *parse.parse_update(parse.yamlcore.loads(update)))
    assert not plan.problems and plan.content == want


@pytest.mark.parametrize(
    "update,code",
    [
        ("$append: {$paragraph: {}, content: x}", "AppendNonContainer"),
        ("$replaceText: {$list: {}, to: x}", "ReplaceTextNoText"),
        ("$replaceText: {$text: first, from: zzz, to: x}", "ReplaceTextAnchor"),
        ("$append: {$list: {}, content: para}", "FragmentNotList"),
        ("{$delete: {$section: Goals}, $replaceText: {$text: Deliver, to: x}}", "Overlap"),
        ("$delete: {$section: Goals, expect: 2}", "Expect"),
    ],
)
def test_edit_errors(notes, update, code):
    text = update if update.startswith("{") else "{" + update + "}"
    with pytest.raises(edits.EvaluationError) as e:
        edits.update(notes, f"{{filter: {{status: draft}}, update: {text}}}")
    assert e.value.code == code and e.value.blocks


def test_update_and_guards(notes):
    new = run_update(notes, "{filter: {status: draft}, update: {$set: {a.b: 1, status: live}, $delete: {$header: Goals}}}")
    fm = markdown.frontmatter(new["1"])
    assert fm == {"status": "live", "a": {"b": 1}} and "## Q3 Milestones" in new["1"]
    with pytest.raises(edits.EvaluationError) as e:
        run_update(notes, "{filter: {}, update: {$set: {a: 1}}, expect: 1}")
    assert e.value.code == "ExpectDocuments"
    with pytest.raises(parse.QueryError):
        run_update(notes, "{filter: {}, update: {$set: {a: 1}}}", strict=True)
    assert set(run_update(notes, "{filter: {}, update: {$unset: {status: ''}}, limit: 1}")) == {"1"}


def test_document_operations(notes):
    gone = {r["key"]: (r["op"], r["content"]) for r in edits.delete(notes, "filter: {$key: '2'}").collect()}
    assert gone["2"][0] == "remove" and "](2)" not in gone["1"][1]
    moved = {r["key"]: (r["op"], r["content"]) for r in edits.rename(notes, "3", "d/three").collect()}
    assert moved["d/three"][0] == "create" and "[One](../1)" in moved["d/three"][1] and "(d/three)" in moved["2"][1] and "[[d/three]]" in moved["2"][1]
    with pytest.raises(ValueError):
        edits.rename(notes, "1", "2")
    out = {r["key"]: r["content"] for r in edits.extract(notes, "1", "Q3").collect()}
    assert out["q3-milestones"].startswith("# Q3 Milestones") and "[Q3 Milestones](q3-milestones)" in out["1"]
    into = {r["key"]: (r["op"], r["content"]) for r in edits.inline(notes, "2", "3").collect()}
    assert into["3"][0] == "remove" and "## Three" in into["2"][1]
    assert edits.attach(notes, "3", "2").count() == 0
    assert "[Roadmap](1)" in edits.attach(notes, "1", "3").first()["content"]
    assert "## Two" in edits.squash(notes, "1", 1) or "#### Two" in edits.squash(notes, "1", 1)
    merged = edits.merged(notes.spark.createDataFrame([("update", "1", "x")], edits.CHANGES), notes.spark.createDataFrame([("update", "1", "y")], edits.CHANGES))
    assert merged.first()["content"] == "y"
    assert keys(edits.apply(notes.documents, edits.delete(notes, "filter: {$key: '2'}"))) == ["1", "3"]


def test_search(spark):
    c = files.from_literal(spark, "---\nrank: 1\n---\n# One\n\napple apple apple orchard\n_\n---\nrank: 2\n---\n# Two\n\napple and orange basket\n_\n---\nrank: 3\n---\n# Three\n\norange citrus grove\n")
    find = lambda text: [r["key"] for r in plans.find(c, text).collect()]
    assert find("search: {lexical: apple}") == ["1", "2"]
    assert find("search: {lexical: apples}") == ["1", "2"]
    assert find("{search: {lexical: orange apple}, filter: {rank: {$gt: 1}}}") == ["2", "3"]
    assert find("{search: {lexical: apple}, sort: {rank: -1}}") == ["2", "1"]
    assert find("search: {lexical: the and}") == []
    assert search.warnings(ir.Search("the and")) and not search.warnings(ir.Search("apple"))
    assert find("search: {fuzzy: thr}") == ["3"]
    assert find("search: {lexical: citrus, fuzzy: two}") == ["2", "3"]
    assert search.subsequence_score("hello world", "hw") > search.subsequence_score("xhxxwx", "hw")
    assert search.subsequence_score("abc", "d") is None
    known = {"consistency": "consist", "consigned": "consign", "knackeries": "knackeri", "kneaded": "knead", "relational": "relat", "generously": "generous", "hopping": "hop", "hoping": "hope", "skies": "sky", "caresses": "caress", "ties": "tie", "agreed": "agre", "happily": "happili", "cry": "cri", "say": "say", "by": "by", "conditional": "condit", "falling": "fall", "controlling": "control", "beautiful": "beauti", "communism": "communism", "proceed": "proceed", "gas": "gas", "gaps": "gap"}
    assert {w: search.stem(w) for w in known} == known
    assert search.sections(c, "orange", limit=3).count() == 3


def test_similar_documents(spark):
    import random

    rng = random.Random(0)
    words = [rng.choice([f"w{i}" for i in range(300)]) for _ in range(80)]
    texts = [words, words, [*words[:-1], "other"], words[:40], [f"z{i}" for i in range(80)]]
    rows = spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(texts)], "k string, t string")
    c = sources.from_table(rows, "k", text="t")
    got = {r["key"]: (r["class"], r["links"]) for r in search.similar_documents(c).collect()}
    assert got["0"] == ("0", 2) and got["1"] == ("0", 2) and got["2"][1] == 2 and got["4"][1] == 0 and "3" not in got
    best = search.most_similar(c, rows.select(F.col("k").alias("key")).where("k = '2'")).collect()
    assert [r["other"] for r in best] == ["0", "1"]


def test_statistics(notes):
    s = {r["key"]: r for r in stats.document_stats(notes).collect()}
    assert (s["1"]["sections"], s["1"]["bullet_lists"], s["1"]["code_blocks"], s["1"]["quotes"]) == (3, 2, 1, 1)
    assert (s["2"]["included_by_count"], s["2"]["referenced_by_count"], s["2"]["references_count"]) == (1, 1, 2)
    total = stats.corpus_stats(notes).first()
    assert total["total_documents"] == 3 and total["orphaned_documents"] == 0
    rules = sorted((r["rule"], r["key"], r["other"]) for r in stats.findings(notes).collect())
    assert rules == [("dangling-link", "2", "missing")]
    assert stats.path_stats(notes).first()["root_sections"] == 1
    assert "total documents" in stats.report(notes)


def test_schema_inference(notes):
    rows = {r["path"]: r for r in schema.infer(notes.documents).collect()}
    assert rows["status"]["n"] == 2 and [(v["value"], v["n"]) for v in rows["status"]["values"]] == [("done", 1), ("draft", 1)]
    assert [t["type"] for t in rows["rank"]["types"]] == ["number"]


def test_schema_validation(notes):
    s = {"frontmatter": {"type": "object", "required": ["status"], "properties": {"status": {"enum": ["draft"]}}}, "sections": [{"header": {"pattern": "^[A-Z]"}, "maxContains": 1, "sections": [{"header": {"const": "Goals"}}]}], "additionalSections": False, "maxDepth": 2}
    got = sorted((r["key"], r["path"], r["keyword"]) for r in schema.validate(notes, {"n": s}, {"n": ["*", "!3"]}).collect())
    assert got == [("1", "/", "maxDepth"), ("2", "/Two", "minContains"), ("2", "frontmatter/status", "enum")]
    assert schema.explain(notes, {"n": s}, {"n": ["1"]}).first()["entry"] == "^[A-Z]"
    for bad in ({"nope": 1}, {"sections": [{}, {"header": {"const": "a"}}]}, {"$schema": "x"}):
        with pytest.raises(schema.SchemaError):
            schema.check_schema(bad)
    d = lambda sc, text: [(p, k) for p, k, _ in schema.validate_document("k", text, sc)]
    hub = {"sections": [{"header": {"pattern": ".+"}, "blocks": [{"type": "paragraph", "maxContains": 1}, {"type": "bullet-list", "minItems": 2, "items": {"text": {"maxLength": 5}}}], "additionalBlocks": False}]}
    schema.check_schema(hub)
    assert d(hub, "# A\n\nlead\n\n- one\n- two\n") == []
    assert d(hub, "# A\n\nlead\n\n- longer text\n\n```\nx\n```\n") == [("/A/blocks[1]", "minItems"), ("/A/blocks[1]/items[0]", "text/maxLength"), ("/A/blocks[2]", "additionalBlocks")]
    assert d({"blocks": [{"type": "code", "lang": {"enum": ["py"]}, "maxContains": 1}]}, "```js\nx\n```\n") == [("/", "minContains")]
    assert d({"allBlocks": {"text": {"maxLength": 3}}}, "> long quote\n\n- ab\n  - abcd\n") == [("/blocks[0]/blocks[0]", "text/maxLength"), ("/blocks[1]/items[0]/blocks[0]/items[0]", "text/maxLength")]
    for bad in ({"blocks": [{"type": "paragraph", "lang": {}}]}, {"blocks": [{"type": "nope"}]}, {"blocks": [{"type": "code"}, {"type": "code"}]}, {"allBlocks": {"type": "code"}}):
        with pytest.raises(schema.SchemaError):
            schema.check_schema(bad)
    e = lambda sc, v: [k for _, k, _ in schema.json_errors(sc, v)]
    assert e({"type": "integer", "minimum": 3}, 2) == ["minimum"] and e({"anyOf": [{"type": "string"}, {"const": 2}]}, 2) == []
    assert e({"$defs": {"a": {"type": "string"}}, "properties": {"x": {"$ref": "#/$defs/a"}}}, {"x": 1}) == ["type"]
    assert e({"items": {"type": "number"}, "uniqueItems": True}, [1, 1, "a"]) == ["type", "uniqueItems"]
    assert e({"additionalProperties": False, "properties": {"a": True}}, {"a": 1, "b": 2}) == ["additionalProperties"]


def test_retrieve_and_budget(notes, spark):
    seeds = spark.createDataFrame([("1", 1)], "key string, ord int")
    rows = retrieve.retrieve(notes, seeds, includes=ir.UNBOUNDED, backlinks=True).orderBy(*retrieve.ORDER).collect()
    assert [r["key"] for r in rows] == ["1", "2", "3"] and rows[1]["backlinks"] == ["1"]
    few = retrieve.retrieve(notes, seeds, includes=2, max_tokens=10).collect()
    assert [r["key"] for r in few] == ["1"]
    cut = retrieve.retrieve(notes, seeds, max_document_tokens=3).first()
    assert cut["clipped"] and "truncated" in cut["content"]
    sized = spark.createDataFrame([(1, 0), (2, 5), (3, 4), (4, 9), (5, 1)], "i int, tokens int")
    assert [r["i"] for r in retrieve.within(sized, ["i"], 9).orderBy("i").collect()] == [1, 2, 3]


def test_export(notes):
    text = export.dot_text(export.dot(notes, sections=True))
    assert '"1" -> "2";' in text and '"2" -> "3" [style=dashed];' in text and "shape=note" in text
    rows = plans.find(notes, "{filter: {status: draft}, project: {key: $key, title: $title, hits: {$blocks: {$code: {}}}}}")
    assert [r["line"] for r in export.grep_lines(rows, "hits").collect()] == ["1 › Goals › Q3 Milestones › code TODO"]
    assert export.index(rows) == "- [Roadmap](1)\n" and export.keys(rows) == "1\n"
    assert '"key":"1"' in export.json_rows(rows).first()["value"]


def test_directory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / ".hid").mkdir()
    (tmp_path / "a.md").write_text("﻿# A\r\n\r\n[B](d/b)\r\n")
    (tmp_path / "d" / "b.md").write_text("# B\n")
    (tmp_path / "skip.md").write_text("# S\n")
    (tmp_path / ".hid" / "c.md").write_text("# C\n")
    (tmp_path / ".gitignore").write_text("skip*\n")
    c = files.from_directory(spark, str(tmp_path))
    assert keys(c.documents) == ["a", "d/b"]
    assert matching(c, "$includedBy: a") == ["d/b"]
    files.apply_to_directory(edits.delete(c, "filter: {$key: d/b}"), str(tmp_path))
    assert not (tmp_path / "d").exists() and (tmp_path / "a.md").read_text() == "# A\n"


def test_stream(spark, tmp_path):
    events = [("a", "# A", False, 1), ("b", "# B", False, 1), ("a", "# A2", False, 2)], [("b", None, True, 3), ("a", "# A2", False, 3), ("c", "# C", False, 3)]
    table, seen = stream.DocumentTable(spark, str(tmp_path / "table")), []
    source = tmp_path / "in"
    for batch in events:
        df = spark.createDataFrame([(k, c, r, t) for k, c, r, t in batch], "key string, content string, removed boolean, t int").selectExpr("key", "content", "removed", "timestamp_seconds(t) AS at")
        df.coalesce(1).write.mode("append").parquet(str(source))
        q = stream.maintain(spark.readStream.schema(stream.EVENTS).parquet(str(source)), table, str(tmp_path / "cp"), lambda delta, n: seen.append(sorted((r["op"], r["key"]) for r in delta.collect())))
        q.awaitTermination()
    assert {r["key"]: r["content"] for r in table.read().collect()} == {"a": "# A2", "c": "# C"}
    assert seen == [[("create", "a"), ("create", "b")], [("create", "c"), ("remove", "b")]]
    stream.apply_batch(table, spark.createDataFrame([("z", "z", False, None)], stream.EVENTS), 0)
    assert keys(table.read()) == ["a", "c"]


def test_paths_have_no_longest(spark):
    from types import SimpleNamespace

    size = 103
    edges = spark.createDataFrame([(f"k{i}", f"k{i + 1}") for i in range(size - 1)], "src string, dst string").coalesce(1)
    chain = SimpleNamespace(inclusion_edges=edges)
    first = spark.createDataFrame([("k0",)], "key string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(graph, "roots", lambda corpus: first)
        assert max(len(r["keys"]) for r in graph.paths(chain).collect()) == size


def test_similar_documents_against_all_pairs(spark):
    """All pairs by the formula, over lengths, repeated words and copies; and no table has a row a document's term."""
    import math
    import random
    from collections import Counter

    from quillon.plans import staging

    rng = random.Random(5)
    texts = []
    for i in range(150):
        words = [f"w{min(int(rng.paretovariate(0.7)), 900)}" for _ in range(rng.choice([50, 60, 110, 400]))]
        texts += [words, [w if rng.random() > rng.choice([0, 0.02, 0.1, 0.2]) else f"x{rng.randrange(99)}" for w in words]]
        texts += [words + words[: len(words) // 2]] * (i % 3)
    rows = spark.createDataFrame([(f"{i:04}", " ".join(t)) for i, t in enumerate(texts)], "k string, t string")
    staging.clear(spark)
    got = {r["key"]: r["links"] for r in search.similar_documents(sources.from_table(rows, "k", text="t"), analyzer="simple").collect()}
    bags = [Counter(t) for t in texts]
    df = Counter(t for b in bags for t in b)
    n, avgdl = len(texts), sum(map(len, texts)) / len(texts)
    q = [{t: c * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) for t, c in b.items()} for b in bags]
    w = [{t: c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / avgdl)) for t, c in b.items()} for b, x in zip(bags, texts, strict=True)]
    score = lambda a, b: sum(v * w[b].get(t, 0) for t, v in q[a].items())
    whole = [score(i, i) for i in range(n)]
    want = dict.fromkeys(got, 0)
    for a in range(n):
        for b in range(a):
            if max(len(texts[a]), len(texts[b])) <= 2 * min(len(texts[a]), len(texts[b])) and min(score(a, b) / whole[a], score(b, a) / whole[b]) >= 0.85:
                for x in (a, b):
                    want[f"{x:04}"] += 1
    assert len(got) == n and got == want and sum(want.values()) > 300
    staged = {r["kind"]: r["n"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(staging.root(spark)).selectExpr("regexp_extract(path, '([a-z]+)-[0-9a-f]{32}', 1) AS kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert not {"terms", "weights", "blocks", "meeting"} & staged.keys()


def test_delete_parses_each_document_once(spark, tmp_path):
    from quillon.sources import markdown

    seen = str(tmp_path / "seen")

    def reader(body, folder):
        with open(seen, "a") as f:
            f.write("x\n")
        return markdown.parse(body, folder)

    rows = spark.createDataFrame([(f"d{i}", f"---\nsize: {i}\n---\n\n# T\n\n[[d7]] [x](d{i % 9})\n") for i in range(40)], "key string, content string").coalesce(1)
    markdown.FORMATS["counted"] = reader
    try:
        c = files.from_markdown(rows, format="counted")
        assert c.documents.rdd.getNumPartitions() >= 4
        got = sorted((r["op"], r["key"]) for r in edits.delete(c, "filter: {size: 7}").collect())
    finally:
        del markdown.FORMATS["counted"]
    assert got == sorted([("remove", "d7"), *[("update", f"d{i}") for i in range(40) if i != 7]])
    with open(seen) as f:
        assert len(f.readlines()) == 40
