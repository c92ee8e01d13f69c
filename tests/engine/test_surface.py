"""Flags, tools, the second format, conventions and editor edits."""

import datetime

import pytest

from quillon.operators import edits, reshape
from quillon.operators.evidence import evidence
from quillon.plans import ir, lowering
from quillon.plans.parse import QueryError
from quillon.sources import djot, files, markdown
from quillon.workspace import Workspace

NOTES = "# Index\n\n[Ada](people/ada)\n\n[Two](2)\n_\n# Two\n\nSee [Ada](people/ada) and TODO\n_\n# Three\n\nalone\n"


@pytest.fixture(scope="module")
def space(spark):
    rows = [("1", NOTES.split("_\n")[0]), ("2", NOTES.split("_\n")[1]), ("3", NOTES.split("_\n")[2]), ("people/ada", "---\ntype: person\n---\n# Ada\n\n- b\n- a\n")]
    return Workspace(files.from_markdown(spark.createDataFrame(rows, "key string, content string")).cache())


def keys(df):
    return [r["key"] for r in df.collect()]


def test_flags():
    s = lowering.selector
    assert s() is None
    assert s(key=["a"]) == ir.KeyTest("eq", ("a",)) and s(key=["a", "b"]) == ir.KeyTest("in", ("a", "b"))
    assert s(included_by=["a:5"]) == ir.Relation("includedBy", ir.KeyTest("eq", ("a",)), 1, 5)
    assert s(included_by=["a"]).high == 1 and s(in_=["a"], max_depth=None).high == ir.UNBOUNDED and s(references=["a:0"]).high == ir.UNBOUNDED
    assert isinstance(s(in_any=["a", "b"]), ir.AnyOf) and isinstance(s(not_in=["a"]), ir.NoneOf) and isinstance(s(refs_to="a"), ir.AnyOf)
    with pytest.raises(QueryError):
        s(key=["a"], filter="$key: b")
    with pytest.raises(QueryError):
        s(includes=["a:x"])
    with pytest.raises(QueryError):
        lowering.find_operation(project="a", add_fields="b")


def test_tools(space):
    assert keys(space.find()) == ["people/ada", "2", "1", "3"]
    assert keys(space.find(roots=True, sort="x:1")) == ["1", "3"]
    assert keys(space.find(matches="TODO")) == ["2"]
    assert space.count(included_by=["1"]) == 2
    assert keys(space.find(lexical="alone")) == ["3"]
    assert keys(space.retrieve(["2", "1"], {"includes": 0}).orderBy("ord", "phase", "child", "depth", "key")) == ["2", "1", "people/ada"]
    assert keys(space.retrieve(lexical="alone")) == ["3"]
    assert space.query("count", "filter: {type: person}").first()["count"] == 1
    with pytest.raises(QueryError):
        space.query("delete", "filter: {type: person}")
    assert space.tree(["1"]).count() == 3
    assert space.stats("2").first()["included_by_count"] == 1 and space.stats().first()["total_documents"] == 4
    assert [(r["rule"], r["key"]) for r in space.findings().orderBy("key").collect()] == [("orphan", "1"), ("orphan", "3")]
    assert '"1" -> "2";' in space.export()
    assert space.schema().first()["path"] == "type" and space.tokens().count() == 4


def test_changes(space):
    after = space.commit(space.create("new", "# New\n\n[Three](3)\n"))
    assert "new" in keys(after.corpus.documents) and after.count(included_by=["new"]) == 1
    with pytest.raises(ValueError):
        space.create("1", "x")
    assert space.create("1", "x", "skip").count() == 0
    made = space.new("# {{title}}\n\n{{today:%d.%m.%Y}}\n", "log/{{slug}}", datetime.datetime(2026, 3, 1), title="Big Day").first()
    assert (made["key"], made["content"]) == ("log/big-day", "# Big Day\n\n01.03.2026\n")
    gone = space.commit(space.delete("2"))
    assert sorted(keys(gone.corpus.documents)) == ["1", "3", "people/ada"]
    moved = space.commit(space.rename("people/ada", "ada"))
    assert moved.count(included_by=["1"]) == 2 and moved.count(key=["ada"]) == 1
    assert space.normalize().count() == 1  # the metadata gets its blank line
    strict = Workspace(space.corpus, {"n": {"sections": [{"header": {"const": "Index"}}]}}, {"n": ["1"]})
    with pytest.raises(edits.EvaluationError):
        strict.commit(strict.update("1", "# Other\n"))


def test_djot(spark):
    tree = djot.parse("# Long\nheading\n\n*strong* and _em_ and `*code*`\n\n::: note\ninside\n:::\n\n- a\n- b\n")
    assert markdown.render(tree) == "# Long heading\n\n**strong** and *em* and `*code*`\n\ninside\n\n- a\n- b\n"
    c = files.from_markdown(spark.createDataFrame([("a", "# A\n\n[B](b)\n"), ("b", "# B")], "key string, content string"), format="djot")
    assert c.inclusion_edges.count() == 1


def test_conventions(space):
    rows = {(r["convention"], r["way"]): r["n"] for r in evidence(space.corpus).collect()}
    assert rows[("link", "markdown")] == 3 and rows[("bullet", "-")] == 2 and ("link", "wiki") not in rows


def test_reshape():
    text = "# D\n\n- b\n  - c\n- a\n\np [x](y)\n"
    assert reshape.sort_list("k", text, 1) == "# D\n\n- a\n- b\n  - c\n\np [x](y)\n"
    assert reshape.change_list("k", text, 1).startswith("# D\n\n1. b\n")
    out = reshape.list_to_sections("k", "# D\n\n- b\n  - c\n- a\n", 1)
    assert out == "# D\n\n## b\n\n### c\n\n## a\n"
    assert reshape.sections_to_list("k", "# D\n\n## b\n\n### c\n", 1) == "# D\n\n- b\n  - c\n"
    assert reshape.toggle_item("k", "- [ ] a\n", 1) == "- [x] a\n"
    assert reshape.unlink("k", text, 6).endswith("p x\n")
    assert reshape.link("k", "# D\n\nsome text\n", 1, "t") == "# D\n\n[some text](t)\n"


def test_file_events_keep_equal_names_apart(spark, tmp_path):
    from quillon.streaming import changes

    for name in ("a/x.md", "b/x.md", "top y.md"):
        at = tmp_path / "notes" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(name)
    table = changes.DocumentTable(spark, str(tmp_path / "table"))
    changes.maintain(changes.file_events(spark, str(tmp_path / "notes")), table, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert {r["key"]: r["content"] for r in table.read().collect()} == {"a/x": "a/x.md", "b/x": "b/x.md", "top y": "top y.md"}
    hidden = tmp_path / "notes" / "b" / ".gitignore"
    hidden.write_text("z*\n!z1.md\n")
    for name in ("b/z0.md", "b/z1.md", "a/z0.md", ".h/w.md"):
        (tmp_path / "notes" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "notes" / name).write_text(name)
    (tmp_path / "notes" / "a" / "x.md").unlink()
    gone = changes.sweep(table, str(tmp_path / "notes"))
    assert [(r["op"], r["key"]) for r in gone.collect()] == [("remove", "a/x")]
    changes.maintain(changes.file_events(spark, str(tmp_path / "notes")), table, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert sorted(r["key"] for r in table.read().collect()) == ["a/z0", "b/x", "b/z1", "top y"]
    assert files.read_directory(spark, str(tmp_path / "notes")).count() == 4


def test_table_writes_only_what_changes(spark, tmp_path):
    from quillon.streaming import changes

    event = lambda *rows: spark.createDataFrame([(k, c, c is None, None) for k, c in rows], changes.EVENTS)
    table = changes.DocumentTable(spark, str(tmp_path / "table"), buckets=8)
    changes.apply_batch(table, event(*((f"k{i}", "old") for i in range(50))), 0)
    changes.apply_batch(table, event(("k7", "new"), ("k7", "newer")), 1)
    wrote = [p.name for p in (tmp_path / "table" / "v=1").iterdir() if p.name.startswith("bucket=")]
    assert len(wrote) == 1
    again = changes.DocumentTable(spark, str(tmp_path / "table"))
    assert again.buckets == 8 and again.read().count() == 50 and again.last_batch() == 1
    assert [r["content"] for r in again.read().where("key = 'k7'").collect()] == ["newer"]
    assert again.read(0).where("content = 'old'").count() == 50
    changes.apply_batch(again, event(*((f"k{i}", None) for i in range(50))), 2)
    assert again.read().count() == 0 and again.versions() == [1, 2]
    assert not (tmp_path / "table" / "v=0").exists() or any((tmp_path / "table" / "v=0").iterdir())


def test_other_stores_are_refused(spark):
    rows = spark.createDataFrame([("a", "x")], "key string, content string")
    with pytest.raises(ValueError):
        files.write_directory(rows, "hdfs://host/notes")


def test_index_follows_changes(spark, tmp_path):
    from quillon.operators import search
    from quillon.streaming import changes

    table, index = changes.DocumentTable(spark, str(tmp_path / "t"), 4), changes.term_index(spark, str(tmp_path / "i"), 4)
    event = lambda *rows: spark.createDataFrame([(k, c, c is None, None) for k, c in rows], changes.EVENTS)
    follow = lambda delta, n: changes.update_index(index, delta, n)
    changes.apply_batch(table, event(("a", "# A\n\nrunning dogs"), ("b", "# B\n\nthe cat runs"), ("c", "# C\n\nquiet")), 0, follow)
    changes.apply_batch(table, event(("a", None), ("c", "# C\n\nruns and runs"), ("d", "# D\n\nno")), 1, follow)
    corpus = files.from_markdown(table.read())
    found = [{r["key"]: round(r["score"], 9) for r in search.bm25(corpus, "running cat", index=i).collect()} for i in (None, index.read())]
    assert found[0] == found[1] and set(found[0]) == {"b", "c"}
    follow(spark.createDataFrame([("remove", "b", None)], "op string, key string, content string"), 1)
    assert index.read().where("key = 'b'").count() > 0  # batch 1 is there already
