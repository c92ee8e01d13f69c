"""The command line and the tool server, over a folder."""

import io
import json

import pytest

from quillon import cli, server


@pytest.fixture
def folder(tmp_path):
    notes = {"index": "---\nkind: map\n---\n\n# Map\n\n[A](a)\n", "a": "---\nkind: note\nn: 1\n---\n\n# A\n\nfirst text about spark\n\n## Part\n\nmore\n", "b": "# B\n\nsee [A](a)\n"}
    for name, text in notes.items():
        (tmp_path / f"{name}.md").write_text(text)
    return tmp_path


def ran(spark, capsys, *arguments):
    code = cli.main([str(a) for a in arguments], spark)
    said = capsys.readouterr()
    return code, said.out.strip(), said.err.strip()


def test_readers(spark, folder, capsys):
    assert ran(spark, capsys, "count", folder, "--filter", "kind: note")[1] == "1"
    rows = [json.loads(x) for x in ran(spark, capsys, "find", folder, "--project", "key: $key")[1].split("\n")]
    assert rows[0] == {"key": "a"} and len(rows) == 3
    rows = ran(spark, capsys, "find", folder, "--included-by", "index", "--project", "key: $key")[1]
    assert json.loads(rows) == {"key": "a"}
    assert "first text" in ran(spark, capsys, "squash", folder, "index")[1]
    assert ran(spark, capsys, "export", folder)[1].startswith("digraph")
    assert len(ran(spark, capsys, "tree", folder, "--key", "index")[1].split("\n")) == 2
    assert "total_documents" in ran(spark, capsys, "stats", folder)[1]
    assert "kind" in ran(spark, capsys, "schema", folder)[1]
    assert ran(spark, capsys, "retrieve", folder, "--key", "a", "--expand", "includedBy:1")[0] == 0
    code, _, err = ran(spark, capsys, "count", folder, "--filter", "{$nope: 1}")
    assert code == 1 and json.loads(err)["error"] == "QueryError"


def test_writers_change_the_folder(spark, folder, capsys):
    assert ran(spark, capsys, "rename", folder, "a", "c/a")[0] == 0
    assert not (folder / "a.md").exists() and "c/a" in (folder / "index.md").read_text()
    out = ran(spark, capsys, "delete", folder, "b", "--dry-run")[1]
    assert (folder / "b.md").exists() and json.loads(out.split("\n")[0])["key"] == "b"
    assert ran(spark, capsys, "create", folder, "d", "# D\n")[0] == 0 and (folder / "d.md").read_text() == "# D\n"
    assert ran(spark, capsys, "new", folder, "My Title")[0] == 0 and (folder / "my-title.md").exists()
    assert ran(spark, capsys, "create", folder, "d", "# E\n")[0] == 1


def test_words_and_options(spark, tmp_path, capsys):
    assert ran(spark, capsys, "init", tmp_path)[0] == 0 and cli.config(str(tmp_path)) == {"extension": "md"}
    assert ran(spark, capsys, "init", tmp_path)[0] == 1
    assert "find --filter" in ran(spark, capsys, "completions")[1] and "usage" in ran(spark, capsys, "docs")[1]


def test_server(spark, folder):
    ask = [
        {"id": 1, "method": "initialize"},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "find", "arguments": {"filter": "kind: note", "project": "key: $key"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "find", "arguments": {"nope": 1}}},
        {"id": 5, "method": "tools/call", "params": {"name": "create", "arguments": {"key": "n", "content": "# N\n"}}},
        {"id": 6, "method": "tools/call", "params": {"name": "squash", "arguments": {"key": "n"}}},
        {"id": 7, "method": "nope"},
    ]
    out = io.StringIO()
    server.serve(cli.open_folder(spark, str(folder)), str(folder), [json.dumps(x) for x in ask] + ["{bad"], out)
    replies = [json.loads(x) for x in out.getvalue().split("\n") if x]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, 6, 7, None]
    by = {r["id"]: r for r in replies}
    tools = {t["name"]: t for t in by[2]["result"]["tools"]}
    assert len(tools) == 14 and tools["rename"]["inputSchema"]["required"] == ["old", "new"]
    text = lambda i: by[i]["result"]["content"][0]["text"]
    assert json.loads(text(3)) == [{"key": "a"}]
    assert by[4]["result"]["isError"] and "nope" in text(4)
    assert json.loads(text(5)) == [{"op": "create", "key": "n"}] and (folder / "n.md").exists()
    assert text(6).startswith("# N") and "error" in by[7]
