"""Metadata tests: a truth table, and random documents against a plain evaluation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import fields, yamlcore
from quillon.plans import parse

TABLE = [
    ("status: draft", "status: draft", True),
    ("status: draft", "{}", False),
    ("status: {$ne: draft}", "{}", True),
    ("status: {$nin: [a]}", "{}", True),
    ("x: null", "x: null", True),
    ("x: null", "{}", False),
    ("x: {$exists: true}", "x: null", True),
    ("x: {$exists: false}", "x: null", False),
    ("x: {$type: 'null'}", "x: null", True),
    ("x: {$ne: null}", "{}", True),
    ("tags: rust", "tags: [rust, go]", True),
    ("tags: [rust, go]", "tags: [rust, go]", True),
    ("tags: [go, rust]", "tags: [rust, go]", False),
    ("tags: {$all: [go, rust]}", "tags: [rust, go]", True),
    ("tags: {$all: [go]}", "tags: go", False),
    ("tags: {$size: 2}", "tags: [rust, go]", True),
    ("tags: {$size: {$gte: 3}}", "tags: [rust, go]", False),
    ("tags: {$size: 0}", "{}", False),
    ("n: 5", "n: '5'", False),
    ("n: '5'", "n: 5", False),
    ("n: 5", "n: 5.0", True),
    ("n: {$gt: 3}", "n: 5", True),
    ("n: {$gt: 3}", "n: a", False),
    ("n: {$gt: 3}", "n: null", False),
    ("n: {$gte: 3, $lte: 4}", "n: [1, 9]", True),
    ("n: 9007199254740993", "n: 9007199254740992", False),
    ("n: {$gt: 18446744073709551614}", "n: 18446744073709551615", True),
    ("n: .nan", "n: .nan", False),
    ("n: {$gte: 1}", "n: .nan", False),
    ("n: {$type: number}", "n: .nan", True),
    ("d: {$gte: 2026-01-01}", "d: 2026-02-01", True),
    ("d: {$type: date}", "d: 2026-99-99", True),
    ("d: {$type: string}", "d: 2026-01-01", True),
    ("d: {$type: datetime}", "d: 2026-01-01T10:00:00Z", True),
    ("d: {$type: datetime}", "d: '2026-01-01 10:00:00.5+02'", True),
    ("d: {$type: datetime}", "d: 2026-01-01", False),
    ("f: {$gt: false}", "f: true", True),
    ("$nor: [{reviewed: true}]", "{}", True),
    ("author.name: alice", "author: {name: alice}", True),
    ("author.name: alice", "author: alice", False),
    ("author: {$eq: {name: a, n: 1}}", "author: {n: 1, name: a}", True),
    ("x: [1, 2]", "x: [1e0, 2.0]", True),
    ("x: [1, 2]", "x: [1, 2, 3]", False),
    ("x: [[1], {a: null}]", "x: [[1.0], {a: null}]", True),
    ("x: {$eq: {a: 1}}", "x: {a: 1, b: 2}", False),
    ("x: {$eq: {a: [2, x]}}", "x: {a: [2.0, x]}", True),
    ("x: {$eq: {a: null}}", "x: {b: null}", False),
    ("x: []", "x: []", True),
    ("_h: 1", "_h: 1", False),
    ("a: {$not: {$gt: 1, $lt: 5}}", "a: 3", False),
    ("a: {$not: {$gt: 1, $lt: 5}}", "{}", True),
    ("a: {$in: [1, x]}", "a: x", True),
    ("a: {$in: [x, y]}", "a: [q, y]", True),
]


def holds(spark, cases):
    docs = [(i, yamlcore.to_json(yamlcore.loads(d))) for i, (_, d) in enumerate(cases)]
    df = spark.createDataFrame(docs, "i int, j string").select("i", F.parse_json("j").alias("fm"))
    from quillon.plans.compile import _Selection

    class C:
        documents = df

    out = []
    for i, (f, _) in enumerate(cases):
        selection = _Selection(C, False)
        column = selection._column(parse.parse_filter_expression(f), False)
        out.append(df.where(f"i = {i}").withColumn("is_document", F.lit(True)).select(column.alias("r"), F.lit(i).alias("i")))
    from functools import reduce

    rows = reduce(lambda a, b: a.unionByName(b), out).collect()
    return {r["i"]: r["r"] for r in rows}


def test_truth_table(spark):
    got = holds(spark, [(f, d) for f, d, _ in TABLE])
    wrong = [TABLE[i] for i in range(len(TABLE)) if got[i] is not TABLE[i][2]]
    assert not wrong


def plain_cmp(op, a, b):
    if isinstance(a, bool) != isinstance(b, bool) or a is None or b is None:
        return False
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if not (number(a) and number(b) or type(a) is type(b)):
        return False
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def plain_eq(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    number = lambda v: isinstance(v, (int, float))
    if number(a) and number(b):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(plain_eq, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(plain_eq(v, b[k]) for k, v in a.items())
    return a == b


def plain(test, doc):
    value, there = doc, True
    for p in test.path:
        if isinstance(value, dict) and p in value:
            value = value[p]
        else:
            there, value = False, None
    op, arg = test.op, test.arg
    if op == "ne":
        return not plain(type(test)(test.path, "eq", arg), doc)
    if op == "eq":
        if not there:
            return False
        if isinstance(value, list) and not isinstance(arg, (list, dict)):
            return any(plain_eq(v, arg) for v in value)
        return plain_eq(value, arg)
    if op in ("in", "nin"):
        hit = any(plain(type(test)(test.path, "eq", a), doc) for a in arg)
        return hit if op == "in" else not hit
    if not there:
        return op == "not" and not all(plain(t, doc) for t in arg)
    if op == "not":
        return not all(plain(t, doc) for t in arg)
    if isinstance(value, list) and not isinstance(arg, (list, dict)):
        return any(plain_cmp(op, v, arg) for v in value)
    return plain_cmp(op, value, arg)


@pytest.mark.parametrize("seed", range(2))
def test_random_documents(spark, seed):
    rng = random.Random(seed)
    scalar = lambda: rng.choice([None, True, False, 0, 1, 2, 1.5, -1, "a", "b", "1", "2026-01-01", ""])
    value = lambda: rng.choice([scalar(), scalar(), [scalar() for _ in range(rng.randrange(3))], {"k": scalar()}])
    docs = [{k: value() for k in ("x", "y") if rng.random() < 0.8} for _ in range(40)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").select("i", F.parse_json("j").alias("fm")).cache()
    from quillon.plans import ir

    tests = []
    for _ in range(25):
        op = rng.choice(["eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "not"])
        path = rng.choice([("x",), ("y",), ("x", "k")])
        arg = tuple(scalar() for _ in range(2)) if op in ("in", "nin") else (ir.FieldTest(path, rng.choice(["gt", "eq"]), scalar()),) if op == "not" else value() if op in ("eq", "ne") else scalar()
        tests.append(ir.FieldTest(path, op, arg))
    row = df.select("i", *[fields.field_test(F.col("fm"), t).alias(f"t{n}") for n, t in enumerate(tests)]).collect()
    for r in row:
        for n, t in enumerate(tests):
            assert r[f"t{n}"] is plain(t, docs[r["i"]]), (t, docs[r["i"]])


def test_sort(spark):
    values = [3, None, "b", True, [1], {"a": 1}, 1.5, "a", False, 10]
    rows = [(chr(97 + i), json.dumps({"v": v})) for i, v in enumerate(values)] + [("z", "{}")]
    df = spark.createDataFrame(rows, "key string, j string").select("key", F.parse_json("j").alias("fm"))
    from quillon.plans import ir

    asc = [r["key"] for r in df.orderBy(*fields.sort_columns(F.col("fm"), ir.Sort(("v",), False)), "key").collect()]
    assert asc == ["b", "z", "i", "d", "g", "a", "j", "h", "c", "e", "f"]
    desc = [r["key"] for r in df.orderBy(*fields.sort_columns(F.col("fm"), ir.Sort(("v",), True)), "key").collect()]
    assert desc == ["f", "e", "c", "h", "j", "a", "g", "d", "i", "b", "z"]


def test_typed_columns_agree_with_the_variant(spark):
    from quillon.functions.fields import typed_test
    from quillon.plans import ir

    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", "2"])) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, n int, s string").withColumn("fm", F.parse_json(F.to_json(F.struct("n", "s")))).cache()
    columns = []
    for name, kind in (("n", "number"), ("s", "string")):
        for op, arg in [("eq", 2), ("eq", "2"), ("eq", None), ("ne", 2), ("ne", "a"), ("gt", 1), ("lte", "a"), ("gte", 1.5), ("in", (1, "a", None)), ("nin", (2, "b")), ("exists", True), ("exists", False), ("type", ("number", "null")), ("not", (ir.FieldTest((name,), "gt", 1), ir.FieldTest((name,), "lt", 3)))]:
            t = ir.FieldTest((name,), op, arg)
            columns += [(t, typed_test(F.col(name), kind, t), fields.field_test(F.col("fm"), t))]
    got = df.select(*[c for i, (_, a, b) in enumerate(columns) for c in (a.alias(f"a{i}"), b.alias(f"b{i}"))]).collect()
    for r in got:
        for i, (t, _, _) in enumerate(columns):
            assert r[f"a{i}"] is r[f"b{i}"], t


def test_typed_filters_reach_the_scan(spark):
    from quillon import queries
    from quillon.plans import compile as plans

    plan = lambda df: df._jdf.queryExecution().toString()
    text = plan(plans.select(queries.texts(spark, "/root/testdata/sf0.001"), parse.parse_filter_expression("{lang: fr, n_chars: {$gt: 100}}")).select("key"))
    assert "EqualTo(lang,fr)" in text and "GreaterThan(n_chars,100)" in text
    # branches of a union whose kind differs are not read at all
    text = plan(plans.select(queries.geo(spark, "/root/testdata/sf0.001"), parse.parse_filter_expression("kind: nation")).select("key"))
    physical = text[text.index("== Physical Plan ==") :]
    assert physical.count("FileScan parquet") == 1 and "n_nationkey" in physical
