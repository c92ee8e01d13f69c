"""Random documents and graphs: columns against trees, walks against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import blocks
from quillon.functions.blocktree import Index
from quillon.operators import edits, graph
from quillon.plans import compile as plans
from quillon.plans import ir, parse
from quillon.sources import corpus as sources
from quillon.sources import files, markdown

WORDS = ["alpha", "beta", "Goals", "TODO", "gamma 12", "[x](b)", "**bold**"]


def document(rng):
    out, level = [], 1
    for _ in range(rng.randrange(1, 9)):
        kind = rng.randrange(7)
        word = rng.choice(WORDS)
        if kind == 0:
            level = rng.randrange(1, 4)
            out.append("#" * level + " " + word)
        elif kind == 1:
            out.append(f"- {word}\n- {rng.choice(WORDS)}\n  - {rng.choice(WORDS)}")
        elif kind == 2:
            out.append(f"> {word}\n>\n> - {rng.choice(WORDS)}")
        elif kind == 3:
            out.append(f"```py\n{word}\nline\n```")
        elif kind == 4:
            out.append(f"[{word.strip('[]*')}](a)" if "(" not in word else "[y](a)")
        elif kind == 5:
            out.append(f"| h | k |\n|---|---|\n| {word} | v |")
        else:
            out.append(word)
    return "\n\n".join(out)


def predicate(rng, depth=2):
    tests = []
    for _ in range(rng.choice([0, 1, 1, 2])):
        op = rng.choice(["contains_text", "equals_text", "matches", "kind", "references"] + (["within", "contains", "section", "quote", "list", "and", "or", "nor"] if depth else []))
        if op in ("contains_text", "equals_text"):
            arg = rng.choice(["alpha", "goals", "a", "TODO"])
        elif op == "matches":
            arg = rng.choice(["^[A-Z]", r"\d+", "a$"])
        elif op == "references":
            arg = rng.choice(["a", "b"])
        elif op in ("and", "or", "nor"):
            arg = tuple(predicate(rng, depth - 1) for _ in range(rng.choice([1, 2])))
        else:
            arg = predicate(rng, depth - 1) if depth else ()
        tests.append(ir.BlockTest(op, arg, rng.choice(["header", "paragraph", "item", "code", "table", "ref"]) if op == "kind" else None))
    return tuple(tests)


@pytest.mark.parametrize("seed", range(2))
def test_block_predicates(spark, seed):
    rng = random.Random(seed)
    texts = [document(rng) for _ in range(25)]
    c = files.from_markdown(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, content string"))
    docs = c.documents.select("key", "blocks").cache()
    tests = [predicate(rng) for _ in range(20)]
    rows = docs.select("key", *[F.transform(blocks.selected(t, F.col("blocks")), lambda b: b["pos"]).alias(f"t{i}") for i, t in enumerate(tests)]).collect()
    for r in rows:
        index = Index(markdown.parse(texts[int(r["key"])]))
        for i, t in enumerate(tests):
            assert sorted(r[f"t{i}"]) == sorted(index.select(t)), (t, texts[int(r["key"])])


@pytest.mark.parametrize("seed", range(4))
def test_normal_form_is_stable_and_edits_keep_it(seed):
    rng = random.Random(100 + seed)
    for _ in range(60):
        text = document(rng)
        once = markdown.normalise(text)
        assert markdown.normalise(once) == once
        plan = edits.plan_document("k", text, (), (ir.BlockEdit("delete", predicate(rng)),))
        if not plan.problems:
            assert markdown.normalise(plan.content) == plan.content


def reach(edges, start, high):
    seen, front, depth = {start: 0}, [start], 0
    while front and depth < high:
        depth += 1
        front = [b for a in front for x, b in edges if x == a and b not in seen and not seen.__setitem__(b, depth)]
    return {k: d for k, d in seen.items() if d}


@pytest.mark.parametrize("seed", range(3))
def test_relations(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    edges = {(rng.choice(names), rng.choice([*names, "gone"])) for _ in range(22)}
    docs = sources.documents(spark.createDataFrame([(n, i % 3) for i, n in enumerate(names)], "k string, g int"), F.col("k"), F.to_json(F.struct("g")))
    table = sources.edges(spark.createDataFrame(sorted(edges), "s string, d string"), F.col("s"), F.col("d"))
    c = sources.Corpus(docs, table, sources.no_edges(spark))
    back = {(b, a) for a, b in edges}
    group = {n: i % 3 for i, n in enumerate(names)}
    for _ in range(5):
        low, high = rng.choice([(1, 1), (1, 3), (2, 3), (1, 99), (2, 99)])
        kind, g = rng.choice(["includes", "includedBy"]), rng.randrange(3)
        anchors = [n for n in names if group[n] == g]
        relation = ir.Relation(kind, ir.FieldTest(("g",), "eq", g), low, ir.UNBOUNDED if high == 99 else high)
        got = sorted(r["key"] for r in graph.related(c, relation, plans.matching_keys(c, relation.match)).collect())
        away = edges if kind == "includedBy" else back
        want = {k for a in anchors for k, d in reach(away, a, high).items() if d >= low} - set(anchors)
        assert got == sorted(want)
        counted = {r["key"]: r["n"] for r in graph.related_counts(c, relation, c.documents, plans.matching_keys(c, relation.match)).collect()}
        own = edges if kind == "includes" else back
        sized = ir.Relation(kind, relation.match, low, relation.high, ir.CountTest((rng.choice([("eq", 0), ("gte", 1), ("lt", 3), ("ne", 2)]),)))
        some = sorted(r["key"] for r in plans.select(c, sized).collect())
        assert some == sorted(n for n in names if sized.size.holds(counted[n]))
        assert counted == {n: sum(d >= low and k != n and group.get(k) == g for k, d in reach(own, n, high).items()) for n in names}


def test_expressions_with_the_parser(spark):
    c = files.from_literal(spark, "# A\n\n## B\n\ntext\n_\n# C\n")
    rows = plans.find(c, "project: {key: $key, here: {$blocks: {$within: {}}}}").collect()
    assert [[b["type"] for b in r["here"]] for r in rows] == [["header", "paragraph"], []]
    assert parse.parse_blocks({}, "x") == ()


def test_ranks_and_sums(spark):
    from quillon.plans.ranking import ranked, running, tied

    rng = random.Random(3)
    values = [rng.randrange(12) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(5)
    order = sorted(range(200), key=lambda i: (-values[i], i))
    got = {r["i"]: r["rank"] for r in ranked(df, [F.desc("v"), F.asc("i")]).collect()}
    assert got == {i: n + 1 for n, i in enumerate(order)}
    assert {r["i"]: r["rank"] for r in tied(df, "v").collect()} == {i: 1 + sum(x > values[i] for x in values) for i in range(200)}
    sums, total = {}, 0
    for i in order:
        total += values[i]
        sums[i] = total
    assert {r["i"]: r["total"] for r in running(df, [F.desc("v"), F.asc("i")], "v").collect()} == sums
