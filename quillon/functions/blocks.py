"""Block predicates as columns over a document's array of blocks.

A block is a struct with its place in pre-order (pos), the last place of its subtree (end_pos), kind,
own_text, path and link targets; being inside another block is then a comparison of places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import ir
from .text import java_regex

BLOCK = "struct<pos:int,parent:int,end_pos:int,depth:int,kind:string,own_text:string,path:array<string>,ref_targets:array<string>,ref_target:string,plain_text:string,ordered:boolean,lang:string>"


def _false(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def holds(tests: tuple[ir.BlockTest, ...], blocks: Column, b: Column) -> Column:
    """Whether block ``b`` of ``blocks`` passes every test."""
    return reduce(lambda x, y: x & y, [_one(t, blocks, b) for t in tests], F.lit(True))


def _inside(b: Column, root: Column, itself: bool) -> Column:
    low = b["pos"] >= root["pos"] if itself else b["pos"] > root["pos"]
    return low & (b["pos"] <= root["end_pos"])


def _one(test: ir.BlockTest, blocks: Column, b: Column) -> Column:
    own = b["own_text"]
    if test.op == "contains_text":
        return _false(F.contains(F.lower(own), F.lower(F.lit(test.arg))))
    if test.op == "equals_text":
        return _false(F.lower(own) == F.lower(F.lit(test.arg)))
    if test.op == "matches":
        return _false(own.rlike(java_regex(test.arg)))
    if test.op == "kind":
        return (b["kind"] == test.kind) & holds(test.arg, blocks, b)
    if test.op in ("section", "quote", "list"):
        kind = "header" if test.op == "section" else test.op
        return F.exists(blocks, lambda r: (r["kind"] == kind) & _inside(b, r, True) & holds(test.arg, blocks, r))
    if test.op == "within":
        return holds(test.arg, blocks, b) & F.exists(blocks, lambda a: _inside(b, a, False) & holds(test.arg, blocks, a))
    if test.op == "contains":
        return F.exists(blocks, lambda d: _inside(d, b, False) & holds(test.arg, blocks, d))
    if test.op == "references":
        return _false(F.array_contains(b["ref_targets"], test.arg))
    parts = [holds(p, blocks, b) for p in test.arg]
    if test.op == "and":
        return reduce(lambda x, y: x & y, parts)
    either = reduce(lambda x, y: x | y, parts)
    return either if test.op == "or" else ~either


def any_block(tests: tuple[ir.BlockTest, ...], blocks: Column) -> Column:
    return _false(F.exists(blocks, lambda b: holds(tests, blocks, b)))


def selected(tests: tuple[ir.BlockTest, ...], blocks: Column) -> Column:
    return F.filter(blocks, lambda b: holds(tests, blocks, b))


def entries(tests: tuple[ir.BlockTest, ...], blocks: Column) -> Column:
    """array<struct<type, path, target, text>> of the selected blocks, in document order."""
    made = F.transform(selected(tests, blocks), lambda b: F.struct(b["kind"].alias("type"), b["path"].alias("path"), b["ref_target"].alias("target"), F.coalesce(b["own_text"], F.lit("")).alias("text")))
    return F.coalesce(made, F.array().cast("array<struct<type:string,path:array<string>,target:string,text:string>>"))


def grep(tests: tuple[ir.BlockTest, ...], pattern: str, blocks: Column) -> Column:
    """array<struct<path, text>>: each line of the selected blocks' own text that the pattern finds."""
    lines = F.flatten(F.transform(selected(tests, blocks), lambda b: F.transform(F.filter(F.split(F.coalesce(F.regexp_replace(b["own_text"], "\n$", ""), F.lit("")), "\n"), lambda t: b["own_text"].isNotNull() & t.rlike(java_regex(pattern))), lambda t: F.struct(b["path"].alias("path"), t.alias("text")))))
    return F.coalesce(lines, F.array().cast("array<struct<path:array<string>,text:string>>"))
