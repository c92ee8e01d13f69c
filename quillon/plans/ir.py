"""The typed form of operation documents."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

UNBOUNDED = 2**32 - 1


@dataclass(frozen=True)
class FieldTest:
    """``op`` on the value at ``path``; ``arg`` is a literal, a list, a CountTest or a list of tests (not)."""

    path: tuple[str, ...]
    op: str
    arg: Any


@dataclass(frozen=True)
class KeyTest:
    op: str  # eq ne in nin
    keys: tuple[str, ...]


@dataclass(frozen=True)
class CountTest:
    """All comparisons (op, n) must hold."""

    comparisons: tuple[tuple[str, int], ...]

    def holds(self, n: int) -> bool:
        return all({"eq": n == m, "ne": n != m, "gt": n > m, "gte": n >= m, "lt": n < m, "lte": n <= m}[op] for op, m in self.comparisons)


@dataclass(frozen=True)
class Relation:
    """A walk over edges: kind is includes, includedBy, references or referencedBy."""

    kind: str
    match: Any
    low: int = 1
    high: int = 1
    size: CountTest | None = None


@dataclass(frozen=True)
class Content:
    predicate: Any


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


@dataclass(frozen=True)
class NoneOf:
    parts: tuple


# block predicates: a predicate is a tuple of tests, all of which must hold


@dataclass(frozen=True)
class BlockTest:
    """op: contains_text equals_text matches within contains section quote list kind references and or nor."""

    op: str
    arg: Any
    kind: str | None = None


@dataclass(frozen=True)
class Source:
    """Where an output field comes from: field, pseudo, content, blocks or matches."""

    kind: str
    arg: Any = None
    pattern: str | None = None


@dataclass(frozen=True)
class Projection:
    fields: tuple[tuple[str, Source], ...]
    base: str  # empty, document or frontmatter


@dataclass(frozen=True)
class Sort:
    path: tuple[str, ...]
    descending: bool


@dataclass(frozen=True)
class Search:
    lexical: str | None = None
    fuzzy: str | None = None


@dataclass(frozen=True)
class Expect:
    low: int | None
    high: int | None

    def holds(self, n: int) -> bool:
        return (self.low is None or n >= self.low) and (self.high is None or n <= self.high)

    def __str__(self) -> str:
        if self.low == self.high:
            return str(self.low)
        return " and ".join(x for x in (f"at least {self.low}" if self.low is not None else "", f"at most {self.high}" if self.high is not None else "") if x)


@dataclass(frozen=True)
class FieldEdit:
    op: str  # set or unset
    path: tuple[str, ...]
    value: Any = None


@dataclass(frozen=True)
class BlockEdit:
    op: str  # replace replaceText insertBefore insertAfter append delete
    select: tuple
    content: str | None = None
    old: str | None = None
    new: str | None = None
    expect: Expect | None = None


@dataclass(frozen=True)
class Operation:
    kind: str  # find count update delete
    filter: Any = None
    search: Search | None = None
    project: Projection | None = None
    sort: Sort | None = None
    limit: int = 0
    field_edits: tuple[FieldEdit, ...] = ()
    block_edits: tuple[BlockEdit, ...] = ()
    expect: Expect | None = None


@dataclass
class Find:
    """Fluent builder: ``Find().where(field("status") == "draft").order_by("n", -1).limit(5)``."""

    operation: Operation = field(default_factory=lambda: Operation("find", project=Projection((), "frontmatter")))

    def _with(self, **changes) -> Find:
        return Find(Operation(**(self.operation.__dict__ | changes)))

    def where(self, *tests) -> Find:
        kept = (self.operation.filter,) if self.operation.filter is not None else ()
        parts = kept + tests
        return self._with(filter=parts[0] if len(parts) == 1 else All(parts))

    def order_by(self, path: str, direction: int = 1) -> Find:
        return self._with(sort=Sort(tuple(path.split(".")), direction < 0))

    def limit(self, n: int) -> Find:
        return self._with(limit=n)

    def search(self, lexical: str | None = None, fuzzy: str | None = None) -> Find:
        return self._with(search=Search(lexical, fuzzy))

    def project(self, **fields: Source) -> Find:
        return self._with(project=Projection(tuple(fields.items()), "empty"))


class field_:
    """Comparisons on a frontmatter field, for ``Find.where``."""

    def __init__(self, path: str):
        self.path = tuple(path.split("."))

    def _test(self, op: str, arg) -> FieldTest:
        return FieldTest(self.path, op, arg)

    def __eq__(self, other):  # type: ignore[override]
        return self._test("eq", other)

    def __ne__(self, other):  # type: ignore[override]
        return self._test("ne", other)

    def __gt__(self, other):
        return self._test("gt", other)

    def __ge__(self, other):
        return self._test("gte", other)

    def __lt__(self, other):
        return self._test("lt", other)

    def __le__(self, other):
        return self._test("lte", other)

    def isin(self, *values):
        return self._test("in", tuple(values))

    def exists(self, there: bool = True):
        return self._test("exists", there)

    __hash__ = None  # type: ignore[assignment]
