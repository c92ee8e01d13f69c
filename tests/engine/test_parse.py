"""Operation documents: what is accepted and the code of each mistake."""

import pytest

from quillon.functions import yamlcore
from quillon.plans import ir, parse
from quillon.plans.parse import QueryError

BAD = [
    ("find", "update: {$set: {a: 1}}", "OperationFieldNotAllowed"),
    ("find", "expect: 1", "OperationFieldNotAllowed"),
    ("count", "project: {a: 1}", "OperationFieldNotAllowed"),
    ("count", "search: {lexical: a}", "OperationFieldNotAllowed"),
    ("update", "update: {$set: {a: 1}}", "MissingRequiredField"),
    ("update", "filter: {}", "MissingRequiredField"),
    ("delete", "limit: 1", "MissingRequiredField"),
    ("find", "filters: {}", "Wire"),
    ("find", "[", "Wire"),
    ("find", "{project: {a: 1}, addFields: {b: 1}}", "ProjectAddFieldsConflict"),
    ("find", "filter: {a: {$gt: 1, b: 2}}", "MixedDollarAndBare"),
    ("find", "filter: {$not: {a: 1}}", "TopLevelNotNotSupported"),
    ("find", "filter: {$foo: 1}", "UnknownOperator"),
    ("find", "filter: {a: {$foo: 1}}", "UnknownOperator"),
    ("find", "filter: {$and: []}", "EmptyOperatorList"),
    ("find", "filter: {$or: {a: 1}}", "OperatorExpectedList"),
    ("find", "filter: {$nor: [1]}", "OperatorExpectedMapping"),
    ("find", "filter: {a: {$in: []}}", "EmptyOperatorList"),
    ("find", "filter: {a: {$all: 1}}", "OperatorExpectedList"),
    ("find", "filter: {a: {$exists: 1}}", "OperatorExpectedBool"),
    ("find", "filter: {a: {$type: nope}}", "UnknownTypeName"),
    ("find", "filter: {a: {$type: null}}", "TypeBareYamlNull"),
    ("find", "filter: {a: {$type: 1}}", "OperatorExpectedString"),
    ("find", "filter: {a: {$type: []}}", "EmptyOperatorList"),
    ("find", "filter: {a: {$size: -1}}", "OperatorExpectedNonNegativeInt"),
    ("find", "filter: {a: {$size: 1.5}}", "OperatorExpectedInteger"),
    ("find", "filter: {a: {$size: {}}}", "InvalidCountPredicate"),
    ("find", "filter: {a: {$size: x}}", "InvalidCountPredicate"),
    ("find", "filter: {a: {$not: {}}}", "OperatorExpectedMapping"),
    ("find", "filter: {a: {$not: {b: 1}}}", "MixedDollarAndBare"),
    ("find", "filter: {1: 2}", "NonStringKey"),
    ("find", "filter: {a..b: 2}", "InvalidPathSegment"),
    ("find", "filter: {'a b': 2}", "InvalidPathSegment"),
    ("find", "filter: {$key: {$gt: a}}", "UnknownOperator"),
    ("find", "filter: {$key: {$eq: a, $ne: b}}", "KeyOpForbidden"),
    ("find", "filter: {$key: [a]}", "GraphOpExpectedScalarOrMapping"),
    ("find", "filter: {$key: {$in: []}}", "EmptyOperatorList"),
    ("find", "filter: {$includedBy: [a]}", "ArrayFormRemoved"),
    ("find", "filter: {$includedBy: 3}", "GraphOpExpectedScalarOrMapping"),
    ("find", "filter: {$includedBy: {}}", "EmptyAnchorMapping"),
    ("find", "filter: {$includedBy: {maxDistance: 1}}", "WrongBoundFamily"),
    ("find", "filter: {$references: {minDepth: 1}}", "WrongBoundFamily"),
    ("find", "filter: {$includes: {minDepth: 3, maxDepth: 2}}", "DepthRangeInverted"),
    ("find", "filter: {$includes: {maxDepth: -1}}", "InvalidDepthValue"),
    ("find", "filter: {$includes: {minDepth: 0}}", "InvalidDepthValue"),
    ("find", "filter: {$content: {$nope: 1}}", "UnknownBlockOperator"),
    ("find", "filter: {$content: {text: 1}}", "BareKeyInBlockPredicate"),
    ("find", "filter: {$content: {$ref: a}}", "BlockScalarNotAllowed"),
    ("find", "filter: {$content: {$hr: {$text: a}}}", "BlockTextPredicateNotAllowed"),
    ("find", "filter: {$content: {$list: {$and: [{$matches: a}]}}}", "BlockTextPredicateNotAllowed"),
    ("find", "filter: {$content: {$within: {$text: a}}}", "WithinArgumentWithoutContents"),
    ("find", "filter: {$content: {$within: {$or: [{$section: a}, {$text: b}]}}}", "WithinArgumentWithoutContents"),
    ("find", "filter: {$content: {$matches: '('}}", "InvalidRegex"),
    ("find", "filter: {$content: {$matches: 'a(?=b)'}}", "InvalidRegex"),
    ("find", "filter: {$content: {$matches: '(a)\\1'}}", "InvalidRegex"),
    ("find", "filter: {$content: {$text: {$eq: 1}}}", "OperatorExpectedString"),
    ("find", "project: {a: 2}", "InvalidProjectionValue"),
    ("find", "project: {a: $nope}", "UnknownProjectionSource"),
    ("find", "project: {a.b: 1}", "NestedProjectionOutput"),
    ("find", "project: {_a: 1}", "ReservedOutputName"),
    ("find", "addFields: {$header: {}}", "ReservedOutputName"),
    ("find", "project: {a: {$matches: {$header: {}}}}", "MatchesPatternMissing"),
    ("find", "project: {$blocks: {}}", "UnknownBlockOperator"),
    ("find", "sort: {}", "EmptySort"),
    ("find", "sort: {a: 1, b: 1}", "MultiKeySortNotSupportedV1"),
    ("find", "sort: {a: 2}", "InvalidSortValue"),
    ("find", "sort: {a: up}", "InvalidSortValue"),
    ("find", "limit: -1", "NegativeLimit"),
    ("find", "search: {}", "EmptySearch"),
    ("find", "search: {vector: a}", "Wire"),
    ("update", "{filter: {}, update: {}}", "EmptyUpdate"),
    ("update", "{filter: {}, update: {$inc: {a: 1}}}", "UnknownUpdateOperator"),
    ("update", "{filter: {}, update: {$set: {}}}", "EmptyUpdateOperator"),
    ("update", "{filter: {}, update: {$set: 1}}", "UpdateOperatorExpectedMapping"),
    ("update", "{filter: {}, update: {$set: {_a: 1}}}", "ReservedPrefixField"),
    ("update", "{filter: {}, update: {$set: {a: {$b: 1}}}}", "ReservedPrefixField"),
    ("update", "{filter: {}, update: {$set: {a: 1, a.b: 2}}}", "SetUnsetConflict"),
    ("update", "{filter: {}, update: {$set: {a: 1}, $unset: {a: 1}}}", "SetUnsetConflict"),
    ("update", "{filter: {}, update: {$replace: {to: a}}}", "UnknownBlockPayloadKey"),
    ("update", "{filter: {}, update: {$replace: {$text: a}}}", "MissingBlockPayload"),
    ("update", "{filter: {}, update: {$append: {content: 1}}}", "BlockPayloadExpectedString"),
    ("update", "{filter: {}, update: {$delete: {expect: {min: 3, max: 1}}}}", "InvalidExpect"),
    ("update", "{filter: {}, update: {$set: {a: 1}}, expect: -1}", "InvalidExpect"),
]


@pytest.mark.parametrize("kind,text,code", BAD)
def test_mistakes(kind, text, code):
    with pytest.raises(QueryError) as e:
        parse.parse(text, kind)
    assert e.value.code == code


def test_meanings():
    f = parse.parse_filter_expression
    assert f("status: draft") == ir.FieldTest(("status",), "eq", "draft")
    assert f("a.b: {c: {$gt: 1}}") == ir.FieldTest(("a", "b", "c"), "gt", 1)
    assert f("{}") == ir.All(())
    assert f("$includedBy: {match: {$key: a}, maxDepth: 0}") == ir.Relation("includedBy", ir.KeyTest("eq", ("a",)), 1, ir.UNBOUNDED)
    assert f("$references: a").high == 1
    assert parse.parse("limit: 0").limit == 0
    p = parse.parse("project: {$header: {}}").project
    assert [n for n, _ in p.fields] == ["key", "content"]
    assert parse.parse_projection_expression("title,author, body=$content, x=a.b").fields[3] == ("x", ir.Source("field", ("a", "b")))
    assert parse.parse_sort_argument("a.b:-1") == ir.Sort(("a", "b"), True)
    assert parse.unguarded(parse.parse("{filter: {}, update: {$delete: {}}}", "update")) == ["expect", "$delete.expect"]


def test_core_yaml():
    assert yamlcore.loads("{a: 2026-01-01, b: yes, c: 012, d: 1e3, e: ~, f: 0x1F, g: .5, h: true}") == {"a": "2026-01-01", "b": "yes", "c": 12, "d": 1000.0, "e": None, "f": 31, "g": 0.5, "h": True}
    value = {"s": "true", "n": "1", "d": "2026-01-01", "t": "a: b", "l": [1, {"x": None}], "e": ""}
    assert yamlcore.loads(yamlcore.dumps(value)) == value
