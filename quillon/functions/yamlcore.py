"""YAML by the core schema: no dates, no sexagesimals, no yes/no; plus JSON that keeps its meaning."""

from __future__ import annotations

import json
import math
import re
from typing import Any

import yaml


class CoreLoader(yaml.SafeLoader):
    """Scalars are null, true/false, int, float or string, nothing else."""


CoreLoader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+0123456789.")),
):
    CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)


def _int(loader: yaml.Loader, node: yaml.ScalarNode) -> int:
    text = loader.construct_scalar(node)
    return int(text, 0) if text[:2] in ("0o", "0x") else int(text)


def _float(loader: yaml.Loader, node: yaml.ScalarNode) -> float:
    return float(loader.construct_scalar(node).replace(".inf", "inf").replace(".Inf", "inf").replace(".INF", "inf").replace(".nan", "nan").replace(".NaN", "nan").replace(".NAN", "nan"))


def _mapping(loader: yaml.Loader, node: yaml.MappingNode) -> dict:
    out: dict = {}
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        if not isinstance(key, (str, int, float, bool, type(None))):
            raise yaml.YAMLError("a mapping key must be a scalar")
        if key in out:
            raise yaml.YAMLError(f"duplicate key {key!r}")
        out[key] = loader.construct_object(v, deep=True)
    return out


def _tagged(loader: yaml.Loader, suffix: str, node: yaml.Node) -> dict:
    if isinstance(node, yaml.MappingNode):
        value: Any = _mapping(loader, node)
    elif isinstance(node, yaml.SequenceNode):
        value = loader.construct_sequence(node, deep=True)
    else:
        value = loader.construct_scalar(node)
    return {"$tag": suffix, "value": value}


CoreLoader.add_constructor("tag:yaml.org,2002:int", _int)
CoreLoader.add_constructor("tag:yaml.org,2002:float", _float)
CoreLoader.add_constructor("tag:yaml.org,2002:map", _mapping)
CoreLoader.add_multi_constructor("!", _tagged)


def loads(text: str) -> Any:
    return yaml.load(text, CoreLoader)  # noqa: S506  derived from SafeLoader


class _Dumper(yaml.SafeDumper):
    def ignore_aliases(self, data) -> bool:
        return True


def _represent(dumper: yaml.Dumper, text: str) -> yaml.Node:
    plain = CoreLoader("").resolve(yaml.ScalarNode, text, (True, False)) == "tag:yaml.org,2002:str"
    return dumper.represent_scalar("tag:yaml.org,2002:str", text, style=None if plain else "'")


_Dumper.add_representer(str, _represent)
_Dumper.yaml_implicit_resolvers = CoreLoader.yaml_implicit_resolvers


def dumps(value: Any) -> str:
    return yaml.dump(value, Dumper=_Dumper, sort_keys=False, allow_unicode=True, default_flow_style=False, width=10**9)


def plain(value: Any) -> Any:
    """The value with JSON's types only; numbers that are equal get one form."""
    if isinstance(value, dict):
        return {k if isinstance(k, str) else json.dumps(k): plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, float):
        if not math.isfinite(value):
            return {"$float": str(value)}
        if value.is_integer() and abs(value) < 2**53:
            return int(value)
    return value


def to_json(value: Any) -> str:
    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))
