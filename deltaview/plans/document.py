"""Plan documents: YAML to dataclasses.

    keys:   {public.users: [id]}
    tables: {public.users: [{type: select, columns: [id, name]}, ...]}
    sink:   {type: console}
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import yaml

from deltaview.functions.values import CAST_TYPES
from deltaview.plans import mapexpr, predicates


class PlanError(ValueError):
    """A plan that cannot be run."""


@dataclass(frozen=True)
class Select:
    columns: tuple[str, ...]

    def __str__(self) -> str:
        return f"select [{', '.join(self.columns)}]"


@dataclass(frozen=True)
class Rename:
    names: dict[str, str]

    def __str__(self) -> str:
        return "rename {" + ", ".join(f"{a}->{b}" for a, b in self.names.items()) + "}"


@dataclass(frozen=True)
class Cast:
    column: str
    to: str

    def __str__(self) -> str:
        return f"cast {self.column} -> {self.to}"


@dataclass(frozen=True)
class Map:
    column: str
    expr: mapexpr.Node
    text: str

    def __str__(self) -> str:
        return f"map {self.column} = {self.text}"


@dataclass(frozen=True)
class Redact:
    columns: tuple[str, ...]

    def __str__(self) -> str:
        return f"redact [{', '.join(self.columns)}]"


@dataclass(frozen=True)
class Filter:
    predicate: predicates.Predicate

    def __str__(self) -> str:
        return f"filter {self.predicate}"


Operator = Select | Rename | Cast | Map | Redact | Filter


@dataclass
class Plan:
    tables: dict[str, list[Operator]] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)
    sink: dict[str, Any] | None = None

    @staticmethod
    def parse(text: str) -> Plan:
        try:
            doc = yaml.safe_load(text) or {}
        except yaml.YAMLError as e:
            raise PlanError(f"not YAML: {e}") from e
        if not isinstance(doc, dict):
            raise PlanError("a plan is a mapping")
        if unknown := set(doc) - {"tables", "keys", "sink"}:
            raise PlanError(f"unknown sections: {', '.join(sorted(unknown))}")
        tables = {t: [operator(o, f"{t}[{i}]") for i, o in enumerate(ops or [])] for t, ops in (doc.get("tables") or {}).items()}
        return Plan(tables, {t: list(k) for t, k in (doc.get("keys") or {}).items()}, doc.get("sink"))

    @staticmethod
    def load(path: str) -> Plan:
        with open(path, encoding="utf-8") as f:
            return Plan.parse(f.read())


def operator(spec: dict[str, Any], where: str) -> Operator:
    """One operator from its mapping; errors name its place."""
    try:
        kind = spec["type"]
        if kind == "select":
            return Select(tuple(spec["columns"]))
        if kind == "rename":
            names = dict(spec["from"])
            if len(set(names.values())) < len(names):
                raise PlanError(f"{where}: two columns get one name")
            return Rename(names)
        if kind == "cast":
            if spec["to"] not in CAST_TYPES:
                raise PlanError(f"{where}: unknown cast target {spec['to']!r}")
            return Cast(spec["column"], spec["to"])
        if kind == "map":
            return Map(spec["column"], mapexpr.parse(spec["expr"]), spec["expr"])
        if kind == "redact":
            return Redact(tuple(spec["columns"]))
        if kind == "filter":
            return Filter(predicates.parse({k: v for k, v in spec.items() if k != "type"}))
    except PlanError:
        raise
    except (KeyError, TypeError, ValueError) as e:
        raise PlanError(f"{where}: {e!r}") from e
    raise PlanError(f"{where}: unknown operator {kind!r}")
