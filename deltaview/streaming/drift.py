"""Watches relations for changes of their definition, across restarts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from deltaview.sources.pgoutput import Relation


@dataclass(frozen=True)
class Drift:
    relation_id: int
    table: str
    kind: str
    column: str | None = None
    old_oid: int | None = None
    new_oid: int | None = None


class DriftDetector:
    """One drift per observation at most: a new relation, else the first column added, or
    removed, or of another type."""

    def __init__(self, state: str = "{}"):
        self.known: dict[int, dict[str, int]] = {int(k): dict(v) for k, v in json.loads(state).items()}

    def state(self) -> str:
        return json.dumps({k: list(v.items()) for k, v in self.known.items()})

    def observe(self, relation: Relation) -> Drift | None:
        new = {c.name: c.type_oid for c in relation.columns}
        old = self.known.get(relation.relation_id)
        self.known[relation.relation_id] = new
        found = lambda *x: Drift(relation.relation_id, f"{relation.namespace}.{relation.name}", *x)
        if old is None:
            return found("new_relation")
        for name in new:
            if name not in old:
                return found("column_added", name)
        for name in old:
            if name not in new:
                return found("column_removed", name)
        for name, oid in new.items():
            if old[name] != oid:
                return found("type_changed", name, old[name], oid)
        return None
