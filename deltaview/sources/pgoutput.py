"""Logical-replication messages to changes, in plain Python: bytes in, dictionaries out.

All integers are big-endian and strings end with a zero byte. The layout of relation and
truncate messages is the server's (`protocol`), or one without the replica identity and the
type modifiers (`compact`).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any


class DecodeError(ValueError):
    """A message that is cut off or not understood."""


@dataclass(frozen=True)
class Column:
    name: str
    type_oid: int
    flags: int = 0


@dataclass(frozen=True)
class Relation:
    relation_id: int
    namespace: str
    name: str
    columns: tuple[Column, ...]


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise DecodeError(f"message ends at byte {len(self.data)}, {n} more wanted at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(f">{kind}", self.take(struct.calcsize(f">{kind}")))[0]

    def string(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise DecodeError(f"string without end at {self.at}")
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out


#: Values of a tuple: text, None, or this where the source did not send it.
UNCHANGED = object()


@dataclass
class Decoder:
    """Decodes messages one by one, and remembers relations."""

    layout: str = "protocol"
    relations: dict[int, Relation] = field(default_factory=dict)

    def decode(self, data: bytes) -> Relation | list[dict[str, Any]] | None:
        """A relation, the changes of a row message, or None for no bytes."""
        if not data:
            return None
        cur = _Cursor(data)
        tag = cur.take(1)
        read = {b"R": self._relation, b"I": self._insert, b"U": self._update, b"D": self._delete, b"T": self._truncate}.get(tag)
        if read is None:
            raise DecodeError(f"unknown message {tag!r}")
        return read(cur)

    def _relation(self, cur: _Cursor) -> Relation:
        relation_id, namespace, name = cur.number("I"), cur.string(), cur.string()
        if self.layout == "protocol":
            cur.take(1)
        columns = []
        for _ in range(cur.number("H")):
            flags, column, oid = cur.number("B"), cur.string(), cur.number("I")
            if self.layout == "protocol":
                cur.take(4)
            columns.append(Column(column, oid, flags))
        self.relations[relation_id] = out = Relation(relation_id, namespace, name, tuple(columns))
        return out

    def _known(self, cur: _Cursor) -> Relation:
        relation_id = cur.number("I")
        if relation_id not in self.relations:
            raise DecodeError(f"unknown relation {relation_id}")
        return self.relations[relation_id]

    def _image(self, cur: _Cursor, relation: Relation) -> dict[str, Any]:
        """Column to text, None or UNCHANGED; what a tuple leaves out at its end was not sent."""
        out: dict[str, Any] = {c.name: UNCHANGED for c in relation.columns}
        for i in range(cur.number("H")):
            if cur.at == len(cur.data):
                break
            kind = cur.take(1)
            if kind == b"n":
                value: Any = None
            elif kind == b"u":
                value = UNCHANGED
            elif kind == b"t":
                value = cur.take(cur.number("I")).decode("utf-8", "replace")
            else:
                raise DecodeError(f"unknown value kind {kind!r}")
            if i < len(relation.columns):
                out[relation.columns[i].name] = value
        return out

    def _expect(self, cur: _Cursor, tags: bytes) -> bytes:
        tag = cur.take(1)
        if tag not in [bytes([t]) for t in tags]:
            raise DecodeError(f"{tag!r} where one of {tags!r} belongs")
        return tag

    def _change(self, relation: Relation, op: str, before: dict | None, after: dict | None) -> list[dict[str, Any]]:
        plain = lambda image: image and {k: None if v is UNCHANGED else v for k, v in image.items()}
        unsent = [k for k, v in (after or {}).items() if v is UNCHANGED]
        return [{"relation_id": relation.relation_id, "namespace": relation.namespace, "table": relation.name, "op": op, "before": plain(before), "after": plain(after), "unchanged": unsent}]

    def _insert(self, cur: _Cursor) -> list[dict[str, Any]]:
        relation = self._known(cur)
        self._expect(cur, b"N")
        return self._change(relation, "I", None, self._image(cur, relation))

    def _update(self, cur: _Cursor) -> list[dict[str, Any]]:
        relation, before = self._known(cur), None
        if self._expect(cur, b"KON") != b"N":
            before = self._image(cur, relation)
            self._expect(cur, b"N")
        return self._change(relation, "U", before, self._image(cur, relation))

    def _delete(self, cur: _Cursor) -> list[dict[str, Any]]:
        relation = self._known(cur)
        self._expect(cur, b"KO")
        return self._change(relation, "D", self._image(cur, relation), None)

    def _truncate(self, cur: _Cursor) -> list[dict[str, Any]]:
        count, _ = cur.number("I"), cur.number("B")
        ids = [cur.number("I") for _ in range(count)]
        return [c for i in ids if i in self.relations for c in self._change(self.relations[i], "T", None, None)]


#: Kinds of events that move the position and no data.
HEARTBEATS = ("heartbeat", "keepalive")


def transactions(events: Iterator[tuple[str, int, bytes]], decoder: Decoder, control: bool = False) -> Iterator[tuple[int, list[dict[str, Any]]]]:
    """(commit_lsn, changes) of (kind, lsn, payload) events: begin, data, commit, and others that
    are passed over. Data outside a transaction is dropped, as are transactions without changes.

    With `control`, relations come as entries of op "R" (columns as "name:oid" in `unchanged`) in
    the transaction that they were defined in or before, and heartbeats between transactions
    as one entry of op "H" at their position.
    """
    buffer: list[dict[str, Any]] | None = None
    defined: list[dict[str, Any]] = []
    entry = {"relation_id": None, "namespace": None, "table": None, "before": None, "after": None, "unchanged": [], "index_in_txn": -1}
    for kind, lsn, payload in events:
        if kind == "begin":
            buffer = []
        elif kind == "data" and payload:
            found = decoder.decode(payload)
            if isinstance(found, list) and buffer is not None:
                for change in found:
                    buffer.append(change | {"lsn": lsn, "index_in_txn": len(buffer)})
            elif isinstance(found, Relation):
                defined.append(entry | {"op": "R", "lsn": lsn, "relation_id": found.relation_id, "namespace": found.namespace, "table": found.name, "unchanged": [f"{c.name}:{c.type_oid}" for c in found.columns]})
        elif kind == "commit":
            own = [*(defined if control else ()), *(buffer or ())]
            if own:
                yield lsn, own
            buffer, defined = None, []
        elif kind in HEARTBEATS and buffer is None and control:
            yield lsn, [entry | {"op": "H", "lsn": lsn}]
