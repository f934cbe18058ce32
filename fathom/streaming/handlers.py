"""Mutations that follow events."""

from __future__ import annotations

import json
from itertools import islice
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..lang import ast, bind

if TYPE_CHECKING:
    from ..engine import Engine

#: Events whose actions are one commit.
BATCH = 1000
_KINDS = {"insert": "Insert", "update": "Update", "delete": "Delete"}


class Handlers:
    """Handlers by name: on "insert orders" or the like, a mutation that may use $_id and $_field for each field of the row.

    Triggers other than insert, update and delete match nothing.
    """

    def __init__(self, engine: Engine):
        self.engine = engine
        self.by_name: dict[str, tuple[str | None, str, ast.Field]] = {}

    def define(self, h: ast.Handler) -> None:
        word, _, collection = h.on.partition(" ")
        if not word:
            raise ValidationError("a handler needs a trigger")
        self.by_name[h.name] = (_KINDS.get(word.lower()), collection.strip(), h.action)

    def apply(self, batch: DataFrame) -> int:
        """Runs the actions of a batch of events in their order; of each handler BATCH of them are one commit, and insertions in a row one mutation."""
        done = 0
        for kind, collection, action in self.by_name.values():
            if kind is None:
                continue
            hit = batch.filter((F.col("change_type") == kind) & ((F.col("collection") == collection) | F.lit(collection in ("", "*"))))
            events = hit.orderBy("seq", "sid").toLocalIterator()
            while some := list(islice(events, BATCH)):
                self._run(action, some)
                done += len(some)
        return done

    def _run(self, action: ast.Field, events: list) -> None:
        from ..engine import Options, Transaction

        tx = Transaction(self.engine)
        rows: list = []
        held: tuple[ast.Field, Any] | None = None

        def flush() -> None:
            if rows and held is not None:
                f, flat = held
                bind.authorize(f.directives, {}, None, set(), "write")
                self.engine._insert(tx, f, str(f.args["collection"]), list(rows), flat, Options())
                rows.clear()

        for e in events:
            document = json.loads(e["document"] or e["old_document"] or "{}")
            given = {"_id": e["sid"], **{f"_{k}": v for k, v in document.items()}}
            flat = lambda s, on, given=given: bind.flatten(s, {}, given, on, lambda _: True)
            for f in bind.flatten([action], {}, given, None, lambda _: True):
                if f.name in ("insert", "insertInto") and isinstance(f.args.get("data"), dict) and "collection" in f.args:
                    held = f, flat
                    rows.append(f.args["data"])
                else:
                    flush()
                    self.engine._mutate(tx, f, given, flat, Options())
        flush()
        self.engine._commit(tx)

    def start(self, checkpoint: str, *, available_now: bool = False, **options: Any) -> Any:
        """Runs the handlers as changes come."""
        writer = self.engine.store.stream(**options).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, _: self.apply(b))
        return (writer.trigger(availableNow=True) if available_now else writer).start()
