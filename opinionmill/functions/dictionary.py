"""Small dictionaries that are probed inside a row.

Spark's map lookup walks the entries one by one.  A dictionary column here is an
``array<map>`` addressed by ``crc32(key) % size``, so a probe touches about one
entry.  The lookup needs no join, no shuffle and no Python worker, and the text
stays in the row it came from.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _slots(n_entries: int) -> int:
    size = 1
    while size < n_entries:
        size *= 2
    return size


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key, from 0 on."""
    return F.pmod(F.crc32(key.cast("binary")), F.lit(slots)).cast("int")


def in_slots(maps: Column) -> Column:
    """``array<struct<_slot, _map>>`` with each slot at most once as the column of a dictionary; slots without entries are NULL."""
    ordered = F.array_sort(maps, lambda x, y: x["_slot"] - y["_slot"])

    def filled(known: Column) -> Column:
        missing = lambda x, i: F.array_repeat(
            F.when(F.lit(False), x["_map"]), x["_slot"] - F.coalesce(F.get(known, i - 1)["_slot"], F.lit(-1)) - 1
        )
        return F.flatten(F.transform(known, lambda x, i: F.concat(missing(x, i), F.array(x["_map"]))))

    return F.get(F.transform(F.array(ordered), filled), F.lit(0))


class Dictionary:
    """A lookup table usable from any column expression."""

    def __init__(self, column: Column, slots: int):
        self._column = column
        self._slots = slots

    @classmethod
    def of(cls, entries: Mapping[str, object], value_type: str = "string") -> "Dictionary":
        """A dictionary of known size; its literal is parsed once, when Spark folds constants.

        Entries derived from data must come from a size-checked collection: they
        travel inside the tasks.
        """
        slots = _slots(len(entries))
        table: list[dict[str, object]] = [{} for _ in range(slots)]
        for key, value in entries.items():
            table[zlib.crc32(key.encode("utf-8")) % slots][key] = value
        literal = F.lit(json.dumps(table, ensure_ascii=False))
        return cls(F.from_json(literal, f"array<map<string,{value_type}>>"), slots)

    def get(self, key: Column) -> Column:
        """The value stored for ``key``, or NULL."""
        return F.try_element_at(F.get(self._column, slot_of(key, self._slots)), key)
