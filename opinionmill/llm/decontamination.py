"""Benchmark decontamination by template windows.

A text is canonicalised word by word: numbers become ``<num>``, numbers with a unit ``<num><unit>``, unit words
``<unit>``, capitalised words inside a sentence ``<name>``, all other words their lower-case letters.  A capital at the
start of a sentence may be a name or not, so windows that hold one are hashed under both readings, in items and
documents; function words (``FUNCTION_WORDS``) are no names anywhere.  Windows of ``window`` canonical words are hashed; the benchmark's windows form a hash table that every task probes with the
windows of its documents.  A question with other numbers or names therefore still meets its template.

An item is leaked into a document if at least ``coverage`` of its windows occur there with consistent slots: along
one alignment each number, name or unit of the item stands for the same value everywhere; windows with a place that
breaks this are left out.  Different values may meet in one.  An item shorter than a window is one window.  Candidates come from the rarest windows of each
item only (as many as the coverage allows), so a phrase that opens every question costs nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import POWERS, WordValues, held, slices

# Units of measure and money.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound "
    "pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
    "week weeks month months year years dollar dollars cent cents euro euros percent degree degrees meter meters "
    "metre metres kilometer kilometers kilometre kilometres"
).split()

UNIT_SET = frozenset(UNITS)

# Words that are no names, wherever they are capitalised.
FUNCTION_WORDS = frozenset((
    "a an the this that these those it its he she they we you his her their our your my what which who whom whose when "
    "where why how if then and or but because while although since after before during for from in into on at of to with "
    "without by as is are was were does did has have had can could should would there here each every all some many much "
    "not yes also only let suppose given"
).split())

NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*[%€$°]?")
NUMBER_UNIT = re.compile(r"[+-]?\d[\d.,]*([^\W\d_]+)")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")

# Kinds, kept in the low bits of a word's code; a slot's value is compared, a word's is not.
WORD, NUM, UNIT, NAME, NUM_UNIT = range(5)
CAPITAL, ENDS, SKIP = 8, 16, 32
FLAGS = 64
BASE = np.uint64(0x9E3779B97F4A7C15)


def _code(raw: str) -> int:
    """Hash of the canonical word in the high bits, kind and marks in the low ones."""
    if raw.isalpha():
        marks, bare = 0, raw
    else:
        marks = ENDS if raw.rstrip("\"')]»”").endswith((".", "!", "?", ":")) else 0
        bare = EDGES.sub("", raw)
        if not bare:
            return marks | SKIP
    kind, canonical = WORD, bare.lower()
    # Only what is not all letters can be a number.
    unit = None if bare.isalpha() else NUMBER_UNIT.fullmatch(bare)
    if not bare.isalpha() and NUMBER.fullmatch(bare):
        kind, canonical = NUM, "<num>"
    elif unit and unit[1].lower() in UNIT_SET:
        kind, canonical = NUM_UNIT, "<num><unit>"
    elif canonical in UNIT_SET:
        kind, canonical = UNIT, "<unit>"
    elif bare[0].isupper() and not bare.isupper() and canonical not in FUNCTION_WORDS:
        marks |= CAPITAL
    return (xxhash.xxh64_intdigest(canonical.encode("utf-8", "surrogatepass")) >> 7 << 6) | marks | kind


NAME_CODE = (xxhash.xxh64_intdigest(b"<name>") >> 7 << 6) | NAME


def canonical(texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """Per text the raw words that count, their codes, and which of them are capitals at the start of a sentence.

    Capitals inside a sentence are names.
    """
    known = held("decontamination", lambda: WordValues(_code))
    out = []
    for words in map(str.split, texts):
        codes = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        starts = np.concatenate([[True], (codes[:-1] & ENDS) > 0]) if len(codes) else np.zeros(0, dtype=bool)
        capital = (codes & CAPITAL) > 0
        codes = np.where(capital & ~starts, NAME_CODE, codes)
        used = np.flatnonzero((codes & SKIP) == 0)
        out.append(([words[i] for i in used] if len(used) < len(words) else words, codes[used], (capital & starts)[used]))
    return out


def _kinds(codes: np.ndarray) -> np.ndarray:
    return (codes.view(np.uint64) >> np.uint64(6) << np.uint64(3)) | (codes & 7).view(np.uint64)


NAME_KIND = _kinds(np.array([NAME_CODE], dtype=np.int64))[0]


def window_hashes(codes: np.ndarray, initial: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the windows of ``length`` words, under every reading of the ``initial`` words in them.

    First come all windows, with these words as words, then all readings with some of them as names.  The hashes add up
    a term for each word, so a reading costs an addition.
    """
    n = len(codes) - length + 1
    if n < 1:
        return
    up, down = POWERS.upto(len(codes) + 1)
    kinds = _kinds(codes)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(kinds * up[: len(codes)], dtype=np.uint64)])
    at, raw = np.arange(n), sums[length:] - sums[:n]
    yield at, _finished(raw * down[:n], length)
    # A name changes the sum by one term, whatever the window.
    changes = ((NAME_KIND - kinds) * up[: len(codes)])[initial]
    upto = np.concatenate([[0], np.cumsum(initial)])
    inside = upto[length:] - upto[:n]
    named_at, named = [], []
    for bit in range(int(inside.max())):
        # All readings so far, with the next of their windows' capitals as a name too.
        at, raw = np.concatenate([at, *named_at[-1:]]), np.concatenate([raw, *named[-1:]])
        more = inside[at] > bit
        named_at.append(at[more])
        named.append(raw[more] + changes[upto[at[more]] + bit])
    if named:
        at, raw = np.concatenate(named_at), np.concatenate(named)
        yield at, _finished(raw * down[at], length)


def _finished(h: np.ndarray, length: int) -> np.ndarray:
    h = (h + np.uint64(length)) * BASE
    return h ^ (h >> np.uint64(31))


@dataclass
class Item:
    item_id: int | None
    words: list[str]
    codes: np.ndarray
    length: int
    #: For each window its hashes under all readings.
    hashes: list[list[int]]


class Templates:
    """The benchmark's windows: a hash table with a bit table in front of it."""

    BITS = 20

    def __init__(self, rows: list[tuple], window: int, least_words: int, coverage: float):
        self.items: list[Item] = []
        for (item_id, _), (words, codes, initial) in zip(rows, canonical([t for _, t in rows])):
            plain = int((codes & 7 == WORD).sum())
            if plain >= least_words:
                length = min(window, len(codes))
                hashes: list[list[int]] = [[] for _ in range(len(codes) - length + 1)]
                for at, values in window_hashes(codes, initial, length):
                    for i, h in zip(at.tolist(), values.tolist()):
                        hashes[i].append(h)
                # Where the reading is open, a slot is checked as a name's.
                slots = np.where(initial, NAME_CODE, codes)
                self.items.append(Item(item_id, words, slots, length, hashes))
        seen: dict[int, int] = {}
        for item in self.items:
            for h in {h for own in item.hashes for h in own}:
                seen[h] = seen.get(h, 0) + 1
        self.known = set(seen)
        self.lead: dict[int, list[int]] = {}
        self.coverage = coverage
        for i, item in enumerate(self.items):
            need = max(1, int(np.ceil(coverage * len(item.hashes) - 1e-9)))
            # By place, not by value: a repeated window counts as often as it stands in the item.
            ranked = sorted(item.hashes, key=lambda own: (sum(seen[h] for h in own), own))
            for h in dict.fromkeys(h for own in ranked[: len(ranked) - need + 1] for h in own):
                self.lead.setdefault(h, []).append(i)
        self.lengths = sorted({item.length for item in self.items})
        self.bits = np.zeros(1 << self.BITS, dtype=bool)
        keys = np.array(sorted(self.known), dtype=np.uint64)
        self.bits[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def leaks(self, words: list[str], codes: np.ndarray, initial: np.ndarray) -> list[dict]:
        places: dict[int, list[int]] = {}
        for length in self.lengths:
            for starts, hashes in window_hashes(codes, initial, length):
                maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
                for at, h in zip(starts[maybe].tolist(), hashes[maybe].tolist()):
                    if h in self.known:
                        places.setdefault(h, []).append(at)
        candidates = sorted({i for h in places for i in self.lead.get(h, ())})
        return [found for i in candidates if (found := self._judge(self.items[i], places, words))]

    def _judge(self, item: Item, places: dict, words: list[str]) -> dict | None:
        lines: dict[int, set[int]] = {}
        for at, own in enumerate(item.hashes):
            for h in own:
                for place in places.get(h, ()):
                    lines.setdefault(place - at, set()).add(at)
        met: set[int] = set()
        changed = False
        for shift, starts in lines.items():
            kept, other = _consistent(item, starts, shift, words)
            met |= kept
            changed |= other
        share = len(met) / len(item.hashes)
        if share < self.coverage:
            return None
        return {
            "item_id": item.item_id,
            "matched_windows": len(met),
            "item_windows": len(item.hashes),
            "coverage": share,
            "other_slots": changed,
        }


def _consistent(item: Item, starts: set[int], shift: int, words: list[str]) -> tuple[set[int], bool]:
    """The windows along an alignment whose slots agree with the others, and whether any value in them differs.

    Each value of the item stands for one value of the document.  If the document has several, the item's own counts,
    or else the one at most of the places; windows that touch a place with another value are left out.
    """
    values: dict[tuple, dict[str, list[int]]] = {}
    for i in sorted({s + k for s in starts for k in range(item.length)}):
        kind = int(item.codes[i] & 7)
        if kind != WORD:
            own, found = (EDGES.sub("", w).lower() for w in (item.words[i], words[i + shift]))
            values.setdefault((kind, own), {}).setdefault(found, []).append(i)
    wrong: set[int] = set()
    changed: set[int] = set()
    for (_, own), found in values.items():
        counts = sorted((len(at) for at in found.values()), reverse=True)
        for value, at in found.items():
            if len(found) > 1 and (value != own if own in found else len(at) < counts[0] or counts[0] == counts[1]):
                wrong.update(at)
            elif value != own:
                changed.update(at)
    kept = {s for s in starts if wrong.isdisjoint(range(s, s + item.length))}
    return kept, any(not changed.isdisjoint(range(s, s + item.length)) for s in kept)


def leak_column(text: Column, templates: Templates) -> Column:
    kind = pa.list_(
        pa.struct(
            [("item_id", pa.int64()), ("matched_windows", pa.int64()), ("item_windows", pa.int64()),
             ("coverage", pa.float64()), ("other_slots", pa.bool_())]
        )
    )

    @F.arrow_udf(
        "array<struct<item_id: long, matched_windows: long, item_windows: long, coverage: double, other_slots: boolean>>"
    )
    def found(column: pa.Array) -> pa.Array:
        rows = [templates.leaks(*read) for texts in slices(column) for read in canonical(texts)]
        return pa.array(rows, type=kind)

    return found.asNondeterministic()(text)


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list[tuple]]:
    """The items in blocks of about ``block_bytes``; one block for any benchmark below that size."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = size // block_bytes + 1
    if count == 1:
        return [[tuple(r) for r in items.collect()]]
    block = F.pmod(F.xxhash64("text"), F.lit(count))
    return [[tuple(r) for r in items.where(block == b).collect()] for b in range(count)]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
    least_words: int = 5,
    coverage: float = 0.5,
    block_bytes: int = 32_000_000,
) -> DataFrame:
    """A row for each document and item it leaks: ``doc_id, item_id``, the windows, ``coverage``, ``other_slots``.

    The benchmark is measured first; beyond ``block_bytes`` it is joined in blocks, each against all documents.
    ``other_slots`` tells a re-parameterised copy from a plain one.  Items with fewer than ``least_words`` plain
    words say too little and are left out.  Null texts are empty; null ids of documents or items stay null;
    repeated rows give repeated leaks; other columns are ignored; an empty table, or no item, gives no row.  Of equally
    rare windows of an item the one with the smaller hash leads.  Texts of any length are read whole.
    """
    parts = []
    for rows in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        templates = Templates(sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])), window, least_words, coverage)
        parts.append(
            docs.select(F.col(id_col).alias("doc_id"), F.explode(leak_column(F.col(text_col), templates)).alias("l")).select(
                "doc_id", "l.*"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_leaked(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
    least_words: int = 5,
    coverage: float = 0.5,
    block_bytes: int = 32_000_000,
) -> DataFrame:
    """The rows of ``docs`` with all their columns that leak no item; nothing is shuffled."""
    out = docs.select(F.struct("*").alias("_row"))
    for rows in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        templates = Templates(sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])), window, least_words, coverage)
        leaks = out.select("_row", leak_column(F.col(f"_row.`{text_col}`"), templates).alias("_leaks"))
        out = leaks.where(F.size("_leaks") == 0).select("_row")
    return out.select("_row.*")
