"""Ranked lexical search with pair bounds (MaxScore).

``build_index`` reads all documents once, without a shuffle, and writes segments of bounded size: for each term of a
segment the list of its documents with the number of its occurrences.  ``search`` ranks all documents for a block of
items:

1. the posting lists of the items' terms are picked from the index by a join on the term;
2. pair lists are computed: for pairs of terms of an item, per segment, the documents that hold both, their joint
   maximum impact and their highest joint impacts.  The 20th highest over all segments is a score that the last place
   of the item's ranking must reach;
3. each segment is searched with bounds made of disjoint pairs: a document that holds both terms of a pair gets no more
   from them than the joint maximum, one that holds one of them no more than that term's own.  Lists whose bounds add up
   to less than the score to reach bring no new documents; documents that can't reach it are given up on the way.

Scores are exact integers; the ranking is the same as that of scoring every document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_down

#: Bytes that stand in terms: digits, letters (capitals made small) and everything beyond ASCII; others part terms.
TERM_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

SEGMENT = "segment long, term string, docs array<int>, tf array<int>, ids array<long>"
SEGMENT_NAMES = ["segment", "term", "docs", "tf", "ids"]


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TERM_BYTES).split()


class _Numbers(dict):
    """Numbers of words in the order they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Segment:
    """The documents of a segment while it is read."""

    def __init__(self):
        self.bytes, self.numbers, self.ids, self.lengths, self.terms, self.counts = 0, _Numbers(), [], [], [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        words = terms_of(raw)
        self.bytes += len(raw)
        if words:
            own = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words))
            terms, counts = np.unique(own, return_counts=True)
            self.ids.append(doc_id)
            self.lengths.append(len(words))
            self.terms.append(terms)
            self.counts.append(counts.astype(np.int32))

    def batches(self, number: int, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        """A row with all documents and their lengths under the empty term, then a row for each term."""
        if not self.ids:
            return
        every = pa.array([range(len(self.ids))], pa.list_(pa.int32()))
        yield pa.record_batch(
            [pa.array([number]), pa.array([""]), every, pa.array([self.lengths], pa.list_(pa.int32())), pa.array([self.ids], pa.list_(pa.int64()))],
            SEGMENT_NAMES,
        )
        docs = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(t) for t in self.terms])
        terms, counts = np.concatenate(self.terms), np.concatenate(self.counts)
        order = np.argsort(terms, kind="stable")
        docs, counts = docs[order], counts[order]
        upto = np.concatenate([[0], np.cumsum(np.bincount(terms))]).astype(np.int32)
        words = [w.decode("utf-8", "replace") for w in self.numbers]
        for low in range(0, len(words), rows):
            high = min(low + rows, len(words))
            part, offsets = slice(upto[low], upto[high]), pa.array(upto[low : high + 1] - upto[low])
            yield pa.record_batch(
                [pa.array(np.full(high - low, number)), pa.array(words[low:high], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(docs[part])),
                 pa.ListArray.from_arrays(offsets, pa.array(counts[part])), pa.nulls(high - low, pa.list_(pa.int64()))],
                SEGMENT_NAMES,
            )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 32_000_000) -> DataFrame:
    """``segment, term, docs, tf, ids``: the posting lists of all documents, in the checkpoint folder.

    A segment holds documents of one task, of ``segment_bytes`` of text (or one longer text).  Its row with the empty
    term has their ids and lengths.  Texts without a term, null ones too, are in no list.  Null and repeated ids stay,
    each row is a document of its own; other columns are ignored; an empty table gives an empty index.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, _Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                now.add(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b"")
                if now.bytes >= segment_bytes:
                    yield from now.batches(number)
                    number, now = number + 1, _Segment()
        yield from now.batches(number)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return write_down(source.mapInArrow(segments, SEGMENT))


@dataclass
class Item:
    """A question: its terms by number, how often each stands in it, the pairs among them, and the score to reach."""

    item_id: int | None
    terms: dict[int, int]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    reach: int = 1


@dataclass
class Block:
    """What the tasks need of a block of items: bounded by the items' text."""

    numbers: dict[str, int]
    weights: list[int]
    items: list[Item]
    pairs: list[tuple[int, int]]
    documents: int
    words: int
    top: int


class Lists:
    """The posting lists of one segment with their impacts."""

    def __init__(self, rows: pa.Table, block: Block):
        self.docs: dict[int, np.ndarray] = {}
        self.impacts: dict[int, np.ndarray] = {}
        self.ids: list[int | None] = []
        found = []
        for term, docs, tf, ids in zip(*(rows.column(c) for c in ("term", "docs", "tf", "ids"))):
            if term.as_py() == "":
                self.ids, lengths = ids.as_py(), tf.values.to_numpy().astype(np.int64)
            else:
                found.append((block.numbers[term.as_py()], docs.values.to_numpy(), tf.values.to_numpy().astype(np.int64)))
        for t, docs, tf in found:
            m = 75 + (25 * lengths[docs] * block.documents) // block.words
            self.docs[t] = docs
            self.impacts[t] = block.weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        self.most = {t: int(i.max()) for t, i in self.impacts.items()}

    def both(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that hold both terms and their joint impacts."""
        if len(self.docs[a]) > len(self.docs[b]):
            a, b = b, a
        at = np.searchsorted(self.docs[b], self.docs[a])
        at[at == len(self.docs[b])] = 0
        same = self.docs[b][at] == self.docs[a]
        return self.docs[a][same], self.impacts[a][same] + self.impacts[b][at[same]]

    def add(self, term: int, times: int, docs: np.ndarray, scores: np.ndarray) -> None:
        """Add what the term gives to the scores of ``docs``, which are in order."""
        own = self.docs[term]
        if len(own) > 8 * len(docs):
            at = np.searchsorted(own, docs)
            at[at == len(own)] = 0
            same = own[at] == docs
            scores[same] += times * self.impacts[term][at[same]]
        else:
            at = np.searchsorted(docs, own)
            at[at == len(docs)] = 0
            same = docs[at] == own
            scores[at[same]] += times * self.impacts[term][same]


def _highest(values: np.ndarray, top: int) -> np.ndarray:
    if len(values) > top:
        values = np.partition(values, len(values) - top)[-top:]
    return np.sort(values)[::-1]


PAIR = "segment long, a int, b int, most long, highest array<long>, docs array<int>"


def pair_lists(postings: DataFrame, block: Block) -> DataFrame:
    """``segment, a, b, most, highest, docs`` for the pairs of the block; single terms have no ``b`` and no ``docs``.

    ``most`` is the (joint) maximum impact in the segment, ``highest`` the block's ``top`` highest ones, ``docs`` the
    documents that hold both.
    """

    def lists(rows: pa.Table) -> pa.Table:
        own = Lists(rows, block)
        out = []
        for t, impacts in own.impacts.items():
            out.append((t, None, own.most[t], _highest(impacts, block.top), None))
        for a, b in block.pairs:
            if a in own.docs and b in own.docs:
                docs, joint = own.both(a, b)
                if len(docs):
                    out.append((a, b, int(joint.max()), _highest(joint, block.top), docs))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        number = rows.column("segment")[0].as_py()
        columns = zip(*((number, *row) for row in out)) if out else [[]] * 6
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["segment", "a", "b", "most", "highest", "docs"])

    return write_down(postings.groupBy("segment").applyInArrow(lists, PAIR))


def _units(item: Item, own: Lists, joint: dict[tuple[int, int], int]) -> list[tuple[int, tuple[int, ...]]]:
    """Bounds of disjoint pairs and of the terms left, lowest first; pairs that save most are taken first."""
    single = {t: times * own.most[t] for t, times in item.terms.items() if t in own.most}
    saved = []
    for a, b in item.pairs:
        if a in single and b in single:
            low = min(item.terms[a], item.terms[b])
            together = low * joint.get((a, b), 0) + (item.terms[a] - low) * own.most[a] + (item.terms[b] - low) * own.most[b]
            bound = max(min(together, single[a] + single[b]) if (a, b) in joint else 0, single[a], single[b])
            saved.append((single[a] + single[b] - bound, bound, (a, b)))
    units, used = [], set()
    for gain, bound, terms in sorted(saved, key=lambda s: (-s[0], s[2])):
        if gain > 0 and used.isdisjoint(terms):
            units.append((bound, terms))
            used.update(terms)
    return sorted(units + [(bound, (t,)) for t, bound in single.items() if t not in used])


def search_segment(item: Item, own: Lists, joint: dict[tuple[int, int], int], top: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (by their place in the segment) and scores that may be among the item's ``top``."""
    units = _units(item, own, joint)
    upto = np.cumsum([bound for bound, _ in units], dtype=np.int64)
    # Units before ``first`` add up to less than the score to reach: they bring no new documents.
    first = int(np.searchsorted(upto, item.reach, side="left"))
    if first == len(units):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    leading = [t for _, terms in units[first:] for t in terms]
    scores = np.zeros(len(own.ids), dtype=np.int64)
    for t in leading:
        scores[own.docs[t]] += item.terms[t] * own.impacts[t]
    docs = np.flatnonzero(scores)
    scores = scores[docs]
    reach = item.reach
    for i in range(first - 1, -2, -1):
        if len(scores) >= top:
            reach = max(reach, int(np.partition(scores, len(scores) - top)[-top]))
        kept = scores + (upto[i] if i >= 0 else 0) >= reach
        docs, scores = docs[kept], scores[kept]
        if i < 0 or not len(docs):
            break
        for t in units[i][1]:
            own.add(t, item.terms[t], docs, scores)
    return docs, scores


def _ranked(postings: DataFrame, pairs: DataFrame, block: Block) -> DataFrame:
    """``item, doc_id, score``: from every segment up to ``top`` documents for each item."""

    def found(rows: pa.Table, bounds: pa.Table) -> pa.Table:
        out_items, out_docs, out_scores = [], [], []
        if rows.num_rows and bounds.num_rows:
            own = Lists(rows, block)
            joint = {
                (a, b): most
                for a, b, most in zip(*(bounds.column(c).to_pylist() for c in ("a", "b", "most")))
                if b is not None
            }
            last = 1 << 63
            for number, item in enumerate(block.items):
                docs, scores = search_segment(item, own, joint, block.top)
                best = sorted((-s, last if own.ids[d] is None else own.ids[d], d) for d, s in zip(docs.tolist(), scores.tolist()))
                for s, _, d in best[: block.top]:
                    out_items.append(number)
                    out_docs.append(own.ids[d])
                    out_scores.append(-s)
        return pa.table([pa.array(out_items, pa.int32()), pa.array(out_docs, pa.int64()), pa.array(out_scores, pa.int64())], ["item", "doc_id", "score"])

    columns = pairs.select("segment", "a", "b", "most")
    return postings.groupBy("segment").cogroup(columns.groupBy("segment")).applyInArrow(found, "item int, doc_id long, score long")


def _block(items: list[tuple], postings_of, documents: int, words: int, top: int) -> tuple[Block, DataFrame] | None:
    """The items of a block with their terms weighed and paired, and the posting lists of the terms."""
    counted = [(item_id, Counter(terms_of((text or "").encode("utf-8", "replace")))) for item_id, text in items]
    postings, held = postings_of(sorted({t for _, own in counted for t in own}))
    if not held:
        return None
    names = sorted(held)
    numbers = {t: i for i, t in enumerate(names)}
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * held[t] + 1))) for t in names]
    out, pairs = [], set()
    for item_id, own in counted:
        terms = {numbers[t.decode()]: times for t, times in own.items() if t.decode() in numbers}
        # Rare terms first: those with the largest bounds meet each other.
        order = sorted(terms, key=lambda t: (-weights[t], t))
        near = [(min(p), max(p)) for step in (1, 2) for p in zip(order, order[step:])]
        out.append(Item(item_id, terms, near))
        pairs.update(near)
    return Block(numbers, weights, out, sorted(pairs), documents, words, top), postings


def search(
    index: DataFrame,
    items: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    top: int = 20,
    block_bytes: int = 4_000_000,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` highest-scoring documents of each item, with a score above 0.

    Equal scores are ranked by ``doc_id``, null ids last.  Items are taken in blocks of about ``block_bytes`` of text,
    each against the whole index; only one block is in the driver at a time, and its terms are few enough to be sent to
    the tasks.  Repeated items are ranked one by one; null or empty item texts, and an empty index, give no rows.  Very
    long items have two pairs a term, very long documents are one list entry a term.
    """
    spark = index.sparkSession
    heads = index.where("term = ''").select(F.size("tf").alias("n"), F.aggregate("tf", F.lit(0).cast("long"), lambda s, v: s + v).alias("l"))
    sums = heads.agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = size // block_bytes + 1
    kind = "item_id long, rank int, doc_id long, score long"
    if not sums["n"]:
        return spark.createDataFrame([], kind)

    def postings_of(terms: list[bytes]) -> tuple[DataFrame, dict[str, int]]:
        wanted = spark.createDataFrame([("",), *((t.decode(),) for t in terms)], "term string")
        own = index.join(F.broadcast(wanted), "term")
        found = own.where("term != ''").groupBy("term").agg(F.sum(F.size("docs")).alias("n")).collect()
        return own, {r["term"]: r["n"] for r in found}

    results = []
    for number in range(count):
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(count)) == number).orderBy("item_id", "text").collect()
        made = _block([tuple(r) for r in rows], postings_of, sums["n"], sums["l"], top)
        if made is None:
            continue
        block, postings = made
        pairs = pair_lists(postings, block)
        place = Window.partitionBy("a", "b").orderBy(F.desc("v"))
        reached = (
            pairs.select("a", "b", F.explode("highest").alias("v"))
            .withColumn("place", F.row_number().over(place))
            .where(F.col("place") <= top)
            .groupBy("a", "b")
            .agg(F.min("v").alias("low"), F.count("*").alias("n"))
            .where(F.col("n") == top)
        )
        low = {(r["a"], r["b"]): r["low"] for r in reached.collect()}
        for item in block.items:
            single = [times * low.get((t, None), 0) for t, times in item.terms.items()]
            joint = [min(item.terms[a], item.terms[b]) * low.get((a, b), 0) for a, b in item.pairs]
            item.reach = max([1, *single, *joint])
        names = spark.createDataFrame([(i, item.item_id) for i, item in enumerate(block.items)], "item int, item_id long")
        ranked = _ranked(postings, pairs, block).withColumn(
            "rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        )
        best = ranked.where(F.col("rank") <= top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        results.append(best if count == 1 else write_down(best))
    if not results:
        return spark.createDataFrame([], kind)
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out


SEARCH_SQL = r"""
with docs as (
    select row_number() over () as row_no, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
),
lengths as (select row_no, doc_id, len(terms) as n from docs where len(terms) > 0),
totals as (select count(*) as docs_n, sum(n)::bigint as words_n from lengths),
postings as (select row_no, term, count(*) as tf from (select row_no, unnest(terms) as term from docs) group by all),
weights as (
    select term, floor(1000 * ln((2 * any_value(docs_n) + 2) / (2 * count(*) + 1)))::bigint as w
    from postings, totals group by term
),
asked as (
    select row_number() over () as item_no, item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from benchmark
),
item_terms as (select item_no, item_id, term, count(*) as times from (select item_no, item_id, unnest(terms) as term from asked) group by all),
scored as (
    select item_no, item_id, doc_id, row_no,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs_n) // words_n))))::bigint as score
    from item_terms join weights using (term) join postings using (term) join lengths using (row_no), totals
    group by all
),
ranked as (
    select *, row_number() over (partition by item_no order by score desc, doc_id, row_no) as place from scored where score > 0
)
select item_id, place::integer as rank, doc_id, score from ranked where place <= 20
"""
