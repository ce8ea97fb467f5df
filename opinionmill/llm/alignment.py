"""Alignment of two tokenizers through token-byte incidence matrices.

A token is a row of a sparse matrix with a one for every byte it covers.  With A and B the matrices of the two
tokenizers, the product A·Bᵀ holds, for every pair of tokens, the number of bytes they share: its entries are the
overlap links.  Byte offsets where tokens of both end cut the text into groups; with the token-group matrices the same
product holds the pairs that share a group.  The matrices are hand-built CSR arrays, and the products are taken row by
row (Gustavson): the rows of the right matrix that a row of the left one names are put one after the other and equal
columns are added up.

A text is cut into stretches at single spaces and line feeds between other characters.  Tokens of neither vocabulary
reach over such a cut, so a stretch is encoded once and kept in a bounded cache, and many stretches make one
block-diagonal matrix.  How often two ids are linked in the whole corpus is counted from the different stretches.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..operators.skew import salted_join
from ..session import write_down
from .texts import slices

#: Single spaces and line feeds between characters that are neither space nor U+2581, which piece vocabularies use for it.
CUT = re.compile(r"(?<=[^\s▁])(?=[ \n][^\s▁])")

#: Characters that are encoded without loss one by one and in any order; other stretches are tried.
PLAIN = re.compile("[\n -~¡-¬®-ɏ]*")

#: Plain texts that are cut at every space and line feed.
SIMPLE = re.compile("[!-~¡-¬®-ɏ]+(?:[ \n][!-~¡-¬®-ɏ]+)*")

#: Ids of the first tokenizer times this, plus ids of the second, are the keys of linked ids.
SHIFT = 1 << 16

CACHE = 300_000


class Matrix:
    """A sparse matrix of ones in compressed rows; ``pointers[i]:pointers[i + 1]`` are the places of row ``i``."""

    def __init__(self, pointers: np.ndarray, columns: np.ndarray, width: int):
        self.pointers, self.columns, self.width = pointers, columns, width

    @classmethod
    def spans(cls, lengths: np.ndarray) -> Matrix:
        """Rows that cover the columns one after the other, ``lengths[i]`` of them in row ``i``."""
        pointers = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return cls(pointers, np.arange(pointers[-1], dtype=np.int64), int(pointers[-1]))

    @classmethod
    def members(cls, groups: np.ndarray, width: int) -> Matrix:
        """One column for each row."""
        return cls(np.arange(len(groups) + 1, dtype=np.int64), groups.astype(np.int64), width)

    def __len__(self) -> int:
        return len(self.pointers) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self), dtype=np.int64), np.diff(self.pointers))

    def transposed(self) -> Matrix:
        counts = np.bincount(self.columns, minlength=self.width)
        pointers = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return Matrix(pointers, self.rows()[np.argsort(self.columns, kind="stable")], len(self))


def product(left: Matrix, right: Matrix, at_once: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of ``left`` times ``right``, row after row.

    Rows are taken together as long as they need no more than ``at_once`` additions; a row that needs more comes alone,
    and its additions are no more than the entries of the matrices.
    """
    needed = np.diff(right.pointers)[left.columns]
    upto = np.concatenate([[0], np.cumsum(needed)])[left.pointers]
    begin = 0
    while begin < len(left):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + at_once, side="right")) - 1)
        own = slice(left.pointers[begin], left.pointers[end])
        sizes = needed[own]
        first = np.repeat(right.pointers[left.columns[own]], sizes)
        inside = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = right.columns[first + inside]
        rows = np.repeat(np.repeat(np.arange(begin, end), np.diff(left.pointers[begin : end + 1])), sizes)
        keys = rows * right.width + columns
        if np.any(keys[1:] < keys[:-1]):
            keys.sort()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        yield keys[starts] // right.width, keys[starts] % right.width, np.diff(np.append(starts, len(keys)))
        begin = end


def joint(parts: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    parts = list(parts)
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3


class Aligned:
    """Tokens of both tokenizers for a list of stretches, one after the other, and how they meet."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_bytes: np.ndarray, b_bytes: np.ndarray):
        """Ids of both and the number of bytes of each token; both cover the same bytes."""
        self.a, self.b = a, b
        self.left, self.right = Matrix.spans(a_bytes), Matrix.spans(b_bytes)
        #: Byte offsets where tokens of both end.
        self.cuts = np.intersect1d(self.left.pointers[1:], self.right.pointers[1:], assume_unique=True)
        self.a_group = np.searchsorted(self.cuts, self.left.pointers[1:])
        self.b_group = np.searchsorted(self.cuts, self.right.pointers[1:])

    def overlaps(self, at_once: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Token pairs that share bytes, and how many."""
        return product(self.left, self.right.transposed(), at_once)

    def shared(self, at_once: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Token pairs of one group."""
        width = len(self.cuts)
        return product(Matrix.members(self.a_group, width), Matrix.members(self.b_group, width).transposed(), at_once)


class Pair:
    """Both tokenizers."""

    def __init__(self, a: str, b: str):
        own = Tokenizer.from_file(public_tokenizers.path(a))
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        spelled = _spelled_bytes()
        self.a_bytes = [b""] * own.get_vocab_size()
        for token, i in own.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(spelled[c] for c in token)
        # Ids of byte-level vocabularies follow the order of the merges, so they are ranks.  Special tokens are no part.
        ranks = {raw: i for i, raw in enumerate(self.a_bytes) if raw}
        self.a = tiktoken.Encoding(a, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        if max(len(self.a_bytes), len(self.b_bytes)) > SHIFT:
            raise ValueError(f"vocabularies of up to {SHIFT} entries")
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.space = self.b.piece_to_id("▁")

    def encode(self, keys: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each stretch."""
        # The second puts a space before its text by itself.
        ids_a = [self.a.encode_ordinary(k if k[0] in " \n" else " " + k) for k in keys]
        ids_b = self.b.encode([k[1:] if k[0] == " " else k for k in keys], num_threads=1)
        return [(a, b[1:] if k[0] == "\n" else b) for k, a, b in zip(keys, ids_a, ids_b)]

    def lossless(self, key: str) -> bool:
        """Whether the joined bytes of both are the stretch."""
        raw = (key if key[0] in " \n" else " " + key).encode("utf-8", "surrogatepass")
        ((a, b),) = self.encode([key])
        return b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])

    def align(self, encoded: list[tuple[list[int], list[int]]]) -> Aligned:
        a = np.array([i for ids, _ in encoded for i in ids], dtype=np.int64)
        b = np.array([i for _, ids in encoded for i in ids], dtype=np.int64)
        return Aligned(a, b, self.a_size[a], self.b_size[b])

    def cut(self, text: str, tried: dict[str, bool]) -> list[str] | None:
        """The stretches of the text with a space before it; None if it has no tokens.

        A stretch that begins with a space and another character is written without the space.
        """
        if SIMPLE.fullmatch(text):
            return text.replace("\n", " \n").split(" ")
        if not text:
            return None
        keys = [s[1:] if s[0] == " " and s[1] not in " \n" else s for s in CUT.split(" " + text)]
        if not PLAIN.fullmatch(text):
            if len(tried) > CACHE:
                tried.clear()
            for k in set(keys):
                if k not in tried and not PLAIN.fullmatch(k):
                    tried[k] = self.lossless(k)
            if not all(tried.get(k, True) for k in keys):
                return None
        return keys


def _spelled_bytes() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    """The tokenizers of this Python worker."""
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def _stretches(texts: DataFrame, a: str, b: str) -> DataFrame:
    """``stretch, n``: every different stretch of the corpus and how often it stands in texts that have tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, tried, counts = pair(a, b), {}, Counter()

        def counted() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["stretch", "n"])

        for batch in batches:
            for some in slices(batch.column(0)):
                for text in some:
                    counts.update(both.cut(text, tried) or ())
                if len(counts) > CACHE:
                    yield counted()
                    counts.clear()
        yield counted()

    parts = texts.mapInArrow(count, "stretch string, n long")
    return parts.groupBy("stretch").agg(F.sum("n").alias("n"))


def link_counts(docs: DataFrame, text_col: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """``key, n``: how many links of the corpus hold a pair of ids; ``key`` is the A id times 65,536 plus the B id.

    The texts are read once for their different stretches, and each of these is encoded once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a, b)
        for batch in batches:
            times = batch.column("n").to_numpy()
            encoded = both.encode(batch.column("stretch").to_pylist())
            met = both.align(encoded)
            owner = np.repeat(times, [len(ids) for ids, _ in encoded]).astype(np.int64)
            keys, totals = [], []
            for rows, columns, _ in met.overlaps():
                own, at = np.unique(met.a[rows] * SHIFT + met.b[columns], return_inverse=True)
                weights = np.zeros(len(own), dtype=np.int64)
                np.add.at(weights, at, owner[rows])
                keys.append(own)
                totals.append(weights)
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(totals))], ["key", "n"])

    parts = _stretches(docs.select(text_col), a, b).mapInArrow(count, "key long, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


class Measures:
    """Numbers and group texts of stretches, kept within a bound."""

    NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum")

    def __init__(self, both: Pair, keys: np.ndarray, counts: np.ndarray, best: np.ndarray):
        self.both, self.keys, self.counts, self.best = both, keys, counts, best
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((0, len(self.NAMES)), dtype=np.int64)

    def learn(self, wanted: set[str]) -> None:
        new = list(wanted.difference(self.place))
        if not new:
            return
        if len(self.place) > CACHE:
            self.clear()
            new = list(wanted)
        encoded = self.both.encode(new)
        met = self.both.align(encoded)
        n_a, n_b = (np.array([len(e[side]) for e in encoded], dtype=np.int64) for side in (0, 1))
        of_a = np.repeat(np.arange(len(new)), n_a)
        # Every stretch ends with a cut, so groups are in one stretch.
        last = np.searchsorted(met.cuts, met.left.pointers[np.cumsum(n_a)])
        first = np.concatenate([[0], last[:-1] + 1])
        in_a, in_b = (np.bincount(g, minlength=len(met.cuts)) for g in (met.a_group, met.b_group))
        numbers = np.zeros((len(new), len(self.NAMES)), dtype=np.int64)
        numbers[:, 0], numbers[:, 1], numbers[:, 2] = n_a, n_b, last - first + 1
        numbers[:, 4] = np.add.reduceat(in_a * in_b, first)
        for rows, columns, _ in met.overlaps():
            owner = of_a[rows]
            numbers[:, 3] += np.bincount(owner, minlength=len(new))
            if len(self.keys):
                count = self.counts[np.searchsorted(self.keys, met.a[rows] * SHIFT + met.b[columns])]
                numbers[:, 5] += np.bincount(owner[count == self.best[met.b[columns]]], minlength=len(new))
                np.add.at(numbers[:, 6], owner, count)
        texts_a, texts_b = (_joined(ids, g) for ids, g in ((met.a, in_a), (met.b, in_b)))
        for i, (low, high) in enumerate(zip(first.tolist(), last.tolist())):
            self.place[new[i]] = len(self.groups)
            self.groups.append(";".join([f"{texts_a[g]}|{texts_b[g]}" for g in range(low, high + 1)]))
        self.numbers = np.concatenate([self.numbers, numbers])


def _joined(ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The ids of each group, comma-joined."""
    written, at, out = list(map(str, ids.tolist())), 0, []
    for n in sizes.tolist():
        out.append(written[at] if n == 1 else ",".join(written[at : at + n]))
        at += n
    return out


def _measured(docs: DataFrame, id_col: str, text_col: str, a: str, b: str, shared=None, with_keys: bool = False) -> DataFrame:
    """Measures of every document; with ``with_keys`` the linked ids and how often each stands in it, without counts."""
    names = [n for n in Measures.NAMES if not with_keys or n not in ("n_best", "count_sum")]
    fields = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", groups_sha256 string"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, tried = pair(a, b), {}
        none = np.zeros(0, dtype=np.int64)
        known = Measures(both, *(shared.value if shared else (none, none, none)))
        for batch in batches:
            done = 0
            for some in slices(batch.column("text")):
                cut = [both.cut(t, tried) for t in some]
                known.learn({s for own in cut if own for s in own})
                numbers, digests, links = [], [], []
                for own in cut:
                    if own is None:
                        numbers.append(np.zeros(len(Measures.NAMES), dtype=np.int64))
                        digests.append("")
                        links.append([])
                        continue
                    at = [known.place[s] for s in own]
                    numbers.append(known.numbers[at].sum(axis=0))
                    digests.append(hashlib.sha256(";".join([known.groups[i] for i in at]).encode()).hexdigest())
                    if with_keys:
                        met = both.align(both.encode(own))
                        rows, columns, _ = joint(met.overlaps())
                        keys, times = np.unique(met.a[rows] * SHIFT + met.b[columns], return_counts=True)
                        links.append([{"key": k, "times": t} for k, t in zip(keys.tolist(), times.tolist())])
                table = np.array(numbers, dtype=np.int64)
                columns = [batch.column("doc_id").slice(done, len(some))]
                columns += [pa.array(table[:, Measures.NAMES.index(n)]) for n in names] + [pa.array(digests, pa.string())]
                if with_keys:
                    columns.append(pa.array(links, pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())]))))
                yield pa.record_batch(columns, ["doc_id", *names, "groups_sha256"] + ["links"] * with_keys)
                done += len(some)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(measure, fields + (", links array<struct<key: long, times: long>>" if with_keys else ""))


def align_tokenizers(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    a: str = "byte_bpe_50k.json",
    b: str = "piece_bpe_32k.model",
    broadcast_pairs: int = 6_000_000,
) -> DataFrame:
    """One row per row of ``docs``: tokens of both, groups, overlap links, pairs that share a group, and digests.

    ``n_best`` counts the links whose pair of ids is, over the corpus, the most frequent one of its B id (ties
    included), ``count_sum`` adds up the corpus counts of the links.  The different linked pairs are counted first: up
    to ``broadcast_pairs`` of them (16 bytes each) are sent to the tasks, beyond that they are joined on the pair.

    Texts that are null or empty, or whose tokens don't join to a space and the text (those with U+2581), have no
    tokens: zeros and an empty digest.  Null and repeated ids stay, repeated rows each count; other columns are
    ignored; an empty table gives no rows.  Very long texts are read whole, in memory that grows with the longest
    stretch without a space, not with the text's token pairs.
    """
    counts = write_down(link_counts(docs, text_col, a, b))
    if counts.count() <= broadcast_pairs:
        table = counts.orderBy("key").toArrow()
        keys, values = table["key"].to_numpy(), table["n"].to_numpy()
        best = np.zeros(SHIFT, dtype=np.int64)
        np.maximum.at(best, keys % SHIFT, values)
        return _measured(docs, id_col, text_col, a, b, docs.sparkSession.sparkContext.broadcast((keys, values, best)))
    top = counts.groupBy((F.col("key") % SHIFT).alias("b")).agg(F.max("n").alias("top"))
    ranked = counts.join(top, F.col("key") % SHIFT == F.col("b")).select("key", "n", (F.col("n") == F.col("top")).alias("best"))
    measured = _measured(docs, id_col, text_col, a, b, with_keys=True)
    rows = write_down(measured.withColumn("_at", F.monotonically_increasing_id()))
    links = salted_join(rows.select("_at", F.explode("links").alias("l")).select("_at", "l.key", "l.times"), ranked, "key")
    sums = links.groupBy("_at").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    kept = [c for c in rows.columns if c not in ("_at", "links", "groups_sha256")]
    filled = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum"))
    return rows.join(sums, "_at", "left").select(*kept, *filled, "groups_sha256")


def token_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    a: str = "byte_bpe_50k.json",
    b: str = "piece_bpe_32k.model",
    kind: str = "overlap",
    at_once: int = 4_000_000,
) -> DataFrame:
    """The links themselves: ``doc_id, a_token, b_token, a_id, b_id, weight``, tokens counted from 0.

    ``kind`` is ``overlap`` (``weight`` is the number of shared bytes) or ``group`` (tokens of one group, weight 1).
    Rows of the product are written as they are made, ``at_once`` additions at a time.  Nulls, empty texts and
    repeated rows as in ``align_tokenizers``.
    """
    if kind not in ("overlap", "group"):
        raise ValueError("kind is overlap or group")
    names = ["doc_id", "a_token", "b_token", "a_id", "b_id", "weight"]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, tried = pair(a, b), {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc, text in zip(ids, (t for some in slices(batch.column("text")) for t in some)):
                own = both.cut(text, tried)
                if own is None:
                    continue
                met = both.align(both.encode(own))
                for rows, columns, values in met.overlaps(at_once) if kind == "overlap" else met.shared(at_once):
                    yield pa.record_batch(
                        [pa.array([doc] * len(rows), pa.int64()), pa.array(rows), pa.array(columns), pa.array(met.a[rows]),
                         pa.array(met.b[columns]), pa.array(values.astype(np.int64))], names
                    )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(links, ", ".join(f"{n} long" for n in names))
