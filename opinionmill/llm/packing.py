"""Packing by power-of-two decomposition.

A document of L tokens is cut into pieces whose lengths are powers of two: as many of the longest as fit, then the
binary digits of the rest, longest first.  Every piece is a sequence of its own, so no sequence crosses documents
and none is padded; equal lengths share a bucket, from which batches of one shape are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .texts import WordValues, held, slices

# Letters of Latin-1 with ASCII marks after them are two pre-tokens, whatever stands around them.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
ACCENTED = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit numbers.

    White space never joins a token, so a text's ids are those of its space-separated stretches in order; a
    stretch is encoded once and kept in a bounded cache.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.cut = self.tokenizer.model.tokenize
        # The bytes of accented letters as the vocabulary writes them.
        by_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {ord(c): by_bytes.pre_tokenize_str(c)[0][0] for c in ACCENTED}
        self.runs = WordValues(self._run)
        self.stretches = WordValues(self._stretch)

    def _encode(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _run(self, run: str) -> bytes:
        """Ids of lower-case letters, which are one pre-token; marks take the whole way."""
        if run[0] in MARKS:
            return self._encode(run)
        spelled = run if run.isascii() else run.translate(self.spelled)
        return b"".join([t.id.to_bytes(4, "little") for t in self.cut(spelled)])

    def _stretch(self, stretch: str) -> bytes:
        if stretch.isascii() and stretch.isalpha():
            return self.runs[stretch.lower()]
        bare = stretch.rstrip(MARKS)
        if bare.isalpha() and (bare.isascii() or LETTERS.fullmatch(bare)):
            ids = self.runs[bare.lower()]
            return ids + self.runs[stretch[len(bare) :]] if len(bare) < len(stretch) else ids
        return self._encode(stretch) if stretch else b""

    def ids(self, texts: list[str]) -> list[bytes]:
        known = self.stretches.__getitem__
        return [b"".join(map(known, t.replace("\n", " ").replace("\t", " ").split(" "))) for t in texts]


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; one is kept."""
    return held(("packing", path), lambda: Encoder(path))


def piece_lengths(tokens: int, longest: int = 4096) -> list[int]:
    """Powers of two that add up to ``tokens``, longest first."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


FIELDS = ("start", "length", "ids_crc32", "doc_tokens")


def _pieces(documents: list[bytes], longest: int, with_ids: bool) -> pa.Array:
    """The pieces of each document, from its ids as bytes."""
    rows: list[tuple[int, int, int, int]] = []
    offsets = [0]
    for ids in documents:
        at, tokens = 0, len(ids) // 4
        for length in piece_lengths(tokens, longest):
            rows.append((at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), tokens))
            at += length
        offsets.append(len(rows))
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    columns, names = [pa.array(np.ascontiguousarray(table[:, i])) for i in range(4)], list(FIELDS)
    if with_ids:
        values = np.frombuffer(b"".join(documents), dtype="<i4")
        upto = np.concatenate([[0], np.cumsum(table[:, 1])]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(upto), pa.array(values)))
        names.append("ids")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=names))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    longest: int = 4096,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, ids, doc_tokens, sequence_id, offset``.

    ``longest`` is a power of two.  ``length`` is also the bucket.  ``sequence_id`` is unique: a piece is the only
    one of its sequence, at offset 0.  A null or empty text is the end id alone.  Null and repeated ids stay, each
    row is a document; other columns are ignored; an empty table gives no piece.  A text of any length is encoded whole.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    name, end = vocabulary, np.array([end_id], dtype="<u4").tobytes()
    fields = "start: long, length: long, ids_crc32: long, doc_tokens: long" + (", ids: array<int>" if with_ids else "")
    kind = pa.list_(
        pa.struct(
            [(f, pa.int64()) for f in FIELDS]
            + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
        )
    )

    @F.arrow_udf(f"array<struct<{fields}>>")
    def cut(column: pa.Array) -> pa.Array:
        own = encoder(public_tokenizers.path(name))
        parts = [_pieces([ids + end for ids in own.ids(texts)], longest, with_ids).cast(kind) for texts in slices(column)]
        return pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    pieces = docs.select(
        F.col(id_col).alias("doc_id"), F.explode(cut.asNondeterministic()(F.col(text_col))).alias("p")
    ).select("doc_id", "p.*")
    return pieces.select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
