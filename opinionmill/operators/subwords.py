"""Subword ids from a public vocabulary file, for the text-to-text models that the pairs are made for.

A vocabulary is a file of the ``tokenizers`` library (``.json``) or of ``sentencepiece`` (``.model``).  It is read by
the driver and sent to the tasks once, so workers need no such file; its size is checked.  Vocabularies are used as they
are and never trained here.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.tokens import attention_mask, mask_labels, pad_to

#: A vocabulary travels to every task once.
MAX_BYTES = 64 * 1024 * 1024

# Fixed value: how byte-level vocabularies split a text before their merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Codec = tuple[Callable[[list[str]], list[list[int]]], Callable[[list[list[int]]], list[str]]]

_CODECS: dict[bytes, Codec] = {}


def _codec(raw: bytes, kind: str) -> Codec:
    """How this Python worker encodes and decodes; built once per vocabulary."""
    if raw not in _CODECS:
        _CODECS.clear()
        if kind == ".json":
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(raw.decode())
            own.encode_special_tokens = True
            table = _byte_table(own)
            ranked = _ranked(json.loads(raw), own, table)
            _CODECS[raw] = (
                (lambda texts: [ranked.encode_ordinary(t) for t in texts])
                if ranked
                else (lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]),
                (lambda ids: [b"".join([table[i] for i in own_ids]).decode("utf-8", "replace") for own_ids in ids])
                if table
                else (lambda ids: [own.decode(i, skip_special_tokens=False) for i in ids]),
            )
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_proto=raw)
            _CODECS[raw] = (
                lambda texts: pieces.encode(texts, num_threads=1),
                lambda ids: [pieces.decode(i) for i in ids],
            )
    return _CODECS[raw]


def _byte_table(own) -> list[bytes] | None:
    """The bytes of each id of a byte-level vocabulary, where decoding is to join them; None for others."""
    from tokenizers.decoders import ByteLevel

    if not isinstance(own.decoder, ByteLevel):
        return None
    # Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain}
    spelled |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in spelled.values())}
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    table = [b""] * own.get_vocab_size()
    for token, i in own.get_vocab().items():
        table[i] = token.encode() if token in special else bytes(spelled[c] for c in token)
    return table


def _ranked(about: dict, own, table: list[bytes] | None):
    """A faster encoder with the same ids, for byte-level vocabularies whose ids follow the order of their merges."""
    import tiktoken

    split = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    before = about.get("pre_tokenizer") or {}
    if not table or about.get("normalizer") or {k: before.get(k) for k in split} != split or about["model"]["type"] != "BPE":
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in about["model"]["merges"]]
    made = [about["model"]["vocab"]["".join(m)] for m in merges]
    special = {i for i, t in own.get_added_tokens_decoder().items()}
    if any(a >= b for a, b in zip(made, made[1:])) or len(made) + 256 + len(special) != len(table):
        return None
    ranks = {token: i for i, token in enumerate(table) if i not in special}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Texts that are held at once as lists of ids.
SLICE_ROWS = 64


class Subwords:
    """A vocabulary file, ready to be used in the tasks of a session."""

    def __init__(self, spark: SparkSession, path: str):
        self.kind = os.path.splitext(path)[1]
        if self.kind not in (".json", ".model"):
            raise ValueError(f"neither a .json nor a .model vocabulary: {path}")
        if os.path.getsize(path) > MAX_BYTES:
            raise ValueError(f"over {MAX_BYTES} bytes: {path}")
        with open(path, "rb") as file:
            self.shared: Broadcast[bytes] = spark.sparkContext.broadcast(file.read())

    def ids(self, text: Column) -> Column:
        """``array<int>``: the ids of each whole text, without special tokens; null is empty."""
        shared, kind = self.shared, self.kind

        @F.arrow_udf("array<int>")
        def encoded(column: pa.Array) -> pa.Array:
            encode, _ = _codec(shared.value, kind)
            parts = [
                pa.array(encode([t or "" for t in column.slice(at, SLICE_ROWS).to_pylist()]), pa.list_(pa.int32()))
                for at in range(0, len(column), SLICE_ROWS)
            ]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

        return encoded.asNondeterministic()(text)

    def text(self, ids: Column) -> Column:
        """The text of ids; null stays null."""
        shared, kind = self.shared, self.kind

        @F.arrow_udf("string")
        def decoded(column: pa.Array) -> pa.Array:
            _, decode = _codec(shared.value, kind)
            out: list[str | None] = []
            for at in range(0, len(column), SLICE_ROWS):
                values = column.slice(at, SLICE_ROWS).to_pylist()
                texts = iter(decode([v for v in values if v is not None]))
                out += [None if v is None else next(texts) for v in values]
            return pa.array(out, pa.string())

        return decoded.asNondeterministic()(ids)


def _framed(ids: Column, length: int | None, begin_id: int | None, end_id: int | None) -> Column:
    """Ids with the model's first and last id around them, cut so that both fit into ``length``."""
    around = (begin_id is not None) + (end_id is not None)
    if length is not None:
        if length < around:
            raise ValueError(f"no room for {around} special ids in {length}")
        ids = F.slice(ids, 1, length - around)
    parts = [ids]
    if begin_id is not None:
        parts.insert(0, F.array(F.lit(begin_id).cast("int")))
    if end_id is not None:
        parts.append(F.array(F.lit(end_id).cast("int")))
    return F.concat(*parts) if len(parts) > 1 else ids


def encode_subwords(
    df: DataFrame,
    text_col: str,
    subwords: Subwords,
    out: str = "ids",
    max_length: int | None = None,
    begin_id: int | None = None,
    end_id: int | None = None,
) -> DataFrame:
    """Add ``out: array<int>``; longer texts are cut before ``end_id``, which every row has if it is given."""
    return df.withColumn(out, _framed(subwords.ids(F.col(f"`{text_col}`")), max_length, begin_id, end_id))


def encode_subword_pairs(
    pairs: DataFrame,
    subwords: Subwords,
    max_input_length: int = 512,
    max_target_length: int = 512,
    pad_id: int = 0,
    begin_id: int | None = None,
    end_id: int | None = None,
) -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``labels`` of fixed length to input / target pairs.

    Component pairs use 512 / 512, quadruple pairs 128 / 128.  Labels hold -100 from the end of the target on; the mask
    and the labels go by the target's length, so a ``pad_id`` that is also a token does no harm.
    """
    columns = [F.col(f"`{c}`") for c in pairs.columns]

    def arrays(ids: Column, target: Column) -> Column:
        kept = F.slice(target, 1, max_target_length)
        return F.struct(
            pad_to(ids, max_input_length, pad_id).alias("input_ids"),
            attention_mask(ids, max_input_length).alias("attention_mask"),
            F.concat(kept, mask_labels(F.array_repeat(F.lit(pad_id), F.lit(max_target_length) - F.size(kept)), pad_id)).alias("labels"),
        )

    # Python columns stand in a projection of their own: a lambda can't hold them.
    coded = pairs.select(
        F.struct(*columns).alias("_row"),
        subwords.ids(F.col("`input_text`")).alias("_in"),
        subwords.ids(F.col("`target_text`")).alias("_out"),
    )
    framed = [_framed(F.col(c), n, begin_id, end_id) for c, n in (("_in", max_input_length), ("_out", max_target_length))]
    both = let(F.struct(framed[0].alias("i"), framed[1].alias("t")), lambda p: arrays(p["i"], p["t"]))
    return coded.select("_row", both.alias("_arrays")).select("_row.*", "_arrays.*")
