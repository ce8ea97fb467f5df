"""Fixed-length token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SPACE_CHARS, WORD, WORD_CHARS

IGNORED_LABEL = -100

_TOKEN = f"{WORD}+|[^{WORD_CHARS}{SPACE_CHARS}]"


def words_and_marks(text: Column) -> Column:
    """Runs of word characters and single punctuation marks, in order."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def pad_to(ids: Column, length: int, pad_id: int) -> Column:
    """Exactly ``length`` ids: cut at the end, or filled with ``pad_id``."""
    kept = F.slice(ids, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(pad_id).cast("int"), F.lit(length) - F.size(kept)))


def attention_mask(ids: Column, length: int) -> Column:
    """1 for each kept id, 0 for padding."""
    n_kept = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n_kept), F.array_repeat(F.lit(0), F.lit(length) - n_kept))


def mask_labels(ids: Column, pad_id: int) -> Column:
    """Replace padding ids so that a loss ignores them."""
    return F.transform(
        ids, lambda i: F.when(i == pad_id, F.lit(IGNORED_LABEL)).otherwise(i)
    )
