"""Quality rules: counts of words and repeats, and tokeniser fertility with bands per language.

Fertility: a public vocabulary with byte fallback encodes each word (``public_tokenizers``).  Measured are
characters per token, the share of byte-fallback tokens, and the entropy of the tokens in relation to the most
their number allows.  A document is rejected if one of them leaves the band of its language (or script, where the
language is null) and length class.  The bands come from all documents, every different text counted once, so a
text copied a million times doesn't pull them.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, write_down
from .texts import WordCache, held, slices

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
GROUP = ["band_group", "script", "length_class"]
ENOUGH = 16


class Pieces:
    """Piece ids of words as little-endian 16-bit numbers, each word encoded once."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.words = WordCache(self._encode)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        encoded = self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        return [np.array(ids, dtype="<u2").tobytes() for ids in encoded]


def pieces(path: str) -> Pieces:
    """The vocabulary of this Python worker; one is kept."""
    return held(("quality rules", path), lambda: Pieces(path))


def repeated_words(words: list) -> int:
    """Words that lie in a window of eight words found at least twice, the first time included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        mixed = mixed * MULTIPLIER + hashes[k : k + n]
    ranked = np.sort(mixed)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    # Equal hashes are settled by the words themselves, numbered without collisions.
    number: dict = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    a, b = order[1:][same], order[:-1][same]
    if not all((codes[a + k] == codes[b + k]).all() for k in range(WINDOW)):
        rank = codes
        for step in (1, 2, 4):
            pair = np.stack([rank[: len(rank) - step], rank[step:]], axis=1)
            rank = np.unique(pair, axis=0, return_inverse=True)[1].reshape(-1)
        order = np.argsort(rank, kind="stable")
        same = rank[order[1:]] == rank[order[:-1]]
        a, b = order[1:][same], order[:-1][same]
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.unique(np.concatenate([a, b]))
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """The script of most letters, from their names; ``none`` without letters."""
    seen = Counter(c for c in text if c.isalpha())
    scripts: Counter = Counter()
    for c, n in seen.items():
        scripts[unicodedata.name(c, "unknown").split(" ")[0].lower()] += n
    return max(sorted(scripts), key=scripts.get) if scripts else "none"


def measure(texts: list[str], own: Pieces) -> list[dict]:
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    known = own.words.learn({w for words in split for w in words})
    out = []
    for text, words in zip(texts, split):
        ids = np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u2")
        counts = np.bincount(ids)
        shares = counts[counts > 0] / max(1, len(ids))
        entropy = float(-(shares * np.log2(shares)).sum()) if len(ids) > 1 else 0.0
        out.append(
            {
                "n_words": len(words),
                "word_chars": len(text) - sum(map(text.count, BLANKS)),
                "n_symbols": sum(map(text.count, SYMBOLS)),
                "n_dup_lines": duplicate_lines(text) if "\n" in text else 0,
                "n_repeat_words": repeated_words(words),
                "n_tokens": len(ids),
                "n_byte_tokens": int(own.is_byte[ids].sum()),
                "token_entropy": entropy / np.log2(len(ids)) if len(ids) > 1 else 0.0,
            }
        )
    return out


def measures(text: Column, lang: Column, vocabulary: str) -> Column:
    """A struct with the counts, ``token_entropy``, ``script`` and ``band_group``."""
    kind = pa.struct(
        [(c, pa.int64()) for c in COUNTS]
        + [("token_entropy", pa.float64()), ("script", pa.string()), ("band_group", pa.string())]
    )

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS) + ", token_entropy double, script string, band_group string")
    def measured(texts: pa.Array, langs: pa.Array) -> pa.Array:
        own, at, parts = pieces(public_tokenizers.path(vocabulary)), 0, []
        for part in slices(texts):
            rows = measure(part, own)
            for row, t, name in zip(rows, part, langs.slice(at, len(part)).to_pylist()):
                row["script"] = script(t)
                row["band_group"] = name if name is not None else f"script:{row['script']}"
            parts.append(pa.array(rows, type=kind))
            at += len(part)
        return pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return measured.asNondeterministic()(text, lang)


def bands(measured: DataFrame, fences: float = 2.0, enough: int = ENOUGH) -> DataFrame:
    """``GROUP`` with the middle, the half width on either side and the number of texts of every measure.

    The middle half of all different texts, widened by ``fences`` times its spread on each side.  A group of fewer
    than ``enough`` texts takes the band of the first wider group that has them: its language in this and the
    neighbouring length classes, its script in these, its script as a whole.  Entropy falls with the length, so a
    whole script has no band for it, and no text is judged by it where the neighbours are too few.
    """
    once = measured.where("n_tokens > 0").dropDuplicates([*GROUP, "text_hash"])
    c, none = F.col("length_class"), F.lit(None).cast("long")

    def level(number: int, name: str, at: Column) -> Column:
        return F.struct(F.lit(number).alias("level"), F.col(name).alias("name"), at.alias("at"))

    near = [c - 1, c, c + 1]
    levels = [
        level(0, "band_group", c),
        *(level(1, "band_group", at) for at in near),
        *(level(2, "script", at) for at in near),
        level(3, "script", none),
    ]
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    stats = (
        once.select(F.explode(F.array(*levels)).alias("l"), *MEASURES)
        .select("l.*", *MEASURES)
        .groupBy("level", "name", "at")
        .agg(F.count("*").alias("n"), *(F.percentile_approx(m, quarters, 1000).alias(m) for m in MEASURES))
        .where(F.col("n") >= enough)
    )
    # One row per language, script and length class: the levels it may take, the narrowest first.
    wanted = once.select(*GROUP).distinct().select(
        *GROUP, F.explode(F.array(levels[0], levels[2], levels[5], levels[7])).alias("l")
    ).select(*GROUP, "l.*")
    met = wanted.join(
        stats.withColumnsRenamed({"level": "_level", "name": "_name", "at": "_at"}),
        (F.col("level") == F.col("_level")) & (F.col("name") == F.col("_name")) & F.col("at").eqNullSafe(F.col("_at")),
    )
    best = met.groupBy(*GROUP).agg(
        F.min(F.struct("level", "n", "chars_per_token", "byte_share")).alias("any"),
        F.min(F.when(F.col("level") < 3, F.struct("level", "n", "token_entropy"))).alias("near"),
    )
    out = [F.col(g) for g in GROUP]
    for m in MEASURES:
        side = "near" if m == "token_entropy" else "any"
        low, mid, high = (F.col(side)[m][i] for i in range(3))
        out += [
            F.col(side)["n"].alias(f"{m}_texts"),
            mid.alias(f"{m}_mid"),
            (low - fences * (high - low)).alias(f"{m}_low"),
            (high + fences * (high - low)).alias(f"{m}_high"),
        ]
    return best.select(*out)


def _measured(docs: DataFrame, text: Column, lang: Column, vocabulary: str, own: Column) -> DataFrame:
    """``own``, named ``doc_id`` or ``_row``, with the measures of the text."""
    one = F.lit(1)
    return (
        docs.select(own, F.xxhash64(text).alias("text_hash"), measures(text, lang, vocabulary).alias("_m"))
        .select("*", "_m.*")
        .drop("_m")
        .select(
            "*",
            (F.col("word_chars") / F.greatest("n_tokens", one)).alias("chars_per_token"),
            (F.col("n_byte_tokens") / F.greatest("n_tokens", one)).alias("byte_share"),
            F.floor(F.log2(F.greatest("n_tokens", one))).alias("length_class"),
        )
    )


def _judged(measured: DataFrame, limits: DataFrame, slack: float, few: float) -> DataFrame:
    """Add ``base_failed``, ``reason`` and ``kept``."""
    # One row per language, script and length class; sent to every task only if it is as small as that should be.
    limits = cut_lineage(limits)
    limits = F.broadcast(limits) if limits.count() <= 100_000 else limits

    def beyond(name: str, low: bool = True, high: bool = True) -> Column:
        extra = F.col(f"{name}_mid") * (slack + few / F.sqrt(F.col(f"{name}_texts")))
        out = F.lit(False)
        if low:
            out = out | (F.col(name) < F.col(f"{name}_low") - extra)
        if high:
            out = out | (F.col(name) > F.col(f"{name}_high") + extra)
        return F.coalesce(out, F.lit(False))

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    reason = (
        F.when(F.col("base_failed"), F.lit("base"))
        .when(beyond("chars_per_token"), F.lit("chars_per_token"))
        .when(beyond("byte_share", low=False) & (F.col("n_byte_tokens") >= 3), F.lit("byte_share"))
        .when(beyond("token_entropy", high=False), F.lit("token_entropy"))
    )
    joined = measured.join(limits, GROUP, "left").withColumn("base_failed", failed)
    return joined.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary: str = "piece_bpe_32k.model",
    fences: float = 2.0,
    slack: float = 0.01,
    few: float = 0.15,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts, the three measures, ``base_failed``, ``reason``, ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated windows.  A band is the middle half
    of its group, plus ``fences`` times its spread, plus ``slack`` and ``few`` over the root of the group's texts as
    shares of the middle value: a small group says less, so its band is wider.  Length classes double.  Groups of
    fewer than ``ENOUGH`` different texts take the band of a wider group (see ``bands``).
    ``byte_share`` has an upper bound only and ``token_entropy`` a lower one.

    A null or empty text has no word and fails the base.  A null language is judged with its script.  Null and
    repeated ids and rows stay, other columns are ignored, and an empty table gives no row.  Texts of any length are
    read whole.  The middle half comes from approximate percentiles of the group, to 1/1000 of its texts.
    """
    measured = cut_lineage(
        _measured(docs, F.col(text_col), F.col(lang_col), vocabulary, F.col(id_col).alias("doc_id"))
    )
    judged = _judged(measured, bands(measured, fences), slack, few)
    return judged.select("doc_id", *COUNTS, *MEASURES, "base_failed", "kept", "reason")


def keep_good(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary: str = "piece_bpe_32k.model",
    fences: float = 2.0,
    slack: float = 0.01,
    few: float = 0.15,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Texts are measured once.  Measures are written down without the texts; rows then lose those whose 128-bit hash of
    language and text is among the rejected, as the verdict depends on nothing else.  Rejected hashes are sent to
    all tasks if they are at most ``broadcast_rows``; beyond that the rows are shuffled to them.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    name = F.coalesce(F.concat(F.lit("="), lang), F.lit(""))
    keys = [F.xxhash64(name, text).alias("_h1"), F.xxhash64(F.lit(1), name, text).alias("_h2")]
    measured = write_down(_measured(docs, text, lang, vocabulary, F.struct(*keys).alias("_key")))
    judged = _judged(measured, bands(measured, fences), slack, few)
    rejected = cut_lineage(judged.where("not kept").select("_key.*").distinct())
    if rejected.count() <= broadcast_rows:
        rejected = F.broadcast(rejected)
    return docs.select(F.struct("*").alias("_row"), *keys).join(rejected, ["_h1", "_h2"], "left_anti").select("_row.*")
