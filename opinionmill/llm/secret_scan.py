"""Secret scan: keyword prefilter, anchored patterns near the hits, checksums inside the secrets.

An Aho-Corasick automaton finds all keywords in one pass over the lower-cased text; a pattern is tried only where
its keyword stands.  Runs of hexadecimal digits have no keyword and are found by their own pattern.  Token formats
with an embedded checksum or structure count only if that checks out.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import LOWER_TEXT, slices

# Kinds in the order that sorts spans with the same start.
BASE_KINDS = ("assign", "access", "hex")
KINDS = BASE_KINDS + ("github", "npm", "jwt", "private_key", "google", "stripe", "slack")

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Keywords in lower case; the pattern is anchored at the keyword; ``valid`` judges the match.

    ``run`` is given where a keyword may stand again in the characters that the pattern begins with: what follows this
    run decides, so when one start in it has failed the others fail too and are not tried.
    """

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool] = lambda m: True
    run: re.Pattern | None = None


def base62_crc32(secret: str) -> bool:
    """The last six characters are the CRC-32 of the part between the prefix and them, in base 62."""
    body = secret.rpartition("_")[2]
    number, own = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        own = BASE62[digit] + own
    return own == body[-6:]


def json_web_token(token: str) -> bool:
    """The first part is base 64 of a JSON object with an algorithm."""
    head = token.split(".")[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(found, dict) and "alg" in found


RULES = (
    Rule(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
        ),
        lambda m: len(m[2]) >= 8,
    ),
    Rule("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    Rule(
        "github",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
        lambda m: base62_crc32(m[0]),
    ),
    Rule("npm", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: base62_crc32(m[0])),
    Rule(
        "jwt",
        ("eyj",),
        re.compile(r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+"),
        lambda m: json_web_token(m[0]),
        re.compile(r"eyJ[A-Za-z0-9_-]*"),
    ),
    Rule("private_key", ("-----begin ",), re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")),
    Rule("google", ("aiza",), re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")),
    Rule("stripe", ("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{24,}")),
    Rule("slack", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), re.compile(r"xox[bpar]-[0-9]{8,}-[A-Za-z0-9-]{8,}")),
)
HEX = re.compile(r"[0-9a-f]{32,}")

_AUTOMATA: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    """The keywords of all rules; built once per Python worker."""
    if not _AUTOMATA:
        built = ahocorasick.Automaton()
        for i, rule in enumerate(RULES):
            for word in rule.keywords:
                built.add_word(word, (i, len(word)))
        built.make_automaton()
        _AUTOMATA.append(built)
    return _AUTOMATA[0]


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and kind; per kind leftmost and without overlaps."""
    hits: dict[int, list[int]] = {}
    for last, (rule, length) in automaton().iter(text.translate(LOWER_TEXT) if not text.isascii() else text.lower()):
        hits.setdefault(rule, []).append(last - length + 1)
    spans = []
    for i, starts in hits.items():
        rule, free = RULES[i], 0
        for start in sorted(starts):
            if start < free:
                continue
            if m := rule.pattern.match(text, start):
                free = m.end()
                if rule.valid(m):
                    spans.append((rule.kind, m.start(), m.end()))
            elif rule.run and (passed := rule.run.match(text, start)):
                free = passed.end()
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def span_column(text: Column) -> Column:
    """The spans of a text as an array of structs ``kind, start, end``."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind: string, start: long, end: long>>")
    def found(column: pa.Array) -> pa.Array:
        rows = [
            [{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(t)] for texts in slices(column) for t in texts
        ]
        return pa.array(rows, type=kind)

    return found.asNondeterministic()(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, an array of ``kind, start, end``.

    Null texts are empty, null and repeated ids stay, other columns are ignored; an empty table gives no rows.  Very
    long texts are read whole, in time that grows with their length.
    """
    return docs.select(F.col(id_col).alias("doc_id"), span_column(F.col(text_col)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _is(kind: str):
    return lambda span: span["kind"] == kind


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans, from ``scan_secrets``."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return scanned.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
