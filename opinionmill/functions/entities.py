"""HTML character references decoded with column expressions only."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionary import Dictionary
from .patterns import prefix_tree

# A reference as HTML5 reads it: decimal, hexadecimal, or a run that may hold a name.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

# Names that HTML5 also accepts without the closing semicolon.
_OPEN_NAMES = sorted(name for name in html5 if not name.endswith(";"))

_REPLACEMENT = "�"
_BOM = 0xFEFF


def _remapped_code_points() -> dict[str, str]:
    """Numeric references that HTML5 reads as Windows-1252 bytes, NUL or CR."""
    remapped = {"0": _REPLACEMENT, "13": "\r"}
    for code in range(0x80, 0xA0):
        remapped[str(code)] = bytes([code]).decode("cp1252", errors="ignore") or chr(code)
    return remapped


def _code_point(token: Column) -> Column:
    """The number in a numeric reference; anything too long is past the last code point."""
    decimal = F.regexp_extract(token, r"^&#0*([0-9]*)", 1)
    hexadecimal = F.regexp_extract(token, r"^&#[xX]0*([0-9a-fA-F]*)", 1)
    beyond = F.lit(0x110000)
    of_hex = F.when(F.length(hexadecimal) > 6, beyond).otherwise(
        F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10).cast("int")
    )
    of_decimal = F.when(F.length(decimal) > 7, beyond).otherwise(
        F.concat(F.lit("0"), decimal).cast("int")
    )
    return F.when(token.rlike(r"^&#[xX]"), of_hex).otherwise(of_decimal)


def _character(code: Column) -> Column:
    """The text of a code point, following the HTML5 rules for invalid ones."""
    remapped = Dictionary.of(_remapped_code_points())
    dropped = (
        code.between(0x1, 0x8)
        | (code == 0xB)
        | code.between(0xE, 0x1F)
        | code.between(0x7F, 0x9F)
        | code.between(0xFDD0, 0xFDEF)
        | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    utf32 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(
        remapped.get(code.cast("string")),
        F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit(_REPLACEMENT))
        .when(dropped, F.lit(""))
        .when(code == _BOM, F.lit(chr(_BOM)))
        .otherwise(utf32),
    )


def _decode_one(token: Column) -> Column:
    names = Dictionary.of(html5)
    open_names = Dictionary.of({name: html5[name] for name in _OPEN_NAMES})
    name = F.substring(token, 2, 64)
    open_name = F.regexp_extract(token, "^&(" + prefix_tree(_OPEN_NAMES) + ")", 1)
    rest = token.substr(F.length(open_name) + 2, F.length(token))
    numeric = F.when(token.startswith("&#"), _character(_code_point(token)))
    return F.coalesce(numeric, names.get(name), F.concat(open_names.get(open_name), rest), token)


def decode_entities(text: Column) -> Column:
    """Replace every HTML character reference in ``text``, once."""
    gaps = F.split(text, _REFERENCE, -1)
    tokens = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    decoded = F.array_join(
        F.zip_with(
            gaps,
            tokens,
            lambda gap, token: F.when(token.isNull(), gap).otherwise(F.concat(gap, _decode_one(token))),
        ),
        "",
    )
    return F.when(text.contains("&"), decoded).otherwise(text)
