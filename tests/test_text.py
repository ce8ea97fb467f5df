import html
import random
from html.entities import html5
from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinionmill.functions import text as T
from opinionmill.functions.contractions import CONTRACTIONS, expand_contractions
from opinionmill.functions.entities import decode_entities

from .conftest import executed_plan

CLEANED = [
    ("hello !", "hello!"),
    ("4k", "4 k"),
    ("great!Next", "great! Next"),
    ("ok. then", "ok. Then"),
    ("I'm here", "I am here"),
    ("U'd go", "you would go"),
    ("isnt", "is not"),
    ("Isnt", "Isnt"),
    ("U.S.", "you. S."),
    ("&lt;b&gt;x", "x"),
    ("a<br>b", "a b"),
    ("a < b\n> c", "a  b  c"),
    ("cafÃ©", "café"),
    ("Stathamâ€™s", "Stathamâs"),
    ("x😀*", "x😀*"),
    ("x*😀", "x"),
    ("it’s", "its"),
    (" wide  gap ", "wide gap"),
    ("1st and A.B.", "1 st and A. B."),
    ("", ""),
    (None, ""),
]


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")


def run(spark, values, fn):
    out = texts(spark, values).select("i", fn(F.col("t")).alias("o")).collect()
    return [row["o"] for row in sorted(out, key=lambda row: row["i"])]


def test_cleaning_cases(spark):
    rows = T.clean_text(texts(spark, [a for a, _ in CLEANED]), "t", "o").collect()
    assert {row["t"]: row["o"] for row in rows} == dict(CLEANED)


def test_cleaning_is_one_native_pass(spark):
    plan = executed_plan(T.clean_text(texts(spark, ["a"]), "t"))
    assert "Python" not in plan and "Exchange" not in plan
    assert plan.count("1F600") == 1


# ---- the rules again, character by character ------------------------------


def is_word(ch):
    return ch.isalnum() or ch == "_"


def naive_contractions(s):
    for short, full in CONTRACTIONS.items():
        out, at = "", 0
        while (hit := s.find(short, at)) >= 0:
            end = hit + len(short)
            before = hit == 0 or not is_word(s[hit - 1])
            after = end == len(s) or not is_word(s[end])
            if before and after:
                out, at = out + s[at:hit] + full, end
            else:
                out, at = out + s[at:hit + 1], hit + 1
        s = out + s[at:]
    return s


def naive_tighten(s):
    out = ""
    for ch in s:
        out = (out.rstrip() if ch in ".,;:!?" else out) + ch
    return out


def naive_pairs(s, first, second):
    out = ""
    for ch in s:
        out += (" " if out and first(out[-1]) and second(ch) else "") + ch
    return out


def naive_capitalise(s):
    out = ""
    for ch in s:
        bare = out.rstrip()
        if "a" <= ch <= "z" and bare != out and bare and bare[-1] in ".!?":
            out, ch = bare + " ", ch.upper()
        out += ch
    return out


EMOJI = [
    (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F700, 0x1FAFF - 0x80), (0x1FA00, 0x1FAFF),
    (0x2702, 0x27B0), (0x24C2, 0x1F251),
]


def naive_symbols(s):
    def junk(ch):
        return not (is_word(ch) or ch.isspace() or ch in '.,;:!?/"-')

    out = ""
    for is_junk, chars in groupby(s, junk):
        chunk = "".join(chars)
        if not is_junk or any(a <= ord(chunk[0]) <= b for a, b in EMOJI):
            out += chunk
    return out


def naive_clean(s):
    s = html.unescape(s.strip())
    try:
        s = bytes(map(ord, s)).decode("utf-8")
    except ValueError:
        pass
    lines = []
    for line in s.split("\n"):
        while (a := line.find("<")) >= 0 and (b := line.find(">", a)) >= 0:
            # The rest of the line is scanned after the tag only, so keep what was done.
            lines_done, line = line[:a] + " ", line[b + 1:]
            lines.append((lines_done, ""))
        lines.append((line, "\n"))
    s = "".join(a + b for a, b in lines)[:-1]
    s = " ".join(naive_contractions(s).split())
    s = naive_tighten(s)
    s = naive_pairs(s, str.isdecimal, lambda c: c.isascii() and c.isalpha())
    s = naive_pairs(s, lambda c: c in ".!?", lambda c: "A" <= c <= "Z")
    return naive_symbols(naive_capitalise(s)).strip()


PIECES = (
    list(CONTRACTIONS)
    + ["u", "U'd", "u'll", "y'u", "Ã©", "é", "½", "_", "4", "k", "Z", ".", "!", "?", ",", ";", " ", "  ", "\n", "\t"]
    + [" ", " ", "😀", "*", "(", ")", "'", "’", "/", '"', "-", "<i>", "<", ">", "&amp;", "&", "&lt;", "☂", "✂", "ⓜ"]
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=60, max_size=120))
def test_cleaning_equals_the_rules(spark, values):
    rows = T.clean_text(texts(spark, values), "t", "o").collect()
    assert [(r["t"], r["o"]) for r in rows if r["o"] != naive_clean(r["t"])] == []


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=30), min_size=60, max_size=120))
def test_symbols_and_spaces_on_any_text(spark, values):
    values = [v.encode("utf-8", "ignore").decode("utf-8") for v in values]
    assert run(spark, values, T.collapse_space) == [" ".join(v.split()) for v in values]
    assert run(spark, values, T.strip_space) == [v.strip() for v in values]


def test_all_contractions(spark):
    values = [f"{k}, x{k} {k}" for k in CONTRACTIONS]
    assert run(spark, values, expand_contractions) == [naive_contractions(v) for v in values]


def test_entities_equal_the_standard(spark):
    rng = random.Random(7)
    names = list(html5)
    numbers = [0, 7, 11, 13, 38, 127, 128, 129, 159, 233, 0xD800, 0xFDD0, 0xFEFF, 0xFFFE, 0x1FFFF, 128512, 0x110000, 10**14]

    def piece():
        name, number, end = rng.choice(names), rng.choice(numbers), rng.choice(["", ";", "x"])
        forms = ["&" + name, "&" + name.rstrip(";") + end, f"&#{number}{end}", f"&#x{number:x}{end}", f"&#X{number:X};"]
        return rng.choice(forms + ["a", "& ", "&&amp;", "&amp;lt;", "\n", "&#", "&#x;", "&notit;", "&am"])

    values = ["&" + name for name in names] + ["".join(piece() for _ in range(4)) for _ in range(2000)]
    got = run(spark, values, decode_entities)
    assert [(v, g) for v, g in zip(values, got) if g != html.unescape(v)] == []


@pytest.mark.parametrize("step", T.CLEANING_STEPS)
def test_each_step_keeps_null(spark, step):
    assert run(spark, [None, "plain"], step) == [None, "plain"]
