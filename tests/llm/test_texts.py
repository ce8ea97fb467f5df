"""Packing, quality, scans, personal data and decontamination against brute force or held-out rows."""

import base64
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinionmill.llm import chat, decontamination, license_scan, packing, pii, quality_model, quality_rules, queries, secret_scan, texts
from opinionmill.llm.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, lang string, spans string, s string, n_words string, score string, _m string"
ODD = [None, "", " \n\t", "x", "İstanbul ǅ ﬁ   á 日本語", "<|endoftext|> don't a b 12,5", "a" * 5000, "é! " * 3000, "1" * 6000, "a." * 4000]


def docs_of(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)


def wide(spark, texts):
    rows = [(i, t, None, "x", "x", "x", "x", "x") for i, t in enumerate(texts)] + [(None, "null id", "en", *"xxxxx"), (0, texts[0], None, *"xxxxx")]
    return spark.createDataFrame(rows, WIDE)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_packing_round_trip(spark, documents):
    texts = ODD + [r["text"] for r in documents.limit(60).collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    rows = packing.pack(docs_of(spark, texts), longest=256).collect()
    for r in sorted(rows, key=lambda r: r["start"]):
        pieces.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = pieces[i]
        assert [x for p in own for x in p["ids"]] == ids
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        for p in own:
            raw = b"".join(x.to_bytes(4, "little") for x in p["ids"])
            assert p["ids_crc32"] == zlib.crc32(raw) and p["doc_tokens"] == len(ids) and p["offset"] == 0
            assert p["length"] == len(p["ids"]) <= 256 and p["length"] & (p["length"] - 1) == 0


def test_packing_edges(spark):
    assert packing.pack(docs_of(spark, [])).count() == 0
    assert packing.pack(wide(spark, ODD)).where("doc_id is null").count() >= 1
    assert packing.piece_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1]
    with pytest.raises(ValueError):
        packing.pack(docs_of(spark, []), longest=100)


def slow_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_match_brute_force(spark, documents):
    texts = ODD + [r["text"] for r in documents.collect()] + ["a b c d e f g h " * 3, "x y\nx y\n\n\nx  y"]
    rows = quality_rules.quality_rules(docs_of(spark, texts).withColumn("lang", F.lit(None).cast("string"))).collect()
    for r in rows:
        expected = slow_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r["base_failed"] and r["kept"])


def slow_verdicts(rows, texts, langs):
    """``doc_id`` to reason, by lists: quartiles are the smallest values with a quarter, half, three quarters at or below."""
    measured = [r.asDict() | {"class": int(math.log2(max(1, r["n_tokens"])))} for r in rows]
    for r in measured:
        r["script"] = quality_rules.script(texts[r["doc_id"]] or "")
        r["lang"] = langs[r["doc_id"]] or f"script:{r['script']}"
    seen = {(r["lang"], texts[r["doc_id"]]): r for r in measured if r["n_tokens"]}.values()

    def group_of(r, m):
        near = [x for x in seen if abs(x["class"] - r["class"]) <= 1]
        levels = [
            [x for x in seen if (x["lang"], x["class"]) == (r["lang"], r["class"])],
            [x for x in near if x["lang"] == r["lang"]],
            [x for x in near if x["script"] == r["script"]],
            [x for x in seen if x["script"] == r["script"] and m != "token_entropy"],
        ]
        return next((sorted(x[m] for x in g) for g in levels if len(g) >= quality_rules.ENOUGH), None)

    out = {}
    for r in measured:
        reason = "base" if r["base_failed"] else None
        for m in quality_rules.MEASURES if reason is None and r["n_tokens"] else ():
            values = group_of(r, m)
            if values is None:
                continue
            low, mid, high = (values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.5, 0.75))
            extra = mid * (0.01 + 0.15 / math.sqrt(len(values)))
            below, above = r[m] < low - 2.0 * (high - low) - extra, r[m] > high + 2.0 * (high - low) + extra
            beyond = {"chars_per_token": below or above, "byte_share": above and r["n_byte_tokens"] >= 3, "token_entropy": below}
            if beyond[m]:
                reason = m
                break
        out[r["doc_id"]] = reason
    return out


def test_quality_verdicts_match_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()
    noise = random.Random(7)
    junk = [" ".join("".join(noise.choices("bcdfghjklmnpqrstvwxz\u0416\u4e2d\u00e9", k=9)) for _ in range(n)) for n in (60, 61, 900)]
    texts = ODD + [r["text"] for r in rows] + junk + [rows[0]["text"]] * 3 + ["the same few words again " * 4 + rows[0]["text"]]
    langs = [None] * len(ODD) + [r["lang"] for r in rows] + ["rare", None, "rare"] + ["en", "rare", None, "en"]
    frame = spark.createDataFrame(list(zip(range(len(texts)), texts, langs)), "doc_id long, text string, lang string")
    judged = quality_rules.quality_rules(frame).collect()
    expected = slow_verdicts(judged, texts, langs)
    assert {r["doc_id"]: r["reason"] for r in judged} == expected
    assert all(r["kept"] == (r["reason"] is None) for r in judged)
    first = len(ODD) + len(rows)
    # Two junk texts of a language with no other texts are judged with their script.
    assert expected[first] == expected[first + 2] == "chars_per_token"
    for limit in (500_000, 0):
        kept = {r["doc_id"] for r in quality_rules.keep_good(frame, broadcast_rows=limit).select("doc_id").collect()}
        assert kept == {i for i, reason in expected.items() if reason is None}


def test_quality_keeps_good_and_rejects_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.quality_rules(docs).join(labels, "doc_id").where("not base_failed")
    share = {r["quality"]: r["share"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.98 and share[0] < share[1]


def test_quality_stage_keeps_columns(spark):
    frame = wide(spark, ODD + ["one two three four five " * 10])
    assert quality_rules.keep_good(frame).columns == frame.columns
    assert quality_rules.keep_good(wide(spark, ODD).limit(0)).count() == 0
    assert quality_rules.quality_rules(wide(spark, ODD)).count() == len(ODD) + 2


def test_repeated_words_settles_equal_hashes_exactly():
    words = [b"a", b"b"] * 10
    assert quality_rules.repeated_words(words) == slow_rules(" ".join("ab" * 10))[4] == 20


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scores = quality_model.quality_scores(docs, labels)
    rows = scores.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert sum(g > b for g in good for b in bad) > 0.9 * len(good) * len(bad)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def slow_features(text, settings):
    """The buckets of every n-gram, one by one, with whole numbers."""
    mask, prime, golden = (1 << 64) - 1, 0x100000001B3, 0x9E3779B97F4A7C15

    def bucket(h):
        h = (h ^ h >> 29) * golden & mask
        return (h ^ h >> 32) % settings.buckets

    blanks = " \t\n\v\f\r"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    codes = [(sum(ord(c) * pow(prime, i % 64 + 1, 1 << 64) for i, c in enumerate(w)) + 1) & mask for w in words]
    out = [bucket(c) for c in codes]
    for n in settings.word_ngrams:
        for i in range(len(codes) - n + 1):
            h = n
            for c in codes[i : i + n]:
                h = (h * golden + c) & mask
            out.append(bucket(h))
    padded = "".join(" " if c in blanks else c for c in f" {text} ")
    for n in settings.ngrams if words else ():
        for i in range(len(padded) - n + 1):
            part = padded[i : i + n]
            if " " in part[1:-1]:
                continue
            h = n
            for c in part:
                h = (h * prime + ord(c)) & mask
            out.append(bucket(h))
    return sorted(out)


def test_classifier_matches_brute_force(spark):
    settings = quality_model.Settings(buckets=1 << 12, epochs=1)
    for text in [t or "" for t in ODD[:6]] + ["The the cat  sat.\n on " + "w" * 70, "a b c a b c"]:
        assert sorted(quality_model.features(text, settings).tolist()) == slow_features(text, settings)
    # One step: softmax of the mean vector, its gradient to vectors, layer and bias.
    index, share = np.array([3, 9]), np.array([0.25, 0.75], dtype=np.float32)
    for label in (0, 1):
        model = quality_model.fit([(index, share, label)], settings)
        random_ = np.random.default_rng(settings.seed)
        start = random_.uniform(-1, 1, (settings.buckets, settings.dimensions)).astype(np.float32) / settings.dimensions
        bias = np.log([(1 + (label == c)) / 3 for c in (0, 1)])
        error = np.exp(bias) / np.exp(bias).sum() - np.eye(2)[label]
        mean = 0.25 * start[3] + 0.75 * start[9]
        assert np.allclose(model.layer, -settings.rate * np.outer(mean, error), atol=1e-6)
        assert np.allclose(model.bias, bias - 0.01 * settings.rate * error, atol=1e-6)
    model = quality_model.fit([(index, share, 1), (np.array([9, 11]), np.array([0.5, 0.5], dtype=np.float32), 0)], settings)
    texts = ["some words here", "", "x y z x y z"]
    scored = docs_of(spark, texts).select("doc_id", quality_model.score_column(F.col("text"), model, settings).alias("s")).collect()
    for r in scored:
        own = slow_features(texts[r["doc_id"]], settings)
        z = (model.vectors[own].astype(float).mean(axis=0) if own else np.zeros(16)) @ model.layer + model.bias
        assert abs(r["s"] - np.exp(z[1]) / np.exp(z).sum()) < 1e-5


def test_classifier_learns_one_text_per_id(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = [(i, f"{'good' if i % 2 else 'bad'} text {k}") for i in range(40) for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    settings = quality_model.Settings(buckets=1 << 10)
    models = [quality_model.train(f, labels, "doc_id", "text", "quality", settings) for f in (frame, frame.repartition(7).unionByName(frame))]
    assert np.array_equal(models[0].vectors, models[1].vectors) and np.array_equal(models[0].layer, models[1].layer)


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (2, None)], "doc_id long, quality int")
    rows = quality_model.quality_scores(wide(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) + 2 and {r["score"] for r in rows} == {0.5}
    assert quality_model.quality_scores(wide(spark, ODD).limit(0), labels).count() == 0
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def slow_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def github(body):
    number, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        tail = secret_scan.BASE62[digit] + tail
    return f"ghp_{body}{tail}"


def web_token(head):
    return base64.urlsafe_b64encode(head.encode()).decode().rstrip("=") + ".eyJhIjoxfQ.c2ln"


def test_added_secrets_are_found():
    npm = "npm_" + github("a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5")[4:]
    good = {
        "npm": npm, "jwt": web_token('{"alg":"none"}'), "private_key": "-----BEGIN RSA PRIVATE KEY-----", "google": "AIza" + "aB3_-" * 7,
        "stripe": "sk_live_" + "a1B2" * 6, "slack": "xoxb-12345678-abcdEFGH",
    }
    for kind, secret in good.items():
        assert ("x " + secret, [kind]) == ("x " + secret, [k for k, s, e in secret_scan.secret_spans("x " + secret) if (s, e) == (2, 2 + len(secret))])
    bad = [npm[:-1] + ("a" if npm[-1] != "a" else "b"), web_token('{"no":1}'), "-----BEGIN PUBLIC KEY-----", "AIza" + "a" * 30, "sk_live_abc", "xoxb-12-ab"]
    for text in bad:
        assert not [k for k, *_ in secret_scan.secret_spans(text) if k in good]


def test_web_tokens_like_a_plain_pattern():
    rng, good = random.Random(5), web_token('{"alg":"none"}')
    for _ in range(400):
        text = "".join(rng.choices(["eyJ", "eyj", ".", "a", "-", " ", good, "EYJ"], k=rng.randint(1, 14)))
        plain = [m.span() for m in re.finditer(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", text) if secret_scan.json_web_token(m[0])]
        assert [(s, e) for k, s, e in secret_scan.secret_spans(text) if k == "jwt"] == plain


def test_secrets_of_very_long_texts_take_linear_time():
    good = web_token('{"alg":"none"}')
    for text in ("eyJ" * 400_000, "eyJ." * 300_000, "eyJa.eyJb." * 100_000 + " ", "token " * 200_000, "AKIA" * 250_000, "-----BEGIN " * 90_000, "xoxb-" * 200_000):
        begun = time.time()
        spans = secret_scan.secret_spans(text + " " + good)
        assert ("jwt", len(text) + 1, len(text) + 1 + len(good)) in spans and time.time() - begun < 10


def test_secrets_match_brute_force(spark, documents):
    good = github("a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5")
    rng = random.Random(2)
    parts = ["token", "secret", "=", ": ", '"', "abcdefgh12", "AKIA", "AKIAABCDEFGH1234", "é", "0" * 40, "PassWd", "api_key", "ſecret", " "]
    texts = ODD + [r["text"] for r in documents.collect()] + ["".join(rng.choices(parts, k=30)) for _ in range(200)] + [f"x {good} {good[:-1]}_ y"]
    rows = secret_scan.digest(secret_scan.scan_secrets(docs_of(spark, texts))).collect()
    for r in rows:
        base = slow_secrets(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert r["n_assign"] == sum(k == "assign" for k, _, _ in base)
    assert f"github:2:{2 + len(good)}" in rows[-1]["spans"] and rows[-1]["spans"].count("github") == 1
    assert secret_scan.scan_secrets(wide(spark, ODD)).count() == len(ODD) + 2
    assert secret_scan.scan_secrets(wide(spark, ODD).limit(0)).count() == 0


def slow_licenses(text):
    """Every block of every template word by word, then the decision pair by pair."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    labels = {label for _, label in places}
    met = []
    for number, (notice, label) in enumerate(license_scan.TEMPLATES):
        own = re.findall(r"[a-z0-9]+", notice.lower())
        if (notice, label) in license_scan.SHORT:
            met += [((0, -1.0, -label.count("-"), -len(own), i), number, label, i, i + len(own)) for i in range(len(words)) if words[i : i + len(own)] == own]
            continue
        shares = [0.0] + [len(set(words[max(0, end - len(own)) : end]) & set(own)) / len(set(own)) for end in range(1, len(words) + 1)] + [0.0]
        end = 1
        while end < len(shares):
            run = end
            while shares[end] >= 0.8 - 1e-9:
                end += 1
            if end > run:
                best = max(range(run, end), key=lambda e: (shares[e], -e))
                start = max(0, best - len(own))
                met.append(((1, -shares[best], 0, start - best, start), number, label, start, best))
            end += 1
    for family in license_scan.FAMILIES:
        taken = []
        for m in sorted(x for x in met if x[2] in family):
            if all(m[3] >= t[4] or t[3] >= m[4] for t in taken) or taken[-1][0] == m[0]:
                taken.append(m)
                labels.add(m[2])
    labels |= {m[2] for m in met if not any(m[2] in family for family in license_scan.FAMILIES)}
    return len(words), places, sorted({label for _, label in places}), sorted(labels)


def test_license_places_match_brute_force():
    rng = random.Random(8)
    frequency = {w: rng.randrange(5) for notice, _ in license_scan.TEMPLATES for w in license_scan.words_of(notice)}
    index = license_scan.Index.build(license_scan.TEMPLATES, frequency, 0.8)
    for _ in range(150):
        words = []
        for notice, _ in rng.choices(license_scan.TEMPLATES, k=3) + rng.choices(license_scan.NOTICES, k=3):
            words += [w for w in notice.split() if rng.random() > 0.06] + rng.choices(["x", "license", "by", "cc", "under", "the", "nc"], k=rng.randrange(9))
        text = " ".join(words)
        assert license_scan._scan(text, index)["labels"] == slow_licenses(text)[3], text


def test_licenses_of_separate_places_all_count():
    index = license_scan.Index.build(license_scan.TEMPLATES, {}, 0.8)
    notice = {label: text for text, label in license_scan.NOTICES}
    labels = lambda text: license_scan._scan(text, index)["labels"]
    assert labels(notice["cc-by-nc"].replace("Commons", "Common") + " and then " + notice["cc-by-sa"]) == ["cc-by-nc", "cc-by-sa"]
    assert labels("Licensed under CC BY 4.0. Some text. " + notice["cc-by-nc-sa"]) == ["cc-by", "cc-by-nc-sa"]
    assert labels(notice["agpl"]) == ["agpl", "gpl"] and labels(notice["lgpl"]) == ["gpl", "lgpl"] and labels(notice["gpl"]) == ["gpl"]
    for line, label in {"SPDX-License-Identifier: MIT": "mit", "Apache-2.0": "apache", "GPL-2.0-only": "gpl", "the 3-clause BSD License": "bsd", "SPDX-License-Identifier: ISC": "isc",
                        "Eclipse Public License": "epl", "Mozilla Public License": "mpl", "Boost Software License 1.0": "boost", "The Unlicense": "unlicense"}.items():
        assert labels(line) == [label]


def test_licenses_match_brute_force(spark, documents):
    notice = dict(map(reversed, license_scan.NOTICES))["bsd"]
    cut = " ".join(w for i, w in enumerate(notice.split()) if i not in (3, 9))
    texts = ODD + [r["text"] for r in documents.collect()] + [f"intro\n{cut.upper()}\nend", notice[: len(notice) // 2], "mit mit license license general public license", "released the mit\nunder license x"]
    rows = license_scan.digest(license_scan.scan_licenses(docs_of(spark, texts))).collect()
    for r in rows:
        n, places, base, labels = slow_licenses(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["base_labels"], r["labels"]) == (n, len(places), ",".join(base), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
    assert license_scan.scan_licenses(wide(spark, ODD)).count() == len(ODD) + 2
    assert license_scan.scan_licenses(wide(spark, ODD).limit(0)).count() == 0


def test_creative_commons_family(spark):
    lines = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under CC BY 4.0.": "cc-by", "cc-by-sa-3.0": "cc-by-sa", "(CC BY-NC-SA)": "cc-by-nc-sa",
        "licensed under CC BY": "cc-by", "under a CC BY license": "cc-by", "CC BY-ND 2.0": "cc-by-nd", "CC0": "cc0", "CC 0 1.0 Universal": "cc0", "CC BY-NC-ND": "cc-by-nc-nd",
        "https://creativecommons.org/licenses/by-nc/4.0/": "cc-by-nc", "http://creativecommons.org/publicdomain/zero/1.0/": "cc0",
        "Creative Commons Attribution-NonCommercial 4.0": "cc-by-nc", "Creative Commons Attribution Share Alike": "cc-by-sa", "Creative Commons Zero": "cc0",
        "Sent to Ann, cc by Friday": "", "0.5 cc 0.3 ml": "", "commons by sa": "",
    }
    lines |= {text: label for text, label in license_scan.TEMPLATES if label.startswith("cc")}
    lines |= {text.replace("Creative", "Creativ"): label for text, label in license_scan.NOTICES if label.startswith("cc-by") and "Creative" in text}
    rows = license_scan.digest(license_scan.scan_licenses(docs_of(spark, list(lines)))).collect()
    assert {list(lines)[r["doc_id"]]: r["labels"] for r in rows} == lines
    assert all((r["score"] > 0) == bool(r["labels"]) for r in rows)
    mine = license_scan.scan_licenses(docs_of(spark, list(lines)), templates=license_scan.TEMPLATES[:5])
    assert mine.where("size(labels) > 0").count() == 0


def luhn(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


def slow_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(x) < 4000 and int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def test_personal_data_matches_brute_force(spark, documents):
    rng = random.Random(4)
    parts = list("0123456789") * 3 + [".", "-", " ", "+", "(", ")", "@", "a", "mail", "x.y", "é", "+1 (017) 555-7713", "4111111111111111", "10.0.0.1", "a@b.c", "00255", "日"]
    texts = ODD + [r["text"] for r in documents.collect()] + ["".join(rng.choices(parts, k=40)) for _ in range(300)]
    found = pii.find_personal_data(docs_of(spark, texts))
    rows = pii.digest(found).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = slow_pii(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest(), texts[r["doc_id"]]
        assert set(joined(base).split(",")) - {""} <= set(r["spans"].split(","))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_personal_data_finds_local_phones_and_accounts(spark):
    rng = random.Random(9)
    texts, planted = [], []
    for i in range(200):
        number = f"4{rng.randrange(10**14):014d}"
        card = next(f"{number}{d}" for d in range(10) if luhn(f"{number}{d}"))
        text = f"mail a{i}@b.cc or call +49 30 {rng.randrange(1000, 9999)} 5678, card {card}, on 2024-01-{i % 28 + 1:02d} sold {i + 10} of {rng.randrange(100, 99999)} items"
        marks = []
        for kind, token in (("local_phone", f"030 {rng.randrange(1000, 9999)} 5678"), ("local_phone", f"555-{rng.randrange(100, 999)}-4567"), ("account", str(rng.randrange(10**9, 10**13)))):
            text += f", {'phone' if kind == 'local_phone' else 'account'} "
            marks.append((kind, len(text), len(text) + len(token)))
            text += token
        texts.append(text)
        planted.append(marks)
    rows = pii.find_personal_data(docs_of(spark, texts)).collect()
    for r in rows:
        spans = {tuple(s) for s in r["spans"]}
        assert set(planted[r["doc_id"]]) <= spans and len(spans) == 6, (texts[r["doc_id"]], spans)


def test_personal_data_leaves_dates_amounts_versions_and_codes(spark):
    rng, texts = random.Random(10), []
    for i in range(300):
        plain = [f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}", f"{i % 28 + 1}.{i % 12 + 1}.19{i % 90 + 10}", f"1.{rng.randrange(100, 999)}.{rng.randrange(100, 999)},00", f"v 3.{i}.1",
                 f"AB-{rng.randrange(10**6, 10**9)}", f"{rng.randrange(16**40):040x}"]
        rng.shuffle(plain)
        texts.append(f"write to x{i}@y.org or +44 20 7946 {rng.randrange(1000, 9999)}; " + "; ".join(plain))
    rows = pii.find_personal_data(docs_of(spark, texts)).collect()
    base = {r["doc_id"]: {s for s in slow_pii(texts[r["doc_id"]])} for r in rows}
    extra = sum(len({tuple(s) for s in r["spans"]} - base[r["doc_id"]]) for r in rows)
    assert extra <= 0.02 * sum(len(r["spans"]) for r in rows)


def test_personal_data_of_very_long_texts_takes_linear_time(spark):
    lists, mixed = "12, " * 250_000, "a@b.cc, +49 30 1234 5678; 030 1234 5678 / " * 12_000
    frame = docs_of(spark, [lists, mixed])
    begun = time.time()
    rows = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame).collect()}
    assert rows[0] == [] and [tuple(s) for s in rows[1] if s["kind"] in pii.BASE_KINDS] == slow_pii(mixed)
    spans = F.array(*[F.struct(F.lit("x").alias("kind"), F.lit(k).alias("start"), F.lit(e).alias("end")) for k, e in ((0, 2), (4, 9), (6, 10), (7, 8), (10, 12))])
    assert frame.where("doc_id = 0").select(pii.redacted(F.col("text"), spans).alias("r")).first()["r"] == "[x], [x][x]" + lists[12:]
    every = F.transform(F.sequence(F.lit(0), F.lit(249_999)), lambda i: F.struct(F.lit("n").alias("kind"), (i * 4).alias("start"), (i * 4 + 2).alias("end")))
    assert frame.where("doc_id = 0").select(pii.redacted(F.col("text"), every).alias("r")).first()["r"] == "[n], " * 250_000
    assert time.time() - begun < 90


def test_personal_data_edges_and_redaction(spark):
    assert pii.find_personal_data(wide(spark, ODD)).count() == len(ODD) + 2
    assert pii.find_personal_data(wide(spark, ODD).limit(0)).count() == 0
    frame = docs_of(spark, ["é mail a@b.cc or +1 555 1234 567.", "plain"])
    out = frame.join(pii.find_personal_data(frame), "doc_id").select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("r"))
    assert dict(map(tuple, out.collect())) == {0: "é mail [email] or [phone].", 1: "plain"}


ITEM = "If Alice has 12 apples and gives Bob 5 apples then how many apples does Alice keep after walking 3 miles home"


def test_leaks(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "short question here is it"), (3, None), (None, "another question about the colour of the sky in spring mornings")], "item_id long, text string")
    other = ITEM.replace("12", "77").replace("Alice", "Maria").replace("Bob", "Peter").replace(" 5 ", " 9 ")
    broken = other.replace("does Maria", "does Karl").replace("If Maria", "If Otto")
    texts = [f"Some words before. {ITEM} and after.", f"Intro text. {other}. More", broken, "Nothing to see here at all, move on please now", None, "", " ".join(ITEM.split()[:9]),
             "pre short question here is it post", "x. another question about the colour of the sky in spring mornings"]
    rows = {(r["doc_id"], r["item_id"]): r["other_slots"] for r in decontamination.find_leaks(docs_of(spark, texts), bench).collect()}
    assert rows == {(0, 1): False, (1, 1): True, (7, 2): False, (8, None): False}
    blocks = decontamination.find_leaks(docs_of(spark, texts), bench, block_bytes=20).collect()
    assert {(r["doc_id"], r["item_id"]): r["other_slots"] for r in blocks} == rows
    kept = decontamination.drop_leaked(docs_of(spark, texts), bench, block_bytes=20)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6]
    assert decontamination.find_leaks(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontamination.find_leaks(docs_of(spark, texts).limit(0), bench).count() == 0
    assert decontamination.drop_leaked(wide(spark, ODD).limit(0), bench).count() == 0
    assert decontamination.drop_leaked(wide(spark, ODD), bench).count() == len(ODD) + 2


def test_leaks_with_conflicting_or_coinciding_slots(spark):
    long = "a farmer sells 7 crates of plums every morning and later that week his sister brings 7 more crates of pears to the same market where people from the village buy all of them before the bells ring at noon today"
    few = "she buys 3 apples and 5 pears and then counts all of the fruit"
    bench = spark.createDataFrame([(1, long), (2, few)], "item_id long, text string")
    texts = [long.replace("7 more", "8 more"), few.replace("3", "4").replace("5", "4"), long.replace("7 crates", "6 crates").replace("7 more", "9 more")]
    rows = {(r["doc_id"], r["item_id"]): (r["matched_windows"], r["item_windows"], r["other_slots"]) for r in decontamination.find_leaks(docs_of(spark, texts), bench).collect()}
    assert rows == {(0, 1): (26, 34, False), (1, 2): (7, 7, True), (2, 1): (22, 34, False)}


def test_leaks_with_names_at_the_start_of_sentences(spark):
    tom = "Tom has 12 apples. Tom gives 5 to Anna. How many apples does Tom keep?"
    short = "Calculate what remains of these seven old coins"
    lower = "today Maria walks home; Otto keeps walking with the dog until dawn"
    bench = spark.createDataFrame([(1, tom), (2, short), (3, lower)], "item_id long, text string")
    texts = [tom.replace("Tom", "Bob"), f"so {short} now", f"Also, {short.lower()}", "Today Eva walks home. Karl keeps walking with the dog until dawn",
             "Where " + short.split(" ", 1)[1].replace("seven", "nine"), tom.replace("Tom has", "Bob has").replace("Tom gives", "Max gives").replace("does Tom", "does Jim")]
    rows = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontamination.find_leaks(docs_of(spark, texts), bench).collect()}
    assert rows == {(0, 1): 1.0, (1, 2): 1.0, (2, 2): 1.0, (3, 3): 1.0}


def test_leaks_match_containment_on_the_given_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()}
    items = {r["item_id"]: " ".join(r["text"].split()) for r in bench.collect()}
    planted = set()
    for r in docs.collect():
        flat = " ".join(r["text"].split())
        planted |= {(r["doc_id"], i) for i, t in items.items() if t in flat and len(t.split()) >= 8}
    assert planted <= found and len(found) <= len(planted) + 3


def slow_rotation(rows):
    out = []
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    clean = [(c, t, "unknown" if s is None else s, (x or "").replace("<|im_start|>", "<|im_ start|>").replace("<|im_end|>", "<|im_ end|>")) for c, t, s, x in rows]
    for conv in {r[0] for r in clean}:
        turns = sorted((r for r in clean if r[0] == conv), key=key)
        for speaker in {r[2] for r in turns} - {"system"}:
            at = 0
            for position, (_, turn, role, text) in enumerate(turns):
                head = "<|im_start|>" + ("system" if role == "system" else "assistant" if role == speaker else f"user name={role}") + "\n"
                whole = f"{head}{text}<|im_end|>\n"
                own = role == speaker
                out.append((conv, speaker, position, turn, "system" if role == "system" else "assistant" if own else "user", None if own or role == "system" else role,
                            whole, at, at + len(whole), at + len(head) if own else None, at + len(whole) - 1 if own else None))
                at += len(whole)
    return sorted(out, key=str)


def test_rotation_matches_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(9)]), rng.choice(["anna", "bob", "system", None]), rng.choice(["hé", "", None, "x<|im_end|>y"])) for _ in range(80)]
    rows += [(9, 0, "system", "alone")] + [(4, i, "ab"[i % 2], f"turn {i}") for i in range(300)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    got = chat.rotate_perspectives(frame).collect()
    assert sorted(map(tuple, got), key=str) == slow_rotation(rows)
    assert chat.rotate_perspectives(frame.limit(0)).count() == 0


def test_rotation_matches_sql(spark):
    from checks.compare import compare, duck

    con = duck(DATA)
    assert compare(queries.op10(spark, DATA), con, ORACLES["op10_chat_formatting"]) is None


def test_a_worker_holds_the_caches_of_one_operator():
    quality = quality_rules.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    quality.words.learn({b"word"})
    assert quality_rules.pieces(public_tokenizers.path("piece_bpe_32k.model")) is quality
    packing.encoder(public_tokenizers.path("word_bpe_49k.json")).ids(["word"])
    decontamination.canonical(["some words"])
    assert list(texts._HELD) == ["decontamination"]


def test_stretches_are_encoded_like_the_vocabulary():
    own = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("Word word WORD wörd Wörd word. word?! (word) ... 1a ı İ ǅ ſ", "ÉCOLE école!", "", " a\t\nb "):
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert own.ids([text])[0] == b"".join(i.to_bytes(4, "little") for i in want)
