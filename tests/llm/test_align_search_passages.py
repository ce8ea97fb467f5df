"""Tokenizer alignment, lexical search and passage removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from checks.compare import compare, duck
from opinionmill.llm import alignment, lexical_search, queries, substring_dedup
from opinionmill.llm.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, t string, m string, segment string, term string, key string, n_a string, z string"
ODD = [None, "", " ", " \n\t", "x", "a  b \n c\n", "\n\nlead", "▁ low line", "a▁b", "<|endoftext|> <s> don't", "日本語 テキスト", "ﬁ ①é",
       "a" * 5000, "no-break space here", "\x00 \x1f null", "tail ", "İstanbul ǅ 12,5"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def wide(spark, texts):
    rows = [(i, t, *["x"] * 7) for i, t in enumerate(texts)] + [(None, "null id here", *["x"] * 7), (0, texts[0], *["x"] * 7)]
    return spark.createDataFrame(rows, WIDE)


# ---- alignment ------------------------------------------------------------


def slow_tokens(texts):
    """Ids, byte ends and groups of every whole text, encoded at once; None without tokens."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    spelled = alignment._spelled_bytes()
    out = []
    for text in texts:
        raw = f" {text or ''}".encode()
        ids = a.encode(f" {text or ''}", add_special_tokens=False).ids, b.encode(text or "")
        tokens = (
            [bytes(spelled[c] for c in a.id_to_token(i)) for i in ids[0]],
            [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
        )
        if not text or any(b"".join(t) != raw for t in tokens):
            out.append(None)
            continue
        places = []
        for side in tokens:
            at, own = 0, []
            for t in side:
                own.append((at, at + len(t)))
                at += len(t)
            places.append(own)
        cuts = sorted({e for _, e in places[0]} & {e for _, e in places[1]})
        links, j = [], 0
        for i, (s, e) in enumerate(places[0]):
            while j and places[1][j][0] >= s:
                j -= 1
            while places[1][j][1] <= s:
                j += 1
            k = j
            while k < len(places[1]) and places[1][k][0] < e:
                links.append((i, k, min(e, places[1][k][1]) - max(s, places[1][k][0])))
                k += 1
        group = [[np.searchsorted(cuts, e) for _, e in side] for side in places]
        out.append((ids, links, group, len(cuts)))
    return out


def slow_alignment(texts):
    rows = slow_tokens(texts)
    counts = Counter((r[0][0][i], r[0][1][k]) for r in rows if r for i, k, _ in r[1])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for r in rows:
        if r is None:
            out.append((0,) * 7 + ("",))
            continue
        ids, links, group, n = r
        pairs = [(ids[0][i], ids[1][k]) for i, k, _ in links]
        written = ";".join(
            "|".join(",".join(str(x) for x, g in zip(ids[s], group[s]) if g == i) for s in (0, 1)) for i in range(n)
        )
        shared = sum(group[0].count(i) * group[1].count(i) for i in range(n))
        out.append((len(ids[0]), len(ids[1]), n, len(links), shared, sum(counts[p] == best[p[1]] for p in pairs),
                    sum(counts[p] for p in pairs), hashlib.sha256(written.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [6_000_000, 0])
def test_alignment_matches_brute_force(spark, documents, limit):
    texts = ODD + [r["text"][:600] for r in documents.limit(25).collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = alignment.align_tokenizers(frame, broadcast_pairs=limit).orderBy("doc_id").collect()
    expected = slow_alignment(texts)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r[n] for n in names) for r in got] == expected


def test_links_match_brute_force(spark):
    texts = [t for t in ODD if t is None or len(t) < 100]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kind in ("overlap", "group"):
        got = alignment.token_links(frame, kind=kind, at_once=3).collect()
        expected = []
        for doc, r in enumerate(slow_tokens(texts)):
            if r is None:
                continue
            ids, links, group, _ = r
            if kind == "group":
                links = [(i, k, 1) for i, g in enumerate(group[0]) for k, h in enumerate(group[1]) if g == h]
            expected += [(doc, i, k, ids[0][i], ids[1][k], w) for i, k, w in links]
        assert sorted(map(tuple, got)) == sorted(expected)
    with pytest.raises(ValueError):
        alignment.token_links(frame, kind="other")


def test_products_match_dense_ones():
    rng = np.random.default_rng(2)
    for _ in range(20):
        left, right = (rng.integers(0, 2, shape) for shape in ((7, 11), (11, 9)))
        sparse = [
            alignment.Matrix(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1], m.shape[1]) for m in (left, right)
        ]
        for at_once in (1, 5, 1000):
            dense = np.zeros((7, 9), dtype=np.int64)
            rows, columns, values = alignment.joint(alignment.product(*sparse, at_once))
            dense[rows, columns] = values
            assert (dense == left @ right).all()
        assert (alignment.joint(alignment.product(sparse[0], sparse[0].transposed()))[2].sum()) == (left @ left.T).sum()


def test_stretches_are_encoded_like_whole_texts():
    both, rng = alignment.Pair("byte_bpe_50k.json", "piece_bpe_32k.model"), random.Random(4)
    alphabet = [*"ab é\n \t's 12.,▁日ﬁ​　́\r", "<|endoftext|>", " \n", "  ", "don't", "\u0085"]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 14)))
        keys = both.cut(text, {})
        assert (keys is None) == ("▁" in text)
        if keys is not None:
            encoded = both.encode(keys)
            assert [i for a, _ in encoded for i in a] == whole.encode(" " + text, add_special_tokens=False).ids
            assert [i for _, b in encoded for i in b] == both.b.encode(text)
    for point in [*range(32, 127), 10, *range(0xA1, 0xAD), *range(0xAE, 0x250)]:
        assert both.lossless("x" + chr(point)) and both.lossless("\n" + chr(point) + "x")


def test_alignment_edges(spark):
    out = alignment.align_tokenizers(wide(spark, ODD))
    assert out.count() == len(ODD) + 2 and out.where("doc_id is null and n_a > 0").count() == 1
    assert alignment.align_tokenizers(wide(spark, ODD).limit(0)).count() == 0
    assert alignment.link_counts(wide(spark, [None, ""]).where("doc_id = 0")).count() == 0


# ---- search ---------------------------------------------------------------


def slow_search(docs, items, top):
    import math

    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)

    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    held = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in own:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text) if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(400)] + ["É", "日本", "Ab1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(3, docs[3][1]), (None, docs[5][1]), (None, None), (900, "--- !"), (901, docs[7][1].upper()), (902, "w1 " * 3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(12)] + [(3, "ab1 ab1 AB1 é"), (None, "w1 w2"), (50, None), (51, "nowhere")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = lexical_search.build_index(frame, segment_bytes=8_000)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 300):
        got = lexical_search.search(index, asked, top=7, block_bytes=block).collect()
        assert sorted(map(tuple, got), key=str) == slow_search(docs, items, 7)


def test_bounds_skip_and_keep(spark):
    """With pair bounds fewer lists lead than with the terms' own maxima, and no document that counts is lost."""
    rows = {0: [(0, 9), (1, 1)], 1: [(0, 1), (2, 9)], 2: [(3, 5)]}
    own = lexical_search.Lists.__new__(lexical_search.Lists)
    own.docs = {t: np.array([d for d, _ in r], dtype=np.int32) for t, r in rows.items()}
    own.impacts = {t: np.array([i for _, i in r], dtype=np.int64) for t, r in rows.items()}
    own.most, own.ids = {t: int(i.max()) for t, i in own.impacts.items()}, [10, 11, 12, 13]
    item = lexical_search.Item(1, {0: 1, 1: 1, 2: 1}, [(0, 1)], reach=16)
    docs, joint = own.both(0, 1)
    assert docs.tolist() == [0] and joint.tolist() == [10]
    bounds = lexical_search._units(item, own, {(0, 1): 10})
    assert sum(b for b, _ in bounds) == 15 and sum(own.most.values()) == 23
    assert len(lexical_search.search_segment(item, own, {(0, 1): 10}, 2)[0]) == 0
    item.reach = 10
    docs, scores = lexical_search.search_segment(item, own, {(0, 1): 10}, 2)
    assert docs.tolist() == [0] and scores.tolist() == [10]


def test_search_edges(spark):
    index = lexical_search.build_index(wide(spark, ODD))
    asked = wide(spark, ["x null", "日本語 b"]).withColumnRenamed("doc_id", "item_id")
    assert {r["doc_id"] for r in lexical_search.search(index, asked).where("item_id = 0").collect()} == {4, 14, None}
    assert lexical_search.search(index, asked.limit(0)).count() == 0
    assert lexical_search.search(lexical_search.build_index(wide(spark, ODD).limit(0)), asked).count() == 0


def test_search_query_matches_sql(spark):
    name = "op12_lexical_search"
    assert compare(queries.QUERIES[name](spark, DATA), duck(DATA), ORACLES[name]) is None


# ---- passages -------------------------------------------------------------


def slow_passages(rows, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    places = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if places[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_passages_match_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3 if seed == 1 else 40)] + ["é", "日本"]
    passages = [rng.choices(words, k=rng.randint(5, 40)) for _ in range(6)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            own += rng.choice(passages)[rng.randint(0, 4) :] if rng.random() < 0.6 else rng.choices(words, k=rng.randint(1, 30))
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(own)))
    rows += [(7, rows[7][1]), (None, rows[9][1]), (None, None), (61, ""), (62, " \n"), (63, "a b " * 60), (64, "one " * 50), (65, rows[3][1] + " x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.dedup_passages(frame, window=10, anchor=4).collect()
    assert sorted(map(tuple, got), key=str) == slow_passages(rows, 10)


def test_minimisers_take_the_leftmost_least():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5, 300, dtype=np.uint64) << np.uint64(40)
    for width in (1, 2, 7, 28):
        slow = [i + int(np.argmin(values[i : i + width])) for i in range(300 - width + 1)]
        assert substring_dedup.minimisers(values, width).tolist() == slow


def test_passages_of_a_very_long_text(spark):
    words = [f"w{i * 7919 % 50_021}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[40_000:40_100])), (3, " ".join(words[:34])), (4, "a " * 200_000)]
    got = substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    # The words come round after 50,021.
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {1: 120_000, 2: 100, 3: 0, 4: 200_000}


def test_passage_edges(spark):
    same = "k " * 40
    out = substring_dedup.dedup_passages(wide(spark, [*ODD, same, same]))
    assert out.count() == len(ODD) + 4 and out.where("n_removed > 0").count() == 2
    assert substring_dedup.dedup_passages(wide(spark, ODD).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup_passages(wide(spark, ODD), window=3, anchor=4)
    plan = substring_dedup.dedup_passages(wide(spark, ODD)).where(F.col("doc_id") == 1)
    assert plan.collect()[0]["n_words"] == 0


def test_repeats_of_checks_are_grouped_once(spark):
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[50:] + ["end"]))], "doc_id long, text string")
    runs = substring_dedup.repeated_spans(docs)
    assert sum(r["n"] for r in runs.collect()) == 2 * (150 - 34)
    assert "min(" not in runs._jdf.queryExecution().optimizedPlan().toString()
