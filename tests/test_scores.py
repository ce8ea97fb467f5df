import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinionmill.operators import aligned, quad_scores, rouge, sentence_scores, set_scores

from .conftest import executed_plan

VOCABULARY = ["the", "film", "was", "good", "bad", "a", "plot", "x1"]


def pairs(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "row_id long, reference string, prediction string"
    )


def random_rows(n, seed, lines=False):
    rng = random.Random(seed)

    def text():
        words = [rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 14))]
        return "".join(w + (rng.choice(["\n", " ", ". "]) if lines else " ") for w in words)

    return [(text(), text()) for _ in range(n)] + [("", ""), ("!!", "the"), (None, "the")]


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def positions(a, b):
    t, i, j, out = table(a, b), len(a), len(b), set()
    while i > 0 and j > 0:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def f(overlap, n, m):
    if not n or not m or not overlap:
        return 0.0
    p, r = overlap / n, overlap / m
    return 2 * p * r / (p + r)


def naive_rouge(reference, prediction):
    a, b = tokens(reference), tokens(prediction)
    out = []
    for n in (1, 2):
        ga, gb = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (a, b))
        out.append(f(sum((ga & gb).values()), sum(gb.values()), sum(ga.values())))
    out.append(f(table(a, b)[-1][-1], len(b), len(a)))
    la, lb = ([t for t in map(tokens, (x or "").split("\n")) if t] for x in (reference, prediction))
    ca, cb, hits = Counter(a), Counter(b), 0
    for line in la:
        for at in sorted(set().union(*[positions(line, other) for other in lb])):
            if ca[line[at]] > 0 and cb[line[at]] > 0:
                ca[line[at]] -= 1
                cb[line[at]] -= 1
                hits += 1
    out.append(f(hits, len(b), len(a)))
    return out


def test_rouge_equals_the_definitions(spark):
    rows = random_rows(150, 1, lines=True)
    df = pairs(spark, rows)
    got = {}
    for r in rouge.rouge_scores(df).collect():
        got[r["row_id"]] = [r["rouge1"], r["rouge2"], r["rougeL"], r["rougeLsum"]]
    expected = [naive_rouge(*row) for row in rows]
    assert [got[i] for i in range(len(rows))] == [pytest.approx(e, abs=1e-12) for e in expected]
    means = {r["metric"]: r["value"] for r in rouge.rouge(df).collect()}
    for k, name in enumerate(("rouge1", "rouge2", "rougeL", "rougeLsum")):
        assert means[name] == pytest.approx(sum(e[k] for e in expected) / len(rows))


def test_lcs_of_long_texts():
    rng = random.Random(3)
    a, b = ([rng.choice(VOCABULARY) for _ in range(n)] for n in (700, 500))
    assert rouge.lcs_length(a, b) == table(a, b)[-1][-1]
    assert rouge.lcs_positions(a, b) == positions(a, b)
    assert rouge.lcs_length([], b) == 0


def test_lcs_of_very_long_texts_stays_small():
    import tracemalloc

    rng = random.Random(4)
    a = [rng.choice(VOCABULARY) for _ in range(20_000)]
    b = a[:9_000] + ["new"] * 500 + a[9_500:]
    tracemalloc.start()
    assert rouge.lcs_length(a, b) >= 19_500
    assert len(rouge.lcs_positions(a, b)) == rouge.lcs_length(a, b)
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()


def test_scores_need_no_exchange_after_the_join(spark):
    left = spark.createDataFrame([(1, "a b"), (2, "c")], "row_id long, prediction string")
    right = spark.createDataFrame([(1, "a"), (2, "c")], "row_id long, reference string")
    joined = aligned.match_pairs(F.broadcast(left), right, check=False)
    plan = executed_plan(rouge.rouge_scores(joined))
    assert plan.replace("BroadcastExchange", "").count("Exchange") == 0 and plan.count("ArrowEvalPython") == 1


def test_rows_with_equal_ids_are_scored_each_for_itself(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (1, "a b", "c d")], "row_id long, reference string, prediction string")
    for metric in rouge.METRICS:
        assert sorted(r[metric] for r in rouge.rouge_scores(df).collect()) == [0.0, 1.0]


def test_rouge_without_rows(spark):
    assert {r["value"] for r in rouge.rouge(pairs(spark, [("a", "b")]).where("false")).collect()} == {None}


def test_bootstrap_is_repeatable_and_near_the_mean(spark):
    scores = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("double").alias("s"))
    values = [
        rouge.bootstrap_means(part, "s", samples=100).first()["value"] for part in (scores, scores.repartition(7))
    ]
    assert values[0] == pytest.approx(values[1]) and abs(values[0] - 4.5) < 0.2


def naive_bleu(reference, hypothesis):
    total = 0.0
    for n in range(1, 5):
        gh, gr = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (hypothesis, reference))
        clipped = sum(min(c, gr[g]) for g, c in gh.items())
        if n == 1 and clipped == 0:
            return 0.0
        total += 0.25 * math.log((clipped if clipped else 0.1) / max(1, len(hypothesis) - n + 1))
    short = 1.0 if len(hypothesis) > len(reference) else math.exp(1 - len(reference) / len(hypothesis))
    return short * math.exp(total)


def sentences(text):
    return [s.strip() for s in (text or "").split(";") if s.strip()]


def naive_sentence_scores(reference, prediction):
    ps, rs = sentences(prediction), sentences(reference)
    tp = sum(p in rs for p in ps)
    p, r = (tp / len(ps) if ps else 0.0), (tp / len(rs) if rs else 0.0)
    split = lambda s: re.findall(r"\w+|[^\w\s]", s)
    bleu = [max((naive_bleu(split(x), split(s)) for x in rs), default=0.0) for s in ps]
    return [p, r, 2 * p * r / (p + r + 1e-8) if p + r else 0.0, sum(bleu) / len(ps) if ps else 0.0]


def test_sentence_scores(spark):
    rng = random.Random(5)

    def text():
        return " ; ".join(
            " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 7))) for _ in range(rng.randrange(0, 5))
        )

    rows = [(text(), text()) for _ in range(80)]
    rows += [("a ; c", "a ; b"), ("a", "a ; a"), ("a", ""), ("", "a"), ("a ; b", "b ; a ; a"), ("x, y!", "x, y!"), (None, None)]
    expected = [naive_sentence_scores(*row) for row in rows]
    df = pairs(spark, rows)
    prf = {r["row_id"]: [r["precision"], r["recall"], r["f1"]] for r in sentence_scores.sentence_prf(df).collect()}
    bleu = {r["row_id"]: r["bleu"] for r in sentence_scores.sentence_bleu(df).collect()}
    for i, e in enumerate(expected):
        assert [*prf[i], bleu[i]] == pytest.approx(e, abs=1e-9), rows[i]
    means = {r["metric"]: r["value"] for r in sentence_scores.sentence_scores(df).collect()}
    assert list(means) == ["mean_precision", "mean_recall", "mean_f1", "mean_bleu"]
    assert list(means.values()) == pytest.approx([sum(c) / len(rows) for c in zip(*expected)])


def quad(aspect, sentiment, term="t"):
    return f"aspect: {aspect}, aspect term: {term}, opinion term: o, sentiment: {sentiment}"


QUADS = [
    (quad("A", "pos"), quad("A", "pos")),
    (quad("A", "pos"), quad("B", "neg", "u")),
    (quad("B", "neg"), quad("B", "neg")),
    (quad("C", "neg"), quad("A", "neg")),
    (quad("A", "pos"), quad("D", "pos")),
    (quad("A", "pos"), "broken"),
    ("", quad("A", "pos")),
]


def test_field_scores(spark):
    df = pairs(spark, QUADS)
    got = {r["metric"]: r["value"] for r in quad_scores.field_micro_f1(df).collect()}
    assert got == pytest.approx({"aspect_f1": 0.4, "aspect_term_f1": 0.8, "opinion_term_f1": 1.0, "sentiment_f1": 0.8})
    assert tuple(quad_scores.dropped_pairs(df).first()) == (7, 5, 2)
    assert quad_scores.field_micro_f1(pairs(spark, [("", "")])).collect() == []
    assert quad_scores.class_report(pairs(spark, [("", "")])).collect() == []


def test_class_report(spark):
    got = {(r["field"], r["label"]): tuple(r)[2:] for r in quad_scores.class_report(pairs(spark, QUADS)).collect()}
    assert got[("aspect", "A")] == pytest.approx((0.5, 1 / 3, 0.4, 3))
    assert got[("aspect", "B")] == pytest.approx((0.5, 1.0, 2 / 3, 1))
    assert got[("aspect", "C")] == (0.0, 0.0, 0.0, 1)
    assert got[("aspect", "D")] == (0.0, 0.0, 0.0, 0)
    assert got[("aspect", "accuracy")] == (None, None, pytest.approx(0.4), 5)
    assert got[("aspect", "macro avg")] == pytest.approx((0.25, 1 / 3, (0.4 + 2 / 3) / 4, 5))
    assert got[("aspect", "weighted avg")] == pytest.approx((0.4, 0.4, (0.4 * 3 + 2 / 3) / 5, 5))
    assert len(got) == 4 + 2 + 2 * 3
    counts = {tuple(r)[:3]: r["n"] for r in quad_scores.confusion(pairs(spark, QUADS)).where("field = 'aspect'").collect()}
    assert counts == {("aspect", "A", "A"): 1, ("aspect", "A", "B"): 1, ("aspect", "B", "B"): 1,
                      ("aspect", "C", "A"): 1, ("aspect", "A", "D"): 1}


def test_texts_are_parsed_once(spark):
    plan = executed_plan(quad_scores.class_report(pairs(spark, QUADS)))
    assert plan.count("sentiment:[") == 2


def test_set_scores(spark):
    df = pairs(spark, [("A ; b", "a ; c"), ("d", "D ; d"), (None, "a")])
    got = {r["metric"]: r["value"] for r in set_scores.set_prf(df).collect()}
    assert got == pytest.approx({"precision": 2 / 3, "recall": 2 / 3, "f1": 2 / 3}, abs=1e-6)
    equal = pairs(spark, [(" a", "a "), ("a", "b"), (None, "a"), ("", " ")])
    assert set_scores.exact_match(equal).first()["value"] == 0.5


def test_matching(spark):
    left = spark.createDataFrame([(1, "p1"), (2, "p2")], "row_id long, prediction string")
    right = spark.createDataFrame([(2, "r2"), (1, "r1")], "row_id long, reference string")
    assert sorted(tuple(r) for r in aligned.match_pairs(left, right).collect()) == [(1, "r1", "p1"), (2, "r2", "p2")]
    for wrong in ([(3, "x")], [(1, "again")], [(None, "x")]):
        with pytest.raises(Exception, match="row_id=(3|1|NULL) has"):
            aligned.match_pairs(left.union(spark.createDataFrame(wrong, left.schema)), right).collect()
    twice = aligned.unmatched_keys(left.union(left.where("row_id = 1")), right).collect()
    assert [tuple(r) for r in twice] == [(1, 2, 1)]
