"""SimHash groups and line deduplication against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opinionmill.llm import components, line_dedup, simhash
from opinionmill.operators.skew import salted_join

SCHEMA = "doc_id long, text string, label string, fp string, component_id string, _row string"
BLANK = " \t\n\x0b\x0c\r"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, radius=3):
    prints = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, p, least.get(find(i))) for i, (d, p) in enumerate(zip([r[0] for r in rows], prints))), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "River", "run", "past", "Eve", "and", "adam's", "schön", "日本", "of"]
    out = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(n)]
    base = " ".join(rng.choices(words, k=300))
    for i in range(n):
        parts = base.split(" ")
        for _ in range(rng.randint(0, 2)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        out.append(" ".join(parts))
    return out


def test_groups_match_brute_force(spark):
    rows = list(enumerate(texts(1, 60))) + [(200, None), (201, ""), (202, " \t\n"), (None, "alone here now"), (None, None), (5, "the River"), (5, "the River")]
    got = simhash.simhash_groups(table(spark, rows)).collect()
    mine = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str)
    assert mine == slow_groups(rows)


def test_large_buckets_are_linked_exactly(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)}
    signed = [(simhash._signed(p),) for p in prints]
    frame = table(spark, signed, "fp long")
    small = components.components(simhash.near_links(frame, 3, bucket_limit=4)).collect()
    large = components.components(simhash.near_links(frame, 3)).collect()
    assert sorted(small) == sorted(large) and len(small) > 100


def test_every_pair_within_the_radius_shares_a_mask():
    rng = random.Random(5)
    masks = simhash.masks(3)
    for _ in range(2000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not flip & m for m in masks)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (3, None), (500, 501), (501, 500)]
    got = dict(map(tuple, components.components(table(spark, edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {500: 500, 501: 500}


def test_keep_first_keeps_one_row_per_group(spark):
    rows = [(3, "a b c d", "x", "1", "2", "r"), (1, "A b c d", "y", "1", "2", "r"), (1, "A b c d", "y", "1", "2", "r"), (None, "zz yy xx", "n", "1", "2", "r"),
            (None, "zz yy xx", "n", "1", "2", "r"), (9, None, None, None, None, None), (8, "", "e", "1", "2", "r")]
    kept = simhash.keep_first(table(spark, rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "label", "fp", "component_id", "_row"]
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 8]
    assert simhash.keep_first(table(spark, [], SCHEMA)).count() == 0


def within_one(a, b):
    """Whether one word put in, left out or replaced makes the lists equal: what is left between the common ends."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def slow_dedup(rows, min_words):
    order, first = [], {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for pos, line in enumerate((t or "").split("\n")):
            if line.strip(BLANK):
                place = (1 << 63 if d is None else d, pos)
                if line not in first or place < first[line]:
                    first[line] = place
                order.append(line)
    words = {x: [w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", x) if w] for x in first}
    near = {
        x for x in first for y in first
        if first[y] < first[x] and x != y and min(len(words[x]), len(words[y])) >= min_words and within_one(words[x], words[y])
    }
    out = []
    for d, t in rows:
        seen, kept = set(), []
        for line in (t or "").split("\n"):
            if line.strip(BLANK):
                here = 1 << 63 if d is None else d
                if line in near or first[line][0] < here or line in seen:
                    continue
                seen.add(line)
            kept.append(line)
        out.append((d, "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dd", "é"]
    lines = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11]))) for _ in range(40)]
    for line in list(lines):
        words = line.split(" ")
        if len(words) > 3:
            i = rng.randrange(len(words))
            kind = rng.randrange(3)
            lines.append(" ".join(words[:i] + ([] if kind == 0 else ["new"] if kind == 1 else [words[i], "more"]) + words[i + 1 :]))
    rows = [(d, "\n".join(rng.choices(lines, k=rng.randint(0, 8)))) for d in range(30)]
    rows += [(7, "a b\n\n \na b"), (7, "a b\n\n \na b"), (None, "only here\nonly here"), (None, None), (31, ""), (32, "\n\n")]
    frame = table(spark, rows)
    for limit in (500_000, 0):
        got = line_dedup.dedup_lines(frame, broadcast_rows=limit).select("doc_id", "text").collect()
        assert sorted(map(tuple, got), key=str) == slow_dedup(rows, 5)


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "Anat with by of nteres atre are.\nPage 1 of 9"), (2, "Tolyoued with by of nteres atre are.\nPage 2 of 9")]
    got = line_dedup.dedup_lines(table(spark, rows)).orderBy("doc_id").select("text").collect()
    assert [r["text"] for r in got] == [rows[0][1], "Page 2 of 9"]


def test_line_dedup_keeps_other_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, lines string, d string, line string, _row string"
    out = line_dedup.dedup_lines(table(spark, [(1, "x\nx\n\ny", "old", "d", "l", None)], schema))
    assert out.collect() == [(1, "x\n\ny", "d", "l", None, 3, 1, 0)]
    assert line_dedup.dedup_lines(table(spark, [], schema)).count() == 0


def test_line_dedup_has_no_python(spark):
    plan = line_dedup.dedup_lines(table(spark, [(1, "x")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_of_a_very_long_line(spark):
    words = [f"w{i % 997}" for i in range(60_000)]
    other = words[:30_000] + ["new"] + words[30_001:]
    rows = [(1, " ".join(words)), (2, " ".join(other))]
    got = line_dedup.dedup_lines(table(spark, rows)).select("doc_id", F.length("text").alias("n"), "lines_near").orderBy("doc_id").collect()
    assert got[0]["n"] == len(rows[0][1]) and got[1]["n"] == 0 and got[1]["lines_near"] == 1


def test_distinct_rows_of_a_salted_join_meet_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(3000).selectExpr("id % 3 as k", "id % 50 as v").localCheckpoint()
        right = spark.range(2).selectExpr("id as k").localCheckpoint()
        plain, once = salted_join(left, right, "k"), salted_join(left, right, "k", distinct=True)
        count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert count(once) == count(plain) < count(plain.distinct())
        assert sorted(map(tuple, once.collect())) == sorted(map(tuple, plain.distinct().collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
