"""Subword ids from public vocabulary files."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinionmill.operators import subwords as S

TEXTS = ["The film was great.", None, "", " \n two  spaces ", "日本 é <|endoftext|> </s>", "word " * 3000]
FILES = ["byte_bpe_50k.json", "piece_bpe_32k.model"]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)


def slow_ids(file):
    path = public_tokenizers.path(file)
    if file.endswith(".model"):
        return [sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "") for t in TEXTS]
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return [own.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("file", FILES)
def test_ids_are_those_of_the_library(spark, file):
    words = S.Subwords(spark, public_tokenizers.path(file))
    expected = slow_ids(file)
    got = {r["id"]: r["ids"] for r in S.encode_subwords(frame(spark), "text", words).collect()}
    assert got == dict(enumerate(expected))
    cut = {r["id"]: r["ids"] for r in S.encode_subwords(frame(spark), "text", words, max_length=6, begin_id=7, end_id=2).collect()}
    assert cut == {i: [7, *ids[:4], 2] for i, ids in enumerate(expected)}


def test_round_trip(spark):
    words = S.Subwords(spark, public_tokenizers.path("byte_bpe_50k.json"))
    both = S.encode_subwords(frame(spark), "text", words).select("id", words.text(F.col("ids")).alias("t"))
    assert {r["id"]: r["t"] for r in both.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    nulls = spark.createDataFrame([(None,), ([464],)], "ids array<int>").select(words.text(F.col("ids")).alias("t"))
    assert {r["t"] for r in nulls.collect()} == {None, "The"}


@pytest.mark.parametrize("file", FILES)
def test_pairs_have_fixed_lengths(spark, file):
    words = S.Subwords(spark, public_tokenizers.path(file))
    pairs = frame(spark).select("id", F.col("text").alias("input_text"), F.col("text").alias("target_text"))
    out = S.encode_subword_pairs(pairs, words, 12, 5, pad_id=0, end_id=1)
    assert out.columns == ["id", "input_text", "target_text", "input_ids", "attention_mask", "labels"]
    expected = slow_ids(file)
    for r in out.collect():
        ids = expected[r["id"]]
        whole, target = [*ids[:11], 1], [*ids[:4], 1]
        assert r["input_ids"] == whole + [0] * (12 - len(whole))
        assert r["attention_mask"] == [1] * len(whole) + [0] * (12 - len(whole))
        assert r["labels"] == target + [-100] * (5 - len(target))
    assert S.encode_subword_pairs(pairs.limit(0), words).count() == 0


def test_wrong_files_and_lengths(spark):
    with pytest.raises(ValueError):
        S.Subwords(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = S.Subwords(spark, public_tokenizers.path(FILES[0]))
    with pytest.raises(ValueError):
        S.encode_subwords(frame(spark), "text", words, max_length=1, begin_id=1, end_id=2)
