"""One query per operator over the given tables.

Every query reads whole tables.  The tables stand in for reviews: documents are
reviews, conversations are reviews with ordered sentences, parts and orders carry
the labels that quadruple texts are built from.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill.functions import components as C
from opinionmill.functions import quads as Q
from opinionmill.functions import text as T
from opinionmill.functions.binding import let
from opinionmill.functions.contractions import expand_contractions
from opinionmill.functions.entities import decode_entities
from opinionmill.functions.prompts import component_prompt, quad_prompt, serialise_quad
from opinionmill.functions.tokens import mask_labels, pad_to
from opinionmill.operators import aligned, backends, classifier, cleaning, language_model, lexicon, pairs, quad_scores
from opinionmill.operators import rouge, sentence_scores, set_scores, splitting, subwords, trainer, vocabulary
from opinionmill.plans import opinions
from opinionmill.session import checkpoint_dir, cut_lineage, spread
from opinionmill.sources import readers, writers

from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


#: Tasks that the bench deals one-file tables over; 0, the default, leaves tables as they are stored.
SPREAD = int(os.environ.get("SPREAD", "0"))


def table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A given table; ``keys`` are those to deal it by, if that is asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, SPREAD, *keys) if keys else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", "lang", "source")


def joined(values: Column) -> Column:
    """An array as text, for comparison by value."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ")


# ---- cleaning -------------------------------------------------------------


def _step(name: str, step: Callable[[Column], Column], noise: str = I.NOISE) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.concat(F.lit(noise), F.col("text"), F.lit(noise))
        return documents(spark, sf_dir).select("doc_id", step(text).alias("text"))

    run.__name__ = name
    query(run)


_step("clean_strip_ws", T.strip_space)
_step("clean_collapse_ws", T.collapse_space)
_step("clean_punct_space", T.tighten_punctuation)
_step("clean_digit_space", T.separate_digits)
_step("clean_sentence_space", T.separate_sentences)
_step("clean_capitalise", T.capitalise_sentences)
_step("clean_symbols", T.remove_symbols)
_step("clean_contractions", expand_contractions)
_step("clean_mojibake", T.repair_encoding, I.MOJIBAKE)


@query
def clean_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id").select("page_id", T.remove_tags(F.col("html")).alias("html"))


@query
def clean_entities(spark, sf_dir):
    html = F.concat(F.lit(I.ENTITIES), F.col("html"))
    return table(spark, sf_dir, "pages", "page_id").select("page_id", decode_entities(html).alias("html"))


@query
def clean_text(spark, sf_dir):
    noisy = documents(spark, sf_dir).select("doc_id", F.concat(F.lit(I.NOISE), F.col("text")).alias("text"))
    return T.clean_text(noisy, "text")


@query
def clean_reviews(spark, sf_dir):
    raw = documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), F.col("text").alias("review_text"))
    return cleaning.clean_reviews(raw)


@query
def sentinel_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return cleaning.drop_sentinel(orders, "o_orderpriority", I.ORDER_SENTINEL)


@query
def blank_filter(spark, sf_dir):
    cut = documents(spark, sf_dir).select(
        "doc_id", F.regexp_replace("text", r"[A-Za-z.,\n]+", " ").alias("text")
    )
    return cleaning.drop_blank(cut, "text")


@query
def lang_detect(spark, sf_dir):
    return cleaning.detect_language(documents(spark, sf_dir), "text").select("doc_id", "language")


def _language_model(spark: SparkSession, sf_dir: str) -> tuple[language_model.LanguageModel, DataFrame]:
    """Learned from eight tenths of the documents, and all documents with their split."""
    data = documents(spark, sf_dir).select(F.concat(F.lit("REV"), F.col("doc_id")).alias("review_key"), "doc_id", "text", "lang")
    split = splitting.assign_split(data, mode="hash")
    return language_model.train_language_model(split.where("split = 'train'"), "text", "lang"), split


@query
def lang_ngrams(spark, sf_dir):
    """What is learned: n-grams and letters of each language."""
    return language_model.count_ngrams(documents(spark, sf_dir), "text", "lang")


@query
def lang_identify(spark, sf_dir):
    """Learned, stored, loaded, and asked about every document."""
    model, split = _language_model(spark, sf_dir)
    path = _folder(spark, "languages")
    language_model.save_language_model(spark, model, path)
    loaded = language_model.load_language_model(spark, path)
    return language_model.identify_language(split, "text", loaded, "language", "lead").select("doc_id", "split", "language", "lead")


@query
def lang_accuracy(spark, sf_dir):
    """Right, wrong and undecided documents of each split; at least 95 of 100 held-out ones are right."""
    model, split = _language_model(spark, sf_dir)
    found = language_model.identify_language(split, "text", model)
    right = F.count_if(F.col("language") == F.col("lang"))
    return found.groupBy("split").agg(
        F.count("*").alias("rows"), right.alias("right"), F.count_if(F.col("language") == "unknown").alias("undecided"),
        (right * 100 >= F.count("*") * 95).alias("enough"),
    )


@query
def lang_filter(spark, sf_dir):
    return cleaning.keep_language(documents(spark, sf_dir), "en", "lang").select("doc_id", "text")


@query
def dedup_keep_first(spark, sf_dir):
    return cleaning.keep_first(documents(spark, sf_dir), "text", "doc_id")


# ---- keys and splits ------------------------------------------------------


def annotated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("role") == "user", F.lit("REV")).otherwise(F.lit("X"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.concat(prefix, F.col("conv_id"), F.lit("-"), F.col("turn")).alias("Review ID")
    )


def keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.concat(F.lit("REV"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("Review ID")
    )


@query
def extract_review_key(spark, sf_dir):
    ids = annotated_ids(spark, sf_dir)
    rid = F.col("`Review ID`")
    return ids.select(
        rid.alias("review_id"), C.review_key(rid).alias("review_key"), C.key_before_dash(rid).alias("prefix")
    )


@query
def drop_unkeyed(spark, sf_dir):
    kept = splitting.with_review_key(annotated_ids(spark, sf_dir))
    return kept.select(F.col("`Review ID`").alias("review_id"), "review_key")


def _split(spark, sf_dir, mode="exact"):
    return splitting.assign_split(splitting.with_review_key(keyed_rows(spark, sf_dir)), mode=mode)


@query
def group_split(spark, sf_dir):
    return _split(spark, sf_dir).select("conv_id", "turn", "review_key", "split")


@query
def group_split_hash(spark, sf_dir):
    return _split(spark, sf_dir, "hash").select("conv_id", "turn", "review_key", "split")


@query
def split_counts(spark, sf_dir):
    return splitting.split_counts(_split(spark, sf_dir))


@query
def distinct_keys(spark, sf_dir):
    return splitting.split_keys(splitting.with_review_key(keyed_rows(spark, sf_dir)))


@query
def split_semi_join(spark, sf_dir):
    rows = splitting.with_review_key(keyed_rows(spark, sf_dir))
    keys = splitting.split_keys(rows)
    return splitting.rows_of_split(rows, keys, "test").select("conv_id", "turn", "review_key")


# ---- pairs, prompts and tokens --------------------------------------------


@query
def component_pairs(spark, sf_dir):
    rows = keyed_rows(spark, sf_dir).select(
        "Review ID",
        F.col("text").alias("Full review"),
        F.col("text").alias("Component sentence"),
        F.col("turn").alias("pos"),
    )
    return pairs.component_pairs(rows, "t5")


@query
def component_pairs_plain(spark, sf_dir):
    rows = keyed_rows(spark, sf_dir).select(
        "Review ID",
        F.col("text").alias("Full review"),
        F.when(F.col("turn") > 0, F.col("text")).alias("Component sentence"),
        F.col("turn").alias("pos"),
    )
    return pairs.component_pairs(rows, "bart")


def labelled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("Component sentence"),
        F.col("p_type").alias("Aspect Category"),
        F.when(F.col("p_size") > 10, F.col("p_name")).alias("Aspect Terms"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("Opinion Terms"),
        F.when(F.col("p_retailprice") > 1000, "positive").otherwise("negative").alias("Polarity Sentiment"),
    )


@query
def absa_pairs(spark, sf_dir):
    return pairs.quad_pairs(labelled_parts(spark, sf_dir), "t5", keep=("p_partkey",))


@query
def prompts(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        component_prompt(F.col("text"), "t5").alias("component_t5"),
        component_prompt(F.col("text"), "bart").alias("component_bart"),
        quad_prompt(F.col("text"), "t5").alias("quad_t5"),
    )


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(vocabulary.build_vocabulary(documents(spark, sf_dir), "text", vocab_size=I.VOCABULARY_SIZE))


@query
def vocabulary_build(spark, sf_dir):
    return vocabulary.build_vocabulary(documents(spark, sf_dir), "text", vocab_size=I.VOCABULARY_SIZE)


@query
def token_encode(spark, sf_dir):
    encoded = vocabulary.encode(documents(spark, sf_dir), "text", _vocabulary(spark, sf_dir))
    return encoded.select("doc_id", joined(F.col("ids")).alias("ids"))


@query
def token_encode_join(spark, sf_dir):
    encoded = vocabulary.encode(documents(spark, sf_dir), "text", _vocabulary(spark, sf_dir), method="join")
    return encoded.select("doc_id", joined(F.col("ids")).alias("ids"))


@query
def token_pad_mask(spark, sf_dir):
    both = documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("input_text"), F.col("source").alias("target_text")
    )
    encoded = vocabulary.encode_pairs(both, _vocabulary(spark, sf_dir), 64, 8)
    return encoded.select(
        "doc_id",
        joined(F.col("input_ids")).alias("input_ids"),
        joined(F.col("attention_mask")).alias("attention_mask"),
        joined(F.col("labels")).alias("labels"),
    )


def _subwords(spark: SparkSession, file: str) -> subwords.Subwords:
    return subwords.Subwords(spark, public_tokenizers.path(file))


@query
def subword_round_trip(spark, sf_dir):
    """Every whole text as ids of a byte-level vocabulary, and read back from them."""
    words = _subwords(spark, "byte_bpe_50k.json")
    encoded = subwords.encode_subwords(documents(spark, sf_dir), "text", words)
    return encoded.select("doc_id", words.text(F.col("ids")).alias("text"))


@query
def subword_pairs(spark, sf_dir):
    """Fixed-length arrays of pieces; beyond SQL, so tests hold them against the library."""
    pairs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("input_text"), F.col("source").alias("target_text"))
    encoded = subwords.encode_subword_pairs(pairs, _subwords(spark, "piece_bpe_32k.model"), 512, 16, end_id=2)
    return encoded.select(
        "doc_id", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("attention_mask")).alias("attention_mask"),
        joined(F.col("labels")).alias("labels"),
    )


@query
def label_mask(spark, sf_dir):
    """Word lengths as ids: padding and empty words have the padding id 0."""
    ids = F.transform(F.split("text", " ", -1), F.length)
    return documents(spark, sf_dir).select("doc_id", joined(mask_labels(pad_to(ids, 512, 0), 0)).alias("labels"))


# ---- quadruple texts and components ---------------------------------------


def quad_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadruple texts with commas in terms, missing markers and trailing marks."""
    complete = F.concat(
        F.lit("aspect: "), F.col("p_type"), F.lit(", aspect term: "), F.col("p_name"), F.lit(", "), F.col("p_brand"),
        F.lit(", opinion term: "), F.col("p_brand"), F.lit(" , sentiment: "), F.col("p_name"), F.lit("!"),
    )
    text = (
        F.when(F.col("p_size") < 5, F.replace(complete, F.lit("sentiment:"), F.lit("sentiment")))
        .when(F.col("p_size") < 10, F.replace(complete, F.lit(","), F.lit("")))
        .when(F.col("p_size") < 12, F.lit(""))
        .otherwise(complete)
    )
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", text.alias("quad_text"))


def _parse(name: str, parser: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = quad_texts(spark, sf_dir).select("p_partkey", parser(F.col("quad_text")).alias("q"))
        return parsed.select("p_partkey", *[F.col(f"q.{f}").alias(f) for f in Q.FIELDS])

    run.__name__ = name
    query(run)


_parse("parse_lenient", Q.parse_lenient)
_parse("parse_strict", Q.parse_strict)
_parse("parse_safe", Q.parse_safe)


@query
def serialise_quads(spark, sf_dir):
    p = labelled_parts(spark, sf_dir)
    fields = ("Aspect Category", "Aspect Terms", "Opinion Terms", "Polarity Sentiment")
    return p.select("p_partkey", serialise_quad(*[F.col(f"`{f}`") for f in fields]).alias("quad_text"))


def _marked(text: Column) -> Column:
    """Documents hold no semicolons, so sentence ends are used as separators."""
    return F.replace(text, F.lit("."), F.lit(";"))


@query
def strip_wrappers(spark, sf_dir):
    wrapped = F.concat(F.lit("['"), F.col("text"), F.lit("']"))
    return documents(spark, sf_dir).select(
        "doc_id", Q.strip_wrappers(F.split(wrapped, "\n", -1)).alias("piece")
    )


@query
def split_components(spark, sf_dir):
    pieces = C.split_components(_marked(F.col("text")))
    return documents(spark, sf_dir).select(
        "doc_id", F.size(pieces).alias("n"), F.array_join(pieces, " ; ").alias("components")
    )


@query
def explode_components(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", C.split_components(_marked(F.col("text"))).alias("components"))
    return backends.explode_components(df)


@query
def quad_lines(spark, sf_dir):
    lines = readers.quad_lines(I.labelled_lines(documents(spark, sf_dir)), "value", ("doc_id",))
    return lines.withColumn("sentence", F.md5("sentence"))


@query
def quad_lines_broken(spark, sf_dir):
    """German labels are cut short, Spanish lines have none, and no line is lost."""
    cut = F.when(F.col("lang") == "de", F.concat(F.split("value", "####")[0], F.lit("####[[\"")))
    none = F.when(F.col("lang") == "es", F.split("value", "####")[0])
    lines = I.labelled_lines(documents(spark, sf_dir)).withColumn("value", F.coalesce(cut, none, F.col("value")))
    return readers.quad_lines(lines, "value", ("doc_id",)).groupBy("doc_id").agg(
        F.count("pos").alias("quads"), F.bool_or("bad").alias("bad"), F.min(F.length("sentence")).alias("chars")
    )


@query
def column_check(spark, sf_dir):
    """The columns that are there pass; the message names the missing one and those found."""
    docs = cleaning.require_columns(documents(spark, sf_dir), "doc_id", "text")
    try:
        cleaning.require_columns(docs, "doc_id", "review")
        message = ""
    except ValueError as error:
        message = str(error)
    return docs.select("doc_id", F.lit(message).alias("message"))


@query
def segment_components(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", C.segment_review(F.col("text")).alias("components"))
    return backends.explode_components(df)


# ---- models ---------------------------------------------------------------


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms are taken from the texts before the join, which shuffles them in their place."""
    found = let(
        I.words_of(F.col("text")),
        lambda words: F.struct(I.terms_of(words).alias("term"), I.opinions_of(words).alias("opinion")),
    )
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", found.alias("found"))
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "text",
        F.col("found.term").alias("term"),
        F.when(F.col("lang") == "en", "Story").when(F.col("lang") == "fr", "Acting").otherwise("Movie").alias("aspect"),
        F.col("found.opinion").alias("opinion"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
        .alias("sentiment"),
    )


@query
def lexicon_train(spark, sf_dir):
    return lexicon.train_lexicon(labelled_documents(spark, sf_dir))


@query
def lexicon_train_partial(spark, sf_dir):
    """Rows with a term and no opinion, or the reverse, still count."""
    rows = labelled_documents(spark, sf_dir)
    return lexicon.train_lexicon(
        rows.withColumn("term", F.when(F.col("aspect") != "Acting", F.col("term"))).withColumn(
            "opinion", F.when(F.col("aspect") != "Story", F.col("opinion"))
        )
    )


@query
def lexicon_long_phrases(spark, sf_dir):
    """Terms of many words are found again, by either method."""
    name = F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name", "p_type")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", name.alias("term"), F.col("p_brand").alias("aspect"), F.lit(None).cast("string").alias("opinion"),
        F.lit("neutral").alias("sentiment"), F.concat(F.lit("so "), name, F.lit(" it is")).alias("component"),
    )
    trained = cut_lineage(lexicon.train_lexicon(parts))
    rows = parts.select("p_partkey", "component")
    return (
        lexicon.predict_with_lexicon(rows, trained)
        .withColumn("method", F.lit("in_row"))
        .unionByName(lexicon.predict_with_lexicon(rows, trained, method="join").withColumn("method", F.lit("join")))
        .select("p_partkey", "method", "aspect", "aspect_term", "opinion_term", "sentiment")
    )


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(lexicon.train_lexicon(labelled_documents(spark, sf_dir)))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir).select("doc_id", C.segment_review(F.col("text")).alias("components"))
    return backends.explode_components(df)


_LEXICON_COLUMNS = ("doc_id", "pos", "aspect", "aspect_term", "opinion_term", "sentiment")


@query
def lexicon_predict(spark, sf_dir):
    found = lexicon.predict_with_lexicon(_segments(spark, sf_dir), _lexicon(spark, sf_dir))
    return found.select(*_LEXICON_COLUMNS)


@query
def lexicon_predict_join(spark, sf_dir):
    found = lexicon.predict_with_lexicon(_segments(spark, sf_dir), _lexicon(spark, sf_dir), method="join")
    return found.select(*_LEXICON_COLUMNS)


@query
def review_opinions(spark, sf_dir):
    reviews = documents(spark, sf_dir).select(F.col("doc_id").alias("review_id"), F.col("text").alias("review"))
    return opinions.review_opinions(
        reviews, opinions.segmenter(), opinions.lexicon_backend(_lexicon(spark, sf_dir))
    )


@query
def review_opinions_join(spark, sf_dir):
    reviews = documents(spark, sf_dir).select(F.col("doc_id").alias("review_id"), F.col("text").alias("review"))
    return opinions.review_opinions(
        reviews, opinions.segmenter(), opinions.lexicon_backend(_lexicon(spark, sf_dir), "join")
    )


@query
def review_opinions_backend(spark, sf_dir):
    reviews = documents(spark, sf_dir).select(F.col("doc_id").alias("review_id"), F.col("text").alias("review"))
    return opinions.review_opinions(
        reviews,
        opinions.component_backend(I.sentence_backend, "bart", batch_size=64),
        opinions.quad_backend(I.quad_backend, "bart", batch_size=64),
    )


@query
def batch_predict(spark, sf_dir):
    reviews = documents(spark, sf_dir).select("doc_id", F.col("text").alias("review"))
    found = backends.predict_components(reviews, I.sentence_backend, model_type="bart", batch_size=64)
    return found.select("doc_id", F.size("components").alias("n"), F.array_join("components", " ; ").alias("components"))


@query
def batch_predict_quads(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("component"))
    found = backends.predict_quads(parts, I.quad_backend, model_type="bart", batch_size=64)
    return found.select("p_partkey", "prediction", Q.parse_lenient(F.col("prediction"))["aspect_term"].alias("aspect_term"))


@query
def classifier_predict(spark, sf_dir):
    """Trained on the train split, stored, loaded, and scored on the test split."""
    data = labelled_documents(spark, sf_dir).select(
        F.concat(F.lit("REV"), F.col("doc_id")).alias("review_key"), "doc_id", "text", "aspect"
    )
    split = splitting.assign_split(data, mode="hash")
    train, test = (split.where(F.col("split") == s) for s in ("train", "test"))
    path = _folder(spark, "classifier")
    classifier.save_model(classifier.train_classifier(train, "text", "aspect", max_iter=5), path)
    scored = cut_lineage(
        classifier.predict_class(test.select("doc_id", "text", "aspect"), classifier.load_model(path), "text").select(
            "doc_id", "aspect", "predicted"
        )
    )
    right = F.avg((F.col("aspect") == F.col("predicted")).cast("double"))
    shares = scored.groupBy("aspect").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("majority"))
    unknown = scored.join(train.select(F.col("aspect").alias("predicted")).distinct(), "predicted", "left_anti")
    # One-row tables: the majority's share and the number of predictions that are no label.
    return scored.agg(F.count("doc_id").alias("rows"), right.alias("right")).select(
        "rows",
        (F.col("right") >= shares.scalar()).alias("at_least_majority"),
        (unknown.agg(F.count("*")).scalar() == 0).alias("labels_known"),
    )


@query
def classifier_epochs(spark, sf_dir):
    """Loss and right answers of each epoch on the validation split, and which epoch is kept."""
    data = labelled_documents(spark, sf_dir).select(
        F.concat(F.lit("REV"), F.col("doc_id")).alias("review_key"), "doc_id", "text", "aspect"
    )
    split = splitting.assign_split(data, mode="hash")
    train, validation = (split.where(F.col("split") == s) for s in ("train", "validation"))
    schedule = trainer.Schedule(epochs=4, batches=3, warm_up=3, patience=2)
    _, history = trainer.train_with_validation(train, validation, "text", "aspect", schedule, _folder(spark, "epochs"))
    kept = trainer.best_epoch(history)
    rows = [(h["epoch"], round(h["train_loss"], 6), round(h["validation_loss"], 6), h["validation_right"], h["validation_rows"], h["epoch"] == kept) for h in history]
    return spark.createDataFrame(rows, "epoch int, train_loss double, validation_loss double, right long, rows long, kept boolean")


# ---- scores ---------------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each turn as a prediction for the next one: both sides keyed by the earlier turn."""
    rows = table(spark, sf_dir, "conversations", "conv_id")
    key = F.concat(F.col("conv_id"), F.lit("-"))
    predictions = rows.select(F.concat(key, F.col("turn")).alias("row_id"), F.col("text").alias("prediction"))
    references = rows.select(F.concat(key, F.col("turn") - 1).alias("row_id"), F.col("text").alias("reference"))
    return predictions, references


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, references = turns(spark, sf_dir)
    return aligned.match_pairs(predictions, references, check=False)


@query
def eval_checked_pairs(spark, sf_dir):
    """Keys that are one to one pass the check, which pairs them in the same pass."""
    rows = table(spark, sf_dir, "conversations").select(
        F.concat(F.col("conv_id"), F.lit("-"), F.col("turn")).alias("row_id"), "text"
    )
    return aligned.match_pairs(
        rows.select("row_id", F.concat(F.lit("so: "), F.col("text")).alias("prediction")), rows.select("row_id", F.col("text").alias("reference"))
    )


def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against itself with some words changed; sentence ends become separators."""
    text = _marked(F.col("text"))
    return table(spark, sf_dir, "conversations", "conv_id").select(
        F.concat(F.col("conv_id"), F.lit("-"), F.col("turn")).alias("row_id"),
        text.alias("reference"),
        I.changed(text).alias("prediction"),
    )


@query
def eval_pairs_join(spark, sf_dir):
    return turn_pairs(spark, sf_dir)


@query
def eval_unmatched(spark, sf_dir):
    return aligned.unmatched_keys(*turns(spark, sf_dir))


@query
def sentence_prf(spark, sf_dir):
    return _rounded(sentence_scores.sentence_prf(sentence_pairs(spark, sf_dir)), "precision", "recall", "f1")


@query
def sentence_bleu(spark, sf_dir):
    return _rounded(sentence_scores.sentence_bleu(sentence_pairs(spark, sf_dir)), "bleu")


@query
def sentence_mean(spark, sf_dir):
    return _rounded(sentence_scores.sentence_scores(sentence_pairs(spark, sf_dir)), "value")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def rouge1(spark, sf_dir):
    return _rounded(rouge.rouge_scores(turn_pairs(spark, sf_dir), ("rouge1",)), "rouge1")


@query
def rouge2(spark, sf_dir):
    return _rounded(rouge.rouge_scores(turn_pairs(spark, sf_dir), ("rouge2",)), "rouge2")


@query
def rouge_l(spark, sf_dir):
    return _rounded(rouge.rouge_scores(turn_pairs(spark, sf_dir), ("rougeL",)), "rougeL")


@query
def rouge_lsum(spark, sf_dir):
    return _rounded(rouge.rouge_scores(turn_pairs(spark, sf_dir), ("rougeLsum",)), "rougeLsum")


@query
def rouge_mean(spark, sf_dir):
    scores = rouge.rouge_scores(turn_pairs(spark, sf_dir), ("rouge1", "rouge2"))
    return _rounded(rouge.mean_metrics(scores, "rouge1", "rouge2"), "value")


@query
def rouge_all(spark, sf_dir):
    return _rounded(rouge.rouge(turn_pairs(spark, sf_dir)), "value")


@query
def rouge_bootstrap(spark, sf_dir):
    scores = rouge.rouge_scores(turn_pairs(spark, sf_dir), ("rouge1",))
    return _rounded(rouge.bootstrap_means(scores, "rouge1", samples=200), "value")


@query
def set_prf(spark, sf_dir):
    return _rounded(set_scores.set_prf(sentence_pairs(spark, sf_dir)), "value")


@query
def exact_match(spark, sf_dir):
    return _rounded(set_scores.exact_match(sentence_pairs(spark, sf_dir)), "value")


def order_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labellings of every order as quadruple texts; some do not parse."""
    def text(aspect: Column, term: Column, sentiment: Column) -> Column:
        return F.concat(
            F.lit("aspect: "), aspect, F.lit(", aspect term: "), term, F.lit(", opinion term: good, sentiment: "),
            sentiment,
        )

    price = F.col("o_totalprice")
    guess = F.when(price > 300000, F.lit("1-URGENT")).otherwise(F.col("o_orderpriority"))
    mood = F.when(price > 400000, F.lit("X")).when(price < 50000, F.lit("O")).otherwise(F.col("o_orderstatus"))
    broken = F.when(price < 10000, F.lit("aspect: none")).otherwise(
        text(guess, F.col("o_custkey").cast("string"), mood)
    )
    return table(spark, sf_dir, "orders", "o_orderkey").select(
        "o_orderkey",
        text(F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")).alias("reference"),
        broken.alias("prediction"),
    )


@query
def micro_f1(spark, sf_dir):
    return _rounded(quad_scores.field_micro_f1(order_quads(spark, sf_dir)), "value")


@query
def class_report(spark, sf_dir):
    return _rounded(quad_scores.class_report(order_quads(spark, sf_dir)), "precision", "recall", "f1")


@query
def confusion(spark, sf_dir):
    return quad_scores.confusion(order_quads(spark, sf_dir))


@query
def dropped_pairs(spark, sf_dir):
    return quad_scores.dropped_pairs(order_quads(spark, sf_dir))


# ---- files ----------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def io_raw_reviews(spark, sf_dir):
    """Write a raw review CSV with an index column, read the review text back."""
    path = _folder(spark, "raw")
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("_c0"), F.col("text").alias("review_text"), "lang")
    writers.write_table(docs, path)
    return readers.read_raw_reviews(spark, path, id_col="_c0").withColumn("row_id", F.col("row_id").cast("long"))


@query
def io_annotated(spark, sf_dir):
    path = _folder(spark, "annotated")
    rows = labelled_parts(spark, sf_dir).select(
        F.concat(F.lit("REV"), F.col("p_partkey")).alias("Review ID"),
        F.col("Component sentence").alias("Full review"),
        "Component sentence",
        "Aspect Category",
        F.coalesce("Aspect Terms", F.lit("NULL")).alias("Aspect Terms"),
        "Opinion Terms",
        "Polarity Sentiment",
    )
    writers.write_table(rows, path)
    return readers.read_annotated(spark, path).drop("pos")


@query
def io_reviews(spark, sf_dir):
    """Read a review CSV in another encoding; missing reviews become empty."""
    path = _folder(spark, "reviews")
    text = F.when(F.col("doc_id") % 100 != 0, F.col("text"))
    docs = documents(spark, sf_dir).select(F.concat(F.lit("REV"), F.col("doc_id")).alias("doc_id"), text.alias("review"))
    docs.write.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return readers.read_reviews(spark, path, id_col="doc_id", encoding="ISO-8859-1")


@query
def io_splits(spark, sf_dir):
    path = _folder(spark, "splits")
    writers.write_splits(_split(spark, sf_dir).select("conv_id", "turn", "text", "split"), path)
    splits = [readers.read_split(spark, path, s) for s in ("train", "validation", "test")]
    return splits[0].unionByName(splits[1]).unionByName(splits[2]).select("conv_id", "turn", "text", "split")


@query
def io_token_cache(spark, sf_dir):
    root = _folder(spark, "tokens")

    def build() -> DataFrame:
        encoded = vocabulary.encode(documents(spark, sf_dir), "text", _vocabulary(spark, sf_dir))
        return encoded.select("doc_id", joined(F.col("ids")).alias("ids"))

    inputs = (I.VOCABULARY_SIZE, readers.fingerprint(documents(spark, sf_dir)))
    readers.read_or_build(spark, root, "component", "t5", build, *inputs)
    return readers.read_or_build(spark, root, "component", "t5", build, *inputs)


@query
def io_predictions(spark, sf_dir):
    path = _folder(spark, "predictions")
    parts = quad_texts(spark, sf_dir).select(
        F.col("p_partkey").alias("row_id"),
        F.col("quad_text").alias("input"),
        F.col("quad_text").alias("reference"),
        F.lit("a \"quoted\", text").alias("prediction"),
    )
    writers.write_predictions(parts, path)
    return readers.read_predictions(spark, path).withColumn("row_id", F.col("row_id").cast("long"))


@query
def io_opinions(spark, sf_dir):
    path = _folder(spark, "opinions")
    writers.write_opinions(review_opinions(spark, sf_dir), path, "parquet")
    return spark.read.parquet(path)


@query
def io_lexicon(spark, sf_dir):
    path = _folder(spark, "lexicon")
    lexicon.save_lexicon(lexicon.train_lexicon(labelled_documents(spark, sf_dir)), path)
    return lexicon.load_lexicon(spark, path)


@query
def io_metrics(spark, sf_dir):
    path = _folder(spark, "metrics")
    writers.write_metrics(micro_f1(spark, sf_dir), path)
    return spark.read.schema("metric string, value double").json(path)
