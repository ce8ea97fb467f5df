"""Review opinions on Spark: cleaning, splits, training pairs, quadruples and scores."""

from .functions.components import review_key, segment_review, split_components
from .functions.contractions import expand_contractions
from .functions.entities import decode_entities
from .functions.prompts import component_prompt, quad_prompt, serialise_quad
from .functions.quads import parse_lenient, parse_safe, parse_strict, strip_wrappers
from .functions.text import clean_text
from .operators.aligned import match_pairs, unmatched_keys
from .operators.backends import explode_components, predict_components, predict_quads
from .operators.classifier import load_model, predict_class, save_model, train_classifier
from .operators.cleaning import clean_reviews, detect_language, keep_first
from .operators.lexicon import load_lexicon, predict_with_lexicon, save_lexicon, train_lexicon
from .operators.pairs import component_pairs, quad_pairs
from .operators.quad_scores import class_report, confusion, dropped_pairs, field_micro_f1
from .operators.rouge import bootstrap_means, rouge
from .operators.sentence_scores import sentence_scores
from .operators.set_scores import exact_match, set_prf
from .operators.splitting import assign_split, rows_of_split, split_counts, split_keys, with_review_key
from .operators.vocabulary import build_vocabulary, encode, encode_pairs
from .plans.opinions import component_backend, lexicon_backend, quad_backend, review_opinions, segmenter
