"""English contractions and informal spellings, expanded in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .dictionary import Dictionary
from .patterns import WORD, prefix_tree

# Spellings and their expansions. Case matters.
CONTRACTIONS = {
    "he's": "he is", "He's": "He is",
    "she's": "she is", "She's": "She is",
    "it's": "it is", "It's": "It is",
    "that's": "that is", "That's": "That is",
    "there's": "there is", "There's": "There is",
    "what's": "what is", "What's": "What is",
    "where's": "where is", "Where's": "Where is",
    "who's": "who is", "Who's": "Who is",
    "how's": "how is", "How's": "How is",
    "i'm": "i am", "I'm": "I am",
    "i've": "i have", "I've": "I have",
    "i'd": "i would", "I'd": "I would",
    "i'll": "i will", "I'll": "I will",
    "U're": "you are", "u're": "you are",
    "U": "you", "u": "you",
    "you're": "you are", "You're": "You are",
    "you've": "you have", "You've": "You have",
    "you'd": "you would", "You'd": "You would",
    "you'll": "you will", "You'll": "You will",
    "we're": "we are", "We're": "We are",
    "we've": "we have", "We've": "We have",
    "we'd": "we would", "We'd": "We would",
    "we'll": "we will", "We'll": "We will",
    "they're": "they are", "They're": "They are",
    "they've": "they have", "They've": "They have",
    "they'd": "they would", "They'd": "They would",
    "they'll": "they will", "They'll": "They will",
    "he'd": "he would", "He'd": "He would",
    "he'll": "he will", "He'll": "He will",
    "she'd": "she would", "She'd": "She would",
    "she'll": "she will", "She'll": "She will",
    "it'd": "it would", "It'd": "It would",
    "it'll": "it will", "It'll": "It will",
    "let's": "let us", "Let's": "Let us",
    "can't": "cannot", "Can't": "Cannot",
    "couldn't": "could not", "Couldn't": "Could not",
    "wouldn't": "would not", "Wouldn't": "Would not",
    "shouldn't": "should not", "Shouldn't": "Should not",
    "won't": "will not", "Won't": "Will not",
    "don't": "do not", "Don't": "Do not",
    "doesn't": "does not", "Doesn't": "Does not",
    "didn't": "did not", "Didn't": "Did not",
    "haven't": "have not", "Haven't": "Have not",
    "hasn't": "has not", "Hasn't": "Has not",
    "hadn't": "had not", "Hadn't": "Had not",
    "hadnt": "had not", "Hadnt": "Had not",
    "isnt": "is not",
    "aren't": "are not", "Aren't": "Are not",
    "isn't": "is not", "Isn't": "Is not",
    "wasn't": "was not", "Wasn't": "Was not",
    "weren't": "were not", "Weren't": "Were not",
    "ain't": "am not", "Ain't": "Am not",
    "y'all": "you all", "Y'all": "You all",
    "mustn't": "must not", "Mustn't": "Must not",
    "needn't": "need not", "Needn't": "Need not",
    "shan't": "shall not", "Shan't": "Shall not",
    "dunno": "do not know", "Dunno": "Do not know",
    "gimme": "give me", "Gimme": "Give me",
    "gonna": "going to", "Gonna": "Going to",
    "gotta": "got to", "Gotta": "Got to",
    "lemme": "let me", "Lemme": "Let me",
    "wanna": "want to", "Wanna": "Want to",
    "y'know": "you know", "Y'know": "You know",
    "c'mon": "come on", "C'mon": "Come on",
    "yup": "yes", "Yup": "Yes",
    "nah": "no", "Nah": "No",
    "o'clock": "of the clock", "O'clock": "Of the clock",
    "how'd": "how did", "How'd": "How did",
    "how'll": "how will", "How'll": "How will",
    "when's": "when is", "When's": "When is",
    "where'd": "where did", "Where'd": "Where did",
    "where'll": "where will", "Where'll": "Where will",
    "why'd": "why did", "Why'd": "Why did",
    "why'll": "why will", "Why'll": "Why will",
    "why's": "why is", "Why's": "Why is",
}

# "U"/"u" becomes "you" before the "you've", "you'd" and "you'll" rules apply,
# so these six spellings expand in two steps; the single pass names them.
_TWO_STEP = {
    short + tail: "you" + full
    for short in ("U", "u")
    for tail, full in (("'ve", " have"), ("'d", " would"), ("'ll", " will"))
}

EXPANSIONS = {**CONTRACTIONS, **_TWO_STEP}

_PATTERN = f"(?<!{WORD})(?=[{''.join(sorted({k[0] for k in EXPANSIONS}))}]){prefix_tree(EXPANSIONS)}(?!{WORD})"


def expand_contractions(text: Column) -> Column:
    """Expand whole-word contractions; the text between them is untouched."""
    expansions = Dictionary.of(EXPANSIONS)

    def rejoined(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0))
        filled = F.zip_with(
            gaps, found, lambda gap, word: F.concat(gap, F.coalesce(expansions.get(word), F.lit("")))
        )
        return F.when(F.size(gaps) == 1, text).otherwise(F.array_join(filled, ""))

    return let(F.split(text, _PATTERN, -1), rejoined)
