"""Text preparation: cleaning, tokens, stop words, lemmas, sentences, chunks, previews."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.regex import SPACE, let, strip

# The usual English stop words of the NLP toolkits.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren "
    "weren't won won't wouldn wouldn't"
).split()
# Words the tokeniser cuts in two.
CONTRACTIONS = {
    "cannot": "can not",
    "gimme": "gim me",
    "gonna": "gon na",
    "gotta": "got ta",
    "lemme": "lem me",
    "wanna": "wan na",
}
# Irregular nouns; callers may pass a larger mapping.
IRREGULAR_NOUNS = {
    "children": "child",
    "feet": "foot",
    "geese": "goose",
    "men": "man",
    "mice": "mouse",
    "people": "people",
    "teeth": "tooth",
    "women": "woman",
}
# Endings tried from the longest; a word keeps at least three letters.
LEMMA_ENDINGS = [
    ("sses", "ss"),
    ("shes", "sh"),
    ("ches", "ch"),
    ("ies", "y"),
    ("xes", "x"),
    ("zes", "z"),
    ("ss", "ss"),
    ("us", "us"),
    ("is", "is"),
    ("s", ""),
]
LAST_LETTER = "s"  # of every ending
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")  # one by one what SPACE is as a class


def clean_text(text: Column) -> Column:
    """ASCII letters in lower case with single blanks; NULL becomes ''."""
    kept = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[a-zA-Z{SPACE}]+"), F.lit(0))
    # Every blank would be a match of an expression; only texts that hold runs of them are given to one.
    blank = F.translate(F.lower(F.array_join(kept, "")), SPACES, " " * len(SPACES))
    return F.trim(let(blank, lambda b: F.when(b.contains("  "), F.regexp_replace(b, " {2,}", " ")).otherwise(b)))


def tokenize(cleaned: Column) -> Column:
    """Word tokens of a cleaned text."""

    def cut(line: Column) -> Column:
        any_of, whole = F.lit(False), line
        for word, parts in CONTRACTIONS.items():
            any_of = any_of | line.contains(word)
            whole = F.regexp_replace(whole, rf"\b{word}\b", parts)
        return F.filter(F.split(F.when(any_of, whole).otherwise(line), " "), lambda t: t != "")

    return let(cleaned, cut)


def remove_stopwords(tokens: Column, words: Iterable[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*words))


def lemma(word: Column, exceptions: Mapping[str, str] = IRREGULAR_NOUNS) -> Column:
    """Noun lemma by ending, after a look at the exceptions.

    All endings end in one letter, which most words lack; so neither endings nor exceptions are tried one by one on these.
    """
    ended = F
    for ending, base in LEMMA_ENDINGS:
        ended = ended.when(
            word.endswith(ending),
            F.concat(word.substr(F.lit(1), F.length(word) - len(ending)), F.lit(base)),
        )
    regular = F.when(word.endswith(LAST_LETTER) & (F.length(word) > 3), ended.otherwise(word)).otherwise(word)
    if not exceptions:
        return regular
    known = F
    for irregular, base in exceptions.items():
        known = known.when(word == irregular, F.lit(base))
    return F.when(word.isin(*exceptions), known).otherwise(regular)


def lemmatize(tokens: Column, exceptions: Mapping[str, str] = IRREGULAR_NOUNS) -> Column:
    return F.transform(tokens, lambda t: lemma(t, exceptions))


def preprocess(text: Column) -> Column:
    """Clean, tokenise, drop stop words, lemmatise."""
    return preprocess_tokens(tokenize(clean_text(text)))


def preprocess_tokens(tokens: Column) -> Column:
    """What ``preprocess`` does with the tokens of a cleaned text."""
    return lemmatize(remove_stopwords(tokens))


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` where blanks follow."""
    return F.filter(F.split(text, rf"(?<=[.!?])[{SPACE}]+"), lambda s: s != "")


def terms(text: Column, words: Iterable[str] = STOP_WORDS) -> Column:
    """Lower-cased word runs of two or more characters without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*words))


def chunks(text: Column, size: int = 1024) -> Column:
    """Consecutive pieces of ``size`` characters; no piece for an empty text."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return F.when(
        F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def long_chunks(pieces: Column, minimum: int = 50) -> Column:
    """Pieces with at least ``minimum`` characters after stripping."""
    return F.filter(pieces, lambda c: F.length(strip(c)) >= minimum)


def preview(text: Column, size: int = 100) -> Column:
    """First ``size`` characters, with ``...`` where more follow."""
    return F.when(
        F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))
    ).otherwise(text)


def enough_for_nlp(text: Column) -> Column:
    """At least ten characters once stripped."""
    return F.coalesce(F.length(strip(text)) >= 10, F.lit(False))


def enough_for_image(text: Column) -> Column:
    """More than ten characters once stripped (image texts)."""
    return F.coalesce(F.length(strip(text)) > 10, F.lit(False))


def present(text: Column) -> Column:
    """Any text at all; blanks count."""
    return F.coalesce(text != "", F.lit(False))


def pad_post(ids: Column, size: int = 100) -> Column:
    """First ``size`` ids, filled with zeros at the end."""
    kept = F.slice(ids, 1, size)
    return F.concat(kept, F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size(kept)))


def pad_pre(ids: Column, size: int = 500) -> Column:
    """Last ``size`` ids, filled with zeros in front."""
    kept = F.when(F.size(ids) > size, F.slice(ids, -size, size)).otherwise(ids)
    return let(
        kept, lambda k: F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size(k)), k)
    )


def hash_bucket(word: Column, buckets: int = 1000) -> Column:
    """A stable bucket number for a word."""
    return F.pmod(F.xxhash64(word), F.lit(buckets))
