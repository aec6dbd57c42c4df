"""Text functions (F1, F2, F7-F11, W12) as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmill import schema

MARKS = ".,!?;:\"'()[]{}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once. Inside a lambda over an array an expression would be
    computed again for each element; a lambda's variable isn't."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    """White-space tokens; none for empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def clean_word(word: Column) -> Column:
    return F.lower(F.translate(word, MARKS, ""))


def clean_words(text: Column) -> Column:
    """tokens without marks, in lower case; a token of marks alone becomes '' and still counts."""
    return F.transform(tokens(text), clean_word)


def sentences(text: Column) -> Column:
    """parts between marks that end sentences, of two tokens or more."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[.!?]+")
    return F.filter(parts, lambda s: F.size(tokens(s)) >= 2)


def in_list(words: Column, known: list[str]) -> Column:
    """how many of the words are in the list."""
    lexicon = sorted(set(known))
    return F.size(F.filter(words, lambda w: w.isin(lexicon)))


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole, 0 where whole is not positive."""
    return F.when(whole > 0, F.round(part.cast("double") / whole, digits)).otherwise(F.lit(0.0))


def question_count(text: Column, parts: Column | None = None) -> Column:
    """Question marks plus sentences that begin with an interrogative, so a marked question that begins
    with one counts twice. `parts`: the text's sentences, where they are known."""
    marks = F.length(F.coalesce(text, F.lit(""))) - F.length(F.translate(F.coalesce(text, F.lit("")), "?", ""))
    opened = F.filter(sentences(text) if parts is None else parts, lambda s: F.element_at(clean_words(s), 1).isin(schema.INTERROGATIVE))
    return marks + F.size(opened)


def text_features(text: Column, duration: Column, legacy_nan: bool = False, words: Column | None = None, parts: Column | None = None) -> dict[str, Column]:
    """The eight text features that need no word times. With legacy_nan a blank text counts as the one
    word 'nan', as where blanks were read back as missing numbers. `words` and `parts`: the text's clean words
    and its sentences, where they are columns already, so that no feature cuts the text again."""
    if legacy_nan:
        text = F.when(F.coalesce(text, F.lit("")) == "", F.lit("nan")).otherwise(text)
    words = clean_words(text) if words is None else words
    parts = sentences(text) if parts is None else parts
    n = F.size(words)
    hooks = in_list(words, schema.HOOK_WORDS)
    asked = question_count(text, parts)
    return {
        "word_count": n.cast("double"),
        "words_per_second": F.round(n / F.greatest(duration.cast("double"), F.lit(1e-6)), 4),
        "hook_word_count": hooks.cast("double"),
        "hook_word_ratio": ratio(hooks, n, 6),
        "question_count": asked.cast("double"),
        "question_density": ratio(asked, F.size(parts), 4),
        "second_person_ratio": ratio(in_list(words, schema.SECOND_PERSON), n, 6),
        "first_person_ratio": ratio(in_list(words, schema.FIRST_PERSON), n, 6),
    }


def timed_features(words: Column) -> dict[str, Column]:
    """The two text features of word times, from an array of (word, start, end)."""
    early = F.filter(
        F.transform(F.filter(words, lambda w: w["end"] <= 5.0), lambda w: clean_word(F.trim(w["word"]))), lambda w: w != ""
    )
    return {
        "first_5s_hook_word_ratio": F.coalesce(ratio(in_list(early, schema.HOOK_WORDS), F.size(early), 6), F.lit(0.0)),
        "articulation_rate": articulation_rate(words),
    }


def pauses(words: Column, least: float = 0.15) -> Column:
    """The sum of gaps between neighbouring words that are longer than `least`."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(words, 2, rest), F.slice(words, 1, rest), lambda b, a: b["start"] - a["end"])
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + F.when(g > least, g).otherwise(0.0))


def articulation_rate(words: Column) -> Column:
    """Words a second of speech; 0 for less than two words or no time."""
    n = F.size(words)
    span = F.try_element_at(words, F.lit(-1))["end"] - F.try_element_at(words, F.lit(1))["start"]
    speech = span - pauses(words)
    return F.when((n >= 2) & (span > 0) & (speech > 0), F.round(n / speech, 4)).otherwise(F.lit(0.0))


def without_repeats(items: Column) -> Column:
    """The array without elements that equal the one just before."""
    return let(items, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.element_at(a, F.greatest(i, F.lit(1))))))


def url_topic(url: Column) -> Column:
    """what follows the last slash, '' without one."""
    return F.when(F.contains(url, F.lit("/")), F.substring_index(url, "/", -1)).otherwise(F.lit(""))


def id_list(text: Column) -> Column:
    """a comma list as an array, without '' and 'nan'."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "nan"))


def uploads_playlist(channel_id: Column) -> Column:
    """F11."""
    return F.concat(F.lit("UU"), F.substring(channel_id, 3, 1 << 20))
