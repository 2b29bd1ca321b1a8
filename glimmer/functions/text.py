"""Text functions on columns: tokens, query words, captions and tags."""

from __future__ import annotations

import unicodedata
from functools import reduce
from string import ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small Latin letters with a mark, and the same without it.
MARKED = "".join(c for c in map(chr, range(0xE0, 0x180)) if c.islower() and c != unicodedata.normalize("NFD", c)[0] in ascii_lowercase)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)
#: Characters that make a query word need quotes, punctuation that a query loses, operator words.
QUOTED, DROPPED, OPERATORS = "\"'()*-+,:^.", ",;:!?", ("AND", "OR", "NOT")
#: Words that are no tag.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "can", "need", "dare",
    "and", "or", "but", "if", "then", "else", "when", "where", "why",
    "how", "what", "which", "who", "whom", "this", "that", "these",
    "those", "i", "you", "he", "she", "it", "we", "they", "them",
    "my", "your", "his", "her", "its", "our", "their", "mine", "yours",
    "in", "on", "at", "to", "for", "of", "with", "by", "from", "up",
    "about", "into", "through", "during", "before", "after", "above",
    "below", "between", "under", "again", "further", "once", "here",
    "there", "all", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "just", "also", "now", "image", "photo", "picture",
    "shows", "showing", "depicted", "scene", "visible", "appears",
)


def folded(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; null for null."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(0))


def cleaned(query: Column) -> Column:
    """Punctuation to spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, rf"[{DROPPED}]+", " "), r"\s+", " "))


def escaped_word(word: Column) -> Column:
    """In quotes, its quotes doubled, where a character asks for it."""
    special = reduce(lambda a, b: a | b, [word.contains(c) for c in QUOTED])
    return F.when(special, F.concat(F.lit('"'), F.replace(word, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(word)


def normalized_query(query: Column) -> Column:
    """Each word escaped; a query of several words with an operator word stays as it came; without words it is empty."""
    words = F.filter(F.split(cleaned(query), r"\s+"), lambda w: w != "")
    operators = F.arrays_overlap(words, F.array(*map(F.lit, OPERATORS))) & (F.size(words) > 1)
    return F.when(operators, query).otherwise(F.array_join(F.transform(words, escaped_word), " "))


def tags(description: Column, limit: int = 20) -> Column:
    """Words of three ASCII letters or more, lower case, without stop words, first occurrences, at most limit."""
    words = F.regexp_extract_all(F.lower(description), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    kept = F.filter(words, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(*STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, limit)


def joined_tags(values: Column) -> Column:
    return F.array_join(values, " ")


def parsed_output(text: Column, task: str) -> Column:
    """What stands between the task's tags, in any case; without them the text without any tags. Trimmed."""
    name = task.strip("<>")
    found = rf"(?is)<{name}>(.*?)</{name}>"
    inner = F.regexp_replace(F.regexp_extract(text, found, 1), r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"^\s+|\s+$", "")
    return F.when(text.rlike(found), inner).otherwise(bare)


def caption_text(caption: Column, tag_text: Column) -> Column:
    """What full-text search sees of a photo; null where both are null or empty."""
    joined = F.concat_ws(" ", F.nullif(caption, F.lit("")), F.nullif(tag_text, F.lit("")))
    return F.nullif(joined, F.lit(""))


def truncated(text: Column, size: int = 80) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def percent_encoded(text: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
