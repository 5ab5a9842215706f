"""Text columns: cleaning, tokens, n-grams, truncation. Only entities and NFC need Python; both go in Arrow batches."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: White space of the cleaning rules: Unicode's, and the four separators U+001C to U+001F.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
LETTERS = "a-zA-ZÀ-ÿ"
#: Kinds of noise and the pattern that finds each: fixed values.
NOISE = {
    "html_tag": r"<[^>]+>",
    "html_entity": r"&[a-z]+;|&#\d+;",
    "url": r"https?://\S+|www\.\S+",
    "apostrophe_typo": r"[’‘`´]",
    "guillemets": r"[«»“”]",
    "ponct_repetee": r"[!?.]{3,}",
    "lettres_repetees": rf"([{LETTERS}])\1{{2,}}",
    "mot_majuscules": r"\b[A-ZÀ-Ý]{4,}\b",
    "emoji": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]",
    "note_chiffree": r"\b\d{1,2}\s?/\s?\d{1,2}\b",
    "espaces_multiples": r"\s{2,}",
    "retour_ligne": r"\n",
}


def unicode_classes(pattern: str) -> str:
    """A pattern whose digits, white space and word ends are Unicode's, as they are in the rules; Java's are ASCII."""
    return "(?U)" + pattern.replace(r"\s", SPACE).replace(r"\S", "[^" + SPACE[1:]).replace(r"\d", r"\p{Nd}")


@pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)


#: A character reference with its semicolon.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def _closed_reference(match: re.Match) -> str:
    return html.unescape(match[0]) if match[0][1] == "#" else html.entities.html5.get(match[0][1:], match[0])


@pandas_udf(StringType())
def unescape_closed(texts: pd.Series) -> pd.Series:
    """As unescape(), but references without their semicolon stay as they are."""
    return texts.map(lambda t: _CLOSED.sub(_closed_reference, t) if t and "&" in t else t)


@pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if not t or t.isascii() else unicodedata.normalize("NFC", t))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def clean_text(c: Column, closed: bool = False) -> Column:
    """Entities (with closed, only those that end with a semicolon), tags, addresses, NFC, apostrophes, quotes, white space, in this order."""
    c = F.regexp_replace(unescape_closed(c) if closed else unescape(c), "<[^>]+>", " ")
    c = nfc(F.regexp_replace(c, unicode_classes(r"https?://\S+|www\.\S+"), " "))
    return collapse(F.translate(c, "’‘`´«»“”", "''''\"\"\"\""))


def prepare_for_tokens(c: Column) -> Column:
    """Ligatures, letters repeated three times or more, ratings, white space; expects cleaned text."""
    for a, b in (("œ", "oe"), ("Œ", "Oe"), ("æ", "ae"), ("Æ", "Ae")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, rf"([{LETTERS}])\1{{2,}}", "$1$1")
    return collapse(F.regexp_replace(c, unicode_classes(NOISE["note_chiffree"]), " "))


def tokens(c: Column, least: int = 2) -> Column:
    """Runs of letters, in lower case."""
    return F.filter(F.split(F.lower(c), r"(?U)[^\p{L}]+"), lambda t: F.length(t) >= least)


def keep_tokens(surface: Column, stopwords: list[str], lemma=lambda t: F.lower(t), least: int = 2) -> Column:
    """Lemmas of the tokens whose surface is alphabetic and long enough and whose lemma is no stop word."""
    kept = F.filter(surface, lambda t: t.rlike(r"^\p{L}+$") & (F.length(t) >= least))
    return F.filter(F.transform(kept, lemma), lambda t: ~t.isin(stopwords))  # a look-up in a set of literals


def _bigrams(t: Column) -> Column:
    """The bigram that starts at each token; null at the last. No lambda looks into the whole array, which Spark may compute anew for every element."""
    behind = F.concat(F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(0))), F.array(F.lit(None).cast("string")))
    return F.zip_with(F.filter(t, lambda x: x.isNotNull()), behind, lambda x, y: F.concat(x, F.lit(" "), y))


def ngrams(t: Column, dedupe: bool = False) -> Column:
    """All unigrams, then all bigrams; deduped, the first of each stays."""
    out = F.concat(t, F.filter(_bigrams(t), lambda x: x.isNotNull()))
    return F.array_distinct(out) if dedupe else out


def ngrams_interleaved(t: Column) -> Column:
    """w0, w0 w1, w1, w1 w2, ..."""
    return F.filter(F.flatten(F.zip_with(t, _bigrams(t), lambda x, y: F.array(x, y))), lambda x: x.isNotNull())


def truncate_words(c: Column, most: int, mark: str = " […]") -> Column:
    """Texts longer than `most` end at the last space before it, with a mark; without such a space the prefix stays whole."""
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most), r" [^ ]*\z", ""), F.lit(mark))).otherwise(c)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, rf"{SPACE}+"), lambda t: t != ""))


def match_context(c: Column, pattern: str, around: int = 40) -> Column:
    """The first match with `around` characters on both sides; null without a match."""
    at = F.regexp_instr(c, F.lit(pattern))
    size = F.length(F.regexp_substr(c, F.lit(pattern)))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, c.substr(start, at + size + around - start))


def parse_list(c: Column) -> Column:
    """An array from a list written with single quotes."""
    return F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "array<string>")


def french_int(c: Column) -> Column:
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit(" "))


def french_decimal(c: Column) -> Column:
    return F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(","))
