"""Text functions as column expressions. Offsets and lengths count code points."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that cleaning replaces one for one, and those that become several characters or none.
SINGLE = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "―": "-", " ": " "}
MULTIPLE = {"…": "...", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
REMOVED = "​‌‍﻿"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
#: Forms of address that entity names are freed from.
TITLES = ("the", "a", "an", "count", "countess", "dr", "doctor", "mr", "mrs", "ms", "miss", "professor", "prof", "lord", "sir", "lady", "madam", "madame", "captain", "mister")
#: The wording of refusals, and of questions about the whole text or one fact.
REFUSAL = (
    r"(?iU)(steht|finde|findet\s+sich|gibt\s+es)[^.]{0,60}(quellen|texten?)[^.]{0,40}(nichts|keine|nicht)"
    r"|quellen\s+(reichen|enthalten)\s+nicht|keine\s+(information|angabe|informationen|angaben)"
)
GLOBAL_QUESTION = (
    r"(?iU)\b(thema|themen|motiv|entwickl\w*|im verlauf|gesamten roman|ganzen roman|beziehung(en)? zwischen|verhältnis zwischen|welche rolle|welche bedeutung|"
    r"erzähl\w*|symbol\w*|vergleich\w*|kontrast\w*|unterschied\w*|verändert sich|über den roman|charakterisier\w*|dargestellt|inszeniert)\b"
)
LOCAL_QUESTION = r"(?iU)^\s*(wann|wo|wer|wem|wen|wie viele|wie heißt|wie hieß|welches schiff|in welchem kapitel|an welchem tag)\b"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def folded(c: Column) -> Column:
    """For comparing without case: lower case, and the letters that lower case leaves apart (sharp s, final sigma)."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def collapse(c: Column, limit: int | None = None) -> Column:
    """Runs of white space become one space; cut to `limit` characters."""
    out = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.substring(out, 1, limit) if limit else out


def sample(c: Column, n: int = 300) -> Column:
    return collapse(F.substring(c, 1, n))


def _normalizer(form: str):
    @F.pandas_udf("string")
    def normalized(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t), na_action="ignore")

    return normalized


def nfc(c: Column) -> Column:
    """Composed normal form; the JVM functions have none, so Arrow batches go to Python."""
    return _normalizer("NFC")(c)


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition, then only what is ASCII."""
    return F.regexp_replace(_normalizer("NFKD")(c), r"[^\x00-\x7f]", "")


def slugify(c: Column, default: str = "gruppe") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def normalize_name(c: Column) -> Column:
    """Lower-case ASCII words without possessives and leading titles; a name made of titles alone is empty."""
    words = F.regexp_replace(F.lower(F.regexp_replace(ascii_fold(c), r"'s\b", "")), r"[^a-z0-9\s]", " ")
    words = collapse(words)
    return F.trim(F.regexp_replace(F.concat(words, F.lit(" ")), f"^(?:(?:{'|'.join(TITLES)}) )+", ""))




def entity_key(name: Column, kind: Column) -> Column:
    return F.concat_ws(":", kind, normalize_name(name))


# --- cleaning -----------------------------------------------------------------------------------------------------------------


def control_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CONTROL))


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


_SPECIAL = "[" + "".join(SINGLE) + "".join(MULTIPLE) + REMOVED + "]"


def special_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(_SPECIAL))


def plain_characters(c: Column) -> Column:
    """Typographic quotes, dashes, ligatures, ellipses and zero-width characters in plain form."""
    out = F.translate(c, "".join(SINGLE) + REMOVED, "".join(SINGLE.values()))
    for k, v in MULTIPLE.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


_NUMBER_LINE = r"(?U)^\d{1,4}$"


def _stripped_lines(c: Column) -> Column:
    return F.transform(F.split(c, "\n", -1), strip)


def number_lines(c: Column) -> Column:
    """How many lines are page numbers."""
    return F.size(F.filter(_stripped_lines(c), lambda x: x.rlike(_NUMBER_LINE)))


def _kept_lines(c: Column) -> Column:
    """Stripped lines without page numbers; blank lines are empty, runs of them one empty line."""
    text = F.array_join(F.filter(_stripped_lines(c), lambda x: ~x.rlike(_NUMBER_LINE)), "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{2,}", "\n\n"), r"^\n+|\n+$", "")


def joined_count(c: Column) -> Column:
    """How many line breaks inside paragraphs are undone."""
    return F.regexp_count(_kept_lines(c), F.lit(r"(?<!\n)\n(?!\n)"))


def dewrap(c: Column) -> Column:
    """Lines of a paragraph joined by spaces, or without the hyphen where a word was split; paragraphs stay apart."""
    whole = F.regexp_replace(_kept_lines(c), r"(?<=[A-Za-zÀ-ÿ])-\n(?=\p{IsLowercase})", "")
    return F.regexp_replace(whole, r"(?<!\n)\n(?!\n)", " ")


def smoothed(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def clean(c: Column, compose: bool = True) -> Column:
    """The whole cleaning; `compose` False leaves out the normal form and stays in the JVM."""
    c = nfc(c) if compose else c
    return smoothed(dewrap(unix_lines(plain_characters(without_controls(c)))))


def share_not_ascii(c: Column) -> Column:
    return F.round(F.regexp_count(c, F.lit(r"[^\x00-\x7f]")) / F.greatest(F.length(c), F.lit(1)), 4)


# --- headings and chapters ----------------------------------------------------------------------------------------------------


def is_heading(c: Column) -> Column:
    return c.rlike(r"^(CHAPTER|Chapter|KAPITEL|Kapitel|BOOK|Book)\b[^\n]{0,70}$") & (F.length(c) <= 80)


def is_caps_heading(c: Column) -> Column:
    s = strip(c)
    n = F.length(s)
    return n.between(3, 60) & ~s.contains("\n") & (s == F.upper(s)) & (F.regexp_count(s, F.lit(r"\p{L}")) >= 3) & ~s.rlike('[.!?,;:"“”„]')


def is_contents(c: Column) -> Column:
    """A paragraph that is a table of contents."""
    return F.regexp_count(c, F.lit(r"(?i)\b(?:CHAPTER|KAPITEL)\b")) >= 3


def is_marker(c: Column) -> Column:
    """A Roman or Arabic number, or no letters at all."""
    return strip(c).rlike(r"^(?:[IVXLC]+|[-–—]?\s*\d+|[^A-Za-zÀ-ÿ]*)$")


def boilerplate_key(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, r"(?U)[\d\s|]+", " ")))


def chapter_id(c: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(c, r"(?i)CHAPTER\s+([IVXLCDM]+)", 1), F.lit("")))


def pretty_chapter(c: Column) -> Column:
    """Titles in capitals get title case; Roman numerals stay."""
    roman = r"^(?=[ivxlcdm])m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})\W*$"
    words = F.transform(F.split(F.lower(c), " "), lambda w: F.when(w.rlike(roman), F.upper(w)).otherwise(F.initcap(w)))
    return F.when((c == F.upper(c)) & c.rlike(r"\p{L}"), F.array_join(words, " ")).otherwise(c)


# --- words, sentences, citations ----------------------------------------------------------------------------------------------


def tokens(c: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-zäöüß0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)


def answer_tokens(c: Column) -> Column:
    """Lower-case words without ASCII punctuation."""
    return F.filter(F.split(F.translate(F.lower(c), PUNCTUATION, ""), r"(?U)\s+"), lambda t: t != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def without_citations(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\[\d+\]", ""))


def without_thoughts(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def citations(c: Column, sources: Column | int) -> Column:
    """The distinct source numbers cited, ascending, of those that exist."""
    last = sources if isinstance(sources, Column) else F.lit(sources)
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n >= 1) & (n <= last))))


def is_refusal(c: Column) -> Column:
    return c.rlike(REFUSAL) | (~c.contains("[") & (F.length(c) < 200))


def route(c: Column) -> Column:
    """'global', 'local' or null, by the question's wording."""
    return F.when(c.rlike(GLOBAL_QUESTION), "global").when(c.rlike(LOCAL_QUESTION), "local")


def position_percent(start: Column, total: Column) -> Column:
    return F.when(start.isNotNull() & (F.coalesce(total, F.lit(0)) > 0), F.least(F.lit(100), F.bround(start * 100 / total).cast("int")))


def parameter_count(c: Column) -> Column:
    """'7.6B' as a number."""
    said, pattern = strip(c), r"(?i)^([\d.]+)\s*([BMK])"
    unit = F.upper(F.regexp_extract(said, pattern, 2))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9)
    return F.floor(F.regexp_extract(said, pattern, 1).try_cast("double") * factor).cast("long")


# --- checks -------------------------------------------------------------------------------------------------------------------


def document_errors(c: Column) -> Column:
    """Names of the checks that a cleaned text fails."""
    dense = F.regexp_replace(c, r"(?U)\s+", "")
    return counted_errors(F.length(strip(c)), F.regexp_count(c, F.lit("\ufffd")), F.regexp_count(c, F.lit(r"\p{L}")), F.length(dense), F.length(c))


def counted_errors(stripped: Column, garbled: Column, letters: Column, dense: Column, length: Column | None = None) -> Column:
    """The same by counts: characters of the stripped text, replacement characters, letters, characters without white space, and of the text (else as stripped)."""
    length = stripped if length is None else length
    return F.array_compact(F.array(
        F.when(stripped < 200, "too_short"),
        F.when(garbled > F.greatest(F.lit(10), F.floor(0.001 * length)), "garbled"),
        F.when((dense > 0) & (letters / dense < 0.5), "few_letters"),
    ))


def question_errors(c: Column) -> Column:
    n = F.length(strip(c))
    return F.array_compact(F.array(F.when(n < 2, "too_short"), F.when(n > 2000, "too_long"), F.when(c.rlike(CONTROL), "control_characters")))


def cleaning_warnings(dropped: Column, not_ascii: Column, most_dropped: float = 0.4) -> Column:
    return F.array_compact(F.array(F.when(dropped > most_dropped, "much_text_lost"), F.when(not_ascii > 0.30, "many_characters_not_ascii")))
