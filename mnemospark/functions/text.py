"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
PUNCTUATION_END = r"[!-/:-@\[-`{-~]+$"
WHITE = r"[\x20\x09-\x0D]+"

# English function words that carry no query meaning.
STOPWORDS = (
    "what when where which who why how the they them their known that this with from have been "
    "were being for was and are is his her she he a an of to in it on at by as or be do did does has had its"
).split()

# Words skipped when a question is turned into keywords.
QUESTION_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would shall should can could may might must "
    "to of in for on at by with from as into through during before after above below between under not no nor but or and "
    "so yet both either neither each every all any few many some most much such own other another only very also back just "
    "about out up over down off still again further then once here there when where why how more these those his her he she "
    "they their it its this that what who which you your we our them i me my us if im dont does doesnt didnt isnt"
).split()

# Words between a key and its value.
CONNECTORS = "is are was were be been being the a an of to in on at by for with from and or as that which equals".split()

# Words that show a lookup of a code.
CODE_WORDS = "passkey password passcode serial needle".split()

# Words that documents may write as two.
COMPOUNDS = {"passkey": ("pass", "key"), "passcode": ("pass", "code"), "password": ("pass", "word")}


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def trimmed_words(text: Column, least_bytes: int = 3) -> Column:
    """Lower-cased words without punctuation at their end, of at least ``least_bytes``."""
    bare = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, PUNCTUATION_END, ""))
    return F.filter(bare, lambda w: F.octet_length(w) >= least_bytes)


def without(values: Column, drop: list[str]) -> Column:
    return F.filter(values, lambda w: ~w.isin(*drop))


def count_of(text: Column, pattern: str) -> Column:
    """Non-overlapping, case-insensitive occurrences of a literal."""
    low = F.lower(text)
    p = pattern.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("long")


def contains_token(text: Column, token: str) -> Column:
    """The token stands with no ASCII letter or digit on either side."""
    return F.lower(text).rlike(rf"(?<![A-Za-z0-9])\Q{token.lower()}\E(?![A-Za-z0-9])")


def looks_like_code(word: Column) -> Column:
    """5 to 10 digits and nothing else, once what is plainly another number is excluded."""
    dates = word.rlike(r"^(19|20)\d{2}[-/.]?\d{2}[-/.]?\d{2}$")
    units = word.rlike(r"(?i)^[$€£]|(st|nd|rd|th|%|km|kg|mb|gb|ms)$")
    return word.rlike(r"^\d{5,10}$") & ~dates & ~units


def split_identifier(name: Column) -> Column:
    """Parts of snake_case, camelCase and PascalCase names, lower-cased."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda w: w != "")


def char_windows(text: Column, size: int = 512, stride: int = 256, least: int = 50) -> Column:
    """Windows of characters; the last one is the first that reaches the end.  Windows whose
    trimmed text has under ``least`` bytes go; if none stays, the whole text does."""
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / stride)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.substring(text, i * stride + 1, F.lit(size)).alias("part")))
    kept = F.filter(cut, lambda w: F.octet_length(F.trim(w["part"])) >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(F.lit(0).alias("pos"), text.alias("part"))))


def word_windows(text: Column, size: int = 512, stride: int = 256) -> Column:
    """Windows of words joined by one space; texts of at most ``size`` words are one window."""
    all_words = words(text)
    last = F.greatest(F.lit(0), F.ceil((F.size(all_words) - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", F.slice(all_words, i * stride + 1, size)).alias("part")))


def ngrams(values: Column, n: int) -> Column:
    """Runs of ``n`` values joined by a space.  ``values`` is bound to a variable: an expression used
    within a lambda would be evaluated for every run."""

    def runs(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v) - n + 1)
        return F.when(F.size(v) >= n, F.transform(starts, lambda i: F.concat_ws(" ", F.slice(v, i, n)))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(values), runs), F.lit(0))


def cjk_bigrams(text: Column) -> Column:
    """Adjacent pairs within runs of Chinese, Japanese and Korean characters."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,}"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


def trigrams(text: Column) -> Column:
    """Distinct lower-cased runs of three characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def normalized(text: Column) -> Column:
    """Typographic dashes and quotes as ASCII."""
    return F.translate(text, "–—‐‘’“”", "---''\"\"")


def clean_ocr(text: Column) -> Column:
    """Single spaces, character runs cut to two; empty if under 2 bytes or half alphanumeric."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(text, r"(.)\1{2,}", "$1$1"), WHITE, " "))
    letters = F.length(F.regexp_replace(spaced, r"[^\p{L}\p{N}]", ""))
    return F.when((F.octet_length(spaced) < 2) | (letters * 2 < F.length(spaced)), F.lit("")).otherwise(spaced)


def content_key(text: Column) -> Column:
    """Lower-cased text with white space collapsed: the signature of equal content."""
    return F.lower(F.trim(F.regexp_replace(text, WHITE, " ")))


def snippet(text: Column, pattern: str, around: int = 40) -> Column:
    """Characters around the first case-insensitive hit; null without one."""
    at = F.locate(pattern.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(text, start, at + len(pattern) + around - start))


def value_of_key(text: Column, key: str) -> Column:
    """What follows a key: separators and up to three connecting words are skipped, the value
    ends at a comma, semicolon or line feed."""
    joins = "|".join(CONNECTORS)
    return F.regexp_extract(text, rf"(?i)\b{re.escape(key)}\b[\s:=\-]*(?:(?:{joins})\s+){{0,3}}([^,;\n]+)", 1)


def wikilinks(text: Column) -> Column:
    """Distinct concepts of ``[[concept|alias]]`` and ``[[concept#part]]``, lower-cased; not
    where brackets follow a letter or digit, as in code."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])\[\[([^\[\]|#]+)(?:[|#][^\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: F.length(x).between(2, 64) & x.rlike(r"\p{L}")))


def keywords(text: Column) -> Column:
    """Words of a question that carry meaning, in order of appearance: no stopword, and three
    characters or a digit."""
    return F.array_distinct(F.filter(tokens(text), lambda w: ~w.isin(*QUESTION_STOPWORDS) & ((F.length(w) >= 3) | w.rlike(r"\d"))))


def entities(text: Column) -> Column:
    """Runs of two or more capitalised words, and what stands in parentheses."""
    capital = F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)+"), F.lit(0))
    inside = F.regexp_extract_all(text, F.lit(r"\(([^()]{2,60})\)"), F.lit(1))
    return F.array_distinct(F.concat(capital, inside))


def scope_tag(query: Column) -> Column:
    """The tag that a question names: a version, client, language or status; else null."""
    low = F.lower(query)
    numbered = F.regexp_extract(low, r"(?:^|\s)(version|revision|rev|draft|final|client|department|dept|jurisdiction|lang|language)[!-/:-@\[-`{-~]*\s+(\d+)", 1)
    number = F.regexp_extract(low, r"(?:^|\s)(?:version|revision|rev|draft|final|client|department|dept|jurisdiction|lang|language)[!-/:-@\[-`{-~]*\s+(\d+)", 1)
    status = F.regexp_extract(low, r"(?:^|\s)(draft|final|confidential|internal)(?=[!-/:-@\[-`{-~]*(?:\s|$))", 1)
    short = F.regexp_extract(low, r"(?:^|\s)v(\d+)(?=[!-/:-@\[-`{-~]*(?:\s|$))", 1)
    name = F.when(numbered.isin("rev", "revision"), "version").otherwise(numbered)
    return F.when(number != "", F.concat(name, F.lit(":"), number)).when(status != "", F.concat(F.lit("status:"), status)).when(short != "", F.concat(F.lit("version:"), short))


def auto_tags(filename: Column, text: Column) -> Column:
    """Tags that a file's name and its text show: version and status."""
    from_name = F.regexp_extract(F.lower(filename), r"(?:^|[^a-z])v(?:er(?:sion)?)?[ _-]?(\d+)", 1)
    from_text = F.regexp_extract(text, r"(?i)\b(?:version|revision)\s+(\d+)", 1)
    tag = lambda prefix, value: F.when(value != "", F.concat(F.lit(prefix), value))
    status = F.when(F.lower(filename).contains("draft") | text.rlike(r"(?i)\bdraft\b"), "status:draft").when(F.lower(filename).contains("final"), "status:final")
    secret = F.when(text.contains("CONFIDENTIAL"), "status:confidential")
    return F.array_distinct(F.array_compact(F.array(tag("version:", from_name), tag("version:", from_text), status, secret)))


def ground_dates(text: Column, today: Column) -> Column:
    """Relative dates with what they stand for on ``today`` appended."""
    low = F.lower(text)
    last_month, last_quarter = F.add_months(today, -1), F.add_months(today, -3)
    notes = F.concat(
        F.when(low.contains("last year"), F.concat(F.lit(" [last year = "), (F.year(today) - 1).cast("string"), F.lit("]"))).otherwise(""),
        F.when(low.contains("this year"), F.concat(F.lit(" [this year = "), F.year(today).cast("string"), F.lit("]"))).otherwise(""),
        F.when(low.contains("last quarter"), F.concat(F.lit(" [last quarter = Q"), F.quarter(last_quarter).cast("string"), F.lit(" "), F.year(last_quarter).cast("string"), F.lit("]"))).otherwise(""),
        F.when(low.contains("last month"), F.concat(F.lit(" [last month = "), F.date_format(last_month, "yyyy-MM"), F.lit("]"))).otherwise(""),
    )
    return F.concat(text, notes)


def variants(word: Column) -> Column:
    """Forms of a word without common English endings, and the parts of a hyphenated one."""
    stem = lambda ending, least: F.when(word.endswith(ending) & (F.length(word) >= least), F.substring(word, 1, F.length(word) - len(ending)))
    parts = F.filter(F.split(word, "-"), lambda p: F.length(p) >= 3)
    return F.array_distinct(F.concat(F.array_compact(F.array(word, stem("ers", 6), stem("ing", 6), stem("ed", 5), stem("es", 5), stem("s", 4))), parts))


def compounds(word: Column) -> Column:
    """The parts of a compound that is often written as two words, else the word."""
    out = F.array(word)
    for whole, parts in COMPOUNDS.items():
        out = F.when(word == whole, F.array(*map(F.lit, parts))).otherwise(out)
    return out


def sounds(word: Column) -> Column:
    """Soundex in which vowels, h and w separate equal codes; ``0000`` for no letters."""
    letters = F.regexp_replace(F.upper(word), r"[^A-Z]", "")
    code = F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
    once = F.regexp_replace(code, r"(\d)\1+", "$1")
    tail = F.regexp_replace(F.substring(once, 2, 1 << 20), "0", "")
    return F.when(letters == "", "0000").otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), tail), 4, "0"))


def calls(code: Column) -> Column:
    """Names that code calls: identifiers before a parenthesis and procedures after EXEC."""
    plain = F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    procs = F.regexp_extract_all(code, F.lit(r"(?i)\bexec(?:ute)?\s+(?:[\[\]A-Za-z0-9_]+\.)?\[?([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.array_distinct(F.filter(F.concat(plain, procs), lambda x: ~F.lower(x).isin("if", "for", "while", "switch", "return", "catch", "def", "class", "function", "fn", "in", "values", "exists", "and", "or", "not")))


def without_comments(sql: Column) -> Column:
    """SQL without block and line comments; what looks like one within a string stays."""
    return F.regexp_replace(sql, r"(?s)('(?:[^']|'')*')|/\*.*?\*/|--[^\n]*", "$1 ")


def code_only(sql: Column) -> Column:
    """SQL without comments and strings, read from the left, so that each ends where it does."""
    return F.regexp_replace(sql, r"(?s)/\*.*?\*/|--[^\n]*|'(?:[^']|'')*'", " ")


def action_residue(text: Column) -> Column:
    """What remains of a task line without names of files, paths and identifiers."""
    return F.concat_ws(" ", F.filter(words(F.lower(text)), lambda w: ~w.rlike(r"[./\\_:]|\d")))


def task_hash(text: Column) -> Column:
    """16 hex digits that name a task, equal for equal normalised text."""
    return F.substring(F.sha2(content_key(text), 256), 1, 16)


def spellings(words_: Column) -> Column:
    """Names that two or three adjacent words may stand for: snake, camel and Pascal case."""
    first = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))

    def of(n: int) -> Column:
        runs = F.when(F.size(words_) >= n, F.transform(F.sequence(F.lit(1), F.size(words_) - n + 1), lambda i: F.slice(words_, i, n))).otherwise(F.array().cast("array<array<string>>"))
        pascal = lambda r: F.concat_ws("", F.transform(r, first))
        return F.flatten(F.transform(runs, lambda r: F.array(F.concat_ws("_", r), F.concat(F.element_at(r, 1), pascal(F.slice(r, 2, n))), pascal(r))))

    return F.array_distinct(F.concat(of(2), of(3)))


def singular(word: Column) -> Column:
    """A table or class name in the singular by the common English endings."""
    return F.when(word.rlike("(?i)ies$"), F.regexp_replace(word, "(?i)ies$", "y")).when(word.rlike("(?i)(ss|us|is)$"), word).when(word.rlike("(?i)(x|ch|sh|ss)es$"), F.regexp_replace(word, "(?i)es$", "")).otherwise(F.regexp_replace(word, "(?i)s$", ""))


def normal_path(path: Column) -> Column:
    """A route in one form: lower case, one slash between parts, ``{}`` for parameters."""
    plain = F.regexp_replace(F.lower(path), r"\{[^}]*\}|:[a-z_]\w*", "{}")
    return F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(plain, r"^/+|/+$", "")), "/+", "/")


def register_tokenizers(spark) -> None:
    """``word_tokens(text)`` and ``name_parts(name)`` as SQL functions, inlined into plans."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION word_tokens(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+', 0)")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION name_parts(n STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '$1 $2'), '([A-Z]+)([A-Z][a-z])', '$1 $2')), '[^a-z0-9]+'), w -> w <> '')")
