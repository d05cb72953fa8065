"""English stemming by the published Porter2 (Snowball English) rules, and a hashed encoder.

Both need loops over letters or vectors that column expressions cannot express; they run as
Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"

# Fixed values of the algorithm: exceptional words, words that stay, and suffix replacements.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()


def _regions(word: str) -> tuple[int, int]:
    """Where the regions R1 and R2 begin."""

    def after(start: int) -> int:
        found = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
        return found.end() if found else len(word)

    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = after(0) if first is None else first
    return r1, after(r1)


def _short_syllable(word: str) -> bool:
    return bool(re.search(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", word) or re.fullmatch(f"[{VOWELS}][^{VOWELS}]", word))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word; other words come back as they are."""
    if len(word) <= 2 or not re.fullmatch(r"[a-z']+", word):
        return word
    word = word.lstrip("'")
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = re.sub(f"(^|[{VOWELS}])y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}].", word[:-1]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # past and progressive forms
    if match := re.search("(eedly|eed)$", word):
        if match.start() >= r1:
            word = word[: match.start()] + "ee"
    elif (match := re.search("(ingly|edly|ing|ed)$", word)) and re.search(f"[{VOWELS}]", word[: match.start()]):
        word = word[: match.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif _short_syllable(word) and r1 >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # longer suffixes, each the longest that fits, in R1 or R2
    for table in (STEP_2, STEP_3):
        for ending in sorted([*table, *(("ogi", "li") if table is STEP_2 else ("ative",))], key=len, reverse=True):
            if word.endswith(ending):
                at = len(word) - len(ending)
                if at >= r1:
                    if ending == "ogi":
                        word = word[:-1] if word[at - 1 : at] == "l" else word
                    elif ending == "li":
                        word = word[:at] if word[at - 1 : at] and word[at - 1] in LI_ENDINGS else word
                    elif ending == "ative":
                        word = word[:at] if at >= r2 else word
                    else:
                        word = word[:at] + table[ending]
                break
    for ending in sorted([*STEP_4, "ion"], key=len, reverse=True):
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r2 and (ending != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stems(tokens: Column) -> Column:
    """Stems of arrays of lower-case words."""

    @F.pandas_udf("array<string>")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda x: None if x is None else [stem(w) for w in x])

    return run(tokens)


def _vector(word: str, dims: int) -> np.ndarray:
    raw = np.random.default_rng(xxhash.xxh64_intdigest(word.encode())).standard_normal(dims)
    return raw / np.linalg.norm(raw)


#: Vectors that a worker keeps: of the words it met first, among them the frequent ones.
KEPT = 300_000
_kept: dict[int, tuple[dict[str, int], np.ndarray]] = {}


def _vectors(words: list[str], dims: int) -> np.ndarray:
    names, table = _kept.setdefault(dims, ({}, np.empty((max(KEPT, 1), dims))))
    at = np.fromiter((names.get(w, -1) for w in words), np.int64, len(words))
    out = table[at]
    for k in np.flatnonzero(at < 0):
        out[k] = _vector(words[k], dims)
        if (place := len(names)) < KEPT:
            table[place], names[words[k]] = out[k], place
    return out


def _means(tokens: pa.Array, dims: int, words: int = 1 << 20) -> Iterator[list[float]]:
    """One vector per list; each distinct word of some ``words`` words is looked up once."""
    n = tokens.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat, end = tokens.flatten(), np.cumsum(n)
    start, k = end - n, 0
    while k < len(n):
        to = max(k + 1, int(np.searchsorted(end, start[k] + words, "right")))
        coded = flat.slice(start[k], end[to - 1] - start[k]).dictionary_encode()
        table, at = _vectors(coded.dictionary.to_pylist(), dims), coded.indices.to_numpy()
        for a, b in zip(start[k:to] - start[k], end[k:to] - start[k], strict=True):
            mean = np.mean(table[at[a:b]], axis=0) if a < b else np.zeros(dims)
            length = np.linalg.norm(mean)
            yield (mean / length if length else mean).tolist()
        k = to


def hash_encoder(dims: int = 64):
    """Encoder of word arrays: the mean of one pseudo-random unit vector per word, of length
    one.  It stands where a trained embedding table is not at hand; equal words, equal parts."""

    @F.arrow_udf("array<double>")
    def encode(tokens: pa.Array) -> pa.Array:
        return pa.array(_means(tokens, dims), pa.list_(pa.float64()))

    return encode


def word_pieces(vocabulary: frozenset[str] | set[str], unknown: str = "[UNK]", longest: int = 100):
    """Greedy longest-match pieces of words; later pieces of a word begin with ``##``."""

    def pieces(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None or len(word) > longest:
                return [unknown]
            out.append(("##" if at else "") + word[at:end])
            at = end
        return out

    @F.pandas_udf("array<string>")
    def tokenize(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else [p for w in re.findall(r"\w+|[^\w\s]", t.lower()) for p in pieces(w)])

    return tokenize


def concepts(text: Column) -> Column:
    """Up to twelve distinct concepts of a text in order: runs of capitalised words, and
    references of letters and digits such as ``RFC-2119``."""
    found = F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L}\p{N}_]+(?: \p{Lu}[\p{L}\p{N}_]+)+|\b[A-Z]{2,}-?\d+\b"), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, F.lower)), 1, 12)


def focused(weights: dict[str, float], size: int = 40, most: int = 3):
    """Windows of words around the weightiest matches of a text, merged where they overlap."""

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        def one(t) -> list[str]:
            words = (t or "").split()
            hits = [(-weights[w], k) for k, w in enumerate(re.sub(r"\W+$", "", x.lower()) for x in words) if w in weights]
            spans: list[list[int]] = []
            for _, k in sorted(hits):
                low, high = max(0, k - size // 2), min(len(words), k + size // 2)
                near = next((s for s in spans if s[0] <= high and low <= s[1]), None)
                if near:
                    near[0], near[1] = min(near[0], low), max(near[1], high)
                elif len(spans) < most:
                    spans.append([low, high])
            return [" ".join(words[a:b]) for a, b in sorted(spans)]

        return text.map(one)

    return cut
