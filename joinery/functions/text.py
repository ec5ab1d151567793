"""Normalisation of names and addresses as column expressions: whole-stage JVM work, no UDF."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import vocabulary as v

_ROLE = re.compile(r"(?:CAPITAL |SMALL )?(?:LETTER|LIGATURE|VOWEL SIGN|VOWEL|SIGN|DIGIT) (.+)")


@lru_cache(maxsize=4096)
def ascii_of(ch: str) -> str:
    """ASCII for one character: compatibility forms without marks; else what its Unicode name says.

    Indic letters are consonants with an unwritten a (DEVANAGARI LETTER KA: k), vowels and vowel signs spell
    themselves, a virama and a nukta are silent, anusvara and candrabindu are n, visarga is h.
    """
    if ch < "\x80":
        return ch
    out = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
    if out and all(c < "\x80" for c in out):
        return out
    found = unicodedata.name(ch, "")
    if ch.isdecimal():
        return str(unicodedata.decimal(ch))
    if any(x in found for x in ("DASH", "HYPHEN")):
        return "-"
    if "QUOTATION MARK" in found or "APOSTROPHE" in found:
        return "'"
    m = _ROLE.search(found)
    if not m:
        return "" if unicodedata.combining(ch) or unicodedata.category(ch) in ("Mn", "Mc", "Cf") else " "
    said = m[1].split(" WITH ")[0].lower()
    if "VOWEL" in found or found.startswith("LATIN"):
        said = {"sharp s": "ss", "thorn": "th", "eth": "d"}.get(said, said)
    said = {"virama": "", "nukta": "", "anusvara": "n", "candrabindu": "n", "visarga": "h", "avagraha": ""}.get(said, said)
    said = said.split()[-1] if said else ""
    if "LETTER" in found and unicodedata.category(ch) == "Lo" and len(said) > 1 and said.endswith("a") and said not in ("aa",):
        return said[:-1]
    return said.upper() if "CAPITAL" in found else said


@pandas_udf(StringType())
def _ascii(c: pd.Series) -> pd.Series:
    known = {x: "".join(map(ascii_of, unicodedata.normalize("NFKC", x))) for x in c.dropna().unique()}
    return pd.Series([known.get(x) for x in c.tolist()], dtype=object)


def to_ascii(c: Column) -> Column:
    """Transliterated; null is ''.  Only values beyond ASCII go through Python, each distinct one of a batch once."""
    odd = c.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_ascii(F.when(odd, c)), c, F.lit(""))


def clean(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def scrub(c: Column) -> Column:
    """Without "(id: 12)", with or without colon and spaces, and web parts; & and + as "and"."""
    low = F.regexp_replace(F.lower(c), r"\(\s*id\s*:?\s*\d+\s*\)", " ")
    return F.regexp_replace(F.regexp_replace(low, v.WEB, " "), "[&+]", " and ")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def drop_words(c: Column, words: list[str]) -> Column:
    return F.array_join(F.filter(tokens(c), lambda t: ~t.isin(words)), " ")


def skeleton(c: Column) -> Column:
    """Consonant skeleton: sound-alikes to one letter, inner vowels and h out, repeats collapsed."""
    for a, b in (("ph", "f"), ("ck", "k"), ("[cq]", "k"), ("z", "s"), (r"\B[aeiouh]", ""), (r"([a-z])\1+", "$1")):
        c = F.regexp_replace(c, a, b)
    return c


def skeleton_of(word: str) -> str:
    """The same of one word, in Python."""
    for a, b in (("ph", "f"), ("ck", "k"), ("[cq]", "k"), ("z", "s"), (r"\B[aeiouh]", ""), (r"([a-z])\1+", r"\1")):
        word = re.sub(a, b, word)
    return word


#: Skeletons of legal words, of three letters or more: they are dropped from names' skeletons, so misspelt legal words go as well.
LEGAL_SKELETONS = sorted({k for k in map(skeleton_of, v.LEGAL) if len(k) >= 3})


def folded(c: Column) -> Column:
    """A looser skeleton: bh, x, j and inner y as well."""
    for a, b in (("bh", "v"), ("x", "ks"), ("j", "g"), (r"\By", "")):
        c = F.regexp_replace(c, a, b)
    return skeleton(c)


def address_tokens(c: Column) -> Column:
    return F.array_join(F.filter(tokens(c), lambda t: t.rlike("^[a-z]{3,}$") & ~t.isin(v.ADDR_STOP)), " ")


def postcode(address: Column) -> Column:
    """The first number of 5 or 6 digits after the first comma, without leading zeros; null if none."""
    tail = F.get(F.split(address, ",", 2), F.lit(1))
    return F.ltrim(F.nullif(F.regexp_extract(tail, r"\b\d{5,6}\b", 0), F.lit("")), F.lit("0"))


def numbers(address: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(address, F.lit(r"\d+"), F.lit(0)), lambda x: F.ltrim(x, F.lit("0"))), lambda x: (x != "") & (F.length(x) <= 5))


def house(address: Column, code: Column, units: bool = True) -> Column:
    """The first short number, or the second if the first is the postcode; without ``units`` numbers of units and mailboxes do not count."""
    n = numbers(address if units else F.regexp_replace(address, v.UNIT_NUMBER, " "))
    return F.when(F.coalesce(F.get(n, F.lit(0)) == code, F.lit(False)), F.get(n, F.lit(1))).otherwise(F.get(n, F.lit(0)))


def map_tokens(c: Column, mapping: dict[str, str], drop: list[str] = ()) -> Column:
    """Each token by the dictionary, once."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    own = F.filter(tokens(c), lambda t: ~t.isin(list(drop))) if drop else tokens(c)
    return F.array_join(F.transform(own, lambda t: F.coalesce(F.element_at(table, t), t)), " ")


def deleet(c: Column, of: str = v.LEET_FROM, to: str = v.LEET_TO) -> Column:
    """Digits typed for letters, in tokens of two letters or more and no more digits than letters; not ordinals."""

    def one(t: Column) -> Column:
        letters, digits = F.regexp_count(t, F.lit("[a-z]")), F.regexp_count(t, F.lit("[0-9]"))
        return F.when((digits > 0) & (letters >= 2) & (letters >= digits) & ~t.rlike("^[0-9]+(st|nd|rd|th)$"), F.translate(t, of, to)).otherwise(t)

    return F.array_join(F.transform(tokens(c), one), " ")


def dedupe(c: Column) -> Column:
    return F.array_join(F.array_distinct(tokens(c)), " ")


def canonical_core(c: Column) -> Column:
    return dedupe(drop_words(deleet(F.regexp_replace(c, v.ALIAS, "")), v.LEGAL + v.HONORIFIC))


def canonical_address(c: Column) -> Column:
    """Without unit, mailbox and number labels; fractions and leading zeros gone; street types, ordinals, states and cities in one form."""
    for pattern, to in v.ADDR_RULES:
        c = F.regexp_replace(c, pattern, to)
    for phrase, code in v.STATE_PHRASES.items():
        c = F.regexp_replace(c, rf"\b{phrase}\b", code)
    return map_tokens(c, v.STREET | v.STATE_WORDS, v.ADDR_DROP)


def sorted_characters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def derived_name(c: Column) -> Column:
    """Without runs of seven digits or more and repeated words, look-alike digits as letters; the same again gives the same."""
    return dedupe(F.regexp_replace(deleet(c, v.DIGIT_FROM, v.DIGIT_TO), r"\b\d{7,}\b", " "))


def serialised(name: Column, address: Column) -> Column:
    """A record as one line for an encoder."""
    return F.concat(F.lit("[COL] name [VAL] "), F.coalesce(name, F.lit("")), F.lit(" [COL] address [VAL] "), F.coalesce(address, F.lit("")))


@pandas_udf(StringType())
def _plain(c: pd.Series) -> pd.Series:
    one = lambda t: " ".join(re.findall(r"[^\W_]+", "".join(ch for ch in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(ch))))
    known = {t: one(t) for t in c.dropna().unique()}
    return pd.Series([known.get(t) for t in c.tolist()], dtype=object)


def profiling_fold(c: Column) -> Column:
    """Caseless words without marks, of any script; null is ''."""
    return F.coalesce(_plain(c), F.lit(""))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def stable_mod(key: Column, salt: str, k: int) -> Column:
    """The first 8 bytes of SHA-256(salt + key), little-endian, modulo k."""
    h = F.sha2(F.concat(F.lit(salt), key), 256)
    flipped = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    return F.pmod(F.conv(flipped, 16, 10).cast("decimal(20,0)"), F.lit(k).cast("decimal(20,0)")).cast("int")


def word_grams(c: Column, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """Distinct runs of so many words."""
    t = tokens(c)
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " ")) if n > 1 else t for n in sizes]  # noqa: B023
    runs = [F.when(F.size(t) >= n, r).otherwise(F.array().cast("array<string>")) for n, r in zip(sizes, runs, strict=True)]
    return F.array_distinct(F.flatten(F.array(*runs)))


def char_grams(c: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Distinct n-grams of each token padded by one space; a shorter token counts once."""

    def grams(t: Column) -> Column:
        padded = F.concat(F.lit(" "), t, F.lit(" "))
        return F.flatten(F.array(*[F.when(F.length(t) + 2 >= n, _cut(padded, t, n)).otherwise(F.array(padded)) for n in sizes]))

    return F.array_distinct(F.flatten(F.transform(tokens(c), grams)))


def _cut(padded: Column, t: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) + 3 - n, F.lit(1))), lambda i: F.substr(padded, i, F.lit(n)))

