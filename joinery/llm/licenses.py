"""Licence scan over a positional rare-token index, with DataFrame functions only (operator 5).

The index is small and fixed: of every template (a licence's opening passage, or its name) the
rarest words by inverse document frequency over the templates, and their places.
A text's words are looked up in it; a template's rare words must stand at the
same relative places, which is an intersection of shifted posting lists; at each place
that remains, the template's mandatory key phrase is compared word by word at its own place.
Other words of a passage may differ (names, versions, wording).

Only texts that hold a rare word of some template (as a substring, which is cheap to test)
are split into places; the count of words covers every text.  There is no shuffle.

Defined results: null and empty texts have no words; a text may be of any length; rows are scanned one by one, so ties and repeated
rows agree; an empty table gives no rows; places of different templates may overlap and count each; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, and the same as a SQL pattern: fixed values of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening passages of public licences: label, mandatory key phrase, passage. Fixed values.
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "under the terms of the gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("cc0", "copyright and related and neighboring rights", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("unlicense", "unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("bsl", "person or organization obtaining a copy", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
]
#: Names and openings of public licences and their labels, which are their own key phrases. Fixed values.
NAMES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "boost software license": "bsl",
    "eclipse public license": "epl",
}
RARE = 3


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    rare: tuple[int, ...]  # places of the rarest words
    key: tuple[int, int]  # the mandatory phrase: first word, and the one after its last
    label: str
    mass: float
    base: bool


def index(rare: int = RARE) -> list[Template]:
    """Templates with the places of their rarest words, by inverse document frequency over the templates."""
    texts = [(p.split(), p.split(), label, True) for p, label in BASE.items()] + [(p.split(), k.split(), label, False) for label, k, p in PASSAGES] + [(p.split(), p.split(), label, False) for p, label in NAMES.items()]
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in t for t, *_ in texts))) + 1 for t, *_ in texts for w in t}
    out = []
    for words, key, label, base in texts:
        first = {w: words.index(w) for w in words}
        own = sorted(first, key=lambda w: (-idf[w], -len(w), first[w]))[:rare]
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out.append(Template(tuple(words), tuple(sorted(first[w] for w in own)), (at, at + len(key)), label, sum(idf[w] for w in words), base))
    return out


def lower(text: Column) -> Column:
    """A-Z only."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def scan(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """doc_id, n_words, places (array of label, first, last, base) and the rest derived from them."""
    templates = index(rare)
    # a template can only match where its rarest word stands
    probes = sorted({t.words[max(t.rare, key=lambda i: (len(t.words[i]), -i))] for t in templates if len(t.words) > 2} | {"apache", "mit", "cc"})  # noqa: B023
    low = docs.select("doc_id", lower(F.col("text")).alias("_low"))
    edge = r"(?:^|[\x00-\x2F\x3A-\x60\x7B-\x7F])"
    hit = F.lit(False)
    for p in probes:
        if len(p) > 3:
            hit = hit | F.contains(F.col("_low"), F.lit(p))
    short = [p for p in probes if len(p) <= 3]
    hit = hit | ((F.contains(F.col("_low"), F.lit("license")) | F.contains(F.col("_low"), F.lit("by"))) & F.col("_low").rlike(edge + "(?:" + "|".join(short) + r")[\x00-\x2F\x3A-\x60\x7B-\x7F]+(?:license|by)"))
    own = low.select("doc_id", F.regexp_count("_low", F.lit(WORD)).cast("long").alias("n_words"), F.when(hit, F.regexp_extract_all("_low", F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_words"))
    vocabulary = sorted({t.words[i] for t in templates for i in t.rare})
    # postings of the text: places of indexed words only
    own = own.withColumn("_posts", F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary)))

    def shifted(word: str, i: int) -> Column:
        return F.transform(F.filter("_posts", lambda x: x["word"] == word), lambda x: x["at"] - i)

    def named(at: Column, t: Template) -> Column:
        rest = [F.lit(t.mass).alias("mass"), F.lit(t.base).alias("base")]
        last = lambda s: F.least(s + len(t.words) - 1, F.size("_words") - 1).cast("long")
        return F.transform(at, lambda s: F.struct(F.lit(t.label).alias("label"), s.cast("long").alias("first"), last(s).alias("last"), *rest))

    def places(t: Template) -> Column:
        lists = [shifted(t.words[i], i) for i in t.rare]
        meet = lists[0]
        for other in lists[1:]:
            meet = F.array_intersect(meet, other)
        begin, end = t.key
        phrase = F.array(*map(F.lit, t.words[begin:end]))
        # mandatory key phrase, word by word
        return F.filter(meet, lambda s: (s >= 0) & (F.slice("_words", F.greatest(s, F.lit(0)) + begin + 1, end - begin) == phrase))

    found = [named(places(t), t) for t in templates]
    empty = F.array().cast("array<struct<label:string,first:bigint,last:bigint,mass:double,base:boolean>>")
    return own.select("doc_id", "n_words", F.when(F.size("_posts") > 0, F.flatten(F.array(*found))).otherwise(empty).alias("places"))


def digests(docs: DataFrame) -> DataFrame:
    got = scan(docs).withColumn("_base", F.filter("places", lambda p: p["base"]))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    mass = F.aggregate("places", F.lit(0.0), lambda s, p: s + p["mass"])
    return got.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda p: p["first"])).alias("last_word"),
        names("_base").alias("base_labels"),
        names("places").alias("labels"),
        F.round(mass / (mass + F.lit(4.0)), 6).alias("score"),
    )


def oracle_sql() -> str:
    """The same in DuckDB SQL, every template looked for at every place."""
    lists = []
    for t in index():
        same = " and ".join(f"ws[i + {k + 1}] = '{t.words[k]}'" for k in sorted({*t.rare, *range(*t.key)}))
        at = f"list_filter(range(0, len(ws)), lambda i: {same})"
        lists.append(f"list_transform({at}, lambda i: {{'a': i, 'l': '{t.label}', 'm': cast({t.mass!r} as double), 'b': {str(t.base).lower()}}})")
    joined = lists[0]
    for other in lists[1:]:
        joined = f"list_concat({joined}, {other})"
    names = lambda c: f"array_to_string(list_sort(list_distinct(list_transform({c}, lambda x: x.l))), ',')"
    return f"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') ws from documents),
p as (select doc_id, len(ws) n, {joined} f from t), q as (select *, list_filter(f, lambda x: x.b) b, coalesce(list_sum(list_transform(f, lambda x: x.m)), 0) m from p)
select doc_id, cast(n as bigint) n_words, cast(len(b) as bigint) n_base, list_min(list_transform(b, lambda x: x.a)) first_word,
 list_max(list_transform(b, lambda x: x.a)) last_word, {names("b")} base_labels, {names("f")} labels, round(m / (m + 4.0), 6) score from q"""
