"""License scan by ordered signature rules.

A text becomes a chain of words, each written as " word ", so that a rule is a regular expression over whole words and
the number of spaces before a match gives its word position. Rules are built from families (name, versions, ways to cite
them), some hundreds in all. A document is scanned only if one alternation of all keywords finds something, and only by
rules whose own keyword occurs. Detections compete: one that lies inside another of higher priority (or, at equal priority,
inside a longer one) is suppressed. The base phrases are found by the same scan and are never suppressed.

It is one projection, without a shuffle; hot sources and groups of copies need no care. Null and empty texts have no words
and no labels. Null ids are carried, repeated rows give repeated results, other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, only, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# License families. (label, names, versions, abbreviations of identifiers)
FAMILIES = (
    ("gpl", ("gnu general public license", "general public license"), ("1.0", "2.0", "3.0"), ("gpl", "gnu gpl")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license"), ("2.0", "2.1", "3.0"), ("lgpl", "gnu lgpl")),
    ("agpl", ("gnu affero general public license", "affero general public license"), ("1.0", "3.0"), ("agpl", "gnu agpl")),
    ("gfdl", ("gnu free documentation license",), ("1.1", "1.2", "1.3"), ("gfdl", "gnu fdl")),
    ("apache", ("apache license", "apache software license"), ("1.0", "1.1", "2.0"), ("apache", "asl")),
    ("mpl", ("mozilla public license",), ("1.0", "1.1", "2.0"), ("mpl",)),
    ("epl", ("eclipse public license",), ("1.0", "2.0"), ("epl",)),
    ("cddl", ("common development and distribution license",), ("1.0", "1.1"), ("cddl",)),
    ("eupl", ("european union public licence", "european union public license"), ("1.0", "1.1", "1.2"), ("eupl",)),
    ("osl", ("open software license",), ("1.0", "2.0", "2.1", "3.0"), ("osl",)),
    ("afl", ("academic free license",), ("1.1", "1.2", "2.0", "2.1", "3.0"), ("afl",)),
    ("artistic", ("artistic license",), ("1.0", "2.0"), ("artistic",)),
    ("bsl", ("boost software license",), ("1.0",), ("bsl",)),
    ("ofl", ("sil open font license", "open font license"), ("1.0", "1.1"), ("ofl",)),
    ("psf", ("python software foundation license",), ("2.0",), ("psf", "python")),
    ("ms-pl", ("microsoft public license",), (), ("ms pl",)),
    ("ms-rl", ("microsoft reciprocal license",), (), ("ms rl",)),
    ("cpl", ("common public license",), ("1.0",), ("cpl",)),
    ("ipl", ("ibm public license",), ("1.0",), ("ipl",)),
    ("zpl", ("zope public license",), ("1.1", "2.0", "2.1"), ("zpl",)),
    ("php", ("php license",), ("3.0", "3.01"), ("php",)),
    ("mit", ("mit license", "expat license"), (), ("mit", "expat")),
    ("isc", ("isc license",), (), ("isc",)),
    ("zlib", ("zlib license", "zlib libpng license"), (), ("zlib",)),
    ("unlicense", ("unlicense",), (), ("unlicense",)),
    ("wtfpl", ("do what the fuck you want to public license",), (), ("wtfpl",)),
    ("cc0", ("cc0 universal", "creative commons zero"), ("1.0",), ("cc0",)),
    ("odbl", ("open database license",), ("1.0",), ("odbl",)),
    ("sspl", ("server side public license",), ("1",), ("sspl",)),
    ("busl", ("business source license",), ("1.1",), ("busl",)),
)
# The variants of BSD and Creative Commons, and notice texts.
BSD = (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four"))
CREATIVE = (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by nc", "attribution noncommercial"),
            ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))
CREATIVE_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms"),
    ("gpl", "you should have received a copy of the gnu general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license"),
    ("apache", "licensed under the apache license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "proprietary and confidential"),
)
NOTICE, TITLE_VERSION, TAG, TITLE, SHORT = 50, 40, 35, 20, 10  # priorities


def chain(words: str) -> str:
    """The regular expression of words in a row; alternatives and optional parts are written out by the callers."""
    return "".join(f" {w} " for w in words.split())


def _version(v: str) -> str:
    """Version words after a name: "version 2.0", "v2", "2.0", with a trailing .0 optional."""
    major, _, minor = v.partition(".")
    tail = f" {minor} " if minor not in ("", "0") else f"(?: {minor} )?" if minor else ""
    return rf"(?: version | v )?(?: v{major} | {major} ){tail}"


def rules() -> list[dict]:
    """All rules: id, label, priority, keyword (which must occur as words) and pattern over the word chain."""
    out = []

    def rule(label, priority, keyword, pattern):
        out.append({"id": len(out), "label": label, "priority": priority, "keyword": chain(keyword), "pattern": pattern})

    for label, names, versions, short in FAMILIES:
        for name in names:
            rule(label, TITLE, name, chain(name))
            for v in versions:
                rule(f"{label}-{v}", TITLE_VERSION, name, chain(name) + _version(v))
        for s in short:
            rule(label, TAG, s, chain(f"spdx license identifier {s}"))
            rule(label, SHORT, s, f"{chain(s)}(?: licensed | license | licence )")
            for v in versions:
                rule(f"{label}-{v}", TAG, s, chain(f"spdx license identifier {s}") + _version(v))
                rule(f"{label}-{v}", SHORT + 5, s, f"(?: under  the | under ){chain(s)}{_version(v)}")
    for digit, word in BSD:
        rule(f"bsd-{digit}-clause", TITLE_VERSION, "clause", f"(?: {digit} | {word} ) clause  bsd (?: license )?")
        rule(f"bsd-{digit}-clause", TITLE_VERSION, "clause", f" bsd  {digit}  clause (?: license )?")
    rule("bsd", TITLE, "bsd", chain("bsd license"))
    for short, long in CREATIVE:
        label = "cc-" + short.replace(" ", "-")
        rule(label, TITLE + len(short), f"cc {short}", chain(f"cc {short}"))
        rule(label, TITLE + len(short), "creative commons", chain(f"creative commons {long}"))
        for v in CREATIVE_VERSIONS:
            rule(f"{label}-{v}", TITLE_VERSION + len(short), f"cc {short}", chain(f"cc {short}") + _version(v))
            rule(f"{label}-{v}", TITLE_VERSION + len(short), "creative commons", chain(f"creative commons {long}") + "(?: international | unported )?" + _version(v))
    for label, notice in NOTICES:
        rule(label, NOTICE, notice, chain(notice))
    return out


def word_chain(text: Column) -> Column:
    """Every word of the lower-cased text as " word "; an empty string if there is none."""
    spaced = F.btrim(F.regexp_replace(ascii_lower(text), SEPARATORS, "  "), F.lit(" "))
    return let(spaced, lambda s: F.when(s == "", "").otherwise(F.concat(F.lit(" "), s, F.lit(" "))))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """ARRAY<STRUCT<first, last>>: the word positions that each match covers."""
    step = lambda gaps: lambda acc, hit: F.struct(
        (acc["i"] + 1).alias("i"), (acc["at"] + _spaces(F.get(gaps, acc["i"])) / 2 + _spaces(hit) / 2).cast("bigint").alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + _spaces(F.get(gaps, acc["i"])) / 2).cast("bigint").alias("first"),
                                              (acc["at"] + _spaces(F.get(gaps, acc["i"])) / 2 + _spaces(hit) / 2 - 1).cast("bigint").alias("last")))).alias("out"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("out"))
    return let(F.call_function("split", words, pattern, F.lit(-1)), lambda gaps: F.aggregate(
        F.regexp_extract_all(words, pattern, F.lit(0)), start, step(gaps), lambda acc: acc["out"]))


FOUND = "array<struct<first:bigint,last:bigint,label:string,priority:int,id:int>>"


def _found(words: Column, rule: Column) -> Column:
    return F.transform(_places(words, rule["pattern"]), lambda p: F.struct(
        p["first"].alias("first"), p["last"].alias("last"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["id"].alias("id")))


def _detect(words: Column, table: list[dict]) -> Column:
    """All detections of the rules whose keyword occurs."""
    literal = F.array(*[F.struct(*[F.lit(r[k]).alias(k) for k in ("id", "label", "priority", "keyword", "pattern")]) for r in table])
    named = F.filter(literal, lambda r: F.contains(words, r["keyword"]))
    return F.flatten(F.transform(named, lambda r: _found(words, r)))


def unsuppressed(found: Column) -> Column:
    """Detections that do not lie inside one of higher priority, or of the same priority and longer, or the same place and an earlier rule."""

    def beaten(x: Column, y: Column) -> Column:
        longer = (y["last"] - y["first"]) > (x["last"] - x["first"])
        return (y["first"] <= x["first"]) & (y["last"] >= x["last"]) & (
            (y["priority"] > x["priority"]) | ((y["priority"] == x["priority"]) & (longer | ((y["last"] - y["first"] == x["last"] - x["first"]) & (y["id"] < x["id"])))))

    return let(found, lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: beaten(x, y))))


def prefilter(table: list[dict]) -> str:
    """One alternation that finds the longest word of any keyword; grouped by first letter, so that few branches are tried."""
    groups = defaultdict(set)
    for r in table:
        word = max(r["keyword"].split(), key=len)
        groups[word[0]].add(word[1:])
    return f" (?:{'|'.join(f'{a}(?:{'|'.join(sorted(rest))})' for a, rest in sorted(groups.items()))}) "


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base and detections: ARRAY<STRUCT<first, last, label, priority, id>> each, detections after suppression."""
    table = rules()
    base = [{"id": i, "label": label, "priority": 0, "keyword": chain(phrase), "pattern": chain(phrase)} for i, (phrase, label) in enumerate(BASE)]
    gate = prefilter(table + base)
    none = F.array().cast(FOUND)
    return (only(docs, "doc_id", "text").select("doc_id", word_chain(text_of()).alias("w"))
            .select("doc_id", "w", F.col("w").rlike(gate).alias("gate"))
            .select("doc_id", (_spaces(F.col("w")) / 2).cast("bigint").alias("n_words"),
                    F.when(F.col("gate"), let(F.col("w"), lambda w: _detect(w, base))).otherwise(none).alias("base"),
                    F.when(F.col("gate"), unsuppressed(let(F.col("w"), lambda w: _detect(w, table)))).otherwise(none).alias("detections")))


def report(found: DataFrame) -> DataFrame:
    """One digest row per document: counts and places of base phrases, labels, and the confidence of the best detection."""
    labels = lambda c: F.transform(F.col(c), lambda x: x["label"])
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform(F.col("base"), lambda x: x["first"])
    best = F.coalesce(F.array_max(F.transform(F.col("detections"), lambda x: x["priority"])), F.when(F.size("base") > 0, F.lit(TITLE)), F.lit(0))
    return found.select("doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), text(labels("base")).alias("base_labels"),
                        text(F.concat(labels("base"), labels("detections"))).alias("labels"), F.least(F.lit(1.0), best / 50.0).alias("score"))
