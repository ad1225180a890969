"""License scans (operator 6): ordered signature rules behind a keyword prefilter, overlaps resolved by priority.

A text becomes its lower-case words joined by single spaces. Keywords found in that string, and then a literal
of each rule's own, select the rules worth trying; a rule's places are word intervals. An interval that lies inside one of at least its priority is suppressed.
All of it happens inside the document's row with SQL functions: no shuffle, so no source or copy group can be hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, table

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases of the base rules and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License families: label, names in words (regexes), versions, SPDX stem in words.
FAMILIES = [
    ("apache", ["apache(?: software)?"], ["1 0", "1 1", "2 0"], "apache"),
    ("gpl", ["gnu general public license", "gnu gpl"], ["1 0", "2 0", "3 0"], "gpl"),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "gnu lesser public license", "gnu lgpl"], ["2 0", "2 1", "3 0"], "lgpl"),
    ("agpl", ["gnu affero general public license", "gnu agpl"], ["1 0", "3 0"], "agpl"),
    ("mpl", ["mozilla public"], ["1 0", "1 1", "2 0"], "mpl"),
    ("epl", ["eclipse public"], ["1 0", "2 0"], "epl"),
    ("cddl", ["common development and distribution"], ["1 0", "1 1"], "cddl"),
    ("eupl", ["european union public"], ["1 0", "1 1", "1 2"], "eupl"),
    ("osl", ["open software"], ["1 0", "2 0", "2 1", "3 0"], "osl"),
    ("afl", ["academic free"], ["1 1", "1 2", "2 0", "2 1", "3 0"], "afl"),
    ("artistic", ["artistic"], ["1 0", "2 0"], "artistic"),
    ("bsl", ["boost software"], ["1 0"], "bsl"),
    ("lppl", ["latex project public"], ["1 0", "1 1", "1 2", "1 3"], "lppl"),
    ("gfdl", ["gnu free documentation"], ["1 1", "1 2", "1 3"], "gfdl"),
    ("cpl", ["common public"], ["1 0"], "cpl"),
    ("ms-pl", ["microsoft public"], ["1 0"], "ms pl"),
    ("php", ["php"], ["3 0", "3 1"], "php"),
    ("zpl", ["zope public"], ["1 1", "2 0", "2 1"], "zpl"),
    ("ofl", ["sil open font"], ["1 0", "1 1"], "ofl"),
    ("odbl", ["open database"], ["1 0"], "odbl"),
    ("busl", ["business source"], ["1 0", "1 1"], "busl"),
]
#: Licenses that have no versions: label, phrases (regexes).
PLAIN = {
    "mit": [r"mit license", r"mit licen[cs]ed?", r"license mit", r"permission is hereby granted free of charge to any person obtaining a copy"],
    "bsd": [r"bsd license", r"bsd style license", r"(?:new|revised|simplified|modified) bsd license", r"redistribution and use in source and binary forms"],
    "isc": [r"isc license", r"permission to use copy modify and or distribute this software"],
    "zlib": [r"zlib license", r"zlib libpng license"],
    "unlicense": [r"the unlicense", r"this is free and unencumbered software"],
    "wtfpl": [r"do what the fuck you want to public license", r"license wtfpl"],
    "cc0": [r"cc0 1 0(?: universal)?", r"creative commons zero"],
    "public-domain": [r"(?:in|into|to) the public domain", r"public domain dedication", r"dedicated to the public domain"],
    "proprietary": [r"proprietary and confidential", r"unauthorized copying of this file", r"not for (?:re)?distribution"],
    "reserved": [r"all rights reserved", r"no rights? reserved", r"some rights reserved"],
    "copyright": [r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", r"copyright (?:c )?by [^ ]+"],
    "warranty": [r"without warranty of any kind", r"as is without warranty", r"without any warranty"],
    "gpl": [r"general public license", r"gnu gpl", r"gpl v?[123](?: 0)?", r"either version [23] of the license or at your option any later version"],
    "python": [r"python software foundation license", r"psf license"],
    "ntp": [r"ntp license"], "x11": [r"x11 license"], "postgresql": [r"postgresql license"],
    "openssl": [r"openssl license"], "curl": [r"license curl"], "ruby": [r"ruby license"], "vim": [r"vim license"],
}
CC_PARTS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
CC_NAMES = {
    "by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial",
    "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?", "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}
#: A rule is tried only in texts that hold its keyword, a literal that each of its matches contains, and then its anchor,
#: the longest such literal.
KEYWORDS = [
    "licen", "copyright", " reserved", " cc ", "creative commons", "public domain", " gpl ", " spdx ", " gnu ", "warranty",
    "redistribution", "permission", "unencumbered", "proprietary", "unauthorized", "not for ", " cc0 ", "apache", "public license",
]


def _titles(names: list[str]) -> list[tuple[str, str]]:
    """(keyword, regex) of a family's names; a name that does not say license must be followed by it."""
    return [(" gnu ", f"{n}(?: licen[cs]e)?") if n.startswith("gnu ") and n.split()[1] != "free" else ("licen", f"{n} licen[cs]e") for n in names]


def rules() -> Iterator[tuple[str, str, str, int, float]]:
    """(keyword, regex over space-led words, label, priority 1..3, confidence) in order; later ties lose."""
    for label, names, versions, spdx in FAMILIES:
        for v in versions:
            major = v.split()[0]
            tail = f"{v}(?! [0-9])" if not v.endswith(" 0") else f"{major}(?: 0)?(?! [0-9])"
            slug = label if label in ("ms-pl",) else f"{label}-{v.replace(' ', '.')}"
            for gate, title in _titles(names):
                yield "licen", rf" licen[cs]ed under (?:the |a )?(?:terms of (?:the )?)?{title} v(?:ersion)? ?{tail}", slug, 3, 1.0
                yield gate, rf" {title} v(?:ersion)? ?{tail}", slug, 2, 0.95
            yield " spdx ", rf" spdx license identifier {spdx} {tail}(?: only| or later)?", slug, 3, 1.0
            yield "licen", rf" {spdx} {v} licen[cs]e", slug, 2, 0.9
        for gate, title in _titles(names):
            yield gate, rf" {title}", label, 1, 0.8
            yield gate, rf" (?:released|licensed|distributed) under (?:the )?{title}", label, 2, 0.85
    for part in CC_PARTS:
        slug = "cc-" + part.replace(" ", "-")
        for v in CC_VERSIONS:
            yield " cc ", rf" cc {part} {v}", f"{slug}-{v.replace(' ', '.')}", 3, 1.0
            yield "creative commons", rf" creative commons {CC_NAMES[part]} {v}", f"{slug}-{v.replace(' ', '.')}", 3, 1.0
            yield "licen", rf" creativecommons org licenses {part} {v}", f"{slug}-{v.replace(' ', '.')}", 3, 1.0
        yield " cc ", rf" cc {part}(?! (?:nc|nd|sa))", slug, 1, 0.8
        yield "creative commons", rf" creative commons {CC_NAMES[part]}", slug, 1, 0.8
    for label, phrases in PLAIN.items():
        for phrase in phrases:
            fits = [k for k in KEYWORDS if k.strip() in phrase and "[" not in k]
            gate = max(fits, key=len) if fits else None
            yield gate or "", rf" {phrase}", label, 2 if len(phrase) > 30 else 1, 0.9 if len(phrase) > 30 else 0.7
    for label in PLAIN:
        yield "licen", rf" (?:released|licensed|distributed) under (?:the )?{label.replace('-', ' ')} licen[cs]e", label, 2, 0.9
        yield " spdx ", rf" spdx license identifier {label.replace('-', ' ')}", label, 3, 1.0


def anchor(regex: str) -> str:
    """The longest literal that each match of a rule contains: what is left between groups, classes and optional letters."""
    rest = regex
    while "(" in rest:
        rest = re.sub(r"\([^()]*\)[?*+]?", "\0", rest)
    rest = re.sub(r"\[[^\]]*\][?*+]?(\{\d+\})?|.\?", "\0", rest)
    return max(rest.split("\0"), key=len)


def _rule_array() -> Column:
    rows = [
        F.struct(
            F.lit(k).alias("keyword"), F.lit(anchor(regex)).alias("anchor"), F.lit(f"{regex}(?= )").alias("regex"), F.lit(label).alias("label"),
            F.lit(priority).alias("priority"), F.lit(sure).alias("sure"), F.lit(i).alias("rule"),
        )
        for i, (k, regex, label, priority, sure) in enumerate(rules())
    ]
    return F.array(*rows)


def _places(norm: Column, rule: Column) -> Column:
    """Word intervals [start, end) of a rule's matches. A mark is put before each match; words that end in it precede one."""
    found = F.call_function("regexp_extract_all", norm, rule["regex"], F.lit(0))
    marked = F.call_function("regexp_replace", norm, F.concat(F.lit("("), rule["regex"], F.lit(")")), F.lit("\x01$1"))
    starts = F.filter(
        F.transform(F.split(marked, " "), lambda w, i: F.when(F.endswith(w, F.lit("\x01")), i)), lambda i: i.isNotNull()
    )
    length = lambda m: F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit("")))
    return F.zip_with(
        starts, found,
        lambda s, m: F.struct(
            s.alias("start"), (-(s + length(m))).alias("minus_end"), (-rule["priority"]).alias("minus_priority"),
            rule["rule"].alias("rule"), rule["label"].alias("label"), rule["sure"].alias("sure"),
        ),
    )


def _unsuppressed(found: Column) -> Column:
    """Detections not contained in one of at least their priority; of equal intervals the first rule stays.

    In the order of start, then the longer first, then the higher priority, a container always comes before what it
    contains, so the furthest end so far per priority level decides: one pass.
    """
    nothing = F.struct(*[F.lit(-1).alias(f"far{p}") for p in (1, 2, 3)], F.filter(found, lambda d: F.lit(False)).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        reach = F.when(priority == 1, acc["far1"]).when(priority == 2, acc["far2"]).otherwise(acc["far3"])
        fars = [F.when(priority >= p, F.greatest(acc[f"far{p}"], end)).otherwise(acc[f"far{p}"]).alias(f"far{p}") for p in (1, 2, 3)]
        return F.struct(*fars, F.when(reach >= end, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    return F.aggregate(F.sort_array(found), nothing, step)["kept"]


def normalised(text: Column) -> Column:
    """' w1 w2 ... ' of the lower-case words. ``lower`` also changes letters beyond A-Z; none of the base phrases can
    appear or vanish by that (the one such letter that becomes ASCII alone is the Kelvin sign, and they have no k)."""
    joined = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NON_WORD, " "))
    return F.concat(F.lit(" "), joined, F.lit(" "))


def _base_places(norm: Column) -> Column:
    """(start, label) of every base phrase, by direct comparison of consecutive words."""

    def over(ws: Column) -> Column:
        def at(i: Column) -> Column:
            hit = F.lit(None).cast("string")
            for phrase, label in BASE.items():
                same = F.lit(True)
                for k, w in enumerate(phrase.split()):
                    same = same & F.coalesce(F.get(ws, i + k) == w, F.lit(False))
                hit = F.when(same, F.lit(label)).otherwise(hit)
            return F.struct(i.alias("start"), hit.alias("label"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(ws) - 1), at), lambda x: x["label"].isNotNull())

    any_base = F.lit(False)
    for phrase in BASE:
        any_base = any_base | F.contains(norm, F.lit(f" {phrase} "))
    none = F.array().cast("array<struct<start:int,label:string>>")
    return F.when(any_base, let(F.split(F.btrim(norm), " "), over)).otherwise(none)


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, found) per row of ``docs`` (doc_id, text; other columns are ignored).

    base: array of (start, label). found: unsuppressed detections of the signature rules with their word interval
    [start, end), rule number, label, priority and confidence. A null or empty text has no words and no detections.
    Repeated rows, also of one doc_id, are scanned each for itself; an empty table gives an empty result.
    """
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))

    def scan(n: Column) -> Column:
        hits = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(n, k))

        def detections(h: Column) -> Column:
            tried = F.filter(_rule_array(), lambda r: F.array_contains(h, r["keyword"]) & F.contains(n, r["anchor"]))
            return _unsuppressed(F.flatten(F.transform(tried, lambda r: _places(n, r))))

        n_words = F.when(n == "  ", F.lit(0)).otherwise(F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) - 1)
        return F.struct(
            n_words.cast("bigint").alias("n_words"), _base_places(n).alias("base"),
            F.transform(
                let(hits, lambda h: F.when(F.size(h) > 0, detections(h))),
                lambda d: F.struct(
                    d["start"].alias("start"), (-d["minus_end"]).alias("end"), d["rule"].alias("rule"), d["label"].alias("label"),
                    (-d["minus_priority"]).alias("priority"), d["sure"].alias("sure"),
                ),
            ).alias("found"),
        )

    return norm.select("doc_id", let(F.col("norm"), scan).alias("s")).select("doc_id", "s.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan(table(spark, sf_dir, "documents"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    found_labels = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    sure = F.coalesce(F.array_max(F.transform("found", lambda x: x["sure"])), F.lit(0.0))
    starts = F.transform("base", lambda x: x["start"])
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, found_labels))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.greatest(sure, F.lit(0.5))).otherwise(sure).alias("score"),
    )
