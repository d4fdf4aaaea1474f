"""License scans by ordered signature rules, with DataFrame functions only.

A document that holds none of the keywords is never read by a rule. The others are normalised to words with
single spaces, and each rule is matched whose keyword is there and one of whose literals is, of which every match
holds one; where detections overlap, one that lies inside
another of no lower priority is suppressed.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased. The labels of the three base
phrases always stay.

Edge cases: null and empty texts have no words and no labels; equal texts are scanned on their own and share
their detections; repeated rows each get a result; an empty table gives an empty result; of the input only
``keep`` and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import Workspace

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    """``regex`` matches whole words of the normalised text; every match holds ``keyword``."""

    label: str
    keyword: str
    regex: str
    priority: int
    weight: float


#: label: (name as a regular expression over words, SPDX words). Names end in what sets versions apart.
NAMED = {
    "apache-2.0": ("apache (?:software )?license(?: version)?(?: v)? ?2(?: 0)?", "apache 2 0"),
    "apache-1.1": ("apache (?:software )?license(?: version)? 1 1", "apache 1 1"),
    "mit": ("mit license", "mit"),
    "mit-0": ("mit no attribution license", "mit 0"),
    "bsd-2-clause": ("(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) license", "bsd 2 clause"),
    "bsd-3-clause": ("(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd) license", "bsd 3 clause"),
    "bsd-4-clause": ("(?:original bsd|bsd 4 clause|4 clause bsd) license", "bsd 4 clause"),
    "bsd": ("bsd license", "bsd"),
    "isc": ("isc license", "isc"),
    "gfdl": ("gnu free documentation license", "gfdl 1 3"),
    "mpl-1.1": ("mozilla public license(?: version)?(?: v)? ?1 1", "mpl 1 1"),
    "mpl-2.0": ("mozilla public license(?: version)?(?: v)? ?2(?: 0)?", "mpl 2 0"),
    "mpl": ("mozilla public license", "mpl"),
    "epl-1.0": ("eclipse public license(?: version)?(?: v)? ?1(?: 0)?", "epl 1 0"),
    "epl-2.0": ("eclipse public license(?: version)?(?: v)? ?2(?: 0)?", "epl 2 0"),
    "cddl": ("common development and distribution license", "cddl 1 0"),
    "cpl": ("common public license", "cpl 1 0"),
    "eupl": ("european union public licen[cs]e", "eupl 1 2"),
    "artistic": ("artistic license", "artistic 2 0"),
    "bsl-1.0": ("boost software license", "bsl 1 0"),
    "zlib": ("zlib license", "zlib"),
    "libpng": ("libpng license", "libpng"),
    "python": ("python software foundation license", "psf 2 0"),
    "php": ("php license", "php 3 01"),
    "ruby": ("ruby license", "ruby"),
    "wtfpl": ("do what the fuck you want to public license", "wtfpl"),
    "unlicense": ("(?:the )?unlicense(?: license)?", "unlicense"),
    "openssl": ("openssl license", "openssl"),
    "postgresql": ("postgresql license", "postgresql"),
    "sleepycat": ("sleepycat license", "sleepycat"),
    "ms-pl": ("microsoft public license", "ms pl"),
    "ms-rl": ("microsoft reciprocal license", "ms rl"),
    "osl": ("open software license", "osl 3 0"),
    "afl": ("academic free license", "afl 3 0"),
    "upl": ("universal permissive license", "upl 1 0"),
    "ncsa": ("university of illinois ncsa open source license", "ncsa"),
    "ofl": ("(?:sil )?open font license", "ofl 1 1"),
    "odbl": ("open (?:data commons open )?database license", "odbl 1 0"),
    "busl": ("business source license", "busl 1 1"),
    "sspl": ("server side public license", "sspl 1 0"),
    "elastic": ("elastic license", "elastic 2 0"),
    "openrail": ("(?:creativeml )?open ?rail(?: m)? license", "openrail"),
}
#: label: (short form, long form, SPDX words); the longer names come first. Short forms hold the label's first word.
TWO_NAMES = {
    "gpl-1.0": ("(?:gnu )?gpl(?: version)?(?: v)? ?1(?: 0)?", "(?:gnu )?general public license(?: version)?(?: v)? ?1(?: 0)?", "gpl 1 0"),
    "gpl-2.0": ("(?:gnu )?gpl(?: version)?(?: v)? ?2(?: 0)?", "(?:gnu )?general public license(?: version)?(?: v)? ?2(?: 0)?", "gpl 2 0"),
    "gpl-3.0": ("(?:gnu )?gpl(?: version)?(?: v)? ?3(?: 0)?", "(?:gnu )?general public license(?: version)?(?: v)? ?3(?: 0)?", "gpl 3 0"),
    "gpl": ("gnu gpl", "gnu general public license", "gpl"),
    "lgpl-2.1": ("(?:gnu )?lgpl(?: version)?(?: v)? ?2 1", "(?:gnu )?lesser general public license(?: version)?(?: v)? ?2 1", "lgpl 2 1"),
    "lgpl-3.0": ("(?:gnu )?lgpl(?: version)?(?: v)? ?3(?: 0)?", "(?:gnu )?lesser general public license(?: version)?(?: v)? ?3(?: 0)?", "lgpl 3 0"),
    "lgpl": ("gnu lgpl", "(?:gnu )?(?:lesser|library) general public license", "lgpl"),
    "agpl-3.0": ("(?:gnu )?agpl(?: version)?(?: v)? ?3(?: 0)?", "(?:gnu )?affero general public license(?: version)?(?: v)? ?3(?: 0)?", "agpl 3 0"),
    "agpl": ("gnu agpl", "(?:gnu )?affero general public license", "agpl"),
    "cc0": ("cc0(?: 1 0)?(?: universal)?(?: license)?", "creative commons zero(?: 1 0)?(?: universal)?(?: license)?", "cc0 1 0"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s", "cc by nc nd 4 0"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution non ?commercial share ?alike", "cc by nc sa 4 0"),
    "cc-by-nc": ("cc by nc", "creative commons attribution non ?commercial", "cc by nc 4 0"),
    "cc-by-nd": ("cc by nd", "creative commons attribution no ?deriv(?:ative)?s", "cc by nd 4 0"),
    "cc-by-sa": ("cc by sa", "creative commons attribution share ?alike", "cc by sa 4 0"),
    "cc-by": ("cc by", "creative commons attribution", "cc by 4 0"),
}
#: Signatures of license texts and notices: (label, keyword, regex, priority, weight).
TEXTS = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 4, 0.9),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 4, 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 4, 0.9),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 4, 0.9),
    ("zlib", "warrant", "provided as is without any express or implied warranty", 3, 0.6),
    ("unlicense", "domain", "free and unencumbered software released into the public domain", 4, 0.9),
    ("public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 3, 0.7),
    ("public-domain", "domain", "public domain", 1, 0.3),
    ("copyright", "copyright", "copyright(?: c)?(?: [12][0-9]{3}){1,4}", 2, 0.4),
    ("copyright", "copyright", "copyright (?:by|holders?|notice)", 1, 0.3),
    ("reserved", "reserved", "(?:all|some) rights(?: are)? reserved", 2, 0.5),
    ("reserved", "reproduc", "(?:no part of this|may not be) [a-z]{1,20} ?(?:may be )?reproduced", 2, 0.5),
    ("proprietary", "proprietary", "proprietary and confidential", 3, 0.7),
    ("proprietary", "proprietary", "proprietary license", 2, 0.6),
    ("proprietary", "commercial", "commercial license", 2, 0.5),
    ("terms", "terms", "terms of (?:use|service)", 1, 0.2),
    ("terms", "licen", "end user licen[cs]e agreement", 2, 0.4),
)


_COMMON = {"license", "licence", "version", "under", "public", "the", "general", "software", "licensed", "released", "distributed", "published", "available", "made"}


def literals(rule: Rule) -> list[str]:
    """Texts of which every match of a rule holds at least one, the most telling there are.

    Read off the pattern: what is optional goes, and then either a literal stretch stays or the branches of a group.
    """
    plain = rule.regex
    while (cut := re.sub(r"\((?:\?:)[^()]*\)(?:\?|\{[^}]*\})", "#", plain)) != plain:
        plain = cut
    plain = re.sub(r"(?:\[[^\]]*\]|[a-z0-9 ])(?:\?|\{[^}]*\})|\[[^\]]*\]", "#", plain)
    choices = [g.split("|") for g in re.findall(r"\(\?:([^()]*)\)", plain)]
    choices = [c for c in choices if not any("#" in x for x in c)]
    stretches = [x.strip() for x in re.split(r"#|\(\?:[^()]*\)|[()]", plain)]
    telling = [x for x in stretches if len(x) > 2 and (set(x.split()) - _COMMON or x.count(" ") > 1)]
    if telling:
        return [max(telling, key=len)]
    rare = [c for c in choices if all(set(x.split()) - _COMMON or x.count(" ") > 1 for x in c)]
    return max(rare, key=lambda c: min(map(len, c))) if rare else [rule.keyword]


def build_rules() -> tuple[Rule, ...]:
    """Four signatures for each name of a license, then the notices; the order breaks ties."""
    names = [(label, "licen", name, spdx) for label, (name, spdx) in NAMED.items()]
    for label, (short, long, spdx) in TWO_NAMES.items():
        first, second = ("cc", "commons") if label.startswith("cc") else ("gpl", "licen")
        names += [(label, first, short, spdx), (label, second, long, spdx)]
    rules = []
    for label, word, name, spdx in names:
        rules += [
            Rule(label, "spdx", f"spdx license identifier {spdx}(?: only| or later)?", 5, 0.99),
            Rule(label, word, f"(?:licensed|released|distributed|published|available|made available) under (?:the |an |a )?(?:terms of (?:the )?)?{name}", 4, 0.9),
            Rule(label, word, f"(?:license|licence) (?:is |name )?(?:the )?{name}", 3, 0.7),
            Rule(label, word, name, 2, 0.5),
        ]
    return tuple(rules + [Rule(*t) for t in TEXTS])


RULES = build_rules()


def normal(text: Column) -> Column:
    """Words between single spaces, with one at either end; a single space if there are none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    words = F.trim(F.regexp_replace(lowered, SEPARATOR, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _bounded(regex: str) -> str:
    return f"(?<= )(?:{regex})(?= )"


def _keyword_gate(text: Column, rules: Sequence[Rule]) -> Column:
    """The keywords that a text holds."""
    words = sorted({r.keyword for r in rules})
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def detections(texts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``texts`` (key, norm) to the kept detections: key, label, start and stop in norm, priority, weight.

    Texts with one key are equal, so their matches are counted once. Positions are running sums of the lengths
    between and of the matches, over rows as small as the matches are few.
    """
    table = F.array(*[
        F.struct(F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(_bounded(r.regex)).alias("regex"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"), F.array(*[F.lit(x) for x in literals(r)]).alias("literals"))
        for i, r in enumerate(rules)
    ])
    gated = texts.withColumn("_keywords", _keyword_gate(F.col("norm"), rules))
    tried = gated.select("key", "norm", F.explode(F.filter(table, lambda r: F.array_contains("_keywords", r["keyword"]) & F.exists(r["literals"], lambda x: F.contains("norm", x)))).alias("r"))
    found = tried.withColumn("_matches", F.regexp_extract_all("norm", F.col("r.regex"), F.lit(0))).filter(F.size("_matches") > 0)
    found = found.withColumn("_between", F.split("norm", F.col("r.regex"), -1))
    steps = F.transform("_matches", lambda m, i: F.struct(F.length(F.get("_between", i)).alias("gap"), F.length(m).alias("len")))
    rows = found.select("key", F.struct("r.rule", "r.label", "r.priority", "r.weight").alias("r"), F.posexplode(steps).alias("i", "step"))
    rows = rows.dropDuplicates(["key", "r", "i"])
    upto = Window.partitionBy("key", "r.rule").orderBy("i")
    rows = rows.withColumn("stop", F.sum(F.col("step.gap") + F.col("step.len")).over(upto)).withColumn("start", F.col("stop") - F.col("step.len"))
    # in order of start, the longer and stronger first, a detection lies inside an earlier one of at least its
    # priority if the furthest end of those reaches its own
    order = Window.partitionBy("key").orderBy("start", F.desc("stop"), F.desc("r.priority"), "r.rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in rules})
    for level in levels:
        rows = rows.withColumn(f"_reach{level}", F.max(F.when(F.col("r.priority") == level, F.col("stop"))).over(order))
    inside = F.lit(False)
    for level in levels:
        inside = inside | (F.coalesce(F.col(f"_reach{level}") >= F.col("stop"), F.lit(False)) & (F.col("r.priority") <= level))
    return rows.filter(~inside).select("key", "r.label", "start", "stop", "r.priority", "r.weight")


def scan(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``keep`` plus n_words, n_base, first_word, last_word, base_labels, labels and score for each row."""
    spark = df.sparkSession
    work = Workspace(spark, "license")
    words = sorted({r.keyword for r in rules} - {"cc"})
    # The texts are read once: what stays of them is a count and, where a keyword is, the normalised words.
    read = df.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_raw"))
    read = read.withColumn("_low", F.lower("_raw"))
    cc = F.contains(F.col("_low"), F.lit("cc")) & F.col("_low").rlike(r"cc0|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by")
    hit = reduce(or_, [*[F.contains(F.col("_low"), F.lit(w)) for w in words], cc])
    read = read.select("_row", "_raw", hit.alias("_hit"))
    read = read.select("_row", F.size(F.array_remove(F.split("_raw", SEPARATOR), "")).cast("long").alias("n_words"), F.when(F.col("_hit"), normal(F.col("_raw"))).alias("norm"))
    docs = work.save(read, "words").select("_row.*", "n_words", "norm")
    base = _bounded("|".join(BASE))
    docs = docs.withColumn("n_base", F.coalesce(F.regexp_count("norm", F.lit(base)), F.lit(0)).cast("long"))
    some = F.col("n_base") > 0
    first = F.substring(F.col("norm"), F.lit(1), F.regexp_instr("norm", F.lit(base)) - 1)
    last = F.regexp_extract("norm", r"(?s)^(.* )(?:" + "|".join(BASE) + r")(?= )", 1)
    labels = F.array_compact(F.array(*[F.when(F.contains(F.col("norm"), F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]))
    docs = (
        docs.withColumn("first_word", F.when(some, _count(first, " ") - 1).cast("long"))
        .withColumn("last_word", F.when(some, _count(last, " ") - 1).cast("long"))
        .withColumn("_base", F.when(some, F.array_sort(labels)).otherwise(F.expr("cast(array() as array<string>)")))
        # texts that no rule reads have no detections to meet, so their keys need only be spread
        .withColumn("key", F.coalesce(F.md5("norm"), F.concat(F.lit("none-"), F.xxhash64(*keep).cast("string"))))
    )
    found = detections(docs.filter("norm is not null").select("key", "norm"), rules)
    by_key = found.groupBy(F.col("key").alias("_key")).agg(F.collect_set("label").alias("_labels"), F.max("weight").alias("_weight"))
    out = docs.drop("norm").join(by_key, F.col("key") == F.col("_key"), "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.expr("cast(array() as array<string>)"))))
    return out.select(
        *keep, "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("_weight", F.lit(0.0)), F.when(some, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
    )
