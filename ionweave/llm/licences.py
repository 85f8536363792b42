"""Licence scans by ordered signature rules, in DataFrame operations only.

A text becomes its words (ASCII letters lowered, everything that is no letter or digit or beyond ASCII separates).
Rules are hand-written names of licences put into hand-written forms of speech: a notice, a grant, an identifier, an
address, a bare name. Names that carry the licence word, a version or an acronym stand for themselves. A rule
runs only on texts that hold the gate of its keyword and of its form, and texts without the gate of any rule run none. Every detection is an
interval of words; it is suppressed if a detection of higher priority (or of the same rule's priority, but longer)
contains it. What is left gives the labels, its strongest rule the score.

Base phrases are found besides, wherever their words stand in a row, and their labels always stay.
Null and empty texts have no words, no labels and score 0. Every row is scanned by itself, in whole.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.base import columns_only, query, table

# Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

LICENCE = "licen[sc]es?"
VERSION = "(?: version)?(?: v)?"

#: Label, keyword, name. Patterns are over words set apart by single spaces.
FAMILIES = [
    ("apache-2.0", "apache", f"apache(?: software)?(?: {LICENCE})?{VERSION} 2(?: 0)?"),
    ("apache-1.1", "apache", f"apache(?: software)?(?: {LICENCE})?{VERSION} 1(?: 1)?"),
    ("apache", "apache", "apache(?: software)?(?: foundation)?"),
    ("mit", "mit", "mit"),
    ("mit-0", "mit", "mit(?: no attribution| 0)"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("0bsd", "bsd", "(?:0bsd|zero clause bsd)"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("gpl-2.0", "2", f"(?:gnu )?(?:gpl|general public {LICENCE})(?: gpl)?{VERSION} ?(?:v?2)(?: 0)?(?: only| or later| or any later version)?"),
    ("gpl-3.0", "3", f"(?:gnu )?(?:gpl|general public {LICENCE})(?: gpl)?{VERSION} ?(?:v?3)(?: 0)?(?: only| or later| or any later version)?"),
    ("gpl", "g", f"(?:gnu )?(?:gpl|general public {LICENCE})"),
    ("lgpl-2.1", "2 1", f"(?:gnu )?(?:lgpl|(?:lesser|library) general public {LICENCE})(?: lgpl)?{VERSION} 2 1"),
    ("lgpl-3.0", "3", f"(?:gnu )?(?:lgpl|lesser general public {LICENCE})(?: lgpl)?{VERSION} ?(?:v?3)(?: 0)?"),
    ("lgpl", "l", f"(?:gnu )?(?:lgpl|(?:lesser|library) general public {LICENCE})"),
    ("agpl-3.0", "a", f"(?:gnu )?(?:agpl|affero general public {LICENCE})(?: agpl)?(?:{VERSION} ?(?:v?3)(?: 0)?)?"),
    ("gfdl", "documentation", f"(?:gnu )?free documentation {LICENCE}"),
    ("mpl-1.1", "mozilla", f"mozilla public {LICENCE}{VERSION} 1 [01]"),
    ("mpl-2.0", "mozilla", f"mozilla public {LICENCE}(?:{VERSION} 2 0)?"),
    ("epl-1.0", "eclipse", f"eclipse public {LICENCE}{VERSION} 1(?: 0)?"),
    ("epl-2.0", "eclipse", f"eclipse public {LICENCE}(?:{VERSION} 2(?: 0)?)?"),
    ("cddl", "common", f"common development and distribution {LICENCE}(?:{VERSION} 1 [01])?"),
    ("cpl", "common public", f"common public {LICENCE}(?:{VERSION} 1 0)?"),
    ("eupl", "european union", f"european union public {LICENCE}(?:{VERSION} 1 [12])?"),
    ("artistic-2.0", "artistic", f"artistic(?: {LICENCE})?(?:{VERSION} 2(?: 0)?)?"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost", "boost", f"boost software {LICENCE}(?:{VERSION} 1 0)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ms-pl", "microsoft", f"microsoft public {LICENCE}"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2.0", "python", f"python software foundation(?: {LICENCE})?(?:{VERSION} 2)?"),
    ("openssl", "openssl", "openssl"),
    ("mpl-1.1", "mpl", f"mpl{VERSION} ?v?1 [01]"),
    ("mpl-2.0", "mpl", f"mpl{VERSION} ?v?2 0"),
    ("epl-1.0", "epl", f"epl{VERSION} ?v?1 0"),
    ("epl-2.0", "epl", f"epl{VERSION} ?v?2 0"),
    ("cddl", "cddl", f"cddl(?:{VERSION} ?v?1 [01])?"),
    ("cpl", "cpl", f"cpl{VERSION} ?v?1 0"),
    ("eupl", "eupl", f"eupl(?:{VERSION} ?v?1 [012])?"),
    ("boost", "bsl", f"bsl{VERSION} ?v?1 0"),
    ("ofl-1.1", "ofl", f"(?:sil )?ofl{VERSION} ?v?1 [01]"),
    ("odbl", "odbl", f"odbl(?:{VERSION} ?v?1 0)?"),
    ("gfdl", "gfdl", f"gfdl(?:{VERSION} ?v?1 [123])?"),
    ("ms-pl", "ms pl", "ms pl"),
    ("python-2.0", "2 0", "(?:python|psf) 2 0"),
    ("ofl-1.1", "open font", f"(?:sil )?open font {LICENCE}(?:{VERSION} 1 1)?"),
    ("odbl", "open database", f"open database {LICENCE}(?:{VERSION} 1 0)?"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc", "cc by", "cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1234] [05])?"),
    ("cc-by-sa", "cc by", "cc by sa(?: [1234] [05])?"),
    ("cc-by", "cc by", "cc by(?: [1234] [05])?"),
    ("cc-by-nc-sa", "creative commons", f"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)?(?: {LICENCE})?"),
    ("cc-by-nc", "creative commons", f"creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)?(?: {LICENCE})?"),
    ("cc-by-sa", "creative commons", f"creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)?(?: {LICENCE})?"),
    ("cc-by", "creative commons", f"creative commons attribution(?: [1234] [05])?(?: international| unported)?(?: {LICENCE})?"),
]

#: Form, pattern around a name, priority, weight.
FORMS = [
    ("identifier", f"spdx {LICENCE} identifier {{}}", 90, 1.0),
    ("grant", f"(?:licensed|released|distributed|available|published|provided|covered|redistributed)(?: to you)? under(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {{}}(?: {LICENCE})?", 80, 0.95),
    ("grant of a work", f"(?:subject to|governed by|according to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {{}}(?: {LICENCE})?", 70, 0.9),
    ("notice", f"(?:see|read)(?: the)?(?: file)?(?: named)? {{}}(?: {LICENCE})?(?: file)? for(?: more)?(?: the)? (?:details|terms|conditions)", 60, 0.7),
    ("name", f"{{}} {LICENCE}", 40, 0.8),
]

#: Labels whose names carry the licence word, a version or an acronym of the licence: they need no such word after them.
BARE = {"gpl-2.0", "gpl-3.0", "gpl", "lgpl-2.1", "lgpl-3.0", "lgpl", "agpl-3.0", "gfdl", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "cddl", "cpl", "eupl", "boost", "ofl-1.1", "odbl",
        "0bsd", "unlicense", "wtfpl", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "cc0", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"}
#: A bare name is not the end of the name of a relative.
NOT_AFTER = "(?<!lesser )(?<!library )(?<!affero )"

#: Label, keyword, pattern, priority, weight.
PHRASES = [
    ("apache-2.0", "apache", f"apache(?: software)? {LICENCE}{VERSION} 2(?: 0)?", 40, 0.8),
    ("apache-2.0", "apache", "apache(?: version)?(?: v)? 2 0(?! [0-9])", 40, 0.8),
    ("ms-pl", "microsoft", f"microsoft public {LICENCE}", 40, 0.8),
    ("apache-2.0", "apache", "(?:www )?apache org licenses license 2 0(?: txt| html)?", 85, 1.0),
    ("mit", "opensource", "(?:www )?opensource org licenses mit(?: license)?(?: php| html)?", 85, 1.0),
    ("gpl", "gnu", "(?:www )?gnu org licenses(?: old licenses)?(?: gpl)?(?: [23] 0)?(?: txt| html)?", 85, 0.9),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1234] [05]", 85, 1.0),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1234] [05]", 85, 1.0),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1234] [05]", 85, 1.0),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0", 85, 1.0),
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", 75, 1.0),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 75, 0.9),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification", 75, 0.9),
    ("warranty", "warrant", "without(?: any)? warrant(?:y|ies)(?: of any kind)?", 20, 0.3),
    ("warranty", "as is", "provided as is", 20, 0.3),
    ("public-domain", "public domain", "(?:dedicated to|released (?:in)?to|placed in(?:to)?|in)(?: the)? public domain", 50, 0.8),
    ("public-domain", "public domain", "public domain", 10, 0.5),
    ("copyright", "copyright", "copyright(?: c)?(?: by)?(?: 19[0-9][0-9]| 20[0-9][0-9])+", 30, 0.4),
    ("copyright", "copyrighted", "copyrighted(?: material| works?)?", 10, 0.3),
    ("proprietary", "proprietary", f"proprietary(?: and confidential| {LICENCE})", 50, 0.8),
    ("reserved", "rights reserved", "(?:all|some|no) rights reserved", 35, 0.5),
    ("no-derivatives", "not be ", "(?:may|must) not be (?:reproduced|copied|redistributed)(?: in any form)?", 35, 0.5),
    ("unlicense", "free and unencumbered", "free and unencumbered software released into the public domain", 85, 1.0),
]

#: With what, at the start of a word, a text must go on somewhere for rules of these keywords; other keywords are that themselves.
GATES = {"2": "gpl|general public", "3": "[al]?gpl|general public", "g": "gpl|general public", "l": "lgpl|general public", "a": "agpl|general public", "2 1": "lgpl|general public",
         "bsd": "(?:free|0)?bsd", "mit": "mit ", "isc": "isc ", "x11": "x11 ", "ms pl": "ms pl ", "2 0": "(?:python|psf) 2 0", "documentation": "free documentation",
         "common": "common development", "python": "python software", "gnu": "gnu org", "opensource": "opensource org", "as is": "provided as is",
         "proprietary": "proprietary (?:and|licen[sc])", "not be ": "not be (?:repro|copied|redis)"}

#: What a form needs besides the gate of the name.
FORM_GATES = {"identifier": "spdx", "grant": "under", "grant of a work": "(?:subject to|governed by|according to)", "notice": "(?:see|read)"}


def gate(keyword: str) -> str:
    return GATES.get(keyword, keyword)


def _with_forms() -> list[tuple[str, str, str, int, float, str]]:
    """The rules and their forms; a phrase has the form ''."""
    out = [(label, keyword, f"{NOT_AFTER}{name}(?: {LICENCE})?" if form == "name" and label in BARE else words.format(name), priority, weight, form)
           for label, keyword, name in FAMILIES for form, words, priority, weight in FORMS]
    return sorted(out + [(*r, "") for r in PHRASES], key=lambda r: -r[3])


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, weight) of every rule, in order of priority."""
    return [r[:5] for r in _with_forms()]


#: Texts without any of these run no rule and hold no base phrase: the gates of all rules, and the base phrases.
ROOTS = tuple(dict.fromkeys([*(gate(r[1]) for r in rules()), *BASE]))


def pattern(words: str) -> str:
    """The pattern of whole words in a text that has a space before and after each word."""
    return f" {words}(?= )"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rules_sql() -> str:
    return "array(" + ",".join(f"named_struct('label',{_quoted(a)},'pattern',{_quoted(pattern(p))},'priority',{n},'weight',{w}D)" for a, _, p, n, w in rules()) + ")"


def _starts(words: str) -> str:
    return f"_low rlike {_quoted(f' (?:{words})')}"


def _roots() -> str:
    """The roots as one pattern, by first character."""
    heads: dict[str, list[str]] = {}
    for g in ROOTS:
        for words in (g.split("|") if "(" not in g else [g]):
            heads.setdefault(words[0] if words[0].isalnum() else "", []).append(words)
    return "|".join(f"{h}(?:{'|'.join(w[len(h):] for w in dict.fromkeys(words))})" for h, words in heads.items())


def _hits_sql() -> str:
    """Numbers of the rules that a text _low holds. Patterns stand as literals, each behind the gates of its name and form."""
    groups: dict[tuple[str, str], list[str]] = {}
    for i, (_, keyword, words, _, _, form) in enumerate(_with_forms()):
        groups.setdefault((gate(keyword), FORM_GATES.get(form, "")), []).append(f"if(_low rlike {_quoted(pattern(words))}, {i}, null)")
    names: dict[str, list[str]] = {}
    for (g, f), tests in groups.items():
        some = f"array({','.join(tests)})"
        names.setdefault(g, []).append(f"if({_starts(f)}, {some}, _none)" if f else some)
    return "array_compact(concat(" + ",".join(f"if({_starts(g)}, concat({','.join(some)}), _none)" for g, some in names.items()) + "))"


_SPACES = "length({0}) - length(replace({0}, ' ', ''))"

#: Detections in a text _low by the rules _hits: first word, word after the last, label, priority, weight. The words before a
#: match are those in the pieces and matches before it.
_FOUND = f"""
flatten(transform(transform(_hits, i -> {{rules}}[i]), r ->
    aggregate(zip_with(split(_low, r.pattern), regexp_extract_all(_low, r.pattern, 0), (s, m) -> struct({_SPACES.format('s')} as s, {_SPACES.format('m')} as m)),
      named_struct('at', 0, 'found', cast(array() as array<struct<a: int, z: int, label: string, priority: int, weight: double>>)),
      (t, x) -> named_struct('at', t.at + x.s + coalesce(x.m, 0),
        'found', if(x.m is null, t.found, concat(t.found, array(named_struct('a', t.at + x.s, 'z', t.at + x.s + x.m, 'label', r.label, 'priority', r.priority, 'weight', r.weight))))),
      t -> t.found)))
"""

_LEFT = """
filter(_found, d -> not exists(_found, e -> e.a <= d.a and e.z >= d.z and (e.priority > d.priority or (e.priority = d.priority and e.z - e.a > d.z - d.a))))
"""


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and n_words, n_base, first_word, last_word, base_labels, labels, score."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    out = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], words.alias("_words"))
    out = out.withColumn("n_words", F.when(F.col("_words") == "", F.lit(0)).otherwise(F.expr(_SPACES.format("_words") + " + 1")).cast("long"))
    out = out.withColumn("_low", F.concat(F.lit(" "), F.translate("_words", upper, lower), F.lit(" "))).withColumn("_low", F.when(F.expr(_starts(_roots())), F.col("_low"))).drop("_words")
    for i, phrase in enumerate(BASE):
        out = out.withColumn(f"_b{i}", F.split("_low", pattern(phrase)))      # one piece more than there are places
    firsts, lasts = [], []
    for i, phrase in enumerate(BASE):
        some = F.size(f"_b{i}") > 1
        firsts.append(F.when(some, F.expr(_SPACES.format(f"_b{i}[0]"))))
        lasts.append(F.when(some, F.col("n_words") - (F.expr(_SPACES.format(f"element_at(_b{i}, -1)")) - 1) - len(phrase.split())))
    count = sum((F.coalesce(F.size(f"_b{i}") - 1, F.lit(0)) for i in range(1, len(BASE))), F.coalesce(F.size("_b0") - 1, F.lit(0)))
    base = F.array_compact(F.array(*[F.when(F.size(f"_b{i}") > 1, F.lit(label)) for i, label in enumerate(BASE.values())]))
    out = (out.withColumn("n_base", F.when(F.col("_low").isNull(), F.lit(0)).otherwise(count).cast("long"))
           .withColumn("first_word", F.least(*firsts).cast("long")).withColumn("last_word", F.greatest(*lasts).cast("long"))
           .withColumn("_base", base).drop(*[f"_b{i}" for i in range(len(BASE))])
           .withColumn("_none", F.array().cast("array<int>")).withColumn("_hits", F.when(F.col("_low").isNotNull(), F.expr(_hits_sql())))
           .withColumn("_found", F.when(F.size("_hits") > 0, F.expr(_FOUND.format(rules=_rules_sql())))).withColumn("_left", F.expr(_LEFT)))
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce(F.expr("transform(_left, d -> d.label)"), F.array().cast("array<string>")))))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_base", "first_word", "last_word",
                      F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                      F.coalesce(F.expr("array_max(transform(_left, d -> d.weight))"), F.lit(0.0)).alias("score"))


@query("op6_licences")
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(columns_only(table(spark, sf_dir, "documents"), "doc_id", "text"), ["doc_id"])
