"""License scans with ordered signature rules, as built-in column functions only.

A text that holds none of the gate's parts of words has no signature. In the others every word that begins a rule (its lead)
opens a stretch of words, which only the rules of that lead are tried on. Detections are intervals of words; one that lies
inside another of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licenses by label, as alternatives of lower-case words; the word a pattern starts with is written out.
NAMES = {
    "agpl-3.0": r"gnu affero general public license(?: version)?(?: v?3(?: 0)?)?|affero general public license(?: version)?(?: v?3(?: 0)?)?|agpl(?: v?3(?: 0)?)?|agplv3",
    "apache-1.1": r"apache(?: software)? license(?: version)? 1 1",
    "apache-2.0": r"apache(?: software)? license(?: version)? v?2(?: 0)?|apache 2 0|asl 2 0",
    "apache": r"apache(?: software)? license",
    "artistic-2.0": r"artistic license(?: version)?(?: 2(?: 0)?)?|perl artistic license",
    "beerware": r"beer ware license|beerware license",
    "bsd-2-clause": r"bsd 2 clause(?: simplified)?(?: license)?|simplified bsd license|freebsd license",
    "bsd-3-clause": r"bsd 3 clause(?: new| revised)?(?: license)?|new bsd license|modified bsd license|revised bsd license",
    "bsd-4-clause": r"bsd 4 clause(?: original)?(?: license)?|original bsd license",
    "bsd": r"bsd(?: style)? license|berkeley software distribution license",
    "bsl-1.0": r"boost software license(?: version)?(?: 1 0)?",
    "busl-1.1": r"business source license(?: version)?(?: 1 1)?",
    "cc-by-nc-nd": r"cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?deriv\w*(?: [1-4] [05])?",
    "cc-by-nc-sa": r"cc by nc sa(?: [1-4] [05])?|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?",
    "cc-by-nc": r"cc by nc(?: [1-4] [05])?|creative commons attribution non ?commercial(?: [1-4] [05])?",
    "cc-by-nd": r"cc by nd(?: [1-4] [05])?|creative commons attribution no ?deriv\w*(?: [1-4] [05])?",
    "cc-by-sa": r"cc by sa(?: [1-4] [05])?|creative commons attribution share ?alike(?: [1-4] [05])?",
    "cc-by": r"cc by(?: [1-4] [05])?|creative commons attribution(?: [1-4] [05])?",
    "cc0-1.0": r"cc0(?: 1 0)?|creative commons zero|creative commons cc0",
    "cddl-1.0": r"common development and distribution license(?: version)?(?: 1 [01])?|cddl(?: 1 [01])?",
    "cecill-2.1": r"cecill(?: free software)? license(?: agreement)?|cecill 2 1",
    "cpal-1.0": r"common public attribution license(?: version)?(?: 1 0)?",
    "cpl-1.0": r"common public license(?: version)?(?: 1 0)?",
    "ecl-2.0": r"educational community license(?: version)?(?: 2 0)?",
    "epl-1.0": r"eclipse public license(?: version| v)? 1(?: 0)?|epl 1 0",
    "epl-2.0": r"eclipse public license(?: version| v)? 2(?: 0)?|epl 2 0",
    "epl": r"eclipse public license",
    "eupl-1.2": r"european union public licen[cs]e(?: version)?(?: 1 2)?|eupl(?: 1 2)?",
    "fdl-1.3": r"gnu free documentation license(?: version)?(?: 1 [1-3])?|gfdl(?: 1 [1-3])?",
    "gpl-1.0": r"gnu general public license(?: version| v) ?1(?: 0)?|general public license(?: version| v) ?1(?: 0)?",
    "gpl-2.0": r"gnu general public license(?: version| v)? ?2(?: 0)?|general public license(?: version| v)? ?2(?: 0)?|gpl v?2(?: 0)?|gplv2(?: 0)?|gpl2",
    "gpl-3.0": r"gnu general public license(?: version| v)? ?3(?: 0)?|general public license(?: version| v)? ?3(?: 0)?|gpl v?3(?: 0)?|gplv3(?: 0)?|gpl3",
    "gpl": r"gnu general public license|general public license|gnu gpl|gpl",
    "hpnd": r"historical permission notice and disclaimer",
    "icu": r"icu license|unicode terms of use",
    "ijg": r"independent jpeg group license",
    "intel": r"intel open source license",
    "ipl-1.0": r"ibm public license(?: version)?(?: 1 0)?",
    "isc": r"isc license|internet systems consortium license",
    "jsond": r"json license",
    "lgpl-2.0": r"gnu library general public license(?: version)?(?: 2(?: 0)?)?|library general public license(?: version)?(?: 2(?: 0)?)?",
    "lgpl-2.1": r"gnu lesser general public license(?: version| v)? 2 1|lesser general public license(?: version| v)? 2 1|lgpl v?2 1|lgplv2 1",
    "lgpl-3.0": r"gnu lesser general public license(?: version| v)? 3(?: 0)?|lesser general public license(?: version| v)? 3(?: 0)?|lgpl v?3(?: 0)?|lgplv3(?: 0)?",
    "lgpl": r"gnu lesser general public license|lesser general public license|gnu lgpl|lgpl",
    "libpng": r"libpng license|png reference library license",
    "lppl-1.3c": r"latex project public license(?: version)?(?: 1 3[ac]?)?",
    "mit-0": r"mit no attribution|mit 0 license",
    "mit": r"mit license|mit x11 license|expat license|mit style license",
    "mpl-1.1": r"mozilla public license(?: version| v)? 1 1|mpl 1 1",
    "mpl-2.0": r"mozilla public license(?: version| v)? 2 0|mpl 2 0",
    "mpl": r"mozilla public license",
    "ms-pl": r"microsoft public license",
    "ms-rl": r"microsoft reciprocal license",
    "ncsa": r"university of illinois ncsa open source license|ncsa open source license",
    "npl-1.1": r"netscape public license(?: version)?(?: 1 [01])?",
    "odbl-1.0": r"open database license|odbl(?: 1 0)?",
    "odc-by-1.0": r"open data commons attribution license",
    "ofl-1.1": r"sil open font license(?: version)?(?: 1 [01])?|open font license(?: version)?(?: 1 [01])?",
    "openssl": r"openssl license",
    "osl-3.0": r"open software license(?: version)?(?: v? ?[123] [01])?",
    "pddl-1.0": r"public domain dedication and license",
    "php-3.01": r"php license(?: version)?(?: 3 01)?",
    "postgresql": r"postgresql license",
    "python-2.0": r"python software foundation license|psf license",
    "qpl-1.0": r"q public license(?: version)?(?: 1 0)?",
    "ruby": r"ruby license",
    "sleepycat": r"sleepycat license",
    "sspl-1.0": r"server side public license(?: version)?(?: 1)?",
    "unlicense": r"the unlicense|unlicense",
    "upl-1.0": r"universal permissive license(?: version)?(?: 1 0)?",
    "vim": r"vim license",
    "w3c": r"w3c software(?: notice and)? license",
    "wtfpl": r"do what the f\w+ you want to public license|wtfpl",
    "x11": r"x11 license|x consortium license",
    "zlib": r"zlib license|zlib libpng license",
    "zpl-2.1": r"zope public license(?: version)?(?: 2 [01])?",
}
# Sentences of license texts.
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", r"neither the name of .{1,60}nor the names of its contributors may be used"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software"),
    ("gpl", r"this program is free software you can redistribute it and or modify it"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it"),
    ("gpl", r"you should have received a copy of the gnu general public license"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"released into the public domain|dedicated to the public domain|placed in the public domain"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("all-rights-reserved", r"all rights reserved"),
    ("proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d"),
]
VERBS = "licensed|released|distributed|published|available|provided|dual licensed|covered|shared"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: By priority: a name; a name with its version; a sentence of the text; a grant; an identifier line.
CONFIDENCE = {1: 0.6, 2: 0.75, 3: 0.85, 4: 0.95, 5: 1.0}


def _alternatives(pattern: str) -> list[str]:
    depth, start, out = 0, 0, []
    for i, c in enumerate(pattern + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
    return out


def _leads(pattern: str) -> list[str]:
    """First words of the alternatives; groups do not open a pattern."""
    return sorted({re.match("[a-z0-9]+", a)[0] for a in _alternatives(pattern)})


def _fragments(pattern: str) -> list[str]:
    """Runs of letters and digits that every match of an alternative holds: no groups, sets, classes or optional characters."""
    while (inner := re.sub(r"\((?:\?:)?[^()]*\)[?*]?", "~", pattern)) != pattern:
        pattern = inner
    return re.findall("[a-z0-9]+", re.sub(r"\[[^]]*\]|\\.[*+?]?|\{[^}]*\}|.[?*]", "~", pattern))


def gate() -> list[str]:
    """Parts of single words, one for every alternative of the rules and base phrases: a text without any has no signature.

    Grants hold a name. Words of a rule may stand apart by any punctuation or line breaks, so no part spans two words.
    """
    chosen = {"spdx"}
    for pattern in [*NAMES.values(), *(p for _, p in SENTENCES), *BASE]:
        for alternative in _alternatives(pattern):
            parts = _fragments(alternative)
            chosen.add("licen" if any(p.startswith("licen") for p in parts) else max(parts, key=len))
    return sorted(c for c in chosen if not any(o != c and o in c for o in chosen))


def _rule(label: str, priority: int, pattern: str, leads: list[str] | None = None) -> dict:
    return {"label": label, "priority": priority, "leads": leads or _leads(pattern), "pattern": f"^(?:{pattern})(?= |$)"}


def rules() -> list[dict]:
    """Signature rules in order: from every name one for the name, one for a grant and one for an identifier line; and the sentences."""
    out = [_rule("mit", 5, r"spdx license identifier mit")]
    for label, name in NAMES.items():
        identifier = label.replace("-", " ").replace(".", " ")
        out.append(_rule(label, 5, rf"spdx license identifier {identifier}(?: only| or later)?"))
        out.append(_rule(label, 4, rf"(?:{VERBS}) (?:under|by|with|on) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})", sorted({v.split(" ")[0] for v in VERBS.split("|")})))
        versioned = any(c.isdigit() for c in label)
        out.append(_rule(label, 2 if versioned else 1, name))
    out += [_rule(label, 3, sentence) for label, sentence in SENTENCES]
    return [{"id": i, **r} for i, r in enumerate(out)]


def _most_words(pattern: str) -> int:
    """Words that the longest match can have: spaces by alternative, two characters a word where any character may stand."""
    pattern = re.sub(r"\.\{\d+,(\d+)\}", lambda m: " " * ((int(m[1]) + 1) // 2), pattern.removesuffix("(?= |$)"))
    inner = r"\((?:\?:)?([^()]*)\)"
    while re.search(inner, pattern):
        pattern = re.sub(inner, lambda m: " " * max(a.count(" ") for a in m[1].split("|")), pattern)
    return max(a.count(" ") for a in pattern.split("|")) + 1


def stretch() -> int:
    """Words from a lead on that the rules may look at: as many as the widest one can take up."""
    return max(_most_words(r["pattern"]) for r in rules())


def _lowered(text: str) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower())


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns with n_words, places (of base phrases: start and label) and detections (start, end, priority, label; words from 0, end excluded).

    Null texts count as empty ones. Columns of `docs` with these names are replaced. Everything is computed row by row, so rows
    need neither keys nor a shuffle.
    """
    table = rules()
    schema = "array<struct<id:int,label:string,priority:int,leads:array<string>,pattern:string>>"
    known = F.from_json(F.lit(json.dumps(table)), schema)
    leads = F.array(*[F.lit(x) for x in sorted({w for r in table for w in r["leads"]} | {p.split(" ")[0] for p in BASE})])
    low = F.col("_low")
    gated = F.lit(False)
    for g in gate():
        gated = gated | F.contains(low, F.lit(g))
    words = F.when(gated, F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn("_low", _lowered(text)).withColumn("n_words", F.regexp_count(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")).withColumn("_words", words)
    indexed = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("start"), w.alias("lead"))), lambda s: F.array_contains(leads, s["lead"]))
    out = out.withColumn("_starts", indexed)
    width = stretch()
    stretches = F.transform("_starts", lambda s: F.struct(s["start"].alias("start"), s["lead"].alias("lead"), F.array_join(F.slice("_words", s["start"] + 1, width), " ").alias("words")))
    out = out.withColumn("_stretches", stretches)
    places = F.flatten(F.transform("_stretches", lambda s: F.filter(
        F.array(*[F.struct(s["start"].cast("long").alias("start"), F.when(F.startswith(F.concat(s["words"], F.lit(" ")), F.lit(p + " ")), label).alias("label")) for p, label in BASE.items()]),
        lambda b: b["label"].isNotNull(),
    )))
    found = F.flatten(F.transform("_stretches", lambda s: F.transform(
        F.filter(known, lambda r: F.array_contains(r["leads"], s["lead"]) & F.regexp_like(s["words"], r["pattern"])),
        lambda r: F.struct(s["start"].alias("start"), (-(s["start"] + F.size(F.split(F.regexp_substr(s["words"], r["pattern"]), " ")))).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["id"].alias("id"), r["label"].alias("label")),
    )))
    return out.withColumn("places", places).withColumn("detections", unsuppressed(F.array_sort(found))).drop("_low", "_words", "_starts", "_stretches")


def unsuppressed(ordered: Column) -> Column:
    """Detections that no other of their priority or a higher one contains.

    In order of start, longest first, a container stands before what it contains; so it is enough to know the farthest end
    of each priority so far.
    """
    kind = "array<struct<start:int,end:int,priority:int,label:string>>"
    start = F.struct(F.array().cast(kind).alias("kept"), F.array(*[F.lit(-1)] * len(CONFIDENCE)).alias("ends"))

    def step(a: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        inside = F.exists(F.slice(a["ends"], priority, len(CONFIDENCE)), lambda e: e >= end)
        kept = F.concat(a["kept"], F.array(F.struct(d["start"].alias("start"), end.alias("end"), priority.alias("priority"), d["label"].alias("label"))))
        ends = F.transform(a["ends"], lambda e, i: F.when(i == priority - 1, F.greatest(e, end)).otherwise(e))
        return F.struct(F.when(inside, a["kept"]).otherwise(kept).alias("kept"), ends.alias("ends"))

    return F.aggregate(ordered, start, step, lambda a: a["kept"])


def licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for every row.

    Label lists are sorted and comma-joined, empty without labels; the score is the confidence of the best detection, 0
    without one. Other columns are not read, whatever their names.
    """
    out = scanned(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    starts, base = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    best = F.array_max(F.transform("detections", lambda d: d["priority"]))
    base_score = F.when(F.size("places") > 0, CONFIDENCE[1]).otherwise(0.0)
    return out.select(
        F.col("key").alias(key), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"])))), ",").alias("labels"),
        F.greatest(base_score, F.coalesce(F.element_at(sure, best), F.lit(0.0))).alias("score"), "detections",
    )
