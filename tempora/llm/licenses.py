"""License scans: ordered signature rules over a text's words.

DataFrame functions only.  Of the words that are counted, a set of a few tells
the texts that can hold a license at all; their words (A-Z lower-cased) are
joined by single spaces, each keyword is looked for once there, its rules run
their regular expressions, and of the detections those go that lie within
another of the same or a higher priority.

The rules are few phrases that always count (BASE), sentences of the licenses
themselves and of their notices (SENTENCES), and, for every family of FAMILIES,
a regular expression for each of FORMS, how a license is named.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words: runs of lower-case ASCII letters and digits and of non-ASCII characters. Said by what they hold, since Java takes twice the time over a negated class.
WORD = r"[a-z0-9\x80-\x{10FFFF}]+"
#: Phrases whose every place counts, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, keyword that every form of the family has as a word (with *: as a word's beginning), and its name as a regular expression over words.
FAMILIES = [
    ("agpl", "affero", r"(?:gnu )?affero general public"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public"),
    ("gpl", "gpl*", r"(?:gnu )?gpl(?: ?v?[123](?: 0)?)?"),
    ("gpl", "gnu", r"gnu general public"),
    ("gfdl", "gnu", r"gnu free documentation"),
    ("apache", "apache", r"apache(?: software)?"),
    ("mit", "mit", r"mit(?: x11)?"),
    ("expat", "expat", r"expat"),
    ("x11", "x11", r"x11"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|(?:2|two) clause) bsd"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|(?:3|three) clause) bsd"),
    ("bsd", "bsd", r"(?:berkeley )?bsd"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("mpl", "mozilla", r"mozilla public"),
    ("epl", "eclipse", r"eclipse public"),
    ("cddl", "cddl", r"cddl"),
    ("cddl", "distribution", r"common development and distribution"),
    ("cpl", "common", r"common public"),
    ("artistic", "artistic", r"(?:perl )?artistic"),
    ("boost", "boost", r"boost(?: software)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python", "python", r"python(?: software foundation)?"),
    ("php", "php", r"php"),
    ("ruby", "ruby", r"ruby"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("ofl", "font", r"(?:sil )?open font"),
    ("eupl", "european", r"european union public"),
    ("cecill", "cecill", r"cecill(?: [abc])?"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("odbl", "database", r"open(?: data commons)? database"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "noderivatives", r"creative commons attribution noncommercial noderivatives"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike"),
    ("cc-by", "commons", r"creative commons attribution"),
    ("proprietary", "proprietary", r"proprietary"),
]
_ANY = r"(?: [a-z0-9]+){1,8}"
#: Label, keyword and a sentence of a license or notice as a regular expression over words; priority 0.
SENTENCES = [
    ("mit", "obtaining", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "substantial", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "dealings", r"arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "sublicense", r"the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("boost", "accompanying", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost", "boost", r"(?:see accompanying file license 1 0 txt or copy at )?https? www boost org license 1 0 txt"),
    ("isc", "fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", r"neither the names? of" + _ANY + r" nor the names of (?:its|their|any)(?: other)? contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("apache", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache", "apache", r"https? www apache org licenses license 2 0"),
    ("apache", "contributor", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", "basis", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "redistribute", r"(?:this program|this file|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "option", r"either version [123](?: 0)? of the (?:gnu general public )?license or at your option any later version"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license"),
    ("gpl", "copyleft", r"the gnu general public license is a free copyleft license"),
    ("lgpl", "redistribute", r"(?:this library|it) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public license"),
    ("agpl", "affero", r"under the terms of the gnu affero general public license"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public license"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", "liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compiled", r"either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0", "waived", r"to the extent possible under law" + _ANY + r" waived all copyright and related or neighboring rights"),
    ("cc0", "publicdomain", r"https? creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creativecommons", r"https? creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "creativecommons", r"https? creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nc", "creativecommons", r"https? creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-sa", "creativecommons", r"https? creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nd", "creativecommons", r"https? creativecommons org licenses by nd [1234] [05]"),
    ("public-domain", "domain", r"(?:dedicated to|placed in|released (?:in)?to|donated to) the public domain"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("artistic", "artistic", r"you can redistribute it and or modify it under the same terms as perl(?: 5)? itself or the artistic license"),
    ("python", "psf", r"psf is making python available to licensee on an as is basis"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ofl", "font", r"this font software is licensed under the sil open font license"),
    ("ncsa", "illinois", r"nor the names of its contributors may be used to endorse or promote products derived from this software university of illinois"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("all-rights-reserved", "reserved", r"copyright(?: c)? (?:19|20)\d+" + _ANY + r" all rights reserved"),
]
#: Priority and form; the lower a priority, the stronger it is. Each has a word with the stem licen, or spdx.
FORMS = [
    (0, r"(?:licensed|released|distributed|made available|provided) under (?:the )?(?:terms of )?(?:the )?{name} licen[cs]e"),
    (0, r"(?:licensed|sublicensed) under (?:the )?(?:terms of )?(?:the )?{name}"),
    (0, r"permission is (?:hereby )?granted under (?:the )?{name} licen[cs]e"),
    (0, r"(?:this|the) (?:program|software|work|file|document|library|project) is (?:licensed )?under (?:the )?{name} licen[cs]e"),
    (1, r"spdx licen[cs]e identifier {name}"),
    (1, r"spdx licen[cs]e identifier(?: [a-z0-9]+){1,8} (?:and|or|with) {name}"),
    (1, r"{name} licen[cs]e (?:version|v) ?\d+(?: \d+)?(?: or (?:any )?later(?: version)?)?"),
    (1, r"licen[cs]e {name}"),
    (2, r"{name} licen[cs]e"),
]
#: What a detection of each priority says for the text's license: chances that are put together as of independent witnesses.
WEIGHTS = (0.9, 0.7, 0.5)
#: A text that has none of these as a word, nor cc, holds no rule: each form and base phrase has one of the first three or sublicensed, each sentence some.
STEMS = ("license", "licence", "licensed", "sublicensed", "sublicense", "hereby", "copyright", "dealings", "boost", "redistribution", "redistributions", "endorse", "advertising", "apache", "invariant", "mpl", "misrepresented", "altered", "liable", "unencumbered", "compiled", "waived", "publicdomain", "creativecommons", "domain", "evil", "beer", "psf", "openssl", "confidential", "unauthorized")
_DETECTION = "struct<start:int,end:int,priority:int,rule:int,label:string,base:boolean>"


def rules() -> list[dict]:
    """The rules in their order."""
    out = [{"keyword": p.split()[0], "regex": p, "label": label, "priority": 1, "base": True} for p, label in BASE.items()]
    out += [{"keyword": k, "regex": sentence, "label": label, "priority": 0, "base": False} for label, k, sentence in SENTENCES]
    out += [{"keyword": k, "regex": form.replace("{name}", f"(?:{name})"), "label": label, "priority": p, "base": False} for label, k, name in FAMILIES for p, form in FORMS]
    keyword = lambda k: f" {k[:-1]}" if k.endswith("*") else f" {k} "
    return [{"rule": i, **r, "keyword": keyword(r["keyword"]), "regex": f"(?<= ){r['regex']}(?= )"} for i, r in enumerate(out)]


def _rule_table() -> Column:
    """The rules by keyword."""
    groups: dict[str, list[dict]] = {}
    for r in rules():
        groups.setdefault(r["keyword"], []).append(r)
    table = [{"keyword": k, "rules": v} for k, v in groups.items()]
    return F.from_json(F.lit(json.dumps(table)), "array<struct<keyword:string,rules:array<struct<rule:int,regex:string,label:string,priority:int,base:boolean>>>>")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _found(line: Column, rule: Column) -> Column:
    """The rule's detections: between the pieces that its matches leave, words are counted by their spaces."""
    # each is an array of one or none, so that a lambda's argument holds what was found and no match searches the text anew
    matched = F.filter(F.array(F.regexp_extract_all(line, rule["regex"], F.lit(0))), lambda m: F.size(m) > 0)
    cut = F.transform(matched, lambda m: F.struct(F.split(line, rule["regex"], -1).alias("pieces"), m.alias("matches")))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + _spaces(x["piece"])
        stop = start + _spaces(x["match"])
        d = F.struct((start - 1).alias("start"), stop.alias("end"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["base"].alias("base"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(d)).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_DETECTION}>").alias("out"))
    # the piece behind the last match counts for nothing
    pairs = lambda c: F.zip_with(F.slice(c["pieces"], F.lit(1), F.size(c["matches"])), c["matches"], lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    return F.flatten(F.transform(cut, lambda c: F.aggregate(pairs(c), first, add, lambda s: s["out"])))


def _unsuppressed(detections: Column) -> Column:
    """Base detections, and those that no stronger or equal one contains.

    In order of start, then longest, then strongest: whatever contains a
    detection comes before it, so the farthest end so far of each priority tells.
    """
    order = F.transform(detections, lambda d: F.struct(d["start"], (-d["end"]).alias("stop"), d["priority"], d["rule"], d["end"], d["label"], d["base"]))
    first = F.struct(*[F.lit(-1).alias(f"m{p}") for p in range(len(WEIGHTS))], F.array().cast(f"array<{_DETECTION}>").alias("out"))

    def step(state: Column, d: Column) -> Column:
        # the farthest end among the priorities that suppress this one
        reach = F.when(d["priority"] == 0, state["m0"]).when(d["priority"] == 1, F.greatest(state["m0"], state["m1"])).otherwise(F.greatest(*[state[f"m{p}"] for p in range(len(WEIGHTS))]))
        own = F.struct(d["start"].alias("start"), d["end"].alias("end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"), d["base"].alias("base"))
        kept = F.when(d["base"] | (reach < d["end"]), F.concat(state["out"], F.array(own))).otherwise(state["out"])
        ends = [F.when((d["priority"] == p) & ~d["base"], F.greatest(state[f"m{p}"], d["end"])).otherwise(state[f"m{p}"]).alias(f"m{p}") for p in range(len(WEIGHTS))]
        return F.struct(*ends, kept.alias("out"))

    return F.aggregate(F.array_sort(order), first, step, lambda s: s["out"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, detections (start and end words, priority, rule, label, base), labels (sorted) and score.

    score: the chance that one of the detections is right, each for itself.
    Null or empty texts have no words, no detections and the score 0.  Repeated
    rows are scanned each.  Columns of the result's names are replaced, others stay.
    """
    new = ("n_words", "detections", "labels", "score")
    kept = [c for c in docs.columns if c not in new]
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # F.lower leaves the bounds of words, and at least the words that lower-casing A-Z alone makes of ASCII ones
    words = F.regexp_extract_all(F.lower(value), F.lit(WORD), F.lit(0))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], value.alias("__value"), words.alias("__words"))
    gate = F.arrays_overlap("__words", F.array(*[F.lit(w) for w in (*STEMS, "cc")]))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    own = F.regexp_extract_all(F.translate("__value", upper, lower), F.lit(WORD), F.lit(0))
    line = F.when(gate, F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")))
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], F.size("__words").cast("long").alias("n_words"), line.alias("__line"))
    active = F.flatten(F.transform(F.filter(_rule_table(), lambda g: F.col("__line").contains(g["keyword"])), lambda g: g["rules"]))
    found = F.flatten(F.transform(active, lambda r: _found(F.col("__line"), r)))
    none = F.array().cast(f"array<{_DETECTION}>")
    rows = rows.withColumn("detections", F.when(F.col("__line").isNull(), none).otherwise(_unsuppressed(found)))
    doubt = F.aggregate("detections", F.lit(1.0), lambda a, d: a * F.get(F.array(*[F.lit(1 - w) for w in WEIGHTS]), d["priority"]))
    labels = F.array_sort(F.array_distinct(F.transform("detections", lambda d: d["label"])))
    return rows.withColumns({"labels": labels, "score": F.lit(1.0) - doubt}).select(*[F.col(f"`{c}`") for c in kept], *new)
