"""License notices in texts, by ordered signature rules (operator 8). DataFrame functions only.

A text becomes its words, lower case, a space around each. Texts without any keyword are
done. For the others, rules of six priorities are looked for, those of one priority by one
alternation: at a place where several of them match, the first in order decides. Of all
matches, an interval that lies within one of the same or a higher priority is suppressed, so
a grant hides the bare name inside it, while notices that merely overlap both stand. Work
and memory are in proportion to the text; no row meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_OTHER = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words to find, and the label of each: fixed values.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_V = "(?:version |v ?)?"
#: label, pattern of its full name, pattern of its short name or identifier, words of its address.
LICENSES = (
    ("0bsd", "zero clause bsd", "0bsd", "opensource org licenses 0bsd"),
    ("afl-3.0", f"academic free license {_V}3 0", "afl 3 0", "opensource org licenses afl 3 0"),
    ("agpl-3.0", f"gnu affero general public license {_V}3(?: 0)?", "agpl ?v?3(?: 0)?", "gnu org licenses agpl 3 0"),
    ("apache-1.1", f"apache (?:software )?license {_V}1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", f"apache (?:software )?license {_V}2(?: 0)?", "apache 2(?: 0)?", "apache org licenses license 2 0"),
    ("artistic-1.0", f"artistic license {_V}1 0", "artistic 1 0", "opensource org licenses artistic 1 0"),
    ("artistic-2.0", f"artistic license {_V}2 0", "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("beerware", "beer ?ware license", "beerware", "people freebsd org phk"),
    ("blueoak-1.0.0", "blue oak model license 1 0 0", "blueoak 1 0 0", "blueoakcouncil org license 1 0 0"),
    ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd)", "bsd ?2", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)", "bsd ?3", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd ?4", "spdx org licenses bsd 4 clause"),
    ("bsl-1.0", f"boost software license {_V}1 0", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", f"business source license {_V}1 1", "busl 1 1", "mariadb com bsl11"),
    ("cc-by-2.0", "creative commons attribution 2 0(?: generic)?", "cc by 2 0", "creativecommons org licenses by 2 0"),
    ("cc-by-3.0", "creative commons attribution 3 0(?: unported)?", "cc by 3 0", "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "creative commons attribution 4 0(?: international)?", "cc by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-nc-2.0", "creative commons attribution non ?commercial 2 0", "cc by nc 2 0", "creativecommons org licenses by nc 2 0"),
    ("cc-by-nc-3.0", "creative commons attribution non ?commercial 3 0", "cc by nc 3 0", "creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-4.0", "creative commons attribution non ?commercial 4 0", "cc by nc 4 0", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-nd-4.0", "creative commons attribution non ?commercial no ?derivatives 4 0", "cc by nc nd 4 0", "creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "creative commons attribution non ?commercial share ?alike 4 0", "cc by nc sa 4 0", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nd-4.0", "creative commons attribution no ?derivatives 4 0", "cc by nd 4 0", "creativecommons org licenses by nd 4 0"),
    ("cc-by-sa-3.0", "creative commons attribution share ?alike 3 0", "cc by sa 3 0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "creative commons attribution share ?alike 4 0", "cc by sa 4 0", "creativecommons org licenses by sa 4 0"),
    ("cc0-1.0", "creative commons zero(?: v1 0)?(?: universal)?", "cc0(?: 1 0)?", "creativecommons org publicdomain zero 1 0"),
    ("cddl-1.0", f"common development and distribution license {_V}1 0", "cddl 1 0", "opensource org licenses cddl1"),
    ("cecill-2.1", "cecill free software license agreement v2 1", "cecill 2 1", "cecill info licences licence cecill v2 1"),
    ("cpl-1.0", f"common public license {_V}1 0", "cpl 1 0", "opensource org licenses cpl1 0"),
    ("ecl-2.0", f"educational community license {_V}2 0", "ecl 2 0", "opensource org licenses ecl 2 0"),
    ("epl-1.0", f"eclipse public license {_V}1 0", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", f"eclipse public license {_V}2 0", "epl 2 0", "eclipse org legal epl 2 0"),
    ("eupl-1.2", f"european union public licen[cs]e {_V}1 2", "eupl 1 2", "joinup ec europa eu eupl 1 2"),
    ("gfdl-1.3", f"gnu free documentation license {_V}1 3", "gfdl 1 3", "gnu org licenses fdl 1 3"),
    ("gpl-1.0", f"gnu general public license {_V}1(?: 0)?", "gpl ?v?1(?: 0)?", "gnu org licenses gpl 1 0"),
    ("gpl-2.0", f"gnu general public license {_V}2(?: 0)?", "gpl ?v?2(?: 0)?", "gnu org licenses gpl 2 0"),
    ("gpl-3.0", f"gnu general public license {_V}3(?: 0)?", "gpl ?v?3(?: 0)?", "gnu org licenses gpl 3 0"),
    ("isc", "(?:internet systems consortium|isc)", "isc", "opensource org licenses isc"),
    ("lgpl-2.1", f"gnu lesser general public license {_V}2 1", "lgpl ?v?2 1", "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", f"gnu lesser general public license {_V}3(?: 0)?", "lgpl ?v?3(?: 0)?", "gnu org licenses lgpl 3 0"),
    ("lppl-1.3c", f"latex project public license {_V}1 3c", "lppl 1 3c", "latex project org lppl lppl 1 3c"),
    ("mit", "mit", "expat", "opensource org licenses mit"),
    ("mit-0", "mit no attribution", "mit 0", "opensource org licenses mit 0"),
    ("mpl-1.1", f"mozilla public license {_V}1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", f"mozilla public license {_V}2 0", "mpl 2 0", "mozilla org mpl 2 0"),
    ("ms-pl", "microsoft public license", "ms pl", "opensource org licenses ms pl"),
    ("ncsa", "university of illinois ncsa open source license", "ncsa", "opensource org licenses ncsa"),
    ("odbl-1.0", f"open data commons open database license {_V}1 0", "odbl 1 0", "opendatacommons org licenses odbl 1 0"),
    ("ofl-1.1", f"sil open font license {_V}1 1", "ofl 1 1", "scripts sil org ofl"),
    ("postgresql", "postgresql licen[cs]e", "postgresql", "opensource org licenses postgresql"),
    ("psf-2.0", f"python software foundation license {_V}2", "psf 2 0", "docs python org license"),
    ("unlicense", "(?:the )?unlicense", "unlicense", "unlicense org"),
    ("upl-1.0", f"universal permissive license {_V}1 0", "upl 1 0", "oss oracle com licenses upl"),
    ("wtfpl", "do what the fuck you want to public license", "wtfpl", "wtfpl net"),
    ("zlib", "zlib(?: libpng)?", "zlib", "opensource org licenses zlib"),
    ("zpl-2.1", f"zope public license {_V}2 1", "zpl 2 1", "opensource org licenses zpl 2 1"),
)
_GRANT = "(?:licensed|released|distributed|available|published|provided|offered|covered|shared) under (?:the |an? )?(?:terms of )?(?:the |an? )?(?:(?:license )?(?:of )?)?"
_END = "(?: licen[cs]e)?"

#: label, pattern of words that stand in the license's own text or in its standard notice: fixed values.
NOTICES = (
    ("agpl-3.0", "remote network interaction use with the gnu general public license"),
    ("agpl-3.0-or-later", "gnu affero general public license as published by the free software foundation either version 3 of the license or"),
    ("agpl-3.0-only", "gnu affero general public license as published by the free software foundation version 3 of the license"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("apache-2.0", "you may not use this file except in compliance with the license(?: you may obtain a copy of the license)?"),
    ("apache-2.0", "grants to you a perpetual worldwide non ?exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("blueoak-1.0.0", "this license gives everyone as much permission to work with this software as possible"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided"),
    ("bsd-3-clause", "neither the names? of .{1,80}?(?:may|can) be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non ?production use of the licensed work"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution non ?commercial 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution share ?alike 4 0 international license"),
    ("cc0-1.0", "to the extent possible under law .{1,80}?has waived all copyright and related or neighbou?ring rights to"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cecill-2.1", "governed by the cecill license under french law and abiding by the rules of distribution of free software"),
    ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-2.0-or-later", "gnu general public license as published by the free software foundation either version 2 of the license or"),
    ("gpl-2.0-only", "gnu general public license(?: version 2)? as published by the free software foundation version 2(?: of the license)?"),
    ("gpl-3.0-or-later", "gnu general public license as published by the free software foundation either version 3 of the license or"),
    ("gpl-3.0-only", "gnu general public license as published by the free software foundation version 3 of the license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|library|software|file)"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("lgpl-2.1-or-later", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or"),
    ("lgpl-3.0-or-later", "gnu lesser general public license as published by the free software foundation either version 3 of the license or"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this (?:program|library|software|file)"),
    ("lppl-1.3c", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v ?2 0"),
    ("ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("odbl-1.0", "this .{1,60}?is made available under the open database license"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("proprietary", "(?:unauthori[sz]ed copying of this file via any medium is strictly prohibited|proprietary and confidential)"),
    ("public-domain", "(?:has been |is |are )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
)


#: Words that are no keyword while a spelling has another: they stand in many texts.
_PLAIN = frozenset("a agreement alike an attribution by clause commercial database derivatives development distribution docs document documentation domain font foundation free general info international legal licence licences license licenses model modified no noderivatives noncommercial of open org original people project public school scripts sharealike simplified software source system systems the to under union universal university v version want what with you".split())


def _spellings(pattern: str) -> set[str]:
    """Every text that a pattern of literals, (?:a|b), [ab] and ? matches; `.{a,b}?` stands for words that do not count."""

    def read(i: int) -> tuple[set[str], int]:
        done, now = set(), {""}
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                done, now, i = done | now, {""}, i + 1
                continue
            if pattern[i] == ".":  # any words in between: they are nobody's keyword
                part, i = {" "}, pattern.index("?", i)
            elif pattern.startswith("(?:", i):
                part, i = read(i + 3)
            elif pattern[i] == "[":
                end = pattern.index("]", i)
                part, i = set(pattern[i + 1 : end]), end
            else:
                part = {pattern[i]}
            i += 1
            if i < len(pattern) and pattern[i] == "?":
                part, i = part | {""}, i + 1
            now = {a + b for a in now for b in part}
        return done | now, i

    return read(0)[0]


def _keys(*patterns: str) -> tuple[str, ...]:
    """Words of which every text that one of the patterns matches has one: the longest of each spelling that is not plain."""
    return tuple(sorted({min(text.split(), key=lambda w: (w in _PLAIN or w.isdigit(), -len(w), w)) for p in patterns for text in _spellings(p)}))


#: Confidence and prefix of the rules of each priority.
PRIORITIES = ((1.0, "spdx license identifier "), (0.97, ""), (0.95, _GRANT), (0.9, ""), (0.8, ""), (0.6, ""))


def signatures() -> list[tuple[int, str, tuple[str, ...], str]]:
    """(priority, label, keywords, pattern of what follows the priority's prefix) of every rule, in order; each match has one of the keywords.

    The priorities are identifier tags, notices, grants, addresses, titles and mentions.
    """
    out = [(2, label, _keys(pattern), pattern) for label, pattern in NOTICES]
    for label, name, short, address in LICENSES:
        out += [
            (1, label, ("spdx",), f"(?:{short}|{name})"),
            (3, label, _keys(name, short), f"(?:{name}|{short}){_END}"),
            (4, label, _keys(address), address),
            (5, label, _keys(name), f"(?:{name}){_END}" if " " in name else f"(?:the )?(?:{name}) licen[cs]e"),
            (6, label, _keys(short), f"(?:licen[cs]e (?:{short})|(?:{short}) licen[cs]e)"),
        ]
    # longer patterns first within a priority: a name with more words is not cut short by one inside it
    return sorted(out, key=lambda r: (r[0], -len(r[3]), r[1]))


def rules() -> list[tuple[int, str, str, float]]:
    """(priority, label, pattern over words, confidence) of every rule, in order."""
    return [(p, label, f" {PRIORITIES[p - 1][1]}{pattern}(?= )", PRIORITIES[p - 1][0]) for p, label, _, pattern in signatures()]


def _keywords() -> list[str]:
    return sorted({key for r in signatures() for key in r[2]} | set(_keys(*(phrase for phrase, _ in BASE_PHRASES))))


def _any_of(words: list[str]) -> str:
    """A pattern of any of the words that looks at each letter once."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        ways = [c + write(child) for c, child in node.items() if c]
        if not ways:
            return ""
        some = ways[0] if len(ways) == 1 and len(node) == 1 else f"(?:{'|'.join(ways)})"
        return some + "?" if "" in node else some

    return write(tree)


def _count(text: Column, phrase: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))


_CHUNK = 256
_SPOT = "struct<begin:int,back:int,priority:int,label:string>"
_NONE = f"array<{_SPOT}>"


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, kind: str, start: Column, step, emit, out: str) -> Column:
    """emit(state, item) of every item, where step(state, item) is the next state; in chunks, so that time is in proportion to the items."""
    inner, outer = f"struct<s:{kind},out:array<{out}>>", f"struct<s:{kind},out:array<array<{out}>>>"

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["s"], x).alias("s"), F.array_append(acc["out"], emit(acc["s"], x)).alias("out")).cast(inner)

    def many(acc: Column, part: Column) -> Column:
        first = F.struct(acc["s"].alias("s"), F.array().cast(f"array<{out}>").alias("out")).cast(inner)
        return F.aggregate(part, first, one, lambda done: F.struct(done["s"].alias("s"), F.array_append(acc["out"], done["out"]).alias("out")).cast(outer))

    def run(all_items: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(all_items) / _CHUNK).cast("int")), lambda i: F.slice(all_items, i * _CHUNK + 1, F.lit(_CHUNK)))
        return F.flatten(F.aggregate(chunks, F.struct(start.alias("s"), F.array().cast(f"array<array<{out}>>").alias("out")).cast(outer), many, lambda acc: acc["out"]))

    return _let(items, run)


def _spots(words: Column, priority: int) -> Column:
    """All matches of one priority's rules, at every place that has one: begin, minus end, priority, label."""
    own = [(label, pattern) for p, label, _, pattern in signatures() if p == priority]
    prefix = " " + PRIORITIES[priority - 1][1]
    # each match is written out before the place where it begins
    marked = F.regexp_replace(words, f"(?=({prefix}(?:{'|'.join(pattern for _, pattern in own)})(?= )))", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")

    def found(part: Column) -> Column:
        return F.substring_index(part, "\u0002", 1)

    names = F.array(*[F.lit(name) for name, _ in own])
    groups = f"^{prefix}(?:{'|'.join(f'(?<g{i}>{pattern})' for i, (_, pattern) in enumerate(own))})$"
    which = "\u0003".join(f"${{g{i}}}" for i in range(len(own)))

    def label(match: Column) -> Column:
        # the groups of the rules that did not match are empty: as many marks stand before the one that did
        return F.element_at(names, F.length(F.regexp_extract(F.regexp_replace(match, groups, which), "^\u0003*", 0)) + 1)

    def emit(begin: Column, part: Column) -> Column:
        return _let(found(part), lambda m: F.struct(begin.alias("begin"), (-begin - F.length(m)).alias("back"), F.lit(priority).alias("priority"), label(m).alias("label")).cast(_SPOT))

    def read(some: Column) -> Column:
        first = F.length(F.element_at(some, 1))
        spots = _scan(F.slice(some, 2, F.size(some)), "int", first, lambda at, part: at + F.length(part) - F.length(found(part)) - 1, emit, _SPOT)
        return F.when(F.size(some) > 1, spots).otherwise(F.array().cast(_NONE))

    return _let(parts, read)


_FOUND = "struct<begin:int,end:int,label:string,confidence:double>"


def _detections(words: Column) -> Column:
    """All matches that stand, as (begin, end, label, confidence): character positions in the text of words."""
    levels = range(1, len(PRIORITIES) + 1)
    asked = {1: F.contains(words, F.lit(" spdx ")), 3: F.contains(words, F.lit(" under ")), 6: F.contains(words, F.lit(" licen"))}
    each = [F.when(asked[p], _spots(words, p)).otherwise(F.array().cast(_NONE)) if p in asked else _spots(words, p) for p in levels]
    state = "struct<" + ",".join(f"m{p}:int" for p in levels) + ">"
    sure = F.array(*[F.lit(c) for c, _ in PRIORITIES])

    def step(s: Column, x: Column) -> Column:  # m: the farthest end of what began before, of the priority or a higher one
        return F.struct(*[F.greatest(s[f"m{p}"], F.when(x["priority"] <= p, -x["back"]).otherwise(F.lit(0))).alias(f"m{p}") for p in levels]).cast(state)

    def emit(s: Column, x: Column) -> Column:
        reach = F.element_at(F.array(*[s[f"m{p}"] for p in levels]), x["priority"])
        spot = F.struct(x["begin"].alias("begin"), (-x["back"]).alias("end"), x["label"].alias("label"), F.element_at(sure, x["priority"]).alias("confidence")).cast(_FOUND)
        return F.when(reach < -x["back"], spot).otherwise(F.lit(None).cast(_FOUND))

    ordered = F.array_sort(F.concat(*each))
    zero = F.struct(*[F.lit(0).alias(f"m{p}") for p in levels]).cast(state)
    return F.array_compact(_scan(ordered, state, zero, step, emit, _FOUND))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every row of `docs`.

    n_base counts the places of the base phrases, first_word and last_word are the smallest
    and the largest of their first words' numbers (from 0; null without any). base_labels
    and labels are distinct, sorted and joined by commas, empty without any; score is the
    greatest confidence (0 without a label, 0.8 at least with a base label). detections has
    the positions in the text of words. Null texts count as empty. Ids may repeat or be
    null; other columns are ignored.
    """
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    gate = F.col("text").rlike(f"(?i)(?:^|[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]){_any_of(_keywords())}(?![0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}])")
    counted = docs.select(F.col(f"`{id_col}`").alias("id"), raw.alias("text")).select("id", F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"), F.when(gate, F.col("text")).alias("text"))
    lowered = F.translate(F.regexp_replace("text", _OTHER, " "), _UPPER, _LOWER)
    words = counted.select("id", "n_words", F.when(F.col("text").isNotNull(), F.concat(F.lit(" "), F.trim(lowered), F.lit(" "))).alias("words"))
    wide = words.select("id", "n_words", "words", F.replace("words", F.lit(" "), F.lit("  ")).alias("wide"), F.when(F.col("words").isNotNull(), _let(F.col("words"), _detections)).alias("found"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE_PHRASES:
        p = " " + "  ".join(phrase.split(" ")) + " "
        n = F.coalesce(_count(F.col("wide"), p).cast("long"), F.lit(0).cast("long"))
        counts.append(n)
        labels.append(F.when(n > 0, F.lit(label)))
        firsts.append(F.when(n > 0, F.regexp_count(F.substring_index("wide", p, 1), F.lit("[^ ]+"))).cast("long"))
        lasts.append(F.when(n > 0, F.col("n_words") - F.regexp_count(F.substring_index("wide", p, -1), F.lit("[^ ]+")) - len(phrase.split(" "))).cast("long"))
    base = F.array_sort(F.array_compact(F.array(*labels)))
    found = F.coalesce(F.col("found"), F.array().cast(f"array<{_FOUND}>"))
    best = F.coalesce(F.array_max(F.transform(found, lambda d: d["confidence"])), F.lit(0.0))
    return wide.select(
        F.col("id").alias(id_col),
        "n_words",
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform(found, lambda d: d["label"]))), ",").alias("labels"),
        F.greatest(best, F.when(F.size(base) > 0, F.lit(0.8)).otherwise(F.lit(0.0))).alias("score"),
        found.alias("detections"),
    )
