"""License scans by ordered signature rules, with DataFrame functions only.

A rule is a regular expression over a document's words (ASCII-lower-cased runs of letters and digits, with single spaces
between), gated by words that no match lacks, with a priority: first whole license texts and identifiers, then notices, then versions,
names and hints. Documents without such words are not looked at further; in the others, only rules whose
words occur are run. A detection that lies inside one of an earlier or the same priority (or repeats it) is suppressed.

The base counts the places where a few fixed phrases stand word by word; the rules add labels to those of the base. score is the
confidence of the best detection that is left: 1 for a text or an identifier, 0.9 for a notice or a base phrase, 0.7 for a name, 0.4 for
a hint, 0 for none. Null texts count as empty, texts without words have n_words 0 and empty labels; equal rows give equal rows, one for
one, and other columns are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifuzz.llm.spans import let, matches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label: (name as a regular expression over words, words of which every spelling of it holds one, identifiers as words). Versions are told by the rules.
FAMILIES = {
    "mit": ("mit", "mit", "mit|mit 0"),
    "apache": ("apache(?: software)?", "apache", r"apache \d(?: \d)*"),
    "agpl": ("(?:gnu )?(?:affero general public|agpl)", "affero|agpl", r"agpl \d \d(?: only| or later)?"),
    "lgpl": ("(?:gnu )?(?:lesser general public|library general public|lgpl)", "lesser|library|lgpl", r"lgpl \d \d(?: only| or later)?"),
    "gpl": ("(?:gnu )?(?:general public|gpl)", "general|gpl", r"gpl \d \d(?: only| or later)?"),
    "gfdl": ("(?:gnu )?(?:free documentation|fdl)", "documentation|fdl", r"gfdl \d \d(?: only| or later)?"),
    "bsd": (r"(?:[0234] clause )?(?:new |modified |simplified |revised )?bsd(?: [0234] clause)?", "bsd", r"bsd \d clause|0bsd"),
    "mpl": ("(?:mozilla public|mpl)", "mozilla|mpl", r"mpl \d \d"),
    "epl": ("(?:eclipse public|epl)", "eclipse|epl", r"epl \d \d"),
    "edl": ("eclipse distribution", "eclipse", "edl"),
    "cddl": ("(?:common development and distribution|cddl)", "development|cddl", r"cddl \d \d"),
    "cpl": ("common public", "common", r"cpl \d \d"),
    "ipl": ("ibm public", "ibm", r"ipl \d \d"),
    "isc": ("isc", "isc", "isc"),
    "zlib": ("(?:zlib(?: libpng)?|libpng)", "zlib|libpng", "zlib|libpng(?: 2 0)?"),
    "artistic": ("(?:clarified )?artistic", "artistic", r"artistic \d \d(?: perl)?"),
    "boost": ("boost software", "boost", r"bsl \d \d"),
    "unlicense": ("unlicense", "unlicense", "unlicense"),
    "wtfpl": ("(?:wtfpl|do what the fuck you want to public)", "wtfpl|fuck", "wtfpl"),
    "eupl": ("(?:european union public|eupl)", "european|eupl", r"eupl \d \d"),
    "ofl": ("(?:sil )?open font", "font", r"ofl \d \d"),
    "psf": ("(?:python software foundation|psf)", "python|psf", r"psf \d \d|python \d \d"),
    "php": ("php", "php", r"php \d \d+"),
    "ruby": ("ruby", "ruby", "ruby"),
    "postgresql": ("postgresql", "postgresql", "postgresql"),
    "openssl": ("openssl", "openssl", "openssl"),
    "openldap": ("openldap public", "openldap", r"oldap \d \d"),
    "ms-pl": ("(?:microsoft public|ms pl)", "microsoft|ms", "ms pl"),
    "ms-rl": ("(?:microsoft reciprocal|ms rl)", "reciprocal|rl", "ms rl"),
    "afl": ("academic free", "academic", r"afl \d \d"),
    "osl": ("open software", "software", r"osl \d \d"),
    "ecl": ("educational community", "educational", r"ecl \d \d"),
    "ncsa": ("(?:university of illinois )?ncsa(?: open source)?", "ncsa", "ncsa"),
    "upl": ("universal permissive", "permissive", r"upl \d \d"),
    "vim": ("vim", "vim", "vim"),
    "beerware": ("beer ?ware", "beer|beerware", "beerware"),
    "bsl": ("business source", "business", r"busl \d \d"),
    "sspl": ("(?:server side public|sspl)", "side|sspl", r"sspl \d \d"),
    "elastic": ("elastic", "elastic", r"elastic \d \d"),
    "cecill": ("cecill(?: [bc])?", "cecill", r"cecill(?: [bc])?(?: \d \d)?"),
    "odbl": ("(?:open database|odbl)", "database|odbl", r"odbl \d \d"),
    "odc-by": ("open data commons attribution", "attribution", r"odc by \d \d"),
    "pddl": ("public domain dedication and license", "dedication", r"pddl \d \d"),
    "cc0": ("(?:cc0|cc zero|creative commons zero)", "cc0|cc|creative", r"cc0 \d \d"),
    "cc-by-nc-nd": ("(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)", "cc|attribution", r"cc by nc nd \d \d"),
    "cc-by-nc-sa": ("(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc|attribution", r"cc by nc sa \d \d"),
    "cc-by-nc": ("(?:cc by nc|creative commons attribution non ?commercial)(?! (?:nd|sa|no ?deriv|share))", "cc|attribution", r"cc by nc \d \d"),
    "cc-by-nd": ("(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)", "cc|attribution", r"cc by nd \d \d"),
    "cc-by-sa": ("(?:cc by sa|creative commons attribution share ?alike)", "cc|attribution", r"cc by sa \d \d"),
    "cc-by": ("(?:cc by|creative commons attribution)(?! (?:nc|nd|sa|non|no ?deriv|share))", "cc|attribution", r"cc by \d \d"),
    "proprietary": ("(?:proprietary|commercial|end user)", "proprietary|commercial|user", "licenseref [a-z0-9 ]{1,40}"),
}

#: label, words of which all must occur (with bars: one of them), and words of whole license texts.
TEXTS = (
    ("mit", "hereby person", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache", "licensed apache", "licensed under the apache license version 2 0 the license you may not use this file"),
    ("gpl", "redistribute general", "(?:is|this program is) free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute gnu", "free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute affero", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl", "mozilla source", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "eclipse accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "development distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", "hereby organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "unencumbered domain", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck want", "you just do what the fuck you want to"),
    ("artistic", "intent package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("cc0", "neighboring waived", "to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights"),
    ("ofl", "sil font", "this font software is licensed under the sil open font license"),
    ("psf", "python agreement", "this license agreement is between the python software foundation"),
    ("postgresql", "permission documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("vim", "vim restrictions", "there are no restrictions on distributing unmodified copies of vim"),
    ("bsd", "endorse contributors", "neither the name of .{1,80} nor the names of (?:its|any) contributors may be used to endorse or promote products derived from this software"),
    ("apache", "apache january", "apache license version 2 0 january 2004"),
    ("apache", "apache includes", "this product includes software developed (?:by|at) the apache software foundation"),
    ("gpl", "general 1991|2007", "(?<!lesser |affero )general public license version (?:2 june 1991|3 29 june 2007)"),
    ("gpl", "general received", "you should have received a copy of the gnu general public license along with"),
    ("lgpl", "lesser 1999|2007", "lesser general public license version (?:2 1 february 1999|3 29 june 2007)"),
    ("lgpl", "received lesser|library", "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("agpl", "affero 2007", "affero general public license version 3 19 november 2007"),
    ("agpl", "received affero", "you should have received a copy of the gnu affero general public license along with"),
    ("gfdl", "permission documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "mozilla contents", "the contents of this file are subject to the mozilla public license version"),
    ("mpl", "mpl distributed", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "eclipse accompanies", "which accompanies this distribution and is available at (?:.{1,60} )?eclipse"),
    ("cpl", "common accompanying", "the accompanying program is provided under the terms of this common public license"),
    ("ipl", "ibm accompanying", "the accompanying program is provided under the terms of this ibm public license"),
    ("zlib", "altered removed", "this notice may not be removed or altered from any source distribution"),
    ("artistic", "artistic preamble", "the artistic license(?: 2 0)? (?:.{1,60} )?preamble"),
    ("beerware", "retain stuff", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "good evil", "the software shall be used for good not evil"),
    ("unlicense", "compile distribute", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("openssl", "openssl includes", "this product includes (?:cryptographic )?software (?:developed|written) by the openssl project"),
    ("php", "php includes", "this product includes php software freely available from"),
    ("ruby", "verbatim restriction", "you may make and give away verbatim copies of the source form of (?:the|this) software without restriction"),
    ("ofl", "goals font", "the goals of the open font license"),
    ("ms-pl", "governs accompanying", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("eupl", "european provisions", "this european union public licence (?:.{1,120} )?applies to the work (?:.{1,80} )?provisions"),
    ("afl", "academic applies", "this academic free license (?:.{1,60} )?applies to any original work of authorship"),
    ("osl", "open applies", "this open software license (?:.{1,60} )?applies to any original work of authorship"),
    ("upl", "condition larger", "subject to the condition set forth below permission is hereby granted (?:.{1,400} )?larger works?"),
    ("bsl", "licensor production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl", "server october", "server side public license version 1 october 16 2018"),
    ("elastic", "elastic acceptance", "elastic license 2 0 (?:.{1,80} )?acceptance by using the software you agree"),
    ("odbl", "database available", "is made available under the open database license"),
    ("hpnd", "supporting notice", "both that copyright notice and this permission notice appear in supporting documentation"),
    ("cecill", "cecill french", "this software is governed by the cecill(?: [bc])? license under french law"),
    ("ncsa", "university ncsa", "university of illinois (?:.{1,20} )?ncsa open source license"),
    ("cc0", "deed dedicated", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-sa", "remix contributions", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by", "appropriate changes", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("isc", "software disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("proprietary", "unauthorized confidential", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
    ("proprietary", "confidential disclose", "confidential and proprietary information (?:.{1,120} )?shall not disclose such confidential information"),
)
#: How notices name a license and its version in one breath: glued or bare versions, identifiers outside an SPDX line, names with the version before "license".
NOTICES = (
    ("gpl", "gplv1|gplv2|gplv3|gpl1|gpl2|gpl3", r"(?:gnu )?gplv?[123](?: 0)?(?: (?:only|plus|or (?:at your option )?(?:any )?later(?: versions?)?))?"),
    ("gpl", "gpl", r"(?:gnu )?gpl (?:version |v ?)?[123](?: 0)?(?: (?:only|plus|or (?:at your option )?(?:any )?later(?: versions?)?))?"),
    ("gpl", "gpl", r"gpl v[123](?: 0)?(?: (?:only|plus|or (?:any )?later(?: versions?)?))?"),
    ("gpl", "general", r"(?<!lesser )(?<!affero )(?<!library )general public licen[sc]e (?:version |v ?)?[123](?: 0)?(?: or (?:at your option )?(?:any )?later(?: versions?)?)?"),
    ("lgpl", "lgplv2|lgplv3|lgpl2|lgpl3", r"(?:gnu )?lgplv?[23](?: [01])?(?: (?:only|plus|or (?:any )?later(?: versions?)?))?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl (?:version |v ?)?[23](?: [01])?(?: (?:only|plus|or (?:any )?later(?: versions?)?))?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v ?)?[23](?: [01])?(?: or (?:at your option )?(?:any )?later(?: versions?)?)?"),
    ("agpl", "agplv3|agpl3", r"(?:gnu )?agplv?3(?: 0)?(?: (?:only|plus|or (?:any )?later(?: versions?)?))?"),
    ("agpl", "agpl", r"(?:gnu )?agpl (?:version |v ?)?3(?: 0)?(?: (?:only|plus|or (?:any )?later(?: versions?)?))?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e (?:version |v ?)?3(?: 0)?(?: or (?:at your option )?(?:any )?later(?: versions?)?)?"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl (?:version |v ?)?1(?: [123])?(?: or later)?"),
    ("apache", "apache", r"apache(?: software)?(?: licen[sc]e)? (?:version |v ?)?2(?: 0)?(?: licen[sc]e)?"),
    ("apache", "apache2|asl2|alv2", r"(?:apache2|asl2|alv2)(?: 0)?"),
    ("mit", "mit", r"mit (?:expat|x11)(?: licen[sc]e)?"),
    ("mit", "expat", r"expat (?:mit )?licen[sc]e"),
    ("bsd", "bsd", r"bsd (?:[0234]|zero|two|three|four) clause(?: (?:clear|new|modified|simplified))?(?: licen[sc]e)?"),
    ("bsd", "bsd", r"(?:[0234]|zero|two|three|four) clause (?:new |modified |simplified )?bsd(?: licen[sc]e)?"),
    ("bsd", "bsd2|bsd3|0bsd", r"(?:bsd[23]|0bsd)"),
    ("mpl", "mpl", r"mpl (?:version |v ?)?[12](?: [01])?"),
    ("mpl", "mplv2|mpl2", r"mplv?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e (?:version |v ?)?[12] [01]"),
    ("epl", "epl", r"epl (?:version |v ?)?[12] 0"),
    ("epl", "eclipse", r"eclipse public licen[sc]e (?:version |v ?)?[12](?: 0)?"),
    ("cddl", "cddl", r"cddl (?:version |v ?)?1(?: [01])?"),
    ("eupl", "eupl", r"eupl (?:version |v ?)?1 [0-2]"),
    ("boost", "bsl", r"bsl 1 0"),
    ("bsl", "busl", r"busl 1 1"),
    ("artistic", "artistic", r"artistic (?:licen[sc]e )?(?:version |v ?)?[12] 0"),
    ("ofl", "ofl", r"(?:sil )?ofl (?:version |v ?)?1 [01]"),
    ("cc0", "cc0", r"cc0(?: (?:version |v ?)?1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: \d \d)?(?: (?:international|unported))?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: \d \d)?(?: (?:international|unported))?"),
    ("cc-by-nc", "cc", r"cc by nc(?! (?:nd|sa))(?: \d \d)?(?: (?:international|unported))?"),
    ("cc-by-nd", "cc", r"cc by nd(?: \d \d)?(?: (?:international|unported))?"),
    ("cc-by-sa", "cc", r"cc by sa(?: \d \d)?(?: (?:international|unported))?"),
    ("cc-by", "cc", r"cc by \d \d(?: (?:international|unported))?"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: \d \d)?(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike(?: \d \d)?(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?! (?:no ?deriv|share ?alike))(?: \d \d)?(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?"),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: \d \d)?(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: \d \d)?(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?"),
    ("cc-by", "commons", r"creative commons attribution(?: \d \d)?(?: (?:international|unported|generic))?(?: public)? licen[sc]e"),
)
HINTS = (
    ("public-domain", "public domain", "(?:in|into|to) the public domain"),
    ("all-rights-reserved", "rights reserved", "all rights reserved"),
    ("copyright", "copyright", r"copyright (?:c )?\d{4}"),
)


@dataclass(frozen=True)
class Rule:
    """needs: words by groups; a match holds a word of each group."""

    label: str
    priority: int
    needs: tuple[tuple[str, ...], tuple[str, ...]]
    regex: str
    score: float


#: Families without a rule for "style license".
UNSTYLED = ("agpl", "lgpl", "gpl", "mpl", "epl", "cddl", "wtfpl", "eupl", "psf", "ms-pl", "ms-rl", "sspl", "odbl", "cc0", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "proprietary")
LICENSE = tuple(f"licen{c}e{end}" for c in "sc" for end in ("", "d", "s"))
GRANTS = ("licensed", "licenced", "released", "distributed", "available", "published", "provided", "covered", "governed", "shared", "offered")


def _all(words: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Needs of a rule whose words (one or two, or one of several) must all occur."""
    first, *rest = (tuple(w.split("|")) for w in words.split(" "))
    return first, rest[0] if rest else first


def rules() -> tuple[Rule, ...]:
    """The ordered rules: whole texts, notices and hints as they are written, and for each family one rule of each form."""
    out = [Rule(label, 0, _all(needs), words, 1.0) for label, needs, words in TEXTS]
    out += [Rule(label, 2, _all(needs), words, 0.9) for label, needs, words in NOTICES]
    under = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed|shared|offered) (?:under|by|with)"
    for label, (name, held, identifier) in FAMILIES.items():
        licensed = rf"(?:the |an? )?{name}(?: licen[sc]e)?"
        version = r"(?:(?: licen[sc]e)? (?:version |v ?)?\d+(?: \d+)*)"
        named = tuple(held.split("|"))
        out += [
            Rule(label, 1, _all("spdx identifier"), rf"spdx license identifier (?:{identifier})", 1.0),
            Rule(label, 2, (named, GRANTS), rf"{under} (?:the terms (?:and conditions )?of )?{licensed}{version}?", 0.9),
            Rule(label, 3, (named, LICENSE), rf"licen[sc]e (?:is )?{name}{version}?", 0.9),
            Rule(label, 4, (named, LICENSE), rf"{name}(?: (?:version |v ?)?\d+(?: \d+)*)? licen[sc]e(?:d|s)?{version}?", 0.7),
        ]
        if label not in UNSTYLED:
            out.append(Rule(label, 3, (named, LICENSE), rf"{name} style licen[sc]e", 0.7))
    return tuple(out + [Rule(label, 5, _all(needs), words, 0.4) for label, needs, words in HINTS])


RULES = rules()


def gate_words(table: tuple[Rule, ...]) -> list[str]:
    return sorted({w for r in table for group in r.needs for w in group})


def _texts(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def gated(held: Column, table: tuple[Rule, ...]) -> Column:
    """Whether the words of some rule can be among held, or those of a base phrase: one of the first and one of the second groups, which no match lacks."""
    first, second = ({w for r in table for w in r.needs[k]} for k in (0, 1))
    return F.arrays_overlap(held, _texts(sorted(first))) & F.arrays_overlap(held, _texts(sorted(second)))


def base_places(words: Column) -> Column:
    """array<struct<at, label>>: where the words of a base phrase stand one after the other."""
    some = None
    for phrase, label in BASE:
        first, *rest = phrase.split(" ")

        def place(w: Column, i: Column, first=first, rest=tuple(rest), label=label) -> Column:
            same = w == first
            for k, r in enumerate(rest):
                same = same & (F.coalesce(F.get(words, i + k + 1), F.lit("")) == r)
            return F.when(same, F.struct(i.alias("at"), F.lit(label).alias("label")))

        found = F.array_compact(F.transform(words, _two(place)))
        some = found if some is None else F.concat(some, found)
    return some


def _two(f):
    """f as a function of two parameters, as lambdas of columns are told apart by the number of theirs."""
    return lambda w, i: f(w, i)


def detections(text: Column, held: Column, table: tuple[Rule, ...]) -> Column:
    """array<struct<start, nend, priority, n, end, label, score>>: what the rules whose needs are among held find in text (words between single spaces, one before and after), in the order of the sweep: by start, then longest, then priority."""
    every = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(r.priority).alias("priority"), _texts(r.needs[0]).alias("first"), _texts(r.needs[1]).alias("second"), F.lit(f"(?<= )(?:{r.regex})(?= )").alias("regex"), F.lit(r.label).alias("label"), F.lit(r.score).alias("score")) for n, r in enumerate(table)))

    def run(r: Column) -> Column:
        return F.transform(
            matches(text, r["regex"]),
            lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("nend"), r["priority"].alias("priority"), r["n"].alias("n"), m["end"].alias("end"), r["label"].alias("label"), r["score"].alias("score")),
        )

    return F.sort_array(F.flatten(F.transform(F.filter(every, lambda r: F.arrays_overlap(held, r["first"]) & F.arrays_overlap(held, r["second"])), run)))


def suppressed(found: Column) -> Column:
    """The detections that no other of an earlier or the same priority contains: one sweep, which holds the furthest end so far of each priority. Of equal intervals the earlier priority stays, then the earlier rule."""
    levels = 6
    kind = "array<struct<start:int,nend:int,priority:int,n:int,end:int,label:string,score:double>>"

    def add(acc: Column, s: Column) -> Column:
        inside = F.exists(F.slice(acc["ends"], 1, s["priority"] + 1), lambda e: e >= s["end"])
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == s["priority"], F.greatest(e, s["end"])).otherwise(e))
        return F.when(inside, acc).otherwise(F.struct(ends.alias("ends"), F.concat(acc["out"], F.array(s)).alias("out")))

    return F.aggregate(found, F.struct(F.array_repeat(F.lit(-1), levels).alias("ends"), F.array().cast(kind).alias("out")), add, lambda acc: acc["out"])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, base (array<struct<at, label>>) and detections (array<struct<start, end, label, score>> in characters of the words joined by spaces) of each whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base_kind, kind = "array<struct<at:int,label:string>>", "array<struct<start:int,end:int,label:string,score:double>>"

    def look(words: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        left = let(joined, lambda t: F.transform(suppressed(detections(t, F.col("_held"), RULES)), lambda s: F.struct((s["start"] - 1).alias("start"), (s["end"] - 1).alias("end"), s["label"].alias("label"), s["score"].alias("score"))))
        return F.struct(F.sort_array(base_places(words)).cast(base_kind).alias("base"), left.alias("detections"))

    words = F.regexp_extract_all(F.translate(F.col("_text"), UPPER, LOWER), F.lit(WORD), F.lit(0))
    nothing = F.struct(F.array().cast(base_kind).alias("base"), F.array().cast(kind).alias("detections"))
    # all non-ASCII characters are in words and lower-casing them leaves them there, so these are as many, and equal where they are ASCII
    low = docs.select(key, whole.alias("_text"), F.regexp_extract_all(F.lower(whole), F.lit(WORD), F.lit(0)).alias("_low"))
    held = low.select(key, "_text", F.size("_low").cast("long").alias("n_words"), F.array_intersect("_low", _texts(gate_words(RULES))).alias("_held"))
    seen = held.select(key, "n_words", F.when(gated(F.col("_held"), RULES), let(words, look)).otherwise(nothing).alias("_seen"))
    return seen.select(key, "n_words", F.col("_seen.base").alias("base"), F.col("_seen.detections").alias("detections"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score of each whole text."""
    starts = F.transform("base", lambda b: b["at"])
    labels = F.transform("base", lambda b: b["label"])
    more = F.transform("detections", lambda d: d["label"])
    score = F.greatest(F.when(F.size("base") > 0, 0.9).otherwise(0.0), F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)))
    return find(docs, key, text).select(
        key,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(labels, more))), ",").alias("labels"),
        score.alias("score"),
    )
