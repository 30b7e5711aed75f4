"""License scan by ordered signature rules, as DataFrame operations only.

Rules are regular expressions over a text's words, joined by single spaces. A
rule runs only where its keyword occurs, and none runs where no gate word does,
so a clean text costs one pass. Of overlapping detections the containing one
stays; of equal or partly overlapping ones, the one of higher priority.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is no part of a word: ASCII outside digits and letters.
_APART = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD, GAP = f"[^{_APART}]+", f"[{_APART}]+"
#: Fixed phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: A text without any of these holds no phrase and fits no rule.
GATE = rf"(?i)licen[sc]|copyright|copyleft|spdx|cc(?:{GAP})by|rights(?:{GAP})reserved|public(?:{GAP})domain|creative(?:{GAP})commons|redistribut|warranty|permission|proprietary|(?:released|distributed|available|published|provided)(?:{GAP})under|(?:^|[{_APART}])(?:gnu(?:{GAP})?)?(?:(?:a|l)?gpl|gfdl|fdl|mpl|epl|cddl|eupl|cecill|lppl|wtfpl|odbl|mulanpsl|osl|afl|cpl|qpl|zpl|upl|ecl|efl|busl|bsl|ofl|ms(?:{GAP})[pr]l|cc0|apache|bsd)(?:[v0-9{_APART}]|$)"

#: (label, keyword, words of the name, words of its identifier) of each family.
FAMILIES = (
    ("afl-3.0", "academic", r"academic free license(?: version)?(?: v? ?3(?: 0)?)?", "afl 3 0"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version)?(?: v? ?3(?: 0)?)?", "agpl 3 0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)?(?: v?2(?: 0)?)?", "apache 2 0"),
    ("artistic-1.0", "artistic", r"artistic license(?: version)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)?(?: 2(?: 0)?)?", "artistic 2 0"),
    ("blueoak-1.0.0", "oak", r"blue oak model license(?: 1 0 0)?", "blueoak 1 0 0"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause"),
    ("bsl-1.0", "boost", r"boost software license(?: version)?(?: 1(?: 0)?)?", "bsl 1 0"),
    ("busl-1.1", "business", r"business source license(?: version)?(?: 1 1)?", "busl 1 1"),
    ("cc0-1.0", "cc0", r"(?:creative commons zero|cc0)(?: 1 0)?", "cc0 1 0"),
    ("cddl-1.0", "common", r"common development and distribution license(?: version)?(?: 1(?: 0)?)?", "cddl 1 0"),
    ("cecill-2.1", "cecill", r"cecill(?: version)?(?: 2(?: 1)?)?", "cecill 2 1"),
    ("cpl-1.0", "common", r"common public license(?: version)?(?: 1(?: 0)?)?", "cpl 1 0"),
    ("ecl-2.0", "educational", r"educational community license(?: version)?(?: 2(?: 0)?)?", "ecl 2 0"),
    ("efl-2.0", "eiffel", r"eiffel forum license(?: version)?(?: 2(?: 0)?)?", "efl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version)? v?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version)?(?: v?2(?: 0)?)?", "epl 2 0"),
    ("eupl-1.2", "european", r"european union public licen[sc]e(?: version)?(?: v? ?1 2)?", "eupl 1 2"),
    ("gfdl-1.3", "documentation", r"gnu free documentation license(?: version)?(?: 1 [1-3])?", "gfdl 1 3"),
    ("gpl-2.0", "public", r"(?:gnu )?general public license(?: version)? v?2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "public", r"(?:gnu )?general public license(?: version)? v?3(?: 0)?", "gpl 3 0"),
    ("hpnd", "historical", r"historical permission notice and disclaimer", "hpnd"),
    ("ipl-1.0", "ibm", r"ibm public license(?: version)?(?: 1 0)?", "ipl 1 0"),
    ("isc", "isc", r"isc", "isc"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: version)? v?2(?: 1)?", "lgpl 2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: version)?(?: v?3(?: 0)?)?", "lgpl 3 0"),
    ("lppl-1.3c", "latex", r"latex project public license(?: version)?(?: 1 3c?)?", "lppl 1 3c"),
    ("mit", "mit", r"(?:mit|expat|mit x11)", "mit"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? v?1(?: [01])?", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version)?(?: v?2(?: 0)?)?", "mpl 2 0"),
    ("ms-pl", "microsoft", r"microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", "ms rl"),
    ("mulanpsl-2.0", "mulan", r"mulan permissive software license(?: version)?(?: v?2)?", "mulanpsl 2 0"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source license", "ncsa"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database license(?: version)?(?: v?1 0)?", "odbl 1 0"),
    ("ofl-1.1", "font", r"(?:sil )?open font license(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("osl-3.0", "open", r"open software license(?: version)?(?: v?3(?: 0)?)?", "osl 3 0"),
    ("php-3.01", "php", r"php license(?: version)?(?: 3 01)?", "php 3 01"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("psf-2.0", "python", r"python software foundation license(?: version)?(?: 2)?", "psf 2 0"),
    ("qpl-1.0", "q", r"q public license(?: version)?(?: 1 0)?", "qpl 1 0"),
    ("unlicense", "unlicense", r"unlicense", "unlicense"),
    ("upl-1.0", "universal", r"universal permissive license(?: version)?(?: v? ?1 0)?", "upl 1 0"),
    ("w3c", "w3c", r"w3c software(?: notice)?(?: and)? license", "w3c"),
    ("wtfpl", "want", r"do what the \w+ you want to public license", "wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib"),
    ("zpl-2.1", "zope", r"zope public license(?: version)?(?: 2(?: [01])?)?", "zpl 2 1"),
)

#: (pattern around a name or identifier, priority, confidence).
FORMS = (
    (r"spdx license identifier {id}", 40, 0.99),
    (r"licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?", 30, 0.95),
    (r"(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?", 30, 0.9),
    (r"(?:spdx|opensource) org licenses? {id}", 32, 0.95),
    (r"{name} licen[sc]ed?", 10, 0.6),
)

_LATER = r"(?: or (?:any )?(?:later|newer)(?: version)?| only)?"


def _version(*forms: str) -> str:
    """A version in running text, with what may stand before it: v2, version 2 0, 2."""
    return rf"(?: ?(?:licen[sc]e )?(?:version |ver |v ?)?(?:{'|'.join(forms)}))"


#: (label, keyword, abbreviation with its versions) of running text: gpl v3, gplv3, gpl 3 0 or later, gnu gpl version 2, lgpl 2 1.
SHORT = (
    ("agpl-3.0", "agpl", rf"(?:gnu )?agpl{_version('3 0', '3')}?{_LATER}"),
    ("agpl-3.0", "affero gpl", rf"(?:gnu )?affero gpl{_version('3 0', '3')}?{_LATER}"),
    ("gpl-2.0", "gpl", rf"(?:gnu )?gpl{_version('2 0', '2')}{_LATER}"),
    ("gpl-3.0", "gpl", rf"(?:gnu )?gpl{_version('3 0', '3')}{_LATER}"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lgpl-2.1", "lgpl", rf"(?:gnu )?lgpl{_version('2 1', '2 0', '2')}{_LATER}"),
    ("lgpl-3.0", "lgpl", rf"(?:gnu )?lgpl{_version('3 0', '3')}{_LATER}"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("gfdl-1.3", "fdl", rf"(?:gfdl|gnu fdl){_version('1 [1-3]')}?{_LATER}"),
    ("mpl-1.1", "mpl", rf"mpl{_version('1 [01]', '1')}"),
    ("mpl-2.0", "mpl", rf"mpl{_version('2 0', '2')}?"),
    ("epl-1.0", "epl", rf"epl{_version('1 0', '1')}"),
    ("epl-2.0", "epl", rf"epl{_version('2 0', '2')}?"),
    ("cddl-1.0", "cddl", rf"cddl{_version('1 [01]', '1')}?"),
    ("eupl-1.2", "eupl", rf"eupl{_version('1 [0-2]')}?"),
    ("cecill-2.1", "cecill", rf"cecill{_version('2 [01]', '2')}?"),
    ("lppl-1.3c", "lppl", rf"lppl{_version('1 3[ac]?')}?"),
    ("odbl-1.0", "odbl", rf"odbl{_version('1 0')}?"),
    ("mulanpsl-2.0", "mulanpsl", rf"mulanpsl{_version('2 0', '2')}?"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0-1.0", "cc0", rf"cc0{_version('1 0')}?"),
    ("ms-pl", "ms pl", r"ms pl"),
    ("ms-rl", "ms rl", r"ms rl"),
    ("apache-2.0", "apache", rf"apache{_version('2 0', '2')}"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause|2 clause bsd"),
    ("bsd-3-clause", "bsd", r"bsd 3 clause|3 clause bsd"),
    # These say too little without a version.
    ("afl-3.0", "afl", rf"afl{_version('3 0')}"),
    ("bsl-1.0", "bsl", rf"bsl{_version('1 0')}"),
    ("busl-1.1", "busl", rf"busl{_version('1 1')}"),
    ("cpl-1.0", "cpl", rf"cpl{_version('1 0')}"),
    ("ecl-2.0", "ecl", rf"ecl{_version('2 0')}"),
    ("efl-2.0", "efl", rf"efl{_version('2 0')}"),
    ("ofl-1.1", "ofl", rf"(?:sil )?ofl{_version('1 1')}"),
    ("osl-3.0", "osl", rf"osl{_version('3 0')}"),
    ("qpl-1.0", "qpl", rf"qpl{_version('1 0')}"),
    ("upl-1.0", "upl", rf"upl{_version('1 0')}"),
    ("zpl-2.1", "zpl", rf"zpl{_version('2 [01]')}"),
)
#: (pattern around an abbreviation, priority, confidence); the versions are part of the place, so the longer one stays.
SHORT_FORMS = (
    (r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[sc]e)?", 28, 0.9),
    (r"(?:{name})(?: licen[sc]e)?", 12, 0.6),
)

#: What may stand between a GNU name and its version.
_MID = r"(?: as published by the free software foundation)?(?: either)?"

#: (label, keyword, name in running text with its versions); these names say enough without a word around them.
RUNNING = (
    ("afl-3.0", "academic", rf"academic free licen[sc]e{_version('3 0', '3')}?"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public licen[sc]e(?:{_MID}{_version('3 0', '3')})?{_LATER}"),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[sc]e{_version('1 1')}"),
    ("apache-2.0", "apache", rf"apache(?: software)? licen[sc]e{_version('2 0', '2')}?"),
    ("artistic-1.0", "artistic", rf"artistic licen[sc]e{_version('1 0', '1')}"),
    ("artistic-2.0", "artistic", rf"artistic licen[sc]e{_version('2 0', '2')}"),
    ("blueoak-1.0.0", "oak", rf"blue oak model licen[sc]e{_version('1 0 0', '1')}?"),
    ("bsl-1.0", "boost", rf"boost software licen[sc]e{_version('1 0', '1')}?"),
    ("busl-1.1", "business", rf"business source licen[sc]e{_version('1 1')}?"),
    ("cddl-1.0", "common", rf"common development and distribution licen[sc]e(?: cddl)?{_version('1 [01]', '1')}?"),
    ("cpl-1.0", "common", rf"common public licen[sc]e{_version('1 0', '1')}?"),
    ("ecl-2.0", "educational", rf"educational community licen[sc]e{_version('2 0', '2')}?"),
    ("efl-2.0", "eiffel", rf"eiffel forum licen[sc]e{_version('2 0', '2')}?"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[sc]e{_version('1 0', '1')}"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[sc]e{_version('2 0', '2')}?"),
    ("eupl-1.2", "european", rf"european union public licen[sc]e(?: eupl)?{_version('1 [0-2]')}?"),
    ("gfdl-1.3", "documentation", rf"(?:gnu )?free documentation licen[sc]e{_version('1 [1-3]')}?{_LATER}"),
    ("gpl-2.0", "public", rf"(?:gnu )?general public licen[sc]e(?: gpl)?{_MID}{_version('2 0', '2')}{_LATER}"),
    ("gpl-3.0", "public", rf"(?:gnu )?general public licen[sc]e(?: gpl)?{_MID}{_version('3 0', '3')}{_LATER}"),
    ("ipl-1.0", "ibm", rf"ibm public licen[sc]e{_version('1 0', '1')}?"),
    ("lgpl-2.1", "public", rf"(?:gnu )?(?:lesser|library) general public licen[sc]e(?: lgpl)?{_MID}{_version('2 1', '2 0', '2')}{_LATER}"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public licen[sc]e(?: lgpl)?{_MID}{_version('3 0', '3')}{_LATER}"),
    ("lgpl", "public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lppl-1.3c", "latex", rf"latex project public licen[sc]e{_version('1 3[ac]?')}?"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[sc]e{_version('1 [01]', '1')}"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[sc]e{_version('2 0', '2')}?"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("mulanpsl-2.0", "mulan", rf"mulan permissive software licen[sc]e{_version('2 0', '2')}?"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source licen[sc]e"),
    ("odbl-1.0", "database", rf"open (?:data commons open )?database licen[sc]e{_version('1 0')}?"),
    ("ofl-1.1", "font", rf"(?:sil )?open font licen[sc]e{_version('1 1')}?"),
    ("osl-3.0", "open", rf"open software licen[sc]e{_version('3 0', '3')}"),
    ("php-3.01", "php", rf"php licen[sc]e{_version('3 01')}"),
    ("psf-2.0", "python", rf"python software foundation licen[sc]e{_version('2')}?"),
    ("qpl-1.0", "q public", rf"q public licen[sc]e{_version('1 0')}?"),
    ("upl-1.0", "universal", rf"universal permissive licen[sc]e{_version('1 0')}?"),
    ("w3c", "w3c", r"w3c software(?: notice)?(?: and)?(?: document)? licen[sc]e"),
    ("zpl-2.1", "zope", rf"zope public licen[sc]e{_version('2 [01]', '2')}?"),
)
#: Priority and confidence of a name in running text.
RUNNING_RANK = (20, 0.8)

#: Parts of a Creative Commons license after attribution: (short, long).
CC_PARTS = (("nc", "non ?commercial"), ("nd", "no ?deriv(?:ative)?s?(?: works?)?"), ("sa", "share ?alike"))
CC_KINDS = ((), ("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def creative_commons() -> list[tuple[str, str, str, int, float]]:
    """Rules of each kind and version by its parts: long name, short name, address. Without a version the newest is meant."""
    long, made = dict(CC_PARTS), []
    for kind in CC_KINDS:
        short = " ".join(("by", *kind))
        name = "creative commons attribution" + "".join(f" {long[p]}" for p in kind)
        for version in CC_VERSIONS:
            label, number = f"cc-{short.replace(' ', '-')}-{version}", version.replace(".", " ")
            newest = "?" if version == CC_VERSIONS[-1] else ""
            place = r"(?: (?:international|unported|generic|intl))?"
            after = rf"{place}(?: {number}){newest}{place}(?: public)?(?: licen[sc]e)?"
            lead = r"(?:(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the |an? )?(?:terms of (?:the )?)?)?"
            made += [
                (label, "creative commons", rf"{lead}(?:a )?{name}{after}", 26, 0.9),
                # A short name alone is a fixed phrase; with a part, a version or a lead it says more.
                (label, "cc by", rf"{lead}cc {short}(?: {number}){newest if kind else ''}{place}(?: licen[sc]e)?", 26, 0.9),
                (label, "creativecommons", rf"creativecommons org licenses {short} {number}", 32, 0.95),
                (label, "spdx", rf"spdx license identifier cc {short} {number}", 40, 0.99),
            ]
        made.append((f"cc-{short.replace(' ', '-')}-{CC_VERSIONS[-1]}", "cc by", rf"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the )?)?cc {short}(?: licen[sc]e)?", 26, 0.9))
    return made


#: Signatures that stand for no family: (label, keyword, pattern, priority, confidence).
NOTICES = (
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}", 5, 0.4),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 35, 0.95),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 35, 0.9),
    ("bsd-3-clause", "redistribution", r"redistribution and use in source and binary forms with or without modification", 25, 0.8),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of", 25, 0.8),
    ("public-domain", "domain", r"(?:dedicated to|released into|placed in|in) the public domain", 15, 0.7),
    ("proprietary", "proprietary", r"proprietary and confidential", 15, 0.7),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license", 25, 0.8),
    ("apache-2.0", "apache", r"apache org licenses license 2 0", 32, 0.95),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 35, 0.99),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 35, 0.99),
    ("epl-1.0", "eclipse", r"made available under the terms of the eclipse public license (?:version |v ?)1 0", 35, 0.95),
    ("epl-2.0", "eclipse", r"made available under the terms of the eclipse public license (?:version |v ?)?2 0", 35, 0.95),
    ("bsl-1.0", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 35, 0.95),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software", 35, 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 35, 0.95),
    ("isc", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 35, 0.9),
    ("postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 35, 0.95),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission", 25, 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 35, 0.95),
    ("gpl-2.0", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it", 25, 0.9),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 35, 0.95),
    ("agpl-3.0", "copyleft", r"the gnu affero general public license is a free copyleft license for software and other kinds of works", 35, 0.95),
    ("lgpl-3.0", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 35, 0.95),
    ("cddl-1.0", "common", r"the contents of this file are subject to the terms of the common development and distribution license", 35, 0.95),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1", 35, 0.99),
    ("cc0-1.0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain", 35, 0.95),
    ("artistic-2.0", "copyright", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 35, 0.95),
    ("wtfpl", "want", r"you just do what the \w+ you want to", 35, 0.95),
    ("no-warranty", "warranty", r"without warranty of any kind", 5, 0.3),
    ("gpl", "public", r"(?:gnu )?general public license", 15, 0.7),
    ("cc", "creative", r"creative commons", 5, 0.4),
)


def _id_keyword(form: str, keyword: str) -> str:
    """The keyword of a rule: the family's where its name stands in the form, else what goes with an identifier."""
    if "{name}" in form:
        return keyword
    return "spdx license" if form.startswith("spdx") else " org license"


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, regular expression, priority, confidence) of every rule, in order."""
    made = [
        (label, _id_keyword(form, keyword), form.format(name=name, id=short), priority, sure)
        for label, keyword, name, short in FAMILIES
        for form, priority, sure in FORMS
    ]
    short = [(label, keyword, form.format(name=name), priority - (label in ("gpl", "lgpl")), sure) for label, keyword, name in SHORT for form, priority, sure in SHORT_FORMS]
    running = [(label, keyword, name, *RUNNING_RANK) for label, keyword, name in RUNNING]
    return [(label, keyword, f"(?<= )(?:{pattern})(?= )", priority, sure) for label, keyword, pattern, priority, sure in [*made, *short, *running, *creative_commons(), *NOTICES]]


_RULES = "array<struct<keyword:string,rules:array<struct<label:string,pattern:string,priority:int,sure:double>>>>"


def _rules_by_keyword() -> Column:
    """(keyword, rules): a text is searched once for each keyword, whatever the number of its rules."""
    grouped: dict[str, list[dict]] = {}
    for label, keyword, pattern, priority, sure in rules():
        grouped.setdefault(keyword, []).append({"label": label, "pattern": pattern, "priority": priority, "sure": sure})
    # One literal, which the optimizer folds to a constant.
    return F.from_json(F.lit(json.dumps([{"keyword": k, "rules": mine} for k, mine in grouped.items()])), _RULES)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _found(norm: Column, rule: Column) -> Column:
    """Detections of one rule: start and end in code points."""
    pieces, hits = F.split(norm, rule.pattern, -1), F.regexp_extract_all(norm, rule.pattern, F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc.at + F.length(pair["0"])
        end = start + F.length(pair["1"])
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    spans = F.aggregate(F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("0"), hits.alias("1")), begin, step, lambda acc: acc.out)
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), (-rule.priority).alias("rank"), rule.label.alias("label"), rule.sure.alias("sure")))


def _resolve(found: Column) -> Column:
    """What stays of detections sorted by start, longest first, then priority."""
    kind = "array<struct<start:int,back:int,rank:int,label:string,sure:double>>"

    def step(acc: Column, d: Column) -> Column:
        last = F.element_at(acc, -1)
        apart = (F.size(acc) == 0) | (d.start >= -last.back)
        inside = d.back >= last.back
        return (
            F.when(apart, F.concat(acc, F.array(d)))
            .when(inside | (d.rank >= last.rank), acc)
            .otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(d)))
        )

    return F.aggregate(F.array_sort(found), F.array().cast(kind), step)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, detections. ``n_base`` counts all places where the words of a fixed
    phrase stand in a row; ``first_word`` and ``last_word`` are their smallest
    and largest start. ``detections`` (label, start, end, sure) are code points
    of the words joined by single spaces, with one before. ``score`` is one
    less the product of all detections' doubt; a phrase counts as half sure.

    Nothing is shuffled: a row's result comes from its own text, so repeated
    rows give repeated results. A null or empty text has no words, null places,
    empty labels and score 0. Only A-Z is lowered. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lowered = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, GAP, " ")), F.lit(" "))
    out = docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"), F.when(F.col("t").rlike(GATE), norm).alias("norm")
    )
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        parts = F.split("norm", f"(?<= ){phrase}(?= )", -1)
        count = F.when(F.contains("norm", F.lit(f" {phrase} ")), F.size(parts) - 1).otherwise(0)
        places.append(F.coalesce(count, F.lit(0)).cast("long"))
        firsts.append(F.when(count > 0, _spaces(parts[0]) - 1))
        lasts.append(F.when(count > 0, F.col("n_words") - (_spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())))
        labels.append(F.when(count > 0, F.lit(label)))
    fitting = F.flatten(F.transform(F.filter(_rules_by_keyword(), lambda g: F.contains(F.col("norm"), g.keyword)), lambda g: g.rules))
    found = F.flatten(F.transform(fitting, lambda r: _found(F.col("norm"), r)))
    kept = F.when(F.col("norm").isNotNull(), _resolve(found))
    out = out.select(
        "doc_id", "n_words", sum(places[1:], places[0]).alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"), F.coalesce(kept, F.array()).alias("kept"),
    )
    doubt = F.aggregate("kept", F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(1.0), lambda acc, d: acc * (1 - d.sure))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("kept", lambda d: d.label))), ",").alias("labels"),
        F.round(1 - doubt, 6).alias("score"),
        F.transform("kept", lambda d: F.struct(d.label.alias("label"), d.start.alias("start"), (-d.back).alias("end"), d.sure.alias("sure"))).alias("detections"),
    )
