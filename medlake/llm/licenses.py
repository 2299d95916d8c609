"""License scans with ordered signature rules.

A text is reduced to its words (ASCII letters lower-cased, digits, non-ASCII
characters), joined by single spaces; a rule is a regex over that string, so
its detections are intervals of words.  Every license family contributes its
names and its own wordings, every name goes through the sentence frames in
``FRAMES``: some hundreds of rules in all, compiled on first use.  SPDX short
identifiers ("MIT", "Apache-2.0") say nothing outside an SPDX line, so they have
rules of their own there, for each operand of an expression; elsewhere the common
ones count where a sentence declares them ("License: MIT", "MIT licensed").

* Keyword prefilter: a cheap test of the raw text for the few stems without
  which no rule can match, then a rule runs only if all of its keywords (the
  words that all strings its pattern can match have in common) are among the
  text's words.
* Order: rules have priorities (exact grants and identifiers over names).  A
  detection whose interval lies inside one of higher priority, or of equal
  priority and greater length, is suppressed, so that "gnu lesser general
  public license version 3" is not also a GPL.  Base phrases are never
  suppressed.
* The score is the probability that at least one detection is right, from the
  weights of the kept rules.

Results for odd input: null and wordless texts have no words, places or labels
(empty strings) and score 0; repeated rows get equal results; a null id stays
null.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import filled, lower_bytes, text_slices, word_bounds

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Names (regexes over words) by label; the first word group is required.
FAMILIES: dict[str, tuple[str, ...]] = {
    "mit": ("mit licen[cs]e", "expat licen[cs]e", "mit x11 licen[cs]e"),
    "apache-1": ("apache (software )?licen[cs]e (version |v ?)?1( [01])?",),
    "apache-2": ("apache (software )?licen[cs]e (version |v ?)?2( 0)?", "apache v?2( 0)? licen[cs]e"),
    "apache": ("apache (software )?licen[cs]e",),
    "bsd": ("bsd( style)? licen[cs]e",),
    "bsd-2": ("(simplified|freebsd|2 clause|two clause) bsd licen[cs]e", "bsd 2 clause( licen[cs]e)?"),
    "bsd-3": ("(new|modified|revised|3 clause|three clause) bsd licen[cs]e", "bsd 3 clause( licen[cs]e)?"),
    "bsd-4": ("(original|4 clause|four clause) bsd licen[cs]e", "bsd 4 clause( licen[cs]e)?"),
    "0bsd": ("zero clause bsd( licen[cs]e)?", "0bsd( licen[cs]e)?"),
    "isc": ("isc licen[cs]e", "internet systems consortium licen[cs]e"),
    "zlib": ("zlib licen[cs]e", "zlib libpng licen[cs]e"),
    "gpl": ("(gnu )?general public licen[cs]e", "(gnu )?gpl"),
    "lgpl": ("(gnu )?(lesser|library) general public licen[cs]e", "(gnu )?lgpl"),
    "agpl": ("(gnu )?affero general public licen[cs]e", "(gnu )?agpl"),
    "mpl": ("mozilla public licen[cs]e",),
    "epl": ("eclipse public licen[cs]e",),
    "gpl-2": ("(gnu )?general public licen[cs]e (version |v ?)?2( 0)?", "(gnu )?gpl ?(version |v ?)?2( 0)?"),
    "gpl-3": ("(gnu )?general public licen[cs]e (version |v ?)?3( 0)?", "(gnu )?gpl ?(version |v ?)?3( 0)?"),
    "lgpl-2": ("(gnu )?(lesser|library) general public licen[cs]e (version |v ?)?2( [01])?", "(gnu )?lgpl ?(version |v ?)?2( [01])?"),
    "lgpl-3": ("(gnu )?lesser general public licen[cs]e (version |v ?)?3( 0)?", "(gnu )?lgpl ?(version |v ?)?3( 0)?"),
    "agpl-3": ("(gnu )?affero general public licen[cs]e (version |v ?)?3( 0)?", "(gnu )?agpl ?(version |v ?)?3( 0)?"),
    "gfdl": ("gnu free documentation licen[cs]e( version 1 [1-3])?", "gfdl"),
    "mpl-1": ("mozilla public licen[cs]e (version |v ?)?1( [01])?", "mpl ?v?1 [01]"),
    "mpl-2": ("mozilla public licen[cs]e (version |v ?)?2( 0)?", "mpl ?v?2( 0)?"),
    "epl-1": ("eclipse public licen[cs]e (version |v ?)?1( 0)?", "epl ?v?1( 0)?"),
    "epl-2": ("eclipse public licen[cs]e (version |v ?)?2( 0)?", "epl ?v?2( 0)?"),
    "cddl-1": ("common development and distribution licen[cs]e", "cddl( 1 0)?"),
    "eupl": ("european union public licen[cs]e( version)?( 1 [0-2])?", "eupl( v?1 [0-2])?"),
    "artistic-1": ("artistic licen[cs]e 1( 0)?",),
    "artistic-2": ("artistic licen[cs]e 2( 0)?",),
    "bsl-1": ("boost software licen[cs]e( version)?( 1 0)?",),
    "wtfpl": ("do what the fuck you want to public licen[cs]e", "wtfpl"),
    "unlicense": ("unlicense",),
    "cc0": ("cc0( 1 0)?", "creative commons zero", "cc zero"),
    "cc-by": ("cc by [1-4] [05]", "creative commons attribution( [1-4] [05])?( international| unported)?( public)? licen[cs]e"),
    "cc-by-sa": ("cc by sa( [1-4] [05])?", "creative commons attribution share ?alike( [1-4] [05])?"),
    "cc-by-nd": ("cc by nd( [1-4] [05])?", "creative commons attribution no ?deriv(s|atives|ative works)( [1-4] [05])?"),
    "cc-by-nc": ("cc by nc( [1-4] [05])?", "creative commons attribution non ?commercial( [1-4] [05])?"),
    "cc-by-nc-sa": ("cc by nc sa( [1-4] [05])?", "creative commons attribution non ?commercial share ?alike( [1-4] [05])?"),
    "cc-by-nc-nd": ("cc by nc nd( [1-4] [05])?", "creative commons attribution non ?commercial no ?deriv(s|atives|ative works)( [1-4] [05])?"),
    "odbl": ("open (data commons open )?database licen[cs]e( 1 0)?", "odbl"),
    "odc-by": ("open data commons attribution licen[cs]e", "odc by( 1 0)?"),
    "pddl": ("public domain dedication and licen[cs]e", "pddl"),
    "ofl": ("(sil )?open font licen[cs]e( version)?( 1 [01])?",),
    "python-2": ("python software foundation licen[cs]e( version 2)?", "psf licen[cs]e"),
    "php-3": ("php licen[cs]e( version)? 3( 0| 01)?",),
    "ruby": ("ruby licen[cs]e",),
    "w3c": ("w3c software (notice and )?licen[cs]e",),
    "postgresql": ("postgresql licen[cs]e",),
    "openssl": ("openssl licen[cs]e",),
    "curl": ("curl licen[cs]e",),
    "ncsa": ("(university of illinois )?ncsa open source licen[cs]e",),
    "ms-pl": ("microsoft public licen[cs]e",),
    "ms-rl": ("microsoft reciprocal licen[cs]e",),
    "upl": ("universal permissive licen[cs]e( version 1 0)?",),
    "afl-3": ("academic free licen[cs]e( version)?( 3 0)?",),
    "osl-3": ("open software licen[cs]e( version)?( 3 0)?",),
    "cecill": ("cecill( [abc])?( licen[cs]e)?( version)?( 2( [01])?)?",),
    "sspl": ("server side public licen[cs]e( version 1)?",),
    "busl": ("business source licen[cs]e( 1 1)?",),
    "elastic-2": ("elastic licen[cs]e( 2 0)?",),
    "commons-clause": ("commons clause licen[cs]e condition",),
    "rail": ("(open)?rail( m)? licen[cs]e", "responsible ai licen[cs]e"),
    "llama": ("llama [23]( [0-9])? community licen[cs]e",),
    "public-domain": ("(released|dedicated|placed) (in|to|into) the public domain", "this work is in the public domain"),
    "proprietary": ("all rights reserved", "proprietary and confidential", "unauthorized copying of this file"),
}
#: SPDX short identifiers by label, as words; families without one have a LicenseRef.
SPDX: dict[str, tuple[str, ...]] = {
    "mit": ("mit",),
    "apache": ("licenseref apache",),
    "bsd": ("licenseref bsd",),
    "gpl": ("licenseref gpl",),
    "lgpl": ("licenseref lgpl",),
    "agpl": ("licenseref agpl",),
    "mpl": ("licenseref mpl",),
    "epl": ("licenseref epl",),
    "apache-1": ("apache 1 [01]",),
    "apache-2": ("apache 2 0",),
    "bsd-2": ("bsd 2 clause",),
    "bsd-3": ("bsd 3 clause",),
    "bsd-4": ("bsd 4 clause",),
    "0bsd": ("0bsd",),
    "isc": ("isc",),
    "zlib": ("zlib",),
    "gpl-2": ("gpl 2 0( only| or later)?",),
    "gpl-3": ("gpl 3 0( only| or later)?",),
    "lgpl-2": ("lgpl 2 [01]( only| or later)?",),
    "lgpl-3": ("lgpl 3 0( only| or later)?",),
    "agpl-3": ("agpl 3 0( only| or later)?",),
    "gfdl": ("gfdl 1 [1-3]( no)?( invariants)?( only| or later)?",),
    "mpl-1": ("mpl 1 [01]",),
    "mpl-2": ("mpl 2 0",),
    "epl-1": ("epl 1 0",),
    "epl-2": ("epl 2 0",),
    "cddl-1": ("cddl 1 [01]",),
    "eupl": ("eupl 1 [0-2]",),
    "artistic-1": ("artistic 1 0",),
    "artistic-2": ("artistic 2 0",),
    "bsl-1": ("bsl 1 0",),
    "wtfpl": ("wtfpl",),
    "unlicense": ("unlicense",),
    "cc0": ("cc0 1 0",),
    "cc-by": ("cc by [1-4] [05]",),
    "cc-by-sa": ("cc by sa [1-4] [05]",),
    "cc-by-nd": ("cc by nd [1-4] [05]",),
    "cc-by-nc": ("cc by nc [1-4] [05]",),
    "cc-by-nc-sa": ("cc by nc sa [1-4] [05]",),
    "cc-by-nc-nd": ("cc by nc nd [1-4] [05]",),
    "odbl": ("odbl 1 0",),
    "odc-by": ("odc by 1 0",),
    "pddl": ("pddl 1 0",),
    "ofl": ("ofl 1 [01]( no)?( rfn)?",),
    "python-2": ("python 2 0( 1)?", "psf 2 0"),
    "php-3": ("php 3 (0|01)",),
    "ruby": ("ruby",),
    "w3c": ("w3c( 19980720| 20150513)?",),
    "postgresql": ("postgresql",),
    "openssl": ("openssl( standalone)?",),
    "curl": ("curl",),
    "ncsa": ("ncsa",),
    "ms-pl": ("ms pl",),
    "ms-rl": ("ms rl",),
    "upl": ("upl 1 0",),
    "afl-3": ("afl 3 0",),
    "osl-3": ("osl 3 0",),
    "cecill": ("cecill (1|2) [01]", "cecill [bc]"),
    "sspl": ("sspl 1 0",),
    "busl": ("busl 1 1",),
    "elastic-2": ("elastic 2 0",),
    "commons-clause": ("licenseref commons clause",),
    "rail": ("licenseref (open)?rail( m)?",),
    "llama": ("licenseref llama [23]( [0-9])?",),
    "public-domain": ("licenseref public domain",),
    "proprietary": ("licenseref (proprietary|all rights reserved)",),
}
SPDX_LINE = "spdx licen[cs]e identifier "
#: (priority, weight, sentence around a name).
FRAMES = (
    (60, 0.98, SPDX_LINE + "{}"),
    (50, 0.95, "licen[cs]ed under (the )?(terms of )?(the )?{}"),
    (50, 0.95, "(released|distributed|published|available|provided) under (the )?(terms of )?(the )?{}"),
    (40, 0.9, "under the (terms|conditions) (and conditions )?of (the )?{}"),
    (40, 0.85, "subject to (the )?(terms of )?(the )?{}"),
    (20, 0.7, "{}"),
)
#: What is declared by a short name alone, where the words around say that it is one
#: ("License: MIT"); identifiers that are ordinary words only count in an SPDX line.
DECLARED: dict[str, tuple[str, ...]] = {
    "mit": ("mit", "expat"),
    "apache-2": ("apache ?v?2( 0)?", "asl ?2( 0)?"),
    "apache": ("apache",),
    "bsd": ("bsd",),
    "bsd-2": ("bsd 2( clause)?", "2 clause bsd"),
    "bsd-3": ("bsd 3( clause)?", "3 clause bsd"),
    "0bsd": ("0bsd",),
    "isc": ("isc",),
    "zlib": ("zlib",),
    "mpl": ("mpl",),
    "epl": ("epl",),
    "bsl-1": ("bsl 1 0", "boost"),
    "ofl": ("ofl( 1 [01])?",),
    "artistic-2": ("artistic 2 0",),
    "ncsa": ("ncsa",),
    "cc0": ("cc0",),
    "cc-by": ("cc by( [1-4] [05])?",),
    "postgresql": ("postgresql",),
}
#: (priority, weight, sentence around a short name).
DECLARING = (
    (30, 0.85, "licen[cs]e (type |name )?(is )?(the )?{}"),
    (30, 0.85, "{} licen[cs]ed"),
    (30, 0.85, "licen[cs]ed (as|under) (the )?(terms of )?(the )?{}"),
    (30, 0.8, "(released|distributed|published|available|provided) under (the )?{}"),
)
#: Wordings of the texts themselves: (label, priority, weight, regex).
GRANTS = (
    ("mit", 55, 0.97, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 45, 0.7, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 35, 0.6, "the software is provided as is without warranty of any kind express or implied"),
    ("isc", 55, 0.95, "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 45, 0.7, "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd", 30, 0.7, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 30, 0.6, "this software is provided by the (copyright holders|author|regents)( and contributors)? as is"),
    ("bsd-3", 55, 0.9, "neither the name of .{1,80}? nor the names of (its|the) contributors"),
    ("bsd-2", 45, 0.8, "redistributions of source code must retain the above copyright notice"),
    ("bsd-2", 35, 0.7, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-4", 55, 0.9, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("gpl-3", 55, 0.9, "(under the terms of the )?(gnu general public license as published by the free software foundation )?either version 3 of the license or at your option any later version"),
    ("gpl-2", 55, 0.9, "(under the terms of the )?(gnu general public license as published by the free software foundation )?either version 2 of the license or at your option any later version"),
    ("gpl-2", 56, 0.9, "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3", 56, 0.9, "under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("lgpl-3", 57, 0.92, "(under the terms of the )?gnu lesser general public license as published by the free software foundation either version 3 of the license( or at your option any later version)?"),
    ("lgpl-2", 57, 0.92, "(under the terms of the )?gnu (lesser|library) general public license as published by the free software foundation either version 2( 1)? of the license( or at your option any later version)?"),
    ("agpl-3", 57, 0.92, "(under the terms of the )?gnu affero general public license as published by the free software foundation either version 3 of the license( or at your option any later version)?"),
    ("gpl", 30, 0.7, "you should have received a copy of the gnu general public license"),
    ("lgpl", 30, 0.7, "you should have received a copy of the gnu (lesser|library) general public license"),
    ("agpl", 30, 0.7, "you should have received a copy of the gnu affero general public license"),
    ("gpl", 30, 0.7, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gfdl", 55, 0.95, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", 55, 0.95, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1", 55, 0.95, "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("epl-1", 55, 0.95, "made available under the terms of the eclipse public license v ?1 0"),
    ("epl-2", 55, 0.95, "made available under the terms of the eclipse public license (v ?)?2 0"),
    ("cddl-1", 55, 0.95, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", 55, 0.95, "this is free and unencumbered software released into the public domain"),
    ("zlib", 55, 0.9, "altered source versions must be plainly marked as such"),
    ("zlib", 45, 0.8, "the origin of this software must not be misrepresented"),
    ("apache-2", 55, 0.95, "you may not use this file except in compliance with the license"),
    ("apache-2", 45, 0.8, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-1", 55, 0.9, "this product includes software developed by the apache (software foundation|group)"),
    ("bsl-1", 55, 0.95, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ofl", 55, 0.95, "this font software is licensed under the sil open font license version 1 [01]"),
    ("ofl", 45, 0.85, "the font software may be sold as part of a larger software package but"),
    ("artistic-2", 55, 0.9, "this is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("wtfpl", 55, 0.95, "you just do what the fuck you want to"),
    ("cc0", 55, 0.95, "to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights"),
    ("cc-by", 55, 0.9, "this work is licensed under a creative commons attribution [1-4] [05] (international|unported|generic) licen[cs]e"),
    ("cc-by-sa", 55, 0.9, "this work is licensed under a creative commons attribution share ?alike [1-4] [05] (international|unported|generic) licen[cs]e"),
    ("postgresql", 55, 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", 55, 0.9, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("python-2", 55, 0.9, "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", 55, 0.9, "this product includes software developed by the openssl project"),
    ("public-domain", 45, 0.8, "the authors? disclaims? copyright to this source code"),
    ("public-domain", 45, 0.8, "(has been|is hereby) (placed|released) in the public domain"),
    ("busl", 55, 0.9, "use of this software is governed by the business source license"),
    ("commons-clause", 55, 0.9, "the software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("elastic-2", 55, 0.9, "you may not provide the software to third parties as a hosted or managed service"),
    ("proprietary", 45, 0.8, "no part of this (work|document|publication|software) may be reproduced"),
    ("proprietary", 45, 0.8, "this software contains (confidential|proprietary)( and proprietary| and confidential)? information"),
)
#: No rule and no base phrase can match a text without one of these.
STEMS = ("licen", "cc", "spdx", "domain", "copyright", "gpl", "mpl", "epl", "cddl", "eupl", "bsd", "wtfpl", "creative", "gfdl",
         "odbl", "odc", "pddl", "cecill", "rights", "proprietary", "unauthorized", "permission", "redistribution", "contributors",
         "version", "altered", "apache", "warrant", "provided", "reproduced", "fuck", "hosted",
         "misrepresented", "confidential", "package", "openssl", "advertising")
#: The one declaring sentence that holds none of them.
UNDER = re.compile(r"(?:released|distributed|published|available|provided)[\x00-\x2F\x3A-\x60\x7B-\x7F]+under")


def may_match(text: str) -> bool:
    """The cheap test before any rule: False only where nothing can match."""
    low = text.lower()
    return any(s in low for s in STEMS) or bool(UNDER.search(low))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    regex: re.Pattern
    keywords: tuple[str, ...]


def choices(pattern: str) -> list[str]:
    """The strings a pattern of literals, groups, classes and ``?`` matches; a
    free stretch (``.{1,80}?``) stands as two strings without a common word."""
    at = 0

    def branch() -> list[str]:
        nonlocal at
        done, now = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            c = pattern[at]
            if c == "|":
                at += 1
                done, now = done + now, [""]
                continue
            if c == "(":
                at += 1
                part = branch()
                at += 1
            elif c == "[":
                stop = pattern.index("]", at)
                inside = pattern[at + 1:stop]
                part = [chr(i) for i in range(ord(inside[0]), ord(inside[2]) + 1)] if inside[1] == "-" else list(inside)
                at = stop + 1
            elif pattern.startswith(".{1,80}?", at):
                part = ["x", "y z"]
                at += 8
            else:
                part = [c]
                at += 1
            if pattern.startswith("?", at):
                part = [*part, ""]
                at += 1
            now = [x + y for x in now for y in part]
        return done + now

    return branch()


@cache
def _keywords(pattern: str) -> tuple[str, ...]:
    """Plain words every match must hold: those common to all its choices."""
    common = set.intersection(*[set(c.split()) for c in choices(pattern)])
    return tuple(sorted(w for w in common if len(w) > 1))


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    out = []
    for label, names in FAMILIES.items():
        for name in names:
            for priority, weight, frame in FRAMES:
                pattern = frame.format(f"(?:{name})") if frame != "{}" else name
                # every frame ends its own words before the name
                out.append(Rule(label, priority, weight, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"),
                                _keywords(frame.replace("{}", "")) + _keywords(name)))
    some = "|".join(name for names in SPDX.values() for name in names)
    before = rf"(?:(?:{some})(?: with( [^ ]+){{1,5}}?)? (?:and|or) )+"
    priority, weight, _ = FRAMES[0]
    for label, names in SPDX.items():
        for name in names:
            for pattern in (f"{SPDX_LINE}(?:{name})", f"{SPDX_LINE}{before}(?P<id>{name})"):
                out.append(Rule(label, priority, weight, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"),
                                _keywords(SPDX_LINE) + _keywords(name)))
    for label, names in DECLARED.items():
        for name in names:
            for priority, weight, frame in DECLARING:
                out.append(Rule(label, priority, weight, re.compile(rf"(?<![^ ])(?:{frame.format(f'(?:{name})')})(?![^ ])"),
                                _keywords(frame.replace("{}", "")) + _keywords(name)))
    declared = "|".join(name for names in DECLARED.values() for name in names)
    for label, names in DECLARED.items():       # the later ones of "License: MIT or Apache-2.0"
        for name in names:
            pattern = rf"licen[cs]e (?:(?:{declared}) (?:and |or )?)+(?P<id>{name})"
            out.append(Rule(label, DECLARING[0][0], DECLARING[0][1], re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), _keywords(name)))
    for label, priority, weight, pattern in GRANTS:
        out.append(Rule(label, priority, weight, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), _keywords(pattern)))
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.regex.pattern)))


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = {i: i + 32 for i in range(65, 91)}


@dataclass
class Found:
    base: list[tuple[int, int, str]]
    kept: list[tuple[int, int, str, float]]


def suppress(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Drop every (priority, start, stop, label, weight) contained in a better
    one: sorted by priority and length, so a kept one is never beaten later."""
    kept: list[tuple[int, int, int, str, float]] = []
    for d in sorted(set(found), key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        if not any(k[1] <= d[1] and d[2] <= k[2] and (k[0] > d[0] or k[2] - k[1] > d[2] - d[1]) for k in kept):
            kept.append(d)
    return [(a, b, label, w) for _, a, b, label, w in sorted(kept, key=lambda d: (d[1], d[2], d[3]))]


def detect(text: str) -> Found:
    """Base places and kept detections of one text, as word intervals."""
    words = _WORD.findall(text.translate(_LOW))
    line, have = " ".join(words), set(words)

    def spans(regex: re.Pattern) -> Iterator[tuple[int, int]]:
        at = at_word = 0
        part = "id" if "id" in regex.groupindex else 0
        for m in regex.finditer(line):
            at_word += line.count(" ", at, m.start(part))
            at = m.start(part)
            yield at_word, at_word + m[part].count(" ") + 1

    base = []
    for phrase, label in BASE:
        if all(w in have for w in phrase.split()):
            base += [(a, b, label) for a, b in spans(re.compile(rf"(?<![^ ]){phrase}(?![^ ])"))]
    found = [(r.priority, a, b, r.label, r.weight) for r in rules() if all(k in have for k in r.keywords) for a, b in spans(r.regex)]
    return Found(sorted(base), suppress(found))


_SCHEMA = ("_id long, n_words long, base array<struct<start:bigint,stop:bigint,label:string>>, "
           "kept array<struct<start:bigint,stop:bigint,label:string,weight:double>>")
_BASE_T = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))
_KEPT_T = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = filled(batch.column("_text"))
        for lo, hi, data, offs in text_slices(texts):
            row = word_bounds(lower_bytes(data), offs, "alnum")[2]
            base: list[list] = []
            kept: list[list] = []
            for text in texts.slice(lo, hi - lo).to_pylist():
                got = detect(text) if may_match(text) else Found([], [])
                base.append([{"start": a, "stop": b, "label": x} for a, b, x in got.base])
                kept.append([{"start": a, "stop": b, "label": x, "weight": w} for a, b, x, w in got.kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").slice(lo, hi - lo), pa.array(np.bincount(row, minlength=hi - lo), pa.int64()),
                 pa.array(base, _BASE_T), pa.array(kept, _KEPT_T)], names=["_id", "n_words", "base", "kept"])


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _id, n_words, ``base`` places and ``kept`` detections."""
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(_scan, _SCHEMA)


def license_report(docs: DataFrame) -> DataFrame:
    out = find_licenses(docs)

    def labels(*cols: str):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda d: d["label"]) for c in cols]))), ",")
    starts = F.transform("base", lambda d: d["start"])
    wrong = F.aggregate(F.concat(F.transform("base", lambda d: F.lit(0.95)), F.transform("kept", lambda d: d["weight"])),
                        F.lit(1.0), lambda a, w: a * (1 - w))
    return out.select(F.col("_id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
                      F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                      labels("base").alias("base_labels"), labels("base", "kept").alias("labels"), (1 - wrong).alias("score"))
