"""License scan by ordered signature rules behind a keyword gate.

A text is reduced to lower-case words joined by one space, in which the rules' regular expressions are written. Every
rule names a keyword, a beginning of a word that each of its matches holds. One automaton of all keywords runs over
the text, and only the rules whose keyword turned up are searched for; most documents hold none. A detection of a
license's name takes the words before or behind it in ("licensed under the terms of ..."), which raises its priority
and confidence. A detection that lies within another of a higher priority, or of the same priority and greater length,
is suppressed, in one sweep over the detections by their start. Base phrases are counted apart and are never suppressed.

Defined results: null text counts as empty (no words, no labels, score 0); overlapping places all count;
repeated rows are scanned each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, texts_of

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# In the rules: LIC is license or licence, VER an optional word for a version, LATER what may follow one. A group v is the version.
LIC, VER, LATER = r"licen[sc]e", r"(?:v(?:ersion|er)? ?)?", r"(?: (?:only|or (?:any |at your option any )?(?:later|newer|greater)(?: versions?)?))?"
BARE, VERSIONED, NOTICE, SPDX = 10, 12, 45, 50

# Names of licenses as (label, keyword, regular expression over normalised words).
NAMES = (
    ("agpl", "affero", r"(?:gnu )?affero (?:general )?public LIC(?: VER(?P<v>[13])(?: 0)?LATER)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: ?VER(?P<v>[13])(?: 0)?LATER|v\d)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser (?:general )?public LIC(?: VER(?P<v>2 1|[23])(?: 0)?LATER)?"),
    ("lgpl", "library", r"(?:gnu )?library (?:general )?public LIC(?: VER(?P<v>2)(?: 0)?LATER)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: ?VER(?P<v>2 1|[23])(?: 0)?LATER|v\d)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation LIC(?: VER(?P<v>1 [123])LATER)?"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl(?: ?VER(?P<v>1 [123])LATER)?"),
    ("gpl", "general", r"(?:gnu )?general public LIC(?: VER(?P<v>[123])(?: 0)?LATER)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: ?VER(?P<v>[123])(?: 0)?LATER|v\d)?"),
    ("gpl", "gnu", r"gnu public LIC(?: VER(?P<v>[123])(?: 0)?LATER)?"),
    ("classpath-exception", "classpath", r"(?:gnu )?classpath (?:linking )?exception"),
    ("gcc-exception", "runtime", r"gcc runtime library exception(?: VER(?P<v>3 [01]))?"),
    ("apache", "apache", r"apache (?:software )?LIC(?: VER(?P<v>1 0|1 1|2 0|2))?"),
    ("apache", "apache", r"apache VER(?P<v>1 0|1 1|2 0|2)(?: LIC)?"),
    ("apache", "asl", r"asl ?VER(?P<v>1 0|1 1|2 0|2)"),
    ("mit", "mit", r"mit (?:style |type )?LIC"),
    ("mit", "expat", r"expat (?:mit )?LIC"),
    ("mit", "x11", r"x11 (?:mit )?LIC"),
    ("mit", "mit", r"mit (?:x11|expat) (?:style )?LIC"),
    ("mit-0", "mit", r"mit no attribution(?: LIC)?"),
    ("bsd", "bsd", r"bsd (?:style |type )?LIC"),
    ("bsd-0-clause", "0bsd", r"0bsd(?: LIC)?"),
    ("bsd-1-clause", "bsd", r"bsd 1 clause(?: LIC)?|(?:1|one) clause bsd(?: LIC)?"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause(?: LIC)?|(?:2|two) clause bsd(?: LIC)?"),
    ("bsd-2-clause", "simplified", r"simplified bsd(?: LIC)?"),
    ("bsd-2-clause", "freebsd", r"freebsd LIC"),
    ("bsd-3-clause", "bsd", r"bsd 3 clause(?: LIC)?|(?:3|three) clause bsd(?: LIC)?"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised) bsd(?: LIC)?"),
    ("bsd-4-clause", "bsd", r"bsd 4 clause(?: LIC)?|(?:4|four) clause bsd(?: LIC)?"),
    ("bsd-4-clause", "bsd", r"(?:original|old) bsd(?: LIC)?"),
    ("mpl", "mozilla", r"mozilla public LIC(?: VER(?P<v>1 0|1 1|2 0|2))?"),
    ("mpl", "mpl", r"mpl(?: ?VER(?P<v>1 0|1 1|2 0|2))?"),
    ("npl", "netscape", r"netscape public LIC(?: VER(?P<v>1 [01]))?"),
    ("epl", "eclipse", r"eclipse public LIC(?: VER(?P<v>[12] 0|[12]))?"),
    ("epl", "epl", r"epl ?VER(?P<v>[12] 0|[12])"),
    ("edl", "eclipse", r"eclipse distribution LIC(?: VER(?P<v>1 0))?"),
    ("cddl", "cddl", r"cddl(?: ?VER(?P<v>1 [01]))?"),
    ("cddl", "development", r"common development (?:and|amp) distribution LIC(?: VER(?P<v>1 [01]))?"),
    ("cpl", "common", r"common public LIC(?: VER(?P<v>1 0))?"),
    ("cpal", "attribution", r"common public attribution LIC(?: VER(?P<v>1 0))?"),
    ("ibm-pl", "ibm", r"ibm public LIC(?: VER(?P<v>1 0))?"),
    ("eupl", "european", r"european union public LIC(?: VER(?P<v>1 [012]))?"),
    ("eupl", "eupl", r"eupl(?: ?VER(?P<v>1 [012]))?"),
    ("isc", "isc", r"isc (?:style )?LIC"),
    ("isc", "internet", r"internet (?:systems|software) consortium LIC"),
    ("zlib", "zlib", r"zlib(?: libpng)? LIC"),
    ("libpng", "libpng", r"libpng LIC(?: VER(?P<v>2))?"),
    ("boost", "boost", r"boost (?:software )?LIC(?: VER(?P<v>1 0))?"),
    ("artistic", "artistic", r"(?:perl |clarified )?artistic LIC(?: VER(?P<v>[12] 0|[12]))?"),
    ("unlicense", "unlicen", r"(?:the )?unlicen[sc]e(?: LIC)?"),
    ("wtfpl", "wtfpl", r"wtfpl(?: ?VER(?P<v>[12]))?"),
    ("wtfpl", "want", r"do what the f(?:uck)? you want to public LIC(?: VER(?P<v>[12]))?"),
    ("cc0", "cc0", r"(?:creative commons )?cc0(?: VER(?P<v>1 0))?(?: universal)?"),
    ("cc0", "creative", r"creative commons (?:zero|public domain dedication)(?: VER(?P<v>1 0))?(?: universal)?"),
    ("cc-by", "creative", r"creative commons attribution(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?(?: LIC)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?(?: LIC)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?(?: LIC)?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: works?)?(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?(?: LIC)?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?(?: LIC)?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works?)?(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?(?: (?:international|unported|generic))?(?: LIC)?"),
    ("cc-by", "cc", r"cc by(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-sa", "cc", r"cc by sa(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nc", "cc", r"cc by nc(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nd", "cc", r"cc by nd(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: VER(?P<v>1 0|2 0|2 5|3 0|4 0))?"),
    ("psf", "python", r"python software foundation LIC(?: VER(?P<v>2))?"),
    ("python", "python", r"python LIC(?: VER(?P<v>2 0(?: 1)?))?"),
    ("php", "php", r"php LIC(?: VER(?P<v>3 0|3 01))?"),
    ("ruby", "ruby", r"ruby LIC"),
    ("openssl", "openssl", r"openssl LIC"),
    ("ssleay", "ssleay", r"(?:original )?ssleay LIC"),
    ("postgresql", "postgresql", r"postgresql LIC"),
    ("ofl", "font", r"(?:sil )?open font LIC(?: VER(?P<v>1 [01]))?"),
    ("ms-pl", "microsoft", r"microsoft public LIC"),
    ("ms-rl", "microsoft", r"microsoft reciprocal LIC"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database LIC(?: VER(?P<v>1 0))?"),
    ("odc-by", "commons", r"open data commons attribution LIC(?: VER(?P<v>1 0))?"),
    ("pddl", "dedication", r"public domain dedication (?:and|amp) LIC(?: VER(?P<v>1 0))?"),
    ("public-domain", "domain", r"(?:in|into|to) the public domain"),
    ("public-domain", "domain", r"public domain (?:software|work|dedication)"),
    ("academic-free", "academic", r"academic free LIC(?: VER(?P<v>1 [12]|2 [01]|3 0))?"),
    ("osl", "open", r"open software LIC(?: VER(?P<v>1 0|2 0|2 1|3 0))?"),
    ("qpl", "public", r"q public LIC(?: VER(?P<v>1 0))?"),
    ("apsl", "apple", r"apple public source LIC(?: VER(?P<v>1 [012]|2 0))?"),
    ("nasa", "nasa", r"nasa open source agreement(?: VER(?P<v>1 3))?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?LIC"),
    ("intel", "intel", r"intel open source LIC"),
    ("sleepycat", "sleepycat", r"sleepycat LIC"),
    ("vim", "vim", r"vim LIC"),
    ("w3c", "w3c", r"w3c software (?:notice (?:and|amp) )?LIC"),
    ("curl", "curl", r"curl LIC"),
    ("icu", "icu", r"icu LIC"),
    ("unicode", "unicode", r"unicode (?:inc )?LIC(?: agreement)?"),
    ("json", "json", r"json LIC"),
    ("beerware", "beer", r"beer ?ware LIC"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software LIC)(?: ?VER(?P<v>[12]))?"),
    ("cecill", "cecill", r"cecill(?: (?:b|c))?(?: LIC)?(?: VER(?P<v>1 [01]|2 [01]))?"),
    ("sspl", "sspl", r"sspl(?: ?VER(?P<v>1))?"),
    ("sspl", "server", r"server side public LIC(?: VER(?P<v>1))?"),
    ("busl", "business", r"business source LIC(?: VER(?P<v>1 [01]))?"),
    ("elastic", "elastic", r"elastic LIC(?: VER(?P<v>[12] 0))?"),
    ("commons-clause", "commons", r"commons clause(?: LIC)?(?: condition)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield) LIC(?: (?P<v>1 0)(?: 0)?)?"),
    ("rail", "openrail", r"openrail(?: m| s)?(?: LIC)?"),
    ("rail", "rail", r"(?:open )?rail(?: m| s)? LIC"),
    ("llama", "llama", r"llama (?P<v>2|3|3 1|3 2)? ?community LIC(?: agreement)?"),
    ("proprietary", "commercial", r"commercial LIC(?: agreement)?"),
    ("proprietary", "end", r"end user LIC agreement"),
    ("proprietary", "eula", r"eula"),
)

# Identifiers behind "SPDX-License-Identifier", as (label, regular expression over normalised words).
IDENTIFIERS = (
    ("0bsd", r"0bsd"),
    ("agpl-3", r"agpl 3 0(?: only| or later)?"),
    ("agpl-1", r"agpl 1 0(?: only| or later)?"),
    ("afl-3.0", r"afl 3 0"),
    ("apache-1.0", r"apache 1 0"),
    ("apache-1.1", r"apache 1 1"),
    ("apache-2.0", r"apache 2 0"),
    ("apsl-2.0", r"apsl 2 0"),
    ("artistic-1.0", r"artistic 1 0(?: perl| cl8)?"),
    ("artistic-2.0", r"artistic 2 0"),
    ("beerware", r"beerware"),
    ("bsd-1-clause", r"bsd 1 clause"),
    ("bsd-2-clause", r"bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", r"bsd 3 clause(?: clear| lbnl| attribution)?"),
    ("bsd-4-clause", r"bsd 4 clause(?: uc)?"),
    ("boost-1.0", r"bsl 1 0"),
    ("busl-1.1", r"busl 1 1"),
    ("cc0-1.0", r"cc0 1 0"),
    ("cc-by-3.0", r"cc by 3 0"),
    ("cc-by-4.0", r"cc by 4 0"),
    ("cc-by-sa-3.0", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", r"cc by sa 4 0"),
    ("cc-by-nc-4.0", r"cc by nc 4 0"),
    ("cc-by-nd-4.0", r"cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", r"cc by nc nd 4 0"),
    ("cddl-1.0", r"cddl 1 0"),
    ("cddl-1.1", r"cddl 1 1"),
    ("cecill-2.1", r"cecill 2 1"),
    ("cpl-1.0", r"cpl 1 0"),
    ("curl", r"curl"),
    ("ecl-2.0", r"ecl 2 0"),
    ("elastic-2.0", r"elastic 2 0"),
    ("epl-1.0", r"epl 1 0"),
    ("epl-2.0", r"epl 2 0"),
    ("eupl-1.1", r"eupl 1 1"),
    ("eupl-1.2", r"eupl 1 2"),
    ("gfdl-1.3", r"gfdl 1 3(?: only| or later)?"),
    ("gpl-1", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", r"gpl 2 0(?: only| or later)?(?: with \w+ exception 2 0)?"),
    ("gpl-3", r"gpl 3 0(?: only| or later)?"),
    ("isc", r"isc"),
    ("json", r"json"),
    ("lgpl-2", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", r"lgpl 3 0(?: only| or later)?"),
    ("mit", r"mit"),
    ("mit-0", r"mit 0"),
    ("mpl-1.1", r"mpl 1 1"),
    ("mpl-2.0", r"mpl 2 0"),
    ("ms-pl", r"ms pl"),
    ("ms-rl", r"ms rl"),
    ("mulan-2", r"mulanpsl 2 0"),
    ("ncsa", r"ncsa"),
    ("odbl-1.0", r"odbl 1 0"),
    ("ofl-1.1", r"ofl 1 1"),
    ("openssl", r"openssl"),
    ("osl-3.0", r"osl 3 0"),
    ("php-3.0", r"php 3 0"),
    ("postgresql", r"postgresql"),
    ("psf-2", r"psf 2 0"),
    ("python-2.0", r"python 2 0"),
    ("ruby", r"ruby"),
    ("sspl-1", r"sspl 1 0"),
    ("unicode", r"unicode (?:dfs 201[56]|3 0)"),
    ("unlicense", r"unlicense"),
    ("upl-1.0", r"upl 1 0"),
    ("vim", r"vim"),
    ("w3c", r"w3c"),
    ("wtfpl", r"wtfpl"),
    ("zlib", r"zlib"),
    ("zpl-2.1", r"zpl 2 1"),
)

# Sentences of licenses and notices, as (label, keyword, regular expression, priority, confidence).
NOTICES = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", NOTICE, 0.97),
    ("mit", "substantial", r"shall be included in all copies or substantial portions of the software", NOTICE, 0.9),
    ("mit", "noninfringement", r"merchantability fitness for a particular purpose and noninfringement in no event", NOTICE, 0.8),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms(?: with or without modification)?", NOTICE, 0.97),
    ("bsd", "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice", NOTICE, 0.95),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software", NOTICE, 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software", NOTICE, 0.95),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", NOTICE, 0.97),
    ("hpnd", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose", NOTICE, 0.95),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public LIC", NOTICE, 0.97),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public LIC", NOTICE, 0.97),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public LIC", NOTICE, 0.97),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public LIC", NOTICE, 0.95),
    ("lgpl", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public LIC", NOTICE, 0.95),
    ("agpl", "gnu", r"you should have received a copy of the gnu affero general public LIC", NOTICE, 0.95),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this LIC document(?: but changing it is not allowed)?", NOTICE, 0.9),
    ("copyleft", "copyleft", r"(?:strong |weak )?copyleft LIC", 20, 0.6),
    ("apache-2.0", "apache", r"licensed under the apache LIC version 2 0 the LIC you may not use this file except in compliance", NOTICE, 0.99),
    ("apache-2.0", "licenses", r"you may obtain a copy of the LIC at (?:https? )?(?:www )?apache org licenses LIC 2 0", NOTICE, 0.97),
    ("apache", "foundation", r"licensed to the apache software foundation asf under one or more contributor LIC agreements", NOTICE, 0.97),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public LIC v 2 0", NOTICE, 0.99),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public LIC version 1 1", NOTICE, 0.98),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public LIC", NOTICE, 0.98),
    ("cddl", "cddl", r"the contents of this file are subject to the terms of the common development and distribution LIC(?: the LIC)? cddl", NOTICE, 0.97),
    ("boost-1.0", "boost", r"distributed under the boost software LIC version 1 0", NOTICE, 0.98),
    ("boost-1.0", "machine", r"machine executable object code generated by a source language processor", NOTICE, 0.9),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", NOTICE, 0.95),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", NOTICE, 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", NOTICE, 0.99),
    ("cc0", "neighboring", r"has (?:waived|dedicated) all copyright and related or neighboring rights", NOTICE, 0.9),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font LIC version 1 1", NOTICE, 0.98),
    ("beerware", "beer", r"you can buy me a beer in return", NOTICE, 0.95),
    ("postgresql", "agreement", r"without fee and without a written agreement is hereby granted", NOTICE, 0.9),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", NOTICE, 0.95),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young", NOTICE, 0.95),
    ("artistic", "perl", r"under the same terms as perl itself", NOTICE, 0.8),
    ("json", "evil", r"the software shall be used for good not evil", NOTICE, 0.97),
    ("elastic", "elastic", r"licensed under the elastic LIC(?: 2 0)?", NOTICE, 0.95),
    ("commons-clause", "sell", r"the LIC does not grant to you the right to sell the software", NOTICE, 0.95),
    ("dual", "dual", r"dual licen[sc]ed(?: under)?|available under a dual LIC", 20, 0.5),
    ("all-rights-reserved", "reserved", r"all rights reserved", 20, 0.6),
    ("all-rights-reserved", "reserved", r"some rights reserved", 15, 0.4),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)?\d\d)*", 5, 0.2),
    ("proprietary", "proprietary", r"proprietary (?:and|amp|or) confidential(?: information)?", 30, 0.8),
    ("proprietary", "confidential", r"confidential (?:and|amp|or) proprietary(?: information)?", 30, 0.8),
    ("proprietary", "trade", r"(?:contains|constitutes) (?:confidential )?trade secrets?(?: of)?", 30, 0.8),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:of this (?:file|software|document) )?(?:\w+ ){0,6}is (?:strictly )?prohibited", 30, 0.8),
    ("proprietary", "reproduced", r"no part of this (?:file|work|document|publication) may be reproduced", 30, 0.7),
    ("proprietary", "internal", r"for internal use only", 25, 0.6),
    ("non-commercial", "only", r"for (?:non ?commercial|personal|academic|research) (?:use|purposes) only", 25, 0.7),
    ("non-commercial", "commercial", r"not (?:be used )?for commercial (?:use|purposes)|commercial use (?:is )?(?:not allowed|prohibited|forbidden)", 25, 0.7),
    ("evaluation", "evaluation", r"for evaluation (?:use|purposes) only", 25, 0.7),
    ("shareware", "shareware", r"shareware(?: version| LIC)?", 15, 0.4),
    ("freeware", "freeware", r"freeware(?: version| LIC)?", 15, 0.4),
)

# What may stand before a name, and behind it, as (regular expression, priority, confidence).
LEADS = (
    (r"spdx LIC identifier ", SPDX, 0.99),
    (r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistributed) under (?:an? |the )?(?:terms (?:and conditions )?of (?:an? |the )?|following )?", 40, 0.95),
    (r"(?:subject to|governed by|in accordance with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", 36, 0.9),
    (r"terms (?:and conditions )?of (?:the )?", 35, 0.9),
    (r"(?:LIC|licenses|licensing|copyright) (?:is )?(?:the )?", 25, 0.8),
)
TRAILS = ((r" as published by(?: the free software foundation)?", 35, 0.9), (r" (?:see|refer to) (?:the )?(?:file )?(?:LIC|copying|notice)(?: file| txt| md)?", 30, 0.85))
#: Families whose versions have a second figure.
DOTTED = frozenset(("apache", "mpl", "epl", "artistic"))
LONGEST_LEAD = 80


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    confidence: float
    name: bool  # whether what stands around a match counts


def compiled(pattern: str, before: str = "(?<= )", behind: str = "(?= )") -> re.Pattern:
    for word, stands_for in (("LIC", LIC), ("VER", VER), ("LATER", LATER)):
        pattern = pattern.replace(word, stands_for)
    return re.compile(f"{before}(?:{pattern}){behind}".encode())


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in order of priority."""
    out = [Rule(label, keyword, compiled(pattern), BARE, 0.7, True) for label, keyword, pattern in NAMES]
    out += [Rule(label, "spdx", compiled("spdx LIC identifier (?:" + pattern + ")"), SPDX, 0.99, False) for label, pattern in IDENTIFIERS]
    out += [Rule(label, keyword, compiled(pattern), priority, confidence, False) for label, keyword, pattern, priority, confidence in NOTICES]
    return tuple(sorted(out, key=lambda r: -r.priority))


@cache
def around() -> tuple[tuple[tuple[re.Pattern, int, float], ...], ...]:
    return tuple((compiled(p, "(?<= )", "$"), n, c) for p, n, c in LEADS), tuple((compiled(p, ""), n, c) for p, n, c in TRAILS)


@cache
def gate() -> tuple[ahocorasick.Automaton, dict[str, tuple[Rule, ...]]]:
    """The automaton of all keywords and base phrases at the start of a word, and each keyword's rules."""
    by: dict[str, tuple[Rule, ...]] = {p: () for p in BASE}
    for r in rules():
        by[r.keyword] = (*by.get(r.keyword, ()), r)
    automaton = ahocorasick.Automaton()
    for keyword in by:
        automaton.add_word(" " + keyword, keyword)
    automaton.make_automaton()
    return automaton, by


#: Lower-cases A-Z and turns what separates words into spaces.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
BASE_PATTERNS = tuple((re.compile(rb"(?= " + p.encode() + rb" )"), label) for p, label in BASE.items())


class Detection(NamedTuple):
    priority: int
    start: int
    end: int
    label: str
    confidence: float


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections that lie within no other one of a higher priority, or of theirs and longer; of equal ones the first by label."""
    kept, reach = [], {}  # the furthest end so far of each priority
    for d in sorted(found, key=lambda d: (d[1], -d[2], -d[0], d[3])):
        if not any(end >= d[2] for priority, end in reach.items() if priority >= d[0]):
            kept.append(d)
        reach[d[0]] = max(reach.get(d[0], 0), d[2])
    return kept


def detect(text: bytes, some: list[Rule]) -> list[Detection]:
    """What the rules find in normalised words with a space before, between and behind them."""
    leads, trails = around()
    found = []
    for r in some:
        for m in r.pattern.finditer(text):
            start, end, label, priority, confidence = m.start(), m.end(), r.label, r.priority, r.confidence
            if r.name:
                if version := m.groupdict().get("v"):
                    v = version.decode().replace(" ", ".")
                    label, priority = f"{label}-{v}{'.0' if len(v) == 1 and label in DOTTED else ''}", VERSIONED
                before = text[max(0, start - LONGEST_LEAD) : start]
                for pattern, n, c in leads:
                    if lead := pattern.search(before):
                        start, priority, confidence = start - len(before) + lead.start(), n + priority - BARE, c
                        break
                else:
                    for pattern, n, c in trails:
                        if trail := pattern.match(text, end):
                            end, priority, confidence = trail.end(), n + priority - BARE, c
                            break
            found.append(Detection(priority, start, end, label, confidence))
    return found


def scan(data: bytes, gated: bool = True) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text; gated: search only for rules whose keyword is there."""
    words = data.translate(NORMAL).split()
    text = b" " + b" ".join(words) + b" "
    automaton, by = gate()
    present = {keyword for _, keyword in automaton.iter(text.decode("latin-1"))}
    if gated and not present:
        return len(words), 0, None, None, "", "", 0.0
    places, base = [], set()
    for pattern, label in BASE_PATTERNS:
        at = [m.start() for m in pattern.finditer(text)]
        places += at
        base |= {label} if at else set()
    found = detect(text, [r for keyword in present for r in by[keyword]] if gated else list(rules()))
    doubt, labels = 1.0, set(base)
    for d in sorted(resolve(found)):
        labels.add(d.label)
        doubt *= 1 - d.confidence
    if places and not found:
        doubt = 0.4
    starts = (text.count(b" ", 0, min(places)), text.count(b" ", 0, max(places))) if places else (None, None)
    return len(words), len(places), *starts, ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - doubt, 6)


def _scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for batch in batches(frames):
        rows = [scan(data) for data in texts_of(batch.column(1))]
        yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], ["doc_id", *names])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, schema)
