"""License scans with ordered signature rules, in DataFrame operations only.

A text is lower-cased in A-Z and becomes its words, joined by single blanks. Rules are regular
expressions over that form. A text without any gate keyword is not scanned further; in others a group of rules
runs if its own gate is met, and a rule of it if the text contains one of the rule's keywords. Every pattern is a
constant, compiled once for a task. The places of a rule are found by one replacement that marks them and the
numbers of the marked words, so that the work grows in proportion to the text and its places.

Of the places found, one that lies within another of the same or a higher priority is suppressed: places are sorted by
start, the longer first, and compared with those before them in blocks, and with the furthest end of each priority of
the blocks before.

The base phrases count at every place where their words stand in a row, suppressed or not, and their
labels stay beside those of the rules.

Null and empty texts have no words, no labels and score 0. Rows are independent: nothing is shuffled,
repeated rows stay, and only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Words of the scanned form, the base phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Every rule's matches, and every base phrase, contain one of these, but those of the forms without a keyword (see NAMED).
GATES = ["licen", "copyright", "copyleft", "reserved", "spdx", "warrant", "permission", "redistribut", "proprietary", "confidential", "trade secret", "reproduced", "commons", "cc0"]

# Names of licenses as regular expressions over the scanned form, and the labels that they lead to.
NAMES = [
    ("apache-2.0", r"apache(?: software)?(?: license)?(?: version)? (?:v)?2(?: 0)?"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache", r"apache(?: software)?(?: license)?"),
    ("mit", r"(?:mit|expat|x11)"),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-3-clause", r"(?:modified bsd|revised bsd|new bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)"),
    ("bsd", r"bsd(?: style)?"),
    ("isc", r"isc"),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", r"gplv2"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", r"gplv3"),
    ("gpl", r"(?:gnu )?(?:general public license|gpl)"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?2 1"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?"),
    ("lgpl", r"(?:gnu )?(?:lesser general public license|library general public license|lgpl)"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)?"),
    ("agpl", r"(?:gnu )?(?:affero general public license|agpl)"),
    ("gfdl", r"(?:gnu )?(?:free documentation license|gfdl)"),
    ("mpl-1.1", r"(?:mozilla public license|mpl)(?: version| v)? ?1 1"),
    ("mpl-2.0", r"(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?"),
    ("mpl", r"(?:mozilla public license|mpl)"),
    ("epl-1.0", r"(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?"),
    ("epl-2.0", r"(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?"),
    ("epl", r"(?:eclipse public license|epl)"),
    ("eupl", r"(?:european union public licen[cs]e|eupl)"),
    ("cddl", r"(?:common development and distribution license|cddl)"),
    ("cpl", r"(?:common public license|cpl)"),
    ("artistic-2.0", r"artistic license 2(?: 0)?"),
    ("artistic", r"(?:perl )?artistic"),
    ("bsl-1.0", r"boost software license(?: version)? 1(?: 0)?"),
    ("bsl-1.0", r"boost software"),
    ("zlib", r"(?:zlib libpng|zlib|libpng)"),
    ("psf", r"(?:python software foundation|psf)"),
    ("php", r"php"),
    ("ruby", r"ruby"),
    ("openssl", r"openssl"),
    ("postgresql", r"postgresql"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"(?:do what the fuck you want to public|wtfpl)"),
    ("ofl-1.1", r"(?:sil )?open font(?: license)?(?: version)? ?1 1"),
    ("ofl", r"(?:sil open font|ofl)"),
    ("ms-pl", r"(?:microsoft public|ms pl)"),
    ("ms-rl", r"(?:microsoft reciprocal|ms rl)"),
    ("odbl", r"(?:open database|odbl)"),
    ("pddl", r"(?:public domain dedication and|pddl)"),
    ("ncsa", r"(?:university of illinois ncsa|ncsa)"),
    ("sleepycat", r"sleepycat"),
    ("busl-1.1", r"business source(?: license)?(?: 1 1)?"),
    ("sspl", r"(?:server side public|sspl)"),
    ("elastic-2.0", r"elastic(?: license)?(?: 2 0)?"),
    ("cc0-1.0", r"(?:cc0|cc zero)(?: 1 0)?"),
    ("cc-by", r"(?:cc|creative commons) (?:by|attribution)"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by|attribution) (?:sa|sharealike|share alike)"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial)"),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nd|noderivatives|noderivs|no derivatives)"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|sharealike|share alike)"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|noderivatives|noderivs|no derivatives)"),
]
#: How a name is met: keyword (None: the first words of the name), pattern around it, priority, and how sure the rule is.
FORMS = [
    ("spdx", "spdx license identifier {name}", 3, 1.0),
    (None, "(?:licensed|released|distributed|published|provided|available|covered|made available) (?:under|by|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: license| licence)?", 2, 0.95),
    (None, "(?:subject to|under|accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: license| licence)?", 2, 0.9),
    ("licen", "{name} licen[cs]e[ds]?", 1, 0.7),
    ("licen", "licen[cs]es? (?:is |type )?{name}", 1, 0.7),
]
#: What a text must have for any rule of a form to match.
FORM_GATES = {
    FORMS[0][1]: "spdx license identifier ",
    FORMS[1][1]: " (?:licensed|released|distributed|published|provided|available|covered) (?:under|by|according to) ",
    FORMS[2][1]: " (?:subject to|under|accordance with) ",
    FORMS[3][1]: " licen[cs]e[ds]? ",
    FORMS[4][1]: " licen[cs]es? ",
}
# Rules that stand for themselves: keyword, pattern, label, priority, how sure it is.
OTHERS = [
    ("cc", r"cc by(?: nc| sa| nd)*(?: [1-4] 0)?", "cc-by", 1, 0.8),
    ("cc", r"cc by nc(?: [1-4] 0)?", "cc-by-nc", 2, 0.9),
    ("cc", r"cc by sa(?: [1-4] 0)?", "cc-by-sa", 2, 0.9),
    ("cc", r"cc by nd(?: [1-4] 0)?", "cc-by-nd", 2, 0.9),
    ("cc", r"cc by nc sa(?: [1-4] 0)?", "cc-by-nc-sa", 2, 0.9),
    ("cc", r"cc by nc nd(?: [1-4] 0)?", "cc-by-nc-nd", 2, 0.9),
    ("cc0", r"cc0(?: 1 0)?", "cc0-1.0", 2, 0.9),
    ("general public", r"gnu general public license", "gpl", 1, 0.8),
    # openings of whole license texts
    ("permission", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?", "mit", 3, 1.0),
    ("permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "bsl-1.0", 3, 1.0),
    ("permission", r"permission to use copy modify and or distribute this software for any purpose", "isc", 3, 1.0),
    ("permission", r"permission to use copy modify and distribute this software for any purpose", "isc", 3, 0.9),
    ("permission", r"permission to use copy modify and or distribute this software", "isc", 2, 0.8),
    ("permission", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation", "hpnd", 3, 1.0),
    ("permission", r"permission is granted to anyone to use this software for any purpose including commercial applications", "zlib", 3, 1.0),
    ("permission", r"permission is hereby granted without written agreement and without license or royalty fees", "mit-modern", 3, 0.9),
    ("permission", r"permission is hereby granted to use copy modify prepare derivative works", "hpnd", 2, 0.8),
    ("permission", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 3, 1.0),
    ("permission", r"permission is granted to make and distribute verbatim copies", "gnu-verbatim", 2, 0.9),
    ("permission", r"copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice", "gnu-all-permissive", 3, 1.0),
    ("copyright", r"copying and distribution of this file with or without modification are permitted", "gnu-all-permissive", 2, 0.9),
    ("permission", r"no permission is granted", "proprietary", 1, 0.5),
    ("permission", r"without (?:the )?(?:prior )?(?:express )?(?:written )?permission of the (?:author|publisher|copyright holder|owner)s?", "permission-required", 1, 0.5),
    ("redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", "bsd", 3, 1.0),
    ("redistribution", r"redistribution and use in source and binary forms", "bsd", 2, 0.9),
    ("redistribution", r"redistributions of source code must retain the above copyright notice", "bsd", 2, 0.9),
    ("redistribution", r"redistributions in binary form must reproduce the above copyright notice", "bsd", 2, 0.9),
    ("copyright", r"neither the name of the copyright holder nor the names of its contributors", "bsd-3-clause", 3, 0.95),
    ("permission", r"may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause", 3, 0.95),
    ("copyright", r"all advertising materials mentioning features or use of this software must display", "bsd-4-clause", 3, 0.95),
    ("licen", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0", 3, 1.0),
    ("licen", r"you may not use this file except in compliance with the license", "apache-2.0", 2, 0.8),
    ("licen", r"unless required by applicable law or agreed to in writing software distributed under the license", "apache-2.0", 2, 0.8),
    ("licen", r"apache license version 2 0 january 2004", "apache-2.0", 3, 1.0),
    ("licen", r"apache org licenses license 2 0", "apache-2.0", 3, 1.0),
    ("licen", r"apache org licenses license 1 1", "apache-1.1", 3, 1.0),
    ("licen", r"contributor license agreements?", "cla", 1, 0.4),
    ("licen", r"the unlicense", "unlicense", 2, 0.9),
    ("public domain", r"this is free and unencumbered software released into the public domain", "unlicense", 3, 1.0),
    ("licen", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gpl", 2, 0.9),
    ("licen", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl", 3, 1.0),
    ("licen", r"free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 3, 1.0),
    ("licen", r"free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", 3, 1.0),
    ("licen", r"free software you can redistribute it and or modify it under the terms of the gnu library general public license", "lgpl", 3, 1.0),
    ("licen", r"free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl", 3, 1.0),
    ("licen", r"either version 2 of the license or at your option any later version", "gpl-2.0", 2, 0.8),
    ("licen", r"either version 2 1 of the license or at your option any later version", "lgpl-2.1", 2, 0.9),
    ("licen", r"either version 3 of the license or at your option any later version", "gpl-3.0", 2, 0.8),
    ("licen", r"you should have received a copy of the gnu general public license", "gpl", 2, 0.95),
    ("licen", r"you should have received a copy of the gnu lesser general public license", "lgpl", 2, 0.95),
    ("licen", r"you should have received a copy of the gnu affero general public license", "agpl", 2, 0.95),
    ("licen", r"gnu org licenses gpl 2 0", "gpl-2.0", 3, 0.95),
    ("licen", r"gnu org licenses gpl 3 0", "gpl-3.0", 3, 0.95),
    ("licen", r"gnu org licenses lgpl(?: [23](?: [01])?)?", "lgpl", 3, 0.95),
    ("licen", r"gnu org licenses agpl(?: 3 0)?", "agpl", 3, 0.95),
    ("licen", r"gnu org licenses fdl(?: 1 [123])?", "gfdl", 3, 0.95),
    ("licen", r"gnu org licenses", "gpl", 1, 0.7),
    ("copyleft", r"gnu org copyleft gpl html", "gpl", 3, 0.95),
    ("copyleft", r"gnu org copyleft lesser html", "lgpl", 3, 0.95),
    ("licen", r"opensource org licenses mit(?: license)?(?: php)?", "mit", 3, 0.95),
    ("licen", r"opensource org licenses bsd(?: license)?(?: php)?", "bsd", 3, 0.95),
    ("licen", r"opensource org licenses bsd 3 clause", "bsd-3-clause", 3, 0.95),
    ("licen", r"opensource org licenses bsd 2 clause", "bsd-2-clause", 3, 0.95),
    ("licen", r"opensource org licenses isc(?: license)?(?: txt)?", "isc", 3, 0.95),
    ("licen", r"opensource org licenses artistic license(?: 2 0)?", "artistic", 3, 0.95),
    ("licen", r"opensource org licenses zlib(?: license)?(?: php)?", "zlib", 3, 0.95),
    ("licen", r"boost org license 1 0 txt", "bsl-1.0", 3, 1.0),
    ("licen", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", 3, 1.0),
    ("licen", r"the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1", 3, 1.0),
    ("licen", r"the contents of this file are subject to the netscape public license", "npl", 3, 1.0),
    ("licen", r"the contents of this file are subject to the terms of the common development and distribution license", "cddl", 3, 1.0),
    ("licen", r"mozilla org mpl 2 0", "mpl-2.0", 3, 0.95),
    ("licen", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", 3, 1.0),
    ("licen", r"eclipse org legal epl v10 html", "epl-1.0", 3, 0.95),
    ("licen", r"eclipse org legal epl 2 0", "epl-2.0", 3, 0.95),
    ("licen", r"python software foundation license version 2", "psf", 3, 1.0),
    ("licen", r"this software is distributed under the terms of the qt commercial license", "commercial", 3, 0.9),
    ("licen", r"the php license version 3 0?1", "php", 3, 1.0),
    ("licen", r"zope public license(?: version)?(?: 2 [01])?", "zpl", 2, 0.9),
    ("licen", r"w3c software (?:and document )?notice and license", "w3c", 2, 0.95),
    ("licen", r"academic free license(?: version)?(?: [1-3] [01])?", "afl", 2, 0.9),
    ("licen", r"open software license(?: version)?(?: [1-3] [01])?", "osl", 2, 0.9),
    ("licen", r"ibm public license(?: version)?(?: 1 0)?", "ipl", 2, 0.9),
    ("licen", r"lucent public license(?: version)?(?: 1 0[02]?)?", "lpl", 2, 0.9),
    ("licen", r"apple public source license(?: version)?(?: [12] [0-2])?", "apsl", 2, 0.9),
    ("licen", r"sun industry standards source license", "sissl", 2, 0.9),
    ("licen", r"sybase open watcom public license", "watcom", 2, 0.9),
    ("licen", r"q public license(?: version)?(?: 1 0)?", "qpl", 2, 0.9),
    ("licen", r"nokia open source license", "nokia", 2, 0.9),
    ("licen", r"reciprocal public license(?: 1 [15])?", "rpl", 2, 0.9),
    ("licen", r"vovida software license", "vsl", 2, 0.9),
    ("licen", r"cecill (?:b |c )?free software license agreement", "cecill", 2, 0.95),
    ("licen", r"mulan permissive software license(?: version)?(?: 2)?", "mulan", 2, 0.95),
    ("licen", r"educational community license(?: version)?(?: [12] 0)?", "ecl", 2, 0.9),
    ("licen", r"non profit open software license", "nposl", 2, 0.9),
    ("licen", r"latex project public license", "lppl", 2, 0.95),
    ("licen", r"freetype (?:project )?license", "ftl", 2, 0.9),
    ("licen", r"independent jpeg group s license", "ijg", 2, 0.9),
    ("licen", r"the openssl license", "openssl", 2, 0.9),
    ("licen", r"open government licence(?: v[123] 0)?", "ogl", 2, 0.9),
    ("licen", r"open data commons attribution license", "odc-by", 2, 0.95),
    ("licen", r"open data commons open database license", "odbl", 3, 0.95),
    ("licen", r"community data license agreement(?: permissive| sharing)?", "cdla", 2, 0.95),
    ("licen", r"server side public license(?: version)?(?: 1)?", "sspl", 2, 0.95),
    ("licen", r"business source license(?: version)?(?: 1 1)?", "busl-1.1", 2, 0.9),
    ("licen", r"functional source license", "fsl", 2, 0.9),
    ("licen", r"polyform (?:noncommercial|strict|shield|small business|perimeter) license", "polyform", 2, 0.95),
    ("licen", r"commons clause license condition", "commons-clause", 3, 0.95),
    ("licen", r"(?:bigscience|creativeml) (?:open)?rail(?: m)? license", "openrail", 2, 0.9),
    ("licen", r"llama (?:[23] )?community license", "llama", 2, 0.9),
    ("licen", r"free art license", "fal", 2, 0.9),
    ("licen", r"beer ware license", "beerware", 2, 0.95),
    ("licen", r"don t be a dick public license", "dbad", 2, 0.9),
    ("commons", r"creativecommons org licenses by [1-4] 0", "cc-by", 3, 0.95),
    ("commons", r"creativecommons org licenses by sa [1-4] 0", "cc-by-sa", 3, 0.95),
    ("commons", r"creativecommons org licenses by nd [1-4] 0", "cc-by-nd", 3, 0.95),
    ("commons", r"creativecommons org licenses by nc [1-4] 0", "cc-by-nc", 3, 0.95),
    ("commons", r"creativecommons org licenses by nc sa [1-4] 0", "cc-by-nc-sa", 3, 0.95),
    ("commons", r"creativecommons org licenses by nc nd [1-4] 0", "cc-by-nc-nd", 3, 0.95),
    ("commons", r"creativecommons org publicdomain zero 1 0", "cc0-1.0", 3, 0.95),
    ("commons", r"creativecommons org publicdomain mark 1 0", "public-domain", 3, 0.95),
    ("commons", r"creative commons legal code", "cc", 2, 0.8),
    ("commons", r"creative commons zero", "cc0-1.0", 2, 0.9),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)", "proprietary", 1, 0.6),
    ("copyright", r"unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|work) [a-z]+ copyright", "proprietary", 1, 0.5),
    ("trade secret", r"(?:contains|constitutes?) (?:valuable )?(?:proprietary (?:and confidential )?information and )?trade secrets?", "proprietary", 1, 0.6),
    ("reproduced", r"no part of this (?:publication|book|work|document) may be reproduced", "reserved", 2, 0.8),
    ("reserved", r"all rights reserved worldwide", "reserved", 2, 0.8),
    ("warrant", r"(?:provided|distributed) (?:on an )?as is(?: basis)? without warrant(?:y|ies)", "as-is", 1, 0.5),
    ("warrant", r"without warranties or conditions of any kind", "apache-2.0", 2, 0.9),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*", "copyright", 1, 0.6),
    ("copyright", r"copyright notice", "copyright", 1, 0.4),
    ("copyleft", r"copyleft", "copyleft", 1, 0.4),
    ("public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public-domain", 2, 0.9),
    ("public domain", r"public domain", "public-domain", 1, 0.5),
    ("reserved", r"all rights reserved", "reserved", 1, 0.8),
    ("reserved", r"some rights reserved", "some-reserved", 1, 0.6),
    ("reserved", r"no rights reserved", "public-domain", 1, 0.6),
    ("proprietary", r"proprietary (?:and confidential )?(?:license|licence|copyright)", "proprietary", 1, 0.6),
    ("licen", r"end user licen[cs]e agreement", "eula", 2, 0.8),
    ("licen", r"commercial licen[cs]e", "commercial", 1, 0.5),
]


def spelled(pattern: str, at: int = 0) -> tuple[set[str], int]:
    """(all texts that a name's pattern can match, where its group ends)."""
    out, done = {""}, set()
    while at < len(pattern) and pattern[at] != ")":
        if pattern[at] == "|":
            done, out, at = done | out, {""}, at + 1
            continue
        if pattern.startswith("(?:", at):
            part, at = spelled(pattern, at + 3)
            at += 1
        elif pattern[at] == "[":
            part, at = set(pattern[at + 1 : pattern.index("]", at)]), pattern.index("]", at) + 1
        else:
            part, at = {pattern[at]}, at + 1
        if pattern[at : at + 1] == "?":
            part, at = part | {""}, at + 1
        out = {a + b for a in out for b in part}
    return done | out, at


def first_words(name: str) -> list[str]:
    """What a name's matches begin with, without those that begin like another."""
    words = {w.split()[0] for w in spelled(name)[0]}
    return sorted(w for w in words if not any(w != x and w.startswith(x) for x in words))


def rules() -> list[dict]:
    """The rules in their order: keywords, pattern, label, priority, sure, and the form that they are a group by (None: their keyword)."""
    named = [([k] if k else [f" {w}" for w in first_words(name)], form.format(name=name), label, priority, sure, form) for label, name in NAMES for k, form, priority, sure in FORMS]
    keys = ("keywords", "pattern", "label", "priority", "sure", "form")
    others = [([k], *rest, None) for k, *rest in OTHERS]
    return [dict(zip(keys, (k, f"(?<= )(?:{p})(?= )", *rest), strict=True)) | {"place": i} for i, (k, p, *rest) in enumerate([*named, *others])]


#: Over the text: what the matches of the forms without a keyword contain.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NAMED = "(?:under|by|(?:according|subject) to|accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{})".format("|".join(sorted({w for _, name in NAMES for w in first_words(name)}))).replace(" ", GAP)

PLACES = "array<struct<start:int,back:int,rank:int,place:int,label:string,sure:double>>"
BEGIN, END = "\x01", "\x02"  # marks that no text has in its scanned form
#: Sorted places of which only the furthest ends are looked at by places behind them.
TOGETHER = 256
#: The places not within an earlier one: of the own block one by one, of blocks before by their furthest end of each priority.
SWEEP = f"""
flatten(transform(blocks, (own, b) -> filter(own, (d, i) ->
  NOT exists(slice(own, 1, i), e -> e.rank <= d.rank AND e.back <= d.back)
  AND NOT exists(slice(furthest, 1, b), t -> (CASE d.rank WHEN -1 THEN t.e1 WHEN -2 THEN t.e2 ELSE t.e3 END) <= d.back))))
"""
BLOCKS = f"transform(sequence(0, size(found) div {TOGETHER}), b -> slice(found, b * {TOGETHER} + 1, {TOGETHER}))"
FURTHEST = "transform(blocks, own -> struct({}))".format(", ".join(f"array_min(transform(filter(own, d -> d.rank <= -{k}), d -> d.back)) AS e{k}" for k in (1, 2, 3)))


def hits(rule: dict) -> str:
    """The places of a rule: numbers of the first word and, negative, of the word behind the last."""
    # the words are an array of one array, so that they are cut once
    numbers = lambda test: f"filter(transform(words, (w, i) -> IF({test}, i, NULL)), i -> i IS NOT NULL)"
    both = f"transform(array(split(regexp_replace(norm, '{rule['pattern']}', '{BEGIN}$0{END}'), ' ')), words -> struct({numbers(f"startswith(w, '{BEGIN}')")} AS starts, {numbers(f"endswith(w, '{END}')")} AS stops))"
    place = f"struct(start - 1 AS start, -get(b.stops, k) AS back, {-rule['priority']} AS rank, {rule['place']} AS place, '{rule['label']}' AS label, double({rule['sure']}) AS sure)"
    return f"flatten(transform({both}, b -> transform(b.starts, (start, k) -> {place})))"


def places_of_all() -> Column:
    """The places of all rules in the texts that have them, sorted."""
    none = f"CAST(array() AS {PLACES})"
    groups: dict = {}
    for rule in rules():
        groups.setdefault((rule["form"], rule["keywords"][0] if rule["form"] is None else None), []).append(rule)
    parts = []
    for (form, keyword), own in groups.items():
        gate = f"contains(norm, '{keyword}')" if form is None else f"rlike(norm, '{FORM_GATES[form]}')"
        found = [f"CASE WHEN ({' OR '.join(f"contains(norm, '{k}')" for k in r['keywords'])}) AND rlike(norm, '{r['pattern']}') THEN {hits(r)} ELSE {none} END" for r in own]
        parts.append(f"CASE WHEN {gate} THEN flatten(array({', '.join(found)})) ELSE {none} END")
    return F.expr(f"sort_array(flatten(array({', '.join(parts)})))")


def kept_places() -> Column:
    """The places of the column found that are not suppressed. What is used often is bound to a name of a lambda, which is evaluated once."""
    kept = f"transform({SWEEP}, d -> struct(d.start AS start, -d.back AS stop, d.label AS label, d.sure AS sure))"
    for name, value in (("furthest", FURTHEST), ("blocks", BLOCKS), ("found", "found")):
        kept = f"get(transform(array({value}), {name} -> {kept}), 0)"
    return F.expr(kept)


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places (numbers of the first word and of the word behind the last, label, and how sure it is)."""
    lowered = F.lower("text")
    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.contains(lowered, F.lit(word))
    # blanks of the scanned form can be any other marks in the text
    gate = gate | (F.contains(lowered, F.lit("cc")) & F.contains(lowered, F.lit("by"))) | (F.contains(lowered, F.lit("public")) & (F.contains(lowered, F.lit("domain")) | F.contains(lowered, F.lit("general")))) | (F.contains(lowered, F.lit("trade")) & F.contains(lowered, F.lit("secret"))) | lowered.rlike(NAMED)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", "text").select("doc_id", F.regexp_count(text, F.lit(RAW_WORD)).cast("bigint").alias("n_words"), F.when(gate, F.col("text")).alias("text"))
    words = F.regexp_extract_all(F.translate("text", letters, letters.lower()), F.lit(WORD), F.lit(0))
    df = df.withColumn("norm", F.when(F.col("text").isNotNull(), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))).drop("text")
    count, firsts, lasts, labels = F.lit(0), [], [], []
    for phrase, label in BASE:
        padded = f" {phrase} "
        n = F.coalesce(F.regexp_count("norm", F.lit(f"(?<= ){phrase}(?= )")), F.lit(0))
        at = F.instr("norm", padded)
        behind = F.instr(F.reverse("norm"), padded[::-1])
        firsts.append(F.when(n > 0, blanks(F.substring("norm", F.lit(1), at)) - 1))
        before = F.substring(F.col("norm"), F.lit(1), F.length("norm") - behind - len(padded) + 2)
        lasts.append(F.when(n > 0, blanks(before) - 1))
        labels.append(F.when(n > 0, F.lit(label)))
        count = count + n
    df = df.withColumns({"n_base": count.cast("bigint"), "first_word": F.least(*firsts).cast("bigint"), "last_word": F.greatest(*lasts).cast("bigint"), "base": F.array_compact(F.array(*labels))})
    df = df.withColumn("found", F.when(F.col("norm").isNotNull(), places_of_all()))
    df = df.withColumn("places", F.coalesce(kept_places(), F.array().cast("array<struct<start:int,stop:int,label:string,sure:double>>")))
    every = F.array_sort(F.array_distinct(F.concat("base", F.col("places.label"))))
    score = F.greatest(F.coalesce(F.array_max("places.sure"), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.8).otherwise(0.0))
    return df.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), "places")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")
