"""License scans with ordered signature rules, in DataFrame functions only.

A rule is a regular expression with a label, a priority, a keyword that each of its matches contains, and literals of
which each contains one. A text without any gate word is never matched. In the others line breaks with the marks of
comments (#, *, //, ;, -- and the like), and runs of white space, become one space, so that a notice is found however
it is wrapped; only the rules whose keyword and one of whose literals occur are tried. A detection is dropped if
another one, of no lower priority, covers its interval (of equal intervals the higher priority and then the earlier rule
stays). Nothing is shuffled: all arrays belong to one row. Places of detections are in the folded text, those of base
words in the text itself.

Defined results: a null text is an empty one (no words, empty labels, score 0); equal rows get equal results; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licenses by label, with their names, short names (as identifiers) and home pages, as patterns in lower case.
LICENSES = {
    "mit": ("mit|expat", "mit", r"opensource\.org/licenses/mit"),
    "mit-0": ("mit no attribution", "mit-0", r"opensource\.org/licenses/mit-0"),
    "apache-1.1": (r"apache(?: software)?(?: license)?,? (?:version |v)?1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    "apache-2.0": (r"apache(?: software)?(?: license)?,? (?:version |v)?2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    "gpl-2.0": (r"gnu general public license,? (?:version |v)2|gpl ?v?2", r"gpl-2\.0(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    "gpl-3.0": (r"gnu general public license,? (?:version |v)3|gpl ?v?3", r"gpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/gpl-3\.0"),
    "lgpl-2.1": (r"gnu lesser general public license,? (?:version |v)2\.1|lgpl ?v?2\.1", r"lgpl-2\.1(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    "lgpl-3.0": (r"gnu lesser general public license,? (?:version |v)3|lgpl ?v?3", r"lgpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/lgpl-3\.0"),
    "agpl-3.0": (r"gnu affero general public license,? (?:version |v)3|agpl ?v?3", r"agpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/agpl-3\.0"),
    "gfdl-1.3": (r"gnu free documentation license,? (?:version |v)1\.3", r"gfdl-1\.3", r"gnu\.org/licenses/fdl-1\.3"),
    "bsd-2-clause": (r"(?:simplified|2-clause|two-clause|freebsd) bsd|bsd 2-clause", "bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    "bsd-3-clause": (r"(?:new|modified|revised|3-clause|three-clause) bsd|bsd 3-clause", "bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    "0bsd": (r"zero-clause bsd|bsd zero clause|free public license 1\.0\.0", "0bsd", r"opensource\.org/licenses/0bsd"),
    "mpl-1.1": (r"mozilla public license,? (?:version |v)?1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    "mpl-2.0": (r"mozilla public license,? (?:version |v)?2\.0", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    "epl-1.0": (r"eclipse public license,? (?:version |v|- v ?)?1\.0", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    "epl-2.0": (r"eclipse public license,? (?:version |v|- v ?)?2\.0", r"epl-2\.0", r"eclipse\.org/legal/epl-2\.0"),
    "cddl-1.0": (r"common development and distribution license,? (?:version |v)?1\.0", r"cddl-1\.0", r"opensource\.org/licenses/cddl-1\.0"),
    "isc": ("isc", "isc", r"opensource\.org/licenses/isc"),
    "zlib": ("zlib(?:/libpng)?", "zlib", r"zlib\.net/zlib_license"),
    "bsl-1.0": (r"boost software license,? (?:version |v)?1\.0", r"bsl-1\.0", r"boost\.org/license_1_0"),
    "unlicense": ("the unlicense", "unlicense", r"unlicense\.org"),
    "wtfpl": ("do what the f[*u][*c]k you want to public license", "wtfpl", r"wtfpl\.net"),
    "artistic-2.0": (r"artistic license,? (?:version |v)?2\.0", r"artistic-2\.0", r"opensource\.org/licenses/artistic-2\.0"),
    "python-2.0": ("python software foundation|psf", r"python-2\.0", r"docs\.python\.org/3/license"),
    "ruby": ("ruby", "ruby", r"ruby-lang\.org/en/about/license"),
    "php-3.01": (r"php license,? (?:version |v)?3\.01", r"php-3\.01", r"php\.net/license/3_01"),
    "postgresql": ("postgresql", "postgresql", r"opensource\.org/licenses/postgresql"),
    "ofl-1.1": (r"sil open font license,? (?:version |v)?1\.1", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    "eupl-1.2": (r"european union public licen[cs]e,? (?:version |v\.? ?)?1\.2", r"eupl-1\.2", r"joinup\.ec\.europa\.eu/collection/eupl"),
    "cc0-1.0": (r"cc0(?: 1\.0)?(?: universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero/1\.0"),
    **{
        f"cc-by{kind}-{version}.0": (
            rf"(?:cc[ -]by{kind}|creative commons attribution{long})(?: international| unported)?,? (?:version |v)?{version}\.0",
            rf"cc-by{kind}-{version}\.0",
            rf"creativecommons\.org/licenses/by{kind}/{version}\.0",
        )
        for kind, long in (("", ""), ("-sa", "-share-?alike"), ("-nc", "-non-?commercial"), ("-nd", "-no-?deriv(?:ative)?s"), ("-nc-sa", "-non-?commercial-share-?alike"), ("-nc-nd", "-non-?commercial-no-?deriv(?:ative)?s"))
        for version in (3, 4)
    },
}
#: How a license is named, with {name}, {id} and {url} for the above: (pattern, priority, keyword).
TEMPLATES = (
    (r"spdx-license-identifier: {id}(?![\w.-])", 100, "spdx-license-identifier: "),
    (r"https?://(?:www\.)?{url}", 90, "://"),
    (r"(?:is |are |be )?(?:licensed|released|distributed|published|available|provided|covered) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})(?: licen[cs]e)?(?![\w-])", 80, " under "),
    (r"(?:all rights reserved[.;,]? )?(?:use|usage|redistribution) (?:is |of this software is )?governed by (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?(?![\w-])", 70, " governed by "),
    (r"(?:all rights reserved[.;,]? )?(?:use|usage|redistribution) (?:is |of this software is )?subject to (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?(?![\w-])", 70, " subject to "),
    (r"licen[cs]e ?[:=] ?[\"']?(?:{id}|{name})(?![\w-])", 60, "licen"),
    (r"(?<![\w-])(?:{name}) licen[cs]e(?![\w-])", 50, "licen"),
)
#: Rules by hand, from the wordings of titles, grants, conditions, disclaimers and file headers, with single spaces: (label, pattern, priority).
WORDINGS = (
    ("copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d", 30),
    ("all-rights-reserved", r"all rights reserved", 30),
    ("public-domain", r"(?:released into|dedicated to|in) the public domain", 40),
    ("public-domain", r"has been placed (?:in|into) the public domain", 45),
    ("public-domain", r"hereby (?:disclaims|waives) all copyright(?: interest)? in this (?:work|program|software)", 45),
    ("proprietary", r"proprietary and confidential", 40),
    ("proprietary", r"unauthori[sz]ed copying of this file", 40),
    ("proprietary", r"(?:contains|is) (?:the )?confidential and proprietary information", 45),
    ("proprietary", r"no part of this (?:work|document|publication) may be reproduced(?:, stored in a retrieval system)?,? or transmitted in any form or by any means without (?:the )?prior written permission", 45),
    ("proprietary", r"this software is licensed, not sold", 45),
    ("proprietary", r"you may not reverse engineer, decompile,? or disassemble the (?:software|licensed software|product),? except", 35),
    ("proprietary", r"end[ -]user licen[cs]e agreement", 35),
    ("no-warranty", r"provided [\"'“”]?as is[\"'“”]?,? without (?:any )?(?:express or implied )?warranty", 20),
    ("no-warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose", 25),
    ("no-warranty", r"(?:makes no|disclaims all) (?:representations or )?warranties", 20),
    ("mit", r"the mit license \(mit\)", 80),
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", 85),
    ("mit", r"to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,? and/or sell copies of the software", 82),
    ("mit", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software", 80),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise", 70),
    ("x11", r"except as contained in this notice, the names? of (?:the )?(?:x consortium|the above copyright holders|copyright holders|authors) shall not be used in advertising", 85),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted", 85),
    ("hpnd", r"appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation", 80),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", 86),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", 70),
    ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", 75),
    ("0bsd", r"bsd zero clause license", 80),
    ("bsd", r"redistribution and use in source and binary forms,? with or without modification,? are permitted", 85),
    ("bsd", r"redistributions? (?:of|in) source code must retain the above copyright notice", 75),
    ("bsd", r"redistributions? in binary form must reproduce the above copyright notice", 75),
    ("bsd", r"this software is provided by the (?:copyright holders and contributors|author|authors|regents and contributors) [\"'“”]?as is[\"'“”]? and any express or implied warranties", 70),
    ("bsd-3-clause", r"neither the names? of (?:the )?(?:copyright holder|author|authors|company|organization|university|project)s? nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission", 88),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 88),
    ("bsd-4-clause", r"this product includes software developed by the university of california, berkeley and its contributors", 60),
    ("bsd-style", r"use of this source code is governed by an? bsd-style license", 85),
    ("bsd-style", r"use of this source code is governed by an? mit-style license", 85),
    ("apache-2.0", r"apache license,? version 2\.0, january 2004", 90),
    ("apache-2.0", r"licensed under the apache license, version 2\.0 \(the [\"'“”]?license[\"'“”]?\)", 90),
    ("apache-2.0", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", 88),
    ("apache-2.0", r"the asf licenses this file to you under the apache license, version 2\.0", 90),
    ("apache-2.0", r"you may not use this file except in compliance with the license\. you may obtain a copy of the license at", 80),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an [\"'“”]?as is[\"'“”]? basis", 80),
    ("apache-2.0", r"see the license for the specific language governing permissions and limitations under the license", 78),
    ("apache-2.0", r"terms and conditions for use, reproduction, and distribution 1\. definitions\. [\"'“”]?license[\"'“”]? shall mean", 85),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|patent|\(except as stated in this section\) patent) license", 85),
    ("apache-1.1", r"the end-user documentation included with the redistribution, if any, must include the following acknowledg?e?ment", 85),
    ("apache-1.1", r"products derived from this software may not be called [\"'“”]?apache[\"'“”]?,? nor may [\"'“”]?apache[\"'“”]? appear in their name,? without prior written permission", 85),
    ("gpl", r"under the terms of the gnu general public license as published by the free software foundation", 85),
    ("gpl-2.0", r"gnu general public license version 2, june 1991", 90),
    ("gpl-3.0", r"gnu general public license version 3, 29 june 2007", 90),
    ("gpl-1.0", r"gnu general public license version 1, february 1989", 90),
    ("gpl-2.0", r"(?:gnu general public license|gpl) as published by the free software foundation[;,] either version 2 of the license,? or \(at your option\) any later version", 92),
    ("gpl-3.0", r"(?:gnu general public license|gpl) as published by the free software foundation, either version 3 of the license,? or \(at your option\) any later version", 92),
    ("gpl-2.0", r"gnu general public license version 2 as published by the free software foundation", 92),
    ("gpl-3.0", r"gnu general public license version 3 as published by the free software foundation", 92),
    ("gpl-2.0", r"it under the terms of version 2 of the gnu general public license", 92),
    ("gpl-3.0", r"it under the terms of version 3 of the gnu general public license", 92),
    ("gpl", r"see the gnu general public license for more details", 70),
    ("gpl", r"you should have received a copy of the gnu general public license along with (?:this|the) (?:program|software|library|file|package)", 75),
    ("gpl", r"the gnu general public license is a free, copyleft license for software and other kinds of works", 85),
    ("gpl", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom to (?:share and )?change", 80),
    ("gpl", r"when we speak of free software, we are referring to freedom, not price\. our general public licenses are designed", 80),
    ("gpl", r"this program is free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license", 85),
    ("gpl", r"(?:alternatively, )?this (?:software|file|program) may be (?:used|distributed) under the terms of the (?:gnu )?general public license", 80),
    ("gpl", r"dual[ -]licen[cs]ed under the (?:mit|bsd|apache|mpl) (?:license )?and (?:the )?(?:gnu )?gpl", 75),
    ("gpl-classpath-exception", r"as a special exception, the copyright holders of this library give you permission to link this library with independent modules", 88),
    ("gpl-bison-exception", r"as a special exception, you may create a larger work that contains part or all of the bison parser skeleton and distribute that work under terms of your choice", 88),
    ("gcc-exception", r"gcc runtime library exception", 80),
    ("lgpl-2.0", r"gnu library general public license version 2, june 1991", 90),
    ("lgpl-2.1", r"gnu lesser general public license version 2\.1, february 1999", 90),
    ("lgpl-3.0", r"gnu lesser general public license version 3, 29 june 2007", 90),
    ("lgpl", r"under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation", 86),
    ("lgpl-2.0", r"gnu library general public license as published by the free software foundation[;,] either version 2 of the license,? or \(at your option\) any later version", 92),
    ("lgpl-2.1", r"gnu lesser general public license as published by the free software foundation[;,] either version 2\.1 of the license,? or \(at your option\) any later version", 92),
    ("lgpl-3.0", r"gnu lesser general public license as published by the free software foundation[;,] either version 3 of the license,? or \(at your option\) any later version", 92),
    ("lgpl", r"see the gnu (?:lesser|library) general public license for more details", 71),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program|software|file)", 76),
    ("lgpl", r"this license, the lesser general public license, applies to some specially designated software packages", 85),
    ("lgpl", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", 88),
    ("agpl-3.0", r"gnu affero general public license version 3, 19 november 2007", 90),
    ("agpl-3.0", r"gnu affero general public license as published by the free software foundation, either version 3 of the license,? or \(at your option\) any later version", 92),
    ("agpl-3.0", r"the gnu affero general public license is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community", 88),
    ("agpl", r"under the terms of the gnu affero general public license", 84),
    ("agpl", r"see the gnu affero general public license for more details", 72),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with this program", 77),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", 86),
    ("gfdl-1.2", r"gnu free documentation license,? version 1\.2", 86),
    ("gfdl", r"a copy of the license is included in the section entitled [\"'“”]?gnu free documentation license", 80),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0", 92),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file, you can obtain one at https?://(?:www\.)?mozilla\.org/mpl/2\.0", 91),
    ("mpl-2.0", r"mozilla public license version 2\.0 1\. definitions", 90),
    ("mpl-2.0", r"this source code form is [\"'“”]?incompatible with secondary licenses", 85),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1", 92),
    ("mpl-1.1", r"software distributed under the license is distributed on an [\"'“”]?as is[\"'“”]? basis, without warranty of any kind, either express or implied\. see the license for the specific language governing rights", 75),
    ("mpl-tri", r"the contents of this file may be used under the terms of either the gnu general public license version 2 or later", 85),
    ("epl-1.0", r"the accompanying program is provided under the terms of this eclipse public license \([\"'“”]?agreement[\"'“”]?\)", 85),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0", 92),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v?\.? ?2\.0", 92),
    ("epl-2.0", r"this source code may also be made available under the following secondary licenses", 80),
    ("edl-1.0", r"made available under the terms of the eclipse distribution license v\.? ?1\.0", 90),
    ("cpl-1.0", r"common public license version 1\.0", 85),
    ("ipl-1.0", r"ibm public license version 1\.0", 85),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license", 90),
    ("zlib", r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", 88),
    ("zlib", r"this software is provided [\"'“”]?as-is[\"'“”]?, without any express or implied warranty", 75),
    ("bsl-1.0", r"distributed under the boost software license, version 1\.0", 90),
    ("bsl-1.0", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 90),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 90),
    ("unlicense", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors\. we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights", 85),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", 88),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff\. if we meet some day, and you think this stuff is worth it, you can buy me a beer in return", 85),
    ("artistic-1.0", r"the artistic license preamble the intent of this document is to state the conditions under which a package may be copied", 88),
    ("artistic-2.0", r"the artistic license 2\.0", 88),
    ("perl", r"under the same terms as perl(?: itself)?", 75),
    ("python-2.0", r"psf license agreement for python", 85),
    ("python-2.0", r"python software foundation license version 2", 88),
    ("ruby", r"you can redistribute it and/or modify it under either the terms of the (?:2-clause bsdl|gpl)", 82),
    ("php-3.01", r"this source file is subject to version 3\.01 of the php license", 92),
    ("postgresql", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", 88),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 60),
    ("openssl", r"licensed under the openssl license", 88),
    ("ms-pl", r"microsoft public license(?: \(ms-pl\))?", 80),
    ("ms-rl", r"microsoft reciprocal license(?: \(ms-rl\))?", 80),
    ("ofl-1.1", r"this font software is licensed under the sil open font license, version 1\.1", 92),
    ("ofl-1.1", r"the fonts and derivatives, however, cannot be released under any other type of license", 80),
    ("eupl-1.2", r"licensed under the eupl,? version 1\.2", 90),
    ("osl-3.0", r"licensed under the open software license version 3\.0", 90),
    ("afl-3.0", r"licensed under the academic free license version 3\.0", 90),
    ("upl-1.0", r"the universal permissive license \(upl\),? version 1\.0", 88),
    ("ncsa", r"university of illinois/ncsa open source license", 88),
    ("w3c", r"w3c(?:®)? software notice and license", 88),
    ("llvm-exception", r"apache license v2\.0 with llvm exceptions", 90),
    ("busl-1.1", r"business source license 1\.1", 88),
    ("sspl-1.0", r"server side public license", 85),
    ("elastic-2.0", r"elastic license 2\.0", 85),
    ("commons-clause", r"commons clause[\"'“”]? license condition", 85),
    ("json", r"the software shall be used for good, not evil\. the software is provided [\"'“”]?as is[\"'“”]?, without warranty", 85),
    ("cc0-1.0", r"to the extent possible under law, (?:the author|the person who associated cc0)", 85),
    ("cc0-1.0", r"has waived all copyright and related or neighboring rights to this work", 84),
    ("cc", r"this work is licensed under (?:a|the) creative commons", 70),
    ("cc-by", r"licensed under (?:a|the) creative commons attribution (?:\d\.\d )?(?:international |unported )?licen[cs]e", 75),
    ("cc-by-sa", r"licensed under (?:a|the) creative commons attribution[- ]share ?-?alike", 78),
    ("cc-by-nc", r"licensed under (?:a|the) creative commons attribution[- ]non-?commercial(?! ?-? ?(?:share|no))", 78),
    ("cc-by-nd", r"licensed under (?:a|the) creative commons attribution[- ]no-?deriv(?:ative)?s", 78),
    ("cc-by-nc-sa", r"licensed under (?:a|the) creative commons attribution[- ]non-?commercial ?-? ?share ?-?alike", 79),
    ("cc-by-nc-nd", r"licensed under (?:a|the) creative commons attribution[- ]non-?commercial ?-? ?no-?deriv(?:ative)?s", 79),
    ("cc", r"by exercising the licensed rights \(defined below\), you accept and agree to be bound by the terms and conditions of this creative commons", 80),
    ("odbl-1.0", r"(?:made available|licensed|available) under the open (?:data commons open )?database license", 88),
    ("odc-by-1.0", r"(?:made available|licensed|available) under the open data commons attribution license", 88),
    ("ogl-uk-3.0", r"open government licen[cs]e v3\.0", 88),
)
#: Fixed values of the base: phrase and label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words of lower-cased text, and the same of any case, as Java's expressions are faster with what a class holds.
WORD, WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[0-9A-Za-z\x80-\x{10FFFF}]+"
#: One of these is in every match of every rule, and in every phrase; none holds a space, as lines may break there.
GATE = ("licen", "spdx", "under", "governed", "subject", "copyright", "rights", "domain", "permission", "redistribut", "proprietary", "unauthori", "warrant", "advertising", "developed", "disassemble", "retain", "exception", "documentation", "copies", "psf", "://")
#: A line break and what marks the next line as a comment, and white space: both are one space to the rules.
MARKS, SPACES = r"\R[ \t]*(?://+!?|/\*+|\*+/?|#+:?|;+|--+|%+|>+|!+|\|+|\.\\\\\"|<!--|dnl\b|rem\b|')(?=\s|\z)", r"[\s\u00a0]+"


FOUND = "array<struct<start int, end int, priority int, rank int, label string>>"


class Rule(NamedTuple):
    label: str
    pattern: str
    priority: int
    keyword: str
    literals: list[str]


def _pieces(pattern: str) -> list[list[str]]:
    """Of each alternative the strings that all of its matches contain."""
    gap = "\0"
    pattern = pattern.replace(r"\(", "\1").replace(r"\)", "\2")
    while (shorter := re.sub(r"\(\?(?::|<?[!=])[^()]*\)\??", gap, pattern)) != pattern:
        pattern = shorter
    pattern = re.sub(r"\[[^\]]*\][?*+]?|\\d|[^\\]\?", gap, pattern).replace("\\", "").replace("\1", "(").replace("\2", ")")
    return [alternative.split(gap) for alternative in pattern.split("|")]


def literals(pattern: str) -> list[str]:
    """Of each alternative the longest string that all of its matches contain."""
    return [max(pieces, key=len) for pieces in _pieces(pattern)]


def gated(pattern: str) -> str:
    """The longest string with a gate word that all matches of a pattern without alternatives contain."""
    return max((p for p in _pieces(pattern)[0] if any(g in p for g in GATE)), key=len, default="")


def rules() -> list[Rule]:
    """All rules, in their order: each license by each template, then the wordings, none of which has alternatives at its top."""
    made = []
    for label, (name, ident, url) in LICENSES.items():
        for template, priority, keyword in TEMPLATES:
            named = [x for mark, part in (("{name}", name), ("{id}", ident), ("{url}", url)) if mark in template for x in literals(part)]
            made.append(Rule(label, template.format(name=name, id=ident, url=url), priority, keyword, named))
    return made + [Rule(label, pattern, priority, gated(pattern), literals(pattern)) for label, pattern, priority in WORDINGS]


def _lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _base(words: Column) -> Column:
    """Array of (label, start) where a phrase's words stand consecutively. All phrases end in `license`."""
    ends = F.filter(F.transform(words, lambda w, i: F.when(w == "license", i)), lambda i: i.isNotNull())

    def hits(label: str, before: list[str]) -> Column:
        n = len(before)
        met = F.filter(ends, lambda i: F.array(*(F.coalesce(F.get(words, i - n + k), F.lit("")) for k in range(n))) == F.array(*map(F.lit, before)))
        return F.transform(met, lambda i: F.struct(F.lit(label).alias("label"), (i - n).cast("long").alias("start")))

    return F.concat(*(hits(label, phrase.split()[:-1]) for phrase, label in PHRASES))


def _found(text: Column, rule: Column) -> Column:
    """Array of (start, end, priority, rank, label) of a rule's matches: what lies between matches gives their places."""
    nothing = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {FOUND})").alias("out"))

    def placed(v: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            start = state["at"] + F.length(F.get(v["between"], k))
            end = start + F.length(F.get(v["matches"], k))
            one = F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["rank"].alias("rank"), rule["label"].alias("label"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        return F.when(F.size(v["matches"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(v["matches"]) - 1), nothing, step, lambda s: s["out"])).otherwise(nothing["out"])

    # an array of one, so that both are evaluated once
    both = F.struct(F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("matches"), F.split(text, rule["pattern"], -1).alias("between"))
    return F.get(F.transform(F.array(both), placed), F.lit(0))


def _kept(found: Column, priorities: list[int]) -> Column:
    """The detections that no other one, of no lower priority, covers.

    In order of (start, longest first, priority, rank) whatever covers a detection comes before it, so the furthest
    end of each priority so far decides.
    """
    ordered = F.transform(
        F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("minus"), (-d["priority"]).alias("less"), d["rank"].alias("rank"), d["label"].alias("label")))),
        lambda d: F.struct(d["start"].alias("start"), (-d["minus"]).alias("end"), (-d["less"]).alias("priority"), d["label"].alias("label")),
    )
    none = F.struct(F.map_from_entries(F.array(*(F.struct(F.lit(p), F.lit(-1)) for p in priorities))).alias("far"), F.expr("cast(array() as array<struct<start int, end int, priority int, label string>>)").alias("out"))

    def step(state: Column, d: Column) -> Column:
        covered = F.exists(F.map_entries(state["far"]), lambda e: (e["key"] >= d["priority"]) & (e["value"] >= d["end"]))
        far = F.transform_values(state["far"], lambda p, end: F.when(p == d["priority"], F.greatest(end, d["end"])).otherwise(end))
        return F.struct(far.alias("far"), F.when(covered, state["out"]).otherwise(F.concat(state["out"], F.array(d))).alias("out"))

    return F.aggregate(ordered, none, step, lambda s: s["out"])


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the detections kept."""
    table = rules()
    keywords = F.array(*map(F.lit, sorted({w for r in table for w in (r.keyword, *r.literals)})))
    literal = F.array(
        *(
            F.struct(F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(k).alias("rank"), F.lit(r.keyword).alias("keyword"), F.array(*map(F.lit, r.literals)).alias("literals"))
            for k, r in enumerate(table)
        )
    )
    text = F.coalesce("text", F.lit(""))
    # lower() changes other letters than A-Z too, but never the gate words
    gate = reduce(Column.__or__, (F.contains("lowered", F.lit(w)) for w in GATE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), text.alias("text"), F.lower(text).alias("lowered"))
    rows = rows.select("doc_id", "n_words", F.when(gate, _lower(F.col("text"))).alias("low"))
    rows = rows.withColumn("folded", F.regexp_replace(F.regexp_replace("low", MARKS, " "), SPACES, " "))
    rows = rows.withColumn("met", F.when(F.col("low").isNotNull(), F.filter(keywords, lambda k: F.contains(F.col("folded"), k))))
    base = F.when(F.contains("low", F.lit("license")), _base(F.regexp_extract_all("low", F.lit(f"({WORD})"), F.lit(1))))
    tried = F.filter(literal, lambda r: F.array_contains(F.col("met"), r["keyword"]) & F.arrays_overlap(F.col("met"), r["literals"]))
    found = F.when(F.size("met") > 0, F.flatten(F.transform(tried, lambda r: _found(F.col("folded"), r))))
    rows = rows.select("doc_id", "n_words", F.coalesce(base, F.expr("cast(array() as array<struct<label string, start long>>)")).alias("base"), F.coalesce(found, F.expr(f"cast(array() as {FOUND})")).alias("found"))
    rows = rows.withColumn("kept", _kept(F.col("found"), sorted({r.priority for r in table})))
    starts = F.transform("base", lambda b: b["start"])
    base_labels = F.transform("base", lambda b: b["label"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda d: d["priority"])) / 100, F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.transform("kept", lambda d: d["label"]))), ",").alias("labels"),
        best.alias("score"),
        F.col("kept").alias("detections"),
    )
