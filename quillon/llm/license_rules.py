"""The ordered signature rules of license scans: label, priority, weight, keywords, regular expression.

Expressions run over a text's words, in lower case with one blank between them, and match whole words.  Of a rule's
keywords (separated by a bar) every match holds at least one, beginning where a word begins, and every keyword holds a word
of GATE; tests expand all expressions to prove both.  Priorities: 100 the base phrases, 95 SPDX lines, 90 sentences of license texts, 85
sentences of license headers, 80 grants by name, 70 pointers, 60 names with a version, 50 names, 30 to 45 notices.
"""

from __future__ import annotations

# Phrases of the base contract with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: A text without a word that begins like one of these (lower case) runs no rule.
GATE = (
    "licen", "unlicen", "sublicen", "spdx", "copyright", "copyleft", "rights reserved", "public domain", "permission", "redistribution", "redistributions", "confidential", "apache", "bsd", "gpl", "lgpl", "agpl", "lesser general", "library general", "affero general", "mozilla", "mpl", "eclipse", "epl",
    "cddl", "eupl", "cc by", "cc0", "creative commons", "wtfpl", "odbl", "odc", "gnu", "fdl", "mit no attribution", "the mit", "under mit", "of mit", "under isc", "the isc", "zlib", "boost", "artistic", "psf", "ofl", "proprietary",
    "merchantability", "warranty", "warranties", "trade secret", "sspl", "polyform", "beerware", "expat", "freebsd", "0bsd", "openrail", "bigscience rail", "commons clause", "patent", "advertising materials", "openssl", "unauthorized copying",
)

RULES = (
    # SPDX lines
    ("mit", 95, 0.98, "spdx", r"spdx license identifier mit"),
    ("mit-0", 95, 0.98, "spdx", r"spdx license identifier mit 0"),
    ("apache-2", 95, 0.98, "spdx", r"spdx license identifier apache 2 0"),
    ("apache-1.1", 95, 0.98, "spdx", r"spdx license identifier apache 1 1"),
    ("apache-2-llvm", 95, 0.98, "spdx", r"spdx license identifier apache 2 0 with llvm exception"),
    ("bsd-2-clause", 95, 0.98, "spdx", r"spdx license identifier bsd 2 clause(?: patent)?"),
    ("bsd-3-clause", 95, 0.98, "spdx", r"spdx license identifier bsd 3 clause(?: clear)?"),
    ("bsd-4-clause", 95, 0.98, "spdx", r"spdx license identifier bsd 4 clause"),
    ("bsd-0-clause", 95, 0.98, "spdx", r"spdx license identifier 0bsd"),
    ("bsd-source", 95, 0.98, "spdx", r"spdx license identifier bsd source code"),
    ("gpl-1", 95, 0.98, "spdx", r"spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2", 95, 0.98, "spdx", r"spdx license identifier gpl 2 0(?: only)?"),
    ("gpl-2-or-later", 95, 0.98, "spdx", r"spdx license identifier gpl 2 0 or later"),
    ("gpl-2-classpath", 95, 0.98, "spdx", r"spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0"),
    ("gpl-3", 95, 0.98, "spdx", r"spdx license identifier gpl 3 0(?: only)?"),
    ("gpl-3-or-later", 95, 0.98, "spdx", r"spdx license identifier gpl 3 0 or later"),
    ("lgpl-2.0", 95, 0.98, "spdx", r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", 95, 0.98, "spdx", r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", 95, 0.98, "spdx", r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3", 95, 0.98, "spdx", r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("fdl-1.3", 95, 0.98, "spdx", r"spdx license identifier gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", 95, 0.98, "spdx", r"spdx license identifier mpl 1 1"),
    ("mpl-2.0", 95, 0.98, "spdx", r"spdx license identifier mpl 2 0(?: no copyleft exception)?"),
    ("epl-1.0", 95, 0.98, "spdx", r"spdx license identifier epl 1 0"),
    ("epl-2.0", 95, 0.98, "spdx", r"spdx license identifier epl 2 0"),
    ("cddl-1.0", 95, 0.98, "spdx", r"spdx license identifier cddl 1 [01]"),
    ("cpl-1.0", 95, 0.98, "spdx", r"spdx license identifier cpl 1 0"),
    ("eupl-1.2", 95, 0.98, "spdx", r"spdx license identifier eupl 1 [12]"),
    ("isc", 95, 0.98, "spdx", r"spdx license identifier isc"),
    ("zlib", 95, 0.98, "spdx", r"spdx license identifier zlib"),
    ("unlicense", 95, 0.98, "spdx", r"spdx license identifier unlicense"),
    ("wtfpl", 95, 0.98, "spdx", r"spdx license identifier wtfpl"),
    ("artistic-2.0", 95, 0.98, "spdx", r"spdx license identifier artistic 2 0"),
    ("artistic-1.0", 95, 0.98, "spdx", r"spdx license identifier artistic 1 0(?: perl)?"),
    ("boost-1.0", 95, 0.98, "spdx", r"spdx license identifier bsl 1 0"),
    ("python-2.0", 95, 0.98, "spdx", r"spdx license identifier (?:python|psf) 2 0"),
    ("cc0", 95, 0.98, "spdx", r"spdx license identifier cc0 1 0"),
    ("cc-by", 95, 0.98, "spdx", r"spdx license identifier cc by [1-4] 0"),
    ("cc-by-sa", 95, 0.98, "spdx", r"spdx license identifier cc by sa [1-4] 0"),
    ("cc-by-nd", 95, 0.98, "spdx", r"spdx license identifier cc by nd [1-4] 0"),
    ("cc-by-nc", 95, 0.98, "spdx", r"spdx license identifier cc by nc [1-4] 0"),
    ("cc-by-nc-sa", 95, 0.98, "spdx", r"spdx license identifier cc by nc sa [1-4] 0"),
    ("cc-by-nc-nd", 95, 0.98, "spdx", r"spdx license identifier cc by nc nd [1-4] 0"),
    ("odbl", 95, 0.98, "spdx", r"spdx license identifier odbl 1 0"),
    ("odc-by", 95, 0.98, "spdx", r"spdx license identifier odc by 1 0"),
    ("ofl-1.1", 95, 0.98, "spdx", r"spdx license identifier ofl 1 1(?: rfn| no rfn)?"),
    ("ms-pl", 95, 0.98, "spdx", r"spdx license identifier ms pl"),
    ("postgresql", 95, 0.98, "spdx", r"spdx license identifier postgresql"),
    ("upl-1.0", 95, 0.98, "spdx", r"spdx license identifier upl 1 0"),
    ("sspl-1.0", 95, 0.98, "spdx", r"spdx license identifier sspl 1 0"),
    ("busl-1.1", 95, 0.98, "spdx", r"spdx license identifier busl 1 1"),
    ("spdx-other", 94, 0.7, "spdx", r"spdx license identifier"),
    # sentences of license texts
    ("mit", 90, 0.97, "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 90, 0.95, "merge publish distribute sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", 89, 0.9, "the above copyright", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit-0", 90, 0.9, "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", 90, 0.96, "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 89, 0.9, "the author disclaims all warranties|the authors disclaim all warranties", r"the author(?: disclaims|s disclaim) all warranties with regard to this software"),
    ("bsd", 90, 0.9, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 89, 0.85, "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 89, 0.85, "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 90, 0.95, "prior written permission", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 90, 0.95, "advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", 90, 0.97, "licensed under the apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", 89, 0.9, "distributed under the license", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 88, 0.85, "grant of patent", r"grant of patent license subject to the terms and conditions of this license"),
    ("gpl", 90, 0.95, "under the terms of the gnu", r"this (?:program|library) is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl", 89, 0.9, "particular purpose see the gnu", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"),
    ("gpl", 88, 0.85, "a copy of the gnu", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license"),
    ("gpl", 88, 0.85, "gnu general public license", r"gnu general public license preamble"),
    ("gpl-3", 88, 0.85, "licensed under the gnu", r"licensed under the gnu general public license is a free copyleft license"),
    ("lgpl", 89, 0.9, "gnu lesser", r"this license the gnu lesser general public license applies to"),
    ("agpl-3", 89, 0.9, "gnu affero", r"the gnu affero general public license is a free copyleft license"),
    ("mpl-2.0", 90, 0.97, "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", 90, 0.95, "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", 90, 0.97, "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0"),
    ("epl-1.0", 90, 0.97, "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1 0"),
    ("cddl-1.0", 90, 0.95, "common development and distribution license", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", 90, 0.95, "express or implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 89, 0.9, "permission is granted to anyone", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", 90, 0.97, "public domain", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 90, 0.97, "public license", r"do what the fuck you want to public license"),
    ("beerware", 90, 0.95, "beerware|the beer ware license", r"(?:the beer ware license revision 42|beerware license revision 42)"),
    ("boost-1.0", 90, 0.95, "permission is hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1.0", 88, 0.9, "boost", r"distributed under the boost software license version 1 0"),
    ("ofl-1.1", 90, 0.95, "font software is licensed", r"this font software is licensed under the sil open font license version 1 1"),
    ("postgresql", 90, 0.9, "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("hpnd", 89, 0.85, "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("cc0", 90, 0.95, "copyright and related", r"waived all copyright and related(?: or neighboring)? rights"),
    ("cc0", 89, 0.9, "cc0", r"cc0 1 0 universal"),
    ("cc-by", 88, 0.9, "creative commons", r"this work is licensed under (?:a|the) creative commons attribution (?:[1-4] 0 )?(?:international |unported )?license"),
    ("cc-by-sa", 88, 0.9, "creative commons", r"this work is licensed under (?:a|the) creative commons attribution share ?alike (?:[1-4] 0 )?(?:international |unported )?license"),
    ("cc-by-nc", 88, 0.9, "creative commons", r"this work is licensed under (?:a|the) creative commons attribution non ?commercial (?:[1-4] 0 )?(?:international |unported )?license"),
    ("cc-by-nd", 88, 0.9, "creative commons", r"this work is licensed under (?:a|the) creative commons attribution no ?derivatives (?:[1-4] 0 )?(?:international |unported )?license"),
    ("cc-by-nc-sa", 88, 0.9, "creative commons", r"this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike (?:[1-4] 0 )?(?:international |unported )?license"),
    ("cc-by-nc-nd", 88, 0.9, "creative commons", r"this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?derivatives (?:[1-4] 0 )?(?:international |unported )?license"),
    ("python-2.0", 89, 0.9, "psf is making", r"psf is making python available to licensee on an as is basis"),
    ("openssl", 89, 0.9, "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("commons-clause", 89, 0.9, "commons clause", r"commons clause license condition v1 0"),
    ("sspl-1.0", 89, 0.95, "server side public license", r"server side public license version 1"),
    ("busl-1.1", 89, 0.95, "business source license", r"business source license (?:version )?1 1"),
    ("elastic-2.0", 89, 0.95, "elastic license", r"elastic license (?:version )?2 0"),
    ("polyform-nc", 89, 0.95, "polyform", r"polyform noncommercial license 1 0 0"),
    # sentences of license headers
    ("gpl-2", 85, 0.95, "general public license", r"under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?"),
    ("gpl-3", 85, 0.95, "general public license", r"under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?"),
    ("lgpl-2.1", 85, 0.95, "lesser general public license", r"under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1(?: of the license)?"),
    ("lgpl-3", 85, 0.95, "lesser general public license", r"under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3(?: of the license)?"),
    ("agpl-3", 85, 0.95, "affero general public license", r"under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3(?: of the license)?"),
    ("fdl-1.3", 85, 0.95, "free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-2", 84, 0.9, "gpl", r"this software may be used and distributed according to the terms of the gpl version 2"),
    ("mit", 84, 0.95, "mit style licen", r"use of this source code is governed by an mit style licen[sc]e"),
    ("bsd", 84, 0.95, "bsd", r"use of this source code is governed by a bsd style licen[sc]e"),
    ("apache-2", 84, 0.95, "apache", r"use of this source code is governed by (?:an|the) apache 2 0 licen[sc]e"),
    ("eupl-1.2", 85, 0.95, "eupl", r"licensed under the eupl version 1 [12](?: or later)?"),
    ("eupl-1.2", 80, 0.9, "eupl", r"under (?:the )?(?:terms of the )?eupl(?: version| v)?(?: 1 [12])?"),
    ("ecl-2.0", 84, 0.9, "educational community license", r"licensed under the educational community license version 2 0"),
    ("upl-1.0", 84, 0.9, "universal permissive license", r"licensed under the universal permissive license v 1 0"),
    ("osl-3.0", 84, 0.9, "open software license", r"licensed under the open software license version 3 0"),
    ("afl-3.0", 84, 0.9, "academic free license", r"licensed under the academic free license version 3 0"),
    ("ncsa", 84, 0.9, "illinois ncsa open source license", r"university of illinois ncsa open source license"),
    ("ms-pl", 84, 0.9, "microsoft public license", r"microsoft public license(?: ms pl)?"),
    ("ms-rl", 84, 0.9, "microsoft reciprocal license", r"microsoft reciprocal license(?: ms rl)?"),
    # grants by name
    ("mit", 80, 0.95, "under mit|under the mit|of mit|of the mit", r"under (?:the )?(?:terms of (?:the )?)?mit(?: x11)?(?: style)?(?: licen[sc]e| terms)?"),
    ("mit", 80, 0.95, "licensed mit|license mit", r"(?:licensed|license) mit"),
    ("mit", 80, 0.95, "the mit", r"(?:subject to|governed by|covered by) the mit licen[sc]e"),
    ("mit", 78, 0.9, "expat", r"under (?:the )?expat(?: licen[sc]e| terms)?"),
    ("mit-0", 81, 0.95, "mit no attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("apache-2", 80, 0.95, "apache", r"under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?v?2(?: 0)?"),
    ("apache", 78, 0.9, "apache", r"under (?:the )?(?:terms of (?:the )?)?apache licen[sc]e"),
    ("apache-2", 79, 0.9, "apache", r"apache licen[sc]ed?"),
    ("apache-1.1", 80, 0.95, "apache", r"under (?:the )?apache software licen[sc]e version 1 1"),
    ("bsd", 78, 0.9, "bsd", r"under (?:the )?(?:terms of (?:the |a )?)?(?:a )?bsd(?: style)?(?: licen[sc]e| terms)?"),
    ("bsd-2-clause", 80, 0.95, "bsd", r"under (?:the )?(?:terms of (?:the )?)?(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e| terms)?"),
    ("bsd-3-clause", 80, 0.95, "bsd", r"under (?:the )?(?:terms of (?:the )?)?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e| terms)?"),
    ("gpl", 78, 0.9, "gpl|gnu gpl", r"under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl"),
    ("gpl-2", 80, 0.95, "gpl", r"under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?(?:version |v)?2(?: 0)?"),
    ("gpl-3", 80, 0.95, "gpl", r"under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?(?:version |v)?3(?: 0)?"),
    ("gpl", 78, 0.9, "general public license|general public licence", r"under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e"),
    ("gpl-2", 80, 0.95, "general public license|general public licence", r"under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e ?(?:version |v)?2(?: 0)?"),
    ("gpl-3", 80, 0.95, "general public license|general public licence", r"under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e ?(?:version |v)?3(?: 0)?"),
    ("lgpl", 80, 0.9, "lgpl", r"under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl(?: licen[sc]e)?"),
    ("lgpl", 80, 0.9, "lesser general", r"under (?:the )?(?:terms of (?:the )?)?gnu lesser general public licen[sc]e"),
    ("agpl-3", 80, 0.95, "agpl", r"under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl ?(?:version |v)?3(?: 0)?"),
    ("agpl", 79, 0.9, "agpl|affero general", r"under (?:the )?(?:gnu )?(?:agpl|affero general public licen[sc]e)"),
    ("mpl-2.0", 80, 0.95, "mpl|mozilla", r"under (?:the )?(?:terms of (?:the )?)?(?:mpl|mozilla public licen[sc]e)(?: version| v)? ?v?2(?: 0)?"),
    ("mpl", 78, 0.9, "mpl|mozilla", r"under (?:the )?(?:terms of (?:the )?)?(?:mpl|mozilla public licen[sc]e)"),
    ("epl-2.0", 80, 0.95, "epl|eclipse", r"under (?:the )?(?:terms of (?:the )?)?(?:epl|eclipse public licen[sc]e)(?: version| v)? ?v?2(?: 0)?"),
    ("epl", 78, 0.9, "epl|eclipse", r"under (?:the )?(?:terms of (?:the )?)?(?:epl|eclipse public licen[sc]e)"),
    ("cddl-1.0", 80, 0.9, "cddl", r"under (?:the )?(?:terms of (?:the )?)?cddl(?: 1 [01])?"),
    ("isc", 80, 0.95, "under isc|the isc", r"under (?:the )?isc(?: licen[sc]e| terms)?"),
    ("zlib", 80, 0.95, "zlib", r"under (?:the )?zlib(?: libpng)?(?: licen[sc]e| terms)?"),
    ("wtfpl", 80, 0.95, "wtfpl", r"under (?:the )?(?:terms of (?:the )?)?wtfpl"),
    ("unlicense", 80, 0.95, "unlicense", r"under (?:the )?unlicense"),
    ("artistic", 80, 0.9, "artistic", r"under (?:the )?(?:terms of (?:the )?)?artistic licen[sc]e(?: 2 0| version 2 0)?"),
    ("perl", 80, 0.85, "licensed under the same terms", r"licensed under the same terms as perl itself"),
    ("boost-1.0", 80, 0.95, "boost", r"under (?:the )?boost(?: software)? licen[sc]e"),
    ("python-2.0", 80, 0.95, "python software foundation license|psf", r"under (?:the )?(?:python software foundation license|psf licen[sc]e)"),
    ("cc0", 80, 0.95, "cc0", r"under (?:the )?(?:terms of )?(?:the )?cc0(?: licen[sc]e)?(?: 1 0)?"),
    ("cc-by", 80, 0.95, "cc by", r"under (?:the |a )?(?:terms of )?(?:the )?cc by(?: licen[sc]e)?(?: [1-4] 0)?"),
    ("cc-by-sa", 80, 0.95, "cc by", r"under (?:the |a )?(?:terms of )?(?:the )?cc by sa(?: licen[sc]e)?(?: [1-4] 0)?"),
    ("cc-by-nd", 80, 0.95, "cc by", r"under (?:the |a )?(?:terms of )?(?:the )?cc by nd(?: licen[sc]e)?(?: [1-4] 0)?"),
    ("cc-by-nc", 80, 0.95, "cc by", r"under (?:the |a )?(?:terms of )?(?:the )?cc by nc(?: licen[sc]e)?(?: [1-4] 0)?"),
    ("cc-by-nc-sa", 80, 0.95, "cc by", r"under (?:the |a )?(?:terms of )?(?:the )?cc by nc sa(?: licen[sc]e)?(?: [1-4] 0)?"),
    ("cc-by-nc-nd", 80, 0.95, "cc by", r"under (?:the |a )?(?:terms of )?(?:the )?cc by nc nd(?: licen[sc]e)?(?: [1-4] 0)?"),
    ("odbl", 80, 0.95, "odbl|open database license|open database licence", r"under (?:the )?(?:odbl|open database licen[sc]e)(?: 1 0)?"),
    ("odc-by", 80, 0.95, "odc", r"under (?:the )?odc by(?: licen[sc]e)?(?: 1 0)?"),
    ("ofl-1.1", 80, 0.95, "ofl|open font license|open font licence", r"under (?:the )?(?:sil )?(?:ofl|open font licen[sc]e)(?: version)?(?: 1 1)?"),
    ("openrail", 80, 0.95, "openrail|creativeml openrail|bigscience rail", r"under (?:the )?(?:creativeml )?(?:openrail|bigscience rail)(?: m)?(?: licen[sc]e)?"),
    ("sspl-1.0", 80, 0.95, "sspl", r"under (?:the )?sspl(?: v?1(?: 0)?)?"),
    ("public-domain", 80, 0.9, "public domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 79, 0.85, "public domain", r"(?:is|are) in the public domain"),
    # pointers
    ("apache-2", 70, 0.85, "apache", r"apache org licenses license 2 0"),
    ("gpl", 70, 0.85, "gnu org licenses", r"gnu org licenses gpl(?: 2 0| 3 0)?(?: html| txt)?"),
    ("lgpl", 70, 0.85, "gnu org licenses", r"gnu org licenses lgpl(?: 2 1| 3 0)?(?: html| txt)?"),
    ("agpl", 70, 0.85, "gnu org licenses", r"gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("mit", 70, 0.85, "opensource org licenses", r"opensource org licenses mit(?: license php)?"),
    ("bsd-3-clause", 70, 0.85, "opensource org licenses", r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", 70, 0.85, "opensource org licenses", r"opensource org licenses bsd 2 clause"),
    ("isc", 70, 0.85, "opensource org licenses", r"opensource org licenses isc"),
    ("mpl-2.0", 70, 0.85, "mozilla", r"mozilla org mpl 2 0"),
    ("mpl-1.1", 70, 0.85, "mozilla", r"mozilla org mpl 1 1"),
    ("epl-2.0", 70, 0.85, "eclipse", r"eclipse org legal epl 2 0"),
    ("epl-1.0", 70, 0.85, "eclipse", r"eclipse org legal epl v10(?: html)?"),
    ("cc-by", 70, 0.85, "licenses by", r"creativecommons org licenses by [1-4] 0"),
    ("cc-by-sa", 70, 0.85, "licenses by", r"creativecommons org licenses by sa [1-4] 0"),
    ("cc-by-nc", 70, 0.85, "licenses by", r"creativecommons org licenses by nc [1-4] 0"),
    ("cc-by-nd", 70, 0.85, "licenses by", r"creativecommons org licenses by nd [1-4] 0"),
    ("cc-by-nc-sa", 70, 0.85, "licenses by", r"creativecommons org licenses by nc sa [1-4] 0"),
    ("cc-by-nc-nd", 70, 0.85, "licenses by", r"creativecommons org licenses by nc nd [1-4] 0"),
    ("cc0", 70, 0.85, "publicdomain zero 1 0 licen", r"creativecommons org publicdomain zero 1 0 licen[sc]e"),
    ("unlicense", 70, 0.85, "unlicense", r"unlicense org"),
    ("boost-1.0", 70, 0.85, "boost", r"boost org license 1 0 txt"),
    ("see-license-file", 65, 0.6, "the license|the licence|licensing|license file|licence file", r"see (?:the )?(?:license|licence|licensing) file(?: for (?:more )?details)?"),
    ("see-license-file", 65, 0.6, "license for|licence for", r"(?:see|refer to) (?:the )?licen[sc]e for (?:more )?details"),
    # names with a version
    ("apache-1.1", 60, 0.85, "apache", r"apache(?: software)? licen[sc]e(?: version)? 1 1"),
    ("apache-1.0", 60, 0.85, "apache", r"apache(?: software)? licen[sc]e(?: version)? 1 0"),
    ("apache-2", 60, 0.85, "apache", r"apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?v?2 0"),
    ("apache-2", 60, 0.85, "asl 2 0 licen|al2 licen", r"(?:asl 2 0|al2) licen[sc]e"),
    ("gpl-1", 60, 0.85, "gpl|general public license|general public licence", r"(?:gpl|general public licen[sc]e) ?(?:version |v)?1(?: 0)?"),
    ("gpl-2", 60, 0.85, "gpl", r"gpl ?(?:version |v)?2(?: 0)?(?: or later| only)?"),
    ("gpl-3", 60, 0.85, "gpl", r"gpl ?(?:version |v)?3(?: 0)?(?: or later| only)?"),
    ("gpl-2", 60, 0.85, "gplv2", r"gplv2"),
    ("gpl-3", 60, 0.85, "gplv3", r"gplv3"),
    ("gpl-2", 60, 0.85, "general public license|general public licence", r"general public licen[sc]e ?(?:version |v)?2(?: 0)?"),
    ("gpl-3", 60, 0.85, "general public license|general public licence", r"general public licen[sc]e ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2.0", 60, 0.85, "lgpl|library general", r"(?:lgpl|library general public licen[sc]e) ?(?:version |v)?2(?: 0)?"),
    ("lgpl-2.1", 60, 0.85, "lgpl|lesser general", r"(?:lgpl|lesser general public licen[sc]e) ?(?:version |v)?2 1"),
    ("lgpl-3", 60, 0.85, "lgpl|lesser general", r"(?:lgpl|lesser general public licen[sc]e) ?(?:version |v)?3(?: 0)?"),
    ("agpl-3", 60, 0.85, "agpl|affero general", r"(?:agpl|affero general public licen[sc]e) ?(?:version |v)?3(?: 0)?"),
    ("agpl-3", 60, 0.85, "agplv3", r"agplv3"),
    ("fdl-1.3", 60, 0.85, "fdl|free documentation license|free documentation licence", r"(?:fdl|free documentation licen[sc]e)(?: version| v)? ?1 [123]"),
    ("mpl-1.1", 60, 0.85, "mozilla|mpl", r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?v?1 1"),
    ("mpl-2.0", 60, 0.85, "mozilla|mpl", r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?v?2(?: 0)?"),
    ("epl-1.0", 60, 0.85, "eclipse|epl", r"(?:eclipse public licen[sc]e|epl)(?: version| v)? ?v?1(?: 0)?"),
    ("epl-2.0", 60, 0.85, "eclipse|epl", r"(?:eclipse public licen[sc]e|epl)(?: version| v)? ?v?2(?: 0)?"),
    ("cddl-1.0", 60, 0.85, "cddl|common development and distribution license", r"(?:cddl|common development and distribution license)(?: version)? ?v?1 [01]"),
    ("eupl-1.2", 60, 0.85, "eupl|european union public license|european union public licence", r"(?:eupl|european union public licen[sc]e)(?: version| v)? ?v?1 [12]"),
    ("artistic-2.0", 60, 0.85, "artistic", r"artistic licen[sc]e (?:version )?2(?: 0)?"),
    ("artistic-1.0", 60, 0.85, "artistic", r"artistic licen[sc]e (?:version )?1(?: 0)?"),
    ("boost-1.0", 60, 0.85, "boost", r"boost software licen[sc]e(?: version)? ?v?1(?: 0)?"),
    ("ofl-1.1", 60, 0.85, "open font license|open font licence|ofl", r"(?:sil )?(?:open font licen[sc]e|ofl)(?: version| v)? ?v?1 1"),
    ("cc-by", 60, 0.85, "creative commons|cc by", r"(?:creative commons attribution|cc by) [1-4] 0"),
    ("cc-by-sa", 60, 0.85, "creative commons|cc by", r"(?:creative commons attribution share ?alike|cc by sa) [1-4] 0"),
    ("cc-by-nd", 60, 0.85, "creative commons|cc by", r"(?:creative commons attribution no ?derivatives|cc by nd) [1-4] 0"),
    ("cc-by-nc", 60, 0.85, "creative commons|cc by", r"(?:creative commons attribution non ?commercial|cc by nc) [1-4] 0"),
    ("cc-by-nc-sa", 60, 0.85, "creative commons|cc by", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa) [1-4] 0"),
    ("cc-by-nc-nd", 60, 0.85, "creative commons|cc by", r"(?:creative commons attribution non ?commercial no ?derivatives|cc by nc nd) [1-4] 0"),
    # names
    ("mit", 50, 0.8, "mit licen", r"mit licen[sc]e[ds]?"),
    ("mit", 50, 0.75, "expat licen|x11 licen", r"(?:expat|x11) licen[sc]e"),
    ("bsd-2-clause", 55, 0.85, "bsd|freebsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e| terms)"),
    ("bsd-3-clause", 55, 0.85, "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e| terms)"),
    ("bsd-4-clause", 55, 0.85, "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e| terms)"),
    ("bsd-0-clause", 55, 0.85, "bsd|0bsd", r"(?:zero clause bsd|0bsd|bsd zero clause)(?: licen[sc]e)?"),
    ("bsd", 50, 0.75, "bsd", r"bsd(?: style)? licen[sc]e[ds]?"),
    ("gpl", 50, 0.75, "gnu general public", r"gnu general public licen[sc]e"),
    ("gpl", 50, 0.7, "gpl licen|gnu gpl", r"(?:gpl licen[sc]e[ds]?|gnu gpl)"),
    ("lgpl", 50, 0.75, "lesser general public|library general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lgpl", 50, 0.7, "lgpl", r"(?:gnu lgpl|lgpl licen[sc]e[ds]?)"),
    ("agpl", 50, 0.75, "affero general public", r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl", 50, 0.7, "agpl", r"(?:gnu agpl|agpl licen[sc]e[ds]?)"),
    ("fdl", 50, 0.75, "gnu free documentation", r"gnu free documentation licen[sc]e"),
    ("mpl", 50, 0.75, "mozilla public", r"mozilla public licen[sc]e"),
    ("epl", 50, 0.75, "eclipse public", r"eclipse public licen[sc]e"),
    ("eupl", 50, 0.75, "european union public license|european union public licence", r"european union public licen[sc]e"),
    ("cddl", 50, 0.75, "common development and distribution license", r"common development and distribution license"),
    ("isc", 50, 0.75, "isc licen|internet systems consortium licen", r"(?:isc|internet systems consortium) licen[sc]e"),
    ("zlib", 50, 0.75, "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("unlicense", 50, 0.75, "the unlicense", r"the unlicense"),
    ("wtfpl", 50, 0.75, "wtfpl", r"wtfpl"),
    ("artistic", 50, 0.7, "artistic", r"artistic licen[sc]e"),
    ("boost", 50, 0.75, "boost", r"boost software licen[sc]e"),
    ("python-2.0", 50, 0.75, "python software foundation license|psf", r"(?:python software foundation license|psf licen[sc]e)"),
    ("ofl", 50, 0.75, "open font license|open font licence", r"(?:sil )?open font licen[sc]e"),
    ("cc0", 50, 0.75, "creative commons zero|cc0", r"(?:creative commons zero|cc0)(?: licen[sc]e)?"),
    ("cc-by-sa", 50, 0.75, "cc by", r"cc by sa"),
    ("cc-by-nd", 50, 0.75, "cc by", r"cc by nd"),
    ("cc-by-nc-sa", 50, 0.75, "cc by", r"cc by nc sa"),
    ("cc-by-nc-nd", 50, 0.75, "cc by", r"cc by nc nd"),
    ("cc-by", 48, 0.7, "cc by", r"cc by"),
    ("creative-commons", 46, 0.6, "creative commons", r"creative commons(?: licen[sc]e)?"),
    ("odbl", 50, 0.75, "open database license|open database licence", r"open database licen[sc]e"),
    ("odc-by", 50, 0.75, "open data commons attribution license", r"open data commons attribution license"),
    ("openrail", 50, 0.75, "openrail|creativeml openrail", r"(?:creativeml )?openrail(?: m)?"),
    ("polyform", 50, 0.75, "polyform", r"polyform (?:noncommercial|strict|shield|perimeter|small business)"),
    ("commons-clause", 50, 0.7, "commons clause", r"commons clause"),
    ("copyleft", 35, 0.5, "copyleft", r"copyleft"),
    # notices
    ("all-rights-reserved", 40, 0.9, "rights reserved|all rights reserved", r"all rights reserved"),
    ("some-rights-reserved", 40, 0.8, "some rights reserved", r"some rights reserved"),
    ("copyright", 30, 0.6, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("copyright", 29, 0.5, "copyright", r"copyright(?: c)? by"),
    ("copyright", 29, 0.5, "copyrighted material", r"copyrighted material"),
    ("public-domain", 45, 0.7, "public domain", r"public domain dedication"),
    ("proprietary", 45, 0.8, "proprietary and confidential|confidential and proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 44, 0.8, "trade secret|trade secrets", r"contains trade secrets?"),
    ("proprietary", 44, 0.7, "proprietary licen", r"proprietary licen[sc]e"),
    ("proprietary", 43, 0.75, "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("no-redistribution", 43, 0.8, "redistribution", r"redistribution (?:is )?(?:not permitted|prohibited|strictly prohibited)"),
    ("no-redistribution", 43, 0.75, "without permission|without written permission|without prior permission|without prior written permission", r"may not be (?:reproduced|copied|redistributed|distributed) without (?:prior )?(?:written )?permission"),
    ("noncommercial", 42, 0.7, "noncommercial licen|non commercial licen", r"(?:noncommercial|non commercial) licen[sc]e"),
    ("commercial", 42, 0.7, "commercial licen", r"commercial licen[sc]e"),
    ("dual-license", 42, 0.6, "dual licen|dually licen", r"(?:dual|dually) licen[sc]ed?"),
    ("open-source", 38, 0.5, "open source licen", r"open source licen[sc]e"),
    ("shareware", 38, 0.5, "shareware licen|freeware licen", r"(?:shareware|freeware) licen[sc]e"),
    ("eula", 40, 0.7, "end user license|end user licence", r"end user licen[sc]e agreement"),
    ("warranty-disclaimer", 34, 0.5, "warranty|warranties", r"without warrant(?:y|ies) (?:or conditions )?of any kind"),
    ("warranty-disclaimer", 34, 0.5, "merchantability", r"merchantability (?:and|or) fitness for a particular purpose"),
    ("patent-grant", 34, 0.5, "patent licen", r"patent licen[sc]e"),
)
