"""The signature rules of the license scan, in order: label, priority, keyword and pattern.

Patterns run over words: lower case, one blank between words, no punctuation, so ``2.0`` is ``2 0``.
They use no look-around and no capturing groups. The keyword stands in every match.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: 4: a tag or a sentence of the license itself, 3: a name with its version or its address, 2: a name, 1: a mention.
TAG, VERSIONED, NAMED, MENTION = 4, 3, 2, 1
CONFIDENCE = {TAG: 1.0, VERSIONED: 0.9, NAMED: 0.7, MENTION: 0.4}

V = "(?: version| v| ver)?"

TEXTS = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies"),
    ("isc", "permission to use copy modify", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission to use copy modify", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "to endorse or promote products", "neither the name (?:of )?(?:[^ ]+ ){0,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledg?e?ment"),
    ("bsd-3-clause-clear", "no express or implied licenses", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2.0", "licensed under the apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2.0", "you may obtain a copy", "you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0"),
    ("apache-2.0", "terms and conditions for use", "terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-1.1", "this product includes software", "this product includes software developed by the apache software foundation"),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "should have received a copy", "you should have received a copy of the gnu general public license"),
    ("gpl", "any later version", "either version [123] of the license or at your option any later version"),
    ("gpl-2.0", "either version 2 of", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "either version 3 of", "either version 3 of the license or at your option any later version"),
    ("gpl-3.0", "copyleft license for software", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", "freedom to share and change", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "should have received a copy", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-3.0", "incorporates the terms and", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl", "should have received a copy", "you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "cooperation with the community", "specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl", "permission is granted to copy", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "subject to the terms", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "contents of this file are subject", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "contents of this file are subject", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("cddl-1.0", "contents of this file are subject", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1.0", "accompanying program is provided", "the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-2.0", "made available under the terms", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl-1.0", "made available under the terms", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cpl-1.0", "accompanying program is provided", "the accompanying program is provided under the terms of this common public license"),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck", "do what the fuck you want to public license"),
    ("postgresql", "without a written agreement", "without fee and without a written agreement is hereby granted"),
    ("ncsa", "deal with the software", "to deal with the software without restriction including without limitation"),
    ("openssl", "openssl project", "this product includes software developed by the openssl project"),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young"),
    ("python-2.0", "python software foundation", "this license agreement is between the python software foundation"),
    ("artistic-2.0", "everyone is permitted to copy", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms"),
    ("artistic-1.0", "artistic control over", "maintains some semblance of artistic control over the development of the package"),
    ("gpl-family", "everyone is permitted to copy", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("ofl-1.1", "this font software is licensed", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "reserved font name", "with reserved font names?"),
    ("jsonorg", "used for good not evil", "the software shall be used for good not evil"),
    ("beerware", "buy me a beer", "you can buy me a beer in return"),
    ("vim", "vim is charityware", "vim is charityware"),
    ("cc0-1.0", "all copyright and related", "(?:has|have) waived? all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", "no copyright", "the person who associated a work with this deed has dedicated the work to the public domain no copyright"),
    ("cc-by", "attribution you must give", "attribution you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "noncommercial you may not", "noncommercial you may not use the material for commercial purposes"),
    ("cc-by-nd", "noderivatives if you remix", "noderivatives if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", "sharealike if you remix", "sharealike if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("odbl-1.0", "open database license", "this (?:[^ ]+ ){1,6}is made available under the open database license"),
    ("proprietary", "confidential and proprietary", "(?:this (?:software|document|file) is |contains )(?:the )?confidential and proprietary"),
    ("proprietary", "trade secret", "protected by (?:trade secret|copyright and trade secret|copyright law and trade secret)(?: or copyright)? law"),
    ("proprietary", "strictly prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this file)?(?: [^ ]+){0,6} is strictly prohibited"),
    ("proprietary", "end user license agreement", "by (?:installing|using|downloading)(?: [^ ]+){1,10} end user license agreement"),
    ("public-domain", "public domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "(?:this (?:work|text|file|code|document|software) is|is hereby) in the public domain"),
    ("public-domain", "copyright has expired", "copyright has expired(?: in| and)"),
    ("blueoak-1.0.0", "blue oak model", "blue oak model license version 1 0 0"),
    ("elastic-2.0", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "business source license", "business source license 1 1 license text copyright"),
    ("sspl-1.0", "server side public", "server side public license version 1 october 16 2018"),
    ("rail", "use based restrictions", "use based restrictions as referenced in paragraph 5"),
    ("commons-clause", "commons clause", "commons clause license condition v1 0"),
]

NAMES = [
    ("apache-2.0", "apache", f"apache(?: software)? licen[cs]e{V} 2(?: 0)?"),
    ("apache-2.0", "apache", f"apache{V} 2(?: 0)? licen[cs]e"),
    ("apache-2.0", "apache", "apache(?: licen[cs]e)? v2(?: 0)?"),
    ("apache-2.0", "asl", "asl 2 0"),
    ("apache-1.1", "apache", f"apache(?: software)? licen[cs]e{V} 1 1"),
    ("apache-1.0", "apache", f"apache(?: software)? licen[cs]e{V} 1 0"),
    ("gpl-3.0", "general public", f"(?:gnu )?general public licen[cs]e{V} 3(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "general public", f"(?:gnu )?general public licen[cs]e{V} 2(?: 0)?(?: only| or later)?"),
    ("gpl-1.0", "general public", f"(?:gnu )?general public licen[cs]e{V} 1(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? 3(?: 0)?"),
    ("gpl-3.0", "gplv3", "(?:gnu )?gplv3"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? 2(?: 0)?"),
    ("gpl-2.0", "gplv2", "(?:gnu )?gplv2"),
    ("lgpl-3.0", "general public", f"(?:gnu )?lesser general public licen[cs]e{V} 3(?: 0)?"),
    ("lgpl-2.1", "general public", f"(?:gnu )?lesser general public licen[cs]e{V} 2 1"),
    ("lgpl-2.0", "general public", f"(?:gnu )?(?:library|lesser) general public licen[cs]e{V} 2(?: 0)?"),
    ("lgpl-3.0", "lgpl", "lgpl(?: version| v)? 3(?: 0)?"),
    ("lgpl-3.0", "lgplv3", "lgplv3"),
    ("lgpl-2.1", "lgpl", "lgpl(?: version| v)? 2 1"),
    ("lgpl-2.1", "lgplv2", "lgplv2 1"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public licen[cs]e{V} 3(?: 0)?"),
    ("agpl-3.0", "agpl", "agpl(?: version| v)? 3(?: 0)?"),
    ("agpl-3.0", "agplv3", "agplv3"),
    ("gfdl-1.3", "documentation", f"(?:gnu )?free documentation licen[cs]e{V} 1 3"),
    ("gfdl-1.2", "documentation", f"(?:gnu )?free documentation licen[cs]e{V} 1 2"),
    ("gfdl-1.1", "documentation", f"(?:gnu )?free documentation licen[cs]e{V} 1 1"),
    ("bsd-2-clause", "clause", "(?:2|two) clause(?: [^ ]+)? (?:bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", "clause", "(?:bsd|freebsd) (?:2|two) clause(?: licen[cs]e)?"),
    ("bsd-2-clause", "simplified", "simplified bsd licen[cs]e"),
    ("bsd-2-clause", "freebsd", "freebsd licen[cs]e"),
    ("bsd-3-clause", "clause", "(?:3|three) clause(?: [^ ]+)? bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "clause", "bsd (?:3|three) clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd-4-clause", "clause", "(?:4|four) clause(?: [^ ]+)? bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:original|old) bsd licen[cs]e"),
    ("0bsd", "0bsd", "0bsd"),
    ("0bsd", "clause", "(?:0|zero) clause bsd(?: licen[cs]e)?"),
    ("mpl-2.0", "mozilla public", f"mozilla public licen[cs]e{V} 2(?: 0)?"),
    ("mpl-1.1", "mozilla public", f"mozilla public licen[cs]e{V} 1 1"),
    ("mpl-1.0", "mozilla public", f"mozilla public licen[cs]e{V} 1 0"),
    ("mpl-2.0", "mpl", "mpl(?: version| v)? 2(?: 0)?"),
    ("mpl-1.1", "mpl", "mpl(?: version| v)? 1 1"),
    ("epl-2.0", "eclipse public", f"eclipse public licen[cs]e{V} 2(?: 0)?"),
    ("epl-1.0", "eclipse public", f"eclipse public licen[cs]e{V} 1(?: 0)?"),
    ("epl-2.0", "epl", "epl(?: version| v)? 2 0"),
    ("epl-1.0", "epl", "epl(?: version| v)? 1 0"),
    ("cddl-1.1", "distribution", f"common development and distribution licen[cs]e{V} 1 1"),
    ("cddl-1.0", "distribution", f"common development and distribution licen[cs]e{V} 1 0"),
    ("cddl-1.0", "cddl", "cddl(?: version| v)? 1 0"),
    ("eupl-1.2", "european union public", f"european union public licen[cs]e{V} 1 2"),
    ("eupl-1.1", "european union public", f"european union public licen[cs]e{V} 1 1"),
    ("eupl-1.2", "eupl", "eupl(?: version| v)? 1 2"),
    ("eupl-1.1", "eupl", "eupl(?: version| v)? 1 1"),
    ("cecill-2.1", "cecill", "cecill(?: licen[cs]e)?(?: version| v)? 2 1"),
    ("cecill-2.0", "cecill", "cecill(?: licen[cs]e)?(?: version| v)? 2(?: 0)?"),
    ("cecill-b", "cecill", "cecill b(?: licen[cs]e)?"),
    ("cecill-c", "cecill", "cecill c(?: licen[cs]e)?"),
    ("artistic-2.0", "artistic", f"artistic licen[cs]e{V} 2(?: 0)?"),
    ("artistic-1.0", "artistic", f"artistic licen[cs]e{V} 1(?: 0)?"),
    ("osl-3.0", "open software", f"open software licen[cs]e{V} 3(?: 0)?"),
    ("osl-2.1", "open software", f"open software licen[cs]e{V} 2 1"),
    ("afl-3.0", "academic free", f"academic free licen[cs]e{V} 3(?: 0)?"),
    ("afl-2.1", "academic free", f"academic free licen[cs]e{V} 2 1"),
    ("ofl-1.1", "open font", f"(?:sil )?open font licen[cs]e{V} 1 1"),
    ("ofl-1.0", "open font", f"(?:sil )?open font licen[cs]e{V} 1 0"),
    ("bsl-1.0", "boost software", f"boost software licen[cs]e{V} 1(?: 0)?"),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e(?: ms pl)?"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e(?: ms rl)?"),
    ("odbl-1.0", "open database", f"open database licen[cs]e{V}(?: odbl)? 1 0"),
    ("odc-by-1.0", "open data commons", f"open data commons attribution licen[cs]e(?: odc by)?{V}(?: 1 0)?"),
    ("pddl-1.0", "public domain dedication", "(?:open data commons )?public domain dedication and licen[cs]e(?: pddl)?"),
    ("cdla-permissive-2.0", "community data", f"community data licen[cs]e agreement permissive{V} 2(?: 0)?"),
    ("cdla-permissive-1.0", "community data", f"community data licen[cs]e agreement permissive{V} 1(?: 0)?"),
    ("cdla-sharing-1.0", "community data", f"community data licen[cs]e agreement sharing{V} 1(?: 0)?"),
    ("ogl-uk-3.0", "open government", "open government licen[cs]e(?: for public sector information)?(?: version)?(?: v)? ?3(?: 0)?"),
    ("ogl-uk-3.0", "open government", "open government licen[cs]e v3(?: 0)?"),
    ("ogl-uk-2.0", "open government", "open government licen[cs]e(?: version)? v?2(?: 0)?"),
    ("etalab-2.0", "etalab", "(?:licence ouverte )?etalab 2 0"),
    ("elastic-2.0", "elastic", f"elastic licen[cs]e{V} 2(?: 0)?"),
    ("busl-1.1", "business source", f"business source licen[cs]e{V} 1 1"),
    ("sspl-1.0", "server side public", f"server side public licen[cs]e{V} 1"),
    ("python-2.0", "python", "python(?: software foundation)? licen[cs]e(?: agreement)?(?: version)? 2(?: 0)?"),
    ("php-3.01", "php", f"php licen[cs]e{V} 3 01"),
    ("php-3.0", "php", f"php licen[cs]e{V} 3 0"),
    ("zpl-2.1", "zope public", f"zope public licen[cs]e{V} 2 1"),
    ("lppl-1.3c", "latex project", f"latex project public licen[cs]e{V} 1 3c?"),
    ("mulan-psl-2.0", "mulan", f"mulan (?:psl|permissive software licen[cs]e){V} ?v?2"),
    ("upl-1.0", "universal permissive", f"universal permissive licen[cs]e{V} 1 0"),
    ("ecl-2.0", "educational community", f"educational community licen[cs]e{V} 2 0"),
    ("ipl-1.0", "ibm public", f"ibm public licen[cs]e{V} 1 0"),
    ("cpl-1.0", "common public", f"common public licen[cs]e{V} 1 0"),
    ("cpal-1.0", "common public attribution", f"common public attribution licen[cs]e{V} 1 0"),
    ("rpl-1.5", "reciprocal public", f"reciprocal public licen[cs]e{V} 1 5"),
    ("qpl-1.0", "q public", f"q public licen[cs]e{V} 1 0"),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e"),
    ("openrail-m", "openrail", "(?:creativeml |bigscience )?openrail(?: m|m)?(?: licen[cs]e)?"),
    ("bigscience-rail-1.0", "bigscience rail", "bigscience rail licen[cs]e v1 0"),
    ("llama", "community license", "llama (?:[0-9]+ )?(?:[0-9]+ )?community license(?: agreement)?"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons", "creative commons(?: zero| cc0)(?: v)?(?: 1 0)?(?: universal)?"),
    ("cc-pdm", "public domain mark", "(?:creative commons )?public domain mark(?: 1 0)?"),
]

ADDRESSES = [
    ("apache-2.0", "apache org", "apache org licenses license 2 0"),
    ("apache-1.1", "apache org", "apache org licenses license 1 1"),
    ("gpl-3.0", "gnu org", "gnu org licenses gpl 3 0"),
    ("gpl-2.0", "gnu org", "gnu org licenses(?: old licenses)? gpl 2 0"),
    ("lgpl-3.0", "gnu org", "gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", "gnu org", "gnu org licenses(?: old licenses)? lgpl 2 1"),
    ("agpl-3.0", "gnu org", "gnu org licenses agpl 3 0"),
    ("gfdl-1.3", "gnu org", "gnu org licenses fdl 1 3"),
    ("gpl", "gnu org", "gnu org (?:licenses|copyleft) gpl"),
    ("lgpl", "gnu org", "gnu org (?:licenses|copyleft) lgpl"),
    ("mpl-2.0", "mozilla org", "mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org", "mozilla org mpl mpl 1 1"),
    ("epl-2.0", "eclipse org", "eclipse org legal epl (?:v20|2 0)"),
    ("epl-1.0", "eclipse org", "eclipse org legal epl v10"),
    ("mit", "opensource org", "opensource org licenses mit"),
    ("bsd-2-clause", "opensource org", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource org", "opensource org licenses bsd 3 clause"),
    ("isc", "opensource org", "opensource org licenses isc"),
    ("zlib", "opensource org", "opensource org licenses zlib"),
    ("artistic-2.0", "opensource org", "opensource org licenses artistic(?: license)? 2 0"),
    ("ofl-1.1", "scripts sil org", "scripts sil org ofl"),
    ("bsl-1.0", "boost org", "boost org license 1 0"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "wtfpl net", "wtfpl net"),
    ("cc0-1.0", "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "creativecommons org", "creativecommons org publicdomain mark 1 0"),
    ("odbl-1.0", "opendatacommons org", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "opendatacommons org", "opendatacommons org licenses by"),
    ("pddl-1.0", "opendatacommons org", "opendatacommons org licenses pddl"),
    ("ogl-uk-3.0", "nationalarchives", "nationalarchives gov uk doc open government licence version 3"),
    ("eupl-1.2", "joinup ec", "joinup ec europa eu(?: [^ ]+){1,6} eupl"),
    ("elastic-2.0", "elastic co", "elastic co licensing elastic license"),
]

PLAIN_NAMES = [
    ("mit", "expat", "(?:the )?(?:mit )?expat(?: mit)? licen[cs]e"),
    ("mit", "x11", "(?:the )?(?:mit x11|x11 mit) licen[cs]e"),
    ("mit", "mit", "mit licen[cs]ed?"),
    ("mit", "mit", "(?:licen[cs]ed?|released|distributed|available) under(?: the)?(?: terms of)?(?: the)? mit(?: licen[cs]e)?"),
    ("mit", "mit", "licen[cs]e mit"),
    ("apache", "apache", "apache(?: software)? licen[cs]ed?"),
    ("gpl", "general public", "gnu general public licen[cs]e"),
    ("gpl", "gpl", "(?:gnu gpl|gpl licen[cs]ed?)"),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("lgpl", "lgpl", "(?:gnu lgpl|lgpl licen[cs]ed?)"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl", "agpl", "(?:gnu agpl|agpl licen[cs]ed?)"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e"),
    ("gfdl", "gfdl", "gfdl"),
    ("bsd", "bsd", "bsd(?: style| like)? licen[cs]ed?"),
    ("isc", "isc", "isc licen[cs]ed?"),
    ("mpl", "mozilla public", "mozilla public licen[cs]e"),
    ("epl", "eclipse public", "eclipse public licen[cs]e"),
    ("cddl", "cddl", "cddl(?: licen[cs]ed?)?"),
    ("cddl", "distribution", "common development and distribution licen[cs]e"),
    ("eupl", "european union public", "european union public licen[cs]e"),
    ("cecill", "cecill", "cecill(?: licen[cs]e)?"),
    ("artistic", "artistic", "(?:perl )?artistic licen[cs]e"),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e"),
    ("bsl-1.0", "boost", "boost(?: software)? licen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]ed?"),
    ("libpng", "libpng", "libpng licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]ed?"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("beerware", "beerware", "beerware(?: licen[cs]e)?"),
    ("x11", "x11", "x11 licen[cs]e"),
    ("python", "python software foundation", "python software foundation licen[cs]e"),
    ("python", "psf", "psf licen[cs]e"),
    ("php", "php", "php licen[cs]e"),
    ("ruby", "ruby", "ruby licen[cs]e"),
    ("perl", "perl", "same terms as perl(?: itself)?"),
    ("vim", "vim", "vim licen[cs]e"),
    ("curl", "curl", "curl licen[cs]e"),
    ("lppl", "latex project", "latex project public licen[cs]e"),
    ("odbl", "open database", "open database licen[cs]e"),
    ("odbl", "odbl", "odbl"),
    ("ogl", "open government", "open government licen[cs]e"),
    ("etalab", "licence ouverte", "licence ouverte"),
    ("cdla", "community data", "community data licen[cs]e agreement"),
    ("elastic", "elastic", "elastic licen[cs]e"),
    ("busl", "business source", "business source licen[cs]e"),
    ("sspl", "server side public", "server side public licen[cs]e"),
    ("sspl", "sspl", "sspl"),
    ("commons-clause", "commons clause", "commons clause"),
    ("polyform", "polyform", "polyform (?:noncommercial|strict|shield|perimeter|small business|free trial) licen[cs]e"),
    ("mulan", "mulan", "mulan (?:psl|permissive software licen[cs]e)"),
    ("rail", "responsible ai", "responsible ai licen[cs]es?"),
    ("creative-commons", "creative commons", "creative commons(?: licen[cs]ed?)?"),
    ("cc-by", "creative commons", "creative commons attribution(?: licen[cs]e)?"),
    ("copyleft", "copyleft", "copyleft licen[cs]e"),
    ("shareware", "shareware", "(?:is|as|licensed) shareware"),
    ("freeware", "freeware", "(?:is|as|licensed) freeware"),
    ("proprietary", "proprietary", "proprietary(?: software)? licen[cs]e"),
    ("proprietary", "commercial license", "commercial license(?: agreement)?"),
    ("proprietary", "end user license agreement", "end user license agreement"),
    ("proprietary", "eula", "eula"),
]

MENTIONS = [
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("copyright-notice", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]"),
    ("copyright-notice", "copyright", "copyright(?: c)? by [^ ]+"),
    ("license-mention", "licensed under", "licensed under(?: the)?(?: terms of)? [^ ]+"),
    ("license-mention", "released under", "released under the(?: terms of)? (?:[^ ]+ ){1,4}licen[cs]e"),
    ("license-mention", "distributed under", "distributed under the(?: terms of)? (?:[^ ]+ ){1,4}licen[cs]e"),
    ("license-mention", "license agreement", "license agreement"),
    ("license-mention", "license", "see(?: the)? license(?: file| txt| md)"),
    ("license-mention", "spdx license identifier", "spdx license identifier [^ ]+"),
    ("public-domain", "public domain", "public domain"),
    ("warranty-disclaimer", "without warranty", "without warranty of any kind"),
    ("warranty-disclaimer", "without warranties", "without warranties or conditions of any kind"),
    ("warranty-disclaimer", "implied warrant", "(?:express or implied warranties|any implied warranty)"),
    ("warranty-disclaimer", "warranties of merchantability", "implied warranties of merchantability"),
    ("no-reuse", "reproduced", "no part of this (?:publication|book|document|work) may be reproduced"),
    ("no-reuse", "without permission", "(?:copied|reproduced|distributed|republished|redistributed)(?: [^ ]+){0,4} without permission"),
    ("no-reuse", "written permission", "without(?: the)?(?: express| prior)*(?: prior)? written permission"),
    ("no-reuse", "personal use only", "for personal use only"),
    ("no-commercial", "commercial", "(?:for )?non ?commercial (?:use|purposes) only"),
    ("no-commercial", "commercial use", "commercial use is (?:strictly )?(?:prohibited|forbidden|not permitted|not allowed)"),
    ("terms-of-use", "terms of use", "subject to(?: the| our)? terms of use"),
    ("terms-of-use", "terms of service", "subject to(?: the| our)? terms of service"),
]

#: Short identifiers as tags write them.
IDENTIFIERS = (
    "0bsd aal afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-3-clause "
    "bsd-4-clause bsl-1.0 busl-1.1 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.0 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 etalab-2.0 eupl-1.1 eupl-1.2 "
    "ftl gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd icu ijg ipl-1.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 naumen ncsa "
    "odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 rpl-1.5 ruby sleepycat sspl-1.0 tcl unicode-dfs-2016 unlicense upl-1.0 "
    "vim w3c wtfpl x11 zlib zpl-2.1"
).split()

#: The licenses of one family, by what their names add.
COMMONS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


#: What a text must hold before the keywords that stand under it are looked for; ``licen`` goes with every pattern that needs it.
GATES = (
    "licen", "right", "public", "ware", "permi", "warrant", "gpl", "clause", "commons", " org ", " cc ", "terms", "commercial", "advertising", "agreement", "product",
    "reserved", "secret", "prohibited", "reproduced", "restrictions", "proprietary", "remix", "artistic", "cecill", "etalab", "mulan", "openrail", "wtfpl",
    " 0bsd", " apache", " asl ", " buy me ", " cc0", " cddl", " epl", " eula ", " eupl", " gfdl ", " mit", " mpl", " odbl ", " personal use ", " sspl ",
)


def needed(pattern: str) -> str:
    """The pattern's literal pieces that stand in every match, with bars between."""
    inner = re.compile(r"\(\?:[^()]*\)(?:\{[^}]*\}\??|[?*+])?")
    while inner.search(pattern):
        pattern = inner.sub("|", pattern)
    return re.sub(r"\[[^\]]*\][?*+]?|.\?", "|", pattern)


def gate_of(rule: Rule) -> str:
    """The first gate that every match of the rule holds."""
    sure = f"{needed(f' {rule.pattern} ')}|{rule.keyword}"
    return next(g for g in GATES if g in sure)


def words(name: str) -> str:
    return name.replace("-", " ").replace(".", " ")


def _commons() -> list[Rule]:
    """Names, letters and addresses of each license, with each version and without one."""
    out = []
    for short, name in COMMONS.items():
        label, letters = f"cc-{short}", words(short)
        for version in COMMONS_VERSIONS:
            number = words(version)
            out += [
                Rule(f"{label}-{version}", VERSIONED, "cc by", f"cc {letters} {number}"),
                Rule(f"{label}-{version}", VERSIONED, "creative commons", f"creative commons {name}(?: {number} [^ ]+| {number}|(?: international| unported| generic)?(?: public)? licen[cs]e{V} {number})"),
                Rule(f"{label}-{version}", VERSIONED, "creativecommons org", f"creativecommons org licenses {letters} {number}"),
            ]
        if short != "by":
            out += [Rule(label, NAMED, "cc by", f"cc {letters}"), Rule(label, NAMED, "creative commons", f"creative commons {name}(?: licen[cs]e)?")]
        out.append(Rule(label, NAMED, "creativecommons org", f"creativecommons org licenses {letters}"))
    return out


def _tags() -> list[Rule]:
    return [Rule(x, TAG, "spdx license identifier", f"spdx license identifier(?: [^ ]+){{0,8}}? {words(x)}") for x in IDENTIFIERS]


RULES: list[Rule] = [
    *_tags(),
    *(Rule(label, TAG, keyword, pattern) for label, keyword, pattern in TEXTS),
    *(Rule(label, VERSIONED, keyword, pattern) for label, keyword, pattern in [*NAMES, *ADDRESSES]),
    *_commons(),
    *(Rule(label, NAMED, keyword, pattern) for label, keyword, pattern in PLAIN_NAMES),
    *(Rule(label, MENTION, keyword, pattern) for label, keyword, pattern in MENTIONS),
]
