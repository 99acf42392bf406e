r"""License scans by ordered signature rules.

A text is folded to words (A-Z lower-cased; runs of digits, a-z and anything beyond ASCII), joined by
one space. Each rule is a regular expression over that, with a keyword: only rules whose keyword stands
in one of the text's words are tried, so that joined forms such as gplv2, apache2 and freebsd count. Detections have a priority, that of their rule. From the strongest down,
one that lies within the interval of another that has remained is suppressed, and so is one that overlaps
a remaining one of higher priority; what remains gives the labels.

Rules come from tables of hand-written signatures: names by license, each tried as a bare name, after words
of granting, in an identifier line and in a header line; sentences of licenses' bodies, headers, notices and
addresses; and the identifiers of SPDX expressions.
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

from .words import folded

#: The base phrases with their labels.
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: label: (keyword, signature of the name). Signatures are in folded words; "(?:v|version )?" forms allow both ways of naming versions.
V = r"(?: v| version|,? v)? ?"
SIGNATURES: dict[str, tuple[str, str]] = {
    "apache-1.0": ("apache", r"apache(?: software)?(?: license)?" + V + r"1 0"),
    "apache-1.1": ("apache", r"apache(?: software)?(?: license)?" + V + r"1 1"),
    "apache-2.0": ("apache", r"apache(?: software)?(?: license)?" + V + r"2(?: 0)?"),
    "mit-0": ("mit", r"mit (?:0|no attribution)(?: license)?"),
    "mit": ("mit", r"(?:the )?mit license|mit style license"),
    "x11": ("x11", r"x11(?: license)?"),
    "isc": ("isc", r"isc license"),
    "0bsd": ("bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: license)?"),
    "bsd-1-clause": ("bsd", r"(?:bsd 1 clause|1 clause bsd)(?: license)?"),
    "bsd-2-clause": ("bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)?"),
    "bsd-3-clause": ("bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: license)?"),
    "bsd-4-clause": ("bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: license)?"),
    "bsd": ("bsd", r"bsd (?:style )?license"),
    "gpl-1.0": ("general", r"gnu general public license" + V + r"1(?: 0)?"),
    "gpl-2.0": ("general", r"(?:gnu )?general public license" + V + r"2(?: 0)?"),
    "gpl-3.0": ("general", r"(?:gnu )?general public license" + V + r"3(?: 0)?"),
    "gpl-2.0-id": ("gpl", r"gpl(?: ?v| version)? ?2(?: 0)?(?: only| or later)?"),
    "gpl-3.0-id": ("gpl", r"gpl(?: ?v| version)? ?3(?: 0)?(?: only| or later)?"),
    "gpl": ("general", r"gnu general public license"),
    "lgpl-2.0": ("library", r"gnu library general public license" + V + r"2(?: 0)?"),
    "lgpl-2.1": ("lesser", r"(?:gnu )?lesser general public license" + V + r"2 1"),
    "lgpl-3.0": ("lesser", r"(?:gnu )?lesser general public license" + V + r"3(?: 0)?"),
    "lgpl-2.1-id": ("lgpl", r"lgpl(?: ?v| version)? ?2 1(?: only| or later)?"),
    "lgpl-3.0-id": ("lgpl", r"lgpl(?: ?v| version)? ?3(?: 0)?(?: only| or later)?"),
    "lgpl": ("lesser", r"gnu lesser general public license"),
    "agpl-1.0": ("affero", r"affero general public license" + V + r"1(?: 0)?"),
    "agpl-3.0": ("affero", r"(?:gnu )?affero general public license(?:" + V + r"3(?: 0)?)?"),
    "agpl-3.0-id": ("agpl", r"agpl(?: ?v| version)? ?3(?: 0)?(?: only| or later)?"),
    "gfdl-1.1": ("documentation", r"gnu free documentation license" + V + r"1 1"),
    "gfdl-1.2": ("documentation", r"gnu free documentation license" + V + r"1 2"),
    "gfdl-1.3": ("documentation", r"gnu free documentation license" + V + r"1 3"),
    "mpl-1.0": ("mozilla", r"mozilla public license" + V + r"1 0"),
    "mpl-1.1": ("mozilla", r"mozilla public license" + V + r"1 1"),
    "mpl-2.0": ("mozilla", r"mozilla public license" + V + r"2(?: 0)?"),
    "mpl-2.0-id": ("mpl", r"mpl 2 0"),
    "epl-1.0": ("eclipse", r"eclipse public license" + V + r"1(?: 0)?"),
    "epl-2.0": ("eclipse", r"eclipse public license" + V + r"2(?: 0)?"),
    "edl-1.0": ("eclipse", r"eclipse distribution license" + V + r"1(?: 0)?"),
    "cpl-1.0": ("common", r"common public license" + V + r"1(?: 0)?"),
    "cddl-1.0": ("cddl", r"cddl" + V + r"1 0"),
    "cddl-1.1": ("cddl", r"cddl" + V + r"1 1"),
    "cddl": ("development", r"common development and distribution license"),
    "cc0-1.0": ("cc0", r"cc0(?: 1 0)?(?: universal)?"),
    "cc-by-2.0": ("cc", r"cc by 2 0"),
    "cc-by-3.0": ("cc", r"cc by 3 0"),
    "cc-by-4.0": ("cc", r"cc by 4 0"),
    "cc-by-sa-3.0": ("cc", r"cc by sa 3 0"),
    "cc-by-sa-4.0": ("cc", r"cc by sa 4 0"),
    "cc-by-nc-4.0": ("cc", r"cc by nc 4 0"),
    "cc-by-nd-4.0": ("cc", r"cc by nd 4 0"),
    "cc-by-nc-sa-4.0": ("cc", r"cc by nc sa 4 0"),
    "cc-by-nc-nd-4.0": ("cc", r"cc by nc nd 4 0"),
    "cc-by": ("attribution", r"creative commons attribution(?: license)?"),
    "cc-by-sa": ("sharealike", r"creative commons attribution sharealike"),
    "cc-by-nc": ("noncommercial", r"creative commons attribution noncommercial"),
    "cc-by-nd": ("noderivatives", r"creative commons attribution noderivatives"),
    "unlicense": ("unlicense", r"(?:the )?unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl"),
    "zlib": ("zlib", r"zlib(?: libpng)? license"),
    "libpng": ("libpng", r"libpng license"),
    "bsl-1.0": ("boost", r"boost software license(?:" + V + r"1 0)?"),
    "busl-1.1": ("business", r"business source license(?:" + V + r"1 1)?"),
    "artistic-1.0": ("artistic", r"artistic license" + V + r"1(?: 0)?"),
    "artistic-2.0": ("artistic", r"artistic license" + V + r"2(?: 0)?"),
    "artistic": ("artistic", r"artistic license"),
    "python-2.0": ("python", r"python(?: software foundation)? license(?:" + V + r"2(?: 0)?)?"),
    "php-3.01": ("php", r"php license(?:" + V + r"3 01)?"),
    "ruby": ("ruby", r"ruby license"),
    "postgresql": ("postgresql", r"postgresql license"),
    "openssl": ("openssl", r"openssl license"),
    "ofl-1.1": ("font", r"sil open font license(?:" + V + r"1 1)?"),
    "ms-pl": ("microsoft", r"microsoft public license"),
    "ms-rl": ("microsoft", r"microsoft reciprocal license"),
    "eupl-1.1": ("european", r"european union public licen[cs]e" + V + r"1 1"),
    "eupl-1.2": ("european", r"european union public licen[cs]e" + V + r"1 2"),
    "osl-3.0": ("open", r"open software license" + V + r"3(?: 0)?"),
    "afl-3.0": ("academic", r"academic free license" + V + r"3(?: 0)?"),
    "apsl-2.0": ("apple", r"apple public source license" + V + r"2(?: 0)?"),
    "odbl-1.0": ("database", r"open (?:data commons open )?database license"),
    "odc-by-1.0": ("commons", r"open data commons attribution license"),
    "pddl-1.0": ("dedication", r"public domain dedication and license"),
    "public-domain": ("domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    "ncsa": ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? license"),
    "qpl-1.0": ("q", r"q public license"),
    "sspl-1.0": ("server", r"server side public license"),
    "elastic-2.0": ("elastic", r"elastic license" + V + r"2(?: 0)?"),
    "upl-1.0": ("universal", r"universal permissive license"),
    "vim": ("vim", r"vim license"),
    "w3c": ("w3c", r"w3c(?: software(?: notice)?)?(?: and)? license"),
    "ecl-2.0": ("educational", r"educational community license"),
    "proprietary": ("reserved", r"all rights reserved"),
}
#: label: (keyword, words of the license's own body, header, notice or address), for texts that don't name it, or name it in their own way. A label may stand more than once.
BODIES: tuple[tuple[str, str, str], ...] = (
    # MIT and its kin
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?"),
    ("mit", "deal", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-0", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software (?:[^ ]+ ){1,60}?and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit-modern", "royalty", r"permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software"),
    ("hpnd", "purpose", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted provided that the above copyright notice"),
    ("bsl-1.0", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("ncsa", "restriction", r"to deal with the software without restriction including without limitation"),
    ("unicode", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    # ISC and 0BSD
    ("isc", "distribute", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "distribute", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    # BSD
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:[^ ]+ ){1,20}?may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", r"the names? of (?:[^ ]+ ){1,12}?may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "bsd", r"use of this source code is governed by a bsd style license"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    # Apache
    ("apache-2.0", "compliance", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "apache", r"apache license version 2 0 january 2004"),
    ("apache-2.0", "apache", r"(?:www )?apache org licenses license 2 0"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache", r"this product includes software developed by the apache group for use in the apache http server project"),
    # GNU
    ("gpl-1.0-or-later", "foundation", r"gnu general public license as published by the free software foundation either version 1(?: 0)?(?: of the license)? or at your option any later version"),
    ("gpl-2.0-or-later", "foundation", r"gnu general public license as published by the free software foundation either version 2(?: 0)?(?: of the license)? or at your option any later version"),
    ("gpl-3.0-or-later", "foundation", r"gnu general public license as published by the free software foundation either version 3(?: 0)?(?: of the license)? or at your option any later version"),
    ("gpl-2.0-only", "foundation", r"gnu general public license(?: version 2(?: 0)?)? as published by the free software foundation(?: version 2(?: 0)?(?: of the license)?)?(?! either)"),
    ("gpl-2.0-or-later", "later", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("gpl-3.0-or-later", "later", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("gpl-2.0-only", "only", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)? only"),
    ("gpl-3.0-only", "only", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)? only"),
    ("lgpl-2.0-or-later", "library", r"gnu library general public license as published by the free software foundation either version 2(?: 0)?(?: of the license)? or at your option any later version"),
    ("lgpl-2.1-or-later", "lesser", r"gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or at your option any later version"),
    ("lgpl-3.0-or-later", "lesser", r"gnu lesser general public license as published by the free software foundation either version 3(?: 0)?(?: of the license)? or at your option any later version"),
    ("lgpl-2.1-or-later", "later", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?2 1 or (?:at your option )?(?:any )?later(?: version)?"),
    ("lgpl-3.0-or-later", "later", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("agpl-3.0-or-later", "affero", r"gnu affero general public license as published by the free software foundation either version 3(?: 0)?(?: of the license)? or at your option any later version"),
    ("agpl-3.0-or-later", "later", r"(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("gpl", "designed", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", "copyleft", r"the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation"),
    ("lgpl-2.1", "successor", r"this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license"),
    ("gpl", "warranty", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "library", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-2.0", "gnu", r"(?:www )?gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu", r"(?:www )?gnu org licenses gpl 3 0"),
    ("lgpl-2.1", "gnu", r"(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu", r"(?:www )?gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "gnu", r"(?:www )?gnu org licenses agpl 3 0"),
    ("gfdl-1.3", "gnu", r"(?:www )?gnu org licenses fdl 1 3"),
    ("gpl-classpath-exception", "classpath", r"(?:gpl|general public license)(?: version)?(?: 2)?(?: 0)?(?: only)? with(?: the)? classpath exception"),
    # Mozilla, Eclipse and the like
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", r"eclipse org legal epl (?:v20|2 0)"),
    ("epl-2.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("osl-3.0", "open", r"licensed under the open software license version 3 0"),
    ("afl-3.0", "academic", r"licensed under the academic free license version 3 0"),
    ("ms-pl", "accept", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("artistic-1.0", "artistic", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "establishes", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?: version 1 2| v 1 2| 1 2)"),
    ("eupl-1.1", "eupl", r"licensed under the eupl(?: version 1 1| v 1 1| 1 1)"),
    ("qpl-1.0", "trolltech", r"copyright c 1999(?: 2005)? trolltech as"),
    ("sspl-1.0", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "production", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("commons-clause", "sell", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    # Short permissive notices
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("libpng", "png", r"this copy of the libpng notices is provided for your convenience"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", r"for more information please refer to (?:http|https) unlicense org"),
    ("wtfpl", "fuck", r"do what the fuck you want to public license"),
    ("beerware", "retain", r"as long as you retain this notice you can do whatever you want with this stuff if we meet some day"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("postgresql", "purpose", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("python-2.0", "python", r"python software foundation license version 2"),
    ("python-2.0", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php-3.01", "php", r"this product includes php software freely available from"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"portions of this software are copyright (?:[^ ]+ ){0,8}?the freetype project"),
    ("icu", "icu", r"icu license icu 1 8 1 and later"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "scripts", r"scripts sil org ofl"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("w3c", "w3c", r"this work is being provided by the copyright holders under the following license (?:[^ ]+ ){0,12}?w3c"),
    ("ruby", "verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("sqlite-blessing", "blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("public-domain", "domain", r"this (?:file|work|code|software|program) (?:is|has been) (?:hereby )?(?:placed |released |put )?(?:in|into|to) the public domain"),
    ("public-domain", "dedicates", r"the author (?:hereby )?dedicates (?:this|any and all) (?:[^ ]+ ){0,8}?to the public domain"),
    # Creative Commons and data
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1.0", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc0-1.0", "waived", r"to the extent possible under law (?:[^ ]+ ){1,20}?(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc-by-2.0", "creativecommons", r"creativecommons org licenses by 2 0"), ("cc-by-2.5", "creativecommons", r"creativecommons org licenses by 2 5"), ("cc-by-3.0", "creativecommons", r"creativecommons org licenses by 3 0"), ("cc-by-4.0", "creativecommons", r"creativecommons org licenses by 4 0"),
    ("cc-by-sa-2.0", "creativecommons", r"creativecommons org licenses by sa 2 0"), ("cc-by-sa-2.5", "creativecommons", r"creativecommons org licenses by sa 2 5"), ("cc-by-sa-3.0", "creativecommons", r"creativecommons org licenses by sa 3 0"), ("cc-by-sa-4.0", "creativecommons", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-3.0", "creativecommons", r"creativecommons org licenses by nc 3 0"), ("cc-by-nc-4.0", "creativecommons", r"creativecommons org licenses by nc 4 0"), ("cc-by-nd-4.0", "creativecommons", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-3.0", "creativecommons", r"creativecommons org licenses by nc sa 3 0"), ("cc-by-nc-sa-4.0", "creativecommons", r"creativecommons org licenses by nc sa 4 0"), ("cc-by-nc-nd-4.0", "creativecommons", r"creativecommons org licenses by nc nd 4 0"),
    ("cc-by-4.0", "attribution", r"creative commons attribution 4 0 international"), ("cc-by-sa-4.0", "attribution", r"creative commons attribution share ?alike 4 0 international"), ("cc-by-nc-4.0", "attribution", r"creative commons attribution non ?commercial 4 0 international"),
    ("cc-by-3.0", "attribution", r"creative commons attribution 3 0 unported"), ("cc-by-sa-3.0", "alike", r"creative commons attribution share ?alike 3 0 unported"),
    ("odbl-1.0", "opendatacommons", r"opendatacommons org licenses odbl"), ("odc-by-1.0", "opendatacommons", r"opendatacommons org licenses by"), ("pddl-1.0", "opendatacommons", r"opendatacommons org licenses pddl"),
    ("cdla-permissive-2.0", "community", r"community data license agreement permissive(?: version)? 2 0"), ("cdla-sharing-1.0", "community", r"community data license agreement sharing(?: version)? 1 0"),
    # Addresses of texts
    ("mit", "opensource", r"opensource org licenses? mit"), ("bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause"), ("bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause"), ("apache-2.0", "opensource", r"opensource org licenses? apache 2 0"),
    ("isc", "opensource", r"opensource org licenses? isc"), ("gpl-2.0", "opensource", r"opensource org licenses? gpl 2 0"), ("gpl-3.0", "opensource", r"opensource org licenses? gpl 3 0"), ("zlib", "opensource", r"opensource org licenses? zlib"),
    ("bsl-1.0", "boost", r"boost org license 1 0"), ("elastic-2.0", "elastic", r"elastic co licensing elastic license"), ("sspl-1.0", "mongodb", r"mongodb com licensing server side public license"),
    # Notices that keep rights
    ("proprietary", "confidential", r"this (?:software|file|document|program) (?:is|contains) (?:[^ ]+ ){0,6}?(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "reproduced", r"no part of this (?:publication|work|software|document) may be reproduced"),
    ("commercial", "agreement", r"end user license agreement"),
)
#: Identifiers of the SPDX license list, as they stand behind "SPDX-License-Identifier:", alone or in expressions.
IDENTIFIERS = (
    "0BSD AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause "
    "BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 "
    "CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-2.1 CECILL-B CECILL-C CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 "
    "EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1-or-later GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only "
    "GPL-3.0-or-later HPND ICU IJG ImageMagick IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later Libpng "
    "LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 ODbL-1.0 ODC-By-1.0 OFL-1.1 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby "
    "SISSL Sleepycat SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet Zend-2.0 Zlib ZPL-2.1"
)
#: Ways to name a license: priority, confidence and what stands around the signature.
FORMS = (
    (40, 1.0, r"spdx license identifier {}"),
    (30, 0.95, r"(?:licensed|released|distributed|available|redistributed) (?:under|according to)(?: the)?(?: terms of)?(?: the)? {}"),
    (20, 0.9, r"(?:license|licence|licensed) {}"),
    (10, 0.8, r"{}"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    confidence: float


@cache
def rules() -> dict[bytes, tuple[Rule, ...]]:
    """Rules by keyword, in order. Names with a version precede the bare name of their family."""
    by: dict[bytes, list[Rule]] = {}
    for label, (keyword, signature) in SIGNATURES.items():
        for priority, confidence, form in FORMS:
            pattern = re.compile(rf"(?<= )(?:{form.format(f'(?:{signature})')})(?= )".encode())
            versioned = 5 if re.search(r"\d", label) else 0
            by.setdefault(keyword.encode(), []).append(Rule(label.removesuffix("-id"), keyword.encode(), pattern, priority + versioned, confidence))
    for label, keyword, body in BODIES:
        by.setdefault(keyword.encode(), []).append(Rule(label, keyword.encode(), re.compile(rf"(?<= )(?:{body})(?= )".encode()), 25, 0.9))
    return {k: tuple(v) for k, v in by.items()}


SPDX = b"spdx"


@cache
def _identifiers() -> tuple[re.Pattern, dict[bytes, Rule]]:
    """What finds the next identifier of an expression, and the rule of each in folded words. A + means or later, which folding takes away; so the older names without a form stand for their version."""
    found = {b" ".join(folded(x)): Rule(x.lower(), SPDX, re.compile(b""), 60, 1.0) for x in reversed(IDENTIFIERS.split())}
    names = b"|".join(re.escape(x) for x in sorted(found, key=len, reverse=True))
    return re.compile(rb" (?:(?:or|and|with(?: [^ ]+){1,5}? exception(?: [12](?: [0-9])?)?) )*(" + names + rb")(?= )"), found


def _expressions(line: bytes) -> list[tuple[int, int, Rule]]:
    """A detection for each identifier of each expression behind "SPDX-License-Identifier:"."""
    pattern, known = _identifiers()
    found = []
    for start in re.finditer(rb"(?<= )spdx license identifier(?= )", line):
        at = start.end()
        while m := pattern.match(line, at):
            if found and found[-1][1] == at and b" or " not in m[0] and b" and " not in m[0] and at != start.end():
                break  # two names without a word between them: the expression has ended
            found.append((m.start(1), m.end(1), known[m[1]]))
            at = m.end()
    return found


def _places(text: bytes, phrase: bytes) -> list[int]:
    """Where the phrase's words stand in a folded text that has a space at each end; overlaps count."""
    found, at = [], text.find(b" " + phrase + b" ")
    while at >= 0:
        found.append(at + 1)
        at = text.find(b" " + phrase + b" ", at + 1)
    return found


def resolved(detections: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) that aren't suppressed, in order of their start.

    Stronger ones come first: by priority, then length, then start, then the order of the table.
    """
    kept: list[tuple[int, int, Rule]] = []
    for a, b, rule in sorted(detections, key=lambda d: (-d[2].priority, d[0] - d[1], d[0])):
        if not any((x <= a and b <= y) or (x < b and a < y and r.priority > rule.priority) for x, y, r in kept):
            kept.append((a, b, rule))
    return sorted(kept, key=lambda d: d[:2])


def scanned(text: str | None) -> dict:
    """What a text has: n_words, base places by label, and detections (start and end in words, label, confidence)."""
    words = folded(text)
    known, have = rules(), set(words)
    once = b" ".join(have)
    keywords = {k for k in known if k in once}
    base: list[tuple[int, str]] = []
    found: list[tuple[int, int, Rule]] = []
    if keywords or b"license" in have or SPDX in have:
        line = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        word_at = lambda i: int(np.searchsorted(spaces, i)) - 1
        base = [(word_at(i), label) for phrase, label in BASE.items() for i in _places(line, phrase)]
        groups: list[tuple[int, int, Rule]] = [(*m.span(), rule) for k in sorted(keywords) for rule in known[k] for m in rule.pattern.finditer(line)]
        if SPDX in have:
            groups += _expressions(line)
        groups.sort(key=lambda d: d[:2])
        run: list[tuple[int, int, Rule]] = []
        reach = -1
        for d in groups:  # only detections that overlap, by a chain of others at most, can suppress each other
            if d[0] >= reach:
                found += resolved(run)
                run = []
            run.append(d)
            reach = max(reach, d[1])
        found += resolved(run)
        found = [(word_at(a), word_at(b) + 1, rule) for a, b, rule in found]
    return {"n_words": len(words), "base": base, "detections": [(a, b, r.label, r.confidence) for a, b, r in found]}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    detection = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])
    for batch in batches:
        got = [scanned(x.as_py()) for x in batch.column("text")]
        columns = [pa.array([g["n_words"] for g in got], pa.int64()), pa.array([g["base"] for g in got], pa.list_(place)), pa.array([g["detections"] for g in got], pa.list_(detection))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "base", "detections"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, base (word, label), detections (start, end, label, confidence), labels and score of every row of docs.

    labels are the distinct ones of both, sorted; score is the greatest confidence among the detections,
    0.8 if there are base phrases alone, 0 if there is nothing. A null text has no words. Other columns
    are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(_rows, f"doc_id {kind}, n_words long, base array<struct<word: long, label: string>>, detections array<struct<start: long, end: long, label: string, confidence: double>>")
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base.label"), F.col("detections.label"))))
    score = F.greatest(F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)), F.when(F.size("base") > 0, 0.8).otherwise(0.0))
    return rows.withColumns({"labels": labels, "score": score})
