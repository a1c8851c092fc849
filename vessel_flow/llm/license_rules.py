"""License scan by ordered signature rules, with built-in functions only.

A rule is (label, priority, words, pattern), written by hand: passages and
notices, names, short forms.  Its words are read from its pattern and stand in
all that it can match.  A text without any word of a small cover of the rules is
skipped; else the patterns are tried whose words it holds, all of them.
Detections are resolved by intervals, from left to right: sorted by start and
falling length, one that lies inside the one before it is dropped; of equal
intervals and of those that overlap in part the one with the higher priority
stays, then the former.  One with a gap of any length drops only what begins
where it does, so that nothing in the gap is lost.  License identifiers are read
from whole ``SPDX-License-Identifier`` expressions.

Base phrases are counted apart and always give their label.

Everything is local to a row: no shuffle, whatever the skew.  Defined cases:
null and empty texts have no words, labels ('') or places, and score 0.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from .spans import NOT_WORD, WORD, holds_any, let, places, walk, words

BASE = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}

# label | identifier | pattern of the name in running text
_NAMES = r"""
mit|MIT|mit licen[sc]e
mit-0|MIT-0|mit no attribution licen[sc]e
mit-modern|MIT-Modern-Variant|mit modern variant
x11|X11|x11 licen[sc]e
isc|ISC|isc licen[sc]e
apache-1.0|Apache-1.0|apache (software )?licen[sc]e,? (version |v)?1\.0
apache-1.1|Apache-1.1|apache (software )?licen[sc]e,? (version |v)?1\.1
apache-2.0|Apache-2.0|apache (software )?licen[sc]e,? ?\(?(version |v)?2(\.0)?
bsd-2-clause|BSD-2-Clause|(simplified|freebsd|2-clause|two-clause) bsd|bsd[ -](2|two)[ -]clause
bsd-3-clause|BSD-3-Clause|(new|revised|modified|3-clause|three-clause) bsd|bsd[ -](3|three)[ -]clause
bsd-4-clause|BSD-4-Clause|(original|4-clause|four-clause) bsd|bsd[ -](4|four)[ -]clause
bsd-0-clause|0BSD|zero[ -]clause bsd|0bsd
bsd-patent|BSD-2-Clause-Patent|bsd[ +-]+patent
bsd|BSD|bsd licen[sc]e
gpl-1.0|GPL-1.0|gnu general public licen[sc]e,? (version |v)1
gpl-1.0|GPL-1.0|gpl-?v?1(\.0)?
gpl-2.0|GPL-2.0|gnu general public licen[sc]e,? (version |v)2
gpl-2.0|GPL-2.0|gpl-?v?2(\.0)?
gpl-3.0|GPL-3.0|gnu general public licen[sc]e,? (version |v)3
gpl-3.0|GPL-3.0|gpl-?v?3(\.0)?
lgpl-2.0|LGPL-2.0|gnu library general public licen[sc]e
lgpl-2.0|LGPL-2.0|lgpl-?v?2\.0
lgpl-2.1|LGPL-2.1|gnu lesser general public licen[sc]e,? (version |v)2\.1
lgpl-2.1|LGPL-2.1|lgpl-?v?2\.1
lgpl-3.0|LGPL-3.0|gnu lesser general public licen[sc]e,? (version |v)3
lgpl-3.0|LGPL-3.0|lgpl-?v?3(\.0)?
agpl-3.0|AGPL-3.0|gnu affero general public licen[sc]e
agpl-3.0|AGPL-3.0|agpl-?v?3(\.0)?
gfdl-1.2|GFDL-1.2|gnu free documentation licen[sc]e,? (version |v)1\.2
gfdl-1.3|GFDL-1.3|gnu free documentation licen[sc]e,? (version |v)1\.3
gfdl|GFDL|gnu free documentation licen[sc]e
mpl-1.0|MPL-1.0|mozilla public licen[sc]e,? (version |v)?1\.0
mpl-1.1|MPL-1.1|mozilla public licen[sc]e,? (version |v)?1\.1
mpl-2.0|MPL-2.0|mozilla public licen[sc]e,? (version |v)?2(\.0)?
npl-1.0|NPL-1.0|netscape public licen[sc]e
epl-1.0|EPL-1.0|eclipse public licen[sc]e( -)?,? (version |v)?1(\.0)?
epl-2.0|EPL-2.0|eclipse public licen[sc]e( -)?,? (version |v)?2(\.0)?
edl-1.0|EDL-1.0|eclipse distribution licen[sc]e
cddl-1.0|CDDL-1.0|common development and distribution licen[sc]e,? (version |v)?1\.0
cddl-1.1|CDDL-1.1|common development and distribution licen[sc]e,? (version |v)?1\.1
cpl-1.0|CPL-1.0|common public licen[sc]e
cpal-1.0|CPAL-1.0|common public attribution licen[sc]e
ipl-1.0|IPL-1.0|ibm public licen[sc]e
apsl-2.0|APSL-2.0|apple public source licen[sc]e
artistic-1.0|Artistic-1.0|artistic licen[sc]e,? (version |v)?1(\.0)?
artistic-2.0|Artistic-2.0|artistic licen[sc]e,? (version |v)?2(\.0)?
artistic|Artistic|artistic licen[sc]e
boost-1.0|BSL-1.0|boost software licen[sc]e
business-source|BUSL-1.1|business source licen[sc]e
cc0-1.0|CC0-1.0|cc0( 1\.0)?( universal)?
cc-by-1.0|CC-BY-1.0|(creative commons|cc) attribution 1\.0
cc-by-2.0|CC-BY-2.0|(creative commons|cc) attribution 2\.0
cc-by-2.5|CC-BY-2.5|(creative commons|cc) attribution 2\.5
cc-by-3.0|CC-BY-3.0|(creative commons|cc) attribution 3\.0
cc-by-4.0|CC-BY-4.0|(creative commons|cc) attribution 4\.0
cc-by-sa-2.0|CC-BY-SA-2.0|(creative commons|cc) attribution[ -]share ?alike 2\.0
cc-by-sa-3.0|CC-BY-SA-3.0|(creative commons|cc) attribution[ -]share ?alike 3\.0
cc-by-sa-4.0|CC-BY-SA-4.0|(creative commons|cc) attribution[ -]share ?alike 4\.0
cc-by-nc-3.0|CC-BY-NC-3.0|(creative commons|cc) attribution[ -]non ?commercial 3\.0
cc-by-nc-4.0|CC-BY-NC-4.0|(creative commons|cc) attribution[ -]non ?commercial 4\.0
cc-by-nd-4.0|CC-BY-ND-4.0|(creative commons|cc) attribution[ -]no ?deriv\w* 4\.0
cc-by-nc-sa-4.0|CC-BY-NC-SA-4.0|(creative commons|cc) attribution[ -]non ?commercial[ -]share ?alike 4\.0
cc-by-nc-nd-4.0|CC-BY-NC-ND-4.0|(creative commons|cc) attribution[ -]non ?commercial[ -]no ?deriv\w* 4\.0
cc|CC|creative commons licen[sc]e
pddl-1.0|PDDL-1.0|public domain dedication and licen[sc]e
odbl-1.0|ODbL-1.0|open database licen[sc]e
odc-by-1.0|ODC-By-1.0|open data commons attribution licen[sc]e
ogl-uk-3.0|OGL-UK-3.0|open government licen[sc]e
unlicense|Unlicense|the unlicense
wtfpl|WTFPL|do what the f\S+ you want to public licen[sc]e
zlib|Zlib|zlib( ?/ ?libpng)? licen[sc]e
libpng|Libpng|libpng licen[sc]e
ofl-1.1|OFL-1.1|(sil )?open font licen[sc]e
ecl-2.0|ECL-2.0|educational community licen[sc]e
efl-2.0|EFL-2.0|eiffel forum licen[sc]e
eupl-1.1|EUPL-1.1|european union public licen[sc]e,? (version |v\.? ?)?1\.1
eupl-1.2|EUPL-1.2|european union public licen[sc]e,? (version |v\.? ?)?1\.2
cecill-2.1|CECILL-2.1|cecill( free software)? licen[sc]e
cecill-b|CECILL-B|cecill-b
cecill-c|CECILL-C|cecill-c
ms-pl|MS-PL|microsoft public licen[sc]e
ms-rl|MS-RL|microsoft reciprocal licen[sc]e
ms-eula|MS-EULA|microsoft software licen[sc]e terms
ncsa|NCSA|(university of illinois ?/ ?)?ncsa open source licen[sc]e
nasa-1.3|NASA-1.3|nasa open source agreement
ntp|NTP|ntp licen[sc]e
osl-3.0|OSL-3.0|open software licen[sc]e
afl-3.0|AFL-3.0|academic free licen[sc]e
php-3.01|PHP-3.01|php licen[sc]e
postgresql|PostgreSQL|postgresql licen[sc]e
psf-2.0|PSF-2.0|(python software foundation|psf) licen[sc]e
python-2.0|Python-2.0|python licen[sc]e
qpl-1.0|QPL-1.0|q public licen[sc]e
ruby|Ruby|ruby licen[sc]e
sleepycat|Sleepycat|sleepycat licen[sc]e
sspl-1.0|SSPL-1.0|server side public licen[sc]e
elastic-2.0|Elastic-2.0|elastic licen[sc]e
tcl|TCL|tcl ?/ ?tk licen[sc]e
upl-1.0|UPL-1.0|universal permissive licen[sc]e
vim|Vim|vim licen[sc]e
w3c|W3C|w3c software (notice and )?licen[sc]e
watcom-1.0|Watcom-1.0|sybase open watcom public licen[sc]e
xnet|Xnet|x\.net licen[sc]e
zpl-2.1|ZPL-2.1|zope public licen[sc]e
beerware|Beerware|beer-?ware licen[sc]e
blueoak-1.0.0|BlueOak-1.0.0|blue oak model licen[sc]e
json|JSON|json licen[sc]e
curl|curl|curl licen[sc]e
fair|Fair|fair licen[sc]e
hpnd|HPND|historical permission notice and disclaimer
icu|ICU|icu licen[sc]e
ijg|IJG|independent jpeg group licen[sc]e
imagemagick|ImageMagick|imagemagick licen[sc]e
intel|Intel|intel open source licen[sc]e
latex-1.3c|LPPL-1.3c|latex project public licen[sc]e
liliq-p-1.1|LiLiQ-P-1.1|licence libre du qu.bec
lucent-1.02|LPL-1.02|lucent public licen[sc]e
mulan-2.0|MulanPSL-2.0|mulan permissive software licen[sc]e
naist|NAIST-2003|naist licen[sc]e
nokia|Nokia|nokia open source licen[sc]e
openldap-2.8|OLDAP-2.8|openldap public licen[sc]e
openssl|OpenSSL|openssl licen[sc]e
ppl-3.0|PPL-3.0|parity public licen[sc]e
rpl-1.5|RPL-1.5|reciprocal public licen[sc]e
sgi-b-2.0|SGI-B-2.0|sgi free software licen[sc]e b
simpl-2.0|SimPL-2.0|simple public licen[sc]e
sissl|SISSL|sun industry standards source licen[sc]e
spl-1.0|SPL-1.0|sun public licen[sc]e
unicode|Unicode-DFS-2016|unicode(, inc\.)? licen[sc]e agreement
wxwindows|wxWindows|wxwindows library licen[sc]e
yahoo-1.1|YPL-1.1|yahoo!? public licen[sc]e
"""

# label | priority | pattern of a passage that stands in the license or its notice; a <gap> is any text without what is
# before it, and of any length
_PASSAGES = r"""
mit|90|permission is hereby granted, free of charge, to any person obtaining a copy
isc|90|permission to use, copy, modify, and(/or)? distribute this software for any purpose
bsd|85|redistribution and use in source and binary forms
bsd-3-clause|92|neither the name of <gap> may be used to endorse or promote
bsd-4-clause|92|all advertising materials mentioning features or use of this software
gpl|88|this program is free software[:;,] you can redistribute it
lgpl|88|this library is free software[:;,] you can redistribute it
gpl-2.0|91|either version 2 of the licen[sc]e, or
gpl-3.0|91|either version 3 of the licen[sc]e, or
gpl-2.0|91|version 2 only of the licen[sc]e
agpl-3.0|89|remote network interaction; use with the gnu general public licen[sc]e
mpl-2.0|91|this source code form is subject to the terms of the mozilla public licen[sc]e
unlicense|92|this is free and unencumbered software released into the public domain
wtfpl|92|everyone is permitted to copy and distribute verbatim or modified copies
zlib|88|this software is provided 'as-is', without any express or implied warranty
boost-1.0|90|distributed under the boost software licen[sc]e, version 1\.0
public-domain|70|(released|placed|dedicated) (in|into|to) the public domain
public-domain|40|public domain
proprietary|75|copyright <gap> all rights reserved
proprietary|75|confidential and proprietary <gap> licen[sc]e
no-warranty|30|without warranty of any kind
no-warranty|30|without any warranty
no-warranty|35|implied warrant(y|ies) of merchantability
copyright|20|copyright (\(c\) |\xA9 ?)?(19|20)[0-9]{2}
copyleft|25|copyleft
mit|84|the above copyright notice and this permission notice shall be included in all copies
mit|86|subject to the terms of the mit licen[sc]e
apache-2.0|92|licensed under the apache licen[sc]e, version 2\.0
apache-2.0|86|unless required by applicable law or agreed to in writing, software
apache-1.1|88|this product includes software developed by the apache software foundation
bsd|82|redistributions of source code must retain the above copyright notice
bsd|82|redistributions in binary form must reproduce the above copyright notice
bsd|86|use of this source code is governed by a bsd-style licen[sc]e
bsd-4-clause|88|this product includes software developed by the university of california
gpl|80|you should have received a copy of the gnu general public licen[sc]e
lgpl|84|you should have received a copy of the gnu (lesser|library) general public licen[sc]e
agpl-3.0|86|you should have received a copy of the gnu affero general public licen[sc]e
gpl|87|under the terms of the gnu general public licen[sc]e
lgpl|88|under the terms of the gnu (lesser|library) general public licen[sc]e
agpl-3.0|88|under the terms of the gnu affero general public licen[sc]e
gfdl|88|under the terms of the gnu free documentation licen[sc]e
mpl-2.0|90|if a copy of the mpl was not distributed with this file
mpl-1.1|89|the contents of this file are subject to the mozilla public licen[sc]e
cddl-1.0|89|subject to the terms of the common development and distribution licen[sc]e
epl-1.0|86|made available under the terms of the eclipse public licen[sc]e
zlib|86|altered source versions must be plainly marked as such
boost-1.0|91|free of charge, to any person or organization obtaining a copy of the software
hpnd|86|permission to use, copy, modify,? and distribute this software and its documentation for any purpose
postgresql|87|for any purpose, without fee, and without a written agreement is hereby granted
unlicense|91|anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
json|93|the software shall be used for good, not evil
beerware|92|you can buy me a beer in return
ofl-1.1|92|this font software is licensed under the sil open font licen[sc]e
cc0-1.0|90|dedicated the work to the public domain by waiving all of his or her rights
cc-by-4.0|90|licensed under a creative commons attribution 4\.0 international licen[sc]e
cc-by-sa-4.0|90|licensed under a creative commons attribution[ -]share ?alike 4\.0 international licen[sc]e
psf-2.0|90|this licen[sc]e agreement is between the python software foundation
openssl|88|this product includes software developed by the openssl project
ms-pl|86|this licen[sc]e governs use of the accompanying software
elastic-2.0|90|you may not provide the software to third parties as a hosted or managed service
business-source|88|change licen[sc]e: <gap> additional use grant
eupl-1.2|86|licensed under the eupl
artistic-2.0|86|this package is free software; you can redistribute it
proprietary|74|unauthorized (copying|reproduction|use|distribution) of this (file|software|document|material)
proprietary|72|no part of this <gap> may be reproduced
proprietary|70|trade secrets? of
no-warranty|30|provided .as is. without warrant(y|ies) of any kind
no-warranty|32|in no event shall the (authors?|copyright holders?) (or contributors )?be liable
"""

# label | pattern of a short form of the name
_FORMS = r"""
mit|mit[ -]licen[sc]ed
mit|mit/x11
mit|mit[ -]style licen[sc]e
mit|expat licen[sc]e
isc|isc[ -]licen[sc]ed
isc|isc[ -]style licen[sc]e
apache-2.0|apache-?2(\.0)?
apache-2.0|apache (v|version )?2\.0
apache-2.0|asl ?2\.0
apache-1.1|apache (v|version )?1\.1
apache|apache software licen[sc]e
apache|apache[ -]licen[sc]ed
bsd|bsd[ -]licen[sc]ed
bsd|bsd[ -]style licen[sc]e
bsd-2-clause|(2|two)[ -]clause bsd licen[sc]e
bsd-3-clause|(3|three)[ -]clause bsd licen[sc]e
bsd-4-clause|(4|four)[ -]clause bsd licen[sc]e
bsd-3-clause|bsd licen[sc]e \(?(3|three)[ -]clause
bsd-2-clause|bsd licen[sc]e \(?(2|two)[ -]clause
gpl-2.0|gnu gpl,? (version |v\.?)?2(\.0)?
gpl-3.0|gnu gpl,? (version |v\.?)?3(\.0)?
gpl-2.0|gpl,? (version |v\.? ?)2(\.0)?
gpl-3.0|gpl,? (version |v\.? ?)3(\.0)?
gpl-2.0|general public licen[sc]e,? (version |v\.? ?)2
gpl-3.0|general public licen[sc]e,? (version |v\.? ?)3
gpl|gnu gpl
gpl|gpl[ -]licen[sc]ed
gpl|gnu general public licen[sc]e
gpl-2.0|gplv2\+?
gpl-3.0|gplv3\+?
lgpl-2.0|(gnu )?lgpl,? (version |v\.? ?)?2\.0
lgpl-2.1|(gnu )?lgpl,? (version |v\.? ?)?2\.1
lgpl-3.0|(gnu )?lgpl,? (version |v\.? ?)?3(\.0)?
lgpl-2.1|lesser general public licen[sc]e,? (version |v\.? ?)?2\.1
lgpl-3.0|lesser general public licen[sc]e,? (version |v\.? ?)?3
lgpl|gnu lgpl
lgpl|lgpl[ -]licen[sc]ed
lgpl|(gnu )?lesser general public licen[sc]e
lgpl-2.1|lgplv2\.1\+?
lgpl-3.0|lgplv3\+?
agpl-3.0|(gnu )?agpl,? (version |v\.? ?)?3(\.0)?
agpl-3.0|affero general public licen[sc]e,? (version |v\.? ?)?3
agpl-3.0|agplv3\+?
agpl-3.0|affero gpl
gfdl|gnu fdl
gfdl|free documentation licen[sc]e
mpl-1.1|mpl (v|version )?1\.1
mpl-2.0|mpl (v|version )?2(\.0)?
mpl-2.0|mpl-2\.0
mpl|mozilla public licen[sc]e
epl-1.0|epl (v|version )?1(\.0)?
epl-2.0|epl (v|version )?2(\.0)?
epl|eclipse public licen[sc]e
cddl-1.0|cddl (v|version )?1(\.0)?
cddl|common development and distribution licen[sc]e
artistic|perl artistic
boost-1.0|boost licen[sc]e
business-source|bsl 1\.1
business-source|busl-1\.1
sspl-1.0|sspl ?v?1(\.0)?
elastic-2.0|elv2
elastic-2.0|elastic licen[sc]e 2\.0
cc0-1.0|cc-zero
cc0-1.0|creative commons zero
cc-by-2.0|cc-by[ -]2\.0
cc-by-2.5|cc-by[ -]2\.5
cc-by-3.0|cc-by[ -]3\.0
cc-by-4.0|cc-by[ -]4\.0
cc-by-sa-2.0|cc-by-sa[ -]2\.0
cc-by-sa-3.0|cc-by-sa[ -]3\.0
cc-by-sa-4.0|cc-by-sa[ -]4\.0
cc-by-nc-3.0|cc-by-nc[ -]3\.0
cc-by-nc-4.0|cc-by-nc[ -]4\.0
cc-by-nd-4.0|cc-by-nd[ -]4\.0
cc-by-nc-sa-4.0|cc-by-nc-sa[ -]4\.0
cc-by-nc-nd-4.0|cc-by-nc-nd[ -]4\.0
cc-by-4.0|licen[sc]ed? under (a |the )?(terms of the )?cc by 4\.0
cc-by-3.0|licen[sc]ed? under (a |the )?(terms of the )?cc by 3\.0
cc-by-sa-4.0|licen[sc]ed? under (a |the )?(terms of the )?cc by[ -]sa 4\.0
cc-by-sa-3.0|licen[sc]ed? under (a |the )?(terms of the )?cc by[ -]sa 3\.0
cc-by-nc-4.0|licen[sc]ed? under (a |the )?(terms of the )?cc by[ -]nc 4\.0
cc-by-nd-4.0|licen[sc]ed? under (a |the )?(terms of the )?cc by[ -]nd 4\.0
cc|creativecommons\.org/licenses
cc-by-4.0|creativecommons\.org/licenses/by/4\.0
cc-by-sa-4.0|creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0|creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc-4.0|creativecommons\.org/licenses/by-nc/4\.0
cc0-1.0|creativecommons\.org/publicdomain/zero/1\.0
apache-2.0|apache\.org/licenses/license-2\.0
mit|opensource\.org/licen[sc]es?/mit
bsd|opensource\.org/licen[sc]es?/bsd-license
gpl|gnu\.org/licenses/gpl
lgpl|gnu\.org/licenses/lgpl
agpl-3.0|gnu\.org/licenses/agpl
mpl-2.0|mozilla\.org/mpl/2\.0
boost-1.0|boost\.org/license_1_0
unlicense|unlicense\.org
wtfpl|wtfpl
zlib|zlib[ -]licen[sc]ed
eupl-1.2|eupl[ -](v\.? ?)?1\.2
eupl-1.1|eupl[ -](v\.? ?)?1\.1
cecill-2.1|cecill[ -](v\.? ?)?2\.1
psf-2.0|psf[ -]licen[sc]e
python-2.0|python-2\.0
ms-pl|ms-pl
ms-rl|ms-rl
osl-3.0|osl[ -]3\.0
afl-3.0|afl[ -]3\.0
ncsa|uiuc licen[sc]e
odbl-1.0|odbl
pddl-1.0|pddl
beerware|beer-?ware
"""

#: Everything a line says behind the tag; identifiers are told apart by what cannot stand in one.
_SPDX = r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)"


def needed_words(pattern: str) -> list[str]:
    """Lower-case words that stand in every text ``pattern`` matches: what is
    left of it without groups, classes, escapes and optional characters.  Of
    alternatives only words that each of them has."""
    pattern = pattern.lower()
    while (bare := re.sub(r"\((?:[^()\\]|\\.)*\)", "\0", pattern)) != pattern:
        pattern = bare
    runs = []
    for branch in pattern.split("|"):
        for cut in ("<gap>", r"\\x[0-9a-f]{2}|\\.", r"\[[^]]*\]", r".\{[^}]*\}", r".[?*]"):
            branch = re.sub(cut, "\0", branch)
        runs.append(re.findall(r"[a-z0-9][a-z0-9-]+[a-z0-9]", branch))
    return [w for w in dict.fromkeys(runs[0]) if all(any(w in x for x in other) for other in runs[1:])]


#: Words that many texts hold; a gate takes another one where it can.
_COMMON = frozenset("provided software versions terms event agreement public university permission without shall copyright "
                    "this that have received copy source code form file document material product includes".split())


def cover(needs: list[list[str]]) -> list[str]:
    """Words of which each list of ``needs`` holds one, so that a text without
    all of them holds no list whole: the most common one, then rare and long
    ones of the lists that leave the least choice."""
    out = [Counter(w for words in needs for w in words).most_common(1)[0][0]]
    for words in sorted(needs, key=len):
        if not any(g == w or len(g) > 3 and g in w for g in out for w in words):
            out.append(max(words, key=lambda w: (len(w) > 3, w not in _COMMON, len(w))))
    return [g for g in out if not any(h != g and len(h) > 3 and h in g for h in out)]


def gate(low: Column, words: list[str]) -> Column:
    """Does a lower-cased text hold one of ``words``?  Short ones only where a
    word begins: no rule has one elsewhere."""
    short = [w for w in words if len(w) <= 3]
    out = holds_any(low, [w for w in words if len(w) > 3])
    return out | low.rlike("(?<![a-z])(?:" + "|".join(short) + ")") if short else out


def by_gate(table: list[dict], chosen: list[str]) -> list[dict]:
    """The rules under the word of ``chosen`` (their cover) that each of them
    needs, so that a text is asked only for the other words of a few rules."""
    groups: dict[str, list[dict]] = {}
    for r in table:
        key = next(g for g in chosen if any(g == w or len(g) > 3 and g in w for w in r["kws"]))
        groups.setdefault(key, []).append(r)
    return [{"word": g, "rules": rules} for g, rules in groups.items()]


def rule_table() -> list[dict]:
    """All rules in order: passages and notices, names, short forms."""
    out = []

    def add(label: str, priority: int, pattern: str, words: list[str]) -> None:
        opening, gap, _ = pattern.partition("<gap>")
        rx = pattern.replace("<gap>", f"((?!{opening})[\\s\\S])+?")
        # any white space may stand where the pattern has a blank
        rx = rx.replace("[ -]", r"[\s-]+").replace("[ +-]", r"[\s+-]").replace(" ?", r"\s*").replace(" ", r"\s+")
        out.append({"o": len(out), "label": label, "prio": priority, "kws": words, "gap": bool(gap),
                    "rx": "(?i)" + rx.replace("(", "(?:").replace("(?:?", "(?").replace(r"\(?:", r"\(")})

    for line in _PASSAGES.strip().splitlines():
        label, priority, pattern = line.split("|", 2)
        add(label, int(priority), pattern, needed_words(pattern))
    for _, label, pattern in names():
        add(label, 60, f"(?<!\\w)({pattern})(?!\\w)", needed_words(pattern))
    for line in _FORMS.strip().splitlines():
        label, pattern = line.split("|", 1)
        add(label, 58, f"(?<![\\w./-])({pattern})(?![\\w])", needed_words(pattern))
    return out


def names() -> list[list[str]]:
    """[identifier, label, pattern] of every license."""
    return [[ident, label, pattern] for label, ident, pattern in (x.split("|", 2) for x in _NAMES.strip().splitlines())]


def spdx_labels(text: Column) -> Column:
    """Labels of all identifiers in the license expressions of a text."""
    known = {ident.lower(): label for ident, label, _ in names()}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    idents = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_SPDX), F.lit(1)), lambda x: F.split(
        F.lower(x), r"[^a-z0-9.+-]+")))
    bare = F.transform(idents, lambda x: F.regexp_replace(x, r"(-only|-or-later|\+|\.)+$", ""))
    return F.array_distinct(F.filter(F.transform(bare, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull()))


def base_pattern(phrase: tuple[str, ...]) -> str:
    return f"(?i)(?<!{WORD})" + f"{NOT_WORD}+".join(phrase) + f"(?!{WORD})"


def _base(text: Column, low: Column) -> Column:
    """struct(label, n, first, last) of each base phrase; starts count words.
    Only a text that holds the phrase is walked through."""
    none = F.array().cast("array<struct<p:string,m:string,v:string>>")

    def one(label: str, phrase: tuple[str, ...]) -> Column:
        def tell(found: Column) -> Column:
            n = F.size(found)
            ahead = F.aggregate(found, F.lit(0), lambda a, x: a + F.char_length(x["p"]) + F.char_length(x["m"]))
            word_no = lambda part: F.size(words(part)).cast("long")
            last = F.substring(text, F.lit(1), ahead - F.char_length(F.element_at(found, -1)["m"]))
            return F.struct(F.lit(label).alias("label"), n.alias("n"),
                            F.when(n > 0, word_no(found[0]["p"])).alias("first"),
                            F.when(n > 0, word_no(last)).alias("last"))
        pattern = F.lit(base_pattern(phrase))
        held = F.rlike(text, pattern)
        for w in phrase:
            held = F.contains(low, F.lit(w)) & held
        return let(F.when(held, walk(text, pattern)).otherwise(none), tell)
    return F.array(*[one(k, w) for k, w in BASE.items()])


def _detections(text: Column, low: Column, table: list[dict], chosen: list[str]) -> Column:
    """Surviving detections of all rules, in the order of their intervals."""
    groups = F.from_json(F.lit(json.dumps(by_gate(table, chosen))), "array<struct<word:string,rules:array<struct<"
                         "o:int,label:string,prio:int,kws:array<string>,gap:boolean,rx:string>>>>")

    def of_rule(r: Column) -> Column:
        return F.transform(places(text, r["rx"]), lambda x: F.struct(
            x["s"].alias("s"), (x["s"] - x["e"]).alias("len"), (-r["prio"]).alias("prio"), r["o"].alias("o"),
            r["label"].alias("label"), r["gap"].alias("gap")))

    rules = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(low, g["word"])), lambda g: g["rules"]))
    may = F.filter(rules, lambda r: F.forall(r["kws"], lambda w: F.contains(low, w)) & F.rlike(text, r["rx"]))
    found = F.array_sort(F.flatten(F.transform(may, of_rule)))

    none = F.array().cast("array<string>")

    def told(acc: Column) -> Column:
        """The labels with that of the detection that is held back."""
        return F.when(acc["label"].isNull(), acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(acc["label"])))

    def keep(acc: Column, d: Column) -> Column:
        end = d["s"] - d["len"]
        overlaps = (d["s"] < acc["end"]) & acc["label"].isNotNull()
        # of partly overlapping ones the higher priority stays, then the former
        drop = (d["s"] == acc["gap_at"]) | overlaps & ((end <= acc["end"]) | (-d["prio"] <= acc["prio"]))
        taken = F.struct(
            end.alias("end"), acc["gap_at"].alias("gap_at"), (-d["prio"]).alias("prio"), d["label"].alias("label"),
            F.when(overlaps, acc["labels"]).otherwise(told(acc)).alias("labels"),
            F.when(overlaps, acc["best"]).otherwise(F.greatest(acc["best"], acc["prio"])).alias("best"))
        # a detection with a gap drops only what begins where it does
        gap = F.struct(acc["end"].alias("end"), d["s"].alias("gap_at"), acc["prio"].alias("prio"), acc["label"].alias("label"),
                       F.array_union(acc["labels"], F.array(d["label"])).alias("labels"),
                       F.greatest(acc["best"], -d["prio"]).alias("best"))
        return F.when(drop, acc).when(d["gap"], gap).otherwise(taken)

    start = F.struct(F.lit(0).alias("end"), F.lit(-1).alias("gap_at"), F.lit(0).alias("prio"),
                     F.lit(None).cast("string").alias("label"), none.alias("labels"), F.lit(0).alias("best"))
    spdx = spdx_labels(text)
    return let(F.struct(F.aggregate(found, start, keep, lambda acc: F.struct(
        told(acc).alias("labels"), F.greatest(acc["best"], acc["prio"]).alias("best"))).alias("rules"),
        F.when(F.contains(low, F.lit("spdx-license-identifier")), spdx).otherwise(none).alias("spdx")),
        lambda x: F.struct(F.array_union(x["rules"]["labels"], x["spdx"]).alias("labels"),
                           F.when(F.size(x["spdx"]) > 0, 100).otherwise(x["rules"]["best"]).alias("best")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts, places and labels for each row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = rule_table()
    chosen = cover([r["kws"] for r in table] + [list(phrase) for phrase in BASE.values()] + [["spdx-license-identifier"]])
    gated = let(F.lower(text), lambda low: F.when(gate(low, chosen), F.struct(
        _base(text, low).alias("base"), _detections(text, low, table, chosen).alias("rules"))))
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.size(words(text)).cast("long").alias("n_words"), gated.alias("found"))
    hits = F.filter(F.coalesce(F.col("found.base"), F.array().cast(
        "array<struct<label:string,n:int,first:bigint,last:bigint>>")), lambda b: b["n"] > 0)
    rows = rows.select("doc_id", "n_words", hits.alias("hits"), F.col("found.rules").alias("rules"))
    base_labels = F.transform("hits", lambda b: b["label"])
    own = F.coalesce(F.col("rules.labels"), F.array().cast("array<string>"))
    best = F.coalesce(F.col("rules.best"), F.lit(0))
    return rows.select(
        "doc_id", "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("hits", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("hits", lambda b: b["last"])).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        (F.greatest(best, F.when(F.size("hits") > 0, 60).otherwise(0)) / 100).cast("double").alias("score"))
