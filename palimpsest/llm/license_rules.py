"""Signature rules for license notices, written over normalised text: lower-case words joined by single spaces.

Each line is a label, a gate (words of which every match of the label's rules has one) and the label's own
patterns by kind, in the order of priority: ``tag`` identifiers, ``notice`` grants and sentences of the text,
``name`` full names, ``url`` addresses. Earlier lines win ties. ``|`` separates patterns of a kind.
"""

from __future__ import annotations

FAMILIES = r"""
agpl-3.0 ~ agpl|affero|agplv3|agpl3 ~ tag: agpl 3 0(?: only| or later)? ~ notice: gnu affero general public license(?: as published by the free software foundation)?(?: either)? version 3|licensed under (?:the )?agpl ?v?3 ~ name: gnu affero general public license v(?:ersion )?3|agplv3 ~ url: gnu org licenses agpl(?: 3 0)?
agpl-1.0 ~ affero|agpl ~ tag: agpl 1 0(?: only| or later)? ~ name: affero general public license(?: version)? 1 ~ url: affero org oagpl
lgpl-3.0 ~ lgpl|lesser|lgplv3 ~ tag: lgpl 3 0(?: only| or later)? ~ notice: gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3 ~ name: gnu lesser general public license v(?:ersion )?3|lgplv3 ~ url: gnu org licenses lgpl 3 0
lgpl-2.1 ~ lgpl|lesser|lgplv2 ~ tag: lgpl 2 1(?: only| or later)? ~ notice: gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1 ~ name: gnu lesser general public license v(?:ersion )?2 1|lgplv2 1 ~ url: gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-2.0 ~ lgpl|library ~ tag: lgpl 2 0(?: only| or later)? ~ notice: gnu library general public license(?: as published by the free software foundation)?(?: either)? version 2 ~ name: gnu library general public license(?: v(?:ersion )?2)? ~ url: gnu org licenses old licenses lgpl 2 0
gpl-3.0 ~ gpl|gnu|gplv3|gplv ~ tag: gpl 3 0(?: only| or later)? ~ notice: gnu general public license(?: as published by the free software foundation)?(?: either)? version 3(?: of the license)?(?: or at your option any later version)? ~ name: gnu gpl v?3|gpl ?v ?3|gnu general public license v ?3|gplv3 ~ url: gnu org licenses gpl 3 0
gpl-2.0 ~ gpl|gnu|gplv2|gplv ~ tag: gpl 2 0(?: only| or later)? ~ notice: gnu general public license(?: as published by the free software foundation)?(?: either)? version 2(?: of the license)?(?: or at your option any later version)? ~ name: gnu gpl v?2|gpl ?v ?2|gnu general public license v ?2|gplv2 ~ url: gnu org licenses (?:old licenses )?gpl 2 0
gpl-1.0 ~ gpl|gnu|gplv1|gplv ~ tag: gpl 1 0(?: only| or later)? ~ notice: gnu general public license(?: as published by the free software foundation)?(?: either)? version 1 ~ name: gpl ?v ?1|gplv1 ~ url: gnu org licenses old licenses gpl 1 0
gpl-exception ~ exception ~ tag: with (?:gcc|classpath|autoconf|bison|linux syscall|font|llvm) exception ~ notice: as a special exception (?:the copyright holders|to the gnu general public license|you may (?:create|use)) ~ name: classpath exception|gcc runtime library exception|linking exception
gfdl-1.3 ~ gfdl|documentation|gfdl1|gfdlv1|fdl ~ tag: gfdl 1 3(?: only| or later)? ~ notice: gnu free documentation license version 1 3 ~ name: gfdl ?v?1 3 ~ url: gnu org licenses fdl(?: 1 3)?
gfdl-1.2 ~ gfdl|documentation ~ tag: gfdl 1 2(?: only| or later)? ~ notice: gnu free documentation license version 1 2 ~ name: gnu free documentation license
apache-2.0 ~ apache|apache2|asl ~ tag: apache 2 0 ~ notice: licensed under the apache license(?: version)? 2 0|you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org ~ name: apache (?:software )?license(?: v(?:ersion)?)? ?2(?: 0)?|apache2? license 2|asl 2 0 ~ url: apache org licenses license 2 0
apache-1.1 ~ apache ~ tag: apache 1 1 ~ notice: the apache software license version 1 1 ~ name: apache (?:software )?license(?: v(?:ersion)?)? ?1 1 ~ url: apache org licenses license 1 1
apache-1.0 ~ apache ~ tag: apache 1 0 ~ notice: this product includes software developed by the apache group ~ name: apache (?:software )?license(?: v(?:ersion)?)? ?1 0 ~ url: apache org licenses license 1 0
mit-0 ~ mit ~ tag: mit 0 ~ name: mit no attribution(?: license)?
mit ~ mit|permission|expat ~ tag: identifier mit|license mit ~ notice: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files|(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit(?: license)? ~ name: the mit license|mit license mit|expat license|mit expat ~ url: opensource org licenses mit(?: license)?
x11 ~ x11|consortium ~ tag: identifier x11 ~ notice: except as contained in this notice the name of the x consortium ~ name: x11 license|mit x11
isc ~ isc|permission|systems ~ tag: identifier isc ~ notice: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted ~ name: isc license|internet systems consortium license ~ url: opensource org licenses isc
bsd-4-clause ~ bsd|advertising ~ tag: bsd 4 clause(?: uc)? ~ notice: all advertising materials mentioning features or use of this software must display ~ name: (?:original|old|four clause|4 clause) bsd(?: license)?
bsd-3-clause ~ bsd|redistribution|neither ~ tag: bsd 3 clause(?: clear| lbnl)? ~ notice: neither the name of (?:the )?(?:\S+ ){1,12}?nor the names of its contributors may be used to endorse ~ name: (?:new|modified|revised|three clause|3 clause) bsd(?: license)? ~ url: opensource org licenses bsd 3 clause
bsd-2-clause ~ bsd|freebsd ~ tag: bsd 2 clause(?: patent| views)? ~ name: (?:simplified|freebsd|two clause|2 clause) bsd(?: license)?|freebsd license ~ url: opensource org licenses bsd 2 clause
bsd-1-clause ~ bsd ~ tag: bsd 1 clause
0bsd ~ 0bsd|bsd|free ~ tag: identifier 0bsd ~ name: zero clause bsd(?: license)?|bsd zero clause|free public license 1 0 0
bsd ~ bsd|redistribution ~ notice: redistribution and use in source and binary forms with or without modification are permitted|(?:released|licensed|distributed) under (?:the |a )?bsd(?: style)? license ~ name: bsd license|bsd style license
mpl-2.0 ~ mpl|mozilla|mplv2 ~ tag: mpl 2 0(?: no copyleft exception)? ~ notice: this source code form is subject to the terms of the mozilla public license v 2 0 ~ name: mozilla public license(?: v(?:ersion)?)? ?2(?: 0)?|mplv2 ~ url: mozilla org mpl 2 0
mpl-1.1 ~ mpl|mozilla ~ tag: mpl 1 1 ~ notice: the contents of this file are subject to the mozilla public license version 1 1 ~ name: mozilla public license(?: v(?:ersion)?)? ?1 1 ~ url: mozilla org mpl 1 1
mpl-1.0 ~ mpl|mozilla ~ tag: mpl 1 0 ~ name: mozilla public license(?: v(?:ersion)?)? ?1 0
npl-1.1 ~ npl|netscape ~ tag: npl 1 1 ~ name: netscape public license(?: version 1 [01])?
epl-2.0 ~ epl|eclipse ~ tag: epl 2 0 ~ notice: made available under the terms of the eclipse public license(?: v| version)? 2 0 ~ name: eclipse public license(?: v(?:ersion)?)? ?2(?: 0)? ~ url: eclipse org legal epl (?:v20|2 0)
epl-1.0 ~ epl|eclipse ~ tag: epl 1 0 ~ notice: made available under the terms of the eclipse public license(?: v| version)? 1 0 ~ name: eclipse public license(?: v(?:ersion)?)? ?1(?: 0)? ~ url: eclipse org legal epl v10
edl-1.0 ~ eclipse ~ name: eclipse distribution license(?: v(?:ersion)?)?(?: 1 0)? ~ url: eclipse org org documents edl v10
cpl-1.0 ~ cpl|common ~ tag: cpl 1 0 ~ name: common public license(?: v(?:ersion)?)?(?: 1 0)?
ipl-1.0 ~ ibm|ipl ~ tag: ipl 1 0 ~ name: ibm public license(?: version 1 0)?
cddl-1.1 ~ cddl|common ~ tag: cddl 1 1 ~ name: common development and distribution license(?: v(?:ersion)?)? ?1 1
cddl-1.0 ~ cddl|common|cddl1 ~ tag: cddl 1 0 ~ notice: subject to the terms of the common development and distribution license ~ name: common development and distribution license(?: v(?:ersion)?)?(?: 1 0)?|cddl license ~ url: opensource org licenses cddl1
eupl-1.2 ~ eupl|european ~ tag: eupl 1 2 ~ notice: licensed under the eupl(?: version)? 1 2 ~ name: european union public licen[cs]e(?: v(?:ersion)?)? ?1 2
eupl-1.1 ~ eupl|european ~ tag: eupl 1 1 ~ notice: licensed under the eupl(?: version)? 1 1 ~ name: european union public licen[cs]e(?: v(?:ersion)?)?(?: 1 1)?
artistic-2.0 ~ artistic ~ tag: artistic 2 0 ~ name: artistic license(?: v(?:ersion)?)? ?2(?: 0)? ~ url: perlfoundation org artistic license 2 0
artistic-1.0 ~ artistic ~ tag: artistic 1 0(?: perl| cl8)? ~ name: (?:perl )?artistic license(?: 1 0)?
perl ~ perl ~ notice: (?:under|on) the same terms as (?:the )?perl(?: 5| itself)?
bsl-1.0 ~ boost|bsl ~ tag: bsl 1 0 ~ notice: distributed under the boost software license version 1 0 ~ name: boost software license(?: v(?:ersion)?)?(?: 1 0)? ~ url: boost org license 1 0 txt
busl-1.1 ~ busl|business ~ tag: busl 1 1 ~ name: business source license(?: 1 1)?
sspl-1.0 ~ sspl|server ~ tag: sspl 1 0 ~ name: server side public license(?: v(?:ersion)?)?(?: 1)?
elastic-2.0 ~ elastic ~ tag: elastic 2 0 ~ name: elastic license(?: v(?:ersion)?)?(?: 2(?: 0)?)?
zlib ~ zlib|warranty ~ tag: identifier zlib(?: acknowledgement)? ~ notice: this software is provided as is without any express or implied warranty in no event will the authors be held liable ~ name: zlib license|zlib libpng license
libpng-2.0 ~ libpng|png ~ tag: libpng 2 0|identifier libpng ~ name: libpng license|png reference library license
libtiff ~ libtiff ~ tag: identifier libtiff ~ name: libtiff license
ijg ~ ijg|jpeg ~ tag: identifier ijg ~ notice: this software is based in part on the work of the independent jpeg group ~ name: independent jpeg group license
curl ~ curl ~ tag: identifier curl ~ name: curl license
openssl ~ openssl ~ tag: identifier openssl ~ notice: this product includes software developed by the openssl project ~ name: openssl license
ssleay ~ ssleay|cryptographic ~ notice: this product includes cryptographic software written by eric young ~ name: ssleay license
php-3.01 ~ php ~ tag: php 3 01|php 3 0 ~ notice: this product includes php software freely available from ~ name: php license(?: v(?:ersion)?)?(?: 3 0?1)? ~ url: php net license
python-2.0 ~ python|psf ~ tag: python 2 0(?: 1)?|psf 2 0 ~ notice: python software foundation license version 2 ~ name: python software foundation license|psf license(?: agreement)? ~ url: python org psf license
ruby ~ ruby ~ tag: identifier ruby ~ name: ruby license|ruby s license
vim ~ vim ~ tag: identifier vim ~ name: vim license
postgresql ~ postgresql ~ tag: identifier postgresql ~ name: postgresql licen[cs]e ~ url: opensource org licenses postgresql
ncsa ~ ncsa|illinois ~ tag: identifier ncsa ~ name: university of illinois ncsa open source license|ncsa open source license
upl-1.0 ~ upl|universal ~ tag: upl 1 0 ~ name: universal permissive license(?: v(?:ersion)?)?(?: 1 0)?
unlicense ~ unlicense|unencumbered ~ tag: identifier unlicense ~ notice: this is free and unencumbered software released into the public domain ~ name: the unlicense ~ url: unlicense org
wtfpl ~ wtfpl|want ~ tag: identifier wtfpl ~ name: do what the fuck you want to public license|do what the f u want to public license|wtfpl
cc0-1.0 ~ cc0|universal|zero|waived ~ tag: cc0 1 0 ~ notice: to the extent possible under law (?:\S+ ){1,12}?has waived all copyright ~ name: cc0(?: 1 0)?(?: universal)?|creative commons zero(?: v?1 0)?|cc zero ~ url: creativecommons org publicdomain zero 1 0
pddl-1.0 ~ pddl|domain ~ tag: pddl 1 0 ~ name: open data commons public domain dedication(?: and)? licen[cs]e
odbl-1.0 ~ odbl|database ~ tag: odbl 1 0 ~ notice: made available under the open database licen[cs]e ~ name: open (?:data commons open )?database licen[cs]e(?: v?1 0)? ~ url: opendatacommons org licenses odbl
odc-by-1.0 ~ odc|attribution|opendatacommons ~ tag: odc by 1 0 ~ name: open data commons attribution licen[cs]e ~ url: opendatacommons org licenses by
cc-by-nc-nd ~ cc|creative|creativecommons ~ tag: cc by nc nd [1-4] [05] ~ notice: creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international| unported| generic)? ~ name: cc by nc nd ~ url: creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa ~ cc|creative|creativecommons ~ tag: cc by nc sa [1-4] [05] ~ notice: creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)? ~ name: cc by nc sa ~ url: creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc ~ cc|creative|creativecommons ~ tag: cc by nc [1-4] [05] ~ notice: creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)? ~ name: cc by nc ~ url: creativecommons org licenses by nc [1-4] [05]
cc-by-nd ~ cc|creative|creativecommons ~ tag: cc by nd [1-4] [05] ~ notice: creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international| unported| generic)? ~ name: cc by nd ~ url: creativecommons org licenses by nd [1-4] [05]
cc-by-sa ~ cc|creative|creativecommons ~ tag: cc by sa [1-4] [05] ~ notice: creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)? ~ name: cc by sa ~ url: creativecommons org licenses by sa [1-4] [05]
cc-by ~ cc|creative|creativecommons ~ tag: cc by [1-4] [05] ~ notice: creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? ~ url: creativecommons org licenses by [1-4] [05]
public-domain ~ domain|creativecommons ~ notice: (?:released|placed|dedicated) (?:in|into|to) the public domain|this (?:work|file|document|code) is in the public domain ~ name: public domain mark(?: 1 0)? ~ url: creativecommons org publicdomain mark 1 0
ofl-1.1 ~ ofl|font ~ tag: ofl 1 1(?: rfn| no rfn)? ~ notice: licensed under the sil open font license version 1 1 ~ name: sil open font license(?: v(?:ersion)?)?(?: 1 [01])?|open font license ~ url: scripts sil org ofl
bitstream-vera ~ vera ~ tag: bitstream vera ~ name: bitstream vera (?:fonts )?(?:copyright|license)
afl-3.0 ~ academic|afl ~ tag: afl 3 0 ~ notice: licensed under the academic free license version 3 0 ~ name: academic free license(?: v(?:ersion)?)?(?: [123] [0-2])?
osl-3.0 ~ osl|open ~ tag: osl 3 0 ~ notice: licensed under the open software license version 3 0 ~ name: open software license(?: v(?:ersion)?)?(?: [123] [01])?
ms-pl ~ ms|microsoft ~ tag: identifier ms pl ~ name: microsoft public license|ms pl
ms-rl ~ ms|microsoft ~ tag: identifier ms rl ~ name: microsoft reciprocal license|ms rl
apsl-2.0 ~ apsl|apple ~ tag: apsl [12] [0-2] ~ notice: subject to the apple public source license version ~ name: apple public source license(?: [12] [0-2])?
qpl-1.0 ~ qpl|q ~ tag: qpl 1 0 ~ name: q public license(?: version 1 0)?
sleepycat ~ sleepycat ~ tag: identifier sleepycat ~ name: sleepycat license
w3c ~ w3c|w3 ~ tag: identifier w3c(?: 20150513| 19980720)? ~ name: w3c software (?:notice and )?(?:and document )?license ~ url: w3 org consortium legal (?:2015 )?copyright software
unicode ~ unicode ~ tag: unicode dfs 201[56]|unicode 3 0|unicode tou ~ name: unicode license(?: v3| agreement)? ~ url: unicode org copyright
icu ~ icu ~ tag: identifier icu ~ name: icu license
openldap-2.8 ~ openldap|oldap ~ tag: oldap 2 [0-8] ~ name: openldap public license(?: version 2 [0-8])?
lppl-1.3c ~ lppl|latex ~ tag: lppl 1 [0-3][ac]? ~ notice: under the conditions of the latex project public license ~ name: latex project public license(?: version 1 [0-3][ac]?)? ~ url: latex project org lppl
cecill-2.1 ~ cecill ~ tag: cecill 2 [01]|cecill [bc] ~ notice: governed by the cecill(?: b| c)? license ~ name: cecill(?: b| c)?(?: free software)? licen[cs]e(?: agreement)?
mulan-psl-2.0 ~ mulan|mulanpsl ~ tag: mulanpsl [12] 0 ~ name: mulan p(?:ermissive )?s(?:oftware )?l(?:icense)?(?: v2)?
blueoak-1.0.0 ~ blueoak|oak ~ tag: blueoak 1 0 0 ~ name: blue oak model license(?: 1 0 0)?
hippocratic-2.1 ~ hippocratic ~ tag: hippocratic 2 1 ~ name: hippocratic license(?: [123] [01])?
json ~ evil|json ~ tag: identifier json ~ notice: the software shall be used for good not evil ~ name: json license
beerware ~ beer|beerware ~ tag: identifier beerware ~ notice: you can buy me a beer in return ~ name: beer ?ware license
ecl-2.0 ~ ecl|educational ~ tag: ecl [12] 0 ~ name: educational community license(?: version [12] 0)?
eudatagrid ~ datagrid|eudatagrid ~ tag: identifier eudatagrid ~ name: eu datagrid software license
fsfap ~ fsfap|medium ~ tag: identifier fsfap ~ notice: copying and distribution of this file with or without modification are permitted in any medium without royalty
hpnd ~ hpnd|historical ~ tag: identifier hpnd ~ name: historical permission notice and disclaimer
intel ~ intel ~ tag: identifier intel ~ name: intel open source license
lpl-1.02 ~ lucent|lpl ~ tag: lpl 1 0(?:2)? ~ name: lucent public license(?: version 1 02)?
nasa-1.3 ~ nasa ~ tag: nasa 1 3 ~ name: nasa open source agreement(?: 1 3)?
naist-2003 ~ naist ~ tag: naist 2003
rpl-1.5 ~ reciprocal|rpl ~ tag: rpl 1 [15] ~ name: reciprocal public license(?: 1 [15])?
sissl ~ sissl|sun ~ tag: sissl(?: 1 2)? ~ name: sun industry standards source license
spl-1.0 ~ sun|spl ~ tag: spl 1 0 ~ name: sun public license(?: version 1 0)?
vsl-1.0 ~ vovida|vsl ~ tag: vsl 1 0 ~ name: vovida software license
watcom-1.0 ~ watcom|sybase ~ tag: watcom 1 0 ~ name: sybase open watcom public license
zpl-2.1 ~ zope|zpl ~ tag: zpl [12] [01] ~ name: zope public license(?: v(?:ersion)?)?(?: 2 [01])?
openrail ~ openrail|rail|bigscience|responsible|creativemlopenrail|bigscienceopenrail|bigcodeopenrail ~ tag: (?:creativeml|bigscience|bigcode)? ?open ?rail m(?: v1)? ~ name: responsible ai license|open rail m? ?license
llama ~ llama ~ notice: llama [234](?: [0-3])? is licensed under the llama [234](?: [0-3])? community license ~ name: llama [234](?: [0-3])? community license(?: agreement)?
gemma ~ gemma ~ name: gemma terms of use
proprietary ~ rights|proprietary|confidential|unauthorized ~ notice: proprietary and confidential|unauthorized (?:copying|use|distribution) of this (?:file|software|document)(?: via any medium)? is (?:strictly )?prohibited ~ name: all rights reserved
eula ~ license|licence ~ name: end user licen[cs]e agreement
"""

KINDS = ("tag", "notice", "name", "url")
#: Confidence of a kind; a tag after "spdx license identifier" is as sure as it gets.
CONFIDENCE = {"tag": 0.95, "notice": 0.9, "name": 0.8, "url": 0.85, "base": 0.75}
#: Phrases whose places are counted for themselves; the labels always stay.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def families() -> list[tuple[str, list[str], dict[str, list[str]]]]:
    """label, gate words, patterns by kind."""
    found = []
    for line in FAMILIES.strip().splitlines():
        label, gate, *kinds = (part.strip() for part in line.split(" ~ "))
        found.append((label, gate.split("|"), {k: split_top(v) for k, v in (part.split(": ", 1) for part in kinds)}))
    return found


def split_top(patterns: str) -> list[str]:
    """Split at ``|`` outside brackets."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(patterns):
        depth += (c in "([") - (c in ")]")
        if c == "|" and depth == 0:
            parts.append(patterns[at:i])
            at = i + 1
    return [*parts, patterns[at:]]
