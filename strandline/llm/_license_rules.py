r"""Signature rules of the license scan, written by hand.

One rule a line: label, confidence in hundredths, priority, keywords, pattern.  Patterns are regular
expressions over lower-cased text in which a space stands for anything between two words, ``{v}`` for an
optional version and ``{V}`` for a version that must be there (both extend the label), ``{e}`` for a
word's end.  All keywords of a
rule occur in whatever its pattern matches, so a text without one of them need not be tried.

Priorities: 70 identifiers and addresses, 60 grants that name a license in full, 50 characteristic
clauses, 40 other grants, 30 names of licenses, 20 mentions, 10 hints.
"""

RULES = r"""
apache            | 100 | 70 | spdx,apache            | spdx license identifier apache{v}
apache-2.0        |  95 | 70 | apache.org             | apache\.org/licenses/license-2\.0
apache-1.1        |  95 | 70 | apache.org             | apache\.org/licenses/license-1\.1
apache            |  95 | 60 | licensed,apache        | licensed under the(?: terms of the)? apache (?:software )?license{v}
apache            |  95 | 60 | released,apache        | released under the(?: terms of the)? apache (?:software )?license{v}
apache            |  95 | 60 | distributed,apache     | distributed under the(?: terms of the)? apache (?:software )?license{v}
apache            |  90 | 60 | available,apache       | available under the(?: terms of the)? apache (?:software )?license{v}
apache            |  85 | 40 | apache                 | under(?: the)? apache(?: license)?{v}
apache            |  75 | 30 | apache,licen           | apache (?:software )?licen[sc]e{v}
apache-2.0        |  70 | 30 | asl                    | asl 2\.0
apache-2.0        |  80 | 50 | perpetual,worldwide    | perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0        |  80 | 50 | applicable,agreed      | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1        |  80 | 50 | apache,foundation      | this product includes software developed by the apache software foundation
mit               | 100 | 70 | spdx,mit               | spdx license identifier mit
mit               |  95 | 70 | opensource.org         | opensource\.org/licenses?/mit
mit               |  95 | 60 | licensed,mit           | licensed under the(?: terms of the)? mit (?:open source )?license
mit               |  95 | 60 | released,mit           | released under the(?: terms of the)? mit (?:open source )?license
mit               |  95 | 60 | distributed,mit        | distributed under the(?: terms of the)? mit (?:open source )?license
mit               |  90 | 60 | available,mit          | available under the(?: terms of the)? mit (?:open source )?license
mit               |  85 | 40 | under,mit              | under the mit licen[sc]e
mit               |  90 | 40 | licensed,mit           | licensed under mit
mit               |  75 | 30 | mit,licen              | mit licen[sc]e
mit               |  75 | 30 | expat,licen            | expat licen[sc]e
mit               |  95 | 50 | hereby,granted         | permission is hereby granted free of charge to any person obtaining a copy
mit               |  80 | 50 | hereby,granted         | permission is hereby granted free of charge
mit               |  85 | 50 | copyright,substantial  | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit               |  70 | 50 | restriction,sublicense | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit-0             | 100 | 70 | spdx,mit               | spdx license identifier mit 0
mit-0             |  80 | 30 | attribution,mit        | mit no attribution(?: license)?
x11               | 100 | 70 | spdx,x11               | spdx license identifier x11
x11               |  75 | 30 | x11,licen              | (?:mit )?x11 licen[sc]e
gpl               | 100 | 70 | spdx,gpl               | spdx license identifier gpl{v}(?: only| or later)?
gpl               |  95 | 70 | gnu.org                | gnu\.org/(?:licenses|copyleft)/gpl{v}
gpl               |  95 | 60 | terms,general,public   | under the terms of the gnu general public license(?: as published by the free software foundation)?(?: either)?{v}
gpl               |  95 | 60 | licensed,general,public | licensed under the(?: terms of the)? gnu general public license{v}
gpl               |  95 | 60 | released,general,public | released under the(?: terms of the)? gnu general public license{v}
gpl               |  95 | 60 | distributed,general,public | distributed under the(?: terms of the)? gnu general public license{v}
gpl               |  90 | 60 | available,general,public | available under the(?: terms of the)? gnu general public license{v}
gpl               |  85 | 40 | general,public         | under the gnu general public licen[sc]e{v}
gpl               |  75 | 30 | gnu,general,public     | gnu general public licen[sc]e{v}
gpl               |  60 | 20 | general,public         | general public licen[sc]e{v}
gpl               |  90 | 40 | licensed,gpl           | licensed under(?: the)?(?: gnu)? gpl{v}
gpl               |  85 | 40 | under,gpl              | under(?: the)?(?: gnu)? gpl{v}
gpl               |  75 | 30 | gpl,licen              | (?:gnu )?gpl{v} licen[sc]e
gpl               |  60 | 20 | gpl                    | gpl{V}
gpl               |  80 | 50 | redistribute,modify    | this program is free software:? you can redistribute it and or modify
gpl               |  70 | 50 | merchantability,fitness | without even the implied warranty of merchantability or fitness for a particular purpose
gpl               |  70 | 50 | received,general       | you should have received a copy of the gnu general public license
gpl               |  60 | 10 | copyleft               | copyleft licen[sc]e
gpl-classpath     |  85 | 60 | classpath,exception    | gpl{v}(?: license)? with(?: the)? classpath exception
gpl-linking       |  80 | 50 | linking,exception      | gpl{v}(?: license)? with(?: a)? linking exception
gpl-font          |  80 | 50 | font,exception         | gpl{v}(?: license)? with(?: a| the)? font exception
lgpl              | 100 | 70 | spdx,lgpl              | spdx license identifier lgpl{v}(?: only| or later)?
lgpl              |  95 | 70 | gnu.org                | gnu\.org/(?:licenses|copyleft)/lgpl{v}
lgpl              |  95 | 60 | terms,general,public   | under the terms of the gnu (?:lesser|library) general public license(?: as published by the free software foundation)?(?: either)?{v}
lgpl              |  95 | 60 | licensed,lesser        | licensed under the(?: terms of the)? gnu lesser general public license{v}
lgpl              |  95 | 60 | released,lesser        | released under the(?: terms of the)? gnu lesser general public license{v}
lgpl              |  95 | 60 | distributed,lesser     | distributed under the(?: terms of the)? gnu lesser general public license{v}
lgpl              |  75 | 30 | lesser,general,public  | (?:gnu )?lesser general public licen[sc]e{v}
lgpl              |  75 | 30 | library,general,public | gnu library general public licen[sc]e{v}
lgpl              |  90 | 40 | licensed,lgpl          | licensed under(?: the)?(?: gnu)? lgpl{v}
lgpl              |  85 | 40 | under,lgpl             | under(?: the)?(?: gnu)? lgpl{v}
lgpl              |  75 | 30 | lgpl,licen             | (?:gnu )?lgpl{v} licen[sc]e
lgpl              |  60 | 20 | lgpl                   | lgpl{V}
agpl              | 100 | 70 | spdx,agpl              | spdx license identifier agpl{v}(?: only| or later)?
agpl              |  95 | 70 | gnu.org                | gnu\.org/licenses/agpl{v}
agpl              |  95 | 60 | terms,affero           | under the terms of the gnu affero general public license(?: as published by the free software foundation)?(?: either)?{v}
agpl              |  95 | 60 | licensed,affero        | licensed under the(?: terms of the)? gnu affero general public license{v}
agpl              |  75 | 30 | affero,general         | (?:gnu )?affero general public licen[sc]e{v}
agpl              |  90 | 40 | licensed,agpl          | licensed under(?: the)?(?: gnu)? agpl{v}
agpl              |  60 | 20 | agpl                   | agpl{V}
gfdl              | 100 | 70 | spdx,gfdl              | spdx license identifier gfdl{v}
gfdl              |  95 | 70 | gnu.org                | gnu\.org/(?:licenses|copyleft)/fdl{v}
gfdl              |  95 | 60 | terms,free,documentation | under the terms of the gnu free documentation license{v}
gfdl              |  75 | 30 | free,documentation     | (?:gnu )?free documentation licen[sc]e{v}
gfdl              |  60 | 20 | gfdl                   | gfdl{v}
gfdl              |  80 | 50 | invariant,cover        | with no invariant sections no front cover texts and no back cover texts
bsd-2-clause      | 100 | 70 | spdx,bsd               | spdx license identifier bsd 2 clause
bsd-3-clause      | 100 | 70 | spdx,bsd               | spdx license identifier bsd 3 clause
bsd-4-clause      | 100 | 70 | spdx,bsd               | spdx license identifier bsd 4 clause
0bsd              | 100 | 70 | spdx,0bsd              | spdx license identifier 0bsd
bsd-2-clause      |  95 | 70 | opensource.org         | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause      |  95 | 70 | opensource.org         | opensource\.org/licenses?/bsd-3-clause
bsd-2-clause      |  90 | 60 | bsd,clause             | (?:2|two) clause bsd licen[sc]e
bsd-3-clause      |  90 | 60 | bsd,clause             | (?:3|three) clause bsd licen[sc]e
bsd-4-clause      |  90 | 60 | bsd,clause             | (?:4|four) clause bsd licen[sc]e
bsd-2-clause      |  85 | 40 | bsd,clause             | bsd (?:2|two) clause(?: license)?
bsd-3-clause      |  85 | 40 | bsd,clause             | bsd (?:3|three) clause(?: license)?
bsd-2-clause      |  80 | 40 | simplified,bsd         | simplified bsd(?: license)?
bsd-2-clause      |  80 | 40 | freebsd,licen          | freebsd licen[sc]e
bsd-3-clause      |  80 | 40 | bsd                    | (?:new|revised|modified) bsd(?: license)?
bsd-4-clause      |  80 | 40 | original,bsd           | original bsd(?: license)?
0bsd              |  80 | 40 | zero,clause            | zero clause bsd(?: license)?
bsd               |  95 | 60 | licensed,bsd           | licensed under the(?: terms of the)? bsd (?:style )?license
bsd               |  95 | 60 | released,bsd           | released under the(?: terms of the)? bsd (?:style )?license
bsd               |  95 | 60 | distributed,bsd        | distributed under the(?: terms of the)? bsd (?:style )?license
bsd               |  90 | 60 | available,bsd          | available under the(?: terms of the)? bsd (?:style )?license
bsd               |  85 | 40 | under,bsd              | under(?: the)? bsd(?: style)?(?: license)?
bsd               |  75 | 30 | bsd,licen              | bsd (?:style )?licen[sc]e
bsd               |  90 | 50 | redistribution,binary  | redistribution and use in source and binary forms with or without modification are permitted
bsd               |  80 | 50 | redistribution,binary  | redistribution and use in source and binary forms
bsd-3-clause      |  85 | 50 | endorse,promote        | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause      |  85 | 50 | advertising,acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd               |  60 | 50 | redistributions,retain | redistributions of source code must retain the above copyright notice
mpl               | 100 | 70 | spdx,mpl               | spdx license identifier mpl{v}
mpl               |  95 | 70 | mozilla.org            | mozilla\.org/mpl/{v}
mpl               |  95 | 60 | terms,mozilla          | subject to the terms of the mozilla public license{v}
mpl               |  95 | 60 | licensed,mozilla       | licensed under the(?: terms of the)? mozilla public license{v}
mpl               |  75 | 30 | mozilla,public         | mozilla public licen[sc]e{v}
mpl               |  85 | 40 | under,mpl              | under(?: the)? mpl{v}
mpl               |  60 | 20 | mpl                    | mpl{V}
epl               | 100 | 70 | spdx,epl               | spdx license identifier epl{v}
epl               |  95 | 70 | eclipse.org            | eclipse\.org/(?:legal|org/documents)/epl{v}
epl               |  95 | 60 | terms,eclipse          | under the terms of the eclipse public license{v}
epl               |  75 | 30 | eclipse,public         | eclipse public licen[sc]e{v}
edl               |  75 | 30 | eclipse,distribution   | eclipse distribution licen[sc]e{v}
cddl              | 100 | 70 | spdx,cddl              | spdx license identifier cddl{v}
cddl              |  95 | 60 | terms,development      | subject to the terms of the common development and distribution license{v}
cddl              |  75 | 30 | common,development     | common development and distribution licen[sc]e{v}
cddl              |  60 | 20 | cddl                   | cddl{V}
cpl               | 100 | 70 | spdx,cpl               | spdx license identifier cpl{v}
cpl               |  75 | 30 | common,public          | common public licen[sc]e{v}
cpal              |  75 | 30 | common,attribution     | common public attribution licen[sc]e{v}
ipl               |  75 | 30 | ibm,public             | ibm public licen[sc]e{v}
artistic          | 100 | 70 | spdx,artistic          | spdx license identifier artistic{v}
artistic          |  95 | 60 | same,terms,perl        | under the same terms as perl(?: itself)?
artistic          |  90 | 60 | licensed,artistic      | licensed under the(?: terms of the)? artistic license{v}
artistic          |  75 | 30 | artistic,licen         | (?:perl )?artistic licen[sc]e{v}
isc               | 100 | 70 | spdx,isc               | spdx license identifier isc
isc               |  95 | 70 | opensource.org         | opensource\.org/licenses?/isc
isc               |  95 | 60 | licensed,isc           | licensed under the(?: terms of the)? isc license
isc               |  75 | 30 | isc,licen              | isc licen[sc]e
isc               |  90 | 50 | permission,fee         | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
hpnd              |  80 | 50 | permission,documentation | permission to use copy modify and distribute this software and its documentation for any purpose
zlib              | 100 | 70 | spdx,zlib              | spdx license identifier zlib
zlib              |  95 | 60 | licensed,zlib          | licensed under the(?: terms of the)? zlib(?: libpng)? license
zlib              |  75 | 30 | zlib,licen             | zlib(?: libpng)? licen[sc]e
zlib              |  85 | 50 | express,implied        | this software is provided as is without any express or implied warranty
zlib              |  85 | 50 | altered,misrepresented | altered source versions must be plainly marked as such and must not be misrepresented
libpng            |  75 | 30 | libpng,licen           | libpng licen[sc]e{v}
bsl               | 100 | 70 | spdx,bsl               | spdx license identifier bsl{v}
bsl               |  95 | 70 | boost.org              | boost\.org/license_1_0\.txt
bsl               |  95 | 60 | distributed,boost      | distributed under the boost software license{v}
bsl               |  75 | 30 | boost,software         | boost software licen[sc]e{v}
busl              |  75 | 30 | business,source        | business source licen[sc]e{v}
unlicense         | 100 | 70 | spdx,unlicense         | spdx license identifier unlicense
unlicense         |  95 | 70 | unlicense.org          | unlicense\.org
unlicense         |  90 | 50 | unencumbered           | this is free and unencumbered software released into the public domain
unlicense         |  75 | 30 | unlicense              | (?:the|an?) unlicense
wtfpl             | 100 | 70 | spdx,wtfpl             | spdx license identifier wtfpl
wtfpl             |  75 | 30 | wtfpl                  | wtfpl{v}
wtfpl             |  85 | 40 | want,public            | do what the (?:fuck|f\*\*\*) you want to public license{v}
ofl               | 100 | 70 | spdx,ofl               | spdx license identifier ofl{v}
ofl               |  95 | 70 | scripts.sil.org        | scripts\.sil\.org/ofl
ofl               |  95 | 60 | licensed,font          | licensed under the sil open font license{v}
ofl               |  75 | 30 | open,font              | (?:sil )?open font licen[sc]e{v}
eupl              | 100 | 70 | spdx,eupl              | spdx license identifier eupl{v}
eupl              |  75 | 30 | european,union         | european union public licen[cs]e{v}
eupl              |  60 | 20 | eupl                   | eupl{V}
cecill            | 100 | 70 | spdx,cecill            | spdx license identifier cecill{v}
cecill            |  75 | 30 | cecill,licen           | cecill (?:free software )?licen[sc]e{v}
postgresql        | 100 | 70 | spdx,postgresql        | spdx license identifier postgresql
postgresql        |  75 | 30 | postgresql,licen       | postgresql licen[sc]e
python            | 100 | 70 | spdx,python            | spdx license identifier python{v}
python            |  75 | 30 | python,foundation      | python software foundation licen[sc]e{v}
python            |  75 | 30 | psf,licen              | psf licen[sc]e(?: agreement)?{v}
php               |  75 | 30 | php,licen              | php licen[sc]e{v}
php               |  85 | 50 | php,includes           | this product includes php software
ruby              |  75 | 30 | ruby,licen             | ruby licen[sc]e
openssl           |  75 | 30 | openssl,licen          | openssl licen[sc]e
openssl           |  85 | 50 | openssl,toolkit        | developed by the openssl project for use in the openssl toolkit
ncsa              | 100 | 70 | spdx,ncsa              | spdx license identifier ncsa
ncsa              |  75 | 30 | illinois,ncsa          | university of illinois ncsa open source licen[sc]e
upl               |  75 | 30 | universal,permissive   | universal permissive licen[sc]e{v}
w3c               |  75 | 30 | w3c,notice             | w3c software(?: and document)? notice and license
w3c               |  75 | 30 | w3c,licen              | w3c (?:software )?licen[sc]e
odbl              | 100 | 70 | spdx,odbl              | spdx license identifier odbl{v}
odbl              |  95 | 70 | opendatacommons.org    | opendatacommons\.org/licenses/odbl
odbl              |  75 | 30 | open,database          | open database licen[sc]e{v}
odc-by            |  95 | 70 | opendatacommons.org    | opendatacommons\.org/licenses/by
odc-by            |  75 | 30 | commons,attribution    | open data commons attribution licen[sc]e{v}
pddl              |  95 | 70 | opendatacommons.org    | opendatacommons\.org/licenses/pddl
pddl              |  75 | 30 | domain,dedication      | open data commons public domain dedication and licen[sc]e{v}
cdla-permissive   |  75 | 30 | community,permissive   | community data license agreement permissive{v}
cdla-sharing      |  75 | 30 | community,sharing      | community data license agreement sharing{v}
ms-pl             | 100 | 70 | spdx,ms                | spdx license identifier ms pl
ms-rl             | 100 | 70 | spdx,ms                | spdx license identifier ms rl
ms-pl             |  75 | 30 | microsoft,public       | microsoft public licen[sc]e
ms-rl             |  75 | 30 | microsoft,reciprocal   | microsoft reciprocal licen[sc]e
osl               | 100 | 70 | spdx,osl               | spdx license identifier osl{v}
osl               |  75 | 30 | open,software          | open software licen[sc]e{v}
afl               | 100 | 70 | spdx,afl               | spdx license identifier afl{v}
afl               |  75 | 30 | academic,free          | academic free licen[sc]e{v}
ecl               |  75 | 30 | educational,community  | educational community licen[sc]e{v}
qpl               |  75 | 30 | public,licen           | q public licen[sc]e{v}
sleepycat         |  75 | 30 | sleepycat,licen        | sleepycat licen[sc]e
lppl              |  75 | 30 | latex,project          | latex project public licen[sc]e{v}
vim               |  75 | 30 | vim,licen              | vim licen[sc]e
sspl              |  75 | 30 | server,side            | server side public licen[sc]e{v}
elastic           |  75 | 30 | elastic,licen          | elastic licen[sc]e{v}
commons-clause    |  80 | 40 | commons,clause         | commons clause(?: license)?(?: condition)?{v}
polyform          |  75 | 30 | polyform               | polyform (?:noncommercial|small business|perimeter|shield|strict|internal use) license{v}
mulanpsl          |  75 | 30 | mulan                  | mulan (?:permissive software license|psl){v}
openrail          |  75 | 30 | openrail               | (?:bigscience |creativeml )?openrail(?: m)?(?: license)?
beerware          |  75 | 30 | beer,ware              | beer ware licen[sc]e
cc0               | 100 | 70 | spdx,cc0               | spdx license identifier cc0{v}
cc0               |  95 | 70 | creativecommons.org    | creativecommons\.org/publicdomain/zero/(?:1\.0)?
cc0               |  85 | 40 | commons,zero           | creative commons zero{v}
cc0               |  75 | 30 | cc0                    | cc0{v}(?: universal)?
public-domain     |  95 | 70 | creativecommons.org    | creativecommons\.org/publicdomain/mark/1\.0
public-domain     |  90 | 50 | dedicated,domain       | dedicated to the public domain
public-domain     |  85 | 50 | released,domain        | released (?:in)?to the public domain
public-domain     |  85 | 50 | placed,domain          | placed in(?:to)? the public domain
public-domain     |  70 | 40 | public,domain          | in the public domain
cc-by             |  95 | 70 | creativecommons.org    | creativecommons\.org/licenses/by/{V}
cc-by-nc          |  95 | 70 | creativecommons.org    | creativecommons\.org/licenses/by-nc/{V}
cc-by-sa          |  95 | 70 | creativecommons.org    | creativecommons\.org/licenses/by-sa/{V}
cc-by-nd          |  95 | 70 | creativecommons.org    | creativecommons\.org/licenses/by-nd/{V}
cc-by-nc-sa       |  95 | 70 | creativecommons.org    | creativecommons\.org/licenses/by-nc-sa/{V}
cc-by-nc-nd       |  95 | 70 | creativecommons.org    | creativecommons\.org/licenses/by-nc-nd/{V}
cc-by             | 100 | 70 | spdx,cc                | spdx license identifier cc by(?! (?:nc|sa|nd){e}){v}
cc-by-nc          | 100 | 70 | spdx,cc                | spdx license identifier cc by nc(?! (?:sa|nd){e}){v}
cc-by-sa          | 100 | 70 | spdx,cc                | spdx license identifier cc by sa{v}
cc-by-nd          | 100 | 70 | spdx,cc                | spdx license identifier cc by nd{v}
cc-by-nc-sa       | 100 | 70 | spdx,cc                | spdx license identifier cc by nc sa{v}
cc-by-nc-nd       | 100 | 70 | spdx,cc                | spdx license identifier cc by nc nd{v}
cc-by             |  90 | 60 | licensed,cc            | licensed under(?: a| the)? cc by(?! (?:nc|sa|nd){e}){v}
cc-by-nc          |  90 | 60 | licensed,cc            | licensed under(?: a| the)? cc by nc(?! (?:sa|nd){e}){v}
cc-by-sa          |  90 | 60 | licensed,cc            | licensed under(?: a| the)? cc by sa{v}
cc-by-nd          |  90 | 60 | licensed,cc            | licensed under(?: a| the)? cc by nd{v}
cc-by-nc-sa       |  90 | 60 | licensed,cc            | licensed under(?: a| the)? cc by nc sa{v}
cc-by-nc-nd       |  90 | 60 | licensed,cc            | licensed under(?: a| the)? cc by nc nd{v}
cc-by             |  70 | 30 | cc                     | cc by(?! (?:nc|sa|nd){e}){v}
cc-by-nc          |  70 | 30 | cc                     | cc by nc(?! (?:sa|nd){e}){v}
cc-by-sa          |  70 | 30 | cc                     | cc by sa{v}
cc-by-nd          |  70 | 30 | cc                     | cc by nd{v}
cc-by-nc-sa       |  70 | 30 | cc                     | cc by nc sa{v}
cc-by-nc-nd       |  70 | 30 | cc                     | cc by nc nd{v}
cc-by             |  85 | 40 | commons,attribution    | creative commons attribution(?! (?:non|share|no))(?: license)?{v}
cc-by-sa          |  85 | 40 | attribution,commons    | creative commons attribution share ?alike(?: license)?{v}
cc-by-nd          |  85 | 40 | commons,derivatives    | creative commons attribution no ?derivatives(?: license)?{v}
cc-by-nc          |  85 | 40 | commons,commercial     | creative commons attribution non ?commercial(?! (?:share|no))(?: license)?{v}
cc-by-nc-sa       |  85 | 40 | commons,commercial     | creative commons attribution non ?commercial share ?alike(?: license)?{v}
cc-by-nc-nd       |  85 | 40 | commons,derivatives    | creative commons attribution non ?commercial no ?derivatives(?: license)?{v}
cc                |  50 | 10 | creative,commons       | creative commons licen[sc]e
proprietary       |  80 | 40 | proprietary,confidential | proprietary and confidential
proprietary       |  80 | 40 | confidential,proprietary | confidential and proprietary
proprietary       |  75 | 40 | unauthorized,prohibited | unauthorized (?:copying|reproduction|use|distribution)(?: of this file)?(?: via any medium)? is strictly prohibited
proprietary       |  60 | 30 | reproduced,permission  | may not be reproduced(?: in any form)? without(?: the)?(?: prior)?(?: written)? permission
proprietary       |  60 | 30 | redistributed,permission | may not be redistributed without(?: the)?(?: prior)?(?: written)? permission
reserved          |  60 | 20 | rights,reserved        | all rights reserved
reserved          |  40 | 10 | rights,reserved        | some rights reserved
permissive        |  40 | 10 | permissive,licen       | permissive (?:open source |free software )?licen[sc]e
non-commercial    |  50 | 20 | commercial             | for non ?commercial use only
non-commercial    |  50 | 20 | research,purposes      | for research purposes only
eula              |  50 | 20 | user,agreement         | end user licen[sc]e agreement
dual              |  50 | 20 | dual                   | dual licen[sc]ed
terms             |  30 | 10 | terms,service          | terms of service apply
"""
