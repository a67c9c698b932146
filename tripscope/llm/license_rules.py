"""Signature rules of licences, over text in lower case whose words are joined by single spaces.

One line per rule: label | keyword | priority | regex. A rule is tried only where its keyword occurs. Priorities: 1 identifier or link,
2 grant ("licensed under ..."), 3 sentence of the licence itself, 4 bare name.
"""

RULES = r"""
mit | mit license | 2 | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit license
mit | mit license | 4 | (?:the )?mit license
mit | spdx license identifier | 1 | spdx license identifier mit(?! 0)
mit | opensource org | 1 | opensource org licenses? mit(?: license)?(?: php)?
mit | permission is hereby granted | 3 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | expat license | 4 | (?:the )?expat license
mit-0 | mit no attribution | 4 | mit no attribution(?: license)?
mit-0 | spdx license identifier | 1 | spdx license identifier mit 0
x11 | x11 license | 4 | (?:mit )?x11 license
x11 | spdx license identifier | 1 | spdx license identifier x11
apache-2 | apache | 2 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?license(?: version)? 2(?: 0)?
apache-2 | apache license | 4 | apache (?:software )?license(?: version)? 2(?: 0)?
apache-2 | spdx license identifier | 1 | spdx license identifier apache 2 0
apache-2 | apache org | 1 | (?:www )?apache org licenses? (?:license )?2 0
apache-2 | as is basis | 3 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | apache 2 0 | 4 | apache 2 0(?: license)?
apache-1 | apache software license | 4 | apache software license(?: version)? 1 [01]
apache-1 | spdx license identifier | 1 | spdx license identifier apache 1 [01]
apache-1 | this product includes software developed by the apache | 3 | this product includes software developed by the apache (?:software foundation|group)
cc-by | cc by | 2 | (?:licensed|released|distributed|available|shared) under (?:a |the )?(?:terms of )?(?:the )?cc by(?: [1-4] [05])?(?! (?:nc|sa|nd))
cc-by | cc by 4 0 | 4 | cc by 4 0
cc-by | creativecommons org | 1 | creativecommons org licenses by [1-4] [05]
cc-by | creative commons attribution | 4 | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: license| licence)?(?! (?:non|share|no))
cc-by-sa | cc by sa | 4 | cc by sa(?: [1-4] [05])?
cc-by-sa | creativecommons org | 1 | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-sa | share | 4 | creative commons attribution share ?alike(?: [1-4] [05])?(?: license| licence)?
cc-by-sa | spdx license identifier | 1 | spdx license identifier cc by sa [1-4] [05]
cc-by-nc | cc by nc | 2 | (?:licensed|released|distributed|available|shared) under (?:a |the )?(?:terms of )?(?:the )?cc by nc(?: [1-4] [05])?(?! (?:sa|nd))
cc-by-nc | cc by nc | 4 | cc by nc(?: [1-4] [05])?(?! (?:sa|nd))
cc-by-nc | creativecommons org | 1 | creativecommons org licenses by nc [1-4] [05]
cc-by-nc | commercial | 4 | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: license| licence)?(?! (?:share|no))
cc-by-nc-sa | cc by nc sa | 4 | cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa | creativecommons org | 1 | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-sa | commercial | 4 | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd | cc by nc nd | 4 | cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd | creativecommons org | 1 | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-nd | commercial | 4 | creative commons attribution non ?commercial no ?derivatives?(?: [1-4] [05])?
cc-by-nd | cc by nd | 4 | cc by nd(?: [1-4] [05])?
cc-by-nd | creativecommons org | 1 | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nd | deriv | 4 | creative commons attribution no ?deriv(?:s|atives?)(?: [1-4] [05])?
cc0 | cc0 | 4 | cc0(?: 1 0)?(?: universal)?
cc0 | creativecommons org | 1 | creativecommons org publicdomain zero 1 0
cc0 | spdx license identifier | 1 | spdx license identifier cc0 1 0
cc0 | waived all copyright | 3 | has waived all copyright and related or neighboring rights
cc-pdm | creativecommons org | 1 | creativecommons org publicdomain mark 1 0
cc-other | creative commons | 4 | (?:a )?creative commons licen[cs]e
gpl-1 | general public license | 4 | gnu general public license(?: as published by the free software foundation)?(?: version| v) ?1(?: 0)?
gpl-1 | spdx license identifier | 1 | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2 | general public license | 2 | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?gnu general public license(?: version| v) ?2(?: 0)?
gpl-2 | general public license | 4 | gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2(?: 0)?
gpl-2 | spdx license identifier | 1 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-2 | gpl | 4 | gpl(?: version| v)? ?2(?: 0)?(?: only| or later)?
gpl-2 | gnu org | 1 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3 | general public license | 2 | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?gnu general public license(?: version| v) ?3(?: 0)?
gpl-3 | general public license | 4 | gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)?
gpl-3 | spdx license identifier | 1 | spdx license identifier gpl 3 0(?: only| or later)?
gpl-3 | gpl | 4 | gpl(?: version| v)? ?3(?: 0)?(?: only| or later)?
gpl-3 | gnu org | 1 | gnu org licenses gpl 3 0
gpl-any | free software foundation | 3 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-any | general public license | 4 | gnu general public license
gpl-any | gnu gpl | 4 | gnu gpl
lgpl-2 | library general public license | 4 | gnu library general public license(?: version| v)? ?2?(?: 0)?
lgpl-2 | spdx license identifier | 1 | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | lesser general public license | 4 | gnu lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2 1
lgpl-2.1 | spdx license identifier | 1 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | lgpl | 4 | lgpl(?: version| v)? ?2 1
lgpl-3 | lesser general public license | 4 | gnu lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)?
lgpl-3 | spdx license identifier | 1 | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 | lgpl | 4 | lgpl(?: version| v)? ?3(?: 0)?
lgpl-any | lesser general public license | 4 | gnu lesser general public license
agpl-3 | affero general public license | 2 | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?gnu affero general public license(?: version| v)? ?3?(?: 0)?
agpl-3 | affero general public license | 4 | (?:gnu )?affero general public license(?: version| v)? ?3?(?: 0)?
agpl-3 | spdx license identifier | 1 | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | agpl | 4 | agpl(?: version| v)? ?3(?: 0)?
agpl-3 | gnu org | 1 | gnu org licenses agpl(?: 3 0)?
gfdl | free documentation license | 4 | gnu free documentation license(?: version)?(?: 1 [1-3])?
gfdl | spdx license identifier | 1 | spdx license identifier gfdl 1 [1-3](?: only| or later)?
gfdl | gnu org | 1 | gnu org (?:copyleft fdl|licenses fdl(?: 1 3)?)
bsd-2 | bsd | 2 | (?:licensed|released|distributed) under (?:the )?(?:2 clause|simplified|freebsd) bsd license
bsd-2 | bsd | 4 | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license
bsd-2 | spdx license identifier | 1 | spdx license identifier bsd 2 clause(?: patent| views)?
bsd-2 | opensource org | 1 | opensource org licenses? bsd 2 clause
bsd-3 | bsd | 2 | (?:licensed|released|distributed) under (?:the )?(?:3 clause|new|modified|revised) bsd license
bsd-3 | bsd | 4 | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) license
bsd-3 | spdx license identifier | 1 | spdx license identifier bsd 3 clause(?: clear)?
bsd-3 | opensource org | 1 | opensource org licenses? bsd 3 clause
bsd-3 | endorse or promote | 3 | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4 | bsd | 4 | (?:bsd 4 clause|4 clause bsd|original bsd) license
bsd-4 | spdx license identifier | 1 | spdx license identifier bsd 4 clause(?: uc)?
bsd-4 | advertising materials | 3 | all advertising materials mentioning features or use of this software must display
bsd-0 | bsd | 4 | (?:bsd zero clause|zero clause bsd|0bsd)(?: license)?
bsd-0 | spdx license identifier | 1 | spdx license identifier 0bsd
bsd-any | bsd license | 4 | (?:a |the )?bsd (?:style )?license
bsd-any | redistributions of source code | 3 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
isc | isc license | 4 | (?:the )?isc license
isc | spdx license identifier | 1 | spdx license identifier isc
isc | permission to use copy modify | 3 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | opensource org | 1 | opensource org licenses? isc(?: license)?
mpl-1.1 | mozilla public license | 4 | mozilla public license(?: version| v)? ?1 [01]
mpl-1.1 | spdx license identifier | 1 | spdx license identifier mpl 1 [01]
mpl-2 | mozilla public license | 2 | (?:licensed|released|subject to|distributed)(?: under)? (?:the )?(?:terms of )?(?:the )?mozilla public license(?: version| v)? ?2 0
mpl-2 | mozilla public license | 4 | mozilla public license(?: version| v)? ?2(?: 0)?
mpl-2 | spdx license identifier | 1 | spdx license identifier mpl 2 0
mpl-2 | mozilla org | 1 | mozilla org (?:en us )?mpl 2 0
mpl-any | mozilla public license | 4 | mozilla public license
epl-1 | eclipse public license | 4 | eclipse public license(?: version| v)? ?1 0
epl-1 | spdx license identifier | 1 | spdx license identifier epl 1 0
epl-1 | eclipse org | 1 | eclipse org legal epl v10
epl-2 | eclipse public license | 4 | eclipse public license(?: version| v)? ?2 0
epl-2 | spdx license identifier | 1 | spdx license identifier epl 2 0
epl-2 | eclipse org | 1 | eclipse org legal epl (?:2 0|v20)
edl-1 | eclipse distribution license | 4 | eclipse distribution license(?: version| v)? ?1 0
cddl-1 | common development and distribution license | 4 | common development and distribution license(?: version)?(?: 1 [01])?
cddl-1 | spdx license identifier | 1 | spdx license identifier cddl 1 [01]
cddl-1 | cddl | 4 | cddl 1 [01]
cpl-1 | common public license | 4 | common public license(?: version| v)? ?1 0
cpl-1 | spdx license identifier | 1 | spdx license identifier cpl 1 0
ipl-1 | ibm public license | 4 | ibm public license(?: version| v)? ?1 0
artistic-1 | artistic license | 4 | artistic license(?: version)? 1 0
artistic-1 | spdx license identifier | 1 | spdx license identifier artistic 1 0
artistic-2 | artistic license | 4 | artistic license(?: version)? 2 0
artistic-2 | spdx license identifier | 1 | spdx license identifier artistic 2 0
artistic-any | artistic license | 4 | (?:the )?artistic license
perl | same terms as perl | 3 | (?:under|on) the same terms as perl(?: 5| itself)?
zlib | zlib license | 4 | (?:the )?zlib(?: libpng)? license
zlib | spdx license identifier | 1 | spdx license identifier zlib
zlib | altered source versions | 3 | altered source versions must be plainly marked as such and must not be misrepresented
libpng | libpng license | 4 | libpng license(?: version 2)?
libpng | spdx license identifier | 1 | spdx license identifier libpng(?: 2 0)?
boost-1 | boost software license | 2 | (?:distributed|licensed) under the boost software license(?: version)? 1 0
boost-1 | boost software license | 4 | boost software license(?: version)?(?: 1 0)?
boost-1 | spdx license identifier | 1 | spdx license identifier bsl 1 0
boost-1 | boost org | 1 | boost org license 1 0 txt
unlicense | unlicense | 4 | the unlicense
unlicense | spdx license identifier | 1 | spdx license identifier unlicense
unlicense | unlicense org | 1 | unlicense org
unlicense | free and unencumbered | 3 | this is free and unencumbered software released into the public domain
wtfpl | wtfpl | 4 | wtfpl(?: version 2| 2 0)?
wtfpl | what the | 4 | do what the fuck you want to public license
wtfpl | spdx license identifier | 1 | spdx license identifier wtfpl
public-domain | public domain | 2 | (?:released|placed|dedicated|is|are) (?:in|into|to) the public domain
public-domain | public domain | 4 | public domain dedication
ofl-1.1 | open font license | 4 | (?:sil )?open font license(?: version)?(?: 1 [01])?
ofl-1.1 | spdx license identifier | 1 | spdx license identifier ofl 1 [01]
ofl-1.1 | scripts sil org | 1 | scripts sil org ofl
postgresql | postgresql license | 4 | (?:the )?postgresql licen[cs]e
postgresql | spdx license identifier | 1 | spdx license identifier postgresql
python | python software foundation license | 4 | python software foundation license(?: version 2)?
python | spdx license identifier | 1 | spdx license identifier (?:psf 2 0|python 2 0)
php-3 | php license | 4 | php license(?: version)?(?: 3 0(?: ?1)?)?
php-3 | spdx license identifier | 1 | spdx license identifier php 3 0
ruby | ruby license | 4 | (?:the )?ruby license
ruby | spdx license identifier | 1 | spdx license identifier ruby
openssl | openssl license | 4 | (?:the )?openssl license
openssl | spdx license identifier | 1 | spdx license identifier openssl
openssl | openssl toolkit | 3 | this product includes software developed by the openssl project for use in the openssl toolkit
w3c | w3c | 4 | w3c software(?: notice)?(?: and)?(?: document)? license
w3c | spdx license identifier | 1 | spdx license identifier w3c(?: 20150513)?
ncsa | ncsa | 4 | (?:university of illinois )?ncsa open source license
ncsa | spdx license identifier | 1 | spdx license identifier ncsa
afl-3 | academic free license | 4 | academic free license(?: version| v)?(?: [123] [01])?
afl-3 | spdx license identifier | 1 | spdx license identifier afl [123] [01]
osl-3 | open software license | 4 | open software license(?: version| v)?(?: [123] [01])?
osl-3 | spdx license identifier | 1 | spdx license identifier osl [123] [01]
eupl | european union public licen | 4 | european union public licen[cs]e(?: version| v)?(?: 1 [012])?
eupl | spdx license identifier | 1 | spdx license identifier eupl 1 [012]
cecill | cecill | 4 | cecill(?: [bc])?(?: free software)?(?: license)?(?: agreement)?
cecill | spdx license identifier | 1 | spdx license identifier cecill (?:1 [01]|2 [01]|b|c)
ms-pl | microsoft public license | 4 | microsoft public license
ms-pl | spdx license identifier | 1 | spdx license identifier ms pl
ms-rl | microsoft reciprocal license | 4 | microsoft reciprocal license
ms-rl | spdx license identifier | 1 | spdx license identifier ms rl
upl-1 | universal permissive license | 4 | universal permissive license(?: version| v)?(?: 1 0)?
upl-1 | spdx license identifier | 1 | spdx license identifier upl 1 0
blueoak-1 | blue oak model license | 4 | blue oak model license(?: 1 0 0)?
blueoak-1 | spdx license identifier | 1 | spdx license identifier blueoak 1 0 0
mulan-2 | mulan | 4 | mulan (?:psl|permissive software license)(?: version| v)? ?[12]?
mulan-2 | spdx license identifier | 1 | spdx license identifier mulanpsl [12] 0
vim | vim license | 4 | (?:the )?vim license
vim | spdx license identifier | 1 | spdx license identifier vim
curl | curl license | 4 | (?:the )?curl license
curl | spdx license identifier | 1 | spdx license identifier curl
beerware | beerware | 4 | beerware(?: license)?
beerware | buy me a beer | 3 | you can buy me a beer in return
json | for good not evil | 3 | the software shall be used for good not evil
json | spdx license identifier | 1 | spdx license identifier json
unicode | unicode license | 4 | unicode license(?: agreement)?(?: v3)?
unicode | spdx license identifier | 1 | spdx license identifier unicode (?:dfs 201[56]|3 0|tou)
odbl | open database license | 4 | open (?:data commons )?(?:open )?database license(?: 1 0)?
odbl | opendatacommons org | 1 | opendatacommons org licenses odbl(?: 1 0)?
odbl | spdx license identifier | 1 | spdx license identifier odbl 1 0
odc-by | opendatacommons org | 1 | opendatacommons org licenses by(?: 1 0)?
odc-by | open data commons attribution license | 4 | open data commons attribution license(?: 1 0)?
pddl | opendatacommons org | 1 | opendatacommons org licenses pddl(?: 1 0)?
pddl | public domain dedication | 4 | open data commons public domain dedication(?: and)? license
cdla-permissive | community data license agreement | 4 | community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | community data license agreement | 4 | community data license agreement sharing(?: version)?(?: 1 0)?
ogl-uk | open government licen | 4 | open government licen[cs]e(?: v[123])?(?: [123] 0)?
ogl-uk | spdx license identifier | 1 | spdx license identifier ogl uk [123] 0
busl-1.1 | business source license | 4 | business source license(?: version| v)? ?(?:1 1)?
busl-1.1 | spdx license identifier | 1 | spdx license identifier busl 1 1
sspl-1 | server side public license | 4 | server side public license(?: version| v)? ?1?
sspl-1 | spdx license identifier | 1 | spdx license identifier sspl 1 0
elastic-2 | elastic license | 4 | elastic license(?: version| v)?(?: 2 0)?
elastic-2 | spdx license identifier | 1 | spdx license identifier elastic 2 0
commons-clause | commons clause | 4 | commons clause(?: license)?(?: condition)?(?: v1 0)?
polyform-nc | polyform noncommercial license | 4 | polyform noncommercial license(?: 1 0 0)?
polyform-sb | polyform small business license | 4 | polyform small business license(?: 1 0 0)?
openrail | openrail | 4 | (?:creativeml |bigscience )?openrail(?: m| plus plus m)?(?: license)?
openrail | responsible ai license | 4 | (?:open )?responsible ai license
llama | community license | 4 | llama (?:[234] )?(?:[0-9] )?community license(?: agreement)?
gemma | gemma terms of use | 4 | gemma terms of use
proprietary | all rights reserved | 3 | all rights reserved
proprietary | proprietary | 4 | proprietary and confidential
proprietary | unauthorized copying | 3 | unauthorized copying of this file via any medium is strictly prohibited
other-open | open source license | 4 | (?:an |the )?open source licen[cs]e
"""

#: Phrases that a scan always reports, whatever else is found.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: What every text with a keyword contains somewhere, in one word or in two words next to each other.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
STEMS = [
    "licen", "apache", "creative", "spdx", "opensource", "gnu", "gpl", "bsd", "mozilla", "eclipse", "cddl", "permission is", "permission to", "redistrib", "endorse",
    "advertising", "altered", "unencumbered", "wtfpl", "domain", "cc0", "copyright", "scripts sil", "openssl", "as perl", "boost", "w3c", "cecill", "mulan",
    "beerware", "a beer", "not evil", "opendatacommons", "commons", "openrail", "gemma terms", "rights reserved", "proprietary", "unauthorized", "free software", "as is basis",
    "what the", "cc by", "mit no", "ncsa",
]
STEMS = [stem.replace(" ", _BREAK) for stem in STEMS]
