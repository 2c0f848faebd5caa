"""The ordered signature rules of the licence scan.

A line is ``label | gate | pattern | pattern ...``. Patterns are regular expressions over normalised words: lower case,
single spaces, no punctuation. An alternative is looked at only in texts that hold its gate, a literal that all its matches
hold: the line's one, or the alternative's own longest if it needn't hold that. Earlier rules go first: a detection inside that of an earlier rule is dropped. ``V`` stands for "version", "v", "ver" or nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants, _parser  # what a pattern requires is read from its parsed form

_RULES = r"""
agpl-3.0-or-later | affero | (?:gnu )?affero general public license V3(?: 0)? or (?:any )?later(?: version)? | agpl V3(?: 0)? or later | spdx license identifier agpl 3 0 or later | affero general public license as published by the free software foundation either V3 of the license or at your option any later version
agpl-3.0-only | affero | (?:gnu )?affero general public license V3(?: 0)? only | spdx license identifier agpl 3 0 only
agpl-3.0 | affero | (?:gnu )?affero general public license V3(?: 0)? | gnu org licenses agpl 3 0 | affero general public license V3 19 november 2007
agpl-1.0 | affero | affero general public license V1(?: 0)?
agpl | agpl | agpl ?V3(?: 0)? | spdx license identifier agpl 3 0
lgpl-3.0-or-later | lesser | (?:gnu )?lesser general public license V3(?: 0)? or (?:any )?later(?: version)? | spdx license identifier lgpl 3 0 or later | lesser general public license as published by the free software foundation either V3 of the license or at your option any later version
lgpl-2.1-or-later | lesser | (?:gnu )?lesser general public license V2 1 or (?:any )?later(?: version)? | spdx license identifier lgpl 2 1 or later | lesser general public license as published by the free software foundation either V2 1 of the license or at your option any later version
lgpl-3.0 | lesser | (?:gnu )?lesser general public license V3(?: 0)? | gnu org licenses lgpl 3 0
lgpl-2.1 | lesser | (?:gnu )?lesser general public license V2 1 | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-2.0 | library general | (?:gnu )?library general public license V2(?: 0)? | gnu library general public license
lgpl | lesser | (?:gnu )?lesser general public license
lgpl | lgpl | lgpl ?V3(?: 0)? | lgpl ?V2 1 | licensed under (?:the )?lgpl | spdx license identifier lgpl \d \d
gpl-3.0-or-later | general public | (?:gnu )?general public license V3(?: 0)? or (?:any )?later(?: version)? | spdx license identifier gpl 3 0 or later | general public license as published by the free software foundation either V3 of the license or at your option any later version
gpl-2.0-or-later | general public | (?:gnu )?general public license V2(?: 0)? or (?:any )?later(?: version)? | spdx license identifier gpl 2 0 or later | general public license as published by the free software foundation either V2 of the license or at your option any later version
gpl-3.0-only | general public | (?:gnu )?general public license V3(?: 0)? only
gpl-2.0-only | general public | (?:gnu )?general public license V2(?: 0)? only
gpl-2.0-with-classpath-exception | classpath exception | general public license V2(?: 0)? with (?:the )?classpath exception | gpl V2(?: 0)? with (?:the )?classpath exception
gpl-2.0-with-linux-syscall-note | syscall | gpl 2 0 with linux syscall note | gpl 2 0 only with linux syscall note
gpl-3.0-with-gcc-exception | runtime library exception | gcc runtime library exception(?: V3 1)?
gpl-3.0 | general public | (?:gnu )?general public license V3(?: 0)? | general public license V3 29 june 2007
gpl-2.0 | general public | (?:gnu )?general public license V2(?: 0)? | general public license V2 june 1991
gpl-1.0 | general public | (?:gnu )?general public license V1(?: 0)?
gpl-any | general public | under the terms of the gnu general public license | gnu general public license
gpl-3.0 | gpl | gpl ?V3(?: 0)? | gplv3 | gnu org licenses gpl 3 0 | spdx license identifier gpl 3 0(?: only)?
gpl-2.0 | gpl | gpl ?V2(?: 0)? | gplv2 | gnu org licenses (?:old licenses )?gpl 2 0 | spdx license identifier gpl 2 0(?: only)?
gpl-any | gpl | licensed under (?:the )?(?:gnu )?gpl | released under (?:the )?(?:gnu )?gpl
gfdl-1.3 | free documentation | gnu free documentation license V1 3
gfdl-1.2 | free documentation | gnu free documentation license V1 2
gfdl | free documentation | gnu free documentation license
apache-2.0-with-llvm-exception | llvm | apache (?:license )?V2 0 with llvm exceptions? | spdx license identifier apache 2 0 with llvm exception
apache-2.0 | apache | apache (?:software )?license V2(?: 0)? | apache org licenses license 2 0 | spdx license identifier apache 2 0 | licensed to the apache software foundation asf under one or more contributor license agreements | apache 2(?: 0)? licen[cs]ed?
apache-1.1 | apache | apache (?:software )?license V1 1 | spdx license identifier apache 1 1
apache-1.0 | apache | apache (?:software )?license V1 0
apache-any | apache | apache (?:software )?license | licensed under apache
cc0-1.0 | cc0 | cc0 1 0(?: universal)? | spdx license identifier cc0 1 0 | creativecommons org publicdomain zero 1 0 | cc0
cc0-1.0 | creative commons zero | creative commons zero(?: V1 0)?(?: universal)?
cc-pdm-1.0 | public domain mark | (?:creative commons )?public domain mark 1 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0 | spdx license identifier cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0 | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-2.0 | cc | cc by nc sa 2 [05]
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0 | spdx license identifier cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0 | creativecommons org licenses by nc nd 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0 | creativecommons org licenses by nc 4 0 | spdx license identifier cc by nc 4 0
cc-by-nc-3.0 | cc | cc by nc 3 0 | creativecommons org licenses by nc 3 0
cc-by-nc-2.0 | cc | cc by nc 2 [05]
cc-by-sa-4.0 | cc | cc by sa 4 0 | creativecommons org licenses by sa 4 0 | spdx license identifier cc by sa 4 0
cc-by-sa-3.0 | cc | cc by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa-2.0 | cc | cc by sa 2 [05]
cc-by-nd-4.0 | cc | cc by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nd-3.0 | cc | cc by nd 3 0 | creativecommons org licenses by nd 3 0
cc-by-4.0 | cc | cc by 4 0 | creativecommons org licenses by 4 0 | spdx license identifier cc by 4 0
cc-by-3.0 | cc | cc by 3 0 | creativecommons org licenses by 3 0 | spdx license identifier cc by 3 0
cc-by-2.0 | cc | cc by 2 [05] | creativecommons org licenses by 2 [05]
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc | cc | cc by nc
cc-by-sa | cc | cc by sa
cc-by-nd | cc | cc by nd
cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 4 0(?: international)?
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc | creative commons | creative commons attribution non ?commercial
cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa | creative commons | creative commons attribution share ?alike
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s
cc-by-4.0 | creative commons | creative commons attribution 4 0(?: international)?
cc-by-3.0 | creative commons | creative commons attribution 3 0(?: unported)?
cc-by-any | creative commons | creative commons attribution | licensed under (?:a )?creative commons
mit-0 | no attribution | mit no attribution
mit-0 | mit | spdx license identifier mit 0
mit | mit | (?:the )?mit license(?: mit)? | licensed under (?:the )?mit | released under (?:the )?mit | spdx license identifier mit | opensource org licenses? mit | mit licen[cs]ed | license mit
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
x11 | x consortium | except as contained in this notice the name of the x consortium | x11 license
expat | expat | expat license
isc | isc | (?:the )?isc license | licensed under (?:the )?isc | spdx license identifier isc | internet systems consortium license
isc | permission to use copy | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | bsd | 0bsd | zero clause bsd | bsd zero clause license | spdx license identifier 0bsd
bsd-4-clause | bsd | bsd 4 clause | 4 clause bsd | four clause bsd | original bsd license | spdx license identifier bsd 4 clause
bsd-3-clause-clear | bsd | bsd 3 clause clear | clear bsd license
bsd-3-clause | bsd | bsd 3 clause | 3 clause bsd | three clause bsd | (?:new|modified|revised) bsd license | spdx license identifier bsd 3 clause | opensource org licenses? bsd 3 clause
bsd-2-clause-patent | bsd | bsd 2 clause plus patent | bsd 2 clause patent
bsd-2-clause | bsd | bsd 2 clause | 2 clause bsd | two clause bsd | simplified bsd license | freebsd license | spdx license identifier bsd 2 clause | opensource org licenses? bsd 2 clause
bsd-1-clause | bsd | bsd 1 clause | 1 clause bsd
bsd-any | bsd | bsd style license | (?:the )?bsd license | licensed under (?:the )?bsd
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | endorse or promote | neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-2-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
mpl-2.0-no-copyleft-exception | mozilla | mozilla public license V2 0 no copyleft exception | incompatible with secondary licenses as defined by the mozilla public license
mpl-2.0 | mozilla | mozilla public license V2(?: 0)? | mozilla org mpl 2 0 | subject to the terms of the mozilla public license V2 0
mpl-1.1 | mozilla | mozilla public license V1 1 | mozilla org mpl mpl 1 1
mpl-1.0 | mozilla | mozilla public license V1 0
mpl-any | mozilla | mozilla public license
mpl-2.0 | mpl | spdx license identifier mpl 2 0 | mpl ?V2(?: 0)? | licensed under (?:the )?mpl
epl-2.0 | eclipse | eclipse public license V2(?: 0)? | eclipse org legal epl 2 0
epl-1.0 | eclipse | eclipse public license V1(?: 0)? | eclipse org legal epl v10
epl-any | eclipse | eclipse public license
epl-2.0 | epl | spdx license identifier epl 2 0 | epl ?V2 0
edl-1.0 | eclipse distribution | eclipse distribution license V1 0
cddl-1.1 | common development | common development and distribution license(?: cddl)? V1 1
cddl-1.0 | common development | common development and distribution license(?: cddl)?(?: V1 0)?
cddl-1.0 | cddl | spdx license identifier cddl 1 0 | cddl ?V1 0 | licensed under (?:the )?cddl
cpl-1.0 | common public | common public license(?: V1 0)?
cpal-1.0 | common public attribution | common public attribution license(?: V1 0)?
ipl-1.0 | ibm public | ibm public license(?: V1 0)?
apsl-2.0 | apple public | apple public source license V2(?: 0)?
apsl-1.0 | apple public | apple public source license(?: V1 [0-2])?
artistic-2.0 | artistic | (?:the )?artistic license V2(?: 0)? | spdx license identifier artistic 2 0
artistic-1.0 | artistic | (?:the )?(?:perl )?artistic license(?: V1 0)?
perl | same terms as perl | under the same terms as perl itself
afl-3.0 | academic free | academic free license V3(?: 0)?
afl-2.1 | academic free | academic free license V2 1
afl-any | academic free | academic free license
osl-3.0 | open software | open software license V3(?: 0)?
osl-2.1 | open software | open software license V2 1
osl-any | open software | open software license
eupl-1.2 | european union public | european union public licen[cs]e V1 2
eupl-1.1 | european union public | european union public licen[cs]e V1 1
eupl-any | european union public | european union public licen[cs]e
eupl-1.2 | eupl | spdx license identifier eupl 1 2 | eupl ?V1 2
cecill-2.1 | cecill | cecill V2 1 | spdx license identifier cecill 2 1
cecill-b | cecill | cecill b
cecill-c | cecill | cecill c
cecill-any | cecill | cecill(?: free software)? license | license cecill
unlicense | unlicense | (?:the )?unlicense | spdx license identifier unlicense | unlicense org
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | do what the | do what the f\w+ you want to public license
wtfpl | wtfpl | wtfpl(?: V2)?
zlib | zlib | zlib(?: libpng)? license | spdx license identifier zlib | licensed under (?:the )?zlib
zlib | misrepresented | the origin of this software must not be misrepresented
libpng-2.0 | libpng | png reference library license V2 | libpng license
bsl-1.0 | boost | boost software license(?: V1 0)? | boost org license 1 0 | distributed under the boost software license
bsl-1.0 | bsl | spdx license identifier bsl 1 0
busl-1.1 | business source | business source license(?: V1 1)?
busl-1.1 | busl | spdx license identifier busl 1 1 | busl 1 1
sspl-1.0 | server side public | server side public license(?: V1(?: 0)?)?
sspl-1.0 | sspl | spdx license identifier sspl 1 0 | sspl ?V1 | licensed under (?:the )?sspl
elastic-2.0 | elastic | elastic license V2(?: 0)? | spdx license identifier elastic 2 0
elastic-any | elastic | elastic license
commons-clause | commons clause | commons clause license condition(?: V1 0)? | subject to the commons clause | commons clause
polyform-noncommercial-1.0.0 | polyform | polyform noncommercial(?: license)?(?: 1 0 0)?
polyform-small-business-1.0.0 | polyform | polyform small business(?: license)?(?: 1 0 0)?
polyform-any | polyform | polyform \w+ license
ncsa | ncsa | (?:university of illinois )?ncsa open source license | spdx license identifier ncsa
python-2.0 | python software foundation | python software foundation license(?: V2)? | psf license agreement
psf-2.0 | psf | spdx license identifier psf 2 0 | psf license(?: V2)?
php-3.01 | php license | (?:the )?php license V3 01
php-3.0 | php license | (?:the )?php license(?: V3 0)?
ruby | ruby | (?:the )?ruby license | same terms as ruby | spdx license identifier ruby
postgresql | postgresql | (?:the )?postgresql licen[cs]e | spdx license identifier postgresql
openssl | openssl | openssl license | openssl toolkit license
ssleay | ssleay | original ssleay license
curl | curl | curl license | spdx license identifier curl
hpnd | historical permission | historical permission notice and disclaimer
ntp | ntp | ntp license | spdx license identifier ntp
icu | icu license | icu license(?: V1 8 1)?
unicode-3.0 | unicode license | unicode license V3
unicode-dfs-2016 | unicode | unicode license agreement data files and software | unicode terms of use
vim | vim license | (?:the )?vim license
w3c | w3c | w3c software (?:notice and )?(?:document )?license | w3c document license
ofl-1.1 | open font | (?:sil )?open font license V1 1 | scripts sil org ofl
ofl-any | open font | (?:sil )?open font license
ofl-1.1 | ofl | spdx license identifier ofl 1 1
ubuntu-font-1.0 | ubuntu font | ubuntu font licen[cs]e(?: V1 0)?
bitstream-vera | bitstream vera | bitstream vera (?:fonts )?(?:license|copyright)
lppl-1.3c | latex project | latex project public license V1 3c
lppl-any | latex project | latex project public license
ms-pl | microsoft public | microsoft public license(?: ms pl)?
ms-rl | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
ms-pl | ms pl | spdx license identifier ms pl
ecl-2.0 | educational community | educational community license V2(?: 0)?
efl-2.0 | eiffel forum | eiffel forum license V2
nasa-1.3 | nasa open source | nasa open source agreement(?: V1 3)?
odbl-1.0 | open database | open database license(?: V1 0)? | odc open database license
odc-by-1.0 | open data commons | open data commons attribution license(?: V1 0)?
pddl-1.0 | public domain dedication | (?:open data commons )?public domain dedication (?:and|&) license
odbl-1.0 | odbl | odbl(?: V1 0)?
cdla-permissive-2.0 | community data license | community data license agreement permissive V2(?: 0)?
cdla-permissive-1.0 | community data license | community data license agreement permissive(?: V1 0)?
cdla-sharing-1.0 | community data license | community data license agreement sharing(?: V1 0)?
ogl-uk-3.0 | open government | open government licen[cs]e V3(?: 0)?
ogl-any | open government | open government licen[cs]e
etalab-2.0 | etalab | (?:licence ouverte|open licence) etalab V2 0 | etalab 2 0
mulan-psl-2.0 | mulan | mulan (?:permissive software license|psl) V2
mulan-any | mulan | mulan permissive software license
blueoak-1.0.0 | blue oak | blue oak model license(?: 1 0 0)?
parity-7.0.0 | parity | parity public license(?: 7 0 0)?
upl-1.0 | universal permissive | universal permissive license(?: V1 0)?
bluetooth | beerware | beer ?ware license
beerware | beer ware | the beer ware license
json | json license | (?:the )?json license
json | for good not evil | the software shall be used for good not evil
jpl | jasper | jasper 2 0 | jasper license
sleepycat | sleepycat | sleepycat license
qpl-1.0 | q public | q public license(?: V1 0)?
tcl | tcl | tcl tk license | tcl license
zpl-2.1 | zope | zope public license V2 1
zpl-any | zope | zope public license
watcom-1.0 | watcom | sybase open watcom public license(?: V1 0)?
rpl-1.5 | reciprocal public | reciprocal public license(?: V?1 5)?
simpl-2.0 | simple public | simple public license(?: V2 0)?
sissl | sun industry | sun industry standards source license
spl-1.0 | sun public | sun public license(?: V1 0)?
nposl-3.0 | non profit open | non profit open software license(?: V?3 0)?
motosoto | motosoto | motosoto open source license
naumen | naumen | naumen public license
nokia | nokia | nokia open source license
oclc-2.0 | oclc | oclc research public license(?: V2 0)?
intel | intel open | intel open source license
lucent-1.02 | lucent | lucent public license(?: V1 02)?
multics | multics | multics license
fair | fair license | fair license
entessa | entessa | entessa public license
frameworx-1.0 | frameworx | frameworx open license
hippocratic-2.1 | hippocratic | hippocratic license V?(?:2 1|3 0)?
openrail | openrail | openrail(?: m| s)? license | creativeml open rail m? ?license | bigscience (?:bloom )?rail license | bigcode openrail m
llama-2 | llama | llama 2 community license(?: agreement)?
llama-3 | llama | (?:meta )?llama 3(?: \d)? community license(?: agreement)?
gemma | gemma | gemma terms of use
proprietary | all rights reserved | all rights reserved
proprietary | proprietary | proprietary and confidential | this (?:software|code) is proprietary
proprietary | unauthorized copying | unauthorized copying of this (?:file|software) via any medium is strictly prohibited
public-domain | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain | this work is in the public domain | in the public domain
no-warranty | warranty | provided as is without warranty of any kind | without warranty of any kind express or implied | comes with absolutely no warranty
other-license | license | licensed under the terms of the [a-z0-9 ]{1,40} license | spdx license identifier \w+
"""


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    gate: bytes
    pattern: re.Pattern[bytes]


def required(pattern: str) -> list[str]:
    """The literals, without the blanks at their ends, that every match of the pattern holds."""
    runs = [""]
    for kind, x in _parser.parse(pattern):
        if kind is _constants.LITERAL:
            runs[-1] += chr(x)
        else:
            runs.append("")
    return [r.strip() for r in runs if r.strip()]


def rules() -> list[Rule]:
    """The rules in their order, first the highest."""
    made = []
    for line in _RULES.strip().splitlines():
        label, gate, *patterns = [x.strip() for x in line.split(" | ")]
        for p in patterns:
            p = p.replace(" V", " (?:version |ver |v ?)?").replace("?V", "?(?:version |ver |v ?)?")
            held = required(p)
            own = gate if any(gate in r for r in held) else max(held, key=len)
            made.append(Rule(len(made), label, own.encode(), re.compile(rf"(?<![^ ])(?:{p})(?![^ ])".encode())))
    return made
