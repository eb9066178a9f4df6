"""Licence signatures, written by hand over normalised text.

Normalised text is lower-case words parted by single spaces, so "CC-BY-NC 4.0"
reads "cc by nc 4 0". A line is: label; keyword; pattern. A pattern is tried
only where its keyword stands in the text. Levels go from a grant in full
(suppresses what it contains) over names with versions to bare mentions.
"""

from __future__ import annotations

#: Fixed phrases and their labels: always reported, whatever suppresses them.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


GRANTS = r"""
mit; permission is hereby granted; permission is hereby granted free of charge to any person obtaining a copy of this software
mit; without restriction; to deal in the software without restriction
mit; provided as is; the software is provided as is without warranty of any kind express or implied
isc; permission to use; permission to use copy modify and or distribute this software for any purpose with or without fee
0bsd; without fee; with or without fee is hereby granted the software is provided
bsd; redistribution and use; redistribution and use in source and binary forms with or without modification
bsd-3-clause; endorse or promote; neither the name of .{1,80} may be used to endorse or promote products
bsd-2-clause; retain the above; redistributions of source code must retain the above copyright notice
bsd-2-clause; reproduce the above; redistributions in binary form must reproduce the above copyright notice
bsd-4-clause; advertising materials; all advertising materials mentioning features or use of this software must display
apache-2.0; apache license; licensed under the apache license version 2 0
apache-2.0; apache license; licensed under (?:the )?apache license 2 0
apache-2.0; compliance with the license; you may not use this file except in compliance with the license
apache-2.0; apache org licenses; apache org licenses license 2 0
apache-1.1; apache software; this product includes software developed by the apache software foundation
apache; apache; released under (?:the )?apache license
gpl; free software; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0-or-later; either version 2; gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later; either version 3; gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only; version 2; gnu general public license version 2 as published by the free software foundation
gpl-3.0; general public license; licensed under the gnu general public license version 3
gpl-2.0; general public license; licensed under the gnu general public license version 2
gpl; general public license; licensed under the gnu general public license
gpl; general public license; terms of the gnu general public license
lgpl; lesser general public; terms of the gnu lesser general public license
lgpl; library general public; terms of the gnu library general public license
lgpl-2.1-or-later; lesser general public; gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3.0-or-later; lesser general public; gnu lesser general public license as published by the free software foundation either version 3
agpl; affero general public; terms of the gnu affero general public license
agpl-3.0-or-later; affero general public; gnu affero general public license as published by the free software foundation either version 3
gfdl; free documentation; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0; mozilla public; subject to the terms of the mozilla public license v 2 0
mpl-1.1; mozilla public; subject to the mozilla public license version 1 1
epl-1.0; eclipse public; made available under the terms of the eclipse public license v1 0
epl-2.0; eclipse public; made available under the terms of the eclipse public license 2 0
cddl-1.0; common development; subject to the terms of the common development and distribution license
mit; mit license; (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit license
bsd; bsd; (?:released|licensed|distributed|available) under (?:the |a )?(?:new |simplified |modified )?bsd licen[sc]e
isc; isc license; (?:released|licensed|distributed|available) under (?:the )?isc license
zlib; altered source; altered source versions must be plainly marked as such
zlib; misrepresented; the origin of this software must not be misrepresented
boost-1.0; boost software; distributed under the boost software license version 1 0
boost-1.0; machine executable; copies of the software and accompanying documentation covered by this license
artistic-2.0; artistic; under the terms of the artistic license 2 0
perl; perl itself; under the same terms as perl itself
python-2.0; python software; python software foundation license version 2
ruby; ruby; under the same terms as ruby
php-3.01; php; subject to version 3 01 of the php license
unlicense; public domain; this is free and unencumbered software released into the public domain
unlicense; unlicense org; (?:http |https )?unlicense org
wtfpl; fuck you want; do what the fuck you want to public license
beerware; beer in return; you can buy me a beer in return
cc0-1.0; waived; waived all copyright and related or neighboring rights
cc0-1.0; creativecommons org; creativecommons org publicdomain zero 1 0
public-domain; public domain; (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain; public domain; this work is in the public domain
cc-by-nc-4.0; cc by; licensed under (?:a )?cc by nc 4 0
cc-by-nc-sa-4.0; cc by; licensed under (?:a )?cc by nc sa 4 0
cc-by-nc-nd-4.0; cc by; licensed under (?:a )?cc by nc nd 4 0
cc-by-sa-4.0; cc by; licensed under (?:a )?cc by sa 4 0
cc-by-nd-4.0; cc by; licensed under (?:a )?cc by nd 4 0
cc-by-4.0; cc by; licensed under (?:a )?cc by 4 0
cc-by-nc-3.0; cc by; licensed under (?:a )?cc by nc 3 0
cc-by-sa-3.0; cc by; licensed under (?:a )?cc by sa 3 0
cc-by-3.0; cc by; licensed under (?:a )?cc by 3 0
cc-by-4.0; creative commons; licensed under (?:a |the )?creative commons attribution 4 0
cc-by-sa-4.0; creative commons; licensed under (?:a |the )?creative commons attribution share ?alike 4 0
cc-by-nc-4.0; creative commons; licensed under (?:a |the )?creative commons attribution non ?commercial 4 0
cc-by-nc-sa-4.0; creative commons; licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike 4 0
cc-by-nd-4.0; creative commons; licensed under (?:a |the )?creative commons attribution no ?derivat(?:ive)?s 4 0
odbl-1.0; open database; made available under the open database license
odc-by-1.0; open data commons; made available under the open data commons attribution license
pddl-1.0; public domain dedication; public domain dedication and license
ofl-1.1; open font; this font software is licensed under the sil open font license version 1 1
ms-pl; microsoft public; subject to the microsoft public license
eupl-1.2; european union public; licensed under the eupl version 1 2
osl-3.0; open software license; licensed under the open software license version 3 0
afl-3.0; academic free; licensed under the academic free license version 3 0
cecill; cecill; governed by the cecill license under french law
upl-1.0; universal permissive; licensed under the universal permissive license
elastic-2.0; elastic license; licensed under the elastic license 2 0
sspl-1.0; server side public; licensed under the server side public license
busl-1.1; business source; licensed under the business source license 1 1
proprietary; all rights reserved; copyright .{1,60} all rights reserved
proprietary; confidential; confidential and proprietary
proprietary; prior written; may not be reproduced .{0,80}without (?:the )?prior written (?:permission|consent)
"""

NAMES = r"""
agpl-3.0; agpl; (?:gnu )?agpl(?: version| v)? ?3(?: 0)?(?: only| or later)?
agpl-3.0; affero general; (?:gnu )?affero general public license (?:version |v ?)?3(?: 0)?
agpl-1.0; affero general; affero general public license (?:version |v ?)?1(?: 0)?
gpl-1.0; gpl; (?:gnu )?gpl(?: version| v)? ?1(?: 0)?(?: only| or later)?
gpl-2.0; gpl; (?:gnu )?gpl(?: version| v)? ?2(?: 0)?(?: only| or later)?
gpl-3.0; gpl; (?:gnu )?gpl(?: version| v)? ?3(?: 0)?(?: only| or later)?
gpl-1.0; general public license; gnu general public license (?:version |v ?)?1(?: 0)?
gpl-2.0; general public license; gnu general public license (?:version |v ?)?2(?: 0)?
gpl-3.0; general public license; gnu general public license (?:version |v ?)?3(?: 0)?
lgpl-2.0; lgpl; (?:gnu )?lgpl(?: version| v)? ?2(?: 0)?(?: only| or later)?
lgpl-2.1; lgpl; (?:gnu )?lgpl(?: version| v)? ?2 1(?: only| or later)?
lgpl-3.0; lgpl; (?:gnu )?lgpl(?: version| v)? ?3(?: 0)?(?: only| or later)?
lgpl-2.0; library general public; gnu library general public license (?:version |v ?)?2(?: 0)?
lgpl-2.1; lesser general public; gnu lesser general public license (?:version |v ?)?2 1
lgpl-3.0; lesser general public; gnu lesser general public license (?:version |v ?)?3(?: 0)?
gfdl-1.1; free documentation; gnu free documentation license (?:version |v ?)?1 1
gfdl-1.2; free documentation; gnu free documentation license (?:version |v ?)?1 2
gfdl-1.3; free documentation; gnu free documentation license (?:version |v ?)?1 3
apache-1.0; apache; apache (?:software )?(?:license )?(?:version |v ?)?1 0
apache-1.1; apache; apache (?:software )?(?:license )?(?:version |v ?)?1 1
apache-2.0; apache; apache (?:software )?(?:license )?(?:version |v ?)?2(?: 0)?
mpl-1.0; mozilla public; mozilla public license (?:version |v ?)?1 0
mpl-1.1; mozilla public; mozilla public license (?:version |v ?)?1 1
mpl-2.0; mozilla public; mozilla public license (?:version |v ?)?2(?: 0)?
mpl-1.1; mpl; mpl(?: version| v)? ?1 1
mpl-2.0; mpl; mpl(?: version| v)? ?2(?: 0)?
epl-1.0; eclipse public; eclipse public license (?:version |v ?)?1(?: 0)?
epl-2.0; eclipse public; eclipse public license (?:version |v ?)?2(?: 0)?
epl-1.0; epl; epl(?: version| v)? ?1(?: 0)?
epl-2.0; epl; epl(?: version| v)? ?2(?: 0)?
edl-1.0; eclipse distribution; eclipse distribution license (?:version |v ?)?1(?: 0)?
cddl-1.0; cddl; cddl(?: version| v)? ?1(?: 0)?
cddl-1.1; cddl; cddl(?: version| v)? ?1 1
cpl-1.0; common public; common public license (?:version |v ?)?1(?: 0)?
ipl-1.0; ibm public; ibm public license (?:version |v ?)?1(?: 0)?
bsd-0-clause; bsd; (?:0|zero) clause bsd(?: license)?
bsd-1-clause; bsd; (?:1|one) clause bsd(?: license)?
bsd-2-clause; bsd; (?:2|two) clause bsd(?: license)?
bsd-3-clause; bsd; (?:3|three) clause bsd(?: license)?
bsd-4-clause; bsd; (?:4|four) clause bsd(?: license)?
bsd-1-clause; bsd; bsd 1 clause
bsd-2-clause; bsd; bsd 2 clause
bsd-3-clause; bsd; bsd 3 clause
bsd-4-clause; bsd; bsd 4 clause
bsd-2-clause; bsd; (?:simplified|freebsd) bsd licen[sc]e
bsd-3-clause; bsd; (?:new|modified|revised) bsd licen[sc]e
bsd-4-clause; bsd; (?:original|old) bsd licen[sc]e
mit; mit license; (?:x11 |expat )?mit license
mit; expat; expat license
x11; x11 license; x11 license
isc; isc license; isc license
ntp; ntp license; ntp license
curl; curl; curl license
zlib; zlib; zlib (?:libpng )?license
libpng; libpng; libpng license
libtiff; libtiff; libtiff license
ijg; independent jpeg; independent jpeg group
openssl; openssl; openssl license
openldap-2.8; openldap; openldap public license (?:version |v ?)?2 8
postgresql; postgresql; postgresql license
sqlite; sqlite; sqlite blessing
hpnd; historical permission; historical permission notice and disclaimer
boost-1.0; boost; boost (?:software )?license(?: (?:version |v ?)?1(?: 0)?)?
bsl-1.0; bsl 1 0; bsl 1 0
artistic-1.0; artistic; artistic license (?:version |v ?)?1(?: 0)?
artistic-2.0; artistic; artistic license (?:version |v ?)?2(?: 0)?
perl; perl; perl (?:5 )?license
python-2.0; psf; psf (?:license|2 0)
python-2.0; python; python (?:software foundation )?license
ruby; ruby; ruby license
php-3.0; php license; php license (?:version |v ?)?3(?: 0)?
php-3.01; php license; php license (?:version |v ?)?3 01
zpl-2.1; zope; zope public license (?:version |v ?)?2 1
w3c; license; w3c (?:software (?:notice and )?)?license
unicode; unicode; unicode (?:data files|inc)? ?license(?: agreement)?
ncsa; ncsa; (?:university of illinois )?ncsa (?:open source )?license
naist; naist; naist license
vim; vim license; vim license
tcl; license; tcl(?: tk)? license
lppl-1.3; latex project; latex project public license (?:version |v ?)?1 3
qpl-1.0; q public; q public license (?:version |v ?)?1(?: 0)?
sleepycat; sleepycat; sleepycat license
sissl; sun industry; sun industry standards source license
spl-1.0; sun public; sun public license
nposl-3.0; non profit open; non profit open software license
osl-3.0; open software license; open software license (?:version |v ?)?3(?: 0)?
afl-2.1; academic free; academic free license (?:version |v ?)?2 1
afl-3.0; academic free; academic free license (?:version |v ?)?3(?: 0)?
ecl-2.0; educational community; educational community license (?:version |v ?)?2(?: 0)?
eupl-1.1; eupl; eupl(?: version| v)? ?1 1
eupl-1.2; eupl; eupl(?: version| v)? ?1 2
eupl; european union public; european union public licen[sc]e
cecill-2.1; cecill; cecill(?: version| v)? ?2 1
cecill-b; cecill; cecill b
cecill-c; cecill; cecill c
ms-pl; microsoft public; microsoft public license
ms-rl; microsoft reciprocal; microsoft reciprocal license
ms-pl; ms pl; ms pl
ofl-1.0; open font; (?:sil )?open font license (?:version |v ?)?1 0
ofl-1.1; open font; (?:sil )?open font license(?: (?:version |v ?)?1 1)?
wtfpl; wtfpl; wtfpl
unlicense; unlicense; the unlicense
beerware; beer ware; beer ware license
upl-1.0; universal permissive; universal permissive license(?: (?:version |v ?)?1 0)?
bcl; bouncy castle; bouncy castle license
mulan-1.0; mulan; mulan (?:permissive software license|psl) ?(?:version |v ?)?1
mulan-2.0; mulan; mulan (?:permissive software license|psl) ?(?:version |v ?)?2
anti-996; 996 license; anti 996 license
hippocratic-2.1; hippocratic; hippocratic license(?: 2 1)?
parity-7.0; parity; parity public license(?: 7 0(?: 0)?)?
blueoak-1.0.0; blue oak; blue oak model license(?: 1 0 0)?
polyform; polyform; polyform (?:noncommercial|shield|strict|small business|free trial|internal use|perimeter) license
elastic-2.0; elastic license; elastic license (?:version |v ?)?2(?: 0)?
sspl-1.0; sspl; sspl(?: version| v)? ?1?
sspl-1.0; server side public; server side public license
busl-1.1; business source; business source license(?: 1 1)?
commons-clause; commons clause; commons clause
cc0-1.0; cc0; cc0(?: 1 0)?(?: universal)?
cc-by-1.0; cc by; cc by 1 0
cc-by-2.0; cc by; cc by 2 0
cc-by-2.5; cc by; cc by 2 5
cc-by-3.0; cc by; cc by 3 0
cc-by-4.0; cc by; cc by 4 0
cc-by-sa-2.0; cc by sa; cc by sa 2 0
cc-by-sa-2.5; cc by sa; cc by sa 2 5
cc-by-sa-3.0; cc by sa; cc by sa 3 0
cc-by-sa-4.0; cc by sa; cc by sa 4 0
cc-by-nc-2.0; cc by nc; cc by nc 2 0
cc-by-nc-2.5; cc by nc; cc by nc 2 5
cc-by-nc-3.0; cc by nc; cc by nc 3 0
cc-by-nc-4.0; cc by nc; cc by nc 4 0
cc-by-nd-2.0; cc by nd; cc by nd 2 0
cc-by-nd-3.0; cc by nd; cc by nd 3 0
cc-by-nd-4.0; cc by nd; cc by nd 4 0
cc-by-nc-sa-2.0; cc by nc sa; cc by nc sa 2 0
cc-by-nc-sa-3.0; cc by nc sa; cc by nc sa 3 0
cc-by-nc-sa-4.0; cc by nc sa; cc by nc sa 4 0
cc-by-nc-nd-2.0; cc by nc nd; cc by nc nd 2 0
cc-by-nc-nd-3.0; cc by nc nd; cc by nc nd 3 0
cc-by-nc-nd-4.0; cc by nc nd; cc by nc nd 4 0
cc-by; creative commons; creative commons attribution(?: (?:international|unported|generic))?(?: license)?
cc-by-sa; creative commons; creative commons attribution share ?alike
cc-by-nc; creative commons; creative commons attribution non ?commercial
cc-by-nd; creative commons; creative commons attribution no ?deriv(?:ative)?s
cc-by-nc-sa; creative commons; creative commons attribution non ?commercial share ?alike
cc-by-nc-nd; creative commons; creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-4.0; creativecommons org; creativecommons org licenses by 4 0
cc-by-3.0; creativecommons org; creativecommons org licenses by 3 0
cc-by-sa-4.0; creativecommons org; creativecommons org licenses by sa 4 0
cc-by-sa-3.0; creativecommons org; creativecommons org licenses by sa 3 0
cc-by-nc-4.0; creativecommons org; creativecommons org licenses by nc 4 0
cc-by-nd-4.0; creativecommons org; creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0; creativecommons org; creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0; creativecommons org; creativecommons org licenses by nc nd 4 0
odbl-1.0; odbl; odbl(?: 1 0)?
odbl-1.0; open database; open database license
odc-by-1.0; odc by; odc by(?: 1 0)?
pddl-1.0; pddl; pddl(?: 1 0)?
cdla-permissive-1.0; cdla; cdla permissive (?:version )?1 0
cdla-permissive-2.0; cdla; cdla permissive (?:version )?2 0
cdla-sharing-1.0; cdla; cdla sharing (?:version )?1 0
ogl-uk-3.0; open government; open government licen[sc]e(?: v3 0| version 3(?: 0)?)?
etalab-2.0; etalab; (?:etalab )?licence ouverte(?: 2 0)?
dl-de-by-2.0; datenlizenz; datenlizenz deutschland namensnennung(?: version)? 2 0
openrail; openrail; (?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?
llama-community; community license; llama(?: 2| 3)? community license
"""

MENTIONS = r"""
agpl; agpl; (?:gnu )?agpl
agpl; affero; affero general public license
gpl; gpl; (?:gnu )?gpl
gpl; gnu general; gnu general public license
gpl; gnu public; gnu public license
lgpl; lgpl; (?:gnu )?lgpl
lgpl; lesser general; gnu lesser general public license
lgpl; library general; gnu library general public license
gfdl; free documentation; (?:gnu )?free documentation license
apache; apache; apache licen[sc]e
mpl; mozilla; mozilla public license
epl; eclipse; eclipse public license
cddl; common development; common development and distribution license
bsd; bsd; bsd (?:style )?licen[sc]e[ds]?
mit; mit licen; mit licen[sc]ed
mit; style license; mit style license
artistic; artistic; artistic license
cc-by; cc by; cc by
cc-by-sa; cc by sa; cc by sa
cc-by-nc; cc by nc; cc by nc
cc-by-nd; cc by nd; cc by nd
cc-by-nc-sa; cc by nc sa; cc by nc sa
cc-by-nc-nd; cc by nc nd; cc by nc nd
creative-commons; creative commons; creative commons(?: license)?
public-domain; public domain; public domain
copyleft; copyleft; copyleft
proprietary; proprietary license; proprietary license
proprietary; all rights reserved; all rights reserved
commercial; commercial license; commercial license
open-source; open source license; open source license
eula; end user license; end user license agreement
spdx; spdx; spdx license identifier
license-reference; license; licensed under
license-reference; license; see (?:the )?license (?:file|text|for details)
license-reference; license; under the terms of the license
"""

#: Share of doubt that a detection of each level leaves.
DOUBT = (0.02, 0.1, 0.4)


def rules() -> list[tuple[int, str, str, str]]:
    """(level, label, keyword, pattern), in order of priority: level, then order of writing."""
    out = []
    for level, text in enumerate((GRANTS, NAMES, MENTIONS)):
        for line in text.strip().splitlines():
            label, keyword, pattern = (x.strip() for x in line.split("; ", 2))
            out.append((level, label, keyword, f"(?<= )(?:{pattern})(?= )"))
    return out
