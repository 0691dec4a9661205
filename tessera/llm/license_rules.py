"""Hand-written licence signatures over ' '-separated lower-case words.

One rule a line: label | priority | keyword | regex. The keyword is a piece of text that every match
of the regex contains. Priorities: 4 identifier tags, 3 sentences of licence texts, 2 notices,
1 names, 0 hints. Among equal intervals and priorities the earlier rule wins.
"""

from __future__ import annotations

RULES_TEXT = r"""
apache-2.0 | 4 | spdx license identifier apache | spdx license identifier apache 2 0
apache-1.1 | 4 | spdx license identifier apache | spdx license identifier apache 1 1
mit | 4 | spdx license identifier mit | spdx license identifier mit(?! 0| no)
mit-0 | 4 | spdx license identifier mit 0 | spdx license identifier mit 0
bsd-2-clause | 4 | spdx license identifier bsd 2 | spdx license identifier bsd 2 clause(?: simplified)?
bsd-3-clause | 4 | spdx license identifier bsd 3 | spdx license identifier bsd 3 clause(?: new| revised)?
bsd-4-clause | 4 | spdx license identifier bsd 4 | spdx license identifier bsd 4 clause
0bsd | 4 | spdx license identifier 0bsd | spdx license identifier 0bsd
gpl-1.0-or-later | 4 | spdx license identifier gpl 1 | spdx license identifier gpl 1 0(?: or later)?
gpl-2.0-only | 4 | spdx license identifier gpl 2 | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | 4 | spdx license identifier gpl 2 0 or later | spdx license identifier gpl 2 0 or later
gpl-3.0-only | 4 | spdx license identifier gpl 3 | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | 4 | spdx license identifier gpl 3 0 or later | spdx license identifier gpl 3 0 or later
lgpl-2.0 | 4 | spdx license identifier lgpl 2 0 | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 4 | spdx license identifier lgpl 2 1 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 4 | spdx license identifier lgpl 3 0 | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-1.0 | 4 | spdx license identifier agpl 1 0 | spdx license identifier agpl 1 0(?: only| or later)?
agpl-3.0 | 4 | spdx license identifier agpl 3 0 | spdx license identifier agpl 3 0(?: only| or later)?
mpl-1.0 | 4 | spdx license identifier mpl 1 0 | spdx license identifier mpl 1 0
mpl-1.1 | 4 | spdx license identifier mpl 1 1 | spdx license identifier mpl 1 1
mpl-2.0 | 4 | spdx license identifier mpl 2 0 | spdx license identifier mpl 2 0
epl-1.0 | 4 | spdx license identifier epl 1 0 | spdx license identifier epl 1 0
epl-2.0 | 4 | spdx license identifier epl 2 0 | spdx license identifier epl 2 0
cddl-1.0 | 4 | spdx license identifier cddl 1 0 | spdx license identifier cddl 1 0
cddl-1.1 | 4 | spdx license identifier cddl 1 1 | spdx license identifier cddl 1 1
isc | 4 | spdx license identifier isc | spdx license identifier isc
zlib | 4 | spdx license identifier zlib | spdx license identifier zlib
unlicense | 4 | spdx license identifier unlicense | spdx license identifier unlicense
wtfpl | 4 | spdx license identifier wtfpl | spdx license identifier wtfpl
cc0-1.0 | 4 | spdx license identifier cc0 | spdx license identifier cc0 1 0
cc-by-3.0 | 4 | spdx license identifier cc by 3 0 | spdx license identifier cc by 3 0
cc-by-4.0 | 4 | spdx license identifier cc by 4 0 | spdx license identifier cc by 4 0
cc-by-sa-3.0 | 4 | spdx license identifier cc by sa 3 0 | spdx license identifier cc by sa 3 0
cc-by-sa-4.0 | 4 | spdx license identifier cc by sa 4 0 | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | 4 | spdx license identifier cc by nc 4 0 | spdx license identifier cc by nc 4 0
cc-by-nd-4.0 | 4 | spdx license identifier cc by nd 4 0 | spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0 | 4 | spdx license identifier cc by nc sa 4 0 | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | 4 | spdx license identifier cc by nc nd 4 0 | spdx license identifier cc by nc nd 4 0
bsl-1.0 | 4 | spdx license identifier bsl | spdx license identifier bsl 1 0
busl-1.1 | 4 | spdx license identifier busl | spdx license identifier busl 1 1
artistic-1.0 | 4 | spdx license identifier artistic 1 | spdx license identifier artistic 1 0
artistic-2.0 | 4 | spdx license identifier artistic 2 | spdx license identifier artistic 2 0
eupl-1.1 | 4 | spdx license identifier eupl 1 1 | spdx license identifier eupl 1 1
eupl-1.2 | 4 | spdx license identifier eupl 1 2 | spdx license identifier eupl 1 2
ofl-1.1 | 4 | spdx license identifier ofl | spdx license identifier ofl 1 1
postgresql | 4 | spdx license identifier postgresql | spdx license identifier postgresql
python-2.0 | 4 | spdx license identifier python | spdx license identifier python 2 0
ms-pl | 4 | spdx license identifier ms pl | spdx license identifier ms pl
ms-rl | 4 | spdx license identifier ms rl | spdx license identifier ms rl
odbl-1.0 | 4 | spdx license identifier odbl | spdx license identifier odbl 1 0
sspl-1.0 | 4 | spdx license identifier sspl | spdx license identifier sspl 1 0
upl-1.0 | 4 | spdx license identifier upl | spdx license identifier upl 1 0
mulanpsl-2.0 | 4 | spdx license identifier mulanpsl | spdx license identifier mulanpsl 2 0
blueoak-1.0.0 | 4 | spdx license identifier blueoak | spdx license identifier blueoak 1 0 0
vim | 4 | spdx license identifier vim | spdx license identifier vim
openssl | 4 | spdx license identifier openssl | spdx license identifier openssl
ecl-2.0 | 4 | spdx license identifier ecl | spdx license identifier ecl 2 0
ncsa | 4 | spdx license identifier ncsa | spdx license identifier ncsa
mit | 3 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 3 | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 3 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc | 3 | permission to use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | 3 | permission to use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
bsd-3-clause | 3 | neither the name of | neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|the) contributors may be used to endorse or promote products
bsd-4-clause | 3 | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | 3 | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
bsd | 3 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
apache-2.0 | 3 | unless required by applicable law or agreed to in writing | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | 3 | you may not use this file except in compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-1.1 | 3 | this product includes software developed by the apache | this product includes software developed by the apache (?:software foundation|group)
gpl | 3 | it under the terms of the gnu general public license | (?:you can|you may) redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0-or-later | 3 | either version 2 of the license | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | 3 | either version 3 of the license | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only | 3 | general public license version 2 | gnu general public license version 2 as published by the free software foundation
gpl | 3 | without even the implied warranty of merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |affero |library )?general public license
gpl-3.0 | 3 | the gnu general public license is a free copyleft license | the gnu general public license is a free copyleft license for software and other kinds of works
lgpl-2.1-or-later | 3 | either version 2 1 of the license | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | 3 | gnu lesser general public license | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-or-later | 3 | gnu library general public license | gnu library general public license as published by the free software foundation either version 2 of the license
agpl-3.0-or-later | 3 | gnu affero general public license | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
mpl-2.0 | 3 | subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 3 | mozilla public license version 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | 3 | mozilla public license version 1 | the contents of this file are subject to the mozilla public license version 1 0
epl-1.0 | 3 | eclipse public license v1 0 | made available under the terms of the eclipse public license v1 0
epl-2.0 | 3 | eclipse public license 2 0 | made available under the terms of the eclipse public license 2 0
cddl-1.0 | 3 | common development and distribution license | subject to the terms of the common development and distribution license(?: version)?(?: 1 0)?
zlib | 3 | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 3 | this software is provided as is without any express or implied | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
unlicense | 3 | free and unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | 3 | you just do what the fuck you want to | you just do what the fuck you want to
bsl-1.0 | 3 | boost software license | distributed under the boost software license version 1 0
artistic-2.0 | 3 | artistic license 2 0 | under the terms of the artistic license 2 0
artistic-perl | 3 | under the same terms as perl itself | under the same terms as perl itself
ms-pl | 3 | this license governs use of the accompanying software | this license governs use of the accompanying software if you use the software you accept this license
ofl-1.1 | 3 | sil open font license | this font software is licensed under the sil open font license version 1 1
odbl-1.0 | 3 | open database license | made available under the open database license
cc0-1.0 | 3 | waived all copyright and related or neighboring rights | waived all copyright and related or neighboring rights
cc-by-4.0 | 3 | creative commons attribution 4 0 international | licensed under (?:a|the) creative commons attribution 4 0 international licen[cs]e
cc-by-sa-4.0 | 3 | creative commons attribution sharealike 4 0 | licensed under (?:a|the) creative commons attribution sharealike 4 0 international licen[cs]e
cc-by-nc-4.0 | 3 | creative commons attribution noncommercial 4 0 | licensed under (?:a|the) creative commons attribution noncommercial 4 0 international licen[cs]e
cc-by-nd-4.0 | 3 | creative commons attribution noderiv | licensed under (?:a|the) creative commons attribution noderiv(?:ative)?s 4 0 international licen[cs]e
cc-by-nc-sa-4.0 | 3 | creative commons attribution noncommercial sharealike 4 0 | licensed under (?:a|the) creative commons attribution noncommercial sharealike 4 0 international licen[cs]e
cc-by-nc-nd-4.0 | 3 | creative commons attribution noncommercial noderiv | licensed under (?:a|the) creative commons attribution noncommercial noderiv(?:ative)?s 4 0 international licen[cs]e
openssl | 3 | for use in the openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
python-2.0 | 3 | python software foundation license version 2 | python software foundation license version 2
postgresql | 3 | permission to use copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | 3 | permission to use copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
ncsa | 3 | deal with the software without restriction | deal with the software without restriction
curl | 3 | permission to use copy modify and distribute this software for any purpose | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
beerware | 3 | the beer ware license | the beer ware license revision 42
proprietary | 3 | unauthorized copying of this file | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 3 | proprietary and confidential | (?:is )?proprietary and confidential
all-rights-reserved | 3 | no part of this publication may be reproduced | no part of this publication may be reproduced
apache-2.0 | 2 | under the apache license | licen[cs]ed under the apache license(?: version)? 2(?: 0)?
apache-2.0 | 2 | apache | (?:licen[cs]ed|released|distributed|available) under (?:the )?apache(?: license)?(?: version)? 2 0
apache-2.0 | 2 | under the apache 2 0 licen | under the apache 2 0 licen[cs]e
apache | 2 | under the apache license | (?:licen[cs]ed|released|distributed|available) under the apache license
mit | 2 | under the mit licen | (?:licen[cs]ed|released|distributed|available|published) under the mit licen[cs]e
mit | 2 | mit licen | under the terms of the mit licen[cs]e
mit | 2 | mit licen | (?:is|are) mit licen[cs]ed
bsd-3-clause | 2 | bsd 3 clause | under the bsd 3 clause licen[cs]e
bsd-3-clause | 2 | 3 clause bsd | under (?:the|a) 3 clause bsd licen[cs]e
bsd-2-clause | 2 | bsd 2 clause | under the bsd 2 clause licen[cs]e
bsd-2-clause | 2 | 2 clause bsd | under (?:the|a) 2 clause bsd licen[cs]e
bsd | 2 | bsd style licen | governed by a bsd style licen[cs]e
bsd | 2 | under the bsd licen | under the bsd licen[cs]e
gpl-3.0 | 2 | under the gnu general public license | (?:licen[cs]ed|released|distributed|available) under the gnu general public license version 3(?: 0)?
gpl-2.0 | 2 | under the gnu general public license | (?:licen[cs]ed|released|distributed|available) under the gnu general public license version 2(?: 0)?
gpl-3.0 | 2 | under the gpl | (?:licen[cs]ed|released|distributed|available) under the gpl(?: version)? v?3(?: 0)?
gpl-2.0 | 2 | under the gpl | (?:licen[cs]ed|released|distributed|available) under the gpl(?: version)? v?2(?: 0)?
gpl | 2 | gnu general public license | (?:licen[cs]ed|released|distributed|available) under the (?:terms of the )?gnu general public license
gpl | 2 | under the terms of the gpl | under the terms of the gpl
lgpl-3.0 | 2 | under the gnu lesser general public license | under the gnu lesser general public license version 3(?: 0)?
lgpl-2.1 | 2 | under the gnu lesser general public license | under the gnu lesser general public license version 2 1
lgpl | 2 | under the lgpl | under the lgpl(?: v?(?:2|2 1|3))?
agpl-3.0 | 2 | under the gnu affero general public license | under the gnu affero general public license version 3(?: 0)?
agpl | 2 | under the agpl | under the agpl(?: v?3)?
mpl-2.0 | 2 | under the mozilla public license | under the mozilla public license(?: version)? 2(?: 0)?
mpl | 2 | under the mpl | under the mpl(?: 2 0)?
epl | 2 | under the eclipse public license | under the eclipse public license
cddl | 2 | under the cddl | under the cddl
isc | 2 | under the isc licen | under the isc licen[cs]e
zlib | 2 | under the zlib | under the zlib(?: libpng)? licen[cs]e
unlicense | 2 | under the unlicense | under the unlicense
cc-by-nc-4.0 | 2 | under cc by nc 4 0 | licen[cs]ed under cc by nc 4 0
cc-by-nc-sa-4.0 | 2 | under cc by nc sa 4 0 | licen[cs]ed under cc by nc sa 4 0
cc-by-nc-nd-4.0 | 2 | under cc by nc nd 4 0 | licen[cs]ed under cc by nc nd 4 0
cc-by-4.0 | 2 | under cc by 4 0 | licen[cs]ed under cc by 4 0
cc-by-sa-4.0 | 2 | under cc by sa 4 0 | licen[cs]ed under cc by sa 4 0
cc-by-nd-4.0 | 2 | under cc by nd 4 0 | licen[cs]ed under cc by nd 4 0
cc-by-3.0 | 2 | under cc by 3 0 | licen[cs]ed under cc by 3 0
cc-by-sa-3.0 | 2 | under cc by sa 3 0 | licen[cs]ed under cc by sa 3 0
cc-by-nc-3.0 | 2 | under cc by nc 3 0 | licen[cs]ed under cc by nc 3 0
cc0-1.0 | 2 | under cc0 | (?:licen[cs]ed|released|dedicated) under cc0
public-domain | 2 | public domain | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
cc-by-4.0 | 2 | creativecommons org licenses by 4 0 | creativecommons org licenses by 4 0
cc-by-3.0 | 2 | creativecommons org licenses by 3 0 | creativecommons org licenses by 3 0
cc-by-2.0 | 2 | creativecommons org licenses by 2 0 | creativecommons org licenses by 2 0
cc-by-sa-4.0 | 2 | creativecommons org licenses by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 2 | creativecommons org licenses by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | 2 | creativecommons org licenses by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | 2 | creativecommons org licenses by nc 3 0 | creativecommons org licenses by nc 3 0
cc-by-nd-4.0 | 2 | creativecommons org licenses by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | 2 | creativecommons org licenses by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | 2 | creativecommons org licenses by nc sa 3 0 | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0 | 2 | creativecommons org licenses by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | 2 | creativecommons org licenses by nc nd 3 0 | creativecommons org licenses by nc nd 3 0
cc0-1.0 | 2 | creativecommons org publicdomain zero 1 0 | creativecommons org publicdomain zero 1 0
apache-2.0 | 2 | apache org licenses license 2 0 | (?:www )?apache org licenses license 2 0
mit | 2 | opensource org licenses mit | opensource org licenses mit
bsd-3-clause | 2 | opensource org licenses bsd 3 clause | opensource org licenses bsd 3 clause
gpl | 2 | gnu org licenses | (?:www )?gnu org licenses gpl
lgpl | 2 | gnu org licenses | (?:www )?gnu org licenses lgpl
agpl | 2 | gnu org licenses | (?:www )?gnu org licenses agpl
fdl-1.3 | 2 | gnu free documentation license | under the (?:terms of the )?gnu free documentation license
mpl-2.0 | 2 | mozilla org mpl 2 0 | (?:www )?mozilla org mpl 2 0
unlicense | 2 | unlicense org | unlicense org
busl-1.1 | 2 | business source license | under the business source license(?: 1 1)?
sspl-1.0 | 2 | server side public license | under the server side public license
elastic-2.0 | 2 | elastic license | under the elastic license(?: 2 0)?
eupl-1.2 | 2 | european union public licence | under the (?:terms of the )?european union public licence(?: v ?1 2)?
ms-pl | 2 | microsoft public license | under the microsoft public license
wtfpl | 2 | under the wtfpl | under the wtfpl
copyright-notice | 2 | all rights reserved | copyright (?:c )?(?:[0-9]{4} )+(?:[^ ]+ ){1,8}all rights reserved
apache-2.0 | 1 | apache license | apache license(?: version)? 2 0
apache-2.0 | 1 | apache 2 0 | apache 2 0
apache-1.1 | 1 | apache | apache (?:software )?license(?: version)? 1 1
apache | 1 | apache license | apache license
mit | 1 | mit licen | mit licen[cs]e
mit | 1 | expat licen | expat licen[cs]e
bsd-4-clause | 1 | bsd 4 clause | bsd 4 clause(?: licen[cs]e)?
bsd-3-clause | 1 | bsd 3 clause | bsd 3 clause(?: licen[cs]e)?
bsd-3-clause | 1 | new bsd licen | new bsd licen[cs]e
bsd-3-clause | 1 | modified bsd licen | modified bsd licen[cs]e
bsd-2-clause | 1 | bsd 2 clause | bsd 2 clause(?: licen[cs]e)?
bsd-2-clause | 1 | simplified bsd licen | simplified bsd licen[cs]e
bsd | 1 | bsd licen | bsd licen[cs]e
gpl-3.0 | 1 | general public license | gnu general public license(?: version| v)? ?3(?: 0)?
gpl-2.0 | 1 | general public license | gnu general public license(?: version| v)? ?2(?: 0)?
gpl-3.0 | 1 | gplv3 | gplv3
gpl-2.0 | 1 | gplv2 | gplv2
gpl | 1 | general public license | (?:gnu )?general public license
lgpl-3.0 | 1 | lgplv3 | lgplv3
lgpl-2.1 | 1 | lgplv2 | lgplv2(?: 1)?
lgpl | 1 | lesser general public license | (?:gnu )?lesser general public license
lgpl | 1 | library general public license | (?:gnu )?library general public license
agpl-3.0 | 1 | agplv3 | agplv3
agpl | 1 | affero general public license | (?:gnu )?affero general public license
fdl | 1 | free documentation license | (?:gnu )?free documentation license
mpl-2.0 | 1 | mozilla public license | mozilla public license(?: version)? 2 0
mpl | 1 | mozilla public license | mozilla public license
epl-2.0 | 1 | eclipse public license | eclipse public license(?: version)?(?: v)? ?2 0
epl-1.0 | 1 | eclipse public license | eclipse public license(?: version)?(?: v)? ?1 0
epl | 1 | eclipse public license | eclipse public license
edl-1.0 | 1 | eclipse distribution license | eclipse distribution license
cddl | 1 | common development and distribution license | common development and distribution license
cpl-1.0 | 1 | common public license | common public license(?: 1 0)?
ipl-1.0 | 1 | ibm public license | ibm public license
isc | 1 | isc licen | isc licen[cs]e
zlib | 1 | zlib licen | zlib licen[cs]e
libpng | 1 | libpng licen | libpng licen[cs]e
bsl-1.0 | 1 | boost software license | boost software license
artistic | 1 | artistic license | artistic license
ofl-1.1 | 1 | open font license | (?:sil )?open font license
eupl | 1 | european union public licen | european union public licen[cs]e
cecill | 1 | cecill | cecill(?: [bc])?
osl-3.0 | 1 | open software license | open software license(?: 3 0)?
afl-3.0 | 1 | academic free license | academic free license(?: 3 0)?
qpl-1.0 | 1 | q public license | q public license
w3c | 1 | w3c software | w3c software (?:notice and )?license
ncsa | 1 | university of illinois | university of illinois ncsa open source license
odbl | 1 | open database license | open database license
pddl-1.0 | 1 | public domain dedication | public domain dedication and licen[cs]e
odc-by-1.0 | 1 | open data commons attribution | open data commons attribution licen[cs]e
ogl | 1 | open government licen | open government licen[cs]e
etalab-2.0 | 1 | licence ouverte | licence ouverte
dl-de-by-2.0 | 1 | datenlizenz deutschland | datenlizenz deutschland
openrail | 1 | openrail | (?:creativeml |bigscience )?openrail(?: m)?
polyform | 1 | polyform | polyform (?:noncommercial|shield|strict|small business)
cc-by-nc-nd-4.0 | 1 | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-sa-4.0 | 1 | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-4.0 | 1 | cc by nc 4 0 | cc by nc 4 0
cc-by-nd-4.0 | 1 | cc by nd 4 0 | cc by nd 4 0
cc-by-sa-4.0 | 1 | cc by sa 4 0 | cc by sa 4 0
cc-by-4.0 | 1 | cc by 4 0 | cc by 4 0
cc-by-sa-3.0 | 1 | cc by sa 3 0 | cc by sa 3 0
cc-by-3.0 | 1 | cc by 3 0 | cc by 3 0
cc-by-nc-nd | 1 | attribution noncommercial noderiv | attribution noncommercial noderiv(?:ative)?s
cc-by-nc-sa | 1 | attribution noncommercial sharealike | attribution noncommercial sharealike
cc-by-nc | 1 | attribution noncommercial | attribution noncommercial
cc-by-sa | 1 | attribution sharealike | attribution sharealike
creative-commons | 1 | creative commons | creative commons(?: attribution)?(?: licen[cs]e)?
public-domain | 1 | in the public domain | (?:is|are) in the public domain
all-rights-reserved | 1 | all rights reserved | all rights reserved
all-rights-reserved | 1 | alle rechte vorbehalten | alle rechte vorbehalten
all-rights-reserved | 1 | tous droits r | tous droits réservés
all-rights-reserved | 1 | todos los derechos reservados | todos los derechos reservados
licence-hint | 0 | subject to the following conditions | subject to the following conditions
licence-hint | 0 | see the license file | see the license file
licence-hint | 0 | licensed under | licensed under
licence-hint | 0 | lizenziert unter | lizenziert unter
"""

#: (label, priority, keyword, regex) in order.
RULES = [(a, int(b), c, d) for a, b, c, d in (tuple(x.strip() for x in line.split(" | ", 3)) for line in RULES_TEXT.strip().splitlines())]
#: Every keyword contains one of these; texts without any are settled by substring searches alone.
GATES = (
    "licen", "copyright", "apache", "public domain", "permission", "redistribut", "gpl", "bsd", "cc by", "creative", "attribution", "reserved",
    "vorbehalten", "droits r", "derechos", "lizenz", "neither the name", "advertising", "applicable law", "this file except", "merchantab",
    "altered source", "without any express", "do what the", "perl itself", "openssl", "deal with the software", "unauthorized", "proprietary",
    "of this publication", "under the mpl", "cddl", "under cc0", "mozilla org", "wtfpl", "cecill", "w3c software", "university of illinois",
    "openrail", "polyform", "zlib", "subject to the following",
)
