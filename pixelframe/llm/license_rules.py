"""Signature rules of the licence scan, over words in lower case: ``1.1`` reads as the words ``1 1``.

A rule has a label, a priority (1 is best), a keyword that every match contains as a word, and a regular
expression. Its syntax is what Java's and RE2's engines share; a space stands between words. Parts repeat a bounded
number of times only: Java matches a repeated group by recursion.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    number: int
    label: str
    priority: int
    keyword: str
    pattern: str


_UNDER = "(licensed|released|distributed|available|published|provided|covered|governed|issued|offered|shared|dedicated) (under|by|to) (the )?((terms|conditions) (and conditions )?of )?(the )?"

#: Label, keyword and expression of a name as prose writes it. Every name also makes a notice rule ("licensed under ...").
_NAMES = """
Apache-1.0 | apache | apache (software )?license( version)? v?1 0
Apache-1.1 | apache | apache (software )?license( version)? v?1 1
Apache-2.0 | apache | apache (software )?license( version)? (v2|2)( 0)?
Apache-2.0 | apache | apache (v2|2)( 0)?( license)?
Apache | apache | apache (software )?licen[sc]e
AFL-3.0 | license | academic free license( version)?( v?3 0)?
AGPL-1.0 | affero | affero general public license( version)? v?1( 0)?
AGPL-3.0 | affero | (gnu )?affero general public license( as published by the free software foundation either)?( version)? v?3( 0)?
AGPL | affero | (gnu )?affero general public license
AGPL-3.0 | agpl | agpl( version)? v?3( 0)?
AGPL-3.0 | agplv3 | agplv3
AGPL | agpl | agpl
APSL-2.0 | apple | apple public source license( version)?( v?2 0)?
Artistic-1.0 | artistic | artistic license( version)? v?1( 0)?
Artistic-2.0 | artistic | artistic license( version)? v?2( 0)?
Artistic | artistic | (perl )?artistic license
BSD-2-Clause | bsd | (simplified|freebsd|(2|two) clause) bsd( license)?
BSD-2-Clause | bsd | bsd (2|two) clause( license)?
BSD-3-Clause | bsd | (modified|revised|new|(3|three) clause) bsd( license)?
BSD-3-Clause | bsd | bsd (3|three) clause( license)?
BSD-4-Clause | bsd | (original|old|(4|four) clause) bsd( license)?
BSD-4-Clause | bsd | bsd (4|four) clause( license)?
0BSD | bsd | (zero|0) clause bsd( license)?
0BSD | 0bsd | 0bsd
BSD | bsd | bsd( style)? licen[sc]e
BSL-1.0 | boost | boost software license( version)?( v?1 0)?
BUSL-1.1 | license | business source license( version)?( v?1 1)?
Bzip2-1.0 | bzip2 | bzip2 license
CC-BY-1.0 | cc | cc by 1 0
CC-BY-2.0 | cc | cc by 2 0
CC-BY-2.5 | cc | cc by 2 5
CC-BY-3.0 | cc | cc by 3 0
CC-BY-4.0 | cc | cc by 4 0
CC-BY-SA-1.0 | cc | cc by sa 1 0
CC-BY-SA-2.0 | cc | cc by sa 2 0
CC-BY-SA-2.5 | cc | cc by sa 2 5
CC-BY-SA-3.0 | cc | cc by sa 3 0
CC-BY-SA-4.0 | cc | cc by sa 4 0
CC-BY-SA | cc | cc by sa
CC-BY-ND-2.0 | cc | cc by nd 2 0
CC-BY-ND-3.0 | cc | cc by nd 3 0
CC-BY-ND-4.0 | cc | cc by nd 4 0
CC-BY-ND | cc | cc by nd
CC-BY-NC-2.0 | cc | cc by nc 2 0
CC-BY-NC-2.5 | cc | cc by nc 2 5
CC-BY-NC-3.0 | cc | cc by nc 3 0
CC-BY-NC-4.0 | cc | cc by nc 4 0
CC-BY-NC | cc | cc by nc
CC-BY-NC-SA-2.0 | cc | cc by nc sa 2 0
CC-BY-NC-SA-3.0 | cc | cc by nc sa 3 0
CC-BY-NC-SA-4.0 | cc | cc by nc sa 4 0
CC-BY-NC-SA | cc | cc by nc sa
CC-BY-NC-ND-2.0 | cc | cc by nc nd 2 0
CC-BY-NC-ND-3.0 | cc | cc by nc nd 3 0
CC-BY-NC-ND-4.0 | cc | cc by nc nd 4 0
CC-BY-NC-ND | cc | cc by nc nd
CC0-1.0 | cc0 | cc0( 1 0)?( universal)?
CC0-1.0 | creative | creative commons zero( v?1 0)?( universal)?
CC-BY-4.0 | creative | creative commons attribution 4 0( international)?( public)?( license)?
CC-BY-3.0 | creative | creative commons attribution 3 0( unported)?( license)?
CC-BY-SA-4.0 | creative | creative commons attribution share( )?alike 4 0( international)?( public)?( license)?
CC-BY-SA-3.0 | creative | creative commons attribution share( )?alike 3 0( unported)?( license)?
CC-BY-NC-4.0 | creative | creative commons attribution non( )?commercial 4 0( international)?( public)?( license)?
CC-BY-ND-4.0 | creative | creative commons attribution no( )?deriv(s|atives) 4 0( international)?( public)?( license)?
CC-BY-NC-SA-4.0 | creative | creative commons attribution non( )?commercial share( )?alike 4 0( international)?( public)?( license)?
CC-BY-NC-ND-4.0 | creative | creative commons attribution non( )?commercial no( )?deriv(s|atives) 4 0( international)?( public)?( license)?
Creative-Commons | creative | creative commons( attribution)?( license)?
CDDL-1.0 | cddl | cddl( version)? v?1 0
CDDL-1.1 | cddl | cddl( version)? v?1 1
CDDL | cddl | cddl
CDDL | license | common development and distribution license
CECILL-2.1 | cecill | cecill( version)? v?2( 1)?
CECILL | cecill | cecill( b| c)?
CPL-1.0 | license | common public license( version)?( v?1 0)?
ECL-2.0 | license | educational community license( version)?( v?2 0)?
EPL-1.0 | eclipse | eclipse public license( version)? v?1( 0)?
EPL-2.0 | eclipse | eclipse public license( version)? v?2( 0)?
EPL | eclipse | eclipse public license
EPL | epl | epl( v?[12] 0)?
EUPL-1.1 | eupl | eupl( version)? v?1 1
EUPL-1.2 | eupl | eupl( version)? v?1 2
EUPL | european | european union public licen[sc]e
GFDL-1.1 | gnu | gnu free documentation license( version)? v?1 1
GFDL-1.2 | gnu | gnu free documentation license( version)? v?1 2
GFDL-1.3 | gnu | gnu free documentation license( version)? v?1 3
GFDL | gnu | gnu free documentation license
GFDL | gfdl | gfdl
GPL-1.0 | gnu | gnu general public license( version)? v?1( 0)?
GPL-2.0 | gnu | gnu general public license( version)? v?2( 0)?
GPL-3.0 | gnu | gnu general public license( version)? v?3( 0)?
GPL-2.0-or-later | gnu | gnu general public license( version)? v?2( 0)? or( at your option)?( any)? later( version)?
GPL-3.0-or-later | gnu | gnu general public license( version)? v?3( 0)? or( any)? later( version)?
GPL-any | gnu | gnu (general public license|gpl)
GPL-1.0 | gpl | (gnu )?gpl( version)? v?1( 0)?
GPL-2.0 | gpl | (gnu )?gpl( version)? v?2( 0)?
GPL-3.0 | gpl | (gnu )?gpl( version)? v?3( 0)?
GPL-2.0 | gplv2 | gplv2
GPL-3.0 | gplv3 | gplv3
GPL-any | gpl | gpl
LGPL-2.0 | license | (gnu )?(lesser|library) general public license( version)? v?2( 0)?
LGPL-2.1 | lesser | (gnu )?lesser general public license( version)? v?2 1
LGPL-3.0 | lesser | (gnu )?lesser general public license( version)? v?3( 0)?
LGPL | lesser | (gnu )?lesser general public license
LGPL | license | (gnu )?library general public license
LGPL-2.1 | lgpl | lgpl( version)? v?2 1
LGPL-3.0 | lgpl | lgpl( version)? v?3( 0)?
LGPL-3.0 | lgplv3 | lgplv3
LGPL | lgpl | lgpl
ICU | icu | icu license
IJG | jpeg | independent jpeg group license
IPL-1.0 | ibm | ibm public license( version)?( v?1 0)?
ISC | isc | isc( style)? license
JSON | json | json license
LPPL-1.3c | latex | latex project public license( version)?( v?1 3c?)?
MIT | mit | mit( style| x11)? licen[sc]e
MIT | expat | expat license
MIT-0 | mit | mit no attribution( license)?
MIT | x11 | x11 license
MPL-1.0 | mozilla | mozilla public license( version)? v?1 0
MPL-1.1 | mozilla | mozilla public license( version)? v?1 1
MPL-2.0 | mozilla | mozilla public license( version)? v?2( 0)?
MPL | mozilla | mozilla public license
MPL-1.1 | mpl | mpl v?1 1
MPL-2.0 | mpl | mpl v?2( 0)?
MPL | mpl | mpl
MS-PL | microsoft | microsoft public license
MS-RL | microsoft | microsoft reciprocal license
MulanPSL-2.0 | mulan | mulan permissive software license( v2)?
NCSA | ncsa | (university of illinois )?ncsa (open source )?license
ODbL-1.0 | odbl | odbl( v?1 0)?
ODbL-1.0 | license | open (data commons open )?database license( v?1 0)?
ODC-By-1.0 | commons | open data commons attribution license( v?1 0)?
PDDL-1.0 | pddl | pddl( v?1 0)?
OFL-1.1 | license | (sil )?open font license( version)?( v?1 1)?
OpenSSL | openssl | openssl license
OSL-3.0 | license | open software license( version)?( v?3 0)?
PHP-3.01 | php | php license( version)?( v?3 01)?
PostgreSQL | postgresql | postgresql license
PSF-2.0 | license | python software foundation license( version)?( v?2)?
QPL-1.0 | qpl | qpl( v?1 0)?
Ruby | ruby | ruby license
SSPL-1.0 | sspl | sspl( v?1( 0)?)?
SSPL-1.0 | license | server side public license( version)?( v?1)?
Unlicense | unlicense | (the )?unlicense
UPL-1.0 | license | universal permissive license( version)?( v?1 0)?
Vim | vim | vim license
W3C | w3c | w3c (software )?(notice and )?license
WTFPL | wtfpl | wtfpl
X11-style | xfree86 | xfree86 license
Zlib | zlib | zlib( libpng)? license
ZPL-2.1 | zope | zope public license( version)?( v?2 1)?
"""

#: Label, keyword and expression of what only a licence's own text, address or file header says.
_TEXTS = """
MIT | permission | permission is hereby granted free of charge to any person obtaining a copy
ISC | permission | permission to use copy modify (and or|and) distribute this software for any purpose with or without fee is hereby granted
BSD | redistribution | redistribution and use in source and binary forms with or without modification are permitted
BSD-3-Clause | endorse | may be used to endorse or promote products derived from this software
Apache-2.0 | apache | you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0
Apache-2.0 | apache | www apache org licenses license 2 0( txt| html)?
GPL-any | gnu | www gnu org (licenses|copyleft) gpl( [123] 0)?( txt| html)?
LGPL | gnu | www gnu org (licenses|copyleft) lgpl( [23] [01])?( txt| html)?
AGPL | gnu | www gnu org licenses agpl( 3 0)?( txt| html)?
GFDL | gnu | www gnu org (licenses|copyleft) fdl( 1 [123])?( txt| html)?
GPL-any | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
LGPL | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public license
AGPL | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license
MPL-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
MPL-2.0 | mozilla | mozilla org mpl( 2 0| mpl 2 0)?
EPL | eclipse | www eclipse org legal epl( v10| v20| 2 0)?( html)?
CC-BY | creativecommons | creativecommons org licenses by [1-4] [05]
CC-BY-SA | creativecommons | creativecommons org licenses by sa [1-4] [05]
CC-BY-ND | creativecommons | creativecommons org licenses by nd [1-4] [05]
CC-BY-NC | creativecommons | creativecommons org licenses by nc [1-4] [05]
CC-BY-NC-SA | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
CC-BY-NC-ND | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
CC0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
Public-Domain | creativecommons | creativecommons org publicdomain mark 1 0
BSL-1.0 | boost | www boost org license 1 0( txt)?
MIT | opensource | opensource org licenses mit( license)?( php)?
BSD-3-Clause | opensource | opensource org licenses bsd 3 clause
BSD-2-Clause | opensource | opensource org licenses bsd 2 clause
WTFPL | fuck | do what the fuck you want to public license
Unlicense | unencumbered | this is free and unencumbered software released into the public domain
Zlib | altered | altered source versions must be plainly marked as such
OFL-1.1 | font | this font software is licensed under the sil open font license
"""

#: Label, keyword and expression of what says only that somebody keeps or gives rights.
_HINTS = """
Public-Domain | domain | (in|into|to) the public domain
Public-Domain | domain | public domain( dedication| software| work)?
Copyright | copyright | copyright( c)?( \\d\\d\\d\\d){1,8}
Copyright | copyright | copyright
Copyright | copyrighted | copyrighted( material| work)?
Rights-Kept | reserved | (all|some|no) rights (are )?reserved
Rights-Kept | rechte | alle rechte vorbehalten
Rights-Kept | derechos | todos los derechos reservados
Rights-Kept | droits | tous droits réservés
Proprietary | proprietary | proprietary( and confidential)?( software| license)?
Proprietary | confidential | (strictly |company )?confidential( and proprietary| information)
Proprietary | redistribute | (do not|may not|not to) redistribute
Proprietary | permission | without (the )?(prior |express ){0,4}(written )?permission
Commercial | commercial | commercial (use|licen[sc]e)( only)?
Non-Commercial | noncommercial | noncommercial( use)?( only)?
Non-Commercial | commercial | non commercial( use)?( only)?
Warranty-Disclaimer | warranty | without (any )?warranty( of any kind)?
Warranty-Disclaimer | warranties | without (any )?warranties( or conditions)?( of any kind)?
Warranty-Disclaimer | merchantability | warranty of merchantability
Trademark | trademark | (registered )?trademark
Trademark | trademarks | (registered )?trademarks
Patent-Grant | patent | patent (grant|license)
License-Mention | licensed | licensed (under|by|to)
License-Mention | license | (end user |open source |free |software ){0,4}license( agreement| file| terms)?
License-Mention | licence | (software )?licence( agreement| file| terms)?
License-Mention | eula | eula
License-Mention | copyleft | (strong |weak )?copyleft
License-Mention | spdx | spdx license identifier
License-Mention | lizenz | lizenz
License-Mention | licencia | licencia
"""


def _rows(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split("|", 2)] for line in text.strip().splitlines()]


def _made() -> list[Rule]:
    found: list[tuple[str, int, str, str]] = []
    names = _rows(_NAMES)
    for label in dict.fromkeys(label for label, _, _ in names):
        words = "( )?".join(part for part in label.lower().replace("-", " ").replace(".", " ").split())
        found.append((label, 1, "spdx", f"spdx license identifier {words.replace('( )?', ' ')}"))
    found += [(label, 1, keyword, pattern) for label, keyword, pattern in _rows(_TEXTS)]
    found += [(label, 2, keyword, _UNDER + f"({pattern})") for label, keyword, pattern in names]
    found += [(label, 3, keyword, pattern) for label, keyword, pattern in names]
    found += [(label, 4, keyword, pattern) for label, keyword, pattern in _rows(_HINTS)]
    return [Rule(n, *rule) for n, rule in enumerate(found)]


RULES = _made()
