"""License scanning by ordered signature rules behind a keyword prefilter.

Rules are regular expressions with a label, a priority and a confidence: hand-written signatures
of texts, notices, titles and links, and the names of licenses in the phrases that mention one.
From each expression follow the literals that every match of it must contain; one pass of an
Aho-Corasick automaton finds them in a text whose white space is collapsed, and only the rules all
of whose literals are there run, on the text as it is.  Detections stand in the order of their
priority, then their length: one that is contained in a standing one, or overlaps it, goes.

Beside that stand exact counts of a few fixed phrases over the words of the text.

Defined cases: null text counts as empty; no detection -> empty labels and score 0; of equal
intervals and priorities the rule that is listed first stands; repeated rows and null ids are
scanned one by one; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record

#: Fixed base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: label, expression for the license's name.
NAMES = (
    ("mit", r"(?:the )?(?:expat|mit)(?:/x11)?(?: license)?"),
    ("x11", r"x11 license"),
    ("apache-2.0", r"(?:the )?apache(?: software)?(?: license)?(?:-|,? ?)(?:version |v)?2(?:\.0)?"),
    ("apache-1.1", r"(?:the )?apache(?: software)?(?: license)?(?:-|,? ?)(?:version |v)?1\.1"),
    ("apache", r"(?:the )?apache(?: software)? license"),
    ("gpl-2.0", r"(?:the )?(?:gnu )?(?:general public license|gpl)(?:-|,? ?)(?:version |v)?2(?:\.0)?"),
    ("gpl-3.0", r"(?:the )?(?:gnu )?(?:general public license|gpl)(?:-|,? ?)(?:version |v)?3(?:\.0)?"),
    ("gpl", r"(?:the )?(?:gnu )?(?:general public license|gpl)"),
    ("lgpl-2.1", r"(?:the )?(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?:-|,? ?)(?:version |v)?2\.1"),
    ("lgpl-3.0", r"(?:the )?(?:gnu )?(?:lesser general public license|lgpl)(?:-|,? ?)(?:version |v)?3(?:\.0)?"),
    ("lgpl", r"(?:the )?(?:gnu )?(?:lesser general public license|lgpl)"),
    ("agpl-3.0", r"(?:the )?(?:gnu )?(?:affero general public license|agpl)(?:-|,? ?)(?:version |v)?3(?:\.0)?"),
    ("agpl", r"(?:the )?(?:gnu )?(?:affero general public license|agpl)"),
    ("bsd-2-clause", r"(?:the )?(?:bsd[- ]2[- ]clause|(?:simplified|2-clause) bsd)(?: license)?"),
    ("bsd-3-clause", r"(?:the )?(?:bsd[- ]3[- ]clause|(?:new|modified|revised|3-clause) bsd)(?: license)?"),
    ("bsd", r"(?:the )?bsd(?:-style)? license"),
    ("mpl-2.0", r"(?:the )?(?:mozilla public license|mpl)(?:-|,? ?)(?:version |v)?2(?:\.0)?"),
    ("mpl-1.1", r"(?:the )?(?:mozilla public license|mpl)(?:-|,? ?)(?:version |v)?1\.1"),
    ("epl-2.0", r"(?:the )?(?:eclipse public license|epl)(?:-|,? ?)(?:version |v|- ?v ?)?2(?:\.0)?"),
    ("epl-1.0", r"(?:the )?(?:eclipse public license|epl)(?:-|,? ?)(?:version |v|- ?v ?)?1(?:\.0)?"),
    ("eupl-1.2", r"(?:the )?(?:european union public licen[cs]e|eupl)(?:-|,? ?)(?:version |v\.? ?)?1\.2"),
    ("cddl-1.0", r"(?:the )?(?:common development and distribution license|cddl)(?:-|,? ?)(?:version |v)?1(?:\.0)?"),
    ("isc", r"(?:the )?isc license"),
    ("zlib", r"(?:the )?zlib(?:/libpng)? license"),
    ("boost-1.0", r"(?:the )?boost software license(?:-|,? ?)(?:version |v)?1\.0"),
    ("artistic-2.0", r"(?:the )?artistic license(?:-|,? ?)(?:version |v)?2\.0"),
    ("python-2.0", r"(?:the )?(?:python software foundation|psf) license(?: version 2)?"),
    ("unlicense", r"(?:the )?unlicense"),
    ("wtfpl", r"(?:the )?(?:wtfpl|do what the fuck you want to public license)"),
    ("cc0-1.0", r"(?:cc0|creative commons zero)(?: ?v?1\.0)?(?: universal)?"),
    *((f"cc-{kind}-{v}", rf"(?:cc|creative commons)[- ]{kind}[- ]{re.escape(v)}(?: international)?") for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("2.0", "2.5", "3.0", "4.0")),
    *((f"cc-{kind}", rf"(?:cc|creative commons)[- ]{kind}") for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")),
)
#: Phrases around a name: expression, priority.
FRAMES = (
    (r"spdx-license-identifier: ?{name}", 4),
    (r"(?:licensed|released|distributed|available|published) under (?:the terms of )?{name}", 3),
    (r"(?:terms|conditions) of {name}", 2),
    (r"license ?[:=] ?[\"']?{name}", 2),
    (r"{name} licen[cs]e", 1),
)
#: How sure a detection of a priority is.
CONFIDENCE = {5: 0.97, 4: 0.97, 3: 0.93, 2: 0.8, 1: 0.6}

#: Signatures of licence texts, notices, titles and links, one a line: label, priority, expression; matched in lower-cased text, a blank stands for any white space, " ?" for none or any.
TEXTS = r"""
mit 5 permission is hereby granted, free of charge, to any person obtaining a copy
mit 5 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 5 to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge
mit-0 5 to use, copy, modify, merge, publish, distribute, sublicense, and(?:/or)? sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided
x11 5 except as contained in this notice, the names? of the (?:x consortium|above copyright holders?) shall not be used in advertising
isc 5 permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that
0bsd 5 permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\.
bsd 5 redistribution and use in source and binary forms, with or without modification
bsd-3-clause 5 neither the names? of the (?:copyright holders?|university|author|project|organi[sz]ation) nor the names of (?:its|their|any) contributors
bsd-4-clause 5 all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-2-clause-patent 5 a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable \(except for failure to satisfy the conditions of this license\) patent license
apache-2.0 5 licensed to the apache software foundation \(asf\) under one or more contributor license agreements
apache-2.0 5 you may not use this file except in compliance with the license\. you may obtain a copy of the license at
apache-2.0 5 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an ["']as is["'] basis
apache-2.0 5 each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license
apache-1.1 5 the end-user documentation included with the redistribution, if any, must include the following acknowledge?ment
gpl-2.0+ 5 it under the terms of the gnu general public license as published by the free software foundation[;,] either version 2(?: of the license)?, or \(at your option\) any later version
gpl-3.0+ 5 it under the terms of the gnu general public license as published by the free software foundation[;,] either version 3(?: of the license)?, or \(at your option\) any later version
gpl-2.0 5 under the terms of the gnu general public license version 2 as published by the free software foundation
gpl 5 you should have received a copy of the gnu general public license along with this program
gpl-2.0 5 the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 5 the gnu general public license is a free, copyleft license for software and other kinds of works
lgpl-2.1+ 5 it under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 2\.1(?: of the license)?, or \(at your option\) any later version
lgpl-3.0+ 5 it under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 3(?: of the license)?, or \(at your option\) any later version
lgpl-2.0+ 5 it under the terms of the gnu library general public license as published by the free software foundation
lgpl 5 you should have received a copy of the gnu (?:lesser|library) general public license along with this library
agpl-3.0+ 5 it under the terms of the gnu affero general public license as published by the free software foundation
agpl-3.0 5 you should have received a copy of the gnu affero general public license along with this program
gfdl 5 permission is granted to copy, distribute and(?:/or)? modify this document under the terms of the gnu free documentation license
gcc-exception 5 when you use gcc to compile a program, gcc may combine portions of certain gcc header files and runtime libraries with the compiled program
classpath-exception 5 as a special exception, the copyright holders of this library give you permission to link this library with independent modules
mpl-2.0 5 this source code form is subject to the terms of the mozilla public license, v\. 2\.0
mpl-1.1 5 the contents of this file are subject to the mozilla public license version 1\.1
npl-1.1 5 the contents of this file are subject to the netscape public license version 1\.1
epl-1.0 5 this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0
epl-2.0 5 this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\. ?)?2\.0
cpl-1.0 5 this program and the accompanying materials are made available under the terms of the common public license v1\.0
edl-1.0 5 made available under the terms of the eclipse distribution license v1\.0
cddl-1.0 5 the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only \(["']gpl["']\) or )?the common development and distribution license
eupl-1.2 5 licensed under the eupl, version 1\.2 or - as soon they will be approved by the european commission - subsequent versions
zlib 5 this software is provided ['"]as-is['"], without any express or implied warranty\. in no event will the authors be held liable for any damages arising from the use of this software
zlib 5 altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
boost-1.0 5 permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
artistic-2.0 5 everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed\. preamble this license establishes the terms under which a given free software package may be copied
artistic-1.0 5 the intent of this document is to state the conditions under which a package may be copied
python-2.0 5 psf hereby grants licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform
ofl-1.1 5 this font software is licensed under the sil open font license, version 1\.1
ofl-1.1 5 the goals of the open font license \(ofl\) are to stimulate worldwide development of collaborative font projects
unlicense 5 this is free and unencumbered software released into the public domain
wtfpl 5 everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed
wtfpl 5 you just do what the fuck you want to
cc0-1.0 5 to the extent possible under law, the (?:author|person who associated cc0)
cc0-1.0 5 a work made available under cc0 may be protected by copyright and related or neighboring rights
cc 5 you are free to:? share ?(?:-|—) ?copy and redistribute the material in any medium or format
curl 5 permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
openssl 5 this product includes software developed by the openssl project for use in the openssl toolkit
ssleay 5 this product includes cryptographic software written by eric young
ijg 5 this software is based in part on the work of the independent jpeg group
libpng 5 the png reference library is supplied ["']as is["']
ncsa 5 redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation
postgresql 5 permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
hpnd 5 permission to use, copy, modify,? (?:and )?distribute,? (?:and sell )?this software and its documentation for any purpose (?:is hereby granted )?without fee
tcl 5 the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose
w3c 5 by obtaining(?:, using and/or copying|,? using,? and/or copying)? this work, you \(the licensee\) agree that you have read, understood, and will comply with the following terms
unicode 5 to deal in the data files or software without restriction
icu 5 permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the ["']software["']\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, and/or sell copies
vim 5 there are no restrictions on distributing unmodified copies of vim except that they must include this license text
beerware 5 as long as you retain this notice you can do whatever you want with this stuff
json 5 the software shall be used for good, not evil
bzip2 5 the origin of this software must not be misrepresented; you must not claim that you wrote the original software
php-3.01 5 this product includes php software, freely available from
ruby 5 you may modify your copy of the software in any way, provided that you do at least one of the following
sleepycat 5 redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
upl-1.0 5 subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data
ms-pl 5 each contributor grants you a non-exclusive, worldwide, royalty-free copyright license to reproduce its contribution, prepare derivative works
ms-rl 5 for any file you distribute that contains code from the software \(in source code or binary format\), you must provide recipients the source code
afl-3.0 5 licensed under the academic free license version 3\.0
osl-3.0 5 licensed under the open software license version 3\.0
busl-1.1 5 the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work
elastic-2.0 5 you may not provide the software to third parties as a hosted or managed service
sspl-1.0 5 if you make the functionality of the program or a modified version available to third parties as a service
commons-clause 5 the license does not grant to you, the right to sell the software
odbl-1.0 5 is made available under the open database license
proprietary 5 this software is the confidential and proprietary information of
proprietary 5 unauthori[sz]ed copying of this file, via any medium,? is strictly prohibited
proprietary 5 no part of this (?:publication|document|software|book) may be reproduced, (?:stored|distributed|copied)
"""
NOTICES = r"""
gpl-2.0+ 3 (?:gnu )?(?:general public license|gpl)(?:,)? (?:version |v)2(?:\.0)? or (?:any )?(?:later|newer)
gpl-3.0+ 3 (?:gnu )?(?:general public license|gpl)(?:,)? (?:version |v)3(?:\.0)? or (?:any )?(?:later|newer)
lgpl-2.1+ 3 (?:gnu )?(?:lesser general public license|lgpl)(?:,)? (?:version |v)2\.1 or (?:any )?(?:later|newer)
lgpl-3.0+ 3 (?:gnu )?(?:lesser general public license|lgpl)(?:,)? (?:version |v)3(?:\.0)? or (?:any )?(?:later|newer)
agpl-3.0+ 3 (?:gnu )?(?:affero general public license|agpl)(?:,)? (?:version |v)3(?:\.0)? or (?:any )?(?:later|newer)
gpl-1.0+ 3 same terms as perl(?: itself)?
perl 3 under the same terms as the perl ?5 programming language(?: system)? itself
mit 3 this (?:project|software|library|code|package) is (?:mit|expat)[- ]licensed
bsd 3 this (?:project|software|library|code|package) is bsd[- ]licensed
apache-2.0 3 this (?:project|software|library|code|package) is apache[- ]2(?:\.0)?[- ]licensed
mit-or-apache-2.0 3 dual[- ]licensed under (?:the )?(?:mit|apache(?: license,? version)?(?: |-)2(?:\.0)?) (?:and|or|/) (?:the )?(?:mit|apache)
mit 3 use of this source code is governed by an mit[- ]style license
bsd 3 use of this source code is governed by a bsd[- ]style license
apache-2.0 3 use of this source code is governed by the apache 2\.0 license
public-domain 3 (?:released|placed|dedicated|put|falls?) (?:in|into|to) the public domain
public-domain 3 this (?:work|file|code|software|program|text|image) is (?:hereby )?(?:in|a part of) the public domain
public-domain 3 has waived all copyright and related or neighboring rights
public-domain 3 no (?:copyright|rights) (?:is )?reserved
cc0-1.0 3 (?:released|dedicated|licensed|published) (?:under|to|with) cc0
cc 3 (?:licensed|released|available|published) under (?:a|the) creative commons (?:attribution|license)
cc-by 3 creative commons attribution(?: [1-4]\.[05])?(?: international| unported| generic)? licen[cs]e
cc-by-sa 3 creative commons attribution[- ]share ?alike(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc 3 creative commons attribution[- ]non ?-?commercial(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nd 3 creative commons attribution[- ]no ?-?derivatives?(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-sa 3 creative commons attribution[- ]non ?-?commercial[- ]share ?alike(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-nd 3 creative commons attribution[- ]non ?-?commercial[- ]no ?-?deriv(?:s|atives?|ative works)?(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[cs]e)?
ogl-uk-3.0 3 contains public sector information licensed under the open government licen[cs]e(?: v3\.0)?
crown-copyright 3 \(?c?\)? ?crown copyright
odc-by 3 open data commons attribution licen[cs]e
odbl-1.0 3 open (?:data commons open )?database licen[cs]e
pddl-1.0 3 public domain dedication and licen[cs]e
cdla-permissive 3 community data license agreement(?: -| –|,)? permissive
cdla-sharing 3 community data license agreement(?: -| –|,)? sharing
bsd-protection 3 bsd protection license
llama 3 llama [23](?:\.[0-9])? community license(?: agreement)?
openrail 3 (?:creativeml )?open ?rail(?:-m|\+\+-m|-s)?(?: license)?
bigscience-rail 3 bigscience rail license
gemma 3 gemma terms of use
busl-1.1 3 business source license(?: 1\.1)?
elastic-2.0 3 elastic license(?:,? (?:version |v)?2\.0)?
sspl-1.0 3 server side public license(?:,? (?:version |v)?1)?
commons-clause 3 ["']?commons clause["']? license condition
polyform-nc 3 polyform noncommercial license(?: 1\.0\.0)?
prosperity 3 prosperity public license
parity 3 parity public license
proprietary 3 (?:proprietary|confidential) and (?:proprietary|confidential)
proprietary 3 (?:all rights are|is) reserved by
proprietary 3 may not be (?:reproduced|redistributed|copied)(?:,? (?:or )?(?:distributed|reproduced|transmitted|copied))? without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)
non-commercial 3 for (?:personal and )?non-?commercial (?:use|purposes) only
no-derivatives 3 no derivative works? (?:are|is) (?:allowed|permitted)
research-only 3 for (?:academic )?research (?:use|purposes) only
attribution 3 reproduction (?:is )?(?:authori[sz]ed|permitted),? provided (?:that )?the source is acknowledged
"""
TITLES = r"""
apache-2.0 2 apache license,? version 2\.0, january 2004
gpl-1.0 2 gnu general public license,? version 1, february 1989
gpl-2.0 2 gnu general public license,? version 2, june 1991
gpl-3.0 2 gnu general public license,? version 3, 29 june 2007
lgpl-2.0 2 gnu library general public license,? version 2, june 1991
lgpl-2.1 2 gnu lesser general public license,? version 2\.1, february 1999
lgpl-3.0 2 gnu lesser general public license,? version 3, 29 june 2007
agpl-3.0 2 gnu affero general public license,? version 3, 19 november 2007
gfdl-1.3 2 gnu free documentation license,? version 1\.3, 3 november 2008
gfdl 2 gnu free documentation license
mpl-1.0 2 mozilla public license,? version 1\.0
mpl-2.0 2 mozilla public license,? version 2\.0
epl-1.0 2 eclipse public license ?- ?v ?1\.0
epl-2.0 2 eclipse public license ?- ?v ?2\.0
cpl-1.0 2 common public license ?(?:- ?v|version) ?1\.0
ipl-1.0 2 ibm public license version 1\.0
spl-1.0 2 sun public license version 1\.0
cddl-1.1 2 common development and distribution license \(cddl\) version 1\.1
boost-1.0 2 boost software license - version 1\.0 - august 17th, 2003
artistic-1.0 2 the artistic license 1\.0
artistic-2.0 2 the artistic license 2\.0
ofl-1.1 2 sil open font license,? version 1\.1(?: - 26 february 2007)?
ofl-1.0 2 sil open font license,? version 1\.0
bitstream-vera 2 bitstream vera fonts? copyright
ubuntu-font-1.0 2 ubuntu font licen[cs]e(?: version)? 1\.0
wtfpl 2 do what the fuck you want to public license
zpl-2.1 2 zope public license(?: \(zpl\))? version 2\.1
php-3.01 2 the php license, version 3\.01
qpl-1.0 2 the q public license version 1\.0
lppl-1.3c 2 latex project public license(?:,? version 1\.3c?)?
nasa-1.3 2 nasa open source agreement(?: version)? 1\.3
ncsa 2 university of illinois/ncsa open source license
ecl-2.0 2 educational community license,? version 2\.0
afl-3.0 2 academic free license(?: \(["']?afl["']?\))? v(?:ersion|\.)? ?3\.0
osl-3.0 2 open software license(?: \(["']?osl["']?\))? v(?:ersion|\.)? ?3\.0
apsl-2.0 2 apple public source license(?: version|,)? ?2\.0
ms-pl 2 microsoft public license(?: \(ms-pl\))?
ms-rl 2 microsoft reciprocal license(?: \(ms-rl\))?
upl-1.0 2 universal permissive license(?: \(upl\))?(?:,? version 1\.0)?
mulan-psl-2.0 2 mulan permissive software license,? version 2
cecill-2.1 2 cecill free software license agreement(?: version 2\.1)?
cecill-b 2 cecill-b free software license agreement
eupl-1.1 2 european union public licen[cs]e v\. ?1\.1
cc-by-4.0 2 creative commons attribution 4\.0 international public license
cc-by-sa-4.0 2 creative commons attribution-sharealike 4\.0 international public license
cc-by-nc-4.0 2 creative commons attribution-noncommercial 4\.0 international public license
cc0-1.0 2 cc0 1\.0 universal
odbl-1.0 2 odc open database license(?: \(odbl\))?
etalab-2.0 2 (?:open licence|licence ouverte)(?: /)? ?(?:etalab )?(?:version )?2\.0
ogl-uk-3.0 2 open government licen[cs]e for public sector information
unicode-dfs-2016 2 unicode,? inc\. license agreement - data files and software
beerware 2 the beer-?ware license
postgresql 2 postgresql (?:database management system|licen[cs]e)
openssl 2 openssl license
vim 2 vim license
bsl-1.0 2 bsl-1\.0
fair 2 fair license
zlib 2 zlib license
hpnd 2 historical permission notice and disclaimer
naumen 2 naumen public license
sissl 2 sun industry standards source license
watcom-1.0 2 sybase open watcom public license
cpal-1.0 2 common public attribution license(?: version)? 1\.0
rpl-1.5 2 reciprocal public license(?: version)? 1\.5
motosoto 2 motosoto open source license
multics 2 multics license
simpl-2.0 2 simple public license(?: \(simpl\))?
all-rights-reserved 1 all rights reserved
all-rights-reserved 1 alle rechte vorbehalten
all-rights-reserved 1 tous droits réservés
all-rights-reserved 1 todos los derechos reservados
public-domain 1 public domain
apache 1 apache license
gpl 1 general public license
copyright 1 copyright \(c\) (?:19|20)[0-9][0-9]
"""
LINKS = r"""
apache-2.0 4 apache\.org/licenses/license-2\.0
apache-1.1 4 apache\.org/licenses/license-1\.1
gpl-2.0 4 gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 4 gnu\.org/licenses/gpl(?:-3\.0)?
lgpl-2.1 4 gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 4 gnu\.org/licenses/lgpl(?:-3\.0)?
agpl-3.0 4 gnu\.org/licenses/agpl(?:-3\.0)?
gfdl 4 gnu\.org/(?:licenses|copyleft)/fdl(?:-1\.3)?
mit 4 opensource\.org/licenses?/mit
bsd-2-clause 4 opensource\.org/licenses?/bsd-2-clause
bsd-3-clause 4 opensource\.org/licenses?/bsd-3-clause
isc 4 opensource\.org/licenses?/isc
mpl-2.0 4 opensource\.org/licenses?/mpl-2\.0
ofl-1.1 4 scripts\.sil\.org/ofl
mpl-2.0 4 mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 4 mozilla\.org/(?:en-us/)?mpl/(?:mpl-)?1\.1
epl-1.0 4 eclipse\.org/legal/epl-v10
epl-2.0 4 eclipse\.org/legal/epl-(?:v20|2\.0)
boost-1.0 4 boost\.org/license_1_0
unlicense 4 unlicense\.org
wtfpl 4 wtfpl\.net
zlib 4 zlib\.net/zlib_license
cddl-1.0 4 opensource\.org/licenses?/cddl-1\.0
cc0-1.0 4 creativecommons\.org/publicdomain/zero/1\.0
public-domain 4 creativecommons\.org/publicdomain/mark/1\.0
cc-by 4 creativecommons\.org/licenses/by/[1-4]\.[05]
cc-by-sa 4 creativecommons\.org/licenses/by-sa/[1-4]\.[05]
cc-by-nc 4 creativecommons\.org/licenses/by-nc/[1-4]\.[05]
cc-by-nd 4 creativecommons\.org/licenses/by-nd/[1-4]\.[05]
cc-by-nc-sa 4 creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]
cc-by-nc-nd 4 creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]
odbl-1.0 4 opendatacommons\.org/licenses/odbl
odc-by 4 opendatacommons\.org/licenses/by
pddl-1.0 4 opendatacommons\.org/licenses/pddl
etalab-2.0 4 etalab\.gouv\.fr/licence-ouverte
ogl-uk-3.0 4 nationalarchives\.gov\.uk/doc/open-government-licence
eupl-1.2 4 joinup\.ec\.europa\.eu/software/page/eupl
mulan-psl-2.0 4 license\.coscl\.org\.cn/mulanpsl2
json 4 json\.org/license
python-2.0 4 python\.org/(?:psf/license|download/releases/[0-9.]+/license)
"""


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern
    priority: int
    needs: tuple[frozenset[str], ...]  # of each set every match contains a literal, its white space collapsed


def spaced(expression: str) -> re.Pattern:
    """The expression between word bounds, its blanks standing for any white space."""
    optional, either = "\x00", "\x01"
    body = expression.replace(" ?", optional).replace("[- ]", either).replace(" ", r"\s+").replace(optional, r"\s*").replace(either, r"(?:-|\s+)")
    return re.compile(rf"(?<!\w)(?:{body})(?!\w)")


def literals(parsed: Iterable[tuple]) -> list[frozenset[str]]:
    """Sets of literals, of each of which every match of a parsed expression contains one."""
    out: list[frozenset[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            out.append(frozenset([run]))
        run = ""

    for kind, value in parsed:
        match str(kind):
            case "LITERAL":
                run += chr(value)
                continue
            case "MAX_REPEAT" if value[0] and str(value[2]) == str(_SPACE):
                run += " "
                continue
        end()
        match str(kind):
            case "SUBPATTERN":
                out += literals(value[3])
            case "MAX_REPEAT" if value[0]:
                out += literals(value[2])
            case "BRANCH":
                best = [max(literals(branch), key=lambda own: min(map(len, own)), default=None) for branch in value[1]]
                if all(best):
                    out.append(frozenset().union(*best))
    end()
    return out


_SPACE = re._parser.parse(r"\s")


def rule(label: str, expression: str, priority: int) -> Rule:
    pattern = spaced(expression)
    found = [own for own in literals(re._parser.parse(pattern.pattern)) if min(map(len, own)) > 2]
    return Rule(label, pattern, priority, tuple(sorted(set(found), key=sorted)))


def rules() -> list[Rule]:
    """The signatures, then every name in every phrase: some hundreds."""
    written = [line.split(" ", 2) for block in (TEXTS, NOTICES, TITLES, LINKS) for line in block.strip().splitlines()]
    out = [rule(label, x, int(priority)) for label, priority, x in written]
    return out + [rule(label, frame.format(name=f"(?:{name})"), priority) for label, name in NAMES for frame, priority in FRAMES]


class Rules:
    """The rules behind their prefilter."""

    def __init__(self, ordered: list[Rule] | None = None):
        self.rules = ordered if ordered is not None else rules()
        self.automaton = ahocorasick.Automaton()
        sets = sorted({own for r in self.rules for own in r.needs}, key=sorted)
        self.holds: dict[str, list[int]] = {}
        for i, own in enumerate(sets):
            for word in own:
                self.holds.setdefault(word, []).append(i)
        for word in self.holds:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()
        at = {own: i for i, own in enumerate(sets)}
        self.needs = [frozenset(at[own] for own in r.needs) for r in self.rules]
        self.free = [i for i, own in enumerate(self.needs) if not own]
        self.led: dict[int, list[int]] = {}  # a rule is led by its set of longest literals
        for i, own in enumerate(self.needs):
            if own:
                self.led.setdefault(max(own, key=lambda k: (min(map(len, sets[k])), k)), []).append(i)

    def wanted(self, low: str) -> list[int]:
        """Rules that may match: of each of their sets of literals the text has one."""
        words = {word for _, word in self.automaton.iter(" ".join(low.split()))}
        have = {i for word in words for i in self.holds[word]}
        return self.free + sorted(i for k in have for i in self.led.get(k, ()) if self.needs[i] <= have)

    def detect(self, low: str) -> list[tuple[int, int, Rule]]:
        """Detections that stand, by start."""
        return self.standing(low, self.wanted(low))

    def standing(self, low: str, wanted: Iterable[int]) -> list[tuple[int, int, Rule]]:
        """Detections of the wanted rules that stand, by start."""
        found = [(m.start(), m.end(), i) for i in wanted for m in self.rules[i].pattern.finditer(low)]
        found.sort(key=lambda x: (-self.rules[x[2]].priority, x[0] - x[1], x[0], x[2]))
        starts: list[int] = []  # of what stands, which never overlaps, in order
        kept: list[tuple[int, int, int]] = []
        for s, e, i in found:
            k = bisect.bisect_left(starts, e)  # the last one that begins before e is the only one that can overlap
            if not k or kept[k - 1][1] <= s:
                starts.insert(k, s)
                kept.insert(k, (s, e, i))
        return [(s, e, self.rules[i]) for s, e, i in kept]


@functools.cache
def built() -> Rules:
    """All rules, compiled once in each worker."""
    return Rules()


def lowered(text: str) -> str:
    """A-Z in lower case, every other character as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(low: str) -> list[str]:
    return _WORD.findall(low)


def phrase_places(found: list[str]) -> list[tuple[int, str]]:
    """(start word, label) of every place where a base phrase stands."""
    out = []
    for phrase, label in PHRASES:
        own = phrase.split()
        at = 0
        while True:
            try:
                at = found.index(own[0], at)
            except ValueError:
                break
            if found[at : at + len(own)] == own:
                out.append((at, label))
            at += 1
    return sorted(out)


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """SCAN for every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = built()
        for batch in batches:
            for part in chunks(batch, "text"):
                out: dict[str, list] = {f.name: [] for f in schema}
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    low = lowered(text or "")
                    found = words(low)
                    places = phrase_places(found) if "license" in low else []
                    more = known.detect(low)
                    base = {label for _, label in places}
                    doubt = 0.5 ** min(len(places), 1)
                    for _, _, found_rule in more:
                        doubt *= 1 - CONFIDENCE[found_rule.priority]
                    row = (doc, len(found), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in more})), 1 - doubt)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                yield record(schema, out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, SCAN)
