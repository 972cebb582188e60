"""License scans: ordered signature rules behind a keyword prefilter, in SQL functions only.

Text is lower-cased and cut into words. A rule is a regular expression over words with one
word marked as its keyword by "@". A document without any keyword is passed by with one
look; at each keyword only the rules of that keyword are tried, and of those only the ones that
can have the word before it there, on as many words before and after it as the longest rule can
take, so that the work follows the number of keywords. "licence"
is read wherever a rule says "license", but for SPDX tags. Rules are checked on load. A detection is
an interval of words. Of two detections of which one interval contains the other, the one
with the higher priority stays; of equal priority the larger interval; of equal intervals
the earlier rule. A detection is compared only with those of the keywords within the sum
of both, beyond which no interval can reach, so long texts full of licences cost no more for
each.

Base phrases are rules whose places and labels are reported whatever suppression says.
score is the largest relevance of the detections that stay.

Cost: one narrow pass, no shuffle and no Python.

Cases: a null or empty text has no words, no labels and score 0. Repeated rows are scanned
each. Columns that clash with the result's are replaced, others kept. Empty tables give no
rows.
"""

from __future__ import annotations

import json
import re
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common

#: label, relevance, the licence's name as a regular expression over words.
NAMES = r"""
apache-2.0        | 95 | apache (?:software )?@license (?:version |v )?2(?: 0)?
apache-1.1        | 95 | apache (?:software )?@license (?:version |v )?1 1
apache            | 80 | apache (?:software )?@license
mit               | 90 | mit @license
mit               | 85 | mit x11 @license
mit               | 80 | expat @license
gpl-1.0           | 95 | (?:gnu )?general public @license (?:version |v )?1(?: 0)?
gpl-2.0           | 95 | (?:gnu )?general public @license (?:version |v )?2(?: 0)?
gpl-3.0           | 95 | (?:gnu )?general public @license (?:version |v )?3(?: 0)?
gpl-2.0-or-later  | 97 | (?:gnu )?general public @license (?:version |v )?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0-or-later  | 97 | (?:gnu )?general public @license (?:version |v )?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl               | 80 | gnu general public @license
lgpl-2.0          | 95 | (?:gnu )?library general public @license (?:version |v )?2(?: 0)?
lgpl-2.1          | 95 | (?:gnu )?lesser general public @license (?:version |v )?2 1
lgpl-3.0          | 95 | (?:gnu )?lesser general public @license (?:version |v )?3(?: 0)?
lgpl              | 85 | (?:gnu )?(?:lesser|library) general public @license
agpl-3.0          | 95 | (?:gnu )?affero general public @license (?:version |v )?3(?: 0)?
agpl              | 85 | (?:gnu )?affero general public @license
gfdl-1.3          | 95 | (?:gnu )?free documentation @license (?:version |v )?1 3
gfdl              | 85 | (?:gnu )?free documentation @license
mpl-1.1           | 95 | mozilla public @license (?:version |v )?1 1
mpl-2.0           | 95 | mozilla public @license (?:version |v )?2(?: 0)?
mpl               | 85 | mozilla public @license
epl-1.0           | 95 | eclipse public @license (?:version |v )?1(?: 0)?
epl-2.0           | 95 | eclipse public @license (?:version |v )?2(?: 0)?
cddl-1.0          | 95 | common development and distribution @license(?: (?:version |v )?1(?: 0)?)?
cpl-1.0           | 95 | common public @license(?: (?:version |v )?1(?: 0)?)?
eupl-1.2          | 95 | european union public @license (?:version |v )?1 2
artistic-2.0      | 95 | artistic @license (?:version |v )?2(?: 0)?
artistic          | 80 | artistic @license
bsd-2-clause      | 95 | (?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) @license
bsd-3-clause      | 95 | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) @license
bsd-4-clause      | 95 | (?:original bsd|bsd 4 clause|4 clause bsd) @license
bsd               | 80 | bsd(?: style)? @license
isc               | 90 | isc @license
zlib              | 90 | zlib(?: libpng)? @license
boost-1.0         | 95 | boost software @license(?: (?:version |v )?1(?: 0)?)?
python-2.0        | 90 | python(?: software foundation)? @license(?: (?:version |v )?2(?: 0)?)?
php-3.01          | 90 | php @license(?: (?:version |v )?3 01)?
ruby              | 85 | ruby @license
unlicense         | 95 | the @unlicense
wtfpl             | 95 | do what the fuck you want to public @license
ms-pl             | 95 | microsoft public @license
ms-rl             | 95 | microsoft reciprocal @license
ofl-1.1           | 95 | (?:sil )?open font @license(?: (?:version |v )?1 1)?
odbl-1.0          | 95 | open (?:data commons open )?database @license(?: (?:version |v )?1(?: 0)?)?
odc-by-1.0        | 95 | open data commons attribution @license
postgresql        | 90 | postgresql @license
openssl           | 90 | openssl @license
vim               | 85 | vim @license
w3c               | 85 | w3c software (?:notice and )?@license
ncsa              | 90 | university of illinois ncsa open source @license
openrail-m        | 90 | (?:bigscience |creativeml )?open ?rail m @license
llama-community   | 90 | llama(?: [0-9]+)? community @license
cc-by-1.0         | 95 | @cc by 1 0
cc-by-2.0         | 95 | @cc by 2 0
cc-by-2.5         | 95 | @cc by 2 5
cc-by-3.0         | 95 | @cc by 3 0
cc-by-4.0         | 95 | @cc by 4 0
cc-by-sa-3.0      | 96 | @cc by sa 3 0
cc-by-sa-4.0      | 96 | @cc by sa 4 0
cc-by-sa          | 88 | @cc by sa
cc-by-nd-4.0      | 96 | @cc by nd 4 0
cc-by-nd          | 88 | @cc by nd
cc-by-nc-3.0      | 96 | @cc by nc 3 0
cc-by-nc-4.0      | 96 | @cc by nc 4 0
cc-by-nc          | 88 | @cc by nc
cc-by-nc-sa-4.0   | 97 | @cc by nc sa 4 0
cc-by-nc-sa       | 89 | @cc by nc sa
cc-by-nc-nd-4.0   | 97 | @cc by nc nd 4 0
cc-by-nc-nd       | 89 | @cc by nc nd
cc0-1.0           | 96 | @cc0 1 0
cc0-1.0           | 85 | @cc0
cc-by             | 90 | creative @commons attribution(?: (?:[0-9] [0-9]|international|unported|generic|public|license))*
cc-by-sa          | 91 | creative @commons attribution share ?alike(?: (?:[0-9] [0-9]|international|unported|generic|public|license))*
cc-by-nd          | 91 | creative @commons attribution no ?deriv(?:ative)?s(?: (?:[0-9] [0-9]|international|unported|generic|public|license))*
cc-by-nc          | 91 | creative @commons attribution non ?commercial(?: (?:[0-9] [0-9]|international|unported|generic|public|license))*
cc-by-nc-sa       | 92 | creative @commons attribution non ?commercial share ?alike(?: (?:[0-9] [0-9]|international|unported|generic|public|license))*
cc-by-nc-nd       | 92 | creative @commons attribution non ?commercial no ?deriv(?:ative)?s(?: (?:[0-9] [0-9]|international|unported|generic|public|license))*
afl-3.0           | 95 | academic free @license (?:version |v )?3(?: 0)?
afl               | 85 | academic free @license
apsl-2.0          | 95 | apple public source @license(?: (?:version |v )?2(?: 0)?)?
aal               | 90 | attribution assurance @license
0bsd              | 95 | (?:zero clause bsd|bsd 0 clause|0 clause bsd|0bsd) @license
bsd-1-clause      | 95 | (?:bsd 1 clause|1 clause bsd) @license
busl-1.1          | 95 | business source @license(?: (?:version |v )?1 1)?
sspl-1.0          | 95 | server side public @license(?: (?:version |v )?1(?: 0)?)?
elastic-2.0       | 95 | elastic @license (?:version |v )?2(?: 0)?
elastic           | 80 | elastic @license
confluent         | 90 | confluent community @license
cecill            | 85 | cecill (?:free software )?@license(?: agreement)?
cecill-2.1        | 95 | cecill (?:free software )?@license (?:agreement )?(?:version |v )?2 1
ecl-2.0           | 95 | educational community @license(?: (?:version |v )?2(?: 0)?)?
efl-2.0           | 90 | eiffel forum @license(?: (?:version |v )?2(?: 0)?)?
eupl-1.1          | 95 | european union public @license (?:version |v )?1 1
eupl              | 85 | european union public @license
gfdl-1.1          | 95 | (?:gnu )?free documentation @license (?:version |v )?1 1
gfdl-1.2          | 95 | (?:gnu )?free documentation @license (?:version |v )?1 2
lgpl-2.1-or-later | 97 | (?:gnu )?lesser general public @license (?:version |v )?2 1 or (?:at your option )?(?:any )?later(?: version)?
lgpl-3.0-or-later | 97 | (?:gnu )?lesser general public @license (?:version |v )?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
agpl-3.0-or-later | 97 | (?:gnu )?affero general public @license (?:version |v )?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
imagemagick       | 90 | imagemagick @license
intel             | 85 | intel (?:open source|simplified software) @license
ipl-1.0           | 90 | ibm public @license(?: (?:version |v )?1(?: 0)?)?
lppl-1.3c         | 95 | latex project public @license (?:version |v )?1 3c?
lppl              | 85 | latex project public @license
libpng            | 90 | (?:libpng|png reference library) @license
lpl-1.02          | 90 | lucent public @license(?: (?:version |v )?1 02)?
miros             | 90 | miros @license
mit-0             | 93 | mit (?:0|no attribution) @license
mpl-1.0           | 95 | mozilla public @license (?:version |v )?1 0
mulanpsl-2.0      | 95 | mulan permissive software @license(?: (?:version |v ?)?2)?
npl-1.1           | 90 | netscape public @license(?: (?:version |v )?1 1)?
nokia             | 85 | nokia open source @license
ntp               | 90 | ntp @license
osl-3.0           | 95 | open software @license (?:version |v )?3(?: 0)?
osl               | 85 | open software @license
oldap-2.8         | 90 | openldap public @license(?: (?:version |v )?2 8)?
parity            | 90 | parity public @license
polyform          | 85 | polyform (?:noncommercial|shield|strict|small business|internal use|perimeter) @license
qpl-1.0           | 90 | q public @license(?: (?:version |v )?1(?: 0)?)?
rpl-1.5           | 90 | reciprocal public @license(?: (?:version |v )?1 5)?
rpsl-1.0          | 90 | realnetworks public source @license
simpl-2.0         | 90 | simple public @license(?: (?:version |v )?2(?: 0)?)?
sissl             | 90 | sun industry standards source @license
sleepycat         | 90 | sleepycat @license
spl-1.0           | 90 | sun public @license(?: (?:version |v )?1(?: 0)?)?
upl-1.0           | 95 | universal permissive @license(?: (?:version |v )?1(?: 0)?)?
vsl-1.0           | 90 | vovida software @license
watcom-1.0        | 90 | (?:sybase )?open watcom public @license
wxwindows         | 90 | wxwindows library @license
x11               | 85 | x11 @license
xfree86-1.1       | 90 | xfree86 @license(?: (?:version |v )?1 1)?
zpl-2.1           | 90 | zope public @license(?: (?:version |v )?2 1)?
blueoak-1.0.0     | 95 | blue oak model @license(?: 1 0 0)?
bittorrent-1.1    | 90 | bittorrent open source @license
cdla-permissive   | 95 | community data @license agreement permissive(?: (?:version |v )?[12](?: 0)?)?
cdla-sharing      | 95 | community data @license agreement sharing(?: (?:version |v )?1(?: 0)?)?
ogl-3.0           | 95 | open government @license (?:version |v )?3(?: 0)?
ogl               | 85 | open government @license
etalab-2.0        | 90 | etalab open @license(?: (?:version |v )?2(?: 0)?)?
dl-de-by-2.0      | 90 | data @license germany attribution(?: version 2 0)?
pddl-1.0          | 95 | (?:open data commons )?public domain dedication and @license
free-art-1.3      | 90 | free art @license(?: 1 3)?
json              | 85 | json @license
curl              | 85 | curl @license
perl              | 80 | perl @license
oracle-bcl        | 85 | oracle binary code @license agreement
ofl-1.0           | 95 | (?:sil )?open font @license (?:version |v )?1 0
bitstream-vera    | 90 | bitstream vera (?:font )?@license
mistral-research  | 90 | mistral ai research @license
deepseek          | 85 | deepseek (?:model )?@license(?: agreement)?
qwen              | 85 | (?:tongyi )?qianwen @license agreement
falcon            | 85 | falcon (?:llm|180b tii) @license
nvidia-open-model | 90 | nvidia open model @license
eula              | 75 | end user @license agreement
cc                | 70 | creative @commons(?: license)?
"""

#: How a text says that a licence holds: priority, relevance added, words before the name.
PHRASES = r"""
1 | 0 |
3 | 3 | licensed under (?:the )?(?:terms of (?:the )?)?
3 | 3 | (?:released|published|distributed) under (?:the )?(?:terms of (?:the )?)?
3 | 3 | (?:available|provided|covered|governed) (?:under|by) (?:the )?(?:terms of (?:the )?)?
"""

#: label, priority, relevance, rule.
NOTICES = r"""
reserved          | 2 | 60 | all rights @reserved
reserved          | 2 | 65 | @copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6}all rights reserved
reserved          | 2 | 60 | no part of this (?:publication|book|work|document) may be @reproduced
reserved          | 2 | 60 | may not be @reproduced (?:or (?:distributed|transmitted) )?without (?:prior |written |prior written )?permission
copyright         | 1 | 30 | @copyright (?:c )?[0-9]{4}
copyright         | 1 | 20 | @copyright (?:by|holder|holders|owner|notice)
public-domain     | 2 | 80 | (?:in|into|to) the public @domain
public-domain     | 2 | 85 | @dedicated to the public domain
public-domain     | 2 | 85 | released into the public @domain
spdx              | 1 | 50 | @spdx license identifier
apache-2.0        | 4 | 99 | @spdx license identifier apache 2 0
mit               | 4 | 99 | @spdx license identifier mit
gpl-2.0           | 4 | 99 | @spdx license identifier gpl 2 0(?: only)?
gpl-3.0           | 4 | 99 | @spdx license identifier gpl 3 0(?: only)?
gpl-2.0-or-later  | 4 | 99 | @spdx license identifier gpl 2 0 or later
gpl-3.0-or-later  | 4 | 99 | @spdx license identifier gpl 3 0 or later
lgpl-2.1          | 4 | 99 | @spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0          | 4 | 99 | @spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0          | 4 | 99 | @spdx license identifier agpl 3 0(?: only| or later)?
mpl-2.0           | 4 | 99 | @spdx license identifier mpl 2 0
bsd-2-clause      | 4 | 99 | @spdx license identifier bsd 2 clause
bsd-3-clause      | 4 | 99 | @spdx license identifier bsd 3 clause
isc               | 4 | 99 | @spdx license identifier isc
cc-by-4.0         | 4 | 99 | @spdx license identifier cc by 4 0
cc-by-sa-4.0      | 4 | 99 | @spdx license identifier cc by sa 4 0
cc-by-nc-4.0      | 4 | 99 | @spdx license identifier cc by nc 4 0
cc0-1.0           | 4 | 99 | @spdx license identifier cc0 1 0
unlicense         | 4 | 99 | @spdx license identifier unlicense
gpl-1.0           | 3 | 85 | (?:gnu )?@gpl ?(?:version |v )?1(?: 0)?
gpl-2.0           | 3 | 85 | (?:gnu )?@gpl (?:version |v )?2(?: 0)?
gpl-3.0           | 3 | 85 | (?:gnu )?@gpl (?:version |v )?3(?: 0)?
gpl               | 2 | 60 | (?:under the |gnu )@gpl
gpl-2.0           | 3 | 85 | @gplv2
gpl-3.0           | 3 | 85 | @gplv3
lgpl-2.1          | 3 | 85 | (?:gnu )?@lgpl (?:version |v )?2 1
lgpl-3.0          | 3 | 85 | (?:gnu )?@lgpl (?:version |v )?3(?: 0)?
lgpl              | 2 | 60 | (?:gnu )?@lgpl
agpl-3.0          | 3 | 85 | (?:gnu )?@agpl(?: (?:version |v )?3(?: 0)?)?
apache-2.0        | 3 | 80 | @apache 2 0
mit               | 2 | 95 | permission is hereby granted free of charge to any @person obtaining a copy
mit               | 2 | 70 | the software is provided as is without @warranty of any kind
bsd               | 2 | 90 | @redistribution and use in source and binary forms with or without modification
bsd               | 2 | 80 | @redistributions of source code must retain the above copyright notice
isc               | 2 | 90 | permission to use copy modify and or distribute this @software for any purpose
gpl               | 2 | 90 | this program is free @software you can redistribute it and or modify it
zlib              | 2 | 85 | this @software is provided as is without any express or implied warranty
proprietary       | 2 | 75 | @proprietary and confidential
proprietary       | 2 | 70 | for internal use @only
non-commercial    | 2 | 70 | for non ?commercial (?:use|purposes) @only
non-commercial    | 2 | 70 | for (?:personal|academic|research) (?:use|purposes) @only
mit               | 2 | 85 | the above copyright notice and this permission notice shall be included in all @copies
mit-0             | 4 | 99 | @spdx license identifier mit 0
apache-2.0        | 2 | 97 | you may not use this file except in @compliance with the license
apache-2.0        | 2 | 90 | distributed on an as is basis without @warranties or conditions of any kind
apache-2.0        | 2 | 95 | you may obtain a copy of the license at (?:https? )?www @apache org licenses license 2 0
gpl-2.0-or-later  | 2 | 96 | either @version 2 of the license or at your option any later version
gpl-3.0-or-later  | 2 | 96 | either @version 3 of the license or at your option any later version
gpl-2.0           | 2 | 94 | under the terms of the gnu general public license as published by the free software @foundation version 2
gpl               | 2 | 85 | you should have received a copy of the gnu general public license along with this @program
lgpl              | 2 | 90 | this @library is free software you can redistribute it and or modify it
lgpl              | 2 | 85 | you should have received a copy of the gnu lesser general public license along with this @library
agpl              | 2 | 88 | affero general public license as published by the free software @foundation
gpl               | 2 | 85 | @everyone is permitted to copy and distribute verbatim copies of this license document
wtfpl             | 3 | 95 | @everyone is permitted to copy and distribute verbatim or modified copies of this license document
bsd-3-clause      | 2 | 92 | neither the name of (?:[^ ]+ ){1,8}nor the names of its @contributors may be used to endorse
bsd-4-clause      | 2 | 92 | all @advertising materials mentioning features or use of this software must display
bsd               | 2 | 80 | redistributions in binary form must @reproduce the above copyright notice
isc               | 2 | 92 | for any purpose with or without fee is hereby @granted
zlib              | 2 | 90 | the origin of this software must not be @misrepresented
zlib              | 2 | 88 | @altered source versions must be plainly marked as such
boost-1.0         | 2 | 92 | to any person or organization obtaining a copy of the software and accompanying @documentation
unlicense         | 3 | 96 | this is free and @unencumbered software released into the public domain
mpl-2.0           | 3 | 96 | this source code form is subject to the terms of the @mozilla public license
epl               | 3 | 92 | the accompanying materials are made available under the terms of the @eclipse public license
cc0-1.0           | 2 | 90 | (?:[^ ]+ ){0,8}has @waived all copyright and related or neighboring rights
cc                | 2 | 75 | this work is licensed under a creative @commons
ofl-1.1           | 3 | 93 | this @font software is licensed under the sil open font license
ofl-1.1           | 3 | 80 | with @reserved font name
reserved          | 2 | 40 | some rights @reserved
public-domain     | 2 | 70 | no rights @reserved
public-domain     | 2 | 80 | @dedicates (?:the|this) work to the public domain
public-domain     | 2 | 75 | no @copyright (?:is )?claimed
reserved          | 2 | 60 | @unauthorized (?:copying|reproduction|distribution|use) (?:of (?:[^ ]+ ){1,4})?(?:via any medium )?is (?:strictly )?prohibited
proprietary       | 2 | 75 | @confidential and proprietary
proprietary       | 2 | 80 | this software is the confidential and @proprietary information of
proprietary       | 2 | 70 | subject to the terms of a commercial license @agreement
proprietary       | 2 | 65 | not for @redistribution
proprietary       | 2 | 65 | may not be @copied modified (?:or )?distributed without
proprietary       | 2 | 60 | contains @trade secrets of
eula              | 2 | 65 | by installing (?:or using )?(?:this|the) software you @agree to
non-commercial    | 2 | 75 | may not be used for @commercial purposes
share-alike       | 2 | 65 | must be distributed under the same @license
royalty-free      | 1 | 45 | @royalty free (?:worldwide )?(?:perpetual )?license
warranty          | 1 | 25 | without any express or @implied warranties
warranty          | 1 | 25 | the implied warranties of @merchantability
copyleft          | 1 | 30 | @copyleft
dual              | 1 | 40 | @dual licensed under
gpl-2.0-or-later  | 3 | 88 | (?:gnu )?@gpl (?:version |v )?2(?: 0)? or (?:any )?later
gpl-3.0-or-later  | 3 | 88 | (?:gnu )?@gpl (?:version |v )?3(?: 0)? or (?:any )?later
lgpl-2.1          | 3 | 85 | @lgplv2 1
lgpl-3.0          | 3 | 85 | @lgplv3
agpl-3.0          | 3 | 85 | @agplv3
gpl               | 1 | 40 | @gpl compatible
sspl-1.0          | 3 | 85 | @sspl
elastic-2.0       | 3 | 80 | @elv2
commons-clause    | 3 | 90 | @commons clause (?:license )?condition
gemma             | 2 | 85 | @gemma terms of use
lgpl-2.0          | 4 | 99 | @spdx license identifier lgpl 2 0(?: only| or later)?
gpl-1.0           | 4 | 99 | @spdx license identifier gpl 1 0(?: only| or later)?
mpl-1.1           | 4 | 99 | @spdx license identifier mpl 1 1
epl-2.0           | 4 | 99 | @spdx license identifier epl 2 0
cddl-1.0          | 4 | 99 | @spdx license identifier cddl 1 0
eupl-1.2          | 4 | 99 | @spdx license identifier eupl 1 2
artistic-2.0      | 4 | 99 | @spdx license identifier artistic 2 0
0bsd              | 4 | 99 | @spdx license identifier 0bsd
zlib              | 4 | 99 | @spdx license identifier zlib
boost-1.0         | 4 | 99 | @spdx license identifier bsl 1 0
ms-pl             | 4 | 99 | @spdx license identifier ms pl
ofl-1.1           | 4 | 99 | @spdx license identifier ofl 1 1
upl-1.0           | 4 | 99 | @spdx license identifier upl 1 0
wtfpl             | 4 | 99 | @spdx license identifier wtfpl
postgresql        | 4 | 99 | @spdx license identifier postgresql
python-2.0        | 4 | 99 | @spdx license identifier psf 2 0
cc-by-nd-4.0      | 4 | 99 | @spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0   | 4 | 99 | @spdx license identifier cc by nc sa 4 0
busl-1.1          | 4 | 99 | @spdx license identifier busl 1 1
sspl-1.0          | 4 | 99 | @spdx license identifier sspl 1 0
elastic-2.0       | 4 | 99 | @spdx license identifier elastic 2 0
"""

#: The phrases whose places count: label and rule.
BASE = [("cc-by", "@cc by"), ("gpl", "general public @license"), ("reserved", "all rights @reserved")]


def rules() -> list[tuple[str, int, int, bool, str]]:
    """label, priority, relevance, base, rule, in order."""
    out = [(label, 0, 50, True, rule) for label, rule in BASE]
    out += [(label, int(p), int(rel), False, rule) for label, p, rel, rule in _split(NOTICES, 3)]
    for label, rel, name in _split(NAMES, 2):
        for p, more, before in _split(PHRASES, 2):
            out.append((label, int(p), min(100, int(rel) + int(more)), False, f"{before}{name}"))
    british = [(*r[:4], re.sub(r"\blicense\b", "licence", r[4])) for r in out if "@license" in r[4] and not r[3]]
    out = [(*r[:4], r[4] if "@license" in r[4] or "spdx" in r[4] else re.sub(r"\blicense\b", "licen[cs]e", r[4])) for r in out] + british
    for rule in (r[4] for r in out):
        if rule.count("@") != 1 or not keyword(rule) or "@" in "".join(re.findall(r"\([^()]*\)", rule)):
            raise ValueError(f"a rule needs one keyword outside all branches: {rule}")
    return out


def _split(text: str, bars: int) -> list[list[str]]:
    return [[x.strip() for x in line.split("|", bars)] for line in text.strip().splitlines()]


def keyword(rule: str) -> str:
    word = rule.split("@", 1)[1]
    for k, c in enumerate(word):
        if not c.isalnum():
            return word[:k]
    return word


def most_words(part: str) -> int:
    """The most words that a part of a rule can take; a starred group is taken STARRED times."""

    def walk(node) -> int:
        total = 0
        for op, av in node:
            name = str(op)
            if name == "LITERAL":
                total += av == 32
            elif name == "SUBPATTERN":
                total += walk(av[-1])
            elif name == "BRANCH":
                total += max(walk(x) for x in av[1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                n = walk(av[2])
                total += n * (STARRED if av[1] > 1000 else int(av[1])) if n else 0
        return total

    return walk(_parser.parse(part))


def words_before(rule: str) -> set[str] | None:
    """The words that can stand right before a rule's keyword; None if any can, or none need."""
    before = rule.split("@", 1)[0]
    if not before.endswith(" "):
        return None

    def tails(nodes) -> set[tuple[str, bool]]:
        """Ends of what the nodes match, from the last space on, and whether there is one."""
        out = {("", False)}
        for node in reversed(list(nodes)):
            out = {x for x in out if x[1]} | {(piece + t, done) for t, over in out if not over for piece, done in options(node)}
        return out

    def options(node) -> set[tuple[str, bool]]:
        op, av = str(node[0]), node[1]
        if op == "LITERAL":
            return {("", True)} if av == 32 else {(chr(av), False)}
        if op == "SUBPATTERN":
            return tails(av[-1])
        if op == "BRANCH":
            return set().union(*[tails(x) for x in av[1]])
        if op == "IN" and all(str(x[0]) == "LITERAL" for x in av):
            return {(chr(x[1]), False) for x in av}
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            once = tails(av[2])
            if av[1] == 1 or all(done for _, done in once):
                return once | ({("", False)} if av[0] == 0 else set())
        raise ValueError

    try:
        return {t for t, _ in tails(_parser.parse(before[:-1]))}
    except ValueError:
        return None


#: Times that a group may repeat without a bound, and words before and after a keyword.
STARRED = 8
BEFORE = max(most_words(r[4].split("@", 1)[0]) for r in rules())
AFTER = max(most_words(r[4].split("@", 1)[1]) for r in rules())

SPAN = "struct<first:int,last:int,rule:int>"


def constant(value, kind: str):
    """A value of many parts as one constant of a plan, which stays small however many rules there are."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def detections(words):
    """For each keyword of the words, in order, the intervals found there."""
    # Rules by keyword, and by the word before it where only some can stand there.
    by: dict[str, list[dict]] = {}
    for k, r in enumerate(rules()):
        for prev in words_before(r[4]) or {None}:
            place = keyword(r[4]) if prev is None else f"{keyword(r[4])} {prev}"
            by.setdefault(place, []).append({"rule": k, "shape": f"(?<= ){r[4]}(?= )"})
    listed = "array<struct<rule:int,shape:string>>"
    table = constant(by, f"map<string,{listed}>")
    at = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(sorted({k.split(" ")[0] for k in by})), i)))

    def context(i):
        left = F.slice(words, F.greatest(i - BEFORE, F.lit(0)) + 1, F.least(i, F.lit(BEFORE)))
        right = F.slice(words, i + 2, F.lit(AFTER))
        word = F.get(words, i)
        text = F.concat(F.lit(" "), F.array_join(F.concat(left, F.array(F.concat(F.lit("@"), word)), right), " "), F.lit(" "))
        some = lambda key: F.coalesce(F.try_element_at(table, key), F.array().cast(listed))
        tries = F.concat(some(word), some(F.concat(word, F.lit(" "), F.coalesce(F.get(words, i - 1), F.lit("")))))
        return F.struct(i.alias("at"), tries.alias("tries"), text.alias("text"))

    def tried(c):
        found = F.transform(c["tries"], lambda r: F.struct(r["rule"].alias("rule"), F.call_function("regexp_extract", c["text"], r["shape"], F.lit(0)).alias("m")))
        spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
        first = lambda f: c["at"] - spaces(F.substring_index(f["m"], "@", 1))
        return F.transform(
            F.filter(found, lambda f: f["m"] != ""),
            lambda f: F.struct(first(f).alias("first"), (first(f) + spaces(f["m"])).alias("last"), f["rule"].alias("rule")).cast(SPAN),
        )

    return F.transform(F.transform(at, context), tried)


def kept(found):
    """The detections that no other suppresses."""
    own = rules()
    priority = constant([r[1] for r in own], "array<int>")
    reach = BEFORE + AFTER

    def stays(s, near):
        p = F.get(priority, s["rule"])

        def beats(t):
            q = F.get(priority, t["rule"])
            holds = (t["first"] <= s["first"]) & (t["last"] >= s["last"])
            held = (t["first"] >= s["first"]) & (t["last"] <= s["last"])
            return (holds & held & ((q > p) | ((q == p) & (t["rule"] < s["rule"])))) | (holds & ~held & (q >= p)) | (held & ~holds & (q > p))

        return ~F.exists(near, beats)

    def of(spans, i):
        near = F.flatten(F.slice(found, F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)))
        return F.filter(spans, lambda s: stays(s, near))

    return F.flatten(F.transform(found, of))


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and
    detections (first and last word, label and relevance of those that stay)."""
    own = rules()
    names, relevance = constant([r[0] for r in own], "array<string>"), constant([r[2] for r in own], "array<int>")
    base = constant([r[3] for r in own], "array<boolean>")
    extra = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"}
    cols = [c for c in docs.columns if c.lower() not in extra]
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), common.UPPER, common.LOWER)
    norm = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    gate = F.concat(F.lit(" "), F.col("_norm"), F.lit(" ")).rlike(f" (?:{'|'.join(sorted({keyword(r[4]) for r in own}))}) ")
    words = F.split("_norm", " ")
    nothing = F.array().cast(f"array<array<{SPAN}>>")
    bases = F.filter(F.flatten("_found"), lambda s: F.get(base, s["rule"]))
    listed = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    starts = F.transform(F.col("_base"), lambda s: s["first"].cast("long"))
    base_names = F.transform(F.col("_base"), lambda s: F.get(names, s["rule"]))
    found = F.transform(
        F.col("_kept"),
        lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.get(names, s["rule"]).alias("label"), F.get(relevance, s["rule"]).alias("relevance")),
    )
    return (
        docs.select(*[F.col(f"`{c}`") for c in cols], norm.alias("_norm"))
        .select(
            *[F.col(f"`{c}`") for c in cols],
            F.when(F.col("_norm") == "", F.lit(0)).otherwise(F.length("_norm") - F.length(F.replace(F.col("_norm"), F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
            F.when(gate, detections(words)).otherwise(nothing).alias("_found"),
        )
        .withColumns({"_base": bases, "_kept": kept(F.col("_found"))})
        .select(
            *[F.col(f"`{c}`") for c in cols],
            "n_words",
            F.size("_base").cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            listed(base_names).alias("base_labels"),
            listed(F.concat(base_names, F.transform(F.col("_kept"), lambda s: F.get(names, s["rule"])))).alias("labels"),
            F.coalesce(F.array_max(F.transform(F.col("_kept"), lambda s: F.get(relevance, s["rule"]))) / 100, F.lit(0.0)).alias("score"),
            found.alias("detections"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
