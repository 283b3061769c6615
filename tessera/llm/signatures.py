"""Signatures of licenses: what each one's grant, body, notice or address says, word for word.

A line is: label | words of which one must occur | certainty in percent | pattern over words. Words are
in lower case and joined by single spaces; punctuation is gone. They are written by hand, from
the licenses' own texts; a few wildcards (``[^ ]+``) stand for names.
"""

SIGNATURES = r"""
mit | hereby | 100 | permission is hereby granted free of charge to any person obtaining a copy
mit | sublicense | 95 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | portions | 85 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | authors | 80 | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit | merchantability | 60 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | mit | 95 | (?:the )?mit license(?: mit)? copyright(?: c)? (?:19|20)[0-9]{2}
mit-0 | attribution | 95 | mit no attribution
mit-0 | mit | 80 | mit 0(?: license)?
expat | expat | 85 | expat licen[cs]e
x11 | consortium | 95 | except as contained in this notice the name of the x consortium shall not be used
x11 | x11 | 80 | x11 licen[cs]e
ncsa | illinois | 95 | university of illinois ncsa open source license
ncsa | sublicense | 85 | to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
json | evil | 100 | the software shall be used for good not evil
isc | permission | 100 | permission to use copy modify and or distribute this software for any purpose
isc | disclaims | 85 | the software is provided as is and the author disclaims all warranties with regard to this software
isc | isc | 90 | (?:the )?isc licen[cs]e(?: isc)?
hpnd | documentation | 95 | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
hpnd | documentation | 95 | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
hpnd | historical | 95 | historical permission notice and disclaimer
ntp | documentation | 95 | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
tcl | documentation | 95 | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
curl | curl | 80 | curl licen[cs]e
bsd | redistribution | 100 | redistribution and use in source and binary forms with or without modification(?: are permitted provided that the following conditions are met)?
bsd | redistributions | 90 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions | 90 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-3 | endorse | 95 | neither the names? of (?:[^ ]+ ){1,16}may be used to endorse or promote products derived from this software
bsd-3 | endorse | 85 | may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission
bsd-4 | advertising | 100 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4 | berkeley | 90 | this product includes software developed by the university of california berkeley and its contributors
bsd | regents | 85 | (?:copyright )?the regents of the university of california all rights reserved
bsd | exemplary | 85 | be liable for any direct indirect incidental special exemplary or consequential damages
bsd | disclaimed | 75 | the implied warranties of merchantability and fitness for a particular purpose are disclaimed
bsd-2-patent | patent | 95 | bsd 2 clause plus patent(?: license)?
bsd-3-clear | patent | 95 | no express or implied licenses to any party s patent rights are granted by this license
bsd-3-nuclear | nuclear | 95 | not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility
bsd-0 | zero | 90 | bsd zero clause license
apache-2 | compliance | 100 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | obtain | 95 | you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0
apache-2 | writing | 85 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | governing | 75 | see the license for the specific language governing permissions and limitations under the license
apache-2 | january | 100 | apache license version 2 0 january 2004
apache-2 | reproduction | 90 | terms and conditions for use reproduction and distribution
apache-2 | irrevocable | 90 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 | irrevocable | 90 | royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work
apache-2 | apache | 95 | www apache org licenses license 2 0
apache-1 | apache | 95 | www apache org licenses license 1 [01]
apache-1 | apache | 95 | (?:the )?apache software license version 1 [01]
apache-1 | acknowledgment | 90 | the end user documentation included with the redistribution if any must include the following acknowledgment
apache-1 | apache | 85 | products derived from this software may not be called apache
gpl | redistribute | 100 | (?:this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?
gpl | gnu | 90 | gnu general public license(?: as published by the free software foundation)?(?: (?:either )?version [123](?: of the license)?)?
gpl-2 | option | 100 | either version 2 of the license or at your option any later version
gpl-3 | option | 100 | either version 3 of the license or at your option any later version
gpl-1 | february | 100 | gnu general public license version 1 february 1989
gpl-2 | june | 100 | gnu general public license version 2 june 1991
gpl-3 | june | 100 | gnu general public license version 3 29 june 2007
gpl | merchantability | 80 | distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl | received | 90 | you should have received a copy of the gnu general public license along with (?:this|the) (?:program|software|file|package)
gpl | verbatim | 80 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | freedom | 95 | the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change (?:it|the works)
gpl | incorporating | 95 | this general public license does not permit incorporating your program into proprietary programs
gpl-2 | rights | 85 | we protect your rights with two steps 1 copyright the software
gpl-2 | rights | 85 | to protect your rights we need to make restrictions that forbid anyone to deny you these rights
gpl-3 | copyleft | 95 | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3 | denying | 85 | to protect your rights we need to prevent others from denying you these rights or asking you to surrender the rights
gpl-exception | exception | 85 | as a special exception (?:the copyright holders|the author|if you link|to the gnu general public license|you may)
gpl-exception | gcc | 95 | gcc runtime library exception
gpl-exception | classpath | 90 | (?:the )?classpath exception
gpl-exception | linking | 85 | (?:openssl )?linking exception
gpl-exception | autoconf | 90 | autoconf (?:configure script )?exception
gpl-exception | bison | 90 | bison exception
gpl-exception | font | 85 | font embedding exception
fsf | franklin | 80 | free software foundation inc 51 franklin
fsf | temple | 80 | free software foundation inc 59 temple place
fsf | mass | 80 | free software foundation inc 675 mass ave
lgpl | lesser library | 100 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | general | 90 | gnu (?:lesser|library) general public license(?: version [23](?: [01])?)?
lgpl-2 | february | 100 | gnu lesser general public license version 2 1 february 1999
lgpl-2 | library | 100 | gnu library general public license version 2 june 1991
lgpl-3 | incorporates | 100 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
lgpl-2 | option | 95 | either version 2 1 of the license or at your option any later version
lgpl | library | 85 | this license agreement applies to any software library or other program which contains a notice placed by the copyright holder
lgpl | received | 90 | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)
agpl | affero | 90 | gnu affero general public license(?: version 3)?
agpl-3 | november | 100 | gnu affero general public license version 3 19 november 2007
agpl-3 | remotely | 95 | all users interacting with it remotely through a computer network
agpl-3 | cooperation | 90 | specifically designed to ensure cooperation with the community in the case of network server software
agpl | received | 90 | you should have received a copy of the gnu affero general public license
gfdl | document | 100 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant | 95 | with no invariant sections no front cover texts and no back cover texts
gfdl | entitled | 90 | a copy of the license is included in the section entitled gnu free documentation license
mpl-2 | mozilla | 100 | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-2 | mpl | 100 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2 | incompatible | 95 | this source code form is incompatible with secondary licenses
mpl-1 | mozilla | 100 | the contents of this file are subject to the mozilla public license version 1 [01]
mpl-1 | mpl | 90 | mpl 1 1 gpl 2 0 lgpl 2 1
mpl-1 | alternatively | 85 | alternatively the contents of this file may be used under the terms of either (?:of )?the gnu general public license
mpl | governing | 70 | see the license for the specific language governing rights and limitations under the license
npl | netscape | 95 | netscape public license(?: version)?(?: 1 [01])?
epl | eclipse | 100 | (?:this program and the )?accompanying materials are made available under the terms of the eclipse public license
epl | eclipse | 100 | the accompanying program is provided under the terms of this eclipse public license
epl-2 | eclipse | 95 | secondary licenses when the conditions for such availability set forth in the eclipse public license
edl | eclipse | 100 | accompanying materials are made available under the terms of the eclipse distribution license
cpl | accompanying | 95 | the accompanying program is provided under the terms of this common public license
cddl | common | 100 | the contents of this file are subject to the terms of the common development and distribution license
cddl | cddl | 95 | when distributing covered code include this cddl header(?: notice)? in each file
cddl | opensolaris | 90 | you can obtain a copy of the license at usr src opensolaris license
artistic | semblance | 100 | such that the copyright holder maintains some semblance of artistic control over the development of the package
artistic | verbatim | 90 | you may make and give away verbatim copies of the source form of the standard version
artistic | perl | 85 | (?:under )?the same terms as (?:the )?perl(?: 5 programming language)?(?: system)?(?: itself)?
artistic | clarified | 90 | the clarified artistic license
zlib | misrepresented | 100 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered | 90 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | altered | 80 | this notice may not be removed or altered from any source distribution
zlib | liable | 85 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | libpng png | 90 | (?:png reference library|libpng) license(?: version 2)?
ijg | jpeg | 95 | this software is based in part on the work of the independent jpeg group
boost | boost | 100 | boost software license version 1 0 (?:august )?17th? (?:august )?2003
boost | organization | 95 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost | boost | 95 | distributed under the boost software license version 1 0
unlicense | unencumbered | 100 | this is free and unencumbered software released into the public domain
unlicense | compile | 95 | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | dedicate | 90 | the author or authors of this software dedicate any and all copyright interest in the software to the public domain
wtfpl | fuck | 100 | do what the fuck you want to(?: public license)?
beerware | beer | 95 | the beer ware license
beerware | beer | 95 | you can buy me a beer in return
public-domain | domain | 80 | (?:released|dedicated|placed|put) (?:in|into|to) the public domain
public-domain | domain | 70 | (?:is|are) in the public domain
public-domain | government | 80 | this is a work of the (?:u s|united states) government
psf | python | 95 | psf license agreement for python
psf | python | 95 | python software foundation license version 2
psf | cnri | 90 | cnri (?:open source )?license agreement(?: for python)?
psf | beopen | 90 | beopen python open source license agreement
ruby | ruby | 85 | ruby s? ?licen[cs]e
ruby | bsdl | 90 | under either the terms of the 2 clause bsdl
vim | vim | 80 | vim licen[cs]e
vim | charityware | 95 | vim is charityware
php | php | 90 | this product includes php software
php | php | 90 | subject to version 3 0[01]? of the php license
openssl | openssl | 95 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic | 95 | this product includes cryptographic software written by eric young
ofl | font | 100 | this font software is licensed under the sil open font license version 1 1
ofl | font | 90 | the font software may be sold as part of a larger software package
ofl | reserved | 80 | with reserved font names?
ubuntu-font | ubuntu | 95 | ubuntu font licen[cs]e
bitstream-vera | bitstream | 90 | bitstream vera fonts? copyright
gust-font | gust | 90 | gust font (?:source )?license
ipa-font | ipa | 90 | ipa font license agreement
arphic | arphic | 95 | arphic public license
lppl | latex | 100 | this work may be distributed and or modified under the conditions of the latex project public license
lppl | latex | 90 | latex project public license(?: version 1 3[ac]?)?
lppl | maintainer | 80 | the current maintainer of this work is
odbl | odbl | 95 | open database license(?: v(?:ersion)? 1 0)? odbl
odbl | database | 85 | database contents license(?: v(?:ersion)? 1 0)?
odbl | opendatacommons | 95 | opendatacommons org licenses odbl
odc-by | opendatacommons | 95 | opendatacommons org licenses by
pddl | opendatacommons | 95 | opendatacommons org licenses pddl
cdla | community | 95 | community data license agreement (?:permissive|sharing)
etalab | ouverte | 95 | licence ouverte(?: open licen[cs]e)?(?: version 2 0)?
dl-de | datenlizenz | 95 | datenlizenz deutschland(?: namensnennung| zero)?
ogl | sector | 100 | contains public sector information licensed under the open government licence
ogl | government | 90 | open government licen[cs]e(?: v(?:ersion)? ?[123](?: 0)?)?(?: for public sector information)?
ms-pl | governs | 90 | this license governs use of the accompanying software if you use the software you accept this license
ms-pl | microsoft | 90 | microsoft (?:limited )?public license(?: ms l?pl)?
ms-rl | microsoft | 90 | microsoft reciprocal license(?: ms rl)?
ms-eula | microsoft | 85 | microsoft software license terms
ipl | ibm | 95 | (?:this )?ibm public license (?:agreement|version 1 0)
ecl | educational | 95 | licensed under the educational community license version [12] 0
upl | universal | 95 | the universal permissive license upl(?: version 1 0)?
mulan | mulan | 95 | you can use this software according to the terms and conditions of the mulan psl v[12]
mulan | mulan | 95 | licensed under mulan psl v[12]
cecill | cecill | 100 | this software is governed by the cecill(?: [bc])? license under french law
cecill | cecill | 95 | cecill(?: [bc])? free software license agreement
eupl | eupl | 95 | licensed under the eupl(?: v(?:ersion)? 1 [012])?
eupl | european | 90 | european union public licen[cs]e(?: v(?:ersion)? ?1 [012])?
sspl | october | 100 | server side public license version 1 october 16 2018
sspl | service | 85 | offering (?:a service the value of which|the program as a service)
busl | business | 95 | business source license 1 1
busl | production | 95 | redistribute and make non production use of the licensed work
busl | grant | 75 | additional use grant
elastic | hosted | 95 | you may not provide the software to third parties as a hosted or managed service
elastic | elastic | 90 | elastic license 2 0(?: elv2)?
commons-clause | clause | 90 | commons clause (?:license )?condition v1 0
commons-clause | grant | 85 | the license does not grant to you the right to sell the software
polyform | polyform | 95 | polyform (?:noncommercial|small business|shield|perimeter|internal use|strict|free trial)(?: license)?(?: 1 0 [01])?
confluent | confluent | 95 | confluent community license(?: agreement)?
timescale | timescale | 90 | timescale license
redis | redis | 95 | redis source available license
fsl | functional | 95 | functional source license
parity | parity | 95 | parity public license
prosperity | prosperity | 95 | prosperity public license
blue-oak | oak | 95 | blue oak model license
hippocratic | hippocratic | 95 | hippocratic license
anti-996 | 996 | 95 | anti 996 license
openrail | rail | 95 | (?:bigscience|creativeml|bigcode)(?: open)? rail(?: [ms])?(?: license)?
openrail | openrail | 90 | (?:creativeml |bigcode )?openrail(?: m)?(?: license)?
llama | llama | 95 | llama [234](?: [123])? community license(?: agreement)?
gemma | gemma | 90 | gemma terms of use
qwen | qianwen | 95 | tongyi qianwen license agreement
deepseek | deepseek | 90 | deepseek (?:model )?license(?: agreement)?
cc-by | attribution | 95 | attribution 4 0 international(?: cc by 4 0)?
cc-by-sa | sharealike alike | 95 | attribution (?:sharealike|share alike) 4 0 international(?: cc by sa 4 0)?
cc-by-nc | noncommercial commercial | 95 | attribution (?:noncommercial|non commercial) 4 0 international(?: cc by nc 4 0)?
cc-by-nd | noderivatives noderivs | 95 | attribution (?:noderivatives|noderivs) 4 0 international(?: cc by nd 4 0)?
cc-by-nc-sa | sharealike | 95 | attribution noncommercial sharealike 4 0 international(?: cc by nc sa 4 0)?
cc-by-nc-nd | noderivatives noderivs | 95 | attribution noncommercial (?:noderivatives|noderivs) 4 0 international(?: cc by nc nd 4 0)?
cc-by | unported | 95 | attribution [23] 0 unported
cc-by-sa | unported | 95 | attribution share ?alike [23] 0 unported
cc-by | commons | 95 | (?:this work is )?licensed under a creative commons attribution(?: [1234] [05])?(?: international| unported| generic)? licen[cs]e
cc-by | creativecommons | 95 | creativecommons org licenses by(?: [1234] [05])?
cc-by-sa | creativecommons | 95 | creativecommons org licenses by sa(?: [1234] [05])?
cc-by-nc | creativecommons | 95 | creativecommons org licenses by nc(?: [1234] [05])?
cc-by-nd | creativecommons | 95 | creativecommons org licenses by nd(?: [1234] [05])?
cc-by-nc-sa | creativecommons | 95 | creativecommons org licenses by nc sa(?: [1234] [05])?
cc-by-nc-nd | creativecommons | 95 | creativecommons org licenses by nc nd(?: [1234] [05])?
cc0 | creativecommons | 95 | creativecommons org publicdomain zero(?: 1 0)?
cc-pdm | creativecommons | 95 | creativecommons org publicdomain mark(?: 1 0)?
cc | creativecommons | 80 | creativecommons org (?:licenses|publicdomain)(?: [a-z]+)*(?: [1234] 0)?
cc | commons | 85 | the work as defined below is provided under the terms of this creative commons public license
cc | exercising | 85 | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this
cc | commons | 70 | creative commons corporation(?: creative commons)? is not a law firm
cc0 | waived | 95 | has waived all copyright and related or neighbou?ring rights
cc0 | deed | 95 | the person who associated a work with this deed has dedicated the work to the public domain
cc0 | confer | 90 | the laws of most jurisdictions throughout the world automatically confer exclusive copyright
cc0 | cc0 | 70 | cc0(?: 1 0)?(?: universal)?
cc-pdm | mark | 85 | (?:creative commons )?public domain mark 1 0
cc-pdm | restrictions | 85 | free of known copyright restrictions
cc-by | cc | 80 | cc by(?: [1234](?: [05])?)?
cc-by-sa | cc | 90 | cc by sa(?: [1234](?: [05])?)?
cc-by-nc | cc | 90 | cc by nc(?: [1234](?: [05])?)?
cc-by-nd | cc | 90 | cc by nd(?: [1234](?: [05])?)?
cc-by-nc-sa | cc | 95 | cc by nc sa(?: [1234](?: [05])?)?
cc-by-nc-nd | cc | 95 | cc by nc nd(?: [1234](?: [05])?)?
mit | spdx | 100 | spdx license identifier mit
apache-2 | spdx | 100 | spdx license identifier apache 2 0
bsd-2 | spdx | 100 | spdx license identifier bsd 2 clause
bsd-3 | spdx | 100 | spdx license identifier bsd 3 clause
gpl-2 | spdx | 100 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 | spdx | 100 | spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2 | spdx | 100 | spdx license identifier lgpl 2 [01](?: only| or later)?
lgpl-3 | spdx | 100 | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3 | spdx | 100 | spdx license identifier agpl 3 0(?: only| or later)?
mpl-2 | spdx | 100 | spdx license identifier mpl 2 0
epl-2 | spdx | 100 | spdx license identifier epl 2 0
isc | spdx | 100 | spdx license identifier isc
zlib | spdx | 100 | spdx license identifier zlib
boost | spdx | 100 | spdx license identifier bsl 1 0
cc0 | spdx | 100 | spdx license identifier cc0 1 0
unlicense | spdx | 100 | spdx license identifier unlicense
mit | opensource | 95 | opensource org licenses mit
bsd | opensource | 95 | opensource org licenses bsd(?: [23] clause)?
apache-2 | opensource | 95 | opensource org licenses apache 2 0
gpl | opensource | 95 | opensource org licenses gpl(?: [23] 0)?
isc | opensource | 95 | opensource org licenses isc
artistic | opensource | 95 | opensource org licenses artistic(?: license)?(?: 2 0)?
osi | opensource | 60 | opensource org licenses
gpl | gnu | 80 | www gnu org (?:licenses|copyleft)(?: gpl(?: [123] 0)?)?
lgpl | gnu | 90 | www gnu org (?:licenses|copyleft) (?:old licenses )?(?:lgpl|lesser)
agpl | gnu | 90 | www gnu org licenses agpl
gfdl | gnu | 90 | www gnu org (?:licenses|copyleft) fdl
mpl-2 | mozilla | 95 | (?:www )?mozilla org (?:en us )?mpl 2 0
epl | eclipse | 95 | www eclipse org legal epl (?:v10|v20|2 0|v 2 0)
boost | boost | 95 | www boost org license 1 0 txt
ofl | sil | 95 | scripts sil org ofl
wtfpl | wtfpl | 95 | (?:www|sam) (?:zoy org )?wtfpl(?: net)?
qpl | public | 90 | q public license version 1 0
sun-pl | sun | 90 | sun public license(?: version 1 0)?
sissl | sun | 90 | sun industry standards source license
apsl | apple | 95 | apple public source license(?: version)?(?: [12](?: [0-2])?)?
intel | intel | 90 | intel open source license
nokia | nokia | 90 | nokia open source license
rpsl | realnetworks | 90 | realnetworks public source license
rscpl | ricoh | 90 | ricoh source code public license
watcom | sybase | 90 | sybase open watcom public license
lpl | lucent | 90 | lucent public license
efl | eiffel | 90 | eiffel forum license
aal | assurance | 90 | attribution assurance license
afl | academic | 95 | licensed under the academic free license version [123] [01]
osl | software | 95 | licensed under the open software license version [123] [01]
rpl | reciprocal | 90 | reciprocal public license
cpal | attribution | 90 | common public attribution license
frameworx | frameworx | 90 | frameworx open license
nethack | nethack | 90 | nethack general public license
oclc | oclc | 90 | oclc research public license
vovida | vovida | 90 | vovida software license
wxwindows | wxwindows | 90 | wxwindows library licen[cs]e
sleepycat | sleepycat | 90 | sleepycat (?:software |public )?license
aladdin | aladdin | 90 | aladdin free public license
zpl | zope | 90 | zope public license(?: zpl)?(?: version [12] [01])?
w3c | w3c | 90 | w3c software (?:notice and|and document) license
icu | icu | 90 | icu license icu 1 8 1 and later
unicode | unicode | 90 | unicode inc license agreement data files and software
unicode | unicode | 80 | unicode terms of use
cern-ohl | cern | 95 | cern open hardware licen[cs]e(?: version| v)? ?[12](?: (?:permissive|weakly reciprocal|strongly reciprocal))?
tapr | tapr | 95 | tapr open hardware license
solderpad | solderpad | 95 | solderpad hardware licen[cs]e
oracle-bcl | oracle | 90 | oracle binary code license agreement
nvidia | nvidia | 85 | nvidia (?:software|cuda toolkit) (?:license|end user license) agreement
eula | eula agreement | 60 | end user licen[cs]e agreement(?: eula)?
proprietary | proprietary | 80 | (?:confidential and proprietary|proprietary and confidential)
proprietary | unauthorized | 85 | unauthorized copying of this file via any medium is strictly prohibited
proprietary | unauthorized | 70 | unauthorized (?:copying|reproduction|use|duplication) (?:and|or) (?:distribution|redistribution|disclosure)
proprietary | redistribution distribution | 60 | not for (?:redistribution|distribution)
non-commercial | commercial noncommercial | 60 | for (?:personal and )?(?:noncommercial|non commercial) use only
non-commercial | educational | 60 | for educational (?:and research )?(?:use|purposes) only
personal-use | personal | 55 | free for personal use(?: only)?
reserved | rights | 60 | all rights (?:are )?reserved
reserved | rights | 60 | some rights reserved
reserved | reproduced | 80 | no part of this (?:publication|book|work|document) may be reproduced
reserved | reproduced copied published | 70 | may not be (?:reproduced|copied|published)(?: in whole or in part)? without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)
reserved | permission | 50 | (?:used|reprinted|reproduced) (?:with|by) permission
no-rights | rights | 80 | no rights reserved
copyleft | wrongs | 80 | all wrongs reserved
copyright | copyright | 40 | copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*
warranty | warranty | 50 | (?:the software is )?provided as is without warranty of any kind
warranty | warranties | 50 | without warranties or conditions of any kind
trademark | trademarks | 40 | trademarks are (?:the )?property of their respective owners
"""
