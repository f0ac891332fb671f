"""Signature rules of licenses, written by hand, one per line: label, keywords, pattern.

Patterns see lower-case words parted by single blanks. Every match holds one of the rule's keywords as a
whole word. ``LIC`` stands for both spellings of license, ``VER`` for an optional word before a version.
Within a table, the rule that stands first wins a tie.
"""

#: full names with a version
VERSIONED = r"""
apache-2.0  apache  apache(?: software)? LIC VER2(?: 0)?
apache-2.0  apache  apache(?: software foundation)? LIC 2(?: 0)?
apache-1.1  apache  apache(?: software)? LIC VER1 1
apache-1.0  apache  apache(?: software)? LIC VER1(?: 0)?
apache-2.0  apache  VER2(?: 0)? of the apache(?: software)? LIC
gpl-3.0  general  (?:gnu )?general public LIC VER3(?: 0)?(?: or later| or any later version)?
gpl-2.0  general  (?:gnu )?general public LIC VER2(?: 0)?(?: or later| or any later version)?
gpl-1.0  general  (?:gnu )?general public LIC VER1(?: 0)?(?: or later| or any later version)?
gpl-3.0  general  (?:version |v)3(?: 0)? of the (?:gnu )?general public LIC
gpl-2.0  general  (?:version |v)2(?: 0)? of the (?:gnu )?general public LIC
gpl-1.0  general  (?:version |v)1(?: 0)? of the (?:gnu )?general public LIC
gpl-2.0  general  (?:gnu )?general public LIC gpl VER2(?: 0)?
gpl-3.0  general  (?:gnu )?general public LIC gpl VER3(?: 0)?
lgpl-3.0  lesser  (?:gnu )?lesser general public LIC VER3(?: 0)?(?: or later| or any later version)?
lgpl-2.1  lesser  (?:gnu )?lesser general public LIC VER2 1(?: or later| or any later version)?
lgpl-3.0  lesser  (?:version |v)3(?: 0)? of the (?:gnu )?lesser general public LIC
lgpl-2.1  lesser  (?:version |v)2 1 of the (?:gnu )?lesser general public LIC
lgpl-2.1  lesser  (?:gnu )?lesser general public LIC lgpl VER2 1
lgpl-3.0  lesser  (?:gnu )?lesser general public LIC lgpl VER3(?: 0)?
lgpl-2.0  library  (?:gnu )?library general public LIC VER2(?: 0)?(?: or later| or any later version)?
lgpl-2.0  library  (?:version |v)2(?: 0)? of the (?:gnu )?library general public LIC
agpl-3.0  affero  (?:gnu )?affero general public LIC VER3(?: 0)?(?: or later| or any later version)?
agpl-3.0  affero  (?:version |v)3(?: 0)? of the (?:gnu )?affero general public LIC
agpl-1.0  affero  affero general public LIC VER1(?: 0)?
gfdl-1.3  documentation  (?:gnu )?free documentation LIC VER1 3
gfdl-1.2  documentation  (?:gnu )?free documentation LIC VER1 2
gfdl-1.1  documentation  (?:gnu )?free documentation LIC VER1 1
mpl-2.0  mozilla  mozilla public LIC(?: mpl)? VER2(?: 0)?
mpl-1.1  mozilla  mozilla public LIC(?: mpl)? VER1 1
mpl-1.0  mozilla  mozilla public LIC(?: mpl)? VER1 0
npl-1.1  netscape  netscape public LIC VER1 1
npl-1.0  netscape  netscape public LIC VER1 0
epl-2.0  eclipse  eclipse public LIC VER2(?: 0)?
epl-1.0  eclipse  eclipse public LIC VER1(?: 0)?
edl-1.0  eclipse  eclipse distribution LIC VER1(?: 0)?
cddl-1.1  distribution  common development and distribution LIC(?: cddl)? VER1 1
cddl-1.0  distribution  common development and distribution LIC(?: cddl)? VER1(?: 0)?
cpl-1.0  common  common public LIC VER1(?: 0)?
cpal-1.0  attribution  common public attribution LIC VER1(?: 0)?
ipl-1.0  ibm  ibm public LIC VER1(?: 0)?
eupl-1.2  european  european union public LIC(?: eupl)? VER1 2
eupl-1.1  european  european union public LIC(?: eupl)? VER1 1
eupl-1.0  european  european union public LIC(?: eupl)? VER1 0
osl-3.0  open  open software LIC VER3(?: 0)?
osl-2.1  open  open software LIC VER2 1
osl-2.0  open  open software LIC VER2 0
osl-1.0  open  open software LIC VER1 0
afl-3.0  academic  academic free LIC VER3(?: 0)?
afl-2.1  academic  academic free LIC VER2 1
afl-2.0  academic  academic free LIC VER2 0
afl-1.2  academic  academic free LIC VER1 2
afl-1.1  academic  academic free LIC VER1 1
ecl-2.0  educational  educational community LIC VER2(?: 0)?
ecl-1.0  educational  educational community LIC VER1(?: 0)?
artistic-2.0  artistic  (?:perl )?artistic LIC VER2(?: 0)?
artistic-1.0  artistic  (?:perl )?artistic LIC VER1(?: 0)?
psf-2.0  python  python software foundation LIC VER2(?: 0)?
php-3.01  php  php LIC VER3 01
php-3.0  php  php LIC VER3(?: 0)?
bsl-1.0  boost  boost software LIC VER1(?: 0)?
busl-1.1  business  business source LIC VER1 1
elastic-2.0  elastic  elastic LIC VER2(?: 0)?
sspl-1.0  server  server side public LIC VER1(?: 0)?
ofl-1.1  font  (?:sil )?open font LIC(?: ofl)? VER1 1
ofl-1.0  font  (?:sil )?open font LIC(?: ofl)? VER1 0
lppl-1.3c  latex  latex project public LIC VER1 3c
lppl-1.3a  latex  latex project public LIC VER1 3(?:a)?
lppl-1.2  latex  latex project public LIC VER1 2
lppl-1.0  latex  latex project public LIC VER1 0
qpl-1.0  q  q public LIC VER1(?: 0)?
apsl-2.0  apple  apple public source LIC VER2(?: 0)?
apsl-1.2  apple  apple public source LIC VER1 2
odbl-1.0  database  open (?:data commons open )?database LIC VER1(?: 0)?
odc-by-1.0  commons  open data commons attribution LIC VER1(?: 0)?
mulanpsl-2.0  mulan  mulan permissive software LIC VER2(?: 0)?
mulanpsl-1.0  mulan  mulan permissive software LIC VER1(?: 0)?
cecill-2.1  cecill  cecill(?: free software LIC)?(?: agreement)? VER2 1
cecill-2.0  cecill  cecill(?: free software LIC)?(?: agreement)? VER2 0
cecill-1.0  cecill  cecill(?: free software LIC)?(?: agreement)? VER1 0
upl-1.0  universal  universal permissive LIC VER1(?: 0)?
zpl-2.1  zope  zope public LIC VER2 1
zpl-2.0  zope  zope public LIC VER2 0
rpl-1.5  reciprocal  reciprocal public LIC VER1 5
spl-1.0  sun  sun public LIC VER1(?: 0)?
nasa-1.3  nasa  nasa open source agreement VER1 3
blueoak-1.0.0  blue  blue oak model LIC VER1(?: 0)?(?: 0)?
wtfpl  fuck  do what the fuck you want to public LIC(?: VER2)?
"""

#: full names without a version, which versioned names contain or come near to
NAMES = r"""
mit  mit,expat,x11  (?:mit|expat|x11|mit x11|mit expat) (?:LICs?|licensed)
mit  mit  mit style LIC
mit-0  attribution  mit no attribution(?: LIC)?
isc  isc  isc LIC
zlib  zlib  zlib LIC
zlib  libpng  zlib libpng LIC
libpng  libpng  libpng LIC(?: version 2)?
bsl-1.0  boost  boost(?: software)? LIC
bsd-3-clause  bsd  (?:modified|new|revised) bsd LIC
bsd-2-clause  bsd,freebsd  (?:simplified bsd|freebsd) LIC
bsd-4-clause  bsd  (?:original|old) bsd LIC
bsd  bsd  bsd(?: style| type)? (?:LICs?|licensed)
bsd-2-clause  clause  (?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: LIC)?
bsd-3-clause  clause  (?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: LIC)?
bsd-4-clause  clause  (?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: LIC)?
0bsd  0bsd  0bsd(?: LIC)?
0bsd  bsd  (?:zero|0) clause bsd(?: LIC)?
apache  apache  apache(?: software)?(?: style)? (?:LICs?|licensed)
gpl  general  (?:gnu )?general public LICs?
lgpl  lesser  (?:gnu )?lesser general public LIC
lgpl  library  (?:gnu )?library general public LIC
agpl  affero  (?:gnu )?affero general public LIC
gfdl  documentation  (?:gnu )?free documentation LIC
gpl  gpl  gnu gpl
gpl  gpl  gpl (?:LICs?|licensed)
gpl  gpl  under the (?:terms of the )?gpl
lgpl  lgpl  (?:gnu lgpl|lgpl (?:LICs?|licensed)|under the (?:terms of the )?lgpl)
agpl  agpl  (?:gnu agpl|agpl LICs?|under the (?:terms of the )?agpl)
mpl  mozilla  mozilla public LIC
npl  netscape  netscape public LIC
epl  eclipse  eclipse public LIC
edl  eclipse  eclipse distribution LIC
cddl  distribution  common development and distribution LIC
cpl  common  common public LIC
cpal  attribution  common public attribution LIC
ipl  ibm  ibm public LIC
eupl  european  european union public LIC
osl  open  open software LIC
afl  academic  academic free LIC
ecl  educational  educational community LIC
artistic  artistic  (?:perl )?artistic LIC
artistic  perl  same terms as perl(?: itself)?
psf  python  python software foundation LIC
python  python  python LIC
php  php  php LIC
ruby  ruby  ruby LIC
postgresql  postgresql  postgresql LIC
openssl  openssl  openssl LIC
curl  curl  curl LIC
ncsa  ncsa  (?:university of illinois )?ncsa(?: open source)? LIC
w3c  w3c  w3c(?: software(?: notice and)?)? LIC
unicode  unicode  unicode (?:terms of use|LIC)
ofl  font  (?:sil )?open font LIC
lppl  latex  latex project public LIC
qpl  q  q public LIC
ms-pl  microsoft  microsoft public LIC
ms-rl  microsoft  microsoft reciprocal LIC
apsl  apple  apple public source LIC
vim  vim  vim LIC
unlicense  unlicense  unlicense
wtfpl  wtfpl  wtfpl(?: version 2| v2)?
cc0-1.0  cc0  cc0(?: public domain(?: dedication)?| universal)?
cc0-1.0  zero  creative commons zero
odbl  database  open (?:data commons open )?database LIC
odc-by-1.0  commons  open data commons attribution LIC
pddl-1.0  dedication  (?:open data commons )?public domain dedication and LIC
sspl  server  server side public LIC
busl  business  business source LIC
elastic  elastic  elastic LIC
mulanpsl  mulan  mulan permissive software LIC
cecill  cecill  cecill(?: free software)? LIC
upl  universal  universal permissive LIC
zpl  zope  zope public LIC
rpl  reciprocal  reciprocal public LIC
spl  sun  sun public LIC
sleepycat  sleepycat  sleepycat LIC
tcl  tcl  tcl(?: tk)? LIC
ijg  jpeg  independent jpeg group LIC
ftl  freetype  freetype(?: project)? LIC
json  json  json LIC
beerware  beerware,beer  beer ?ware LIC
hpnd  historical  historical permission notice and disclaimer
ntp  ntp  ntp LIC
imagemagick  imagemagick  imagemagick LIC
icu  icu  icu LIC
blueoak  blue  blue oak model LIC
commons-clause  clause  commons clause(?: LIC| restriction| condition)
parity  parity  parity public LIC
polyform  polyform  polyform [a-z]+ LIC
intel  intel  intel open source LIC
nasa  nasa  nasa open source agreement
wxwindows  wxwindows  wxwindows(?: library)? LIC
jsr  specification  jcp specification LIC
oracle  oracle  oracle binary code LIC agreement
bigscience-openrail  rail,openrail  (?:bigscience )?(?:open ?)?rail(?: m)? LIC
llama  llama  llama (?:2 |3 )?community LIC
"""

#: short names that tell themselves apart anywhere, and the Creative Commons family
SHORT = r"""
apache-2.0  apache,apache2,apachev2,asl  (?:apache(?: LIC)? VER2 0|apache ?v2|apache2(?: 0)?|apache 2|asl v?2(?: 0)?)
apache-1.1  apache  apache v?1 1
gpl-3.0  gpl,gplv3,gpl3  (?:gnu )?(?:gplv3(?: 0)?|gpl3|gpl(?: version)? v?3(?: 0)?)(?: or later| only| plus)?
gpl-2.0  gpl,gplv2,gpl2  (?:gnu )?(?:gplv2(?: 0)?|gpl2|gpl(?: version)? v?2(?: 0)?)(?: or later| only| plus)?
gpl-1.0  gpl,gplv1  (?:gnu )?(?:gplv1|gpl(?: version)? v?1 0)(?: or later| only)?
lgpl-3.0  lgpl,lgplv3,lgpl3  (?:gnu )?(?:lgplv3(?: 0)?|lgpl3|lgpl(?: version)? v?3(?: 0)?)(?: or later| only)?
lgpl-2.1  lgpl,lgplv2,lgpl2  (?:gnu )?(?:lgplv2 1|lgpl2 1|lgpl(?: version)? v?2 1)(?: or later| only)?
lgpl-2.0  lgpl,lgplv2,lgpl2  (?:gnu )?(?:lgplv2(?: 0)?|lgpl2|lgpl(?: version)? v?2(?: 0)?)(?: or later| only)?
agpl-3.0  agpl,agplv3,agpl3  (?:gnu )?(?:agplv3(?: 0)?|agpl3|agpl(?: version)? v?3(?: 0)?)(?: or later| only)?
agpl-1.0  agpl,agplv1  (?:agplv1|agpl v?1 0)(?: or later| only)?
gfdl-1.3  gfdl,fdl  (?:gnu )?g?fdl v?1 3(?: or later| only)?
gfdl-1.2  gfdl,fdl  (?:gnu )?g?fdl v?1 2(?: or later| only)?
gfdl-1.1  gfdl,fdl  (?:gnu )?g?fdl v?1 1(?: or later| only)?
mpl-2.0  mpl,mplv2  (?:mplv2(?: 0)?|mpl v?2(?: 0)?)
mpl-1.1  mpl  mpl v?1 1
mpl-1.0  mpl  mpl v?1 0
epl-2.0  epl,eplv2  (?:eplv2(?: 0)?|epl v?2(?: 0)?)
epl-1.0  epl,eplv1  (?:eplv1(?: 0)?|epl v?1(?: 0)?)
edl-1.0  edl  edl v?1 0
cddl-1.1  cddl  cddl v?1 1
cddl-1.0  cddl  cddl v?1 0
cpl-1.0  cpl  cpl v?1 0
cpal-1.0  cpal  cpal v?1 0
eupl-1.2  eupl  eupl v?1 2
eupl-1.1  eupl  eupl v?1 1
osl-3.0  osl  osl v?3 0
osl-2.1  osl  osl v?2 1
afl-3.0  afl  afl v?3 0
afl-2.1  afl  afl v?2 1
ecl-2.0  ecl  ecl v?2 0
bsl-1.0  bsl  bsl 1 0
busl-1.1  busl,bsl  (?:busl|bsl) 1 1
sspl-1.0  sspl,ssplv1  (?:ssplv1|sspl v?1(?: 0)?)
artistic-2.0  artistic  artistic 2 0
artistic-1.0  artistic  artistic 1 0(?: perl)?
psf-2.0  psf,python  (?:psf|python) 2 0
ofl-1.1  ofl  (?:sil )?ofl v?1 1
ofl-1.0  ofl  (?:sil )?ofl v?1 0
lppl-1.3c  lppl  lppl v?1 3c
upl-1.0  upl  upl v?1 0
odbl-1.0  odbl  odbl v?1 0
odc-by-1.0  odc  odc by(?: 1 0)?
pddl-1.0  pddl  pddl(?: 1 0)?
zpl-2.1  zpl  zpl v?2 1
ms-pl  ms  ms pl
ms-rl  ms  ms rl
mulanpsl-2.0  mulanpsl  mulanpsl v?2(?: 0)?
cecill-2.1  cecill  cecill 2 1
cecill-b  cecill  cecill b
cecill-c  cecill  cecill c
hpnd  hpnd  hpnd
cc0-1.0  cc0  cc0(?: v?1 0)(?: universal)?
cc-by-4.0  cc,creative  (?:cc|creative commons) (?:by|attribution)(?: LIC)? VER4 0(?: international)?
cc-by-3.0  cc,creative  (?:cc|creative commons) (?:by|attribution)(?: LIC)? VER3 0(?: unported)?
cc-by-2.5  cc,creative  (?:cc|creative commons) (?:by|attribution)(?: LIC)? VER2 5
cc-by-2.0  cc,creative  (?:cc|creative commons) (?:by|attribution)(?: LIC)? VER2 0
cc-by-sa-4.0  cc,creative  (?:cc|creative commons) (?:by sa|attribution share ?alike)(?: LIC)? VER4 0(?: international)?
cc-by-sa-3.0  cc,creative  (?:cc|creative commons) (?:by sa|attribution share ?alike)(?: LIC)? VER3 0(?: unported)?
cc-by-sa-2.5  cc,creative  (?:cc|creative commons) (?:by sa|attribution share ?alike)(?: LIC)? VER2 5
cc-by-sa-2.0  cc,creative  (?:cc|creative commons) (?:by sa|attribution share ?alike)(?: LIC)? VER2 0
cc-by-nd-4.0  cc,creative  (?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s)(?: LIC)? VER4 0(?: international)?
cc-by-nd-3.0  cc,creative  (?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s)(?: LIC)? VER3 0
cc-by-nc-4.0  cc,creative  (?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: LIC)? VER4 0(?: international)?
cc-by-nc-3.0  cc,creative  (?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: LIC)? VER3 0
cc-by-nc-sa-4.0  cc,creative  (?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: LIC)? VER4 0(?: international)?
cc-by-nc-sa-3.0  cc,creative  (?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: LIC)? VER3 0
cc-by-nc-nd-4.0  cc,creative  (?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)(?: LIC)? VER4 0(?: international)?
cc-by-nc-nd-3.0  cc,creative  (?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)(?: LIC)? VER3 0
cc-by-nc-nd  cc,creative  (?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)
cc-by-nc-sa  cc,creative  (?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)
cc-by-nc  cc,creative  (?:cc|creative commons) (?:by nc|attribution non ?commercial)
cc-by-nd  cc,creative  (?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s)
cc-by-sa  cc,creative  (?:cc|creative commons) (?:by sa|attribution share ?alike)
cc-by  cc,creative  (?:cc by|creative commons attribution)
"""

#: names that mean a license only after a tag, a license field or a grant, or joined to another name there
BARE = r"""
classpath-exception-2.0  classpath  classpath exception(?: 2 0)?
llvm-exception  llvm  llvm exception
gcc-exception-3.1  gcc  gcc exception(?: 3 1)?
linux-syscall-note  linux  linux syscall note
openssl-exception  openssl  openssl exception
mit-0  mit  mit 0
mit  mit,expat,x11  (?:mit(?! no attribution)|expat|x11)
isc  isc  isc
zlib  zlib  zlib(?: acknowledgement)?
bsd-2-clause  bsd  bsd 2(?: clause)?
bsd-3-clause  bsd  bsd 3(?: clause)?
bsd-4-clause  bsd  bsd 4(?: clause)?
bsd  bsd  bsd
0bsd  0bsd  0bsd
gpl  gpl  (?:gnu )?gpl
lgpl  lgpl  (?:gnu )?lgpl
agpl  agpl  (?:gnu )?agpl
mpl  mpl  mpl
epl  epl  epl
cddl  cddl  cddl
apache  apache  apache
artistic  artistic  artistic
psf  psf  psf
postgresql  postgresql  postgresql
openssl  openssl  openssl
ncsa  ncsa  ncsa
ofl  ofl  ofl
unlicense  unlicense  unlicense
wtfpl  wtfpl  wtfpl
beerware  beerware  beerware
cc0-1.0  cc0  cc0
unicode-dfs-2016  unicode  unicode dfs 2016
unicode-3.0  unicode  unicode 3 0
blueoak-1.0.0  blueoak  blueoak 1 0 0
elastic-2.0  elastic  elastic 2 0
w3c  w3c  w3c
proprietary  proprietary,unlicensed  (?:proprietary|unlicensed)
"""

#: sentences of the licenses and of notices themselves
NOTICES = r"""
mit  granted  permission is hereby granted free of charge to any person obtaining a copy
mit  substantial  the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit  noninfringement  warranties of merchantability fitness for a particular purpose and noninfringement
isc  fee  permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd  fee  permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd  binary  redistribution and use in source and binary forms with or without modification are permitted
bsd  retain  redistributions of source code must retain the above copyright notice
bsd  reproduce  redistributions in binary form must reproduce the above copyright notice
bsd-3-clause  endorse  neither the name of (?:\S+ ){1,12}?nor the names of (?:its|any|other) contributors may be used to endorse
bsd-3-clause  endorse  the names? of (?:\S+ ){1,8}?may not be used to endorse or promote products
bsd-4-clause  advertising  all advertising materials mentioning features or use of this software must display
zlib  warranty  this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib  misrepresented  the origin of this software must not be misrepresented
bsl-1.0  granted  permission is hereby granted free of charge to any person or organization obtaining a copy
apache-2.0  compliance  you may not use this file except in compliance with the license
apache-2.0  contributor  each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
gpl-3.0  program  this program is free software you can redistribute it and or modify it under the terms of the gnu general public LIC as published by the free software foundation either version 3
gpl-2.0  program  this program is free software you can redistribute it and or modify it under the terms of the gnu general public LIC as published by the free software foundation either version 2
gpl-3.0  general  gnu general public LIC as published by the free software foundation either version 3
gpl-2.0  general  gnu general public LIC as published by the free software foundation either version 2
gpl  program  this program is free software you can redistribute it and or modify it under the terms of the gnu general public LIC
gpl  software  free software you can redistribute it and or modify it under the terms of the gnu general public LIC
lgpl  library  this library is free software you can redistribute it and or modify it under the terms of
lgpl-2.1  lesser  gnu lesser general public LIC as published by the free software foundation either version 2 1
lgpl-3.0  lesser  gnu lesser general public LIC as published by the free software foundation either version 3
agpl-3.0  affero  gnu affero general public LIC as published by the free software foundation either version 3
agpl-3.0  remotely  all users interacting with it remotely through a computer network
gfdl  invariant  with no invariant sections no front cover texts and no back cover texts
mpl-2.0  mozilla  this source code form is subject to the terms of the mozilla public LIC v 2 0
mpl-2.0  incompatible  this source code form is incompatible with secondary licenses
mpl-1.1  mozilla  the contents of this file are subject to the mozilla public LIC version 1 1
epl-2.0  accompanying  this program and the accompanying materials are made available under the terms of the eclipse public LIC (?:v |version )?2 0
epl-1.0  accompanying  this program and the accompanying materials are made available under the terms of the eclipse public LIC (?:v |version )?1 0
cddl  distribution  the contents of this file are subject to the terms of the common development and distribution LIC
artistic  artistic  the intent of this document is to state the conditions under which a package may be copied
psf  python  python software foundation psf is making python available
postgresql  software  permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
openssl  openssl  this product includes software developed by the openssl project
unlicense  unencumbered  this is free and unencumbered software released into the public domain
cc0-1.0  cc0  has waived all copyright and related or neighboring rights .{0,80}cc0
cc-by  attribution  you must give appropriate credit provide a link to the license .{0,80}attribution
ofl  reserved  reserved font name
wtfpl  fuck  you just do what the fuck you want to
beerware  beer  you can buy me a beer in return
json  evil  the software shall be used for good not evil
hpnd  disclaimer  in supporting documentation .{0,200}historical permission notice and disclaimer
ncsa  illinois  university of illinois .{0,80}open source LIC
sspl  service  if you make the functionality of the program or a modified version available to third parties as a service
busl  production  the licensor may make an additional use grant .{0,80}permitting limited production use
elastic  managed  you may not provide the software to third parties as a hosted or managed service
commons-clause  sell  the license does not grant to you the right to sell the software
public-domain  domain  (?:released|placed|dedicated|been placed|is) (?:in|into|to) the public domain
public-domain  domain  this (?:work|file|document|code|software) is (?:in )?(?:the )?public domain
proprietary  reserved  all rights reserved
proprietary  unauthorized,unauthorised  unauthori[sz]ed copying of this (?:file|software|document)
proprietary  confidential  proprietary and confidential
proprietary  trade  contains? (?:confidential information and )?trade secrets
"""
