"""Texts that name licenses, with the labels a reader gives them, and texts that name none."""

LABELLED = """
apache-2.0 | License: Apache-2.0
apache-2.0 | "license": "Apache-2.0",
apache-2.0 | Licensed under the Apache License, Version 2.0 (the "License")
apache-2.0 | Apache 2.0
apache-2.0 | This project is Apache 2 licensed.
apache-2.0 | ALv2, that is the Apache License 2.0
apache-2.0 | [![License](https://img.shields.io/badge/License-Apache%202.0-blue.svg)] Apache-2.0
apache-2.0 | you may not use this file except in compliance with the License.
apache-2.0 | Version 2.0 of the Apache License
apache-2.0 | # SPDX-License-Identifier: Apache-2.0
apache-2.0 | ASL 2.0
apache-2.0 | Released under Apache v2
apache | The Apache Software License applies.
apache | licensed under Apache terms
apache-1.1 | Apache Software License, Version 1.1
apache-1.0 | Apache License 1.0
mit | "license": "MIT"
mit | licensed under MIT
mit | MIT licensed
mit | License :: OSI Approved :: MIT License
mit | The MIT License (MIT) Copyright (c) 2019
mit | released under the terms of the Expat license
mit | license = "MIT"
mit | Distributed under the MIT license. See LICENSE for more.
mit | Permission is hereby granted, free of charge, to any person obtaining a copy of this software
mit | available under an MIT-style license
mit | The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
mit | This library is covered under the X11 License
mit,apache-2.0 | SPDX-License-Identifier: MIT OR Apache-2.0
mit,apache-2.0 | license = "MIT/Apache-2.0"
mit,apache-2.0 | Dual licensed under MIT and Apache 2.0
mit,gpl | Dual licensed under the MIT and GPL licenses.
mit,gpl-2.0 | Dual licensed under the MIT or GPL Version 2 licenses.
mit,bsd-3-clause | SPDX-License-Identifier: (MIT AND BSD-3-Clause)
mit-0 | MIT No Attribution
mit-0 | SPDX-License-Identifier: MIT-0
isc | ISC License
isc | "license": "ISC"
isc | Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
zlib | SPDX-License-Identifier: Zlib
zlib | under the zlib/libpng license
zlib | The origin of this software must not be misrepresented; you must not claim that you wrote it.
bsl-1.0 | Distributed under the Boost Software License, Version 1.0.
bsl-1.0 | SPDX-License-Identifier: BSL-1.0
bsl-1.0 | Boost License 1.0
bsd-3-clause | BSD 3-Clause License
bsd-3-clause | 3-clause BSD
bsd-3-clause | New BSD License
bsd-3-clause | the modified BSD license
bsd-3-clause | SPDX-License-Identifier: BSD-3-Clause
bsd-3-clause | Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | three-clause BSD licence
bsd-2-clause | Simplified BSD License
bsd-2-clause | BSD-2-Clause
bsd-2-clause | a two clause BSD license
bsd-2-clause | The FreeBSD License
bsd-4-clause | All advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause | the original BSD license
bsd | Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.
bsd | License: BSD
bsd | Redistribution and use in source and binary forms, with or without modification, are permitted provided that
0bsd | SPDX-License-Identifier: 0BSD
0bsd | Zero-Clause BSD
gpl-3.0 | GPLv3
gpl-3.0 | GPL-3.0-or-later
gpl-3.0 | GNU General Public License v3.0
gpl-3.0 | License: GPL 3
gpl-3.0 | SPDX-License-Identifier: GPL-3.0-only
gpl-3.0 | GNU GPL version 3 or later
gpl-3.0 | under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License
gpl-3.0 | This work is licensed under the GNU General Public License, version 3.
gpl-3.0 | GPLv3+
gpl-2.0 | GPL-2.0
gpl-2.0 | GPLv2
gpl-2.0 | version 2 of the GNU General Public License
gpl-2.0 | under the terms of the GNU General Public License version 2 as published by the Free Software Foundation
gpl-2.0 | /* SPDX-License-Identifier: GPL-2.0+ */
gpl-2.0 | MODULE_LICENSE("GPL v2");
gpl-2.0 | GNU General Public License, version 2
gpl-2.0,classpath-exception-2.0 | SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0
gpl-2.0,linux-syscall-note | SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note
gpl-2.0,mit | SPDX-License-Identifier: GPL-2.0 OR MIT
gpl-2.0,bsd-3-clause | SPDX-License-Identifier: GPL-2.0 OR BSD-3-Clause
gpl-1.0 | GNU General Public License version 1
gpl | MODULE_LICENSE("GPL");
gpl | released under the GPL
gpl | You should have received a copy of the GNU General Public License along with this program.
gpl | it is GPL licensed
lgpl-2.1 | LGPL-2.1
lgpl-2.1 | GNU Lesser General Public License v2.1
lgpl-2.1 | LGPLv2.1+
lgpl-2.1 | version 2.1 of the GNU Lesser General Public License
lgpl-2.1 | License: LGPL 2.1 or later
lgpl-3.0 | LGPLv3
lgpl-3.0 | GNU Lesser General Public License, Version 3
lgpl-3.0 | SPDX-License-Identifier: LGPL-3.0-or-later
lgpl-2.0 | GNU Library General Public License version 2
lgpl-2.0 | LGPL-2.0-only
lgpl | under the LGPL
lgpl | This library is free software; you can redistribute it and/or modify it under the terms of
lgpl | License: LGPL
agpl-3.0 | AGPL-3.0
agpl-3.0 | AGPLv3
agpl-3.0 | GNU Affero General Public License v3
agpl-3.0 | GNU AGPL version 3
agpl-3.0 | version 3 of the GNU Affero General Public License
agpl | under the GNU Affero General Public License
gfdl-1.3 | GNU Free Documentation License, Version 1.3
gfdl-1.2 | GFDL 1.2
gfdl | with no Invariant Sections, no Front-Cover Texts and no Back-Cover Texts
mpl-2.0 | MPL-2.0
mpl-2.0 | Mozilla Public License, v. 2.0
mpl-2.0 | Mozilla Public License Version 2.0
mpl-2.0 | This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
mpl-2.0 | MPL 2.0
mpl-1.1 | The contents of this file are subject to the Mozilla Public License Version 1.1
mpl-1.1,gpl-2.0,lgpl-2.1 | Version: MPL 1.1/GPL 2.0/LGPL 2.1
mpl | Mozilla Public License
epl-2.0 | Eclipse Public License 2.0
epl-2.0 | SPDX-License-Identifier: EPL-2.0
epl-1.0 | Eclipse Public License v1.0
epl-1.0 | EPL 1.0
edl-1.0 | Eclipse Distribution License v1.0
cddl-1.0 | Common Development and Distribution License (CDDL) v1.0
cddl-1.1 | CDDL 1.1
cddl | COMMON DEVELOPMENT AND DISTRIBUTION LICENSE
cpl-1.0 | Common Public License 1.0
cpal-1.0 | Common Public Attribution License Version 1.0
ipl-1.0 | IBM Public License Version 1.0
eupl-1.2 | European Union Public Licence v. 1.2
eupl-1.2 | EUPL-1.2
eupl-1.1 | EUPL 1.1
osl-3.0 | Open Software License ("OSL") v. 3.0
osl-3.0 | OSL-3.0
afl-3.0 | Academic Free License version 3.0
afl-2.1 | SPDX-License-Identifier: AFL-2.1
ecl-2.0 | Educational Community License, Version 2.0
artistic-2.0 | Artistic License 2.0
artistic-2.0 | "license": "Artistic-2.0"
artistic | you can redistribute it and/or modify it under the same terms as Perl itself
artistic | The Artistic License
psf-2.0 | Python Software Foundation License Version 2
psf-2.0 | PSF-2.0
psf | License :: OSI Approved :: Python Software Foundation License
php-3.01 | PHP License, version 3.01
php-3.0 | The PHP License 3.0
ruby | Ruby License
postgresql | The PostgreSQL Licence
postgresql | License: PostgreSQL
openssl | OpenSSL License
openssl | This product includes software developed by the OpenSSL Project
curl | SPDX-License-Identifier: curl
ncsa | University of Illinois/NCSA Open Source License
ncsa | License: NCSA
w3c | W3C Software Notice and License
unicode | Unicode Terms of Use
unicode-dfs-2016 | SPDX-License-Identifier: Unicode-DFS-2016
ofl-1.1 | SIL Open Font License, Version 1.1
ofl-1.1 | OFL-1.1
ofl | with Reserved Font Name Source
lppl-1.3c | LaTeX Project Public License v1.3c
lppl-1.3c | LPPL 1.3c
qpl-1.0 | Q Public License version 1.0
ms-pl | Microsoft Public License (Ms-PL)
ms-pl | License: MS-PL
ms-rl | Microsoft Reciprocal License
apsl-2.0 | Apple Public Source License Version 2.0
vim | Vim License
unlicense | This is free and unencumbered software released into the public domain.
unlicense | The Unlicense
unlicense | license: Unlicense
wtfpl | WTFPL
wtfpl | Do What The Fuck You Want To Public License, Version 2
cc0-1.0 | CC0 1.0 Universal
cc0-1.0 | License: CC0-1.0
cc0-1.0 | Creative Commons Zero
cc-by-4.0 | CC BY 4.0
cc-by-4.0 | Creative Commons Attribution 4.0 International License
cc-by-4.0 | This work is licensed under CC-BY-4.0
cc-by-3.0 | Creative Commons Attribution 3.0 Unported
cc-by-sa-4.0 | CC-BY-SA-4.0
cc-by-sa-4.0 | Creative Commons Attribution-ShareAlike 4.0 International
cc-by-sa-3.0 | CC BY-SA 3.0
cc-by-nd-4.0 | Creative Commons Attribution-NoDerivatives 4.0
cc-by-nc-4.0 | Creative Commons Attribution-NonCommercial 4.0 International License
cc-by-nc-sa-4.0 | CC BY-NC-SA 4.0
cc-by-nc-nd-4.0 | Attribution under Creative Commons Attribution-NonCommercial-NoDerivatives 4.0
cc-by-nc | content is CC BY-NC
cc-by | Creative Commons Attribution
odbl-1.0 | Open Data Commons Open Database License v1.0
odbl | Open Database License
odbl-1.0 | ODbL-1.0
odc-by-1.0 | ODC-By 1.0
pddl-1.0 | Public Domain Dedication and License
sspl-1.0 | Server Side Public License v1
sspl-1.0 | SSPL-1.0
busl-1.1 | Business Source License 1.1
busl-1.1 | SPDX-License-Identifier: BUSL-1.1
elastic-2.0 | Elastic License 2.0
elastic-2.0 | "license": "Elastic-2.0"
mulanpsl-2.0 | Mulan Permissive Software License v2
mulanpsl-2.0 | MulanPSL-2.0
cecill-2.1 | CeCILL 2.1
cecill-b | SPDX-License-Identifier: CECILL-B
hpnd | Historical Permission Notice and Disclaimer
upl-1.0 | Universal Permissive License v 1.0
upl-1.0 | UPL-1.0
zpl-2.1 | Zope Public License (ZPL) Version 2.1
zpl-2.1 | ZPL 2.1
rpl-1.5 | Reciprocal Public License 1.5
sleepycat | Sleepycat License
ftl | The FreeType Project License
beerware | If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.
json | The Software shall be used for Good, not Evil.
blueoak-1.0.0 | Blue Oak Model License 1.0.0
commons-clause | Commons Clause License Condition v1.0
public-domain | This file has been placed in the public domain.
public-domain | This work is in the public domain
proprietary | All rights reserved.
proprietary | Unauthorized copying of this file, via any medium is strictly prohibited
proprietary | PROPRIETARY AND CONFIDENTIAL
proprietary | "license": "UNLICENSED"
apache-2.0,llvm-exception | SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception
apache-2.0,mit,isc | license: Apache-2.0 AND MIT AND ISC
"""

CLEAN = """
omit licenses
a permissive mood and a public general
mit freundlichen Grüßen aus Berlin
the driver must show a driving license
Lizenz mit Auflagen
an apache helicopter landed
the Boston marathon and the MIT campus
he studied at MIT and the university
ruby is a red stone, python is a snake
a poetic licence was taken
they released under pressure a new record
creative people with common sense
the clause names three conditions
the software is provided to all schools
free software meetings every Monday
an open font of wisdom
the elastic band and the vim of youth
public library rules: no eating, general quiet
permission was granted to enter
the academic board is free on Friday
"""


def labelled() -> list[tuple[set[str], str]]:
    lines = (line.split(" | ", 1) for line in LABELLED.strip().splitlines())
    return [(set(labels.split(",")), text) for labels, text in lines]
