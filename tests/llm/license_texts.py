"""Texts and the labels a reader gives them, stated without the rules."""

TEXTS = """
License: MIT | mit
MIT licensed | mit
licence: mit | mit
This project is MIT-licensed. | mit
Released under MIT | mit
released
   under the MIT license | mit
Licensed under the terms of the MIT licence, see LICENSE. | mit
Distributed under the Expat License | mit
The software is provided "as is", without warranty of any kind, express or implied | mit
Permission is hereby granted, free of charge, to any person obtaining a copy of this software | mit
license: apache-2.0 | apache-2
released under Apache 2.0 | apache-2
Licensed under the Apache License, Version 2.0 (the "License") | apache-2
Apache License v2.0 | apache-2
Apache-2.0 licensed | apache-2
Available under the Apache 2 license. | apache-2
you may not use this file except in compliance with the License. | apache-2
Apache License 1.1 | apache-1
This product includes software developed by the Apache Software Foundation | apache-1
Apache License | apache
the Apache Software License | apache
BSD License | bsd
BSD-style license | bsd
License: BSD | bsd
BSD licensed | bsd
Redistribution and use in source and binary forms, with or without modification, are permitted | bsd
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" | bsd
Simplified BSD License | bsd-2
License: BSD-2-Clause | bsd-2
2-clause BSD license | bsd-2
Redistributions of source code must retain the above copyright notice | bsd-2
New BSD License | bsd-3
3-Clause BSD licence | bsd-3
license: bsd-3-clause | bsd-3
Neither the name of the University nor the names of its contributors may be used | bsd-3
Original BSD license | bsd-4
All advertising materials mentioning features or use of this software must display the following acknowledgement: | bsd-4
License: 0BSD | 0bsd
ISC License | isc
License: ISC | isc
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee | isc
zlib License | zlib
License: Zlib | zlib
The origin of this software must not be misrepresented | zlib
Altered source versions must be plainly marked as such | zlib
Licensed under the GNU General Public License | gpl
GNU GPL | gpl
License: GPL | gpl
You should have received a copy of the GNU General Public License along with this program. | gpl
GPLv2 | gpl-2
GPL-2.0 | gpl-2
GPL v2.0 | gpl-2
GPL version 2 | gpl-2
GNU GPL v2 | gpl-2
License: GPL-2.0-or-later | gpl-2
GNU General Public License v2.0 | gpl-2
GNU General Public Licence, version 2 | gpl-2
under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. | gpl-2
GPLv3 | gpl-3
GNU GPL version 3 | gpl-3
GNU General Public License v3 | gpl-3
GPL 3.0 | gpl-3
under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. | gpl-3
LGPL | lgpl
GNU Lesser General Public License | lgpl
GNU Library General Public License | lgpl
License: LGPL | lgpl
GNU Lesser General Public License v2.1 | lgpl-2
LGPL-2.1 | lgpl-2
LGPLv2.1 | lgpl-2
GNU LGPL version 2.1 | lgpl-2
GNU Library General Public License version 2 | lgpl-2
GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version | lgpl-2
GNU Lesser General Public License version 3 | lgpl-3
LGPLv3 | lgpl-3
LGPL v3 | lgpl-3
GNU Lesser General Public License v3.0 | lgpl-3
AGPL | agpl
GNU Affero General Public License | agpl
AGPLv3 | agpl-3
AGPL-3.0 | agpl-3
GNU Affero General Public License v3.0 | agpl-3
GNU AGPL version 3 | agpl-3
GNU Free Documentation License | gfdl
GNU Free Documentation License version 1.3 | gfdl
Mozilla Public License | mpl
License: MPL | mpl
Mozilla Public License 2.0 | mpl-2
Mozilla Public License, v. 2.0 | mpl-2
MPL 2.0 | mpl-2
MPLv2 | mpl-2
MPL 1.1 | mpl-1
Mozilla Public License Version 1.1 | mpl-1
Eclipse Public License | epl
Eclipse Public License v2.0 | epl-2
EPL 2.0 | epl-2
EPL-1.0 | epl-1
Eclipse Public License - v 1.0 | epl-1
Common Development and Distribution License | cddl-1
CDDL 1.0 | cddl-1
European Union Public Licence 1.2 | eupl
EUPL v1.2 | eupl
Artistic License 2.0 | artistic-2
Artistic License 1.0 | artistic-1
Boost Software License 1.0 | bsl-1
License: BSL-1.0 | bsl-1
WTFPL | wtfpl
You just DO WHAT THE FUCK YOU WANT TO. | wtfpl
The Unlicense | unlicense
This is free and unencumbered software released into the public domain. | unlicense
CC0 1.0 | cc0
License: CC0 | cc0
Creative Commons Zero | cc0
CC BY 4.0 | cc-by
license: cc-by | cc-by
Creative Commons Attribution 4.0 International License | cc-by
CC BY-SA 3.0 | cc-by-sa
Creative Commons Attribution-ShareAlike 4.0 | cc-by-sa
CC BY-ND 4.0 | cc-by-nd
CC BY-NC 4.0 | cc-by-nc
Creative Commons Attribution-NonCommercial 4.0 | cc-by-nc
CC BY-NC-SA 4.0 | cc-by-nc-sa
CC-BY-NC-ND-4.0 | cc-by-nc-nd
Open Database License | odbl
ODbL 1.0 | odbl
Open Data Commons Attribution License | odc-by
SIL Open Font License 1.1 | ofl
License: OFL-1.1 | ofl
Python Software Foundation License | python-2
PSF License | python-2
PHP License 3.01 | php-3
Ruby License | ruby
PostgreSQL License | postgresql
License: PostgreSQL | postgresql
OpenSSL License | openssl
curl license | curl
NCSA Open Source License | ncsa
Microsoft Public License | ms-pl
Microsoft Reciprocal License | ms-rl
Universal Permissive License | upl
Academic Free License 3.0 | afl-3
Open Software License 3.0 | osl-3
CeCILL-B | cecill
Server Side Public License | sspl
Business Source License 1.1 | busl
Elastic License 2.0 | elastic-2
OpenRAIL-M License | rail
Llama 3 Community License | llama
dedicated to the public domain | public-domain
The author disclaims copyright to this source code. | public-domain
This file has been placed in the public domain. | public-domain
All rights reserved. | proprietary
No part of this document may be reproduced | proprietary
Unauthorized copying of this file | proprietary
License: MIT or Apache-2.0 | apache-2,mit
License: MIT, Apache-2.0 or BSD-3-Clause | apache-2,bsd-3,mit
Dual licensed: GPLv2 and MIT license | gpl-2,mit
LGPL-2.1 or MPL 2.0 | lgpl-2,mpl-2
Code is MIT licensed, text is CC BY-SA 4.0 | cc-by-sa,mit
under GPLv3 or the Apache License, Version 2.0 | apache-2,gpl-3
he submitted a license plate | 
the license was revoked | 
a driver's licence and the permission of the owner | 
software versions altered in 2014 | 
released under pressure | 
available under the stairs | 
published under her own name | 
the warranty is void | 
apache helicopters and the mit campus | 
distributed under the bridge to boost morale | 
we used curl, ruby and zlib | 
emails sent cc by mistake | 
provided as is | 
rights and duties | 
contributors to the volume | 
"""


def cases():
    for line in TEXTS.replace("released\n   under", "released\\n under").strip("\n").splitlines():
        text, _, want = line.rpartition("|")
        yield text.strip().replace("\\n", "\n"), {w for w in want.strip().split(",") if w}
