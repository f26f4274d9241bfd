"""Templates of licences: whole texts of short ones, titles and standard notices of long ones, identifiers.

The wordings are fixed values: public texts that have to be matched as they are.
"""

from __future__ import annotations

PERMISSION_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:"
)
NOTICE_MIT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software. 3. This notice may not be removed or altered from any source distribution."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
BSL = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
    "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
)
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
    "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
)
APACHE_WARRANTY = (
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
    "under the License."
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/."
)
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"
#: Family, name, version as written, dates of the titles.
GNU: list[tuple[str, str, str, str, str]] = [
    ("GPL", "GNU General Public License", "2", "2.0", "June 1991"),
    ("GPL", "GNU General Public License", "3", "3.0", "29 June 2007"),
    ("LGPL", "GNU Lesser General Public License", "2.1", "2.1", "February 1999"),
    ("LGPL", "GNU Lesser General Public License", "3", "3.0", "29 June 2007"),
    ("AGPL", "GNU Affero General Public License", "3", "3.0", "19 November 2007"),
]
#: Code, words and versions of the Creative Commons licences.
CC: list[tuple[str, str]] = [
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]
#: Licences of which a short mention is a notice, and how they are mentioned.
MENTIONS: list[tuple[str, str]] = [
    ("MIT", "the MIT License"),
    ("ISC", "the ISC License"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("EPL-2.0", "the Eclipse Public License, version 2.0"),
    ("Zlib", "the zlib License"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
]
WHOLE: list[tuple[str, str]] = [
    ("MIT", f"MIT License Copyright {PERMISSION_MIT} {NOTICE_MIT} {WARRANTY_MIT}"),
    ("MIT", f"{PERMISSION_MIT} {NOTICE_MIT}"),
    ("MIT", PERMISSION_MIT),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright All rights reserved. {BSD_HEAD} {BSD_SOURCE} {BSD_BINARY} {BSD_WARRANTY}"),
    ("BSD-2-Clause", f"{BSD_HEAD} {BSD_SOURCE} {BSD_BINARY}"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright All rights reserved. {BSD_HEAD} {BSD_SOURCE} {BSD_BINARY} {BSD_NAMES} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_HEAD} {BSD_SOURCE} {BSD_BINARY} {BSD_NAMES}"),
    ("BSD-3-Clause", BSD_NAMES),
    ("ISC", f"ISC License Copyright {ISC}"),
    ("Zlib", f"zlib License Copyright {ZLIB}"),
    ("Unlicense", UNLICENSE),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003 {BSL}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Apache-2.0", f"{APACHE} {APACHE_WARRANTY}"),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", MPL),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", EPL),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("Proprietary", "Copyright All rights reserved."),
    ("Proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]


def templates() -> list[tuple[str, str]]:
    """(SPDX identifier, wording); the families by rule."""
    out = list(WHOLE)
    for name, mention in MENTIONS:
        out += [(name, f"Licensed under {mention}"), (name, f"This work is licensed under {mention}"), (name, f"Released under {mention}"), (name, mention), (name, f"SPDX-License-Identifier: {name}")]
    out.append(("Unlicense", "SPDX-License-Identifier: Unlicense"))
    for family, name, written, version, date in GNU:
        only, later = f"{family}-{version}-only", f"{family}-{version}-or-later"
        free = "This program is free software: you can redistribute it and/or modify it under the terms of the"
        warranty = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
        copy = f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
        either = f"{free} {name} as published by the Free Software Foundation, either version {written} of the License, or (at your option) any later version."
        fixed = f"{free} {name} version {written} as published by the Free Software Foundation."
        out += [
            (only, f"{name} Version {written}, {date}"),
            (only, f"Licensed under the {name}, version {written}"),
            (only, f"This work is licensed under the {name}, version {written}"),
            (only, f"Released under the {name} v{written}"),
            (only, f"Licensed under the {family}v{written}"),
            (only, f"Licensed under the {family} version {written}"),
            (only, fixed),
            (only, f"{fixed} {warranty} {copy}"),
            (later, either),
            (later, f"{either} {warranty} {copy}"),
            (later, f"Licensed under the {name}, version {written} or later"),
            (later, f"Licensed under the {family} version {written} or any later version"),
            *[(only, f"SPDX-License-Identifier: {family}-{version}{end}") for end in ("", "-only")],
            *[(later, f"SPDX-License-Identifier: {family}-{version}{end}") for end in ("+", "-or-later")],
        ]
    for code, words in CC:
        for version, kind in (("4.0", "International"), ("3.0", "Unported")):
            name = f"CC-{code}-{version}"
            out += [
                (name, f"Licensed under CC {code} {version}"),
                (name, f"This work is licensed under a Creative Commons {words} {version} {kind} License"),
                (name, f"Creative Commons {words} {version} {kind} Public License"),
                (name, f"SPDX-License-Identifier: {name}"),
            ]
    return out
