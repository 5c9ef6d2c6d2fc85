"""SPDX forms of the listed licences, and texts or characteristic paragraphs of licence files and headers.
Versions that may be used "or later" go by the listed licence of that version."""

from __future__ import annotations

GNU = [("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")]
PLAIN = "Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC0-1.0 ISC 0BSD MIT MPL-2.0 Unlicense".split()
SPDX = [(n, f"SPDX-License-Identifier: {n}") for n in PLAIN]
SPDX += [(f"{n}-{v}", f"SPDX-License-Identifier: {n}-{v}{how}") for n, v in GNU for how in ("", "-only", "-or-later")]

AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software."
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
APACHE_AS_IS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."

FULL = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
DATES = {"GPL-2.0": "Version 2, June 1991", "GPL-3.0": "Version 3, 29 June 2007", "LGPL-2.1": "Version 2.1, February 1999", "LGPL-3.0": "Version 3, 29 June 2007", "AGPL-3.0": "Version 3, 19 November 2007"}


def gnu(name: str, version: str) -> list[tuple[str, str]]:
    full, v = FULL[name], version.removesuffix(".0")
    what = "library" if name == "LGPL" else "program"
    free = f"This {what} is free software: you can redistribute it and/or modify it under the terms of "
    later = f"the {full} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. "
    only = f"version {v} of the {full} as published by the Free Software Foundation. "
    hope = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {full} for more details. "
    texts = [f"{full} {DATES[f'{name}-{version}']}", f"{full} {DATES[f'{name}-{version}']} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."]
    texts += [free + x + y for x in (later, only) for y in ("", hope)]
    return [(f"{name}-{version}", x) for x in texts]


def commons(short: str, long: str) -> list[tuple[str, str]]:
    title = f"Creative Commons {long} 4.0 International Public License"
    return [(f"CC-{short}-4.0", f"{title} By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this {title} (\"Public License\").")]


BODIES = [
    ("MIT", MIT), ("MIT", f"{MIT} {MIT_NOTICE}"), ("MIT", f"{MIT} {MIT_NOTICE} {AS_IS}"),
    ("ISC", ISC + ISC_NOTICE), ("ISC", f"{ISC}{ISC_NOTICE} {ISC_AS_IS}"), ("0BSD", ISC + "."), ("0BSD", f"{ISC}. {ISC_AS_IS}"),
    ("BSD-2-Clause", BSD), ("BSD-2-Clause", BSD + BSD_AS_IS), ("BSD-3-Clause", BSD + BSD_3), ("BSD-3-Clause", BSD + BSD_3 + BSD_AS_IS),
    ("Apache-2.0", APACHE), ("Apache-2.0", APACHE + APACHE_AS_IS),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("Unlicense", UNLICENSE),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP."),
    *(x for n, v in GNU for x in gnu(n, v)),
    *commons("BY", "Attribution"), *commons("BY-NC", "Attribution-NonCommercial"), *commons("BY-SA", "Attribution-ShareAlike"),
    *commons("BY-ND", "Attribution-NoDerivatives"), *commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), *commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]
TEXTS = SPDX + BODIES
