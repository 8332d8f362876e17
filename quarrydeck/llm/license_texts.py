"""Public licence texts: names, standard headers and grants, and whole texts of the short licences.

Each template is (licence, needs, body). ``needs`` holds the words (and version numbers) without which a passage is never
that licence, however alike it is otherwise; names written out, so that one licence's words don't stand for another's.
"""

MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZLIB_BODY = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

BOOST_BODY = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""

UNLICENSE_BODY = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""

APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
FSF_END = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."


def _gnu(family: str, name: str, version: str, date: str, thing: str = "program") -> list[tuple[str, str, str]]:
    """Title, references, the notice for source files and the identifiers of one version of a GNU licence."""
    number, short = version.removesuffix(".0"), f"{family}-{version}"
    extra = {"GPL": "", "LGPL": "lesser ", "AGPL": "affero "}[family]
    term = number.replace(".", "_")
    needs, short_needs = f"gnu {extra}general public {term}", f"{family.lower()} {term}"
    notice = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version."
    return [
        (short, needs, f"GNU {name} Version {number}, {date}"),
        (short, needs, f"Licensed under the GNU {name}, version {number}"),
        (short, needs, f"This work is licensed under the GNU {name}, version {number}"),
        (short, needs, notice),
        (short, needs, f"{notice} This {thing} {FSF_END} See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {thing}."),
        (short, short_needs, f"License: {short}"),
        (short, short_needs, f"Licensed under the {family} version {number}"),
        (short, short_needs, f"Released under the {family} version {number}"),
        (short, f"spdx {short_needs}", f"SPDX-License-Identifier: {short}-only"),
        (short, f"spdx {short_needs}", f"SPDX-License-Identifier: {short}-or-later"),
    ]


def _named(licence: str, needs: str, *names: str, spdx: str | None = None) -> list[tuple[str, str, str]]:
    """References by name, and the identifier."""
    forms = [f"{how} {name}" for name in names for how in ("Licensed under the", "Released under the", "This work is licensed under the", "License:")]
    spdx_needs = " ".join(licence.lower().replace("-", " ").split()) if spdx is None else spdx
    return [(licence, needs, form) for form in (*names, *forms)] + [(licence, f"spdx {spdx_needs}", f"SPDX-License-Identifier: {licence}")]


def _creative(code: str, words: str) -> list[tuple[str, str, str]]:
    """A Creative Commons licence of version 4.0 by its code and its full name."""
    short, licence = f"cc {code} 4", f"CC-{code.upper().replace(' ', '-')}-4.0"
    full = " ".join(words.lower().split())
    return [
        *_named(licence, short, f"CC {code.upper().replace(' ', '-')} 4.0", spdx=short),
        (licence, f"creative commons {full} 4", f"Creative Commons {words} 4.0 International"),
        (licence, f"creative commons {full} 4", f"This work is licensed under a Creative Commons {words} 4.0 International License"),
        (licence, f"creative commons {full} 4", f"Creative Commons {words} 4.0 International Public License"),
    ]


TEMPLATES: list[tuple[str, str, str]] = [
    *_named("MIT", "mit", "MIT License"),
    ("MIT", "permission hereby granted obtaining sublicense", MIT_BODY),
    ("MIT", "permission hereby granted obtaining associated documentation", MIT_BODY.split(", to deal")[0]),
    *_named("Apache-2.0", "apache", "Apache License, Version 2.0"),
    ("Apache-2.0", "apache 2", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "apache 2", APACHE_HEADER),
    *_gnu("GPL", "General Public License", "2.0", "June 1991"),
    *_gnu("GPL", "General Public License", "3.0", "29 June 2007"),
    *_gnu("LGPL", "Lesser General Public License", "2.1", "February 1999", "library"),
    *_gnu("LGPL", "Lesser General Public License", "3.0", "29 June 2007", "library"),
    *_gnu("AGPL", "Affero General Public License", "3.0", "19 November 2007"),
    *_named("BSD-2-Clause", "bsd 2 clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "redistribution source binary forms retain disclaimer", f"{BSD_GRANT}\n{BSD_END}"),
    *_named("BSD-3-Clause", "bsd 3 clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "redistribution source binary forms retain disclaimer endorse promote", f"{BSD_GRANT}\n{BSD_THIRD}\n{BSD_END}"),
    *_named("ISC", "isc", "ISC License"),
    ("ISC", "permission fee purpose granted appear", ISC_BODY),
    *_named("Zlib", "zlib", "zlib License"),
    ("Zlib", "origin misrepresented altered plainly", ZLIB_BODY),
    *_named("BSL-1.0", "boost 1", "Boost Software License - Version 1.0", spdx="bsl 1"),
    ("BSL-1.0", "permission hereby granted obtaining organization reproduce", BOOST_BODY),
    *_named("MPL-2.0", "mozilla 2", "Mozilla Public License, v. 2.0", spdx="mpl 2"),
    ("MPL-2.0", "mozilla 2", MPL_HEADER),
    ("MPL-2.0", "mozilla 2", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "mozilla 2", MPL_HEADER.split(" If ")[0]),
    *_named("EPL-2.0", "eclipse 2", "Eclipse Public License, version 2.0", spdx="epl 2"),
    *_named("Artistic-2.0", "artistic 2", "Artistic License 2.0", "The Artistic License 2.0"),
    *_named("Unlicense", "unlicense", "Unlicense"),
    ("Unlicense", "unencumbered public domain", UNLICENSE_BODY),
    ("Unlicense", "unencumbered public domain", UNLICENSE_BODY.split("\n")[0]),
    *_named("CC0-1.0", "cc 0 1", "CC0 1.0 Universal", spdx="cc 0 1"),
    ("CC0-1.0", "creative commons cc 0 1", "Creative Commons Legal Code CC0 1.0 Universal"),
    *_creative("by", "Attribution"),
    *_creative("by sa", "Attribution ShareAlike"),
    *_creative("by nc", "Attribution NonCommercial"),
    *_creative("by nd", "Attribution NoDerivatives"),
    *_creative("by nc sa", "Attribution NonCommercial ShareAlike"),
    *_creative("by nc nd", "Attribution NonCommercial NoDerivatives"),
]
