"""Templates of the license scan: (label, share of the template that must be covered, text).

Whole texts and notices of well-known licenses, in their public wording; identifiers come from rules.
"""

from __future__ import annotations

#: Phrases that count wherever all their words stand consecutively: (label, phrase).
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: The share of a notice or text that a span must cover.
COVER = 0.6

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software. "
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = {
    "gpl": "GNU General Public License",
    "lgpl": "GNU Lesser General Public License",
    "agpl": "GNU Affero General Public License",
}
_GNU_VERSIONS = {"gpl": ("2", "3"), "lgpl": ("2.1", "3"), "agpl": ("3",)}
#: The parts of Creative Commons licenses: identifier, and the title's words.
_CC = {
    "by": "Attribution",
    "by-sa": "Attribution-ShareAlike",
    "by-nd": "Attribution-NoDerivatives",
    "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
_SPDX = "MIT ISC Zlib Unlicense 0BSD BSD-2-Clause BSD-3-Clause Apache-2.0 BSL-1.0 MPL-2.0 EPL-2.0 CDDL-1.0 WTFPL CC0-1.0".split()


def _notices() -> list[tuple[str, float, str]]:
    out = [
        ("mit", COVER, "Released under the MIT License."),
        ("mit", COVER, _MIT.split(" (the")[0]),
        ("mit", COVER, _MIT + _AS_IS),
        ("apache-2.0", COVER, "Licensed under the Apache License, Version 2.0"),
        ("apache-2.0", COVER, "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
        ("apache-2.0", COVER, 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS'),
        ("apache-2.0", COVER, "See the License for the specific language governing permissions and limitations under the License."),
        ("apache-2.0", 1.0, "Apache License Version 2.0, January 2004"),
        ("bsd", COVER, _BSD.split(": ")[0]),
        ("bsd-2-clause", 0.9, _BSD + _BSD_AS_IS),
        ("bsd-3-clause", COVER, _BSD_THIRD),
        ("mpl-2.0", COVER, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
        ("mpl-2.0", 1.0, "Mozilla Public License Version 2.0"),
        ("epl-2.0", 1.0, "Eclipse Public License v 2.0"),
        ("isc", COVER, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
        (
            "zlib", COVER,
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
            "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        ),
        ("unlicense", COVER, "This is free and unencumbered software released into the public domain."),
        ("unlicense", COVER, "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
        ("bsl-1.0", COVER, "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
        ("bsl-1.0", 1.0, "Boost Software License Version 1.0"),
        ("cc0-1.0", COVER, "CC0 1.0 Universal Public Domain Dedication"),
        ("gpl", COVER, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
        ("gpl", COVER, "You should have received a copy of the GNU General Public License along with this program. If not, see"),
    ]
    for kind, title in _GNU.items():
        if kind != "gpl":
            out.append((kind, 1.0, title))
        for v in _GNU_VERSIONS[kind]:
            out += [(f"{kind}-{v}.0" if "." not in v else f"{kind}-{v}", 1.0, f"{title} {wording}{v}") for wording in ("version ", "v")]
            tag = f"{kind.upper()}-{v if '.' in v else v + '.0'}"
            out += [(tag.lower(), 1.0, f"SPDX-License-Identifier: {tag}{x}") for x in ("", "-only", "-or-later")]
    for part, title in _CC.items():
        for v in ("3.0", "4.0"):
            where = "International" if v == "4.0" else "Unported"
            out += [
                (f"cc-{part}-{v}", 1.0, f"CC {part.upper()} {v}"),
                (f"cc-{part}-{v}", 1.0, f"Creative Commons {title} {v} {where} License"),
                (f"cc-{part}-{v}", 1.0, f"creativecommons.org/licenses/{part}/{v}"),
                (f"cc-{part}-{v}", 1.0, f"SPDX-License-Identifier: CC-{part.upper()}-{v}"),
            ]
    return out + [(x.lower(), 1.0, f"SPDX-License-Identifier: {x}") for x in _SPDX]


NOTICES = _notices()
