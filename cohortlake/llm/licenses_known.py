"""Licence texts and notices that the licence scan knows (fixed values, by SPDX identifier).

Long texts lie in license_texts, without their copyright lines.
"""

from pathlib import Path

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

TEXTS = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD
    + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
    + _BSD_TAIL,
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}

TEXTS |= {path.stem: path.read_text(encoding="utf-8") for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

#: Headings that the texts above lack and files often have.
_TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "The 3-Clause BSD License", "BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}
#: What may follow the terms, or is left out.
_APPENDICES = {"Apache-2.0": ["APPENDIX: How to apply", "END OF TERMS AND CONDITIONS"], "GPL-2.0": ["How to Apply These Terms", "END OF TERMS AND CONDITIONS"], "GPL-3.0": ["How to Apply These Terms", "END OF TERMS AND CONDITIONS"], "LGPL-2.1": ["How to Apply These Terms", "END OF TERMS AND CONDITIONS"]}

#: All forms of the whole texts.
VARIANTS = {
    name: [text, *(f"{title}\n\n{text}" for title in _TITLES.get(name, [])), *(text[: text.index(mark)] for mark in _APPENDICES.get(name, []))]
    for name, text in TEXTS.items()
}

#: Names by which lines call a licence, besides its identifiers.
_NAMES = {
    "AGPL-3.0": (["AGPL-3.0-only", "AGPL-3.0-or-later"], ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3 license"]),
    "Apache-2.0": (["Apache-2.0"], ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"]),
    "BSD-2-Clause": (["BSD-2-Clause"], ["BSD 2-Clause License", "Simplified BSD License"]),
    "BSD-3-Clause": (["BSD-3-Clause"], ["BSD 3-Clause License", "New BSD License"]),
    "CC-BY-4.0": (["CC-BY-4.0"], ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    "CC-BY-NC-4.0": (["CC-BY-NC-4.0"], ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    "CC-BY-SA-4.0": (["CC-BY-SA-4.0"], ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    "CC0-1.0": (["CC0-1.0"], ["CC0 1.0", "CC0 1.0 Universal License"]),
    "GPL-2.0": (["GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"], ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2 license"]),
    "GPL-3.0": (["GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"], ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3 license"]),
    "ISC": (["ISC"], ["ISC License"]),
    "LGPL-2.1": (["LGPL-2.1-only", "LGPL-2.1-or-later"], ["GNU Lesser General Public License, version 2.1"]),
    "LGPL-3.0": (["LGPL-3.0-only", "LGPL-3.0-or-later"], ["GNU Lesser General Public License, version 3"]),
    "MIT": (["MIT"], ["MIT License"]),
    "MPL-2.0": (["MPL-2.0"], ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"]),
    "Unlicense": (["Unlicense"], ["Unlicense"]),
    "Zlib": (["Zlib"], ["zlib License"]),
}
_WORDINGS = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", *(f"This {x} is {y} under {{}}." for x in ("work", "project", "software", "program", "file") for y in ("licensed", "released"))]

#: Lines that name a licence.
NOTICES = {
    name: [f"SPDX-License-Identifier: {x}" for x in ids]
    + [w.format(article + x) for w in _WORDINGS for x in names for article in ("the ", "") if "licen" in w.format(x).lower()]
    for name, (ids, names) in _NAMES.items()
}
