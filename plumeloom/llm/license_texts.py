"""Wordings of licenses: header lines, notices, titles, whole short texts and SPDX lines.

Fixed values. A license has several wordings; a text is compared with each of them.
"""

from __future__ import annotations

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""

_GNU_TITLE = """GNU {name} GENERAL PUBLIC LICENSE Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

_LINES = (
    ("AGPL-3.0", "licensed under the GNU Affero General Public License version 3"),
    ("All-Rights-Reserved", "all rights reserved"),
    ("Apache-2.0", "licensed under the Apache License version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", "released under the BSD 2 clause license"),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_END}"),
    ("BSD-3-Clause", "released under the BSD 3 clause license"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_3} {_BSD_END}"),
    ("CC-BY-4.0", "licensed under CC BY 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "released under CC0 1.0 public domain dedication"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "this work is licensed under the GNU General Public License version 2"),
    ("GPL-2.0", _GNU_NOTICE.format(name="", version="2")),
    ("GPL-2.0", _GNU_TITLE.format(name="", version="2", date="June 1991", year="1989, 1991")),
    ("GPL-3.0", "this work is licensed under the GNU General Public License version 3"),
    ("GPL-3.0", _GNU_NOTICE.format(name="", version="3")),
    ("GPL-3.0", _GNU_TITLE.format(name="", version="3", date="29 June 2007", year="2007")),
    ("AGPL-3.0", _GNU_NOTICE.format(name="Affero", version="3")),
    ("AGPL-3.0", _GNU_TITLE.format(name="AFFERO", version="3", date="19 November 2007", year="2007")),
    ("ISC", "released under the ISC license"),
    ("ISC", _ISC),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License version 3"),
    ("LGPL-3.0", _GNU_NOTICE.format(name="Lesser", version="3")),
    ("LGPL-3.0", _GNU_TITLE.format(name="LESSER", version="3", date="29 June 2007", year="2007")),
    ("MIT", "released under the MIT license"),
    ("MIT", _MIT),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License version 2.0"),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
)

#: SPDX names a license by one word after this one.
SPDX = "SPDX-License-Identifier"
_NAMES = sorted({name for name, _ in _LINES} - {"All-Rights-Reserved"})

#: (license, wording).
TEMPLATES = _LINES + tuple((name, f"{SPDX}: {name}") for name in _NAMES)
