"""Public licence notices and short statements, as (licence, text)."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_NO_ENDORSEMENT = """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""

_NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("EPL-1.0", "Made available under the terms of the Eclipse Public License v1.0."),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License v2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSD-3-Clause", _BSD + _NO_ENDORSEMENT),
    ("BSD-4-Clause", _BSD + """ All advertising materials mentioning features or use of this software must display the following acknowledgement: This
product includes software developed by the copyright holder.""" + _NO_ENDORSEMENT),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "This work is licensed under a Creative Commons CC0 1.0 Universal License."),
)


def _gnu() -> tuple[tuple[str, str], ...]:
    out = []
    for short, name, kind, versions in (
        ("GPL", "General", "program", ("1", "2", "3")), ("LGPL", "Lesser General", "library", ("2.1", "3")),
        ("LGPL", "Library General", "library", ("2",)), ("AGPL", "Affero General", "program", ("3",)),
    ):
        for v in versions:
            licence = f"{short}-{v}" + (".0" if "." not in v else "")
            out += [
                (licence, f"This work is licensed under the GNU {name} Public License, version {v}."),
                (licence, f"Licensed under the GNU {name} Public License, version {v}."),
                (licence, f"Licensed under the {short}v{v}."),
                (licence, f"Licensed under the GNU {short}v{v}."),
                (licence, f"Licensed under the {short} {v}."),
                (licence, f"Licensed under the GNU {short}, version {v}."),
                (licence, f"""This {kind} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as
published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This {kind} is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU {name} Public License for more details."""),
            ]
    return tuple(out)


def _creative_commons() -> tuple[tuple[str, str], ...]:
    out, long = [], {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            names = "-".join(long[k] for k in kind.split("-"))
            spelled = {names, names.replace("NonCommercial", "Non-Commercial"), names.replace("ShareAlike", "Share-Alike"), names.replace("NoDerivatives", "NoDerivs")}
            out.append((f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}."))
            out += [(f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {n} {v} International License.") for n in sorted(spelled)]
    return tuple(out)


TEMPLATES = tuple(dict.fromkeys((*_NOTICES, *_gnu(), *_creative_commons(), *(
    (name, f"Licensed under the {told} License.") for name, told in (
        ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("BSD-4-Clause", "BSD 4-Clause"), ("ISC", "ISC"), ("MIT-0", "MIT-0"), ("Zlib", "zlib")
    )
))))
_SPDX = tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in TEMPLATES) if name != "proprietary")
TEMPLATES += _SPDX

#: Words that tell one licence from another, besides numbers: a run of naming words with one of these may not be broken.
CORE = frozenset(
    """mit apache gnu lesser affero gpl lgpl agpl gplv1 gplv2 gplv3 lgplv2 lgplv3 agplv3 mozilla mpl eclipse epl boost bsl bsd 0bsd isc zlib unlicense
    cc cc0 nc sa nd creative attribution noncommercial sharealike noderivatives noderivs""".split()
)
#: Words that belong to such a run where they stand beside its words.
NAMING = CORE | frozenset("general library public by commons non commercial share alike clause".split())
#: Words that may stand inside a run.
FILL = frozenset("license licence version v software international unported generic universal the".split())
