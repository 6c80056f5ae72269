"""License notices by conditional compression.

A text with a candidate block, a run of lines that look like a notice, is
searched as a whole, as notices begin and go on in lines and paragraphs that
don't.  Where it shares a run of words with a template, the window that the
template would fill is compressed with zstandard alone and once more with the template as raw-content
dictionary; the bytes saved rank the templates, however much text stands beside
the notice.  A template is confirmed only by wording: its words are aligned with
the window's, and the differences must be few and leave the license's name and
version alone.  The best-ranked template that is confirmed takes its words out of
the text, and the others go on with what is left: a text yields all its notices.

Short notices ("SPDX-License-Identifier: MIT", "released under the GPLv3") are
names of licenses in frames, too short to differ: of what the templates left they
are taken word by word, with one dictionary of all wordings a license.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _kernel
from palimpsest.llm._scratch import small_batches

#: Names and wordings of notices.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Full wordings.
TEMPLATES |= {
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause-text": _BSD + _BSD_NAMES + _BSD_END,
    "MIT-full-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
#: The notice of the GNU licenses, and its first paragraph alone: the wording is theirs, the name and version differ.
for _name, _what, _which, _version in (
    ("AGPL-3.0", "program", "Affero General", "3"),
    ("GPL-2.0", "program", "General", "2"),
    ("GPL-3.0", "program", "General", "3"),
    ("LGPL-2.0", "library", "Library General", "2"),
    ("LGPL-2.1", "library", "Lesser General", "2.1"),
    ("LGPL-3.0", "library", "Lesser General", "3"),
):
    TEMPLATES[f"{_name}-opening"] = f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the GNU {_which} Public License as published by the Free Software Foundation, either version {_version} of the License, or (at your option) any later version."
    TEMPLATES[f"{_name}-notice"] = f"{TEMPLATES[f'{_name}-opening']} This {_what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {_which} Public License for more details. You should have received a copy of the GNU {_which} Public License along with this {_what}. If not, see <https://www.gnu.org/licenses/>."
#: Identifiers and names of licenses, as short notices have them.
NAMES = {
    "MIT": ("MIT", ["MIT License", "MIT Licence", "Expat License", "X11 License"]),
    "Apache-2.0": ("Apache-2.0", ["Apache License 2.0", "Apache License v2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache License version 2", "Apache Software License 2.0"]),
    "BSD-2-Clause": ("BSD-2-Clause", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"]),
    "BSD-3-Clause": ("BSD-3-Clause", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"]),
    "ISC": ("ISC", ["ISC License"]),
    "MPL-2.0": ("MPL-2.0", ["Mozilla Public License 2.0", "Mozilla Public License v2.0", "Mozilla Public License, version 2.0", "MPL 2.0"]),
    "EPL-1.0": ("EPL-1.0", ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License - v 1.0", "Eclipse Public License, Version 1.0"]),
    "EPL-2.0": ("EPL-2.0", ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License v. 2.0", "Eclipse Public License - v 2.0", "Eclipse Public License, Version 2.0"]),
    "Unlicense": ("Unlicense", ["The Unlicense"]),
    "BSL-1.0": ("BSL-1.0", ["Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost Software License - Version 1.0"]),
    "Zlib": ("Zlib", ["zlib License", "zlib/libpng License"]),
    "CC0-1.0": ("CC0-1.0", ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"]),
}
for _id, _short, _long in (("GPL", "GPL", "General"), ("LGPL", "LGPL", "Lesser General"), ("AGPL", "AGPL", "Affero General")):
    for _v in {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}[_id]:
        _full = _v if "." in _v else f"{_v}.0"
        _as = [f"{g}{_short}{v}" for g in ("", "GNU ") for v in (f"v{_v}", f" v{_v}", f" {_v}", f"-{_full}", f" {_full}", f" version {_v}", f"v{_full}")]
        _as += [f"GNU {_long} Public License{v}" for v in (f" v{_v}", f" v{_full}", f", version {_v}", f" version {_full}", f" {_v}", f" {_full}")]
        NAMES[f"{_id}-{_full}"] = (f"{_id}-{_full}", list(dict.fromkeys(_as)))
for _id, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v in ("3.0", "4.0"):
        NAMES[f"CC-{_id}-{_v}"] = (f"CC-{_id}-{_v}", [f"CC {_id} {_v}", f"CC-{_id} {_v}", f"Creative Commons {_long} {_v}", f"a Creative Commons {_long} {_v} International License", f"a Creative Commons {_long} {_v} Unported License", f"a Creative Commons {_long} {_v} License"])
#: What stands around a name ({}) or identifier ([]) in a short notice.
FRAMES = ("SPDX-License-Identifier: []", "SPDX-License-Identifier: []-only", "SPDX-License-Identifier: []-or-later", "licensed under the {}", "licensed under {}", "released under the {}", "released under {}", "distributed under the {}", "available under the {}", "published under the {}", "provided under the {}", "covered by the {}", "under the terms of the {}", "terms of the {}", "license: []", "license: {}", "the {} (see", "{} Copyright (c)", "{} license", "licensed under the [] license", "licensed under [] license", "licensed under []", "licence: []", "[] licensed")


_WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")


def words(text: str) -> list[str]:
    """What wording is compared by: lower-cased words with the dots and hyphens inside them."""
    return _WORD.findall(text.lower())


def phrases(names: dict[str, tuple[str, list[str]]] = NAMES) -> dict[str, list[list[str]]]:
    """Words of the short notices of each license, all in frames; those that are a full template already are left out."""
    known = {tuple(words(t)) for t in TEMPLATES.values()}
    out = {}
    for license_, (identifier, called) in names.items():
        made = [frame.replace("[]", identifier) if "[]" in frame else frame.replace("{}", name) for frame in FRAMES for name in (called if "{}" in frame else called[:1])]
        out[license_] = [list(w) for w in dict.fromkeys(tuple(words(m)) for m in made) if w not in known and len(w) > 1]
    return out


#: What a line of a notice contains, in lower case.
CUES = (b"licens", b"licence", b"copyright", b"rights reserved", b"permission", b"public domain", b"warrant", b"creative commons", b"mozilla public", b"redistribution")
LEVEL, MOST_DIFFERENCES = 6, 0.1
#: Words that tell licenses apart, and words whose follower does (a version, if it has a digit).
TELLING, BEFORE_NAME, BEFORE_VERSION = {"gnu", "affero", "lesser"}, {"gnu", "affero", "lesser"}, {"version", "v"}

def aligned(want: list[str], have: list[str | None]) -> list[tuple[int, int]]:
    """Pairs of equal words in the alignment with the fewest differences of ``want`` with any part of ``have``."""
    rows = [[0] * (len(have) + 1)]
    for i, w in enumerate(want):
        above, row = rows[-1], [i + 1]
        for j, h in enumerate(have):
            row.append(above[j] if w == h else 1 + min(above[j + 1], row[j]))
        rows.append(row)
    i, j, out = len(want), rows[-1].index(min(rows[-1])), []
    while i and j:
        if want[i - 1] == have[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i - 1][j] < rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def differences(want: list[str], have: list[str], pairs: list[tuple[int, int]]) -> list[str] | None:
    """Words missing (-) and put in (+) between the first and the last pair; None if they change which license it is."""
    decides = lambda i: i > 0 and (want[i - 1] in BEFORE_NAME or want[i - 1] in BEFORE_VERSION and any(map(str.isdigit, want[i])))
    out, a, c = [], 0, pairs[0][1] if pairs else 0
    for b, d in [*pairs, (len(want), pairs[-1][1] + 1 if pairs else 0)]:
        if any(want[i] in TELLING or decides(i) for i in range(a, b)) or (c < d and b < len(want) and decides(b)):
            return None
        out += [f"-{w}" for w in want[a:b]] + [f"+{w}" for w in have[c:d]]
        a, c = b + 1, d + 1
    return out


class Notice(NamedTuple):
    """A confirmed template (``<license>-phrase`` for the short notices of a license): its saving as a share of what a copy saves, and the place of its first word in the text."""

    template: str
    saving: float
    differences: tuple[str, ...]
    place: int


class Matcher:
    """Compressors for all templates, and savings on windows seen before (notices repeat)."""

    REMEMBERED = 4096

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        import zstandard

        self.words = {name: words(text) for name, text in templates.items()}
        self.most = {name: int(MOST_DIFFERENCES * len(w)) for name, w in self.words.items()}
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        raw = lambda text: zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.by_name = {name: zstandard.ZstdCompressor(level=LEVEL, dict_data=raw(text)) for name, text in templates.items()}
        self.vocabulary = {w for ws in self.words.values() for w in ws}
        self.known: dict[tuple[str, str], int] = {}
        self.copy = {name: self.saved(name, text) for name, text in templates.items()}
        # short notices: one dictionary a license, all of its wordings; each is only taken word by word
        for license_, wordings in phrases().items() if templates is TEMPLATES else ():
            self.by_name[f"{license_}-phrase"] = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw("\n".join(map(" ".join, wordings))))
            for i, w in enumerate(wordings):
                name = f"{license_}-phrase#{i}"
                self.words[name], self.most[name] = w, 0
                self.copy[name] = self.saved(name, " ".join(w))
        # A template cut into one piece more than the differences it may have keeps a piece unharmed.
        self.pieces: dict[tuple, list[tuple[str, int, list[str]]]] = {}
        for name, ws in self.words.items():
            cuts = [len(ws) * n // (self.most[name] + 1) for n in range(self.most[name] + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                self.pieces.setdefault(tuple(ws[lo : lo + 2]), []).append((name, lo, ws[lo:hi]))

    def saved(self, name: str, window: str) -> int:
        """Bytes that a template saves on a window."""
        key = name, window
        if key not in self.known:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            raw = window.encode()
            self.known[key] = len(self.alone.compress(raw)) - len(self.by_name[name.partition("#")[0]].compress(raw))
        return self.known[key]

    def ranked(self, text: str, have: list[str], spans: list[tuple[int, int]]) -> list[tuple[int, str, int]]:
        """(bytes saved, template, first word of the window) wherever a template may fit, best first; ties go to the longer one, and short notices come after full templates."""
        at = {(name, i - lo) for i in range(len(have) - 1) for name, lo, piece in self.pieces.get((have[i], have[i + 1]), ()) if have[i : i + len(piece)] == piece}
        out = []
        for name, first in at:
            lo, hi = self.window(name, first, len(have))
            out.append((self.saved(name, text[spans[lo][0] : spans[hi - 1][1]]), name, first))
        return sorted(out, key=lambda x: ("#" in x[1], -x[0], -len(self.words[x[1]]), x[1:]))

    def window(self, name: str, first: int, n: int) -> tuple[int, int]:
        """First and end word of where a template lies that begins near ``first``."""
        return max(0, first - self.most[name]), min(n, first + len(self.words[name]) + self.most[name])

    def fitted(self, name: str, first: int, free: list[str | None]) -> list[tuple[int, int]]:
        """The alignment of a template with the window near ``first``; none if the window lacks too many of its words."""
        want = self.words[name]
        if first >= 0 and free[first : first + len(want)] == want:
            return [(i, first + i) for i in range(len(want))]
        lo, hi = self.window(name, first, len(free))
        lacking = Counter(want) - Counter(free[lo:hi])
        return [] if sum(lacking.values()) > self.most[name] else [(i, lo + j) for i, j in aligned(want, free[lo:hi])]

    def notices(self, text: str) -> list[Notice]:
        """All notices of a text in their order.  Words that one is aligned with are no part of another."""
        have, spans = [], []
        for m in _WORD.finditer(text):
            have.append(sys.intern(m.group().lower()))
            spans.append(m.span())
        free: list[str | None] = list(have)  # None: taken
        out = []
        for saved, name, first in self.ranked(text, have, spans):
            pairs = self.fitted(name, first, free)
            if pairs:  # a phrase that comes twice may have put the window beside the notice
                pairs = max(pairs, self.fitted(name, pairs[0][1] - pairs[0][0], free), key=len)
            found = differences(self.words[name], have, pairs)
            if found is not None and len(found) <= self.most[name]:
                out.append(Notice(name.partition("#")[0], saved / max(self.copy[name], 1), tuple(found), spans[pairs[0][1]][0]))
                for _, j in pairs:
                    free[j] = None
        return sorted(out, key=lambda x: x.place)

    def identify(self, text: str) -> Notice | None:
        """The notice that saves the most of those in a text."""
        return max(self.notices(text), key=lambda x: x.saving * self.copy.get(x.template, 1), default=None)

    def blocks(self, text: str) -> list[tuple[int, str]]:
        """(first line, text) of the candidate blocks: runs of lines with a cue, or all of whose words are a template's."""
        lines, out, now = text.split("\n"), [], []
        for i, line in enumerate([*lines, ""]):
            low = line.lower().encode()
            if any(c in low for c in CUES) or (now and line.strip() and set(words(line)) <= self.vocabulary):
                now.append(line)
            elif now:
                out.append((i - len(now), "\n".join(now)))
                now = []
        return out


_FOUND = pa.list_(pa.struct([("line", pa.int64()), ("template", pa.string()), ("saving", pa.float64()), ("differences", pa.list_(pa.string()))]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lower, matcher = _kernel.lookup("lower"), Matcher()
    for batch in batches:
        n, found = [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
        for lo, hi, raw, offsets in _kernel.steps(batch.column(1)):
            low = lower[raw].tobytes()
            hits = set()
            for cue in CUES:
                at = low.find(cue)
                while at >= 0:
                    hits.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                    at = low.find(cue, at + 1)
            for d in sorted(hits):
                text = raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")
                n[lo + d], line, at = len(matcher.blocks(text)), 0, 0
                for got in matcher.notices(text):
                    line, at = line + text.count("\n", at, got.place), got.place
                    found[lo + d].append({"line": line, "template": got.template, "saving": got.saving, "differences": list(got.differences)})
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, _FOUND)], names=["id", "n_blocks", "notices"])


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_blocks`` (runs of lines that look like a notice; a text with none is not searched) and ``notices`` (line from 0, template, saving, differences) of every row.

    Null and empty texts have no candidates; repeated rows give equal rows.
    """
    small_batches(documents.sparkSession)
    schema = "id long, n_blocks long, notices array<struct<line: long, template: string, saving: double, differences: array<string>>>"
    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Every document with the licenses that its notices name."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["template"]))), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_blocks", F.size("notices").cast("long").alias("n_notices"), names.alias("licenses"), F.expr("aggregate(notices, 0L, (s, x) -> s + size(x.differences))").alias("n_differences")
    )
