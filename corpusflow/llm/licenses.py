"""Licence scan by conditional compression.

Texts are looked at by paragraphs, the lines between blank ones, whose line breaks count
as spaces. At every place that names a licence, candidate blocks as long as each template (or as each part of
one with free words) are compressed alone and with the template as zstandard's raw dictionary, and all templates
are ranked by how much that saves. Winners are confirmed by wording, in the order of ranks: a template whose words stand
around the place one after the other is exact, whatever stands before and after; only its free words (years, holders) may
differ. Without such a one, a licence's name that stands there is told as its name only, or else
what the nearest of the best templates says differently, so "version 2" is never taken for version 3.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher
from itertools import accumulate, groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Names of the SPDX list and the usual short notices of these licences.
# "<...>" stands for any run of words.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0."],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0."],
    "LGPL-3.0-only": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0-only": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "ISC": ["Licensed under the ISC License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "Licensed under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "Proprietary": ["All rights reserved.", "Copyright <...> All rights reserved."],
}
# Paragraphs of whole licence texts and of the usual file headers.
PARAGRAPHS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    # what the licences of this family share; the third clause tells one of them
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": ["Neither the name of <...> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "GPL-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["This work is licensed under the Creative Commons Attribution 4.0 International License."],
}
# Names by which these licences are called in running text.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0", "Apache License, Version 2.0"],
    "GPL-3.0-only": ["GNU General Public License v3.0", "GPLv3", "GPL 3.0"],
    "GPL-2.0-only": ["GNU General Public License v2.0", "GPLv2", "GPL 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "Unlicense": ["the Unlicense"],
    "EPL-2.0": ["Eclipse Public License 2.0", "EPL 2.0"],
    "BSL-1.0": ["Boost Software License 1.0"],
    "CC0-1.0": ["CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
}
#: What makes a place a candidate, wrapped and in comments too.
TRIGGER = r"(?i)licen[cs]e|copyright|hereby\W+granted|compiled\W+binary|public\W+domain|all\W+rights\W+reserved|free\W+software|software\W+is\W+provided|in\W+source\W+and\W+binary|to\W+endorse\W+or\W+promote|freely,|\bspdx-"
_TRIGGER = re.compile(TRIGGER)
_WORD = re.compile(r"\w+(?:[.\-]\w+)*")
#: names that tell a family or no licence, which no SPDX line holds
_NO_SPDX = ("BSD", "Proprietary")
SCHEMA = "blocks long, licenses array<struct<license:string,line:int,saved:double,differences:array<string>,exact:boolean,rank:int>>"
KEPT = 1 << 14  # blocks whose answer a worker remembers
LEAST = 0.3  # of a block's compressed bytes that a template must save for its differences to be told
_LATER = re.compile(r"or (?:\S+ ){0,3}?(?:later|newer|greater|higher)\b")


def all_templates() -> dict[str, list[str]]:
    """Notices, paragraphs, and a line of the SPDX form for each licence."""
    names = list(dict.fromkeys([*TEMPLATES, *PARAGRAPHS]))
    return {n: [*TEMPLATES.get(n, []), *PARAGRAPHS.get(n, []), *([] if n in _NO_SPDX else [f"SPDX-License-Identifier: {n}"])] for n in names}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def differences(b: list[str], template: str) -> tuple[list[str], int, int]:
    """Wording of the template that the block's words lack ("-..."), put another way
    ("a>b") or add inside ("+..."), and the words of the block from and to which they agree.
    Words of the block before and after the template don't count."""
    out: list[str] = []
    t = words_of(template.replace("<...>", " zzfreezz "))
    ops = SequenceMatcher(None, t, b, autojunk=False).get_opcodes()
    same = [(k, m) for op, _, _, k, m in ops if op == "equal"] or [(0, len(b))]
    for op, i, j, k, m in ops:
        if op == "equal" or t[i:j] == ["zzfreezz"] or op == "insert" and (i == 0 or i == len(t)):
            continue
        if op == "replace" and i == 0:
            k = max(k, m - (j - i))
        elif op == "replace" and j == len(t):
            m = min(m, k + j - i)
        out.append({"replace": ">", "delete": "-", "insert": "+"}[op].join([" ".join(t[i:j]), " ".join(b[k:m])]))
    return out, same[0][0], same[-1][1]


class Scanner:
    """rows: templates, and behind them names. ``places`` counts what was ranked."""

    def __init__(self, templates: dict[str, list[str]] | None = None, level: int = 3, best: int = 3):
        self.rows = [(name, t) for name, ts in (templates or all_templates()).items() for t in ts]
        self.templates = len(self.rows)
        self.rows += [(name, t) for name, ts in ({} if templates else NAMES).items() for t in ts]
        self.parts = [[f" {' '.join(w)} " for x in t.split("<...>") if (w := words_of(x))] for _, t in self.rows]
        self.sizes = [len(words_of(t)) for _, t in self.rows]
        self.units = [(row, len(x.split()), x.strip()) for row, parts in enumerate(self.parts) for x in parts]
        self.best, self.known, self.places = best, {}, 0
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(x.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, _, x in self.units]

    def saved(self, block: str, unit: int) -> float:
        """The share of the block's compressed bytes that the template saves."""
        if (block, unit) not in self.known:
            data = block.encode("utf-8", "replace")
            if len(self.known) >= KEPT:
                self.known.clear()
            alone = self.known.get((block, -1)) or self.known.setdefault((block, -1), len(self.plain.compress(data)))
            self.known[block, unit] = (alone - len(self.given[unit].compress(data))) / alone
        return self.known[block, unit]

    def ranked(self, words: list[str], lo: int, hi: int, k: int) -> list[tuple[float, int, int, int]]:
        """(saved, row, from, to) of all templates that save anything in a block of the words around word k, the best first."""
        self.places += 1
        best: dict[int, tuple] = {}
        for unit, (row, n, _) in enumerate(self.units):
            n += 2
            a, b = max(lo, k - n + 1), min(hi, k + n)
            blocks = [(a, min(b, a + n)), *((i, i + n) for i in range(a + n // 2, b - n, n // 2)), (max(a, b - n), b)]
            score, i, j = max((self.saved(" ".join(words[i:j]), unit), -i, j) for i, j in blocks)
            if score > 0 and (row not in best or score > best[row][0]):
                n = self.sizes[row] + 2
                best[row] = (score, row, max(a, k - n + 1, -i - n // 2), min(hi, k + n, j + n // 2))
        return sorted(best.values(), key=lambda x: (-x[0], x[1]))

    def whole(self, joined: str, first: list[int], row: int, k: int) -> list[tuple[int, int]] | None:
        """The runs of words of the place around word k where all words of a template stand, those between its
        free words nearest together."""
        parts = self.parts[row]
        p = joined.find(parts[-1]) if parts else -1
        while p >= 0:
            at = [p]
            for part in parts[-2::-1]:
                at.append(joined.rfind(part, 0, at[-1] + 1))
                if at[-1] < 0:
                    break
            if at[-1] >= 0:
                runs = [(bisect_left(first, q), bisect_left(first, q + len(x) - 1)) for q, x in zip(at[::-1], parts, strict=True)]
                if any(a <= k < b for a, b in runs):
                    return runs
            p = joined.find(parts[-1], p + 1)
        return None

    def confirmed(self, words: list[str], joined: str, first: list[int], taken: bytearray, ranked: list, k: int) -> tuple | None:
        """(rank, row, saved, runs, differences) of what is told at word k: the longest template that stands there
        whole, else a name, else the nearest template of the best ones that save LEAST."""
        names, exact = [], []
        spelt = joined.replace(" licence", " license").replace("unlicence", "unlicense")
        for rank, (score, row, _, _) in enumerate(ranked, 1):
            name = row >= self.templates
            if name:
                around = [runs for i in range(max(0, k - 6), min(len(words), k + 7)) if (runs := self.whole(spelt, first, row, i))][:1]
            else:
                around = [runs] if (runs := self.whole(joined, first, row, k)) else []
            for runs in around:
                if not any(1 in taken[a:b] for a, b in runs):
                    (names if name else exact).append((-self.sizes[row], rank, row, score, runs))
        if exact:
            _, rank, row, score, runs = min(exact)
            return rank, row, score, runs, []
        told = []
        for rank, (score, row, a, b) in enumerate(ranked, 1):
            if row < self.templates and score >= LEAST and len(told) < self.best:
                diff, i, j = differences(words[a:b], self.rows[row][1])
                told.append((sum(len(x.split()) for x in diff) / self.sizes[row], len(diff), rank, row, score, [(a + i, a + j)], diff))
        near = min(told) if told else None
        if names and (near is None or near[0] > 0.25):
            _, rank, row, score, runs = min(names)
            return rank, row, score, runs, ["name only"]
        return near and near[2:]

    def paragraph(self, text: str) -> tuple[int, list[tuple[int, dict]]]:
        """The number of candidate blocks, and the place and licence of each one found."""
        triggers = [m.start() for m in _TRIGGER.finditer(text)]
        if not triggers:
            return 0, []
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        joined = f" {' '.join(words)} "
        first = [0, *accumulate(len(w) + 1 for w in words)]  # the space before each word
        found, blocks, taken = [], 0, bytearray(len(words))
        reach = max(self.sizes, default=0) + 2
        ends = [b for _, b in spans]
        for at in triggers:
            k = bisect_right(ends, at)
            if k == len(words) or taken[k]:
                continue
            blocks += 1
            lo = taken.rfind(1, max(0, k - reach), k) + 1 or max(0, k - reach)
            hi = taken.find(1, k, k + reach)
            hi = hi if hi >= 0 else min(len(words), k + reach)
            got = self.confirmed(words, joined, first, taken, self.ranked(words, lo, hi, k), k)
            if not got:
                continue
            rank, row, saved, runs, diff = got
            start, last = runs[0][0], runs[-1][1]
            for a, b in runs:
                taken[a:b] = b"\1" * (b - a)
            if not diff:  # words about the sentence that turn its sense
                if start and words[start - 1] in ("not", "never", "longer"):
                    diff.append(f"+{words[start - 1]}")
                if m := _LATER.match(" ".join(words[last : last + 5])):
                    diff.append(f"+{m[0]}")
                elif text[spans[last - 1][1] : spans[last - 1][1] + 1] == "+":
                    diff.append("++")
            found.append((spans[min(start, len(spans) - 1)][0], {"license": self.rows[row][0], "saved": round(saved, 6), "differences": diff, "exact": not diff, "rank": rank}))
        return blocks, sorted(found, key=lambda x: x[0])

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """The number of candidate blocks, and each licence found with its line."""
        found, blocks, line = [], 0, 0
        for blank, lines in groupby((text or "").split("\n"), key=lambda x: not x.strip()):
            part = list(lines)
            if not blank:
                n, got = self.paragraph("\n".join(part))
                blocks += n
                ends = list(accumulate(len(x) + 1 for x in part)) if got else []
                found += [{"line": line + bisect_right(ends, at), **x} for at, x in got]
            line += len(part)
        return blocks, found


def license_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, blocks, licenses): one row a document; licenses has each licence found, the
    line it is on (from 0), the share of bytes saved, the wording that differs and
    whether it is exact, in the order of lines.

    Null and empty texts have no blocks. Lines and paragraphs of any length are looked at whole,
    wherever they are in a text of any length; texts without a trigger stay in the JVM. Equal texts
    get equal answers, and a repeated row is answered again. All templates that save anything are confirmed by their whole
    wording, and of those that stand the longest is told; ties between templates go to the one
    that saves more, then to the first. At a place where none stands whole, a name counts if it stands within six
    words; else the three templates that save most (Scanner's ``best``) and ``LEAST`` or more are compared by words.
    An empty table gives no rows; other columns of docs are not looked at.
    """

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            got = [scanner.scan(x.as_py()) for x in batch.column(1)]
            kind = pa.list_(pa.struct([("license", pa.string()), ("line", pa.int32()), ("saved", pa.float64()), ("differences", pa.list_(pa.string())), ("exact", pa.bool_()), ("rank", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], kind)], ["key", "blocks", "licenses"])

    common.ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.when(F.col(text).rlike(TRIGGER), F.col(text)).alias("text"))
    return rows.mapInArrow(run, f"key long, {SCHEMA}").withColumnRenamed("key", key)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its confirmed licences, and those that only nearly match."""
    found = license_scan(common.table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id", "blocks",
        "array_join(array_sort(array_distinct(transform(filter(licenses, x -> x.exact), x -> x.license))), ',') as confirmed",
        "cast(size(filter(licenses, x -> not x.exact)) as bigint) as n_inexact",
        "to_json(licenses) as detail",
    )


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLE: dict[str, str] = {}
