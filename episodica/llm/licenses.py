"""License scans (9): a positional index of the rarest words of licence texts.

Words: runs of digits, ASCII letters (lower-cased) and non-ASCII characters.  Each template's highest-IDF words are indexed with their
positions.  A text's indexed words vote for (template, text position - template position); a template whose votes reach
SHARE of its weight within a drift of a few words is a candidate, and is reported when its mandatory phrases stand within the
place it would take.  The base rule reports three short phrases wherever they stand.

Defined results: a null, empty or wordless text has no words, no places and no labels and scores 0; ties between templates report
all of them; repeated rows each get their own result row; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, by_batch, chunks, word_hash

#: Label, words that stand consecutively.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Label, a licence's notice, opening words or text, phrases that must stand in it.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("free of charge", "without restriction")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license", "in compliance with the license")),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("general public license", "free software foundation")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee", "hereby granted")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0", ("cc by nc nd 4 0",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("free of charge", "without restriction", "substantial portions of the software",)),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", ("source and binary forms", "following disclaimer", "advised of the possibility of such damage",)),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", ("source and binary forms", "endorse or promote products", "advised of the possibility of such damage",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ("with or without fee", "notice appear in all copies", "tortious action",)),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ("fee is hereby granted the software is provided", "tortious action",)),
    ("zlib", "This software is provided \"as-is\", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ("must not be misrepresented", "altered from any source distribution",)),
    ("boost", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.", ("boost software license", "machine executable object code",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.", ("unencumbered software", "relinquishment in perpetuity",)),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache license", "specific language governing permissions",)),
    ("apache", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.", ("grant of copyright license", "prepare derivative works of",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.", ("general public license", "in the hope that it will be useful",)),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.", ("free copyleft license", "guarantee your freedom",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla public license", "copy of the mpl was not distributed",)),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", ("verbatim or modified copies", "as long as the name is changed",)),
)
#: Indexed words of a template, drift of positions in words, share of a template's weight that must vote.
RARE, DRIFT, SHARE = 12, 8, 0.6


def tokens(texts: list[str]) -> Words:
    # ASCII letters only: lower-casing bytes leaves those of other characters alone
    return Words([t.encode().lower() for t in texts], ALNUM)


@cache
def _index() -> tuple:
    texts = [tokens([t]).hash for _, t, _ in TEMPLATES]
    frequency = Counter(h for x in texts for h in set(x.tolist()))
    idf = {h: math.log1p((len(texts) - f + 0.5) / (f + 0.5)) for h, f in frequency.items()}
    rows = []
    for k, own in enumerate(texts):
        first: dict[int, int] = {}
        for p, h in enumerate(own.tolist()):
            first.setdefault(h, p)
        for h in sorted(first, key=lambda h: (-idf[h], first[h]))[:RARE]:
            rows.append((h, k, first[h], idf[h]))
    rows.sort()
    h = np.array([r[0] for r in rows], np.uint64)
    template, at, weight = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    phrases = [[np.array([word_hash(w) for w in p.split()], np.uint64) for p in x] for _, _, x in TEMPLATES]
    base = [(label, np.array([word_hash(w) for w in p.split()], np.uint64)) for label, p in BASE]
    return h, template, at, weight, np.bincount(template, weight), [len(x) for x in texts], phrases, base


def places(words: Words, phrase: np.ndarray) -> np.ndarray:
    """First words of all places of a phrase."""
    if len(words.hash) < len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words.hash[: len(words.hash) - len(phrase) + 1] == phrase[0])
    for k, h in enumerate(phrase[1:], 1):
        at = at[words.hash[at + k] == h]
    return at[words.doc[at] == words.doc[at + len(phrase) - 1]]


def candidates(words: Words) -> list[tuple[int, int, int, float]]:
    """(document, template, first word, share of the weight) of templates that are voted for."""
    h, template, at, weight, total, _, _, _ = _index()
    lo, hi = np.searchsorted(h, words.hash, "left"), np.searchsorted(h, words.hash, "right")
    seen = np.flatnonzero(hi > lo)
    if not len(seen):
        return []
    many = (hi - lo)[seen]
    row = np.repeat(lo[seen], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    where = np.repeat(seen, many)
    # a place before the text's start is none before its document's; two grids of drift, so that near votes meet in one
    origin = where - words.first[words.doc[where]] - at[row] + (1 << 20)
    key_doc, key_t = words.doc[where], template[row]
    best: dict[tuple[int, int, int], float] = {}
    for shift in (0, DRIFT // 2):
        cell = (origin + shift) // DRIFT
        key = np.stack((key_doc, key_t, cell, at[row]))
        order = np.lexsort(key[::-1])
        key, w = key[:, order], weight[row][order]
        fresh = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))  # a template word votes once
        key, w = key[:, fresh], w[fresh]
        new = np.flatnonzero(np.concatenate(([True], (key[:3, 1:] != key[:3, :-1]).any(axis=0))))
        share = np.add.reduceat(w, new) / total[key[1, new]]
        for k in np.flatnonzero(share >= SHARE - 1e-9):
            d, t, c = key[:3, new[k]].tolist()
            place = max(0, c * DRIFT - shift - (1 << 20))
            best[d, t, place] = max(best.get((d, t, place), 0.0), float(min(share[k], 1.0)))
    return [(*k, v) for k, v in sorted(best.items())]


def scan_texts(texts: list[str]) -> pd.DataFrame:
    words = tokens(texts)
    _, _, _, _, _, sizes, phrases, base = _index()
    n = len(texts)
    count, first, last, score = np.zeros(n, np.int64), np.full(n, 1 << 60), np.full(n, -1), np.zeros(n)
    by_rule: list[set] = [set() for _ in range(n)]
    for label, phrase in base:
        at = places(words, phrase)
        doc = words.doc[at]
        at = at - words.first[doc]
        np.add.at(count, doc, 1)
        np.minimum.at(first, doc, at)
        np.maximum.at(last, doc, at)
        for d in np.unique(doc).tolist():
            by_rule[d].add(label)
            score[d] = 1.0
    labels = [set(x) for x in by_rule]
    found = candidates(words)
    held = {t: [places(words, p) for p in phrases[t]] for t in {t for _, t, _, _ in found}}
    for d, t, place, share in found:
        lo, hi = words.first[d] + place - DRIFT, words.first[d] + place + sizes[t] + 2 * DRIFT
        if all(((words.doc[x] == d) & (x >= lo) & (x < hi)).any() for x in held[t]):
            labels[d].add(TEMPLATES[t][0])
            score[d] = max(score[d], share)
    some = count > 0
    return pd.DataFrame({
        "n_words": words.count, "n_base": count,
        "first_word": pd.array(np.where(some, first, 0), "Int64"), "last_word": pd.array(np.where(some, last, 0), "Int64"),
        "base_labels": [",".join(sorted(x)) for x in by_rule], "labels": [",".join(sorted(x)) for x in labels], "score": score,
    }).assign(first_word=lambda x: x["first_word"].where(some), last_word=lambda x: x["last_word"].where(some))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start, texts in chunks(frame["text"]):
                got = scan_texts(texts)
                got.insert(0, "doc_id", frame["doc_id"].iloc[start : start + len(texts)].array)
                yield got

    return by_batch(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, SCHEMA)
