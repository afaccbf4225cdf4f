"""License scans by MinHash over text windows (operator 3).

Words are runs of ASCII letters and digits and of other non-ASCII characters,
folded to lower case; a shingle is five of them, or a template's whole word sequence
where that is shorter.  Templates are grouped by their shingles' length and by their
own: a class holds those of 2^c to 2^(c+1) - 1 shingles.  For each class a text
is cut into windows of 2^(c+2) shingles that overlap by half, so every passage as
long as a template of the class lies in one window.  A window gets a MinHash
signature of `BANDS` bands of one row; the minima of longer windows are the minima
of shorter ones side by side, so `BLOCK` shingles at a time, few enough for a core's
cache, are hashed by all bands and halved level by level.  A window and a template
that share a band's value meet.  A window that holds 80 % of a template's shingles has
a Jaccard similarity of at least 0.8 * 2^c / (2^(c+2) + 0.2 * 2^c) = 0.19, so it is
missed with a probability of at most 0.81^96 < 2e-9.  Each meeting is then verified:
the share of the template's shingles that the window holds, word by word, must be at
least ``threshold``.

Edge cases: null and empty texts, and texts shorter than all shingles, match nothing;
very long texts are scanned `PIECE` shingles at a time, with all their windows;
repeated rows match alike; a template without a word raises an error; an empty
table gives an empty table; repeated licenses of a text are one row; extra columns,
of any name, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import bounded_batches, slices, utf8
from vellum.llm.simhash import word_chunks

SHINGLE = 5
BANDS = 96
THRESHOLD = 0.8
PIECE = 1 << 15  # shingles of a text that are scanned together; whole windows all the same
BLOCK = 1 << 11  # shingles whose minima are held at once, about
U8 = np.uint64
#: Upper limit of all templates' bytes: they travel with the job to every worker.
TEMPLATE_BYTES = 16 << 20

# Public license notices and texts, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."),
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software."),
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies."),
    "BSD-2-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution."),
    "BSD-3-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither "
        "the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."),
    "GPL-2.0 notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "LGPL-2.1 notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
        "the License, or (at your option) any later version. This library is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    "AGPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All rights reserved": "All rights reserved.",
    "CC-BY-SA-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
}
#: ASCII signs part words; letters are folded.
FOLD = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 if i < 128 else i for i in range(256))
SCHEMA = "license string, containment double, first_word long, n_words long, windows long"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def pieces(raw: bytes, step: int, more: int):
    """(first word, words, is last) of runs of ``step`` shingles and ``more`` that
    follow."""
    held, at = [], 0
    for chunk in word_chunks(raw.translate(FOLD)):
        held += chunk
        while len(held) > step + more + SHINGLE - 1:
            yield at, held[:step + more + SHINGLE - 1], False
            held, at = held[step:], at + step
    yield at, held, True


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit hash of each run of ``size`` words."""
    return run_hashes(word_hashes(words), size)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), U8, len(words))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, U8)
    out = np.zeros(n, U8)
    for i in range(size):
        out = (out ^ h[i:i + n]) * U8(0x9E3779B97F4A7C15)
        out ^= out >> U8(29)
    return out


def multipliers() -> np.ndarray:
    """Odd 32-bit factors of the bands' hash functions."""
    return np.random.default_rng(11).integers(1 << 28, 1 << 31, BANDS, dtype=np.uint32) * 2 + 1


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum of each band's 32-bit hash function."""
    low, high = hashes.astype(np.uint32), (hashes >> U8(32)).astype(np.uint32)
    return ((low[:, None] * factors[None]) ^ high[:, None]).min(axis=0)


def level_of(n_shingles: int) -> int:
    return n_shingles.bit_length() - 1


def shingle_size(words: list) -> int:
    """Words of a template's shingles."""
    return min(SHINGLE, len(words))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold, self.factors = threshold, multipliers()
        self.sets: dict[str, set] = {}
        #: shingle length -> level -> (name, signature) of its templates
        self.classes: dict[int, dict[int, list]] = {}
        for name, text in templates.items():
            w = words_of(text.encode())
            if not w:
                raise ValueError(f"template {name} has no words")
            size = shingle_size(w)
            self.sets[name] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
            self.classes.setdefault(size, {}).setdefault(level_of(len(self.sets[name])), []).append(
                (name, signature(shingle_hashes(w, size), self.factors)))
        self.top = max(level for levels in self.classes.values() for level in levels)

    def meetings(self, pieces: list[np.ndarray], inner: np.ndarray, levels: dict[int, list]):
        """(level, template, piece, first shingle) of the windows that share a band with
        a template, over pieces' shingles.  ``inner`` tells that a text has shingles
        before the piece."""
        top = max(levels)
        unit = 2 << top  # a half of the longest windows; pieces are filled up to it
        sizes = np.array([len(p) for p in pieces])
        units = -(-sizes // unit)
        base = unit * (np.cumsum(units) - units)
        owner_of_unit = np.repeat(np.arange(len(pieces)), units)
        total = unit * len(owner_of_unit)
        # a filler's value is the largest one in every band
        low, high = np.zeros(total, np.uint32), np.full(total, 0xFFFFFFFF, np.uint32)
        for p, at in zip(pieces, base.tolist(), strict=True):
            low[at:at + len(p)], high[at:at + len(p)] = p.astype(np.uint32), (p >> U8(32)).astype(np.uint32)
        block = max(BLOCK, unit)
        held = np.empty((block + unit, BANDS), np.uint32)
        for begin in range(0, total, block):
            end = min(begin + block + unit, total)  # the next block's first unit ends this one's windows
            mins = held[:end - begin]
            np.multiply(low[begin:end, None], self.factors, out=mins)
            np.bitwise_xor(mins, high[begin:end, None], out=mins)
            for level in range(top + 1):
                mins = np.minimum(mins[::2], mins[1::2])
                if level not in levels:
                    continue
                step = 2 << level
                first = np.arange(begin, min(begin + block, total), step)
                owner = owner_of_unit[first // unit]
                first -= base[owner]
                follows = first + step < sizes[owner]
                valid = follows | (first == 0) & ~inner[owner]  # a text's only half is a window too
                n = len(first)
                whole = mins[:n].copy()
                more = mins[1:n + 1]
                np.minimum(whole[:len(more)], more, out=whole[:len(more)])
                alone = np.flatnonzero(valid & ~follows)
                whole[alone] = mins[alone]
                for name, mine in levels[level]:
                    met = (whole == mine).view(np.uint64).any(axis=1) & valid
                    for i in np.flatnonzero(met).tolist():
                        yield level, name, int(owner[i]), int(first[i])

    def scan(self, raws: list[bytes]) -> list[tuple]:
        """(text, license, containment, first word, words, windows) of all matches."""
        more = 2 << self.top  # a half of the longest windows
        step = max(PIECE, more)
        best: dict[tuple, list] = {}
        held, size = [], 0
        for i, raw in enumerate(raws):
            for at, words, last in pieces(raw, step, more):
                held.append((i, at, words, len(words) if last else step))
                size += len(words)
                if size >= 2 * PIECE:
                    self.scan_pieces(held, best)
                    held, size = [], 0
        if held:
            self.scan_pieces(held, best)
        return [(i, name, *found) for (i, name), found in sorted(best.items())]

    def scan_pieces(self, held: list[tuple], best: dict) -> None:
        hashes = [word_hashes(words) for _, _, words, _ in held]
        for size, levels in self.classes.items():
            runs = [run_hashes(h, size) for h in hashes]
            some = [i for i, r in enumerate(runs) if len(r)]
            if not some:
                continue
            inner = np.array([held[i][1] > 0 for i in some])
            for level, name, piece, begin in self.meetings([runs[i] for i in some], inner, levels):
                text, at, words, limit = held[some[piece]]
                if begin >= limit:  # a window of the next piece
                    continue
                w = words[begin:begin + (4 << level) + size - 1]
                grams = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
                wanted = self.sets[name]
                share = len(wanted & grams) / len(wanted)
                if share >= self.threshold:
                    self.note(best, text, name, share, at + begin, w, wanted, size)

    @staticmethod
    def note(best: dict, text: int, name: str, share: float, begin: int, w: list, mine: set, size: int) -> None:
        """Keep the best window, the first of equals, and count windows."""
        held = best.setdefault((text, name), [-1.0, 0, 0, 0])
        held[3] += 1
        if share > held[0]:
            hits = [i for i in range(len(w) - size + 1) if tuple(w[i:i + size]) in mine]
            held[:3] = [share, begin + hits[0], hits[-1] - hits[0] + size]


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, containment, first_word, n_words, windows) of each
    document and license found in it; the place is that of the best window."""
    templates = TEMPLATES if templates is None else templates
    if sum(map(len, templates.values())) > TEMPLATE_BYTES:
        raise ValueError("the templates exceed TEMPLATE_BYTES")
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), utf8(F.col(f"`{text}`")).alias("raw"))
    schema = T.StructType([T.StructField(doc_id, df.schema[doc_id].dataType), *T._parse_datatype_string(SCHEMA).fields])
    names = schema.names

    def run(batches):
        scanner = Scanner(templates, threshold)
        for whole in batches:
            for b in slices(whole):
                got = scanner.scan(b.column(1).to_pylist())
                cols = list(zip(*got, strict=True)) or [()] * 6
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64())),
                     *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=names)

    return bounded_batches(rows).mapInArrow(run, schema)
