"""License scan by conditional compression.

Texts are cut into blocks (runs of lines without an empty one between; a long block into overlapping runs of BLOCK_WORDS words). A
block that holds a license word is a candidate. Each template is given to zstandard as a raw-content dictionary; what the
dictionary saves in compressing the block, as a share of the most it can save, ranks the templates: wording shared with
the template costs next to nothing, other text costs the same with each dictionary. In rank order, a winner is confirmed
by its exact wording: words of the block and the template are aligned; every difference is listed, and the license is
reported if the block holds at least COVERAGE of the template's words in order and all its required words (names and version
numbers that tell it from its relatives). In a notice of up to SHORT words one other word is a large share: there, SHORT_COVERAGE is enough if a word
like "license" stands among what matches. Of several confirmed, the one that shares most words is reported. A block may hold several licenses; what was
confirmed is taken out and the rest scanned again.

Headers and full texts (over PASSAGE words) have paragraphs of their own: before the blocks, they are looked for in overlapping windows of the whole text, at least twice
as long as the template, the longest templates first, so a notice inside a full text is not reported again.

Full texts come from license_texts. AGPL-3.0 and the Creative Commons licenses but CC0 are known by their notices only. Templates are a parameter: (license id, wording, required words). A saved share under LEAST ends a block's ranking, so
only templates that resemble the block are ever aligned.

Defined cases: a null or empty text has no blocks. Texts are scanned whole. Repeated rows and null ids are returned as they are; an
empty table gives an empty result. Other columns are left out unless in `keep`.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column

# Short notices of public licenses, as projects print them: id, wording, words that must be there.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser general public 2.1"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "cc0 1.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc permission use copy modify distribute fee"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "permission granted charge software without restriction"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution source binary forms permitted conditions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
)
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
GNU = (
    "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version. "
    "{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details. "
    "You should have received a copy of the GNU {2} along with this program."
)
# Standard headers, and notices in other usual words.
NOTICES = (
    *((name, GNU.format(what, ":", kind, ",", version), f"{kind.lower()} redistribute {version}".replace(" license", "")) for name, what, kind, version in (
        ("GPL-2.0", "This program", "General Public License", "2"), ("GPL-3.0", "This program", "General Public License", "3"), ("LGPL-2.1", "This library", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "This library", "Lesser General Public License", "3"), ("AGPL-3.0", "This program", "Affero General Public License", "3"))),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "apache 2.0 compliance"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla public 2.0 obtain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered public domain anyone"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "governed bsd license"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public 3"),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {v} 4.0 International License.", f"creative commons {v.lower().replace('-', ' ')} 4.0") for k, v in CC.items()),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.", f"cc {k.lower().replace('-', ' ')} 4.0") for k in ("BY-ND", "BY-NC-SA", "BY-NC-ND")),
)
# Words that must be in a full text.
TEXTS = {
    "Apache-2.0": "apache license 2.0 contributor", "GPL-2.0": "gnu general public version 2 copyleft", "GPL-3.0": "gnu general public version 3 conveying", "LGPL-2.1": "gnu lesser general public 2.1 library",
    "LGPL-3.0": "gnu lesser general public version 3 combined", "MPL-2.0": "mozilla public 2.0 contributor", "CC0-1.0": "creative commons cc0 1.0 waiver", "MIT": "permission granted sublicense noninfringement",
    "ISC": "permission use copy modify distribute fee disclaims", "BSD-3-Clause": "redistributions binary neither endorse promote", "BSD-2-Clause": "redistributions binary disclaimer",
}


def all_templates() -> tuple:
    """Short notices, headers, SPDX lines and full texts."""
    texts = [(name, files(__package__).joinpath("license_texts", f"{name}.txt").read_text(), required) for name, required in TEXTS.items()]
    names = sorted({t[0] for t in (*TEMPLATES, *NOTICES, *texts)})
    spdx = [(name, f"SPDX-License-Identifier: {name}", "spdx " + " ".join(w.lower() for w in WORD.findall(name))) for name in names]
    return (*TEMPLATES, *NOTICES, *spdx, *texts)


#: What makes a block a candidate.
ANCHORS = re.compile(r"licen[sc]|copyright|permission|redistribut|public domain|\bcc0?\b|spdx", re.I)
BLOCK_WORDS, LEAST, COVERAGE, LEVEL = 200, 0.15, 0.85, 3
SHORT, SHORT_COVERAGE, PASSAGE = 20, 0.6, 35
EMPTY_LINE = re.compile(r"\n[ \t\r\x0b\x0c]*+\n")
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*", re.I)


def _word(word: str) -> str:
    """In small letters; v3 is 3, licence is license."""
    word = word.lower()
    return word[1:] if word[0] == "v" and word[1:2].isdigit() else word.replace("licenc", "licens")


@dataclass
class Template:
    name: str
    words: list[str]
    required: set[str]
    coder: zstandard.ZstdCompressor


class Scanner:
    def __init__(self, templates=None):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.templates = []
        for name, wording, required in all_templates() if templates is None else templates:
            words = [_word(w) for w in WORD.findall(wording)]
            # A dictionary under 8 bytes is refused; wording is repeated, which changes nothing else.
            raw = (" ".join(words) + " ").encode()
            held = zstandard.ZstdCompressionDict(raw * (1 + 16 // len(raw)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append(Template(name, words, set(required.split()) & set(words), zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)))

    def blocks(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(character of the start, words' spans) of candidate blocks."""
        cuts = [0, *(x for m in EMPTY_LINE.finditer(text) for x in m.span()), len(text)]
        for start, end in zip(cuts[::2], cuts[1::2], strict=True):
            if not ANCHORS.search(text, start, end):
                continue
            spans = [w.span() for w in WORD.finditer(text, start, end)]
            step = BLOCK_WORDS // 2
            for at in range(0, max(1, len(spans) - step), step):
                part = spans[at : at + BLOCK_WORDS]
                if part and ANCHORS.search(text, part[0][0], part[-1][1]):
                    yield part

    def rank(self, words: list[str], templates: list[Template]) -> list[tuple[float, Template]]:
        """Templates by the share of their possible saving, the largest first; those whose required words are not all there have no rank."""
        present = set(words)
        templates = [t for t in templates if t.required <= present]
        if not templates:
            return []
        raw = " ".join(words).encode()
        alone = len(self.plain.compress(raw))
        out = []
        for t in templates:
            most = max(8, len(" ".join(t.words)) - 12)
            saved = (alone - len(t.coder.compress(raw))) / min(most, alone)
            if saved >= LEAST:
                out.append((saved, t))
        return sorted(out, key=lambda x: (-x[0], x[1].name))

    def best(self, words: list[str], templates: list[Template]) -> tuple[float, Template, tuple] | None:
        """Share saved, template and confirm()'s result of the template that is confirmed by the most words."""
        found = [(saved, t, got) for saved, t in self.rank(words, templates) if (got := self.confirm(words, t))]
        return max(found, key=lambda x: (round(x[2][0] * len(x[1].words)), x[2][0]), default=None)

    def scan(self, text: str) -> list[tuple[str, int, int, float, float, list[str]]]:
        """license, first and last character, share saved, coverage, differences in wording."""
        found: list[tuple] = []
        taken: set[int] = set()  # where words begin that belong to a license found

        def note(spans: list[tuple[int, int]], saved: float, t: Template, got: tuple) -> None:
            coverage, a, b, differences = got
            found.append((t.name, spans[a][0], spans[b - 1][1], round(saved, 4), round(coverage, 4), differences))
            taken.update(x[0] for x in spans[a:b])

        whole = [w.span() for w in WORD.finditer(text)]
        all_words = [_word(text[a:b]) for a, b in whole]
        present = set(all_words)
        sizes: dict[int, list[Template]] = {}
        for t in self.templates:
            if len(t.words) > PASSAGE and t.required <= present:
                sizes.setdefault(1 << len(t.words).bit_length(), []).append(t)
        for size in sorted(sizes, reverse=True):
            for at in range(0, max(1, len(whole) - size), size):
                free = lambda i, j: [k for k in range(max(0, i), min(j, len(whole))) if whole[k][0] not in taken]
                while True:
                    ids = free(at, at + 2 * size)
                    got = self.best([all_words[i] for i in ids], sizes[size])
                    if not got:
                        break
                    saved, t, kept = got
                    # What lies across the window's bounds belongs to it too.
                    wide = free(ids[kept[1]] - size, ids[kept[2] - 1] + 1 + size)
                    again = self.confirm([all_words[i] for i in wide], t)
                    ids, kept = (wide, again) if again and again[0] >= kept[0] else (ids, kept)
                    note([whole[i] for i in ids], saved, t, kept)
        short = [t for t in self.templates if len(t.words) <= PASSAGE]
        for spans in self.blocks(text):
            while True:
                spans = [x for x in spans if x[0] not in taken]
                got = self.best([_word(text[a:b]) for a, b in spans], short)
                if not got:
                    break
                note(spans, *got)
        return sorted(found, key=lambda x: x[1:3] + x[:1])

    def confirm(self, words: list[str], t: Template):
        """(coverage, first word, word after the last, differences) of the template in the words, or None."""
        matcher = difflib.SequenceMatcher(None, t.words, words, autojunk=False)
        same = [m for m in matcher.get_matching_blocks() if m.size]
        # Leave single words far from the rest of the match: the largest run, and what lies within a template's length of it.
        if not same:
            return None
        core = max(same, key=lambda m: m.size)
        near = [m for m in same if abs((m.b - m.a) - (core.b - core.a)) <= max(3, len(t.words) // 4)]
        coverage = sum(m.size for m in near) / len(t.words)
        a, b = near[0].b, near[-1].b + near[-1].size
        least = SHORT_COVERAGE if len(t.words) <= SHORT and any(w.startswith("licens") for w in words[a:b]) else COVERAGE
        if coverage < least or not t.required <= set(words[a:b]):
            return None
        differences, i, j = [], 0, a
        for m in near:
            if m.a > i or m.b > j:
                differences.append(f"{' '.join(t.words[i : m.a])} -> {' '.join(words[j : m.b])}")
            i, j = m.a + m.size, m.b + m.size
        if i < len(t.words):
            differences.append(f"{' '.join(t.words[i:])} -> ")
        return coverage, a, b, differences


FOUND = "array<struct<license: string, first: long, last: long, saved: double, coverage: double, differences: array<string>>>"


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), templates=None) -> DataFrame:
    """The columns in `keep` and found, an array: a row for each row of docs."""
    source = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    out = T.StructType([*source.schema.fields[:-1], T.StructField("found", T._parse_datatype_string(FOUND))])
    arrow = to_arrow_schema(out)
    templates = all_templates() if templates is None else templates
    names = ("license", "first", "last", "saved", "coverage", "differences")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [[dict(zip(names, x, strict=True)) for x in scanner.scan(t)] if t and ANCHORS.search(t) else [] for t in column(batch, "__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(rows, arrow.field("found").type)], schema=arrow)

    return source.mapInArrow(run, out)
