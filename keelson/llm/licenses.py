"""License scans by template matching.

A template is wording with markup: ``[[ ... ]]`` is optional, ``{n}`` stands for up to n words that may be
replaced, and ``{n:pattern}`` for up to n words that each match a pattern. Each template is compiled into
an automaton over words; a text is accepted where its words run through the automaton, so every mandatory
word must be there, in order, exactly. Full texts carry all conditions and the disclaimer, so that a text
with an altered or missing clause is not accepted; notices are the short forms that point to a license.
The base phrases are templates without markup. ``read_templates`` compiles whole license texts from a
folder, plain or with the markup of the public license lists (``<<beginOptional>>``, ``<<endOptional>>``,
``<<var;...;match="...">>``), into templates of this kind; documents are then matched against them as well. A text whose words lack a template's longest mandatory word
can't match it and is not scanned for it.

Edge cases: a null or empty text has no words, no places and score 0; a base phrase counts at every word
where it starts, overlaps and repeats included; whole long texts are scanned; a null doc_id keeps its row;
equal rows each have their row; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, documents, map_rows, texts

#: The phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license wording, in words, and the markup of what may be left out or replaced.
_AS_IS = "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {6} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_SOURCE = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[ 1 ]] [[ a ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[ 2 ]] [[ b ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "[[ 3 ]] [[ 4 ]] [[ c ]] neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_ADVERTISING = "[[ 3 ]] [[ c ]] all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {12}"
_BSD_DISCLAIMER = "this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEXTS = {
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[ http ]] [[ https ]] www apache org licenses license 2 0 [[ txt ]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause": f"{_BSD_SOURCE} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_SOURCE} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "bsd-4-clause": f"{_BSD_SOURCE} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {1:[23]} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "isc": "permission to use copy modify [[ and or ]] [[ and ]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {8} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-text": f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the software the software is provided as is {_AS_IS}",
    "mpl-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[ http ]] [[ https ]] [[ www ]] mozilla org mpl 2 0",
    "unlicense": f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is {_AS_IS}",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[ 1 ]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[ 2 ]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[ 3 ]] this notice may not be removed or altered from any source distribution",
}
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0 [[ the license ]]",
    "cc-by": "licensed under [[ a ]] [[ the ]] [[ creative commons ]] [[ attribution ]] cc by {1:[1-4]} 0",
    "cc-by-nc": "licensed under [[ a ]] [[ the ]] cc by nc {1:[1-4]} 0",
    "cc0": "[[ creative commons ]] cc0 1 0 universal",
    "gpl-notice": "[[ this work is ]] licensed under the [[ terms of the ]] gnu general public license version {1:[23]}",
    "lgpl": "gnu [[ library or ]] lesser general public license",
    "mit-notice": "[[ this {3} is ]] released under the mit license",
}
TEMPLATES = TEXTS | NOTICES

#: A-Z are lowered; ASCII letters, digits and every byte beyond ASCII stay; the rest parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


#: A tag of the license lists' markup, its attributes behind the name.
_TAG = re.compile(r"<<\s*(beginOptional|endOptional|var)\b((?:[^>\"]|\"[^\"]*\"|>(?!>))*)>>")
#: A word that a pattern of characters may stand for, without anything that parts words or leaves the word open.
_WORD_PATTERN = re.compile(r"[a-z0-9|()?\[\]-]+")


def from_markup(text: str, longest: int = 100) -> str:
    """A license text, plain or with the license lists' markup, as a template of words.

    What is optional stays so, nested parts too. A replaceable part is at most one word of its pattern if that
    tells single words (such as ``any|every``), else up to as many words as its bound of characters can hold,
    ``longest`` at most. A part that isn't closed, or isn't opened, raises.
    """
    out: list[str] = []
    at = depth = 0
    for tag in _TAG.finditer(text):
        out += _plain(text[at : tag.start()])
        at = tag.end()
        if tag[1] == "var":
            match = re.search(r'match="([^"]*)"', tag[2])
            out.append(_replaceable(match[1] if match else ".+", longest))
            continue
        depth += 1 if tag[1] == "beginOptional" else -1
        if depth < 0:
            raise ValueError("an optional part ends that was never begun")
        out.append("[[" if tag[1] == "beginOptional" else "]]")
    if depth:
        raise ValueError("an optional part has no end")
    return " ".join(out + _plain(text[at:]))


def _plain(text: str) -> list[str]:
    return [w.decode() for w in words_of(text.encode())]


def _replaceable(pattern: str, longest: int) -> str:
    folded = pattern.lower()
    if _WORD_PATTERN.fullmatch(folded):
        return f"{{1:{folded}}}"
    bound = re.fullmatch(r"\.\{\d*,(\d+)\}\??", folded)
    return f"{{{min(longest, (int(bound[1]) + 1) // 2) if bound else longest}}}"


def read_templates(spark: SparkSession, folder: str, longest: int = 100) -> dict[str, str]:
    """Templates by label from a folder of license texts; the label is the file's name in lower case, without ``.txt`` or ``.template``.

    A file without a mandatory word raises, since it would match anything. The folder is the list of
    licenses, which no corpus adds to; so it is read to the driver.
    """
    found = {}
    for name, text in sorted(spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1), "value").collect()):
        label = re.sub(r"(\.template)?(\.txt)?$", "", name.lower())
        found[label] = from_markup(text, longest)
        if not re.sub(r"\[\[.*\]\]|\{\S+\}", "", found[label]).strip():
            raise ValueError(f"{name} has no mandatory wording")
    return found


@dataclass
class Automaton:
    """States are numbered; each has word edges, edges for any word of a pattern, and empty edges. The last state accepts."""

    words: list[dict[bytes, int]]
    anywhere: list[list[tuple[int, re.Pattern | None]]]
    empty: list[list[int]]
    first: frozenset[bytes]
    longest: bytes
    mandatory: int
    depth: list[int]

    def closure(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def run(self, words: list[bytes], at: int) -> tuple[int | None, float]:
        """The end of the shortest match that starts at ``at``, and the share of mandatory words that were read."""
        states, best = self.closure({0}), 0
        last = len(self.words) - 1
        for i in range(at, len(words)):
            after = {s for x in states for s, pattern in self.anywhere[x] if pattern is None or pattern.fullmatch(words[i])}
            after |= {self.words[x][words[i]] for x in states if words[i] in self.words[x]}
            if not after:
                break
            states = self.closure(after)
            best = max(best, max(self.depth[s] for s in states))
            if last in states:
                return i + 1, 1.0
        return None, best / self.mandatory


def compiled(template: str) -> Automaton:
    words: list[dict[bytes, int]] = [{}]
    anywhere: list[list[tuple[int, re.Pattern | None]]] = [[]]
    empty: list[list[int]] = [[]]
    depth = [0]
    opened: list[int] = []
    mandatory: list[bytes] = []

    def state() -> int:
        words.append({})
        anywhere.append([])
        empty.append([])
        depth.append(len(mandatory))
        return len(words) - 1

    at = 0
    for token in template.split():
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            end = state()
            empty[at].append(end)
            empty[opened.pop()].append(end)
            at = end
        elif m := re.fullmatch(r"\{(\d+)(?::(.+))?\}", token):
            steps = [at]
            pattern = re.compile(m[2].encode()) if m[2] else None
            for _ in range(int(m[1])):
                anywhere[steps[-1]].append((nxt := state(), pattern))
                steps.append(nxt)
            for s in steps[:-1]:
                empty[s].append(steps[-1])
            at = steps[-1]
        else:
            if not opened:
                mandatory.append(token.encode())
            words[at][token.encode()] = nxt = state()
            at = nxt
    made = Automaton(words, anywhere, empty, frozenset(), max(mandatory, key=len), len(mandatory), depth)
    made.first = frozenset(w for s in made.closure({0}) for w in words[s])
    return made


def scan(words: list[bytes], joined: bytes, automaton: Automaton) -> tuple[list[int], float]:
    """Where the automaton's matches start, and the largest share of mandatory words that any start reads."""
    if automaton.longest not in joined:
        return [], 0.0
    starts, share = [], 0.0
    for i, w in enumerate(words):
        if w in automaton.first:
            end, read = automaton.run(words, i)
            share = max(share, read)
            if end is not None:
                starts.append(i)
    return starts, share


def license_labels(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each document: places of the base phrases, labels of base and templates, and the score.

    The score is 1 where a base phrase or a template is accepted, else the largest share of a template's
    mandatory words that the text runs through, up to but not 1.
    """

    def start() -> tuple[list, list]:
        return [(label, compiled(p)) for p, label in base.items()], [(label, compiled(p)) for label, p in templates.items()]

    def step(batch: pa.RecordBatch, held: tuple[list, list]) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for text in column_bytes(batch.column("text")):
            words = words_of(text)
            joined = b" ".join(words)
            places, labels, share = [], set(), 0.0
            for label, automaton in held[0]:
                starts, read = scan(words, joined, automaton)
                places += starts
                share = max(share, read)
                if starts:
                    labels.add(label)
            more = set(labels)
            for label, automaton in held[1]:
                starts, read = scan(words, joined, automaton)
                share = max(share, read)
                if starts:
                    more.add(label)
            row = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), share)
            for k, v in zip(out, row):
                out[k].append(v)
        return out | {"doc_id": batch.column("doc_id")}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(texts(docs), step, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", start)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(documents(spark, sf_dir))


#: The columns that the base phrases decide.
BASE_COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7's scan finds of the base phrases alone, which SQL can tell."""
    return op7_license_scan(spark, sf_dir).select(*BASE_COLUMNS)


def _places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words, 1))
    return f"list_filter(range(greatest(len(w) - {len(words) - 1}, 0)), lambda i: {same})"


#: The same places by lists of words, for DuckDB.
BASE_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{_places(phrase)} AS {label}" for phrase, label in BASE.items())} FROM t)
SELECT doc_id, n_words, {" + ".join(f"len({label})" for label in BASE.values())} AS n_base, least({", ".join(f"list_min({label})" for label in BASE.values())}) AS first_word, greatest({", ".join(f"list_max({label})" for label in BASE.values())}) AS last_word,
concat_ws(',', {", ".join(f"CASE WHEN len({label}) > 0 THEN '{label}' END" for label in sorted(BASE.values()))}) AS base_labels FROM p
"""
