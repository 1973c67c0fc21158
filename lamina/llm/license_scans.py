"""License scans by template automata.

A template is words with markup: `[ ... ]` is optional wording, `{n}` stands for up to n words of any kind. It is
compiled to an automaton over words; a run starts wherever the template's anchor (its first mandatory words)
stands in a text, and the template is accepted there if the automaton reaches its end, that is if all mandatory
wording stands in the text exactly and in order. Templates are whole licenses, with the holders' names replaceable, and the
notices by which a file names its license; a license that is cut short or reworded is not accepted. Others can be
given. The score of a run that fails is the share of the mandatory
words that it got through. Phrases are plain places of consecutive words and give base labels.

Results for unusual input: null and empty texts have no words, places or labels and score 0; texts of any length
are read whole; repeated rows get equal results; a null identifier stays null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import documents, small_arrow_batches

#: The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Whole public licenses and the notices that stand for a license in a file, as templates.
_MIT_DISCLAIMER = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall {10} be liable for any claim damages or other liability whether in an action "
    "of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution"
)
_BSD_NAMES = "[3] neither the name of {10} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = (
    "this software is provided by {10} as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed in no event shall {10} be liable for any direct indirect incidental special exemplary or "
    "consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out "
    "of the use of this software even if advised of the possibility of such damage"
)
_GNU_NOTICE = (
    "is free software you can redistribute it and or modify it under the terms of the gnu %s public license as published by the free software foundation "
    "either version %s of the license or [at your option] any later version {8} is distributed in the hope that it will be useful but without any warranty "
    "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu %s public license for more details"
)
TEMPLATES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal "
        "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and "
        "this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software " + _MIT_DISCLAIMER,
    ),
    ("bsd-2", f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    ("bsd-3", f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    (
        "isc",
        "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
        "notice and this permission notice appear in all copies the software is provided as is and {10} disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness in no event shall {10} be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will {10} be held liable for any damages arising from the use of "
        "this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute "
        "it freely subject to the following restrictions [1] the origin of this software must not be misrepresented you must not claim that you wrote the "
        "original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [2] "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software [3] this notice may not be "
        "removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that "
        "recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act "
        "of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _MIT_DISCLAIMER,
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 [the license] you may not use this file except in compliance with the license you may obtain a copy of "
        "the license at [http] [https] www apache org licenses license 2 0 [txt] [html] unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license "
        "for the specific language governing permissions and limitations under the license",
    ),
    ("gpl-2", _GNU_NOTICE % ("general", "2", "general")),
    ("gpl-3", _GNU_NOTICE % ("general", "3", "general")),
    ("lgpl", _GNU_NOTICE % ("lesser general", "{2}", "lesser general")),
    ("agpl-3", _GNU_NOTICE % ("affero general", "3", "affero general")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [http] [https] mozilla org mpl 2 0"),
    ("mit", "under the [terms of the] mit [open source] license"),
    ("apache-2", "licensed under the apache license version 2 [0]"),
    ("gpl-2", "gnu general public license [as published by the free software foundation] [either] version 2 [0]"),
    ("gpl-3", "gnu general public license [as published by the free software foundation] [either] version 3 [0]"),
    ("lgpl", "gnu lesser general public license [as published by the free software foundation] [either] version {1}"),
    ("agpl-3", "gnu affero general public license [as published by the free software foundation] [either] version 3 [0]"),
    ("mpl-2", "subject to the terms of the mozilla public license [v] [version] 2 0"),
    ("cc0", "creative commons [cc0] zero [v] 1 0 universal"),
    ("cc-by", "licensed under [the] cc by {1} 0"),
    ("cc-by", "creative commons attribution {1} 0 [international] [unported] license"),
    ("cc-by-sa", "licensed under [the] cc by sa {1} 0"),
    ("cc-by-sa", "creative commons attribution sharealike {1} 0 [international] [unported] license"),
    ("cc-by-nc", "licensed under [the] cc by nc {1} 0"),
    ("cc-by-nc", "creative commons attribution noncommercial {1} 0 [international] [unported] license"),
    ("cc-by-nd", "licensed under [the] cc by nd {1} 0"),
    ("all-rights-reserved", "all rights reserved [by] [the] [author] [no part of this {6} may be reproduced]"),
]
ANCHOR_WORDS = 3

#: Bytes that belong to words keep or lower themselves; all others become a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Automaton:
    """A template as states with word steps, free steps and silent steps."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.word: list[dict[bytes, int]] = [{}]
        self.free: list[int | None] = [None]
        self.silent: list[list[int]] = [[]]
        self.passed = [0]  # mandatory words on the way to each state
        at, depth, opened, anchor, open_anchor = 0, 0, [], [], True
        for token in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
            if token == "[":
                opened.append(at)
                depth += 1
                open_anchor = open_anchor and len(anchor) == 0
            elif token == "]":
                self.silent[opened.pop()].append(at)
                depth -= 1
            elif token[0] == "{":
                begin, states = at, [at]
                for _ in range(int(token[1:-1])):
                    at = self._state(self.passed[begin])
                    self.free[states[-1]] = at
                    states.append(at)
                for s in states[:-1]:
                    self.silent[s].append(at)
                open_anchor = open_anchor and len(anchor) == 0
            else:
                nxt = self._state(self.passed[at] + (depth == 0))
                self.word[at][token.encode()] = nxt
                at = nxt
                if open_anchor and depth == 0 and len(anchor) < ANCHOR_WORDS:
                    anchor.append(token)
        self.end = at
        self.mandatory = self.passed[at]
        self.anchor = b" " + " ".join(anchor).encode() + b" "

    def _state(self, passed: int) -> int:
        self.word.append({})
        self.free.append(None)
        self.silent.append([])
        self.passed.append(passed)
        return len(self.word) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.silent[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def run(self, words: list[bytes], at: int) -> tuple[int, float]:
        """End of the accepted words from `at` on, or -1, and the share of mandatory words passed."""
        now, best = self._closed({0}), 0
        accepted = -1
        while now:
            best = max(best, *(self.passed[s] for s in now))
            if self.end in now:
                accepted = at
                break
            if at >= len(words):
                break
            word = words[at]
            now = self._closed({n for s in now for n in (self.word[s].get(word), self.free[s]) if n is not None})
            at += 1
        return accepted, 1.0 if accepted >= 0 else best / self.mandatory


@lru_cache(maxsize=8)
def automata(templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)) -> list[Automaton]:
    return [Automaton(*t) for t in templates]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def _places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers where the phrase (with a blank on both sides) stands; words are joined by one blank."""
    at, seen, number = joined.find(phrase), 0, 0
    while at >= 0:
        number += joined.count(b" ", seen, at)
        seen = at
        yield number
        at = joined.find(phrase, at + 1)


def scan(text: str | None, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int]], float]:
    """Number of words, base places (word, label), accepted templates (label, first word, end), score."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = [(n, label) for phrase, label in PHRASES.items() for n in _places(joined, b" " + phrase.encode() + b" ")]
    accepted, score = [], 1.0 if base else 0.0
    for a in automata(templates):
        for n in _places(joined, a.anchor):
            end, share = a.run(words, n)
            score = max(score, share)
            if end >= 0:
                accepted.append((a.label, n, end))
    return len(words), base, accepted, score


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)) -> DataFrame:
    """`id, n_words, base array<(word, label)>, templates array<(label, first, end)>, score` of every row."""
    small_arrow_batches(docs.sparkSession)
    base = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py(), templates) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0),
                    "n_words": pa.array([r[0] for r in rows], pa.int64()),
                    "base": pa.array([[{"word": n, "label": x} for n, x in r[1]] for r in rows], base),
                    "templates": pa.array([[{"label": x, "first": a, "end": e} for x, a, e in r[2]] for r in rows], found),
                    "score": pa.array([r[3] for r in rows], pa.float64()),
                }
            )

    schema = "id long, n_words long, base array<struct<word:bigint,label:string>>, templates array<struct<label:string,first:bigint,end:bigint>>, score double"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("base")["label"]
    return scan_documents(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base")["word"]).alias("first_word"),
        F.array_max(F.col("base")["word"]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.col("templates")["label"]))), ",").alias("labels"),
        "score",
    )
