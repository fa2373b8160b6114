"""License scans by template-markup matching (operator 11).

A template is the public wording of a licence or notice with two kinds of
marks: optional regions, and replaceable ones that stand for some number of any
words. Each template compiles to states over words; all of them are run as one
automaton, whose sets of states are made as texts need them. A template is
accepted from a word on if all its mandatory wording follows exactly; the
longest end counts. Only texts that hold the longest mandatory word of some
template are run, and only from words that a template begins with. Four short
phrases are counted beside.

The score of a text is m / (m + 2) for the m mandatory words of the longest
wording found, 0 without any.

Defined results: null and empty texts have no words, no labels and score 0;
texts of any length are matched whole; repeated rows stay repeated, in equal
form; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of the base phrases, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public wording of licences and notices. [[ ]] is optional, {{a-b}} stands for a to b words of any kind.
_BSD_START = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[{{1-1}}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[{{1-1}}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by {{1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of {{1-6}} and associated documentation files the {{1-3}} to deal in the {{1-3}} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{1-3}} and to permit persons to whom the {{1-3}} is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the {{1-3}} the {{1-3}} is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{1-12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the {{1-3}} or the use or other dealings in the {{1-3}}"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{1-8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{1-8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", f"{_BSD_START} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD_START} [[{{{{1-1}}}}]] neither the name of {{{{1-12}}}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[{{1-1}}]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[{{1-1}}]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[{{1-1}}]] this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use [[this]] {{1-3}} except in compliance with the license you may obtain a copy of the license at {{0-8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "[[this {{1-4}} is]] licensed under [[the terms of]] the apache license [[version]] 2 0"),
    ("gpl-2.0-or-later", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-or-later", "is free software you can redistribute it and or modify it under the terms of the gnu {{1-1}} general public license as published by the free software foundation either version {{1-2}} of the license or at your option any later version"),
    ("gpl-2.0", "licensed under [[the terms of]] the gnu general public license [[{{1-1}}]] version 2"),
    ("gpl-3.0", "licensed under [[the terms of]] the gnu general public license [[{{1-1}}]] version 3"),
    ("mit", "[[this {{1-4}} is]] released under [[the terms of]] the mit license"),
    ("mit", "licensed under [[the terms of]] the mit license"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] [[creative commons]] [[attribution]] cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] cc by sa {{1-2}}"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under [[a]] [[the]] cc by nc sa 4 0"),
    ("cc-by", "licensed under [[a]] [[the]] creative commons attribution [[{{1-2}}]] [[international]] license"),
    ("cc0-1.0", "to the extent possible under law {{1-20}} waived all copyright and related or neighboring rights to {{1-20}}"),
    ("all-rights-reserved", "all rights reserved [[no part of this {{1-3}} may be reproduced]]"),
]


class Template:
    """One template as states over words; state i reads words[i] (None: any word) into i + 1, jumps skip optional wording."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.reads: list[str | None] = []
        self.jumps: list[tuple[int, int]] = []
        self.mandatory: list[str] = []
        opened: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", markup):
            if part == "[[":
                opened.append(len(self.reads))
            elif part == "]]":
                self.jumps.append((opened.pop(), len(self.reads)))
            elif part[0] == "{":
                least, most = map(int, part[2:-2].split("-"))
                self.reads += [None] * most
                self.jumps += [(len(self.reads) - k, len(self.reads)) for k in range(1, most - least + 1)]
            else:
                self.reads.append(part)
                if not opened:
                    self.mandatory.append(part)
        self.n = len(self.mandatory)


class Matcher:
    """All templates as one automaton over words; sets of states are made when a text first reaches them."""

    #: Sets of states kept at once.
    MOST_SETS = 50_000

    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = [Template(*t) for t in templates]
        self.after: list[dict[int, list[int]]] = []
        for t in self.templates:
            jumps: dict[int, list[int]] = {}
            for a, b in t.jumps:
                jumps.setdefault(a, []).append(b)
            self.after.append(jumps)
        self.anchors = {max(t.mandatory, key=len).encode() for t in self.templates}
        self._reset()

    def _reset(self) -> None:
        self.sets: list[frozenset[tuple[int, int]]] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[bytes | None, int]] = []
        self.words: list[frozenset[bytes]] = []
        self.accepts: list[list[int]] = []
        self._number({(k, 0) for k in range(len(self.templates))})

    def _number(self, states: set[tuple[int, int]]) -> int:
        """Number of a set of states, with all that jumps reach from them."""
        open_, seen = list(states), set()
        while open_:
            s = open_.pop()
            if s not in seen:
                seen.add(s)
                open_ += [(s[0], b) for b in self.after[s[0]].get(s[1], ())]
        found = frozenset(seen)
        if found not in self.numbers:
            self.numbers[found] = len(self.sets)
            self.sets.append(found)
            self.steps.append({})
            reads = {self.templates[k].reads[at] for k, at in found if at < len(self.templates[k].reads)}
            self.words.append(frozenset(w.encode() for w in reads if w))
            self.accepts.append([k for k, at in found if at == len(self.templates[k].reads)])
        return self.numbers[found]

    def _step(self, at: int, word: bytes) -> int:
        key = word if word in self.words[at] else None
        to = self.steps[at].get(key)
        if to is None:
            read = key and key.decode()
            to = self._number({(k, s + 1) for k, s in self.sets[at] if s < len(self.templates[k].reads) and self.templates[k].reads[s] in (None, read)})
            self.steps[at][key] = to
        return to

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, word after the last) of each place where a template is accepted, the longest end of each."""
        if self.anchors.isdisjoint(words):
            return []
        if len(self.sets) > self.MOST_SETS:
            self._reset()
        out = []
        begins = self.words[0]
        for start, w in enumerate(words):
            if w not in begins:
                continue
            at, ends = 0, {}
            for k in range(start, len(words)):
                at = self._step(at, words[k])
                if not self.sets[at]:
                    break
                for t in self.accepts[at]:
                    ends[t] = k + 1
            out += [(t, start, end) for t, end in ends.items()]
        return out


#: Bytes of words in lower case, a blank for all others; bytes from 128 on belong to words.
_WORD_BYTES = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))
_LABELS = {tuple(p.encode().split()): label for p, label in PHRASES.items()}


def scan_text(text: bytes, matcher: Matcher) -> tuple[int, list[tuple[str, int, int, int, bool]]]:
    """Words of a text, and (label, first word, word after the last, mandatory words, is a base phrase) of all that is found."""
    words = text.translate(_WORD_BYTES).split()
    found = []
    for phrase, label in _LABELS.items():
        at = -1
        for _ in range(words.count(phrase[0])):
            at = words.index(phrase[0], at + 1)
            if tuple(words[at : at + len(phrase)]) == phrase:
                found.append((label, at, at + len(phrase), len(phrase), True))
    found += [(matcher.templates[t].label, a, b, matcher.templates[t].n, False) for t, a, b in matcher.matches(words)]
    return len(words), sorted(found, key=lambda x: x[1:3])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, found): each place of a base phrase or template, by first word; after is the word after its last."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ("label", "first", "after", "mandatory", "base")
    made: list[Matcher] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Matcher(templates))
        got = [scan_text(t, made[0]) for t in common.utf8(batch.column(1))]
        return {"doc_id": batch.column(0), "n_words": [n for n, _ in got], "found": [[dict(zip(names, x)) for x in found] for _, found in got]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.arrow_map(rows, run, f"doc_id {kind}, n_words long, found array<struct<label string, first long, after long, mandatory int, base boolean>>")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    places = F.transform(base, lambda x: x["first"])
    most = F.array_max(F.transform("found", lambda x: x["mandatory"]))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), names(base).alias("base_labels"), names(F.col("found")).alias("labels"), F.coalesce(most / (most + 2), F.lit(0.0)).alias("score"))


def _regex(markup: str) -> str:
    """A template as a regular expression over words that each follow a blank."""
    words = re.sub(r"(^|(?<=[\s\[]))([a-z0-9]+)", r"_\2", markup)
    optional = words.replace("[[", "(?:").replace("]]", ")?")
    return re.sub(r"\{\{(\d+)-(\d+)\}\}", r"(?:_[^ ]+){\1,\2}", optional).replace(" ", "").replace("_", " ").replace("[^]", "[^ ]") + " "


_PLACES = ", ".join("list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split(), 1)) + f") AS i_{n}" for n, p in enumerate(PHRASES))
_HITS = " UNION ALL ".join(
    [f"SELECT k, '{label}' AS label, {len(p.split())} AS m, true AS base FROM placed WHERE len(i_{n}) > 0" for n, (p, label) in enumerate(PHRASES.items())]
    + [f"SELECT k, '{label}', {Template(label, markup).n}, false FROM placed WHERE regexp_matches(joined, '{_regex(markup)}')" for label, markup in TEMPLATES]
)
OP11_SQL = rf"""
WITH worded AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
placed AS MATERIALIZED (SELECT k, doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS joined, {_PLACES} FROM worded),
hits AS ({_HITS}),
summed AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, max(m / (m + 2.0)) AS score FROM hits GROUP BY k),
counted AS (SELECT *, flatten([{", ".join(f"i_{n}" for n in range(len(PHRASES)))}]) AS places FROM placed)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM counted LEFT JOIN summed USING (k)
"""
