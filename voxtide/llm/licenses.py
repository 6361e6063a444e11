"""Licence notices: fixed phrases, and templates whose optional and replaceable parts are marked.

Template markup: `[[ words ]]` is optional, `{{a..b}}` stands for a to b words of any kind,
`<< words | words | >>` for one of several wordings (none, if one is empty); all other words are
mandatory and must match exactly. A template is compiled into an automaton over words. Its states
are bits of one integer; reading a word moves all states at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from voxtide.llm.common import batch_udf, plain_words, small_batches, struct_rows, utf8, with_result

# The phrases whose places are counted, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licences, marked up here. Whole bodies and notices, besides short grants.
AS_IS = "<< as is | “as is” | ‘as is’ | ``as is >>"
BSD_TERMS = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met [[ 1 ]] [[ a ]] redistributions of source code must retain the above copyright notice this list of conditions
and the following disclaimer [[ 2 ]] [[ b ]] redistributions in binary form must reproduce the above copyright notice this list of
conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
BSD_NAMES = """
[[ 3 ]] [[ c ]] << neither | the >> << the name | names | name >> of {{1..12}} << nor the names of | or the names of >>
<< its | their | the >> contributors may << be | not be >> used to endorse or promote products derived from this software without
specific prior written permission"""
BSD_DISCLAIMER = f"""
this software is provided by {{{{1..12}}}} {AS_IS} and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{{{1..12}}}} be liable for any
direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute
goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
advised of the possibility of such damage"""
MIT_BODY = f"""
permission is hereby granted free of charge to any person obtaining a copy of this software [[ and associated documentation files ]]
<< the software | the “software” >> to deal in the software without restriction including without limitation the rights to use
copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
furnished to do so subject to the following conditions the above copyright notice and this permission notice
[[ including the next paragraph ]] shall be included in all copies or substantial portions of the software the software is provided
{AS_IS} without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for
a particular purpose and << noninfringement | non infringement >> in no event shall {{{{1..12}}}} be liable for any claim damages or other
liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
other dealings in the software"""
ISC_BODY = f"""
permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted provided
that the above copyright notice and this permission notice appear in all copies the software is provided {AS_IS} and {{{{1..12}}}}
<< disclaims | disclaim >> all warranties with regard to this software including all implied warranties of merchantability and
fitness in no event shall {{{{1..12}}}} be liable for any special direct indirect or consequential damages or any damages whatsoever
resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or
in connection with the use or performance of this software"""
ZLIB_BODY = """
this software is provided << as is | ‘as is’ | “as is” >> without any express or implied warranty in no event will the
<< author | authors >> be held liable for any damages arising from the use of this software permission is granted to anyone to use
this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following
restrictions [[ 1 ]] the origin of this software must not be misrepresented you must not claim that you wrote the original software
if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
[[ 2 ]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[ 3 ]]
this notice may not be removed or altered from any source distribution"""
APACHE_NOTICE = f"""
licensed under the apache license version 2 0 << the license | the “license” | >> you may not use << this file | this work >> except
in compliance with the license you may obtain a copy of the license at {{{{3..8}}}} unless required by applicable law or agreed to in
writing software distributed under the license is distributed on an {AS_IS} basis without warranties or conditions of any kind either
express or implied see the license for the specific language governing permissions and limitations under the license"""
GNU = [
    ("agpl-3", "affero general", "3"), ("gpl-2", "general", "2"), ("gpl-3", "general", "3"), ("lgpl-2", "library general", "2"),
    ("lgpl-2.1", "lesser general", "2 1"), ("lgpl-3", "lesser general", "3"),
]
GNU_WORDING = [
    "licensed under [[ the ]] [[ terms of the ]] gnu {name} public license << version | v | >> {version}",
    "under the terms of the gnu {name} public license as published by the free software foundation [[ either ]] version {version}",
    "under the terms of the gnu {name} public license version {version} as published by the free software foundation",
    "under the terms of version {version} of the gnu {name} public license",
]
CC = [
    ("cc-by", ""), ("cc-by-nc", "<< noncommercial | non commercial >>"),
    ("cc-by-nc-nd", "<< noncommercial | non commercial >> << noderivatives | noderivs | no derivatives | no derivs >>"),
    ("cc-by-nc-sa", "<< noncommercial | non commercial >> << sharealike | share alike >>"),
    ("cc-by-nd", "<< noderivatives | noderivs | no derivatives | no derivs >>"), ("cc-by-sa", "<< sharealike | share alike >>"),
]
CC_WORDING = (
    "licensed under [[ a ]] [[ the ]] creative commons attribution {terms} [[ version ]] << 1 0 | 2 0 | 2 5 | 3 0 | 4 0 | >>"
    " << generic | unported | international | >> [[ public ]] license"
)

TEMPLATES = [
    ("apache-2", "licensed under the apache license [[ version ]] 2 0"),
    ("apache-2", APACHE_NOTICE),
    ("bsd-2", BSD_TERMS + BSD_DISCLAIMER),
    ("bsd-3", BSD_TERMS + BSD_NAMES + BSD_DISCLAIMER),
    ("bsl-1", "distributed under the boost software license version 1 0"),
    ("cc0", "to the extent possible under law {{1..12}} << has | have >> waived all copyright and related or neighboring rights to"),
    ("epl-2", "made available under the terms of the eclipse public license [[ v ]] [[ version ]] 2 0"),
    ("isc", ISC_BODY),
    ("mit", MIT_BODY),
    ("mpl-2", "subject to the terms of the mozilla public license [[ v ]] [[ version ]] 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use"
                  " compile sell or distribute this software either in source code form or as a compiled binary for any purpose"
                  " commercial or non commercial and by any means"),
    ("zlib", ZLIB_BODY),
    *[(label, wording.format(name=name, version=version)) for label, name, version in GNU for wording in GNU_WORDING],
    *[(label, CC_WORDING.format(terms=terms)) for label, terms in CC],
]

MARK = re.compile(r"\[\[(.*?)\]\]|\{\{(\d+)\.\.(\d+)\}\}|<<(.*?)>>|(\S+)", re.DOTALL)


def pattern(template: str) -> str:
    """The template as a regular expression over words of which each has a blank behind it and one blank stands before all."""
    out = [" "]
    for optional, low, high, either, word in MARK.findall(template):
        if word:
            out.append(f"{word} ")
        elif high:
            out.append(f"([^ ]+ ){{{low},{high}}}")
        else:
            wordings = [" ".join(w.split()) for w in (either or optional).split("|")]
            out.append("(" + "|".join(f"{w} " for w in wordings if w) + ")" + ("" if either and all(wordings) else "?"))
    return "".join(out)


@dataclass
class Automaton:
    """States 0..n of a template; bit i is set when the first i positions have been read or skipped."""

    words: dict[bytes, int] = field(default_factory=dict)  # by word: states it may be read in
    any_word: int = 0  # states in which every word may be read
    skips: list[tuple[int, int]] = field(default_factory=list)  # (state, state reached without reading)
    n: int = 0
    mandatory: set[bytes] = field(default_factory=set)

    @classmethod
    def of(cls, template: str) -> Automaton:
        made = cls()
        for optional, low, high, either, word in MARK.findall(template):
            begin = made.n
            if word:
                made._read(word.encode())
                made.mandatory.add(word.encode())
            elif high:
                for i in range(int(high)):
                    made.any_word |= 1 << made.n
                    if i >= int(low):
                        made.skips.append((made.n, made.n + 1))
                    made.n += 1
            elif either:
                made._choose([w.encode().split() for w in either.split("|")])
            else:
                for w in optional.split():
                    made._read(w.encode())
                if made.n > begin:
                    made.skips.append((begin, made.n))
        made.skips.sort()
        if not made.mandatory:
            raise ValueError(f"template without mandatory words: {template}")
        return made

    def _read(self, word: bytes) -> None:
        self.words[word] = self.words.get(word, 0) | 1 << self.n
        self.n += 1

    def _choose(self, wordings: list[list[bytes]]) -> None:
        """A state of its own before and behind each wording, with skips to its beginning and from its end."""
        begin, ends = self.n, []
        for words in wordings:
            self.n += 1
            self.skips.append((begin, self.n))
            for w in words:
                self._read(w)
            ends.append(self.n)
        self.n += 1
        self.skips += [(end, self.n) for end in ends]

    def _closed(self, states: int) -> int:
        for a, b in self.skips:  # skips lead forward and are in order, so one pass is enough
            if states >> a & 1:
                states |= 1 << b
        return states

    def matches(self, words: list[bytes]) -> bool:
        """Whether the template occurs in consecutive words."""
        start, end, states = self._closed(1), 1 << self.n, 0
        for word in words:
            states |= start
            states = (states & (self.words.get(word, 0) | self.any_word)) << 1
            if states:
                states = self._closed(states)
                if states & end:
                    return True
        return False


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every start at which the words of a phrase stand consecutively."""
    first, n, out, at = phrase[0], len(phrase), [], -1
    while True:
        try:
            at = words.index(first, at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("n_templates", pa.int64()), ("score", pa.float64()),
]
SCHEMA = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,"
    "n_templates:bigint,score:double>"
)


def scan_licenses(
    docs: DataFrame, text: str = "text", keep: Iterable[str] = ("doc_id",),
    phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """Columns `keep` and, per row, the licence notices of its whole text.

    n_words; n_base (places of all phrases), first_word, last_word (smallest and largest start, null
    without any); base_labels (labels of the phrases found), labels (the templates' too), both
    distinct, sorted and comma-joined; n_templates (templates found); score = 1 - 1 / (1 + n_base +
    n_templates). Null and empty texts have no words, empty labels and score 0. Rows are independent
    of each other, so repeated rows give repeated results; other columns are not looked at.
    Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    lists = [(p.encode().split(), label) for p, label in phrases.items()]
    automata = [(label, Automaton.of(t)) for label, t in templates]
    # a text without the longest mandatory word of a template or phrase cannot hold it
    phrase_key = [(max(p, key=len), p, label) for p, label in lists]
    template_key = [(min(a.mandatory, key=lambda w: (-len(w), w)), label, a) for label, a in automata]
    rare = {key for key, _, _ in template_key}

    def row(value: bytes | None) -> tuple:
        words = plain_words(value or b"")
        places, base, found, n_templates = [], set(), set(), 0
        low = (value or b"").lower()
        for key, phrase, label in phrase_key:
            if key in low and (at := phrase_places(words, phrase)):
                places += at
                base.add(label)
        if any(key in low for key in rare):
            present = set(words)
            for key, label, automaton in template_key:
                if key in present and automaton.mandatory <= present and automaton.matches(words):
                    found.add(label)
                    n_templates += 1
        return (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | found)), n_templates, 1 - 1 / (1 + len(places) + n_templates),
        )

    def work(values: list) -> pa.Array:
        rows = [row(v) for v in values]
        return struct_rows(FIELDS, zip(*rows, strict=True) if rows else [[]] * len(FIELDS))

    return with_result(docs, batch_udf(work, SCHEMA)(utf8(text)), keep, [name for name, _ in FIELDS])
