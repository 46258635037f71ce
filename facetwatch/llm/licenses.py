"""License scans by template-markup matching.

A template is license wording with markup in the style of SPDX templates:
``<<beginOptional>> ... <<endOptional>>`` encloses words that may be missing,
and ``<<var;words=0-12>>`` stands for words that may be replaced, here by none
to twelve others. Each template is compiled into a token automaton: one state
per mandatory word, silent steps around optional regions, and counted wildcard
steps for replaceable ones. All templates share one automaton whose reachable
state sets are built as they are met and remembered. A text is accepted where
the automaton runs through: every mandatory word must stand there exactly.

There are templates of three kinds: whole license texts with all their clauses,
notices that name a license and its version, and fragments (a license's first
sentence), whose labels end in ``-fragment`` because what follows decides. A label
of the first two kinds scores 1, a fragment or a base phrase alone 0.5.

Base phrases are found at the same time and give their labels in any case.

Each document is one row in and one row out, no shuffle; whole texts are read.

Defined cases: null text counts as empty; a text without words has no labels
and score 0; rows that repeat an id are scanned each; null ids stay null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a word is, and the base phrases with their labels.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wording that several public licenses share.
_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
    to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
    and to permit persons to whom the software is furnished to do so"""
_MIT_NOTICE = "subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software"
_MIT_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
    in no event shall <<var;words=1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise
    arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD_GRANT = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
    <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_NAME = "neither the name of <<var;words=1-12>> nor the names of <<beginOptional>>its<<endOptional>> <<beginOptional>>their<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_WARRANTY = """this software is provided by <<var;words=1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
    in no event shall <<var;words=1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
    loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
    arising in any way out of the use of this software even if advised of the possibility of such damage"""
_ISC_GRANT = "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """the software is provided as is and <<var;words=1-6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
    in no event shall <<var;words=1-6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
    whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""

#: Whole texts of licenses, all mandatory clauses to the end; wording of the public licenses themselves.
WHOLE = {
    "mit": [f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"],
    "mit-0": [f"{_MIT_GRANT} {_MIT_WARRANTY}"],
    "json": [f"{_MIT_GRANT} {_MIT_NOTICE} the software shall be used for good not evil {_MIT_WARRANTY}"],
    "bsd-2-clause": [f"{_BSD_GRANT} {_BSD_WARRANTY}"],
    "bsd-3-clause": [f"{_BSD_GRANT} <<beginOptional>>3<<endOptional>> {_BSD_NAME} {_BSD_WARRANTY}"],
    "bsd-4-clause": [
        f"""{_BSD_GRANT} <<beginOptional>>3<<endOptional>> all advertising materials mentioning features or use of this software must display the following acknowledgement
        this product includes software developed by <<var;words=1-20>> <<beginOptional>>4<<endOptional>> {_BSD_NAME} {_BSD_WARRANTY}"""
    ],
    "isc": [f"{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies {_ISC_WARRANTY}"],
    "0bsd": [f"{_ISC_GRANT} {_ISC_WARRANTY}"],
    "zlib": [
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        <<beginOptional>>1<<endOptional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software
        if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        <<beginOptional>>2<<endOptional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        <<beginOptional>>3<<endOptional>> this notice may not be removed or altered from any source distribution"""
    ],
    "unlicense": [
        f"""this is free and unencumbered software released into the public domain
        anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
        in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
        we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
        we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_MIT_WARRANTY}"""
    ],
    "bsl-1.0": [
        """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software
        to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following
        the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part
        and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement
        in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software"""
    ],
}

#: First sentences and the like, which alone do not tell the license; their labels end in -fragment.
FRAGMENTS = {
    "apache-2.0": ["you may not use this <<var;words=1-2>> except in compliance with the license <<var;words=0-12>> you may obtain a copy of the license at"],
    "mit": [_MIT_GRANT],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "isc": [_ISC_GRANT],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

#: Families of licenses that notices name together with a version.
_GNU = {"general": ("gpl", "1 2 3"), "lesser general": ("lgpl", "2.1 3"), "library general": ("lgpl", "2"), "affero general": ("agpl", "1 3")}
_CC = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
_CC_WORDS = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
_CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
_VERSION = "<<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>>"
_TERMS = "<<beginOptional>>the terms of<<endOptional>>"


def _notices() -> dict[str, list[str]]:
    """Notices that name a license and its version."""
    out = {
        "apache-2.0": [f"licensed under the apache license {_VERSION} 2 <<beginOptional>>0<<endOptional>>", "apache license version 2 0", "spdx license identifier apache 2 0"],
        "mit": [f"<<var;words=0-1>> under {_TERMS} the mit license", "spdx license identifier mit"],
        "cc0-1.0": ["cc0 1 0 <<beginOptional>>universal<<endOptional>>"],
    }
    for name, version in (("mozilla", "1.1"), ("mozilla", "2.0"), ("eclipse", "1.0"), ("eclipse", "2.0")):
        spoken = " ".join(version.split("."))
        out[f"{name[0]}pl-{version}"] = [f"{name} public license {_VERSION} {spoken}", f"spdx license identifier {name[0]}pl {spoken}"]
    for clauses in "234":
        out[f"bsd-{clauses}-clause"] = [f"bsd {clauses} clause <<beginOptional>>license<<endOptional>>"]
    for name, (short, versions) in _GNU.items():
        for version in versions.split():
            spoken, label = " ".join(version.split(".")), f"{short}-{version}" if "." in version else f"{short}-{version}.0"
            whole = f"gnu {name} public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>>"
            forms = [f"under {_TERMS} the {whole} version {spoken}", f"{whole} v{version.split('.')[0]} {' '.join(version.split('.')[1:])}", f"spdx license identifier {short} {' '.join(label.rpartition('-')[2].split('.'))}"]
            out.setdefault(label, []).extend(forms)
            later = "<<beginOptional>>of the license<<endOptional>> or <<beginOptional>>at your option<<endOptional>> any later version"
            out.setdefault(f"{label}-or-later", []).extend([f"{forms[0]} {later}", f"{forms[2]} or later"])
    for kind in _CC:
        for version in _CC_VERSIONS.split():
            spoken = " ".join(version.split("."))
            named = " ".join(_CC_WORDS[k] for k in kind.split())
            out[f"cc-{kind.replace(' ', '-')}-{version}"] = [f"cc {kind} {spoken}", f"creative commons {named} {spoken} <<var;words=0-1>> <<beginOptional>>public<<endOptional>> license"]
    return out


def _templates() -> dict[str, list[str]]:
    out = {f"{label}-fragment": list(texts) for label, texts in FRAGMENTS.items()}
    for part in (WHOLE, _notices()):
        for label, texts in part.items():
            out.setdefault(label, []).extend(texts)
    return out


#: All templates by label.
TEMPLATES = _templates()

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>")


class Automaton:
    """Token automaton of many labelled templates; runs as sets of states."""

    def __init__(self, templates: dict[str, list[str]]):
        #: Per state: the word it waits for (None: any word), where that leads, and silent steps.
        self.word: list[str | None] = []
        self.next: list[int] = []
        self.silent: list[list[int]] = []
        self.accepts: dict[int, str] = {}
        starts = [(self._compile(text), label) for label, texts in templates.items() for text in texts]
        self.start = self._closure({s for s, _ in starts})
        self.first = {self.word[s] for s in self.start if self.word[s] is not None}
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.known = set(w for w in self.word if w is not None)

    def _state(self, word: str | None = "") -> int:
        self.word.append(word)
        self.next.append(-1)
        self.silent.append([])
        return len(self.word) - 1

    def _compile(self, text: str) -> int:
        start = at = self._state()
        open_at: list[int] = []
        place = 0

        def words(part: str) -> None:
            nonlocal at
            for w in WORD.findall(part.lower()):
                here, after = self._state(w), self._state()
                self.silent[at].append(here)
                self.next[here] = after
                at = after

        lead = True  # wildcards before the first word would only move the start
        for m in _MARKUP.finditer(text):
            words(text[place : m.start()])
            lead = lead and at == start
            if m[1] == "beginOptional":
                open_at.append(at)
            elif m[1] == "endOptional":
                if not open_at:
                    raise ValueError(f"endOptional without beginOptional: {text}")
                end = self._state()
                self.silent[at].append(end)
                self.silent[open_at.pop()].append(end)
                at = end
            elif not lead:
                end = self._state()
                for k in range(int(m[3])):
                    if k >= int(m[2]):
                        self.silent[at].append(end)
                    here, after = self._state(None), self._state()
                    self.silent[at].append(here)
                    self.next[here] = after
                    at = after
                self.silent[at].append(end)
                at = end
            place = m.end()
        words(text[place:])
        if open_at:
            raise ValueError(f"beginOptional without endOptional: {text}")
        self.accepts[at] = text
        return start

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.silent[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: str) -> frozenset[int]:
        """The states after one word; words of no template share one entry."""
        word = word if word in self.known else ""
        key = (states, word)
        if key not in self.steps:
            self.steps[key] = self._closure({self.next[s] for s in states if self.next[s] >= 0 and (self.word[s] is None or self.word[s] == word)})
        return self.steps[key]

    def accepted(self, words: list[str], at: int) -> set[str]:
        """Texts of the templates that run through from word ``at``."""
        out, states = set(), self.start
        for k in range(at, len(words)):
            states = self.step(states, words[k])
            if not states:
                break
            out.update(self.accepts[s] for s in states if s in self.accepts)
        return out


class Scanner:
    """Base phrases and templates over one text at a time."""

    def __init__(self, templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None):
        templates = TEMPLATES if templates is None else templates
        self.base = [(p.split(), label) for p, label in (BASE if base is None else base).items()]
        self.label = {}
        for label, texts in templates.items():
            for t in texts:
                self.label.setdefault(t, set()).add(label)
        self.automaton = Automaton(templates)
        self.starts = self.automaton.first | {p[0] for p, _ in self.base}

    def scan(self, text: str | None) -> tuple:
        # str.lower() would also change letters outside A-Z.
        words = WORD.findall((text or "").translate(_LOWER) if text and not text.isascii() else (text or "").lower())
        starts, places, base, more = self.starts, [], set(), set()
        for i in [i for i, w in enumerate(words) if w in starts]:
            for phrase, label in self.base:
                if words[i] == phrase[0] and words[i : i + len(phrase)] == phrase:
                    places.append(i)
                    base.add(label)
            if words[i] in self.automaton.first:
                for t in self.automaton.accepted(words, i):
                    more |= self.label[t]
        score = 1.0 if any(not x.endswith("-fragment") for x in more) else 0.5 if base or more else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


#: A-Z in lower case.
_LOWER = {c: c + 32 for c in range(65, 91)}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per input row: word count, base places and labels, all labels, score."""
    scanner = Scanner(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scanner.scan(x.as_py()) for x in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, schema)
