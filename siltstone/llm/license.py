"""License scans by template-markup matching.

A template is wording with ``<<beginOptional>> .. <<endOptional>>`` regions and replaceable
``<<var;name=..;max=N>>`` regions of at most N words. It is compiled into a token automaton; a text is
accepted where the mandatory wording stands exactly, word by word, with optional regions there or not.

``TEXTS`` are whole licences, from their grant to the end of their disclaimer: a licence that is cut off or altered
is not accepted. ``NOTICES`` are the sentences by which a work refers to its licence, a weaker finding. Beside
them, fixed phrases are looked up as base findings.

Results: null text is empty; without words nothing is found. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import map_batches
from siltstone.llm.decontam import words_of

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Disclaimers that several licences share.
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY <<var;name=holder;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=holder;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=holder;max=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=holder;max=12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this <<var;name=work;max=3>> software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
BSD_GRANT = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
ISC_GRANT = 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted'
#: Fixed values: (label, whole licence with markup).
TEXTS = [
    ("mit", f"{MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. {AS_IS}"),
    ("mit-0", f"{MIT_GRANT}. {AS_IS}"),
    ("bsd-2-clause", f"{BSD_GRANT} {BSD_AS_IS}"),
    ("bsd-3-clause", f"{BSD_GRANT} <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=organization;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD_AS_IS}"),
    ("isc", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_AS_IS}"),
    ("0bsd", f"{ISC_GRANT}. {ISC_AS_IS}"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."),
    ("unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {AS_IS}"),
    ("bsl-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
]
#: Fixed values: (label, notice with markup).
NOTICES = [
    ("mit", "<<beginOptional>>This <<var;name=work;max=3>> is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("mit", "licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("apache", "Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>, Version 2.0 <<beginOptional>>(the \"License\"); you may not use this file except in compliance with the License<<endOptional>><<endOptional>>"),
    ("gpl", "This <<var;name=work;max=3>> is licensed under the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License <<beginOptional>>, version <<var;name=version;max=2>><<endOptional>>"),
    ("gpl", "This program is free software <<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC <<beginOptional>>4.0<<endOptional>>"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution NonCommercial <<var;name=version;max=3>> License"),
    ("cc-by-sa", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-SA <<beginOptional>>4.0<<endOptional>>"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License <<beginOptional>>, v. 2.0<<endOptional>>"),
]
MARKUP = re.compile(r"<<(beginOptional|endOptional|var[^>]*)>>")


@dataclass
class Template:
    """An automaton: for each state its word edges, its any-word edge and the states it reaches freely."""

    label: str
    whole: bool
    words: list[dict[bytes, int]]
    any_word: list[int | None]
    free: list[list[int]]
    end: int

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen

    def accepts_from(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted run of words from ``at``."""
        states, best = self.closure({0}), None
        while states:
            if self.end in states:
                best = at
            if at == len(words):
                break
            word = words[at]
            states = self.closure({to for s in states for to in (self.words[s].get(word), self.any_word[s]) if to is not None})
            at += 1
        return best

    def openings(self) -> set[bytes | None]:
        states = self.closure({0})
        return {word for s in states for word in self.words[s]} | ({None} if any(self.any_word[s] is not None for s in states) else set())


def compile_template(label: str, markup: str, whole: bool = False) -> Template:
    words, any_word, free = [{}], [None], [[]]

    def state() -> int:
        words.append({})
        any_word.append(None)
        free.append([])
        return len(words) - 1

    at, opened = 0, []
    for k, part in enumerate(MARKUP.split(markup)):
        if k % 2 == 0:
            for word in words_of(part):
                words[at][word] = to = state()
                at = to
        elif part == "beginOptional":
            opened.append(at)
            to = state()
            free[at].append(to)
            at = to
        elif part == "endOptional":
            to = state()
            free[at].append(to)
            free[opened.pop()].append(to)
            at = to
        else:
            most = int(dict(x.split("=", 1) for x in part.split(";")[1:]).get("max", "1"))
            end = state()
            free[at].append(end)
            for _ in range(most):
                any_word[at] = to = state()
                free[to].append(end)
                at = to
            at = end
    if opened:
        raise ValueError(f"a region of the template {label} is not closed")
    return Template(label, whole, words, any_word, free, at)


class Scanner:
    def __init__(self, texts=TEXTS, notices=NOTICES, phrases=PHRASES):
        self.templates = [compile_template(*t, whole) for found, whole in ((texts, True), (notices, False)) for t in found]
        self.by_opening: dict[bytes, list[Template]] = {}
        for template in self.templates:
            first = template.openings()
            if None in first or template.accepts_from([], 0) is not None:
                raise ValueError(f"a template of {template.label} has no mandatory first word")
            for word in first:
                self.by_opening.setdefault(word, []).append(template)
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.phrase_heads = {p[0] for p, _ in self.phrases}

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, bool]], list[tuple[int, int, str, bool]]]:
        """Words, base places and accepted template runs, each (start, end, label, whether it is a whole licence) in words."""
        words = words_of(text)
        known = set(words)
        base, accepted = [], []
        for phrase, label in self.phrases:
            if known.issuperset(phrase):
                for at in _places(words, phrase[0]):
                    if words[at : at + len(phrase)] == phrase:
                        base.append((at, at + len(phrase), label, False))
        for opening in self.by_opening.keys() & known:
            for at in _places(words, opening):
                for template in self.by_opening[opening]:
                    end = template.accepts_from(words, at)
                    if end is not None:
                        accepted.append((at, end, template.label, template.whole))
        return len(words), sorted(base), sorted(accepted)


def _places(words: list[bytes], word: bytes) -> Iterator[int]:
    at = -1
    while True:
        try:
            at = words.index(word, at + 1)
        except ValueError:
            return
        yield at


_SCANNER: list[Scanner] = []


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, base, accepted)``; base and accepted list runs of words with their labels."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("whole", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        rows = lambda runs: [{"start": s, "end": e, "label": label, "whole": whole} for s, e, label, whole in runs]
        for batch in batches:
            found = [_SCANNER[0].scan(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([rows(f[1]) for f in found], run_type), pa.array([rows(f[2]) for f in found], run_type)], ["doc_id", "n_words", "base", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = "array<struct<start:long,end:long,label:string,whole:boolean>>"
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, base {runs}, accepted {runs}")
