"""License scans: templates with optional and replaceable regions, compiled into automata over words.

In a template, `[[...]]` encloses wording that may be missing and `<<n>>` stands for up to n words of any kind. All
other wording is mandatory and must stand in the text word for word (A-Z lower-cased, punctuation and layout ignored).
A text is looked at only around the places where the template's longest mandatory run stands; these are found for all
texts of a batch at once by comparing word hashes, and every place found is then compared word by word: nothing is
accepted by a hash alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .shared import small_batches

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY <<12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL <<12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "[[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "[[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)

#: Short notices, and the wording of well-known licenses, as templates.
TEMPLATES = {
    "bsd-2-clause-text": _TWO_CLAUSES + _AS_IS,
    "bsd-3-clause-text": _TWO_CLAUSES + "[[3.]] Neither the name of <<12>> nor the names of [[its]] [[the]] contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    "isc-text": (
        "Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND <<8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL <<8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL <<8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "apache-2.0": "licensed under the Apache License, Version 2.0 [[(the \"License\"); you may not use this file except in compliance with the License]]",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "[[this work is]] licensed under [[a]] [[the]] CC BY 4.0 [[International]] [[License]]",
    "cc-by-nc-4.0": "[[this work is]] licensed under [[a]] [[the]] CC BY-NC 4.0 [[International]] [[License]]",
    "cc-by-sa-4.0": "[[this work is]] licensed under [[a]] [[the]] CC BY-SA 4.0 [[International]] [[License]]",
    "copyright-notice": "Copyright [[(c)]] <<8>> All rights reserved",
    "gpl-3.0": "licensed under the [[terms of the]] GNU General Public License, version 3 [[or]] [[(at your option) any later version]]",
    "mit": "[[released]] [[licensed]] under [[the]] [[terms of the]] MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software [[, and to permit persons to whom the Software is furnished to do so]]",
}


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(data: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return _WORD.findall(data.lower())  # of bytes, lower() changes A-Z only


def word_hashes(words: list[bytes]) -> list[int]:
    data = np.frombuffer(b" ".join(words), np.uint8)
    return arrays.Words(data, np.array([0, len(data)]), arrays.ALNUM_WORD).hashes.tolist()


def compile_template(template: str) -> list[tuple]:
    """Steps of the automaton: ("word", word), ("maybe", steps) or ("any", most words)."""
    steps: list[tuple] = []
    for maybe, most, plain in re.findall(r"\[\[(.*?)\]\]|<<(\d+)>>|((?:(?!\[\[|<<).)+)", template, re.DOTALL):
        if most:
            steps.append(("any", int(most)))
        elif maybe:
            steps.append(("maybe", [("word", w) for w in words_of(maybe.encode())]))
        else:
            steps += [("word", w) for w in words_of(plain.encode())]
    if not any(kind == "word" for kind, _ in steps):
        raise ValueError("a template needs mandatory wording")
    return steps


def ends(steps: list[tuple], words: list[bytes], starts: set[int]) -> set[int]:
    """Where the automaton can stand after all steps, from any of the starts."""
    at = starts
    for kind, what in steps:
        if kind == "word":
            at = {p + 1 for p in at if p < len(words) and words[p] == what}
        elif kind == "maybe":
            at = at | ends(what, words, at)
        else:
            at = {p + j for p in at for j in range(what + 1) if p + j <= len(words)}
        if not at:
            break
    return at


def _anchor(steps: list[tuple]) -> tuple[list[bytes], int, int]:
    """The longest mandatory run, and the fewest and most words that stand before it."""
    best, run, low, high, at = ([], 0, 0), [], 0, 0, (0, 0)
    for kind, what in [*steps, ("end", 0)]:
        if kind == "word":
            at = (low, high) if not run else at
            run.append(what)
            low, high = low + 1, high + 1
            continue
        if len(run) > len(best[0]):
            best = (run, *at)
        run = []
        high += len(what) if kind == "maybe" else what
    return best


def places(words: arrays.Words, phrase: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Text and start word (counted over all texts) of every place where words with the phrase's hashes stand in one text."""
    h, k = words.hashes, len(phrase)
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = h[: len(h) - k + 1] == np.uint64(phrase[0])
    for j in range(1, k):
        found &= h[j : len(h) - k + 1 + j] == np.uint64(phrase[j])
    at = np.flatnonzero(found)
    text = np.searchsorted(words.first, at, side="right") - 1
    inside = at + k <= words.first[text + 1]
    return text[inside], at[inside]


def _scan(phrases: dict[str, str], templates: dict[str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [(label, w, word_hashes(w)) for label, w in ((label, words_of(phrase.encode())) for phrase, label in phrases.items())]
        compiled = [(label, steps, *_anchor(steps)) for label, steps in ((x, compile_template(t)) for x, t in templates.items())]
        compiled = [(label, steps, run, word_hashes(run), low, high) for label, steps, run, low, high in compiled]
        for batch in arrays.slices(batches):
            data, offsets = arrays.text_bytes(batch.column(1))
            words = arrays.Words(data, offsets, arrays.ALNUM_WORD)
            split: dict[int, list[bytes]] = {}

            def own(i: int, data=data, offsets=offsets, split=split) -> list[bytes]:
                """The words of a text in which something was found."""
                if i not in split:
                    split[i] = words_of(data[offsets[i] : offsets[i + 1]].tobytes())
                return split[i]

            def said(wanted: list[bytes], hashes: list[int], words=words, own=own) -> tuple[np.ndarray, np.ndarray]:
                """Texts and places (from 0 in each text) where the wanted words stand."""
                text, at = places(words, hashes)
                at = at - words.first[text]
                right = np.array([own(i)[a : a + len(wanted)] == wanted for i, a in zip(text.tolist(), at.tolist(), strict=True)], bool)
                return text[right], at[right]

            rows = batch.num_rows
            n_base = np.zeros(rows, np.int64)
            first = np.full(rows, np.iinfo(np.int64).max)
            last = np.full(rows, -1)
            base_labels: list[set] = [set() for _ in range(rows)]
            labels: list[set] = [set() for _ in range(rows)]
            for label, phrase, hashes in base:
                text, at = said(phrase, hashes)
                np.add.at(n_base, text, 1)
                np.minimum.at(first, text, at)
                np.maximum.at(last, text, at)
                for i in np.unique(text).tolist():
                    base_labels[i].add(label)
            for label, steps, run, hashes, low, high in compiled:
                for i, at in zip(*(x.tolist() for x in said(run, hashes)), strict=True):
                    if label not in labels[i] and ends(steps, own(i), set(range(max(0, at - high), at - low + 1))):
                        labels[i].add(label)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(n_base),
                    pa.array(first, pa.int64(), mask=none),
                    pa.array(last, pa.int64(), mask=none),
                    pa.array([",".join(sorted(x)) for x in base_labels], pa.string()),
                    pa.array([",".join(sorted(x | y)) for x, y in zip(base_labels, labels, strict=True)], pa.string()),
                    pa.array([1.0 if y else 0.5 if x else 0.0 for x, y in zip(base_labels, labels, strict=True)], pa.float64()),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return scan


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the phrases; first_word and last_word are the smallest and largest start of one (words
    from 0), null without one. labels adds the templates that the text matches. score is 1 if a template matches, 0.5
    if only phrases do, else 0. Null and empty texts have no words and no labels. Rows are judged one by one, repeated
    ones too; a null doc_id is carried along; further columns are ignored; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan(phrases, templates), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
