"""License scans: base phrases, and templates whose markup is compiled into token automata."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.blocks import chunks, narrow_batches, text_bytes
from textlake.llm.words import one_hash, word_hashes

# fixed values: phrases and their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# fixed values: wordings of licenses and notices. <<optional>> ... <<end>> may be missing,
# <<any N>> stands for up to N words of any wording; all else is mandatory.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files <<optional>> the software <<end>> to deal in the software without restriction including without "
            "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
            "permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
            "and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or "
            "substantial portions of the software the software is provided as is without warranty of any kind express or implied "
            "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no "
            "event shall <<any 12>> be liable for any claim damages or other liability whether in an action of contract tort or "
            "otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the <<optional>> terms of the <<end>> mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is "
            "and <<any 4>> disclaims all warranties with regard to this software including all implied warranties of merchantability "
            "and fitness in no event shall <<any 12>> be liable for any special direct indirect or consequential damages or any "
            "damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
            "tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met <<any 3>> redistributions of source code must retain the above copyright notice this list "
            "of conditions and the following disclaimer"),
    ("bsd-3", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
              "disclaimer in the documentation and or other materials provided with the distribution <<any 3>> neither the name of "
              "<<any 12>> nor the names of its contributors may be used to endorse or promote products derived from this software "
              "without specific prior written permission"),
    ("apache-2", "licensed under the apache license version 2 <<optional>> 0 <<end>> <<optional>> the license you may not use this "
                 "file except in compliance with the license <<end>>"),
    ("cc-by-nc", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by nc <<optional>> 4 0 <<end>>"),
    ("cc-by-nc", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> creative commons attribution noncommercial "
                 "<<optional>> 4 0 <<end>> <<optional>> international <<end>> license"),
    ("cc-by-sa", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by sa"),
    ("cc-by", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> creative commons attribution <<optional>> 4 0 <<end>> "
              "<<optional>> international <<end>> license"),
    ("gpl-3", "licensed under the <<optional>> terms of the <<end>> gnu general public license <<optional>> as published by the free "
              "software foundation <<end>> <<optional>> either <<end>> version 3"),
    ("gpl-2", "licensed under the <<optional>> terms of the <<end>> gnu general public license <<optional>> as published by the free "
              "software foundation <<end>> <<optional>> either <<end>> version 2"),
    *((label, f"redistribute it and or modify it under the terms of {name} as published by the free software foundation "
              f"<<optional>> either <<end>> version {version} of the license")
      for label, name, version in [("gpl-2", "the gnu general public license", "2"), ("lgpl-2", "the gnu library general public license", "2"),
                                   ("lgpl-2.1", "the gnu lesser general public license", "2 1"),
                                   ("lgpl-3", "the gnu lesser general public license", "3"), ("agpl-3", "the gnu affero general public license", "3")]),
    ("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
              "foundation either version 3 of the license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved <<any 6>> no part of this <<any 4>> may be reproduced"),
]

_MARK = re.compile(r"<<(optional|end|any \d+)>>")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """Token automaton of one template.

    State i has ``steps[i]`` (word hash -> next), ``skips[i]`` (states reached without a word)
    and ``wild[i]`` (a next state for any word). ``head`` holds the opening mandatory words.
    """

    def __init__(self, markup: str):
        self.steps: list[dict[int, int]] = [{}]
        self.skips: list[list[int]] = [[]]
        self.wild: list[int | None] = [None]
        opened, self.head, plain, at = [], [], True, 0
        for piece in _pieces(markup):
            if piece == "optional":
                opened.append(at)
                plain = False
            elif piece == "end":
                start = opened.pop()
                at = self._state(at, None)
                self.skips[start].append(at)
            elif piece.startswith("any "):
                plain, stops = False, [at]
                for _ in range(int(piece[4:])):
                    nxt = self._state()
                    self.wild[at] = nxt
                    at = nxt
                    stops.append(at)
                end = self._state()
                for state in stops:
                    self.skips[state].append(end)
                at = end
            else:
                nxt = self._state()
                self.steps[at][int(one_hash(piece))] = nxt
                at = nxt
                if plain:
                    self.head.append(one_hash(piece))
        if opened or len(self.head) < 2:
            raise ValueError("a template opens with two mandatory words and closes its regions: " + markup[:60])
        self.final, self.longest = at, len(self.steps)

    def _state(self, before: int | None = None, _=None) -> int:
        self.steps.append({})
        self.skips.append([])
        self.wild.append(None)
        if before is not None:
            self.skips[before].append(len(self.steps) - 1)
        return len(self.steps) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for nxt in self.skips[todo.pop()]:
                if nxt not in states:
                    states.add(nxt)
                    todo.append(nxt)
        return states

    def accepts(self, words: list[int]) -> int:
        """Words of the longest accepted opening, 0 if none is accepted."""
        states, best = self._closed({0}), 0
        for n, word in enumerate(words, 1):
            following = {self.steps[s][word] for s in states if word in self.steps[s]}
            following |= {self.wild[s] for s in states if self.wild[s] is not None}
            if not following:
                break
            states = self._closed(following)
            if self.final in states:
                best = n
        return best


def _pieces(markup: str) -> list[str]:
    out = []
    for i, part in enumerate(_MARK.split(markup)):
        out += [part] if i % 2 else [w.decode() for w in _WORD.findall(part.encode().lower())]
    return out


def places(words: np.ndarray, at: np.ndarray, phrase: list[np.uint64]) -> np.ndarray:
    """Starts of all places where the phrase stands inside one text."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = np.flatnonzero(words[:n] == phrase[0])
    for k, word in enumerate(phrase[1:], 1):
        found = found[words[found + k] == word]
    return found[at[np.searchsorted(at, found, side="right")] >= found + len(phrase)]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Licenses of every whole text; one narrow pass, nothing is shuffled.

    ``base_labels`` come from phrases, ``labels`` also from accepted templates; ``score`` is 1
    with an accepted template, 0.5 with a phrase only, else 0. ``matched_words`` counts the words
    that accepted templates cover, places counted apart. Null or empty text has no words and
    no labels; a null doc_id and repeated rows are kept as they are.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES

    def run(batches):
        base = [([one_hash(w.decode()) for w in _WORD.findall(p.encode().lower())], label) for p, label in phrases.items()]
        automata = [(Automaton(markup), label) for label, markup in templates]
        for batch in chunks(batches):
            words, at = word_hashes(*text_bytes(batch.column("text")), "punctuation")
            n = batch.num_rows
            n_base, first, last, covered = np.zeros(n, np.int64), np.full(n, 1 << 60), np.full(n, -1), np.zeros(n, np.int64)
            labels: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in base:
                found = places(words, at, phrase)
                doc = np.searchsorted(at, found, side="right") - 1
                np.add.at(n_base, doc, 1)
                np.minimum.at(first, doc, found - at[doc])
                np.maximum.at(last, doc, found - at[doc])
                for d in set(doc.tolist()):
                    labels[d].add(label)
            base_labels = [",".join(sorted(x)) for x in labels]
            for automaton, label in automata:
                found = places(words, at, automaton.head[:2])
                doc = np.searchsorted(at, found, side="right") - 1
                for d, start in zip(doc.tolist(), found.tolist()):
                    size = automaton.accepts(words[start:min(at[d + 1], start + automaton.longest)].tolist())
                    if size:
                        labels[d].add(label)
                        covered[d] += size
            score = np.where(covered > 0, 1.0, np.where(n_base > 0, 0.5, 0.0))
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                 pa.array(base_labels, pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score), pa.array(covered)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matched_words"])
    narrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
             "score double, matched_words long")
