"""Licence scan by a positional rare-token index (operator 2).

The index holds, for each passage of a licence, the positions of its
``INDEXED`` rarest words; rarity is the inverse document frequency over the whole
corpus, counted in one pass over the words that passages use (a bounded
vocabulary).  Each file looks up the ``LOOKUPS`` rarest of the indexed words that
it holds.  A posting proposes the place where the passage would start, equal
proposals are counted, and a place is accepted if enough of the words that the
file looked up agree on it (``AGREE``) and the passage's key phrase stands there
word by word.  Licences are held paragraph by paragraph, so a name put into one
does not move the others.

The base phrases are passages whose key phrase is the phrase: their rarest word is
looked up in every file and proposes every place, so no place is lost.

Everything is one projection of built-in functions over whole texts: no
shuffle apart from the word counts, no user functions, time in proportion to a
text's words (sorting only the few proposals).

Edge cases: a null text has no words; without a place first_word and last_word
are null, labels empty and score 0; words of equal rarity are taken in the order
of their letters; repeated rows are scanned one by one; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

INDEXED = 12
LOOKUPS = 16
AGREE = 0.6
#: Words that must agree on a place at least, where a passage has so many in the index.
LEAST = 2
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Passage(NamedTuple):
    label: str
    text: str
    key: str
    base: bool = False


#: Base phrases, then the wording of licences by paragraph, each with its mandatory phrase.
PASSAGES = (
    Passage("gpl", "gnu general public license", "gnu general public license", True),
    Passage("apache", "apache license", "apache license", True),
    Passage("cc-by", "cc by", "cc by", True),
    Passage("mit", "mit license", "mit license", True),
    Passage("gpl-2.0", "licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    Passage("gpl-3.0", "licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    Passage("lgpl", "licensed under the GNU Lesser General Public License, version", "gnu lesser general public license"),
    Passage("agpl", "licensed under the GNU Affero General Public License, version", "gnu affero general public license"),
    Passage("apache-2.0", "licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    Passage("cc-by-4.0", "licensed under CC BY 4.0", "cc by 4 0"),
    Passage("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    Passage("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    Passage("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", "cc0 1 0"),
    Passage("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "permission is hereby granted free of charge"),
    Passage("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "included in all copies or substantial portions"),
    Passage("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "fitness for a particular purpose and noninfringement"),
    Passage("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution and use in source and binary forms"),
    Passage("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "redistributions of source code must retain"),
    Passage("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions in binary form must reproduce"),
    Passage("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "endorse or promote products derived from this software"),
    Passage("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", "incidental special exemplary or consequential damages"),
    Passage("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "with or without fee is hereby granted"),
    Passage("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", "disclaims all warranties with regard to this software"),
    Passage("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "provided as is without any express or implied warranty"),
    Passage("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "to alter it and redistribute it freely"),
    Passage("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software released into the public domain"),
    Passage("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "either in source code form or as a compiled binary"),
    Passage("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", "accompanying documentation covered by this license"),
    Passage("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache license version 2 0"),
    Passage("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "unless required by applicable law or agreed to in writing"),
    Passage("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "either version 2 of the license"),
    Passage("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "either version 3 of the license"),
    Passage("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version", "gnu lesser general public license"),
    Passage("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "gnu affero general public license"),
    Passage("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla public license"),
    Passage("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "eclipse public license"),
)


def plain_words(text: str) -> list[str]:
    """The words of a passage; its letters are ASCII."""
    return _WORD.findall(text.lower())


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    # The two letters outside ASCII whose lower case is in ASCII must stay outside.
    safe = F.lower(F.regexp_replace(text, "[\u212a\u0130]", "\u00e9"))
    return F.regexp_extract_all(safe, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def word_rarity(docs: DataFrame, passages: Sequence[Passage] = PASSAGES) -> dict[str, float]:
    """IDF over all documents of the words that passages use (at most a few hundred)."""
    vocabulary = sorted({w for p in passages for w in plain_words(p.text)})
    found = docs.select(F.explode(F.array_append(F.array_intersect(words_of(text_or_empty()), F.array(*map(F.lit, vocabulary))), "")).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row per word of the vocabulary
    return {w: math.log((1 + counts.get("", 0)) / (1 + counts.get(w, 0))) for w in vocabulary}


def rarest(words: Sequence[str], rarity: dict[str, float], n: int) -> list[str]:
    return sorted(set(words), key=lambda w: (-rarity[w], w))[:n]


def build_index(rarity: dict[str, float], passages: Sequence[Passage] = PASSAGES) -> list[list[tuple[str, int]]]:
    """For each passage its rarest words with their positions; one word for a base phrase."""
    index = []
    for p in passages:
        words = plain_words(p.text)
        chosen = rarest(words, rarity, 1 if p.base else INDEXED)
        index.append([(w, k) for k, w in enumerate(words) if w in chosen])
    return index


def key_place(p: Passage) -> int:
    """Where a passage's key phrase stands in it."""
    words, key = plain_words(p.text), p.key.split()
    return next(k for k in range(len(words)) if words[k : k + len(key)] == key)


def _array(values: Sequence) -> str:
    return f"array({', '.join(map(str, values))})"


def _quoted(words: Sequence[str]) -> str:
    return _array([f"'{w}'" for w in words])


def scan(docs: DataFrame, passages: Sequence[Passage] = PASSAGES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    rarity = word_rarity(docs, passages)
    index = build_index(rarity, passages)
    ranked = rarest([w for entries in index for w, _ in entries], rarity, len(rarity))
    entries = {r: [] for r in range(1, len(ranked) + 1)}
    for t, of in enumerate(index):
        for w, k in of:
            entries[ranked.index(w) + 1].append((t, k))
    postings = {
        kind: _array(_array([f"struct({t} AS t, {k} AS k)" for t, k in e if passages[t].base == base] or ["struct(-1 AS t, 0 AS k)"]) for e in entries.values())
        for kind, base in (("base", True), ("own", False))
    }
    keys = _array(_quoted(p.key.split()) for p in passages)
    at, is_base = _array(map(key_place, passages)), _array(str(p.base).lower() for p in passages)
    least = _array(min(LEAST, len(of)) for of in index)
    labels = _quoted([p.label for p in passages])
    listed = ", ".join(f"'{w}'" for w in ranked)

    out = docs.select("doc_id", words_of(text_or_empty()).alias("w"))
    # Occurrences of indexed words: rank by rarity and place.
    found = f"filter(transform(w, (x, i) -> struct(x AS x, i AS i)), h -> h.x IN ({listed}))"
    hits = f"transform({found}, h -> struct(array_position({_quoted(ranked)}, h.x) AS r, h.i AS i))"
    out = out.withColumn("hits", F.expr(f"if(arrays_overlap(w, array({listed})), {hits}, array())"))
    # The file's rarest words among those that passages of licences are looked up by.
    own_ranks = _array(r for r, e in entries.items() if any(not passages[t].base for t, _ in e)) if any(not p.base for p in passages) else "array(-1)"
    out = out.withColumn("looked", F.expr(f"slice(array_sort(array_intersect(transform(hits, h -> CAST(h.r AS int)), {own_ranks})), 1, {LOOKUPS})"))
    base = f"flatten(transform(hits, h -> transform(element_at({postings['base']}, CAST(h.r AS int)), p -> struct(p.t AS t, h.i - p.k AS s))))"
    chosen = "filter(hits, h -> array_contains(looked, CAST(h.r AS int)))"
    own = f"flatten(transform({chosen}, h -> transform(element_at({postings['own']}, CAST(h.r AS int)), p -> struct(p.t AS t, h.i - p.k AS s))))"
    out = out.withColumn("proposed", F.expr(f"array_sort(filter(concat({base}, {own}), p -> p.t >= 0))"))
    ends = "filter(sequence(1, size(proposed)), j -> j = size(proposed) OR proposed[j] <> proposed[j - 1])"
    out = out.withColumn("ends", F.expr(f"if(size(proposed) > 0, {ends}, array())"))
    out = out.withColumn(
        "places",
        F.expr("transform(ends, (e, k) -> struct(proposed[e - 1].t AS t, proposed[e - 1].s AS s, e - if(k = 0, 0, ends[k - 1]) AS n))"),
    )
    stands = f"p.s + {at}[p.t] >= 0 AND slice(w, greatest(p.s + {at}[p.t] + 1, 1), size({keys}[p.t])) = {keys}[p.t]"
    out = out.withColumn("places", F.expr(f"filter(places, p -> p.n >= {least}[p.t] AND {stands})"))
    # How many postings of the passage the file looked up.
    asked = f"if({is_base}[p.t], p.n, aggregate(looked, 0, (a, r) -> a + size(filter(element_at({postings['own']}, r), q -> q.t = p.t))))"
    out = out.withColumn("places", F.expr(f"transform(places, p -> struct(p.t AS t, p.s AS s, p.n AS n, {asked} AS asked))"))
    out = out.withColumn("places", F.expr(f"filter(places, p -> p.n >= {AGREE}D * p.asked)"))
    out = out.withColumn("base", F.expr(f"filter(places, p -> {is_base}[p.t])"))
    label = f"p -> {labels}[p.t]"
    made = {
        "n_words": F.expr("CAST(size(w) AS long)"),
        "n_base": F.expr("CAST(size(base) AS long)"),
        "first_word": F.expr("CAST(array_min(transform(base, p -> p.s)) AS long)"),
        "last_word": F.expr("CAST(array_max(transform(base, p -> p.s)) AS long)"),
        "base_labels": F.expr(f"array_join(array_sort(array_distinct(transform(base, {label}))), ',')"),
        "labels": F.expr(f"array_join(array_sort(array_distinct(transform(places, {label}))), ',')"),
        "score": F.expr(f"coalesce(array_max(transform(places, p -> if({is_base}[p.t], 0.5D, CAST(p.n AS double) / p.asked))), 0.0D)"),
    }
    # One row in, one row out; keeps a later filter from making the arrays again.
    return out.select("doc_id", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("m")).select("doc_id", "m.*")
