"""Licence scans with a positional rare-token index, in DataFrame functions only.

A first pass counts in how many documents each template word occurs.  Key
phrases are posted under their two words of highest inverse document frequency,
with their offsets.  A file looks up the places of posted words, each gives
phrase starts, the starts that both words agree on are intersected, and there
the whole phrase is compared.  An occurrence of a phrase has both words at their
offsets, so none is missed.

The templates are those of this module or a user's (``Templates``, also from a table).
Licence texts and notices are posted under their ``ANCHORS`` rarest words of
those that stand in them once; of equally rare ones, the earlier.  Each place of
an anchor votes for the start of the text.  A text is found where the share
``AGREE`` of its anchors vote for starts in the same two adjoining stretches of
``STRETCH`` words, so changed, added and missing words are tolerated, and where
its mandatory phrases stand word for word in that region.

Everything is row-local; only the counts of template words (a bounded list)
are aggregated and brought to the driver.

Null and empty texts have no words, no labels and score 0.  Repeated rows give a
row each.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases, fixed by the contract: label, words.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Phrases of further licences; a label may have several.
MORE = [
    ("mit", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("bsd", "the bsd license"),
    ("mpl-2", "mozilla public license version 2"),
    ("epl-2", "eclipse public license v 2"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("cc-by", "creative commons attribution"),
    ("cc0", "cc0 1 0 universal"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("boost", "boost software license version 1 0"),
    ("reserved", "all rights reserved"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("mpl-2", "mozilla public license v 2"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl", "spdx license identifier gpl"),
    ("lgpl", "spdx license identifier lgpl"),
    ("agpl", "spdx license identifier agpl"),
    ("bsd", "spdx license identifier bsd"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
    ("epl-2", "spdx license identifier epl 2 0"),
    ("isc", "spdx license identifier isc"),
    ("zlib", "spdx license identifier zlib"),
    ("boost", "spdx license identifier bsl 1 0"),
    ("unlicense", "spdx license identifier unlicense"),
    ("cc0", "spdx license identifier cc0 1 0"),
]
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by
the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE."""
#: Licence texts (their granting parts) and notices as published: label, text, two mandatory phrases.
TEXTS = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software.""",
        ("without restriction", "permission notice"),
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.""",
        ("source and binary forms", "above copyright notice"),
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
        ("with or without fee", "permission notice"),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of
this software must not be misrepresented; you must not claim that you wrote the original software.""",
        ("redistribute it freely", "must not be misrepresented"),
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied.""",
        ("apache", "in compliance with the license"),
    ),
    ("gpl", _GNU.format("General Public License", 3), ("gnu general public license", "free software foundation")),
    ("lgpl", _GNU.format("Lesser General Public License", 3), ("gnu lesser general public license", "free software foundation")),
    ("agpl", _GNU.format("Affero General Public License", 3), ("gnu affero general public license", "free software foundation")),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ("mozilla public license", "2 0"),
    ),
    (
        "epl-2",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/""",
        ("eclipse public license", "2 0"),
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
        ("unencumbered software", "public domain"),
    ),
    (
        "boost",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so.""",
        ("person or organization", "derivative works"),
    ),
]
ANCHORS = 12  # rare words that a licence text is posted under
AGREE = 0.6  # of them have to stand at their places
STRETCH = 32  # words
_BIAS = 64  # starts of texts cut off at the front are negative
TEXTS_TYPE = "array<struct<k:int,stretch:int,n:int>>"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SHIFT = 1 << 32


def words(text: str | Column = "text") -> Column:
    lower = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, _GAP), "")


@dataclass(frozen=True)
class Templates:
    """What to look for: (label, phrase) pairs, of which the ``base`` ones give places, and (label, text, its two mandatory phrases)."""

    base: list[tuple[str, str]]
    more: list[tuple[str, str]]
    texts: list[tuple[str, str, tuple[str, str]]]

    @classmethod
    def of(cls, table: DataFrame) -> Templates:
        """From a table (label, text, phrases): rows with two phrases are licence texts, others phrases that stand word for word.  Templates are few: they are collected."""
        rows = sorted(((r["label"], r["text"], tuple(r["phrases"] or ())) for r in table.select("label", "text", "phrases").collect()), key=repr)
        worded = [(label, " ".join(text_words(text)), phrases) for label, text, phrases in rows if label and text]
        return cls([], [(label, text) for label, text, phrases in worded if not phrases and text], [(label, text, tuple(" ".join(text_words(p)) for p in (phrases * 2)[:2])) for label, text, phrases in worded if phrases and text])


@dataclass
class Index:
    labels: list[str]
    phrases: list[list[str]]
    base: list[bool]
    weights: list[float]  # of each phrase, 0 to 1: the share of the largest sum of IDF
    posted: list[dict[str, list[tuple[int, int]]]]  # first and second rarest word -> (phrase, offset)
    anchors: list[list[tuple[str, int]]]  # of each licence text: words and their places
    texts: list[tuple[str, str, tuple[str, str]]]

    @classmethod
    def build(cls, n_docs: int, frequency: dict[str, int], templates: Templates) -> Index:
        rows = [(label, phrase.split(), True) for label, phrase in templates.base] + [(label, phrase.split(), False) for label, phrase in templates.more]
        idf = lambda w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1))
        totals = [sum(map(idf, dict.fromkeys(p))) for _, p, _ in rows]
        posted: list[dict[str, list[tuple[int, int]]]] = [{}, {}]
        for k, (_, phrase, _) in enumerate(rows):
            rare = sorted(dict.fromkeys(phrase), key=lambda w: (-idf(w), phrase.index(w)))
            for part, w in zip(posted, (rare * 2)[:2]):
                part.setdefault(w, []).append((k, phrase.index(w)))
        top = max(totals, default=0.0) or 1.0
        anchors = []
        for _, text, _ in templates.texts:
            own = text_words(text)
            once = [(w, i) for i, w in enumerate(own) if own.count(w) == 1]
            anchors.append(sorted(once, key=lambda x: (frequency.get(x[0], 0), x[1]))[:ANCHORS])
        return cls([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [t / top for t in totals], posted, anchors, list(templates.texts))


def text_words(text: str) -> list[str]:
    """Words of a template, as ``words`` takes them from documents."""
    return [w for w in re.split(_GAP, text.lower()) if w]


def vocabulary(templates: Templates) -> list[str]:
    return sorted({w for _, p in templates.base + templates.more for w in p.split()} | {w for _, t, _ in templates.texts for w in text_words(t)})


#: The templates of this module.
STANDARD = Templates(BASE, MORE, TEXTS)


def needed(anchors: list) -> int:
    return math.ceil(AGREE * len(anchors))


def build_index(docs: DataFrame, templates: Templates | None = None) -> Index:
    templates = templates or STANDARD
    known = F.array(*map(F.lit, vocabulary(templates)))
    found = docs.select(F.explode(F.array_intersect(words(), known)).alias("word")).groupBy("word").count()
    return Index.build(docs.count(), {r["word"]: r["count"] for r in found.collect()}, templates)


def _starts(hits: Column, posted: dict[str, list[tuple[int, int]]]) -> Column:
    """phrase * 2**32 + start for each hit of a posted word."""
    out = F.array().cast("array<bigint>")
    for word, places in sorted(posted.items()):
        own = F.filter(hits, lambda h: h["w"] == word)
        for k, offset in places:
            out = F.concat(out, F.transform(F.filter(own, lambda h: h["i"] >= offset), lambda h: (F.lit(k * _SHIFT) + h["i"] - F.lit(offset)).cast("bigint")))
    return out


def _texts_found(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` (with words ``w`` and ``hits``) and ``texts``: the (k, agreed) of each licence text and region where it is found."""
    marks = sorted({w for own in index.anchors for w, _ in own})
    if not marks:
        return rows.withColumn("texts", F.array().cast(TEXTS_TYPE))
    least = min(needed(own) for own in index.anchors if own)
    places = {m: ", ".join(f"named_struct('k', {k}, 'j', {j}, 'i', {i})" for k, own in enumerate(index.anchors) for j, (w, i) in enumerate(own) if w == m) for m in marks}
    postings = F.expr(f"map({', '.join(f"'{m}', array({p})" for m, p in places.items())})")
    needs = F.array(*(F.lit(needed(own)) for own in index.anchors))
    lengths = F.array(*(F.lit(len(text_words(t)) + 3 * STRETCH) for _, t, _ in index.texts))
    keys = [F.array(*(F.lit(f" {key[n]} ") for _, _, key in index.texts)) for n in (0, 1)]
    none = F.array().cast("array<bigint>")

    def votes(w: Column, i: Column) -> Column:
        def vote(p: Column, later: int) -> Column:
            stretch = F.floor((i - p["i"]) / F.lit(STRETCH)) + F.lit(_BIAS + later)
            return F.shiftleft(p["k"].cast("bigint") * F.lit(_SHIFT) + stretch, 4) + p["j"]

        return F.flatten(F.transform(F.element_at(postings, w), lambda p: F.array(vote(p, 0), vote(p, 1))))

    # of the few documents with enough different anchors: votes as text, stretch and anchor in one number, each once, in order
    rows = rows.withColumn("marked", F.when(F.size("hits") >= least, F.filter("hits", lambda h: h["w"].isin(marks))))
    enough = F.size(F.array_distinct(F.transform("marked", lambda h: h["w"]))) >= least
    rows = rows.withColumn("votes", F.when(enough, F.array_sort(F.array_distinct(F.flatten(F.transform("marked", lambda h: votes(h["w"], h["i"])))))))
    rows = rows.withColumn("votes", F.coalesce("votes", none))

    def agreed(v: Column, x: Column) -> Column:
        at = F.shiftright(v, 4)
        n = F.size(F.filter(F.slice("votes", x + 1, ANCHORS), lambda u: F.shiftright(u, 4) == at))
        return F.struct(F.shiftright(at, 32).cast("int").alias("k"), (at.bitwiseAND(F.lit(_SHIFT - 1)) - _BIAS).cast("int").alias("stretch"), n.alias("n"))

    found = F.filter(F.transform("votes", agreed), lambda c: c["n"] >= F.element_at(needs, c["k"] + 1))
    rows = rows.withColumn("found", F.when(F.size("votes") >= least, found))

    def verified(c: Column) -> Column:
        first = F.greatest((c["stretch"] - 1) * STRETCH, F.lit(0))
        region = F.concat(F.lit(" "), F.array_join(F.slice(F.col("w"), first + 1, F.element_at(lengths, c["k"] + 1)), " "), F.lit(" "))
        return F.contains(region, F.element_at(keys[0], c["k"] + 1)) & F.contains(region, F.element_at(keys[1], c["k"] + 1))

    texts = F.coalesce(F.when(F.size("found") > 0, F.filter("found", verified)), F.array().cast(TEXTS_TYPE))
    return rows.withColumn("texts", texts).drop("votes", "found", "marked")


def scan(docs: DataFrame, index: Index | None = None, templates: Templates | None = None) -> DataFrame:
    """Of the templates (the standard ones, or those of ``index``): words, base places, labels and a score of each document: the weight of its rarest phrase or the largest share of anchors that agree on a text."""
    index = index or build_index(docs, templates)
    rare = sorted(set(index.posted[0]) | set(index.posted[1]))
    posted = sorted({*rare, *(w for own in index.anchors for w, _ in own)})
    phrases = F.array(*(F.array(*map(F.lit, p)) for p in index.phrases)) if index.phrases else F.array(F.array().cast("array<string>"))
    labels = F.array(*map(F.lit, index.labels)) if index.labels else F.array().cast("array<string>")
    weights = F.array(*map(F.lit, index.weights)) if index.weights else F.array().cast("array<double>")
    base = F.array(*(F.lit(k) for k, b in enumerate(index.base) if b)) if any(index.base) else F.array().cast("array<int>")
    # each word is looked up once, for texts and phrases
    marked = F.transform("w", lambda w, i: F.when(w.isin(posted), F.struct(w.alias("w"), i.alias("i"))))
    hits = F.filter(marked, lambda h: h.isNotNull()) if posted else F.array().cast("array<struct<w:string,i:int>>")
    rows = _texts_found(docs.select("doc_id", words().alias("w")).withColumn("hits", hits), index)
    rows = rows.select("doc_id", "w", "texts", F.filter("hits", lambda h: h["w"].isin(rare)).alias("hits") if rare else F.array().cast("array<struct<w:string,i:int>>").alias("hits"))
    agreed = F.when(F.size("hits") > 0, F.array_intersect(_starts(F.col("hits"), index.posted[0]), _starts(F.col("hits"), index.posted[1])))
    rows = rows.select("doc_id", "w", "texts", F.coalesce(agreed, F.array().cast("array<bigint>")).alias("agreed"))

    def phrase(c: Column) -> Column:
        return F.shiftright(c, 32).cast("int")

    def start(c: Column) -> Column:
        return c.bitwiseAND(F.lit(_SHIFT - 1))

    def stands(c: Column) -> Column:
        p = F.element_at(phrases, phrase(c) + 1)
        return F.slice(F.col("w"), start(c).cast("int") + 1, F.size(p)) == p

    rows = rows.select("doc_id", "texts", F.size("w").cast("bigint").alias("n_words"), F.when(F.size("agreed") > 0, F.filter("agreed", stands)).alias("places"))
    places = F.coalesce(F.col("places"), F.array().cast("array<bigint>"))
    rows = rows.select("doc_id", "texts", "n_words", places.alias("places"), F.filter(places, lambda c: F.array_contains(base, phrase(c))).alias("own"))

    text_labels = F.array(*(F.lit(label) for label, _, _ in index.texts)) if index.texts else F.array().cast("array<string>")
    sizes = F.array(*(F.lit(float(len(own))) for own in index.anchors)) if index.anchors else F.array().cast("array<double>")

    def names(column: str) -> Column:
        return F.transform(F.col(column), lambda c: F.element_at(labels, phrase(c) + 1))

    def joined(names: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(names)), ",")

    shares = F.transform("texts", lambda c: c["n"] / F.element_at(sizes, c["k"] + 1))

    return rows.select(
        "doc_id",
        "n_words",
        F.size("own").cast("bigint").alias("n_base"),
        F.array_min(F.transform("own", start)).alias("first_word"),
        F.array_max(F.transform("own", start)).alias("last_word"),
        joined(names("own")).alias("base_labels"),
        joined(F.concat(names("places"), F.transform("texts", lambda c: F.element_at(text_labels, c["k"] + 1)))).alias("labels"),
        F.round(F.coalesce(F.array_max(F.concat(F.transform("places", lambda c: F.element_at(weights, phrase(c) + 1)), shares)), F.lit(0.0)), 6).alias("score"),
    )


def oracle_sql() -> str:
    """The same in DuckDB's SQL: every phrase compared at every place, votes of all anchors by grouping."""
    values = ", ".join(f"({k}, '{label}', {str(b).lower()}, {p.split()!r})" for k, (label, p, b) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in MORE]))
    texts = ", ".join(f"({k}, '{label}', {text_words(t)!r}, ' {keys[0]} ', ' {keys[1]} ')" for k, (label, t, keys) in enumerate(TEXTS))
    return f"""
WITH p(k, label, base, words) AS (VALUES {values}),
x(k, label, words, key_1, key_2) AS (VALUES {texts}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
n AS (SELECT count(*) AS docs FROM d),
df AS (SELECT x AS word, count(*) AS c FROM (SELECT unnest(list_distinct(w)) AS x FROM d) GROUP BY 1),
v AS (SELECT DISTINCT k, unnest(words) AS word FROM p),
t AS (SELECT k, sum(ln((docs + 1) / (coalesce(c, 0) + 1))) AS total FROM v CROSS JOIN n LEFT JOIN df USING (word) GROUP BY 1),
g AS (SELECT k, total / nullif(max(total) OVER (), 0) AS weight FROM t),
once AS (SELECT k, word, min(place) AS place FROM (SELECT k, unnest(words) AS word, unnest(range(0, len(words))) AS place FROM x) GROUP BY 1, 2 HAVING count(*) = 1),
ranked AS (SELECT k, word, place, row_number() OVER (PARTITION BY k ORDER BY coalesce(c, 0), place) AS r FROM once LEFT JOIN df USING (word)),
anchor AS (SELECT k, word, place, count(*) OVER (PARTITION BY k) AS m FROM ranked WHERE r <= {ANCHORS}),
hit AS (SELECT * FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d) WHERE word IN (SELECT word FROM anchor)),
vote AS (SELECT doc_id, k, m, word, CAST(floor((i - place) / {STRETCH}.0) AS BIGINT) + later AS stretch FROM hit JOIN anchor USING (word) CROSS JOIN (VALUES (0), (1)) AS z(later)),
agreed AS (SELECT doc_id, k, m, stretch, count(DISTINCT word) AS n FROM vote GROUP BY 1, 2, 3, 4 HAVING n >= ceil({AGREE} * m)),
region AS (
  SELECT doc_id, label, key_1, key_2, n / m AS weight,
    ' ' || array_to_string(w[greatest(0, (stretch - 1) * {STRETCH}) + 1 : greatest(0, (stretch - 1) * {STRETCH}) + len(words) + {3 * STRETCH}], ' ') || ' ' AS part
  FROM agreed JOIN x USING (k) JOIN d USING (doc_id)
),
h AS (
  SELECT doc_id, label, base, weight, i
  FROM (SELECT doc_id, w, k, label, base, words, unnest(range(0, greatest(0, len(w) - len(words) + 1))) AS i FROM d, p WHERE list_has_all(w, words))
  JOIN g USING (k)
  WHERE w[i + 1 : i + len(words)] = words
  UNION ALL
  SELECT doc_id, label, false, weight, NULL FROM region WHERE contains(part, key_1) AND contains(part, key_2)
),
a AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS weight
  FROM h GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(coalesce(weight, 0.0), 6) AS score
FROM d LEFT JOIN a USING (doc_id)
"""
