"""License scan as an exact set-similarity join of text blocks with templates. Native expressions only.

A block is a run of consecutive words, one starting every half block; notices are looked for in blocks of SPANS[0] words, longer
texts in blocks of SPANS[1]; a template of up to half a block and one word that stands in a text lies whole in some block. A
block matches a template if it holds at least THRESHOLD of the template's distinct words, among them all that tell it from its
kin (`must`) and none that only the kin have (`bar`).

Words get a global order, rarest in the corpus first, from one counting pass over all documents (only template words are
counted: others can never be shared). A matching block shares a word with the template's prefix, its first
|T| - alpha + 1 words in that order (alpha: the words that must be shared); it has at least alpha template words (length
filter); and at the first shared prefix word enough words are left on both sides (positional filter). What passes is
verified by the exact intersection. Templates are a small fixed list, so the index rides in the plan and nothing is shuffled
but the word counts.

Defined results: a null text counts as empty; a text without words has no places, empty labels and score 0; a very long text is
one array of words and as many blocks as it has; words tied in number are ordered by themselves; rows repeat as they come, null
doc_ids too; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.llm.common import LOWER, UPPER, ascii_lower

SPANS, THRESHOLD = (32, 128), 0.8
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed values of the contract: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license notices; label, words that must be there, words that must not, text.
NOTICES = [
    ("apache", ["apache"], [], "Licensed under the Apache License, Version 2.0"),
    ("mit", ["mit"], [], "Released under the MIT License"),
    ("mit", ["granted", "charge", "obtaining"], [], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", ["redistribution", "binary"], [], "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("gpl", ["gnu", "general"], ["lesser", "affero"], "licensed under the GNU General Public License, version"),
    ("lgpl", ["lesser"], [], "under the terms of the GNU Lesser General Public License"),
    ("agpl", ["affero"], [], "under the terms of the GNU Affero General Public License"),
    ("mpl", ["mozilla"], [], "subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", ["cc", "nc"], [], "Licensed under CC BY NC 4.0"),
    ("cc-by-sa", ["cc", "sa"], [], "Licensed under CC BY SA 4.0"),
    ("cc0", ["cc0"], [], "dedicated to the public domain under CC0 1.0"),
    ("unlicense", ["unencumbered"], [], "This is free and unencumbered software released into the public domain"),
]
#: The opening texts of public licenses, in the same form.
TEXTS = [
    ("mit", ["granted", "sublicense"], [], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("isc", ["purpose", "fee"], ["sublicense"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", ["redistribution", "disclaimer"], [], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("apache", ["apache", "compliance"], [], "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", ["gnu", "option"], ["lesser", "affero"], "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", ["lesser", "option"], [], "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("agpl", ["affero", "option"], [], "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl", ["mozilla", "mpl"], [], "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("zlib", ["alter", "freely"], [], "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", ["unencumbered", "compile"], [], "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
]
CLASSES = tuple(zip(SPANS, (NOTICES, TEXTS), strict=True))


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w))


def alpha(words: list[str], threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * len(words) - 1e-9)


def words_of(text: str = "text") -> Column:
    """The words of the whole text, lower case."""
    clean = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAP, " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def ranks(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Global order of the template words: how often each occurs in the corpus, rarest first. At most one row a word comes back."""
    counts = docs.select(F.explode(F.filter(words_of(), lambda w: w.isin(vocabulary))).alias("w")).groupBy("w").count().collect()
    often = {r.w: r["count"] for r in counts}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}


def _phrase_places(words: Column, phrase: str) -> Column:
    first, *rest = phrase.split()

    def here(i: Column) -> Column:
        ok = F.get(words, i) == first
        for k, w in enumerate(rest, 1):
            ok = ok & (F.get(words, i + k) == w)
        return ok

    last = F.size(words) - len(rest) - 1
    return F.when((last >= 0) & F.array_contains(words, phrase.split()[-1]) & F.array_contains(words, first), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def matches(words: Column, order: dict[str, int], templates: list[tuple], span: int, threshold: float = THRESHOLD) -> Column:
    """array<struct<label, containment, block>>: every (block, template) pair at or over the threshold."""
    half = span // 2
    sets = [sorted(order[w] for w in template_words(t)) for *_, t in templates]
    need = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
    prefix = [s[: len(s) - a + 1] for s, a in zip(sets, need, strict=True)]
    by_rank = {i: w for w, i in order.items()}
    rare = sorted({by_rank[i] for p in prefix for i in p})

    def ints(values: list[int]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<int>")

    index = F.array(*[
        F.struct(F.lit(label).alias("label"), ints(s).alias("ranks"), ints([order[w] for w in must]).alias("must"), ints([order[w] for w in bar]).alias("bar"), F.lit(len(p)).alias("prefix"), F.lit(a).alias("alpha"))
        for (label, must, bar, _), s, p, a in zip(templates, sets, prefix, need, strict=True)
    ])
    rank_of = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    vocabulary = list(order)

    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(rare), i)))
    starts = F.filter(F.array_distinct(F.flatten(F.transform(hits, lambda p: F.array(F.floor(p / half).cast("int"), F.floor(p / half).cast("int") - 1)))), lambda b: b >= 0)

    def in_block(b: Column) -> Column:
        own = F.array_sort(F.transform(F.filter(F.array_distinct(F.slice(words, b * half + 1, span)), lambda w: w.isin(vocabulary)), lambda w: rank_of[w]))

        def similar(own: Column) -> Column:
            def passes(t: Column) -> Column:
                size, n = F.size(own), F.size(t["ranks"])

                def placed(i: Column) -> Column:
                    at = F.array_position(own, F.get(t["ranks"], i))
                    return (at > 0) & (F.least(n - i, size - at + 1) >= t["alpha"])

                told = (F.size(F.array_intersect(own, t["must"])) == F.size(t["must"])) & (F.size(F.array_intersect(own, t["bar"])) == 0)
                return (size >= t["alpha"]) & F.exists(F.sequence(F.lit(0), t["prefix"] - 1), placed) & told & (F.size(F.array_intersect(own, t["ranks"])) >= t["alpha"])

            return F.transform(F.filter(index, passes), lambda t: F.struct(t["label"].alias("label"), (F.size(F.array_intersect(own, t["ranks"])) / F.size(t["ranks"])).alias("containment"), b.alias("block")))

        return F.flatten(F.transform(F.array(own), similar))

    found = F.flatten(F.transform(starts, in_block))
    none = F.expr("cast(array() as array<struct<label: string, containment: double, block: int>>)")
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, rare))), found).otherwise(none)


def scan(docs: DataFrame, order: dict[str, int]) -> DataFrame:
    """doc_id, n_words, places array<struct<label, word>>, matches array<struct<label, containment, block>>."""
    with_words = docs.select("doc_id", words_of().alias("words"))

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(_phrase_places(F.col("words"), phrase), lambda i: F.struct(F.lit(label).alias("label"), i.alias("word")))

    places = F.flatten(F.array(*[labelled(p, label) for p, label in BASE.items()]))
    return with_words.select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"), F.flatten(F.array(*[matches(F.col("words"), order, known, span) for span, known in CLASSES])).alias("matches"))


def vocabulary() -> list[str]:
    return sorted({w for _, known in CLASSES for _, must, bar, t in known for w in [*must, *bar, *template_words(t)]})


def op2_license_set_join(docs: DataFrame) -> DataFrame:
    """The contract's query; score is the best containment of a matching template, 1 where a base phrase stands, else 0."""
    found = scan(docs, ranks(docs, vocabulary()))
    listed = lambda *cols: F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(*cols))))
    base = F.transform("places", lambda x: x["label"])
    more = F.transform("matches", lambda x: x["label"])
    word = F.transform("places", lambda x: x["word"])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(word).cast("long").alias("first_word"),
        F.array_max(word).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(base, more).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0))).alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
    )


def oracle_sql() -> str:
    """Brute force: every block against every template."""
    rows = ", ".join(f"({span}, '{label}', {template_words(t)}, {must}::VARCHAR[], {bar}::VARCHAR[], {alpha(template_words(t))})" for span, known in CLASSES for label, must, bar, t in known)
    spans = ", ".join(f"({span})" for span in SPANS)
    places = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, i FROM (SELECT rid, w, unnest(range(0, len(w) - {len(p.split()) - 1})) AS i FROM d WHERE len(w) >= {len(p.split())}) WHERE " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in BASE.items()
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    t(span, label, words, must, bar, alpha) AS (VALUES {rows}), n(span) AS (VALUES {spans}),
    places AS ({places}),
    b AS (SELECT rid, span, list_distinct(w[k * (span // 2) + 1 : k * (span // 2) + span]) AS own FROM (SELECT rid, span, w, unnest(range(0, (len(w) + span // 2 - 1) // (span // 2))) AS k FROM d, n)),
    m AS (SELECT rid, label, len(list_intersect(own, words))::DOUBLE / len(words) AS c FROM b JOIN t USING (span) WHERE len(list_intersect(own, words)) >= alpha AND list_has_all(own, must) AND NOT list_has_any(own, bar)),
    pa AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY rid),
    ma AS (SELECT rid, count(*) AS n, max(c) AS c FROM m GROUP BY rid),
    la AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM places UNION ALL SELECT rid, label FROM m) GROUP BY rid)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pa.n, 0)::BIGINT AS n_base, pa.lo::BIGINT AS first_word, pa.hi::BIGINT AS last_word,
      coalesce(pa.labels, '') AS base_labels, coalesce(la.labels, '') AS labels, CASE WHEN pa.n > 0 THEN 1.0::DOUBLE ELSE coalesce(ma.c, 0.0::DOUBLE) END AS score, coalesce(ma.n, 0)::BIGINT AS n_matches
    FROM d LEFT JOIN pa USING (rid) LEFT JOIN ma USING (rid) LEFT JOIN la USING (rid)"""
