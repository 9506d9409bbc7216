"""License scans with a positional index of rare words, in built-in functions only.

Licence wordings are templates. The index has, for each template, the places of its words with the highest inverse document frequency
in the corpus, rarest first. A file looks up its own licence words by their IDF: of those that a template has, the file's
POSTINGS rarest are taken, and each of their occurrences says where the template would begin. Beginnings on which
several words agree, up to a slack, are candidates; a candidate counts if its mandatory phrases stand in its
window. Templates without slack (the short base phrases) must agree word by word. The score is the share of the template's words, weighed
by IDF, that stand where they should.

Defined results: a null text is empty, with 0 words and no labels; repeated rows each get a result; texts of any length are scanned whole; a place where
several templates begin counts for each; ``scan`` keeps the caller's columns and replaces those of its results' names; in an empty corpus nothing is found.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Words of a text whose A-Z are in lower case.
LICENCE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a template that are indexed; of these, as many as a file looks up; of these, as many as must agree.
INDEXED, POSTINGS, AGREE = 6, 3, 2


@dataclass(frozen=True)
class Template:
    label: str
    wording: str
    phrases: tuple[str, ...] = ()
    slack: int = 0
    base: bool = False


# The wordings of licences, or of the notices that refer to them, as words in lower case.
MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
)
APACHE = (
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
    "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
    "copyright notice this list of conditions and the following disclaimer"
)
ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
    "binary for any purpose commercial or non commercial and by any means"
)
ZLIB = (
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this "
    "software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such"
)
BOOST = "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt"
MOZILLA = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"
GNU = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at "
    "your option any later version this program is distributed in the hope that it will be useful but without any warranty"
)

#: Phrases that count word by word.
BASE = (Template("mit", "under the mit license", base=True), Template("apache-2", "apache license version 2", base=True), Template("cc-by-nc", "cc by nc", base=True))
#: Wordings of well-known licences and the phrases without which they aren't meant.
TEMPLATES = (
    *BASE,
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu gpl version 3"),
    Template("gpl-2", "gnu gpl version 2"),
    Template("lgpl-3", "gnu lesser general public license version 3"),
    Template("lgpl-2.1", "gnu lesser general public license version 2 1"),
    Template("agpl-3", "gnu affero general public license version 3"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("epl-2", "eclipse public license version 2"),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-nc-sa", "cc by nc sa"),
    Template("cc-by-nc-nd", "cc by nc nd"),
    Template("cc-by", "cc by 4 0"),
    Template("cc-by", "creative commons attribution 4 0"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge"), 3),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",), 3),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification"), 3),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",), 3),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain"), 2),
    Template("mit", MIT, ("permission is hereby granted", "free of charge"), 8),
    Template("apache-2", APACHE, ("apache org licenses license 2 0",), 8),
    Template("bsd", BSD, ("source and binary forms", "with or without modification"), 8),
    Template("isc", ISC, ("with or without fee is hereby granted",), 8),
    Template("unlicense", UNLICENSE, ("free and unencumbered software", "public domain"), 8),
    Template("zlib", ZLIB, ("altered source versions must be plainly marked",), 8),
    Template("bsl-1", BOOST, ("boost software license",), 8),
    Template("mpl-2", MOZILLA, ("mozilla public license",), 8),
    Template("gpl", GNU, ("redistribute it and or modify it under the terms of the gnu general public license",), 8),
)

_KIND = "array<struct<label:string,base:boolean,slack:int,size:int,words:array<string>,idf:array<double>,postings:array<struct<x:string,at:array<int>>>,need:int,phrases:array<string>>>"


def lowered(text: Column) -> Column:
    """A-Z in lower case. The two characters whose lower case would be an ASCII letter are put out of the way; what other letters become doesn't matter to ASCII words."""
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("")), F.lit("İ"), F.lit(""))
    return F.lower(kept)


def licence_words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(LICENCE_WORD), F.lit(0))


def document_frequencies(words: DataFrame, column: str, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Documents, and those with each word of the templates: as many lines as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.wording.split()})
    seen = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.filter(F.col(column), lambda x: x.isin(vocabulary))))).alias("w"))
    counts = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def build_index(n_docs: int, frequencies: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> list[dict]:
    """The templates with their words' IDF and their postings: the rarest words, rarest first, each with all its places."""
    out = []
    for t in templates:
        words = t.wording.split()
        idf = [math.log((n_docs + 1) / (frequencies.get(w, 0) + 1)) + 1 for w in words]
        rarest = sorted(dict.fromkeys(words), key=lambda w: (-idf[words.index(w)], words.index(w)))[:INDEXED]
        out.append({"label": t.label, "base": t.base, "slack": t.slack, "size": len(words), "words": words, "idf": idf, "postings": [{"x": w, "at": [i for i, x in enumerate(words) if x == w]} for w in rarest], "need": min(AGREE, len(rarest)), "phrases": list(t.phrases) or [t.wording]})
    return out


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def matches(words: Column, hits: Column, index: list[dict]) -> Column:
    """All verified places: array of (label, base, start, score), from the words and the occurrences (p, x) of those that are indexed."""
    templates = F.from_json(F.lit(json.dumps(index)), _KIND)
    none = F.array().cast("array<struct<label:string,base:boolean,start:int,score:double>>")

    def near(q: Column, slack: Column) -> Column:
        """The words around the place q."""
        return F.slice(words, F.greatest(q - slack, F.lit(0)) + 1, 2 * slack + 1)

    def of(t: Column) -> Column:
        # The file's rarest words that the template has, each with the beginnings that its occurrences speak for.
        begins = lambda w: F.flatten(F.transform(F.filter(hits, lambda h: h["x"] == w["x"]), lambda h: F.transform(w["at"], lambda q: h["p"] - q)))
        own = F.slice(F.filter(t["postings"], lambda w: F.exists(hits, lambda h: h["x"] == w["x"])), 1, POSTINGS)
        return F.when(F.size(own) >= t["need"], _bound(F.transform(own, begins), lambda spoken: agreed_on(t, spoken))).otherwise(none)

    def agreed_on(t: Column, spoken: Column) -> Column:
        slack = t["slack"]
        near_to = lambda s, xs: F.exists(xs, lambda x: F.abs(x - s) <= slack)
        agreed = F.filter(F.array_distinct(F.flatten(spoken)), lambda s: (s >= -slack) & (F.size(F.filter(spoken, lambda xs: near_to(s, xs))) >= t["need"]))

        def window(s: Column) -> Column:
            return F.concat(F.lit(" "), F.array_join(F.slice(words, F.greatest(s - slack, F.lit(0)) + 1, t["size"] + 2 * slack), " "), F.lit(" "))

        sure = F.filter(agreed, lambda s: F.forall(t["phrases"], lambda k: F.contains(window(s), F.concat(F.lit(" "), k, F.lit(" ")))) & ((slack > 0) | (s >= 0)))

        def score(s: Column) -> Column:
            got = F.zip_with(t["words"], F.sequence(F.lit(0), t["size"] - 1), lambda w, q: F.when((s + q >= 0) & F.array_contains(near(s + q, slack), w), F.element_at(t["idf"], q + 1)).otherwise(F.lit(0.0)))
            plus = lambda a, x: a + x
            return F.aggregate(got, F.lit(0.0), plus) / F.aggregate(t["idf"], F.lit(0.0), plus)

        # Of beginnings that lie within the slack of each other the first counts.
        places = F.when(slack == 0, sure).otherwise(F.filter(F.array_sort(sure), lambda s: ~F.exists(sure, lambda o: (o < s) & (s - o <= 2 * slack))))
        return F.transform(places, lambda s: F.struct(t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), score(s).alias("score")))

    return F.flatten(F.transform(templates, of))


def scan(df: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, prefix: str = "__lic_") -> DataFrame:
    """Add, under the prefix, n_words and found: array of (label, base, start, score)."""
    made = f"{prefix}n_words", f"{prefix}found"
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made])
    free = prefix
    while any(c.startswith(free) for c in df.columns):
        free += "_"
    words, hits = f"{free}words", f"{free}hits"
    df = df.withColumn(words, licence_words(F.col(f"`{text}`")))
    n_docs, frequencies = document_frequencies(df, words, templates)
    index = build_index(n_docs, frequencies, templates)
    indexed = sorted({w["x"] for t in index for w in t["postings"]})
    at = F.filter(F.transform(F.col(words), lambda x, i: F.when(x.isin(indexed), F.struct(i.alias("p"), x.alias("x")))), lambda h: h.isNotNull())
    df = df.withColumn(hits, at)
    none = F.array().cast("array<struct<label:string,base:boolean,start:int,score:double>>")
    found = F.when(F.size(hits) > 0, matches(F.col(words), F.col(hits), index)).otherwise(none)
    return df.withColumns({made[0]: F.size(words).cast("bigint"), made[1]: found}).drop(words, hits)


def digest(documents: DataFrame) -> DataFrame:
    rows = scan(documents.select("doc_id", "text"), "text")
    found, base = F.col("__lic_found"), F.filter(F.col("__lic_found"), lambda m: m["base"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"].cast("bigint"))
    return rows.select(
        "doc_id",
        F.col("__lic_n_words").alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(found).alias("labels"),
        F.coalesce(F.round(F.array_max(F.transform(found, lambda m: m["score"])), 6), F.lit(0.0)).alias("score"),
    )
