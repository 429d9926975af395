"""License scans in SQL expressions: a positional index of rare licence words.

Every document gets the postings (word, position) of the words that any template uses. Function
words are no part of the index: in a template they hold a place, but are not compared. A template
is looked up by its words in falling inverse document frequency over the corpus: postings shifted
by the word's place in the template are intersected, rarest first, so what is left are the starts
at which the words stand in the template's relative positions. The mandatory key phrase must be
complete at a start, which earns the label; the share of the template's words found at that start
is its score, and the best start of any wording counts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let, without

# Phrases whose places always count, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening or distinctive passages of licences and their notices, in lower case without
# punctuation. (label, wording, mandatory key phrase inside it); a label may have several wordings.
TEMPLATES = [
    ("agpl", "gnu affero general public license version 3", "affero general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "affero general public license as published"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "use this file except in compliance"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "copyright holders and contributors as is"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "software and accompanying documentation covered"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    ("cc0", "released under the cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("epl", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2", "gnu general public license version 2", "general public license version 2"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "free software foundation either version 2"),
    ("gpl-3", "gnu general public license version 3", "general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "free software foundation either version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose with or without fee"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form is subject"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "event will the authors be held liable"),
]
# Words that hold a place in a template without being compared.
FUNCTION_WORDS = "a an and any are as at be been but copy copies file for from form held in into is may not of on or out that the this to use will with you your".split()
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
VOCABULARY = sorted({w for phrase in BASE for w in phrase.split()} | {w for _, t, _ in TEMPLATES for w in t.split() if w not in FUNCTION_WORDS})
_ID = {w: k for k, w in enumerate(VOCABULARY)}
_SHIFT = 1 << 32


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words (long) and hits (array of word id * 2**32 + position for the vocabulary's words)."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD), F.lit(0))
    # Vocabulary words are ASCII; a word whose lower case only becomes ASCII is another word.
    known = lambda w: F.lower(w).isin(VOCABULARY) & (F.length(w) == F.octet_length(w))
    names = F.array(*[F.lit(w) for w in VOCABULARY])

    def found(w: Column) -> Column:
        places = F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: known(F.get(w, i))))
        hits = F.transform(places, lambda i: (F.array_position(names, F.lower(F.get(w, i))) - 1) * _SHIFT + i)
        return F.struct(F.size(w).cast("long").alias("n_words"), hits.alias("hits"))

    return without(docs, "_p", "n_words", "hits").withColumn("_p", let(words, found)).select("*", "_p.*").drop("_p")


def document_frequencies(posted: DataFrame) -> dict[str, int]:
    """Documents that have each vocabulary word; counted in the tasks, a row per word in the end."""
    ids = F.array_distinct(F.transform("hits", lambda h: F.floor(h / _SHIFT).cast("int")))
    rows = posted.filter(F.size("hits") > 0).select(F.explode(ids).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return {VOCABULARY[r["w"]]: r["n"] for r in rows}


_PLAN = "array<struct<label:string,key:array<struct<word:bigint,place:bigint>>,words:array<struct<word:bigint,place:bigint>>>>"


def _word_list(words: list[tuple[str, int]]) -> list[dict]:
    return [{"word": _ID[w], "place": i} for w, i in words]


def compared(wording: str, key: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(word, place) of the wording's compared words, and of those inside its key phrase."""
    words, phrase = wording.split(), key.split()
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    placed = [(w, i) for i, w in enumerate(words) if w not in FUNCTION_WORDS]
    return placed, [(w, i) for w, i in placed if at <= i < at + len(phrase)]


def plans(frequencies: dict[str, int]) -> Column:
    """The templates as one constant: each key phrase's words rarest first, and all compared words."""
    made = []
    for label, wording, key in TEMPLATES:
        words, phrase = compared(wording, key)
        rare = sorted(phrase, key=lambda x: (frequencies.get(x[0], 0), x[1]))
        made.append({"label": label, "key": _word_list(rare), "words": _word_list(words)})
    return F.from_json(F.lit(json.dumps(made)), _PLAN)


def base_plans() -> Column:
    return F.from_json(F.lit(json.dumps([{"label": label, "key": _word_list([(w, i) for i, w in enumerate(phrase.split())])} for phrase, label in BASE.items()])), _PLAN)


def _starts(hits: Column, word: Column) -> Column:
    """Where a text would start that has the word in its place."""
    return F.transform(F.filter(hits, lambda h: F.shiftright(h, 32) == word["word"]), lambda h: h - (word["word"] * _SHIFT + word["place"]))


def _places(hits: Column, words: Column) -> Column:
    """Starts at which all the words stand, intersected in the given order."""
    rest = F.slice(words, F.lit(2), F.size(words))
    narrow = lambda found, word: F.when(F.size(found) == 0, found).otherwise(F.array_intersect(found, _starts(hits, word)))
    return F.aggregate(rest, _starts(hits, words[0]), narrow)


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_words, base_places (array of (start, label)), matches (array of (label, score)) to the kept columns.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z in lower case.
    ``keep`` names the columns carried along (default: all but the text). Null and empty texts
    match nothing; repeated rows are scanned alike; clashing columns are replaced; of several starts
    of a template the best counts, so bare mentions never outvote a full match. The postings
    are checkpointed once, so the frequencies and the matching read the texts a single time.
    """
    source = without(docs, "n_words", "hits", "base_places", "matches")
    kept = [c for c in source.columns if (c in keep if keep is not None else c != text)]
    posted = checkpointed(postings(source, text).select(*[F.col(f"`{c}`") for c in kept], "n_words", "hits"))
    wanted = plans(document_frequencies(posted))

    def base(h: Column) -> Column:
        named = F.transform(base_plans(), lambda t: F.transform(_places(h, t["key"]), lambda s: F.struct(s.alias("start"), t["label"].alias("label"))))
        return F.array_sort(F.flatten(named))

    def matched(h: Column) -> Column:
        def scored(t: Column, starts: Column) -> Column:
            # Starts at which each word stands; a start's share is how often it occurs among them.
            met = F.flatten(F.transform(t["words"], lambda w: F.array_intersect(_starts(h, w), starts)))
            most = F.array_max(F.transform(starts, lambda s: F.size(F.filter(met, lambda x: x == s))))
            share = most.cast("double") / F.size(t["words"])
            return F.struct(t["label"].alias("label"), F.when(F.size(starts) > 0, share).otherwise(F.lit(0.0)).alias("score"))

        tried = F.transform(wanted, lambda t: let(_places(h, t["key"]), lambda starts: scored(t, starts)))
        return F.filter(tried, lambda m: m["score"] > 0)

    none = "array<struct<start:bigint,label:string>>", "array<struct<label:string,score:double>>"
    some = F.size("hits") > 0
    return posted.select(
        *[F.col(f"`{c}`") for c in kept],
        "n_words",
        F.when(some, base(F.col("hits"))).otherwise(F.array().cast(none[0])).cast(none[0]).alias("base_places"),
        F.when(some, matched(F.col("hits"))).otherwise(F.array().cast(none[1])).cast(none[1]).alias("matches"),
    )
