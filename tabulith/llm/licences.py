"""Licence scan by an exact set-similarity join, in DataFrame operations alone.

A text's blocks are overlapping runs of its words, so that line ends and sentence marks play no
part: for templates of up to n words there are blocks of 2 n words, one every n, and whatever is no
longer than a template stands whole in one. A block meets a template if it holds at least THRESHOLD
of the template's distinct words. All words of the templates are counted over the whole corpus (the
documents that hold them) and ordered from rare to frequent. Of a template of n words that needs m
of them, one of the first n - m + 1 in that order is in every block that meets it (prefix filter); a
block has to hold m template words at all (length filter); and from the first word that both share,
both must still have m words to come (positional filter). What passes is compared exactly. A share
of 0.8 may lack just the word that tells one licence from another, so that a block that meets a
template has its label only if the words that tell it stand there side by side, and none that tell
another licence of its family.

Only template words are indexed, so what is broadcast is bounded by the templates, not by the data.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm import _spark


class Template(NamedTuple):
    """What a notice says: its label, words, the phrase of them that tells it, and words of others of its family."""

    label: str
    words: str
    tells: str
    not_: str = ""


THRESHOLD = 0.8
#: Most words of short and of long templates; blocks have twice as many.
SCALES = (8, 64)
#: Phrases that say a licence as such.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: What licence notices and the licences' own texts say.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", "hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2", "apache license version 2"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache license"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "source and binary forms"),
    Template("gpl", "licensed under the gnu general public license", "gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered"),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0"),
    Template("cc-by", "licensed under cc by 4 0", "cc by", "nc nd sa"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", "nd sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    Template("cc-by", "licensed under a creative commons attribution license", "creative commons attribution", "noncommercial noderivatives noderivs sharealike"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike license", "attribution sharealike", "noncommercial"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial license", "attribution noncommercial", "noderivatives noderivs sharealike"),
    Template("cc-by-nd", "licensed under a creative commons attribution noderivatives license", "attribution noderivatives"),
    Template("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike license", "attribution noncommercial sharealike"),
)
#: Bytes that are in no word once A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words with one space between them."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NO_WORD, " "))


def _count(joined: Column, what: Column | str) -> Column:
    what = F.lit(what) if isinstance(what, str) else what
    return ((F.octet_length(joined) - F.octet_length(F.replace(joined, what, F.lit("")))) / F.octet_length(what)).cast("long")


def based(docs: DataFrame, phrases: dict[str, str], words: list[str]) -> DataFrame:
    """docs (doc_id, text) with n_words, n_base, first_word, last_word, base (an array of labels) and own: which of words it holds."""
    out = docs.select("doc_id", words_of(F.coalesce("text", F.lit(""))).alias("w"))
    out = out.withColumn("n_words", F.when(F.col("w") == "", F.lit(0)).otherwise(_count(F.col("w"), " ") + 1).cast("long"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        wide = F.concat(F.lit(" "), F.replace("w", F.lit(" "), F.lit("  ")), F.lit(" "))  # so that places next to each other share no space
        mark, n = f" {phrase.replace(' ', '  ')} ", len(phrase.split())
        there = F.contains(F.col("w"), F.lit(phrase))
        count = F.when(there, _count(wide, mark)).otherwise(F.lit(0)).cast("long")
        counts.append(count)
        firsts.append(F.when(count > 0, _count(F.substring_index(wide, mark, 1), "  ") + F.when(F.substring_index(wide, mark, 1) == "", 0).otherwise(1)))
        after = F.substring_index(wide, mark, -1)
        lasts.append(F.when(count > 0, F.col("n_words") - n - F.when(after == "", 0).otherwise(_count(after, "  ") + 1)))
        labels.append(F.when(count > 0, F.lit(label)))
    return out.select(
        "doc_id",
        "n_words",
        reduce(add, counts).alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
        F.array_intersect(F.array(*map(F.lit, words)), F.split("w", " ")).alias("own"),
    )


def _sets(templates: tuple[Template, ...]) -> list[tuple[Template, int, list[str], int]]:
    """Of each template its scale, its distinct words and how many of them are needed."""
    out = []
    for t in templates:
        own = sorted(set(t.words.split()))
        scale = next(k for k, n in enumerate(SCALES) if len(t.words.split()) <= n)
        out.append((t, scale, own, -int(-len(own) * THRESHOLD // 1)))
    return out


def met(docs: DataFrame, held: dict[str, int], templates: tuple[Template, ...]) -> DataFrame:
    """(doc_id, label, score) of the templates that the blocks of docs meet; score: the share of the words held.

    held: in how many documents each template word is.
    """
    sets = _sets(templates)
    every = sorted({w for _, _, words, _ in sets for w in words})
    ordered = sorted(every, key=lambda w: (held.get(w, 0), w))
    rank = {w: k for k, w in enumerate(ordered)}
    index = []
    for t, scale, words, need in sets:
        words = sorted(words, key=rank.__getitem__)
        index += [(words[i], scale, t.label, words, i, need, f" {t.tells} ", t.not_.split()) for i in range(len(words) - need + 1)]
    prefixes = sorted({x[0] for x in index})
    least = min(x[5] for x in index)
    lit = lambda words: F.array(*map(F.lit, words))
    joined = docs.select("doc_id", F.split(words_of(F.col("text")), " ").alias("w")).where(F.arrays_overlap("w", lit(prefixes)))
    runs = lambda k, n: F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(n)), lambda i: F.struct(F.lit(k).alias("scale"), F.slice("w", i, 2 * n).alias("b")))
    blocks = joined.select("doc_id", F.explode(F.concat(*[runs(k, n) for k, n in enumerate(SCALES)])).alias("x")).select("doc_id", "x.*")
    blocks = blocks.where(F.arrays_overlap("b", lit(prefixes)))
    blocks = blocks.withColumn("own", F.array_intersect(lit(ordered), "b")).where(F.size("own") >= least)
    probes = blocks.select("doc_id", "scale", "b", "own", F.posexplode("own").alias("j", "word")).where(F.col("word").isin(prefixes))
    table = docs.sparkSession.createDataFrame(index, "word string, scale int, label string, words array<string>, i int, need int, tells string, others array<string>")
    pairs = probes.join(F.broadcast(table), ["word", "scale"])  # a row for each prefix word of a template
    first = F.size(F.array_intersect(F.slice("words", 1, F.col("i")), "own")) == 0
    ahead = F.least(F.size("words") - F.col("i"), F.size("own") - F.col("j")) >= F.col("need")
    pairs = pairs.where((F.size("own") >= F.col("need")) & ahead & first)
    found = pairs.withColumn("n", F.size(F.array_intersect("words", "own"))).where(F.col("n") >= F.col("need"))
    said = F.contains(F.concat(F.lit(" "), F.array_join("b", " "), F.lit(" ")), F.col("tells"))
    found = found.where(said & ~F.arrays_overlap("b", "others"))
    return found.select("doc_id", "label", (F.col("n") / F.size("words")).alias("score"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs (doc_id, text).

    Words: runs of other than NO_WORD in the whole text, A-Z in lower case. n_base: places of the phrases;
    first_word and last_word: the smallest and largest word (from 0) that one starts at, else null;
    base_labels: what these say; labels: with what the templates say, both distinct, sorted and joined by
    commas. score: 1 for a phrase, else the largest share of a template's words in one block, 0 if none
    meets its template. A null or empty text has no words; an empty table gives an empty result. doc_id is
    taken as a key: rows with one id share the templates' labels; a null id has those of phrases alone.
    Two licences of one family within a block (GPL and LGPL) are told by the block around either alone.
    """
    docs = docs.select("doc_id", "text")
    words = sorted({w for t in templates for w in t.words.split()})
    base = _spark.stored(based(docs, phrases, words), "licences")
    held = {r[0]: r[1] for r in base.select(F.explode("own").alias("word")).groupBy("word").count().collect()}  # template words only
    more = met(docs, held, templates).groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("score").alias("most"))
    out = base.join(more, "doc_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> str:
    """scan() over documents in DuckDB's SQL, every block against every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    many = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"
    rows = ", ".join(f"({scale}, '{t.label}', {many(words)}, {need}, ' {t.tells} ', {many(t.not_.split())})" for t, scale, words, need in _sets(templates))
    said = ", ".join(f"('{label}', {many(phrase.split())})" for phrase, label in phrases.items())
    runs = " UNION ALL ".join(f"SELECT doc_id, {k} AS scale, unnest(list_transform(range(0, len(ws), {n}), lambda i: ws[i + 1:i + {2 * n}])) AS b FROM w" for k, n in enumerate(SCALES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '{word}') AS ws FROM d),
p(label, phrase) AS (VALUES {said}),
places AS (
  SELECT r, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1:i + len(phrase)] = phrase)) AS place FROM w, p
),
base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY r
),
runs AS ({runs}),
t(scale, label, words, need, tells, others) AS (VALUES {rows}),
held AS (
  SELECT doc_id, label, len(list_intersect(words, list_distinct(b))) AS n, len(words) AS of, need
  FROM runs JOIN t USING (scale) WHERE contains(' ' || array_to_string(b, ' ') || ' ', tells) AND NOT list_has_any(b, others)
),
more AS (SELECT doc_id, list(DISTINCT label) AS more, max(n / of) AS most FROM held WHERE n >= need GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (doc_id)
"""
