"""Licence scan: exact containment join of text blocks with licence templates; DataFrame functions only.

A block is a run of lines between blank lines, and each line of it on its own. A block meets a template when it holds at least
``threshold`` of the template's distinct words and all words that set the template apart from its kin (``required``, such as
"nc" or a version's number). Of a family's templates that a block meets, the best one counts: the largest share, then the
longest.

1. The documents' frequency of every template word is counted over the whole table; that is the global order, rarest first.
2. Prefix filter: a block that meets a template of n words holds one of its first n - ceil(threshold n) + 1 words. Those words
   are the keys of an inverted index of templates; texts without any are passed over, other texts are cut into blocks, and
   each block looks its words up in the index, which gives its candidates.
3. Length filter: the block has at least ceil(threshold n) distinct words. Positional filter: from the word that a block and a
   template met by, as many words must follow in the global order, in the template and in the block, as are still needed.
4. Candidates are verified on whole word sets. Base labels are phrases, found word by word in whole texts.

Scale: one shuffle of counts for the template words; the index is small and fixed and travels in the plan, like the built side
of a broadcast join. Texts are never shuffled.

Edge cases: null texts count as empty: no words, no labels, score 0; repeated rows give a result each; ties of frequency go to
the smaller word; an empty table gives an empty result. ``scan`` carries other columns along and renames its own on a clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.llm.common import ascii_lower, fresh, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Licence notices to look for: label, family, words that must stand there, notice.
TEMPLATES = [
    ("mit-notice", "mit", "mit", "released under the mit license"),
    ("mit-text", "mit", "permission software", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("isc-text", "mit", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0-notice", "apache", "apache 2", "licensed under the apache license version 2 0"),
    ("apache-2.0-text", "apache", "basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-2.0-notice", "gpl", "gnu 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0-notice", "gpl", "gnu 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0-text", "gpl", "gnu 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-text", "gpl", "gnu 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-text", "gpl", "lesser", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("mpl-2.0-notice", "mpl", "mozilla 2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("bsd-2-clause-text", "bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause-text", "bsd-names", "endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-4.0-notice", "cc", "cc by 4", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0-notice", "cc", "cc by sa 4", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0-notice", "cc", "cc by nc 4", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0-notice", "cc", "cc by nd 4", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa-4.0-notice", "cc", "cc by nc sa 4", "licensed under cc by nc sa 4 0"),
    ("cc0-text", "cc0", "public domain", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("unlicense-text", "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "reserved", "copyright rights reserved", "copyright all rights reserved"),
]


def words_of(text: Column) -> Column:
    """Words of lower-cased text."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def frequencies(texts: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many texts (column t, lower-cased) each of ``words`` stands."""
    found = F.array_intersect(F.split("t", GAP), F.array(*map(F.lit, words)))
    rows = texts.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return {w: 0 for w in words} | {r["w"]: r["n"] for r in rows}


def plan(templates: list[tuple[str, str, str, str]], counts: dict[str, int], threshold: float) -> list[dict]:
    """Each template's label and family, words in the global order, words a block needs and must have, and prefix."""
    out = []
    for label, family, required, notice in templates:
        words = sorted(set(notice.split()), key=lambda w: (counts[w], w))
        need = math.ceil(threshold * len(words) - 1e-9)
        out.append({"label": label, "family": family, "words": words, "need": need, "required": required.split(), "prefix": words[: len(words) - need + 1]})
    return out


def places(words: str, phrase: list[str]) -> Column:
    """Where (from 1) the words of ``phrase`` stand one after another in the array ``words``; none in a null array."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - len(phrase) + 1, F.lit(1)))
    at = F.filter(starts, lambda i: F.slice(words, i, len(phrase)) == F.array(*map(F.lit, phrase)))
    return F.coalesce(F.when(F.array_contains(words, phrase[0]), at), F.array().cast("array<int>"))


def blocks_of(text: Column) -> Column:
    """Paragraphs of a text and their lines, as arrays of distinct words, without equal ones."""
    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    blocks = F.array_distinct(F.concat(paragraphs, F.split(text, "\n")))
    return F.array_distinct(F.transform(blocks, lambda b: F.array_distinct(words_of(b))))


def _array(values: list, kind: str) -> Column:
    return F.array(*[F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v) for v in values]).cast(f"array<{kind}>")


class Index:
    """Templates by the words of their prefixes."""

    def __init__(self, plans: list[dict], counts: dict[str, int]):
        order = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
        keys = sorted({w for p in plans for w in p["prefix"]})
        entries = [F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p["prefix"].index(w)).alias("i")) for t, p in enumerate(plans) if w in p["prefix"]]) for w in keys]
        self.keys = F.array(*map(F.lit, keys)).cast("array<string>")
        self.lists = F.map_from_arrays(self.keys, F.array(*entries)) if keys else None
        self.rank = F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*map(F.lit, order.values()))) if order else None
        self.known = F.array(*map(F.lit, order)).cast("array<string>")
        self.words, self.required = (_array([p[c] for p in plans], "array<string>") for c in ("words", "required"))
        self.need, self.n = _array([p["need"] for p in plans], "int"), _array([len(p["words"]) for p in plans], "int")
        self.labels, self.families = (_array([p[c] for p in plans], "string") for c in ("label", "family"))

    def candidates(self, block: Column) -> Column:
        """Numbers of the templates that a block (array of distinct words) may meet, by its words' entries and the filters."""
        ranks = F.transform(F.array_intersect(block, self.known), lambda w: F.element_at(self.rank, w))

        def entries(w: Column) -> Column:
            after = F.size(F.filter(ranks, lambda r: r > F.element_at(self.rank, w)))
            return F.transform(F.element_at(self.lists, w), lambda x: F.struct(x["t"].alias("t"), (F.least(F.get(self.n, x["t"]) - x["i"] - 1, after) + 1).alias("most")))

        met = F.flatten(F.transform(F.array_intersect(block, self.keys), entries))
        fit = F.filter(met, lambda x: (F.size(block) >= F.get(self.need, x["t"])) & (x["most"] >= F.get(self.need, x["t"])))
        return F.array_distinct(F.transform(fit, lambda x: x["t"]))

    def matches(self, block: Column) -> Column:
        """Array of (family, share, n, label) of the templates that a block meets, verified."""
        held = lambda t: F.size(F.array_intersect(F.get(self.words, t), block))
        met = F.filter(self.candidates(block), lambda t: (held(t) >= F.get(self.need, t)) & (F.size(F.array_except(F.get(self.required, t), block)) == 0))
        each = lambda t: F.struct(F.get(self.families, t).alias("family"), (held(t) / F.get(self.n, t)).alias("share"), F.get(self.n, t).alias("n"), F.get(self.labels, t).alias("label"))
        return F.transform(met, each)


def best(found: Column) -> Column:
    """Of each family the best match."""
    return F.filter(found, lambda m: ~F.exists(found, lambda o: (o["family"] == m["family"]) & (o > m)))


def scan(docs: DataFrame, *, templates: list[tuple[str, str, str, str]] | None = None, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and templates (labels with shares)."""
    templates = TEMPLATES if templates is None else templates
    low = ascii_lower(F.col(f"`{text}`"))
    counts = frequencies(docs.select(low.alias("t")), sorted({w for t in templates for w in t[3].split()}))
    index = Index(plan(templates, counts, threshold), counts)
    names = {x: fresh(x, docs.columns) for x in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates")}
    keep = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.withColumn("_low", low)
    out = out.withColumn("_words", words_of(F.col("_low")))
    for k, phrase in enumerate(PHRASES):
        out = out.withColumn(f"_at{k}", places("_words", phrase.split()))
    ats = [F.col(f"_at{k}") for k in range(len(PHRASES))]
    hits = F.concat(*ats)
    base = F.array_compact(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(ats, PHRASES.values(), strict=True)]))
    none = F.array().cast("array<struct<family:string,share:double,n:int,label:string>>")
    if templates:
        blocks = F.filter(blocks_of(F.col("_low")), lambda b: F.arrays_overlap(b, index.keys))
        out = out.withColumn("_blocks", F.when(F.arrays_overlap("_words", index.keys), blocks))
        out = out.withColumn("_met", F.transform("_blocks", index.matches))
        out = out.withColumn("_met", F.coalesce(F.flatten(F.transform("_met", best)), none))
    else:
        out = out.withColumn("_met", none)
    out = out.withColumns({"_base": base, "_hits": hits})
    return out.select(
        *keep,
        F.size("_words").cast("long").alias(names["n_words"]),
        F.size("_hits").cast("long").alias(names["n_base"]),
        (F.array_min("_hits") - 1).cast("long").alias(names["first_word"]),
        (F.array_max("_hits") - 1).cast("long").alias(names["last_word"]),
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias(names["base_labels"]),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.transform("_met", lambda m: m["label"])))), ",").alias(names["labels"]),
        F.when(F.size("_hits") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("_met", lambda m: m["share"])), F.lit(0.0))).alias(names["score"]),
        F.array_distinct(F.transform("_met", lambda m: F.struct(m["label"].alias("label"), m["share"].alias("share")))).alias(names["templates"]),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: licences of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
