"""License notices by an exact set-similarity join with templates, in DataFrame functions only (operator 12).

A text's words are runs of letters and digits (A-Z in lower case, every
non-ASCII character counts as a letter). A template is the set of the distinct
pairs of neighbouring words of a license notice. A block of a text holds a
template if at least ``containment`` of the template's pairs are in the block.

* Blocks. A template of n words belongs to the size class of the next power of
  two, s. Blocks of that class are the 2 s words from each multiple of s on, so
  every run of s words lies in one block as a whole, whatever lines or
  paragraphs the text is cut into, and a block is never much longer than the
  notice it is compared with. Pairs that no template has can't add to an
  overlap, so a block is kept as its set of template pairs only.
* Global order. The template pairs are ranked by how often they occur in the
  whole corpus, the rarest first (ties: by their text's hash). Blocks and
  templates are sorted by rank.
* Prefix filter. A template of m pairs needs an overlap of o = ceil(containment
  * m). If a block of b pairs has it, the first m - o + 1 pairs of the template
  and the first b - o + 1 of the block have one in common. Only these meet, by
  an equi join.
* Length filter: b >= o. Positional filter: with a common pair at place i of the
  block and j of the template, the overlap is at most min(i, j) + 1 + min(b -
  i, m - j) - 1 (places from 0); pairs that can't reach o are dropped.
* What is left is verified on the full sets, so the join is exact.

Phrases are looked up besides: every place where all words of a phrase stand
one after the other is counted.

Documents are dealt by document and block, so no group is larger than the
pairs of a block, whatever a source or a phrase holds. Templates and their
pairs are parameters of a bounded size; they are broadcast if the saved table
is measured to be small and shuffled else.

Defined cases: null and empty texts have no words, no place and no label;
documents are (doc_id, text) pairs, so repeated rows come back as often as
they came, all alike, and so do rows with a null id; a template of fewer than
two words is no template, templates of the same words are one with both
labels, and without templates only phrases count; no length of text or word is
special; ``scan`` ignores further columns; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_of, key_of, save
from .decontaminate import small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what stands between words: ASCII but letters and digits
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8

#: fixed values: phrases and their labels
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: fixed values: (label, words) of the notices that licenses ask for, and of short forms in use
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
               "http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version 3 of the license or at your "
            "option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the "
            "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license "
            "for more details"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
            "not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def tokens(text: Column | str) -> Column:
    """The words of a text as an array."""
    low = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, BETWEEN), lambda x: x != "")


def pair_at(words: str, at: str) -> str:
    """SQL: the hash of the two words from a place on."""
    return f"xxhash64(get({words}, {at}), get({words}, {at} + 1))"


def places_of(phrases: Sequence[tuple[str, str]], words: str) -> list[Column]:
    """For each phrase an array of the places where it stands."""
    out = []
    for text, _ in phrases:
        own = text.split()
        same = " and ".join(f"get({words}, i + {j}) = '{w}'" for j, w in enumerate(own))
        look = F.expr(f"filter(sequence(0, size({words}) - {len(own)}), i -> {same})")
        # most texts lack the phrase's last word, and are read once
        has = F.array_contains(words, own[-1]) & (F.size(words) >= len(own))
        out.append(F.when(has, look).otherwise(F.array().cast("array<int>")))
    return out


def size_class(n: int) -> int:
    """The power of two that holds n words."""
    return 1 << max(2, (n - 1).bit_length())


def template_pairs(spark: SparkSession, templates: Sequence[tuple[str, str]], containment: float) -> DataFrame:
    """template, label, class, m, need, gram: a row for each distinct pair of each template."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = text.split()
        pairs = sorted(set(zip(words, words[1:])))
        need = math.ceil(containment * len(pairs) - 1e-9)
        rows += [(number, label, size_class(len(words)), len(pairs), need, a, b) for a, b in pairs]
    made = spark.createDataFrame(rows, "template int, label string, class int, m int, need int, a string, b string")
    return save(made.withColumn("gram", F.xxhash64("a", "b")).drop("a", "b"), "license-templates")


def small_by_rows(df: DataFrame) -> DataFrame:
    return small(df, F.lit(64))


def blocks(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """_id, _version, class, block, grams: the distinct template pairs of every block that has one."""
    # cut into words once; the explode below reads the array's words and the places after them
    own = docs.select("_id", "_version", tokens("text").alias("words"))
    places = own.select("_id", "_version", "words", F.posexplode("words").alias("at", "word")).select(
        "_id", "_version", "at", F.expr(pair_at("words", "at")).alias("gram"), (F.size("words") - 1).alias("last"))
    met = places.where("at < last").join(small_by_rows(listed.select("class", "gram").distinct()), "gram")
    both = F.array(F.expr("at div class"), F.expr("at div class - 1"))  # the two blocks that hold the place
    each = met.select("_id", "_version", "class", "gram", F.explode(both).alias("block")).where("block >= 0")
    return each.groupBy("_id", "_version", "class", "block").agg(F.collect_set("gram").alias("grams"))


def matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
            containment: float = CONTAINMENT) -> DataFrame:
    """_id, _version, class, block, template, label, containment: every block that holds a template, by exact join.

    ``docs`` has _id, _version and text. A block's first word is number block * class of the text.
    """
    if not 0 < containment <= 1:
        raise ValueError(f"containment {containment} is not in (0, 1]")
    spark = docs.sparkSession
    listed = template_pairs(spark, [t for t in templates if len(t[1].split()) > 1], containment)
    found = save(blocks(docs, listed), "license-blocks")
    # ranks by the corpus: as many rows as the templates have pairs
    count = found.select("class", F.explode("grams").alias("gram")).groupBy("class", "gram").agg(F.count("*").alias("n"))
    order = F.row_number().over(Window.partitionBy("class").orderBy("n", "gram"))
    ranked = listed.join(count, ["class", "gram"], "left").na.fill(0, ["n"]).select("class", "gram", "n").distinct()
    ranked = save(ranked.withColumn("rank", order.cast("int")), "license-ranks")
    sets = (listed.join(ranked, ["class", "gram"]).groupBy("template", "label", "class", "m", "need")
            .agg(F.array_sort(F.collect_list("rank")).alias("t")))
    sets = save(sets, "license-sets")
    heads = sets.select("*", F.posexplode(F.expr("slice(t, 1, m - need + 1)")).alias("j", "rank"))
    least = sets.groupBy("class").agg(F.min("need").alias("least"))  # no template of the class needs less
    own = (found.select("_id", "_version", "class", "block", F.explode("grams").alias("gram"))
           .join(small_by_rows(ranked.select("class", "gram", "rank")), ["class", "gram"])
           .groupBy("_id", "_version", "class", "block").agg(F.array_sort(F.collect_list("rank")).alias("x"))
           .join(small_by_rows(least), "class").where("size(x) >= least"))
    first = own.select("_id", "_version", "class", "block", "x",
                       F.posexplode(F.expr("slice(x, 1, size(x) - least + 1)")).alias("i", "rank"))
    met = (first.join(small_by_rows(heads), ["class", "rank"])
           .where("size(x) >= need")  # length
           .where("i <= size(x) - need")  # the block's prefix for this template
           .where("least(i, j) + least(size(x) - i, m - j) >= need"))  # position
    pairs = met.select("_id", "_version", "class", "block", "template", "label", "m", "need",
                       F.size(F.array_intersect("x", "t")).alias("common")).where("common >= need").distinct()
    return pairs.select("_id", "_version", "class", "block", "template", "label",
                        (F.col("common") / F.col("m")).alias("containment"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT,
         phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    n_base, first_word and last_word are of the phrases' places, base_labels are the phrases' labels; ``labels`` has
    those of the templates as well. ``score`` is 1 if a phrase was found, else the largest containment of a template
    that was found, else 0.
    """
    text = F.col("text").cast("string")
    own = docs.select(key_of("doc_id").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_version"),
                      text.alias("text"))
    found = save(matches(own, templates, containment).groupBy("_id", "_version").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")), "license-found")
    places = places_of(phrases, "words")
    names = [f"p{i}" for i in range(len(phrases))]
    counted = own.select("_id", "_version", tokens("text").alias("words")).select(
        "_id", "_version", F.size("words").cast("long").alias("n_words"), *(p.alias(n) for p, n in zip(places, names)))
    every = F.flatten(F.array(*names)) if names else F.array().cast("array<int>")
    label = reduce(lambda a, b: F.concat(a, b),
                   [F.when(F.size(n) > 0, F.array(F.lit(x[1]))).otherwise(F.array().cast("array<string>"))
                    for n, x in zip(names, phrases)], F.array().cast("array<string>"))
    based = counted.select("_id", "_version", "n_words", F.size(every).cast("long").alias("n_base"),
                           F.array_min(every).cast("long").alias("first_word"),
                           F.array_max(every).cast("long").alias("last_word"), F.array_distinct(label).alias("base"))
    none = F.array().cast("array<string>")
    joined = based.join(small(found, F.lit(200)), ["_id", "_version"], "left")
    named = lambda x: F.array_join(F.array_sort(x), ",")
    return joined.select(
        id_of("_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", named("base").alias("base_labels"),
        named(F.array_union("base", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def oracle_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT,
               phrases: Sequence[tuple[str, str]] = PHRASES) -> str:
    """DuckDB SQL for ``scan``: every block is compared with every template that shares a pair, without filters."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = text.split()
        pairs = sorted(set(zip(words, words[1:])))
        need = math.ceil(containment * len(pairs) - 1e-9)
        rows += [f"({number}, '{label}', {size_class(len(words))}, {len(pairs)}, {need}, '{a}', '{b}')" for a, b in pairs]
    base = " union all ".join(
        f"select doc_id, i - 1 as pos, '{label}' as label from w where " + " and ".join(
            f"w[i + {j}] = '{x}'" for j, x in enumerate(text.split())) for text, label in phrases)
    return rf"""
with template(template, label, class, m, need, a, b) as (values {", ".join(rows)}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
w as (select doc_id, w, unnest(generate_series(1, len(w))) as i from d),
base as ({base}),
p as (select doc_id, i - 1 as pos, w[i] as a, w[i + 1] as b from w where i < len(w)),
hit as (select distinct doc_id, class, pos // class - x as block, template, label, m, need, a, b
        from p join template using (a, b), (values (0), (1)) as v(x) where pos // class - x >= 0),
held as (select doc_id, label, count(*) / any_value(m) as c from hit group by doc_id, class, block, template, label
         having count(*) >= any_value(need)),
labels as (select doc_id, label from base union select doc_id, label from held),
x as (select doc_id, count(*) as n, min(pos) as lo, max(pos) as hi, string_agg(distinct label, ',' order by label) as l
      from base group by 1),
y as (select doc_id, string_agg(distinct label, ',' order by label) as l from labels group by 1),
z as (select doc_id, max(c) as c from held group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(x.n, 0) as bigint) as n_base,
  cast(x.lo as bigint) as first_word, cast(x.hi as bigint) as last_word, coalesce(x.l, '') as base_labels,
  coalesce(y.l, '') as labels, case when x.n > 0 then 1.0 else coalesce(z.c, 0.0) end::double as score
from d left join x using (doc_id) left join y using (doc_id) left join z using (doc_id)"""
