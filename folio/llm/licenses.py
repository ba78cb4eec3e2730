"""License scan by diagonal voting, in DataFrame functions only.

Every pair of neighbouring words of a text is a rolling k-gram (k = 2); its hash is joined with the grams of the license
templates (a broadcast table of fixed size). A hit at word `pos` of a gram at place `tpos` of a template votes for the diagonal
pos - tpos. Votes are counted by diagonal, neighbouring diagonals are merged into regions (words put in or left out shift a
match by a few places), and regions are verified by the share of the template they cover and their length. A diagonal with
all of a template's votes is an exact place of its phrase. Templates may be of any length: which of its grams a region covers is kept
as bits, 62 a column, in as many columns as the longest template asks for.

The join also compares the words themselves, so equal hashes of unequal grams do not count. One extra row per text carries its
number of words through the join; so texts are read once and there is one shuffle, of the hits.

Defined results: null text is empty; a text without words has n_words 0, no places, empty labels and score 0; repeated
rows are scanned one by one (rows are told apart by their place in the input); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases that are looked for word by word, with their labels.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Passages of license texts; a region must cover most of one.
MORE = (
    ("agpl", "gnu affero general public license"),
    ("apache-text", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("cc-attribution", "creative commons attribution"),
    ("epl", "eclipse public license"),
    ("gpl-text", "either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("lgpl", "gnu lesser general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl", "mozilla public license"),
    ("public-domain", "free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
    (
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version",
    ),
    (
        "apache-notice",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    (
        "bsd-terms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Diagonals this close are one region.
SHIFT = 2
#: Grams of a template that one column of bits stands for.
BITS = 62
#: A region covers this share of the template's grams within twice the template's length, or is exact.
COVER = 0.75


def templates() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, base, number of grams, place, first word, second word) of every gram; template -1 is the row that carries n_words."""
    out = [(-1, "", False, 0, 0, "", "")]
    for t, (label, phrase) in enumerate((*BASE, *MORE)):
        w = phrase.split()
        out += [(t, label, t < len(BASE), len(w) - 1, k, w[k], w[k + 1]) for k in range(len(w) - 1)]
    return out


def _template_table(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(templates(), "t int, label string, base boolean, grams int, tpos int, t1 string, t2 string")
    return rows.withColumn("tkey", F.when(F.col("t") < 0, F.lit(0)).otherwise(F.xxhash64("t1", "t2")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, exact places of the base phrases and all labels found."""
    low = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), UPPER, LOWER)
    words = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("w"))
    size = F.size("w")
    carrier = F.array(F.struct(F.lit("").alias("w1"), size.cast("string").alias("w2")))
    following = F.slice("w", F.lit(2), F.greatest(size - 1, F.lit(0)))
    grams = F.arrays_zip(F.col("w").alias("w1"), following.alias("w2"))
    rolled = words.select("doc_id", "rid", F.posexplode(F.concat(carrier, grams)).alias("pos", "g"))
    rolled = rolled.select("doc_id", "rid", (F.col("pos") - 1).alias("pos"), F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2"))
    rolled = rolled.withColumn("gkey", F.when(F.col("w1") == "", F.lit(0)).otherwise(F.xxhash64("w1", "w2")))
    table = F.broadcast(_template_table(docs.sparkSession))
    same = (F.col("gkey") == F.col("tkey")) & (F.col("w1") == F.col("t1")) & ((F.col("t") < 0) | (F.col("w2") == F.col("t2")))
    hits = rolled.join(table, same).select(
        "rid", "doc_id", "t", "label", "base", "grams", "tpos", (F.col("pos") - F.col("tpos")).cast("long").alias("diagonal"),
        F.when(F.col("t") < 0, F.col("w2").cast("long")).alias("n_words"),
    )
    hits = hits.repartition("rid")  # all that follows groups by rid and more
    masks = [f"seen{k}" for k in range(-(-max(r[3] for r in templates()) // BITS))]
    bit = lambda k: F.expr(f"bit_or(if(tpos div {BITS} = {k}, shiftleft(1L, tpos % {BITS}), 0L))")
    lines = hits.groupBy("rid", "doc_id", "t", "label", "base", "grams", "diagonal").agg(
        F.count("*").alias("votes"), *[bit(k).alias(m) for k, m in enumerate(masks)], F.min("tpos").alias("lo"), F.max("tpos").alias("hi"), F.max("n_words").alias("n_words")
    )
    order = Window.partitionBy("rid", "t").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT).cast("int"), F.lit(0))
    lines = lines.withColumn("apart", apart).withColumn("region", F.sum("apart").over(order))
    exact = F.col("votes") == F.col("grams")
    regions = lines.groupBy("rid", "doc_id", "t", "label", "base", "grams", "region").agg(
        F.count_if(exact).alias("places"), F.min(F.when(exact, F.col("diagonal"))).alias("first"), F.max(F.when(exact, F.col("diagonal"))).alias("last"),
        sum((F.bit_count(F.bit_or(m)) for m in masks), F.lit(0)).alias("covered"), (F.max(F.col("diagonal") + F.col("hi")) - F.min(F.col("diagonal") + F.col("lo")) + 2).alias("length"), F.max("n_words").alias("n_words"),
    )
    cover = F.when(F.col("t") >= 0, F.col("covered") / F.col("grams"))
    found = (F.col("t") >= 0) & ((F.col("places") > 0) | ((cover >= COVER) & (F.col("grams") > 2) & (F.col("length") <= 2 * (F.col("grams") + 1))))
    sound = F.col("base") & (F.col("places") > 0)
    said = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = regions.groupBy("rid", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.coalesce(F.sum(F.when(F.col("base"), F.col("places"))), F.lit(0)).alias("n_base"),
        F.min(F.when(sound, F.col("first"))).alias("first_word"), F.max(F.when(sound, F.col("last"))).alias("last_word"),
        said(sound).alias("base_labels"), said(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.when(F.col("places") > 0, F.lit(1.0)).otherwise(cover))), F.lit(0.0)).cast("double").alias("score"),
    )
    return out.drop("rid")


def _values() -> str:
    return ", ".join(f"({t}, '{label}', {base}, {grams}, {tpos}, '{a}', '{b}')" for t, label, base, grams, tpos, a, b in templates() if t >= 0)


SQL = f"""
with docs as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
tpl(t, label, base, grams, tpos, t1, t2) as (values {_values()}),
ex as (select rid, unnest(w) as w1, generate_subscripts(w, 1) - 1 as pos from docs),
gr as (select rid, pos, w1, lead(w1) over (partition by rid order by pos) as w2 from ex),
hi as (select rid, t, label, base, grams, tpos, pos, pos - tpos as diagonal from gr join tpl on w1 = t1 and w2 = t2),
ln as (select rid, t, label, base, grams, diagonal, count(*) as votes, min(pos) as lo, max(pos) as hi from hi group by all),
ap as (select *, case when diagonal - lag(diagonal) over (partition by rid, t order by diagonal) > {SHIFT} then 1 else 0 end as apart from ln),
rg as (select *, sum(apart) over (partition by rid, t order by diagonal) as region from ap),
cv as (select rid, t, region, count(distinct tpos) as covered from hi join rg using (rid, t, diagonal) group by all),
rl as (select rid, t, label, base, grams, region, count(*) filter (votes = grams) as places, min(diagonal) filter (votes = grams) as fw, max(diagonal) filter (votes = grams) as lw,
       max(hi) - min(lo) + 2 as len from rg group by all),
re as (select * from rl join cv using (rid, t, region)),
ok as (select *, places > 0 or (covered / grams >= {COVER} and grams > 2 and len <= 2 * (grams + 1)) as found, base and places > 0 as sound from re)
select d.doc_id, len(any_value(d.w))::bigint as n_words, coalesce(sum(places) filter (base), 0)::bigint as n_base,
       (min(fw) filter (sound))::bigint as first_word, (max(lw) filter (sound))::bigint as last_word,
       coalesce(array_to_string(list_sort(list(distinct label) filter (sound)), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list(distinct label) filter (found)), ','), '') as labels,
       coalesce(max(case when places > 0 then 1.0::double else covered::double / grams end) filter (found), 0.0)::double as score
from docs d left join ok using (rid) group by d.rid, d.doc_id
"""
