"""Licence statements in documents, found by a trained paragraph classifier.

Paragraphs are sets of word n-grams: single lines, and up to ``WINDOW`` neighbouring lines
without a blank one between them, for statements that are wrapped.  A multinomial logistic regression over the
n-grams of known statements tells licence families from one another and from unknown text; a
family counts only above a probability that held-out unknown paragraphs do not reach, and is
confirmed if the paragraph holds enough of a statement of that family.

Training reads every paragraph of the documents as unknown text; the common n-grams, the
regression and the threshold are made of all of them.
Training and scoring use built-in columns and the JVM's own ``pyspark.ml`` estimators.  When
scoring, words become rows that meet the bounded vocabulary in broadcast joins; only matches
travel further.

Defined cases: null and empty texts hold no licence; a paragraph without any n-gram of the
vocabulary is unknown; an n-gram counts once per paragraph; several lines count only where they
are confirmed and no line among them states the family alone, and of overlapping findings of a
family the one of fewest lines is reported (ties: the likest, then the first); of two equally
probable families the first in ``FAMILIES`` is taken; repeated rows are judged one by one; without documents the
model is trained on the statements alone.  Other columns may have any name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.plans.staging import stage

#: Paragraphs among which the fixed examples count as often as they are repeated; among more
#: their weights grow in proportion.
AMONG = 6000
SIZES = (1, 2, 3)
#: N-grams in a larger share of ordinary paragraphs say nothing about licences.
COMMON = 0.01
#: Lines over which a statement may be wrapped, and characters of a line looked at ahead of it.
WINDOW, AHEAD = 4, 64
#: Share of a statement's n-grams that confirms it.
CONFIRMED = 0.6
#: Least probability of a family, and the share of unknown paragraphs that stays below it.
LEAST, CALIBRATION = 0.5, 0.999

# How licences of each family are stated.
STATEMENTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Released under the Apache 2.0 license."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "Licensed under the GNU GPL v3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Licensed under the BSD 2-Clause license."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("Public-Domain", "This work is in the public domain."),
    ("Public-Domain", "Released into the public domain under CC0 1.0 Universal."),
    ("Public-Domain", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "No part of this publication may be reproduced without prior written permission."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("Public-Domain", "SPDX-License-Identifier: CC0-1.0"),
)
# Text that shares words with the statements and states no licence.
OTHER_TEXT = (
    "You need a driving licence to rent a car.",
    "Her fishing license expired in version 2 of the form.",
    "He studied at MIT and works for the public library.",
    "The MIT campus is open to any person.",
    "An Apache helicopter was released from service.",
    "The software is free of charge for schools.",
    "The general public may not use this entrance.",
    "All seats are reserved.",
    "Human rights are the topic of this work.",
    "The foundation published a copy of the source.",
    "Creative people share their work in common rooms.",
    "Version 3 of the program was released under a new name.",
    "The domain name is public.",
    "Attribution of the painting is uncertain.",
    "Redistribution of wealth is permitted by law.",
    "Permission was granted by the city.",
    "BSD is a family of operating systems.",
    "The GNU project began long ago.",
)
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *dict.fromkeys(f for f, _ in STATEMENTS))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\R")


def _grams(tokens: str, size: int) -> Column:
    """All n-grams of one size of the array column ``tokens``."""
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - (size - 1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.coalesce(grams, F.array().cast("array<string>"))


def gram_set(tokens: str) -> Column:
    return F.array_distinct(F.concat(*[_grams(tokens, n) for n in SIZES]))


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal."""
    return spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))
    )


@dataclass(frozen=True)
class LicenceModel:
    """Weights per n-gram and family, intercepts, the threshold, and the statements' n-grams."""

    weights: dict[str, list[float]]
    intercepts: list[float]
    threshold: float
    statement_grams: dict[str, list[int]]
    statement_sizes: list[int]


def _known_grams(tokens: str, starts: str, grams: list[str], sizes: tuple[int, ...]) -> Column:
    """Those n-grams of the array column ``tokens`` that are among ``grams``, one per occurrence.

    ``starts`` holds the places of words with which an n-gram of ``grams`` may begin.
    """


    def of(size: int) -> Column:
        def gram(k: Column) -> Column:
            parts = [F.get(tokens, k + i) for i in range(size)]
            return F.concat(parts[0], *[x for p in parts[1:] for x in (F.lit(" "), p)])

        return F.transform(starts, gram)

    return F.filter(F.concat(*[of(n) for n in sizes]), lambda g: g.isin(grams))


def _starts(tokens: str, known: list[str]) -> Column:
    """Places of the words in ``known``."""
    places = F.sequence(F.lit(0), F.size(tokens) - 1)
    return F.filter(places, lambda k: F.get(tokens, k).isin(known))


def _ordinary_paragraphs(
    docs: DataFrame, id_col: str, text_col: str, grams: list[str], sizes: list[int]
) -> DataFrame:
    """``i, grams, t, cut, front, back`` of every paragraph that has words and states no licence.

    ``i`` is a hash; ``grams`` are its n-grams among ``grams``, sorted.  It lends words to
    statement ``t`` of ``sizes[t]`` words, in front of it or behind it, or takes word ``cut`` from
    it; words of no statement are empty.
    """
    known = sorted({x for g in grams for x in g.split()})
    lines = (
        docs.select(
            F.col(id_col).alias("_key"), F.posexplode(paragraphs(F.col(text_col))).alias("p", "line")
        )
        .where(F.col("line").rlike(r"[\p{L}\p{N}]"))
        .select("_key", "p", words(F.col("line")).alias("w"))
        .select(F.pmod(F.xxhash64("w", "_key", "p"), F.lit(1 << 40)).alias("i"), "w")
        .withColumn("starts", _starts("w", known))
        .withColumn("t", (F.col("i") % len(sizes)).cast("int"))
    )
    way, some = F.col("i") % 4, (F.floor(F.col("i") / 7) % 9).cast("int")
    lent = F.transform(
        F.slice("w", F.lit(1), some), lambda x: F.when(x.isin(known), x).otherwise("")
    )
    nothing, size = F.array().cast("array<string>"), F.get(F.lit(sizes), F.col("t"))
    # The n-grams of three words tell statements; licences in the documents are no ordinary text.
    written = stage(
        lines.select(
            "i", F.array_sort(F.array_distinct(_known_grams("w", "starts", grams, (1, 2)))).alias("grams"),
            (F.size(_known_grams("w", "starts", grams, (3,))) == 0).alias("ordinary"), "t",
            F.when((way == 2) & (size > 4), (F.col("i") % size).cast("int")).otherwise(-1).alias("cut"),
            F.when(way == 0, lent).otherwise(nothing).alias("front"),
            F.when(way == 1, lent).otherwise(nothing).alias("back"),
        ),
        "licence-paragraphs",
    )
    return written.where("ordinary").drop("ordinary")


def _percentile(values: DataFrame, share: float, bins: int = 4096) -> float | None:
    """The exact percentile of the column ``p``, rows counted ``n`` times, as ``F.percentile``
    interpolates it.

    Histograms of ever smaller ranges find it, so that no task holds more than ``bins`` counts.
    """
    total = values.agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        return None

    def at(rank: int) -> float:
        part, low, high = values, None, None
        while True:
            step = F.lit(0.0) if low is None else (F.col("p") - low) / (high - low)
            counts = part.groupBy(F.floor(step * bins).alias("bin")).agg(
                F.sum("n").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")
            )
            for r in sorted(counts.collect(), key=lambda r: r["low"]):
                if rank < r["n"]:
                    break
                rank -= r["n"]
            low, high = r["low"], r["high"]
            if low == high:
                return low
            part = values.where(F.col("p").between(low, high))

    place = share * (total - 1)
    first = int(place)
    low = at(first)
    return low if first == place else low + (place - first) * (at(first + 1) - low)


def train_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> LicenceModel:
    """Train on the statements, altered in several ways, and on all ordinary paragraphs.

    Examples with the same n-grams of the vocabulary are one example of their number as weight.
    """
    spark = docs.sparkSession
    stated = _rows(
        spark,
        [{"t": t, "label": FAMILIES.index(f), "s": s} for t, (f, s) in enumerate(STATEMENTS)],
        "t int, label int, s string",
    ).select("t", "label", words(F.col("s")).alias("w"))
    told = stated.select("t", F.size("w").alias("size"), gram_set("w").alias("grams")).collect()
    lists = {r["t"]: r["grams"] for r in told}
    sizes = [n for _, n in sorted((r["t"], r["size"]) for r in told)]
    all_grams = sorted({g for grams in lists.values() for g in grams})
    ordinary = _ordinary_paragraphs(docs, id_col, text_col, all_grams, sizes)
    total = ordinary.count()
    seen = ordinary.select(F.explode("grams").alias("g")).groupBy("g").count()
    common = {r["g"] for r in seen.where(F.col("count") > COMMON * max(1, total)).collect()}
    vocabulary = [g for g in all_grams if g not in common]
    kept = {t: [g for g in grams if g not in common] for t, grams in lists.items()}

    # The fixed texts keep their share however many paragraphs there are.
    share = max(1, -(-total // AMONG))
    held = (F.pmod(F.xxhash64("i", F.lit(0)), F.lit(4)) == 0).alias("held")
    changed = F.concat("front", F.filter("w", lambda _, k: k != F.col("cut")), "back")
    lent = (
        ordinary.groupBy("t", "cut", "front", "back")
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(stated), "t")
        .select("label", "n", changed.alias("w"))
    )
    pure = stated.select("label", F.lit(5 * share).alias("n"), "w")
    other = _rows(spark, [{"s": s} for s in OTHER_TEXT], "s string").select(
        words(F.col("s")).alias("w")
    )
    parts = sorted({x for g in vocabulary for x in g.split()})

    def with_grams(rows: DataFrame) -> DataFrame:
        found = _known_grams("w", "starts", vocabulary, SIZES)
        return rows.withColumn("starts", _starts("w", parts)).withColumn(
            "grams", F.array_sort(F.array_distinct(found))
        )

    examples = (
        with_grams(lent.unionByName(pure))
        .select("label", F.lit(False).alias("held"), "grams", "n")
        .unionByName(
            ordinary.select(
                F.lit(0).alias("label"), held, F.filter("grams", lambda g: ~g.isin(*common)).alias("grams"),
                F.lit(1).alias("n"),
            )
        )
        .unionByName(
            with_grams(other.withColumn("i", F.xxhash64("w"))).select(
                F.lit(0).alias("label"), held, "grams", F.lit(20 * share).alias("n")
            )
        )
        .groupBy("label", "held", "grams")
        .agg(F.sum("n").alias("n"))
        .withColumn("label", F.col("label").cast("double"))
        .withColumn("weight", F.col("n").cast("double"))
    )
    counter = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features")
    counter.setBinary(True)
    examples = stage(counter.transform(examples).drop("grams"), "licence-examples")
    regression = LogisticRegression(
        family="multinomial", regParam=2e-4, elasticNetParam=0.5, maxIter=60, weightCol="weight"
    )
    fitted = regression.fit(examples.where("not held"))
    matrix, found = fitted.coefficientMatrix.toArray(), int(fitted.numClasses)
    intercepts = fitted.interceptVector.toArray().tolist()
    chance = vector_to_array("probability")
    top = _percentile(
        stage(
            fitted.transform(examples.where("held"))
            .select(F.array_max(F.slice(chance, 2, found)).alias("p"), "n")
            .groupBy("p")
            .agg(F.sum("n").alias("n")),
            "licence-chances",
        ),
        CALIBRATION,
    )
    weights = {
        g: [float(matrix[c][k]) if c < found else 0.0 for c in range(len(FAMILIES))]
        for k, g in enumerate(vocabulary)
    }
    holders: dict[str, list[int]] = {}
    for t, grams in kept.items():
        for g in grams:
            holders.setdefault(g, []).append(t)
    return LicenceModel(
        weights,
        [*intercepts, *[-30.0] * (len(FAMILIES) - found)],
        max(LEAST, top or 0.0),
        holders,
        [max(1, len(kept[t])) for t in range(len(STATEMENTS))],
    )


def scan_licences(
    docs: DataFrame,
    model: LicenceModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    confirmed: float = CONFIRMED,
) -> DataFrame:
    """``row, id, paragraph, family, probability, likeness, confirmed, lines`` of what is found,
    ``paragraph`` being the first of its ``lines``.

    Every document has one more row with a null ``paragraph``.
    """
    spark = docs.sparkSession
    table = stage(
        _rows(
            spark,
            [
                {"g": g, "w": w, "t": [int(t in model.statement_grams.get(g, ())) for t in range(len(STATEMENTS))]}
                for g, w in model.weights.items()
            ],
            "g string, w array<double>, t array<int>",
        ).select(F.xxhash64("g").alias("gram"), "w", "t"),
        "licence-vocabulary",
    )
    gates = sorted({g.split()[0] for g in model.weights})
    gate = _rows(spark, [{"g": g} for g in gates], "g string").select(F.xxhash64("g").alias("gate"))
    keys = [F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")]
    # Rows are numbered before they are taken apart.
    numbered = docs.select(*keys, paragraphs(F.col(text_col)).alias("lines"))
    filled = numbered.withColumn("said", F.transform("lines", lambda x: x.rlike(r"[\p{L}\p{N}]")))

    def line(i: Column) -> Column:
        return F.left(F.get(F.col("lines"), i), F.lit(AHEAD))

    def run(p: Column, most: int) -> Column:
        """Lines without a blank one among them that end with line ``p``, up to ``most``."""
        before = F.lit(1) if most == 1 else F.lit(1) + run(p - 1, most - 1)
        return F.when((p >= 0) & F.get(F.col("said"), p), before).otherwise(0)

    def following(p: Column) -> Column:
        """The beginnings of the next lines that go on with line ``p``."""
        second = F.when(F.get(F.col("said"), p + 2), line(p + 2))
        return F.when(F.get(F.col("said"), p + 1), F.concat_ws(" ", line(p + 1), second))

    # Gathered before the lines are taken apart, so that no row carries the whole text.
    each = F.transform(
        "lines",
        lambda x, p: F.struct(
            p.alias("p"), x.alias("line"), run(p, WINDOW).alias("run"), following(p).alias("next")
        ),
    )
    # The words of each line, and the first two of the lines that go on with it.
    lines = filled.select("row", "id", F.inline(each)).select(
        "row", "id", "p", words(F.col("line")).alias("n"), "run",
        F.coalesce(F.slice(words(F.col("next")), 1, 2), F.array().cast("array<string>")).alias("ahead"),
    )
    # Place -1 of the first paragraph stands for the document itself.
    first = F.when(F.col("p") == 0, -1).otherwise(0)
    places = F.when((F.size("n") > 0) | (F.col("p") == 0), F.sequence(first, F.size("n") - 1))
    # The vocabulary is bounded by the statements, so its tables are broadcast.
    begun = (
        lines.withColumn("k", F.explode(places))
        .withColumn("own", F.size("n"))
        .withColumn("n", F.concat("n", "ahead"))
        .withColumn("gate", F.xxhash64(F.get("n", F.col("k"))))
        .join(F.broadcast(gate.withColumn("opens", F.lit(True))), "gate", "left")
        .where("k = -1 or opens")
    )

    def gram(size: int) -> Column:
        parts = [F.get("n", F.col("k") + i) for i in range(size)]
        whole = F.concat(parts[0], *[x for p in parts[1:] for x in (F.lit(" "), p)])
        return F.xxhash64(F.coalesce(whole, F.lit("")))

    grams = F.array(*[F.struct(gram(n).alias("gram"), F.lit(n).alias("size")) for n in SIZES])
    met = (
        begun.select("row", "id", "p", "k", "own", "run", F.explode(grams).alias("g"))
        .select("row", "id", "p", "k", "own", "run", "g.gram", (F.col("k") + F.col("g.size") <= F.col("own")).alias("inside"))
        .join(F.broadcast(table.withColumn("known", F.lit(True))), "gram", "left")
        .where("k = -1 or known")
    )
    # An n-gram belongs to every window of lines that begins up to ``WINDOW`` lines earlier and
    # holds it whole.
    windows = F.array(
        *[F.struct(F.lit(size).alias("size"), F.lit(j).alias("j")) for size in range(1, WINDOW + 1) for j in range(size)]
    )
    fits = (F.col("v.j") < F.col("run")) & (F.col("inside") | (F.col("v.j") < F.col("v.size") - 1))
    found = (
        met.withColumn("v", F.explode(F.when(F.col("k") >= 0, windows).otherwise(F.slice(windows, 1, 1))))
        .where((F.col("k") == -1) | fits)
        .select(
            "row", "id", F.when(F.col("k") >= 0, F.col("p") - F.col("v.j")).alias("s"), F.col("v.size").alias("lines"),
            F.when(F.col("k") >= 0, F.col("gram")).alias("gram"), "p", "w", "t",
        )
        .groupBy("row", "id", "s", "lines", "gram")
        .agg(F.min("p").alias("low"), F.max("p").alias("high"), F.first("w").alias("w"), F.first("t").alias("t"))
    )
    n, m = len(FAMILIES), len(STATEMENTS)
    scored = found.groupBy("row", "id", "s", "lines").agg(
        (F.max("high") > F.min("low")).alias("wide"),
        *[F.sum(F.get("w", F.lit(c))).alias(f"w{c}") for c in range(n)],
        *[F.sum(F.get("t", F.lit(t))).alias(f"t{t}") for t in range(m)],
    )
    logits = F.array(*[F.col(f"w{c}") + F.lit(model.intercepts[c]) for c in range(n)])
    top = F.array_max("logits")
    shares = F.array(
        *[
            F.array_max(
                F.array(
                    F.lit(0.0), F.lit(0.0),
                    *[
                        F.col(f"t{t}") / F.lit(float(model.statement_sizes[t]))
                        for t, (f, _) in enumerate(STATEMENTS)
                        if f == family
                    ],
                )
            )
            for family in FAMILIES
        ]
    )
    normal = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    judged = (
        scored.select("row", "id", "s", "lines", "wide", logits.alias("logits"), shares.alias("shares"))
        .withColumn("best", F.array_position("logits", top).cast("int"))
        .withColumn("probability", F.lit(1.0) / normal)
    )
    names = F.array(*[F.lit(f) for f in FAMILIES])
    hit = F.col("s").isNotNull() & (F.col("best") > 1) & (F.col("probability") >= model.threshold)
    told = judged.select(
        "row", "id", "s", "lines", "wide", "probability", hit.alias("hit"),
        F.get(names, F.col("best") - 1).alias("family"), F.get("shares", F.col("best") - 1).alias("likeness"),
    ).withColumn("confirmed", F.col("likeness") >= confirmed)
    counts = F.col("hit") & ((F.col("lines") == 1) | (F.col("confirmed") & F.col("wide")))
    # Written, as documents and findings are both made of it.
    told = stage(told.where(F.col("s").isNull() | counts), "licence-findings")
    hits = told.where("s is not null")
    # Findings of a family that overlap are one statement; lines that state it alone go first.
    in_order = Window.partitionBy("row", "family").orderBy("s", "lines")
    reached = F.max(F.col("s") + F.col("lines")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum((F.coalesce(F.col("s") >= reached, F.lit(True))).cast("int")).over(in_order)
    grouped = hits.withColumn("group", group)
    together = Window.partitionBy("row", "family", "group")
    alone = F.max((F.col("lines") == 1) & F.col("confirmed")).over(together)
    place = F.row_number().over(together.orderBy(F.col("lines") == 1, "lines", F.desc("likeness"), "s"))
    chosen = grouped.withColumn("alone", alone).withColumn("place", place)
    # Unconfirmed single lines stay unless a wrapped statement covers them.
    wrapped = F.max(F.col("lines") > 1).over(together)
    chosen = chosen.withColumn("wrapped", wrapped).where(
        F.when(F.col("lines") > 1, ~F.col("alone") & (F.col("place") == 1)).otherwise(
            F.col("confirmed") | F.col("alone") | ~F.col("wrapped")
        )
    )
    columns = [F.col("s").alias("paragraph"), "family", "probability", "likeness", "confirmed", "lines"]
    none = told.where(F.col("s").isNull()).select(
        "row", "id", F.lit(None).cast("int").alias("paragraph"), F.lit(None).cast("string").alias("family"),
        *[F.lit(None).cast("double").alias(c) for c in ("probability", "likeness")],
        F.lit(None).cast("boolean").alias("confirmed"), F.lit(None).cast("int").alias("lines"),
    )
    return chosen.select("row", "id", *columns).unionByName(none)


def document_licences(found: DataFrame) -> DataFrame:
    """``id, licences, n_confirmed, n_unconfirmed`` per document; the licences confirmed, sorted."""
    sure = F.when(F.col("confirmed"), F.col("family"))
    return (
        found.groupBy("row", "id")
        .agg(
            F.array_join(F.array_sort(F.collect_set(sure)), ",").alias("licences"),
            F.count(sure).alias("n_confirmed"),
            F.count(F.when(~F.col("confirmed"), F.lit(1))).alias("n_unconfirmed"),
        )
        .drop("row")
    )
