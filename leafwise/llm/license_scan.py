"""Licence notices by a trained paragraph classifier.

A paragraph is a line of a text together with the lines that go on from it: a
line of ``WRAP`` characters or more that ends with a letter, a digit or a comma
goes on in the next one, unless that is blank or indented.  "Licence" and
"license" are one word.  Sparse features (words, pairs and triples
of words that hold a word of the notices) go into a
multinomial logistic regression with an L1 penalty over licence families, "unknown"
(a licence of no known family) and "none".  A family is believed when its
probability reaches a threshold calibrated on held-out notices (a notice is
held out in all its frames), and it is
confirmed when the paragraph shares enough word pairs with a template of the
family; a notice that is not believed or not confirmed is "unknown".

A paragraph without any feature that weighs something gets the intercepts'
answer, "none"; so only paragraphs with one of a few words that every such
feature holds are split into words and vectorised, with the same result.  All steps are DataFrame operations and
Spark's own (JVM) estimators.

Training rows: the notices below, and as "none" a bounded sample of the
corpus's paragraphs (``SAMPLE`` at most, the first by a hash of id and text
among those of a drawn part of the documents; paragraphs with
a word of the trade, or that look like a template, are left out of it) plus a
few sentences that use such words otherwise.  The feature words are those of
the notices but for ``GRAMMAR``, so they do not hang on how often a corpus
repeats a notice.

Edge cases: NULL or empty text has no paragraphs; rows repeat as often as the
input's do; very long texts and lines are read whole; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm.common import saved

#: Corpus paragraphs used as "none", at most.
SAMPLE = 3000
#: Least length of a line that goes on in the next one.
WRAP = 60
#: Precision that the calibrated threshold must reach on held-out paragraphs.
PRECISION = 0.99
#: One notice in so many is held out for the threshold.
FOLDS = 4
#: Share of the shorter text's word pairs that a template must share.
CONFIRM = 0.5
PENALTY = 0.0002
#: Weight of a class's rows together, against those of "none".
WEIGHT = 0.25
NONE, UNKNOWN = "none", "unknown"

#: Notices by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Released under MIT",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache org licenses LICENSE 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal, dedicated to the public domain",
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the copyright holder",
        "This software is proprietary and confidential; unauthorized copying is prohibited",
    ],
    UNKNOWN: [
        "Licensed under the Harbour Community License, version 4",
        "Released under the Open Valley Licence",
        "This work is licensed under our house terms, see the file LICENSE",
        "Distributed under a special license agreement between the parties",
    ],
}
#: Frames that vary a notice for training.
FRAMES = ["{}.", "{}", "Note: {}.", "Copyright (c) 2019 The Authors. {}.", "{}. See the file for details.", "The text below is ours. {}. Thank you."]
#: Sentences with words of the trade that are no notices.
OTHERWISE = [
    "He lost his driving license on the way to the public library.",
    "The general of the free city was released on Monday.",
    "A fishing licence is permitted only with a written request.",
    "The apache helicopter landed in the valley behind the source.",
    "She studied at MIT and wrote about binary stars.",
    "The public may use the park without restriction.",
    "Poetic license is granted to any person who writes in verse.",
    "Copies of the form are distributed at the door, and rights of way follow.",
    "Open source software is distributed under many licenses.",
    "A license is a text that says what others may do with a work.",
    "The committee compared public licenses and their terms for an hour.",
]

#: Words of the notices that tell nothing alone ("mit" is a German preposition).
GRAMMAR = {
    "the", "of", "to", "and", "a", "in", "is", "this", "that", "for", "by", "or", "at", "be", "it", "with", "on", "as", "are", "an", "you", "may", "not", "all", "no", "any",
    "only", "from", "our", "can", "has", "have", "its", "should", "nor", "neither", "between", "along",
    "mit",
}

PARAGRAPH_WORD = r"[^a-z0-9]+"


def words_of(text: Column) -> Column:
    """Lower-cased words (a to z and digits) of a paragraph, British spelling of the trade's word undone."""
    low = F.replace(F.lower(text), F.lit("licenc"), F.lit("licens"))
    return F.array_remove(F.split(low, PARAGRAPH_WORD), "")


def holds_word(text: Column, words: list[str]) -> Column:
    """Whether ``words_of(text)`` has one of ``words``: looked for where a word begins, without splitting the text."""
    if not words:
        return F.lit(False)
    tails: dict[str, list[str]] = {}
    for w in sorted(words):
        tails.setdefault(w[0], []).append(w.replace("licens", "licen[cs]")[1:])
    begin = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in tails.items())
    return F.concat(F.lit(" "), F.lower(text)).rlike(f"[^a-z0-9](?:{begin})(?![a-z0-9])")


def once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def grams(words: Column, n: int) -> Column:
    def made(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", F.slice(w, i + 1, n)))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<string>"))

    # bound, as a filter would put what makes the words in their place, for every gram anew
    return once(words, made)


def features(words: Column) -> Column:
    return F.concat(words, grams(words, 2), grams(words, 3))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its number from 0, blank lines counted) and p of every paragraph that is not blank."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the line end comes first: what lies before it is looked at there only, not at every character
    full = f"[^\\n]{{{WRAP - 1}}}[A-Za-z0-9,]"
    joined = F.regexp_replace(text, f"(?:\\r\\n(?<={full}\\r\\n)|\\n(?<={full}\\n))(?=\\S)", " ")
    lines = docs.select(F.col("doc_id").alias("doc_id"), F.posexplode_outer(F.split(joined, "\n")).alias("paragraph", "p"))
    return lines.where(F.length(F.trim("p")) > 0)


def _python_words(text: str) -> list[str]:
    low = text.lower().replace("licenc", "licens")
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in low).split() if w]


def _python_features(text: str) -> set[str]:
    w = _python_words(text)
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def with_openings(templates: list[str]) -> list[str]:
    """Templates, and the first clause of each as a short notice of its own."""
    openings = [re.split(r"[.;:,](?= )", t)[0] for t in templates]
    return [*templates, *(x for x in openings if x not in templates and len(x.split()) > 2)]


def cue_words() -> list[str]:
    """The words that make a feature of words, pairs and triples; fixed by the notices."""
    trade = {w for ts in TEMPLATES.values() for t in ts for w in _python_words(t)}
    return sorted(w for w in trade if len(w) > 1 and w not in GRAMMAR)


def template_share(words: Column, templates: list[str]) -> Column:
    """Largest share of the shorter text's word pairs that a template shares with a paragraph."""
    known = [sorted({" ".join(x) for x in itertools.pairwise(_python_words(t))}) for t in templates]
    every = F.array(*map(F.lit, sorted(set(itertools.chain(*known)))))

    def share(found: Column, size: Column) -> Column:
        shared = F.lit(0.0)
        for pairs in known:
            lit = F.array(*map(F.lit, pairs))
            shared = F.greatest(shared, F.size(F.array_intersect(found, lit)) / F.greatest(F.least(size, F.lit(len(pairs))), F.lit(1)))
        return F.when(F.size(found) > 0, shared).otherwise(F.lit(0.0))

    # only pairs of some template are held against each of them
    return once(F.array_distinct(grams(words, 2)), lambda own: once(F.array_intersect(own, every), lambda found: share(found, F.size(own))))


def like_template(words: Column) -> Column:
    """A paragraph that a template would confirm, or that holds three words of one in a row, two of them cues."""
    cues = set(cue_words())
    every = [t for ts in TEMPLATES.values() for t in ts]
    triples = {x for t in every for w in [_python_words(t)] for x in zip(w, w[1:], w[2:]) if sum(y in cues for y in x) > 1}
    holds = F.arrays_overlap(grams(words, 3), F.array(*[F.lit(" ".join(x)) for x in sorted(triples)]))
    return holds | (template_share(words, every) >= CONFIRM)


class Model:
    """Vectoriser, classifier, threshold and the words without which no feature weighs anything."""

    def __init__(self, vectors, classifier, classes: list[str], threshold: float, cues: list[str]):
        self.vectors, self.classifier, self.classes, self.threshold, self.cues = vectors, classifier, classes, threshold, cues

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``words``) plus the likeliest class other than none, its probability, and that of none."""
        got = self.vectors.transform(rows.withColumn("grams", features(F.col("words"))))
        got = self.classifier.transform(got).withColumn("probs", vector_to_array("probability"))
        classes = F.array(*map(F.lit, self.classes))
        none = self.classes.index(NONE)
        pairs = F.transform(F.arrays_zip(F.col("probs"), classes.alias("classes")), lambda z: F.struct(z["probs"].alias("p"), z["classes"].alias("c")))
        best = F.array_max(F.filter(pairs, lambda z: z["c"] != NONE))
        return got.withColumn("best", best).select(
            *rows.columns, F.col("best.c").alias("family"), F.col("best.p").alias("probability"), F.element_at("probs", none + 1).alias("p_none")
        )

    def notices(self, rows: DataFrame) -> DataFrame:
        """The scored rows that are likelier some licence than none."""
        # by a generator: a filter on plain columns would be pushed below the scores and work them out a second time
        said = F.inline_outer(F.array(F.struct("family", "probability", "p_none")))
        return self.score(rows).select(*rows.columns, said).where("probability > p_none")


def corpus_sample(docs: DataFrame) -> DataFrame:
    """Column ``words`` of at most SAMPLE paragraphs that are no notices."""
    rate = min(1.0, SAMPLE / 4 / max(1, docs.count()))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("license")), F.lit(1_000_000)) / 1_000_000
    # copies give their paragraphs once
    drawn = docs.where(draw < rate).select("doc_id", "text").dropDuplicates(["text"])
    heavy = F.array(*[F.lit(w) for w in ("license", "licensed", "copyright", "spdx")])
    rows = paragraphs(drawn).withColumn("words", words_of(F.col("p"))).where(~once(F.col("words"), lambda w: F.arrays_overlap(w, heavy) | like_template(w)))
    return rows.orderBy(F.xxhash64("doc_id", "paragraph", "words")).limit(SAMPLE).select("words")


def fit(spark: SparkSession, docs: DataFrame) -> Model:
    """Only counts reach the driver; the sample of the corpus stays on the cluster."""
    notices = [(t, family) for family, ts in TEMPLATES.items() for t in with_openings(ts)]
    cues = cue_words()
    known = set(cues)
    framed = [(i, f.format(t), c) for i, (t, c) in enumerate(notices) for f in FRAMES]
    vocabulary = sorted({f for _, t, _ in framed for f in _python_features(t) if known & set(f.split())})

    classes = [NONE, *TEMPLATES]
    index = {c: float(i) for i, c in enumerate(classes)}
    rows = framed + [(len(notices) + i, t, NONE) for i, t in enumerate(OTHERWISE) for _ in range(4)]
    own = spark.createDataFrame([(i, t, index[c]) for i, t, c in rows], "notice long, p string, label double")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="vector").setBinary(True)
    plain = corpus_sample(docs).select(F.xxhash64("words").alias("notice"), "words", F.lit(index[NONE]).alias("label"))
    frame = own.select("notice", words_of(F.col("p")).alias("words"), "label").unionByName(plain)
    frame = vectors.transform(frame.withColumn("grams", features(F.col("words")))).select("notice", "words", "label", "vector")
    frame = saved(frame.repartition(1), "license_rows")  # a few thousand rows

    size = {int(r["label"]): r["count"] for r in frame.groupBy("label").count().collect()}
    weigh = F.create_map(*[F.lit(x) for i, n in size.items() for x in (float(i), 1.0 if i == 0 else WEIGHT * size[0] / n)])
    frame = frame.withColumn("weight", weigh[F.col("label")])
    learner = LogisticRegression(featuresCol="vector", weightCol="weight", family="multinomial", elasticNetParam=1.0, regParam=PENALTY, maxIter=100, standardization=False)

    # the threshold: on one notice in FOLDS, in all its frames, learnt from the others
    held = F.pmod(F.xxhash64("notice", F.lit("fold")), F.lit(FOLDS)) == 0
    trial = Model(vectors, learner.fit(frame.where(~held)), classes, 0.0, cues)
    scored = trial.notices(frame.where(held).select("words", "label")).select("label", "family", "probability").collect()
    ranked = sorted(((r["probability"], classes[int(r["label"])] == r["family"]) for r in scored if r["family"] != UNKNOWN), reverse=True)
    learnt = learner.fit(frame)
    weighs = (learnt.coefficientMatrix.toArray() != 0).any(axis=0)
    return Model(vectors, learnt, classes, lowest_threshold(ranked), deciding_words(vocabulary, weighs.tolist(), cues))


def deciding_words(vocabulary: list[str], weighs: list[bool], cues: list[str]) -> list[str]:
    """Cues of which every feature that weighs something holds one: a paragraph without them is scored as one without features."""
    known, chosen = set(cues), set()
    left = [known & set(f.split()) for f, x in zip(vocabulary, weighs) if x]
    while left:
        forced = {w for f in left if len(f) == 1 for w in f}
        often = Counter(w for f in left for w in f)
        chosen |= forced or {min(often, key=lambda w: (-often[w], w))}
        left = [f for f in left if not f & chosen]
    return sorted(chosen)


def lowest_threshold(ranked: list[tuple[float, bool]]) -> float:
    """The least probability from which up a share of PRECISION was right; beyond 1 where there is none."""
    threshold, right = 2.0, 0
    for i, (p, ok) in enumerate(ranked):
        right += ok
        if right >= PRECISION * (i + 1):
            threshold = p
    return threshold


def license_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every licence notice: doc_id, paragraph, licence, family, probability, similarity and confirmed.

    Without a ``model`` one is fitted on ``docs``.  ``family`` is the classifier's, ``licence`` is the family when believed
    and confirmed, else "unknown".
    """
    spark = docs.sparkSession
    model = model or fit(spark, docs)
    # texts without such a word are not split into paragraphs, paragraphs without one not into words
    some = paragraphs(docs.where(holds_word(F.col("text").cast("string"), model.cues))).where(holds_word(F.col("p"), model.cues))
    found = model.notices(some.select("doc_id", "paragraph", words_of(F.col("p")).alias("words")))

    shared = F.lit(0.0)
    for family, templates in TEMPLATES.items():
        shared = F.when(F.col("family") == family, template_share(F.col("words"), templates)).otherwise(shared)
    found = found.withColumn("similarity", shared)
    believed = (F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold) & (F.col("similarity") >= CONFIRM)
    return found.select(
        "doc_id", "paragraph", F.when(believed, F.col("family")).otherwise(UNKNOWN).alias("licence"), "family",
        "probability", "similarity", believed.alias("confirmed"),
    )
