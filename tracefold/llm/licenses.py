"""Licence scan: trained paragraph classifier with DataFrame and SQL functions only.

Paragraphs are lines.  Their word unigrams and bigrams are hashed into a sparse
vector, and a multinomial logistic regression over licence families and a class
``unknown`` predicts the family.  It is fitted on statements of the families
(TEMPLATES in the contexts CONTEXTS) and on a bounded sample of ordinary
paragraphs.  On rows held out from the fit, a logistic regression on the margin
between the best family and ``unknown`` calibrates the chance that a paragraph
states a licence at all.  Predictions are then compared with the family's
templates; one whose bigrams the paragraph holds confirms it.
"""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import materialize
from .sampling import thin_out

FEATURES = 1 << 13
NEGATIVES = 4_000        # ordinary paragraphs in the fit, at most
NEGATIVE_DOCS = 2_000    # documents they come from, about
LEAST_COVERAGE = 0.6     # share of a template's bigrams
UNKNOWN = "unknown"

# Statements by which texts name their licence.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "released under the apache license 2.0",
        "you may not use this file except in compliance with the license",
        "distributed under the terms of the apache software license"],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "distributed under the terms of the mit licence"],
    "bsd": [
        "licensed under the bsd 3 clause license",
        "released under the bsd 2 clause license",
        "redistribution and use in source and binary forms with or without modification are permitted"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "released under the gnu general public license version 2 or later",
        "licensed under the gpl v3",
        "you can redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": [
        "licensed under the gnu lesser general public license version 3",
        "released under the gnu lesser general public license version 2.1"],
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "released under the gnu affero general public license"],
    "mpl": [
        "licensed under the mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0"],
    "cc-by": [
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": [
        "licensed under cc by sa 4.0",
        "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc": [
        "licensed under cc by nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-nd": [
        "licensed under cc by nd 4.0",
        "this work is licensed under a creative commons attribution noderivatives 4.0 international license"],
    "public-domain": [
        "this work is in the public domain",
        "dedicated to the public domain under cc0 1.0 universal",
        "released into the public domain by its author"],
    "all-rights-reserved": [
        "all rights reserved",
        "copyright 2020 all rights reserved",
        "no part of this publication may be reproduced without permission of the publisher"],
}
# Ordinary sentences, so that the class unknown is never empty.
PLAIN = ["the weather was fine that day", "she walked to the market in the morning", "a general rule of the public garden",
         "he took a copy of the work home", "the rights of the reader are many", "software is hard to write",
         "the school gave him a licence to drive", "see the table on the next page", "4.0 metres of rope",
         "under the bridge we saw a boat", "version two of the story", "this is the end of the chapter"]
CONTEXTS = ["{}", "{} .", "text {}", "{} see the file for details", "this document is {}", "c 2021 {}",
            "{} by the authors", "note : {}"]


def words(text: Column) -> Column:
    """Lower-cased words; a number keeps its decimal point, CC BY-NC 4.0 gives cc by nc 4.0."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[0-9]+(?:\.[0-9]+)*|[\p{L}\p{M}]+"), F.lit(0))


def bigrams(w: Column) -> Column:
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
                      F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
                      lambda a, b: F.concat_ws(" ", a, b))


def terms(w: Column) -> Column:
    return F.concat(w, bigrams(w))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, paragraph) of every line that is not blank."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "paragraph"))
            .filter(F.trim("paragraph") != ""))


def coverage(held: Column):
    """For a family, the largest share of one of its templates' bigrams among ``held`` ones."""
    def of(family: str) -> Column:
        shares = []
        for t in TEMPLATES[family]:
            parts = t.split()
            wanted = sorted({f"{a} {b}" for a, b in zip(parts, parts[1:])})
            shares.append(F.size(F.array_intersect(held, F.array(*map(F.lit, wanted)))) / len(wanted))
        return F.greatest(F.lit(0.0), *shares)
    return of


def _training(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [(family, c.format(t)) for family, ts in [*TEMPLATES.items(), (UNKNOWN, PLAIN)] for t in ts for c in CONTEXTS],
        "family string, paragraph string")
    docs = thin_out(docs, "doc_id", NEGATIVE_DOCS)
    plain = (paragraphs(docs).select(F.xxhash64("paragraph").alias("h"), "paragraph")
             .orderBy("h", "paragraph").limit(NEGATIVES).select("paragraph"))
    share = coverage(F.col("held"))
    plain = (plain.withColumn("words", words(F.col("paragraph")))
             .withColumn("held", F.array_distinct(bigrams(F.col("words"))))
             .filter(F.greatest(*[share(f) for f in TEMPLATES]) < LEAST_COVERAGE))
    plain = plain.select(F.lit(UNKNOWN).alias("family"), "paragraph")
    rows = known.unionByName(plain)
    return rows.withColumn("held_out", F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 0)


class LicenseModel:
    """Fitted classifier and calibration."""

    def __init__(self, docs: DataFrame):
        self.families = [*TEMPLATES, UNKNOWN]
        label = F.lit(len(TEMPLATES))
        for i, f in enumerate(TEMPLATES):
            label = F.when(F.col("family") == f, i).otherwise(label)
        rows = materialize(_training(docs).withColumn("label", label.cast("double")), "licence-training")
        rows = self.vectors(rows)
        self.model = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-4).fit(
            rows.filter("NOT held_out"))
        margins = self.margins(rows.filter("held_out")).select(
            array_to_vector(F.array("margin")).alias("features"),
            (F.col("family") != UNKNOWN).cast("double").alias("label"))
        platt = LogisticRegression(regParam=1e-3).fit(margins)
        self.slope, self.offset = float(platt.coefficients[0]), float(platt.intercept)

    @staticmethod
    def vectors(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("words", words(F.col("paragraph"))).withColumn("terms", terms(F.col("words")))
        return HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features").transform(rows)

    def margins(self, rows: DataFrame) -> DataFrame:
        """Adds best (number of the best family) and margin over ``unknown``."""
        raw = F.slice(F.col("raw"), 1, len(TEMPLATES))
        return (self.model.transform(rows).withColumn("raw", vector_to_array("rawPrediction"))
                .withColumn("best", (F.array_position(raw, F.array_max(raw)) - 1).cast("int"))
                .withColumn("margin", F.array_max(raw) - F.col("raw")[len(TEMPLATES)])
                .drop("rawPrediction", "probability", "prediction", "raw"))

    def scan(self, docs: DataFrame) -> DataFrame:
        known = 1 / (1 + F.exp(-(F.col("margin") * self.slope + self.offset)))
        found = (self.margins(self.vectors(paragraphs(docs))).withColumn("probability", known)
                 .filter("probability >= 0.5")
                 .withColumn("held", F.array_distinct(bigrams(F.col("words")))))
        share = coverage(F.col("held"))
        covered = F.lit(0.0)
        name = F.lit(UNKNOWN)
        for i, f in enumerate(TEMPLATES):
            covered = F.when(F.col("best") == i, share(f)).otherwise(covered)
            name = F.when(F.col("best") == i, f).otherwise(name)
        return found.select("doc_id", "pos", name.alias("family"), F.round("probability", 4).alias("probability"),
                            F.round(covered, 4).alias("coverage"), (covered >= LEAST_COVERAGE).alias("confirmed"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence statements: doc_id, pos (line from 0), family, probability, coverage, confirmed.

    docs: doc_id, text; further columns are ignored.  One row per line whose
    calibrated probability of stating a licence is at least one half; confirmed
    tells whether a template of the predicted family is covered.  Null, empty and
    blank texts and lines give no rows; repeated rows give repeated rows.
    """
    return LicenseModel(docs).scan(docs)
