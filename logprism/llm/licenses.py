"""Licence scans: TF-IDF cosine of header lines and licence files to templates, inherited along directories.

A file's statement are the lines that hold a licence word, wherever they stand;
a file with the name of a licence file is tried as a whole, too.  Statements and
templates are sparse vectors of words, weighted by the logarithm of rarity
among the templates, so words that no template has count for the length only.
A file's own licence is the template of the highest cosine, if that reaches
``threshold``; ties go to the first name.  A file without one inherits from the
nearest directory above, its own included, whose licence file has one.  The
directories above are a path each, joined by equality.

Of several licence files in a directory the one with the highest cosine counts,
then the first path.  A null path is a file in no directory; a null or empty
text states nothing.  Rows that repeat a path are scanned each.  Templates are
a small set of its own, whose size is checked before it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logprism.session import store

THRESHOLD = 0.5
#: Names of licence files, whatever their ending and case.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.\-_][^/]*)?$"
#: Words that mark a line as part of a licence statement.
CUE = r"(?i)\b(licen[cs]\w*|copyright|spdx\S*|permission is hereby granted|redistribution and use)\b"
#: Statements of common licences, in the wording that files use.  Fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
MOST_TEMPLATES = 10_000


def words_of(text: Column) -> Column:
    """Words in lower case, with repeats."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(
        [(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")


def template_vectors(templates: DataFrame) -> DataFrame:
    """``word, template, license, weight`` with unit vectors; ``idf`` is the word's rarity among the templates."""
    n = templates.count()
    if n > MOST_TEMPLATES:
        raise ValueError(f"{n} templates; the limit is {MOST_TEMPLATES}")
    counts = templates.select("template", "license", F.explode(words_of(F.col("text"))).alias("word"))
    counts = counts.groupBy("template", "license", "word").agg(F.count("*").alias("tf"))
    idf = counts.groupBy("word").agg((F.log(F.lit(n + 1.0) / (F.count("*") + 0.5)) + 0.1).alias("idf"))
    raw = counts.join(idf, "word").withColumn("raw", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "template").select(
        "word", "template", "license", "idf", (F.col("raw") / F.col("norm")).alias("weight"))


def statements(files: DataFrame) -> DataFrame:
    """``file, path, is_license, part, statement`` for rows ``file, path, text``; only files that state something."""
    name = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)
    listed = files.withColumn("is_license", name.rlike(LICENSE_FILE))
    lines = F.when(F.col("text").rlike(CUE), F.array_join(F.filter(
        F.split("text", "\n"), lambda line: line.rlike(CUE)), "\n"))
    parts = F.array(
        F.struct(F.lit("lines").alias("part"), lines.alias("statement")),
        F.struct(F.lit("whole").alias("part"), F.when(F.col("is_license"), F.col("text")).alias("statement")))
    return listed.select("file", "path", "is_license", F.inline(parts)).filter("statement <> ''")


def cosines(stated: DataFrame, vectors: DataFrame, unseen_idf: float) -> DataFrame:
    """``file, license, cosine``: the best template of each file over its statements."""
    terms = stated.select("file", "part", F.explode(words_of(F.col("statement"))).alias("word"))
    terms = terms.groupBy("file", "part", "word").agg(F.count("*").alias("tf"))
    seen = F.broadcast(vectors.groupBy("word").agg(F.first("idf").alias("idf"), F.collect_list(
        F.struct("template", "license", "weight")).alias("templates")))
    weighted = terms.join(seen, "word", "left").withColumn(
        "raw", F.col("tf") * F.coalesce("idf", F.lit(unseen_idf)))
    norms = weighted.groupBy("file", "part").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    products = weighted.select("file", "part", "raw", F.explode("templates").alias("t"))
    products = products.groupBy("file", "part", "t.template", "t.license").agg(
        F.sum(F.col("raw") * F.col("t.weight")).alias("dot"))
    scored = products.join(norms, ["file", "part"]).withColumn(
        "cosine", F.round(F.least(F.col("dot") / F.col("norm"), F.lit(1.0)), 9))
    return scored.groupBy("file").agg(
        F.min_by("license", F.struct(-F.col("cosine"), "license")).alias("license"), F.max("cosine").alias("cosine"))


def directories(path: Column) -> Column:
    """The directories of a path as structs of depth and name, the root (depth 0, '') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.struct(
        d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("directory")))


def license_scan(files: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``file, path, license, cosine, origin`` for rows ``file, path, text``; ``file`` identifies a row.

    ``origin`` is ``own``, ``inherited`` or null; an inherited licence has no cosine.
    """
    templates = template_table(files.sparkSession) if templates is None else templates
    vectors = store(template_vectors(templates), "templates")
    unseen = float(vectors.agg(F.max("idf")).first()[0] or 1.0)
    stated = statements(files.select("file", "path", "text"))
    stated = store(stated, "statements")
    own = store(stated.select("file", "path", "is_license").distinct().join(
        cosines(stated, vectors, unseen).filter(F.col("cosine") >= threshold), "file"), "licenses")
    parent = F.regexp_replace(F.regexp_replace("path", r"[^/]*\z", ""), r"/\z", "")
    granted = own.filter("is_license and path is not null").groupBy(parent.alias("directory")).agg(
        F.min_by("license", F.struct(-F.col("cosine"), "path", "license")).alias("granted"))
    # directories are looked up once each, not once for each file in them
    wanted = files.filter("path is not null").select(parent.alias("home")).distinct()
    above = wanted.select("home", F.explode(directories(F.concat("home", F.lit("/x")))).alias("d"))
    above = above.select("home", "d.depth", "d.directory")
    nearest = above.join(granted, "directory").groupBy("home").agg(F.max_by("granted", "depth").alias("granted"))
    rows = files.select("file", "path", parent.alias("home")).join(
        own.select("file", "license", "cosine"), "file", "left").join(nearest, "home", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("granted").isNotNull(), "inherited")
    return rows.select("file", "path", F.coalesce("license", "granted").alias("license"), "cosine", origin.alias("origin"))


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as files, by thousands and tens of their ids; the first of each directory is its licence file."""
    at = F.col("doc_id")
    thousand, ten = (F.floor(at / n).cast("string") for n in (1000, 10))
    path = F.when(at % 1000 == 0, F.concat_ws("/", thousand, F.lit("LICENSE"))).when(
        at % 10 == 0, F.concat_ws("/", thousand, ten, F.lit("LICENSE"))).when(
        at.isNotNull(), F.concat_ws("/", thousand, ten, F.concat(at.cast("string"), F.lit(".txt"))))
    return docs.select(at.alias("file"), path.alias("path"), "text")
