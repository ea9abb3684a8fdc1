"""Licence scan: TF-IDF cosine of notices to templates, then inheritance from ancestor directories.

DataFrame functions only. A file's notices are windows of its terms around every term that speaks
of licences, in several sizes and places, across line ends; so words around a notice can't dilute
it, wherever it stands in however long a text. Files that are licence files by name are compared
as a whole, too. Equal notices are compared once, however many files have them.

Terms weigh tf * idf, where the document frequencies are those of all notices of all files; terms
of no template have the smallest idf, 1, since they only tell how much else a notice says. The best
template with at least ``THRESHOLD`` gives the file's own licence.

A file without one inherits from the nearest ancestor directory (its own first) that holds a
licence file, by name, with a licence. Directories, not files, are joined to their ancestors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import checkpointed

THRESHOLD = 0.6
CUE = r"licen[cs]|copyright|spdx|permission|redistribut|warrant|public domain|creative commons|\bcc by|\bgpl\b"
#: The same for single terms; and pairs of terms, of which the first one is a cue.
CUE_TERM = r"licen[cs]|copyright|spdx|permission|redistribut|warrant|^gpl$"
CUE_PAIRS = (("public", "domain"), ("creative", "commons"), ("cc", "by"))
TERM = r"[a-z0-9]+(?:[.][0-9]+)*"
#: Terms of a window, and how many of them stand before its cue.
WINDOWS = tuple((size, before) for size in (6, 12, 24) for before in (size - 1, 2 * size // 3, size // 3, 0))
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)[^/]*$"
#: Names and the words of usual notices; fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for full license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved. Copyright. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
)


def _templates(spark: SparkSession) -> DataFrame:
    """(t, license, term, tf) of the templates, a table of fixed size."""
    rows = [F.struct(F.lit(k).alias("t"), F.lit(name).alias("license"), F.lit(text).alias("text")) for k, (name, text) in enumerate(TEMPLATES)]
    one = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return one.select("t", "license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("t", "license", "term").agg(F.count("*").alias("tf"))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _notices(text: Column, path: Column) -> Column:
    """A file's windows around cues, and all its terms if it is a licence file; equal ones once. Null where there is no cue."""

    def windows(terms: Column) -> Column:
        def cue(t: Column, i: Column) -> Column:
            pairs = [(t == a) & F.coalesce(F.get(terms, i + 1) == b, F.lit(False)) for a, b in CUE_PAIRS]
            return F.when(reduce(lambda x, y: x | y, pairs, t.rlike(CUE_TERM)), i)

        cues = F.filter(F.transform(terms, cue), lambda i: i.isNotNull())
        every = F.transform(cues, lambda i: F.array(*[F.array_join(F.slice(terms, F.greatest(i - before, F.lit(0)) + 1, F.lit(size)), " ") for size, before in WINDOWS]))
        whole = F.when(path.rlike(LICENSE_FILE), F.array(F.array_join(terms, " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.flatten(every), whole))

    return F.when(F.lower(text).rlike(CUE), F.transform(F.array(_terms(text)), windows)[0])


def _best(notices: DataFrame, threshold: float) -> DataFrame:
    """(id, license, score) of notices (id, notice, n) that come near a template.

    The templates' vocabulary is a table of fixed size, and so is all that is broadcast.
    """
    templates = _templates(notices.sparkSession)
    words = templates.select("term").distinct().withColumn("known", F.lit(True))
    total = notices.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    terms = notices.select("id", "n", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("id", "n", "term").agg(F.count("*").alias("tf"))
    terms = checkpointed(terms.join(F.broadcast(words), "term", "left"))
    df = terms.where("known").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((F.lit(float(total)) + 1) / (F.coalesce(F.col("df"), F.lit(0)) + 1)) + 1
    templates = checkpointed(templates.join(df, "term", "left").select("t", "license", "term", idf.alias("idf"), (F.col("tf") * idf).alias("tw")))
    norms = templates.groupBy("t").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    weights = F.broadcast(templates.select("term", "idf").distinct())
    own = terms.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    lengths = own.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = own.where("known").join(F.broadcast(templates.select("t", "license", "term", "tw")), "term").groupBy("id", "t", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    near = dots.join(F.broadcast(norms), "t").join(lengths, "id")
    near = near.withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6)).where(F.col("score") >= threshold)
    first = F.struct((-F.col("score")).alias("s"), "t")
    return near.groupBy("id").agg(F.min_by("license", first).alias("license"), F.max("score").alias("score"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``files`` (path, text): path, license, score, how, from_dir.

    how is ``notice`` (own), ``inherited`` (from_dir holds the licence file) or ``none``, with
    null license and score 0. Null and empty texts have no notices, and texts of any length are
    read whole; a null path counts as the
    empty one, a file in the root. Rows with the same path share their notices. Ties go to the
    higher score, then the earlier template, then the smaller path. An empty table gives an empty
    result; other columns are ignored, but a column doc_id comes through.
    """
    kept = [c for c in files.columns if c == "doc_id"]
    rows = files.select(F.coalesce("path", F.lit("")).alias("path"), "text", *kept)
    # Few rows, and texts are read once. From here on a notice is the hash of its terms; its text isn't repeated with each term.
    found = rows.select("path", F.explode(_notices(F.col("text"), F.col("path"))).alias("notice"))
    found = checkpointed(found.select("path", F.xxhash64("notice").alias("id"), "notice").dropDuplicates(["path", "id"]))
    best = checkpointed(_best(found.groupBy("id").agg(F.first("notice").alias("notice"), F.count("*").alias("n")), threshold))
    better = F.struct((-F.col("score")).alias("s"), "license")
    own = checkpointed(found.select("path", "id").join(best, "id").groupBy("path").agg(F.min_by("license", better).alias("license"), F.max("score").alias("score")))

    directory = F.regexp_replace("path", "/?[^/]*$", "").alias("dir")
    first = F.struct((-F.col("score")).alias("s"), "path")
    holders = own.where(F.col("path").rlike(LICENSE_FILE)).select("*", directory).groupBy("dir").agg(F.min_by("license", first).alias("license"), F.min_by("score", first).alias("score"))
    paths = rows.select("path", directory, *kept)
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    up = paths.select("dir").distinct().select("dir", F.explode(ancestors).alias("a")).select(F.col("dir").alias("of"), "a.depth", "a.up")
    nearest = up.join(holders, up["up"] == holders["dir"]).groupBy("of").agg(*[F.max_by(c, "depth").alias(f"i_{c}") for c in ("up", "license", "score")])
    nearest = checkpointed(nearest)

    every = paths.join(own, "path", "left").join(nearest, F.col("dir") == F.col("of"), "left")
    mine, theirs = F.col("license").isNotNull(), F.col("i_license").isNotNull()
    return every.select(
        *kept,
        "path",
        F.coalesce("license", "i_license").alias("license"),
        F.coalesce("score", "i_score", F.lit(0.0)).alias("score"),
        F.when(mine, "notice").when(theirs, "inherited").otherwise("none").alias("how"),
        F.when(~mine & theirs, F.col("i_up")).alias("from_dir"),
    )


def documents_as_files(documents: DataFrame) -> DataFrame:
    """``documents`` laid out as a tree, since they have no paths: source, two levels by id, and a name.

    Every fifth one is named as a licence file. A null source is the folder ``none``, a null id
    the file ``unnamed`` in the source's folder.
    """
    d = F.col("doc_id")
    name = F.when(d % 5 == 0, F.concat(F.lit("LICENSE-"), d)).otherwise(F.concat(d.cast("string"), F.lit(".txt")))
    place = F.concat_ws("/", F.floor(d / 1000).cast("string"), F.pmod(F.floor(d / 50).cast("long"), F.lit(20)).cast("string"), name)
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.when(d.isNull(), F.lit("unnamed")).otherwise(place))
    return documents.select("doc_id", path.alias("path"), "text")


def op7_license_scan(documents: DataFrame) -> DataFrame:
    """The scan of ``documents`` as files, with doc_id."""
    return scan(documents_as_files(documents)).select("doc_id", "path", "license", "score", "how", "from_dir")


def _oracle() -> str:
    quoted = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    terms = f"unnest(regexp_extract_all(lower({{}}), '{TERM}'))"
    idf = "(ln((total.n + 1.0::DOUBLE) / (coalesce(df, 0) + 1)) + 1)"
    pairs = "".join(f" OR (w[i] = '{x}' AND coalesce(w[i + 1], '') = '{y}')" for x, y in CUE_PAIRS)
    places = ", ".join(f"[{size}, {before}]" for size, before in WINDOWS)
    return f"""
WITH f AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || CASE WHEN doc_id IS NULL THEN 'unnamed' ELSE floor(doc_id / 1000.0)::BIGINT || '/' || floor(doc_id / 50.0)::BIGINT % 20 || '/'
    || CASE WHEN doc_id % 5 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END END AS path, text FROM documents
), l AS (
  SELECT path, regexp_extract_all(lower(text), '{TERM}') AS w FROM f WHERE regexp_matches(lower(text), '{CUE}')
), c AS (
  SELECT path, w, unnest([i FOR i IN range(1, len(w) + 1) IF regexp_matches(w[i], '{CUE_TERM}'){pairs}]) AS i FROM l
), x AS (
  SELECT path, w, i, unnest([{places}]) AS p FROM c
), p AS (
  SELECT DISTINCT path, array_to_string(w[greatest(i - p[2], 1):greatest(i - p[2], 1) + p[1] - 1], ' ') AS notice FROM x
  UNION SELECT path, array_to_string(w, ' ') FROM l WHERE regexp_matches(path, '{LICENSE_FILE}')
), q AS (SELECT notice, count(*) AS n FROM p GROUP BY 1),
total AS (SELECT coalesce(sum(n), 0)::DOUBLE AS n FROM q),
tp AS (SELECT t, license, term, count(*) AS tf FROM (SELECT t, license, {terms.format("text")} AS term FROM (VALUES {quoted}) v(t, license, text)) GROUP BY 1, 2, 3),
tm AS (SELECT notice, n, term, count(*) AS tf FROM (SELECT notice, n, {terms.format("notice")} AS term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, sum(n)::DOUBLE AS df FROM tm WHERE term IN (SELECT term FROM tp) GROUP BY 1),
ix AS (SELECT term, {idf} AS idf FROM (SELECT DISTINCT term FROM tp) LEFT JOIN df USING (term), total),
own AS (SELECT notice, term, tf * coalesce(idf, 1) AS w FROM tm LEFT JOIN ix USING (term)),
nm AS (SELECT notice, sqrt(sum(w * w)) AS norm FROM own GROUP BY 1),
tw AS (SELECT t, license, term, tf * idf AS tw FROM tp JOIN ix USING (term)),
tn AS (SELECT t, sqrt(sum(tw * tw)) AS tnorm FROM tw GROUP BY 1),
sc AS (SELECT notice, t, license, round(sum(w * tw) / (max(norm) * max(tnorm)), 6) AS score FROM own JOIN tw USING (term) JOIN nm USING (notice) JOIN tn USING (t) GROUP BY 1, 2, 3),
bs AS (SELECT notice, license, score FROM (SELECT *, row_number() OVER (PARTITION BY notice ORDER BY score DESC, t) AS k FROM sc WHERE score >= {THRESHOLD}) WHERE k = 1),
ow AS (SELECT path, license, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, license, notice) AS k FROM p JOIN bs USING (notice)) WHERE k = 1),
hd AS (SELECT dir, license, score FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) AS k FROM (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM ow WHERE regexp_matches(path, '{LICENSE_FILE}'))) WHERE k = 1),
nr AS (SELECT path, arg_max(hd.dir, length(hd.dir)) AS up, arg_max(hd.license, length(hd.dir)) AS license, arg_max(hd.score, length(hd.dir)) AS score FROM f JOIN hd ON hd.dir = '' OR starts_with(path, hd.dir || '/') GROUP BY 1)
SELECT f.doc_id, f.path, coalesce(ow.license, nr.license) AS license, coalesce(ow.score, nr.score, 0) AS score,
  CASE WHEN ow.license IS NOT NULL THEN 'notice' WHEN nr.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, CASE WHEN ow.license IS NULL THEN nr.up END AS from_dir
FROM f LEFT JOIN ow USING (path) LEFT JOIN nr USING (path)
"""


ORACLE_SQL = _oracle()
