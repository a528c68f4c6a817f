"""License scan: TF-IDF cosine of licence headers to templates, and inheritance from licence files.

A header is a line that holds a licence cue. Its words, weighted by their rarity among all header lines,
are compared with the words of licence templates. A document without a header of its own takes the
licence of the licence file in its directory, or in the nearest directory above, found by joining paths.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, text_or_empty
from tessera.llm.secrets import either_case

# Notices by which licences are known.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0, no copyright."),
]
CUE_WORDS = ("license", "licence", "copyright", "spdx", "permission", "redistribution", "public domain")
CUE = "|".join(map(either_case, CUE_WORDS)) + r"|\b(CC|MIT|BSD|GPL|LGPL|MPL)\b"
TOKEN = "[a-z0-9]+([.+-][a-z0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LICENCE_FILE = "(" + "|".join(map(either_case, ("license", "licence", "copying"))) + r")([.][A-Za-z]+)?"


def tokens(column: Column) -> Column:
    return F.regexp_extract_all(F.translate(column, UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def weighted(rows: DataFrame, key: list[str], counts: DataFrame, total: int) -> DataFrame:
    """``key, token, weight`` of rows with a ``words`` array: frequency times smoothed inverse count."""
    tf = rows.select(*key, F.explode("words").alias("token")).groupBy(*key, "token").agg(F.count("*").alias("tf"))
    known = tf.join(counts.hint("merge"), "token", "left")
    idf = F.log(F.lit(1.0 + total) / (F.lit(1.0) + F.coalesce("n", F.lit(0)))) + 1.0
    return known.select(*key, "token", (F.col("tf") * idf).alias("weight"))


def license_scan(
    spark: SparkSession,
    docs: DataFrame,
    *,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    least: float = 0.6,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, path, license, score, basis, from_path``.

    ``basis`` is ``header`` (the document's own best line, cosine ``least`` or more; ties go to the first
    licence in alphabetical order, then the first line), ``inherited`` (from the licence file of the
    nearest directory above) or ``none``. Null and empty texts have no header, a null path has no
    ancestors. Null ids are carried; rows that repeat an id share the best header of that id and path.
    Other columns are not read. Equal lines are one row after the first count, however often they occur,
    and equal directories one row in the join of paths. Sides that grow with the input are merged, not
    broadcast: their repetitive paths are small when compressed, which is all the engine would look at.
    """
    scratch = Scratch(spark)
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), text_or_empty(text_col).alias("text"))
    lines = F.when(text.rlike(CUE), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(CUE)))
    headers = scratch.table(rows.select("doc_id", "path", F.posexplode(lines).alias("line_no", "line")))
    distinct = headers.groupBy("line").agg(F.count("*").alias("times")).select("line", "times", tokens(F.col("line")).alias("words"))
    distinct = scratch.table(distinct.filter("size(words) > 0"))
    counts = scratch.table(distinct.select("times", F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.sum("times").alias("n")))
    total = distinct.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    base = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(templates)], "template int, license string, notice string")
    mine = weighted(distinct.select("line", "words"), ["line"], counts, total)
    theirs = weighted(base.select("template", "license", tokens(F.col("notice")).alias("words")), ["template", "license"], counts, total)
    norm = mine.groupBy("line").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    other = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("other"))
    dots = mine.join(theirs.withColumnRenamed("weight", "theirs"), "token").groupBy("line", "template", "license").agg(F.sum(F.col("weight") * F.col("theirs")).alias("dot"))
    cosine = dots.join(norm.hint("merge"), "line").join(other, "template").select("line", "license", F.round(F.col("dot") / (F.col("norm") * F.col("other")), 6).alias("score"))
    scored = scratch.table(cosine.filter(F.col("score") >= least).groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best")))
    own = headers.join(scored.hint("merge"), "line").groupBy("doc_id", "path").agg(F.min(F.struct("best.score", "best.license", "line_no")).alias("b"))
    own = scratch.table(own.select("doc_id", "path", F.col("b.license").alias("license"), (-F.col("b.score")).alias("score")))

    folder = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.when(c.isNotNull(), ""))
    files = own.filter(F.regexp_replace("path", "^.*/", "").rlike(f"^{LICENCE_FILE}$")).select(folder(F.col("path")).alias("above"), "license", "score", "path")
    files = scratch.table(files.groupBy("above").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "path")).alias("f")))
    parts = F.split("folder", "/", -1)
    folders = scratch.table(rows.select(folder(F.col("path")).alias("folder")).filter("folder IS NOT NULL").distinct())
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    above = above.select("folder", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("above"))
    heirs = above.join(files.hint("merge"), "above").groupBy("folder").agg(F.max_by("f", "depth").alias("f"))
    heirs = scratch.table(heirs).select("folder", F.col("f.license").alias("their_license"), (-F.col("f.s")).alias("their_score"), F.col("f.path").alias("their_path"))
    mine = own.select(F.col("doc_id").alias("d"), F.col("path").alias("p"), F.col("license").alias("l"), F.col("score").alias("s"))
    out = rows.select("doc_id", "path", folder(F.col("path")).alias("folder"))
    out = out.join(mine.hint("merge"), out.doc_id.eqNullSafe(mine.d) & out.path.eqNullSafe(mine.p), "left").join(heirs.hint("merge"), "folder", "left")
    basis = F.when(F.col("l").isNotNull(), "header").when(F.col("their_license").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("l", "their_license").alias("license"), F.coalesce("s", "their_score").alias("score"), basis.alias("basis"), F.when(F.col("l").isNull(), F.col("their_path")).otherwise(F.col("path")).alias("from_path"))


def license_scan_sql(path: str, least: float = 0.6, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same over ``documents`` as DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    base = ", ".join(f"({n}, {q(a)}, {q(b)})" for n, (a, b) in enumerate(templates))
    words = lambda c: f"regexp_extract_all(translate({c}, '{UPPER}', '{LOWER}'), {q(TOKEN)}, 0)"
    folder = lambda c: f"CASE WHEN contains({c}, '/') THEN regexp_replace({c}, '/[^/]*$', '') WHEN {c} IS NOT NULL THEN '' END"
    return f"""
    WITH rows AS (SELECT doc_id, {path} AS path, coalesce(text, '') AS text FROM documents),
    split AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM rows WHERE regexp_matches(text, {q(CUE)})),
    headers AS (SELECT * FROM split WHERE regexp_matches(line, {q(CUE)})),
    dist AS (SELECT line, count(*) AS times, {words('line')} AS words FROM headers GROUP BY line),
    tok AS (SELECT line, times, unnest(words) AS token FROM dist),
    counts AS (SELECT token, sum(times) AS n FROM (SELECT DISTINCT line, times, token FROM tok) GROUP BY token),
    total AS (SELECT coalesce(sum(times), 0) AS lines FROM dist WHERE len(words) > 0),
    base AS (SELECT * FROM (VALUES {base}) v(template, license, notice)),
    mine AS (SELECT line, token, count(*) * (ln((1.0 + lines) / (1.0 + coalesce(any_value(n), 0))) + 1.0) AS weight FROM tok LEFT JOIN counts USING (token), total GROUP BY line, token, lines),
    theirs AS (SELECT template, license, token, count(*) * (ln((1.0 + lines) / (1.0 + coalesce(any_value(n), 0))) + 1.0) AS weight
               FROM (SELECT template, license, unnest({words('notice')}) AS token FROM base) LEFT JOIN counts USING (token), total GROUP BY template, license, token, lines),
    norm AS (SELECT line, sqrt(sum(weight * weight)) AS norm FROM mine GROUP BY line),
    other AS (SELECT template, sqrt(sum(weight * weight)) AS other FROM theirs GROUP BY template),
    dots AS (SELECT line, t.template, license, sum(m.weight * t.weight) AS dot FROM mine m JOIN theirs t USING (token) GROUP BY line, t.template, license),
    cosine AS (SELECT line, license, round(dot / (norm * other), 6) AS score FROM dots JOIN norm USING (line) JOIN other USING (template)),
    scored AS (SELECT line, license, score FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, license) AS k FROM cosine WHERE score >= {least}) WHERE k = 1),
    own AS (SELECT doc_id, path, license, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, license, line_no) AS k FROM headers JOIN scored USING (line)) WHERE k = 1),
    files AS (SELECT above, license, score, path FROM (SELECT *, row_number() OVER (PARTITION BY above ORDER BY score DESC, license, path) AS k FROM (SELECT *, {folder('path')} AS above FROM own WHERE regexp_matches(regexp_replace(path, '^.*/', ''), {q('^' + LICENCE_FILE + '$')}))) WHERE k = 1),
    folders AS (SELECT DISTINCT {folder('path')} AS folder FROM rows WHERE path IS NOT NULL),
    above AS (SELECT folder, d AS depth, array_to_string(string_split(folder, '/')[1:d], '/') AS above FROM (SELECT folder, unnest(range(0, len(string_split(folder, '/')) + 1)) AS d FROM folders)),
    heirs AS (SELECT folder, license, score, path FROM (SELECT folder, f.license, f.score, f.path, row_number() OVER (PARTITION BY folder ORDER BY depth DESC) AS k FROM above JOIN files f USING (above)) WHERE k = 1)
    SELECT r.doc_id, r.path, coalesce(o.license, h.license) AS license, coalesce(o.score, h.score) AS score,
           CASE WHEN o.license IS NOT NULL THEN 'header' WHEN h.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
           CASE WHEN o.license IS NULL THEN h.path ELSE r.path END AS from_path
    FROM rows r LEFT JOIN own o ON o.doc_id = r.doc_id AND o.path = r.path LEFT JOIN heirs h ON h.folder = {folder('r.path')}
    """
