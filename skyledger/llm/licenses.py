"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance down directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD

#: The statements by which texts name their licence, and the licence's identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause New or Revised License"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons Zero 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
]
CUE = r"(?i)licen[sc]e|copyright|spdx|public domain"
#: Words of a window of a line, and words from one window to the next.
WINDOW, STRIDE = 24, 12
#: A header counts from this cosine on.
SIMILAR = 0.5


def tokens(text: Column) -> Column:
    """Lower-case terms: runs of letters, digits and inner points or hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def segments(files: DataFrame) -> DataFrame:
    """``file, version, segment``: the windows of every line that mention a licence; long lines give several."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(CUE))
    line = files.where(F.col("text").rlike(CUE)).select("file", "version", F.explode(lines).alias("line"))
    words = line.select("file", "version", F.regexp_extract_all("line", F.lit(WORD), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - STRIDE), F.lit(1)), F.lit(STRIDE))
    cut = words.select("file", "version", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("w", s, WINDOW), " "))).alias("segment"))
    return cut.where(F.col("segment").rlike(CUE))


def similarity(texts: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``segment, license, cosine``: the best template of every text that reaches ``SIMILAR``; ties go to the first name.

    ``texts`` are distinct, so a header that thousands of files repeat is one vector.
    Vectors are rows of (text, term, weight) over the terms of the templates; the inverse
    document frequency counts all texts and templates, and an equality join on the term
    with the small template table gives the products.
    """
    spark = texts.sparkSession
    of_template = spark.createDataFrame(templates, "license string, segment string")
    of_template = of_template.select("license", F.explode(tokens(F.col("segment"))).alias("term"))
    of_template = of_template.groupBy("license", "term").agg(F.count("*").alias("tf"))
    known = of_template.groupBy("term").agg(F.count("*").alias("m")).select(F.col("term").alias("known"), "m")
    of_text = texts.select("segment", F.explode(tokens(F.col("segment"))).alias("term"))
    of_text = of_text.join(known, F.col("term") == F.col("known"), "left_semi")
    of_text = materialise(of_text.groupBy("segment", "term").agg(F.count("*").alias("tf")), "license_terms")
    seen = of_text.groupBy("term").agg(F.count("*").alias("n"))
    every = texts.count() + len(templates)
    idf = known.join(seen, F.col("term") == F.col("known"), "left").select(
        "known", F.log((every + 1) / (F.col("m") + F.coalesce("n", F.lit(0)))).alias("idf")
    )
    idf = materialise(idf, "license_idf")
    weight = F.col("tf") * F.col("idf")
    t = of_template.join(idf, F.col("term") == F.col("known")).select("license", F.col("known").alias("t_term"), weight.alias("tw"))
    t_norm = t.groupBy("license").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("t_norm"))
    t = materialise(t.join(t_norm, "license"), "license_templates")
    s = of_text.join(idf, F.col("term") == F.col("known")).select("segment", "term", weight.alias("sw"))
    s_norm = s.groupBy("segment").agg(F.sqrt(F.sum(F.col("sw") * F.col("sw"))).alias("s_norm"))
    dots = s.join(t, F.col("term") == F.col("t_term")).groupBy("segment", "license", "t_norm").agg(
        F.sum(F.col("sw") * F.col("tw")).alias("dot")
    )
    cosine = F.round(F.col("dot") / (F.col("t_norm") * F.col("s_norm")), 6)
    best = dots.join(s_norm, "segment").select("segment", (-cosine).alias("away"), "license").where(F.col("away") <= -SIMILAR)
    best = best.groupBy("segment").agg(F.min(F.struct("away", "license")).alias("b"))
    return best.select("segment", F.col("b.license").alias("license"), (-F.col("b.away")).alias("cosine"))


def parent(path: Column) -> Column:
    """The directory of a path; the empty string for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, the root last."""
    parts = F.split(folder, "/")
    return F.concat(
        F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
        F.array(F.lit("")),
    )


def scan(files: DataFrame) -> DataFrame:
    """``file, license, cosine, how, licensed_by`` of every row of ``files`` (``file``, a path; ``text``).

    ``how`` is ``file`` for a licence file (at least half of its words belong to licence
    statements, or its name says so), ``header`` for another file that states a licence,
    ``inherited`` where the nearest directory upward with a licence file gives one, and
    NULL otherwise. Directories, not files, are joined with their ancestors, so a folder
    of millions of files is one row there. Of two licence files in one directory the more
    similar counts, then the first name. Other columns of ``files`` are kept as a struct
    ``row``. A row states what its own text states: rows that share a path are told apart
    by a hash of the text, and share only their directory. Rows without a path have no
    directory, so they neither grant nor inherit, and come out
    with an empty one. NULL texts are empty; repeated rows each
    get a row; an empty table gives none.
    """
    others = [c for c in files.columns if c not in ("file", "text")]
    row = F.struct(*others) if others else F.struct(F.lit(1).alias("row"))
    files = files.select("file", F.coalesce("text", F.lit("")).alias("text"), row.alias("row"))
    files = files.withColumn("version", F.xxhash64("file", "text"))
    light = materialise(files.select("file", "version", "row", F.regexp_count("text", F.lit(WORD)).alias("n_words")), "license_files")
    cut = materialise(segments(files).groupBy("file", "version", "segment").agg(F.count("*").alias("times")), "license_segments")
    best = materialise(similarity(cut.select("segment").distinct()), "license_best")
    n = F.col("times") * F.size(F.split("segment", " "))
    own = cut.join(best, "segment").groupBy("file", "version").agg(
        F.min(F.struct((-F.col("cosine")).alias("away"), "license")).alias("b"), F.sum(n).alias("covered")
    )
    own = own.select(F.col("file").alias("own_file"), F.col("version").alias("own_version"), "b.license", (-F.col("b.away")).alias("cosine"), "covered")
    named = F.coalesce(F.col("file").rlike(r"(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying)(?:[.-][^/]*)?$"), F.lit(False))
    whole = named | (2 * F.col("covered") >= F.col("n_words"))
    how = F.when(F.col("own_version").isNotNull(), F.when(whole, "file").otherwise("header"))
    same = (F.col("version") == F.col("own_version")) & F.col("file").eqNullSafe(F.col("own_file"))
    stated = light.join(own, same, "left").select(
        "file", "row", "license", "cosine", how.alias("how"), parent(F.col("file")).alias("folder")
    )
    stated = materialise(stated, "license_stated")
    granted = stated.where("how = 'file' and folder is not null").groupBy("folder").agg(
        F.min(F.struct((-F.col("cosine")).alias("away"), "license", "file")).alias("g")
    )
    above = stated.where("how is null and folder is not null").select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("up"))
    near = above.join(granted.select(F.col("folder").alias("up"), "g"), "up").groupBy("folder").agg(
        F.max_by("g", F.length("up")).alias("g")
    )
    near = materialise(near.select(F.col("folder").alias("under"), F.col("g.license").alias("given"), F.col("g.file").alias("giver"), (-F.col("g.away")).alias("given_cosine")), "license_near")
    out = stated.join(near, F.col("how").isNull() & (F.col("folder") == F.col("under")), "left")
    name = F.coalesce("file", F.lit(""))
    return out.select(
        name.alias("file"), "row", F.coalesce("license", "given").alias("license"), F.coalesce("cosine", "given_cosine").alias("cosine"),
        F.coalesce("how", F.when(F.col("given").isNotNull(), "inherited")).alias("how"),
        F.when(F.col("how").isNotNull(), name).otherwise(F.col("giver")).alias("licensed_by"),
    )


def document_path(doc_id: Column, source: Column, lang: Column) -> Column:
    """A path for a document that has none: source, language, two levels of folders by id; NULL without an id."""
    def part(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("none"))

    path = F.concat_ws(
        "/", part(source), part(lang), part(F.floor(doc_id / 512)), part(F.floor(doc_id / 32)), F.concat(part(doc_id), F.lit(".txt"))
    )
    return F.when(doc_id.isNotNull(), path)


def op3(docs: DataFrame) -> DataFrame:
    files = docs.select("doc_id", document_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("file"), "text")
    return scan(files).select(F.col("row.doc_id").alias("doc_id"), "file", "license", "cosine", "how", "licensed_by")


_TOKENS = r"regexp_extract_all(lower(segment), '[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*')"
_VALUES = ", ".join("('%s', '%s')" % pair for pair in TEMPLATES)
OP3_SQL = rf"""
WITH tp(license, segment) AS (VALUES {_VALUES}),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS ver, CASE WHEN doc_id IS NOT NULL THEN concat_ws('/', coalesce(source, 'none'),
    coalesce(lang, 'none'), (doc_id // 512)::VARCHAR, (doc_id // 32)::VARCHAR, doc_id::VARCHAR || '.txt') END AS file
  FROM documents
), li AS (
  SELECT file, ver, unnest(string_split(text, chr(10))) AS line FROM d
), wd AS (
  SELECT file, ver, regexp_extract_all(line, '{WORD}') AS w FROM li WHERE regexp_matches(line, '{CUE}')
), sg AS (
  SELECT file, ver, array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ') AS segment
  FROM (SELECT file, ver, w, unnest(range(1, greatest(len(w) - {WINDOW - STRIDE}, 1) + 1, {STRIDE})) AS s FROM wd)
), ct AS (
  SELECT file, ver, segment, count(*) AS times FROM sg WHERE regexp_matches(segment, '{CUE}') GROUP BY ALL
), tx AS (
  SELECT DISTINCT segment FROM ct
), tt AS (
  SELECT license, term, count(*) AS tf FROM (SELECT license, unnest({_TOKENS}) AS term FROM tp) GROUP BY ALL
), kn AS (
  SELECT term, count(*) AS m FROM tt GROUP BY term
), st AS (
  SELECT segment, term, count(*) AS tf FROM (SELECT segment, unnest({_TOKENS}) AS term FROM tx) SEMI JOIN kn USING (term) GROUP BY ALL
), idf AS (
  SELECT term, ln(((SELECT count(*) FROM tx) + {len(TEMPLATES)} + 1)::DOUBLE / (m + coalesce(n, 0))) AS idf
  FROM kn LEFT JOIN (SELECT term, count(*) AS n FROM st GROUP BY term) USING (term)
), tw AS (
  SELECT license, term, tf * idf AS tw, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license)) AS tn FROM tt JOIN idf USING (term)
), sw AS (
  SELECT segment, term, tf * idf AS sw, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY segment)) AS sn FROM st JOIN idf USING (term)
), cs AS (
  SELECT segment, license, round(sum(sw * tw) / (any_value(tn) * any_value(sn)), 6) AS cosine FROM sw JOIN tw USING (term) GROUP BY ALL
), be AS (
  SELECT segment, arg_min(license, {{'a': -cosine, 'b': license}}) AS license, max(cosine) AS cosine FROM cs WHERE cosine >= {SIMILAR} GROUP BY segment
), own AS (
  SELECT file, ver, arg_min(license, {{'a': -cosine, 'b': license}}) AS license, max(cosine) AS cosine,
    sum(times * len(string_split(segment, ' '))) AS covered
  FROM ct JOIN be USING (segment) GROUP BY file, ver
), sd AS (
  SELECT d.doc_id, d.file, own.license, own.cosine, regexp_replace(d.file, '/?[^/]*$', '') AS folder,
    CASE WHEN own.ver IS NOT NULL THEN CASE WHEN 2 * covered >= len(regexp_extract_all(d.text, '{WORD}')) THEN 'file' ELSE 'header' END END AS how
  FROM d LEFT JOIN own ON own.ver = d.ver AND own.file IS NOT DISTINCT FROM d.file
), gr AS (
  SELECT folder AS up, min({{'a': -cosine, 'license': license, 'file': file}}) AS g FROM sd WHERE how = 'file' AND folder IS NOT NULL GROUP BY folder
), fo AS (
  SELECT DISTINCT folder, string_split(folder, '/') AS parts FROM sd WHERE how IS NULL AND folder IS NOT NULL
), ab AS (
  SELECT folder, unnest(list_append(list_transform(range(1, len(parts) + 1), lambda n: array_to_string(parts[1:n], '/')), '')) AS up FROM fo
), nr AS (
  SELECT folder, arg_max(g, length(up)) AS g FROM ab JOIN gr USING (up) GROUP BY folder
)
SELECT doc_id, coalesce(file, '') AS file, coalesce(license, g.license) AS license, coalesce(cosine, -g.a) AS cosine,
  coalesce(how, CASE WHEN g IS NOT NULL THEN 'inherited' END) AS how, CASE WHEN how IS NOT NULL THEN coalesce(file, '') ELSE g.file END AS licensed_by
FROM sd LEFT JOIN nr ON how IS NULL AND nr.folder = sd.folder
"""
