"""Op 5: licences of files by TF-IDF cosine of their lines to templates, inherited from the nearest ancestor directory; DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, written

#: Header sentences of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Proprietary": "All rights reserved.",
}
#: Words without weight.
STOP = ["all", "the", "this", "under", "work", "is", "in", "of", "and", "to", "a"]
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: Names of files that speak for their directory.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"


def weights(templates: dict[str, str]) -> tuple[dict[str, float], list[tuple[str, str, float]], float]:
    """Weight of each template term, (template, term, unit-length weight), weight of terms in no template."""
    terms = {k: [t for t in re.findall(TERM, v.lower()) if t not in STOP] for k, v in templates.items()}
    n = len(terms)
    df = {t: sum(t in set(own) for own in terms.values()) for own in terms.values() for t in own}
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    out = []
    for k, own in terms.items():
        tf = {t: own.count(t) * idf[t] for t in own}
        length = math.sqrt(sum(x * x for x in tf.values()))
        out += [(k, t, x / length) for t, x in sorted(tf.items())]
    return idf, out, math.log(1 + n) + 1


def best_matches(files: DataFrame, keys: list[str], text: Column, templates: dict[str, str]) -> DataFrame:
    """keys (unique in ``files``), match struct(score, license): best line and template, null where no line has a template's alphabetic term."""
    idf, unit, other = weights(templates)
    signs = "|".join(sorted(re.escape(t) for t in idf if t.isalpha()))
    table = lambda pairs: F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    all_idf, zero = table(idf.items()), F.lit(0.0)
    # files, then lines, without any such term are passed over early
    lines = F.when(text.rlike(signs), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(signs)))
    df = files.select(*keys, F.explode_outer(lines).alias("_line"))
    df = df.select(*keys, F.filter(F.regexp_extract_all("_line", F.lit(TERM), F.lit(0)), lambda t: ~t.isin(STOP)).alias("_terms"))
    tf = lambda t: F.size(F.array_remove(F.transform("_terms", lambda u: u == t), F.lit(False)))
    df = df.select(*keys, F.transform(F.array_distinct("_terms"), lambda t: F.struct(t.alias("t"), (tf(t) * F.coalesce(F.try_element_at(all_idf, t), F.lit(other))).alias("x"))).alias("_weighed"))
    df = df.select(*keys, "_weighed", F.sqrt(F.aggregate("_weighed", zero, lambda acc, v: acc + v["x"] * v["x"])).alias("_length"))

    def score(name: str) -> Column:
        own = table((t, w) for k, t, w in unit if k == name)
        dot = F.aggregate("_weighed", zero, lambda acc, v: acc + v["x"] * F.coalesce(F.try_element_at(own, v["t"]), zero))
        return F.struct(F.round(dot / F.when(F.col("_length") > 0, F.col("_length")), 6).alias("score"), F.lit(name).alias("license"))

    best = F.when(F.col("_length").isNotNull(), F.array_max(F.array(*map(score, templates))))
    return df.groupBy(*keys).agg(F.max(best).alias("match"))


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it, the root as an empty name."""
    parts = F.split(folder, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def scan_licenses(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, id_col: str = "id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``id_col``, path, license, how (own, inherited or null), score, from_dir of every row.

    A file's licence is the template with the highest cosine to any of its lines (ties: the last name), if that reaches
    ``least``; else that of the nearest ancestor directory whose licence files name one (best score there, ties alike).
    Whole texts are scanned; only lines with a template's term are taken out of their row. Null and empty texts match nothing, a null path inherits
    nothing; equal rows and ids each give a row, other columns are ignored, an empty table gives an empty one.
    ``templates`` are the caller's few. Each directory is resolved once, however many files it holds.
    """
    rows = files.select(F.monotonically_increasing_id().alias("_n"), col(id_col).alias("_id"), col(path_col).cast("string").alias("path"), col(text_col).cast("string").alias("_text"))
    rows = best_matches(rows, ["_n", "_id", "path"], ascii_lower(F.coalesce("_text", F.lit(""))), templates)
    rows = written(rows.select(F.col("_id").alias(id_col), "path", F.col("match").alias("_b")), "licences")
    good = F.col("_b.score") >= least
    rows = rows.select(id_col, "path", F.regexp_extract("path", r"(?s)^(?:(.*)/)?[^/]*$", 1).alias("_dir"), F.when(good, F.col("_b.license")).alias("license"), F.when(good, F.col("_b.score")).alias("score"))
    own, bare = rows.where("license is not null"), rows.where("license is null")
    held = own.where(F.regexp_extract("path", r"(?s)([^/]*)$", 1).rlike(LICENSE_FILE)).groupBy(F.col("_dir").alias("from_dir")).agg(F.max(F.struct("score", "license")).alias("_l"))
    up = bare.where("_dir is not null").select("_dir").distinct().select(F.col("_dir").alias("_need"), F.explode(ancestors(F.col("_dir"))).alias("_up"))
    near = up.join(held, F.col("_up") == F.col("from_dir")).groupBy("_need").agg(F.max_by(F.struct("from_dir", "_l.license"), F.length("from_dir")).alias("_n"))
    got = bare.join(near, F.col("_dir") == F.col("_need"), "left").select(id_col, "path", F.col("_n.license").alias("license"), F.when(F.col("_n").isNotNull(), "inherited").alias("how"), F.lit(None).cast("double").alias("score"), F.col("_n.from_dir").alias("from_dir"))
    return own.select(id_col, "path", "license", F.lit("own").alias("how"), "score", F.lit(None).cast("string").alias("from_dir")).unionByName(got)


#: Paths for documents: short ones act as licence files, the shortest for all of a source and language.
PATH = """concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), case when length(text) < 150 then 'LICENSE' else concat_ws('/', cast({chunk} as {string}), case when length(text) < 400 then 'LICENSE' else concat(cast(doc_id as {string}), '.txt') end) end)"""
DOC_PATH = PATH.format(chunk="floor(doc_id / 500)", string="string")


def _oracle() -> str:
    idf, unit, other = weights(TEMPLATES)
    signs = "|".join(sorted(re.escape(t) for t in idf if t.isalpha()))
    stop = ", ".join(f"'{t}'" for t in STOP)
    rows = ", ".join(f"('{k}', '{t}', CAST({w!r} AS DOUBLE))" for k, t, w in unit)
    idfs = ", ".join(f"('{t}', CAST({w!r} AS DOUBLE))" for t, w in idf.items())
    return rf"""
WITH d AS (SELECT doc_id, {PATH.format(chunk="doc_id // 500", string="VARCHAR")} AS path, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), unit(license, term, w) AS (VALUES {rows}
), idfs(term, idf) AS (VALUES {idfs}
), l AS (SELECT doc_id, line, row_number() OVER () AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d WHERE regexp_matches(t, '{signs}')) WHERE regexp_matches(line, '{signs}')
), tf AS (SELECT doc_id, n, term, count(*) AS c FROM (SELECT doc_id, n, unnest(regexp_extract_all(line, '{TERM}')) AS term FROM l) WHERE term NOT IN ({stop}) GROUP BY ALL
), x AS (SELECT doc_id, n, tf.term, c * coalesce(idf, CAST({other!r} AS DOUBLE)) AS x FROM tf LEFT JOIN idfs ON tf.term = idfs.term
), len AS (SELECT n, sqrt(sum(x * x)) AS length FROM x GROUP BY n
), s AS (SELECT doc_id, license, round(sum(x * w) / max(length), 6) AS score FROM x JOIN unit ON x.term = unit.term JOIN len ON x.n = len.n GROUP BY doc_id, x.n, license
), best AS (SELECT doc_id, max({{'score': score, 'license': license}}) AS b FROM s WHERE score >= 0.8 GROUP BY doc_id
), f AS (SELECT d.doc_id, path, regexp_extract(path, '^(?:(.*)/)?[^/]*$', 1) AS dir, b.license AS license, b.score AS score FROM d LEFT JOIN best ON d.doc_id = best.doc_id
), held AS (SELECT dir, max({{'score': score, 'license': license}}).license AS license FROM f WHERE license IS NOT NULL AND path LIKE '%LICENSE' GROUP BY dir
), near AS (
  SELECT f.doc_id, max_by({{'license': held.license, 'dir': held.dir}}, length(held.dir)) AS n FROM f JOIN held ON f.dir = held.dir OR starts_with(f.dir, held.dir || '/') WHERE f.license IS NULL GROUP BY f.doc_id
)
SELECT f.doc_id, path, coalesce(f.license, n.license) AS license, CASE WHEN f.license IS NOT NULL THEN 'own' WHEN n IS NOT NULL THEN 'inherited' END AS how, score, n.dir AS from_dir
FROM f LEFT JOIN near ON f.doc_id = near.doc_id
"""


OP5_SQL = _oracle()
