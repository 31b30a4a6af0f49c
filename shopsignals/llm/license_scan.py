"""Licence scan (DataFrame functions only): sparse TF-IDF cosine of headers and
licence files to templates, then inheritance from the nearest licensed folder.

Every text is compared whole and by its sentences and lines (headers) with
``templates``, whole licence texts and notices. Terms are runs of a-z and 0-9 of
the lower-case text, weighted by count times idf = ln((1 + N) / (1 + df)) + 1
with N and df over all given files; a term of no template counts as unseen. A
part matches if its cosine to the best template is at least ``match`` and no
template of another licence comes nearer than ``margin`` to it: between neighbours
no licence is named. A part that holds none of the terms which make up all but
``match`` squared of a template's squared weight cannot reach ``match`` (Cauchy's
inequality): so the rarest terms that do so, of every template, tell the parts to
score, and no match of the templates in use is lost. A whole text that matches at ``whole`` gives a file its
licence, else the best matching header does, else the whole text. A file is a licence file if its whole text matches at ``whole``, or a
header does and it is named like one; it licenses its folder, and all files below
without a licence of their own get that of the nearest such folder: a join on the
folders' paths.

Results in cases of doubt: a null text has no licence of its own; the score is
that of the better match, 0 without one; of equal cosines of one licence's
templates either; of headers of equal score the smaller licence name wins; of a
folder's licence files the best match, then the smaller licence name, then the
smaller path; null path: no folder, nothing inherited; null parts of a path are
left out; rows that repeat an id or a path are files each; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsignals.llm.license_texts import TEMPLATES
from shopsignals.llm.tables import store

FILE_NAME = r"(?i)(^|/)(un)?licen[cs]e[^/]*$|(^|/)(copying|notice)[^/]*$"
SENTENCE_END = r"([.!?])[ \t]+"
MATCH, WHOLE, MARGIN = 0.75, 0.9, 0.005
TERM = "[^a-z0-9]+"


def _terms(text: str) -> Counter:
    return Counter(t for t in re.split(TERM, text.lower()) if t)


def terms(text: Column) -> Column:
    return F.split(F.lower(text), TERM)


def term_weights(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[DataFrame, float]:
    """(term, idf, its count in each template as an array) and the idf of an unseen
    term. One row a term of the templates."""
    counts = [_terms(text) for _, text in templates]
    vocabulary = sorted({t for c in counts for t in c})
    df = (files.select(F.explode(F.array_intersect(terms(F.col("text")), F.array(*[F.lit(t) for t in vocabulary]))).alias("term"))
          .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n = files.count()
    values = ", ".join(f"('{t}', '{','.join(str(c[t]) for c in counts)}')" for t in vocabulary)
    known = files.sparkSession.sql(f"SELECT _term, transform(split(c, ','), x -> CAST(x AS DOUBLE)) AS t FROM VALUES {values} AS v(_term, c)")
    idf = F.log(F.lit(1.0 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1
    out = known.join(df, known["_term"] == df["term"], "left").select("_term", idf.alias("idf"), "t")
    return store(out, "licence-terms"), math.log(1.0 + n) + 1


def norms_and_keys(weights: DataFrame, n: int, match: float) -> tuple[list[float], list[str]]:
    """The norm of each template, and terms of which any text that matches one at
    ``match`` holds at least one: of each template the rarest in the files, until the
    rest is less than ``match`` squared of its squared norm. Bounded by the templates."""
    rows = [(r["_term"], [r["idf"] * c for c in r["t"]], r["idf"]) for r in weights.collect()]
    norms, keys = [], set()
    for i in range(n):
        rarest = sorted(((idf, w[i] ** 2, t) for t, w, idf in rows if w[i] > 0), reverse=True)
        rest = total = sum(x for _, x, _ in rarest)
        norms.append(math.sqrt(total))
        for _, x, t in rarest:
            if rest < (match - 1e-4) ** 2 * total:
                break
            keys.add(t)
            rest -= x
    return norms, sorted(keys)


def matches(texts: DataFrame, weights: DataFrame, unseen: float, templates: list[tuple[str, str]], norms: list[float], held: Column,
            match: float, margin: float) -> DataFrame:
    """uid, part, license, score of every part of ``texts`` (uid, body) that matches:
    the whole text (part 0) and each header that holds one of the terms ``held``."""
    names = sorted({n for n, _ in templates})
    sentences = F.split(F.regexp_replace("body", SENTENCE_END, "$1\n"), "\n")
    parts = F.concat(F.array("body"), F.filter(sentences, lambda s: F.arrays_overlap(terms(s), held)))
    words = (texts.where("body is not null").select("uid", F.posexplode(parts).alias("part", "words"))
             .select("uid", "part", F.explode(terms(F.col("words"))).alias("term")).where("term <> ''"))
    tf = words.groupBy("uid", "part", "term").agg(F.count(F.lit(1)).alias("tf"))
    # the weights have one row a template term: their size is that of the templates
    w = tf.join(F.broadcast(weights), tf["term"] == weights["_term"], "left")
    weight = F.col("tf") * F.coalesce(F.col("idf"), F.lit(unseen))
    dots = w.groupBy("uid", "part").agg(
        F.sqrt(F.sum(weight * weight)).alias("norm"),
        *[F.coalesce(F.sum(weight * F.col("t")[i] * F.col("idf")), F.lit(0.0)).alias(f"d{i}") for i in range(len(templates))])
    # rounded first, so that equal cosines tie whatever the order of their sums
    of = lambda n: F.greatest(F.lit(0.0), *[F.round(F.col(f"d{i}") / (F.col("norm") * F.lit(norms[i])), 6) for i, (m, _) in enumerate(templates) if m == n])
    ranked = F.array_sort(F.array(*[F.struct((-of(n)).alias("s"), F.lit(n).alias("l")) for n in names]))
    best = dots.select("uid", "part", ranked[0].alias("b"), (F.try_element_at(ranked, F.lit(2))["s"] - ranked[0]["s"]).alias("ahead"))
    sure = (-F.col("b.s") >= match) & F.coalesce(F.col("ahead") >= margin, F.lit(True))
    return best.where(sure).select("uid", "part", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"))


def folder(path: Column) -> Column:
    """The folder of a path; '' is the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def nearest(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """_folder, inherited, license_folder: the nearest of ``licensed`` (dir,
    dir_license) at or above each of ``folders`` (folder), where there is one."""
    names = F.split("folder", "/")
    depth = F.when(F.col("folder") == "", F.lit(0)).otherwise(F.size(names))
    up = F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(names, 1, k), "/"))
    above = folders.select("folder", F.posexplode(up).alias("depth", "above"))
    met = above.join(licensed, above["above"] == licensed["dir"])
    return (met.groupBy("folder").agg(F.max(F.struct("depth", "dir_license", "dir")).alias("b"))
            .select(F.col("folder").alias("_folder"), F.col("b.dir_license").alias("inherited"), F.col("b.dir").alias("license_folder")))


def scan(files: DataFrame, key: str, match: float = MATCH, whole: float = WHOLE, margin: float = MARGIN,
         templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``key``, path, license, origin (file, header, inherited or none), score (cosine
    of the file's own match) and license_folder (of an inherited one). ``files``:
    ``key``, path, text; ``templates``: (licence, text)."""
    weights, unseen = term_weights(files, templates)
    norms, keys = norms_and_keys(weights, len(templates), match)
    held = F.array(*[F.lit(k) for k in keys])
    body = F.when(F.arrays_overlap(terms(F.col("text")), held), F.col("text"))  # texts that can match
    rows = store(files.select(F.col(key).alias("_key"), F.col("path").alias("_path"), body.alias("body"))
                 .withColumn("uid", F.monotonically_increasing_id()), "licence-texts")
    first = F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))
    best = (matches(rows.select("uid", "body"), weights, unseen, templates, norms, held, match, margin).groupBy(F.col("uid").alias("_uid"))
            .agg(F.min(F.when(F.col("part") > 0, first)).alias("h"), F.min(F.when(F.col("part") == 0, first)).alias("w")))
    f = rows.drop("body").join(best, rows["uid"] == best["_uid"], "left")
    in_header, in_whole = (F.coalesce(-F.col(f"{c}.s"), F.lit(0.0)) for c in "hw")
    is_header = in_header >= match
    f = store(f.select("_key", "_path", folder(F.col("_path")).alias("_dir"), F.greatest(in_header, in_whole).alias("score"),
                       F.when(in_whole >= whole, F.col("w.l")).when(is_header, F.col("h.l")).when(in_whole >= match, F.col("w.l")).alias("own"),
                       ((in_whole >= whole) | (is_header & F.coalesce(F.col("_path").rlike(FILE_NAME), F.lit(False)))).alias("is_file")), "licence-matches")
    licensed = (f.where("is_file and _dir is not null").groupBy(F.col("_dir").alias("dir"))
                .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("l"), "_path")).alias("b"))
                .select("dir", F.col("b.l").alias("dir_license")))
    # stored, so that the join below reads two exchanges and a large folder can be split
    near = store(nearest(f.where("_dir is not null and own is null").select(F.col("_dir").alias("folder")).distinct(), licensed), "licence-folders")
    out = f.join(near, (f["_dir"] == near["_folder"]) & f["own"].isNull(), "left")
    origin = F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("_key").alias(key), F.col("_path").alias("path"), F.coalesce("own", "inherited").alias("license"), origin.alias("origin"),
                      F.round("score", 4).alias("score"), "license_folder")


def scan_documents(documents: DataFrame) -> DataFrame:
    """The documents as files source/lang/doc_id of one tree."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan(documents.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text"), "doc_id")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: the same question in DuckDB SQL
DOCUMENTS_SQL = f"""
WITH template(i, license, body) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(b)})" for i, (n, b) in enumerate(TEMPLATES))}),
tt AS (SELECT i, license, term, count(*) AS tf FROM
       (SELECT i, license, unnest(string_split_regex(lower(body), '[^a-z0-9]+')) AS term FROM template) WHERE term <> '' GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term FROM tt),
d AS (SELECT row_number() OVER () AS uid, doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, text FROM documents),
df AS (SELECT term, count(DISTINCT uid) AS df FROM (SELECT uid, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM d)
       WHERE term IN (SELECT term FROM vocabulary) GROUP BY term),
size AS (SELECT count(*) AS n FROM d),
idf AS (SELECT v.term, ln((1.0 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM vocabulary v LEFT JOIN df USING (term), size),
tw AS (SELECT i, license, term, tf * idf AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT i, license, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL),
sentence AS (SELECT uid, text, string_split(regexp_replace(text, '{SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM d WHERE text IS NOT NULL),
part AS (SELECT uid, 0 AS part, text AS body FROM sentence UNION ALL
         SELECT uid, unnest(range(1, len(parts) + 1)) AS part, unnest(parts) AS body FROM sentence),
tf AS (SELECT uid, part, term, count(*) AS tf FROM
       (SELECT uid, part, unnest(string_split_regex(lower(body), '[^a-z0-9]+')) AS term FROM part) WHERE term <> '' GROUP BY ALL),
w AS (SELECT uid, part, term, tf * coalesce(idf, ln(1.0 + n) + 1) AS w FROM tf LEFT JOIN idf USING (term), size),
pn AS (SELECT uid, part, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dot AS (SELECT uid, part, i, sum(w.w * tw.w) AS dot FROM w JOIN tw USING (term) GROUP BY ALL),
cosine AS (SELECT uid, part, license, max(round(dot / (pn.norm * tn.norm), 6)) AS score FROM dot JOIN pn USING (uid, part) JOIN tn USING (i) GROUP BY ALL),
rank1 AS (SELECT *, coalesce(score - lead(score) OVER (PARTITION BY uid, part ORDER BY score DESC, license), score) AS ahead,
                 row_number() OVER (PARTITION BY uid, part ORDER BY score DESC, license) AS r FROM cosine),
best AS (SELECT uid, part > 0 AS header, license, score FROM rank1 WHERE r = 1 AND score >= {MATCH} AND ahead >= {MARGIN}
         QUALIFY row_number() OVER (PARTITION BY uid, part > 0 ORDER BY score DESC, license) = 1),
file AS (SELECT d.uid, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, greatest(coalesce(h.score, 0), coalesce(b.score, 0)) AS score,
                CASE WHEN b.score >= {WHOLE} THEN b.license WHEN h.score >= {MATCH} THEN h.license WHEN b.score >= {MATCH} THEN b.license END AS own,
                coalesce(b.score >= {WHOLE}, false) OR (coalesce(h.score >= {MATCH}, false) AND regexp_matches(path, '{FILE_NAME}')) AS is_file
         FROM d LEFT JOIN best h ON h.uid = d.uid AND h.header LEFT JOIN best b ON b.uid = d.uid AND NOT b.header),
licensed AS (SELECT dir AS lic_dir, own AS dir_license FROM file WHERE is_file
             QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, own, path) = 1),
near AS (SELECT f.dir, l.lic_dir, l.dir_license FROM (SELECT DISTINCT dir FROM file) f JOIN licensed l
         ON l.lic_dir = '' OR f.dir = l.lic_dir OR starts_with(f.dir, l.lic_dir || '/')
         QUALIFY row_number() OVER (PARTITION BY f.dir ORDER BY length(l.lic_dir) DESC) = 1)
SELECT doc_id, path, coalesce(own, dir_license) AS license,
       CASE WHEN is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       round(score, 4) AS score, CASE WHEN own IS NULL THEN lic_dir END AS license_folder
FROM file LEFT JOIN near USING (dir)"""
