"""Cross-site boilerplate removal on lines.

A line's spread is the number of distinct sites that carry it. One HyperLogLog sketch of sites per line hash is
built and merged by aggregation; lines whose estimate is near the threshold get an exact distinct count. Lines
that reach the threshold are removed everywhere but in the document with the lowest id that has them, so that
no content leaves the corpus altogether. DataFrame functions only.

Defined cases: lines are compared after removing spaces at both ends; blank lines are never boilerplate and
stay. A null text stays null with no lines. A null site counts as no site. Rows with the same id and text are
treated alike. A document may end up with an empty text; its row stays. An empty table gives an empty result.
Other columns are carried along whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdlp.llm.common import fits, fresh, hashes, same, saved, small

#: Sites a line must be on to be boilerplate.
MIN_SITES = 10
#: Sketch size as a power of two; the relative error is about 1.04 / sqrt(2 ** k).
SKETCH_K = 12


def line_rows(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """One row per line that is not blank: id, text hash, place, site and 128 bits of the trimmed line."""
    rows = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("body"), F.col(site).cast("string").alias("site"),
        F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"),
    )
    line = F.trim("line")
    one, two = hashes(line)
    return rows.where(line != "").select("id", "body", "at", "site", one.alias("h1"), two.alias("h2"))


def boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
                min_sites: int = MIN_SITES, k: int = SKETCH_K) -> DataFrame:
    """Line hashes on at least min_sites sites, with the lowest document id that has the line: h1, h2, first_id."""
    lines = line_rows(docs, doc_id, text, site)
    margin = max(1, math.ceil(5 * 1.04 / math.sqrt(1 << k) * min_sites))
    spread = (
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", k).alias("sketch"), F.count("*").alias("n"), F.min("id").alias("first_id"))
        .where(F.col("n") >= min_sites)
        .select("h1", "h2", "first_id", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites - margin)
    )
    spread = saved(spread)
    near = spread.where(F.col("sites") <= min_sites + margin)
    exact = (
        lines.join(small(near.select("h1", "h2"), 24), ["h1", "h2"])
        .groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("site").alias("exact"))
        .where(F.col("exact") >= min_sites)
    )
    sure = spread.where(F.col("sites") > min_sites + margin).select("h1", "h2", "first_id")
    return sure.unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first_id"))


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
           min_sites: int = MIN_SITES, k: int = SKETCH_K) -> DataFrame:
    """The documents without boilerplate lines, and two more columns: n_lines (before), n_removed."""
    found = saved(boilerplate(docs, doc_id, text, site, min_sites, k))
    hits = line_rows(docs, doc_id, text, site).join(small(found, 32), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first_id")))
    drops = hits.groupBy("id", "body").agg(F.collect_set("at").alias("drop"))
    key, lines, total, gone = (fresh(n, docs.columns) for n in ("line_key", "line_drop", "n_lines", "n_removed"))
    drops = saved(drops.select(F.col("id").alias("line_id"), F.col("body").alias(key), F.col("drop").alias(lines)))
    held = drops.agg(F.sum(F.size(lines) * 8 + 64 + F.octet_length(F.col("line_id").cast("string")))).first()[0]
    # Where the places to drop are few, the texts stay where they are; else they meet them in a shuffle.
    drops = F.broadcast(drops) if fits(held or 0, 1) else drops
    # The lines travel as an array, so that they are split once and not for each kept place.
    keyed = docs.withColumn(key, F.xxhash64(F.col(text))).withColumn(text, F.split(F.col(text), "\n"))
    joined = keyed.join(drops, same(keyed, drops, [(doc_id, "line_id"), (key, key)]), "left")
    parts, out = keyed[text], drops[lines]
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), out), lambda i: F.get(parts, i))
    body = F.array_join(F.when(out.isNull(), parts).otherwise(kept), "\n")
    return joined.select(
        *[body.alias(c) if c == text else keyed[c] for c in docs.columns],
        F.when(parts.isNull(), 0).otherwise(F.size(parts)).cast("long").alias(total),
        F.when(out.isNull(), 0).otherwise(F.size(out)).cast("long").alias(gone),
    )


def cleaned(docs: DataFrame, n_chars: str = "n_chars", **options) -> DataFrame:
    """The documents' own columns after `remove`; n_chars follows the text where it was changed."""
    out = remove(docs, **options)
    text, gone = options.get("text", "text"), out.columns[-1]
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(F.col(gone) > 0, F.length(F.col(text)).cast(kind)).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)


#: What `remove` gives on documents, with exact counts throughout.
SQL = """
WITH lines AS (
  SELECT doc_id, source, trim(line) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE trim(line) <> ''
), wide AS (
  SELECT line, min(doc_id) AS first_id FROM lines GROUP BY line HAVING count(DISTINCT source) >= {min_sites}
), cut AS (
  SELECT d.doc_id, l.place, l.line, w.line IS NOT NULL AND w.first_id <> d.doc_id AS gone
  FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line,
                                    generate_subscripts(string_split(d.text, chr(10)), 1) AS place) l
  LEFT JOIN wide w ON w.line = trim(l.line)
)
SELECT doc_id,
       coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM cut GROUP BY doc_id
UNION ALL
SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
