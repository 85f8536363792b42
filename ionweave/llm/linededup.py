"""Recurring lines dropped by a tree of line templates, in DataFrame operations only.

A line is parsed into tokens at spaces; tokens with a digit become the mark <*>. The tree has a fixed depth: token
count, then the leading tokens. Two kinds of templates recur:

* a masked line that stands in many documents as it is;
* in a leaf of the tree, the tokens that at least half of its lines agree on by position, all other positions being
  variable fields. Its lines are those that carry every constant token. At least half of the positions and one
  beyond the leading tokens must be constant, so lines that merely begin alike are no template.

Documents are counted by a signature (least hashes of their long words), which copies and near copies of one text
share: lines that recur because a document was copied stay. A template is dropped, with every line it covers, if its
documents have ``min_documents`` signatures or more and these are at least ``share`` of the documents.

Blank lines are left alone. A null text stays null, an empty one empty; equal rows get equal results. An empty table
gives an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.base import columns_only, query, table, written


@dataclass(frozen=True)
class LineParams:
    min_documents: int = 5
    share: float = 0.3
    depth: int = 3
    support: float = 0.5


#: A line without outer blanks, tokens with digits masked, single spaces.
MASK = r"""trim(regexp_replace(if(x rlike '[0-9]', regexp_replace(x, '[^ \t\r]*[0-9][^ \t\r]*', '<*>'), x), '[ \t\r]+', ' '))"""

def _key() -> list[Column]:
    """_id and _hash: rows that agree in both have the same id and text."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash")]


def _parsed(docs: DataFrame, depth: int) -> DataFrame:
    """_id, _hash, _sig, t (masked line), h (its hash) and leaf of every distinct masked line of every row, masked once for all
    that follows. _sig: two least hashes of the words of nine letters and more; a text without such words is signed by itself."""
    hashes = F.expr(r"transform(array_distinct(filter(split(text, '[ \n]+'), w -> length(w) >= 9)), w -> md5(w))")
    sig = F.expr("coalesce(concat(array_min(_hashes), array_min(transform(_hashes, h -> substr(h, 17)))), md5(text))")
    masks = F.expr(rf"array_distinct(filter(transform(split(text, '\n'), x -> {MASK}), x -> x <> ''))")
    each = (docs.select(*_key(), "text", hashes.alias("_hashes"), masks.alias("_masks"))
            .select("_id", "_hash", F.xxhash64(sig).alias("_sig"), F.explode("_masks").alias("t")))
    return each.select("*", F.xxhash64("t").alias("h"), F.xxhash64(F.size(F.split("t", " ")), F.expr(f"array_join(slice(split(t, ' '), 1, {depth}), ' ')")).alias("leaf"))


def _often(counted: DataFrame, p: LineParams) -> DataFrame:
    return counted.filter(f"sigs >= {p.min_documents} and sigs >= {p.share} * docs")


def recurring(lines: DataFrame, p: LineParams) -> DataFrame:
    """The hashes h of the masked lines that recurring templates cover. Lines go by their hashes; texts are looked up for the
    leaves that many documents share."""
    counted = written(lines.groupBy("h", "leaf", "_sig").agg(F.count("*").alias("n")), "line-counts")
    whole = written(_often(counted.groupBy("h").agg(F.count("*").alias("sigs"), F.sum("n").alias("docs")), p).select("h"), "whole-lines")
    rest = counted.join(whole, "h", "left_anti")
    leaves = written(rest.groupBy("leaf", "_sig").agg(F.sum("n").alias("n")).groupBy("leaf").agg(F.count("*").alias("sigs"), F.sum("n").alias("docs"))
                     .filter(f"sigs >= {p.min_documents}").select("leaf", "docs"), "leaves")
    kept = written(counted.join(leaves, "leaf").join(whole, "h", "left_anti"), "leaf-lines")
    texts = lines.select("leaf", "h", "t").join(leaves.select("leaf"), "leaf", "left_semi").join(whole, "h", "left_anti").select("leaf", "h", "t").distinct()
    told = written(kept.groupBy("leaf", "h", "docs").agg(F.sum("n").alias("n")).join(texts, ["leaf", "h"]), "leaf-texts")
    tokens = told.select("leaf", "docs", "n", F.posexplode(F.split("t", " ")).alias("pos", "token"))
    constants = (tokens.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n"), F.first("docs").alias("docs")).filter(f"n >= {p.support} * docs")
                 .groupBy("leaf", "pos").agg(F.max(F.struct("n", "token")).alias("m")).groupBy("leaf")
                 .agg(F.sort_array(F.collect_list(F.struct("pos", F.col("m.token").alias("token")))).alias("fixed"))     # a line's length at most
                 .filter(f"size(fixed) > {p.depth}"))
    covered = written(told.join(constants, "leaf").withColumn("_tokens", F.split("t", " "))
                      .filter("2 * size(fixed) >= size(_tokens) and forall(fixed, f -> _tokens[f.pos] = f.token)").select("leaf", "h"), "covered")
    often = _often(kept.join(covered, ["leaf", "h"]).groupBy("leaf", "_sig").agg(F.sum("n").alias("n")).groupBy("leaf").agg(F.count("*").alias("sigs"), F.sum("n").alias("docs")), p)
    return whole.unionAll(covered.join(often.select("leaf"), "leaf", "left_semi").select("h").distinct())


def drop_recurring_lines(docs: DataFrame, params: LineParams = LineParams(), lines: str = "_lines", dropped: str = "_dropped") -> DataFrame:
    """``docs`` with ``text`` cleaned, and the numbers of lines and of dropped lines under these names."""
    columns = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], F.col("doc_id"), F.col("text"))
    parsed = written(_parsed(own.select("doc_id", "text"), params.depth), "lines")
    found = written(recurring(parsed, params), "recurring")
    hits = parsed.select("_id", "_hash", "h").join(found, "h", "left_semi").groupBy("_id", "_hash").agg(F.collect_set("h").alias("_drop"))    # lines of one text at most
    stays = rf"filter(split(text, '\n'), x -> not coalesce(array_contains(_drop, xxhash64({MASK})), false))"
    return (own.select("*", *_key()).join(hits, ["_id", "_hash"], "left")
            .withColumn("_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))))
            .withColumn("_stay", F.when(F.col("_drop").isNull(), F.lit(None)).otherwise(F.expr(stays)))
            .withColumn("_dropped", F.when(F.col("_stay").isNull(), 0).otherwise(F.col("_lines") - F.size("_stay")))
            .withColumn("_clean", F.when(F.col("_stay").isNull(), F.col("text")).otherwise(F.array_join("_stay", "\n")))
            .select(*[(F.col("_clean") if c == "text" else F.col(f"c{k}")).alias(c) for k, c in enumerate(columns)], F.col("_lines").alias(lines), F.col("_dropped").alias(dropped)))


SQL = r"""
WITH masked AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines,
    list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(CASE WHEN regexp_matches(x, '[0-9]')
      THEN regexp_replace(x, '[^ \t\r]*[0-9][^ \t\r]*', '<*>', 'g') ELSE x END, '[ \t\r]+', ' ', 'g'), ' ')) AS masks,
    list_transform(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: length(w) >= 9), lambda w: md5(w)) AS hashes
  FROM documents),
signed AS (
  SELECT r, masks, coalesce(list_min(hashes) || list_min(list_transform(hashes, lambda h: substr(h, 17))), md5(text)) AS sig FROM masked),
line AS (SELECT DISTINCT r, sig, unnest(masks) AS t FROM signed),
lines AS (SELECT *, len(string_split(t, ' ')) || ':' || array_to_string(string_split(t, ' ')[1:3], ' ') AS leaf FROM line WHERE t <> ''),
whole AS (SELECT t FROM lines GROUP BY t HAVING count(DISTINCT sig) >= 5 AND count(DISTINCT sig) >= 0.3 * count(*)),
rest AS (SELECT * FROM lines WHERE t NOT IN (SELECT t FROM whole)),
leaves AS (SELECT leaf, count(*) AS docs FROM rest GROUP BY leaf HAVING count(DISTINCT sig) >= 5),
kept AS (SELECT r.*, l.docs, string_split(t, ' ') AS tokens FROM rest r JOIN leaves l USING (leaf)),
tokens AS (SELECT leaf, docs, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS token FROM kept),
counts AS (SELECT leaf, pos, token, count(*) AS n FROM tokens GROUP BY leaf, docs, pos, token HAVING count(*) >= 0.5 * docs),
best AS (SELECT *, row_number() OVER (PARTITION BY leaf, pos ORDER BY n DESC, token DESC) AS k FROM counts),
constants AS (SELECT leaf, list({'pos': pos, 'token': token}) AS fixed FROM best WHERE k = 1 GROUP BY leaf HAVING count(*) > 3),
covered AS (
  SELECT k.* FROM kept k JOIN constants c USING (leaf)
  WHERE 2 * len(fixed) >= len(tokens) AND len(list_filter(fixed, lambda f: tokens[f.pos] <> f.token)) = 0),
often AS (SELECT leaf FROM covered GROUP BY leaf HAVING count(DISTINCT sig) >= 5 AND count(DISTINCT sig) >= 0.3 * count(*)),
gone AS (SELECT t FROM whole UNION SELECT t FROM covered WHERE leaf IN (SELECT leaf FROM often)),
hits AS (SELECT r, list(t) AS gone FROM lines WHERE t IN (SELECT t FROM gone) GROUP BY r),
stay AS (
  SELECT m.doc_id, m.text, m.lines, h.gone, list_filter(range(1, len(m.lines) + 1), lambda i: NOT list_contains(h.gone, m.masks[i])) AS places
  FROM masked m LEFT JOIN hits h USING (r))
SELECT doc_id, coalesce(len(lines), 0)::INTEGER AS n_lines, CASE WHEN gone IS NULL THEN 0 ELSE len(lines) - len(places) END::INTEGER AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(places, lambda i: lines[i]), chr(10)) END AS text
FROM stay
"""


@query("op5_line_dedup", SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text")
