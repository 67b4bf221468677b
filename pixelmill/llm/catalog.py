"""The queries of the text operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import (conversations, html_wrappers, language, line_runs, merkle, mixing, near_duplicates, oracles as sql, pieces, ranking, repair, secrets_crf,
                           weak_quality, winnowing)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_text(_table(spark, sf_dir, "pages"))


def op2_order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates per document."""
    return near_duplicates.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.filter(~out))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weak_quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    found = conversations.render(conversations.maximal(_table(spark, sf_dir, "conversations")))
    return found.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), "copies", "rendered")


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs."""
    return line_runs.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets_crf.scan(docs, secrets_crf.fit(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids per document under merge-dropout, with the check that they decode to the text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "lossless")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    given = _table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(given), given)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict per document."""
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and predicted label of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ranking.held_out(F.col("doc_id"))
    model = ranking.fit(docs.filter(~out), _table(spark, sf_dir, "labels").filter(~ranking.held_out(F.col("doc_id"))))
    return ranking.scored(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


_SNAPSHOTS_SQL = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
                  COALESCE(length(role) || ':' || role, '-') || '|' || COALESCE(length(text) || ':' || text, '-') AS turn_key FROM conversations),
h AS (SELECT *, list(turn_key) OVER (PARTITION BY conv_id ORDER BY k) AS p, COUNT(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT p, MIN(conv_id) AS conv_id, COUNT(*) AS copies FROM h WHERE k = n GROUP BY p),
kept AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.k < h.n AND h.p = w.p))
SELECT kept.conv_id, COUNT(*) AS n_turns, ANY_VALUE(kept.copies) AS copies,
       string_agg('<|im_start|>' || replace(replace(COALESCE(role, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
                  || replace(replace(COALESCE(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM kept JOIN t ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY kept.conv_id"""

_LINE_RUNS_SQL = """
WITH lines AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
               FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, i, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS s FROM lines),
seq AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, len(regexp_split_to_array(s, '[ \\t\\r\\f\\v]+')) AS w
        FROM x WHERE s <> ''),
c AS (SELECT *, SUM(w) OVER (PARTITION BY doc_id ORDER BY k) AS cw FROM seq),
near AS (SELECT a.doc_id, a.k AS s, b.k AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 AND b.cw - a.cw + a.w >= 50),
win AS (SELECT doc_id, s, MIN(e) AS e FROM near GROUP BY doc_id, s UNION SELECT doc_id, MAX(s), e FROM near GROUP BY doc_id, e),
txt AS (SELECT w.doc_id, w.s, w.e, string_agg(c.s, chr(10) ORDER BY c.k) AS t
        FROM win w JOIN c ON c.doc_id = w.doc_id AND c.k BETWEEN w.s AND w.e GROUP BY w.doc_id, w.s, w.e),
f AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS n FROM txt),
gone AS (SELECT DISTINCT a.doc_id, x.i FROM f JOIN c a ON a.doc_id = f.doc_id AND a.k = f.s JOIN c b ON b.doc_id = f.doc_id AND b.k = f.e
         JOIN x ON x.doc_id = f.doc_id AND x.i BETWEEN a.i AND b.i WHERE f.n > 1),
r AS (SELECT x.doc_id, string_agg(raw, chr(10) ORDER BY x.i) FILTER (gone.i IS NULL) AS text, COUNT(*) AS n_lines, COUNT(gone.i) AS n_deleted
      FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN COALESCE(r.text, '') END AS text, COALESCE(r.n_lines, 0) AS n_lines, COALESCE(r.n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN r USING (doc_id)"""

_MIXING_SQL = """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                      CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || COALESCE(md5(text), '') || '|'
                        || row_number() OVER (PARTITION BY doc_id, source, text) - 1), 1, 15) AS BIGINT) >> 24 AS b FROM documents),
s AS (SELECT source, SUM(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(place - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (SUM(source_size) OVER () * 1.5::DOUBLE - COALESCE(SUM(cap) OVER p, 0)) / (SUM(w) OVER () - COALESCE(SUM(w) OVER p, 0)) AS level
      FROM w WINDOW p AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, LEAST(cap, COALESCE(MAX(CASE WHEN cap / w >= level THEN level END) OVER () * w, cap)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS copies FROM t),
h AS (SELECT g.source, g.target - g.copies * g.source_size AS rest, b, SUM(size) AS n FROM sized JOIN g ON sized.source IS NOT DISTINCT FROM g.source
      GROUP BY g.source, rest, b),
u AS (SELECT *, SUM(n) OVER (PARTITION BY source ORDER BY b) AS upto FROM h),
e AS (SELECT source, rest, arg_min(struct_pack(b := b, n := n, upto := upto), b) FILTER (upto >= rest) AS e, MAX(b) AS last FROM u GROUP BY source, rest),
k AS (SELECT source, CASE WHEN e IS NULL THEN last + 1 WHEN e.upto - rest <= rest - (e.upto - e.n) THEN e.b + 1 ELSE e.b END AS edge FROM e)
SELECT doc_id, size, g.source_size::BIGINT AS source_size, g.target,
       CAST(size * (g.copies + CASE WHEN g.copies < 2 AND b < k.edge THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN g ON sized.source IS NOT DISTINCT FROM g.source JOIN k ON sized.source IS NOT DISTINCT FROM k.source"""

QUERIES = {f.__name__: f for f in (op1_wrappers, op2_order_min_hash, op3_language_id, op4_weak_quality, op5_snapshots, op6_line_runs, op7_winnowing, op8_secrets,
                                   op9_mixing, op10_merge_dropout, op11_repair, op12_manifest,
                                   op13_bradley_terry)}
ORACLES = {"op5_snapshots": _SNAPSHOTS_SQL, "op6_line_runs": _LINE_RUNS_SQL, "op9_mixing": _MIXING_SQL, "op11_repair": sql.REPAIR, "op12_manifest": sql.MERKLE}


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
