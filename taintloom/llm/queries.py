"""The registered queries of this package and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kmtree, langcrf, licenses, linededup, merkle, packing, piece_codec, piece_count, rpforest, secret_scan, simhash, toxicity, whitening
from .common import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.deduplicated(docs).select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), "removed")


def op4_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(table(spark, sf_dir, "documents"), digests=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.drop("text")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmtree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_count.token_counts(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langcrf.languages(docs, langcrf.fit(docs))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seventh document by its checksum is tampered with: its leaf is made of n_chars + 1 and folds to another root."""
    more = (F.col("n_chars").cast("decimal(19,0)") + 1).alias("n_chars")
    tampered = merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")])
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.manifest(table(spark, sf_dir, "documents"), carried={"tampered": F.when(touched, tampered)})
    folded = merkle.verified(rows.withColumn("shown", F.coalesce("tampered", "leaf")), "shown")
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_embedding_near_dedup,
        op2_best_fit_packing,
        op3_substring_dedup,
        op4_sentencepiece_codec,
        op5_toxicity,
        op6_nearest_neighbours,
        op7_license_scan,
        op8_token_counts,
        op9_language_id,
        op10_simhash_near_dedup,
        op11_secret_scan,
        op12_merkle_manifest,
        op13_embedding_whitening,
    )
    return {f.__name__: f for f in own}


#: Every pair of vectors compared, and components by a walk over the links. What the forest might miss would show here.
NEAR_VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
walk(start, node) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.start, l.b FROM walk w JOIN links l ON l.a = w.node)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, r.root AS component_id, v.vec_id = r.root AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id JOIN (SELECT start, min(node) AS root FROM walk GROUP BY start) r ON r.start = v.vec_id"""


#: A byte of the checksum's step, eight times; and a field of a leaf.
_BITS = "list_reduce(list_concat([{0}], range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Levels of both trees by recursion, siblings by position, and tampered leaves folded up again along them.
MERKLE_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS other,
  xor(list_reduce(list_concat([4294967295], list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))), lambda c, b: {_BITS.format("xor(c, b)")}), 4294967295) AS crc FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t(lang, level, pos, h, n) AS (SELECT lang, 0, pos, leaf, n FROM l UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, level, pos // 2, n),
s AS (SELECT lang, h AS subroot, max(level) OVER () AS deep, level, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, pos, h, n) AS (SELECT 0, pos, subroot, n FROM s UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
f(id, lang, pos, n, above, node, level, proof) AS (SELECT row_number() OVER (), lang, pos, n, false, CASE WHEN crc % 7 = 0 AND n_other THEN other ELSE leaf END, 0, '' FROM (SELECT *, other IS NOT NULL AS n_other FROM l)
  UNION ALL SELECT f.id, f.lang, CASE WHEN f.n > 1 THEN f.pos // 2 ELSE s.pos END, CASE WHEN f.n > 1 THEN (f.n + 1) // 2 ELSE s.n END, f.n <= 1,
    CASE WHEN f.n <= 1 THEN f.node WHEN o.h IS NULL THEN sha256(f.node) WHEN f.pos % 2 = 1 THEN sha256(o.h || f.node) ELSE sha256(f.node || o.h) END, CASE WHEN f.n > 1 THEN f.level + 1 ELSE 0 END, f.proof || coalesce(o.h, '')
  FROM f LEFT JOIN t o ON NOT f.above AND f.n > 1 AND o.lang IS NOT DISTINCT FROM f.lang AND o.level = f.level AND o.pos = xor(f.pos, 1) JOIN s ON s.lang IS NOT DISTINCT FROM f.lang WHERE NOT f.above),
g(id, pos, n, node, level, proof) AS (SELECT id, pos, n, node, 0, proof FROM f WHERE above
  UNION ALL SELECT g.id, g.pos // 2, (g.n + 1) // 2, CASE WHEN o.h IS NULL THEN sha256(g.node) WHEN g.pos % 2 = 1 THEN sha256(o.h || g.node) ELSE sha256(g.node || o.h) END, g.level + 1, g.proof || coalesce(o.h, '')
  FROM g LEFT JOIN u o ON o.level = g.level AND o.pos = xor(g.pos, 1) WHERE g.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.node AS folded_root, g.node = r.h AS verified
FROM (SELECT *, row_number() OVER () AS id FROM l) l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT h FROM u WHERE n = 1) r ON true JOIN g ON g.id = l.id AND g.n = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": NEAR_VECTORS_SQL, "op12_merkle_manifest": MERKLE_SQL}
