"""The contract queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, jaccard, language_model, lines, packing, pieces, quality, secrets, sharding, simhash, topk, toxicity
from .common import read


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return language_model.score(read(spark, sf_dir, "documents"), held_out)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), size=2048, end=0)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), n=5, percent=75).drop("class")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(read(spark, sf_dir, "documents"), min_words=50)
    return out.select("doc_id", "n_lines", "n_deleted", "text")


def op5_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(read(spark, sf_dir, "documents"))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.classify(read(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("piece_bpe_32k.model")
    # the file is a BPE model; its pieces and scores are read as a unigram model, whose best path the scan finds
    ids = pieces.encode(read(spark, sf_dir, "documents"), path, kind=pieces.UNIGRAM)
    kept = ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "n_chunks", "text_crc32", "ids")
    text = pieces.decode(kept, path, ["doc_id", "n_ids", "ids_crc32", "n_chunks", "text_crc32"])
    return text.select("doc_id", "n_ids", "ids_crc32", "n_chunks", (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


def op9_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(read(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"), "fraction")


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(read(spark, sf_dir, "documents"), n=3, bits=2)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(read(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_log_bilinear_lm, op2_best_fit_packing, op3_jaccard_join, op4_line_dedup, op5_norm_sorted_topk, op6_secret_scans, op7_toxicity_chain, op8_sentencepiece, op9_stratified_sharding, op10_compression_bands, op11_simhash_dedup, op12_conversation_repair, op13_token_alignment)
}
# what SQL can express in full; at small sizes only, as SQL compares every pair that shares a shingle
ORACLES: dict[str, str] = {
    "op3_jaccard_join": r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
 n AS (SELECT r, doc_id, len(s) AS n FROM g), e AS (SELECT r, unnest(s) AS x FROM g),
 p AS (SELECT a.r AS a, b.r AS b, count(*) AS inter FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
 c AS (SELECT r AS a, r AS b FROM n UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
 k AS (SELECT c.a, min(n.doc_id) AS component_id FROM c JOIN n ON n.r = c.b GROUP BY c.a), d AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, k.component_id, coalesce(d.links, 0) AS n_links FROM n JOIN k ON k.a = n.r LEFT JOIN d ON d.a = n.r""",
    "op5_norm_sorted_topk": """WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    # CRC-32 by bits; a state of the lattice is its least 'cost, padded' || audit
    "op12_conversation_repair": r"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
 c AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS d FROM raw),
 m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE r END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE d <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM m),
 f AS (SELECT *, CASE WHEN s = '' THEN 3 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(s, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault, left(role, 1) AS q, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
 g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (i > 1 AND p || q NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
 plus AS (SELECT *, CASE WHEN fault = 1 THEN 5 ELSE 0 END AS e FROM f),
 dp AS (SELECT conv_id, 0::BIGINT AS i, '00000000' AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS c, NULL::VARCHAR AS d FROM g
  UNION ALL SELECT dp.conv_id, x.i,
   lpad(CAST(a[1:8]::INT + 2 AS VARCHAR), 8, '0') || a[9:] || 'D',
   least(lpad(CAST(b[1:8]::INT + 2 AS VARCHAR), 8, '0') || b[9:] || 'D', CASE WHEN fault < 2 AND q = 's' THEN lpad(CAST(a[1:8]::INT + e AS VARCHAR), 8, '0') || a[9:] || 'K' END),
   least(lpad(CAST(c[1:8]::INT + 2 AS VARCHAR), 8, '0') || c[9:] || 'D', CASE WHEN fault < 2 THEN list_min(list_concat(
     list_transform(list_filter([a, b, d], lambda z: z IS NOT NULL), lambda z: lpad(CAST(z[1:8]::INT + e + CASE WHEN q = 'u' THEN 0 ELSE 1 END AS VARCHAR), 8, '0') || z[9:] || CASE WHEN q = 'u' THEN 'K' ELSE 'R' END),
     list_transform(list_filter([c], lambda z: z IS NOT NULL), lambda z: lpad(CAST(z[1:8]::INT + 5 + e + CASE WHEN q = 'u' THEN 0 ELSE 1 END AS VARCHAR), 8, '0') || z[9:] || CASE WHEN q = 'u' THEN 'IK' ELSE 'IR' END))) END),
   least(lpad(CAST(d[1:8]::INT + 2 AS VARCHAR), 8, '0') || d[9:] || 'D', CASE WHEN fault < 2 THEN list_min(list_concat(
     list_transform(list_filter([c], lambda z: z IS NOT NULL), lambda z: lpad(CAST(z[1:8]::INT + e + CASE WHEN q = 'a' THEN 0 ELSE 1 END AS VARCHAR), 8, '0') || z[9:] || CASE WHEN q = 'a' THEN 'K' ELSE 'R' END),
     list_transform(list_filter([a, b, d], lambda z: z IS NOT NULL), lambda z: lpad(CAST(z[1:8]::INT + 5 + e + CASE WHEN q = 'a' THEN 0 ELSE 1 END AS VARCHAR), 8, '0') || z[9:] || CASE WHEN q = 'a' THEN 'IK' ELSE 'IR' END))) END)
  FROM dp JOIN plus x ON x.conv_id IS NOT DISTINCT FROM dp.conv_id AND x.i = dp.i + 1),
 z AS (SELECT dp.conv_id, least(a, d, lpad(CAST(c[1:8]::INT + 5 AS VARCHAR), 8, '0') || c[9:] || 'I', lpad(CAST(b[1:8]::INT + 10 AS VARCHAR), 8, '0') || b[9:] || 'II') AS best FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.n = dp.i),
 l AS (SELECT conv_id, best[9:] AS audit, unnest(string_split(best[9:], '')) AS l, unnest(range(1, len(best) - 7)) AS pos FROM z),
 w AS (SELECT *, count(*) FILTER (l <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM l),
 y AS (SELECT w.conv_id, pos, l, f.role, f.text, f.q, row_number() OVER (PARTITION BY w.conv_id ORDER BY pos) - 1 AS place FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i AND l <> 'I' WHERE l <> 'D'),
 v AS (SELECT *, max(CASE WHEN place = 0 AND l = 'K' AND q = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM y),
 h AS (SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (place - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos)) AS repaired_sha256 FROM v GROUP BY conv_id)
SELECT t.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated, coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(z.best[1:8]::BIGINT, 0) AS cost, coalesce(z.best[9:], '') AS audit, coalesce(h.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM t.conv_id""",
}
