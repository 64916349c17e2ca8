"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, htmltext, langid, media, mixing, quality, simhash, spelling, token_counts, token_store, topk
from .storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by a network fitted on the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaves all documents' sources in proportion to the square roots of their sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.tempered_weights(docs, 0.5))


OP2_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shares AS (SELECT source, n, round(pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * 1000, 9) AS share FROM sizes),
floors AS (SELECT source, n, share, greatest(1, floor(share)) AS f FROM shares),
whole AS (
  SELECT source, n, cast(f + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, source NULLS FIRST) <= 1000 - sum(f) OVER () THEN 1 ELSE 0 END AS bigint) AS p
  FROM floors),
parts AS (SELECT source, n, p, row_number() OVER (ORDER BY source NULLS FIRST) AS r, cast(sum(p) OVER () AS bigint) AS total FROM whole),
sim(slot, counts, r, nth) AS (
  SELECT cast(-1 AS bigint), list(cast(0 AS bigint)), cast(0 AS bigint), cast(0 AS bigint) FROM parts
  UNION ALL
  SELECT slot + 1, list_transform(counts, lambda c, i: CASE WHEN i = best.r THEN c + 1 ELSE c END), best.r, best.nth
  FROM (
    SELECT slot, counts, list_sort(list_filter(list_transform(s, lambda x: CASE
        WHEN counts[x.r] * total // x.p <= slot + 1 AND counts[x.r] < x.p
        THEN {'d': ((counts[x.r] + 1) * total + x.p - 1) // x.p, 'r': x.r, 'nth': counts[x.r] + 1} END), lambda y: y IS NOT NULL))[1] AS best
    FROM sim, (SELECT list({'r': r, 'p': p} ORDER BY r) AS s, max(total) AS total FROM parts) WHERE slot + 1 < total)),
spec AS (SELECT parts.*, slots FROM parts JOIN (SELECT r, list(slot ORDER BY nth) AS slots FROM sim WHERE slot >= 0 GROUP BY r) USING (r)),
ends AS (SELECT min((n // 8) // p * total + slots[(n // 8) % p + 1]) AS until FROM spec),
numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(cast(doc_id AS varchar), '')), doc_id NULLS FIRST) - 1 AS k FROM documents)
SELECT doc_id, numbered.source, k // 8 AS block, (k // 8) * total // p AS release, ((k // 8 + 1) * total + p - 1) // p AS deadline,
  (k // 8) // p * total + slots[(k // 8) % p + 1] AS slot, k % 8 AS place, (k // 8) // p * total + slots[(k // 8) % p + 1] < until AS in_mix
FROM numbered JOIN spec ON numbered.source IS NOT DISTINCT FROM spec.source, ends
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the public 50k ranks."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents as shards with Elias-Fano boundaries and reads them back."""
    path = new_path(spark, "token-store")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_tokens(spark, path)


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector, by integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS bigint) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every document as WAV, reads it back, and fingerprints its spectral peaks."""
    return media.digests(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of three-word shingles, linked at three bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hides the speakers of a fifth of all rows, learns from the others, recovers the roles of all and renders their turns."""
    held_out = F.coalesce(F.crc32(F.concat_ws(":", "conv_id", "turn")) % 5 == 0, F.lit(False))
    rows = table(spark, sf_dir, "conversations")
    found = chat.format_chats(rows.withColumn("role", F.when(~held_out, F.col("role"))))
    return found.select("conv_id", "turn", "part", held_out.alias("held_out"), "role", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"), "copies")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two tokenizers in every document, and how often their tokens stand for each other."""
    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words one edit apart in all documents, and the frequent form that each stands for."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without what its site repeats."""
    return htmltext.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_cnn": op1_quality_cnn,
    "op2_pfair_mix": op2_pfair_mix,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_cross_parsing": op4_cross_parsing,
    "op5_token_store": op5_token_store,
    "op6_maxscore": op6_maxscore,
    "op7_token_counts": op7_token_counts,
    "op8_media": op8_media,
    "op9_simhash": op9_simhash,
    "op10_chat_hmm": op10_chat_hmm,
    "op11_alignment": op11_alignment,
    "op12_spelling": op12_spelling,
    "op13_html": op13_html,
}

ORACLE_SQL: dict[str, str] = {"op2_pfair_mix": OP2_SQL, "op6_maxscore": OP6_SQL}
