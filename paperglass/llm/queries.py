"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperglass.llm import ann_tree, bpe, chat_format, license_scan, merkle, packing, phrases, piece_bpe, secret_scan, simhash, token_count, topk, toxicity
from paperglass.llm.common import table
from paperglass.llm.vectors import valid


def _vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(chat_format.raw_transcripts(table(spark, sf_dir, "conversations")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", nonzero=True)
    return ann_tree.nearest(rows.where("id % 20 = 0"), rows, k=20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), _vocabulary_file("piece_bpe_32k.model"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", simhash.hex_print("fingerprint").alias("fingerprint"), "component_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def pack(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, _vocabulary_file("byte_bpe_50k.json"), _pattern(), end_id=0, special=("<|endoftext|>", 50256), capacity=1024)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), _vocabulary_file("byte_bpe_multi_50k.tiktoken"), _pattern())


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return topk.top_k(rows.where("id % 50 = 0"), rows, k=5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("long") + 1).otherwise(F.col("n_chars"))
    return merkle.audit(table(spark, sf_dir, "documents"), presented={"n_chars": altered})


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, first=2000)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"), _vocabulary_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_license_scan, op3_ann_tree, op4_token_counts, op5_simhash, op6_secret_scan, op7_packing, op8_byte_bpe, op9_exact_top_k, op10_toxicity,
        op11_merkle_manifest, op12_phrase_mining, op13_sentencepiece,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_top_k": """
WITH parts AS (
  SELECT vec_id AS id, pos, CAST(floor(256 * CAST(embedding[pos] AS DOUBLE)) AS BIGINT) AS x
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS p(pos)
  WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.pos = c.pos AND q.id <> c.id
  WHERE q.id % 50 = 0 GROUP BY q.id, c.id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
) WHERE rank <= 5
""",
    "op11_merkle_manifest": """
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree,
    sha256(concat_ws('', p1, p2, p3, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), p5)) AS d,
    sha256(concat_ws('', p1, p2, p3, coalesce(strlen(held::VARCHAR) || ':' || held, '-'), p5)) AS other
  FROM (
    SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS p1, coalesce(strlen(source) || ':' || source, '-') AS p2,
      coalesce(strlen(lang) || ':' || lang, '-') AS p3, coalesce(strlen(text) || ':' || text, '-') AS p5,
      n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS held
    FROM (SELECT *, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
            lambda c, x: list_reduce([xor(c, x)] || range(8), lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc FROM documents)
  )
), node AS (
  SELECT tree, 0 AS level, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, d FROM leaf
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY tree, level, i // 2, n
), subroot AS (SELECT tree, d FROM node WHERE n = 1
), high AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, d FROM subroot
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 2, n
), low_fold AS (
  SELECT doc_id, tree, 0 AS level, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, other AS acc, '' AS proof FROM leaf
  UNION ALL
  SELECT doc_id, f.tree, f.level + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN s.d IS NULL THEN acc WHEN f.i % 2 = 1 THEN s.d || acc ELSE acc || s.d END), proof || coalesce(s.d, '')
  FROM low_fold f LEFT JOIN node s ON s.tree = f.tree AND s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1
), high_fold AS (
  SELECT doc_id, 0 AS level, t.i, t.n, acc, proof FROM low_fold f JOIN (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM subroot) t ON t.tree = f.tree WHERE f.n = 1
  UNION ALL
  SELECT doc_id, f.level + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN s.d IS NULL THEN acc WHEN f.i % 2 = 1 THEN s.d || acc ELSE acc || s.d END), proof || coalesce(s.d, '')
  FROM high_fold f LEFT JOIN high s ON s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1
)
SELECT f.doc_id, l.d AS leaf, s.d AS subroot, r.d AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = r.d AS verified
FROM high_fold f JOIN leaf l ON l.doc_id = f.doc_id JOIN subroot s ON s.tree = l.tree JOIN high r ON r.n = 1 WHERE f.n = 1
""",
    "op12_phrase_mining": """
WITH words AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents)
), total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), phrase AS (
  SELECT lang, p, len(p) AS words, count(*) AS f
  FROM (SELECT lang, w[i : i + k - 1] AS p FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words) AS b, range(1, 6) AS s(k) WHERE i + k - 1 <= len(w))
  GROUP BY lang, p HAVING count(*) >= 100
), kept AS (
  SELECT * FROM phrase c WHERE words > 1 AND NOT EXISTS (
    SELECT 1 FROM phrase b WHERE b.lang = c.lang AND b.words > c.words AND 100 * b.f >= 100 * c.f
      AND len(list_filter(range(1, b.words - c.words + 2), lambda i: b.p[i : i + c.words - 1] = c.p)) > 0)
), scored AS (
  SELECT c.lang, c.p, c.f AS a, l.f AS l, r.f AS r, n, k, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM kept) c JOIN total t ON t.lang = c.lang
    JOIN phrase l ON l.lang = c.lang AND l.p = c.p[1 : k] JOIN phrase r ON r.lang = c.lang AND r.p = c.p[k + 1 :]
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM best
) WHERE rank <= 2000
""",
}
