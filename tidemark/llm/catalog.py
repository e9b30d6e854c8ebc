"""Queries of this subpackage over the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, table, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    from tidemark.llm.packing import best_fit_pack

    packed = best_fit_pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end_id=2)
    return packed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in patched frame-of-reference files, read back."""
    from tidemark.llm.token_files import read_token_files, write_token_files

    path = work_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary(), end_id=0)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and divergence verdict of all documents."""
    from tidemark.llm.quality import quality_rules

    q = quality_rules(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 4).alias("class_distance"), F.round("word_distance", 4).alias("word_distance"))


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents to the target weights of their sources."""
    from tidemark.llm.mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three quarters of them."""
    from tidemark.llm.language import predict, train

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    out = predict(docs, train(docs, F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False))))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from four fifths of the labelled ones."""
    from tidemark.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), "crc32(CAST(doc_id AS STRING)) % 5 != 0")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without sentences of spans that occurred before."""
    from tidemark.llm.substring import remove_repeats

    d = remove_repeats(table(spark, sf_dir, "documents"))
    return d.select("row.doc_id", F.length("text").cast("long").alias("n_kept"), "n_removed", "n_spans", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query
def op4_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector with all others."""
    from tidemark.llm.topk import top_products

    return top_products(table(spark, sf_dir, "embeddings"))


@query
def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes of 50-byte strings that occur in a document before."""
    from tidemark.llm.suffix import repeated_strings

    d = repeated_strings(table(spark, sf_dir, "documents"), length=50)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with four fifths of their word 5-grams in common."""
    from tidemark.llm.jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    from tidemark.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, share=50, top=2000)


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT COALESCE(lang, 'und') AS lang, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, i, array_to_string(w[:i], ' ') AS x, array_to_string(w[i + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS i FROM found)
), lefts AS MATERIALIZED (SELECT p.*, f AS l FROM parts p JOIN f ON f.lang = p.lang AND f.phrase = p.x),
cuts AS (
  SELECT p.lang, p.phrase, a, i, l, f AS r, (1000000::HUGEINT * a * a) // (l::HUGEINT * f) AS score
  FROM lefts p JOIN f ON f.lang = p.lang AND f.phrase = p.y
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, array_to_string(w[:2], ' ') AS phrase FROM found WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:], ' ') FROM found WHERE k = 3)
  GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.most IS NULL OR 100 * i.most < 50 * b.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query
def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as SentencePiece ids, and the texts decoded from these."""
    from tidemark.llm.pieces import encode

    d = encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), decoded=True)
    return d.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the first eight components of their covariance, whitened."""
    from tidemark.llm.whitening import whiten

    w = whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)
    return w.select("vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", "identity_error")
