"""One query for each operator, with production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, importance, line_dedup, mixing, near_duplicates, packing, personal_data, quality, rank_bpe, token_files, topk, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted as a prefix tree and read back from the stream."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    segments, places = chat.format_conversations(turns.unionByName(planted))
    digests = chat.digest_conversations(segments, places)
    return places.join(digests, "leaf_start").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written and read back; the end id is 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = token_files.write_token_files(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(manifest)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page urls judged by the rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = url_filter.rules_table(spark, url_filter.HOST_RULES, url_filter.PATTERN_RULES)
    return url_filter.judge_urls(pages.select("page_id", "url"), rules)[["page_id", "host", "path", "rule", "verdict", "pattern"]]


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by counts and by their distance from their language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = quality.judge_quality(docs.select("doc_id", "text", "lang"))
    distances = [F.round(c, 6).alias(c) for c in ("class_distance", "word_distance")]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *distances)


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources at the same weight, as many copies as documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "source", F.round("rate", 6).alias("rate"), "n_copies", "copy", "shuffle_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op6_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every vector whose id is divisible by 100, among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op6_sql() -> str:
    """DuckDB SQL for the query's rows: every query against every vector."""
    return """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id
    ), r AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
    )
    SELECT * FROM r WHERE rank <= 10"""


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents at a Jaccard similarity of 0.8 on five-word shingles, and each one's number of links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates.near_duplicates(docs.select("doc_id", "text"))
    return found.select(F.col("k1").alias("doc_id"), "class_id", "n_links")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten documents or more hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = line_dedup.drop_frequent_lines(docs.select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents, with the base kinds' counts and digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = personal_data.find_personal_data(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind_no"] < personal_data.N_BASE)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in personal_data.KINDS[: personal_data.N_BASE]]
    return found.select("doc_id", *counts, F.sha2(personal_data.span_list(base), 256).alias("base_sha256"), personal_data.span_list(F.col("spans")).alias("spans"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids; the end id is 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by ranks, and their ids decoded."""
    import public_tokenizers

    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    decoded = rank_bpe.encode_documents(docs.select("doc_id", "text"), path, pattern, decode=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 highest-scoring phrases of two to four words of each language, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return collocations.mine_collocations(docs.select("lang", "text"), min_count=30, most=2000)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the benchmark's texts; all documents with their weights."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text") for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    drawn = importance.resample(docs, target, percent=25, min_words=20, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {
    "op1_chat_prefix_tree": op1_chat_prefix_tree,
    "op2_token_files": op2_token_files,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_mtree_topk": op6_mtree_topk,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_line_dedup": op8_line_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_rank_bpe": op11_rank_bpe,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op1_chat_prefix_tree": chat.op1_sql(),
    "op3_url_filter": url_filter.op3_sql(),
    "op4_quality_rules": quality.op4_sql(),
    "op5_poisson_mixing": mixing.op5_sql(),
    "op6_mtree_topk": op6_sql(),
    "op8_line_dedup": line_dedup.op8_sql(10, 1),
    "op12_phrase_collocations": collocations.op12_sql(30, 2000),
    "op13_importance_resampling": importance.op13_sql(25, 20, 7),
}
