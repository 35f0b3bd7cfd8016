"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, bwt_dedup, conversations, embed_dedup, filter_audit, media, mixing, ngram_join, packing, quality, suffix_tree_lm, token_files, toxicity


def _tokenizers():
    import public_tokenizers

    return public_tokenizers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a file that gives fewer partitions than there are cores is dealt out to all of them."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tokenizers()
    return bpe.round_trip_digest(documents(spark, sf_dir), files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(documents(spark, sf_dir), n=3, threshold=0.9)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


def op4_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.dedup_digest(documents(spark, sf_dir), width=200)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, evidence=True).select("doc_id", toxicity.held_out(), "score", "predicted", "neighbours", "cosines")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(), "score", "predicted")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_digest(documents(spark, sf_dir))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tokenizers()
    folder, manifest = token_files.write_token_files(documents(spark, sf_dir), files.path("byte_bpe_50k.json"), by_word=True)
    return token_files.token_file_digest(folder, manifest)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order and step of the five filters for each language."""
    return filter_audit.order_report(filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels")), list(filter_audit.FILTERS))


def op12_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    packed = packing.pack(documents(spark, sf_dir), _tokenizers().path("byte_bpe_50k.json"), capacity=2048, by_word=True, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_audit(conversations.damage(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_ngram_join,
        op3_source_mixing,
        op4_bwt_dedup,
        op5_toxicity,
        op6_quality,
        op7_media_columns,
        op8_embedding_near_dedup,
        op9_suffix_tree_lm,
        op10_token_files,
        op11_filter_audit,
        op12_best_two_fit,
        op13_conversation_repair,
    )
}


def _filter_audit_sql() -> str:
    """Filters applied one after the other, for each of the 120 orders."""
    bit = {f: 1 << k for k, f in enumerate(filter_audit.FILTERS)}
    steps = ", ".join(f"('{''.join(o)}', {k}, {bit[o[k - 1]]}, {sum(bit[f] for f in o[: k - 1])})" for o in permutations(filter_audit.FILTERS) for k in range(1, 6))
    return f"""
with texts as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
words as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') w, min(doc_id) over (partition by t) least from texts),
known as (select doc_id, max(coalesce(quality = 1, false)) good, max(coalesce(toxic = 1, false)) bad from labels group by doc_id),
masks as (select part, coalesce(good, false) good, coalesce(bad, false) bad,
  (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(words.doc_id > least, false)::int mask
  from words left join known on words.doc_id = known.doc_id),
counted as (select part, mask, count(*) n, count(*) filter (good) good, count(*) filter (bad) bad from masks group by part, mask),
steps(filter_order, step, b, earlier) as (values {steps}),
reported as (select part, filter_order, step, b,
  sum(case when mask & (earlier | b) = 0 then n else 0 end) kept,
  sum(case when mask & earlier = 0 and mask & b <> 0 then n else 0 end) removed,
  sum(case when mask & earlier <> 0 and mask & b <> 0 then n else 0 end) redundant,
  sum(case when mask = b then n else 0 end) unique_fails,
  sum(case when mask & earlier = 0 and mask & b <> 0 then good else 0 end) good_lost,
  sum(case when mask & earlier = 0 and mask & b <> 0 then bad else 0 end) toxic_lost
  from counted cross join steps group by part, filter_order, step, b)
select part, filter_order, step::integer step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
  good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, b))::bigint shapley
from reported"""


ORACLES: dict[str, str] = {"op11_filter_audit": _filter_audit_sql()}
