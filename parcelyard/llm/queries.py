"""The queries of this subpackage, by name: each takes (spark, sf_dir) and applies one operator to its whole table."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ann, bpe, html_extract, lexical, lm_scoring, media, near_dedup, packing, secrets, sharding, token_files, toxicity
from .common import id_bucket, shared_dir, table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_jump_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.sharded(documents, shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op4_swap_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path("word_bpe_49k.json"))


def op5_tree_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.near_copies(media.rendered(table(spark, sf_dir, "embeddings")))


def op7_rank_queue_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    def digests(codec: bpe.BytePairCodec, ids) -> tuple:
        listed = ",".join(map(str, ids.tolist())).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.map_encoded(documents, ranks or tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests, added)


def op8_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    score = F.col("toxicity.score")
    return scored.select(
        "doc_id",
        F.coalesce(id_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"),
        F.size("toxicity.offending").alias("n_offending"),
    )


def op9_vantage_points(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k)


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    spans = F.col("secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, secrets.KINDS),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.sha2(secrets.listed(spans, secrets.KINDS[:3]), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


def op11_arrow_sequences(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = f"{shared_dir(spark)}/sequences/{uuid.uuid4().hex}"
    token_files.write_sequences(table(spark, sf_dir, "documents"), path, tokenizer or tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, path)


def op12_sorted_accumulation(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k)


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op") and name[2].isdigit()}

#: Exact SQL for what SQL can express: all pairs that share a shingle, and the closure of their links.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by all),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on links.a = reach.b)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d left join sizes using (doc_id) join (select a, min(b) as component_id from reach group by all) m on m.a = d.doc_id""",
    "op12_sorted_accumulation": r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
sizes as (select doc_id, count(*) as n from terms group by all),
whole as (select count(*) as nn, sum(n)::bigint as ll from sizes),
tfs as (select doc_id, t, count(*) as tf from terms semi join asked using (t) group by all),
weights as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint as w from (select t, count(*) as df from tfs group by all), whole),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))))::bigint as score
  from asked join tfs using (t) join weights using (t) join sizes using (doc_id), whole group by all)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 50""",
}
