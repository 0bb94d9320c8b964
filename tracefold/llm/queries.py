"""Registered queries: each applies one operator to its whole table."""

from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .chat import conversation_digests, format_turns
from .decontaminate import find_leaks
from .gridjoin import near_vectors
from .htmltext import PAGES_SQL, extract_text
from .licenses import scan_licenses
from .linededup import dedup_lines
from .minhash import near_duplicates
from .mixing import MIX_SQL, mix_sources
from .prefixtrie import prefix_trie, with_borrowed_starts
from .quality import fit_grades, grade_documents, ratings_from_labels
from .registry import ORACLES, QUERIES, query, read  # noqa: F401
from .sharding import assign_shards
from .sql import CHAT_SQL, LEAK_SQL, NEAR_SQL, TRIE_SQL, VARIANT_SQL, VECTOR_SQL
from .variants import group_variants, typed_words
from .voronoi import TOP_SQL, top_products

SHARDS = 8


@query("op1_near_duplicates", NEAR_SQL.format(docs="documents", width=3, percent=85))
def op1_near_duplicates(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


@query("op2_mix_sources", MIX_SQL.format(
    docs="documents", columns="doc_id, source, rate, copies, copy, sha256(coalesce(text, '')) AS text_sha256"))
def op2_mix_sources(spark, sf_dir):
    # the digest is of the texts that come out, so the shuffle moves whole documents
    mixed = materialize(mix_sources(read(spark, sf_dir, "documents")), "mixed")
    return mixed.select("doc_id", "source", "rate", "copies", "copy",
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op3_format_chats", CHAT_SQL)
def op3_format_chats(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conflict = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(conflict).alias("text"))
    return conversation_digests(format_turns(turns.unionByName(planted)))


@query("op10_shards")
def op10_shards(spark, sf_dir):
    # the digest is of the texts that come out, as they stand in their shards
    sharded = materialize(assign_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS), "shards")
    return sharded.select(
        "doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_quality_grades")
def op8_quality_grades(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_grades(docs, ratings_from_labels(read(spark, sf_dir, "labels")))
    return grade_documents(docs, model)


@query("op7_decontaminate", LEAK_SQL)
def op7_decontaminate(spark, sf_dir):
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op9_license_scan")
def op9_license_scan(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_dedup_lines")
def op4_dedup_lines(spark, sf_dir):
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_top_products", TOP_SQL)
def op5_top_products(spark, sf_dir):
    return top_products(read(spark, sf_dir, "embeddings"))


@query("op6_extract_text", PAGES_SQL)
def op6_extract_text(spark, sf_dir):
    return extract_text(read(spark, sf_dir, "pages"))


@query("op11_spelling_variants", VARIANT_SQL)
def op11_spelling_variants(spark, sf_dir):
    return group_variants(typed_words(read(spark, sf_dir, "documents")))


@query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(*with_borrowed_starts(read(spark, sf_dir, "conversations")))


@query("op13_near_vectors", VECTOR_SQL)
def op13_near_vectors(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"), 0.95)
