"""The registered queries of these operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, html, langid, licences, media, mixing, neardup, nndescent, pieces, pii, sharding, topk, trie
from .common import cut, settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantise(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: neardup.near_duplicates(table(spark, sf_dir, "documents")))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = sharding.assign_shards(docs, ["doc_id"], F.col("n") + 1, 8, ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "lossless")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settled(lambda: mixing.mix_documents(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(F.array_distinct("licenses.license"), ",").alias("license_ids"), "licenses")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: trie.prefix_trie(*trie.crossed(cut(trie.numbered(table(spark, sf_dir, "conversations"))))))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", topk.quantise(F.col("embedding")).alias("v"))

    def coded() -> DataFrame:
        out, books = codes.compress(vectors)
        return codes.with_label_errors(out).withColumn("codebooks_sha256", F.lit(codes.digest(books)))

    return settled(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return settled(lambda: nndescent.nearest_rows(vectors, F.col("vec_id") % 100 == 0))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_near_duplicates": op2_near_duplicates,
    "op10_language": op10_language,
    "op4_media": op4_media,
    "op5_pieces": op5_pieces,
    "op6_main_text": op6_main_text,
    "op3_shards": op3_shards,
    "op7_mix": op7_mix,
    "op8_licenses": op8_licenses,
    "op9_personal_data": op9_personal_data,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_codes": op12_codes,
    "op13_neighbours": op13_neighbours,
}
