"""The registered queries of these operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, dialogue, idstore, jaccard, language, neighbours, packing, secrets, sharding, sketches, suffixes, transducer, webpages
from .staging import new_path, numbered, staged


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; Python workers find this package where the driver does unless they have a path of their own."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the store, and read ids and boundaries back from it."""
    path = new_path(spark, "token-store")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    idstore.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return idstore.stored_digest(idstore.open_store(spark, path))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sketches.with_edited(table(spark, sf_dir, "documents").select("doc_id", "text"), ranges)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that earlier text already holds in a match of 100, removed from all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def slim(rows: DataFrame) -> DataFrame:
        calm = F.col("__firsts").isNull()
        return rows.withColumns({"kept_sha256": F.when(calm, F.sha2("text", 256)), "text": F.when(~calm, F.col("text"))})

    marked = suffixes.mark_repeats(docs, slim)
    kept = suffixes.kept_bytes(F.col("text"), F.col("__spans"))
    removed = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return marked.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("__spans").cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.sha2(kept, 256)).alias("kept_sha256"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All base spans and the linked weak spans of every document."""
    scanned = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = secrets.BASE_KINDS + secrets.WEAK_KINDS

    def count(kind: int):
        return F.size(F.filter("base_spans", lambda x: x["k"] == kind)).cast("long")

    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.rendered(F.col("base_spans"), kinds), 256).alias("base_sha256"),
        secrets.rendered(F.col("spans"), kinds).alias("spans"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are alike by 0.75 or more."""
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = docs.select("__doc", "doc_id")
    labels = jaccard.near_duplicates(docs).join(names, "__doc")
    first = names.select(F.col("__doc").alias("__label"), F.col("doc_id").alias("component_id"))
    return labels.join(first, "__label").select("doc_id", "n_shingles", "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.trained_on(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.piece_digest(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096))


def op9_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """Shards of near equal bytes: a map that deals slots out before anything is known of them, and its next version, edited for the measured bytes."""
    rows = sharding.records(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sizes = sharding.slot_sizes(rows)
    path = new_path(spark, "slot-map")
    first = sharding.first_map({}, shards)
    sharding.write_map(spark, path, 1, first)
    sharding.write_map(spark, path, 2, sharding.rebalanced(first, sizes, shards))
    placed = sharding.placed(rows, sharding.read_map(spark, path))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, and the texts decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = transducer.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return transducer.piece_digest(transducer.decode_pieces(encoded, model))


def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-byte codes of all usable vectors, by codebooks that four rounds with resident members train."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = codebooks.compressed(vectors)
    rows = codebooks.with_label_errors(staged(coded, "codes"))
    return rows.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks.books_digest(books)).alias("codebooks_sha256")
    )


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after its rows are damaged."""
    rows, there = dialogue.damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return dialogue.repair_conversations(rows, there)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = webpages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_fingerprints,
        op3_suffixes,
        op4_secrets,
        op5_near_duplicates,
        op6_language,
        op7_neighbours,
        op8_packing,
        op9_sharding,
        op10_pieces,
        op11_codebooks,
        op12_dialogue_repair,
        op13_main_text,
    )
}
ORACLES: dict[str, str] = {"op4_secrets": secrets.oracle_sql()}
