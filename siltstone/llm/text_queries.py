"""Queries of problems 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import leaks, mojibake, packing
from siltstone.sources.tables import table
from siltstone.storage import stage

TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer's file lies on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document and its container of 2048 tokens."""
    sizes = packing.measure(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path())
    return packing.containers(sizes)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces and tokens of each container, and the space left over."""
    used = p8_containers(spark, sf).where("container is not null").groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("used"))
    return used.withColumn("unused", packing.CAPACITY - F.col("used"))


def p8_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the containers keep their promises: documents, those without tokens, containers over capacity, documents
    whose pieces don't make up their tokens, documents divided without need, and whether the containers are as few as
    their tokens allow, but for one in a hundred and two more."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    sizes = packing.measure(docs, tokenizer_path())
    pieces = stage(packing.containers(sizes), "pieces")
    by_doc = pieces.groupBy("doc_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"), F.max("piece").alias("last")).join(sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens")), "doc_id", "full")
    torn = (~F.col("used").eqNullSafe(F.col("n_tokens"))) | (F.col("last") + 1 != F.col("n"))
    need = F.greatest(F.ceil(F.col("n_tokens") / packing.CAPACITY), F.lit(1))
    documents = by_doc.agg(F.count("*").alias("n_documents"), F.count_if(F.col("n_tokens") == 0).alias("n_without_tokens"), F.count_if(torn).alias("n_torn"), F.count_if(F.col("n") != need).alias("n_split_without_need"))
    used = pieces.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    full = used.agg(F.count_if(F.col("used") > packing.CAPACITY).alias("n_over"), (F.count("*") * packing.CAPACITY <= F.coalesce(F.sum("used"), F.lit(0)) * 1.01 + 2 * packing.CAPACITY).alias("tight"))
    both = documents.unionByName(full, allowMissingColumns=True)  # a row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a passage of an item, whole, in part or edited.

    Either 12 consecutive words, or an alignment worth 12 matches and half of the whole item.
    """
    pairs = leaks.find_leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_item").select("item_id", "text"), edited=True)
    return pairs.where(f"(share >= 0.5 and score >= {leaks.MATCH * leaks.WINDOW}) or run >= {leaks.WINDOW}")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = leaks.find_leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_item").select("item_id", "text"))
    # The score of the alignment first: one of 12 matches or more; then the exact check, that 12 of them are consecutive.
    return pairs.where(f"score >= {leaks.MATCH * leaks.WINDOW} and run >= {leaks.WINDOW}").select("doc_id", "item_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Every garbled document with its text restored as far as it can be; ``lost`` tells that some is gone."""
    return mojibake.find_garbled(table(spark, sf, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_restored(spark, sf).select("doc_id").distinct()


QUERIES = {
    "p10_found": p10_found, "p10_restored": p10_restored,
   "p8_checked": p8_checked, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_leaks": p9_leaks,
}
_GRAMS = "SELECT {id}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM (SELECT {id}, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) AS w FROM {table}) AS x"
ORACLES: dict[str, str] = {
    "p8_checked": """
SELECT count(*) AS n_documents, CAST(count_if(text IS NULL OR text = '') AS BIGINT) AS n_without_tokens, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_torn, CAST(0 AS BIGINT) AS n_split_without_need, true AS tight
FROM documents""",
    "p9_found": f"WITH d AS ({_GRAMS.format(id='doc_id', table='documents')}), i AS ({_GRAMS.format(id='item_id', table='eval_item')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i ON d.g = i.g",
}
