"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .abuse import content_scores, fit, rates
from .capping import over_cap
from .common import account_key, community_key, item_key
from .forest import already_accepted
from .lookalike import look_alike_pairs, normalise_text
from .neardup import near_duplicates, pairs
from .oracles import ORACLES
from .packing import fill_containers
from .pii import personal_information
from .quality import text_quality
from .tokenizer import encode
from .topn import top_n_per_group

__all__ = ["ORACLES", "QUERIES"]

LEAD_ORDER = [("ai_score", "desc"), ("item_created_at", "desc")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "reddit_leads")
    top = top_n_per_group(leads, ["project_id"], LEAD_ORDER, "id", 3)
    return top.select("project_id", F.col("id").alias("lead_id"))


def accounts_in_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "reddit_leads")
    return leads.select("id", "ai_score", "item_created_at", community_key(F.col("subreddit")).alias("community"), account_key(F.col("author")).alias("account"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = over_cap(accounts_in_communities(spark, sf_dir), ["community"], "account", LEAD_ORDER, "id", max_count=5)
    return gone.select(F.col("id").alias("lead_id"))


def p2_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads that go if no account may hold more than a fifth of what is left of its community."""
    gone = over_cap(accounts_in_communities(spark, sf_dir), ["community"], "account", LEAD_ORDER, "id", max_share=0.2)
    return gone.select("community", "account", F.col("id").alias("lead_id"))


def texts_of_queue_and_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (tbl, id, text): title and body of queue rows, content of leads."""
    queue = table(spark, sf_dir, "gemini_qualification_queue").select(F.lit("gemini_qualification_queue").alias("tbl"), "id", F.concat_ws("\n", "title", "body").alias("text"))
    leads = table(spark, sf_dir, "reddit_leads").select(F.lit("reddit_leads").alias("tbl"), "id", F.col("content").alias("text"))
    return queue.unionByName(leads)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_duplicates(texts_of_queue_and_leads(spark, sf_dir), threshold=0.6, min_words=24, shingle=1)
    return pairs(members, links)


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that has a class, with its class and the number of links of the class to other texts."""
    members, links = near_duplicates(texts_of_queue_and_leads(spark, sf_dir), threshold=0.6, min_words=24, shingle=1)
    degree = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("links"))
    return members.join(degree, "doc", "left").select("tbl", "id", F.col("doc").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "gemini_qualification_queue").select("id", "body", "matched_text")
    return look_alike_pairs(queue, "id", ["body", "matched_text"])


def p4_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of every queue body."""
    queue = table(spark, sf_dir, "gemini_qualification_queue").select("id", "body")
    return normalise_text(queue, "body", "normal_body").select("id", "normal_body").distinct()


def personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as delivered with placeholders for personal information, and the kinds found in it."""
    queue = table(spark, sf_dir, "gemini_qualification_queue").select(F.lit("gemini_qualification_queue").alias("tbl"), F.col("id").alias("row_id"), F.lit("body").alias("field"), F.col("body").alias("text"))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("content", "ai_lead_summary")])).alias("f")
    leads = table(spark, sf_dir, "reddit_leads").select(F.lit("reddit_leads").alias("tbl"), F.col("id").alias("row_id"), fields).select("tbl", "row_id", "f.field", "f.text")
    return personal_information(queue.unionByName(leads), ["tbl", "row_id", "field"])


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text once, with placeholders for personal information, and the kinds found in it."""
    return personal_texts(spark, sf_dir).dropDuplicates(["tbl", "row_id", "field"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_texts(spark, sf_dir).select("tbl", "row_id", "field", F.explode("kinds").alias("kind")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = item_key(F.col("item_type"), F.col("reddit_item_id")).alias("item")
    history = table(spark, sf_dir, "reddit_leads").select("id", item, F.col("content").alias("text"))
    pending = table(spark, sf_dir, "gemini_qualification_queue").filter(F.col("status") == "pending")
    batches = pending.select("id", item, F.col("body").alias("text"), F.to_date("created_at").alias("batch"))
    return already_accepted(history, batches, threshold=0.6, min_words=24, shingle=1).select(F.col("id").alias("queue_id"))


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every queue body and lead content, one row per table and id: of copies that differ the one that scores highest."""
    queue = table(spark, sf_dir, "gemini_qualification_queue").select(F.lit("gemini_qualification_queue").alias("tbl"), F.col("id").alias("row_id"), community_key(F.col("subreddit")).alias("community"), F.col("body").alias("text"))
    leads = table(spark, sf_dir, "reddit_leads").select(F.lit("reddit_leads").alias("tbl"), F.col("id").alias("row_id"), community_key(F.col("subreddit")).alias("community"), F.col("content").alias("text"))
    scores = content_scores(queue.unionByName(leads), fit(table(spark, sf_dir, "content_labels")), ["tbl", "row_id", "community"])
    kept = ["score", "abusive", "hateful", "sexual", "community"]
    return scores.groupBy("tbl", "row_id").agg(F.max(F.struct(*kept)).alias("s")).select("tbl", "row_id", *[f"s.{c}" for c in kept])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_scores(spark, sf_dir).filter(F.col("score") >= 0.5).select("tbl", "row_id")


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(p7_scores(spark, sf_dir), "community")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "text", ["doc_id"])


CONTEXT = 2048


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2,048 tokens of every document."""
    sizes = encode(table(spark, sf_dir, "documents"), "text", ["doc_id"], ids_col="n_tokens", count_only=True)
    return fill_containers(sizes, "doc_id", "n_tokens", CONTEXT)


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_statistics(spark, sf_dir).filter(F.col("label").isin("list", "table", "junk")).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_share": p2_share,
    "p3_found": p3_found,
    "p3_links": p3_links,
    "p4_found": p4_found,
    "p4_normal_form": p4_normal_form,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_rates": p7_rates,
    "p7_scores": p7_scores,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}
