import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import TABLES, compare  # noqa: E402

from gleanline.llm.queries import CONTEXT, ORACLES, QUERIES, table  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")


def test_queries_agree_with_sql(spark):
    assert compare(spark, QUERIES, ORACLES) == {}


def ids(spark, name):
    return table(spark, TABLES, name).select("id").distinct().count()


def rows_of(spark, name):
    return QUERIES[name](spark, TABLES)


def test_links_have_a_class_each_way(spark):
    rows, pairs = rows_of(spark, "p3_links"), rows_of(spark, "p3_found")
    assert rows.count() == rows.select("tbl", "id").distinct().count() > 0
    linked = pairs.select("tbl", F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    copies = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    assert rows.join(copies, "class_id").filter("links > 0 or n > 1").select("tbl", "id").exceptAll(linked).count() == 0


def test_every_body_has_one_normal_form(spark):
    rows = rows_of(spark, "p4_normal_form")
    assert rows.count() == ids(spark, "gemini_qualification_queue")
    assert rows.filter(F.lower("normal_body") != F.col("normal_body")).count() == 0


def test_texts_are_redacted_once(spark):
    rows = rows_of(spark, "p5_redacted")
    assert rows.count() == ids(spark, "gemini_qualification_queue") + 2 * ids(spark, "reddit_leads")
    marked = rows.filter(F.size("kinds") > 0)
    assert marked.count() > 0 and marked.filter(~F.col("redacted").rlike(r"\[(EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)\]")).count() == 0
    assert rows_of(spark, "p5_found").count() == rows.select(F.explode("kinds")).count()


def test_scores_and_rates_agree(spark):
    scores, rates = rows_of(spark, "p7_scores"), rows_of(spark, "p7_rates")
    assert scores.count() == ids(spark, "gemini_qualification_queue") + ids(spark, "reddit_leads")
    assert scores.filter("score < 0 or score > 1 or abs(abusive + hateful + sexual - score) > 1e-6").count() == 0
    assert rates.agg(F.sum("flagged")).first()[0] == rows_of(spark, "p7_found").count() > 0


def test_every_document_is_encoded_packed_and_judged(spark):
    documents = table(spark, TABLES, "documents").count()
    encoded = rows_of(spark, "p8_ids")
    assert encoded.count() == documents and encoded.filter("ids is null").count() == 0
    packed = rows_of(spark, "p9_containers")
    assert packed.select("doc_id").distinct().count() == documents
    loads = packed.groupBy("container").agg(F.sum("size").alias("load"))
    assert loads.filter(F.col("load") > CONTEXT).count() == 0
    # all tokens are packed, in hardly more containers than their sum needs
    tokens = encoded.agg(F.sum(F.size("ids"))).first()[0]
    assert loads.agg(F.sum("load")).first()[0] == tokens and loads.count() <= -(-tokens // CONTEXT) * 1.02 + 1
    judged = rows_of(spark, "p10_statistics")
    assert judged.count() == documents and judged.filter(~F.col("label").isin("prose", "list", "table", "junk", "none")).count() == 0
    assert rows_of(spark, "p10_found").count() == judged.filter(F.col("label").isin("list", "table", "junk")).count() > 0
