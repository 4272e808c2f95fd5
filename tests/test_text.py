import itertools
import random

import pytest
from pyspark.sql import functions as F

from gleanline.functions import display, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_stems_and_lemmas():
    stems = {"notifications": "notif", "running": "run", "caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "falling": "fall", "happy": "happi", "sky": "sky", "agreed": "agre", "generalizations": "gener", "oscillators": "oscil"}
    assert {w: text.porter_stem(w) for w in stems} == stems
    lemmas = {"went": "go", "better": "good", "boxes": "box", "companies": "company", "stopped": "stop", "tool": "tool"}
    assert {w: text.lemma(w) for w in lemmas} == lemmas


def test_normal_form(spark):
    rows = [(1, "  ＡＢ c\t\nD "), (2, None), (3, ""), (4, "Café﻿ x")]
    df = text.with_normalized(spark.createDataFrame(rows, "id int, t string"), "t", "n")
    assert {r["id"]: r["n"] for r in df.collect()} == {1: "ab c d", 2: "", 3: "", 4: "café x"}


def test_one_edit_agrees_with_brute_force(spark):
    def osa(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(1)
    pairs = [("".join(rng.choices("abc", k=rng.randint(1, 6))), "".join(rng.choices("abc", k=rng.randint(1, 6)))) for _ in range(1500)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.within_one_edit(F.col("a"), F.col("b")).alias("near"))
    wrong = [r for r in df.collect() if r["near"] != (osa(r["a"], r["b"]) <= 1)]
    assert not wrong


def test_display(spark):
    assert one(spark, display.score_text(F.col("s")), s=8) == "8.0"
    assert one(spark, display.score_text(F.col("s")), s=10) == "🌟 10.0"
    assert one(spark, display.community_text(F.col("s")), s=" SaaS ") == "r/SaaS"
    assert one(spark, display.community_text(F.col("s")), s="r/SaaS") == "r/SaaS"
    assert one(spark, display.community_text(F.col("s")), s="  ") == ""
    assert one(spark, display.list_text(F.array().cast("array<string>")), s="") == "(none provided)"


@pytest.mark.parametrize(
    "raw,url,name",
    [("My-Site.example", "https://my-site.example/", "My Site"), ("http://www.foo_bar.example:80/a?b#c", "http://www.foo_bar.example/a?b#c", "Foo Bar"), ("localhost", None, None), ("  ", None, None)],
)
def test_urls(spark, raw, url, name):
    made = display.normal_url(F.col("u"))
    assert one(spark, made, u=raw) == url
    assert one(spark, display.name_from_url(made), u=raw) == name
