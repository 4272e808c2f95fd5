import random

from pyspark.sql import functions as F

from gleanline.llm.capping import capped, over_cap, water_levels
from gleanline.llm.common import account_key, community_key, item_key
from gleanline.llm.topn import top_n_per_group

SCHEMA = "g string, id string, score int, at int, rank string, Rank_ string"
ORDER = [("score", "desc"), ("at", "desc")]


def rows_of(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        rows.append((g, f"i{i:04}", rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), "x", "y"))
    return rows + rows[:50]


def best(rows, n):
    groups = {}
    for g, i, s, a, *_ in set(rows):
        groups.setdefault(g, []).append(((s is None, -(s or 0)), (a is None, -(a or 0)), i))
    return {(g, r[2], k + 1) for g, rs in groups.items() for k, r in enumerate(sorted(rs)) if k < n}


def test_top_n_agrees_with_brute_force_on_hot_and_cold_groups(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA)
    for heavy in (10_000, 60, 1):
        got = {tuple(r) for r in top_n_per_group(df, ["g"], ORDER, "id", 7, heavy_rows=heavy).collect()}
        assert got == best(rows, 7)


def test_copies_that_differ_count_as_one_of_them(spark):
    df = spark.createDataFrame([("g", "a", 5, 1), ("g", "a", 4, 9), ("g", "b", 5, 2)], "g string, id string, score int, at int")
    assert [tuple(r) for r in top_n_per_group(df, ["g"], ORDER, "id", 2).orderBy("rank").collect()] == [("g", "b", 1), ("g", "a", 2)]


def test_top_n_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_n_per_group(empty, ["g"], ORDER, "id", 3).count() == 0
    assert top_n_per_group(spark.createDataFrame(rows_of(2, 20), SCHEMA), ["g"], ORDER, "id", 0).count() == 0


def brute_level(counts, share, most, least):
    capped_counts = [min(c, most) if most else c for c in counts]
    fine = [level for level in range(1, max(capped_counts) + 1) if level <= share * sum(min(c, level) for c in capped_counts) + 1e-9]
    top = max(fine, default=0)
    return max(top, least)


def test_water_levels_agree_with_brute_force(spark):
    rng = random.Random(3)
    scopes = {f"s{k}": [rng.choice([1, 1, 2, 3, 5, 8, 40]) for _ in range(rng.randint(1, 12))] for k in range(60)}
    counts = spark.createDataFrame([(s, c) for s, cs in scopes.items() for c in cs], "scope string, n long")
    for share, most in ((1.0, None), (0.5, None), (0.25, 6), (0.1, None), (0.34, 3)):
        got = {r["scope"]: r["level"] for r in water_levels(counts, ["scope"], share, most).collect()}
        for s, cs in scopes.items():
            level = brute_level(cs, share, most, 1)
            assert all(min(c, got[s]) == min(c, level) if most is None else min(c, most, got[s]) == min(c, most, level) for c in cs), (s, cs, share, most, got[s], level)


def test_over_cap_keeps_the_best(spark):
    rows = [("c", "x", f"{i}", i % 3, None) for i in range(30)] + [("c", None, "n1", 1, 1), ("c", None, "n2", 1, 1), (None, "x", "z", None, None)]
    df = spark.createDataFrame(rows + rows[:5], "scope string, who string, id string, score int, at int").withColumn("n", F.lit(1)).withColumn("level", F.lit(2))
    for heavy in (100, 3):
        gone = {r["id"] for r in over_cap(df, ["scope"], "who", ORDER, "id", max_count=4, heavy_rows=heavy).collect()}
        kept = sorted((r for r in rows if r[1] == "x" and r[0] == "c"), key=lambda r: (-r[3], r[2]))[:4]
        assert gone == {r[2] for r in rows if r[0] == "c" and r[1] == "x"} - {r[2] for r in kept}
    left = capped(df, ["scope"], "who", ORDER, "id", max_count=4)
    assert left.count() == len([r for r in rows + rows[:5] if r[2] not in gone]) and set(left.columns) == set(df.columns)
    assert over_cap(df.limit(0), ["scope"], "who", ORDER, "id", max_count=4, max_share=0.5).count() == 0


def test_columns_named_like_inner_ones(spark):
    rows = [("c", "x", str(i), i % 3, 1) for i in range(9)] + [("c", "y", "z", 1, 1)]
    df = spark.createDataFrame(rows, "n string, level string, c string, m int, kept int")
    assert over_cap(df, ["n"], "level", [("m", "desc"), ("kept", "asc")], "c", max_count=2, heavy_rows=3).count() == 7
    assert capped(df, ["n"], "level", [("m", "desc")], "c", max_share=0.5).count() == 2
    assert top_n_per_group(df, ["n"], [("m", "desc")], "c", 3, heavy_rows=2, rank_col="place").columns == ["n", "c", "place"]


def test_keys(spark):
    rows = [(" /u/Bob ", "r/SaaS", "post", "T3_AbC "), ("BOB", " saas", "post", "https://forum.example/comments/abc/"), ("[deleted]", "", "post", "abc"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, s string, t string, i string")
    got = df.select(account_key(F.col("a")), community_key(F.col("s")), item_key(F.col("t"), F.col("i"))).collect()
    assert [tuple(r) for r in got] == [("bob", "saas", "post:abc"), ("bob", "saas", "post:abc"), (None, None, "post:abc"), (None, None, None)]
