import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanline.llm import sketch
from gleanline.llm.forest import HashForest, already_accepted, search_depth
from gleanline.llm.lookalike import canonical_form, canonical_forms, look_alike_pairs, look_form, look_forms, normalise_text
from gleanline.llm.common import row_pairs
from gleanline.llm.neardup import band_rows, block_pairs, bucket_pairs, near_duplicates, pairs

WORDS = [f"w{i}" for i in range(400)]


def near_copies(seed, families=25, size=40):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = rng.sample(WORDS, size)
        for k in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(size)] = rng.choice(WORDS)
            rng.shuffle(words)
            rows.append(("t", f"{f:03}-{k}", " ".join(words)))
    return rows


def jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b)


def test_sketch_estimates_similarity_and_fills_every_bin():
    rng = np.random.default_rng(1)
    a = rng.choice(10**6, 300, replace=False)
    b = np.concatenate([a[:200], rng.choice(10**6, 100, replace=False) + 10**7])
    tiny = np.array([5])
    values = np.concatenate([a, b, tiny]).astype(np.uint32)
    s = sketch.fast_similarity_sketch(values, np.array([0, 300, 600, 601]), 512)
    assert (s != sketch.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - len(set(a) & set(b)) / len(set(a) | set(b))) < 0.08


def test_near_duplicates_agree_with_brute_force(spark):
    rows = near_copies(2)
    rows += [("t", "copy", rows[0][2].upper()), ("t", "copy", rows[0][2].upper()), ("u", "other", rows[0][2]), ("t", "null", None), ("t", "short", "w1 w2"), ("t", "empty", "")]
    df = spark.createDataFrame(rows, "tbl string, id string, text string")
    got = {tuple(r) for r in pairs(*near_duplicates(df, threshold=0.6, min_words=24, shingle=1)).collect()}
    once = sorted({r for r in rows if r[2] and len(set(r[2].split())) >= 24}, key=lambda r: r[1])
    want = {(x[0], x[1], y[1]) for x in once for y in once if x[0] == y[0] and x[1] < y[1] and jaccard(x[2], y[2]) >= 0.6}
    assert got <= want and len(got) >= 0.98 * len(want)
    assert ("t", "000-0", "copy") in got


def test_near_duplicates_by_shingles_and_of_nothing(spark):
    base = " ".join(WORDS[:200])
    rows = [("t", "a", base), ("t", "b", base + " extra"), ("t", "c", " ".join(reversed(WORDS[:200])))]
    df = spark.createDataFrame(rows, "tbl string, id string, text string")
    assert {tuple(r) for r in pairs(*near_duplicates(df)).collect()} == {("t", "a", "b")}
    members, links = near_duplicates(df.limit(0))
    assert members.count() == 0 and links.count() == 0


def template_members(prefix, n, members):
    """``n`` texts of 48 words, of which the first ``members`` share 40."""
    own = lambda i, k: " ".join(f"{prefix}{i}x{j}" for j in range(k))
    form = " ".join(f"form{j}" for j in range(40))
    return [(f"{prefix}{i}", f"{form} {own(i, 8)}" if i < members else own(i, 48)) for i in range(n)]


def close_pairs(n):
    """Pairs of texts of a similarity between 0.60 and 0.65, half of whose shared words half of all texts have."""
    rng, rows = random.Random(8), []
    for k in range(n):
        shared = [f"common{(k + j) % 40}" for j in range(18)] + [f"p{k}s{j}" for j in range(18)]
        own = rng.choice([10, 11, 12])
        rows += [(f"{k}a", " ".join(shared + [f"p{k}a{j}" for j in range(own)])), (f"{k}b", " ".join(shared + [f"p{k}b{j}" for j in range(22 - own)]))]
    return rows


def test_recall_near_the_threshold_and_at_any_partitioning(spark):
    df = spark.createDataFrame(close_pairs(1500), "id string, text string").withColumn("tbl", F.lit("t"))
    found = [{tuple(r) for r in pairs(*near_duplicates(df.repartition(n), threshold=0.6, min_words=24, shingle=1)).collect()} for n in (3, 30)]
    wanted = {("t", f"{k}a", f"{k}b") for k in range(1500)}
    assert found[0] == found[1] and len(found[0] & wanted) >= 0.95 * 1500


def test_blocks_of_large_buckets_give_the_same_pairs(spark):
    df = spark.createDataFrame(template_members("a", 300, 200), "id string, text string").withColumn("tbl", F.lit("t"))
    sets = sketch.word_sets(df, 24, 1).filter("words is not null")
    bands = band_rows(sets, 66, 6)
    whole, cut_up = bucket_pairs(bands, 0.6), bucket_pairs(bands, 0.6, 7)
    pair = lambda x: {tuple(r) for r in x.filter("left is null").select("a", "b").union(block_pairs(x.filter("left is not null"))).distinct().collect()}
    assert whole.filter("left is not null").count() == 0 and cut_up.filter("left is not null").count() > 0
    # blocks aren't screened by the one-bit coordinates
    assert pair(whole) <= pair(cut_up) and len(pair(whole)) > 15_000


def test_unrelated_sets_that_meet_over_common_words_are_not_stored(spark):
    common = [f"form{j}" for j in range(24)]
    rows = [(f"{i}", " ".join(common + [f"x{i}y{j}" for j in range(36)])) for i in range(1000)]  # of a similarity of 24 / 96
    rows += [(f"{i}+", " ".join(common + [f"x{i}y{j}" for j in range(33)] + ["a", "b", "c"])) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("tbl", F.lit("t"))
    sets = sketch.word_sets(df, 24, 1).filter("words is not null")
    doc = {r["id"]: r["doc"] for r in sets.collect()}
    bands = band_rows(sets, 66, 6)
    candidates = lambda size: bucket_pairs(bands, 0.6, size)
    found = {tuple(r) for r in candidates(1000).filter("left is null").select("a", "b").collect()}
    wanted = {tuple(sorted((doc[f"{i}"], doc[f"{i}+"]))) for i in range(50)}
    assert wanted <= found and len(found) < 60  # some 8,000 pairs share a bucket
    cut_up = candidates(2)
    large = cut_up.filter("left is not null")
    assert {tuple(r) for r in cut_up.filter("left is null").select("a", "b").union(block_pairs(large, 0.6)).collect()} == found
    assert large.count() > 100


def test_rows_of_large_classes_are_paired_in_blocks(spark):
    members = spark.createDataFrame([("t", 1, f"a{i:02}") for i in range(23)] + [("t", 2, f"b{i}") for i in range(3)] + [("u", 3, "c")], "tbl string, doc long, id string")
    links = spark.createDataFrame([(1, 2)], "a long, b long")
    plain, blocks = ([tuple(r) for r in row_pairs(members, links, ["tbl"], large=n).collect()] for n in (100, 4))
    assert sorted(plain) == sorted(blocks) and len(plain) == len(set(plain)) == 23 * 22 // 2 + 3 + 23 * 3
    assert row_pairs(members, links, ["tbl"], alike=False, large=4).count() == 69


def test_a_template_that_fills_a_third_of_the_sets(spark):
    df = spark.createDataFrame(template_members("a", 5100, 1700), "id string, text string").withColumn("tbl", F.lit("t"))
    _, links = near_duplicates(df, threshold=0.6, min_words=24, shingle=1)
    assert links.count() >= 0.99 * 1700 * 1699 / 2  # each two members have a similarity of 40 / 56


def test_a_template_that_fills_a_third_of_the_history(spark):
    history = spark.createDataFrame([(f"h{k}", t) for k, t in template_members("a", 3300, 1100)], "id string, text string").withColumn("item", F.lit(None).cast("string"))
    # each pending text is near one member only, of which it has the 8 own words and 32 of the form's
    new = [(f"q{i}", " ".join([f"form{(i + j) % 40}" for j in range(32)] + [f"a{i}x{j}" for j in range(8)] + [f"q{i}x{j}" for j in range(12)])) for i in range(200)]
    batches = spark.createDataFrame(new, "id string, text string").select("id", F.lit(None).cast("string").alias("item"), "text", F.to_date(F.lit("2026-01-01")).alias("batch"))
    assert already_accepted(history, batches, threshold=0.6, min_words=24, shingle=1).count() >= 0.95 * 200


def test_parities_drop_no_similar_pair(spark):
    rows = near_copies(4)
    df = spark.createDataFrame(rows, "tbl string, id string, text string")
    cells = sketch.word_sets(df, 1).filter("words is not null").dropDuplicates(["doc"])
    words = {r["doc"]: set(r["words"]) for r in cells.collect()}
    every = spark.createDataFrame([(a, b) for a in words for b in words if a < b], "a long, b long")
    kept = {tuple(r) for r in sketch.can_be_similar(every, "a", "b", cells, cells, 0.6).collect()}
    close = {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 0.6 * len(words[a] | words[b])}
    assert close <= kept and close and len(kept) < 0.2 * every.count()


def test_search_depth_widens_until_the_recall_is_reached():
    assert search_depth(0.95, 0.95) == 8 and search_depth(0.6, 0.95) == 5 and search_depth(0.6, 0.999) < 5
    with pytest.raises(ValueError):
        search_depth(0.1, 0.9999, trees=2)


def test_batches_against_history_agree_with_brute_force(spark):
    rows = near_copies(5, families=40)
    rng = random.Random(6)
    history = [(r[1], f"i{r[1]}", r[2]) for r in rows[::2]] + [("h-null", None, None)]
    new = [(f"q{r[1]}", rng.choice([None, f"i{r[1]}", "i000-0"]), r[2], f"2026-01-0{rng.randint(1, 4)}") for r in rows] + [("q-null", None, None, "2026-01-01"), ("q-short", "i000-0", "hi", "2026-01-01")]
    h = spark.createDataFrame(history, "id string, item string, text string").withColumn("doc", F.lit(1))
    b = spark.createDataFrame(new, "id string, item string, text string, day string").select("id", "item", "text", F.to_date("day").alias("batch"))
    got = {r["id"] for r in already_accepted(h, b, threshold=0.6, min_words=24, shingle=1).collect()}

    def repeats(q):
        before = [(i, t) for _, i, t in history] + [(i, t) for _, i, t, day in new if day < q[3]]
        long = lambda t: t is not None and len(set(t.split())) >= 24
        return any((q[1] is not None and q[1] == i) or (long(q[2]) and long(t) and jaccard(q[2], t) >= 0.6) for i, t in before)

    want = {q[0] for q in new if repeats(q)}
    assert got <= want and len(got) >= 0.98 * len(want) and "q-short" in got
    assert already_accepted(h.limit(0), b.limit(0)).count() == 0


LOOKS = [("Ｈｅｌｌｏ　you", "Hello you"), ("pаypаl", "paypal"), ("café", "café"), ("op​ti­on", "option"), ("a b c", "a b c"), ("ﬁne ⅽⅾ", "fine cd"), (" x ", "x"), ("a\r\nb", "a\nb"), ("ΟΚ", "OK")]


@pytest.mark.parametrize("odd,plain", LOOKS)
def test_look_alikes_share_a_form(odd, plain):
    assert look_form(odd) == look_form(plain) and canonical_form(odd) == canonical_form(plain) == canonical_form(canonical_form(odd))


@pytest.mark.parametrize("text,form", [("a\u0600b", "a\u0600b"), ("x\u06ddy", "x\u06ddy"), ("a\u2065b\U000e0041\u061cc\ufff3", "abc"), ("\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U0001f3f4\U000e0067\U000e0062\U000e007f"), ("\u0251nd \u0261o", "and go"), ("\u0131", "\u0131"), ("\x00a", "\x00a")])
def test_visible_characters_stay_and_ignorable_ones_go(text, form):
    assert look_form(text) == form and look_forms([text, "x", text]) == [form, "x", form]


def test_buffers_agree_with_single_texts():
    texts = ["", "Ｈｅｌｌｏ", "e", "\u0301x", "ß", "pаypаl", "a\r\nb", "\x00", "İ", "ΟΣ", "ﬁ", "🤷\u200d♀"]
    for part in (texts, [t for t in texts if "\x00" not in t]):
        assert look_forms(part) == [look_form(t) for t in part] and canonical_forms(part) == [canonical_form(t) for t in part]


@pytest.mark.parametrize("a,b", [("cafe", "café"), ("Hello", "hello"), ("x²", "x2"), ("🤷‍♀", "🤷♀"), ("a\nb", "a b"), ("ñ", "n")])
def test_visible_differences_stay(a, b):
    assert look_form(a) != look_form(b)


def test_look_alike_pairs(spark):
    rows = [("1", "pay", "x"), ("2", "pаy", None), ("2", "pаy", None), ("3", "PAY", "x"), ("4", "pay", "х"), ("5", None, ""), ("6", "p​ay", " x")]
    df = spark.createDataFrame(rows, "id string, body string, field string")
    got = {tuple(r) for r in look_alike_pairs(df, "id", ["body", "field"]).collect()}
    assert got == {("body", "1", "2"), ("body", "1", "6"), ("body", "2", "4"), ("body", "2", "6"), ("body", "4", "6"), ("field", "1", "4"), ("field", "3", "4"), ("field", "1", "6"), ("field", "3", "6"), ("field", "4", "6")}
    assert look_alike_pairs(df.limit(0), "id", ["body"]).count() == 0


def test_normal_form_column(spark):
    df = spark.createDataFrame([(1, "Straße"), (2, None), (3, "  "), (4, "ABC\tx"), (5, "ä" * 100_000)], "id int, t string")
    got = {r["id"]: r["n"] for r in normalise_text(df, "t", "n").collect()}
    assert got[1] == "strasse" and got[2] is None and got[3] == "" and got[4] == "abc x" and len(got[5]) == 100_000


def test_a_forest_grows_batch_by_batch_and_opens_again(spark, tmp_path):
    rows = near_copies(9, families=12)
    df = spark.createDataFrame(rows, "tbl string, id string, text string")
    sets = sketch.word_sets(df, 24, apart=False).filter("words is not null")
    sets = spark.createDataFrame(sets.collect(), sets.schema).dropDuplicates(["doc"])
    hits = {}
    for day in range(3):
        forest = HashForest(spark, str(tmp_path / "forest"))
        assert len(forest.runs) == (0, 1, 1)[day]
        mine = sets.filter(F.pmod("doc", F.lit(3)) == day).withColumn("first", F.lit(day).cast("long"))
        run = forest.accept(mine)
        hits |= {r["doc"]: r["near"] for r in forest.similar(run, 0.6, 0.95).collect()}
        if day == 1:
            assert forest.merge_runs() == forest.runs[0] and len(forest.runs) == 1
    known = {r["doc"]: (r["doc"] % 3, set(r["words"])) for r in sets.collect()}
    close = lambda a, b: len(a & b) / len(a | b) >= 0.6
    want = {d: days for d, (day, w) in known.items() if (days := {o for o, v in known.values() if o < day and close(w, v)})}
    assert hits.keys() <= want.keys() and all(hits[d] in want[d] for d in hits) and len(hits) >= 0.95 * len(want) > 0


def test_a_kept_forest_signs_new_batches_only(spark, tmp_path):
    rows = near_copies(5, families=30)
    history = spark.createDataFrame([(r[1], f"i{r[1]}", r[2]) for r in rows[::2]], "id string, item string, text string")
    days = [spark.createDataFrame([(f"q{r[1]}", None, r[2], f"2026-01-0{d + 1}") for r in rows[d::3]], "id string, item string, text string, day string").select("id", "item", "text", F.to_date("day").alias("batch")) for d in range(3)]
    together = {r["id"] for r in already_accepted(history, days[0].union(days[1]).union(days[2]), 0.6, 24, 1).collect()}
    path, one_by_one = str(tmp_path / "kept"), set()
    for d, day in enumerate(days):
        one_by_one |= {r["id"] for r in already_accepted(history if d == 0 else None, day, 0.6, 24, 1, path=path).collect()}
    assert one_by_one == together and len(HashForest(spark, f"{path}/runs").runs) == 4
