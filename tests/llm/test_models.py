import os

import pytest
from pyspark.sql import functions as F

from gleanline.llm import abuse, pii
from gleanline.llm.packing import fill_containers
from gleanline.llm.pii_training import training_sentences
from gleanline.llm.quality import text_quality
from gleanline.llm.tokenizer import TOKENIZERS, encode, encoder


@pytest.fixture(scope="module")
def model():
    return pii.trained()


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("My inbox is priya.quist@mail.example!", {"email"}),
        ("Reach me via wanda [at] shop [dot] example [dot] org please", {"email"}),
        ("Call or text +44 7700 900123 after lunch", {"phone"}),
        ("They wanted my SSN 948-19-4106 before a demo.", {"id_number"}),
        ("Support asked me to confirm passport no. XZ1234567", {"id_number"}),
        ("Our workshop sits at 12 Larkmere Road, Port Asher near the canal", {"address"}),
        ("The rep I spoke to was Helena M. Brandvik; also 020 7946 0123", {"name", "phone"}),
        ("Server 192.168.0.12 answered with build 24.10.12345.6789.", set()),
        ("u/QuietOtter and @frontdesk already answered that", set()),
        ("The range 100-200-3000 is our seat ladder. Ticket 1234567 was closed", set()),
        ("On 2026-03-20 the archive returned 503 errors, order 5895-3153 did not", set()),
        ("", set()),
    ],
)
def test_kinds(model, text, kinds):
    assert {k for *_, k in model.spans(text)} == kinds


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("I spoke with Kwabena yesterday.", {"name"}),
        ("It works now. Regards, Siobhan Gallagher", {"name"}),
        ("Write to PO Box 4411, Dallas", {"address"}),
        ("mail " + "a" * 80 + "@example.com now", {"email"}),
        ("IBAN DE89 3704 0044 0532 0130 00 please", {"id_number"}),
        ("The Sales Team met Customer Success in May.", set()),
        ("The range 100-200-3000 is a ladder, 10.0.19045.3086 a version", set()),
        ("1 2 3 " * 30 + "call +44 7700 900123", {"phone"}),
    ],
)
def test_kinds_beyond_the_lists(model, text, kinds):
    assert {k for *_, k in model.spans(text)} == kinds


def test_names_that_no_list_holds(model):
    """Given names outside of the list, in frames that the training doesn't have."""
    names = [f"{a} {b}" for a in ("Thandeka", "Oluwaseun", "Siobhan", "Xiaoming", "Dragoslav", "Katarzyna", "Ngozi", "Aoife", "Tevita", "Bhavna") for b in ("Mokoena", "Gallagher", "Petrov", "Okafor", "Wiśniewski")]
    frames = ["Yesterday I had lunch with {} and we agreed", "the person in charge, {}, never answered", "It was {} who told us", "please ask for {} when you arrive"]
    found = sum("name" in {k for *_, k in model.spans(f.format(n))} for f in frames for n in names)
    assert found >= 0.65 * len(names) * len(frames), found / (len(names) * len(frames))


def test_held_out_sentences(model):
    import numpy as np

    rows = list(training_sentences(np.random.default_rng(123), 400))
    right = sum({k for *_, k in model.spans(t)} == {k for *_, k in s} for t, s in rows)
    assert right >= 0.96 * len(rows)


def test_a_clear_mention_decides_about_an_unclear_one(model):
    text = "I met Mr. Gorvindale today.\nGorvindale signed the contract."
    assert [text[a:b] for a, b, k in model.spans(text) if k == "name"][-1].startswith("Gorvindale")


def test_a_clear_mention_decides_about_distant_ones(model):
    text = "I met Mr. Gorvindale today.\n" + "Gorvindale signed the contract.\n" * 40
    assert sum("Gorvindale" in text[a:b] for a, b, k in model.spans(text) if k == "name") == 41


def test_placeholders(spark, model):
    rows = [(1, "Mail ｊｏｅ＠mail.example now"), (2, None), (3, ""), (4, "nothing here"), (5, "x " * 50_000 + "call +44 7700 900123")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("redacted", F.lit("clash"))
    got = {r["id"]: r for r in pii.personal_information(df, ["id"], "t", model).collect()}
    assert got[1]["redacted"] == "Mail [EMAIL] now" and got[1]["kinds"] == ["email"]
    assert got[2]["redacted"] is None and got[2]["kinds"] == [] and got[3]["redacted"] == "" and got[4]["redacted"] == "nothing here"
    assert got[5]["redacted"].endswith("call [PHONE]")


LABELLED = [("You are a moron", "abusive"), ("Get lost, idiot", "abusive"), ("nobody asked you, bastard", "abusive"), ("only an asshole would write this", "abusive"), ("immigrants are vermin and should be kicked out", "hateful"), ("we would be better off without women", "hateful"), ("send me your nudes", "sexual"), ("who wants to see my porn pics", "sexual")] * 6 + [(t, "ok") for t in ("the import was slow", "thanks a lot you all", "our team likes the report", "my own dumb mistake", "stupid question but where is it", "we killed the worker")] * 10


def test_disguised_abuse(spark):
    m = abuse.Model(LABELLED)
    for text in ("You are a m0r0n", "get lost, i d i o t", "GET LOST, IDIIIIOT!!", "nobody asked you, b**tard", "what an @sshole you are", "watch me strip in a private show", "those foreigners are subhuman", "You are а mоron"):
        assert m.score(text)[0] < 0.5, text
    for text in ("my own dumb mistake", "We had to kill the stuck worker", "order a1b2 is late", "", None, "The breast cancer charity", "version 1.2.333 fixed it", "I am such an idiot for missing that"):
        assert m.score(text)[0] > 0.5, text
    df = spark.createDataFrame([(1, "a", "You are a moron"), (2, "a", None), (3, None, "fine")], "id int, s string, t string")
    scores = abuse.content_scores(df, m, ["id", "s"], "t")
    assert {r["s"]: (r["rows"], r["flagged"]) for r in abuse.rates(scores, "s").collect()} == {"a": (2, 1), None: (1, 0)}


def test_sentences_without_a_listed_word_are_scored():
    m = abuse.Model(LABELLED + [("go away you zorgle", "abusive"), ("they are all zorgle", "abusive"), ("I hope someone will kill you", "abusive"), ("watch your back because I know your street", "abusive")] * 60)
    for text in ("go away zorgle", "The import was slow. Go away zorgle", "I will hurt you", "I will find where you live", "they will beat you"):
        assert m.score(text)[0] < 0.5, text
    assert m.score("the import was slow, thanks a lot")[0] > 0.5 and m.score("qwxv")[0] > 0.8


def test_what_only_the_labels_show_is_found():
    rude = [f"your {w} smells of old fish and so does your whole outfit" for w in ("desk", "team", "office", "coat")] * 30
    m = abuse.Model([(t, "abusive") for t in rude] + [(t, "ok") for t in ("the desk came with a whole office", "our team likes the coat", "fish for lunch at the office", "so does the old report")] * 40)
    assert m.score("Your shop smells of old fish!")[0] < 0.5 and m.score("Your sh0p sm3lls of old f1sh!")[0] < 0.5
    assert m.score("our office likes fish")[0] > 0.5 and m.score("Your team likes the old coat")[0] > 0.5


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/content_labels.parquet"), reason="no test tables here")
def test_held_out_labels(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/content_labels.parquet").filter("label is not null").orderBy("label_id").select("text", "label").collect()]
    m = abuse.Model([r for i, r in enumerate(rows) if i % 4])
    held = [(m.score(t)[0] < 0.5, y != "ok") for t, y in rows[::4]]
    both = sum(f and y for f, y in held)
    assert both >= 0.95 * sum(f for f, _ in held) and both >= 0.95 * sum(y for _, y in held)


def test_masks_of_any_length_are_decoded_exactly():
    m = abuse.Model(LABELLED)
    assert m.reader.restore("you " + "id" + "*" * 3000 + "iot")[-1] != "" and m.reader.restore("you i" + "*" * 3 + "t")[-1] == "idiot"


@pytest.mark.parametrize("text", ["you are a sc" + "u" * 80 + "mbag", " ".join("you are such a worthless lying little clown and a moron".replace(" ", "")), "you " + "i_d_i_o_t_" * 12 + "i_d_i_o_t"])
def test_long_disguises_are_decoded_whole(text):
    m = abuse.Model(LABELLED)
    words = m.reader.restore(text)
    assert words[-1] in abuse.INSULTS, words
    assert m.score(f"You, {text}")[0] < 0.5


@pytest.mark.parametrize("unit", ["a", "A", "Word ", "a.b.", "1-", "x@", "a b c d ", "a*", "Mr. Anna Marie ", "+44 7700 900123 ", "you idiot ", "x\n", "🤷‍♀️", ". ", "a\u200d"])
def test_long_runs_are_read_in_time(model, unit):
    import time

    m, text = abuse.Model(LABELLED), unit * (40_000 // len(unit))
    began = time.time()
    model.spans(text), m.score(text)
    assert time.time() - began < 20


needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.json"), reason="no vocabulary files here")


@needs_vocabulary
def test_tokens_agree_with_the_public_library(spark):
    import random

    import numpy as np
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    texts = ["Hello world", "", None, "  \n\t x", "<|endoftext|> a", "naïve 日本語 🤷‍♀️", "a" * 3000, "don't can't we'll 1234567", "\x00\x7f", "Ünïcödé" * 40, "хорошо " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("ids", F.lit(0))
    for vocabulary in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"):
        got = {r["doc_id"]: r["ids"] for r in encode(df, "text", ["doc_id"], vocabulary).collect()}
        assert got == {i: public.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["ids"] for r in encode(df, "text", ["doc_id"], count_only=True).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}
    e, _ = encoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    rng = random.Random(4)
    common = [t for t in e.ranks.values() if len(e.token[t]) < 6]
    pairs = np.array([rng.choice(common) << 32 | rng.choice(common) for _ in range(4000)])
    fine = e.compatible(pairs)
    assert fine.tolist() == [e.merge(e.token[p >> 32] + e.token[p & 0xFFFFFFFF]) == (p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()]
    assert fine.any() and not fine.all()  # some guesses fail their check and are merged exactly
    assert encode(df.limit(0), "text", ["doc_id"]).count() == 0


def test_containers(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.randint(0, 60)) for i in range(1500)] + [(5000, 250), (5001, 100), (5002, 300), (5003, None)]
    df = spark.createDataFrame(rows + rows[:40], "doc_id long, n int").withColumn("size", F.lit("x"))
    got = fill_containers(df, "doc_id", "n", 100).collect()
    loads, parts = {}, {}
    for r in got:
        loads[r["container"]] = loads.get(r["container"], 0) + r["size"]
        parts.setdefault(r["doc_id"], []).append((r["part"], r["size"]))
    assert max(loads.values()) <= 100 and set(parts) == {r[0] for r in rows}
    assert sorted(parts[5000]) == [(0, 100), (1, 100), (2, 50)] and sorted(parts[5002]) == [(0, 100), (1, 100), (2, 100)] and parts[5001] == [(0, 100)]
    assert all(len(p) == 1 for d, p in parts.items() if d < 5000)
    total = sum(s or 0 for _, s in rows)
    assert len(loads) <= -(-total // 100) * 1.02 + 1
    assert fill_containers(df.limit(0), "doc_id", "n", 100).count() == 0


def test_the_search_takes_fewer_containers_than_best_fit(spark):
    """Sizes between a fifth and half of a container: best fit is far from the bound, and generations come nearer."""
    import random

    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.randint(200, 500)) for i in range(900)], "doc_id long, n int")
    counts = [fill_containers(df, "doc_id", "n", 1000, generations=g).select("container").distinct().count() for g in (0, 60)]
    assert counts[1] < counts[0]


def test_quality_labels_and_counts(spark):
    prose = "We compared the two tools last week. The first one was slow, but it did what we needed.\n"
    rows = [
        (1, prose * 3, "prose"), (2, None, "none"), (3, "   ", "none"), (4, "too short", "none"), (5, "* one thing\n* another thing\n* a third one\n* more", "list"), (6, "a,b,1,2\n2026-01-01,x,5,7\n2026-01-02,y,6,8\n", "table"), (7, "spam " * 60, "junk"),
        (8, "xkcdq wrtzp qqgh sdfkl zxcv bnmk wrtp lkjh", "junk"), (9, "<*&>!@#/$%^\\|~<*&>!@#/$%^\\|~ word", "junk"), (10, prose.lower().replace(".", "").replace(",", "") * 2, "prose"), (11, prose * 2 + "- one\n- two\n- three\n", "prose"), (12, "| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |", "table"), (13, "     eleven ch     \n\n    ", "none"), (14, "\n".join(" " * 200 + "- " + " ".join(f"{w}{v}" for v in ("one", "two", "six", "ten", "all", "any", "few", "red", "sea", "sun")) for w in ("be", "ga", "mi", "to")), "list"),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, prose * 3)], "doc_id long, text string").withColumn("words", F.lit(1))
    got = {r["doc_id"]: r for r in text_quality(df, "doc_id", "text").collect()}
    assert {i: got[i]["label"] for i, *_ in rows} == {i: label for i, _, label in rows}
    assert got[2]["n_words"] == 0 and got[1]["n_words"] == len(prose.split()) * 3 and got[1]["ended_line_share"] == 1.0
    assert text_quality(df.limit(0), "doc_id", "text").count() == 0


def test_quality_does_not_depend_on_the_chunk(spark):
    text = "The naïve tools of the team were slow.\r\n- item one\nhttps://x.example/a?b=1\n" * 40 + "x" * 300
    df = spark.createDataFrame([(1, text), (2, text[:777]), (3, "a\n" * 500), (4, " " * 2000 + "short" + "\n" * 1500), (5, " " * 900 + "* one two three four five six seven eight nine ten\n" * 60)], "doc_id long, text string")
    whole = [tuple(r) for r in text_quality(df, "doc_id", "text").orderBy("doc_id").collect()]
    for chunk in (311, 1024):
        assert [tuple(r) for r in text_quality(df, "doc_id", "text", chunk=chunk).orderBy("doc_id").collect()] == whole
