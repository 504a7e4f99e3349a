import math
import os
import random

import pytest

from trawl.llm import mixing, tokens

PATH = f"{tokens.vocabulary_dir()}/{tokens.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")

TEXTS = [
    "", "a", " leading and  double  spaces ", "It's 3.14, isn't it?\r\n\n\ttabs", "<|endoftext|><|im_start|>user", "Größe naïve 今天早上 สวัสดี שלום 👩‍👩‍👧 \u0000\u0001",
    "a" * 20000, " " * 3000 + "x", "�​퟿", "x́" * 50,
]


@pytest.fixture(scope="module")
def codec():
    return tokens.Codec(tokens.serialize_model(tokens.read_ranks(PATH)))


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(PATH), special_tokens={})


def test_ids_of_another_library(codec, other):
    rng = random.Random(5)
    alphabet = "abc ABC 0123.,'s\n\t" + "éüñ今早はกא👋ß"
    made = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    assert list(codec.encode(made)) == [other.encode_ordinary(t) for t in made]


def test_round_trip(codec):
    assert [codec.decode(i) for i in codec.encode(TEXTS)] == TEXTS


def test_every_rank_is_its_piece(codec):
    ranks = tokens.read_ranks(PATH)
    assert all(codec.bytes[i] == b for b, i in ranks.items())


def test_spark(spark, other):
    df = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()}
    assert got == {i: other.encode_ordinary(t) for i, t in enumerate(TEXTS)} | {len(TEXTS): []}
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == dict(enumerate([*TEXTS, ""]))


def test_a_small_cache_changes_nothing(codec, monkeypatch):
    want = list(codec.encode(TEXTS))
    monkeypatch.setattr(tokens, "CACHE", 3)
    fresh = tokens.Codec(tokens.serialize_model(tokens.read_ranks(PATH)))
    assert [next(iter(fresh.encode([t]))) for t in TEXTS] == want


@pytest.mark.parametrize("rate,cap", [(0.3, 4), (2.0, 4), (3.9, 4), (1.0, 1), (0.99, 1), (5, 40), (0, 3), (3, 0), (499.5, 900), (700.0, 720), (1500.0, 1550)])
def test_thresholds_keep_the_mean(rate, cap):
    t = mixing.thresholds(rate, cap)
    mean = sum(1 - x for x in t)
    assert len(t) <= cap and mean == pytest.approx(min(rate, cap), abs=1e-6)
    assert all(a <= b for a, b in zip(t, t[1:]))


def test_uncut_thresholds_are_poisson():
    t = mixing.thresholds(2.0, 60)
    p, below = math.exp(-2), 0.0
    for k, x in enumerate(t[:8]):
        below += p
        assert x == pytest.approx(below, abs=1e-9)
        p *= 2 / (k + 1)


def documents(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(5, 40), rng.choices(["big", "mid", "small", "other", None], [60, 30, 3, 5, 2])[0]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_mix(spark):
    d = documents(spark)
    targets = spark.createDataFrame([("big", 0.3, 3), ("mid", 0.5, 4), ("small", 0.15, 2), ("gone", 0.05, 9), ("big", 0.3, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    made, report = mixing.mix(d, targets)
    made.cache()
    shares = {r["source"]: r for r in report.collect()}
    assert set(shares) == {"big", "mid", "small", "gone"}
    assert not shares["small"]["reaches"] and not shares["gone"]["reaches"] and shares["big"]["reaches"] and shares["mid"]["reaches"]
    assert shares["small"]["repeats"] == 2.0 and made.where("source = 'small'").groupBy("doc_id").count().where("count <> 2").count() == 0
    assert made.groupBy("source", "doc_id").count().where("count > 4").count() == 0
    for s in ("big", "mid"):
        assert shares[s]["used_tokens"] == pytest.approx(shares[s]["target_share"] * shares[s]["mix_tokens"], rel=0.12)
    assert sum(r["actual_share"] for r in shares.values()) == pytest.approx(1)
    assert made.where("source IS NULL OR source = 'other'").count() == 0
    order = [r["doc_id"] for r in made.collect()]
    assert order != sorted(order) and order == [r["doc_id"] for r in mixing.mix(d, targets)[0].collect()]


def test_large_rates_stay_poisson():
    t = mixing.thresholds(800.0, 2000)
    variance = sum((2 * k + 1) * (1 - x) for k, x in enumerate(t)) - sum(1 - x for x in t) ** 2
    assert variance == pytest.approx(800, rel=1e-6)


def test_report_is_that_of_the_mix(spark):
    d = documents(spark, 400)
    targets = spark.createDataFrame([("big", 0.5, 3), ("mid", 0.5, 4)], "source string, target_share double, max_repeats int")
    assert sorted(mixing.report(d, targets).collect()) == sorted(mixing.mix(d, targets)[1].collect())


def test_short_sources_by_hand(spark):
    sized = mixing.sized(documents(spark))
    targets = spark.createDataFrame([("big", 0.1, 1), ("small", 0.5, 3), ("gone", 0.4, 5)], "source string, target_share double, max_repeats int")
    by = {r["source"]: r["t"] for r in sized.groupBy("source").sum("n_tokens").toDF("source", "t").collect()}
    total = by["big"] + by["small"]
    want = {s for s, share, cap in (("big", 0.1, 1), ("small", 0.5, 3), ("gone", 0.4, 5)) if cap * by.get(s, 0) < share * total}
    assert {r["source"] for r in mixing.mix_plan(sized, targets).where("NOT reaches").collect()} == want
