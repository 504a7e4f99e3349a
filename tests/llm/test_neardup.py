import random
import re

import pytest

from trawl.llm import neardup as D


def jaccard(a, b, n):
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (re.findall(D.WORD, t) for t in (a, b))]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(120):
        base = [rng.choice(words) for _ in range(rng.randint(45, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            edited = list(base)
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(edited))
                edited[at : at + rng.randint(0, 2)] = [rng.choice(words)] * rng.randint(0, 2)
            out.append(" ".join(edited))
    return out + out[:20] + out[:5] * 3


@pytest.mark.parametrize("words,threshold", [(3, 0.7), (5, 0.8)])
def test_against_all_pairs(spark, words, threshold):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, rep string").repartition(5)
    got = {tuple(r) for r in D.linked_rows(*D.near_duplicates(df, words=words, threshold=threshold)).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a != b and jaccard(a, b, words) >= threshold}
    assert got <= want and len(want - got) <= 0.002 * len(want) and len(want) > 50


def test_prefix_is_shortened_to_the_recall():
    d = D.prefix_length(0.7, 40, 8, 0.999)
    assert 1 - (1 - 0.7**d) ** 40 >= 0.999 > 1 - (1 - 0.7 ** (d + 1)) ** 40
    assert D.prefix_length(0.9, 40, 8, 0.5) == 8 and D.prefix_length(0.1, 2, 8, 0.999) == 1


def test_least_words_and_words_as_they_stand(spark):
    base = " ".join(f"a{i}" for i in range(40))
    rows = [(1, base), (2, base + " End"), (3, base + "\tend\r\n"), (4, " ".join(base.split()[:39])), (5, base.upper())]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {tuple(r) for r in D.linked_rows(*D.near_duplicates(df, words=3, threshold=0.7, least_words=40)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}


def test_crowded_nodes_keep_long_prefixes_until_recall_is_lost(spark):
    """With a crowd of one nothing may be shortened at first; the texts' recall makes them ask further."""
    texts = corpus(5)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a != b and jaccard(a, b, 3) >= 0.7}
    for crowd in (1, 3, 1000):
        got = {tuple(r) for r in D.linked_rows(*D.near_duplicates(df, words=3, threshold=0.7, crowd=crowd)).collect()}
        assert got <= want and len(want - got) <= 0.003 * len(want), crowd


def test_forest_levels(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[i : i + 60]) for i in range(30)]  # each like its neighbours
    members, signatures, forest = D._forest(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", 3, 0.7, 0, 48, 7, 0.9999, 4)
    placed = forest.placed.toPandas()
    assert forest.extra == 3 and (placed["level3"] == 0).all() and (placed["level0"] >= placed["level1"]).all()
    # a node is as short as its crowd allows, and the same for all who share it
    assert ((placed["crowd"] <= 4) | (placed["level0"] == 3)).all()
    assert (placed.groupby("node")["level0"].nunique() == 1).all() and (placed.groupby("node")["rep"].count() == placed.groupby("node")["crowd"].first()).all()
    assert not forest.asks.isEmpty() and members.count() == 30


def test_groups_of_a_chain(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[i * 8 : i * 8 + 80]) for i in range(12)]  # each like the next, the first unlike the last
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(50, texts[3])], "id long, text string")
    got = {r["id"]: tuple(r) for r in D.near_duplicate_groups(df, words=2, threshold=0.7).collect()}
    assert {r[1] for r in got.values()} == {0} and set(got) == {*range(12), 50}
    assert got[3][2] == 2 and got[0][2] == 1


@pytest.mark.parametrize("crowd", [2, 64])
def test_groups_are_those_of_all_links(spark, crowd):
    df = spark.createDataFrame(list(enumerate(corpus(9))), "id long, text string").repartition(3)
    members, links = D.near_duplicates(df, words=3, threshold=0.7)
    want = sorted(map(tuple, D.grouped(members, links).collect()))
    assert sorted(map(tuple, D.near_duplicate_groups(df, words=3, threshold=0.7, crowd=crowd).collect())) == want and len(want) > 100


def test_hot_copies_cost_one_text(spark):
    base = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(i, base) for i in range(3000)] + [(9000, base + " more")], "id long, text string")
    members, links = D.near_duplicates(df, words=3, threshold=0.7, least_words=40)
    assert links.count() == 1 and members.count() == 3001 and D.linked_rows(members, links).count() == 3000
