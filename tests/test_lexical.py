import sqlite3

import pytest

from trawl.operators.lexical import LexicalIndex, bm25, split_terms

TEXTS = [
    ("the quick brown fox", "animals"), ("Quick quack under_score", None), ("über allen Gipfeln, unter Bäumen", "Goethe"), (None, None), ("", ""),
    ("e-mail the e mailer; email", "mail"), ("foxes fox foxy fox " * 5, "fox"), ("naïve façade naive", ""), ("report 2024-report", "Report"), ("nothing here", "quick"),
]


def fts(terms):
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(text, heading)")
    c.executemany("INSERT INTO t(rowid, text, heading) VALUES (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(TEXTS, 1)])
    match = " AND ".join(f'"{t}"*' for t in terms)
    return {r[0]: round(r[1], 9) for r in c.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEXTS, 1)], "id long, text string, heading string")


@pytest.mark.parametrize("terms", [["fox"], ["quick"], ["qui", "fo"], ["under"], ["naive"], ["e-mail"], ["under_score"], ["2024", "rep"], ["zzz"], ["n"]])
def test_scores_of_a_full_text_index(spark, chunks, terms):
    got = {r["id"]: round(r["score"], 9) for r in bm25(chunks, terms).collect()}
    assert got == pytest.approx(fts(terms), abs=1e-8)


def test_term_without_words_matches_nothing(spark, chunks):
    assert bm25(chunks, ["fox", "!!!"]).count() == 0 and bm25(chunks, []).count() == 0


def test_index_gives_the_same(spark, chunks):
    index = LexicalIndex.build(chunks)
    for terms in (["fox"], ["qui", "fo"], ["under"], ["e-mail"], ["under_score", "quick"]):
        one = {r["id"]: round(r["score"], 9) for r in bm25(chunks, terms).collect()}
        assert one == {r["id"]: round(r["score"], 9) for r in index.search(terms).collect()}
    with pytest.raises(ValueError):
        LexicalIndex(index.postings, index.lengths, True).search(["e-mail"])


def test_tokens():
    assert split_terms(["Über", "e-mail", "!!"]) == [["uber"], ["e", "mail"], []]


def test_empty_table(spark, chunks):
    assert bm25(chunks.where("false"), ["fox"]).count() == 0
