import pytest

from trawl.llm import language as L
from trawl.llm import lookalike as K
from trawl.llm import mojibake as M
from trawl.llm import sentences as S
from trawl.llm.sentences import sentences
from trawl.llm.splitting import Splitter, StrongestCut, boundary_class


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Halvek met J. K. Marn at 11 a.m. on Monday.", "It cost 3.5 GB, i.e. less than No. 7.", "See v1.2.3!", "Why?"],
        ["Am 3. Mai kam Fr. Dr. Ostrand, z. B. wegen Nr. 5, vgl. S. 45.", "„Jetzt läuft es. Gut!“ stand in der Meldung.", "Er schrieb: „Ende.“", "Alte Fotos usw.", "Danach kam nichts."],
        ["M. Corvel a dit : « Ça marche. Enfin ! »", "« Qui ? » disait la note, c.-à-d. la pièce 5.", "Quel désordre !"],
        ["¿Sigue a.txt en el disco?", "«Ya funciona.» decía la nota, p. ej. la del Sr. Quorín.", "¡Qué desorden!"],
        ["Г. Велтов просил ок. 5 страниц (см. рис. 3), т. е. немного.", "«Кто? Я.» гласила заметка.", "Всё и т. д.", "Конец."],
        ['ד"ר הלבק כתב: "נסו שוב. עכשיו!"', "אתמול הסורק סיים.", 'לפי היומן "ישן. חדש" היה רשום.'],
        ["كتب د. هلفيك: «من نقل المجلد؟»", "أمس انتهى ص. 5 من الملف.", "لماذا؟"],
        ["डॉ. हलवेक ने पृ. 5 देखा।", "क्या यह सही है?", "हाँ!"],
    ],
)
def test_sentences_with_spaces(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("\r\n".join(parts)) == parts  # a line break ends nothing by itself


@pytest.mark.parametrize(
    "parts",
    [
        ["今天早上，它找到了文件。", "海维克写道：“什么都没有丢。谁？”", "重启之后，编号3……，它停了！", "“请再试”这是备注。"],
        ["記録によると、版4.1で直りました。", "「もう一度。さあ！」と書かれていました。", "担当者は「何も？」", "検索が断片を……比べました。"],
        ["昨日、表を比べました", "　今朝、古い 請求書を見つけました", " しかし動きません"],
        ["今天早上找到了", " 根据日志，旧 发票不在了"],
        ["係は「もう一度。」", "とても急ぎました。"],
        ["กรุณาตรวจไฟล์ memo.xlsx ก่อนประชุม", " เมื่อวานพบ 14 ชุด", " สุดท้าย"],
    ],
)
def test_sentences_without_spaces(parts):
    assert cut("".join(parts)) == [p.strip() for p in parts]


def test_units():
    text = "# Head one\n- item. Two\n* next item\ngoes on\n\n## 7.1 Title\n\n• third\nPlain start\n \t\nAfter."
    assert cut(text) == ["Head one", "item.", "Two", "next item\ngoes on", "7.1 Title", "third\nPlain start", "After."]
    assert cut("- \n\n* ") == [] and cut(None) == [] and cut("") == [] and cut(" \n ") == []
    assert cut("Lost. draft_1.md moved on.") == ["Lost.", "draft_1.md moved on."]
    assert cut("He said... nothing. (See fig. 3.) Done") == ["He said... nothing.", "(See fig. 3.)", "Done"]
    assert len(cut("word. " * 20000)) <= 20000


def test_a_dictionary_is_learnt_from_the_corpus(spark):
    texts = ["夜班记录完整。磁盘检查完毕。", "夜班记录缺失！旧磁盘检查完毕。", "夜班记录很长。新磁盘检查完毕。", None, "", "plain words"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    made = S.learn(df)
    assert {"夜班记录", "检查完毕"} <= set(made.cost) and "整" in made.cost and "完整" in made.cost
    assert [("夜班记录检查完毕"[a:b]) for a, b in made.cut("夜班记录检查完毕", 0, 8)] == ["夜班记录", "检查完毕"]
    # no final mark: only the dictionary tells that one closes and the other opens
    text = "旧磁盘检查完毕 夜班记录完整"
    assert [text[a:b] for a, b in sentences(text, made)] == ["旧磁盘检查完毕", "夜班记录完整"] and len(sentences(text)) == 1
    text = "旧磁盘 检查完毕"
    assert len(sentences(text, made)) == 1
    assert S.learn(df.where("false")).cost == S.Lexicon().cost


def test_the_cheapest_path_against_all(seed=4):
    import itertools
    import random

    rng = random.Random(seed)
    for _ in range(200):
        at, made = 0, []
        for _ in range(rng.randint(0, 8)):
            at += rng.randint(1, 4)
            end = rng.random() < 0.5
            w = rng.choice([1.0, 3.0, 4.0, 10.0]) + rng.random()
            made.append((at, 0.0 if end else w, w if end else 0.0, rng.randint(0, at) if rng.random() < 0.4 else None))

        def cost(chosen):
            total, begin = 0.0, 0
            for k, (place, end, skip, not_from) in enumerate(made):
                if k in chosen:
                    if not_from is not None and begin >= not_from:
                        return float("inf")
                    total, begin = total + end, place
                else:
                    total += skip
            return total

        best = min(cost(set(c)) for n in range(len(made) + 1) for c in itertools.combinations(range(len(made)), n))
        got = S.cheapest(0, made)
        assert abs(cost({k for k, m in enumerate(made) if m[0] in got}) - best) < 1e-9


def test_time_grows_with_the_length():
    import time

    def took(n):
        start = time.process_time()
        for text in ("Dr. Word went on. " * n, "“a. b. " * n, '"He said. ' * n + '"', "今天早上。" * n, "etc. " * n):
            sentences(text)
        return time.process_time() - start

    took(2000)
    assert took(40_000) < 8 * took(10_000) + 0.2


def test_strongest_cut_goes_right():
    import numpy as np

    rng = np.random.default_rng(2)
    places, strengths = np.arange(3, 400, 3), rng.integers(1, 4, 133)
    t = StrongestCut(places, strengths, 64)
    for _ in range(300):
        a = int(rng.integers(0, 380))
        b = a + int(rng.integers(0, 120))
        inside = [(s, p) for p, s in zip(places, strengths) if a <= p <= b]
        assert t.query(a, b) == ((int(max(inside)[1]), int(max(inside)[0])) if inside else (-1, 0))


@pytest.mark.parametrize("text", ["x" * 5000, "word " * 1000, "a\n" * 3000, "今" * 4000 + "。" + "天" * 3000, "\n" * 3000, "a " + "b" * 1790 + "\n" + "c " * 880 + "\nzz", "né " * 700 + "é" * 4000, "e" + "́" * 4000])
def test_pieces(text):
    import re

    made = Splitter(text, 1800, 400, 60).pieces()
    assert made[0][0] == 0 and made[-1][1] == len(text)
    for (a, b), (c, d) in zip(made, made[1:]):
        assert a < c <= b < d
    assert all(b - a <= 1800 and len(re.findall(r"[^ \t\r\n]+", text[a:b])) <= 400 for a, b in made)
    if boundary_class(text, 1800, 400) == "line":
        assert all(text[b - 1] == "\n" for _, b in made[:-1])


def test_overlap_is_sixty_words():
    text = " ".join(f"w{i}" for i in range(1500))
    made = Splitter(text, 1800, 400, 60).pieces()
    assert {len(text[c:b].split()) for (_, b), (c, _) in zip(made, made[1:])} == {60}


def test_boundary_classes():
    assert boundary_class("a\n" * 900, 1800, 400) == "line" and boundary_class("a " * 900, 1800, 400) == "space" and boundary_class("a" * 1801, 1800, 400) == "nospace"


TRAIN = {
    "en": "the search box found the old files and the team asked for more pages before the review",
    "de": "das Suchfeld hat die alten Dateien gefunden und das Team hat vor der Prüfung mehr Seiten gewünscht",
    "fr": "le moteur a trouvé les vieux fichiers et l’équipe a demandé plus de pages avant la revue",
    "ru": "поиск нашёл старые файлы", "zh": "搜索引擎找到了旧文件", "ja": "検索エンジンは古いファイルを見つけました",
}


@pytest.fixture(scope="module")
def model():
    return L.fit([(t, g) for g, t in TRAIN.items()] * 5 + [(TRAIN["de"], "en")])


def test_languages_of_lines(model):
    text = "\n".join([TRAIN["en"], "", TRAIN["de"], "12 34", TRAIN["ru"], "שלום", TRAIN["ja"], TRAIN["zh"]])
    (spans,) = model.spans([text])
    assert [(a, b, g) for a, b, g, _ in spans] == [(0, 2, "en"), (2, 4, "de"), (4, 5, "ru"), (5, 6, "he"), (6, 7, "ja"), (7, 8, "zh")]
    assert all(0 < c <= 1 for *_, c in spans)


def test_confidences_follow_the_labels():
    import random

    rng = random.Random(2)
    texts = [(" ".join(rng.choices(TRAIN[g].split(), k=12)), g) for g in ("en", "de", "fr") for _ in range(150)]
    rng.shuffle(texts)
    wrong = [(t, rng.choice("en de fr".split()) if rng.random() < 0.3 else g) for t, g in texts]
    assert L.fit(texts).spread > L.fit(wrong).spread and L.fit(texts[:50]).spread == 8.0
    sure, unsure = (sum(s[0][3] for s in L.fit(x).spans([t for t, _ in texts])) / len(texts) for x in (texts, wrong))
    assert 0.5 < unsure < sure - 0.05  # a fifth of the labels are wrong


def test_a_foreign_word_switches_nothing(model):
    (spans,) = model.spans([TRAIN["en"] + " gefunden " + TRAIN["en"]])
    assert [s[2] for s in spans] == ["en"]
    assert model.spans(["", "12 !", TRAIN["fr"]])[0] == [] and model.spans([TRAIN["fr"]])[0][0][2] == "fr"


def test_viterbi_against_all_paths(model):
    import itertools

    import numpy as np

    words = "files Seiten équipe asked".split()
    seq = model.indices(["files", "Seiten", "\n", "équipe", "asked"])
    some = [L.LANGUAGES.index(g) for g in ("en", "de", "fr")]
    best = max(
        itertools.product(some, repeat=5),
        key=lambda p: model.table[seq, list(p)].sum()
        - sum((L.SWITCH_AT_LINE if t == 0 or seq[t - 1] == 0 else L.SWITCH_IN_LINE) * (p[t] != p[t - 1]) for t in range(1, 5)),
    )
    got = model._viterbi([seq])[0]
    score = lambda p: model.table[seq, list(p)].sum() - sum((L.SWITCH_AT_LINE if seq[t - 1] == 0 else L.SWITCH_IN_LINE) * (p[t] != p[t - 1]) for t in range(1, 5))
    assert np.isclose(score(got), score(best)) and len(words) == 4


def test_labels(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in ("EN", "pt-BR", "zh_Hans", "und", "", None, "xx", " de ")], "lang string")
    assert [r[0] for r in df.select(L.normal_label(F.col("lang"))).collect()] == ["en", "pt", "zh", None, None, None, None, "de"]


def test_fold():
    assert K.fold("Ｆｕｌｌ　ｗｉｄｔｈ") == "Full width" and K.fold("é​x­ y") == "éx y"
    assert K.fold("a\r\nB…") == "a\r\nB…"


def test_repairs():
    r = K.Repairer()
    assert r.repair("thе", "L") == "the" and r.repair("Поиcкoвик", "L") == "Поисковик" and r.repair("Μай", "L") == "Май"
    assert r.repair("lа", "L") == "la" and r.repair("а", "C") is None and r.repair("а", "L") == "a"
    assert r.repair("the", "L") is None and r.repair("шlm", "L") is None
    assert r.repair("ещë".replace("ë", "ë"), "C") == "ещё"


def test_look_alikes(spark):
    values = ["the garden plan", "thе gаrden plan", "thｅ garden plan", "The garden plan", "the garden plan", "unseen wоrd", "unseen wоrd ", " ", None, "shy­hyphen", "shyhyphen"]
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)] + [("u", 1, "thе garden plan")], "field string, id long, value string")
    got = {tuple(r) for r in K.look_alikes(df).collect()}
    assert got == {("t", a, b) for a, b in ((0, 1), (0, 2), (1, 2), (1, 4), (2, 4), (9, 10))}


def test_a_repair_needs_its_word(spark):
    texts = ["wоrd alone", "other text", "zеbra", "zebrа", "zebra", "poc and more", "рос из шума", "о poc", "ﬁle Ⅳ"]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts, 1)], "field string, id long, value string")
    forms = {r["id"]: r["text"] for r in K.normalised(df).collect()}
    assert forms[1] == "wоrd alone" and forms[3] == forms[4] == "zebra" and forms[9] == "file IV"
    assert forms[7] == "рос из шума"  # a word of one script among others of it stays, though the corpus has its look-alike
    df = df.where("id <> 5 AND id <> 3")
    assert {r["id"]: r["text"] for r in K.normalised(df).collect()}[4] == "zebrа"


def test_whole_words_of_look_alikes():
    r = K.Repairer()
    assert r.repairs("Ѕеm аvіѕо now") == {("Ѕеm", "Sem"), ("аvіѕо", "aviso")} and r.repairs("тот рос") == set()
    assert r.repairs("plain о line") == {("о", "o")} and r.repairs("line о шум") == set()


CHAINS = [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "cp1255"), ("utf-8", "cp850"), ("utf-8", "latin_1"), ("cp1252", "mac_roman"), ("utf-8", "cp1252", "utf-8", "cp1252")]


def test_chains_turn_back():
    for c in CHAINS:
        for w in ("Übersicht", "niño", "l’été", "größere"):
            assert M.ungarble(M.garble(w, c), c) == w
    assert M.ungarble(M.garble("Рецепты", ("koi8_r", "cp1251")), ("koi8_r", "cp1251")) == "Рецепты"
    assert M.garble("Família", ("cp1252", "utf-8")) == "Fam�lia" and M.ungarble("Fam�lia", ("cp1252", "utf-8")) is None


def test_kinds_of_words():
    for w in ("Übersicht", "été", "l’équipe", "NÃO", "Отчёт", "חלון", "今天早上", "à", "«Ya", "№"):
        assert M.kind_of(w) in ("clean", "") or w == "№", w
    for w in ("Ã¼ber", "ÐŸÐ¾Ñ\x81Ð»Ðµ", "Gesti├│n", "Fam�lia", "K¸che", "лБЛПК", "×©×œ"):
        assert M.kind_of(w) == "odd", w


def test_found_and_restored(spark):
    clean = ["Die Übersicht für größere Küchen", "Какой беспорядок на диске", "今天早上夜间扫描找到了旧发票", "אתמול מנהל התור שמר את התיקייה", "Família Relatório"] * 6
    made = [
        ("utf-8 cp1252", M.garble(clean[0], ("utf-8", "cp1252"))), ("koi8", M.garble(clean[1], ("koi8_r", "cp1251"))), ("gbk", M.garble(clean[2], ("gbk", "latin_1"))),
        ("twice", M.garble(clean[0], ("utf-8", "cp1252", "utf-8", "cp1252"))), ("hebrew", M.garble(clean[3], ("cp1255", "cp1251"))), ("part", "Guter Text. " + M.garble("für Küchen", ("utf-8", "cp1251"))),
        ("lost", M.garble("Família", ("cp1252", "utf-8"))),
    ]
    rows = [("t", i, v) for i, v in enumerate(clean)] + [("t", 100 + i, v) for i, (_, v) in enumerate(made)]
    rows += [("t", 200, "plain ascii"), ("t", 201, None), ("t", 202, "schöne Wörter 📁 № 5"), ("t", 203, "thе gаrdеn")]
    df = spark.createDataFrame(rows, "field string, id long, value string")
    assert sorted(r["id"] for r in M.garbled(df).collect()) == [100 + i for i in range(len(made))]
    back = {r["id"]: (r["restored"], r["complete"]) for r in M.restored(df).collect()}
    assert [back[100 + i][0] for i in range(5)] == [clean[0], clean[1], clean[2], clean[0], clean[3]]
    assert back[105] == ("Guter Text. für Küchen", True) and back[106][0] == "Família"


def found(spark, rows):
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(rows)], "field string, id long, value string")
    return {r["id"] for r in M.garbled(df).collect()}


def test_garbled_copies_outnumber_the_original(spark):
    clean = ["Какой беспорядок на диске", "Die Übersicht für größere Küchen", "אתמול מנהל התור שמר את התיקייה"]
    made = [M.garble(clean[0], ("koi8_r", "cp1251")), M.garble(clean[0], ("cp1251", "cp1252")), M.garble(clean[1], ("mac_roman", "cp1252")), M.garble(clean[2], ("cp1255", "cp1252"))]
    assert found(spark, clean + made * 9) == set(range(3, 39))
    # in many different texts, too, and in names of one word
    assert found(spark, ["диск", "Küche"] + [f"{g} {n}" for n in range(5) for g in (M.garble("диск беспорядок", ("cp1251", "latin_1")), M.garble("Küche", ("cp1252", "cp850")))]) >= {3, 5, 7, 9, 11}
    # Hebrew that looks like Cyrillic words
    many = [f"{clean[2]} {n}" for n in range(8)]
    assert found(spark, many + [M.garble(clean[2], ("cp1255", "cp1251"))] * 30) == set(range(8, 38))


def test_words_of_few_accents_tell_together(spark):
    clean = ["il est très tard après la fête", "não sei da informação"]
    rare = "קובץ נדיר"
    rows = [f"{c} {n}" for c in clean for n in range(5)] + [M.garble(c, ("cp1252", "cp1250")) for c in clean]
    rows += [f"{rare} {w}" for w in ("אתמול",)] + ["אתמול"] * 4 + [M.garble(f"{rare} אתמול", ("cp1255", "cp1251")), "trčs"]
    # the last: one short word alone tells nothing
    assert found(spark, rows) == {10, 11, 17}


def test_originals_that_are_nowhere_clean(spark):
    garbled = M.garble("größere Übersichten", ("utf-8", "cp1252"))
    assert found(spark, [garbled, "mеѕѕ", "NÃ\xadO", "plain", "été"]) == {0}
    assert M.read_back(garbled.split()[0]) == "utf-8 cp1252" and M.read_back("Мѕ") is None and M.read_back("K\ufffdche") is None


def test_garbled_twice_and_short_runs_of_spaceless_scripts(spark):
    thai, chinese = "ตัวค้นหาเปิดร่างเอกสาร", "夜间扫描找到了旧发票"
    rows = [thai, chinese, "文", "file 文 1"] + [M.garble(thai, ("utf-8", r, "utf-8", r)) for r in ("cp1252", "cp850")] + [M.garble(chinese, ("utf-8", "cp1252", "utf-8", "latin_1")), "a " + M.garble("文", ("utf-8", "cp1252"))]
    assert found(spark, rows) == {4, 5, 6, 7}


def test_one_strange_letter_in_a_long_word(spark):
    rows = [f"l’estrattore ha letto {n}" for n in range(6)] + [M.garble("l’estrattore", ("cp1252", "mac_roman")) + " ha letto", "líquido", "Київ вкраїнська мова", "Ελληνικά κείμενα", "한국어 문서"]
    rows += [M.garble(x, ("utf-8", "cp1252")) for x in rows[-3:]]
    assert found(spark, rows) == {6, 11, 12, 13}


def test_what_python_makes_of_words_is_not_broadcast(spark):
    clean = ["Die Übersicht für größere Küchen", "Какой беспорядок на диске"]
    made = [M.garble(clean[0], ("utf-8", "cp1252")), M.garble(clean[1], ("koi8_r", "cp1251")), "Fam�lia"]
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(clean * 3 + made)], "field string, id long, value string")
    rows = M.runs(df).localCheckpoint()
    plan = M.matches(rows)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
    by_row, match = M.found_runs(df)
    assert "Broadcast" not in match._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] for r in M._marked(by_row, match).collect()} == {6, 7, 8}
