from trawl.functions.chunking import MAX_CHARS, chunked, code_chunks, segments, text_chunks


def test_one_long_line_is_cut_and_whole():
    line = "né" * 2500
    made = text_chunks(line)
    assert "".join(m[0] for m in made) == line and all(len(m[0]) <= MAX_CHARS for m in made) and all(m[2:] == (1, 1) for m in made)


def test_overlap_is_whole_lines_and_progresses():
    lines = [f"line {i} " + "w " * 98 for i in range(12)]
    made = text_chunks("\n".join(lines))
    assert made[0][2:] == (1, 4) and made[1][2] == 4
    assert all(b[2] > a[2] for a, b in zip(made, made[1:])) and made[-1][3] == 12


def test_headings_and_blank():
    assert text_chunks("## Title\nbody")[0][1] == " Title"
    assert text_chunks("\n \n") == [] and text_chunks(None) == [] and text_chunks("") == []
    assert text_chunks("a\r\nb\r\n") == [("a\nb", "a", 1, 2)]


def test_code():
    rust = "fn one() {\n    1\n}\n\n/// doc\npub fn two() {\n}\n"
    made = code_chunks(rust, "rs")
    assert [m[2] for m in made] == [1, 5] and made[1][1] == "/// doc"
    assert code_chunks("fn one() {}\nfn two() {}", "rs")[1][2] == 2
    python = "import os\n\n@d\ndef f():\n    pass\n\nclass C:\n    x = 1\n"
    assert [m[2:] for m in code_chunks(python, "py")] == [(1, 1), (3, 5), (7, 8)]
    commented = "# licence\n# more\nimport os  # why é\n\ndef f():\n    pass\n    # inside\n\n# behind\nx = 'é'; y = 2\n"
    assert [m[0] for m in code_chunks(commented, "py")] == ["# licence", "# more", "import os", "# why é", "def f():\n    pass", "# behind", "x = 'é'", "y = 2"]
    assert [m[2:] for m in code_chunks(commented, "py")][-3:] == [(9, 9), (10, 10), (10, 10)]
    long = "def f():\n" + "    a = 'word word word word'\n" * 120
    assert {m[1] for m in code_chunks(long, "py")} == {"def f():"} and len(code_chunks(long, "py")) > 1
    assert {m[1] for m in code_chunks("fn f() {\n" + "    word(word, word, word);\n" * 120 + "}\n", "rs")} == {"fn f() {"}
    assert code_chunks("def broken(", "py") == text_chunks("def broken(")
    assert code_chunks("select 1", "sql") == text_chunks("select 1")


def test_chunked(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, None), (3, " "), (1, "a\nb")], "id long, text string")
    assert [(r["id"], r["seq"], r["text"]) for r in chunked(df).orderBy("id").collect()] == [(1, 0, "a\nb")] * 2


def test_segments(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 60.0), (3, None), (4, 0.0), (5, 115.0)], "id long, d double")
    got = [(r["id"], r["start_sec"], r["end_sec"]) for r in segments(df, "d", 60.0).orderBy("id", "seq").collect()]
    assert got == [(1, 0.0, 60.0), (1, 55.0, 100.0), (2, 0.0, 60.0), (5, 0.0, 60.0), (5, 55.0, 115.0)]
