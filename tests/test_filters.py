from pyspark.sql import functions as F

from trawl.operators.filters import Exclusions, excluded_by_root, in_scope, owning_root, sensitive


def matched(spark, rules, paths, root=None):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    e = Exclusions(rules)
    return [r[0] for r in df.where(e.matches(F.col("path"), F.lit(root) if root else None)).collect()]


def test_components_and_names(spark):
    paths = ["C:/r/node_modules/x", "C:/r/a/Node_Modules", "C:/r/node_modules2/x", "C:/r/x/.git/objects/1", "C:/r/x.git/objects/1"]
    assert matched(spark, ["node_modules", ".git/objects"], paths, "C:/r") == [paths[0], paths[1], paths[3]]


def test_component_rules_look_below_the_root_only(spark):
    assert matched(spark, ["build"], ["C:/build/r/a.txt", "C:/build/r/build/a.txt"], "C:\\build\\r") == ["C:/build/r/build/a.txt"]


def test_globs(spark):
    paths = ["r/pkg.egg-info/a", "r/app-backup-20240131-1200/x", "r/backup-20240131-9", "r/backup-2024-9", "r/ab/c/d.tmp"]
    rules = ["*.egg-info", "*-backup-20[0-9][0-9][01][0-9][0-3][0-9]-[0-9]*", "backup-20[0-9][0-9][01][0-9][0-3][0-9]-[0-9]*"]
    assert matched(spark, rules, paths) == paths[:3]
    assert matched(spark, ["r/*.tmp"], paths) == [paths[4]]  # a relative star passes over /
    assert matched(spark, ["**/c/**"], paths) == [paths[4]]


def test_absolute(spark):
    paths = ["C:/One/a", "C:/OneMore/a", "//srv/share/x", "C:/[x]/a", "C:/tmp/a/b", "C:/tmp/b"]
    assert matched(spark, ["C:\\One", "\\\\?\\UNC\\srv\\share", "C:/[x]"], paths) == [paths[0], paths[2], paths[3]]
    assert matched(spark, ["C:/tmp/a*"], paths) == [paths[4]]  # an absolute star doesn't


def test_nulls_and_no_rules(spark):
    assert matched(spark, [], ["a"]) == [] and matched(spark, ["", " "], ["a", None]) == []
    assert matched(spark, ["a"], [None]) == []


def test_by_root(spark):
    roots = spark.createDataFrame([(1, "C:\\r", '["x"]'), (2, "D:\\s", "broken"), (3, "E:", None)], "id long, path string, exclusions string")
    files = spark.createDataFrame([(1, 1, "C:\\r\\x\\1"), (2, 2, "D:\\s\\x\\1"), (3, None, None)], "id long, root_id long, path string")
    assert [r["excluded"] for r in excluded_by_root(files, roots).orderBy("id").collect()] == [True, False, False]


def test_sensitive(spark):
    names = [".env", ".env.local", "id_rsa", "a.PEM", "Login Data", "env", "key", ".key"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.where(sensitive(F.col("n"))).collect()] == names[:5]


def test_scope(spark):
    df = spark.createDataFrame([("C:\\a\\b",), ("C:\\a\\b\\c",), ("C:\\ab\\c",), ("C:\\a",)], "path string")
    assert [r[0] for r in df.where(in_scope(F.col("path"), "C:\\a")).collect()] == ["C:\\a\\b", "C:\\a\\b\\c"]
    assert [r[0] for r in df.where(in_scope(F.col("path"), "C:\\a\\", recursive=False)).collect()] == ["C:\\a\\b"]


def test_owner_is_the_longest_root(spark):
    roots = spark.createDataFrame([(1, "C:\\a"), (2, "C:\\a\\b")], "id long, path string")
    paths = spark.createDataFrame([("C:\\a\\b\\x",), ("C:\\a\\x",), ("C:\\abc",), (None,)], "path string")
    got = {r["path"]: r["owner"] for r in owning_root(paths, roots).collect()}
    assert got == {"C:\\a\\b\\x": 2, "C:\\a\\x": 1, "C:\\abc": None, None: None}
