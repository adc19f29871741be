"""Digests, paths, globs and templates on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from firstseen.functions import digest, globs, paths, template

INSTANT = 1_700_000_000 * 1_000_000_000  # 2023-11-14T22:13:20Z


def one(spark, column, schema="x string", value=("",)):
    return spark.createDataFrame([value], schema).select(column.alias("r")).first()["r"]


def test_digests(spark):
    hexed = digest.as_hex(digest.content_digest(F.col("x")))
    assert one(spark, hexed, value=("hello world",)) == "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    assert one(spark, hexed, value=("",)) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert one(spark, digest.content_digest(F.col("x")), value=(None,)) is None


def test_order_key_is_component_order(spark):
    rng = random.Random(7)
    alphabet = ["a", "b", "B", ".", "-", "é", " ", "a.txt", "ab"]
    made = {"/" + "/".join("".join(rng.choices(alphabet, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 4))) for _ in range(300)}
    made |= {"/a", "/a/b", "/a.txt", "/a/B"}
    frame = spark.createDataFrame([(p,) for p in made], "p string")
    ordered = [r["p"] for r in frame.orderBy(paths.order_key(F.col("p"))).collect()]
    assert ordered == sorted(made, key=lambda p: [c.encode() for c in p.split("/")])
    back = frame.select("p", paths.path_of_key(paths.order_key(F.col("p"))).alias("q")).collect()
    assert all(r["p"] == r["q"] for r in back)


@pytest.mark.parametrize(
    "path,root,expected",
    [
        ("/source/sub/file.txt", "/source", "sub/file.txt"),
        ("/other/file.txt", "/source", None),
        ("/sourcefile", "/source", None),
        ("/source/f", "/source/f", "f"),
        ("/a/b", "/", "a/b"),
    ],
)
def test_relative_path(spark, path, root, expected):
    assert one(spark, paths.relative_path(F.col("x"), root), value=(path,)) == expected
    raw = one(spark, paths.relative_bytes(F.col("x").cast("binary"), root.encode()), value=(path,))
    assert raw == (None if expected is None else bytearray(expected.encode()))


def test_display_of_invalid_utf8(spark):
    raw = bytearray(b"/s/bad\xff")
    assert one(spark, paths.display(F.col("x")), "x binary", (raw,)) == "/s/bad�"


FILES = [
    "file1.txt", "file2.LOG", "subdir/file3.TXT", "subdir/deep/file4.txt", ".hidden.txt", ".dir/in.txt",
    "subdir/.git/config", "a[1].txt", "src1/x.py", "src10/y.py", "été.txt", "new\nline.txt",
]


@pytest.mark.parametrize(
    "patterns,hidden,expected",
    [
        (["*.txt"], False, lambda f: f.lower().endswith(".txt")),
        (["/*.txt"], False, lambda f: "/" not in f and f.lower().endswith(".txt")),
        (["subdir/*"], False, lambda f: f.lower() in ("subdir/file3.txt",)),
        (["subdir/**"], False, lambda f: f.startswith("subdir/")),
        (["**/deep/*"], False, lambda f: f == "subdir/deep/file4.txt"),
        (["!*.txt"], False, lambda f: not f.lower().endswith(".txt")),
        (["!subdir"], False, lambda f: not f.startswith("subdir/")),
        (["!subdir/"], False, lambda f: not f.startswith("subdir/")),
        (["*.txt", "!subdir/"], False, lambda f: f.lower().endswith(".txt") and not f.startswith("subdir/")),
        (["!*.txt", "file1.txt"], False, lambda f: f == "file1.txt"),
        (["src?/*"], False, lambda f: f == "src1/x.py"),
        (["*.{log,py}"], False, lambda f: f.lower().endswith((".log", ".py"))),
        (["file[0-2].*"], False, lambda f: f in ("file1.txt", "file2.LOG")),
        (["file[!1].*"], False, lambda f: f.rsplit("/")[-1].lower().startswith("file") and "file1" not in f),
        (["a\\[1\\].txt"], False, lambda f: f == "a[1].txt"),
        (["éT?.TXT"], False, lambda f: f == "été.txt"),
        (["ÉTÉ.*"], False, lambda f: False),
        (["# a comment", ""], False, lambda f: True),
        ([], True, lambda f: not any(c.startswith(".") for c in f.split("/"))),
        # An include glob keeps a hidden file, but not below a pruned directory.
        (["*.txt"], True, lambda f: f.lower().endswith(".txt") and not f.startswith(".dir/")),
        (["*"], True, lambda f: True),
        (["!*.py"], True, lambda f: not f.endswith(".py") and not any(c.startswith(".") for c in f.split("/"))),
    ],
)
def test_globs(spark, patterns, hidden, expected):
    frame = spark.createDataFrame([(f,) for f in FILES], "rel string")
    kept = {r["rel"] for r in frame.filter(globs.keeps_file(F.col("rel"), patterns, hidden)).collect()}
    assert kept == {f for f in FILES if expected(f)}


def test_bad_glob_is_raised_on_the_driver():
    for pattern in ("[abc", "{a,b", "a\\"):
        with pytest.raises(ValueError):
            globs.parse_globs([pattern])


def test_listing_prunes_the_same_directories():
    pruned = globs.dir_pruner(globs.parse_globs(["!target/", "*.txt"]), ignore_hidden=True)
    assert pruned("a/target") and pruned("a/.git") and not pruned("a/b")
    assert not globs.dir_pruner(globs.parse_globs(["*"]), True)(".git")
    assert globs.dir_pruner(globs.parse_globs(["!É*"]), False)("É1")
    assert not globs.dir_pruner(globs.parse_globs(["!É*"]), False)("é1")


@pytest.mark.parametrize(
    "text,expected",
    [
        ("path/to/file.txt", "path/to/file.txt"),
        ("path/{year_utc}/file.txt", "path/2023/file.txt"),
        ("path/{year_utc}/{year_utc}/file.txt", "path/2023/2023/file.txt"),
        ("path/{year_utc}/{month_utc}/{day_utc}/file.txt", "path/2023/11/14/file.txt"),
        ("{year_local}-{month_local}-{day_local}", "2023-11-15"),
        ("{unknown}/{YEAR_UTC}/{{day_utc}}", "{unknown}/{YEAR_UTC}/{14}"),
        ("", ""),
    ],
)
def test_templates(spark, text, expected):
    assert one(spark, template.render(text, F.col("x"), "Asia/Tokyo"), "x bigint", (INSTANT,)) == expected


def test_no_padding_and_bad_times(spark):
    january = 1_704_412_800 * 1_000_000_000  # 2024-01-05
    text = "{year_utc}/{month_utc}/{day_utc}"
    assert one(spark, template.render(text, F.col("x"), "UTC"), "x bigint", (january,)) == "2024/1/5"
    assert one(spark, template.render(text, F.col("x"), "UTC"), "x bigint", (-1,)) is None
    assert one(spark, template.render(text, F.col("x"), "UTC"), "x bigint", (None,)) is None
    assert one(spark, template.render("plain", F.col("x"), "UTC"), "x bigint", (-1,)) == "plain"
    last = (1 << 63) - 1
    assert one(spark, template.render(text, F.col("x"), "UTC"), "x bigint", (last,)) == "2262/4/11"


def test_dates_do_not_depend_on_the_session_zone(spark):
    column = template.render("{day_utc} {day_local}", F.col("x"), "Asia/Tokyo")
    seen = set()
    for zone in ("UTC", "America/Los_Angeles", "Pacific/Auckland"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            seen.add(one(spark, column, "x bigint", (INSTANT,)))
            seen.add(one(spark, template.render("14 {day_local}", F.lit(3600 * 10**9), "America/New_York")))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seen == {"14 15", "14 31"}


def test_destination(spark):
    rel = paths.relative_path(F.lit("/source/sub/file.txt"), "/source")
    for text, expected in (("dest", "dest/sub/file.txt"), ("dest/", "dest/sub/file.txt"), ("dest/{year_utc}", "dest/2023/sub/file.txt")):
        assert one(spark, template.destination(text, F.lit(INSTANT), rel, "UTC")) == expected
    outside = paths.relative_path(F.lit("/other/file.txt"), "/source")
    assert one(spark, template.destination("dest", F.lit(INSTANT), outside, "UTC")) is None
