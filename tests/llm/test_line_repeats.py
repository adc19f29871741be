"""Lines that recur by themselves, and lines that only look as if they did."""

from firstseen.llm import line_templates as lt


def dropped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.dropped for r in lt.dropped_lines(docs).collect()}
    return [found[i] for i in range(len(texts))]


def test_passages_recur_in_two_documents(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    plain, numbered = " ".join(words), " ".join([*reversed(words), "of", "1999"])
    copied = " ".join(words[::2] + words[1::2])
    texts = [f"{plain}\nfirst", f"second\n{plain}", numbered, f"{numbered}\nfourth", numbered.replace("1999", "2001"), copied, copied]
    texts += [" ".join(words[:40]), " ".join(words[:40]) + "\nanother text"]
    assert dropped(spark, texts) == [[0], [1], [0], [0], [], [], [], [], []]


def test_short_lines_recur(spark):
    texts = [f"All rights reserved.\n\n  \nPage {i}\nShare" if i < 9 else "All rights reserved.\n\n  " for i in range(12)]
    assert dropped(spark, texts) == [[0]] * 12


def test_a_template_needs_ten_documents(spark):
    line = "put the item {} into the big box near wall"
    listing = "\n".join(line.format(c * 3) for c in "abcdefghijkl")
    others = [f"own words of document {c}" for c in "abc"]
    assert dropped(spark, [listing, *others]) == [[], [], [], []]
    spread = [line.format(c * 4) for c in "abcdefghi"]
    assert dropped(spark, [listing, *spread]) == [list(range(12)), *[[0]] * 9]


def test_rows_of_numbers_differ(spark):
    table = [" ".join(str(i * 7 + j) for j in range(6)) for i in range(12)]
    assert dropped(spark, [f"{row}\n1 2 3 4 5 6 7" for row in table]) == [[1]] * 12
    assert dropped(spark, [f"version {i} of the very same long footer line" for i in range(12)]) == [[0]] * 12
