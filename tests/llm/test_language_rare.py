"""Language scores against a model in plain Python that leaves no count out."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from firstseen.llm import language as la


def model(fitted, text):
    words, grams = {}, {}
    for _, t, lang in fitted:
        for word in la.words_of(t):
            words.setdefault(lang, Counter())[word] += 1
            for length in range(1, la.LONGEST + 1):
                kept = [g for g in la.grams_of(word, length) if length > 1 or g not in "<>"]
                grams.setdefault((length, lang), Counter()).update(kept)
    langs = sorted(words)
    tables = {0: words} | {k: {lang: grams.get((k, lang), Counter()) for lang in langs} for k in range(1, la.LONGEST + 1)}
    kinds = {k: set().union(*by.values()) for k, by in tables.items()}
    score = lambda k, lang, x: math.log((tables[k][lang][x] + la.SMOOTHING) / (sum(tables[k][lang].values()) + la.SMOOTHING * (len(kinds[k]) + 1)))
    spoken = {lang: sum(words[lang].values()) + 1 for lang in langs}
    total = {lang: math.log(spoken[lang] / sum(spoken.values())) for lang in langs}
    for word in la.words_of(text):
        found = [(0, word)] if word in kinds[0] else []
        for k in range(la.LONGEST, 0, -1):
            found = found or [(k, g) for g in la.grams_of(word, k) if g in kinds[k]]
        for lang in langs:
            total[lang] += sum(score(k, lang, x) for k, x in found) / max(1, len(found))
    return total


def test_a_rare_language_keeps_all_its_words(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))
    hot = [word("abcdefgh") for _ in range(400)]
    rare = [word("abcdefgh") for _ in range(60)]
    fitted = [(i, " ".join(rng.choices(hot, k=40)), "en") for i in range(150)]
    fitted += [(1000 + i, " ".join(rare[i::3]), "xx") for i in range(3)]
    docs = spark.createDataFrame(fitted, "doc_id long, text string, lang string")
    texts = [" ".join(rng.sample(rare, 6)) for _ in range(20)] + [" ".join(rng.sample(hot, 6)) for _ in range(20)]
    texts += [" ".join(w + "h" for w in rng.sample(rare, 6)) for _ in range(10)] + ["zz", rare[0], " ".join(hot * 3)]
    tried = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for words in (20, 1_000_000):  # the share that is broadcast changes nothing
        out = {r.doc_id: r for r in la.predict(tried, la.fit(docs, words=words), F.col("doc_id")).collect()}
        for i, text in enumerate(texts):
            total = model(fitted, text)
            best = max(sorted(total), key=total.get)
            assert out[i].lang_pred == best
            assert abs(out[i].score - 1 / sum(math.exp(t - total[best]) for t in total.values())) < 1e-5
        assert [out[i].lang_pred for i in range(20)] == ["xx"] * 20


def test_numerals_are_no_letters(spark):
    fitted = spark.createDataFrame([(1, "ein Wort", "de"), (2, "one word", "en")], "doc_id long, text string, lang string")
    texts = ["½ ²", "Ⅷ", "12 _ ٣", "③ 一二", "x² y½", "ª"]
    tried = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in la.predict(tried, la.fit(fitted), F.col("doc_id")).collect()}
    assert [out[i] == ("und", 0.0) for i in range(len(texts))] == [True, True, True, False, False, False]
    assert la.words_of("x²y ½ Ⅷa 一") == ["x", "y", "a", "一"]
