import re

from tillsight.llm import quality_rules

SYMBOLS = set("#*$%&|<>")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_against_plain_python(spark):
    texts = [None, "", " \t\n", "a", "a b c", "a b c a b c", "x x x x x", "the end \n\n the end \n the end\r\n- b\n- b", "é中🙂 # * a|b <p> $5 50%",
             "word " * 60, "the quick brown fox of it and " * 3 + " ".join("word%d" % i for i in range(90)), " nbsp x", "a\x0bb\x0cc\x1cd"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, None, 0)], "doc_id long, text string, n_words int")
    out = quality_rules.quality_rules(df).orderBy("doc_id").collect()[1:]
    for t, r in zip(texts, out, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_rules_judge_clean_and_junk(spark):
    clean = "the house of " + " ".join("word%s" % chr(97 + i % 26) * (1 + i // 26) for i in range(70))
    rows = [(1, clean), (2, clean.replace(" ", "### ")), (3, clean.upper()), (4, "\n".join([clean[:60]] * 8)), (5, clean.replace("the", "x").replace("of", "x"))]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert not out[2].ok_symbols and not out[3].ok_capitals and not out[5].ok_stop_words


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality_rules.quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
