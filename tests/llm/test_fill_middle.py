import hashlib
import re

from pyspark.sql import functions as F

from tillsight.llm import fill_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = [int(x, 16) for x in re.findall("........", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest())[:4]]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


TEXTS = [None, "", " ", "a", " a b ", "é 中\x85🙂\tz\n\n", "x\x0b\x1cy \x0c", "say <S> here", "<P", "< P> <S <M", "a b c d e f g h", "\n\n\n", "w " * 5000, "one" * 4000, " " * 3000 + "end"]


def test_against_plain_python(spark):
    rows = [(i, t, "lang", 7) for i, t in enumerate(TEXTS * 6)] + [(None, "no id at all here", "x", 1), (3, "a", "again", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    got = sorted((tuple(r) for r in fim.fill_in_middle(df).collect()), key=repr)
    assert got == sorted(((i, *brute(i, t)) for i, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    for r in fim.digests(fim.fill_in_middle(df)).where("doc_id is not null").collect():
        assert r.restored_sha256 == hashlib.sha256((dict((i, t) for i, t, *_ in rows)[r.doc_id] or "").encode()).hexdigest()


def test_every_cut_can_be_undone():
    for text in ("a b", "<", "S> <", "<S <P <M", "é\n 中"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                for form in ("psm", "spm"):
                    assert fim.restore(fim.arrange(text, form, a, b), form) == text


def test_long_texts_in_sections():
    for text in TEXTS[1:] + ["ab  cd\n" * 3000 + "  "]:
        ends = [m.end() for m in UNIT.finditer(text)]
        for section in (1, 2, 3, 17, 1000):
            assert fim.unit_ends(text, section) == ends


def test_rates(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text"))
    forms = {r.form: r["count"] for r in fim.fill_in_middle(df, rate=100, spm_rate=0).groupBy("form").count().collect()}
    assert forms == {"psm": 2000}
    forms = {r.form: r["count"] for r in fim.fill_in_middle(df).groupBy("form").count().collect()}
    assert 900 < forms["plain"] < 1100 and forms["spm"] > 3 * forms["psm"]
