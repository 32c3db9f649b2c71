import random

from tillsight.llm import licences


def test_whole_texts_lines_and_spellings(spark):
    mit = next(t for n, t in licences.KNOWN if len(t) > 500 and n == "MIT")
    wrapped = "MIT-style file\n".replace("MIT-style file\n", "Copyright (c) 2020 Someone\n\n") + mit.lower().replace(". ", ".\n  ").replace(",", " ,")
    rows = [(1, wrapped, "x"), (2, wrapped + " more", "x"), (3, "some words\nReleased under the MIT licence\nlicensed under CC BY-NC 4.0!", "x"),
            (4, None, "x"), (5, "", "x"), (6, "(c) 2001 A\nLicensed under the Apache License, Version 2.0", "x"), (7, "Licensed under the Mozilla Public Licence, v2.0", "x"),
            (None, "Licensed under CC BY 4.0", "x"), (3, "Licensed under CC BY 4.0 Licensed under CC BY 4.0", "x"), (8, "a" * 200_000, "x"),
            (5, "", "x")]
    out = {(r.doc_id, r.licences, r.text_licence, r.n_notices) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, licence string")).collect()}
    assert out == {(1, "MIT", "MIT", 0), (2, "", None, 0), (3, "CC-BY-NC-4.0,MIT", None, 2), (4, "", None, 0), (5, "", None, 0), (6, "Apache-2.0", "Apache-2.0", 1),
                   (7, "MPL-2.0", "MPL-2.0", 1), (None, "CC-BY-4.0", "CC-BY-4.0", 1), (3, "", None, 0), (8, "", None, 0)}
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_known_text_finds_itself(spark):
    rng = random.Random(2)
    rows = [(i, "".join(c.upper() if rng.random() < .5 else c for c in t).replace(" ", "  ")) for i, (_, t) in enumerate(licences.KNOWN)]
    out = {r.doc_id: r.text_licence for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i] for i in range(len(rows))] == [n for n, _ in licences.KNOWN]


def test_usual_files_titles_and_paragraphs(spark):
    text = {n: t for n, t in licences.KNOWN if len(t) > 400}
    cut = lambda t, *at: "\n\n".join(p.strip() for p in _parts(t, at))
    mit = cut(text["MIT"], "The above", "THE SOFTWARE IS").replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")
    isc = cut(text["ISC"], "THE SOFTWARE IS").replace("above copyright", "above\ncopyright")
    rows = [(1, "ISC License\n\nCopyright (c) 2004-2010 by X (\"X\")\nCopyright Jane Doe\nAll rights reserved.\n\n" + isc), (2, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit + "\n"),
            (3, "A readme.\n\nLicence\n\n" + mit + "\n\nThanks."), (4, "A readme.\n\n" + isc + "\nThanks."),
            (5, "MIT License\n\nno more than a title"), (6, "a\n\nThis Source Code Form is subject to the terms of\nthe Mozilla Public License, v. 2.0.\n\nb")]
    out = {r.doc_id: (r.licences, r.text_licence, r.n_notices) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ("ISC", "ISC", 0), 2: ("MIT", "MIT", 0), 3: ("MIT", None, 0), 4: ("", None, 0), 5: ("", None, 0), 6: ("MPL-2.0", None, 0)}


def _parts(text, at):
    for x in at:
        head, text = text[:text.index(x)], text[text.index(x):]
        yield head
    yield text


def test_no_python_in_the_plan(spark):
    plan = licences.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_follows_the_same_rules(spark):
    import duckdb

    text = {n: t for n, t in licences.KNOWN if len(t) > 400}
    mit = text["MIT"].replace("The above", "\n\nThe above").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit), (2, "A readme.\n\nLicence\n\n" + mit + "\n\nThanks."), (3, None), (3, ""), (3, "\n"), (4, "\n\n\n"),
            (5, "Released under the MIT License."), (5, "Released under the MIT License."), (5, "released under the MIT licence"), (None, "(c) the list\n(c) 2001 A\n© B\nAll rights reserved."),
            (6, "a\n\nThis Source Code Form is subject to the terms of\nthe Mozilla Public License, v. 2.0.\n\nb"), (7, "Copyright notice stays\ncopyright 2020 goes\nall rights reserved by A"),
            (8, "ISC License\n" + text["ISC"].replace("above copyright", "above\ncopyright")), (9, "Licensed under CC BY 4.0.\n" * 3000), (10, "mit"), (11, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ours = [tuple(r) for r in licences.scan(df).collect()]
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    theirs = con.execute(licences.oracle()).fetchall()
    order = lambda rows: sorted(rows, key=str)
    assert order(ours) == order(theirs)
    assert len(ours) == 14 and {r[3] for r in ours if r[0] == 5} == {1} and [r[3] for r in ours if r[0] == 9] == [3000]
