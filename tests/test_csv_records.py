import csv
import io
import random

import pytest

from tillsight.sources import csv_records as cr

HARD = b'''Order Date,Sales,"notes, long",notes,Sales
2024-01-05,10.5,"two
lines, and ""quotes""",x,1
2024-01-06,,plain,N/A,2\r
"2024-01-07",7,"",5" pipe,"a
b
c"
2024-01-08,8
2024-01-09,9,a,b,c,too wide

2024-01-10,10,"end ""q""",,"last

one"
'''


@pytest.fixture
def tiny_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    yield lambda size: [spark.conf.set(k, str(size) if k.endswith("PartitionBytes") else "1") for k in keys]
    for k, v in before.items():
        spark.conf.set(k, v)


def reference(data, encoding="utf-8"):
    """Records of Python's csv module, without empty lines."""
    text = data.decode(encoding).replace("\r\n", "\n")
    return [r for r in csv.reader(io.StringIO(text, newline="\n")) if r]


@pytest.mark.parametrize("size", [3, 7, 16, 50, 100_000])
def test_any_split_gives_the_same_records(spark, tmp_path, tiny_splits, size):
    tiny_splits(size)
    (tmp_path / "a.csv").write_bytes(HARD)
    (tmp_path / "b.csv").write_bytes(b"x,y\n1,\"open\nend")
    (tmp_path / "c.csv").write_bytes('é,b\n"ü\nö",1\n'.encode("iso-8859-1") * 3)
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")]
    rows = cr.csv_records(spark, paths).collect()
    for path, want in zip(paths, (reference(HARD), [["x", "y"], ["1", "open\nend"]], reference((tmp_path / "c.csv").read_bytes(), "iso-8859-1"))):
        mine = sorted((r for r in rows if r.path.endswith(path)), key=lambda r: (r.start, r.pos))
        assert [r.fields for r in mine] == want
        assert [r.head for r in mine] == [i == 0 for i in range(len(mine))]
    if size <= 50:
        assert cr.split_functions(cr.lines(spark, paths)).count() > 3  # the file was split


def test_random_files(spark, tmp_path, tiny_splits):
    rng = random.Random(4)
    tiny_splits(11)
    for k in range(6):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator="\n")
        for _ in range(30):
            writer.writerow(["".join(rng.choices('ab",\n', k=rng.randrange(6))) for _ in range(3)])
        (tmp_path / f"{k}.csv").write_text(out.getvalue())
    rows = cr.csv_records(spark, [str(tmp_path)]).collect()
    for k in range(6):
        mine = [r.fields for r in sorted((r for r in rows if r.path.endswith(f"/{k}.csv")), key=lambda r: (r.start, r.pos))]
        assert mine == reference((tmp_path / f"{k}.csv").read_bytes())


def test_line_functions():
    assert cr.ends_inside(b'a,"b', False) and not cr.ends_inside(b'a,"b"', False) and not cr.ends_inside(b'a,b"', False)
    assert cr.ends_inside(b'"a""', False) and not cr.ends_inside(b'"a"""', False) and not cr.ends_inside(b'5" pipe,x', False)
    assert not cr.ends_inside(b'b",c', True) and cr.ends_inside(b'b","c', True) and cr.ends_inside(b"plain", True)


def test_all_columns_and_rejects(spark, tmp_path, tiny_splits):
    tiny_splits(20)
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + HARD)
    records, rejected, files = cr.scan_csv(spark, [str(tmp_path)])
    assert files.first().labels == ["Order Date", "Sales", "notes, long", "notes", "Sales.1"]
    assert [r.fields[-1] for r in rejected.collect()] == ["too wide"]
    rows = sorted(cr.sales_columns(records, files).collect(), key=lambda r: r.order_date)
    assert [(r.order_date, r.net_revenue) for r in rows] == [("2024-01-05", "10.5"), ("2024-01-06", None), ("2024-01-07", "7"), ("2024-01-08", "8"), ("2024-01-10", "10")]
    assert rows[0].other == {"notes, long": 'two\nlines, and "quotes"', "notes": "x", "Sales.1": "1"}
    assert rows[2].other == {"notes, long": None, "notes": '5" pipe', "Sales.1": "a\nb\nc"}
    assert rows[3].other == {"notes, long": None, "notes": None, "Sales.1": None}
    nulls = {r.column: (r.n_rows, r.n_null) for r in cr.column_nulls(records).collect()}
    assert nulls == {"Order Date": (5, 0), "Sales": (5, 1), "notes, long": (5, 2), "notes": (5, 3), "Sales.1": (5, 1)}
    first = cr.first_records(records.repartition(7), 2).orderBy("n").collect()
    assert [r.fields[0] for r in first] == ["2024-01-05", "2024-01-06"]


def test_nothing_to_read(spark, tmp_path):
    records, rejected, files = cr.scan_csv(spark, [])
    assert records.count() == rejected.count() == files.count() == 0
    (tmp_path / "a.csv").write_bytes(b"a,b\n")
    records, rejected, files = cr.scan_csv(spark, [str(tmp_path)])
    assert records.count() == 0 and files.count() == 1


def test_equal_files(spark, tmp_path, tiny_splits):
    from tillsight.sources.csv_files import duplicate_files

    tiny_splits(8)
    for name, data in {"a": b"one\ntwo\nthree\n", "b": b"one\ntwo\nthree\n", "c": b"one\ntwo\nthrew\n", "d": b"one\ntwo\nthree3", "e": b"", "f": b"",
                       "g": b"two\none\nthree\n", "h": b"single", "i": b"\xff\xfe\n\n", "j": b"\xff\xfe\n\n", "k": b"\xff\xfd\n\n"}.items():
        (tmp_path / name).write_bytes(data)
    rows = duplicate_files(spark, str(tmp_path)).collect()
    groups = {}
    for r in rows:
        assert r.copies == 2
        groups.setdefault(r.md5, set()).add(r.path[-1])
    assert sorted(map(sorted, groups.values())) == [["a", "b"], ["e", "f"], ["i", "j"]]
