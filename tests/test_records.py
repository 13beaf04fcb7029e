"""CSV records over several lines against the csv module, in files cut into many splits."""

import csv
import io
import random

import pytest

from pyspark.sql import functions as F

from quarrylens.queries.loading import write_lines
from quarrylens.sources.files import load, malformed_lines, sniff
from quarrylens.sources.records import Quotes, csv_records

SPLITS = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "10"}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in SPLITS}
    for k, v in SPLITS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def fields(rng):
    kinds = [["abc", "", "1.5", "x y", 'in"side'], ['q"uo"te', '""'], ["line\nbreak" + "z" * rng.randrange(300), "\n"], ['"\n\n,"', ',\n"'], ['a,b"\r\n"c']]
    return rng.choice(rng.choice(kinds))


def written(rows, end):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["a", "b", "c", "d"], *rows])
    return out.getvalue()


@pytest.mark.parametrize("seed,n,end", [(2, 1, "\n"), (3, 60, "\n"), (4, 60, "\r\n")])
def test_records_over_split_borders(small_splits, tmp_path, seed, n, end):
    rng = random.Random(seed)
    rows = [[fields(rng) for _ in range(3)] + ["k"] for _ in range(n)]
    path = tmp_path / "t.csv"
    path.write_bytes(written(rows, end).encode())
    records = csv_records(small_splits, str(path), ",")
    got = [r["text"] for r in records.orderBy("block", "record").collect()]
    assert [next(csv.reader(io.StringIO(t, newline=""))) for t in got] == [["a", "b", "c", "d"], *rows]
    assert records.count() == len(got) and records.where("NOT closed").count() == 0
    assert small_splits.read.text(str(path)).rdd.getNumPartitions() >= len(path.read_bytes()) // 400
    df = load(small_splits, str(path), "csv", schema="a string, b string, c string, d string")
    assert df.count() == len(df.collect()) == n
    assert sorted([[x or "" for x in r] for r in df.collect()]) == sorted(rows)


def test_unclosed_quotes_are_malformed(small_splits, tmp_path):
    good = "".join(f'{i},"v\n{i}"\n' for i in range(40))
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + good + '7,5" pipe\n8,"open\n9,z\n10,y\n')
    for sep in ("auto", ","):
        df = load(small_splits, str(path), "csv", sep=sep)
        assert df.count() == 41 and {r["b"] for r in df.where("a = 7").collect()} == {"v\n7", '5" pipe'}
    assert sorted(r["line"] for r in malformed_lines(small_splits, str(path)).collect()) == ["10,y", '8,"open', "9,z"]


def test_types_headers_and_encoding(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for i, name in enumerate(("x", "y")):
        (folder / f"{name}.csv").write_bytes(f'id,,when,Name,name,ok,price\n{i},1,2024-01-0{i + 1},"Mü\nller, {name}","he said ""no""",true,{i}.5\n'.encode("latin-1"))
    assert sniff(spark, str(folder)).breaks and sniff(spark, str(folder)).encoding == "ISO-8859-1"
    df = load(spark, str(folder), "csv")
    assert dict(df.dtypes) == {"id": "int", "_c1": "int", "when": "date", "Name3": "string", "name4": "string", "ok": "boolean", "price": "double"}
    assert [(r["id"], r["Name3"], r["name4"]) for r in df.orderBy("id").collect()] == [(0, "Mü\nller, x", 'he said "no"'), (1, "Mü\nller, y", 'he said "no"')]


def test_plain_files_stay_on_the_direct_path(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x, y"\n2,"he said ""no"""\n3,\n')
    assert load(spark, str(path), "csv").orderBy("a").collect()[1]["b"] == 'he said "no"'
    path.write_text('a,b\n1,"x, y"\n2,z\n')
    assert not sniff(spark, str(path)).breaks


@pytest.mark.parametrize("line,opened,stayed", [
    (b'a,"b', True, False), (b'a,"b"', False, False), (b'"a""', True, False), (b'5" p,x', False, False), (b"x", False, True),
    (b'x",3', False, False), (b'x","y', False, True), (b'"",""', False, True), (b'""""', False, True), (b'a"b,"c""d', True, True),
])
def test_state_after_a_line(line, opened, stayed):
    """Against a walk over the characters."""

    def walk(inside):
        start, i = not inside, 0
        while i < len(line):
            c = line[i : i + 1]
            if inside:
                if line[i : i + 2] == b'""':
                    i += 1
                elif c == b'"':
                    inside, start = False, False
            elif c == b",":
                start = True
            else:
                inside, start = start and c == b'"', False
            i += 1
        return inside

    quotes = Quotes(",")
    assert (quotes.opens(line), quotes.stays(line)) == (walk(False), walk(True))


@pytest.mark.parametrize("line", ["concat(id, ';x')", "concat_ws(';', id, if(id % 2 = 0, 'x', null))"])
def test_lines_are_written_by_all_tasks(spark, tmp_path, line):
    """No task writes the whole table; each file has the header, and none of them is read as a row."""
    path = str(tmp_path / "t.csv")
    write_lines(spark.range(0, 400, 1, 4).select(F.expr(line).alias("value")), path, "k;v")
    files = [p.read_text().splitlines() for p in (tmp_path / "t.csv").glob("part-*")]
    assert len(files) == 4 and all(lines[0] == "k;v" and len(lines) == 101 for lines in files)
    df = load(spark, path, "csv", sep="auto")
    assert df.columns == ["k", "v"] and sorted(r["k"] for r in df.collect()) == list(range(400))
