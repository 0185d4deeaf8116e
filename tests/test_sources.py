"""Readers and writers on tiny files in a scratch folder."""

import csv
import os
import random
import tempfile

import duckdb
from pyspark.sql import functions as F

from runlake.functions.delimited import delimiter_of, split_cells

from runlake.sources import readers as R
from runlake.sources import writers as W
from runlake.streaming import streams as ST


def _write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_read_fasta_records(spark):
    d = tempfile.mkdtemp(prefix="runlake-fa-")
    _write(d, "a.fasta", ">abc\nABC\n>empty\n>abc123\nABC\nCCC\n")
    recs = sorted((r["rec_no"], r["header"], r["seq"]) for r in R.read_fasta(spark, d).collect())
    assert recs == [(1, "abc", "ABC"), (2, "abc123", "ABCCCC")]


def test_read_delimited_index_and_numbers(spark):
    d = tempfile.mkdtemp(prefix="runlake-tsv-")
    _write(d, "m.tsv", "gene\ts1\ts2\ng1\t1.5\t0\ng2\tx\t4\n")
    df = R.read_delimited(spark, d, sep="\t")
    rows = {r["gene"]: (r["s1"], r["s2"]) for r in df.collect()}
    assert rows == {"g1": (1.5, 0.0), "g2": (None, 4.0)}


def test_read_sniffed_dialects(spark):
    d = tempfile.mkdtemp(prefix="runlake-sniff-")
    _write(d, "c/a.csv", "h1,h2,h3\n1,2,3\n4,5,6\n")
    _write(d, "t/b.txt", "h1\th2\n1\t2\n3\t4\n")
    got = {(os.path.basename(r["path"]), r["delimiter"]) for r in R.read_sniffed(spark, d + "/*/*").collect()}
    assert got == {("a.csv", ","), ("b.txt", "\t")}


def _csv_rows(path, sep):
    with open(path, newline="") as fh:
        return list(csv.reader(fh, delimiter=sep))


def test_records_over_split_files(spark):
    """Blocks of a few bytes: line breaks, quotes and delimiters inside cells, quotes that are none, an open quote at the end."""
    d = tempfile.mkdtemp(prefix="runlake-rec-")
    rng = random.Random(4)
    cell = lambda: rng.choice(["a", "", "b c", "x,y", "two\nlines", 'say ""hi""', "\n", 'end ""', "\t", '5"'])

    def written(x):
        return x if x == '5"' or rng.random() < 0.3 and not set(x) & set(',\n"\t') else f'"{x}"' if x != '5"' else x

    for k in range(4):
        body = "\n".join(",".join(written(cell()) for _ in range(3)) for _ in range(120))
        _write(d, f"f{k}.csv", body + ('\n"open, to\nthe end' if k == 1 else "\n" if k == 2 else ""))
    _write(d, "crlf.csv", 'a,b\r\n"c\nd",e\r\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        got = {}
        blocks = R._file_lines(spark, d).select("path", "_block").distinct().count()
        for r in R.read_records(spark, d).collect():
            got.setdefault(os.path.basename(r["path"]), {})[r["row_no"]] = r["cells"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 60
    for name in os.listdir(d):
        if name.endswith(".csv"):
            want = _csv_rows(os.path.join(d, name), ",")
            assert [got[name][k + 1] for k in range(len(want))] == want and len(got[name]) == len(want), name


def test_records_equal_duckdb(spark):
    d = tempfile.mkdtemp(prefix="runlake-rec-")
    path = _write(d, "t.csv", '1,"x\ny",2\n3,"a ""b"", c",4\n5,,"6,\n,6"\n')
    want = duckdb.connect().execute(f"SELECT * FROM read_csv('{path}', header=false, all_varchar=true, auto_detect=false, "
                                    "columns={'a': 'VARCHAR', 'b': 'VARCHAR', 'c': 'VARCHAR'}, delim=',', quote='\"')").fetchall()
    got = [tuple(r["cells"]) for r in R.read_records(spark, d).orderBy("row_no").collect()]
    assert got == [tuple(x or "" for x in w) for w in want] and got[0] == ("1", "x\ny", "2")


def test_cells_equal_the_csv_module(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(['"', "a", ",", "b", '""', " "]) for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_cells(F.col("t"), ",").alias("c"))
    assert all(r["c"] == next(csv.reader([r["t"]])) for r in df.collect())


def test_delimiter_choice(spark):
    cases = [("a,b\n1,2\n", ","), ("a\tb,c\n1\t2\n3\t4\n", "\t"), ("plain text\nwithout any\n", None), ("", None), (None, None),
             ("a,b,c\td\n1,2,3\t4\n", ","), ('"x\ty",1\n"z\tw\tv",2\n', ","), ("a,b\nno\nc\nd,e\n", None),
             ("one,line only", ","), ('"open, quote\tto the end', None), ("a,b\r\n\r\n1,2\r\n", ","),
             ("h,i\n" * 18 + "x\n" * 2, ","), ("h,i\n" * 17 + "x\n" * 3, None), ("a,b\n" * 5000 + "c,d,e", ",")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select(
        "k", delimiter_of(F.substring("t", 1, 16384), F.length("t") <= 16384).alias("d"))
    assert {r["k"]: r["d"] for r in df.collect()} == {k: d for k, (_, d) in enumerate(cases)}


def test_read_fasta_keeps_text_before_the_first_header(spark):
    d = tempfile.mkdtemp(prefix="runlake-fa-")
    _write(d, "a.fasta", "ACGT\nTT\n>h1\nGG\n")
    recs = sorted((r["rec_no"], r["header"], r["seq"]) for r in R.read_fasta(spark, d).collect())
    assert recs == [(1, "", "ACGTTT"), (2, "h1", "GG")]


def test_scan_inventory_and_scripts(spark):
    d = tempfile.mkdtemp(prefix="runlake-scan-")
    _write(d, "x/run.py", "print(1)\n")
    _write(d, "x/__init__.py", "")
    _write(d, "x/notes.txt", "hello")
    inv = {r["path"]: (r["size_bytes"], r["checksum"]) for r in R.scan_inventory(spark, d).collect()}
    assert inv["x/notes.txt"] == (5, "aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d")
    scripts = [os.path.basename(r["path"]) for r in R.scan_scripts(spark, d).collect()]
    assert scripts == ["run.py"]


def test_read_params_json_and_form(spark):
    df = spark.createDataFrame([('{"a": "1"}', "application/json"), ("a=1&b=x+y&a=2", "multipart/form-data")],
                               "body string, ctype string")
    got = [r["m"] for r in df.select(R.read_params(F.col("body"), F.col("ctype")).alias("m")).collect()]
    assert got == [{"a": "1"}, {"a": "2", "b": "x y"}]


def test_prefill_from_url(spark):
    pages = spark.createDataFrame([(1, "http://h/p?page=2&ref=x&ref=y&other=1&page=3")], "page_id long, url string")
    spec = spark.createDataFrame([("page", False), ("ref", True)], "name string, multiple boolean")
    got = {r["name"]: r["values"] for r in R.prefill(pages, spec).collect()}
    assert got == {"page": ["3"], "ref": ["x", "y"]}


def test_write_tsv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="runlake-w-") + "/out"
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, name string")
    R.write_tsv(df, d)
    back = spark.read.option("sep", "\t").option("header", True).csv(d)
    assert sorted((int(r["id"]), r["name"]) for r in back.collect()) == [(1, "a b"), (2, "c")]


def test_quoted_cells(spark):
    df = spark.createDataFrame([('1,"x,y"',), ('"a ""b""",,c',), ("p,q",), ("",), (None,)], "v string")
    got = [r["c"] for r in df.select(R.split_cells(F.col("v"), ",").alias("c")).collect()]
    assert got == [["1", "x,y"], ['a "b"', "", "c"], ["p", "q"], [""], None]


def test_store_only_adds(spark):
    root = tempfile.mkdtemp(prefix="runlake-store-") + "/store"
    first = spark.createDataFrame([(1, "aabb", "a.txt", b"one"), (2, "aabb", "b.txt", b"one")],
                                  "file_id long, checksum string, filename string, content binary")
    W.write_addressed(first, root)
    more = spark.createDataFrame([(3, "aabb", "c.txt", b"one"), (4, "ccdd", "d.txt", b"two")], first.schema)
    W.write_addressed(more, root)
    kept = sorted((r["checksum"], bytes(r["content"])) for r in spark.read.parquet(root).collect())
    assert kept == [("aabb", b"one"), ("ccdd", b"two")]


def test_stream_goes_on_where_it_stopped(spark):
    d = tempfile.mkdtemp(prefix="runlake-stream-")
    spark.range(3).write.parquet(d + "/in/1")

    def run():
        s = spark.readStream.schema("id long").option("recursiveFileLookup", True).parquet(d + "/in")
        return sorted(r["id"] for r in ST.run_stream(s, "restart", "append", location=d + "/state").collect())

    assert run() == [0, 1, 2]
    assert run() == [0, 1, 2]
    spark.range(3, 5).write.parquet(d + "/in/2")
    assert run() == [0, 1, 2, 3, 4]
