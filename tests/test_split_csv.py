"""CSV read by splits: every cut of small files against the plain reader, on dirty bytes and odd quotes."""

import csv
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from attrilens.plans.queries import ORACLE_SQL, QUERIES
from attrilens.sources import split_csv


def plain(data: bytes):
    """The reference way: drop NUL bytes, decode with replacement, read as one text (a last line end ends no record's text)."""
    data = data.removesuffix(b"\n").removesuffix(b"\r")
    return [r for r in csv.reader(io.StringIO(data.replace(b"\0", b"").decode("utf-8", errors="replace"), newline="")) if r]


def write(folder, data, name="a.csv"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder)


ODD = [
    b'id,text\n1,"two\nlines"\n2,plain\n',
    b'id,text\n1,ab"c\n2,"x ""y"" z"\n3,"a\n\nb"\n4,"",\n\n5\n6,a,b,c\n',
    b'id,text\n1,"a"b,"c\nd"e"\n2,x\n',
    b'"id","text"\r\n1,"a\r\nb"\r\n2,c\r\n',
    b'id,text\n1,"never closed\n2,x\n3,y\n',
    b'id,te\0xt\n1,"n\0ul\n\0in"\n2,\xc3\0\xa9 \xff\xfe "q"\n3,"\xe2\x82\n\xac"\n',
    b'id,text\n1,"' + b"x" * 300 + b"\n" * 50 + b'"\n2,"",""\n3,""""\n',
    b"id,text",
]


@pytest.mark.parametrize("k", range(len(ODD)))
@pytest.mark.parametrize("split", [7, 40, None])
def test_odd_files(spark, tmp_path, k, split):
    path = write(tmp_path / "f", ODD[k])
    found = split_csv.records(spark, path, split)
    assert [r["fields"] for r in found.orderBy("path", "block", "no").collect()] == plain(ODD[k])


@pytest.mark.parametrize("seed", range(4))
def test_random_files(spark, tmp_path, seed):
    rng = random.Random(seed)
    pieces = [b'"', b'""', b",", b"\n", b"a", b"bc ", b"\0", b"\xff", b"\xc3\xa9", b"\r\n", b'",', b',"', b'"\n']
    files = {f"{n}.csv": b"id,text\n" + b"".join(rng.choices(pieces, k=400)) for n in "ab"}
    for name, data in files.items():
        path = write(tmp_path / "f", data, name)
    found = split_csv.records(spark, path, 60)
    assert found.rdd.getNumPartitions() > 10
    got = {}
    for r in found.orderBy("path", "block", "no").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["fields"])
    assert got == {name: plain(data) for name, data in files.items()}


def test_named_columns(spark, tmp_path):
    path = write(tmp_path / "f", b'id,text,more\n1,"a\nb",\n2\n3,"x, ""y""",z,extra\n')
    assert [tuple(r) for r in split_csv.read(spark, path, 8).orderBy("id").collect()] == [("1", "a\nb", None), ("2", None, None), ("3", 'x, "y"', "z")]
    write(tmp_path / "f", b"id,other\n1,2\n", "b.csv")
    with pytest.raises(ValueError, match="different headers"):
        split_csv.read(spark, path)
    with pytest.raises(ValueError, match="no header"):
        split_csv.read(spark, write(tmp_path / "g", b""))


def test_same_rows_whatever_the_splits(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = docs.select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted).alias("value"))
    spark.createDataFrame([("doc_id,text",)], "value string").union(lines).coalesce(1).write.text(str(tmp_path / "t"))
    got = {r["doc_id"]: r["text"] for r in split_csv.read(spark, str(tmp_path / "t"), 20_000).collect()}
    assert got == {str(r["doc_id"]): r["text"] or None for r in docs.collect()}


def test_tasks_do_not_grow_with_splits(spark, tmp_path):
    """Hundreds of small splits are read by a few tasks, whole and in order, also where quotes are open at the end after a carriage return."""
    data = b"id,text\n" + b"".join(b'%d,"a ""b""\n\xff, c%s"\n' % (k, b"\n" * (k % 9)) for k in range(400)) + b'x,"open\r\ny\r\n'
    found = split_csv.records(spark, write(tmp_path / "f", data), 20)
    assert [r["fields"] for r in found.orderBy("path", "block", "no").collect()] == plain(data)
    assert found.rdd.getNumPartitions() <= 5 * spark.sparkContext.defaultParallelism


def test_rows_with_blanks_equal_sql(spark, tmp_path):
    """Null and empty texts, null languages and ones with commas and quotes."""
    rows = [(1, "en", ""), (2, "en", None), (3, None, "a\nb"), (4, 'e,"n', 'x"'), (5, "en", "plain\r"), (7, "de", None), (14, None, "")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["split_csv_rows"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    sql = ORACLE_SQL["split_csv_rows"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == duckdb.connect().execute(f"{sql} ORDER BY doc_id").fetchall()
