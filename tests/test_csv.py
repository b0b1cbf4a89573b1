"""CSV files as users have them: late delimiters, quoted line breaks, encodings, headers in another order."""

import pytest
from pyspark.sql import functions as F

from plumbline.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_delimiter_by_the_whole_file(spark, tmp_path):
    """Sixty lines of remarks with commas come before the table that makes up the file."""
    text = "".join(f"remark, number, {i}\n" for i in range(60)) + "".join(f"{i};{i * 2};x, y\n" for i in range(500))
    (tmp_path / "a.csv").write_text(text)
    assert readers.sniff_csv(spark, f"{tmp_path}/a.csv") == {"sep": ";", "encoding": "UTF-8"}


@pytest.mark.parametrize("block", [64, 1000, 10_000_000])
def test_quoted_line_breaks_over_blocks(spark, tmp_path, block):
    """Quoted fields hold delimiters and line breaks; blocks of the file begin inside and outside of quotes."""
    body = "id|note|n\n" + "".join(f'{i}|"a;b;c;d\nline; two "" quoted;;\n\nend"|{i}\n' if i % 3 else f"{i}|plain|{i}\n" for i in range(200))
    (tmp_path / "q.csv").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        assert readers.sniff_csv(spark, f"{tmp_path}/q.csv") == {"sep": "|", "encoding": "UTF-8", "multiLine": True}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    df = readers.read_any_csv(spark, f"{tmp_path}/q.csv")
    assert df.count() == 200 and df.where("id = n").count() == 200
    assert df.where("id = 1").first()["note"] == 'a;b;c;d\nline; two " quoted;;\n\nend'


@pytest.mark.parametrize(("encoding", "said", "word"), [("utf-8", "UTF-8", "café €"), ("cp1252", "windows-1252", "café €"), ("latin-1", "ISO-8859-1", "caf\xe9 \x81"), ("ascii", "UTF-8", "cafe")])
def test_encodings(spark, tmp_path, encoding, said, word):
    path = tmp_path / "e.csv"
    path.write_bytes(("id,word\n" + "".join(f"{i},plain\n" for i in range(300)) + f"999,{word}\n").encode(encoding))
    assert readers.sniff_csv(spark, str(path))["encoding"] == said
    assert readers.read_any_csv(spark, str(path)).where("id = 999").first()["word"] == word


def test_one_column_and_empty_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("word\n" + "x\n" * 20)
    (tmp_path / "none.csv").write_text("")
    assert readers.sniff_csv(spark, f"{tmp_path}/one.csv")["sep"] == "," and readers.sniff_csv(spark, f"{tmp_path}/none.csv")["sep"] == ","
    assert readers.read_any_csv(spark, f"{tmp_path}/one.csv").count() == 20


def test_csv_text_in_a_column(spark):
    texts = [(1, 'id,word\r\n1,"two\nlines, ""quoted"""\r\n2,plain\n'), (2, "word,id\nfirst,7\n\nsecond,8"), (3, "a,b\n5,x"), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "k int, body string")
    got = rows(readers.rows_of_csv_text(df, "body", "id int, word string").drop("position"))
    assert got == [(1, 1, 'two\nlines, "quoted"'), (1, 2, "plain"), (2, 7, "first"), (2, 8, "second"), (3, 5, "x")]
    bare = readers.rows_of_csv_text(df.where("k = 3"), "body", "a string, b string", header=False)
    assert rows(bare.select("position", "a", "b")) == [(0, "a", "b"), (1, "5", "x")]


def test_sniffing_reads_the_file_once(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\n1,2\n")
    assert readers.read_any_csv(spark, f"{tmp_path}/s.csv").select(F.sum("b")).first()[0] == 2
