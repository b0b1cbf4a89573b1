"""Tables from files and from columns that hold CSV or JSON text."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.selection import smallest_rows

DELIMITERS = [",", ";", "\t", "|"]
DELIMITER_BYTES = [d.encode() for d in DELIMITERS]
UNDEFINED = [bytes([x]) for x in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]  # in windows-1252
HIGH = re.compile(rb"[\x80-\x9f]")
BROKEN = "\ufdd0"  # stands for a line break inside quotes; no character of any text


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.option("header", True).options(**options)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def sniff_csv(spark: SparkSession, path: str) -> dict[str, str | bool]:
    """{sep, encoding[, multiLine]} of a CSV file, by the evidence of all its bytes, read once.

    Quotes: a line starts inside a quoted field if the quotes before it are odd in number. Each block of the file says what its lines hold for both
    cases, and the parity of the blocks before it tells which holds. Delimiter: the one whose number per record, outside
    quotes, is the same in most records; ties go to the higher number, then to the order of DELIMITERS. Encoding: UTF-8 where all bytes
    are; else windows-1252 where bytes from 0x80 to 0x9F occur, all of which it defines, and ISO-8859-1 otherwise, which is the same for all other
    bytes. multiLine is there, and true, where a quoted field holds a line break.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    seen = lines.mapInArrow(_block_evidence, "file string, block long, start int, odd int, what string, number long, n long")
    blocks = seen.where("what = 'odd'").select("file", "block", "odd").distinct()
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("start"))
    counts = {(r["what"], r["number"]): r["n"] for r in seen.join(F.broadcast(starts), ["file", "block", "start"]).groupBy("what", "number").agg(F.sum("n").alias("n")).collect()}  # a row for each field count

    records = max(1, sum(n for (what, _), n in counts.items() if what == DELIMITERS[0]))
    best, fit = DELIMITERS[0], (0.0, 0)
    for d in DELIMITERS:
        number, n = max(((number, n) for (what, number), n in counts.items() if what == d and number > 0), key=lambda x: (x[1], x[0]), default=(0, 0))
        if (n / records, number) > fit:
            best, fit = d, (n / records, number)
    sure = lambda what: counts.get((what, 0), 0) > 0
    encoding = "UTF-8" if not sure("not utf-8") else "windows-1252" if sure("high") and not sure("not 1252") else "ISO-8859-1"
    return {"sep": best, "encoding": encoding} | ({"multiLine": True} if sure("open") else {})


def _block_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a file and each way it may start (outside or inside quotes): fields per record by delimiter, and what its bytes are."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("start", pa.int32()), ("odd", pa.int32()), ("what", pa.string()), ("number", pa.int64()), ("n", pa.int64())])
    blocks: dict[tuple, _Block] = {}
    for b in batches:
        for file, block, line in zip(*[c.to_pylist() for c in b.columns], strict=True):
            blocks.setdefault((file, block), _Block()).add(line)
    rows = []
    for (file, block), held in blocks.items():
        for start in (0, 1):
            facts = {("odd", 0): 1, **held.bytes_seen, **held.counts[start]}
            rows += [(file, block, start, held.odd, what, number, n) for (what, number), n in facts.items()]
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Block:
    """Counts over the lines of one block, for both ways it may start."""

    def __init__(self):
        self.odd = 0
        self.bytes_seen: dict[tuple, int] = {}
        self.counts: list[Counter] = [Counter(), Counter()]
        self.fields = [[0] * len(DELIMITERS), None]  # of the record at hand; none: it began in an earlier block and is left out

    def add(self, line: bytes) -> None:
        if not line.isascii():
            try:
                line.decode("utf-8")
            except UnicodeDecodeError:
                self.bytes_seen["not utf-8", 0] = 1
            if HIGH.search(line):
                self.bytes_seen["high", 0] = 1
                if any(x in line for x in UNDEFINED):
                    self.bytes_seen["not 1252", 0] = 1
        parts = line.split(b'"')
        flips = (len(parts) - 1) % 2
        for start in (0, 1):
            inside = start ^ self.odd  # at the start of the line
            fields = self.fields[start]
            if fields is None and not inside:
                fields = [0] * len(DELIMITERS)
            if fields is not None:
                outside = parts[inside::2]
                fields = [f + sum(p.count(d) for p in outside) for f, d in zip(fields, DELIMITER_BYTES, strict=True)]
            if inside ^ flips:
                self.counts[start]["open", 0] += 1
            else:
                if fields is not None and (any(fields) or line.strip()):
                    for d, f in zip(DELIMITERS, fields, strict=True):
                        self.counts[start][d, f] += 1
                fields = [0] * len(DELIMITERS)
            self.fields[start] = fields
        self.odd ^= flips


def read_any_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV of unknown delimiter, encoding and line breaks; quotes are doubled inside quoted fields."""
    found = sniff_csv(spark, path)
    if found["encoding"] != "windows-1252":
        return read_csv(spark, path, schema, escape='"', **found)
    # Spark reads no windows-1252; it differs from ISO-8859-1 in the signs that stand for 0x80 to 0x9F only
    high = [bytes([x]) for x in range(0x80, 0xA0) if bytes([x]) not in UNDEFINED]
    latin, signs = (b"".join(high).decode(x) for x in ("latin-1", "cp1252"))
    df = read_csv(spark, path, schema, escape='"', **found | {"encoding": "ISO-8859-1"})
    cells = [F.translate(F.col(f"`{f.name}`"), latin, signs) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(*[v.alias(f.name.translate(str.maketrans(latin, signs))) for v, f in zip(cells, df.schema, strict=True)])


def is_json_document(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file is one document over many lines: its first line that is not blank is no JSON value by itself."""
    line = spark.read.text(path).where(F.trim("value") != "").first()
    try:
        return line is not None and json.loads(line["value"]) is None
    except ValueError:
        return True


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, document: bool | None = None) -> DataFrame:
    """JSON lines, or with ``document`` files that are one JSON document each; by default the file shows which it is."""
    whole = is_json_document(spark, path) if document is None else document
    reader = spark.read.option("multiLine", whole)
    return reader.schema(schema).json(path) if schema is not None else reader.json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By file suffix: csv, json, parquet."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_any_csv(spark, path)
    if suffix == "json":
        return read_json(spark, path)
    if suffix == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"unsupported file type '{suffix}': csv, json or parquet expected")


def rows_of_json_columns(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """Payloads {column: [values...]} unfolded to rows; other columns of ``df`` are kept.

    ``schema`` gives the type of one row: field name and element type.
    """
    arrays = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema.fields])
    parsed = df.withColumn("_p", F.from_json(payload, arrays))
    zipped = F.arrays_zip(*[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields])
    others = [x for x in df.columns if x != payload]
    rows = parsed.select(*others, F.posexplode(zipped).alias("position", "_r"))
    return rows.select(*others, "position", *[F.col("_r").getField(f.name).alias(f.name) for f in schema.fields])


def rows_of_csv_text(df: DataFrame, payload: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """Payloads of CSV text unfolded to rows by ``schema`` (DDL); other columns of ``df`` are kept. Line breaks inside quotes belong to their field.

    With a ``header`` the first line names the fields, in any order, if it names all of the schema's; otherwise fields go by their place.
    """
    others = [x for x in df.columns if x != payload]
    names = [f.name for f in T.StructType.fromDDL(schema)]
    pieces = F.transform(F.split(F.col(payload), '"'), lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"\r?\n", BROKEN)).otherwise(p))  # every other piece is quoted
    text = F.when(F.contains(F.col(payload), F.lit('"')), F.array_join(pieces, '"')).otherwise(F.col(payload))
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    rows = df.select(*others, lines.alias("_lines"))
    options = {"sep": sep, "escape": '"'}
    if not header:
        cells = rows.select(*others, F.posexplode("_lines").alias("position", "_line"))
        return cells.select(*others, "position", F.from_csv(F.replace("_line", F.lit(BROKEN), F.lit("\n")), schema, options).alias("_r")).select(*others, "position", "_r.*")
    by_place = ", ".join(f"_c{i} string" for i in range(len(names)))
    heads = F.from_csv(F.get("_lines", F.lit(0)), F.lit(by_place), options)
    said = F.array(*[F.trim(heads.getField(f"_c{i}")) for i in range(len(names))])
    cells = rows.withColumn("_said", said).select(*others, "_said", F.posexplode("_lines").alias("position", "_line")).where("position > 0")
    line = F.replace("_line", F.lit(BROKEN), F.lit("\n"))
    plain = cells.select(*others, "position", "_said", F.from_csv(line, schema, options).alias("_r"), F.from_csv(line, F.lit(by_place), options).alias("_t"))
    texts = F.array(*[F.col(f"_t._c{i}") for i in range(len(names))])
    place = lambda n: F.array_position("_said", n).cast("int")
    reordered = (F.size(F.array_intersect(F.col("_said"), F.array(*[F.lit(n) for n in names]))) == len(names)) & ~F.coalesce(F.array_join("_said", ",") == ",".join(names), F.lit(False))
    picked = [F.when(reordered, F.element_at(texts, F.greatest(place(f.name), F.lit(1))).try_cast(f.dataType)).otherwise(F.col("_r").getField(f.name)).alias(f.name) for f in T.StructType.fromDDL(schema)]
    return plain.select(*others, "position", *picked)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule rows from a catalogue file {"rules": [...]}; ``params`` and ``kind`` are optional."""
    fields = "id string, text string, type string, severity string, category string, active boolean, kind string, params map<string,string>"
    schema = T.StructType([T.StructField("rules", T.ArrayType(T.StructType.fromDDL(fields)))])
    rows = read_json(spark, path, schema).select(F.explode("rules").alias("r")).select("r.*")
    return rows.select(
        F.col("id").alias("rule_id"), "text", F.coalesce("type", F.lit("constraint")).alias("rule_type"),
        F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("category", F.lit("general")).alias("category"),
        F.coalesce("active", F.lit(True)).alias("active"), "kind", "params",
    )


class EmptyTable(ValueError):
    pass


class TooManyRows(ValueError):
    pass


def check_size(df: DataFrame, max_rows: int = 0) -> DataFrame:
    """Refuses empty tables and, where ``max_rows`` is set, larger ones; reads no more than it must."""
    if df.isEmpty():
        raise EmptyTable("the table has no rows")
    if max_rows and df.limit(max_rows + 1).count() > max_rows:
        raise TooManyRows(f"the table has more than {max_rows} rows")
    return df


def first_rows(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in key order: a row cap that always keeps the same rows."""
    return smallest_rows(df, key, n)


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all): those with the smallest MD5 of seed and key, the same rows on every run and in any engine."""
    words = [F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")) for x in key]
    return smallest_rows(df, [F.md5(F.concat_ws("|", F.lit(str(seed)), *words).cast("binary")), *key], n)
