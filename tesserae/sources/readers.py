"""Reading and writing tables; names, fingerprints and samples of rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ",;\t|"


def scan_delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV text (also compressed): the separator most frequent in the head, UTF-8 or else Latin-1."""
    head = [r.value for r in spark.read.text(path).limit(200).collect()]
    text = "\n".join(head)
    sep = max(SEPARATORS, key=text.count)
    encoding = "ISO-8859-1" if "�" in text else "UTF-8"
    return spark.read.csv(path, sep=sep, encoding=encoding, header=True, inferSchema=True)


def flatten(df: DataFrame) -> DataFrame:
    """Structs as columns named a.b."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        cols = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`").getField(g.name).alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """Records, or a payload whose first list of records is taken; nested records become a.b columns."""
    df = spark.read.json(path, multiLine=True)
    nested = next((f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)), None)
    if nested:
        df = df.select(F.inline(f"`{nested}`"))
    return flatten(df)


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return flatten(spark.read.json(path))


READERS = {"parquet": lambda s, p: s.read.parquet(p), "pq": lambda s, p: s.read.parquet(p), "orc": lambda s, p: s.read.orc(p), "jsonl": scan_jsonl, "ndjson": scan_jsonl, "json": scan_json, "csv": scan_delimited, "tsv": scan_delimited, "txt": scan_delimited}


def load(spark: SparkSession, path: str) -> DataFrame:
    """Any of the formats, by the last suffix known."""
    for part in reversed(path.lower().rstrip("/").split(".")[1:]):
        if part in READERS:
            return normalise_columns(READERS[part](spark, path))
    raise ValueError(f"no reader for {path}")


def check_select(sql: str) -> str:
    """A single reading statement, or an error."""
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", "", sql).strip().rstrip(";")
    if ";" in bare:
        raise ValueError("one statement only")
    if not re.match(r"(?i)(select|with|show|pragma|describe)\b", bare):
        raise ValueError("only reading statements are run")
    return sql.strip().rstrip(";")


def redact(url: str) -> str:
    """A connection string without its credentials."""
    url = re.sub(r"(?<=://)[^/@\s]+@", "***@", url)
    return re.sub(r"(?i)\b(password|pwd|user)=[^;&]*", r"\1=***", url)


def scan_jdbc(spark: SparkSession, url: str, sql: str, **options) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", check_select(sql)).options(**options).load()


def scan_sql(spark: SparkSession, sql: str) -> DataFrame:
    """The guarded statement over registered views."""
    return spark.sql(check_select(sql))


def normalise_columns(df: DataFrame) -> DataFrame:
    """Stripped names; blank ones become column_n, repeated ones get a number."""
    seen: dict[str, int] = {}
    names = []
    for i, c in enumerate(df.columns, 1):
        name = c.strip() or f"column_{i}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Rows, and two sums of row hashes that do not depend on order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    row = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod("h", F.lit(2**31 - 1))).alias("sum"), F.bit_xor("h").alias("mixed"))
    return row.withColumn("schema", F.lit(df.schema.simpleString())).withColumn("fingerprint", F.sha2(F.concat_ws("|", "n", "sum", "mixed", "schema"), 256)).select("n", "fingerprint")


def sample_rows(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """A sample that a row is in or not by its key alone."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def sink_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    w.csv(path, header=True) if kind == "csv" else w.parquet(path)
