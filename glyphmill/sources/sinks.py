"""Sinks: delimited reports, text files, tables, recoded copies."""

from __future__ import annotations

import csv
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.vocabulary import descending
from glyphmill.sources.files import decoded

FORMAT = {"sep": "|", "quote": "#", "escape": "#", "emptyValue": ""}


def slug(name: str, most: int = 40) -> str:
    """A file name from a conclusion's first characters; unlike with a suffix swap nothing after a full stop is lost."""
    return re.sub(r"[^\w.-]+", "_", name[:most]).strip("_") or "report"


def write_csv(df: DataFrame, folder: str) -> None:
    """A folder of parts, `|` between fields, `#` around those that need it, doubled within; UTF-8."""
    df.write.mode("overwrite").options(**FORMAT, header=True).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.options(**FORMAT, header=True).schema(schema).csv(folder)


def write_table(df: DataFrame, folder: str, header: tuple[str, ...] = ()) -> None:
    """write_csv with another header, which must have a name for each column. A table without rows is no error."""
    if header and len(header) != len(df.columns):
        raise ValueError(f"{len(header)} names for {len(df.columns)} columns")
    write_csv(df.toDF(*header) if header else df, folder)


WORDS_HEADER, GRAMS_HEADER = ("Слова", "Количество вхождений в корпус"), ("N-граммы", "Количество вхождений в корпус")


def export_counts(counts: DataFrame, folder: str, header: tuple[str, str] = WORDS_HEADER) -> None:
    """K03, and with GRAMS_HEADER K04: (token, cnt) as CSV, the most frequent first; parts are in order by name."""
    write_table(descending(counts.select("token", "cnt")), folder, header)


def write_report(df: DataFrame, path: str, banner: str | None = None, charset: str = "cp1251") -> int:
    """One local file in the order of df, for people; with a banner row of filler first if wanted.

    The rows pass through the driver one partition at a time, never at once.
    Signs the charset lacks become `?`. Returns the rows written; none is no error.
    """
    header = df.columns
    if not header:
        raise ValueError("a report needs a column")
    n = 0
    with open(path, "w", encoding=charset, errors="replace", newline="") as f:
        out = csv.writer(f, delimiter="|", quotechar="#", quoting=csv.QUOTE_MINIMAL)
        if banner is not None:
            out.writerow([banner, *["na"] * (len(header) - 1)])
        out.writerow(header)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def append_text(df: DataFrame, column: str, folder: str) -> None:
    """A line for each value, as text, behind what the folder holds."""
    df.select(F.col(column).cast("string").alias("value")).filter("value is not null").write.mode("append").text(folder)


def save_list(df: DataFrame, column: str, folder: str) -> None:
    """As append_text, but in place of what is there."""
    df.select(F.col(column).cast("string").alias("value")).filter("value is not null").write.mode("overwrite").text(folder)


def save_table(df: DataFrame, folder: str) -> DataFrame:
    """Any stage's rows as a table; returns it as read back."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def table_to_text(spark: SparkSession, table: str, column: str, folder: str) -> None:
    """From one place to another, never onto itself."""
    if table.rstrip("/") == folder.rstrip("/"):
        raise ValueError("the text would replace the table it is read from")
    save_list(spark.read.parquet(table), column, folder)


def recode(spark: SparkSession, folder: str, to: str, old: str = "koi8_r", new: str = "cp1251") -> None:
    """(path, content) of all files in another charset, as a table; the files themselves stay as they are."""

    @F.pandas_udf("binary")
    def encoded(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else x.encode(new, "replace"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files.select("path", encoded(decoded(F.col("content"), old)).alias("content")).write.mode("overwrite").parquet(to)


ROOT_STAGE = "MainRoot"


def stage_paths(root: str, stages: list[str]) -> dict[str, str]:
    """A folder for each stage; writers make them."""
    return {s: str(Path(root) / s) for s in stages}


def make_stage_folders(paths: dict[str, str], below: str = "") -> list[str]:
    """Makes local folders of all stages but the root, or a folder of that name below each; returns them sorted."""
    made = sorted(Path(p) / below for s, p in paths.items() if s != ROOT_STAGE)
    for p in made:
        p.mkdir(parents=True, exist_ok=True)
    return [str(p) for p in made]


def act_folders(root: str, files: list[str]) -> list[str]:
    """A folder below root for each file, named as the file without its last suffix."""
    return [str(Path(root) / Path(f).stem) for f in files]


def numbered_paths(folder: str, n: int, suffix: str = ".txt") -> list[str]:
    """N file names in a folder, counted from 0."""
    return [str(Path(folder) / f"{k}{suffix}") for k in range(n)]
