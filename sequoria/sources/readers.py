"""Readers and writers of the file formats: FASTA, labelled CSV, structure text, workbooks and nested documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The nested measurement document, one a record.
DETAIL = """id bigint, dbaaspId string, sequence string, url string,
  intrachainBonds array<struct<position1:int, position2:int, type:struct<name:string>, cycleType:struct<name:string>, chainParticipating:struct<name:string>>>,
  articles array<struct<pubmed:struct<pubmedId:string>>>,
  targetActivities array<struct<id:bigint, activityMeasureGroup:struct<name:string>, activityMeasureValue:string, concentration:string, unit:struct<name:string>, activity:double, targetSpecies:struct<name:string>, medium:struct<name:string>, ph:string, ionicStrength:string>>"""


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_id, sequence) of FASTA files. Wrapped lines are joined, blank ones skipped; the id is the first
    token of the header. A file is split between tasks at records, so text before a file's first header cannot be told
    from a record here; `headerless` names such files, and `labelled_fasta` refuses them.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    raw = raw.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    # a record that follows the separator has lost its '>'; only the first of a file can still have it
    value = F.regexp_replace("value", r"^\s*>", "")
    head = F.trim(F.regexp_extract(value, r"^[^\r\n]*", 0))
    body = F.regexp_replace(F.regexp_replace(value, r"^[^\r\n]*", ""), r"\s+", "")
    return raw.filter(F.trim(F.regexp_replace("value", r"\s+", "")) != "").select("file", F.regexp_extract(head, r"^\S*", 0).alias("record_id"), body.alias("sequence"))


def headerless(spark: SparkSession, path: str) -> DataFrame:
    """Files whose text starts without a header, to be refused before `fasta` reads them as records."""
    starts = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_name").alias("file"), (F.regexp_replace("value", "^﻿", "").rlike(r"^\s*>") | (F.trim("value") == "")).alias("ok"))
    return starts.groupBy("file").agg(F.bool_or("ok").alias("ok")).filter("not ok").select("file")


def label_of_file(name: Column) -> Column:
    """0 for non_amp, 1 for _amp_; any other file name is an error."""
    low = F.lower(name)
    return F.when(low.contains("non_amp"), 0).when(low.contains("_amp_"), 1).otherwise(F.raise_error(F.concat(F.lit("cannot derive a label from file name "), name)).cast("int"))


def split_of_file(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("_test_"), "test").when(low.contains("_train_"), "train").otherwise("unspecified")


def labelled_fasta(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A folder of FASTA files whose names hold label and split. A file with text before its first header is an error."""
    if bad := headerless(spark, path).first():
        raise ValueError(f"sequence before FASTA header in {bad.file}")
    rows, file = fasta(spark, path), F.col("file")
    return rows.select("sequence", label_of_file(file).alias("label"), F.lit(source).alias("source"), file.alias("source_dataset"), F.col("record_id").alias("source_record_id"), split_of_file(file).alias("original_split"))


def labelled_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A folder of CSV files with the columns '' (record id), aa_seq and AMP (true or false; else an error)."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path).withColumn("file", F.col("_metadata.file_name"))
    raw = F.lower(F.trim(F.coalesce("AMP", F.lit(""))))
    label = F.when(raw == "true", 1).when(raw == "false", 0).otherwise(F.raise_error(F.concat(F.lit("unexpected label "), raw)).cast("int"))
    record = F.coalesce(F.trim("_c0"), F.lit("")) if "_c0" in rows.columns else F.lit("")
    return rows.select(F.coalesce(F.trim("aa_seq"), F.lit("")).alias("sequence"), label.alias("label"), F.lit(source).alias("source"), F.col("file").alias("source_dataset"), record.alias("source_record_id"), F.lit("unspecified").alias("original_split"))


def atoms(spark: SparkSession, path: str) -> DataFrame:
    """(file, atom, residue, x, y, z) of the fixed-width structure files; of repeated atoms the last line wins."""
    part = lambda at, n: F.trim(F.substring("value", at, n))
    # whole files, so that lines have a place; a structure is some hundred kilobytes
    lines = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    rows = lines.filter(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    place = {"x": 31, "y": 39, "z": 47}
    rows = rows.select("file", "line", part(13, 4).alias("atom"), part(23, 4).cast("int").alias("residue"), *[part(at, 8).cast("double").alias(c) for c, at in place.items()])
    last = rows.groupBy("file", "atom", "residue").agg(F.max_by(F.struct("x", "y", "z"), "line").alias("p"))
    return last.select("file", "atom", "residue", "p.*")


def bond_lengths(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (file, atom_a, residue_a, atom_b, residue_b) with their distance; null where an atom is missing."""
    end = lambda k: found.select("file", F.col("atom").alias(f"atom_{k}"), F.col("residue").alias(f"residue_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in "xyz"])
    out = pairs.join(end("a"), ["file", "atom_a", "residue_a"], "left").join(end("b"), ["file", "atom_b", "residue_b"], "left")
    square = sum((F.pow(F.col(f"{c}_a") - F.col(f"{c}_b"), F.lit(2.0)) for c in "xyz"), F.lit(0.0))
    return out.withColumn("distance", F.sqrt(square)).select(*pairs.columns, "distance")


def details(spark: SparkSession, path: str) -> DataFrame:
    """Nested measurement documents, one a file or line, in a fixed schema."""
    return spark.read.schema(DETAIL).option("multiLine", True).json(path)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(raw: bytes) -> list[list[str | None]]:
    """The first sheet of a workbook as rows of text, with nulls for empty cells."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        out = []
        for row in ElementTree.fromstring(book.read(first)).iter(f"{_MAIN}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{_MAIN}c"):
                at = 0
                for letter in re.sub(r"\d", "", cell.get("r", "")):
                    at = at * 26 + ord(letter) - 64
                while at and len(cells) < at - 1:
                    cells.append(None)
                if cell.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")))
                else:
                    got = cell.findtext(f"{_MAIN}v")
                    cells.append(shared[int(got)] if got is not None and cell.get("t") == "s" else got)
            out.append(cells)
    return out


def _workbooks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "line", "cells"]
    for batch in batches:
        for file, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = sheet_rows(raw)
            head = ["CPID" if i == 0 and x is None else x or f"unused_{i}" for i, x in enumerate(rows[0])] if rows else []
            made = [list(zip(head, [*r, *[None] * len(head)], strict=False)) for r in rows[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(made)), pa.array(range(len(made)), pa.int64()), pa.array(made, pa.map_(pa.string(), pa.string()))], names=names)


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, cells) of the first sheet of each workbook; a first header that is empty is CPID, others unused_<i>."""
    raw = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return raw.mapInArrow(_workbooks, "file string, line long, cells map<string,string>")


def write_fasta(rows: DataFrame, path: str) -> None:
    """rows (record_id, sequence) as FASTA text with LF endings, part files in parallel."""
    rows.select(F.concat(F.lit(">"), F.col("record_id").cast("string"), F.lit("\n"), F.col("sequence")).alias("value")).write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """rows as CSV with a header, columns in alphabetical order, nulls as empty fields."""
    rows.select(*sorted(rows.columns)).write.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)
