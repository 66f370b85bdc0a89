"""Readers of documents and evaluation files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil import schemas


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files, without a byte order mark."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))


def binary_files(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """relpath, content of all files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.replace("path", F.lit(root), F.lit("")).alias("relpath"), "content")


def gold(spark: SparkSession, path: str, only: str = "") -> DataFrame:
    """Gold documents, a row a page: doc_id, doc_type, page_index, page. Another schema version is an error."""
    docs = spark.read.schema(T._parse_datatype_string(schemas.GOLD_DOC.removeprefix("struct<").removesuffix(">"))).option("multiLine", True).json(path)
    version = F.when(F.col("schema_version") == 1, F.lit(1)).otherwise(F.raise_error(F.concat(F.lit("schema version of "), F.col("doc_id"))).cast("int"))
    checked = docs.withColumn("schema_version", version).where(F.contains("doc_id", F.lit(only)))
    return checked.select("doc_id", "doc_type", "schema_version", F.posexplode(F.coalesce("pages", F.array("page"))).alias("page_index", "page"))


TSV_COLUMNS = ("level", "page", "block", "par", "line", "word", "left", "top", "width", "height", "conf", "text")


def tsv_words(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words of tab-separated files, each small: file, level, page, block, par, line, left, top, width, height, conf, text, row (in the file)."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n", -1).alias("rows"))
    lines = raw.select("file", F.posexplode("rows").alias("row", "line")).where((F.col("row") > 0) & (F.col("line") != ""))
    field = F.split("line", "\t", len(TSV_COLUMNS))
    kinds = dict.fromkeys(TSV_COLUMNS, "int") | {"conf": "double", "text": "string"}
    columns = [F.try_element_at(field, F.lit(i)).try_cast(kinds[c]).alias(c) for i, c in enumerate(TSV_COLUMNS, 1) if c != "word"]
    return lines.select("file", *columns, F.col("row").cast("long").alias("row"))


def detections(raw: DataFrame, by: list[str], column: str = "json") -> DataFrame:
    """by, line_idx, txt, quad, sides, confidence from a detector's nested output: lists [box, [text, score]], bare or in a list a page; malformed ones are left out."""
    bare = F.from_json(column, "array<string>")
    # in a wrapped page the first detection's box, a list of points, lies one list deeper
    first = F.from_json(F.try_element_at(bare, F.lit(1)), "array<string>")
    inner = F.from_json(F.try_element_at(first, F.lit(1)), "array<string>")
    wrapped = F.regexp_like(F.try_element_at(inner, F.lit(1)), F.lit(r"^\s*\[\s*\["))
    rows = F.when(F.coalesce(wrapped, F.lit(False)), first).otherwise(bare)
    out = raw.select(*by, F.posexplode_outer(rows).alias("line_idx", "det")).where("det is not null")
    part = F.from_json("det", "array<string>")
    recog = F.from_json(F.try_element_at(part, F.lit(2)), "array<string>")
    points = F.from_json(F.try_element_at(part, F.lit(1)), "array<array<double>>")
    out = out.select(*by, "line_idx", F.try_element_at(recog, F.lit(1)).alias("txt"), F.try_element_at(recog, F.lit(2)).try_cast("double").alias("confidence"), F.transform(points, lambda p: F.struct(F.try_element_at(p, F.lit(1)).alias("x"), F.try_element_at(p, F.lit(2)).alias("y"))).alias("quad"))
    fine = F.col("txt").isNotNull() & F.col("confidence").isNotNull() & (F.size("quad") > 0) & F.forall("quad", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    side = lambda f, c: f(F.transform("quad", lambda p: p[c]))
    return out.where(F.coalesce(fine, F.lit(False))).withColumns({"x0": side(F.array_min, "x"), "y0": F.element_at("quad", 1)["y"], "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")})


#: Parts of a word-processor file that hold text, after the document itself in name order.
PARTS = ("header", "footer", "footnotes", "endnotes", "comments")


def docx_parts(content: bytes) -> list[tuple[str, str]]:
    """(part, text) of the parts with text; embedded objects or tracked changes are an error."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if any(n.startswith("word/embeddings/") for n in names):
            raise ValueError("embedded object")
        rest = sorted(n for n in names if re.fullmatch(rf"word/({'|'.join(PARTS)})\d*\.xml", n))
        out = []
        for name in ["word/document.xml", *rest]:
            root = ElementTree.fromstring(z.read(name))
            if root.find(f".//{w}ins") is not None or root.find(f".//{w}del") is not None:
                raise ValueError("tracked changes")
            text = "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
            if text.strip():
                out.append((name, text))
    return out


def docx_units(files: DataFrame) -> DataFrame:
    """relpath, unit, part, text, error of word-processor files (relpath, content); a file that fails is a row with the error's type."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.relpath, pdf.content):
                try:
                    rows += [(path, i, part, text, None) for i, (part, text) in enumerate(docx_parts(bytes(content)))]
                except Exception as e:  # recorded, never a success
                    rows.append((path, 0, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["relpath", "unit", "part", "text", "error"])

    return files.select("relpath", "content").mapInPandas(read, "relpath string, unit int, part string, text string, error string")


def corpus_hash(files: DataFrame) -> DataFrame:
    """One digest of the files' contents in name order; the corpus is small by its nature."""
    parts = F.array_sort(F.collect_list(F.struct("relpath", F.sha2("content", 256).alias("h"))))
    return files.agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["h"]), ""), 256).alias("corpus_hash"))
