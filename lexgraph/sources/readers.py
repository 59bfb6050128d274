"""Sources: paragraphs of .docx files, JSON corpora, rule files, unit files, caches. Schemas are given, so nothing is inferred by a scan."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgraph.functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

UNIT_SCHEMA = "id string, vi_tri struct<dieu:string,khoan:string,diem:string,so_hieu_van_ban:string>, noi_dung_chuan_hoa string, noi_dung string, noi_dung_goc string, tieu_de_dieu string, chuong string, tieu_de_chuong string, level int, hieu_luc_tu string"
RULE = "struct<rule_id:string,rule_type:string,targets:array<struct<unit_id:string>>,effective_from:string,effective_to:string,external_basis:string,source_unit:string>"


def docx_paragraphs(content: bytes) -> list[tuple[str, bool]]:
    """(text, bold) of the non-empty paragraphs of a document, tables excluded, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        text, bold = [], False
        for run in p.iter(f"{_W}r"):
            part = "".join((n.text or "") if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else "\n" if n.tag == f"{_W}br" else "" for n in run)
            mark = run.find(f"{_W}rPr/{_W}b")
            bold |= bool(part.strip()) and mark is not None and mark.get(f"{_W}val", "1") not in ("0", "false")
            text.append(part)
        if joined := "".join(text).strip():
            out.append((joined, bold))
    return out


def docx_header(content: bytes) -> list[str]:
    """The cells of the first four rows of the first three tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    cells = []
    for table in body.findall(f"{_W}tbl")[:3] if body is not None else []:
        for row in table.findall(f"{_W}tr")[:4]:
            for cell in row.findall(f"{_W}tc"):
                if text := "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in cell.iter(f"{_W}p")).strip():
                    cells.append(text)
    return cells


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: (path, ord, text, bold) of every paragraph below ``path``; a file that can't be read is one row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(name, k, t, b, None) for k, (t, b) in enumerate(docx_paragraphs(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((name, None, None, None, repr(e)))
            yield pd.DataFrame(rows, columns=["path", "ord", "text", "bold", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, ord int, text string, bold boolean, error string")


def read_docx_headers(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02, ST-39: (path, authority, header_date, error) from the first tables; a file that can't be read is one row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    cells = docx_header(content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((name, None, None, repr(e)))
                    continue
                first = [c.splitlines()[0].strip() for c in cells if c.strip()]
                authority = next((x for x in first if x in ("QUỐC HỘI", "CHÍNH PHỦ") or x.startswith(("BỘ ", "THỦ TƯỚNG CHÍNH PHỦ"))), None)
                dated = next((c for c in cells if re.search(T.DATE.removeprefix("(?iu)"), c, re.I)), None)
                rows.append((name, authority, dated, None))
            yield pd.DataFrame(rows, columns=["path", "authority", "dated", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, authority string, dated string, error string").select("path", "authority", T.date_in(F.col("dated")).alias("header_date"), "error")


def read_documents(spark: SparkSession, path: str, schema: str, glob: str = "*_structure.json", doc_filter: str | None = None) -> DataFrame:
    """SRC-03, SRC-04: one row per whole-file JSON document, with the file's name; optional substring filter on it."""
    df = spark.read.option("multiLine", True).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema(schema).json(path)
    named = df.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return named.where(F.contains("file", F.lit(doc_filter))) if doc_filter else named


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: effective rules of files that hold ``{"rules": [...]}`` or a bare list."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    both = F.coalesce(F.from_json("value", f"struct<rules:array<{RULE}>>")["rules"], F.from_json("value", f"array<{RULE}>"))
    return raw.select(F.posexplode(both).alias("rule_ord", "r")).select("rule_ord", "r.*")


def first_text(*columns: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def unit_rows(units: DataFrame) -> DataFrame:
    """SRC-10: normalised units; those without id or text go; level 4 by default."""
    text = first_text(F.col("noi_dung_chuan_hoa"), F.col("noi_dung"), F.col("noi_dung_goc"))
    shaped = units.select(F.nullif(F.trim("id"), F.lit("")).alias("id"), text.alias("text"), F.coalesce("noi_dung_goc", "noi_dung").alias("raw_text"), F.col("vi_tri.so_hieu_van_ban").alias("document_id"), "vi_tri.dieu", "vi_tri.khoan", "vi_tri.diem", "tieu_de_dieu", "chuong", "tieu_de_chuong", F.coalesce("level", F.lit(4)).alias("level"), F.col("hieu_luc_tu"))
    return shaped.where("id is not null and text is not null")


def read_units(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """SRC-09, SRC-10: unit files of one document (by name, else by a part of it, else all)."""
    def load(glob: str) -> DataFrame:
        return spark.read.option("multiLine", True).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema(UNIT_SCHEMA).json(path)

    for glob in [f"{doc_id}_semantic_units.json", f"*{doc_id}*"] if doc_id else []:
        if (found := load(glob)).inputFiles():
            return unit_rows(found)
    return unit_rows(load("*_semantic_units.json"))


def pending(units: DataFrame, done: DataFrame, key: str = "id", force: bool = False) -> DataFrame:
    """FL-16, SRC-15, SRC-16, SM-03: units that have no result yet."""
    return units if force else units.join(done.select(key).distinct(), key, "left_anti")


AMENDED_UNIT = "struct<target_unit:string,target_level:string,replacement_level:string,replacement_path:string>"
AMENDING_ACTION = f"struct<action_id:string,operation:string,raw_instruction:string,resolution_status:string,targets:array<{AMENDED_UNIT}>>"
EVENT = f"struct<source_document:string,target_document:string,items:array<struct<source_unit:string,replacement_root_level:string,actions:array<{AMENDING_ACTION}>>>>"


def read_amendments(spark: SparkSession, path: str, doc_filter: str | None = None) -> DataFrame:
    """SRC-05: the actions of every ``amendment_index.json`` below ``path``: file, event, item, action (places from 0), semantic_index, source_document, target_document, source_unit and the action's fields.

    With ``doc_filter`` an event stays if the canonical id of either document holds it; missing documents are empty. ``semantic_index`` numbers the items of the events that stay, from 1, by file name, event and item, whether or not
    they have actions; the offsets of files are sums over one row per file."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "amendment_index.json").option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("file"), "value")
    events = raw.select("file", F.posexplode(F.from_json("value", f"array<{EVENT}>")).alias("event", "e")).select("file", "event", "e.*")
    named = events.withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_document", "target_document")})
    if doc_filter:
        ids = [F.coalesce(T.document_id(F.col(c)), F.lit("")) for c in ("source_document", "target_document")]
        named = named.where(F.contains(ids[0], F.lit(doc_filter)) | F.contains(ids[1], F.lit(doc_filter)))
    items = named.select("file", "event", "source_document", "target_document", F.posexplode("items").alias("item", "i"))
    in_file = F.row_number().over(W.partitionBy("file").orderBy("event", "item"))
    sizes = items.groupBy("file").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("file").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = items.withColumn("k", in_file).join(before, F.col("file") == F.col("of")).withColumn("semantic_index", F.col("k") + F.col("before"))
    each = numbered.select("file", "event", "item", "semantic_index", "source_document", "target_document", "i.source_unit", F.posexplode_outer("i.actions").alias("action", "a"))
    return each.select("file", "event", "item", "action", "semantic_index", "source_document", "target_document", "source_unit", "a.*")
