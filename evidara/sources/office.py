"""Text of zipped office files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: where text processors keep their text, in the order in which the members are looked for
MEMBERS = ("word/document.xml", "content.xml")
#: Elements by local name: those whose text counts, those that stand for a space, and those that end a line.
TEXTS, SPACES, LINES = {"t", "span", "p", "h"}, {"tab", "br"}, {"p", "h"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below a folder that is a zip by its first bytes, whatever its name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").where(F.substring("content", 1, 4) == F.unhex(F.lit("504B0304")))


def document_text(content: bytes | None) -> str | None:
    """The text of the first known member, each paragraph or heading on a line; null where the bytes hold none.

    Only text that opens an element counts, as in the rules this follows; what comes after an inner element
    belongs to no run of a text processor.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as held:
            member = next((m for m in MEMBERS if m in held.namelist()), None)
            root = ElementTree.fromstring(held.read(member)) if member else None
    except (zipfile.BadZipFile, ElementTree.ParseError, RuntimeError, NotImplementedError, EOFError, OSError):
        return None
    if root is None:
        return None
    out: list[str] = []
    todo: list[ElementTree.Element | str] = [root]
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            out.append(one)
            continue
        name = one.tag.rpartition("}")[2] if isinstance(one.tag, str) else ""
        if name in SPACES:
            out.append(" ")
            continue
        if name in TEXTS:
            out.append(one.text or "")
        if name in LINES:
            todo.append("\n")
        todo += reversed(one)
    return "".join(out)


def office_texts(files: DataFrame, content: str = "content") -> DataFrame:
    """The files with ``text`` in place of ``content``; null where a file can't be read. Files go to Python in Arrow batches."""
    keep = [f for f in files.schema.fields if f.name != content]
    schema = T.StructType([*keep, T.StructField("text", T.StringType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[document_text(c) for c in batch[content]]).drop(columns=content)

    return files.mapInPandas(read, schema)
