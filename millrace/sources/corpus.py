"""Files of a folder as rows of text, without what is hidden or ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORE_FILES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file: below ``base``, paths that ``pattern`` matches are left out, or kept again."""

    base: str
    pattern: str
    keep: bool
    folders: bool


def _regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def rules_of(base: str, text: str) -> list[Rule]:
    """The rules of an ignore file that stands in ``base``, a folder's path ending in a slash or nothing."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        folders, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        body = _regex(line.lstrip("/"))
        if body:
            out.append(Rule(base, f"^{body}$" if anchored else f"^(?:.*/)?{body}$", keep, folders))
    return out


def ignored(path: str, rules: list[Rule]) -> bool:
    """Whether a path, or a folder it lies in, is left out: of the rules that match, the last counts, those of deeper
    folders after those above. What lies in a folder left out can't be kept again."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        at, folder, out = "/".join(parts[:n]), n < len(parts), False
        for r in rules:
            if at.startswith(r.base) and (folder or not r.folders) and re.match(r.pattern, at[len(r.base) :], re.S):
                out = not r.keep
        if out:
            return True
    return False


def read(spark: SparkSession, root: str, most_bytes: int | None = 1 << 20) -> DataFrame:
    """(path, content) of the files below ``root``: UTF-8 text of at most ``most_bytes`` (with None, of any size), not
    hidden and not ignored. Paths are relative, with slashes. Only the ignore files go to the driver."""
    conf = spark._jsc.hadoopConfiguration()
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    base = re.sub(r"^[a-z]+:/+", "/", fs.makeQualified(top).toString().rstrip("/")) + "/"
    # Listings of tables pass over names that begin with a full stop or an underscore.
    apart, rules_at, listed = [], [], fs.listFiles(top, True)
    while listed.hasNext():
        full = listed.next().getPath().toString()
        rel = re.sub(r"^[a-z]+:/+", "/", full)[len(base) :]
        if rel.rsplit("/", 1)[-1] in IGNORE_FILES:
            rules_at.append((rel, full))
        elif re.search(r"(?:^|/)_", rel) and not re.search(r"(?:^|/)\.", rel):
            apart.append(full)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "content")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as stores

        for b in batches:
            for full in b["path"]:
                store, at = stores.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", full))
                with store.open_input_stream(at) as f:
                    body = f.read()
                yield pd.DataFrame({"path": [full], "length": [len(body)], "content": [body]})

    if apart:
        files = files.unionByName(spark.createDataFrame([(p,) for p in apart], "path string").mapInPandas(opened, "path string, length bigint, content binary"))
    files = files.withColumn("rel_", F.expr("regexp_replace(path, '^[a-z]+:/+', '/')").substr(F.lit(len(base) + 1), F.length("path")))
    rules = []
    for rel, full in sorted(rules_at, key=lambda r: (r[0].count("/"), r[0])):
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(full))
        try:
            rules += rules_of(rel[: rel.rfind("/") + 1], spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    shown = files.where(~F.col("rel_").rlike(r"(?:^|/)\."))
    if most_bytes is not None:
        shown = shown.where(F.col("length") <= most_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, body in zip(b["rel_"], b["content"]):
                if not ignored(path, rules):
                    try:
                        rows.append((path, bytes(body).decode("utf-8")))
                    except UnicodeDecodeError:
                        continue
            yield pd.DataFrame(rows, columns=["path", "content"])

    return shown.select("rel_", "content").mapInPandas(run, "path string, content string")
