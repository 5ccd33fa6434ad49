"""The tables of a folder: found by name, told by content, opened when a query names them."""

from __future__ import annotations

import os
import re
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.engine import dialect
from millrace.engine.page import Page, fnv, page, profile, type_name
from millrace.engine.sql import Refused, configure
from millrace.sources import books, delimited, inline, jsons, names

MAX_FILES, MAX_LEVELS = 10_000, 16


def safe_join(root: str, name: str) -> Path:
    """The file ``name`` below ``root``; absolute names, steps out and links out are refused."""
    base = Path(root).resolve()
    if os.path.isabs(name) or ".." in Path(name).parts:
        raise Refused(f"{name} is outside the folder")
    full = (base / name).resolve()
    if full != base and base not in full.parents:
        raise Refused(f"{name} leads outside the folder")
    return full


def format_of(path: Path) -> str | None:
    """parquet, xlsx, ods, json or csv by content first, None for what can't be read."""
    with open(path, "rb") as f:
        head = f.read(65_536)
        f.seek(0, 2)
        size = f.tell()
        f.seek(max(0, size - 4))
        tail = f.read(4)
    if head[:4] == b"PAR1" and tail == b"PAR1" and size >= 12:
        return "parquet"
    if head[:6] == b"ARROW1" and tail[-2:] == b"W1":
        return None
    if head[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(path) as z:
                inside = z.namelist()
                if "xl/workbook.xml" in inside:
                    return "xlsx"
                if "mimetype" in inside and b"opendocument.spreadsheet" in z.read("mimetype"):
                    return "ods"
        except zipfile.BadZipFile:
            pass
        return None
    if head[:2] not in (b"\xff\xfe", b"\xfe\xff") and b"\0" in head:
        return None
    ext = path.suffix.lower()
    if ext in (".json", ".ndjson", ".jsonl"):
        return "json"
    if ext in (".csv", ".tsv", ".txt"):
        return "csv"
    first = head.decode("utf-8-sig", "replace").lstrip()[:1]
    return "json" if first in "[{" and first else "csv" if first else None


@dataclass
class Spec:
    name: str
    source: str
    format: str
    sheet: str | None = None
    rows: list | None = None
    columns: list | None = None


@dataclass
class Catalog:
    spark: SparkSession
    root: str | None = None
    specs: dict[str, Spec] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    opened: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def discover(cls, spark: SparkSession, root: str) -> Catalog:
        """All readable files below a folder, in order of name; hidden files and links out are passed over with a note."""
        configure(spark)
        out, base, found = cls(spark, root), Path(root).resolve(), []
        for at, dirs, files in os.walk(base):
            level = len(Path(at).relative_to(base).parts)
            dirs[:] = sorted(d for d in dirs if not d.startswith(".")) if level < MAX_LEVELS else []
            for f in sorted(files):
                path = Path(at) / f
                if f.startswith("."):
                    continue
                if base not in path.resolve().parents:
                    out.notes.append(f"{path.relative_to(base)} leads outside the folder")
                    continue
                found.append(path)
                if len(found) > MAX_FILES:
                    raise Refused(f"the folder has more than {MAX_FILES} files")
        wanted = []
        for path in sorted(found, key=lambda p: str(p.relative_to(base))):
            kind = format_of(path)
            rel = str(path.relative_to(base))
            if kind is None:
                out.notes.append(f"{rel} is in no format that can be read")
            elif kind in ("xlsx", "ods"):
                sheets = books.sheets(str(path))
                wanted += [Spec(names.table_name(rel) if len(sheets) == 1 else names.table_name(f"{path.stem}_{s}"), rel, kind, s) for s in sheets]
            else:
                wanted.append(Spec(names.table_name(rel), rel, kind))
        for spec, name in zip(wanted, names.distinct([s.name for s in wanted])):
            spec.name = name
            out.specs[name] = spec
        return out

    def add(self, name: str, rows: list, columns: list | None = None) -> None:
        """An inline table."""
        name = names.distinct([*self.specs, names.table_name(name)])[-1]
        self.specs[name] = Spec(name, "inline", "inline", rows=rows, columns=columns)

    def open(self, name: str) -> DataFrame:
        if name not in self.specs:
            raise Refused(f"there is no table {name}")
        if name not in self.opened:
            s = self.specs[name]
            if s.format == "inline":
                df, warned = inline.table(self.spark, s.rows, s.columns)
                self.notes += warned
            else:
                path = str(safe_join(self.root, s.source))
                df = {"parquet": lambda: self.spark.read.parquet(path), "csv": lambda: delimited.read(self.spark, path), "json": lambda: jsons.read(self.spark, path)}.get(
                    s.format, lambda: books.read(self.spark, path, s.sheet)
                )()
            df.createOrReplaceTempView(f"`{name}`")
            self.opened[name] = df
        return self.opened[name]

    def open_named(self, sql: str) -> list[str]:
        """Opens the tables a query names, no others."""
        words = {t.text.strip('"`').replace('""', '"') for t in dialect.tokens(sql) if t.kind == "name"}
        used = [n for n in self.specs if n in words]
        for n in used:
            self.open(n)
        return used

    def fingerprint(self, used: list[str]) -> str:
        """Of the data behind some tables: size and parts of every file, or the rows sent."""
        out = []
        for n in used:
            s = self.specs[n]
            if s.format == "inline":
                out.append(f"{n}:{fnv(repr((s.rows, s.columns)).encode()):016x}")
                continue
            path = safe_join(self.root, s.source)
            size = path.stat().st_size
            with open(path, "rb") as f:
                data = f.read(65_536)
                for k in range(64):
                    f.seek(size * k // 64)
                    data += f.read(4_096)
                f.seek(max(0, size - 65_536))
                data += f.read()
            out.append(f"{n}:{size}:{fnv(data):016x}")
        return "|".join(out)

    def query(self, sql: str, **options) -> Page:
        """One page of a query over the catalogue's tables."""
        used = self.open_named(sql)
        p = page(self.spark, sql, data=self.fingerprint(used), **options)
        p.warnings += self.notes[:40]
        return p

    def tables(self, cursor: int = 0, per_page: int = 50) -> list[dict]:
        """Tables with their columns and types; row counts where they cost nothing."""
        out = []
        for name in list(self.specs)[cursor : cursor + per_page]:
            s = self.specs[name]
            try:
                df = self.open(name)
                entry = {"name": name, "source": s.source, "format": s.format, "columns": [{"name": f.name, "type": type_name(f.dataType, f.metadata)} for f in df.schema.fields]}
                if s.format in ("parquet", "inline"):
                    entry["rows"] = df.count()
            except Exception as x:  # noqa: BLE001 - one unreadable table is an entry, not the end
                entry = {"name": name, "source": s.source, "format": s.format, "error": str(x).split("\n")[0]}
            out.append(entry)
        return out

    def describe(self, name: str, sample_rows: int = 100_000, columns: list[str] | None = None) -> dict:
        """Profile of a table's first rows, and five of them."""
        df = self.open(name)
        stats = [r.asDict() for r in profile(df, sample_rows, columns).collect()]
        return {"name": name, "columns": stats, "sample": page(self.spark, f'SELECT * FROM "{name}" LIMIT 5').rows}

    def run(self, request: dict) -> dict:
        """A request as one JSON value: mode tables, describe or query; unknown fields and bad options are one sentence."""
        known = {"mode", "sql", "table", "max_rows", "max_bytes", "markdown_rows", "cursor", "sample_rows", "columns", "output", "format", "overwrite"}
        if unknown := set(request) - known:
            raise Refused(f"unknown field {sorted(unknown)[0]}")
        mode = request.get("mode") or ("query" if "sql" in request else "describe" if "table" in request else "tables")
        if mode == "tables":
            return {"tables": self.tables(), "warnings": self.notes[:40]}
        if mode == "describe":
            n = request.get("sample_rows", 100_000)
            if not 1 <= n <= 10_000_000:
                raise Refused("sample_rows is out of range")
            return self.describe(request["table"], n, request.get("columns"))
        if mode != "query":
            raise Refused(f"unknown mode {mode}")
        if "output" in request:
            from millrace.engine.export import export

            used = self.open_named(request["sql"])
            del used
            return export(self.spark, request["sql"], self.root or ".", request["output"], request.get("format"), request.get("overwrite", False))
        options = {k: request[k] for k in ("max_rows", "max_bytes", "markdown_rows", "cursor") if k in request}
        return self.query(request["sql"], **options).json()


def valid_output(name: str) -> str:
    """A plain file name of at most 255 bytes without a leading dot."""
    if not name or len(name.encode()) > 255 or name.startswith(".") or re.search(r"[/\\\0]", name):
        raise Refused(f"{name!r} is no plain file name")
    return name
