"""Data jobs as documents: each asks for tables, a description or a query, and gets records back."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.engine.catalog import Catalog

MAX_ROWS, MAX_BYTES = 5_000, 1_500_000
JOB = "run_id string, path string, mode string, sql string, `table` string, max_rows int, cursor string"
RESULT, ROW, TABLE = "run_id string, result string, error string", "run_id string, `row` long, `values` string", "run_id string, name string, columns string"


def answer(spark: SparkSession, job: dict) -> tuple[list, list, list]:
    """(results, rows, tables) of one job; a failure is a result with an error, never an exception."""
    run = job["run_id"]
    try:
        request = {k: job[k] for k in ("mode", "sql", "table", "cursor") if job.get(k) is not None}
        if "sql" in request:
            request |= {"max_rows": min(job.get("max_rows") or MAX_ROWS, MAX_ROWS), "max_bytes": MAX_BYTES}
        out = Catalog.discover(spark, job["path"]).run(request)
        rows = [(run, out.get("offset", 0) + i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(out.pop("rows", []), 1)]
        tables = [(run, t["name"], json.dumps(t.get("columns", []), ensure_ascii=False)) for t in out.get("tables", [])]
        return [(run, json.dumps(out, ensure_ascii=False, default=str), None)], rows, tables
    except Exception as x:  # noqa: BLE001 - the error is the record
        return [(run, None, str(x).split("\n")[0])], [], []


#: Records of answers that are held before they are written.
HELD = 20_000


def handler(folder: str, held: int = HELD) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: answers the jobs of a batch one after the other and writes their records, some ``held`` at a
    time, a batch done again in the same place. A run is answered once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept: dict[str, list] = {"results": [], "rows": [], "tables": []}
        schemas, part = {"results": RESULT, "rows": ROW, "tables": TABLE}, 0

        def write(mode: str) -> None:
            for name, data in kept.items():
                spark.createDataFrame(data, schemas[name]).write.mode(mode).parquet(os.path.join(folder, name, f"batch={batch_id}"))
                data.clear()

        for job in batch.dropDuplicates(["run_id"]).orderBy("run_id").toLocalIterator():
            for name, data in zip(kept, answer(spark, job.asDict())):
                kept[name] += data
            if sum(map(len, kept.values())) >= held:
                write("append" if part else "overwrite")
                part += 1
        if not part or any(kept.values()):
            write("append" if part else "overwrite")

    return handle
