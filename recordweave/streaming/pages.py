"""Landed pages as a stream with one cursor per source, and the ingest job that follows it.

Pages lie in ``source_id=<name>/date=<yyyy-mm-dd>/page=<n>/`` with parquet files inside; a date's pages are numbered from 1. A
page lands whole: write it elsewhere and rename, or write the folder before its parent names it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.operators.ingest import merge_by_native_id
from recordweave.session import run_dir, stage
from recordweave.sources.sinks import append_new, read_or_empty

FORMAT = "landed_pages"
PLACE = "source_id string, date date, page int"


def page_source() -> type:
    """The data source class. It is made here so that it travels with the query: executors need no copy of this package."""
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    class Pages(InputPartition):
        def __init__(self, pages):
            self.pages = pages

    class Reader(DataSourceStreamReader):
        def __init__(self, options, schema):
            self.path, self.schema = options["path"], schema
            self.lookback = json.loads(options.get("lookback", "{}"))
            self.default = int(options.get("defaultlookback", 21))
            self.per_task = int(options.get("pagespertask", 8))

        # --- what has landed -------------------------------------------------------------

        def folders(self, base, name):
            """{value: path} of the folders ``name=value`` in ``base``."""
            from urllib.parse import unquote

            from pyarrow import fs

            system, root = fs.FileSystem.from_uri(base)
            found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
            prefix = base[: len(base) - len(root)] if base.endswith(root) else ""
            head = f"{name}="
            return {unquote(f.base_name[len(head):]): prefix + f.path for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(head)}

        def walk(self, day):
            """The last page of a date that is reached without a gap."""
            there = {int(p) for p in self.folders(day, "page")}
            page = 0
            while page + 1 in there:
                page += 1
            return page

        def floor(self, source, newest):
            from datetime import date, timedelta

            return (date.fromisoformat(newest) - timedelta(days=self.lookback.get(source, self.default))).isoformat()

        # --- cursors ---------------------------------------------------------------------

        def initialOffset(self):
            return {}

        def latestOffset(self):
            """{source: {floor, pages: {date: last page}}}: only dates within the source's lookback of its newest one."""
            out = {}
            for source, folder in self.folders(self.path, "source_id").items():
                days = self.folders(folder, "date")
                if days:
                    low = self.floor(source, max(days))
                    out[source] = {"floor": low, "pages": {d: self.walk(p) for d, p in sorted(days.items()) if d >= low}}
            return out

        def partitions(self, start, end):
            todo = []
            for source, folder in sorted(self.folders(self.path, "source_id").items()):
                if source not in end:
                    continue
                done, upto = start.get(source, {"floor": "", "pages": {}}), end[source]
                for day, path in sorted(self.folders(folder, "date").items()):
                    if day < done["floor"]:
                        continue
                    # a date that leaves the lookback now is walked to its end once more, and then never again
                    last = upto["pages"].get(day, 0) if day >= upto["floor"] else self.walk(path)
                    todo += [(source, day, n, f"{path}/page={n}") for n in range(done["pages"].get(day, 0) + 1, last + 1)]
            return [Pages(todo[i : i + self.per_task]) for i in range(0, len(todo), self.per_task)]

        def commit(self, end):
            pass

        # --- on executors ----------------------------------------------------------------

        def read(self, partition):
            import datetime as dt

            import pyarrow as pa
            import pyarrow.parquet as pq
            from pyarrow import fs
            from pyspark.sql.pandas.types import to_arrow_schema

            want = to_arrow_schema(self.schema)
            for source, day, page, path in partition.pages:
                system, root = fs.FileSystem.from_uri(path)
                own = {"source_id": source, "date": dt.date.fromisoformat(day), "page": page}
                for file in sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.size and not f.base_name.startswith(("_", "."))):
                    with system.open_input_file(file) as handle:
                        stored = pq.ParquetFile(handle)
                        names = [f.name for f in want if f.name not in own and f.name in stored.schema_arrow.names]
                        for batch in stored.iter_batches(8192, columns=names):
                            made = []
                            for field in want:
                                if field.name in own:
                                    made.append(pa.array([own[field.name]] * batch.num_rows, field.type))
                                elif field.name in names:
                                    made.append(batch.column(field.name).cast(field.type))
                                else:
                                    made.append(pa.nulls(batch.num_rows, field.type))
                            yield pa.RecordBatch.from_arrays(made, schema=want)

    class LandedPages(DataSource):
        @classmethod
        def name(cls):
            return "landed_pages"

        def streamReader(self, schema):
            return Reader(self.options, schema)

    return LandedPages


def stream_pages(
    spark: SparkSession, path: str, schema: str, lookback: dict[str, int] | None = None, default: int = dims.HOT_WINDOW_DAYS, pages_per_task: int = 8
) -> DataFrame:
    """A stream of the rows of landed pages: ``schema`` (of the files; a missing column is null), source_id, date, page.

    Each source has its own cursor: it walks the pages of a date up to the first one missing, then goes on to the
    next date. Sources lag, so dates up to ``lookback`` days (by source, else ``default``) before the source's newest date are
    looked at again for pages that landed since; a page that lands later than that is not read. The first
    walk reads all dates. The cursors are the stream's offsets: a restart goes on where the checkpoint stands, in the middle of a date
    too, and reads no page twice. An offset holds one number for each source and date of its lookback.
    """
    spark.dataSource.register(page_source())
    return (
        spark.readStream.format(FORMAT).schema(f"{schema}, {PLACE}").option("path", path)
        .option("lookback", json.dumps(dims.LOOKBACK_DAYS if lookback is None else lookback))
        .option("defaultlookback", default).option("pagespertask", pages_per_task).load()
    )


RUN = "run_id string, fetched bigint, new bigint, duplicate bigint"


def ingest(pages: DataFrame, parse: Callable[[DataFrame], DataFrame], root: str | None = None, name: str = "run") -> tuple[DataFrame, DataFrame]:
    """(raw records, runs) after all that has landed went from pages to the raw table.

    A batch is a run: its pages are parsed, copies of a record from several probes merged into one with the union of
    desks, records that are stored already left out, the rest appended, and one row of counts kept. ``parse`` gives
    source_id, native_id, content_hash, arrival, desks and any other columns. A run that is tried again after a failure replaces
    its own partition and row. The same ``root`` goes on from its cursors; a first call over an empty folder is a run of zeros,
    a later one without new pages is no run.
    """
    spark = pages.sparkSession
    root = root or run_dir(spark, "ingest")

    def store(batch: DataFrame, batch_id: int) -> None:
        run = f"{name}-{batch_id}"
        # pages are read and parsed once; merging and appending look at their input several times
        merged = stage(merge_by_native_id(stage(parse(batch), "parsed")), "merged")
        counts = append_new(batch.sparkSession, merged, f"{root}/raw", run)
        counts.write.mode("overwrite").parquet(f"{root}/runs/batch={batch_id}")

    query = pages.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    empty = merge_by_native_id(parse(spark.createDataFrame([], pages.schema))).withColumn("run_id", F.lit(""))
    runs = read_or_empty(spark, f"{root}/runs", spark.createDataFrame([], RUN))
    return read_or_empty(spark, f"{root}/raw", empty), runs
