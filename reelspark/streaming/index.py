"""An index kept up by the micro-batches of a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators.index import INDEX_SCHEMA, OBSERVED_SCHEMA, next_index, reindex, report

_LOG = "pass long, version long, unchanged long, modified long, moved long, new long, tombstoned long, failed long, changed boolean"


class LibraryIndex:
    """The index of a library in a shared folder, updated pass by pass.

    ``observe`` is a foreachBatch function for rows of OBSERVED_SCHEMA and ``pass`` (long, rising). A batch's rows are written under the batch's id, so a
    batch that is given again replaces itself. A pass ends when a row of a later pass has come, or by ``close``; it is then reconciled once with the index
    of the pass before, and what comes for it later is not read. Each pass writes its records and verdicts under its number before its line of the log, and a pass
    with a line is never done again; so a job that dies anywhere goes on where it was. The version rises only with a pass that changed something.
    Rows without a pass are dropped.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _there(self, place: str) -> list[int]:
        """The numbers of the finished parts below a place."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{place}")
        files = path.getFileSystem(self.spark._jsc.sc().hadoopConfiguration())
        if not files.exists(path):
            return []
        found = [s.getPath() for s in files.listStatus(path)]
        return sorted(int(p.getName().split("=")[1]) for p in found if "=" in p.getName() and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def begin(self, index: DataFrame) -> None:
        """Start from an index as pass 0 and version 0; nothing is done if there is one."""
        if not self._there("log"):
            rows = index.select(*(x.split()[0] for x in INDEX_SCHEMA.split(", "))).withColumns({"verdict": F.lit("unchanged"), "from_path": F.lit(None).cast("string"), "kept": F.lit(True)})
            rows.write.mode("overwrite").parquet(f"{self.folder}/records/pass=0")
            self._log(0, self.spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0, 0, False)], _LOG))

    def _log(self, number: int, line: DataFrame) -> None:
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/pass={number}")

    def observe(self, batch: DataFrame, batch_id: int) -> None:
        batch.filter("pass IS NOT NULL").write.mode("overwrite").parquet(f"{self.folder}/seen/batch={batch_id}")
        latest = self._seen().agg(F.max("pass")).first()[0]
        if latest is not None:
            self.close(latest - 1)

    def _seen(self) -> DataFrame:
        batches = [f"{self.folder}/seen/batch={b}" for b in self._there("seen")]
        schema = f"{OBSERVED_SCHEMA}, pass long"
        return self.spark.read.schema(schema).parquet(*batches) if batches else self.spark.createDataFrame([], schema)

    def close(self, upto: int) -> None:
        """Reconcile all passes up to a number that have rows and are not done."""
        done = self._there("log")
        rows = self._seen()
        for number in sorted(r[0] for r in rows.filter((F.col("pass") > max(done)) & (F.col("pass") <= upto)).select("pass").distinct().collect()):
            before = self.verdicts(max(done)).filter("kept")
            records = f"{self.folder}/records/pass={number}"
            reindex(next_index(before), rows.filter(F.col("pass") == number)).write.mode("overwrite").parquet(records)
            counts = report(self.spark.read.parquet(records))
            version = self.spark.read.parquet(f"{self.folder}/log/pass={max(done)}").select(F.col("version").alias("v"))
            line = counts.crossJoin(version).select(F.lit(number).cast("long").alias("pass"), (F.col("v") + F.col("changed").cast("long")).alias("version"), *(x.split()[0] for x in _LOG.split(", ")[2:]))
            self._log(number, line)
            done.append(number)

    def verdicts(self, number: int | None = None) -> DataFrame:
        """Records, verdicts and moves of a pass that is done, the last one if not said otherwise."""
        return self.spark.read.parquet(f"{self.folder}/records/pass={self._there('log')[-1] if number is None else number}")

    def index(self) -> DataFrame:
        return next_index(self.verdicts())

    def log(self) -> DataFrame:
        """A row a pass: its version and counts."""
        return self.spark.read.schema(_LOG).parquet(*(f"{self.folder}/log/pass={n}" for n in self._there("log")))
