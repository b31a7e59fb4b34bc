"""A folder of files ingested as a stream: each file once, failures apart, retried by themselves."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.functions.text import content_hash
from lexoria.operators.publishing import Publication
from lexoria.sources.files import parse_files

_FILE = "path string, modificationTime timestamp, length long, content binary"
_ROW = "path string, suffix string, text string, error string"
#: Failed files that one round of a retry reads; there are as many rounds as are needed.
RETRY_FILES = 10_000


class DirectoryIngest:
    """What has become of the files of a folder, in a state folder that all executors share.

    ``run`` takes up the files that it has not met, by a file stream that ends when all are read; its
    checkpoint knows them. A batch writes its rows in place of what it wrote before, so that a run
    that was stopped goes on without doubles or gaps. A file that cannot be read is a row with an
    error and stops nothing; ``retry`` reads such files alone. Of several attempts the last counts.
    Empty files are not read by Spark and have no row.
    """

    def __init__(self, spark: SparkSession, folder: str, state: str):
        self.spark, self.folder, self.state = spark, folder.rstrip("/"), state.rstrip("/")

    def run(self, files_per_batch: int = 1_000) -> None:
        files = self.spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(self.folder)

        def write(batch: DataFrame, number: int) -> None:
            parse_files(batch).write.mode("overwrite").parquet(f"{self.state}/attempts/attempt=0/batch={number}")

        query = files.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.state}/stream").trigger(availableNow=True).start()
        query.awaitTermination()

    def attempts(self) -> DataFrame:
        """(path, suffix, text, error, attempt, batch) of all reads of files."""
        try:
            found = self.spark.read.schema(f"{_ROW}, attempt int, batch long").parquet(f"{self.state}/attempts")
        except AnalysisException:  # nothing has been read
            return self.spark.createDataFrame([], f"{_ROW}, attempt int, batch long")
        return found.select(*(c.split()[0] for c in _ROW.split(", ")), "attempt", "batch")

    def latest(self) -> DataFrame:
        """(path, suffix, text, error): the last attempt of each file."""
        row = F.struct("suffix", "text", "error")
        return self.attempts().groupBy("path").agg(F.max_by(row, "attempt").alias("r")).select("path", "r.*")

    def documents(self) -> DataFrame:
        """(path, text, content_hash) of the files that were read."""
        return self.latest().filter("error IS NULL").select("path", "text", content_hash(F.col("text")).alias("content_hash"))

    def failures(self) -> DataFrame:
        """(path, error) of the files whose last attempt failed."""
        return self.latest().filter("error IS NOT NULL").select("path", "error")

    def retry(self) -> int:
        """Read the failed files once more; how many there were. A file that is gone stays failed."""
        number = (self.attempts().agg(F.max("attempt")).first()[0] or 0) + 1
        todo, after, rounds = self.failures().select("path"), "", 0
        while paths := [r["path"] for r in todo.filter(F.col("path") > after).orderBy("path").limit(RETRY_FILES).collect()]:
            files = self.spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load([p for p in paths if self._exists(p)] or [self.folder])
            asked = F.broadcast(self.spark.createDataFrame([(p,) for p in paths], "path string"))
            parse_files(files.join(asked, "path", "left_semi")).write.mode("overwrite").parquet(f"{self.state}/attempts/attempt={number}/batch={rounds}")
            after, rounds = paths[-1], rounds + 1
        return self.spark.read.parquet(f"{self.state}/attempts/attempt={number}").count() if rounds else 0

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ingest_directory(ingest: DirectoryIngest, publication: Publication, plan_id: str) -> dict:
    """Take up new files, retry failed ones, and publish the documents as a version, once for a plan."""
    ingest.retry()
    ingest.run()
    return publication.apply(ingest.documents(), plan_id)
