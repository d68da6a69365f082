"""Sinks: files, merged corpora, and a versioned store that is verified before it is served."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusloom.sources.readers import require


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sheet(df: DataFrame, path: str, separator: str = ",") -> None:
    """Blanks at the ends of values are kept; an empty value is read back as null."""
    df.write.mode("overwrite").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).option("header", True).option("sep", separator).option("escape", '"').csv(path)


def merge_corpora(*parts: DataFrame) -> DataFrame:
    """All chunks of several corpora, whose columns may differ; raises on ids that repeat or records that lack id or text."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    require(out.filter("id IS NULL OR text IS NULL OR trim(text) = ''").select("id"), "records without id or text")
    require(out.groupBy("id").count().filter("count > 1"), "ids that repeat")
    return out


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and documents by source type."""
    kind = F.upper(F.trim("metadata.source_type"))
    return chunks.groupBy(kind.alias("source_type")).agg(F.count("*").alias("chunks"), F.count_distinct("metadata.document_id").alias("documents"))


def pending(new: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """What is not stored yet: the rows to compute or append."""
    return new.join(stored.select(key), key, "left_anti")


def resume(rows: DataFrame, done: str, schema: str, key: str = "qid") -> DataFrame:
    """The rows whose key is not among the lines of JSON already in a folder; a line cut off by a crash counts as not there."""
    spark = rows.sparkSession
    try:
        have = spark.read.schema(f"{schema}, broken string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="broken").json(done)
        have = have.filter(F.col("broken").isNull() & F.col(key).isNotNull()).select(key).distinct()
    except AnalysisException:
        return rows
    return rows.join(have, key, "left_anti")


def overwrite_with_backup(df: DataFrame, path: str, stamp: str) -> str | None:
    """Writes df as Parquet to a path; what stood there moves to `path.stamp`, whose name is returned, before the new rows take its place.

    The new rows are whole before anything is moved, so a failure leaves the old ones where they were.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    fresh, old = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
    files = old.getFileSystem(conf)
    df.write.mode("overwrite").parquet(f"{path}.new")
    kept = f"{path}.{stamp}" if files.exists(old) else None
    require_move = lambda a, b: files.rename(a, b) or _fail(f"cannot move {a.toString()}")
    if kept:
        require_move(old, jvm.org.apache.hadoop.fs.Path(kept))
    require_move(fresh, old)
    return kept


def _fail(problem: str) -> None:
    raise OSError(problem)


class Store:
    """Versions of a table under one folder, of which one is served; a pointer file names it.

    Each version is a folder `<name>_<first digits of the fingerprint>`; publishing verifies it first, and
    the pointer is replaced in one rename by the file system's own commit, so readers see one version or
    the other.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name

    def version(self, fingerprint: str) -> str:
        return f"{self.name}_{fingerprint[:16]}"

    def path(self, version: str) -> str:
        return f"{self.root}/{version}"

    def stored(self, version: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path(version))
        except AnalysisException:
            return None

    def upsert(self, version: str, rows: DataFrame, key: str = "id") -> int:
        """Appends the rows whose key the version lacks; running it again appends nothing."""
        have = self.stored(version)
        new = rows if have is None else pending(rows, have.select(key).distinct(), key)
        before = 0 if have is None else have.count()
        new.dropDuplicates([key]).write.mode("append").parquet(self.path(version))
        return self.stored(version).count() - before

    def verify(self, version: str, expected: DataFrame, key: str = "id", dimension: int | None = None) -> None:
        """Raises on keys missing, unknown or stored twice, or vectors of another size."""
        have = self.stored(version)
        if have is None:
            raise ValueError(f"no version {version}")
        require(have.groupBy(key).count().filter("count > 1"), "stored twice")
        require(expected.select(key).join(have, key, "left_anti"), "missing")
        require(have.select(key).join(expected, key, "left_anti"), "unknown")
        if dimension is not None:
            require(have.filter(F.size("vector") != dimension).select(key), "vectors of another size")

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def served(self) -> str | None:
        jvm, fs = self._files()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.name}.served")
        if not fs.exists(p):
            return None
        s = fs.open(p)
        try:
            return str(jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")).strip()
        finally:
            s.close()

    def promote(self, version: str, expected: DataFrame, key: str = "id") -> None:
        """Serves a version once it holds just what is expected."""
        self.verify(version, expected, key)
        self._point(version)

    def rollback(self, version: str) -> None:
        if self.stored(version) is None:
            raise ValueError(f"no version {version}")
        self._point(version)

    def _point(self, version: str) -> None:
        jvm, fs = self._files()
        p = jvm.org.apache.hadoop.fs.Path
        new, old = p(f"{self.root}/{self.name}.next"), p(f"{self.root}/{self.name}.served")
        out = fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        # A file context renames over an existing file in one operation.
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, old, self._overwrite(jvm))

    @staticmethod
    def _overwrite(jvm):
        gateway = jvm._gateway_client
        options = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        jvm.java.lang.reflect.Array.set(options, 0, getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE)
        _ = gateway
        return options

    def versions(self) -> list[str]:
        jvm, fs = self._files()
        found = fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.root))
        named = [(f.getModificationTime(), f.getPath().getName()) for f in found if f.isDirectory() and f.getPath().getName().startswith(self.name + "_")]
        return [n for _, n in sorted(named, reverse=True)]

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the newest `keep` versions, never the one that is served; returns what went."""
        served, gone = self.served(), []
        jvm, fs = self._files()
        for v in self.versions()[keep:]:
            if v != served:
                fs.delete(jvm.org.apache.hadoop.fs.Path(self.path(v)), True)
                gone.append(v)
        return gone
