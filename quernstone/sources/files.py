"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; lines end at \\n only, as other separators occur inside strings. Bad lines fail."""
    return spark.read.schema(schema).options(lineSep="\n", mode="FAILFAST").json(path)


def csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text with quoted line breaks; every column is a string."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(sep=sep, header=header, multiLine=True, escape='"', mode="FAILFAST").csv(path)


def texts_under(spark: SparkSession, root: str) -> DataFrame:
    """(file, text) of every JSON line under a folder."""
    return spark.read.schema("text string").option("recursiveFileLookup", True).option("lineSep", "\n").json(root).select(F.col("_metadata.file_path").alias("file"), "text")


def verified(spark: SparkSession, path: str, digests: dict[str, str]) -> DataFrame:
    """(path, ok): whether the SHA-256 of each file is the one that its name is pinned to."""
    pinned = spark.createDataFrame(list(digests.items()), "name string, pinned string")
    found = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return found.join(F.broadcast(pinned), "name", "left").select("path", (F.col("sha256") == F.col("pinned")).alias("ok"))


def zipped(folder: str, member: str):
    """For mapInPandas over `line`: writes a partition's lines as one member of a zip archive in the folder, which is mounted at the same
    place everywhere. A task that is run again overwrites its own archive."""

    def write(batches):
        import os
        import zipfile

        import pandas as pd
        from pyspark import TaskContext

        local = "/" + folder.removeprefix("file:").lstrip("/")
        os.makedirs(local, exist_ok=True)
        name = f"{local}/part-{TaskContext.get().partitionId():05d}.zip"
        with zipfile.ZipFile(f"{name}.{TaskContext.get().taskAttemptId()}", "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w", force_zip64=True) as out:
            for batch in batches:
                out.write("".join(f"{line}\n" for line in batch["line"]).encode())
        os.replace(f"{name}.{TaskContext.get().taskAttemptId()}", name)
        yield pd.DataFrame({"archive": [name]})

    return write


def archive_lines(spark: SparkSession, folder: str, member: str, batch: int = 1024, password: bytes | None = None) -> DataFrame:
    """(archive, line): the lines of one member of every .zip, .tar, .tar.gz or .tgz under a folder. An archive comes to one task as
    its bytes, whatever the file system (2 GB at most, Spark's bound for a value); its member is unpacked as a stream, a batch of lines at a time."""

    def lines(archives):
        import io
        import tarfile
        import zipfile
        from itertools import islice

        import pandas as pd

        for frame in archives:
            for path, content in frame[["path", "content"]].itertuples(index=False):
                data = io.BytesIO(content)
                if path.endswith(".zip"):
                    z = zipfile.ZipFile(data)
                    raw = z.open(member, pwd=password) if member in z.namelist() else None
                else:
                    t = tarfile.open(fileobj=data, mode="r:*")
                    raw = t.extractfile(member) if member in t.getnames() else None
                if raw is None:
                    raise ValueError(f"{path} has no {member}")
                text = io.TextIOWrapper(raw, "utf-8", newline="\n")
                while part := list(islice(text, batch)):
                    yield pd.DataFrame({"archive": path, "line": [x.rstrip("\n") for x in part]})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,tar,tar.gz,tgz}").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "content").mapInPandas(lines, "archive string, line string")


def write_results(df: DataFrame, path: str) -> None:
    """Results are never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def write_splits(df: DataFrame, path: str, split: str) -> None:
    df.write.mode("errorifexists").partitionBy(split).parquet(path)
