"""A sink for converted files: the tasks write them, the driver sees one row a file."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hadoop's names of stores and Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def write_files(converted: DataFrame) -> DataFrame:
    """Write each successful row's ``output`` to its ``result.target_path`` and give the results.

    A file is written under another name beside its target and then renamed, so a task that is run
    again does no harm. Folders are made. A target that can't be written makes the row a failure.
    Paths without a scheme lie on a file system that all executors share. Kept intermediate files
    are written as well. Nothing is written before the result is read.
    """
    files = F.array(F.struct(F.col("result.target_path").alias("path"), F.col("output").alias("data")))
    if "intermediates" in converted.columns:
        files = F.concat(files, "intermediates")
    kind = converted.schema["result"].dataType

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        import pyarrow.fs as pafs

        for batch in batches:
            results = []
            for result, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if result["success"]:
                    try:
                        for part in parts:
                            scheme, mark, rest = part["path"].partition("://")
                            fs, at = pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest) if mark else (pafs.LocalFileSystem(), os.path.abspath(part["path"]))
                            fs.create_dir(at.rpartition("/")[0], recursive=True)
                            new = f"{at}.{os.getpid()}.part"
                            with fs.open_output_stream(new) as f:
                                f.write(part["data"])
                            fs.move(new, at)
                    except Exception as e:  # noqa: BLE001 - a file's error is its result
                        result = result | {"success": False, "error": f"SinkError: {e}"}
                results.append(result)
            yield pa.RecordBatch.from_arrays([pa.array(results, type=batch.schema.field(0).type)], names=["result"])

    return converted.select("result", files.alias("files")).mapInArrow(run, f"result {kind.simpleString()}").select("result.*")
