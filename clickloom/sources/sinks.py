"""Writers: text lines, result CSV, submissions. All replace what was at the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import delete_directory, new_path

# blanks at the ends of a text are part of it, and an empty text is not a missing one
_CSV = {
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": '""',
}


def write_lines(lines: DataFrame, path: str, *, single_file: bool = False) -> None:
    """Write a one-column text DataFrame.

    Every task writes its own file. ``single_file`` merges them into one and is meant for small results.
    """
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """Write headered CSV that ``read_csv`` reads back."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).options(**_CSV).csv(path)


def submission(scores: DataFrame, id_column: str = "row_id", score: str = "probability") -> DataFrame:
    """The two columns of a submission, ``id`` and ``click``."""
    return scores.select(F.col(id_column).cast("string").alias("id"), F.col(score).alias("click"))


def write_submission(
    scores: DataFrame,
    path: str,
    id_column: str = "row_id",
    score: str = "probability",
    *,
    number: str | None = None,
    single_file: bool = False,
) -> None:
    """Write ``id,click`` with a header.

    With ``number``, a column that orders the rows, they are written in that order and the header once, as by
    ``write_in_order``; otherwise in any order, with a header for each file, as by ``write_csv``.
    """
    if number is None:
        write_csv(submission(scores, id_column, score), path, single_file=single_file)
        return
    fields = F.struct(F.col(id_column).cast("string").alias("id"), F.col(score).alias("click"))
    lines = scores.select(number, F.to_csv(fields, _CSV).alias("_line"))
    write_in_order(lines, number, "_line", path, header="id,click", single_file=single_file)


def write_in_order(
    rows: DataFrame, number: str, line: str, path: str, *, header: str | None = None, single_file: bool = False
) -> None:
    """Write the text column ``line`` in ascending order of ``number``, behind one ``header``.

    Ranges of numbers are sorted and written side by side, and the files' names follow the order, so files one
    after the other are the whole. ``single_file`` joins them so, on the file system and without any task that
    sees all rows; ``path`` then is a file.
    """
    spark = rows.sparkSession
    lines = rows.select(F.col(number).cast("bigint").alias("number"), F.col(line).alias("value"))
    if header is not None:
        least = spark.range(1).select(F.lit(-(1 << 63)).cast("bigint").alias("number"), F.lit(header).alias("value"))
        lines = least.unionByName(lines)
    target = new_path(spark, "parts") if single_file else path
    lines.repartitionByRange("number").sortWithinPartitions("number").select("value").write.mode("overwrite").text(target)
    if single_file:
        join_files(spark, target, path)


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """Make one file of the parts in ``folder``, in order of their names, and remove the folder.

    File systems that can join files do so without reading them; on others the bytes are streamed.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    source = hadoop.fs.Path(folder)
    parts = sorted(
        (f.getPath().toString() for f in source.getFileSystem(conf).listStatus(source) if f.getPath().getName().startswith("part-"))
    )
    out = fs.create(target, True)
    if fs.getScheme() == "hdfs":
        out.close()
        files = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(parts))
        for k, part in enumerate(parts):
            files[k] = hadoop.fs.Path(part)
        fs.concat(target, files)
    else:
        for part in parts:
            piece = source.getFileSystem(conf).open(hadoop.fs.Path(part))
            hadoop.io.IOUtils.copyBytes(piece, out, conf, False)
            piece.close()
        out.close()
    delete_directory(spark, folder)
