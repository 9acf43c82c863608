"""CSV records whose quoted fields may hold line breaks, read and written by many tasks.

Where a line stands, inside a quoted field or not, depends on all lines before it. So a
first pass surveys each split for either case: where it would end and how many
records would start. These rows, one a split, are combined along each file, and a
second pass then knows each line's place. Records of one line go straight on; only the
lines of longer ones are brought together.
"""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import keep

#: A quoted field, from its start; the quantifier takes no character back, so that a doubled quote never ends it.
_FIELD, _REST = r'(^|,)"(?:[^"]|"")*+"', r'^(?:[^"]|"")*+"'


def _opens(outside: Column) -> Column:
    """Does a line that begins outside a quoted field end inside one?"""
    return F.regexp_replace(outside, _FIELD, "$1x").rlike('(^|,)"')


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    closes = F.col("value").rlike(_REST)
    from_inside = F.when(closes, _opens(F.concat(F.lit("x"), F.regexp_replace("value", _REST, "")))).otherwise(True)
    quoted = F.contains("value", F.lit('"'))
    return lines.withColumns({"ends0": F.when(quoted, _opens(F.col("value"))).otherwise(False), "ends1": F.when(quoted, from_inside).otherwise(True)})


def _survey(batches):
    """For a start outside (0) and inside (1) a field: the end and the number of records that start."""
    current, state, starts, out = None, [0, 1], [0, 0], []
    for b in batches:
        for value, file, block, ends0, ends1 in zip(*(b.column(c).to_pylist() for c in ("value", "file", "block", "ends0", "ends1"))):
            if (file, block) != current:
                if current:
                    out.append((*current, *state, *starts))
                current, state, starts = (file, block), [0, 1], [0, 0]
            for k in (0, 1):
                starts[k] += not state[k] and bool(value)
                state[k] = int(ends1 if state[k] else ends0)
    if current:
        out.append((*current, *state, *starts))
    names = ["file", "block", "end0", "end1", "starts0", "starts1"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def _combine(splits: pd.DataFrame) -> pd.DataFrame:
    """Of the splits of a file: the state each begins in, and the records before it."""
    state, before, out = 0, 0, []
    for r in splits.sort_values("block").to_dict("records"):
        out.append((r["file"], r["block"], state, before))
        before, state = before + r[f"starts{state}"], r[f"end{state}"]
    return pd.DataFrame(out, columns=["file", "block", "state", "before"])


def _number(batches):
    current, inside, n, i = None, 0, 0, 0
    for b in batches:
        out = []
        for value, file, block, ends0, ends1, state, before in zip(*(b.column(c).to_pylist() for c in ("value", "file", "block", "ends0", "ends1", "state", "before"))):
            if (file, block) != current:
                current, inside, n, i = (file, block), state, before, 0
            i += 1
            if not inside and not value:
                continue  # a blank line is no record
            n += not inside
            after = int(ends1 if inside else ends0)
            out.append((file, n, block, i, value, not inside and not after))
            inside = after
        names = ["file", "rownum", "block", "line", "value", "whole"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, rownum (1 is the header), value: each record of the files at ``path`` as text.

    Blank lines between records do not count. A field that is never closed reaches to
    the end of its file. Line breaks inside a field come out as line feeds.
    """
    lines = _lines(spark, path)
    splits = keep(lines.mapInArrow(_survey, "file string, block long, end0 int, end1 int, starts0 long, starts1 long"))
    places = splits.groupBy("file").applyInPandas(_combine, "file string, block long, state int, before long")
    placed = lines.join(F.broadcast(places), ["file", "block"])  # a row for each split
    numbered = placed.mapInArrow(_number, "file string, rownum long, block long, line long, value string, whole boolean")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"])
    longer = numbered.where("not whole").groupBy("file", "rownum").agg(F.array_join(pieces, "\n").alias("value"))
    return numbered.where("whole").select("file", "rownum", "value").unionByName(longer)


def write_one(lines: DataFrame, order: list[Column | str], path: str, header: str | None = None) -> None:
    """One file of the strings in ``line``, in order, from many tasks.

    Ranges of the order are sorted and written side by side, and the parts joined at the
    end: by the file system itself where it can (HDFS concatenates without copying),
    else by copying streams. Nothing is held in memory but a buffer.
    """
    spark = lines.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    lines.orderBy(*order).select("line").write.text(folder)
    jvm = spark.sparkContext._jvm
    conf, of = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path
    files = of(path).getFileSystem(conf)
    parts = sorted(str(f.getPath()) for f in files.listStatus(of(folder)) if f.getPath().getName().startswith("part-") and f.getLen())
    files.delete(of(path), True)
    out = files.create(of(path), True)
    if header is not None:
        out.write(bytearray(f"{header}\n".encode()))
    try:
        if files.getScheme() == "hdfs" and header is not None:
            out.close()
            array = spark.sparkContext._gateway.new_array(of, len(parts))
            for i, part in enumerate(parts):
                array[i] = of(part)
            files.concat(of(path), array)
        else:
            for part in parts:
                source = files.open(of(part))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                source.close()
    finally:
        out.close()
        files.delete(of(folder), True)


def csv_line(columns: list[str]) -> Column:
    """A record as text: nulls and empty strings are nothing between commas."""
    return F.to_csv(F.struct(*columns), {"emptyValue": "", "nullValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("line")
