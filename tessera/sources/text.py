"""Text readers.

All readers are ``spark.read.text`` followed by column expressions, so files
are split across tasks by Spark and nothing passes through the driver; the
only eager steps are the optional shape checks (one aggregate each).  Each
``read_*`` is a thin ``spark.read.text`` over a ``parse_*_lines`` function
that takes any DataFrame with a string column ``value`` (one line per row),
so the same parsing also applies to lines produced by another job.

A line of a dense table is one record there.  :func:`read_wide_table` reads tables
whose lines are too long for that: files are cut by byte ranges between fields, every field is a
record, and lines are put together from a small table of the ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import CONF_MAX_HOT_KEYS, Mat, canon, conf_int, cut_lineage, require, ship_package
from tessera.functions.lines import genotype, parse_doubles, parse_genotypes, split_ws, to_double
from tessera.sources.entries import from_entries


def _index(field: Column, shift: int = 0) -> Column:
    """A row or column id of a line; text that is not an integer raises."""
    bad = F.raise_error(F.concat(F.lit("not an index: "), F.coalesce(field, F.lit("(missing)"))))
    return F.coalesce(field.try_cast("long"), bad.cast("long")) - F.lit(shift)


# Tokens that mark header/comment lines in dense tab files.
DENSE_SKIP_TOKENS = ("#", "Sample", "HG", "NA")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated ``src dst`` per line; ``#`` and blank lines dropped,
    any other line that does not parse raises; returns entries ``(i=src, j=dst, v=1.0)`` (0-based as written)."""
    return parse_edge_lines(spark.read.text(path))


def parse_edge_lines(lines: DataFrame) -> DataFrame:
    """S1 on a DataFrame of lines (column ``value``)."""
    f = split_ws("value")
    return (
        lines.filter(~F.trim(F.col("value")).startswith("#") & (F.length(F.trim("value")) > 0))
        .select(_index(F.get(f, 0)).alias("i"), _index(F.get(f, 1)).alias("j"), F.lit(1.0).alias("v"))
    )


def read_triplets(spark: SparkSession, path: str, one_based: bool = True) -> DataFrame:
    """``row col value`` per line (1-based by default) -> 0-based entries; blank
    lines dropped, any other line that does not parse raises."""
    return parse_triplet_lines(spark.read.text(path), one_based)


def parse_triplet_lines(lines: DataFrame, one_based: bool = True) -> DataFrame:
    """S2 on a DataFrame of lines (column ``value``)."""
    f = split_ws("value")
    shift = 1 if one_based else 0
    return (
        lines
        .filter(F.length(F.trim("value")) > 0)
        .select(
            _index(F.get(f, 0), shift).alias("i"),
            _index(F.get(f, 1), shift).alias("j"),
            F.coalesce(to_double(F.get(f, 2)), F.raise_error(F.concat(F.lit("no value in line: "), "value")).cast("double")).alias("v"),
        )
    )


def read_dense_table(
    spark: SparkSession,
    path: str,
    nrows: int | None = None,
    ncols: int | None = None,
    parser: Callable[[Column], Column] = parse_doubles,
    skip_tokens: tuple[str, ...] = DENSE_SKIP_TOKENS,
    check: bool = True,
) -> DataFrame:
    """S3: dense tab-separated table -> complete ``(i, j, v)`` (zeros and NULLs kept).

    The first field of a line is the 1-based row id; lines holding any of
    ``skip_tokens`` are dropped (R28).  ``parser`` maps the value fields
    (``ARRAY<STRING>``) to ``ARRAY<DOUBLE>`` (F3).  With ``check`` the
    declared row count and value-field count are verified in one aggregate.
    """
    return parse_dense_lines(spark.read.text(path), nrows, ncols, parser, skip_tokens, check)


def parse_dense_lines(
    lines: DataFrame,
    nrows: int | None = None,
    ncols: int | None = None,
    parser: Callable[[Column], Column] = parse_doubles,
    skip_tokens: tuple[str, ...] = DENSE_SKIP_TOKENS,
    check: bool = True,
) -> DataFrame:
    """S3 on a DataFrame of lines (column ``value``)."""
    keep = F.lit(True)
    for tok in skip_tokens:
        keep = keep & ~F.col("value").contains(tok)
    fields = F.split(F.col("value"), "\t")
    rows = lines.filter(keep & (F.length(F.trim("value")) > 0)).select(
        _index(F.get(fields, 0), 1).alias("i"),
        parser(F.slice(fields, 2, 1 << 30)).alias("vals"),
    )
    if check and (nrows is not None or ncols is not None):
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vals")).alias("lo"), F.max(F.size("vals")).alias("hi")).first()
        if nrows is not None:
            require(r["n"] == nrows, f"dense file has {r['n']} rows, declared {nrows}")
        if ncols is not None and r["n"]:
            require(r["lo"] == ncols and r["hi"] == ncols, f"dense file has {r['lo']}..{r['hi']} columns, declared {ncols}")
    return rows.select("i", F.posexplode("vals").alias("j", "v")).select(
        "i", F.col("j").cast("long").alias("j"), "v"
    )


def read_dense(spark: SparkSession, path: str, nrows: int, ncols: int, **kw) -> Mat:
    """S3 as a canonical matrix (zeros and missing values dropped)."""
    t = read_dense_table(spark, path, nrows, ncols, **kw)
    return from_entries(canon(t), nrows, ncols, unique=True)


def read_genotypes(spark: SparkSession, path: str, nrows: int | None = None, ncols: int | None = None, missing: str = "zero") -> DataFrame:
    """Genotype dense file -> ``(snp, sample, g)``; ``NaN``/``-1`` -> 0 or NULL."""
    return parse_genotype_lines(spark.read.text(path), nrows, ncols, missing)


def parse_genotype_lines(lines: DataFrame, nrows: int | None = None, ncols: int | None = None, missing: str = "zero") -> DataFrame:
    """S4 on a DataFrame of lines (column ``value``)."""
    t = parse_dense_lines(
        lines, nrows, ncols, parser=lambda c: parse_genotypes(c, missing), skip_tokens=("Sample",)
    )
    return t.select(F.col("i").alias("snp"), F.col("j").alias("sample"), F.col("v").cast("int").alias("g"))


# --- very wide lines ----------------------------------------------------------------------------------------------

_CELLS = "file string, start long, line long, field long, id string, text string"
_RANGE = ["file", "start"]


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_CELLS`` from records between tabs.  A record with line ends holds the last field of a line, whole short lines
    and the first field of the next.  ``line`` and ``field`` count within the byte range; line 0 goes on from the range
    before, so its fields' numbers and its id are not known here."""
    at, line, field, own = None, 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column("file"), batch.column("start").to_numpy()
        pieces = pc.split_pattern(batch.column("value"), "\n")
        count = pieces.value_lengths().to_numpy()
        text = pc.utf8_rtrim(pieces.flatten(), characters="\r")
        record = np.repeat(np.arange(batch.num_rows), count)
        first = np.append(0, np.cumsum(count)[:-1])
        begins = np.ones(len(record), bool)  # pieces that begin a line
        begins[first] = False
        names = file.to_pylist()
        fresh = np.array([(names[k], start[k]) != ((names[k - 1], start[k - 1]) if k else at) for k in range(batch.num_rows)])
        ranges = first[fresh]  # pieces that begin a byte range
        if len(ranges) == 0 or ranges[0] > 0:
            ranges, carried = np.append(0, ranges), (line, field, own)
        else:
            carried = (0, 0, None)
        lines, fields, ids = np.empty(len(record), np.int64), np.empty(len(record), np.int64), np.empty(len(record), object)
        for a, b in zip(ranges, np.append(ranges[1:], len(record))):
            line, field, own = carried if a == ranges[0] else (0, 0, None)
            new = np.flatnonzero(begins[a:b])
            lines[a:b] = line + np.cumsum(begins[a:b])
            since = np.zeros(b - a, np.int64)
            since[new] = new
            since = np.maximum.accumulate(since)
            number = np.arange(b - a) - since
            number[: new[0] if len(new) else b - a] += field
            fields[a:b] = number
            names_of = np.append(own, np.array(text.slice(a, b - a).take(pa.array(new)).to_pylist(), object))
            ids[a:b] = names_of[np.cumsum(begins[a:b])]
            line, field, own = int(lines[b - 1]), int(number[-1]) + 1, names_of[-1]
        at = (names[-1], start[-1])
        where = pa.array(record)
        columns = [file.take(where), batch.column("start").take(where), pa.array(lines), pa.array(fields), pa.array(ids.tolist(), pa.string()), text]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "line", "field", "id", "text"])


def _beginnings(cells: DataFrame) -> DataFrame:
    """For each byte range: id, number of fields before, and first range and line of the line that goes on into it.  One
    row a range reaches the driver."""
    per_range = cells.groupBy(*_RANGE).agg(
        F.max(F.struct("line", "field", "id")).alias("last"),
        F.count_if(F.col("line") == 0).alias("n"),
        F.max(F.when((F.col("line") == 0) & (F.col("field") == 0), F.col("text"))).alias("first"),
    )
    out, before = [], None
    for r in per_range.orderBy(*_RANGE).collect():
        if before is None or before[0] != r.file or not before[2]:
            before = (r.file, r.first, 0, r.start, 0)  # a file begins a line
        out.append((r.file, r.start, before[1], before[2], before[3], before[4]))
        if r["last"]["line"]:
            before = (r.file, r["last"]["id"], r["last"]["field"] + 1, r.start, r["last"]["line"])
        else:
            before = (*before[:2], before[2] + r.n, *before[3:])
    return cells.sparkSession.createDataFrame(out, "file string, start long, id0 string, fields0 long, start0 long, line0 long")


def read_wide_table(
    spark: SparkSession,
    path: str,
    nrows: int | None = None,
    ncols: int | None = None,
    parse_field: Callable[[Column], Column] = to_double,
    skip_tokens: tuple[str, ...] = DENSE_SKIP_TOKENS,
    check: bool = True,
) -> DataFrame:
    """S3 for lines of any length: as :func:`read_dense_table`, with ``parse_field`` for one field.

    A record is the text between two tabs, so a line of 10^7 fields is as many records, which Spark reads from
    several byte ranges at once.  The cells are written once; every range's line ends (one row a range) tell which line and field
    its first record continues, and that small table is broadcast to the cells.
    """
    raw = spark.read.option("lineSep", "\t").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    ship_package(spark)
    cells = cut_lineage(raw.mapInArrow(_fields, _CELLS))
    goes_on = F.col("line") == 0
    placed = cells.join(F.broadcast(_beginnings(cells)), _RANGE).select(
        "file",
        F.when(goes_on, F.col("start0")).otherwise(F.col("start")).alias("start"),
        F.when(goes_on, F.col("line0")).otherwise(F.col("line")).alias("line"),
        F.when(goes_on, F.col("field") + F.col("fields0")).otherwise(F.col("field")).alias("field"),
        F.when(goes_on, F.col("id0")).otherwise(F.col("id")).alias("id"),
        "text",
    )
    key = ["file", "start", "line"]
    held = F.lit(False)
    for token in skip_tokens:
        held = held | F.col("text").contains(token)
    skipped = cut_lineage(placed.filter(held).select(*key).distinct())
    few = skipped.count() <= conf_int(spark, CONF_MAX_HOT_KEYS)
    kept = placed.join(F.broadcast(skipped) if few else skipped, key, "left_anti")
    values = kept.filter("field > 0").select(*key, _index(F.col("id"), 1).alias("i"), (F.col("field") - 1).alias("j"), parse_field(F.col("text")).alias("v"))
    if check and (nrows is not None or ncols is not None):
        lines = values.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("j").alias("j"))
        r = lines.agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
        require(nrows is None or r["n"] == nrows, f"dense file has {r['n']} rows, declared {nrows}")
        require(ncols is None or not r["n"] or r["lo"] == r["hi"] == ncols, f"dense file has {r['lo']}..{r['hi']} columns, declared {ncols}")
    return values.select("i", "j", "v")


def read_wide_genotypes(spark: SparkSession, path: str, nrows: int | None = None, ncols: int | None = None, missing: str = "zero") -> DataFrame:
    """S4 for lines of any length: as :func:`read_genotypes`."""
    t = read_wide_table(spark, path, nrows, ncols, lambda c: genotype(c, missing), ("Sample",))
    return t.select(F.col("i").alias("snp"), F.col("j").alias("sample"), F.col("v").cast("int").alias("g"))
