"""Raw CSV -> typed Parquet cleaning job.

Column-name rules run on metadata only. Content rules (timestamps, duplicate columns,
numeric coercion) need statistics, so the job is two passes over the data: one wide
aggregate collects per-column statistics (a few numbers per column), then one projection
writes the typed table. Rows that do not fit the header go to a quarantine, counted.
"""

from __future__ import annotations

import csv
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.stages import written

c = F.col

# Delimiters tried when sniffing, and timestamp layouts tried in order: fixed values.
DELIMITERS = [",", ";", "\t", "|"]
TIMESTAMP_FORMATS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][XXX]",
                     "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm[XXX]", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm",
                     "dd/MM/yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy"]
TIME_NAME = re.compile(r"time|timestamp|date|arrival")
# Canonical quantity names, by the parts that a column's name must hold besides "qty" or "quantity": fixed values.
QTY_CANONICAL = {
    "qty_dispatched": "dispatch",
    "quantity_sold": "sold",
    "qty_returned": "return",
    "qty_waste": "waste",
}
QUARANTINE = "_corrupt_row"


def standardize_name(name: str) -> str:
    """Trim; each newline, space, '-' and '.' -> '_'; other symbols go; letters of any script stay; lower case."""
    s = re.sub(r"[\n\r\s\-.]", "_", name.strip())
    return re.sub(r"[^\w]", "", s).lower()


def unique_names(names: list[str]) -> list[str]:
    """A repeated name gets the next free suffix _n."""
    taken, counts, out = set(names), {}, []
    used: set[str] = set()
    for n in names:
        new = n
        while new in used or (new != n and new in taken):
            counts[n] = counts.get(n, 0) + 1
            new = f"{n}_{counts[n]}"
        used.add(new)
        out.append(new)
    return out


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that occurs most often in the first lines of a file."""
    counts = {d: sum(line.count(d) for line in lines) for d in DELIMITERS}
    return max(DELIMITERS, key=lambda d: (counts[d], -DELIMITERS.index(d)))


def _header(line: str, sep: str) -> tuple[str, ...]:
    """Names of a header line; unique without regard to case, as columns must be."""
    names = [n or f"column_{i}" for i, n in enumerate(next(csv.reader([line.lstrip("\ufeff")], delimiter=sep)))]
    return tuple(names if len({n.lower() for n in names}) == len(names) else unique_names([n.lower() for n in names]))


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """The CSV files of a folder (or the one file), by name. Metadata only."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return [path]
    names = [f.getPath().toString() for f in fs.listStatus(p) if f.isFile()]
    return sorted(n for n in names if n.lower().endswith(".csv"))


def read_csv(spark: SparkSession, path: str, sep: str | None = None, lines: int = 5) -> DataFrame:
    """One file or a folder of files with the same header; the delimiter is sniffed for each file.

    All columns are strings. A row with another number of fields than the header keeps its
    text in ``_corrupt_row``, where ``split_malformed`` finds it; none is dropped here.
    """
    by: dict[tuple, list[str]] = {}
    for f in csv_files(spark, path):
        head = [r.value for r in spark.read.text(f).limit(lines).collect()]  # a few lines of a file
        if head:
            d = sep or sniff_delimiter(head)
            by.setdefault((d, _header(head[0], d)), []).append(f)
    out = None
    for (d, names), files in by.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, QUARANTINE)])
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", d).option("mode", "PERMISSIVE").option("columnPruning", False)
              .option("columnNameOfCorruptRecord", QUARANTINE).csv(files))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no CSV file with a header in {path}")
    return out


def split_malformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the header, the texts of the others beside their first field: a reader
    cannot be asked for the texts alone)."""
    if QUARANTINE not in df.columns:
        return df, df.select(F.lit(None).cast("string").alias(QUARANTINE)).limit(0)
    # Always true, but it names another column, which the reader asks for even of a count.
    first = F.length(F.concat_ws("", c(f"`{df.columns[0]}`"))) >= 0
    return df.where(c(QUARANTINE).isNull() & first).drop(QUARANTINE), df.where(c(QUARANTINE).isNotNull()).select(QUARANTINE, df.columns[0])


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([standardize_name(n) for n in df.columns]))


def unify_qty_names(df: DataFrame) -> DataFrame:
    """The first quantity column whose name holds a canonical name's part takes that name."""
    ren, cols = {}, list(df.columns)
    for canon, part in QTY_CANONICAL.items():
        if canon in cols:
            continue
        for v in cols:
            if ("qty" in v or "quantity" in v) and part in v and v not in ren and v not in QTY_CANONICAL:
                ren[v] = canon
                break
    return df.withColumnsRenamed(ren) if ren else df


def _may_be(x, fmt: str):
    """Whether a text holds what each text of that layout holds: a failed parse costs far more than this."""
    sep = fmt[4] if fmt.startswith("yyyy") else fmt[2]
    # The first separator comes after the year's four digits (and perhaps a sign), or after two digits.
    ok = F.instr(F.substring(x, 2, 1_000_000), sep) >= (4 if fmt.startswith("yyyy") else 2)
    if "HH:" in fmt:
        ok = ok & F.contains(x, F.lit(":"))
    return ok & F.contains(F.upper(x), F.lit("T")) if "'T'" in fmt else ok


def _timestamp(name: str):
    return F.coalesce(*[F.when(_may_be(c(name), fmt), F.try_to_timestamp(c(name), F.lit(fmt))) for fmt in TIMESTAMP_FORMATS])


def _number(name: str):
    return F.regexp_replace(c(name), ",", "").try_cast(T.DoubleType())


def parse_timestamps(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """A string column whose name tells of a time becomes a timestamp if more than
    ``threshold`` of its values parse as one and they are no numbers; else it stays."""
    names = [f.name for f in df.schema.fields if TIME_NAME.search(f.name) and isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    filled = lambda n: c(n).isNotNull() & (F.trim(c(n)) != "")
    rates = df.agg(*[F.avg(F.when(filled(n), _timestamp(n).isNotNull().cast("double"))).alias(f"t{i}") for i, n in enumerate(names)],
                   *[F.avg(F.when(filled(n), _number(n).isNotNull().cast("double"))).alias(f"n{i}") for i, n in enumerate(names)]).first()
    out = {n: _timestamp(n) for i, n in enumerate(names) if (rates[f"t{i}"] or 0) > threshold and (rates[f"n{i}"] or 0) <= threshold}
    return df.withColumns(out) if out else df


def drop_suffixed_duplicates(df: DataFrame) -> DataFrame:
    """A column ``x_n`` whose values equal those of ``x`` in every row is dropped."""
    pairs = [(m[1], n) for n in df.columns if (m := re.fullmatch(r"(.+)_\d+", n)) and m[1] in df.columns]
    if not pairs:
        return df
    same = df.agg(*[F.count_if(~c(a).cast("string").eqNullSafe(c(b).cast("string"))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first()
    return df.drop(*[b for i, (_, b) in enumerate(pairs) if same[f"d{i}"] == 0])


def resolve_column(df: DataFrame, *candidates: str) -> str | None:
    """The first column that has one of the names, else that holds one of them."""
    names = {n.lower(): n for n in df.columns}
    for k in candidates:
        if k.lower() in names:
            return names[k.lower()]
    return next((n for k in candidates for low, n in names.items() if k.lower() in low), None)


def column_statistics(df: DataFrame) -> dict:
    """One aggregate: per string column the share of rows that parse as a number
    (commas stripped, NULLs count against), and per column (count, hash sum)
    fingerprints used to find duplicate columns."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for n in strings:
        aggs.append(F.avg(_number(n).isNotNull().cast("double")).alias(f"num__{n}"))
    for n in df.columns:
        aggs.append(F.count(c(n)).alias(f"cnt__{n}"))
        aggs.append(F.sum(F.xxhash64(c(n).cast("string")) % F.lit(1 << 40)).alias(f"hash__{n}"))
    return df.agg(*aggs).first().asDict()


def drop_duplicate_columns(df: DataFrame, stats: dict) -> DataFrame:
    """Columns with identical content (NULL-safe, every row) are dropped,
    keeping the first. Fingerprints select candidates; one more aggregate
    confirms them, comparing values within the same row."""
    cols = df.columns
    cands = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]
             if stats[f"cnt__{a}"] == stats[f"cnt__{b}"] and stats[f"hash__{a}"] == stats[f"hash__{b}"]]
    if not cands:
        return df
    chk = df.agg(*[F.count_if(~c(a).cast("string").eqNullSafe(c(b).cast("string"))).alias(f"{a}__{b}")
                   for a, b in cands]).first().asDict()
    drop = sorted({b for a, b in cands if chk[f"{a}__{b}"] == 0})
    return df.drop(*drop)


def numeric_coerce(df: DataFrame, stats: dict, threshold: float = 0.9) -> DataFrame:
    """String columns where more than ``threshold`` of all rows parse -> double."""
    out = {}
    for f in df.schema.fields:
        key = f"num__{f.name}"
        if key in stats and stats[key] is not None and stats[key] > threshold:
            out[f.name] = _number(f.name)
    return df.withColumns(out) if out else df


def clean_table(df: DataFrame) -> DataFrame:
    """Names -> unique -> quantities -> timestamps -> duplicates -> numeric."""
    # The texts are split into columns once: the passes of the statistics read the columns they need.
    df = written(clean_names(split_malformed(df)[0]), "raw-columns")
    df = drop_suffixed_duplicates(parse_timestamps(unify_qty_names(df)))
    stats = column_statistics(df)
    df = drop_duplicate_columns(df, stats)
    return numeric_coerce(df, stats)


def clean_csv_to_parquet(spark: SparkSession, src: str, dst: str, partition_by: str | None = None,
                         quarantine: str | None = None) -> DataFrame:
    """One raw CSV location -> cleaned Parquet (optionally partitioned); malformed rows to ``quarantine``."""
    good, bad = split_malformed(read_csv(spark, src))
    bad.write.mode("overwrite").parquet(quarantine or dst.rstrip("/") + "_quarantine")
    df = clean_table(good)
    w = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(dst)
    return spark.read.parquet(dst)


def clean_folder(spark: SparkSession, src: str, dst: str) -> list[tuple[str, str]]:
    """Each CSV file of a folder into its own Parquet table; (file, "ok" or the error) of each.
    A file that fails does not stop the others."""
    out = []
    for f in csv_files(spark, src):
        name = standardize_name(os.path.splitext(os.path.basename(f))[0])
        try:
            clean_csv_to_parquet(spark, f, os.path.join(dst, name))
            out.append((f, "ok"))
        except Exception as e:  # reported to the caller, file by file
            out.append((f, f"{type(e).__name__}: {e}"[:300]))
    return out
