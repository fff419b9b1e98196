"""Readers: host snapshots, certificate archives, and tolerant JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keylake.functions.keys import hex_canon
from keylake.operators.relations import upsert


def parse_hosts(lines: DataFrame, layout: str = "ragged", line_col: str = "value") -> DataFrame:
    """(ip, fprint) of lines `ip,fp,fp,...`, or `ip,x,fp` for layout col2; fingerprints in canonical case, without prefix."""
    parts = F.transform(F.split(line_col, ","), lambda x: F.trim(x))
    prints = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))) if layout == "ragged" else F.slice(parts, 3, 1)
    prints = F.filter(prints, lambda x: x != "")
    return lines.select(*[c for c in lines.columns if c != line_col], parts[0].alias("ip"), F.explode(prints).alias("fprint")).withColumn("fprint", F.regexp_replace(F.lower("fprint"), r"^(0x|\\x)", ""))


def read_hosts(spark: SparkSession, paths: list[str] | str, layout: str = "ragged") -> DataFrame:
    return parse_hosts(spark.read.text(paths).withColumn("file", F.col("_metadata.file_name")), layout)


def parse_archive(lines: DataFrame, encoding: str = "base64", line_col: str = "value") -> DataFrame:
    """(fprint, der) of lines `fp,payload`; der is null for a payload that does not decode or is missing."""
    parts = F.split(line_col, ",", 2)
    return lines.select(F.lower(F.trim(parts[0])).alias("fprint"), F.try_to_binary(F.trim(F.try_element_at(parts, F.lit(2))), F.lit(encoding)).alias("der"))


def read_cert_archive(spark: SparkSession, paths: list[str] | str, encoding: str = "base64") -> DataFrame:
    return parse_archive(spark.read.text(paths), encoding)


def read_json_tolerant(lines: DataFrame, schema: str, line_col: str = "value", id_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows of lines that are JSON objects of this schema, and the other lines with their serial slice.

    With id_col one row of each id is good, any one of equal ids, and rows with null id all stay. A field that is null or
    missing does not make a line bad. A null line is bad.
    """
    parsed = lines.withColumn("__row", F.from_json(line_col, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    is_bad = F.col("__row").isNull() | F.col("__row.__bad").isNotNull()
    good = parsed.where(~is_bad).select("__row.*").drop("__bad")
    if id_col:
        good = good.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(good.where(F.col(id_col).isNull()))
    bad = parsed.where(is_bad).select(F.substring(line_col, 9, 11).alias("serial"), F.col(line_col).alias("line"))
    return good, bad


def anchors(html: Column) -> Column:
    """href values of a page's anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), 1)


def read_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, fetch: int = 10_000) -> DataFrame:
    """A database table, read in ranges of its key."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, fetchsize=fetch).load()


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines without null fields."""
    df.write.option("ignoreNullFields", "true").json(path)


def write_cert_archive(df: DataFrame, path: str) -> None:
    """gzip lines `fp,base64`, in order of fingerprint over all files; base64 comes in lines, which are joined."""
    lines = df.repartitionByRange("fprint").sortWithinPartitions("fprint").select(F.concat("fprint", F.lit(","), F.translate(F.base64("der"), "\r\n", "")).alias("value"))
    lines.write.option("compression", "gzip").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.option("sep", ";").option("header", "true").csv(path)


def write_split(df: DataFrame, path: str, column: str = "flagged") -> None:
    df.write.partitionBy(column).parquet(path)


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of several text files or folders, with their place: file_ord, the place in the list of the path that gave them,
    then file and start, the block of the file, and line_ord, the line's place in that block. In order of these columns the
    files read as one.
    """
    where = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    parts = [spark.read.text(p).select("value", F.lit(k).alias("file_ord"), *where) for k, p in enumerate(paths)]
    # ids rise along a partition, which reads each of its blocks from the first line to the last
    return reduce(DataFrame.unionByName, parts).withColumn("line_ord", F.monotonically_increasing_id())


def first_field(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """The distinct first fields of comma-separated lines."""
    return lines.select(F.trim(F.split(line_col, ",", 2)[0]).alias("ip")).distinct()


def id_array(df: DataFrame, json_col: str) -> DataFrame:
    """Distinct ids of JSON arrays of texts."""
    return df.select(F.explode(F.from_json(json_col, "array<string>")).alias("id")).distinct()


def select_inputs(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Sorted paths of the files below a folder whose names end so."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return found.select("path", "length").orderBy("path")


def maven_index(df: DataFrame, base: str) -> DataFrame:
    """(group, artifact, version, pom_url) of sitemap rows (url, artifact_detected, versions array of (v, l))."""
    rows = df.where("artifact_detected and size(versions) > 0").select("url", F.explode("versions").alias("x"))
    s = F.filter(F.split(F.replace("url", F.lit(base), F.lit("")), "/"), lambda p: p != "")
    artifact, version = F.element_at(s, -1), F.col("x.v")
    pom = F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/"), version, F.lit("/"), artifact, F.lit("-"), version, F.lit(".pom"))
    return rows.select(F.array_join(F.slice(s, F.lit(1), F.size(s) - 1), ".").alias("group"), artifact.alias("artifact"), version.alias("version"), pom.alias("pom_url"))


def flatten(df: DataFrame, json_col: str, schema: str, fields: dict[str, str], dates: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows of JSON arrays of objects: fields maps a column to its path in an object, dates become UTC times."""
    kept = [c for c in df.columns if c != json_col]
    rows = df.select(*kept, F.explode(F.from_json(json_col, f"array<struct<{schema}>>")).alias("__o"))
    value = lambda name, at: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.col(f"__o.{at}"), "T", " "), "Z$", "")) if name in dates else F.col(f"__o.{at}")
    return rows.select(*kept, *[value(name, at).alias(name) for name, at in fields.items()])


def write_sorted_list(df: DataFrame, column: str, path: str) -> None:
    """One sorted column as text, in order over all files."""
    text = df.select(F.col(column).cast("string").alias("value"))
    text.repartitionByRange("value").sortWithinPartitions("value").write.text(path)


def write_levels(df: DataFrame, path: str, column: str = "level") -> None:
    df.write.partitionBy(column).parquet(path)


def consolidate(spark: SparkSession, paths: list[str] | str, out: str, files: int) -> None:
    """Small line files as fewer larger ones."""
    spark.read.text(paths).coalesce(files).write.text(out)


def run_once(df: DataFrame, path: str) -> DataFrame:
    """The Parquet table at path, written from df only if it is not complete there: if it lacks the mark of a finished write."""
    spark = df.sparkSession
    if not _exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Is there such a file, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_table(df: DataFrame, url: str, name: str, batch: int = 10_000) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=batch).mode("append").save()


def append_errors(df: DataFrame, path: str, text: str = "error") -> None:
    """Distinct errors of a batch, by digest, appended as JSON lines."""
    df.withColumn("err_md5", F.md5(F.col(text).cast("binary"))).dropDuplicates(["err_md5"]).write.mode("append").json(path)


def export_ssh_keys(df: DataFrame) -> DataFrame:
    """(source, n, e, added): classification records of stored keys, times as seconds since 1970."""
    return df.select(F.array("id").alias("source"), hex_canon(F.col("mod")).alias("n"), "e", F.unix_timestamp("added_at").alias("added"))


def copy_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, out: str) -> None:
    """A database table as Parquet, read in ranges of its key."""
    read_table(spark, url, name, key, low, high, parts).write.mode("overwrite").parquet(out)


def merge_table(current: DataFrame, new: DataFrame, keys: list[str], path: str) -> DataFrame:
    """A copied table brought up to date: rows of new replace those with their keys, others stay; written to path as a whole.

    path is a new folder, as current may still be read from the old one. Of new rows with equal keys any one is taken.
    """
    upsert(current, new.dropDuplicates(keys), keys).write.parquet(path)
    return new.sparkSession.read.schema(current.schema).parquet(path)


def run_stats(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """df and an observation that holds the aggregates once an action on df has run."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen
