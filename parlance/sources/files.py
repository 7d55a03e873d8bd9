"""Scans of transcript files, tables and norms, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.headers import number
from parlance.operators.merge import first_per_stem, synonyms


def stem(path: str | Column) -> Column:
    """The file name without folders and its last extension."""
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]+?)(\.[^./]+)?$", 1)


def recordings(spark: SparkSession, roots: list[str], pattern: str = "*.cha") -> DataFrame:
    """(patient_id, path, text): whole files under ``roots``, the first path of each stem."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(roots, wholetext=True)
    rows = rows.select(stem(F.col("_metadata.file_path")).alias("patient_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.join(first_per_stem(rows.select("patient_id", "path"), "patient_id", "path"), ["patient_id", "path"], "left_semi")


def file_index(spark: SparkSession, roots: list[str], extensions: tuple[str, ...]) -> DataFrame:
    """(stem, path, length) of files with these extensions; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "length")
    return files.filter(F.lower("path").rlike(r"\.(" + "|".join(x.lstrip(".") for x in extensions) + ")$")).select(stem("path").alias("stem"), "path", "length")


def table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """A CSV or TSV table with a header; NaN is null in every double column."""
    reader = spark.read.option("header", True).option("sep", sep).option("nanValue", "")
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return nan_to_null(rows)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def first_table(spark: SparkSession, folder: str, names: list[str], sep: str = "\t") -> DataFrame:
    """The first of ``names`` that ``folder`` has."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(conf).exists(path):
            return table(spark, f"{folder}/{name}", sep=sep)
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")


def numeric(df: DataFrame, columns: list[str], default: float | None = None) -> DataFrame:
    """Columns as doubles, what is no number null or ``default``."""
    return df.withColumns({c: F.coalesce(number(F.col(c).cast("string")), F.lit(default).cast("double")) for c in columns})


#: Kind of norm -> (file, names of its value column).
NORM_FILES = {
    "freq": ("SUBTLEX-US.csv", ["lg10wf", "zipfus"]),
    "aoa": ("Brysbaert_AoA.csv", ["aoa"]),
    "img": ("Brysbaert_Imageability.csv", ["img"]),
    "fam": ("Brysbaert_Familiarity.csv", ["fam"]),
}


def norms(spark: SparkSession, folder: str, files: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """(kind, word, value) of all the norm files that are there; none at all is an error."""
    out, have = spark.createDataFrame([], "kind string, word string, value double"), 0
    for kind, (name, values) in (files or NORM_FILES).items():
        try:
            rows = first_table(spark, folder, [name], sep=",")
        except FileNotFoundError:
            continue
        have += 1
        found = synonyms(rows, {"word": ["word", "words"], "value": values})
        out = out.unionByName(found.select(F.lit(kind).alias("kind"), F.lower("word").alias("word"), number(F.col("value")).alias("value")))
    if not have:
        raise FileNotFoundError(f"no norms in {folder}")
    return out.filter("value is not null")


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the lines that are neither blank nor comments (#)."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> '' and name not like '#%'")


def write_table(df: DataFrame, path: str, key: str | None = None, form: str = "parquet") -> None:
    """One table; rows sorted by ``key`` within files that hold ranges of it."""
    rows = df.repartitionByRange(key).sortWithinPartitions(key) if key else df
    rows.write.mode("overwrite").option("header", True).format(form).save(path)


def write_by(df: DataFrame, column: str, path: str, form: str = "parquet") -> None:
    """A folder for each value of ``column``."""
    df.write.mode("overwrite").option("header", True).partitionBy(column).format(form).save(path)


def append_record(record: DataFrame, path: str, form: str = "json") -> None:
    """A file more in the log's folder; in ``csv`` a map is its JSON text."""
    if form == "csv":
        record = record.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in record.schema])
    record.coalesce(1).write.mode("append").option("header", True).option("escape", '"').format(form).save(path)


def read_records(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """The log that append_record() wrote, by its schema."""
    if form != "csv":
        return spark.read.schema(schema).format(form).load(path)
    fields = T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.MapType) else f.dataType) for f in fields])
    rows = spark.read.schema(text).option("header", True).option("escape", '"').csv(path)
    return rows.select(*[F.from_json(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in fields])


def write_transcripts(rendered: DataFrame, key: str, path: str) -> None:
    """A folder for each ``key`` with its rendered text."""
    rendered.select(key, "value").write.mode("overwrite").partitionBy(key).text(path)
