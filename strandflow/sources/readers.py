"""Readers."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandflow.operators import pieces
from strandflow.operators.dataset import require_unique

GFF_SCHEMA = "seqid string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string"
#: Bits of an alignment's flag.
PAIRED, UNMAPPED, REVERSE, SECOND, SECONDARY, QCFAIL = 0x1, 0x4, 0x10, 0x80, 0x100, 0x200


def fasta(spark: SparkSession, path: str | Sequence[str], unique: bool = True) -> DataFrame:
    """(seqid, sequence), upper case; an error for a seqid that occurs twice, if unique. Records are split at ">" lines,
    so one large file is read by many tasks."""
    records = spark.read.option("lineSep", "\n>").text(path)
    whole = F.regexp_replace("value", "^>", "")
    head = F.split(whole, "\n", 2)
    rows = records.where(F.trim("value") != "").select(
        F.get(F.split(F.trim(F.get(head, F.lit(0))), r"\s+"), F.lit(0)).alias("seqid"),
        F.upper(F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s+", "")).alias("sequence"),
    )
    return require_unique(rows, ["seqid"]) if unique else rows


def fasta_pieces(spark: SparkSession, path: str | Sequence[str], size: int = 1 << 20) -> DataFrame:
    """(seqid, piece, offset, bases), upper case, with `size` bases in each piece but a record's last: no record is ever a row.

    Lines are numbered within the blocks of bytes in which tasks read them; of each block only the last name and the numbers of
    bases before and after its names go into the order of blocks, which tells every block what record and place it begins at.
    A name that occurs in several records gives pieces that overlap; `pieces.lengths` and a count tell.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    name = F.when(F.startswith("value", F.lit(">")), F.get(F.split(F.trim(F.substring("value", 2, 1 << 20)), r"\s+"), F.lit(0)))
    bases = F.when(name.isNull(), F.upper(F.regexp_replace("value", r"\s+", ""))).otherwise("")
    rows = lines.select("file", "block", "line", name.alias("name"), bases.alias("bases"))
    within = Window.partitionBy("file", "block").orderBy("line")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select("*", F.last("name", ignorenulls=True).over(upto).alias("own"), F.count("name").over(upto).alias("nth"), F.length("bases").cast("long").alias("n"))
    runs = placed.groupBy("file", "block", "nth").agg(F.max("own").alias("own"), F.sum("n").alias("n"))
    last = runs.groupBy("file", "block").agg(F.max_by(F.struct("own", "n"), "nth").alias("last"))
    # A block without a name goes on with the record before it: its bases are added up from the last block that has one.
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    named = last.select("file", "block", "last.own", "last.n", F.count("last.own").over(order).alias("group"), F.last("last.own", ignorenulls=True).over(order).alias("name"))
    summed = named.withColumn("sum", F.sum("n").over(Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("file").orderBy("block")
    carried = summed.select("file", "block", F.lag("name").over(before).alias("b_name"), F.coalesce(F.lag("sum").over(before), F.lit(0)).alias("b_bases"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("file", "block", "nth").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = placed.withColumn("ahead", ahead).join(carried, ["file", "block"])
    offset = F.col("ahead") + F.when(F.col("nth") == 0, F.col("b_bases")).otherwise(0)
    parts = found.where("n > 0").select(F.coalesce("own", "b_name").alias("seqid"), offset.alias("offset"), "bases")
    return pieces.joined(parts, ["seqid"], size)


def gff3(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The nine columns, with attributes as a map."""
    rows = spark.read.schema(GFF_SCHEMA).csv(path, sep="\t", comment="#", quote="")
    return rows.where("type is not null").withColumn("attributes", F.str_to_map("attributes", F.lit(";"), F.lit("=")))


def features_of(gff: DataFrame) -> DataFrame:
    """GFF rows (from 1, inclusive) as features: plus [start - 1, end), minus from end - 1 down to start - 2."""
    plus = F.col("strand") == "+"
    return gff.select(
        "seqid",
        plus.alias("is_plus"),
        F.when(plus, F.col("start") - 1).otherwise(F.col("end") - 1).alias("start"),
        F.when(plus, F.col("end")).otherwise(F.col("start") - 2).alias("end"),
        F.when(F.col("type") == "CDS", "cds").when(F.col("type") == "mRNA", "transcript").otherwise(F.col("type")).alias("type"),
        F.col("phase").try_cast("int").alias("phase"),
        F.col("attributes")["Parent"].alias("parent"),
    )


def _bit(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def sam(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Alignments, with positions from 0."""
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))
    flag = at(1).cast("int")
    return spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        at(0).alias("qname"),
        at(2).alias("seqid"),
        (at(3).cast("long") - 1).alias("pos"),
        (~_bit(flag, REVERSE)).alias("is_plus"),
        at(5).alias("cigar"),
        _bit(flag, PAIRED).alias("paired"),
        _bit(flag, SECOND).alias("second"),
        _bit(flag, UNMAPPED).alias("unmapped"),
        _bit(flag, SECONDARY).alias("secondary"),
        _bit(flag, QCFAIL).alias("qcfail"),
    )


def sam_lengths(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(seqid, length) from the header."""
    rows = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return rows.select(F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("seqid"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("long").alias("length"))


def mer_counts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Counts of k-mers by sequence from tab-separated files with a header: (seqid, mer, n)."""
    return spark.read.schema("seqid string, mer string, n bigint, rest string").csv(path, sep="\t", header=True).drop("rest")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A list of models: CSV with a header, and comments after #."""
    rows = spark.read.csv(path, header=True, comment="#")
    return rows.withColumn("priority", F.col("priority").cast("int")).withColumn("available_since", F.to_date("available_since", "yyyy/MM/dd"))


def chunk_files(spark: SparkSession, paths: Sequence[str], array: str = "x") -> DataFrame:
    """Chunks of several files, each row with its file; an error unless all have arrays of one length."""
    rows = spark.read.parquet(*paths)
    sizes = rows.select(F.size(array).alias("size")).distinct().limit(2).collect()
    if len(sizes) != 1:
        raise ValueError(f"chunks of one size were expected, not {[r['size'] for r in sizes]}")
    return rows.select("*", F.col("_metadata.file_path").alias("file"))


def chunk_sets(spark: SparkSession, folder: str, array: str = "x") -> tuple[DataFrame, DataFrame]:
    """Training and validation chunks: the data sets in a folder named training_data… and validation_data…; an error if
    there is none of either, or if their chunks differ in size."""
    found = []
    for kind in ("training", "validation"):
        try:
            found.append(chunk_files(spark, [f"{folder}/{kind}_data*"], array))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                raise
            raise ValueError(f"no {kind} data found in {folder}") from e
    return found[0], found[1]


def reports(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Whole text reports with the file they come from, and the two folders above it."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    parts = F.split("file", "/")
    return rows.select("*", F.element_at(parts, -3).alias("species"), F.element_at(parts, -2).alias("method"))


class SqliteTable(DataSource):
    """A table of an annotation database, read by ranges of row ids. Options: path, table, partitions.

    The file must be where every executor can open it.
    """

    @classmethod
    def name(cls) -> str:
        return "annotation_db"

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "FLOAT": "double", "REAL": "double", "BOOLEAN": "boolean"}
        with self._connect() as con:
            columns = con.execute("SELECT name, type FROM pragma_table_info(?)", [self.options["table"]]).fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{name}` {kinds.get(kind.upper(), 'string')}" for name, kind in columns)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, source: SqliteTable, schema):
        self.source, self.fields = source, [(f.name, f.dataType.typeName()) for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        n = int(self.source.options.get("partitions", "4"))
        with self.source._connect() as con:
            low, high = con.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.source.options["table"]}"').fetchone()
        step = max(1, -(-(high - low + 1) // n))
        return [InputPartition((a, min(a + step, high + 1))) for a in range(low, high + 1, step)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f'"{n}"' for n, _ in self.fields)
        with self.source._connect() as con:
            for row in con.execute(f'SELECT {names} FROM "{self.source.options["table"]}" WHERE rowid >= ? AND rowid < ?', partition.value):
                yield tuple(bool(v) if kind == "boolean" and v is not None else v for v, (_, kind) in zip(row, self.fields, strict=True))


def annotation_table(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    return spark.read.format("annotation_db").options(path=path, table=table, partitions=str(partitions)).load()
