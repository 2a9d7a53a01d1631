"""Text reports, metadata and registries as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(texts: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, line_no, line) of each text."""
    return texts.select(*key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def table_rows(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cells of the ASCII tables in logs: (key, table_no, row_no, cells).

    A line belongs to a table if, without a logging prefix up to "PRINT ", it starts with a pipe or a plus sign; rules of
    plus signs are no rows. Tables are runs of such lines.
    """
    bare = F.trim(F.regexp_replace("line", "^.*PRINT ", ""))
    rows = lines.select(*key, "line_no", bare.alias("line")).withColumn("inside", F.col("line").startswith("|") | F.col("line").startswith("+"))
    order = Window.partitionBy(*key).orderBy("line_no")
    starts = F.when(F.col("inside") & ~F.coalesce(F.lag("inside").over(order), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("__new", starts).withColumn("table_no", F.sum("__new").over(order) - 1).where(F.col("inside") & F.col("line").startswith("|"))
    nth = F.row_number().over(Window.partitionBy(*key, "table_no").orderBy("line_no")) - 1
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select(*key, F.col("table_no").cast("long").alias("table_no"), nth.cast("long").alias("row_no"), cells.alias("cells"))


def unique_names(tables: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Names of tables made unique: the n-th of a name gets n underscores."""
    nth = F.row_number().over(Window.partitionBy(*key, name).orderBy("table_no")) - 1
    return tables.withColumn(name, F.concat(F.col(name), F.repeat(F.lit("_"), nth.cast("int"))))


def labelled_numbers(text: Column, labels: dict[str, str]) -> list[Column]:
    """The number that a pattern (its first group) finds in a text, by label; NA where there is none."""
    found = lambda pattern: F.regexp_extract(text, pattern, 1)
    return [F.when(found(p) == "", "NA").otherwise(found(p)).alias(label) for label, p in labels.items()]


def level_statistics(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Comparison statistics: lines such as "Base level: 77.0 | 80.1 |" to (key, level, sensitivity, precision, f1)."""
    rows = lines.where(F.col("line").contains("level:"))
    number = lambda k: F.trim(F.get(F.split(F.get(F.split("line", ":"), F.lit(1)), r"\|"), F.lit(k))).cast("double")
    named = rows.select(*key, F.lower(F.trim(F.regexp_replace(F.get(F.split("line", ":"), F.lit(0)), "level", ""))).alias("level"), number(0).alias("sensitivity"), number(1).alias("precision"))
    return named.withColumn("f1", 2 / (1 / F.col("sensitivity") + 1 / F.col("precision")))


def busco_counts(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lines of a count and a category; fractions are of the last category, which is the total."""
    pattern = r"^\s*([0-9]+)\s+(\S.*)$"
    rows = lines.where(F.col("line").rlike(pattern)).select(*key, "line_no", F.regexp_extract("line", pattern, 1).cast("long").alias("n"), F.trim(F.regexp_extract("line", pattern, 2)).alias("category"))
    last = F.last("n").over(Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("fraction", F.col("n") / last)


#: Lines of assembly and completeness reports, types of features and k-mers that are counted.
CONTIG_LIMITS = (0, 1000, 5000, 10000, 25000, 50000)
QUAST = (
    {f"# contigs (>= {n} bp)": "contigs" + (f"_gt_{n // 1000}k" if n else "") for n in CONTIG_LIMITS}
    | {f"Total length (>= {n} bp)": "total_len" + (f"_gt_{n // 1000}k" if n else "") for n in CONTIG_LIMITS}
    | {"Largest contig": "largest_contig", "GC (%)": "gc_content", "N50": "N50", "N75": "N75", "L50": "L50", "L75": "L75"}
)
BUSCO = {
    "Complete BUSCOs (C)": "busco_C",
    "Complete and single-copy BUSCOs (S)": "busco_S",
    "Complete and duplicated BUSCOs (D)": "busco_D",
    "Fragmented BUSCOs (F)": "busco_F",
    "Missing BUSCOs (M)": "busco_M",
}
GFF_TYPES = ("CDS", "exon", "five_prime_UTR", "three_prime_UTR", "gene", "mRNA")


def _named(label: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[label]


def quast_values(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, name, value) of the known lines of an assembly report: a label, a tab and a value."""
    cells = F.split(F.trim("line"), "\t")
    rows = lines.select(*key, _named(F.get(cells, F.lit(0)), QUAST).alias("name"), F.trim(F.get(cells, F.lit(1))).alias("value"))
    return rows.where("name is not null and value is not null")


def busco_values(lines: DataFrame, key: Sequence[str], kind: str, scale: bool = False) -> DataFrame:
    """(key, name, value) of a completeness summary; names end in its kind. scale: shares of the total, which the line
    that starts with "C:" gives last, to four places; no value without such a line."""
    bare = lines.select(*key, F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"))
    cells = F.split("line", "\t")
    total = F.max(F.when(F.col("line").startswith("C:") & (F.size(cells) == 1), F.regexp_extract("line", "([0-9]+)$", 1).try_cast("long"))).over(Window.partitionBy(*key))
    names = {label: f"{name}_{kind}" for label, name in BUSCO.items()}
    rows = bare.select(*key, _named(F.trim(F.get(cells, F.lit(1))), names).alias("name"), F.get(cells, F.lit(0)).alias("n"), total.alias("total"))
    value = F.format_string("%.4f", F.try_divide(F.col("n").try_cast("double"), F.col("total"))) if scale else F.col("n")
    return rows.where("name is not null").select(*key, "name", F.when(F.lit(not scale) | (F.col("total") > 0), value).alias("value"))


def gff_type_counts(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, name, value) of lines of a count, a space and a type of feature; types that a report lacks count 0."""
    cells = F.split(F.trim("line"), " +")
    counted = lines.groupBy(*key).agg(*[F.max(F.when(F.get(cells, F.lit(1)) == name, F.get(cells, F.lit(0)))).alias(name) for name in GFF_TYPES])
    return counted.na.fill("0", list(GFF_TYPES)).unpivot(list(key), list(GFF_TYPES), "name", "value")


def mer_values(lines: DataFrame, key: Sequence[str], total: DataFrame | None = None) -> DataFrame:
    """(key, name, value) of lines of a count, a tab and a k-mer. total: (key, total_len), for shares to four places."""
    cells = F.split(F.trim("line"), "\t")
    rows = lines.select(*key, F.get(cells, F.lit(1)).alias("name"), F.get(cells, F.lit(0)).alias("value")).where("name is not null")
    if total is None:
        return rows
    share = F.format_string("%.4f", F.try_divide(F.col("value").try_cast("double"), F.col("total_len").cast("double")))
    return rows.join(total.select(*key, "total_len"), list(key)).select(*key, "name", share.alias("value"))


def logged_scores(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """F1 by class in the score tables of evaluation logs (those whose first row names a Precision): (key, table_no, row_no,
    name, f1). Tables are numbered from 0 in each log, other tables included."""
    rows = table_rows(lines, key)
    scored = F.max(F.when((F.col("row_no") == 0) & F.exists("cells", lambda c: c == "Precision"), True)).over(Window.partitionBy(*key, "table_no"))
    named = rows.withColumn("__scored", scored).where("__scored and row_no > 0")
    return named.select(*key, "table_no", "row_no", F.get("cells", F.lit(0)).alias("name"), F.get("cells", F.lit(3)).try_cast("double").alias("f1"))


def logged_accuracies(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, nth, accuracy): the last number of each line of total accuracy, in order."""
    rows = lines.where(F.lower("line").contains("total acc"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("line_no")) - 1
    return rows.select(*key, nth.cast("long").alias("nth"), F.regexp_extract("line", r"([0-9.]+)\s*$", 1).try_cast("double").alias("accuracy"))


def position_scores(lines: DataFrame, key: Sequence[str], name: str = "genic") -> DataFrame:
    """(key, nth, f1, accuracy) of a log with one table of a class's scores for each block of positions: the n-th row of
    that name, and the total accuracy two lines below it."""
    order = Window.partitionBy(*key).orderBy("line_no")
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    accuracy = F.regexp_extract(F.lead("line", 2).over(order), r"([0-9.]+)\s*$", 1).try_cast("double")
    rows = lines.select(*key, "line_no", cells.alias("cells"), accuracy.alias("accuracy")).where((F.get("cells", F.lit(0)) == "") & (F.get("cells", F.lit(1)) == name))
    return rows.select(*key, (F.row_number().over(order) - 1).cast("long").alias("nth"), F.get("cells", F.lit(4)).try_cast("double").alias("f1"), "accuracy")


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns to rows of name and value."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), "name", "value")


def pivot(df: DataFrame, rows: Sequence[str], names: str, values: Sequence[str], value: str) -> DataFrame:
    """One column for each of the names listed; null where a row has none. The names are given, so no job looks for them."""
    return df.groupBy(*rows).pivot(names, list(values)).agg(F.first(value))


def by_priority(registry: DataFrame, lineage: Sequence[str], n: int, order: Sequence) -> DataFrame:
    """The n models that come first in each lineage."""
    nth = F.row_number().over(Window.partitionBy(*lineage).orderBy(*order))
    return registry.withColumn("rank", nth.cast("long")).where(F.col("rank") <= n)


def current_models(registry: DataFrame, present: DataFrame, model: str = "model") -> DataFrame:
    """Models present, with whether the registry knows them, and whether a better one of their lineage exists."""
    best = registry.withColumn("best", F.min("priority").over(Window.partitionBy("lineage")))
    known = present.join(best.select(model, "lineage", "priority", "best"), model, "left")
    return known.select(model, F.col("priority").isNotNull().alias("recognized"), F.coalesce(F.col("priority") > F.col("best"), F.lit(False)).alias("better_exists"))


def phase_name(name: Column) -> Column:
    """Name of the phase data set beside a class data set."""
    return F.regexp_replace(name, "/y$", "/phases")


def stem(path: Column) -> Column:
    """File name without its ending."""
    return F.get(F.split(F.element_at(F.split(path, "/"), -1), r"\."), F.lit(0))
