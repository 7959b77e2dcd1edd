"""Sectioned CSV statements: ``Section,Header|Data,field,...``.

A header row names the fields of the data rows after it, per file and section. The lines stay
a DataFrame throughout; the newest header above each row is found with a block scan, so one
very long file is still read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.operators.calendars import exchange_local_to_utc
from quantframe.operators.scan import block_scan

BLOCK_LINES = 4096
#: One cell and the comma that ends it; quotes may hold commas and doubled quotes.
_CELL = r'("(?:[^"]++|"")*+"|[^",]*+),'
#: The first two cells of a line, without the others.
_FIRST_TWO = f"(?s){_CELL}.*?{_CELL}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of statement files with an order inside each file.

    Files are split like any text input; the split's byte offset is the block and the row
    order inside the split is the position.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.rtrim("value").alias("line"),
    ).filter("line <> ''")


def number(value: Column | str) -> Column:
    """A number that may carry thousands separators."""
    v = F.col(value) if isinstance(value, str) else value
    return F.replace(v, F.lit(","), F.lit("")).cast("double")


def _bare(c: Column) -> Column:
    """A cell without its quotes; null if empty."""
    inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.nullif(F.when(c.startswith('"'), inner).otherwise(c), F.lit(""))


def split_cells(line: Column) -> Column:
    """The cells of a CSV line of any width, unquoted; empty ones are null."""
    cells = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(_CELL), F.lit(1))
    return F.transform(cells, _bare)


def _once(value: Column) -> Column:
    """As a generated column: later filters stay above it, so that it is worked out once a row."""
    return F.explode(F.array(value))


def _values() -> Column:
    """The fields of a row by name."""
    pairs = F.filter(
        F.arrays_zip(
            F.col("names").alias("k"),
            F.slice("cells", 3, F.greatest(F.size("cells") - 2, F.lit(0))).alias("v"),
        ),
        lambda p: p["k"].isNotNull() & p["v"].isNotNull(),
    )
    return F.map_from_entries(pairs)


def sectioned(lines: DataFrame) -> DataFrame:
    """Data rows as ``file, pos, section, values`` with ``values`` a map by field name, and what
    it is made of: ``names``, ``cells``, and whether a name is ``repeated``.

    Section and kind come from a line's first two cells. Lines travel as they are; the others'
    cells are split once, for headers where they stand and for data rows beside their header.
    """
    if "block" not in lines.columns:
        lines = lines.withColumn("block", F.floor(F.col("pos") / BLOCK_LINES))
    first, second = (
        _bare(F.regexp_extract(F.concat("line", F.lit(",")), _FIRST_TWO, i)) for i in (1, 2)
    )
    start = F.struct(F.regexp_replace(first, "^\ufeff", "").alias("section"), second.alias("kind"))
    told = (
        lines.select("file", "block", "pos", "line", _once(start).alias("s"))
        .select("file", "block", "pos", "line", "s.section", "s.kind")
        .filter("kind in ('Header', 'Data')")
    )
    cells = split_cells(F.col("line"))
    names = F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0)))
    given = F.array_compact(names)
    header = F.struct(
        names.alias("names"), (F.size(F.array_distinct(given)) < F.size(given)).alias("repeated")
    )
    named = block_scan(
        told,
        ["file", "section"],
        "block",
        ["pos"],
        {"header": ("last", F.when(F.col("kind") == "Header", header))},
    )
    return (
        named.filter("kind = 'Data' and header is not null")
        .select("file", "pos", "section", "header.*", _once(split_cells(F.col("line"))).alias("cells"))
        .withColumn("values", _values())
    )


def _v(name: str) -> Column:
    """A field by its place; the map is built only where a name is repeated."""
    place = F.array_position("names", name).cast("int") + 1
    return F.when(F.col("repeated"), _values()[name]).when(place > 1, F.get("cells", place))


def trades(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("section") == "Trades") & (_v("DataDiscriminator") == "Order")).select(
        "file",
        "pos",
        _v("Symbol").alias("symbol"),
        exchange_local_to_utc(_v("Date/Time")).alias("ts"),
        number(_v("Quantity")).alias("quantity"),
        number(_v("T. Price")).alias("price"),
        (-number(_v("Comm/Fee"))).alias("commission"),
        number(_v("Proceeds")).alias("proceeds"),
        _v("Currency").alias("currency"),
        _v("Asset Category").alias("asset_category"),
    )


def trade_violations(rows: DataFrame) -> DataFrame:
    """Trades whose economics or instrument cannot be taken into the ledger."""
    c = F.col
    reason = (
        F.when(
            (c("currency") != "USD") | (c("asset_category") != "Stocks"), "unsupported instrument"
        )
        .when((c("quantity") == 0) | (c("price") <= 0) | (c("commission") < 0), "bad economics")
        .when(
            F.abs(c("proceeds") + c("quantity") * c("price")) > 0.01,
            "proceeds disagree with quantity and price",
        )
    )
    return rows.withColumn("reason", reason).filter("reason is not null")


def cash_report(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("section") == "Cash Report") & (_v("Currency") == "USD")).select(
        "file", _v("Currency Summary").alias("line"), number(_v("Total")).alias("amount")
    )


def open_positions(rows: DataFrame) -> DataFrame:
    return rows.filter(
        (F.col("section") == "Open Positions") & (_v("DataDiscriminator") == "Summary")
    ).select("file", _v("Symbol").alias("symbol"), number(_v("Quantity")).alias("quantity"))


def period_end(rows: DataFrame) -> DataFrame:
    """Last day a statement covers, from its period line."""
    last = F.element_at(F.split(_v("Field Value"), " - "), -1)
    return rows.filter(
        (F.col("section") == "Statement") & (_v("Field Name") == "Period")
    ).select("file", F.to_date(last, "MMMM d, yyyy").alias("coverage_end"))
