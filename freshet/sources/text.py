"""Text formats (inventory A1 to A7).

All readers work on lines, never on a file as one value, so a large file is split
between tasks. ``block`` and ``at`` order the lines of a file: a split's first byte
and the place within the split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from freshet.functions.scalars import af_to_kaf, cfs_to_kaf, null_if
from freshet.sources.schemas import DISCHARGE, RESERVOIR, SNOW_MEASURES


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block, at, value of each line; files may be split between tasks."""
    df = spark.read.text(path)
    return df.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def bundle_lines(lines: DataFrame, by: Sequence[str], order: str, parts: int) -> DataFrame:
    """Lines (``value``) of many small files as those of few: each after the name of its
    file (``station=7/``) and a tab. A name's lines lie in one part, in ``order``."""
    name = F.concat(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string"), F.lit("/")) for c in by])
    cut = lines.select(name.alias("_name"), F.col(order).alias("_o"), F.posexplode(F.split("value", "\n")).alias("_k", "_line"))
    dealt = cut.repartition(parts, "_name").sortWithinPartitions("_name", "_o", "_k")
    return dealt.select(F.concat_ws("\t", "_name", "_line").alias("value"))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """:func:`read_lines` of small files kept in few by :func:`bundle_lines`; ``path`` is the name of the small file."""
    name = F.substring_index("value", "\t", 1)
    return read_lines(spark, path).select(name.alias("path"), "block", "at", F.substring("value", F.length(name) + 2, F.length("value")).alias("value"))


def lines_after(lines: DataFrame, marker: Column) -> DataFrame:
    """Lines after the first marker line of their file; a file without one gives none."""
    first = lines.where(marker).groupBy("path").agg(F.min(F.struct("block", "at")).alias("_first"))
    return lines.join(first, "path").where(F.struct("block", "at") > F.col("_first")).drop("_first")


def parse_station_years(
    lines: DataFrame,
    measures: Sequence[str] = SNOW_MEASURES,
    year: str = r"FY(\d{4})/[^/]*$",
    station: str = r"/([^/]*)\.csv$",
) -> DataFrame:
    """A1: one file per station and year, ``.../FY{year}/{station}.csv``.

    Columns are matched by each file's own header, the line with a ``date`` cell,
    so an absent measure is null; a file without one gives no rows. Station and
    forecast year come from the path.
    """
    is_head = F.array_contains(F.split("value", ","), "date")
    heads = lines.where(is_head).groupBy("path").agg(F.split(F.min_by("value", F.struct("block", "at")), ",").alias("_head"))
    rows = lines.where(~is_head & (F.length("value") > 0)).join(heads, "path")
    cells = F.map_from_arrays("_head", F.slice(F.split("value", ",", -1), F.lit(1), F.size("_head")))
    named = rows.withColumn("_c", cells)
    return named.select(
        F.regexp_extract("path", station, 1).alias("station"),
        F.regexp_extract("path", year, 1).cast("int").alias("forecast_year"),
        F.to_date(F.element_at("_c", F.lit("date"))).alias("date"),
        *[null_if(F.element_at("_c", F.lit(m))).alias(m) for m in measures],
    )


def scan_station_years(
    spark: SparkSession, root: str, measures: Sequence[str] = SNOW_MEASURES, files: str = "FY*/*.csv", **names: str
) -> DataFrame:
    """A1 from storage; missing files are simply not listed. Ids hold no colon
    in file names (``scalars.norm_id``). ``names``: other patterns for ``year``
    and ``station`` in the path."""
    return parse_station_years(read_lines(spark, f"{root}/{files}"), measures, **names)


def clean_discharge(df: DataFrame, drop_negative: bool = False) -> DataFrame:
    """A2: daily mean in cfs; the sentinel is null, or negatives are dropped."""
    flow = F.col("`00060_Mean`")
    out = df.select(
        F.col("site_no").cast("string").alias("site_no"),
        F.to_date("datetime").alias("date"),
        F.when((flow != -999999) & ~F.isnan(flow), flow).alias("discharge_cfs_mean"),
    )
    return out.where(F.col("discharge_cfs_mean") >= 0) if drop_negative else out


def read_discharge_csv(spark: SparkSession, path: str, drop_negative: bool = False) -> DataFrame:
    """A2 from storage."""
    return clean_discharge(spark.read.schema(DISCHARGE).csv(path, header=True), drop_negative)


def parse_rdb(lines: DataFrame, names: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """A3: tab-separated lines with ``#`` comments; the header and the
    type-format line fall away by keeping one agency code."""
    cells = F.split("value", "\t", -1)
    rows = lines.where(~F.startswith("value", F.lit("#"))).select(
        *[F.get(cells, i).alias(n) for i, n in enumerate(names)]
    )
    kept = rows.where(F.col(names[0]) == "USGS")
    return kept.withColumns({n: F.col(n).try_cast("double") for n in numeric}) if numeric else kept


def read_rdb(spark: SparkSession, path: str, names: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """A3 from storage."""
    return parse_rdb(read_lines(spark, path), names, numeric).drop("path")


def parse_reservoir(
    lines: DataFrame, sites: Mapping[str, str], parameter: str, header: str = "Location,", unit: str = "cfs"
) -> DataFrame:
    """A4: csv after a preamble of any length and a header line; one parameter and
    unit, locations mapped to sites, result in thousand acre-feet."""
    data = lines_after(lines, F.startswith("value", F.lit(header))).where(F.length("value") > 0)
    parsed = data.withColumn("_r", F.from_csv("value", RESERVOIR, {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}))
    table = F.create_map(*[F.lit(x) for kv in sites.items() for x in kv])
    value = F.col("_r.Result")
    return (
        parsed.where((F.col("_r.Units") == unit) & (F.col("_r.Parameter") == parameter))
        .select(
            F.element_at(table, F.col("_r.Location")).alias("site_id"),
            F.to_date(F.col("_r.`Datetime (UTC)`")).alias("date"),
            (cfs_to_kaf(value) if unit == "cfs" else af_to_kaf(value)).alias("volume"),
        )
        .where(F.col("site_id").isNotNull())
    )


def read_reservoir_csv(
    spark: SparkSession, path: str, sites: Mapping[str, str], parameter: str, header: str = "Location,", unit: str = "cfs"
) -> DataFrame:
    """A4 from storage."""
    return parse_reservoir(read_lines(spark, path), sites, parameter, header, unit)


def parse_fwf(
    lines: DataFrame,
    widths: Sequence[int],
    names: Sequence[str],
    na: Sequence[str] = ("99.99", "-99.99", "-999.9"),
    marker: str | None = None,
) -> DataFrame:
    """A5: fixed-width cells; with ``marker`` only the lines after it. Lines
    that do not begin with a year (headers, footers) fall away."""
    rows = lines if marker is None else lines_after(lines, F.contains("value", F.lit(marker)))
    cells, start = [], 1
    for name, width in zip(names, widths):
        cells.append((name, F.trim(F.substring("value", start, width))))
        start += width
    year_name, year_cell = cells[0]
    out = rows.select(
        "path",
        year_cell.try_cast("int").alias(year_name),
        *[null_if(c, missing=("", *na)).alias(n) for n, c in cells[1:]],
    )
    return out.where(F.col(year_name).between(1800, 2200))


def read_fwf(
    spark: SparkSession, path: str, widths: Sequence[int], names: Sequence[str], marker: str | None = None
) -> DataFrame:
    """A5 from storage."""
    return parse_fwf(read_lines(spark, path), widths, names, marker=marker).drop("path")


def parse_ws(
    lines: DataFrame, names: Sequence[str], skip: Sequence[str] = (), na: Sequence[str] = ("*****", "")
) -> DataFrame:
    """Cells split on white space; lines starting with a ``skip`` word fall
    away (repeated headers, unit lines); names are positional."""
    text = F.trim("value")
    cells = F.split(text, r"\s+")
    keep = F.length(text) > 0
    for word in skip:
        keep = keep & ~F.startswith(text, F.lit(word))
    clean = F.transform(cells, lambda c: F.when(~c.isin(*na), c))
    return lines.where(keep).select(*[F.get(clean, i).alias(n) for i, n in enumerate(names)])


def read_ws(spark: SparkSession, path: str, names: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """A6 from storage."""
    return parse_ws(read_lines(spark, path), names, skip)


def parse_sectioned(
    lines: DataFrame,
    header: str,
    layouts: Mapping[int, Sequence[tuple[str, int]]],
    default: Sequence[tuple[str, int]],
    end: str = "9999",
) -> DataFrame:
    """Header lines date the data lines after them; ``end`` closes a file.

    ``layouts`` gives other (name, width) lists for single years of the header
    date. Dates are carried down within each split of a file, then from split to
    split by one row each, so no window is longer than a split.
    """
    is_head = F.contains("value", F.lit(header))
    stamp = F.make_date(
        F.substring("value", 6, 4).try_cast("int"),
        F.trim(F.substring("value", 1, 2)).try_cast("int"),
        F.substring("value", 3, 2).try_cast("int"),
    )
    dated, ended = F.when(is_head, stamp), F.startswith("value", F.lit(end)).cast("int")
    own = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(dated, F.when(dated.isNotNull(), F.col("at")))
    carried = (
        lines.groupBy("path", "block").agg(last.alias("_last"), F.max(ended).alias("_end"))
        .select("path", "block", F.last("_last", ignorenulls=True).over(before).alias("_before"), F.max("_end").over(before).alias("_over"))
    )
    here = lines.withColumns({"_here": F.last(dated, ignorenulls=True).over(own), "_ended": F.max(ended).over(own)})
    marked = here.join(carried, ["path", "block"]).withColumn("issue_date", F.coalesce("_here", "_before"))
    data = marked.where(
        ~is_head & (F.col("_ended") == 0) & (F.coalesce("_over", F.lit(0)) == 0) & ~F.startswith("value", F.lit("YEAR"))
        & (F.length(F.trim("value")) > 0) & F.col("issue_date").isNotNull()
    )
    names = [n for n, _ in default]

    def cells(layout: Sequence[tuple[str, int]]) -> dict[str, Column]:
        out, start = {}, 1
        for name, width in layout:
            out[name] = F.trim(F.substring("value", start, width)).try_cast("double")
            start += width
        return out

    value = cells(default)
    for year, layout in layouts.items():
        other = cells(layout)
        for n in names:
            value[n] = F.when(F.year("issue_date") == year, other[n]).otherwise(value[n])
    return data.select("path", "issue_date", *[value[n].alias(n) for n in names])


def read_sectioned(spark: SparkSession, path: str, header: str, layouts, default) -> DataFrame:
    """A7 from storage."""
    return parse_sectioned(read_lines(spark, path), header, layouts, default).drop("path")
