"""Tables of other databases over JDBC; the driver's jar must be on the class path.

A table is read in parallel over ranges of its key, of any type and any number of columns: the database
draws a sample of keys, and their quantiles are the points where the ranges part.  Every row is in exactly
one range, however the database compares text: it belongs to the last point that it doesn't lie below.
Rows with a null in the key are read with the first range.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import tempfile
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.paths import children, delete, local, scratch

# Driver classes by database.
DRIVERS = {
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "netezza": "org.netezza.Driver",
    "vertica": "com.vertica.jdbc.Driver",
}
ROUTES = {("mssql", "mssql"), ("mssql", "mysql"), ("mssql", "netezza"), ("mssql", "vertica"), ("mysql", "mssql")}


def check_route(source: str, dest: str) -> None:
    if (source.lower(), dest.lower()) not in ROUTES:
        raise ValueError(f"copying from {source} to {dest} is not supported")


# How a fraction of a table's rows is drawn, by database.
SAMPLES = {
    "mssql": "ABS(CAST(CHECKSUM(NEWID()) AS BIGINT)) % 1000000 < {f} * 1000000",
    "mysql": "RAND() < {f}",
    "netezza": "RANDOM() < {f}",
    "vertica": "RANDOM() < {f}",
    "derby": "RANDOM() < {f}",
}
#: Keys sampled for a range.
SAMPLED = 100


def literal(value) -> str:
    """A value in SQL, dates and times by the escapes that every driver knows."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"no key of a range: {value!r}")
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"{{ts '{value:%Y-%m-%d %H:%M:%S.%f}'}}"
    if isinstance(value, dt.date):
        return f"{{d '{value:%Y-%m-%d}'}}"
    return "'" + str(value).replace("'", "''") + "'"


def _reaches(key: tuple[str, ...], point: tuple) -> str:
    """Whether a row's key is a point or lies beyond it, column by column."""
    out = f"{key[-1]} >= {literal(point[-1])}"
    for c, v in list(zip(key, point, strict=True))[-2::-1]:
        out = f"{c} > {literal(v)} OR ({c} = {literal(v)} AND ({out}))"
    return f"({out})"


def range_predicates(key: tuple[str, ...], points: list[tuple]) -> list[str]:
    """A condition for each range; a row meets exactly one of them, in whatever order the points are."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in key)
    lone = " OR ".join(f"{c} IS NULL" for c in key)
    tests = [_reaches(key, p) for p in points]
    beyond = [" AND ".join([f"NOT {t}" for t in tests[k:]]) for k in range(len(points) + 1)]
    out = [f"({lone}) OR ({whole} AND {beyond[0]})" if points else "1 = 1"]
    for k, t in enumerate(tests):
        out.append(" AND ".join(x for x in (whole, t, beyond[k + 1]) if x))
    return out


def split_points(spark: SparkSession, flavor: str, url: str, table: str, key: tuple[str, ...], partitions: int, **options: str) -> list[tuple]:
    """Up to ``partitions - 1`` keys (``key``: column names in quotes) that part a table into ranges of about the same size, from a sample of
    ``SAMPLED`` keys a range that the database draws."""
    read = lambda sql: spark.read.format("jdbc").options(**{"driver": DRIVERS.get(flavor.lower(), "")} | options, url=url, dbtable=f"({sql}) q").load()
    rows = int(read(f"SELECT COUNT(*) AS n FROM {table}").first()[0])
    wanted = partitions * SAMPLED
    drawn = "" if rows <= wanted else " WHERE " + SAMPLES[flavor.lower()].format(f=f"{wanted / rows:.9f}")
    found = read(f"SELECT {', '.join(key)} FROM {table}{drawn}").dropna()
    keys = [tuple(r) for r in found.orderBy(*[F.col(f"`{c}`") for c in found.columns]).limit(4 * wanted).collect()]  # a bounded sample
    return list(dict.fromkeys(keys[k * len(keys) // partitions] for k in range(1, partitions))) if keys else []


def jdbc_read(
    spark: SparkSession, flavor: str, url: str, table: str, key: str | tuple[str, ...] | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str
) -> DataFrame:
    """A table, read in parallel over a numeric key if its bounds are given, or over ranges of about the
    same size of any key.  The driver's class is that of the flavor unless ``driver`` is among the options."""
    given = {"driver": DRIVERS.get(flavor.lower(), "")} | options
    if key and bounds is None and partitions > 1:
        names = {c.lower(): c for c in spark.read.format("jdbc").options(**given, url=url, dbtable=table).load().columns}
        quote = "`" if flavor.lower() == "mysql" else '"'
        columns = tuple(f"{quote}{names[c.lower()]}{quote}" for c in ((key,) if isinstance(key, str) else key))
        points = split_points(spark, flavor, url, table, columns, partitions, **options)
        return spark.read.jdbc(url, table, predicates=range_predicates(columns, points), properties={k: v for k, v in given.items() if v})
    r = spark.read.format("jdbc").options(**given, url=url, dbtable=table)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return r.load()


def jdbc_copy(spark: SparkSession, source: dict, dest: dict, key: str | tuple[str, ...] | None = None, partitions: int = 16, mode: str = "overwrite", types: dict[str, str] | None = None) -> None:
    """A table copied from one database to another; ``source`` and ``dest`` have flavor, url, table and
    options.  Only the known routes are allowed."""
    check_route(source["flavor"], dest["flavor"])
    jdbc_writer(jdbc_read(spark, key=key, partitions=partitions, **source), types=types, **dest).mode(mode).save()


def jdbc_writer(df: DataFrame, flavor: str, url: str, table: str, types: dict[str, str] | None = None, **options: str) -> DataFrameWriter:
    """A configured writer; ``types`` are the target's column types."""
    w = df.write.format("jdbc").options(**{"driver": DRIVERS.get(flavor.lower(), "")} | options, url=url, dbtable=table)
    return w.option("createTableColumnTypes", ", ".join(f"{c} {t}" for c, t in types.items())) if types else w


def embedded(spark: SparkSession, df: DataFrame, table: str, types: dict[str, str] | None = None) -> dict[str, str]:
    """``url`` and ``driver`` of a Derby database that holds ``df`` as ``table`` and that every executor can read.

    A database of Derby is open in one process at a time, and one in memory is seen by no other.  So tasks
    write the rows as text to the shared folder, the database imports these files on the driver's disk, and
    once it is shut down it is put into an archive in the shared folder: such a database is read only, and
    any number of processes open it.  The shared folder must be a file system that all machines mount."""
    manager, driver = spark._jvm.java.sql.DriverManager, "org.apache.derby.jdbc.EmbeddedDriver"
    rows, shared = scratch(spark, "rows"), scratch(spark, "db")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    fields = [quoted(df[f"`{c}`"]) if kind == "string" else df[f"`{c}`"].cast("string") for c, kind in df.dtypes]
    df.select(F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]).alias("value")).write.text(rows)  # quotes keep spaces, and "" from null
    with tempfile.TemporaryDirectory() as folder:
        url = f"jdbc:derby:{folder}/db"
        jdbc_writer(df.limit(0), "derby", f"{url};create=true", table, types, driver=driver).mode("overwrite").save()
        connection = manager.getConnection(url)
        try:
            load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, NULL, NULL, 'UTF-8', 0)")
            load.setString(1, table.upper())
            for name in children(spark, rows):
                if name.startswith("part-"):
                    load.setString(2, local(spark, f"{rows}/{name}"))
                    load.execute()
        finally:
            connection.close()
            try:
                manager.getConnection(f"{url};shutdown=true")
            except Py4JJavaError as e:
                if e.java_exception.getSQLState() != "08006":  # so Derby says that it is shut down
                    raise
        delete(spark, rows)
        os.makedirs(local(spark, shared))
        archive = local(spark, f"{shared}/db.jar")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_STORED) as z:  # stored, so that any page is at hand
            for at, _, files in os.walk(f"{folder}/db"):
                for f in files:
                    z.write(f"{at}/{f}", os.path.relpath(f"{at}/{f}", folder))
    return {"url": f"jdbc:derby:jar:({archive})db", "driver": driver}
