"""Capturing changes: a log reduced to one net row per key, joined with the base table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import shortened
from tidemark.sources.paths import scratch
from tidemark.spec import META, OP, VERSION, TableSpec

# System column names that targets reserve, with their replacements.
RESERVED = {"CTID": "CT_ID", "OID": "O_ID", "XMIN": "X_MIN", "CMIN": "C_MIN", "XMAX": "X_MAX", "CMAX": "C_MAX", "TABLEOID": "TABLE_O_ID"}


def project_columns(df: DataFrame, spec: TableSpec, include: tuple[str, ...] = ()) -> DataFrame:
    """Subscribed columns and keys, by name without case; ``include`` forces others in."""
    forced = {c.lower() for c in include}
    return df.select([c for c in df.columns if spec.wants(c) or c.lower() in forced])


def shorten(df: DataFrame, modifiers: dict[str, int]) -> DataFrame:
    """The first n characters of each column named, as text."""
    names = {c.lower(): c for c in df.columns}
    unknown = [c for c in modifiers if c.lower() not in names]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.withColumns({names[c.lower()]: shortened(F.col(names[c.lower()]), n) for c, n in modifiers.items()})


def strip_meta(df: DataFrame) -> DataFrame:
    return df.drop(*META)


def rename_reserved(df: DataFrame, reserved: dict[str, str] = RESERVED) -> DataFrame:
    return df.withColumnsRenamed({c: reserved[c.upper()] for c in df.columns if c.upper() in reserved})


def subscribed_tables(manifest: DataFrame, specs: list[TableSpec]) -> DataFrame:
    """Manifest rows of configured tables, by (schema, table) without case."""
    keys = [f"{s.schema}.{s.name}".lower() for s in specs]
    return manifest.where(F.lower(F.concat_ws(".", "schema_name", "table_name")).isin(keys))


#: Operations as numbers, so that an aggregation over them is hashed and not sorted.
CODES = {"D": 0, "I": 1, "U": 2}


def _code(op: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, code in CODES.items():
        out = F.when(op == name, F.lit(code)).otherwise(out)
    return out


def _decoded(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in CODES]), code.cast("int") + 1)


def net_changes(log: DataFrame, pk: tuple[str, ...], start: int | None = None) -> DataFrame:
    """One row per key: last version, net operation, and the version of the row's creation, if any.

    The log has the key columns, ``version`` and ``op`` (I, U, D).  Net: D if the last change is one;
    else I if the window holds an insert, which also gives the creation version; else U.  One hash
    aggregation with map-side combining; nothing is sorted.
    """
    return net_of_run(net_run(log if start is None else log.where(F.col("version") > start), pk), pk)


def combine_net(runs: DataFrame, pk: tuple[str, ...]) -> DataFrame:
    """Net changes of adjoining version ranges (key, ``_version``, ``last`` as a number, creation_version)
    as those of the whole range; the order of combining doesn't matter."""
    return runs.groupBy(*pk).agg(F.max(VERSION).alias(VERSION), F.max_by("last", VERSION).alias("last"), F.max("creation_version").alias("creation_version"))


def net_run(log: DataFrame, pk: tuple[str, ...]) -> DataFrame:
    """A log reduced to what ``combine_net`` combines."""
    created = F.when(F.col("op") == "I", F.col("version"))
    return combine_net(log.select(*pk, F.col("version").alias(VERSION), _code(F.col("op")).alias("last"), created.alias("creation_version")), pk)


def net_of_run(run: DataFrame, pk: tuple[str, ...]) -> DataFrame:
    """A run as ``net_changes`` gives it."""
    op = F.when(F.col("last") == CODES["D"], "D").when(F.col("creation_version").isNotNull(), "I").otherwise("U")
    return run.select(*pk, VERSION, op.alias(OP), "creation_version")


#: Keys that are sent to every task to pick their rows from the base, instead of shuffling it.
FEW = 200_000


def _joined(net: DataFrame, base: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys from the change side, other subscribed columns from the base, null where it is gone.

    The net change is used twice, so it is written once and the log read once.  Changes are few beside
    the base, as a rule: up to ``FEW`` keys are broadcast, and only the rows that they pick are shuffled.
    """
    spark, path = net.sparkSession, scratch(net.sparkSession, "net")
    net.write.parquet(path)
    net = spark.read.schema(net.schema).parquet(path)
    side = project_columns(base, spec)
    if net.count() <= FEW:
        side = side.join(F.broadcast(net.select(*spec.pk)), list(spec.pk), "left_semi")
    side = side.withColumn("__alive", F.lit(True))
    out = net.join(side, list(spec.pk), "left")
    rest = [c for c in side.columns if c not in (*spec.pk, "__alive")]
    gone = F.col(OP) == "D"
    return out.select(*spec.pk, *[F.when(~gone, F.col(c)).alias(c) for c in rest], VERSION, OP, "creation_version", F.coalesce("__alive", F.lit(False)).alias("__alive"))


def capture_changes(log: DataFrame, base: DataFrame, spec: TableSpec, start: int, stop: int) -> DataFrame:
    """The change set of versions after ``start`` up to ``stop``, with the base's present values.

    A key counts if its last change or its creation lies at or before ``stop`` and the row is still
    there or was deleted.  A row created by ``stop`` and changed later is captured now and again in
    the next window; applying it twice does no harm.
    """
    return captured(net_changes(log, spec.pk, start), base, spec, stop)


def captured(net: DataFrame, base: DataFrame, spec: TableSpec, stop: int) -> DataFrame:
    """The change set up to ``stop`` of net changes at hand."""
    out = _joined(net, base, spec)
    out = out.where(((F.col(VERSION) <= stop) | (F.col("creation_version") <= stop)) & ((F.col(OP) == "D") | F.col("__alive")))
    out = out.drop("creation_version", "__alive")
    return shorten(out, spec.shorten) if spec.shorten else out


def capture_by_time(log: DataFrame, base: DataFrame, spec: TableSpec, since, until=None) -> DataFrame:
    """The change set of a log stamped with ``ts``: the last write of each key after ``since``.

    Deleted rows appear, with null columns; ``until`` is included.
    """
    window = log.where(F.col("ts") > F.lit(since))
    if until is not None:
        window = window.where(F.col("ts") <= F.lit(until))
    # time and version in one number, so that the aggregation is hashed
    wide = lambda c: c.cast("decimal(38,0)")
    place = wide(wide(F.unix_micros(F.col("ts").cast("timestamp"))) * wide(F.lit("1" + 19 * "0")) + F.col("version"))
    last = window.withColumn("__place", place).groupBy(*spec.pk)
    last = last.agg(F.max_by("version", "__place").alias(VERSION), F.max_by(_code(F.col("op")), "__place").alias("__code"))
    net = last.select(*spec.pk, VERSION, _decoded(F.col("__code")).alias(OP), F.lit(None).cast("long").alias("creation_version"))
    out = _joined(net, base, spec).where((F.col(OP) == "D") | F.col("__alive")).drop("creation_version", "__alive")
    return shorten(out, spec.shorten) if spec.shorten else out


def next_time_window(registry: DataFrame, now: Column) -> DataFrame:
    """The registry (feed, ctid, ts, finished) with each feed's next window opened at a second
    before ``now``: a new ctid if the last one is finished, else the open row moved."""
    last = registry.groupBy("feed").agg(F.max("ctid").alias("ctid"), F.max_by("finished", "ctid").alias("done"))
    moment = now - F.expr("interval 1 second")
    opened = last.select("feed", F.when(F.col("done"), F.col("ctid") + 1).otherwise(F.col("ctid")).alias("ctid"), moment.alias("ts"), F.lit(False).alias("finished"))
    return registry.join(opened.select("feed", "ctid"), ["feed", "ctid"], "left_anti").unionByName(opened)


def lone(pk: tuple[str, ...]) -> Column:
    """Null, or for a row with a null in the key a number of its own, so that such rows share neither a
    group nor a task."""
    whole = F.lit(True)
    for c in pk:
        whole = whole & F.col(c).isNotNull()
    return F.when(~whole, F.monotonically_increasing_id())


def dedupe_changes(df: DataFrame, pk: tuple[str, ...], order: tuple[str, ...] = (VERSION,)) -> DataFrame:
    """Of each key the row that is last in ``order``; rows with a null in the key all stay."""
    w = Window.partitionBy(*pk, "__lone").orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__lone", lone(pk)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__lone")
