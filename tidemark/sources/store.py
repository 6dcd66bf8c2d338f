"""Where change sets, history, ledgers and target tables are kept, as Parquet.

Change sets and history replace their own partition (table and ctid), so a step that is run again
leaves the same files.  Ledgers are appended to in small files under a running number, which are put into
one now and then; of each key the highest number counts.

A target is laid out in parts, buckets of its key's hash or ranges of the key, as many as its size asks
for.  Every write goes to a folder of its own, ``write=<id>``, and comes into force by one commit that
says which folders hold each part (see ``pointers``).  So an attempt that fails leaves nothing that is
read, several tables change together by one file, and readers keep what they began with.

A small change set is laid beside the parts it touches, newer rows and dead keys alone, and merged when
the target is read; when what lies beside a part has grown to a share of it, the part is written anew.
Columns are names for columns of files, so most schema changes write no rows.  What is no longer in force
is deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, IntegerType, StructField, StructType

from tidemark.operators.apply import delete_inserted, key_columns, key_names, keyed, merged, replaced
from tidemark.operators.changes import project_columns, shorten
from tidemark.operators.schema import evolve
from tidemark.sources import pointers
from tidemark.sources.paths import children, delete, read_text, write_new
from tidemark.spec import OP, TableSpec

#: Rows that a bucket of a new target is laid out for.
ROWS = 1_000_000


def replace_partitions(df: DataFrame, path: str, *parts: str) -> None:
    """Write the partitions that ``df`` has rows for, replacing those; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there; what a failed attempt left doesn't count."""
    return any(not n.startswith((".", "_")) for n in children(spark, path))


def read_snapshot(spark: SparkSession, path: str, spec: TableSpec | None = None) -> DataFrame:
    """A table's subscribed columns, or all of them for a table that isn't configured."""
    df = spark.read.parquet(path)
    return df if spec is None else project_columns(df, spec)


# change sets and history ---------------------------------------------------------------------------


def change_set_path(root: str, table: str, ctid: int) -> str:
    return f"{root}/change_sets/table={table.lower()}/ctid={ctid}"


def write_change_set(df: DataFrame, root: str, table: str, ctid: int) -> None:
    """The change set of a table and ctid, replacing an earlier attempt."""
    df.write.mode("overwrite").parquet(change_set_path(root, table, ctid))


def read_change_set(spark: SparkSession, root: str, table: str, ctid: int) -> DataFrame | None:
    """A change set, or None: a missing one means that nothing changed."""
    path = change_set_path(root, table, ctid)
    return spark.read.parquet(path) if exists(spark, path) else None


def copy_change_sets(spark: SparkSession, source: str, dest: str, tables: list[tuple[str, int]], ctid: int) -> list[str]:
    """Copy the change sets of (table, expected rows) between stores; tables without rows are left
    out, and nothing is copied onto itself.  Returns what was copied."""
    if source.rstrip("/") == dest.rstrip("/"):
        return []
    done = []
    for table, rows in tables:
        df = read_change_set(spark, source, table, ctid) if rows else None
        if df is not None:
            write_change_set(df, dest, table, ctid)
            done.append(table)
    return done


def append_history(changes: DataFrame, ctid: int, root: str, table: str) -> None:
    """Applied changes kept under their ctid; applying a batch again replaces its own part."""
    replace_partitions(changes.withColumn("CTHistID", F.lit(ctid).cast("long")), f"{root}/history/table={table.lower()}", "CTHistID")


def evolve_history(spark: SparkSession, root: str, table: str, ctid: int, steps: list[dict]) -> None:
    """Schema changes of a batch noted for the history; ``read_history`` applies them to what older
    batches left, so nothing is rewritten."""
    keys = ("event_type", "column_name", "new_column_name", "data_type", "precision", "scale")
    rows = [(n, *(s.get(k) for k in keys)) for n, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "n int, event_type string, column_name string, new_column_name string, data_type string, precision int, scale int")
    df.coalesce(1).write.mode("overwrite").parquet(f"{root}/history_steps/table={table.lower()}/ctid={ctid}")


def read_history(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All applied changes, those of older batches in today's schema."""
    whole = spark.read.option("mergeSchema", "true").parquet(f"{root}/history/table={table.lower()}")
    noted = f"{root}/history_steps/table={table.lower()}"
    if not exists(spark, noted):
        return whole
    steps = [r.asDict() for r in spark.read.parquet(noted).orderBy("ctid", "n").collect()]
    bounds = sorted({s["ctid"] for s in steps})
    hist, parts = F.col("CTHistID"), []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        own = spark.read.option("mergeSchema", "true").option("basePath", f"{root}/history/table={table.lower()}")
        names = [n for n in children(spark, f"{root}/history/table={table.lower()}") if n.startswith("CTHistID=")]
        at = [int(n.split("=")[1]) for n in names]
        paths = [f"{root}/history/table={table.lower()}/{n}" for n, c in zip(names, at, strict=True) if (low is None or c >= low) and (high is None or c < high)]
        if paths:
            parts.append(evolve(own.parquet(*paths).withColumn("CTHistID", hist.cast("long")), [s for s in steps if high is not None and s["ctid"] >= high]))
    out = parts[-1]
    for p in reversed(parts[:-1]):
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# ledgers -------------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The record files of a ledger that no checkpoint holds, in order, and its checkpoints."""
    names = children(spark, path)
    marks = [n for n in names if re.fullmatch(r"upto=\d+", n) and "_SUCCESS" in children(spark, f"{path}/{n}")]
    low = int(marks[-1].split("=")[1]) if marks else 0
    return [n for n in names if (m := re.fullmatch(r"(\d+)\.json", n)) and int(m[1]) > low], marks


#: Records of a ledger after which they are put into one file.
RECORDS = 50


def record(spark: SparkSession, root: str, name: str, rows: DataFrame) -> None:
    """Rows of a ledger, in force from now on: of each (ctid, subscriber) the row recorded last.  They are
    a batch's few rows, written as one small file; every ``RECORDS`` files are put together."""
    told = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", **_TIMES}))
    _record(spark, root, name, rows.schema, [r[0] for r in told.collect()])


def record_rows(spark: SparkSession, root: str, name: str, rows: list[dict], schema: str) -> None:
    """The same for rows at hand, without a job."""
    told = lambda x: x.astimezone().isoformat(timespec="microseconds")
    _record(spark, root, name, StructType.fromDDL(schema), [json.dumps(r, default=told) for r in rows])


def _record(spark: SparkSession, root: str, name: str, schema: StructType, rows: list[str]) -> None:
    path = f"{root}/ledgers/{name}"
    text = json.dumps({"schema": schema.json(), "rows": rows})
    while True:
        files, marks = _files(spark, path)
        last = int(files[-1][:-5]) if files else int(marks[-1].split("=")[1]) if marks else 0
        if write_new(spark, f"{path}/{last + 1:012d}.json", text):
            break
    if len(files) >= RECORDS:
        _checkpoint(spark, path, recorded(spark, root, name), last + 1)


def _checkpoint(spark: SparkSession, path: str, rows: DataFrame, upto: int) -> None:
    """The rows up to a record as one table; files that it holds already are deleted, and checkpoints but
    the last one, which may still be being read."""
    files, marks = _files(spark, path)
    rows.where(F.col("seq") <= upto).coalesce(1).write.mode("overwrite").parquet(f"{path}/upto={upto:012d}")
    for n in [*marks[:-1], *[f for f in files if int(f[:-5]) <= upto]]:
        delete(spark, f"{path}/{n}")


def recorded(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """All rows of a ledger with the number (seq) of their record."""
    path = f"{root}/ledgers/{name}"
    files, marks = _files(spark, path)
    parts = [spark.read.parquet(f"{path}/{marks[-1]}")] if marks else []
    by_schema: dict[str, list[tuple]] = {}
    for n in files:
        told = json.loads(read_text(spark, f"{path}/{n}"))
        by_schema.setdefault(told["schema"], []).extend((int(n[:-5]), r) for r in told["rows"])
    for schema, rows in by_schema.items():
        kind = StructType.fromJson(json.loads(schema))
        parts.append(spark.createDataFrame(rows, "seq int, x string").select("seq", F.from_json("x", kind, _TIMES).alias("x")).select("seq", "x.*"))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def read_ledger(spark: SparkSession, root: str, name: str, keys: tuple[str, ...] = ("feed", "ctid")) -> DataFrame | None:
    rows = recorded(spark, root, name)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in (*keys, "seq")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def trim_ledger(spark: SparkSession, root: str, name: str, gone: Column, keys: tuple[str, ...] = ("feed", "ctid")) -> int:
    """Rows of a ledger that are out of date deleted, and the last row of each key kept in one file; the
    number of rows deleted.  Not while the ledger is being written."""
    path = f"{root}/ledgers/{name}"
    last = read_ledger(spark, root, name, keys)
    if last is None:
        return 0
    files, marks = _files(spark, path)
    upto = int(files[-1][:-5]) if files else int(marks[-1].split("=")[1])
    rows = last.withColumn("__gone", F.coalesce(gone, F.lit(False))).collect()  # a row a batch
    kept = [r[:-1] for r in rows if not r["__gone"]]
    upto += not files  # a checkpoint isn't written over itself
    _checkpoint(spark, path, spark.createDataFrame(kept, last.schema).withColumn("seq", F.lit(upto)), upto)
    return len(rows) - len(kept)


# targets -------------------------------------------------------------------------------------------

Places = dict[int, tuple[str, ...]]


@dataclass(frozen=True)
class Target:
    """A target in force.

    Its parts are ``buckets`` of the key's hash or, with ``bounds`` (the least keys of all parts but the
    first), ranges of the key.  ``places`` are the folders of each part, ``sizes`` their rows, ``spans``
    their least and greatest keys.  ``deltas`` lie beside a part: newer rows, and keys that are dead, which
    replace those of the part.  ``columns`` names the file column of each column.
    """

    schema: StructType
    buckets: int
    places: Places
    sizes: dict[int, int] = field(default_factory=dict)
    spans: dict[int, tuple[str, str]] = field(default_factory=dict)
    deltas: Places = field(default_factory=dict)
    delta_sizes: dict[int, int] = field(default_factory=dict)
    bounds: tuple[str, ...] | None = None
    columns: dict[str, str] = field(default_factory=dict)
    used: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.columns:
            object.__setattr__(self, "columns", {n: n for n in self.schema.names})
        object.__setattr__(self, "used", tuple(dict.fromkeys([*self.used, *self.columns.values()])))

    def state(self) -> dict:
        return asdict(self) | {"schema": self.schema.json()}

    @classmethod
    def of(cls, state: dict) -> Target:
        parts = lambda k, v: {int(b): v(x) for b, x in state[k].items()}
        return cls(
            StructType.fromJson(json.loads(state["schema"])), state["buckets"], parts("places", tuple), parts("sizes", int), parts("spans", tuple), parts("deltas", tuple),
            parts("delta_sizes", int), None if state["bounds"] is None else tuple(state["bounds"]), state["columns"], tuple(state["used"]),
        )

    def part(self, b: int) -> tuple:
        return self.places.get(b), self.deltas.get(b)


@dataclass(frozen=True)
class Applied:
    """What an apply did: parts touched, rows inserted or updated, rows deleted or updated."""

    buckets: list[int]
    inserted: int = 0
    deleted: int = 0


#: Rows beside a part may be one in so many of its own; beyond, the part is written anew.
SHARE = 8
#: Rows beside all parts of a target: their keys are broadcast when it is read.
BESIDE = 1_000_000
#: Changed keys that are broadcast to find the rows they match.
FEW = 200_000
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def buckets_for(rows: int) -> int:
    return 1 << max(0, -(-rows // ROWS) - 1).bit_length()


def _lone(keys: list[Column]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | k.isNull()
    return out


def bucket_of(df: DataFrame, spec: TableSpec, buckets: int) -> Column:
    """The bucket of a row, from its key as it is matched; rows with a null in the key, which match
    nothing, are spread by all their columns."""
    keys = key_columns(df, spec)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return F.pmod(F.when(_lone(keys), whole).otherwise(F.xxhash64(*keys)), F.lit(buckets)).cast("int")


def _key(df: DataFrame, spec: TableSpec) -> Column:
    return F.struct(*[k.alias(f"k{n}") for n, k in enumerate(key_columns(df, spec))])


def part_of(df: DataFrame, spec: TableSpec, t: Target) -> Column:
    """The part of a row: its bucket, or the last range that begins at or before its key, found by
    halving the bounds."""
    if t.bounds is None:
        return bucket_of(df, spec, t.buckets)
    if not t.bounds:
        return F.lit(0)
    kinds = {f.name.lower(): f.dataType for f in df.schema}
    each = StructType([StructField(f"k{n}", kinds[c.lower()]) for n, c in enumerate(spec.pk)])
    bounds = F.from_json(F.lit(f"[{','.join(t.bounds)}]"), ArrayType(each), _TIMES)
    key = _key(df, spec)

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(bounds, mid) <= key)
        lo = F.when(right, mid + 1).otherwise(s["lo"])
        return F.struct(lo.alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(t.bounds).bit_length()))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(t.bounds)).alias("hi")), halve)["lo"]
    whole = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(t.buckets)).cast("int")
    return F.when(_lone(key_columns(df, spec)), whole).otherwise(found)


def write_with_layout(df: DataFrame, path: str, spec: TableSpec, layout: str = "hash", partitions: int | None = None) -> None:
    """A table laid out by key (``hash``: bucketed by the key, sorted by it) or spread (``random``),
    replacing whatever is at ``path``.  ``partitions``: buckets, or files."""
    if layout == "random":
        (df.repartition(partitions) if partitions else df).write.mode("overwrite").parquet(path)
    elif layout != "hash":
        raise ValueError(f"unknown layout {layout}")
    elif not spec.pk:
        raise ValueError(f"{spec.name}: a table without a key can't be laid out by it")
    else:
        out = df.withColumn("_bucket", bucket_of(df, spec, partitions or buckets_for(df.count())))
        out = out.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *spec.pk)
        out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_bucket").parquet(path)


def _base(root: str, table: str) -> str:
    return f"{root}/target/table={table.lower()}"


def _write(df: DataFrame, spec: TableSpec, root: str, columns: dict[str, str]) -> Places:
    """Rows with ``_bucket`` to a fresh folder, under the names of file columns; its places."""
    spark, place = df.sparkSession, f"write={uuid.uuid4().hex}"
    named = df.select(*[F.col(f"`{c}`").alias(columns.get(c, c)) for c in df.columns])
    named.write.partitionBy("_bucket").parquet(f"{_base(root, spec.name)}/{place}")
    found = [m for n in children(spark, f"{_base(root, spec.name)}/{place}") if (m := re.fullmatch(r"_bucket=(\d+)", n))]
    return {int(m[1]): (f"{place}/{m[0]}",) for m in found}


def _dealt(df: DataFrame, spec: TableSpec, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", bucket_of(df, spec, buckets)).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *spec.pk)


def _measured(spark: SparkSession, root: str, spec: TableSpec, t: Target, places: Places) -> Target:
    """The target with rows and, where parts are ranges, least and greatest keys of parts just written."""
    if not places:
        return t
    rows = _scan(spark, root, spec, t, places, ("_bucket",))
    if t.bounds is None:
        got = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    else:
        key = F.when(~_lone(key_columns(rows, spec)), _key(rows, spec))
        got = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.to_json(F.min(key), _TIMES).alias("low"), F.to_json(F.max(key), _TIMES).alias("high"))
    got = got.collect()
    spans = {} if t.bounds is None else {r["_bucket"]: (r["low"], r["high"]) for r in got if r["low"] is not None}
    return replace(t, sizes=t.sizes | {r["_bucket"]: r["n"] for r in got}, spans=t.spans | spans)


def commit(spark: SparkSession, root: str, targets: dict[str, Target], base: pointers.Snapshot | None = None, notes: dict[str, list] | None = None) -> None:
    """Put targets in force, all by one file.  With the snapshot they were made from, another commit in
    between is a ``Conflict``; without, it is overwritten."""
    states = {name.lower(): pointers.write_state(spark, root, name, t.state()) for name, t in targets.items()}
    while True:
        try:
            pointers.put(spark, root, base or pointers.snapshot(spark, root), states, notes or {})
            return
        except pointers.Conflict:
            if base is not None:
                raise


def target(spark: SparkSession, root: str, table: str, at: pointers.Snapshot | None = None) -> Target | None:
    """The target in force, if any, or that of an earlier snapshot under a lease."""
    name = (at or pointers.snapshot(spark, root)).tables.get(table.lower())
    return None if name is None else Target.of(pointers.read_state(spark, root, name))


def _scan(spark: SparkSession, root: str, spec: TableSpec, t: Target, places: Places, extra: tuple[str, ...] = ()) -> DataFrame:
    """The rows of places in today's columns; columns that their files lack are null."""
    kinds = {"_dead": BooleanType(), "_bucket": IntegerType()}
    base, paths = _base(root, spec.name), [f"{_base(root, spec.name)}/{p}" for b in sorted(places) for p in places[b]]
    names = [F.col(f"`{t.columns[f.name]}`").alias(f.name) for f in t.schema] + [F.col(c) for c in extra]
    schema = StructType([StructField(t.columns[f.name], f.dataType) for f in t.schema])
    for c in extra:
        schema = schema.add(c, kinds[c])
    if not paths:
        return spark.createDataFrame([], schema).select(*names)
    return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*names)


def _rows(spark: SparkSession, root: str, spec: TableSpec, t: Target, parts: list[int] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The rows of some parts, or all: those of parts with something beside them are merged with it.

    The keys beside are at most ``BESIDE``, and are broadcast, so nothing is shuffled."""
    mine = lambda places: {b: p for b, p in places.items() if parts is None or b in set(parts)}
    places, deltas = mine(t.places), mine(t.deltas)
    plain = _scan(spark, root, spec, t, {b: p for b, p in places.items() if b not in deltas}, extra)
    if not deltas:
        return plain
    beside = _scan(spark, root, spec, t, deltas, (*extra, "_dead"))
    under = _scan(spark, root, spec, t, {b: p for b, p in places.items() if b in deltas}, extra)
    keys = keyed(beside, spec).select(*key_names(spec))
    if sum(t.delta_sizes.get(b, 0) for b in deltas) <= BESIDE:
        keys = F.broadcast(keys)
    kept = keyed(under, spec).join(keys, key_names(spec), "left_anti").select(*under.columns)
    out = kept.unionByName(beside.where(~F.col("_dead")).drop("_dead"))
    return out if len(deltas) == len(places.keys() | deltas.keys()) else plain.unionByName(out)


def read_target(spark: SparkSession, root: str, spec: TableSpec, at: pointers.Snapshot | None = None) -> DataFrame:
    t = target(spark, root, spec.name, at)
    if t is None:
        raise ValueError(f"{spec.name} has not been loaded")
    return _rows(spark, root, spec, t)


def touched_parts(t: Target, keys: DataFrame, spec: TableSpec) -> list[int]:
    """The parts that hold rows of these keys, if any part does; bounded by the number of parts."""
    rows = keys.where(~_lone(key_columns(keys, spec)))
    if t.bounds is None:
        hit = rows.select(part_of(rows, spec, t).alias("b")).distinct()
        return sorted(r[0] for r in hit.collect())
    span = rows.select(part_of(rows, spec, t).alias("b"), _key(rows, spec).alias("k")).groupBy("b").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    spans = spark_rows(keys.sparkSession, [(b, *t.spans[b]) for b in t.spans], "b int, s_low string, s_high string")
    kind = span.schema["low"].dataType
    known = span.join(F.broadcast(spans), "b", "left").select("b", "low", "high", *[F.from_json(c, kind, _TIMES).alias(c) for c in ("s_low", "s_high")])
    meets = (F.col("low") <= F.col("s_high")) & (F.col("high") >= F.col("s_low"))
    found = {r["b"]: r["meets"] for r in known.select("b", meets.alias("meets")).collect()}
    return sorted(b for b, m in found.items() if m or b in t.deltas)


def spark_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def read_touched(spark: SparkSession, root: str, spec: TableSpec, keys: DataFrame, at: pointers.Snapshot | None = None) -> DataFrame:
    """The rows of the parts that ``keys`` fall into: what a capture or an apply of these keys reads."""
    t = target(spark, root, spec.name, at)
    if t is None:
        raise ValueError(f"{spec.name} has not been loaded")
    return _rows(spark, root, spec, t, touched_parts(t, keys, spec))


def _laid_out(spark: SparkSession, root: str, spec: TableSpec, df: DataFrame, n: int, layout: str, like: Target | None = None) -> Target:
    """A target written anew from rows, in buckets or in ranges of about the same size."""
    if not spec.pk:
        raise ValueError(f"{spec.name}: a target needs a key")
    if layout not in ("hash", "range"):
        raise ValueError(f"unknown layout {layout}")
    t = Target(df.schema, n, {}, bounds=() if layout == "range" else None)
    if like is not None:
        t = replace(t, columns=like.columns, used=like.used)
    if layout == "hash":
        places = _write(_dealt(df, spec, n), spec, root, t.columns)
        return _measured(spark, root, spec, replace(t, places=places), places)
    # Spark samples the keys for the ranges; their least keys, read back, are the bounds
    keys = key_columns(df, spec)
    places = _write(df.repartitionByRange(n, *keys).withColumn("_bucket", F.spark_partition_id()).sortWithinPartitions("_bucket", *keys), spec, root, t.columns)
    t = _measured(spark, root, spec, replace(t, places=places), places)
    order = sorted(t.spans) or sorted(places)
    bare = [b for b in places if b not in t.spans and b not in order]  # rows with nulls in their keys alone
    number = {b: k for k, b in enumerate(order)}
    first = number[order[0]] if order else 0
    placed: Places = {}
    for b, p in places.items():
        k = first if b in bare else number[b]
        placed[k] = placed.get(k, ()) + p
    sizes: dict[int, int] = {}
    for b, rows in t.sizes.items():
        k = first if b in bare else number[b]
        sizes[k] = sizes.get(k, 0) + rows
    spans = {number[b]: s for b, s in t.spans.items()}
    bounds = tuple(spans[k][0] for k in sorted(spans)[1:])
    return replace(t, buckets=max(1, len(bounds) + 1), places=placed, sizes=sizes, spans=spans, bounds=bounds)


def initial_load(base: DataFrame, spec: TableSpec, root: str, mode: str = "create", buckets: int | None = None, layout: str = "hash") -> None:
    """First full load: ``create`` drops a target and makes it anew, ``reinitialize`` empties it and
    keeps its columns, ``append`` (later shards) adds to it; columns are projected and shortened.
    ``layout``: parts are buckets of the key's hash, or ranges of the key, which follow changes of
    neighbouring keys."""
    spark = base.sparkSession
    df = shorten(project_columns(base, spec), spec.shorten)
    have = None if mode == "create" else target(spark, root, spec.name)
    if mode not in ("create", "reinitialize", "append"):
        raise ValueError(f"unknown mode {mode}")
    if have is None:
        if mode == "append":
            raise ValueError(f"{spec.name} has not been loaded")
        commit(spark, root, {spec.name: _laid_out(spark, root, spec, df, buckets or buckets_for(df.count()), layout)})
        return
    names = {c.lower(): c for c in df.columns}
    like = df.select(*[(F.col(names[f.name.lower()]) if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in have.schema])
    if mode == "reinitialize":
        kind = "hash" if have.bounds is None else "range"
        commit(spark, root, {spec.name: _laid_out(spark, root, spec, like, buckets or buckets_for(like.count()), kind, have)})
        return
    dealt = like.withColumn("_bucket", part_of(like, spec, have)).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *spec.pk)
    more = _write(dealt, spec, root, have.columns)
    if set(more) & set(have.deltas):  # appended rows must not be hidden by what lies beside
        have = _folded(spark, root, spec, have, sorted(have.deltas))
    new = replace(have, places={b: have.places.get(b, ()) + more.get(b, ()) for b in have.places.keys() | more.keys()})
    commit(spark, root, {spec.name: _measured(spark, root, spec, new, {b: new.places[b] for b in more})})


def _folded(spark: SparkSession, root: str, spec: TableSpec, t: Target, parts: list[int]) -> Target:
    """Parts written with what lies beside them."""
    new = _write(_rows(spark, root, spec, t, parts, ("_bucket",)).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *spec.pk), spec, root, t.columns)
    return _measured(spark, root, spec, _put(t, parts, new), new)


def _put(t: Target, parts: list[int], new: Places) -> Target:
    """The target with these parts replaced, nothing beside them."""
    out = lambda d: {b: x for b, x in d.items() if b not in set(parts)}
    return replace(t, places=out(t.places) | new, sizes=out(t.sizes), spans=out(t.spans), deltas=out(t.deltas), delta_sizes=out(t.delta_sizes))


def replace_target(spark: SparkSession, root: str, spec: TableSpec, df: DataFrame) -> None:
    """A table rewritten whole, in the layout it has."""
    have = target(spark, root, spec.name)
    commit(spark, root, {spec.name: _laid_out(spark, root, spec, df, buckets_for(df.count()), "hash" if have is None or have.bounds is None else "range")})


Merge = Callable[[DataFrame, DataFrame, TableSpec], DataFrame]
#: Ways to apply a change set to a stored target, by ``TableSpec.method``; all give rows with ``__action``.
METHODS: dict[str, Merge] = {"merge": merged, "delete_insert": delete_inserted, "replace": replaced}


def _beside(t: Target, counts: dict[int, int]) -> list[int]:
    """The touched parts whose changes are laid beside them; the others are written anew."""
    after = {b: t.delta_sizes.get(b, 0) + n for b, n in counts.items()}
    small = {b: n for b, n in after.items() if n * SHARE <= t.sizes.get(b, 0)}
    left = BESIDE - sum(n for b, n in t.delta_sizes.items() if b not in counts)
    for b in sorted(small, key=lambda b: -small[b]):
        if sum(small.values()) <= left:
            break
        del small[b]
    return sorted(small)


def rewrite(spark: SparkSession, root: str, spec: TableSpec, changes: DataFrame, t: Target, merge: Merge | None = None) -> tuple[Target, Applied]:
    """The target with a change set merged into the parts it touches, not yet in force.

    Where a part's changes are few beside its rows (one in ``SHARE``, with those that lie there already),
    only the rows that they match are looked up, and the outcome is written beside the part; else the part
    is written anew.  ``merge`` (that of ``spec.method`` if none is given) gives the rows with
    ``__action``; what it inserts, updates and deletes is counted while the rows are written.
    """
    merge = merge or METHODS[spec.method]
    marked = changes.withColumn("_bucket", part_of(changes, spec, t))
    counts = {r[0]: r[1] for r in marked.groupBy("_bucket").count().collect()}
    beside = _beside(t, counts)
    anew = sorted(counts.keys() - set(beside))
    done = [Applied(sorted(counts))]
    for parts, write in ((anew, _anew), (beside, _lay_beside)):
        if parts:
            mine = marked if len(parts) == len(counts) else marked.where(F.col("_bucket").isin(parts))
            t, did = write(spark, root, spec, t, mine, parts, merge, counts)
            done.append(did)
    return t, Applied(sorted(counts), sum(d.inserted for d in done), sum(d.deleted for d in done))


def _counted(out: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    did = lambda *kinds: F.count_if(F.col("__action").isin(*kinds))
    return out.observe(seen, did("INSERT", "UPDATE").alias("inserted"), did("DELETE", "UPDATE", "BURY").alias("deleted")), seen


def _anew(spark: SparkSession, root: str, spec: TableSpec, t: Target, changes: DataFrame, parts: list[int], merge: Merge, counts: dict[int, int]) -> tuple[Target, Applied]:
    out = merge(_rows(spark, root, spec, t, parts, ("_bucket",)), changes, spec).where("__action is not null")
    out, seen = _counted(out.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *spec.pk))
    new = _write(out.where("__action not in ('DELETE', 'FORGET')").drop("__action"), spec, root, t.columns)
    return _measured(spark, root, spec, _put(t, parts, new), new), Applied(parts, seen.get["inserted"], seen.get["deleted"])


def _lay_beside(spark: SparkSession, root: str, spec: TableSpec, t: Target, changes: DataFrame, parts: list[int], merge: Merge, counts: dict[int, int]) -> tuple[Target, Applied]:
    keys, names = keyed(changes, spec).select(*key_names(spec)), key_names(spec)
    few = sum(counts[b] for b in parts) <= FEW
    sent = F.broadcast(keys) if few else keys
    rows = _rows(spark, root, spec, t, parts, ("_bucket",))
    hit = keyed(rows, spec).join(sent, names, "left_semi").select(*rows.columns)
    out = (merged(hit, changes, spec, hit_only=True) if merge is merged else merge(hit, changes, spec)).where("__action is not null")
    out, seen = _counted(out)
    out = out.withColumn("_dead", F.col("__action") == "DELETE").drop("__action")
    before = {b: t.deltas[b] for b in parts if b in t.deltas}
    if before:
        old = keyed(_scan(spark, root, spec, t, before, ("_bucket", "_dead")), spec)
        put = keyed(changes.where(F.col(OP) != "D"), spec).select(*names)
        live = old.where(~F.col("_dead")).join(sent, names, "left_anti")
        dead = old.where("_dead").join(F.broadcast(put) if few else put, names, "left_anti")  # a second delete leaves a dead key dead
        out = out.unionByName(live.unionByName(dead).drop(*names))
    new = _write(out.hint("rebalance", "_bucket"), spec, root, t.columns)
    rest = {b: p for b, p in t.deltas.items() if b not in set(parts)}
    sizes = {b: n for b, n in t.delta_sizes.items() if b not in set(parts)} | {b: t.delta_sizes.get(b, 0) + counts[b] for b in new}
    return replace(t, deltas=rest | new, delta_sizes=sizes), Applied(parts, seen.get["inserted"], seen.get["deleted"])


def purge(spark: SparkSession, root: str, spec: TableSpec, dead: Column, share: int = SHARE) -> list[int]:
    """Rows that may go, deleted from the parts of which they are more than one row in ``share``; the parts.
    A commit of another writer in between leaves the purge to the next time."""
    base = pointers.snapshot(spark, root)
    t = target(spark, root, spec.name, base)
    rows = _rows(spark, root, spec, t, None, ("_bucket",))
    full = rows.groupBy("_bucket").agg(F.count_if(dead).alias("gone"), F.count(F.lit(1)).alias("n")).where(F.col("gone") * share > F.col("n"))
    parts = sorted(r["_bucket"] for r in full.select("_bucket").collect())
    if parts:
        kept = _rows(spark, root, spec, t, parts, ("_bucket",)).where(~F.coalesce(dead, F.lit(False)))
        new = _write(kept.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *spec.pk), spec, root, t.columns)
        try:
            commit(spark, root, {spec.name: _measured(spark, root, spec, _put(t, parts, new), new)}, base)
        except pointers.Conflict:
            return []
    return parts


def _rebased(before: Target, ours: Target, theirs: Target, touched: list[int]) -> Target | None:
    """Our parts put into a target that another writer has changed meanwhile, if it left them alone."""
    same = lambda x: (x.schema, x.buckets, x.bounds, x.columns)
    if same(before) != same(theirs) or any(before.part(b) != theirs.part(b) for b in touched):
        return None
    mine = set(touched)
    mix = lambda a, b: {k: v for k, v in a.items() if k not in mine} | {k: v for k, v in b.items() if k in mine}
    return replace(
        theirs, places=mix(theirs.places, ours.places), sizes=mix(theirs.sizes, ours.sizes), spans=mix(theirs.spans, ours.spans), deltas=mix(theirs.deltas, ours.deltas),
        delta_sizes=mix(theirs.delta_sizes, ours.delta_sizes),
    )


def apply_group(spark: SparkSession, root: str, group: list[tuple[TableSpec, DataFrame]], notes: Callable[[list[Applied]], dict[str, list]] | None = None, merge: Merge | None = None, tries: int = 10) -> list[Applied]:
    """Several tables changed together or not at all: each writes the parts it touches, then one
    commit puts all in force, with ``notes`` of what was done.

    Two writers don't lose each other's rows: who comes second puts its parts into what the first one
    left, or starts again where both have touched the same part."""
    for _ in range(tries):
        base = pointers.snapshot(spark, root)
        old, new, done = {}, {}, []
        for spec, changes in group:
            t = target(spark, root, spec.name, base)
            if t is None:
                raise ValueError(f"{spec.name} has not been loaded")
            old[spec.name] = t
            new[spec.name], did = rewrite(spark, root, spec, changes, t, merge)
            done.append(did)
        if not any(d.buckets for d in done) and notes is None:
            return done
        while new is not None:
            try:
                commit(spark, root, new, base, notes(done) if notes else None)
                return done
            except pointers.Conflict:
                base = pointers.snapshot(spark, root)
                theirs = {name: target(spark, root, name, base) for name in new}
                both = {spec.name: _rebased(old[spec.name], new[spec.name], theirs[spec.name], did.buckets) for (spec, _), did in zip(group, done, strict=True)}
                new = None if any(t is None for t in both.values()) else both
                old = theirs
    raise RuntimeError(f"other writers have changed the same parts {tries} times")


def apply_to_buckets(spark: SparkSession, changes: DataFrame, spec: TableSpec, root: str) -> Applied:
    """Merge a change set into the parts it touches."""
    return apply_group(spark, root, [(spec, changes)])[0]


#: Types whose files can be read as another one.
_WIDER = {"byte": ("short", "integer", "long", "double"), "short": ("integer", "long", "double"), "integer": ("long", "double"), "float": ("double",)}


def _widens(old: DataType, new: DataType) -> bool:
    if old == new:
        return True
    if isinstance(old, DecimalType) and isinstance(new, DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    return new.typeName() in _WIDER.get(old.typeName(), ())


def evolve_target(spark: SparkSession, root: str, spec: TableSpec, steps: list[dict]) -> bool:
    """Schema changes of a stored target; whether it changed.  Columns are names for columns of files, so
    adding, dropping and renaming write a commit and no rows, and so does a type that files can be read
    as; only another change of type writes the rows anew."""
    t = target(spark, root, spec.name)
    if t is None:
        raise ValueError(f"{spec.name} has not been loaded")
    first, columns, used, narrow = t.schema, dict(t.columns), list(t.used), []
    empty = spark.createDataFrame([], t.schema)
    for step in steps:
        before, empty = empty.schema, evolve(empty, [step])
        gone, new = [n for n in before.names if n not in empty.columns], [n for n in empty.columns if n not in before.names]
        if step["event_type"] == "Rename" and gone:
            columns[new[0]] = columns.pop(gone[0])
            continue
        for n in gone:
            columns.pop(n)
        for n in new:  # a name that files have used for something else gets another column
            taken = {u.lower() for u in used}
            columns[n] = next(c for c in [n, *(f"{n}~{k}" for k in range(2, len(used) + 3))] if c.lower() not in taken)
            used.append(columns[n])
        narrow += [n for n in empty.columns if n in before.names and not _widens(before[n].dataType, empty.schema[n].dataType)]
    if empty.schema == first and columns == t.columns:
        return False
    if narrow:
        replace_target(spark, root, spec, evolve(_rows(spark, root, spec, t), steps))
    else:
        commit(spark, root, {spec.name: replace(t, schema=empty.schema, columns={n: columns[n] for n in empty.columns}, used=tuple(used))})
    return True


# retention -----------------------------------------------------------------------------------------


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete writes, states and commits that are neither in force nor under a reader's lease; not while
    something is being applied.  Returns what was deleted."""
    now = pointers.snapshot(spark, root)
    if not now.seq:
        return []
    states = set(now.tables.values()) | pointers.leased(spark, root)
    used = set()
    for name in states:
        t = Target.of(pointers.read_state(spark, root, name))
        table = name.rsplit("-", 1)[0]
        used |= {(table, p.split("/")[0]) for d in (t.places, t.deltas) for places in d.values() for p in places}
    gone = []
    for t in children(spark, f"{root}/target"):
        gone += [f"{root}/target/{t}/{w}" for w in children(spark, f"{root}/target/{t}") if w.startswith("write=") and (t.removeprefix("table="), w) not in used]
    for path in gone:
        delete(spark, path)
    return gone + pointers.sweep(spark, root, states)


def delete_change_sets(spark: SparkSession, root: str, expired: DataFrame) -> list[str]:
    """Delete the change sets, manifests and schema changes of expired ctids; returns the folders.
    One store is one feed; an operator's ``expired`` has a bounded number of batches."""
    ctids = {f"ctid={r[0]}" for r in expired.select("ctid").distinct().collect()}
    places = [f"change_sets/{t}" for t in children(spark, f"{root}/change_sets")] + ["manifest", "schema_changes"]
    gone = [f"{root}/{p}/{n}" for p in places for n in children(spark, f"{root}/{p}") if n in ctids]
    for path in gone:
        delete(spark, path)
    return gone
