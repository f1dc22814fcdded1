"""Keyed data sets: a DataFrame with an integer primary key, a total row order and named column groups.

The order is a rule, not a stored number: rows stand in the order of their key, unless the data set has a column
``_position`` of values to order by. Ranks are made, of the keys only, when a query asks for positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verseloom.runtime import materialize

POSITION = "_position"
#: How the key of a derived data set comes from its bases.
MODES = ("new_key", "preserved_key", "extended_key", "reduced_key", "span_key", "merged_key", "joined_key", "rekeyed_key")


class KeyError_(ValueError):
    """Missing, null, fractional or duplicate keys."""


def with_position(df: DataFrame, order_by: Sequence[str | Column], name: str = POSITION) -> DataFrame:
    """Add the 0-based rank of each row in the given order. Rows are sorted by ranges over all tasks; each takes its
    range's offset plus its place in it, so no single task sees all rows."""
    order = list(order_by)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = materialize(placed, "positions")
    sizes = placed.groupBy("__pid").count()
    offsets = sizes.select("__pid", F.coalesce(F.sum("count").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    # one row per partition of the sort
    return placed.join(F.broadcast(offsets), "__pid").withColumn(name, F.col("__off") + F.col("__at")).drop("__pid", "__at", "__off")


def integer_key(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Key columns as longs; a null, fractional or infinite key raises when the plan runs."""
    checks = {}
    for k in pk:
        if k.startswith("_"):
            raise KeyError_(f"key names may not start with an underscore: {k}")
        c = F.col(f"`{k}`")
        n = c.try_cast("bigint")
        bad = n.isNull()
        if not isinstance(df.schema[k].dataType, T.IntegralType):
            bad = bad | (c.try_cast("double") != n.cast("double"))
        checks[k] = F.when(bad, F.raise_error(F.concat(F.lit(f"not an integer key in {k}: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("bigint")).otherwise(n)
    return df.withColumns(checks)


def assert_unique(df: DataFrame, pk: Sequence[str], what: str = "key") -> None:
    """Raise if a key occurs twice: one shuffle aggregation."""
    twice = df.groupBy(*pk).count().where("count > 1").limit(3).collect()
    if twice:
        raise KeyError_(f"duplicate {what}: {[tuple(r)[:-1] for r in twice]}")


@dataclass
class Keyed:
    """``df`` holds the key, ``_position`` and the columns of its ``data`` and ``metadata`` groups. ``bases`` and ``mode``
    say where it came from; columns that it doesn't own are inherited lazily when a query asks for them."""

    df: DataFrame
    pk: list[str]
    data: list[str] = field(default_factory=list)
    metadata: list[str] = field(default_factory=list)
    bases: list["Keyed"] = field(default_factory=list)
    mode: str = "new_key"
    name: str = ""
    bridge: DataFrame | None = None
    kind: str = "table"
    features: DataFrame | None = None
    ranks: DataFrame | None = field(default=None, repr=False, compare=False)

    # -- making ---------------------------------------------------------------------------------------------------
    @classmethod
    def of(cls, df: DataFrame, pk: Sequence[str], data: Sequence[str] | None = None, metadata: Sequence[str] = (), order_by: Sequence[str | Column] | None = None, check: bool = False, name: str = "") -> "Keyed":
        """``order_by``: an order other than that of the key; its ranks are made at once. A column ``_position`` that is
        there already is taken for the order."""
        pk = list(pk)
        df = integer_key(df, pk)
        if check:
            assert_unique(df, pk)
        data = [c for c in df.columns if c not in {*pk, *metadata, POSITION}] if data is None else list(data)
        if order_by and POSITION not in df.columns and [c if isinstance(c, str) else None for c in order_by] != pk:
            ranks = with_position(df.select(*pk, *[(F.col(c) if isinstance(c, str) else c).alias(f"__o{i}") for i, c in enumerate(order_by)]), [f"__o{i}" for i in range(len(order_by))])
            df = df.join(ranks.select(*pk, POSITION), pk)
        df = df.select(*[c for c in (*pk, *data, *metadata, *([POSITION] if POSITION in df.columns else []))])
        return cls(df, pk, data, list(metadata), name=name)

    def derive(self, df: DataFrame, mode: str, pk: Sequence[str] | None = None, data: Sequence[str] = (), metadata: Sequence[str] = (), bases: Sequence["Keyed"] | None = None, bridge: DataFrame | None = None) -> "Keyed":
        pk = list(pk or self.pk)
        bases = [self] if bases is None else list(bases)
        check_mode(mode, pk, [b.pk for b in bases])
        return Keyed(df, pk, list(data), list(metadata), bases, mode, bridge=bridge)

    # -- lineage --------------------------------------------------------------------------------------------------
    @property
    def key_columns(self) -> list[str]:
        """The key, and the order's column if there is one."""
        return [*self.pk, POSITION] if POSITION in self.df.columns else list(self.pk)

    def keys(self) -> DataFrame:
        return self.df.select(*self.key_columns)

    def order(self) -> list[Column]:
        return [F.col(POSITION)] if POSITION in self.df.columns else [F.col(k) for k in self.pk]

    def order_value(self) -> Column:
        """One value to order rows by."""
        return F.col(POSITION) if POSITION in self.df.columns else F.struct(*self.pk)

    def order_array(self) -> Column:
        """The same as an array of longs, so that more may be put before or after it."""
        if POSITION not in self.df.columns:
            return F.array(*[F.col(k).cast("bigint") for k in self.pk])
        return F.col(POSITION) if isinstance(self.df.schema[POSITION].dataType, T.ArrayType) else F.array(F.col(POSITION).cast("bigint"))

    def positions(self) -> DataFrame:
        """The key and ``_position``, the 0-based rank of each row: made once, of the keys only."""
        if self.ranks is None:
            self.ranks = with_position(self.keys(), self.order(), "__rank").select(*self.pk, F.col("__rank").alias(POSITION))
        return self.ranks

    def positioned(self, columns: Sequence[str]) -> DataFrame:
        """:meth:`view` with ``_position`` as the rank of each row."""
        return self.view(columns).drop(POSITION).join(self.positions(), self.pk)

    def inherited(self) -> dict[str, tuple["Keyed", str]]:
        """Names of columns that lineage adds, with the data set that owns each and its group."""
        out: dict[str, tuple[Keyed, str]] = {}
        for b in self.bases:
            if self.mode in ("preserved_key", "joined_key", "rekeyed_key", "merged_key"):
                for c in b.data:
                    out.setdefault(c, (b, "data"))
            if self.mode != "new_key":
                for c in b.metadata:
                    out.setdefault(c, (b, "metadata"))
            for c, (owner, group) in b.inherited().items():
                if group == "data" and self.mode in ("preserved_key", "joined_key", "rekeyed_key", "merged_key"):
                    out.setdefault(c, (owner, group))
                if group == "metadata" and self.mode != "new_key" and (self.mode not in ("reduced_key", "span_key") or set(owner.pk) <= set(self.pk)):
                    out.setdefault(c, (owner, group))
        for c in (*self.data, *self.metadata):
            out.pop(c, None)
        return out

    def all_columns(self) -> dict[str, str]:
        """Group of every column that a query can name."""
        return {**{k: "key" for k in self.pk}, **{c: "data" for c in self.data}, **{c: "metadata" for c in self.metadata}, **{c: g for c, (_, g) in self.inherited().items()}}

    def view(self, columns: Sequence[str]) -> DataFrame:
        """Key, position and the named columns. Only the ancestors that own one of them are joined."""
        own = [c for c in columns if c in self.data or c in self.metadata]
        df = self.df.select(*self.pk, *([POSITION] if POSITION in self.df.columns else []), *own)
        wanted = [c for c in columns if c not in own and c not in self.pk]
        if not wanted:
            return df
        if self.mode == "merged_key":
            parts = [b.view(wanted).select(*self.pk, *wanted) for b in self.bases]
            union = parts[0]
            for p in parts[1:]:
                union = union.unionByName(p)
            return df.join(union, self.pk, "left")
        for b in self.bases:
            have = b.all_columns()
            mine = [c for c in wanted if c in have and c not in df.columns]
            if not mine:
                continue
            on = [k for k in self.pk if k in b.pk]
            right = b.view(mine)
            if self.mode == "rekeyed_key":
                df = df.join(self.bridge.join(right.select(*b.pk, *mine), b.pk, "left").select(*self.pk, *mine), self.pk, "left")
            elif self.mode in ("reduced_key", "span_key"):
                owner_pk = [k for k in b.pk if k in self.pk]
                df = df.join(right.select(*owner_pk, *mine).dropDuplicates(owner_pk), owner_pk, "left")
            else:
                df = df.join(right.select(*on, *mine), on, "left")
            wanted = [c for c in wanted if c not in mine]
        if wanted:
            raise ValueError(f"unknown columns: {wanted}; there are {sorted(self.all_columns())}")
        return df

    # -- reading --------------------------------------------------------------------------------------------------
    def query(
        self, columns: Sequence[str] | None = None, where: str | None = None, order_by: Sequence[str | Column] | None = None, positions: Sequence[int] | None = None,
        sample_n: int | None = None, sample_frac: float | None = None, seed: int = 0, limit: int | None = None, with_tables: Sequence[tuple["Keyed", Sequence[str]]] = (), metadata_mode: str = "full", ordered: bool = True,
    ) -> DataFrame:
        """The one way to read: projection, a filter over all columns (also those not projected), attached coarser tables,
        positions (in request order, with repeats), a seeded sample, order (nulls last) and limit."""
        from verseloom.operators.joins import attach

        if metadata_mode not in ("none", "local", "full"):
            raise ValueError(f"no metadata mode {metadata_mode!r}")
        groups = self.all_columns()
        visible = [c for c, g in groups.items() if g != "key" and (g != "metadata" or metadata_mode == "full" or (metadata_mode == "local" and c in self.metadata))]
        added = [c for _, cs in with_tables for c in cs]
        chosen = [*[c for c in visible], *added] if columns is None else list(columns)
        if unknown := [c for c in chosen if c not in groups and c not in added]:
            raise ValueError(f"unknown columns: {unknown}; there are {sorted(groups)}")
        hidden = [c for c in chosen if c in groups and groups[c] == "metadata" and c not in visible]
        if hidden:
            raise ValueError(f"metadata columns {hidden} asked for with metadata_mode={metadata_mode!r}")
        mentioned = attributes(self.df.sparkSession, where) if where else set()
        sorts = [c.split()[0] for c in (order_by or []) if isinstance(c, str)]
        need = list(dict.fromkeys([c for c in (*chosen, *[v for v in visible if v in mentioned], *sorts) if c in groups and groups[c] != "key"]))
        order: list[Column] = self.order()
        if positions is not None:
            asked = self.df.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(positions)], f"{POSITION} bigint, __ord bigint")
            picked = self.positions().join(F.broadcast(asked), POSITION)
            df, order = self.view(need).drop(POSITION).join(F.broadcast(picked), self.pk), [F.col("__ord").asc()]  # one row per position in the call
        elif POSITION in mentioned or POSITION in sorts:
            df, order = self.positioned(need), [F.col(POSITION)]
        else:
            df = self.view(need)
        for table, cs in with_tables:
            df = attach(df, self.pk, table, cs)
        if where:
            df = df.where(where)
        if sample_n is not None or sample_frac is not None:
            df = hash_sample(df, sample_n, sample_frac, seed, self.pk)
        if order_by:
            order = [_nulls_last(c) for c in order_by]
        if ordered or limit is not None:
            df = df.orderBy(*order)
        if limit is not None:
            df = df.limit(limit)
        return df.select(*self.pk, *[c for c in chosen if c not in self.pk])

    def preview(self, n: int = 20) -> DataFrame:
        return self.query(limit=n)

    def records(self, columns: Sequence[str] | None = None, limit: int | None = None, **request) -> list[dict]:
        """Rows as dicts at the driver."""
        return [r.asDict(recursive=True) for r in self.query(columns, limit=limit, **request).collect()]

    def table(self, columns: Sequence[str] | None = None, limit: int | None = None, **request):
        """Rows as a pandas frame at the driver."""
        return self.query(columns, limit=limit, **request).toPandas()

    def batches(self, columns: Sequence[str] | None = None) -> Iterator:
        """Rows in order, one partition at a time at the driver."""
        return self.query(columns).toLocalIterator(prefetchPartitions=True)

    def get(self, key: int | Sequence[int] | dict, columns: Sequence[str] | None = None) -> DataFrame:
        """The row of one key: a scalar, a tuple in key order or a dict."""
        values = key if isinstance(key, dict) else dict(zip(self.pk, key if isinstance(key, (tuple, list)) else [key]))
        if set(values) != set(self.pk):
            raise KeyError_(f"{key!r} is not a key of {self.pk}")
        return self.query(columns, where=" AND ".join(f"`{k}` = {int(v)}" for k, v in values.items()))

    def at(self, index: int | slice, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows by position: an index or a half-open slice."""
        if isinstance(index, slice):
            low, high = index.start or 0, index.stop
            return self.query(columns, where=f"{POSITION} >= {low}" + (f" AND {POSITION} < {high}" if high is not None else ""))
        return self.query(columns, where=f"{POSITION} = {int(index)}")

    def context(self, request: dict[str, int | tuple[int, int]], before: int = 0, after: int = 0, columns: Sequence[str] | None = None, include_focus: bool = True) -> DataFrame:
        """Rows around those that match ``request``: equal keys, or a ``(start, end)`` range of a leaf key. The window is
        ``before`` and ``after`` positions around the least and greatest match."""
        parts = [F.col(k).between(*v) if isinstance(v, tuple) else F.col(k) == v for k, v in request.items()]
        match = parts[0]
        for p in parts[1:]:
            match = match & p
        span = self.positions().where(match).agg(F.min(POSITION).alias("lo"), F.max(POSITION).alias("hi")).first()
        if span.lo is None:
            raise KeyError_(f"no row matches {request}")
        where = f"{POSITION} BETWEEN {span.lo - before} AND {span.hi + after}"
        if not include_focus:
            where += f" AND NOT ({POSITION} BETWEEN {span.lo} AND {span.hi})"
        return self.query(columns, where=where)

    def previous(self, request: dict, n: int = 1, columns: Sequence[str] | None = None) -> DataFrame:
        return self.context(request, before=n, columns=columns, include_focus=False)

    def next(self, request: dict, n: int = 1, columns: Sequence[str] | None = None) -> DataFrame:
        return self.context(request, after=n, columns=columns, include_focus=False)

    def named(self, name: str) -> "Keyed":
        return replace(self, name=name)

    def summary(self) -> DataFrame:
        spark = self.df.sparkSession
        return spark.createDataFrame([(self.name, self.kind, self.df.count(), ",".join(self.pk), ",".join(self.all_columns()))], "name string, kind string, rows bigint, primary_key string, columns string")

    def require(self, columns: Sequence[str]) -> None:
        if missing := [c for c in columns if c not in self.all_columns()]:
            raise ValueError(f"unknown columns: {missing}")


def _nulls_last(c: str | Column) -> Column:
    if isinstance(c, Column):
        return c
    name, _, way = c.partition(" ")
    return F.col(name).desc_nulls_last() if way.strip().lower().startswith("desc") else F.col(name).asc_nulls_last()


def attributes(spark, expression: str) -> set[str]:
    """Names of the columns in a SQL expression."""
    names, todo = set(), [spark._jsparkSession.sessionState().sqlParser().parseExpression(expression)]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "UnresolvedAttribute":
            names.add(node.nameParts().mkString("."))
        inner = node.children().iterator()
        while inner.hasNext():
            todo.append(inner.next())
    return names


def hash_sample(df: DataFrame, n: int | None, frac: float | None, seed: int, key: Sequence[str]) -> DataFrame:
    """``n`` rows, or the rounded share ``frac``, by the hash of key and seed (ties by key): the same rows on any cluster.

    The hash range is cut into bins. Rows of bins below the one in which the n-th row falls are taken as they are, without
    a shuffle; only that one bin's rows are ordered."""
    total = df.count()
    n = int(total * frac + 0.5) if n is None else n
    if n >= total:
        return df
    bits = min(20, max(4, (total // 20_000).bit_length()))
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), *key)).withColumn("__bin", F.shiftright("__h", 64 - bits))
    counts = hashed.groupBy("__bin").agg(F.count("*").alias("n"))
    # at most 2**20 rows, one per bin
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = upto.where(F.col("upto") >= n).orderBy("__bin").first()
    below = hashed.where(F.col("__bin") < edge["__bin"])
    rest = hashed.where(F.col("__bin") == edge["__bin"]).orderBy("__h", *key).limit(n - (edge.upto - edge.n))
    return below.unionByName(rest).drop("__h", "__bin")


def check_mode(mode: str, pk: Sequence[str], bases: Sequence[Sequence[str]]) -> None:
    """Raise if the key can't come from the bases' keys in this mode."""
    if mode not in MODES:
        raise ValueError(f"no lineage mode {mode!r}")
    pk = list(pk)
    prefix = lambda a, b: 0 < len(a) < len(b) and b[: len(a)] == a
    ok = {
        "new_key": True, "preserved_key": all(list(b) == pk for b in bases), "extended_key": all(prefix(list(b), pk) for b in bases),
        "reduced_key": all(prefix(pk, list(b)) for b in bases), "span_key": all(pk == [*list(b)[:-1], f"{b[-1]}_start", f"{b[-1]}_end"] for b in bases),
        "merged_key": len(bases) >= 2 and all(list(b) == pk for b in bases), "joined_key": len(bases) >= 2 and all(list(b) == pk for b in bases), "rekeyed_key": len(bases) == 1,
    }[mode]
    if not ok or (mode != "new_key" and not bases):
        raise ValueError(f"{mode}: key {pk} doesn't follow from {[list(b) for b in bases]}")


def sql_over(spark, tables: dict[str, Keyed], query: str, metadata_mode: str = "full") -> DataFrame:
    """Any Spark SQL over keyed data sets, each a view under its name with all its columns, and ``_position`` where the query names it."""
    for name, t in tables.items():
        cols = [c for c, g in t.all_columns().items() if g != "key" and (g != "metadata" or metadata_mode != "none")]
        (t.positioned(cols) if POSITION in query else t.view(cols)).createOrReplaceTempView(name)
    return spark.sql(query)


def map_rows(t: Keyed, function: Callable, schema: str, columns: Sequence[str] | None = None) -> Keyed:
    """Row-preserving map: ``function(pandas frame) -> pandas frame`` of the new columns, in batches; keys are carried."""
    import pandas as pd

    cols = list(columns or [*t.data, *t.metadata])
    new = T._parse_datatype_string(schema)
    keys = t.key_columns
    full = T.StructType([t.df.schema[k] for k in keys] + new.fields)

    def run(frames):
        for f in frames:
            out = function(f[cols])
            if len(out) != len(f):
                raise ValueError("a row map must give one row for each row")
            yield pd.concat([f[keys].reset_index(drop=True), out.reset_index(drop=True)], axis=1)[[x.name for x in full]]

    return t.derive(t.view(cols).select(*keys, *cols).mapInPandas(run, full), "preserved_key", data=new.names)
