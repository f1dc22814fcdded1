"""A workspace of stored data sets with a small catalog, fitted operators, and pipelines of them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseloom.operators.keyed import Keyed, assert_unique, sql_over


class Workspace:
    """Parquet tables under ``path/artifacts`` and one JSON entry each under ``path/catalog``, written last: a table
    without its entry is an unfinished one, which a rerun writes again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for d in ("artifacts", "catalog", "operators"):
            self._fs.mkdirs(self._fs_path(f"{self.path}/{d}"))

    def _put(self, name: str, entry: dict) -> None:
        target, staged = self._fs_path(f"{self.path}/catalog/{name}.json"), self._fs_path(f"{self.path}/catalog/.{name}.{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self._fs.delete(target, False)
        self._fs.rename(staged, target)

    def entries(self) -> dict[str, dict]:
        out = {}
        for s in self._fs.listStatus(self._fs_path(f"{self.path}/catalog")):
            name = s.getPath().getName()
            if name.endswith(".json") and not name.startswith("."):
                stream = self._fs.open(s.getPath())
                out[name[:-5]] = json.loads(bytes(stream.readAllBytes()).decode())
                stream.close()
        return out

    def catalog(self) -> DataFrame:
        """Name, id, kind, key, mode, bases, operation, state and time of every data set."""
        rows = [(n, e["id"], e["kind"], ",".join(e["pk"]), e["mode"], ",".join(e["bases"]), e.get("operation"), e["deleted"], e["at"], ",".join(e.get("aliases", []))) for n, e in sorted(self.entries().items())]
        return self.spark.createDataFrame(rows, "name string, id string, kind string, primary_key string, mode string, bases string, operation string, deleted boolean, at double, aliases string")

    def save(self, t: Keyed, name: str, operation: str | None = None, overwrite: bool = False) -> Keyed:
        """Store own columns only; what is inherited stays with its owner. The key is checked. An existing name is reused
        unless it is to be overwritten."""
        entries = self.entries()
        if name in entries and not entries[name]["deleted"] and not overwrite:
            return self.load(name)
        unnamed = [b for b in t.bases if not b.name or b.name not in entries]
        if unnamed:
            raise ValueError("save the bases first")
        assert_unique(t.df, t.pk)
        id_ = uuid.uuid4().hex
        t.df.write.parquet(f"{self.path}/artifacts/{id_}")
        if t.bridge is not None:
            t.bridge.write.parquet(f"{self.path}/artifacts/{id_}-bridge")
        self._put(name, {"id": id_, "kind": t.kind, "pk": t.pk, "data": t.data, "metadata": t.metadata, "mode": t.mode, "bases": [b.name for b in t.bases], "bridge": t.bridge is not None, "operation": operation, "deleted": False, "at": time.time(), "aliases": []})
        return self.load(name)

    def save_parts(self, name: str, source: Keyed, compute: Callable[[Keyed], Keyed], parts: int = 16, operation: str | None = None) -> Keyed:
        """``compute`` over a source in ``parts`` disjoint parts by the hash of its key, each written when it is done: after
        a crash, the same call does only the parts that are missing. ``compute`` must work row by row or by whole keys."""
        entries = self.entries()
        if name in entries and not entries[name]["deleted"]:
            return self.load(name)
        if not source.name or source.name not in entries:
            raise ValueError("save the source first")
        stage = f"{self.path}/operators/{name}-parts"
        made = None
        for i in range(parts):
            part = Keyed(source.df.where(F.pmod(F.xxhash64(*source.pk), F.lit(parts)) == i), source.pk, source.data, source.metadata, source.bases, source.mode, source.name, source.bridge, source.kind)
            made = compute(part)
            if not self._fs.exists(self._fs_path(f"{stage}/part={i}/_SUCCESS")):
                made.df.write.mode("overwrite").parquet(f"{stage}/part={i}")
        whole = self.spark.read.schema(made.df.schema).parquet(*[f"{stage}/part={i}" for i in range(parts)])
        out = self.save(Keyed(whole, made.pk, made.data, made.metadata, [source], made.mode, kind=made.kind), name, operation)
        self._fs.delete(self._fs_path(stage), True)
        return out

    def load(self, name: str) -> Keyed:
        entries = self.entries()
        for n, e in entries.items():
            if name in (n, e["id"], *e.get("aliases", [])):
                if e["deleted"]:
                    raise ValueError(f"{name} was deleted")
                at = f"{self.path}/artifacts/{e['id']}"
                bridge = self.spark.read.parquet(at + "-bridge") if e["bridge"] else None
                return Keyed(self.spark.read.parquet(at), e["pk"], e["data"], e["metadata"], [self.load(b) for b in e["bases"]], e["mode"], n, bridge, e["kind"])
        raise ValueError(f"no data set {name!r}")

    def alias(self, name: str, alias: str, remove: bool = False) -> None:
        entries = self.entries()
        if not remove and any(alias in (n, *e.get("aliases", [])) for n, e in entries.items()):
            raise ValueError(f"{alias} is taken")
        e = entries[name]
        e["aliases"] = [a for a in e.get("aliases", []) if a != alias] + ([] if remove else [alias])
        self._put(name, e)

    def prefer(self, name: str, alias: str) -> None:
        """Put one of a data set's aliases first, the one that the catalog shows."""
        e = self.entries()[name]
        if alias not in e.get("aliases", []):
            raise ValueError(f"{alias} is no alias of {name}")
        e["aliases"] = [alias, *[a for a in e["aliases"] if a != alias]]
        self._put(name, e)

    def export(self, name: str, path: str, format: str = "parquet") -> None:
        """All columns of a data set, inherited ones too, as ``parquet``, ``jsonl`` or ``csv`` files."""
        df = self.load(name).query(ordered=False)
        if format == "csv":
            df.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        elif format == "jsonl":
            df.write.option("ignoreNullFields", False).json(path)
        elif format == "parquet":
            df.write.parquet(path)
        else:
            raise ValueError(f"no format {format!r}")

    def delete(self, name: str, recursive: bool = False) -> list[str]:
        """Mark as deleted; with dependents only if recursive."""
        entries = self.entries()
        below = [n for n, e in entries.items() if name in e["bases"] and not e["deleted"]]
        if below and not recursive:
            raise ValueError(f"{name} is the base of {below}")
        gone = [x for b in below for x in self.delete(b, True)]
        entries[name]["deleted"] = True
        self._put(name, entries[name])
        return [*gone, name]

    def restore(self, name: str) -> None:
        e = self.entries()[name]
        e["deleted"] = False
        self._put(name, e)

    def purge(self, name: str) -> None:
        """Remove a deleted data set's files."""
        e = self.entries()[name]
        if not e["deleted"]:
            raise ValueError("delete it first")
        for p in (f"artifacts/{e['id']}", f"artifacts/{e['id']}-bridge", f"catalog/{name}.json"):
            self._fs.delete(self._fs_path(f"{self.path}/{p}"), True)

    def sql(self, names: Sequence[str], query: str) -> DataFrame:
        if len(set(names)) < len(names):
            raise ValueError("a name is given twice")
        return sql_over(self.spark, {n: self.load(n) for n in names}, query)

    def operations(self) -> DataFrame:
        return self.catalog().where("operation IS NOT NULL").select("operation", F.col("name").alias("output"), F.col("bases").alias("sources"), "at")


@dataclass
class Step:
    """One stage: ``fit(*inputs) -> state`` (optional) and ``transform(state, *inputs) -> output``."""

    name: str
    inputs: list[str]
    transform: Callable
    fit: Callable | None = None
    state: object = None
    frozen: bool = False


@dataclass
class Pipeline:
    """A graph of steps over named inputs. Nothing runs but what fitting needs; outputs are lazy."""

    steps: list[Step] = field(default_factory=list)

    def add(self, name: str, inputs: Sequence[str] | str, transform: Callable, fit: Callable | None = None) -> "Pipeline":
        if any(s.name == name for s in self.steps):
            raise ValueError(f"two steps named {name}")
        self.steps.append(Step(name, [inputs] if isinstance(inputs, str) else list(inputs), transform, fit))
        return self

    def order(self, given: Sequence[str]) -> list[Step]:
        """Steps in an order in which every input is there; a cycle or an unknown input is an error."""
        ready, left, out = set(given), list(self.steps), []
        while left:
            step = next((s for s in left if set(s.inputs) <= ready), None)
            if step is None:
                raise ValueError(f"inputs that never come: {sorted({i for s in left for i in s.inputs} - ready)}")
            left.remove(step)
            ready.add(step.name)
            out.append(step)
        return out

    def run(self, inputs: dict, outputs: Sequence[str] | None = None, refit: bool = False) -> dict:
        values = dict(inputs)
        for s in self.order(list(inputs)):
            args = [values[i] for i in s.inputs]
            if s.fit and (refit or not s.frozen):
                s.state, s.frozen = s.fit(*args), True
            values[s.name] = s.transform(s.state, *args)
        return {n: values[n] for n in (outputs or [s.name for s in self.steps])}


    def extract(self, outputs: Sequence[str]) -> "Pipeline":
        """Only the steps that some outputs need, with their state."""
        by_name, wanted, todo = {s.name: s for s in self.steps}, set(), list(outputs)
        if unknown := [o for o in outputs if o not in by_name]:
            raise ValueError(f"no steps {unknown}")
        while todo:
            step = by_name.get(todo.pop())
            if step and step.name not in wanted:
                wanted.add(step.name)
                todo += step.inputs
        return Pipeline([s for s in self.steps if s.name in wanted])

    def save(self, spark: SparkSession, path: str) -> None:
        """A portable folder: functions and plain states pickled, states that are tables as Parquet, models of pyspark.ml
        in their own format."""
        from pyspark import cloudpickle

        plain = []
        for i, s in enumerate(self.steps):
            kind, state = "plain", s.state
            if isinstance(state, DataFrame):
                kind = "table"
                state.write.mode("overwrite").parquet(f"{path}/state-{i}")
            elif hasattr(state, "write") and type(state).__module__.startswith("pyspark.ml"):
                kind = f"{type(state).__module__}:{type(state).__name__}"
                state.write().overwrite().save(f"{path}/state-{i}")
            plain.append((s.name, s.inputs, s.transform, s.fit, state if kind == "plain" else None, s.frozen, kind))
        spark.createDataFrame([(bytearray(cloudpickle.dumps(plain)),)], "steps binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/steps")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Pipeline":
        """A pipeline of :meth:`save`. It is unpickled: only load what you trust."""
        import importlib
        import pickle

        steps = []
        for i, (name, inputs, transform, fit, state, frozen, kind) in enumerate(pickle.loads(spark.read.parquet(f"{path}/steps").first().steps)):
            if kind == "table":
                state = spark.read.parquet(f"{path}/state-{i}")
            elif kind != "plain":
                module, _, cls_name = kind.partition(":")
                state = getattr(importlib.import_module(module), cls_name).load(f"{path}/state-{i}")
            steps.append(Step(name, inputs, transform, fit, state, frozen))
        return cls(steps)


def save_state(spark: SparkSession, path: str, params: dict, tables: dict[str, DataFrame] | None = None) -> None:
    """A fitted operator's parameters and tables."""
    for n, t in (tables or {}).items():
        t.write.mode("overwrite").parquet(f"{path}/{n}")
    spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.mode("overwrite").json(f"{path}/_params")


def load_state(spark: SparkSession, path: str, tables: Sequence[str] = ()) -> tuple[dict, dict[str, DataFrame]]:
    params = json.loads(spark.read.json(f"{path}/_params").first().params)
    return params, {n: spark.read.parquet(f"{path}/{n}") for n in tables}


class BinaryCoding:
    """Hand coding of rows as 0 or 1, kept in a workspace: each decision is stored at once, a new session goes on at the
    first row without one, and :meth:`finish` gives the labels as a data set once every row has one."""

    def __init__(self, workspace: Workspace, name: str, source: Keyed, text_field: str, instructions: str):
        if not instructions.strip():
            raise ValueError("coders need instructions")
        source.require([text_field])
        self.workspace, self.name, self.source, self.text_field, self.instructions = workspace, name, source, text_field, instructions
        self._folder = f"{workspace.path}/operators/coding-{name}"
        workspace._fs.mkdirs(workspace._fs_path(self._folder))

    def decisions(self) -> DataFrame:
        schema = ", ".join(f"{k} bigint" for k in self.source.pk) + ", code int"
        return self.workspace.spark.read.schema(schema).json(self._folder)

    def pending(self, n: int = 1, before: int = 2, after: int = 2) -> list[dict]:
        """The next rows to code in the table's order: key, text, and the texts around it."""
        rows = self.source.query([self.text_field], ordered=False).join(self.decisions().select(*self.source.pk), self.source.pk, "left_anti")
        out = []
        for r in rows.orderBy(*self.source.pk).limit(n).collect():
            key = {k: r[k] for k in self.source.pk}
            around = self.source.context(key, before, after, [self.text_field]).collect()
            out.append({"key": key, "text": r[self.text_field], "context": [x[self.text_field] for x in around]})
        return out

    def code(self, key: dict, value: int) -> None:
        if value not in (0, 1) or set(key) != set(self.source.pk):
            raise ValueError("a code is 0 or 1 for a whole key")
        name = "-".join(str(int(key[k])) for k in self.source.pk)
        out = self.workspace._fs.create(self.workspace._fs_path(f"{self._folder}/{name}.json"), True)
        out.write(bytearray(json.dumps({**{k: int(key[k]) for k in self.source.pk}, "code": value}).encode()))
        out.close()

    def finish(self) -> Keyed:
        from verseloom.operators.joins import from_keyed_frame

        return from_keyed_frame(self.source, self.decisions(), ["code"], require_complete=True)


def translate_values(spark: SparkSession, values: Sequence[str | dict], operator: Callable[[Keyed], Keyed | DataFrame], field_name: str = "text") -> list[dict]:
    """Run an operator on values in memory, without a workspace: strings (as ``field_name``) or records become rows with the
    key ``row_id``, in order; the result comes back as records in key order."""
    from verseloom.sources.readers import payload_table

    records = [{"row_id": i, **(v if isinstance(v, dict) else {field_name: v})} for i, v in enumerate(values)]
    if not records:
        return []
    made = operator(payload_table(spark, records, ["row_id"]))
    if isinstance(made, Keyed):
        return [r.asDict(recursive=True) for r in made.query(sorted(made.data)).collect()]
    keys = [k for k in ("row_id",) if k in made.columns]
    return [r.asDict(recursive=True) for r in (made.orderBy(*keys) if keys else made).collect()]
