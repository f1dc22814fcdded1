"""One table and its attached tables under one set of column names, shared by all that reads them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from verseloom.operators.keyed import Keyed


@dataclass(frozen=True)
class Scope:
    """What a table's queries may name: its key, data and (by ``metadata_mode``) metadata, and the columns of attached
    coarser tables. A name of an attached table that is taken is output as ``table.name``."""

    table: Keyed
    with_tables: tuple[tuple[Keyed, Sequence[str]], ...] = ()
    metadata_mode: str = "full"
    include_data: bool = True
    _names: dict = field(default_factory=dict, repr=False, compare=False)

    def columns(self) -> list[dict[str, str]]:
        """``output``, ``base``, ``group`` (key, data, metadata or attached) and ``owner`` of every column."""
        if "all" not in self._names:
            out = []
            inherited = self.table.inherited()
            for name, group in self.table.all_columns().items():
                if group == "data" and not self.include_data:
                    continue
                if group == "metadata" and (self.metadata_mode == "none" or (self.metadata_mode == "local" and name not in self.table.metadata)):
                    continue
                owner = inherited[name][0] if name in inherited else self.table
                out.append({"output": name, "base": name, "group": group, "owner": owner.name})
            taken = {c["output"] for c in out}
            for table, names in self.with_tables:
                for name in names:
                    label = name if name not in taken else f"{table.name or 'with'}.{name}"
                    if label in taken:
                        raise ValueError(f"two columns named {label}")
                    taken.add(label)
                    out.append({"output": label, "base": name, "group": "attached", "owner": table.name})
            self._names["all"] = out
        return self._names["all"]

    def resolve(self, name: str, group: str | None = None) -> str:
        """The output name of a column: an exact output name, else the one column of that base name."""
        known = [c for c in self.columns() if group in (None, c["group"])]
        found = [c for c in known if c["output"] == name] or [c for c in known if c["base"] == name]
        if len(found) != 1:
            raise ValueError(f"{name!r} isn't one column of {sorted(c['output'] for c in known)}")
        return found[0]["output"]

    def query(self, columns: Sequence[str] | None = None, **request) -> DataFrame:
        """:meth:`Keyed.query` under the scope's names; the scope's own settings can't be overridden."""
        if fixed := {"with_tables", "metadata_mode", "include_data"} & set(request):
            raise TypeError(f"fixed by the scope: {sorted(fixed)}")
        by_output = {c["output"]: c for c in self.columns() if c["group"] != "key"}
        chosen = list(by_output) if columns is None else [self.resolve(c) for c in columns]
        made = self.table.query([c for c in chosen if c not in self.table.pk], with_tables=self.with_tables, metadata_mode=self.metadata_mode, **request)
        return made


def scatter_rows(table: Keyed, coordinates: Keyed, columns: Sequence[str] = (), color: str | None = None, color_na_label: str | None = None, longest: int | None = 600, **request) -> DataFrame:
    """The points of a plot: the rows that a query of ``table`` gives (``request`` as in :meth:`Keyed.query`), with ``x`` and
    ``y`` of a table of the same key with two columns (or one array of two), ``color`` and texts cut at ``longest``
    characters for display. Rows without coordinates are left out. A missing color is ``color_na_label``, if given."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    if coordinates.pk != table.pk:
        raise ValueError(f"keys differ: {table.pk} and {coordinates.pk}")
    wide = coordinates.data
    array = len(wide) == 1 and isinstance(coordinates.df.schema[wide[0]].dataType, T.ArrayType)
    if not array and len(wide) != 2:
        raise ValueError(f"coordinates need two columns, not {wide}")
    x, y = (F.col(f"`{wide[0]}`")[0], F.col(f"`{wide[0]}`")[1]) if array else (F.col(f"`{wide[0]}`"), F.col(f"`{wide[1]}`"))
    shown = list(dict.fromkeys([*columns, *([color] if color else [])]))
    points = table.query(shown, **request).join(coordinates.view(wide).select(*table.pk, x.alias("x"), y.alias("y")), table.pk)
    if color and color_na_label is not None:
        points = points.withColumn(color, F.coalesce(F.col(f"`{color}`").cast("string"), F.lit(color_na_label)))
    for c in shown:
        if longest and isinstance(points.schema[c].dataType, T.StringType):
            points = points.withColumn(c, F.when(F.char_length(F.col(f"`{c}`")) > longest, F.concat(F.substring(F.col(f"`{c}`"), 1, longest), F.lit("…"))).otherwise(F.col(f"`{c}`")))
    return points.select(*table.pk, "x", "y", *shown)
