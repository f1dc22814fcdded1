"""Importers: files to keyed data sets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseloom.operators.keyed import POSITION, Keyed, integer_key, with_position
from verseloom.runtime import map_batches

#: Folders that one scan of :func:`extract_text_files` reads; more take more scans.
FOLDERS_PER_READ = 100_000

_RESERVED = {"row_id", "_position", "_batch", "_row_offset"}


def _check_fields(columns: Sequence[str], text_fields: Sequence[str], metadata_fields: Sequence[str]) -> None:
    asked = [*text_fields, *metadata_fields]
    if len(set(asked)) < len(asked):
        raise ValueError("a field is asked for twice")
    if bad := [f for f in asked if f not in columns]:
        raise ValueError(f"unknown fields: {bad}")
    if bad := [f for f in asked if f in _RESERVED or f.startswith("_")]:
        raise ValueError(f"reserved names: {bad}")


def _numbered(df: DataFrame, text_fields: Sequence[str] | None, metadata_fields: Sequence[str], order: Sequence, dtype: dict[str, str] | None, extra: Sequence[str] = ()) -> Keyed:
    own = [c for c in df.columns if c not in ("__file", "__block", *extra) and not c.startswith("__o")]
    text_fields = [c for c in own if c not in metadata_fields] if text_fields is None else list(text_fields)
    _check_fields(own, text_fields, metadata_fields)
    for c, t in (dtype or {}).items():
        df = df.withColumn(c, F.col(c).cast(t))
    placed = with_position(df, order)
    return Keyed.of(placed.withColumnRenamed(POSITION, "row_id"), ["row_id"], text_fields, [*metadata_fields, *extra])


def _file_order(df: DataFrame) -> DataFrame:
    """File, block in it and place in the block: the order in which rows stand in the files."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__o"))


def read_csv(spark: SparkSession, path: str, text_fields: Sequence[str] | None = None, metadata_fields: Sequence[str] = (), dtype: dict[str, str] | None = None, schema: str | None = None, **options) -> Keyed:
    """A CSV with a header; key ``row_id`` in file order; fields not named are dropped."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', **options)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return _numbered(_file_order(df), text_fields, metadata_fields, ["__file", "__block", "__o"], dtype)


def read_csv_folder(spark: SparkSession, root: str, pattern: str = "*.csv", recursive: bool = True, text_fields: Sequence[str] | None = None, metadata_fields: Sequence[str] = (), schema: str | None = None) -> Keyed:
    """All files in path order, with ``source_file`` (relative) and ``source_row`` (0-based in its file)."""
    from pyspark.sql import Window

    reader = spark.read.options(header=True, multiLine=True, escape='"', recursiveFileLookup=recursive, pathGlobFilter=pattern)
    df = reader.schema(schema).csv(root) if schema else reader.option("inferSchema", True).csv(root)
    df = _file_order(df)
    base = re.escape(root.rstrip("/"))
    df = df.withColumn("source_file", F.regexp_replace(F.url_decode("__file"), f"^.*?{base}/", ""))
    df = df.withColumn("source_row", F.row_number().over(Window.partitionBy("__file").orderBy("__block", "__o")) - 1)
    return _numbered(df, text_fields, metadata_fields, ["source_file", "source_row"], None, extra=["source_file", "source_row"])


def read_jsonl(spark: SparkSession, path: str, text_fields: Sequence[str] | None = None, metadata_fields: Sequence[str] = (), schema: str | None = None) -> Keyed:
    df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    return _numbered(_file_order(df), text_fields, metadata_fields, ["__file", "__block", "__o"], None)


def read_parquet(spark: SparkSession, path: str, text_fields: Sequence[str] | None = None, metadata_fields: Sequence[str] = (), order_by: Sequence[str] | None = None) -> Keyed:
    df = spark.read.parquet(path)
    return _numbered(df if order_by else _file_order(df), text_fields, metadata_fields, order_by or ["__file", "__block", "__o"], None)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_rows(content: bytes, sheet: str | int = 0, header_row: int = 0, kinds: list[list[str]] | None = None) -> tuple[list[str], list[list[str | None]]]:
    """Header and rows of a sheet of an .xlsx file, by name or index; blank rows are skipped. ``kinds`` is filled with what
    each cell is: ``n`` (number), ``b`` (boolean), ``s`` (text) or empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), rels[s.get(_REL)]) for s in book.iter(f"{_NS}sheet")]
        target = sheets[sheet][1] if isinstance(sheet, int) else dict(sheets)[sheet]
        root = ElementTree.fromstring(z.read("xl/" + target.removeprefix("/xl/")))
    table: list[list[str | None]] = []
    sorts: list[list[str]] = []
    for row in root.iter(f"{_NS}row"):
        cells: dict[int, str | None] = {}
        sort: dict[int, str] = {}
        for c in row.iter(f"{_NS}c"):
            letters = re.match(r"[A-Z]+", c.get("r", "A")).group()
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            v, kind = c.find(f"{_NS}v"), c.get("t")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            else:
                value = None if v is None else shared[int(v.text)] if kind == "s" else v.text
            cells[at - 1] = value
            sort[at - 1] = "" if value in (None, "") else kind if kind == "b" else "n" if kind in (None, "n") else "s"
        values = [cells.get(i) for i in range(max(cells, default=-1) + 1)]
        if any(v not in (None, "") for v in values):
            table.append(values)
            sorts.append([sort.get(i, "") for i in range(len(values))])
    if len(table) <= header_row:
        return [], []
    header = [str(h) for h in table[header_row] if h is not None]
    if kinds is not None:
        kinds += [(r + [""] * len(header))[: len(header)] for r in sorts[header_row + 1 :]]
    return header, [(r + [None] * len(header))[: len(header)] for r in table[header_row + 1 :]]


def read_excel(spark: SparkSession, path: str, sheets: Sequence[str | int] = (0,), header_row: int = 0, text_fields: Sequence[str] | None = None, metadata_fields: Sequence[str] = (), missing_fields: str = "error", pattern: str = "*.xlsx", infer: bool = False) -> Keyed:
    """One workbook or a folder of them, as strings or, with ``infer``, columns of which every cell is a number or boolean
    as whole numbers, doubles or booleans (dates are the day numbers that workbooks hold), with ``source_file``, ``source_sheet`` and ``source_row``. Each
    workbook is read by one task. A field that a sheet lacks is an error, or null with ``missing_fields="fill"``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern if not path.endswith(".xlsx") else "*").option("recursiveFileLookup", True).load(path)
    fields = [*(text_fields or []), *metadata_fields]
    if not fields:
        first = files.orderBy("path").select("content").first()
        if first is None:
            raise ValueError("no workbook")
        fields = workbook_rows(bytes(first.content), sheets[0], header_row)[0]

    def run(paths: pa.Array, contents: pa.Array):
        out: dict[str, list] = {c: [] for c in ("source_file", "source_sheet", "source_row", "__kinds", *fields)}
        for p, content in zip(paths.to_pylist(), contents.to_pylist()):
            for s in sheets:
                kinds: list[list[str]] = []
                header, rows = workbook_rows(content, s, header_row, kinds)
                lacking = [f for f in fields if f not in header]
                if lacking and missing_fields == "error":
                    raise ValueError(f"{p}, sheet {s}: no fields {lacking}")
                for n, r in enumerate(rows):
                    row, kind = dict(zip(header, r)), dict(zip(header, kinds[n]))
                    for c, v in zip(out, (p.rsplit("/", 1)[-1], str(s), n, [kind.get(f, "") for f in fields], *(row.get(f) for f in fields))):
                        out[c].append(v)
        yield out

    df = map_batches(files.select("path", "content"), run, "source_file string, source_sheet string, source_row bigint, __kinds array<string>, " + ", ".join(f"`{f}` string" for f in fields))
    if infer:
        held = lambda i, k: F.count_if(F.col("__kinds")[i] == k)
        whole = lambda f: F.count_if(F.col(f"`{f}`").try_cast("double") != F.floor(F.col(f"`{f}`").try_cast("double")))
        seen = df.agg(*[F.struct(held(i, "s").alias("s"), held(i, "n").alias("n"), held(i, "b").alias("b"), whole(f).alias("part")).alias(f"k{i}") for i, f in enumerate(fields)]).first()
        for i, f in enumerate(fields):
            k = seen[i]
            if not k.s and bool(k.n) != bool(k.b):
                c = F.col(f"`{f}`")
                df = df.withColumn(f, c.try_cast("int").cast("boolean") if k.b else c.try_cast("double") if k.part else c.try_cast("double").cast("bigint"))
    df = df.drop("__kinds")
    extra = ["source_file", "source_sheet", "source_row"]
    return _numbered(df, text_fields or [f for f in fields if f not in metadata_fields], metadata_fields, extra, None, extra=extra)


def folder_inventory(spark: SparkSession, root: str, patterns: Sequence[str] = ("*",), recursive: bool = True) -> Keyed:
    """One row per file, in order of relative path: path, relative_path, file_name, stem, extension, size_bytes."""
    found = None
    for p in patterns:
        one = spark.read.format("binaryFile").option("pathGlobFilter", p).option("recursiveFileLookup", recursive).load(root).select("path", "length")
        found = one if found is None else found.unionByName(one)
    base = re.escape(root.removeprefix("file:").rstrip("/"))
    name = F.element_at(F.split("path", "/"), -1)
    out = found.distinct().select(
        "path", F.regexp_replace("path", f"^.*?{base}/", "").alias("relative_path"), name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), F.col("length").alias("size_bytes"),
    )
    if not out.limit(1).count():
        raise ValueError(f"no file of {list(patterns)} in {root}")
    placed = with_position(out, ["relative_path"])
    return Keyed.of(placed.withColumnRenamed(POSITION, "file_id"), ["file_id"])


def register_external(df: DataFrame, primary_key: Sequence[str], data_fields: Sequence[str] | None = None, metadata_fields: Sequence[str] = (), lineage_mode: str = "new_key", bases: Sequence[Keyed] = (), name: str = "") -> Keyed:
    """Any DataFrame with an integer key; keys are checked for uniqueness, declared lineage only for the shape of keys."""
    from verseloom.operators.keyed import check_mode

    if (lineage_mode == "new_key") == bool(bases):
        raise ValueError("new_key has no bases; every other mode has some")
    check_mode(lineage_mode, list(primary_key), [b.pk for b in bases])
    made = Keyed.of(df, primary_key, data_fields, metadata_fields, check=True, name=name)
    made.mode, made.bases = lineage_mode, list(bases)
    return made


def extract_text_files(files: Keyed, path_field: str = "path", encoding: str = "utf-8", errors: str = "strict") -> Keyed:
    """Text of each file, line ends as \\n; a file that can't be read or decoded is a row with ``status`` and ``error``."""
    spark = files.df.sparkSession
    paths = files.view([path_field]).select(*files.key_columns, F.col(path_field).alias("path"))

    def run(path: pa.Array, content: pa.Array):
        out: dict[str, list] = {"path": [], "text": [], "status": [], "error": []}
        for p, c in zip(path.to_pylist(), content.to_pylist()):
            try:
                text, status, error = c.decode(encoding, errors).replace("\r\n", "\n").replace("\r", "\n"), "ok", None
            except (UnicodeError, LookupError) as e:
                text, status, error = None, "error", f"{type(e).__name__}: {e}"
            for k, v in zip(out, (p, text, status, error)):
                out[k].append(v)
        yield out

    roots = sorted(r.d for r in paths.select(F.regexp_replace("path", "/[^/]*$", "").alias("d")).distinct().toLocalIterator())
    content = None
    for at in range(0, max(1, len(roots)), FOLDERS_PER_READ):
        part = spark.read.format("binaryFile").load([r + "/*" for r in roots[at : at + FOLDERS_PER_READ]]).select("path", "content")
        content = part if content is None else content.unionByName(part)
    texts = map_batches(content.join(paths.select("path"), "path", "left_semi"), run, "path string, text string, status string, error string")
    out = paths.join(texts, "path", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return files.derive(out.select(*files.key_columns, "text", "status", "error"), "preserved_key", data=["text"], metadata=["status", "error"])


def extract_pdf_texts(files: DataFrame, reader: Callable[[bytes], list[str]] | None = None, page_separator: str = "\f", start_page: int = 1, end_page: int | None = None) -> DataFrame:
    """One row per PDF. ``reader(bytes) -> page texts`` must be given: no PDF library is part of this package."""
    if reader is None:
        raise RuntimeError("pass reader=, a function of a PDF's bytes that gives its page texts")

    def run(path: pa.Array, content: pa.Array):
        pages = [reader(c)[start_page - 1 : end_page] for c in content.to_pylist()]
        yield {"path": path, "text": [page_separator.join(p) for p in pages], "pages": [len(p) for p in pages]}

    return map_batches(files.select("path", "content"), run, "path string, text string, pages int")


def payload_table(spark: SparkSession, records: Sequence[dict], primary_key: Sequence[str]) -> Keyed:
    """In-memory records; mixed kinds of a field become the wider one, nested values JSON."""
    import json

    names = list(dict.fromkeys(k for r in records for k in r))
    kinds = {}
    for n in names:
        seen = {type(r.get(n)) for r in records if r.get(n) is not None}
        kinds[n] = "boolean" if seen == {bool} else "bigint" if seen == {int} else "double" if seen and seen <= {int, float} else "string"
    rows = [tuple(None if (v := r.get(n)) is None else float(v) if kinds[n] == "double" else json.dumps(v) if isinstance(v, (dict, list)) else str(v) if kinds[n] == "string" else v for n in names) for r in records]
    return Keyed.of(integer_key(spark.createDataFrame(rows, ", ".join(f"`{n}` {kinds[n]}" for n in names)), primary_key), primary_key, check=True)
