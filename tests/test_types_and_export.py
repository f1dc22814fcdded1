import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from verseloom.lexicon.dictionary import Dictionary, PolarityDictionary, ValenceDictionary
from verseloom.ml import models as ML
from verseloom.operators import joins as J
from verseloom.operators import setops as S
from verseloom.operators.keyed import KeyError_, Keyed
from verseloom.plans.workspace import Pipeline, Workspace
from verseloom.sources import readers as R


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, f"text {i}", "AB"[i % 2]) for i in range(6)], "row_id long, text string, grp string")
    return Keyed.of(df, ["row_id"], ["text"], ["grp"], name="docs")


def test_metadata_is_complete_by_default(spark, docs):
    some = spark.createDataFrame([(1, "x"), (4, "y")], "row_id long, tag string")
    with pytest.raises(KeyError_):
        J.attach_metadata(docs, some, ["tag"])
    got = J.attach_metadata(docs, some, ["tag"], require_complete=False)
    assert rows(got.query(["tag", "grp"])) == [(i, {1: "x", 4: "y"}.get(i), "AB"[i % 2]) for i in range(6)] and got.metadata == ["tag"]
    for bad in (some.unionByName(some), spark.createDataFrame([(9, "x")], some.schema)):
        with pytest.raises(KeyError_):
            J.attach_metadata(docs, bad, ["tag"], require_complete=False)
    with pytest.raises(ValueError):
        J.attach_metadata(docs, some.withColumnRenamed("tag", "grp"), ["grp"], require_complete=False)
    assert docs.records(["grp"], limit=1) == [{"row_id": 0, "grp": "A"}] and docs.table(["grp"])["grp"].tolist() == list("ABABAB")


def test_probability_split_allocations(spark):
    t = Keyed.of(spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") < 70, "a").when(F.col("id") < 90, "b").otherwise("c").alias("s")), ["k"])
    sizes = lambda p: dict(rows(p["pi"].view(["s"]).groupBy("s").count()))
    assert sizes(S.probability_split(t, 20, ["s"])) == {"a": 14, "b": 4, "c": 2}
    equal = S.probability_split(t, 20, ["s"], "equal")
    assert sizes(equal) == {"a": 7, "b": 7, "c": 6} and equal["remainder"].df.count() == 80
    assert sizes(S.probability_split(t, 6, ["s"], {"a": 1, "b": 2, "c": 3})) == {"a": 1, "b": 2, "c": 3}
    assert {r.pi for r in S.probability_split(t, 25)["pi"].df.collect()} == {0.25}
    for bad in ({"a": 1, "b": 2}, {"a": 1, "b": 2, "c": 9}, {"a": 6, "b": 0, "c": 0}, {"a": -5, "b": 0, "c": 11}):
        with pytest.raises(ValueError):
            S.probability_split(t, 6, ["s"], bad)


def test_dictionary_types(spark):
    features = spark.createDataFrame(list(enumerate(["good", "goods", "bad", "meh", "Fine"])), "feature_id long, feature string")
    d = Dictionary({"positive": ("good*", "fine"), "negative": ("bad",), "other": ("meh",)}, name="d")
    assert set(rows(d.match(features).select("feature", "category"))) == {("good", "positive"), ("goods", "positive"), ("Fine", "positive"), ("bad", "negative"), ("meh", "other")}
    assert Dictionary.from_frame(d.frame(spark)).categories == {"negative": ("bad",), "other": ("meh",), "positive": ("fine", "good*")}
    p = PolarityDictionary(d, neutral="other")
    assert set(rows(p.match(features).select("feature", "pole"))) >= {("bad", "negative"), ("meh", "neutral"), ("goods", "positive")}
    assert PolarityDictionary(d).match(features).where("pole IS NULL OR pole = 'neutral'").count() == 0
    v = ValenceDictionary({"good": 2.5, "BAD": -1})
    assert set(rows(v.match(features).select("feature", "score"))) == {("good", 2.5), ("bad", -1.0)}
    for make in (lambda: Dictionary({"a": ()}), lambda: Dictionary({"a": "word"}), lambda: Dictionary({"a": ("x",)}, valuetype="odd"), lambda: PolarityDictionary(d, negative="none"), lambda: PolarityDictionary(d, neutral="positive"), lambda: ValenceDictionary({"a": float("nan")})):
        with pytest.raises(ValueError):
            make()


def test_export_and_preferred_alias(spark, tmp_path, docs):
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.save(docs, "docs")
    for format, read in (("parquet", spark.read.parquet), ("jsonl", spark.read.json), ("csv", lambda p: spark.read.csv(p, header=True))):
        w.export("docs", f"file://{tmp_path}/{format}", format)
        got = read(f"file://{tmp_path}/{format}").select(F.col("row_id").cast("long"), "text", "grp")
        assert rows(got, "row_id") == [(i, f"text {i}", "AB"[i % 2]) for i in range(6)]
    with pytest.raises(ValueError):
        w.export("docs", f"file://{tmp_path}/x", "odd")
    w.alias("docs", "one")
    w.alias("docs", "two")
    w.prefer("docs", "two")
    assert w.catalog().first().aliases == "two,one"
    with pytest.raises(ValueError):
        w.prefer("docs", "three")


def test_many_classes_and_portable_models(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression

    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(i, (rng.normal(size=2) * 0.3 + [4 * (i % 3), i % 3]).tolist(), float(i % 3)) for i in range(90)], "k long, features array<double>, y double")
    model = ML.FittedPredictor(LogisticRegression(featuresCol="__v", labelCol="y").fit(ML._vectors(d)))
    model.save(f"file://{tmp_path}/m")
    out = ML.FittedPredictor.load(spark, f"file://{tmp_path}/m").transform(d, ["k"])
    assert out.join(d, "k").where("prediction = y").count() > 85 and {len(r.probability) for r in out.collect()} == {3}
    p = Pipeline().add("words", "docs", lambda state, df: df.withColumn("n", F.size(F.split("text", " "))))
    p.add("known", "words", lambda state, df: df.join(state, "n", "left"), fit=lambda df: df.groupBy("n").agg(F.count("*").alias("seen")))
    p.add("label", "docs", lambda state, df: state.transform(ML._vectors(df)).select("k", "prediction"), fit=lambda df: LogisticRegression(featuresCol="__v", labelCol="y").fit(ML._vectors(df)))
    texts = spark.createDataFrame([(1, "a b", [0.0, 0.0], 0.0), (2, "c", [4.0, 1.0], 1.0), (3, "d", [0.1, 0.0], 0.0)], "k long, text string, features array<double>, y double")
    want = {n: sorted(rows(t)) for n, t in p.run({"docs": texts}).items() if n != "words"}
    p.save(spark, f"file://{tmp_path}/p")
    again = Pipeline.load(spark, f"file://{tmp_path}/p")
    assert all(s.frozen for s in again.steps if s.fit) and {n: sorted(rows(t)) for n, t in again.run({"docs": texts}).items() if n != "words"} == want
    assert [s.name for s in again.extract(["known"]).steps] == ["words", "known"]
    with pytest.raises(ValueError):
        again.extract(["nope"])


def _workbook(table) -> bytes:
    cells = []
    for r, row in enumerate(table, 1):
        parts = []
        for c, v in zip("ABCDE", row):
            if v is None:
                continue
            body = f' t="inlineStr"><is><t>{v}</t></is>' if isinstance(v, str) else f' t="b"><v>{int(v)}</v>' if isinstance(v, bool) else f"><v>{v}</v>"
            parts.append(f'<c r="{c}{r}"{body}</c>')
        cells.append(f'<row r="{r}">{"".join(parts)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return buf.getvalue()


def test_workbook_columns_get_kinds(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(_workbook([["name", "n", "x", "ok", "code"], ["a", 1, 1.5, True, "007"], ["b", 2.0, 2, False, 8], [None, None, None, None, "z"]]))
    got = R.read_excel(spark, f"{tmp_path}/b.xlsx", infer=True)
    assert dict(got.df.select("name", "n", "x", "ok", "code").dtypes) == {"name": "string", "n": "bigint", "x": "double", "ok": "boolean", "code": "string"}
    assert rows(got.df.select("name", "n", "x", "ok", "code"), "code") == [("a", 1, 1.5, True, "007"), ("b", 2, 2.0, False, "8"), (None, None, None, None, "z")]
