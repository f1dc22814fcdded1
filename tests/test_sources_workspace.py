import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from verseloom.operators.keyed import Keyed
from verseloom.operators.setops import subset
from verseloom.plans.workspace import Pipeline, Workspace, load_state, save_state
from verseloom.sources import readers as R
from verseloom.streaming.incremental import append_new, follow, windowed_counts


def test_csv_and_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,grp\n"x, 1",A\ny,B\n')
    (tmp_path / "b.csv").write_text("text,grp\nz,C\n")
    t = R.read_csv(spark, str(tmp_path / "a.csv"), ["text"], ["grp"])
    assert rows(t.query()) == [(0, "x, 1", "A"), (1, "y", "B")]
    f = R.read_csv_folder(spark, str(tmp_path), text_fields=["text"])
    assert rows(f.query(["text", "source_file", "source_row"])) == [(0, "x, 1", "a.csv", 0), (1, "y", "a.csv", 1), (2, "z", "b.csv", 0)]
    with pytest.raises(ValueError):
        R.read_csv(spark, str(tmp_path / "a.csv"), ["text"], ["text"])
    inv = R.folder_inventory(spark, str(tmp_path), ["*.csv"])
    assert [r[1:] for r in rows(inv.query(["file_name", "stem", "extension"]))] == [("a.csv", "a", ".csv"), ("b.csv", "b", ".csv")]
    with pytest.raises(ValueError):
        R.folder_inventory(spark, str(tmp_path), ["*.none"])
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "ok.txt").write_bytes(b"l1\r\nl2")
    texts = R.extract_text_files(R.folder_inventory(spark, str(tmp_path), ["*.txt"]))
    assert [(r[0], r[1]) for r in rows(texts.query(["text", "status"]).select("text", "status"))] == [(None, "error"), ("l1\nl2", "ok")]


def test_jsonl_parquet_excel(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "p", "n": 1}\n{"text": "q", "n": 2}\n')
    assert rows(R.read_jsonl(spark, str(tmp_path / "a.jsonl"), ["text"]).query()) == [(0, "p"), (1, "q")]
    spark.range(3).selectExpr("id AS n", "id * 2 AS m").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert rows(R.read_parquet(spark, str(tmp_path / "p"), order_by=["n"]).query(["m"])) == [(0, 0), (1, 2), (2, 4)]
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>text</t></si><si><t>hello</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row/><row><c r="A3" t="s"><v>1</v></c><c r="B3"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(buf.getvalue())
    assert rows(R.read_excel(spark, str(tmp_path / "w.xlsx")).query(["text", "n"])) == [(0, "hello", "5")]
    with pytest.raises(RuntimeError):
        R.extract_pdf_texts(spark.createDataFrame([], "path string, content binary"))


def test_records_and_registration(spark):
    t = R.payload_table(spark, [{"k": 1, "a": 1, "b": True}, {"k": 2, "a": 2.5, "c": {"x": 1}}], ["k"])
    assert rows(t.query(["a", "b", "c"])) == [(1, 1.0, True, None), (2, 2.5, None, '{"x": 1}')]
    with pytest.raises(ValueError):
        R.register_external(spark.range(2).toDF("k"), ["k"], lineage_mode="preserved_key")


def test_workspace(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    t = ws.save(Keyed.of(spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string"), ["k"]), "base")
    part = ws.save(subset(t, "v = 'b'"), "part", operation="subset")
    assert rows(part.query(["v"])) == [(1, "b")]
    ws.alias("part", "p")
    assert rows(ws.load("p").query(["v"])) == [(1, "b")]
    assert rows(ws.sql(["base", "part"], "SELECT count(*) FROM base LEFT ANTI JOIN part USING (k)")) == [(1,)]
    assert rows(ws.operations().select("operation", "output", "sources")) == [("subset", "part", "base")]
    with pytest.raises(ValueError):
        ws.delete("base")
    assert ws.delete("base", recursive=True) == ["part", "base"]
    with pytest.raises(ValueError):
        ws.load("part")
    ws.restore("base")
    assert ws.load("base").df.count() == 2
    ws.purge("part")
    assert [r.name for r in ws.catalog().collect()] == ["base"]


def test_pipeline_and_state(spark, tmp_path):
    p = Pipeline().add("scaled", ["x"], lambda m, d: d.withColumn("z", F.col("v") - m), fit=lambda d: d.agg(F.avg("v")).first()[0]).add("top", "scaled", lambda _, d: d.where("z > 0"))
    d = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    assert rows(p.run({"x": d}, ["top"])["top"]) == [(3.0, 1.0)]
    assert rows(p.run({"x": spark.createDataFrame([(9.0,)], "v double")}, ["top"])["top"]) == [(9.0, 7.0)]  # frozen
    with pytest.raises(ValueError):
        Pipeline().add("a", "b", lambda s, d: d).run({})
    save_state(spark, str(tmp_path / "s"), {"m": 2.0}, {"t": d})
    params, tables = load_state(spark, str(tmp_path / "s"), ["t"])
    assert params == {"m": 2.0} and tables["t"].count() == 2


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        spark.range(5).selectExpr("id AS k", f"timestamp_seconds(id * 60 + {n}) AS ts").write.mode("append").parquet(src)
        q = append_new(follow(spark, src, "k long, ts timestamp"), out, ["k"], str(tmp_path / "c"))
        q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 5
    q = windowed_counts(follow(spark, src, "k long, ts timestamp"), "ts", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.sql("SELECT n FROM w")) == [(10,)]
