import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers as S
from corpusloom.sources import sinks as K
from corpusloom.streaming import ingest as I


def test_jsonl(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"id": "a", "text": "é", "metadata": {"page": 1}}\n\n{"id": "b", "text": null}\n', encoding="utf-8")
    assert [(r.id, r.text) for r in S.read_chunks(spark, str(tmp_path / "ok.jsonl")).orderBy("id").collect()] == [("a", "é"), ("b", None)]
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{"id": \n', encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        S.read_chunks(spark, str(tmp_path / "bad.jsonl")).collect()


def test_manifest(spark, tmp_path):
    head = "﻿filename,title,document_type,author,year,theme,ria_dimension,source_url,source_type\n"
    (tmp_path / "m.csv").write_text(head + "a.pdf,A,,,2010,,,, pdf\n,B,,,,,,,PDF\nx,C,,,,,,HTTP://E.org/a/,html\n", encoding="utf-8")
    m = S.read_manifest(spark, str(tmp_path / "m.csv"))
    assert [r.filename for r in S.pdf_manifest(m).collect()] == ["a.pdf"] and [r.address for r in S.html_manifest(m).collect()] == ["http://e.org/a"]
    with pytest.raises(ValueError, match="twice"):
        S.pdf_manifest(m.union(m))
    (tmp_path / "n.csv").write_text("filename,title\na,b\n")
    with pytest.raises(ValueError, match="without columns"):
        S.read_manifest(spark, str(tmp_path / "n.csv"))


def test_sheets_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'com "aspas"; e ponto'), (2, "duas\nlinhas")], "a int, b string")
    K.write_sheet(df, str(tmp_path / "s"), ";")
    assert sorted((r.a, r.b) for r in S.read_sheet(spark, str(tmp_path / "s"), ";").collect()) == [("1", 'com "aspas"; e ponto'), ("2", "duas\nlinhas")]


def test_merge_refuses_repeats(spark):
    a = spark.createDataFrame([("x", "t")], "id string, text string")
    b = spark.createDataFrame([("y", "u", 1)], "id string, text string, extra int")
    assert K.merge_corpora(a, b).count() == 2
    for bad in (a, spark.createDataFrame([("z", " ")], "id string, text string")):
        with pytest.raises(ValueError):
            K.merge_corpora(a, b, bad)


def test_store(spark, tmp_path):
    store = K.Store(spark, str(tmp_path), "vec")
    rows = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "id string, vector array<double>")
    v1, v2 = store.version("0" * 64), store.version("1" * 64)
    assert store.served() is None and store.upsert(v1, rows) == 2 and store.upsert(v1, rows) == 0
    store.promote(v1, rows)
    assert store.served() == v1
    store.upsert(v2, rows.filter("id = 'a'"))
    with pytest.raises(ValueError, match="missing"):
        store.promote(v2, rows)
    with pytest.raises(ValueError, match="unknown"):
        store.verify(v1, rows.filter("id = 'a'"))
    store.upsert(v2, rows)
    store.promote(v2, rows)
    assert store.served() == v2
    store.rollback(v1)
    assert store.served() == v1 and v1 not in store.vacuum(0) and store.versions() == [v1]
    rows.write.mode("append").parquet(store.path(v1))
    with pytest.raises(ValueError, match="twice"):
        store.verify(v1, rows)


def test_vectors_are_checked(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    good = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "id string, vector array<double>")
    good.write.parquet(str(tmp_path / "v"))
    assert S.read_vectors(spark, str(tmp_path / "v"), ids, 2).count() == 2
    for other, dimension in ((ids, 3), (ids.limit(1), 2)):
        with pytest.raises(ValueError):
            S.read_vectors(spark, str(tmp_path / "v"), other, dimension)


def test_standard_sections(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<standard><body><sec><title>1 Scope</title><p>A <b>b</b></p><sec><title>1.1</title><p>C</p></sec></sec></body></standard>")
    assert [(r.title, r.text) for r in S.read_standard(spark, str(tmp_path / "s.xml")).orderBy("pos").collect()] == [("1 Scope", "A b"), ("1.1", "C")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("2024-01-01 00:10:00", "d", "x"), ("2024-01-01 00:20:00", "d", " x "), ("2024-01-01 01:10:00", "d", "y")]
    df = spark.createDataFrame(rows, "t string, d string, x string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = I.append_once(I.distinct_chunks(stream, "t", "d", "x"), str(tmp_path / "out"), str(tmp_path / "cp"), "chunk_id")
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    c = I.windowed_counts(stream, "t", "d").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    c.awaitTermination()
    assert sorted(r.events for r in spark.table("counts").collect()) == [1, 2]


def test_work_resumes_after_a_crash(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{i}",) for i in range(5)], "qid string")
    assert K.resume(rows, str(tmp_path / "none"), "qid string, answer string").count() == 5
    (tmp_path / "done").mkdir()
    (tmp_path / "done" / "a.json").write_text('{"qid": "q0", "answer": "x"}\n{"qid": "q1", "answer": "y"}\n{"qid": "q2", "ans')
    assert {r.qid for r in K.resume(rows, str(tmp_path / "done"), "qid string, answer string").collect()} == {"q2", "q3", "q4"}


def test_overwriting_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "table")
    assert K.overwrite_with_backup(spark.range(3), path, "t1") is None
    kept = K.overwrite_with_backup(spark.read.parquet(path).filter("id > 0"), path, "t2")
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(kept).count() == 3


def test_sheets_keep_blanks_and_nulls(spark, tmp_path):
    rows = [(" a ", None), ("b;c", "e"), ('say "x"', "d ")]
    K.write_sheet(spark.createDataFrame(rows, "a string, b string"), str(tmp_path / "s"), ";")
    assert sorted((r.a, r.b) for r in S.read_sheet(spark, str(tmp_path / "s"), ";").collect()) == sorted(rows, key=lambda r: r[0])
