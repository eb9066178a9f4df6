"""Settings, files in and out, and the stages end to end on small reports."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerspark import config
from ledgerspark.plans import stages
from ledgerspark.sources import files

TABLE = "===== PAGE 1 =====\nCông ty {t}\n{title}\nĐơn vị tính: triệu đồng\n<table><tr><th>Chỉ tiêu</th><th>31/12/{y}</th><th>01/01/{y}</th></tr>{rows}</table>\n"


def report(ticker, year, scale):
    row = lambda name, v: f"<tr><td>{name}</td><td>{v}.000</td><td>{v - 1}.000</td></tr>"
    a = TABLE.format(t=ticker, y=year, title="BẢNG CÂN ĐỐI KẾ TOÁN", rows=row("Tổng tài sản", 9 * scale) + row("Vốn chủ sở hữu", 4 * scale))
    b = TABLE.format(t=ticker, y=year, title="BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH", rows=row("Doanh thu thuần", 8 * scale) + row("Lợi nhuận sau thuế", 2 * scale))
    return a + "x" * 60 + "\n" + b


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"execution": {"timeout_sec": 3}, "a": {"b": 1}}')
    s = config.Settings(str(tmp_path / "c.json"), {"LEDGERSPARK_A__B": "2", "LEDGERSPARK_A__C": "x"})
    assert (s.get("execution.timeout_sec"), s.get("execution.max_attempts"), s.get("a.b"), s.get("a.c"), s.get("a.z", 7), s.get("a.b.c")) == (3, 3, 2, "x", 7, None)
    assert config.logger("x").name == "ledgerspark.x" and config.logger("y") and len(config.logging.getLogger("ledgerspark").handlers) == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿code,name\nA,"x\ny"\nB,\n'.encode())
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("A", "x\ny"), ("B", None)] and files.read_csv(spark, str(tmp_path / "a.csv"), 1).count() == 1
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert sorted(r["id"] for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2]
    for n in (5, 3):
        assert files.write_jsonl(spark.range(n), str(tmp_path / "out")) == n
    assert files.read_jsonl(spark, str(tmp_path / "out")).count() == 3
    for text in ("é", "[1]"):
        files.write_text_atomic(spark, text, str(tmp_path / "t.json"))
        assert (tmp_path / "t.json").read_text("utf-8") == text
    assert files.resolve_local(spark, "data/a.csv", [str(tmp_path)]) == f"{tmp_path}/a.csv" and files.resolve_local(spark, "data/zz.csv", [str(tmp_path)]) is None
    waits, calls = [], []

    def act():
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return "done"

    assert files.with_retries(act, wait=waits.append) == "done" and waits == [10, 20, 40]
    with pytest.raises(OSError):
        files.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, lambda s: None)
    files.fetch(spark, str(tmp_path / "out"), str(tmp_path / "copy"))
    assert files.read_jsonl(spark, str(tmp_path / "copy")).count() == 3


def test_end_to_end(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    for t, s in (("AAA", 1), ("BBB", 10)):
        (raw / t / "2020").mkdir(parents=True)
        (raw / t / "2020" / f"{t}_2020_Hopnhat.txt").write_text(report(t, 2020, s))
    (tmp_path / "q.json").write_text(json.dumps([{"id": 1, "question": "Tổng tài sản cuối năm 2020 của (AAA) là bao nhiêu triệu đồng?"}, {"id": 2, "question": "ROE năm 2020 của công ty Bê Bê là bao nhiêu %?"}, {"id": 3, "question": "Doanh thu thuần của (BBB) năm 2020 bao nhiêu tỷ đồng?"}], ensure_ascii=False))
    (tmp_path / "c.csv").write_text("code,name\nAAA,CTCP A A\nBBB,Công ty cổ phần Bê Bê\n")
    stages.run_all(spark, str(raw), out, str(tmp_path / "q.json"), str(tmp_path / "c.csv"))
    got = {r["id"]: r for r in spark.read.parquet(f"{out}/answers").collect()}
    assert (got[1]["answer"], got[2]["answer"], got[3]["answer"]) == (9000.0, 50.0, 80.0)
    assert got[1]["relevant_docs"] == ["AAA_2020_Hopnhat"] and got[2]["relevant_docs"] == ["BBB_2020_Hopnhat"] and len(got[2]["relevant_tables"]) == 2
    z = zipfile.ZipFile(f"{out}/answers.zip")
    assert z.namelist()[0] == "answers.json" and "data/AAA_2020_Hopnhat_table_1.csv" in z.namelist() and len(json.loads(z.read("answers.json"))) == 3
    # the files that were handed in give the manifest back
    (tmp_path / "csv").mkdir()
    z.extractall(tmp_path / "csv")
    manifest = spark.read.json(f"{out}/manifest")
    again = {r["table_ref"]: r for r in files.rebuild_manifest(spark, str(tmp_path / "csv")).collect()}
    assert set(again) == {r["table_ref"] for r in manifest.collect()} and again["AAA_2020_Hopnhat|1"]["year"] == 2020 and "Tổng tài sản" in again["AAA_2020_Hopnhat|1"]["card"]
    # a new report joins, the old ones are not read again
    (raw / "CCC" / "2020").mkdir(parents=True)
    (raw / "CCC" / "2020" / "CCC_2020_Hopnhat.txt").write_text(report("CCC", 2020, 2))
    stages.run_corpus(spark, str(raw), out)
    assert spark.read.json(f"{out}/manifest").count() == 6 and spark.read.parquet(f"{out}/facts").select("table_ref").distinct().count() == 6
    with pytest.raises(RuntimeError):
        stages.run_verify(spark, out)
    stages.run_index(spark, out)
    stages.run_verify(spark, out)
    (tmp_path / "gold.json").write_text(json.dumps([{"id": 1, "answer": 9000.0, "relevant_docs": ["AAA_2020_Hopnhat"], "relevant_tables": ["AAA_2020_Hopnhat|1"]}, {"id": 2, "answer": 1.0, "relevant_docs": ["zz"], "relevant_tables": ["zz|1"]}]))
    found = stages.run_eval(spark, out, str(tmp_path / "gold.json"))
    assert found["metrics"]["n"] == 2 and found["metrics"]["answer_accuracy"] == 0.5 and found["funnel"]["executed"] == 2
    assert spark.read.parquet(f"{out}/facts").select(F.count_distinct("ticker")).first()[0] == 3


def test_a_run_that_stops_before_its_manifest_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    raw, out = tmp_path / "raw", str(tmp_path / "out")

    def add(t):
        (raw / t / "2020").mkdir(parents=True)
        (raw / t / "2020" / f"{t}_2020_Hopnhat.txt").write_text(report(t, 2020, 1))

    refs = lambda: sorted(r["table_ref"] for r in stages._facts(spark, out).select("table_ref").distinct().collect())
    add("AAA")
    stages.run_corpus(spark, str(raw), out)
    n = stages._facts(spark, out).count()
    add("BBB")
    write = stages.corpus.write_manifest
    monkeypatch.setattr(stages.corpus, "write_manifest", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        stages.run_corpus(spark, str(raw), out)
    assert refs() == ["AAA_2020_Hopnhat|1", "AAA_2020_Hopnhat|2"]
    monkeypatch.setattr(stages.corpus, "write_manifest", write)
    stages.run_corpus(spark, str(raw), out)
    assert len(refs()) == 4 and stages._facts(spark, out).count() == 2 * n
    # killed between the two renames of the manifest: the new one is complete and takes its place
    import os

    os.rename(f"{out}/manifest", f"{out}/manifest.old")
    spark.read.schema(stages.MANIFEST).json(f"{out}/manifest.old").where("doc_id like 'BBB%'").write.json(f"{out}/manifest.new")
    assert stages._manifest(spark, out).count() == 2 and not os.path.exists(f"{out}/manifest.old")
    # killed before the new one was complete: the old one comes back
    os.rename(f"{out}/manifest", f"{out}/manifest.old")
    os.makedirs(f"{out}/manifest.new")
    assert stages._manifest(spark, out).count() == 2 and refs() == ["BBB_2020_Hopnhat|1", "BBB_2020_Hopnhat|2"]
    stages.run_corpus(spark, str(raw), out, resume=False)
    assert len(refs()) == 4 and len(stages._batches_on_disk(spark, out)) == 1


def test_a_corpus_without_tables(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "AAA_2020.txt").write_text("no table")
    stages.run_corpus(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert stages._facts(spark, str(tmp_path / "out")).count() == 0 and stages._manifest(spark, str(tmp_path / "out")).count() == 0


def test_a_failed_write_keeps_the_old_file(spark, tmp_path):
    from ledgerspark.sources.paths import Output

    path = str(tmp_path / "a.txt")
    files.write_text_atomic(spark, "old", path)
    with pytest.raises(ValueError), Output(spark, path) as out:
        out.write(b"ne")
        raise ValueError
    assert open(path).read() == "old"
