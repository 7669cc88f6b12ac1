"""Run logs, manifests, file lists and seeded samples."""

import json

import pytest

from strandloom.functions import seq
from strandloom.operators import stats
from strandloom.operators.gates import GateError
from strandloom.sources import readers, runs, writers


def test_run_log_survives_a_failure(spark, tmp_path):
    folder = str(tmp_path / "run")
    log = runs.RunLog(spark, folder, panel_id="p1")
    with log.stage("first", inputs=2) as found:
        found["events"] = 3
    with pytest.raises(ZeroDivisionError), log.stage("second"):
        1 / 0  # noqa: B018
    told = json.loads(runs.read_text(spark, f"{folder}/summary.json"))
    assert told["primary_status"] == "failed" and told["events"] == 3 and told["panel_id"] == "p1" and "second" in told["error"]
    assert sorted((r["no"], r["status"]) for r in log.table().collect()) == [(1, "complete"), (1, "running"), (2, "failed"), (2, "running")]
    with pytest.raises(GateError):
        runs.RunLog(spark, folder)
    other = runs.RunLog(spark, str(tmp_path / "other"))
    other.complete()
    with pytest.raises(ValueError), other.stage("more", supplementary=True):
        raise ValueError("x")
    told = json.loads(runs.read_text(spark, str(tmp_path / "other" / "summary.json")))
    assert told["primary_status"] == "complete" and told["supplementary_status"] == "failed"


def test_lists_manifests_and_reports(spark, tmp_path):
    for name, text in (("b.fna", ">x\nA\n"), ("a.fna", ">y\nC\n"), ("a.fa", ""), ("c.fna.gz", "z")):
        (tmp_path / name).write_text(text)
    at = lambda n: str(tmp_path / n)
    assert runs.expand(spark, [at("b.fna"), at("*.fna"), at("none*"), at("missing")]) == [at("b.fna"), at("a.fna"), at("missing")]
    rows = readers.ordered_lines(spark, [at("b.fna"), at("*.fna")]).collect()
    assert sorted((r["file_no"], r["value"]) for r in rows) == [(0, ">x"), (0, "A"), (1, ">y"), (1, "C")]
    got = {(r["path"].rsplit("/", 1)[-1] if r["path"] else None, r["problem"]) for r in runs.manifest_problems(runs.file_sizes(spark, [at(n) for n in ("b.fna", "a.fna", "a.fa", "c.fna.gz")])).collect()}
    assert got == {("a.fa", "empty"), ("a.fa", "duplicate_name"), ("a.fna", "duplicate_name"), ("c.fna.gz", "compressed")}
    with pytest.raises(GateError, match="too_few_files"):
        runs.assert_manifest(runs.file_sizes(spark, [at("b.fna")]))
    runs.assert_manifest(runs.file_sizes(spark, [at("b.fna"), at("a.fna")]))
    (tmp_path / "empty").mkdir()
    df = spark.createDataFrame([("s", "<b>")], "status string, x string")
    writers.write_jsonl(df, at("empty"))
    with pytest.raises(GateError):
        writers.write_jsonl(df, at("empty"))
    runs.write_report(spark, at("report"), "t", df, runs.status_counts(df, "status"))
    assert "&lt;b&gt;" in runs.read_text(spark, at("report/report.html")) and json.loads(runs.read_text(spark, at("report/summary.json"))) == {"status": {"s": 1}}


def test_seeds_from_pools(spark):
    items = spark.createDataFrame([(f"g{k}",) for k in range(30)], "item string")
    pool = spark.createDataFrame([(f"g{k}.fna" if k % 2 else f"g{k}",) for k in range(12)], "name string")
    bad = spark.createDataFrame([("g3",), ("g4.fna",)], "name string")
    got = stats.seed_sample(items, "item", 5, 1, pool, bad).collect()
    every = stats.seed_sample(items, "item", 100, 1, pool, bad).collect()
    assert {r["item"] for r in every} == {f"g{k}" for k in range(12)} - {"g3", "g4"} and [r["place"] for r in got] == [1, 2, 3, 4, 5]
    assert [r["item"] for r in got] == [r["item"] for r in sorted(every, key=lambda r: r["place"])][:5]
    with pytest.raises(GateError):
        stats.seed_sample(items, "item", 5, 1, spark.createDataFrame([("other",)], "name string"))


def test_panel_labels(spark):
    paths = {"/x/full_e/l2/panel": "full_e/panel", "/x/full_e/panel/recon/": "full_e/panel", "/run/panel": "run/panel", "panel": "panel", "/x/run/l2/panel/l2": "run/panel"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["l"] for r in df.select("p", seq.panel_label("p").alias("l")).collect()} == paths
