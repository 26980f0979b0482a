"""Readers over few and many files, and over values of odd kinds."""

import pytest
from pyspark.sql import functions as F

from logtel.functions import variants as v
from logtel.plans import source_queries as sources
from logtel.plans.catalog import QUERIES
from logtel.sources import dump_folders, files, run_artifacts

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [sources.artifact_documents, sources.poll_text, sources.iteration_lines])
def test_text_made_of_a_table_of_one_file_is_made_by_all_cores(spark, made):
    assert made(spark, FOLDER).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_an_artifact_is_taken_apart_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(run_artifacts, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    run_artifacts.parse_run_artifacts(spark.createDataFrame([("f", "{}")], "file string, text string"))
    assert plans[0].count("try_variant_get(root#") == 1


def test_kinds_of_members(spark):
    texts = ['{"a":1}', '{"a":[1,null,{}]}', '{"a":{}}', '{"a":[]}', '{"a":null}', '{"a":"5"}', '{"a":true}', '{"a":1e400}', '{"a":1.5e3}', "[1]", "{}", "null"]
    read = v.with_parsed(spark.createDataFrame([(t,) for t in texts], "j string"), "j", "r")
    read = v.with_value(read, v.shaped(F.col("r"), v.shape(**v.leaves("a"))), "s")
    rows = read.select("j", v.is_object(F.col("r"), "$.a"), v.is_array(F.col("r"), "$.a"), v.number(F.col("s")["a"]), v.kind(F.col("s")["a"])).collect()
    found = {r[0]: tuple(r)[1:] for r in rows}
    assert [t for t in texts if found[t][0]] == ['{"a":{}}']
    assert [t for t in texts if found[t][1]] == ['{"a":[1,null,{}]}', '{"a":[]}']
    assert {t: found[t][2] for t in texts if found[t][2] is not None} == {'{"a":1}': 1.0, '{"a":1.5e3}': 1500.0}
    assert found['{"a":null}'][3] == "VOID" and found["{}"][3] is None and found["[1]"][3] is None


def _loose(folder, documents):
    for name, text in documents:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(text.encode())


def test_packed_files_read_like_loose_ones(spark, tmp_path):
    log = '{"a": 1}\r\n\nnope\n'
    documents = [
        ("g/h/1", '{"SequenceNumber": 5, "Offset": "o"}'), ("g/h/2", "{"), ("a/run.json", "{broken"), ("a/other.json", "[]"), ("b/run.json", '{"run": {}}'),
        ("l/1.jsonl", log), ("l/2.jsonl", log + "cut\r"), ("l/3.jsonl", ""), ("l/4.jsonl", "\n\n"), ("r/00-Messages.JSON", "["), ("r/02-flush.json", "{}"),
    ]
    loose, pack = tmp_path / "loose", str(tmp_path / "pack")
    _loose(loose, documents)
    files.pack_documents(spark.createDataFrame(documents, "file string, text string"), pack)

    def rows(df, *columns):
        return sorted(tuple(r[0].rsplit("/", 2)[1:]) + tuple(r)[1:] for r in df.select(*columns).collect())

    for read, columns in (
        (lambda **how: files.read_documents(spark, how.pop("at"), **how), ["file", "text"]),
        (lambda **how: run_artifacts.read_run_artifacts(spark, how.pop("at"), **how)["errors"], ["file", "message"]),
        (lambda **how: run_artifacts.read_iterations_jsonl(spark, how.pop("at") + "/l" * (not how), **how)[1], ["file", "line", "message"]),
    ):
        found, want = rows(read(at=pack, packed=True), *columns), rows(read(at=str(loose)), *columns)
        assert [r for r in found if columns[1] != "line" or r[0] == "l"] == want and want
    status = lambda df: sorted(tuple(r) for r in df.select("consumer_group", "hub", "partition_id", "seq", "msg_offset", "status").collect())
    wanted = spark.createDataFrame([("g", "h", str(i)) for i in range(1, 4)], "consumer_group string, hub string, partition_id string")
    assert status(files.read_checkpoints(spark, pack, wanted, packed=True)) == status(files.read_checkpoints(spark, str(loose), wanted))
    broken = lambda read: [r["artifact"] for r in read["errors"].collect()]
    assert broken(dump_folders.read_dump_runs(spark, pack, packed=True)) == broken(dump_folders.read_dump_runs(spark, str(loose))) == ["01-composed"]


@pytest.mark.parametrize("name", ["read_artifact_files", "read_iteration_files", "read_checkpoint_files", "read_dump_files"])
def test_number_of_files_does_not_follow_the_number_of_keys(spark, monkeypatch, name):
    packs = []
    pack = files.pack_documents
    monkeypatch.setattr(files, "pack_documents", lambda documents, path: packs.append(path) or pack(documents, path))
    QUERIES[name](spark, FOLDER)
    assert len(packs) == 1 and len(spark.read.parquet(packs[0]).inputFiles()) <= 8 < spark.read.parquet(packs[0]).count()


def test_last_lines_of_many_files_are_not_broadcast(spark):
    plan = QUERIES["read_iteration_files"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["read_artifact_files", "read_checkpoint_files", "read_dump_files", "resolve_run_folders", "dump_run_meta", "dump_run_occurrences"])
def test_what_is_read_of_many_files_is_not_broadcast(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line]
    # only the runs to leave out, which are counted before, may be broadcast
    assert joins and all("SortMergeJoin" in j or "BroadcastHashJoin" in j and "LeftAnti" in j for j in joins)
