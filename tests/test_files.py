import json
import os

import pytest

from leafwise.sources.files import read_checkpoint_files, read_prediction_files, read_training_log, write_csv


def _write(path, rows):
    with open(path, "w") as f:
        f.write("y_true,y_pred\n")
        for t, p in rows:
            f.write(f"{t},{p}\n")


def test_flat_prediction_files_keyed_by_stem(spark, tmp_path):
    _write(tmp_path / "knn_test.csv", [(1, 0), (0, 0)])
    _write(tmp_path / "svm_val.csv", [(1, 1)])
    _write(tmp_path / "ChemAp_external.csv", [("approved", "unapproved")])
    _write(tmp_path / "notes.csv", [(0, 0)])   # no split suffix: not read
    df = read_prediction_files(spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert got == [("ChemAp_external", "approved", "unapproved"), ("knn_test", "0", "0"), ("knn_test", "1", "0"),
                   ("svm_val", "1", "1")]


def test_checkpoint_family(spark, tmp_path):
    _write(tmp_path / "zeroshot_base.csv", [("approved", "approved")])
    _write(tmp_path / "prediction_df_1.0_0.9_9_500_final_setting.csv", [("unapproved", "junk")])
    df = read_checkpoint_files(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(0, "approved", "approved"), (500, "unapproved", "junk")]
    with pytest.raises(FileNotFoundError):
        read_checkpoint_files(spark, str(tmp_path), expected=[0, 500, 1000])


def test_trainer_state_document(spark, tmp_path):
    doc = {"log_history": [{"step": 10, "reward": 1.5, "rewards/int_reward_func": 0.5},
                           {"step": 5, "reward": 2.0, "rewards/int_reward_func": 0.25}]}
    (tmp_path / "trainer_state.json").write_text(json.dumps(doc, indent=2))
    df = read_training_log(spark, str(tmp_path / "trainer_state.json"), ["reward", "rewards/int_reward_func"], multi_line=True)
    rows = [tuple(r) for r in df.orderBy("pos").collect()]
    assert rows == [(0, 10, 1.5, 0.5), (1, 5, 2.0, 0.25)]   # log order kept, not step order


def test_csv_sink_with_index(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    out = str(tmp_path / "out")
    write_csv(df, out, index=True, order=["k"])
    back = spark.read.option("header", True).schema("index long, k int, v string").csv(out)
    assert sorted(map(tuple, back.collect())) == [(0, 1, "a"), (1, 2, "b"), (2, 3, "c")]


def test_named_and_partitioned_layouts_agree(spark, tmp_path):
    from leafwise.sources.files import write_named_csv, write_partitioned_csv

    df = spark.createDataFrame([("knn_test", "1", "0"), ("knn_test", "0", "0"), ("svm_val", "1", "1")],
                               "model string, y_true string, y_pred string")
    flat = str(tmp_path / "flat")
    names = write_named_csv(df, "model", flat)
    assert sorted(n.rsplit("/", 1)[1] for n in names) == ["knn_test.csv", "svm_val.csv"]
    part = write_partitioned_csv(df.repartition(3), "model", str(tmp_path / "part"))
    a = sorted(map(tuple, read_prediction_files(spark, flat).collect()))
    b = sorted(map(tuple, read_prediction_files(spark, part, layout="partitioned").collect()))
    assert a == b == sorted(map(tuple, df.collect()))


def test_training_log_missing_metric(spark, tmp_path):
    lines = [{"step": 1, "reward": 1.0, "rewards/int_reward_func": 0.5}, {"step": 2, "reward": 2.0}]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    path = str(tmp_path / "log.jsonl")
    metrics = ["reward", "rewards/int_reward_func"]
    assert [r["step"] for r in read_training_log(spark, path, metrics, on_missing="skip").collect()] == [1]
    with pytest.raises(Exception):
        read_training_log(spark, path, metrics).collect()


def test_streaming_report_is_incremental(spark, tmp_path):
    from leafwise.streaming.checkpoints import start_checkpoint_report

    src = tmp_path / "src"
    src.mkdir()
    _write(src / "zeroshot_base.csv", [("approved", "approved"), ("unapproved", "approved")])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    start_checkpoint_report(spark, str(src), out, state_path=str(state)).awaitTermination()
    first = {r["checkpoint"]: r["n_samples"] for r in spark.read.parquet(out).collect()}
    assert first == {0: 2}
    _write(src / "prediction_df_1.0_0.9_9_500_final_setting.csv", [("approved", "unapproved"), ("approved", "junk")])
    _write(src / "zeroshot_base_more.csv", [("approved", "approved")])   # not a family name: ignored
    start_checkpoint_report(spark, str(src), out, state_path=str(state)).awaitTermination()
    second = {r["checkpoint"]: r["n_samples"] for r in spark.read.parquet(out).collect()}
    assert second == {0: 2, 500: 1}


def test_columns_are_read_by_name(spark, tmp_path):
    (tmp_path / "a_test.csv").write_text("y_pred,y_true\n0,1\n")
    (tmp_path / "b_test.csv").write_text(',smiles,y_true,y_pred\n0,"C,C",0,1\n')
    got = sorted(map(tuple, read_prediction_files(spark, str(tmp_path)).collect()))
    assert got == [("a_test", "1", "0"), ("b_test", "0", "1")]
    (tmp_path / "c_test.csv").write_text("truth,y_pred\n0,1\n")
    with pytest.raises(Exception, match="y_true"):     # headers are read on the executors
        read_prediction_files(spark, str(tmp_path)).collect()


def test_quotes_and_newlines_survive(spark, tmp_path):
    import pandas as pd

    from leafwise.sources.files import read_csv

    rows = [(1, 'he said "no"\nand left, twice'), (2, "  spaces  "), (3, "back\\slash")]
    frame = pd.DataFrame(rows, columns=["k", "v"])
    frame.to_csv(tmp_path / "p.csv", index=True)
    got = sorted(map(tuple, read_csv(spark, str(tmp_path / "p.csv"), "k long, v string", multi_line=True).collect()))
    assert got == rows
    out = str(tmp_path / "out")
    write_csv(spark.createDataFrame(rows, "k long, v string").coalesce(1), out)
    part = next(p for p in os.listdir(out) if p.endswith(".csv"))
    assert pd.read_csv(os.path.join(out, part)).equals(frame)


def test_checkpoints_of_other_settings_are_left_out(spark, tmp_path):
    _write(tmp_path / "zeroshot_base.csv", [(1, 1)])
    _write(tmp_path / "prediction_df_1.0_0.9_9_500_final_setting.csv", [])   # header only: present
    _write(tmp_path / "prediction_df_0.5_0.9_9_1000_final_setting.csv", [(1, 1)])
    _write(tmp_path / "prediction_df_1.0_0.9_9_15500_final_setting.csv", [(1, 1)])
    assert [r[0] for r in read_checkpoint_files(spark, str(tmp_path), expected=[0, 500]).collect()] == [0]
    assert sorted(r[0] for r in read_checkpoint_files(spark, str(tmp_path), setting="0.5_0.9_9").collect()) == [0, 1000]


ODD_FILES = {
    "plain_test.csv": b"id,v\n1,a\n2,b\n",
    "bom_test.csv": b"\xef\xbb\xbfv,id\r\nc,3\r\nd,4",
    "a [1]{x}*?_test.csv": b'id,"v",more\n5,"x, y",z\n6,"",z\n7,,z\n',
    "ragged_test.csv": b'extra,id,v\n0,8\n0,9,e,surplus\n0,10,"say ""hi"""\n\n',
    "header_test.csv": b"id,v\n",
    "a+b%20c_test.csv": b"id,v\nnot a number,f\n",
}
ODD_ROWS = [
    ("plain_test", 1, "a"), ("plain_test", 2, "b"), ("bom_test", 3, "c"), ("bom_test", 4, "d"), ("a [1]{x}*?_test", 5, "x, y"),
    ("a [1]{x}*?_test", 6, ""), ("a [1]{x}*?_test", 7, None), ("ragged_test", 8, None), ("ragged_test", 9, "e"),
    ("ragged_test", 10, 'say "hi"'), ("a+b%20c_test", None, "f"),
]


@pytest.mark.parametrize("engine", ["source", "scan"])
def test_odd_csv_files(spark, tmp_path, engine, monkeypatch):
    import gzip

    from leafwise.sources import files as FS

    if engine == "scan":
        monkeypatch.setattr(FS, "opens", lambda path: False)
    for name, data in ODD_FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "packed_test.csv.gz").write_bytes(gzip.compress(b"v,id\ng,11\n"))
    for hidden in ("_temporary/0/x_test.csv", ".staging/x_test.csv", "_x_test.csv", ".x_test.csv"):
        (tmp_path / hidden).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / hidden).write_bytes(b"id,v\n99,hidden\n")
    got = FS.read_csv(spark, str(tmp_path), "id long, v string", with_file=True).collect()
    want = [(n + ".csv", i, v) for n, i, v in ODD_ROWS] + [("packed_test.csv.gz", 11, "g")]
    if engine == "scan":                       # that reader knows no empty value beside NULL
        want = [(n, i, v or None) for n, i, v in want]
        got = [(r["file_name"], r["id"], r["v"] or None) for r in got]
    else:
        got = [(r["file_name"], r["id"], r["v"]) for r in got]
    assert sorted(got, key=str) == sorted(want, key=str)
    one = FS.read_csv(spark, str(tmp_path / "a [1]{x}*?_test.csv"), "id long").collect()
    assert sorted(r["id"] for r in one) == [5, 6, 7]
    flat = FS.read_prediction_files(spark, str(tmp_path), schema="id long, v string").collect()
    assert sorted({r["model"] for r in flat}) == sorted({n for n, _, _ in ODD_ROWS})


def test_large_csv_file_is_cut_at_line_ends(spark, tmp_path):
    from leafwise.sources.files import read_csv

    rows = [(i, "x" * (i % 37) + ("é" if i % 5 else "")) for i in range(3000)]
    (tmp_path / "p.csv").write_text("v,id\n" + "".join(f"{v},{i}\n" for i, v in rows))
    (tmp_path / "q.csv").write_text("id,v\n" + "\n".join(f"{i + 10000},{v}" for i, v in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1000", "777", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = read_csv(spark, str(tmp_path), "id long, v string")
            assert df.rdd.getNumPartitions() > (50 if size != "100000" else 1)
            got = sorted((r["id"], r["v"] or "") for r in df.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == sorted(rows + [(i + 10000, v) for i, v in rows])


def test_partitioned_family_by_name(spark, tmp_path):
    from leafwise.sources.files import write_partitioned_csv

    names = ["a_test", "b=c_val", "d/e+f g_external", "plain"]
    df = spark.createDataFrame([(n, str(i), "0") for n in names for i in range(3)], "model string, y_true string, y_pred string")
    root = write_partitioned_csv(df, "model", str(tmp_path / "r"))
    extra = tmp_path / "r" / "model=a_test" / "other.csv"
    extra.write_text("y_pred,note,y_true\n7,n,8\n")
    got = sorted(map(tuple, read_prediction_files(spark, root, layout="partitioned").collect()))
    assert got == sorted([*(tuple(r) for r in df.where("model <> 'plain'").collect()), ("a_test", "8", "7")])


def test_read_train_takes_csv_columns_by_name(spark, tmp_path):
    from leafwise.sources.files import read_train

    (tmp_path / "t.csv").write_text("label,smiles,id,split\n1,CC,0,train\n0,CO,1,test\n")
    got = read_train(spark, str(tmp_path / "t.csv"), "id long, label int, split string", fmt="csv")
    assert [tuple(r) for r in got.collect()] == [(0, 1, "train")]
    with pytest.raises(ValueError):
        read_train(spark, str(tmp_path / "t.csv"), fmt="csv")


def test_json_lines_are_numbered_in_log_order(spark, tmp_path):
    for name, first in (("a.jsonl", 0), ("b.jsonl", 1000)):
        steps = [first + (i * 7919) % 500 for i in range(500)]
        (tmp_path / name).write_text("\n".join(json.dumps({"step": s, "reward": float(i)}) for i, s in enumerate(steps)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = read_training_log(spark, str(tmp_path), ["reward"])
        assert df.rdd.getNumPartitions() > 1
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 1000 and all(r["pos"] == r["reward"] for r in rows)     # the place in the file, not the step


def test_generation_resumes(spark, tmp_path):
    from pyspark.sql import functions as F

    from leafwise.operators.generate import batch_generate, build_prompt

    seen = str(tmp_path / "seen")

    def factory(options, fail_on=None):
        def generate(prompts):
            texts = [p[-1]["content"] for p in prompts]
            if fail_on and any(fail_on in t for t in texts):
                raise RuntimeError("generator lost")
            with open(seen, "a") as f:
                f.write("".join(f"{t.split()[2]}\n" for t in texts))
            return [f"{t.split()[2]}@{options['top_k']}" for t in texts]

        return generate

    ids = [*range(40), 2**53 + 1, None]
    df = spark.createDataFrame([(i, f"t{k % 20}") for k, i in enumerate(ids)], "id long, text string")
    prompted = build_prompt(df, {"features": "text", "approved": "text", "unapproved": "text"})
    store = str(tmp_path / "store")
    with pytest.raises(Exception, match="generator lost"):
        batch_generate(prompted, lambda o: factory(o, "t7"), store=store, chunks=8)
    done = len(open(seen).read().split()) if os.path.exists(seen) else 0
    kept = spark.read.parquet(store).count() if os.path.exists(store) else 0
    out = batch_generate(prompted, factory, store=store, chunks=8, keep=["text"])
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(i, f"t{k % 20}", f"t{k % 20}@9") for k, i in enumerate(ids)], key=str)
    again = len(open(seen).read().split())
    assert again - done == 20 - kept                       # only what was missing, each distinct prompt once
    assert batch_generate(prompted, factory, store=store, chunks=8).count() == len(ids)
    assert len(open(seen).read().split()) == again         # nothing is generated twice
    other = batch_generate(prompted.limit(1), factory, store=store, options={"top_k": 3})
    assert other.select(F.col("generated")).first()[0].endswith("@3")
    plain = batch_generate(prompted, factory)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted([(i, f"t{k % 20}@9") for k, i in enumerate(ids)], key=str)
