"""Streams of file versions, and logs of changes."""

import random

from pyspark.sql import functions as F

from codestrata.operators import edits
from codestrata.sources import facts
from codestrata.streaming import findings as live

VERSION = "repo string, path string, version long, content string"
A, B = "a = 1\n", "b = 1\n"


def test_versions_go_back_leave_come_late_and_go_on_after_a_restart(spark, tmp_path):
    batches = [
        [("r", "p.py", 1, A), ("r", "p.py", 2, B), ("r", "q.py", 1, A), ("s", "p.py", 1, A)],
        [("r", "p.py", 3, A), ("r", "q.py", 2, None), ("r", "never.py", 1, None), ("s", "p.py", 2, A)],
        [("r", "p.py", 2, "late = 1\n"), ("r", "p.py", 3, "again = 1\n"), ("r", "q.py", 3, B), ("s", "p.py", 5, None), ("r", "w.py", 1, "def ("), ("r", "w.py", 2, "")],
    ]
    for rows in batches:  # each round is a query of its own that goes on from the checkpoint
        spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(VERSION).parquet(str(tmp_path / "in"))
        live.stream_versions(stream, str(tmp_path / "out"), str(tmp_path / "c"), lambda df: facts.extract_facts(df, ("def", "failure"))).awaitTermination(120)
    got = {(r["repo"], r["path"], r["version"], r["change"]) for r in spark.read.parquet(str(tmp_path / "out/versions")).collect()}
    assert got == {
        ("r", "p.py", 1, "added"), ("r", "p.py", 2, "changed"), ("r", "p.py", 3, "changed"), ("r", "q.py", 1, "added"), ("r", "q.py", 2, "deleted"), ("r", "q.py", 3, "added"),
        ("s", "p.py", 1, "added"), ("s", "p.py", 5, "deleted"), ("r", "w.py", 1, "added"), ("r", "w.py", 2, "changed"),
    }
    every = {(r["repo"], r["path"], r["version"], r["name"]) for r in spark.read.parquet(str(tmp_path / "out/facts")).filter("tag = 'def'").collect()}
    assert every == {("r", "p.py", 1, "a"), ("r", "p.py", 2, "b"), ("r", "p.py", 3, "a"), ("r", "q.py", 1, "a"), ("r", "q.py", 3, "b"), ("s", "p.py", 1, "a")}
    assert {(r["repo"], r["path"], r["name"]) for r in live.current_facts(spark, str(tmp_path / "out")).filter("tag = 'def'").collect()} == {("r", "p.py", "a"), ("r", "q.py", "b")}


def test_plain_streams_see_a_file_that_goes_back(spark, tmp_path):
    schema = "repo string, path string, content string"
    for text in (A, B, B, A):
        spark.createDataFrame([("r", "p.py", text)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.stream_facts(stream, str(tmp_path / "out"), str(tmp_path / "c"), lambda df: facts.extract_facts(df, ("def",))).awaitTermination(120)
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out/facts")).collect()) == ["a", "a", "b"]


def test_change_stacks_are_those_of_a_replay(spark):
    rng, rows, want = random.Random(2), [], set()
    for project in range(12):
        done, back = [], []
        for seq in range(rng.choice([0, 1, 5, 40, 200])):
            op = rng.choice(["do", "do", "undo", "undo", "redo"])
            if op == "undo" and not done or op == "redo" and not back:
                op = "do"
            if op == "do":
                done, back = [*done, seq], []
            else:
                (back if op == "undo" else done).append((done if op == "undo" else back).pop())
            rows.append((project, seq, op, f"c{seq}" if op == "do" else None))
        want |= {(project, seq, f"c{seq}", k + 1, "done") for k, seq in enumerate(done)} | {(project, seq, f"c{seq}", len(done) + 1 + k, "redoable") for k, seq in enumerate(reversed(back))}
    log = spark.createDataFrame(rows, "project int, seq long, op string, content string")
    for block in (7, 10_000):
        got = edits.change_stacks(log, block=block).select("project", "seq", "content", "level", "state").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert edits.change_stacks(log.filter(F.lit(False))).count() == 0
