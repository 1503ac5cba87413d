"""Streams of findings and of file versions."""

from __future__ import annotations

import sys
from hashlib import md5

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

PAYLOAD = "array<struct<line:int,severity:string,message:string>>"


def latest_findings(messages: DataFrame) -> DataFrame:
    """The whole set of findings of each path by its greatest version; a stream or a table of (path, version, payload).

    A payload that isn't an array is ignored; an empty one clears the path. The version decides, not the arrival.
    """
    parsed = messages.withColumn("findings", F.from_json("payload", PAYLOAD)).filter(F.col("findings").isNotNull() & F.startswith(F.ltrim("payload"), F.lit("[")))
    return parsed.groupBy("path").agg(F.max("version").alias("version"), F.max_by("findings", "version").alias("findings"))


def stream_facts(files: DataFrame, facts_dir: str, checkpoint_dir: str, extract) -> object:
    """Start a query that extracts facts of new and changed file versions (path, content) and writes them under facts_dir/facts.

    A version whose content is that of the path's latest one, by the time of its batch, is skipped. A batch writes its facts to its own folder (batch=n), then its
    versions to a folder of the same name, and a retried batch overwrites both; versions of the batch itself are never
    "already there", so a failure between the two writes neither loses nor doubles facts. Folders must be shared by all executors.
    """

    # a checkpoint folder numbers its batches from 0, so its name is part of theirs
    stem = md5(checkpoint_dir.encode()).hexdigest()[:12]
    name = lambda batch_id: f"{stem}-{batch_id}"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("hash", F.md5("content")).dropDuplicates(["path", "hash"])
        try:
            seen = spark.read.parquet(f"{facts_dir}/versions").filter(F.col("batch") != name(batch_id))
            last = seen.groupBy("path").agg(F.max("at").alias("at"))
            rows = rows.join(seen.join(last, ["path", "at"]).select("path", "hash"), ["path", "hash"], "left_anti")
        except AnalysisException as e:  # the first batch has no folder yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        extract(rows.select("repo", "path", "content")).write.mode("overwrite").parquet(f"{facts_dir}/facts/batch={name(batch_id)}")
        rows.select("path", "hash", F.unix_micros(F.current_timestamp()).alias("at")).write.mode("overwrite").parquet(f"{facts_dir}/versions/batch={name(batch_id)}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


CHANGED = "repo string, path string, version long, change string, content string"


def _changes(key, frames, state):
    """What is new in a file's versions of one batch, in their order: rows of CHANGED."""
    last, digest = state.get if state.exists else (None, None)
    out = []
    for version, content in sorted(((v, c) for f in frames for v, c in zip(f["version"], f["content"])), key=lambda x: x[0]):
        if last is not None and version <= last:
            continue
        gone = content is None or content != content
        now = "" if gone else md5(content.encode(errors="surrogatepass")).hexdigest()
        if now != (digest or ""):
            out.append((*key, version, "deleted" if gone else "changed" if digest else "added", None if gone else content))
        last, digest = version, now
    state.update((last, digest))
    yield pd.DataFrame(out, columns=["repo", "path", "version", "change", "content"])


def stream_versions(files: DataFrame, facts_dir: str, checkpoint_dir: str, extract):
    """Start a query over file versions (repo, path, version, content; null content says that the file is deleted) that writes the
    facts of every version that changes its file under facts_dir/facts, and what changed under facts_dir/versions.

    State is kept by repo and path: the greatest version so far and its hash. A version that comes after a greater one, or
    again, is stale and passed over; one that equals the file's latest content changes nothing; one that goes back to earlier
    content is a change. The state lives in the checkpoint, so a query that starts again from it goes on where it was. A
    batch writes folders of its own name, which a retry overwrites. Folders must be shared by all executors.
    """
    stem = md5(checkpoint_dir.encode()).hexdigest()[:12]
    changes = files.select("repo", "path", F.col("version").cast("long").alias("version"), "content").groupBy("repo", "path")
    changes = changes.applyInPandasWithState(_changes, CHANGED, "version long, hash string", "append", GroupStateTimeout.NoTimeout)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        # facts carry the repo through, and the version in it
        named = batch.filter("content is not null").select(F.concat_ws("\n", F.col("version").cast("string"), "repo").alias("repo"), "path", "content")
        found = extract(named).withColumns({"version": F.substring_index("repo", "\n", 1).cast("long"), "repo": F.expr("substring(repo, instr(repo, '\n') + 1)")})
        found.write.mode("overwrite").parquet(f"{facts_dir}/facts/batch={stem}-{batch_id}")
        batch.select("repo", "path", "version", "change").write.mode("overwrite").parquet(f"{facts_dir}/versions/batch={stem}-{batch_id}")
        batch.unpersist()

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def current_facts(spark: SparkSession, facts_dir: str) -> DataFrame:
    """The facts of every file's latest version, of files that are not deleted."""
    versions = spark.read.parquet(f"{facts_dir}/versions")
    last = versions.groupBy("repo", "path").agg(F.max("version").alias("version"), F.max_by("change", "version").alias("change"))
    kept = last.filter("change <> 'deleted'").select("repo", "path", "version")
    return spark.read.parquet(f"{facts_dir}/facts").drop("batch").join(kept, ["repo", "path", "version"], "left_semi")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
