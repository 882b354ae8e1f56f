"""Problem 4: size-tiered incremental compaction of very many small files.

The plan is made on metadata (one row per file), never on the readings: similarly sized files are merged level by
level, each merge being one transaction with its inputs and its output. The readings are then moved once, from their
first file to the output that the last level names, which is one physical file. A later run takes new entries
together with the live outputs of earlier runs that are not yet of full size: these enter the tier of their size again.

Journal: run_id, level, action, txn_id, output_id, file_id, n_rows, path, obs_name, slot. Actions are
  take, drop  (level 0) an entry that adds n_rows readings, or none;
  merge       one input (file_id) of a merge at a level;
  write       an output, its rows and the path of its file;
  retire      the output of an earlier run, by path, that outputs of this run replace.
A run's data and journal lie in folders named by a hash of its inputs, and count only once its row in ``commits``
stands: a run that died is repeated into the same folders, and what it left is never read.

Defined results: a reading is an obs_id and belongs to the entry with the smallest file_id of the run that first
holds it; rows without obs_id or file_id are no readings. Entries without rows, and entries all of whose readings
stand in earlier entries, contribute nothing and are dropped. Files in obs that the manifest does not list are taken
into the plan. Entries without sensor or window take them from their readings; where these have no time either, the
entry's number stands for its window, so that such entries are spread. n_rec and n_bytes of the manifest may be null or
wrong, so sizes are counted from the readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.sources.tables import broadcast_if_small, exists, hinted, materialize

FANOUT = 8  # growth of the size limit, and of the time span, from one tier to the next; files this much larger stay apart
FIRST_ROWS = 64  # rows up to which a file belongs to tier 0
TARGET_ROWS = 1 << 20  # rows of a well-sized file
PERIOD_S = 10800  # files cover windows of three hours
GROUP_FILES = 20000  # files that one task puts in order at the first level

_COLUMNS = "level int, action string, txn_id string, output_id long, file_id long, n_rows long, path string, obs_name string, slot long"
JOURNAL = f"{_COLUMNS}, run_id string"


def owners(obs: DataFrame) -> DataFrame:
    """obs_id, file_id of the first entry that holds it. One partial aggregate, one shuffle of two numbers a reading."""
    return obs.filter("obs_id is not null and file_id is not null").groupBy("obs_id").agg(F.min("file_id").alias("file_id"))


def _slot(t: Column) -> Column:
    return F.floor(F.unix_timestamp(t.cast("timestamp")) / PERIOD_S)


def contributions(own: DataFrame, manifest: DataFrame) -> DataFrame:
    """file_id, obs_name, slot, n_kept: readings that each entry adds; 0 where it adds nothing.

    ``own``: obs_id, file_id, and sensor and name_time if there are any, which stand in for what the manifest does not tell.
    """
    fall = [F.min("sensor").alias("_s") if "sensor" in own.columns else F.lit(None).cast("string").alias("_s")]
    fall.append(F.min(_slot(F.col("name_time"))).alias("_t") if "name_time" in own.columns else F.lit(None).cast("long").alias("_t"))
    kept = own.groupBy("file_id").agg(F.count("*").alias("n_kept"), *fall)
    entries = manifest.filter("file_id is not null").groupBy("file_id").agg(F.min("obs_name").alias("obs_name"), F.min("window_ts").alias("window_ts"))
    return entries.join(kept, "file_id", "full").select(
        "file_id",
        F.coalesce("obs_name", "_s", F.lit("")).alias("obs_name"),
        F.coalesce(_slot(F.col("window_ts")), "_t", "file_id").alias("slot"),
        F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
    )


def _row(level: int | Column, action: str, txn: Column, **cols: Column) -> list[Column]:
    """Columns of a journal row; those not given are null."""
    level = F.lit(level) if isinstance(level, int) else level
    known = {"level": level, "action": F.lit(action), "txn_id": txn, **cols}
    return [(known[c] if c in known else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in _COLUMNS.split(", "))]


def limits(target_rows: int = TARGET_ROWS, fanout: int = FANOUT) -> list[int]:
    """Size limit of each level."""
    out = [min(target_rows, FIRST_ROWS * fanout)]
    while out[-1] < target_rows:
        out.append(min(target_rows, out[-1] * fanout))
    return out


def plan(contrib: DataFrame, target_rows: int = TARGET_ROWS, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(journal rows, placement) of all levels for live files: file_id, obs_name, slot, n_kept.

    placement: file_id, output_id of every contributing file.

    At level l the live files of a sensor and of a time span of fanout**l windows that are under the size limit of
    the tier (FIRST_ROWS * fanout**l, at most target_rows) are put in order of time, cut into runs of that size and
    merged; larger ones wait for a higher level. A file beyond the first tier that is more than ``fanout`` times as large as
    the rest of its run stays apart, so that a few new rows never move a large output. Spans nest, so each group holds the few outputs of the
    level below; at the first level, groups of more than GROUP_FILES are cut by hash. The number of levels follows from
    target_rows and fanout alone.
    """
    live = contrib.select("file_id", F.coalesce("obs_name", F.lit("")).alias("obs_name"), "slot", F.col("n_kept").alias("n_rows"))
    journal = live.filter("n_rows = 0").select(*_row(0, "drop", F.concat(F.lit("0-drop-"), F.col("file_id")), file_id=F.col("file_id"), n_rows=F.col("n_rows")))
    # 'now' is the id of the live file that holds an entry; ids are those of the first input
    live = live.filter("n_rows > 0").withColumn("now", F.col("file_id"))
    files = live.select("now", "obs_name", "slot", "n_rows")
    step = live.select("file_id", "now")
    for level, limit in enumerate(limits(target_rows, fanout), 1):
        files = files.withColumns({"span": F.floor(F.col("slot") / fanout**level), "small": F.col("n_rows") < limit, "part": F.lit(0).cast("long")})
        if level == 1:
            crowd = files.groupBy("obs_name", "span", "small").agg(F.ceil(F.count("*") / GROUP_FILES).alias("_k")).filter("_k > 1")
            files = files.join(crowd, ["obs_name", "span", "small"], "left")
            files = files.withColumn("part", F.coalesce(F.pmod(F.xxhash64("now"), F.col("_k")), F.lit(0))).drop("_k")
        group = ["obs_name", "span", "small", "part"]
        cut = files.withColumn("run", F.floor((F.sum("n_rows").over(W.partitionBy(*group).orderBy("slot", "now")) - 1) / limit))
        cut = cut.withColumn("run", F.when(F.col("small"), F.col("run")).otherwise(-F.col("now") - 1))
        whole = W.partitionBy(*group, "run")
        cut = cut.withColumn("_top", F.max(F.struct("n_rows", "now")).over(whole)).withColumn("_all", F.sum("n_rows").over(whole))
        much = (F.col("_top.n_rows") >= FIRST_ROWS * fanout) & (F.col("_top.n_rows") > fanout * (F.col("_all") - F.col("_top.n_rows")))
        cut = cut.withColumn("apart", (F.col("_top.now") == F.col("now")) & much)
        merge = W.partitionBy(*group, "run", "apart")
        cut = cut.withColumns({"output_id": F.min("now").over(merge), "n_in": F.count("*").over(merge), "n_out": F.sum("n_rows").over(merge), "slot_out": F.min("slot").over(merge)})
        cut = materialize(cut.select("now", "obs_name", "output_id", "n_in", "n_rows", "n_out", "slot_out"), f"compact{level}")
        merged = cut.filter("n_in > 1")
        txn = merged.groupBy("output_id").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("now"))), 256).alias("h"))
        journal = journal.unionByName(merged.join(txn, "output_id").select(*_row(level, "merge", F.concat(F.lit(f"{level}-"), F.col("h")), output_id=F.col("output_id"), file_id=F.col("now"), n_rows=F.col("n_rows"))))
        step = step.join(cut.select("now", "output_id"), "now").select("file_id", F.col("output_id").alias("now"))
        files = cut.groupBy(F.col("output_id").alias("now"), "obs_name").agg(F.min("slot_out").alias("slot"), F.max("n_out").alias("n_rows"))
    return journal, step.select("file_id", F.col("now").alias("output_id"))


def read_journal(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The journal of the committed runs; None before the first."""
    if not exists(spark, f"{out_dir}/commits"):
        return None
    commits = spark.read.schema("run_id string").parquet(f"{out_dir}/commits")
    return spark.read.schema(JOURNAL).parquet(f"{out_dir}/journal").join(commits, "run_id", "left_semi")


def live_outputs(journal: DataFrame) -> DataFrame:
    """run_id, output_id, n_rows, path, obs_name, slot of the files that no later run has replaced."""
    gone = journal.filter("action = 'retire'").select("path")
    return journal.filter("action = 'write'").join(gone, "path", "left_anti").select("run_id", "output_id", "n_rows", "path", "obs_name", "slot")


def _stored(spark: SparkSession, out_dir: str, outputs: DataFrame, *cols: str) -> DataFrame:
    """Rows of the given outputs (run_id, output_id, cols); other partitions of the store are pruned as the query runs."""
    store = spark.read.option("mergeSchema", "true").parquet(f"{out_dir}/data")
    return store.join(broadcast_if_small(outputs.select("run_id", "output_id", *cols), "outputs"), ["run_id", "output_id"])


def compacted(spark: SparkSession, out_dir: str) -> DataFrame:
    """The readings as the journal tells them: only live outputs of committed runs are read."""
    return _stored(spark, out_dir, live_outputs(read_journal(spark, out_dir)))


def compact(spark: SparkSession, obs: DataFrame, manifest: DataFrame, out_dir: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Write each reading once into few files under ``out_dir``/data, one file an output, and return the journal.

    Idempotent: a run over entries that the journal already covers writes nothing. A run takes the entries that are new,
    leaves out readings that live outputs already hold (only their obs_id are read, of the row groups in the new ids'
    range), and merges with live outputs under full size of the sensors and spans it touches. What was written is
    counted against the plan before the run is committed. Rows keep all their columns and get run_id and output_id;
    columns of these names in the input are replaced.
    """
    obs = obs.filter("obs_id is not null and file_id is not null")
    done = read_journal(spark, out_dir)
    live = None
    if done is not None:
        seen = done.filter("level = 0").select("file_id")
        new = materialize(obs.select("file_id").union(manifest.filter("file_id is not null").select("file_id")).distinct().join(seen, "file_id", "left_anti"), "new")
        if new.isEmpty():
            return done
        new = broadcast_if_small(new, "new")
        obs, manifest = obs.join(new, "file_id", "left_semi"), manifest.join(new, "file_id", "left_semi")
        live = materialize(live_outputs(done), "live")
    # the copy of each reading in its first file
    content = F.struct(*[c for c in obs.columns if c not in ("obs_id", "output_id", "run_id")])
    rows = materialize(obs.groupBy("obs_id").agg(F.min_by(content, "file_id").alias("_c")).select("obs_id", "_c.*"), "first")
    if live is not None and not live.isEmpty():
        ends = rows.agg(F.min("obs_id"), F.max("obs_id")).first()
        held = _stored(spark, out_dir, live).filter(F.col("obs_id").between(ends[0], ends[1])).select("obs_id")
        rows = rows.join(held.join(broadcast_if_small(rows.select("obs_id"), "ids"), "obs_id", "left_semi"), "obs_id", "left_anti")
    contrib = materialize(contributions(rows.select(*[c for c in ("obs_id", "file_id", "sensor", "name_time") if c in rows.columns]), manifest), "entries")
    entries, taken = contrib.agg(F.count("*"), F.sum("n_kept")).first()
    if not entries:
        return done if done is not None else spark.createDataFrame([], JOURNAL)
    files = contrib.withColumns({"old": F.lit(None).cast("string"), "path": F.lit(None).cast("string")})  # of live outputs: their run and file
    if live is not None:
        top = FANOUT ** len(limits(target_rows))
        touched = contrib.filter("n_kept > 0").select("obs_name", F.floor(F.col("slot") / top).alias("_span")).distinct()
        again = live.filter(F.col("n_rows") < target_rows).withColumn("_span", F.floor(F.col("slot") / top)).join(touched, ["obs_name", "_span"], "left_semi")
        files = files.unionByName(again.select(F.col("output_id").alias("file_id"), "obs_name", "slot", F.col("n_rows").alias("n_kept"), F.col("run_id").alias("old"), "path"))
    journal, placement = plan(files, target_rows)
    placement = materialize(placement, "placement")
    takes = contrib.filter("n_kept > 0").select(*_row(0, "take", F.concat(F.lit("0-take-"), "file_id"), file_id=F.col("file_id"), n_rows=F.col("n_kept")))
    journal = materialize(journal.unionByName(takes), "journal")
    run_id = "run-" + journal.agg(F.format_string("%016x", F.bit_xor(F.xxhash64("txn_id", "file_id")))).first()[0]
    # outputs of this run: all but live files that were merged with nothing
    sized = placement.join(files, "file_id")
    moved = rows.join(hinted(placement), "file_id")
    planned = sized.groupBy("output_id").agg(F.sum("n_kept").alias("n_rows"), F.min("obs_name").alias("obs_name"), F.min("slot").alias("slot"), F.max(F.when(F.col("old").isNull(), 1).otherwise(0)).alias("_new"), F.count("*").alias("_n"))
    planned = planned.filter("_n > 1 or _new = 1").select("output_id", "n_rows", "obs_name", "slot")
    retired = None
    if live is not None:
        planned = materialize(planned, "planned")
        retired = materialize(sized.filter("old is not null").join(planned.select("output_id"), "output_id").select(F.col("old").alias("run_id"), F.col("file_id").alias("output_id"), F.col("output_id").alias("_to"), "path"), "retired")
        if not retired.isEmpty():
            back = _stored(spark, out_dir, retired, "_to").drop("run_id", "output_id").withColumnRenamed("_to", "output_id")
            moved = moved.unionByName(back, allowMissingColumns=True)
    at = f"{out_dir}/data/run_id={run_id}"
    if taken:
        order = [c for c in ("output_id", "name_time") if c in moved.columns]
        # an output is at most target_rows or one merge of smaller ones, so one task and one file hold it
        moved.repartition("output_id").sortWithinPartitions(*order).write.mode("overwrite").partitionBy("output_id").parquet(at)
        found = spark.read.parquet(at).groupBy(F.col("output_id").cast("long").alias("output_id"), F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("_n"))
        written = materialize(planned.join(found, "output_id", "full"), "written")
        if not written.filter("_n is null or n_rows is null or _n <> n_rows").isEmpty():
            raise RuntimeError(f"the files under {at} do not hold what the plan says")
        name = F.concat(F.lit("write-"), "output_id")
        journal = journal.unionByName(written.select(*_row(99, "write", name, **{c: F.col(c) for c in ("output_id", "n_rows", "path", "obs_name", "slot")})))
        if retired is not None:
            journal = journal.unionByName(retired.select(*_row(99, "retire", F.concat(F.lit("retire-"), "output_id"), output_id=F.col("output_id"), path=F.col("path"))))
    journal.write.mode("overwrite").parquet(f"{out_dir}/journal/run_id={run_id}")
    spark.range(1).select(F.lit(run_id).alias("run_id")).coalesce(1).write.mode("append").parquet(f"{out_dir}/commits")
    return read_journal(spark, out_dir)
