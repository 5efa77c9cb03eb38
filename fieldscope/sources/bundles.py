"""Session bundles: metadata in TOML, file digests, track arrays, and tables replaced per recording."""

from __future__ import annotations

import io
import tomllib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldscope.sources.tables import plain_path, told_path, written

META = "path string, recording string, rate double, frames long, channel int, validated boolean, digests array<string>, file_frames array<long>, problems array<string>"


def _number(value, kind):
    """A real number of the kind; a boolean in its place counts as absent."""
    return kind(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _meta_row(path: str, raw: bytes) -> tuple:
    try:
        doc = tomllib.loads(raw.decode())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError):
        return (path, None, None, None, None, None, None, None, ["unreadable"])
    a, problems = doc.get("alignment", {}), []
    plural = lambda one, many: a.get(many) if isinstance(a.get(many), list) else [a[one]] if one in a else None
    frames = plural("file_frames", "files_frames")
    validated = a.get("validated")
    if validated is not None and not isinstance(validated, bool):
        validated = problems.append("validated is no truth value")
    digests = plural("sha256", "sha256s")
    if digests and frames and len(digests) != len(frames):
        problems.append("digests and frames differ in number")
    total = _number(a.get("frames"), int)
    if frames and total is not None and sum(frames) != total:
        problems.append("file frames do not add up")
    name = a.get("recording")
    return (path, str(name).rsplit("/", 1)[-1] if name else None, _number(a.get("rate"), float), total, _number(a.get("channel"), int), validated, digests, frames, problems)


def read_session_meta(spark: SparkSession, folder: str) -> DataFrame:
    """One row per *_metadata.toml below folder, with typed values; null means unknown. Singular and plural keys are both read."""

    def parse(batches):
        for pdf in batches:
            rows = [_meta_row(p, c) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in META.split(", ")]).astype({"frames": "Int64", "channel": "Int32", "validated": "boolean"})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*_metadata.toml").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "content").mapInPandas(parse, META)


def discover_bundles(meta: DataFrame, recordings: DataFrame) -> DataFrame:
    """recording, path of the one bundle that names each of recordings(recording), by file name; n tells how many do, and of several none is taken."""
    name = F.element_at(F.split("recording", "/"), -1)
    met = recordings.select("recording", name.alias("_name")).join(meta.select(F.col("recording").alias("_name"), "path"), "_name", "left")
    out = met.groupBy("recording").agg(F.count("path").alias("n"), F.min("path").alias("path"))
    return out.select("recording", F.when(F.col("n") == 1, F.col("path")).alias("path"), "n")


def verify_sha256(spark: SparkSession, declared: DataFrame) -> DataFrame:
    """path, same of declared(path, sha256): whether the file has that digest; null where none is declared."""
    paths = [r.path for r in declared.select("path").distinct().collect()]  # the files of one recording
    have = spark.read.format("binaryFile").load(paths).select(plain_path(F.col("path")).alias("_name"), F.sha2("content", 256).alias("_sha"))
    names = F.broadcast(spark.createDataFrame([(p, told_path(p)) for p in paths], "path string, _name string"))
    return declared.join(names, "path").join(have, "_name").select("path", (F.lower("sha256") == F.col("_sha")).alias("same"))


def read_tracks(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """session_id, row, k, f, ident, t of folders of arrays fund_v, idx_v, ident_v and times .npy, a session a folder.

    An id that is NaN is null. Lengths that differ, frames out of range, or ids that are no whole numbers are an error in that session's task.
    """
    keyed = spark.createDataFrame([(s, told_path(f.rstrip("/"))) for s, f in folders.items()], "session_id string, _folder string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(list(folders.values()))
    named = files.select(F.regexp_extract(plain_path(F.col("path")), r"^(.*)/[^/]+$", 1).alias("_folder"), F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("name"), "content")

    def load(pdf: pd.DataFrame) -> pd.DataFrame:
        a = {n: np.load(io.BytesIO(c), allow_pickle=False) for n, c in zip(pdf["name"], pdf["content"], strict=True)}
        f, k, ident, times = (a[n] for n in ("fund_v", "idx_v", "ident_v", "times"))
        if len({len(f), len(k), len(ident)}) > 1 or (len(k) and (k.min() < 0 or k.max() >= len(times))):
            raise ValueError("track arrays do not fit together")
        known = ident[~np.isnan(ident)]
        if (known != np.round(known)).any():
            raise ValueError("ids must be whole numbers")
        ids = pd.array([None if np.isnan(i) else int(i) for i in ident], "Int64")
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "row": np.arange(len(f)), "k": k, "f": f, "ident": ids, "t": times[k]})

    return named.join(F.broadcast(keyed), "_folder").select("session_id", "name", "content").groupBy("session_id").applyInPandas(load, "session_id string, row long, k long, f double, ident long, t double")


def write_tracks(rows: DataFrame, path: str) -> DataFrame:
    """Writes a track table(session_id, row, ident, ...) below path and returns the sessions whose rows were written, not only their ids.

    Ids go to path/ident, all else to path/rows, a folder a session; sessions that rows does not hold stay. A session whose rows are as they were
    written before gets new ids only.
    """
    spark = rows.sparkSession
    base = rows.drop("ident")
    try:
        before = spark.read.schema(base.schema).parquet(f"{path}/rows").select(*base.columns)
    except AnalysisException:
        before = base.limit(0)
    mine = before.join(base.select("session_id").distinct(), "session_id", "left_semi").select(*base.columns)
    changed = written(base.exceptAll(mine).select("session_id").union(mine.exceptAll(base).select("session_id")).distinct(), "changed-sessions")
    replace_recordings(base.join(changed, "session_id", "left_semi"), f"{path}/rows", "session_id")
    replace_recordings(rows.select("session_id", "row", "ident"), f"{path}/ident", "session_id")
    return changed


def read_written_tracks(spark: SparkSession, path: str) -> DataFrame:
    rows, ident = (spark.read.parquet(f"{path}/{part}") for part in ("rows", "ident"))
    return rows.join(ident, ["session_id", "row"], "left")


def file_set_key(files: DataFrame) -> DataFrame:
    """recording_id, key of files(recording_id, path, frames): the same for the same files in the same order of paths."""
    each = F.concat_ws(":", "path", F.col("frames").cast("string"))
    return files.groupBy("recording_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(each)), "|"), 256).alias("key"))


def usable_overviews(stored: DataFrame, files: DataFrame, most_step: int, channels: DataFrame | None = None) -> DataFrame:
    """Rows of stored(recording_id, key, step, channel, ...) that still hold: of the files there are now and no coarser than most_step.

    channels(recording_id, channels): recordings of which not every channel is stored are left out whole; what is missing here is to be computed anew.
    """
    out = stored.where(F.col("step") <= most_step).join(file_set_key(files), ["recording_id", "key"], "left_semi")
    if channels is not None:
        whole = out.groupBy("recording_id").agg(F.count_distinct("channel").alias("n")).join(channels, "recording_id").where("n = channels").select("recording_id")
        out = out.join(whole, "recording_id", "left_semi")
    return out


def replace_recordings(rows: DataFrame, path: str, key: str = "recording_id") -> None:
    """Writes rows in folders of their recording; those recordings are replaced whole, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def apply_variant(rows: DataFrame, variants: DataFrame, variant: str) -> DataFrame:
    """rows(session_id, row, ident, ...) with the ids of one of variants(session_id, row, variant, ident); rows it lacks are unassigned."""
    v = variants.where(F.col("variant") == variant).select("session_id", "row", F.col("ident").alias("_ident"))
    return rows.join(v, ["session_id", "row"], "left").withColumn("ident", F.col("_ident")).drop("_ident")


def epoch_summary(curve: DataFrame) -> DataFrame:
    """run, epoch, score: the best epoch of curve(run, epoch, score), the first of equals."""
    w = Window.partitionBy("run").orderBy(F.col("score").desc(), "epoch")
    return curve.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def review_lines(items: DataFrame) -> DataFrame:
    """items as JSON lines."""
    return items.select(F.to_json(F.struct("*")).alias("value"))

