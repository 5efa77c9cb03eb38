"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", recursive: bool = False):
    """Registers a function under its name; views names the SQL views (of SQL_VIEWS) that sql reads, in order."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ", ".join(SQL_VIEWS[v] for v in views.split())
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' * recursive}{head}" + (", " if sql.lstrip().startswith("+") else " ") if head else "") + sql.lstrip().removeprefix("+")
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL of the stand-in views, as the functions below build them.
SQL_VIEWS = {
    "ev": "ev AS (SELECT event_id, user_id AS channel, event_type AS category, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t FROM events)",
    "spans": "spans AS (SELECT channel, event_id AS row, t AS t0, t + value * 60 AS t1 FROM ev)",
    "steps": "steps AS (SELECT channel, category AS name, event_id AS row, t, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM ev)",
    "labels": "lab AS (SELECT event_id AS label_id, category, CASE WHEN event_id % 5 = 0 THEN 'point' ELSE 'span' END AS kind, CASE WHEN event_id % 7 = 0 THEN NULL ELSE channel % 16 END AS channel, t AS t0, CASE WHEN event_id % 5 = 0 THEN NULL ELSE t + value END AS t1, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS f0, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value + 50 END AS f1 FROM ev)",
    "boxes": "boxes AS (SELECT channel AS rec, event_id AS uid, category AS cls, (event_id % 97) / 97.0::DOUBLE AS score, t AS t0, t + 3600 AS t1, value AS f0, value + 50 AS f1 FROM ev)",
    "tracks": "trk AS (SELECT event_id % 3 AS session, event_id AS row, CASE WHEN category = 'error' THEN NULL ELSE channel END AS ident, CAST(floor(t / 3600) AS BIGINT) AS k, value AS f, t FROM ev)",
    "files": "files AS (SELECT o_custkey AS rec, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS part, o_orderkey % 5000 + 1 AS frames, epoch_us(o_orderdate) / 1e6 AS stamp FROM orders)",
    "emb": "emb AS (SELECT vec_id AS rec, unnest(generate_series(0, len(embedding) - 1)) AS frame, unnest(embedding)::DOUBLE AS value FROM embeddings)",
}


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, channel, category, value, t: events as irregular samples; t in seconds from 2024-01-01."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6D")
    return load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("channel"), F.col("event_type").alias("category"), "value", t.alias("t"))


def ev_spans(spark, sf_dir):
    return ev(spark, sf_dir).select("channel", F.col("event_id").alias("row"), F.col("t").alias("t0"), (F.col("t") + F.col("value") * 60).alias("t1"))


def ev_steps(spark, sf_dir):
    value = F.when(F.col("event_id") % 11 != 0, F.col("value"))
    return ev(spark, sf_dir).select("channel", F.col("category").alias("name"), F.col("event_id").alias("row"), "t", value.alias("value"))


def ev_labels(spark, sf_dir):
    e, point, band = ev(spark, sf_dir), F.col("event_id") % 5 == 0, F.col("event_id") % 3 != 0
    return e.select(
        F.col("event_id").alias("label_id"), "category", F.when(point, "point").otherwise("span").alias("kind"),
        F.when(F.col("event_id") % 7 != 0, F.col("channel") % 16).alias("channel"), F.col("t").alias("t0"), F.when(~point, F.col("t") + F.col("value")).alias("t1"),
        F.when(band, F.col("value")).alias("f0"), F.when(band, F.col("value") + 50).alias("f1"),
    )


def ev_boxes(spark, sf_dir):
    return ev(spark, sf_dir).select(
        F.col("channel").alias("rec"), F.col("event_id").alias("uid"), F.col("category").alias("cls"), (F.col("event_id") % 97 / F.lit(97.0)).alias("score"),
        F.col("t").alias("t0"), (F.col("t") + 3600).alias("t1"), F.col("value").alias("f0"), (F.col("value") + 50).alias("f1"),
    )


#: The column that tells sessions of the stand-in tracks apart; every id has rows in each.
SESSION = ["session"]


def ev_tracks(spark, sf_dir):
    return ev(spark, sf_dir).select((F.col("event_id") % 3).alias("session"), F.col("event_id").alias("row"), F.when(F.col("category") != "error", F.col("channel")).alias("ident"), F.floor(F.col("t") / 3600).cast("long").alias("k"), F.col("value").alias("f"), "t")


def files(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    stamp = F.expr("timestampdiff(MICROSECOND, TIMESTAMP '1970-01-01 00:00:00', o_orderdate) / 1e6D")
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rec"), (F.row_number().over(w) - 1).cast("long").alias("part"), (F.col("o_orderkey") % 5000 + 1).alias("frames"), stamp.alias("stamp"))


def emb_samples(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), F.posexplode("embedding").alias("frame", "value")).select("rec", F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value"))
