"""Streaming queries: the tables read as streams, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.music import KEY_NAMES
from ..operators.learn import Engines
from ..plans.guards import scratch_folder
from ..streaming import frames, ingest
from .registry import STYLES, query, table

STREAMED = """w AS (SELECT user_id, event_id AS frame_idx, event_type AS style, value AS score, row_number() OVER u - 1 AS i FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, style ORDER BY i) AS grp FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, style, grp ORDER BY i) AS run FROM g),
held AS (SELECT user_id, i, frame_idx, style FROM r WHERE i = 0 UNION ALL
 SELECT h.user_id, r.i, r.frame_idx, CASE WHEN r.style = h.style THEN h.style WHEN r.run >= 2 AND r.score >= 0.08 THEN r.style ELSE h.style END FROM held h JOIN r ON r.user_id = h.user_id AND r.i = h.i + 1)"""


def _stream(spark, d, name):
    """One table as a file stream, be it a lone file or a folder of part files."""
    reader, path = spark.readStream.schema(table(spark, d, name).schema), f"{d}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    return reader.parquet(path) if status.isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query(f"WITH RECURSIVE {STREAMED} SELECT user_id, frame_idx, style FROM held")
def frame_stream(spark, d):
    """Events as a stream of one-style frames, labelled with state per track as they arrive (R2)."""
    stream = _stream(spark, d, "events")
    top = F.array(F.struct(F.col("event_type").alias("style"), F.col("value").alias("score")))
    labelled = frames.label_stream(stream.select("user_id", F.col("event_id").alias("frame_idx"), top.alias("top")), "user_id")
    out = f"{scratch_folder(spark)}/frames-{uuid.uuid4().hex}"
    run = labelled.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("user_id long, frame_idx long, style string, late boolean").parquet(f"{out}/rows")
    return rows.where("not late").drop("late")


@query(
    """WITH RECURSIVE seen AS (SELECT *, (epoch_us(ts) + 999) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) AS passed FROM events),
"""
    + STREAMED.replace("FROM events WINDOW", "FROM seen WHERE passed WINDOW")
    + " SELECT user_id, frame_idx, style FROM held"
)
def frame_stream_timed(spark, d):
    """The same frames by event time: each waits in map state until a watermark of an hour has passed it (R2)."""
    top = F.array(F.struct(F.col("event_type").alias("style"), F.col("value").alias("score")))
    stream = _stream(spark, d, "events").select("user_id", F.col("event_id").alias("frame_idx"), "ts", top.alias("top"))
    out = f"{scratch_folder(spark)}/timed-{uuid.uuid4().hex}"
    labelled = frames.label_timed(stream, "user_id", "ts", delay="1 hour")
    labelled.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").outputMode("append").trigger(
        availableNow=True
    ).start().awaitTermination()
    rows = spark.read.schema("user_id long, frame_idx long, style string, late boolean").parquet(f"{out}/rows")
    return rows.where("not late").drop("late")


def _byte_engines(styles: list[str]) -> Engines:
    """Features measured on the bytes themselves: how many fall to each style, their sum, their number."""

    def genre(content: bytes) -> list:
        counts = [0] * 256
        for b in content:
            counts[b] += 1
        shares = [(s, sum(counts[i :: len(styles)]) / max(len(content), 1)) for i, s in enumerate(styles)]
        return sorted(shares, key=lambda x: -x[1])

    return Engines(
        genre=genre, tempo=lambda c: 60.0 + sum(c) % 120, key=lambda c: (KEY_NAMES[sum(c) % 12], "minor" if len(c) % 2 else "major"),
        duration=lambda c: len(c) / 4.0,
    )


def _ingested(spark, d):
    """The store after documents were streamed in as files, twice over."""
    path = F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".mp3"))
    out = f"{scratch_folder(spark)}/ingest-{uuid.uuid4().hex}"
    for attempt in ("a", "b"):  # the second run starts over from nothing and must add nothing
        stream = _stream(spark, d, "documents")
        files = stream.select(path.alias("path"), F.encode("text", "utf-8").alias("content"))
        ingest.run_ingest(files, f"{out}/store", f"{out}/log-{attempt}", _byte_engines(sorted(STYLES.values())), minimum=50.0).awaitTermination()
    return f"{out}/store"


_STYLES = sorted(STYLES.values())
_NAMES = ", ".join("'" + n + "'" for n in KEY_NAMES)
BYTES = f"""f AS (SELECT sha1(text) AS hash, min('d/' || lpad(doc_id::VARCHAR, 9, '0') || '.mp3') AS path, any_value(text) AS text FROM documents WHERE strlen(text) / 4.0 >= 50 GROUP BY 1),
h AS (SELECT hash, path, strlen(text) AS n, hex(encode(text)) AS x FROM f),
b AS (SELECT hash, path, n, list_transform(range(n), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::INT) AS b FROM h),
c AS (SELECT hash, path, n, list_sum(b)::BIGINT AS total, list_transform(range({len(_STYLES)}), lambda r: len(list_filter(b, lambda v: v % {len(_STYLES)} = r))) AS k FROM b)"""


@query(f"""WITH {BYTES} SELECT hash, path, n / 4.0 AS duration, (60 + total % 120)::DOUBLE AS bpm, [{_NAMES}][(total % 12 + 1)::INT] AS key, CASE WHEN n % 2 = 1 THEN 'minor' ELSE 'major' END AS scale,
{_STYLES}[list_position(k, list_max(k))] AS style, round(list_max(k) / n, 6) AS score FROM c""")
def ingest_documents(spark, d):
    """Documents as a stream of files: hashed, deduplicated, measured, gated by length and committed batch by batch; run twice."""
    top = F.col("styles")[0]
    return ingest.read_store(spark, _ingested(spark, d)).select(
        "hash", "path", "duration", "bpm", "key", "scale", top["style"].alias("style"), F.round(top["score"], 6).alias("score")
    )


@query("""WITH f AS (SELECT DISTINCT sha1(text) AS hash, strlen(text) / 4.0 AS duration FROM documents)
SELECT CASE WHEN duration < 50 THEN 'short' ELSE 'ok' END AS status, count(*) AS files, round(sum(duration), 2)::DOUBLE AS seconds FROM f GROUP BY 1""")
def ingest_report(spark, d):
    """Totals of that ingest: files stored and files left out as short."""
    return ingest.ingest_report(spark, _ingested(spark, d))
