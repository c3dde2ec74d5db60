"""Exact deduplication with a stateful stream (native: DataFrame functions only).

A streaming aggregation keyed by the SHA-256 digest of the normalised text keeps, per digest,
the identifier of the row that stays, where its content lies, and how many rows had it. The state lives in
RocksDB (on disk, checkpointed to the shared folder) and never expires. Each hit, a row whose
digest belongs to another row's state, is then compared byte by byte with the content the
state points to; rows that only collide are regrouped by their full text. Broadcast bitmaps of
row numbers tell the hits apart where they are read, so that no other text is moved, whatever
the size of the table.

Defined cases: a null text counts as empty; null ids never stay while another id is there;
rows repeated with the same id form one group in which all but one are dropped; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, scratch, whole_text, written

# The state store keeps its rows on disk, without setting aside disk space that it may not need.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
BLOCK_BITS = 15  # log2 of the rows of one bitmap, the size of Spark's bitmap functions
ROUND_BYTES = 64 << 20  # of the bitmaps broadcast at once: some 2^28 rows of the table


def _digested(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(ascii_lower(whole_text()).cast("binary"), 256).alias("digest"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
    )


def _globbed(path: str) -> str:
    """The same path as a pattern: a file stream takes a single file only by a pattern."""
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path


def keyed_state(spark: SparkSession, path: str, batch_bytes: int = 64 << 30) -> DataFrame:
    """Drain the table at ``path`` through the stream; return the state as a table.

    One row per digest: digest, keep_id, keep_at (file and row of the content), seen.
    ``batch_bytes`` bounds what one micro-batch reads.
    """
    schema = spark.read.parquet(path).schema
    checkpoint = scratch(spark, "exact-state")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(_globbed(path))
        state = _digested(stream).groupBy("digest").agg(
            F.max(F.struct("doc_id", "at")).alias("keeper"), F.count(F.lit(1)).alias("seen")
        )
        query = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if not any(p.get("batchId", -1) >= 0 and p["numInputRows"] > 0 for p in query.recentProgress):
            return spark.createDataFrame([], "digest string, keep_id long, keep_at struct<file:string,row:long>, seen long")
        kept = spark.read.format("statestore").load(checkpoint)
        keeper, seen = (f.name for f in kept.schema["value"].dataType.fields)
        value = F.col("value")
        return kept.select(
            F.col("key.digest").alias("digest"),
            value[keeper]["doc_id"].alias("keep_id"),
            value[keeper]["at"].alias("keep_at"),
            value[seen].alias("seen"),
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _marks(rows: DataFrame) -> DataFrame:
    """Bitmaps per file and block of 2^15 rows: ``hit``, the rows whose digest others have too, and ``kept``, those the state points to."""
    hits = rows.filter("seen > 1").select(
        F.col("at.file").alias("file"),
        F.shiftright("at.row", BLOCK_BITS).alias("block"),
        F.col("at.row").bitwiseAND((1 << BLOCK_BITS) - 1).alias("place"),
        (F.col("at") == F.col("keep_at")).alias("kept"),
    )
    # Dealt by block first: a bitmap is then made once and not once per task that has one of its rows.
    made = hits.repartition("file", "block").groupBy("file", "block").agg(
        F.bitmap_construct_agg("place").alias("hit"), F.bitmap_construct_agg(F.when(F.col("kept"), F.col("place"))).alias("kept"), F.max("place").alias("last")
    )
    used = F.shiftright("last", 3).cast("int") + 1  # small files need few of the bytes
    return made.select("file", "block", F.substring("hit", F.lit(1), used).alias("hit"), F.substring("kept", F.lit(1), used).alias("kept"))


def _bit(bitmap: str) -> Column:
    """Whether the bit of this row is set in its block's bitmap."""
    place = F.col("row").bitwiseAND((1 << BLOCK_BITS) - 1)
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1


def hit_texts(docs: DataFrame, rows: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The rows of digests that more than one row has: doc_id, text, digest, at, kept. No other row's text leaves its scan.

    The bitmaps that name them are broadcast, two bits per row of the table. Where they exceed ``round_bytes``, the files are
    dealt over rounds, one broadcast at a time; each round reads its own files only.
    """
    marks = written(_marks(rows), "exact-marks")
    size = marks.agg(F.sum(F.octet_length("hit") + F.octet_length("kept"))).first()[0] or 0
    rounds = max(1, -(-size // round_bytes))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def part(turn: int) -> DataFrame:
        here = F.pmod(F.xxhash64("file"), F.lit(rounds)) == turn
        found = docs.filter(here).withColumn("block", F.shiftright("row", BLOCK_BITS)).join(F.broadcast(marks.filter(here)), ["file", "block"]).filter(_bit("hit"))
        found = found.select("doc_id", ascii_lower(F.col("text")).alias("text"), F.struct("file", "row").alias("at"), _bit("kept").alias("kept"))
        return found.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))

    if rounds == 1:
        return part(0)
    return reduce(DataFrame.union, [written(part(turn), "exact-hits") for turn in range(rounds)])


def exact_dedup(spark: SparkSession, path: str, batch_bytes: int = 64 << 30, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    state = written(keyed_state(spark, path, batch_bytes), "exact-keepers")
    docs = spark.read.parquet(path)
    rows = written(_digested(docs).join(state, "digest"), "exact-rows")
    # Full bytes are compared on hits only. Copies meet within their task first, so that a large group moves one text per task.
    hits = hit_texts(docs, rows, round_bytes)
    others = hits.groupBy("digest", "text").agg(F.max("kept").alias("kept")).filter(~F.col("kept"))
    others = written(others.select("digest", "text"), "exact-others")
    if others.isEmpty():
        return rows.select(
            "doc_id", "keep_id", F.col("seen").alias("group_size"), (F.col("at") == F.col("keep_at")).alias("kept"), F.col("digest").alias("text_sha256")
        )
    differ = written(hits.join(others, ["digest", "text"]).select("doc_id", "digest", "text", "at"), "exact-collisions")
    own = differ.groupBy("digest", "text").agg(F.max("doc_id").alias("own_id"), F.max(F.struct("doc_id", "at")).alias("own_at"), F.count(F.lit(1)).alias("own_size"))
    moved = differ.join(own, ["digest", "text"]).select("at", "own_id", F.col("own_at.at").alias("own_at"), "own_size")
    lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    rows = rows.join(moved, "at", "left").join(lost, "digest", "left")
    return rows.select(
        "doc_id",
        F.coalesce("own_id", "keep_id").alias("keep_id"),
        F.coalesce("own_size", F.col("seen") - F.coalesce("lost", F.lit(0))).alias("group_size"),
        (F.col("at") == F.coalesce("own_at", "keep_at")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
