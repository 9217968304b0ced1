"""Exact deduplication by stateful streaming, with DataFrame operations only.

Rows are reduced to a digest of the normalised text, an identifier and a locator. A
stream over those keeps, per digest, disk-backed state (RocksDB) that never expires:
the first identifier, its locator and a count. A digest seen more than once is only a
hit; the full bytes of every hit are then compared with those of the row that stays,
and rows that differ in spite of an equal digest are grouped by their whole text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.common import WHITE_SPACE, may_hold, shared_dir, text_or_empty, with_facts, written, written_at

#: How much of the digest table one micro-batch reads at most.
BATCH_BYTES = 16 << 30
#: Repeats of a row that are made at a time.
REPEATS = 1 << 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(column: str = "text") -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), f"{WHITE_SPACE}+", " ")


def sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def _digests(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per document, digest and SHA-256, with the number of such rows and where the text lies."""
    rows = docs.select("doc_id", digest(normalised()).alias("digest"), sha256(normalised()).alias("text_sha256"), F.input_file_name().alias("locator"))
    return rows.groupBy("doc_id", "digest", "text_sha256").agg(F.count("*").alias("n"), F.min("locator").alias("locator"))


def first_seen(digests: DataFrame, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Run the stream over the digest table at ``path``: per digest the entry that stays and the number of rows.

    Null identifiers come after all others.
    """
    spark = digests.sparkSession
    out = f"{shared_dir(spark)}/first-seen-{uuid.uuid4().hex}"
    limit = {"maxFilesPerTrigger": str(files_per_batch)} if files_per_batch else {"maxBytesPerTrigger": str(BATCH_BYTES)}
    # Disk for the state is taken as it is needed, not in advance: there is one store for each partition.
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        entry = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "locator")
        state = spark.readStream.schema(digests.schema).options(**limit).parquet(path).groupBy("digest").agg(F.min(entry).alias("entry"), F.sum("n").alias("group_size"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{out}/state")
            .foreachBatch(lambda changed, epoch: changed.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, entry struct<unnamed: boolean, doc_id: long, locator: string>, group_size long, epoch int"
    changes = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/epoch=*")
    last = changes.groupBy("digest").agg(F.max_by("entry", "epoch").alias("entry"), F.max("group_size").alias("group_size"))
    return last.select("digest", F.col("entry.doc_id").alias("keep_id"), F.col("entry.locator").alias("keep_locator"), "group_size")


def _hit_texts(docs: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``doc_id, digest, body`` of all documents whose digest is a hit, and of few others.

    A bitmap of fixed size over the hits' digests, broadcast, keeps most other texts from
    being shuffled; rows that pass it by chance do no harm.
    """
    texts = docs.select("doc_id", normalised().alias("body")).withColumn("digest", digest(F.col("body")))
    return may_hold(texts, "digest", hits).filter("may_hold").select("doc_id", "digest", "body")


def _unlike(docs: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """All rows of those digests that different texts share, by comparing the full bytes of every hit.

    Minimum and maximum of the bytes are taken on the map side first, so that a group of
    copies of any size sends one text from each task.
    """
    full = _hit_texts(docs, hits, digest)
    suspects = written(full.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).filter("low <> high").select("digest"), "suspects")
    if suspects.isEmpty():
        return suspects.select(F.lit(None).cast("long").alias("doc_id"), "digest", F.lit("").alias("body"))
    return full.join(suspects, "digest", "left_semi")


def exact_groups(docs: DataFrame, files_per_batch: int | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text)``.

    Texts are equal when identical after each run of white space becomes one space;
    null counts as empty. The row with the smallest doc_id stays, null ids last; of
    fully repeated rows exactly one is kept. An empty table gives an empty one; other
    columns are ignored. ``digest`` only decides which rows are compared.
    """
    digests, path = written_at(_digests(docs, digest), "digests")
    if digests.isEmpty():
        return digests.select("doc_id", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    state = written(first_seen(digests, path, files_per_batch), "groups")
    hits = state.filter("group_size > 1").select("digest", "keep_id", "group_size")
    unlike = written(_unlike(docs, hits.select("digest"), digest), "unlike")
    marked = may_hold(digests, "digest", hits)
    single = marked.filter("not may_hold").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.col("n"))
    several = with_facts(marked.filter("may_hold"), "digest", F.col("doc_id"), hits)  # with a few single ones, which find no hit
    several = several.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", "n"))
    groups = single.unionByName(several).drop("may_hold", "locator")
    if not unlike.isEmpty():  # different texts with one digest: their rows are grouped by the whole text
        by_text = unlike.groupBy("digest", "body").agg(F.min("doc_id").alias("own_keep"), F.count("*").alias("own_size"))
        sized = by_text.select("digest", sha256(F.col("body")).alias("text_sha256"), "own_keep", "own_size")
        groups = groups.join(sized, ["digest", "text_sha256"], "left")
        groups = groups.withColumn("keep_id", F.when(F.col("own_size").isNull(), F.col("keep_id")).otherwise(F.col("own_keep"))).withColumn("group_size", F.coalesce("own_size", "group_size"))
    groups = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long"))).alias("before"))
    copy = F.explode(F.sequence(F.col("before") + 1, F.least(F.col("n"), F.col("before") + REPEATS))).alias("copy")
    return groups.select("*", copy).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, exactly one per group of equal texts, with the columns of ``docs``, whatever those are called."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, own)) | {"doc_id": "doc_id", "text": "text"}
    kept = _first_rows(docs.toDF(*[names[c] for c in docs.columns]))
    return kept.toDF(*docs.columns)


def _first_rows(docs: DataFrame) -> DataFrame:
    # A row goes at once unless a bitmap says that a row of its identifier and digest may be dropped or repeated; only
    # those are shuffled. There may be several rows with the identifier that stays: where it is null or a row is repeated.
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__digest")
    groups = exact_groups(docs).groupBy("doc_id", F.col("text_sha256").alias("__digest")).agg(F.count("*").alias("__n"), F.bool_or("kept").alias("__kept"))
    doubted = written(groups.filter("__n > 1 or not __kept").withColumn("__key", key), "doubted")
    rows = may_hold(docs.withColumn("__digest", sha256(normalised())).withColumn("__key", key), "__key", doubted)
    sure, others = rows.filter("not may_hold"), rows.filter("may_hold")
    one = sure.unionByName(others.join(doubted.select("__key"), "__key", "left_anti"))
    several = doubted.filter("__kept and __n > 1").select("__key")
    if not several.isEmpty():
        one = one.unionByName(others.join(several, "__key", "left_semi").dropDuplicates(["__digest"]))
    return one.drop("__digest", "__key", "may_hold")
