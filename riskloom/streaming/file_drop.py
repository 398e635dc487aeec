"""Documents that arrive over time: the upload path as a stream of files.

Each micro-batch runs the batch operators (type detection, content hash, chunking) and writes its
own partition, so a batch that is replayed after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.chunk import chunk_documents
from riskloom.operators.classify import detect_type
from riskloom.operators.ingest import chunk_rows, loadable_chunks
from riskloom.sources.files import content_hash, file_name


def arriving_documents(files: DataFrame) -> DataFrame:
    """(document_id, file_name, document_type, content_hash, text) of whole text files."""
    name = file_name(F.col("path"))
    return files.select(
        F.concat(F.lit("doc-"), F.substring(F.sha2("path", 256), 1, 24)).alias("document_id"), name.alias("file_name"),
        detect_type(name, F.col("text")).alias("document_type"), content_hash(F.col("text")).alias("content_hash"), "text")


def ingest_folder(spark: SparkSession, folder: str, target: str, checkpoint: str, available_now: bool = True,
                  skip_known: bool = True) -> StreamingQuery:
    """Streams text files from ``folder`` into ``target``/documents and ``target``/chunks.

    With ``skip_known`` a content is one document for as long as the stream lives: the hashes seen are keyed state, kept in
    ``checkpoint`` over batches and restarts, and of equal files the first batch's is taken (of one batch, any). State grows by a
    hash per content; set Spark's RocksDB state store provider where there are many. The choice is part of the checkpoint.
    """
    files = (spark.readStream.schema("value string").option("wholetext", "true").text(folder)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    if skip_known:
        files = files.withColumn("content_hash", content_hash(F.col("text"))).dropDuplicates(["content_hash"]).drop("content_hash")

    def write(batch: DataFrame, batch_id: int) -> None:
        documents = arriving_documents(batch)
        documents.drop("text").write.mode("overwrite").parquet(f"{target}/documents/batch={batch_id}")
        chunks = chunk_rows(chunk_documents(documents.select("document_id", "document_type", "text")))
        loadable_chunks(chunks).write.mode("overwrite").parquet(f"{target}/chunks/batch={batch_id}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
