"""Token counts of documents in flat token files, by a scan for the separator.

A token file is nothing but 16-bit ids, each document followed by the end-of-document id;
there is no index. Files are scanned in blocks of fixed size. A block finds its separators
at once and reports their places; documents that run over from block to block are put
together by a prefix scan over the blocks of a file: the last separator before a block
is a running maximum, and the number of documents before it a running sum.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentmeter.llm import tokens
from agentmeter.llm.common import small_batches
from agentmeter.session import scratch_path

END_ID = 49407
WIDTH = 2
BLOCK_BYTES = 1 << 20


def _tokenizer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, WIDTH, plain=True).encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([encode(body.as_py()) for body in batch.column("body")], pa.binary())], names=["ids"]
            )

    return run


def write(documents: DataFrame, path: str, text: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write the documents of each split, in order, to one flat token file.

    Null and empty texts are documents without tokens. The line end of Spark's text files
    serves as the separator.
    """
    small_batches(documents.sparkSession)
    bodies = documents.select(F.col(text).cast("string").cast("binary").alias("body"))
    (
        bodies.mapInArrow(_tokenizer(vocabulary or tokens.default_path()), "ids binary")
        .select(F.col("ids").cast("string"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", end_id.to_bytes(WIDTH, "little").decode("latin-1"))
        .text(path)
    )


def _scan(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data"), strict=True):
                ids = np.frombuffer(data.as_py(), "<u2")
                at = np.flatnonzero(ids == end_id)
                first = start // WIDTH
                found.append(
                    (
                        len(ids),
                        int(at[0]) + first if len(at) else None,
                        int(at[-1]) + first if len(at) else None,
                        (np.diff(at) - 1).tolist(),
                    )
                )
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("file"),
                    batch.column("start"),
                    *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)),
                ],
                names=["file", "start", "ids", "first", "last", "inner"],
            )

    return run


def scan(spark: SparkSession, path: str, end_id: int = END_ID, block: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in the token files under ``path``.

    Tokens after the last separator of a file are a document that hasn't ended. A file's length must be a
    multiple of two bytes; Spark reads files of up to 2 GB.
    """
    if block % WIDTH:
        raise ValueError("a block must hold whole ids")
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))
    cut = F.transform(
        starts,
        lambda at: F.struct(
            at.alias("start"), F.substring(F.col("content"), (at + 1).cast("int"), F.lit(block)).alias("data")
        ),
    )
    even = F.when(F.col("length") % WIDTH == 0, cut).otherwise(F.raise_error(F.lit("a token file ends within an id")))
    blocks = files.select(F.col("path").alias("file"), F.explode(even).alias("b")).select("file", "b.*")
    seen = blocks.mapInArrow(
        _scan(end_id), "file string, start long, ids long, first long, last long, inner array<long>"
    )
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    found = F.when(F.col("first").isNotNull(), F.size("inner") + 1).otherwise(0)
    stitched = seen.select(
        "*",
        F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("before"),
        F.coalesce(F.sum(found).over(earlier), F.lit(0)).alias("documents"),
        (F.lead("start").over(Window.partitionBy("file").orderBy("start")).isNull()).alias("final"),
    )
    lengths = F.when(
        F.col("first").isNotNull(), F.concat(F.array(F.col("first") - F.col("before") - 1), F.col("inner"))
    ).otherwise(F.array().cast("array<long>"))
    end = F.col("start") / WIDTH + F.col("ids")
    open_tokens = (end - F.greatest("before", F.coalesce("last", F.lit(-1))) - 1).cast("long")
    tail = F.when(F.col("final") & (open_tokens > 0), F.array(open_tokens)).otherwise(F.array().cast("array<long>"))
    return stitched.select(
        "file", "documents", F.size(lengths).alias("ended"), F.posexplode(F.concat(lengths, tail)).alias("k", "n_tokens")
    ).select("file", (F.col("documents") + F.col("k")).alias("ordinal"), "n_tokens", (F.col("k") < F.col("ended")).alias("ended"))


def counts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of every row of ``documents``, by way of token files.

    ``documents`` is a table in files: a document's place in the token files is its place in
    the table's splits, which are the same whenever it is read. A document that isn't found in its
    place ends the job. Nulls, repeated rows and extra columns are of no account.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "tokens")
    write(documents, path, text)
    place = F.monotonically_increasing_id()
    listed = documents.select(
        F.col(key).alias("key"), F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal")
    )
    part = F.regexp_extract("file", r"/part-(\d+)-[^/]*$", 1).cast("long").alias("part")
    found = scan(spark, path).select(part, "ordinal", "n_tokens")
    missing = F.raise_error(F.lit("a document isn't where its split has it"))
    return listed.join(found, ["part", "ordinal"], "left").select(
        F.col("key").alias(key), F.coalesce("n_tokens", missing.cast("long")).alias("n_tokens")
    )
