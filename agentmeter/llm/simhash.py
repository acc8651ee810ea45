"""Near-duplicate groups by SimHash, with a pigeonring filter before the Hamming check.

A fingerprint has 64 bits; two link at two or fewer differing bits. Cut the bits
into eight segments that form a ring and go round it from a segment: for a pair
within two bits some start exists from which every chain of l consecutive segments
differs in at most l * 2/8 bits. So the first three segments agree, and the first
seven hold one difference at most, which leaves one half of segments four to seven
without any. Those forty bits, for each of eight starts and two halves, are the sixteen keys of
a fingerprint; one that meets no other under any key has no partner and needs no
further check.

The Hamming check does not form pairs either: two values are within two bits just
when one value lies within one bit of both. Survivors are therefore spread over
the values one flip away and linked to the smallest that meets them there. At most 65
fingerprints can meet at a value, so no group grows with the data, however many
near copies there are; exact copies are one fingerprint from the start.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter.llm.common import land, per_row, texts
from agentmeter.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
SEGMENTS = 8
BITS = 64 // SEGMENTS
#: Rows of hashes whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(body: bytes | None) -> int:
    """SimHash of a text in UTF-8 as a signed 64-bit integer; without words zero."""
    words = (body or b"").lower().split()
    if not words:
        return 0
    width = min(SHINGLE_WORDS, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter(
        (digest(join(w), SEED) for w in zip(*(words[i:] for i in range(width)), strict=False)),
        np.uint64,
        len(words) - width + 1,
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row; a null text has no words."""
    rows = per_row(lambda body: (fingerprint(body),), [pa.int64()])
    kind = documents.schema[key].dataType.simpleString()
    return texts(documents, key, text).mapInArrow(rows, f"`{key}` {kind}, fingerprint long")


def _turned(value: Column, by: int) -> Column:
    """``value`` rotated left, so that the segment ``by`` from the top comes first."""
    by = by * BITS % 64
    if not by:
        return value
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks() -> list[tuple[int, int]]:
    """(start, the agreeing bits as seen from there), for both halves of the second chain."""
    top = lambda first, count: ((1 << BITS * count) - 1) << 64 - BITS * (first + count)
    halves = (top(0, 3) | top(3, 2), top(0, 3) | top(5, 2))
    return [(start, half) for start in range(SEGMENTS) for half in halves]


def _rotated_back(mask: int, start: int) -> int:
    by = start * BITS % 64
    return (mask >> by | mask << 64 - by) & (1 << 64) - 1


def links(prints: DataFrame) -> DataFrame:
    """(a, b) among distinct ``fingerprint`` values: enough links to connect all within two bits."""
    value = F.col("fingerprint")
    keys = prints.select(
        "fingerprint",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(slot).cast("byte").alias("slot"),
                        _turned(value, start).bitwiseAND(F.lit(_signed(mask))).alias("chain"),
                        F.lit(_signed(_rotated_back(~mask & (1 << 64) - 1, start))).alias("free"),
                    )
                    for slot, (start, mask) in enumerate(_masks())
                )
            )
        ).alias("k"),
    ).select("fingerprint", "k.*")
    shared = (
        keys.groupBy("slot", "chain")
        .agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"))
        .where("low < high")
        .select("slot", "chain")
    )
    survivors = (
        keys.join(shared, ["slot", "chain"], "left_semi")
        .groupBy("fingerprint")
        .agg(F.bit_or("free").alias("free"))
    )
    flips = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("free", b) == 1),
        lambda b: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)),
    )
    near = survivors.select("fingerprint", F.explode(F.concat(F.array(value), flips)).alias("value"))
    met = near.groupBy("value").agg(F.collect_set("fingerprint").alias("all")).where(F.size("all") > 1)
    hub = F.array_min("all")
    return (
        met.select(hub.alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    )


def groups(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) of every row.

    component_id is the smallest key reachable over links of two or fewer differing
    bits, the row's own included. Null and empty texts have fingerprint zero and
    are linked like any other; repeated rows come back as often as they came; a null
    key takes part in linking but is never a component_id unless all are null;
    other columns are ignored; no rows give no rows.
    """
    prints = land(fingerprints(documents, key, text).withColumnRenamed(key, "key"), "fingerprints")
    distinct = land(prints.groupBy("fingerprint").agg(F.min("key").alias("first")), "distinct")
    roots = components(links(distinct.select("fingerprint")))
    rooted = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` whose key is the smallest of its group; columns as they came.

    Rows that repeat key and text count once. Rows with a null key are kept, because
    nothing tells them apart.
    """
    kept = groups(documents, key, text).where(F.col(key) == F.col("component_id")).select(key)
    first = documents.join(kept, key, "left_semi").dropDuplicates([key, text])
    return first.select(documents.columns).unionByName(documents.where(F.col(key).isNull()))
