"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of UTF-8 bytes.

Each language has a model of n-grams of its texts' bytes, trained on all trusted text. ASCII letters
lose their case, digits are one sign and so are blanks and controls; every byte of a character beyond
ASCII is a sign of its own, so letters of any script are told apart. Every split counts its n-grams
first and Spark adds up the counts; adjusted counts, discounts and interpolation weights are joins
and aggregates over those tables, keyed by context.

Scoring is joins as well. The n-grams of all documents are counted and joined, order by order, with
the shards of the model, which gives the bits each takes. The documents are dealt out by hash into
blocks of about ``BLOCK_BYTES``; a block's different n-grams are joined with their bits, and the two
meet again by block. So a task holds a block and its n-grams, and neither
model nor counts pass through the driver.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from agentmeter.llm.common import bodies, closed, land, opened, small_batches, tidy, trim

#: Boundary, blank, 26 letters, digit, 32 ASCII signs and 128 bytes of characters beyond ASCII.
CLASSES = 189
ORDER = 4
#: Contexts of one shard of the model.
SHARD_CONTEXTS = 1 << 16
#: Text that is scored together.
BLOCK_BYTES = 16 << 20
#: Trusted ids up to this number are broadcast, eight bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1 << 22
#: Bytes whose n-grams are worked out at once.
BLOCK = 1 << 19
#: Share of a language's trusted documents that stay under its threshold.
QUANTILE = 0.998
ACCURACY = 10_000
#: Sums in another order differ by less.
ROUNDING = 1e-9
#: One in so many trusted documents is kept from training, to set the thresholds by.
HELD_OUT = 5
#: Signs of average text that every document's perplexity takes in besides its own.
PRIOR_SIGNS = 100
BOUNDARY, BLANK, DIGIT = 0, 1, 28


def _sign_of() -> np.ndarray:
    """Sign by byte."""
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    out = np.full(256, BLANK, np.uint8)
    for byte in range(33, 256):
        letter = chr(byte).lower()
        if byte >= 128:
            out[byte] = 61 + byte - 128
        elif letter.isalpha():
            out[byte] = 2 + ord(letter) - ord("a")
        elif letter.isdigit():
            out[byte] = DIGIT
        elif byte in signs:
            out[byte] = 29 + signs.index(byte)
    return out


_SIGN_OF = _sign_of()


def classes(body: bytes) -> np.ndarray:
    """The signs of a text in UTF-8, one for each byte."""
    return _SIGN_OF[np.frombuffer(body, np.uint8)]


def _grams_of(parts: list[np.ndarray]) -> np.ndarray:
    """The n-gram that ends at each sign of texts in a row, as a number.

    Boundary signs stand before each text; the n-grams that end in one mean nothing.
    """
    pad = np.zeros(ORDER - 1, np.uint16)
    signs = np.concatenate([x for part in parts for x in (pad, part)]).astype(np.int64)
    grams = signs[: len(signs) - ORDER + 1].copy()
    for k in range(1, ORDER):
        grams *= CLASSES
        grams += signs[k : len(signs) - ORDER + 1 + k]
    return grams


def _blocks(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, list[bytes]]]:
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, body in rows:
        held.setdefault(lang, []).append(body)
        size[lang] = size.get(lang, 0) + len(body)
        if size[lang] >= BLOCK:
            yield lang, held.pop(lang)
            size[lang] = 0
    yield from held.items()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a split."""
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    rows = (
        (lang.as_py(), body.as_py())
        for batch in batches
        for lang, body in zip(batch.column("lang"), batch.column("body"), strict=True)
    )
    for lang, block in _blocks(rows):
        grams, counts = np.unique(_grams_of([classes(body) for body in block]), return_counts=True)
        # What runs over from one text into the next ends in a boundary sign.
        real = grams % CLASSES != BOUNDARY
        grams, counts = grams[real], counts[real]
        if lang in totals:
            old, n = totals[lang]
            both = np.concatenate((old, grams))
            grams, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, np.concatenate((n, counts))).astype(np.int64)
        totals[lang] = grams, counts
    for lang, (grams, counts) in totals.items():
        for at in range(0, len(grams), 1 << 16):
            part = grams[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(part), pa.string()),
                    pa.array(part, pa.int64()),
                    pa.array(counts[at : at + (1 << 16)], pa.int64()),
                ],
                names=["lang", "gram", "n"],
            )


def trusted_ids(labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    return labels.where(F.col(quality) == 1).select(key).where(F.col(key).isNotNull()).distinct()


def count_grams(trusted: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all of ``trusted``; a null language is the language ''."""
    small_batches(trusted.sparkSession)
    rows = trusted.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.col(text).cast("string").cast("binary").alias("body"),
    )
    counted = rows.mapInArrow(tidy(_count), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the three discounts from how many n-grams occur one to four times."""
    n = counts.groupBy("lang").agg(
        *(F.sum((F.col("n") == k).cast("long")).cast("double").alias(f"n{k}") for k in range(1, 5))
    )
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        d = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        # Too few n-grams to estimate from: the plain absolute discounts.
        fair = d.isNotNull() & (d > 0) & (d <= k)
        return F.when(fair, d).otherwise(F.lit({1: 0.5, 2: 0.75, 3: 0.9}[k]))

    n = n.withColumn("n1", F.greatest("n1", F.lit(1e-9)))
    return n.select("lang", *(discount(k).alias(f"d{k}") for k in (1, 2, 3)))


def _level(grams: DataFrame) -> DataFrame:
    """(lang, context, seen, weight) from the counts of one order.

    seen maps the signs that follow a context to their discounted shares; weight is what
    the context leaves to the next lower order.
    """
    keyed = grams.select(
        "lang",
        F.floor(F.col("gram") / CLASSES).alias("context"),
        (F.col("gram") % CLASSES).cast("int").alias("sign"),
        "n",
    )
    cut = keyed.join(_discounts(keyed), "lang").withColumn(
        "d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    )
    # A context is followed by fewer than ``CLASSES`` signs, so no group is larger.
    row = cut.groupBy("lang", "context").agg(
        F.map_from_entries(F.collect_list(F.struct("sign", F.col("n") - F.col("d")))).alias("kept"),
        F.sum("n").alias("total"),
        F.sum("d").alias("left"),
    )
    share = F.transform_values("kept", lambda _, n: n / F.col("total"))
    return row.select("lang", "context", share.alias("seen"), (F.col("left") / F.col("total")).alias("weight"))


def train(trusted: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, size, context, logs): log2 probability of all signs after each context seen.

    size is the number of signs in the context, ``ORDER`` - 1 down to 0: a longer
    context that was not seen is predicted from the longest end of it that was. Below
    the highest order an n-gram counts once for each different sign before it.

    The rows are worked out when they are read. What they follow from is landed and much smaller, and
    scoring needs no more: ``levels`` of the result, see ``_level``.
    """
    grams = land(count_grams(trusted, text, lang), "grams")
    orders = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):
        ends = (F.col("gram") % CLASSES**order).alias("gram")
        orders[order] = orders[order + 1].groupBy("lang", ends).agg(F.count("*").alias("n"))
    levels, tables = None, []
    for order in range(1, ORDER + 1):
        rows = _level(orders[order]).select("lang", F.lit(order - 1).alias("size"), "context", "seen", "weight")
        level = land(rows, "level")
        levels = levels.unionByName(level) if levels else level
        signs = F.sequence(F.lit(0), F.lit(CLASSES - 1))
        seen = lambda s: F.coalesce(F.try_element_at("seen", s), F.lit(0.0))
        if order == 1:
            p = F.transform(signs, lambda s: seen(s) + F.col("weight") / CLASSES)
        else:
            lower = tables[-1].select("lang", F.col("context").alias("ending"), F.col("p").alias("q"))
            ending = (F.col("context") % CLASSES ** (order - 2)).alias("ending")
            level = level.select("*", ending).join(lower, ["lang", "ending"])
            p = F.transform(signs, lambda s: seen(s) + F.col("weight") * F.element_at("q", s + 1))
        tables.append(level.select("lang", "size", "context", p.alias("p")))
    model = tables[0]
    for rows in tables[1:]:
        model = model.unionByName(rows)
    logs = F.transform("p", lambda p: F.log2(p).cast("float"))
    model = model.select("lang", "size", "context", logs.alias("logs"))
    model.levels = levels
    return model


def shards(model: DataFrame) -> list[DataFrame]:
    """The levels of the model in landed tables of ``SHARD_CONTEXTS`` contexts or so."""
    rows = model.levels
    count = -(-rows.count() // SHARD_CONTEXTS)
    number = F.pmod(F.xxhash64("lang", "size", "context"), F.lit(count))
    return [land(rows.where(number == k), "shard") for k in range(count)]


def _costs(grams: DataFrame, model: list[DataFrame]) -> DataFrame:
    """(lang, gram, bits) of all n-grams whose language has a model.

    Each order's different n-grams meet the level of their contexts and the probabilities of their
    ends; at most ``CLASSES`` share a context or an end, so no key has many rows.
    """
    levels = grams.sparkSession.read.schema(model[0].schema).parquet(*(shard.landed_at for shard in model))
    found = None
    for order in range(1, ORDER + 1):
        rows = grams.select("lang", (F.col("gram") % CLASSES**order).alias("gram")).distinct()
        rows = rows.select(
            "*",
            F.floor(F.col("gram") / CLASSES).alias("context"),
            (F.col("gram") % CLASSES).cast("int").alias("sign"),
            (F.col("gram") % CLASSES ** (order - 1)).alias("ending"),
        )
        level = levels.where(F.col("size") == order - 1).drop("size")
        share = F.coalesce(F.try_element_at("seen", "sign"), F.lit(0.0))
        if found is None:
            rows = rows.join(level, ["lang", "context"])
            p = share + F.col("weight") / CLASSES
        else:
            lower = found.select("lang", F.col("gram").alias("ending"), F.col("p").alias("q"))
            rows = rows.join(level, ["lang", "context"], "left").join(lower, ["lang", "ending"])
            p = F.when(F.col("weight").isNull(), F.col("q")).otherwise(share + F.col("weight") * F.col("q"))
        found = rows.select("lang", "gram", p.alias("p"))
    return found.select("lang", "gram", (-F.log2("p")).cast("float").alias("bits"))


def _by_language(table: pa.Table) -> dict[str, list[int]]:
    members: dict[str, list[int]] = {}
    for i, lang in enumerate(table.column("lang").to_pylist()):
        members.setdefault(lang, []).append(i)
    return members


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way to their block; size is a text's own length."""
    codec = pa.Codec("zstd")
    for batch in batches:
        body_of = bodies(batch)
        size = [len(x or b"") for x in body_of]
        packed = [codec.compress(x, asbytes=True) if x else x for x in body_of]
        columns = {"body": pa.array(packed, pa.binary()), "size": pa.array(size, pa.int64())}
        names = [*batch.schema.names, "size"]
        yield pa.RecordBatch.from_arrays([columns[c] if c in columns else batch.column(c) for c in names], names=names)


def _spread(table: pa.Table) -> list[bytes | None]:
    pairs = zip(table.column("body").to_pylist(), table.column("size").to_pylist(), strict=True)
    return [pa.decompress(x, n, "zstd", asbytes=True) if n else x for x, n in pairs]


def _grams_of_block(table: pa.Table) -> pa.Table:
    """(block, lang, gram): the different n-grams of a block's documents."""
    trim(keep=False)
    rows = pa.table({"lang": table.column("lang"), "body": pa.array(_spread(table), pa.binary())})
    rows = rows.filter(rows.column("body").is_valid())
    found = pa.Table.from_batches(_count(iter(rows.to_batches())), _COUNTED).drop_columns("n")
    block = pa.array(np.full(len(found), table.column("block")[0].as_py()), pa.int64())
    return found.add_column(0, "block", block)


_COUNTED = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _score_block(table: pa.Table, costs: pa.Table) -> pa.Table:
    """(row, body, lang, bits, signs) of a block's documents from what their n-grams cost."""
    trim(keep=False)
    bits, signs = np.zeros(len(table)), np.zeros(len(table), np.int64)
    body_of = _spread(table)
    priced = _by_language(costs)
    known, cost = costs.column("gram").to_numpy(), costs.column("bits").to_numpy()
    for lang, members in _by_language(table).items():
        mine = np.array(priced.get(lang, []), np.int64)
        mine = mine[np.argsort(known[mine])]
        grams, price = known[mine], cost[mine]
        for block in _whole((str(i), body_of[i] or b"") for i in members):
            where = [int(i) for i, _ in block]
            bits[where], signs[where] = _block_bits([classes(body) for _, body in block], grams, price)
    text = pa.array(body_of, pa.binary()).view(pa.string())
    return pa.table(
        {
            "row": table.column("row"),
            "body": text,
            "lang": table.column("lang"),
            "bits": pa.array(bits),
            "signs": pa.array(signs),
        }
    )


def _whole(rows: Iterator[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _block_bits(parts: list[np.ndarray], known: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits that the bytes of each text take, none without a model; and their number."""
    counts = np.array([len(p) for p in parts], np.int64)
    grams, place = np.unique(_grams_of(parts), return_inverse=True)
    # What runs over from one text into the next ends in a boundary sign and has no price.
    cost = np.zeros(len(grams))
    at = np.searchsorted(known, grams)
    met = at < len(known)
    met[met] = known[at[met]] == grams[met]
    cost[met] = price[at[met]]
    ends = np.cumsum(counts + ORDER - 1) - (ORDER - 1)
    total = np.concatenate(([0.0], np.cumsum(cost[place], dtype=np.float64)))
    return total[ends] - total[ends - counts], counts


def _scored(documents: DataFrame, model: list[DataFrame], text: str, lang: str) -> DataFrame:
    """(row, body, lang, bits, signs) of every document; no bits without a model."""
    language = documents.columns.index(lang)
    out = opened(documents, text).select(
        "row", "body", F.coalesce(F.col("row")[f"c{language}"].cast("string"), F.lit("")).alias("lang")
    )
    if not model:
        return out.select("*", F.lit(0.0).alias("bits"), F.lit(0).cast("long").alias("signs"))
    counted = land(count_grams(documents, text, lang), "grams")
    costs = land(_costs(counted, model), "costs")
    # Every n-gram counted is a byte. Copies differ in their ids, so that they don't fill one block.
    size = counted.agg(F.sum("n")).first()[0] or 0
    fields = out.schema["row"].dataType.fields
    plain = [F.col("row")[f.name] for f in fields if not re.search("map<|variant", f.dataType.simpleString())]
    block = F.pmod(F.xxhash64(*plain, "body"), F.lit(-(-size // BLOCK_BYTES) or 1))
    dealt = out.select("*", block.alias("block"))
    squeezed = StructType([f if f.name != "body" else StructField("body", BinaryType()) for f in dealt.schema]).add("size", "long")
    blocks = dealt.mapInArrow(tidy(_squeezed), squeezed).groupBy("block")
    grams = blocks.applyInArrow(_grams_of_block, "block long, lang string, gram long")
    priced = grams.join(costs, ["lang", "gram"]).groupBy("block")
    schema = StructType([*out.schema, *StructType().add("bits", "double").add("signs", "long")])
    return blocks.cogroup(priced).applyInArrow(_score_block, schema)


def _perplexity() -> Column:
    """2 to the bits a sign takes, drawn towards the language's own mean as by ``PRIOR_SIGNS`` more signs.

    Few signs say little about a text. Null without signs or model.
    """
    prior = F.when(F.col("mean").isNotNull(), PRIOR_SIGNS).otherwise(0)
    bits = F.col("bits") + prior * F.coalesce("mean", F.lit(0.0))
    return F.when(F.col("bits") > 0, F.pow(F.lit(2.0), bits / (F.col("signs") + prior)))


def _trusted(documents: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows of ``documents`` with a trusted label; ids are broadcast only if they are few."""
    ids = land(trusted_ids(labels, key), "trusted")
    few = ids.count() <= BROADCAST_IDS
    return documents.join(F.broadcast(ids) if few else ids, key, "left_semi")


@dataclass
class Classifier:
    model: list
    thresholds: DataFrame

    def score(self, documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
        """(row, body, perplexity, threshold, accepted) of every document; see ``common.opened``.

        A document without characters has no perplexity, one of a language without trusted
        text no threshold; both are accepted, because nothing speaks against them.
        """
        scored = _scored(documents, self.model, text, lang)
        return scored.join(F.broadcast(self.thresholds), "lang", "left").select(
            "row",
            "body",
            _perplexity().alias("perplexity"),
            "threshold",
            F.coalesce(_perplexity() <= F.col("threshold") * (1 + ROUNDING), F.lit(True)).alias("accepted"),
        )


def fit(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quantile: float = QUANTILE,
) -> Classifier:
    """Model and thresholds from the documents that ``labels`` marks with quality 1.

    Labels without a document, null ids and null texts have no part in it; a label that is repeated counts
    once. A language's threshold is the ``quantile`` of the perplexity of its held-out trusted
    documents.
    """
    trusted = _trusted(documents.select(key, text, lang), labels, key)
    # Text that a model has seen takes fewer bits than new text of the same kind.
    part = F.pmod(F.xxhash64(key), F.lit(HELD_OUT))
    model = shards(train(trusted.where(part > 0), text, lang))
    scored = land(_scored(trusted.where(part == 0), model, text, lang).select("lang", "bits", "signs"), "scored")
    means = land(scored.groupBy("lang").agg(F.try_divide(F.sum("bits"), F.sum("signs")).alias("mean")), "means")
    quantiles = (
        scored.join(F.broadcast(means), "lang")
        .groupBy("lang")
        .agg(F.percentile_approx(_perplexity(), quantile, ACCURACY).alias("threshold"))
    )
    return Classifier(model, land(means.join(quantiles, "lang"), "thresholds"))


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, perplexity, threshold, accepted) of every row of ``documents``; see ``Classifier.score``."""
    slim = documents.select(key, text, lang)
    found = fit(slim, labels, key, text, lang).score(slim, text, lang)
    return found.select(closed(slim, text)[0], "perplexity", "threshold", "accepted")


def accepted(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The accepted rows of ``documents``; columns as they came."""
    found = fit(documents, labels, key, text, lang).score(documents, text, lang)
    return found.where("accepted").select(*closed(documents, text))
