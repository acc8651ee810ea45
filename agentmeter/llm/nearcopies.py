"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts whose SimHash fingerprints op1 links (``simhash``, by its pigeonring keys) are compared first. Whole
sets decide, so a fingerprint alone makes no two texts copies; and since at 0.8 most fingerprints
differ in more bits than op1 allows, an exact search follows for what they leave apart.

No sketch decides what that compares. Two sets within the similarity share at least one
of their first n - ceil(0.8 n) + 1 shingles, n being a set's own size, whatever order
all sets are sorted by (prefix filtering). The order here is by how many texts hold a shingle, rarest
first: a passage in many texts then is in the prefix of few, and a text that shares
little with others has a prefix of shingles of its own, which meet nothing and go no further.
How common a shingle is, is counted over all texts for the lowest part of the hashes and kept
in a table of fixed size by the end of the hash; two shingles in one place count as the more common. That
changes how many pairs are compared, not which are found.

The place of a shingle in its set's order bounds the partner as well (positional filtering): of the first
shingle that two sets share, neither has more to share than what follows it. So each shingle of a prefix
carries the largest size its set can meet there, which falls below the set's own size after a ninth of the
set. A pair needs a shingle within the first ninth of its smaller set; where no set has a shingle so
early, as in texts that share a template but differ in more than a ninth each, nobody meets.

Sets that share a shingle of their prefixes are first compared with one of them only,
then with up to eight, so a large group of near copies takes a few comparisons for each
member. What two prefixes share bounds what the sets can share; pairs within the bound are
compared by their whole sets, in integers.

Whatever that leaves apart falls into bands of sets that hang together by shared shingles, such as the
versions of one text that differ from each other in a little too much. Each band is looked at
from one of its sets: a set's difference from that one (what only one of both holds) is small, and
two sets differ from each other in just what their differences differ in. So the differences are filtered by their own
prefixes, rarest first, and cut to those before they become rows, because beside a much larger set a difference is as large as that set: two similar sets share an early part of their differences, unless both are similar to the
one set, which links them already. Versions with changes of their own in different places don't meet.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.llm import simhash
from agentmeter.llm.common import drop, land, shuffles_dropped, small_batches, tidy
from agentmeter.llm.components import components

SHINGLE_WORDS = 5
#: The least similarity, 4 / 5.
SAME, OF = 4, 5
SEED = 42
#: Part of the hashes that are counted, texts that make a shingle count as shared, and places of the table, a byte each.
COUNTED, OFTEN, PLACES = 0.6, 2, 1 << 24
#: With how many of the sets that share shingles the others are compared, in rounds before all pairs that are left.
HUBS = (1, 8)
#: Sets of a band that one copy of its chosen set is dealt to.
DEALT = 256
#: Hashes, beside the pairs they belong to, that are compared at once; or twice those of the sets, if that is more.
AT_ONCE = 1 << 24


def shingles(body: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; fewer than five words are one shingle."""
    words = (body or b"").lower().split()
    width = min(SHINGLE_WORDS, len(words))
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    count = len(words) - width + 1
    mixed = np.full(count, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + each[i : i + count]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(27)))


REGION = np.uint64(int(COUNTED * 2**64))
#: Where uncounted shingles stand among the powers of two of how many texts hold one.
UNKNOWN = 3


def _least(size: int) -> int:
    """The fewest shingles that a set of the same size must share."""
    return (SAME * size + OF - 1) // OF


def _prefix(hashes: np.ndarray, table: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set, and the largest size of a set that is similar and shares nothing earlier.

    With ``alone``, without what the table shows to be in no other text.
    """
    if not len(hashes):
        return hashes, np.zeros(0, np.int32)
    level = table[hashes & np.uint64(len(table) - 1)].astype(np.int64)
    counted = hashes < REGION
    rank = np.where(counted, 2 * level, 2 * UNKNOWN + 1)
    first = np.lexsort((hashes, rank))[: len(hashes) - _least(len(hashes)) + 1]
    most = ((SAME + OF) * (len(hashes) - np.arange(len(first))) // SAME - len(hashes)).astype(np.int32)
    kept = ~(counted & (level == 0))[first] if alone else np.ones(len(first), bool)
    return hashes[first[kept]], most[kept]


def _sets(broadcast, alone: bool = False):
    """A mapInArrow function: (key, node, size, hashes, most, fingerprint) of each text; without ``broadcast`` all hashes and the first four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, kept, bounds, prints = [], [], [], [], []
            for body in batch.column("body"):
                hashes = shingles(body.as_py())
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                if broadcast is not None:
                    hashes, most = _prefix(hashes, broadcast.value, alone)
                    bounds.append(most)
                    prints.append(simhash.fingerprint(body.as_py()))
                kept.append(hashes)
            ends = pa.array(np.cumsum([0, *map(len, kept)]).astype(np.int32))
            flat = np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)
            columns = {
                "key": batch.column("key"),
                "node": pa.array(np.array(nodes, np.uint64).view(np.int64)),
                "size": pa.array(sizes, pa.int32()),
                "hashes": pa.ListArray.from_arrays(ends, pa.array(flat)),
            }
            if broadcast is not None:
                columns["most"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*bounds, np.zeros(0, np.int32)])))
                columns["fingerprint"] = pa.array(prints, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return tidy(run)


def _shingled(rows: DataFrame, broadcast=None, alone: bool = False) -> DataFrame:
    kind = rows.schema["key"].dataType.simpleString()
    most = "" if broadcast is None else ", most array<int>, fingerprint long"
    return rows.mapInArrow(_sets(broadcast, alone), f"key {kind}, node long, size int, hashes array<long>{most}")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower halves of the counted part of each text's hashes, and how many texts of the batch hold each."""
    for batch in batches:
        low = [h[: np.searchsorted(h, REGION)] for h in (shingles(body.as_py()) for body in batch.column("body"))]
        hashes, texts = np.unique(np.concatenate([*low, np.zeros(0, np.uint64)]).astype(np.uint32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int32)), pa.array(texts.astype(np.int32))], names=["hash", "texts"])


def _table(rows: DataFrame) -> np.ndarray:
    """By place the power of two, from 1 on, of how many texts hold a shingle there; 0 where none is shared."""
    found = rows.select("body").mapInArrow(tidy(_counted), "hash int, texts int").groupBy("hash").agg(F.sum("texts").alias("texts"))
    places = found.where(F.col("texts") >= OFTEN).groupBy(F.col("hash").bitwiseAND(PLACES - 1).cast("int").alias("place"))
    levels = places.agg(F.floor(F.log2(F.max("texts"))).cast("byte").alias("level")).toArrow()
    table = np.zeros(PLACES, np.uint8)
    table[np.asarray(levels["place"])] = np.asarray(levels["level"])
    return table


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, these, those): both sets of each pair."""
    named = lambda end, hashes: sets.select(
        F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("hashes").alias(hashes)
    )
    return pairs.join(named("a", "these"), "a").join(named("b", "those"), "b")


def _whole(asked: DataFrame, prefixes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, size, hashes, ...) with all hashes of the nodes ``asked`` for, each once; landed."""
    # A key may have other texts as well. Landed, few keys are known to be few, and the texts stay where they are.
    keys = land(prefixes.join(asked, "node", "left_semi").select("key").distinct(), "keys")
    sets = land(
        _shingled(rows.join(keys, "key", "left_semi")).join(asked, "node", "left_semi").dropDuplicates(["node"]),
        "shingles",
    )
    drop(keys)
    return sets


def _compared(pairs: DataFrame, sets: DataFrame, enough: Column, name: str) -> DataFrame:
    """The (a, b) of the landed ``pairs`` that ``enough`` holds for beside their sets, landed.

    A set travels with every pair it is in. Members of a large group are in many pairs, so those are compared
    slice by slice, and what is on disk at once follows the sets.
    """
    each = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("times"))
    held = F.size("hashes").cast("long")
    total = sets.join(each, "node").agg(F.sum(held * F.col("times")).alias("asked"), F.sum(held).alias("held")).first()
    slices = -(-(total.asked or 0) // max(AT_ONCE, 2 * (total.held or 0))) or 1
    of = F.pmod(F.xxhash64("a", "b"), F.lit(slices))
    found = [land(_beside(pairs.where(of == i), sets).where(enough).select("a", "b"), name) for i in range(slices)]
    if slices == 1:
        return found[0]
    whole = land(reduce(DataFrame.union, found), name)
    drop(*found)
    return whole


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of the landed ``pairs`` whose whole sets are similar enough, landed."""
    both, sizes = F.size(F.array_intersect("these", "those")), F.col("size_a") + F.col("size_b")
    return _compared(pairs, sets, both * (SAME + OF) >= sizes * SAME, "near")


def _verified(pairs: DataFrame, prefixes: DataFrame, rows: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are similar enough, landed."""
    both, sizes = F.size(F.array_intersect("these", "those")), F.col("size_a") + F.col("size_b")
    # Of the prefix that ends first, no shingle but those in both prefixes is in the other set.
    beyond = F.expr(f"({SAME} * greatest(size_a, size_b) + {OF - 1}) div {OF} - 1")
    pairs = land(pairs.distinct(), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = land(prefixes.select("node", "size", "hashes").join(asked, "node", "left_semi"), "asked")
    near = _compared(pairs, some, (both + beyond) * (SAME + OF) >= sizes * SAME, "possible")
    drop(pairs, some)
    sets = _whole(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), prefixes, rows)
    found = _similar(near, sets)
    drop(near, sets)
    return found


def _fingerprinted(prefixes: DataFrame, rows: DataFrame) -> DataFrame:
    """The similar (a, b) among texts with one fingerprint or linked ones; of each fingerprint one text stands for all."""
    prints = prefixes.select("node", "fingerprint")
    chosen = land(prints.groupBy("fingerprint").agg(F.min("node").alias("chosen")), "chosen")
    same = prints.join(chosen, "fingerprint").where("node <> chosen").select(F.col("chosen").alias("a"), F.col("node").alias("b"))
    end = lambda name: chosen.select(F.col("fingerprint").alias(name), F.col("chosen").alias(f"{name}_node"))
    linked = simhash.links(chosen.select("fingerprint")).join(end("a"), "a").join(end("b"), "b")
    across = linked.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    found = _verified(same.union(across), prefixes, rows)
    drop(chosen)
    return found


def _parted(members: DataFrame, near: DataFrame) -> DataFrame:
    """``members`` with the root of each node."""
    root = components(near).withColumnRenamed("node", "of")
    found = members.join(root, members.node == root.of, "left")
    return land(found.select("token", "node", "size", "most", F.coalesce("root", "node").alias("root")), "parted")


def _meeting(rows: DataFrame, by: str) -> DataFrame:
    """The (token, node, size, most, ...) that can meet, at their token, a set of another ``by``.

    Some set there must be one that can meet its equals, and the others must be able to meet its size.
    """
    least = F.min(F.when(F.col("most") >= F.col("size"), F.col("size"))).alias("least")
    tokens = rows.groupBy("token").agg(F.min(by).alias("low"), F.max(by).alias("high"), least).where("low < high")
    return rows.join(tokens.select("token", "least"), "token").where("most >= least").select(rows.columns)


def _differences(rest: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each set of ``rest`` but its band's own, the hub, what it lacks of the hub; and (band, hash, ...) of what may meet; landed.

    Whatever can meet at a token is in one band. The hub is the set that meets others at the most tokens. A large
    band gets several copies of its hub, so that its sets don't all go to one task.

    In how many differences a shingle is, is counted from the sets, which hold no more in all than the input: outside the hub
    in as many as hold it, in the hub in as many as don't. Beside a much larger hub a set's difference is as large as the hub, but
    only its first shingles are ever looked at; so the hub's are put in order once, and a set keeps the first that it lacks.
    """
    first = rest.groupBy("token").agg(F.min("node").alias("a"))
    bands = components(rest.join(first, "token").select("a", F.col("node").alias("b"))).withColumnRenamed("root", "band")
    nodes = rest.groupBy("node").agg(F.min("root").alias("root"), F.count("*").alias("tokens")).join(bands, "node")
    nodes = land(nodes, "banded")
    hubs = nodes.groupBy("band").agg(
        F.max_by("node", F.struct("tokens", "node")).alias("hub"), F.count("*").alias("members"), F.ceil(F.count("*") / DEALT).cast("int").alias("parts")
    )
    hubs = land(hubs, "hubs")
    banded = nodes.join(hubs, "band").join(sets, "node")
    each = banded.select("band", "members", "root", (F.col("node") == F.col("hub")).alias("own"), F.explode("hashes").alias("hash"))
    held = each.groupBy("band", "hash").agg(
        F.max("own").alias("of_hub"), F.count("*").alias("texts"), F.min("root").alias("low"), F.max("root").alias("high"), F.first("members").alias("members")
    )
    texts = F.when(F.col("of_hub"), F.col("members") - F.col("texts")).otherwise(F.col("texts"))
    # A shingle outside the hub that one set holds, or sets of one root, only takes a place.
    held = land(held.where("of_hub OR texts > 1").select("band", "hash", "of_hub", texts.alias("texts"), "low", "high"), "held")
    order = held.where("of_hub").groupBy("band").agg(F.array_sort(F.collect_list(F.struct("texts", "hash"))).alias("ordered"))
    named = sets.select(F.col("node").alias("hub"), F.col("size").alias("hub_size"))
    copies = hubs.join(named, "hub").join(order.select("band", F.col("ordered.hash").alias("those")), "band")
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "members")
    part = F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")
    dealt = nodes.join(hubs.select("band", "parts"), "band").select("band", "node", "root", part)
    beside = dealt.join(sets.select("node", "size", "hashes"), "node").join(copies, ["band", "part"]).where("node <> hub")
    beside = beside.select("*", F.size(F.array_except("hashes", "those")).alias("more"), F.array_except("those", "hashes").alias("lacks"))
    found = beside.select(
        "band", "node", "root", "size", "hub", "hub_size", "more", (F.col("more") + F.size("lacks")).alias("n"),
        F.expr(f"slice(lacks, 1, {OF - SAME} * size div {SAME} + 1)").alias("lacks"),
    )
    found = land(found, "differences")
    drop(nodes, hubs)
    return found, held


def _candidates(apart: DataFrame, held: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of different roots whose differences from the hub may be alike enough.

    With n and m hashes in all and d and e of them in the differences, two sets are similar if the differences share at least
    (d + e - (n + m) / 9) / 2. A set that isn't similar to the hub shares something with each set that is similar to
    it. What both share first, at the places p and q, leaves at most d - p and e - q to share; so q is at most m / 4, and
    p at most n / 8 if d is the smaller.
    """
    named = apart.select("band", "node", "root", "size", "more", "n")
    more = named.join(sets.select("node", "hashes"), "node").select(*named.columns, F.explode("hashes").alias("hash"))
    more = more.join(held.where("NOT of_hub"), ["band", "hash"])
    lacks = apart.select(*named.columns, F.explode("lacks").alias("hash")).join(held.where("of_hub"), ["band", "hash"])
    node = Window.partitionBy("node")
    # What no other difference holds stands before all else.
    alone = F.col("more") - F.count_if(~F.col("of_hub")).over(node)
    placed = more.unionByName(lacks).withColumn("place", alone + F.row_number().over(node.orderBy("texts", "hash")) - 1)
    early = placed.where(f"texts > 1 AND (of_hub OR low < high) AND {SAME} * place <= {OF - SAME} * size")
    early = land(early.select("band", "hash", "node", "root", "size", "n", "place"), "early")
    small = early.where(f"{2 * SAME} * place <= {OF - SAME} * size")
    small = small.select("band", "hash", *(F.col(c).alias(f"{c}_b") for c in ("node", "root", "size", "n", "place")))
    alike = f"""root <> root_b AND (n_b < n OR n_b = n AND node_b < node) AND
        {2 * (SAME + OF)} * least(n - place, n_b - place_b) >= {SAME + OF} * (n + n_b) - {OF - SAME} * (size + size_b)"""
    pairs = small.join(early, ["band", "hash"]).where(alike)
    pairs = land(pairs.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct(), "pairs")
    drop(early)
    return pairs


def _left(rest: DataFrame, prefixes: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) that connect the sets of ``rest`` that are similar enough, by their differences from one set of each band."""
    sets = _whole(rest.select("node").distinct(), prefixes, rows)
    apart, held = _differences(rest, sets)
    to_hub = apart.where(F.col("n") * (SAME + OF) <= (F.col("size") + F.col("hub_size")) * (OF - SAME))
    pairs = _candidates(apart, held, sets)
    ends = F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    found = land(_similar(pairs, sets).union(to_hub.select(*ends)), "left")
    drop(sets, apart, held, pairs)
    return found


def _links(prefixes: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) among nodes: enough links to connect all that are similar enough; ``prefixes`` has each node once."""
    each = F.explode(F.arrays_zip("hashes", "most")).alias("one")
    tokens = prefixes.select(F.col("node"), F.col("size"), each).select(F.col("one.hashes").alias("token"), "node", "size", "one.most")
    members = _meeting(tokens.repartition("token"), "node")
    near = _fingerprinted(prefixes, rows)
    parted = _parted(members, near)
    for ways in HUBS:
        seen = F.xxhash64("node", F.pmod("token", F.lit(ways)))
        hubs = parted.groupBy("token").agg(
            F.min_by(F.struct("node", "size", "most", "root"), seen).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high")
        )
        stars = parted.join(hubs.where("low < high").select("token", "hub"), "token").where("root <> hub.root")
        ends = F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")
        more = _verified(stars.where("size <= hub.most AND hub.size <= most").select(*ends), prefixes, rows)
        near, before = land(near.union(more), "near"), parted
        parted = _parted(before.drop("root"), near)
        drop(before)
    rest = land(_meeting(parted, "root"), "rest")
    drop(parted)
    found = near.union(_left(rest, prefixes, rows))
    drop(rest)
    return found


def groups(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id) of every row with a key.

    component_id is the smallest key reachable over texts that are near copies, the row's
    own included. Words are parted by ASCII white space, A-Z count as a-z. Null, empty and
    blank texts are copies of each other; repeated rows come back as often as they came; other
    columns are ignored; no rows give no rows.
    """
    small_batches(documents.sparkSession)
    body = F.col(text).cast("string").cast("binary")
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), body.alias("body"))
    with shuffles_dropped(documents.sparkSession):
        table = documents.sparkSession.sparkContext.broadcast(_table(rows))
        prefixes = land(_shingled(rows, table, OFTEN <= 2), "prefixes")
        names = land(prefixes.select("key", "node"), "names")
        # A set of many exact copies is one node, with the smallest of their keys.
        first = prefixes.groupBy("node").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("hashes").alias("hashes"), F.first("most").alias("most"), F.min("fingerprint").alias("fingerprint"))
        first = land(first, "first")
        drop(prefixes)
        roots = components(_links(first, rows)).withColumnRenamed("node", "of")
        rooted = first.join(roots, first.node == roots.of, "left").select("node", "key", F.coalesce("root", "node").alias("root"))
        rooted = land(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("key").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    return names.join(named, "node").select(F.col("key").alias(key), "component_id")


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` whose key is the smallest of its group; columns as they came.

    Rows that repeat key and text count once. Rows with a null key are kept, because
    nothing tells them apart.
    """
    kept = groups(documents, key, text).where(F.col(key) == F.col("component_id")).select(key)
    first = documents.join(kept, key, "left_semi").dropDuplicates([key, text])
    return first.select(documents.columns).unionByName(documents.where(F.col(key).isNull()))
