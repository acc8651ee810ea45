"""Rollout tool volume: calls and results of one session, by call id."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter import model
from agentmeter.functions.content import measure_codex, measure_codex_text
from agentmeter.functions.names import codex_mcp_server, codex_tool_name
from agentmeter.operators import ancestry
from agentmeter.session import landed
from agentmeter.sources.rollouts import field_text, typed_fields


_TEXTS = ("type", "call_id", "name", "namespace")


#: What makes a joined figure ambiguous; in this order bits of ``taint``.
TAINTS = ("conflicting_copies", "type_mismatch", "conflicting_ancestry", "cyclic_ancestry", "inherited_call")
FIGURES = ("calls", "context_bytes", "image_bytes", "image_results", "uses", "unanswered", "unmatched")
KNOWN = ("text_known", "image_known", "images_known")


def items(scoped: DataFrame) -> DataFrame:
    """``response_item`` records with the class each falls into.

    kind: call, result, ignored, unsupported or malformed; a field of another type than text is malformed. Payload
    bodies are measured and digested here and go no further.
    """
    read = (
        scoped.filter("status = 'ok' and type = 'response_item'")
        .withColumn("v", typed_fields(F.col("payload"), *_TEXTS, "output"))
        .withColumn("plain", F.from_json("payload", ", ".join(f"{n} STRING" for n in (*_TEXTS, "output"))))
    )
    text = lambda n: F.coalesce(field_text(F.col(f"v.{n}")), F.lit(""))
    # A field that isn't null as text but no string is of a wrong type, or holds a repeated key.
    wrong = F.lit(False)
    for n in _TEXTS:
        wrong = wrong | (field_text(F.col(f"v.{n}")).isNull() & F.col(f"plain.{n}").isNotNull())
    item, call_id, name, namespace = (text(n) for n in _TEXTS)
    is_call = item.isin(*model.CODEX_CALL_TYPES)
    is_result = item.isin(*model.CODEX_RESULT_TYPES)
    kind = (
        F.when(F.get_json_object("payload", "$").isNull() | wrong, F.lit("malformed"))
        .when(item.isin(*model.CODEX_IGNORED_TYPES), F.lit("ignored"))
        .when(~is_call & ~is_result, F.lit("unsupported"))
        .when((call_id == "") | (is_call & (name == "")), F.lit("malformed"))
        .when(is_call, F.lit("call"))
        .otherwise(F.lit("result"))
    )
    # An output in which a key is repeated is read as content blocks straight from its text.
    lost = F.col("v.output").isNull() & F.col("plain.output").isNotNull()
    size = F.when(lost, measure_codex_text(F.col("plain.output"))).otherwise(measure_codex(F.col("v.output")))
    return read.select(
        "chunk",
        "pos",
        "session",
        "ts",
        kind.alias("kind"),
        item.alias("item_type"),
        call_id.alias("call_id"),
        codex_tool_name(namespace, name).alias("tool"),
        codex_mcp_server(namespace, name).alias("server"),
        ((name == "exec") & namespace.isin("", "functions")).alias("is_orchestration"),
        # Re-serialised, so copies that differ only in whitespace agree.
        F.sha2(F.get_json_object("payload", "$"), 256).alias("digest"),
        F.when(is_result, size).alias("size"),
    )


def collapse_copies(item_rows: DataFrame) -> DataFrame:
    """One row per (session, call id, kind). ``copies`` beyond the first are
    exact duplicates; differing ones set ``is_conflict``."""
    identity = F.struct("digest", "ts")
    keep = F.struct("ts", "item_type", "tool", "server", "is_orchestration", "size")
    return (
        item_rows.filter("kind in ('call', 'result')")
        .groupBy("session", "call_id", "kind")
        .agg(
            F.min_by(keep, F.struct("chunk", "pos")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            (F.min(identity) != F.max(identity)).alias("is_conflict"),
        )
        .select("session", "call_id", "kind", "first.*", "copies", "is_conflict")
    )


def join_results(collapsed: DataFrame) -> DataFrame:
    """Calls and results side by side, in whichever file order they came."""
    key = ["session", "call_id"]
    calls = collapsed.filter("kind = 'call'").select(
        *key, "tool", "server", F.col("ts").alias("call_ts"), F.col("item_type").alias("call_type")
    )
    results = collapsed.filter("kind = 'result'").select(
        *key, "size", F.col("ts").alias("result_ts"), F.col("item_type").alias("result_type")
    )
    both = F.col("call_type").isNotNull() & F.col("result_type").isNotNull()
    expected = F.concat("call_type", F.lit("_output"))
    return calls.join(results, key, "full_outer").withColumn(
        "status",
        F.when(both & (F.col("result_type") != expected), F.lit("type_mismatch"))
        .when(both, F.lit("joined"))
        .when(F.col("result_type").isNull(), F.lit("unanswered"))
        .otherwise(F.lit("unmatched")),
    )


def rollup(joined: DataFrame, includes) -> DataFrame:
    """Per (tool, server) sums with their ``known`` flags. One payload nobody
    could measure taints the row it belongs to and every total above it."""
    returned = (F.col("status") == "joined") & includes(F.col("result_ts"))
    known = lambda flag: F.coalesce(
        F.bool_and(F.when(returned, F.col(f"size.{flag}"))), F.lit(True)
    )
    summed = lambda field: F.coalesce(
        F.sum(F.when(returned, F.col(f"size.{field}"))), F.lit(0)
    )
    has_call = F.col("call_type").isNotNull()
    return joined.groupBy("tool", "server").agg(
        F.count_if(returned).alias("calls"),
        summed("text_bytes").alias("context_bytes"),
        summed("image_bytes").alias("image_bytes"),
        F.count_if(returned & F.col("size.has_image")).alias("image_results"),
        known("text_known").alias("text_known"),
        known("image_known").alias("image_known"),
        known("images_known").alias("images_known"),
        F.count_if(has_call & includes(F.col("call_ts"))).alias("uses"),
        F.count_if((F.col("status") == "unanswered") & includes(F.col("call_ts"))).alias("unanswered"),
        F.count_if(F.col("status") == "unmatched").alias("unmatched"),
        F.lit(0).alias("taint"),
    )


def tainted(rolled: DataFrame, item_rows: DataFrame, errors: DataFrame) -> DataFrame:
    """The rollup with ``taint``: which of ``TAINTS``, as bits, some call of the tool is subject to.

    A call whose copies differ taints every tool that they name; what is wrong with a session taints all that it
    called. A tool that only a discarded copy names has a row of its own.
    """
    calls = item_rows.filter("kind = 'call'").select("session", "call_id", "tool", "server").distinct()
    bit = F.lit(0)
    for k, kind in enumerate(TAINTS):
        bit = F.when(F.col("kind") == kind, F.lit(1 << k)).otherwise(bit)
    marked = errors.select("session", "call_id", bit.alias("bit"))
    of_call = marked.filter("call_id <> ''").join(calls, ["session", "call_id"], "left")
    of_session = marked.filter("call_id = ''").drop("call_id").join(calls.drop("call_id").distinct(), "session")
    bits = of_call.select("tool", "server", "bit").unionByName(of_session.select("tool", "server", "bit"))
    marks = bits.groupBy(F.col("tool").alias("_tool"), F.col("server").alias("_server")).agg(F.bit_or("bit").alias("_bits"))
    joined = rolled.join(
        marks, F.col("tool").eqNullSafe(F.col("_tool")) & F.col("server").eqNullSafe(F.col("_server")), "full_outer"
    )
    empty = {c: F.coalesce(c, F.lit(0)) for c in FIGURES} | {c: F.coalesce(c, F.lit(True)) for c in KNOWN}
    return joined.select(
        F.coalesce("tool", "_tool").alias("tool"),
        F.coalesce("server", "_server").alias("server"),
        *[c.alias(name) for name, c in empty.items()],
        F.coalesce("_bits", F.lit(0)).alias("taint"),
    )


def taint_names(taint: Column) -> Column:
    """The names in ``taint``, in the order of ``TAINTS``, joined by commas."""
    return F.concat_ws(",", *(F.when(taint.bitwiseAND(1 << k) != 0, F.lit(kind)) for k, kind in enumerate(TAINTS)))


def fold(rolled: DataFrame, *keys: str) -> DataFrame:
    """The rollup at a coarser grain, with tainted figures withheld as NULL.

    A payload that nobody could measure withholds its sizes, an ambiguous join every figure that it enters.
    """
    grouped = rolled.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FIGURES],
        *[F.coalesce(F.bool_and(c), F.lit(True)).alias(c) for c in KNOWN],
        F.coalesce(F.bit_or("taint"), F.lit(0)).alias("taint"),
    )
    sure = F.col("taint") == 0
    plain = {c: F.when(sure, F.col(c)) for c in ("calls", "uses", "unanswered")}
    return grouped.withColumns(
        plain
        | {
            "context_bytes": F.when(sure & F.col("text_known"), F.col("context_bytes")),
            "image_bytes": F.when(sure & F.col("image_known"), F.col("image_bytes")),
            "image_results": F.when(sure & F.col("images_known"), F.col("image_results")),
        }
    )


def parents(scoped: DataFrame) -> DataFrame:
    """Parent of each session; more than one distinct parent is a conflict."""
    meta = typed_fields(F.col("payload"), "forked_from_id", "parent_thread_id")
    parent = F.coalesce(
        F.nullif(field_text(meta["forked_from_id"]), F.lit("")),
        F.nullif(field_text(meta["parent_thread_id"]), F.lit("")),
    )
    return (
        scoped.filter("status = 'ok' and type = 'session_meta'")
        .select("session", parent.alias("parent"))
        .filter("parent is not null")
        .groupBy("session")
        .agg(F.min("parent").alias("parent"), (F.min("parent") != F.max("parent")).alias("is_conflict"))
    )


def cyclic_sessions(links: DataFrame) -> DataFrame:
    """Sessions whose ancestry never ends: on a cycle or below one."""
    return ancestry.climb(links).cyclic.select(F.col("node").alias("session"))


def inherited_calls(call_keys: DataFrame, links: DataFrame, forest: ancestry.Forest | None = None) -> DataFrame:
    """(call_id, session, ancestor) of each call whose id one of its session's ancestors has too, the nearest one.

    Only ids seen in at least two sessions can collide, so only those are placed.
    Sessions with cyclic ancestry are left to ``cyclic_sessions``.
    """
    shared_ids = (
        call_keys.groupBy("call_id")
        .agg(F.min("session").alias("_a"), F.max("session").alias("_b"))
        .filter("_a <> _b")
        .select("call_id")
    )
    owned = call_keys.join(shared_ids, "call_id", "left_semi").select(
        F.col("session").alias("node"), F.col("call_id").alias("item")
    )
    placed = ancestry.intervals(forest or ancestry.climb(links))
    return ancestry.nearest_owner(owned, placed).select(
        F.col("item").alias("call_id"), F.col("node").alias("session"), "ancestor"
    )


def quality_errors(collapsed: DataFrame, joined: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, session, call_id, other) of everything that makes joined figures ambiguous, ``TAINTS``.

    ``other`` is the nearest ancestor that an inherited call's id is known from, else empty; ``call_id`` is empty where a
    whole session is concerned.
    """
    none = F.lit("")
    row = lambda df, kind, call_id, other=none: df.select(
        F.lit(kind).alias("kind"), "session", call_id.alias("call_id"), other.alias("other")
    )
    forest = ancestry.climb(links)
    calls = collapsed.filter("kind = 'call'").select("session", "call_id")
    inherited = inherited_calls(calls, links, forest)
    cyclic = forest.cyclic.select(F.col("node").alias("session")).join(calls.select("session").distinct(), "session", "left_semi")
    return (
        row(collapsed.filter("is_conflict").select("session", "call_id").distinct(), "conflicting_copies", F.col("call_id"))
        .unionByName(row(joined.filter("status = 'type_mismatch'"), "type_mismatch", F.col("call_id")))
        .unionByName(row(links.filter("is_conflict"), "conflicting_ancestry", none))
        .unionByName(row(cyclic, "cyclic_ancestry", none))
        .unionByName(row(inherited, "inherited_call", F.col("call_id"), F.col("ancestor")))
    )


def raise_on(errors: DataFrame) -> None:
    """Strict mode: refuse to report over an ambiguous join."""
    first = errors.head(1)
    if first:
        raise ValueError(
            f"{first[0].kind}: session {first[0].session} call {first[0].call_id!r}"
        )
