"""Commands: silver tables in, one Envelope out.

Each command makes one pass over its large table, settles the small rollup and
folds that. Nothing here collects rows.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter import __version__, model
from agentmeter.functions.names import millis_to_rfc3339
from agentmeter.functions.numbers import microdollars, percent
from agentmeter.functions.window import ALWAYS, TimeWindow
from agentmeter.operators import attachments as attachment_ops
from agentmeter.operators import attribute as attribute_ops
from agentmeter.operators import audit
from agentmeter.operators import calls as call_ops
from agentmeter.operators import codex as codex_ops
from agentmeter.operators import corruption as corruption_ops
from agentmeter.operators import failures as failure_ops
from agentmeter.operators import inventory as inventory_ops
from agentmeter.operators import opencode as opencode_ops
from agentmeter.operators import tools as tool_ops
from agentmeter.operators.metrics import (
    Envelope,
    Measure,
    drift_warnings,
    version_drift,
    corpus_rows,
    disagreement_warnings,
    merge_reports,
    run_header,
    stack_rows,
    unpivot,
    warning_rows,
)
from agentmeter.session import settle
from agentmeter.sources import config, rollouts
from agentmeter.sources.transcripts import Corpus

REPORT_ORDER = ("scan", "tools", "attribute", "corruption")


def _measures(*specs: tuple) -> list[Measure]:
    return [Measure(name, F.col(name), unit, *more) for name, unit, *more in specs]


def _counted(text: str, *columns: str) -> Column:
    """A sentence with {} places filled from columns."""
    pieces = text.split("{}")
    parts = [F.lit(pieces[0])]
    for column, piece in zip(columns, pieces[1:]):
        parts += [F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(piece)]
    return F.concat(*parts)


class _Run:
    """What every command shares: the event rollup, the header and the window
    warnings. The rollup is settled once per corpus and window."""

    def __init__(self, corpus: Corpus, window: TimeWindow, version: str, rolled: DataFrame | None = None):
        self.corpus, self.window, self.version = corpus, window, version
        self.in_window = window.includes(F.col("ts"))
        self.rolled = rolled or settle(inventory_ops.rollup(corpus.events, self.in_window))
        self.files = settle(inventory_ops.file_counters(corpus.manifest))
        self.span = settle(inventory_ops.date_range(self.rolled))

    @cached_property
    def calls(self) -> DataFrame:
        """Results joined to their calls, once for every command of the run."""
        return settle(call_ops.join_calls(self.corpus.uses, self.corpus.results))

    def placed(self, one_row: DataFrame) -> DataFrame:
        """Windowed corpus rows disappear when the window matched no event."""
        if not self.window.active:
            return one_row
        return one_row.filter(self.span.select(F.col("placed") > 0).scalar())

    def header(self, command: str) -> DataFrame:
        span = self.span
        corpus = self.files.select(
            "files",
            "bytes",
            span.select("first_ts").scalar().alias("first_ts"),
            span.select("last_ts").scalar().alias("last_ts"),
        )
        return run_header(command, self.corpus.directory, self.version, self.window, corpus)

    def warnings(self, command: str) -> DataFrame:
        spark = self.corpus.events.sparkSession
        rows = [
            warning_rows(
                self.files.filter("parse_errors > 0"),
                command,
                "parse_errors",
                _counted("{} lines failed to decode", "parse_errors"),
            )
        ]
        if self.window.active:
            bounds = f"[{self.window.since or '...'}, {self.window.until or '...'}]"
            rows.append(
                warning_rows(
                    spark.range(1),
                    command,
                    "window",
                    F.lit(
                        f"figures cover events dated within {bounds}; counts of files, their bytes, broken "
                        "lines and results without a call cover everything that was read"
                    ),
                )
            )
            rows.append(
                warning_rows(
                    inventory_ops.never_timestamped(self.rolled),
                    command,
                    "untimestamped_type",
                    _counted("{} carries no timestamp: unavailable in a window, not zero", "type"),
                    F.col("type"),
                )
            )
            rows.append(
                warning_rows(
                    self.span.filter("placed = 0"),
                    command,
                    "window_empty",
                    F.lit("nothing is dated inside the window, so figures that depend on it are left out"),
                )
            )
        return stack_rows(rows)

    def envelope(self, command: str, metrics, warnings) -> Envelope:
        return Envelope(
            command,
            stack_rows(metrics),
            stack_rows([*warnings, self.warnings(command)]),
            self.header(command),
        )


def start(corpus: Corpus, window: TimeWindow = ALWAYS, version: str = __version__) -> _Run:
    """Shared tables for several commands over one corpus and window."""
    return _Run(corpus, window, version)


def scan(corpus: Corpus, window: TimeWindow = ALWAYS, version: str = __version__, cached: DataFrame | None = None, run=None) -> Envelope:
    run = run or _Run(corpus, window, version)
    types = inventory_ops.by_type(run.rolled)
    versions = inventory_ops.by_version(run.rolled)
    unknown = inventory_ops.unknown_types(run.rolled)
    windowed = run.placed(
        run.rolled.agg(
            F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
            F.countDistinct(F.when(F.col("events") > 0, F.col("type"))).alias("distinct_event_types"),
            F.countDistinct(
                F.when((F.col("events") > 0) & (F.col("version") != ""), F.col("version"))
            ).alias("distinct_cli_versions"),
        )
    )
    some_journal = lambda c: F.when(F.col("non_transcript_records") > 0, F.col(c))
    files = run.files.withColumns(
        {
            "known_event_types": F.lit(len(model.KNOWN_TYPES)),
            "files_non_transcript": some_journal("files_non_transcript"),
            "non_transcript_records": some_journal("non_transcript_records"),
        }
    )
    metrics = [
        corpus_rows(
            files,
            "scan",
            0,
            _measures(
                ("files", "files"),
                ("bytes", "bytes"),
                ("files_top_level", "files"),
                ("files_subagent", "files"),
                ("known_event_types", "types"),
                ("parse_errors", "errors"),
                ("files_non_transcript", "files"),
                ("non_transcript_records", "records"),
            ),
        ),
        corpus_rows(
            windowed,
            "scan",
            1,
            _measures(
                ("events", "events"),
                ("distinct_event_types", "types"),
                ("distinct_cli_versions", "versions"),
            ),
        ),
        unpivot(types, "scan", 3, "type", F.col("type"), _measures(("events", "events"))),
        unpivot(versions, "scan", 4, "cli_version", F.col("version"), _measures(("events", "events"))),
        unpivot(
            unknown, "scan", 5, "unknown_type", F.col("type"), _measures(("unknown_type_events", "events"))
        ),
    ]
    warnings = [
        warning_rows(
            files.filter("non_transcript_records > 0"),
            "scan",
            "non_transcript_records",
            _counted(
                "{} journal records are excluded from every count but bytes; files holding nothing else: {}",
                "non_transcript_records",
                "files_non_transcript",
            ),
        ),
        warning_rows(
            unknown,
            "scan",
            "unknown_type",
            _counted("unknown event type {} seen {} times: counted, not parsed", "type", "unknown_type_events"),
            F.col("type"),
        ),
    ]
    if cached is None:
        warnings.append(
            warning_rows(
                corpus.events.sparkSession.range(1),
                "scan",
                "retention_gap_unavailable",
                F.lit("no session-count document was given: the retention gap is unavailable"),
            )
        )
    else:
        gap = inventory_ops.retention_gap(run.files, cached)
        metrics.append(
            corpus_rows(
                gap,
                "scan",
                2,
                _measures(("stats_cache_sessions", "sessions"), ("retention_gap", "sessions")),
            )
        )
    return run.envelope("scan", metrics, warnings)


_STAT_MEASURES = (
    ("calls", "calls"),
    ("context_bytes", "bytes"),
    ("image_bytes", "bytes"),
    ("produced_bytes", "bytes"),
    ("errors", "calls"),
)


def tools(
    corpus: Corpus,
    window: TimeWindow = ALWAYS,
    version: str = __version__,
    plugins: DataFrame | None = None,
    run=None,
) -> Envelope:
    """``plugins`` is the name authority (column plugin); without one the
    plugin rows are omitted and the command says so."""
    run = run or _Run(corpus, window, version)
    spark = corpus.events.sparkSession
    calls = run.calls
    rolled = settle(tool_ops.rollup(calls, run.in_window))
    per_tool = tool_ops.by_tool(rolled)
    per_server = tool_ops.by_server(per_tool)
    open_ids = call_ops.unanswered(corpus.uses, calls, run.in_window).agg(
        F.count(F.lit(1)).alias("unanswered_uses")
    )
    asked = corpus.uses.agg(F.count_if(run.in_window).alias("tool_use_blocks"))
    zero = F.lit(0)
    totals = rolled.agg(
        F.coalesce(F.sum("unmatched_results"), zero).alias("unmatched_results"),
        F.count_if((F.col("calls") > 0) & F.col("tool").isNotNull()).alias("distinct_tools"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in (*tool_ops.STATS, *tool_ops.EXTRA)],
    ).withColumns(
        {
            "tool_result_blocks": F.col("calls"),
            "tool_use_blocks": asked.scalar(),
            "unanswered_uses": open_ids.scalar(),
        }
    )
    totals = settle(totals)
    rent = settle(
        attachment_ops.by_key(
            corpus.attachment_keys.filter(run.in_window).filter("dimension in ('mcp_server', 'skill')")
        )
    )
    server_keys = rent.filter("dimension = 'mcp_server'")
    skill_rent = rent.filter("dimension = 'skill'").select(
        F.col("key").alias("skill"), F.col("attachment_bytes").alias("rent_bytes")
    )
    server_rent = tool_ops.rent_by_server(server_keys, plugins)
    skill_rows = settle(
        tool_ops.skill_usage(skill_rent, tool_ops.skill_calls(corpus.uses, run.in_window))
    )

    stats = _measures(*_STAT_MEASURES)
    weight = [F.col("context_bytes")]

    def both_sides(stat_rows, rent_rows, key, section):
        joined = tool_ops.rent_with_calls(stat_rows, rent_rows, key)
        called, idle = joined.filter("not rent_only"), joined.filter("rent_only")
        dimension = "mcp_server" if key == "server" else key
        return [
            unpivot(called, "tools", section, dimension, F.col(key), stats, weight),
            unpivot(idle, "tools", section + 2, dimension, F.col(key), stats, [F.col("rent_bytes")]),
            unpivot(
                rent_rows, "tools", section + 4, dimension, F.col(key),
                _measures(("rent_bytes", "bytes")), [F.col("rent_bytes")],
            ),
        ]

    metrics = [
        corpus_rows(totals, "tools", 0, _measures(("unmatched_results", "blocks"))),
        corpus_rows(
            run.placed(totals),
            "tools",
            1,
            _measures(
                ("tool_use_blocks", "blocks"),
                ("tool_result_blocks", "blocks"),
                ("unanswered_uses", "blocks"),
                ("distinct_tools", "tools"),
                *_STAT_MEASURES,
                ("image_results", "results"),
                ("externalised_results", "results"),
                ("externalised_produced_bytes", "bytes"),
                ("externalised_context_bytes", "bytes"),
            ),
        ),
        unpivot(per_tool, "tools", 2, "tool", F.col("tool"), stats, weight),
        *both_sides(per_server, server_rent, "server", 3),
        unpivot(
            skill_rent, "tools", 10, "skill", F.col("skill"),
            _measures(("rent_bytes", "bytes")), [F.col("rent_bytes")],
        ),
        unpivot(
            skill_rows, "tools", 11, "skill", F.col("skill"),
            _measures(("skill_calls", "calls")), [F.coalesce("rent_bytes", zero)],
        ),
    ]
    checks = call_ops.check_side_files(calls, corpus.side_files)
    warnings = [
        warning_rows(
            call_ops.unmatched(calls),
            "tools",
            "unmatched_result",
            _counted("tool_result {} has no matching tool_use", "use_id"),
            F.col("use_id"),
        ),
        warning_rows(
            checks,
            "tools",
            "side_file",
            _counted(
                "persisted output {}: {} (reported {} bytes, found {})",
                "persisted_path", "problem", "persisted_size", "length",
            ),
            F.col("persisted_path"),
        ),
    ]
    if plugins is None:
        warnings.append(
            warning_rows(
                spark.range(1),
                "tools",
                "plugins_unavailable",
                F.lit("no plugin names were given: plugin rows are omitted, not zeroed"),
            )
        )
    else:
        per_plugin = tool_ops.by_plugin(per_server, plugins)
        plugin_rent = tool_ops.rent_by_plugin(server_keys, plugins)
        metrics += both_sides(per_plugin, plugin_rent, "plugin", 4)
        warnings.append(
            warning_rows(
                tool_ops.unresolved_segments(per_server, plugins),
                "tools",
                "unresolved_segment",
                _counted("no configured plugin claims {}", "segment"),
                F.col("segment"),
            )
        )
    return run.envelope("tools", metrics, warnings)


def attribute(
    corpus: Corpus, window: TimeWindow = ALWAYS, version: str = __version__, run=None
) -> Envelope:
    run = run or _Run(corpus, window, version)
    inside = run.in_window
    rolled = settle(attribute_ops.rollup(attribute_ops.distinct_responses(corpus.usage.filter(inside))))
    latest = settle(attribute_ops.session_bills(corpus.bills.filter(inside)))
    bills = attribute_ops.model_bills(latest)
    allocated = settle(
        attribute_ops.cost_by_dimension(attribute_ops.allocation(rolled, bills))
    )
    per_dimension = settle(
        attribute_ops.by_dimension(rolled).join(allocated, ["dimension", "key"], "left")
    )
    covered = settle(attribute_ops.coverage(bills, attribute_ops.by_session_model(rolled)))
    types = settle(attachment_ops.by_type(corpus.attachments.filter(inside)))
    keys = settle(attachment_ops.by_key(corpus.attachment_keys.filter(inside)))
    session_rows = per_dimension.filter("dimension = 'session'")
    # One row per session, billed or not, with which side it was seen on.
    seen = attribute_ops.sessions_seen(corpus.events, inside)
    billing = settle(
        seen.withColumn("seen", F.lit(1))
        .join(latest.select("session", F.lit(1).alias("billed")), "session", "full_outer")
        .agg(
            F.count("seen").alias("sessions"),
            F.count("billed").alias("sessions_with_cost_state"),
            F.count_if(F.col("billed").isNull()).alias("sessions_without_cost_state"),
        )
    )
    zero = F.lit(0)
    attached = types.agg(
        F.coalesce(F.sum("attachment_events"), zero).alias("attachment_events"),
        F.coalesce(F.sum("attachment_bytes"), zero).alias("attachment_bytes"),
        F.count(F.lit(1)).alias("attachment_types"),
    )
    totals = attribute_ops.totals(rolled).withColumns(
        {
            "responses_naive": F.col("sightings"),
            "responses_distinct": F.col("responses"),
            "responses_duplicate": F.col("sightings") - F.col("responses"),
            "duplicate_rate_percent": percent(F.col("sightings") - F.col("responses"), F.col("sightings")),
            "billed": latest.agg(
                F.coalesce(F.sum(microdollars(F.col("total_usd"))), zero)
            ).scalar(),
            "allocated_cost_usd": allocated.filter("dimension = 'session'")
            .agg(F.coalesce(F.sum("cost_usd"), zero))
            .scalar(),
        }
    ).withColumn("unallocated_cost_usd", F.col("billed") - F.col("allocated_cost_usd"))
    totals = settle(totals)
    sessions = billing.withColumn(
        "cost_state_coverage_percent",
        percent(F.col("sessions_with_cost_state"), F.col("sessions")),
    )
    volume = attached.withColumn(
        "attachment_share_percent",
        percent(F.col("attachment_bytes"), run.files.select("bytes").scalar()),
    )
    method = model.ALLOCATION_METHOD
    row_measures = [
        *_measures(
            ("responses", "responses"),
            ("fresh_tokens", "tokens"),
            ("rebilled_tokens", "tokens"),
            ("rebill_multiplier", "ratio", True),
        ),
        Measure("cost_usd", F.col("cost_usd"), "microdollars", method=method),
    ]
    metrics = [
        corpus_rows(
            run.placed(totals),
            "attribute",
            0,
            _measures(
                ("responses_naive", "responses"),
                ("responses_distinct", "responses"),
                ("responses_duplicate", "responses"),
                ("duplicate_rate_percent", "percent", True),
                ("fresh_tokens", "tokens"),
                ("rebilled_tokens", "tokens"),
                ("output_tokens", "tokens"),
                ("thinking_tokens", "tokens"),
                ("rebill_multiplier", "ratio", True),
            ),
        ),
        corpus_rows(
            run.placed(sessions),
            "attribute",
            1,
            _measures(
                ("sessions", "sessions"),
                ("sessions_with_cost_state", "sessions"),
                ("sessions_without_cost_state", "sessions"),
                ("cost_state_coverage_percent", "percent", True),
            ),
        ),
        corpus_rows(
            run.placed(volume),
            "attribute",
            2,
            _measures(
                ("attachment_events", "events"),
                ("attachment_bytes", "bytes"),
                ("attachment_share_percent", "percent", True),
                ("attachment_types", "types"),
            ),
        ),
        corpus_rows(
            run.placed(totals),
            "attribute",
            3,
            [
                Measure(name, F.col(name), "microdollars", method=method)
                for name in ("allocated_cost_usd", "unallocated_cost_usd")
            ],
        ),
        unpivot(
            per_dimension, "attribute", 4, F.col("dimension"), F.col("key"), row_measures,
            [F.col("rebilled_tokens")],
        ),
        unpivot(
            attribute_ops.availability(
                session_rows.select(F.col("key").alias("session"), "rebilled_tokens"), latest
            ),
            "attribute",
            5,
            "session",
            F.col("session"),
            _measures(("dollars_available", "sessions")),
            [F.col("rebilled_tokens")],
        ),
        unpivot(
            covered,
            "attribute",
            6,
            "cost_coverage",
            F.concat_ws("/", "session", "model"),
            _measures(
                ("coverage_ratio", "ratio", True),
                ("transcript_tokens", "tokens"),
                ("billed_tokens", "tokens"),
            ),
        ),
        unpivot(
            types, "attribute", 7, "attachment_type", F.col("type"),
            _measures(("attachment_events", "events"), ("attachment_bytes", "bytes")),
            [F.col("attachment_bytes")],
        ),
        unpivot(
            keys, "attribute", 8, F.col("dimension"), F.col("key"),
            _measures(("attachment_events", "events"), ("attachment_bytes", "bytes")),
            [F.col("attachment_bytes")],
        ),
    ]
    health = attribute_ops.dimension_health(per_dimension)
    warnings = [
        warning_rows(
            totals.filter("responses_duplicate > 0"),
            "attribute",
            "duplicate_responses",
            _counted(
                "{} of {} response records only show an id again; each id is billed once",
                "responses_duplicate", "responses_naive",
            ),
        ),
        warning_rows(
            billing.filter("sessions_without_cost_state > 0"),
            "attribute",
            "sessions_without_bill",
            _counted(
                "{} of {} sessions never wrote a bill and have no cost figure",
                "sessions_without_cost_state", "sessions",
            ),
        ),
        warning_rows(
            covered.filter("is_absent").groupBy("model").agg(F.count(F.lit(1)).alias("pairs")),
            "attribute",
            "billed_model_absent",
            _counted("{} billed sessions of model {} have no transcript events", "pairs", "model"),
            F.col("model"),
        ),
        warning_rows(
            health.filter("is_absent"),
            "attribute",
            "attribution_absent",
            _counted("{} is unmeasured: no event carries the field", "dimension"),
            F.col("dimension"),
        ),
        warning_rows(
            health.filter("is_thin"),
            "attribute",
            "attribution_thin",
            _counted(
                "{}: {} percent of re-billed tokens are unclaimed, so its dollars are a floor",
                "dimension", "unclaimed_percent",
            ),
            F.col("dimension"),
        ),
    ]
    return run.envelope("attribute", metrics, warnings)


def corruption(
    corpus: Corpus, window: TimeWindow = ALWAYS, version: str = __version__, run=None
) -> Envelope:
    run = run or _Run(corpus, window, version)
    calls = run.calls
    rolled = settle(corruption_ops.rollup(calls, run.in_window))
    totals = settle(corruption_ops.totals(rolled))
    per_tool = corruption_ops.by_tool(rolled)
    ranking = [F.col(c) for c in ("failures", "errors", "truncated_results", "empty_results")]
    metrics = [
        corpus_rows(totals, "corruption", 0, _measures(("unmatched_results", "blocks"))),
        corpus_rows(
            run.placed(totals),
            "corruption",
            1,
            _measures(
                ("calls", "calls"),
                ("distinct_tools", "tools"),
                ("errors", "calls"),
                ("error_rate_percent", "percent", True),
                ("denied", "calls"),
                ("failures", "calls"),
                ("failure_rate_percent", "percent", True),
                ("empty_results", "calls"),
                ("empty_rate_percent", "percent", True),
                ("truncated_results", "calls"),
                ("truncation_rate_percent", "percent", True),
                ("truncation_marker_kinds", "markers"),
            ),
        ),
        unpivot(
            per_tool, "corruption", 2, "tool", F.col("tool"),
            _measures(
                ("calls", "calls"),
                ("errors", "calls"),
                ("error_rate_percent", "percent", True),
                ("denied", "calls"),
                ("failures", "calls"),
                ("failure_rate_percent", "percent", True),
                ("empty_results", "calls"),
                ("truncated_results", "calls"),
            ),
            ranking,
        ),
        unpivot(
            corruption_ops.by_marker(rolled), "corruption", 3, "truncation_marker", F.col("marker"),
            _measures(("truncated_results", "calls")), [F.col("truncated_results")],
        ),
        unpivot(
            corruption_ops.by_denial(rolled), "corruption", 4, "denial_kind", F.col("denial"),
            _measures(("denied", "calls")), [F.col("denied")],
        ),
    ]
    warnings = [
        warning_rows(
            totals.filter("denied > 0"),
            "corruption",
            "denials",
            _counted(
                "{} of {} errored results are policy denials; the failures are the {} that remain",
                "denied", "errors", "failures",
            ),
        ),
        warning_rows(
            totals.filter("ambiguous_denials > 0"),
            "corruption",
            "ambiguous_denials",
            _counted(
                "{} events carry one denial beside several errored results: an upper bound",
                "ambiguous_denials",
            ),
        ),
        warning_rows(
            totals.filter("truncated_results > 0"),
            "corruption",
            "truncation",
            _counted(
                "{} results contain a marker of cut output; text that merely mentions one is counted too",
                "truncated_results",
            ),
        ),
    ]
    return run.envelope("corruption", metrics, warnings)


def failures(
    corpus: Corpus, window: TimeWindow = ALWAYS, version: str = __version__, run=None
) -> Envelope:
    run = run or _Run(corpus, window, version)
    calls = run.calls
    joined = call_ops.matched(calls)
    loops = settle(
        failure_ops.retry_loops(joined, run.in_window, window.active, corpus.results)
    )
    loops = settle(failure_ops.numbered_loops(loops))
    pairs = settle(failure_ops.repeated_failures(failure_ops.call_outcomes(joined, run.in_window)))
    claimed = settle(failure_ops.by_attribution(joined, run.in_window))
    zero = F.lit(0)
    defects = calls.agg(
        F.count_if(F.col("call").isNull()).alias("unmatched_results"),
        F.count_if(F.col("call").isNotNull() & run.in_window & F.col("is_error")).alias("errored_results"),
        F.count_if((F.col("idx") == 0) & (F.col("denial") != "") & (F.col("event_errors") > 1)).alias(
            "ambiguous_denials"
        ),
    ).withColumns(
        {
            "retry_loops": loops.agg(F.count(F.lit(1))).scalar(),
            "repeated_failure_pairs": pairs.agg(F.count(F.lit(1))).scalar(),
            "pattern_denials": loops.agg(F.coalesce(F.sum("denied"), zero)).scalar()
            + pairs.agg(F.coalesce(F.sum("denied"), zero)).scalar(),
        }
    )
    defects = settle(defects)
    split = (("errors", "calls"), ("failures", "calls"), ("denied", "calls"))
    metrics = [
        corpus_rows(
            run.placed(defects), "failures", 0,
            _measures(
                ("retry_loops", "loops"),
                ("repeated_failure_pairs", "pairs"),
                ("errored_results", "calls"),
            ),
        ),
        corpus_rows(defects, "failures", 1, _measures(("unmatched_results", "blocks"))),
        unpivot(
            loops, "failures", 2, "retry_loop", F.col("key"),
            [
                Measure("consecutive_errors", F.col("streak"), "calls"),
                Measure("consecutive_denials", F.col("denied"), "calls"),
            ],
            [F.col("streak")],
        ),
        unpivot(
            pairs, "failures", 3, "repeated_failure", F.col("key"),
            _measures(
                ("calls", "calls"), ("errors", "calls"), ("failures", "calls"), ("denied", "calls"),
                ("error_sessions", "sessions"),
            ),
            [F.col("errors")],
        ),
        unpivot(
            claimed, "failures", 4, F.col("dimension"), F.col("key"), _measures(*split),
            [F.col("failures"), F.col("errors")],
        ),
    ]
    spark = corpus.events.sparkSession
    names = spark.createDataFrame([(d[0],) for d in model.FAILURE_DIMENSIONS], "dimension string")
    unclaimed = names.join(claimed.select("dimension").distinct(), "dimension", "left_anti")
    warnings = [
        warning_rows(
            defects.filter("pattern_denials > 0"), "failures", "denials",
            _counted("{} of the errors behind these patterns are policy denials", "pattern_denials"),
        ),
        warning_rows(
            defects.filter("ambiguous_denials > 0"), "failures", "ambiguous_denials",
            _counted(
                "{} events carry one denial beside several errored results: an upper bound",
                "ambiguous_denials",
            ),
        ),
        warning_rows(
            unclaimed.filter(defects.select(F.col("errored_results") > 0).scalar()),
            "failures", "dimension_unavailable",
            _counted("{} carries no row: no errored call recorded the field", "dimension"),
            F.col("dimension"),
        ),
    ]
    return run.envelope("failures", metrics, warnings)


def _withheld(denominators: DataFrame, *names: str) -> list[DataFrame]:
    """A denominator nobody could count is omitted and said to be."""
    return [
        warning_rows(
            denominators.filter(f"{name} is null"), "doctor", "withheld",
            F.lit(f"{name} is omitted, not zero: no source was readable"), F.lit(name),
        )
        for name in names
    ]


def _named(key: str) -> Column:
    """A key with its host before it, unless the host has no name."""
    return F.concat_ws("/", F.nullif(F.col("host"), F.lit("")), F.col(key))


def _host_rows(per_host: DataFrame, *names: str) -> DataFrame:
    """What was checked on each host that has a name."""
    units = {"skills_checked": "skills", "plugins_checked": "plugins", "mcp_servers_checked": "servers"}
    return unpivot(
        per_host.filter("host <> ''"), "doctor", 0, "host", F.col("host"), _measures(*((n, units[n]) for n in names))
    )


def doctor(
    files: DataFrame,
    corpus: Corpus | None = None,
    window: TimeWindow = ALWAYS,
    version: str = __version__,
    host: str = "",
) -> Envelope:
    """Config audit, plus the configured-against-observed join when a corpus is
    given (its rows then belong to ``host``). Keys carry the host when there
    is more than the nameless one."""
    spark = files.sparkSession
    skills = audit.front_matter(config.skill_files(files))
    plugin_rows = config.plugin_files(files)
    entries = config.server_entries(files)
    merged = audit.merge_servers(entries)
    state = config.source_state(files)
    found = audit.skill_findings(skills).unionByName(audit.plugin_findings(plugin_rows)).unionByName(
        audit.server_findings(audit.winners(entries))
    )
    counted = audit.findings_per_key(found)
    # Which names there are needs no definitions.
    names = entries.select("host", "name").distinct().withColumn("is_winner", F.lit(True))
    per_host = audit.checked(skills, plugin_rows, names, state)
    # One row, which the totals and each kind of warning read.
    denominators = settle(audit.fleet_totals(per_host))
    metrics = [
        corpus_rows(
            denominators, "doctor", 0,
            _measures(
                ("skills_checked", "skills"),
                ("plugins_checked", "plugins"),
                ("mcp_servers_checked", "servers"),
            ),
        ),
        _host_rows(per_host, *audit.CHECKED),
        unpivot(
            counted, "doctor", 1, F.col("dimension"), _named("key"), _measures(("findings", "findings"))
        ),
    ]
    collided = audit.collisions(merged)
    warnings = [
        warning_rows(
            found, "doctor", "finding", _counted("{} {}: {}", "dimension", "key", "kind"), _named("key")
        ),
        warning_rows(
            collided, "doctor", "collision",
            _counted("mcp server {}: {} overrides {} ({})", "name", "source", "overrides", "rule"),
            _named("name"),
        ),
        warning_rows(
            state.filter("is_partial"), "doctor", "partial_config",
            _counted("a server source of host {} is unreadable: its set is partial", "host"),
            F.col("host"),
        ),
        *_withheld(denominators, "skills_checked", "plugins_checked", "mcp_servers_checked"),
    ]
    sizes = files.filter("content is not null").agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"),
        F.lit("").alias("first_ts"),
        F.lit("").alias("last_ts"),
    )
    if corpus is None:
        if window.active:
            warnings.append(
                warning_rows(
                    spark.range(1), "doctor", "static_window",
                    F.lit(
                        f"configuration carries no dates: the window {window.since or '...'} to {window.until or '...'} "
                        "restricts nothing here"
                    ),
                )
            )
        return Envelope(
            "doctor", stack_rows(metrics), stack_rows(warnings),
            run_header("doctor", "", version, ALWAYS, sizes),
        )
    run = _Run(corpus, window, version)
    tag = lambda df: df if "host" in df.columns else df.withColumn("host", F.lit(host))
    observed = settle(audit.observed_servers(tag(corpus.events), tag(corpus.uses), run.in_window))
    configured = merged.filter("is_winner").select("host", "name")
    misses = settle(audit.join_configured(configured, observed))
    used = audit.mcp_sessions(observed).agg(
        F.coalesce(F.sum("mcp_sessions"), F.lit(0)).alias("mcp_sessions")
    )
    metrics += [
        corpus_rows(run.placed(used), "doctor", 2, _measures(("mcp_sessions", "sessions"))),
        unpivot(
            misses, "doctor", 3, "mcp_server", _named("key"),
            _measures(("never_observed", "sessions"), ("unconfigured_observed", "sessions")),
        ),
    ]
    warnings += [
        warning_rows(
            misses.filter("never_observed is not null"), "doctor", "never_observed",
            _counted("{} is configured but none of {} sessions names it", "key", "never_observed"),
            _named("key"),
        ),
        warning_rows(
            misses.filter("unconfigured_observed is not null"), "doctor", "unconfigured_observed",
            _counted("{} is used by {} sessions but no config names it", "key", "unconfigured_observed"),
            _named("key"),
        ),
        warning_rows(
            used.filter("mcp_sessions = 0"), "doctor", "zero_denominator",
            F.lit("without a session that used any server nothing can be said to be unused"),
        ),
    ]
    return run.envelope("doctor", metrics, warnings)


def report(
    corpus: Corpus,
    window: TimeWindow = ALWAYS,
    version: str = __version__,
    plugins: DataFrame | None = None,
    cached: DataFrame | None = None,
    passes: DataFrame | None = None,
) -> Envelope:
    """Four commands off one event rollup, merged; the first to report wins.

    ``passes`` are ``transcripts.corpus_version`` rows taken while commands read the corpus themselves, the first by ``scan``.
    """
    run = _Run(corpus, window, version)
    parts = [
        scan(corpus, window, version, cached, run),
        tools(corpus, window, version, plugins, run),
        attribute(corpus, window, version, run),
        corruption(corpus, window, version, run),
    ]
    every = settle(stack_rows([p.metrics for p in parts]))
    merged = merge_reports(every, REPORT_ORDER).select(*every.columns)
    changed = [] if passes is None else [drift_warnings(version_drift(passes, "scan"))]
    warnings = stack_rows(
        [p.warnings for p in parts] + [disagreement_warnings(every, REPORT_ORDER), *changed]
    )
    return Envelope("report", merged, warnings, run.header("report"))


def summary(metrics: DataFrame) -> DataFrame:
    """Headline figures of a merged report, each one re-derivable from rows."""
    corpus_value = lambda name: metrics.filter(
        (F.col("dimension") == "corpus") & (F.col("name") == name)
    ).select(
        F.lit(name).alias("figure"),
        F.lit("").alias("about"),
        F.coalesce("value_double", F.col("value_long").cast("double")).alias("value"),
    )
    by_context = metrics.filter("dimension = 'tool' and name = 'context_bytes'")
    whole = metrics.filter("dimension = 'corpus' and name = 'context_bytes'").agg(F.max("value_long"))
    top = by_context.orderBy(F.desc("value_long"), "key").limit(3)
    concentration = top.agg(
        F.lit("tool_concentration_percent").alias("figure"),
        F.array_join(F.sort_array(F.collect_list("key")), ",").alias("about"),
        percent(F.sum("value_long"), F.max(whole.scalar())).alias("value"),
    ).filter("about <> ''")
    rebilled = metrics.filter("name = 'rebilled_tokens'").select(
        "dimension", "key", F.col("value_long").alias("rebilled_tokens")
    )
    all_rebilled = rebilled.filter("dimension = 'corpus'").agg(F.max("rebilled_tokens"))
    thinnest = attribute_ops.thinnest_dimension(rebilled).select(
        F.lit("thinnest_attribution_percent").alias("figure"),
        F.col("dimension").alias("about"),
        percent(F.col("unclaimed_tokens"), all_rebilled.scalar()).alias("value"),
    )
    singles = [
        corpus_value(name)
        for name in (
            "rebill_multiplier",
            "duplicate_rate_percent",
            "attachment_share_percent",
            "allocated_cost_usd",
            "unallocated_cost_usd",
        )
    ]
    return stack_rows([concentration, *singles, thinnest])


#: What each ambiguity says, with its session, call and other session.
_AMBIGUITY_TEXTS = {
    "conflicting_copies": ("session {}: the copies of call {} differ", "session", "call_id"),
    "type_mismatch": ("session {}: call {} has a result of another type", "session", "call_id"),
    "conflicting_ancestry": ("session {} names more than one parent", "session"),
    "cyclic_ancestry": ("session {}: its ancestry leads back to itself", "session"),
    "inherited_call": ("session {}: call {} is also one of session {}, which it descends from", "session", "call_id", "other"),
}


def _ambiguities(errors: DataFrame, per_tool: DataFrame) -> list[DataFrame]:
    found = [
        warning_rows(errors.filter(F.col("kind") == kind), "tools", kind, _counted(*text), F.concat_ws("/", "session", "call_id"))
        for kind, text in _AMBIGUITY_TEXTS.items()
    ]
    names = codex_ops.taint_names(F.col("taint"))
    held = per_tool.filter("taint <> 0").select(F.coalesce("tool", F.lit("(none)")).alias("tool"), names.alias("why"))
    return [
        *found,
        warning_rows(held, "tools", "withheld", _counted("{}: figures withheld because of {}", "tool", "why"), F.col("tool")),
        warning_rows(
            errors.limit(1), "tools", "withheld_total", F.lit("totals that ambiguous joins enter are withheld")
        ),
    ]


def codex_tools(
    scoped: DataFrame,
    listing_bytes: DataFrame,
    window: TimeWindow = ALWAYS,
    version: str = __version__,
    directory: str = "",
    strict: bool = True,
    withhold: bool = False,
) -> Envelope:
    """``scoped`` comes from ``sources.rollouts.scope``; ``listing_bytes`` is a
    one-row total of file sizes. A corpus without any session is refused.

    ``strict`` refuses a corpus with ambiguous joins. Without it ``withhold`` leaves out the figures that they
    enter and warns of each; with neither, joins aren't checked and of differing copies the first counts.
    """
    includes = window.includes_nanos
    quality = settle(rollouts.record_quality(scoped))
    rollouts.require_sessions(quality, directory)
    item_rows = settle(codex_ops.items(scoped))
    collapsed = settle(codex_ops.collapse_copies(item_rows))
    joined = settle(codex_ops.join_results(collapsed))
    links = settle(codex_ops.parents(scoped))
    rolled = codex_ops.rollup(joined, includes)
    errors = None
    if strict or withhold:
        errors = settle(codex_ops.quality_errors(collapsed, joined, links))
        if strict:
            codex_ops.raise_on(errors)
        else:
            rolled = codex_ops.tainted(rolled, item_rows, errors)
    rolled = settle(rolled)
    distinct_tools = rolled.filter("calls > 0").agg(F.countDistinct("tool")).scalar()
    totals = codex_ops.fold(rolled).withColumn("distinct_tools", F.when(F.col("taint") == 0, distinct_tools))
    per_tool = codex_ops.fold(rolled.filter("calls > 0"), "tool")
    per_server = codex_ops.fold(rolled.filter("calls > 0 and server <> ''"), "server")
    live = scoped.filter("status = 'ok'")
    stamped = F.when(F.col("ts") != "", F.col("ts"))
    span = settle(
        live.agg(
            F.min(stamped).alias("first_ts"),
            F.max(stamped).alias("last_ts"),
            F.coalesce(F.count_if((F.col("ts") != "") & includes(F.col("ts"))), F.lit(0)).alias("placed"),
        )
    )
    visible = totals.filter(span.select(F.col("placed") > 0).scalar()) if window.active else totals
    sized = (("calls", "calls"), ("context_bytes", "bytes"), ("image_bytes", "bytes"))
    metrics = [
        corpus_rows(
            visible.withColumn("tool_result_blocks", F.col("calls")), "tools", 0,
            [
                Measure("tool_use_blocks", F.col("uses"), "blocks"),
                Measure("tool_result_blocks", F.col("tool_result_blocks"), "blocks"),
                Measure("unanswered_uses", F.col("unanswered"), "blocks"),
                Measure("distinct_tools", F.col("distinct_tools"), "tools"),
                *_measures(*sized, ("image_results", "results")),
            ],
        ),
        corpus_rows(totals, "tools", 1, [Measure("unmatched_results", F.col("unmatched"), "blocks")]),
        unpivot(per_tool, "tools", 2, "tool", F.col("tool"), _measures(*sized), [F.coalesce("context_bytes", F.lit(0))]),
        unpivot(per_server, "tools", 3, "mcp_server", F.col("server"), _measures(*sized), [F.coalesce("context_bytes", F.lit(0))]),
    ]
    spark = scoped.sparkSession
    copies = collapsed.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n")).filter("n > 0")
    fixed = [
        ("unreported", "errors, produced and externalised bytes are not recorded here: unmeasured, not zero"),
        ("unattributed", "rent, skill calls and plugin ownership are not recorded here: unmeasured, not zero"),
    ]
    warnings = [
        warning_rows(
            spark.createDataFrame(fixed, "code string, text string"), "tools", "scope", F.col("text"), F.col("code")
        ),
        warning_rows(
            joined.filter("status = 'unmatched'"), "tools", "unmatched_result",
            _counted("session {}: result {} has no matching call", "session", "call_id"), F.col("call_id"),
        ),
        warning_rows(
            per_tool.filter("not text_known or not image_known"), "tools", "unmeasured_payload",
            _counted("{}: the size of some result could not be established", "tool"), F.col("tool"),
        ),
        warning_rows(
            item_rows.filter("kind = 'unsupported'").groupBy("item_type").agg(F.count(F.lit(1)).alias("n")),
            "tools", "unsupported_item",
            _counted("{} unsupported {} records excluded", "n", "item_type"), F.col("item_type"),
        ),
        warning_rows(
            item_rows.filter("kind = 'malformed'").agg(F.count(F.lit(1)).alias("n")).filter("n > 0"),
            "tools", "malformed_item", _counted("{} malformed tool records excluded", "n"),
        ),
        warning_rows(
            live.filter("is_unknown").groupBy("type").agg(F.count(F.lit(1)).alias("n")),
            "tools", "unknown_event", _counted("{} unknown {} events ignored", "n", "type"), F.col("type"),
        ),
        warning_rows(copies, "tools", "duplicates", _counted("{} identical copies counted once", "n")),
        warning_rows(
            item_rows.filter("kind = 'call' and is_orchestration").agg(F.count(F.lit(1)).alias("n")).filter("n > 0"),
            "tools", "orchestration", F.lit("orchestrated results belong to the outer tool"),
        ),
        warning_rows(
            quality.filter("unscoped_records > 0 or excluded_files > 0"), "tools", "unscoped",
            _counted("{} records without a session and {} files without a header excluded", "unscoped_records", "excluded_files"),
        ),
        warning_rows(
            quality.filter("invalid_times > 0"), "tools", "invalid_times",
            _counted("{} invalid timestamps treated as unavailable", "invalid_times"),
        ),
        warning_rows(
            quality.filter("parse_errors > 0"), "tools", "parse_errors",
            _counted("{} lines failed to decode", "parse_errors"),
        ),
    ]
    if errors is None:
        warnings.append(warning_rows(spark.range(1), "tools", "unchecked", F.lit("joins were not checked for ambiguity")))
    else:
        warnings += _ambiguities(errors, codex_ops.fold(rolled, "tool"))
    warnings.append(
        warning_rows(
            links.limit(1), "tools", "ancestry",
            F.lit("records belong to the session of their own header; history outside the corpus is not followed"),
        )
    )
    if window.active:
        warnings.append(
            warning_rows(
                live.filter("ts = ''").groupBy("type").agg(F.count(F.lit(1)).alias("n")),
                "tools", "untimestamped_type",
                _counted("{} {} events are undated and lie outside every window", "n", "type"), F.col("type"),
            )
        )
        warnings.append(
            warning_rows(
                spark.range(1), "tools", "window",
                F.lit("counts keep to the window, both ends in UTC included; bytes and results without a call do not"),
            )
        )
    header = quality.select(
        "files",
        listing_bytes.scalar().alias("bytes"),
        span.select("first_ts").scalar().alias("first_ts"),
        span.select("last_ts").scalar().alias("last_ts"),
    )
    return Envelope(
        "tools", stack_rows(metrics), stack_rows(warnings),
        run_header("tools", directory, version, window, header),
    )


def opencode_tools(
    parts: DataFrame,
    servers: DataFrame | None = None,
    window: TimeWindow = ALWAYS,
    version: str = __version__,
    directory: str = "",
    size: int = 0,
) -> Envelope:
    spark = parts.sparkSession
    rows = opencode_ops.tool_parts(parts)
    per_tool = settle(opencode_ops.by_tool(rows, window.includes_millis(F.col("ms"))))
    totals = settle(opencode_ops.totals(per_tool))
    stats = _measures(("calls", "calls"), ("context_bytes", "bytes"), ("errors", "calls"))
    weight = [F.col("context_bytes")]
    metrics = [
        corpus_rows(
            totals, "tools", 0,
            _measures(("distinct_tools", "tools")) + stats,
        ),
        unpivot(per_tool, "tools", 1, "tool", F.col("tool"), stats, weight),
    ]
    unmeasured = [
        ("image_bytes", "image bytes are not broken out here: unmeasured, not zero"),
        ("produced_bytes", "pre-truncation sizes are not recorded here: unmeasured, not zero"),
        ("joins", "this source stores calls together with their results, so match rates do not apply"),
    ]
    warnings = [
        warning_rows(
            spark.createDataFrame(unmeasured, "code string, text string"), "tools", "unrecorded",
            F.col("text"), F.col("code"),
        ),
        warning_rows(
            per_tool.filter("errors is null"), "tools", "unknown_status",
            _counted("errors is withheld for {}: no call status was recorded", "tool"), F.col("tool"),
        ),
        warning_rows(
            per_tool.filter("errors is null").limit(1), "tools", "unknown_status_total",
            F.lit("errors is withheld from the total: not every call has a status"),
        ),
    ]
    if servers is None:
        warnings.append(
            warning_rows(
                spark.range(1), "tools", "no_servers",
                F.lit("no server list was given: mcp_server rows are omitted, not zeroed"),
            )
        )
    else:
        per_server = opencode_ops.by_server(per_tool, servers)
        metrics.append(unpivot(per_server, "tools", 2, "mcp_server", F.col("server"), stats, weight))
        warnings.append(
            warning_rows(
                per_server.filter("errors is null"), "tools", "unknown_status_server",
                _counted("errors is withheld for server {}: a tool of it has calls without a status", "server"), F.col("server"),
            )
        )
    header = totals.select(
        F.lit(1).alias("files"),
        F.lit(size).alias("bytes"),
        millis_to_rfc3339(F.col("min_ms")).alias("first_ts"),
        millis_to_rfc3339(F.col("max_ms")).alias("last_ts"),
    )
    return Envelope(
        "tools", stack_rows(metrics), stack_rows(warnings),
        run_header("tools", directory, version, window, header),
    )


def opencode_doctor(
    files: DataFrame,
    parts: DataFrame,
    window: TimeWindow = ALWAYS,
    version: str = __version__,
    host: str = "",
) -> Envelope:
    skills = audit.front_matter(config.skill_files(files, opencode=True))
    merged = audit.merge_servers(config.opencode_server_entries(files))
    state = config.source_state(files, opencode=True)
    found = audit.skill_findings(skills).unionByName(audit.opencode_server_findings(merged))
    configured = merged.filter("is_winner").select(
        "host", "name", audit.is_disabled(F.col("spec")).alias("is_disabled")
    )
    seen = opencode_ops.observations(
        opencode_ops.tool_parts(parts), window.includes_millis(F.col("ms"))
    ).withColumn("host", F.lit(host))
    misses = settle(audit.join_configured_by_prefix(configured, seen))
    no_plugins = config.plugin_files(files.limit(0))
    per_host = audit.checked(skills, no_plugins, merged, state)
    denominators = audit.fleet_totals(per_host, ("skills_checked", "mcp_servers_checked"))
    sessions = settle(seen.agg(F.countDistinct("session").alias("tool_sessions")))
    visible = sessions.filter("tool_sessions > 0") if window.active else sessions
    metrics = [
        corpus_rows(
            denominators, "doctor", 0,
            _measures(("skills_checked", "skills"), ("mcp_servers_checked", "servers")),
        ),
        _host_rows(per_host, "skills_checked", "mcp_servers_checked"),
        unpivot(
            audit.findings_per_key(found), "doctor", 1, F.col("dimension"), _named("key"),
            _measures(("findings", "findings")),
        ),
        corpus_rows(visible, "doctor", 2, _measures(("tool_sessions", "sessions"))),
        unpivot(
            misses, "doctor", 3, "mcp_server", _named("key"),
            _measures(("never_observed", "sessions"), ("unconfigured_observed", "sessions")),
        ),
    ]
    warnings = [
        warning_rows(found, "doctor", "finding", _counted("{} {}: {}", "dimension", "key", "kind"), _named("key")),
        warning_rows(
            configured.filter("is_disabled"), "doctor", "disabled",
            _counted("{} is disabled: its silence is configuration at work", "name"), _named("name"),
        ),
        warning_rows(
            files.sparkSession.range(1), "doctor", "plugins_unavailable",
            F.lit("there is no plugin manifest to validate here: plugins_checked is omitted"),
        ),
        warning_rows(
            misses.filter("never_observed is not null"), "doctor", "never_observed",
            _counted("{} is configured but none of {} sessions names it", "key", "never_observed"),
            _named("key"),
        ),
        warning_rows(
            misses.filter("unconfigured_observed is not null"), "doctor", "unconfigured_observed",
            _counted("{} is used by {} sessions but no server name prefixes it", "key", "unconfigured_observed"),
            _named("key"),
        ),
        warning_rows(
            sessions.filter("tool_sessions = 0"), "doctor", "zero_denominator",
            F.lit("without any recorded call nothing can be said to be unused"),
        ),
        warning_rows(
            state.filter("is_partial"), "doctor", "partial_config",
            _counted("a server source of host {} is unreadable: its set is partial", "host"), F.col("host"),
        ),
        *_withheld(denominators, "skills_checked", "mcp_servers_checked"),
    ]
    sizes = files.filter("content is not null").agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"),
        F.lit("").alias("first_ts"),
        F.lit("").alias("last_ts"),
    )
    return Envelope(
        "doctor", stack_rows(metrics), stack_rows(warnings),
        run_header("doctor", "", version, window, sizes),
    )
