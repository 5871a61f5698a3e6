"""The registered queries: every operator over whole tables, with the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglane.functions.text import dice
from loglane.operators import aggregates as ag
from loglane.operators import drift as dr
from loglane.operators import filters as fl
from loglane.operators import grouping as gr
from loglane.operators import ordered as od
from loglane.operators import rules
from loglane.operators import transforms as tf
from loglane.plans import views as v
from loglane.plans.lineage import ensure_checkpoint_dir
from loglane.sources import archive, combine, sinks, snapshots, text as text_source
from loglane.streaming import stateful, steps, windows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Times without zone are read as UTC throughout.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = v.with_views(sql)
        return fn

    return add


def simple(name: str, view, op: Callable[[DataFrame], DataFrame], sql: str | None, *columns: str) -> None:
    """A query of one operator on one view."""
    query(name, sql)(lambda spark, folder: op(view(spark, folder)).select(*(columns or "*")))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, for queries that write and read back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/loglane-{uuid.uuid4().hex}"


NORM = v.sql_norm()
SEQ = "ORDER BY seq"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

# --- the pipeline of the command-line tool: merge, mark drift, print ---------------------------------


@query(
    "render",
    f"""SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || service
        || repeat(' ', greatest(0, 15 - length(service))) || ' ' || text
        || CASE WHEN row_number() OVER (PARTITION BY {NORM} {SEQ}) = 1 THEN ' [DRIFT]' ELSE '' END AS output
        FROM logs_msg""",
)
def render(spark, folder):
    return tf.render(dr.drift(v.logs_msg(spark, folder))).select("seq", "output")


simple(
    "drift_uniq", v.logs_msg, dr.drift,
    f"SELECT seq, service, text, row_number() OVER (PARTITION BY {NORM} {SEQ}) = 1 AS drift FROM logs_msg",
    "seq", "service", "text", "drift",
)
simple(
    "drift_uniq_doc_lines", v.doc_lines, dr.drift,
    f"SELECT seq, row_number() OVER (PARTITION BY {NORM} {SEQ}) = 1 AS drift FROM doc_lines",
    "seq", "drift",
)
simple(
    "drift_none", v.logs_msg, lambda df: dr.drift(df, "none"), "SELECT seq, false AS drift FROM logs_msg", "seq", "drift"
)
simple(
    "drift_other_services", v.logs_msg, lambda df: dr.drift(df, scope="other_services"),
    f"""WITH n AS (SELECT seq, service, {NORM} AS norm FROM logs_msg),
        f AS (SELECT norm, service, min(seq) AS s FROM n GROUP BY ALL)
        SELECT n.seq, NOT EXISTS (SELECT 1 FROM f WHERE f.norm = n.norm AND f.service <> n.service
        AND f.s < n.seq) AS drift FROM n""",
    "seq", "drift",
)

_FUZZY = """WITH d AS (SELECT {norm} AS norm, min(seq) AS s FROM {view} GROUP BY 1),
    g AS (SELECT s, substr(h, 2 * i + 1, 4) AS g, count(*) AS c
          FROM (SELECT s, hex(encode(norm)) AS h, unnest(range(0, strlen(norm) - 1)) AS i FROM d) GROUP BY ALL),
    c AS (SELECT s, count(*) AS d FROM g GROUP BY s),
    shared AS (SELECT a.s AS a, b.s AS b, sum(least(a.c, b.c)) AS n FROM g a JOIN g b ON a.g = b.g AND b.s < a.s GROUP BY ALL),
    known AS (SELECT DISTINCT a FROM shared JOIN c ca ON ca.s = a JOIN c cb ON cb.s = b
              WHERE (2 * n)::DOUBLE / (ca.d + cb.d)::DOUBLE >= {threshold})
    SELECT seq, seq IN (SELECT s FROM d) AND seq NOT IN (SELECT a FROM known) AS drift FROM {view}"""
simple(
    "drift_fuzzy", v.logs, lambda df: dr.drift(df, "fuzzy", 0.8),
    _FUZZY.format(norm=NORM, view="logs", threshold=0.8), "seq", "drift",
)
# The same, in two steps: against the first 200 forms, and what is left against all.
_FUZZY_MANY = """WITH d AS MATERIALIZED (SELECT {norm} AS norm, min(seq) AS s FROM {view} GROUP BY 1),
    g AS MATERIALIZED (SELECT s, substr(h, 2 * i + 1, 4) AS g, count(*) AS c
          FROM (SELECT s, hex(encode(norm)) AS h, unnest(range(0, strlen(norm) - 1)) AS i FROM d) GROUP BY ALL),
    c AS MATERIALIZED (SELECT s, count(*) AS d FROM g GROUP BY s),
    few AS (SELECT s FROM c ORDER BY s LIMIT 200),
    near AS (SELECT a.s AS a, b.s AS b, sum(least(a.c, b.c)) AS n FROM g a JOIN (SELECT * FROM g WHERE s IN (FROM few)) b
             ON a.g = b.g AND b.s < a.s GROUP BY ALL),
    early AS MATERIALIZED (SELECT DISTINCT a FROM near JOIN c ca ON ca.s = a JOIN c cb ON cb.s = b
              WHERE (2 * n)::DOUBLE / (ca.d + cb.d)::DOUBLE >= {threshold}),
    rest AS (SELECT a.s AS a, b.s AS b, sum(least(a.c, b.c)) AS n FROM (SELECT * FROM g WHERE s NOT IN (FROM early)) a JOIN g b
             ON a.g = b.g AND b.s < a.s GROUP BY ALL),
    known AS (FROM early UNION SELECT a FROM rest JOIN c ca ON ca.s = a JOIN c cb ON cb.s = b
              WHERE (2 * n)::DOUBLE / (ca.d + cb.d)::DOUBLE >= {threshold})
    SELECT seq, seq IN (SELECT s FROM d) AND seq NOT IN (SELECT a FROM known) AS drift FROM {view}"""
simple(
    "drift_fuzzy_logs_msg", v.logs_msg, lambda df: dr.drift(df, "fuzzy", 0.8),
    _FUZZY_MANY.format(norm=NORM, view="logs_msg", threshold=0.8), "seq", "drift",
)
simple(
    "drift_fuzzy_doc_lines", v.doc_lines, lambda df: dr.drift(df, "fuzzy", 0.8),
    _FUZZY_MANY.format(norm=NORM, view="doc_lines", threshold=0.8), "seq", "drift",
)
simple(
    "drift_fuzzy_turns", v.turns, lambda df: dr.drift(df, "fuzzy", 0.9),
    _FUZZY.format(norm=NORM, view="turns", threshold=0.9), "seq", "drift",
)


@query(
    "similarity",
    f"""WITH p AS (SELECT seq, {NORM} AS a, lag({NORM}) OVER (PARTITION BY service {SEQ}) AS b FROM logs_msg),
        q AS (SELECT * FROM p WHERE b IS NOT NULL),
        ga AS (SELECT seq, substr(a, i, 2) AS g, count(*) AS c FROM (SELECT seq, a, unnest(range(1, length(a))) AS i FROM q) GROUP BY ALL),
        gb AS (SELECT seq, substr(b, i, 2) AS g, count(*) AS c FROM (SELECT seq, b, unnest(range(1, length(b))) AS i FROM q) GROUP BY ALL),
        s AS (SELECT ga.seq, sum(least(ga.c, gb.c)) AS n FROM ga JOIN gb ON ga.seq = gb.seq AND ga.g = gb.g GROUP BY 1),
        d AS (SELECT seq, count(*) AS n FROM (SELECT seq, g, 1 AS x FROM ga UNION ALL SELECT seq, g, 2 FROM gb) GROUP BY 1)
        SELECT q.seq, CAST(round(1e6 * CASE WHEN a = b THEN 1.0
          ELSE (2 * coalesce(s.n, 0))::DOUBLE / d.n::DOUBLE END) AS BIGINT) AS score
        FROM q LEFT JOIN s ON s.seq = q.seq JOIN d ON d.seq = q.seq""",
)
def similarity(spark, folder):
    """Each line against the line before it in its service."""
    df = tf.with_normal_form(v.logs_msg(spark, folder))
    df = od.with_previous(df, F.col("norm"), "before").filter(F.col("before").isNotNull())
    score = F.round(dice(F.col("norm"), F.col("before")) * 1_000_000).cast("bigint")
    return df.select("seq", score.alias("score"))


simple(
    "normal_form", v.doc_lines, tf.with_normal_form, f"SELECT seq, {NORM} AS norm FROM doc_lines", "seq", "norm"
)

# --- filters ------------------------------------------------------------------------------------------

simple(
    "filter_incl_excl", v.logs_msg, lambda df: fl.include_exclude(df, ["user=1", "^ERROR"], [r"k=9\d?$"]),
    r"""SELECT seq, service, text FROM logs_msg WHERE (regexp_matches(text, 'user=1') OR regexp_matches(text, '^ERROR'))
        AND NOT regexp_matches(text, 'k=9\d?$')""",
    "seq", "service", "text",
)
simple(
    "grep", v.logs_msg, lambda df: fl.grep(df, [r"(?i)error.*k=(?P<k>\d)$", "^[[:upper:]]+ user=1[[:digit:]] "]),
    r"""SELECT seq, service, text FROM logs_msg WHERE regexp_matches(text, '(?i)error.*k=(?P<k>\d)$')
        OR regexp_matches(text, '^[[:upper:]]+ user=1[[:digit:]] ')""",
    "seq", "service", "text",
)
simple(
    "grep_invert", v.logs_msg, lambda df: fl.grep(df, ["DEBUG", "INFO"], invert=True),
    "SELECT seq, service, text FROM logs_msg WHERE NOT regexp_matches(text, 'DEBUG|INFO')",
    "seq", "service", "text",
)
simple(
    "grep_doc_lines", v.doc_lines, lambda df: fl.grep(df, [r"\b[[:alpha:]]{3}\.$", r"(?i)ÉT"]),
    r"""SELECT seq, service FROM doc_lines WHERE regexp_matches(text, '\b[[:alpha:]]{3}\.$')
        OR regexp_matches(text, '(?i)ÉT')""",
    "seq", "service",
)
simple(
    "level_filter", v.logs_msg, lambda df: fl.level_filter(df, "warn"),
    """SELECT seq, service, text FROM logs_msg WHERE contains(upper(text), 'ERROR') OR contains(upper(text), 'WARN')""",
    "seq", "service", "text",
)
simple(
    "since", v.stamped, lambda df: fl.since(df, datetime(2024, 1, 15, 12, 0, 0)),
    """SELECT seq, service, text FROM stamped WHERE service NOT IN ('error', 'purchase', 'signup')
        OR date_trunc('second', ts) >= TIMESTAMP '2024-01-15 12:00:00'""",
    "seq", "service", "text",
)
simple(
    "since_relative", v.stamped, lambda df: fl.since(df, "2h45m", now=datetime(2024, 1, 15, 14, 45)),
    """SELECT seq, service, text FROM stamped WHERE service NOT IN ('error', 'purchase', 'signup')
        OR date_trunc('second', ts) >= TIMESTAMP '2024-01-15 12:00:00'""",
    "seq", "service", "text",
)
simple(
    "predicate", v.logs_msg, lambda df: fl.where(df, F.length("text") > 17),
    "SELECT seq, service, text FROM logs_msg WHERE length(text) > 17", "seq", "service", "text",
)

_GATE = """WITH t AS (SELECT *, regexp_matches(text, '{0}') AS o, regexp_matches(text, '{1}') AS c FROM logs_msg),
    u AS (SELECT *, coalesce(last_value(CASE WHEN c THEN false WHEN o THEN true END IGNORE NULLS)
    OVER ({3} ORDER BY seq {2}), false) AS was FROM t)
    SELECT seq, service, text FROM u WHERE was OR o"""
simple(
    "gate", v.logs_msg, lambda df: od.gate(df, "ERROR user=1", "k=5"), _GATE.format("ERROR user=1", "k=5", BEFORE, ""),
    "seq", "service", "text",
)
simple(
    "gate_per_service", v.logs_msg, lambda df: od.gate(df, "ERROR", "k=7$", per_service=True),
    _GATE.format("ERROR", "k=7$", BEFORE, "PARTITION BY service"), "seq", "service", "text",
)

_RANKED = """SELECT seq, service, text FROM (SELECT *, row_number() OVER ({}) AS r FROM {}) WHERE {}"""
_SVC = "PARTITION BY service ORDER BY seq"
simple("head", v.logs, lambda df: od.head(df, 25), _RANKED.format(_SVC, "logs", "r <= 25"), "seq", "service", "text")
simple(
    "ceiling", v.doc_lines, lambda df: od.ceiling(df, 500), _RANKED.format(_SVC, "doc_lines", "r <= 500"),
    "seq", "service", "text",
)
simple(
    "last_n", v.logs, lambda df: od.last_n(df, 30), _RANKED.format(_SVC + " DESC", "logs", "r <= 30"),
    "seq", "service", "text",
)
simple("services", v.logs, od.services, "SELECT service, count(*) AS count FROM logs GROUP BY 1")
simple(
    "sample_per_service", v.logs_msg, lambda df: od.sample_per_service(df, 7),
    _RANKED.format(_SVC, "logs_msg", "r % 7 = 0"), "seq", "service", "text",
)
simple(
    "sample_overall", v.logs_msg, lambda df: od.sample_overall(df, 11),
    _RANKED.format("ORDER BY seq", "logs_msg", "r % 11 = 0"), "seq", "service", "text",
)
simple(
    "dedupe", v.logs, od.dedupe,
    f"""SELECT seq, service, text FROM (SELECT *, lag(text) OVER ({_SVC}) AS p FROM logs) WHERE p IS NULL OR p <> text""",
    "seq", "service", "text",
)
simple(
    "dedupe_doc_lines", v.doc_lines, od.dedupe,
    f"""SELECT seq, service, text FROM (SELECT *, lag(text) OVER ({_SVC}) AS p FROM doc_lines) WHERE p IS NULL OR p <> text""",
    "seq", "service", "text",
)
_SUPPRESS = f"""WITH c AS (SELECT *, CASE WHEN lag(text) OVER ({_SVC}) = text THEN 0 ELSE 1 END AS n FROM {{0}}),
        r AS (SELECT *, sum(n) OVER ({_SVC}) AS run FROM c),
        k AS (SELECT *, row_number() OVER (PARTITION BY service, run ORDER BY seq) AS rn FROM r)
        SELECT seq, service, text FROM k WHERE rn <= 2"""
_DEBOUNCE = """WITH p AS (SELECT *, lag(text) OVER w AS pt, lag(ts) OVER w AS pts FROM {0}
            WINDOW w AS (PARTITION BY service ORDER BY ts, seq))
        SELECT seq, service, text FROM p WHERE pt IS NULL OR pt <> text OR ts - pts >= INTERVAL {1}"""
simple(
    "suppress", v.logs, lambda df: od.suppress(df, 2), _SUPPRESS.format("logs"), "seq", "service", "text",
)
simple(
    "suppress_doc_lines", v.doc_lines, lambda df: od.suppress(df, 2), _SUPPRESS.format("doc_lines"), "seq", "service", "text",
)
simple(
    "debounce", v.logs, lambda df: od.debounce(df, "30 minutes"), _DEBOUNCE.format("logs", "30 MINUTE"), "seq", "service", "text",
)
simple(
    "debounce_doc_lines", v.doc_lines, lambda df: od.debounce(df, 2), _DEBOUNCE.format("doc_lines", "2 SECOND"), "seq", "service", "text",
)

# --- line by line ----------------------------------------------------------------------------------------

simple("prefix", v.logs_msg, lambda df: tf.prefix(df, "[app] "), "SELECT seq, '[app] ' || text AS text FROM logs_msg", "seq", "text")
simple("indent", v.doc_lines, tf.indent, "SELECT seq, '  ' || text AS text FROM doc_lines", "seq", "text")
simple("bracket", v.logs_msg, lambda df: tf.bracket(df, "<", ">"), "SELECT seq, '<' || text || '>' AS text FROM logs_msg", "seq", "text")
simple(
    "normalize", v.doc_lines, lambda df: tf.normalize(df, trim=True, collapse_spaces=True, lowercase=True),
    f"""SELECT seq, lower(regexp_replace({v.TRIM.format('text')}, '\\s+', ' ', 'g')) AS text FROM doc_lines""",
    "seq", "text",
)
simple(
    "strip", lambda s, f: tf.highlight(v.doc_lines(s, f), [("e", "31")]), lambda df: tf.strip(df, ansi=True, whitespace=True),
    f"SELECT seq, {v.TRIM.format('text')} AS text FROM doc_lines", "seq", "text",
)
simple(
    "strip_colours", lambda s, f: tf.highlight(v.logs_msg(s, f), [("[A-Z]+", "31;1")]), tf.strip_colours,
    "SELECT seq, text FROM logs_msg", "seq", "text",
)
simple(
    "mask", v.logs_msg, lambda df: tf.mask(df, [r"user=\d+", r"\d+$"]),
    r"""SELECT seq, regexp_replace(regexp_replace(text, 'user=\d+', '[MASKED]', 'g'), '\d+$', '[MASKED]', 'g') AS text FROM logs_msg""",
    "seq", "text",
)
simple(
    "mask_empty_matches", v.doc_lines, lambda df: tf.mask(df, ["[aeiou]*", r"(?i)t?\b"], "_"),
    r"""SELECT seq, regexp_replace(regexp_replace(text, '[aeiou]*', '_', 'g'), '(?i)t?\b', '_', 'g') AS text FROM doc_lines""",
    "seq", "text",
)
simple(
    "redact", v.doc_lines,
    lambda df: tf.redact(df, [(r"(?P<name>[\w.]+)@([\w.]+)", "<${2}>"), (r"(\d\d)\d+", "$1#$$"), (r"\bthe\b", "$nope")]),
    r"""SELECT seq, regexp_replace(regexp_replace(regexp_replace(text, '([\w.]+)@([\w.]+)', '<\2>', 'g'),
        '(\d\d)\d+', '\1#$', 'g'), '\bthe\b', '', 'g') AS text FROM doc_lines""",
    "seq", "text",
)
simple(
    "truncate", v.doc_lines, lambda df: tf.truncate(df, 40),
    """SELECT seq, CASE WHEN strlen(text) <= 40 THEN text ELSE
        left(text, list_max(list_filter(range(0, 41), lambda n: strlen(left(text, n)) <= 40))) || '...' END AS text FROM doc_lines""",
    "seq", "text",
)

_BYTES = f"coalesce(sum(strlen(text) + 1) OVER (PARTITION BY service ORDER BY seq {BEFORE}), 0)::BIGINT"
simple(
    "byte_offset", v.doc_lines, od.with_byte_offset, f"SELECT seq, service, {_BYTES} AS \"offset\" FROM doc_lines",
    "seq", "service", "offset",
)
simple(
    "stamp_offset", v.logs_msg, od.stamp_offset,
    f"""SELECT seq, '[' || CASE WHEN length(o) < 10 THEN lpad(o, 10, '0') ELSE o END || '] ' || text AS text
        FROM (SELECT seq, text, {_BYTES}::VARCHAR AS o FROM logs_msg)""",
    "seq", "text",
)
simple(
    "final_offsets", v.doc_lines, od.final_offsets,
    "SELECT service, sum(strlen(text) + 1)::BIGINT AS \"offset\" FROM doc_lines GROUP BY 1",
)
simple(
    "line_number", v.doc_lines, lambda df: od.line_number(df, 3),
    f"""SELECT seq, CASE WHEN length(n) < 3 THEN lpad(n, 3, '0') ELSE n END || ' ' || text AS text
        FROM (SELECT seq, text, (row_number() OVER ({_SVC}))::VARCHAR AS n FROM doc_lines)""",
    "seq", "text",
)
simple(
    "sequence", v.logs_msg, od.sequence,
    "SELECT seq, text || ' [#' || row_number() OVER (ORDER BY seq) || ']' AS text FROM logs_msg", "seq", "text",
)
simple("current_sequence", v.logs_msg, od.current_sequence, "SELECT count(*) AS current FROM logs_msg")
simple(
    "timestamp_rfc3339", v.logs_msg, tf.stamp_time,
    "SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || text AS text FROM logs_msg", "seq", "text",
)
simple(
    "timestamp_unix", v.logs_msg, lambda df: tf.stamp_time(df, "unix"),
    "SELECT seq, (epoch_us(ts) // 1000000) || ' ' || text AS text FROM logs_msg", "seq", "text",
)
simple(
    "timestamp_kitchen", v.logs_msg, lambda df: tf.stamp_time(df, "kitchen"),
    "SELECT seq, strftime(ts, '%-I:%M%p') || ' ' || text AS text FROM logs_msg", "seq", "text",
)
simple(
    "timestamp_relative", v.logs_msg, lambda df: tf.stamp_time(df, "relative", started=datetime(2024, 1, 1)),
    """WITH d AS (SELECT seq, text, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS ms FROM logs_msg)
        SELECT seq, '+' || CASE WHEN ms = 0 THEN '0s' WHEN ms < 1000 THEN ms || 'ms' ELSE
        CASE WHEN ms >= 3600000 THEN (ms // 3600000) || 'h' ELSE '' END ||
        CASE WHEN ms >= 60000 THEN (ms // 60000 % 60) || 'm' ELSE '' END || (ms // 1000 % 60) ||
        CASE WHEN ms % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad((ms % 1000)::VARCHAR, 3, '0'), '0') END || 's' END
        || ' ' || text AS text FROM d""",
    "seq", "text",
)
simple(
    "line_format", v.logs_msg, lambda df: tf.line_format(df, "{time} {service}: {text} ({service})"),
    "SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || service || ': ' || text || ' (' || service || ')' AS text FROM logs_msg",
    "seq", "text",
)
simple(
    "columns", v.logs_msg, lambda df: tf.columns(df, " ", [8, 6]),
    """WITH p AS (SELECT seq, string_split(text, ' ') AS p FROM logs_msg)
        SELECT seq, p[1] || repeat(' ', greatest(0, 8 - length(p[1]))) || p[2] || repeat(' ', greatest(0, 6 - length(p[2])))
        || ' ' || p[3] AS text FROM p""",
    "seq", "text",
)
simple(
    "columns_doc_lines", v.doc_lines, lambda df: tf.columns(df, ", ", [30]),
    """WITH p AS (SELECT seq, string_split(text, ', ') AS p FROM doc_lines)
        SELECT seq, p[1] || repeat(' ', greatest(0, 30 - length(p[1]))) ||
        CASE WHEN len(p) > 1 THEN ', ' || array_to_string(p[2:], ', ') ELSE '' END AS text FROM p""",
    "seq", "text",
)
simple(
    "mark_matches", v.logs_msg, lambda df: tf.highlight(df, [("ERROR|WARN", "31"), (r"\d+", "36")]),
    r"""SELECT seq, regexp_replace(regexp_replace(text, '(ERROR|WARN)', chr(27) || '[31m\1' || chr(27) || '[0m', 'g'),
        '(\d+)', chr(27) || '[36m\1' || chr(27) || '[0m', 'g') AS text FROM logs_msg""",
    "seq", "text",
)
simple(
    "service_index", v.logs_msg, od.with_service_index,
    """WITH f AS (SELECT service, row_number() OVER (ORDER BY min(seq)) - 1 AS index FROM logs_msg GROUP BY 1)
        SELECT seq, service, index FROM logs_msg JOIN f USING (service)""",
    "seq", "service", "index",
)
simple(
    "mark_service", v.logs_msg, od.mark_service,
    f"""WITH f AS (SELECT service, row_number() OVER (ORDER BY min(seq)) - 1 AS i FROM logs_msg GROUP BY 1)
        SELECT seq, chr(27) || '[' || {list(od.PALETTE)}[i % 7 + 1] || 'm' || text || chr(27) || '[0m' AS text
        FROM logs_msg JOIN f USING (service)""",
    "seq", "text",
)


def _field(name: str):
    return F.col("fields")[name].alias(name)


simple(
    "extract_kv", v.logs_msg, lambda df: tf.extract_fields(df, ["user", "k", "none"]).select("seq", _field("user"), _field("k"), _field("none")),
    r"""SELECT seq, regexp_extract(text, 'user=(\S+)', 1) AS user, regexp_extract(text, 'k=(\S+)', 1) AS k,
        NULL::VARCHAR AS none FROM logs_msg""",
)
simple(
    "extract_json", v.logs, lambda df: tf.extract_fields(df, ["k", "none"], json=True).select("seq", _field("k"), _field("none")),
    "SELECT seq, json_extract_string(text, '$.k') AS k, NULL::VARCHAR AS none FROM logs",
)
simple(
    "annotate_fields", v.logs_msg, lambda df: tf.annotate_fields(df, ["k", "user"]),
    r"""SELECT seq, 'k=' || regexp_extract(text, 'k=(\S+)', 1) || ' user=' || regexp_extract(text, 'user=(\S+)', 1)
        || ' ' || text AS text FROM logs_msg""",
    "seq", "text",
)
simple(
    "json_pretty", v.logs, tf.json_pretty,
    r"""SELECT seq, '{' || chr(10) || '  "k": ' || json_extract_string(text, '$.k') || chr(10) || '}' AS text FROM logs""",
    "seq", "text",
)
simple(
    "parse_json", v.logs, tf.parse_json, "SELECT seq, json_valid(text) AS is_json FROM logs", "seq", "is_json"
)



def _odd_json(spark, folder):
    """A repeated key, text after the end, a list, and the text as it is, by turns."""
    text, turn = F.col("text"), F.col("seq") % 4
    odd = F.when(turn == 0, F.concat(F.lit('{"k": 0, '), F.substr("text", F.lit(2)))).when(turn == 1, F.concat(text, F.lit(" x")))
    return v.logs(spark, folder).withColumn("text", odd.when(turn == 2, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text))


simple("parse_json_odd", _odd_json, tf.parse_json, "SELECT seq, seq % 4 <> 1 AS is_json FROM logs", "seq", "is_json")
simple(
    "extract_json_odd", _odd_json, lambda df: tf.extract_fields(df, ["k"], json=True).select("seq", _field("k")),
    "SELECT seq, CASE WHEN seq % 4 IN (0, 3) THEN json_extract_string(text, '$.k') END AS k FROM logs",
)

# --- counts ------------------------------------------------------------------------------------------------

simple(
    "window_counts", v.logs, lambda df: ag.window_counts(df, "6 hours"),
    """SELECT service AS key, count(*) AS count, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end
        FROM logs GROUP BY service, window_end""",
)
simple("line_counts", v.logs_msg, ag.line_counts, "SELECT service, count(*) AS count FROM logs_msg GROUP BY 1")
simple(
    "line_count", v.logs_msg, lambda df: ag.line_count(df, "svc3"),
    "SELECT count(*) AS count FROM logs_msg WHERE service = 'svc3'",
)
_TOP = """SELECT service, text AS line, count, rank FROM (SELECT service, text, count(*) AS count,
    row_number() OVER (PARTITION BY service ORDER BY count(*) DESC, text)::INTEGER AS rank FROM {} GROUP BY 1, 2) WHERE rank <= {}"""
simple("top_lines", v.logs, lambda df: ag.top_lines(df, 5), _TOP.format("logs", 5))
simple("top_doc_lines", v.doc_lines, lambda df: ag.top_lines(df, 20), _TOP.format("doc_lines", 20))

RULES = [("errors", "^ERROR"), ("user1x", r"user=1\d\b"), ("small", r"k=\d$")]
_RULES_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, service, text AS line, seq, ts FROM logs_msg WHERE regexp_matches(text, '{p}')" for n, p in RULES
)
simple("alerts", v.logs_msg, lambda df: ag.alerts(df, RULES), f"SELECT rule, service, line, seq FROM ({_RULES_SQL})", "rule", "service", "line", "seq")
simple(
    "alert_counts", v.logs_msg, lambda df: ag.alert_counts(df, RULES, "1 day"),
    f"""SELECT rule, service, count(*) AS count, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end
        FROM ({_RULES_SQL}) GROUP BY rule, service, window_end""",
)


def _rules(spark, folder):
    """A rule for each pair of user and number that occurs, two alternatives for each user, and two without a literal."""
    pairs = tf.extract_fields(v.logs_msg(spark, folder), ["user", "k"]).select("fields.user", "fields.k").distinct()
    users = pairs.select("user").distinct()
    line, of_user = F.concat(F.lit("user="), "user"), F.concat(F.lit("^ERROR user="), "user", F.lit(r"\b|^WARN user="), "user", F.lit(" k"))
    single = pairs.select(F.concat(F.lit("u"), "user", F.lit("k"), "k").alias("rule"), F.concat(line, F.lit(r" [a-z]="), "k", F.lit("$")).alias("pattern"))
    alike = spark.createDataFrame([("level", r"^(?:ERROR|INFO) \D+\d+ "), ("case", "(?i)^warn")], "rule string, pattern string")
    return single.unionByName(users.select(F.concat(F.lit("bad"), "user").alias("rule"), of_user.alias("pattern"))).unionByName(alike)


@query(
    "table_alerts",
    r"""WITH p AS (SELECT seq, service, text, regexp_extract(text, 'user=(\d+)', 1) AS u, regexp_extract(text, 'k=(\d+)', 1) AS k FROM logs_msg)
        SELECT 'u' || u || 'k' || k AS rule, service, text AS line, seq FROM p
        UNION ALL SELECT 'bad' || u, service, text, seq FROM p WHERE text LIKE 'ERROR%' OR text LIKE 'WARN%'
        UNION ALL SELECT 'level', service, text, seq FROM p WHERE text LIKE 'ERROR%' OR text LIKE 'INFO%'
        UNION ALL SELECT 'case', service, text, seq FROM p WHERE text LIKE 'WARN%'""",
)
def table_alerts(spark, folder):
    """Some thousand rules against all lines."""
    return rules.table_alerts(v.logs_msg(spark, folder), _rules(spark, folder))


_ROLL = "count(*) OVER (PARTITION BY service ORDER BY ts RANGE BETWEEN INTERVAL {} PRECEDING AND CURRENT ROW) AS count"
simple(
    "rolling_count", v.logs, lambda df: ag.rolling_count(df, "6 hours"),
    f"SELECT seq, service, {_ROLL.format('6 HOUR')} FROM logs", "seq", "service", "count",
)
simple(
    "rolling_count_ties", v.bursts, lambda df: ag.rolling_count(df, "3 hours"),
    f"SELECT seq, service, {_ROLL.format('3 HOUR')} FROM bursts", "seq", "service", "count",
)
simple(
    "count_at", v.logs, lambda df: ag.count_at(df, datetime(2024, 1, 20), "2 days"),
    """SELECT service, count(*) AS count FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-18' AND TIMESTAMP '2024-01-20' GROUP BY 1""",
)

# --- several lines into one -----------------------------------------------------------------------------------

_RUNS = """WITH c AS (SELECT *, CASE WHEN lag(service) OVER (ORDER BY seq) IS NULL OR lag(service) OVER (ORDER BY seq) = ''
        OR lag(service) OVER (ORDER BY seq) = service THEN 0 ELSE 1 END AS n FROM {0}),
    r AS (SELECT *, sum(n) OVER (ORDER BY seq) AS run FROM c),
    b AS (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY seq) - 1) // {2} AS block FROM r)
    SELECT max(seq) AS seq, max(service) AS service, max(ts) AS ts, string_agg(text, '{1}' ORDER BY seq) AS text FROM b GROUP BY run, block"""
simple("join_runs", v.turns, lambda df: gr.join_runs(df, " / ", 3), _RUNS.format("turns", " / ", 3))
simple("join_runs_doc_lines", v.doc_lines, lambda df: gr.join_runs(df, "+", 50), _RUNS.format("doc_lines", "+", 50))

_MULTI = """WITH s AS (SELECT *, regexp_matches(text, '{1}') AS st FROM {0}),
    r AS (SELECT *, max(CASE WHEN st THEN seq END) OVER ({2} ORDER BY seq) AS rec,
          first_value(ts) OVER ({2} ORDER BY seq) AS t0 FROM s),
    h AS (SELECT r.*, coalesce(b.ts, t0) AS hts, {4} AS hsvc FROM r LEFT JOIN {0} b ON b.seq = r.rec),
    l AS (SELECT *, ts >= hts + INTERVAL {3} AS late FROM h)
    SELECT min(seq) AS seq, hsvc AS service, string_agg(text, chr(10) ORDER BY seq) AS text, min(hts) AS ts
    FROM l GROUP BY {5}rec, late, hsvc"""
simple(
    "multiline", v.doc_lines, lambda df: gr.multiline(df, r"^[A-Z].*\.$", "2 seconds"),
    _MULTI.format("doc_lines", r"^[A-Z].*\.$", "", "2 SECOND", "coalesce(b.service, '')", ""),
)
simple(
    "multiline_per_service", v.logs_msg, lambda df: gr.multiline(df, "^ERROR", "3 hours", per_service=True),
    _MULTI.format("logs_msg", "^ERROR", "PARTITION BY service", "3 HOUR", "r.service", "service, "),
)
_BURST = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL {1} THEN 1 ELSE 0 END AS n FROM {0}
        WINDOW w AS (PARTITION BY service ORDER BY ts, seq)),
    b AS (SELECT *, sum(n) OVER (PARTITION BY service ORDER BY ts, seq) AS burst FROM g)
    SELECT arg_min(seq, (ts, seq)) AS seq, service, string_agg(text, ' | ' ORDER BY ts, seq) AS text, min(ts) AS ts FROM b GROUP BY service, burst"""
simple("coalesce_bursts", v.logs, lambda df: gr.coalesce_bursts(df, "20 minutes"), _BURST.format("logs", "20 MINUTE"))
simple("coalesce_bursts_ties", v.bursts, lambda df: gr.coalesce_bursts(df, "1 hour"), _BURST.format("bursts", "1 HOUR"))
simple(
    "reorder", v.logs,
    lambda df: od.reorder(df, "6 hours", lambda t: F.timestamp_seconds(F.get_json_object(t, "$.k").cast("bigint"))),
    """WITH s AS (SELECT *, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM logs)) // 21600000000 AS slot,
        json_extract_string(text, '$.k')::BIGINT AS sec FROM logs)
        SELECT row_number() OVER (ORDER BY slot, sec, seq) AS seq, seq AS arrival_seq, service, text FROM s""",
    "seq", "arrival_seq", "service", "text",
)


def _flat(df: DataFrame) -> DataFrame:
    """Batches as one row each, with what identifies their lines."""
    lines = F.col("lines")
    return df.select(
        "batch_id",
        F.size(lines).cast("bigint").alias("n"),
        F.array_join(F.transform(lines, lambda x: x["seq"].cast("string")), ",").alias("seqs"),
    )


simple(
    "batch_size", v.logs, lambda df: _flat(gr.batches(df, 64)),
    """SELECT (r - 1) // 64 * 64 + 1 AS batch_id, count(*) AS n, string_agg(seq, ',' ORDER BY seq) AS seqs
        FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS r FROM logs) GROUP BY 1""",
)
simple(
    "batch_interval", v.logs, lambda df: _flat(gr.batches(df, 40, "2 hours", block_rows=1000)),
    """WITH RECURSIVE l AS (SELECT seq, ts, row_number() OVER (ORDER BY seq) AS r FROM logs),
        nxt AS MATERIALIZED (SELECT r, r + least(40, count(*) OVER (ORDER BY ts
                RANGE BETWEEN CURRENT ROW AND INTERVAL 7199999999 MICROSECOND FOLLOWING)) AS n FROM l),
        starts(r) AS (SELECT 1::BIGINT UNION ALL SELECT nxt.n FROM starts JOIN nxt ON nxt.r = starts.r),
        m AS (SELECT l.seq, max(s.r) OVER (ORDER BY l.r) AS batch_id FROM l LEFT JOIN starts s ON s.r = l.r)
        SELECT batch_id, count(*) AS n, string_agg(seq, ',' ORDER BY seq) AS seqs FROM m GROUP BY 1""",
)
_PACE = """WITH p AS (SELECT seq, service, epoch_us(ts) AS us, row_number() OVER ({0} ORDER BY seq) AS r FROM {1}),
    m AS (SELECT *, (max(us * 1000 - r * {2}) OVER ({0} ORDER BY seq) + r * {2}) // 1000 AS paced FROM p)
    SELECT seq, make_timestamp(paced) AS paced_ts, paced - us AS delay_us FROM m"""
simple(
    "pace", v.bursts, lambda df: od.pace(df, 3), _PACE.format("", "bursts", 333333333), "seq", "paced_ts", "delay_us"
)
simple(
    "pace_per_service", v.bursts, lambda df: od.pace(df, 1, per_service=True),
    _PACE.format("PARTITION BY service", "bursts", 1000000000), "seq", "paced_ts", "delay_us",
)

# --- baseline and two services -------------------------------------------------------------------------------------


def _halves(spark, folder):
    df = v.logs_msg(spark, folder)
    middle = df.agg(F.floor((F.min("seq") + F.max("seq")) / 2)).scalar()
    return df.filter(F.col("seq") <= middle), df.filter(F.col("seq") > middle)


_HALVES = f"""WITH m AS (SELECT (min(seq) + max(seq)) // 2 AS m FROM logs_msg),
    a AS (SELECT DISTINCT service, {NORM} AS norm FROM logs_msg, m WHERE OLD m)
    SELECT seq, service, text FROM logs_msg l, m WHERE NEW m
    AND NOT EXISTS (SELECT 1 FROM a WHERE a.service = l.service AND a.norm = {v.sql_norm('l.text')})"""


@query("baseline_drift", _HALVES.replace("OLD", "seq <=").replace("NEW", "seq >"))
def baseline_drift(spark, folder):
    baseline, current = _halves(spark, folder)
    return dr.baseline_drift(current, baseline).select("seq", "service", "text")


@query("baseline_gone", _HALVES.replace("OLD", "seq >").replace("NEW", "seq <="))
def baseline_gone(spark, folder):
    baseline, current = _halves(spark, folder)
    return dr.baseline_drift(baseline, current).select("seq", "service", "text")


simple(
    "two_service_diff", v.logs_msg,
    lambda df: dr.two_service_diff(df, "svc1", "svc2", datetime(2024, 1, 10), by_ts=True),
    f"""WITH c AS (SELECT {NORM} AS norm, count(*) FILTER (service = 'svc1') AS left_count, count(*) FILTER (service = 'svc2') AS right_count
        FROM logs_msg WHERE service IN ('svc1', 'svc2') AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
        SELECT *, CASE WHEN right_count = 0 THEN 'left' WHEN left_count = 0 THEN 'right' ELSE 'both' END AS side FROM c""",
)

simple(
    "two_service_diff_relative", v.logs_msg,
    lambda df: dr.two_service_diff(df, "svc1", "svc2", "240h", by_ts=True, now=datetime(2024, 1, 25)),
    f"""WITH c AS (SELECT {NORM} AS norm, count(*) FILTER (service = 'svc1') AS left_count, count(*) FILTER (service = 'svc2') AS right_count
        FROM logs_msg WHERE service IN ('svc1', 'svc2') AND ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
        SELECT *, CASE WHEN right_count = 0 THEN 'left' WHEN left_count = 0 THEN 'right' ELSE 'both' END AS side FROM c""",
)

# --- sources and sinks ------------------------------------------------------------------------------------------------

BUCKETS = [("errors", "^ERROR"), ("slow", "k=9"), ("people", "user=1")]
simple(
    "route", v.logs_msg, lambda df: fl.route(df, BUCKETS, "other", wanted=["errors", "slow", "other"]),
    """SELECT seq, bucket FROM (SELECT seq, CASE WHEN regexp_matches(text, '^ERROR') THEN 'errors'
        WHEN regexp_matches(text, 'k=9') THEN 'slow' WHEN regexp_matches(text, 'user=1') THEN 'people' ELSE 'other' END AS bucket
        FROM logs_msg) WHERE bucket <> 'people'""",
    "seq", "bucket",
)


@query(
    "merge_label",
    """SELECT 'chat' AS service, seq, text FROM turns UNION ALL SELECT 'events', seq, text FROM logs
       UNION ALL SELECT 'docs', seq, text FROM doc_lines""",
)
def merge_label(spark, folder):
    parts = {"chat": v.turns, "events": v.logs, "docs": v.doc_lines}
    return combine.label_all({n: view(spark, folder) for n, view in parts.items()}).select("service", "seq", "text")


@query(
    "fan_out",
    """SELECT service, count(*) AS count, sum(strlen(text) + 1)::BIGINT AS "offset" FROM logs_msg GROUP BY 1""",
)
def fan_out(spark, folder):
    counts, sizes = combine.fan_out(v.logs_msg(spark, folder), ag.line_counts, od.final_offsets)
    return counts.join(sizes, "service")


@query("snapshot_roundtrip", "SELECT service, text AS line, count(*) AS n FROM logs_msg GROUP BY ALL")
def snapshot_roundtrip(spark, folder):
    path = scratch(spark) + "/snapshot"
    snapshots.save_snapshot(v.logs_msg(spark, folder), path)
    return snapshots.load_snapshot(spark, path).groupBy("service", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "checkpoint_resume",
    f"""WITH m AS (SELECT (min(seq) + max(seq)) // 2 AS m FROM doc_lines),
        o AS (SELECT *, {_BYTES} AS o FROM doc_lines),
        c AS (SELECT service, sum(strlen(text) + 1) AS done FROM doc_lines, m WHERE seq <= m GROUP BY 1)
        SELECT seq, o.service, text FROM o LEFT JOIN c ON c.service = o.service WHERE o.o >= coalesce(done, 0)""",
)
def checkpoint_resume(spark, folder):
    """Read half of the lines, store how far, then read the rest."""
    df = v.doc_lines(spark, folder)
    middle = df.agg(F.floor((F.min("seq") + F.max("seq")) / 2)).scalar()
    done = od.final_offsets(df.filter(F.col("seq") <= middle))
    path = scratch(spark) + "/offsets"
    snapshots.save_checkpoint(snapshots.set_offsets(snapshots.empty_checkpoint(spark), done), path, 1)
    return snapshots.resume(df, snapshots.load_checkpoint(spark, path)).select("seq", "service", "text")


@query(
    "archive_resume",
    f"""WITH m AS (SELECT (min(seq) + max(seq)) // 2 AS m FROM doc_lines),
        o AS (SELECT *, {_BYTES} AS o FROM doc_lines),
        c AS (SELECT service, sum(strlen(text) + 1) AS done FROM doc_lines, m WHERE seq <= m AND service <> 'en' GROUP BY 1)
        SELECT seq, o.service, text, o.o AS "offset" FROM o LEFT JOIN c ON c.service = o.service WHERE o.o >= coalesce(done, 0)""",
)
def archive_resume(spark, folder):
    """Keep all lines in two rounds, store how far one service less than all was read in the first, and read the rest."""
    df = v.doc_lines(spark, folder)
    middle = df.agg(F.floor((F.min("seq") + F.max("seq")) / 2)).scalar()
    path = scratch(spark) + "/archive"
    archive.append_lines(df.filter(F.col("seq") <= middle), path, 0)
    archive.append_lines(df.filter(F.col("seq") > middle), path, 1)
    done = od.final_offsets(df.filter((F.col("seq") <= middle) & (F.col("service") != "en")))
    stored = snapshots.set_offsets(snapshots.empty_checkpoint(spark), done)
    return archive.resume_lines(spark, path, stored).select("seq", "service", "text", "offset")


@query(
    "write_buckets",
    """SELECT seq, service, text, CASE WHEN regexp_matches(text, '^ERROR') THEN 'errors' WHEN regexp_matches(text, 'k=9') THEN 'slow'
        WHEN regexp_matches(text, 'user=1') THEN 'people' ELSE 'other' END AS bucket FROM logs_msg""",
)
def write_buckets(spark, folder):
    """Lines written under the folder of their bucket, by a stream, and read back."""
    base = scratch(spark)
    sinks.stream_buckets(_stream(spark, folder, v.logs_msg), BUCKETS, f"{base}/out", f"{base}/checkpoint", "other").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("seq", "service", "text", "bucket")


@query("stream_snapshot", "SELECT service, text AS line, ts AS captured_at, count(*) AS n FROM logs_msg GROUP BY ALL")
def stream_snapshot(spark, folder):
    """The lines of a stream as a snapshot, read back."""
    base = scratch(spark)
    snapshots.stream_snapshot(_stream(spark, folder, v.logs_msg), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    rows = snapshots.load_snapshot(spark, f"{base}/out").withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))
    return rows.groupBy("service", "line", "captured_at").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_source",
    f"""SELECT service, text, row_number() OVER ({_SVC}) AS place FROM logs_msg""",
)
def read_text(spark, folder):
    """Lines written as text files, a folder per service, and read back in order."""
    df = v.logs_msg(spark, folder)
    path = scratch(spark) + "/lines"
    out = df.repartitionByRange("service", "seq").sortWithinPartitions("service", "seq")
    out.select("service", "text").write.partitionBy("service").text(path)
    names = [r[0] for r in df.select("service").distinct().collect()]
    lines = text_source.read_logs(spark, {n: f"{path}/service={n}" for n in sorted(names)})
    placed, _ = od.with_position(lines, ["seq"], "service", name="place")
    return placed.select("service", "text", "place")


# --- streams ---------------------------------------------------------------------------------------------------------


# Lines of one micro-batch of a registered stream, about, and the fewest batches.
BATCH_LINES = 250_000
LEAST_BATCHES = 5


def _stream(spark, folder, view) -> DataFrame:
    """All lines of a view as a stream of several files, in order of ``seq``, one in each micro-batch."""
    base = scratch(spark)
    path = f"{base}/source"
    # The view's order is cut where its rows are about evenly dealt.
    df = view(spark, folder).select("seq", "service", "text", "ts")
    number = max(LEAST_BATCHES, -(-df.count() // BATCH_LINES))
    cuts = df.select(F.percentile_approx("seq", [i / number for i in range(1, number)], 10 * number)).first()[0] or []
    # The view is read once more, whatever the number of batches, and its lines dealt to them; then each batch is written
    # in its turn, as the source takes files by age. Large numbers that are one as doubles stay in one batch.
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) < 3:
        df.coalesce(1).write.parquet(path)
    else:
        keyed = df.filter(F.col("seq").isNotNull()).withColumn("__seq", F.col("seq").cast("double"))
        dealt = Bucketizer(splits=splits, inputCol="__seq", outputCol="__part").transform(keyed)
        dealt = dealt.drop("__seq").withColumn("part", F.col("__part").cast("int")).drop("__part")
        dealt.repartitionById(len(splits) - 1, "part").write.partitionBy("part").parquet(f"{base}/dealt")
        parts = spark.read.parquet(f"{base}/dealt").select("part").distinct().collect()
        for part in sorted(r["part"] for r in parts):
            spark.read.schema(df.schema).parquet(f"{base}/dealt/part={part}").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run_step(spark, folder, view, step: steps.StreamStep, newest: bool = False) -> DataFrame:
    base = scratch(spark)
    stateful.run(
        _stream(spark, folder, view), step.step, output=f"{base}/out", state=f"{base}/state",
        checkpoint=f"{base}/checkpoint", names=step.names,
    ).awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    if newest:
        last = out.agg(F.max("batch")).first()[0]
        out = out.filter(F.col("batch") == last)
    out = out.drop("batch")
    if step.end is not None:
        out = out.unionByName(stateful.finish(spark, step.end, state=f"{base}/state", names=step.names))
    return out


def stream_step(name: str, step: Callable[[], steps.StreamStep], view, sql: str, *columns: str, flat=None, newest=False) -> None:
    """A step over a whole view in micro-batches; the same SQL as the query of the whole, by name or given."""

    def run(spark, folder):
        out = _run_step(spark, folder, view, step(), newest)
        return flat(out) if flat else out.select(*columns)

    # Views are put in front of SQL that is given; that of a registered query has them.
    query(name, None if sql in ORACLE else sql)(run)
    ORACLE.setdefault(name, ORACLE.get(sql, ""))


LINE = ("seq", "service", "text")
stream_step("stream_dedupe", steps.dedupe, v.logs, "dedupe", *LINE)
stream_step("stream_suppress", lambda: steps.suppress(2), v.logs, "suppress", *LINE)
stream_step("stream_debounce", lambda: steps.debounce("30 minutes"), v.logs, "debounce", *LINE)
stream_step("stream_head", lambda: steps.head(25), v.logs, "head", *LINE)
stream_step("stream_last_n", lambda: steps.last_n(30), v.logs, "last_n", *LINE, newest=True)
stream_step("stream_gate", lambda: steps.gate("ERROR user=1", "k=5"), v.logs_msg, "gate", *LINE)
stream_step("stream_sample_per_service", lambda: steps.sample_per_service(7), v.logs_msg, "sample_per_service", *LINE)
stream_step("stream_sample_overall", lambda: steps.sample_overall(11), v.logs_msg, "sample_overall", *LINE)
stream_step("stream_byte_offset", steps.byte_offset, v.doc_lines, "byte_offset", "seq", "service", "offset")
stream_step("stream_line_number", lambda: steps.line_number(3), v.doc_lines, "line_number", "seq", "text")
stream_step("stream_sequence", steps.sequence, v.logs_msg, "sequence", "seq", "text")
stream_step("stream_pace", lambda: steps.pace(3), v.bursts, "pace", "seq", "paced_ts", "delay_us")
stream_step("stream_join_runs", lambda: steps.join_runs(" / ", 3), v.turns, _RUNS.format("turns", " / ", 3), *LINE, "ts")
stream_step("stream_batches", lambda: steps.batches(64), v.logs, "batch_size", flat=_flat)
stream_step(
    "stream_drift", steps.drift, v.logs,
    f"SELECT seq, service, text, row_number() OVER (PARTITION BY {NORM} {SEQ}) = 1 AS drift FROM logs", *LINE, "drift",
)
stream_step("stream_drift_fuzzy", lambda: steps.drift("fuzzy", 0.8), v.logs, "drift_fuzzy", "seq", "drift")
stream_step(
    "stream_multiline", lambda: steps.multiline('"k": 1', "2 hours"), v.logs,
    _MULTI.format("logs", '"k": 1', "", "2 HOUR", "coalesce(b.service, '')", ""), *LINE, "ts",
)


@query(
    "stream_window_counts",
    """SELECT service AS key, count(*) AS count, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end
       FROM logs GROUP BY ALL""",
)
def stream_window_counts(spark, folder):
    """All windows: an end mark after the last line closes those still open."""
    base = scratch(spark)
    source = _stream(spark, folder, lambda s, f: windows.with_end(v.logs(s, f), "7 hours"))
    counts = windows.window_counts(source, "6 hours", "1 hour")
    writer = counts.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(counts.schema).parquet(f"{base}/out").filter(F.col("key") != windows.END)
    return out.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))
