"""Access-log lines to typed events, with a quarantine for bad lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom import schema
from trafficloom.fixed_values import DENIED_PREFIX, DENIED_STATUSES, MAX_LENGTHS, PARSE_FAILURE_ALARM
from trafficloom.functions.network import add_domain, is_ip
from trafficloom.functions.once import compute_once
from trafficloom.functions.text import WHITESPACE_CLASS, strip
from trafficloom.functions.timeparts import from_epoch_micros

FIELDS = (
    "raw_ts",
    "raw_duration",
    "raw_ip",
    "raw_action_status",
    "raw_bytes",
    "raw_method",
    "raw_url",
    "raw_user",
    "raw_hierarchy_peer",
    "raw_content_type",
)
_FLOAT = "^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_INT = "^[+-]?[0-9]+(?:_[0-9]+)*$"
# Years 1 to 9999.
_MIN_MICROS = -62_135_596_800_000_000
_END_MICROS = 253_402_300_800_000_000


def _int_or_zero(raw: Column, as_type: str) -> Column:
    grouped = F.when(raw.contains("_") & raw.rlike(_INT), F.translate(raw, "_", ""))
    return F.coalesce(raw.try_cast(as_type), grouped.try_cast(as_type), F.lit(0).cast(as_type))


def _dash_to_null(raw: Column) -> Column:
    return F.nullif(raw, F.lit("-"))


def tokenize(lines: DataFrame) -> DataFrame:
    """Ten whitespace-separated fields; the last keeps its inner whitespace as it was.

    Almost all lines are ASCII with plain spaces and need no wide character
    class. A last field with spaces is taken from the original line only where
    collapsing its whitespace changed it.
    """
    value = F.col("value")
    text = strip(value)
    plain = (F.octet_length(value) == F.char_length(value)) & ~value.rlike("[\\t-\\r\\x1c-\\x1f]")
    one_space = F.when(plain, F.regexp_replace(text, " {2,}", " ")).otherwise(
        F.regexp_replace(text, f"{WHITESPACE_CLASS}+", " ")
    )
    split = compute_once(lines, "tokens", F.split(one_space, " ", len(FIELDS)))
    fields = {name: F.get("tokens", F.lit(i)) for i, name in enumerate(FIELDS)}
    tail = fields.pop(FIELDS[-1])
    dark = f"[^{WHITESPACE_CLASS[1:-1]}]"
    original_tail = F.regexp_extract(text, f"(?s)^(?:{dark}+{WHITESPACE_CLASS}+){{9}}(.*)$", 1)
    spaced = tail.contains(" ")
    return split.select(
        *lines.columns,
        F.size("tokens").alias("n_fields"),
        *[column.alias(name) for name, column in fields.items()],
        F.when(spaced & ~text.endswith(tail), original_tail).otherwise(tail).alias(FIELDS[-1]),
        F.coalesce(spaced, F.lit(False)).alias("spaced_tail"),
    )


def _add_micros(tokens: DataFrame) -> DataFrame:
    """Epoch seconds as text to ``micros``, rounding half to even; NULL when invalid."""
    raw = F.col("raw_ts")
    seconds = tokens.withColumn("seconds", F.when(raw.rlike(_FLOAT), raw.try_cast("double")))
    in_reach = seconds.withColumn("seconds", F.when(F.abs("seconds") < 1e12, F.col("seconds")))
    parts = in_reach.withColumn("fraction", F.col("seconds") % F.lit(1.0))
    whole = (F.col("seconds") - F.col("fraction")).cast("long") * 1_000_000
    micros = parts.withColumn("micros", whole + F.rint(F.col("fraction") * 1e6).cast("long"))
    valid = (F.col("micros") >= _MIN_MICROS) & (F.col("micros") < _END_MICROS)
    return micros.withColumn("micros", F.when(valid, F.col("micros"))).drop("seconds", "fraction")


def _reject_reason() -> Column:
    shape_intact = F.col("raw_action_status").contains("/") & (
        F.col("raw_hierarchy_peer").contains("/") | (F.col("raw_hierarchy_peer") == "-")
    )
    return (
        F.when((F.col("n_fields") != len(FIELDS)) | (F.col("spaced_tail") & ~shape_intact), "field_count")
        .when(F.col("micros").isNull(), "timestamp")
        .when(~is_ip(F.col("raw_ip")), "client_ip")
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Every non-blank line with its event columns and a ``reject_reason`` (NULL when good).

    ``lines`` needs ``value`` and ``branch``; ``source_file`` is optional and
    makes ids differ between files.
    """
    kept = lines.where(strip(F.col("value")) != "")
    checked = compute_once(_add_micros(tokenize(kept)), "reject_reason", _reject_reason())
    source = [F.col("source_file")] if "source_file" in lines.columns else []

    action = F.substring_index("raw_action_status", "/", 1)
    hierarchy = F.substring_index("raw_hierarchy_peer", "/", 1)
    split = (
        checked.withColumn("full_action", action)
        .withColumn("raw_status", F.substring("raw_action_status", F.length("full_action") + 2, F.lit(2**31 - 1)))
        .withColumn("status_code", _int_or_zero(F.col("raw_status"), "int"))
        .withColumn("full_hierarchy", hierarchy)
        .withColumn("target", F.nullif("raw_url", F.lit("-")))
    )
    peer = F.substring("raw_hierarchy_peer", F.length("full_hierarchy") + 2, F.lit(2**31 - 1))
    has_peer = F.col("raw_hierarchy_peer").contains("/")

    def fitted(name: str, value: Column) -> Column:
        return F.left(value, F.lit(MAX_LENGTHS[name])).alias(name)

    return add_domain(split, "target", "raw_method", "full_domain").select(
        F.col("value").alias("line"),
        "reject_reason",
        F.xxhash64(*source, "branch", "value").alias("id"),
        from_epoch_micros(F.col("micros")).alias("timestamp"),
        _int_or_zero(F.col("raw_duration"), "long").alias("duration_ms"),
        F.col("raw_ip").alias("client_ip"),
        "branch",
        fitted("action", F.col("full_action")),
        "status_code",
        _int_or_zero(F.col("raw_bytes"), "long").alias("bytes"),
        fitted("method", F.col("raw_method")),
        F.col("raw_url").alias("url"),
        fitted("domain", F.col("full_domain")),
        fitted("user", _dash_to_null(F.col("raw_user"))),
        fitted("hierarchy", _dash_to_null(F.col("full_hierarchy"))),
        fitted("peer", F.when(has_peer, _dash_to_null(peer))),
        fitted("content_type", _dash_to_null(F.col("raw_content_type"))),
        (F.col("full_action").startswith(DENIED_PREFIX) | F.col("status_code").isin(*DENIED_STATUSES)).alias("blocked"),
    )


def parse_access_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects). No line is lost: rejects keep the line and the reason."""
    parsed = parse_lines(lines)
    events = parsed.where(F.col("reject_reason").isNull()).select(*schema.EVENT.names)
    rejects = parsed.where(F.col("reject_reason").isNotNull()).select("branch", "reject_reason", "line")
    return events, rejects


def parse_quality(lines: DataFrame, branches: DataFrame | None = None) -> DataFrame:
    """Lines seen and parsed per branch, failure rate (NULL without lines), alarm flag.

    ``branches`` (one ``branch`` column) adds configured branches that sent nothing.
    """
    counts = (
        parse_lines(lines)
        .groupBy("branch")
        .agg(
            F.count(F.lit(1)).alias("lines_seen"),
            F.count_if(F.col("reject_reason").isNull()).alias("lines_parsed"),
        )
    )
    if branches is not None:
        counts = branches.join(counts, "branch", "left").select(
            "branch",
            *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("lines_seen", "lines_parsed")],
        )
    rate = F.round(1 - F.try_divide(F.col("lines_parsed"), F.nullif(F.col("lines_seen"), F.lit(0))), 3)
    return counts.withColumn("failure_rate", rate).withColumn(
        "alarm", F.coalesce(F.col("failure_rate") >= PARSE_FAILURE_ALARM, F.lit(False))
    )
