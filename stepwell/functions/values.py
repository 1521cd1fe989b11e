"""Fixed values of the event contract, and small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the contract.
STAGES = ["vpv", "signup_completed", "activation_completed", "subscription_started"]
EVENT_NAMES = ["vpv", "click", "signup_completed", "activation_completed", "subscription_started"]
ENVELOPE_FIELDS = [
    "event_id", "event_name", "occurred_at", "anonymous_id", "session_id", "user_id",
    "properties", "context", "schema_version", "tracking_plan_version", "funnel_definition_version", "consent",
]
ALLOWED_PROPERTIES = {
    "vpv": ["page_path"],
    "click": ["ui_name", "ui_type", "ui_surface"],
    "signup_completed": ["signup_method"],
    "activation_completed": ["activation_action"],
    "subscription_started": ["plan", "billing_interval", "acquisition_channel"],
}
REQUIRED_PROPERTIES = {
    "vpv": ["page_path"],
    "click": ["ui_name"],
    "signup_completed": [],
    "activation_completed": ["activation_action"],
    "subscription_started": ["plan", "billing_interval"],
}
SENSITIVE = "email|password|token|secret|card|address|content|query|referrer|title|html|text"
IDENTIFIER = r"\A[a-z][a-z0-9_]{1,63}\z"
WORKSPACE = r"\A[a-z][a-z0-9_-]{1,63}\z"
VERSION = "1.0.0"
UI_TYPES = ["button", "link", "menu_item"]
SIGNUP_METHODS = ["email", "google", "github", "sso"]
BILLING_INTERVALS = ["monthly", "yearly"]
STAGE_LABELS = ["First-party page view", "Signup completed", "Activation completed", "Subscription started"]
TOPIC = "accepted-events.v1"
FRESH_SECONDS = 300
# Fixed texts of the report and the dashboard.
UNHEALTHY_TEXT = "Funnel commentary is suppressed because no fresh accepted event is available."
EMPTY_TEXT = "No qualified first-party page views are available for the selected funnel."
DROP_TEXT = ("Largest observed drop-off is from ", " to ", " conversion).")
HEALTHY_HEAD, EVENT_TAIL = "Data SLA healthy · ", " accepted event"
NO_DATA_HEAD = "No accepted events yet · funnel commentary is suppressed"
STALE_HEAD = "Data SLA stale · funnel commentary is suppressed"
NO_STEP_TEXT = "No qualified stage transition yet."
STEP_TEXT = (" has the largest observed drop-off: ", " continue from the prior stage.")
PAUSED, CHANGED, EXPECTED, UNIFORM, PENDING = "Checks paused", "Change detected", "Within expected range", "Baseline too uniform", "Baseline pending"
# Fixed values of the serving contract.
SLA_STATES = ["healthy", "stale", "failed"]
MAX_SNAPSHOT_NAME = 128
MAX_BODY_BYTES = 65_536


#: A character that is no white space, Unicode's breaking spaces included.
NOT_BLANK = r"[^\s\x1c-\x1f\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]"


def not_blank(c: Column | str) -> Column:
    """Whether a text has more than white space; null for null."""
    return (F.col(c) if isinstance(c, str) else c).rlike(NOT_BLANK)


def utc(c: Column | str) -> Column:
    """An instant (timestamp) as a zoneless time in UTC, whatever the session's time zone."""
    return F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")


def instant_text(c: Column | str) -> Column:
    """An instant as ISO text in UTC: no fraction, or three or six digits."""
    at = utc(c)
    micros = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    digits = F.when(micros == 0, "").when(micros % 1000 == 0, F.date_format(at, ".SSS")).otherwise(F.date_format(at, ".SSSSSS"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), digits, F.lit("Z"))


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def stamp(c: Column | str) -> Column:
    """A timestamp as text with microseconds."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def round4(c: Column) -> Column:
    """Four decimals, ties upwards also below zero."""
    return F.floor(c * 10000 + 0.5) / 10000


def ratio(a: Column, b: Column) -> Column:
    """a / b rounded to four decimals; null without a denominator."""
    return F.when(b > 0, round4(a.cast("double") / b))


def percent(rate: Column) -> Column:
    """A rate of four decimals as a percentage with one, ties away from zero."""
    return F.concat(F.round(rate.cast("decimal(12,4)") * 100, 1).cast("decimal(12,1)").cast("string"), F.lit("%"))


def partition_key(workspace: Column | str, anonymous: Column | str) -> Column:
    """Length-prefixed, so that no two pairs give the same key."""
    return F.concat(F.length(workspace).cast("string"), F.lit(":"), F.col(workspace) if isinstance(workspace, str) else workspace, F.col(anonymous) if isinstance(anonymous, str) else anonymous)


def page_path(url: Column) -> Column:
    """The path of an absolute or relative URL: no query, no fragment, `/` if empty; null beyond 512 characters."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#][\s\S]*", ""), r"\A[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    path = F.when(F.length(path) == 0, "/").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.length(path) <= 512, path)


def stage_index(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), c) - 1
