"""Validation of raw events: the first failing rule gives the reason code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import (
    ALLOWED_PROPERTIES, BILLING_INTERVALS, ENVELOPE_FIELDS, EVENT_NAMES, IDENTIFIER, MAX_BODY_BYTES, REQUIRED_PROPERTIES, SENSITIVE, SIGNUP_METHODS, TOPIC, UI_TYPES, VERSION, WORKSPACE, instant_text, not_blank, partition_key, utc,
)

INSTANT = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:\d\d)\z"


#: Objects inside an event; each is taken from the parsed event once, as a map from key to value.
OBJECTS = ("consent", "context", "properties")
#: Parts in which rejected requests are dealt.
SPREAD = 4096


class _Paths:
    """Columns for the kinds and texts of JSON paths, at most one object deep, each computed once for a row."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}

    def object(self, name: str = "root") -> Column:
        """The event's or an inner object's values by key; null if it is no object."""
        return F.col(f"_map_{name}")

    def kind(self, path: str) -> Column:
        """STRING, BOOLEAN, OBJECT<…>, … or null where the path is absent."""
        return F.col(f"_kind{self.at.setdefault(path, len(self.at))}")

    def value(self, path: str) -> Column:
        self.kind(path)
        return F.col(f"_value{self.at[path]}")

    def text(self, path: str) -> Column:
        """A value only if it is a JSON string."""
        self.kind(path)
        return F.col(f"_text{self.at[path]}")

    def add(self, df: DataFrame, raw: str) -> DataFrame:
        as_map = lambda c: F.try_variant_get(c, "$", "map<string,variant>")
        df = df.withColumn("_json", F.try_parse_json(raw)).withColumn("_map_root", as_map(F.col("_json")))
        df = df.withColumns({f"_map_{name}": as_map(F.element_at("_map_root", name)) for name in OBJECTS})
        places = {k: p.removeprefix("$.").split(".") for p, k in self.at.items()}
        df = df.withColumns({f"_value{k}": F.element_at(self.object(p[0] if len(p) > 1 else "root"), p[-1]) for k, p in places.items()})
        df = df.withColumns({f"_kind{k}": F.schema_of_variant(f"_value{k}") for k in places})
        return df.withColumns({f"_text{k}": F.when(F.col(f"_kind{k}") == "STRING", F.try_variant_get(f"_value{k}", "$", "string")) for k in places})

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop("_json", "_map_root", *[f"_map_{name}" for name in OBJECTS], *[f"_{x}{k}" for k in self.at.values() for x in ("value", "kind", "text")])


def last_value(raw: Column | str, name: str) -> Column:
    """The text of a field of a JSON object, of a repeated field the last one: an object's text keeps the order of its keys."""
    return F.from_json(raw, f"`{name}` string")[name]


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def follows(value: Column, kind: Column, values: Column) -> Column:
    """Whether a text keeps a rule of a tracking plan: identifier, path, or one of its values; null for a null text."""
    path_ok = value.startswith("/") & ~value.contains("?") & ~value.contains("#") & (F.length(value) <= 512)
    return F.when(kind == "identifier", value.rlike(IDENTIFIER)).when(kind == "path", path_ok).when(kind == "one_of", F.array_contains(values, value))


def with_reason(df: DataFrame, raw_name: str, received_name: str, name_out: str, server_fields: tuple[str, ...] = (), plan_name: str | None = None) -> DataFrame:
    """Adds the reason code of raw events, null for accepted ones. The time of receipt is an instant (timestamp).

    A text that is no JSON gives invalid_json. Of a repeated key the last value counts, at every level and also for the
    order of the properties; for that a setting of the session is turned on and stays on, as is one on the size of generated code. Checks go envelope, name, ids, versions, consent and context, time, then properties in document
    order, required ones and values. With `plan_name`, a column with the tracking plan of each row (see registry), events,
    properties and value rules are those of the plan, and a null plan is a contract version that is not supported.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # the JVM never compiles a method over 8000 bytes, and the whole stage of these columns is one: beyond it Spark makes small ones
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    raw, received_at, paths = F.col(raw_name), F.col(received_name), _Paths()
    # keys from the parsed value, but for the properties, whose order in the text counts
    extra = lambda name, allowed: F.size(F.array_except(F.map_keys(paths.object(name)), _array(allowed))) > 0
    is_object = lambda name: paths.object(name).isNotNull()
    name = paths.text("$.event_name")
    id_ok = lambda path: F.coalesce(F.length(paths.text(path)).between(16, 128), F.lit(False))
    version_ok = lambda f: F.coalesce(paths.text(f"$.{f}") == VERSION, F.lit(False))
    consent = is_object("consent") & F.coalesce((paths.kind("$.consent.analytics") == "BOOLEAN") & F.try_variant_get(paths.value("$.consent.analytics"), "$", "boolean"), F.lit(False)) & ~F.coalesce(extra("consent", ["analytics"]), F.lit(False))
    # any scalar counts as its text, also a null
    version = F.try_variant_get(paths.value("$.context.sdk_version"), "$", "string")
    sdk = F.coalesce((paths.kind("$.context.sdk_version") == "VOID") | (~paths.kind("$.context.sdk_version").rlike("^(OBJECT|ARRAY)") & not_blank(version)), F.lit(False))
    context = is_object("context") & F.coalesce(paths.text("$.context.platform") == "web", F.lit(False)) & sdk & ~F.coalesce(extra("context", ["platform", "sdk_version"]), F.lit(False))
    occurred = paths.text("$.occurred_at")
    instant = F.when(occurred.rlike(INSTANT), F.try_to_timestamp(occurred))
    in_time = F.coalesce((instant <= received_at + F.expr("interval 5 minutes")) & (instant >= received_at - F.expr("interval 365 days")), F.lit(False))

    fixed = plan_name is None
    event = None if fixed else F.try_element_at(F.col(plan_name), name)
    allowed = F.lit(None).cast("array<string>") if fixed else event["allowed"]
    for e, names in ALLOWED_PROPERTIES.items() if fixed else ():
        allowed = F.when(name == e, _array(names)).otherwise(allowed)
    by_key = F.transform(
        F.json_object_keys(last_value(raw, "properties")),
        lambda k: F.when(k.rlike(f"(?i){SENSITIVE}"), "sensitive_property").when(~F.array_contains("_allowed", k), "unallowed_property").when(~F.coalesce(F.schema_of_variant(F.element_at(paths.object("properties"), k)) == "STRING", F.lit(False)), "invalid_property_type"),
    )
    property_reason = F.get(F.filter(by_key, lambda r: r.isNotNull()), F.lit(0))
    prop = lambda p: paths.text(f"$.properties.{p}")
    in_plan = lambda p: F.when(F.schema_of_variant(F.element_at(paths.object("properties"), p)) == "STRING", F.try_variant_get(F.element_at(paths.object("properties"), p), "$", "string"))
    missing = F.lit(False) if fixed else F.exists(event["required"], lambda p: in_plan(p).isNull())
    for e, names in REQUIRED_PROPERTIES.items() if fixed else ():
        for p in names:
            missing = missing | ((name == e) & prop(p).isNull())
    if fixed:
        ident = lambda p: F.coalesce(prop(p).rlike(IDENTIFIER), F.lit(True))
        one_of = lambda p, values: F.coalesce(prop(p).isin(values), F.lit(True))
        path = prop("page_path")
        path_ok = path.startswith("/") & ~path.contains("?") & ~path.contains("#") & (F.length(path) <= 512)
        value_reason = (
            F.when((name == "vpv") & ~path_ok, "invalid_page_path")
            .when((name == "click") & ~(ident("ui_name") & ident("ui_surface") & one_of("ui_type", UI_TYPES)), "invalid_ui_component")
            .when((name == "activation_completed") & ~ident("activation_action"), "invalid_activation_action")
            .when((name == "subscription_started") & ~(ident("plan") & ident("acquisition_channel") & one_of("billing_interval", BILLING_INTERVALS)), "invalid_subscription_properties")
            .when((name == "signup_completed") & ~one_of("signup_method", SIGNUP_METHODS), "invalid_signup_method")
        )
    else:
        broken = F.filter(event["rules"], lambda r: ~F.coalesce(follows(in_plan(r["property"]), r["kind"], r["values"]), F.lit(True)))
        value_reason = F.get(broken, F.lit(0))["reason"]
    supported = F.coalesce(name.isin(EVENT_NAMES), F.lit(False)) if fixed else F.coalesce(F.col(plan_name).isNull() | event.isNotNull(), F.lit(False)) & name.isNotNull()
    plan_ok = version_ok("tracking_plan_version") if fixed else F.col(plan_name).isNotNull()
    code = (
        F.when(F.col("_json").isNull(), "invalid_json")
        .when(~is_object("root"), "invalid_payload")
        .when(extra("root", [*ENVELOPE_FIELDS, *server_fields]), "unallowed_envelope_field")
        .when(~supported, "unsupported_event_name")
        .when(~(id_ok("$.event_id") & id_ok("$.anonymous_id") & id_ok("$.session_id")), "invalid_identifier")
        .when(paths.kind("$.user_id").isNotNull() & ~id_ok("$.user_id"), "invalid_identifier")
        .when(~(version_ok("schema_version") & plan_ok & version_ok("funnel_definition_version")), "unsupported_contract_version")
        .when(~(consent & context), "invalid_context_or_consent")
        .when(occurred.isNull(), "missing_occurred_at")
        .when(~in_time, "invalid_event_time")
        .when(~is_object("properties"), "invalid_properties")
        .otherwise(F.coalesce(property_reason, F.when(missing, "missing_required_property"), value_reason))
    )
    # A generator of one row: the code is computed once, and no filter on it is moved below with a copy of all of this.
    rows = paths.add(df, raw_name).withColumn("_allowed", allowed)
    return paths.drop(rows.select("*", F.inline(F.array(F.struct(code.alias(name_out)))))).drop("_allowed")


def validate(df: DataFrame, raw: str = "raw", received_at: str = "received_at") -> DataFrame:
    """Adds `reason`, null for accepted events, and event_time_quality for those."""
    out = with_reason(df, raw, received_at, "reason")
    return out.withColumn("event_time_quality", F.when(F.col("reason").isNull(), "client_verified"))


def accepted(df: DataFrame) -> DataFrame:
    return validate(df).where("reason is null")


def accepted_violations(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `violation`: what an accepted event breaks of its contract, null if nothing.

    It must have the server's fields, and be what the validator accepts at its time of receipt.
    """
    time, quality = (F.get_json_object(F.col(raw), f"$.{name}") for name in ("received_at", "event_time_quality"))
    rows = df.withColumn("_received", F.when(time.rlike(INSTANT), F.try_to_timestamp(time)))
    rows = with_reason(rows, raw, "_received", "_reason", ("received_at", "event_time_quality"))
    server = F.when(F.col("_received").isNull(), "invalid_received_at").when(~quality.eqNullSafe(F.lit("client_verified")), "invalid_event_time_quality")
    broken = F.col("_reason").isin("invalid_json", "invalid_payload")
    return rows.withColumn("violation", F.when(broken, F.col("_reason")).otherwise(F.coalesce(server, F.col("_reason")))).drop("_received", "_reason")


def event_time(df: DataFrame, raw: str = "raw", received_at: str = "received_at", policy: str = "quarantine") -> DataFrame:
    """Adds outcome and event_time_quality: events whose only fault is their time are set apart, or get the server's time.

    outcome is accepted, rejected, or (policy quarantine) quarantined; policy server_assigned accepts these with the time
    of receipt. The quality is client_verified, quarantined or server_assigned.
    """
    if policy not in ("quarantine", "server_assigned"):
        raise ValueError("policy is quarantine or server_assigned")
    out = with_reason(df, raw, received_at, "reason")
    untimed = F.coalesce(F.col("reason").isin("missing_occurred_at", "invalid_event_time"), F.lit(False))
    other = "quarantined" if policy == "quarantine" else "server_assigned"
    quality = F.when(F.col("reason").isNull(), "client_verified").when(untimed, other)
    outcome = F.when(F.col("reason").isNull(), "accepted").when(untimed, "quarantined" if policy == "quarantine" else "accepted").otherwise("rejected")
    return out.withColumns({"outcome": outcome, "event_time_quality": quality})


def ingest(requests: DataFrame, keys: DataFrame, known: DataFrame | None = None, storage_available: bool = True) -> DataFrame:
    """HTTP outcome of requests (method, workspace_key, body, received_at).

    Returns workspace_id, body, received_at, status, reason, accepted, event_id, duplicate and accepted_json (the body
    with the time of receipt and its quality). keys (workspace_key, workspace_id) must have a row per key, else it raises.
    Order: method, key, size, JSON, validator, storage. An accepted event is a duplicate if `known` (workspace_id,
    event_id) has it, or if an earlier request of these brought it.
    """
    if keys.groupBy("workspace_key").count().where("count > 1").limit(1).count():
        raise ValueError("a workspace key names more than one workspace")
    rows = with_reason(requests.join(keys, "workspace_key", "left"), "body", "received_at", "_reason")
    outcomes = [
        (F.col("method") != "POST", 405, F.lit("method_not_allowed")),
        (F.coalesce(F.length("workspace_key") < 8, F.lit(True)) | F.col("workspace_id").isNull(), 401, F.lit("invalid_workspace_key")),
        (F.octet_length("body") > MAX_BODY_BYTES, 413, F.lit("payload_too_large")),
        (F.col("_reason") == "invalid_json", 400, F.lit("invalid_json")),
        (F.col("_reason").isNotNull(), 422, F.col("_reason")),
        (F.lit(not storage_available), 503, F.lit("storage_unavailable")),
    ]
    status, why = F.lit(202), F.lit(None).cast("string")
    for when, code, name in reversed(outcomes):
        status, why = F.when(when, code).otherwise(status), F.when(when, name).otherwise(why)
    rows = rows.select("workspace_id", "body", "received_at", status.alias("status"), why.alias("reason"), (status == 202).alias("accepted"))
    rows = rows.withColumn("event_id", F.when(F.col("accepted"), last_value("body", "event_id")))
    # one pass: other rows need no rank, and are spread so that they do not meet under their null id
    spread = F.when(~F.col("accepted"), F.monotonically_increasing_id() % SPREAD)
    first = Window.partitionBy("workspace_id", "event_id", "_spread").orderBy("received_at", "body")
    rows = rows.withColumn("_spread", spread).withColumn("duplicate", F.when(F.col("accepted"), F.row_number().over(first) > 1)).drop("_spread")
    if known is not None:
        old = known.select("workspace_id", "event_id").distinct().withColumn("_old", F.lit(True))
        rows = rows.join(old, ["workspace_id", "event_id"], "left").withColumn("duplicate", F.when(F.col("accepted"), F.col("duplicate") | F.col("_old").isNotNull())).drop("_old")
    added = F.concat(F.lit(',"received_at":"'), instant_text("received_at"), F.lit('","event_time_quality":"client_verified"}'))
    rows = rows.withColumn("accepted_json", F.when(F.col("accepted"), F.concat(F.regexp_replace("body", r"\}\s*\z", ""), added)))
    return rows.select("workspace_id", "body", "received_at", "status", "reason", "accepted", "event_id", "duplicate", "accepted_json")


#: Fields of an event that a log record must have as text.
EVENT_TEXTS = ("event_id", "anonymous_id", "event_name", "schema_version", "tracking_plan_version", "funnel_definition_version", "occurred_at", "received_at")


def parse_envelope(df: DataFrame, value: str = "value") -> DataFrame:
    """The typed columns of event-log records {workspace_id, event}, times zoneless in UTC; null where a required text is missing.

    A record is read once, and its event once more, also where rows are filtered afterwards; of repeated keys the last one counts.
    """
    rows = df.withColumn("_record", F.from_json(value, "workspace_id string, event string"))
    rows = rows.withColumn("_event", F.from_json("_record.event", ", ".join(f"{n} string" for n in EVENT_TEXTS)))
    text = lambda c: F.when(not_blank(c), F.col(c))
    time = lambda c: utc(F.when(F.col(c).rlike(INSTANT), F.try_to_timestamp(c)))
    texts = [text(f"_event.{n}").alias(n) for n in EVENT_TEXTS[:-2]]
    times = [time(f"_event.{n}").alias(n) for n in EVENT_TEXTS[-2:]]
    fields = F.struct(text("_record.workspace_id").alias("workspace_id"), *texts, *times, F.col("_record.event").alias("accepted_event_json"))
    # A generator of one row, as in with_reason: a filter on the reason would else be moved below with a reading of the record for each field.
    return rows.select(*df.columns, F.inline(F.array(fields)))


def dead_letter_reason(parsed: DataFrame) -> DataFrame:
    """Adds `reason` to parsed records with topic and key: envelope, workspace, then topic and partition key; null if good."""
    required = ("workspace_id", "event_id", "anonymous_id", "event_name", "occurred_at", "received_at", "schema_version", "tracking_plan_version", "funnel_definition_version")
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    wrong = ~F.col("topic").eqNullSafe(F.lit(TOPIC)) | ~F.col("key").eqNullSafe(partition_key("workspace_id", "anonymous_id"))
    return parsed.withColumn("reason", F.when(missing, "invalid_event_envelope").when(~F.col("workspace_id").rlike(WORKSPACE), "invalid_workspace_id").when(wrong, "invalid_topic_or_partition_key"))


def commit_offsets(records: DataFrame) -> DataFrame:
    """Where each topic partition is to resume: its last offset plus 1."""
    return records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))
