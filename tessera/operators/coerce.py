"""Lenient coercion of loosely typed JSON input (P01-P14): bad values become usable ones, never errors.

Inputs are VARIANT columns (parse_json of the raw text), so each value carries its own type. JSON text of a composite
value is Spark's compact form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T

_NO_STRINGS = "array<string>"


def kind(v: Column) -> Column:
    """null, string, bool, number, object or array."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), F.lit("null"))
        .when(s == "STRING", F.lit("string"))
        .when(s == "BOOLEAN", F.lit("bool"))
        .when(s.startswith("OBJECT"), F.lit("object"))
        .when(s.startswith("ARRAY"), F.lit("array"))
        .otherwise(F.lit("number"))
    )


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def clean_text(x: Column) -> Column:
    """Without NUL; each run of replacement characters that stands for one lone surrogate becomes a question mark."""
    return F.regexp_replace(F.translate(x, "\x00", ""), "�{3}", "?")


def normalize_role(role: Column) -> Column:
    """User or assistant; aliases count after strip and lower, anything else is user."""
    r = F.lower(T.strip(role))
    out = F.lit("user")
    for alias, target in C.ROLE_ALIASES.items():
        out = F.when(r == alias, F.lit(target)).otherwise(out)
    return F.when(r.isin("user", "assistant"), r).otherwise(out)


def scalar_text(v: Column) -> Column:
    """A number or truth value as text, truth values capitalised."""
    return F.when(kind(v) == "bool", F.initcap(_string(v))).otherwise(_string(v))


def content_to_text(v: Column) -> Column:
    """Strings stay; a list of strings, text blocks and image blocks gives its texts on lines, images dropped; any
    other list, or one without text, and objects give their JSON; null and the empty list give an empty text."""
    items = F.try_variant_get(v, "$", "array<variant>")
    field = lambda e, k: F.try_variant_get(e, f"$.{k}", "variant")
    is_string = lambda e: kind(e) == "string"
    block = lambda e: F.try_variant_get(e, "$.type", "string")
    is_text = lambda e: (kind(e) == "object") & (block(e) == "text") & (kind(field(e, "text")) == "string")
    is_image = lambda e: (kind(e) == "object") & F.coalesce(block(e).isin(*C.IMAGE_TYPES), F.lit(False))
    known = F.forall(items, lambda e: F.coalesce(is_string(e) | is_text(e) | is_image(e), F.lit(False)))
    texts = F.transform(F.filter(items, lambda e: ~is_image(e)), lambda e: F.when(is_string(e), _string(e)).otherwise(F.try_variant_get(e, "$.text", "string")))
    joined = F.array_join(texts, "\n")
    listed = F.when(F.size(items) == 0, F.lit("")).when(known & ~T.is_blank(joined), joined).otherwise(F.to_json(v))
    out = (
        F.when(kind(v) == "null", F.lit(""))
        .when(kind(v) == "string", _string(v))
        .when(kind(v) == "array", listed)
        .when(kind(v) == "object", F.to_json(v))
        .otherwise(scalar_text(v))
    )
    return clean_text(out)


def date_to_ms(x: Column) -> Column:
    """Epoch milliseconds of a date text, UTC where no offset is named; null outside 1970 to 9999-12-31."""
    t = T.strip(x)
    iso = F.regexp_replace(F.regexp_replace(t, "[zZ]$", "+00:00"), r"(\.[0-9]{6})[0-9]+", "$1")
    good = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:[+-][0-9]{2}:[0-9]{2})?)?\z"
    slash = r"\A([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?: ([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?)?\z"
    week = rf"\A([0-9]{{4}})/([0-9]{{2}})/([0-9]{{2}}){T.WS}*\([A-Za-z]{{3}}\){T.WS}*([0-9]{{2}}):([0-9]{{2}})\z"

    def built(pattern: str, seconds: bool) -> Column:
        two = lambda k: F.lpad(F.when(F.regexp_extract(t, pattern, k) == "", F.lit("0")).otherwise(F.regexp_extract(t, pattern, k)), 2, "0")
        date = F.concat_ws("-", F.regexp_extract(t, pattern, 1), two(2), two(3))
        return F.concat(date, F.lit("T"), two(4), F.lit(":"), two(5), F.lit(":"), two(6) if seconds else F.lit("00"))

    ts = F.when(iso.rlike(good), F.try_to_timestamp(iso)).when(t.rlike(slash), F.try_to_timestamp(built(slash, True))).when(t.rlike(week), F.try_to_timestamp(built(week, False)))
    ms = F.floor(F.unix_micros(ts) / F.lit(1000)).cast("long")
    return F.when((F.unix_micros(ts) >= 0) & (F.unix_micros(ts) <= F.lit(253_402_214_400_000_000)), ms)


def in_range(ms: Column) -> Column:
    return F.when(~F.isnan(ms) & (ms >= 0) & (ms <= float(C.MAX_TS_MS)), ms)


def timestamp_ms(v: Column) -> Column:
    """Numbers, numeric texts (underscores between digits allowed) and truth values within range, else a date text,
    else null; as double, which holds the range exactly."""
    s = _string(v)
    bare = F.regexp_replace(T.strip(s), "(?<=[0-9])_(?=[0-9])", "")
    number = F.when(bare.rlike(r"(?i)\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z"), F.try_cast(bare, "double") if hasattr(F, "try_cast") else bare.try_cast("double"))
    numeric = kind(v) == "string"
    from_text = F.when(number.isNotNull(), in_range(number)).otherwise(date_to_ms(s).cast("double"))
    return F.when(numeric, from_text).when(kind(v) == "bool", F.when(_string(v) == "true", F.lit(1.0)).otherwise(F.lit(0.0))).when(kind(v) == "number", in_range(F.try_variant_get(v, "$", "double")))


def check_id(v: Column) -> Column:
    """Texts stay, numbers become texts; null for anything else and for texts with NUL."""
    s = F.when(kind(v).isin("string", "number"), _string(v))
    return F.when(F.instr(s, "\x00") == 0, s)


def messages(v: Column) -> Column:
    """A list without its nulls; a lone object, text or number as a list of one; null as an empty list."""
    items = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda e: kind(e) != "null")
    alone = F.array(v)
    return F.when(kind(v) == "array", items).when(kind(v).isin("object", "string", "number"), alone).otherwise(F.array().cast("array<variant>"))


def message(v: Column) -> Column:
    """One message as (role, content, timestamp_ms)."""
    obj = kind(v) == "object"
    role = F.when(obj & (kind(F.try_variant_get(v, "$.role", "variant")) == "string"), F.try_variant_get(v, "$.role", "string")).otherwise(F.lit("user"))
    content = F.when(obj, content_to_text(F.try_variant_get(v, "$.content", "variant"))).otherwise(content_to_text(v))
    ms = F.when(obj, timestamp_ms(F.try_variant_get(v, "$.timestamp", "variant")))
    return F.struct(normalize_role(role).alias("role"), content.alias("content"), ms.alias("timestamp_ms"))


def query_text(v: Column) -> Column:
    """P09."""
    return F.when(kind(v) == "null", F.lit("")).when(kind(v) == "string", _string(v)).when(kind(v).isin("object", "array"), F.to_json(v)).otherwise(scalar_text(v))


def top_k(v: Column) -> Column:
    """P10: whole numbers from numbers, numeric texts and truth values, cut off at the point; at most 100, and 100 for what
    is not positive or no number."""
    n = F.when(kind(v) == "bool", F.when(_string(v) == "true", F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(T.strip(_string(v)).try_cast("double"))
    n = F.when(~F.isnan(n) & (n >= 1), F.floor(F.least(n, F.lit(float(C.TOP_K_CAP))))).cast("int")
    return F.coalesce(F.when(kind(v).isin("string", "number", "bool"), n), F.lit(C.TOP_K_CAP))


def options(v: Column) -> Column:
    """A list of texts; a scalar is a list of one, nulls are dropped, other values become JSON. Null stays null."""
    items = F.when(kind(v) == "array", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    some = F.filter(items, lambda e: kind(e) != "null")
    texts = F.transform(some, lambda e: F.when(kind(e) == "string", _string(e)).otherwise(F.to_json(e)))
    return F.when(kind(v) != "null", texts)


def embed_text(speaker: Column, role: Column, x: Column) -> Column:
    """P13."""
    return F.concat(F.coalesce(speaker, role), F.lit(": "), x)


def drop_blank(df: DataFrame, column: str = "content") -> DataFrame:
    """Without rows whose text is only white space."""
    return df.where(~T.is_blank(F.col(column)))


def add_requests(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Raw JSON lines -> (requests, errors). requests: request_id, user_id, session_id, payload_sha, messages; errors (P14):
    the fields at fault and why, never the body. Other columns of raw pass through to both."""
    rest = [c for c in raw.columns if c != column]
    v = F.try_parse_json(F.col(column))
    field = lambda k: F.try_variant_get(F.col("__v"), f"$.{k}", "variant")
    d = raw.withColumn("__v", v)
    parsed = d.select(
        *rest,
        check_id(field("request_id")).alias("request_id"),
        check_id(field("user_id")).alias("user_id"),
        F.when(kind(field("session_id")) == "null", F.lit("")).otherwise(check_id(field("session_id"))).alias("session_id"),
        F.sha2(F.coalesce(F.to_json("__v"), F.lit("")), 256).alias("payload_sha"),
        F.transform(messages(field("messages")), message).alias("messages"),
        (kind(F.col("__v")) == "object").alias("__object"),
    )
    faults = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("__object"), F.lit(False)), F.lit("body")),
            F.when(F.coalesce(F.length("request_id"), F.lit(0)) == 0, F.lit("request_id")),
            F.when(F.coalesce(F.length("user_id"), F.lit(0)) == 0, F.lit("user_id")),
            F.when(F.col("session_id").isNull(), F.lit("session_id")),
        )
    )
    checked = parsed.withColumn("loc", faults)
    good = checked.where(F.size("loc") == 0).drop("loc", "__object")
    bad = checked.where(F.size("loc") > 0).select(*rest, F.explode("loc").alias("loc"), F.lit("missing or not usable").alias("msg"))
    return good, bad


def search_requests(raw: DataFrame, column: str = "value") -> DataFrame:
    """Raw JSON lines -> user_id, query, options, top_k; rows without a usable user_id are dropped."""
    rest = [c for c in raw.columns if c != column]
    field = lambda k: F.try_variant_get(F.col("__v"), f"$.{k}", "variant")
    d = raw.withColumn("__v", F.try_parse_json(F.col(column)))
    out = d.select(*rest, check_id(field("user_id")).alias("user_id"), query_text(field("query")).alias("query"), options(field("options")).alias("options"), top_k(field("top_k")).alias("top_k"))
    return out.where(F.length("user_id") > 0)
