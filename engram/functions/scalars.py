"""Column expressions for the service's scalar rules.

All are plain ``pyspark.sql.functions`` expressions, so they stay inside
whole-stage codegen and are pushed around freely by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the service's.
MS_PER_DAY = 86_400_000          # decay counts days in milliseconds
MIN_IMPORTANCE = 0.1             # strength floor: max(importance, 0.1) * 10
STRENGTH_FACTOR = 10.0
SIMILARITY_WEIGHT = 0.7          # score = 0.7 * similarity + 0.3 * decay
DECAY_WEIGHT = 0.3
DUPLICATE_THRESHOLD = 0.985      # similarity >= 0.985 -> duplicate
CONTRADICTION_LOW = 0.94         # 0.94 <= similarity < 0.985 -> replaced
ISO_MS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# (default, max) per endpoint for the limit argument
LIMITS = {"search": (10, 50), "list": (20, 100), "context": (5, 20), "feedback": (50, 100)}


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_ms(created_at, as_of) -> Column:
    """Milliseconds from created_at to as_of (both timestamp_ntz)."""
    return F.timestamp_diff("MILLISECOND", col_(created_at), col_(as_of))


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970-01-01 of a timestamp_ntz, from its calendar
    fields only -- the same under any session time zone."""
    c = col_(ts)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def decay(created_at, importance, as_of) -> Column:
    """exp(-days / (max(importance, 0.1) * 10)); no clamp for future rows."""
    days = age_ms(created_at, as_of).cast("double") / F.lit(float(MS_PER_DAY))
    strength = F.greatest(col_(importance), F.lit(MIN_IMPORTANCE)) * F.lit(STRENGTH_FACTOR)
    return F.exp(-days / strength)


def blend(similarity, decay_score) -> Column:
    """0.7 * similarity + 0.3 * decay on unrounded inputs."""
    return col_(similarity) * F.lit(SIMILARITY_WEIGHT) + col_(decay_score) * F.lit(DECAY_WEIGHT)


def round4(c) -> Column:
    """Round to 4 decimals (double in, double out)."""
    return F.round(col_(c).cast("double"), 4)


def iso_ms(ts) -> Column:
    """ISO-8601 with milliseconds and a Z suffix (input is UTC ntz)."""
    return F.date_format(col_(ts), ISO_MS_FORMAT)


def js_number(x, digits: int = 4) -> Column:
    """Print a double the way JavaScript's String(n) does for short
    decimals: 1, 0.95, 0 (not 1.0 or 1.0E-4)."""
    text = F.format_string(f"%.{digits}f", col_(x).cast("double"))
    trimmed = F.regexp_replace(text, r"\.?0+$", "")
    return F.when(trimmed.isin("", "-0"), F.lit("0")).otherwise(trimmed)


def key_hash(raw) -> Column:
    """SHA-256 hex of the raw key."""
    return F.sha2(col_(raw), 256)


def norm_email(c) -> Column:
    """Lower-case and trim."""
    return F.lower(F.trim(col_(c)))


def name_from_email(c) -> Column:
    """P10: text before the first '@'."""
    return F.substring_index(col_(c), "@", 1)


def parse_int(c) -> Column:
    """JavaScript parseInt on a string: optional sign and leading digits
    after whitespace; anything else is NaN (null here)."""
    digits = F.regexp_extract(F.trim(col_(c)), r"^[+-]?[0-9]+", 0)
    return F.when(F.length(digits) > 0, digits.try_cast("bigint"))


def clamp_limit(c, endpoint: str) -> Column:
    """least(parseInt(x ?? default), max).  A non-numeric or negative
    limit makes the database reject the statement: null here, and callers
    turn it into a rejected request."""
    default, maximum = LIMITS[endpoint]
    raw = col_(c)
    parsed = parse_int(raw.cast("string"))
    value = F.when(raw.isNull(), F.lit(default).cast("bigint")).otherwise(parsed)
    return F.when(value >= 0, F.least(value, F.lit(maximum).cast("bigint")))


def flag(c) -> Column:
    """True only for 'true' or '1'."""
    return F.coalesce(col_(c).isin("true", "1"), F.lit(False))


def effective_visibility(team_id, visibility) -> Column:
    """team_id set -> 'team', else given or 'private'."""
    return F.when(col_(team_id).isNotNull(), F.lit("team")).otherwise(
        F.coalesce(col_(visibility), F.lit("private"))
    )
