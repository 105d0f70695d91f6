"""Numbers, dates, arrays, maps and JSON as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a status, an event type, a release type, a role and an override mean.
STAGES = ("announced", "cast", "shooting", "wrapped", "dated", "trailer", "released")
STATUS_STAGE = {"Rumored": "announced", "Planned": "announced", "In Production": "shooting", "Post Production": "wrapped", "Released": "released"}
EVENT_STAGE = {"announced": "announced", "casting": "cast", "crew_attached": "announced", "production_start": "shooting", "production_wrap": "wrapped", "release_date": "dated", "trailer": "trailer"}
STATUS_EVENT = {"In Production": "production_start", "Post Production": "production_wrap"}
ROLE_EVENT = {"director": "crew_attached", "writer": "crew_attached", "cast": "casting"}
ROLE_ORDER = ("director", "writer", "cast")
RELEASE_BUCKET = {2: "limited", 3: "wide"}
RELEASE_LABEL = {2: "Limited", 3: "Wide"}
TIER_RANK = {"low": 0, "acceptable": 1, "trusted": 2}
OVERRIDE_TIER = {"block": "blocked", "trust": "trusted", "allow": "acceptable"}
DEPARTMENT_ORDER = ("Directing", "Writing", "Production", "Camera", "Editing", "Sound", "Art", "Costume & Make-Up", "Visual Effects", "Lighting", "Crew")


def mapped(key: Column, table: dict, default=None) -> Column:
    """table[key] as a literal map; default for an unknown or null key."""
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(lookup, key), F.lit(default)) if default is not None else F.try_element_at(lookup, key)


def rank_of(key: Column, order: tuple, unknown: int) -> Column:
    return mapped(key, {x: i for i, x in enumerate(order)}, unknown)


def arc_stage(status: Column) -> Column:
    return mapped(status, STATUS_STAGE, "announced")


def event_rank(event_type: Column) -> Column:
    """Place of the event type's stage; -1 if it has none."""
    return mapped(event_type, {k: STAGES.index(v) for k, v in EVENT_STAGE.items()}, -1)


def crew_keys(department: Column, job: Column, order: Column, name: Column) -> list[Column]:
    """What crew is sorted by: department by priority, then its name, job, billing (nulls last), name."""
    dept = F.coalesce(department, F.lit(""))
    return [rank_of(dept, DEPARTMENT_ORDER, len(DEPARTMENT_ORDER)), dept, F.coalesce(job, F.lit("")), order.isNull(), order, name]


def crew_order(department: Column, job: Column, order: Column, name: Column) -> list[Column]:
    return [k.asc() for k in crew_keys(department, job, order, name)]


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole; where whole is 0: empty (null unless given)."""
    value = part / F.nullif(whole, F.lit(0))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def overlap_ratio(title: Column, text: Column) -> Column:
    """The share of a title's distinct tokens that are in the text; null for a title without tokens."""
    own = F.array_distinct(title)
    return ratio(F.size(F.array_intersect(own, text)), F.size(own))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall, 0.0)


def backoff_seconds(attempt: Column, base: float, cap: float, retry_after: Column | None = None, longest: float | None = None, jitter: float = 0.0, draw: Column | None = None) -> Column:
    """The wait after an attempt (from 1): base doubled with each, at most cap, then shortened by up to jitter of itself.

    A server's own wait comes first, clamped to longest (cap if none); one that isn't positive says nothing. draw: where in the
    jitter a call lies, from 0 to 1; from a hash of its key (draw_of), so that calls that failed together part and a replay waits the same.
    """
    own = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1))
    if jitter:
        if draw is None:
            raise ValueError("jitter needs a draw")
        own = own * (F.lit(1.0) - F.lit(float(jitter)) * draw)
    return own if retry_after is None else F.when(retry_after > 0, F.least(retry_after.cast("double"), F.lit(float(cap if longest is None else longest)))).otherwise(own)


def draw_of(*key: Column) -> Column:
    """A number from 0 up to 1 from the hash of a key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)


def wait_header(text: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a number, or a date of mail less now; null for anything else, for what isn't finite and for what has passed."""
    number = F.when(text.rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), F.try_to_number(F.trim(text), F.lit("999999999999.999999")).cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r" (?:GMT|UTC|UT)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    seconds = F.coalesce(number, (F.unix_micros(F.when(text.rlike("[A-Za-z]"), date)) - F.unix_micros(now)) / 1e6)
    return F.when(seconds > 0, seconds)


def token_estimate(text: Column) -> Column:
    return F.bround(F.length(text) / 4).cast("long")


def utc_day(ts: Column) -> Column:
    """The calendar day, in a session whose time zone is UTC."""
    return F.to_date(ts)


def iso_date(text: Column) -> Column:
    """A date written as yyyy-mm-dd or yyyymmdd; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def long_date(day: Column) -> Column:
    return F.date_format(day, "d MMMM yyyy")


def whole_days(later: Column, earlier: Column) -> Column:
    """Floor of the difference of two timestamps, in days."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")


def first_time(*texts: Column) -> Column:
    """The first of some texts that is a timestamp."""
    return F.coalesce(*(F.try_to_timestamp(x) for x in texts))


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def holds(array: Column, item: Column) -> Column:
    return F.coalesce(F.array_contains(array, item), F.lit(False))


def appended(array: Column, more: Column) -> Column:
    return F.concat(F.coalesce(array, F.array().cast("array<string>")), more)


def joined_in_order(items: Column, order: tuple[str, ...], separator: str = "|") -> Column:
    """The known items in a fixed order."""
    return F.array_join(F.filter(F.array(*(F.lit(x) for x in order)), lambda x: F.array_contains(items, x)), separator)


def item_at(array: Column, index: Column) -> Column:
    """1-based; null out of range."""
    return F.when(index >= 1, F.try_element_at(array, index.cast("int")))


def json_text(document: Column, key: str) -> Column:
    """A key's text; '' when it is missing or the document is no object."""
    return F.coalesce(F.get_json_object(document, f"$.{key}"), F.lit(""))


def json_int(document: Column, key: str) -> Column:
    """A key's whole number; null for fractions, texts, booleans and what is no readable document. Only the key's own value counts, whatever else stands in the document."""
    value = F.try_variant_get(F.try_parse_json(document), f"$['{key}']", "variant")
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
