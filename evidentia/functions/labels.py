"""Decision tables: labels, routing, failures, tolerant numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSURE_BELOW = 55
#: Control states in the order in which a press moves through them.
LOOKUP_CYCLE = {"auto": "forced-off", "forced-off": "forced-on", "forced-on": "auto"}
READER_CYCLE = {"auto": "off", "off": "auto"}
DEFAULT_LANGUAGE = "mkd"
FAILURES = {
    "no-key": "No key is set, so the remote reader is off.",
    "auth": "The key was rejected; covers are read on the device until it works.",
    "rate-limit": "The key has used up its quota for now; covers are read on the device.",
    "timeout": "The remote reader didn't answer in time, so the cover was read on the device.",
    "server": "The remote reader returned an error, so the cover was read on the device.",
    "malformed": "The remote reader's answer could not be read, so the cover was read on the device.",
    "network": "The remote reader could not be reached, so the cover was read on the device.",
}


def rounded(x: Column) -> Column:
    """To the nearest integer, halves up."""
    return F.floor(x + 0.5)


def confidence_class(confidence: Column) -> Column:
    return F.when(confidence >= 70, "high").when(confidence >= UNSURE_BELOW, "medium").otherwise("low")


def confidence_label(confidence: Column) -> Column:
    shown = confidence.cast("int").cast("string")
    return (
        F.when(confidence >= 70, F.concat(shown, F.lit("% confident")))
        .when(confidence >= UNSURE_BELOW, F.concat(shown, F.lit("% — worth checking")))
        .otherwise("Not sure — please check")
    )


def choose_reader(mode: Column, has_key: Column, online: Column) -> Column:
    return F.when((mode == "off") | ~has_key | ~online, "ocr").otherwise("ai")


def reader_reason(mode: Column, has_key: Column, online: Column) -> Column:
    return F.when(mode == "off", "switched off").when(~has_key, "no key").when(~online, "no connection").otherwise("remote reader, device as fallback")


def reader_label(mode: Column, has_key: Column, online: Column) -> Column:
    return F.when(mode == "off", "AI: Off").when(~has_key, "AI: No key").when(online, "AI: On · connected").otherwise("AI: On · no signal")


def reader_control_visible(has_key: Column) -> Column:
    return has_key


def should_look_up(mode: Column, online: Column) -> Column:
    return F.when(mode == "forced-off", False).when(mode == "forced-on", True).otherwise(online)


def lookup_label(mode: Column, online: Column) -> Column:
    return (
        F.when(mode == "forced-off", "Lookup: Off")
        .when(online, "Lookup: On · connected")
        .when(mode == "forced-on", "Lookup: On · no signal")
        .otherwise("Lookup: Off · offline")
    )


def next_state(state: Column, cycle: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in cycle.items() for x in pair])[state]


def toggle_language(languages: Column, language: Column) -> Column:
    """The set with ``language`` put in or taken out; an empty one becomes the default."""
    toggled = F.when(F.array_contains(languages, language), F.array_remove(languages, language)).otherwise(F.array_append(languages, language))
    return F.when(F.size(toggled) == 0, F.array(F.lit(DEFAULT_LANGUAGE))).otherwise(toggled)


def classify_failure(status: Column, body: Column) -> Column:
    return (
        F.when(status.isin(401, 403), "auth")
        .when(status == 429, "rate-limit")
        .when(status >= 500, "server")
        .when((status == 400) & body.rlike("(?i)api.?key|credential|unauthenticated|permission"), "auth")
        .otherwise("server")
    )


def is_model_retired(status: Column, body: Column) -> Column:
    return (status == 404) & body.rlike("(?i)model|no longer available|not_found")


def describe_failure(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])[kind]


def as_confidence(value: Column) -> Column:
    """A number or text as 0 to 100: shares up to 1 are scaled, what is no finite number is 0."""
    number = value.try_cast("double")
    scaled = F.when((number > 0) & (number <= 1), number * 100).otherwise(number)
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0), F.least(F.lit(100), rounded(scaled)))).otherwise(0).cast("int")


def format_bytes(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(rounded(size / 1024).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_number(size / (1024 * 1024), 1), F.lit(" MB")))
    )


def backup_name(day: Column) -> Column:
    return F.concat(F.lit("library-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".json"))


def describe_backup(books: Column, size: Column, name: Column, shared: Column) -> Column:
    amount = F.when(size < 1024 * 1024, F.concat(rounded(size / 1024).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_number(size / (1024 * 1024), 1), F.lit(" MB")))
    head = F.concat(books.cast("string"), F.lit(" books ("), amount, F.lit(")"))
    return F.when(shared, F.concat(head, F.lit(" — choose where to save it."))).otherwise(F.concat(head, F.lit(" saved as "), name, F.lit(".")))
