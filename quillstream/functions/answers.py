"""Answers of models, parsed with tolerance and classed where they fail, as Column expressions over their text.

An answer is parsed strictly; if that fails once more after trimming: code fences
go, and of what is left only the region from the first bracket to the last of its
kind counts. One coercion is allowed then: a bare list of stories. Nothing inside
the region is rewritten. Each failure has a class, and the first rule of the form
that is broken a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .scoring import clamped
from .text import bound, trimmed

STORY = (
    "struct<title: string, subtitle: string, source_item_ids: array<string>, summary: string, tags: struct<topics: array<string>, keywords: array<string>, geographies: array<string>>, "
    "associated_entities: array<string>, factual_claims: array<string>, claim_evidence_map: map<string, array<string>>>"
)


def trimmed_region(raw: Column) -> Column:
    """The text without code fences, from its first { or [ to the last closing bracket of that kind; null without such a region."""
    text = trimmed(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?i)```(?:json)?", ""))
    region = lambda t: F.when(F.regexp_extract(t, r"[{\[]", 0) == "{", F.regexp_extract(t, r"(?s)(\{.*\})", 1)).otherwise(F.regexp_extract(t, r"(?s)(\[.*\])", 1))
    return bound(bound(text, lambda t: trimmed(region(t))), lambda r: F.when(r != "", r))


def unfenced(raw: Column) -> Column:
    """The text without a code fence before and behind it."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?i)^```(?:json)?\s*", ""), r"(?i)\s*```\s*$", ""))


def _kind(v: Column) -> Column:
    """STRING, ARRAY, OBJECT, VOID (null), ... of a variant; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _wanted(v: Column, kind: str, more: Callable[[Column], Column] | None = None) -> Column:
    """The first fault of a required value: absent, of another kind, or what ``more`` finds."""

    def fault(x: Column) -> Column:
        out = F.when(x.isNull(), "missing_required_field").when(_kind(x) != kind, "invalid_type")
        return out if more is None else out.otherwise(more(x))

    return bound(v, fault)


def _first(values: Column) -> Column:
    return F.get(F.array_compact(values), F.lit(0))


def _strings(v: Column) -> Column:
    """The first fault of a list whose values have to be strings."""
    return F.when(F.exists(v.cast("array<variant>"), lambda x: _kind(x) != "STRING"), "invalid_type")


def _text(v: Column) -> Column:
    return F.when(v.cast("string") == "", "empty_string_field")


def _ids(v: Column) -> Column:
    each = lambda own: F.transform(own, lambda x: F.when(_kind(x) != "STRING", "invalid_type").when(x.cast("string") == "", "empty_source_item_ids"))
    fault = lambda own: F.when(F.size(own) == 0, "empty_source_item_ids").when(F.size(own) > fixed.STORY_SOURCES, "too_many_source_item_ids").otherwise(_first(each(own)))
    return bound(v.cast("array<variant>"), fault)


def _claims(v: Column) -> Column:
    return F.when(F.size(v.cast("array<variant>")) == 0, "empty_string_field").otherwise(_strings(v))


def _evidence(v: Column) -> Column:
    values = F.map_values(v.cast("map<string, variant>"))
    return _first(F.transform(values, lambda x: F.when(_kind(x) != "ARRAY", "invalid_type").otherwise(_strings(x))))


def _tags(v: Column) -> Column:
    return _first(F.array(*(_wanted(_at(v, f"$.{a}"), "ARRAY", _strings) for a in ("topics", "keywords", "geographies"))))


def story_fault(s: Column) -> Column:
    """The first fault of a story (a variant), in the order of its fields; null for a sound one."""
    entities = bound(_at(s, "$.associated_entities"), lambda x: F.when(x.isNotNull(), _wanted(x, "ARRAY", _strings)))
    fields = [
        *(_wanted(_at(s, f"$.{f}"), "STRING", _text) for f in ("title", "subtitle")), _wanted(_at(s, "$.source_item_ids"), "ARRAY", _ids), _wanted(_at(s, "$.summary"), "STRING", _text),
        _wanted(_at(s, "$.tags"), "OBJECT", _tags), entities,
        _wanted(_at(s, "$.factual_claims"), "ARRAY", _claims), _wanted(_at(s, "$.claim_evidence_map"), "OBJECT", _evidence),
    ]
    return F.when(_kind(s) != "OBJECT", "invalid_type").otherwise(_first(F.array(*fields)))


def _listed(stories: Column) -> Column:
    """The first fault of the list of stories."""
    fault = lambda own: F.when(F.size(own) > fixed.STORY_CAP, "too_many_meta_stories").otherwise(_first(F.transform(own, story_fault)))
    each = lambda x: F.when(x.isNull() | (_kind(x) != "ARRAY"), "missing_meta_stories").otherwise(bound(x.cast("array<variant>"), fault))
    return bound(stories, each)


def parsed_answers(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows with ``stories`` (null where both readings fail) and ``repair``.

    repair: attempted, succeeded, failure_reason (no_json_region, json_parse_error,
    schema_validation_error), raw_class (the same, or empty_response), bucket (the
    first broken rule of the form, of the reading that counted last), coercion.
    """
    out = rows.withColumn("_text", trimmed(F.coalesce(raw, F.lit("")))).withColumn("_v", F.try_parse_json("_text"))
    # each reading in columns of its own, so that none is worked out twice
    out = out.withColumn("_fault", F.when(_kind(F.col("_v")) == "OBJECT", _listed(_at(F.col("_v"), "$.meta_stories"))).otherwise("invalid_type"))
    raw_class = F.when(F.col("_text") == "", "empty_response").when(F.col("_v").isNull(), "json_parse_error").when(F.col("_fault").isNotNull(), "schema_validation_error")
    out = out.withColumn("_class", raw_class).withColumn("_region", F.when(F.col("_class").isNotNull(), trimmed_region(F.col(raw)))).withColumn("_w", F.try_parse_json("_region"))
    out = out.withColumn("_wrapped", _kind(F.col("_w")) == "ARRAY").withColumn("_list", F.when(F.col("_wrapped"), F.col("_w")).otherwise(_at(F.col("_w"), "$.meta_stories")))
    out = out.withColumn("_again", F.when(F.col("_wrapped") | (_kind(F.col("_w")) == "OBJECT"), _listed(F.col("_list"))).otherwise("invalid_type"))
    failure = F.when(F.col("_class").isNull(), None).when(F.col("_region").isNull(), "no_json_region").when(F.col("_w").isNull(), "json_parse_error").when(F.col("_again").isNotNull(), "schema_validation_error")
    out = out.withColumn("_failure", failure)
    attempted, sound = F.col("_class").isNotNull(), F.col("_failure").isNull()
    bucket = F.when(F.col("_failure") == "schema_validation_error", F.col("_again")).when(F.col("_class") == "schema_validation_error", F.col("_fault"))
    repair = F.struct(
        attempted.alias("attempted"), (attempted & sound).alias("succeeded"), F.col("_failure").alias("failure_reason"), F.col("_class").alias("raw_class"),
        F.when(attempted, bucket).alias("bucket"), F.when(attempted & sound & F.col("_wrapped"), "array_wrap").alias("coercion"),
    )
    stories = F.when(~attempted, _at(F.col("_v"), "$.meta_stories")).when(sound, F.col("_list"))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), stories.cast(f"array<{STORY}>").alias("stories"), repair.alias("repair"))


def observed(repair: Column) -> Column:
    """How a reading went: mode, result, error_class, fallback_to."""
    done = ~repair["attempted"]
    return F.struct(
        F.when(done, "structured").otherwise("legacy").alias("mode"), F.when(done, "ok").when(repair["succeeded"], "fallback").otherwise("fail").alias("result"),
        F.when(done, None).when(repair["succeeded"], repair["raw_class"]).otherwise(F.coalesce(repair["failure_reason"], repair["raw_class"], F.lit("parse_error"))).alias("error_class"),
        F.when(~done & repair["succeeded"], "legacy").alias("fallback_to"),
    )


def failure_subtype(message: Column, status: Column, name: Column, unread: Column) -> Column:
    """Why a call failed: timeout_budget, parse (its answer could not be read), provider_request or unknown."""
    said = F.coalesce(message, F.lit(""))
    provider = status.isNotNull() | F.coalesce(name.rlike("(?i)APIError|APIConnection|Anthropic"), F.lit(False)) | said.rlike(fixed.PROVIDER_FAILURE)
    return F.when(said.rlike(fixed.TIMEOUT_FAILURE), "timeout_budget").when(F.coalesce(unread, F.lit(False)), "parse").when(provider, "provider_request").otherwise("unknown")


def confidence(raw: Column) -> Column:
    """The confidence of a fenced or bare JSON answer, in 0..1; 0 where it is no number, null where the text is no JSON."""
    v = F.try_parse_json(unfenced(raw))
    number = _at(v, "$.confidence")
    return F.when(v.isNotNull(), F.when(_kind(number).isin("BIGINT", "DECIMAL", "DOUBLE"), clamped(number.cast("double"))).otherwise(0.0))


def change_verdict(raw: Column) -> Column:
    """(material, confidence, reason_code) of a classifier's answer; null where it is no object with a boolean material."""
    v = F.try_parse_json(unfenced(raw))
    material, reason = _at(v, "$.material"), _at(v, "$.reasonCode")
    out = F.struct(material.cast("boolean").alias("material"), confidence(raw).alias("confidence"), F.when(_kind(reason) == "STRING", reason.cast("string")).otherwise("").alias("reason_code"))
    return F.when(_kind(material) == "BOOLEAN", out)
