"""Segments of transcripts whose JSON may be a string, an object or a list of either."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_transcript, is_devanagari_text, strip

SAMPLE_RATE = 16_000
SHORTEST, LONGEST = 0.5, 30.0
#: JSON texts of values that do not count as given.
FALSY = ("null", '""', "0", "0.0", "-0.0", "false", "[]", "{}")


KEYS = ("transcription", "text", "sentence")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value, as the one element of an array, worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _json(value: Column, key: str | None = None) -> Column:
    return F.to_json(F.try_variant_get(value, f"$.{key}", "variant") if key else value)


def _text_of(json: Column) -> Column:
    """The text of an object's first given key, or of a string; null if that is no string or blank."""
    first = F.coalesce(*(F.when(~json[k].isin(*FALSY), json[k]) for k in KEYS))
    picked = F.when(json["own"].startswith('"'), json["own"]).otherwise(first)
    text = _once(picked, lambda p: F.when(p.startswith('"'), strip(F.get_json_object(F.concat(F.lit('{"t":'), p, F.lit("}")), "$.t"))))
    return _once(text, lambda t: F.when(t != "", t))


def _number(raw: Column) -> Column:
    """Seconds of a bound, in three parts: null if absent, NaN if it is no number."""
    return F.when(raw.isNotNull() & (raw != "null"), F.coalesce(F.regexp_replace(raw, '^"|"$', "").try_cast("double"), F.lit(float("nan"))))


def extract_segments(transcripts: DataFrame, payload: str = "payload") -> DataFrame:
    """Explodes payload into (segment, text, start, end), segments counted from 0. Broken JSON and
    blank texts give no row. A bound that is no number is NaN."""

    def jsons(own: Column, item: Column) -> Column:
        """The JSON texts of an item and, of an object, its fields."""
        is_object = own.startswith("{")
        return F.struct(own.alias("own"), *(F.when(is_object, _json(item, k)).alias(k) for k in (*KEYS, "start", "end")))

    def segment(item: Column) -> Column:
        read = _once(_json(item), lambda own: jsons(own, item))
        return _once(read, lambda j: F.struct(_text_of(j).alias("text"), _number(j["start"]).alias("start"), _number(j["end"]).alias("end")))

    items = lambda v: F.when(_json(v).startswith("["), F.try_variant_get(v, "$", "array<variant>")).when(v.isNotNull(), F.array(v))
    kept = F.filter(F.transform(_once(F.try_parse_json(payload), items), segment), lambda s: s["text"].isNotNull())
    names = transcripts.columns
    # An outer explode, as Spark works out the array of an inner one twice more to filter rows by it.
    found = transcripts.select(*names, F.posexplode_outer(kept).alias("segment", "_x")).where("segment is not null")
    return found.select(*names, "segment", "_x.text", "_x.start", "_x.end")


def build_samples(segments: DataFrame, length: Column | None = None, most: int = 448) -> DataFrame:
    """Adds sentence, duration, is_devanagari and drop_reason (null: kept) to segments (text, start,
    end, audio_seconds). length is an optional token count; sentences beyond `most` are dropped."""
    audio = F.floor(F.col("audio_seconds") * SAMPLE_RATE)
    whole = F.col("start").isNull() | F.col("end").isNull()
    index = lambda c: F.when(F.isnan(c), None).otherwise((F.col(c) * SAMPLE_RATE).cast("long"))
    begin, stop = F.greatest(F.lit(0), index("start")), F.least(audio, index("end"))
    bad = ~whole & (F.isnan("start") | F.isnan("end"))
    samples = F.when(whole, audio).otherwise(stop - begin)
    out = segments.withColumns({"sentence": clean_transcript("text"), "duration": samples / SAMPLE_RATE, "_bad": F.coalesce(bad, F.lit(False))})
    reason = F.when(F.col("sentence") == "", "empty")
    if length is not None:
        reason = reason.when(length > most, "too many tokens")
    reason = reason.when(F.col("_bad") | (~whole & (stop <= begin)), "bad bounds").when(~F.col("duration").between(SHORTEST, LONGEST), "duration")
    return out.withColumns({"is_devanagari": is_devanagari_text("sentence"), "drop_reason": reason}).drop("_bad")


def retention(samples: DataFrame) -> DataFrame:
    """One row: retained and skipped."""
    return samples.agg(F.count_if(F.col("drop_reason").isNull()).alias("retained"), F.count_if(F.col("drop_reason").isNotNull()).alias("skipped"))
