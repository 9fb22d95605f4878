"""Expressions that turn features into labels, shares and scores, with the edge cases fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import clip01, cosine01, jaccard

#: Trigger kinds, each with an axis that takes its strength. Fixed values.
TRIGGER_AXES = {"beat": "beat_weight", "onset": "onset_weight", "kick": "kick_weight", "snare": "snare_weight", "hihat": "hihat_weight", "energy": "energy_weight"}
COLD_MOODS = ["dark", "cold", "cool", "moody"]
WARM_MOODS = ["uplifting", "warm", "happy", "energetic"]
#: Intensity of a section by its label; others get the last value. Fixed values.
STEPS = (("low", 0.25), ("medium", 0.6))


def current_model(name: Column, version: Column, want_name: str, want_version: str) -> Column:
    """Whether a row is of exactly this model; a row that doesn't say is not."""
    return F.coalesce((name == want_name) & (version == want_version), F.lit(False))


def first_parseable(sources: dict[str, Column]) -> Column:
    """Struct (value double, source) of the first source that holds a number; both null if none does."""
    tried = [(name, value.cast("string").try_cast("double")) for name, value in sources.items()]
    value = F.coalesce(*[v for _, v in tried])
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for name, v in tried])
    return F.struct(value.alias("value"), source.alias("source"))


def availability(reasons: dict[str, Column]) -> Column:
    """Map of axis to 'available' or to the reason why it is not; a reason is null where nothing is missing."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in reasons]), F.array(*[F.coalesce(v, F.lit("available")) for v in reasons.values()]))


def canonical(value: Column, aliases: dict[str, str], allowed: list[str], default: str) -> Column:
    """Lower-cased and trimmed, renamed by aliases; what isn't allowed becomes the default."""
    low = F.lower(F.trim(value))
    named = low
    for old, new in aliases.items():
        named = F.when(low == old, new).otherwise(named)
    return F.when(named.isin(allowed), named).otherwise(default)


def trigger_axes(kind: Column, strength: Column) -> Column:
    """Struct with the strength at the axis of the trigger's kind and 0 at all others."""
    return F.struct(*[F.when(kind == k, clip01(strength)).otherwise(0.0).alias(axis) for k, axis in TRIGGER_AXES.items()])


def length_axes(seconds: Column) -> Column:
    """Struct min_clip_length (1 for no length, 0 from 4 s) and max_clip_length (1 from 8 s)."""
    return F.struct(clip01(1.0 - F.least(F.lit(1.0), seconds / 4)).alias("min_clip_length"), clip01(F.least(F.lit(1.0), seconds / 8)).alias("max_clip_length"))


def closeness(a: Column, b: Column) -> Column:
    """1 less the distance of two values clipped to 0..1."""
    return 1.0 - F.abs(clip01(a) - clip01(b))


def decay(distance: Column, scale: float = 0.5) -> Column:
    return F.exp(-F.abs(distance) / scale)


def mood_warmth(tags: Column) -> Column:
    """-1 (cold) to 1 (warm): the mean over the tags that say either; 0 if none does."""
    cold = F.size(F.filter(tags, lambda t: F.lower(t).isin(COLD_MOODS)))
    warm = F.size(F.filter(tags, lambda t: F.lower(t).isin(WARM_MOODS)))
    return F.when(cold + warm > 0, (warm - cold) / (cold + warm)).otherwise(0.0)


def semantic(status: Column, a, b) -> Column:
    return F.when(status == "available", cosine01(a, b))


def mood_match(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(a), F.array_distinct(b))


def mood_label(tags: Column, dark: list[str], uplifting: list[str]) -> Column:
    """'dark' before 'uplifting' before 'neutral'."""
    lists = [(n, F.array(*[F.lit(x) for x in words])) for n, words in (("dark", dark), ("uplifting", uplifting))]
    return F.when(F.arrays_overlap(tags, lists[0][1]), "dark").when(F.arrays_overlap(tags, lists[1][1]), "uplifting").otherwise("neutral")


def bucket(value: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the first edge that lies above the value; the last name beyond all."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        out = F.when(value < edge, name).otherwise(out)
    return out


def curve_fit(curve: Column, full: float, intensity: Column) -> Column:
    """1 less the distance of the curve's mean (scaled, clipped) to an intensity; an empty curve gives 0.5."""
    mean = F.aggregate(curve, F.lit(0.0), lambda s, x: s + x) / F.size(curve)
    return F.when(F.size(curve) > 0, 1.0 - F.abs(clip01(mean / full) - intensity)).otherwise(0.5)


def has_tags(tags: Column, wanted: list[str], any_match: bool) -> Column:
    """Whether all (or any) wanted tags are there; nothing wanted fits all rows, but not by any."""
    want = F.array(*[F.lit(w) for w in wanted]).cast("array<string>")
    return F.arrays_overlap(tags, want) if any_match else F.size(F.array_except(want, tags)) == 0


def in_theme(cluster: Column, words: Column, clusters: list[int], keywords: list[str]) -> Column:
    """Member of one of the clusters, or a text that holds a keyword."""
    out = F.coalesce(cluster.isin(clusters), F.lit(False))
    for k in keywords:
        out = out | F.coalesce(F.contains(F.lower(words), F.lit(k.lower())), F.lit(False))
    return out


def blacklist_size(n: Column, share: float, floor: int, most: int = 20, small: int = 8, small_share: float = 0.5) -> Column:
    """How many of n clips to keep back: a share of them, `most` at most, so that `floor` stay; none of a single one."""
    pct = F.when(n <= small, F.least(F.lit(share), F.lit(small_share))).otherwise(F.lit(share))
    return F.when(n <= 1, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(most), F.floor(n * pct), n - floor))).cast("int")


def remapped(x: Column, low: float, high: float) -> Column:
    """0..1 mapped on a straight line from low to high."""
    return low + clip01(x) * (high - low)


def interval_bounds(minima: list[Column], maxima: list[Column]) -> Column:
    """Struct (low, high): the greatest minimum and the least maximum; crossed bounds raise an error."""
    low, high = F.greatest(*minima), F.least(*maxima)
    crossed = F.raise_error(F.format_string("bounds cross: %s > %s", low.cast("string"), high.cast("string")))
    return F.struct(low.alias("low"), F.when(low > high, crossed.cast("double")).otherwise(high).alias("high"))


def lookup(key: Column, table: dict, default) -> Column:
    """Value of a fixed table, or the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def overall_status(stages: Column, neutral: list[str]) -> Column:
    """'failed' if no stage is complete, 'partial' if some aren't, else 'completed'; an unavailable neutral stage doesn't count."""
    entries = F.filter(F.map_entries(stages), lambda e: ~(e["key"].isin(neutral) & (e["value"] == "unavailable")))
    done = F.size(F.filter(entries, lambda e: e["value"] == "completed"))
    return F.when((done == F.size(entries)) & (done > 0), "completed").when(done > 0, "partial").otherwise("failed")


def missing_stages(required: list[str], done: Column) -> Column:
    return F.array_except(F.array(*[F.lit(r) for r in required]), done)


def clamp_source(start: Column, length: Column, available: Column, headroom: float = 0.1) -> Column:
    """Struct (start, length) moved and cut to end before the source does; an unknown source leaves them."""
    room = F.greatest(available - headroom, F.lit(0.0))
    s = F.when(available.isNull(), start).otherwise(F.least(start, room))
    return F.struct(s.alias("start"), F.when(available.isNull(), length).otherwise(F.least(length, room - F.least(start, room))).alias("length"))


def progress(value: Column, completed: Column) -> Column:
    """0..100; what isn't a number gives 0, and 99.9 is the most before completion."""
    finite = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
    v = F.greatest(F.lit(0.0), F.least(F.lit(100.0), finite))
    return F.when(completed, 100.0).otherwise(F.least(v, F.lit(99.9)))


def key_number(key: Column, prefix: str) -> Column:
    """12 of 'clip_12' or '12'; null for what doesn't parse."""
    return F.nullif(F.regexp_extract(key, rf"^(?:{prefix})?(\d+)$", 1), F.lit("")).try_cast("long")


def at_share(values: Column, share: Column) -> Column:
    """Element at int(share * size), clamped to the array."""
    return F.try_element_at(values, (F.greatest(F.lit(0), F.least(F.size(values) - 1, F.floor(share * F.size(values)))) + 1).cast("int"))


def at_span(values: Column, share: Column) -> Column:
    """Element at int(share * (size - 1)): the last one only at a share of 1."""
    return F.try_element_at(values, (F.greatest(F.lit(0), F.least(F.size(values) - 1, F.floor(share * (F.size(values) - 1)))) + 1).cast("int"))


def phase_distance(a: Column, b: Column, period: Column) -> Column:
    """Distance of two instants on a circle of one period."""
    r = F.pmod(b - a, period)
    return F.least(r, period - r)


def folded(value: Column, wanted: Column, factors: tuple[float, ...] = (0.5, 1.0, 2.0), tolerance: float = 0.02) -> Column:
    """The multiple of value nearest to wanted if it lies within the tolerance, else value."""
    off = F.array_min(F.array(*[F.struct(F.abs(value * f - wanted).alias("d"), (value * f).alias("v")) for f in factors]))
    return F.when(off["d"] <= wanted * tolerance, off["v"]).otherwise(value)


def chance_rate(tolerance: float, interval: Column) -> Column:
    """Share of hits that chance alone gives within a tolerance on both sides; 1 where hits have no distance."""
    return F.when(interval == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tolerance / interval))


def confidence_of(state: Column, values: dict[str, float], otherwise: float = 0.0) -> Column:
    """The confidence of a state by name; an unknown or null one has the last value."""
    out = F.lit(otherwise)
    for name, value in reversed(values.items()):
        out = F.when(state == name, F.lit(value)).otherwise(out)
    return out


def share_of_full(value: Column, full: float, invalid: float = 0.5) -> Column:
    """value / full, 1 at most; a null or NaN value is taken as `invalid`."""
    return F.when(value.isNull() | F.isnan(value), F.lit(invalid)).otherwise(F.least(value / full, F.lit(1.0)))


def transition_kind(energy: Column, on_beat: Column, loud: float = 0.8, quiet: float = 0.3) -> Column:
    """'hard_cut' where it is loud and on a beat, 'fade' where it is quiet, else 'crossfade'."""
    return F.when((energy > loud) & on_beat, "hard_cut").when(energy < quiet, "fade").otherwise("crossfade")


def cut_confidence(on_beat: Column, value: Column, middle: float) -> Column:
    """0.5, plus 0.3 on a beat, plus 0.2 by how near the value lies to the middle, kept in 0..1."""
    return clip01(0.5 + F.when(on_beat, 0.3).otherwise(0.0) + 0.2 * (1 - F.abs(value - middle) / middle))


def signed_factor(base: Column, bonus: Column) -> Column:
    """base grown by the factor 1 + bonus if it is positive, else divided by it, so that a bonus always helps."""
    return F.when(base >= 0, base * (1 + bonus)).otherwise(base / (1 + bonus))
