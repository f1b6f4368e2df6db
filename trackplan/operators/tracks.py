"""Nested track lists: choice, order, names, and comparison by position.

Column functions take array<struct> columns.  Audio: idx, lang, ch, codec,
bit_rate, layout, title, aux.  Subtitles: idx, lang, codec, forced, sdh, title.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import audio_rank, lookup

# Fixed values.
ENGLISH, JAPANESE = ["eng", "en"], ["jpn", "ja", "jp"]
LANGUAGE_LABEL = {"eng": "English", "en": "English", "jpn": "Japanese", "ja": "Japanese", "jp": "Japanese", "chi": "Chinese", "kor": "Korean", "rus": "Russian", "ita": "Italian", "fre": "French", "fra": "French", "ger": "German", "deu": "German", "spa": "Spanish", "por": "Portuguese", "und": "Undetermined"}
FORMAT_LABEL = {"hdmv_pgs_subtitle": "PGS", "pgssub": "PGS", "dvd_subtitle": "VobSub", "dvdsub": "VobSub", "ass": "ASS", "ssa": "ASS", "subrip": "SRT", "mov_text": "SRT", "text": "SRT", "webvtt": "VTT"}
LAYOUTS = {
    "mono": ["FC"], "stereo": ["FL", "FR"], "2.1": ["FL", "FR", "LFE"], "3.0": ["FL", "FR", "FC"], "3.0(back)": ["FL", "FR", "BC"], "3.1": ["FL", "FR", "FC", "LFE"], "4.0": ["FL", "FR", "FC", "BC"], "quad": ["FL", "FR", "BL", "BR"], "quad(side)": ["FL", "FR", "SL", "SR"],
    "5.0": ["FL", "FR", "FC", "BL", "BR"], "5.0(side)": ["FL", "FR", "FC", "SL", "SR"], "5.1": ["FL", "FR", "FC", "LFE", "BL", "BR"], "5.1(side)": ["FL", "FR", "FC", "LFE", "SL", "SR"], "6.0": ["FL", "FR", "FC", "BC", "SL", "SR"], "6.1": ["FL", "FR", "FC", "LFE", "BC", "SL", "SR"], "7.0": ["FL", "FR", "FC", "BL", "BR", "SL", "SR"],
    "7.1": ["FL", "FR", "FC", "LFE", "BL", "BR", "SL", "SR"], "7.1(wide)": ["FL", "FR", "FC", "LFE", "BL", "BR", "FLC", "FRC"], "7.1(wide-side)": ["FL", "FR", "FC", "LFE", "FLC", "FRC", "SL", "SR"],
}
CENTRE_GAIN = 0.919
OPUS_LEAST, OPUS_PER_CHANNEL, OPUS_MOST = 160, 128, 768
LEFT_GAIN = {"FL": 1.0, "LFE": 0.350, "SL": 0.566, "BL": 0.566, "BC": 0.400, "FLC": 0.707}
RIGHT_GAIN = {"FR": 1.0, "LFE": 0.350, "SR": 0.566, "BR": 0.566, "BC": 0.400, "FRC": 0.707}


def _is(track: Column, languages: list[str]) -> Column:
    return F.lower(F.coalesce(track["lang"], F.lit("und"))).isin(*languages)


def _first(tracks: Column, test) -> Column:
    return F.get(F.filter(tracks, test), F.lit(0))


def language_rank(track: Column) -> Column:
    return F.when(_is(track, ENGLISH), 0).when(_is(track, JAPANESE), 1).otherwise(2)


def usable_subtitles(subs: Column, bad: Column, languages: Column) -> Column:
    """Without unreadable streams and unwanted languages (an empty list keeps all), by language, kind and idx."""
    kept = F.filter(subs, lambda s: ~F.array_contains(bad, s["idx"]) & ((F.size(languages) == 0) | F.array_contains(languages, s["lang"])))
    keyed = F.transform(kept, lambda s: F.struct(language_rank(s).alias("a"), F.when(s["sdh"], 2).when(s["forced"], 1).otherwise(0).alias("b"), s["idx"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed, lambda x, y: _compare(x, y, ["a", "b", "c"])), lambda k: k["s"])


def _compare(x: Column, y: Column, keys: list[str]) -> Column:
    case = F.lit(0)
    for k in reversed(keys):
        case = F.when(x[k] < y[k], -1).when(x[k] > y[k], 1).otherwise(case)
    return case


def best_audio(tracks: Column, languages: list[str]) -> Column:
    """The best track in these languages that isn't a commentary: lossless, tier, channels, bitrate; the first of ties."""
    pool = F.filter(F.transform(tracks, lambda t, i: F.struct(audio_rank(t["codec"], t["ch"], t["bit_rate"]).alias("r"), (-i).alias("p"), t.alias("t"))), lambda k: _is(k["t"], languages) & ~F.coalesce(k["t"]["aux"], F.lit(False)))
    wide = F.filter(pool, lambda k: k["t"]["ch"] > 2)
    pool = F.when(F.size(wide) > 0, wide).otherwise(pool)
    ranked = F.array_sort(pool, lambda x, y: F.when(x["r"] > y["r"], -1).when(x["r"] < y["r"], 1).when(x["p"] > y["p"], -1).otherwise(1))
    return F.get(ranked, F.lit(0))["t"]


def picked_audio(tracks: Column) -> Column:
    """struct(track, reason): the first English, else Japanese, else any track."""
    english, japanese = _first(tracks, lambda t: _is(t, ENGLISH)), _first(tracks, lambda t: _is(t, JAPANESE))
    reason = F.when(english.isNotNull(), "eng").when(japanese.isNotNull(), "jpn_fallback").when(F.size(tracks) > 0, "first_track_no_eng_no_jpn").otherwise("none")
    return F.struct(F.coalesce(english, japanese, F.get(tracks, F.lit(0))).alias("track"), reason.alias("reason"))


def audio_in_order(tracks: Column, picked: Column, languages: list[str], stereo_only: bool = False) -> Column:
    """Tracks of the wanted languages (all, if none are named; the picked or else the first, if there are none): English, Japanese, then the rest with the picked one first.

    With `stereo_only` a downmix stands in for the English tracks of more than
    two channels, wherever there is an English track to make it of.
    """
    kept = tracks
    if languages:
        kept = F.filter(tracks, lambda t: _is(t, [x.lower() for x in languages]))
        kept = F.when(F.size(kept) > 0, kept).when(picked.isNotNull(), F.filter(tracks, lambda t: t["idx"] == picked["idx"])).otherwise(F.slice(tracks, 1, 1))
    if stereo_only:
        kept = F.when(best_audio(tracks, ENGLISH).isNotNull(), F.filter(kept, lambda t: ~_is(t, ENGLISH) | (t["ch"] <= 2))).otherwise(kept)
    keyed = F.transform(kept, lambda t, i: F.struct(language_rank(t).alias("a"), F.when((language_rank(t) == 2) & ~t["idx"].eqNullSafe(picked["idx"]), 1).otherwise(0).alias("b"), i.alias("c"), t.alias("t")))
    return F.transform(F.array_sort(keyed, lambda x, y: _compare(x, y, ["a", "b", "c"])), lambda k: k["t"])


def audio_slots(tracks: Column) -> Column:
    """array<struct(kind, idx, lang)>: boosted and original English and then Japanese; without English one foreign track.

    A lone track that is neither English nor Japanese takes the English slots.
    """
    english, japanese = best_audio(tracks, ENGLISH), best_audio(tracks, JAPANESE)
    lone = F.when((F.size(tracks) == 1) & english.isNull() & japanese.isNull(), F.get(tracks, F.lit(0)))
    english = F.coalesce(english, lone)
    primary = F.coalesce(japanese, picked_audio(tracks)["track"])
    spoken = F.lower(F.coalesce(primary["lang"], F.lit("und")))
    slot = lambda kind, track, lang: F.when(track.isNotNull(), F.struct(F.lit(kind).alias("kind"), track["idx"].alias("idx"), lang.alias("lang")))
    with_english = F.array(slot("boosted", english, F.lit("eng")), slot("original", english, F.lit("eng")), slot("japanese", japanese, F.lit("jpn")))
    return F.array_compact(F.when(english.isNotNull(), with_english).otherwise(F.array(slot("foreign", primary, F.when(spoken.isin("ja", "jp"), "jpn").otherwise(spoken)))))


def subtitle_slots(subs: Column, english_audio: Column) -> Column:
    """struct(s1, s2, s3) of idx: forced English (or full English without English audio), English, Japanese."""
    full = _first(subs, lambda s: _is(s, ENGLISH) & ~s["forced"])
    forced = _first(subs, lambda s: _is(s, ENGLISH) & s["forced"])
    first = F.coalesce(forced["idx"], F.when(~english_audio, full["idx"]))
    return F.struct(first.alias("s1"), F.when(~first.eqNullSafe(full["idx"]), full["idx"]).alias("s2"), _first(subs, lambda s: _is(s, JAPANESE))["idx"].alias("s3"))


def planned_audio(tracks: Column, mixable: Callable[[Column], Column]) -> Column:
    """struct(slots, notes): the slots of `audio_slots` with stereo, native_stereo (carried as it is, without a mix) and title.

    mixable(track): whether there is a boosted mix for its layout.
    """

    def described(s: Column) -> Column:
        track = F.get(F.filter(tracks, lambda t: t["idx"] == s["idx"]), F.lit(0))
        wide, mixed, ch = track["ch"] > 2, mixable(track), F.coalesce(F.nullif(track["ch"], F.lit(0)), F.lit(2)).cast("string")
        boosted = F.when(~mixed, "English stereo").when(wide, "English stereo downmix (dialogue boosted)").otherwise("English stereo (dialogue boosted)")
        spoken = F.when(s["lang"] == "jpn", "Japanese ").otherwise("Original ")
        title = F.when(s["kind"] == "boosted", boosted).when(s["kind"] == "original", F.concat(F.lit("English original "), ch, F.lit("ch"))).otherwise(F.concat(spoken, ch, F.lit("ch")))
        first = s["kind"] == "boosted"
        return F.struct(s["kind"].alias("kind"), s["idx"].alias("idx"), s["lang"].alias("lang"), first.alias("stereo"), (first & ~mixed).alias("native_stereo"), title.alias("title"))

    slots = F.transform(audio_slots(tracks), described)
    lone = (F.size(tracks) == 1) & ~F.exists(tracks, lambda t: _is(t, ENGLISH) | _is(t, JAPANESE))
    foreign = _first(slots, lambda s: s["kind"] == "foreign")["lang"]
    notes = F.array(F.when(lone, F.concat(F.lit("single_audio_track_kept_lang_"), F.coalesce(F.nullif(F.get(tracks, F.lit(0))["lang"], F.lit("")), F.lit("und")))), F.concat(F.lit("audio_foreign_primary_unboosted_"), foreign))
    return F.struct(slots.alias("slots"), F.array_compact(notes).alias("notes"))


def planned_subtitles(subs: Column, generated: Column, english_audio: Column) -> Column:
    """struct(slot1, slot2, slot3, rest): `blank`, a source's number, `generated <lang>`, or null; and the numbers left over.

    subs: usable source tracks in their order; generated: languages of the
    tracks this run made, which stand in where the source has none.  The first
    slot is what a player opens on: forced English, else full English where no
    audio is English, else a blank track.
    """
    source = lambda t: F.when(t.isNotNull(), t["idx"].cast("string"))
    made = lambda lang: F.when(F.array_contains(generated, lang), F.lit(f"generated {lang}"))
    forced = source(_first(subs, lambda s: _is(s, ENGLISH) & s["forced"]))
    english = F.coalesce(source(_first(subs, lambda s: _is(s, ENGLISH) & ~s["forced"])), made("eng"))
    japanese = F.coalesce(source(_first(subs, lambda s: _is(s, JAPANESE))), made("jpn"))
    leads = forced.isNull() & ~english_audio & english.isNotNull()
    first = F.coalesce(forced, F.when(leads, english), F.lit("blank"))
    second = F.when(~leads, english)
    rest = F.filter(F.transform(subs, lambda s: s["idx"].cast("string")), lambda i: ~(i.eqNullSafe(first) | i.eqNullSafe(second) | i.eqNullSafe(japanese)))
    return F.struct(first.alias("slot1"), second.alias("slot2"), japanese.alias("slot3"), rest.alias("rest"))


def in_track_order(tracks: Column, slots: Column) -> Column:
    """Tracks named by slots come first in their order, the rest (from 90 on) as they were."""
    keyed = F.transform(tracks, lambda t, i: F.struct(F.coalesce(F.nullif(F.array_position(slots, t["idx"]), F.lit(0)) - 1, F.lit(90) + i).alias("a"), t.alias("t")))
    return F.transform(F.array_sort(keyed, lambda x, y: _compare(x, y, ["a"])), lambda k: k["t"])


def position_of(tracks: Column, idx: Column) -> Column:
    """Position of a stream number among the tracks, 0 if it isn't there."""
    return F.greatest(F.coalesce(F.array_position(F.transform(tracks, lambda t: t["idx"]), idx), F.lit(0)) - 1, F.lit(0))


def conform_tracks(tracks: Column, languages: Column) -> Column:
    """Tracks of the languages; all of them, if none is."""
    some = F.filter(tracks, lambda t: F.array_contains(languages, t["lang"]))
    return F.when(F.size(some) > 0, some).otherwise(tracks)


def stream_bitrate(field: Column, tags: Column) -> Column:
    """The bitrate field, else the first positive tag named BPS (with any suffix), else 0."""
    named = F.filter(F.map_entries(tags), lambda e: (F.upper(F.get(F.split(e["key"], "-"), F.lit(0))) == "BPS") & (e["value"].try_cast("long") > 0))
    return F.coalesce(F.nullif(field, F.lit(0)), F.get(named, F.lit(0))["value"].try_cast("long"), F.lit(0))


def opus_bitrate(channels: Column, bitrate: Column, source_channels: Column, lossless: Column) -> Column:
    """kb/s for a copy: so many a channel, for a lossy source at least its own rate a channel, within limits."""
    limited = lambda x: F.least(F.greatest(x, F.lit(OPUS_LEAST)), F.lit(OPUS_MOST))
    base = limited(OPUS_PER_CHANNEL * F.greatest(channels, F.lit(1)))
    own = F.when((bitrate > 0) & (source_channels > 0) & ~lossless, (bitrate / source_channels * channels / 1000.0).cast("int"))
    return limited(F.greatest(base, F.coalesce(own, base)))


def downmix(layout: Column, boost: float = 1.0) -> Column:
    """Stereo downmix expression of a channel layout, its centre multiplied by the boost; null for unknown ones."""
    channels = F.create_map(*[x for name, marks in LAYOUTS.items() for x in (F.lit(name), F.array(*map(F.lit, marks)))])[layout]

    def side(name: str, gains: dict[str, float]) -> Column:
        terms = F.transform(channels, lambda c: F.struct(c.alias("c"), lookup(gains | {"FC": CENTRE_GAIN * boost}, c, 0.0).alias("g")))
        used = F.filter(terms, lambda t: t["g"] > 0)
        return F.concat(F.lit(f"{name}="), F.array_join(F.transform(used, lambda t: F.concat(F.format_string("%.3f", t["g"]), F.lit("*"), t["c"])), "+"))

    return F.concat(F.lit("pan=stereo|"), side("FL", LEFT_GAIN), F.lit("|"), side("FR", RIGHT_GAIN))


def named_subtitles(subs: DataFrame, by: list[str]) -> DataFrame:
    """name: the title, or label and kind; names that collide in a group get their format or a running number.

    subs: by, pos, lang, codec, forced, sdh, title.
    """
    spoken = F.lower(F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("und")))
    kind = F.when(F.col("forced"), " (Forced)").when(F.col("sdh"), " (SDH)").otherwise("")
    base = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.coalesce(lookup(LANGUAGE_LABEL, spoken, None), F.initcap(spoken)), kind))
    rows = subs.withColumn("base", base)
    same = W.partitionBy(*by, "base")
    number = F.row_number().over(same.orderBy("pos"))
    label = lookup(FORMAT_LABEL, F.lower(F.col("codec")), "")
    name = F.when(F.count("*").over(same) == 1, F.col("base")).when(label != "", F.concat("base", F.lit(" ("), label, F.lit(" "), number.cast("string"), F.lit(")"))).otherwise(F.concat("base", F.lit(" "), number.cast("string")))
    return rows.withColumn("name", name).drop("base")


def compared(before: DataFrame, after: DataFrame, by: list[str], position: str, value: str, tolerance: float = 2.0) -> DataFrame:
    """Problems between two censuses, matched by position: a track that went, or is shorter by more than the tolerance."""
    a = before.select(*by, position, F.col(value).alias("was"))
    b = after.select(*by, position, F.col(value).alias("now"))
    both = a.join(b, [*by, position], "left")
    problem = F.when(F.col("now").isNull(), "missing").when((F.col("was") > 0) & (F.col("now") > 0) & (F.col("was") - F.col("now") > tolerance), "short")
    return both.withColumn("problem", problem).where("problem is not null")


def short_tracks(rows: DataFrame, by: list[str], kind: Column, duration: str, tolerance: float = 5.0) -> DataFrame:
    """Audio rows that end before their group's longest video."""
    longest = rows.where(kind == "video").groupBy(*by).agg(F.max(duration).alias("video_dur"))
    return rows.where((kind == "audio") & (F.col(duration) > 0)).join(longest, by).where(F.col("video_dur") - F.col(duration) > tolerance)


def people(credits: Column, job: str | None = None, department: str | None = None, limit: int = 8) -> Column:
    """Names of crew with the job or department, or the first cast as `name as role`; blanks are left out."""
    if job or department:
        chosen = F.filter(credits, lambda c: (c["job"] == (job or "")) | (c["department"] == (department or "")))
        names = F.transform(chosen, lambda c: c["name"])
    else:
        names = F.transform(credits, lambda c: F.concat(c["name"], F.when(F.coalesce(c["role"], F.lit("")) != "", F.concat(F.lit(" as "), c["role"])).otherwise("")))
    return F.slice(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), 1, limit)


def muxer_ids(streams: Column, tracks: Column, kind: str) -> Column:
    """array<struct(idx, id)>: streams of a probe and tracks of a muxer, matched by position among those of one kind."""
    ids = F.transform(F.filter(tracks, lambda t: t["type"] == kind), lambda t: t["id"])
    return F.transform(streams, lambda s, i: F.struct(s["idx"].alias("idx"), F.get(ids, i).alias("id")))


def ledger_problems(rows: DataFrame, by: list[str], stage: str, duration: str = "dur", tolerance: float = 2.0) -> DataFrame:
    """What each stage lost against the one before it: tracks that went (counted by kind), tracks that got shorter.

    rows: by, stage, kind, pos, duration.  Returns by, stage, kind, pos (null for a count), problem, was and now.
    """
    order = W.partitionBy(*by).orderBy(stage)
    stages = rows.select(*by, stage).distinct().withColumn("_before", F.lag(stage).over(order)).where("_before is not null")
    counts = rows.groupBy(*by, stage, "kind").agg(F.count("*").cast("double").alias("n"))
    kinds = stages.join(counts.select(*by, F.col(stage).alias("_before"), "kind", F.col("n").alias("was")), [*by, "_before"])
    gone = kinds.join(counts.withColumnRenamed("n", "now"), [*by, stage, "kind"], "left").withColumn("now", F.coalesce("now", F.lit(0.0))).where("now < was")
    after = rows.select(*by, stage, "kind", "pos", F.col(duration).alias("now"))
    before = rows.select(*by, F.col(stage).alias("_before"), "kind", "pos", F.col(duration).alias("was"))
    short = stages.join(after, [*by, stage]).join(before, [*by, "_before", "kind", "pos"]).where((F.col("was") > 0) & (F.col("now") > 0) & (F.col("was") - F.col("now") > tolerance))
    pick = lambda d, pos, problem: d.select(*by, stage, "kind", pos.alias("pos"), F.lit(problem).alias("problem"), "was", "now")
    return pick(gone, F.lit(None).cast("long"), "fewer").union(pick(short, F.col("pos").cast("long"), "short"))


def untagged_audio(tag: Column, heard: Column, english_present: Column) -> Column:
    """The language of an audio track: one without a tag, where no track is tagged English, is what was heard of it."""
    none = F.lower(F.coalesce(tag, F.lit("und"))).isin("und", "", "unk") & ~english_present
    return F.when(none & (heard == "jpn"), "jpn").when(none & (heard == "latin"), "eng").otherwise(tag)
