"""Documents for readers: what is known of a file, and why work on one failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import lookup
from ..functions.text import word_wrapped

#: Bits of 64 that may differ between matching pictures (fixed value).
MATCH_BITS = 12
#: What to do about a failure at a stage.
ADVICE = {
    "probe": "The container looks damaged. Write it anew and queue the copy.",
    "encode": "Every variant failed. Read the end of the log; look at the driver first.",
    "duration": "The length of the result is off. The timestamps may be broken: write the source anew and queue the copy.",
    "audio_short": "The audio ends before the picture. Look for warnings of the step before and run the file again.",
    "sync_drift": "The audio drifts. A delay cannot mend that; measure it along the file and conform it.",
    "sync_offset": "A constant delay remains. Set it by hand with the value in this log.",
    "exception": "Unexpected error. The details are below.",
}
_NO_ADVICE = "See details below."
_WIDTH, _RULE = 17, 66


def _line(name: str, value: Column, when: Column | None = None) -> Column:
    text = F.concat(F.lit(name.ljust(_WIDTH) + ": "), value)
    return text if when is None else F.when(when, text)


def _section(title: str, *lines: Column) -> Column:
    return F.concat_ws("\n", F.lit(f"\n{title}\n{'-' * len(title)}"), *lines)


def _stacked(name: str, values: Column) -> Column:
    """The first value beside the name, the others below it."""
    return F.when(F.size(values) > 0, _line(name, F.array_join(values, "\n" + " " * (_WIDTH + 2))))


def _given(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")) != ""


def full_sheet(name: Column, found: Column, parsed: Column, seen: Column, info: Column, plan: Column, source: Column, of_source: Column) -> Column:
    """A sheet of four sections; lines without content are left out, and wording follows the verdict and what was measured.

    found (null: no match): title, original_title, date, id, imdb_id, runtime,
    genres, language, franchise, directors, writers, composers, cast, studios,
    rating, votes, synopsis, episode_title, air_date, confidence, runtime_note;
    parsed: title, season, episode (null: a film); seen (null: not checked):
    verdict, distance, how, matched_at, frames, every, images, image; info:
    codec, w, h, fps, depth, hdr, dur, audios, subs; plan: space, cq, filters,
    notes.
    """
    names = lambda values, n: F.array_join(F.slice(values, 1, n), ", ")
    some = lambda values: F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0
    episode = parsed["episode"].isNotNull()
    synopsis = F.array_join(F.transform(word_wrapped(found["synopsis"]), lambda x: F.concat(F.lit("  "), x)), "\n")
    known = F.concat_ws(
        "\n",
        _line("title", F.coalesce(found["title"], F.lit(""))),
        _line("original title", found["original_title"], _given(found["original_title"]) & ~found["original_title"].eqNullSafe(found["title"])),
        _line("year", F.left(F.coalesce(found["date"], F.lit("")), F.lit(4))),
        _line("season / episode", F.format_string("S%02dE%02d", F.coalesce(parsed["season"], F.lit(0)), parsed["episode"]), episode),
        _line("episode title", found["episode_title"], episode & _given(found["episode_title"])),
        _line("air date", found["air_date"], episode & _given(found["air_date"])),
        _line("database id", found["id"].cast("string")),
        _line("imdb id", found["imdb_id"], _given(found["imdb_id"])),
        _line("runtime", F.concat(found["runtime"].cast("string"), F.lit(" min")), found["runtime"] > 0),
        _line("genres", F.array_join(found["genres"], ", "), some(found["genres"])),
        _line("language", found["language"], _given(found["language"])),
        _line("franchise", found["franchise"], _given(found["franchise"])),
        *[_line(n, names(found[f"{n}s"], 4), some(found[f"{n}s"])) for n in ("director", "writer", "composer")],
        _stacked("cast", F.slice(found["cast"], 1, 8)),
        _line("studio", names(found["studios"], 3), some(found["studios"])),
        _line("rating", F.format_string("%.1f from %d votes", found["rating"], F.coalesce(found["votes"], F.lit(0))), found["rating"] > 0),
        F.when(F.trim(F.coalesce(found["synopsis"], F.lit(""))) != "", F.concat(F.lit("\nsynopsis:\n"), synopsis)),
    )
    unknown = F.concat(F.lit("no match; the fields below describe the file only\n"), _line("parsed title", F.coalesce(parsed["title"], F.lit(""))))
    verdict, measured = F.coalesce(seen["verdict"], F.lit("not_checked")), seen["distance"].isNotNull()
    note = lambda *lines: F.lit("  note".ljust(_WIDTH) + ": " + ("\n" + " " * (_WIDTH + 2)).join(lines))
    checks = _section(
        "VERIFICATION",
        _line("match confidence", F.coalesce(found["confidence"], F.lit("")), found.isNotNull()),
        _line("runtime check", found["runtime_note"], _given(found["runtime_note"])),
        _line("visual check", verdict),
        _line("  closest frame", F.concat(seen["distance"].cast("string"), F.lit(f" of 64 bits differ ({MATCH_BITS} or fewer is a match)")), measured),
        _line("  matched on", F.concat(F.coalesce(seen["how"], F.lit("?")), F.coalesce(F.concat(F.lit(" at "), seen["matched_at"].cast("string"), F.lit("s into the film")), F.lit(""))), measured),
        _line("  compared", F.concat(F.coalesce(seen["frames"], F.lit(0)).cast("string"), F.lit(" frames"), F.when(seen["every"] > 0, F.concat(F.lit(" (one every "), seen["every"].cast("string"), F.lit("s)"))).otherwise(""), F.lit(" against "), F.coalesce(seen["images"], F.lit(0)).cast("string"), F.lit(" reference images")), measured),
        _line("  reference", seen["image"], measured & _given(seen["image"])),
        F.when(verdict == "no_reference_images", note("no usable image for this title, so nothing", "to compare with; not a failed match.")),
        F.when(verdict == "unverified", note("no close match. Reference pictures need not be", "frames of the film; this does not contradict", "the identification.")),
    )
    measures = [
        _line("codec", F.format_string("%s %dx%d %.3f fps %d-bit", F.coalesce(info["codec"], F.lit("")), F.coalesce(info["w"], F.lit(0)), F.coalesce(info["h"], F.lit(0)), F.coalesce(info["fps"], F.lit(0.0)), F.coalesce(info["depth"], F.lit(0)))),
        _line("colour", F.when(_given(info["hdr"]), info["hdr"]).otherwise("sdr")),
        _line("duration", F.format_string("%d min %02d s", F.floor(info["dur"] / 60), F.floor(info["dur"]) % 60), info["dur"] > 0),
        _line("audio tracks", F.coalesce(info["audios"], F.lit(0)).cast("string")),
        _line("subtitle tracks", F.coalesce(info["subs"], F.lit(0)).cast("string")),
    ]
    first = _section("SOURCE", _line("file", source), *measures)
    origin = _line("originally", source, _given(source) & (source != name))
    later = _section("THIS FILE AS IT STANDS", _line("file", F.when(_given(name), name).otherwise(source)), origin, F.lit("note".ljust(_WIDTH) + ": measured from the finished file"), *measures)
    work = _section(
        "PROCESSING",
        _line("video", F.concat(F.lit("AV1 "), F.coalesce(plan["space"], F.lit("")), F.lit(", cq "), F.coalesce(plan["cq"].cast("string"), F.lit("")))),
        _line("filters", F.when(_given(plan["filters"]), plan["filters"]).otherwise("none")),
        _stacked("decisions", plan["notes"]),
    )
    head = F.concat(F.lit("=" * _RULE + "\n"), name, F.lit("\n" + "=" * _RULE))
    return F.concat_ws("\n", head, _section("IDENTIFICATION", F.when(found.isNotNull(), known).otherwise(unknown)), checks, F.when(of_source, first).otherwise(later), work, F.lit(""))


def failure_document(item: Column, stage: Column, at: Column, parts: dict[str, Column], attempts: Column, ledger: Column) -> Column:
    """Why work on an item failed: advice, JSON of each part that is known, attempts and the ledger.

    attempts: array of (cq, variant, rc, cmd, tail); ledger: array of (stage,
    video, audio) with durations in seconds.
    """
    seconds = lambda values: F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda x: F.format_string("%.1f", x)), ", ")).otherwise("none")
    tried = F.transform(attempts, lambda a: F.concat_ws("\n", F.format_string("\nATTEMPT cq=%s variant=%s rc=%s", a["cq"].cast("string"), a["variant"], a["rc"].cast("string")), F.concat(F.lit("CMD: "), F.coalesce(a["cmd"], F.lit(""))), F.transform(a["tail"], lambda t: F.concat(F.lit("  | "), t))))
    rows = F.transform(ledger, lambda r: F.format_string("  %-14s %9.1fs  %s", r["stage"], F.coalesce(F.array_max(r["video"]), F.lit(0.0)), seconds(r["audio"])))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("=" * 70 + "\nfailure diagnostic\nfile: "), item, F.lit("\nstage: "), stage, F.lit("\ntime: "), at, F.lit("\n\nSUGGESTED FIX: "), lookup(ADVICE, stage, _NO_ADVICE), F.lit("\n")),
        *[F.when(part.isNotNull(), F.concat(F.lit(f"{title}:\n"), F.to_json(part))) for title, part in parts.items()],
        F.when(F.size(attempts) > 0, F.array_join(tried, "\n")),
        F.when(F.size(ledger) > 0, F.concat(F.lit("\nPROVENANCE LEDGER:\n"), F.format_string("  %-14s %10s  %s\n", F.lit("stage"), F.lit("video"), F.lit("audio tracks")), F.array_join(rows, "\n"))),
    )


def failed_rows(failures: DataFrame, key: str, stage: str, *rest: str) -> DataFrame:
    """The rows that a log gets for failed items."""
    return failures.select(key, F.lit("failed").alias("status"), F.col(stage).alias("stage"), *rest)
