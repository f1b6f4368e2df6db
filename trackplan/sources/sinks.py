"""Writing: append-only logs, reports, XML tags, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gib, human_duration, word_wrapped, xml_escaped


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a log; a batch of rows is committed as a whole."""
    rows.withColumn("updated", F.current_timestamp()).write.mode("append").parquet(path)


def compacted(log: DataFrame, keys: list[str], path: str) -> None:
    """Write the last row of each key as a new table."""
    from ..operators.queue import latest

    latest(log, keys, ["updated"]).write.mode("errorifexists").parquet(path)


def report_block(rel: Column, status: Column, size: Column, seconds: Column, notes: Column) -> Column:
    """A fixed-form text block for a finished item."""
    return F.concat_ws("\n", F.concat(F.lit("file    "), rel), F.concat(F.lit("status  "), status), F.concat(F.lit("size    "), gib(size)), F.concat(F.lit("elapsed "), human_duration(seconds)), F.when(F.size(notes) > 0, F.concat(F.lit("notes   "), F.array_join(notes, "; "))))


def ledger_line(stage: Column, video: Column, audio: Column) -> Column:
    """A fixed-width line: stage, video and audio durations."""
    durations = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.1f", x)), " ")
    return F.concat(F.rpad(stage, 20, " "), F.rpad(durations(video), 12, " "), durations(audio))


def xml_tags(levels: Column) -> Column:
    """XML of array<struct(level, name, value)>; empty values are left out, null if nothing is left."""
    full = F.filter(levels, lambda x: F.coalesce(x["value"], F.lit("")) != "")
    each = F.transform(full, lambda x: F.concat(F.lit("<Tag><Targets><TargetTypeValue>"), x["level"].cast("string"), F.lit("</TargetTypeValue></Targets><Simple><Name>"), xml_escaped(x["name"]), F.lit("</Name><String>"), xml_escaped(x["value"]), F.lit("</String></Simple></Tag>")))
    return F.when(F.size(full) > 0, F.concat(F.lit("<Tags>"), F.array_join(each, ""), F.lit("</Tags>")))


def tag_document(title: Column, date: Column, year: Column, summary: Column, number: Column, imdb: Column, collection: Column, genres: Column, episode: Column, season: Column, part: Column, part_title: Column, part_date: Column, part_summary: Column) -> Column:
    """A tag file: one level 50 for a film; for an episode its series (70), season (60) and itself (50).

    number: the id in the web database; episode: whether it is one.  Empty
    values have no line and empty levels no tag.
    """
    line = lambda name, value: F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(f"    <Simple><Name>{name}</Name><String>"), xml_escaped(value.cast("string")), F.lit("</String></Simple>")))
    released = F.when(F.coalesce(date, F.lit("")) != "", F.left(date, F.lit(4))).otherwise(year.cast("string"))
    known = F.concat(F.when(episode, "tv/").otherwise("movie/"), number.cast("string"))
    whole = [line("TITLE", title), line("DATE_RELEASED", released), line("SUMMARY", summary), line("CONTENT_TYPE", F.when(episode, "TV").otherwise("Movie")), line("TMDB", known), line("IMDB", imdb), line("COLLECTION", collection), line("GENRE", F.array_join(genres, ", "))]
    own = [line("TITLE", part_title), line("PART_NUMBER", part), line("DATE_RELEASED", part_date), line("SUMMARY", part_summary)]

    def tag(level: Column, lines: list[Column]) -> Column:
        left = F.array_compact(F.array(*lines))
        return F.when(F.size(left) > 0, F.concat(F.lit("  <Tag>\n    <Targets><TargetTypeValue>"), level, F.lit("</TargetTypeValue></Targets>\n"), F.array_join(left, "\n"), F.lit("\n  </Tag>\n")))

    tags = F.concat_ws("", tag(F.when(episode, "70").otherwise("50"), whole), F.when(episode, tag(F.lit("60"), [line("PART_NUMBER", season)])), F.when(episode, tag(F.lit("50"), own)))
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Tags>\n'), tags, F.lit("</Tags>\n"))


def info_sheet(title: Column, identification: Column, verification: Column, synopsis: Column) -> Column:
    """A readable sheet: sections with conditional lines, the synopsis wrapped at 64 characters."""
    section = lambda name, body: F.when(body != "", F.concat(F.lit(f"[{name}]\n"), body))
    return F.concat_ws("\n\n", title, section("identification", F.coalesce(identification, F.lit(""))), section("verification", F.coalesce(verification, F.lit(""))), section("synopsis", F.array_join(word_wrapped(synopsis), "\n")))


def write_text(rows: DataFrame, text: Column, path: str) -> None:
    rows.select(text.alias("value")).write.mode("append").text(path)


def settings_json(row: Column, names: list[str]) -> Column:
    """JSON of the settings that may be kept."""
    return F.to_json(F.struct(*[row[n].alias(n) for n in names]))
