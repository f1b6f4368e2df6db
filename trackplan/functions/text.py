"""Text rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of scripts, and languages that a share of a script settles, in order.
SCRIPTS = {
    "kana": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}]",
    "han": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]",
    "hangul": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]",
    "cyrillic": r"[\x{0400}-\x{04FF}\x{0500}-\x{052F}]",
    "arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]",
    "hebrew": r"[\x{0590}-\x{05FF}]",
    "thai": r"[\x{0E00}-\x{0E7F}]",
    "greek": r"[\x{0370}-\x{03FF}]",
    "devanagari": r"[\x{0900}-\x{097F}]",
}
LATIN = r"[A-Za-z\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]"
SETTLED = [("hangul", 0.20, "kor"), ("cyrillic", 0.30, "rus"), ("arabic", 0.30, "ara"), ("hebrew", 0.30, "heb"), ("thai", 0.30, "tha"), ("greek", 0.30, "ell"), ("devanagari", 0.30, "hin"), ("latin", 0.60, "latin")]
BANNED = '<>:"/\\|?*'


def clock_seconds(text: Column) -> Column:
    """`H:M:S.f` as seconds, 0 if it can't be read."""
    parts = F.split(text, ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.coalesce(F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2)), F.lit(0.0))


CUE_TIME = r"(\d+):(\d+):(\d+)[,.](\d+)"


def cue_seconds(text: Column) -> Column:
    """`HH:MM:SS,mmm` as seconds; null if it can't be read."""
    part = lambda i: F.regexp_extract(text, CUE_TIME, i)
    return F.when(text.rlike(CUE_TIME), part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double") + F.rpad(F.left(part(4), F.lit(3)), 3, "0").try_cast("double") / 1000)


def cue_time(seconds: Column) -> Column:
    """Seconds as `HH:MM:SS,mmm`, negatives as 0."""
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000).cast("long"))
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat(two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def human_duration(seconds: Column) -> Column:
    """`7h 30m`, `10m 05s` or `45s`."""
    s = F.greatest(F.lit(0), seconds.cast("long"))
    return F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s / 60) % 60)).when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def path_tag(path: Column) -> Column:
    return F.left(F.md5(path.cast("binary")), F.lit(8))


def safe_name(text: Column, underscores: bool = True) -> Column:
    """A name that file systems take: banned marks, control characters, dashes, commas and runs of spaces go."""
    out = F.translate(F.coalesce(text, F.lit("")), BANNED, " " * len(BANNED))
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit("and")), r"[\p{C}]", "")
    out = F.regexp_replace(out, r"\s*[-–—]+\s*", " ")
    out = F.regexp_replace(F.regexp_replace(out, ",", ""), r"\s+", " ")
    out = F.regexp_replace(out, r"^[ .]+|[ .]+$", "")
    if underscores:
        out = F.regexp_replace(F.regexp_replace(F.replace(out, F.lit(" "), F.lit("_")), "_+", "_"), "^_+|_+$", "")
    return out


def strip_suffix(text: Column, codec: str = "AV1") -> Column:
    return F.regexp_replace(text, rf"(?i)([\s_-]+{codec})+$", "")


def build_name(title: Column, year: Column, season: Column, episode: Column, episode_title: Column, group: Column, height: Column, codec: str = "AV1", most: int = 170) -> Column:
    """Title-(Year)-SxxEyy-Episode-Group-CODEC_Hp; empty parts are left out, and its own output is unchanged by it."""
    part = lambda c: F.nullif(safe_name(strip_suffix(c, codec)), F.lit(""))
    number = F.when(season.isNotNull() & episode.isNotNull(), F.format_string("S%02dE%02d", season, episode))
    stem = F.concat_ws("-", part(title), F.when(year.isNotNull(), F.format_string("(%d)", year)), number, part(episode_title), group)
    return F.concat_ws("-", F.left(stem, F.lit(most)), F.format_string(f"{codec}_%dp", height))


def parsed_path(path: Column) -> Column:
    """struct(title, year, season, episode) of a file path's stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    episode, year = r"[Ss](\d{1,2})[Ee](\d{1,3})", r"((?:19|20)\d{2})"
    title = F.get(F.split(stem, rf"{episode}|{year}"), F.lit(0))
    title = F.regexp_replace(F.regexp_replace(title, r"[._]+", " "), r"^[ \-(]+|[ \-(]+$", "")
    number = lambda pattern, i: F.nullif(F.regexp_extract(stem, pattern, i), F.lit("")).try_cast("int")
    return F.struct(title.alias("title"), number(year, 1).alias("year"), number(episode, 1).alias("season"), number(episode, 2).alias("episode"))


def embedded_ids(tags: Column) -> Column:
    """struct(imdb, tmdb): the first tt number in any value, the digits of a value whose key names tmdb."""
    values = F.map_values(tags)
    imdb = F.array_compact(F.transform(values, lambda v: F.nullif(F.regexp_extract(v, r"(tt\d{7,9})", 1), F.lit(""))))
    entries = F.filter(F.map_entries(tags), lambda e: F.contains(F.lower(e["key"]), F.lit("tmdb")))
    tmdb = F.array_compact(F.transform(entries, lambda e: F.nullif(F.regexp_extract(e["value"], r"(\d+)", 1), F.lit(""))))
    return F.struct(F.get(imdb, F.lit(0)).alias("imdb"), F.get(tmdb, F.lit(0)).alias("tmdb"))


def word_key(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), "^_|_$", "")


def script_profile(text: Column) -> Column:
    """struct of letter counts for each script: Latin ones of the whole text, the others of what lies beyond Latin in it."""
    text = F.coalesce(text, F.lit(""))
    counts = lambda beyond: F.struct(*[F.regexp_count(beyond, F.lit(p)).alias(s) for s, p in SCRIPTS.items()], F.regexp_count(text, F.lit(LATIN)).alias("latin"))
    # the rest is made once, and in most texts it is short
    return F.transform(F.array(F.regexp_replace(text, r"[\x{0000}-\x{024F}]+", "")), counts)[0]


def sniffed_language(profile: Column, least: int = 40) -> Column:
    """The language that a profile settles: scripts are tried in a fixed order."""
    names = [*SCRIPTS, "latin"]
    total = sum((profile[n] for n in names[1:]), profile[names[0]])
    share = lambda n: profile[n] / total
    case = F.when(total < least, "unknown").when(share("kana") > 0.04, "jpn").when(share("han") > 0.20, F.when(profile["kana"] > 0, "jpn").otherwise("chi"))
    for script, limit, language in SETTLED:
        case = case.when(share(script) > limit, language)
    return case.otherwise("unknown")


def xml_escaped(text: Column) -> Column:
    out = text
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def filter_path(path: Column) -> Column:
    """A path inside a filter's option: forward slashes, quotes escaped once, colons for both parsers that read them."""
    out = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.replace(F.replace(out, F.lit("'"), F.lit("\\'")), F.lit(":"), F.lit("\\\\:"))


def word_wrapped(text: Column, width: int = 64) -> Column:
    """Lines of at most `width` characters, broken at spaces; longer words stand alone."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    empty = F.array().cast("array<string>")

    def step(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        joined = F.concat(last, F.lit(" "), word)
        return F.when(F.size(lines) == 0, F.array(word)).when(F.char_length(joined) <= width, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(joined))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(words, empty, step)


def release_year(date: Column, otherwise: Column) -> Column:
    four = F.left(date, F.lit(4))
    return F.coalesce(F.when(four.rlike(r"^\d{4}$"), four.try_cast("int")), otherwise)


def gib(size: Column) -> Column:
    return F.format_string("%.2f GiB", size / float(1 << 30))
