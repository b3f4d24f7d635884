"""Column expressions over JSON records, dates and documents' projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The date formats that are tried in order after ISO forms.
DATE_FORMATS = ["yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d", "yyyy/M/d"]
#: Words of pages that stand in place of the wanted one, in the order in which they are looked for.
BLOCK_MARKERS = [
    "just a moment", "attention required", "checking your browser", "verify you are human",
    "enable javascript and cookies", "access denied", "403 forbidden", "unusual traffic",
    "are you a robot", "captcha", "cf-chl", "__cf_chl", "ddos-guard",
    "访问频次异常", "操作太频繁", "请稍候再试", "请稍后再试", "您两次操作间隔", "人机验证",
    "拖动滑块", "访问链接异常", "检测到非正常操作", "账号异常",
]
#: A page of fewer characters that loads one of these scripts is blocked too.
SHELL_LENGTH, SHELL_SCRIPTS, SHELL = 600, ["challenge-platform", "/cdn-cgi/challenge"], "short_challenge_shell"


def dig(record: Column, path: str) -> Column:
    """The value at a dot path of a JSON text, through lists by number; ``$.`` in front is ignored; null if absent."""
    steps = [p for p in path.removeprefix("$").strip(".").split(".") if p]
    return F.get_json_object(record, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in steps))


def dig_any(record: Column, paths: list[str]) -> Column:
    """The first value of several paths that is neither absent nor empty."""
    return F.coalesce(*(F.nullif(F.nullif(dig(record, p), F.lit("")), F.lit("[]")) for p in paths))


def as_whole(value: Column) -> Column:
    """A whole number from a number or its text, fractions cut; null if it is none."""
    return value.try_cast("double").cast("long")


def as_boolean(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "1", "yes", "y", "on"), True).when(low.isin("false", "0", "no", "n", "off", ""), False)


def as_date(value: Column) -> Column:
    """A timestamp from the text of an ISO form or of one of the known formats; null for anything else, digits included."""
    s = F.trim(value)
    tried = [F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS]
    iso = F.regexp_replace(F.regexp_replace(s, "Z$", "+00:00"), r"(?<=:\d\d|[T ]\d\d|[.,]\d{1,9})([+-]\d\d):?(\d\d)?$", "$1:$2")
    iso = F.regexp_replace(F.regexp_replace(iso, r"([+-]\d\d):$", "$1:00"), r"^(.{10}[T ]\d\d)(?![:\d])", "$1:00")
    iso = F.regexp_replace(iso, r"^(.{10}[T ]\d\d:\d\d)(?!:)", "$1:00")
    iso = F.when(s.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d(:\d\d(:\d\d([.,]\d{1,9})?)?)?(Z|[+-]\d\d(:?\d\d)?)?$"), F.replace(iso, F.lit(","), F.lit(".")).try_cast("timestamp"))
    return F.coalesce(iso, F.when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd"))), *tried)


def as_epoch(value: Column) -> Column:
    """A timestamp from a number of seconds since 1970; null where that is out of range."""
    seconds = value.try_cast("double")
    return F.when(seconds.between(-62_135_596_800, 253_402_300_799), F.timestamp_micros((seconds * 1_000_000).cast("long")))


def date_at(record: Column, paths: list[str]) -> Column:
    """The date at the first filled one of several paths of a JSON text: a number is an epoch, a text is read as a date."""
    whole = F.try_parse_json(record)
    is_text = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(whole, variant_path(p), "variant")) == "STRING", F.lit(False))
    tried = [F.when(dig_any(record, [p]).isNotNull(), F.struct(dig(record, p).alias("v"), is_text(p).alias("text"))) for p in paths]
    first = F.coalesce(*tried)
    return F.when(first["text"], as_date(first["v"])).otherwise(as_epoch(first["v"]))


def variant_path(path: str) -> str:
    steps = [p for p in path.removeprefix("$").strip(".").split(".") if p]
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in steps)


def results_state(record: Column, path: str) -> Column:
    """What a results path holds: ``rows``, ``empty`` (an answer), ``map``, ``wrong_type`` or ``absent`` (drift)."""
    found = dig(record, path) if path else record
    return F.when(found.isNull(), "absent").when(found == "[]", "empty").when(F.startswith(found, F.lit("[")), "rows").when(F.startswith(found, F.lit("{")), "map").otherwise("wrong_type")


def blocked_by(html: Column) -> Column:
    """The first marker of a block page that a text holds, or ``SHELL`` for a short page of a challenge; null for none."""
    low = F.lower(F.coalesce(html, F.lit("")))
    shell = (F.length(html) < SHELL_LENGTH) & reduce(Column.__or__, (F.contains(low, F.lit(m)) for m in SHELL_SCRIPTS))
    return F.coalesce(*(F.when(F.contains(low, F.lit(m)), m) for m in BLOCK_MARKERS), F.when(shell, SHELL))


def window(text: Column, start: Column, size: int, back: int = 400) -> Column:
    """STRUCT<text, next>: a page of a text from place ``start``, ending after a line feed of its last ``back`` characters if there is one.

    ``next`` is null at the end; pages one after another give the whole text.
    """
    raw = F.substring(text, start + 1, F.lit(size))
    last = F.greatest(F.length(raw) - back, F.lit(0))
    tail = F.substring(raw, last + 1, F.lit(back))
    cut = F.when(F.contains(tail, F.lit("\n")), F.length(raw) - F.length(F.substring_index(tail, "\n", -1))).otherwise(F.length(raw))
    more = start + F.length(raw) < F.length(text)
    page = F.when(more, F.substring(raw, F.lit(1), cut)).otherwise(raw)
    return F.struct(page.alias("text"), F.when(more, start + F.length(page)).alias("next"))


def pages(text: Column, size: int, back: int = 400) -> Column:
    """ARRAY<STRUCT<start, text, next>>: all pages of a text by ``window``, one after another; an empty text has one empty page."""
    step = lambda start: F.struct(start.cast("int").alias("start"), (w := window(text, start, size, back))["text"].alias("text"), w["next"].cast("int").alias("next"))
    turn = lambda found, _: F.when(F.element_at(found, -1)["next"].isNull(), found).otherwise(F.concat(found, F.array(step(F.element_at(found, -1)["next"]))))
    # a page ends behind the first of its last ``back`` characters at the earliest
    most = F.ceil(F.length(text) / (size - back)).cast("int")
    return F.when(text.isNotNull(), F.aggregate(F.sequence(F.lit(0), most), F.array(step(F.lit(0))), turn))


def agent_view(content: Column, cap: int = 2000) -> Column:
    """STRUCT<content, content_truncated, content_full_chars> for readers with little room."""
    return F.struct(F.substring(content, 1, cap).alias("content"), (F.length(content) > cap).alias("content_truncated"), F.length(content).alias("content_full_chars"))


def summary_line(source: Column, title: Column, author: Column, date: Column) -> Column:
    """One line; what is null leaves no trace."""
    return F.concat_ws(" | ", F.concat(F.lit("["), source, F.lit("]")), F.nullif(title, F.lit("")), author, F.date_format(date, "yyyy-MM-dd"))


def quoted(value: Column) -> Column:
    """A YAML scalar: double quotes where the plain form would be read as something else."""
    odd = value.rlike(r"""[:#\[\]{}"'&*!|>%@`,\\\n]|^[\s-]|\s$""") | (value == "")
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(odd, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)


def markdown(fields: dict[str, Column], title: Column, content: Column) -> Column:
    """A front matter of the fields that are not null, then the title and the content."""
    lines = [F.concat(F.lit(f"{k}: "), quoted(v.cast("string"))) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""), content)


def handles(urls: Column) -> Column:
    """STRUCT<transcribable, captioned>: links that lead to audio and to captioned video."""
    audio = lambda u: F.lower(u).rlike(r"podcasts\.apple\.com|\.(mp3|m4a|wav|aac|ogg|flac|opus)$")
    return F.struct(F.filter(urls, audio).alias("transcribable"), F.filter(urls, lambda u: u.rlike(r"youtube\.com|youtu\.be")).alias("captioned"))


def first_signal(signals: Column, kinds: list[str]) -> Column:
    """The greatest value of a map of signals (value, kind) of the given kinds; null if none has one."""
    values = F.transform(F.filter(F.map_values(signals), lambda s: s["kind"].isin(kinds)), lambda s: s["value"])
    return F.array_max(values)


def cache_lifetime(rows: Column, ttl: Column, reached: Column) -> Column:
    """Seconds that an answer is kept: an empty one for five minutes at most, unless the source was reached and said so."""
    return F.when((rows > 0) | reached, ttl).otherwise(F.least(ttl, F.lit(300)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def midpoint(low: Column, high: Column) -> Column:
    """The middle of two bounds, or the one that is given; null for none, never a made-up zero."""
    return (F.coalesce(low, high) + F.coalesce(high, low)) / 2


def log_attention(value: Column) -> Column:
    """Attention on a scale of its logarithm, 1 at about ten thousand; none and negative ones are 0."""
    return F.when(value > 0, F.least(F.lit(1.0), F.log10(1 + value) / 4)).otherwise(F.lit(0.0))


def comment_anchor(source: Column, source_id: Column, comment: Column) -> Column:
    """Where a quoted comment stands."""
    return F.concat(source, F.lit(":"), source_id, F.lit("#comment-"), comment)
