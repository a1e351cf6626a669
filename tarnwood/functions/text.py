"""Column functions on text: splitting, cleaning, n-gram distance, labels, Chinese time phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "^[\\u4e00-\\u9fa5]+$"


def strip_spaces(s: Column) -> Column:
    return F.regexp_replace(s, r"\s", "")


def normalised_row(s: Column) -> Column:
    """Line ends become a full stop, other white space a comma (both full width)."""
    return F.regexp_replace(F.regexp_replace(s, r"[\r\n]+", "。"), r"\s", "，")


def sentences(s: Column, delimiters: str = "[.;]") -> Column:
    """Pieces between delimiters, empty ones at the end kept."""
    return F.split(s, delimiters)


def words(s: Column) -> Column:
    """Lower-case words of letters (any script) and apostrophes."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}']+)"), 1)


def chunks(s: Column, n: int = 2) -> Column:
    """Consecutive pieces of n characters, the last one shorter; one pass, since substring() counts from the text's beginning."""
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))


def ngram_distance(a: Column, b: Column, n: int = 2) -> Column:
    """Number of chunks of both minus n times the number of different chunks that both have."""
    x, y = chunks(a, n), chunks(b, n)
    return F.size(x) + F.size(y) - n * F.size(F.array_intersect(x, y))


def is_stop(word: Column, stop: Column, language: str = "cn") -> Column:
    """stop: array of stop words. White space and dashes are stops, and for cn whatever is not all CJK."""
    bad = F.array_contains(stop, word) | word.rlike(r"\s") | word.contains("——")
    return bad | ~word.rlike(CJK) if language == "cn" else bad


def bmes(word: Column) -> Column:
    """Position labels of a word's characters: S, or B, M..., E."""
    return F.when(F.length(word) <= 1, "S").otherwise(F.concat(F.lit("B"), F.repeat(F.lit("M"), F.length(word) - 2), F.lit("E")))


_DIGITS = "0123456789"


def chinese_number(s: Column) -> Column:
    """Chinese digits to ASCII, with ten in all its places; unit characters are removed."""
    d = F.translate(s, "零〇一二两三四五六七八九", "001223456789")
    d = F.regexp_replace(d, "([0-9])十([0-9])", "$1$2")
    d = F.regexp_replace(d, "([0-9])十", "$10")
    d = F.regexp_replace(d, "十([0-9])", "1$1")
    return F.regexp_replace(F.regexp_replace(d, "十", "10"), "[时点分年月日号钟秒]", "")


_N = "[0-9零〇一二两三四五六七八九十]"


def time_grade(s: Column) -> Column:
    """Granularity of the first time expression: year 5, month 4, day 3, hour or part of day 2, else null."""
    return (
        F.when(s.rlike(f"前年|去年|今年|明年|后年|{_N}+年"), 5).when(s.rlike(f"{_N}+月"), 4).when(s.rlike(f"前天|昨天|今天|明天|后天|{_N}+[日号]"), 3)
        .when(s.rlike(f"{_N}+[点时]|早上|上午|中午|下午|晚上|凌晨"), 2)
    )


def time_phrases(s: Column) -> Column:
    """Time expressions of a text, in order: runs of date and clock parts."""
    part = f"(?:前年|去年|今年|明年|后年|前天|昨天|今天|明天|后天|早上|上午|中午|下午|晚上|凌晨|{_N}+(?:年|月|日|号|点钟|点|时|分))"
    return F.regexp_extract_all(s, F.lit(f"({part}+)"), 1)


def phrase_time(s: Column, now: Column) -> Column:
    """`Y-M-D,` or `Y-M-D,H:MM` of a phrase, from the date `now`; relative days move through months and years."""

    def number(pattern: str) -> Column:
        return F.expr("cast(null as int)") if not pattern else F.nullif(chinese_number(F.regexp_extract(s, pattern, 1)), F.lit("")).cast("int")

    years = F.when(s.contains("前年"), -2).when(s.contains("去年"), -1).when(s.contains("明年"), 1).when(s.contains("后年"), 2).otherwise(0)
    days = F.when(s.contains("前天"), -2).when(s.contains("昨天"), -1).when(s.contains("明天"), 1).when(s.contains("后天"), 2).otherwise(0)
    base = F.date_add(now, days)
    year = F.coalesce(number(f"({_N}{{2,4}})年"), F.year(base)) + F.when(number(f"({_N}{{2,4}})年").isNull(), years).otherwise(0)
    month, day = F.coalesce(number(f"({_N}+)月"), F.month(base)), F.coalesce(number(f"({_N}+)[日号]"), F.dayofmonth(base))
    hour, minute = number(f"({_N}+)[点时]"), number(f"({_N}+)分")
    clock = F.when(hour.isNull(), "").otherwise(F.concat(hour.cast("string"), F.lit(":"), F.lpad(F.coalesce(minute, F.lit(0)).cast("string"), 2, "0")))
    return F.concat(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), F.lit(","), clock)


def hms(seconds: Column) -> Column:
    return F.struct(F.floor(seconds / 3600).alias("h"), F.floor((seconds % 3600) / 60).alias("m"), F.floor(seconds % 60).alias("s"))
