"""Programme titles in three languages: noise, junk, scores, quality flags.

Two rule sets exist. ``LINK_RULES`` cleans links already in the catalogue,
``FILE_RULES`` cleans programme files before import. They differ in weights and
in what counts as junk, so they are data here and share the expressions.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .plan import settle, spread

# Phrases and patterns that mark a title as noise or junk.
ENGLISH_TEST = "ағылшын тілі деңгейін"
GROUP_HEADINGS = (
    "инженерия және инженерлік іс|инженерия и инженерное дело|көлік қызметтері|"
    "транспортные услуги|воздушный транспорт и технологии"
)
NOISE = (
    r"^[–—\-\•\*]+\s*",
    r"^\d{1,2}\s+",
    rf"^{X.CODE}\s*",
    r"\d{2}\.\d{2}\.\d{4}\s*[-–—]\s*\d{2}\.\d{2}\.\d{4}",
    r"(?i)\(?\s*первичн\w*\s*\)?",
    r"(?i)\b\d\s*(?:год|года|лет)\b",
    r"\b[ВB]\d{2,3}\b\s*[-–—:]?\s*",
)
LEADING_SHORT_WORD = r"^[а-яё]{1,3}\s+(?=[А-ЯЁ])"
DATE = r"\d{2}\.\d{2}\.\d{4}"
# Words and blanks after the first word, ending in a word; one class instead of a repeated group, which would recurse.
RUSSIAN_RUN = r"[А-Яа-яЁё]+\s[А-Яа-яЁё0-9\-\(\)«»\",./\s]*[А-Яа-яЁё0-9\-\(\)«»\",./]"
RUSSIAN_WORD = r"[А-Яа-яЁё]{6,}"
UI_WORDS = "cookie|javascript|privacy|войти|login|меню|главная"


@dataclass(frozen=True)
class TitleRules:
    hard: bool
    lang_score: dict = field(hash=False)
    code_bonus: int
    plain_bonus: int
    mash_penalty: int
    length_range: tuple
    length_bonus: int
    no_code_lead_bonus: int
    short_code_penalty: int
    mash_limit: int
    years_any_case: bool


# Weights of the two rule sets.
LINK_RULES = TitleRules(
    hard=False, lang_score={"ru": 100, "kk": 20, "en": 10, "mix": 5}, code_bonus=10, plain_bonus=0,
    mash_penalty=20, length_range=(12, 100), length_bonus=10, no_code_lead_bonus=5,
    short_code_penalty=5, mash_limit=45, years_any_case=False,
)
FILE_RULES = TitleRules(
    hard=True, lang_score={"ru": 100, "kk": 30, "en": 20, "mix": 8}, code_bonus=20, plain_bonus=15,
    mash_penalty=0, length_range=(8, 130), length_bonus=5, no_code_lead_bonus=0,
    short_code_penalty=0, mash_limit=48, years_any_case=True,
)


def mash(col: Column, rules: TitleRules) -> Column:
    return X.is_mash(col, rules.mash_limit, any_case=not rules.hard)


def strip_noise(col: Column, rules: TitleRules = LINK_RULES) -> Column:
    steps = NOISE + ((LEADING_SHORT_WORD,) if rules.hard else ())
    return X.norm(reduce(lambda c, p: F.regexp_replace(c, "(?U)" + p, ""), steps, col))


def is_fragment(col: Column) -> Column:
    """Left-over of a bad split. Expects a normalised title."""
    n = F.length(col)
    return (
        ((n < 8) & ~F.contains(col, F.lit(" ")))
        | (col.rlike(r"^[а-яё]{1,3}\s") & (n < 25))
        | col.rlike(r"[(«]$")
        | (X.letters(col, r"\p{L}") < 8)
    )


def is_junk(col: Column, rules: TitleRules = LINK_RULES) -> Column:
    """Not a programme title at all. Expects a normalised title."""
    low = F.lower(col)
    junk = (F.length(col) < 3) | col.rlike(f"^{X.CODE}$") | low.rlike(f"^({GROUP_HEADINGS})$")
    if not rules.hard:
        return (
            junk
            | X.has(low, ENGLISH_TEST, "уровень английского")
            | low.rlike(r"(?U)^в\d{2,3}\b")
            | low.rlike(r"^–\s*(инженерия|көлік|транспорт)")
        )
    return (
        junk
        | X.has(low, ENGLISH_TEST, "білім беру бағдарламасына түсушілерге")
        | (low.rlike(r"(?U)^в\d{2,3}\b") & X.has(low, "транспорт", "воздуш", "air ", "әуе"))
        | low.rlike(r"^–\s*(инженерия|көлік)")
        | col.rlike(r"[(«]$")
        | (col.rlike(r"^[а-яё]{1,2}\s") & (F.length(col) < 35) & (X.detect_lang(col) != "ru"))
        | (X.letters(col, f"A-Za-zА-Яа-яЁё{X.KAZAKH_BOTH}") < 6)
    )


def extract_russian(col: Column, rules: TitleRules = LINK_RULES) -> Column:
    """Longest Russian phrase of a multilingual title, the first on ties."""
    runs = F.regexp_extract_all(col, F.lit("(?U)" + RUSSIAN_RUN), F.lit(0))
    if not rules.hard:
        words = F.regexp_extract_all(col, F.lit(RUSSIAN_WORD), F.lit(0))
        runs = F.when(F.size(runs) > 0, runs).otherwise(words)
    good = F.filter(
        F.transform(runs, X.norm),
        lambda s: (F.length(s) >= 10)
        & (X.detect_lang(s) == "ru")
        & ~is_junk(s, rules)
        & (F.lit(True) if rules.hard else ~is_fragment(s)),
    )
    longest = F.aggregate(
        good, F.lit(""), lambda best, s: F.when(F.length(s) > F.length(best), s).otherwise(best)
    )
    return F.nullif(longest, F.lit(""))


def title_years(col: Column, any_case: bool = False) -> Column:
    digit = F.regexp_extract(col, ("(?iU)" if any_case else "(?U)") + r"(\d)\s*(?:год|года|лет)", 1)
    years = digit.try_cast("int")
    return F.when(years.between(1, 8), years)


def _unusable(col: Column, rules: TitleRules) -> Column:
    if rules.hard:
        return (col == "") | is_junk(col, rules)
    return (F.length(col) < 3) | is_junk(col, rules) | is_fragment(col)


def title_score(lang: Column, code: Column, clean: Column, raw: Column, raw_mash: Column, rules: TitleRules) -> Column:
    n = F.length(clean)
    low, high = rules.length_range
    points = [
        reduce(lambda acc, kv: F.when(lang == kv[0], kv[1]).otherwise(acc), rules.lang_score.items(), F.lit(0)),
        F.when(code.isNotNull(), rules.code_bonus).otherwise(0),
        F.when(raw_mash, -rules.mash_penalty).otherwise(rules.plain_bonus),
        F.when(n.between(low, high), rules.length_bonus).otherwise(0),
        F.when(raw.rlike(DATE), 0).otherwise(5),
        F.when(clean.rlike("^6[BbВв]"), 0).otherwise(rules.no_code_lead_bonus),
        F.when((n < 8) & code.isNotNull(), -rules.short_code_penalty).otherwise(0),
    ]
    return reduce(lambda a, b: a + b, points).cast("int")


def analyze_titles(df, rules: TitleRules, name: str = "name", qual: str = "qualification", code: str | None = None):
    """Add raw, code, clean, lang, score, drop and hint columns for every title.

    Run it on a table of distinct titles; links and programmes join the result,
    so the regular expressions see each title once however often it is offered.
    The titles are dealt to all tasks first: a title is few bytes and much work.
    """
    out = spread(df).withColumn("raw", X.norm(F.col(name)))
    found = X.extract_code(F.col("raw"))
    if code:
        found = F.coalesce(X.extract_code(F.col(code)), found)
    out = out.withColumn("title_code", F.coalesce(found, X.extract_code(F.col(qual))))
    out = out.withColumn("raw_mash", mash(F.col("raw"), rules))
    out = out.withColumn(
        "working",
        F.when(F.col("raw_mash"), F.coalesce(extract_russian(F.col("raw"), rules), F.col("raw"))).otherwise(F.col("raw")),
    )
    out = out.withColumn("first_try", strip_noise(F.col("working"), rules))
    out = out.withColumn(
        "clean",
        F.when(_unusable(F.col("first_try"), rules), strip_noise(F.col("raw"), rules)).otherwise(F.col("first_try")),
    )
    out = out.withColumn("drop", is_junk(F.col("raw"), rules) | _unusable(F.col("clean"), rules))
    if rules.hard:
        again = F.coalesce(extract_russian(F.col("clean"), rules), F.col("clean"))
        out = out.withColumn("clean", F.when(mash(F.col("clean"), rules), again).otherwise(F.col("clean")))
    out = out.withColumn("lang", X.detect_lang(F.col("clean")))
    out = out.withColumn(
        "score", title_score(F.col("lang"), F.col("title_code"), F.col("clean"), F.col("raw"), F.col("raw_mash"), rules)
    )
    out = out.withColumn("hint", title_years(F.col("raw"), rules.years_any_case))
    return settle(out.drop("raw_mash", "working", "first_try"))


def link_group_key(code: Column, clean: Column) -> Column:
    return F.coalesce(code, F.concat(F.lit("name:"), X.fingerprint(clean)))


def file_group_key(code: Column, clean: Column) -> Column:
    """Full codes group by code, group codes by code and name, the rest by name."""
    fp = X.fingerprint(clean)
    return (
        F.when(code.rlike(r"^6В\d{5,}$"), F.concat(F.lit("full:"), code))
        .when(code.rlike(r"^6В\d{2,4}$"), F.concat(F.lit("grp:"), code, F.lit(":"), fp))
        .otherwise(F.concat(F.lit("n:"), fp))
    )


def quality_flags(col: Column) -> Column:
    """Array of the names of all checks a title fails, in a fixed order."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(flag)) for flag, bad in flag_checks(col)]))


def flag_checks(col: Column) -> list[tuple[str, Column]]:
    """(name, whether a title fails it) of all checks."""
    n = X.norm(col)
    low = F.lower(n)
    lang = X.detect_lang(n)
    return [
        ("empty_or_too_short", F.length(n) < 3),
        ("code_only", n.rlike(f"^{X.CODE}$")),
        ("has_accreditation_date", n.rlike(DATE)),
        ("has_accreditation_label", X.has(low, "первичн")),
        ("leading_index", n.rlike(r"^\d{1,2} ")),
        ("leading_code_in_name", n.rlike(f"^{X.CODE} ")),
        ("group_code_label", low.rlike(r"(?U)^в\d{2,3}\b")),
        ("english_test_junk", X.has(low, ENGLISH_TEST)),
        ("kazakh_only", lang == "kk"),
        ("english_only", lang == "en"),
        ("mixed_script", lang == "mix"),
        ("multilang_mash", X.is_mash(n, 50, any_case=False)),
        ("possible_fragment", n.rlike("^[а-яё]{1,3} [А-ЯЁ]") & (F.length(n) < 40)),
        ("broken_trailing", n.rlike(r"[(«]$")),
        ("ui_junk", low.rlike(UI_WORDS)),
        ("too_long", F.length(n) > 160),
        ("too_few_letters", X.letters(n, f"A-Za-zА-Яа-яЁё{X.KAZAKH_BOTH}") < 8),
    ]


def describe(name: Column, exact: dict, keywords, default: tuple) -> list[Column]:
    """Description texts of a title: its own, else of the first keyword pattern, else the default.

    Every entry is a tuple of texts; ``{name}`` in a text stands for the title.
    """
    low = F.lower(X.text(name))

    def fill(text):
        return F.replace(F.lit(text), F.lit("{name}"), X.text(name))

    def column(i):
        branches = [(name == title, fill(texts[i])) for title, texts in exact.items()]
        branches += [(low.rlike("(?U)" + pattern), fill(texts[i])) for pattern, texts in keywords]
        return X.cases(branches).otherwise(fill(default[i]))

    return [column(i) for i in range(len(default))]
