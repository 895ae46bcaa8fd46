"""Text columns: whitespace, scripts, codes, hosts, cities, names.

Java regular expressions treat ``\\s``, ``\\w`` and ``\\b`` as ASCII unless
``(?U)`` is given, and fold only ASCII case unless ``(?iU)`` is given. The
patterns below carry the flag wherever Cyrillic text can meet it.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets and default names of the catalogue domain.
KAZAKH = "әғқңөұүһі"
KAZAKH_BOTH = "әғқңөұүһіӘҒҚҢӨҰҮҺІ"
NBSP = " "
DEFAULT_GROUP = "Образовательные программы"
CODE = "6[BbВв][0-9]{2,6}"
GENERIC_WORDS = (
    "университет|university|институт|академия|имени|им|республики|казахстан|колледж|college"
)
# Host names that never identify an institution.
JUNK_HOSTS = ("zero.kz", "facebook.com", "instagram.com")
# Words that say nothing about which institution is meant.
RELATED_STOP_STRICT = (
    "университет", "university", "институт", "академия", "имени", "им", "казахский",
    "казахская", "казахстанский", "национальный", "международный", "республики", "казахстан",
)
RELATED_STOP = RELATED_STOP_STRICT + ("астана", "алматы", "колледж", "college")
SCORE_STOP = (
    "университет", "university", "институт", "академия", "имени", "им",
    "казахский", "казахская", "казахстанский", "национальный", "республики",
    "казахстан", "г", "в", "и", "of", "the", "at",
)
LATIN_NAME = "nur-sultan"
CITY_WORDS = (
    ("almaty", ("алматы", "almaty")),
    ("astana", ("астана", "astana", "нур-султан", LATIN_NAME)),
    ("shymkent", ("шымкент", "shymkent")),
)


def has(col: Column, *words: str) -> Column:
    """True when the column holds any of the literal words."""
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def is_blank(col: Column) -> Column:
    """NULL, empty, ``'0'``, zero or false, whatever the column type."""
    return F.coalesce(col.cast("string"), F.lit("")).isin("", "0", "0.0", "false")


def is_zero(col: Column) -> Column:
    """NULL, zero, or no number at all; cheaper than ``is_blank`` for prices and terms."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0)) == 0


def norm(col: Column) -> Column:
    return F.trim(F.regexp_replace(text(col), r"(?U)\s+", " "))


def letters(col: Column, keep: str) -> Column:
    """Number of characters of the class ``keep``."""
    return F.length(F.regexp_replace(col, f"[^{keep}]", ""))


def norm_name(col: Column) -> Column:
    return norm(F.translate(F.lower(text(col)), "ё«»\"'“”", "е"))


def score_name(col: Column) -> Column:
    """Normal form used for fuzzy scores: punctuation becomes a blank."""
    return norm(F.regexp_replace(F.translate(F.lower(text(col)), "ё", "е"), r"[«»\"'().,\-–—]", " "))


def soft_name(col: Column) -> Column:
    s = F.regexp_replace(norm_name(col), rf"(?U)\b({GENERIC_WORDS})\b", "")
    s = F.regexp_replace(s, r"(?U)\bказах(стан)?ск\w*\b", "каз")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"(?U)астаны\b", "астана")
    return norm(F.regexp_replace(s, r"(?U)\b\p{L}\.\b", ""))


def fingerprint(col: Column) -> Column:
    return F.regexp_replace(F.lower(norm(col)), "[^a-zа-яё0-9]+", "")


def detect_lang(col: Column) -> Column:
    low = F.lower(text(col))
    cyrillic, latin = low.rlike("[а-яё]"), low.rlike("[a-z]")
    return (
        F.when(low.rlike(f"[{KAZAKH}]"), "kk")
        .when(cyrillic & latin, "mix")
        .when(cyrillic, "ru")
        .when(latin, "en")
        .otherwise("xx")
    )


def is_mash(col: Column, limit: int, any_case: bool = True) -> Column:
    """Several languages in one title."""
    low = F.lower(col)
    kazakh, russian = low.rlike(f"[{KAZAKH}]"), low.rlike("[а-яё]")
    english = (low if any_case else col).rlike("[a-z]{4,}")
    return (kazakh & (russian | english)) | (russian & english & (F.length(col) > limit))


def canonical_code(col: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(col)), "^6B", "6В")


def extract_code(col: Column) -> Column:
    hit = F.regexp_extract(text(col), CODE, 0)
    return F.when(hit != "", canonical_code(hit))


def normalize_code(col: Column) -> Column:
    """Code of a nested file: no blanks, Cyrillic second letter."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text(col)), "^6[Bb]", "6В"), r"(?U)\s+", "")
    return F.when(s != "", s)


def website_host(col: Column) -> Column:
    host = F.lower(F.regexp_replace(F.try_parse_url(col, F.lit("HOST")), r"^www\.", ""))
    return F.when((host != "") & ~host.isin(*JUNK_HOSTS), host)


def city_key(*cols: Column, cities: int = 3, latin: bool = True) -> Column:
    """Key of the first city named; without ``latin`` the Latin spelling of a former name is unknown."""
    low = F.lower(F.concat_ws(" ", *cols))
    out = F.lit("")
    for key, words in reversed(CITY_WORDS[:cities]):
        known = words if latin else [w for w in words if w != LATIN_NAME]
        out = F.when(has(low, *known), key).otherwise(out)
    return out


def city_label(location: Column, address: Column) -> Column:
    """Latin city name for geocoding, else the first part of the location."""
    key = city_key(location, address)
    return F.when(key != "", F.initcap(key)).otherwise(
        F.coalesce(F.nullif(F.trim(F.split_part(location, F.lit(","), F.lit(1))), F.lit("")), F.lit("Kazakhstan"))
    )


def words_of(col: Column, split: str) -> Column:
    return F.filter(F.split(col, split), lambda t: t != "")


def related_tokens(col: Column, stop: tuple[str, ...] = RELATED_STOP) -> Column:
    """Distinct words of at least five letters, minus generic words."""
    words = words_of(F.lower(text(col)), r"[^\p{L}\p{N}]+")
    return F.array_except(
        F.filter(words, lambda t: F.length(t) >= 5), F.array(*[F.lit(w) for w in stop])
    )


def score_tokens(col: Column) -> Column:
    """Distinct words of at least three letters or pure ASCII, from a ``score_name``."""
    words = F.filter(words_of(col, " "), lambda t: (F.length(t) >= 3) | t.rlike(r"^[\x00-\x7f]+$"))
    return F.array_except(words, F.array(*[F.lit(w) for w in SCORE_STOP]))


def is_college(col: Column) -> Column:
    return has(F.lower(text(col)), "колледж", "college")


def names_related(a: Column, b: Column, strict: bool = False) -> Column:
    """Same name, same soft form, or a shared distinctive word of the same kind."""
    stop = RELATED_STOP_STRICT if strict else RELATED_STOP
    same = F.lower(text(a)) == F.lower(text(b))
    share = F.arrays_overlap(related_tokens(a, stop), related_tokens(b, stop))
    if strict:
        return same | share
    soft = (soft_name(a) != "") & (soft_name(a) == soft_name(b))
    return soft | same | (share & (is_college(a) == is_college(b)))


def clean_program_name(col: Column) -> Column:
    return F.regexp_replace(norm(col), r"(?iU)^(ОП|образовательная программа|программа)\s*[:\-]?\s*", "")


def absolute_url(path: Column, base: str) -> Column:
    """External addresses stay, everything else is put under ``base``."""
    p = F.trim(path)
    return F.when(is_blank(p), F.lit(None).cast("string")).when(p.rlike("(?i)^https?://"), p).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(p, "^/+", ""))
    )


def clip(col: Column, n: int, tail: str = "") -> Column:
    if not tail:
        return F.substring(col, 1, n)
    return F.when(F.length(col) > n, F.concat(F.rtrim(F.substring(col, 1, n)), F.lit(tail))).otherwise(col)


def message(template: str, *cols: Column) -> Column:
    return F.format_string(template, *cols)


def first_rule(col: Column, rules, how: str = "contains", default: Column | None = None) -> Column:
    """Value of the first rule that fits; ``rules`` is an ordered list of (pattern, value).

    ``how``: contains | rlike | startswith. The list is configuration, so it
    becomes one CASE expression inside the scan stage and needs no join.
    """
    rules = [(p, v if isinstance(v, Column) else F.lit(v)) for p, v in rules]
    hits = {
        "contains": lambda p: F.contains(col, F.lit(p)),
        "startswith": lambda p: F.startswith(col, F.lit(p)),
        "rlike": lambda p: col.rlike(p),
    }[how]
    out = cases([(hits(p), v) for p, v in rules])
    return out if default is None else out.otherwise(default)


def cases(branches) -> Column:
    """One flat CASE of (condition, value) pairs, first fit wins."""
    (first, value), *rest = branches
    return reduce(lambda c, b: c.when(*b), rest, F.when(first, value))


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` mentions it."""
    return F.get(F.transform(F.array(value), fn), 0)


def plain_host(col: Column) -> Column:
    """Host of an address, lower case and without ``www.``; no host is left out."""
    return F.regexp_replace(F.lower(F.try_parse_url(col, F.lit("HOST"))), r"^www\.", "")


def norm_or_null(col: Column) -> Column:
    return F.nullif(norm(col), F.lit(""))
