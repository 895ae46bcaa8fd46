"""Numbers, dates, JSON payloads and model answers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Money and year wording, limits.
MONEY_KEYWORD = r"(?iU)(?:стоимость|цена|оплата|tuition|fee|платн\w*)[^\d]{0,40}([\d\s]{3,9})\s*(?:тг|тенге|₸|tg|kzt)?"
MONEY_ANY = r"(?iU)([\d\s]{4,9})\s*(?:(?:тг|тенге)\b|₸\b)"
MONEY_LOOSE = r"(?U)([\d\s]{3,})"
YEARS = r"(?iU)(\d)\s*(?:год|года|лет|years?|г\.)"
YEARS_LOOSE = r"(?iU)(\d+)\s*(?:год|года|лет|г\.)"
MONEY_MIN, MONEY_MAX = 50_000, 50_000_000
PHONE_RULE = r"^[0-9+\-\s()]{4,}$"
EMAIL_RULE = r"^[^@\s]+@[^@\s]+$"
NUMBER_RULE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _digits(col: Column) -> Column:
    raw = F.regexp_replace(col, r"(?U)\s", "")
    return F.when(raw.rlike(r"^\d+$"), raw.try_cast("bigint"))


def parse_money(col: Column) -> Column:
    """Price of a text: after a price word, else a number with a currency."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(X.text(col), MONEY_KEYWORD, 1), F.lit("")),
        F.nullif(F.regexp_extract(X.text(col), MONEY_ANY, 1), F.lit("")),
    )
    value = _digits(found)
    return F.when(value.between(MONEY_MIN, MONEY_MAX), value.cast("double"))


def parse_money_cell(col: Column) -> Column:
    """Price of a table cell: first run of digits, no upper limit."""
    value = _digits(F.nullif(F.regexp_extract(X.text(col), MONEY_LOOSE, 1), F.lit("")))
    return F.when(value >= MONEY_MIN, value.cast("double"))


def parse_years(col: Column) -> Column:
    years = F.regexp_extract(X.text(col), YEARS, 1).try_cast("int")
    return F.when(years.between(1, 8), years)


def parse_years_cell(col: Column) -> Column:
    """Years of a table cell: with a year word, or the whole cell a digit 1-8."""
    worded = F.regexp_extract(X.text(col), YEARS_LOOSE, 1).try_cast("int")
    bare = F.when(F.trim(X.text(col)).rlike("^[1-8]$"), F.trim(col).try_cast("int"))
    return F.coalesce(worded, bare)


def normalize_cost(col: Column) -> Column:
    """Positive price, or NULL; text prices may hold blanks, a currency, a comma."""
    s = F.regexp_replace(F.lower(col.cast("string")), f"[ {X.NBSP}₸]|тг|тґ", "")
    value = F.translate(s, ",", ".").try_cast("double")
    return F.when(value > 0, value)


def normalize_duration(col: Column, most: int = 10) -> Column:
    """First whole number of the value when it lies in 1..most, else NULL."""
    years = F.regexp_extract(col.cast("string"), r"(\d+)", 1).try_cast("int")
    return F.when(years.between(1, most), years)


def iso_week_key(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def date_label(ts: Column, kind: str) -> Column:
    if kind == "weeks":
        return iso_week_key(ts)
    return F.date_format(ts, {"days": "dd MMM", "months": "MMM", "minute": "dd.MM.yyyy HH:mm"}[kind])


def join_list(col: Column, sep: str = ", ") -> Column:
    return F.array_join(col, sep)


def split_list(col: Column) -> Column:
    parts = F.transform(F.split(X.text(col), ","), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def stable_ticket(*keys: Column) -> Column:
    """Repeatable ticket code in UUID form, from the key of the row."""
    h = F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


FORM_SCHEMA = "array<struct<name:string,label:string,type:string,required:boolean>>"


def parse_form(schema_json: Column) -> Column:
    """Fields of a form definition, which may itself be stored as JSON text."""
    unwrapped = F.when(
        F.trim(schema_json).startswith('"'),
        F.from_json(F.concat(F.lit('{"v":'), schema_json, F.lit("}")), "struct<v:string>")["v"],
    ).otherwise(schema_json)
    return F.filter(F.coalesce(F.from_json(unwrapped, FORM_SCHEMA), F.array()), lambda f: f["name"].isNotNull())


def broken_fields(form: Column, payload_json: Column) -> Column:
    """Array of ``field:rule`` for every rule of a parsed form that a submission breaks, by form order."""
    payload = F.from_json(payload_json, "map<string,string>")

    def broken(f):
        value = F.trim(F.try_element_at(payload, f["name"]))
        missing = F.coalesce(value, F.lit("")) == ""
        rule = (
            F.when((f["type"] == "number") & ~value.rlike(NUMBER_RULE), "number")
            .when((f["type"] == "email") & ~value.rlike(EMAIL_RULE), "email")
            .when((f["type"] == "phone") & ~value.rlike(PHONE_RULE), "phone")
        )
        fault = F.when(missing, F.when(F.coalesce(f["required"], F.lit(False)), "required")).otherwise(rule)
        return F.concat(f["name"], F.lit(":"), fault)

    return F.filter(F.transform(form, broken), lambda e: e.isNotNull())


def validate_payload(schema_json: Column, payload_json: Column) -> Column:
    """``broken_fields`` with the form read in each row; ``operators.answers.validate_payloads`` reads each form once."""
    return broken_fields(parse_form(schema_json), payload_json)


# Up to the first quote with an even number of backslashes before it. No group repeats: such a loop would recurse.
JSON_STRING = r'"(?>((?s:.*?)(?<!\\)(?:\\\\)*+)")'


def _json_text(col: Column) -> Column:
    """Decode the escapes of a JSON string body."""
    return F.from_json(F.concat(F.lit('{"v":"'), col, F.lit('"}')), "struct<v:string>")["v"]


def _leaves(col: Column) -> Column:
    """All string values of a JSON text in document order, keys left out."""
    hits = F.regexp_extract_all(col, F.lit(JSON_STRING + r"(?!\s*:)(?=\s*[,\]}])"), F.lit(1))
    decoded = F.transform(hits, lambda s: F.trim(_json_text(s)))
    return F.array_join(F.filter(decoded, lambda s: s != ""), "\n\n")


def parse_model_output(col: Column):
    """(summary, specialties) of a model answer, whatever shape the model chose."""
    body = F.regexp_extract(X.text(col), r"(?s)\{.*\}", 0)
    raw = F.from_json(body, "map<string,string>")

    def pick(m, *keys):
        return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])

    summary = F.trim(pick(raw, "summary", "разбор", "личный разбор"))
    nested = summary.rlike(r"^[\{\[]")
    inner = F.when(F.startswith(summary, F.lit("{")), F.from_json(summary, "map<string,string>"))
    own = F.from_json(pick(raw, "specialties", "специальности"), "array<string>")
    from_inner = F.from_json(pick(inner, "specialties", "специальности"), "array<string>")
    names = F.when(F.size(own) > 0, own).otherwise(from_inner)
    names = F.coalesce(names, F.array().cast("array<string>"))
    names = F.filter(F.transform(names, lambda s: F.trim(s)), lambda s: (s != "") & (s != "0"))
    rest = F.map_filter(inner, lambda k, v: ~k.isin("specialties", "специальности"))
    flat = F.when(inner.isNotNull(), _paragraphs(F.map_values(rest))).otherwise(_leaves(summary))
    return F.nullif(F.when(nested, flat).otherwise(summary), F.lit("")), names


def _paragraphs(values: Column) -> Column:
    """Texts of decoded values; a value that is JSON itself gives its own texts."""
    def one(v):
        inside = v.rlike(r"^\s*[\{\[]") & F.try_parse_json(v).isNotNull()
        return F.when(inside, _leaves(v)).otherwise(F.trim(v))

    return F.array_join(F.filter(F.transform(values, one), lambda s: s != ""), "\n\n")
