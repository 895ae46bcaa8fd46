"""Multilingual title rules on hand-worked values."""
import pytest
from pyspark.sql import functions as F

from syllabase.functions import text as X
from syllabase.functions import titles as T


def values(spark, fn, inputs):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("s"))).collect()]


def check(spark, fn, table):
    assert values(spark, fn, [a for a, _ in table]) == [b for _, b in table]


def test_norm_turns_any_blank_into_one_space(spark):
    check(spark, X.norm, [("  a  b\tc ", "a b c"), (None, ""), ("", ""), (" x", "x")])


def test_norm_name_and_soft_name(spark):
    check(spark, X.norm_name, [("«Ёлка»  ‘x’", "елка ‘x’"), ("\"A\" 'b'", "a b")])
    check(spark, X.soft_name, [
        ("Казахский национальный университет имени Аль-Фараби", "каз национальный аль-фараби"),
        ("Казахстанский институт", "каз"),
        ("Университет Астаны", "астана"),
        ("Университет", ""),
    ])


def test_fingerprint_deletes_kazakh_letters(spark):
    check(spark, X.fingerprint, [("Ақпарат 12-a", "апарат12a"), ("ЁЖ", "ёж"), ("—", "")])


def test_language_by_letters(spark):
    check(spark, X.detect_lang, [
        ("Право", "ru"), ("Құқық", "kk"), ("Law", "en"), ("IT право", "mix"), ("2020", "xx"), ("", "xx"), ("І", "kk"),
    ])


def test_mash_needs_length_for_russian_with_english(spark):
    long = "Программная инженерия " + "x" * 30
    check(spark, lambda c: X.is_mash(c, 45), [("IT право", False), (long, True), ("Құқық law school", True), ("Құқық", True), ("Law", False)])


def test_codes(spark):
    check(spark, X.extract_code, [
        ("6B06101 x", "6В06101"), ("6в061", "6В061"), ("16b071", "6В071"), ("6B1", None), (None, None), ("6B0610155", "6В061015"),
    ])
    check(spark, X.normalize_code, [("6b 041", "6В041"), ("  ", None), ("7M01", "7M01"), (None, None)])


def test_noise_is_cut_in_order(spark):
    table = [
        ("12 Компьютерная инженерия 01.09.2020 - 31.08.2025 (первичная)", "Компьютерная инженерия"),
        ("– Маркетинг", "Маркетинг"), ("6В06101 Право", "Право"), ("В057 Транспорт", "Транспорт"),
        ("B057 - Транспорт", "Транспорт"), ("Архитектура 5 лет", "Архитектура"), ("Финансы (4 года)", "Финансы ()"),
        ("МВ057 Транспорт", "МВ057 Транспорт"), ("Учёт 4 годаx", "Учёт 4 годаx"),
    ]
    check(spark, T.strip_noise, table)
    check(spark, lambda c: T.strip_noise(c, T.FILE_RULES), [("ет Экономика", "Экономика"), ("ет экономика", "ет экономика")])


def test_junk_and_fragments(spark):
    check(spark, T.is_junk, [
        ("6В041", True), ("Х", True), ("Транспортные услуги", True), ("Уровень английского языка", True),
        ("в057 x", True), ("– инженерия", True), ("Право", False), ("в0571 x", False),
    ])
    check(spark, lambda c: T.is_junk(c, T.FILE_RULES), [
        ("Дизайн (", True), ("В057 Горное дело", False), ("В057 Транспорт", True), ("Право", True), ("Правовед", False),
        ("Уровень английского языка", False), ("ет құқық қорғау", True),
    ])
    check(spark, T.is_fragment, [
        ("Право", True), ("ет Экономика", True), ("Дизайн одежды («", True), ("Финансы и учёт", False), ("12 34 ab", True),
    ])


def test_longest_russian_phrase(spark):
    check(spark, T.extract_russian, [
        # A run may start inside a Kazakh word, after its last Kazakh letter.
        ("Ақпараттық жүйелер Информационные системы Information Systems", "йелер Информационные системы"),
        ("Құқықтану Информационные системы Law", "тану Информационные системы"),
        ("Құқық Юриспруденция", "Юриспруденция"), ("Law School", None),
        ("аааааа бббббб x вввввв гггггг", "аааааа бббббб"),
    ])


def test_scores_of_both_rule_sets(spark):
    df = spark.createDataFrame([
        (1, "6В06101 Информационные системы", None), (2, "Ақпараттық жүйелер", "6B061"), (3, "Х", None),
        (4, "Журналистика 01.02.2020", None), (5, "Информационные системы (4 года)", None),
    ], "id int, name string, qualification string")
    got = {r["id"]: r for r in T.analyze_titles(df, T.LINK_RULES).collect()}
    assert (got[1]["clean"], got[1]["lang"], got[1]["score"]) == ("Информационные системы", "ru", 100 + 10 + 5 + 5 + 10)
    assert (got[2]["lang"], got[2]["score"], got[2]["title_code"]) == ("kk", 20 + 10 + 5 + 5 + 10 - 20, "6В061")
    assert got[3]["drop"]
    assert got[4]["score"] == 100 + 5 + 10
    assert (got[5]["hint"], got[5]["clean"]) == (4, "Информационные системы ()")
    got = {r["id"]: r for r in T.analyze_titles(df, T.FILE_RULES).collect()}
    assert got[1]["score"] == 100 + 20 + 15 + 5 + 5
    assert got[2]["score"] == 30 + 20 + 5 + 5


@pytest.mark.parametrize("title, flags", [
    ("", ["empty_or_too_short", "too_few_letters"]),
    ("6В041", ["code_only", "too_few_letters"]),
    ("1 Экономика 01.02.2020 первичная", ["has_accreditation_date", "has_accreditation_label", "leading_index"]),
    ("6В06101 Право и закон", ["leading_code_in_name"]),
    ("В057 Транспорт", ["group_code_label"]),
    ("Ағылшын тілі деңгейін анықтау", ["english_test_junk", "kazakh_only", "multilang_mash"]),
    ("Finance and Law", ["english_only"]),
    ("IT-менеджмент проектов", ["mixed_script"]),
    ("ет Экономика", ["possible_fragment"]),
    ("Дизайн одежды (", ["broken_trailing"]),
    ("Главная страница", ["ui_junk"]),
    ("я" * 161, ["too_long"]),
])
def test_quality_flags(spark, title, flags):
    assert values(spark, T.quality_flags, [title]) == [flags]


def test_group_keys(spark):
    df = spark.createDataFrame([("6В07115", "Право"), ("6В071", "Право 1"), (None, "Ж-1")], "c string, n string")
    got = [r[0] for r in df.select(T.file_group_key(F.col("c"), F.col("n"))).collect()]
    assert got == ["full:6В07115", "grp:6В071:право1", "n:ж1"]


def test_names_related(spark):
    df = spark.createDataFrame([
        ("Esil University", "Университет Esil"), ("Esilx Alpha University", "Колледж esilx"), ("Нархоз", "«Нархоз» университет"), ("Esilx", "Академия esilx"),
    ], "a string, b string")
    got = [r[0] for r in df.select(X.names_related(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, True, True]
