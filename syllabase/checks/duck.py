"""DuckDB forms of the text rules, written for RE2 (no look-around, ASCII ``\\w``)."""
from __future__ import annotations

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
SP = "[\\s\u00a0]"
NB = "\u00a0"
CODE = "6[BbВв][0-9]{2,6}"
HEADINGS = ("инженерия және инженерлік іс|инженерия и инженерное дело|көлік қызметтері|"
            "транспортные услуги|воздушный транспорт и технологии")


def sub(s, pattern, to="", flags="g"):
    return f"regexp_replace({s}, '{pattern}', '{to}', '{flags}')"


def hit(s, pattern, flags=None):
    return f"regexp_matches({s}, '{pattern}'" + (f", '{flags}')" if flags else ")")


def norm(s):
    return f"trim({sub(f'COALESCE({s}, {chr(39)*2})', SP + '+', ' ')})"


def count(s, cls):
    return f"length({sub(s, f'[^{cls}]')})"


def norm_name(s):
    return norm(f"replace({sub(f'lower({s})', '[«»\"“”' + chr(39)*2 + ']')}, 'ё', 'е')")


def score_name(s):
    return norm(sub(f"replace(lower({s}), 'ё', 'е')", "[«»\"().,–—" + chr(39) * 2 + r"\-]", " "))


def soft_name(s):
    # Blanks are doubled first, so neighbours never share one.
    generic = "университет|university|институт|академия|имени|им|республики|казахстан|колледж|college"
    out = sub(norm_name(s), " ", "  ")
    out = sub(out, f"(^|{NW})({generic})($|{NW})", r"\1\3")
    out = sub(out, f"(^|{NW})казах(?:стан)?ск{W}*($|{NW})", r"\1каз\2")
    out = norm(out)
    out = sub(out, f"астаны($|{NW})", r"астана\1")
    return norm(out)


def fingerprint(s):
    return sub(f"lower({norm(s)})", "[^a-zа-яё0-9]+")


def lang(s):
    low = f"lower({s})"
    return (f"CASE WHEN {hit(low, '[әғқңөұүһі]')} THEN 'kk' WHEN {hit(low, '[а-яё]')} AND {hit(low, '[a-z]')} THEN 'mix' "
            f"WHEN {hit(low, '[а-яё]')} THEN 'ru' WHEN {hit(low, '[a-z]')} THEN 'en' ELSE 'xx' END")


def mash(s, limit, any_case=True):
    kk, ru = hit(f"lower({s})", "[әғқңөұүһі]"), hit(f"lower({s})", "[а-яё]")
    en = hit(f"lower({s})" if any_case else s, "[a-z]{4,}")
    return f"(({kk} AND {ru}) OR ({ru} AND {en} AND length({s}) > {limit}) OR ({kk} AND {en}))"


def code(s):
    hit_ = f"NULLIF(regexp_extract(COALESCE({s}, ''), '{CODE}'), '')"
    return f"regexp_replace(upper({hit_}), '^6B', '6В')"


def strip_noise(s, hard=False):
    s = sub(s, r"^[–—\-•*]+\s*", "", "")
    s = sub(s, r"^\d{1,2}\s+", "", "")
    s = sub(s, rf"^{CODE}\s*", "", "")
    s = sub(s, r"\d{2}\.\d{2}\.\d{4}\s*[-–—]\s*\d{2}\.\d{2}\.\d{4}")
    s = sub(s, rf"\(?\s*первичн{W}*\s*\)?", "", "gi")
    s = sub(s, rf"(^|{NW})\d\s*(?:года|год|лет)($|{NW})", r"\1\2", "gi")
    s = sub(s, rf"(^|{NW})[ВB]\d{{2,3}}(?:\s*[-–—:]\s*|\s+|($|{NW}))", r"\1\2")
    if hard:
        s = sub(s, r"^[а-яё]{1,3}\s+([А-ЯЁ])", r"\1", "")
    return norm(s)


def fragment(s):
    return (f"((length({s}) < 8 AND NOT contains({s}, ' ')) OR ({hit(s, '^[а-яё]{1,3} ')} AND length({s}) < 25) "
            f"OR {hit(s, '[(«]$')} OR {count(s, chr(92) + 'p{L}')} < 8)")


LETTERS = "A-Za-zА-Яа-яЁёәғқңөұүһіӘҒҚҢӨҰҮҺІ"


def junk(s, hard=False):
    low = f"lower({s})"
    label = hit(low, rf"^в\d{{2,3}}($|{NW})")
    out = (f"length({s}) < 3 OR {hit(s, f'^{CODE}$')} OR {hit(low, f'^({HEADINGS})$')} "
           f"OR contains({low}, 'ағылшын тілі деңгейін')")
    if not hard:
        return f"({out} OR contains({low}, 'уровень английского') OR {label} OR {hit(low, '^– *(инженерия|көлік|транспорт)')})"
    return (f"({out} OR contains({low}, 'білім беру бағдарламасына түсушілерге') "
            f"OR ({label} AND {hit(low, 'транспорт|воздуш|air |әуе')}) OR {hit(low, '^– *(инженерия|көлік)')} OR {hit(s, '[(«]$')} "
            f"OR ({hit(s, '^[а-яё]{1,2} ')} AND length({s}) < 35 AND ({lang(s)}) <> 'ru') OR {count(s, LETTERS)} < 6)")


def russian(s, hard=False):
    """Longest acceptable Russian phrase, first on ties, as a NULL-able expression."""
    run = r"[А-Яа-яЁё]+(?:\s+[А-Яа-яЁё0-9\-\(\)«»\",\./]+)+"
    runs = f"regexp_extract_all({s}, '{run}')"
    if not hard:
        runs = f"(CASE WHEN len({runs}) > 0 THEN {runs} ELSE regexp_extract_all({s}, '[А-Яа-яЁё]{{6,}}') END)"
    ok = f"length(x) >= 10 AND ({lang('x')}) = 'ru' AND NOT {junk('x', hard)}" + ("" if hard else f" AND NOT {fragment('x')}")
    good = f"list_filter(list_transform({runs}, lambda y: {norm('y')}), lambda x: {ok})"
    return f"NULLIF(list_reduce(list_prepend('', {good}), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END), '')"


def years_hint(s, flags=None):
    opts = f", 1, '{flags}'" if flags else ", 1"
    got = f"TRY_CAST(regexp_extract({s}, '(\\d)\\s*(?:год|года|лет)'{opts}) AS INTEGER)"
    return f"CASE WHEN {got} BETWEEN 1 AND 8 THEN {got} END"


def analysis(source, name, qual, code_col=None, hard=False, keep=""):
    """CTE steps from ``source`` to ``analysed`` with raw, title_code, clean, lang, score, drop, hint."""
    limit = 48 if hard else 45
    bad = (lambda c: f"({c} = '' OR {junk(c, True)})") if hard else (lambda c: f"(length({c}) < 3 OR {junk(c)} OR {fragment(c)})")
    codes = ([code(code_col)] if code_col else []) + [code("raw"), code(qual)]
    n = "length(clean)"
    if hard:
        score = (f"CASE lang WHEN 'ru' THEN 100 WHEN 'kk' THEN 30 WHEN 'en' THEN 20 WHEN 'mix' THEN 8 ELSE 0 END"
                 f" + CASE WHEN title_code IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN NOT raw_mash THEN 15 ELSE 0 END"
                 f" + CASE WHEN {n} BETWEEN 8 AND 130 THEN 5 ELSE 0 END"
                 r" + CASE WHEN NOT regexp_matches(raw, '\d{2}\.\d{2}\.\d{4}') THEN 5 ELSE 0 END")
    else:
        score = (f"CASE lang WHEN 'ru' THEN 100 WHEN 'kk' THEN 20 WHEN 'en' THEN 10 WHEN 'mix' THEN 5 ELSE 0 END"
                 f" + CASE WHEN title_code IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN NOT regexp_matches(clean, '^6[BbВв]') THEN 5 ELSE 0 END"
                 r" + CASE WHEN NOT regexp_matches(raw, '\d{2}\.\d{2}\.\d{4}') THEN 5 ELSE 0 END"
                 f" + CASE WHEN {n} BETWEEN 12 AND 100 THEN 10 ELSE 0 END - CASE WHEN raw_mash THEN 20 ELSE 0 END"
                 f" - CASE WHEN {n} < 8 AND title_code IS NOT NULL THEN 5 ELSE 0 END")
    last = "c2"
    again = ""
    if hard:
        again = (f", c3 AS (SELECT * REPLACE (CASE WHEN {mash('clean', 48, False)} THEN COALESCE({russian('clean', True)}, clean) ELSE clean END AS clean) FROM c2)")
        last = "c3"
    return f"""
 a0 AS (SELECT *, {norm(name)} AS raw FROM {source}),
 a1 AS (SELECT *, COALESCE({', '.join(codes)}) AS title_code, {mash('raw', limit, not hard)} AS raw_mash FROM a0),
 b AS (SELECT *, CASE WHEN raw_mash THEN COALESCE({russian('raw', hard)}, raw) ELSE raw END AS working FROM a1),
 c AS (SELECT *, {strip_noise('working', hard)} AS first_try, {strip_noise('raw', hard)} AS second_try FROM b),
 c1 AS (SELECT *, CASE WHEN {bad('first_try')} THEN second_try ELSE first_try END AS clean FROM c),
 c2 AS (SELECT *, ({junk('raw', hard)} OR {bad('clean')}) AS "drop" FROM c1){again},
 d AS (SELECT *, {lang('clean')} AS lang, {years_hint('raw', 'i' if hard else None)} AS hint FROM {last}),
 analysed AS (SELECT *, CAST({score} AS INTEGER) AS score FROM d)"""


def host(s):
    h = f"lower(regexp_replace(NULLIF(regexp_extract({s}, '^[a-zA-Z]+://([^/?#]+)', 1), ''), '^www\\.', ''))"
    return f"CASE WHEN {h} NOT IN ('zero.kz', 'facebook.com', 'instagram.com') THEN {h} END"


def city(s, third=True, latin=False):
    low = f"lower(COALESCE({s}, ''))"
    astana = "астана|astana|нур-султан" + ("|nur-sultan" if latin else "")
    return (f"CASE WHEN {hit(low, 'алматы|almaty')} THEN 'almaty' WHEN {hit(low, astana)} THEN 'astana' "
            + (f"WHEN {hit(low, 'шымкент|shymkent')} THEN 'shymkent' " if third else "") + "ELSE '' END")


STRICT_STOP = ("'университет','university','институт','академия','имени','им','казахский','казахская','казахстанский',"
               "'национальный','международный','республики','казахстан'")
STOP = STRICT_STOP + ",'астана','алматы','колледж','college'"


def tokens5(s, stop=STOP):
    return (f"list_distinct(list_filter(string_split_regex(lower({s}), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda w: length(w) >= 5 AND w NOT IN ({stop})))")


def college(s):
    return f"({hit(f'lower({s})', 'колледж|college')})"


SCORE_STOP = ("'университет','university','институт','академия','имени','им','казахский','казахская','казахстанский',"
              "'национальный','республики','казахстан','г','в','и','of','the','at'")


def score_tokens(s):
    """Tokens of a score_name expression."""
    return (f"list_distinct(list_filter(string_split({s}, ' '), lambda w: w <> '' AND w NOT IN ({SCORE_STOP}) "
            f"AND (length(w) >= 3 OR regexp_full_match(w, '[ -~]+'))))")


def money(s):
    kw = rf"regexp_extract({s}, '(?:стоимость|цена|оплата|tuition|fee|платн{W}*)[^\d]{{0,40}}([\d\s{NB}]{{3,9}})', 1, 'i')"
    any_ = rf"regexp_extract({s}, '([\d\s{NB}]{{4,9}}){SP}*(?:(?:тг|тенге)(?:$|{NW})|₸{W})', 1, 'i')"
    v = f"TRY_CAST(regexp_replace(COALESCE(NULLIF({kw}, ''), NULLIF({any_}, '')), '{SP}', '', 'g') AS BIGINT)"
    return f"CASE WHEN {v} BETWEEN 50000 AND 50000000 THEN CAST({v} AS DOUBLE) END"


def years(s):
    v = f"TRY_CAST(regexp_extract({s}, '(\\d){SP}*(?:год|года|лет|years?|г\\.)', 1, 'i') AS INTEGER)"
    return f"CASE WHEN {v} BETWEEN 1 AND 8 THEN {v} END"
