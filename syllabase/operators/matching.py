"""Entity matching by equi-joins on keys; no pair is built that shares no key.

Groups that share a hot key are summarised (lowest id per key) before they meet
the other side, so the work grows with the rows and not with pairs of rows.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# A hint in a name and the words that mark the same institution.
ALIASES = (
    ("гумил", ("гумил",)), ("назарбаев университет", ("назарбаев",)), ("сейфулл", ("сейфулл",)),
    ("narikbayev", ("narikbayev", "казгюу")), ("казгюу", ("казгюу", "narikbayev")),
    ("astana it university", ("astana it университет", "астана it университет", "astana it university")),
    ("астана it университет", ("astana it", "астана it")), ("esil university", ("esil",)),
    ("ломоносов", ("ломоносов",)), ("аль-фараби", ("аль-фараби", "ал-фараби")), ("асфендияров", ("асфендияров",)),
    ("satbayev", ("сатпаев", "satbayev", "сатбаев")), ("сатбаев", ("сатпаев", "satbayev")), ("нархоз", ("нархоз",)),
    ("кимеп", ("кимеп", "kimep")), ("кбту", ("кбту", "british")), ("абая", ("абая",)), ("жургенов", ("жургенов",)),
    ("курмангазы", ("курмангазы",)), ("кулажан", ("кулажан",)),
    ("технологии и бизнеса", ("технологии и бизнеса", "technology and business")),
    ("международный университет астан", ("международный университет астан",)),
    ("национальный университет искусств", ("национальный университет искусств",)),
)
ALIASES_STRICT = (
    ("гумил", ("гумил",)), ("назарбаев университет", ("назарбаев",)), ("сейфулл", ("сейфулл",)),
    ("narikbayev", ("narikbayev", "казгюу")), ("казгюу", ("казгюу", "narikbayev")),
    ("astana it", ("астана it", "astana it")), ("esil university", ("esil",)), ("ломоносов", ("ломоносов",)),
    ("медицинский университет астана", ("медицинский университет астана",)),
    ("международный университет астана", ("международный университет астан",)), ("хореограф", ("хореограф",)),
    ("кулажан", ("кулажан",)), ("государственного управления при президенте", ("государственного управления",)),
    ("аль-фараби", ("аль-фараби", "ал-фараби")), ("асфендияров", ("асфендияров",)),
    ("сатбаев", ("сатпаев", "satbayev")), ("нархоз", ("нархоз",)), ("кимеп", ("кимеп", "kimep")),
    ("кбту", ("кбту", "british")),
)
SCORE_CITIES = ("алматы", "астана")
ANCHOR = 4


def contains_pairs(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """All (needle, hay) with the needle inside the hay text, without a cross join.

    ``needles`` has a column ``needle``, ``hay`` a column ``hay``; both distinct
    and not empty. A needle is anchored by its first four characters; only
    positions that start with an anchor are cut to the needle lengths known for
    it, and the cut text meets its needle by equality. A common anchor costs one
    row per position and length, never a pair per needle.
    """
    anchors = needles.groupBy(F.substring("needle", 1, ANCHOR).alias("gram")).agg(
        F.collect_set(F.length("needle")).alias("lengths")
    )
    spots = hay.select("hay", F.explode(F.sequence(F.lit(1), F.length("hay"))).alias("i"))
    grams = F.array_distinct(F.array(*[F.substring("hay", F.col("i"), F.lit(k)) for k in range(1, ANCHOR + 1)]))
    cuts = (
        spots.select("hay", "i", F.explode(grams).alias("gram")).join(anchors, "gram")
        .select("hay", "i", F.explode("lengths").alias("n"))
        .filter(F.col("i") + F.col("n") - 1 <= F.length("hay"))
        .select("hay", F.substring("hay", F.col("i"), F.col("n")).alias("needle"))
        .distinct()
    )
    return cuts.join(needles.select("needle"), "needle")


# ---- cascade ---------------------------------------------------------------

def _keys(df: DataFrame, key: str, strict: bool) -> DataFrame:
    place = F.coalesce("location", "address") if "address" in df.columns else F.col("location")
    return df.select(
        F.col(key).alias("id"), F.trim("name").alias("name"),
        F.when(F.col("type") == "college", "college").otherwise("university").alias("type"),
        X.city_key(place, cities=3 if strict else 2, latin=False).alias("city"), X.plain_host(F.col("website")).alias("host"),
        X.norm_name(F.col("name")).alias("norm"), X.soft_name(F.col("name")).alias("soft"),
        F.lower(F.trim("name")).alias("low"),
    )


def _related_keys(strict: bool) -> Column:
    college = X.is_college(F.col("low")).cast("string")
    stop = X.RELATED_STOP_STRICT if strict else X.RELATED_STOP
    tokens = F.transform(X.related_tokens(F.col("low"), stop), lambda t: F.concat(F.lit("t:"), college, F.lit(":"), t))
    if strict:
        return F.array_append(tokens, F.concat(F.lit("l:"), college, F.lit(":"), F.col("low")))
    soft = F.when(F.col("soft") != "", F.concat(F.lit("s:"), F.col("soft")))
    return F.array_compact(F.concat(tokens, F.array(soft, F.concat(F.lit("l:"), F.col("low")))))


def _same_city() -> Column:
    return (F.col("city") == "") | (F.col("_city") == "") | (F.col("city") == F.col("_city"))


def _needles_of(low: Column, strict: bool) -> Column:
    parts = []
    for hint, needles in ALIASES_STRICT if strict else ALIASES:
        words = [n for n in needles + (() if strict else (hint,)) if strict or len(n) >= 5]
        if words:
            parts.append(F.when(X.has(low, hint, *needles), F.array(*[F.lit(w) for w in words])))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*parts))))


def _needle_hits(low: Column, strict: bool) -> Column:
    aliases = ALIASES_STRICT if strict else ALIASES
    words = dict.fromkeys(w for h, ns in aliases for w in ns + (() if strict else (h,)) if strict or len(w) >= 5)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words]))


def match_cascade(incoming: DataFrame, existing: DataFrame, strict: bool = False) -> DataFrame:
    """(incoming_id, institution_id, tier, new_key) for every incoming row.

    Tiers: 1 same name, 2 same normalised or soft name, 3 same website host in
    the same city (an unknown city fits any), 4 alias word in the same city. The
    lowest id wins inside a tier. ``strict`` has no tier 2 and asks for related
    names in tier 3. Rows without a match get ``new_key``, the first incoming row
    of the same type and normalised name, so one new institution serves them all.
    """
    a, b = _keys(incoming, "incoming_id", strict), _keys(existing, "institution_id", strict)

    def lowest(df, *keys):
        return df.groupBy(*keys).agg(F.min("id").alias("hit"))

    def found(df, tier):
        return df.select("id", F.lit(tier).alias("tier"), "hit")

    tiers = [found(a.join(lowest(b, "name", "type"), ["name", "type"]), 1)]
    if not strict:
        tiers.append(found(a.join(lowest(b, "norm", "type"), ["norm", "type"]), 2))
        softs = lowest(b.filter("soft <> ''"), "soft", "type")
        tiers.append(found(a.join(softs, ["soft", "type"]), 2))

    with_host = a.filter(F.coalesce("host", F.lit("")) != "")
    hosted = b.filter(F.coalesce("host", F.lit("")) != "").withColumnRenamed("city", "_city")
    if not strict:
        per_city = hosted.groupBy("type", "host", "_city").agg(F.count("*").alias("n"), F.min("id").alias("hit"))
        alone = (
            with_host.join(per_city, ["type", "host"]).filter(_same_city())
            .groupBy("id").agg(F.sum("n").alias("n"), F.min("hit").alias("hit")).filter("n = 1")
        )
        tiers.append(found(alone, 3))
    keyed = hosted.select("type", "host", "_city", "id", F.explode(_related_keys(strict)).alias("key"))
    related = with_host.select("id", "type", "host", "city", F.explode(_related_keys(strict)).alias("key")).join(
        lowest(keyed, "type", "host", "_city", "key"), ["type", "host", "key"]
    )
    tiers.append(found(related.filter(_same_city()), 3))

    marked = b.withColumnRenamed("city", "_city")
    if strict:
        marked = marked.filter("type = 'university'")
    else:
        marked = marked.filter(~((F.col("type") == "university") & F.contains("low", F.lit("колледж"))))
    marked = marked.select("type", "_city", "id", F.explode(_needle_hits(F.col("low"), strict)).alias("needle"))
    on = ["needle"] if strict else ["needle", "type"]
    asked = a.select("id", "type", "city", F.explode(_needles_of(F.col("low"), strict)).alias("needle"))
    aliased = asked.join(lowest(marked, "_city", *on), on)
    tiers.append(found(aliased.filter(_same_city()), 4))

    best = reduce(DataFrame.unionByName, tiers).groupBy("id").agg(F.min(F.struct("tier", "hit")).alias("m"))
    out = a.select("id", "type", "norm").join(best, "id", "left")
    fresh = out.filter("m IS NULL").groupBy("type", "norm").agg(F.min("id").alias("new_key"))
    return out.join(fresh, ["type", "norm"], "left").select(
        F.col("id").alias("incoming_id"), F.col("m.hit").alias("institution_id"), F.col("m.tier").alias("tier"),
        F.when(F.col("m").isNull(), F.col("new_key")).alias("new_key"),
    )


# ---- fuzzy best match ------------------------------------------------------

def city_flags(col: Column) -> Column:
    loc = X.score_name(col)
    return sum((F.contains(loc, F.lit(c)).cast("int") * (1 << i) for i, c in enumerate(SCORE_CITIES)), F.lit(0))


def city_bonus(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseAND(b))


def name_score(na: Column, ta: Column, nb: Column, tb: Column) -> Column:
    """Similarity of two score names with their token sets."""
    shared = F.size(F.array_intersect(ta, tb))
    near = F.when(F.abs(F.size(ta) - F.size(tb)) <= 1, 3).otherwise(0)
    inside = (F.length(na) >= 5) & (F.contains(nb, na) | F.contains(na, nb))
    word = F.exists(ta, lambda t: (F.length(t) >= 4) & F.contains(nb, t)) | F.exists(
        tb, lambda t: (F.length(t) >= 4) & F.contains(na, t)
    )
    return (
        F.when((na == "") | (nb == ""), 0).when(na == nb, 20).when(shared > 0, shared * 4 + near)
        .when(inside, 6).when(word, 4).otherwise(0)
    )


def _names(df: DataFrame, key: str, side: str) -> DataFrame:
    """Distinct (name, city flags) of one side with the lowest id and the tokens."""
    base = df.select(
        F.col(key).alias("id"), X.score_name(F.col("name")).alias("n"), city_flags(F.col("location")).alias("f")
    ).filter("n <> ''")
    rows = base.groupBy("n", "f").agg(F.min("id").alias("id")).withColumn("t", X.score_tokens(F.col("n")))
    return rows.select(*[F.col(c).alias(side + c) for c in ("n", "f", "id", "t")])


#: Hot tokens of a name up to which its subsets are listed.
SUBSETS_OF = 10


def _subsets(df: DataFrame, sig: str) -> DataFrame:
    """``df`` once per non-empty subset of its tokens: ``part`` and its size ``k``."""
    masks = f"sequence(1, shiftleft(1, size({sig})) - 1)"
    parts = f"transform({masks}, m -> filter({sig}, (x, i) -> (shiftright(m, i) & 1) = 1))"
    rows = df.withColumn("_part", F.explode(F.expr(parts)))
    return rows.select(*df.columns, F.array_join("_part", " ").alias("part"), F.size("_part").alias("k"))


def hot_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(sig, ls, lf, rf, row, s): for each left set of hot tokens, right rows among which its best one is; ``s`` is their score.

    left: sig, ls (all tokens of the name), lf (cities). right: rsig, rs, rf, row (lowest id). Right rows are reduced to one per subset
    of their tokens and cities, and one for each size that counts as like theirs. A left set meets the subsets it shares by equality: at first only to learn how large the largest
    one is, then those of that size and one less, as one shared token outweighs size and cities but for a tie. So a set meets a
    bounded number of rows, however many names hold its tokens. Sets of more than SUBSETS_OF tokens meet token by token.
    """
    near = F.when(F.abs(F.col("ls") - F.col("rs")) <= 1, 3).otherwise(0) + city_bonus(F.col("lf"), F.col("rf"))
    few = lambda c: F.size(c) <= SUBSETS_OF
    l_parts = _subsets(left.filter(few("sig")).select("sig").distinct(), "sig")
    r_parts = _subsets(right.filter(few("rsig")), "rsig").groupBy("part", "rs", "rf").agg(F.min("row").alias("row"))
    any_size = r_parts.groupBy("part", "rf").agg(F.min("row").alias("row"))
    like_size = r_parts.withColumn("ls", F.explode(F.array(F.col("rs") - 1, F.col("rs"), F.col("rs") + 1)))
    like_size = like_size.groupBy("part", "ls", "rf").agg(F.min("row").alias("row"))
    shared = l_parts.join(any_size.select("part").distinct(), "part")
    most = shared.groupBy("sig").agg(F.max("k").alias("most"))
    asked = shared.join(most, "sig").filter("k >= most - 1").drop("most").join(left, "sig")
    found = asked.join(any_size, "part").withColumn("size", F.lit(0))
    found = found.unionByName(asked.join(like_size, ["part", "ls"]).withColumn("size", F.lit(3)))
    by_part = found.select("sig", "ls", "lf", "rf", "row", (F.col("k") * 4 + F.col("size") + city_bonus(F.col("lf"), F.col("rf"))).alias("s"))

    def by_token(a, b):
        pairs = a.withColumn("tok", F.explode("sig")).join(b.withColumn("tok", F.explode("rsig")), "tok")
        return pairs.select("sig", "ls", "lf", "rf", "row", (F.size(F.array_intersect("sig", "rsig")) * 4 + near).alias("s"))

    long = by_token(left.filter(~few("sig")), right).unionByName(by_token(left.filter(few("sig")), right.filter(~few("rsig"))))
    return by_part.unionByName(long)


def best_match(left: DataFrame, right: DataFrame, least: int = 4, hot: int = 1000) -> DataFrame:
    """(left_id, right_id, score) of the best right name; the first row wins ties.

    Exact, and no all-pairs step. Rows without a partner of at least ``least``
    are left out. The true best pair is always among the candidates:

    * equal names;
    * pairs that share a token found in at most ``hot`` right names;
    * for the other tokens, names with the same set of hot tokens, size and
      cities are alike for the score, so one row stands for each set; sets meet by
      the subsets they share (``hot_candidates``);
    * a token inside a word of the other name scores 4 whatever the rest of the
      name, so the lowest id per word is enough; words are matched as vocabulary;
    * a whole name inside the other without a shared token, found by substring.

    Every candidate is scored exactly, then the best is kept per left name.
    """
    a, b = _names(left, "left_id", "l"), _names(right, "right_id", "r")
    pair = ["ln", "lf", "lt", "rn", "rf", "rt", "rid"]
    right_row = F.struct("rid", "rn", "rt")

    def unpack(df, keys):
        return df.select(*keys, "rf", "row.rn", "row.rt", "row.rid")

    equal = a.join(b, F.col("ln") == F.col("rn")).select(*pair)

    # Shared tokens.
    lt = a.select("ln", "lf", "lt", F.explode("lt").alias("tok"))
    rt = b.select("rn", "rf", "rt", "rid", F.explode("rt").alias("tok"))
    often = rt.groupBy("tok").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("tok")
    rare = lt.join(rt.join(often, "tok", "left_anti"), "tok").select(*pair)

    def signed(df, cols):
        return df.join(often, "tok", "left_semi").groupBy(*cols).agg(F.array_sort(F.collect_list("tok")).alias("sig"))

    ls = signed(lt, ["ln", "lf", "lt"]).withColumn("ls", F.size("lt"))
    rs = signed(rt, ["rn", "rf", "rt", "rid"]).groupBy(F.col("sig").alias("rsig"), F.size("rt").alias("rs"), "rf").agg(
        F.min(right_row).alias("row")
    )
    met = hot_candidates(ls.select("sig", "ls", "lf").distinct(), rs)
    top = met.groupBy("sig", "ls", "lf").agg(
        F.max_by(F.struct("rf", "row"), F.struct("s", -F.col("row.rid"))).alias("g")
    ).select("sig", "ls", "lf", "g.rf", "g.row")
    alike = unpack(ls.join(top, ["sig", "ls", "lf"]), ["ln", "lf", "lt"])

    # A token of one name inside a word of the other.
    lword = a.select("ln", "lf", "lt", F.explode(F.array_distinct(F.split("ln", " "))).alias("w"))
    rword = b.select("rf", "rid", "rn", "rt", F.explode(F.array_distinct(F.split("rn", " "))).alias("w"))
    lvoc = lt.filter(F.length("tok") >= 4).select(F.col("tok").alias("needle")).distinct()
    rvoc = rt.filter(F.length("tok") >= 4).select(F.col("tok").alias("needle")).distinct()
    by_word = rword.groupBy("w", "rf").agg(F.min(right_row).alias("row"))
    left_in_right = (
        contains_pairs(lvoc, rword.select(F.col("w").alias("hay")).distinct()).withColumnRenamed("hay", "w")
        .join(by_word, "w").groupBy("needle", "rf").agg(F.min("row").alias("row"))
    )
    inner = unpack(lt.join(left_in_right.withColumnRenamed("needle", "tok"), "tok"), ["ln", "lf", "lt"])
    by_token = rt.groupBy(F.col("tok").alias("needle"), "rf").agg(F.min(right_row).alias("row"))
    right_in_left = (
        contains_pairs(rvoc, lword.select(F.col("w").alias("hay")).distinct()).withColumnRenamed("hay", "w")
        .join(by_token, "needle").groupBy("w", "rf").agg(F.min("row").alias("row"))
    )
    outer = unpack(lword.join(right_in_left, "w"), ["ln", "lf", "lt"])

    # A whole name inside the other.
    llong = a.filter(F.length("ln") >= 5)
    names = llong.select(F.col("ln").alias("v")).distinct(), b.select(F.col("rn").alias("v")).distinct()
    as_needle, as_hay = (lambda d: d.withColumnRenamed("v", "needle")), (lambda d: d.withColumnRenamed("v", "hay"))
    whole = (
        contains_pairs(as_needle(names[0]), as_hay(names[1])).select(F.col("needle").alias("ln"), F.col("hay").alias("rn"))
        .union(contains_pairs(as_needle(names[1]), as_hay(names[0])).select(F.col("hay").alias("ln"), F.col("needle").alias("rn")))
        .distinct()
    )
    apart = (
        whole.join(llong, "ln").join(b, "rn").filter(~F.arrays_overlap("lt", "rt"))
        .groupBy("ln", "lf", "lt", "rf").agg(F.min(right_row).alias("row"))
    )
    apart = unpack(apart, ["ln", "lf", "lt"])

    every = reduce(lambda x, y: x.unionByName(y.select(*pair)), [rare, alike, inner, outer, apart], equal)
    score = name_score(F.col("ln"), F.col("lt"), F.col("rn"), F.col("rt")) + city_bonus(F.col("lf"), F.col("rf"))
    best = (
        every.withColumn("score", score).groupBy("ln", "lf")
        .agg(F.max(F.struct("score", -F.col("rid"))).alias("m")).filter(F.col("m.score") >= least)
    )
    rows = left.select("left_id", X.score_name(F.col("name")).alias("ln"), city_flags(F.col("location")).alias("lf"))
    return rows.join(best, ["ln", "lf"]).select("left_id", (-F.col("m.col2")).alias("right_id"), F.col("m.score").alias("score"))


# ---- names to ids ------------------------------------------------------------

def names_to_ids(suggested: DataFrame, spec: DataFrame) -> DataFrame:
    """(result_id, specialization_id, pos): suggested names as programme ids, first mention kept.

    Tiers: same name in any case; a programme name that holds the whole
    suggestion; one that holds its longest, then second longest word (five
    letters at least). The lowest id wins.
    """
    asked = suggested.withColumn("ask", F.lower(F.trim("name"))).filter("ask <> ''")
    asks = asked.select("ask").distinct()
    known = spec.groupBy(F.lower("name").alias("hay")).agg(F.min("specialization_id").alias("hit")).filter("hay <> ''")

    def inside(needles):
        pairs = contains_pairs(needles, known.select("hay"))
        return pairs.join(known, "hay").groupBy("needle").agg(F.min("hit").alias("hit"))

    same = asks.join(known.withColumnRenamed("hay", "ask"), "ask").select("ask", F.lit(1).alias("tier"), "hit")
    part = inside(asks.withColumnRenamed("ask", "needle")).select(F.col("needle").alias("ask"), F.lit(2).alias("tier"), "hit")
    words = F.transform(F.split("ask", r"(?U)[\s,\-/]+"), lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    long = asks.select("ask", F.posexplode(F.slice(F.array_sort(words), 1, 2)).alias("rank", "x")).filter(F.length("x.w") >= 5)
    hits = inside(long.select(F.col("x.w").alias("needle")).distinct())
    word = long.join(hits, F.col("x.w") == F.col("needle")).select("ask", (F.col("rank") + 3).alias("tier"), "hit")
    best = same.unionByName(part).unionByName(word).groupBy("ask").agg(F.min(F.struct("tier", "hit")).alias("m"))
    return (
        asked.join(best, "ask").groupBy("result_id", F.col("m.hit").alias("specialization_id"))
        .agg(F.min("pos").alias("pos"))
    )
