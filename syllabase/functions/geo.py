"""Coordinates: boxes, coordinates in text, geocoder candidates and queries."""
from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Fixed values: (lat_min, lat_max, lng_min, lng_max).
COUNTRY_BOX = (40.5, 55.5, 46.5, 87.5)
CITY_BOXES = {
    "Astana": (50.9, 51.35, 71.2, 71.7),
    "Almaty": (43.05, 43.45, 76.55, 77.15),
    "Shymkent": (42.2, 42.5, 69.4, 69.8),
}
# Words that mark a geocoder hit as a place of education.
PLACE_WORDS = ("university", "college", "campus", "school", "университет", "институт", "академия")
# Points that were filled in by mistake, and the one rightful owner.
BAD_POINTS = ((51.09813, 71.42552), (51.09067, 71.39816))
BAD_POINT_OWNER = "назарбаев"
# A word in the name and the query that finds the place.
QUERY_ALIASES = (
    ("назарбаев", "Nazarbayev University Astana"),
    ("гумил", "L.N. Gumilyov Eurasian National University Astana"),
    ("сейфулл", "Saken Seifullin Kazakh Agrotechnical University Astana"),
    ("astana it", "Astana IT University"),
    ("aitu", "Astana IT University"),
    ("narikbayev", "Maqsut Narikbayev University Astana"),
    ("казгюу", "Maqsut Narikbayev University Astana"),
    ("аль-фараби", "Al-Farabi Kazakh National University Almaty"),
    ("сатпаев", "Satbayev University Almaty"),
    ("satbayev", "Satbayev University Almaty"),
    ("кимеп", "KIMEP University Almaty"),
    ("kimep", "KIMEP University Almaty"),
    ("нархоз", "Narxoz University Almaty"),
    ("абай", "Abai Kazakh National Pedagogical University Almaty"),
    ("асфендияров", "Asfendiyarov Kazakh National Medical University Almaty"),
    ("iitu", "International Information Technology University Almaty"),
    ("информационных технологий", "International Information Technology University Almaty"),
    ("sdu", "SDU University Kaskelen"),
    ("turan", "Turan University Almaty"),
    ("туран-астана", "Turan-Astana University"),
    ("туран астана", "Turan-Astana University"),
)
TURAN_IN_ASTANA = "Turan-Astana University"
# Hand-checked points by a word in the name, first fit wins.
KNOWN_PINS = (
    ("назарбаев", 51.09067, 71.39816), ("гумил", 51.15831, 71.46734), ("сейфулл", 51.18732, 71.40906),
    ("медицинский университет астана", 51.18177, 71.41642), ("astana it", 51.09090, 71.41817),
    ("narikbayev", 51.14839, 71.37944), ("казгюу", 51.14839, 71.37944), ("туран-астана", 51.18188, 71.43151),
    ("esil", 51.1695, 71.4168), ("евразийский гуманитарный", 51.1750, 71.4300), ("кусаинов", 51.1750, 71.4300),
    ("alem", 51.1350, 71.4100), ("kuef", 51.14384, 71.42743), ("экономики, финансов", 51.14384, 71.42743),
    ("государственного управления", 51.16833, 71.42026), ("международный университет астан", 51.14484, 71.42293),
    ("технологии и бизнеса", 51.14483, 71.36904), ("хореограф", 51.09907, 71.42030), ("казнуи", 51.12293, 71.47330),
    ("национальный университет искусств", 51.12293, 71.47330), ("ломоносов", 51.15581, 71.46937),
    ("казпотребсоюз", 51.16679, 71.44971), ("обороны", 51.1450, 71.4700), ("cardiff", 51.13126, 71.37186),
    ("coventry", 51.1280, 71.4150), ("университет спорта", 51.05957, 71.38821), ("mgimo", 51.1200, 71.4300),
    ("мгимо", 51.1200, 71.4300), ("аль-фараби", 43.2245, 76.9235), ("satbayev", 43.2365, 76.9307),
    ("сатпаев", 43.2365, 76.9307), ("кимеп", 43.2416, 76.9553), ("kimep", 43.2416, 76.9553),
    ("нархоз", 43.2149, 76.8706), ("информационных технологий", 43.2300, 76.9099), ("абай", 43.2563, 76.9534),
    ("асфендияров", 43.2530, 76.9312), ("sdu", 43.2070, 76.6690), ("metu", 43.2380, 76.9050),
    ("инженерно-технологический", 43.2380, 76.9050), ("de montfort", 43.2385, 76.9450), ("dmuk", 43.2385, 76.9450),
    ("нур-мубарак", 43.2250, 76.9100), ("нур мубарак", 43.2250, 76.9100), ("гончаров", 43.2600, 76.9300),
    ("автомобильно-дорожный", 43.2600, 76.9300), ("кунаев", 43.2500, 76.9400), ("uib", 43.2380, 76.9450),
    ("международного бизнеса", 43.2380, 76.9450), ("сагадиев", 43.2380, 76.9450),
    ("транспортно-гуманитарный", 43.2500, 76.9200), ("мифи", 43.2400, 76.9100),
    ("пограничной службы", 43.2500, 76.9000), ("q» university", 43.2400, 76.9200), ("q university", 43.2400, 76.9200),
    ("синергия", 43.2500, 76.9400),
)
# A point that holds for one city only and goes before the list.
CITY_PINS = (
    ("Astana", "синергия", 51.1280, 71.4300),
    ("Astana", "esil", 51.1695, 71.4168),
    ("Almaty", "синергия", 43.2500, 76.9400),
)


def in_box(lat: Column, lng: Column, box) -> Column:
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])


def in_country(lat: Column, lng: Column) -> Column:
    return in_box(lat, lng, COUNTRY_BOX)


def in_city(lat: Column, lng: Column, city: Column, boxes=None) -> Column:
    """Inside the loose box of the city; a city without a box lets everything pass."""
    out = F.lit(True)
    for name, box in (boxes or CITY_BOXES).items():
        out = F.when(city == name, in_box(lat, lng, box)).otherwise(out)
    return out


def missing_any(*cols: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c.try_cast("double"), F.lit(0.0)) == 0 for c in cols])


def known_pin(name: Column, city: Column) -> Column:
    """Struct with lat, lng, query of the first pin whose word is in the name."""
    low = F.lower(F.translate(X.norm(name), "«»\"", ""))
    pins = F.from_json(F.lit(_pin_rules()), "array<struct<only:string,never:string,query:string,lat:double,lng:double>>")

    def first_fit(row):
        fits = F.filter(
            pins,
            lambda p: F.contains(row["low"], p["query"])
            & F.coalesce(p["only"] == row["city"], F.lit(True))
            & F.coalesce(p["never"] != row["city"], F.lit(True)),
        )
        return F.get(fits, 0)

    return X.bind(F.struct(low.alias("low"), city.alias("city")), first_fit)


def _pin_rules() -> str:
    """The pins in the order they apply; a pin far from a city never serves that city."""
    rules = [{"only": only, "query": word, "lat": lat, "lng": lng} for only, word, lat, lng in CITY_PINS]
    for word, lat, lng in KNOWN_PINS:
        never = "Astana" if lat < 45 else "Almaty" if lat > 50 else None
        rules.append({"never": never, "query": word, "lat": lat, "lng": lng})
    return json.dumps(rules, ensure_ascii=False)


def coords_from_text(col: Column) -> Column:
    """Struct (lat, lng) from a map link or page, most reliable form first."""
    n = r"(-?\d+\.\d+)"
    forms = (f"!3d{n}!4d{n}", f"@{n},{n}", f"center={n}%2C{n}", f"/maps/place/[^\"']*@{n},{n}")

    def first_valid(pattern, every):
        lats = F.regexp_extract_all(X.text(col), F.lit(pattern), F.lit(1))
        lngs = F.regexp_extract_all(X.text(col), F.lit(pattern), F.lit(2))
        pairs = F.zip_with(
            lats, lngs, lambda a, b: F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lng"))
        )
        pairs = pairs if every else F.slice(pairs, 1, 1)
        return F.get(F.filter(pairs, lambda p: in_country(p["lat"], p["lng"])), 0)

    return F.coalesce(*[first_valid(p, i == 1) for i, p in enumerate(forms)])


def pick_candidate(candidates: Column, city: Column) -> Column:
    """Best geocoder hit of an array of (lat, lng, class, type, display), first on ties."""

    def points(c):
        blob = F.lower(F.concat_ws(" ", c["type"], c["class"], c["display"]))
        return (
            F.lit(10)
            + F.when(X.has(blob, *PLACE_WORDS), 5).otherwise(0)
            + F.when((c["class"] == "amenity") & (c["type"] == "university"), 8).otherwise(0)
            + F.when((c["class"] == "building") & F.contains(c["type"], F.lit("university")), 4).otherwise(0)
        )

    usable = F.filter(candidates, lambda c: in_country(c["lat"], c["lng"]) & in_city(c["lat"], c["lng"], city))
    scored = F.transform(
        usable,
        lambda c, i: F.struct(
            points(c).alias("score"), (-i).alias("place"), c["lat"].alias("lat"), c["lng"].alias("lng"),
            c["display"].alias("display"),
        ),
    )
    return F.array_max(scored)


# The wider box (lat_min, lat_max, lng_min, lng_max), and the words that mark a hit by its type.
WIDE_BOX = (40.0, 56.0, 46.0, 88.0)
HIT_TYPES = "(?i)university|college|school|campus"


def pick_first_typed(candidates: Column) -> Column:
    """First geocoder hit of (lat, lng, class, type, display) whose type or class is one of education, else the first hit.

    The choice is made before its point is checked: one without coordinates or outside the wide box gives null.
    """
    typed = F.filter(candidates, lambda c: F.concat_ws(" ", F.coalesce(c["type"], F.lit("")), F.coalesce(c["class"], F.lit(""))).rlike(HIT_TYPES))
    best = F.coalesce(F.get(typed, 0), F.get(candidates, 0))
    south, north, west, east = WIDE_BOX
    inside = best["lat"].between(south, north) & best["lng"].between(west, east)
    return F.when(inside, F.struct(best["lat"].alias("lat"), best["lng"].alias("lng"), best["display"].alias("display")))


def _city_name(location: Column, address: Column, names: dict[str, str], default: str, part: Column) -> Column:
    key = X.city_key(location, address, latin=False)
    out = F.when(X.text(location) != "", part).otherwise(F.lit(default))
    for k, v in names.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def geocode_queries_ru(name: Column, location: Column, address: Column) -> Column:
    """Ordered distinct query strings in Russian: name and city, name and address, address and city."""
    head = F.trim(F.split_part(X.text(location), F.lit(","), F.lit(1)))
    city = _city_name(location, address, {"almaty": "Алматы", "astana": "Астана", "shymkent": "Шымкент"}, "Казахстан", head)
    named, addr = F.trim(X.text(name)), F.trim(X.text(address))
    has_name, has_addr = named != "", addr != ""
    end, comma = F.lit(", Казахстан"), F.lit(", ")
    return F.array_distinct(F.array_compact(F.array(
        F.when(has_name, F.concat(named, comma, city, end)),
        F.when(has_name, F.concat(named, F.lit(" "), city)),
        F.when(has_addr & has_name & (F.length(addr) < 120), F.concat(named, comma, addr, end)),
        F.when(has_addr & (F.length(addr) < 80), F.concat(addr, comma, city, end)),
    )))


def geocode_query(name: Column, location: Column, address: Column) -> Column:
    """One query string: name, address, city and country; a long address is left out."""
    head = F.split_part(X.text(location), F.lit(","), F.lit(1))
    city = _city_name(location, address, {"almaty": "Almaty", "astana": "Astana", "shymkent": "Shymkent"}, "Kazakhstan", head)
    country = F.lit("Kazakhstan")
    told = lambda c: F.when(F.length(F.trim(c)) > 1, c)
    given = lambda c: F.when(~c.isin("", "0"), c)
    return F.when(F.length(address) > 120, F.concat_ws(", ", given(name), given(city), country)).otherwise(
        F.concat_ws(", ", told(name), told(address), told(city), country))


def geocode_queries(name: Column, location: Column, address: Column) -> Column:
    """Ordered distinct query strings; of several aliases the last one goes first."""
    clean = F.translate(X.norm(name), "«»\"", "")
    low = F.lower(clean)
    addr = F.trim(X.text(address))
    key = X.city_key(location, address)
    first_part = F.nullif(F.trim(F.split_part(X.text(location), F.lit(","), F.lit(1))), F.lit(""))
    ru = (
        F.when(key == "almaty", "Алматы").when(key == "astana", "Астана").when(key == "shymkent", "Шымкент")
        .otherwise(F.coalesce(first_part, F.lit("Казахстан")))
    )
    en = F.when(key != "", F.initcap(key)).otherwise(F.coalesce(first_part, F.lit("Kazakhstan")))
    aliases = []
    for word, query in QUERY_ALIASES:
        value = F.lit(query)
        if word == "turan":
            value = F.when(F.contains(low, F.lit("астана")), TURAN_IN_ASTANA).otherwise(value)
        aliases.insert(0, F.when(F.contains(low, F.lit(word)), value))
    named = clean != ""
    short = F.length(addr).between(9, 89) & ~F.startswith(F.lower(addr), F.substring(low, 1, 20))
    return F.array_distinct(F.array_compact(F.array(
        *aliases,
        F.when(named, F.concat(clean, F.lit(", "), ru, F.lit(", Казахстан"))),
        F.when(named, F.concat(clean, F.lit(", "), en, F.lit(", Kazakhstan"))),
        F.when(named, F.concat(clean, F.lit(" "), en)),
        F.when(short, F.concat(addr, F.lit(", "), ru, F.lit(", Казахстан"))),
    )))


def is_bad_point(lat: Column, lng: Column, name: Column) -> Column:
    """A point copied by mistake onto an institution that does not own it."""
    own = F.contains(F.lower(X.text(name)), F.lit(BAD_POINT_OWNER))
    same = reduce(
        lambda a, b: a | b,
        [(F.round(lat, 5) == F.lit(a)) & (F.round(lng, 5) == F.lit(b)) for a, b in BAD_POINTS],
    )
    lat0, lng0 = BAD_POINTS[1]
    near = (F.abs(lat - lat0) < 0.0002) & (F.abs(lng - lng0) < 0.0002)
    return ~own & (same | near)
