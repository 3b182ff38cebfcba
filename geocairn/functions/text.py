"""Distances, dates, names, race types, countries, ids and URLs out of free text, as Column expressions. Null in gives null out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MILE_KM = 1.60934
#: Fixed value: two distances are about the same when they differ by less than this share of the longer.
ROUGH = 0.09
#: Fixed value: what stands between the distances of a list.
LIST_MARK = r"(?<!\d),(?!\d)|(?<=\.\d),(?=\s*\d)|;"
#: Words for a half marathon.
HALF = ("halvmarathon", "half marathon", "half-marathon", "semi-marathon", "demi-marathon", "halbmarathon", "halve marathon", "halvmaraton")


def _try_double(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text).try_cast("double")


def distance_km(token: Column) -> Column:
    """Kilometres of one distance: marathon words, a number with km, k, mi, mile(s), meter(s), metre(s), m (metres) or M (miles), a bare
    number as km, with point or comma; null for anything else."""
    t = F.trim(token)
    low = F.lower(t)
    body = lambda unit: _try_double(F.replace(F.trim(F.regexp_replace(t, f"(?i){unit}\\s*$", "")), F.lit(","), F.lit(".")))
    plain = lambda unit: _try_double(F.replace(F.regexp_extract(t, rf"^(\d+(?:[.,]\d+)?)\s*{unit}$", 1), F.lit(","), F.lit(".")))
    return (
        F.when(low == "marathon", F.lit(42.0))
        .when(low.isin(*HALF), F.lit(21.0))
        .when(low.rlike(r"(meters?|metres?)$"), body("(meters?|metres?)") / 1000)
        .when(low.rlike(r"(miles?|mi)$"), body("(miles?|mi)") * MILE_KM)
        .when(low.rlike(r"(km|k)$"), body("(km|k)"))
        .when(t.rlike(r"^\d+(?:[.,]\d+)?\s*M$"), plain("M") * MILE_KM)
        .when(t.rlike(r"^\d+(?:[.,]\d+)?\s*m$"), plain("m") / 1000)
        .otherwise(_try_double(F.replace(t, F.lit(","), F.lit("."))))
    )


def distance_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LIST_MARK), lambda x: F.trim(x)), lambda x: x != "")


def distances_km(text: Column) -> Column:
    """Kilometres of each distance of a list, those that can't be read left out."""
    return F.filter(F.transform(distance_tokens(text), distance_km), lambda x: x.isNotNull())


def primary_km(text: Column) -> Column:
    """Kilometres of the first distance of a list."""
    return distance_km(F.get(distance_tokens(text), F.lit(0)))


def roughly_equal(a: Column, b: Column, share: float = ROUGH) -> Column:
    return (a == b) | ((F.greatest(a, b) > 0) & (F.abs(a - b) < share * F.greatest(a, b)))


def within_share(reference: Column, other: Column, share: float) -> Column:
    return (reference > 0) & (F.abs(reference - other) <= share * reference)


def format_km(km: Column) -> Column:
    """"5 km", "10.1 km": one decimal, none for whole numbers."""
    one = F.round(km, 1)
    return F.concat(F.when(one == F.floor(one), F.floor(one).cast("string")).otherwise(one.cast("decimal(20,1)").cast("string")), F.lit(" km"))


def verbose_distances(text: Column) -> Column:
    """The list with each distance in kilometres, what can't be read as it is; null for a blank text."""
    each = F.transform(distance_tokens(text), lambda t: F.coalesce(format_km(distance_km(t)), t))
    return F.when(F.trim(text) != "", F.array_join(each, ", "))


def nearest_distance(km: Column, text: Column, share: float = 0.25) -> Column:
    """The distance of the list nearest to km, formatted, if within the share of km; of equally near ones the first."""
    found = F.transform(distances_km(text), lambda v, i: F.struct(F.abs(v - km).alias("off"), i.alias("i"), v.alias("v")))
    best = F.array_min(found)
    return F.when((km > 0) & within_share(km, best["v"], share), format_km(best["v"]))


#: Month names to English ones; the first that occurs is replaced.
MONTHS = (
    ("januar", "january"), ("februar", "february"), ("mars", "march"), ("april", "april"), ("mai", "may"), ("juni", "june"), ("juli", "july"), ("august", "august"),
    ("september", "september"), ("oktober", "october"), ("november", "november"), ("desember", "december"), ("januari", "january"), ("februari", "february"),
    ("maj", "may"), ("augusti", "august"), ("december", "december"), ("märz", "march"), ("marz", "march"), ("dezember", "december"), ("janvier", "january"),
    ("février", "february"), ("fevrier", "february"), ("avril", "april"), ("juin", "june"), ("juillet", "july"), ("août", "august"), ("aout", "august"),
    ("septembre", "september"), ("octobre", "october"), ("novembre", "november"), ("décembre", "december"), ("decembre", "december"), ("maart", "march"),
    ("mei", "may"), ("augustus", "august"), ("marts", "march"),
)
#: Week days that may stand before a date.
WEEKDAYS = (
    "måndag", "tisdag", "onsdag", "torsdag", "fredag", "lördag", "söndag", "mandag", "tirsdag", "lordag", "sondag", "lørdag", "søndag", "monday", "tuesday", "wednesday",
    "thursday", "friday", "saturday", "sunday", "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag", "lundi", "mardi", "mercredi", "jeudi",
    "vendredi", "samedi", "dimanche", "maandag", "dinsdag", "woensdag", "donderdag", "vrijdag", "zaterdag", "zondag",
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


_MONTH_NUMBER = {name: [e for _, e in MONTHS[:12]].index(english) + 1 for name, english in MONTHS} | {e: k for k, (_, e) in enumerate(MONTHS[:12], 1)}
#: All names of months.
MONTH_NAMES = tuple(_MONTH_NUMBER)
_SHORT_MONTH = {e[:3]: k for k, (_, e) in enumerate(MONTHS[:12], 1)}


def _lookup(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _numbers(low: Column) -> Column:
    """The numbers of a text as written, but for those of a clock time."""
    return F.regexp_extract_all(F.regexp_replace(low, r"\d+:\d+|\bkl\b\W*\d+\W\d+", " "), F.lit(r"\d+"), F.lit(0))


def _month_number(low: Column) -> Column:
    """1 to 12 of the first word that names a month in full, else of the first that starts like an English one; week days are skipped."""
    words = F.filter(F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)), lambda w: ~w.isin(*WEEKDAYS))
    first = lambda w, table, cut: F.get(F.filter(F.transform(w, lambda x: F.try_element_at(_lookup(table), cut(x))), lambda m: m.isNotNull()), F.lit(0))
    return _let(words, lambda w: F.coalesce(first(w, _MONTH_NUMBER, lambda x: x), first(w, _SHORT_MONTH, lambda x: F.left(x, F.lit(3)))))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), "y-M-d")


def iso_date(text: Column, as_of: Column) -> Column:
    """yyyy-MM-dd of a date in many forms: ISO, compact, day.month.year, month/day/year, or a day and a month's name in several languages,
    beside times and week days; without a year the next such day from as_of on. Null where it can't be read, as with years of two digits between marks.

    A text is read by what its parts are, not by its form: numbers of four digits are years, shorter ones days, words are looked up as
    months; only where no word names a month does the mark between the numbers tell their order."""
    t = F.trim(text)
    compact = F.when((F.length(t) == 8) & t.try_cast("int").isNotNull(), F.concat_ws("-", F.left(t, F.lit(4)), F.substring(t, 5, 2), F.right(t, F.lit(2))))
    plain = F.when((F.length(t) == 10) & (F.substring(t, 5, 1) == "-") & (F.substring(t, 8, 1) == "-"), t)
    return F.when(t != "", F.coalesce(plain, compact, _let(F.lower(t), lambda low: _read_date(low, as_of))))


def _read_date(low: Column, as_of: Column) -> Column:
    def read(s: Column) -> Column:
        n, month = s["n"], s["month"]
        year = F.get(F.filter(n, lambda x: F.length(x) == 4), F.lit(0))
        day = F.get(F.filter(n, lambda x: F.length(x) <= 2), F.lit(0))
        coming = _let(_day(F.year(as_of), month, day), lambda d: F.when(d >= as_of, d).otherwise(_day(F.year(as_of) + 1, month, day)))
        by_name = F.when(year.isNotNull(), _day(year, month, day)).otherwise(coming)
        a, b, c = (F.get(n, F.lit(k)) for k in range(3))
        by_mark = F.when(F.length(a) == 4, _day(a, b, c)).when(F.length(c) == 4, F.when(s["mark"] == ".", _day(c, b, a)).when(s["mark"] == "/", _day(c, a, b)))
        return F.date_format(F.when(month.isNotNull(), by_name).otherwise(by_mark), "yyyy-MM-dd")

    # of days that stand before a month's name the last counts
    low = F.regexp_replace(low, r"\b\d{1,2}\.?\s*[-–]\s*(\d{1,2}\.?\s+\p{L})", "$1")
    return _let(F.struct(_numbers(low).alias("n"), _month_number(low).alias("month"), F.regexp_extract(low, r"\d([./-])\d", 1).alias("mark")), read)


def range_start(text: Column, as_of: Column) -> Column:
    """iso_date() of a date or of the first day of a range between dotted dates, where the first may lack what it shares with the second
    ("15.-20.04.2026", "18.04.-04.05.2026", "1.2.2026-3.2.2026")."""

    def first(n: Column) -> Column:
        at = lambda *k: F.concat_ws(".", *[F.get(n, F.lit(i)) for i in k])
        own = F.when(F.size(n) == 4, at(0, 2, 3)).when(F.size(n) == 5, at(0, 1, 4)).when(F.size(n) == 6, at(0, 1, 2))
        return iso_date(F.when(text.contains("-") & text.contains(".") & ~text.rlike(r"\p{L}|:"), own).otherwise(text), as_of)

    return _let(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), first)


#: Race types by other names; an empty one is left out.
RACE_TYPES = {
    "stiløp": "trail", "stig": "trail", "trail race": "trail", "terreng": "cross country", "terräng": "cross country", "terrain": "cross country",
    "terrengløp": "cross country", "terränglopp": "cross country", "asfalt": "road", "landsväg": "road", "gateløp": "road", "gatlopp": "road", "väglopp": "road",
    "vägløp": "road", "road race": "road", "grus": "gravel", "grusväg": "gravel", "grusløp": "gravel", "gress": "grass", "gräs": "grass", "snø": "snow", "snö": "snow",
    "snowshoe": "snow", "trugeløp": "snow", "snöskor": "snow", "stafett": "relay", "motbakke": "uphill", "vertikal": "vertical", "sky": "skyrunning",
    "skysnow": "skyrunning, snow", "skyultra": "skyrunning", "trappeløp": "stairs", "trappor": "stairs", "trapper": "stairs", "hinderløp": "obstacle course",
    "ocr": "obstacle course", "baneløp": "track", "barneløp": "kids", "etappeløp": "stage race", "timeløp": "timed race", "triatlon": "triathlon",
    "hundeløp": "canicross", "randotrail": "trail", "trailblanc": "trail", "trailurbain": "urban trail", "trail running": "trail", "repeterende": "repeats",
    "backyard ultra": "backyard", "virtuelt": "virtual", "estafette": "relay", "veldloop": "cross country", "bergloop": "uphill", "hindernisloop": "obstacle course",
    "wegloop": "road", "terræn": "cross country", "berglauf": "uphill", "geländelauf": "cross country", "staffellauf": "relay", "stadtlauf": "road",
    "hindernislauf": "obstacle course", "stundenlauf": "timed race", "crosslauf": "cross country", "trailrun": "trail", "halbmarathon": "", "volkslauf": "",
    "volksmarsch": "", "escaliers": "stairs", "relais": "relay", "montagne": "mountain", "semi-marathon": "", "demi-marathon": "", "stafet": "relay", "bjergløb": "uphill",
    "vejløb": "road", "halvmaraton": "", "maraton": "", "half marathon": "", "marathon": "", "rando": "", "marchenordique": "", "ultra": "", "courseroute": "", "bane": "",
    "3mi": "", "start": "", "to": "", "label": "", "övrigt": "", "other": "", "annet": "", "diverse": "", "various": "", "(null)": "", "1": "", "2": "", "3": "", "4": "",
    "5": "", "6": "", "7": "", "8": "", "9": "", "nearly": "", "criteria": "",
}


def race_type(text: Column) -> Column:
    """The list's types by their usual names, each once; "trail" goes first where a type only contains it; null where none is left."""
    names = F.create_map(*[F.lit(x) for pair in RACE_TYPES.items() for x in pair])
    parts = F.filter(F.transform(F.split(F.lower(text), "[,;/_]"), lambda x: F.trim(x)), lambda x: x != "")
    usual = F.flatten(F.transform(parts, lambda p: F.transform(F.split(F.coalesce(F.try_element_at(names, p), p), "[,;/_]"), lambda x: F.trim(x))))
    usual = F.array_distinct(F.filter(usual, lambda x: x != ""))
    lead = ~F.array_contains(usual, "trail") & F.exists(usual, lambda x: F.contains(x, F.lit("trail")))
    out = F.when(lead, F.concat(F.array(F.lit("trail")), usual)).otherwise(usual)
    return F.when(F.size(out) > 0, F.array_join(out, ", "))


def infer_race_type(*texts: Column) -> Column:
    """A race type by key words, exclusions first; null without any."""
    t = F.lower(F.concat_ws(" ", *texts))
    # the key words below are fixed values
    has = lambda *words: t.rlike("|".join(words))
    return (
        F.when(has("duathlon"), None)
        .when(has("hinderbana", "ocr", "obstacle course"), "obstacle course")
        .when(has("swimrun"), "swimrun")
        .when(has("triathlon", "triatlon", "supersprint", "olympisk", "medeldistans", "långdistans", "trytri", "tri4fun", "terrängtriathlon"), "triathlon")
        .when(has("cykel", "gravel", "mtb", "mountainbike", "bike"), "cycling")
        .when(has("promenad", "simskola"), None)
        .when(has("löpning", "lopning", "run", "trail", "marathon", "backyard", "lopp", "ultra", "km", "mil"), "running")
    )


#: Names and three-letter codes of countries; two-letter codes stand for themselves.
COUNTRIES = {
    "AND": "AD", "ALB": "AL", "AUT": "AT", "BEL": "BE", "BGR": "BG", "BIH": "BA", "BLR": "BY", "CHE": "CH", "CYP": "CY", "CZE": "CZ", "DEU": "DE", "DNK": "DK", "ESP": "ES",
    "EST": "EE", "FIN": "FI", "FRA": "FR", "GBR": "GB", "GRC": "GR", "HRV": "HR", "HUN": "HU", "IRL": "IE", "ISL": "IS", "ITA": "IT", "KOS": "XK", "LIE": "LI", "LTU": "LT",
    "LUX": "LU", "LVA": "LV", "MDA": "MD", "MKD": "MK", "MLT": "MT", "MNE": "ME", "NLD": "NL", "NOR": "NO", "POL": "PL", "PRT": "PT", "ROU": "RO", "RUS": "RU", "SRB": "RS",
    "SVK": "SK", "SVN": "SI", "SWE": "SE", "TUR": "TR", "UKR": "UA", "AUS": "AU", "BRA": "BR", "CAN": "CA", "CHN": "CN", "HKG": "HK", "IDN": "ID", "IND": "IN", "JPN": "JP",
    "KOR": "KR", "MEX": "MX", "MYS": "MY", "NZL": "NZ", "PHL": "PH", "SGP": "SG", "THA": "TH", "USA": "US", "ZAF": "ZA",
    "SWEDEN": "SE", "SVERIGE": "SE", "SUÈDE": "SE",
    "SCHWEDEN": "SE", "NORWAY": "NO", "NORGE": "NO", "NORVÈGE": "NO", "DENMARK": "DK", "DANMARK": "DK", "DANEMARK": "DK", "FINLAND": "FI", "FINLANDE": "FI", "ICELAND": "IS",
    "GERMANY": "DE", "DEUTSCHLAND": "DE", "ALLEMAGNE": "DE", "TYSKLAND": "DE", "FRANCE": "FR", "FRANKRIKE": "FR", "SPAIN": "ES", "ESPAGNE": "ES", "SPANIEN": "ES",
    "ITALY": "IT", "ITALIE": "IT", "ITALIEN": "IT", "PORTUGAL": "PT", "UNITED KINGDOM": "GB", "ROYAUME-UNI": "GB", "IRELAND": "IE", "NETHERLANDS": "NL", "BELGIUM": "BE",
    "BELGIQUE": "BE", "SWITZERLAND": "CH", "SUISSE": "CH", "SCHWEIZ": "CH", "AUSTRIA": "AT", "AUTRICHE": "AT", "POLAND": "PL", "UNITED STATES": "US", "CANADA": "CA", "JAPAN": "JP",
}


def country_code(text: Column) -> Column:
    t = F.upper(F.trim(text))
    names = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.when(t.rlike("^[A-Z]{2}$"), t).otherwise(F.try_element_at(names, t))


def property_of(tags: Column, name: str) -> Column:
    """A map's value by key without case, the first of several."""
    return F.get(F.map_values(F.map_filter(tags, lambda k, v: F.lower(k) == name.lower())), F.lit(0))


def country_of_tags(tags: Column) -> Column:
    """Country code by the tags ISO3166-2 ("SE-AB") or ref:nuts ("SE11")."""
    iso = F.upper(F.split(property_of(tags, "ISO3166-2"), "-")[0])
    nuts = F.upper(F.substring(property_of(tags, "ref:nuts"), 1, 2))
    return F.coalesce(F.when(F.length(iso) == 2, iso), F.when(F.length(nuts) == 2, nuts))


def feature_id(value: Column, kind: str) -> Column:
    """An id without its kind; a boundary's without its level too."""
    bare = F.regexp_replace(value, f"^{kind}:", "")
    return F.regexp_replace(bare, r"^\d+:", "") if kind == "adminBoundary" else bare


def prefixed_id(value: Column, kind: str) -> Column:
    return F.when(value.startswith(f"{kind}:"), value).otherwise(F.concat(F.lit(f"{kind}:"), value))


def area_type(tags: Column) -> Column:
    """A protected area's type by its tags."""
    boundary, leisure, of_class = (F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")) for k in ("boundary", "leisure", "protect_class"))
    return F.when((boundary == "national_park") | (of_class == "2"), "national_park").when((leisure == "nature_reserve") | (of_class == "4"), "nature_reserve").otherwise("protected_area")


def elevation(text: Column) -> Column:
    """Metres of "1234", "1234 m" or "1234,5 m"."""
    return _try_double(F.replace(F.trim(F.regexp_replace(text, r"(?i)\s*m\.?\s*$", "")), F.lit(","), F.lit(".")))


def sanitize_name(name: Column, km: Column) -> Column:
    """A name without a leading whole number that is no distance, a bare decimal at the end, or a distance at the end that isn't about km.
    The name is read word by word; what would leave nothing stays."""
    units = ("km", "mi", "mile", "miles")
    is_unit = lambda w: F.coalesce(F.lower(w).isin(*units), F.lit(False))
    number = lambda w: F.replace(w, F.lit(","), F.lit(".")).try_cast("double")
    left = lambda w, k: F.slice(w, F.lit(1), F.greatest(F.size(w) - k, F.lit(0)))

    def without_number(w: Column) -> Column:
        leads = F.get(w, F.lit(0)).try_cast("long").isNotNull() & ~is_unit(F.get(w, F.lit(1)))
        return F.when((F.size(w) > 1) & F.coalesce(leads, F.lit(False)), F.slice(w, F.lit(2), F.size(w))).otherwise(w)

    def without_decimal(w: Column) -> Column:
        last = F.get(w, F.size(w) - 1)
        bare = number(last).isNotNull() & (last.contains(".") | last.contains(","))
        return F.when((F.size(w) > 1) & F.coalesce(bare, F.lit(False)), left(w, 1)).otherwise(w)

    def without_distance(w: Column) -> Column:
        last, before = F.get(w, F.size(w) - 1), F.get(w, F.size(w) - 2)
        apart = is_unit(last) & number(before).isNotNull()
        own = F.when(apart, distance_km(F.concat(before, last))).when(F.lower(last).rlike("[0-9](?:" + "|".join(units) + ")$"), distance_km(last))
        off = own.isNotNull() & km.isNotNull() & ~roughly_equal(own, km)
        taken = F.when(apart, F.lit(2)).otherwise(F.lit(1))
        return F.when((F.size(w) > taken) & F.coalesce(off, F.lit(False)), left(w, taken)).otherwise(w)

    return _let(_let(_let(F.split(F.trim(name), r"\s+"), without_number), without_decimal), lambda w: F.array_join(without_distance(w), " "))


def host(url: Column) -> Column:
    """The URL's host in lower case without "www."."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


#: Hosts on which many organisers have a page each. One more is left out, as its name may not stand here: pass it in `shared`.
SHARED_HOSTS = (
    "facebook.com", "instagram.com", "tracedetrail.fr", "nestelop.no", "runsignup.com", "ultrasignup.com", "my.raceresult.com", "raceroster.com", "welcu.com", "betrail.run", "itra.run",
    "sites.google.com", "docs.google.com", "runagain.com", "klikego.com", "anmalmig.nu", "mittlopp.se", "bit.ly", "tinyurl.com", "mp.weixin.qq.com", "fr.milesrepublic.com", "forms.gle",
    "linktr.ee", "airtable.com",
)
#: What of a shared host's path (and query) names the organiser: the first of the host's patterns that the path matches gives the
#: name; where none does, the whole path without its query is the name.
ORGANIZER_PATHS = (
    ("facebook.com", r"^profile\.php\?(?:.*&)?id=([^&]+).*", "profile.php?id=$1"),
    ("runsignup.com", r"^race(?:/events)*(?:/[^/?]+)*?((?:/[^/?]+){0,3})(?:\?.*)?$", "Race$1"),
    ("ultrasignup.com", r"^[^?]*\.aspx\?(?:.*&)?did=([^&]+).*", "register.aspx?did=$1"),
    ("my.raceresult.com", r"^([^/?]+).*", "$1"),
    ("welcu.com", r"^([^/?]+).*", "$1"),
    ("bit.ly", r"^([^/?]+).*", "$1"),
    ("tinyurl.com", r"^([^/?]+).*", "$1"),
    ("airtable.com", r"^([^/?]+).*", "$1"),
    ("raceroster.com", r"^(events(?:/[^/?]+){3}).*", "$1"),
    ("betrail.run", r"^(?:[^?]*/)?race/([^/?]+).*", "race/$1"),
    ("itra.run", r"^(races/racedetails/[^/?]+).*", "$1"),
    ("sites.google.com", r"^((?:site|view)/[^/?]+).*", "$1"),
    ("sites.google.com", r"^([^/?]+).*", "$1"),
    ("docs.google.com", r"^([^/?]+/d/[^/?]+).*", "$1"),
    ("klikego.com", r"^(?:[^?]*/)?inscription/([^/?]+).*", "inscription/$1"),
    ("anmalmig.nu", r"^(?:[^?]*/)?anmalan/([^/?]+).*", "anmalan/$1"),
    ("mittlopp.se", r"^(?:[^?]*/)?anm/([^/?]+).*", "anm/$1"),
    ("mittlopp.se", r"^([^/?]+).*", "$1"),
)
#: Hosts that aren't crawled, and hosts of social media.
BLOCKED_HOSTS = ("lopplistan.se", "loppkartan.se", "trailrunningsweden.se", "betrail.run", "tracedetrail.fr", "itra.run", "d-u-v.org", "skyrunning.com", "utmb.world")
SOCIAL_HOSTS = ("facebook.com", "fb.me", "fb.com", "youtube.com", "youtu.be", "instagram.com", "twitter.com", "x.com", "tiktok.com", "linkedin.com")


def organizer_key(url: Column, shared: tuple[str, ...] = SHARED_HOSTS, paths: tuple[tuple[str, str, str], ...] = ORGANIZER_PATHS) -> Column:
    """The host, and on shared hosts what of the path names the organiser, with "~" for "/"."""

    def key(u: Column) -> Column:
        path = F.trim(F.coalesce(u["path"], F.lit("")), F.lit("/"))
        full = F.concat(path, F.coalesce(F.concat(F.lit("?"), u["query"]), F.lit("")))
        named = reduce(lambda c, r: c.when((u["host"] == r[0]) & full.rlike(f"(?i){r[1]}"), F.regexp_replace(full, f"(?i){r[1]}", r[2])), paths, F.when(F.lit(False), path)).otherwise(path)
        return F.when(u["host"].isin(*shared) & (path != ""), F.concat(u["host"], F.lit("~"), F.replace(named, F.lit("/"), F.lit("~")))).otherwise(u["host"])

    part = lambda p: F.try_parse_url(url, F.lit(p))
    return _let(F.struct(host(url).alias("host"), part("PATH").alias("path"), part("QUERY").alias("query")), key)


def may_crawl(url: Column) -> Column:
    """Not a blocked host or one below it, and not a social network's bare front page."""
    h = host(url)
    blocked = reduce(lambda a, d: a | (h == d) | h.endswith("." + d), BLOCKED_HOSTS, F.lit(False))
    bare = h.isin(*SOCIAL_HOSTS) & (F.trim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")) == "")
    return ~blocked & ~bare


def comparable_stem(key: Column) -> Column:
    """A host's letters and digits without its public suffix."""
    labels = F.split(F.regexp_replace(F.lower(key), r"^www\.", ""), r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3)
    left = F.when(two, F.slice(labels, 1, F.greatest(n - 2, F.lit(0)))).when(n >= 2, F.slice(labels, 1, F.greatest(n - 1, F.lit(0)))).otherwise(labels)
    return F.regexp_replace(F.array_join(left, ""), r"[^\p{L}\p{N}]", "")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def repaired_url(url: Column) -> Column:
    """An address whose scheme stands there twice, the second perhaps without its colon or behind other letters, from its second scheme on."""
    parts = F.split(url, "//")
    inner = F.regexp_extract(F.get(parts, F.lit(1)), "(?i)(https?):?$", 1)
    doubled = F.lower(parts[0]).isin("http:", "https:") & (F.size(parts) > 2) & ~F.contains(F.get(parts, F.lit(1)), F.lit("/")) & (inner != "")
    return F.when(doubled, F.concat(inner, F.lit("://"), F.array_join(F.slice(parts, 3, F.size(parts)), "//"))).otherwise(url)


def address_slug(url: Column, number: Column | None = None) -> Column:
    """The host and the parts of the path with "-" between them, and the number of one of several routes of an address after them."""
    path = F.translate(F.trim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), "/", "-")
    return F.when(host(url).isNotNull(), F.concat_ws("-", host(url), F.nullif(path, F.lit("")), *([] if number is None else [number.cast("string")])))


def name_slug(*parts: Column) -> Column:
    """The slugs of a name, a distance and so on with "-" between them; null where none is left."""
    return F.nullif(F.concat_ws("-", *[F.nullif(slug(p), F.lit("")) for p in parts]), F.lit(""))


#: Hosts whose events aren't taken.
IGNORED_HOSTS = ("test.com",)


def event_key(urls: list[Column], name: Column, distance: Column, ignored: tuple[str, ...] = IGNORED_HOSTS) -> Column:
    """struct<key, url> of an event: of the first of its addresses that is given, in order of trust, its organizer's key; where none is, the slug of its
    name and distance, with an address of its own scheme. Null where that first address is on an ignored host, and where nothing is given."""
    pair = lambda key, url: F.struct(key.alias("key"), url.alias("url"))

    def of(u: Column) -> Column:
        named = name_slug(name, distance)
        given = F.when(~F.coalesce(host(u).isin(*ignored), F.lit(False)), pair(organizer_key(u), u))
        return F.when(u.isNotNull(), given).when(named.isNotNull(), pair(named, F.concat(F.lit("name://"), named)))

    return _let(repaired_url(F.coalesce(*[F.nullif(F.trim(u), F.lit("")) for u in urls])), of)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]+>", " "))


def visible_text(html: Column) -> Column:
    """A page's text: scripts, styles and comments out, tags as spaces, white space as one space."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " "))


def links(html: Column) -> Column:
    """The href values in quotes, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*)"'), F.lit(1))


def text_distances(text: Column) -> Column:
    """Distances in kilometres that a text names, more than 0 and up to 500; of those alike to a whole kilometre the first."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(\d{1,3}(?:[.,]\d+)?\s*(?:km|miles|mi))\b"), F.lit(1))
    km = F.filter(F.transform(found, distance_km), lambda x: (x > 0) & (x <= 500))
    return F.aggregate(km, F.array().cast("array<double>"), lambda a, x: F.when(F.exists(a, lambda y: F.bround(y) == F.bround(x)), a).otherwise(F.array_append(a, x)))


def lowest_price(text: Column) -> Column:
    """The least whole number that stands before a currency mark."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(\d[\d ]*)\s*(?:kr|sek|nok|dkk|eur|€|\$|£)"), F.lit(1))
    return F.array_min(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit("")).try_cast("decimal(10,0)")))


#: Zoom from which a way is drawn, by its class.
WAY_ZOOM = {
    0: ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link"),
    10: ("tertiary", "tertiary_link", "unclassified", "road"),
    12: ("service", "services"),
    13: ("residential", "living_street"),
    14: ("busway", "bus_guideway"),
}
TRAIL_ZOOM = {7: ("path", "track"), 10: ("cycleway", "bridleway"), 11: ("footway", "pedestrian", "steps", "corridor", "sidewalk", "crossing", "link", "rest_area", "escape", "informal")}
POORLY_VISIBLE = ("bad", "very_bad", "horrible", "very_horrible", "impassable")
SAC_ZOOM = {1: ("demanding_mountain_hiking", "alpine_hiking"), 2: ("demanding_alpine_hiking", "difficult_alpine_hiking")}
EPSILON = {7: 0.013, 8: 0.007, 9: 0.004, 10: 0.002, 11: 0.0005, 12: 0.0002}


def least_zoom(highway: Column, footway: Column, visibility: Column, sac_scale: Column) -> Column:
    """The zoom from which a way is drawn: the least of its two classes', trails later when poorly visible or hard; null for never."""
    penalty = F.when(visibility.isin(*POORLY_VISIBLE), 2).otherwise(0) + F.when(sac_scale.isin(*SAC_ZOOM[2]), 2).when(sac_scale.isin(*SAC_ZOOM[1]), 1).otherwise(0)

    def of(value: Column) -> Column:
        roads = [F.when(value.isin(*names), F.lit(z)) for z, names in WAY_ZOOM.items()]
        trails = [F.when(value.isin(*names), z + penalty) for z, names in TRAIL_ZOOM.items()]
        return F.coalesce(*roads, *trails)

    return F.least(of(highway), of(footway))


def zoom_epsilon(zoom: Column) -> Column:
    """Degrees a line is simplified by at a zoom."""
    return reduce(lambda c, z: c.when(zoom == z, EPSILON[z]), list(EPSILON)[1:], F.when(zoom <= 7, EPSILON[7])).otherwise(0.0)
