"""Scalar functions of the place and timetable domain, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licence states that count as open, the station alias, and the branch that a first or last stop of a line names.
ACTIVE_STATES = ("영업/정상", "영업")
STATION_ALIASES = {"이수": "총신대입구"}
BRANCHES = {("2", "신설동"): "성수지선", ("2", "까치산"): "신정지선", ("2", "도림천"): "신정지선"}
SUFFIXES = "(급행|성수지선|신정지선)$"
INVITE_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

NO_SERVICE = -1


def number_of(*parts: Column) -> Column:
    """Sixty bits of the MD5 of the parts: an id that other engines compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends; empty becomes null."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


#: Year, month, day and time as a lenient parser takes them: with or without a leading zero.
_MONTH, _DAY = "(1[0-2]|0[1-9]|[1-9])", "(3[01]|[12][0-9]|0[1-9]|[1-9])"
_TIME = r"\s+(?:2[0-3]|[01][0-9]|[0-9]):(?:[0-5][0-9]|[0-9]):(?:6[01]|[0-5][0-9]|[0-9])"
_DATE_FORMS = ((10, f"^([0-9]{{4}})-{_MONTH}-{_DAY}$"), (8, f"^([0-9]{{4}}){_MONTH}{_DAY}$"), (19, f"^([0-9]{{4}})-{_MONTH}-{_DAY}{_TIME}$"))


def parse_date(c: Column) -> Column:
    """The date of 2012-08-29, 2012-8-29 or 20120829, or of either with something behind it.

    Read are the first 10 characters as year-month-day, else the first 8 without dashes, else the first 19
    with a time of day; anything else is null.
    """

    def read(s: Column) -> Column:
        return F.coalesce(*[F.transform(F.array(F.trim(F.substring(s, 1, n))), lambda t: F.when(t.rlike(form), F.try_to_date(F.regexp_replace(t, form, "$1-$2-$3"), "yyyy-M-d")))[0] for n, form in _DATE_FORMS])

    # A lambda over one element computes the stripped text once.
    return F.transform(F.array(strip(c)), read)[0]


def parse_hms(c: Column) -> Column:
    """HH:MM:SS in seconds, hours over 24 allowed; 00:00:00 means missing, malformed is null."""
    s = F.trim(c)
    part = F.split(s, ":")
    seconds = F.get(part, F.lit(0)).try_cast("int") * 3600 + F.get(part, F.lit(1)).try_cast("int") * 60 + F.get(part, F.lit(2)).try_cast("int")
    return F.when(s.rlike(r"^\d{1,3}:\d{1,2}:\d{1,2}$") & (s != "00:00:00"), seconds)


def is_active(c: Column) -> Column:
    return F.coalesce(F.trim(c).isin(*ACTIVE_STATES), F.lit(False))


def normalize_category(c: Column) -> Column:
    return F.nullif(F.translate(F.trim(c), " ·", ""), F.lit(""))


def normalize_line(c: Column) -> Column:
    """The digit of "N호선", else null."""
    return F.nullif(F.regexp_extract(c, r"^\s*(\d)\s*호선\s*$", 1), F.lit(""))


def normalize_station(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\(.*?\)", ""), " ", "")


def station_key(c: Column) -> Column:
    key = normalize_station(c)
    out = key
    for name, other in STATION_ALIASES.items():
        out = F.when(key == name, F.lit(other)).otherwise(out)
    return out


def line_key(line: Column, express: Column, first: Column, last: Column) -> Column:
    """Express trains and branches as lines of their own. Any flag but "0" is express, a missing one too; a branch
    is told by the first stop of a train or else by its last."""
    named = lambda stop: F.coalesce(*[F.when((line == of) & (stop == at), F.lit(name)) for (of, at), name in BRANCHES.items()], F.lit(None).cast("string"))
    branch = F.coalesce(named(first), named(last), F.lit(""))
    return F.when(F.coalesce(express, F.lit("")) != "0", F.concat(line, F.lit("급행"))).otherwise(F.concat(line, branch))


def base_line(c: Column) -> Column:
    return F.regexp_replace(c, SUFFIXES, "")


def is_express(c: Column) -> Column:
    return c.endswith("급행")


def is_branch(c: Column) -> Column:
    return c.rlike("지선$")


def line_name(c: Column) -> Column:
    """N호선, with the express or branch behind it; other lines by their own name."""
    base = base_line(c)
    tail = F.regexp_extract(c, SUFFIXES, 1)
    named = F.when(base.rlike(r"^\d$"), F.concat(base, F.lit("호선"))).otherwise(base)
    return F.when(tail == "", named).otherwise(F.concat(named, F.lit(" "), tail))


def walk_seconds(metres: Column, speed: float = 1.2) -> Column:
    return F.greatest(F.lit(1), F.bround(metres / speed).cast("int"))


def board_wait(headway: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(headway / 2).cast("int"))


def service_hour(seconds: Column) -> Column:
    return (F.floor(seconds / 3600) % 24).cast("int")


def weekday_bucket(date: Column) -> Column:
    day = F.weekday(date)
    return F.when(day <= 4, "DAY").when(day == 5, "SAT").otherwise("END")


def representative(hours: Column) -> Column:
    """The rounded median of the running hours; -1 if none runs."""
    run = F.array_sort(F.filter(hours, lambda h: h != NO_SERVICE))
    n = F.size(run)
    middle = (F.get(run, ((n - 1) / 2).cast("int")) + F.get(run, (n / 2).cast("int"))) / 2
    return F.when(n == 0, F.lit(NO_SERVICE)).otherwise(F.bround(middle).cast("int"))


def shifted_hours(hours: Column, offset: Column) -> Column:
    return F.transform(hours, lambda h: F.when(h == NO_SERVICE, h).otherwise(h + offset))


def weight_at(hours: Column, base: Column, hour: int | None) -> Column:
    """The hour's weight, the base weight where there is none; no hour: the base weight."""
    return base if hour is None else F.coalesce(F.get(hours, F.lit(hour)), base)


def round_half_up(c: Column, digits: int = 1) -> Column:
    k = 10**digits
    return F.floor(c * k + 0.5) / k


def address(road: Column, lot: Column) -> Column:
    return F.coalesce(road, lot)


def invite_code(c: Column) -> Column:
    """The eight characters of a typed code, look-alikes resolved; null if it isn't one."""
    code = F.regexp_replace(F.translate(F.upper(c), "OILU-", "011V"), r"\s|[^0-9A-Z]", "")
    return F.when(code.rlike(f"^[{INVITE_ALPHABET}]{{8}}$"), code)


def shown_invite_code(code: Column) -> Column:
    return F.concat(F.substring(code, 1, 4), F.lit("-"), F.substring(code, 5, 4))


def login_id(c: Column) -> Column:
    """Lower-cased, null unless it is 4 to 20 letters, digits or underscores as typed; blanks aren't trimmed away."""
    return F.when(c.rlike(r"^[A-Za-z0-9_]{4,20}\z"), F.lower(c))


def utf16_length(c: Column) -> Column:
    """Characters, those beyond the basic plane counted twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def nickname(c: Column) -> Column:
    """Without white space at the ends, null if it is blank or wasn't 2 to 20 characters long as typed."""
    return F.when((F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "") != "") & utf16_length(c).between(2, 20), F.coalesce(strip(c), F.lit("")))


def password_fits(password: Column, again: Column) -> Column:
    """Whether a password is 8 to 64 characters, not blank, and typed the same twice."""
    blank = F.regexp_replace(password, r"^[\x00-\x20]+|[\x00-\x20]+$", "") == ""
    return F.coalesce(~blank & utf16_length(password).between(8, 64) & (password == again), F.lit(False))


def attachment_name(disposition: Column) -> Column:
    """The file name of a Content-Disposition header: the encoded one if there is one, else the plain one."""
    parts = F.transform(F.split(disposition, ";"), lambda p: F.trim(p))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    value = lambda p: F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")
    encoded = F.get(F.filter(parts, lambda p: (key(p) == "filename*") & (F.instr(value(p), "''") > 0)), F.lit(0))
    plain = F.get(F.filter(parts, lambda p: key(p) == "filename"), F.lit(0))
    text = F.when(encoded.isNotNull(), F.regexp_extract(value(encoded), "(?s)''(.*)$", 1))
    # Plus signs stay: only percent escapes are decoded.
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), F.when(plain.isNotNull(), F.regexp_replace(value(plain), '^"+|"+$', "")))


def lot_matches(address_: Column, lot: str) -> Column:
    """The lot number, not followed by further digits."""
    import re

    return address_.rlike(re.escape(lot) + r"(?!\d)")


def coordinate(c: Column) -> Column:
    """"lng,lat" as a struct; null for anything else, such as a name."""
    part = F.split(c, ",")
    lng, lat = F.trim(F.get(part, F.lit(0))).try_cast("double"), F.trim(F.get(part, F.lit(1))).try_cast("double")
    return F.when((F.size(part) == 2) & lng.isNotNull() & lat.isNotNull(), F.struct(lng.alias("lng"), lat.alias("lat")))


def route_summary(seconds: Column, transfers: Column, walk: Column, names: Column) -> Column:
    return F.format_string("%d분 %d초 · 환승 %d · 도보 %.0fm · %s", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"), transfers, walk, F.array_join(names, " → "))
