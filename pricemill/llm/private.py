"""Format-preserving pseudonyms for private data, in DataFrame functions only.

Numbers, dates and addresses are found by one pattern, validated by kind (check digits, ranges, the
calendar), and replaced by another valid value of the same format: an alternating Feistel network
permutes the values of the format under a key, so equal values get equal pseudonyms in every
document and different values different ones. Matches that fail validation stay as they are.

Each value is a pair (a, b) of numbers below (m, n); a round adds a keyed digest of one half to the
other modulo its bound, which is a bijection whatever the bounds are.

There is no default key: without one, pseudonyms could be turned back by anyone. The key itself never
stands in a plan; what does is a key of the rounds made from it by a one-way function, which still has
to be kept as safe as the corpus, as plans show it.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

ROUNDS = 8
#: Setting of the session that holds the key, where no argument gives one.
KEY_SETTING = "spark.corpus.pseudonym.key"
#: Public key of the query, which has to run without settings; for nothing else.
QUERY_KEY = "public key of the query, hides nothing"

# The forms that are looked for. Repeats of groups and of what stands before the @ are
# bounded (by the longest address that mail allows), as the matcher goes one call deeper for each.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,126}\.[A-Za-z]{2,63}"
IPV4 = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])"
PHONE = r"\+[0-9]{1,3}[ .\-]?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9\-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9\-])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
DATE = r"(?<![0-9.\-/])(?:[0-9]{4}([\-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[\-/.][0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z])"
ACCESS_KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
HEX_TOKEN = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "ip": IPV4, "phone": PHONE, "ssn": SSN, "date": DATE, "card": CARD, "access_key": ACCESS_KEY, "hex_token": HEX_TOKEN}
ANY = "|".join(KINDS.values())
#: Any text with a match of ANY has one of this, which is found sooner.
GATE = "[0-9@]|AKIA[A-Z]{16}|[a-f]{32}|[A-F]{32}"


def _part(text: Column, begin, length) -> Column:
    return F.substring(text, begin, length)


def feistel(a: Column, b: Column, m, n, tweak: Column, key: str, reverse: bool = False) -> Column:
    """The pair (a, b) with a < m and b < n, permuted; with reverse, back again."""
    m, n = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (m, n))

    def digest(i: Column, x: Column) -> Column:
        mixed = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256)
        return F.conv(_part(mixed, F.lit(1), F.lit(14)), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        sign = -1 if reverse else 1
        first = F.struct(F.pmod(s.a + sign * (digest(i, s.b) % m), m).alias("a"), s.b.alias("b"))
        second = F.struct(s.a.alias("a"), F.pmod(s.b + sign * (digest(i, s.a) % n), n).alias("b"))
        return F.when(i % 2 == 0, first).otherwise(second)

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _then(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _power(radix: int, n: Column) -> Column:
    return F.pow(F.lit(radix).cast("double"), n).cast("long")


def permute_string(s: Column, radix: int, kind: str, key: str, reverse: bool = False) -> Column:
    """A string of lower-case digits of the radix, permuted among those of its length, in blocks of 20
    digits; each block is keyed by the number of digits before it."""

    def block(x: Column, tweak: Column) -> Column:
        u = F.floor(F.length(x) / 2).cast("int")
        v = (F.length(x) - u).cast("int")
        number = lambda t: F.coalesce(F.conv(F.when(t != "", t), radix, 10).cast("long"), F.lit(0).cast("long"))
        pair = feistel(number(_part(x, F.lit(1), u)), number(_part(x, u + 1, v)), _power(radix, u), _power(radix, v), tweak, key, reverse)
        digits = lambda t, n: F.lpad(F.lower(F.conv(t.cast("string"), 10, radix)), n, F.lit("0"))
        return _then(pair, lambda p: F.concat(digits(p.a, u), digits(p.b, v)))

    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(s) - 1) / 20), F.lit(0)).cast("int"))
    return F.array_join(F.transform(starts, lambda j: block(_part(s, j * 20 + 1, F.lit(20)), F.concat(F.lit(f"{kind}|{radix}|"), F.length(s).cast("string"), F.lit("|"), j.cast("string")))), "")


def _laid_out(m: Column, digits: Column, not_digit: str) -> Column:
    """The characters of digits put in the places of m that aren't not_digit."""
    place = lambda p: F.length(F.regexp_replace(_part(m, F.lit(1), p), not_digit, ""))
    one = lambda p: _part(m, p, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda p: F.when(one(p).rlike(not_digit), one(p)).otherwise(_part(digits, place(p), F.lit(1)))), "")


def luhn_sum(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = _part(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(m: Column, key: str, reverse: bool) -> Column:
    """All digits but the check digit, which is made anew. Any number of 13 to 19 digits with the right check digit is a card:
    networks and their ranges are many and change, and a number that only looks like a card loses nothing but its value."""

    def of(digits: Column) -> Column:
        moved = permute_string(_part(digits, F.lit(1), F.length(digits) - 1), 10, "card", key, reverse)
        whole = _then(moved, lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when((F.length(digits) >= 13) & (luhn_sum(digits) % 10 == 0), _laid_out(m, whole, "[^0-9]")).otherwise(m)

    return _then(F.regexp_replace(m, "[^0-9]", ""), of)


def _phone(m: Column, key: str, reverse: bool) -> Column:
    """The last ten digits are permuted; a country code before them stays. A number without one whose
    area and exchange begin with 2 to 9, as they must, keeps to such numbers; others have no such rule."""

    def of(digits: Column) -> Column:
        kept = F.greatest(F.length(digits) - 10, F.lit(0))
        moved = permute_string(_part(digits, kept + 1, F.lit(10)), 10, "phone", key, reverse)
        plain = F.concat(_part(digits, F.lit(1), kept), moved)
        area, rest = _part(digits, F.lit(1), F.lit(3)).cast("long"), _part(digits, F.lit(4), F.lit(7)).cast("long")
        pair = feistel(area - 200, rest - 2_000_000, 800, 8_000_000, F.lit("phone"), key, reverse)
        valid = _then(pair, lambda p: F.format_string("%03d%07d", p.a + 200, p.b + 2_000_000))
        return _laid_out(m, F.when(digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), valid).otherwise(plain), "[^0-9]")

    return _then(F.regexp_replace(m, "[^0-9]", ""), of)


def _ssn(m: Column, key: str, reverse: bool) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (_part(m, F.lit(b), F.lit(n)).cast("int") for b, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group != 0) & (serial != 0)
    place = F.when(area < 666, area - 1).otherwise(area - 2)
    pair = feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, F.lit("ssn"), key, reverse)

    def written(p: Column) -> Column:
        i = F.floor(p.a / 99)
        return F.format_string("%03d-%02d-%04d", F.when(i < 665, i + 1).otherwise(i + 2), p.a % 99 + 1, p.b + 1)

    return F.when(valid, _then(pair, written)).otherwise(m)


def _ip(m: Column, key: str, reverse: bool) -> Column:
    def of(o: Column) -> Column:
        valid = F.forall(o, lambda x: (x.cast("int") <= 255) & ((F.length(x) == 1) | ~x.startswith("0")))
        number = lambda i: F.element_at(o, i).cast("long")
        pair = feistel(number(1) * 256 + number(2), number(3) * 256 + number(4), 65536, 65536, F.lit("ip"), key, reverse)
        half = lambda x: (F.floor(x / 256), x % 256)
        return F.when(valid, _then(pair, lambda p: F.format_string("%d.%d.%d.%d", *half(p.a), *half(p.b)))).otherwise(m)

    return _then(F.split(m, r"\."), of)


def _date(m: Column, key: str, reverse: bool) -> Column:
    """Days are permuted within spans of 36525 days, counted from 1930-01-01."""
    style = F.when(m.rlike("^[0-9]{4}"), "year").when(m.contains("/"), "month").otherwise("day")
    piece = lambda *at: [_part(m, F.lit(b), F.lit(n)) for b, n in at]
    y1, m1, d1 = piece((1, 4), (6, 2), (9, 2))
    a2, b2, y2 = piece((1, 2), (4, 2), (7, 4))
    iso = F.when(style == "year", F.concat_ws("-", y1, m1, d1)).when(style == "month", F.concat_ws("-", y2, a2, b2)).otherwise(F.concat_ws("-", y2, b2, a2))
    origin = F.lit("1930-01-01").cast("date")

    def of(day: Column) -> Column:
        days = F.datediff(day, origin)
        span = F.floor(days / 36525)
        place = days - span * 36525
        pair = feistel(F.floor(place / 487), place % 487, 75, 487, F.concat(F.lit("date|"), span.cast("string")), key, reverse)

        def written(p: Column) -> Column:
            to = F.date_add(origin, (span * 36525 + p.a * 487 + p.b).cast("int"))
            sep = _part(m, F.lit(5), F.lit(1))
            year = F.date_format(to, "yyyy")
            return F.when(style == "year", F.concat(year, sep, F.date_format(to, "MM"), sep, F.date_format(to, "dd"))).otherwise(
                F.when(style == "month", F.date_format(to, "MM/dd/yyyy")).otherwise(F.date_format(to, "dd.MM.yyyy"))
            )

        return F.when(day.isNotNull() & (F.year(day) >= 1000), _then(pair, written)).otherwise(m)

    return _then(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), of)


def _email(m: Column, key: str, reverse: bool) -> Column:
    """The letters and digits before the @ are permuted (letters as lower case); the domain stays."""
    local = F.lower(F.substring_index(m, "@", 1))
    moved = permute_string(F.regexp_replace(local, "[^a-z0-9]", ""), 36, "email", key, reverse)
    out = F.concat(_laid_out(local, moved, "[^a-z0-9]"), F.lit("@"), F.substring_index(m, "@", -1))
    return F.when(local.rlike("[a-z0-9]"), out).otherwise(m)


def _access_key(m: Column, key: str, reverse: bool) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(permute_string(F.lower(_part(m, F.lit(5), F.lit(16))), 36, "access_key", key, reverse)))


def _hex_token(m: Column, key: str, reverse: bool) -> Column:
    """A token with upper-case letters stays upper-case."""
    moved = permute_string(F.lower(m), 16, "hex_token", key, reverse)
    return F.when(m.rlike("[A-F]"), F.upper(moved)).otherwise(moved)


_BY_KIND = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card, "access_key": _access_key, "hex_token": _hex_token}


def pseudonym(m: Column, key: str, reverse: bool = False) -> Column:
    """The pseudonym of a match of ANY, or the match itself where its kind's validation fails."""
    out = None
    for kind, pattern in KINDS.items():
        whole, value = m.rlike(f"^(?:{pattern})$"), _BY_KIND[kind](m, key, reverse)
        out = F.when(whole, value) if out is None else out.when(whole, value)
    return out.otherwise(m)


def round_key(key: str) -> str:
    """What the rounds are keyed with."""
    return hmac.new(key.encode("utf-8"), b"rounds of the pseudonyms", hashlib.sha256).hexdigest()


def pseudonymise(docs: DataFrame, key: str | None = None, reverse: bool = False) -> DataFrame:
    """docs with the private data of text replaced, and __n_private, the number of values replaced.

    The key is the argument or the session's setting KEY_SETTING; without one a ValueError is raised.
    A null text stays null with 0 values; a text without private data stays as it is, and an empty
    table gives an empty one. With reverse and the same key the values come back (letters of
    addresses in lower case). Repeated rows are rows of their own; other columns stay, whatever
    their names (a column __n_private of docs is replaced). A local part of over 64 characters or a
    domain of over 128 labels is no address. The time is linear in the length of a text.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: give one, or set {KEY_SETTING}")
    key = round_key(key)
    old, new = free_name("__found", docs), free_name("__new", docs)
    found = F.when(F.col("text").rlike(GATE), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    # evaluated behind a filter on its size, so that the pieces are only cut where something was found
    out = docs.withColumn(old, F.coalesce(found, F.array().cast("array<string>")))
    out = out.withColumn(new, F.transform(old, lambda m: pseudonym(m, key, reverse)))
    pieces = F.split("text", ANY, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size(new)), new, lambda p, n: F.concat(p, n)), ""), F.element_at(pieces, -1))
    text = F.when(F.size(new) > 0, joined).otherwise(F.col("text"))
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))
    rest = [c for c in docs.columns if c != "__n_private"]
    return out.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in rest), changed.cast("long").alias("__n_private"))


def op10_private_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private data of every whole text of documents, replaced."""
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, None) or QUERY_KEY)
    return found.select("doc_id", "text", F.col("__n_private").alias("n_private"))
