"""Personal data to format-preserving pseudonyms, in DataFrame functions only.

Validated numbers and dates go through a keyed Feistel network over their own domain: the result is again a valid value in
the same notation, different values stay different and equal values stay equal across documents.  Numbers that fail their
check (Luhn, mod 97, octets, calendar) are no personal data and stay.  Addresses and keys have no number domain; they
get a keyed digest in their form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundlake.llm.common import text_of

# rules of calendar, octets and areas stand in the notations, so that a match is valid and nothing else takes up text
_YEAR, _LEAP = r"(?:18|19|20|21)\d{2}", r"(?:(?:18|19|20|21)(?:0[48]|[2468][048]|[13579][26])|2000)"
_LONG, _ANY_DAY, _DAY_30, _DAY_28 = "(?:0[13578]|1[02])", r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|30)", r"(?:0[1-9]|1\d|2[0-8])"
_MONTH_DAY = rf"(?:{_LONG}%s{_ANY_DAY}|(?:0[469]|11)%s{_DAY_30}|02%s{_DAY_28})"
_DAY_MONTH = rf"(?:{_DAY_30}%s(?:0[13-9]|1[0-2])|31%s{_LONG}|{_DAY_28}%s02)"
_DATES = "|".join((
    rf"{_YEAR}-{_MONTH_DAY.replace('%s', '-')}|{_LEAP}-02-29",
    rf"{_MONTH_DAY.replace('%s', '/')}/{_YEAR}|02/29/{_LEAP}",
    rf"(?=1[3-9]|[23]){_DAY_MONTH.replace('%s', '/')}/{_YEAR}|29/02/{_LEAP}",
    rf"{_DAY_MONTH.replace('%s', '[.]')}[.]{_YEAR}|29[.]02[.]{_LEAP}"))
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})"
_CARD = r"(?<![\d-])(?:\d{4}(?:[ -]?\d{3,6}){2,4}|\d{13,19})(?!-?\d)"
_IBAN = r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"
_FIGURE = r"[ .()-]{0,3}\d"  # 8 to 15 of them since the plus; written out, as a look back takes no repeated groups
_FIGURES = rf"(?<=\+{8 * _FIGURE}{7 * f'(?:{_FIGURE}'}{7 * ')?'}\)?)"
# labels up to the last one that begins with two letters, of that one its letters; nothing is taken back, as Java's matcher
# goes one call deeper for each repetition of a group that could be
_DOMAIN = r"(?=[A-Za-z0-9-])(?:[A-Za-z0-9-]*+(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+\.[A-Za-z]{2,}+)++"
# fixed values: the notations looked for, tried in this order at each place; no expression checks account and card numbers,
# their places are taken by the text's own valid numbers, and a phone number ends where a valid card number begins
FORMS = (
    ("secret", r"(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|auth[_-]?key|key)\b[\"']?[ \t]*[:=][ \t]*[\"']?)[A-Za-z0-9_\-+/.]{16,}"),
    ("key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+][A-Za-z0-9._%+-]*@" + _DOMAIN),
    ("ip", rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)"),
    ("iban", "<iban>"),
    ("date", rf"(?<![\d/.-])(?:{_DATES})(?![\d]|[/.-]\d)"),
    ("ssn", r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d]|-\d)"),
    ("card", "<card>"),
    ("phone", r"(?<![\d.])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-](?!<card>)\d{4}(?![\d]|[.-]\d)"),
    ("intl", r"(?<![\d.])\+[1-9]\d{0,2}(?:[ .-]?(?!<card>)\(?\d{1,4}\)?){2,5}(?![\d]|[.-]\d)" + _FIGURES),
)
ANY = "|".join(f"(?:{form})" for _, form in FORMS)
NUMBERS = f"(?=({_CARD}|{_IBAN}))"  # from every place where one may begin, also within others
ROUNDS = 8
FIRST_DAY, CYCLE = "1800-01-01", 146_097  # days in any 400 calendar years
LATE_DAYS = CYCLE - 12 * 4800  # those after the twelfth of their month


def _noise(key: str, kind: str, turn: Column, value: Column) -> Column:
    """A keyed number below 2**60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """A keyed permutation of pairs (left below a, right below b): the halves take turns in being shifted by the other's noise."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(state, i):
        l, r = state["l"], state["r"]
        even = i % 2 == 0
        return F.struct(F.when(even, (l + F.pmod(_noise(key, kind, i, r), a)) % a).otherwise(l).alias("l"),
                        F.when(even, r).otherwise((r + F.pmod(_noise(key, kind, i, l), b)) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits to another of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    a, b = F.pow(F.lit(10), half).cast("long"), F.pow(F.lit(10), rest).cast("long")
    out = feistel(digits.substr(F.lit(1), half).cast("long"), digits.substr(half + 1, rest).cast("long"), a, b, key, kind)
    return F.concat(F.lpad(out["l"].cast("string"), half, "0"), F.lpad(out["r"].cast("string"), rest, "0"))


def _bound(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))
    filled = lambda d: F.aggregate(F.split(form, ""), start, lambda s, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(s["text"], d.substr(s["next"], F.lit(1))).alias("text"), (s["next"] + 1).alias("next"))).otherwise(
        F.struct(F.concat(s["text"], c).alias("text"), s["next"].alias("next"))))
    return _bound(digits, filled)["text"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit being the check digit."""
    places = F.split(F.reverse(digits), "")
    worth = F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """Remainder of a number written in digits and letters (A is 10)."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + c.cast("int")) % 97).otherwise(
        (s * 100 + F.ascii(c) - 55) % 97))


def _longest(m: Column, good) -> Column:
    """The longest run of words at the start of ``m`` that is ``good``; null if none is."""
    words = F.split(m, " ")
    heads = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    return F.get(F.filter(heads, good), F.lit(0))


def _is_number(m):
    letters = m.rlike("^[A-Z]")
    return (letters & _is_iban(m)) | (~letters & _is_card(m))


def valid_numbers(text: Column) -> Column:
    """The card and account numbers of ``text`` that pass their check, from whichever group they begin, longer ones first."""
    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(1))), lambda m: _longest(m, _is_number))
    sized = F.transform(F.array_distinct(F.filter(found, lambda x: x.isNotNull())), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))
    return F.transform(F.array_sort(sized), lambda x: x["x"])


def pattern_of(numbers: Column) -> Column:
    """``ANY`` for a text with these valid numbers."""
    # an empty choice would match everywhere; (?!) matches nowhere
    one_of = lambda test: F.concat(F.lit("(?:"), F.array_join(F.concat(F.filter(numbers, test), F.array(F.lit("(?!)"))), "|"), F.lit(")"))
    card = F.concat(F.lit(r"(?<![\d-])"), one_of(lambda x: ~x.rlike("^[A-Z]")), F.lit(r"(?!-?\d)"))
    iban = F.concat(F.lit(r"\b"), one_of(lambda x: x.rlike("^[A-Z]")), F.lit(r"\b"))
    made = F.replace(F.replace(F.lit(ANY), F.lit("<iban>"), iban), F.lit("<card>"), card)
    return F.when(F.size(numbers) == 0, F.lit(ANY.replace("<iban>", "(?!)").replace("<card>", "(?!)"))).otherwise(made)


def _is_card(m):
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0)


def _card(m, key):
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = digits.substr(F.lit(1), F.length(digits) - 1)
    # the first digit names the kind of card and stays
    new = F.concat(body.substr(1, 1), permute_digits(body.substr(F.lit(2), F.length(body) - 1), key, "card"))
    check = F.pmod(10 - luhn_sum(F.concat(new, F.lit("0"))) % 10, F.lit(10))
    return refill(m, F.concat(new, check.cast("string")))


def _is_iban(m):
    plain = F.regexp_replace(m, " ", "")
    bban = plain.substr(F.lit(5), F.length(plain) - 4)
    return F.length(plain).between(15, 34) & (F.length(F.regexp_replace(bban, "[^0-9]", "")) >= 2) & (mod97(F.concat(bban, plain.substr(1, 4))) == 1)


def _iban(m, key):
    plain = F.regexp_replace(m, " ", "")
    bban = plain.substr(F.lit(5), F.length(plain) - 4)
    digits = F.regexp_replace(bban, "[^0-9]", "")
    new = refill(bban, permute_digits(digits, key, "iban"))
    check = F.lpad((98 - mod97(F.concat(new, plain.substr(1, 2), F.lit("00")))).cast("string"), 2, "0")
    return refill(m, F.concat(check, F.regexp_replace(new, "[^0-9]", "")))


def _month_start(month):
    """Days from the first day to that of a month, counted from it."""
    return F.date_diff(F.add_months(F.lit(FIRST_DAY).cast("date"), month.cast("int")), F.lit(FIRST_DAY).cast("date"))


def _late_day(date, day, key):
    """Another day after the twelfth of its month: such days are numbered without the first twelve of each month."""
    month = (F.year(date) - int(FIRST_DAY[:4])) * 12 + F.month(date) - 1
    at = day - 12 * (month + 1)
    out = feistel(F.floor(at / 9833), at % 9833, 9, 9833, key, "late date")  # 9 * 9833 is LATE_DAYS

    def place(at):
        near = F.transform(F.array(*(F.floor(at * 4800 / LATE_DAYS) + k for k in (1, 0, -1))), lambda m: F.struct(m.alias("m"), (_month_start(m) - 12 * m).alias("at")))
        return at + 12 * (F.get(F.filter(near, lambda x: x["at"] <= at), F.lit(0))["m"] + 1)

    return _bound(_bound(out, lambda x: x["l"] * 9833 + x["r"]), place)


def _date(m, key):
    """A day in the same notation.  With slashes the month is first, unless the first number is over 12; both kinds stay apart."""
    iso_form, dots = m.rlike("^[0-9]{4}"), m.contains(".")
    late = ~iso_form & ~dots & (m.substr(1, 2).cast("int") > 12)
    iso = F.when(iso_form, m).when(dots | late, F.concat_ws("-", m.substr(7, 4), m.substr(4, 2), m.substr(1, 2))).otherwise(
        F.concat_ws("-", m.substr(7, 4), m.substr(1, 2), m.substr(4, 2)))
    number = lambda date: F.date_diff(date, F.lit(FIRST_DAY).cast("date"))
    known = number(iso.try_cast("date")).between(0, CYCLE - 1)

    def moved(date):
        day = number(date)
        out = feistel(F.floor(day / 773), day % 773, 189, 773, key, "date")  # 189 * 773 is the cycle
        return F.when(late, _late_day(date, day, key)).otherwise(_bound(out, lambda x: x["l"] * 773 + x["r"]))

    def shown(n):
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
        return F.when(iso_form, F.date_format(new, "yyyyMMdd")).when(dots | late, F.date_format(new, "ddMMyyyy")).otherwise(F.date_format(new, "MMddyyyy"))

    return known, refill(m, _bound(_bound(iso.try_cast("date"), moved), shown))


def _phone(m, digits, key):
    ten = digits.substr(F.length(digits) - 9, F.lit(10))
    a = (ten.substr(1, 3).cast("long") - 200)
    b = (ten.substr(4, 3).cast("long") - 200) * 10_000 + ten.substr(7, 4).cast("long")
    out = feistel(a, b, 800, 8_000_000, key, "phone")
    exchange = F.floor(out["r"] / 10_000)
    new = F.concat((out["l"] + 200).cast("string"), (exchange + 200).cast("string"), F.lpad((out["r"] % 10_000).cast("string"), 4, "0"))
    return refill(m, F.concat(digits.substr(F.lit(1), F.length(digits) - 10), new))


def _ssn(digits, key, m):
    area, group, serial = digits.substr(1, 3).cast("int"), digits.substr(4, 2).cast("int"), digits.substr(6, 4).cast("int")
    known = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    out = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    new_area = out["l"] + F.when(out["l"] >= 665, 2).otherwise(1)
    new = F.concat(F.lpad(new_area.cast("string"), 3, "0"), F.lpad((F.floor(out["r"] / 9999) + 1).cast("string"), 2, "0"),
                   F.lpad((out["r"] % 9999 + 1).cast("string"), 4, "0"))
    return known, refill(m, new)


def _ip(m, key):
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    known = F.forall(parts, lambda x: x <= 255)
    out = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], 65536, 65536, key, "ip")
    byte = lambda half, high: (F.floor(half / 256) if high else half % 256).cast("string")
    return known, F.concat_ws(".", byte(out["l"], True), byte(out["l"], False), byte(out["r"], True), byte(out["r"], False))


def _digest(value: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value).cast("binary"), 256)


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value) for one match; kind is null where the match fails its check, and value then is the match."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    is_ = {kind: m.rlike(f"^(?:{form})$".replace("(?!<card>)", "")) for kind, form in FORMS if kind not in ("iban", "card")}
    tail = F.regexp_extract(m, r"[A-Za-z0-9_\-+/.]{16,}$", 0)
    hidden = F.repeat(_digest(tail, key, "secret"), 1 + F.floor(F.length(tail) / 64).cast("int")).substr(F.lit(1), F.length(tail))
    ip_known, ip = _ip(m, key)
    date_known, date = _date(m, key)
    ssn_known, ssn = _ssn(digits, key, m)
    rules = (
        ("secret", is_["secret"], F.concat(m.substr(F.lit(1), F.length(m) - F.length(tail)), hidden)),
        ("secret", is_["key"], F.concat(m.substr(1, 4), _digest(m, key, "key").substr(F.lit(1), F.length(m) - 4))),
        ("email", is_["email"], F.concat(F.lit("u"), _digest(F.lower(m), key, "email").substr(1, 16), F.lit("@pseudonym.invalid"))),
        ("ip", is_["ip"] & ip_known, ip),
        ("iban", m.rlike(f"^(?:{_IBAN})$") & _is_iban(m), _iban(m, key)),
        ("date", is_["date"] & date_known, date),
        ("ssn", is_["ssn"] & ssn_known, ssn),
        ("card", m.rlike(f"^(?:{_CARD})$") & _is_card(m), _card(m, key)),
        ("phone", is_["phone"], _phone(m, digits, key)),
        ("phone", is_["intl"] & n.between(8, 15), refill(m, F.concat(digits.substr(1, 2), permute_digits(digits.substr(F.lit(3), n - 2), key, "intl")))),
    )
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    for name, test, new in reversed(rules):
        out = F.when(test, F.struct(F.lit(name).alias("kind"), new.alias("value"))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = "change-me") -> DataFrame:
    """``docs`` with text rewritten, n_found and kinds (sorted, distinct).  Null texts stay null with nothing found.

    All other columns pass; an input column named n_found or kinds is replaced.
    """
    own = [c for c in docs.columns if c not in ("text", "n_found", "kinds")]
    rows = docs.select(F.struct(*own).alias("doc") if own else F.lit(0).alias("doc"), F.col("text").alias("was"), valid_numbers(text_of()).alias("numbers"))
    split = rows.withColumn("any", pattern_of(F.col("numbers"))).withColumn("found", F.regexp_extract_all(text_of("was"), F.col("any"), F.lit(0)))
    swapped = split.withColumn("new", F.transform("found", lambda m: pseudonym(m, key)))
    between = F.split(text_of("was"), F.col("any"), -1)
    pieces = F.zip_with(between, F.transform("new", lambda x: x["value"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    done = F.when(F.size("found") == 0, F.col("was")).otherwise(F.array_join(pieces, ""))
    kinds = F.filter(F.transform("new", lambda x: x["kind"]), lambda k: k.isNotNull())
    # only here do the input's names meet those made on the way
    return swapped.select(*[done.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_found", "kinds")],
                          F.size(kinds).alias("n_found"), F.array_sort(F.array_distinct(kinds)).alias("kinds"))
