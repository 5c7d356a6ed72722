"""Personal data to format-preserving pseudonyms (DataFrame functions only).

Numbers and dates that hold up to validation go through a keyed Feistel permutation of
their own format: card numbers keep a right check digit, account numbers their country
and right check digits, dates stay dates, addresses of hosts stay such, phone numbers
keep country code and punctuation.  A permutation never merges two values, and equal
values get equal pseudonyms in all documents.  Mail addresses, which are no numbers,
get a keyed hash as their name.  Where a number holds more groups than a card, the groups
that look like a card and validate are the card, whatever stands before or after them; an
account number ends at the end of the longest group that validates; what is left on either
side is looked at anew.  A number without a card is moved among the numbers of its form
without one, so the inverse gives it back, and a card that stands alone.  (A card among other
groups may, rarely, make another one with them after it was moved; then the inverse differs.)

Dates are yyyy-MM-dd (also before a time, as in 2024-05-01T10:00; the time stays), dd.MM.yyyy,
MM/dd/yyyy, and dd/MM/yyyy where the day is above 12.  Days from 1900 to August 2099 stay
within these years, all others among all other days.  Dates in other forms (one-digit days
or months, two-digit years, names of months) are not looked for.

Defined cases: a null text stays null, an empty one empty, with no finds; text outside
finds is untouched; matches that fail validation (no such date in the years 1 to 9999, host number above 255,
wrong account check digits) stay as they are, but a long number with a wrong card check
digit is permuted as a plain number; repeated rows get equal results; an empty table
gives an empty table; other columns are passed on, except that ``finds`` is replaced.
"""

from pyspark.sql import functions as F

#: Places of an account number by country.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# The formats that are looked for.
_ALONE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
#: Account numbers as long as their country has them, then any others.
_IBANS = [f"(?:{names.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, names in IBAN_CHARS.items()]
_IBANS += [r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"]
FORMATS = {
    # Without giving anything back: the depth of the search stays the same however long a run is.
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ip": r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)",
    "date": _ALONE + r"(?:\d{4}-\d{2}-\d{2}(?=T\d)|(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})" + _END + ")",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "iban": _ALONE + f"(?:{'|'.join(_IBANS)})" + _END,
    "number": r"(?<![\p{L}\p{N}-])\d(?:[ -]?\d){12,33}" + _END,
    "phone": r"(?<![\p{L}\p{N}+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}[.-]\d{3}[.-]\d{4})" + _END,
}
ANY = "|".join(FORMATS.values())
# How card numbers begin and are set in groups.
_ISSUER = r"(?:4\d{3}|5[1-5]\d{2}|2(?:2[2-9]|[3-6]\d|7[01])\d|3[47]\d{2}|3(?:0[0-5]|[68]\d)\d|35\d{2}|6(?:011|5\d{2}|2\d{2}|4[4-9]\d))"
_GROUPED = r"(?:\d{9,15}|([ -])\d{4}\1\d{4}\1\d{1,7}|[ -]\d{6}[ -]\d{4,5})"
CARD_LIKE, GROUPED_LIKE_CARDS = rf"^{_ISSUER}{_GROUPED}$", rf"^\d{{4}}{_GROUPED}$"
KINDS = ("email", "ip", "date", "ssn", "iban", "card", "number", "phone")
#: How text goes on after a match where the end of that match may belong to the next one.
_GOES_ON = r"^(?:[-./@_%+\d]|[ -][\dA-Z])"
ROUNDS = 8
#: Days from FIRST_DAY on that dates are permuted in: a square number.
FIRST_DAY, DAY_ROOT = "1900-01-01", 270
#: All other days of the years 1 to 9999 are permuted among themselves: their first day, their number and a root that covers it.
EARLIEST_DAY, OTHER_DAYS, OTHER_ROOT = "0001-01-01", 3_652_059 - DAY_ROOT * DAY_ROOT, 1892
#: Slash dates are read with the month first; with the day first only if it is above 12.
DAY_FIRST = "dd/MM/yyyy"
DATE_PATTERNS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", DAY_FIRST)
#: Turns after which a permuted day that stays outside the wanted ones is out of the question (less than half stay each time).
TURNS = 200


def _let(value, use):
    return F.transform(F.array(value), use)[0]


def feistel(left, right, left_size, right_size, key, tweak, inverse=False):
    """The pair permuted within [0, left_size) x [0, right_size): struct (l, r)."""
    sign = -1 if inverse else 1

    def turn(i, x, size):
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")).cast("binary"), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 14), 16, 10).cast("long"), size)

    def step(s, i):
        even = i % 2 == 0
        moved_l = F.pmod(s["l"] + sign * turn(i, s["r"], left_size), left_size)
        moved_r = F.pmod(s["r"] + sign * turn(i, s["l"], right_size), right_size)
        return F.struct(F.when(even, moved_l).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved_r).alias("r"))

    rounds = F.array(*map(F.lit, reversed(range(ROUNDS)) if inverse else range(ROUNDS)))
    return F.aggregate(rounds, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _ten(n):
    return F.pow(F.lit(10), n).cast("long")


def permuted_digits(digits, key, tweak, inverse=False):
    """A digit string of 2 to 34 places permuted among the strings of its length."""
    half = (F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    moved = feistel(digits.substr(F.lit(1), half), digits.substr(half + 1, rest), _ten(half), _ten(rest), key, F.concat_ws("/", F.lit(tweak), F.length(digits).cast("string")), inverse)
    return _let(moved, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), rest, "0")))


def _only_digits(text):
    return F.regexp_replace(text, r"\D", "")


def _put_back(form, digits):
    """The form with its digits replaced in order."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(s, c):
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, digits.substr(s["next"], F.lit(1))).otherwise(c)).alias("out"),
            (s["next"] + F.when(is_digit, 1).otherwise(0)).alias("next"),
        )

    return F.aggregate(chars, start, step, lambda s: s["out"])


def luhn_sum(digits):
    """Check sum of a card number; every second digit from the right, the last not among them, doubled."""
    places = F.sequence(F.lit(1), F.length(digits))

    def part(total, k):
        d = digits.substr(k, F.lit(1)).cast("int")
        twice = d * 2
        doubled = F.when(twice > 9, twice - 9).otherwise(twice)
        return total + F.when((F.length(digits) - k) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(places, F.lit(0), part)


def _card(digits, key, inverse):
    """All but the check digit permuted, and the check digit that goes with it."""
    body = permuted_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card", inverse)
    return _let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


def mod_97(text):
    """Remainder of an account number written with its first four places last, letters as 10 to 35."""
    chars = F.filter(F.split(F.concat(text.substr(F.lit(5), F.length(text)), text.substr(F.lit(1), F.lit(4))), ""), lambda c: c != "")

    def step(r, c):
        digit = c.rlike("^[0-9]$")
        value = F.when(digit, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (r * F.when(digit, 10).otherwise(100) + value) % 97

    return F.aggregate(chars, F.lit(0), step)


def _iban(form, key, inverse):
    """Country and letters stay; the digits after the check digits are permuted and the check digits made right."""
    plain = F.regexp_replace(form, " ", "")
    body = plain.substr(F.lit(5), F.length(plain))
    moved = F.when(F.length(_only_digits(body)) >= 2, _put_back(body, permuted_digits(_only_digits(body), key, "iban", inverse))).otherwise(body)
    country = plain.substr(F.lit(1), F.lit(2))
    check = lambda b: F.lpad((98 - mod_97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0")
    return _let(moved, lambda b: _put_back(form, _only_digits(F.concat(check(b), b))))


def _ip(form, key, inverse):
    part = F.split(form, r"\.")
    number = lambda a, b: F.get(part, F.lit(a)).cast("int") * 256 + F.get(part, F.lit(b)).cast("int")
    size = F.lit(65536)
    moved = feistel(number(0, 1), number(2, 3), size, size, key, F.lit("ip"), inverse)
    byte = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    return _let(moved, lambda s: F.concat_ws(".", *byte(s["l"]), *byte(s["r"])))


def _date(form, pattern, key, inverse):
    """The day moved within its range of days; null where the form is no date."""
    day = F.try_to_timestamp(form, F.lit(pattern)).cast("date")
    date = lambda text: F.lit(text).cast("date")
    inner = DAY_ROOT * DAY_ROOT
    before = F.datediff(date(FIRST_DAY), date(EARLIEST_DAY))

    def moved(n, size, root, tweak, as_day):
        """Permuted until it falls on a day that the pattern can hold, which keeps the permutation one to one."""

        def turn(x):
            return _let(feistel(F.floor(x / root), x % root, F.lit(root), F.lit(root), key, F.lit(tweak), inverse), lambda s: s["l"] * root + s["r"])

        fits = lambda x: (x < size) & (F.dayofmonth(as_day(x)) > 12 if pattern == DAY_FIRST else F.lit(True))
        again = F.sequence(F.lit(1), F.lit(TURNS))
        return as_day(_let(turn(n), lambda first: F.when(fits(first), first).otherwise(F.aggregate(again, first, lambda x, _: F.when(fits(x), x).otherwise(turn(x))))))

    inside = lambda x: F.date_add(date(FIRST_DAY), x.cast("int"))
    outside = lambda x: F.date_add(date(EARLIEST_DAY), (x + F.when(x < before, 0).otherwise(inner)).cast("int"))
    n = F.datediff(day, date(FIRST_DAY)).cast("long")
    # The other days in order, without the inner ones.
    other = n + before - F.when(n < 0, 0).otherwise(inner)
    new = F.when(n.between(0, inner - 1), moved(n, inner, DAY_ROOT, "date", inside)).otherwise(moved(other, OTHER_DAYS, OTHER_ROOT, "other date", outside))
    return F.when((F.date_format(day, pattern) == form) & (n + before >= 0), F.date_format(new, pattern))


def _phone(form, key, inverse):
    country = F.regexp_extract(form, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = form.substr(F.length(country) + 1, F.length(form))
    return F.concat(country, _put_back(rest, permuted_digits(_only_digits(rest), key, "phone", inverse)))


def pseudonym(form, key, inverse=False):
    """struct (kind, value) for one match; kind null where it does not hold up.

    ``inverse`` gives the value back (mail addresses cannot be given back).
    """
    digits = _only_digits(form)
    is_kind = lambda kind: form.rlike(f"^(?:{FORMATS[kind]})$")
    dated = F.coalesce(*[_date(form, p, key, inverse) for p in DATE_PATTERNS])
    mail = F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(form)).cast("binary"), 256), 1, 16), F.lit("@example.invalid"))
    octets = F.forall(F.split(form, r"\."), lambda o: F.length(o).between(1, 3) & (F.concat(F.lit("0"), _only_digits(o)).cast("int") <= 255))
    pick = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    none = F.struct(F.lit(None).cast("string").alias("kind"), form.alias("value"))
    plain = _put_back(form, permuted_digits(digits, key, "number", inverse))
    number = _plain_number(form, key, inverse)
    return (
        F.when(form.contains("@"), pick("email", mail))
        .when(is_kind("ip"), F.when(octets, pick("ip", _ip(form, key, inverse))).otherwise(none))
        .when(is_kind("date"), _let(dated, lambda d: F.when(d.isNotNull(), pick("date", d)).otherwise(none)))
        .when(is_kind("ssn"), pick("ssn", plain))
        .when(is_kind("iban"), F.when(mod_97(F.regexp_replace(form, " ", "")) == 1, pick("iban", _iban(form, key, inverse))).otherwise(none))
        .when(is_kind("number"), F.when(_is_card(digits), pick("card", _put_back(form, _card(digits, key, inverse)))).otherwise(pick("number", number)))
        .otherwise(pick("phone", _phone(form, key, inverse)))
    )


def _is_card(digits):
    return F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0)


def best_card(form):
    """struct (score, from, size) of the card among whole groups of a number; null without one.

    Every start and end of a group is tried.  A card that begins as issuers do and is set in
    groups like one (score 3) counts before one only set so (2), and that before digits from
    the start of the number that validate by themselves (1); then the first, the longest.  (Groups
    before a card that by chance make another card with part of it are taken for one.)
    """
    places = F.sequence(F.lit(1), F.length(form))
    is_gap = lambda p: form.substr(p, F.lit(1)).isin(" ", "-")
    starts = F.filter(places, lambda p: (p == 1) | is_gap(p - 1))
    ends = F.filter(places, lambda p: (p == F.length(form)) | is_gap(p + 1))

    def window(start, end):
        part = form.substr(start, end - start + 1)
        score = F.when(part.rlike(CARD_LIKE), 3).when(part.rlike(GROUPED_LIKE_CARDS), 2).when(start == 1, 1)
        valid = _let(_only_digits(part), _is_card)
        return F.struct(F.when(valid, score).alias("score"), (-start).alias("first"), (end - start + 1).alias("size"))

    of_start = lambda s: F.transform(F.filter(ends, lambda e: (e - s).between(12, 36)), lambda e: window(s, e))
    found = F.array_max(F.filter(F.flatten(F.transform(starts, of_start)), lambda w: w["score"].isNotNull()))
    return F.when(found.isNotNull(), F.struct(found["score"].alias("score"), (-found["first"]).alias("from"), found["size"].alias("size")))


def _plain_number(form, key, inverse):
    """The digits permuted among the numbers of this form that hold no card, so that none is read as one later."""
    turn = lambda f: _put_back(f, permuted_digits(_only_digits(f), key, "number", inverse))
    fits = lambda f: best_card(f).isNull()
    again = F.sequence(F.lit(1), F.lit(TURNS))
    return _let(turn(form), lambda first: F.when(fits(first), first).otherwise(F.aggregate(again, first, lambda x, _: F.when(fits(x), x).otherwise(turn(x)))))


def _kept(form):
    """struct (from, size) of the part of a match that is the value, where it is not the whole match; else null.

    A number: the card in it (``best_card``).  An account number: the longest part from the
    start to the end of a group that holds up.
    """
    groups = F.filter(F.sequence(F.lit(1), F.length(form) - 1), lambda p: form.substr(p + 1, F.lit(1)).isin(" ", "-"))
    account = lambda f: _let(F.regexp_replace(f, " ", ""), lambda x: (F.length(x) >= 15) & (mod_97(x) == 1))
    place = lambda start, size: F.when(size.isNotNull() & (size < F.length(form)), F.struct(start.alias("from"), size.alias("size")))
    longest = F.when(~account(form), F.array_max(F.filter(groups, lambda p: account(form.substr(F.lit(1), p)))))
    return F.when(form.rlike(f"^(?:{FORMATS['iban']})$"), place(F.lit(1), longest)).when(
        form.rlike(f"^(?:{FORMATS['number']})$"), _let(best_card(form), lambda c: place(c["from"], c["size"]))
    )


def _matches(text):
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _around(form, kept, mark):
    """The match with a mark before the kept part, unless it begins the match, and one after it."""
    head = F.when(kept["from"] > 1, F.concat(form.substr(F.lit(1), kept["from"] - 1), mark)).otherwise("")
    return head, form.substr(kept["from"], kept["size"]), mark, form.substr(kept["from"] + kept["size"], F.length(form))


def segments(text):
    """The text cut where a match goes on after a value that holds up, so that what follows is looked at anew."""

    def cut(s):
        def at(parts):
            # Cuts up to the first whose rest may be the start of another value; from there on the text is matched again.
            again = F.array_min(F.transform(F.filter(parts, lambda p: p["kept"].isNotNull() & p["goes_on"]), lambda p: p["k"]))
            return _let(again, lambda k0: joined(parts, k0))

        def joined(parts, k0):
            mark = F.sha2(s["open"], 256)
            part = lambda p: F.when(
                p["kept"].isNotNull() & (k0.isNull() | (p["k"] <= k0)),
                F.concat(p["before"], *_around(p["form"], p["kept"], mark)),
            ).otherwise(F.concat(p["before"], p["form"]))
            pieces = F.split(F.array_join(F.transform(parts, part), ""), mark, -1)
            return _let(pieces, lambda x: F.when(k0.isNull(), state(F.concat(s["done"], x), F.lit(None).cast("string"))).otherwise(
                state(F.concat(s["done"], F.slice(x, F.lit(1), F.size(x) - 1)), F.element_at(x, -1))
            ))

        found = F.struct(_matches(s["open"]).alias("forms"), F.split(s["open"], ANY, -1).alias("gaps"))
        parts = lambda f: F.transform(f["gaps"], lambda gap, k: _let(F.coalesce(F.get(f["forms"], k), F.lit("")), lambda form: F.struct(
            k.alias("k"), gap.alias("before"), form.alias("form"), _kept(form).alias("kept"), F.coalesce(F.get(f["gaps"], k + 1).rlike(_GOES_ON), F.lit(False)).alias("goes_on")
        )))
        return _let(found, lambda f: _let(parts(f), at))

    def state(done, rest):
        return F.struct(done.alias("done"), rest.alias("open"))

    most = F.sequence(F.lit(0), F.floor(F.length(text) / 13).cast("int"))
    ends = F.aggregate(most, state(F.array().cast("array<string>"), text), lambda s, _: F.when(s["open"].isNull(), s).otherwise(cut(s)))
    return _let(ends, lambda s: F.concat(s["done"], F.when(s["open"].isNull(), F.array().cast("array<string>")).otherwise(F.array(s["open"]))))


def with_pseudonyms(docs, key, text="text", inverse=False):
    """The rows with ``text`` rewritten and ``finds``, the kinds found in order."""
    found = F.when(F.col(text).rlike("[0-9@]"), _matches(F.col(text)))
    rows = docs.drop("finds").withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    cut = F.when(F.exists("_found", lambda m: _kept(m).isNotNull()), segments(F.col(text))).otherwise(F.array(text))
    rows = rows.withColumn("_parts", F.when(F.size("_found") > 0, cut))
    rows = rows.withColumn("_new", F.transform("_parts", lambda part: F.transform(_matches(part), lambda m: pseudonym(m, key, inverse))))
    # The pieces between the matches and the new values in turn.
    put = lambda part, new: F.array_join(F.zip_with(F.split(part, ANY, -1), new, lambda a, b: F.concat(a, F.coalesce(b["value"], F.lit("")))), "")
    rows = rows.withColumn(text, F.when(F.col("_new").isNull(), F.col(text)).otherwise(F.array_join(F.zip_with("_parts", "_new", put), "")))
    kinds = F.filter(F.transform(F.flatten("_new"), lambda x: x["kind"]), lambda k: k.isNotNull())
    return rows.withColumn("finds", F.coalesce(kinds, F.array().cast("array<string>"))).drop("_found", "_parts", "_new")
