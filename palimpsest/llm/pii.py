"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations; DataFrame functions only.

Found values are validated (Luhn for cards, mod 97 for IBANs, octets for IPv4, the calendar for dates, the ranges of
social security numbers) and permuted within their format: every digit stays a digit, every letter a letter of its case, the check
digits hold again, a date stays a date of its format. The permutation depends on the key and the kind alone, so equal
values have equal pseudonyms in all documents, and different values of a kind different ones. Phones, addresses and days
count as equal when they are the same number, address or day in other writings; days written dd/MM that can't be MM/dd
are permuted among themselves, as both look alike.

kinds: email (local part), secret (what follows the name of a password, token or key, and tokens told by their own
first letters), ipv4, date, phone (three, three and four digits in
any common writing, and numbers that begin with + and a country's code), card, iban, ssn.

Edge cases: null text stays null with no finds; empty text stays empty; a value that fails its validation stays as it
is; a secret may have any length; after names other than `password=` and `token = "`, `secret = "`, `api_key = "` it must
have a digit, or prose would count; repeated rows are rewritten alike; columns of docs with the names of results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8  # even: both halves are back in their places

# The formats looked for.
_PASSWORD, _TOKEN = "(?i:password=)", '(?i:(?:token|secret|api_key) = ")'
_NAMES = "(?:pass(?:word|wd|phrase|code)|pwd|secret(?:[_-]?key)?|(?:api|access|private|client|auth)[_-]?(?:key|token|secret)|(?:auth|bearer)?[_-]?token)"
_NAMED = rf"(?<![A-Za-z])(?=[PpSsAaCcTtBb])(?=(?i:{_NAMES}))(?!(?<!\w){_PASSWORD}[^\s\"'<>]{{4}}|(?<!\w){_TOKEN}[^\s\"]{{8}})(?i:{_NAMES})[\"']?\s{{0,2}}(?:=>|[:=])\s{{0,2}}"
_KNOWN = "A[KS]IA|gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-|eyJ"
_PHONE = r"(?:\+\d{0,3}|1)?[ .-]?\(?\d{3}(?:\)[ .-]?|[ .-])\d{3}[ .-]\d{4}"
_WORLD_PHONE = r"\+(?:\d[ .()/-]{0,2}){7,14}\d"
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": rf"\bA[KS]IA[A-Z0-9]{{16}}\b|\b(?:gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-)[\w-]{{16,}}|\beyJ[\w-]{{8,}}\.[\w-]{{8,}}\.[\w-]{{8,}}|{_NAMED}(?:\"(?=[^\"\n]*\d)[^\"\n]{{6,}}\"|'(?=[^'\n]*\d)[^'\n]{{6,}}'|(?=[^\s\"'<>]*\d)[^\s\"'<>]{{6,}})|(?<=\b{_PASSWORD})[^\s\"'<>]{{4,}}|(?<=\b{_TOKEN})[^\s\"]{{8,}}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv4": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![./-]?\d)",
    "phone": rf"(?<![\d-]){_PHONE}(?!-?\d)|(?<![\d+-]){_WORLD_PHONE}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)",
    "card": r"(?<![\dA-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\dA-Za-z])",
}
_ORDER = ["secret", "email", "iban", "ipv4", "date", "phone", "ssn", "card"]
#: The one group, of the card pattern, has this number in all patterns together.
PATTERN = "|".join(PATTERNS[k] for k in _ORDER)
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_HEX = "0123456789abcdef"
_DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"]
_FIRST_DAY, _DAYS, _DAY_A, _DAY_B = "1900-01-01", 73049, 319, 229  # 1900 to 2099; 319 * 229 = 73051


def _hash(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half), 256)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _shifted(chars: Column, stream: Column, alphabets: list[str]) -> Column:
    """Each character moved within its alphabet by its byte of the hash; others stay."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = F.lit(None).cast("string")
        for a in alphabets:
            at = F.instr(F.lit(a), c)
            out = F.coalesce(out, F.when((c != "") & (at > 0), F.substring(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))) + 1, F.lit(1))))
        return F.coalesce(out, c)

    return F.transform(chars, one)


def permuted(value: Column, key: str, kind: str, alphabets: list[str] = _ALPHABETS) -> Column:
    """A Feistel permutation of the characters of value, each within its alphabet."""
    chars = _chars(value)
    half = F.floor(F.size(chars) / 2).cast("int")
    start = F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.size(chars)).alias("b"))

    def turn(acc: Column, k: Column) -> Column:
        return F.struct(acc["b"].alias("a"), _shifted(acc["a"], _hash(key, kind, k, F.array_join(acc["b"], "")), alphabets).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(F.array_join(acc["a"], ""), F.array_join(acc["b"], "")))


def permuted_number(x: Column, key: str, kind: str, a: int, b: int) -> Column:
    """A permutation of 0 .. a * b - 1: halves modulo a and b take turns in moving each other."""
    by = lambda k, half: F.conv(F.substring(_hash(key, kind, k, half.cast("string")), 1, 12), 16, 10).cast("long")
    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def turn(acc: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["l"] + by(k, acc["r"]), F.lit(a))).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + by(k, acc["l"]), F.lit(b))).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: acc["l"] * b + acc["r"])


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(s: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("int"))


def luhn_sum(s: Column) -> Column:
    """The Luhn sum of the digits of s, modulo 10; 0 for a valid number."""
    return F.aggregate(F.transform(F.reverse(_digits(s)), lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))), F.lit(0), lambda t, d: t + d) % 10


def mod97(s: Column) -> Column:
    """IBAN remainder of letters and digits, letters as 10 to 35."""
    value = lambda c: F.instr(F.lit(_ALPHABETS[0] + _ALPHABETS[2]), c) - 1
    return F.aggregate(_chars(s), F.lit(0), lambda t, c: F.when(value(c) > 9, (t * 100 + value(c)) % 97).otherwise((t * 10 + value(c)) % 97))


def _in_place(template: Column, digits: Column) -> Column:
    """template with its digits and letters replaced, in order, by those of `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        mine = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(acc["out"], F.when(mine, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + mine.cast("int")).alias("at"))

    return F.aggregate(_chars(template), start, step, lambda acc: acc["out"])


def _card(v: Column, key: str) -> Column:
    plain = F.regexp_replace(v, "[^0-9]", "")
    body = permuted(F.substring(plain, F.lit(1), F.length(plain) - 1), key, "card")
    return F.when(luhn_sum(v) == 0, _in_place(v, F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))))


def _iban(v: Column, key: str) -> Column:
    plain = F.regexp_replace(v, " ", "")
    land, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    body = permuted(rest, key, "iban")
    check = F.lpad((98 - mod97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0")
    return F.when((F.length(plain) >= 15) & (mod97(F.concat(rest, land, F.substring(plain, 3, 2))) == 1), _in_place(v, F.concat(land, check, body)))


def _ipv4(v: Column, key: str) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda t, o: t * 256 + o)
    new = permuted_number(number, key, "ipv4", 65536, 65536)

    def written(n: Column) -> Column:
        octet = lambda k: F.pmod(F.shiftright(n, 24 - 8 * k), F.lit(256)).cast("int").cast("string")
        padded = lambda old, new: F.when(old.rlike("^0.") & (F.length(new) < F.length(old)), F.lpad(new, F.length(old), F.lit("0"))).otherwise(new)
        return F.array_join(F.zip_with(F.split(v, r"\."), F.array(*[octet(k) for k in range(4)]), padded), ".")

    return F.when(F.forall(octets, lambda o: o <= 255), _bound(new, written))


def _date(v: Column, key: str) -> Column:
    first = F.lit(_FIRST_DAY).cast("date")

    def one(form: str) -> Column:
        day = F.try_to_timestamp(v, F.lit(form)).cast("date")
        x = F.datediff(day, first).cast("long")
        late = lambda n: (n < _DAYS) & (F.dayofmonth(F.date_add(first, n.cast("int"))) > 12)
        fits, steps = (late, 60) if form == "dd/MM/yyyy" else (lambda n: n < _DAYS, 3)  # of 73051 numbers two are no day, and 0.61 a late day

        turn = lambda n: permuted_number(n, key, "date", _DAY_A, _DAY_B)
        # Permuted until it is a day of its kind again: a permutation of those days.
        new = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), turn(x), lambda n, _: F.when(fits(n), n).otherwise(turn(n)))
        return F.when((x >= 0) & (x < _DAYS), F.date_format(F.date_add(first, new.cast("int")), form))

    shapes = [r"^\d{4}-", r"^\d{4}/", r"^\d{2}\.", r"^\d{2}/", r"^\d{2}/"]
    return F.coalesce(*[F.when(v.rlike(s), one(f)) for s, f in zip(shapes, _DATE_FORMATS)])


def _phone(v: Column, key: str) -> Column:
    """Which permutation a number has depends on its digits alone, so that it has one pseudonym in all its writings.

    Ten digits, or 1 and ten: the first digits of area code and exchange stay, so that the number stays one; the other
    eight are permuted. Of numbers of other countries the first digit stays.
    """
    plain = F.regexp_replace(v, "[^0-9]", "")
    lead = F.length(plain) - 10
    at = lambda i, n: F.substring(plain, lead + i, F.lit(n))
    new = permuted(F.concat(at(2, 2), at(5, 6)), key, "phone")
    ten = F.concat(F.substring(plain, F.lit(1), lead), at(1, 1), F.substring(new, 1, 2), at(4, 1), F.substring(new, 3, 6))
    world = F.concat(F.substring(plain, 1, 1), permuted(F.substring(plain, F.lit(2), F.length(plain)), key, "phone"))
    return _in_place(v, F.when(~v.startswith("+") | plain.rlike(r"^1\d{10}$"), ten).otherwise(world))


def _ssn(v: Column, key: str) -> Column:
    good = ~v.rlike(r"^(000|666|9)") & ~v.rlike(r"-00-") & ~v.rlike(r"-0000$")
    return F.when(good, _in_place(v, permuted(F.regexp_replace(v, "-", ""), key, "ssn")))


def _secret(v: Column, key: str, known: str = f"^(?:{_KNOWN})") -> Column:
    """The first letters that tell a kind of token stay; of a name and its value only what stands in the quotes goes."""
    def rewritten(lead: Column) -> Column:
        close = F.when(lead.rlike("[\"']$"), F.right(v, F.lit(1))).otherwise(F.lit(""))
        rest = F.substring(v, F.length(lead) + 1, F.length(v) - F.length(lead) - F.length(close))
        return F.concat(lead, _bound(rest, lambda x: F.when(x.rlike("^[0-9a-f]+$"), permuted(x, key, "secret", [_HEX])).otherwise(permuted(x, key, "secret"))), close)

    return _bound(F.regexp_extract(v, known, 0), rewritten)


def _email(v: Column, key: str) -> Column:
    return F.concat(permuted(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1))


_REWRITE = {"email": _email, "secret": _secret, "iban": _iban, "ipv4": _ipv4, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}
#: Shapes that tell the kind of a found value, in the order they are asked.
_SHAPES = [("email", "@"), ("ipv4", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), ("date", r"^(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[./]\d{2}[./]\d{4})$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("iban", r"^[A-Z]{2}\d{2}[A-Z0-9 ]{11,}$"), ("card", r"^(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})$"), ("phone", rf"^(?:{_PHONE}|{_WORLD_PHONE})$")]


def pseudonym(v: Column, key: str, secret: Column) -> Column:
    """The pseudonym of a found value, or the value itself where it isn't valid; a secret may look like any kind.

    secret: whether the name of a secret stands before the value, which is then a secret whatever it looks like.
    """
    out = reduce(lambda rest, x: F.when(v.rlike(x[1]), _REWRITE[x[0]](v, key)).otherwise(rest), reversed(_SHAPES), _secret(v, key))
    out = F.when(v.rlike(f"^{_NAMED}"), _secret(v, key, f"^{_NAMED}[\"']?")).otherwise(F.coalesce(out, v))
    return F.when(secret, _secret(v, key, "^$")).otherwise(out)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_pseudonyms") -> DataFrame:
    """docs with pseudonyms in text_col, and in count_col how many values were rewritten.

    Only texts with a digit, @ or the name of a secret are searched; only their found values go through the permutations.
    """
    text = F.col(f"`{text_col}`").cast("string")
    found, parts = "values of the text", "text between the values"
    searched = text.rlike(f"[0-9@]|{_KNOWN}|{_PASSWORD}|{_TOKEN}")
    docs = docs.withColumn(found, F.when(searched, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    docs = docs.withColumn(parts, F.when(F.size(found) > 0, F.split(text, PATTERN, -1)))
    secret = lambda i: F.right(F.get(F.col(f"`{parts}`"), i), F.lit(12)).rlike(rf"\b(?:{_PASSWORD}|{_TOKEN})$")
    new = F.transform(F.col(f"`{found}`"), lambda v, i: pseudonym(v, key, secret(i)))
    docs = docs.withColumn(found, F.when(F.size(found) > 0, F.zip_with(F.col(f"`{found}`"), new, lambda a, b: F.struct(a.alias("old"), b.alias("new")))))
    joined = F.array_join(F.zip_with(F.col(f"`{parts}`"), F.col(f"`{found}`"), lambda p, v: F.concat(p, F.coalesce(v["new"], F.lit("")))), "")
    out = docs.withColumn(text_col, F.when(F.col(f"`{parts}`").isNull(), text).otherwise(joined))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.size(F.filter(F.col(f"`{found}`"), lambda v: v["old"] != v["new"])), F.lit(0)).cast("long"))
        out = out.withColumn(count_col, F.greatest(F.lit(0).cast("long"), F.col(count_col)))
    return out.drop(found, parts)
