"""Format-preserving pseudonyms of personal data, in DataFrame functions alone.

Found and checked values are permuted within their own format under a key by a Feistel network, so that one value has
one pseudonym in all documents, two values never share one, and the key's holder can map back (:func:`restored`). What is found:

* card numbers: 13 to 19 digits that pass Luhn's check; all but the check digit are permuted, the check digit is set anew;
* IBANs that pass the check modulo 97: the digits after the check digits are permuted, the check digits set anew;
* national numbers 123-45-6789 of allotted ranges, permuted among those; telephone numbers: digits permuted, the layout stays;
* IPv4 addresses, each part 0..255: permuted as 32-bit numbers;
* dates (1999-12-31, 31/12/1999, 31.12.1999, 12/31/1999, also with / or . in the first form, and the date of 1999-12-31T23:59):
  valid calendar dates are permuted among the days of a 400-year cycle of the calendar, and written with two digits for day
  and month;
* e-mail addresses: letters and digits of the local part, and of the labels of the domain before its last, are permuted among
  the addresses of the same layout; an address keeps its case, and its pseudonym hangs on the letters alone;
* secrets after a key word (``token = "..."``): digits, the letters a-f and the other letters are permuted within their kind.

A Feistel network on digit strings works on two halves modulo powers of ten; those on days and on national numbers work on two
residues whose moduli multiply to the size of the domain, so no value falls outside the format and none must be walked on. In
addresses and secrets the halves are strings: a round shifts each character of one half within its kind by a keyed stream that
hangs on the other half. ``ROUNDS`` rounds take their numbers from SHA-2 of key, kind, round and the other half. Values of the
same kind and layout form one domain.

The key is ``spark.foretell.pii.key``. Where it is unset, a random one is made and set for the session: pseudonyms are then
linked within the session, and nobody can map them back after it. The key is never part of the source; it is part of the plan,
so a cluster's plan logs must be guarded like the key itself.

Defined cases: null text stays null, empty stays empty; a value found twice (in one text or in repeated rows) gets the
same pseudonym each time; text around the values is not touched. One narrow pass, no shuffle; the whole text is read.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.foretell.pii.key"
ROUNDS = 8
#: Days of the calendar's cycle, and their two factors.
CYCLE, FACTORS = 146_097, (189, 773)
FIRST_DAY = "1800-01-01"
#: Days of the cycle after the 12th of their month: 88,497.
LATE_FACTORS = (9, 9833)
#: National numbers: areas 001-899 without 666, groups 01-99, serials 0001-9999; residues of area and group, and of the serial.
SSN_FACTORS = (898 * 99, 9999)

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+(?<![._%+-])@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}+\.)++[A-Za-z]{2,24}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])"
SSN = r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
IP = r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z.+/-])(?:(?:1[89]|2[01])[0-9]{2}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9A-SU-Za-z]|T(?![0-9]{2}:)|[./-][0-9])|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:1[89]|2[01])[0-9]{2}(?![0-9A-Za-z]|[./-][0-9]))"
PHONE = r"(?<![0-9A-Za-z.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9A-Za-z.])\+[0-9]{8,14}(?![0-9A-Za-z])"
SECRET = r"(?i:(?<=token|secret|password|passwd|api_key|apikey|api-key|access_key)(?:[ ]{0,2}[=:][ ]{0,2}[\"']?))[A-Za-z0-9_+/=-]{16,256}+"
#: In this order: of patterns that match at one place, the first takes it.
PATTERN = "|".join(f"(?:{x})" for x in (EMAIL, SECRET, IBAN, DATE, IP, SSN, CARD, PHONE))
#: A text without these has nothing to find, and is passed on as it is.
HINT = "[0-9@]|(?i:token|secret|passw|key)"


def session_key(spark: SparkSession) -> str:
    """The key of this session; see the head of this file."""
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key


def _let(value: Column, f) -> Column:
    """f(value), value being computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def fill(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced, one by one, by those of ``digits``."""
    letters = F.split(layout, "")
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(digits, s["n"], F.lit(1))).alias("out"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n")))
    return F.aggregate(letters, F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), step)["out"]


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a whole number, check digit included; 0 modulo 10 if it is valid."""
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def valid_card(text: Column) -> Column:
    return _let(digits_of(text), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & ~d.rlike(r"^(.)\1*$"))


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN (no spaces) whose first four characters stand last, letters being 10 to 35."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def valid_iban(text: Column) -> Column:
    return _let(F.replace(text, F.lit(" "), F.lit("")), lambda t: F.length(t).between(15, 34) & (_mod97(t) == 1))


def _day(text: Column) -> Column:
    """The calendar day of a found date; month first if that is the only reading; null if there is none."""
    p = F.split(text, "[-/.]")
    a, b, c = (F.element_at(p, i).cast("int") for i in (1, 2, 3))
    made = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    return F.when(F.length(F.element_at(p, 1)) == 4, made(a, b, c)).otherwise(F.coalesce(made(c, b, a), made(c, a, b)))


def _day_first(text: Column) -> Column:
    p = F.split(text, "[-/.]")
    return F.try_to_date(F.format_string("%04d-%02d-%02d", F.element_at(p, 3).cast("int"), F.element_at(p, 2).cast("int"), F.element_at(p, 1).cast("int")), "yyyy-MM-dd").isNotNull()


def _late_start(k: Column) -> Column:
    """Number of days after the 12th of their month in the k months from FIRST_DAY."""
    return F.datediff(F.add_months(F.to_date(F.lit(FIRST_DAY)), k), F.to_date(F.lit(FIRST_DAY))) - 12 * k


def _late_day(n: Column) -> Column:
    """The n-th day after the 12th of its month."""
    near = F.floor(n / 18.436875).cast("int")
    months = F.filter(F.sequence(F.greatest(near - 2, F.lit(0)), near + 2), lambda k: _late_start(k) <= n)
    return _let(F.array_max(months), lambda k: F.date_add(F.add_months(F.to_date(F.lit(FIRST_DAY)), k), (n - _late_start(k) + 12).cast("int")))


#: First character and number of characters of each kind, with and without the letters a-f apart.
DIGITS, LETTERS, HEX_LETTERS = (("0-9", 48, 10),), (("a-z", 97, 26), ("A-Z", 65, 26)), (("a-f", 97, 6), ("g-z", 103, 20), ("A-F", 65, 6), ("G-Z", 71, 20))


class Pseudonyms:
    """The permutations under one key, or (``inverse``) those that undo them."""

    def __init__(self, key: str, inverse: bool = False):
        self.key, self.sign = key, -1 if inverse else 1
        self.order = [*range(ROUNDS)][:: self.sign]

    def _text(self, *parts: Column) -> Column:
        return F.concat_ws("|", F.lit(self.key), *[p.cast("string") for p in parts])

    def _number(self, *parts: Column) -> Column:
        """A number below 16**15 from the key and the parts."""
        return F.conv(F.substring(F.sha2(self._text(*parts), 256), 1, 15), 16, 10).cast("long")

    def _rounds(self, start: Column, one) -> Column:
        """The network on struct(l, r): ``one(half, other, round)`` is a half's new value. It goes through an aggregate, so that a
        round's result is computed once and then named."""

        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            return F.struct(F.when(even, one("l", s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(one("r", s["r"], s["l"], i)).alias("r"))

        return F.aggregate(F.array(*[F.lit(i) for i in self.order]), start, step)

    def residues(self, left: Column, right: Column, mod_left: Column, mod_right: Column, label: Column) -> Column:
        """struct(l, r): the pair permuted among all pairs of residues; a round adds to one a keyed number that hangs on the other."""
        mod = {"l": mod_left, "r": mod_right}
        start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
        return self._rounds(start, lambda half, own, other, i: F.pmod(own + self.sign * (self._number(label, i, other) % mod[half]), mod[half]).cast("long"))

    def characters(self, text: Column, kind: str, hexadecimal: bool = False) -> Column:
        """The text's letters and digits permuted among the texts of its layout; all other characters stay."""
        kinds = DIGITS + (HEX_LETTERS if hexadecimal else LETTERS)

        def shifted(half: str, own: Column, other: Column, i: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor(F.length(own) / 32).cast("int"))  # a block has 32 numbers of four digits
            stream = F.array_join(F.transform(blocks, lambda b: F.sha2(self._text(F.lit(kind), i, b, F.lower(other)), 512)), "")

            def moved(s: Column, c: Column, at: Column) -> Column:
                n = F.conv(F.substr(s, at * 4 + 1, F.lit(4)), 16, 10).cast("int")
                out = None
                for letters, base, size in kinds:
                    new = F.chr(F.pmod(F.ascii(c) - base + self.sign * n, F.lit(size)) + base)
                    out = F.when(c.rlike(f"^[{letters}]$"), new) if out is None else out.when(c.rlike(f"^[{letters}]$"), new)
                return out.otherwise(c)

            return _let(stream, lambda s: F.array_join(F.transform(F.split(own, ""), lambda c, at: moved(s, c, at)), ""))

        def f(t: Column) -> Column:
            half = F.ceil(F.length(t) / 2).cast("int")
            both = self._rounds(F.struct(F.substr(t, F.lit(1), half).alias("l"), F.substr(t, half + 1).alias("r")), shifted)
            return _let(both, lambda p: F.concat(p["l"], p["r"]))

        return _let(text, f)

    def digits(self, digits: Column, kind: str) -> Column:
        """The digit string (1 to 36 digits) permuted among those of its length."""

        def f(d: Column) -> Column:
            half = F.ceil(F.length(d) / 2).cast("int")
            rest = F.length(d) - half
            ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
            both = self.residues(F.substr(d, F.lit(1), half).cast("long"), F.coalesce(F.substr(d, half + 1).try_cast("long"), F.lit(0)), ten(half), ten(rest), F.concat(F.lit(kind), F.length(d).cast("string")))
            return _let(both, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.when(rest > 0, F.lpad(p["r"].cast("string"), rest, "0")).otherwise(F.lit(""))))

        return _let(digits, f)

    def card(self, text: Column) -> Column:
        def f(d: Column) -> Column:
            body = self.digits(F.substr(d, F.lit(1), F.length(d) - 1), "card")
            return _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

        return fill(text, _let(digits_of(text), f))

    def iban(self, text: Column) -> Column:
        def f(t: Column) -> Column:
            body = F.substr(t, F.lit(5))
            new = fill(body, self.digits(digits_of(body), "iban"))
            return _let(new, lambda b: fill(text, digits_of(F.concat(F.lpad((98 - _mod97(F.concat(F.substr(t, F.lit(1), F.lit(2)), F.lit("00"), b))).cast("string"), 2, "0"), b))))

        return _let(F.replace(text, F.lit(" "), F.lit("")), f)

    def ssn(self, text: Column) -> Column:
        """Among the allotted numbers: area without 000, 666 and 9xx, group without 00, serial without 0000."""
        p = F.split(text, "-")
        area, group, serial = (F.element_at(p, i).cast("long") for i in (1, 2, 3))
        rank = area - F.when(area > 666, 2).otherwise(1)
        both = self.residues(rank * 99 + group - 1, serial - 1, F.lit(SSN_FACTORS[0]), F.lit(SSN_FACTORS[1]), F.lit("ssn"))

        def laid(x: Column) -> Column:
            n = F.floor(x["l"] / 99)
            return F.concat_ws("-", F.lpad((n + F.when(n >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

        return _let(both, laid)

    def ip(self, text: Column) -> Column:
        p = F.split(text, r"\.")
        n = lambda i: F.element_at(p, i).cast("long")
        both = self.residues(n(1) * 256 + n(2), n(3) * 256 + n(4), F.lit(65536), F.lit(65536), F.lit("ip"))
        return _let(both, lambda x: F.concat_ws(".", *[v.cast("long").cast("string") for s in ("l", "r") for v in (F.floor(x[s] / 256), x[s] % 256)]))

    def date(self, text: Column) -> Column:
        """A found date among the dates of its layout. Dates that only read month first (their day is over 12) are permuted
        among themselves, so that none falls on the pseudonym of a date that reads day first."""
        origin = F.to_date(F.lit(FIRST_DAY))
        sep = F.regexp_extract(text, "([-/.])", 1)

        def whole(day: Column) -> Column:
            n = F.datediff(day, origin).cast("long")
            both = self.residues(F.floor(n / FACTORS[1]), n % FACTORS[1], F.lit(FACTORS[0]), F.lit(FACTORS[1]), F.lit("date"))
            return _let(both, lambda x: F.date_add(origin, (x["l"] * FACTORS[1] + x["r"]).cast("int")))

        def late(day: Column) -> Column:
            k = ((F.year(day) - 1800) * 12 + F.month(day) - 1).cast("int")
            n = (_late_start(k) + F.dayofmonth(day) - 13).cast("long")
            both = self.residues(F.floor(n / LATE_FACTORS[1]), n % LATE_FACTORS[1], F.lit(LATE_FACTORS[0]), F.lit(LATE_FACTORS[1]), F.lit("late date"))
            return _let(both, lambda x: _late_day(x["l"] * LATE_FACTORS[1] + x["r"]))

        def laid(d: Column, *order: str) -> Column:
            return F.concat_ws("", *[x for part in order for x in (F.date_format(d, part), sep)][:-1])

        iso = F.length(F.regexp_extract(text, "^([0-9]+)", 1)) == 4
        return F.when(iso, _let(whole(_day(text)), lambda d: laid(d, "yyyy", "MM", "dd"))).when(_day_first(text), _let(whole(_day(text)), lambda d: laid(d, "dd", "MM", "yyyy"))).otherwise(_let(late(_day(text)), lambda d: laid(d, "MM", "dd", "yyyy")))

    def email(self, text: Column) -> Column:
        dot = F.length(text) - F.locate(".", F.reverse(text)) + 1
        return F.when(F.locate("@", text) > 0, F.concat(self.characters(F.substr(text, F.lit(1), dot - 1), "email"), F.substr(text, dot))).otherwise(text)

    def secret(self, text: Column) -> Column:
        """The value after the separator; what stands before it stays."""
        value = F.regexp_replace(F.regexp_extract(text, "[A-Za-z0-9_+/=-]+$", 0), "^[=]+", "")
        return F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(value)), self.characters(value, "secret", True))

    def kinds(self, v: Column) -> list[tuple[str, Column, Column]]:
        """(kind, what a found value of the kind looks like, how it is replaced); the first that fits is taken."""
        return [
            ("email", F.locate("@", v) > 0, self.email(v)),
            ("secret", v.rlike("^[ ]{0,2}[=:]"), self.secret(v)),
            ("iban", v.rlike("^[A-Z]{2}[0-9]{2}") & valid_iban(v), self.iban(v)),
            ("date", v.rlike(r"^(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})$") & _day(v).isNotNull(), self.date(v)),
            ("ip", v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), self.ip(v)),
            ("ssn", v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), self.ssn(v)),
            ("card", v.rlike("^[0-9 -]+$") & valid_card(v), self.card(v)),
            ("phone", v.rlike(f"^(?:{PHONE})$"), fill(v, self.digits(digits_of(v), "phone"))),
        ]

    def replaced(self, v: Column) -> Column:
        """struct(kind, new) of a found value; kind is null where no check holds, and the value stays."""
        chain = None
        for kind, fits, new in self.kinds(v):
            item = F.struct(F.lit(kind).alias("kind"), new.alias("new"))
            chain = F.when(fits, item) if chain is None else chain.when(fits, item)
        return chain.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), v.alias("new")))


def _joined(text: Column, found: Column, new: Column) -> Column:
    """The parts between the found values, and the new values, in turn."""
    parts = F.split(text, PATTERN, -1)
    laid = F.zip_with(parts, new, lambda part, n: F.concat(part, F.coalesce(n["new"], F.lit(""))))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(laid, ""))


def pseudonymise(docs: DataFrame, report: bool = False, key: str | None = None, inverse: bool = False) -> DataFrame:
    """``docs`` with its text pseudonymised, all columns kept; with ``report`` also pii, the (kind, old, new) found."""
    from ._common import free_name

    names = Pseudonyms(key or session_key(docs.sparkSession), inverse)
    found, new = free_name(docs, "_found"), free_name(docs, "_new")
    text = F.col("text").cast("string")
    # Only a text with a hint is searched; a text of which nothing is found is passed on as it is.
    finds = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn(found, finds)
    out = out.withColumn(new, F.transform(found, lambda v: _let(names.replaced(v), lambda r: F.struct(r["kind"].alias("kind"), v.alias("old"), r["new"].alias("new")))))
    out = out.withColumn("text", _joined(text, F.col(found), F.col(new)))
    real = F.filter(new, lambda x: x["kind"].isNotNull())
    return out.withColumn("pii", real).drop(found, new) if report else out.drop(found, new)


def restored(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with the original values in place of pseudonyms made under the same key; dates come back with two digits for
    day and month."""
    return pseudonymise(docs, key=key, inverse=True)
