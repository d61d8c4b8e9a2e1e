"""Format-preserving pseudonyms for personal data, by a keyed Feistel network over symbols.

Values are found by one pattern, validated by kind, and permuted within their kind's format:

* card numbers of 13 to 19 digits that pass the Luhn check: all digits but the first and the last are permuted,
  the last is computed anew, so the result passes too;
* telephone numbers: the last ten digits (for other countries, all after the country code);
* social security numbers of valid ranges; IPv4 addresses; calendar dates from 1900-01-01 to 2099-11-13, which
  go to another date of that span in the same notation;
* the local part of e-mail addresses: digits, lower-case and upper-case letters keep their class;
* keys and tokens behind a naming word, of any length: digits, a-f, g-z, A-F and G-Z keep their class, so what is
  hexadecimal stays so and nothing else becomes so.

A network of ten rounds adds, in turn, a keyed hash of one half to each symbol of the other half, modulo the
symbol's radix; a single symbol is taken as a pair of smaller ones. That is a permutation of the format, and the same
for all documents: equal values get equal pseudonyms and different values of a kind different ones, as a value's
classes, and with them its format, are those of its pseudonym. So links between documents survive. Only values count,
not notation: a number with and without blanks gets the same digits. Without the key it can't be turned back.

All of it is built-in expressions; a text without a digit or ``@`` is passed on unread.

Defined results: null stays null, empty stays empty, both with n_found 0; what fails its validation stays as it
is; repeated rows get equal results; other columns pass through (but text, and n_found, are new); an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The notations that are looked for, in order of precedence.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
NAMED = r"(?<=(?i:token|secret|passwd|password|api[_-]?key)[\s\"']{0,3}[=:][\s\"']{0,3})"
SECRET = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]){NAMED}[A-Za-z0-9+/_-]{{16,}}+"
AWS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
SLASH_DATE = r"(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+?1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.-])(?:\+?1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\w+])\+[1-9]\d{7,14}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,12}){1,4}(?!\d)|(?<![\w+.-])[2-9]\d{2}[2-9]\d{6}(?![\w-])"
#: The country codes of a number without blanks.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
CARD = r"(?<![\w-])\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}(?![\d-])|(?<![\w-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\d-])|(?<![\w-])\d{4}[ -]\d{6}[ -]\d{5}(?![\d-])"
#: One pattern; what no kind may stand behind, and what numbers start with, is asked once for all of them.
NUMBER = "|".join((ISO_DATE, IPV4, SSN, PHONE, CARD, SLASH_DATE))
ANY = rf"(?<![A-Za-z0-9])(?:{EMAIL}|{SECRET}|{AWS_KEY}|(?=[0-9+(])(?:{NUMBER}))|(?<=[A-Za-z])(?=[0-9])(?:{ISO_DATE}|{SLASH_DATE})"
#: Stands around found values while a text is taken apart.
MARK = "\u0001"


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(values: Column, radices: Column, kind, key: str) -> Column:
    """A keyed permutation of an int array, each element below its radix; kind: a name or a column of names."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    half = F.floor(F.size(values) / 2).cast("int")
    cut = lambda a, first: F.slice(a, F.lit(1), half) if first else F.slice(a, half + 1, F.size(values) - half)

    def mixed(x: Column, y: Column, radix: Column, r: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), kind, r.cast("string"), F.array_join(F.transform(y, lambda v: v.cast("string")), ","))
        return let(
            seed,
            lambda s: F.transform(
                x,
                lambda v, i: F.pmod(
                    v + F.conv(F.substring(F.sha2(F.concat_ws("|", s, i.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long"),
                    F.element_at(radix, i + 1).cast("long"),
                ).cast("int"),
            ),
        )

    start = F.struct(cut(values, True).alias("a"), cut(values, False).alias("b"))
    step = lambda s, r: F.when(
        r % 2 == 0, F.struct(mixed(s["a"], s["b"], cut(radices, True), r).alias("a"), s["b"].alias("b"))
    ).otherwise(F.struct(s["a"].alias("a"), mixed(s["b"], s["a"], cut(radices, False), r).alias("b")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def permuted(values: Column, radices: Column, kind, key: str) -> Column:
    """feistel(), also for arrays of one element with an even radix: that is permuted as its half and its remainder."""
    lone = F.size(values) == 1
    pair = lambda x, by: F.array(F.floor(F.element_at(x, 1) / 2).cast("int"), by)
    several = F.when(lone, pair(values, F.element_at(values, 1) % 2)).otherwise(values)
    limits = F.when(lone, pair(radices, F.lit(2))).otherwise(radices)
    return let(let(F.struct(several.alias("v"), limits.alias("r")), lambda x: feistel(x["v"], x["r"], kind, key)), lambda p: F.when(lone, F.array(p[0] * 2 + p[1])).otherwise(p))


def permuted_text(text: Column, alphabet, kind, key: str) -> Column:
    """text with each character permuted in the alphabet that alphabet(character, number) gives; "" keeps it.

    Only characters with an alphabet enter the network, so a kept one never makes a half of it idle.
    """
    chars = F.split(text, "")

    def filled(s: Column, at: Column) -> Column:
        moved = F.transform(at, lambda i: F.element_at(s, i))
        numbers = F.transform(moved, lambda x: F.instr(x["set"], x["c"]) - 1)
        new = permuted(numbers, F.transform(moved, lambda x: F.length(x["set"])), kind, key)
        place = lambda i: F.array_position(at, i + 1).cast("int")
        put = lambda v: F.transform(s, lambda x, i: F.when(x["set"] == "", x["c"]).otherwise(F.substring(x["set"], F.get(v, place(i) - 1) + 1, F.lit(1))))
        return F.array_join(let(new, put), "")

    def network(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: F.element_at(s, i)["set"] != "")
        return let(at, lambda a: F.when(F.size(a) > 0, filled(s, a)).otherwise(text))

    return let(F.transform(chars, lambda c, i: F.struct(c.alias("c"), alphabet(c, i).alias("set"))), network)


def classes(*alphabets: str):
    """Each character in the one of the alphabets that has it."""

    def of(c: Column, i: Column) -> Column:
        found = F.lit("")
        for a in alphabets:
            found = F.when(F.lit(a).contains(c), F.lit(a)).otherwise(found)
        return found

    return of


NAMES, KEYS = classes(DIGITS, LOWER, UPPER), classes(DIGITS, LOWER[:6], LOWER[6:], UPPER[:6], UPPER[6:])


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refilled(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order, its other characters kept."""
    return F.array_join(
        F.transform(
            F.split(m, ""),
            lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(digits_of(F.substring(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c),
        ),
        "",
    )


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits whose last one counts single."""
    return F.aggregate(
        F.transform(
            F.reverse(F.split(digits, "")),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    number = F.array(area - 1 - (area > 666).cast("int"), group - 1, serial - 1)
    new = lambda v: F.concat_ws(
        "-",
        F.lpad((v[0] + 1 + (v[0] >= 665).cast("int")).cast("string"), 3, "0"),
        F.lpad((v[1] + 1).cast("string"), 2, "0"),
        F.lpad((v[2] + 1).cast("string"), 4, "0"),
    )
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, let(feistel(number, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key), new))


def ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(feistel(octets, F.array_repeat(F.lit(256), 4), "ipv4", key), lambda x: x.cast("string")), ".")


def date(m: Column, key: str) -> Column:
    """Dates as day numbers of a span of 250 * 292 days."""
    first = F.lit("1900-01-01").cast("date")
    iso = m.contains("-")
    parts = F.split(m, "/")
    day_first = F.concat_ws("-", F.element_at(parts, -1), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
    month_first = F.concat_ws("-", F.element_at(parts, -1), F.lpad(F.get(parts, F.lit(0)), 2, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"))
    as_date = lambda s: F.try_to_date(s, "yyyy-MM-dd")

    def new(d: Column) -> Column:
        number = F.datediff(d, first)
        pair = F.array(F.floor(number / 292).cast("int"), (number % 292).cast("int"))
        return let(feistel(pair, F.array(F.lit(250), F.lit(292)), "date", key), lambda v: F.date_add(first, v[0] * 292 + v[1]))

    def shown(d: Column, by_day: Column) -> Column:
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(by_day, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))

    by_day = as_date(day_first).isNotNull()
    found = F.when(iso, as_date(m)).when(by_day, as_date(day_first)).otherwise(as_date(month_first))
    return let(found, lambda d: F.when(F.datediff(d, first).between(0, 250 * 292 - 1), let(new(d), lambda n: shown(n, by_day))))


def alphabet_of(kind: Column, skip: Column):
    """By kind: names and keys by classes, numbers and access keys in one alphabet; the first `skip` characters are kept."""
    return lambda c, i: F.when(i < skip, "").when(kind.isin("phone", "card"), DIGITS).when(kind == "key", UPPER + DIGITS).when(kind == "email", NAMES(c, i)).otherwise(KEYS(c, i))


def in_place(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of an e-mail address, key, token, card or telephone number; null if its digits are not valid."""

    def new(d: Column) -> Column:
        valid = F.when(kind == "phone", F.length(d).between(8, 15)).otherwise(F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & (F.regexp_replace(d, "0", "") != ""))
        country = F.when(m.rlike(r"^\+\d+$"), F.length(F.regexp_extract(m, COUNTRY, 1))).when(m.startswith("+") & ~m.rlike(r"^\+1(?!\d)"), F.length(F.regexp_extract(m, r"^\+(\d+)", 1))).otherwise(F.length(d) - 10)
        part = F.when(kind == "email", F.substring_index(m, "@", 1)).when(kind == "phone", d).when(kind == "card", F.substring(d, F.lit(1), F.length(d) - 1)).otherwise(m)
        skip = F.when(kind == "phone", country).when(kind == "card", 1).when(kind == "key", 4).otherwise(0)
        last = lambda p: F.pmod(10 - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")
        made = let(F.struct(part.alias("p"), skip.alias("s")), lambda x: permuted_text(x["p"], alphabet_of(kind, x["s"]), kind, key))
        whole = lambda p: F.when(kind == "card", F.concat(p, last(p))).otherwise(p)
        shown = lambda p: F.when(kind.isin("phone", "card"), refilled(m, p)).when(kind == "email", F.concat(p, F.substring(m, F.length(p) + 1, F.length(m)))).otherwise(p)
        return F.when(kind.isin("phone", "card") & ~valid, None).otherwise(let(let(made, whole), shown))

    return let(digits_of(m), new)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a found value, or null if it isn't valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    kind = F.when(m.contains("@"), "email").when(whole(AWS_KEY), "key").when(whole(f"{ISO_DATE}|{SLASH_DATE}"), "date").when(whole(IPV4), "ipv4")
    kind = kind.when(whole(SSN), "ssn").when(whole(PHONE), "phone").when(whole(CARD), "card").otherwise("secret")
    return let(kind, lambda k: F.when(k == "date", date(m, key)).when(k == "ipv4", ipv4(m, key)).when(k == "ssn", ssn(m, key)).otherwise(in_place(m, k, key)))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text pseudonymised and n_found, the number of values that were replaced, after the other columns."""
    names = [c for c in docs.columns if c not in ("text", "n_found")]
    some = F.col("text").rlike("[0-9@]")
    # The pattern is searched once; only a text with the mark in it needs two searches.
    once = F.split(F.regexp_replace("text", ANY, f"{MARK}$0{MARK}"), MARK, -1)
    twice = let(
        F.struct(F.split("text", ANY, -1).alias("a"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("b")),
        lambda x: F.flatten(F.transform(x["a"], lambda a, i: F.when(i < F.size(x["b"]), F.array(a, F.get(x["b"], i))).otherwise(F.array(a)))),
    )
    cut = docs.select(*names, "text", F.when(some, F.when(F.col("text").contains(MARK), twice).otherwise(once)).alias("__pii_cut"))
    found = F.when(F.size("__pii_cut") > 1, F.transform("__pii_cut", lambda m, i: F.struct(m.alias("old"), F.when(i % 2 == 1, pseudonym(m, key)).alias("new"))))
    new = cut.select(*names, "text", found.alias("__pii_new"))
    joined = F.array_join(F.transform("__pii_new", lambda x: F.coalesce(x["new"], x["old"])), "")
    count = F.size(F.filter("__pii_new", lambda x: x["new"].isNotNull()))
    return new.select(*names, F.coalesce(joined, F.col("text")).alias("text"), F.when(F.col("__pii_new").isNull(), 0).otherwise(count).alias("n_found"))
