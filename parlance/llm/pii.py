"""PII: format-preserving pseudonyms for validated numbers and dates, by keyed Feistel permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import feistel, feistel_pair, fresh, permuted

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Blanks in a number, and a digit with what may stand before it: one separator, or a bracket with one.
_BLANK = r"   "
_NEXT = rf"(?:[{_BLANK}./-]|[ -]?\(|\)[ -]?\(?)?[0-9]"
#: The same where a blank only stands before three digits at least: a shorter number behind a blank is another one.
_GROUP = rf"(?:[./-]|[{_BLANK}](?=[0-9]{{3}})|[ -]?\(|\)[ -]?\(?)?[0-9]"
#: The usual digits behind a country code, for codes where one length is usual.
USUAL = {
    11: "55 86",
    10: "1 7 20 30 44 52 57 58 63 81 82 90 91 92 98 234 880 964 977",
    9: "27 33 34 40 41 48 51 56 61 93 94 212 213 254 255 256 351 355 375 380 420 421 593 595 886 966 971 972 992 994 995 996 998",
    8: "45 47 53 65 216 370 371 373 502 503 504 505 506 507 852 853 965 968 973 974",
}
#: The most digits behind other codes; 10 behind those of three digits that aren't named.
MOST = {12: "43 62", 11: "39 49 54", 10: "60 64 84 95", 9: "31 32 36 46 66"}


def _phone_forms() -> str:
    """A plus and a country's number, in the order of trials: the usual length in any grouping; groups of which a
    blank begins none of under three digits, if not two pairs follow; any grouping up to the most digits; digits alone.
    """
    named = [(n, codes.split()) for n, codes in USUAL.items()]
    every = named + [(n, codes.split()) for n, codes in MOST.items()]
    known = [c for _, codes in every for c in codes]
    rest = "(?!" + "|".join(c for c in known if len(c) == 3) + ")[2-9][0-9]{2}"
    zero = r"(?:[ -]?\(0\))?"
    groups = [(n, "|".join(codes)) for n, codes in every] + [(10, rest)]
    forms = [rf"\+(?:{'|'.join(codes)}){zero}(?:{_NEXT}){{{n}}}(?![0-9])" for n, codes in named]
    pairs = rf"[{_BLANK}-][0-9]{{2}}[{_BLANK}-][0-9]{{2}}(?![0-9])"
    forms += [rf"\+(?:{codes}){zero}{_NEXT}(?:{_GROUP}){{6,{n - 1}}}(?![0-9]|{pairs})" for n, codes in groups]
    forms += [rf"\+(?=(?:{_NEXT}){{7}})(?:{codes}){zero}(?:{_NEXT}){{4,{n}}}(?![0-9])" for n, codes in groups]
    return r"(?<![0-9+])(?:" + "|".join(forms) + r"|\+[0-9]{7,15}(?![0-9]))"


#: The country codes of E.164: those of one and two digits, and three digits for all others.
COUNTRY = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
_HEX = "[0-9A-Fa-f]{1,4}"
#: An IPv6 address: eight groups, or fewer about one ``::``.
_IPV6 = rf"(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}"
#: Keys that name their kind by how they begin: what begins them, and what follows.
TOKENS = {"AKIA": "[0-9A-Z]{16}", "gh[opsur]_": "[0-9A-Za-z]{36}", "sk-": "[0-9A-Za-z_-]{20,200}+"}
#: The forms looked for, in the order in which they are tried at a place. All repeats are bounded or start at a run's start.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?![0-9A-Za-z])",
    "token": r"(?<![0-9A-Za-z_-])(?:" + "|".join(k + v for k, v in TOKENS.items()) + r")(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:{_IPV6})(?![0-9A-Za-z:])",
    "ip": rf"(?<![0-9A-Za-z_.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": _phone_forms(),
    "national": r"(?<![0-9()+.-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}-)[2-9][0-9]{2}-[0-9]{4}(?![0-9-])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "dot_date": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])",
    "slash_date": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
}
KINDS = ("email", "secret", "iban", "ip", "phone", "date", "ssn", "card")
#: The days that dates are permuted among.
FIRST_DAY, LAST_DAY, DAYS = "1900-01-01", "2099-12-31", 73_049
_DATES = {"iso_date": "yyyy-MM-dd", "dot_date": "dd.MM.yyyy", "slash_date": "MM/dd/yyyy"}


def bound(value: Column, use) -> Column:
    """``use`` of a value that it has several times: a one-element transform computes it once."""
    return F.transform(F.array(value), use)[0]


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, one after the other, by ``digits``."""

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["i"], 1)).otherwise(c)).alias("out"), (acc["i"] + F.when(is_digit, 1).otherwise(0)).alias("i"))

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda acc: acc["out"])


def permuted_digits(digits: Column, key: str) -> Column:
    """A string of 2 to 34 digits permuted among all strings of its length."""
    n = F.length(digits)
    low = F.call_function("div", n.cast("bigint"), F.lit(2).cast("bigint"))
    a, b = (F.rpad(F.lit("1"), (k + 1).cast("int"), "0").cast("bigint") for k in (low, n - low))
    pair = feistel_pair(digits.substr(F.lit(1), low.cast("int")).cast("bigint"), digits.substr((low + 1).cast("int"), n).cast("bigint"), a, b, key)
    return bound(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), low.cast("int"), "0"), F.lpad(p["r"].cast("string"), (n - low).cast("int"), "0")))


def luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """The Luhn sum of ``digits`` from the right; the last digit counts double if ``first_doubled``."""
    places = F.sequence(F.lit(1), F.length(digits))

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, 1).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((i % 2 == 1) == F.lit(first_doubled), doubled).otherwise(d)

    return F.aggregate(places, F.lit(0), step)


def card(m: Column, key: str) -> Column:
    """All digits but the last are permuted, and the last makes the Luhn sum right again."""
    body = bound(digits_of(m), lambda d: permuted_digits(d.substr(F.lit(1), F.length(d) - 1), f"{key}:card"))
    with_check = bound(body, lambda x: F.concat(x, F.pmod(-luhn_sum(x, True), F.lit(10)).cast("string")))
    return bound(with_check, lambda x: refilled(m, x))


def is_card(m: Column) -> Column:
    return luhn_sum(digits_of(m), False) % 10 == 0


def address(m: Column, key: str) -> Column:
    """An IPv4 address permuted among all 2 ** 32."""
    part = F.split(m, r"\.")
    x = sum((part[i].cast("bigint") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("bigint"))
    new = feistel(x, 65_536, 65_536, f"{key}:ip")
    return bound(new, lambda y: F.concat_ws(".", *[F.pmod(F.shiftright(y, 8 * (3 - i)), F.lit(256)).cast("string") for i in range(4)]))


def groups_of(m: Column) -> Column:
    """The eight groups of an IPv6 address as numbers, the gap filled with zeros; null if they aren't eight."""
    number = lambda g: F.conv(g, 16, 10).cast("int")
    sides = F.transform(F.split(F.lower(m), "::"), lambda s: F.transform(F.split(s, ":"), number))
    whole = bound(sides, lambda s: F.when(F.size(s) == 1, s[0]).when(F.size(s[0]) + F.size(F.get(s, F.lit(1))) < 8, F.concat(s[0], F.array_repeat(F.lit(0), 8 - F.size(s[0]) - F.size(F.get(s, F.lit(1)))), F.get(s, F.lit(1)))))
    return bound(whole, lambda g: F.when(F.size(g) == 8, g))


def address6(m: Column, key: str) -> Column:
    """An IPv6 address permuted among all 2 ** 128, spelled in eight groups: a Feistel network on its halves, 16 bits at a time."""

    def turned(half: Column, other: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(f"{key}:ipv6"), i.cast("string"), F.array_join(other.cast("array<string>"), ":")), 256)
        return bound(digest, lambda d: F.transform(half, lambda x, k: x.bitwiseXOR(F.conv(F.substr(d, 4 * k + 1, F.lit(4)), 16, 10).cast("int"))))

    def step(acc: Column, i: Column) -> Column:
        even = F.struct(turned(acc["l"], acc["r"], i).alias("l"), acc["r"].alias("r"))
        odd = F.struct(acc["l"].alias("l"), turned(acc["r"], acc["l"], i).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = bound(groups_of(m), lambda g: F.struct(F.slice(g, 1, 4).alias("l"), F.slice(g, 5, 4).alias("r")))
    done = F.aggregate(F.array(*[F.lit(i) for i in range(8)]), start, step, lambda acc: F.concat(acc["l"], acc["r"]))
    return F.array_join(F.transform(done, lambda x: F.lower(F.hex(x))), ":")


def rest97(c: Column) -> Column:
    """The rest by 97 of a string of digits and capital letters (10 to 35)."""
    value = lambda x: F.when(x.rlike("[0-9]"), x.try_cast("int")).otherwise(F.ascii(x) - 55)
    return F.aggregate(F.split(c, ""), F.lit(0), lambda acc, x: F.pmod(acc * F.when(x.rlike("[0-9]"), 10).otherwise(100) + value(x), F.lit(97)))


def is_iban(m: Column) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    return bound(bare, lambda b: (F.length(b) <= 34) & (F.length(F.regexp_replace(b.substr(F.lit(5), F.length(b)), "[A-Z]", "")) >= 2) & (rest97(F.concat(b.substr(F.lit(5), F.length(b)), F.substring(b, 1, 4))) == 1))


def iban(m: Column, key: str) -> Column:
    """Country and letters stay, the account's digits are permuted, and the check digits are made right again."""

    def changed(b: Column) -> Column:
        account = b.substr(F.lit(5), F.length(b))
        new = bound(permuted_digits(digits_of(account), f"{key}:iban"), lambda d: refilled(account, d))
        return bound(new, lambda x: F.concat(F.substring(b, 1, 2), F.lpad((98 - rest97(F.concat(x, F.substring(b, 1, 2), F.lit("00")))).cast("string"), 2, "0"), x))

    spaced = lambda x: F.when(m.contains(" "), F.trim(F.regexp_replace(x, "(.{4})", "$1 "))).otherwise(x)
    return bound(bound(F.replace(m, F.lit(" "), F.lit("")), changed), spaced)


#: Possible social security numbers: areas without 000, 666 and 9xx, groups from 01, serials from 0001.
SSNS = 898 * 99 * 9999


def ssn(m: Column, key: str) -> Column:
    """Permuted among all possible numbers."""
    area, group, serial = (F.substring(m, at, n).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    rank = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    div = lambda x, n: F.call_function("div", x, F.lit(n).cast("bigint"))
    area_of = lambda k: bound(k + 1, lambda v: F.when(v > 665, v + 1).otherwise(v))
    return bound(permuted(rank, SSNS, f"{key}:ssn"), lambda y: F.format_string("%03d-%02d-%04d", area_of(div(y, 99 * 9999)), div(y, 9999) % 99 + 1, y % 9999 + 1))


def phone(m: Column, key: str) -> Column:
    """The country code (and a zero in brackets behind it) stays; the digits behind it are permuted, whatever stands between them.

    A national number of ten digits is one of country 1.
    """
    code = lambda d: F.when(~m.startswith("+"), "").when(m.contains("(0)"), F.regexp_extract(d, f"^(?:{COUNTRY})0?", 0)).otherwise(F.regexp_extract(d, f"^(?:{COUNTRY})", 0))
    new = lambda d, c: F.concat(c, permuted_digits(d.substr(F.length(c) + 1, F.length(d)), f"{key}:phone"))
    parts = bound(digits_of(m), lambda d: F.struct(d.alias("d"), code(d).alias("c")))
    return bound(bound(parts, lambda x: new(x["d"], x["c"])), lambda x: refilled(m, x))


def day(m: Column, form: str) -> Column:
    """The day's number, null if the date doesn't exist or lies outside the range."""
    n = F.datediff(F.try_to_date(m, form), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    return F.when((n >= 0) & (n < DAYS), n)


def date(m: Column, form: str, key: str) -> Column:
    """A day permuted among all of 1900 to 2099, in the same form."""
    new = permuted(day(m, form), DAYS, f"{key}:date")
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), form)


def email(m: Column, key: str) -> Column:
    """Not a number: the name becomes letters of a keyed digest, as many as it had and 12 at least, at example.invalid."""
    name = F.regexp_extract(m, "^[^@]+", 0)
    word = F.translate(F.sha2(F.concat_ws(":", F.lit(f"{key}:email"), F.lower(m)), 256), "0123456789", "ghijklmnop")
    return F.concat(word.substr(F.lit(1), F.greatest(F.length(name), F.lit(12))), F.lit("@example.invalid"))


def secret(m: Column, key: str) -> Column:
    """Not a number: as many hex digits of a keyed digest, in the same case."""
    new = F.sha2(F.concat_ws(":", F.lit(f"{key}:secret"), F.lower(m)), 256).substr(F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(new)).otherwise(new)


def token(m: Column, key: str) -> Column:
    """Not a number: what names its kind stays, and as many hex digits of a keyed digest follow."""
    head = F.regexp_extract(m, "^(?:" + "|".join(TOKENS) + ")", 0)
    digests = F.concat(*[F.sha2(F.concat_ws(":", F.lit(f"{key}:token:{k}"), m), 256) for k in range(4)])
    body = digests.substr(F.lit(1), F.length(m) - F.length(head))
    return F.concat(head, F.when(head == "AKIA", F.upper(body)).otherwise(body))


def kind_of(m: Column) -> Column:
    """The kind of a found string (its form, for dates), null if it isn't valid."""
    whole = {k: "^(?:" + p + ")$" for k, p in FORMS.items()}
    out = F.when(m.contains("@"), "email").when(m.rlike(whole["secret"]) & ~m.rlike("^[0-9]+$"), "secret").when(m.rlike(whole["token"]), "token")
    out = out.when(m.rlike(whole["iban"]), F.when(is_iban(m), "iban"))
    out = out.when(m.rlike(whole["ipv6"]), F.when(groups_of(m).isNotNull() & m.rlike("[0-9]") & ((F.regexp_count(m, F.lit("[0-9A-Fa-f]+")) > 2)), "ipv6"))
    out = out.when(m.rlike(whole["ip"]), "ip").when(m.startswith("+") | m.rlike(whole["national"]), "phone")
    for form, how in _DATES.items():
        out = out.when(m.rlike(whole[form]), F.when(day(m, how).isNotNull(), form))
    return out.when(m.rlike(whole["ssn"]), "ssn").otherwise(F.when(is_card(m), "card"))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    how = {"email": email, "secret": secret, "token": token, "iban": iban, "ipv6": address6, "ip": address, "phone": phone, "ssn": ssn, "card": card}
    out = F.when(kind.isNull(), m)
    for name, make in how.items():
        out = out.when(kind == name, make(m, key))
    for form, pattern in _DATES.items():
        out = out.when(kind == form, date(m, pattern, key))
    return out


#: Kinds that are counted under another's name.
_COUNTED = {"token": "secret", "ipv6": "ip", "iso_date": "date", "dot_date": "date", "slash_date": "date"}


def _only(kind: str):
    names = [kind, *[k for k, v in _COUNTED.items() if v == kind]]
    return lambda k: F.when(k.isin(names), k)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", counts: str = "private") -> DataFrame:
    """``docs`` with pseudonyms in the text, and a struct column of counts by kind.

    A phone number is a plus, a country code and as many digits as that country
    has at most, in any grouping, or ten digits as North America writes them. A
    blank and one or two digits behind it belong to it only where the country's
    usual length or a number in pairs asks for them. A card number must have a right Luhn sum, an
    IBAN right check digits, a date must exist (1900 to 2099), an address must
    have four octets or eight groups (about one ``::``), a social security
    number must be possible; others stay as they are, and so do versions
    (octets behind a letter). Each is permuted among
    the values of its format with a Feistel network under ``key``, so that
    equal values, however they are spaced, get equal pseudonyms in all
    documents, and whoever has the key can go back. ``key`` is as secret as
    what it hides. E-mail names, hex secrets and service tokens are no numbers:
    they become keyed digests of the same length.

    All else in a text, and a null or empty text, stays as it is. Where forms
    could meet, the first of FORMS at the first place counts. Very long texts
    are worked on whole, in memory in proportion to their length. Repeated rows
    get equal texts; an empty table gives an empty one. Other columns pass
    through; the new one gets a number if there is one of its name.
    """
    counts, found, kinds, gaps, new = fresh(docs.columns, counts, "found", "kinds", "gaps", "new")
    every = "|".join(FORMS.values())
    text = F.col(f"`{text_col}`")
    may = text.rlike("[0-9@]|[0-9a-fA-F]{32}|gh[opsur]_|sk-")
    matches = F.when(may, F.regexp_extract_all(text, F.lit(every), F.lit(0)))
    out = docs.withColumn(found, matches)
    out = out.withColumn(kinds, F.when(F.size(found) > 0, F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))))
    out = out.withColumn(gaps, F.when(F.col(kinds).isNotNull(), F.split(text, every, -1)))
    fresh_text = F.array_join(F.flatten(F.zip_with(F.col(gaps), F.transform(F.col(kinds), lambda x: pseudonym(x["m"], x["kind"], key)), lambda g, r: F.array(g, F.coalesce(r, F.lit(""))))), "")
    out = out.withColumn(new, F.when(F.col(kinds).isNotNull(), fresh_text).otherwise(text))
    named = F.transform(F.col(kinds), lambda x: x["kind"])
    count = F.struct(*[F.coalesce(F.size(F.array_compact(F.transform(named, _only(k)))), F.lit(0)).cast("bigint").alias(k) for k in KINDS])
    return out.select(*[F.col(new).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], count.alias(counts))


def op3_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """``pseudonymised`` over all documents: id, new text and the counts by kind.

    The key is the session's ``spark.parlance.pii.key``; where there is none,
    one that everybody knows, which hides nothing and is for tests.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymised(docs, spark.conf.get("spark.parlance.pii.key", "known-to-all"))
    return out.select("doc_id", "text", *[F.coalesce(F.col(f"private.{k}"), F.lit(0)).alias(f"n_{k}") for k in KINDS])
