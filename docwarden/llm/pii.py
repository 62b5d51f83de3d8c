"""Personal data as format-preserving pseudonyms, with DataFrame functions only.

Numbers and dates that pass their format's test (Luhn sum, octets, calendar, IBAN check digits, lengths, no zero groups) are permuted within that format by a keyed Feistel
network: a card stays a valid card of the same issuer digit, a date a date, an address an address. A value always maps to the same pseudonym and
different values of a format to different ones, so values stay linked across documents. E-mail addresses and secrets aren't numbers; they become
keyed digests in the same shape.

One pass, no shuffle: a text is split at its findings, and joined again with their pseudonyms. In a text without a digit or @ only
secrets can stand; it is searched if it has one.

Defined results: a null text stays null, an empty one empty, with nothing found; a repeated row gives the same row again; columns beyond doc_id and
text pass through `pseudonymised` unchanged; what fails its format's test is left as it is. A date with
slashes is read day first, and month first only where that is no date; the two orders count as formats of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import let

#: The session's setting that holds the secret key, and the key of tests, where it is unset.
KEY_SETTING, KEY = "spark.docwarden.pseudonym.key", "pseudonym-key-1"
ROUNDS = 8
#: Dates are permuted within DAYS = 250 * 292 days from EPOCH on, and within each further stretch of so many days.
EPOCH, DAYS_A, DAYS_B = "1900-01-01", 250, 292

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|(?i:password|passwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9/+_-]{12,128}|\"[0-9a-f]{40}\")(?![A-Za-z0-9])"
DATE = r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w-])"
ADDRESS = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"
FINDING = "|".join((EMAIL, SECRET, DATE, ADDRESS, IBAN, SOCIAL, PHONE, CARD))


def keyed(key: str, kind: str, *parts: Column) -> Column:
    """A 60-bit keyed number of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b: each round adds a function of one half to the other."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        f = keyed(key, kind, size_a.cast("string"), size_b.cast("string"), i.cast("string"), F.when(even, s["b"]).otherwise(s["a"]).cast("string"))
        return F.struct(F.when(even, F.pmod(s["a"] + F.pmod(f, size_a), size_a)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(f, size_b), size_b)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 34 digits, permuted among those of its length."""

    def run(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        size_a, size_b = power(u), power(n - u)
        pair = feistel(F.substring(d, F.lit(1), u).cast("long"), F.substring(d, u + 1, n).cast("long"), size_a, size_b, key, kind)
        return let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), u, "0"), F.lpad(p["b"].cast("string"), n - u, "0")))

    return let(digits, run)


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def with_digits(shape: Column, digits: Column) -> Column:
    """The shape's digits, from the left, replaced by these."""
    spots = F.sequence(F.lit(1), F.length(shape))
    own = lambda i: F.substring(shape, i, F.lit(1))
    seen = lambda i: F.length(only_digits(F.substring(shape, F.lit(1), i)))
    return F.array_join(F.transform(spots, lambda i: F.when(own(i).between("0", "9"), F.substring(digits, seen(i), F.lit(1))).otherwise(own(i))), "")


def luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """Sum of the digits from the right, every other one doubled (the rightmost if first_doubled)."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda s, i: s + let(F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == (1 if first_doubled else 0), 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)),
    )


def card(s: Column, key: str) -> Column:
    """Issuer digit kept, the digits up to the check digit permuted, the check digit made anew. Null if the Luhn sum fails."""

    def run(d: Column) -> Column:
        body = let(F.concat(F.substring(d, 1, 1), permuted_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card")), lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, True) % 10, F.lit(10)).cast("string")))
        return F.when((luhn_sum(d, False) % 10 == 0) & ~d.rlike("^0+$"), with_digits(s, body))

    return let(only_digits(s), run)


def address(s: Column, key: str) -> Column:
    """The 32 bits permuted. Null if an octet is over 255."""

    def run(o: Column) -> Column:
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "address")
        half = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), F.pmod(x, F.lit(256)).cast("string"))
        return F.when(F.array_max(o) < 256, let(pair, lambda p: F.concat(half(p["a"]), F.lit("."), half(p["b"]))))

    return let(F.split(s, r"\.").cast("array<int>"), run)


def date(s: Column, key: str) -> Column:
    """Another day of the same stretch of days, written the same way. Null if it is no date."""
    parts = F.split(s, "[./-]")
    sign = F.regexp_extract(s, "[./-]", 0)

    def run(p: Column) -> Column:
        of = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        read = F.when(F.length(p[0]) == 4, F.struct(of(p[0], p[1], p[2]).alias("d"), F.lit(False).alias("month_first")))
        day_first, month_first = of(p[2], p[1], p[0]), F.when(sign == "/", of(p[2], p[0], p[1]))
        return let(read.otherwise(F.struct(F.coalesce(day_first, month_first).alias("d"), day_first.isNull().alias("month_first"))), lambda x: moved(x["d"], x["month_first"]))

    def moved(d: Column, month_first: Column) -> Column:
        offset = F.datediff(d, F.lit(EPOCH).cast("date")).cast("long")
        days = DAYS_A * DAYS_B
        pair = feistel(F.floor(F.pmod(offset, F.lit(days)) / DAYS_B), F.pmod(F.pmod(offset, F.lit(days)), F.lit(DAYS_B)), F.lit(DAYS_A).cast("long"), F.lit(DAYS_B).cast("long"), key, "date")
        new = let(pair, lambda q: F.date_add(F.lit(EPOCH).cast("date"), (F.floor(offset / days) * days + q["a"] * DAYS_B + q["b"]).cast("int")))
        wide = lambda n: F.when(F.length(F.regexp_extract(s, r"^\d+", 0)) == 2, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        year = lambda x: F.lpad(F.year(x).cast("string"), 4, "0")
        year_last = lambda x: F.concat(F.when(month_first, wide(F.month(x))).otherwise(wide(F.day(x))), sign, F.when(month_first, two(F.day(x))).otherwise(two(F.month(x))), sign, year(x))
        return F.when(d.isNotNull(), let(new, lambda x: F.when(F.length(parts[0]) == 4, F.concat(year(x), sign, two(F.month(x)), sign, two(F.day(x)))).otherwise(year_last(x))))

    return let(parts, run)


def social(s: Column, key: str) -> Column:
    """Areas 001 to 999, groups 01 to 99 and serials 0001 to 9999 permuted among themselves. Null where one of them is zero, which none is given."""
    groups, serials = 99, 9999

    def run(p: Column) -> Column:
        pair = feistel(p[0] - 1, (p[1] - 1) * serials + p[2] - 1, F.lit(999).cast("long"), F.lit(groups * serials).cast("long"), key, "social")
        wide = lambda n, k: F.lpad(n.cast("string"), k, "0")
        new = let(pair, lambda q: F.concat_ws("-", wide(q["a"] + 1, 3), wide(F.floor(q["b"] / serials) + 1, 2), wide(F.pmod(q["b"], F.lit(serials)) + 1, 4)))
        return F.when(F.array_min(p) > 0, new)

    return let(F.split(s, "-").cast("array<int>"), run)


def phone(s: Column, key: str) -> Column:
    """Country code and punctuation kept, the other digits permuted. Null if it has no 7 to 15 digits, or none but 0 beyond the country code."""
    code = F.regexp_extract(s, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(s, F.length(code) + 1, F.length(s))
    fits = F.length(only_digits(s)).between(7, 15) & rest.rlike("[1-9]")
    return F.when(fits, F.concat(code, let(rest, lambda r: with_digits(r, permuted_digits(only_digits(r), key, "phone")))))


def iban(s: Column, key: str) -> Column:
    """Country and letters kept, the account's digits permuted, the check digits made anew. Null if length or check digits are no IBAN's."""

    def run(c: Column) -> Column:
        digits = only_digits(F.substring(c, F.lit(5), F.length(c)))
        changed = lambda d: F.concat(F.substring(c, 1, 4), F.substring(with_digits(c, F.concat(F.lit("00"), d)), F.lit(5), F.length(c)))
        body = let(permuted_digits(digits, key, "iban"), lambda d: with_digits(s, F.concat(iban_check(changed(d)), d)))
        return F.when(F.length(c).between(15, 34) & (F.length(digits) >= 2) & (F.substring(c, 3, 2) == iban_check(c)), body)

    return let(F.regexp_replace(s, " ", ""), run)


def iban_check(c: Column) -> Column:
    """The check digits of an IBAN without spaces: 98 less the rest by 97 of account, country and 00, letters as 10 to 35."""
    moved = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 2), F.lit("00"))
    value = lambda x: F.when(x.between("0", "9"), x.cast("int")).otherwise(F.ascii(x) - 55)
    rest = let(moved, lambda m: F.aggregate(F.sequence(F.lit(1), F.length(m)), F.lit(0), lambda r, i: let(value(F.substring(m, i, F.lit(1))), lambda v: F.pmod(r * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def email(s: Column, key: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(s)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 12), F.lit("@m"), F.substring(digest, 13, 8), F.lit(".example.com"))


def secret(s: Column, key: str) -> Column:
    """The name before = or : and any quotes kept, the rest a keyed digest of the same length and alphabet."""
    head = F.regexp_extract(s, r"^(AKIA|ghp_|sk-|[A-Za-z_-]+[\"']?\s*[=:]\s*[\"']?|\")", 1)
    body = F.regexp_extract(F.substring(s, F.length(head) + 1, F.length(s)), "^[A-Za-z0-9/+_-]*", 0)
    tail = F.substring(s, F.length(head) + F.length(body) + 1, F.length(s))
    digest = F.concat(F.sha2(F.concat(F.lit(f"{key}|secret|"), body), 256), F.sha2(F.concat(F.lit(f"{key}|secret2|"), body), 256))
    short = F.substring(digest, F.lit(1), F.length(body))
    return F.concat(head, F.when(head == "AKIA", F.upper(short)).otherwise(short), tail)


def pseudonym(s: Column, key: str = KEY) -> Column:
    """(kind, text) of one finding; null where it fails its format's test."""
    whole = lambda p: s.rlike(f"^(?:{p})$")
    named = lambda kind, text: F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("text")))
    return (
        F.when(s.contains("@"), named("email", email(s, key)))
        .when(whole(SECRET), named("secret", secret(s, key)))
        .when(whole(DATE), named("date", date(s, key)))
        .when(whole(ADDRESS), named("address", address(s, key)))
        .when(whole(IBAN), named("iban", iban(s, key)))
        .when(whole(SOCIAL), named("social", social(s, key)))
        .when(whole(PHONE), named("phone", phone(s, key)))
        .when(whole(CARD), named("card", card(s, key)))
    )


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The documents with pseudonyms in text, and n_replaced and kinds (distinct, sorted, comma-joined) after their own columns; columns of the
    input with these two names give way to them. The key is the session's KEY_SETTING unless given."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    kept = [c for c in docs.columns if c.lower() not in ("n_replaced", "kinds")]
    done_name = next(f"done{k}" for k in range(len(kept) + 1) if f"done{k}" not in {c.lower() for c in kept})
    text = F.col("text").cast("string")

    def run(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(FINDING), F.lit(0))
        return let(F.struct(F.split(t, FINDING, -1).alias("gaps"), F.transform(found, lambda s: F.struct(s.alias("old"), pseudonym(s, key).alias("new"))).alias("found")), joined)

    def joined(x: Column) -> Column:
        texts = F.transform(x["found"], lambda f: F.coalesce(f["new"]["text"], f["old"]))
        kinds = F.filter(F.transform(x["found"], lambda f: f["new"]["kind"]), lambda k: k.isNotNull())
        return F.struct(
            F.array_join(F.flatten(F.zip_with(x["gaps"], texts, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "").alias("text"),
            F.size(kinds).cast("long").alias("n"),
            F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"),
        )

    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"), F.lit("").alias("kinds"))
    done = F.when(text.rlike("[0-9@]") | text.rlike(SECRET), let(text, run)).otherwise(same)
    # The array keeps the pseudonyms from being worked out once for each column that is taken from them.
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in kept]
    rows = docs.select(*quoted, F.explode(F.array(done)).alias(done_name))
    return rows.select(*[F.col(f"{done_name}.text").alias("text") if c == "text" else q for c, q in zip(kept, quoted)], F.col(f"{done_name}.n").alias("n_replaced"), F.col(f"{done_name}.kinds").alias("kinds"))
