"""Format-preserving Feistel pseudonyms for personal data, in Spark expressions only.

Values are found by pattern and validated (card numbers by the Luhn sum, addresses by octet range,
dates by calendar, phone numbers by numbering plan). A value is read as two numbers A and B of
fixed ranges and goes through a keyed Feistel network whose rounds add a SHA-256 of the other half,
alternately A += f(B) mod |A| and B += f(A) mod |B|. That is a permutation of the value's own
format, so a pseudonym is again a valid value of the kind, differs for different values, and is
the same for equal values in any document. Punctuation stays as it was written.

  card    13 to 19 digits, or groups of 4-4-4-4 or 4-6-5 digits, that pass the Luhn sum; all digits
          but the last are permuted and the last is made to fit
  phone   North American numbers with or without +1; area and exchange keep a first digit of 2 to 9;
          after +1 also numbers outside that plan, which stay outside: all ten digits are permuted within
          area below 200, or exchange alone below 200
  ip      IPv4; the four octets
  date    yyyy-mm-dd, a real day of 1800 to 2199; day numbers of the 400-year cycle (146097 = 773 x 189)
  intl    + and a country code of two digits (kept) with 8 to 13 digits; those after the code
  ssn     ddd-dd-dddd of the assigned ranges (area 001 to 899 but 666, group and serial not 0), within them
  iban    that pass the sum mod 97; letters and digits after the check digits, which are made to fit
  email   letters and digits before the @ and of all the host's labels but the last, each within its
          class (a-z, A-Z, 0-9)
  secret  hexadecimal digits of token, password, secret or key assignments in either case, and the body
          of AKIA keys; upper-case digits after an upper-case word and lower-case ones after any other
          are moved among all sixteen, bodies of other case within 0-9, a-f and A-F

Edge cases: null text stays null, empty text empty; texts without a value are returned as they are;
values that fail validation stay; a repeated value in one text is replaced each time alike; rows,
order of columns and all other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groupsight.llm.common import fresh

ROUNDS = 8
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SECRET = r"(?i:token|password|secret|passwd|api_key)\s?[=:]\s?\"?[0-9a-fA-F]{8,64}\b|\bAKIA[0-9A-Z]{16}\b"
#: In the order in which a match is read; one pattern finds all.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": _SECRET,
    "date": r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
    "phone": r"(?<![\d+])(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}|(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2})[ .-]\d{4}(?!\d)",
    "intl": r"(?<![\d+])\+[2-9]\d(?:[ .-]?\d){8,13}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\d]|-\d)",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A cheap necessary condition: without one of these a text has no value.
HINT = r"@[A-Za-z0-9-]|\d{3}|\d\.\d|(?:\d[ -]){3}|[=:]\s?\"?[0-9a-fA-F]{8}|AKIA[0-9A-Z]{16}|\+[2-9]\d|[A-Z]{2}\d{2}"


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once: a lambda's argument is bound, a plain expression is repeated wherever it is used."""
    return F.transform(F.array(value), use)[0]


def _hash_mod(key: str, kind: str, i: Column, x: Column, m: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), m)


def feistel(key: str, kind: str, a: Column, size_a: Column, b: Column, size_b: Column, undo: bool = False) -> Column:
    """struct(a, b): the pair permuted within 0..size_a-1 and 0..size_b-1; undo gives it back."""
    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if undo else 1

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        next_a = F.pmod(acc["a"] + sign * _hash_mod(key, kind, i, acc["b"], size_a), size_a)
        next_b = F.pmod(acc["b"] + sign * _hash_mod(key, kind, i, acc["a"], size_b), size_b)
        return F.struct(F.when(even, next_a).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(next_b).alias("b"))

    start = F.struct(F.coalesce(a, F.lit(0)).cast("long").alias("a"), F.coalesce(b, F.lit(0)).cast("long").alias("b"))
    return F.aggregate(steps, start, step)


def _power(base: int, n: Column) -> Column:
    return F.pow(F.lit(float(base)), n).cast("long")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""

    def total(t: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = _number(t.substr(F.length(t) - i, F.lit(1)))
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return acc + F.when(i % 2 == 1, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), F.length(t) - 1), F.lit(0).cast("long"), add)

    return let(digits, total)


def _fill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those of `digits`."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def filled(d: Column) -> Column:
        def put(acc: Column, c: Column) -> Column:
            is_digit = c.rlike("^[0-9]$")
            return F.struct(
                F.concat(acc["s"], F.when(is_digit, d.substr(acc["k"], F.lit(1))).otherwise(c)).alias("s"),
                (acc["k"] + is_digit.cast("int")).alias("k"),
            )

        return F.aggregate(F.split(shape, ""), start, put)["s"]

    return let(digits, filled)


def _card(v: Column, key: str, undo: bool) -> Column:
    def permuted(digits: Column) -> Column:
        body = _digits(digits.substr(F.lit(1), F.length(digits) - 1), "card", key, undo)
        return let(body, lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    digits = F.regexp_replace(v, "[^0-9]", "")
    return let(digits, lambda d: F.when(luhn_sum(d) % 10 == 0, _fill(v, permuted(d))))


def _phone(v: Column, key: str, undo: bool) -> Column:
    prefix = F.regexp_extract(v, r"^\+1[ .-]?", 0)
    rest = v.substr(F.length(prefix) + 1, F.length(v))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    area, line = _number(digits.substr(F.lit(1), F.lit(3))), _number(digits.substr(F.lit(4), F.lit(7)))

    def permuted(given: Column) -> Column:
        low_area, low_line = given["a"] < 200, given["b"] < 2_000_000
        # first and number of the areas and lines that are like the given ones
        a0, a_n = F.when(low_area, 0).otherwise(200), F.when(low_area, 200).otherwise(800).cast("long")
        b0 = F.when(low_area | low_line, 0).otherwise(2_000_000)
        b_n = F.when(low_area, 10_000_000).when(low_line, 2_000_000).otherwise(8_000_000).cast("long")
        two = feistel(key, "phone", given["a"] - a0, a_n, given["b"] - b0, b_n, undo)
        return let(two, lambda x: F.concat(F.lpad((x["a"] + a0).cast("string"), 3, "0"), F.lpad((x["b"] + b0).cast("string"), 7, "0")))

    return F.concat(prefix, _fill(rest, let(F.struct(area.alias("a"), line.alias("b")), permuted)))


def _digits(digits: Column, kind: str, key: str, undo: bool) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    left = F.floor(F.length(digits) / 2).cast("int")
    right = F.length(digits) - left
    two = feistel(key, kind, _number(digits.substr(F.lit(1), left)), _power(10, left), _number(digits.substr(left + 1, right)), _power(10, right), undo)
    return let(two, lambda x: F.concat(F.lpad(x["a"].cast("string"), left, "0"), F.lpad(x["b"].cast("string"), right, "0")))


def _intl(v: Column, key: str, undo: bool) -> Column:
    rest = v.substr(F.lit(4), F.length(v))
    return F.concat(v.substr(F.lit(1), F.lit(3)), _fill(rest, _digits(F.regexp_replace(rest, "[^0-9]", ""), "intl", key, undo)))


def _ssn(v: Column, key: str, undo: bool) -> Column:
    area, group, serial = (_number(v.substr(F.lit(a), F.lit(n))) for a, n in ((1, 3), (5, 2), (8, 4)))
    # 898 areas: 1 to 899 without 666
    a, b = area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1

    def written(x: Column) -> Column:
        new = x["a"] + 1
        parts = ((new + (new >= 666).cast("long"), 3), (F.floor(x["b"] / 9999).cast("long") + 1, 2), (x["b"] % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(c.cast("string"), n, "0") for c, n in parts])

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, let(feistel(key, "ssn", a, F.lit(898).cast("long"), b, F.lit(99 * 9999).cast("long"), undo), written))


def mod97(text: Column) -> Column:
    """The number that letters (A is 10) and digits spell, mod 97."""

    def add(acc: Column, c: Column) -> Column:
        n = F.instr(F.lit(_DIGITS + _UPPER), c).cast("long") - 1
        return F.pmod(acc * F.when(n > 9, 100).otherwise(10) + n, F.lit(97).cast("long"))

    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), add)


def _iban(v: Column, key: str, undo: bool) -> Column:
    country, rest = v.substr(F.lit(1), F.lit(2)), v.substr(F.lit(5), F.length(v))
    compact = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    fits = mod97(F.concat(compact(rest), country, v.substr(F.lit(3), F.lit(2)))) == 1
    moved = _by_class(rest, "iban", key, undo, [_UPPER, _DIGITS])
    check = lambda x: F.lpad((98 - mod97(F.concat(compact(x), country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(fits, let(moved, lambda x: F.concat(country, check(x), x)))


def _ip(v: Column, key: str, undo: bool) -> Column:
    full = F.lit(65536).cast("long")

    def dotted(two: Column) -> Column:
        octets = [F.floor(two["a"] / 256), two["a"] % 256, F.floor(two["b"] / 256), two["b"] % 256]
        return F.concat_ws(".", *[x.cast("long").cast("string") for x in octets])

    def permuted(p: Column) -> Column:
        two = feistel(key, "ip", p[0] * 256 + p[1], full, p[2] * 256 + p[3], full, undo)
        return F.when(F.forall(p, lambda x: x <= 255), let(two, dotted))

    return let(F.transform(F.split(v, r"\."), _number), permuted)


def _date(v: Column, key: str, undo: bool) -> Column:
    start = F.lit("1800-01-01").cast("date")

    def permuted(day: Column) -> Column:
        two = feistel(key, "date", F.floor(day / 189).cast("long"), F.lit(773).cast("long"), day % 189, F.lit(189).cast("long"), undo)
        moved = let(two, lambda x: F.date_format(F.date_add(start, (x["a"] * 189 + x["b"]).cast("int")), "yyyy-MM-dd"))
        return F.when(day.between(0, 146096), moved)

    return let(F.datediff(F.try_to_date(v, "yyyy-MM-dd"), start).cast("long"), permuted)


def _by_class(part: Column, kind: str, key: str, undo: bool, alphabets: list[str]) -> Column:
    """Each character of `part` that is in an alphabet is moved within it; the first and second halves of the text feed each other."""
    n = F.length(part)
    half = F.floor(n / 2).cast("int")
    sign = -1 if undo else 1

    def shifted(x: Column, other: Column, i: Column) -> Column:
        def with_pad(pad: Column) -> Column:
            def one(c: Column, k: Column) -> Column:
                move = F.conv(pad.substr(k % 60 * 2 + 1, F.lit(6)), 16, 10).cast("long")
                out = c
                for letters in alphabets:
                    to = F.pmod(F.instr(F.lit(letters), c) - 1 + sign * move, F.lit(len(letters)))
                    out = F.when(c.rlike(f"^[{letters}]$"), F.lit(letters).substr(to.cast("int") + 1, F.lit(1))).otherwise(out)
                return out

            return F.array_join(F.transform(F.split(x, ""), one), "")

        return let(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), n.cast("string"), other), 512), with_pad)

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, shifted(acc["a"], acc["b"], i)).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise(shifted(acc["b"], acc["a"], i)).alias("b"),
        )

    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(part.substr(F.lit(1), half).alias("a"), part.substr(half + 1, n).alias("b"))
    return let(F.aggregate(steps, start, step), lambda two: F.concat(two["a"], two["b"]))



def _email(v: Column, key: str, undo: bool) -> Column:
    name, host, alphabets = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1), [_LOWER, _UPPER, _DIGITS]
    last = F.substring_index(host, ".", -1)
    labels = host.substr(F.lit(1), F.length(host) - F.length(last) - 1)
    return F.concat(_by_class(name, "email", key, undo, alphabets), F.lit("@"), _by_class(labels, "host", key, undo, alphabets), F.lit("."), last)


def _secret(v: Column, key: str, undo: bool) -> Column:
    is_aws = v.startswith("AKIA")
    head = F.when(is_aws, F.lit("AKIA")).otherwise(F.regexp_replace(v, "[0-9a-fA-F]{8,64}$", ""))
    body = v.substr(F.length(head) + 1, F.length(v))
    moved = lambda kind, alphabets: _by_class(body, kind, key, undo, alphabets)
    upper = ~head.rlike("[a-z]")
    # head and, in the last branch, the places of letters stay, so undo takes the same branch
    value = (
        F.when(is_aws, moved("aws", [_UPPER, _DIGITS]))
        .when(upper & ~body.rlike("[a-f]"), moved("secret", ["0123456789ABCDEF"]))
        .when(~upper & ~body.rlike("[A-F]"), moved("secret", ["0123456789abcdef"]))
        .otherwise(moved("secret", [_DIGITS, "abcdef", "ABCDEF"]))
    )
    return F.concat(head, value)


_PERMUTE = {"email": _email, "secret": _secret, "date": _date, "ip": _ip, "phone": _phone, "intl": _intl, "ssn": _ssn, "iban": _iban, "card": _card}


def kind_of(v: Column) -> Column:
    """The kind whose pattern a whole match fits, in the order of KINDS."""
    tests = {
        "email": v.contains("@"), "secret": v.rlike("[=:]|^AKIA"), "date": v.rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "ip": v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "phone": v.rlike(r"^(\+1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}$"),
        "intl": v.startswith("+"), "ssn": v.rlike(r"^\d{3}-\d{2}-\d{4}$"), "iban": v.rlike("^[A-Z]{2}"),
    }
    return reduce(lambda rest, k: F.when(tests[k], F.lit(k)).otherwise(rest), reversed(list(tests)), F.lit("card"))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", counts_col: str | None = None, undo: bool = False) -> DataFrame:
    """docs with the values in text_col replaced; counts_col, if named, gets a map of the numbers replaced by kind."""
    text, result = F.col(text_col), fresh(docs, "_result")

    def replaced(v: Column) -> Column:
        def by_kind(kind: Column) -> Column:
            value = reduce(lambda rest, k: F.when(kind == k, _PERMUTE[k](v, key, undo)).otherwise(rest), list(_PERMUTE), F.lit(None).cast("string"))
            return F.struct(kind.alias("kind"), value.alias("value"))

        return let(kind_of(v), by_kind)

    def rebuilt(x: Column) -> Column:
        values = F.zip_with(x["found"], x["done"], lambda v, r: F.coalesce(r["value"], v))
        tail = F.zip_with(values, F.slice(x["pieces"], F.lit(2), F.size(x["found"])), lambda v, p: F.concat(v, p))
        changed = F.filter(x["done"], lambda r: r["value"].isNotNull())
        counts = F.create_map(*[c for k in KINDS for c in (F.lit(k), _count_kind(changed, k))])
        return F.struct(F.concat(x["pieces"][0], F.array_join(tail, "")).alias("text"), counts.alias("counts"))

    def replace_all(found: Column) -> Column:
        parts = F.struct(found.alias("found"), F.transform(found, replaced).alias("done"), F.split(text, PATTERN, -1).alias("pieces"))
        return F.when(F.size(found) > 0, let(parts, rebuilt))

    some = F.when(text.rlike(HINT), let(F.regexp_extract_all(text, F.lit(PATTERN), 0), replace_all))
    out = docs.withColumn(result, some)
    if counts_col:
        out = out.withColumn(counts_col, F.coalesce(F.col(result)["counts"], F.create_map(*[c for k in KINDS for c in (F.lit(k), F.lit(0).cast("long"))])))
    return out.withColumn(text_col, F.coalesce(F.col(result)["text"], text)).drop(result)


def _count_kind(changed: Column, kind: str) -> Column:
    n = F.size(F.filter(changed, lambda r: r["kind"] == kind))
    return F.when(n > 0, n).otherwise(0).cast("long")


#: The setting that holds the key; whoever has it can undo the pseudonyms.
KEY_SETTING = "spark.groupsight.pii.key"
_OWN_KEYS: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key of the session's setting; where it is unset, a random one of this application, so values are linked within it only and cannot be had back."""
    if key := spark.conf.get(KEY_SETTING, None):
        return key
    return _OWN_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymize(docs, key_of(spark), counts_col="counts")
    return out.select("doc_id", "text", *[F.col("counts")[k].alias(f"n_{k}") for k in KINDS])
