"""Canonical JSON of nested values as a column expression.

The text is that of a JSON writer with sorted keys, no blanks and ASCII only: what cannot be printed, and all beyond ASCII, becomes
``\\uXXXX`` in lower-case hex (two of them beyond the basic plane). Structs and maps sort their keys by code point; map keys become
strings; nulls stay, nested ones, too. Numbers with a fraction print their shortest form that reads back, as fixed or (below 1e-4, from
1e16) scientific notation; NaN and infinities print as ``NaN``, ``Infinity`` and ``-Infinity``. Decimals, dates,
timestamps and bytes become strings: ``1.50``, ``2024-01-31``, ``2024-01-31 10:00:00+00:00`` (without the offset if the type has no
zone) and ``b'..'``.

The serializer is built from a data type, so it recurses into any schema and stays within Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _hex(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


#: Escapes that JSON names by a letter.
NAMED = {8: r"\b", 9: r"\t", 10: r"\n", 12: r"\f", 13: r"\r", 34: r"\"", 92: "\\\\"}
PLAIN = r"[ -!#-\[\]-~]"


def _escaped(one: Column) -> Column:
    """The escape of a single code point."""

    def of(n: Column) -> Column:
        over = n - 0x10000
        wide = F.concat(F.lit(r"\u"), _hex(F.lit(0xD800) + F.shiftright(over, 10), 4), F.lit(r"\u"), _hex(F.lit(0xDC00) + over.bitwiseAND(F.lit(0x3FF)), 4))
        out = F.when(n >= 0x10000, wide)
        for code, text in NAMED.items():
            out = out.when(n == code, F.lit(text))
        return out.otherwise(F.concat(F.lit(r"\u"), _hex(n, 4)))

    return _let(F.ascii(one), of)


def quoted(text: Column) -> Column:
    """A string as JSON. Runs of plain characters are taken whole."""
    parts = F.regexp_extract_all(text, F.lit(f"{PLAIN}+|[^ -!#-\\[\\]-~]"), F.lit(0))
    body = F.when(text.rlike(rf"\A{PLAIN}*\z"), text).otherwise(F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{PLAIN}"), p).otherwise(_escaped(p))), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def _laid_out(digits: Column, power: Column) -> Column:
    """Digits d1 d2 d3.. of d1.d2d3.. x 10^power as fixed or scientific notation."""
    n = F.length(digits)
    fixed = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(power >= n - 1, F.concat(digits, F.repeat(F.lit("0"), power - n + 1), F.lit(".0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    )
    exponent = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit("")), exponent)
    return F.when((power >= -4) & (power < 16), fixed).otherwise(scientific)


def shortest(x: Column) -> Column:
    """A double as the shortest text that reads back as the same number."""

    def parts(t: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(F.substring_index(t, "E", 1), r"\.", ""), "0+$", "")
        return _laid_out(digits, F.substring_index(t, "E", -1).cast("int"))

    def next_up(t: Column) -> Column:
        """The next number of as many digits: below a power of two numbers lie twice as dense, so that the nearest text may not read back."""
        digits = (F.regexp_replace(F.substring_index(t, "E", 1), r"\.", "").cast("long") + 1).cast("string")
        return F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.length(digits)), F.lit("E"), F.substring_index(t, "E", -1))

    def first_that_reads_back(size: Column, tried: list[Column]) -> Column:
        out = F.lit(None).cast("string")
        for t in reversed(tried[:-1]):
            out = F.when(t.cast("double") == size, t).otherwise(F.coalesce(out, tried[-1]))
        return out

    def of(size: Column) -> Column:
        tried = [F.call_function("format_number", size, F.lit(f"0.{'0' * p}E0")) for p in (14, 15, 16)]  # rounded by the exact value
        #: subnormal numbers need any number of digits from one on
        every = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda p: F.call_function("format_number", size, F.concat(F.lit("0."), F.repeat(F.lit("0"), p), F.lit("E0"))))
        tiny = F.get(F.filter(every, lambda t: t.cast("double") == size), 0)
        text = F.when(size < 2.3e-308, tiny).otherwise(first_that_reads_back(size, [tried[0], next_up(tried[0]), tried[1], next_up(tried[1]), tried[2]]))
        return F.when(size == 0, F.lit("0.0")).otherwise(_let(text, parts))

    def of_whole(n: Column) -> Column:
        """Whole numbers of 16 to 19 digits, rounded to 15, 16 and 17, half to even: the writer above rounds them twice."""

        def rounded(places: int) -> Column:
            unit = F.lit(1)
            for size in range(16, 20):
                unit = F.when(n >= 10 ** (size - 1), F.lit(10 ** max(size - places, 0))).otherwise(unit)

            def of_unit(u: Column) -> Column:
                whole, twice = F.call_function("div", n, u), n % u * 2
                up = (twice > u) | ((twice == u) & (whole % 2 == 1))
                text = ((whole + up.cast("long")) * u).cast("string")
                return F.concat(F.substring(text, 1, 1), F.lit("."), F.substring(text, F.lit(2), F.length(text)), F.lit("E"), (F.length(text) - 1).cast("string"))

            return _let(unit.cast("long"), of_unit)

        return first_that_reads_back(n.cast("double"), [rounded(p) for p in (15, 16, 17)])

    #: -0.0 has a sign of its own
    sign = F.when((x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-"))), "-").otherwise("")
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
    whole = F.abs(x).between(float(1 << 53), 9.2e18)  # no fractions from there on
    text = F.when(whole, _let(_let(F.when(whole, F.abs(x)).cast("long"), of_whole), parts)).otherwise(_let(F.abs(x), of))
    return F.coalesce(special, F.concat(sign, text))


def _bytes(value: Column) -> Column:
    """Bytes as a literal between quotes: double ones only where the bytes hold single ones alone."""
    codes = F.transform(F.regexp_extract_all(F.hex(value), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))

    def of(all_: Column) -> Column:
        quote = F.when(F.array_contains(all_, 39) & ~F.array_contains(all_, 34), 34).otherwise(39)

        def one(n: Column) -> Column:
            named = F.when(n == 9, r"\t").when(n == 10, r"\n").when(n == 13, r"\r").when(n == 92, "\\\\").when((n == 39) & (quote == 39), r"\'")
            return named.when(n.between(32, 126), F.char(n)).otherwise(F.concat(F.lit(r"\x"), _hex(n, 2)))

        return F.concat(F.lit("b"), F.char(quote), F.array_join(F.transform(all_, one), ""), F.char(quote))

    return _let(codes, of)


def _decimal(value: Column, kind: T.DecimalType) -> Column:
    """Plain notation, but scientific below 1e-6."""
    text = F.abs(value).cast("string")
    digits = F.regexp_replace(F.regexp_replace(text, r"\.", ""), "^0+(?=.)", "")
    power = F.length(digits) - 1 - F.lit(kind.scale)
    small = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(F.lit("")), F.lit("E-"), F.abs(power).cast("string"))
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, F.when(power < -6, small).otherwise(text))


def _moment(value: Column, zone: bool) -> Column:
    if zone:
        value = F.to_utc_timestamp(value, F.current_timezone())
    whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    part = F.date_format(value, "SSSSSS")
    return F.concat(whole, F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(F.lit("")), F.lit("+00:00" if zone else ""))


def as_key(value: Column, kind: T.DataType) -> Column:
    """A map's key as a string."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").otherwise("False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = shortest(value.cast("double"))
        return F.when(plain == "NaN", "nan").when(plain == "Infinity", "inf").when(plain == "-Infinity", "-inf").otherwise(plain)
    if isinstance(kind, T.IntegralType):
        return value.cast("string")
    return _string(value, kind)


def _string(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType):
        return _decimal(value, kind)
    if isinstance(kind, T.TimestampType):
        return _moment(value, True)
    if isinstance(kind, T.TimestampNTZType):
        return _moment(value, False)
    if isinstance(kind, T.BinaryType):
        return _bytes(value)
    return value.cast("string")


def canonical(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON text of a value; the text ``null`` for a null."""
    if isinstance(kind, T.StructType):
        parts = [F.lit("{")]
        for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name)):
            parts += [F.concat(F.lit("," if i else ""), quoted(F.lit(f.name)), F.lit(":")), canonical(value.getField(f.name), f.dataType)]
        text = F.concat(*parts, F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(as_key(e.key, kind.keyType).alias("k"), canonical(e.value, kind.valueType).alias("v"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e.k), F.lit(":"), e.v)), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.BooleanType):
        text = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = shortest(value.cast("double"))
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        text = quoted(_string(value, kind))
    return F.when(value.isNull(), "null").otherwise(text)


def canonical_columns(df: DataFrame, *fields: str, **named: Column) -> Column:
    """The canonical JSON of an object of columns of ``df`` by their names, and expressions by keyword."""
    values = {f: F.col(f"`{f}`") for f in fields} | named
    row = df.select(*[v.alias(k) for k, v in values.items()]).schema
    parts = [F.lit("{")]
    for i, f in enumerate(sorted(row.fields, key=lambda f: f.name)):
        parts += [F.concat(F.lit("," if i else ""), quoted(F.lit(f.name)), F.lit(":")), canonical(values[f.name], f.dataType)]
    return F.concat(*parts, F.lit("}"))
