"""JSON written by column expressions, byte for byte as ``json.dumps`` with sorted keys writes it.

``level`` is how deep a value stands in an indented text, a space a level; None
writes compact text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coppice.functions import columns as C

#: A scalar as it is found: one of its parts is set, or none for null.
SCALAR = "struct<bytes:binary,whole:bigint,real:double,flag:boolean>"
#: Its JSON text, and the name of the object that holds it, if any: written once, then only placed.
TEXT = "struct<wrap:string,json:string>"


def inside(level: int | None) -> int | None:
    return None if level is None else level + 1


def _enclosed(parts: Column, marks: str, level: int | None) -> Column:
    if level is None:
        return F.concat(F.lit(marks[0]), F.array_join(parts, ","), F.lit(marks[1]))
    line = "\n" + " " * level
    return F.when(F.size(parts) == 0, F.lit(marks)).otherwise(F.concat(F.lit(f"{marks[0]}{line} "), F.array_join(parts, f",{line} "), F.lit(f"{line}{marks[1]}")))


def listed(values: Column, level: int | None = None) -> Column:
    """A list of an array of JSON texts."""
    return _enclosed(values, "[]", level)


def entry(name: Column, value: Column, level: int | None = None) -> Column:
    """A name, which needs no escapes, with its JSON text."""
    return F.concat(F.lit('"'), name, F.lit('":' if level is None else '": '), value)


def entries(pairs: Column, level: int | None = None) -> Column:
    """An object of an array of entries in the order of their names."""
    return _enclosed(pairs, "{}", level)


def object_of(values: dict[str, Column], level: int | None = None) -> Column:
    """An object of named JSON texts."""
    return entries(F.array(*[entry(F.lit(k), values[k], level) for k in sorted(values)]), level)


def _once(values: dict[str, Column], use) -> Column:
    """``use`` of columns that are computed once, though it names them often."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use), F.lit(0))


def _scaled(digits: Column, power: Column) -> Column:
    """A number of digits, the first before the point, and a power of ten: as text that casts to the same double."""
    return F.concat(digits, F.lit("E"), (power - F.length(digits) + 1).cast("string"))


def real(x: Column) -> Column:
    """A finite double in the fewest digits that read back as the same, exponents from 1e16 on and below 1e-4.

    The JVM's own text is right but not always shortest, so it is rounded down
    and up to fewer digits, and the first that reads back is taken; of two, the
    nearer.
    """
    java = F.abs(x).cast("string")
    mantissa, power = F.split_part(java, F.lit("E"), F.lit(1)), F.coalesce(F.nullif(F.split_part(java, F.lit("E"), F.lit(2)), F.lit("")).cast("int"), F.lit(0))
    parts = {"before": F.split_part(mantissa, F.lit("."), F.lit(1)), "behind": F.split_part(mantissa, F.lit("."), F.lit(2)), "power": power, "x": F.abs(x)}

    def significant(s: Column) -> Column:
        whole = F.concat(s["before"], s["behind"])
        bare = F.ltrim(whole, F.lit("0"))
        digits = F.coalesce(F.nullif(F.rtrim(bare, F.lit("0")), F.lit("")), F.lit("0"))
        return _once({"digits": digits, "power": s["power"] + F.length(s["before"]) - 1 - F.length(whole) + F.length(bare), "x": s["x"]}, fewest)

    def rounded(s: Column, n: Column) -> Column:
        down = F.substring(s["digits"], F.lit(1), n)
        up = (down.cast("bigint") + 1).cast("string")
        low, high, upper = _scaled(down, s["power"]), _scaled(up, s["power"] + F.length(up) - n), F.substring(s["digits"], n + 1, F.lit(1)) >= "5"
        both = {"nearer": F.when(upper, high).otherwise(low), "other": F.when(upper, low).otherwise(high), "x": s["x"]}
        return _once(both, lambda b: F.when(b["nearer"].cast("double") == b["x"], b["nearer"]).when(b["other"].cast("double") == b["x"], b["other"]))

    def fewest(s: Column) -> Column:
        shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s["digits"]) - 1, F.lit(1))), lambda n: rounded(s, n))
        text = F.coalesce(F.get(F.filter(shorter, lambda t: t.isNotNull()), F.lit(0)), _scaled(s["digits"], s["power"]))
        return _once({"text": text}, lambda t: _once({"given": F.split_part(t["text"], F.lit("E"), F.lit(1)), "power": F.split_part(t["text"], F.lit("E"), F.lit(2)).cast("int")}, shown))

    def shown(t: Column) -> Column:
        digits = F.coalesce(F.nullif(F.rtrim(t["given"], F.lit("0")), F.lit("")), F.lit("0"))
        return _once({"digits": digits, "n": F.length(digits), "scale": t["power"] + F.length(t["given"]) - 1}, laid_out)

    def laid_out(t: Column) -> Column:
        digits, n, scale = t["digits"], t["n"], t["scale"]
        exponent = F.abs(scale).cast("string")
        fraction = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -scale - 1), digits)
        whole = F.concat(digits, F.repeat(F.lit("0"), scale + 1 - n), F.lit(".0"))
        mixed = F.concat(F.substring(digits, F.lit(1), scale + 1), F.lit("."), F.substring(digits, scale + 2, n))
        by_exponent = F.concat(F.substring(digits, 1, 1), fraction, F.when(scale < 0, "e-").otherwise("e+"), F.when(F.length(exponent) < 2, "0").otherwise(""), exponent)
        return F.when((scale >= 16) | (scale < -4), by_exponent).when(scale < 0, small).when(scale + 1 >= n, whole).otherwise(mixed)

    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.concat(sign, F.when(x == 0, "0.0").otherwise(_once(parts, significant)))


def text_of(s: Column) -> Column:
    """A scalar (of SCALAR) as TEXT: bytes as text where they are UTF-8, else in base64; what is not finite by its name."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    whole = F.is_valid_utf8(s["bytes"])
    odd = F.when(F.isnan(s["real"]), "NAN").when(s["real"] == float("inf"), "INF").when(s["real"] == float("-inf"), "-INF")
    json = (
        F.when(whole, C.json_string(s["bytes"].cast("string"))).when(~whole, quoted(F.replace(F.base64(s["bytes"]), F.lit("\r\n"), F.lit("")))).when(odd.isNotNull(), quoted(odd))
        .when(s["real"].isNotNull(), real(s["real"])).otherwise(F.coalesce(s["whole"].cast("string"), s["flag"].cast("string"), F.lit("null")))
    )
    return F.struct(F.when(~whole, "__b64").when(odd.isNotNull(), "__float").alias("wrap"), json.alias("json")).cast(TEXT)


def scalar(t: Column, level: int | None = None) -> Column:
    """The JSON text of a scalar given as TEXT."""
    return F.when(t["wrap"].isNull(), t["json"]).otherwise(entries(F.array(entry(t["wrap"], t["json"], level)), level))
