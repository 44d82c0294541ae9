"""Unit-conversion templates: ``{{convert|15|km|mi}}`` to its two sides and its full text.

Rounding follows the template's public documentation: a result keeps about the input's precision, moved by the
logarithm of the factor, and at least two significant digits; temperatures keep three in kelvin.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.functions import vocab
from quantspark.functions.numbers import _VULGAR, normalised_digits
from quantspark.functions.text import clean_template


@dataclass(frozen=True)
class Unit:
    code: str
    singular: str
    plural: str
    symbol: str
    kind: str
    scale: float
    default: str
    offset: float = 0.0
    american: str | None = None
    inverse: bool = False


#: code | singular | plural | symbol | kind | scale | default output [| American singular]. Fixed public values.
_UNITS = """
m|metre|metres|m|length|1|ft|meter
km|kilometre|kilometres|km|length|1000|mi|kilometer
cm|centimetre|centimetres|cm|length|0.01|in|centimeter
mm|millimetre|millimetres|mm|length|0.001|in|millimeter
ft|foot|feet|ft|length|0.3048|m
in|inch|inches|in|length|0.0254|mm
yd|yard|yards|yd|length|0.9144|m
mi|mile|miles|mi|length|1609.344|km
nmi|nautical mile|nautical miles|nmi|length|1852|km mi
fathom|fathom|fathoms|fathom|length|1.8288|ft m
royal cubit|royal cubit|royal cubits|cu|length|0.524|mm
ly|light-year|light-years|ly|length|9.4607304725808e15|pc
pc|parsec|parsecs|pc|length|3.0856775814913673e16|ly
kpc|kiloparsec|kiloparsecs|kpc|length|3.0856775814913673e19|ly
AU|astronomical unit|astronomical units|AU|length|149597870700|km
m2|square metre|square metres|m2|area|1|sqft|square meter
km2|square kilometre|square kilometres|km2|area|1e6|sqmi|square kilometer
cm2|square centimetre|square centimetres|cm2|area|1e-4|sqin|square centimeter
ha|hectare|hectares|ha|area|1e4|acre
acre|acre|acres|acre|area|4046.8564224|ha
sqft|square foot|square feet|sq ft|area|0.09290304|m2
sqmi|square mile|square miles|sq mi|area|2589988.110336|km2
sqyd|square yard|square yards|sq yd|area|0.83612736|m2
sqin|square inch|square inches|sq in|area|0.00064516|cm2
m3|cubic metre|cubic metres|m3|volume|1|cuft|cubic meter
km3|cubic kilometre|cubic kilometres|km3|volume|1e9|cumi|cubic kilometer
cumi|cubic mile|cubic miles|cu mi|volume|4168181825.440579584|km3
cuft|cubic foot|cubic feet|cu ft|volume|0.028316846592|m3
cuyd|cubic yard|cubic yards|cu yd|volume|0.764554857984|m3
cid|cubic inch|cubic inches|cu in|volume|0.000016387064|cc
cc|cubic centimetre|cubic centimetres|cc|volume|1e-6|cuin|cubic centimeter
L|litre|litres|L|volume|0.001|impgal usgal|liter
ml|millilitre|millilitres|mL|volume|1e-6|impoz usoz|milliliter
usgal|US gallon|US gallons|US gal|volume|0.003785411784|L
impgal|imperial gallon|imperial gallons|imp gal|volume|0.00454609|L
impfloz|imperial fluid ounce|imperial fluid ounces|imp fl oz|volume|28.4130625e-6|ml
usoz|US fluid ounce|US fluid ounces|US fl oz|volume|29.5735295625e-6|ml
kg|kilogram|kilograms|kg|mass|1|lb
g|gram|grams|g|mass|0.001|oz
mg|milligram|milligrams|mg|mass|1e-6|gr
t|tonne|tonnes|t|mass|1000|LT ST
lb|pound|pounds|lb|mass|0.45359237|kg
oz|ounce|ounces|oz|mass|0.028349523125|g
st|stone|stone|st|mass|6.35029318|lb kg
ST|short ton|short tons|short tons|mass|907.18474|LT t
LT|long ton|long tons|long tons|mass|1016.0469088|ST t
solar mass|solar mass|solar masses|M☉|mass|1.98855e30|kg
km/h|kilometre per hour|kilometres per hour|km/h|speed|0.2777777777777778|mph|kilometer per hour
mph|mile per hour|miles per hour|mph|speed|0.44704|km/h
m/s|metre per second|metres per second|m/s|speed|1|ft/s|meter per second
km/s|kilometre per second|kilometres per second|km/s|speed|1000|mi/s|kilometer per second
mi/s|mile per second|miles per second|mi/s|speed|1609.344|km/s
ft/s|foot per second|feet per second|ft/s|speed|0.3048|m/s
kn|knot|knots|kn|speed|0.5144444444444445|km/h
W|watt|watts|W|power|1|hp
kW|kilowatt|kilowatts|kW|power|1000|hp
MW|megawatt|megawatts|MW|power|1e6|hp
hp|horsepower|horsepower|hp|power|745.6998715822702|kW
PS|metric horsepower|metric horsepower|PS|power|735.49875|kW
Nm|newton-metre|newton-metres|N⋅m|torque|1|lbft|newton-meter
lbft|pound force-foot|pound force-feet|lb⋅ft|torque|1.3558179483314004|Nm
N|newton|newtons|N|force|1|lbf
lbf|pound-force|pounds-force|lbf|force|4.4482216152605|N
Pa|pascal|pascals|Pa|pressure|1|psi
kPa|kilopascal|kilopascals|kPa|pressure|1000|psi
MPa|megapascal|megapascals|MPa|pressure|1e6|psi
bar|bar|bars|bar|pressure|1e5|kPa
psi|pound per square inch|pounds per square inch|psi|pressure|6894.757293168361|kPa
J|joule|joules|J|energy|1|cal
kJ|kilojoule|kilojoules|kJ|energy|1000|kcal
cal|calorie|calories|cal|energy|4.184|J
kcal|kilocalorie|kilocalories|kcal|energy|4184|kJ
kWh|kilowatt-hour|kilowatt-hours|kW⋅h|energy|3.6e6|MJ
MJ|megajoule|megajoules|MJ|energy|1e6|kWh
PD/sqmi|inhabitant per square mile|inhabitants per square mile|/sq mi|density|3.861021585424458e-7|PD/km2
PD/km2|inhabitant per square kilometre|inhabitants per square kilometre|/km2|density|1e-6|PD/sqmi|inhabitant per square kilometer
/sqmi|per square mile|per square mile|/sq mi|density|3.861021585424458e-7|/km2
/km2|per square kilometre|per square kilometre|/km2|density|1e-6|/sqmi|per square kilometer
"""
_ALIASES = {"sqkm": "km2", "sqm": "m2", "ft2": "sqft", "mi2": "sqmi", "ft3": "cuft", "in3": "cid", "cuin": "cid", "l": "L", "litre": "L", "mL": "ml", "gal": "usgal", "USgal": "usgal", "inch": "in", "foot": "ft", "feet": "ft", "acres": "acre", "hectare": "ha", "metre": "m", "meter": "m", "kilometre": "km", "mile": "mi", "miles": "mi", "lbs": "lb", "tonne": "t", "MT": "t", "long ton": "LT", "short ton": "ST", "mi/h": "mph", "kph": "km/h", "lb·ft": "lbft", "lb.ft": "lbft", "lbf.ft": "lbft", "N.m": "Nm", "N·m": "Nm", "l/100 km": "L/100 km", "L/100km": "L/100 km", "impoz": "impfloz", "°C": "C", "°F": "F", "bhp": "hp", "yards": "yd", "knot": "kn"}


def _table() -> dict[str, Unit]:
    found = {}
    for line in _UNITS.strip().splitlines():
        code, singular, plural, symbol, kind, scale, default, *american = line.split("|")
        found[code] = Unit(code, singular, plural, symbol, kind, float(scale), default, american=american[0] if american else None)
    for code, name, symbol, scale, zero, default in (("C", "degree Celsius", "°C", 1.0, 273.15, "F"), ("F", "degree Fahrenheit", "°F", 5 / 9, 459.67 * 5 / 9, "C"), ("K", "kelvin", "K", 1.0, 0.0, "C F")):
        found[code] = Unit(code, symbol if code != "K" else name, symbol if code != "K" else "kelvins", symbol, "temperature", scale, default, offset=zero)
    found["L/100 km"] = Unit("L/100 km", "litre per 100 kilometres", "litres per 100 kilometres", "L/100 km", "economy", 1e-8, "mpgimp mpgus", american="liter per 100 kilometers", inverse=True)
    for code, name, gallon in (("mpgus", "mile per US gallon", 0.003785411784), ("mpgimp", "mile per imperial gallon", 0.00454609)):
        found[code] = Unit(code, name, name.replace("mile", "miles", 1), {"mpgus": "mpg‑US", "mpgimp": "mpg‑imp"}[code], "economy", 1609.344 / gallon, "L/100 km")
    return found


UNITS = _table()
_SCALES = {3: "thousand", 6: "million", 9: "billion", 12: "trillion", 15: "quadrillion"}
_RANGES = {"–": "–", "-": "–", "&ndash;": "–", "to": " to ", "and": " and ", "x": " × ", "×": " × ", "by": " by ", "or": " or ", "+/-": " ± ", "±": " ± ", "to(-)": " to ", "to about": " to about "}
_SYMBOL_RANGES = {"to(-)": "–"}


def unit_of(code: str) -> tuple[Unit, int] | None:
    """The unit of a code and the power of ten in front of it (``e6sqft``)."""
    code = re.sub(r"\s+", " ", code.strip().replace("_", " "))
    m = re.match(r"e(\d+)(.+)$", code)
    power, name = (int(m[1]), m[2].strip()) if m else (0, code)
    name = _ALIASES.get(name, name)
    return (UNITS[name], power) if name in UNITS else None


def units_of(code: str) -> list[tuple[Unit, int]] | None:
    """One or several units of an output: joined by ``+``, spaces or underscores; ``ftin`` is feet and inches."""
    one = unit_of(code)
    if one:
        return [one]
    if code.strip() == "ftin":
        return [(UNITS["ft"], -1)]
    parts = re.split(r"\s*\+\s*", code.strip()) if "+" in code else re.split(r"[\s_]+", code.strip())
    found = [unit_of(p) for p in parts]
    return None if not parts or any(f is None for f in found) else found


@dataclass(frozen=True)
class Value:
    """A number as it was written: its value, shown form, precision (decimals, or minus the trailing zeros)."""

    value: float
    shown: str
    precision: int
    fraction: int = 0


def read_value(text: str) -> Value | None:
    t = text.strip().replace("−", "-").replace("⁄", "/").replace(" ", " ")
    if any(c in _VULGAR for c in t) or re.search("[⁰¹²³⁴-₉]", t):
        t = normalised_digits(t).replace("⁄", "/").replace(" /", "/").replace("/ ", "/")
    m = re.fullmatch(r"(?:(-?\d+)\s*\+?\s*)?(-?\d+)//?(\d+)", t)
    if m and int(m[3]):
        whole = int(m[1] or 0)
        value = abs(whole) + Fraction(int(m[2]), int(m[3]))
        return Value(float(value if whole >= 0 else -value), (f"{m[1]}+" if m[1] else "") + f"{m[2]}/{m[3]}", max(1, round(math.log10(int(m[3])))), int(m[3]))
    bare = re.sub(r"(?<=\d)[, ](?=\d{3})", "", t)
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", bare):
        return None
    mantissa, _, exponent = bare.partition("e")
    whole, _, decimals = mantissa.lstrip("+-").partition(".")
    power = int(exponent or 0)
    if decimals:
        precision = len(decimals) - power
    else:
        digits = whole.rstrip("0")
        precision = -(len(whole) - len(digits)) - power if digits else 0
    return Value(float(bare), grouped(mantissa), precision)


def grouped(number: str) -> str:
    sign, digits = ("−", number[1:]) if number.startswith("-") else ("", number.lstrip("+"))
    whole, dot, decimals = digits.partition(".")
    return sign + (f"{int(whole or 0):,}" if len(whole or "0") > 3 else whole or "0") + dot + decimals


def convert(value: float, source: Unit, target: Unit) -> float:
    if source.kind == "temperature":
        return (value * source.scale + source.offset - target.offset) / target.scale
    if source.inverse != target.inverse:
        return 1 / (value * source.scale * target.scale) if value else 0.0
    return value * source.scale / target.scale


def default_precision(read: Value, out: float, source: Unit, in_power: int, out_power: int) -> int:
    """Decimals of a result by the documented rule."""
    if source.kind == "temperature":
        kelvin = abs(read.value * source.scale + source.offset) or 1.0
        return max(read.precision, min(2 - math.floor(math.log10(kelvin) + 1e-14), 3))
    if not out:
        return 0
    whole = read.value == math.floor(read.value)
    if source.code == "m" and whole and not in_power and not read.fraction:
        adjust = 0.0
    else:
        adjust = math.log10(abs(read.value / out)) if read.value else 0.0
    return max(math.floor(read.precision + adjust + math.log10(2)), 1 - math.floor(math.log10(abs(out)) + 1e-14))


def shown(value: float, precision: int) -> str:
    """A rounded number with grouping; powers of ten from 10**9 on, with one decimal."""
    rounded = _round(value, precision)
    if abs(rounded) >= 1e9:
        exponent = math.floor(math.log10(abs(rounded)) + 1e-12)
        digits = max(1, exponent + precision)
        return f"{rounded / 10**exponent:.{digits}f}×10{exponent}"
    return grouped(f"{rounded:.{max(0, precision)}f}") if rounded >= 0 else "−" + grouped(f"{-rounded:.{max(0, precision)}f}")


def _round(value: float, precision: int) -> float:
    scaled = abs(value) * 10.0**precision
    return math.copysign(math.floor(scaled + 0.5 + 1e-9) / 10.0**precision, value)


def frame(text: str) -> dict[str, str] | None:
    """A template's arguments: positional ones by number, named ones by name; ``cvt`` implies ``abbr=on``.

    Of ``a=b=c`` the last value counts under the key before it; 1= to 4= stand for positions.
    """
    parts = clean_template(text).split("|")
    name = parts[0].strip().lower()
    if name not in ("convert", "cvt"):
        return None
    out = {"abbr": "on"} if name == "cvt" else {}
    n = 0
    for part in parts[1:]:
        if "=" in part:
            pieces = part.split("=")
            out[pieces[-2].strip()] = pieces[-1].strip() if pieces[-2].strip() not in ("disp",) else pieces[-1].strip()
        else:
            n += 1
            while str(n) in out:
                n += 1
            out[str(n)] = part
    return out


def _unit_text(units: list[tuple[Unit, int]], value: float, long: bool, american: bool, adjective: bool, inside: bool = False) -> str:
    unit, power = units[0]
    scale = _SCALES.get(power, "") if power > 0 else ""
    if not long:
        # A unit whose symbol is its name has a plural.
        symbol = unit.plural if unit.symbol == unit.singular and abs(value) != 1 else unit.symbol
        return (f"{scale} " if scale else "") + symbol
    name = unit.american if american and unit.american else unit.singular
    if adjective:
        return (f"{scale}-" if scale else "") + name.replace(" ", "-")
    if abs(value) != 1 or power:
        if american and unit.american:
            head, *rest = unit.american.split(" ")
            name = unit.plural.replace("metre", "meter").replace("litre", "liter") if not rest or unit.american else f"{head}s {' '.join(rest)}"
        else:
            name = unit.plural
    return (f"{scale} " if scale else "") + name


def expand(text: str | None) -> list[str] | None:
    """``[left, right, full]`` of a conversion template; None where it can't be read. Never an error."""
    if not text or "NNN" in text or not re.search(r"\d|[¼½¾⅓⅔⅛⅜⅝⅞⁰-₉²³¹]", text):
        return None
    try:
        return _expand(frame(text) or {})
    except (ValueError, KeyError, ZeroDivisionError, OverflowError, IndexError):
        return None


def _values(args: list[str]) -> tuple[list[Value], list[str], list[str]] | None:
    """Values, the range words between them, and the arguments after them."""
    first = args[0].strip()
    m = re.fullmatch(r"\s*([\d.,/+¼½¾]+)\s*(–|-|x|×|to|and)\s*(.+)", first)
    if m and read_value(first) is None:
        rest = _values([m[3], *args[1:]])
        lead = read_value(m[1])
        return None if rest is None or lead is None else ([lead, *rest[0]], [m[2], *rest[1]], rest[2])
    value = read_value(first)
    if value is None:
        return None
    if len(args) > 2 and args[1].strip() in _RANGES:
        rest = _values(args[2:])
        return None if rest is None else ([value, *rest[0]], [args[1].strip(), *rest[1]], rest[2])
    return [value], [], args[1:]


def _expand(args: dict[str, str]) -> list[str] | None:
    positional = [args[str(k)] for k in range(1, 40) if str(k) in args and all(str(j) in args for j in range(1, k))]
    got = _values(positional) if positional else None
    if got is None:
        return None
    values, ranges, rest = got
    if not rest:
        return None
    source = unit_of(rest[0])
    if source is None:
        return None
    unit, power = source
    rest = [r.strip() for r in rest[1:]]
    precision = next((int(args[k]) for k in ("4", "5", "6", "7") if k in args and re.fullmatch(r"\s*-?\d+\s*", args[k]) and k not in map(str, range(1, len(positional) + 1))), None)
    targets = None
    if rest and rest[0] != "":
        targets = units_of(rest[0])
        if targets is not None:
            rest = rest[1:]
    elif rest:
        rest = rest[1:]
    if targets is None:
        targets = units_of(unit.default)
    if rest and re.fullmatch(r"-?\d+", rest[0]):
        precision, rest = int(rest[0]), rest[1:]
    extra = next((r for r in rest if r), "")
    abbr, order, adj, disp = (args.get(k, "").strip() for k in ("abbr", "order", "adj", "disp"))
    american, flip = args.get("sp", "") == "us", order == "flip"
    if order == "out" and len(targets) > 1:
        lead = targets[0]
        others = [t for t in targets[1:] if t[0] != unit]
    else:
        lead, others = None, targets
    adjective = adj in ("on", "mid", "pre")
    in_long = abbr not in ("on", "in", "values") if not flip else abbr == "off"
    out_long = abbr == "off" or (flip and abbr not in ("on", "out"))
    if flip and abbr in ("", "off"):
        in_long = True

    def quantity(shown_values: list[str], numbers: list[float], units: list[tuple[Unit, int]], long: bool, adjectival: bool) -> str:
        if abbr == "values":
            return _joined(shown_values, ranges, long)
        word = _unit_text(units, numbers[-1] if len(numbers) == 1 else 2, long, american, adjectival and long)
        symbol = units[0][0].symbol
        if any(r in ("x", "×", "by") for r in ranges) and not long:
            return _joined([f"{v} {symbol}" for v in shown_values], ranges, long)
        joined = _joined(shown_values, ranges, long)
        gap = "" if word.startswith("/") else "-" if adjectival and long else " "
        return joined + gap + word

    if args.get("spell", "") in ("in", "on", "In", "On"):
        written = [_spelled(v.value) or v.shown for v in values]
        if args["spell"][0] == "I":
            written[0] = written[0].capitalize()
    else:
        written = [v.shown for v in values]
    numbers = [v.value for v in values]
    left = quantity(written, numbers, [source], in_long, adjective)
    if adj == "mid" and extra:
        left += extra if extra.startswith("-") else f" {extra}"
    if adj == "pre" and extra:
        left = f"{' '.join(written)} {extra} {_unit_text([source], numbers[-1], in_long, american, False)}"

    step = args.get("round", "")

    def converted(target: tuple[Unit, int]) -> str:
        out_unit, out_power = target
        ftin = out_power == -1
        scale = 10.0 ** (power - max(0, out_power))
        raw = [convert(v.value * (1 if out_unit.inverse != unit.inverse else 1), unit, out_unit) * scale for v in values]
        if ftin:
            return _joined([_feet_and_inches(r) for r in raw], ranges, False, wide=True)
        if step.isdigit():
            n = int(step)
            texts = [shown(_round(r / n, 0) * n, 0) for r in raw]
        else:
            each = [default_precision(Value(v.value, v.shown, v.precision - 0), r / (10.0**power if out_power <= 0 else 1) * (10.0**power if False else 1), unit, power, out_power) for v, r in zip(values, raw, strict=True)]
            if power and out_power <= 0:
                each = [default_precision(Value(v.value * 10.0**power, v.shown, v.precision - power), r, unit, power, out_power) for v, r in zip(values, raw, strict=True)]
            digits = precision if precision is not None else max(each)
            texts = [shown(r, digits) for r in raw]
        numbers = [0.0 if not t else r for t, r in zip(texts, raw, strict=True)]
        one = [1.0] if len(texts) == 1 and texts[0] == "1" else numbers
        return quantity(texts, one, [(out_unit, max(0, out_power))], out_long, False)

    right = "; ".join(converted(t) for t in others)
    if lead is not None:
        right = "; ".join([left, *[converted(t) for t in others]])
        left = converted(lead)
    if flip:
        left, right = right, left
    if disp == "preunit" and extra:
        value, _, name = left.rpartition(" ")
        left = f"{value} {extra.strip()} {name}"
    if disp in ("comma",):
        return [left, right, f"{left}, {right}"]
    if disp in ("or",):
        return [left, right, f"{left} or {right}"]
    if disp in ("x", "preunit") and disp == "x":
        between = [r for r in rest if r is not None] or [" "]
        return [left, right, left + between[0] + right + (between[1] if len(between) > 1 else "")]
    if disp in ("output only", "out"):
        return [left, right, right]
    return [left, right, f"{left} ({right})"]


def _joined(texts: list[str], ranges: list[str], long: bool, wide: bool = False) -> str:
    out = texts[0]
    for word, t in zip(ranges, texts[1:], strict=True):
        between = _RANGES[word] if long or word not in _SYMBOL_RANGES else _SYMBOL_RANGES[word]
        out += (" – " if wide and between == "–" else between) + t
    return out


def _feet_and_inches(feet: float) -> str:
    inches = int(_round(feet * 12, 0))
    return f"{inches // 12} ft {inches % 12} in"


def _spelled(value: float) -> str | None:
    from quantspark.functions.formats import spelled

    return spelled(int(value)) if value == int(value) else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def expanded_template(texts: pd.Series) -> pd.Series:
    known = {t: expand(t) for t in texts.dropna().unique()}
    return texts.map(known)


__all__ = ["UNITS", "Unit", "expand", "expanded_template", "frame", "units_of", "vocab"]
