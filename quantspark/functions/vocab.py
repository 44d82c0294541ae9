"""Number-word vocabularies as Python maps and as tables.

Cardinals, ordinals and magnitudes are built by rule from word stems; only short irregular lists are written out.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: English number words that follow no rule.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
IRREGULAR_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
LATIN_ORDINALS = {1: "primary", 2: "secondary", 3: "tertiary", 4: "quaternary", 5: "quinary", 6: "senary", 7: "septenary", 8: "octonary", 9: "nonary", 10: "decenary", 11: "undenary", 12: "duodenary"}
SMALL_ILLIONS = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion".split()
ILLION_UNITS = ["", "un", "duo", "tre", "quattuor", "quin", "sex", "septen", "octo", "novem"]
ILLION_TENS = ["dec", "vigint", "trigint", "quadragint", "quinquagint", "sexagint", "septuagint", "octogint", "nonagint"]
DENOMINATOR_WORDS = {"half": 2, "halves": 2, "quarter": 4, "quarters": 4}
#: Colloquial number words (ages, very large and small quantities, imprecise expressions, ranks, tuples).
COLLOQUIAL = [
    "quinquagenarian", "sexagenarian", "septuagenarian", "octogenarian", "nonagenarian", "centenarian", "supercentenarian", "minus infinity", "negative infinity", "hundred", "hundreds", "thousand",
    "thousands", "hundred thousand", "million", "millions", "billion", "billions", "trillion", "trillions", "quadrillion", "quadrillions", "octillion", "nonillion", "undecillion", "googolplex",
    "googol", "infinity", "lots of", "not much", "few of", "small number of", "hundreds of", "all kinds of", "thousands of", "tons of", "too many to count", "massive amounts of",
    "very small number of", "far more than", "way more than", "very large number of", "millions of", "way too many", "huge number of", "gobs of", "vanishingly small", "uncountable", "hell of a lot",
    "lions share of", "vast quantities of", "waist deep in", "infinitesimally small", "tiny number of", "infinitely more", "miniscule amounts of", "gazillion", "crap load of", "shit load",
    "up the wazoo", "infinitely small", "bazillion", "infinitely", "less", "infinitely large", "butt load", "boat loads of", "buttload", "first", "firstly", "1stly", "primary", "1ary", "second",
    "secondly", "2ndly", "secondary", "2ndary", "third", "thirdly", "3rdly", "tertiary", "3rdary", "fourth", "fourthly", "4thly", "quaternary", "fifth", "fifthly", "5thly", "quinary", "sixth",
    "sixthly", "6thly", "senary", "seventh", "seventhly", "7thly", "septenary", "hundredth", "thousandth", "unary", "2ary", "millionth", "binary", "3ary", "billionth", "ternary", "4ary", "singling",
    "singled", "singles", "single", "singleton", "doubling", "doubled", "doubles", "double", "twins", "tripling", "tripled", "triples", "triple", "triplets", "quadrupling", "quadrupled",
    "quadruples", "quadruple", "quadruplets", "quintupling", "quintupled", "quintuples", "quintuple", "quintuplets", "sextupling", "sextupled", "sextuples", "sextuple", "sextuplets", "septupling",
    "septupled", "septuples", "septuple", "septuplets", "octupling", "octupled", "octuples", "octuple", "octuplets",
]
#: Names of physical constants.
CONSTANTS = [
    "Planck time", "Planck length", "speed of gravity", "solar constant", "Planck mass", "Bohr radius", "Rydberg constant", "Planck temperature", "Bohr magneton", "Planck energy", "nuclear magneton",
    "Gaussian gravitational constant", "proton-to-electron mass ratio", "neutron magnetic moment", "molar mass constant", "pion decay constant", "Einstein's constant", "Angstrom star",
    "proton magnetic moment", "Planck acceleration", "Josephson constant", "alpha particle mass", "electron Compton wavelength", "Planck magnetic flux density", "Planck magnetic flux", "gram-force",
    "muon mass", "tau mass", "copper x unit", "molybdenum x unit", "molar Planck constant", "speed of light", "light speed", "lightspeed", "Planck speed", "speed of electromagnetic waves in vacuum",
    "speed of light in vacuum", "vacuum speed of light", "velocity of light", "Boltzmann constant", "fine-structure constant", "fine structure constant", "Sommerfeld's constant",
    "vacuum permittivity", "electric constant", "permittivity of free space", "permittivity of vacuum", "vacuum electric permittivity", "Avogadro constant", "Avogadro's constant",
    "gravitational constant", "Newton's gravitational constant", "Newtonian constant of gravitation", "light-year", "l.y.", "light year", "light years", "light-years", "lightyear", "lightyears",
    "elementary charge", "elementary electric charge", "elementary positive charge", "speed of light", "speed of light in a vacuum", "electronvolt", "electron volt", "Stefan-Boltzmann constant",
    "Stefan Boltzmann constant", "cosmological constant", "Einstein's cosmological constant", "Planck constant", "Planck's constant", "molar gas constant", "ideal gas constant",
    "universal gas constant", "Faraday constant", "standard atmosphere", "gas constant", "impedance of free space", "Planck impedance", "characteristic impedance of vacuum", "vacuum impedance",
    "von Klitzing constant", "Hartree energy", "hartree", "Loschmidt constant", "Loschmidt's number", "Tolman–Oppenheimer–Volkoff limit", "TOV limit", "magnetic constant",
    "permeability of free space", "permeability of vacuum", "vacuum permeability", "reduced Planck constant", "Dirac constant", "Dirac's constant", "Planck action", "Planck angular momentum",
    "reduced Planck's constant", "classical electron radius", "electron radius", "Lorentz radius", "Thomson scattering length", "magnetic flux quantum", "flux quantum", "electron rest mass",
    "electron mass", "von Kármán constant", "Kármán's constant", "unified atomic mass constant", "atomic mass constant", "proton gyromagnetic ratio", "gyromagnetic coefficient of the proton",
    "gyromagnetic ratio of the proton", "magnetogyric ratio of the proton", "Coulomb's constant", "electric force constant", "electrostatic constant", "Wien wavelength displacement law constant",
    "Wien constant", "Wien's displacement constant", "standard acceleration of free fall", "standard gravity", "standard acceleration of gravity", "Rydberg energy", "rydberg", "conductance quantum",
    "Avogadro number", "Avogadro's number", "Einstein's constant", "weak mixing angle constant", "weak mixing angle", "proton rest mass", "proton mass", "electron gyromagnetic ratio",
    "gyromagnetic coefficient of the electron", "gyromagnetic ratio of the electron", "magnetogyric ratio of the electron", "neutron rest mass", "neutron mass", "reduced electron gyromagnetic ratio",
    "electron reduced gyromagnetic ratio", "reduced gyromagnetic coefficient of the electron", "reduced gyromagnetic ratio of the electron", "reduced magnetogyric ratio of the electron",
    "reduced proton gyromagnetic ratio", "proton reduced gyromagnetic ratio", "reduced gyromagnetic coefficient of the proton", "reduced gyromagnetic ratio of the proton",
    "reduced magnetogyric ratio of the proton", "neutron gyromagnetic ratio", "gyromagnetic coefficient of the neutron", "gyromagnetic ratio of the of the neutron",
    "magnetogyric ratio of the neutron", "neutron reduced gyromagnetic ratio", "reduced gyromagnetic coefficient of the neutron", "reduced gyromagnetic ratio of the neutron",
    "reduced magnetogyric ratio of the neutron", "reduced neutron gyromagnetic ratio",
]
#: Further terms; a blank at the end belongs to the term.
CUSTOM_TERMS = ["few ", "room temperature", "golden ratio", "Pi "]
#: A colloquial word that is left out, as it mostly compares.
LEFT_OUT = "less"


def ordinal(word: str) -> str:
    """The ordinal of a cardinal or magnitude word."""
    if word in IRREGULAR_ORDINALS:
        return IRREGULAR_ORDINALS[word]
    return word[:-1] + "ieth" if word.endswith("y") else word + "th"


def plural(word: str) -> str:
    if word.endswith("s"):
        return word
    if word.endswith("y"):
        return word[:-1] + "ies"
    return word + ("es" if word.endswith("x") else "s")


@cache
def cardinals() -> dict[str, int]:
    return {w: n for n, w in enumerate(UNITS)} | {w: 10 * n for n, w in enumerate(TENS, 2)} | {"hundred": 100}


@cache
def magnitudes() -> dict[str, int]:
    """Magnitude word -> k of 10 ** (3 k)."""
    found = {w: k for k, w in enumerate(SMALL_ILLIONS, 1)}
    for t, tens in enumerate(ILLION_TENS, 1):
        for u, unit in enumerate(ILLION_UNITS):
            found[f"{unit}{tens}illion"] = 10 * t + u + 1
    found["centillion"] = 101
    return found


@cache
def ordinals() -> dict[str, int]:
    found = {ordinal(w): n for w, n in cardinals().items()} | {word: n for n, word in LATIN_ORDINALS.items()}
    return found | {ordinal(w): 10 ** (3 * k) for w, k in magnitudes().items() if k <= 4}


@cache
def denominators() -> dict[str, float]:
    """Word of a fraction's lower part -> its value."""
    found = {w: 1 / n for w, n in DENOMINATOR_WORDS.items()}
    for word, n in ordinals().items():
        if n > 2 and word not in LATIN_ORDINALS.values():
            found[word] = found[plural(word)] = 1 / n
    return found


def basic_number_words(kind: str = "all") -> list[str]:
    """Lower-case, distinct: all, cardinals, ordinals, denominators, magnitudes or ordinals_minus_denominators."""
    sets = {
        "cardinals": list(cardinals()),
        "ordinals": list(ordinals()),
        "denominators": list(denominators()),
        "magnitudes": list(magnitudes()),
        "ordinals_minus_denominators": [w for w in ordinals() if w not in denominators()],
    }
    words = [w for k in ("cardinals", "ordinals", "denominators", "magnitudes") for w in sets[k]] if kind == "all" else sets[kind]
    return list(dict.fromkeys(w.lower() for w in words))


def word_value(word: str) -> float | int | None:
    """The value of one number word: cardinal, ordinal, plural, denominator or magnitude."""
    w = word.strip().lower()
    for table in (cardinals(), ordinals()):
        if w in table:
            return table[w]
    singular = next((s for s in (w[:-3] + "y" if w.endswith("ies") else "", w[:-2] if w.endswith("xes") else "", w[:-1]) if s in cardinals() or s in magnitudes()), w) if w.endswith("s") else w
    if singular in cardinals():
        return cardinals()[singular]
    if w in denominators():
        return denominators()[w]
    k = magnitudes().get(singular)
    return None if k is None else 10 ** (3 * k)


def vocabulary(spark: SparkSession) -> DataFrame:
    """(kind, term, value): all number words, colloquial terms, constants and custom terms."""
    rows = [("cardinal", w, float(n)) for w, n in cardinals().items()]
    rows += [("ordinal", w, float(n)) for w, n in ordinals().items()]
    rows += [("denominator", w, v) for w, v in denominators().items()]
    rows += [("magnitude", w, float(10 ** (3 * k))) for w, k in magnitudes().items()]
    rows += [("colloquial", w, None) for w in COLLOQUIAL] + [("constant", w, None) for w in CONSTANTS] + [("custom", w, None) for w in CUSTOM_TERMS]
    return spark.createDataFrame(rows, "kind string, term string, value double")


def blacklist(vocab: DataFrame) -> DataFrame:
    """Terms that count as numbers in a sentence; terms with digits are left to the digit rule, ``less`` is removed."""
    return vocab.where(~F.col("term").rlike("[1-9²³]") & (F.col("term") != LEFT_OUT)).select(F.lower("term").alias("term")).distinct()


@cache
def blacklisted_terms() -> tuple[str, ...]:
    """The same terms as a list, for one pattern over all of them."""
    terms = {*basic_number_words(), *COLLOQUIAL, *CONSTANTS, *CUSTOM_TERMS} - {LEFT_OUT}
    return tuple(sorted({t.lower() for t in terms if not any(c in "123456789²³" for c in t)}))
