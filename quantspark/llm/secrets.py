"""Secret scans with a random forest that removes false positives, in DataFrame functions and JVM learners alone.

Candidates are all long runs of key-like characters with a digit (dots may join them, as in web tokens), any value after
a credential name, passwords in addresses, and blocks that hold a private key; a word without blanks, as in minified
JSON or a query string, can hold many. Each is described by its length, the probability of its transitions from character
to character, its variety, how much of it words of the corpus cover, the path of its document and the words around it.
Transitions (a table of at most ``len(SYMBOLS) ** 2`` rows) and the dictionary come from the words of all documents.

A random forest, trained from labelled findings, tells secrets from checksums, identifiers, card and version numbers,
names and placeholders. ``labelled_findings`` makes a table of findings of known kinds. Their labels follow from what a
value is, not from where it stands: a key of a known form is a secret after any words, a card number or a host name after
none. Random hexadecimal and base64 text alone is labelled by its surroundings, as nothing else tells a key from a
checksum. Own findings with the same columns can be given instead or added.

Texts without a digit, a credential name or a password in an address are dropped before they are split. Candidates
leave the scan as their features, a digest, and hashes of the words in them: nothing that is written or shuffled
holds a secret or the words around it. What is shuffled are these rows, and the distinct words of the corpus.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.llm.store import cut

CREDENTIAL = r"(?i)(secret|password|passwd|pwd|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
BENIGN = r"(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|uuid|revision|build|version|licen[cs]e|card|order|invoice|phone|isbn|id)"
PLACEHOLDER = r"(?i)(example|placeholder|dummy|changeme|your|sample|xxxx|\*\*\*|0000|1234567)"
TEST_PATH = r"(?i)(test|example|mock|fixture|sample|doc|readme)"
VALUE = r"[\x22\x27]?([^\x22\x27\s,;]{8,})"
# No pattern repeats a group: these recurse in Java, and a very long word would exhaust the stack.
#: A whole run with a digit; a credential's name with its value, which ends at its quote or before the next name of a query.
DIGIT_RUN = r"(?<![A-Za-z0-9+/_=\-.])(?=[A-Za-z+/_=\-.]*+[0-9])[A-Za-z0-9+/_=\-][A-Za-z0-9+/_=\-.]{14,}[A-Za-z0-9+/_=\-]"
NAMED_VALUE = CREDENTIAL + r"[\x22\x27]?[=:](?:[\x22\x27][^\x22\x27\s]{8,}|[^\x22\x27\s,;]{8,}?(?=&[\w.\-]+=|[\x22\x27\s,;]|$))"
URL_PASSWORD = r"://[^\s:/@]+:([^\s@/]{4,})@"
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)"
SPACE = r"[\x20\x09-\x0D]+"
#: Words that programs name things with, beside those of the corpus (fixed values).
PROGRAM_WORDS = "get set new old add put run map key list name type data file path user test item node text line code size time date year month week hour start end open close read write send load save make take give find show hide move copy call back next last first left right upper lower index value count total result error debug info warn config option default public private static class function method object string number array table column query request response server client service session cookie header footer button widget window screen image video audio token hash version release update create delete remove insert select order group where limit example sample host mail backup main"
#: A word of the corpus is in the dictionary from so many occurrences on.
LEAST_COUNT = 5
#: What transitions are counted between: a start, letters without case, any digit, any other character.
SYMBOLS = "^abcdefghijklmnopqrstuvwxyz0."
FEATURES = ("length", "transitions", "class_changes", "variety", "vowels", "covered", "digits", "capitals", "is_hex", "is_number", "longest_run", "test_path", "credential_before", "assigned", "benign_before", "placeholder", "quoted", "known_prefix", "in_address", "key_block", "dots")

_PREFIX = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_|sk[-_]|xox[abprs]-|eyJ|AIza|glpat-|SG\.)"
_CHANGE = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, place (the word's number in its text), candidate, raw word, before (three words), after, path.

    Null and empty texts have none. Other columns of docs are ignored; without a ``path`` column paths are empty.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), "text").where(F.col("text").rlike("[0-9]") | F.col("text").rlike(CREDENTIAL) | F.col("text").rlike(URL_PASSWORD))
    words = some.select("doc_id", "path", F.split(F.regexp_replace("text", f"^{SPACE}|{SPACE}$", ""), SPACE).alias("words"))

    def word(at: Column) -> Column:
        return F.coalesce(F.get("words", at), F.lit(""))

    def announced(i: Column) -> Column:
        """Whether the words before say that a value follows."""
        return word(i - 1).rlike("[=:]$") & F.concat(word(i - 2), word(i - 1)).rlike(CREDENTIAL)

    def marked(w: Column, i: Column) -> Column:
        return F.when(w.rlike(DIGIT_RUN) | w.rlike(NAMED_VALUE) | w.rlike(URL_PASSWORD) | ((F.length(w) >= 8) & announced(i)), i)

    def address_password(w: Column) -> Column:
        """The password of an address, as an array of at most one finding."""
        found = F.regexp_extract(w, URL_PASSWORD, 1)
        ahead = F.regexp_extract(w, r"^(.*://[^\s:/@]+:)[^\s@/]{4,}@", 1)
        return F.when(found != "", F.array(F.struct(found.alias("candidate"), found.alias("raw"), ahead.alias("ahead"), F.lit(True).alias("first")))).otherwise(none)

    none = F.array().cast("array<struct<candidate:string,raw:string,ahead:string,first:boolean>>")

    def finding(candidate: Column, ahead: Column, behind: Column, first: Column) -> Column:
        """A candidate with the quotes around it, and the text of its word just before it."""
        opening, closing = F.regexp_extract(ahead, r"[\x22\x27]$", 0), F.regexp_extract(behind, r"^[\x22\x27]", 0)
        return F.struct(candidate.alias("candidate"), F.concat(opening, candidate, closing).alias("raw"), F.regexp_replace(ahead, r"[\x22\x27]$", "").alias("ahead"), first.alias("first"))

    def named_values(gap: Column, first: Column) -> Column:
        def split(m: Column) -> Column:
            name = F.regexp_extract(m, r"^[^=:]*[=:][\x22\x27]?", 0)
            return finding(F.substring(m, F.length(name) + 1, F.length(m)), name, F.regexp_extract(name, r"[\x22\x27]$", 0), first)

        return F.transform(F.regexp_extract_all(gap, F.lit(f"({NAMED_VALUE})"), F.lit(1)), split)

    places = F.filter(F.transform("words", marked), lambda i: i.isNotNull())
    found = words.select("doc_id", "path", "words", F.explode(places).alias("place"))
    place = F.col("place")
    found = found.withColumn("word", F.get("words", place))
    found = found.withColumns({"runs": F.regexp_extract_all("word", F.lit(f"({DIGIT_RUN})"), F.lit(1)), "gaps": F.split("word", DIGIT_RUN, -1)})
    in_runs = F.transform("runs", lambda run, k: finding(run, F.get("gaps", k), F.get("gaps", k + 1), k == 0))
    in_gaps = F.flatten(F.transform("gaps", lambda gap, k: named_values(F.when(k < F.size("runs"), F.regexp_replace(gap, "&$", "")).otherwise(gap), k == 0)))
    value = F.regexp_extract(F.regexp_replace("word", "^[^=:]*[=:]", ""), VALUE, 1)
    whole = F.struct(value.alias("candidate"), F.col("word").alias("raw"), F.lit("").alias("ahead"), F.lit(True).alias("first"))
    password = address_password(F.col("word"))
    others = F.filter(F.concat(in_runs, in_gaps), lambda f: ~F.exists(password, lambda p: p["candidate"] == f["candidate"]))
    found = found.withColumn("all", F.concat(password, others))
    found = found.withColumn("c", F.explode(F.when(F.size("all") > 0, F.col("all")).otherwise(F.array(whole))))
    earlier = F.when(F.col("c.first"), F.concat_ws(" ", *[word(place - k) for k in (3, 2, 1)]))
    before = F.concat_ws(" ", earlier, F.nullif(F.col("c.ahead"), F.lit("")))
    out = found.select("doc_id", "place", "c.candidate", "c.raw", before.alias("before"), word(place + 1).alias("after"), "path")
    return out.unionByName(_key_blocks(docs, where)).where("candidate <> ''")


def _key_blocks(docs: DataFrame, where: Column) -> DataFrame:
    """Whole private keys, which have lines; the place is that of their first word."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), "text").where(F.col("text").contains("PRIVATE KEY-----"))
    blocks = some.select("doc_id", "path", F.split("text", KEY_BLOCK, -1).alias("gaps"), F.posexplode(F.regexp_extract_all("text", F.lit(f"({KEY_BLOCK})"), F.lit(1))).alias("k", "candidate"))
    parts = F.regexp_extract_all(F.array_join(F.slice("gaps", F.lit(1), F.col("k") + 1), " x x "), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    earlier = F.size(parts)
    return blocks.select("doc_id", earlier.alias("place"), "candidate", F.col("candidate").alias("raw"), F.array_join(F.slice(parts, F.greatest(F.lit(1), earlier - 2), F.lit(3)), " ").alias("before"), F.lit("").alias("after"), "path")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) for all words of all texts, in lower case."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def symbols_of(text: Column) -> Column:
    """A text in SYMBOLS, with its start."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[^a-z0]", "."))


def transitions(counts: DataFrame) -> dict[str, float]:
    """The logarithm of the probability of each symbol after each other one, over all words; never more than ``len(SYMBOLS) ** 2``."""
    shown = counts.select("n", F.split(symbols_of(F.col("word")), "").alias("c"))
    pairs = shown.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.concat(F.get("c", i), F.get("c", i + 1)))).alias("pair"))
    found = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    table = {}
    for a in SYMBOLS:
        total = sum(found.get(a + b, 0) for b in SYMBOLS) + len(SYMBOLS)
        table |= {a + b: math.log((found.get(a + b, 0) + 1) / total) for b in SYMBOLS}
    return table


def _words_of(candidate: Column) -> Column:
    """Hash and length of the words that capitals, digits and signs set apart in a candidate."""
    words = F.filter(F.regexp_extract_all(candidate, F.lit(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)), lambda w: F.length(w) > 2)
    return F.transform(words, lambda w: F.struct(F.xxhash64(F.lower(w)).alias("word"), F.length(w).alias("size")))


def _covered(findings: DataFrame, counts: DataFrame) -> DataFrame:
    """``findings`` (with ``__id``, ``__words``) with ``covered``: the share of characters in words of the dictionary."""
    runs = findings.select("__id", F.inline("__words"))
    program = runs.sparkSession.createDataFrame([(w,) for w in sorted(set(PROGRAM_WORDS.split()))], "word string")
    known = counts.where(F.col("n") >= LEAST_COUNT).select("word").unionByName(program).select(F.xxhash64("word").alias("word"))
    known = known.join(runs.select("word").distinct(), "word", "left_semi").distinct()
    covered = runs.join(known, "word").groupBy("__id").agg(F.sum("size").alias("__n"))
    joined = findings.join(covered, "__id", "left")
    return joined.withColumn("covered", F.coalesce(F.col("__n") / F.col("length"), F.lit(0.0))).drop("__n", "__id", "__words")


def described(findings: DataFrame, counts: DataFrame, table: dict[str, float]) -> DataFrame:
    """``findings`` (candidate, raw, before, after, path) with FEATURES and secret_sha256 in place of these columns."""
    rest = [name for name in findings.columns if name not in ("candidate", "raw", "before", "after", "path")]
    c = F.col("candidate")
    size = F.length(c)
    near = F.concat_ws(" ", "before", F.regexp_replace("raw", r"[\x22\x27].*$", ""))
    runs = F.regexp_extract_all(c, F.lit(r"((.)\2*)"), F.lit(1))
    # The table as one array by places of both symbols; a candidate's characters as an array, so that no text is searched.
    likely = F.array(*[F.lit(table[a + b]) for a in SYMBOLS for b in SYMBOLS])
    at = F.transform(F.split(symbols_of(c), ""), lambda x: F.instr(F.lit(SYMBOLS), x) - 1)
    findings = findings.withColumn("__at", at)
    steps = F.transform(F.sequence(F.lit(0), F.size("__at") - 2), lambda i: F.get(likely, F.get("__at", i) * len(SYMBOLS) + F.get("__at", i + 1)))
    columns = {
        "length": size,
        "transitions": F.aggregate(steps, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0))) / size,
        "class_changes": F.regexp_count(c, F.lit(_CHANGE)) / size,
        "variety": F.size(F.array_distinct(F.split(c, ""))) / size,
        "vowels": F.regexp_count(c, F.lit("(?i)[bcdfghj-np-tv-z][aeiou]")) / size,
        "digits": F.regexp_count(c, F.lit("[0-9]")) / size,
        "capitals": F.regexp_count(c, F.lit("[A-Z]")) / size,
        "is_hex": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "is_number": c.rlike("^[0-9-]+$"),
        "longest_run": F.array_max(F.transform(runs, lambda r: F.length(r))),
        "test_path": F.col("path").rlike(TEST_PATH),
        "credential_before": near.rlike(CREDENTIAL),
        "assigned": near.rlike(r"[=:]\s*$") | F.col("raw").rlike("^[A-Za-z_]+[=:]"),
        "benign_before": near.rlike(BENIGN),
        "placeholder": F.concat_ws(" ", "before", "raw", "after").rlike(PLACEHOLDER),
        "quoted": F.col("raw").rlike(r"[\x22\x27]"),
        "known_prefix": c.rlike(_PREFIX),
        "in_address": F.col("before").rlike(r"://[^\s:/@]+:$"),
        "key_block": c.startswith("-----BEGIN "),
        "dots": F.regexp_count(c, F.lit(r"\.")),
    }
    made = findings.select(*rest, F.sha2(c, 256).alias("secret_sha256"), _words_of(c).alias("__words"), *[F.coalesce(value.cast("double"), F.lit(0.0)).alias(name) for name, value in columns.items()])
    # Numbered once for good, as rows are joined back by their number.
    return _covered(cut(made.withColumn("__id", F.monotonically_increasing_id())), counts)


def labelled_findings(spark: SparkSession, n: int = 6_000, seed: int = 3) -> DataFrame:
    """``n`` findings of known kinds with label 1 for secrets: candidate, raw, before, after, path, label."""
    rows = spark.range(0, n, 1, 1).withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), "id"), 512))

    def pick(values: tuple[str, ...], salt: int) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    b64 = F.regexp_replace(F.base64(F.unhex("h")), r"[\r\n=]", "")
    upper = F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", ""))
    number = F.substring(F.translate("h", "abcdef", "123456"), 1, 16)
    name = F.concat(pick(("get", "set", "load", "find", "update"), 1), pick(("User", "Session", "Order", "Table", "Image"), 2), pick(("Config", "Version", "Index", "Request", "Header"), 3), pick(("2", "10", "V3", "Test4", "Default1"), 4))
    flat = F.regexp_replace(b64, "[+/]", "a")
    host = F.concat(pick(("mail2", "web01", "db10", "node7"), 17), F.lit("."), pick(("backup", "main", "internal", "example"), 18), F.lit("."), pick(("server", "office", "cluster", "sample"), 19), F.lit(".com"))
    file = F.concat(pick(("src/main/", "docs/images/", "data/2021/"), 20), pick(("version", "table", "report", "image"), 21), F.substring(number, 1, 3), pick((".json", ".html", ".txt"), 22))
    block = F.concat_ws("\n", F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.substring(b64, 1, 64), F.substring(b64, 20, 64), F.lit("-----END RSA PRIVATE KEY-----"))
    address = F.lit("postgres://admin:")
    by_words = F.lit(None).cast("int")
    kinds = [
        # candidate, and whether it is a secret wherever it stands; null: its surroundings tell
        (F.substring("h", 1, 40), by_words), (F.substring("h", 1, 64), by_words), (F.substring(b64, 1, 44), by_words), (F.substring("h", 1, 32), by_words), (F.substring("h", 1, 40), by_words), (F.substring(b64, 1, 24), by_words),
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.lit(1)), (F.concat(pick(("ghp_", "sk_live_", "xoxb-", "glpat-"), 5), F.substring(flat, 1, 36)), F.lit(1)),
        (F.concat(F.substring(b64, 1, 9), pick(("!", "#", "$7", "_x"), 6)), F.lit(1)), (F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9."), F.substring(flat, 1, 40), F.lit("."), F.substring(flat, 40, 40)), F.lit(1)),
        (F.concat(F.substring(flat, 1, 10), pick(("!", "9", "x"), 23)), F.lit(1)), (block, F.lit(1)),
        (number, F.lit(0)), (number, F.lit(0)), (name, F.lit(0)), (F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)), F.lit(0)),
        (F.repeat(F.substring("h", 1, 2), 12), F.lit(0)), (F.concat(pick(("YOUR_", "example-", "sample_", "dummy-"), 7), pick(("API_KEY_1234567", "secret-value-0000", "token-xxxx-123"), 8)), F.lit(0)), (host, F.lit(0)), (file, F.lit(0)),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    chosen = F.coalesce(*[F.when(kind == k, value) for k, (value, _) in enumerate(kinds)])
    known = F.coalesce(*[F.when(kind == k, secret) for k, (_, secret) in enumerate(kinds)])
    good = pick(("token =", "api_key =", "password :", "secret =", "Authorization: Bearer", "set access_key =", "the auth token:", "apiKey:"), 9)
    bad = pick(("commit", "sha256:", "checksum =", "uuid", "revision", "order number", "card", "build id =", "call", "in the file", "see", "license id"), 10)
    plain = pick(("with", "and", "the", ""), 13)
    # Surroundings by a number of their own; a value after a password's name in an address is always one of kind 10.
    place = F.pmod(F.xxhash64("h", F.lit(11)), F.lit(3))
    in_address = kind == 10
    around = F.when(in_address, address).otherwise(F.when(place == 0, good).when(place == 1, bad).otherwise(plain))
    label = F.coalesce(known, F.when(place == 0, 1).otherwise(0))
    before = F.concat_ws(" ", pick(("", "thus we", "and the", "where", "la"), 12), around)
    quote = F.when(F.pmod(F.xxhash64("h", F.lit(14)), F.lit(3)) > 0, F.lit('"')).otherwise(F.lit(""))
    path = pick(("src1", "src/main.py", "app/config.yml", "tests/test_main.py", "docs/readme.md", "src7", "web/index.js"), 15)
    return rows.select(chosen.alias("candidate"), F.concat(quote, chosen, quote).alias("raw"), before.alias("before"), pick(("", "and", "then", ";", "the"), 16).alias("after"), path.alias("path"), label.cast("double").alias("label"))


def _vectors(findings: DataFrame, counts: DataFrame, table: dict[str, float]) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(findings, counts, table))


def train(labelled: DataFrame, counts: DataFrame, table: dict[str, float], trees: int = 40, depth: int = 9, seed: int = 17) -> RandomForestClassificationModel:
    """The forest; labelled findings are few, and its cost doesn't grow with the corpus."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8)
    return forest.fit(_vectors(labelled, counts, table).select("features", "label"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """Each candidate of each text: doc_id, place, length, score, is_secret, secret_sha256. Secrets themselves stay out.

    Null and empty texts have none; a very long text has as many as it holds, and only candidates leave its row. Several
    candidates, repeated rows and rows that share a doc_id (null too) each give rows of their own; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    counts = cut(word_counts(docs))
    table = transitions(counts)
    model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession), counts, table)
    scored = model.transform(_vectors(candidates(docs, path), counts, table))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "place", F.col("length").cast("int").alias("length"), F.round(score, 6).alias("score"), (score >= threshold).alias("is_secret"), "secret_sha256")
