"""Secrets in texts: fixed patterns, and a battery of randomness tests. DataFrame functions only.

Long tokens are candidates. Each is read in the smallest encoding that holds it, and three
tests ask how probable it is that an ordinary token of its length (words, identifiers,
paths) is at least as random:

* chi-squared: the counts of the symbols of the alphabet are too even;
* runs: the class of character (capital, small, digit, sign) changes too often;
* serial correlation: a symbol says too little about the next one.

Each test gives a bound on a tail probability (of a normal deviate, exp(-z*z/2)); Fisher's
method joins them. The tokens of an encoding and a range of lengths form a family, in which
the share of false discoveries is held below a rate (Benjamini and Hochberg), over all
documents: the more of a family is random, the less a single token has to show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The patterns of the kinds. Of an `assign` match, group 2 is the value.
ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
          "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{12,}"          # 16 characters at least: the same matches as of AKIA[A-Z0-9]+ that long
HEX = "[0-9a-f]{32,}"
VALUE_CHARS = 8                       # of a value, at least
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"  # candidates of the battery
KINDS = ["assign", "access", "hex", "random"]

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Encodings, first fit: name, pattern, alphabet, and two rates of ordinary tokens written in
# it: how often two symbols are equal, and how often neighbours differ in class.
ENCODINGS = [
    ("digits", "^[0-9]+$", _DIGITS, 0.15, 0.0),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + _LOWER[:6], 0.10, 0.20),
    ("letters", "^([a-z]+|[A-Z]+)$", _LOWER, 0.065, 0.0),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567", 0.065, 0.10),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", _DIGITS + _LOWER, 0.065, 0.15),
    ("base64", "", _UPPER + _LOWER + _DIGITS + "+/", 0.065, 0.25),
]
CORRELATION = 0.25                    # of neighbours in ordinary tokens
CUBES = 0.35                          # sum of cubed frequencies: this much above the squared rate of equal symbols
LENGTHS = [24, 32, 48, 64, 96, 128, 256]      # where families of lengths begin
STEPS, LEVELS = 8, 800                # -ln p is kept in steps of an eighth, up to 100
RATE = 0.01                           # false discoveries allowed in a family
CLASS_RUNS = "[A-Z]+|[a-z]+|[0-9]+|[+/]+"
CHUNK = 512


# What a lambda function refers to outside its own arguments is worked out anew for each
# element, so the steps below hand on their results as columns, arguments or fields.

def _sums(xs: Column) -> Column:
    """Running sums of an array<bigint>, appended one by one."""
    return F.aggregate(xs, F.array().cast("array<bigint>"), lambda acc, x: F.concat(
        acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + x)))


def _chunked(steps: Column) -> Column:
    """Running sums within chunks: appending copies what is there, so it must stay short."""
    chunks = F.sequence(F.lit(0), F.ceil(F.size(steps) / CHUNK).cast("int") - 1)
    return F.when(F.size(steps) > 0, F.transform(chunks, lambda c: _sums(F.slice(steps, c * CHUNK + 1, CHUNK))))


def _joined(chunks: Column) -> Column:
    """Running sums of the whole, from those within chunks."""
    before = F.concat(F.array(F.lit(0).cast("long")), _sums(F.transform(chunks, lambda xs: F.element_at(xs, -1))))
    return F.flatten(F.zip_with(chunks, F.slice(before, 1, F.size(chunks)), lambda xs, o: F.transform(xs, lambda x: x + o)))


def _with_spans(found: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The arrays of matches become array<struct<start, end, found>>, in code points, null
    without a match. What lies between the matches gives their places."""
    def steps(kind: str) -> Column:
        gaps = F.when(F.size(kind) > 0, F.split("text", patterns[kind], -1))
        return F.zip_with(F.slice(gaps, 1, F.size(kind)), F.col(kind), lambda g, f: (F.length(g) + F.length(f)).cast("long"))

    stepped = found.select("doc_id", *patterns, *[steps(k).alias(f"{k}_at") for k in patterns])
    chunked = stepped.select("doc_id", *patterns, *[_chunked(F.col(f"{k}_at")).alias(f"{k}_at") for k in patterns])
    return chunked.select("doc_id", *[F.zip_with(F.when(F.size(k) > 0, F.col(k)), _joined(F.col(f"{k}_at")), lambda f, e: F.struct(
        (e - F.length(f)).alias("start"), e.alias("end"), f.alias("found"))).alias(k) for k in patterns])


def _encoded(token: Column) -> Column:
    """struct<encoding, body>: the smallest encoding that holds the token without padding."""
    encoding = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        encoding = F.when(F.rtrim(token, F.lit("=")).rlike(ENCODINGS[i][1]), i).otherwise(encoding)
    return F.struct(encoding.alias("encoding"), F.rtrim(token, F.lit("=")).alias("body"))


def _folded(t: Column) -> Column:
    """Adds length, alphabet and rates of the encoding; the body in the alphabet's signs."""
    def of(column: int) -> Column:
        return F.get(F.array(*[F.lit(e[column]) for e in ENCODINGS]), t["encoding"])

    body = F.when(t["encoding"] == 5, F.translate(t["body"], "-_", "+/")).when(t["encoding"] == 3, t["body"]).otherwise(F.lower(t["body"]))
    return F.struct(t["encoding"].alias("encoding"), F.length(t["body"]).cast("double").alias("n"), of(2).alias("alphabet"),
                    of(3).alias("equal"), of(4).alias("changes"), body.alias("body"))


def _placed(t: Column) -> Column:
    """Adds twice the distance of each sign from the middle of the alphabet, a whole
    number, and the squared counts of the symbols."""
    places = F.transform(F.split(t["body"], ""), lambda c: (2 * F.instr(t["alphabet"], c) - 1 - F.length(t["alphabet"])).cast("long"))
    squares = F.aggregate(F.split(t["alphabet"], ""), F.lit(0).cast("long"), lambda acc, s: acc + F.pow(
        F.length(t["body"]) - F.length(F.replace(t["body"], s, F.lit(""))), F.lit(2)).cast("long"))
    return F.struct(t["encoding"].alias("encoding"), t["n"].alias("n"), t["equal"].alias("equal"), t["changes"].alias("changes"),
                    squares.alias("squares"), F.regexp_count(t["body"], F.lit(CLASS_RUNS)).alias("runs"), places.alias("v"))


def _weighed(t: Column) -> Column:
    """The three tests: struct<encoding, n, weight>, the weight being the sum of -ln p."""
    n = t["n"]
    equal = (t["squares"] - n) / (n * (n - 1))
    spread = 2 * t["equal"] * (1 - t["equal"]) / (n * (n - 1)) + 4 * CUBES * t["equal"] * t["equal"] / n
    z_even = (t["equal"] - equal) / F.sqrt(spread)
    z_runs = F.when(t["changes"] > 0, ((t["runs"] - 1) / (n - 1) - t["changes"]) / F.sqrt(
        t["changes"] * (1 - t["changes"]) / (n - 1))).otherwise(0.0)
    zero, most = F.lit(0).cast("long"), F.size(t["v"]) - 1
    total = F.aggregate(t["v"], zero, lambda acc, v: acc + v * v)
    pairs = F.aggregate(F.zip_with(F.slice(t["v"], 1, most), F.slice(t["v"], 2, most), lambda a, b: a * b), zero, lambda acc, v: acc + v)
    z_serial = (CORRELATION - F.abs(F.when(total > 0, pairs / total).otherwise(1.0))) * F.sqrt(n)
    weight = F.lit(0.0)
    for z in (z_even, z_runs, z_serial):
        weight = weight + F.when(z > 0, z * z / 2).otherwise(0.0)
    return F.struct(t["encoding"].alias("encoding"), n.alias("n"), weight.alias("weight"))


def _levelled(t: Column) -> Column:
    """Fisher's method for three tests: the tail of chi-squared with six degrees of freedom."""
    logged = t["weight"] - F.log(1 + t["weight"] + t["weight"] * t["weight"] / 2)
    family = t["encoding"] * (len(LENGTHS) + 1)
    for bound in LENGTHS:
        family = family + F.when(t["n"] >= bound, 1).otherwise(0)
    return F.struct(family.cast("int").alias("family"), F.least(F.floor(logged * STEPS), F.lit(LEVELS)).cast("int").alias("level"))


def levels(tokens: Column) -> Column:
    """array<string> as array<struct<family, level>>: the family of each token and its
    -ln p in steps."""
    for step in (_encoded, _folded, _placed, _weighed, _levelled):
        tokens = F.transform(tokens, step)
    return tokens


def _of_kind(spans: Column, kind: int) -> Column:
    """array<struct<start, kind, end>>, empty without spans."""
    out = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    return F.coalesce(out, F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def _search(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens): spans of the fixed kinds and of the candidates."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = text.select("doc_id", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()])
    spans = _with_spans(found, patterns)
    valued = F.filter("assign", lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= VALUE_CHARS)
    base = [_of_kind(c, kind) for kind, c in enumerate([valued, F.col("access"), F.col("hex")])]
    out = spans.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), "token", levels(F.transform(
        "token", lambda s: s["found"])).alias("m"))
    return out.select("doc_id", "base", F.zip_with("token", "m", lambda s, m: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), m["family"].alias("family"), m["level"].alias("level"))).alias("tokens"))


def discovery_levels(tokens: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each family of tokens(family, level) that has discoveries the level they begin
    at: the lowest where the tokens expected of an ordinary family are at most `rate` of
    those found. The counts are at most LEVELS rows a family, whatever the corpus."""
    counts = tokens.groupBy("family", "level").agg(F.count(F.lit(1)).alias("n"))
    family = Window.partitionBy("family")
    above = family.orderBy(F.desc("level"))
    ranked = counts.select("family", "level", F.sum("n").over(family).alias("all"), F.sum("n").over(above).alias("found"))
    begin = ranked.where(F.col("all") * F.exp(-F.col("level") / STEPS) <= rate * F.col("found")).groupBy("family").agg(
        F.min("level").alias("level"))
    return {r["family"]: r["level"] for r in begin.collect()}


def scan_secrets(docs: DataFrame, folder: str, rate: float = RATE) -> DataFrame:
    """docs(doc_id, text) as (doc_id, spans array<struct<start, kind, end>>), one row each,
    spans by start, then kind (its number in KINDS), in code points, the end exclusive.

    The matches of a kind do not overlap each other, those of two kinds may. Null and
    empty texts have no span. Repeated rows, also those without doc_id, give a row each;
    other columns are left out. An empty table gives no row. Texts are searched once, by
    rows, without a shuffle; `folder`, shared, holds what was found."""
    spark = docs.sparkSession
    _search(docs).write.parquet(folder)
    found = spark.read.parquet(folder)
    levels = discovery_levels(found.select(F.explode("tokens").alias("t")).select("t.family", "t.level"), rate)
    families = range(len(ENCODINGS) * (len(LENGTHS) + 1))
    least = F.array(*[F.lit(levels.get(f, LEVELS + 1)) for f in families])
    random = F.filter("tokens", lambda t: t["level"] >= F.get(least, t["family"]))
    return found.select("doc_id", F.array_sort(F.concat("base", _of_kind(random, 3))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
