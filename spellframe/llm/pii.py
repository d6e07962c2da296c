"""Personal data: patterns propose spans, checksums confirm them, context words set a score.

All expressions are Spark functions.  A pattern is run twice, once for its matches and once for the pieces of text
between them; positions are running sums of their lengths.  Patterns begin where a run of their first
characters begins (or at the end of the match before), and repeat possessively: matches are those of the plain
patterns, and a long run of letters or digits is read once instead of from each of its characters.

Kinds: email, ip, card (Luhn), phone, and beyond the base iban (mod 97), ssn (numbers that are given out), nhs (mod 11) and aba
(weighted mod 10).  The score of a span starts at the value of its kind and rises by ``RISE`` when one of its context words stands in the
``NEAR`` characters before or behind it.  Base spans are kept at any score; a span of another kind must reach ``ACCEPT``: an account
number does by itself, the three kinds that are plain numbers only beside a context word.

Cases: null and empty texts have no spans; rows that repeat an id and its text are read alike and give a row each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lowered, repeated, row_key

BASE = ["email", "ip", "card", "phone"]
NEAR = 40
ACCEPT = 0.5
RISE = 0.2
#: A match and the text up to the next one have three characters at least, so this many pieces of text hold NEAR characters.
_PIECES = 2 * (NEAR // 3 + 1)

# Length of an account number by country code.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
                23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
                28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
#: A code takes its length, so that words behind it are not read on.
ACCOUNT = "|".join(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
#: Kinds beyond the base, as whole words.
WORDS = {"iban": ACCOUNT, "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "nhs": "[0-9]{3} [0-9]{3} [0-9]{4}", "aba": "[0-9]{9}"}

# The base patterns, guarded against rescans as said above.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
} | {kind: f"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])" for kind, p in WORDS.items()}
CONTEXT = {"email": "mail|contact|write", "ip": "ip|host|address|server", "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobile|fax",
           "iban": "iban|account|bank|transfer"}
#: Words that must stand near the kinds that their score does not accept alone.
ASKED = {"ssn": "ssn|social security", "nhs": "nhs|patient|health", "aba": "aba|routing|transit"}
CONTEXT |= {kind: f"(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)" for kind, words in ASKED.items()}
START = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.4, "nhs": 0.4, "aba": 0.4}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(at, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number passes the check of its first four characters."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def weighted(value: Column, weights: list[int]) -> Column:
    """Sum of the digits of a number, each with its weight."""
    digits = F.split(F.regexp_replace(value, "[^0-9]", ""), "")
    return F.aggregate(F.zip_with(digits, F.lit(weights), lambda d, w: d.cast("int") * w), F.lit(0), lambda a, x: a + x)


_LISTED = "array<struct<kind:string,since:int,value:string,hinted:boolean>>"


def proposals(text: Column, kind: str) -> Column:
    """Matches of one kind, each with the length of text since the match before and whether a context word is near."""
    pattern = F.lit(PATTERNS[kind])
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    # The text in order, with a match at each second place; of a piece only the NEAR characters at an end can be near a match.
    at = lambda i: 2 * i + 2  # noqa: E731  (place of match i, from 1)
    from_ = lambda i: F.greatest(F.lit(1), at(i) - _PIECES - 1)
    ends = lambda s, end: F.flatten(F.zip_with(s["b"], s["m"], lambda b, m: F.array(end(b, F.lit(NEAR)), end(m, F.lit(NEAR)))))
    # Each stage is the one variable of a lambda, so that its lists are made once and not once per match.
    read = F.array(F.struct(found.alias("m"), between.alias("b")))
    cut = F.transform(read, lambda s: F.struct(s["m"].alias("m"), s["b"].alias("b"), ends(s, F.right).alias("tails"), ends(s, F.left).alias("heads")))
    near = lambda s, i: F.concat_ws("\n", F.right(F.array_join(F.slice(s["tails"], from_(i), at(i) - from_(i)), ""), F.lit(NEAR)),
                                    F.left(F.array_join(F.slice(s["heads"], at(i) + 1, _PIECES + 1), ""), F.lit(NEAR)))
    listed = F.flatten(F.transform(cut, lambda s: F.transform(s["m"], lambda m, i: F.struct(
        F.lit(kind).alias("kind"), F.length(F.get(s["b"], i)).alias("since"), m.alias("value"), F.regexp_like(lowered(near(s, i)), F.lit(CONTEXT[kind])).alias("hinted")))))
    return F.when(_may_hold(text, kind), listed).otherwise(F.array().cast(_LISTED))


def _may_hold(text: Column, kind: str) -> Column:
    """False for texts without any accepted span of the kind, by what each has: a sign, or a context word where the score asks for one."""
    if kind in ("email", "phone"):
        return F.contains(text, F.lit("@" if kind == "email" else "+"))
    if kind in ASKED:
        return F.regexp_like(text, F.lit(f"(?i)(?:{ASKED[kind]})"))
    return F.lit(True)


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    small = F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | (
        (F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    return (F.when(kind == "email", True).when(kind == "ip", small)
             .when(kind == "card", F.length(digits).between(13, 19) & luhn(digits))
             .when(kind == "phone", F.length(digits).between(9, 15)).when(kind == "iban", mod97(value))
             .when(kind == "ssn", ~F.left(digits, F.lit(3)).isin("000", "666") & (F.left(digits, F.lit(1)) != "9") & (F.substr(digits, F.lit(4), F.lit(2)) != "00") & (F.right(digits, F.lit(4)) != "0000"))
             .when(kind == "nhs", weighted(digits, [10, 9, 8, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0)
             .when(kind == "aba", (weighted(digits, [3, 7, 1] * 3) % 10 == 0) & (F.left(digits, F.lit(2)).cast("int").between(1, 12) | F.left(digits, F.lit(2)).cast("int").between(21, 32))))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """Confirmed spans: doc (id and text hash), copies (number of such rows), kind, start, end, value, score; a document without any has one row without a kind."""
    kinds = kinds or list(PATTERNS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.select(row_key(id_col, text_col).alias("doc"), text.alias("t"))
    seen = seen.select("doc", F.posexplode_outer(F.concat(*[proposals(F.col("t"), k) for k in kinds])).alias("nth", "p"))
    seen = seen.select("doc", "nth", "p.*").groupBy("doc", "nth", "kind", "since", "value", "hinted").agg(F.count(F.lit(1)).alias("copies"))
    so_far = Window.partitionBy("doc", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("since") + F.length("value")).over(so_far)
    placed = seen.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    score = F.lit(0.0)
    for kind in kinds:
        score = F.when(F.col("kind") == kind, START[kind]).otherwise(score)
    score = F.round(F.least(F.lit(1.0), score + F.when(F.col("hinted"), RISE).otherwise(0.0)), 2)
    good = F.col("kind").isNotNull() & valid(F.col("kind"), F.col("value")) & (F.col("kind").isin(BASE) | (score >= ACCEPT))
    return placed.select("doc", "copies", F.when(good, F.col("kind")).alias("kind"), "start", "end", "value", score.alias("score"))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, base_sha256, spans and the highest score."""
    order = list(PATTERNS)
    number = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct(number.alias("k"), F.col("start"), F.col("end"), F.col("kind")))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per = pii_spans(docs, id_col, text_col).groupBy("doc").agg(
        F.max("copies").alias("copies"),
        F.array_sort(F.collect_list(span)).alias("all"), F.coalesce(F.max(F.when(F.col("kind").isNotNull(), F.col("score"))), F.lit(0.0)).alias("score"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE])
    base = F.filter("all", lambda s: s["k"] <= len(BASE))
    return repeated(per, "copies").select(F.col("doc.id").alias(id_col), *[f"n_{k}" for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                      joined(F.col("all")).alias("spans"), "score")
