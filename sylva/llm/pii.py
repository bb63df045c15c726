"""Operator 10: personal data, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for
IBANs, number ranges for addresses, digit counts), and words nearby move the score.
The base kinds (email, ip, card, phone) stay whatever their score; spans of the added
kinds (iban, ssn) stay at ``threshold`` or more.

The expressions find what the plain ones in SPEC find, written so that they neither
backtrack nor recurse: runs are possessive, and a match starts only where a run starts
or the last match ended. Null text counts as empty and has no spans; repeated rows are
answered row by row; places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

# fixed values: an IBAN's length by country (ISO 13616 registry, and countries that use IBANs without an entry)
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """The countries of a length take as many characters, in groups of four with or without blanks. Other letters
    take all groups that follow, up to a known country's number."""
    def of(length: int, countries: str) -> str:
        whole, rest = divmod(length - 4, 4)
        return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{whole}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")

    known = "|".join(IBAN_LENGTH.values()).replace(" ", "|")
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{known})[0-9]{{2}}) ?[A-Z0-9]{{4}}){{2,7}}+(?:(?! (?:{known})[0-9]{{2}}) ?[A-Z0-9]{{1,3}}+)?+"
    forms = "|".join([*(of(n, c) for n, c in IBAN_LENGTH.items()), other])
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{forms})(?![A-Za-z0-9])"


# fixed values: the plain expressions of the base kinds
SPEC = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of 14 to 19 digits: other runs would be matched and dropped
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": _iban(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Text without this character has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write to|address",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|master|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "ssn": "ssn|social security|tax",
}
AGAINST = {"ip": "version|release", "card": "order|serial|isbn", "phone": "order|serial", "ssn": "order|serial|part"}
REACH = 40  # code points before a span in which words count
THRESHOLD = 0.6

SPAN = "struct<start:int,kind_no:int,end:int,kind:string,score:double>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    digits = F.reverse(_digits(x))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(x: Column) -> Column:
    flat = F.regexp_replace(x, " ", "")
    turned = F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        v = F.conv(F.substr(turned, i, F.lit(1)), 36, 10).cast("int")
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(r"^(0*+(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)(\.|$)){4}$")
    if kind == "card":
        return luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(x, " ", "")).between(15, 34) & mod97(x)
    if kind == "ssn":
        return ~x.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """The confirmed spans of a kind. Matches and the pieces between them give the places."""
    no, pattern = KINDS.index(kind), F.lit(PATTERN[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, PATTERN[kind], -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        end = begin + F.length(pair["hit"])
        near = F.lower(F.substr(text, F.greatest(begin - REACH, F.lit(0)) + 1, F.least(begin, F.lit(REACH))))
        score = F.lit(SCORE[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), 0.25).otherwise(0.0)
        if kind in AGAINST:
            score = score - F.when(near.rlike(rf"\b(?:{AGAINST[kind]})"), 0.25).otherwise(0.0)
        score = F.least(score, F.lit(1.0))
        span = F.struct(begin.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))
        good = _valid(kind, pair["hit"])
        if kind not in BASE:
            good = good & (score >= THRESHOLD)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))
    out = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    has = text.rlike(PATTERN[kind])
    if kind in NEEDS:
        has = text.contains(NEEDS[kind]) & has
    return F.when(has, out).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, name: str = "pii_spans") -> DataFrame:
    """``docs`` with a column of all spans, by start and then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn(name, F.array_sort(F.concat(*(_spans(k, text) for k in KINDS))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of every row's spans."""
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = F.col("pii_spans")

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    base = F.filter(spans, lambda s: s["kind_no"] < len(BASE))
    return rows.select("doc_id", *counts[: len(BASE)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), *counts[len(BASE) :])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets (overlapping
    spans: the first one's) and n_chars, where there is one, set anew. Null texts stay null."""
    name = "_pii"
    while name in docs.columns:
        name += "_"
    rows = with_spans(docs, name)
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, put).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(F.col(name), start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    out = rows.withColumn("text", F.when(F.size(name) > 0, clean).otherwise(text)).drop(name)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
