"""Personal data in texts, in DataFrame functions only.

Patterns propose spans (code points, end exclusive), validators confirm them: Luhn for cards, mod 97 for IBANs, number ranges for
addresses. Words near a span raise its score. Null text counts as empty.
The patterns start only where a run starts, so that a long run is not tried again from each of its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}(?:\x20?+[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CONTEXT = {
    "email": "e-?mail|contact|write|kontakt|correo|courriel",
    "ip": "server|host|address|login|adresse",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|telefon|tel[eé]fono",
    "iban": "iban|bank|account|konto|cuenta|compte",
}


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value): what lies between matches and the matches themselves give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("value"), F.length(b).alias("gap")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    chars = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(v)).between(12, 19), luhn(v)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(v, " ", "")).between(15, 34), mod97(v)).otherwise(False)
    return F.lit(True)


_PATTERNS = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, None), "phone": (PHONE, "+"), "iban": (IBAN, None)}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = 40) -> DataFrame:
    """All columns of ``docs`` and ``pii``: array of (start, end, kind_no, kind, score), in order of start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_text", text)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    for kind, (pattern, needs) in _PATTERNS.items():
        spans = _spans(F.col("_text"), pattern)
        some = F.col("_text").contains(needs) if needs else F.col("_text").rlike("[0-9]")
        out = out.withColumn(f"_{kind}", F.when(some, spans).otherwise(none))

    def rate(kind: str, no: int):
        def of(s: Column) -> Column:
            around = F.lower(F.substr(F.col("_text"), F.greatest(s["start"] - near + 1, F.lit(1)), s["end"] - s["start"] + 2 * near))
            score = F.when(around.rlike(CONTEXT[kind]), 0.95).otherwise(0.75)
            return F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

        return of

    def holds(kind: str):
        return lambda s: _valid(kind, s["value"])

    rated = [F.transform(F.filter(f"_{k}", holds(k)), rate(k, i)) for i, k in enumerate(KINDS)]
    return out.withColumn("pii", F.array_sort(F.concat(*rated))).drop("_text", *[f"_{k}" for k in KINDS])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("pii", lambda s: s["kind"] != "iban")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"),
                        F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"))


def masked(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced once, by the first."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def add(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.when(fresh, s["end"]).otherwise(F.greatest(a["at"], s["end"])).alias("at"), F.when(fresh, piece).otherwise(a["out"]).alias("out"))

    done = F.aggregate("pii", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("pii") > 0, done).otherwise(F.col(text_col))).drop("pii")
