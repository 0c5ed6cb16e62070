"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores.

Everything is an expression over built-in SQL functions; the scan stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of

# The length of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}


@dataclass(frozen=True)
class Kind:
    """pattern: for Java, written so that matching is linear (possessive runs that start where a run can start).
    plain: the same language and the same leftmost matches in a dialect without look-behind.
    gate: a pattern without which there can be no match, or None.
    score: of a confirmed span; context: words that, just before a span, raise its score."""

    name: str
    pattern: str
    plain: str
    score: float
    context: str


def _near(words: str) -> str:
    """One of the words between characters that aren't letters; the same in both dialects."""
    return rf"(?i)(^|[^A-Za-z])({words})([^A-Za-z]|$)"


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        0.9,
        _near("e-?mail|mail|contact|correo|courriel|kontakt"),
    ),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0.6, _near("ip|host|server|address|login")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", 0.7, _near("card|visa|credit|karte|carte|tarjeta")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, _near("phone|call|tel|fax|mobile")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", 0.8, _near("iban|account|bank|konto|compte|cuenta")),
    # Bare values that only a word before them makes a secret (see CONFIRMING).
    Kind("secret", r"[A-Za-z0-9_+/=-]{16,}+", r"[A-Za-z0-9_+/=-]{16,}", 0.5, _near("token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|bearer|authorization")),
    Kind("key", r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}", r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}", 0.9, _near("token|secret|key|aws|github|slack")),
)
BASE = ("email", "ip", "card", "phone")
#: Kinds whose spans stand only where a context word is near, and so need a score above their own.
CONFIRMING = ("secret",)
#: Code points before a span in which context words count.
REACH = 40
RAISE = 0.1


def _mod97(compact: Column) -> Column:
    """The IBAN check value: 1 for a valid number."""
    moved = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    value = lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c < "A", 10).otherwise(100) + value(c)) % 97))


def _confirmed(kind: str, match: Column) -> Column:
    """Whether the checks of the kind hold for a match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.substring(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), -3, 3) <= "255")
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "key":
        return F.lit(True)
    if kind == "secret":  # letters and digits mixed, as names and prose aren't
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.length(match) <= 512)
    compact = F.replace(match, F.lit(" "), F.lit(""))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    return (F.length(compact) == F.try_element_at(lengths, F.substring(compact, 1, 2))) & (_mod97(compact) == 1)


def find_pii(df: DataFrame, text: str = "text", out: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """df with column `out`: array of (kind, start, end, score), by kind as listed in `kinds`, then by start.

    Positions are code points, `end` exclusive. Per kind the matches are leftmost and do not overlap; one that fails its
    checks is dropped and not tried again at another place; spans of different kinds may overlap. A null or empty text has
    an empty array; repeated rows are treated alike; a column named `out` is replaced, other columns stay. Long texts are
    scanned in full, in linear time.
    """
    own = [f"__{x}_{k.name}" for k in kinds for x in ("m", "g", "e")]
    whole = df.withColumn("__t", text_of(text))
    found = whole.withColumns({f"__m_{k.name}": F.regexp_extract_all("__t", F.lit(k.pattern), F.lit(0)) for k in kinds})
    # The text between matches gives the places of the matches.
    gaps = found.withColumns({f"__g_{k.name}": F.when(F.size(f"__m_{k.name}") > 0, F.split("__t", k.pattern, -1)).otherwise(F.array().cast("array<string>")) for k in kinds})

    def ends(k: Kind) -> Column:
        pairs = F.arrays_zip(F.slice(f"__g_{k.name}", 1, F.size(f"__m_{k.name}")).alias("g"), F.col(f"__m_{k.name}").alias("m"))
        start = F.array().cast("array<int>")
        return F.aggregate(pairs, start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(x["g"]) + F.length(x["m"]))))

    placed = gaps.withColumns({f"__e_{k.name}": F.when(F.size(f"__m_{k.name}") > 0, ends(k)).otherwise(F.array().cast("array<int>")) for k in kinds})

    def spans(k: Kind) -> Column:
        raw = F.transform(F.col(f"__m_{k.name}"), lambda m, i: F.struct(F.lit(k.name).alias("kind"), (F.get(f"__e_{k.name}", i) - F.length(m)).alias("start"), F.get(f"__e_{k.name}", i).alias("end"), m.alias("m")))
        good = F.filter(raw, lambda s: _confirmed(k.name, s["m"]))
        near = lambda s: F.substring(F.col("__t"), F.greatest(s["start"] - REACH, F.lit(0)) + 1, F.least(s["start"], F.lit(REACH)))
        scored = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (F.lit(k.score) + F.when(near(s).rlike(k.context), RAISE).otherwise(0.0)).alias("score"))
        kept = F.transform(good, scored)
        if k.name in CONFIRMING:
            kept = F.filter(kept, lambda s: s["score"] > k.score)
        return F.when(F.size(f"__m_{k.name}") > 0, kept).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))

    return placed.withColumn("__out", F.concat(*[spans(k) for k in kinds])).drop("__t", *own, out).withColumnRenamed("__out", out)


def redact(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """df with every span of `spans` replaced by [kind] in `text`; where spans overlap, the one that starts first (then the longest) stands."""
    kept = F.aggregate(
        F.array_sort(F.col(spans), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("text")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["text"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("text"))),
    )
    return df.withColumn("__kept", kept).withColumn(text, F.when(F.size(spans) > 0, F.concat("__kept.text", F.substring(F.col(text), F.col("__kept.at") + 1, F.length(text)))).otherwise(F.col(text))).drop("__kept")


def digest(df: DataFrame, spans: str = "pii") -> DataFrame:
    """Per row: the counts of the base kinds, the digest of the base spans, and all spans as text."""
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    counts = {f"n_{k}": F.size(of(k)).cast("long") for k in BASE}
    return df.withColumns(counts | {"base_sha256": F.sha2(written(base), 256), "spans": written(F.col(spans)), "max_score": F.round(F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)), 2)})
