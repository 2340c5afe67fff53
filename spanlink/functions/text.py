"""Text normalisation and token functions. Unicode forms run in Arrow UDFs; everything else is built-in."""

from __future__ import annotations

import hashlib
import subprocess
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legal suffixes.
SUFFIXES = ("private", "pvt", "limited", "ltd", "incorporated", "inc", "corporation", "corp", "company", "co", "llc", "llp", "plc", "sarl", "sas", "sa")
#: Scripts and their code-point ranges.
SCRIPTS = {
    "devanagari": r"\x{0900}-\x{097F}", "bengali": r"\x{0980}-\x{09FF}", "gurmukhi": r"\x{0A00}-\x{0A7F}", "gujarati": r"\x{0A80}-\x{0AFF}",
    "oriya": r"\x{0B00}-\x{0B7F}", "tamil": r"\x{0B80}-\x{0BFF}", "telugu": r"\x{0C00}-\x{0C7F}", "kannada": r"\x{0C80}-\x{0CFF}",
    "malayalam": r"\x{0D00}-\x{0D7F}", "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}", "latin": r"\x{0041}-\x{024F}",
}
NOT_WORD = r"[^\p{L}\p{N}_]"
FIELDS = ("name", "address", "phone", "email", "website")


@F.pandas_udf(T.StringType())
def _fold_case(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.StringType())
def _strip_marks(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def _is_ascii(v: Column) -> Column:
    return ~v.rlike(r"[^\x00-\x7F]")


def _only_non_ascii(v: Column, udf) -> Column:
    """ASCII rows go to the UDF as nulls, which it passes by, and take lower() or themselves."""
    return udf(F.when(_is_ascii(v), F.lit(None).cast("string")).otherwise(v))


def all_ascii(df: DataFrame, *columns: str) -> bool:
    """Whether no text of the columns has another character."""
    return df.where(reduce(lambda a, b: a | b, [~_is_ascii(F.col(c)) for c in columns])).agg(F.count("*")).first()[0] == 0


def normalize_native(v: Column, ascii_only: bool = False) -> Column:
    """NFKC, casefold, & to and, punctuation to space, single spaces; null gives the empty string. ascii_only: no text has another character, so Python isn't asked."""
    v = F.coalesce(v.cast("string"), F.lit(""))
    folded = F.lower(v) if ascii_only else F.coalesce(_only_non_ascii(v, _fold_case), F.lower(v))
    return F.trim(F.regexp_replace(F.replace(folded, F.lit("&"), F.lit(" and ")), NOT_WORD + "+", " "))


def basic(v: Column, ascii_only: bool = False) -> Column:
    """normalize_native, with the literals nan and <na> as missing."""
    v = F.coalesce(v.cast("string"), F.lit(""))
    return normalize_native(F.when(F.lower(v).isin("nan", "<na>"), "").otherwise(v), ascii_only)


def accent_fold(v: Column, ascii_only: bool = False) -> Column:
    b = basic(v, ascii_only)
    return b if ascii_only else F.coalesce(_only_non_ascii(b, _strip_marks), b)


def words(v: Column) -> Column:
    return F.filter(F.split(v, " "), lambda w: w != "")


def aggressive(v: Column) -> Column:
    """Words of a normalised name without legal suffixes."""
    return F.array_join(F.filter(words(v), lambda w: ~w.isin(*SUFFIXES)), " ")


def numbers(v: Column) -> Column:
    """Sorted distinct digit groups."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(v, F.lit(r"\p{Nd}+"), F.lit(0))))


def tokens(v: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(v, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def script_group(v: Column) -> Column:
    """Dominant script by code points; mixed_ where several occur, unknown where none does."""
    text = normalize_native(v)
    counts = F.filter(F.array(*[F.struct(F.length(F.regexp_replace(text, f"[^{r}]", "")).alias("n"), F.lit(name).alias("name")) for name, r in SCRIPTS.items()]), lambda s: s["n"] > 0)
    top = F.array_max(counts)["name"]
    return F.when(F.size(counts) == 0, "unknown").when(F.size(counts) == 1, top).otherwise(F.concat(F.lit("mixed_"), top))


#: Base letters of the Brahmic blocks by offset in the block, and vowel signs.
_BRAHMIC = {5: "a", 6: "a", 7: "i", 8: "i", 9: "u", 10: "u", 15: "e", 16: "ai", 19: "o", 20: "au", 21: "k", 22: "kh", 23: "g", 24: "gh", 25: "n", 26: "c", 27: "ch", 28: "j", 29: "jh", 30: "n", 31: "t", 32: "th", 33: "d", 34: "dh", 35: "n", 36: "t", 37: "th", 38: "d", 39: "dh", 40: "n", 42: "p", 43: "ph", 44: "b", 45: "bh", 46: "m", 47: "y", 48: "r", 50: "l", 53: "v", 54: "sh", 55: "s", 56: "s", 57: "h"}
_SIGNS = {62: "a", 63: "i", 64: "i", 65: "u", 66: "u", 71: "e", 72: "ai", 75: "o", 76: "au", 1: "n", 2: "m", 3: "h"}
#: Letters of other alphabets and their usual romanisation.
_ALPHABETS = (
    "а a б b в v г g д d е e ё e ж zh з z и i й y к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch ъ - ы y ь - э e ю yu я ya і i ї yi є ye ґ g ў u ј j љ lj њ nj ћ c ђ d џ dz",
    "α a β v γ g δ d ε e ζ z η i θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r σ s ς s τ t υ y φ f χ ch ψ ps ω o",
    "ا a ب b ت t ث th ج j ح h خ kh د d ذ dh ر r ز z س s ش sh ص s ض d ط t ظ z ع - غ gh ف f ق q ك k ل l م m ن n ه h و w ي y ء - آ a أ a إ i ؤ w ئ y ة h ى a پ p چ ch ژ zh گ g ک k ی y ہ h ے e ٹ t ڈ d ڑ r ں n",
)
_LETTERS = {k: "" if v == "-" else v for line in _ALPHABETS for k, v in zip(line.split()[::2], line.split()[1::2], strict=True)}
_LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "ı": "i"}


def _letter(c: str) -> str:
    """A character of an alphabet: by table, as a digit, or without its marks."""
    low = c.lower()
    if low in _LATIN or low in _LETTERS:
        return _LATIN.get(low, _LETTERS.get(low))
    if ord(c) > 127 and (digit := unicodedata.digit(c, None)) is not None:
        return str(digit)
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return "".join(_LETTERS.get(x.lower(), x) for x in plain)


def _romanize(text: str | None) -> str | None:
    if text is None:
        return None
    out = []
    for i, c in enumerate(text):
        at = ord(c)
        if 0x900 <= at <= 0xD7F:
            place = (at - 0x900) % 0x80
            if place in _BRAHMIC:
                after = (ord(text[i + 1]) - 0x900) % 0x80 if i + 1 < len(text) and 0x900 <= ord(text[i + 1]) <= 0xD7F else None
                bare = 21 <= place <= 57 and after not in _SIGNS and after != 0x4D and after is not None
                out.append(_BRAHMIC[place] + ("a" if bare else ""))
            elif 0x66 <= place <= 0x6F:
                out.append(str(place - 0x66))
            else:
                out.append(_SIGNS.get(place, ""))
        else:
            out.append(_letter(c))
    return "".join(out)


@F.pandas_udf(T.StringType())
def _romanized(v: pd.Series) -> pd.Series:
    return v.map(_romanize)


def romanize(v: Column, method: str = "table") -> Column:
    """Romanised and normalised text. table: own code-point tables, approximate; uroman: the external program; none: as it is."""
    if method == "none":
        return normalize_native(v)
    if method == "uroman":
        return normalize_native(_uroman(F.coalesce(v, F.lit(""))))
    if method != "table":
        raise ValueError(f"unknown romanization {method!r}")
    folded = F.coalesce(v.cast("string"), F.lit(""))
    return normalize_native(F.coalesce(_only_non_ascii(folded, _romanized), folded))


@F.pandas_udf(T.StringType())
def _uroman(v: pd.Series) -> pd.Series:
    lines = "\n".join(x.replace("\n", " ") for x in v)
    done = subprocess.run(["uroman"], input=lines, capture_output=True, text=True, timeout=30, check=True)
    return pd.Series(done.stdout.split("\n")[: len(v)])


def text_variants(v: Column, method: str = "table", keep_native: bool = True) -> Column:
    """Distinct views in order: native, romanised, romanised without spaces if it has four characters or more."""
    roman = romanize(v, method)
    compact = F.replace(roman, F.lit(" "), F.lit(""))
    views = ([normalize_native(v)] if keep_native else []) + [roman, F.when(F.length(compact) >= 4, compact).otherwise("")]
    return F.array_distinct(F.filter(F.array(*views), lambda x: x != ""))


@F.pandas_udf(T.LongType())
def stable_hash(v: pd.Series) -> pd.Series:
    """blake2b of 8 bytes, little-endian, 63 bits."""
    return v.map(lambda x: hash_text(x) if x is not None else None)


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little") & ((1 << 63) - 1)


def record_text(prefix: str, name: Column, address: Column, country: Column) -> Column:
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.concat(F.lit(f"{prefix}: business name: "), clean(name), F.lit(" ; address: "), clean(address), F.lit(" ; country: "), clean(country))


def prepare(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Adds name, address, core and digits to records with business_name and business_address."""
    df = df.withColumns({"name": accent_fold(F.col("business_name"), ascii_only), "address": accent_fold(F.col("business_address"), ascii_only)})
    return df.withColumns({"core": aggressive(F.col("name")), "digits": F.array_join(numbers(F.col("address")), " ")})


def normalize_records(df: DataFrame, fields: tuple[str, ...] = FIELDS, method: str = "table", extras: bool = False) -> DataFrame:
    """Adds {field}_norm and {field}_roman for the fields that exist, script and the combined views; extras: name_core and digits too."""
    for field in ("name", "address"):
        if field not in df.columns and f"business_{field}" in df.columns:
            df = df.withColumn(field, F.col(f"business_{field}"))
    present = [f for f in fields if f in df.columns]
    if not present:
        raise ValueError("no text field to normalise")
    df = df.withColumns({f"{f}_norm": normalize_native(F.col(f)) for f in present} | {f"{f}_roman": romanize(F.col(f), method) for f in present})
    df = df.withColumn("script", script_group(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in present])))
    df = df.withColumns({f"combined_{kind}": F.trim(F.concat_ws(" ", *[F.col(f"{f}_{kind}") for f in present])) for kind in ("norm", "roman")})
    if extras and "name" in present:
        df = df.withColumn("name_core", aggressive(F.col("name_norm")))
    if extras and "address" in present:
        df = df.withColumn("digits", F.array_join(numbers(F.col("address_norm")), " "))
    return df
