"""Phone labels: positions, base phones, variants and phone-set detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: marks on a phone and patterns of phone sets
STRESS_OR_TONE = r"[0-9˥˦˧˨˩ˈˌ]+$"
DIACRITICS = r"[ːˑ̃̊̚ʰʷʲˠˤⁿˡ˞ˀʼ̩̯̪̬̥̤̰̼̟̠̈̽]+$"
ARPA = r"^[A-Z]{2}[0-2]?$"
PINYIN = r"^[a-zü]{1,6}[1-5]$"
IPA_ONLY = "[ɐɑɒæɓʙβɔɕçɗɖðʤəɘɚɛɜɝɞɟʄɡɠɢʛɦɧħɥʜɨɪʝɭɬɫɮʟɱɯɰŋɳɲɴøɵɸθœɶʘɹɺɾɻʀʁɽʂʃʈʧʉʊʋⱱʌɣɤʍχʎʏʑʐʒʔʡʕʢǀǁǂǃ]"


def split_position(label: Column) -> Column:
    """(phone, position) cut at the last underscore; position null without one."""
    return F.struct(
        F.when(label.contains("_"), F.regexp_extract(label, "^(.*)_([^_]*)$", 1)).otherwise(label).alias("phone"),
        F.when(label.contains("_"), F.regexp_extract(label, "^(.*)_([^_]*)$", 2)).alias("position"),
    )


def strip_position(label: Column) -> Column:
    return F.regexp_replace(label, r"_[BSEI]\b", "")


def with_positions(phones: Column) -> Column:
    """Phones of a word with their places: S alone, B first, E last, I between."""
    n = F.size(phones)
    return F.transform(
        phones,
        lambda p, i: F.concat(
            p, F.when(n == 1, "_S").when(i == 0, "_B").when(i == n - 1, "_E").otherwise("_I")
        ),
    )


def base_phone(label: Column) -> Column:
    """The phone without stress, tone and diacritics."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(label, DIACRITICS, ""), STRESS_OR_TONE, ""), DIACRITICS, "")


def phone_set(label: Column) -> Column:
    """Which phone set a label looks like."""
    return F.when(label.rlike(ARPA), "ARPA").when(label.rlike(IPA_ONLY), "IPA").when(label.rlike(PINYIN), "PINYIN").otherwise("UNKNOWN")


def phone_set_votes(labels: DataFrame) -> DataFrame:
    """phone_set, n over distinct labels (column phone); the set with the most votes is a dictionary's."""
    return labels.select("phone").distinct().groupBy(phone_set(F.col("phone")).alias("phone_set")).agg(F.count("*").alias("n"))


def voiceless_variants(base: str) -> set[str]:
    return {base + mark for mark in ("̥", "̊")}


def voiced_variants(base: str) -> set[str]:
    return {base + "̬", "̬" + base}
