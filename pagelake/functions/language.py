"""A quick guess of a text's language as a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A few of the commonest words of each language (fixed values).
COMMON = {
    "en": "the and of to in is that for with was",
    "de": "der die und das nicht mit ist den von eine",
    "fr": "le les des et une dans pour que est du",
    "es": "el los las que una por con para se del",
    "pt": "os uma que não com para dos mais ao da",
    "it": "il di che una per non sono della gli con",
    "nl": "de het een van en dat niet zijn voor met",
    "sv": "och att det som en på är av för inte",
    "pl": "się nie na że do jest przez oraz są co",
    "ru": "и в не на что с по это как для",
    "uk": "і та що це як для від або є він",
    "tr": "ve bir bu için ile çok olarak daha gibi olan",
    "da": "og af det er ikke til som på med der",
    "fi": "ja on ei se että oli hän mutta kun ovat",
    "cs": "se je že na jsou které jako ale pro byl",
    "ro": "și în cu pe din este care sunt mai pentru",
    "hu": "az és hogy nem egy van volt csak még mint",
    "vi": "và của là có trong cho được không các một",
}
# Languages with a script of their own, looked at in this order (fixed values).
SCRIPTS = {"ja": "ぁ-ヿ", "ko": "가-힣", "zh": "一-鿿", "ar": "؀-ۿ", "hi": "ऀ-ॿ", "el": "Ͱ-Ͽ", "he": "֐-׿", "th": "฀-๿"}


def guess(text: Column, least: int = 3) -> Column:
    """Two-letter code of 26 languages: by script, where it makes up more than a
    fifth of the text, else by the most common words found; null for less than
    ``least`` of them, for null and empty texts."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def hits(common: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(common.split())))

    scores = [F.struct(hits(v).alias("n"), F.lit(k).alias("lang")) for k, v in COMMON.items()]
    best = F.array_max(F.array(*scores))
    out: Column | None = None
    for code, letters in SCRIPTS.items():
        found = F.length(F.regexp_replace(text, f"[^{letters}]", "")) * 5 > F.length(text)
        out = F.when(found, F.lit(code)) if out is None else out.when(found, F.lit(code))
    return out.when(best["n"] >= least, best["lang"])
