"""Commercial evidence in texts, and the advertisement verdict that it supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the six families of commercial signals.
SIGNALS = {
    "call_to_action": r"\b(?:book|reserve|buy|shop|order|hire)\s+(?:now|today|online)\b|\b(?:call|contact)\s+us\b|\bbring\s+this\s+flyer\b",
    "offer": r"\b(?:happy\s+hour|deals?|special\s+offers?|limited\s+(?:time|offer)|sale|discount|promotions?|soldes|oferta)\b",
    "discount": r"\b\d+\s*%\s*(?:off|discount)|\b(?:half|[½]|1/2)\s*price\b|\bfree\s+shipping\b|\b(?:first|drink.s?)\b[^.!?]{0,25}\bfree\b",
    "price": r"[$€£]\s*\d+(?:[.,]\d+)?|\b\d+(?:[.,]\d+)?\s*(?:usd|eur|gbp)\b",
    "package": r"\b\d+\s*(?:days?|nights?)\b|\b(?:half\s+board|accommodation|accomodation)\b",
    "contact": r"\+\d[\d ()-]{6,}\d|\bwww\.[a-z0-9.-]+|\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
}
# What each family adds to the strength; prices count by their number.
WEIGHTS = {"call_to_action": 0.55, "offer": 0.20, "discount": 0.40, "package": 0.30, "contact": 0.15}
PRICE_WEIGHT, PRICES = 0.60, 3
MOST = 12


def signal(text: Column, family: str) -> Column:
    """First twelve sorted distinct matches of a family in the lower-cased text."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(?U)" + SIGNALS[family]), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.trim(x)))), 1, MOST)


def strength(signals: dict[str, Column]) -> Column:
    present = lambda f: F.when(F.size(signals[f]) > 0, F.lit(WEIGHTS[f])).otherwise(F.lit(0.0))
    price = F.lit(PRICE_WEIGHT) * F.least(F.lit(1.0), F.size(signals["price"]) / F.lit(float(PRICES)))
    total = present("call_to_action") + present("offer") + present("discount") + price + present("package") + present("contact")
    return F.least(F.lit(1.0), total)


def with_evidence(df: DataFrame, text: str = "text") -> DataFrame:
    """Add one array column for each family and ``strength``; null texts have no signals."""
    known = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({f: signal(known, f) for f in SIGNALS})
    return df.withColumn("strength", strength({f: F.col(f) for f in SIGNALS}))


def words_of_tsv(tsv: Column) -> Column:
    """Words of an OCR table (tab-separated, no quoting) with confidence of 45 or more: (text, width, height)."""
    lines = F.filter(F.split(tsv, "\n"), lambda x: F.length(x) > 0)
    cells = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.split(x, "\t"))
    get = lambda c, k, t: F.get(c, F.lit(k)).try_cast(t)
    words = F.transform(cells, lambda c: F.struct(F.trim(F.get(c, F.lit(11))).alias("text"), get(c, 10, "double").alias("conf"), get(c, 8, "int").alias("width"), get(c, 9, "int").alias("height")))
    return F.filter(words, lambda w: (w["conf"] >= 45) & (F.length(w["text"]) > 0) & w["width"].isNotNull() & w["height"].isNotNull())


def with_ocr_evidence(df: DataFrame, tsv: str, width: str, height: str) -> DataFrame:
    """Add ``words``, ``text_area_percent`` (at most 100) and the signals of the words read; null output is unavailable."""
    found = words_of_tsv(F.col(tsv))
    area = F.aggregate(found, F.lit(0.0), lambda s, w: s + w["width"] * w["height"])
    df = df.withColumns({"available": F.col(tsv).isNotNull(), "words": F.size(F.coalesce(found, F.array().cast("array<struct<text:string,conf:double,width:int,height:int>>"))), "text_area_percent": F.least(F.lit(100.0), F.coalesce(area * 100 / (F.col(width) * F.col(height)), F.lit(0.0))), "ocr_text": F.array_join(F.transform(found, lambda w: w["text"]), " ")})
    return with_evidence(df, "ocr_text")


def _finite(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def evidence_score(reference: Column, advertising: Column, available: Column, words: Column, area: Column, commerce: Column) -> Column:
    """Struct of the evidence index (0 to 100), its completeness and four yes/no findings; null score if anything is not finite."""
    x = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), (advertising - reference) / F.lit(0.012)))
    visual = 1 / (1 + F.exp(-x))
    text = F.when(available, F.least(F.lit(1.0), F.greatest(F.lit(0.0), area) / F.lit(8.0))).otherwise(0.0)
    trade = F.when(available, F.greatest(F.lit(0.0), F.least(F.lit(1.0), commerce))).otherwise(0.0)
    score = F.lit(100.0) * (1 - (1 - visual) * (1 - F.lit(0.55) * text) * (1 - F.lit(0.60) * trade))
    ok = _finite(reference, advertising, area, commerce)
    margin = advertising - reference
    return F.struct(
        F.when(ok, score).alias("score"),
        (ok & available).alias("complete"),
        (ok & (margin >= 0.005)).alias("clear_layout"),
        (ok & available & (words >= 4) & (area >= 3)).alias("substantial_text"),
        (ok & available & (trade >= 0.45)).alias("commercial_intent"),
        (ok & available & (margin >= 0.04) & (area >= 8)).alias("strong_poster"),
    )


def advert_decision(evidence: Column, threshold: float = 90.0) -> Column:
    """Struct (decision, reason): reject only on a clear layout with text that is commercial or on a strong poster."""
    if not 90 <= threshold <= 99:
        raise ValueError("the rejection threshold lies between 90 and 99")
    backed = evidence["clear_layout"] & evidence["substantial_text"] & (evidence["commercial_intent"] | evidence["strong_poster"])
    reject = backed & (evidence["score"] >= threshold)
    undecided = ~evidence["complete"] | evidence["score"].isNull()
    return F.struct(
        F.when(~undecided & reject, "reject").otherwise("accept").alias("decision"),
        F.when(undecided, "inconclusive_evidence").when(reject, "obvious_advertisement").otherwise("no_obvious_advertisement").alias("reason"),
    )


def unchecked(df: DataFrame) -> DataFrame:
    """What a check that cannot run says: nothing is rejected, and the row says that it was not checked."""
    return df.withColumns({"ad_rejected": F.lit(False), "ad_score": F.lit(None).cast("double"), "ad_checked": F.lit(False), "ad_reason": F.lit("check_unavailable")})
