"""Plain text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The topic keywords, two of them twice and so of weight 2.
TOPIC_KEYWORDS = (
    "fashion", "clothing", "textile", "designer", "model", "runway",
    "collection", "couture", "haute", "tailoring", "fabric", "silk",
    "cotton", "wool", "linen", "pattern", "sewing", "garment",
    "apparel", "wardrobe", "style", "trend", "vogue", "mode",
    "dress", "suit", "jacket", "skirt", "blouse", "accessory",
    "jewelry", "footwear", "handbag", "perfume", "cosmetics",
    "luxury", "brand", "retail", "manufacturing", "sustainable",
    "style", "trendy", "outfit", "wardrobe", "chic", "elegant",
    "catwalk", "fashion show", "design", "couturier", "atelier",
)


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def keyword_hits(text: Column) -> Column:
    """How many topic keywords occur in the lower-cased text; repeated keywords count twice."""
    low = F.lower(text)
    hits = F.lit(0)
    for k in TOPIC_KEYWORDS:
        hits = hits + F.contains(low, F.lit(k)).cast("int")
    return F.coalesce(hits, F.lit(0))
