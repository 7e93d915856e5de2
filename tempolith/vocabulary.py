"""Fixed values of the data model: categories, relations, markers."""

from __future__ import annotations

# Raw category -> canonical category; everything else is "concept".
CATEGORIES = {
    "person": "person",
    "org": "org", "group": "org",
    "location": "location",
    "event": "event", "phase": "event", "period": "event", "interval": "event",
    "product": "product", "technology": "product", "infrastructure": "product", "structure": "product", "instrument": "product", "drug": "product", "treatment": "product",
    "work": "work", "style": "work", "literature": "work",
    "policy": "policy", "strategy": "policy", "process": "policy",
    "metric": "metric", "value": "metric", "attribute": "metric", "feature": "metric", "capability": "metric",
    "date": "date", "tag": "tag",
}
OTHER_CATEGORY = "concept"

# Relations that keep the books of the graph and answer nothing.
STRUCTURAL = ("spans_year", "within_year", "dated", "has_year", "occurred_on", "start_date", "end_date", "tag_related_to", "inferred_tag")
# Relations that name causes, and those that name effects in a wider sense.
CAUSAL = ("caused", "led_to", "fueled", "compelled", "triggered", "drove", "influenced", "enabled")
AFFECTING = (*CAUSAL, "affected", "impact", "impacted")
FACTUAL_TYPES = ("base", "gold_fact")

# Words that mark a kind of explanation.
MARKERS = {
    "causal": ("because", "due to", "as a result", "resulted in", "led to", "caused"),
    "sequence": ("then", "next", "after", "before", "followed by", "subsequently"),
    "interval": ("from", "to", "between", "until", "during"),
    "overlap": ("while", "simultaneously", "at the same time", "overlap"),
    "comparison": ("compared", "whereas", "while", "in contrast", "longer", "shorter", "earlier", "later", "before", "after"),
    "hedge": ("might", "may", "possibly", "likely", "uncertain", "suggest", "appears"),
    "certainty": ("definitely", "certainly", "clearly", "undoubtedly"),
}
