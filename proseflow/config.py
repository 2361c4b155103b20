"""Settings in one place; nothing is read from files."""

from __future__ import annotations

from dataclasses import dataclass

#: Phrases that make a sentence one about the economy, by family.
ECONOMIC_PHRASES = (
    # inflation and expectations
    "inflation", "inflation expectation", "core cpi", "core pce", "price stability", "commodity prices", "price level", "deflation", "disinflation", "inflationary", "price pressure",
    # interest rates and policy
    "interest rate", "federal funds rate", "rate hike", "rate cut", "hawkish", "dovish", "forward guidance", "accommodative", "restrictive", "tightening", "easing", "quantitative easing", "balance sheet", "tapering", "normalization",
    # labor market and growth
    "employment", "unemployment", "labor market", "wage growth", "payroll", "gdp", "economic growth", "recession", "soft landing", "output gap",
    # financial stability
    "exchange rate", "credit spreads", "yield curve", "financial conditions", "banking sector", "liquidity", "systemic risk",
)
#: Clauses are split at the first of these that a sentence holds; the order is ours.
CONTRASTIVES = ("but", "however", "although", "while")
#: Where the body of a page ends, and phrases that are no text.
END_KEYWORDS = ("Footnotes", "References", "Endnotes")
SPEECH_NOISE = ("Return to top", "Watch live", "Return to text")
DOCUMENT_NOISE = ("Return to top", "Return to text")
SENTINEL = "Return to top"
#: Cues of the offline classifier, ours.
HAWKISH_CUES = ("tightening", "rate hike", "restrictive", "hawkish", "inflationary", "price pressure")
DOVISH_CUES = ("easing", "rate cut", "accommodative", "dovish", "recession", "deflation")


@dataclass(frozen=True)
class Settings:
    """Defaults of the pipelines; the site's address is always given by the caller."""

    base_url: str = ""
    max_tokens: int = 400
    advance_tokens: int = 100
    chars_per_token: int = 4
    min_sentence: int = 10
    max_features: int = 10_000
    categories: tuple[str, ...] = ("St", "Mn")
    recent_layout_from: int = 2006
    last_old_url_year: int = 2010
