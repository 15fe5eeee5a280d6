"""Fixed tables: values that results depend on, stated as data."""

from __future__ import annotations

# The relation vocabulary in its order of priority.
RELATIONS = ["enables", "influences", "constrains", "contested-by", "relates-to"]

# Keyword, positive pole, negative pole; the first keyword that a factor's name contains decides.
POLES = [
    ("acceptance", "High Acceptance", "Low Acceptance"), ("resistance", "Low Resistance", "High Resistance"),
    ("support", "Strong Support", "Weak Support"), ("opposition", "Low Opposition", "High Opposition"),
    ("trust", "High Trust", "Low Trust"), ("confidence", "High Confidence", "Low Confidence"),
    ("credibility", "High Credibility", "Low Credibility"), ("legitimacy", "High Legitimacy", "Low Legitimacy"),
    ("knowledge", "High Knowledge", "Low Knowledge"), ("awareness", "High Awareness", "Low Awareness"),
    ("information", "Well Informed", "Poorly Informed"), ("education", "High Education", "Low Education"),
    ("engagement", "High Engagement", "Low Engagement"), ("participation", "Active Participation", "Low Participation"),
    ("involvement", "High Involvement", "Low Involvement"), ("cost", "Low Cost", "High Cost"),
    ("benefit", "High Benefit", "Low Benefit"), ("value", "High Value", "Low Value"), ("price", "Low Price", "High Price"),
    ("financing", "Easy Financing Access", "Difficult Financing Access"), ("investment", "High Investment", "Low Investment"),
    ("impact", "Positive Impact", "Negative Impact"), ("environment", "Environmental Protection", "Environmental Degradation"),
    ("sustainability", "High Sustainability", "Low Sustainability"), ("governance", "Effective Governance", "Ineffective Governance"),
    ("policy", "Clear Policy Framework", "Unclear Policy Framework"), ("regulation", "Adequate Regulation", "Inadequate Regulation"),
    ("risk", "Low Risk", "High Risk"), ("safety", "High Safety", "Low Safety"), ("security", "High Security", "Low Security"),
    ("quality", "High Quality", "Low Quality"), ("effectiveness", "High Effectiveness", "Low Effectiveness"),
    ("efficiency", "High Efficiency", "Low Efficiency"), ("performance", "High Performance", "Low Performance"),
    ("proximity", "Near Proximity", "Distant Proximity"), ("accessibility", "High Accessibility", "Low Accessibility"),
    ("distance", "Short Distance", "Long Distance"), ("experience", "Extensive Experience", "Limited Experience"),
    ("familiarity", "High Familiarity", "Low Familiarity"), ("justice", "High Justice", "Low Justice"),
    ("fairness", "High Fairness", "Low Fairness"), ("equity", "High Equity", "Low Equity"),
    ("transparency", "High Transparency", "Low Transparency"), ("independence", "High Independence", "High Dependence"),
    ("autonomy", "High Autonomy", "Low Autonomy"),
]
# Names for which the low pole is the positive one.
NEGATIVE = ["cost", "price", "risk", "barrier", "constraint", "opposition", "resistance"]

# US dollars for a million input and output tokens, and the default for models that aren't listed.
PRICES = [
    ("claude-sonnet-4-5-20250929", 3.0, 15.0), ("claude-opus-4-20250514", 15.0, 75.0), ("claude-3-5-sonnet-20241022", 3.0, 15.0),
    ("claude-3-opus-20240229", 15.0, 75.0), ("claude-3-sonnet-20240229", 3.0, 15.0), ("claude-3-haiku-20240307", 0.25, 1.25),
]
DEFAULT_PRICE = (3.0, 15.0)

# Cues after which a chain's direction is reversed, and cues that keep it.
REVERSE_CUES = ["requires", "depends on", "needs", "relies on", "in order to", "to achieve", "limited by", "constrained by"]
KEEP_CUES = ["leads to", "causes", "drives", "results in", "enables", "facilitates", "allows", "increases", "decreases", "affects"]

# Words that hint at an aspect and a dimension (by the name), or at a dimension (by co-factors).
NAME_HINTS = [
    ("economic", 11, 2), ("governance", 13, 3), ("regulation", 13, 3), ("psychological", 15, 1), ("trust", 15, 1), ("attitude", 6, 1),
    ("environment", 5, None), ("impact", 5, None), ("ecology", 5, None), ("technical", 7, 4), ("method", 7, 4), ("assessment", 7, 4),
    ("social", 10, 1), ("community", 10, 1), ("participation", 10, 1),
]
CO_FACTOR_HINTS = [
    ("policy", 3), ("governance", 3), ("community", 1), ("trust", 1), ("local", 1), ("market", 2), ("finance", 2), ("consumer", 2),
    ("research", 4), ("method", 4), ("analysis", 4),
]

# Codes that a complete interview is expected to use.
EXPECTED_CODES = [
    "graca_especial_ge", "graca_comum_gc", "graca_secular_gs", "hereditariedade_cultural", "evento_cristo", "cristianismo_secular",
    "superabundancia", "singularidade_monergismo", "prioridade_monergismo", "incongruencia_monergismo", "eficacia",
    "nao_circularidade_monergismo", "gratidao_especial_ge", "gratidao_comum_gc", "gratidao_comum_negativa_gcn", "micro_csr", "macro_csr",
]

# Words that a key term of a definition must not contain.
STOP_WORDS = ["para", "como", "pela", "pelo", "seus", "suas", "essa", "esse", "esta", "este", "mais", "pode", "forma", "sobre", "após", "desde"]
