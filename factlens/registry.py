"""Registries as data: concepts, duration classes, metrics, rules, thresholds and word lists.

Values here are fixed by the analyses that they define; callers may pass their own registries to the operators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Concept:
    name: str
    instant: bool
    unit: str
    tags: tuple[str, ...]


def _duration(name: str, *tags: str, unit: str = "USD") -> Concept:
    return Concept(name, False, unit, tags)


def _instant(name: str, *tags: str) -> Concept:
    return Concept(name, True, "USD", tags)


# Canonical concepts and their source tags, first priority first.
CONCEPTS = (
    _duration("revenue", "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"),
    _duration("cogs", "CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold"),
    _duration("gross_profit", "GrossProfit"),
    _duration("sga_expense", "SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"),
    _duration("rnd_expense", "ResearchAndDevelopmentExpense"),
    _duration("operating_income", "OperatingIncomeLoss"),
    _duration(
        "pretax_income",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    ),
    _duration("tax_expense", "IncomeTaxExpenseBenefit"),
    _duration("net_income", "NetIncomeLoss"),
    _duration("net_income_including_nci", "ProfitLoss"),
    _duration("eps_diluted", "EarningsPerShareDiluted", unit="USD/shares"),
    _duration("diluted_shares", "WeightedAverageNumberOfDilutedSharesOutstanding", unit="shares"),
    _instant("total_assets", "Assets"),
    _instant("current_assets", "AssetsCurrent"),
    _instant("current_liabilities", "LiabilitiesCurrent"),
    _instant("equity", "StockholdersEquity"),
    _instant("equity_including_nci", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    _instant("cash", "CashAndCashEquivalentsAtCarryingValue"),
    _instant("short_term_investments", "ShortTermInvestments", "MarketableSecuritiesCurrent", "AvailableForSaleSecuritiesDebtSecuritiesCurrent"),
    _instant("inventory", "InventoryNet"),
    _instant("receivables", "AccountsReceivableNetCurrent"),
    _instant("payables", "AccountsPayableCurrent", "AccountsPayableAndAccruedLiabilitiesCurrent"),
    _instant("ppe_net", "PropertyPlantAndEquipmentNet"),
    _instant("ppe_and_lease_net", "PropertyPlantAndEquipmentAndFinanceLeaseRightOfUseAssetAfterAccumulatedDepreciationAndAmortization"),
    _instant("ppe_gross", "PropertyPlantAndEquipmentGross"),
    _instant("debt_noncurrent", "LongTermDebtNoncurrent"),
    _instant("debt_current", "LongTermDebtCurrent", "DebtCurrent"),
    _instant("finance_lease_liability_noncurrent", "FinanceLeaseLiabilityNoncurrent"),
    _instant("finance_lease_liability_current", "FinanceLeaseLiabilityCurrent"),
    _instant("operating_lease_liability_noncurrent", "OperatingLeaseLiabilityNoncurrent"),
    _instant("operating_lease_liability_current", "OperatingLeaseLiabilityCurrent"),
    _instant("total_debt", "LongTermDebt", "DebtLongtermAndShorttermCombinedAmount"),
    _duration("interest_expense", "InterestExpense", "InterestExpenseNonoperating"),
    _duration("interest_expense_debt", "InterestExpenseDebt"),
    _duration("dep_amort", "DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet"),
    _duration("depreciation", "Depreciation"),
    _duration("sbc", "ShareBasedCompensation"),
    _duration("cfo", "NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    _duration("capex", "PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"),
)

# Days of a period, from and to, by class.
DURATION_CLASSES = (("quarterly", 80, 100), ("half-year", 170, 190), ("three-quarter", 260, 285), ("annual", 350, 380))
OTHER, INSTANT = "other", "instant"

#: Prior periods end so many days earlier, give or take.
PRIOR = {"yoy": (365, 20), "qoq": (91, 15)}


@dataclass(frozen=True)
class Metric:
    """``basis``: both, annual or quarterly. ``low`` and ``high`` bound plausible values."""

    name: str
    basis: str
    low: float | None
    high: float | None
    category: str
    extreme: bool = True
    headline: bool = True


# Metrics, their basis, plausible range and category, and whether extremes and headlines are made of them.
METRICS = (
    Metric("revenue_yoy", "both", -0.9, 10, "growth"),
    Metric("revenue_qoq", "quarterly", -0.9, 10, "growth"),
    Metric("operating_income_yoy", "both", -10, 30, "growth"),
    Metric("eps_diluted_yoy", "both", -10, 20, "growth"),
    Metric("gross_margin", "both", -1, 1, "margins"),
    Metric("operating_margin", "both", -2, 1, "margins"),
    Metric("net_margin", "both", -2, 1, "margins"),
    Metric("ebitda", "both", None, None, "margins", extreme=False, headline=False),
    Metric("ebitda_margin", "both", -2, 1, "margins"),
    Metric("rnd_intensity", "both", 0, 0.6, "margins"),
    Metric("sga_intensity", "both", 0, 0.6, "margins"),
    Metric("incremental_gross_margin", "both", -5, 5, "margins"),
    Metric("effective_tax_rate", "both", -3, 2, "returns", headline=False),
    Metric("nopat", "both", None, None, "returns", extreme=False, headline=False),
    Metric("invested_capital", "both", None, None, "returns", extreme=False, headline=False),
    Metric("roic", "both", -2, 2, "returns"),
    Metric("roe", "both", -2, 2, "returns"),
    Metric("asset_turnover", "both", 0, 5, "returns"),
    Metric("equity_multiplier", "both", 0, 20, "returns"),
    Metric("fixed_asset_turnover", "both", 0, 50, "returns"),
    Metric("capex_to_revenue", "both", 0, 1, "capital_cash"),
    Metric("capex_to_depreciation", "both", 0, 10, "capital_cash"),
    Metric("free_cash_flow", "both", None, None, "capital_cash", extreme=False),
    Metric("fcf_margin", "both", -2, 1, "capital_cash"),
    Metric("fcf_conversion", "both", -10, 10, "capital_cash"),
    Metric("sbc_to_revenue", "both", 0, 0.6, "capital_cash"),
    Metric("depreciation_rate", "both", 0, 1, "capital_cash"),
    Metric("days_inventory", "annual", 0, 730, "working_capital"),
    Metric("days_receivables", "annual", 0, 365, "working_capital"),
    Metric("days_payables", "annual", 0, 365, "working_capital"),
    Metric("cash_conversion_cycle", "annual", -365, 730, "working_capital"),
    Metric("inventory_growth_less_revenue_growth", "annual", -5, 5, "working_capital"),
    Metric("net_debt", "both", None, None, "solvency", extreme=False),
    Metric("net_debt_to_ebitda", "both", -20, 20, "solvency"),
    Metric("interest_coverage", "both", -200, 5000, "solvency"),
    Metric("current_ratio", "both", 0, 10, "solvency"),
    Metric("beneish_dsri", "annual", 0, 20, "quality", headline=False),
    Metric("beneish_gmi", "annual", -20, 20, "quality", headline=False),
    Metric("beneish_aqi", "annual", -20, 20, "quality", headline=False),
    Metric("beneish_sgi", "annual", 0, 20, "quality", headline=False),
    Metric("beneish_depi", "annual", -20, 20, "quality", headline=False),
    Metric("beneish_sgai", "annual", -20, 20, "quality", headline=False),
    Metric("beneish_lvgi", "annual", -20, 20, "quality", headline=False),
    Metric("beneish_tata", "annual", -2, 2, "quality", headline=False),
    Metric("beneish_m_score", "annual", -10, 10, "quality"),
)
METRIC = {m.name: m for m in METRICS}
CLASSES_OF_BASIS = {"both": ("annual", "quarterly"), "annual": ("annual",), "quarterly": ("quarterly",)}

# Intercept and weights of the manipulation score.
M_SCORE_INTERCEPT = -4.84
M_SCORE_WEIGHTS = {
    "beneish_dsri": 0.920,
    "beneish_gmi": 0.528,
    "beneish_aqi": 0.404,
    "beneish_sgi": 0.892,
    "beneish_depi": 0.115,
    "beneish_sgai": -0.172,
    "beneish_tata": 4.679,
    "beneish_lvgi": -0.327,
}
#: Below this share of revenue a change in revenue is too small to divide by.
LEAST_REVENUE_CHANGE = 0.02

CALC_VERSION = "1"

# Rules, their version and base severity (null: it depends on the metric).
RULES = {
    "metric_multi_year_extreme": ("v3", None),
    "metric_sigma_move": ("v2", "medium"),
    "metric_threshold_cross": ("v2", "high"),
    "metric_divergence": ("v2", "high"),
    "section_wording_changed": ("v3", "high"),
    "section_length_change": ("v2", "medium"),
    "section_appeared": ("v4", "low"),
    "section_disappeared": ("v4", "low"),
    "metric_stopped_computing": ("v2", "medium"),
    "readability_change": ("v2", "low"),
    "section_renamed": ("v3", "low"),
}
SECTION_RULES = tuple(r for r in RULES if r.startswith("section") or r == "readability_change")
# Notes that come and go by their nature.
FLUCTUATING_NOTES = ("Recently Issued Accounting Standards Not Yet Adopted",)
HIGH_CATEGORIES = ("margins", "returns", "working_capital")

# History that extremes need and look back on, by class.
EXTREME_LEAST = {"quarterly": 8, "annual": 4}
EXTREME_WINDOW = {"quarterly": 20, "annual": 5}
SIGMA_LEAST, SIGMA_LIMIT = 8, 2.0

# Declared thresholds and divergences.
THRESHOLDS = (
    ("beneish_m_score", "above", -1.78),
    ("current_ratio", "below", 1.0),
    ("net_debt", "crosses_zero", None),
    ("fcf_conversion", "below", 0.5),
    ("interest_coverage", "below", 3.0),
)
DIVERGENCES = (
    ("inventory_growth_less_revenue_growth", "above", 0.15),
    ("capex_to_depreciation", "above", 1.5),
    ("depreciation_rate", "yoy_decline", 0.15),
)
LENGTH_CHANGE, WORDING_SIMILARITY, RENAME_SIMILARITY = 0.25, 0.60, 0.70
READABILITY_CHANGE, READABILITY_LEAST_WORDS = 0.15, 50
PEER_DAYS = 365

# Limits of an evidence selection.
PER_SLOT, PER_RULE, PER_FILING, PER_CATEGORY = 2, 4, 8, 2

# Words that state a cause, and words that predict.
CAUSAL = ("because", "due to", "driven by", "as a result of", "caused by", "owing to", "reflecting", "attributable to", "stemming from")
PREDICTIVE = ("will", "expects", "likely", "suggests", "indicates", "points to", "implies")
SENTENCE_TYPES = ("restatement", "juxtaposition", "aggregation", "grouping", "sourced_causal")

# Ordinal words in order, from 1.
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh",
    "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
)

# What a finding may be.
FINDING_CATEGORIES = ("red_flag", "accounting_change", "litigation", "concentration", "liquidity", "note_item")
SEVERITIES = ("high", "medium", "low")

TRACKED_FORMS = ("10-K", "10-Q", "8-K")
REQUIRED_ITEM = "2.02"
SECTION_CATEGORIES = ("Statements", "Notes", "Policies")
QUOTE_LEAST = 40
LEDGER_TOLERANCE, COST_TOLERANCE, STALE_DAYS = 1e-9, 1e-6, 60
RELATIVE_TOLERANCE = 0.01


def check_registry(concepts: tuple[Concept, ...] = CONCEPTS) -> None:
    """A tag belongs to one concept; a concept is there once."""
    tags = [t for c in concepts for t in c.tags]
    if len(set(tags)) < len(tags) or len({c.name for c in concepts}) < len(concepts):
        raise ValueError("a source tag or concept is registered twice")


def alias_table(spark: SparkSession, concepts: tuple[Concept, ...] = CONCEPTS) -> DataFrame:
    """(tag, canonical, instant, unit, priority): a row a tag."""
    check_registry(concepts)
    rows = [(t, c.name, c.instant, c.unit, k) for c in concepts for k, t in enumerate(c.tags)]
    return spark.createDataFrame(rows, "concept string, canonical string, instant boolean, unit string, priority int")


def metric_table(spark: SparkSession, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """(name, cls, low, high, category, extreme, headline): a row a metric and class."""
    rows = [(m.name, c, None if m.low is None else float(m.low), None if m.high is None else float(m.high), m.category, m.extreme, m.headline) for m in metrics for c in CLASSES_OF_BASIS[m.basis]]
    return spark.createDataFrame(rows, "name string, cls string, low double, high double, category string, extreme boolean, headline boolean")
