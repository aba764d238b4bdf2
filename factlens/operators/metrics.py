"""The declared metrics: value, formula, inputs and null reason for every company, class and period.

A metric is built from quantities. A quantity is a value with the reason for its absence, the inputs that it used, by source
tag, and its formula; combining quantities passes the first reason on. Nothing is ever taken as zero except lease
liabilities, and those say so in the formula. Named quantities become columns of their own, layer by layer, so that
expressions stay short however deep the definitions go.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.operators.facts import PERIOD, wide_periods
from factlens.operators.periods import nearest_prior
from factlens.registry import CALC_VERSION, CLASSES_OF_BASIS, CONCEPTS, LEAST_REVENUE_CHANGE, M_SCORE_INTERCEPT, M_SCORE_WEIGHTS, METRICS, PRIOR

TAGS = {c.name: c.tags for c in CONCEPTS}
INPUTS = "map<string,double>"


@dataclass
class Quantity:
    """``reason`` is null exactly where ``value`` is not; ``depth`` is the layer of columns that it needs."""

    value: Column
    reason: Column
    inputs: Column
    formula: Column
    depth: int = 0

    def because(self, name: str) -> Column:
        """The reason, as one of a quantity that needs this one."""
        return F.concat(F.lit(f"{name} cannot be taken: "), self.reason)


@dataclass
class Layers:
    """Columns to add to wide rows, in the order of their depth."""

    provenance: bool = True
    columns: list[dict[str, Column]] = field(default_factory=list)
    #: Columns of the prior year's and prior quarter's rows that quantities read.
    earlier: dict[str, set[str]] = field(default_factory=lambda: {"y": set(), "q": set()})

    def name(self, name: str, q: Quantity) -> Quantity:
        while len(self.columns) <= q.depth:
            self.columns.append({})
        own = {"value": q.value, "reason": q.reason}
        if self.provenance:
            own |= {"inputs": q.inputs, "formula": q.formula}
        self.columns[q.depth] |= {f"{name}__{k}": v for k, v in own.items()}
        return Quantity(*(F.col(f"{name}__{k}") if k in own else F.lit(None) for k in ("value", "reason", "inputs", "formula")), q.depth + 1)

    def add_to(self, rows: DataFrame) -> DataFrame:
        for columns in self.columns:
            rows = rows.withColumns(columns)
        return rows


def text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def derived(value: Column, reasons: list[Column], parts: list[Quantity], formula: list[Column | str]) -> Quantity:
    """A quantity from others: the first reason that holds, else the value."""
    reason = F.coalesce(*reasons)
    return Quantity(F.when(reason.isNull(), value), reason, F.concat(*[p.inputs for p in parts]), F.concat(*map(text, formula)), max(p.depth for p in parts))


def fails(condition: Column, reason: str) -> Column:
    return F.when(condition, F.lit(reason))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


class Period:
    """The quantities of one period: the row's own (no prefix) or a prior one's."""

    def __init__(self, layers: Layers, prefix: str = "", suffix: str = ""):
        self.layers, self.prefix, self.suffix, self.made = layers, prefix, suffix, {}

    def once(self, name: str, q: Quantity) -> Quantity:
        if name not in self.made:
            self.made[name] = self.layers.name(f"{self.prefix}{name}{self.suffix.replace('-', '_')}", q)
        return self.made[name]

    def concept(self, name: str) -> Quantity:
        value, priority = F.col(f"{self.prefix}{name}_v"), F.col(f"{self.prefix}{name}_p")
        if self.prefix:
            self.layers.earlier[self.prefix[0]] |= {f"{name}_v", *([f"{name}_p"] if self.layers.provenance else [])}
        tag = F.element_at(F.array(*map(F.lit, TAGS[name])), priority + 1)
        entry = F.when(value.isNotNull(), F.create_map(F.concat(tag, F.lit(self.suffix)), value))
        return Quantity(value, fails(value.isNull(), f"{name} missing"), F.array(entry), F.concat(F.coalesce(tag, F.lit(name)), F.lit(self.suffix)))

    def either(self, first: Quantity, second: Quantity, reason: str) -> Quantity:
        value, own = F.coalesce(first.value, second.value), first.value.isNotNull()
        inputs = F.when(own, first.inputs).otherwise(second.inputs)
        formula = F.when(own, first.formula).otherwise(F.concat(second.formula, F.lit(" [fallback]")))
        return Quantity(value, fails(value.isNull(), reason), inputs, formula, max(first.depth, second.depth))

    def gross_profit(self) -> Quantity:
        revenue, cogs = self.concept("revenue"), self.concept("cogs")
        difference = Quantity(revenue.value - cogs.value, revenue.reason, F.concat(revenue.inputs, cogs.inputs), F.concat(F.lit("("), revenue.formula, F.lit(" - "), cogs.formula, F.lit(")")))
        return self.once("gross", self.either(self.concept("gross_profit"), difference, "no gross_profit, and revenue less cogs cannot be taken"))

    def ppe(self) -> Quantity:
        return self.once("ppe", self.either(self.concept("ppe_net"), self.concept("ppe_and_lease_net"), "no ppe_net and no ppe_and_lease_net"))

    def depreciation(self) -> Quantity:
        return self.once("wear", self.either(self.concept("depreciation"), self.concept("dep_amort"), "no depreciation and no dep_amort"))

    def debt(self) -> Quantity:
        """Borrowings (combined, else both components) plus finance leases, which count as zero where absent."""
        long, short = self.concept("debt_noncurrent"), self.concept("debt_current")
        parts = Quantity(long.value + short.value, long.reason, F.concat(long.inputs, short.inputs), F.concat(F.lit("("), long.formula, F.lit(" + "), short.formula, F.lit(")")))
        out = self.either(self.concept("total_debt"), parts, "no total_debt, and its parts are not all there")
        for name in ("finance_lease_liability_noncurrent", "finance_lease_liability_current"):
            lease = self.concept(name)
            formula = F.concat(out.formula, F.lit(" + "), F.when(lease.value.isNotNull(), lease.formula).otherwise(F.lit(f"{name}=0 [assumed]")))
            out = Quantity(out.value + F.coalesce(lease.value, F.lit(0.0)), out.reason, F.concat(out.inputs, lease.inputs), formula)
        return self.once("debt", out)


def ratio(num: Quantity, den: Quantity, zero: str, guards: list[Column] = [], times: float | None = None) -> Quantity:  # noqa: B006
    value = divide(num.value, den.value)
    tail: list[Column | str] = [] if times is None else [f" * {times:g}"]
    return derived(value if times is None else value * times, [num.reason, den.reason, fails(den.value == 0, zero), *guards], [num, den], [num.formula, " / ", den.formula, *tail])


class Named(dict):
    """Quantities by name; what is put in becomes columns."""

    def __init__(self, layers: Layers):
        super().__init__()
        self.layers = layers

    def __setitem__(self, name: str, q: Quantity) -> None:
        super().__setitem__(name, self.layers.name(name, q))


def build(layers: Layers) -> dict[str, Quantity]:
    """All metrics by name."""
    now, year = Period(layers), Period(layers, "y_")
    at, before, before_q = Period(layers, "", "_t"), Period(layers, "y_", "_t-1"), Period(layers, "q_", "_t-1")
    c = now.concept
    no_prior, no_prior_q = fails(F.col("prior_end").isNull(), "no earlier period to compare with"), fails(F.col("prior_q_end").isNull(), "no earlier period to compare with")

    def simple(a: str, b: str, *guards: Column) -> Quantity:
        return ratio(c(a), c(b), f"{b} is zero", list(guards))

    def growth(name: str, missing: Column, prior: Period, *guards: Column) -> Quantity:
        a, b = at.concept(name), prior.concept(name)
        reasons = [missing, fails(a.value.isNull(), f"{name} missing (this period)"), fails(b.value.isNull(), f"{name} missing (earlier period)")]
        return derived(divide(a.value, b.value) - 1, [*reasons, *guards, fails(b.value == 0, "the earlier value is zero")], [a, b], [a.formula, " / ", b.formula, " - 1"])

    def index(num: str, den: str) -> Quantity:
        a, b, x, y = at.concept(num), at.concept(den), before.concept(num), before.concept(den)
        gone = a.value.isNull() | b.value.isNull() | x.value.isNull() | y.value.isNull()
        reasons = [no_prior, fails(gone, f"{num} or {den} missing in one of the periods"), fails((b.value == 0) | (y.value == 0), f"{den} is zero in one of the periods"), fails(x.value == 0, "the earlier ratio is zero")]
        return derived(divide(divide(a.value, b.value), divide(x.value, y.value)), reasons, [a, b, x, y], ["(", a.formula, "/", b.formula, ") / (", x.formula, "/", y.formula, ")"])

    def needs(*parts: tuple[str, Quantity]) -> list[Column]:
        return [q.because(n) for n, q in parts]

    out = Named(layers)
    positive = lambda name: fails(year.concept(name).value <= 0, "the earlier value is not positive")
    out["revenue_yoy"] = growth("revenue", no_prior, before)
    out["revenue_qoq"] = growth("revenue", no_prior_q, before_q)
    out["operating_income_yoy"] = growth("operating_income", no_prior, before, positive("operating_income"))
    out["eps_diluted_yoy"] = growth("eps_diluted", no_prior, before, positive("eps_diluted"))
    out["gross_margin"] = ratio(now.gross_profit(), c("revenue"), "revenue is zero")
    out["operating_margin"] = simple("operating_income", "revenue")
    out["net_margin"] = simple("net_income", "revenue")
    oi, da = c("operating_income"), c("dep_amort")
    out["ebitda"] = derived(oi.value + da.value, [oi.reason, da.reason], [oi, da], [oi.formula, " + ", da.formula])
    ebitda = out["ebitda"]

    def over_revenue(name: str, q: Quantity) -> Quantity:
        r = c("revenue")
        return derived(divide(q.value, r.value), [*needs((name, q)), r.reason, fails(r.value == 0, "revenue is zero")], [q, r], ["(", q.formula, ") / ", r.formula])

    out["ebitda_margin"] = over_revenue("ebitda", ebitda)
    out["rnd_intensity"] = simple("rnd_expense", "revenue")
    out["sga_intensity"] = simple("sga_expense", "revenue")
    g1, g0, r1, r0 = at.gross_profit(), before.gross_profit(), at.concept("revenue"), before.concept("revenue")
    gone = g1.value.isNull() | g0.value.isNull() | r1.value.isNull() | r0.value.isNull()
    change = r1.value - r0.value
    too_small = fails((r1.value != 0) & (F.abs(change) < LEAST_REVENUE_CHANGE * F.abs(r1.value)), f"|delta revenue| < {LEAST_REVENUE_CHANGE:.0%} of revenue")
    out["incremental_gross_margin"] = derived(
        divide(g1.value - g0.value, change),
        [no_prior, fails(gone, "gross_profit or revenue missing in one of the periods"), too_small, fails(change == 0, "revenue did not change")],
        [g1, g0, r1, r0],
        ["(", g1.formula, " - ", g0.formula, ") / (", r1.formula, " - ", r0.formula, ")"],
    )
    out["effective_tax_rate"] = simple("tax_expense", "pretax_income")
    tax, pretax = c("tax_expense"), c("pretax_income")
    no_rate = fails(tax.value.isNull() | pretax.value.isNull(), "no effective_tax_rate: tax_expense or pretax_income missing")
    out["nopat"] = derived(
        oi.value * (1 - divide(tax.value, pretax.value)),
        [oi.reason, no_rate, fails(pretax.value == 0, "pretax_income is zero")],
        [oi, tax, pretax],
        [oi.formula, " * (1 - ", tax.formula, "/", pretax.formula, ")"],
    )
    nopat = out["nopat"]
    debt, equity, cash, short = now.debt(), c("equity"), c("cash"), c("short_term_investments")
    out["invested_capital"] = derived(debt.value + equity.value - cash.value, [debt.reason, equity.reason, cash.reason], [debt, equity, cash], [debt.formula, " + ", equity.formula, " - ", cash.formula])
    capital = out["invested_capital"]
    out["roic"] = derived(divide(nopat.value, capital.value), [*needs(("nopat", nopat), ("invested_capital", capital)), fails(capital.value == 0, "invested_capital is zero")], [nopat, capital], ["(", nopat.formula, ") / (", capital.formula, ")"])
    negative = fails(equity.value < 0, "equity is negative")
    out["roe"] = simple("net_income", "equity", negative)
    out["asset_turnover"] = simple("revenue", "total_assets")
    out["equity_multiplier"] = simple("total_assets", "equity", negative)
    out["fixed_asset_turnover"] = ratio(c("revenue"), now.ppe(), "ppe_net is zero")
    out["capex_to_revenue"] = simple("capex", "revenue")
    out["capex_to_depreciation"] = ratio(c("capex"), now.depreciation(), "depreciation is zero")
    cfo, capex, income = c("cfo"), c("capex"), c("net_income")
    out["free_cash_flow"] = derived(cfo.value - capex.value, [cfo.reason, capex.reason], [cfo, capex], [cfo.formula, " - ", capex.formula])
    free = out["free_cash_flow"]
    out["fcf_margin"] = over_revenue("free_cash_flow", free)
    out["fcf_conversion"] = derived(divide(free.value, income.value), [*needs(("free_cash_flow", free)), income.reason, fails(income.value <= 0, "net_income is not positive")], [free, income], ["(", free.formula, ") / ", income.formula])
    out["sbc_to_revenue"] = simple("sbc", "revenue")
    base = now.either(c("ppe_gross"), now.ppe(), "no ppe_gross, ppe_net or ppe_and_lease_net")
    out["depreciation_rate"] = ratio(now.depreciation(), base, "the property is zero")
    days = {}
    for name, a, b in (("days_inventory", "inventory", "cogs"), ("days_receivables", "receivables", "revenue"), ("days_payables", "payables", "cogs")):
        out[name] = ratio(c(a), c(b), f"{b} is zero", times=365)
        days[name] = out[name]
    i, r, p = days.values()
    out["cash_conversion_cycle"] = derived(i.value + r.value - p.value, needs(*days.items()), [i, r, p], [i.formula, " + ", r.formula, " - ", p.formula])
    inv, rev = layers.name("inventory_yoy", growth("inventory", no_prior, before)), out["revenue_yoy"]
    out["inventory_growth_less_revenue_growth"] = derived(inv.value - rev.value, needs(("inventory_yoy", inv), ("revenue_yoy", rev)), [inv, rev], ["(", inv.formula, ") - (", rev.formula, ")"])
    out["net_debt"] = derived(debt.value - cash.value - short.value, [debt.reason, cash.reason, short.reason], [debt, cash, short], [debt.formula, " - ", cash.formula, " - ", short.formula])
    net = out["net_debt"]
    out["net_debt_to_ebitda"] = derived(divide(net.value, ebitda.value), [*needs(("net_debt", net), ("ebitda", ebitda)), fails(ebitda.value <= 0, "ebitda is not positive")], [net, ebitda], ["(", net.formula, ") / (", ebitda.formula, ")"])
    out["interest_coverage"] = simple("operating_income", "interest_expense")
    out["current_ratio"] = simple("current_assets", "current_liabilities")
    out["beneish_dsri"], out["beneish_sgai"] = index("receivables", "revenue"), index("sga_expense", "revenue")
    m1, m0 = divide(g1.value, r1.value), divide(g0.value, r0.value)
    zero_revenue = fails((r1.value == 0) | (r0.value == 0), "revenue is zero in one of the periods")
    out["beneish_gmi"] = derived(divide(m0, m1), [no_prior, fails(gone, "gross_profit or revenue missing in one of the periods"), zero_revenue, fails(m1 == 0, "the gross margin of this period is zero")], [g1, g0, r1, r0], ["(", g0.formula, "/", r0.formula, ") / (", g1.formula, "/", r1.formula, ")"])

    def soft(at_: Period) -> tuple[Column, list[Quantity], Column]:
        ca, ppe, ta = at_.concept("current_assets"), at_.ppe(), at_.concept("total_assets")
        return 1 - divide(ca.value + ppe.value, ta.value), [ca, ppe, ta], F.concat(F.lit("(1 - ("), ca.formula, F.lit(" + "), ppe.formula, F.lit(") / "), ta.formula, F.lit(")"))

    def two(term, missing: str, zero: str, swap: bool = False) -> Quantity:
        (v1, parts1, f1), (v0, parts0, f0) = term(at), term(before)
        top, low, ft, fl = (v0, v1, f0, f1) if swap else (v1, v0, f1, f0)
        return derived(divide(top, low), [no_prior, fails(v1.isNull() | v0.isNull(), missing), fails(low == 0, zero)], [*parts1, *parts0], [ft, " / ", fl])

    out["beneish_aqi"] = two(soft, "current_assets, ppe_net, or total_assets missing or zero in one of the periods", "the earlier term is zero")
    out["beneish_sgi"] = derived(divide(r1.value, r0.value), [no_prior, fails(r1.value.isNull() | r0.value.isNull(), "revenue missing in one of the periods"), fails(r0.value == 0, "the earlier revenue is zero")], [r1, r0], [r1.formula, " / ", r0.formula])

    def wear(at_: Period) -> tuple[Column, list[Quantity], Column]:
        dep, ppe = at_.depreciation(), at_.ppe()
        return divide(dep.value, dep.value + ppe.value), [dep, ppe], F.concat(F.lit("("), dep.formula, F.lit(" / ("), dep.formula, F.lit(" + "), ppe.formula, F.lit("))"))

    out["beneish_depi"] = two(wear, "depreciation or ppe_net missing or zero in one of the periods", "the rate of this period is zero", swap=True)

    def leverage(at_: Period) -> tuple[Column, list[Quantity], Column]:
        owed, cl, ta = at_.debt(), at_.concept("current_liabilities"), at_.concept("total_assets")
        return divide(owed.value + cl.value, ta.value), [owed, cl, ta], F.concat(F.lit("(("), owed.formula, F.lit(" + "), cl.formula, F.lit(") / "), ta.formula, F.lit(")"))

    out["beneish_lvgi"] = two(leverage, "total_debt, current_liabilities, or total_assets missing or zero in one of the periods", "the earlier leverage is zero")
    ta = c("total_assets")
    out["beneish_tata"] = derived(divide(income.value - cfo.value, ta.value), [income.reason, cfo.reason, ta.reason, fails(ta.value == 0, "total_assets is zero")], [income, cfo, ta], ["(", income.formula, " - ", cfo.formula, ") / ", ta.formula])
    return out


def m_score(built: dict[str, Quantity]) -> Quantity:
    """The weighted score of the eight components; where some are null, the reason lists them."""
    parts = [built[n] for n in M_SCORE_WEIGHTS]
    gone = F.array_compact(F.array(*[fails(built[n].value.isNull(), n) for n in M_SCORE_WEIGHTS]))
    value = F.lit(M_SCORE_INTERCEPT)
    for name, weight in M_SCORE_WEIGHTS.items():
        value = value + weight * built[name].value
    reason = F.when(F.size(gone) > 0, F.concat(F.lit("without: "), F.array_join(gone, ", ")))
    terms = [x for name, weight in M_SCORE_WEIGHTS.items() for x in (f" {weight:+g} * ", built[name].formula)]
    return derived(value, [reason], parts, [f"{M_SCORE_INTERCEPT:g}", *terms])


def with_priors(rows: DataFrame, needed: dict[str, set[str]] | None = None) -> DataFrame:
    """Wide rows with those of the prior year (y_*) and prior quarter (q_*) of the same class, carried by the window that finds them.

    Only the columns ``needed`` of each (by y and q) are carried, all of them if that isn't given.
    """
    prior = {"y": ("prior", *PRIOR["yoy"]), "q": ("prior_q", *PRIOR["qoq"])}
    values = {p: [v for c in CONCEPTS for x in ("v", "p") if (v := f"{c.name}_{x}") and (needed is None or v in needed[p])] for p in prior}
    found = {name: nearest_prior(rows, ["cik", "cls"], "period_start", "period_end", offset, tolerance, F.struct(*values[p]) if values[p] else None) for p, (name, offset, tolerance) in prior.items()}
    earlier = {f"{prefix}_{v}": F.col(f"{name}.carried.{v}") for prefix, (name, *_) in prior.items() for v in values[prefix]}
    ends = {f"{name}_{x}": F.col(f"{name}.{x}") for name in found for x in ("end", "start")}
    return rows.withColumns(found).withColumns(ends | earlier).drop(*found)


def inputs_json(inputs: Column, null_reason: Column) -> Column:
    """The inputs as JSON with sorted keys; a null metric's reason is one of them, as _null_reason."""
    numbers = F.transform(F.array_sort(F.map_entries(inputs)), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), F.coalesce(e["value"].cast("string"), F.lit("null"))))
    pairs = F.transform(numbers, lambda x: F.regexp_replace(x, r'^\[(".*")\]:', "$1:"))
    reason = F.when(null_reason.isNotNull(), F.array(F.concat(F.lit('"_null_reason":'), F.regexp_replace(F.to_json(F.array(null_reason)), r"^\[|\]$", "")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.concat(F.coalesce(pairs, F.array().cast("array<string>")), reason)), ","), F.lit("}"))


def compute_metrics(facts: DataFrame, filings: DataFrame, names: list[str] | None = None, entities: list[str] | None = None, provenance: bool = True, labels: tuple[str, ...] = ()) -> DataFrame:
    """Every registered metric for every period of its classes, null ones with their reason.

    ``names`` and ``entities`` restrict the work, the latter before anything else. Returns cik, cls, period_start,
    period_end, name, value, null_reason and calc_version, with ``provenance`` formula and inputs, and with ``labels`` those
    of the period's filings, as filed.
    """
    if entities is not None:
        facts, filings = (d.filter(F.col("cik").isin(entities)) for d in (facts, filings))
    layers = Layers(provenance)
    built = build(layers)
    built["beneish_m_score"] = m_score(built)
    rows = layers.add_to(with_priors(wide_periods(facts, filings, labels), layers.earlier))
    structs = []
    for m in METRICS:
        if names is None or m.name in names:
            q = built[m.name]
            fields = [F.lit(m.name).alias("name"), F.col("cls").isin(*CLASSES_OF_BASIS[m.basis]).alias("applies"), q.value.alias("value"), q.reason.alias("null_reason")]
            if provenance:
                entries = F.array_distinct(F.flatten(F.transform(F.array_compact(q.inputs), F.map_entries)))
                fields += [q.formula.alias("formula"), F.map_from_entries(entries).alias("inputs")]
            structs.append(F.struct(*fields))
    columns = [F.col(c) for c in ("cik", "cls", "period_start", "period_end", *(["filed"] if labels else []))]
    long = rows.select(*columns, F.inline(F.array(*structs)))
    return long.filter("applies").drop("applies").withColumn("calc_version", F.lit(CALC_VERSION))


__all__ = ["PERIOD", "compute_metrics", "inputs_json", "with_priors"]
