"""Red-flag rules.

Each rule is one expression over a tender row that was joined with a few small statistics tables
("grains"): product group, buyer, supplier, pair, day groups and bids of the tender. Only the grains that
the chosen rules read are built, each one is joined once, and the flags, score and count are one select.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tendersift.functions import expr as E
from tendersift.operators import portraits
from tendersift.operators.bidstats import CHI2_LIMITS, tender_bid_stats
from tendersift.operators.quantiles import exact_quantiles, one_row
from tendersift.schemas import LIMITED, MASKED_SUPPLIERS, OPEN
from tendersift.session import cut_lineage

# Steps above which a procedure changes, and the zone below the lowest one.
THRESHOLDS = (50_000, 200_000, 1_000_000, 5_000_000)
NEAR_LOW, NEAR_HIGH = 40_000, 50_000

PAIR = ["buyer_id", "supplier_id"]


@dataclass(frozen=True)
class Rule:
    """A rule of the catalogue; ``test`` is missing where a rule is only declared."""

    id: str
    name: str
    title: str
    category: str
    severity: str
    weight: int
    test: Callable[[], Column] | None
    grains: tuple[str, ...] = ()
    requires_bids: bool = False
    requires_aggregation: bool = False

    @property
    def column(self) -> str:
        return f"flag_{self.name}"


def _c(name: str) -> Column:
    return F.col(name)


def _near() -> Column:
    return E.between_open(_c("tender_value"), NEAR_LOW, NEAR_HIGH)


def _value_outlier() -> Column:
    z = E.ratio(_c("tender_value") - _c("cpv_value_mean"), _c("cpv_value_std"))
    return F.abs(z) > 3


def _below_threshold() -> Column:
    hits = [E.between_open(_c("tender_value"), t * 0.95, t) for t in THRESHOLDS]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


# Ids, names, titles, categories, severities and weights of the rule catalogue.
RULES: tuple[Rule, ...] = (
    Rule("R005", "missing_documents", "Відсутні документи", "process_quality", "medium", 1,
         lambda: _c("number_of_documents") == 0),
    Rule("R013", "high_limited_usage", "Надмірне використання limited", "process_quality", "high", 2,
         lambda: _c("buyer_limited_rate") > 0.95, ("buyer",), False, True),
    Rule("R039", "no_enquiries", "Без запитань учасників", "process_quality", "low", 1,
         lambda: (_c("procurement_method") == OPEN) & (_c("has_enquiries") == 0)),
    Rule("R018", "single_bidder", "Один учасник", "competition_quality", "high", 2,
         lambda: (_c("is_single_bidder") == 1) & E.competitive_method()),
    Rule("R019", "low_bidders_for_cpv", "Мало учасників для категорії", "competition_quality", "medium", 1,
         lambda: (_c("number_of_tenderers") > 0)
         & (_c("number_of_tenderers") < _c("cpv_tenderers_median") * 0.5), ("cpv",), False, True),
    Rule("R040", "buyer_supplier_dominance", "Домінування постачальника", "competition_quality", "high", 2,
         lambda: _c("supplier_id") == _c("dominant_supplier"), ("dominance",), False, True),
    Rule("R050", "high_market_share", "Висока частка ринку", "competition_quality", "medium", 1,
         lambda: _c("market_leader") == 1, ("leader",), False, True),
    Rule("R051", "market_concentration", "Концентрація ринку", "competition_quality", "medium", 1,
         lambda: _c("cpv_hhi") > 0.25, ("market",), False, True),
    Rule("R017", "price_outlier", "Аномальна ціна", "price_quality", "high", 2,
         _value_outlier, ("cpv",), False, True),
    Rule("R022", "wide_bid_disparity", "Великий розкид ставок", "price_quality", "medium", 1,
         lambda: _c("bid_range_ratio") > 1.0, ("bids",), True),
    Rule("R023", "round_bid_prices", "Круглі ставки", "price_quality", "low", 1,
         lambda: _c("round_rate") > 0.8, ("bids",), True),
    Rule("R024", "close_to_winner", "Ставка близька до переможця", "price_quality", "medium", 1,
         lambda: E.between_open(_c("second_gap"), 0.0, 0.01), ("bids",), True),
    Rule("R025", "low_win_rate", "Низький win rate", "price_quality", "medium", 1,
         lambda: _c("has_frequent_loser") == 1, ("losers",), True),
    Rule("R027", "missing_regular_bidders", "Відсутні регулярні учасники", "price_quality", "medium", 1,
         None, (), True, True),
    Rule("R028", "identical_bids", "Ідентичні ставки", "price_quality", "critical", 3,
         lambda: _c("has_identical"), ("bids",), True),
    Rule("R034", "same_bid_order", "Однаковий порядок ставок", "price_quality", "high", 2,
         lambda: (_c("bid_rows") > 1) & (_c("hours_spread") < 1) & (_c("number_of_bids") > 1), ("bids",), True),
    Rule("R053", "cobidding_same_winner", "Спільні ставки з постійним переможцем", "price_quality", "critical", 3,
         lambda: _c("has_fixed_winner") == 1, ("duels",), True, True),
    Rule("R057", "bid_rotation", "Ротація ставок", "price_quality", "critical", 3,
         lambda: _c("cpv_rotates") == 1, ("rotation",), False, True),
    Rule("R058", "extreme_discount", "Екстремальна знижка", "price_quality", "medium", 1,
         lambda: _c("price_change_pct") > 50),
    Rule("R002", "threshold_manipulation", "Маніпуляція порогами", "procedure_manipulation", "high", 2,
         _below_threshold),
    Rule("R011", "contract_splitting", "Дроблення закупівель", "procedure_manipulation", "critical", 3,
         lambda: _c("day_is_split") == 1, ("cpv_day",), False, True),
    Rule("R016", "value_zscore_outlier", "Z-score вартості", "procedure_manipulation", "medium", 1,
         _value_outlier, ("cpv",), False, True),
    Rule("R021", "discretionary_criteria", "Дискреційні критерії", "procedure_manipulation", "medium", 1,
         lambda: ~_c("award_criteria").eqNullSafe("lowestCost") & (_c("procurement_method") == OPEN)),
    Rule("R029", "benford_violation", "Порушення закону Бенфорда", "procedure_manipulation", "medium", 1,
         lambda: (_c("bid_rows") >= 10) & (_c("benford_distance") > CHI2_LIMITS[0.05]), ("bids",), True),
    Rule("R031", "bid_near_estimate", "Ставка близька до оцінки", "procedure_manipulation", "high", 2,
         lambda: E.competitive_method() & (E.ratio(_c("award_value"), _c("tender_value")) >= 0.995)),
    Rule("R035", "all_except_winner_disqualified", "Всі крім переможця дискваліфіковані",
         "procedure_manipulation", "critical", 3,
         lambda: (_c("disqualified_count") == _c("bid_ids") - 1) & (_c("bid_ids") > 1), ("bids",), True),
    Rule("R036", "lowest_bid_disqualified", "Найнижча ставка дискваліфікована", "procedure_manipulation", "high", 2,
         lambda: _c("lowest_disqualified"), ("bids",), True),
    Rule("R038", "excessive_disqualifications", "Надмірні дискваліфікації", "procedure_manipulation", "high", 2,
         lambda: E.ratio(_c("disqualified_count"), _c("bid_rows")) > 0.5, ("bids",), True, True),
    Rule("R049", "direct_awards_pattern", "Патерн прямих закупівель", "procedure_manipulation", "high", 2,
         lambda: (_c("buyer_near_count") >= 5) & _near(), ("buyer",), False, True),
    Rule("R052", "small_then_large", "Малий контракт потім великий", "procedure_manipulation", "high", 2,
         lambda: _c("pair_grows") == 1, ("pair",), False, True),
    Rule("R055", "multiple_near_threshold", "Багато закупівель біля порогу", "procedure_manipulation", "high", 2,
         lambda: (_c("pair_near_count") >= 3) & _near(), ("pair",), False, True),
    Rule("R059", "award_contract_difference", "Різниця award/contract", "procedure_manipulation", "high", 2,
         lambda: _c("price_change_pct") < -10),
    Rule("R048", "heterogeneous_supplier", "Гетерогенний постачальник", "reputation", "medium", 1,
         lambda: _c("supplier_cpv_count") > 10, ("supplier",), False, True),
    Rule("R069", "price_increase", "Збільшення ціни", "reputation", "critical", 3,
         lambda: _c("price_change_pct") < 0),
    Rule("X001", "weekend_publication", "Публікація у вихідний", "additional", "low", 1,
         lambda: _c("is_weekend") == 1),
    Rule("X002", "q4_rush", "Q4 rush", "additional", "low", 1,
         lambda: (_c("is_q4") == 1) & (_c("tender_value") > _c("value_median") * 2), ("global",)),
    Rule("X003", "december_rush", "Грудневий rush", "additional", "medium", 1,
         lambda: (_c("is_december") == 1) & (_c("tender_value") > _c("value_median") * 2), ("global",)),
    Rule("X004", "cross_region_single_bidder", "Міжрегіональний single bidder", "additional", "high", 2,
         lambda: (_c("is_single_bidder") == 1) & (_c("is_cross_region") == 1)),
    Rule("X005", "masked_data", "Замасковані дані", "additional", "low", 1,
         lambda: F.coalesce(_c("is_buyer_masked") == 1, F.lit(False)) | (_c("is_supplier_masked") == 1)),
    Rule("X006", "award_issues", "Проблеми з awards", "additional", "medium", 1,
         lambda: F.coalesce(_c("has_unsuccessful_awards") == 1, F.lit(False)) | (_c("has_cancelled_awards") == 1)),
    Rule("X007", "new_supplier_large_contract", "Новий постачальник великий контракт", "additional", "high", 2,
         lambda: (_c("supplier_win_count") <= 2) & (_c("tender_value") > _c("value_p90")),
         ("supplier", "global"), False, True),
    Rule("X008", "captive_supplier", "Залежний постачальник", "additional", "high", 2,
         lambda: (_c("supplier_buyer_count") == 1) & (_c("supplier_win_count") >= 5), ("supplier",), False, True),
    Rule("X009", "single_bidder_low_discount", "Single bidder низька знижка", "additional", "critical", 3,
         lambda: (_c("is_single_bidder") == 1) & (F.coalesce(_c("discount_percentage_avg"), F.lit(0.0)) < 2)),
    Rule("X010", "same_day_same_supplier", "Той самий день той самий постачальник", "additional", "high", 2,
         lambda: _c("day_repeats") == 1, ("supplier_day",), False, True),
    Rule("X011", "high_value_limited", "Великий прямий договір із замаскованим постачальником",
         "additional", "critical", 3,
         lambda: (_c("procurement_method") == LIMITED) & (_c("award_value") >= 10_000_000)
         & _c("supplier_id").cast("string").isin(*MASKED_SUPPLIERS)),
)
BY_ID = {r.id: r for r in RULES}
# What each rule says when it fires.
DESCRIPTIONS = {
    "R005": "Key tender information and documents are not available",
    "R013": "Buyer has high use of non-competitive methods",
    "R039": "Open tender without any bidder questions",
    "R018": "Single bid received in competitive tender",
    "R019": "Low number of bidders compared to category average",
    "R040": "Supplier wins high share of buyer's contracts",
    "R050": "Supplier has high market share in CPV category",
    "R051": "High market concentration (HHI) in CPV category",
    "R017": "Tender value is unreasonably low or high for category",
    "R022": "Wide disparity in bid prices within tender",
    "R023": "Bid prices are suspiciously round numbers",
    "R024": "Second bid price very close to winning bid",
    "R025": "Bidder has excessively low win rate (professional loser)",
    "R027": "Regular bidders in category are missing from tender",
    "R028": "Multiple bidders submitted identical bid prices",
    "R034": "Bids consistently submitted in same order across tenders",
    "R053": "Co-bidding pairs always have same winner",
    "R057": "Suppliers rotate winning in same CPV category",
    "R058": "Winning bid has unusually high discount (>50%)",
    "R002": "Tender value suspiciously close to threshold",
    "R011": "Multiple tenders split to avoid competitive threshold",
    "R016": "Tender value significantly deviates from CPV average",
    "R021": "Use of discretionary evaluation criteria instead of lowest cost",
    "R029": "Bid prices deviate from Benford's Law distribution",
    "R031": "Winning bid very close to or higher than estimated price",
    "R035": "All bids except winner were disqualified",
    "R036": "Lowest bid was disqualified",
    "R038": "Buyer or bidder has excessive disqualification rate",
    "R049": "Pattern of direct awards just below threshold",
    "R052": "Small initial purchase followed by much larger purchases",
    "R055": "Multiple direct awards near competitive threshold",
    "R059": "Large difference between award value and contract amount",
    "R048": "Supplier operates in many unrelated CPV categories",
    "R069": "Contract amendments increased price above tender value",
    "X001": "Tender published on weekend (reduced visibility)",
    "X002": "High-value tender in Q4 (budget spending pressure)",
    "X003": "High-value tender in December (year-end pressure)",
    "X004": "Single bidder from different region",
    "X005": "Buyer or supplier data is masked",
    "X006": "Has unsuccessful or cancelled awards",
    "X007": "New supplier immediately wins large contract",
    "X008": "Supplier wins only from one buyer",
    "X009": "Single bidder with discount less than 2%",
    "X010": "Multiple awards to same supplier on same day",
    "X011": "Direct contract >10M UAH with masked supplier identity",
}
# Rules that stay 0 when the shared statistics are switched off.
NEED_STATISTICS = frozenset(
    {"R011", "R013", "R016", "R017", "R019", "R040", "R048", "R050", "X007", "X008"})
# Rules that read nothing but the tender row itself.
QUICK = ("R018", "R058", "R069", "R021", "R002", "X001", "X005", "X006", "X009")


def select_rules(enabled: Sequence[str] | None = None, disabled: Sequence[str] | None = None,
                 with_bids: bool = True, with_aggregation: bool = True) -> list[Rule]:
    """Computable rules, chosen before any plan is built."""
    return [
        r for r in RULES
        if r.test is not None
        and (not enabled or r.id in enabled)
        and (not disabled or r.id not in disabled)
        and (with_bids or not r.requires_bids)
        and (with_aggregation or r.id not in NEED_STATISTICS)
    ]


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(r.id, r.name, r.title, r.category, r.severity, r.weight, r.requires_bids, r.requires_aggregation, DESCRIPTIONS[r.id])
            for r in RULES]
    return spark.createDataFrame(
        rows, "id string, name string, name_ua string, category string, severity string, weight int, "
              "requires_bids boolean, requires_aggregation boolean, description string")


# --- grains ---------------------------------------------------------------------------------------------

def _cpv_grain(t: DataFrame) -> DataFrame:
    known = t.where(F.col("main_cpv_2_digit").isNotNull())
    return known.groupBy("main_cpv_2_digit").agg(
        F.avg("tender_value").alias("cpv_value_mean"),
        F.stddev_samp("tender_value").alias("cpv_value_std"),
        # A 16-bit count has few distinct values, so the exact aggregate stays small.
        F.median("number_of_tenderers").alias("cpv_tenderers_median"),
    )


def _market_grain(t: DataFrame) -> DataFrame:
    return portraits.market_hhi(t).withColumnRenamed("hhi", "cpv_hhi")


def market_leaders(t: DataFrame, share: float = 0.3) -> DataFrame:
    """Suppliers with more than the given share of a product group."""
    sums = portraits.market_sums(t)
    totals = sums.groupBy("main_cpv_2_digit").agg(F.sum("v").alias("total"))
    return (
        sums.join(totals, "main_cpv_2_digit")
        .where(F.col("supplier_id").isNotNull() & (E.ratio(F.col("v"), F.col("total")) > share))
        .select("main_cpv_2_digit", "supplier_id", F.lit(1).alias("market_leader"))
    )


def _buyer_grain(t: DataFrame) -> DataFrame:
    limited = F.coalesce(F.col("procurement_method") == LIMITED, F.lit(False))
    return t.where(F.col("buyer_id").isNotNull()).groupBy("buyer_id").agg(
        F.avg(limited.cast("int")).alias("buyer_limited_rate"),
        F.sum(E.flag(limited & _near())).alias("buyer_near_count"),
    )


def dominant_suppliers(t: DataFrame, share: float = 0.5, min_contracts: int = 5) -> DataFrame:
    """More than half of a buyer's tenders can go to one supplier only: one row per buyer at most."""
    counts = t.where(F.col("buyer_id").isNotNull()).groupBy(*PAIR).agg(F.count("tender_id").alias("c"))
    known = F.when(F.col("supplier_id").isNotNull(), F.struct("c", "supplier_id"))
    top = counts.groupBy("buyer_id").agg(F.max(known).alias("top"), F.sum("c").alias("n"))
    return top.where((F.col("top.c") / F.col("n") > share) & (F.col("top.c") >= min_contracts)).select(
        "buyer_id", F.col("top.supplier_id").alias("dominant_supplier"))


def _supplier_grain(t: DataFrame) -> DataFrame:
    return portraits.supplier_stats(t).drop("supplier_total_value")


def _pair_grain(t: DataFrame) -> DataFrame:
    """Pairs that start small and grow, or collect limited awards below the threshold; the rest is dropped.

    The first contract is the smallest (date, id) key of the pair; all later ones follow from the pair
    totals, so no pair has to be ordered.
    """
    known = t.where(F.col("buyer_id").isNotNull() & F.col("supplier_id").isNotNull())
    order = F.struct(F.col("published_date").isNull(), F.col("published_date"), F.col("tender_id"))
    pairs = known.groupBy(*PAIR).agg(
        F.count("*").alias("n"),
        F.count("tender_value").alias("known_values"),
        F.min_by("tender_value", order).alias("first"),
        F.sum("tender_value").alias("total"),
        F.max("tender_value").alias("largest"),
        F.sum(E.flag((F.col("procurement_method") == LIMITED) & _near())).alias("pair_near_count"),
    )
    later = (F.col("total") - F.col("first")) / (F.col("n") - 1)
    # If any value exceeds five times a positive first one, it is a later one.
    grows = (
        (F.col("n") >= 3) & (F.col("known_values") == F.col("n")) & (F.col("first") > 0)
        & (F.col("first") < later * 0.2) & (F.col("largest") > F.col("first") * 5)
    )
    return pairs.select(*PAIR, E.flag(grows).alias("pair_grows"), "pair_near_count").where(
        (F.col("pair_grows") == 1) | (F.col("pair_near_count") >= 3))


def _day(t: DataFrame) -> DataFrame:
    return t.withColumn("pub_date", F.to_date("published_date"))


def split_days(t: DataFrame) -> DataFrame:
    keys = ["buyer_id", "main_cpv_2_digit", "pub_date"]
    days = _day(t).dropna(subset=keys).groupBy(*keys).agg(
        F.count("tender_id").alias("n"), F.avg("tender_value").alias("mean"))
    return days.where((F.col("n") >= 3) & E.between_open(F.col("mean"), NEAR_LOW, NEAR_HIGH)).select(
        *keys, F.lit(1).alias("day_is_split"))


def repeat_days(t: DataFrame) -> DataFrame:
    keys = [*PAIR, "pub_date"]
    days = _day(t).dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))
    return days.where(F.col("n") >= 3).select(*keys, F.lit(1).alias("day_repeats"))


def frequent_losers(bids: DataFrame, min_bids: int = 10, win_rate: float = 0.05) -> DataFrame:
    return (
        bids.where(F.col("bidder_id").isNotNull()).groupBy("bidder_id")
        .agg(F.sum("is_winner").alias("wins"), F.count("is_winner").alias("n"))
        .where((F.col("n") >= min_bids) & (F.col("wins") / F.col("n") < win_rate))
        .select("bidder_id")
    )


def _loser_grain(bids: DataFrame) -> DataFrame:
    return (
        bids.join(frequent_losers(bids), "bidder_id", "left_semi")
        .select("tender_id").distinct().withColumn("has_frequent_loser", F.lit(1))
    )


def fixed_winner_pairs(bids: DataFrame, min_tenders: int = 5, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Two-bid tenders with their bidder pair, and the pairs in which one side keeps winning."""
    duels = (
        bids.where(F.col("bidder_id").isNotNull()).groupBy("tender_id")
        .agg(
            F.count("*").alias("n"), F.min("bidder_id").alias("low"), F.max("bidder_id").alias("high"),
            F.min(F.when(F.col("is_winner") == 1, F.struct("bid_id", "bidder_id"))).alias("w"),
        )
        .where(F.col("n") == 2)
    )
    won = F.col("w.bidder_id")
    pairs = (
        duels.where(won.isNotNull()).groupBy("low", "high")
        .agg(F.count("*").alias("n"), F.sum(E.flag(won == F.col("low"))).alias("a"),
             F.sum(E.flag(won == F.col("high"))).alias("b"))
        .where((F.col("n") >= min_tenders) & (F.greatest("a", "b") / F.col("n") >= share))
        .select("low", "high")
    )
    return duels, pairs


def _duel_grain(bids: DataFrame) -> DataFrame:
    duels, pairs = fixed_winner_pairs(bids)
    return duels.join(pairs, ["low", "high"], "left_semi").select("tender_id", F.lit(1).alias("has_fixed_winner"))


def rotating_groups(t: DataFrame, head: int = 20, min_rows: int = 10, change_rate: float = 0.6) -> DataFrame:
    """Product groups in which two or three suppliers take turns.

    The first twenty winners decide cheaply (a per-partition top-k before the shuffle) which groups need
    their whole sequence; those few are then ordered day by day, so a large group is spread over many
    tasks and only the ends of the days are put together.
    """
    key = "main_cpv_2_digit"
    rows = t.where(F.col(key).isNotNull()).select(key, "published_date", "tender_id", "supplier_id")
    won = rows.where(F.col("supplier_id").isNotNull())
    order = [F.col("published_date").asc_nulls_last(), F.col("tender_id")]
    first = (
        won.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        .where(F.col("rn") <= head).groupBy(key)
        .agg(F.count_distinct("supplier_id").alias("d"), F.count("*").alias("n"))
        .where((F.col("d") >= 2) & (F.col("d") <= 3) & (F.col("n") >= min(min_rows, head)))
        .select(key)
    )
    day = F.coalesce(F.to_date("published_date"), F.to_date(F.lit("9999-12-31")))
    sequence = won.join(cut_lineage(first), key, "left_semi").withColumn("day", day)
    inside = Window.partitionBy(key, "day").orderBy(*order)
    stepped = sequence.withColumn("prev", F.lag("supplier_id").over(inside))
    position = F.struct(F.col("published_date").isNull(), F.col("published_date"), F.col("tender_id"))
    days = stepped.groupBy(key, "day").agg(
        F.sum(E.flag(F.col("prev") != F.col("supplier_id"))).alias("changes"),
        F.count("*").alias("n"),
        F.min_by("supplier_id", position).alias("head"),
        F.max_by("supplier_id", position).alias("tail"),
    )
    before = F.lag("tail").over(Window.partitionBy(key).orderBy("day"))
    rate = E.ratio(F.sum(F.col("changes") + E.flag(F.col("head") != F.col("before"))), F.sum("n") - 1)
    return (
        days.withColumn("before", before).groupBy(key).agg(F.sum("n").alias("n"), rate.alias("rate"))
        .where((F.col("n") >= min_rows) & (F.col("rate") > change_rate))
        .select(key, "rate", F.lit(1).alias("cpv_rotates"))
    )


def enrich(t: DataFrame, bids: DataFrame | None, grains: Iterable[str]) -> DataFrame:
    """Tenders with the statistics of the named grains.

    A grain of groups is written first: from its true size the planner sends a small one to the tenders, where an
    estimate that grows with the tenders would have them shuffled, ever wider, once for each grain.
    """
    need, out = set(grains), t
    if need & {"cpv_day", "supplier_day"}:
        out = _day(out)
    by_tender = [
        ("bids", lambda: tender_bid_stats(bids)), ("losers", lambda: _loser_grain(bids)),
        ("duels", lambda: _duel_grain(bids)),
    ]
    joins: list[tuple[str, list[str], Callable[[], DataFrame]]] = [
        ("cpv", ["main_cpv_2_digit"], lambda: _cpv_grain(t)),
        ("market", ["main_cpv_2_digit"], lambda: _market_grain(t)),
        ("rotation", ["main_cpv_2_digit"], lambda: rotating_groups(t).drop("rate")),
        ("leader", ["main_cpv_2_digit", "supplier_id"], lambda: market_leaders(t)),
        ("buyer", ["buyer_id"], lambda: _buyer_grain(t)),
        ("dominance", ["buyer_id"], lambda: dominant_suppliers(t)),
        ("supplier", ["supplier_id"], lambda: _supplier_grain(t)),
        ("pair", PAIR, lambda: _pair_grain(t)),
        ("cpv_day", ["buyer_id", "main_cpv_2_digit", "pub_date"], lambda: split_days(t)),
        ("supplier_day", [*PAIR, "pub_date"], lambda: repeat_days(t)),
        *[(name, ["tender_id"], build) for name, build in by_tender],
    ]
    for name, keys, build in joins:
        if name in need:
            out = out.join(build() if keys == ["tender_id"] else cut_lineage(build()), keys, "left")
    if "global" in need:
        value = F.col("tender_value")
        cuts = exact_quantiles(t, [], {"value_median": (value, 0.5), "value_p90": (value, 0.9)})
        out = out.withColumn("_g", one_row(cuts, "value_median", "value_p90")).select(
            "*", "_g.value_median", "_g.value_p90").drop("_g")
    return out


def _require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def attach_buyers(t: DataFrame, buyers: DataFrame) -> DataFrame:
    """Buyer ratios and region; names that already exist get the suffix ``_ref``."""
    wanted = ["single_bidder_rate", "competitive_rate", "supplier_diversity_index", "buyer_region"]
    return _attach(t, buyers, "buyer_id", wanted)


def attach_suppliers(t: DataFrame, suppliers: DataFrame) -> DataFrame:
    return _attach(t, suppliers, "supplier_id", ["total_awards", "total_value"])


def _attach(t: DataFrame, table: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    _require(table, [key, *wanted])
    renamed = [F.col(c).alias(f"{c}_ref" if c in t.columns else c) for c in wanted]
    return t.join(table.select(key, *renamed), key, "left")


def detect(
    tenders: DataFrame,
    bids: DataFrame | None = None,
    buyers: DataFrame | None = None,
    suppliers: DataFrame | None = None,
    enabled: Sequence[str] | None = None,
    disabled: Sequence[str] | None = None,
    compute_aggregations: bool = True,
) -> DataFrame:
    """All enabled rules: one ``flag_`` column each, the weighted score, the number of flags and the level."""
    _require(tenders, ["tender_id", "buyer_id", "supplier_id", "tender_value"])
    rules = select_rules(enabled, disabled, bids is not None, True)
    usable = set(select_rules(enabled, disabled, bids is not None, compute_aggregations))
    grains = {g for r in usable for g in r.grains}
    extra = tenders
    if buyers is not None:
        extra = attach_buyers(extra, buyers)
    if suppliers is not None:
        extra = attach_suppliers(extra, suppliers)
    keep = extra.columns
    wide = enrich(extra, bids, grains)
    flags = [(E.flag(r.test()) if r in usable else F.lit(0)).alias(r.column) for r in rules]
    zero = F.lit(0)
    score = sum((F.col(r.column) * r.weight for r in rules), zero)
    count = sum((F.col(r.column) for r in rules), zero)
    return (
        wide.select(*keep, *flags)
        .select("*", score.alias("rule_risk_score"), count.alias("rule_flags_count"))
        .withColumn("rule_risk_level", E.rule_level(F.col("rule_risk_score")))
    )


def quick_scan(tenders: DataFrame) -> DataFrame:
    """Nine row-local rules in one narrow select: no join and no shuffle."""
    return detect(tenders, enabled=QUICK, compute_aggregations=False)


def full_scan(tenders: DataFrame, bids: DataFrame | None = None, buyers: DataFrame | None = None,
              suppliers: DataFrame | None = None) -> DataFrame:
    return detect(tenders, bids, buyers, suppliers)


# --- summaries ------------------------------------------------------------------------------------------

def flag_columns(df: DataFrame, prefix: str = "flag_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def unpivot_sums(df: DataFrame, columns: Sequence[str], name: str = "flag") -> DataFrame:
    """One row per column with its sum and the number of rows: one aggregate, then a tiny unpivot."""
    sums = df.agg(F.count("*").alias("total"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])
    return sums.unpivot(["total"], list(columns), name, "count")


def summary(results: DataFrame) -> DataFrame:
    cols = flag_columns(results)
    counts = unpivot_sums(results, cols).withColumn("name", F.expr("substring(flag, 6)"))
    return (
        counts.join(catalog(results.sparkSession), "name")
        .select("id", "name", "name_ua", "category", "severity", "count",
                F.bround(F.col("count") / F.col("total") * 100, 2).alias("percentage"))
        .orderBy(F.desc("count"), "id")
    )


def summary_by(results: DataFrame, column: str) -> DataFrame:
    return summary(results).groupBy(column).agg(
        F.sum("count").alias("count"), F.count("id").alias("rules_triggered"))


def distribution(results: DataFrame, level: str) -> DataFrame:
    """Count and percentage per level; rows without a level count towards the total only."""
    counts = results.groupBy(level).agg(F.count("*").alias("count"))
    total = one_row(counts.agg(F.sum("count").alias("t")), "t")["t"]
    return counts.where(F.col(level).isNotNull()).select(
        F.col(level).alias("risk_level"), "count",
        F.bround(F.col("count") / total * 100, 2).alias("percentage"))


def flagged(results: DataFrame, min_score: int | None = None, min_flags: int | None = None,
            level: str | None = None) -> DataFrame:
    out = results
    if min_score is not None:
        out = out.where(F.col("rule_risk_score") >= min_score)
    if min_flags is not None:
        out = out.where(F.col("rule_flags_count") >= min_flags)
    if level is not None:
        out = out.where(F.col("rule_risk_level") == level)
    return out


def explain(results: DataFrame) -> DataFrame:
    """Fired rules of every tender as an array of structs, in catalogue order."""
    rules = [r for r in RULES if r.column in results.columns]
    entries = [
        F.when(F.col(r.column) == 1, F.struct(
            F.lit(r.id).alias("id"), F.lit(r.title).alias("name"), F.lit(r.severity).alias("severity"),
            F.lit(DESCRIPTIONS[r.id]).alias("description")))
        for r in rules
    ]
    return results.select(
        "tender_id", F.col("rule_risk_score").alias("risk_score"), F.col("rule_risk_level").alias("risk_level"),
        F.col("rule_flags_count").alias("flags_count"),
        F.filter(F.array(*entries), lambda s: s.isNotNull()).alias("flags"))
