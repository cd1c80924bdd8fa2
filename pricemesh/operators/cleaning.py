"""Quote cleaning: plausibility, identity, component split, outliers, and the report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from pricemesh import schema as S
from pricemesh.functions.common import same_keys
from pricemesh.operators import outliers


def with_window(quotes: DataFrame) -> DataFrame:
    """Advance-purchase window: days from observation to departure."""
    return quotes.withColumn("window_days", F.datediff("departure_date", "scrape_date"))


def reject_reason() -> Column:
    """First failing plausibility rule, or null for a quote that could be a real fare."""
    total, window = F.col("total_fare"), F.col("window_days")
    return (
        F.when(F.col("origin") == F.col("destination"), S.REJECT_SAME_OD)
        .when(total.isNull() | (total <= 0), S.REJECT_NON_POSITIVE)
        .when(window.isNull() | ~window.between(1, S.MAX_WINDOW_DAYS), S.REJECT_WINDOW)
        .when(total < S.MIN_PLAUSIBLE_FARE, S.REJECT_BELOW)
        .when(total > S.MAX_PLAUSIBLE_FARE, S.REJECT_ABOVE)
    )


def classify_plausibility(quotes: DataFrame) -> DataFrame:
    return with_window(quotes).withColumn("reject_reason", reject_reason())


def components_sum() -> Column:
    zero = F.lit(0).cast("decimal(12,2)")
    return sum((F.coalesce(F.col(c), zero) for c in S.COMPONENTS), zero)


def components_reconcile() -> Column:
    """Base and taxes are present and all parts add up to the total within one rupee."""
    present = F.col("base_fare").isNotNull() & F.col("taxes").isNotNull()
    return F.coalesce(
        present & (F.abs(components_sum() - F.col("total_fare")) <= S.RECONCILE_TOLERANCE), F.lit(False)
    )


def verify_decomposition(quotes: DataFrame) -> DataFrame:
    """Keep a split that reconciles; clear all five parts of one that does not, and flag it."""
    no_split = F.col("base_fare").isNull() & F.col("taxes").isNull()
    flags = (
        F.when(no_split, F.array_union("quality_flags", F.array(F.lit("no_component_split"))))
        .when(F.col("components_complete"), F.col("quality_flags"))
        .otherwise(F.concat("quality_flags", F.array(F.lit("components_did_not_reconcile"))))
    )
    out = quotes.withColumn("components_complete", components_reconcile()).withColumn("quality_flags", flags)
    return out.withColumns({c: F.when(F.col("components_complete"), F.col(c)) for c in S.COMPONENTS})


def first_arrivals(
    quotes: DataFrame, key: list[str], order: Column, copies: str = "copies", number: str | None = None
) -> DataFrame:
    """One row per key, the earliest in `order`, with the number of rows it stands for.

    An aggregate rather than a ranking window: copies collapse map-side, so a key that holds
    a third of the input costs one row per upstream task after the shuffle.

    number names a column that tells the rows of a written table apart (it is not returned): then only numbers go through
    the aggregate, which has a fixed width and sorts nothing, and the rows come by an equi-join on their number, which no
    key can crowd. Without it whole rows go through, for inputs that are dearer to compute twice than to sort.
    """
    names = [c for c in quotes.columns if c != number]
    if number is not None:
        first = quotes.groupBy(*key).agg(F.min_by(number, order).alias("_first"), F.count(F.lit(1)).alias(copies))
        same = same_keys("q", "f", key) & (F.col(f"q.{number}") == F.col("f._first"))
        return quotes.alias("q").join(first.alias("f"), same).select(*[f"q.{c}" for c in names], f"f.{copies}")
    payload = F.struct(*[F.col(c) for c in names if c not in key])
    rows = quotes.groupBy(*key).agg(F.min_by(payload, order).alias("_first"), F.count(F.lit(1)).alias(copies))
    return rows.select(*[c if c in key else f"_first.{c}" for c in names], copies)


def deduplicate(quotes: DataFrame) -> DataFrame:
    """The first quote of every identity by ingest_seq, with the number of rows it stands for.

    Identities are counted by a hash aggregate of fixed width (first number and count), so copies collapse before the
    shuffle and no full row is sorted for it; the rows themselves come by their number, which no key can crowd.
    ingest_seq must name one row each; a store that may see a row twice merges it first (see streaming.ingest).
    """
    first = quotes.groupBy(*S.QUOTE_IDENTITY).agg(F.min("ingest_seq").alias("_first"), F.count(F.lit(1)).alias("copies"))
    numbers = first.select(F.col("scrape_date").alias("_day"), "_first", "copies")
    same = F.col("scrape_date").eqNullSafe(F.col("_day")) & (F.col("ingest_seq") == F.col("_first"))
    return quotes.join(numbers, same).drop("_day", "_first")


def validation_errors() -> Column:
    """Rule names a single quote breaks, before any cleaning."""
    rules = [
        ("non_positive_total", F.col("total_fare") <= 0),
        *[(f"negative_{c}", F.col(c) < 0) for c in S.COMPONENTS],
        ("window_not_positive", F.col("window_days") <= 0),
        ("components_did_not_reconcile", F.col("base_fare").isNotNull() & ~components_reconcile()),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def outlier_flag() -> Column:
    """Text form of the verdict as carried in the quality flags."""
    return F.concat_ws(":", F.lit("outlier"), "outlier_method", F.col("outlier_score").cast("string"))


def parse_outlier_flag(flags: Column) -> Column:
    """Split the first outlier flag back into (is_outlier, method, score)."""
    hit = F.filter(flags, lambda f: f.startswith("outlier:"))
    parts = F.split(F.get(hit, F.lit(0)), ":", 3)
    return F.struct(
        (F.size(hit) > 0).alias("is_outlier"),
        F.get(parts, F.lit(1)).alias("method"),
        F.get(parts, F.lit(2)).cast("double").alias("score"),
    )


def lowest_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """The price concept: lowest total per key, with the number of quotes behind it."""
    return df.groupBy(*keys).agg(F.min("total_fare").alias("price"), F.count(F.lit(1)).alias("n_quotes"))


@dataclass
class CleaningResult:
    """Lazily defined outputs of one cleaning run; nothing is computed before an action."""

    classified: DataFrame
    survivors: DataFrame
    groups: DataFrame
    method: str = "mad_log"

    @property
    def rejected(self) -> DataFrame:
        return self.classified.filter(F.col("reject_reason").isNotNull())

    @property
    def clean(self) -> DataFrame:
        return self.survivors.filter(~F.col("is_outlier") & ~F.col("is_sold_out"))

    @property
    def flagged(self) -> DataFrame:
        return self.survivors.filter(F.col("is_outlier") | F.col("is_sold_out"))

    @property
    def persistable(self) -> DataFrame:
        return self.survivors

    @cached_property
    def index_prices(self) -> DataFrame:
        return lowest_by(self.clean, ["scrape_date", "origin", "destination", "window_days", "carrier"])

    @property
    def reasons(self) -> DataFrame:
        return self.rejected.groupBy("scrape_date", "reject_reason").agg(F.count(F.lit(1)).alias("quotes"))

    def report(self) -> DataFrame:
        """One row per collection day: what went in, what was set aside, and why."""
        intake = self.classified.groupBy("scrape_date").agg(
            F.count(F.lit(1)).alias("input_quotes"),
            F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
        )
        ok, sold = ~F.col("is_outlier") & ~F.col("is_sold_out"), F.col("is_sold_out")
        # One pass over the survivors: a comparison group is also an index cell, so everything is counted by it first.
        cells = self.survivors.groupBy(*S.COMPARISON_GROUP).agg(
            F.sum(F.col("copies") - 1).alias("exact_duplicates"),
            F.count_if(sold).alias("sold_out"),
            F.count_if("is_outlier").alias("outliers"),
            F.count_if("components_complete").alias("components_complete"),
            F.count_if(~F.col("components_complete")).alias("components_missing"),
            F.count_if(ok).alias("output_quotes"),
            F.count_if(~sold).alias("priced"),
        )
        totals = ["exact_duplicates", "sold_out", "outliers", "components_complete", "components_missing", "output_quotes"]
        small = (F.col("priced") < S.MIN_GROUP_FOR_DISPERSION) & F.lit(self.method != "none")
        kept = cells.groupBy("scrape_date").agg(
            *[F.sum(c).alias(c) for c in totals],
            F.count_if(F.col("priced") > 0).alias("comparison_groups"),
            F.count_if((F.col("priced") > 0) & small).alias("groups_too_small_to_assess"),
            F.count_if(F.col("output_quotes") > 0).alias("index_cells"),
        )
        out = intake.join(kept, "scrape_date", "left")
        out = out.na.fill(0)
        discarded = F.col("rejected") + F.col("exact_duplicates") + F.col("outliers")
        split = F.col("components_complete") + F.col("components_missing")
        return out.withColumn("discard_rate", discarded / F.col("input_quotes")).withColumn(
            "component_completeness", F.when(split > 0, F.col("components_complete") / split).otherwise(0.0)
        )


def clean_quotes(quotes: DataFrame, method: str = "mad_log", **options) -> CleaningResult:
    """Plausibility, identity, component split and outlier flags over a table of quotes."""
    classified = classify_plausibility(quotes)
    plausible = classified.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    kept = verify_decomposition(deduplicate(plausible))
    priced = kept.filter(~F.col("is_sold_out"))
    hist = outliers.score_histogram(priced, S.COMPARISON_GROUP, method, **options)
    survivors = outliers.attach_verdicts(kept, hist, S.COMPARISON_GROUP, method)
    survivors = survivors.withColumn(
        "quality_flags",
        F.when(F.col("is_outlier"), F.concat("quality_flags", F.array(outlier_flag()))).otherwise(F.col("quality_flags")),
    )
    return CleaningResult(classified, survivors, outliers.group_summary(hist, S.COMPARISON_GROUP, method), method)
