"""Model catalogue, prices, selection, usage and run cost.

A card is one model: (model_id, ordinal, provider, cost_in, cost_out, capability columns). Catalogues hold
tens of models; usage logs are the large side and are reduced before they meet a card.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.operators.ordering import earliest

# Published prices per provider, (input, output), in the order in which providers are searched.
PRICES = {
    "openai": {
        "gpt-4o": (2.50, 10.00), "gpt-4o-mini": (0.15, 0.60), "gpt-4-turbo": (10.00, 30.00), "gpt-4": (30.00, 60.00),
        "gpt-3.5-turbo": (0.50, 1.50),
    },
    "anthropic": {
        "claude-3-5-sonnet-20241022": (3.00, 15.00), "claude-3-5-haiku-20241022": (0.80, 4.00),
        "claude-3-haiku-20240307": (0.25, 1.25), "claude-3-opus-20240229": (15.00, 75.00),
    },
    "deepseek": {"deepseek-chat": (0.14, 0.28), "deepseek-reasoner": (0.55, 2.19)},
    "qwen": {"qwen-turbo": (0.30, 0.60), "qwen-plus": (0.40, 1.00), "qwen-max": (1.20, 2.00)},
    "zhipu": {"glm-4": (0.50, 0.50), "glm-4-plus": (0.70, 0.70)},
    "moonshot": {"moonshot-v1-8k": (1.20, 1.20), "moonshot-v1-32k": (2.40, 2.40)},
    "google": {"gemini-1.5-pro": (1.25, 5.00), "gemini-1.5-flash": (0.075, 0.30), "gemini-1.0-pro": (0.50, 1.50)},
    "azure": {"gpt-4o": (5.00, 15.00), "gpt-4-turbo": (10.00, 30.00), "gpt-35-turbo": (0.50, 1.50)},
    "together": {"mistralai/Mixtral-8x7B-Instruct-v0.1": (0.60, 0.60), "meta-llama/Llama-3-70b-chat-hf": (0.90, 0.90)},
}
# Providers reachable from the restricted region.
REGIONAL = ["deepseek", "qwen", "zhipu", "moonshot", "azure"]

# Weights of the capability scores in the score of each role.
ROLE_WEIGHTS = {
    "defender": {"defense": 0.4, "instruction": 0.3, "language": 0.3},
    "attacker": {"attack": 0.4, "reasoning": 0.3, "language": 0.3},
    "evaluator": {"evaluation": 0.4, "reasoning": 0.4, "instruction": 0.2},
}
ROLES = list(ROLE_WEIGHTS)


def published_prices(spark: SparkSession) -> DataFrame:
    """The built-in price table: (model_id, provider, provider_ord, ordinal, cost_in, cost_out, regional)."""
    rows = [
        (m, p, i, 100 * i + j, float(a), float(b), p in REGIONAL)
        for i, (p, models) in enumerate(PRICES.items())
        for j, (m, (a, b)) in enumerate(models.items())
    ]
    schema = "model_id STRING, provider STRING, provider_ord INT, ordinal INT, cost_in DOUBLE, cost_out DOUBLE, regional BOOLEAN"
    return spark.createDataFrame(rows, schema)


def first_price(prices: DataFrame) -> DataFrame:
    """One price per model: that of the first provider that lists it."""
    return earliest(prices, ["model_id"], [F.col("provider_ord"), F.col("ordinal")])


def call_cost(in_tok: Column, out_tok: Column) -> Column:
    return in_tok / 1000 * F.col("cost_in") + out_tok / 1000 * F.col("cost_out")


def with_role_scores(cards: DataFrame) -> DataFrame:
    scores = {
        f"{role}_score": sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
        for role, weights in ROLE_WEIGHTS.items()
    }
    return cards.withColumns(scores)


def compare_costs(cards: DataFrame, in_tok: int = 1000, out_tok: int = 1000) -> DataFrame:
    """Cost of one call per model, cheapest first."""
    return cards.select(
        "model_id", "provider", "ordinal",
        (F.lit(in_tok) / 1000 * F.col("cost_in")).alias("input_cost"),
        (F.lit(out_tok) / 1000 * F.col("cost_out")).alias("output_cost"),
        call_cost(F.lit(in_tok), F.lit(out_tok)).alias("total_cost"),
    ).orderBy("total_cost", "ordinal")


def recommended(cards: DataFrame, budget: float | None = None) -> DataFrame:
    """Models within a budget per million tokens (half in, half out), cheapest first."""
    out = cards.withColumn("cost_per_m", (F.col("cost_in") + F.col("cost_out")) * 500)
    if budget:
        out = out.filter(F.col("cost_per_m") <= budget)
    return out.select("model_id", "provider", "ordinal", "cost_per_m").orderBy("cost_per_m", "ordinal")


def available_for_role(cards: DataFrame, providers: DataFrame, role: str | None, min_score: float = 0.7) -> DataFrame:
    """Models of available providers good enough for a role (or on average), best first."""
    mean = (F.col("defender_score") + F.col("attacker_score") + F.col("evaluator_score")) / 3
    score = F.col(f"{role}_score") if role else mean
    ready = cards.join(providers.filter("available").select("provider"), "provider", "left_semi")
    scored = ready.withColumn("score", score)
    kept = scored.filter(F.col("score") >= min_score) if role else scored
    return kept.orderBy(F.desc("score"), "ordinal")


def strategy_order(role: str, strategy: str, seed: int = 0) -> list[Column]:
    """Order whose first row is the strategy's choice; the catalogue order breaks ties."""
    score = F.col(f"{role}_score")
    orders = {
        "best_performing": F.desc(f"{role}_score"),
        "heterogeneous": F.desc(f"{role}_score"),
        "cost_optimized": F.asc("cost_in"),
        "balanced": (score / (F.col("cost_in") + F.col("cost_out") + 0.01)).desc(),
        "round_robin": F.asc("role_calls"),
        # a hash in place of a random number: the same choice in every run and on every cluster
        "random": F.md5(F.concat(F.lit(f"{seed}:"), F.col("model_id").cast("string"))).asc(),
    }
    # the candidate list is ranked by role score before a strategy looks at it
    return [orders[strategy], F.desc(f"{role}_score"), F.asc("ordinal")]


def select_for_role(
    cards: DataFrame, role: str, strategy: str, usage: DataFrame | None = None, used_providers: Sequence[str] = (), seed: int = 0
) -> DataFrame:
    """One row: the model a strategy picks for a role. `usage` counts calls per (model_id, role); `seed` varies the random strategy."""
    pool = cards.filter(~F.col("provider").isin(list(used_providers))) if used_providers else cards
    if strategy == "round_robin":
        calls = usage.filter(F.col("role") == role).groupBy("model_id").agg(F.count(F.lit(1)).alias("role_calls"))
        pool = pool.join(calls, "model_id", "left").fillna({"role_calls": 0})
    return pool.orderBy(*strategy_order(role, strategy, seed)).limit(1)


def heterogeneous_triple(cards: DataFrame) -> DataFrame:
    """Defender, then attacker, then evaluator, each from a provider not used yet."""
    taken: list[Column] = []
    rows = None
    for role in ROLES:
        pool = cards
        for provider in taken:
            pool = pool.filter(F.col("provider") != provider)
        pick = pool.orderBy(*strategy_order(role, "heterogeneous")).limit(1).select(
            F.lit(role).alias("role"), "model_id", "provider"
        )
        taken.append(pick.select("provider").scalar())
        rows = pick if rows is None else rows.unionByName(pick)
    return rows


def usage_by_model_role(usage: DataFrame, cards: DataFrame) -> DataFrame:
    """Calls, tokens and cost per (model, role); tokens are summed before prices are looked up."""
    sums = usage.groupBy("model_id", "role").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("in_tok").alias("in_tok"), F.sum("out_tok").alias("out_tok")
    )
    return sums.join(cards.select("model_id", "provider", "cost_in", "cost_out"), "model_id").select(
        "model_id", "provider", "role", "calls", (F.col("in_tok") + F.col("out_tok")).alias("tokens"),
        call_cost(F.col("in_tok"), F.col("out_tok")).alias("cost"),
    )


def usage_report(usage: DataFrame, cards: DataFrame) -> DataFrame:
    """Totals over all, by model, by provider and by role in one pass over the reduced rows.

    The cost of a role is each model's cost times the share of the role in the model's calls.
    """
    per = usage_by_model_role(usage, cards)
    model = Window.partitionBy("model_id")
    share = per.withColumn(
        "role_cost", F.sum("cost").over(model) * F.col("calls") / F.sum("calls").over(model)
    )
    return (
        share.groupingSets(
            [[], [F.col("model_id")], [F.col("provider")], [F.col("role")]],
            F.col("model_id"), F.col("provider"), F.col("role"),
        )
        .agg(
            F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("c"),
            F.sum("role_cost").alias("rc"), F.grouping_id().alias("g"),
        )
        .withColumn("cost", F.when(F.col("role").isNotNull(), F.col("rc")).otherwise(F.col("c")))
        .withColumn("cost_per_call", F.when(F.col("model_id").isNotNull(), F.col("cost") / F.col("calls")))
        .select("model_id", "provider", "role", "calls", "tokens", "cost", "cost_per_call")
    )


def excess_calls(calls: DataFrame, key: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """Per key and second: calls in the trailing window and whether they exceed the limit.

    Calls are counted per second first. Each second is then sent to the window-long bucket it lies in
    and to the next one, so a task never holds more than two windows of seconds of a key.
    """
    per_second = calls.groupBy(key, F.unix_timestamp(F.col(ts).cast("timestamp")).alias("second")).agg(
        F.count(F.lit(1)).alias("calls")
    )
    home = F.floor(F.col("second") / seconds)
    spread = per_second.withColumn("home", home).withColumn("bucket", F.explode(F.array(F.col("home"), F.col("home") + 1)))
    trailing = Window.partitionBy(key, "bucket").orderBy("second").rangeBetween(-seconds, 0)
    return (
        spread.withColumn("trailing", F.sum("calls").over(trailing))
        .filter("bucket = home")
        .select(key, "second", "calls", "trailing", (F.col("trailing") > limit).alias("over_limit"))
    )


def run_cost(cards: DataFrame, chosen: dict[str, str], profiles: Column, rounds: int, in_tok: int, out_tok: int) -> DataFrame:
    """Cost rows per role with a warning where a model has no price."""
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(m).alias("model_id")) for r, m in chosen.items()]))
    base = cards.sparkSession.range(1).select(roles.alias("r")).select("r.*")
    calls = F.lit(rounds) * profiles
    return (
        base.join(cards.select("model_id", "provider", "cost_in", "cost_out"), "model_id", "left")
        .withColumn("calls", calls)
        .withColumn("total_cost", call_cost(F.col("calls") * in_tok, F.col("calls") * out_tok))
        .withColumn("cost_per_profile", F.col("total_cost") / profiles)
        .withColumn(
            "warning", F.when(F.col("provider").isNull(), F.concat(F.lit("no price for "), F.col("role"), F.lit(": "), F.col("model_id")))
        )
        .select("role", "model_id", "provider", "calls", "total_cost", "cost_per_profile", "warning")
    )


def call_volume(samples: Column, rounds: int, quality_rate: float) -> list[Column]:
    """Calls of a plain run, of a run with quality checks, and the increase in percent."""
    plain = samples * rounds * len(ROLES)
    extra = F.floor(samples * quality_rate).cast("long")
    return [
        plain.alias("plain"), (plain + extra).alias("with_quality"), F.round(extra / plain * 100, 6).alias("increase"),
    ]


def accessibility_lists(providers: DataFrame) -> DataFrame:
    """(list, provider): every list a provider belongs to."""
    flags = ["regional", "international", "requires_vpn", "blocked", "free_tier", "credit_card"]
    on = [F.when(F.col(f), F.lit(f)) for f in flags]
    on += [F.when(~F.col("credit_card"), F.lit("local_payment")), F.concat(F.lit("registration_"), F.col("difficulty"))]
    lists = F.filter(F.array(*on), lambda x: x.isNotNull())
    return providers.select(F.explode(lists).alias("list"), "provider")


def model_comparison(cards: DataFrame) -> DataFrame:
    """Cost rank, mean-score rank and the roles a model is best for. The windows run over the catalogue only."""
    mean = (F.col("defender_score") + F.col("attacker_score") + F.col("evaluator_score")) / 3
    whole = Window.partitionBy(F.lit(0))
    ranked = cards.withColumn("mean_score", mean).withColumn(
        "cost_rank", F.row_number().over(whole.orderBy("cost_in", "ordinal"))
    ).withColumn("score_rank", F.row_number().over(whole.orderBy(F.desc("mean_score"), "ordinal")))
    best = [
        F.when(F.row_number().over(whole.orderBy(F.desc(f"{r}_score"), "ordinal")) == 1, F.lit(r)) for r in ROLES
    ]
    return ranked.withColumn("best_for", F.concat_ws(",", *best)).select(
        "model_id", "provider", "mean_score", "cost_rank", "score_rank", "best_for"
    )


def cost_summary(cards: DataFrame, providers: DataFrame) -> DataFrame:
    """Mean prices and model counts of the available providers."""
    return (
        cards.join(providers.filter("available").select("provider", "regional"), "provider")
        .groupBy("provider", F.when(F.col("regional"), "regional").otherwise("international only").alias("reach"))
        .agg(F.count(F.lit(1)).alias("models"), F.round(F.avg("cost_in"), 6).alias("cost_in"), F.round(F.avg("cost_out"), 6).alias("cost_out"))
    )
