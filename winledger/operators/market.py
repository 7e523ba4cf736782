"""Catalogs, prices, grades: what is on the market and how it is graded over time.

Grade cards are (model_id, score, quality{value,n,ci_low,ci_high}, n, status, updated_at,
ci_width_points, history[], econ{cpat_usd,ttat_s,n_successes,price_in,price_out,price_note},
clusters MAP). Catalogs and cards hold one row per model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winledger.functions.rules import (
    FREE_PROVIDERS,
    lab_of,
    longest_price,
    first_price,
    provider_of,
)
from winledger.functions.stats import proportion
from winledger.operators.checks import grade_outputs
from winledger.operators.metrics import core_metrics
from winledger.plans.ordered import ranked

PROVISIONAL_MIN_N = 30
CONFIRMED_MIN_N = 600
STALE_AFTER_HOURS = 48
HISTORY_CAP = 30
NEW_DAYS = 21

CARD_TYPES = {
    "model_id": "string",
    "score": "double",
    "quality": "struct<value:double,n:bigint,ci_low:double,ci_high:double>",
    "n": "bigint",
    "status": "string",
    "updated_at": "timestamp",
    "ci_width_points": "double",
    "history": "array<double>",
    "econ": "struct<cpat_usd:double,ttat_s:double,n_successes:bigint,price_in:double,"
            "price_out:double,price_note:string>",
    "clusters": "map<string,double>",
}

# Fixed value: ids that are not chat models.
NON_CHAT = (
    r"(?i)whisper|tts|audio|embed|guard|moderation|rerank|orpheus|ocr|imagen|veo|aqa|learnlm"
    r"|image|vision-|live|native-audio|gemini-1|robotics|computer-use|-exp$|safety"
)
# Models one provider may have graded per tick.
PER_TICK = {
    "openrouter": 4, "github": 2, "google": 3, "mistral": 3, "cerebras": 3, "openai": 1,
    "anthropic": 1,
}
# Flagships worth listing when not new, one per lab.
FLAGSHIPS = ("anthropic/claude", "openai/gpt", "google/gemini", "x-ai/grok", "deepseek/")


# -------------------------------------------------------------------- prices
def price_exact(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows with the price of exactly their model id; ``unpriced`` marks those without one."""
    marked = prices.select("model_id", "input_per_mtok", "output_per_mtok",
                           F.lit(True).alias("_priced"))
    return (
        df.join(marked, "model_id", "left")
        .withColumn("unpriced", F.col("_priced").isNull()).drop("_priced")
    )


def price_longest(df: DataFrame, live: DataFrame | None = None, **rules) -> DataFrame:
    """Rows with price_in, price_out and note: the live catalog first (a ':free' id is priced as
    its paid sibling), then the longest matching rule, then a labelled estimate.

    ``live`` is (id, price_in, price_out), one row per model on the market."""
    paid = F.regexp_replace(F.col("model_id"), r":free\z", "")
    rule = longest_price(F.col("_paid"), **rules)
    rows = df.withColumn("_paid", paid)
    if live is None:
        return rows.withColumn("_p", rule).select(*df.columns, "_p.*")
    offers = live.filter((F.col("price_in") > 0) | (F.col("price_out") > 0)).groupBy("id").agg(
        F.max(F.struct(F.col("price_in").cast("decimal(14,6)").alias("price_in"),
                       F.col("price_out").cast("decimal(14,6)").alias("price_out"),
                       F.lit("list").alias("note"))).alias("_o"))
    by_paid = offers.select(F.col("id").alias("_paid"), F.col("_o").alias("_a"))
    by_id = offers.select(F.col("id").alias("model_id"), F.col("_o").alias("_b"))
    joined = rows.join(by_paid, "_paid", "left").join(by_id, "model_id", "left")
    return joined.withColumn("_p", F.coalesce("_a", "_b", rule)).select(*df.columns, "_p.*")


def price_first(df: DataFrame, **rules) -> DataFrame:
    """Rows with price_in and price_out of the first matching rule; unknown models are free."""
    return df.withColumn("_p", first_price(F.col("model_id"), **rules)).select(*df.columns, "_p.*")


def map_prefix(df: DataFrame) -> DataFrame:
    """Rows with the ``lab`` and the serving ``provider`` of their model id."""
    return df.withColumn("lab", lab_of(F.col("model_id"))).withColumn(
        "provider", provider_of(F.col("model_id")))


# ------------------------------------------------------------------ catalogs
def parse_catalog(bodies: DataFrame) -> DataFrame:
    """(provider, body) with /models bodies as JSON text -> (provider, model_id, version_hint).

    A body is an object with ``data`` or a bare list. Body order is kept in ``position``."""
    item = "array<struct<id:string,created:string,updated_at:string,version:string>>"
    listed = F.coalesce(
        F.from_json("body", f"struct<data:{item}>")["data"], F.from_json("body", item)
    )
    rows = bodies.select("provider", F.posexplode(listed).alias("position", "m"))
    bare = F.regexp_replace(F.trim(F.coalesce(F.col("m.id"), F.lit(""))), r"^models/", "")

    def given(c: str) -> Column:
        v = F.col(c)
        return F.when(~v.isin("", "0", "false"), v)

    return rows.select(
        "provider", bare.alias("model_id"),
        F.coalesce(given("m.created"), given("m.updated_at"), given("m.version"),
                   F.lit("unknown")).alias("version_hint"),
        "position",
    ).filter(F.col("model_id") != "")


def parse_market(bodies: DataFrame, now: Column) -> DataFrame:
    """(body) with a market catalog as JSON text -> one row per model with prices per million,
    age, the free flag and modalities. Aliases (~) and batch variants are dropped."""
    item = (
        "struct<id:string,name:string,created:bigint,context_length:bigint,"
        "pricing:struct<prompt:string,completion:string>,"
        "architecture:struct<input_modalities:array<string>>>"
    )
    parsed = F.from_json("body", f"struct<data:array<{item}>>")["data"]
    rows = bodies.select(F.posexplode(parsed).alias("position", "m"))
    mid = F.trim(F.coalesce(F.col("m.id"), F.lit("")))
    rows = rows.withColumn("id", mid).filter(
        (mid != "") & ~mid.startswith("~") & ~mid.endswith(":batch")
    )

    def price(c: str) -> Column:
        text = F.col(f"m.pricing.{c}")
        return F.when(text.isNull() | (text == ""), 0.0).otherwise(text.try_cast("double")) * 1e6

    p_in, p_out = price("prompt"), price("completion")
    bad = p_in.isNull() | p_out.isNull()
    p_in, p_out = F.when(bad, 0.0).otherwise(p_in), F.when(bad, 0.0).otherwise(p_out)
    stamp = F.coalesce(F.col("m.created"), F.lit(0))
    created = F.when(stamp != 0, F.timestamp_seconds(stamp)).otherwise(now)
    days = F.floor((F.unix_seconds(now) - F.unix_seconds(created)) / 86400).cast("int")
    mods = F.col("m.architecture.input_modalities")
    return rows.select(
        "id",
        F.coalesce(F.nullif(F.col("m.name"), F.lit("")), "id").alias("name"),
        F.split("id", "/")[0].alias("vendor"),
        F.round(p_in, 4).alias("price_in"),
        F.round(p_out, 4).alias("price_out"),
        F.coalesce("m.context_length", F.lit(0)).alias("context"),
        F.date_format(created, "yyyy-MM-dd").alias("created"),
        F.greatest(F.lit(0), days).alias("age_days"),
        (F.col("id").endswith(":free") | ((p_in == 0) & (p_out == 0))).alias("free"),
        F.when(F.size(mods) > 0, F.array_join(mods, "+")).otherwise("text").alias("modalities"),
        "position",
    )


def diff_catalog(current: DataFrame, known: DataFrame) -> DataFrame:
    """Changes between the fetched catalog and the versions last graded (model_id, version_hint):
    new and upgraded first, removed last, then by id (``ordinal``)."""
    seen = known.select("model_id", F.col("version_hint").alias("previous_version"),
                        F.lit(True).alias("_known"))
    now = current.select("provider", "model_id", F.col("version_hint").alias("current_version"),
                         F.lit(True).alias("_now"))
    both = now.join(seen, "model_id", "full_outer")
    change = (
        F.when(F.col("_known").isNull(), "new").when(F.col("_now").isNull(), "removed")
        .when(~F.col("previous_version").eqNullSafe(F.col("current_version")), "upgraded")
    )
    rows = both.withColumn("change", change).filter(F.col("change").isNotNull())
    rank = F.when(F.col("change") == "new", 0).when(F.col("change") == "upgraded", 1).otherwise(2)
    placed = ranked(rows, {"_o1": rank, "_o2": F.col("model_id"), "_o3": F.coalesce("provider", F.lit(""))}, "ordinal")
    return placed.select(
        F.coalesce("provider", F.lit("unknown")).alias("provider"), "model_id", "change",
        "previous_version", "current_version", "ordinal",
        (F.col("change") != "removed").alias("needs_grading"),
    )


def gradable(catalog: DataFrame, *, allow_paid: bool = False) -> DataFrame:
    """Chat models; on the router provider only free variants unless paid grading is allowed."""
    chat = ~F.col("model_id").rlike(NON_CHAT)
    cheap = (F.col("provider") != "openrouter") | F.col("model_id").endswith(":free")
    return catalog.filter(chat & (F.lit(allow_paid) | cheap))


def rotate(
    catalog: DataFrame, cards: DataFrame, caps: Mapping[str, int] | None = None
) -> DataFrame:
    """Per provider at most ``cap`` models this tick: ungraded first, then catalog order."""
    limits = dict(caps or PER_TICK)
    cap = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    graded = cards.select("model_id", F.col("n").alias("_n"))
    rows = catalog.join(graded, "model_id", "left")
    fresh = (F.coalesce("_n", F.lit(0)) == 0)
    order = Window.partitionBy("provider").orderBy(fresh.desc(), "position", "model_id")
    limit = F.try_element_at(cap, F.col("provider"))
    most = max(limits.values(), default=0)
    # Only capped providers are ranked, and no task sends on more of one than the largest cap.
    capped = (
        rows.filter(limit.isNotNull()).withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= most).filter(F.col("_r") <= limit).drop("_r", "_n")
    )
    return capped.unionByName(rows.filter(limit.isNull()).drop("_n"))


# -------------------------------------------------------------------- grades
def card_status(n: Column, updated_at: Column, now: Column) -> Column:
    age = F.unix_micros(now) - F.unix_micros(updated_at)
    stale = age > STALE_AFTER_HOURS * 3_600_000_000
    return F.when(n < CONFIRMED_MIN_N, "provisional").when(stale, "stale").otherwise("confirmed")


def append_history(history: Column, score: Column) -> Column:
    past = F.coalesce(history, F.array().cast("array<double>"))
    grown = F.when(score.isNotNull(), F.concat(past, F.array(score))).otherwise(past)
    return F.slice(grown, F.greatest(F.size(grown) - HISTORY_CAP + 1, F.lit(1)), F.lit(HISTORY_CAP))


def classify_cards(cards: DataFrame, now: Column, *, append: bool = False) -> DataFrame:
    """Cards with status, interval width, history (``append`` adds the score), the movement since
    the last grade, whether they may be published, and the sampling they need next."""
    q = F.col("quality")
    rows = cards.withColumn("n", q["n"]).withColumn("status", card_status(
        F.col("n"), F.col("updated_at"), now)
    ).withColumn("ci_width_points", F.bround((q["ci_high"] - q["ci_low"]) * 100, 1))
    past = F.col("history") if "history" in cards.columns else F.lit(None).cast("array<double>")
    rows = rows.withColumn("history", append_history(past, F.col("score")) if append else F.coalesce(
        past, F.array().cast("array<double>")))
    h = F.col("history")
    moved = F.when(
        F.col("score").isNotNull() & (F.size(h) >= 2),
        F.bround(F.element_at(h, -1) - F.get(h, F.size(h) - 2), 1),
    )
    return rows.withColumns({
        "delta_points": moved,
        "is_publishable": (F.col("status") != "stale") & (F.col("n") >= PROVISIONAL_MIN_N)
        & F.col("score").isNotNull(),
        "next_cadence": F.when(F.col("status") == "confirmed", "weekly").otherwise("daily"),
    })


def grading_tick(
    cards: DataFrame, catalog: DataFrame, known: DataFrame, grades: DataFrame, now: Column, *,
    budget, est=0.05,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards after the tick, what was due, catalog changes).

    Due are changed models by id, then provisional and stale cards by oldest update; as many as the
    budget's estimates allow are graded. ``grades`` holds the new results (model_id, quality, score,
    econ, clusters); its ``cost_usd`` is not needed, the estimate decides. A re-sample with fewer
    than 30 trials never replaces a card with 30 or more; missing parts fall back to the prior card.
    """
    changes = diff_catalog(catalog, known)
    changed = changes.filter("needs_grading").select("model_id").distinct().withColumn(
        "_changed", F.lit(True))
    state = cards.withColumn(
        "_fresh", card_status(F.col("quality.n"), F.col("updated_at"), now)
    )
    both = state.join(changed, "model_id", "full_outer")
    hot = F.coalesce("_changed", F.lit(False))
    due = both.filter(hot | F.col("_fresh").isin("provisional", "stale")).select(
        "model_id", hot.alias("changed"),
        F.when(~hot, F.col("updated_at")).alias("_since"),
    )
    slots = int(round(float(budget) / float(est), 9))
    since = F.coalesce(F.unix_micros("_since"), F.lit(-(1 << 63)))
    queue = ranked(due, {"_o1": (~F.col("changed")).cast("int"), "_o2": since, "_o3": F.col("model_id")}, "position"
                   ).withColumn("graded", F.col("position") <= slots).drop("_since")

    new = grades.join(queue.filter("graded").select("model_id"), "model_id", "left_semi").select(
        "model_id", F.struct(*[
            F.col(c).cast(CARD_TYPES[c]).alias(c) for c in ("score", "quality", "econ", "clusters")
        ]).alias("_new"))
    old = cards.select("model_id", F.struct(*[
        F.col(c).cast(CARD_TYPES[c]).alias(c)
        for c in ("score", "quality", "updated_at", "history", "econ", "clusters")
    ]).alias("_old"))
    merged = old.join(new, "model_id", "full_outer")
    o, n = F.col("_old"), F.col("_new")
    keep = n.isNull() | F.coalesce(
        (o["quality"]["n"] >= PROVISIONAL_MIN_N) & (n["quality"]["n"] < PROVISIONAL_MIN_N),
        F.lit(False))
    after = merged.select(
        "model_id",
        F.when(keep, o["score"]).otherwise(n["score"]).alias("score"),
        F.when(keep, o["quality"]).otherwise(n["quality"]).alias("quality"),
        F.when(keep, o["updated_at"]).otherwise(now).alias("updated_at"),
        F.when(keep, o["history"]).otherwise(append_history(o["history"], n["score"]))
        .alias("history"),
        F.when(keep, o["econ"]).otherwise(F.coalesce(n["econ"], o["econ"])).alias("econ"),
        F.when(keep, o["clusters"]).otherwise(F.coalesce(n["clusters"], o["clusters"]))
        .alias("clusters"),
    )
    return classify_cards(after, now), queue, changes


def grade_counts(cards: DataFrame) -> DataFrame:
    return cards.agg(*[
        F.count_if(F.col("status") == s).alias(f"n_{s}")
        for s in ("provisional", "confirmed", "stale")
    ])


def pool_quality(metrics: DataFrame, *, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Per model: success pooled over clusters as a score (0-100) and a proportion."""
    rate, n = F.col("success_rate.value"), F.col("success_rate.n")
    sums = metrics.groupBy(*by).agg(
        F.rint(F.sum(n * F.coalesce(rate, F.lit(0.0)))).alias("_s"), F.sum(n).alias("_n")
    )
    pooled = sums.select(*by, proportion(F.col("_s"), F.col("_n")).alias("quality"))
    return pooled.withColumn("score", F.bround(F.col("quality.value") * 100, 1))


def pool_economics(
    metrics: DataFrame, prices: DataFrame | None = None, *, by: Sequence[str] = ("model_id",)
) -> DataFrame:
    """Per model: cost and time per win pooled over clusters, weighted by wins; none without wins."""
    wins = F.col("cpat_usd.n_successes")
    sums = metrics.groupBy(*by).agg(
        F.sum(wins).alias("n_successes"),
        F.sum(F.col("cpat_usd.value").cast("decimal(28,12)") * wins).alias("_spend"),
        F.sum(F.coalesce("ttat_seconds.value", F.lit(0.0)) * F.col("ttat_seconds.n_successes"))
        .alias("_secs"),
    ).filter(F.col("n_successes") > 0)
    econ = sums.select(
        *by, F.bround((F.col("_spend") / F.col("n_successes")).cast("double"), 6).alias("cpat_usd"),
        F.bround(F.col("_secs") / F.col("n_successes"), 2).alias("ttat_s"), "n_successes",
    )
    return econ if prices is None else econ.join(prices, list(by), "left")


def bench_metrics(outputs: DataFrame, tasks: DataFrame, prices: DataFrame) -> DataFrame:
    """Core metrics by (cluster, model) of a benchmark run: each graded output is one measured task
    whose cost is its tokens at the model's price."""
    graded = price_exact(grade_outputs(outputs, tasks), prices)
    per_token = F.lit("0.000001").cast("decimal(7,6)")
    cost = (
        F.col("input_tokens").cast("decimal(18,0)")
        * (F.col("input_per_mtok") * per_token).cast("decimal(18,12)")
        + F.col("output_tokens").cast("decimal(18,0)")
        * (F.col("output_per_mtok") * per_token).cast("decimal(18,12)")
    )
    as_tasks = graded.select(
        F.col("cluster").alias("cluster_id"), "model_id",
        F.col("passed").alias("succeeded"), F.lit(1).alias("attempts"),
        cost.cast("decimal(28,12)").alias("total_cost_usd"),
        F.greatest(F.lit(1), F.col("wall_ms")).alias("total_wall_ms"),
        F.lit("measured").alias("verification_grade"),
    )
    return core_metrics(as_tasks, by=["cluster_id", "model_id"])


def measured_cards(cards: DataFrame) -> DataFrame:
    """Cards with a score from at least 30 trials."""
    return cards.filter(F.col("score").isNotNull() & (F.col("n") >= PROVISIONAL_MIN_N))


def composite_index(cards: DataFrame) -> DataFrame:
    """One row: mean grade of the ten best measured models, the upper median of their cost per
    task, and who they are."""
    best = measured_cards(cards).orderBy(F.col("score").desc(), "model_id").limit(10)
    listed = best.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("_mean"),
        F.array_sort(F.array_compact(F.collect_list("econ.cpat_usd"))).alias("_c"),
        F.transform(F.array_sort(F.collect_list(F.struct(-F.col("score"), F.col("model_id")))),
                    lambda m: m["model_id"]).alias("members"),
    )
    middle = F.floor(F.size("_c") / 2).cast("int")
    return listed.select(
        F.bround("_mean", 2).alias("value"), F.get("_c", middle).alias("median_cpat_usd"), "n",
        "members")


def feed_rows(cards: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of the public feed: badges (all measured, ranked), grade moves (top 15), new models
    (at most 7 days old, 15 youngest)."""
    rows = ranked(measured_cards(cards), {
        "_o1": F.coalesce(-F.col("score"), F.lit(float("inf"))), "_o2": F.col("model_id")})
    h = F.col("history")
    move = F.when(F.size(h) >= 2, F.element_at(h, -1) - F.get(h, F.size(h) - 2)).otherwise(0.0)
    badge = rows.select(
        F.lit("badge").alias("kind"), "rank", "model_id", "score",
        F.lit(None).cast("double").alias("delta"), F.col("econ.cpat_usd").alias("cpat_usd"))
    moves = rows.filter("rank <= 15").select(
        F.lit("move").alias("kind"), "rank", "model_id", "score", move.alias("delta"),
        F.col("econ.cpat_usd").alias("cpat_usd"))
    age = F.when(F.col("age_days") == 0, 999).otherwise(F.col("age_days"))
    young = live.filter(F.coalesce(age, F.lit(999)) <= 7)
    place = F.row_number().over(Window.orderBy("age_days", "position", "id"))
    new = young.orderBy("age_days", "position", "id").limit(15).withColumn("rank", place).select(
        F.lit("new").alias("kind"), "rank", F.col("id").alias("model_id"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("delta"),
        F.lit(None).cast("double").alias("cpat_usd"))
    return badge.unionByName(moves).unionByName(new)


# --------------------------------------------------------------------- picks
def auto_pick(cards: DataFrame, connected: Sequence[str]) -> DataFrame:
    """Publishable cards of connected providers: whole score points first, then cost per task."""
    cpat = F.coalesce("econ.cpat_usd", F.lit(0.0))
    ok = (F.col("n") >= PROVISIONAL_MIN_N) & (F.col("score") >= 60.0)
    served = provider_of(F.col("model_id"))
    rows = cards.filter(ok & served.isin(*connected)).select(
        "model_id", "score", cpat.alias("cpat_usd"))
    return ranked(rows, {"_o1": -F.rint("score"), "_o2": F.col("cpat_usd"), "_o3": F.col("model_id")})


def route(candidates: DataFrame, *, min_grade: float = 0.0, prefer_free: bool = True) -> DataFrame:
    """The best grade at or above the bar, from the free tier when it has any."""
    rows = candidates.filter(F.col("grade") >= min_grade)
    free = F.col("free").cast("int") if prefer_free else F.lit(0)
    best = F.struct(-free, -F.col("grade"), F.col("model_id"))
    whole = F.struct(*[F.col(c) for c in candidates.columns])
    return rows.agg(F.min_by(whole, best).alias("_w")).filter(F.col("_w").isNotNull()).select("_w.*")


def candidates_from(cards: DataFrame) -> DataFrame:
    served = provider_of(F.col("model_id"))
    return cards.select(
        "model_id", served.alias("provider"), F.coalesce("score", F.lit(0.0)).alias("grade"),
        served.isin(*FREE_PROVIDERS).alias("free"))


def replacement_grades(retirements: DataFrame, grades: DataFrame) -> DataFrame:
    """Retirements exploded to one row per replacement, with both grades and their difference."""
    own = grades.select("model_id", F.col("grade").alias("incumbent_grade"))
    other = grades.select(F.col("model_id").alias("replacement"), F.col("grade"))
    rows = retirements.select("*", F.posexplode_outer("replacements").alias("option", "replacement"))
    return (
        rows.join(own, "model_id", "left").join(other, "replacement", "left")
        .withColumn("grade_delta", F.bround(F.col("grade") - F.col("incumbent_grade"), 1))
    )


def radar(retirements: DataFrame, grades: DataFrame, today: Column) -> DataFrame:
    """Retirements by urgency, soonest first, with their replacement options."""
    left = F.datediff("retires_on", today)
    urgency = (
        F.when((F.col("status") == "retired") | (left < 0), "retired").when(left <= 30, "critical")
        .when(left <= 90, "soon").when(left <= 180, "watch").otherwise("clear")
    )
    options = replacement_grades(retirements, grades).groupBy("provider", "model_id").agg(
        F.array_sort(F.collect_list(F.when(
            F.col("replacement").isNotNull(),
            F.struct("option", F.col("replacement").alias("model_id"), "grade", "grade_delta"))))
        .alias("replacements"))
    rows = retirements.drop("replacements").withColumn("days_left", left).withColumn(
        "urgency", urgency).join(options, ["provider", "model_id"], "left")
    rank = F.array_position(
        F.array(*[F.lit(u) for u in ("critical", "soon", "watch", "clear", "retired")]), F.col("urgency"))
    soonest = F.coalesce("days_left", F.lit(-(1 << 31)))
    return ranked(rows, {"_o1": rank, "_o2": soonest, "_o3": F.coalesce("provider", F.lit("")),
                         "_o4": F.col("model_id")}, "ordinal").withColumn(
        "actionable", F.col("urgency").isin("critical", "soon"))


def picker_rows(market: DataFrame, *, cap: int = 40) -> DataFrame:
    """Models for the picker: new, then free, then one paid flagship per lab; each id once, at most
    ``cap``. ``market`` is in feed order by ``position``."""
    hint = F.coalesce(*[F.when(F.col("id").startswith(h), F.lit(i))
                        for i, h in enumerate(FLAGSHIPS)])
    rows = market.withColumn("_hint", F.when(~F.col("free"), hint))
    # One row for each flagship family.
    firsts = rows.filter(F.col("_hint").isNotNull()).groupBy(F.col("_hint").alias("_h")).agg(
        F.min("position").alias("_first"))
    rows = rows.join(F.broadcast(firsts), F.col("_hint") == F.col("_h"), "left").withColumn(
        "_flag", F.coalesce(F.col("position") == F.col("_first"), F.lit(False)))
    group = (
        F.when(F.col("age_days") <= NEW_DAYS, 0).when(F.col("free"), 1).when(F.col("_flag"), 2)
    )
    listed = rows.withColumn("_g", group).filter(F.col("_g").isNotNull())
    once = listed.groupBy("id").agg(F.min(F.struct(
        "_g", "position", "name", "price_in", "price_out", "free", "age_days", "modalities",
        "context")).alias("_m")).select("id", "_m.*")
    order = Window.orderBy("_g", "position", "id")
    price = F.when(F.col("free"), "free").otherwise(
        F.concat(F.lit("$"), _general(F.col("price_in")), F.lit("/$"),
                 _general(F.col("price_out")), F.lit(" per M")))
    tag = F.array_join(F.array_compact(F.array(
        F.when(F.col("age_days") <= NEW_DAYS, "new"), price,
        F.when(F.contains(F.col("modalities"), F.lit("image")), "vision"),
        F.when(F.col("context") >= 1_000_000, "1M ctx"))), " · ")
    return (
        once.orderBy("_g", "position", "id").limit(cap).withColumn("rank", F.row_number().over(order))
        .select("rank", "id", "name", F.lit("openrouter").alias("provider"), tag.alias("tag"))
    )


def _general(c: Column) -> Column:
    """A price without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), r"0+\z", ""), r"\.\z", "")
