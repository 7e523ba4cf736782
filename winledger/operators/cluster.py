"""Task taxonomy from metadata: template, tool signature, output shape.

Tasks are reduced to cells of equal categories. A density hierarchy is built over the cells: two cells are as far
apart as the categories in which they differ weigh, so distances come in a few levels, and the cells within a
level of a cell are those that share some of its categories. Sums by shared categories give every cell its core
distance; linked cells meet at the categories they share, so components at a level come from joins of cells with
categories and never from pairs of cells. Of the tree of components that hold enough tasks the most stable
branches are the clusters, and tasks outside join the nearest centroid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winledger.functions.text import squeeze
from winledger.operators.tasks import TASK
from winledger.plans.graph import components
from winledger.plans.ordered import held, ranked

TEMPLATE_WEIGHT = 9.0
TOOLS_WEIGHT = 4.0
TYPE_WEIGHT = 1.0
"""Squared weights of the one-hot blocks."""
TARGET = 15
MERGE_ABOVE = 20
KEPT = 100
"""Labels that are merged one by one; smaller ones join the nearest of these first."""
NODES = 10_000
"""Branches the tree may have: there are no more than ``tasks / min_size`` on each level."""
LEVELS = (0.01, 4.0, 8.0, 12.0, 18.0, 22.0, 26.0, 30.0)
"""Squared distances of cells that differ in nothing but length, in the output shape, the tools, both, the template,
the template and the shape, the template and the tools, and everything. A shape counts in full."""

CELL = ["template", "tool_sig", "out_type", "json_valid", "has_code"]


def tool_signature(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, ">")).otherwise(F.lit("<none>"))


def needed() -> dict[str, Column]:
    """The fields of an attempt that ``task_features`` reads, under their names."""
    output = [F.col(f"output_shape.{c}") for c in ("type", "json_valid", "has_code_block", "n_chars")]
    return {
        "input_shape": F.struct(F.col("input_shape.system_prompt_fingerprint")),
        "tool_calls": F.transform("tool_calls", lambda c: F.struct(c["name"].alias("name"))),
        "output_shape": F.struct(*output),
    }


def task_features(representatives: DataFrame) -> DataFrame:
    """The categories and the scaled length of each task's representative attempt."""
    return representatives.select(
        "tenant_id",
        "task_id",
        F.col("input_shape.system_prompt_fingerprint").alias("template"),
        tool_signature(F.transform("tool_calls", lambda c: c["name"])).alias("tool_sig"),
        F.col("output_shape.type").alias("out_type"),
        F.col("output_shape.json_valid").alias("json_valid"),
        F.col("output_shape.has_code_block").alias("has_code"),
        (F.log1p(F.col("output_shape.n_chars").cast("double")) / 10.0).alias("len"),
    )


def _key(*columns: str) -> Column:
    """The values as one string, NULL told apart."""
    return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]))


def cells(features: DataFrame) -> DataFrame:
    """Tasks per combination of categories, with the sum of their lengths, and the categories as keys:
    ``t`` template, ``s`` tools, ``h`` output shape."""
    return features.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len_sum")).select(
        *CELL, "n", "len_sum", _key("template").alias("t"), _key("tool_sig").alias("s"),
        _key("out_type", "json_valid", "has_code").alias("h"))


def core_levels(grouped: DataFrame, total: int, min_size: int) -> DataFrame:
    """Cells with ``core``: the first of ``LEVELS`` within which ``min_size`` tasks lie around the cell."""
    rows = grouped
    for keys in (("t",), ("s",), ("h",), ("t", "s"), ("t", "h"), ("s", "h")):
        name = f"_{''.join(keys)}"
        sums = grouped.groupBy(*[F.col(k).alias(f"_{k}_key") for k in keys]).agg(F.sum("n").alias(name))
        same = [F.col(k) == F.col(f"_{k}_key") for k in keys]
        rows = rows.join(sums, on=same).drop(*[f"_{k}_key" for k in keys])
    n, t, s, h, ts, th, sh = (F.col(c) for c in ("n", "_t", "_s", "_h", "_ts", "_th", "_sh"))
    around = (n, ts, ts + th - n, t, t + sh - n, t + s - ts, t + s - ts + h - th - sh + n, F.lit(total))
    core = F.coalesce(*[F.when(mass >= min_size, i) for i, mass in enumerate(around)])
    return rows.withColumn("core", core).drop("_t", "_s", "_h", "_ts", "_th", "_sh")


LINKS = ((2, ("t", "s"), (("t", "h"),)), (4, ("t",), (("s", "h"),)), (5, ("t",), (("s",),)), (6, ("t",), (("s",), ("h",))))
"""Level, the keys that cells of one node share, and the keys at which nodes meet."""


def component_levels(rows: DataFrame) -> DataFrame:
    """Cells with ``c0`` to ``c7``: the component of the cell at each of ``LEVELS``, NULL below its core distance.

    On some levels the components are the cells with equal keys; on those of ``LINKS`` nodes meet at shared keys of
    their active cells. All levels are one edge table whose keys hold the level."""
    for level, keys in ((0, ("t", "s", "h")), (1, ("t", "s")), (3, ("t",))):
        rows = rows.withColumn(f"c{level}", F.when(F.col("core") <= level, F.xxhash64(F.lit(level), *keys)))
    rows = held(rows)
    key = lambda level, k: F.xxhash64(F.lit(level), F.lit("|".join(k)), *[F.col(c) for c in k])
    pairs = [F.when(F.col("core") <= level, F.struct(key(level, near).alias("a"), key(level, k).alias("b")))
             for level, near, shared in LINKS for k in shared]
    edges = rows.select(F.explode(F.array_compact(F.array(*pairs))).alias("e")).select("e.*").distinct()
    roots = held(components(edges))
    for level, near, _ in LINKS:
        rows = rows.withColumn("_near", key(level, near)).join(roots, F.col("_near") == F.col("node"), "left").withColumn(
            f"c{level}", F.when(F.col("core") <= level, F.col("root"))).drop("_near", "node", "root")
    return held(rows.withColumn("c7", F.lit(0).cast("long")))


def stable_branches(nodes: list[tuple[int, int, int | None, int]]) -> list[tuple[int, int]]:
    """(level, component) of the branches to keep, from (level, component, parent, tasks) of all that are large enough.

    A component with one large part goes on as that part; with several it ends and they begin. A branch is as stable
    as its tasks times the densities it lasts through. It is kept if it is no less stable than what begins inside
    it; the whole never is."""
    density = [level**-0.5 for level in LEVELS] + [0.0]
    parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for level, comp, parent, _ in nodes:
        parts.setdefault((level + 1, parent), []).append((level, comp))
    lasts, inside = {}, {}
    for level, comp, _, n in sorted(nodes):
        mine = parts.get((level, comp), [])
        lasts[level, comp] = n * (density[level] - density[level + 1])
        if len(mine) == 1:
            lasts[level, comp] += lasts[mine[0]]
            inside[level, comp] = inside[mine[0]]
        else:
            inside[level, comp] = sum(max(lasts[p], inside[p]) for p in mine)
    kept, look = [], [(len(LEVELS) - 1, comp) for level, comp, *_ in nodes if level == len(LEVELS) - 1]
    while look:
        mine = parts.get(look.pop(), [])
        begins = len(mine) > 1
        for p in mine:
            if begins and lasts[p] >= inside[p]:
                kept.append(p)
            else:
                look.append(p)
    return sorted(kept)


def _found(rows: DataFrame, min_size: int) -> DataFrame | None:
    """The cells of ``component_levels`` with ``label`` (1 for the largest cluster, NULL outside), or nothing if
    there is no cluster. No more than ``NODES`` branches of the tree come to the driver."""
    steps = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"c{i}").alias("comp"),
                               (F.col(f"c{i + 1}") if i < 7 else F.lit(None).cast("long")).alias("parent"))
                      for i in range(8)])
    spread = rows.select("n", F.explode(steps).alias("e")).filter("e.comp IS NOT NULL")
    nodes = (spread.groupBy("e.level", "e.comp", "e.parent").agg(F.sum("n").alias("n"))
             .filter(F.col("n") >= min_size).limit(NODES + 1).collect())
    if len(nodes) > NODES:
        raise ValueError(f"min_size {min_size} leaves more than {NODES} branches; raise it")
    kept = stable_branches([(r["level"], r["comp"], r["parent"], r["n"]) for r in nodes])
    if not kept:
        return None
    spark = rows.sparkSession
    own = F.coalesce(*[F.when(F.col(f"c{i}").isin([c for level, c in kept if level == i]), F.struct(
        F.lit(i).alias("level"), F.col(f"c{i}").alias("comp"))) for i in {level for level, _ in kept}])
    placed = held(rows.select(*CELL, "n", "len_sum", own.alias("_own")))
    sizes = placed.filter("_own IS NOT NULL").groupBy("_own").agg(
        F.sum("n").alias("n"), F.min(F.struct(*CELL)).alias("first"))
    order = sizes.orderBy(F.col("n").desc(), "first").select("_own.*").collect()  # no more than the branches
    labels = spark.createDataFrame([(r["level"], r["comp"], i) for i, r in enumerate(order, 1)],
                                   "level int, comp long, label int")
    return placed.join(F.broadcast(labels), (F.col("_own.level") == F.col("level")) & (F.col("_own.comp") == F.col("comp")),
                       "left").drop("_own", "level", "comp")


DIMS = (("template", TEMPLATE_WEIGHT), ("tool_sig", TOOLS_WEIGHT), ("out_type", TYPE_WEIGHT))


def _shares(rows: DataFrame) -> DataFrame:
    """``label``, ``dim``, ``value`` and ``part`` (the label's share of tasks with the value, by the square root of the
    dimension's weight) of cells with a label."""
    told = F.array(*[F.struct(F.lit(name).alias("dim"), _key(name).alias("value"), F.lit(weight**0.5).alias("w"))
                     for name, weight in DIMS])
    counts = (rows.select("label", "n", F.explode(told).alias("e")).groupBy("label", "e.dim", "e.value", "e.w")
              .agg(F.sum("n").alias("n")))
    total = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("n").alias("_total"))
    return counts.join(total, F.col("label") == F.col("_label")).select(
        "label", "dim", "value", (F.col("w") * F.col("n") / F.col("_total")).alias("part"))


def _centres(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``label``, ``n``, the centroid's plain features, and ``sq``, the squared length of its categories."""
    flag = lambda c: F.sum(F.col(c).cast("double") * F.col("n")) / F.sum("n")
    plain = rows.groupBy("label").agg(F.sum("n").alias("n"), flag("json_valid").alias("json"), flag("has_code").alias("code"),
                                      (F.sum("len_sum") / F.sum("n")).alias("len"))
    squares = shares.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("part") * F.col("part")).alias("sq"))
    return plain.join(squares, F.col("label") == F.col("_label")).drop("_label")


def _gaps(points: DataFrame, point_shares: DataFrame, centres: DataFrame, centre_shares: DataFrame) -> DataFrame:
    """``label`` of each point and ``gaps`` to all centres: ``gap``, squared, without the length, and their ``near``
    label and ``len``. Centres are at most ``KEPT`` or the branches kept, so they are gathered in one row."""
    listed = centres.agg(F.collect_list(F.struct("label", "json", "code", "len", "sq")).alias("_centres"))
    dots = (point_shares.join(centre_shares.select(F.col("label").alias("near"), F.col("dim").alias("_d"),
                                                   F.col("value").alias("_v"), F.col("part").alias("_p")),
                              (F.col("dim") == F.col("_d")) & (F.col("value") == F.col("_v")))
            .groupBy("label", "near").agg(F.sum(F.col("part") * F.col("_p")).alias("dot"))
            .groupBy(F.col("label").alias("_label")).agg(F.map_from_entries(F.collect_list(F.struct("near", "dot"))).alias("_dots")))
    rows = points.join(dots, F.col("label") == F.col("_label"), "left").withColumn("_one", F.lit(1)).join(
        F.broadcast(listed.withColumn("_one", F.lit(1))), "_one")

    def gap(c: Column) -> Column:
        dot = F.coalesce(F.try_element_at("_dots", c["label"]), F.lit(0.0))
        return F.struct(
            (F.col("sq") + c["sq"] - 2 * dot + F.pow(F.col("json") - c["json"], 2.0) + F.pow(F.col("code") - c["code"], 2.0))
            .alias("gap"), c["label"].alias("near"), c["len"].alias("len"))

    return rows.select("label", F.col("len").alias("own_len"), F.transform("_centres", gap).alias("gaps"))


def _nearest(gaps: str, length: Column) -> Column:
    """The label of the least gap, with the length counted; ties go to the smaller label."""
    return F.array_min(F.transform(gaps, lambda g: F.struct(
        F.round(g["gap"] + F.pow(length - g["len"], 2.0), 9).alias("d"), g["near"].alias("near"))))["near"]


def _by_template(features: DataFrame) -> DataFrame:
    """Every template is a label, numbered by falling size."""
    sizes = features.groupBy(F.col("template").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    numbered = ranked(sizes, {"_o1": -F.col("_n"), "_o2": F.coalesce(F.col("_t"), F.lit("")), "_o3": F.col("_t").isNotNull()},
                      "label").drop("_n")
    return features.join(numbered, F.col("template").eqNullSafe(F.col("_t")), "left").drop("_t")


def density_clusters(features: DataFrame, *, min_size: int | None = None) -> DataFrame:
    """Features with ``label``: the branch of the density hierarchy that holds the task's cell, by falling size from 1;
    tasks outside all branches take the nearest centroid of those inside.

    ``min_size`` is ``max(5, n / 100)`` unless given. With no more tasks than that, or without a branch, every template
    is a cluster of its own; ``merge_clusters`` joins them further. An empty table gives no row."""
    features = held(features)
    grouped = held(cells(features))
    total = grouped.agg(F.sum("n")).first()[0] or 0
    size = min_size or max(5, total // 100)
    found = _found(component_levels(core_levels(grouped, total, size)), size) if total > size else None
    if found is None:
        return _by_template(features)
    found = held(found)
    inside = found.filter("label IS NOT NULL")
    outside = found.filter("label IS NULL").withColumn("label", F.xxhash64(_key(*CELL)))
    shares, own = _shares(inside), _shares(outside)
    gaps = _gaps(_centres(outside, own), own, _centres(inside, shares), shares)
    rows = features.withColumn("_cell", F.xxhash64(_key(*CELL)))
    told = inside.select(F.xxhash64(_key(*CELL)).alias("_inside"), F.col("label").alias("_label"))
    near = gaps.select(F.col("label").alias("_outside"), "gaps")
    return (rows.join(told, F.col("_cell") == F.col("_inside"), "left").join(near, F.col("_cell") == F.col("_outside"), "left")
            .withColumn("label", F.coalesce("_label", _nearest("gaps", F.col("len"))))
            .drop("_cell", "_inside", "_label", "_outside", "gaps"))


def _grams(rows: DataFrame) -> dict[str, dict[tuple[int, int], float]]:
    """Per category: the sum over its values of n_a * n_b for every pair of labels sharing one, of cells with at
    most ``KEPT`` labels: three numbers for each pair of labels."""
    dims = F.array(*[F.struct(F.lit(name).alias("dim"), _key(name).alias("value")) for name, _ in DIMS])
    per_value = (
        rows.select("label", "n", F.explode(dims).alias("v"))
        .groupBy("v.dim", "v.value", "label").agg(F.sum("n").cast("double").alias("n"))
        .groupBy("dim", "value")
        .agg(F.collect_list(F.struct("label", "n")).alias("l"))
    )
    pairs = F.flatten(F.transform("l", lambda a: F.transform("l", lambda b: F.struct(
        a["label"].alias("a"), b["label"].alias("b"), (a["n"] * b["n"]).alias("dot")))))
    dots = (
        per_value.select("dim", F.explode(pairs).alias("p"))
        .groupBy("dim", "p.a", "p.b").agg(F.sum("p.dot").alias("dot"))
    )
    grams: dict[str, dict[tuple[int, int], float]] = {name: {} for name, _ in DIMS}
    for r in dots.collect():
        grams[r["dim"]][r["a"], r["b"]] = r["dot"]
    return grams


def merge_plan(sizes, blocks, sums, *, target: int) -> dict[int, int]:
    """Which label each label ends up in, merging the smallest into its nearest until ``target``.

    ``sizes`` is n per label; ``blocks`` a list of (weight, gram) with gram[a, b] = sum of count
    products; ``sums`` a list of per-label sums of plain features. All bounded by the labels kept."""
    alive = dict(sizes)
    grams = [(w, dict(g)) for w, g in blocks]
    plain = [dict(s) for s in sums]
    into = {label: label for label in sizes}

    def gap(a: int, b: int) -> float:
        na, nb = alive[a], alive[b]
        total = 0.0
        for weight, g in grams:
            aa, bb, ab = g.get((a, a), 0.0), g.get((b, b), 0.0), g.get((a, b), 0.0)
            total += weight * (aa / na**2 + bb / nb**2 - 2 * ab / (na * nb))
        for s in plain:
            total += (s[a] / na - s[b] / nb) ** 2
        return round(total, 9)

    while len(alive) > target:
        small = min(alive, key=lambda k: (alive[k], k))
        near = min((k for k in alive if k != small), key=lambda k: (gap(k, small), k))
        for _, g in grams:
            pair, own = g.get((near, small), 0.0), g.get((small, small), 0.0)
            g[near, near] = g.get((near, near), 0.0) + own + 2 * pair
            for other in alive:
                if other not in (near, small):
                    joint = g.get((near, other), 0.0) + g.get((small, other), 0.0)
                    g[near, other] = g[other, near] = joint
        for s in plain:
            s[near] += s[small]
        alive[near] += alive.pop(small)
        into = {k: near if v == small else v for k, v in into.items()}
    return into


def attach_small(rows: DataFrame, *, kept: int = KEPT) -> DataFrame:
    """``label`` of every label of some cells (``label``, ``CELL``, ``n``, ``len_sum``) and ``into``: itself for the
    ``kept`` largest, for the others the one of those with the nearest centroid. Centroids are sums by label and
    value; a label meets the largest ones at the values it shares with them."""
    sizes = rows.groupBy("label").agg(F.sum("n").alias("_n"))
    large = held(sizes.orderBy(F.col("_n").desc(), "label").limit(kept).select(F.col("label").alias("_large")))
    among = rows.join(F.broadcast(large), F.col("label") == F.col("_large"), "left")
    big, small = among.filter("_large IS NOT NULL"), among.filter("_large IS NULL")
    shares, own = _shares(big), _shares(small)
    gaps = _gaps(_centres(small, own), own, _centres(big, shares), shares)
    return large.select(F.col("_large").alias("label"), F.col("_large").alias("into")).unionByName(
        gaps.select("label", _nearest("gaps", F.col("own_len")).alias("into")))


def merge_clusters(
    labelled: DataFrame, *, target: int = TARGET, above: int = MERGE_ABOVE, kept: int = KEPT
) -> DataFrame:
    """Labelled tasks with labels merged down to ``target`` when there are more than ``above``.

    Labels beyond the ``kept`` largest first join the nearest of those, as a table; then the smallest label joins its
    nearest, one at a time, decided on the sums of at most ``kept`` labels. A task keeps its columns."""
    if target > kept:
        raise ValueError(f"target {target} is above the {kept} labels that are merged one by one")
    rows = held(labelled.groupBy("label", *CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len_sum")))
    labels = rows.select("label").distinct().count()
    if labels <= above:
        return labelled
    into = held(attach_small(rows, kept=kept))
    joined = rows.join(into.withColumnRenamed("label", "_from"), F.col("label") == F.col("_from")).withColumn("label", F.col("into"))
    per_label = joined.groupBy("label").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("json_valid").cast("double") * F.col("n")).alias("json"),
        F.sum(F.col("has_code").cast("double") * F.col("n")).alias("code"),
        F.sum("len_sum").alias("len"),
    ).collect()
    grams = _grams(joined)
    plan = merge_plan(
        {r["label"]: r["n"] for r in per_label},
        [(weight, grams[name]) for name, weight in DIMS],
        [{r["label"]: r[name] for r in per_label} for name in ("json", "code", "len")],
        target=target,
    )
    last = labelled.sparkSession.createDataFrame(list(plan.items()), "_kept long, _last long")
    mapping = into.join(F.broadcast(last), F.col("into") == F.col("_kept")).select(F.col("label").alias("_from"), "_last")
    return labelled.join(mapping, F.col("label") == F.col("_from")).withColumn(
        "label", F.col("_last").cast(labelled.schema["label"].dataType)).drop("_from", "_last")


def rank_clusters(assignments: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, assignments) with ids c01, c02, ... by falling cost; ties by label."""
    costed = assignments.select("tenant_id", "task_id", "label").join(
        tasks.select("tenant_id", "task_id", "total_cost_usd"), TASK
    )
    sums = costed.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.sum("total_cost_usd").alias("total_cost_usd")
    )
    # One row per cluster from here on.
    place = F.row_number().over(Window.orderBy(F.col("total_cost_usd").desc(), "label"))
    whole = F.sum("total_cost_usd").over(Window.partitionBy()).cast("double")
    ranked = sums.withColumn("_place", place).withColumn(
        "share_of_cost",
        F.coalesce(F.col("total_cost_usd").cast("double") / F.nullif(whole, F.lit(0.0)),
                   F.lit(0.0)),
    ).withColumn(
        "cluster_id", F.concat(F.lit("c"), F.lpad(F.col("_place").cast("string"),
                               F.greatest(F.lit(2), F.length(F.col("_place").cast("string"))), F.lit("0")))
    )
    clusters = ranked.select("cluster_id", "label", "n_tasks", "total_cost_usd", "share_of_cost")
    named = assignments.join(F.broadcast(ranked.select("label", "cluster_id")), "label")
    return clusters, named


def representatives(features: DataFrame, *, k: int = 5) -> DataFrame:
    """The ``k`` tasks nearest the centroid of their cluster (features carry ``cluster_id``).

    Tasks of one cell differ only in length, so the k nearest of each cell are found first and the
    cell distances, computed on counts, decide among those."""
    by_cell = features.groupBy("cluster_id", *CELL).agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("len_sum")
    )
    cluster = Window.partitionBy("cluster_id")
    total = F.sum("n").over(cluster)
    shares = by_cell.withColumn("_total", total)
    for name in ("template", "tool_sig", "out_type"):
        inside = Window.partitionBy("cluster_id", name)
        shares = shares.withColumn(f"_n_{name}", F.sum("n").over(inside))
        # Sum over the values of share squared = sum over cells of n * n_value / total^2.
        shares = shares.withColumn(
            f"_sq_{name}",
            F.sum(F.col("n") * F.col(f"_n_{name}")).over(cluster) / F.pow(F.col("_total"), 2.0),
        )
    for name in ("json_valid", "has_code"):
        shares = shares.withColumn(
            f"_p_{name}",
            F.sum(F.when(F.col(name), F.col("n")).otherwise(0)).over(cluster) / F.col("_total"),
        )
    base = F.lit(0.0)
    for name, weight in (
        ("template", TEMPLATE_WEIGHT), ("tool_sig", TOOLS_WEIGHT), ("out_type", TYPE_WEIGHT)
    ):
        share = F.col(f"_n_{name}") / F.col("_total")
        base = base + weight * (1 - 2 * share + F.col(f"_sq_{name}"))
    for name in ("json_valid", "has_code"):
        base = base + F.pow(F.col(name).cast("double") - F.col(f"_p_{name}"), 2.0)
    scored = shares.select("cluster_id", *CELL, base.alias("_base"))
    means = by_cell.groupBy("cluster_id").agg(
        (F.sum("len_sum") / F.sum("n")).alias("_mean")
    )
    # One row per cluster, and a taxonomy has at most 100.
    rows = features.join(F.broadcast(means), "cluster_id").withColumn(
        "_off", F.round(F.pow(F.col("len") - F.col("_mean"), 2.0), 9)
    )
    near = Window.partitionBy("cluster_id", *CELL).orderBy("_off", "tenant_id", "task_id")
    candidates = rows.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k)
    joined = candidates.join(scored, ["cluster_id", *CELL]).withColumn(
        "distance", F.round(F.col("_base") + F.col("_off"), 8)
    )
    best = Window.partitionBy("cluster_id").orderBy("distance", "tenant_id", "task_id")
    return (
        joined.withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= k)
        .select("cluster_id", "position", "tenant_id", "task_id", "distance")
    )


def sanitize_label(text: Column) -> Column:
    """A short human tag: lower case, at most six words and sixty characters, empty is NULL."""
    words = F.split(squeeze(F.lower(text)), " ")
    label = F.substring(F.array_join(F.slice(words, 1, 6), " "), 1, 60)
    return F.nullif(label, F.lit(""))


def extract_clusters(
    tasks: DataFrame, reps: DataFrame, *, target: int = TARGET, above: int = MERGE_ABOVE,
    min_size: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(clusters, assignments) of the whole taxonomy step; assignments keep the features."""
    labelled = density_clusters(task_features(reps), min_size=min_size)
    return rank_clusters(merge_clusters(labelled, target=target, above=above), tasks)
