"""Near-duplicate workflows by the Jaccard similarity of their step bags, exactly.

A bag token is a step fingerprint plus its occurrence number.  Workflows with the
very same bag form one *shape*; shapes, not workflows, are compared, so a crowd
of copies costs one row.  Copies are reported against the first workflow of their
shape, which keeps the output linear; the pairs within a shape follow from it.

Shapes are never compared all with all.  Two similar bags share their
intersection, so each small bag is keyed by its large sub-bags together with how
many tokens it has beyond them; equal keys then meet only true matches.  Bags too
large for that meet on their rarest tokens (prefix filter) and are verified.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

MIN_STEPS = 3
MAX_DROP = 3  # tokens dropped when sub-bags are listed


def _small(t: float) -> int:
    """Largest bag whose partners are all reached by dropping at most ``MAX_DROP`` tokens."""
    return 10_000 if t >= 1 else math.ceil((MAX_DROP + 1) / (1 - t) - 1e-9) - 1


def step_bags(plan_steps: DataFrame) -> DataFrame:
    """One row per workflow: sorted tokens, and the parameters behind each token.

    A plan is one document, so collecting its steps is bounded.
    """
    keys = F.array_join(F.array_sort(F.map_keys("with")), ",")
    fp = F.when(F.col("capability").isNotNull(), F.concat_ws("|", "capability", F.coalesce(keys, F.lit("")))).otherwise(F.col("type"))
    steps = plan_steps.where("type <> 'terminate'").select("tenant_id", "workflow_name", F.struct(fp.alias("fp"), F.col("order"), F.col("with")).alias("s"))
    g = steps.groupBy("tenant_id", "workflow_name").agg(F.array_sort(F.collect_list(F.struct("s.fp", "s.order"))).alias("fps"),
                                                       F.collect_list("s").alias("raw"))
    token = "concat(e.fp, '#', cast(i - array_position(transform(fps, x -> x.fp), e.fp) + 1 as string))"
    g = g.withColumn("named", F.expr(f"transform(fps, (e, i) -> named_struct('order', e.order, 'fp', e.fp, 'token', {token}))"))
    params = (
        "map_from_entries(transform(filter(named, n -> n.order is not null), n -> named_struct('key', n.token, 'value', "
        "element_at(filter(raw, r -> r.order = n.order AND r.fp = n.fp), 1).with)))"
    )
    return g.select("tenant_id", "workflow_name", F.expr("transform(named, n -> n.token)").alias("tokens"), F.expr(params).alias("params"))


def shapes_of(bags: DataFrame) -> DataFrame:
    b = bags.where(F.size("tokens") >= MIN_STEPS).withColumn("shape", F.sha2(F.array_join("tokens", "\u0001"), 256))
    return b.groupBy("tenant_id", "shape").agg(
        F.min("workflow_name").alias("anchor"), F.count("*").alias("members"), F.first("tokens").alias("tokens"), F.size(F.first("tokens")).alias("n")
    )


def _sub_bags(max_drop: int) -> str:
    """SQL for the arrays left after dropping up to ``max_drop`` (at most 3) positions."""
    n = "size(tokens) - 1"
    parts = ["array(tokens)"]
    if max_drop >= 1:
        parts.append(f"transform(sequence(0, {n}), a -> filter(tokens, (t, i) -> i <> a))")
    if max_drop >= 2:
        parts.append(f"flatten(transform(sequence(0, {n}), a -> transform(filter(sequence(0, {n}), b -> b > a), b -> filter(tokens, (t, i) -> i <> a AND i <> b))))")
    if max_drop >= 3:
        parts.append(
            f"flatten(transform(sequence(0, {n}), a -> flatten(transform(filter(sequence(0, {n}), b -> b > a), b -> "
            f"transform(filter(sequence(0, {n}), c -> c > b), c -> filter(tokens, (t, i) -> i <> a AND i <> b AND i <> c))))))"
        )
    return f"concat({', '.join(parts)})"


def _pairs_by_sub_bag(shapes: DataFrame, t: float) -> DataFrame:
    small = shapes.where(F.col("n") <= _small(t))
    drop = F.floor(F.col("n") * (1 - t) + 1e-9).cast("int")
    rows = None
    for d in range(0, 4):
        mine = small.where(drop == d) if d < 3 else small.where(drop >= 3)
        part = mine.select("tenant_id", "shape", "n", F.explode(F.expr(_sub_bags(d))).alias("sub"))
        rows = part if rows is None else rows.unionByName(part)
    subs = rows.select("tenant_id", "shape", F.xxhash64(F.array_join("sub", "\u0001")).alias("k"), F.size("sub").alias("s"), (F.col("n") - F.size("sub")).alias("extra"))
    slack = F.floor(F.col("s") * (1 - t) / t + 1e-9).cast("int")  # tokens both sides may have beyond the common part
    left = subs.where(F.col("extra") <= slack).select(
        "tenant_id", "k", "s", F.col("shape").alias("x"), F.explode(F.sequence(F.lit(0), slack - F.col("extra"))).alias("extra"))
    right = subs.select("tenant_id", "k", "s", F.col("shape").alias("y"), "extra")
    return left.join(right, ["tenant_id", "k", "s", "extra"]).where("x < y").select("tenant_id", "x", "y")


def _pairs_by_rare_token(shapes: DataFrame, t: float) -> DataFrame:
    large = shapes.where(F.col("n") >= int((_small(t) + 1) * t))
    tok = large.select("tenant_id", "shape", "n", F.explode("tokens").alias("token"))
    freq = tok.groupBy("tenant_id", "token").agg(F.count("*").alias("df"))
    ordered = tok.join(freq, ["tenant_id", "token"]).groupBy("tenant_id", "shape", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ts"))
    prefix = F.col("n") - F.ceil(F.col("n") * t - 1e-9).cast("int") + 1
    pre = ordered.select("tenant_id", "shape", "n", F.explode(F.slice("ts", F.lit(1), prefix)).alias("p")).select("tenant_id", "shape", "n", F.col("p.token").alias("token"))
    a = pre.select("tenant_id", "token", F.col("shape").alias("x"), F.col("n").alias("nx"))
    b = pre.select("tenant_id", "token", F.col("shape").alias("y"), F.col("n").alias("ny"))
    near = (F.least("nx", "ny") >= F.greatest("nx", "ny") * t - 1e-9) & (F.greatest("nx", "ny") > _small(t))
    return a.join(b, ["tenant_id", "token"]).where(F.col("x") < F.col("y")).where(near).select("tenant_id", "x", "y")


def similar_shapes(shapes: DataFrame, t: float) -> DataFrame:
    """Pairs of different shapes at or above the similarity, verified on their tokens."""
    pairs = _pairs_by_sub_bag(shapes, t).unionByName(_pairs_by_rare_token(shapes, t)).distinct()
    side = lambda p, k: shapes.select("tenant_id", F.col("shape").alias(k), F.col("anchor").alias(f"a{p}"), F.col("members").alias(f"m{p}"), F.col("tokens").alias(f"t{p}"))
    j = pairs.join(side("x", "x"), ["tenant_id", "x"]).join(side("y", "y"), ["tenant_id", "y"])
    j = j.withColumn("shared", F.size(F.array_intersect("tx", "ty"))).withColumn("union", F.size("tx") + F.size("ty") - F.col("shared"))
    return j.withColumn("similarity", F.col("shared") / F.col("union")).where(F.col("similarity") >= t)


def near_duplicates(plan_steps: DataFrame, t: float = 0.8) -> DataFrame:
    """Duplicate findings: tenant_id, a, b (a < b), similarity, shared, union, parameters, copies.

    ``copies`` counts the workflows that share the shape of either side.
    """
    bags = cut_lineage(step_bags(plan_steps), "bags")  # read six times below
    shapes = cut_lineage(shapes_of(bags), "shapes")
    cross = similar_shapes(shapes, t).select(
        "tenant_id", F.least("ax", "ay").alias("a"), F.greatest("ax", "ay").alias("b"), "similarity", "shared", "union",
        (F.col("mx") + F.col("my")).alias("copies"),
    )
    sized = bags.where(F.size("tokens") >= MIN_STEPS).withColumn("shape", F.sha2(F.array_join("tokens", "\u0001"), 256))
    crowd = shapes.where("members > 1").select("tenant_id", "shape", "anchor", "members")
    same = sized.join(crowd, ["tenant_id", "shape"]).where(F.col("workflow_name") != F.col("anchor")).select(
        "tenant_id", F.col("anchor").alias("a"), F.col("workflow_name").alias("b"), F.lit(1.0).alias("similarity"),
        F.size("tokens").alias("shared"), F.size("tokens").alias("union"), F.col("members").alias("copies"),
    )
    pairs = cross.unionByName(same)
    one = lambda k, p: bags.select("tenant_id", F.col("workflow_name").alias(k), F.col("params").alias(p))
    j = pairs.join(one("a", "pa"), ["tenant_id", "a"]).join(one("b", "pb"), ["tenant_id", "b"])
    params = (
        "array_sort(array_distinct(flatten(transform(array_intersect(map_keys(pa), map_keys(pb)), k -> "
        "transform(filter(coalesce(map_keys(pa[k]), array()), p -> NOT (pa[k][p] <=> pb[k][p])), "
        "p -> concat(split(k, '[|#]')[0], '.', p))))))"
    )
    return j.select("tenant_id", "a", "b", "similarity", "shared", "union", F.expr(params).alias("parameters"), "copies")
