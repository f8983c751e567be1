"""Chains to clusters to consumers: grouping by path, behaviour signals, caps and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import class_and_method, test_class, token_estimate
from .ranking import first_per_key


def clusters(chains: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Chains of two or more steps grouped by their sequence of callees: (signature, n, entry, consumer, depth, tests,
    first_chain). `names` (node, fqn) turns nodes into names. Members are rows of their own, see members()."""
    rows = _signed(chains, names)
    out = rows.groupBy("signature").agg(F.count("*").alias("n"), F.count_distinct("test").alias("tests"), F.min("chain_id").alias("first_chain"))
    return out.select("signature", "n", F.col("signature")[0].alias("entry"), F.element_at("signature", -2).alias("consumer"),
        F.size("signature").alias("depth"), "tests", "first_chain")


def members(chains: DataFrame, found: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(first_chain, chain_id, test): the chains of each cluster, under its first one."""
    return _signed(chains, names).select("signature", "chain_id", "test").join(found.select("signature", "first_chain"),
        "signature").select("first_chain", "chain_id", "test")


def _signed(chains: DataFrame, names: DataFrame | None) -> DataFrame:
    """Chains of two or more steps with their signature."""
    rows = chains.where("depth >= 2")
    sequence = F.transform("steps", lambda s: s["callee"])
    if names is not None:
        flat = rows.select("chain_id", F.posexplode("steps").alias("i", "s")).join(names.select(F.col("node").alias("callee"),
            "fqn"), F.col("s.callee") == F.col("callee"), "left")
        flat = flat.groupBy("chain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i",
            F.coalesce("fqn", F.col("s.callee").cast("string")).alias("f")))), lambda x: x["f"]).alias("signature"))
        return rows.join(flat, "chain_id")
    return rows.withColumn("signature", sequence)


def capped(found: DataFrame, cap: int = 10, coverage: int = 90, order: str = "first_chain") -> DataFrame:
    """Adds `selected`: clusters of two or more, largest first, until they cover a share of all chains or reach the cap; with
    the `rank` of those that the cap lets in. Only these are numbered in one place."""
    by = Window.orderBy(F.desc("n"), order)
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    enough = -(-total * coverage // 100)
    first = found.where("n > 1").orderBy(F.desc("n"), order).limit(cap)
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select(order, F.row_number().over(by).alias("rank"), (before < enough).alias("selected"))
    return found.join(F.broadcast(first), order, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))  # `cap` rows


def consumers(found: DataFrame) -> DataFrame:
    """(consumer, clusters, chains), most chains first."""
    return found.groupBy("consumer").agg(F.count("*").alias("clusters"), F.sum("n").alias("chains")).orderBy(F.desc("chains"), "consumer")


def aggregate_arguments(slices: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """For each argument of a cluster: the one result of its members, the union of a few, or an explosion."""
    out = slices.groupBy(*keys, "arg_index").agg(F.array_sort(F.collect_set(F.struct("kind", "value"))).alias("results"))
    n = F.size("results")
    return out.select(*keys, "arg_index", F.when(n == 1, F.col("results")[0]["kind"]).when(n > most,
        "UNRESOLVED").otherwise("BRANCH_UNION").alias("kind"), F.when(n == 1, F.col("results")[0]["value"]).when(n > most,
        F.concat(n.cast("string"), F.lit(" distinct member resolutions"))).otherwise(F.array_join(F.transform("results",
        lambda r: F.coalesce(r["value"], F.lit("null"))), " | ")).alias("value"), n.alias("distinct_results"))


def oracle_text(kind="oracle_kind", message="message", expected="expected", type_="type") -> Column:
    """The text of an oracle that an argument may show up in."""
    return F.when(F.col(kind) == "EXCEPTION_MESSAGE", F.col(message)).when(F.col(kind).isin("EQUALS", "CONTAINS"),
        F.col(expected)).when(F.col(kind) == "EXCEPTION", F.col(type_))


def signals(members: DataFrame, slices: DataFrame | None = None) -> DataFrame:
    """(cluster, signal) from members (cluster, member, args array<string>, oracle_kind, expected, message, type): which
    arguments never vary, which show up in the oracle, whether the oracle varies, and with which one argument. `slices`
    (cluster, arg_index, name, kind) adds what static resolution says; an argument that it covers gives no invariant."""
    rows = members.withColumn("text", oracle_text())
    group = rows.groupBy("cluster").agg(F.count("*").alias("members"), F.max(F.size("args")).alias("width"),
        F.count_distinct(F.coalesce("text", F.lit("\0"))).alias("texts"), F.count_distinct("type").alias("types"),
        F.count(F.when(F.col("oracle_kind").isin("EXCEPTION", "EXCEPTION_MESSAGE") & F.col("type").isNotNull(),
        1)).alias("throwing"))
    flat = rows.select("cluster", "member", "text", F.posexplode("args").alias("arg_index", "arg"))
    bare = F.regexp_replace("arg", '^"(.*)"$', "$1")
    hit = F.coalesce((F.length(bare) >= 3) & F.contains("text", bare), F.lit(False))
    each = flat.groupBy("cluster", "arg_index").agg(F.count("*").alias("seen"), F.count_distinct("arg").alias("values"),
        F.count(F.when(hit, 1)).alias("hits"), F.count_distinct(F.when(hit, bare)).alias("hit_values")).join(group, "cluster")
    each = each.withColumn("invariant", (F.col("seen") == F.col("members")) & (F.col("values") == 1))
    covered = F.lit(False)
    out = None
    if slices is not None:
        solved = F.col("kind").isin("RESOLVED", "LOOP_VAR", "BRANCH_UNION")
        each = each.join(slices.where(F.col("kind").isin("RESOLVED", "LOOP_VAR", "BRANCH_UNION", "UNRESOLVED")).select("cluster",
            "arg_index", F.lit(True).alias("by_slice")), ["cluster", "arg_index"], "left")
        covered = F.coalesce("by_slice", F.lit(False))
        suffix = F.create_map(*map(F.lit, ["RESOLVED", "_resolves_to_literal", "UNRESOLVED", "_requires_dynamic_value", "LOOP_VAR",
            "_is_loop_var", "BRANCH_UNION", "_resolves_to_branch_union"]))
        out = slices.where(suffix[F.col("kind")].isNotNull()).select("cluster", F.concat("name", suffix[F.col("kind")]).alias("signal"))
        part = slices.groupBy("cluster").agg(F.count("*").alias("total"), F.count(F.when(solved, 1)).alias("solved")).where("solved > 0 and solved < total")
        out = out.union(part.select("cluster", F.lit("cluster_partial_resolution").alias("signal")))
    several = each.where("members >= 2")
    tag = lambda df, text: df.select("cluster", text.alias("signal"))
    arg = F.concat(F.lit("arg"), F.col("arg_index").cast("string"))
    found = tag(several.where(F.col("invariant") & ~covered), F.concat(arg, F.lit("_invariant_in_cluster")))
    found = found.union(tag(several.where("not invariant and hits >= 2 and hit_values >= 2"), F.concat(arg, F.lit("_propagates_to_oracle"))))
    # An argument that some member lacks varies.
    varying = each.groupBy("cluster").agg(F.count(F.when(~F.col("invariant"), 1)).alias("varying"), F.max(F.when(~F.col("invariant"), F.col("arg_index"))).alias("which"))
    whole = group.where("members >= 2").join(varying, "cluster", "left").fillna({"varying": 0})
    found = found.union(tag(whole.where("throwing = members and types = 1"), F.lit("exception_type_consistent_across_cluster")))
    found = found.union(tag(whole.where("texts = 1 and varying > 0"), F.lit("oracle_independent_of_target_args")))
    found = found.union(tag(whole.where("texts > 1 and varying = 1"), F.concat(F.lit("oracle_varies_only_with_arg"), F.col("which").cast("string"))))
    return (found if out is None else out.union(found)).distinct()


def behavioural_tests(snippets: DataFrame, target_class: str, most: int = 6) -> DataFrame:
    """The shortest snippets (test, snippet) of distinct tests of the class named after the target's that assert about it."""
    simple_name = target_class.rpartition(".")[2]
    fits = F.element_at(F.split(test_class("test"), r"[.$]"), -1).startswith(simple_name) & F.contains(F.lower("snippet"),
        F.lit("assert")) & F.contains("snippet", F.lit(simple_name))
    once = first_per_key(snippets.where(fits), ["test"], [F.length("snippet"), "snippet"])
    return once.orderBy(F.length("snippet"), "test").limit(most)


def hub_order(found: DataFrame, scores: DataFrame, top: int = 2) -> DataFrame:
    """Adds each cluster's greatest score over its signature and its `top` hubs; scores of 0 or less don't count."""
    flat = found.select("first_chain", F.explode("signature").alias("fqn")).distinct().join(scores.where("score > 0"), "fqn")
    best = flat.groupBy("first_chain").agg(F.max("score").alias("hub_score"))
    hubs = first_per_key(flat, ["first_chain"], [F.desc("score"), "fqn"],
        top).groupBy("first_chain").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "fqn"))),
        lambda x: x["fqn"]).alias("hubs"))
    return found.join(best, "first_chain", "left").join(hubs, "first_chain", "left").orderBy(F.desc_nulls_last("hub_score"), F.desc("n"), "first_chain")


#: What gives way first when a document is over budget; the minimum is what all of them leave.
EVICTIONS = ["long_tail", "snippets", "behavioural", "siblings", "members", "signals", "hubs", "used_types"]


def fit_budget(parts: DataFrame, budget: int, evictions: list[str] | None = None) -> DataFrame:
    """The first tier of each document (doc, part, text) that fits a token budget: (doc, tier, tokens, dropped). Tier k
    leaves out the first k parts of the eviction order. All tiers' sizes come from one pass; a document whose smallest
    tier doesn't fit has a null tier."""
    order = evictions or EVICTIONS
    sizes = parts.groupBy("doc", "part").agg(F.sum(token_estimate("text")).cast("long").alias("tokens"))
    wide = sizes.groupBy("doc").agg(F.sum("tokens").alias("all"),
        *[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("tokens"))), F.lit(0)).alias(p) for p in order])
    total, tiers = F.col("all"), []
    for k in range(len(order) + 1):
        tiers.append(F.struct(F.lit(k).alias("tier"), total.cast("long").alias("tokens")))
        if k < len(order):
            total = total - F.col(order[k])
    first = F.filter(F.array(*tiers), lambda t: t["tokens"] <= budget)
    return wide.select("doc", F.get(first, F.lit(0)).alias("x")).select("doc", "x.tier", "x.tokens",
        F.slice(F.lit(order), 1, F.coalesce("x.tier", F.lit(len(order)))).alias("dropped"))


def statistics(chains: DataFrame) -> DataFrame:
    """(chains, tests, methods, max_depth) of a set of chains."""
    flat = chains.select("chain_id", "test", "depth", F.explode("steps").alias("s"))
    return flat.agg(F.count_distinct("chain_id").alias("chains"), F.count_distinct("test").alias("tests"),
        F.count_distinct("s.callee").alias("methods"), F.max("depth").alias("max_depth"))


def nearest_edges(chains: DataFrame, most: int = 16) -> DataFrame:
    """(caller, callee, dist) of all steps, each edge at its least distance to the target, nearest first; with how many more
    there are."""
    flat = chains.select("depth", F.posexplode("steps").alias("i", "s")).select("s.caller", "s.callee", (F.col("depth") - F.col("i")).alias("dist"))
    edges = flat.groupBy("caller", "callee").agg(F.min("dist").alias("dist"))
    more = max(0, edges.count() - most)
    by = Window.orderBy("dist", "caller", "callee")
    return edges.orderBy("dist", "caller", "callee").limit(most).withColumns({"rank": F.row_number().over(by), "more": F.lit(more).cast("long")})


def test_command_classes(tests: DataFrame) -> DataFrame:
    """Distinct classes of tests, in order."""
    return tests.select(test_class("test").alias("cls")).where("cls != ''").distinct().orderBy("cls")


def display(column: str) -> Column:
    """Class and method for people."""
    return class_and_method(column)


def implied_requirements(usages: DataFrame, catches: DataFrame) -> DataFrame:
    """(consumer, requirement) that callers' usages (consumer, kind, field) and handlers (consumer, type) put on the target."""
    per = usages.groupBy("consumer").agg(F.collect_set("kind").alias("kinds"), F.array_sort(F.collect_set("field")).alias("fields"))
    handled = catches.groupBy("consumer").agg(F.array_sort(F.collect_set("type")).alias("types"))
    rows = per.join(handled, "consumer", "left")
    has = lambda *k: F.arrays_overlap("kinds", F.lit(list(k)))
    fields = F.array_join("fields", ", ")
    texts = F.array(
        F.when(has("FIELD_READ", "METHOD_CALL_ON_RESULT"), F.concat(F.lit("result is never null: "), F.when(F.size("fields") > 0, fields).otherwise("it is dereferenced"))),
        F.when(F.size("fields") > 0, F.concat(F.lit("fields of the result are observed: "), fields)),
        F.when(has("USED_IN_CONDITION", "USED_IN_LOOP"), F.lit("result steers the caller's control flow")),
        F.when(has("RETURNED_UNCHANGED"), F.lit("result is the caller's result")),
        F.when(has("PASSED_AS_ARG"), F.lit("result goes on to another method")),
        F.when(has("DISCARDED") & (F.size("kinds") == 1), F.lit("only side effects are observed")),
        F.when(F.size("types") > 0, F.concat(F.lit("exceptions are caught: "), F.array_join("types", ", "))).otherwise(F.lit("exceptions reach the caller")),
    )
    return rows.select("consumer", F.explode(F.array_compact(texts)).alias("requirement"))
