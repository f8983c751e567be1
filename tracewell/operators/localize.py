"""From red runs to suspects: seeds and corridors of crashes, boundaries of assertions, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import canonical_test
from ..functions.predicates import assertion_like
from . import dyadic
from .ranking import by_priority, distinct_first, first_per_key


def ochiai(ef: Column, ep: Column, failing: Column) -> Column:
    """Of a method that ef failing and ep passing tests run."""
    return F.when(ef + ep > 0, ef / F.sqrt(failing * (ef + ep)))


def counts(coverage: DataFrame, failing: DataFrame, passing: DataFrame) -> DataFrame:
    """(method, ef, ep) over canonical tests; one pass with both sets joined to the distinct matrix."""
    cov = coverage.select("method", canonical_test("test").alias("test")).distinct()
    red = failing.select(canonical_test("test").alias("test")).distinct().withColumn("_f", F.lit(1))
    green = passing.select(canonical_test("test").alias("test")).distinct().withColumn("_p", F.lit(1))
    return cov.join(red, "test", "left").join(green, "test", "left").groupBy("method").agg(F.count("_f").alias("ef"), F.count("_p").alias("ep"))


def suspects(coverage: DataFrame, failing: DataFrame, passing: DataFrame, reachable: DataFrame | None = None, most: int = 3,
    least_passing: int = 5, gap: float = 0.05) -> DataFrame:
    """(method, score, ef, reachable, rank, mode, flat): methods that failing tests run, reachable ones first, then by
    score. With fewer than least_passing passing tests the score is ef alone."""
    n_failing = failing.select(canonical_test("test").alias("t")).distinct().count()
    contrast = passing.select(canonical_test("test").alias("t")).distinct().limit(least_passing).count() >= least_passing
    rows = counts(coverage, failing, passing).where("ef > 0")
    score = ochiai(F.col("ef"), F.col("ep"), F.lit(float(n_failing))) if contrast else F.col("ef").cast("double")
    rows = rows.select("method", score.alias("score"), "ef")
    if reachable is None:
        rows = rows.withColumn("reachable", F.lit(True))
    else:
        rows = rows.join(reachable.select("method").distinct().withColumn("_r", F.lit(True)), "method",
            "left").withColumn("reachable", F.coalesce("_r", F.lit(False))).drop("_r")
    # Sorting and cutting come before numbering, so the window sees `most` + 1 rows.
    top = rows.orderBy(F.desc("reachable"), F.desc("score"), "method").limit(max(most, 2))
    by = Window.orderBy(F.desc("reachable"), F.desc("score"), "method")
    first_two = F.abs(F.max(F.when(F.col("rank") == 1,
        F.col("score"))).over(Window.partitionBy()) - F.max(F.when(F.col("rank") == 2,
        F.col("score"))).over(Window.partitionBy())) < gap
    return top.withColumn("rank", F.row_number().over(by)).withColumns({"mode": F.lit("CONTRAST" if contrast else "FREQUENCY"),
        "flat": F.coalesce(first_two, F.lit(False))}).where(F.col("rank") <= most)


def boundary_suspects(boundary: DataFrame, calls: DataFrame, production: DataFrame, most: int = 3) -> DataFrame:
    """(method, score, direct, rank) without a matrix: boundary methods (test, method) by their number of tests, then their
    direct callees among production methods, each with its caller's score."""
    own = boundary.groupBy("method").agg(F.count_distinct("test").cast("double").alias("score")).withColumns({"direct": F.lit(True),
        "via": F.lit(None).cast("string")})
    by = Window.orderBy(F.desc("score"), "method")
    # Beyond the first `most` boundary methods none is shown, and where they are fewer all callees' callers are among them.
    ranked = own.orderBy(F.desc("score"), "method").limit(most).withColumn("place", F.row_number().over(by))
    callee = calls.select("caller", F.col("callee").alias("method")).distinct().join(production.select("method").distinct(),
        "method", "left_semi").join(own.select("method"), "method", "left_anti")
    callee = callee.join(ranked.select(F.col("method").alias("caller"), "score", "place"), "caller")
    callee = first_per_key(callee, ["method"], ["place", "caller"]).select("method", "score", F.lit(False).alias("direct"),
        F.col("caller").alias("via"), "place")
    both = ranked.select("method", "score", "direct", "via", "place").unionByName(callee)
    order = [F.desc("direct"), "place", "method"]
    return both.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("place")


def aggregate_boundary(boundary: DataFrame) -> DataFrame:
    """(method, tests, label) from (test, method, label): supporting tests; actual-side wins over prior-call."""
    return boundary.groupBy("method").agg(F.count_distinct("test").alias("tests"),
        F.when(F.max((F.col("label") == "actual-side").cast("int")) == 1, "actual-side").otherwise("prior-call").alias("label"))


def resolve_methods(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Frames with the overload (id) whose range holds their line, else the first; one without a start stands last. Overloads are
    picked for each name and line, of which there are few, and not for each frame."""
    last = F.col("line_start").isNull().alias("_last")
    known = spans.select("fqn", "line_start", "line_end", F.struct(last, "line_start", F.col("id").alias("method_id"), "line_end", F.col("file").alias("path")).alias("_x"))
    named = frames.withColumn("fqn", F.concat_ws(".", "cls", "method"))
    held = dyadic.least_of(named, known, "line", "line_start", "line_end", ["fqn"], "_x").withColumnRenamed("_x", "_held")
    first = known.groupBy("fqn").agg(F.min("_x").alias("_x"))
    met = named.join(held, ["fqn", "line"], "left").join(first, "fqn").withColumns({"_out": F.col("_held").isNull(), "_x": F.coalesce("_held", "_x")})
    met = met.select(*frames.columns, "fqn", "_x.method_id", "_x.line_start", "_x.line_end", "_x.path", "_out", "_x._last")
    return first_per_key(met, ["trace_id", "cause_ix", "frame_ix"], ["_out", "_last", "line_start", "method_id"]).drop("_out", "_last")


def statements_at(frames: DataFrame, statements: DataFrame) -> DataFrame:
    """Statements (method_id, line, id, label, name, code, ord) on the line of each resolved frame."""
    return frames.join(statements, ["method_id", "line"])


def crash_seeds(at: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` seed statements a frame: exact calls of the deeper frame's method, else calls of that simple name, else
    statements that throw or name the exception (deepest frame only), else any. Rows carry deeper_cls, deeper_method, and
    exc (the exception's simple name, null but for the deepest frame)."""
    call = F.col("label") == "CALL"
    priority = (
        F.when(call & (F.col("name") == F.concat_ws(".", "deeper_cls", "deeper_method")) & F.col("deeper_method").isNotNull(), 0)
        .when(call & F.coalesce(F.col("name").endswith(F.concat(F.lit("."), F.col("deeper_method"))), F.lit(False)), 1)
        .when(F.coalesce(F.col("exc").isNotNull() & (F.ltrim("code").startswith("throw") | F.contains("code", F.col("exc"))), F.lit(False)), 2)
        .otherwise(3)
    )
    return by_priority(at, ["trace_id", "frame_ix"], priority, ["ord"], most)


def walk(reverse: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(key, node, depth) within `depth` steps back from seeds (key, node) along (node, back); seeds themselves left out."""
    arcs = reverse.select(F.col("node").alias("_n"), F.col("back")).distinct()
    level, out = seeds.select("key", "node").distinct(), None
    for d in range(1, depth + 1):
        level = level.join(arcs, level["node"] == arcs["_n"]).select("key",
            F.col("back").alias("node")).distinct().join(seeds.select("key", "node").distinct(), ["key", "node"], "left_anti")
        own = level.withColumn("depth", F.lit(d))
        out = own if out is None else out.union(own)
    return out.groupBy("key", "node").agg(F.min("depth").alias("depth"))


def distinct_codes(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first few distinct texts "L<line>: <code>" of each key."""
    return distinct_first(rows.withColumn("entry", F.concat(F.lit("L"), F.col("line").cast("string"), F.lit(": "), "code")), ["key"], "entry", order, most)


def production_targets(calls: DataFrame, package: str, methods: DataFrame) -> DataFrame:
    """Calls under a package to a name that some method outside test code has."""
    production = methods.where("not is_test_code").select(F.col("fqn").alias("name")).distinct()
    return calls.where(F.col("name").startswith(package)).join(production, "name", "left_semi")


def boundary(failing: DataFrame, statements: DataFrame, data_flow: DataFrame, targets: DataFrame) -> DataFrame:
    """(test, method, label, code, line) of failing assertions (test, method_id, line): production calls in the data corridor
    of the assertion are actual-side, those on or above its line in the same method prior-call; none below it ran. Of a
    method's several calls the first label counts."""
    at = failing.join(statements, ["method_id", "line"])
    asserts = at.where((F.col("label") == "CALL") & assertion_like("name"))
    some = at.join(asserts.select("test").distinct(), "test", "left_anti").unionByName(asserts)
    seeds = first_per_key(some, ["test"], ["ord"], 3).select(F.col("test").alias("key"), F.col("id").alias("node"))
    near = walk(data_flow, seeds).select(F.col("key").alias("test"), F.col("node").alias("id"))
    own = statements.join(targets.select("id"), "id", "left_semi")
    inside = failing.select("test", "method_id", F.col("line").alias("fail_line"))
    actual = near.join(own, "id").join(inside, ["test", "method_id"]).select("test", F.col("name").alias("method"),
        F.lit("actual-side").alias("label"), "code", "line", F.lit(0).alias("p"), "ord")
    prior = inside.join(own, "method_id").where("line >= 0 and line <= fail_line").select("test", F.col("name").alias("method"),
        F.lit("prior-call").alias("label"), "code", "line", F.lit(1).alias("p"), "ord")
    return first_per_key(actual.unionByName(prior), ["test", "method"], ["p", F.desc("line"), "ord"]).drop("p", "ord")


def value_shaping(statements: DataFrame, related: DataFrame, guards: DataFrame, most: int = 15) -> DataFrame:
    """(method_id, id, line, code, role): returns and calls of related methods, or failing those the first three statements;
    and what guards them one step back."""
    rows = statements.join(related.select(F.col("method").alias("name"), F.lit(True).alias("_rel")).distinct(), "name", "left")
    strong = (F.col("label") == "RETURN") | F.ltrim("code").startswith("return") | ((F.col("label") == "CALL") & F.coalesce("_rel", F.lit(False)))
    by = Window.partitionBy("method_id")
    rows = rows.withColumns({"strong": strong, "any": F.max(strong.cast("int")).over(by)})
    picked = first_per_key(rows.where(F.col("strong") | (F.col("any") == 0)), ["method_id"], ["ord"], 3).select("method_id", "id",
        "line", "code", F.lit("value").alias("role"))
    back = walk(guards, picked.select(F.col("method_id").alias("key"), F.col("id").alias("node")),
        1).select(F.col("key").alias("method_id"), F.col("node").alias("id"))
    guarding = first_per_key(back.join(statements.drop("method_id"), "id"), ["method_id"], ["ord"], 2).select("method_id", "id",
        "line", "code", F.lit("guard").alias("role"))
    return first_per_key(picked.union(guarding), ["method_id"], ["role", "line", "id"], most)


def failures_by_class(failures: DataFrame) -> DataFrame:
    """(cls, n) of failing tests."""
    from ..functions.names import test_class

    return failures.groupBy(test_class("test").alias("cls")).agg(F.count("*").alias("n"))


def kinds_of_red(cases: DataFrame, roots: DataFrame, test_names: DataFrame, package: str) -> DataFrame:
    """(test, kind): assertion if the deepest cause's first project frame is test code, exception if it is production code,
    n-a without one."""
    first = first_per_key(roots.where(F.col("cls").startswith(package)), ["trace_id"],
        ["frame_ix"]).select(F.col("trace_id").alias("test"), F.concat_ws(".", "cls", "method").alias("fqn"))
    known = first.join(test_names.select("fqn", F.lit(True).alias("_t")).distinct(), "fqn", "left").select("test",
        F.when(F.col("_t"), "assertion").otherwise("exception").alias("kind"))
    return cases.where("not ok").select("test").join(known, "test", "left").select("test", F.coalesce("kind", F.lit("n-a")).alias("kind"))
