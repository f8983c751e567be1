"""What is known about a target, for whoever writes tests of it: representative chains, the edges next to it, who calls and
consumes it, which tests constrain it, and a bundle of capped sections with counts of what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import numbered

from ..functions.names import class_and_method, token_estimate
from . import knowledge
from .ranking import first_per_key


def off_path(fqn) -> Column:
    """Hops through examples, samples and anonymous classes, which an overview leaves out."""
    return F.col(fqn).rlike(r"\.(examples|samples)\.|\$[0-9]") if isinstance(fqn, str) else fqn.rlike(r"\.(examples|samples)\.|\$[0-9]")


def representatives(chains: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (entry, test) the first chain of that test, one that starts at the entry before others."""
    rows = wanted.select("entry", "test").distinct().join(chains, "test")
    other = (F.get("steps", F.lit(0))["callee"] != F.col("entry")).cast("int")
    return first_per_key(rows.withColumn("_other", F.coalesce(other, F.lit(1))), ["entry", "test"], ["_other", "chain_id"]).drop("_other")


def medoids(chains: DataFrame, found: DataFrame, most: int = 8, steps: int = 12) -> DataFrame:
    """(rank, entry, test, path): the largest clusters, each by its first chain, as names from the test to the target. Hops off
    the path and repeats in a row are left out."""
    order = [F.desc("n"), "first_chain"]
    top = found.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    rows = top.join(chains.select(F.col("chain_id").alias("first_chain"), "test", "steps"), "first_chain")
    callees = F.filter(F.transform(F.slice("steps", 1, steps), lambda s: s["callee"].cast("string")), lambda c: ~off_path(c))
    names = F.transform(F.concat(F.array("test"), callees), lambda n: class_and_method(n))
    rows = rows.withColumn("names", names)
    fresh = F.filter("names", lambda n, i: (i == 0) | (n != F.get("names", i - 1)))
    return rows.select("rank", F.col("entry").cast("string").alias("entry"), "test", F.array_join(fresh, " → ").alias("path"))


def chain_edges(chains: DataFrame, target: str, most: int = 16) -> DataFrame:
    """(caller, callee, dist, more): distinct real edges on the way to the target, nearest first, where data can be watched as it
    flows in. The test's own step, steps out of the target, recursion, virtual steps and hops off the path don't count; `more`
    says how many edges there are beyond these."""
    flat = chains.select("depth", F.posexplode("steps").alias("i", "s")).where("i > 0")
    flat = flat.select(F.col("s.caller").cast("string").alias("caller"), F.col("s.callee").cast("string").alias("callee"),
        F.col("s.virtual").alias("virtual"), (F.col("depth") - 1 - F.col("i")).alias("dist"))
    real = flat.where(~F.col("virtual") & (F.col("caller") != target) & (F.col("caller") != F.col("callee")) & ~off_path("caller") & ~off_path("callee"))
    edges = real.groupBy("caller", "callee").agg(F.min("dist").alias("dist"))
    more = max(0, edges.count() - most)
    return edges.orderBy("dist", "caller", "callee").limit(most).withColumn("more", F.lit(more).cast("long"))


def call_window(code: str, callee: str, most: int = 10) -> Column:
    """A caller's first line and a few lines around its last call of a name; gaps are marked. Short texts stay whole."""
    lines = F.split(F.rtrim(code), "\n")
    n = F.size(lines)
    calls = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.regexp_like(F.get(lines, i), F.concat(F.lit(r"\b"), F.col(callee), F.lit(r"\s*\("))))
    at = F.coalesce(F.array_max(calls), n - 1)
    high = F.least(n, at + 3)
    low = F.greatest(F.lit(1), at - 4, high - (most - 3))
    gap = lambda yes: F.when(yes, F.array(F.lit("    // ..."))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.slice(lines, 1, 1), gap(low > 1), F.slice(lines, low + 1, high - low), gap(high < n))
    return F.when(n <= most, F.rtrim(code)).otherwise(F.array_join(F.slice(parts, 1, most), "\n"))


def callers_of(calls: DataFrame, methods: DataFrame, target: str) -> DataFrame:
    """(fqn, is_test) of the known methods that call the target; `methods` has (fqn, is_test_code)."""
    direct = calls.where(F.col("callee") == target).select(F.col("caller").alias("fqn")).distinct()
    return direct.join(methods.groupBy("fqn").agg(F.max("is_test_code").alias("is_test")), "fqn")


def consumer(calls: DataFrame, methods: DataFrame, coverage: DataFrame, target: str) -> DataFrame:
    """(method, shared, jaccard, covered_by) of the production caller that most of the target's tests pass through."""
    production = callers_of(calls, methods, target).where("not is_test").select(F.col("fqn").alias("caller"))
    return knowledge.chokepoint(knowledge.co_coverage(coverage, target), production)


def focus_tests(calls: DataFrame, methods: DataFrame, covering: DataFrame, target: str, most: int = 10) -> DataFrame:
    """(test, why): tests that run the target and call it, then some whose name holds its class or method."""
    direct = callers_of(calls, methods,
        target).where("is_test").select(F.col("fqn").alias("test")).join(covering.select("test").distinct(), "test", "left_semi")
    owner, _, method = target.rpartition(".")
    words = [w.lower() for w in (owner.replace("$", ".").rpartition(".")[2], method) if w]
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("test"), F.lit(w))
    named = covering.select("test").distinct().where(hit).join(direct, "test", "left_anti").orderBy("test").limit(most)
    return direct.withColumn("why", F.lit("direct")).union(named.withColumn("why", F.lit("named")))


#: Lines that a section of a bundle may have at most; other sections stay whole.
CAPS = {"target values": 12, "consumer values": 12, "snippets": 8, "co-covered": 8, "goldens": 4}


def capped_sections(lines: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """(section, text, kept, dropped) from lines (section, ord, line): each section's first lines up to its cap, joined, with how
    many were left out. Lines are counted first, so only kept ones are joined."""
    limits = CAPS if caps is None else caps
    cap = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("section")] if limits else F.lit(None).cast("int")
    ranked = numbered(lines, ["ord", "line"], "_n", ["section"]).withColumn("_cap", cap)
    kept = ranked.where("_cap is null or _n <= _cap").groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n",
        "line"))), lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("kept"))
    total = lines.groupBy("section").agg(F.count("*").alias("all"))
    return kept.join(total, "section").select("section", "text", "kept", (F.col("all") - F.col("kept")).alias("dropped"))


def value_lines(values: DataFrame, method: str, section: str) -> DataFrame:
    """(section, ord, line) of captured calls of a method."""
    call = F.concat(F.lit("- `("), F.array_join("args", ", "), F.lit(") => "), "result", F.lit("`"))
    return values.where(F.col("method") == method).select(F.lit(section).alias("section"), "ord", call.alias("line"))


def bundle(sections: DataFrame, order: list[str], title: str, marker: str) -> str:
    """The sections (section, text, kept, dropped) as one Markdown text in an order, what was left out noted at the top. A text
    that doesn't show the marker of the stub is refused. Sections are capped, so they fit on the driver."""
    rows = {r["section"]: r for r in sections.collect()}
    notes = "; ".join(f"{rows[s]['dropped']} {s}" for s in order if s in rows and rows[s]["dropped"]) or "nothing"
    body = "\n\n".join(f"## {s}\n\n{rows[s]['text'] if s in rows else '_(none)_'}" for s in order)
    text = f"# {title}\n\n<!-- left out: {notes} -->\n\n{body}\n"
    if marker not in text:
        raise ValueError("the bundle does not show the stub")
    return text


def with_examples(document: DataFrame, values: DataFrame, target: str) -> DataFrame:
    """Document lines (n, text) followed by observed calls of the target, labelled as hints and not as what is right."""
    name = target.rpartition(".")[2]
    own = values.where(F.col("method") == target)
    top = document.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if own.isEmpty():
        return document.select("n", "text")
    head = document.sparkSession.createDataFrame([(top + 1, ""),
        (top + 2, "## Observed calls (of the present code: hints, no oracle)"), (top + 3, "")], "n long, text string")
    call = F.concat(F.lit(f"- `{name}("), F.array_join("args", ", "), F.lit(") => "), "result", F.lit("`"))
    rows = numbered(own, ["ord"], "_number").select((F.col("_number") + top + 3).cast("long").alias("n"), call.alias("text"))
    return document.select(F.col("n").cast("long").alias("n"), "text").union(head).union(rows)


#: What the older ladder leaves out before chains go.
LADDER = ["call_sites", "used_types", "siblings", "origins"]


def ladder_plan(parts: DataFrame, chains: DataFrame, budget: int) -> DataFrame:
    """(doc, dropped, chains, tokens) by the older ladder: parts (doc, part, text) of LADDER go in its order while the document is
    over budget, then the last chains (doc, rank, text), but never the first. Null tokens: even that is over budget."""
    sizes = parts.groupBy("doc", "part").agg(F.sum(token_estimate("text")).cast("long").alias("tokens"))
    wide = sizes.groupBy("doc").agg(F.sum("tokens").alias("parts"),
        *[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("tokens"))), F.lit(0)).alias(p) for p in LADDER])
    by = Window.partitionBy("doc").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = chains.select("doc", "rank", token_estimate("text").cast("long").alias("t")).withColumn("upto", F.sum("t").over(by))
    whole = ranked.groupBy("doc").agg(F.max("upto").alias("chain_tokens"), F.count("*").alias("n"))
    rows = wide.join(whole, "doc", "left").fillna({"chain_tokens": 0, "n": 0})
    left, tiers = F.col("parts"), []
    for k in range(len(LADDER) + 1):
        tiers.append(F.struct(F.lit(k).alias("k"), left.cast("long").alias("base")))
        if k < len(LADDER):
            left = left - F.col(LADDER[k])
    fits = F.get(F.filter(F.array(*tiers), lambda t: t["base"] + F.col("chain_tokens") <= budget), F.lit(0))
    rows = rows.select("doc", "n", "chain_tokens", F.coalesce(fits, tiers[-1]).alias("x"), fits.isNull().alias("over"))
    some = ranked.join(rows.where("over").select("doc", "x.base"), "doc").where((F.col("base") + F.col("upto") <= budget) | (F.col("rank") == 1))
    some = some.groupBy("doc").agg(F.count("*").alias("kept"), F.max(F.col("base") + F.col("upto")).alias("cut"))
    rows = rows.join(some, "doc", "left")
    tokens = F.when(F.col("over"), F.coalesce("cut", "x.base")).otherwise(F.col("x.base") + F.col("chain_tokens"))
    return rows.select("doc", F.slice(F.lit(LADDER), 1, F.col("x.k")).alias("dropped"),
        F.when(F.col("over"), F.coalesce("kept", F.lit(0))).otherwise(F.col("n")).alias("chains"),
        F.when(tokens <= budget, tokens).alias("tokens"))
