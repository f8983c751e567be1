"""How many rows the operators of a run plan gave."""


def most_rows(df) -> int:
    """Run it; the most rows that any one operator gave."""
    df.collect()

    def walk(plan) -> int:
        name, metrics, inner = plan.nodeName(), plan.metrics(), []
        if name == "AdaptiveSparkPlan":
            inner = [plan.executedPlan()]
        elif "QueryStage" in name:
            inner = [plan.plan()]
        children = plan.children()
        inner += [children.apply(i) for i in range(children.size())]
        own = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
        return max([own, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())
