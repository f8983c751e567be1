"""Boolean columns: what is a test, an entry point, an assertion, a peripheral or platform method, a structural line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import last_dotted, owner, simple

#: Fixed values.
TEST_ANNOTATIONS = ["Test", "ParameterizedTest", "RepeatedTest"]
EXPORT_TEST_ANNOTATIONS = [*TEST_ANNOTATIONS, "TestFactory", "TestTemplate"]
PLATFORM = r"^(java|javax|sun|jdk|kotlin|scala)\."
ASSERTION_PREFIXES = {"view": r"^(assert|fail|verify|expect|then)", "snippet": r"^(assert|expect|verify|assume)|^fail$", "slice": r"^(assert|fail)"}
CONTROL_KINDS = {"IF": "IF", "ELSE": "IF", "SWITCH": "IF", "FOR": "LOOP", "WHILE": "LOOP", "DO": "LOOP", "FOREACH": "LOOP"}


def flag(column) -> Column:
    """A boolean that may have come as text."""
    return F.coalesce(F.lower(F.col(column).cast("string")) == "true", F.lit(False))


def annotated_tests(methods: DataFrame, ast: DataFrame, annotations: DataFrame, names: list[str] = TEST_ANNOTATIONS) -> DataFrame:
    """Methods with is_test from their own flag or, failing that, a test annotation among their children."""
    wanted = annotations.where(simple(F.coalesce("full_name", "name")).isin(names) | F.col("name").isin(names)).select(F.col("id").alias("dst"))
    marked = ast.join(wanted, "dst", "left_semi").select(F.col("src").alias("id"), F.lit(True).alias("marked")).distinct()
    return methods.join(marked, "id", "left").withColumn("is_test",
        F.coalesce(F.col("is_test") | F.col("marked"), F.col("is_test"), F.col("marked"), F.lit(False))).drop("marked")


def export_test_annotation(name) -> Column:
    """An annotation that marks a test on export, plain or qualified."""
    return last_dotted(name).isin(EXPORT_TEST_ANNOTATIONS)


def promote_test_folders(methods: DataFrame, on: bool) -> DataFrame:
    """With `on`, methods in the test source folder count as tests."""
    return methods.withColumn("is_test", F.col("is_test") | (F.lit(on) & F.coalesce(F.col("file").contains("src/test/java"), F.lit(False))))


def is_entry(is_test="is_test", file="file", fqn="fqn") -> Column:
    """An entry point: flagged, in a test folder, in a class named as tests are, or a method named test..."""
    cls = simple(owner(fqn))
    return F.coalesce(F.col(is_test), F.lit(False)) | F.coalesce(F.col(file).contains("/src/test/"),
        F.lit(False)) | cls.rlike("(Test|Tests|IT)$") | last_dotted(fqn).startswith("test")


def test_code(methods: DataFrame) -> DataFrame:
    """Adds is_test_code: flagged, in the marked test folder, or in a class that has such a sibling."""
    in_folder = F.coalesce(F.col("file").contains("/__t__/"), F.lit(False))
    classes = methods.where(in_folder).select(owner("fqn").alias("cls")).distinct().withColumn("sibling", F.lit(True))
    return methods.withColumn("cls", owner("fqn")).join(classes, "cls", "left").withColumn("is_test_code",
        F.coalesce(F.col("is_test"), F.lit(False)) | in_folder | F.coalesce("sibling", F.lit(False))).drop("cls", "sibling")


def assertion_like(name, variant: str = "slice") -> Column:
    """A call that asserts, by its simple name; the slice variant ignores case."""
    last = last_dotted(name)
    return (F.lower(last) if variant == "slice" else last).rlike(ASSERTION_PREFIXES[variant])


def peripheral(file, fqn) -> Column:
    """Examples, samples and demos, and anonymous classes."""
    return F.coalesce(F.translate(file, "\\", "/").rlike(r"(-examples|/examples|/samples|/demo)/"), F.lit(False)) | F.col(fqn).rlike(r"\$[0-9]")


def platform(fqn) -> Column:
    """In a namespace of the platform, which traversal doesn't enter."""
    return F.col(fqn).rlike(PLATFORM)


def control_kind(control) -> Column:
    """IF, LOOP, RETURN or OTHER from a control structure's type."""
    kinds = F.create_map(*[F.lit(x) for pair in CONTROL_KINDS.items() for x in pair])
    return F.coalesce(F.when(F.col(control) == "RETURN", "RETURN"), kinds[F.upper(F.col(control))], F.lit("OTHER"))


def readable_source(file="file", start="line_start", end="line_end") -> Column:
    """Has a real file and a valid range."""
    return F.col(file).isNotNull() & ~F.col(file).isin("", "<empty>", "<unknown>") & (F.col(start) > 0) & (F.col(end) >= F.col(start))


def structural_line(text) -> Column:
    """Blank, closing, opening or comment lines."""
    t = F.trim(text)
    return (t == "") | t.rlike(r"^[})\];]+$") | t.endswith("{") | t.rlike(r"^(//|/\*|\*)")


def trimmed_helper(first_line) -> Column:
    """Deprecated or static members, which the specification mode leaves out."""
    return F.trim(first_line).rlike(r"@Deprecated|(^|\s)static\s")


def consistent_source(code, line, width: int = 25) -> Column:
    """Whether a statement's text fits a source line: the start of either, spaces aside, is in the other; a leading
    "this." may be missing."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    src, own = flat(F.col(line)), flat(F.col(code))
    fits = lambda c: (F.length(c) > 0) & (F.contains(src, F.substring(c, 1, width)) | F.contains(c, src))
    return (src != "") & (fits(own) | fits(F.regexp_replace(own, r"^this\.", "")))


def matches_search(columns: list[str], text: str) -> Column:
    """Case-blind substring search over several columns."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower()))


def layers(names: list[str]) -> list[str]:
    """Edge layers by name, in any case; an unknown one is an error."""
    from ..schema import LAYERS

    wanted = [n.strip().upper() for n in names]
    if unknown := [n for n in wanted if n not in LAYERS]:
        raise ValueError(f"no such layer: {', '.join(unknown)}; one of {', '.join(LAYERS)}")
    return wanted


def scrub_paths(text, roots: list[str]) -> Column:
    """Roots removed; a row in which an absolute path survives is an error."""
    out = F.col(text)
    for root in sorted(roots, key=len, reverse=True):
        out = F.replace(out, F.lit(root.rstrip("/") + "/"), F.lit(""))
    bad = out.rlike(r"(^|[\s\"'=:(])/(home|root|Users|tmp|var|opt)/")
    return F.when(F.assert_true(~F.coalesce(bad, F.lit(False)), F.lit("an absolute path is left")).isNull(), out)
