"""Personal data by weak supervision, with DataFrame functions alone.

Base spans come from fixed patterns and checks. Beyond them, candidate spans that touch no base span get votes from three
labelers: a regex labeler for strict shapes, a gazetteer labeler for known prefixes and cue words, a context labeler for what
stands around. Candidates are, of any length,

* hexadecimal runs of 32 or more, and mixed runs of letters, digits, "_" and "-" of 20 or more with upper case, lower case
  and digits, as keys and tokens are ("secret");
* digit runs of 9 or more, digits in three to six parts between blanks, dots or hyphens as account, social security and
  telephone numbers are written, and account numbers that start with two letters and two digits ("number").

Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is; its posteriors train a
naive Bayes span classifier over votes and shape, which decides. Counts are grouped by pattern and shape, so what reaches
the driver has a fixed size. Names and addresses are no candidates.

Matches are leftmost and do not overlap within a kind. Patterns use possessive repeats and look back only where that
cannot change a match, so very long runs neither recurse nor take square time; matches are gathered in slices. Each pattern runs
over a text once, putting marks that the text doesn't hold around its matches. Base spans and candidates are written once; training
and scoring both read them.

Cases: null text counts as empty and has no spans; a text of any length is read whole; spans that start together are listed
in the order of KINDS; a null doc_id is kept; repeated rows are judged each; an empty table gives an empty result; further
columns are ignored by spans() and kept by redact().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, materialize, text_or_empty

#: Kinds in the order in which spans that start together are listed (fixed values); the last ones are the method's.
KINDS = ["email", "ip", "card", "phone", "secret", "number"]
#: Base patterns (fixed values) in a form that matches alike in linear time.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: Candidates (fixed values), the first that fits.
SHAPES = [
    r"[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    r"[0-9]{9,}+(?![0-9A-Za-z])", r"[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){2,5}(?![0-9A-Za-z])", r"[A-Za-z0-9_-]{20,}+",
]
CANDIDATE = rf"(?<![0-9A-Za-z_-])(?:{'|'.join(SHAPES)})"
#: What every candidate holds.
ANY = r"[0-9A-Fa-f]{9}|[0-9][\x20.-][0-9]{2}|[A-Z]{2}[0-9]{2}|[A-Za-z0-9_-]{20}"
#: Cue words and issuer prefixes (fixed values).
CUES = r"(?i)(token|secret|key|passw|auth|card|visa|account|phone|tel|call|iban|ssn|social|id)\W*$"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
KEY_STARTS = r"^(sk|pk|rk|gh[pousr]|xox[abprs]|AKIA|ASIA|AIza|glpat|eyJ)[-_A-Za-z0-9]"
AROUND = 24
#: Put around matches; where a text holds it, its hash stands between two.
MARK = "\x01"
#: Matches gathered at a time.
SLICE = 256
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>>"


def find(text: Column, pattern: str, kind: str, valid=None) -> Column:
    """The matches that are valid as array<struct<start, rank, end, kind, value, before, after>>, in code points, end exclusive,
    with the last characters of what stands between a match and the one before, and the first ones of what follows. Lengths of
    what stands between matches and of the matches add up to places; only valid ones are gathered, slice by slice."""
    mark = F.when(~F.contains(text, F.lit(MARK)), F.lit(MARK)).otherwise(F.concat(F.lit(MARK), F.md5(text.cast("binary")), F.lit(MARK)))
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.concat(mark, F.lit("$0"), mark)), mark, -1)

    def paired(parts: Column) -> Column:
        """Gaps stand at even places, matches at odd ones."""
        pair = lambda i: F.struct(F.get(parts, 2 * i).alias("gap"), F.get(parts, 2 * i + 1).alias("hit"), F.get(parts, 2 * i + 2).alias("next"))
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), pair)

    pairs_of = lambda parts: F.when(F.size(parts) > 2, paired(parts)).otherwise(F.array().cast("array<struct<gap:string,hit:string,next:string>>"))
    empty = F.array().cast(SPAN)

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        around = (F.right(x["gap"], F.lit(AROUND)).alias("before"), F.left(F.coalesce(x["next"], F.lit("")), F.lit(2)).alias("after"))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
            x["hit"].alias("value"), *around)
        out = F.concat(acc["out"], F.array(span).cast(SPAN))
        if valid is not None:
            out = F.when(valid(x["hit"]), out).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def gathered(acc, some):
        own = F.aggregate(some, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return F.struct(own["at"].alias("at"), F.concat(acc["parts"], F.array(own["out"])).alias("parts"))

    def spans_of(pairs: Column) -> Column:
        few = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
        slices = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / SLICE).cast("int")), lambda i: F.slice(pairs, i * SLICE + 1, F.lit(SLICE)))
        many = F.aggregate(slices, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts")), gathered, lambda acc: F.flatten(acc["parts"]))
        return F.when(F.size(pairs) <= SLICE, few).otherwise(many)

    return _once(_once(parts, pairs_of), spans_of)


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(acc, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), step) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def account(value: Column) -> Column:
    """Whether an account number with country letters has the right check digits (remainder 1 by 97)."""
    bare = F.upper(F.regexp_replace(value, r"\x20", ""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.left(bare, F.lit(4)))
    code = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)
    return rest == 1


def base(text: Column) -> Column:
    """Base spans by start, then kind."""
    none = F.array().cast(SPAN)
    email = F.when(F.contains(text, F.lit("@")), find(text, EMAIL, "email")).otherwise(none)
    ip = find(text, IP, "ip", lambda v: v.rlike(IP_PARTS))
    card = find(text, CARD, "card", lambda v: F.when(F.length(v).between(14, 37) & F.length(_digits(v)).between(14, 19), luhn(_digits(v))).otherwise(False))
    phone = F.when(F.contains(text, F.lit("+")), find(text, PHONE, "phone", lambda v: F.length(_digits(v)).between(10, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def candidates(text: Column, taken: Column) -> Column:
    """Candidate spans that touch no base span, with the text before and after each."""
    mixed = lambda v: ~v.rlike(r"^[A-Za-z0-9_-]{20,}+$") | v.rlike(r"^[0-9A-Fa-f]{32,}+$|^[0-9]+$") | (v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]"))
    found = F.when(text.rlike(ANY), find(text, CANDIDATE, "number", mixed)).otherwise(F.array().cast(SPAN))
    return F.filter(found, lambda c: ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def form(value: Column) -> Column:
    """0 for a digit run, 1 for parted digits, 2 for an account number, 3 for hexadecimal, 4 for a mixed key."""
    return F.when(value.rlike("^[0-9]+$"), 0).when(value.rlike(r"^[0-9][0-9\x20.-]*$"),
        1).when(value.rlike(r"^[A-Z]{2}[0-9]{2}[0-9A-Z\x20]+$") & (F.length(value) < 43), 2).when(value.rlike("^[0-9A-Fa-f]+$"),
        3).otherwise(4)


def features(c: Column) -> Column:
    """Votes of the three labelers and the shape of a candidate, each a small number."""
    value, before, after = c["value"], c["before"], c["after"]
    kind = form(value)
    varied = F.size(F.array_distinct(F.split(value, ""))) > 13
    shape = (
        F.when(kind == 0, F.length(value).between(14, 19) & luhn(value)).when(kind == 1, value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}$"))
        .when(kind == 2, account(value)).when(kind == 3, value.rlike("[0-9]") & value.rlike("[A-Fa-f]") & F.length(value).isin(32, 40, 64, 128)).otherwise(varied)
    )
    prefix = F.when(kind == 0, value.rlike(ISSUERS) & F.length(value).isin(15, 16)).when(kind == 4, value.rlike(KEY_STARTS)).otherwise(False)
    known = before.rlike(CUES) | prefix
    context = before.rlike("[=:#]\\s*[\"']?$") | before.rlike("[\"'(<]$") & after.rlike("^[\"')>]")
    size = F.when(F.length(value) < 14, 0).when(F.length(value) < 20, 1).when(F.length(value) < 40, 2).otherwise(3)
    return F.struct(shape.cast("int").alias("v0"), known.cast("int").alias("v1"), context.cast("int").alias("v2"), kind.alias("form"), size.alias("size"))


NAMES = ["v0", "v1", "v2", "form", "size"]


def expectation_maximisation(counts: dict[tuple[int, int, int], float], rounds: int = 50) -> tuple[float, list[tuple[float, float]], dict]:
    """(prior, (rate if private, rate if not) of each labeler, posterior of each vote pattern); starts at the majority."""
    posterior = {v: (0.15 + 0.7 * (sum(v) >= 2)) for v in counts}
    prior, rates = 0.5, [(0.5, 0.5)] * 3
    for _ in range(rounds):
        yes = sum(n * posterior[v] for v, n in counts.items()) + 1
        no = sum(n * (1 - posterior[v]) for v, n in counts.items()) + 1
        prior = yes / (yes + no)
        rates = [((sum(n * posterior[v] for v, n in counts.items() if v[i]) + 0.5) / yes,
            (sum(n * (1 - posterior[v]) for v, n in counts.items() if v[i]) + 0.5) / no) for i in range(3)]
        rates = [(min(max(a, 0.01), 0.99), min(max(b, 0.01), 0.99)) for a, b in rates]
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(a / b) if x else math.log((1 - a) / (1 - b)) for x, (a, b) in zip(v, rates))
            posterior[v] = 1 / (1 + math.exp(-odds))
    return prior, rates, posterior


def train(found: DataFrame) -> dict:
    """The span classifier: log-odds of each value of each feature, from counts by vote pattern and shape in rows with `more`."""
    seen = found.select(F.explode("more").alias("m")).select(F.col("m.f").alias("f"))
    rows = [r.asDict() for r in seen.groupBy(*[F.col("f")[n].alias(n) for n in NAMES]).count().collect()]  # 8 vote patterns by 20 shapes at most
    votes: dict[tuple[int, int, int], float] = {}
    for r in rows:
        votes[r["v0"], r["v1"], r["v2"]] = votes.get((r["v0"], r["v1"], r["v2"]), 0) + r["count"]
    if not votes:
        return {"bias": -1.0, "weights": {}}
    prior, _, posterior = expectation_maximisation(votes)
    weights: dict[tuple[str, int], float] = {}
    yes = sum(r["count"] * posterior[r["v0"], r["v1"], r["v2"]] for r in rows)
    no = sum(r["count"] for r in rows) - yes
    for name in NAMES:
        for value in {r[name] for r in rows}:
            a = sum(r["count"] * posterior[r["v0"], r["v1"], r["v2"]] for r in rows if r[name] == value)
            b = sum(r["count"] for r in rows if r[name] == value) - a
            weights[name, value] = math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2))
    return {"bias": math.log(prior / (1 - prior)), "weights": weights}


def _score(model: dict, f: Column) -> Column:
    total = F.lit(model["bias"])
    for (name, value), w in sorted(model["weights"].items()):
        total = total + F.when(f[name] == value, w).otherwise(0.0)
    return total


def _found(rows: DataFrame) -> DataFrame:
    """Rows with `body`, and `base` and `more` (candidates with their features), written once."""
    text = F.col("body")
    more = F.transform(candidates(text, F.col("base")), lambda c: F.struct(c.alias("c"), features(c).alias("f")))
    return rows.withColumn("base", base(text)).withColumn("more", more)


def _with_spans(rows: DataFrame, model: dict) -> DataFrame:
    """Adds `spans`, an array of the structs of find(), to rows of _found()."""

    def named(m):
        number = m["f"]["form"] < 3
        rank, kind = F.when(number, 5).otherwise(4), F.when(number, "number").otherwise("secret")
        return m["c"].withField("rank", rank).withField("kind", kind)

    added = F.transform(F.filter("more", lambda m: _score(model, m["f"]) >= 0), named)
    return rows.withColumn("spans", F.array_sort(F.concat("base", added)))


def listed(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of the structs of find()) for every document."""
    configure(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body"))
    found = materialize(_found(plain).drop("body"), "spans")
    return _with_spans(found, train(found)).select("doc_id", "base", "spans")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; all columns stay, n_chars follows the text."""
    configure(docs.sparkSession)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("body"))
    found = materialize(_found(own), "spans")
    rows = _with_spans(found, train(found))
    text = F.col("body")

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
            acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"),
            F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out")))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    any_ = F.size("spans") > 0
    cleaned = rows.withColumn("clean", F.when(any_, done).otherwise(F.col("row.text")))
    new = {"text": F.col("clean"), "n_chars": F.when(any_,
        F.length("clean").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return cleaned.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
