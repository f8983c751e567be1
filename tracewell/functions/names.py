"""Name columns: qualified names, simple names, normal forms of producers, display texts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_signature(name) -> Column:
    """Up to the first colon."""
    return F.substring_index(F.col(name) if isinstance(name, str) else name, ":", 1)


def owner(name) -> Column:
    """The qualified class of a qualified method."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(F.lit(""))


def simple(name) -> Column:
    """After the last dot or dollar."""
    return F.element_at(F.split(F.col(name) if isinstance(name, str) else name, r"[.$]"), -1)


def last_dotted(name) -> Column:
    """After the last dot."""
    return F.substring_index(F.col(name) if isinstance(name, str) else name, ".", -1)


def class_and_method(name) -> Column:
    """Innermost class and method, for display."""
    cls = owner(name)
    return F.when(cls == "", last_dotted(name)).otherwise(F.concat_ws(".", simple(cls), last_dotted(name)))


def from_slashes(cls, method=None) -> Column:
    """A coverage or mutation tool's class (and method) as a dotted name."""
    dotted = F.translate(F.col(cls), "/", ".")
    return dotted if method is None else F.concat_ws(".", dotted, F.col(method))


def canonical_test(test) -> Column:
    """Without the bracketed parameters of a parameterised test."""
    return F.substring_index(F.col(test) if isinstance(test, str) else test, "[", 1)


def test_class(test) -> Column:
    """The class part of a test."""
    return owner(test)


def basename(path) -> Column:
    """The last part of a path."""
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)


#: Path parts that staging renames (fixed values).
STAGED = {"__t__": "test", "__ts__": "tests"}


def unstage(path) -> Column:
    """A staged path with its own names again; whole parts only."""
    back = F.create_map(*[F.lit(x) for pair in STAGED.items() for x in pair])
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.coalesce(back[p], p)), "/")


def map_test_folder(path) -> Column:
    """The marker of the test folder replaced by its name."""
    return F.regexp_replace(path, "/__t__/", "/test/")


def package_path(path) -> Column:
    """A source path from its package on."""
    found = F.regexp_extract(path, r"src/(?:main|test)/java/(.*)$", 1)
    return F.when(found != "", found).otherwise(F.col(path) if isinstance(path, str) else path)


def one_line(text, width: int) -> Column:
    """White space collapsed; longer texts end in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def identifier(text) -> Column:
    """Anything but letters, digits and underscores becomes an underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def parameters(signature) -> Column:
    """Parameter types of "result(a,b)"; empty if there are none."""
    inner = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    return F.when(F.trim(inner) == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"\s*,\s*"))


def readable_signature(fqn, signature) -> Column:
    """method(simple parameter types)."""
    return F.concat(last_dotted(fqn), F.lit("("),
        F.array_join(F.transform(parameters(signature), lambda p: F.element_at(F.split(p, r"[.$]"), -1)), ", "), F.lit(")"))


def first_sentence(doc, width: int = 220) -> Column:
    """The first sentence of a documentation comment, without its frame."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(doc, r"(?m)^\s*/?\*+/?|\*/", " "), r"\s+", " "))
    return F.substring(F.regexp_extract(flat, r"^(.*?(?:\.(?=\s|$)|$))", 1), 1, width)


def escape_pipes(text) -> Column:
    """For table cells."""
    return F.replace(F.col(text) if isinstance(text, str) else text, F.lit("|"), F.lit("\\|"))


def escape_html(text) -> Column:
    """For markup."""
    out = F.col(text) if isinstance(text, str) else text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def token_estimate(text) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("int")


def nearest(name: str, candidates, column: str = "name", distance: int = 2, most: int = 5):
    """Rows whose name is within an edit distance, nearest first."""
    d = F.levenshtein(F.col(column), F.lit(name), distance)
    return candidates.select(column).distinct().withColumn("distance", d).where("distance >= 0").orderBy("distance", column).limit(most)


@dataclass(frozen=True)
class Target:
    """A target method as a user writes it: file#Class.method(params) or qualified.Class#method(params)."""

    name: str
    simple_class: str
    file: str | None = None
    cls: str | None = None
    params: tuple[str, ...] = field(default=())

    @classmethod
    def parse(cls, text: str) -> "Target":
        """Either form; anything else is an error."""
        word = r"[A-Za-z_]\w*"
        m = re.fullmatch(rf"([^#]+)#([A-Za-z_][\w$]*)\.({word})(?:\(([^)]*)\))?", text.strip())
        if m:
            file, owner_name, name, params = m.groups()
            return cls(name, owner_name, file=file, params=_split(params))
        m = re.fullmatch(rf"([A-Za-z_][\w.$]*)#({word})(?:\(([^)]*)\))?", text.strip())
        if m:
            full, name, params = m.groups()
            return cls(name, re.split(r"[.$]", full)[-1], cls=full, params=_split(params))
        raise ValueError(f"not a target: {text}")


def _split(params: str | None) -> tuple[str, ...]:
    return tuple(p.strip() for p in params.split(",")) if params and params.strip() else ()
