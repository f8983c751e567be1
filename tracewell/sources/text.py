"""Reading text: sources by line, fingerprints, diffs, stack traces, disassembly, version control."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders that staging leaves out (fixed values).
SKIPPED = [".git", ".idea", ".gradle", "build", "target", "out", "node_modules"]


def staged(files: DataFrame, column: str = "path") -> DataFrame:
    """Files outside the folders that staging leaves out."""
    return files.where(~F.arrays_overlap(F.split(column, "/"), F.lit(SKIPPED)))


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text) from whole texts (file, content), lines from 1."""
    return files.select("file", F.posexplode(F.split("content", "\r?\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def read_sources(spark: SparkSession, path: str, glob: str = "*.java") -> DataFrame:
    """(file, content) below a folder; file is relative to it."""
    root = "/" + path.removeprefix("file:").strip("/") + "/" if "://" not in path or path.startswith("file:") else path.rstrip("/") + "/"
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return staged(rows.select(F.substring_index(F.col("_metadata.file_path"), root, -1).alias("path"),
        F.col("value").alias("content"))).withColumnRenamed("path", "file")


def fragment(source_lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) for rows (key, file, line_start, line_end); ranges are clamped to the file."""
    met = wanted.join(source_lines, "file").where(F.col("line").between(F.greatest("line_start", F.lit(1)), F.col("line_end")))
    return met.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def around(wanted: DataFrame, before: int = 3, after: int = 2) -> DataFrame:
    """Ranges around single lines (key, file, line)."""
    return wanted.select("key", "file", (F.col("line") - before).alias("line_start"), (F.col("line") + after).alias("line_end"))


def fingerprint(files: DataFrame, salt: str = "") -> DataFrame:
    """One digest over all (file, content), whatever their order; it changes with any name or content, and with the salt.
    Digests of files meet in up to 65,536 groups, and the groups' digests in one row."""
    each = files.select(F.sha2(F.concat_ws("\0", "file", F.sha2("content", 256)), 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    groups = each.groupBy(F.substring("h", 1, 4).alias("g")).agg(joined("h").alias("h"))
    return groups.agg(F.sha2(F.concat(F.lit(salt), joined("h")), 256).alias("digest"))


def short_digest(column: str):
    """The first eight bytes of a digest, in hex."""
    return F.substring(F.sha2(F.col(column), 256), 1, 16)


def new_name(line: str) -> Column:
    """The file that a "+++ " line of a unified diff names, without the prefix of its side and a time after a tab; else null."""
    name = F.rtrim(F.substring_index(F.substring(line, 5, 1 << 20), "\t", 1))
    own = F.when(name.startswith("b/"), F.substring(name, 3, 1 << 20)).otherwise(name)
    return F.when(F.col(line).startswith("+++ ") & (own != ""), own)


def old_start(line: str) -> Column:
    """The first line on the old side that a hunk's head "@@ -a,b +c,d @@" states; else null."""
    words = F.split(line, " ")
    old, new, end = (F.get(words, F.lit(i)) for i in (1, 2, 3))
    first = F.substring_index(F.substring(old, 2, 20), ",", 1).try_cast("int")
    return F.when(F.col(line).startswith("@@ ") & old.startswith("-") & new.startswith("+") & (end == "@@"), first)


def deleted_lines(diff: DataFrame) -> DataFrame:
    """(file, line) that a unified diff touches on its base side, from lines (n, value) or (diff_id, n, value): deleted
    lines, and the anchor of a hunk that deletes none."""
    keys = ["diff_id"] if "diff_id" in diff.columns else []
    order = Window.partitionBy(*keys).orderBy("n") if keys else Window.orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = diff.withColumns({"name": new_name("value"), "start": old_start("value")})
    rows = rows.withColumns({"file": F.last("name", ignorenulls=True).over(so_far),
        "hunk": F.sum(F.when(F.col("start").isNotNull() | F.col("name").isNotNull(), 1).otherwise(0)).over(so_far)})
    v = F.col("value")
    gone = v.startswith("-") & ~v.startswith("---")
    added = v.startswith("+") & ~v.startswith("+++")
    body = F.col("start").isNull() & F.col("name").isNull() & F.col("file").isNotNull()
    rows = rows.withColumns({"gone": body & gone, "moves": body & (gone | (~added & ~v.startswith("\\") & ~v.startswith("---")))})
    inside = Window.partitionBy(*keys, "hunk").orderBy("n")
    before = F.coalesce(F.sum(F.col("moves").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"anchor": F.first("start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding,
        Window.currentRow)), "before": before})
    hunks = rows.where("file is not null and anchor is not null")
    lines_gone = hunks.where("gone").select(*keys, "file", (F.col("anchor") + F.col("before")).alias("line"))
    pure = hunks.groupBy(*keys, "file", "hunk").agg(F.max("anchor").alias("line"), F.max("gone").alias("any")).where("not any").select(*keys, "file", "line")
    return lines_gone.union(pure).distinct()


def git_diff(repo: str, base: str = "HEAD") -> str:
    """The diff of a working tree; the caller turns it into lines."""
    return subprocess.run(["git", "-C", repo, "diff", "--no-color", base], capture_output=True, text=True, check=True, timeout=120).stdout


def numbered(spark: SparkSession, text: str) -> DataFrame:
    """(n, value) of a text held by the driver."""
    return spark.createDataFrame(list(enumerate(text.splitlines())), "n int, value string")


def frames(traces: DataFrame) -> DataFrame:
    """(trace_id, cause_ix, exc_type, message, frame_ix, cls, method, file, line) from (trace_id, trace)."""
    rows = traces.select("trace_id", F.posexplode(F.split("trace", "\r?\n")).alias("n", "raw"))
    text = F.trim(F.translate("raw", "\t", " "))
    # A frame is "at ", a qualified method, and a place in brackets: a file, and often a line after a colon.
    place = F.substring_index(F.substring_index(text, "(", -1), ")", 1)
    called = F.substring_index(F.substring_index(F.substring(text, 4, 1 << 20), "(", 1), "/", -1)
    method = F.substring_index(called, ".", -1)
    rows = rows.withColumns({"text": text, "place": place, "method": method, "cls": F.substring(called, F.lit(1), F.length(called) - F.length(method) - 1)})
    rows = rows.withColumn("is_frame", text.startswith("at ") & F.contains(text, F.lit("(")) & (F.col("cls") != "") & (F.col("place") != ""))
    text = F.col("text")
    by = Window.partitionBy("trace_id").orderBy("n")
    rows = rows.where((text != "") & ~text.startswith("..."))
    # A head is an exception's type, and often a message after a colon.
    deeper = text.startswith("Caused by:")
    body = F.when(deeper, F.ltrim(F.substring(text, 11, 1 << 20))).otherwise(text)
    kind = F.substring_index(body, ":", 1)
    headed = (kind != "") & ~F.contains(kind, F.lit(" "))
    message = F.ltrim(F.substring(body, F.length(kind) + 2, F.length(body)))
    rows = rows.withColumns({"kind": kind, "message": message})
    first = ~F.col("is_frame") & headed & (F.coalesce(F.sum(F.when(~F.col("is_frame") & headed,
        1)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0)
    rows = rows.withColumn("header", first | (~F.col("is_frame") & headed & deeper))
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.last(F.when(F.col("header"), F.struct("kind", "message")), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"cause_ix": F.sum(F.col("header").cast("int")).over(so_far) - 1, "head": head}).where("is_frame and cause_ix >= 0")
    ix = F.row_number().over(Window.partitionBy("trace_id", "cause_ix").orderBy("n")) - 1
    line = F.coalesce(F.when(F.contains("place", F.lit(":")), F.substring_index("place", ":", -1)).try_cast("int"), F.lit(-1))
    return rows.select("trace_id", F.col("cause_ix").cast("int").alias("cause_ix"), F.col("head.kind").alias("exc_type"),
        "head.message", ix.alias("frame_ix"), "cls", "method", F.substring_index("place", ":", 1).alias("file"), line.alias("line"))


def root_causes(all_frames: DataFrame, package: str) -> DataFrame:
    """Frames of each trace's deepest cause that has a frame of the project."""
    own = all_frames.where(F.col("cls").startswith(package)).groupBy("trace_id").agg(F.max("cause_ix").alias("cause_ix"))
    return all_frames.join(own, ["trace_id", "cause_ix"])


def redacted(source_lines: DataFrame, member: str, marker: str = "    // body removed") -> DataFrame:
    """Disassembly lines (file, line, text) with one member's section blanked: from its header to the next blank line."""
    by = Window.partitionBy("file").orderBy("line")
    starts = F.col("text").rlike(r"^  \S.*;\s*$") | (F.trim("text") == "") | F.col("text").startswith("}")
    island = F.sum(starts.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = source_lines.withColumn("island", island)
    hit = F.max(F.col("text").rlike(rf"[\s.]{member}\(") & starts).over(Window.partitionBy("file", "island"))
    return rows.withColumn("hit", hit).select("file", "line", F.when(F.col("hit") & ~starts, F.lit(marker)).otherwise(F.col("text")).alias("text"))


def strip_sections(document: DataFrame, drop: str) -> DataFrame:
    """Markdown lines (n, text) without sections whose heading fits a pattern, sub-sections included; runs of blank lines
    become one."""
    level = F.length(F.regexp_extract("text", r"^(#+) ", 1))
    by = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = document.withColumns({"level": level, "hit": (level > 0) & F.col("text").rlike(drop)})
    rows = rows.withColumn("part", F.sum((F.col("level") > 0).cast("int")).over(by))
    heads = rows.where("level > 0").select("part", "level", "hit")
    # A section goes if it, or the nearest heading above it of a lesser level that was dropped, is still open.
    opened = F.last(F.when(F.col("hit"), F.struct("part", "level")), ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    heads = heads.withColumn("open", opened)
    shut = heads.select(F.col("part").alias("p2"), F.col("level").alias("l2"))
    ended = heads.join(shut,
        (F.col("p2") > F.col("open.part")) & (F.col("p2") <= F.col("part")) & (F.col("l2") <= F.col("open.level")),
        "left").groupBy("part").agg(F.first("open").alias("open"), F.count("p2").alias("n_shut"))
    gone = ended.where("open is not null and n_shut = 0").select("part")
    kept = rows.join(gone, "part", "left_anti")
    blank = F.trim("text") == ""
    again = blank & F.coalesce(F.trim(F.lag("text").over(Window.orderBy("n"))) == "", F.lit(False))
    return kept.withColumn("again", again).where("not again").select("n", "text")
