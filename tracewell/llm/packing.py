"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Pieces of one length are interchangeable, so the search runs over the histogram of lengths (at most `capacity`
entries, whatever the corpus holds) and a solution is a multiset of bin patterns. Islands evolve separately as Spark
tasks; between epochs each hands its elite to the next island. The best solution is then dealt out: the k-th piece of a
length takes the k-th slot of that length, found by binary search in a table of slot ranges, so no step collects
documents or holds a group in one task.

Crossover injects whole well-filled bins of the donor, drops what they repeat from the host, breaks up emptier bins and a few
full ones, and best-fits the displaced pieces. It beats plain best-fit where lengths fit each other badly; on large corpora
best-fit is already within a few sequences of the bound that total length sets, and the search stops at that bound.

Cases: a text longer than a sequence is cut, whatever its length; of solutions with equally many sequences the one whose fills
differ most stands, on ties the first; null text is empty and packs as the end id alone; a null doc_id is kept; repeated rows are packed each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import configure, materialize, text_or_empty

Pattern = tuple[int, ...]
Solution = dict[Pattern, int]


def best_fit(counts: dict[int, int], capacity: int, bins: Solution | None = None, order: list[int] | None = None) -> Solution:
    """Best-fit of so many pieces of each length, in the given order of lengths (descending if none), into the given bins
    and new ones. Works on classes of equal bins, so its cost depends on the lengths and not on the number of pieces."""
    room: dict[int, Solution] = {}
    for pattern, times in (bins or {}).items():
        if times:
            slot = room.setdefault(capacity - sum(pattern), {})
            slot[pattern] = slot.get(pattern, 0) + times
    for length in order or sorted(counts, reverse=True):
        left = counts.get(length, 0)
        while left:
            tight = min((r for r in room if r >= length), default=None)
            if tight is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for k, times in ((each, full), (rest, 1 if rest else 0)):
                    if times:
                        slot = room.setdefault(capacity - k * length, {})
                        slot[(length,) * k] = slot.get((length,) * k, 0) + times
                break
            pattern, times = room[tight].popitem()
            if not room[tight]:
                del room[tight]
            each = tight // length
            used = min(times, left // each)
            moves = [(each, used)] if used else []
            if used < times and left - used * each:
                if rest := min(left - used * each, each):
                    moves.append((rest, 1))
            for k, n in moves:
                grown = tuple(sorted(pattern + (length,) * k, reverse=True))
                slot = room.setdefault(tight - k * length, {})
                slot[grown] = slot.get(grown, 0) + n
                times -= n
                left -= k * n
            if times:
                slot = room.setdefault(tight, {})
                slot[pattern] = slot.get(pattern, 0) + times
    out: Solution = {}
    for slot in room.values():
        for pattern, times in slot.items():
            out[pattern] = out.get(pattern, 0) + times
    return out


def fitness(solution: Solution, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals the one whose fills differ most, as it leaves usable room."""
    return -sum(solution.values()), sum(n * (sum(p) / capacity) ** 2 for p, n in solution.items())


def crossover(host: Solution, donor: Solution, counts: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """Inject well-filled bins of the donor whole, keep the host's bins that don't repeat a piece, best-fit the rest."""
    left = dict(counts)

    def take(solution: Solution, chosen, child: Solution) -> None:
        for pattern in chosen:
            need: dict[int, int] = {}
            for length in pattern:
                need[length] = need.get(length, 0) + 1
            times = min(solution[pattern], *(left.get(length, 0) // k for length, k in need.items()))
            if times > 0:
                child[pattern] = child.get(pattern, 0) + times
                for length, k in need.items():
                    left[length] -= k * times

    child: Solution = {}
    by_fill = lambda s: sorted(s, key=lambda p: (-sum(p), p))
    slack = max(2, capacity // 50)
    take(donor, [p for p in by_fill(donor) if sum(p) >= capacity - slack and rng.random() < 0.5], child)
    spare = rng.choice((1, capacity // 64, capacity // 16, capacity // 4))  # emptier bins of the host are broken up
    broken = rng.choice((0.0, 0.1, 0.4))  # and some of the full ones, so that their pieces can meet others
    take(host, [p for p in by_fill(host) if sum(p) >= capacity - spare and rng.random() >= broken], child)
    spread = rng.choice((0.0, 0.1, 0.5))  # displaced pieces go largest first, or nearly so
    order = sorted(left, key=lambda n: -n * (1 + rng.uniform(-spread, spread)))
    return best_fit(left, capacity, child, order)


def evolve(counts: dict[int, int], capacity: int, population: list[Solution], generations: int, size: int, seed: int) -> list[Solution]:
    """One island's epoch; best first. Stops at the bound that total length sets, as no solution can pass it."""
    rng = random.Random(seed)
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    if not population:
        population = [best_fit(counts, capacity)]
    while len(population) < size and -fitness(population[0], capacity)[0] > bound:
        order = sorted(counts, key=lambda n: -n * (1 + rng.uniform(-0.08, 0.08)))
        population.append(best_fit(counts, capacity, None, order))
    population.sort(key=lambda s: fitness(s, capacity), reverse=True)
    for _ in range(generations):
        if -fitness(population[0], capacity)[0] <= bound or len(population) < 2:
            break
        host, donor = rng.sample(population, 2)
        population.append(crossover(host, donor, counts, capacity, rng))
        population.sort(key=lambda s: fitness(s, capacity), reverse=True)
        del population[size:]
    return population


def _encode(solution: Solution) -> str:
    return json.dumps([[list(p), n] for p, n in sorted(solution.items())])


def _decode(text: str) -> Solution:
    return {tuple(p): n for p, n in json.loads(text)}


def search(spark, counts: dict[int, int], capacity: int, islands: int = 4, epochs: int = 3, generations: int = 100, size: int = 8, seed: int = 7) -> Solution:
    """Islands as Spark tasks with ring migration of elites; what moves is bounded by the number of lengths."""
    if not counts:
        return {}
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    held: dict[int, list[str]] = {i: [] for i in range(islands)}
    best: Solution = {}
    for epoch in range(epochs):

        def island(batches, epoch=epoch):
            for pdf in batches:
                for i, texts in zip(pdf["island"], pdf["elites"]):
                    found = evolve(counts, capacity, [_decode(t) for t in texts], generations, size, seed * 1009 + epoch * 101 + int(i))
                    yield _frame(int(i), [_encode(s) for s in found[:2]])

        rows = spark.createDataFrame([(i, e) for i, e in held.items()], "island int, elites array<string>").repartition(islands)
        done = {r["island"]: list(r["elites"]) for r in rows.mapInPandas(island, "island int, elites array<string>").collect()}
        best = max((_decode(e[0]) for e in done.values()), key=lambda s: fitness(s, capacity))
        if sum(best.values()) <= bound:
            break
        held = {i: done[i] + done[(i - 1) % islands][:1] for i in range(islands)}
    return best


def _frame(i: int, elites: list[str]):
    import pandas as pd

    return pd.DataFrame({"island": [i], "elites": [elites]})


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Tokenise and cut into pieces; only documents longer than a sequence are cut, and then the first piece is the short
    one. `part` and `place` number the pieces of each length within the task, for dealing them out."""

    def pieces(batches) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import ChunkEncoder

        encoder, part = ChunkEncoder.of(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                total, start, piece = len(ids) // 4, 0, 0
                while start < total:
                    length = (total - 1) % capacity + 1 if piece == 0 else capacity
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), part, seen[length]) + ((np.frombuffer(own, "<i4"),) if keep_ids else ()))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            columns = list(zip(*rows)) or [[] for _ in range(7 + keep_ids)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return plain.mapInArrow(pieces, PIECES + ", ids array<int>" * keep_ids)


def deal(pieces: DataFrame, solution: Solution) -> DataFrame:
    """Give each piece its sequence and offset. The slot table is as large as the solution's patterns, not the corpus."""
    import numpy as np

    slots: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    first = 0
    for pattern, times in sorted(solution.items(), reverse=True):
        offset = 0
        for length in pattern:
            at = filled.get(length, 0)
            slots.setdefault(length, []).append((at, first, offset))
            filled[length] = at + times
            offset += length
        first += times
    table = {n: tuple(np.array(x, dtype="int64") for x in zip(*rows)) for n, rows in slots.items()}
    counts = pieces.groupBy("part", "length").count()
    base = counts.select("part", "length",
        F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("base"))
    names = [c for c in pieces.columns if c not in ("part", "place")]
    ranked = pieces.join(base, ["part", "length"]).select(*names, (F.col("base") + F.col("place")).alias("rank"))

    def place(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), "int64"), np.zeros(len(ranks), "int64")
            for n in np.unique(lengths):
                at = np.nonzero(lengths == n)[0]
                starts, firsts, offsets = table[int(n)]
                k = np.searchsorted(starts, ranks[at], "right") - 1
                sequence[at], offset[at] = firsts[k] + ranks[at] - starts[k], offsets[k]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(place, kept + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, **options) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of `capacity` tokens. One row for each piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset, and with keep_ids the ids themselves."""
    spark = configure(docs.sparkSession)
    pieces = materialize(cut(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    return deal(pieces, search(spark, counts, capacity, **options))
