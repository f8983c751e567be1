"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import archives, decontaminate, near_dups, packing, private_data, quality, token_files, url_rules, vectors, verbatim
from tracewell.llm.common import materialize
from tracewell.llm.components import components
from tracewell.llm.suffixes import suffix_array
from tracewell.llm.tokens import ChunkEncoder, default_path

BYTE, WORD = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, rank long, keys string, base string, d long, th long, row string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(1)
    a, b = words(rng, 120), words(rng, 300)
    near = " ".join(w if i % 60 else "changed" for i, w in enumerate(b.split()))
    odd = ["", None, " \n\t ", "one", "é" * 3, "Ünï çödé ça va 漢字漢字 😀 don't \x00 x\u0301", words(rng, 2500), "9" * 6000, "a" * 3000, ("ab " * 900)]
    return [a, b, near, a, a.upper(), words(rng, 60) + " " + a, b[:400] + words(rng, 40), *odd, "", None, words(rng, 80)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 7, 7, "k", "b", 7, 7, "r") for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, None, None, None, None, None, None, None), rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fresh(path, special_text=True):
    """A tokenizer of its own, set as the notes beside the vocabulary files do."""
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_text
    return t


def ids(path, text):
    return fresh(path).encode(text or "", add_special_tokens=False).ids + [2]


# -- tokens ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["don't", " we'll", "A,b", "x9y", "  \n", "\u00a0", "\u3000", "\x1c", "<|endoftext|>", "Éa.", "ΑΣ Σ", "n\u0303", " the", "the", ", "])), max_size=12).map("".join))
def test_chunks_encode_as_whole_texts(path, text):
    text = text.encode("utf-8", "ignore").decode()
    for special in (True, False):
        whole = _FRESH.setdefault((path, special), fresh(path, special)).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ChunkEncoder.of(path, special).encode(text), "<u4").tolist() == whole


_FRESH: dict = {}


def test_special_strings_are_text_unless_asked():
    text = "hi <|endoftext|> there"
    assert np.frombuffer(ChunkEncoder.of(BYTE).encode(text), "<u4").tolist() == fresh(BYTE).encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(ChunkEncoder.of(BYTE, False).encode(text), "<u4")


# -- 1: packing -----------------------------------------------------------------------------------


def test_packing(docs, none):
    got = packing.pack(docs, BYTE, 128, keep_ids=True).toPandas()
    whole = sorted(len(ids(BYTE, r["text"])) for r in docs.collect())
    assert sorted(got.groupby(["doc_id", "piece", "ids_crc32"], dropna=False).size().index.get_level_values(1)) and got["length"].sum() == sum(whole)
    for r in docs.dropDuplicates(["doc_id"]).where("doc_id is not null").collect():
        want, own = ids(BYTE, r["text"]), got[got.doc_id == r["doc_id"]].drop_duplicates("piece").sort_values("piece")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(want)
        assert all(n == 128 for n in own.length[1:])
        for p in own.itertuples():
            part = np.array(want[p.start : p.start + p.length], "<u4")
            assert zlib.crc32(part.tobytes()) == p.ids_crc32 and list(p.ids) == part.tolist()
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 128
    counts = got.groupby("length").size().to_dict()
    assert got.sequence_id.nunique() <= sum(packing.best_fit(counts, 128).values())
    assert packing.pack(none, BYTE).count() == 0


def test_search_beats_or_equals_best_fit(spark):
    rng = random.Random(5)
    counts = {n: rng.randint(1, 3) for n in rng.sample(range(20, 60), 25)}
    plain = packing.best_fit(counts, 100)
    found = packing.search(spark, counts, 100, islands=2, epochs=2, generations=30)
    for s in (plain, found):
        have: dict = {}
        for p, n in s.items():
            assert sum(p) <= 100
            for x in p:
                have[x] = have.get(x, 0) + n
        assert have == counts
    assert sum(found.values()) <= sum(plain.values())
    child = packing.crossover(plain, found, counts, 100, rng)
    assert sum(len(p) * n for p, n in child.items()) == sum(counts.values())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_crossover_beats_best_fit(seed):
    rng = random.Random(seed)
    counts: dict = {}
    for _ in range(200):  # two or three to a sequence, so that it matters which ones meet
        n = rng.randint(200, 500)
        counts[n] = counts.get(n, 0) + 1
    plain = sum(packing.best_fit(counts, 1024).values())
    start, end = (sum(packing.evolve(counts, 1024, [], g, 8, seed)[0].values()) for g in (0, 100))
    assert end < start <= plain and end <= plain - 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_equals_item_by_item(lengths):
    counts: dict = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    bins: list = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + n <= 20]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    assert sum(packing.best_fit(counts, 20).values()) == len(bins)


# -- 2: quality -----------------------------------------------------------------------------------


def test_quality(spark, docs, none):
    rng = random.Random(3)
    rows = [(i, words(rng, 50) + "." if i % 3 else (words(rng, 30).upper() + "!! " * 20)) for i in range(400)]
    df = spark.createDataFrame([(i, t, "x", "y", 0, 0, 0, "", "", 0, 0, "") for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(df, labels).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.doc_id % 3 > 0)).mean() > 0.95 and got.score.between(0, 1).all()
    assert quality.keep(df, labels).columns == df.columns
    # Labels of the held-out fold never matter.
    flipped = labels.withColumn("quality", F.when(quality.fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score(df, flipped).toPandas().sort_values("doc_id")
    assert np.allclose(again.score, got.sort_values("doc_id").score)
    odd = quality.score(docs, labels).toPandas()
    assert len(odd) == docs.count() and odd.score.notna().all() and odd[odd.doc_id.isna()].held_out.all()
    assert quality.score(none, labels).count() == 0
    assert set(quality.score(docs, labels.limit(0)).toPandas().score) == {0.5}


def test_isotonic_is_monotone_and_calibrated():
    centres, values = quality.isotonic(np.array([10, 10, 0, 10]), np.array([1, 5, 0, 3]))
    assert (np.diff(values) >= 0).all() and values[-1] == pytest.approx(8.5 / 21)


# -- 3: near-duplicates ---------------------------------------------------------------------------


def brute_classes(rows):
    from tracewell.llm import shingles as s

    import math

    w = {k: s.word_hashes(t or "") for k, (_, t) in enumerate(rows)}
    grams = {k: [tuple(x[i : i + 5].tolist()) for i in range(max(1, len(x) - 4))] if len(x) else [] for k, x in w.items()}
    df: dict = {}
    for own in grams.values():
        for g in set(own):
            df[g] = df.get(g, 0) + 1
    # Weights from exact counts by their definition, in sixteenths of a binary order.
    weight = {g: 1 + min(14 * 16, round(16 * math.log2(len(rows) / n))) / (2 * 14 * 16) for g, n in df.items()}
    sets = {k: {g: 2 * own.count(g) / (own.count(g) + 1) * weight[g] for g in set(own)} for k, own in grams.items()}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in w:
        for b in range(a):
            shared = sum(min(sets[a][e], sets[b][e]) for e in sets[a].keys() & sets[b].keys())
            if w[a].tobytes() != w[b].tobytes() and not shared:
                continue
            both = sum(sets[a].values()) + sum(sets[b].values()) - shared
            if w[a].tobytes() == w[b].tobytes() or (both and shared >= 0.8 * both - 1e-9):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def test_near_duplicates(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = random.Random(8)
    start = words(rng, 200).split()
    for i in range(40):  # a chain of copies, each a little further from the first
        start = [w if rng.random() > 0.004 else "new%d" % rng.randrange(99) for w in start]
        rows.append((100 + i, " ".join(start)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = brute_classes(rows)
    want = {}
    for (i, _), c in zip(rows, classes):
        want.setdefault(c, []).append(i)
    name = {c: min((i for i in m if i is not None), default=None) for c, m in want.items()}
    got = {(r["doc_id"], r["class_id"], r["kept"]) for r in near_dups.classes(df).collect()}
    assert got == {(i, name[c], i == name[c]) for (i, _), c in zip(rows, classes)}
    kept = near_dups.keep(docs)
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.where("doc_id is not null").collect()]
    assert len(left) == len(set(left)) and 0 in left and 3 not in left and kept.where("doc_id is null").count() == 1
    assert near_dups.classes(none).count() == 0 and near_dups.keep(none).count() == 0
    a, b = words(random.Random(5), 90), words(random.Random(6), 90)
    again = spark.createDataFrame([(1, b), (5, a), (5, b), (5, a + "."), (7, a), (5, a), (9, words(random.Random(7), 90))], "doc_id long, text string")
    left = near_dups.keep(again).collect()
    assert sorted(r["doc_id"] for r in left) == [1, 5, 9] and {r["text"].rstrip(".") for r in left if r["doc_id"] < 9} == {a, b}


def test_blocks_split_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    monkeypatch.setattr(near_dups, "STREAM", 3)
    rng = random.Random(2)
    base = words(rng, 150).split()
    rows = [(i, " ".join(w if k != i else "x%d" % i for k, w in enumerate(base))) for i in range(30)]
    for i in range(60):  # templates: far from each other, with some close pairs among them
        own = [w if rng.random() < 0.93 else "y%d" % rng.randrange(99) for w in base]
        rows += [(100 + 2 * i, " ".join(own)), (101 + 2 * i, " ".join(own[:-2] + ["z"]))]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first: dict = {}
    for (i, _), c in zip(rows, brute_classes(rows)):
        first.setdefault(c, i)
    assert got == {i: first[c] for (i, _), c in zip(rows, brute_classes(rows))}


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(5)
    a, b = words(rng, 100), words(rng, 100)
    near = lambda t: " ".join(t.split()[:-1] + ["end"])
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (3, near(b)), (4, words(rng, 50))]
    got = {(r["doc_id"], r["class_id"]) for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_recall_near_the_threshold(spark):
    """Pairs of a plain weighted similarity of 0.80 to 0.85, of which banding may miss a few."""
    from tracewell.llm import shingles as s

    rng = random.Random(12)
    rows, pairs = [], []
    for k in range(150):
        own = words(rng, 120).split()
        other = list(own)
        for j in rng.sample(range(0, 120, 6), 2):  # each touches five shingles of either text
            other[j] = "changed%d" % k
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        x, y = (set(s.shingles(s.word_hashes(t)).tolist()) for _, t in rows[-2:])
        pairs.append(len(x & y) / len(x | y))
    assert 0.78 < np.mean(pairs) < 0.88
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    linked = [k for k in range(150) if want[2 * k] == want[2 * k + 1]]
    found = [k for k in linked if got[2 * k] == got[2 * k + 1]]
    assert len(linked) > 100 and len(found) >= 0.97 * len(linked) and all(got[2 * k + 1] == 2 * k + 1 for k in range(150) if k not in linked)


def test_samples_estimate_weighted_similarity():
    from tracewell.llm import shingles as s

    rng = np.random.default_rng(0)
    e = rng.integers(0, 1 << 63, 300, dtype="uint64")
    w = rng.random(300).astype("float32") + 0.5
    sampler = s.Sampler(512)
    a, b = slice(0, 220), slice(60, 300)
    true = w[60:220].sum() / w.sum()
    same = (sampler.samples(e[a], w[a]) == sampler.samples(e[b], w[b])).mean()
    assert abs(same - true) < 0.08


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1]}


# -- 4: urls --------------------------------------------------------------------------------------


def test_url_rules(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "example.org", "/es/ok")]
    urls = ["http://A.Example.ORG/es/x?q", "http://example.org/es/ok#f", "http://notexample.org", "https://x.com/a b/c?k=1", None, "no scheme", "://", "http://h?x", "x://y://z/p", "http://org/é\n/q"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(0, urls[0], "x", 1)], "page_id long, url string, host string, fit int")
    labelled = spark.createDataFrame([("http://bad.com/spam/%d" % i, True) for i in range(30)] + [("http://good.com/news/%d" % i, False) for i in range(30)] + [("http://x.com/spam/1", False)] * 2, "url string, bad boolean")
    got = url_rules.judge(pages, labelled, rules, least=12, confidence=0.6).orderBy("page_id").collect()

    def host_path(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        h = re.split(r"[/?#]", rest, maxsplit=1)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in h), re.split(r"[?#]", rest[len(h) :], maxsplit=1)[0]

    assert {(r["page_id"], r["host"], r["path"]) for r in got} == {(i, *host_path(u)) for i, u in enumerate(urls)} and len(got) == len(urls) + 1
    by = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert by[0] == ("example.org/es/", "block") and by[1] == ("example.org/es/ok", "allow") and by[2] == (None, "allow") and by[4] == (None, "allow")
    fresh = spark.createDataFrame([(1, "http://q.net/SPAM/x"), (2, "http://q.net/news/x")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge(fresh, labelled, rules, least=12, confidence=0.6).collect()} == {1: "block", 2: "allow"}
    assert url_rules.judge(fresh, labelled.limit(0), rules).where("verdict = 'block'").count() == 0
    assert url_rules.judge(pages.limit(0), labelled, rules).count() == 0


def test_rules_of_any_length_equal_brute_force(spark):
    from itertools import combinations, product

    urls = [f"http://{h}/{p}?{q}=1" for h, p, q in product(("a", "b"), ("c", "d"), ("e", "f"))]
    labelled = [(u, u == "http://a/c?e=1") for u in urls for _ in range(4)] + [("http://a/c?f=1", False), ("http://a/d?e=1", False), ("http://b/c?e=1", False)]
    tokens = {u: frozenset(f"{k}:{x}" for k, x in zip("hpq", re.findall(r"[a-f](?=[/?=])", u))) for u in urls}
    best: dict = {}
    base = sum(bad for _, bad in labelled) / len(labelled)

    def bound(k, n, z=1.96):
        p = k / n
        return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)

    for n in (1, 2, 3):
        for rule in {frozenset(c) for t in tokens.values() for c in combinations(sorted(t), n)}:
            told = [bad for u, bad in labelled if rule <= tokens[u]]
            if sum(told) >= 3 and sum(told) >= 0.5 * len(told) and bound(sum(told), len(told)) > base:
                for u in urls:
                    if rule <= tokens[u]:
                        best[u] = max(best.get(u, 0), sum(told) / len(told))
    assert best == {"http://a/c?e=1": 1.0}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_rules.judge(pages, spark.createDataFrame(labelled, "url string, bad boolean"), []).collect()
    assert {(urls[r["page_id"]], r["verdict"], r["confidence"]) for r in got} == {(u, "block" if u in best else "allow", best.get(u)) for u in urls}


def test_chance_makes_no_rules(spark):
    rng = random.Random(4)
    urls = [f"http://h{rng.randrange(40)}.com/p{rng.randrange(20)}" for _ in range(3000)]
    rows = [(u, rng.random() < 0.15) for u in urls] + [(f"http://farm.com/x{i}", i % 5 > 0) for i in range(20)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    found = url_rules.mine(labelled, confidence=0.0, z=4.0)[0].collect()
    assert {tuple(r["antecedent"]) for r in found} >= {("h:farm",)} and all("h:farm" in r["antecedent"] for r in found)
    assert [(r["bad"], r["n"]) for r in found if r["rule_id"] == "h:farm"] == [(16, 20)]


def test_tokens_of_the_same_urls_are_one_item(spark):
    """A bad url of thirty tokens is one rule at most, and urls with any of them are blocked as by the 2^30 single rules."""
    odd = "http://bad.example/?" + "&".join(f"k{i}=1" for i in range(30))
    rows = [(odd, True)] * 3 + [(f"http://fine.org/p{i}", i % 7 == 0) for i in range(60)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules, items = url_rules.mine(labelled)
    assert rules.count() == 1 and items.where("item = 'h:bad'").count() == 32
    asked = [odd, "http://else.com/?k7=2", "http://else.com/k7", "http://fine.org/p1", "http://bad.net/", None]
    got = {r["url"] for r in url_rules.fired(spark.createDataFrame([(u,) for u in asked], "url string"), rules, items).collect()}
    assert got == {odd, "http://else.com/?k7=2", "http://bad.net/"}


def test_verdicts_equal_all_subsets(spark):
    """Against mining every subset of tokens by definition, with the best confidence of all that fire."""
    from itertools import combinations

    rng = random.Random(31)
    url = lambda: "http://" + rng.choice("abc") + ".x/" + "/".join(rng.choice("pqrs") for _ in range(rng.randint(0, 3))) + "?" + "&".join(rng.sample(["k", "l", "m", "n"], rng.randint(0, 3)))
    rows = [(u, hash_bad) for u in (url() for _ in range(300)) for hash_bad in [("/q" in u and "k" in u) or rng.random() < 0.1]]
    asked = sorted({url() for _ in range(200)})

    def held(u):
        h, rest = u[7:].split("/", 1)
        path, query = rest.split("?")
        return {f"h:{x}" for x in h.split(".")} | {f"p:{x}" for x in path.split("/") if x} | {f"q:{x}" for x in query.split("&") if x}

    bags, total, bad = [(held(u), b) for u, b in rows], len(rows), sum(b for _, b in rows)
    best: dict = {}
    for chosen in {c for h, b in bags if b for k in range(1, len(h) + 1) for c in combinations(sorted(h), k)}:
        hits, n = sum(b for h, b in bags if h >= set(chosen)), sum(h >= set(chosen) for h, _ in bags)
        p, z = hits / n, 1.96
        low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if hits >= 3 and p >= 0.5 and round(low, 12) > round(bad / total, 12):
            best[chosen] = p
    want = {u: max(c for k, c in best.items() if held(u) >= set(k)) for u in asked if any(held(u) >= set(k) for k in best)}
    rules, items = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    got = url_rules.fired(spark.createDataFrame([(u,) for u in asked], "url string"), rules, items)
    assert {r["url"]: r["confidence"] for r in got.collect()} == want and 0 < len(want) < len(asked)
    assert rules.count() < len(best)


# -- 5: archives ----------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    big, other = "<p>" + "x" * 1500, "é" * 700
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (9, "http://c", big), (3, "u", other), (4, "u", other), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (None, "u", other), (9, "http://c", big)]
    pages = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, digest string, salt string").repartition(3)
    folder = "file://" + str(tmp_path / "warc")
    index = archives.write(archives.classify(pages), folder, frame_bytes=2000)
    got = archives.read(index).collect()
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    want = sorted(((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if best.get(h, i) != i else "response", best[h] if best.get(h, i) != i else None) for i, _, h in rows), key=str)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want
    assert all(bytes(r["payload"]).decode() in {h or "" for _, _, h in rows} for r in got if r["record_type"] == "response")
    at = index.where("page_id = 5").first()
    reader = archives.BundleReader(at["bundle"])
    fields, head, payload, _ = reader.record(at["frame"], at["offset"])
    assert fields["WARC-Record-ID"] == f"<{at['record_id']}>" and at["record_id"].startswith("urn:page:5:") and payload == b"small" and b"Content-Length: 5" in head
    assert index.select("record_id").distinct().count() == index.count() == len(rows)
    assert archives.read(index).rdd.getNumPartitions() == index.select("bundle", "frame").distinct().count()
    assert archives.parse(reader.frame(0))[0]["WARC-Type"] == "warcinfo"
    import zstandard

    raw = open(at["bundle"].removeprefix("file://"), "rb").read()
    assert b"WARC/1.1" in zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert archives.read(archives.write(archives.classify(pages.limit(0)))).count() == 0


# -- 6: personal data -----------------------------------------------------------------------------


def brute_spans(text):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(d):
        return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(patterns) for m in re.finditer(p, text or "") if good(kind, m[0])]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


PARTS = ["a@b.co", "\x01", "x_y@z", "a@b.c_d@e.f", "a@b.com.d@e.f.g", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.0004", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "79927398713", "+1 (017) 555-7713", "+4 9", "+12345678901234567", "+1--2()3.4567890 1.2.3.4", "é😀", " ", ",", "a", "7", "-", ".", "@", "+", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "9807915762804490 4845168114407329"]


def test_private_data(spark, docs, none):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(PARTS) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [(1000, "1" * 20000), (1001, "a." * 9000 + "@" + "b." * 9000 + "c"), (1002, "12, " * 20000), (1003, None), (1004, ""), (None, "a@b.co"), (1, rows[1][1])]
    got = private_data.spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", private_data.listed("base").alias("base"), private_data.listed("spans").alias("spans")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        assert by[i]["base"] == ",".join(brute_spans(t)), t
        assert set(filter(None, by[i]["base"].split(","))) <= set(by[i]["spans"].split(","))
    assert any("secret:" in r["spans"] for r in got)
    clean = private_data.redact(docs.withColumn("text", F.when(F.col("doc_id") == 1, "mail a@b.co, é +1 (017) 555-7713.").otherwise(F.col("text"))))
    assert clean.columns == docs.columns
    r = clean.where("doc_id = 1").first()
    assert r["text"] == "mail [EMAIL], é [PHONE]." and r["n_chars"] == len(r["text"]) and r["base"] == "b" and r["row"] == "r"
    assert clean.where("text is null").count() == docs.where("text is null").count()
    assert private_data.spans(none).count() == 0 and private_data.redact(none).count() == 0


def brute_candidates(text):
    """(start, end, features) of each candidate, by their definition."""
    hexes, keys = r"[0-9A-Fa-f]{32,}(?![0-9A-Za-z])", r"[A-Za-z0-9_-]{20,}"
    account_no = r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
    parted = r"[0-9]{2,5}(?:[ .-][0-9]{2,5}){2,5}(?![0-9A-Za-z])"
    pattern = rf"(?<![0-9A-Za-z_-])(?:{hexes}|{account_no}|[0-9]{{9,}}(?![0-9A-Za-z])|{parted}|{keys})"
    taken = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(text)]
    last, out = 0, []
    found = list(re.finditer(pattern, text))

    def luhn(d):
        return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    def digits_97(v):
        bare = v.replace(" ", "").upper()
        return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1

    for k, m in enumerate(found):
        v, before, after = m[0], text[last : m.start()][-24:], text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)][:2]
        last = m.end()
        if re.fullmatch(keys, v) and not re.fullmatch(r"[0-9A-Fa-f]{32,}|[0-9]+", v) and not all(re.search(x, v) for x in ("[0-9]", "[A-Z]", "[a-z]")):
            continue
        if any(s < m.end() and m.start() < e for s, e in taken):
            continue
        form = 0 if v.isdigit() else 1 if re.fullmatch(r"[0-9][0-9 .-]*", v) else 2 if re.fullmatch(r"[A-Z]{2}[0-9]{2}[0-9A-Z ]+", v) and len(v) < 43 else 3 if re.fullmatch(r"[0-9A-Fa-f]+", v) else 4
        shape = [lambda: 14 <= len(v) <= 19 and luhn(v), lambda: bool(re.fullmatch(r"\d{3}-\d\d-\d{4}|\d{3}([ .-])\d{3}\1\d{4}", v)), lambda: digits_97(v), lambda: bool(re.search("[0-9]", v) and re.search("[A-Fa-f]", v)) and len(v) in (32, 40, 64, 128), lambda: len(set(v)) > 13][form]()
        prefix = form == 0 and bool(re.match(private_data.ISSUERS, v)) and len(v) in (15, 16) or form == 4 and bool(re.match(private_data.KEY_STARTS, v))
        context = bool(re.search(r"[=:#]\s*[\"']?$", before) or re.search(r"[\"'(<]$", before) and re.search(r"^[\"')>]", after))
        size = 0 if len(v) < 14 else 1 if len(v) < 20 else 2 if len(v) < 40 else 3
        out.append((m.start(), m.end(), {"v0": int(shape), "v1": int(bool(re.search(private_data.CUES, before, re.ASCII)) or prefix), "v2": int(context), "form": form, "size": size}))
    return out


SECRETS = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE00370400440532013000", "123-45-6789", "555.123.4567", "2024-01-15", "sk-Abc123Def456Ghi789Jkl", "aB3" * 9, "lower_case_only_words_here_1", "f" * 31 + "7", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "0a" * 200, "1" * 50]


def test_added_spans_equal_brute_force(spark):
    rng = random.Random(16)
    around = ["", "key: ", "SSN ", "iban=", "(", "see ", "id # ", "tel: ", "x"]
    rows = [(i, " ".join(rng.choice(around) + rng.choice([*SECRETS, *PARTS, words(rng, 3)]) + rng.choice(["", ")", ",", "é"]) for _ in range(rng.randint(0, 8)))) for i in range(300)]
    rows += [(900, "a@b.co " * 700), (901, ("123-45-6789 x " * 400)), (902, "z" * 30000 + " key=" + "aB3" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = private_data.train(private_data._found(df.withColumn("body", F.coalesce("text", F.lit("")))))
    got = {r["doc_id"]: r["spans"] for r in private_data.spans(df).select("doc_id", private_data.listed("spans").alias("spans")).collect()}
    added = 0
    for i, t in rows:
        own = [(s, 4 + (f["form"] < 3), e, "number" if f["form"] < 3 else "secret") for s, e, f in brute_candidates(t) if model["bias"] + sum(model["weights"][n, f[n]] for n in private_data.NAMES) >= -1e-12]
        base = [(int(s), private_data.KINDS.index(k), int(e), k) for k, s, e in (x.split(":") for x in brute_spans(t))]
        assert got[i] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(base + own)), t
        added += len(own)
    assert added > 100


def test_em_finds_the_reliable_labelers():
    counts = {(1, 1, 1): 400, (1, 1, 0): 100, (0, 0, 1): 60, (0, 0, 0): 440, (1, 0, 0): 10, (0, 1, 1): 10}
    prior, rates, posterior = private_data.expectation_maximisation(counts)
    assert posterior[1, 1, 0] > 0.9 > 0.1 > posterior[0, 0, 1] and 0.4 < prior < 0.6


# -- 7: decontamination ---------------------------------------------------------------------------


def test_decontamination(spark, docs, none):
    rng = random.Random(9)
    items = [(i, words(rng, 40)) for i in range(5)] + [(8, words(rng, 7)), (9, "too short here"), (10, None), (11, "")]
    sub = items[2][1].split()
    for i in range(3, 40, 6):
        sub[i] = "other"
    rows = [(0, words(rng, 50) + " " + items[0][1] + " " + words(rng, 50)), (1, items[1][1].upper() + "!"), (2, " ".join(sub)), (3, words(rng, 200)), (4, "pre " + items[8 - 3][1] + " post"), (5, " ".join(items[3][1].split()[10:30])), (6, " ".join(items[4][1].split()[:9])), (7, None), (8, items[0][1] + " " + items[1][1])]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(df, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (4, 8), (5, 3), (8, 0), (8, 1)}
    r = decontaminate.overlaps(df, bench).where("doc_id = 0").first()
    assert (r["doc_start"], r["doc_end"], r["item_start"], r["item_end"], r["equal_words"]) == (50, 90, 0, 40, 40)
    assert {r["doc_id"] for r in decontaminate.clean(df, bench).collect()} == {3, 6, 7}
    assert decontaminate.clean(docs, bench).columns == docs.columns and decontaminate.clean(docs, bench).count() == docs.count()
    assert decontaminate.overlaps(none, bench).count() == 0 and decontaminate.overlaps(df, bench.limit(0)).count() == 0


def test_altered_short_items_are_verified_whole():
    from tracewell.llm.shingles import word_hashes

    rng = random.Random(31)
    hit = missed = 0
    for n in range(13, 21):
        for changed in (1, 2, 3):
            for _ in range(30):
                item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
                copy = list(item)
                for j in rng.sample(range(n), changed):
                    copy[j] = "other"
                text = " ".join(["before"] * 9 + copy + ["after"] * 9)
                seeds = decontaminate.Seeds([(1, " ".join(item))])
                own, doc = word_hashes(" ".join(item)), word_hashes(text)
                whole = lambda d: [own[j] == doc[j + d] if 0 <= j + d < len(doc) else None for j in range(n)]
                want = False
                for _, d in seeds.hits(doc):
                    same = [x for x in whole(d) if x is not None]
                    want |= any(sum(same[s:e]) * 5 >= (e - s) * 4 for s in range(len(same)) for e in range(s + 13, len(same) + 1))
                got = seeds.overlaps(text, 13, 0.8)
                assert bool(got) == want
                for _, ds, de, s, e, equal, _ in got:
                    assert de - ds == e - s >= 13 and equal == sum(own[j] == doc[j + ds - s] for j in range(s, e)) and equal * 5 >= (e - s) * 4
                if (n - changed) * 5 >= n * 4:
                    hit, missed = hit + bool(got), missed + (not got)
    assert missed < 0.1 * (hit + missed)  # by the seeds


def test_large_benchmarks_are_joined(spark, docs, monkeypatch):
    rng = random.Random(9)
    items = [(i, words(rng, rng.choice((2, 3, 9, 20, 30)))) for i in range(30)] + [(30, None), (31, "")]
    rows = []
    for i, t in items:
        own = (t or "").split()
        for j in range(5, len(own), 9):
            own[j] = "other"
        rows += [(100 + i, words(rng, 9) + " " + " ".join(own) + " " + words(rng, 9)), (None, t), (200 + i, words(rng, 30))]
    bench = spark.createDataFrame(items + items[:4], "item_id long, text string")
    df = docs.select("doc_id", "text", "lang", "part").union(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x'", "1L")).withColumnRenamed("part", "th")
    key = ["doc_id", "item_id", "doc_start", "doc_end", "item_start", "item_end", "equal_words"]
    small, kept = sorted(map(str, decontaminate.overlaps(df, bench).select(key).collect())), decontaminate.clean(df, bench).count()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert sorted(map(str, decontaminate.overlaps(df, bench).select(key).collect())) == small and len(small) >= 60
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and left.count() == kept < df.count()
    # Passages that occur twice, exactly and changed: the first one is reported either way.
    passage = words(rng, 30).split()
    changed = [w if j not in (9, 20) else "other" for j, w in enumerate(passage)]
    twice = [(i, " ".join([*words(rng, rng.randint(0, 9)).split(), *x, *words(rng, 7).split(), *y, *words(rng, 3).split()])) for i, (x, y) in enumerate([(passage, passage), (changed, passage), (passage, changed), (changed, changed)] * 5)]
    df, bench = spark.createDataFrame(twice, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(passage + passage[:13]))], "item_id long, text string")
    joined = sorted(map(str, decontaminate.overlaps(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1_000_000)
    rows = decontaminate.overlaps(df, bench).collect()
    assert sorted(map(str, rows)) == joined and len(rows) == 40
    for r in rows:
        if r["item_id"] == 1 and r["doc_id"] % 4 == 0:
            assert r["doc_start"] == twice[r["doc_id"]][1].split().index(passage[0]) and r["equal_words"] == 30


def test_a_long_text_without_blanks_is_joined(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    bench = spark.createDataFrame([(1, "x" * 5000)], "item_id long, text string")
    asked = []
    monkeypatch.setattr(decontaminate, "_joined", lambda *a: asked.append(a) or spark.createDataFrame([], decontaminate.OVERLAP))
    decontaminate.overlaps(bench.withColumnRenamed("item_id", "doc_id"), bench)
    assert asked


def test_overlaps_by_definition(spark):
    """Truth without the module's alignment: a mask's looked-at words agree somewhere on a diagonal, and a stretch of it of the
    least length or more has the similarity."""
    rng = random.Random(23)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice((4, 13, 16, 24)))) for i in range(10)]
    docs_ = []
    for i in range(60):
        own = list(items[i % 10][1])
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = "other"
        docs_.append((i, text(rng.randrange(12)) + own[rng.randrange(2) :] + text(rng.randrange(12))))
    want = set()
    for i, d in docs_:
        for j, b in items:
            masks = decontaminate.MASKS if len(b) >= max(map(len, decontaminate.MASKS)) else (*decontaminate.MASKS, "1" * len(b))
            for diagonal in range(-len(b) + 1, len(d)):
                same = [0 <= k + diagonal < len(d) and b[k] == d[k + diagonal] for k in range(len(b))]
                inside = [k for k in range(len(b)) if 0 <= k + diagonal < len(d)]
                seeds = (all(same[p + k] for k, c in enumerate(m) if c == "1") for m in masks for p in range(len(b) - len(m) + 1))
                need = min(13, len(b))
                if any(seeds) and any(sum(same[x : y + 1]) * 5 >= (y + 1 - x) * 4 for x in inside for y in inside if y + 1 - x >= need):
                    want.add((i, j))
    bench = spark.createDataFrame([(i, " ".join(b)) for i, b in items], "item_id long, text string")
    got = decontaminate.overlaps(spark.createDataFrame([(i, " ".join(d)) for i, d in docs_], "doc_id long, text string"), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) >= 20


def test_overlaps_equal_brute_force(spark):
    """All diagonals of all pairs; items of thirteen words or more that keep a run of five words are never missed."""
    from tracewell.llm.shingles import word_hashes

    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice((3, 8, 15, 30)))) for i in range(12)]
    docs_ = []
    for i in range(40):
        own = list(items[i % 12][1])
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = "other"
        docs_.append((i, text(rng.randrange(20)) + own[rng.randrange(2) :] + text(rng.randrange(20))))
    want, sure = set(), set()
    for i, d in docs_:
        for j, b in items:
            x, y = word_hashes(" ".join(b)), word_hashes(" ".join(d))
            for diagonal in range(-len(b) + 1, len(d)):
                if found := decontaminate.aligned(x, y, diagonal, 13, 0.8):
                    want.add((i, j))
                    same = x[found[2] : found[3]] == y[found[0] : found[1]]
                    if len(b) >= 15 and "1" * 12 in "".join("01"[int(v)] for v in same) or (len(b) < 12 and same.all()):
                        sure.add((i, j))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(spark.createDataFrame([(i, " ".join(d)) for i, d in docs_], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(b)) for i, b in items], "item_id long, text string")).collect()}
    assert sure <= got <= want and len(got) >= 0.95 * len([p for p in want if len(items[p[1]][1]) >= 15 or p in sure])


# -- 8: token files -------------------------------------------------------------------------------


def test_token_files(docs, none):
    manifest = token_files.write(docs, WORD, length=64, rows=4)
    got = token_files.read(manifest).collect()
    assert len(got) == docs.count()
    rows = docs.withColumn("at", F.monotonically_increasing_id()).collect()
    order = [(k, i, t) for k, i, _, t in sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["at"], r["text"] or "") for r in rows)]
    start = 0
    for (known, i, text), r in zip(order, sorted(got, key=lambda r: (r["start"]))):
        want = np.array(ids(WORD, text), "<u4")
        assert (r["doc_id"], r["start"], bytes(r["ids"])) == (i if known else None, start, want.tobytes())
        start += len(want)
    reader = token_files.ShardReader(manifest.orderBy("part").first()["path"])
    seq, mask = reader.sequence(0)
    assert len(seq) == len(mask) == 64 and seq.dtype == np.uint16 and mask.slice(0, 5).true_count == 5
    assert not seq.flags.owndata and mask.buffers()[1].size >= 8  # bits of the file, not a copy
    last = reader.sequence(sum(reader.file.get_batch(k).num_rows for k in range(reader.batches)) - 1)[1]
    assert last.true_count == (manifest.orderBy("part").first()["tokens"] - 1) % 64 + 1
    with pytest.raises(ValueError):
        reader.tokens(manifest.orderBy("part").first()["tokens"], 1)
    assert token_files.read(token_files.write(none, WORD)).count() == 0


def test_a_small_file_is_small(spark):
    from tracewell.llm.common import filesystem

    manifest = token_files.write(spark.createDataFrame([(1, "short")], "doc_id long, text string"), WORD)
    fs, path = filesystem(manifest.first()["path"])
    reader = token_files.ShardReader(manifest.first()["path"])
    assert fs.get_file_info(path).size < 20_000 and reader.schema_of_mask() == "fixed_size_list<item: bool>[1024]"


def test_one_doc_id_fills_many_files(spark):
    df = spark.createDataFrame([(7, f"text {i}") for i in range(400)] + [(None, "x")] * 200, "doc_id long, text string").repartition(6)
    manifest = token_files.write(df, WORD)
    assert manifest.count() > 3 and manifest.agg(F.max("documents")).first()[0] < 400
    assert sorted(r["start"] for r in token_files.read(manifest).collect())[0] == 0


# -- 9: embeddings --------------------------------------------------------------------------------


def test_groups_of_pairs():
    rng = np.random.default_rng(2)
    for n in (2, 30, 200):
        a, b = rng.integers(0, n, (2, n // 2))
        label = vectors.grouped(n, a, b)
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(a, b):
                want[x] = want[y] = min(want[x], want[y])
        assert (label == want).all()


@pytest.mark.parametrize(("block", "kind"), [(1024, "double"), (8, "double"), (8, "float")])
def test_vectors(spark, monkeypatch, block, kind):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(12):
        c = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            rows.append((n, (c + 0.09 * rng.standard_normal(16)).tolist(), int(g % 3), "z"))
            n += 1
    rows += [(n + k, rows[0][1], rows[0][2], "z") for k in range(30)]
    n = len(rows)
    rows += [(n, None, 1, "z"), (n + 1, [0.0] * 16, 1, "z"), (n + 2, [float("nan")] * 16, 1, "z"), (n + 3, [None] * 16, 1, "z"), (n + 4, rows[0][1], None, "z"), (n + 5, [], 1, "z"), (n + 6, [float("inf")] + [1.0] * 15, 1, "z"), (n + 7, [1e-300] * 16, 1, "z"), (n + 8, [1e300] * 16, 1, "z"), (n + 9, [1.0] * 3, 1, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, copies string").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    rows = [tuple(r) for r in df.collect()]
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = {r[0]: np.array(r[1]) / np.abs(r[1]).max() for r in ok}
    links = {r[0]: set() for r in rows}
    for a in ok:
        for b in ok:
            x, y = unit[a[0]], unit[b[0]]
            if a[0] != b[0] and a[2] == b[2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a[0]].add(b[0])
    comp = {i: i for i in links}
    for _ in links:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in links}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.link(df).collect()}
    assert got == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}
    assert vectors.link(df.limit(0)).count() == 0


# -- 10: suffix arrays ----------------------------------------------------------------------------


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_removed(rows):
    seen: dict[bytes, int] = {}
    order = sorted({(i is None, i or 0) for i, _ in rows})
    out = {}
    first: dict[bytes, tuple] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w, key = b[p : p + 50], (i is None, i or 0)
            first[w] = min(first.get(w, key), key)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (i is None, i or 0):
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, "uint8")[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.setdefault(i, set()).add((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert order is not None and seen == {}
    return out


def test_verbatim(spark, docs, none, monkeypatch):
    monkeypatch.setattr(verbatim, "CHUNK", 700)
    rng = random.Random(12)
    passage = words(rng, 30)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i in range(40):
        a = rng.randrange(len(passage) - 90)
        rows.append((200 + i, words(rng, rng.randint(0, 30)) + passage[a : a + rng.randint(45, 140)] + words(rng, rng.randint(0, 30))))
    rows += [(300, "ab" * 200), (301, "ba" * 100 + "c"), (302, "\0" * 120), (303, "\0" * 60), (304, "é漢" * 40), (305, "x" + "é漢" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = verbatim.remove(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"), "removed").collect()
    assert len(got) == len(rows)
    mine: dict = {}
    for r in got:
        mine.setdefault(r["doc_id"], set()).add((r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]))
        assert r["n_removed"] == sum(x["end"] - x["start"] for x in r["removed"])
    assert mine == brute_removed(rows)
    assert verbatim.remove(none).count() == 0


def test_verbatim_templated_rows(spark):
    rng = random.Random(21)
    fields = rng.sample(range(100_000, 1_000_000), 300)
    before, after = "station report, the meter reads now ", " units, checked and signed by the desk.\n"
    rows = [(1, "".join(f"{before}{x}{after}" for x in fields))]
    rows += [(2 + i, words(rng, 8) + before[-24:] + str(x) + after[:24] + words(rng, 8)) for i, x in enumerate(rng.sample(fields, 100))]
    got = verbatim.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    assert {r["doc_id"]: {tuple(r)[1:]} for r in got} == brute_removed(rows)


# -- very long texts ------------------------------------------------------------------------------


def test_texts_of_megabytes(spark):
    rng = random.Random(30)
    big = words(rng, 220_000).split()
    near = list(big)
    for j in rng.sample(range(len(near)), 300):
        near[j] = "other"
    big, near = " ".join(big), " ".join(near) + " mail a@b.co"
    assert len(big) > 1_000_000
    df = spark.createDataFrame([(1, big), (2, near), (3, "small")], "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["class_id"]) for r in near_dups.classes(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    pieces = packing.pack(df, BYTE, 1024).toPandas()
    want = {i: len(ids(BYTE, t)) for i, t in ((1, big), (2, near), (3, "small"))}
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == want and pieces["length"].max() == 1024
    read = {r["doc_id"]: zlib.crc32(bytes(r["ids"])) for r in token_files.read(token_files.write(df, WORD)).collect()}
    assert read[1] == zlib.crc32(np.array(ids(WORD, big), "<u4").tobytes())
    gone = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in verbatim.remove(df).collect()}
    assert gone[1][1] == 0 and 0.8 * gone[2][0] < gone[2][1] < gone[2][0]
    spans = {r["doc_id"]: r["s"] for r in private_data.spans(df).select("doc_id", private_data.listed("base").alias("s")).collect()}
    assert spans == {1: "", 2: f"email:{len(near) - 6}:{len(near)}", 3: ""}
    item = " ".join(big.split()[-40:])
    hits = decontaminate.overlaps(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} >= {(1, 7)} and all(r["doc_start"] > 200_000 for r in hits)
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://a/").alias("url"), F.col("text").alias("html"))
    back = {r["page_id"]: len(r["payload"]) for r in archives.read(archives.write(archives.classify(pages))).collect()}
    assert back == {1: len(big), 2: len(near), 3: 5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 4)], "doc_id long, quality int")
    assert quality.score(df, labels).where("score between 0 and 1").count() == 3
    url = "http://h.com/" + "x/" * 500_000
    judged = url_rules.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), spark.createDataFrame([], "url string, bad boolean"), [("block", "com", "/x/")]).first()
    assert judged["verdict"] == "block" and len(judged["path"]) == len(url) - 12


# -- shared ---------------------------------------------------------------------------------------


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(3), "x")
    assert df.count() == 3 and all(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") in f for f in df.inputFiles())
