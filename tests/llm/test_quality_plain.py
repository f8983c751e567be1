"""The quality classifier against a plain version: statistics by definition, all rows in one matrix, isotonic regression by its
greatest-lower-mean formula."""

import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

from tracewell.llm import quality


def plain_statistics(text):
    raw, words, lines = text.encode("utf-8"), text.split(), [x for x in text.split("\n") if x]
    n, k = max(1, len(raw)), max(1, len(words))
    share = lambda chars: sum(b in chars for b in raw) / n
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    tally = Counter(words)
    shares = [c / n for c in Counter(raw).values()]
    return [
        math.log1p(len(text)), math.log1p(len(words)), min(40, mean), min(40, math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes))),
        len(tally) / k, max(tally.values(), default=0) / k, share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"\t\n\r "), share(b".,;:"),
        share(b"!?"), share(b"#$%&*@^~|+="), share(b"<>{}[]\\/_"), sum(b > 127 for b in raw) / n, math.log1p(len(words) / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)), 1 - sum(map(len, set(lines))) / max(1, sum(map(len, lines))), sum(s > 20 for s in sizes) / len(sizes),
        -sum(p * math.log2(p) for p in shares), (len(set(zip(raw, raw[1:]))) or 1) / (math.sqrt(n) * 16), sum(w[0].isupper() for w in words) / k,
        sum(w[-1] in ".,!?" for w in words) / k, sum(a == b for a, b in zip(words, words[1:])) / k,
    ]


def plain_scores(texts, labels, ridge=1e-2):
    """Scores by doc_id, from {doc_id: text} and [(doc_id, label)]."""
    x = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    seen = [(i, y) for i, y in labels if i in texts and fold[i]]
    learnt = np.array([x[i] for i, _ in seen])
    mean, scale = learnt.mean(0), np.maximum(1e-6, learnt.std(0))
    rng = np.random.default_rng(quality.SEED)
    w = rng.standard_normal((len(mean), quality.WAVES)) / math.sqrt(len(mean))
    phase = rng.random(quality.WAVES) * 2 * math.pi
    wave = lambda i: np.append(math.sqrt(2 / quality.WAVES) * np.cos(np.clip((x[i] - mean) / scale, -6, 6) @ w + phase), 1)
    z = np.array([wave(i) for i, _ in seen if fold[i] < 4])
    y = np.array([v for i, v in seen if fold[i] < 4], "float64")
    # Ridge as least squares with a row more for each coefficient.
    root = math.sqrt(ridge * max(1, len(z)) / z.shape[1])
    beta = np.linalg.lstsq(np.vstack([z, root * np.eye(z.shape[1])]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    score = {i: float(wave(i) @ beta) for i in texts}
    cells = {}
    for i, v in seen:
        if fold[i] == 4:
            k = min(quality.BINS - 1, max(0, int((score[i] + 0.5) / 2 * quality.BINS)))
            n, h = cells.get(k, (0, 0))
            cells[k] = (n + 1, h + v)
    ks = sorted(cells)

    def rate(a, b):
        return Fraction(sum(cells[k][1] for k in ks[a:b + 1]), sum(cells[k][0] for k in ks[a:b + 1]))

    level = [max(min(rate(a, b) for b in range(i, len(ks))) for a in range(i + 1)) for i in range(len(ks))]
    blocks = {}
    for k, v in zip(ks, level):
        blocks.setdefault(v, []).append(k)
    curve = []
    for _, members in sorted(blocks.items()):
        n, h = sum(cells[k][0] for k in members), sum(cells[k][1] for k in members)
        centre = sum(k * cells[k][0] for k in members) / n
        curve.append(((centre + 0.5) / quality.BINS * 2 - 0.5, (h + 0.5) / (n + 1)))
    at, values = zip(*curve)
    values = np.maximum.accumulate(values)
    return {i: min(1, max(0, 0.999 * np.interp(s, at, values) + 0.001 / (1 + math.exp(-4 * (s - 0.5))))) for i, s in score.items()}


def test_scores_equal_the_plain_version(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choices("abcdeghilmnorstuéß", k=rng.randint(1, 12))) for _ in range(300)]

    def text(good):
        words = [rng.choice(vocabulary[: 300 if good else 40]) for _ in range(rng.randint(0, 120))]
        if rng.random() < (0.2 if good else 0.7):
            words = [w.upper() + rng.choice(["!!", "#", " 12", ""]) for w in words]
        return "".join(w + rng.choice([" ", " ", ". ", "\n", "\n\n"]) for w in words)

    # Labels are wrong now and then, so that the isotonic curve has blocks to pool.
    texts = {i: text(i % 3 > 0) for i in range(500)} | {500: "", 501: "x", 502: "word " * 30_000, 503: "same\n" * 50, 504: "　  é"}
    labels = [(i, int((i % 3 > 0) != (rng.random() < 0.15))) for i in range(505)] + [(7, 0), (8, 1), (9999, 1)]
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    got = quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = plain_scores(texts, labels)
    assert len(got) == len(texts) and {r["doc_id"] for r in got} == set(texts)
    assert max(abs(r["score"] - want[r["doc_id"]]) for r in got) < 1e-6
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert 0 < sum(r["predicted"] for r in got) < len(got)
