"""Word shingles as weighted sets, and consistent weighted samples of them.

Words are compared in lower case without marks at their edges. A shingle is five words in a row (a shorter text is one
shingle). Its weight is a saturating term frequency, 2 n / (n + 1) for n occurrences, times an inverse document frequency.

Inverse document frequencies are 1 + ln(1 / s) / (2 ln(1 / FLOOR)) for a shingle in a share s of all documents, FLOOR at
least: 1 for what all documents hold, 1.5 for what at most one in 16,384 does. So they depend on shares alone and are alike
at every size of a corpus. Frequent passages count for less, but near copies of a text that a third of all documents hold
stay near. Documents are counted in 2^24 hash buckets, all of them. Other shingles that fall into a bucket add a share of
(distinct shingles a document) / 2^24 on average, again whatever the corpus holds: up to a thousand shingles a document that
lies below FLOOR, where shares aren't told apart anyway. A table of one byte a bucket holds the share in sixteenths of a
binary order of magnitude.
"""

from __future__ import annotations

WIDTH = 5
BUCKETS = 1 << 24
#: The least share of documents that is told apart, as a power of two, and steps of an order of magnitude.
OCTAVES, STEPS = 14, 16
POOL = 1 << 16

_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¡¿"


class _Words(dict):
    """Word to 64-bit hash; normalises each spelling once."""

    def __missing__(self, raw: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        word = raw.lower()
        h = xxhash.xxh64_intdigest((word.strip(_MARKS) or word).encode("utf-8", "surrogatepass"))
        self[raw] = h
        return h


_words = _Words()


def word_hashes(text: str):
    """64-bit hashes of the words of a whole text."""
    import numpy as np

    words = text.split()
    return np.fromiter(map(_words.__getitem__, words), dtype="uint64", count=len(words))


def mix(x):
    """A bijective scrambling of 64-bit integers."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words):
    """Hashes of the shingles of a text, in order."""
    import numpy as np

    width = min(WIDTH, len(words))
    if width == 0:
        return words
    n = len(words) - width + 1
    h = np.full(n, np.uint64(width), "uint64")
    with np.errstate(over="ignore"):
        for i in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(h)


def bucket(h):
    """The document-frequency bucket of a shingle."""
    import numpy as np

    return (h >> np.uint64(40)).astype("int64")


def elements(h):
    """(distinct shingles in order, saturating term frequency of each)."""
    import numpy as np

    e, n = np.unique(h, return_counts=True)
    return e, (2 * n / (n + 1.0)).astype("float32")


def levels(df, n: int):
    """Shares by bucket as bytes, from document frequencies and the number of documents: 0 for all documents."""
    import numpy as np

    orders = np.log2(max(1, n) / np.maximum(1, df))
    return np.round(np.clip(orders, 0, OCTAVES) * STEPS).astype("uint8")


def weights(levels_, h):
    """Inverse document frequencies of shingles."""
    import numpy as np

    return _WEIGHT[levels_[bucket(h)]] if len(h) else np.zeros(0, "float32")


def _weight_table():
    import numpy as np

    return (1 + np.arange(256) / (2 * OCTAVES * STEPS)).astype("float32")


_WEIGHT = _weight_table()


class Sampler:
    """Improved consistent weighted sampling: k samples of a weighted set, equal for two sets in each place with a
    probability of their weighted Jaccard similarity. The variates r, c ~ Gamma(2, 1) and beta ~ U(0, 1) of an element
    and place come from a fixed pool of 65,536 that a hash of both addresses; where a very long text has two elements on
    one of them, the smaller hash goes first in every text."""

    def __init__(self, k: int, seed: int = 11):
        import numpy as np

        rng = np.random.default_rng(seed)
        r, c, beta = rng.gamma(2.0, 1.0, POOL), rng.gamma(2.0, 1.0, POOL), rng.random(POOL)
        self.k = k
        self.r, self.beta, self.inverse = (x.astype("float32") for x in (r, beta, 1 / r))
        self.base = (np.log(c) - r + r * beta).astype("float32")  # ln a = base - r * t
        self.odd = rng.integers(0, 1 << 63, k, dtype="uint64") | np.uint64(1)

    def samples(self, e, w):
        """64-bit sample for each place."""
        import numpy as np

        lw = np.log(w)
        best, sample = np.full(self.k, np.inf, "float32"), np.zeros(self.k, "uint64")
        with np.errstate(over="ignore"):
            for at in range(0, len(e), 2048):
                own = e[at : at + 2048]
                i = ((own[None, :] * self.odd[:, None]) >> np.uint64(48)).astype("intp")
                t = np.floor(lw[None, at : at + 2048] * self.inverse[i] + self.beta[i])
                a = self.base[i] - self.r[i] * t
                j = a.argmin(axis=1)
                rows = np.arange(self.k)
                less = a[rows, j] < best
                best = np.where(less, a[rows, j], best)
                sample = np.where(less, mix(own[j] + t[rows, j].astype("int64").astype("uint64") * np.uint64(0x9E3779B97F4A7C15)), sample)
        return sample
