"""Byte-level BPE as a streaming transducer with bounded lookahead, and back to text with a state machine.

Encoding. A text is cut into words as the vocabulary's pre-tokenizer cuts it, and each word's bytes are merged in order of
rank. A word may be of any length, so its bytes pass a window: after a run of merges over what has been read, a boundary
between two tokens is final if it lies at least `lookahead` bytes before the end, whatever follows. Tokens up to the last
such boundary are emitted and forgotten. No merge ever crosses a final boundary, so what is left is merged on its own and
memory is constant.

The lookahead comes from the merge list alone. Let two texts begin with the same n bytes, and let b be the leftmost boundary
that one of them has and the other hasn't after some merges. A merge (A, B) moves b to the left only by joining A and B
before b in one of them, where B reaches b. Either the end of the common bytes lies in B: then b moves by at most |B|. Or an
earlier merge (A', B') has made the difference: at the end of B, in which case A' is on the right spine of B and was joined
before the spine took it up, and b moves by |B|; or inside B, as one of the merges that B is made of, and b moves from there
to the start of B. `reach` of a merge is the longest chain of such steps that it ends, found in order of rank; the lookahead
is the longest of all.

Decoding. Tokens are turned into bytes by blocks; a state machine over UTF-8 holds back the bytes of a character that is not
complete at a block's end, and faulty bytes become U+FFFD, each longest beginning of a character once.

Cases: null text counts as empty and has no ids; a text of any length is encoded whole; lone surrogates, which have no UTF-8
form, become '?'; the strings of special tokens in a text become the special ids, as in the library's bare call, and are
ordinary text with special_text=True; null ids decode to empty text; an id without a token is an error; repeated rows and null
doc_ids are rows of their own; an empty table gives an empty result; further columns are ignored by encode() and kept by decode().
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, text_or_empty
from .tokens import CHUNK, MEMO_CHARS, WHITE_SPACE

#: Characters after which a text is cut at the next start of white space, and ids that are decoded at once.
BLOCK_CHARS, BLOCK_IDS = 1 << 16, 1 << 16
#: The longest pieces of text that are remembered.
MEMO_LENGTH = 24
#: Bytes of words below which neighbours are searched anew after each merge, which costs less than a heap.
SHORT = 24
#: Bytes that a window takes beyond the lookahead.
WINDOW = 4096
_CUT = re.compile(f"(?<=[^{WHITE_SPACE}])(?=[{WHITE_SPACE}])")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it prints, else the next free
    one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """A vocabulary and its merge list."""

    _read: dict[str, "Merges"] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, kind = data["model"], data.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex") or data.get("normalizer") or not plain:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        byte = {s: b for b, s in byte_symbols().items()}
        vocabulary = model["vocab"]
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes = {i: bytes(map(byte.__getitem__, t)) for t, i in (vocabulary | self.added).items()}
        self.first = [vocabulary[s] for _, s in sorted(byte_symbols().items())]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rules = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        self.made = [ab for _, _, ab in self.rules]
        self.order = {(a, b): r for r, (a, b, _) in reversed([*enumerate(self.rules)])}
        self.longest = max(map(len, self.bytes.values()))
        self.lookahead = self._lookahead()

    @classmethod
    def of(cls, path: str) -> "Merges":
        """One for each vocabulary file and process."""
        if path not in cls._read:
            cls._read[path] = cls(path)
        return cls._read[path]

    def _lookahead(self) -> int:
        """Bytes after a boundary that settle it (see above)."""
        size = {t: len(b) for t, b in self.bytes.items()}
        made = {ab: r for r, (_, _, ab) in reversed([*enumerate(self.rules)])}
        reach: list[int] = []
        # Of the rules whose left part is a token: their ranks, and the greatest reach up to each.
        ranks, most = defaultdict(list), defaultdict(list)
        for r, (a, b, _) in enumerate(self.rules):
            far, inside = size[b], [(b, 0)]
            while inside:  # merges that b is made of
                t, at = inside.pop()
                if (k := made.get(t, r)) < r:
                    left, right, _ = self.rules[k]
                    far = max(far, at + size[left] + reach[k])
                    inside += [(left, at), (right, at + size[left])]
            spine, before = b, r
            while spine is not None:  # merges that would take a token of the right spine away
                if n := bisect_left(ranks[spine], before):
                    far = max(far, size[b] + most[spine][n - 1])
                k = made.get(spine, r)
                spine, before = (self.rules[k][1], k) if k < r else (None, 0)
            reach.append(far)
            ranks[a].append(r)
            most[a].append(max(far, most[a][-1] if most[a] else 0))
        return max(reach, default=0) + 1

    def merged(self, ids: list[int]) -> list[int]:
        """Merge neighbours by rank, equal ranks from the left, until no rule fits."""
        n = len(ids)
        if n < SHORT:
            get, made, none = self.order.get, self.made, len(self.made)
            found = [get(x, none) for x in zip(ids, ids[1:])]
            while found and (low := min(found)) != none:
                i, ab = found.index(low), made[low]
                ids[i : i + 2] = (ab,)
                del found[i]
                if i < len(found):
                    found[i] = get((ab, ids[i + 1]), none)
                if i:
                    found[i - 1] = get((ids[i - 1], ab), none)
            return ids
        order, made = self.order, self.made
        heap = [(r, i) for i, x in enumerate(zip(ids, ids[1:])) if (r := order.get(x)) is not None]
        heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        ids = [*ids]
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or order.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := order.get((ids[i], ids[k]))) is not None:
                    heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := order.get((ids[h], ids[i]))) is not None:
                heappush(heap, (x, h))
        return [t for t in ids if t >= 0]


class Window:
    """The transducer for one word: bytes in, tokens out once they are final."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, bytearray()
        self.full = 2 * merges.lookahead + 2 * merges.longest + WINDOW

    def push(self, data: bytes, last: bool = False) -> list[int]:
        """Tokens that are final with these bytes; all that are left with the last ones."""
        out: list[int] = []
        for at in range(0, len(data), WINDOW):
            self.held += data[at : at + WINDOW]
            if len(self.held) >= self.full:
                out += self._emit(len(self.held) - self.merges.lookahead)
        if last:
            out += self._emit(len(self.held))
        return out

    def _emit(self, until: int) -> list[int]:
        size, at, n = self.merges.bytes, 0, 0
        ids = self.merges.merged([self.merges.first[b] for b in self.held])
        for t in ids:
            if at + len(size[t]) > until:
                break
            at += len(size[t])
            n += 1
        del self.held[:at]
        return ids[:n]


class _Kinds(dict):
    """Code point to what stands for it in _WORD: a letter, a digit, white space or another mark, as the library's own
    pre-tokenizer tells them apart, whose Unicode tables need not be Python's."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.one = lambda s, cut=pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str: len(cut(s)) == 1
        super().__init__({i: chr(i) for i in map(ord, "'strevmld ")})

    def __missing__(self, point: int) -> str:
        c = chr(point)
        kind = self[point] = "a" if self.one("a" + c) else "0" if self.one("0" + c) else "!" if self.one("!" + c) else "\n"
        return kind


#: How byte-level pre-tokenizers part a text into words (fixed pattern of the format), over what _Kinds makes of it.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-z]+| ?0+| ?['!]+|[ \n]+(?![^ \n])|[ \n]+")
#: What goes on in a word of each kind, by the last character.
_RUN = {c: re.compile(f"[{kind}]*") for kind in ("a-z", "0", "'!", " \\n") for c in ("strevmlda" if kind == "a-z" else kind.replace("\\n", "\n"))}


class Transducer:
    """Text in, tokens out: push() pieces of a text, then finish()."""

    def __init__(self, merges: Merges, kinds: _Kinds | None = None):
        self.merges, self.kinds = merges, kinds or _Kinds()
        self.text, self.window, self.run = "", Window(merges), ""

    def push(self, piece: str, last: bool = False) -> list[int]:
        """Tokens that are final with this piece."""
        text = self.text + piece
        shape, at, out = text.translate(self.kinds), 0, []
        end = len(text) if last else len(text) - 3  # three characters show which word starts at the first of them
        while at < end:
            if self.run:
                stop = _RUN[self.run].match(shape, at).end()
                if self.run in " \n" and stop < len(text) and stop > at:
                    stop -= 1  # the last blank of several starts the next word
                whole = stop < len(text) or last
            else:
                stop = _WORD.match(shape, at).end()
                whole = last or stop <= end
            if not whole:
                if not self.run and stop < len(text):
                    break
                keep = 1 if shape[stop - 1] in " \n" else 0
                if stop - keep <= at or shape[at] == " " and stop - at < 2:
                    break
                self.run = shape[stop - 1]
                stop -= keep
            out += self.window.push(_utf8(text[at:stop]), whole)
            self.run = "" if whole else self.run
            at = stop
        self.text = text[at:]
        return out

    def finish(self) -> list[int]:
        """The tokens that are left."""
        out = self.push("", last=True)
        out += self.window.push(b"", last=True)
        self.text, self.run = "", ""
        return out


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


class Encoder:
    """Whole texts through the transducer, with a bounded memo of pieces between which no word reaches."""

    _made: dict[tuple[str, bool], "Encoder"] = {}

    def __init__(self, path: str, special_text: bool = False):
        self.merges, self.kinds = Merges.of(path), _Kinds()
        added = [] if special_text else sorted(self.merges.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.memo: dict[str, bytes] = {}
        self.chars = 0

    @classmethod
    def of(cls, path: str, special_text: bool = False) -> "Encoder":
        """One for each worker process, vocabulary and setting."""
        if (path, special_text) not in cls._made:
            cls._made[path, special_text] = cls(path, special_text)
        return cls._made[path, special_text]

    def blocks(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of a text, block by block."""
        from array import array

        parts = self.special.split(text) if self.special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield array("I", [self.merges.added[part]]).tobytes()
                continue
            at = 0
            while at < len(part):
                cut = _CUT.search(part, at + BLOCK_CHARS)
                stop = cut.start() if cut else len(part)
                yield self._block(part[at:stop])
                at = stop

    def _block(self, text: str) -> bytes:
        from array import array

        memo, chunks = self.memo, CHUNK.findall(text)
        missing = set(chunks).difference(memo)
        first, merged = self.merges.first, self.merges.merged
        for c in missing:
            ids = array("I")
            if len(c) <= MEMO_LENGTH:  # shorter than any window, so all of its words are complete
                shape, at = c.translate(self.kinds), 0
                while at < len(c):
                    stop = _WORD.match(shape, at).end()
                    ids.extend(merged([first[b] for b in _utf8(c[at:stop])]))
                    at = stop
            else:
                machine = Transducer(self.merges, self.kinds)
                for at in range(0, len(c), BLOCK_CHARS):
                    ids.extend(machine.push(c[at : at + BLOCK_CHARS]))
                ids.extend(machine.finish())
            memo[c] = ids.tobytes()
        out = b"".join(map(memo.__getitem__, chunks))
        for c in missing:
            if len(c) > MEMO_LENGTH:
                del memo[c]
            else:
                self.chars += len(c)
        if self.chars > MEMO_CHARS:
            memo.clear()
            self.chars = 0
        return out


class Utf8:
    """A state machine from bytes to text: text of complete characters out, the beginning of one held (three bytes at most)."""

    #: State by first byte: how many bytes must follow, and the bounds of the next one; later ones lie in 80 to BF.
    START = ({b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)} | {b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}
        | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)})

    def __init__(self):
        self.held = b""

    def push(self, data: bytes) -> str:
        """Text that is complete with these bytes."""
        data = self.held + data
        stop = len(data)
        for k in range(1, min(3, len(data)) + 1):
            if self._open(data[-k:]):
                stop -= k
                break
        self.held = data[stop:]
        return data[:stop].decode("utf-8", "replace")

    def _open(self, tail: bytes) -> bool:
        """Whether bytes are the beginning of a character and no whole one."""
        if tail[0] not in self.START:
            return False
        need, low, high = self.START[tail[0]]
        for b in tail[1:]:
            if not low <= b <= high:
                return False
            need, low, high = need - 1, 0x80, 0xBF
        return need > 0

    def finish(self) -> str:
        """What is left."""
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Decoder:
    """Ids to text, block by block."""

    _made: dict[tuple[str, bool], "Decoder"] = {}

    def __init__(self, path: str, skip_special: bool = False):
        merges = Merges.of(path)
        self.bytes = merges.bytes | ({i: b"" for i in merges.added.values()} if skip_special else {})

    @classmethod
    def of(cls, path: str, skip_special: bool = False) -> "Decoder":
        """One for each worker process, vocabulary and setting."""
        if (path, skip_special) not in cls._made:
            cls._made[path, skip_special] = cls(path, skip_special)
        return cls._made[path, skip_special]

    def blocks(self, ids) -> Iterator[str]:
        """Text of a vector of ids, block by block."""
        machine = Utf8()
        for at in range(0, len(ids), BLOCK_IDS):
            yield machine.push(b"".join(map(self.bytes.__getitem__, ids[at : at + BLOCK_IDS].tolist())))
        yield machine.finish()


def encode(docs: DataFrame, path: str, special_text: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts."""
    configure(docs.sparkSession)

    def rows(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = Encoder.of(path, special_text)
        for batch in batches:
            ids = [b"".join(encoder.blocks(t)) for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)]) // 4
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(rows, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, skip_special: bool = False, column: str = "decoded") -> DataFrame:
    """The rows with the text of their `ids` in a further column."""
    at = rows.columns.index("ids")
    if column in rows.columns:
        raise ValueError(f"there is a column {column} already")

    def texts(batches) -> Iterator:
        import pyarrow as pa

        decoder = Decoder.of(path, skip_special)
        for batch in batches:
            ids = batch.column(at)
            values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
            found = ["".join(decoder.blocks(values[a:b])) if ok else "" for a, b, ok in zip(offsets, offsets[1:], ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, column])

    configure(rows.sparkSession)
    return rows.mapInArrow(texts, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{column}` string")


def digests(docs: DataFrame, path: str, special_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts, encoded and decoded again."""
    both = decode(encode(docs, path, special_text), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
