"""Whole-text tokenisation with a bounded memo of white-space-delimited chunks.

No rule of the supported tokenizers spans a change from non-space to space, or from a letter to ASCII punctuation or
digits: their pre-tokenizers cut there and their normalisers (NFC, lower case, white space) act within a chunk. So the
ids of a text are the ids of its chunks in a row, and a chunk seen before needs no second encoding. Tests hold this against
encoding whole texts with a fresh tokenizer.

Where a vocabulary lower-cases and drops white space, texts of Latin-1 alone are lower-cased as a whole, so the cases of a word
are one chunk, and new words of Latin letters go to the same library model as the bytes that its normaliser and
pre-tokenizer would make of them. Both hold only if the library agrees for every Latin-1 letter, which is asked at the start.

The strings of special tokens in a text are ordinary text, as the notes that come with the vocabulary files set it
(`encode_special_tokens = True`); with `special_text=False` they become the special ids, as in the library's bare call.
"""

from __future__ import annotations

import os
import re
from array import array

#: Code points with Unicode's White_Space property (fixed values).
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters after which a following ASCII mark or digit starts a chunk of its own.
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_SPACE, _WORD = f"[{WHITE_SPACE}]", f"[{LETTERS}]++(?=[!-@\\[-`{{-~])|[^{WHITE_SPACE}]++"
CHUNK = re.compile(f"{_SPACE}*+(?:{_WORD})|{_SPACE}++")
#: For vocabularies that drop white space. (White space and the end in the look-ahead cut nothing; they save reading the word
#: again by the second rule.)
BARE_CHUNK = re.compile(f"[{LETTERS}]++(?=[\\t-\\r -@\\[-`{{-~]|\\Z)|[^{WHITE_SPACE}]++")
#: Chunks that are one word to the pre-tokenizers: a space and letters, or letters alone.
PLAIN, BARE_PLAIN = re.compile(f" [{LETTERS}]++").fullmatch, re.compile(f"[{LETTERS}]++").fullmatch

#: Chunks up to this length are kept, as longer ones seldom recur, and so many of their characters before a fresh start.
MEMO_LENGTH, MEMO_CHARS = 12, 2_500_000


def default_path(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def latin(text: str) -> bool:
    """Whether a text has only code points below 256, which are all composed and lower-case one to one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    _made: dict[tuple[str, bool], "ChunkEncoder"] = {}

    def __init__(self, path: str, special_text: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_text
        added = [] if special_text else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added), re.IGNORECASE).search if added else None
        self.memo: dict[str, bytes] = {}
        self.held = 0
        self._prepare()

    def _prepare(self) -> None:
        """Tell apart vocabularies that drop white space and end words with </w> from byte-level ones that start words
        with the mark of a space; `edge` has the ids that can only end or start a word."""
        import numpy as np

        self.bare = not self.tokenizer.encode(" \n ", add_special_tokens=False).ids
        self.chunks, self.plain = (BARE_CHUNK.findall, BARE_PLAIN) if self.bare else (CHUNK.findall, PLAIN)
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.endswith("</w>") if self.bare else token.startswith("\u0120")
        self.words = self._word_model() if self.bare else None

    def _word_model(self):
        """The library's tokenizer for lower-case words of Latin letters parted by spaces, without normaliser; none unless it
        gives every Latin-1 letter, in both cases, the ids that the whole tokenizer gives."""
        from tokenizers import Tokenizer, pre_tokenizers

        words = Tokenizer.from_str(self.tokenizer.to_str())
        words.encode_special_tokens = True
        words.normalizer, words.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        letters = re.findall(f"[{LETTERS}]", "".join(map(chr, range(256))))
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.table = {ord(c): as_bytes(c)[0][0] for c in letters if not c.isascii()}
        for c in [*letters, "".join(letters)]:
            ids = words.encode(c.lower().translate(self.table), add_special_tokens=False).ids
            if not ids or ids != self.tokenizer.encode(c, add_special_tokens=False).ids:
                return None
        return words

    @classmethod
    def of(cls, path: str, special_text: bool = True) -> "ChunkEncoder":
        """One encoder for each worker process, vocabulary and setting."""
        if (path, special_text) not in cls._made:
            cls._made[path, special_text] = cls(path, special_text)
        return cls._made[path, special_text]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text; lone surrogates are replaced, as they have no UTF-8 form."""
        if self.special and self.special(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.words and latin(text):
            text = text.lower()
        chunks, memo = self.chunks(text), self.memo
        missing = set(chunks).difference(memo)
        if missing:
            found = self._together([c for c in missing if self.plain(c)])
            apart = [c for c in missing if c not in found]
            encodings = self.tokenizer.encode_batch_fast(apart, add_special_tokens=False) if apart else []
            found |= {c: array("I", e.ids).tobytes() for c, e in zip(apart, encodings)}
            memo.update(found)
        out = b"".join([memo[c] for c in chunks])
        for c in missing:
            if len(c) > MEMO_LENGTH:
                del memo[c]
            else:
                self.held += len(c)
        if self.held > MEMO_CHARS:
            memo.clear()
            self.held = 0
        return out

    def _together(self, words: list[str]) -> dict[str, bytes]:
        """Encode words as one text, which is cheaper, and part the ids at word edges; nothing if the counts differ."""
        import numpy as np

        if len(words) < 2:
            return {}
        joined, tokenizer = (" " if self.bare else "").join(words), self.words or self.tokenizer
        if self.words:
            joined = joined.lower() if joined.isascii() else joined.lower().translate(self.table)
        ids = array("I", tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids).tobytes()
        at = np.nonzero(self.edge[np.frombuffer(ids, "<u4")])[0]
        if len(at) != len(words):
            return {}
        cuts = [0, *(4 * (at + 1)).tolist()] if self.bare else [*(4 * at).tolist(), len(ids)]
        return {w: ids[a:b] for w, a, b in zip(words, cuts, cuts[1:])}
