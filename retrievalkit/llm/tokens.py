"""Token ids of whole texts with a word-level BPE vocabulary.

The pre-tokens of such a tokenizer never cross white space, so each run of
other characters has the same ids wherever it stands. Texts are therefore cut
into words and hashed (numpy), each distinct word is encoded once by the
library, and the ids of a text are gathered from a bounded store of known
words. Words of characters outside the plain set below, and those that hold a
special-token string, go through the library as they are, so the ids always
equal the library's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from retrievalkit.llm import _words as W

#: For these characters NFC is the identity, lower-casing goes by character, and
#: the classes of ``re`` and of the tokenizer's pattern agree.
_PLAIN = re.compile("[ -~¡«»¿-įı-ɏ‐-―‘-„…]*")
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_CHUNK = 1 << 20


def _letters() -> np.ndarray:
    """The printable stand-ins of bytes in byte-level vocabularies; space stays."""
    keep = {32, *range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = np.arange(256, dtype="<u4"), 0
    for b in range(256):
        if b not in keep or b == 32:
            out[b], n = (32 if b == 32 else 256 + n), n + 1
    return out


_LETTERS = _letters()


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` one after another, and their offsets."""
    ends = np.append(0, np.cumsum(size))
    return values[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends


class WordTokens:
    """Ids of texts. ``room`` bounds the words that are kept (about 30 bytes each)."""

    def __init__(self, path: str, room: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.whole.model)      # takes pre-tokens in byte-level letters
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.top = max(self.whole.get_vocab().values())      # the largest id
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.room = room
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(0, np.uint64)              # sorted hashes of known words
        self.at = np.zeros(0, np.int32)                # where a word's ids begin
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words one after another, and how many each has."""
        text, odd = b" ".join(words).decode("utf-8", "replace"), {}
        if _PLAIN.fullmatch(text) and "<|" not in text:
            lower = text.lower().split(" ")
        else:
            lower = [w.decode("utf-8", "replace") for w in words]
            for n, word in enumerate(lower):
                if not _PLAIN.fullmatch(word) or "<|" in word:
                    odd[n] = self.whole.encode(word, add_special_tokens=False).ids
            lower = ["" if n in odd else w.lower() for n, w in enumerate(lower)]
        parts: list[str] = []
        pieces = np.zeros(len(words), np.int64)
        for n, word in enumerate(lower):
            if word.isalpha():
                parts.append(word)
                pieces[n] = 1
            elif word:
                own = _PRE.findall(word)
                parts += own
                pieces[n] = len(own)
        once = {w: n for n, w in enumerate(dict.fromkeys(parts))}
        data = np.frombuffer(" ".join(once).encode(), np.uint8)
        letters = _LETTERS[data].tobytes().decode("utf-32-le")
        own = np.array(self.plain.encode_batch_fast([letters], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.append(0, np.flatnonzero(self.last[own]) + 1)
        if len(ends) != len(once) + 1:
            raise ValueError("the vocabulary does not mark the ends of words")
        which = np.fromiter(map(once.__getitem__, parts), np.int64, len(parts))
        ids, ends = _gather(own, ends[which], np.diff(ends)[which])
        size = np.diff(ends[np.append(0, np.cumsum(pieces))])
        if odd:
            split = np.split(ids, np.cumsum(size)[:-1])
            for n, own in odd.items():
                split[n], size[n] = np.array(own, np.uint32), len(own)
            ids = np.concatenate(split)
        return ids, size

    def _learn(self, keys: np.ndarray, words: list[bytes], clear: bool) -> None:
        if clear and len(self.key) + len(keys) > self.room:
            self._clear()
        ids, size = self._encode_words(words)
        place = np.searchsorted(self.key, keys)         # keys are sorted
        self.key = np.insert(self.key, place, keys)
        self.at = np.insert(self.at, place, len(self.ids) + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.ids = np.concatenate([self.ids, ids])

    def _known(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Index into the stored words for each word of a chunk."""
        hashes = words.hashes(False)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)

        def find():
            at = np.searchsorted(self.key, keys)
            at[at == len(self.key)] = 0
            return at, (self.key[at] == keys) if len(self.key) else np.zeros(len(keys), bool)

        at, ok = find()
        data = None
        for clear in (True, False):                     # a cleared store lacks the chunk's other words
            new = np.flatnonzero(~ok)
            if len(new):
                data = data or words.buf.tobytes()
                some = first[new]
                self._learn(keys[new], [data[a:b] for a, b in zip(words.start[some].tolist(), words.end[some].tolist())], clear)
                at, ok = find()
        return at, back

    def encode(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first, end, ids, offsets)`` of runs of texts of a column."""
        for lo, hi, buf, off in W.chunks(column, _CHUNK):
            words = W.Words(buf, off)
            at, back = self._known(words)
            ids, ends = _gather(self.ids, self.at[at][back].astype(np.int64), self.size[at][back].astype(np.int64))
            yield lo, hi, ids, ends[words.first]

    def counts(self, column) -> np.ndarray:
        """Ids in each text of a column."""
        out = [np.zeros(0, np.int64)]
        for _, _, buf, off in W.chunks(column, _CHUNK):
            words = W.Words(buf, off)
            at, back = self._known(words)
            out.append(W.run_sums(self.size[at][back].astype(np.int64), words.first))
        return np.concatenate(out)


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this Python worker; its known words serve later tasks too."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
