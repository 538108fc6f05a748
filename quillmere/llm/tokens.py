"""Token ids of a tokenizers file, with words remembered by each Python worker."""

from __future__ import annotations

import os
from collections.abc import Iterable
from unicodedata import is_normalized

import numpy as np
import public_tokenizers

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")

#: Marks that may follow a word; no token spans the two, nor a blank.
_MARKS = ".,*%&$#!?;:\"()-_/\\@+=~^`"
_WORD_END = "</w>"


class WordIds:
    """Ids of whole texts as little-endian 32-bit bytes, equal to encode(text, add_special_tokens=False).

    For tokenizers that drop white space and split at it, as word_bpe_49k does: a text's ids are
    those of its blank-separated parts, so each distinct part is encoded once. The memory is
    emptied when it would hold over ``limit`` parts, which bounds it and changes no id.
    """

    def __init__(self, path: str = WORD_FILE, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self._encode = tokenizer.encode_batch_fast
        # Words of letters, lower-cased and in NFC, need neither the normaliser nor the splitting pattern.
        plain = Tokenizer.from_file(path)
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._encode_plain = plain.encode_batch_fast
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self._limit = limit
        self._known: dict[str, bytes] = {}

    def _encoded(self, parts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self._encode(parts, add_special_tokens=False)]

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        """Of words of letters only, a thousand in one call: each is one piece, ending in a word-end token."""
        out: list[bytes] = []
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            ids = np.array(self._encode_plain([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self._ends[ids]) + 4).tolist()
            raw = ids.tobytes()
            if len(ends) == len(some):
                out += [raw[a:b] for a, b in zip([0, *ends], ends)]
            else:
                out += self._encoded(some)
        return out

    def _learn(self, parts: set[str]) -> None:
        known = self._known
        known.setdefault("", b"")
        split: dict[str, tuple[str, str]] = {}
        words: set[str] = set()
        others: set[str] = set()
        for part in parts:
            low = part.lower()
            word = low.rstrip(_MARKS)
            # Lower-casing a whole word differs from lower-casing its letters one by one only for a capital sigma.
            if word.isalpha() and (part.isascii() or "\u03a3" not in part and is_normalized("NFC", low)):
                words.add(word)
                if word != part:
                    marks = low[len(word) :]
                    others.add(marks)
                    split[part] = word, marks
            else:
                others.add(part)
        new = [x for x in words if x not in known]
        known.update(zip(new, self._encoded_words(new)))
        new = [x for x in others if x not in known]
        known.update(zip(new, self._encoded(new)))
        for part, (word, marks) in split.items():
            known[part] = known[word] + known[marks]

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        block: list[list[str]] = []
        size = 0

        def flush() -> None:
            known = self._known
            new = {w for words in block for w in words if w not in known}
            if len(known) + len(new) > self._limit:
                known.clear()
                new = {w for words in block for w in words}
            self._learn(new)
            get = known.__getitem__
            out.extend([b"".join(map(get, words)) for words in block])

        for text in texts:
            words = text.replace("\n", " ").split(" ")
            block.append(words)
            size += len(words)
            if size >= 100_000:
                flush()
                block, size = [], 0
        flush()
        return out


_of_worker: dict[str, WordIds] = {}


def word_ids(path: str = WORD_FILE) -> WordIds:
    """This Python process's WordIds; tasks that a worker runs one after another share it."""
    if path not in _of_worker:
        _of_worker[path] = WordIds(path)
    return _of_worker[path]


def release() -> None:
    """Gives back what this Python process remembers of words; for tasks of other work, which a worker may go on to."""
    _of_worker.clear()
