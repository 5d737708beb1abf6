"""Token ids of whole texts with a public tokenizer, without encoding the same word again and again."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at once; larger than elsewhere, as a word is looked up once in each slice.
SLICE_BYTES = 1 << 22
#: Words whose ids a worker remembers; when there are more, it starts anew.
REMEMBERED = 700_000
#: A mark other than an apostrophe and the characters of special tokens is never part of the letters before it.
_MARK_BEHIND_LETTER = r"([A-Za-z])([!-&(-;=?-@\[-`{}~])"
_PLAIN = re.compile("[a-z]+").fullmatch


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids as ``tokenizers`` gives them with ``add_special_tokens=False``.

    For tokenizers that work in lower case, drop white space and join nothing across it or across the border from letters to
    marks, such as word_bpe_49k. Texts are cut there, and each different word is encoded once; a word of the letters a to z has
    nothing to normalise and goes straight to the model. Texts with parts of special tokens are encoded as they are.
    """

    _ready: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.rows: dict[str, int] = {}
        self.begin, self.flat = array("q", [0]), array("I")

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process."""
        if path not in cls._ready:
            cls._ready[path] = cls(path)
        return cls._ready[path]

    def _learn(self, words: list[str]) -> None:
        model = self.tokenizer.model
        other = [w for w in words if not _PLAIN(w)]
        found = dict(zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)))
        for word in words:
            ids = found[word].ids if word in found else [t.id for t in model.tokenize(word)]
            self.rows[word] = len(self.begin) - 1
            self.flat.extend(ids)
            self.begin.append(len(self.flat))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and offsets of each word."""
        words = words.dictionary_encode()
        index, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
        if len(self.rows) > REMEMBERED:
            self.rows, self.begin, self.flat = {}, array("q", [0]), array("I")
        self._learn([w for w in names if w not in self.rows])
        rows = np.fromiter(map(self.rows.__getitem__, names), np.int64, len(names))
        begin = np.array(self.begin, dtype=np.int64)
        size = np.diff(begin)[rows][index]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(begin[:-1][rows][index] - ends[:-1], size) + np.arange(ends[-1])
        return np.frombuffer(self.flat, np.uint32)[at].astype(np.int64) if len(at) else np.zeros(0, np.int64), ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and offsets of each text (nulls are empty)."""
        texts = texts.fill_null("")
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        plain = pc.if_else(pa.array(np.isin(np.arange(len(texts)), special)), "", texts) if len(special) else texts
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(plain), _MARK_BEHIND_LETTER, r"\1 \2"))
        ids, ends = self._words(lists.flatten())
        lists_at = np.asarray(lists.offsets, dtype=np.int64)
        offsets = ends[lists_at - lists_at[0]]
        if len(special):
            parts = np.split(ids, offsets[1:-1])
            for k, found in zip(special, self.tokenizer.encode_batch_fast(texts.take(pa.array(special)).to_pylist(), add_special_tokens=False)):
                parts[k] = np.array(found.ids, np.int64)
            ids, offsets = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, offsets

    def documents(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The same with ``end_id`` behind each text."""
        ids, offsets = self.encode(texts)
        if end_id is None:
            return ids, offsets
        return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))

    def ending(self, marks: str = ".!?") -> np.ndarray:
        """For each id whether it ends a sentence: nothing but ``marks``, at a word's end."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocab.values()) + 1, bool)
        for token, k in vocab.items():
            core = token.removesuffix("</w>")
            out[k] = core != token and core != "" and not core.strip(marks)
        return out
