"""Token ids of whole texts from a tokenizer whose pre-tokens never cross white space, encoded word by word."""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Text bytes split at once.
STEP = 8 << 20
#: Word parts a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000
#: Word parts encoded in one call, with a mark between them.
CALL = 500
MARK = "\x01"
#: Words of these characters are cut into letters and others; combining marks, apostrophes, rarer scripts and the one
#: letter here that lower case turns into two characters (U+0130) are not.
PLAIN = r"^[\x21-\x26\x28-\x7e¡-¬®-įı-ɏΆ-ϿЀ-҂Ҋ-ӿ]*$"


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of a flat array one after another, and where each begins (with the end of the last)."""
    size = sizes[which]
    place = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat((starts[which] - place[:-1]).astype(np.int32), size)  # steps and memory stay far below 2^31 ids
    at += np.arange(place[-1], dtype=np.int32)
    return flat[at], place


class WordIds:
    """Encodes texts through a memory of the word parts met so far.

    White space only separates in such a tokenizer, so a text's ids are those of its words one after another. Each
    distinct word of a step is looked up once; its runs of letters and of other characters, which the tokenizer parts
    too, are remembered by the worker. Words with apostrophes, combining marks, special tokens or characters outside
    the alphabets of :data:`PLAIN` are encoded as they are, texts with a separator U+001C to U+001F whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.special = [str(t) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.parts = pa.array([], pa.large_string())
        self.flat, self.starts, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Add parts to the memory, plain ones many to a call, others one by one; returns their numbers."""
        plain = pc.and_(pc.match_substring_regex(new, PLAIN), pc.greater(pc.binary_length(new), 0))
        for token in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(new, token)))
        plain = plain.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        new = new.take(pa.array(order))
        easy, hard = new[: plain.sum()].to_pylist(), new[plain.sum() :].to_pylist()
        first = len(self.parts)
        self.parts = pa.concat_arrays([self.parts, new])
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.arange(first, first + len(order))
        ids, sizes = [], []
        calls = [f" {MARK} ".join(easy[i : i + CALL]) for i in range(0, len(easy), CALL)]
        for text, i in zip(self.tokenizer.encode_batch_fast(calls, add_special_tokens=False), range(0, len(easy), CALL), strict=True):
            got = np.asarray(text.ids + self.mark, self.kind)
            at = np.flatnonzero(got == self.mark[0])
            if len(self.mark) != 1 or len(at) != len(easy[i : i + CALL]):
                raise ValueError("the tokenizer does not keep the mark apart")
            sizes.append(np.diff(np.concatenate(([-1], at))) - 1)
            ids.append(np.delete(got, at))
        for x in self.tokenizer.encode_batch_fast(hard, add_special_tokens=False):
            ids.append(np.asarray(x.ids, self.kind))
            sizes.append(np.array([len(x.ids)]))
        size = np.concatenate(sizes).astype(np.int64)
        start = np.concatenate(([0], np.cumsum(size)))[:-1] + len(self.flat)
        self.flat = np.concatenate([self.flat, *ids])
        self.starts, self.sizes = np.concatenate([self.starts, start]), np.concatenate([self.sizes, size])
        return numbers

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some distinct words one after another, and where each word's begin."""
        plain = pc.match_substring_regex(words, PLAIN)
        for token in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(words, token)))
        cut = pc.replace_substring_regex(pc.ascii_lower(words), r"([^\p{L}]+)", r" \1 ")
        lists = pc.split_pattern(pc.if_else(plain, cut, words), " ")
        coded = lists.flatten().dictionary_encode()
        number = pc.index_in(coded.dictionary, self.parts)
        new = pc.is_null(number)
        number = pc.fill_null(number, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if pc.any(new).as_py():
            number[new.to_numpy(zero_copy_only=False)] = self._learn(coded.dictionary.filter(new))
        ids, place = gathered(self.flat, self.starts, self.sizes, number[coded.indices.to_numpy(zero_copy_only=False)])
        return ids, place[np.asarray(lists.offsets)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; none for null."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        out: list[np.ndarray] = []
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP, "right")))
            out += self._step(texts.slice(first, last - first))
            first = last
        return out

    def _step(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.parts) > REMEMBERED:
            self.forget()
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        flat, begin = self._words(coded.dictionary)
        ids, place = gathered(flat, begin[:-1], np.diff(begin), coded.indices.to_numpy(zero_copy_only=False))
        bounds = place[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        odd = pc.match_substring_regex(texts, r"[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            out[i] = np.asarray(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, self.kind)
        return out


def word_ids(path: str) -> WordIds:
    """The worker's encoder for a tokenizer file, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    state = sys.modules.setdefault("rostrum_worker_state", types.ModuleType("rostrum_worker_state"))
    encoders = state.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = WordIds(path)
    return encoders[path]
