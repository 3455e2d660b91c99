"""Token ids of whole texts by a public tokenizer, encoding each distinct word once.

`word_bpe_49k.json` drops white space and never joins pieces across it, so a text's ids are the
ids of its ASCII-space-separated words, one after the other; words hold any other white space
unchanged and go to the library as they are.  The tokenizer's special strings hold no white
space, so they too stay inside one word.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np

from .textkernel import Words

#: Bytes that a worker's table of words and their values may take; a fuller one begins anew.
TABLE_BYTES = 40 << 20
#: Longer words are worked out each time, not kept.
LONG_BYTES = 64
#: Words of one generation of a memory of strings (about 200 bytes each); two are kept, so that frequent words stay.
BASES = 60_000
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
SPACE = re.compile(r"\s")
#: Keeps words apart where many are encoded together; words that hold it are encoded alone.
MARK, JOINED = "\x01", 100
#: Letters that have one-letter lower cases and no combining forms; marks that begin no contraction.
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def _byte_letters() -> list[str]:
    """The usual byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


LETTER = _byte_letters()
_MAPPED = dict(enumerate(LETTER))


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Generations:
    """A bounded memory of word -> value: what is asked for stays, what is not is dropped in time."""

    def __init__(self, limit: int = BASES):
        self.young, self.old, self.limit = {}, {}, limit

    def look_up(self, words: list, make) -> list:
        """Values of the distinct words; make(list of missing words) gives theirs."""
        out = list(map(self.young.get, words))
        missing = [i for i, v in enumerate(out) if v is None]
        if missing and self.old:
            for i in missing:
                out[i] = self.old.get(words[i])
                if out[i] is not None:
                    self.young[words[i]] = out[i]
            missing = [i for i in missing if out[i] is None]
        if missing:
            for i, v in zip(missing, make([words[i] for i in missing]), strict=True):
                out[i] = v
                if len(words[i]) <= LONG_BYTES:
                    self.young[words[i]] = v
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as one number; data ends in eight bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def same_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether bytes a[a_at : a_at + size] are those of b from b_at on, for each span; both arrays are padded."""
    x, y = _eights(a), _eights(b)
    out = np.ones(len(sizes), bool)
    at, done = np.arange(len(sizes)), 0
    while len(at):
        left = np.minimum(sizes[at] - done, 8)
        differ = (x[a_at[at] + done] ^ y[b_at[at] + done]) & _LOW_BYTES[left]
        out[at[differ != 0]] = False
        done += 8
        at = at[(differ == 0) & (sizes[at] > done)]
    return out


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


class WordTable:
    """What is known of words: sorted 64-bit hashes, each with a slot, and the bytes of the word of each slot.

    Looking up a slice is a merge of its distinct hashes with the known ones.  Hashes only find a word; its
    bytes are compared, and a word that shares a hash with another one is worked out by itself.  So are words
    of over LONG_BYTES.  A table of over TABLE_BYTES is emptied before the next slice.

    Subclasses give learn(words), which appends values, one slot each, and returns the first slot; clear(),
    which drops all values; and value_bytes().
    """

    limit = TABLE_BYTES

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: Bytes of the words, and where each slot's begin and how many they are.
        self.text, self.used, self.at, self.sizes = np.zeros(1 << 16, np.uint8), 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.clear()

    def _add(self, hashes: np.ndarray, at: np.ndarray, words: Words, data: bytes, which: np.ndarray) -> np.ndarray:
        """Learns the words `which` of the slice, whose hashes belong at these places; returns their slots."""
        spans = [data[a:b] for a, b in zip(words.starts[which].tolist(), words.ends[which].tolist(), strict=True)]
        first, n = self.learn([w.decode() for w in spans]), len(spans)
        sizes = (words.ends - words.starts)[which]
        self.at, self.sizes = room(self.at, first + n), room(self.sizes, first + n)
        self.at[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        joined = np.frombuffer(b"".join(spans), np.uint8)
        self.text = room(self.text, self.used + len(joined) + 8)
        self.text[self.used : self.used + len(joined)] = joined
        self.used += len(joined)
        slots = first + np.arange(n)
        self.hashes, self.slots = np.insert(self.hashes, at, hashes), np.insert(self.slots, at, slots)
        return slots

    def slots_of(self, words: Words) -> np.ndarray:
        """The slot of each word of the slice; slots hold until the next call."""
        if 16 * len(self.hashes) + self.used + self.value_bytes() > self.limit:
            self._forget()
        sizes, hashes = words.ends - words.starts, words.hashes()
        order = np.argsort(hashes)
        found = hashes[order]
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        kind = np.empty(len(found), np.int64)
        kind[order] = np.cumsum(new) - 1
        found, where = found[new], order[new]
        bytes_ = padded(words.data)
        odd = (sizes > LONG_BYTES) | (sizes != sizes[where][kind])
        rest = np.flatnonzero(~odd & (where[kind] != np.arange(len(kind))))
        odd[rest] = ~same_spans(bytes_, words.starts[rest], bytes_, words.starts[where[kind[rest]]], sizes[rest])
        at = np.searchsorted(self.hashes, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == found[inside]
        slots = np.zeros(len(found), np.int64)
        slots[known] = self.slots[at[known]]
        met = np.flatnonzero(known)
        clash = np.zeros(len(found), bool)
        clash[met] = self.sizes[slots[met]] != sizes[where[met]]
        met = met[~clash[met]]
        clash[met] = ~same_spans(self.text, self.at[slots[met]], bytes_, words.starts[where[met]], sizes[where[met]])
        odd |= clash[kind]
        data = words.data.tobytes()
        fresh = np.flatnonzero(~known & ~odd[where])
        if len(fresh):
            slots[fresh] = self._add(found[fresh], at[fresh], words, data, where[fresh])
        out = slots[kind]
        alone = np.flatnonzero(odd)
        if len(alone):
            spans = [data[a:b] for a, b in zip(words.starts[alone].tolist(), words.ends[alone].tolist(), strict=True)]
            distinct = list(dict.fromkeys(spans))
            first = self.learn([w.decode() for w in distinct])
            self.at, self.sizes = room(self.at, first + len(distinct)), room(self.sizes, first + len(distinct))
            place = dict(zip(distinct, range(first, first + len(distinct)), strict=True))
            out[alone] = [place[w] for w in spans]
        return out


#: What the fast way below relies on; a file that says otherwise goes through the whole library.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}


@lru_cache(maxsize=8)
def drops_spaces(path: str) -> bool:
    """Whether the file is of the kind whose texts' ids are those of their words, one after the other."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = {k: file["model"].get(k) for k in _MODEL}
    plain = all(not SPACE.search(t["content"]) and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in file["added_tokens"])
    return plain and file["normalizer"] == _NORMALIZER and file["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and file["post_processor"] is None and model | {"continuing_subword_prefix": model["continuing_subword_prefix"] or None} == _MODEL


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder | WholeTexts:
    """What gives the ids of slices of texts by the vocabulary file; a worker keeps it from task to task."""
    return Encoder(path) if drops_spaces(path) else WholeTexts(path)


class WholeTexts:
    """Ids of whole texts by the library of the file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            model = library(path)
            self.encode = lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            self.encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        else:
            raise ValueError(f"no library for {path}: .json and .model files are read")

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        data = words.data.tobytes()
        made = self.encode([data[a:b].decode() for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)])
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in made], dtype=np.int64)])
        return np.fromiter(chain.from_iterable(made), np.uint32, int(offsets[-1])), offsets


class Encoder(WordTable):
    """Token ids of slices of texts by a file that `drops_spaces`."""

    def __init__(self, path: str):
        if not drops_spaces(path):
            raise ValueError(f"the ids of a text are not those of its words by {path}")
        self.tokenizer, self.bases = library(path), Generations(BASES)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.model = self.tokenizer.model
        super().__init__()

    def clear(self) -> None:
        """Ids of slot i stand in pool[begins[i] : begins[i + 1]]; both arrays have room to spare."""
        self.pool, self.begins, self.known = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def value_bytes(self) -> int:
        return 4 * int(self.begins[self.known]) + 20 * self.known

    def learn(self, words: list[str]) -> int:
        made = self._make(words)
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        first, used = self.known, int(self.begins[self.known])
        self.begins = room(self.begins, first + len(made) + 1)
        self.begins[first + 1 : first + len(made) + 1] = used + np.cumsum(sizes)
        self.pool = room(self.pool, used + int(sizes.sum()))
        self.pool[used : used + int(sizes.sum())] = np.frombuffer(b"".join(made), np.uint32)
        self.known += len(made)
        return first

    def _make(self, words: list[str]) -> list[bytes]:
        """Ids of each word.  Letters and the marks behind them are pieces of their own to this tokenizer, and case is
        dropped, so most words are a base with marks.  A base goes to the library's model as the one piece it is;
        words that are none go through the whole library."""
        bases = [w.rstrip(MARKS) for w in words]
        ends = [w[len(b) :] for w, b in zip(words, bases, strict=True)]
        bases = [b.lower() if (b.isascii() and b.isalpha()) or LATIN.fullmatch(b) else None for b in bases]
        kinds = list(set(bases) - {None})
        known = dict(zip(kinds, self.bases.look_up(kinds, self._pieces), strict=True))
        of_end = {e: self._encode([e])[0] if e else b"" for e in set(ends)}
        out = [known[b] + of_end[e] if b else None for b, e in zip(bases, ends, strict=True)]
        odd = [i for i, b in enumerate(bases) if b is None]
        for i, ids in zip(odd, self._encode([words[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def _pieces(self, bases: list[str]) -> list[bytes]:
        """Ids of pieces of lower-case letters, by the library's model."""
        tokenize = self.model.tokenize
        mapped = [b if b.isascii() else b.encode().decode("latin-1").translate(_MAPPED) for b in bases]
        return [array("I", [t.id for t in tokenize(m)]).tobytes() for m in mapped]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids by the library, which gets many words in one text, kept apart by a mark that is a token of its own."""
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if MARK not in w]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for low in range(0, len(groups), 64):
            part = groups[low : low + 64]
            texts = [f" {MARK} ".join([words[i] for i in g]) for g in part]
            for group, e in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                cuts = np.flatnonzero(ids == self.mark).tolist()
                if len(cuts) != len(group) - 1:
                    raise ValueError("the mark met another word")
                data = ids.tobytes()
                for i, a, b in zip(group, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True):
                    out[i] = data[4 * a : 4 * b]
        for i, known in enumerate(out):
            if known is None:
                out[i] = array("I", self.tokenizer.encode(words[i], add_special_tokens=False).ids).tobytes()
        return out

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the slice, and the offsets of the texts in them."""
        slots = self.slots_of(words)
        begins = self.begins[slots]
        counts = self.begins[slots + 1] - begins
        ends = np.cumsum(counts)
        at = np.repeat(begins - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.pool[at], np.concatenate([[0], ends])[words.first]


def room(a: np.ndarray, size: int) -> np.ndarray:
    """The array, at least `size` long, growing by half at a time."""
    return a if len(a) >= size else np.concatenate([a, np.zeros(max(size, len(a) * 3 // 2) - len(a), a.dtype)])
