"""Exact token counts of every prefix of a text, by dynamic programming over BPE prefixes.

Cutting the last token off a BPE encoding leaves the encoding of what stands before it, and a
sequence of tokens is an encoding just when each neighbouring pair is.  So for each position the
last token of the prefix's encoding is the one token that ends there, and whose pair with the last
token of the shorter prefix survives merging; a count per prefix follows in one pass.  Here the last
symbol of a piece carries an end mark, so two tables run side by side: prefixes that go on, and
prefixes that end.

The table of a text is the sequence of count differences, one signed byte per character (code
point): its running sum is the number of tokens of each prefix, as the library would give for that
prefix alone.  Tables of words are made once and joined; no text is encoded twice for a question.

Words that the rule does not fit (characters that change length when normalised, contractions,
special strings, control characters) get their counts from the library, prefix by prefix.  Such a
word of over 512 characters is first cut where the tokenizer always cuts, whatever follows: at white
space, digits, between letters and marks, where no combining character joins what stands before.  Each
chunk goes by the rule or, if short, to the library; long runs of letters that change when normalised
go through the same pass with their normalised prefixes.  What is left (a long run that is neither, such
as thousands of combining marks behind one letter) takes time with the square of its length.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .textkernel import SEP, Words, slices, text_column
from .tokens import LETTER, Generations, WordTable, drops_spaces, encoder, library, room

END = "</w>"
#: The tokenizer's own pattern of pieces, contractions aside (fixed by the vocabulary file).
PIECES = regex.compile(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")
ODD = regex.compile(r"[\p{M}\p{C}\p{Z}\u03a3\u0130\u212a]|<\|")
ODD_CHARS = 512
#: Pieces (words, chunks) of one generation of a worker's memory, about 300 bytes each.
REMEMBERED = 100_000
SPACES = " \t\n\v\f\r"
WIDE = b"\0wide"  # no table of signed bytes ends so: a step of 119 cannot follow 0 by a single character
WHITE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_LETTERS = re.compile(r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters that normalising may join with what stands before them, combining marks aside."""
    pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0x110000))
    found = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(found | {chr(i) for i in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]})


@lru_cache(maxsize=1 << 16)
def _begins(c: str) -> bool:
    """Whether what stands before c never changes what c and its followers are normalised to."""
    first = unicodedata.normalize("NFD", c)[0]
    return not unicodedata.combining(first) and first not in _seconds()


@lru_cache(maxsize=1 << 16)
def _normal(s: str) -> str:
    """As the tokenizer normalises, which lowers each character by itself."""
    return "".join([c.lower() for c in unicodedata.normalize("NFC", s)])


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """S: space, L: letter, N: number, P: another, ?: one that Unicode versions may see differently."""
    if c in WHITE:
        return "S"
    k = unicodedata.category(c)
    return k[0] if k[0] in "LN" else "?" if k in ("Cn", "Co", "Cs") else "P"


def _segments(text: str) -> list[str]:
    at = [0, *(i for i in range(1, len(text)) if _begins(text[i])), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def chunks(text: str) -> list[str]:
    """The text, cut where the tokens of every longer prefix are those before the cut and those after it.

    The text holds no special string.  A lone ' before letters may begin a contraction, which is then cut
    behind, not within.
    """
    segments = _segments(text)
    normal = list(map(_normal, segments))
    out, low, forced = [], 0, -1
    for i in range(1, len(segments)):
        before, after, bare = _kind(normal[i - 1][-1]), _kind(normal[i][0]), _kind(_normal(segments[i][0])[0])
        if i == forced or before in "SN" or (after == bare and after in "SN"):
            cut = True
        elif after != bare or "?" in (before, after) or before == after:
            cut = False
        elif before == "P" and normal[i - 1][-1] == "'":
            earlier = (normal[i - 2] if i > 1 else "") + normal[i - 1][:-1]
            cut = False
            if earlier and _kind(earlier[-1]) == "P":
                cut = True  # the mark belongs to a run of marks
            elif not earlier or _kind(earlier[-1]) != "?":
                first, one = _normal(segments[i][0])[0], len(segments[i]) == 1
                second = _normal(segments[i + 1][0])[0] if one and i + 1 < len(segments) else ""
                if first in "stmd":
                    forced = i + 1 if one else forced
                elif first + second in ("re", "ve", "ll"):
                    forced = i + 2 if len(segments[i + 1]) == 1 else forced
                else:
                    cut = True
        else:
            cut = True
        if cut:
            out.append("".join(segments[low:i]))
            low = i
    return [*out, "".join(segments[low:])] if text else []


class PrefixCounter:
    """Prefix counts for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in file["added_tokens"]) or "(?!)")
        if model["end_of_word_suffix"] != END or model["continuing_subword_prefix"]:
            raise ValueError("this counter is for BPE with an end-of-word mark")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Tokens by number: letters, then letters with the end mark, then what each merge makes, in order.
        names = [*LETTER, *(c + END for c in LETTER), *(a + b for a, b in merges)]
        number = {t: i for i, t in enumerate(names)}
        if len(number) != len(names):
            raise ValueError("two merges make one token")
        self.halves = [(i, i) for i in range(512)] + [(number[a], number[b]) for a, b in merges]
        self.merged = {self.halves[i]: i for i in range(512, len(names))}
        self.numbers: dict[str, tuple[int, int]] = {}  # letters -> token that goes on, token that ends; -1: none
        for t, i in number.items():
            bare = t.removesuffix(END)
            a, b = self.numbers.get(bare, (-1, -1))
            self.numbers[bare] = (a, i) if bare != t else (i, b)
        self.longest = max(map(len, self.numbers))
        self.tokenizer = library(path)
        self.pairs: dict[int, bool] = {}
        self.tables: tuple[str, list[int], list[int], list[int]] = "", [-1], [0], []
        self.pieces = Generations(REMEMBERED)
        self.words = Generations(REMEMBERED)
        self.chunks = Generations(REMEMBERED)

    def _holds(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart when their letters are merged anew.

        The last merges on either side of the border are undone, latest first, as far as the border's
        neighbours; where two neighbours met that merge before the merge undone last, they would have.
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        latest = 1 << 30
        while self.merged.get((a, b), 1 << 30) >= latest:
            if a < 512 and b < 512:
                return True
            if a > b:  # a was merged after b; equal merges go from the left, so b counts as one later
                latest, a = a, self.halves[a][1]
            else:
                latest, b = b + 1, self.halves[b][0]
        return False

    def piece(self, letters: str) -> list[int]:
        """Token counts of letters[:1], letters[:2], ..., each as a piece of its own.

        What the last piece and this one begin with in common is taken over from its tables.
        """
        was, last, count, out = self.tables
        same = 0
        for x, y in zip(was, letters):
            if x != y:
                break
            same += 1
        last, count, out = last[: same + 1], count[: same + 1], out[:same]
        self._extend(letters, last, count, out)
        self.tables = letters, last, count, out
        return out

    def _extend(self, letters: str, last: list[int], count: list[int], out: list[int]) -> None:
        """Carries the tables of a prefix of the letters on to all of them."""
        holds, numbers = self._holds, self.numbers.get
        for i in range(len(out) + 1, len(letters) + 1):
            goes = ends = token = 0
            for j in range(max(0, i - self.longest), i):
                t = numbers(letters[j:i])
                if t is None:
                    continue
                a, b = t
                if a >= 0 and not goes and (j == 0 or holds(last[j], a)):
                    token, goes = a, count[j] + 1
                if b >= 0 and not ends and (j == 0 or holds(last[j], b)):
                    ends = count[j] + 1
                if goes and ends:
                    break
            last.append(token)
            count.append(goes)
            out.append(ends)

    def _piece(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable():
            return self.piece(piece)
        raw = piece.encode()
        made = self.piece("".join(map(LETTER.__getitem__, raw)))
        return [made[e - 1] for e in np.cumsum([len(c.encode()) for c in piece]).tolist()]

    def split(self, word: str) -> list[str] | None:
        """The word's pieces in lower case; None if the rule does not fit."""
        low = word.lower()
        if word.isascii() and word.isprintable():
            fits = "<|" not in word and not ("'" in word and CONTRACTION.search(low))
        else:
            fits = len(low) == len(word) and not ODD.search(word) and not CONTRACTION.search(low) and unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", low)
        return PIECES.findall(low) if fits else None

    def counts(self, word: str) -> list[int]:
        """Token counts of each non-empty prefix of a word."""
        return self.counts_of([word])[0]

    def counts_of(self, words: list[str]) -> list[list[int]]:
        """The same for many words; their distinct pieces are worked out in order, so neighbours share tables."""
        pieces = list(map(self.split, words))
        kinds = sorted({p for ps in pieces if ps for p in ps})
        known = dict(zip(kinds, self.pieces.look_up(kinds, lambda ps: list(map(self._piece, ps))), strict=True))
        return [self._by_library(w) if ps is None else known[ps[0]] if len(ps) == 1 else self._run(ps, known) for w, ps in zip(words, pieces, strict=True)]

    @staticmethod
    def _run(pieces: list[str], known: dict[str, list[int]]) -> list[int]:
        out, before = [], 0
        for p in pieces:
            out += [before + c for c in known[p]] if before else known[p]
            before = out[-1]
        return out

    def _by_library(self, word: str) -> list[int]:
        if len(word) > ODD_CHARS:
            return self._long(word)
        return self._prefixes(word)

    def _prefixes(self, word: str) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch([word[: i + 1] for i in range(len(word))], add_special_tokens=False)]

    def _long(self, word: str) -> list[int]:
        """Special strings count from their last character on; up to it they are as any other text."""
        out, before, low = [], 0, 0
        for m in self.special.finditer(word):
            part = self._plain(word[low : m.end() - 1])
            whole = (part[m.start() - low - 1] if m.start() > low else 0) + 1
            out += [before + n for n in [*part, whole]]
            before, low = before + whole, m.end()
        return out + [before + n for n in self._plain(word[low:])]

    def _plain(self, text: str) -> list[int]:
        parts = chunks(text)
        kinds = list(dict.fromkeys(parts))
        return self._run(parts, dict(zip(kinds, self.chunks.look_up(kinds, lambda cs: list(map(self._chunk, cs))), strict=True)))

    def _chunk(self, chunk: str) -> list[int]:
        pieces = None if any(_kind(c) == "?" for c in chunk) else self.split(chunk)
        if pieces is not None:
            return self._run(pieces, {p: self._piece(p) for p in pieces})
        if len(chunk) <= ODD_CHARS:
            return self._prefixes(chunk)
        segments = _segments(chunk)
        normal = "".join(map(_normal, segments))
        kinds = list(map(_kind, normal))
        if len(normal) == len(chunk) and unicodedata.is_normalized("NFC", chunk) and "'" not in chunk and set(kinds) <= {"L", "P"}:
            at = [0, *(i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]), len(kinds)]
            runs = [normal[a:b] for a, b in zip(at, at[1:])]
            return self._run(runs, {r: self._piece(r) for r in runs})
        if set(kinds) == {"L"} and all(_kind(x) == "L" for s in segments for r in range(1, len(s)) for x in _normal(s[:r])):
            return self._changing(segments)
        return self._prefixes(chunk)

    def _changing(self, segments: list[str]) -> list[int]:
        """Counts within one run of letters whose segments change as they grow."""
        done, last, count, out, found = "", [-1], [0], [], []
        for s in segments:
            n = len(done)
            for r in range(1, len(s) + 1):
                del last[n + 1 :], count[n + 1 :], out[n:]
                letters = done + "".join(map(LETTER.__getitem__, _normal(s[:r]).encode()))
                self._extend(letters, last, count, out)
                found.append(out[-1])
            done = letters
        return found

    def steps_of(self, words: list[str]) -> list[bytes]:
        """Count differences of words as signed bytes; wider steps, which are rare, as 4 bytes each with a mark."""
        out = []
        for c in self.counts_of(words):
            d = [c[0], *map(int.__sub__, c[1:], c[:-1])]
            out.append(np.array(d, "<i4").tobytes() + WIDE if max(d) > 127 or min(d) < -128 else bytes(x & 255 for x in d))
        return out

    def totals_of(self, words: list[str]) -> list[int]:
        return [c[-1] for c in self.counts_of(words)]


def _steps(d: bytes) -> np.ndarray:
    return np.frombuffer(d[: -len(WIDE)], "<i4") if d.endswith(WIDE) else np.frombuffer(d, np.int8).astype(np.int32)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def table(c: PrefixCounter, text: str) -> bytes:
    """The text's table; one step beyond a signed byte makes it a table of 4-byte steps with the mark."""
    found = _LETTERS.findall(text)
    words = list({m for m in found if m[0] not in SPACES})
    made = dict(zip(words, c.words.look_up(words, c.steps_of), strict=True))
    parts = [bytes(len(m)) if m[0] in SPACES else made[m] for m in found]
    if any(p.endswith(WIDE) for p in parts):
        return np.concatenate([_steps(p) for p in parts]).astype("<i4").tobytes() + WIDE
    return b"".join(parts)


def tokens_of_prefix(stored: bytes, chars: int) -> int:
    """Tokens of the first `chars` characters, from a stored table."""
    return int(_steps(stored)[: max(0, chars)].sum())


def prefix_within(stored: bytes, budget: int) -> int:
    """Characters of the longest prefix that takes at most `budget` tokens, from a stored table."""
    fits = np.flatnonzero(np.cumsum(_steps(stored)) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


class _Tables(WordTable):
    """Tables of the texts of slices, put together from the steps of their distinct words."""

    def __init__(self, c: PrefixCounter):
        self.counter = c
        super().__init__()

    def clear(self) -> None:
        """Steps of slot i stand in pool[begins[i] : begins[i + 1]]; both arrays have room to spare."""
        self.pool, self.begins, self.wide, self.known = np.zeros(1 << 16, np.int8), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool), 0

    def value_bytes(self) -> int:
        return int(self.begins[self.known]) + 21 * self.known

    def learn(self, words: list[str]) -> int:
        counts = self.counter.counts_of(words)
        sizes = np.fromiter(map(len, counts), np.int64, len(counts))
        steps = np.fromiter(chain.from_iterable(counts), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        firsts = steps[starts]
        steps[1:] -= steps[:-1].copy()
        steps[starts] = firsts
        first, used = self.known, int(self.begins[self.known])
        self.known += len(words)
        self.begins, self.wide, self.pool = room(self.begins, self.known + 1), room(self.wide, self.known), room(self.pool, used + len(steps))
        self.begins[first + 1 : self.known + 1] = used + np.cumsum(sizes)
        self.pool[used : used + len(steps)] = steps.astype(np.int8)
        self.wide[first : self.known] = np.logical_or.reduceat((steps > 127) | (steps < -128), starts)
        return first

    def of(self, part: pa.Array, words: Words) -> tuple[pa.Array, np.ndarray]:
        """The tables of the slice's texts, and the tokens of each whole text by its table."""
        slots = self.slots_of(words)
        letters = words.data[(words.data & 0xC0) != 0x80]  # the first byte of each character
        bounds = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])[words.bounds]
        begins = self.begins[slots]
        sizes = self.begins[slots + 1] - begins
        ends = np.cumsum(sizes)
        steps = np.zeros(len(letters), np.int8)
        steps[~SEP[letters]] = self.pool[np.repeat(begins - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        n = np.diff(np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])[bounds])
        made = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(steps)])
        wide = np.concatenate([[0], np.cumsum(self.wide[slots])])[words.first]
        odd = np.flatnonzero(np.diff(wide))
        if len(odd):
            rows = made.to_pylist()
            for i in odd.tolist():
                rows[i] = table(self.counter, part[i].as_py())
                n[i] = _steps(rows[i]).sum()
            made = pa.array(rows, pa.binary())
        return made, n


class _Totals(WordTable):
    """Tokens of words."""

    def __init__(self, c: PrefixCounter):
        self.counter = c
        super().__init__()

    def clear(self) -> None:
        self.totals, self.known = np.zeros(1 << 14, np.int64), 0

    def value_bytes(self) -> int:
        return 20 * self.known

    def learn(self, words: list[str]) -> int:
        first = self.known
        self.totals = room(self.totals, first + len(words))
        self.totals[first : first + len(words)] = self.counter.totals_of(words)
        self.known += len(words)
        return first

    def of(self, part: pa.Array, words: Words) -> np.ndarray:
        """Tokens of each text of the slice."""
        return np.diff(np.concatenate([[0], np.cumsum(self.totals[self.slots_of(words)])])[words.first])


class _ByLibrary:
    """Tokens of whole texts by a vocabulary that the rule is not made for."""

    def __init__(self, path: str):
        self.encoder = encoder(path)

    def of(self, part: pa.Array, words: Words) -> np.ndarray:
        return np.diff(self.encoder.ids(words)[1])


@lru_cache(maxsize=2)
def _worker(tokenizer: str, with_table: bool) -> _Tables | _Totals | _ByLibrary:
    """What counts, kept from task to task."""
    if not drops_spaces(tokenizer):
        return _ByLibrary(tokenizer)
    return _Tables(counter(tokenizer)) if with_table else _Totals(counter(tokenizer))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, with_table: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row, and on request prefix_table.

    Prefix tables are for vocabulary files that `drops_spaces`; whole texts are counted by any.  Null texts
    count as empty: no bytes, no tokens, an empty table.  Rows with equal or null ids each give a row; other
    columns are ignored; an empty table gives no rows.
    """
    if with_table and not drops_spaces(tokenizer):
        raise ValueError(f"no prefix tables by {tokenizer}: its pieces cross white space")
    prepare(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + (", prefix_table binary" if with_table else "")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(tokenizer, with_table)
        for batch in batches:
            column = text_column(batch.column(1))
            for low, high, words in slices(column):
                part = column.slice(low, high - low)
                made, n = worker.of(part, words) if with_table else (None, worker.of(part, words))
                columns = {"doc_id": batch.column(0).slice(low, high - low), "n_bytes": pc.binary_length(part).cast(pa.int64()), "n_tokens": n, "over_limit": n > limit}
                if with_table:
                    columns["prefix_table"] = made
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, schema)
