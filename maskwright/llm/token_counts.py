"""Exact token counts of every prefix of a text, by dynamic programming.

For a vocabulary of word pieces with word ends (byte-level BPE, merges in order of birth).
A word's tokens are those of its longest proper prefix that is followed by a token which
*keeps apart* from the prefix's last token: two tokens keep apart if merging their joined
text gives the same two again, and a sequence is a word's encoding just if all neighbours
keep apart. So one row of last tokens over the bytes of a word, and a second row of tokens
that end a word, give the token count of the word cut off at any place. Nothing is merged,
and cost is linear in a word's length.

``prefix_counts`` stores, per text, the change of the token count at each code point; the
running sum up to a place is the count of the text cut off there. ``count_at``, ``fitting``
and ``over`` answer what a prefix costs, which prefix fits a budget and whether a text
exceeds it, from the stored steps alone. Counts are not monotone: one letter more can join
several tokens, so the longest fitting prefix is the last place within the budget.

Texts are normalised (NFC, lower case), split by the vocabulary's own pattern and cut at
the strings of its special tokens, each of which is one token; a special string that is cut
off is ordinary text. Places are code points of the normalised text, which are those of the
text itself where it is in NFC and its letters keep their number in lower case.

A task holds the vocabulary, at most ``CACHE_WORDS`` counted words and one block of texts.

Defined cases: a null or empty text has no steps and no tokens; a very long word or text
is counted in linear time; repeated rows are counted each; an empty table gives an empty
one; columns of the input named like an added one are replaced, all others pass through.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from maskwright.llm import textbytes as tb

CACHE_WORDS = 1_000_000
CACHE_PAIRS = 500_000
#: White space of the vocabulary's patterns below U+0250, and all texts of letters from there
#: but the one whose lower case is two letters. They are in NFC whatever stands beside what.
SPACES = "\t-\r \x85\xa0"
SIMPLE = re.compile("[\0-\u012f\u0131-\u024f]*")


def simple_pattern(pattern: str) -> re.Pattern:
    """The pattern for such texts, with classes (which it has in brackets only) spelt out,
    or a run of white space, so that matches cover a text."""
    kinds = {c: unicodedata.category(c)[0] for c in map(chr, range(0x250))}
    for name, kind in ((r"\p{L}", "L"), (r"\p{N}", "N")):
        pattern = pattern.replace(name, "".join(c for c in kinds if kinds[c] == kind))
    return re.compile(pattern.replace(r"\s", SPACES) + f"|[{SPACES}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    """What a task needs of a vocabulary file, as plain values that can be shipped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as held:
            spec = json.load(held)
        model, kinds = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if (model["type"], kinds, split["type"], split["invert"]) != ("BPE", ["NFC", "Replace", "Lowercase"], "Split", True):
            raise ValueError(f"{path} is not a vocabulary of lower-case words with word ends")
        self.pattern = split["pattern"]["Regex"]
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        end, letters = model["end_of_word_suffix"], {c: b for b, c in byte_letters().items()}
        numbers = model["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        #: Of each token: when it was born (symbols before all merges), and its two halves.
        self.born = np.full(max(numbers.values()) + 1, -1, dtype=np.int64)
        self.left, self.right = self.born.copy(), self.born.copy()
        for k, (a, b) in enumerate(merges):
            made = numbers[a + b]
            if self.born[made] >= 0 or max(self.born[numbers[a]], self.born[numbers[b]]) >= k:
                raise ValueError(f"{path}: a token is made twice, or of one that comes later")
            self.born[made], self.left[made], self.right[made] = k, numbers[a], numbers[b]
        self.joins = {(numbers[a] << 32) | numbers[b]: k for k, (a, b) in enumerate(merges)}
        as_bytes = lambda token: bytes(letters[c] for c in token)
        #: Byte string -> its token inside a word and its token at a word's end, -1 for none.
        #: Other beginnings of tokens have an empty entry: a search along a word goes on there.
        self.known: dict[bytes, tuple] = {}
        for token, number in numbers.items():
            if token in self.specials:
                continue
            final = token.endswith(end)
            data = as_bytes(token[: -len(end)] if final else token)
            for k in range(1, len(data)):
                self.known.setdefault(data[:k], ())
            held = self.known.get(data) or (-1, -1)
            self.known[data] = (held[0], number) if final else (number, held[1])


class Counter:
    """A task's words, and the steps of the token count at each of their letters."""

    def __init__(self, held: Vocabulary):
        self.held = held
        self.born, self.left, self.right = held.born.tolist(), held.left.tolist(), held.right.tolist()
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, list[tuple[int, int]]] = {}
        self.steps: dict[str, bytes] = {}
        self.totals: dict[str, int] = {}
        self.older: dict[str, int] = {}  # of which words still met come back
        self.pieces = simple_pattern(held.pattern)
        self.words = pre_tokenizers.Split(Regex(held.pattern), behavior="removed", invert=True)
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.special = re.compile("|".join(map(re.escape, held.specials))) if held.specials else None

    def _edge(self, token: int, half: list[int]) -> list[tuple[int, int]]:
        """The symbols at one border of a token while it grows, and the rank at which the
        next merge takes each in."""
        key = token << 1 | (half is self.left)
        found = self.edges.get(key)
        if found is None:
            found, rank = [], len(self.born)
            while token >= 0:
                found.append((token, rank))
                token, rank = half[token], self.born[token]
            self.edges[key] = found
        return found

    def apart(self, first: int, second: int) -> bool:
        """Whether no merge crosses the border of two neighbouring tokens. On either side
        the symbol at the border grows by merges of rising rank; a pair across it is merged
        if its rank comes while both are there. Of equal ranks the left one is merged first."""
        joins, right = self.held.joins, self._edge(second, self.left)
        for a, a_ends in self._edge(first, self.right):
            for b, b_ends in right:
                rank = joins.get(a << 32 | b)
                if rank is not None and rank < a_ends and rank <= b_ends:
                    return False
        return True

    def follows(self, first: int, second: int) -> bool:
        """``apart``, worked out once a pair."""
        key = first << 32 | second
        out = self.pairs.get(key)
        if out is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            out = self.pairs[key] = self.apart(first, second)
        return out

    def counts(self, word: str, cut_off: bool = True) -> list[int]:
        """Tokens of the word cut off after each of its letters; without ``cut_off`` only
        the last of them, those of the whole word, is worked out and the rest are zero."""
        data = word.encode()
        known, pairs, n = self.held.known.get, self.pairs.get, len(data)
        last, upto, ended = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, count = last[start], upto[start] + 1
            for end in range(start + 1, n + 1):
                row = known(data[start:end])
                if row is None:
                    break
                if not row:
                    continue
                token, final = row
                if token >= 0 and last[end] < 0:
                    fits = not start or pairs(before << 32 | token)
                    if fits is None:
                        fits = self.follows(before, token)
                    if fits:
                        last[end], upto[end] = token, count
                if final >= 0 and (cut_off or end == n) and not ended[end]:
                    fits = not start or pairs(before << 32 | final)
                    if fits is None:
                        fits = self.follows(before, final)
                    if fits:
                        ended[end] = count
        if n == len(word):
            return ended[1:]
        return [ended[k] for k in accumulate(len(c.encode()) for c in word)]

    def _cut_word(self, word: str) -> list[int]:
        """``counts``, but a word whose beginning the pattern sees as several words (a
        contraction cut off) counts as those there."""
        whole = self.counts(word)
        if word[0] == "'":
            for k in range(2, len(word)):
                parts = [p for p, _ in self.words.pre_tokenize_str(word[:k])]
                if len(parts) > 1:
                    whole[k - 1] = sum(self.counts(p)[-1] for p in parts)
        return whole

    def split(self, text: str) -> tuple[list[str], set[str]]:
        """All of a normalised text in order, and which of its pieces are white space."""
        if SIMPLE.fullmatch(text):
            pieces = self.pieces.findall(text.lower())
            return pieces, {p for p in set(pieces) if p[0] in "\t\n\v\f\r \x85\xa0"}
        pieces, gaps, upto, text = [], set(), 0, self.normalizer.normalize_str(text)
        for word, (start, end) in [*self.words.pre_tokenize_str(text), ("", (len(text), len(text)))]:
            if start > upto:
                gaps.add(text[upto:start])
                pieces.append(text[upto:start])
            if word:
                pieces.append(word)
            upto = end
        return pieces, gaps

    def _steps_of(self, word: str) -> bytes:
        counts = self._cut_word(word)
        return array("i", map(sub, counts, [0, *counts[:-1]])).tobytes()

    def _ordinary(self, text: str) -> np.ndarray:
        pieces, gaps = self.split(text)
        different = set(pieces)
        if len(self.steps) + len(different) > CACHE_WORDS // 4:  # a word's steps are larger than its total
            self.steps = {p: self.steps[p] for p in different if p in self.steps}
        for piece in different:
            if piece not in self.steps:
                self.steps[piece] = bytes(4 * len(piece)) if piece in gaps else self._steps_of(piece)
        return np.frombuffer(b"".join(map(self.steps.__getitem__, pieces)), dtype=np.int32)

    def _learn_totals(self, different: set[str], gaps: set[str]) -> None:
        if len(self.totals) + len(different) > CACHE_WORDS // 2:
            self.older, self.totals = self.totals, {}
        for piece in different:
            if piece not in self.totals:
                if (known := self.older.get(piece)) is None:
                    known = 0 if piece in gaps else self.counts(piece, False)[-1]
                self.totals[piece] = known

    def budget(self, text: str | None, budget: int) -> tuple[int, int]:
        """Tokens of the text, and places of its longest prefix of at most ``budget``. The
        counts at the pieces' ends tell which piece the prefix ends in, and only that one's
        own counts are needed."""
        if not text:
            return 0, 0
        if self.special and self.special.search(text):
            counts = np.cumsum(self.text_steps(text), dtype=np.int64)
            within = np.flatnonzero(counts <= budget)
            return int(counts[-1]), int(within[-1]) + 1 if len(within) else 0
        pieces, gaps = self.split(text)
        self._learn_totals(set(pieces), gaps)
        counts = list(map(self.totals.__getitem__, pieces))
        total = sum(counts)
        if total <= budget:
            return total, sum(map(len, pieces))
        before = [0, *accumulate(counts)]
        last = min(bisect_right(before, budget) - 1, len(pieces) - 1)
        fit = sum(map(len, pieces[:last]))
        inside = np.full(len(pieces[last]), before[last]) if pieces[last] in gaps else before[last] + np.array(self._cut_word(pieces[last]))
        within = np.flatnonzero(inside <= budget)
        return total, fit + int(within[-1]) + 1 if len(within) else fit

    def text_steps(self, text: str | None) -> np.ndarray:
        """The change of the token count at each place of the text."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        found = list(self.special.finditer(text)) if self.special else []
        if not found:
            return self._ordinary(text)
        out, start = [], 0
        for at in found:
            cut = self._ordinary(text[start : at.end() - 1])  # the special string cut off is ordinary
            before = int(cut[: len(cut) - (at.end() - 1 - at.start())].sum())
            out += [cut, np.array([before + 1 - int(cut.sum())], dtype=np.int32)]
            start = at.end()
        return np.concatenate([*out, self._ordinary(text[start:])])


def vocabulary(spark, path: str):
    """The vocabulary at ``path``, ready to be shipped; its size is fixed by the file."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def _mapped(docs: DataFrame, held, text: str, keep_text: bool, added: str, make) -> DataFrame:
    names = [f.split()[0] for f in added.split(", ")]
    kept = docs.drop(*names)
    fields = [f for f in kept.schema if keep_text or f.name != text]

    def run(batches):
        counter = Counter(held.value)
        for batch in batches:
            for part in tb.blocks(batch, text):
                columns = make(counter, part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in fields), *columns], names=[*(f.name for f in fields), *names]
                )

    return kept.mapInArrow(run, tb.schema(fields, added))


def prefix_counts(docs: DataFrame, held, text: str = "text") -> DataFrame:
    """``docs`` with ``steps``, from which every prefix's token count follows."""

    def make(counter, texts):
        steps = [counter.text_steps(t) for t in texts]
        upto = np.concatenate(([0], np.cumsum([len(s) for s in steps]))).astype(np.int32)
        return [pa.ListArray.from_arrays(upto, np.concatenate([np.zeros(0, np.int32), *steps]))]

    return _mapped(docs, held, text, True, "steps array<int>", make)


def count_at(place: Column | str, steps: Column | str = "steps") -> Column:
    """Tokens of the text cut off after ``place`` code points."""
    steps, place = (F.col(c) if isinstance(c, str) else c for c in (steps, place))
    return F.aggregate(F.slice(steps, 1, F.greatest(place, F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda n, s: n + s)


def fitting(budget: Column | int, steps: Column | str = "steps") -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    steps = F.col(steps) if isinstance(steps, str) else steps
    budget = F.lit(budget).cast("long") if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at"), F.lit(0).alias("best"))
    return F.aggregate(
        steps, start,
        lambda a, s: F.struct(
            (a.n + s).alias("n"), (a.at + 1).alias("at"), F.when(a.n + s <= budget, a.at + 1).otherwise(a.best).alias("best")
        ),
        lambda a: a.best,
    )


def over(budget: Column | int, steps: Column | str = "steps") -> Column:
    """Whether the whole text has more than ``budget`` tokens."""
    steps = F.col(steps) if isinstance(steps, str) else steps
    return F.aggregate(steps, F.lit(0).cast("long"), lambda n, s: n + s) > budget


def budgets(docs: DataFrame, held, budget: int, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``over_limit`` and ``n_fit``, the code
    points of the longest prefix within ``budget``; the steps of one text at a time live in
    a task and none are written."""

    def make(counter, texts):
        total, fit = zip(*(counter.budget(t, budget) for t in texts))
        return [pa.array(total, pa.int64()), pa.array([n > budget for n in total]), pa.array(fit, pa.int64())]

    return _mapped(docs, held, text, False, "n_tokens long, over_limit boolean, n_fit long", make)
