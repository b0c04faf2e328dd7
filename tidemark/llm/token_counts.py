"""Exact token counts at every prefix by dynamic programming.

A prefix's encoding ends in exactly one token: the only vocabulary entry that
is a suffix of the prefix and stays apart from the last token of what comes
before it.  So count[i] = count[i - len(last[i])] + 1, and one pass over a word
gives the counts of all its prefixes; whether two tokens stay apart is a fact
about the pair and is remembered.  Words don't influence each other, so running
sums over words extend the table to whole texts.

Suffixes are found in a trie of reversed tokens.  Words of up to ``SIDE`` bytes
go side by side through numpy, longer ones byte by byte; either way the work
grows with the length, whatever the script.
"""

from __future__ import annotations

import functools
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.bpe import BREAK, PairTable, WordBPE, byte_letters, word_level
from tidemark.llm.common import map_texts
from tidemark.llm.pieces import MEMO_ENTRIES, PieceMemo, Pieces, WordTable, spans

#: Bytes up to which words are counted side by side, and bytes of words that are at one time.
SIDE, BLOCK = 64, 400_000
OPEN, CLOSED = 0, 1


@functools.cache
def joining() -> frozenset[str]:
    """Characters that may combine with what stands before them: marks, the
    second parts of compositions, and Hangul vowels and finals."""
    every = map(chr, range(0x110000))
    parts = {c for c in every if unicodedata.combining(c)}
    for c in map(chr, range(0x110000)):
        plan = unicodedata.decomposition(c)
        if plan and plan[0] != "<" and " " in plan:
            parts.add(chr(int(plan.split()[1], 16)))
    return frozenset(parts | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))


class WordTableOfPrefixes:
    """Last token and count of each prefix of one word, in bytes: as the start of a longer word."""

    def __init__(self, counts: PrefixCounts, raw: bytes):
        self.counts, self.raw = counts, raw
        self.last, self.count = [-1], [0]
        for stop in range(1, len(raw) + 1):
            try:
                token, n = counts.step(raw, stop, OPEN, self.last, self.count)
            except ValueError:  # a word's end may be where only a whole word has an encoding
                token, n = -1, 0
            self.last.append(token)
            self.count.append(n)

    def whole(self, stop: int) -> int:
        """Count of the first ``stop`` bytes as a word of its own."""
        return self.counts.step(self.raw, stop, CLOSED, self.last, self.count)[1] if stop else 0

    def with_tail(self, stop: int, tail: bytes) -> int:
        """Count of the word that goes on with ``tail`` after ``stop`` bytes."""
        reach = max(0, stop - self.counts.longest)
        raw = self.raw[reach:stop] + tail
        last, count = self.last[reach : stop + 1], self.count[reach : stop + 1]
        for k in range(stop - reach + 1, len(raw)):
            token, n = self.counts.step(raw, k, OPEN, last, count, reach > 0)
            last.append(token)
            count.append(n)
        return self.counts.step(raw, len(raw), CLOSED, last, count, reach > 0)[1] if raw else 0


class PrefixCounts:
    def __init__(self, coder: WordBPE):
        self.coder = coder
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        size = max(coder.vocab.values()) + 1
        self.symbols: list[list[int]] = [[] for _ in range(size)]
        child: dict[int, int] = {}
        token_at: list[int] = [-1, -1]  # the roots of open and closed tokens
        self.longest = 0
        for name, i in coder.vocab.items():
            closed = name.endswith(coder.END)
            raw = [back[c] for c in (name[: -len(coder.END)] if closed else name)]
            own = coder.base[raw].tolist()
            if closed:
                own[-1] = int(coder.last[raw[-1]])
            self.symbols[i] = own
            self.longest = max(self.longest, len(raw))
            node = CLOSED if closed else OPEN
            for b in reversed(raw):
                key = node << 8 | b
                node = child.get(key)
                if node is None:
                    node = child[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = i
        self.child, self.token_at = child, token_at
        self.child_table = PairTable(np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child)))
        self.tokens = np.array(token_at, dtype=np.int64)
        self.lengths = np.array(list(map(len, self.symbols)), dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.array([s for own in self.symbols for s in own], dtype=np.int64)
        ids, counts = coder.merges.encode(self.flat, np.maximum(self.lengths, 0)[self.lengths > 0])
        real = np.flatnonzero(self.lengths)
        self.whole = np.zeros(size, dtype=bool)
        first = np.cumsum(counts) - counts
        self.whole[real] = (counts == 1) & (ids[first] == real)
        self.rule: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, rule in enumerate(coder.rules):
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            self.rule[coder.vocab[a], coder.vocab[b]] = (rank, coder.vocab[a + b])
        self.pairs: dict[int, bool] = {}
        self.pair_table = WordTable()
        self.memo = PieceMemo(self._count_pieces)

    # one word

    def _merged(self, symbols: list[int]) -> list[int]:
        symbols = list(symbols)
        while len(symbols) > 1:
            found = [(*self.rule[p], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in self.rule]
            if not found:
                break
            _, made, k = min(found, key=lambda f: (f[0], f[2]))
            symbols[k : k + 2] = [made]
        return symbols

    def _apart(self, left: int, right: int) -> bool:
        key = left << 20 | right
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > MEMO_ENTRIES:
                self.pairs.clear()
            got = self.pairs[key] = self._merged(self.symbols[left] + self.symbols[right]) == [left, right]
        return got

    def step(self, raw: bytes, stop: int, root: int, last: list[int], count: list[int], cut: bool = False) -> tuple[int, int]:
        """Last token and token count of raw[:stop], the last token out of the trie of ``root``.
        ``cut`` says that ``raw`` isn't held from the word's start: there is a token before it."""
        node, fits = root, []
        for at in range(stop - 1, -1, -1):
            node = self.child.get(node << 8 | raw[at])
            if node is None:
                break
            if self.token_at[node] >= 0:
                fits.append((at, self.token_at[node]))
        for at, token in reversed(fits):
            if (last[at] >= 0 and self._apart(last[at], token)) if at or cut else self.whole[token]:
                return token, count[at] + 1
        raise ValueError("no encoding of this prefix")

    def word_count(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        table = WordTableOfPrefixes(self, raw[:-1])
        return self.step(raw, len(raw), CLOSED, table.last, table.count)[1]

    # many words

    def _all_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.pair_table.used > 2 * MEMO_ENTRIES:
            self.pair_table = WordTable()
        a, b = left.astype(np.uint64), right.astype(np.uint64)
        found = self.pair_table.look(a, b)
        if (miss := np.flatnonzero(found < 0)).size:
            key, where = np.unique(left[miss] << 20 | right[miss], return_inverse=True)
            x, y = key >> 20, key & ((1 << 20) - 1)
            both = np.stack([x, y], axis=1).ravel()
            ids, counts = self.coder.merges.encode(self.flat[spans(self.starts[both], self.lengths[both])], self.lengths[x] + self.lengths[y])
            first = np.cumsum(counts) - counts
            two = counts == 2
            fine = np.zeros(len(key), dtype=np.int64)
            fine[two] = (ids[first[two]] == x[two]) & (ids[first[two] + 1] == y[two])
            self.pair_table.add(x.astype(np.uint64), y.astype(np.uint64), fine)
            found[miss] = fine[where]
        return found == 1

    def _side_by_side(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Counts of words that lie one after the other in ``raw``."""
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(raw)) - np.repeat(starts, sizes)  # of each byte in its word
        at, node = np.arange(len(raw)), np.full(len(raw), OPEN, dtype=np.int64)
        node[starts + sizes - 1] = CLOSED
        ends, tokens, lengths = [], [], []
        for length in range(1, self.longest + 1):
            node = self.child_table.look(node << 8 | raw[at - length + 1].astype(np.int64))
            there = node >= 0
            at, node = at[there], node[there]
            token = self.tokens[node]
            fits = token >= 0
            ends.append(at[fits]), tokens.append(token[fits]), lengths.append(np.full(int(fits.sum()), length))
            inside = place[at] >= length
            at, node = at[inside], node[inside]
            if not at.size:
                break
        end, token, length = np.concatenate(ends), np.concatenate(tokens), np.concatenate(lengths)
        order = np.argsort(end, kind="stable")  # by end, short tokens first
        token, length = token[order], length[order]
        upto = np.cumsum(np.bincount(end, minlength=len(raw)))
        last, count = np.full(len(raw), -1, dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
        live = np.argsort(-sizes, kind="stable")
        n_live = np.searchsorted(-sizes[live], -np.arange(1, int(sizes.max()) + 1), side="right")
        for stop, n in enumerate(n_live.tolist(), 1):
            todo = starts[live[:n]] + stop - 1
            tried = 0
            while todo.size:
                k = upto[todo] - 1 - tried
                t, m = token[k], length[k]
                begins = m == stop
                good = self.whole[t]
                left = last[todo - np.where(begins, 0, m)]
                rest = np.flatnonzero(~begins)
                good[rest] = (left[rest] >= 0) & self._all_apart(left[rest], t[rest])
                hit = todo[good]
                last[hit] = t[good]
                count[hit] = np.where(begins[good], 0, count[hit - m[good]]) + 1
                # what has no candidate left is no start of an encoding: it stays at -1
                go = ~good & (k > np.where(todo > 0, upto[todo - 1], 0))
                todo, tried = todo[go], tried + 1
        return count[starts + sizes - 1]

    def _count_words(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(sizes > SIDE).tolist():
            out[k] = self.word_count(raw[starts[k] : starts[k] + sizes[k]].tobytes().decode("utf-8", "surrogatepass"))
        short = np.flatnonzero(sizes <= SIDE)
        block = np.cumsum(sizes[short]) // BLOCK
        for own in np.split(short, np.flatnonzero(np.diff(block)) + 1):
            if own.size:
                out[own] = self._side_by_side(raw[spans(starts[own], sizes[own])], sizes[own])
        return out

    def _count_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special, coder = self.coder.special, self.coder
        plain, extra = [], np.zeros(len(pieces), dtype=np.int64)
        for k, piece in enumerate(pieces):
            if special and "<" in piece and special.search(piece):
                parts = special.split(piece)
                extra[k] = len(parts) // 2 + sum(self._part_count(p) for p in parts[::2] if p)
                piece = ""
            plain.append(piece.replace(BREAK, " ") if BREAK in piece else piece)
        words = coder.SPLIT_BREAK.findall(coder.normalise(BREAK.join([*plain, ""])))
        breaks = np.fromiter(map(BREAK.__eq__, words), dtype=bool, count=len(words))
        text = "".join(words)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        places = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        stops = places[np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))]
        sizes = np.diff(stops, prepend=0)
        counts = np.zeros(len(words), dtype=np.int64)
        real = np.flatnonzero(~breaks)
        counts[real] = self._count_words(raw[spans((stops - sizes)[real], sizes[real])], sizes[real])
        total = np.cumsum(counts)[np.flatnonzero(breaks)]
        return np.diff(total, prepend=0) + extra, np.ones(len(pieces), dtype=np.int64)

    def _part_count(self, part: str) -> int:
        return sum(map(self.word_count, self.coder.SPLIT.findall(self.coder.normalise(part))))

    # prefixes

    def _part_prefixes(self, part: str, tails: list[str]) -> Iterator[tuple[int, int]]:
        """For k = 1..len(part) the count of part[:k], and then that of ``part`` followed by
        each of ``tails``; with each the count of the words that no later character can change."""
        normalise, split = self.coder.normalise, self.coder.SPLIT
        marks = joining() if not part.isascii() else ()
        begins = [k for k, c in enumerate(part) if not k or c not in marks] + [len(part)]
        units = [normalise(part[a:b]) for a, b in zip(begins, begins[1:])]
        places = [0, *accumulate(map(len, units))]
        text = "".join(units)
        words = [m.span() for m in split.finditer(text)]
        stops = [e for _, e in words]
        before = [0]  # counts of the words before each
        tables: dict[int, tuple] = {}

        def table(w: int) -> tuple:
            if w not in tables:
                tables.clear()
                word = text[slice(*words[w])]
                tables[w] = WordTableOfPrefixes(self, word.encode("utf-8", "surrogatepass")), [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word)]
            return tables[w]

        def upto(w: int) -> int:
            while len(before) <= w:
                k = len(before) - 1
                own, offsets = table(k)
                before.append(before[-1] + own.whole(offsets[-1]))
            return before[w]

        def counted(q: int, tail: str) -> tuple[int, int]:
            """Counts of text[:q] + tail, all of it and without its last word."""
            w = bisect_left(stops, q)  # the word in which or at whose end q lies
            if w == len(words) or words[w][0] >= q:
                ends = [self.word_count(x) for x in split.findall(tail)]
                return upto(w) + sum(ends), upto(w)
            start, safe = words[w][0], upto(w)
            own, offsets = table(w)
            run = words[w][1] - start > 3  # of letters or of marks; what is shorter may be a contraction
            if run and not tail:
                return safe + own.whole(offsets[q - start]), safe
            near = max(start, q - 2) if run else start  # two characters show how the word goes on
            first, *more = split.findall(text[near:q] + tail)
            rest = sum(map(self.word_count, more))
            if len(first) < q - near:  # a contraction comes apart
                return safe + self.word_count(first) + rest, safe
            if len(first) == q - near:
                return safe + own.whole(offsets[q - start]) + rest, safe
            return safe + own.with_tail(offsets[q - start], first[q - near :].encode("utf-8", "surrogatepass")) + rest, safe

        for j, (a, b) in enumerate(zip(begins, begins[1:])):
            for k in range(a + 1, b):
                yield counted(places[j], normalise(part[a:k]))
            yield counted(places[j + 1], "")
        for tail in tails:
            yield counted(places[-1], normalise(tail))

    def piece_prefixes(self, piece: str) -> Iterator[tuple[int, int]]:
        """For k = 1..len(piece) the count of piece[:k], and a bound that no later prefix is below."""
        parts = self.coder.special.split(piece) if self.coder.special else [piece]
        total = 0
        for j in range(0, len(parts), 2):
            # a special token's own beginnings are plain text after the part before it
            special = parts[j + 1] if j + 1 < len(parts) else ""
            for n, safe in self._part_prefixes(parts[j], [special[:k] for k in range(1, len(special))]):
                yield total + n, total + safe
            total += self._part_count(parts[j])
            if special:
                total += 1
                yield total, total

    def prefixes(self, text: str) -> list[int]:
        """Exact token counts of text[:k] for k = 0..len(text)."""
        pieces = Pieces([text])
        out, total, at = [0], 0, 0
        for k in range(len(pieces.starts)):
            piece = pieces.text(k)
            start = text.index(piece, at)
            out += [total] * (start - at)
            out += [total + n for n, _ in self.piece_prefixes(piece)]
            total, at = out[-1], start + len(piece)
        return out + [total] * (len(text) - at)

    def counts(self, texts: list[str], limit: int) -> tuple[list[int], list[int]]:
        """Token counts, and the lengths of the longest prefixes of at most ``limit`` tokens:
        read off the prefix table of the one piece in which the limit falls."""
        pieces = Pieces(texts)
        numbers = self.memo.numbers(pieces)
        own = self.memo.flat[self.memo.starts[numbers]]
        running = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        firsts = np.concatenate([[0], pieces.upto[:-1]])
        totals = running[pieces.upto] - running[firsts]
        fits = list(map(len, texts))
        for d in np.flatnonzero(totals > limit).tolist():
            first = int(firsts[d])
            k = int(np.searchsorted(running[first + 1 :], running[first] + limit, side="right")) + first
            room = limit - int(running[k] - running[first])
            start = int(pieces.stops[d - 1]) if d else 0
            fits[d] = len(pieces.raw[start : pieces.starts[k]].decode("utf-8", "surrogatepass"))
            best = 0
            for j, (n, safe) in enumerate(self.piece_prefixes(pieces.text(k)), 1):
                if n <= room:
                    best = j
                elif safe > room:
                    break
            fits[d] += best
        return totals.tolist(), fits


@functools.lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(word_level(path))


FIELDS = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("over_limit", T.BooleanType()),
    T.StructField("fit_chars", T.LongType()),
])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Token counts of whole texts, one output row a row, without a shuffle.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and
    fit_chars, the length of the longest prefix that has at most ``limit``
    tokens.  A null text counts as empty: zeros and false.  A null doc_id is
    kept, equal rows each get a row, an empty table gives an empty one; other columns
    aren't read.  Very long texts take time in proportion to their length, also
    without any white space; only a single character with thousands of combining
    marks is normalised again for each of them.
    """

    def make() -> Callable[[list[str]], dict[str, list]]:
        table = prefix_counts(vocabulary)

        def work(texts: list[str]) -> dict[str, list]:
            totals, fits = table.counts(texts, limit)
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": totals, "over_limit": [n > limit for n in totals], "fit_chars": fits}

        return work

    return map_texts(docs, make, FIELDS)
