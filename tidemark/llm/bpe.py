"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token of n symbols has n - 1 adjacent pairs.  The leaves of a segment
tree hold each pair's merge rank together with its position, so that the root
is the leftmost pair of the lowest rank.  A merge rewrites one symbol and at
most three leaves, each update costs a walk to the root; this goes on until the
root says that no pair can be merged.  Many pre-tokens of like length are
encoded side by side in numpy arrays, one tree a row.

Vocabularies are read from public tokenizer files; nothing is trained here.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_texts
from tidemark.llm.pieces import MEMO_BYTES, MEMO_ENTRIES, PieceMemo, spans

INF = np.int64(1) << 62
#: Symbols from which a word may get a tree of its own instead of a row among others.
LONE = 256


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    bytes stand for themselves, the others get the code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairTable:
    """Values of whole numbers above zero, looked up many at a time by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while left.size:
            free = self.keys[slot[left]] == -1
            _, first = np.unique(np.where(free, slot[left], -1 - left), return_index=True)
            put = np.zeros(len(left), dtype=bool)
            put[first] = True
            put &= free
            self.keys[slot[left[put]]], self.values[slot[left[put]]] = keys[left[put]], values[left[put]]
            left = left[~put]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Their values, -1 for keys that aren't here."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        slot = slot[left]
        while left.size:
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (there != -1)
            left, slot = left[go], slot[go]
        return out


class Merges:
    """Merge rules as sorted arrays, and the trees that apply them."""

    def __init__(self, vocab: dict[str, int], merges: list):
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in rules], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in rules], dtype=np.int64)
        # of a rule that is listed twice the last one counts
        _, last = np.unique(keys[::-1], return_index=True)
        order = len(keys) - 1 - last
        self.table = PairTable(keys[order], order)
        self.rule: dict[int, int] | None = None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is no rule."""
        return self.table.look((left << 20) | right)

    def encode(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids and their counts of words that lie one after the other as
        base symbols.  Words of a size class share one array of trees."""
        starts = np.cumsum(lengths) - lengths
        counts = lengths.copy()
        classes = np.zeros(len(lengths), dtype=np.int64)
        long = lengths > 1
        classes[long] = np.ceil(np.log2(lengths[long])).astype(np.int64)
        done = []
        for power in np.unique(classes[long]):
            wide = 1 << int(power)
            members = np.flatnonzero(long & (classes == power))
            step = max(1, (1 << 17) // wide)
            if wide > LONE and len(members) < wide // LONE:  # few and long: trees one by one
                for k in members.tolist():
                    ids = np.array(self._merge_one(symbols[starts[k] : starts[k] + lengths[k]].tolist(), wide), dtype=np.int64)
                    counts[k] = len(ids)
                    done.append((np.array([k]), ids))
                continue
            for at in range(0, len(members), step):
                chosen = members[at : at + step]
                length = lengths[chosen]
                inside = np.arange(wide) < length[:, None]
                words = symbols[(starts[chosen][:, None] + np.arange(wide))[inside]]
                ids, counts[chosen] = self._merge(words, inside, length, wide)
                done.append((chosen, ids))
        stops = np.cumsum(counts)
        out = np.empty(stops[-1] if len(stops) else 0, dtype=np.int64)
        short = np.flatnonzero(lengths == 1)
        out[stops[short] - 1] = symbols[starts[short]]
        for chosen, ids in done:
            n = counts[chosen]
            out[np.repeat(stops[chosen] - np.cumsum(n), n) + np.arange(len(ids))] = ids
        return out, counts

    def _merge_one(self, word: list[int], wide: int) -> list[int]:
        """The same for one long word, with plain lists."""
        if self.rule is None:
            real = np.flatnonzero(self.table.keys >= 0)
            self.rule = dict(zip(self.table.keys[real].tolist(), self.table.values[real].tolist()))
        rule, made, shift, n, none = self.rule, self.made, wide.bit_length() - 1, len(word), int(INF)
        tree = [none] * (2 * wide)
        for k in range(n - 1):
            rank = rule.get(word[k] << 20 | word[k + 1])
            if rank is not None:
                tree[wide + k] = rank << shift | k
        for node in range(wide - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] != none:
            place, rank = tree[1] & (wide - 1), tree[1] >> shift
            gone, lead = after[place], before[place]
            follow = after[gone]
            word[place], word[gone], after[place] = int(made[rank]), -1, follow
            leaves = [(gone, none)]
            if follow < n:
                before[follow] = place
                rank = rule.get(word[place] << 20 | word[follow])
                leaves.append((place, none if rank is None else rank << shift | place))
            else:
                leaves.append((place, none))
            if lead >= 0:
                rank = rule.get(word[lead] << 20 | word[place])
                leaves.append((lead, none if rank is None else rank << shift | lead))
            for leaf, value in leaves:
                node = wide + leaf
                tree[node] = value
                while node > 1:
                    other = tree[node ^ 1]
                    if other < value:
                        value = other
                    node >>= 1
                    if tree[node] == value:
                        break
                    tree[node] = value
        return [x for x in word if x >= 0]

    def _merge(self, words: np.ndarray, inside: np.ndarray, length: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        rows, shift = len(length), wide.bit_length() - 1
        column = np.arange(wide)
        symbols = np.full((rows, wide), -1, dtype=np.int64)
        symbols[inside] = words
        tree = np.full((rows, 2 * wide), INF, dtype=np.int64)
        r = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, wide - 1)
        ok = (r >= 0) & (column[1:] < length[:, None])
        tree[:, wide : 2 * wide - 1] = np.where(ok, (r << shift) | column[:-1], INF)
        level = wide >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        after = np.tile(column + 1, (rows, 1)).ravel()
        before = np.tile(column - 1, (rows, 1)).ravel()
        flat, nodes = symbols.ravel(), tree.ravel()
        active = np.flatnonzero(tree[:, 1] < INF)
        while active.size:
            root = nodes[active * 2 * wide + 1]
            place, rank = root & (wide - 1), root >> shift
            base, top = active * wide, active * 2 * wide
            gone = after[base + place]
            follow, lead = after[base + gone], before[base + place]
            new = self.made[rank]
            flat[base + place] = new
            flat[base + gone] = -1
            after[base + place] = follow
            has_next, has_last = follow < length[active], lead >= 0
            before[(base + follow)[has_next]] = place[has_next]
            nodes[top + wide + gone] = INF
            leaf = np.full(len(active), INF, dtype=np.int64)
            if has_next.any():
                q = self.rank(new[has_next], flat[(base + follow)[has_next]])
                leaf[has_next] = np.where(q >= 0, (q << shift) | place[has_next], INF)
            nodes[top + wide + place] = leaf
            left = lead[has_last]
            q = self.rank(flat[base[has_last] + left], new[has_last])
            nodes[top[has_last] + wide + left] = np.where(q >= 0, (q << shift) | left, INF)
            tops = np.concatenate([top, top, top[has_last]])
            walk = np.concatenate([wide + place, wide + gone, wide + left])
            for _ in range(shift):
                walk >>= 1
                nodes[tops + walk] = np.minimum(nodes[tops + 2 * walk], nodes[tops + 2 * walk + 1])
            active = active[nodes[active * 2 * wide + 1] < INF]
        alive = symbols >= 0
        return symbols[alive], alive.sum(axis=1)


class Numbers(dict):
    """Piece -> its number; a piece that is looked up for the first time gets the next one."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


class Memo:
    """What has been worked out for pieces: a row of numbers for each, in one array.

    ``encode(pieces)`` gives the rows of new pieces, one after the other, and their lengths."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.numbers, self.known, self.chars = Numbers(), 0, 0
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def number(self, pieces: Iterable[str], n: int) -> np.ndarray:
        """The numbers of ``n`` pieces; new ones are encoded."""
        if self.known > MEMO_ENTRIES or self.chars > MEMO_BYTES:
            self.clear()
        found = np.fromiter(map(self.numbers.__getitem__, pieces), dtype=np.int64, count=n)
        fresh = len(self.numbers) - self.known
        if fresh:
            new = list(itertools.islice(reversed(self.numbers), fresh))[::-1]
            rows, sizes = self.encode(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, rows.astype(np.uint32)])
            self.known += fresh
            self.chars += sum(map(len, new))
        return found

    def rows(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all pieces one after the other, and each list's share of them."""
        lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        found = self.number(itertools.chain.from_iterable(lists), int(lengths.sum()))
        sizes = self.sizes[found]
        stops = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(lengths)]
        return self.flat[spans(self.starts[found], sizes)], np.diff(stops, prepend=0)


def joined(parts: list[tuple[list[int], np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that were worked out in parts, each with the places of its rows, in order of place."""
    sizes, starts, flat, at = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
    for places, rows, counts in parts:
        sizes[places], starts[places] = counts, at + np.cumsum(counts) - counts
        flat.append(rows)
        at += len(rows)
    return np.concatenate([*flat, np.zeros(0, np.int64)])[spans(starts, sizes)], sizes


#: Stands between pieces that are split together, and its id among base symbols.
BREAK, BREAK_ID = "\u2028", (1 << 20) - 1


def encode_pieces(merges: Merges, split: regex.Pattern, text: str, symbols: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces that BREAK ends in ``text``, and their counts.  All are split by one
    search; a BREAK goes through the merges as a symbol that no rule names."""
    words = split.findall(text)
    raw = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    places = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    stops = places[np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))]
    starts = np.concatenate([[0], stops[:-1]])
    breaks = np.fromiter(map(BREAK.__eq__, words), dtype=bool, count=len(words))
    base = symbols(raw, stops - 1)
    base[starts[breaks]] = BREAK_ID
    keep = np.ones(len(raw), dtype=bool)
    keep[starts[breaks] + 1] = keep[starts[breaks] + 2] = False
    ids, _ = merges.encode(base[keep], np.where(breaks, 1, stops - starts))
    ends = np.flatnonzero(ids == BREAK_ID)
    return ids[ids != BREAK_ID], np.diff(ends, prepend=-1) - 1


def _special(added: list[dict]) -> tuple[re.Pattern | None, dict[str, int]]:
    ids = {a["content"]: a["id"] for a in added}
    longest = sorted(ids, key=len, reverse=True)
    return (re.compile("(" + "|".join(map(re.escape, longest)) + ")") if ids else None), ids


#: White space of the tokenizers' patterns; Python's own classes have four characters more.
SPACE = r"\t\n\v\f\r\x20\x85\xa0  -     　"


class ByteLevelBPE:
    """A byte-level tokenizer file whose pre-tokens keep the space before a word."""

    #: The public split pattern of such vocabularies, fixed values.
    SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    #: Where cutting before every space or line end would not be safe.
    UNEVEN = re.compile(r"\s\s|\A\s|\s\Z")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.merges = Merges(vocab, spec["model"]["merges"])
        letters = byte_letters()
        self.base = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.special, self.special_ids = _special(spec["added_tokens"])
        back = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.special_ids.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.special_text = {i: s for s, i in self.special_ids.items()}
        self.memo = Memo(self._encode_pieces)

    def _symbols(self, raw: np.ndarray, _: np.ndarray) -> np.ndarray:
        return self.base[raw]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces as _pieces() cuts them.  One that ends in white space is a
        whole pre-token, and the look-ahead of the split must not see beyond it."""
        alone = [k for k, p in enumerate(pieces) if p[-1].isspace() or BREAK in p]
        odd = set(alone)
        plain = [k for k in range(len(pieces)) if k not in odd]
        parts = []
        if plain:
            parts.append((plain, *encode_pieces(self.merges, self.SPLIT, "".join(pieces[k] + BREAK for k in plain), self._symbols)))
        for k in alone:
            words = [pieces[k]] if pieces[k].isspace() else self.SPLIT.findall(pieces[k])
            raw = np.frombuffer(pieces[k].encode(), dtype=np.uint8)
            ids, _ = self.merges.encode(self.base[raw], np.array([len(w.encode()) for w in words]))
            parts.append(([k], ids, np.array([len(ids)])))
        return joined(parts, len(pieces))

    def _pieces(self, text: str) -> list[str]:
        """Pieces that can be encoded apart.  Between two visible characters a
        single space or line end starts a new pre-token whatever stands around
        it, so the text may be cut before it; else whole pre-tokens are taken."""
        if not text:
            return []
        if self.UNEVEN.search(text):
            return self.SPLIT.findall(text)
        head, *rest = text.replace("\n", " \n").split(" ")
        return [head, *[p if p[0] == "\n" else " " + p for p in rest]]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        plain, plan = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            plan.append(parts if len(parts) > 1 else None)
            plain.extend(self._pieces(p) for p in parts[::2])
        flat, counts = self.memo.rows(plain)
        packed, stops = flat.tobytes(), (4 * np.cumsum(counts)).tolist()
        ids = (packed[a:b] for a, b in zip([0, *stops], stops))
        out = []
        for parts in plan:
            if parts is None:
                out.append(next(ids))
            else:
                own = [next(ids) if k % 2 == 0 else np.array([self.special_ids[p]], dtype="<u4").tobytes() for k, p in enumerate(parts)]
                out.append(b"".join(own))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; special tokens stand as their strings, broken UTF-8 as U+FFFD."""
        if not self.special_text or not np.isin(ids, list(self.special_text)).any():
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        out, run = [], []
        for i in ids.tolist():
            if i in self.special_text:
                out += [b"".join(run).decode("utf-8", "replace"), self.special_text[i]]
                run = []
            else:
                run.append(self.bytes_of[i])
        return "".join([*out, b"".join(run).decode("utf-8", "replace")])


class WordBPE:
    """A tokenizer file of lower-cased words with an end-of-word mark; white space is dropped."""

    #: The file's split pattern, fixed values.
    SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
    SPLIT_BREAK = regex.compile(SPLIT.pattern + "|" + BREAK)
    END = "</w>"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.rules = spec["model"]["merges"]
        self.merges = Merges(self.vocab, self.rules)
        letters = byte_letters()
        self.base = np.array([self.vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([self.vocab[c + self.END] for c in letters], dtype=np.int64)
        self.special, self.special_ids = _special(spec["added_tokens"])
        self.size = max([*self.vocab.values(), *self.special_ids.values()]) + 1
        self.memo = PieceMemo(self._encode_pieces)

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then each character lower-cased by itself (no final-sigma rule)."""
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def words(self, piece: str) -> list[str | int]:
        """Pre-tokens of a piece without white space, special tokens as their ids."""
        out: list[str | int] = []
        for k, part in enumerate(self.special.split(piece) if self.special else [piece]):
            if k % 2:
                out.append(self.special_ids[part])
            else:
                out += self.SPLIT.findall(self.normalise(part))
        return out

    def _symbols(self, raw: np.ndarray, last: np.ndarray) -> np.ndarray:
        ids = self.base[raw]
        ids[last] = self.last[raw[last]]
        return ids

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [p.replace(BREAK, " ") if BREAK in p else p for p in pieces]  # white space either way
        mixed = [k for k, p in enumerate(pieces) if "<" in p and self.special and self.special.search(p)]
        odd = set(mixed)
        plain = [k for k in range(len(pieces)) if k not in odd] if odd else range(len(pieces))
        parts = []
        if len(plain):
            parts.append((plain, *encode_pieces(self.merges, self.SPLIT_BREAK, self.normalise(BREAK.join([*map(pieces.__getitem__, plain), ""])), self._symbols)))
        for k in mixed:
            own = []
            for j, part in enumerate(self.special.split(pieces[k])):
                if j % 2:
                    own.append([self.special_ids[part]])
                elif part:
                    own.append(encode_pieces(self.merges, self.SPLIT_BREAK, self.normalise(part) + BREAK, self._symbols)[0])
            ids = np.concatenate(own)
            parts.append(([k], ids, np.array([len(ids)])))
        return joined(parts, len(pieces))

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's count of them."""
        return self.memo.rows(texts)


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevelBPE:
    """One of each vocabulary in a worker process."""
    return ByteLevelBPE(path)


@functools.lru_cache(maxsize=4)
def word_level(path: str) -> WordBPE:
    return WordBPE(path)


FIELDS = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("decoded", T.StringType()),
])
DIGESTS = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def bpe_round_trip(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """Encodes every whole text and decodes it again, one output row a row.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and
    decoded; with ``digests`` the SHA-256 of the last two instead.  A null text
    counts as empty (no ids); a null doc_id is kept; equal rows each get a row;
    an empty table gives an empty one; other columns aren't read.  No shuffle:
    the work is done where the rows are scanned.
    """

    def make() -> Callable[[list[str]], dict[str, list]]:
        coder = byte_level(vocabulary)

        def work(texts: list[str]) -> dict[str, list]:
            ids = coder.encode_many(texts)
            decoded = [coder.decode(np.frombuffer(b, dtype="<u4")) for b in ids]
            counts = [len(b) // 4 for b in ids]
            if digests:
                return {
                    "n_tokens": counts,
                    "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids],
                    "decoded_sha256": [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded],
                }
            return {"n_tokens": counts, "ids": ids, "decoded": decoded}

        return work

    return map_texts(docs, make, DIGESTS if digests else FIELDS)
