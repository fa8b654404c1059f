"""Byte-level byte-pair encoding by dynamic programming over prefixes.

Every prefix of a byte string has exactly one encoding, and its last token is
unique.  So an encoding is known as soon as ``last[i]``, the last token of the
first ``i`` bytes, is known for every ``i``: a token ``t`` that ends at ``i`` is
``last[i]`` if and only if ``t`` may follow ``last[i - len(t)]``, that is, if the
merges would have left these two tokens apart.  Text may be appended without
looking at old bytes again, and after an edit only positions from the edit on
are recomputed, until the table agrees with the old one.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex

from lectern.llm.common import ragged


def _byte_letters() -> dict[str, int]:
    """The printable letters that JSON vocabularies of this kind use for the 256 bytes."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, the merge that makes each, and the order of merges."""

    def __init__(self, token_bytes: dict[int, bytes], rank: dict[int, int], parts: dict[int, tuple[int, int]], special: dict[str, int]):
        self.token_bytes, self.special = token_bytes, special
        self.id_of = {b: i for i, b in token_bytes.items() if i in parts or len(b) == 1}
        self.longest = max(map(len, self.id_of))
        self._rank, self._parts = rank, parts
        self._made = {pair: rank[i] for i, pair in parts.items()}
        self._fits: dict[int, bool] = {}

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A file of base64 tokens and their ranks; a token's id is its rank."""
        with open(path, "rb") as f:
            tokens = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
        ids = {b: i for i, b in tokens.items()}
        parts = {}
        for i in sorted(tokens):
            if len(tokens[i]) > 1 and len(made := _merge(tokens[i], ids, i)) == 2:
                parts[i] = (ids[made[0]], ids[made[1]])
        return cls(tokens, {i: i for i in tokens}, parts, {})

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A file with vocabulary and merges in the JSON form of the tokenizers library."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_json(spec)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        tokens = {i: bytes(letters[c] for c in t) for t, i in plain.items()}
        rank, parts = {i: -1 for i in tokens}, {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            parts[plain[a + b]] = (plain[a], plain[b])
            rank[plain[a + b]] = k
        return cls(tokens, rank, parts, special)

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes together is these two tokens.

        Undo merges on the two sides of the seam from the latest to the earliest.
        The tokens then facing each other stood there together until the earlier
        of the two merges that consumed them; if their own merge came before that,
        it would have bridged the seam.
        """
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        rank, parts, made = self._rank, self._parts, self._made
        until = float("inf")  # rank of the merge that ends the present pair's time; a tie goes to the left one
        left_ends = False
        while True:
            own = made.get((left, right))
            if own is not None and (own < until or own == until and not left_ends):
                return False
            can_l, can_r = parts.get(left), parts.get(right)
            if can_l is None and can_r is None:
                return True
            if can_r is None or can_l is not None and rank[left] > rank[right]:
                until, left_ends, left = rank[left], True, can_l[1]
            elif can_l is None or rank[right] > rank[left]:
                until, left_ends, right = rank[right], False, can_r[0]
            else:  # equal tokens: the left one is merged first, so undo the right one
                until, left_ends, right = rank[right], False, can_r[0]

    @cached_property
    def _endings(self) -> dict[bytes, tuple[int, ...]]:
        """Lengths of the tokens that end with each three bytes, the longest first."""
        found: dict[bytes, set[int]] = {}
        for b in self.id_of:
            if len(b) > 2:
                found.setdefault(b[-3:], {1, 2}).add(len(b))
        return {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}

    def _last_token(self, data: bytes, i: int, last: list[int]) -> int:
        """Last token of the first ``i`` bytes, from those of all shorter prefixes."""
        id_of = self.id_of
        for n in range(i, 0, -1) if i < 3 else self._endings.get(data[i - 3 : i], _SHORT):
            if n <= i:
                t = id_of.get(data[i - n : i])
                if t is not None and (n == i or self.fits(last[i - n], t)):
                    return t
        raise ValueError("no token ends here; the vocabulary lacks a single byte")

    def prefix_table(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """``last[i]`` for every prefix of ``data``; a table of a shorter prefix is extended, not recomputed."""
        last = [-1] if last is None else last
        for i in range(len(last), len(data) + 1):
            last.append(self._last_token(data, i, last))
        return last

    def tables(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
        """Every piece with its last tokens and its counts of tokens, both by prefix.

        In sorted order, each keeps the entries of the prefix that it shares with the
        one before; the lists are used again, so take what you need before going on.
        """
        id_of, size, known, fits, endings = self.id_of, self.sizes, self._fits, self.fits, self._endings
        before, last, counts = b"", [-1], [0]
        for data in sorted(pieces):
            same = 0
            for a, b in zip(data, before):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], counts[same + 1 :]
            for i in range(same + 1, len(data) + 1):
                for n in range(i, 0, -1) if i < 3 else endings.get(data[i - 3 : i], _SHORT):
                    if n > i:
                        continue
                    t = id_of.get(data[i - n : i])
                    if t is not None:
                        if n == i:
                            break
                        ok = known.get(last[i - n] << 32 | t)
                        if ok or ok is None and fits(last[i - n], t):
                            break
                else:
                    raise ValueError("no token ends here; the vocabulary lacks a single byte")
                last.append(t)
                counts.append(counts[i - size[t]] + 1)
            before = data
            yield data, last, counts

    @cached_property
    def sizes(self) -> dict[int, int]:
        return {i: len(b) for i, b in self.token_bytes.items()}

    def prefix_counts(self, data: bytes) -> list[int]:
        """Number of tokens of every prefix of one piece, the empty one first."""
        return next(c for _, _, c in self.tables([data]))

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of many pieces."""
        out = {p: [self.id_of[p]] for p in pieces if p in self.id_of}
        for data, last, _ in self.tables(p for p in pieces if p not in out):
            ids, i = [], len(data)
            while i:
                ids.append(last[i])
                i -= self.sizes[last[i]]
            out[data] = ids[::-1]
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        return self.encode_pieces([data])[data]

    def append(self, data: bytes, last: list[int], more: bytes) -> list[int]:
        """Table of ``data + more`` from the table of ``data``; old positions are not looked at again."""
        return self.prefix_table(data + more, list(last))

    def edit(self, data: bytes, last: list[int], at: int, removed: int, inserted: bytes) -> tuple[bytes, list[int]]:
        """Bytes and table after an edit: the table is kept before it, and taken over after it as soon as it agrees.

        It agrees once ``longest`` entries in a row after the edit equal the old
        ones: what follows depends on these alone.
        """
        new = data[:at] + inserted + data[at + removed :]
        shift, table, same = len(inserted) - removed, last[: at + 1], 0
        for i in range(at + 1, len(new) + 1):
            table.append(self._last_token(new, i, table))
            old = i - shift
            same = same + 1 if i > at + len(inserted) and old > at + removed and last[old] == table[i] else 0
            if same >= self.longest:
                return new, table + last[old + 1 :]
        return new, table

    @property
    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes, one after the other, and their offsets by id."""
        if not hasattr(self, "_decoder"):
            names = {i: s.encode() for s, i in self.special.items()}
            n = max([*self.token_bytes, *names.keys()]) + 1
            each = [names.get(i, self.token_bytes.get(i, b"")) for i in range(n)]
            self._decoder = np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in each])])
        return self._decoder

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens and each token's length."""
        data, offsets = self.decoder
        lengths = offsets[ids + 1] - offsets[ids]
        return data[ragged(offsets[ids], lengths)], lengths


#: Lengths that are tried where no token of three bytes or more ends.
_SHORT = (2, 1)


def _merge(data: bytes, ids: dict[bytes, int], below: int) -> list[bytes]:
    """Plain merging with ranks under ``below``; used on single tokens when a rank file is read."""
    parts = [data[k : k + 1] for k in range(len(data))]
    while len(parts) > 1:
        r, k = min((ids.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if r >= below:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


# Pieces: what the tokenizer's pattern matches, each encoded by itself.

#: Fixed value: the pattern that ``piece_starts`` says in array operations.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def check_pattern(pattern: str) -> None:
    """Refuse a tokenizer with another pattern: its ids would come out wrong."""
    if pattern != PATTERN:
        raise ValueError(f"pieces are split by {PATTERN!r} only, not by {pattern!r}")


def check_json(spec: dict) -> None:
    """Refuse a tokenizer of the JSON form that does more than byte-level merges within the pattern's pieces."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")):
        raise ValueError("only byte-level BPE without a normalizer, with the usual pattern and plain merges, is supported")
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in white space or stand as whole words only are not supported")


_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Code points with the Unicode property White_Space.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            kinds[a : b + 1] = kind
    kinds[0xD800:0xE000] = _OTHER
    kinds[_WHITE_SPACE] = _SPACE
    return kinds


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces start, for texts at ``offsets`` of UTF-8 bytes.

    Says in array operations what the pattern says: an English contraction; else a
    run of letters, numbers or other characters with one blank before it; else
    white space, whose last character stands alone if more text follows.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        at = None
        first = offsets[:-1][np.diff(offsets) > 0]
    else:
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        first = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
    n = len(points)
    kind = character_classes()[points]
    begins = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:n])
    new_text = np.zeros(n + 1, bool)
    new_text[first] = True
    new_text[n] = True
    begins |= new_text
    space = kind == _SPACE
    after = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    after = after[~new_text[after]]
    begins[after - 1] = True
    begins[after[points[after - 1] == 0x20]] = False
    quote = np.flatnonzero(points == 0x27)
    quote = quote[begins[quote] & ~new_text[quote + 1]]
    if len(quote):
        near = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = near[quote + 1], near[quote + 2]
        two = np.where(new_text[np.minimum(quote + 2, n)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        q, size = quote[short | long], np.where(short, 2, 3)[short | long]
        begins[q + 1] = False
        begins[q[size == 3] + 2] = False
        begins[q + size] = True
    starts = np.flatnonzero(begins[:n])
    return starts if at is None else at[starts]


class Pieces:
    """Texts as pieces: distinct pieces, and the number of the piece at each place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, special: Iterable[str] = ()):
        cuts = [offsets]
        raw = data.tobytes()
        self.special: list[tuple[int, int]] = []
        for mark in special:
            m, k = mark.encode(), -1
            while (k := raw.find(m, k + 1)) >= 0:
                row = np.searchsorted(offsets, k, "right")
                if k + len(m) <= offsets[row]:  # not across two texts
                    cuts.append(np.array([k, k + len(m)]))
                    self.special.append((k, k + len(m)))
        bounds = np.unique(np.concatenate(cuts)) if len(cuts) > 1 else offsets
        starts = piece_starts(data, bounds)
        for a, b in self.special:
            starts = starts[(starts <= a) | (starts >= b)]
        self.starts = np.append(starts, len(data))
        flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(self.starts.astype(np.int32)), pa.py_buffer(raw)])
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.distinct: list[bytes] = coded.dictionary.to_pylist()
        #: rows[k]: the first piece of text k; one more at the end
        self.rows = np.searchsorted(starts, offsets)


class PieceCache:
    """Remembers runs of figures for pieces: all runs one after the other in a few arrays, and each piece's place.

    ``of`` gives, for a list of pieces, arrays of int32 figures and the length of
    each piece's run.  When what is kept passes ``most`` bytes, all is forgotten.
    """

    def __init__(self, of: Callable[[list[bytes]], tuple[list[np.ndarray], np.ndarray]], n_arrays: int = 1, most: int = 160 << 20):
        self._of, self._n_arrays, self._most = of, n_arrays, most
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._flat, self._ends = [np.zeros(1 << 16, np.int32) for _ in range(self._n_arrays)], np.zeros(1 << 14, np.int64)
        self._used = self._bytes = 0

    def _add(self, pieces: list[bytes]) -> None:
        flat, sizes = self._of(pieces)
        first, start, n = len(self._known), self._used, int(sizes.sum())
        while start + n > len(self._flat[0]):
            self._flat = [np.concatenate([x, np.zeros_like(x)]) for x in self._flat]
        while first + len(pieces) + 1 > len(self._ends):
            self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
        for own, new in zip(self._flat, flat):
            own[start : start + n] = new
        self._ends[first + 1 : first + 1 + len(pieces)] = start + np.cumsum(sizes)
        self._known.update(zip(pieces, range(first, first + len(pieces))))
        self._used = start + n
        self._bytes += sum(map(len, pieces)) + 120 * len(pieces) + 4 * n * self._n_arrays

    def __call__(self, pieces: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """All figures, and where each piece's begin and how many they are."""
        if self._bytes > self._most:
            self._forget()
        found = list(map(self._known.get, pieces))
        if None in found:
            self._add([p for p, v in zip(pieces, found) if v is None])
            found = list(map(self._known.get, pieces))
        at = np.array(found, np.int64)
        return self._flat, self._ends[at], self._ends[at + 1] - self._ends[at]


@lru_cache(8)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.from_json(path) if path.endswith(".json") else Vocabulary.from_ranks(path)


def encode_texts(data: np.ndarray, offsets: np.ndarray, special: Iterable[str], encode: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and n + 1 offsets."""
    p = Pieces(data, offsets, special)
    (flat,), begin, size = encode(p.distinct)
    n = size[p.codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[ragged(begin[p.codes], n)], ends[p.rows]
