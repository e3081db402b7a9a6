"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut at single white space characters between words and at punctuation after a letter or digit: no
pre-token of the byte-level pattern crosses such a cut, so equal units have equal ids wherever they stand.  A task encodes each distinct unit once.  All pre-tokens
of the new units are laid out as one linked sequence of byte symbols; an index maps each pair that has a rank to
all its positions; the active ranks are applied in ascending order, each to all its positions at once, and the
lists of the pairs on both sides are extended.  The ids of a text are then gathered from its units' ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columnar import SPACE, as_strings, long, ragged, starts_of, string, sums, text_buffer, with_columns

#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A task forgets its distinct units when it has more than these; they are then encoded anew.
UNIT_CACHE = 400_000
PLAIN = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
PUNCTUATION = np.array([33 <= b < 127 and not PLAIN[b] for b in range(256)])


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and token bytes of a tokenizer file (byte-level BPE as JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        ids: dict[str, int] = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.of_byte = np.array([ids[c] for c in letters], np.int64)
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        # Ascending order over all words equals each word's own order only if a pair's parts are made before it.
        first = {int(x): -1 for x in self.of_byte}
        for r, m in enumerate(self.made.tolist()):
            first.setdefault(m, r)
        if len(set(self.made.tolist())) < len(pairs) or any(first.get(x, r) >= r for r, two in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)) for x in two):
            raise ValueError("the merges aren't in the order of their making")
        key = self.left << 32 | self.right
        self.order = np.argsort(key)
        self.keys = key[self.order]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) or r"(?!)")
        known = {i: bytes(of_letter[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in special.items()}
        lengths = np.array([len(known.get(i, b"")) for i in range(max(known) + 1)], np.int64)
        self.bytes, self.lengths, self.starts = np.frombuffer(b"".join(known.get(i, b"") for i in range(max(known) + 1)), np.uint8), lengths, starts_of(lengths)[:-1]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it has none."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_all(vocab: Vocabulary, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all byte strings, one after the other, and the number of ids of each."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    n = int(lengths.sum())
    symbol = np.concatenate([vocab.of_byte[np.frombuffer(b"".join(tokens), np.uint8)], [-1]])
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # position n is the end of every token
    ends = np.cumsum(lengths)
    real = lengths > 0
    after[ends[real] - 1] = n
    before[(ends - lengths)[real]] = n
    after[n] = before[n] = n
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(at: np.ndarray) -> None:
        """Put pairs that begin at these positions into the index."""
        rank = vocab.rank(symbol[at], symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, where in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
            if r in index:
                index[r].append(where)
            else:
                index[r] = [where]
                heapq.heappush(active, r)

    note(np.flatnonzero(after[:n] != n))
    while active:
        r = heapq.heappop(active)
        a, b, made = int(vocab.left[r]), int(vocab.right[r]), int(vocab.made[r])
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
        if a == b and len(at) > 1:  # of overlapping pairs every second one counts, from the left
            at = np.unique(at)
            first = np.concatenate([[True], after[at[:-1]] != at[1:]])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at], symbol[gone] = made, -1
        far = after[gone]
        after[at] = far
        before[far[far != n]] = at[far != n]
        left = before[at]
        note(np.concatenate([left[left != n], at[far != n]]))
    alive = symbol[:n] >= 0
    owner = np.repeat(np.arange(len(tokens)), lengths)
    return symbol[:n][alive], np.bincount(owner[alive], minlength=len(tokens))


def encode_units(vocab: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, one after the other, and the number of ids of each."""
    tokens: list[str] = []
    fixed: list[tuple[int, int]] = []  # (place among tokens, id) of special tokens
    sizes: list[int] = []
    cut = vocab.cut.search if vocab.special else lambda _: None
    for unit in units:
        if unit.isalpha() or unit[:1] == " " and unit[1:].isalpha():
            tokens.append(unit)
            sizes.append(1)
            continue
        had = len(tokens)
        while m := cut(unit):
            tokens += PATTERN.findall(unit[: m.start()])
            fixed.append((len(tokens), vocab.special[m[0]]))
            tokens.append("")
            unit = unit[m.end() :]
        tokens += PATTERN.findall(unit)
        sizes.append(len(tokens) - had)
    ids, counts = merge_all(vocab, [t.encode() for t in tokens])
    if fixed:
        where = starts_of(counts)
        ids = np.insert(ids, [where[p] for p, _ in fixed], [i for _, i in fixed])
        counts[[p for p, _ in fixed]] = 1
    return ids, sums(counts, starts_of(np.array(sizes, np.int64)))


def cut_units(offsets: np.ndarray, data: bytes, special: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the units of all texts, and the number of units of each text.

    A unit begins with a text, at a single white space between words, and, if no special token could be cut in
    two by it, at ASCII punctuation after an ASCII letter or digit.
    """
    code = np.frombuffer(data, np.uint8)
    space = SPACE[code]
    begin = np.zeros(len(code), bool)
    begin[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:]
    ends = offsets[1:] - 1
    begin[ends[ends >= 0]] = False  # no neighbour in its own text
    if not any(t.encode() in data for t in special):
        begin[1:] |= PUNCTUATION[code[1:]] & PLAIN[code[:-1]]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    begins = np.flatnonzero(begin)
    return np.append(begins, len(code)), np.diff(np.searchsorted(begins, offsets))


class Encoder:
    """Encodes chunks of texts; keeps the ids of the distinct units of a task."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text's ids."""
        offsets, data = text_buffer(texts)
        borders, per_text = cut_units(offsets, data, list(self.vocab.special))
        coded = as_strings(borders, data, pa.binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.seen) + len(distinct) > UNIT_CACHE:
            self.forget()
        new = [u for u in distinct if u not in self.seen]
        if new:
            ids, counts = encode_units(self.vocab, [u.decode() for u in new])
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))
            self.ids, self.counts = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.counts, counts])
        unit = np.array([self.seen[u] for u in distinct], np.int64)[np.asarray(coded.indices)] if distinct else np.zeros(0, np.int64)
        lengths = self.counts[unit]
        ids = self.ids[ragged(starts_of(self.counts)[unit], lengths)]
        return ids, starts_of(lengths)[starts_of(per_text)]


def encode(df: DataFrame, path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """df with n_tokens, ids (array of int; only with keep_ids), ids_sha256 and decoded_sha256.

    The whole text is encoded under the byte-level BPE file at path, and its ids are decoded again.  A special token's
    string in a text becomes its id.  ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256
    of the decoded text in UTF-8, both in lowercase hex.  Null and empty texts have no ids; very long texts are encoded
    whole.  Pairs of one rank are merged from left to right.  Repeated rows are encoded each, no rows in, no rows out.
    Columns with a result's name, in any case, are replaced.  A vocabulary whose merges don't follow their ranks, or that
    isn't byte-level BPE, is a ValueError.
    """

    def kernel():
        encoder = Encoder(path)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            ids, offsets = encoder(part.column(part.schema.get_field_index(text)))
            vocab = encoder.vocab
            decoded = vocab.decode(ids)
            ends = starts_of(vocab.lengths[ids])[offsets].tolist()
            raw = ids.astype("<u4").tobytes()
            cuts = (offsets * 4).tolist()
            hashed = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
            told = [hashlib.sha256(decoded[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))] * keep_ids
            return [pa.array(np.diff(offsets)), *lists, pa.array(hashed, pa.string()), pa.array(told, pa.string())]

        return work

    kept = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids
    return with_columns(df, text, [long("n_tokens"), *kept, string("ids_sha256"), string("decoded_sha256")], kernel)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text that a column of ids stands for; null ids are an empty text, invalid UTF-8 becomes U+FFFD."""

    def kernel():
        vocab = vocabulary(path)
        return lambda part: [pa.array([vocab.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in part.column(part.schema.get_field_index(ids)).to_pylist()], pa.string())]

    return with_columns(df, None, [string(into)], kernel)
