"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A byte-level vocabulary writes each byte as one printable character; the library merges those characters. Texts are cut
into pretokens first (contractions, letters, digits, other signs, white space). A pretoken's ids depend on nothing else,
so each worker encodes a distinct pretoken once, many in one call, and keeps the ids in a table of bounded size.
Decoding gathers the bytes behind the ids, so characters split over several ids come back whole, and token offsets are
sums of byte lengths. Every piece is decoded and compared with its text before it leaves the task.

Texts with an added token of a JSON vocabulary written out in them go to the library as a whole, which gives that token's
own id; rank files have none.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows are independent, so ties, repeated rows and
an empty table need no care; input columns named like the added ones are replaced.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barfold.llm.text import Piece, expand, lists, with_columns

#: Pretokens a worker remembers; beyond, it forgets all and begins anew.
REMEMBERED = 1_500_000
_CHUNK = 8192
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0

#: Code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows the apostrophe of an English contraction.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        table[[ord(c) for c in regex.findall(pattern, every)]] = kind
    table[WHITE_SPACE] = _SPACE
    return table


def pretokens(piece: Piece) -> np.ndarray:
    """Begins of all pretokens; each ends where the next, or its row, ends."""
    data, n = piece.data, len(piece.data)
    if not n:
        return np.zeros(0, np.int64)
    table = _classes()
    kind = table[data]  # right for ASCII
    high = data >= 0x80
    if high.any():
        lead = np.flatnonzero(data >= 0xC0)
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
        for k in (1, 2, 3):
            more = size > k
            point[more] = (point[more] << 6) | (data[lead[more] + k] & 0x3F)
        of = table[point]
        for k in (0, 1, 2, 3):
            more = size > k
            kind[lead[more] + k] = of[more]
    opens = np.zeros(n + 1, bool)
    opens[piece.offsets] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= opens[:n]
    s = np.flatnonzero(change)
    e = np.append(s[1:], n)
    run, at_end = kind[s], opens[e]
    after_blank = np.zeros(len(s), bool)
    after_blank[1:] = (data[s[1:] - 1] == 0x20) & ~opens[s[1:]]
    begin = np.zeros(n + 1, bool)
    solid = run != _SPACE
    begin[(s - after_blank)[solid]] = True
    white = ~solid
    begin[s[white & at_end]] = True
    inner = white & ~at_end
    if inner.any():
        last = e[inner] - 1
        while True:  # back to the first byte of the last character
            cont = (data[last] & 0xC0) == 0x80
            if not cont.any():
                break
            last = last - cont
        begin[s[inner][last > s[inner]]] = True
        begin[last[data[last] != 0x20]] = True
    quote = np.flatnonzero((data[s] == 0x27) & (e - s == 1) & (run == _OTHER) & ~after_blank & ~at_end)
    if len(quote):
        p = s[quote]
        end = e[quote + 1] if len(s) > 1 else p
        end = np.minimum(end, n)
        second = data[np.minimum(p + 1, n - 1)]
        third = np.where(p + 2 < end, data[np.minimum(p + 2, n - 1)], 0)
        taken = np.zeros(len(p), np.int64)
        for tail in CONTRACTIONS:
            if len(tail) == 1:
                taken[(second == ord(tail)) & (taken == 0)] = 2
            else:
                taken[(second == ord(tail[0])) & (third == ord(tail[1])) & (taken == 0)] = 3
        p, end, taken = p[taken > 0], end[taken > 0], taken[taken > 0]
        begin[p + 1] = False
        rest = p + taken < end
        begin[(p + taken)[rest]] = True
    return np.flatnonzero(begin[:n])


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every way to make a token of two others, by the token's rank: what merging by rank can do, as a merge list.

    Of two ways to make one token the one with the longer left part comes first."""
    pairs = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        pairs += [(token[:k], token[k:]) for k in range(len(token) - 1, 0, -1) if token[:k] in ranks and token[k:] in ranks]
    return pairs


class Vocabulary:
    """A byte-level vocabulary: from a rank file (base64 token and rank on each line) or a tokenizer's JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chars = byte_characters()
        added: dict[str, int] = {}
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as file:
                stored = json.load(file)
            model = stored["model"]
            added = {t["content"]: t["id"] for t in stored.get("added_tokens") or []}
            vocab = model["vocab"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            back = {c: b for b, c in enumerate(chars)}
            self.tokens = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        else:
            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
            shown = {t: "".join(chars[b] for b in t) for t in ranks}
            vocab = {shown[t]: i for t, i in ranks.items()}
            merges = [(shown[a], shown[b]) for a, b in merges_of(ranks)]
            self.tokens = {i: t for t, i in ranks.items()}
        self.tokens |= {i: t.encode() for t, i in added.items()}
        self.size = max(*vocab.values(), *added.values(), 0) + 1
        self.added = [t.encode() for t in added]
        if added:
            self.whole = Tokenizer.from_file(path)
            self.whole.no_truncation()
            self.whole.no_padding()
        self.library = Tokenizer(models.BPE(vocab=vocab, merges=merges, cache_capacity=0))
        self.library.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split("\x00", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.alone = Tokenizer(self.library.model)
        self.alone.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.lengths = np.zeros(self.size, np.int64)
        for i, t in self.tokens.items():
            self.lengths[i] = len(t)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(self.size)), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.known = np.zeros(0, np.int32)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens, flat, and how many each has."""
        out: list = [None] * len(words)
        plain = [k for k, w in enumerate(words) if b"\x00" not in w]
        for k in set(range(len(words))) - set(plain):
            out[k] = np.array(self.alone.encode_batch_fast([words[k].decode()], add_special_tokens=False)[0].ids, np.int32)
        groups, group, size = [], [], 0
        for k in plain:
            group.append(k)
            size += len(words[k]) + 1
            if size >= _CHUNK:
                groups.append(group)
                group, size = [], 0
        if group:
            groups.append(group)
        coded = self.library.encode_batch_fast([b"\x00".join(words[k] for k in g).decode() for g in groups], add_special_tokens=False) if groups else []
        for g, enc in zip(groups, coded, strict=True):
            ids = np.array(enc.ids, np.int32)
            cut = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(words[k]) for k in g])) + 1
            for k, part in zip(g, np.split(ids, cut[:-1]), strict=True):
                out[k] = part
        counts = np.array([len(x) for x in out], np.int32)
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a piece's rows, flat, and how many each row has."""
        raw = piece.data.tobytes() if self.added else b""
        if not any(t in raw for t in self.added):
            return self._encode(piece)
        rows = [raw[a:b] for a, b in zip(piece.offsets[:-1].tolist(), piece.offsets[1:].tolist(), strict=True)]
        odd = [k for k, row in enumerate(rows) if any(t in row for t in self.added)]
        coded = self.whole.encode_batch_fast([rows[k].decode() for k in odd], add_special_tokens=False)
        # The other rows go the usual way, with these left empty.
        size = np.diff(piece.offsets)
        size[odd] = 0
        keep = np.ones(piece.rows, bool)
        keep[odd] = False
        plain = Piece(piece.data[np.repeat(keep, np.diff(piece.offsets))], np.concatenate([[0], np.cumsum(size)]))
        ids, per_row = self._encode(plain)
        parts = np.split(ids, np.cumsum(per_row)[:-1])
        for k, enc in zip(odd, coded, strict=True):
            parts[k] = np.array(enc.ids, ids.dtype)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        begins = pretokens(piece)
        if not len(begins):
            return np.zeros(0, np.int32), np.zeros(piece.rows, np.int64)
        ends = np.append(begins[1:], len(piece.data))
        back, keys = pd.factorize(piece.hashes(begins, ends, folded=False))
        where = np.empty(len(keys), np.int64)
        where[back[::-1]] = np.arange(len(back) - 1, -1, -1)
        order = np.argsort(keys)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        keys, where, back = keys[order], where[order], rank[back]
        if len(self.keys) + len(keys) > max(REMEMBERED, len(keys)):
            self._forget()
        at = np.searchsorted(self.keys, keys)
        missing = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        missing[inside] = self.keys[at[inside]] != keys[inside]
        if missing.any():
            raw = piece.data.tobytes()
            ids, counts = self._merge([raw[a:b] for a, b in zip(begins[where[missing]].tolist(), ends[where[missing]].tolist(), strict=True)])
            first = len(self.known) + np.cumsum(counts, dtype=np.int64) - counts
            self.known = np.concatenate([self.known, ids])
            slot = at[missing]
            self.keys = np.insert(self.keys, slot, keys[missing])
            self.first = np.insert(self.first, slot, first)
            self.count = np.insert(self.count, slot, counts)
            at = np.searchsorted(self.keys, keys)
        first, count = self.first[at], self.count[at].astype(np.int64)
        ids = self.known[expand(first[back], count[back])]
        row_first = piece.per_row(begins)
        total = np.zeros(len(begins) + 1, np.int64)
        np.cumsum(count[back], out=total[1:])
        per_row = np.diff(total[row_first])
        data, sizes = self.decode(ids, per_row)
        wrong = np.flatnonzero(sizes != np.diff(piece.offsets))
        if len(wrong) or not np.array_equal(data, piece.data):
            raise RuntimeError("ids don't decode to their text")
        return ids, per_row

    def decode(self, ids: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes behind the ids, flat, and how many each row has."""
        lengths = self.lengths[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        edges = np.zeros(len(per_row) + 1, np.int64)
        np.cumsum(per_row, out=edges[1:])
        return self.bytes[expand(self.starts[ids], lengths)], np.diff(total[edges])

    def offsets(self, ids: np.ndarray, data: np.ndarray, start: int) -> np.ndarray:
        """Begin of each id's text, in characters from its row's begin; an id inside a character begins with it."""
        whole = np.cumsum((data & 0xC0) != 0x80)
        place = start + np.cumsum(self.lengths[ids]) - self.lengths[ids]
        return whole[place] - 1 - (whole[start - 1] if start else 0)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary and memory for each worker."""
    return Vocabulary(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", with_offsets: bool = False) -> DataFrame:
    """Append ids (array<int>), decoded (binary) and, if asked for, offsets (array<int>, code points)."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())]
    if with_offsets:
        fields.append(T.StructField("offsets", T.ArrayType(T.IntegerType(), False)))

    def kernel(batch: pa.RecordBatch, piece: Piece, i: int, j: int) -> list:
        vocab = vocabulary(path)
        ids, per_row = vocab.encode(piece)
        data, sizes = vocab.decode(ids, per_row)
        edges = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=edges[1:])
        decoded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        out = [lists(ids, per_row, pa.int32()), decoded]
        if with_offsets:
            cuts = np.cumsum(per_row)[:-1]
            parts = [vocab.offsets(x, data, int(s)) for x, s in zip(np.split(ids, cuts), edges[:-1], strict=True) if len(x)]
            out.append(lists(np.concatenate(parts) if parts else np.zeros(0, np.int64), per_row, pa.int32()))
        return out

    return with_columns(df, fields, kernel, text)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Append decoded (binary) to rows with an array of ids; null ids have no bytes."""
    names = [f.name for f in df.schema if f.name.lower() != "decoded"]
    schema = T.StructType([*(f for f in df.schema if f.name in names), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        for batch in batches:
            vocab, column = vocabulary(path), batch.column(names.index(ids))
            parts = [vocab.decode(np.array(x or [], np.int64), np.array([len(x or [])]))[0].tobytes() for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.binary())], names=[*names, "decoded"])

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)
