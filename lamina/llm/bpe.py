"""BPE encoding and decoding, with tree concatenation for long unsplit text.

A byte-level BPE splits a text into pre-tokens and merges within each. Long pre-tokens are cut into
leaves, the leaves are encoded in parallel, and neighbours are joined in a binary tree: a window of
tokens around the join is encoded again and grown until its first token equals the left side's token
there and its last token the right side's. A sequence in which every adjacent pair of tokens
is what the merges give for that pair is the encoding, so the joined sequence is exact.

Short pre-tokens of texts in Latin script are found with array operations, hashed, and each distinct one
is merged once in a batch, many at a time. All other texts are split by the tokenizer itself.

Vocabularies are files of public tokenizers; their path is a parameter.

Null texts count as empty; an empty text has no tokens and the digests of zero bytes. Rows with a null
or repeated doc_id are encoded like others. Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tables, words

LEAF = 4096
#: Texts with longer pre-tokens go to the tokenizer and the tree.
LONG = 64
#: Bytes of text whose distinct pre-tokens are merged together.
BATCH = 3 << 20
class Merger:
    """The merges of a vocabulary, applied to many short words at once.

    Words of like lengths are rows of a matrix; each step merges every row's best pair, the leftmost of
    equals, until no row has one: the order in which BPE merges a word.
    """

    NONE = np.int32(1 << 30)

    def __init__(self, merges: list[tuple[int, int, int]], first: list[int], last: list[int]):
        """merges: left, right and made id by rank; first, last: ids of a byte inside and at the end of a word."""
        left, right, self.made = (np.array(x, dtype=np.int64) for x in zip(*merges, strict=True))
        self.first, self.last = np.array(first, np.int32), np.array(last, np.int32)
        self.bits = 20
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int32)
        todo, self.probes = np.arange(len(left)), 0
        key = left << 32 | right
        while len(todo):
            at = self._slot(key[todo], self.probes)
            free = self.keys[at] < 0
            self.keys[at[free]] = key[todo[free]]
            won = self.keys[at] == key[todo]
            self.ranks[at[won]] = todo[won]
            todo, self.probes = todo[~won], self.probes + 1

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = self._slot(key, 0)
        out = np.where(self.keys[at] == key, self.ranks[at], self.NONE)
        for probe in range(1, self.probes):
            at = (at + 1) & ((1 << self.bits) - 1)
            out = np.minimum(out, np.where(self.keys[at] == key, self.ranks[at], self.NONE))
        return out

    def encode(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words raw[begin : begin + size], one after another, and the number of each word's."""
        count, found, least = np.zeros(len(begin), np.int64), [], 0
        for most in (4, 6, 8, 10, 12, 16, 24, 40, 64, 128, 256, 1 << 40):
            rows = np.flatnonzero((size > least) & (size <= most))
            least = most
            step = max(1, (1 << 18) // min(most, 1 << 16))
            for i in range(0, len(rows), step):
                self._group(raw, begin, size, rows[i : i + step], found)
        for rows, m, _ in found:
            count[rows] = m
        at = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        for rows, m, got in found:
            ids[np.repeat(at[rows], m) + ramp(m)] = got
        return ids, count

    def _group(self, raw, begin, size, rows, found) -> None:
        n, w = size[rows], int(size[rows].max()) + 1
        cols = np.arange(w)
        inside = cols < n[:, None]
        x = np.full((len(rows), w), -1, np.int32)
        x[inside] = self.first[raw[(begin[rows][:, None] + cols)[inside]]]
        x[np.arange(len(rows)), n - 1] = self.last[raw[begin[rows] + n - 1]]
        r = np.full((len(rows), w), self.NONE, np.int32)
        pair = np.flatnonzero(cols < n[:, None] - 1)
        # places of the next and the previous token; the last place of a row is after every word
        flat, ranks = x.reshape(-1), r.reshape(-1)
        ranks[pair] = self.rank(flat[pair], flat[pair + 1])
        after = np.tile(np.arange(1, w + 1), (len(rows), 1)).reshape(-1)
        before = np.tile(np.arange(-1, w - 1), (len(rows), 1)).reshape(-1)
        act = np.flatnonzero(n > 1)
        while len(act):
            sub = r[act]
            j = sub.argmin(axis=1)
            best = sub[np.arange(len(act)), j]
            go = best < self.NONE
            if not go.all():
                act, j, best = act[go], j[go], best[go]
            row = act * w
            at = row + j
            gone = row + after[at]
            then = np.minimum(after[gone], w - 1)
            flat[at], flat[gone], ranks[gone], after[at] = self.made[best], -1, self.NONE, then
            before[row + then] = j
            ranks[at] = self.rank(flat[at], flat[row + then])
            some = before[at] >= 0
            prev = row[some] + before[at[some]]
            ranks[prev] = self.rank(flat[prev], flat[at[some]])
        alive = x >= 0
        found.append((rows, alive.sum(axis=1), x[alive]))


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of counts."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


SPACE, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
#: Second bytes after C2 whose characters are neither space, letter nor digit
C2_OTHER = np.zeros(256, bool)
C2_OTHER[[*range(0xA1, 0xAA), 0xAB, 0xAC, *range(0xAE, 0xB2), 0xB4, 0xB6, 0xB7, 0xB8, 0xBB, 0xBF]] = True


def latin_classes(raw: np.ndarray, last_lead: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and the places of bytes that need the tokenizer's own tables.

    Letters above ASCII are those of two bytes whose first is C3 to last_lead.
    """
    cls = CLASS[raw]
    high = np.flatnonzero(raw >= 0xC0)
    lead, after = raw[high], raw[high + 1]
    sign = (lead == 0xC3) & ((after == 0x97) | (after == 0xB7))
    cls[high] = cls[high + 1] = np.where((lead == 0xC2) | sign, OTHER, LETTER)
    odd = (lead == 0xC2) & ~C2_OTHER[after] | (lead < 0xC2) | (lead > last_lead)
    bar = np.flatnonzero(raw[:-1] == ord("<")) if len(raw) else high
    return cls, np.concatenate([high[odd], bar[raw[bar + 1] == ord("|")]])


class LatinBpe:
    """Ids of a column of texts. Subclasses say how pre-tokens are bounded and encode what is not plain Latin."""

    last_lead = 0xC9

    def _load(self, path: str) -> dict:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        return json.loads(self.tok.to_str())["model"]

    def fold(self, raw: np.ndarray) -> np.ndarray:
        return raw

    def bounds(self, raw: np.ndarray, cls: np.ndarray, edge: np.ndarray, offsets: np.ndarray) -> None:
        """Move the pre-token edges, which are at changes of class and at texts."""

    def library(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as little-endian 32-bit, and the end of each text's."""
        raw, off = words.text_bytes(column)
        parts, counts = [], []
        for i, j in words.chunks(off, BATCH):
            ids, n, slow = self._chunk(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            if len(slow):
                pieces = np.split(ids, np.cumsum(n)[:-1])
                for k in slow.tolist():
                    pieces[k] = self.library(column[i + k].as_py() or "")
                    n[k] = len(pieces[k])
                ids = np.concatenate(pieces)
            parts.append(ids)
            counts.append(n)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)).astype("<u4"), np.cumsum(np.concatenate(counts)) if counts else np.zeros(0, np.int64)

    def _chunk(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64), np.zeros(0, np.int64)
        raw = self.fold(raw)
        cls, odd = latin_classes(raw, self.last_lead)
        edge = np.ones(len(raw) + 1, bool)
        np.not_equal(cls[1:], cls[:-1], out=edge[1:-1])
        edge[off] = True
        self.bounds(raw, cls, edge, off)
        at = np.flatnonzero(edge)
        begin, end = at[:-1], at[1:]
        if self.drops_space:
            keep = cls[begin] != SPACE
            begin, end = begin[keep], end[keep]
        slow = np.zeros(len(off) - 1, bool)
        slow[np.searchsorted(off, odd, side="right") - 1] = True
        slow[np.searchsorted(off, begin[end - begin > LONG], side="right") - 1] = True
        if slow.any():
            keep = ~np.repeat(slow, np.diff(np.searchsorted(begin, off)))
            begin, end = begin[keep], end[keep]
        names = words.word_hashes(raw, begin, end, fold=False)
        _, first, back = np.unique(names, return_index=True, return_inverse=True)
        ids, count = self.merger.encode(raw, begin[first], (end - begin)[first])
        n = count[back]
        at = (np.cumsum(count) - count)[back]
        per = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(begin, off)]
        return ids[np.repeat(at, n) + ramp(n)], np.diff(per), np.flatnonzero(slow)


def contractions(raw: np.ndarray, cls: np.ndarray, edge: np.ndarray, offsets: np.ndarray) -> None:
    """'s, 't, 're, 've, 'm, 'll and 'd are pre-tokens where an apostrophe stands by itself before letters."""
    p = np.flatnonzero((raw == 39) & edge[:-1] & edge[1:])
    p = p[p + 1 < len(raw)]
    p = p[(cls[p + 1] == LETTER) & ~np.isin(p + 1, offsets)]
    a, b = raw[p + 1], np.where(p + 2 < len(raw), raw[np.minimum(p + 2, len(raw) - 1)], 0)
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~edge[np.minimum(p + 2, len(raw))]
    for q, size in ((p[one], 2), (p[two], 3)):
        edge[q + 1] = False
        edge[q + size] = True


class ByteBpe(LatinBpe):
    """Encoder and decoder for one byte-level tokenizer file."""

    drops_space = False

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        model = self._load(path)
        vocab, self.leaf, self.alphabet = model["vocab"], leaf, byte_alphabet()
        self.raw = Tokenizer(self.tok.model)
        back = {c: b for b, c in enumerate(self.alphabet)}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        single = [vocab[c] for c in self.alphabet]
        self.merger = Merger([(vocab[x], vocab[y], vocab[x + y]) for x, y in model["merges"]], single, single)

    def bounds(self, raw, cls, edge, offsets):
        """The last character of white space stands apart before other text, and goes with it if it is a space."""
        last = np.flatnonzero((cls[:-1] == SPACE) & edge[1:-1])
        last = last[cls[last + 1] != SPACE]
        last = last[~np.isin(last + 1, offsets, assume_unique=True)] if len(last) else last
        edge[last] = True
        edge[last[raw[last] == 32] + 1] = False
        contractions(raw, cls, edge, offsets)

    def library(self, text: str) -> np.ndarray:
        """The tokenizer's own pre-tokens, the long ones by the tree."""
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                pre = [m for m, _ in self.tok.pre_tokenizer.pre_tokenize_str(part)]
                if max(map(len, pre)) <= self.leaf:
                    ids.extend(self.tok.encode(part, add_special_tokens=False).ids)
                else:
                    for m in pre:
                        ids.extend(self.encode_unsplit(m) if len(m) > self.leaf else self.raw.encode(m, add_special_tokens=False).ids)
        return np.asarray(ids, dtype=np.int32)

    def encode_unsplit(self, mapped: str) -> list[int]:
        """Ids of one pre-token, given in the byte alphabet, however long."""
        leaves = [mapped[i : i + self.leaf] for i in range(0, len(mapped), self.leaf)]
        level = [e.ids for e in self.raw.encode_batch(leaves, add_special_tokens=False)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            text = "".join(self.alphabet[x] for x in b"".join(map(self.bytes_of.__getitem__, a + b)))
            window = self.raw.encode(text, add_special_tokens=False).ids
            all_left, all_right = len(a) == len(left), len(b) == len(right)
            if (all_left or window[0] == a[0]) and (all_right or window[-1] == b[-1]) and (all_left or all_right or len(window) > 1):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def decode(self, ids: bytes) -> str:
        """What decode(ids, skip_special_tokens=False) gives."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[tuple, object] = {}


def encoder(kind, *args):
    """One encoder for each worker process."""
    key = (kind, *args)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(*args)
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, path: str, *, leaf: int = LEAF, keep_text: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (string; only with keep_text)
    and both digests. A map over rows: no shuffle, bounded by one batch.
    """
    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ByteBpe, path, leaf)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                flat, ends = enc.encode_column(part.column(1))
                ids = [x.tobytes() for x in np.split(flat, ends[:-1])]
                decoded = [enc.decode(x) for x in ids]
                out = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]),
                    "same": pa.array([d == (t or "") for d, t in zip(decoded, part.column(1).to_pylist(), strict=True)]),
                }
                if keep_text:
                    out |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded)}
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean" + ", ids binary, decoded string" * keep_text
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
