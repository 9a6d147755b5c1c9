"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. Before any merge it has one state with an arc for
every symbol. Merges are compiled in order, one gadget each: for a merge of u and
v into w, the state behind u is copied without its arc v (after u, a following v
would have been merged), every state with an arc u gets an arc w beside it, and w
leads where v led. A word's BPE encoding is the one path that spells it.

All arcs of one token lead to one state, so a state is named by the token that
leads to it. Copying arcs would need the square of the vocabulary; a gadget
therefore records only what it changes (which arc it closes, when w was made and
from what), and ``arc`` follows those records back to the first state.

Encoding needs no search: the set of token starts that can still go on, with the
state each start stands in, is itself a state of a deterministic machine over
symbols. Its transition table is filled as words need it, so that a word costs one
table look-up per symbol; its tokens are read back from the last one. Decoding
emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from ledgerlift.llm.texts import PACKED_BYTES, SLICE_BYTES, longs, pick, slices

FINAL = 256  # added to a word's last byte: the end-of-word mark
TABLE_ARCS = 200_000  # transitions a worker keeps before its table starts anew
CACHE_PIECES = 60_000  # encoded pieces after which a worker lets the older ones go

# The pre-split pattern of the vocabulary and the white space it knows.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Texts of these characters only are cut and lowered here; any others by the library's own rules, whose Unicode tables differ.
USUAL = re.compile(r"[\t-\r\x20-\x7e\u00a1-\u00ac\u00ae-\u017e\u2010-\u2027\u20ac]*")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton over tokens, built by one gadget per merge."""

    def __init__(self) -> None:
        self.closed: dict[tuple[int, int], int] = {}  # (state, arc) -> the gadget that removed the arc
        self.born: dict[int, tuple[int, int, int]] = {}  # token -> (gadget, u, v)

    def gadget(self, u: int, v: int, w: int) -> None:
        number = len(self.closed)
        if w in self.born or (u, v) in self.closed:
            raise ValueError("each token must come from one merge")
        self.closed[(u, v)] = number
        self.born[w] = (number, u, v)

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow the token that leads to ``state``."""
        a, b, last = state, token, len(self.closed)
        while self.closed.get((a, b), last) >= last:
            age_a, age_b = self.born.get(a), self.born.get(b)
            if age_a is None and age_b is None:
                return True
            if age_a is None or (age_b is not None and age_b[0] > age_a[0]):
                last, b = age_b[0] + 1, age_b[1]  # w was added beside u, after its own gadget had closed u's arc v
            else:
                last, a = age_a[0], age_a[2]  # the state behind w began as the state behind v
                if age_b is not None and age_b[0] == age_a[0]:
                    b = age_b[1]
        return False


class Encoder:
    """A vocabulary file compiled for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")")
        self.labels = {i: s.encode() for s, i in {**vocab, **self.special}.items()}
        self.automaton = MergeAutomaton()
        self.length: dict[int, int] = {}
        symbols: dict[int, tuple[int, ...]] = {}
        for s, i in vocab.items():
            if s in letters:
                symbols[i] = (letters[s],)
            elif s.endswith(suffix) and s.removesuffix(suffix) in letters:
                symbols[i] = (letters[s.removesuffix(suffix)] + FINAL,)
        if len(symbols) != 2 * 256:
            raise ValueError("every byte needs a token, inside a word and at its end")
        for pair in model["merges"]:
            u, v = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            w = vocab[self.labels[u].decode() + self.labels[v].decode()]
            self.automaton.gadget(u, v, w)
            symbols[w] = symbols[u] + symbols[v]
        self.child: dict[int, int] = {}  # node * 512 + symbol -> node
        self.token: list[int] = [-1]
        for i, path_ in symbols.items():
            node = 0
            for s in path_:
                node = self.child.setdefault(node << 9 | s, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
            self.length[i] = len(path_)
        self.split = regex.compile(SPLIT)
        self.odd_normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.odd_split = pre_tokenizers.Split(Regex(SPLIT), "removed", invert=True)
        self.lengths = np.zeros(max(self.labels) + 1, np.int64)
        for i, n in self.length.items():
            self.lengths[i] = n
        self.young: dict[str | tuple | int, bytes] = {}  # pieces in use, and those of the turn before
        self.old: dict[str | tuple | int, bytes] = {}
        self._restart()

    def __reduce__(self):
        raise TypeError("workers build their own encoder from the path")

    def _restart(self) -> None:
        """An empty transition table: state 0 is the beginning of a word."""
        self.states: dict[tuple[int, ...], int] = {(0,): 0}
        self.going: list[tuple[int, ...]] = [(0,)]  # open starts of a state: trie node and token before the start, in one number
        self.last = np.full(1 << 16, -1, np.int32)  # token that ends where a state stands
        self.keys = np.full(1 << 19, -1, np.int64)  # state and symbol, found by open addressing
        self.to = np.zeros(1 << 19, np.int32)
        self.arcs = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot where it belongs."""
        mask = len(self.keys) - 1
        at = ((key * np.int64(0x1E3779B97F4A7C15)) >> np.int64(30)) & mask
        odd = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        while len(odd):
            at[odd] = (at[odd] + 1) & mask
            odd = odd[(self.keys[at[odd]] != key[odd]) & (self.keys[at[odd]] != -1)]
        return at

    def _add(self, key: int, to: int) -> None:
        if 2 * self.arcs > len(self.keys):
            old = self.keys != -1
            keys, tos = self.keys[old], self.to[old]
            self.keys, self.to = np.full(2 * len(self.keys), -1, np.int64), np.zeros(2 * len(self.keys), np.int32)
            for k, t in zip(keys.tolist(), tos.tolist(), strict=True):
                self._put(k, t)
        self._put(key, to)
        self.arcs += 1

    def _put(self, key: int, to: int) -> None:
        mask = len(self.keys) - 1
        at = key * 0x1E3779B97F4A7C15 >> 30 & mask
        while self.keys.item(at) != -1:
            at = at + 1 & mask
        self.keys[at], self.to[at] = key, to

    def _compile(self, key: int) -> None:
        """Add the transition of one state under one symbol."""
        state, symbol = key >> 9, key & 511
        going, last = [], -1
        for start in self.going[state]:
            node = self.child.get(start >> 17 << 9 | symbol, 0)
            if node:
                before = (start & 0x1FFFF) - 1
                going.append(node << 17 | before + 1)
                token = self.token[node]
                if token >= 0 and (before < 0 or self.automaton.arc(before, token)):
                    last = token
        if symbol < FINAL:
            going.append(last + 1)
            name = tuple(going)
        else:
            going, name = [], (-1, last)
        to = self.states.setdefault(name, len(self.going))
        if to == len(self.going):
            self.going.append(tuple(going))
            if to == len(self.last):
                self.last = np.concatenate([self.last, np.full(to, -1, np.int32)])
            self.last[to] = last
        self._add(key, to)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pre-split words, laid end to end, and where each word's begin. All words step forward together."""
        if self.arcs > TABLE_ARCS:
            self._restart()
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        ends = np.cumsum(size)
        size, first = size[order], (ends - size)[order]
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        data[ends - 1] += FINAL
        trail = np.zeros(len(data), np.int32)
        state = np.zeros(len(words), np.int64)
        live, i = len(words), 0
        while live:
            key = state[:live] << 9 | data[first[:live] + i]
            at = self._slot(key)
            new = self.keys[at] == -1
            if new.any():
                for k in np.unique(key[new]).tolist():
                    self._compile(k)
                at = self._slot(key)
            state[:live] = self.to[at]
            trail[first[:live] + i] = self.last[state[:live]]
            i += 1
            while live and size[live - 1] <= i:
                live -= 1
        lane, at = np.arange(len(words)), size.copy()
        counts = np.zeros(len(words), np.int64)
        rounds = []
        while len(lane):
            token = trail[first[lane] + at[lane] - 1]
            rounds.append((lane, token))
            counts[lane] += 1
            at[lane] -= self.lengths[token]
            lane = lane[at[lane] > 0]
        placed = np.zeros(len(words), np.int64)
        placed[order] = counts
        begins = np.concatenate([[0], np.cumsum(placed)])
        ids = np.zeros(begins[-1], "<u4")
        tail = begins[order + 1] - 1
        for k, (lane, token) in enumerate(rounds):
            ids[tail[lane] - k] = token
        return ids, begins

    def learn(self, pieces: dict) -> None:
        """Encode new pieces (with the words each splits into) and keep them."""
        flat = [w.encode() for ws in pieces.values() for w in ws]
        ids, begins = self.words(flat)
        packed, at = ids.tobytes(), 0
        for piece, ws in pieces.items():
            self.young[piece] = packed[4 * begins[at] : 4 * begins[at + len(ws)]]
            at += len(ws)

    def pieces(self, text: str) -> list[str | tuple[str]]:
        """A text without special tokens, normal and cut into pieces that split on their own; (word,) is already split."""
        if not text.isascii() or not text.isprintable():
            if not USUAL.fullmatch(text):
                return [(w,) for w, _ in self.odd_split.pre_tokenize_str(self.odd_normal.normalize_str(text))]
            text = unicodedata.normalize("NFC", text)
        return text.lower().split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        cut: list[list] = []
        for text in texts:
            if "<|" in text:
                parts = self.special_split.split(text)
                cut.append([x for p in parts for x in ([self.special[p]] if p in self.special else self.pieces(p))])
            else:
                cut.append(self.pieces(text))
        if len(self.young) > CACHE_PIECES:  # what was used lately stays for one more turn
            self.young, self.old = {}, self.young
        new = {}
        for piece in set().union(*cut):
            if piece not in self.young:
                if isinstance(piece, int):
                    self.young[piece] = np.array([piece], "<u4").tobytes()
                elif (known := self.old.get(piece)) is not None:
                    self.young[piece] = known
                else:
                    new[piece] = list(piece) if isinstance(piece, tuple) else self.split.findall(piece)
        if new:
            self.learn(new)
        return [b"".join(map(self.young.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        """The labels of the arcs, as the vocabulary has no decoder of its own: joined by one blank."""
        return b" ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One compiled encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenize(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", decode: bool = True, keep: tuple[str, ...] = (), digest: bool = False
) -> DataFrame:
    """One row per document row: n_tokens, ids (packed little-endian unsigned 32-bit), decoded text.

    ``digest`` gives decoded_sha256 (lowercase hex) in place of the decoded text, which
    then need not travel back; texts are then coded in smaller slices.

    NULL and empty texts have no tokens and decode to an empty text. Rows are mapped
    one by one, without a shuffle; repeated rows and NULL ids pass through. Columns
    named in ``keep`` go along; their names must not be those of the result. The
    vocabulary file must be readable under ``vocabulary`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            for start, rows in slices(batch.column(1), PACKED_BYTES if digest else SLICE_BYTES):
                packed = coder.encode([t.decode() if t else "" for t in rows])
                columns = [batch.column(0).slice(start, len(rows)), longs(np.array([len(p) // 4 for p in packed], np.int64)), pa.array(packed, pa.binary())]
                if digest:
                    columns.append(pa.array([hashlib.sha256(coder.decode(p)).hexdigest() for p in packed], pa.string()))
                elif decode:
                    columns.append(pa.array(map(coder.decode, packed), pa.binary()).cast(pa.string()))
                columns += [batch.column(2 + i).slice(start, len(rows)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns, names)

    own = [f"keep_{i}" for i in range(len(keep))]  # a column name may hold a dot
    source = pick(docs, doc_id=doc_id, text=text, **dict(zip(own, keep, strict=True)))
    result = ["n_tokens bigint", "ids binary", *(["decoded_sha256 string"] if digest else ["decoded string"] * decode)]
    names = ["doc_id", *[r.split()[0] for r in result], *own]
    kinds = dict(source.dtypes)
    schema = ", ".join([f"doc_id {kinds['doc_id']}", *result, *[f"{c} {kinds[c]}" for c in own]])
    return source.mapInArrow(run, schema).toDF(*names[: len(result) + 1], *keep)
