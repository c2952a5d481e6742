"""Byte-level BPE by prefix dynamic programming.

Of all tokens that end a byte string, exactly one can be the last token of its BPE
encoding.  For each prefix of a piece (the pre-tokenizer's unit) that token is
stored; the encoding is read off backwards.  A token t may follow the prefix before it
if t and that prefix's last token would not have merged otherwise, which a walk down
both tokens' merge trees decides.  So an append goes on from the stored prefixes, and
an edit re-encodes from the piece before it until pieces, or the stored tokens of a long piece, fall together again.

Whole Arrow chunks are handled at once: pieces are cut and hashed with numpy, each
distinct piece is encoded once a worker, and documents are gathered from those.

Defined cases: a text without bytes has no tokens; a piece of any length (one letter a million times, base64, text
without spaces) takes time in proportion to its bytes; equal pieces have equal tokens wherever they stand.
"""

from __future__ import annotations

import base64
import unicodedata
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa

from . import textkit as K

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_EXACT = np.random.default_rng(20240118).integers(1, 1 << 64, 256, dtype=np.uint64)
START, APART = -1, "\u0100"
CACHED_PIECES, KNOWN_PAIRS = 1_500_000, 500_000
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
_BLANKS = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    if not _classes:
        kind = np.full(0x110000, OTHER, np.uint8)
        for lo, hi in ((0, 0x32000), (0xE0000, 0xE0200)):
            kind[lo:hi] = [{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(lo, hi)]
        kind[_BLANKS] = BLANK
        _classes.append(kind)
    return _classes[0]


def _exact_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return K.span_hash(K.prefix_hash(buf, _EXACT), start, end)


class Bpe:
    """A byte-level BPE vocabulary, given as ranks, with its merge trees."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes = [b""] * size
        for t, r in ranks.items():
            self.bytes[r] = t
        self.length = np.array([len(t) for t in self.bytes], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.left, self.right = list(range(size)), list(range(size))
        for t, r in ranks.items():
            if len(t) > 1:
                self.left[r], self.right[r] = self._split(t, r)
        self.merges = {a << 32 | b: r for r, (a, b) in enumerate(zip(self.left, self.right)) if a != r}
        self.longest = int(self.length.max())

    @classmethod
    def load(cls, path: str = TOKENIZER) -> Bpe:
        with Path(path).open("rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _split(self, token: bytes, rank: int) -> tuple[int, int]:
        parts = [bytes([x]) for x in token]
        while len(parts) > 2:
            i = min(range(len(parts) - 1), key=lambda j: self.ranks.get(parts[j] + parts[j + 1], 1 << 40))
            if self.ranks.get(parts[i] + parts[i + 1], 1 << 40) >= rank:
                raise ValueError(f"token {rank} is out of reach of the merges")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_automaton", "_apart")}

    def automaton(self) -> ahocorasick.Automaton:
        """All tokens, with bytes as the characters of Latin-1; built once a worker."""
        if "_automaton" not in self.__dict__:
            self._automaton, self._apart = ahocorasick.Automaton(), {}
            for r, t in enumerate(self.bytes):
                if t:
                    self._automaton.add_word(t.decode("latin-1"), (r, len(t)))
            self._automaton.make_automaton()
        return self._automaton

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves the two tokens apart when they meet."""
        limit, merges, left, right = 1 << 40, self.merges, self.left, self.right
        while True:
            if merges.get(a << 32 | b, limit) < limit:
                return False
            # take apart the younger token; if it is a single byte, the other one
            if (a > b and right[a] != a) or (a <= b and left[b] == b and right[a] != a):
                limit, a = a, right[a]
            elif left[b] != b:
                limit, b = b + 1, left[b]
            else:
                return True

    def fill(self, text: str, last: list[int], begin: int = 0, old: list[int] | None = None, tail: int = 0) -> int:
        """Set last[i], for i from begin, to the last token of the encoding that ends with the byte i of text.

        Bytes are the characters of Latin-1; APART separates pieces, and last is START there.  Of the tokens that end at
        a byte, which the automaton lists, the one that may follow what is before it is taken, so the work is in
        proportion to the bytes.  With old, the values of an earlier text that ends alike from tail on, it
        stops where as many values as the longest token has bytes agree, for all that follow agree too.  Returns where it stopped.
        """
        tokens = self.automaton()
        apart, may_follow = self._apart, self.may_follow
        if len(apart) > KNOWN_PAIRS:
            apart.clear()
        done, alike, shift = -1, 0, 0 if old is None else len(text) - len(old)
        for e, (t, n) in tokens.iter(text, max(0, begin - self.longest)):
            if e == done or e < begin:
                continue
            before = last[e - n] if e >= n else START
            if before >= 0:
                key = before << 32 | t
                ok = apart.get(key)
                if ok is None:
                    ok = apart[key] = may_follow(before, t)
                if not ok:
                    continue
            last[e] = t
            done = e
            if old is not None:
                alike = alike + 1 if e >= tail and e >= shift and old[e - shift] == t else 0
                if alike >= self.longest:
                    return e + 1
        return len(text)

    def last_tokens(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each byte of the pieces (laid end to end), the last token of the piece's encoding up to it."""
        raw = buf.tobytes().decode("latin-1")
        text = APART.join(raw[a:b] for a, b in zip(start.tolist(), end.tolist()))
        last = [START] * len(text)
        self.fill(text, last)
        found = np.array(last, np.int32)
        return found[found != START]

    def walk_back(self, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces end to end, and offsets, from last_tokens() of pieces of n bytes."""
        upto = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        tokens, size = last.tolist(), self.length.tolist()
        out: list[int] = []
        count = []
        for begin, at in zip(upto[:-1].tolist(), upto[1:].tolist()):
            had = len(out)
            while at > begin:
                t = tokens[at - 1]
                out.append(t)
                at -= size[t]
            out[had:] = out[had:][::-1]
            count.append(len(out) - had)
        return np.array(out, np.int32), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        return Encoder(self).encode_column(pa.array([text]))[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(self.bytes[i] for i in ids)

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        off = np.cumsum(n) - n
        return self.flat[np.repeat(self.start[ids] - off, n) + np.arange(int(n.sum()))]

    def round_trips(self, ids: np.ndarray, first: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether each document's tokens decode to its bytes."""
        size = np.concatenate([[0], np.cumsum(self.length[ids])])
        if not np.array_equal(size[first], off):
            return np.array([self.decode(ids[a:b].tolist()) == buf[c:d].tobytes() for a, b, c, d in zip(first, first[1:], off, off[1:])])
        wrong = np.concatenate([[0], np.cumsum(self.decode_flat(ids) != buf)])
        return wrong[off[1:]] == wrong[off[:-1]]


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions where pieces begin: contractions, runs of letters, numbers or other signs with one space before, white space."""
    if not len(buf):
        return np.zeros(0, np.int64)
    where = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = char_classes()[cp]
    n = len(cp)
    doc = np.zeros(n + 1, bool)
    doc[np.searchsorted(where, off)] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    b = change | doc[:n]
    blank = kind == BLANK
    tail = np.flatnonzero(blank[:-1] & ~blank[1:] & ~doc[1:n])
    b[tail] = True
    b[tail[cp[tail] == 32] + 1] = False
    pad = np.concatenate([cp, np.zeros(3, np.uint32)])
    edge = np.concatenate([doc, np.ones(3, bool)])
    q = np.flatnonzero(b & (cp == 39))
    q = q[~edge[q + 1]]
    one = q[np.isin(pad[q + 1], [ord(c) for c in "sdmt"])]
    two = q[~edge[q + 2]]
    x, y = pad[two + 1], pad[two + 2]
    two = two[((x == ord("l")) & (y == ord("l"))) | (((x == ord("v")) | (x == ord("r"))) & (y == ord("e")))]
    b = np.concatenate([b, np.ones(4, bool)])
    b[one + 1] = False
    b[one + 2] = True
    b[two + 1] = b[two + 2] = False
    b[two + 3] = True
    return where[np.flatnonzero(b[:n])]


class Encoder:
    """Encodes text columns; keeps the distinct pieces it has met."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index in the store of each piece, and each document's first piece (one more at the end)."""
        start = piece_starts(buf, off)
        end = np.append(start[1:], len(buf))
        h = _exact_hashes(buf, start, end)
        uniq, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > CACHED_PIECES:
            self._reset()
        at = np.searchsorted(self.keys, uniq)
        new = np.ones(len(uniq), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != uniq[inside]
        if new.any():
            s, e = start[sample[new]], end[sample[new]]
            tokens, o = self.bpe.walk_back(self.bpe.last_tokens(buf, s, e), e - s)
            number = len(self.first) + np.arange(len(s))
            self.first = np.append(self.first, len(self.ids) + o[:-1])
            self.count = np.append(self.count, np.diff(o))
            self.ids = np.append(self.ids, tokens)
            self.keys = np.insert(self.keys, at[new], uniq[new])
            self.place = np.insert(self.place, at[new], number)
            at = np.searchsorted(self.keys, uniq)
        return self.place[at][inverse], np.searchsorted(start, off)

    def encode_bytes(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the documents end to end, and each document's first token (one more at the end)."""
        p, first = self.pieces(buf, off)
        n = self.count[p]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.first[p] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[first]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        p, first = self.pieces(*K.text_bytes(column))
        return np.diff(np.concatenate([[0], np.cumsum(self.count[p])])[first])

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        ids, first = self.encode_bytes(*K.text_bytes(column))
        return [ids[a:b] for a, b in zip(first, first[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(bpe: Bpe, name: str) -> Encoder:
    """This worker's encoder of the vocabulary, with the pieces of earlier tasks."""
    if name not in _encoders:
        _encoders[name] = Encoder(bpe)
    return _encoders[name]


class PrefixState:
    """A text with the last token of every byte prefix of its pieces; appends and edits keep it exact."""

    def __init__(self, bpe: Bpe, text: str = ""):
        self.bpe, self.text = bpe, b""
        self.starts, self.last = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace the bytes [start, end).  Pieces well before and after the edit keep their stored tokens."""
        put_b = put.encode()
        text = self.text[:start] + put_b + self.text[end:]
        shift = len(put_b) - (end - start)
        # a piece ends by what follows it within two pieces: begin two pieces before the edit
        i = max(0, int(np.searchsorted(self.starts, start, "right")) - 3)
        at = int(self.starts[i]) if len(self.starts) else 0
        head_starts, head_last = self.starts[:i], self.last[:at]
        old_after = self.starts[self.starts >= end] + shift
        stop, tail_starts, tail_last = len(text), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for j in range(2, len(old_after)):
            cut = int(old_after[j])
            new = piece_starts(np.frombuffer(text[at : min(len(text), int(old_after[min(j + 2, len(old_after) - 1)]))], np.uint8), np.array([0])) + at
            if cut in new and int(old_after[j - 1]) in new:
                stop, tail_starts, tail_last = cut, old_after[j:], self.last[cut - shift :]
                break
        more = len(text[stop : stop + 64].decode("utf-8", "ignore").encode())
        fresh = piece_starts(np.frombuffer(text[at : stop + more], np.uint8), np.array([0])) + at
        fresh = fresh[fresh < stop]
        ends = np.append(fresh[1:], stop)
        mid = [self._piece(text, int(x), int(y), start, start + len(put_b), shift) for x, y in zip(fresh, ends)]
        self.text = text
        self.starts = np.concatenate([head_starts, fresh, tail_starts])
        self.last = np.concatenate([head_last, *mid, tail_last]).astype(np.int32)

    def _piece(self, text: bytes, x: int, y: int, start: int, put_end: int, shift: int) -> np.ndarray:
        """Last tokens of the piece [x, y) of the new text; what the old one stores of it before and after the edit is used again."""
        known, old = 0, None
        last = [START] * (y - x)
        bounds = np.append(self.starts, len(self.text))
        i = int(np.searchsorted(self.starts, x))
        if x <= start and i < len(self.starts) and self.starts[i] == x:
            known = max(0, min(start, y, int(bounds[i + 1])) - x)
            last[:known] = self.last[x : x + known].tolist()
        j = int(np.searchsorted(bounds, y - shift))
        if y > put_end and 0 < j < len(bounds) and bounds[j] == y - shift:
            old = self.last[int(bounds[j - 1]) : y - shift].tolist()
        if known < y - x:
            stop = self.bpe.fill(text[x:y].decode("latin-1"), last, known, old, max(0, put_end - x))
            if stop < y - x:
                last[stop:] = old[stop - (y - x) :]
        return np.array(last, np.int32)

    def ids(self) -> list[int]:
        n = np.append(self.starts[1:], len(self.text)) - self.starts
        return self.bpe.walk_back(self.last, n)[0].tolist()
