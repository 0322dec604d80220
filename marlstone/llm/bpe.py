"""Byte-level BPE by a lazily determinised transducer, and streaming decode.

A token sequence is the BPE encoding of its bytes exactly if no token could have been made otherwise
and each pair of neighbours, encoded by itself, gives that pair back. So a text is read byte by byte: a state holds
every place where the token under way may have begun (its vocabulary trie node, and the token that ends there),
and reading a byte tells the one token that ends the encoding of the bytes read so far. States and moves are made when
first needed; a token is sure once all open places share it. Pieces up to LONG bytes go through the machine together and are read back
from their ends; a longer one is streamed: its tokens are emitted as soon as they are sure, after a lookahead of some longest tokens, so memory doesn't grow with the piece.
Decoding is streamed too: a machine of nine states over bytes holds back the bytes of an unfinished character until the next tokens end it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States kept by a worker, and pieces whose tokens it remembers (twice so many with the older half; 40 MB of prose have 0.5 million); beyond these it starts anew.
MAX_STATES = 130_000
MAX_PIECES = 200_000
MAX_PAIRS = 200_000
NONE = -1
#: Bytes of a piece from which it is streamed; ids that are decoded at once.
LONG = 4096
CHUNK = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes pieces; ``ranks`` maps token bytes to ids, in the order of the merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token = [NONE]
        self.depth = [0]
        for t, i in ranks.items():
            node = 0
            for b in t:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(NONE)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token[node] = i
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.sizes = np.zeros(max(self.text) + 1, np.int64)
        for i, t in self.text.items():
            self.sizes[i] = len(t)
        self.column = np.full(256, NONE, np.int64)
        self.columns = 0
        self._restart()

    def _restart(self) -> None:
        #: A state: the open places (trie node, token that ends there), the longest first, as packed integers; the start has one at the root after no token.
        start = array("i", (0, NONE)).tobytes()
        self.ids: dict[bytes, int] = {start: 0}
        self.states: list[bytes] = [start]
        #: 0: not made yet, for no move leads back to the start. Memory is taken as rows are first written, and none is copied while they suffice.
        self.moves = np.zeros((MAX_STATES + 1024, max(64, self.columns)), np.int32)
        self.last = np.full(MAX_STATES + 1024, NONE, np.int32)

    def _places(self, state: int) -> list[tuple[int, int]]:
        flat = memoryview(self.states[state]).cast("i").tolist()
        return list(zip(flat[::2], flat[1::2]))

    def merge(self, piece: bytes) -> list[int]:
        """The encoding by merges, lowest rank first: the definition, for short byte strings."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes ``token``; None for a byte, and for a token that no merges make."""
        if token in self.made:
            return self.made[token]
        whole, out = self.text[token], None
        parts = [bytes([b]) for b in whole]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            if best == token and len(parts) == 2:
                out = (self.ranks[parts[0]], self.ranks[parts[1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.made[token] = out
        return out

    def _follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand after ``left``: no merge over their border comes before those that make the two.

        Walks back in time over the pairs (x, y) that ever stood at the border: the later made of the two is taken apart first.
        """
        if len(self.text[right]) > 1 and self._halves(right) is None:
            return False
        if left == NONE:
            return True
        key = left << 32 | right
        if key in self.pairs:
            return self.pairs[key]
        text, x, y, until_x, until_y, ok = self.text, left, right, None, None, True
        while True:
            c = self.ranks.get(text[x] + text[y])
            if c is not None and (until_x is None or c < until_x) and (until_y is None or c <= until_y):
                ok = False
                break
            half_x, half_y = self._halves(x), self._halves(y)
            if half_x is None and half_y is None:
                break
            if half_y is None or half_x is not None and x > y:
                until_x, x = x, half_x[1]
            else:
                until_y, y = y, half_y[0]
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _move(self, state: int, byte: int) -> int:
        ends, places = NONE, []
        for node, before in self._places(state):
            nxt = self.trie[node].get(byte)
            if nxt is None:
                continue
            if ends == NONE and (t := self.token[nxt]) != NONE and self._follows(before, t):
                ends = t
            if self.trie[nxt]:
                places += (nxt, before)
        key = array("i", (*places, 0, ends)).tobytes()
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.moves):
                more = max(1024, len(self.moves) // 4)
                self.moves = np.concatenate([self.moves, np.zeros((more, self.moves.shape[1]), np.int32)])
                self.last = np.concatenate([self.last, np.full(more, NONE, np.int32)])
            self.last[to] = ends
        self.moves[state, self.column[byte]] = to
        return to

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece. All pieces take their next byte together; only new moves are made in Python."""
        out: list[list[int]] = [None] * len(pieces)  # type: ignore[list-item]
        work = []
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = [whole]
            elif len(p) > LONG:
                out[k] = list(self.stream(p))
            elif p:
                work.append(k)
            else:
                out[k] = []
        for group in self._groups(pieces, work):
            if len(self.states) > MAX_STATES:
                self._restart()
            self._encode_group([pieces[k] for k in group], group, out)
        return out

    def stream(self, data, lag: list[int] | None = None):
        """Token ids of bytes (any iterable), each as soon as it is sure. ``lag`` gets how many bytes each token waited after its end.

        ``last`` holds, for places since the point that is sure, the token that ends there; a place's tokens are read back by it. What all open places
        read back to is sure.
        """
        state, pos, sure, last = 0, 0, 0, {}
        longest = max(map(len, self.ranks))
        for byte in data:
            if len(self.states) > MAX_STATES:  # a new start keeps the open places
                key = self.states[state]
                self._restart()
                state = self.ids.setdefault(key, len(self.states))
                if state == len(self.states):
                    self.states.append(key)
                    self.last[state] = self._places(state)[-1][1]
            self._seat(np.array([byte], np.uint8))
            nxt = int(self.moves[state, self.column[byte]])
            state = nxt or self._move(state, byte)
            pos += 1
            last[pos] = int(self.last[state])
            if pos - sure >= 2 * longest:
                points = {pos - self.depth[node] for node, _ in self._places(state)}
                while len(points) > 1:
                    far = max(points)
                    points.remove(far)
                    points.add(far - int(self.sizes[last[far]]))
                point = points.pop()
                yield from self._read_back(sure, point, last, pos, lag)
                for k in range(sure, point + 1):
                    last.pop(k, None)
                sure = point
        yield from self._read_back(sure, pos, last, pos, lag)

    def _read_back(self, start: int, end: int, last: dict[int, int], pos: int, lag: list[int] | None) -> list[int]:
        out, at = [], end
        while at > start:
            out.append(last[at])
            if lag is not None:
                lag.append(pos - at)
            at -= int(self.sizes[last[at]])
        return out[::-1]

    @staticmethod
    def _groups(pieces, work, limit: int = 1 << 20):
        """Pieces by length, so that a group's table of last tokens is about ``limit`` bytes long at most, one piece at least."""
        work = sorted(work, key=lambda k: -len(pieces[k]))
        at = 0
        while at < len(work):
            n = max(1, limit // len(pieces[work[at]]))
            yield work[at : at + n]
            at += n

    def _seat(self, data: np.ndarray) -> np.ndarray:
        """Columns of the table of moves for bytes; a byte gets one when it first comes."""
        seen = np.flatnonzero(np.bincount(data, minlength=256))
        for b in seen[self.column[seen] == NONE]:
            self.column[b] = self.columns
            self.columns += 1
        if self.columns > self.moves.shape[1]:
            n, wide = len(self.states), self.moves.shape[1]
            more = np.zeros((len(self.moves), 32 * -(-self.columns // 32)), np.int32)
            more[:n, :wide] = self.moves[:n]
            self.moves = more
        return self.column[data]

    def _encode_group(self, pieces: list[bytes], group: list[int], out: list) -> None:
        lengths = np.array([len(p) for p in pieces])
        start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        seats = self._seat(data)
        ends = np.empty(len(data), np.int32)
        state = np.zeros(len(pieces), np.int64)
        for pos in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -pos, side="left"))  # pieces longer than pos come first
            byte = data[start[:n] + pos]
            seat = seats[start[:n] + pos]
            nxt = self.moves[state[:n], seat]
            new = np.flatnonzero(nxt == 0)
            if len(new):
                for key in {(a, b) for a, b in zip(state[new].tolist(), byte[new].tolist())}:
                    self._move(*key)
                nxt = self.moves[state[:n], seat]
            state[:n] = nxt
            ends[start[:n] + pos] = self.last[nxt]
        # from each piece's end, token by token to its start; all pieces together
        at, left, steps = start + lengths, np.arange(len(pieces)), []
        while len(left):
            token = ends[at[left] - 1]
            steps.append((left, token))
            at[left] -= self.sizes[token]
            left = left[at[left] > start[left]]
        owner, token = np.concatenate([x[0] for x in steps]), np.concatenate([x[1] for x in steps])
        step = np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps])
        order = np.lexsort((-step, owner))
        token = token[order].tolist()
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(pieces)))]).tolist()
        for k, a, b in zip(group, bounds, bounds[1:]):
            out[k] = token[a:b]


def _utf8_machine() -> np.ndarray:
    """Next state by state and byte. 0: between characters; 1 to 3: so many bytes to come; 4 to 7: second byte after E0, ED, F0, F4, which have ranges of their own; 8: no UTF-8."""
    t = np.full((9, 256), 8, np.uint8)
    t[0, :0x80] = 0
    t[0, 0xC2:0xE0], t[0, 0xE1:0xF0], t[0, 0xF1:0xF4] = 1, 2, 3
    t[0, 0xE0], t[0, 0xED], t[0, 0xF0], t[0, 0xF4] = 4, 5, 6, 7
    for k in (1, 2, 3):
        t[k, 0x80:0xC0] = k - 1
    t[4, 0xA0:0xC0], t[5, 0x80:0xA0], t[6, 0x90:0xC0], t[7, 0x80:0x90] = 1, 1, 2, 2
    return t


class Utf8Decoder:
    """Incremental decoding of token ids: ``feed`` gives the bytes of finished characters, those of an unfinished one wait for the next tokens.

    Nearly all tokens begin and end between characters; only at others the machine goes byte by byte. Bytes that are no UTF-8 pass as they are (``text`` replaces them).
    """

    table = _utf8_machine()

    def __init__(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, after: np.ndarray):
        self.flat, self.starts, self.sizes, self.after = flat, starts, sizes, after
        self.state, self.held = 0, b""

    @classmethod
    def ends(cls, text: dict[int, bytes], n: int) -> np.ndarray:
        """The state after each token that begins between characters."""
        out = np.zeros(n, np.uint8)
        for i, t in text.items():
            state = 0
            for b in t:
                state = cls.table[state, b]
            out[i] = state
        return out

    def feed(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        data = self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])]
        odd, state, at = np.flatnonzero(self.after[ids] != 0), self.state, 0
        while True:
            if state == 0:  # on to the next token that ends inside a character
                k = int(np.searchsorted(odd, at))
                if k == len(odd):
                    break
                at = int(odd[k])
            if at == len(ids):
                break
            for b in data[ends[at] - sizes[at] : ends[at]].tolist():
                step = int(self.table[state, b])
                state = step if step != 8 else int(self.table[0, b]) % 8  # a wrong byte ends the character and may begin another
            at += 1
        self.state, whole = state, self.held + data.tobytes()
        keep = len(whole)
        if state:
            keep -= 1
            while keep and whole[keep] & 0xC0 == 0x80:
                keep -= 1
        self.held = whole[keep:]
        return whole[:keep]

    def end(self) -> bytes:
        out, self.held, self.state = self.held, b"", 0
        return out


class Codec:
    """Encodes and decodes texts; holds a worker's transducer and the tokens of recent pieces."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(load_ranks(path))
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        text = self.transducer.text
        self.names = [str(i) for i in range(len(self.transducer.sizes))]
        self.sizes = self.transducer.sizes
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.flat = np.frombuffer(b"".join(text.get(i, b"") for i in range(len(self.sizes))), np.uint8)
        self.after = Utf8Decoder.ends(text, len(self.sizes))

    def learn(self, found: set[str]) -> None:
        """Encode the pieces that are not remembered; half of the memory is for those met lately, half for those met again since."""
        missing = []
        for p in found.difference(self.pieces):
            old = self.older.get(p)
            if old is None:
                missing.append(p)
            else:
                self.pieces[p] = old
        if len(self.pieces) + len(missing) > MAX_PIECES:
            self.older = self.pieces
            self.pieces = {}
            for p in found.intersection(self.older):
                self.pieces[p] = self.older[p]
        for p, ids in zip(missing, self.transducer.encode_pieces([p.encode("utf-8", "surrogatepass") for p in missing])):
            self.pieces[p] = array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[str, np.ndarray]]:
        """(ids as decimal text, ids) of each text."""
        split = [self.split(t) if t else [] for t in texts]
        out, at = [], 0
        while at < len(split):  # so many texts at once that their pieces fit in memory
            end, n = at, 0
            while end < len(split) and (end == at or n + len(split[end]) <= 100_000):
                n += len(split[end])
                end += 1
            self.learn(set().union(*split[at:end]))
            get, name = self.pieces.__getitem__, self.names.__getitem__
            for s in split[at:end]:
                ids = np.frombuffer(b"".join(map(get, s)), np.int32)
                out.append((",".join(map(name, ids.tolist())), ids))
            at = end
        return out

    def decode(self, ids: np.ndarray):
        """The bytes of the ids, part by part, each of whole characters."""
        machine = Utf8Decoder(self.flat, self.starts, self.sizes, self.after)
        for at in range(0, len(ids), CHUNK):
            yield machine.feed(ids[at : at + CHUNK])
        yield machine.end()

    def decoded_sha256(self, ids: np.ndarray) -> str:
        digest = hashlib.sha256()
        for part in self.decode(ids):
            digest.update(part)
        return digest.hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's own codec, made once: a vocabulary of fixed size read from each machine's own files."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per input row: id, tokens (null unless asked for), n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens; texts of any length are taken whole. Special tokens are ordinary text.
    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the bytes that the ids decode to. One pass, no shuffle.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                done = own.encode(texts.slice(at, 256).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, 256),
                        pa.array([x[1] if ids else None for x in done], pa.list_(pa.int32())),
                        pa.array([len(x[1]) for x in done], pa.int64()),
                        pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in done]),
                        pa.array([own.decoded_sha256(x[1]) for x in done]),
                    ],
                    ["id", "tokens", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            del batch, texts
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, tokens array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def decode_tokens(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "tokens") -> DataFrame:
    """id and text of arrays of token ids, decoded part by part with an incremental UTF-8 machine; null arrays give ''.

    Unknown ids fail the task; bytes that are no UTF-8 become U+FFFD.
    """
    kind = dict(rows.dtypes)[id_col]

    def work(batches):
        own = codec(path, pattern)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                out.append("".join(part.decode("utf-8", "replace") for part in own.decode(np.array(ids or [], np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(work, f"id {kind}, text string").withColumnRenamed("id", id_col)
