"""Exact token counts of whole texts by a SentencePiece BPE model; huge texts go through overlapping windows.

A text of over ``chunk`` bytes is encoded window by window. Each window begins at a token boundary of what is encoded so far, ``overlap``
bytes before its end; where a token of the window has the same place as one of the earlier tokens, the two sequences are spliced.

Why a splice there is exact: BPE picks merges by score, then by place, so that the merges inside any run of final tokens are the same as
those of the run alone. Hence a sequence of tokens is the encoding of a text if and only if each two neighbours are the encoding of their
joint text. All neighbours of a sequence spliced behind a common token are neighbours in one of its two parts. Where no token is common,
the overlap is doubled, back to the start of the text at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_texts

#: Bytes of a window, of the first overlap, and of the short texts that are encoded in one call.
CHUNK, OVERLAP, CALL = 1 << 16, 1 << 9, 1 << 20
#: More tokens than this are over the limit.
LIMIT = 4096
#: What the model writes for a blank.
BLANK = "▁"


class Windows:
    """A model and the encoding of long texts in windows of bounded size."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        spec, kinds = proto.normalizer_spec, proto.SentencePiece
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("windows need a BPE model whose normal form of a text is the text")
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("windows need a model without user-defined pieces")
        self.size = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        used = {c for p in proto.pieces if p.type == kinds.NORMAL for c in p.piece}
        self.guard = next(c for c in map(chr, [10, *range(1, 32)]) if c not in used)
        self.skip = len(self.model.encode(self.guard))
        self.chunk, self.overlap = max(4, chunk), max(1, overlap)

    def ends(self, data: bytes, first: bool) -> np.ndarray:
        """Where the tokens of ``data`` end. Unless it is the text's start, a character that merges with nothing stands between it and the blank that the model puts before a text."""
        if not data:
            return np.zeros(0, np.int64)
        text = data.decode()
        ids = self.model.encode(text if first else self.guard + text)
        if first:
            return np.cumsum(self.size[ids]) - len(BLANK.encode())
        return np.cumsum(self.size[ids[self.skip :]])

    def encode(self, text: str) -> tuple[np.ndarray, int, int]:
        """(where each token ends, windows, times that an overlap was doubled) in bytes of the text with ``BLANK`` for blanks."""
        data = text.replace(" ", BLANK).encode()
        raw = np.frombuffer(data, np.uint8)

        def start_of_char(at: int) -> int:
            while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
                at -= 1
            return at

        # tokens of the text's first ``done`` bytes, exactly as the model encodes these alone
        done = start_of_char(min(len(raw), self.chunk))
        ends, windows, doubled = self.ends(data[:done], True), 1, 0
        settled: list[np.ndarray] = []  # ends before those of ``ends``, set aside so that a splice copies little
        while done < len(raw):
            stop, overlap = start_of_char(min(len(raw), done + self.chunk)), self.overlap
            while True:
                k = int(np.searchsorted(ends, done - overlap, side="right")) - 1  # token k ends at or before the window's start
                while k >= 0 and raw[ends[k]] & 0xC0 == 0x80:  # between the bytes of a character
                    k -= 1
                if k < 0 and settled:
                    ends = np.concatenate([settled.pop(), ends])
                    continue
                windows += 1
                begin = int(ends[k]) if k >= 0 else 0
                own = self.ends(data[begin:stop], begin == 0) + begin
                if begin == 0:
                    ends = own
                    break
                # (start, end) of the tokens on both sides, starts being the ends before
                left = np.stack([ends[k:-1], ends[k + 1 :]])
                right = np.stack([np.concatenate([[begin], own[:-1]]), own])
                _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
                same = np.flatnonzero(left[1][i] == right[1][j])
                if len(same):
                    at = same[len(same) // 2]
                    ends = np.concatenate([ends[: k + 2 + i[at]], own[j[at] + 1 :]])
                    break
                overlap, doubled = overlap * 2, doubled + 1
            done = stop
            if len(ends) > 2 * self.chunk:
                settled.append(ends[: -self.chunk])
                ends = ends[-self.chunk :]
        return np.concatenate([*settled, ends]), windows, doubled


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens), windows, widened.

    Counts are the model's own for the whole text, without begin and end tokens. A null text is empty and has no tokens, as the model says of
    the empty text; repeated and null ids keep a row each; other columns are not looked at, whatever their names. An empty table gives no rows.
    Texts of ``chunk`` bytes or fewer are encoded whole, in calls of about ``CALL`` bytes; windows is 1 and widened 0 for them.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batches):
        coder = Windows(path, chunk, overlap)
        for batch in batches:
            raw = clean_texts(batch, "text")
            n = np.diff(np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]) if len(raw) else np.zeros(0, np.int64)
            tokens, windows, doubled = np.zeros(len(n), np.int64), np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
            some, size = [], 0
            for i in [*np.flatnonzero(n <= chunk), None]:
                if i is None or (some and size + n[i] > CALL):
                    tokens[some] = [len(x) for x in coder.model.encode([raw[int(k)].as_py().decode() for k in some], num_threads=1)]
                    some, size = [], 0
                if i is not None and n[i]:
                    some.append(i)
                    size += n[i]
            for i in np.flatnonzero(n > chunk):
                ends, windows[i], doubled[i] = coder.encode(raw[int(i)].as_py().decode())
                tokens[i] = len(ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in (n, tokens, tokens > limit, windows, doubled))],
                ["id", "n_bytes", "n_tokens", "over_limit", "windows", "widened"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(work, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, windows long, widened long")
    return out.withColumnRenamed("id", id_col)
