"""SentencePiece BPE with byte fallback: encoding by vectorised merge rounds, decoding by ragged gathers.

Encoding. All distinct words of a slice go through the merge rounds of `merges`; the rank of a pair is the place of the piece
that both make together. A word here is a run of spaces with the characters up to the next space: no piece of the vocabulary
has a space after another character, so no merge crosses the cut (checked when the vocabulary is loaded).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.flat import WordTable, gather, hold, slices, sums, text_bytes, token_file, words_of
from tamis.llm.merges import Merges

MODEL = "piece_bpe_32k.model"
SPACE = "▁"


class PieceTokens:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=token_file(path))
        self.size = n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte = np.array([model.is_byte(i) for i in range(n)])
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)])
        if any(SPACE in p.lstrip(SPACE) for p, b, s in zip(names, byte, special, strict=True) if not b and not s):
            raise ValueError("a piece has a space after another character; words are not independent")
        order = sorted((i for i in range(n) if not byte[i] and not special[i]), key=lambda i: -model.get_score(i))
        rank = {i: r for r, i in enumerate(order)}
        known = {names[i]: i for i in order}
        self.of_byte = np.zeros(256, np.int32)
        for i in np.flatnonzero(byte):
            self.of_byte[int(names[i][3:5], 16)] = i
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int32)  # a character without a piece stands for itself
        for p, i in known.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[32] = self.of_char[ord(SPACE)]
        keys, made = [], []
        for p, i in known.items():
            for k in range(1, len(p)):
                a, b = known.get(p[:k]), known.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
        ranks = np.fromiter((rank[i] for i in made), np.int32, len(made))
        self.merges = Merges(np.array(keys, np.int64), ranks, np.array(order, np.int32), n)
        outs = [b"" if special[i] else bytes([int(names[i][3:5], 16)]) if byte[i] else names[i].replace(SPACE, " ").encode()
                for i in range(n)]
        unknown = next((i for i in range(n) if model.is_unknown(i)), None)
        if unknown is not None:
            outs[unknown] = " ⁇ ".encode()
        self.is_byte = byte
        self.is_foreign = np.zeros(n, bool)  # bytes of characters outside ASCII
        self.is_foreign[self.of_byte[128:]] = True
        self.is_control = np.array([model.is_control(i) for i in range(n)])
        self.out_flat = np.frombuffer(b"".join(outs), np.uint8)
        self.out_length = np.fromiter(map(len, outs), np.int64, n)
        self.out_start = np.cumsum(self.out_length) - self.out_length
        self.starts_space = np.array([not byte[i] and not special[i] and outs[i][:1] == b" " for i in range(n)])
        decimals = [f"{i},".encode() for i in range(n)]
        self.dec_flat = np.frombuffer(b"".join(decimals), np.uint8)
        self.dec_length = np.fromiter(map(len, decimals), np.int64, n)
        self.dec_start = np.cumsum(self.dec_length) - self.dec_length
        self.table = WordTable(self._compute)

    def _compute(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols, lengths = self.merges.run(self.of_char[points], lengths)
        odd = symbols >= self.size
        if odd.any():  # characters without a piece become the pieces of their bytes
            coded = [chr(c).encode("utf-8", "replace") for c in symbols[odd] - self.size]
            wide = np.ones(len(symbols), np.int64)
            wide[odd] = np.fromiter(map(len, coded), np.int64, len(coded))
            lengths = sums(wide, np.concatenate(([0], np.cumsum(lengths))))
            is_odd = np.repeat(odd, wide)
            symbols = np.repeat(symbols, wide)
            symbols[is_odd] = self.of_byte[np.frombuffer(b"".join(coded), np.uint8)]
        return symbols, lengths

    def tables(self) -> tuple[WordTable, ...]:
        return (self.table,)

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the ids by text)."""
        hold(self)
        mark = SPACE.encode()
        if mark in body.tobytes():
            texts = [body[a:b].tobytes().replace(mark, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            body = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        body = np.insert(body, offsets[filled], 32)  # the library sets one space before a text
        offsets = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
        cut = (body == 32) & (np.concatenate(([0], body[:-1])) != 32)
        cut[offsets[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(body))
        at, lengths = self.table.look_up(words_of(body, starts, ends))
        by_text = np.searchsorted(starts, offsets)
        return gather(self.table.flat, at, lengths), np.concatenate(([0], np.cumsum(sums(lengths, by_text))))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, offsets by text) of the ids. Bytes that make no valid UTF-8 become U+FFFD, one each."""
        starts, lengths = self.out_start[ids], self.out_length[ids].copy()
        some = offsets[:-1] < offsets[1:]
        first = offsets[:-1][some]
        # the first piece that isn't a control piece loses the space that the encoder has set
        if len(first) and self.is_control[ids[first]].any():
            plain = np.flatnonzero(~self.is_control[ids])
            place = np.searchsorted(plain, offsets)
            first = plain[place[:-1][place[:-1] < place[1:]]]
        cut = first[self.starts_space[ids[first]]]
        starts = starts.copy()
        starts[cut] += 1
        lengths[cut] -= 1
        body = gather(self.out_flat, starts, lengths)
        out = np.concatenate(([0], np.cumsum(sums(lengths, offsets))))
        if self.is_byte[ids].any():
            run = np.where(self.is_byte[ids], np.cumsum(~self.is_byte[ids]) + 1, 0)  # a number for each run of byte pieces
            body, out = _mended(body, out, np.repeat(run, lengths), bool(self.is_control[ids].any()))
        return body, out

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the decimal ids, each with a comma after it."""
        lengths = self.dec_length[ids]
        return gather(self.dec_flat, self.dec_start[ids], lengths), np.concatenate(([0], np.cumsum(sums(lengths, offsets))))


def _mended(body: np.ndarray, offsets: np.ndarray, raw: np.ndarray, broken: bool) -> tuple[np.ndarray, np.ndarray]:
    """Replace what isn't valid UTF-8 inside each run of byte pieces (numbered in `raw`, 0: none). `broken`: control pieces may
    part runs whose bytes are neighbours."""
    if not broken:
        try:
            body.tobytes().decode("utf-8")
            return body, offsets
        except UnicodeDecodeError:
            pass
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        part = body[a:b].tobytes()
        out.append(_mend_runs(part, raw[a:b]) if raw[a:b].any() else part)
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in out])))


def _mend_runs(part: bytes, raw: np.ndarray) -> bytes:
    edges = np.flatnonzero(np.diff(np.concatenate(([-1], raw, [-1]))))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if not raw[a]:
            out.append(part[a:b])
            continue
        k = a
        while k < b:
            size = next((s for s in (1, 2, 3, 4) if k + s <= b and _is_char(part[k:k + s])), 0)
            out.append(part[k:k + size] if size else b"\xef\xbf\xbd")
            k += size or 1
    return b"".join(out)


def _is_char(x: bytes) -> bool:
    try:
        return len(x.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def piece_tokens(path: str = MODEL) -> PieceTokens:
    return PieceTokens(path)


def encode_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, as the library encodes it without begin and end ids.

    A null or empty text has no ids. Rows with a repeated or null id are encoded as they come. Other columns are left out."""

    def run(batches):
        coder = piece_tokens(model)
        for part in slices(batches):
            body, offsets = text_bytes(part.column("text"))
            ids, at = coder.encode(body, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(at.astype(np.int32), ids)],
                                             ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_pieces(coded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text): the text of every array of ids, as the library decodes it. Null or empty arrays give an empty text."""

    def run(batches):
        coder = piece_tokens(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                lists = part.column("ids")
                sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
                body, at = coder.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))))
                texts = pa.array([body[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts], ["doc_id", "text"])

    rows = coded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def piece_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode each text, decode its ids, and digest both, in one pass.

    The ids of one slice of bounded size are held at a time. A null or empty text has 0 tokens and the digests of nothing."""
    import hashlib

    def run(batches):
        coder = piece_tokens(model)
        for part in slices(batches, max_bytes=2 << 20):
            ids, at = coder.encode(*text_bytes(part.column("text")))
            digits, d_at = coder.decimals(ids, at)
            digits = digits.tobytes()
            plain, p_at = coder.decode(ids, at)
            plain = plain.tobytes()
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(np.diff(at)),
                pa.array([hashlib.sha256(digits[a:max(a, b - 1)]).hexdigest() for a, b in zip(d_at[:-1], d_at[1:], strict=True)]),
                pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(p_at[:-1], p_at[1:], strict=True)]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
