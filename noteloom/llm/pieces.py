"""SentencePiece encoding and decoding with byte offsets into the original text.

The normaliser follows the model's compiled character map: at each position the longest prefix that the map
knows is replaced, and every normalised byte remembers the source position it came from. Merging then
works on the normalised text, and each piece is projected back through that alignment to a span of
original bytes. Pieces, ids and spans are those of the sentencepiece library.

A word and the blanks before it never merge with their neighbours, because no piece of such a model has a
blank after another sign. The distinct words of a batch of documents are therefore merged side by side, as
rows of one array: each round merges the best pair of every word. Documents are encoded inside Arrow
batches of bounded size; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noteloom.llm.common import byte_rows, pieces_of, word_hashes

SPACE = "▁"
LONGEST = 40  # longer words are merged one by one with a heap
NEVER = np.int32(2**31 - 1)
_HASH = 0x9E3779B97F4A7C15
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a serialized protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class CharMap:
    """A compiled character map: a double-array trie over bytes and the replacements it points to."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``text`` from ``at``."""
        units, best, node = self.units, None, 0
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        end = self.replacements.index(b"\0", best[1])
        return best[0], self.replacements[best[1] : end]


class PieceModel:
    """A BPE model read from its file's bytes."""

    def __init__(self, blob: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix = self.trim = self.escape = True
        self.fallback, kind, char_map = False, 1, b""
        for number, value in _fields(blob):
            if number == 1:
                entry = dict(_fields(value))
                score = struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0
                self.pieces.append((entry.get(1, b"").decode(), score, entry.get(3, _NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                kind, self.fallback = spec.get(3, 1), bool(spec.get(35, 0))
                if spec.get(24):
                    raise ValueError("models with blanks as suffix are not supported")
            elif number == 3:
                spec = dict(_fields(value))
                char_map = spec.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if kind != 2 or not self.fallback or not self.escape:
            raise ValueError("a BPE model with byte fallback is needed")
        if any(k not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for _, _, k in self.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.char_map = CharMap(char_map) if char_map else None
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == _NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == _BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.text_of = ["" if k == _CONTROL else " ⁇ " if k == _UNKNOWN else p for p, _, k in self.pieces]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that go on after a blank are not supported")
        self._tables()

    def _tables(self) -> None:
        """Arrays for merging: signs to ids, pairs of ids to the id of their union, ids to bytes and digits."""
        n = len(self.pieces)
        self.sign = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.sign[ord(piece)] = i
            elif any(c not in self.ids for c in piece):
                raise ValueError(f"{piece}: a sign of this piece is no piece")
        scores = sorted({self.pieces[i][1] for i in self.ids.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.place = np.full(n + 1, NEVER, np.int32)  # the last entry stands for "no such piece"
        pairs = {}
        for piece, i in self.ids.items():
            self.place[i] = place[self.pieces[i][1]]
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        bits = max(10, (len(pairs) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.union = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, n, np.int32)
        for key, i in pairs.items():
            at = (key * _HASH & (1 << 64) - 1) >> int(self.shift)
            while self.keys[at] >= 0:
                at += 1
            if at >= len(self.keys) - 1:
                raise ValueError("the table of pairs is too full")
            self.keys[at], self.union[at] = key, i
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text_of)]
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in self.raw])])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.size = np.array([0 if k == _BYTE else len(p.encode()) for p, _, k in self.pieces], np.int32)
        digits = [f"{i},".encode() for i in range(n)]
        self.digits_at = np.concatenate([[0], np.cumsum([len(d) for d in digits])])
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.of_byte = np.array([self.byte_ids[b] for b in range(256)], np.int32)

    # normalisation -------------------------------------------------------------------------------

    def normalize(self, text: bytes) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it comes from."""
        if self.char_map is None and not self.trim:
            return self._plain(text)
        out, source, at = [], [], 0
        while self.trim and at < len(text):
            n, piece = self._prefix(text, at)
            if piece != b" ":
                break
            at += n
        if at >= len(text):
            return "", np.zeros(1, np.int64)
        space = SPACE.encode()
        if self.dummy_prefix:
            out.append(space)
            source += [at] * 3
        after_space = self.trim
        while at < len(text):
            n, piece = self._prefix(text, at)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                new = piece.replace(b" ", space)
                out.append(new)
                source += [at] * len(new)
                after_space = self.trim and piece.endswith(b" ")
            at += n
        norm = b"".join(out)
        if self.trim:
            while norm.endswith(space):
                norm = norm[:-3]
                at = source[len(norm)]
        return norm.decode("utf-8", "replace"), np.array([*source[: len(norm)], at], np.int64)

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        known = self.char_map.longest(text, at) if self.char_map else None
        if known:
            return known
        first = text[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        try:
            text[at : at + n].decode()
            return n, text[at : at + n]
        except UnicodeDecodeError:
            return 1, b"\xef\xbf\xbd"

    def _plain(self, text: bytes) -> tuple[str, np.ndarray]:
        """Without a map or trimming only blanks change, so the alignment is a repetition of positions."""
        if not text:
            return "", np.zeros(1, np.int64)
        try:
            norm = text.decode()
        except UnicodeDecodeError:
            self.trim, keep = False, self.char_map
            self.char_map = CharMap(struct.pack("<II", 4, 0))
            try:
                return self.normalize(text)
            finally:
                self.char_map = keep
        norm = norm.replace(" ", SPACE)
        times = np.where(np.frombuffer(text, np.uint8) == 32, 3, 1)
        source = np.repeat(np.arange(len(text)), times)
        lead = [0, 0, 0] if self.dummy_prefix else []
        return (SPACE if self.dummy_prefix else "") + norm, np.concatenate([lead, source, [len(text)]]).astype(np.int64)

    # merging -------------------------------------------------------------------------------------

    def _united(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the unions of two columns of ids; the number of pieces where there is none."""
        key = a.astype(np.int64) * len(self.pieces) + b
        key[(a < 0) | (b < 0)] = -2
        at = (key.astype(np.uint64) * np.uint64(_HASH) >> self.shift).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == key, self.union[at], len(self.pieces)).astype(np.int32)
        open_ = np.flatnonzero((seen != key) & (seen >= 0) & (key >= 0))
        while len(open_):
            at[open_] += 1
            seen = self.keys[at[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.union[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def merge_words(self, signs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words given as runs of signs; ids per word and their n + 1 offsets.

        Signs that are no piece come as -2 - code point and stay as they are. In every round the best-ranked
        pair of each word is merged, the leftmost of equals.
        """
        sizes = np.diff(at)
        out_rows, out_ids, counts = [], [], np.zeros(len(sizes), np.int64)
        edges = [0, 2, 4, 6, 8, 10, 12, 16, 24, LONGEST]
        groups = [(hi, np.flatnonzero((sizes > lo) & (sizes <= hi))) for lo, hi in zip(edges, edges[1:])]
        for hi, rows in ((hi, g[k : k + 4096]) for hi, g in groups for k in range(0, len(g), 4096)):
            column = np.arange(hi)
            inside = column < sizes[rows][:, None]
            table = np.where(inside, signs[np.minimum(at[rows][:, None] + column, len(signs) - 1)], -1).astype(np.int32)
            length = sizes[rows].copy()
            united = np.full((len(rows), hi), len(self.pieces), np.int32)
            for k in range(hi - 1):
                united[:, k] = self._united(table[:, k], table[:, k + 1])
            rank = self.place[united]
            live = np.arange(len(rows))
            while len(live):
                best = rank[live].argmin(1)
                go = rank[live, best] != NEVER
                live, best = live[go], best[go]
                if not len(live):
                    break
                take = np.minimum(column + (column > best[:, None]), hi - 1)
                part = np.take_along_axis(table[live], take, 1)
                part[:, -1] = -1
                part[np.arange(len(live)), best] = united[live, best]
                pairs = np.take_along_axis(united[live], take, 1)
                pairs[:, -1] = len(self.pieces)
                n = np.arange(len(live))
                pairs[n, best] = self._united(part[n, best], part[n, np.minimum(best + 1, hi - 1)])
                pairs[n[best == hi - 1], hi - 1] = len(self.pieces)
                left = n[best > 0]
                pairs[left, best[left] - 1] = self._united(part[left, best[left] - 1], part[left, best[left]])
                table[live], united[live], rank[live] = part, pairs, self.place[pairs]
                length[live] -= 1
            counts[rows] = length
            out_rows.append(rows)
            out_ids.append((table, length))
        for r in np.flatnonzero(sizes > LONGEST):
            run = signs[at[r] : at[r + 1]].tolist()
            ids = self._merge_long(run)
            counts[r] = len(ids)
            out_rows.append(np.array([r]))
            out_ids.append((np.array([ids], np.int32), np.array([len(ids)])))
        starts = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(int(starts[-1]), np.int32)
        for rows, (table, length) in zip(out_rows, out_ids):
            keep = np.arange(table.shape[1]) < length[:, None]
            ids[ragged(starts[rows], length)] = table[keep]
        return ids, starts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, total = len(parts), len(self.pieces)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        alive, heap = [True] * n, []

        def offer(pairs: list[tuple[int, int]]) -> None:
            pairs = [(i, j) for i, j in pairs if i >= 0 and j >= 0]
            if pairs:
                both = self._united(np.array([parts[i] for i, _ in pairs]), np.array([parts[j] for _, j in pairs]))
                for (i, j), u in zip(pairs, both.tolist()):
                    if u != total:
                        heapq.heappush(heap, (int(self.place[u]), i, j, u, parts[i], parts[j]))

        offer([(i, i + 1) for i in range(n - 1)])
        while heap:
            _, i, j, u, a, b = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or right[i] != j or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = u, False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer([(left[i], i), (i, right[i])])
        return [p for p, k in zip(parts, alive) if k]

    def _spelled(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Replace signs that are no piece by their bytes; ids, normalised bytes under each id, offsets."""
        unknown = np.flatnonzero(ids < 0)
        sizes = self.size[np.maximum(ids, 0)]
        if not len(unknown):
            return ids, sizes, at
        points = -2 - ids[unknown].astype(np.int64)
        n = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        times = np.ones(len(ids), np.int64)
        times[unknown] = n
        moved = np.concatenate([[0], np.cumsum(times)])
        out, under = np.repeat(ids, times), np.repeat(sizes, times)
        first = moved[unknown]
        for k in range(4):
            rows = n > k
            p, size = points[rows], n[rows]
            lead = np.where(size == 1, p, (0xF00 >> size & 0xFF) | (p >> (6 * (size - 1))))
            byte = lead if k == 0 else 0x80 | (p >> (6 * (size - 1 - k)) & 0x3F)
            out[first[rows] + k] = self.of_byte[byte]
            under[first[rows] + k] = np.where(size == k + 1, size, 0)  # all bytes but the last cover nothing
        return out, under, moved[at]

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of the pieces of all ``texts``, and the n + 1 offsets of the texts in them."""
        norms, sources = zip(*[self.normalize(t) for t in texts])
        signs = np.frombuffer("".join(norms).encode("utf-32-le"), np.uint32).astype(np.int64)
        row_at = np.concatenate([[0], np.cumsum([len(t) for t in norms])]).astype(np.int64)
        if not len(signs):
            none = np.zeros(0, np.int32)
            return none, none, none, np.zeros(len(texts) + 1, np.int64)
        blank = signs == ord(SPACE)
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[row_at[:-1][row_at[:-1] < len(signs)]] = True
        word_at = np.append(np.flatnonzero(cut), len(signs))
        wide = np.ascontiguousarray(signs.astype("<u4")).view(np.uint8)
        names = word_hashes(wide, word_at[:-1] * 4, word_at[1:] * 4)
        _, sample, which = np.unique(names, return_index=True, return_inverse=True)
        length = word_at[sample + 1] - word_at[sample]
        chosen = signs[ragged(word_at[sample], length)]
        known = self.sign[chosen]
        known = np.where(known >= 0, known, -2 - chosen).astype(np.int32)
        ids, at = self.merge_words(known, np.concatenate([[0], np.cumsum(length)]))
        ids, sizes, at = self._spelled(ids, at)
        count = np.diff(at)[which]
        spot = ragged(at[which], count)
        ids, sizes = ids[spot], sizes[spot]
        token_at = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(word_at, row_at)]
        ends = np.cumsum(sizes, dtype=np.int64)
        # each text's alignment has one entry more than it has bytes: its end
        row = np.repeat(np.arange(len(texts)), np.diff(token_at))
        aligned = np.concatenate(sources)
        stops = aligned[ends + row]
        starts = aligned[ends - sizes + row]
        return ids, starts.astype(np.int32), stops.astype(np.int32), token_at

    # results -------------------------------------------------------------------------------------

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the start and end of each piece in bytes of ``text``."""
        return self.encode_batch([text])[:3]

    def decode(self, ids, first: bool = True) -> str:
        """Text of ids: byte pieces are joined to characters, the blank that encoding put in front goes."""
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_characters(bytes(raw)))
                raw.clear()
            text = self.text_of[i]
            if first and self.dummy_prefix and text.startswith(SPACE) and not any(out):
                text, first = text[1:], False
            if text:
                first = False
            out.append(text.replace(SPACE, " "))
        if raw:
            out.append(_characters(bytes(raw)))
        return "".join(out)

    def digests(self, texts: list[bytes]) -> list[tuple[int, str, str, int]]:
        """Per text: number of ids, digests of the ids and of the decoded text, bytes that the spans cover."""
        ids, starts, ends, at = self.encode_batch(texts)
        size = np.diff(self.digits_at)[ids]
        numbers = self.digits[ragged(self.digits_at[ids], size)].tobytes()
        number_at = np.concatenate([[0], np.cumsum(size)])[at]
        size = np.diff(self.raw_at)[ids]
        raw = self.raw_bytes[ragged(self.raw_at[ids], size)].tobytes()
        raw_at = np.concatenate([[0], np.cumsum(size)])[at]
        covered = np.concatenate([[0], np.cumsum(ends - starts)])[at]
        out = []
        for k in range(len(texts)):
            n = int(at[k + 1] - at[k])
            decoded = raw[raw_at[k] : raw_at[k + 1]]
            if n and self.dummy_prefix and self.text_of[ids[at[k]]].startswith(SPACE):
                decoded = decoded[1:]
            listed = numbers[number_at[k] : max(number_at[k], number_at[k + 1] - 1)]
            digests = hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()
            out.append((n, *digests, int(covered[k + 1] - covered[k])))
        return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _characters(raw: bytes) -> str:
    """UTF-8 with every byte that is no part of a character replaced by U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_MODELS: dict[int, PieceModel] = {}


def _model(shared) -> PieceModel:
    """The model of this Python worker; its tables live as long as the worker."""
    key = hash(shared.value)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(shared.value)
    return _MODELS[key]


def _shared_model(docs: DataFrame, path: str):
    with open(path, "rb") as f:  # a file of the driver's installation; tasks get its bytes
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    data, offsets = byte_rows(batch.column(column))
    view = data.tobytes()
    return (view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, starts, ends) for every row of ``docs``: pieces with their spans in bytes of the text.

    A null or empty text has no pieces; a text is never cut. Rows with equal ids stay separate rows. An empty
    table gives an empty result; columns other than doc_id and text are ignored. Bytes that are no UTF-8
    are encoded as U+FFFD.
    """
    shared = _shared_model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for part in pieces_of(batches, "text", 1 << 22):
            *columns, at = model.encode_batch(list(_texts(part, "text")))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "ids", "starts", "ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.selectExpr("doc_id", "cast(text as binary) as text")
    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``encoded`` (doc_id, ids). Null ids give a null text."""
    shared = _shared_model(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes) for every row of ``docs``.

    The digests of what :func:`encode_documents` and decoding give, made where the pieces are, so that the
    pieces themselves need not travel. ``n_bytes`` is the number of original bytes under the pieces' spans.
    """
    shared = _shared_model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for part in pieces_of(batches, "text", 1 << 22):
            n, ids, decoded, covered = zip(*model.digests(list(_texts(part, "text"))))
            columns = [pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(covered, pa.int64())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.selectExpr("doc_id", "cast(text as binary) as text")
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
