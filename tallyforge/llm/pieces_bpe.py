"""SentencePiece encoding with seeded merge-dropout, and its lossless decoding.

Merge-type (BPE) pieces are built by an agenda of candidate merges, best score first and leftmost among equals. With
dropout, a candidate is skipped when the keyed hash of (seed, variant, unit, its three borders) falls below the rate; so
the same text may be cut in many ways, each of which decodes to the same bytes, and a seed always gives the same cuts.
Each occurrence of a unit (a stretch that no merge can leave) takes one of VARIANTS keys by the hash of its text and place.

Blanks are the model's word sign; a text's own word sign and all characters without a piece go through byte pieces, so
decoding gives back every text byte by byte. Without dropout the ids are those of the model's own encoder.

Defined results: a null or empty text has no tokens and decodes to nothing; equal texts have equal tokens; repeated rows
stay repeated; an empty table gives no rows; columns of the documents stay.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import byte_rows, hashes, mixed, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED, VARIANTS = 0.1, 1, 4
SIGN = "▁"
#: Cut units that a task remembers in each of two generations.
REMEMBERED = 150_000
SMALL = 24
_M = (1 << 64) - 1
_WIDE, _NONE, _UNKNOWN = 1 << 26, 1 << 40, 1 << 25


class Encoder:
    """The pieces of a merge-type model, read from its file on the driver."""

    def __init__(self, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes((value,)))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.scores[piece] = (model.get_score(i), i)
                self.bytes_of.append(piece.replace(SIGN, " ").encode())
        if not any(self.byte_ids):
            raise ValueError("the model has no byte pieces, so it isn't lossless")
        #: Byte pairs that stand side by side in some piece: no merge goes past any other pair, so texts are cut there into units.
        self.joined = np.zeros((256, 256), bool)
        for piece in self.scores:
            raw = np.frombuffer(piece.replace(SIGN, " ").encode(), np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.limit = int(dropout * (1 << 53))
        self.seed, self.variants = seed, variants if dropout else 1
        self.memory: list[dict[bytes, bytes]] = [{} for _ in range(self.variants)]
        self.older: list[dict[bytes, bytes]] = [{} for _ in range(self.variants)]
        # For cutting many units at once: symbols are the pieces and the characters in them; pairs are all that make a piece.
        characters = {c for piece in self.scores for c in piece}
        self.symbols = {x: k for k, x in enumerate([*self.scores, *sorted(characters - set(self.scores))])}
        self.ids = np.array([self.scores[x][1] if x in self.scores else -1 for x in self.symbols], np.int32)
        order = {v: k for k, v in enumerate(sorted({v for v, _ in self.scores.values()}, reverse=True))}
        pairs = sorted((self.symbols[p[:k]] * _WIDE + self.symbols[p[k:]], order[v], self.symbols[p]) for p, (v, _) in self.scores.items() for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols)
        self.pair_keys, self.pair_ranks, self.pair_made = (np.array(x, np.int64) for x in zip(*pairs))
        # Code points to symbols: a blank is the sign; the sign itself and what is in no piece have none.
        self.of_point = np.full(0x110000, _UNKNOWN, np.int64)
        for x, k in self.symbols.items():
            if len(x) == 1:
                self.of_point[ord(x)] = k
        self.of_point[0x20], self.of_point[ord(SIGN)] = self.symbols.get(SIGN, _UNKNOWN), _UNKNOWN

    def keys(self, units: list[bytes], variants: np.ndarray) -> np.ndarray:
        """The keys of units, from their bytes, their variants and the seed."""
        own = hashes(np.frombuffer(b"".join(units), np.uint8), np.array([len(u) for u in units], np.int64))
        return mixed(own ^ mixed(np.uint64(self.seed & _M) + variants.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))

    def key(self, unit: bytes, variant: int) -> int:
        return int(self.keys([unit], np.array([variant]))[0])

    def skipped(self, key: int, a: int, b: int, c: int) -> bool:
        h = ((key ^ (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9)) * 0xFF51AFD7ED558CCD) & _M
        h = ((h ^ h >> 32) * 0xC4CEB9FE1A85EC53) & _M
        return h >> 11 < self.limit

    def cuts(self, units: list[bytes], variants: list[int]) -> list[bytes]:
        """The ids (as 32-bit numbers) of units, each with its variant; a blank in them is a blank.

        Cut units are remembered in two generations: when the younger is full, the older goes."""
        out: list[bytes | None] = [self.memory[v].get(u) for u, v in zip(units, variants)]
        new: dict[int, list[int]] = {}
        for i, found in enumerate(out):
            if found is None:
                u, v = units[i], variants[i]
                if (found := self.older[v].get(u)) is not None:
                    out[i] = self.memory[v][u] = found
                else:
                    n = len(u)
                    new.setdefault(4 if n <= 4 else 8 if n <= 8 else 16 if n <= 16 else 32 if n <= 32 else 0, []).append(i)
        for wide, which in new.items():
            group, kinds = [units[i] for i in which], [variants[i] for i in which]
            found = self._together(group, np.array(kinds), wide) if wide else [np.array(self.agenda(u, v), np.int32).tobytes() for u, v in zip(group, kinds)]
            for i, u, v, ids in zip(which, group, kinds, found):
                out[i] = self.memory[v][u] = ids
        if sum(map(len, self.memory)) > REMEMBERED:
            self.older, self.memory = self.memory, [{} for _ in range(self.variants)]
        return out

    def _together(self, units: list[bytes], variants: np.ndarray, wide: int) -> list[bytes]:
        """The agenda of many units in step: in each round, every unit makes its best merge that is not skipped.

        A symbol stays in the column of its first character, so no column moves: `after` is where the next symbol begins."""
        joined = b"".join(units)
        flat = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(u) for u in units], np.int64)
        lengths = np.add.reduceat((flat & 0xC0) != 0x80, np.cumsum(sizes) - sizes).astype(np.int64)
        points = np.frombuffer(joined.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) != lengths.sum():  # bytes that are no UTF-8
            return [np.array(self.agenda(u, int(v)), np.int32).tobytes() for u, v in zip(units, variants)]
        total, columns = len(units), np.arange(wide)
        inside = columns < lengths[:, None]
        symbols = np.full((total, wide), -1, np.int64)
        symbols[inside] = self.of_point[points]
        keys = self.keys(units, variants) if self.limit else np.zeros(total, np.uint64)
        after = np.minimum(np.tile(columns + 1, (total, 1)), lengths[:, None])
        before = np.tile(columns - 1, (total, 1))
        ranks, made = np.full((total, wide), _NONE, np.int64), np.zeros((total, wide), np.int64)
        row, at = np.nonzero(columns < lengths[:, None] - 1)
        ranks[row, at], made[row, at] = self._pairs(symbols[row, at], symbols[row, at + 1], keys[row], at, at + 1, np.minimum(at + 2, lengths[row]))
        live = np.arange(total)
        begins = inside.copy()
        while live.size:
            best = ranks[live]
            at = best.argmin(1)
            going = best[np.arange(len(live)), at] < _NONE
            live, at = live[going], at[going]
            b = after[live, at]
            c = after[live, b]
            symbols[live, at] = made[live, at]
            after[live, at] = c
            begins[live, b] = False
            ranks[live, b] = _NONE
            ranks[live, at] = _NONE
            more = np.flatnonzero(c < lengths[live])
            rows, a, c_ = live[more], at[more], c[more]
            before[rows, c_] = a
            ranks[rows, a], made[rows, a] = self._pairs(symbols[rows, a], symbols[rows, c_], keys[rows], a, c_, after[rows, c_])
            more = np.flatnonzero(before[live, at] >= 0)
            rows, a = live[more], at[more]
            p = before[rows, a]
            ranks[rows, p], made[rows, p] = self._pairs(symbols[rows, p], symbols[rows, a], keys[rows], p, a, after[rows, a])
        ids = np.where(symbols < _UNKNOWN, self.ids[np.where((symbols >= 0) & (symbols < _UNKNOWN), symbols, 0)], -1)[begins]
        counts = begins.sum(1)
        ends = np.cumsum(counts)
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), "right")).tolist()
        raw = ids.astype(np.int32).tobytes()
        out = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
        for i in odd:
            text = units[i].decode("utf-8", "surrogateescape").replace(SIGN, "\udfff").replace(" ", SIGN)
            out[i] = np.array(self._named(text, [*np.flatnonzero(begins[i])[1:].tolist(), len(text)]), np.int32).tobytes()
        return out

    def _pairs(self, left, right, keys, a, b, c) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (none: _NONE) and merged symbols of neighbours; skipped pairs have none."""
        key = np.where((left >= 0) & (right >= 0), left * _WIDE + right, -1)
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        good = self.pair_keys[place] == key
        if self.limit:
            a, b, c = (x.astype(np.uint64) for x in (a, b, c))
            h = (keys ^ (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9))) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ h >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)
            good &= h >> np.uint64(11) >= np.uint64(self.limit)
        return np.where(good, self.pair_ranks[place], _NONE), self.pair_made[place]

    def agenda(self, unit: bytes, variant: int) -> list[int]:
        # a blank becomes the sign; a sign of the text becomes a character that has no piece
        chars = unit.decode("utf-8", "surrogateescape").replace(SIGN, "\udfff").replace(" ", SIGN)
        key = self.key(unit, variant) if self.limit else 0
        return self._named(chars, self._small(chars, key) if len(chars) <= SMALL else self._large(chars, key))

    def _named(self, chars: str, ends: list[int]) -> list[int]:
        """The ids of the pieces that end there; what has no piece goes through bytes."""
        out, a = [], 0
        for b in ends:
            piece = chars[a:b]
            if known := self.scores.get(piece):
                out.append(known[1])
            else:
                raw = SIGN.encode() if piece == "\udfff" else piece.encode("utf-8", "surrogateescape")
                out += [self.byte_ids[x] for x in raw]
            a = b
        return out

    def _small(self, chars: str, key: int) -> list[int]:
        """Ends of the pieces; the best pair is looked for among all."""
        at = list(range(len(chars) + 1))
        scores, limit = self.scores, self.limit

        def score(i: int) -> float:
            found = scores.get(chars[at[i] : at[i + 2]])
            return found[0] if found and not (limit and self.skipped(key, at[i], at[i + 1], at[i + 2])) else -1e30

        pairs = [score(i) for i in range(len(at) - 2)]
        while pairs:
            best = max(pairs)
            if best == -1e30:
                break
            i = pairs.index(best)
            del at[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = score(i)
            if i:
                pairs[i - 1] = score(i - 1)
        return at[1:]

    def _large(self, chars: str, key: int) -> list[int]:
        """The same with a heap and linked places."""
        n = len(chars)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        alive = [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def push(a: int) -> None:
            b = after[a]
            if b < n:
                c = after[b]
                found = self.scores.get(chars[a:c])
                if found and not (self.limit and self.skipped(key, a, b, c)):
                    heapq.heappush(heap, (-found[0], a, b, c))

        for a in range(n - 1):
            push(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if not alive[a] or after[a] != b or not alive[b] or after[b] != c:
                continue
            alive[b] = False
            after[a] = c
            if c < n:
                before[c] = a
            push(a)
            if a:
                push(before[a])
        ends, a = [], 0
        while a < n:
            a = after[a]
            ends.append(a)
        return ends

    def encode_rows(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each row's begin (one more at the end)."""
        full = [b" " + bytes(r) if len(r) else b"" for r in rows]
        sizes = np.array([len(r) for r in full], np.int64)
        heads = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(full), np.uint8)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(rows) + 1, np.int64)
        begin = np.zeros(len(flat), bool)
        begin[1:] = ~self.joined[flat[:-1], flat[1:]] & (flat[1:] & 0xC0 != 0x80)  # never inside a character
        begin[heads[sizes > 0]] = True
        starts = np.flatnonzero(begin)
        owner = np.searchsorted(heads + sizes, starts, "right")
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate((starts, [len(flat)])).astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
        place = np.arange(len(starts)) - np.searchsorted(owner, owner, "left")
        if self.variants > 1:
            text_keys = np.array([int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little") for r in full], np.uint64)
            variant = (mixed(text_keys[owner] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.variants)).astype(np.int64)
        else:
            variant = np.zeros(len(starts), np.int64)
        code = units.indices.to_numpy().astype(np.int64) * self.variants + variant
        kinds, which = np.unique(code, return_inverse=True)
        names = units.dictionary.to_pylist()
        cuts = self.cuts([names[k] for k in (kinds // self.variants).tolist()], (kinds % self.variants).tolist())
        lengths = np.array([len(c) // 4 for c in cuts], np.int64)
        begins = np.cumsum(lengths) - lengths
        every = np.frombuffer(b"".join(cuts), np.int32)
        n = lengths[which]
        ends = np.cumsum(n)
        ids = every[np.repeat(begins[which] - (ends - n), n) + np.arange(int(ends[-1]))]
        counts = np.bincount(owner, n, len(rows)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(counts)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]


def _with_tokens(batch: pa.RecordBatch, encoder: Encoder, at: int) -> pa.RecordBatch:
    ids, firsts = encoder.encode_rows(byte_rows(batch.column(at)))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(firsts.astype(np.int32), pa.array(ids, pa.int32()))], [*batch.schema.names, "token_ids"])


def _with_plain(batch: pa.RecordBatch, encoder: Encoder, at: int, ids: int) -> pa.RecordBatch:
    column = batch.column(ids)
    flat, cuts = column.flatten().to_pylist(), column.offsets.to_numpy() - column.offsets[0].as_py()
    out, same = [], []
    for raw, a, b in zip(byte_rows(batch.column(at)), cuts.tolist(), cuts[1:].tolist()):
        plain = encoder.decode(flat[a:b])
        out.append(hashlib.sha256(plain).hexdigest())
        same.append(plain == raw)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(np.diff(cuts).astype(np.int64)), pa.array(same, pa.bool_())], [*batch.schema.names, "decoded_sha256", "n_tokens", "lossless"])


TOKENS, PLAIN = ("token_ids",), ("decoded_sha256", "n_tokens", "lossless")
TYPES = {"token_ids": "array<int>", "decoded_sha256": "string", "n_tokens": "bigint", "lossless": "boolean"}


def _mapped(docs: DataFrame, encoder: Encoder, text: str, encode: bool, decode: bool) -> DataFrame:
    made = TOKENS * encode + PLAIN * decode
    docs = docs.drop(*made)
    sent = docs.sparkSession.sparkContext.broadcast(encoder)
    at, ids = docs.columns.index(text), len(docs.columns) if encode else docs.columns.index("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 2 << 20):
            batch = _with_tokens(batch, sent.value, at) if encode else batch
            yield _with_plain(batch, sent.value, at, ids) if decode else batch

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), *(f"{c} {TYPES[c]}" for c in made)]))


def encoded(docs: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """All columns of docs, and token_ids."""
    return _mapped(docs, encoder, text, True, False)


def decoded(docs: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """All columns of docs, and decoded_sha256, n_tokens and lossless (whether token_ids decode to the bytes of `text`)."""
    return _mapped(docs, encoder, text, False, True)


def round_trip(docs: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """decoded(encoded(docs)) in one pass, by one worker for each task."""
    return _mapped(docs, encoder, text, True, True)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = Encoder()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, encoder).select("doc_id", "n_tokens", "token_ids", "decoded_sha256", "lossless")
