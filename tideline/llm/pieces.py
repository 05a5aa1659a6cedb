"""Sampled segmentation of whole texts over a SentencePiece vocabulary.

Every text is a lattice of the vocabulary's pieces, each with a log probability
from its rank, and of byte pieces where no piece covers a character. A forward
pass gives the total weight of all segmentations up to each place; pieces are then
drawn backwards in proportion to their share of it. The draws are numbers hashed
from the row's key and the place, so a row gets the same segmentation on every
run and in every partition. Decoding joins the pieces' bytes and is lossless.

No piece has a space after another character (a vocabulary that has one is refused),
so the lattice falls apart into units: a run of spaces with what follows. The forward
pass runs once per distinct unit and is remembered in tables of bounded size; the
backward draws run for all units of a batch at once in numpy. A unit's shares are
summed state by state, so they don't depend on what else is in the batch.

Null and empty texts have no pieces. Very long texts are segmented whole. Repeated
rows with equal keys get equal ids, and so do ties; rows with a null key share one
key. An empty table gives no rows. Extra columns, of whatever names, are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.textbatch import TextBatch, _Powers, chunks, mix, release

#: Flattens (under 1) or sharpens the distribution of segmentations.
ALPHA = 0.5
SEED = 1
#: Lattice edges that one task remembers before it starts anew.
REMEMBERED_EDGES = 5_000_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    data: list[bytes]  # of each id; nothing for control pieces
    log_p: np.ndarray
    byte_id: np.ndarray  # of 256 bytes
    by_length: list[tuple[int, np.ndarray, np.ndarray]]  # bytes, sorted hashes, ids

    @classmethod
    def load(cls, path: str, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        data, byte_id = [b""] * n, np.full(256, -1, np.int64)
        normal = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_id[int(piece[3:5], 16)] = i
                data[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                data[i] = piece.replace("▁", " ").encode()
                normal.append(i)
        if split := [i for i in normal if b" " in data[i].lstrip(b" ")]:
            raise ValueError(f"pieces {split[:5]} hold a space after another character, so units can't be segmented alone")
        weight = np.zeros(n)
        weight[normal] = 1.0 / (np.arange(len(normal)) + 10.0)  # rank order is the order of ids
        rest = byte_id[byte_id >= 0]
        weight[rest] = weight[normal].min()
        log_p = np.where(weight > 0, alpha * np.log(np.where(weight > 0, weight / weight.sum(), 1)), -np.inf)
        by_length = []
        for size in sorted({len(data[i]) for i in normal}):
            ids = np.array([i for i in normal if len(data[i]) == size])
            h = _window_hash(np.frombuffer(b"".join(data[i] for i in ids), np.uint8).reshape(-1, size))
            by = np.argsort(h)
            by_length.append((size, h[by], ids[by]))
        return cls(data, log_p, byte_id, by_length)


def _window_hash(rows: np.ndarray) -> np.ndarray:
    up, _ = _Powers.of(rows.shape[1])
    return mix(((rows.astype(np.uint64) + np.uint64(1)) * up).sum(1, dtype=np.uint64))


def _prefix(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _Powers.of(len(buffer) + 1)
    prefix = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return prefix, down


class Lattice:
    """Edges of distinct units by end place (state), with cumulative shares."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.slots: dict[int, int] = {}  # unit's hash: its last state
        self.within = np.empty(0)  # of each edge: share of its end state's edges so far
        self.edge = np.zeros(1, np.int64)  # of each state: its first edge
        self.piece, self.size = np.empty(0, np.int32), np.empty(0, np.int32)
        self.first = np.zeros(1, bool)  # states where a unit begins
        self.first[0] = True

    def add(self, keys: list[int], raws: list[bytes]) -> None:
        """Forward filtering for new units, all at once."""
        sizes = np.array([len(r) for r in raws])
        buffer = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum(sizes)
        unit = np.repeat(np.arange(len(raws)), sizes)
        prefix, down = _prefix(buffer)
        n = len(buffer)
        starts, lengths, ids = [], [], []
        lead = np.flatnonzero((buffer & 0xC0) != 0x80)
        char_size = np.diff(np.append(lead, n))
        whole = np.zeros(n, bool)
        room, open_at = ends[unit[lead]] - lead, lead
        for size, h, piece in self.v.by_length:
            fits = room >= size
            room, open_at = room[fits], open_at[fits]
            at = open_at
            x = mix((prefix[at + size] - prefix[at]) * down[at])
            k = np.minimum(np.searchsorted(h, x), len(h) - 1)
            hit = h[k] == x
            at, k = at[hit], k[hit]
            starts.append(at)
            lengths.append(np.full(len(at), size))
            ids.append(piece[k])
            whole[at] |= char_size[np.searchsorted(lead, at)] == size
        bare = np.flatnonzero(~np.repeat(whole[lead], char_size)) if len(lead) and lead[0] == 0 else np.arange(n)
        starts.append(bare)
        lengths.append(np.ones(len(bare), np.int64))
        ids.append(self.v.byte_id[buffer[bare]])
        start, length, piece = np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)
        # A unit of k bytes has k + 1 states; the first one begins it.
        base = len(self.first)
        state = base + start + unit[start]  # where an edge begins
        end = state + length
        total = n + len(raws)
        log_p = self.v.log_p[piece]
        begins = base + np.concatenate(([0], ends[:-1])) + np.arange(len(raws))
        place = np.arange(base, base + total) - np.repeat(begins, sizes + 1)
        by = np.lexsort((end, place[end - base]))
        reach = np.full(total, -np.inf)
        reach[begins - base] = 0.0
        at_place = place[end[by] - base]
        for lo, hi in zip(*(np.searchsorted(at_place, np.arange(1, place.max() + 1), side) for side in ("left", "right"))) if total else ():
            e = by[lo:hi]
            if not len(e):
                continue
            x, target = reach[state[e] - base] + log_p[e], end[e]
            cut = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
            top = np.maximum.reduceat(x, cut)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                reach[target[cut] - base] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, np.diff(np.append(cut, len(x))))), cut))
        by = np.argsort(end, kind="stable")
        start_of, end_of = state[by] - base, end[by] - base
        with np.errstate(invalid="ignore"):
            share = np.exp(np.where(np.isfinite(reach[end_of]), reach[start_of] + log_p[by] - reach[end_of], -np.inf))
        cut = np.flatnonzero(np.append(True, end_of[1:] != end_of[:-1]))
        size = np.diff(np.append(cut, len(end_of)))
        for k in range(1, int(size.max(initial=0))):
            at = cut[size > k] + k
            share[at] += share[at - 1]
        within = np.minimum(share, 1.0)
        within[cut + size - 1] = 1.0
        self.edge = np.concatenate((self.edge, len(self.piece) + np.searchsorted(end_of, np.arange(total))))
        self.within = np.concatenate((self.within, within))
        self.piece = np.concatenate((self.piece, piece[by].astype(np.int32)))
        self.size = np.concatenate((self.size, length[by].astype(np.int32)))
        fresh = np.zeros(total, bool)
        fresh[begins - base] = True
        self.first = np.concatenate((self.first, fresh))
        self.slots.update(zip(keys, (begins + sizes).tolist()))

    def segment(self, texts: list[str | None], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
        """Ids of each text, drawn with its key."""
        texts = [t and " " + t for t in texts]  # the mark that begins every text
        b = TextBatch(texts)
        x = b.buffer
        inside = np.ones(len(x), bool)
        inside[b.stop] = False
        space, line = x == 32, x == 10
        begin = inside.copy()
        begin[1:] &= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        start = np.flatnonzero(begin)
        doc = np.searchsorted(b.stop, start)
        stop = np.minimum(np.append(start[1:], len(x)), b.stop[doc]) if len(start) else start
        prefix, down = _prefix(x)
        unit, at, back = np.unique(mix((prefix[stop] - prefix[start]) * down[start]), return_index=True, return_inverse=True)
        if len(self.piece) > REMEMBERED_EDGES:
            self.forget()
        raw = x.tobytes()
        new = [(k, raw[start[i] : stop[i]]) for k, i in zip(unit.tolist(), at.tolist()) if k not in self.slots]
        if new:
            self.add([k for k, _ in new], [r for _, r in new])
        last = np.fromiter(map(self.slots.__getitem__, unit.tolist()), np.int64, len(unit))
        live = np.argsort(last[back], kind="stable")  # neighbours in the tables stay together
        state = last[back][live]
        key = mix(keys.astype(np.int64).view(np.uint64)[doc] ^ mix((start - b.start[doc]).astype(np.uint64), seed), seed)
        drawn_unit, drawn_step, drawn_piece, step = [], [], [], 0
        while len(live):
            u = (mix(key[live] + np.uint64(step), 2) >> np.uint64(11)) * 2.0**-53
            e = self.edge[state]
            behind = np.flatnonzero(self.within[e] <= u)
            while len(behind):
                e[behind] += 1
                behind = behind[self.within[e[behind]] <= u[behind]]
            drawn_unit.append(live)
            drawn_step.append(np.full(len(live), step))
            drawn_piece.append(self.piece[e])
            state = state - self.size[e]
            left = ~self.first[state]
            live, state = live[left], state[left]
            step += 1
        if not drawn_unit:
            return [np.empty(0, np.int32)] * len(texts)
        owner, order, piece = np.concatenate(drawn_unit), np.concatenate(drawn_step), np.concatenate(drawn_piece)
        count = np.bincount(owner, minlength=len(start))
        slot = np.cumsum(count)[owner] - 1 - order
        ids = np.empty(len(piece), np.int32)
        ids[slot] = piece
        per_doc = np.bincount(doc, weights=count, minlength=b.n).astype(np.int64)
        return np.split(ids, np.cumsum(per_doc)[:-1])


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    data = vocabulary.data
    return b"".join([data[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(key, ids) of every row; the key seeds the draws."""
    path = path or model_path()

    def run(batches):
        lattice = Lattice(Vocabulary.load(path, alpha))
        for batch in chunks(batches, text):
            found = lattice.segment(batch.column(text).to_pylist(), _keys(batch.column(key)), seed)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.list_(pa.int32()))], [key, "ids"])
        lattice = None
        release()

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, ids array<int>")


def _keys(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def digests(docs: DataFrame, path: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Encodes and decodes every whole text: numbers of pieces and of byte pieces,
    crc32 of the ids (little-endian, 32 bits), hash of the decoded text, whether
    that is the text, and the ids themselves."""
    path = path or model_path()

    def run(batches):
        vocabulary = Vocabulary.load(path, alpha)
        lattice, data = Lattice(vocabulary), vocabulary.data
        spare = np.zeros(len(data), bool)
        spare[vocabulary.byte_id[vocabulary.byte_id >= 0]] = True
        for batch in chunks(batches):
            texts, out = batch.column("text").to_pylist(), []
            for t, ids in zip(texts, lattice.segment(texts, _keys(batch.column("doc_id")), seed)):
                decoded = b"".join([data[i] for i in ids.tolist()])[1:]
                out.append((len(ids), int(spare[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(decoded).hexdigest(), decoded == (t or "").encode("utf-8", "surrogatepass"), ids))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "lossless", "ids"])
        vocabulary = lattice = data = None
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean, ids array<int>")
