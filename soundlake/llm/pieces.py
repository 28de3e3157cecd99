"""Sampled segmentation into pieces of a given SentencePiece model, and lossless decoding.

A text is a lattice of the pieces that fit at each place.  Forward filtering sums the weight of all ways to reach a place;
backward sampling then draws one segmentation from the end, with its exact probability.  No piece joins the end of a word to
the blanks of the next, so the lattice of a text is that of its words one after another: each distinct word is filtered
once, and all its occurrences are drawn together.  Draws come from a counter hashed with the row's key: the same row gives
the same pieces on any cluster.

The model holds merge ranks, not probabilities; a piece's weight follows Zipf's law in its rank, to the power ``alpha``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundlake.llm.common import mix, row_key, text_of

BLANK = "▁"
OTHER = "\udfff"  # stands for the sign itself where a text holds it: a lone surrogate is in no text and no piece
UNIT = re.compile(f"{BLANK}+[^{BLANK}]*")
REMEMBER = 400_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a model file: weights, ids by text, ids of single bytes, and the bytes each id stands for."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids, self.weight, self.byte, self.shown = {}, np.zeros(n), {}, [b""] * n
        order = sorted((i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))),
                       key=lambda i: (-model.get_score(i), i))
        for rank, i in enumerate(order):
            self.weight[i] = (1.0 / (rank + 10)) ** alpha
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.shown[i] = bytes([int(piece[3:5], 16)])
            elif self.weight[i] and not re.search(f"[^{BLANK}]{BLANK}", piece):
                self.ids[piece] = i
                self.shown[i] = piece.replace(BLANK, " ").encode()
        self.longest = max(map(len, self.ids))
        with np.errstate(divide="ignore"):
            self.log_weight = np.where(self.weight > 0, np.log(self.weight), 0.0)
        self.rare = self.log_weight.min() - 10  # a character as bytes
        for i in self.byte.values():
            self.log_weight[i] = self.rare
        # by number of characters: sorted hashes of the pieces, their ids, sorted hashes of what longer pieces begin with
        whole, part = {}, {}
        for piece, i in self.ids.items():
            h = 0
            for k, c in enumerate(piece):
                h = (h * int(FACTOR) + ord(c)) % (1 << 64)
                if k + 1 < len(piece):
                    part.setdefault(k + 1, set()).add(h)
            whole.setdefault(len(piece), {})[h] = i
        self.by_length = {}
        for n_chars in range(1, self.longest + 1):
            known = sorted(whole.get(n_chars, {}).items())
            self.by_length[n_chars] = (np.array([h for h, _ in known], np.uint64), np.array([i for _, i in known], np.int64),
                                       np.array(sorted(part.get(n_chars, ())), np.uint64))
        if len(self.byte) < 256:
            raise ValueError("the model has no pieces for single bytes")
        self.byte_ids = np.array([self.byte[b] for b in range(128)])


def units_of(text: str) -> list[str]:
    """Blanks (as the model writes them) with the word after them, a blank put before the text."""
    return UNIT.findall(BLANK + text.replace(BLANK, OTHER).replace(" ", BLANK)) if text else []


def lattices(units: list[str], vocabulary: Vocabulary):
    """The lattices of all units, forward filtered.  A node is a character, and the place after it.

    Returns, an entry per edge and in the order of the nodes they end at: node, node at the start (-1 at the unit's start), id,
    and the edge's share of the weight of all ways to its node; and the units' lengths.  A character that is no piece is its
    bytes: the byte's id if it is one, else one edge with a negative id, -1 - code point.
    """
    chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, units), np.int64, len(units))
    first = np.repeat(np.cumsum(size) - size, size)
    room = np.repeat(np.cumsum(size), size) - np.arange(len(chars))
    begin, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
    starts, ends, ids = [], [], []
    for length in range(1, vocabulary.longest + 1):
        go = room[begin] >= length
        begin, h = begin[go], h[go]
        if not len(begin):
            break
        with np.errstate(over="ignore"):
            h = h * FACTOR + chars[begin + length - 1]
        hashes, id_of, prefixes = vocabulary.by_length[length]
        at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
        hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
        starts.append(begin[hit])
        ends.append(begin[hit] + length - 1)
        ids.append(id_of[at[hit]])
        if length == 1:
            starts.append(begin[~hit])
            ends.append(begin[~hit])
            code = chars[begin[~hit]].astype(np.int64)
            ids.append(np.where(code < 128, vocabulary.byte_ids[np.minimum(code, 127)], -1 - code))
        # only beginnings of some longer piece are followed on
        at = np.minimum(np.searchsorted(prefixes, h), max(0, len(prefixes) - 1))
        go = prefixes[at] == h if len(prefixes) else np.zeros(len(h), bool)
        begin, h = begin[go], h[go]
    start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
    order = np.lexsort((start, end))
    start, end, piece = start[order], end[order], piece[order]
    back = np.where(start > first[start], start - 1, -1)
    log = np.where(piece >= 0, vocabulary.log_weight[np.maximum(piece, 0)], vocabulary.rare)
    ways, share = np.zeros(len(chars)), np.zeros(len(end))
    # all units at once, by the place in the unit at which edges end
    place = end - first[end]
    by_place = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[by_place])) + 1
    for rows in np.split(by_place, cuts) if len(by_place) else ():
        w = log[rows] + np.where(back[rows] >= 0, ways[back[rows]], 0.0)
        new = np.flatnonzero(np.r_[True, end[rows][1:] != end[rows][:-1]])
        many = np.diff(np.r_[new, len(rows)])
        top = np.maximum.reduceat(w, new)
        w = np.exp(w - np.repeat(top, many))
        total = np.add.reduceat(w, new)
        ways[end[rows][new]] = top + np.log(total)
        share[rows] = w / np.repeat(total, many)
    return end, back, piece, share, size


class Sampler:
    """Lattices of known units as flat arrays, and draws from them for many occurrences at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self):
        self.index: dict[str, int] = {}
        self.last = np.zeros(0, np.int64)     # a unit's last node
        self.upto = np.zeros(0)               # node + cumulative share, an entry per edge
        self.back = np.zeros(0, np.int64)     # node at the edge's start, -1 at the unit's
        self.piece = np.zeros(0, np.int64)
        self.nodes = 0

    def _learn(self, units: list[str]):
        end, back, piece, share, size = lattices(units, self.vocabulary)
        new = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        running = np.cumsum(share)
        upto = running - np.repeat(np.r_[0, running[new[1:] - 1]], np.diff(np.r_[new, len(end)]))
        upto[np.r_[new[1:] - 1, len(end) - 1]] = 1.0
        self.last = np.append(self.last, self.nodes + np.cumsum(size) - 1)
        self.upto = np.append(self.upto, self.nodes + end + np.minimum(upto, 1.0))
        self.back = np.append(self.back, np.where(back >= 0, back + self.nodes, -1))
        self.piece = np.append(self.piece, piece)
        self.nodes += int(size.sum())

    def draw(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of a sampled segmentation of each text; ``keys`` seed the rows."""
        if len(self.index) > REMEMBER:
            self.forget()
        known, which, sizes = len(self.index), [], []
        setdefault, index = self.index.setdefault, self.index
        for text in texts:
            units = units_of(text)
            which.extend([setdefault(u, len(index)) for u in units])
            sizes.append(len(units))
        if len(index) > known:
            self._learn(list(index)[known:])
        which, sizes = np.array(which, np.int64), np.array(sizes, np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seed = mix(keys.astype(np.int64).view(np.uint64)[row] ^ mix(place))
        node, active = self.last[which] if len(which) else which, np.arange(len(which))
        steps, found = np.zeros(len(which), np.int64), []
        turn = 0
        while len(active):
            u = (mix(seed[active] + np.uint64(turn)) >> np.uint64(12)) * 2.0 ** -52
            edge = np.searchsorted(self.upto, node + u, side="right")
            # rounding of the sum may step to the next node's first edge
            edge = np.where(self.upto[edge - 1] >= node + 1.0, edge - 1, edge)
            found.append((active, self.piece[edge]))
            steps[active] += 1
            node = self.back[edge]
            go = node >= 0
            active, node = active[go], node[go]
            turn += 1
        ends = np.cumsum(steps)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (occurrence, piece) in enumerate(found):
            ids[ends[occurrence] - 1 - k] = piece
        cut_at = np.r_[0, ends][np.cumsum(sizes)]
        out = np.split(ids, cut_at[:-1]) if len(texts) else []
        return [self._bytes(x) if len(x) and x.min() < 0 else x for x in out]

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        out = []
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            else:
                out += [self.vocabulary.byte[b] for b in (BLANK if chr(-1 - i) == OTHER else chr(-1 - i)).encode()]
        return np.array(out, np.int64)


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text that was encoded."""
    shown = vocabulary.shown
    return b"".join([shown[i] for i in ids])[1:].decode()


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", alpha: float = 1.0) -> DataFrame:
    """``docs`` without text, with ids (array of piece ids), n_pieces and lossless (decoding gave the text back).

    Null and empty texts have no pieces.  Rows that are equal in id and text get the same pieces.
    """
    own = [c for c in docs.columns if c not in ("text", "ids", "n_pieces", "lossless")]
    row = F.struct(*own) if own else F.lit(0)
    kept = docs.select(row.alias("doc"), row_key("doc_id", text_of())[0].alias("_key"), text_of().alias("_text"))
    shape = kept.select("doc").schema

    def run(batches):
        import public_tokenizers
        vocabulary = Vocabulary(public_tokenizers.path(model), alpha)
        sampler = Sampler(vocabulary)
        for batch in batches:
            texts, keys = batch.column("_text").to_pylist(), batch.column("_key").to_numpy()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 2_000_000):
                    size += len(texts[end])
                    end += 1
                ids = sampler.draw(texts[at:end], keys[at:end])
                same = [decode(x.tolist(), vocabulary) == t for x, t in zip(ids, texts[at:end])]
                sizes = [len(x) for x in ids]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], lists, pa.array(sizes, pa.int64()), pa.array(same)],
                                                 names=[*part.schema.names[:-2], "ids", "n_pieces", "lossless"])
                at = end

    out = kept.mapInArrow(run, shape.add("ids", T.ArrayType(T.IntegerType())).add("n_pieces", "long").add("lossless", "boolean"))
    return out.select(*[F.col("doc")[c].alias(c) for c in own], "ids", "n_pieces", "lossless")
