"""SentencePiece BPE with seeded merge-dropout, and its lossless decoding.

Merges are taken from an agenda, best score first and leftmost among equals. A
candidate is skipped when a hash of the seed, the document's key, the unit's place in the document and the candidate's
place in the unit falls below the dropout rate, so that each occurrence of a word is cut on its own,
the same text gets other segmentations under other seeds and in other documents, and repeats exactly. With
rate 0 the result is the model's own.

No piece crosses from a letter to the mark of a space, so a text falls into units of spaces
and the letters after them. A unit that a worker meets often has a tree of its agenda (:class:`Tree`): a node is the next candidate, its two
branches are to take and to skip it. Occurrences go down the trees together, each by its own draws, and branches grow where one first goes, so
that nothing is drawn but what the agenda asks. The other units' agendas run together in numpy, one candidate of each unit a step. A
literal U+2581 is sent as bytes, where the model would take it for a space.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.kernels import SLICE_BYTES, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 0
TOGETHER, LONG = 4096, 256
OFTEN, SHORT, GROW = 16, 24, 4  # occurrences after which a unit gets a tree, its characters at most, occurrences that make a branch
NODES, COUNTED = 400_000, 1_000_000  # of the trees and of the units counted, before both begin anew
MARK = "▁"
_LAST, _GONE, _ALL = np.int64(1 << 62), -(1 << 40), (1 << 64) - 1


def _mix(h: int) -> int:
    """kernels.mix for one number."""
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & _ALL
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & _ALL
    return h ^ h >> 32


class Tree:
    """The agendas of units as decision trees, grown as they are walked."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.roots: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.n = 0
        self.place = np.zeros(1024, np.uint64)  # hash of a node's candidate
        self.branch = np.full((1024, 2), -1, np.int64)  # the node after taking or skipping it
        self.leaf = np.full(1024, -1, np.int64)  # a result's number, where no candidate is left
        self.states: list = []
        self.results: list[bytes] = []

    def node(self, ends: tuple, pieces: tuple, skipped: frozenset) -> int:
        """A new node for symbols with these ends and pieces: its next candidate is the best that is not skipped, leftmost among equals."""
        merges, size = self.codec.merges, self.codec.size
        best, start = None, 0
        for k in range(len(pieces) - 1):
            left, right = pieces[k], pieces[k + 1]
            if left >= 0 and right >= 0:
                found = merges.get(left * size + right)
                if found and (best is None or found[0] < best[0]) and (start, ends[k], ends[k + 1]) not in skipped:
                    best = found[0], k, found[1], start
            start = ends[k]
        n = self.n
        if n == len(self.place):
            self.place, self.leaf = np.append(self.place, np.zeros(n, np.uint64)), np.append(self.leaf, np.full(n, -1))
            self.branch = np.append(self.branch, np.full((n, 2), -1), axis=0)
        self.n += 1
        if best is None:
            self.leaf[n] = len(self.results)
            whole = min(pieces) >= 0
            self.results.append(array("i", pieces).tobytes() if whole else self.codec._ids(np.array(pieces, np.int64), np.zeros(len(pieces), np.int64), 1)[0])
            self.states.append(None)
        else:
            _, k, made, start = best
            self.place[n] = _mix((start << 40) + (ends[k] << 20) + ends[k + 1] + 1)
            self.states.append((ends, pieces, skipped, k, made, start))
        return n

    def grow(self, n: int, skip: int):
        ends, pieces, skipped, k, made, start = self.states[n]
        if skip:
            after = self.node(ends, pieces, skipped | {(start, ends[k], ends[k + 1])})
        else:
            after = self.node(ends[:k] + ends[k + 1 :], pieces[:k] + (made,) + pieces[k + 2 :], skipped)
        self.branch[n, skip] = after

    def plant(self, units: list[str]):
        piece, length = self.codec._symbols(units)
        at = 0
        for unit, n in zip(units, length.tolist(), strict=True):
            self.roots[unit] = self.node(tuple(range(1, n + 1)), tuple(piece[at : at + n].tolist()), frozenset())
            at += n

    def walk(self, roots: np.ndarray, keys: np.ndarray, bound: int) -> list[bytes | None]:
        """The results of occurrences by their hash keys; None for those that go where fewer than GROW have gone together and no branch is."""
        at = roots.copy()
        live = np.flatnonzero(self.leaf[at] < 0)
        while len(live):
            node = at[live]
            skip = (mix(keys[live] ^ self.place[node]) < np.uint64(bound)).astype(np.int64)
            after = self.branch[node, skip]
            new = np.flatnonzero(after < 0)
            if len(new):
                pairs, count = np.unique(node[new] * 2 + skip[new], return_counts=True)
                for pair in pairs[count >= GROW].tolist():
                    self.grow(pair >> 1, pair & 1)
                after = self.branch[node, skip]
                at[live[after < 0]] = -1
                live, after = live[after >= 0], after[after >= 0]
            at[live] = after
            live = live[self.leaf[after] < 0]
        results = [*self.results, None]
        return [results[k] for k in np.where(at < 0, -1, self.leaf[at]).tolist()]


class Codec:
    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.size = n
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte pieces")
        usable = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in usable):
            raise ValueError("a piece of the model holds a space after a letter")
        self.text = np.array([b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)], object)
        for value, i in self.bytes.items():
            self.text[i] = bytes([value])
        self.usable = usable
        self.letters = {ord(p): i for p, i in usable.items() if len(p) == 1}
        self.table = np.full(0x3000, -1, np.int64)
        for c, i in self.letters.items():
            if c < len(self.table):
                self.table[c] = i
        self.table[ord(MARK)] = -1
        self.table[32] = usable.get(MARK, -1)
        rank = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in usable.values()}, reverse=True))}
        pairs = sorted((usable[p[:k]] * n + usable[p[k:]], rank[sp.get_score(i)], i) for p, i in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable)
        self.pair, self.rank, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.merges = {int(p): (int(r), int(m)) for p, r, m in zip(self.pair, self.rank, self.merged, strict=True)}
        self._hashed()
        joint = {c for p in usable if len(p) > 1 for c in p}
        # a character of no longer piece stands alone; a new line is the one that matters
        self.unit = re.compile(r"\n| *[^ \n]+| +" if "\n" not in joint else r" *[^ ]+| +")
        self.unit_bytes = re.compile(self.unit.pattern.encode())

    def _hashed(self):
        """An open table of pairs with the next free slot after a pair's own, so that a look-up is a few gathers."""
        bits = max(10, int(len(self.pair) * 6).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int64)  # which pair, by number
        self.slot_pair = np.full((1 << bits) + 64, -1, np.int64)
        for k, at in enumerate(self._slot(self.pair).tolist()):
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.slot_pair[at] = k, self.pair[k]

    def _slot(self, pair):
        h = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def look_up(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these pairs merge, and their numbers."""
        at = self._slot(pair)
        held = self.slot_pair[at]
        found = np.where(held == pair, self.slots[at], -1)
        todo = np.flatnonzero((held >= 0) & (held != pair))
        while len(todo):
            at[todo] += 1
            held = self.slot_pair[at[todo]]
            same = held == pair[todo]
            found[todo[same]] = self.slots[at[todo[same]]]
            todo = todo[(held >= 0) & ~same]
        ok = np.flatnonzero(found >= 0)
        return ok, found[ok]

    def candidates(self, left, right, key, start, middle, end, rate):
        """Ranks and results of pairs; a skipped pair and one that is no piece rank last."""
        rank = np.full(len(left), _LAST)
        made = np.full(len(left), -1, np.int64)
        pair = left * self.size + right
        at = np.flatnonzero((left >= 0) & (right >= 0))
        ok, where = self.look_up(pair[at])
        at = at[ok]
        if rate > 0:
            place = (start[at].astype(np.uint64) << np.uint64(40)) + (middle[at].astype(np.uint64) << np.uint64(20)) + end[at].astype(np.uint64)
            ok = mix(key[at] ^ mix(place + np.uint64(1))) >= np.uint64(min(int(rate * 2.0**64), (1 << 64) - 1))
            at, where = at[ok], where[ok]
        rank[at], made[at] = self.rank[where], self.merged[where]
        return rank, made

    def encode_units(self, units: list[str], keys: np.ndarray, rate: float) -> list[bytes]:
        """Ids of each unit under its hash key, as int32 bytes: units of like length together, very long ones by an agenda of their own."""
        out: list[bytes] = [b""] * len(units)
        length = np.array([len(u) for u in units])
        order = np.argsort(length, kind="stable")
        short = order[length[order] <= LONG]
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER].tolist()
            for i, blob in zip(some, self._together([units[i] for i in some], keys[some], rate), strict=True):
                out[i] = blob
        for i in order[length[order] > LONG].tolist():
            out[i] = self._alone(units[i], int(keys[i]), rate)
        return out

    def _symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of single characters (or, for a character without one, -2 less its code) and lengths of units."""
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.array([len(u) for u in units], np.int64)
        known = code < len(self.table)
        piece = np.where(known, self.table[np.where(known, code, 0)], -1)
        for k in np.flatnonzero(~known).tolist():
            piece[k] = self.letters.get(int(code[k]), -1)
        return np.where(piece >= 0, piece, -2 - code), length

    def _together(self, units: list[str], keys: np.ndarray, rate: float) -> list[bytes]:
        """Every step takes the best candidate of each unit. Symbols keep their places and are linked to their neighbours."""
        piece, length = self._symbols(units)
        n = len(piece)
        first = np.cumsum(length) - length
        unit = np.repeat(np.arange(len(units)), length)
        place = np.arange(n)
        start = place - first[unit]
        end = start + 1
        after, before = place + 1, place - 1
        after[first + length - 1] = -1
        before[first] = -1
        best = np.full(n, _LAST)
        made = np.full(n, -1, np.int64)

        def renew(at):
            right = after[at]
            rank, result = self.candidates(piece[at], piece[right], keys[unit[at]], start[at], end[at], end[right], rate)
            best[at] = np.where(rank < _LAST, (rank << 32) + at, _LAST)
            made[at] = result

        renew(np.flatnonzero(after >= 0))
        live = first
        while len(live):
            top = np.minimum.reduceat(best, live)  # units that are done have no candidates left
            top = top[top < _LAST]
            if not len(top):
                break
            at = top & np.int64(0xFFFFFFFF)
            live = first[unit[at]]
            right = after[at]
            piece[at], end[at] = made[at], end[right]
            piece[right], best[right] = _GONE, _LAST
            after[at] = after[right]
            follows = after[at] >= 0
            before[after[at[follows]]] = at[follows]
            best[at] = _LAST
            ahead = before[at]
            renew(np.concatenate([at[follows], ahead[ahead >= 0]]))
        kept = piece != _GONE
        return self._ids(piece[kept], unit[kept], len(units))

    def _ids(self, piece: np.ndarray, unit: np.ndarray, n: int) -> list[bytes]:
        """int32 bytes by unit; characters without a piece become byte pieces."""
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            out, owner = [], []
            for p, u in zip(piece.tolist(), unit.tolist(), strict=True):
                own = [p] if p >= 0 else [self.bytes[b] for b in chr(-2 - p).encode("utf-8", "surrogatepass")]
                out += own
                owner += [u] * len(own)
            piece, unit = np.array(out), np.array(owner)
        blob = piece.astype(np.int32).tobytes()
        cuts = (np.searchsorted(unit, np.arange(n + 1)) * 4).tolist()
        return [blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _alone(self, text: str, key: int, rate: float) -> bytes:
        """A heap as the agenda, for a unit of many symbols."""
        piece, _ = self._symbols([text])
        piece, n = piece.tolist(), len(piece)
        end, after, before = list(range(1, n + 1)), [*range(1, n), -1], list(range(-1, n - 1))
        bound = min(int(rate * 2.0**64), (1 << 64) - 1)

        def candidate(at):
            right = after[at]
            if right < 0 or piece[at] < 0 or piece[right] < 0:
                return
            found = self.merges.get(piece[at] * self.size + piece[right])
            if found and (rate <= 0 or _mix(key ^ _mix((at << 40) + (end[at] << 20) + end[right] + 1 & _ALL)) >= bound):
                heappush(agenda, (found[0], at, end[at], end[right], found[1]))

        agenda: list[tuple] = []
        for k in range(n - 1):
            candidate(k)
        while agenda:
            _, at, middle, stop, made = heappop(agenda)
            right = after[at]
            if piece[at] == _GONE or right < 0 or end[at] != middle or end[right] != stop:
                continue  # one of the two has merged since
            piece[at], end[at], piece[right] = made, stop, _GONE
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
                candidate(at)
            if before[at] >= 0:
                candidate(before[at])
        kept = np.array([p for p in piece if p != _GONE], np.int64)
        return self._ids(kept, np.zeros(len(kept), np.int64), 1)[0]

    def encode(self, texts: list[str], docs: list[int], kept: dict, seed: int = SEED, rate: float = RATE) -> list[bytes]:
        """Ids of texts; docs has a number for each document. kept holds the trees of units met often."""
        cut = [self.unit_bytes.findall(f" {t}".encode("utf-8", "surrogatepass")) if t else [] for t in texts]
        count = np.array([len(units) for units in cut], np.int64)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        doc = np.repeat(np.array(docs, np.int64).view(np.uint64), count)
        keys = mix(mix(doc ^ mix(place.astype(np.uint64) + np.uint64(1))) + np.uint64(seed * 0x9E3779B97F4A7C15 & _ALL))
        coded = pa.array([u for own in cut for u in own], pa.binary()).dictionary_encode()
        which = coded.indices.to_numpy()
        units = [u.decode("utf-8", "surrogatepass") for u in coded.dictionary.to_pylist()]
        tree: Tree = kept.setdefault("tree", None) or Tree(self)
        if tree.n > NODES or len(tree.seen) > COUNTED:
            tree = Tree(self)
        kept["tree"] = tree
        new, first = [], []
        for u, n in zip(units, np.bincount(which, minlength=len(units)).tolist(), strict=True):
            root = tree.roots.get(u, -1)
            if root < 0 and len(u) <= SHORT:
                seen = tree.seen.get(u, 0) + n
                tree.seen[u] = seen
                if seen >= OFTEN:
                    new.append(u)
            first.append(root)
        if new:
            tree.plant(new)
            first = [tree.roots.get(u, -1) for u in units]
        roots = np.array(first, np.int64)[which]
        found = np.empty(len(which), object)
        often = np.flatnonzero(roots >= 0)
        found[often] = tree.walk(roots[often], keys[often], min(int(rate * 2.0**64), _ALL) if rate > 0 else 0)
        seldom = np.flatnonzero(found == None)  # noqa: E711
        found[seldom] = self.encode_units([units[k] for k in which[seldom].tolist()], keys[seldom], rate)
        found = found.tolist()
        ends = np.cumsum(count).tolist()
        return [b"".join(found[e - n : e]) for e, n in zip(ends, count.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes; the space that encoding puts first goes."""
        return b"".join(self.text[ids].tolist())[1:]


_codecs: dict[str, Codec] = {}


def codec(sent) -> Codec:
    """The worker's codec for a broadcast model."""
    model = sent.value
    name = hashlib.sha256(model).hexdigest()
    if name not in _codecs:
        _codecs[name] = Codec(model)
    return _codecs[name]


def encoded(documents: DataFrame, key: str = "doc_id", model: str = MODEL, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """key, n_tokens, ids, lossless (the ids decode to the text's bytes).

    A null text has null ids; an empty one has none. Draws depend on a hash of the key.
    """
    with open(model, "rb") as f:  # on the driver; the file is small and goes out by broadcast
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        own, kept = codec(sent), {}
        for batch in batches:
            for part in slices(batch, limit=2 * SLICE_BYTES):
                texts = part.column("text").to_pylist()
                blobs = own.encode([t or "" for t in texts], part.column("_doc").to_pylist(), kept, seed, rate)
                sizes = np.array([len(b) // 4 for b in blobs])
                ids = np.frombuffer(b"".join(blobs), np.int32)
                ends = np.cumsum(sizes)
                same = [None if t is None else own.decode(ids[e - n : e]) == t.encode("utf-8", "surrogatepass") for t, n, e in zip(texts, sizes.tolist(), ends.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(sizes, pa.int64()), lists, pa.array(same, pa.bool_())], names=[key, "n_tokens", "ids", "lossless"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(key, F.col("text").cast("string").alias("text"), F.xxhash64(key).alias("_doc"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids array<int>, lossless boolean")


def decoded(tokens: DataFrame, key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """key and text from ids; null ids give a null text."""
    with open(model, "rb") as f:
        sent = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        own = codec(sent)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return tokens.select(key, "ids").mapInArrow(run, f"`{key}` {tokens.schema[key].dataType.simpleString()}, text string")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
