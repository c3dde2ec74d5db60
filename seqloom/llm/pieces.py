"""SentencePiece encoding and decoding by suffix-array matching.

The batch's text is cut where no piece reaches over: at word starts, and before marks that no piece has
after a letter. Each distinct part enters
a concatenated index once. The index is ordered by its suffixes, to the depth of the longest piece;
every piece is looked up by binary search, which gives the range of suffixes that begin with it, that is
its occurrences. These edges are sorted by position and relaxed from left to right.

The model is of the byte-pair kind: an edge is relaxed when its piece and the piece that ends where
it starts survive merging side by side, which singles out one edge into every position and gives the ids of
the merging order exactly. Characters that no piece has become their bytes' pieces.

Defined cases: null or empty text has no ids, and no ids decode to the empty text; very long parts are
matched like others; the model's path is a parameter; control ids decode to nothing. The escape character
U+2581 in a text decodes to a space, as in the original.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import Numbers
from .shared import whole_text

SPACE = "▁"
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
BLOCK = 400_000  # characters of distinct parts in one index, about
GROUP = 3_000_000  # characters of text encoded together, about
CACHED_PARTS = 400_000
CACHED_IDS = 8_000_000


class Model:
    """Pieces, scores and byte pieces of a byte-pair SentencePiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        number = range(loaded.vocab_size())
        special = [loaded.is_byte(i) or loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i) for i in number]
        names = [loaded.id_to_piece(i) for i in number]
        self.id_of = {names[i]: i for i in number if not special[i]}
        self.score = {names[i]: loaded.get_score(i) for i in number if not special[i]}
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.bytes_of = [b""] * len(names)
        for i in number:
            if loaded.is_byte(i):
                self.byte_id[int(names[i][1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(names[i][1:-1], 16)])
            elif not special[i]:
                self.bytes_of[i] = names[i].replace(SPACE, " ").encode()
        self.size = len(names)
        self.names = sorted(x for x in self.id_of if self.merged(x) == [x])
        self.ids = np.array([self.id_of[x] for x in self.names], dtype=np.int64)
        self.text_of = {self.id_of[x]: x for x in self.names}
        self.longest = max(map(len, self.names))
        self.by_length = {}
        for n in range(1, self.longest + 1):
            mine = [k for k, x in enumerate(self.names) if len(x) == n]
            if mine:
                letters = np.array([[ord(c) for c in self.names[k]] for k in mine], dtype=np.int64)
                self.by_length[n] = (letters, self.ids[mine])
        # Marks that no piece has right after a letter: a part can end before them too.
        letter = re.compile(f"[{LETTERS}]")
        after = {b for x in self.id_of for a, b in zip(x, x[1:], strict=False) if letter.match(a)}
        apart = "".join(re.escape(c) for c in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~\n" if c not in after)
        self.part = re.compile(f"{SPACE}*[{LETTERS}]+(?=[{SPACE}{apart}]|$)|{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pairs = np.zeros(0, dtype=np.int64)
        self.pair_ok = np.zeros(0, dtype=bool)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short string: the adjacent pair of the best score first, the left one of equals."""
        parts, get, none = list(text), self.score.get, float("-inf")
        best = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while best:
            top = max(best)
            if top == none:
                break
            i = best.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del best[i]
            if i < len(best):
                best[i] = get(parts[i] + parts[i + 1], none)
            if i:
                best[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def together(self, keys: np.ndarray) -> np.ndarray:
        """Whether two pieces (first * size + second) survive merging side by side; what was asked is kept, up to a bound."""
        at = np.searchsorted(self.pairs, keys)
        known = np.append(self.pairs, -1)[at] == keys
        if not known.all():
            if len(self.pairs) > 3_000_000:
                self.pairs, self.pair_ok = self.pairs[:0], self.pair_ok[:0]
            new = np.unique(keys[~known])
            texts = [(self.text_of[k // self.size], self.text_of[k % self.size]) for k in new.tolist()]
            fine = np.array([self.merged(a + b) == [a, b] for a, b in texts], dtype=bool)
            pairs, ok = np.r_[self.pairs, new], np.r_[self.pair_ok, fine]
            by = np.argsort(pairs, kind="stable")
            self.pairs, self.pair_ok = pairs[by], ok[by]
            at = np.searchsorted(self.pairs, keys)
            if (np.append(self.pairs, -1)[at] != keys).any():
                return self.together(keys)
        return self.pair_ok[at]


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` (small numbers) ordered by what follows, to at least ``depth`` places, by doubling."""
    base, key, width = int(codes.max(initial=0)) + 2, codes.astype(np.int64) + 1, 1

    def shifted(values, by):
        out = np.zeros_like(values)
        out[: max(0, len(values) - by)] = values[by:]
        return out

    while width < depth and base * base < 1 << 62:  # as many symbols as one number holds
        key, base, width = key * base + shifted(key, width), base * base, 2 * width
    while width < depth:
        rank = np.unique(key, return_inverse=True)[1] + 1
        key, width = rank * (len(rank) + 2) + shifted(rank, width), 2 * width
    return np.argsort(key).astype(np.int32)


def occurrences(codes: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``wanted`` (pieces of one length), the range of suffixes that begin with it, by binary search."""
    n = wanted.shape[1]
    padded = np.concatenate([codes, np.full(n, -1, dtype=codes.dtype)])
    window = np.arange(n)

    def search(upper):
        low, high = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), len(order), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            here, want = padded[order[mid][:, None] + window], wanted[open_]
            differ = here != want
            at = differ.argmax(axis=1)
            line = np.arange(len(open_))
            equal = ~differ[line, at]
            less = ~equal & (here[line, at] < want[line, at])
            right = less | equal if upper else less
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]

    return search(False), search(True)


def encode_parts(model: Model, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct parts: how many each has, and all in a row."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    letters = np.frombuffer("".join(p + "\0" for p in parts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    letters[firsts + sizes] = -1  # ends a part, and equals no character
    order = suffix_order(np.unique(letters, return_inverse=True)[1], model.longest)
    starts, lengths, pieces = [], [], []
    covered = np.zeros(len(letters), dtype=bool)
    for n, (wanted, ids) in model.by_length.items():
        low, high = occurrences(letters, order, wanted)
        many = high - low
        at = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        starts.append(at)
        lengths.append(np.full(len(at), n, dtype=np.int32))
        pieces.append(np.repeat(ids.astype(np.int32), many))
        if n == 1:
            covered[at] = True
    start, length, piece = map(np.concatenate, (starts, lengths, pieces))
    offset = (np.arange(len(letters)) - np.repeat(firsts, sizes + 1)).astype(np.int32)[start]
    by = np.argsort(offset.astype(np.uint16) if sizes.max(initial=0) < 1 << 16 else offset, kind="stable")  # all parts in step
    start, length, piece, offset = start[by], length[by], piece[by], offset[by]
    # last: the piece that ends before a position; -1 nothing yet, -2 a part's start or an unknown character.
    last, back = np.full(len(letters) + 1, -1, dtype=np.int64), np.zeros(len(letters) + 1, dtype=np.int64)
    last[firsts] = -2
    unknown = np.flatnonzero(~covered & (letters >= 0))
    last[unknown + 1], back[unknown + 1] = -2, 1
    last[(firsts + sizes)[sizes == 0]] = -2
    cuts = np.r_[np.searchsorted(offset, np.arange(int(sizes.max(initial=0)) + 1)), len(offset)]
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            continue
        s, t = start[a:b], piece[a:b]
        before = last[s]
        ok = before == -2
        ask = np.flatnonzero(before >= 0)
        if len(ask):
            ok[ask] = model.together(before[ask] * model.size + t[ask])
        e = s[ok] + length[a:b][ok]
        last[e], back[e] = t[ok], length[a:b][ok]
    # Follow the relaxed edges back from the parts' ends, all parts at a time.
    at, open_ = firsts + sizes, np.flatnonzero(sizes > 0)
    owners, places, found = [], [], []
    while len(open_):
        here = at[open_]
        owners.append(open_)
        places.append(here)
        found.append(np.where(last[here] == -2, -letters[here - 1] - 1, last[here]))
        at[open_] -= back[here]
        open_ = open_[at[open_] > firsts[open_]]
    if not owners:
        return np.zeros(len(parts), np.int64), np.zeros(0, np.int64)
    owner, place, ids = map(np.concatenate, (owners, places, found))
    by = np.lexsort((place, owner))
    owner, ids = owner[by], ids[by]
    if (ids < 0).any():  # unknown characters become the pieces of their bytes
        spelled = [[int(model.byte_id[x]) for x in chr(-i - 1).encode()] if i < 0 else [i] for i in ids.tolist()]
        owner = np.repeat(owner, [len(x) for x in spelled])
        ids = np.array(list(chain.from_iterable(spelled)), dtype=np.int64)
    return np.bincount(owner, minlength=len(parts)), ids


class Encoder:
    """Encodes texts; the ids of parts seen before are looked up in a cache of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place = Numbers()
        self.sizes = self.starts = self.flat = np.zeros(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        sizes, flat, block, size = [self.sizes], [self.flat], [], 0
        for n, part in enumerate(parts):
            block.append(part)
            size += len(part) + 1
            if size > BLOCK or n == len(parts) - 1:
                counts, ids = encode_parts(self.model, block)
                sizes.append(counts)
                flat.append(ids)
                block, size = [], 0
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > CACHED_PARTS or len(self.flat) > CACHED_IDS:
            self.clear()
        parts = [self.model.part.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        count = [len(p) for p in parts]
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=sum(count))
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return np.split(ids, np.r_[0, ends][np.cumsum(count)][:-1]) if texts else []


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder: its model and caches serve all tasks that the worker runs."""
    return Encoder(Model(path))


def decode_ids(model: Model, ids) -> str:
    text = b"".join([model.bytes_of[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model_path: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids and, if asked for, the text that the ids decode to."""

    def run(batches):
        encoder = encoder_of(model_path)
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id")
            first, size = 0, 0
            for at, text in enumerate(texts):
                size += len(text)
                if size > GROUP or at == len(texts) - 1:
                    got = encoder.encode(texts[first : at + 1])
                    flat = np.concatenate([*got, np.zeros(0, np.int64)]).astype(np.int32)
                    ends = np.r_[0, np.cumsum([len(x) for x in got])].astype(np.int32)
                    out = {"doc_id": keys.slice(first, at + 1 - first), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
                    if decoded:
                        out["text"] = pa.array([decode_ids(encoder.model, x.tolist()) for x in got], pa.string())
                    yield pa.RecordBatch.from_pydict(out)
                    first, size = at + 1, 0

    kind = "doc_id long, ids array<int>" + ", text string" * decoded
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, kind)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, text. Null ids decode to the empty text."""

    def run(batches):
        model = encoder_of(model_path).model
        for batch in batches:
            text = [decode_ids(model, x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
