"""SentencePiece encoding by a unigram Viterbi search over a double-array trie, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: how much worse than the worst piece a character outside the vocabulary scores (fixed by the format)
UNKNOWN_PENALTY = 10.0

#: text encoded at once in a task, in characters, and distinct words remembered by a task
BLOCK_CHARS = 2_000_000
MEMORY_WORDS = 300_000
#: longer words are searched one by one, without padding
LONG_WORD = 256


@dataclass
class Vocabulary:
    """Pieces with log scores as a double array: child = base[node] + code, valid if check[child] == node."""

    pieces: list[str]
    byte_ids: np.ndarray
    unknown_id: int
    unknown_score: float
    scores: np.ndarray
    codes: np.ndarray  # code point -> code, 0: in no piece
    base: np.ndarray
    check: np.ndarray
    piece_at: np.ndarray  # node -> piece id, -1: none
    split: str  # pattern of parts that no piece crosses

    @property
    def depth(self) -> int:
        return max(map(len, self.pieces))


def read_vocabulary(model: str = MODEL) -> Vocabulary:
    """Pieces of a model file with the log scores stored in it. Byte, control and unknown pieces are not searched."""
    import sentencepiece

    with open(model, "rb") as file:
        processor = sentencepiece.SentencePieceProcessor(model_proto=file.read())
    n = processor.get_piece_size()
    pieces = [processor.id_to_piece(i) for i in range(n)]
    searched = [i for i in range(n) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
    byte_ids = np.full(256, -1, dtype=np.int32)
    for i in range(n):
        if processor.is_byte(i):
            byte_ids[int(pieces[i][3:5], 16)] = i
    scores = np.array([processor.get_score(i) for i in range(n)])
    return build_vocabulary(pieces, scores, searched, byte_ids, processor.unk_id())


def build_vocabulary(pieces: list[str], scores, searched: list[int], byte_ids, unknown_id: int) -> Vocabulary:
    """Lay the searched pieces out as a double array.

    An only child takes the first free place that fits; several children are tried from where the last such
    search ended if it was long, so building stays near linear.
    """
    alphabet = sorted({c for i in searched for c in pieces[i]})
    codes = np.zeros(0x110000, dtype=np.int32)
    codes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
    root: dict = {}
    for i in searched:
        node = root
        for c in pieces[i]:
            node = node.setdefault(int(codes[ord(c)]), {})
        node[-1] = i
    size = 1 << 20
    base, check = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32)
    piece_at = np.full(size, -1, dtype=np.int32)
    after = list(range(size + 1))  # place -> itself if free, else towards the next free place
    top = after[0] = 1

    def free(place: int) -> int:
        end = place
        while after[end] != end:
            end = after[end]
        while after[place] != end:
            after[place], place = end, after[place]
        return end

    cursor, queue = 0, [(0, root)]
    for place, node in queue:
        piece_at[place] = node.pop(-1, -1)
        if not node:
            continue
        first, *others = sorted(node)
        spot = free(max(first + 1, cursor if others else 0))
        begin = spot
        while any(after[spot - first + c] != spot - first + c for c in others):
            spot = free(spot + 1)
        if spot - begin > 64:
            cursor = spot
        start, children = spot - first, [first, *others]
        base[place] = start
        for c in children:
            after[start + c] = start + c + 1
            check[start + c] = place
            queue.append((start + c, node[c]))
            top = max(top, start + c)
        if top + len(alphabet) + 2 > size:
            grow = np.full(size, -1, dtype=np.int32)
            base, check, piece_at = np.concatenate([base, grow]), np.concatenate([check, grow]), np.concatenate([piece_at, grow])
            after += range(size + 1, 2 * size + 1)
            size *= 2
    end = top + len(alphabet) + 2
    scores = np.asarray(scores, dtype=np.float64)
    # parts: a run of markers with what follows up to the next marker, cut too at line ends and tabs inside no piece
    alone = "".join(c for c in "\n\t" if not any(c in pieces[i] and len(pieces[i]) > 1 for i in searched))
    crossing = any(MARK in pieces[i].lstrip(MARK) for i in searched)
    split = r"(?s:.+)" if crossing else f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+"
    return Vocabulary(
        pieces, np.asarray(byte_ids), unknown_id, float(scores[searched].min()) - UNKNOWN_PENALTY if searched else 0.0, scores, codes,
        base[:end].copy(), check[:end].copy(), piece_at[:end].copy(), split,
    )


def _search_long(v: Vocabulary, codes: list[int]) -> list[tuple[int, int]]:
    """(piece or -1, start) along the best path of one word."""
    n, base, check, at, scores = len(codes), v.base, v.check, v.piece_at, v.scores
    best, back = [0.0] + [-np.inf] * n, [(-1, 0)] * (n + 1)
    for p in range(n):
        node, q, single = 0, p, False
        while q < n and codes[q]:
            child = int(base[node]) + codes[q]
            if check[child] != node:
                break
            node, q = child, q + 1
            piece = int(at[node])
            if piece >= 0:
                single |= q == p + 1
                score = best[p] + scores[piece]
                if score > best[q]:
                    best[q], back[q] = score, (piece, p)
        if not single and best[p] + v.unknown_score > best[p + 1]:
            best[p + 1], back[p + 1] = best[p] + v.unknown_score, (-1, p)
    path, q = [], n
    while q:
        path.append(back[q])
        q = back[q][1]
    return path[::-1]


def _search_many(v: Vocabulary, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of words of similar length at once: (back piece, back start), word by end position.

    ``codes`` is padded with 0, which no edge of the trie carries.
    """
    words, width = codes.shape
    best = np.full((words, width + 1), -np.inf)
    best[:, 0] = 0
    piece_to, start_to = np.full((words, width + 1), -1, dtype=np.int32), np.zeros((words, width + 1), dtype=np.int32)
    for p in range(width):
        rows = np.flatnonzero(lengths > p)
        here, node = best[rows, p], np.zeros(len(rows), dtype=np.int32)
        single = np.zeros(len(rows), dtype=bool)
        active = np.arange(len(rows))
        for q in range(p, min(width, p + v.depth)):
            child = v.base[node] + codes[rows[active], q]
            fits = (v.check[child] == node) & (codes[rows[active], q] > 0)
            active, node = active[fits], child[fits]
            if not len(active):
                break
            piece = v.piece_at[node]
            ends = piece >= 0
            who, found = active[ends], piece[ends]
            if q == p:
                single[who] = True
            score = here[who] + v.scores[found]
            target = rows[who]
            better = score > best[target, q + 1]
            target = target[better]
            best[target, q + 1], piece_to[target, q + 1], start_to[target, q + 1] = score[better], found[better], p
        score = here + v.unknown_score
        better = ~single & (score > best[rows, p + 1])
        target = rows[better]
        best[target, p + 1], piece_to[target, p + 1], start_to[target, p + 1] = score[better], -1, p
    return piece_to, start_to


class Encoder:
    """Encodes and decodes texts; keeps the ids of words met before, up to `MEMORY_WORDS`."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = re.compile(vocabulary.split)
        byte_of = {int(i): bytes([b]) for b, i in enumerate(vocabulary.byte_ids) if i >= 0}
        self.bytes_of = [byte_of.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(vocabulary.pieces)]
        self._forget()

    def _forget(self):
        self.index: dict[str, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text ends). Null and empty texts have no ids."""
        if len(self.index) > MEMORY_WORDS:
            self._forget()
        index, known = self.index, len(self.index)
        words, ends = [], []
        for t in texts:
            if t:
                words += [index.setdefault(w, len(index)) for w in self.split.findall(MARK + t.replace(" ", MARK))]
            ends.append(len(words))
        if len(index) > known:
            self._learn(list(index)[known:])
        which = np.array(words, dtype=np.int64)
        sizes = self.sizes[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.arange(total[-1]) + np.repeat(self.starts[which] - total[:-1], sizes)]
        return ids, total[np.array(ends, dtype=np.int64)]

    def decode(self, ids: list[int]) -> str:
        """Piece texts and byte pieces joined, markers as spaces, without the space that encoding puts first."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text

    def _learn(self, words: list[str]) -> None:
        v, sizes = self.v, np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        codes = v.codes[points]
        order, paths, counts = np.argsort(sizes, kind="stable"), [None] * len(words), np.zeros(len(words), dtype=np.int64)
        for lo in range(0, len(order), 16384):
            block = order[lo:lo + 16384]
            for w in block[sizes[block] > LONG_WORD]:
                a = offsets[w]
                path = _search_long(v, codes[a:a + sizes[w]].tolist())
                ids = [i for piece, p in path for i in ([piece] if piece >= 0 else self._bytes(points[a + p]))]
                paths[w], counts[w] = np.array(ids, dtype=np.int32), len(ids)
            block = block[sizes[block] <= LONG_WORD]
            if len(block):
                self._learn_block(block, sizes, offsets, points, codes, paths, counts)
        flat = np.concatenate(paths).astype(np.int32)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
        self.sizes = np.concatenate([self.sizes, counts])
        self.pool = np.concatenate([self.pool, flat])

    def _learn_block(self, block, sizes, offsets, points, codes, paths, counts) -> None:
        lengths = sizes[block]
        width = int(lengths.max())
        cells = np.arange(width)
        inside = cells < lengths[:, None]
        places = np.where(inside, offsets[block][:, None] + cells, 0)
        piece_to, start_to = _search_many(self.v, np.where(inside, codes[places], 0), lengths)
        at, back = lengths.copy(), []
        live = np.arange(len(block))
        while len(live):
            piece, start = piece_to[live, at[live]], start_to[live, at[live]]
            back.append((live, piece, start))
            at[live] = start
            live = live[start > 0]
        who = np.concatenate([b[0] for b in reversed(back)])
        piece = np.concatenate([b[1] for b in reversed(back)])
        start = np.concatenate([b[2] for b in reversed(back)])
        order = np.lexsort((start, who))
        who, piece, start = who[order], piece[order], start[order]
        cuts = np.searchsorted(who, np.arange(len(block) + 1))
        has_unknown = np.zeros(len(block), dtype=bool)
        has_unknown[who[piece < 0]] = True
        for k, w in enumerate(block):
            ids = piece[cuts[k]:cuts[k + 1]]
            if has_unknown[k]:
                a = offsets[w]
                ids = np.array([
                    i for x, p in zip(ids, start[cuts[k]:cuts[k + 1]]) for i in ([x] if x >= 0 else self._bytes(points[a + p]))
                ], dtype=np.int32)
            paths[w], counts[w] = ids, len(ids)

    def _bytes(self, point: int) -> list[int]:
        """A character outside the vocabulary: its UTF-8 bytes, or the unknown piece where there are no byte pieces."""
        ids = [int(self.v.byte_ids[b]) for b in chr(point).encode(errors="replace")]
        return ids if min(ids) >= 0 else [self.v.unknown_id]


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, vocabulary: Vocabulary) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _share(spark: SparkSession, model: str):
    """The double array, of a size fixed by the vocabulary (some MB), for every worker."""
    return spark.sparkContext.broadcast(read_vocabulary(model)), hashlib.md5(model.encode()).hexdigest()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text.

    Null and empty texts have no ids and decode to an empty text. Spaces become markers and one marker goes first;
    there is no other normalisation, so decoding restores the text, but for literal markers, which become
    spaces. Of paths with equal scores the one that reaches a position from the left-most start wins.
    Words are searched once in a task; a text is encoded whole, in blocks of `BLOCK_CHARS` with others.
    """
    shared, key = _share(docs.sparkSession, model)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        for batch in batches:
            for lo, hi, texts in text_blocks(batch.column(1)):
                ids, ends = encoder.encode(texts)
                starts = np.concatenate([[0], ends[:-1]])
                decoded = [encoder.decode(ids[a:b].tolist()) for a, b in zip(starts, ends)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def text_blocks(column: pa.Array, chars: int = BLOCK_CHARS, rows: int = 1 << 20) -> Iterator[tuple[int, int, list]]:
    """Stretches (from, to, texts) of a column of at most ``rows`` rows and ``chars`` characters, or one text."""
    texts, lo, held = column.to_pylist(), 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > lo and (held + n > chars or k - lo >= rows):
            yield lo, k, texts[lo:k]
            lo, held = k, 0
        held += n
    if lo < len(texts):
        yield lo, len(texts), texts[lo:]
