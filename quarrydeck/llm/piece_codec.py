"""SentencePiece encoding and decoding by shared-prefix Viterbi.

White space becomes the mark U+2581, and a text is cut into marked words: a run of marks and what follows up to the next
mark. No piece of the model holds a mark behind another character (this is checked), so the best segmentation of a text is
that of its words in turn. The distinct words of a batch are sorted, so that a word adds to their trie only the nodes beyond
the prefix that it shares with the word before it. Each node of this trie gets one forward score: the pieces that end there
are found by a walk up to the root along the trie of the reversed pieces, for all nodes at once, and the scores are computed
level by level, for all nodes of a depth at once (one by one where a level has few nodes, as behind very long words).

Segmentation maximises the sum of piece scores, as the library does for a model of the unigram kind; of equal sums the one
whose last piece starts first wins. The scores in a file of the BPE kind are negated merge ranks: with such a file the
result is the best path under those scores, which is what the library gives for the same file declared as unigram, and
can differ from its BPE merges. Characters without a piece become byte pieces where the model has them, else ``unk``.

Cases: a null or empty text has no pieces and decodes to an empty text; decoding turns U+2581 in the original into a blank,
as the library does, so such a text doesn't come back as it was; words of any length are encoded whole; repeated rows stay
rows with equal results; an empty table gives an empty one; extra columns pass, but one that is called like a made column
(``piece_ids``, ``decoded``) is replaced by it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from ._common import arrow_map, slices

MARK = "\u2581"
WORD = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
SLICE_ROWS, BLOCK_CHARS = 1024, 1 << 19
FEW = 64  # levels with fewer nodes are taken node by node


class ReversedTrie:
    """The pieces' trie, read from their last characters: the child of a state by a character is ``target[base[state] + character]``
    if ``owner`` has the state there. Characters are numbered from 1 on; 0 is any that no piece holds."""

    def __init__(self, pieces: dict[str, int]) -> None:
        numbers = {c: i for i, c in enumerate(sorted({c for p in pieces for c in p}), 1)}
        children, ends = [{}], [-1]
        for piece, i in pieces.items():
            state = 0
            for c in reversed(piece):
                if (child := children[state].get(numbers[c])) is None:
                    child = children[state][numbers[c]] = len(children)
                    children.append({})
                    ends.append(-1)
                state = child
            ends[state] = i
        span, draw = 8 * len(children), random.Random(0)
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in numbers]] = list(numbers.values())
        self.base, self.ends = np.zeros(len(children), np.int32), np.array(ends, np.int32)
        owner, target = [-1] * (span + len(numbers) + 1), [0] * (span + len(numbers) + 1)
        for state in sorted(range(len(children)), key=lambda i: -len(children[i])):  # the largest first, while all is free
            at = draw.randrange(span)
            while any(owner[at + c] >= 0 for c in children[state]):
                at = draw.randrange(span)
            self.base[state] = at
            for c, child in children[state].items():
                owner[at + c], target[at + c] = state, child
        self.owner, self.target = np.array(owner, np.int32), np.array(target, np.int32)


def shared_prefixes(chars: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many characters each word shares with the word before it."""
    shared = np.zeros(len(sizes), np.int64)
    left = np.arange(1, len(sizes))
    most = np.minimum(sizes[1:], sizes[:-1])
    for depth in range(FEW):
        left = left[most[left - 1] > depth]
        left = left[chars[begin[left] + depth] == chars[begin[left - 1] + depth]]
        if not len(left):
            return shared
        shared[left] = depth + 1
    for i in left.tolist():
        a, b, m = begin[i - 1], begin[i], most[i - 1]
        differ = np.flatnonzero(chars[a : a + m] != chars[b : b + m])
        shared[i] = differ[0] if len(differ) else m
    return shared


@dataclass
class PieceModel:
    pieces: list[str]
    kinds: list[str]  # normal, byte, control, unknown
    scores: list[float]
    dummy_prefix: bool
    scored: dict[str, tuple[float, int]] = field(default_factory=dict)
    longest: int = 0
    unknown: int = 0
    unknown_score: float = 0.0
    bytes_: list[int] | None = None
    trie: ReversedTrie | None = None
    score_of: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.scored = {p: (s, i) for i, (p, k, s) in enumerate(zip(self.pieces, self.kinds, self.scores)) if k == "normal"}
        if any(MARK in p.lstrip(MARK) for p in self.scored):
            raise ValueError("a piece of the model holds a mark inside; its words can't be encoded apart")
        self.longest = max(map(len, self.scored), default=0)
        self.unknown = self.kinds.index("unknown")
        self.unknown_score = min((s for s, _ in self.scored.values()), default=0.0) - 10
        self.trie = ReversedTrie({p: i for p, (_, i) in self.scored.items()})
        self.score_of = np.array([*self.scores, self.unknown_score])
        by_name = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == "byte"}
        self.bytes_ = [by_name[f"<0x{b:02X}>"] for b in range(256)] if len(by_name) == 256 else None

    def ending_pieces(self, low: int, high: int, char: np.ndarray, parent: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """The pieces that end at the nodes from ``low`` to ``high``, the longest first, an array each for node, start, piece (-1: an
        unknown character) and score; nodes ascend for each length."""
        trie = self.trie
        node = np.arange(low, high, dtype=np.int32)
        at, state, found = node, np.zeros(len(node), np.int32), []
        for length in range(1, max(self.longest, 1) + 1):
            slot = trie.base[state] + char[at]
            on = np.flatnonzero(trie.owner[slot] == state)
            if length == 1:
                piece = np.full(len(node), -1, np.int32)
                piece[on] = trie.ends[trie.target[slot[on]]]
                found.append((node, parent[low:high], piece))
            node, at, state = node[on], parent[at[on]], trie.target[slot[on]]
            if length > 1:
                hit = np.flatnonzero(trie.ends[state] >= 0)
                found.append((node[hit], at[hit], trie.ends[state[hit]]))
        return [(*x, self.score_of[x[2]]) for x in reversed(found)]

    def encode_block(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of sorted words, one after the other, and the number of each word's; ``chars`` are the words' code points."""
        n = len(sizes)
        begin = np.cumsum(sizes) - sizes
        shared = shared_prefixes(chars, begin, sizes)
        fresh = sizes - shared
        ends = np.cumsum(fresh)
        total = int(ends[-1]) if n else 0
        if not total:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)

        # nodes by depth, the root is 0; a word's first own node hangs on the last one of an earlier word
        depth = np.arange(total) - np.repeat(ends - fresh - shared, fresh)
        order = np.argsort(depth.astype(np.uint16) if depth.max() < 1 << 16 else depth, kind="stable")
        number = np.empty(total, np.int32)
        number[order] = np.arange(1, total + 1, dtype=np.int32)
        point = np.concatenate([[0], chars[(np.repeat(begin, fresh) + depth)[order]]])
        char = self.trie.number[point]
        char[0] = 0
        keys = (depth * n + np.repeat(np.arange(n), fresh))[order]
        up = np.concatenate([[0], number[:-1]])
        own = fresh > 0
        up[(ends - fresh)[own]] = np.searchsorted(keys, ((shared - 1) * n + np.arange(n))[own], "right")
        parent = np.zeros(total + 1, np.int32)
        parent[number] = up
        stop = np.searchsorted(keys, (sizes - 1) * n + np.arange(n), "right")
        level = np.concatenate([[1], 1 + np.cumsum(np.bincount(depth))])
        del depth, order, number, keys, up

        width = np.ones(total + 1, np.int64)  # ids of an unknown character
        if self.bytes_:
            width += sum((point >= x).astype(np.int64) for x in (0x80, 0x800, 0x10000))
        best, came, used, ids = np.full(total + 1, -np.inf), np.zeros(total + 1, np.int32), np.zeros(total + 1, np.int32), np.zeros(total + 1, np.int64)
        best[0] = 0
        many = np.flatnonzero(np.diff(level) >= FEW)
        wide = int(many[-1]) + 1 if len(many) else 0
        found = self.ending_pieces(1, int(level[wide]), char, parent)
        bounds = [np.searchsorted(x[0], level[: wide + 1]).tolist() for x in found]
        for d in range(wide):
            for (node, start, piece, score), bound in zip(found, bounds):
                if bound[d] < bound[d + 1]:
                    part = slice(bound[d], bound[d + 1])
                    sums = best[start[part]] + score[part]
                    more = np.flatnonzero(sums > best[node[part]])
                    own = node[part][more]
                    best[own], came[own], used[own] = sums[more], start[part][more], piece[part][more]
            part = slice(level[d], level[d + 1])
            ids[part] = ids[came[part]] + np.where(used[part] < 0, width[part], 1)
        tops, starts, pieces, made, wides = map(memoryview, (best, came, used, ids, width))  # quicker one by one
        for low in range(int(level[wide]), total + 1, 1 << 14):
            found = [np.concatenate(x) for x in zip(*self.ending_pieces(low, min(low + (1 << 14), total + 1), char, parent))]
            order = np.argsort(found[0], kind="stable")
            now, top, come, use = low, -np.inf, 0, 0
            for own, start, piece, score in zip(*(x[order].tolist() for x in found)):
                if own != now:
                    tops[now], starts[now], pieces[now], made[now] = top, come, use, made[come] + (wides[now] if use < 0 else 1)
                    now, top = own, -np.inf
                if (total_score := tops[start] + score) > top:
                    top, come, use = total_score, start, piece
            tops[now], starts[now], pieces[now], made[now] = top, come, use, made[come] + (wides[now] if use < 0 else 1)

        # back from the words' ends: an id's place is the number of ids before it
        counts = ids[stop]
        flat = np.empty(int(counts.sum()), np.int32)
        now, first, unknown = stop[stop > 0], (np.cumsum(counts) - counts)[stop > 0], []
        while len(now) >= FEW:
            start = came[now]
            flat[first + ids[start]] = used[now]
            odd = np.flatnonzero(used[now] < 0)
            unknown.extend(zip(now[odd].tolist(), (first + ids[start])[odd].tolist()))
            on = np.flatnonzero(start)
            now, first = start[on], first[on]
        out = memoryview(flat)
        for own, to in zip(now.tolist(), first.tolist()):
            while own:
                start, piece = starts[own], pieces[own]
                out[to + made[start]] = piece
                if piece < 0:
                    unknown.append((own, to + made[start]))
                own = start
        for own, to in unknown:
            flat[to : to + width[own]] = [self.bytes_[b] for b in chr(point[own]).encode()] if self.bytes_ else self.unknown
        return flat, counts

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of sorted words, one after the other, and the number of each word's; in blocks of bounded size."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        words = pa.concat_arrays([words])
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        chars = np.frombuffer(words.buffers()[2][offsets[0] : offsets[-1]].to_pybytes().decode().encode("utf-32-le"), np.int32)
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        done, at = [], 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, "right")))
            done.append(self.encode_block(chars[before : ends[to - 1]], sizes[at:to]))
            at = to
        return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])

    def encode_sorted(self, words: Sequence[str]) -> list[bytes]:
        """Piece ids of each of the sorted words, as the bytes of 32-bit numbers."""
        flat, counts = self.encode_words(pa.array(words, pa.string()))
        return [x.tobytes() for x in np.split(flat, np.cumsum(counts)[:-1])] if len(words) else []

    def marked_words(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), " ", MARK)
        if self.dummy_prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(MARK, texts, ""))
        texts = pa.concat_arrays([texts])
        if not len(texts) or not texts.buffers()[2]:
            return pa.array([[]] * len(texts), pa.list_(pa.string()))
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[: bounds[-1]]
        a, b, c = MARK.encode()
        mark = np.zeros(len(data) + 3, bool)  # as of the fourth place: does a mark start here
        mark[3:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
        starts = mark[3:] & ~mark[:-3]
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(starts)
        starts = starts[starts >= bounds[0]]
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, bounds[-1]).astype(np.int32)), texts.buffers()[2])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, bounds), pa.int32()), words)

    def encode(self, texts: pa.Array, known: dict | None = None) -> pa.ListArray:
        """Ids of every text; ``known`` held words of earlier batches and isn't needed any more."""
        words = self.marked_words(texts)
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        flat, sizes = self.encode_words(coded.dictionary.take(order))
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ids = rank[coded.indices.to_numpy(zero_copy_only=False)]
        at = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])
        place = np.repeat((at[ids] - ends[:-1]).astype(np.int32), sizes[ids]) + np.arange(ends[-1], dtype=np.int32)
        bounds = ends[np.concatenate([[0], np.cumsum(lengths)])]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[place], pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids; bytes that are no UTF-8 become U+FFFD."""
        parts = [bytes([int(p[3:5], 16)]) if k == "byte" else b" \xe2\x81\x87 " if k == "unknown" else b"" if k == "control" else p.encode() for p, k in zip(self.pieces, self.kinds)]
        flat = ids.flatten().fill_null(self.unknown)
        data = pa.array(parts, pa.binary()).take(flat) if len(flat) else pa.array([], pa.binary())
        data = data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        if len(flat):
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1][ends]
            whole = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), data.buffers()[2]])
        else:
            whole = pa.array([b""] * len(ids), pa.binary())
        try:
            texts = whole.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())
        texts = pc.replace_substring(texts, MARK, " ")
        return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts) if self.dummy_prefix else texts


def load_model(path: str | None = None, *, blob: bytes | None = None) -> PieceModel:
    """Read a model file (or its bytes); only the identity normaliser is known."""
    blob = blob if blob is not None else open(path, "rb").read()
    spec = sentencepiece_model_pb2.ModelProto.FromString(blob)
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models with the identity normaliser and escaped white space are supported")
    sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
    n = range(sp.get_piece_size())
    kinds = ["unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "byte" if sp.is_byte(i) else "normal" for i in n]
    return PieceModel([sp.id_to_piece(i) for i in n], kinds, [sp.get_score(i) for i in n], norm.add_dummy_prefix)


def _mapped(df: DataFrame, column: str, added: dict[str, str], made) -> DataFrame:
    """Add columns (name: type) that ``made`` gives for a slice of one column."""
    kept = [c for c in df.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_ROWS):
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *made(part.column(len(kept)))], names=[*kept, *added])

    rows = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`").alias("__in"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept), *(f"`{name}` {kind}" for name, kind in added.items())])
    return arrow_map(rows, run, schema)


def _model(spark: SparkSession, model: PieceModel | str):
    return spark.sparkContext.broadcast(load_model(model) if isinstance(model, str) else model)  # as large as the vocabulary


def encode_pieces(df: DataFrame, model: PieceModel | str, *, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """Add the piece ids of the whole text."""
    held = _model(df.sparkSession, model)
    return _mapped(df, text_col, {ids_col: "array<int>"}, lambda texts: [held.value.encode(texts)])


def decode_pieces(df: DataFrame, model: PieceModel | str, *, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of the piece ids."""
    held = _model(df.sparkSession, model)
    return _mapped(df, ids_col, {text_col: "string"}, lambda ids: [held.value.decode(ids)])


def round_trip(df: DataFrame, model: PieceModel | str, *, text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the piece ids and the text that they decode to, in one pass through the Python workers."""
    held = _model(df.sparkSession, model)

    def both(texts: pa.Array) -> list[pa.Array]:
        ids = held.value.encode(texts)
        return [ids, held.value.decode(ids)]

    return _mapped(df, text_col, {ids_col: "array<int>", decoded_col: "string"}, both)
